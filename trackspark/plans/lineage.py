"""Cutting lineage in iterative jobs and writing shared intermediates once.

Both go to the folder named by ``spark.checkpoint.dir``, which every executor can reach, so a lost executor costs
neither the rounds before nor the table.
"""

from __future__ import annotations

import atexit
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_folder(spark: SparkSession) -> str:
    """The session's shared folder; a local session without one gets a private folder."""
    sc = spark.sparkContext
    folder = spark.conf.get("spark.checkpoint.dir", None) or sc.getCheckpointDir()
    if folder is None:
        if not sc.master.startswith("local") or sc.master.startswith("local-cluster"):
            raise ValueError("set spark.checkpoint.dir to a folder every executor can reach")
        folder = tempfile.mkdtemp(prefix="trackspark-")
        sc.setCheckpointDir(folder)
    return folder


def cut_lineage(df: DataFrame) -> DataFrame:
    """Write the small state of an iterative job, so that its next round starts from a table.

    A checkpoint would keep the size guessed for the plan it came from. The guess for a join is the product of its sides,
    so in a loop it gets twice the digits and more every round, all held by the driver; a table has the size of its files.
    """
    return materialize(df, "round")


def _file_system(spark: SparkSession, path: str):
    jvm = spark.sparkContext._jvm
    place = jvm.org.apache.hadoop.fs.Path(path)
    return place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), place


def path_exists(spark: SparkSession, path: str) -> bool:
    fs, place = _file_system(spark, path)
    return fs.exists(place)


def remove(spark: SparkSession, path: str) -> None:
    """Delete a folder of the shared storage."""
    fs, place = _file_system(spark, path)
    fs.delete(place, True)


_written: dict[str, set[str]] = {}


def materialize(df: DataFrame, name: str = "table", spread: bool = False) -> DataFrame:
    """Write a frame that several branches read to a parquet table and return the table.

    Readers still prune columns and push filters, and the optimizer knows its real size. ``spread`` writes a small
    table as several files, so that costly work on its rows is read into several tasks. Tables are deleted by
    :func:`discard` or at the end of the program.
    """
    spark = df.sparkSession
    if spread:
        df = df.repartition(max(spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions"))))
    root = f"{shared_folder(spark)}/trackspark"
    path = f"{root}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    _written.setdefault(spark.sparkContext.applicationId, set()).add(path)
    out = spark.read.schema(df.schema).parquet(path)
    out.written_to = path
    return out


def discard(*tables: DataFrame) -> None:
    """Delete tables of :func:`materialize` that nothing reads any more."""
    for t in tables:
        path = getattr(t, "written_to", None)
        if path is not None:
            remove(t.sparkSession, path)
            _written.get(t.sparkSession.sparkContext.applicationId, set()).discard(path)


def _clean_up() -> None:
    spark = SparkSession.getActiveSession()
    if spark is None:
        return
    for path in _written.get(spark.sparkContext.applicationId, ()):
        try:
            remove(spark, path)
        except Exception:  # noqa: BLE001  the storage may be gone already
            return


atexit.register(_clean_up)
