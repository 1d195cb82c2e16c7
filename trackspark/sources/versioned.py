"""Parquet tables that change atomically: bucket folders under a numbered manifest.

``path/data/<id>/bucket=<k>`` holds the rows of one bucket as one write left them; ``path/manifest/<number>.json`` names
the folder of every bucket. A change writes new folders for the buckets it touches and then renames a manifest into
place, which is the commit: readers see all of it or nothing, and a job that fails or is killed before leaves only
folders that no manifest names. The rename must be atomic and fail if the number is taken, as on HDFS and local disks; a
writer that comes second takes the newer manifest and does its work again on it if it touches a bucket that has changed.

A manifest has one entry per bucket, so its size is bounded by the number of buckets, which is fixed with the table.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable
from dataclasses import asdict, dataclass, field

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from ..plans.lineage import materialize, remove

BUCKET = "bucket"
#: Times that a writer starts again because another one was faster.
ATTEMPTS = 20


class Conflict(RuntimeError):
    """Another writer has committed this version."""


@dataclass(frozen=True)
class Manifest:
    """One state of the table; ``tag`` is free for the writer, for example the number of a micro-batch."""

    version: int
    key: str
    buckets: int
    schema: str
    folders: dict[str, str] = field(default_factory=dict)
    tag: int | None = None


class VersionedTable:
    """A table of ``buckets`` bucket folders, dealt by a hash of ``key``."""

    def __init__(self, spark: SparkSession, path: str, key: str, buckets: int = 64):
        self.spark, self.path, self.key, self.buckets = spark, path.rstrip("/"), key, buckets
        self._jvm = spark.sparkContext._jvm
        self._conf = spark.sparkContext._jsc.hadoopConfiguration()
        self._fs = self._place(self.path).getFileSystem(self._conf)

    @classmethod
    def at(cls, spark: SparkSession, path: str) -> VersionedTable:
        """The table that is at a path, with the key and buckets it was made with."""
        found = cls(spark, path, "").manifest()
        if found is None:
            raise FileNotFoundError(f"no table at {path}")
        return cls(spark, path, found.key, found.buckets)

    # ---- files

    def _place(self, name: str):
        return self._jvm.org.apache.hadoop.fs.Path(name)

    def _manifest_file(self, version: int) -> str:
        return f"{self.path}/manifest/{version:012d}.json"

    def versions(self) -> list[int]:
        """Numbers of the manifests that are there, in order."""
        folder = self._place(f"{self.path}/manifest")
        if not self._fs.exists(folder):
            return []
        names = [f.getPath().getName() for f in self._fs.listStatus(folder)]
        return sorted(int(n.removesuffix(".json")) for n in names if n.endswith(".json") and n[:1].isdigit())

    def manifest(self, version: int | None = None) -> Manifest | None:
        """The newest manifest, or the one of a version that is still kept."""
        if version is None:
            found = self.versions()
            if not found:
                return None
            version = found[-1]
        stream = self._fs.open(self._place(self._manifest_file(version)))
        try:
            return Manifest(**json.loads(self._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")))
        finally:
            stream.close()

    def commit(self, manifest: Manifest) -> None:
        """Put a manifest into place; raises :class:`Conflict` if its number is taken."""
        target = self._place(self._manifest_file(manifest.version))
        draft = self._place(f"{self.path}/manifest/.{uuid.uuid4().hex}")
        out = self._fs.create(draft, True)
        try:
            out.write(bytearray(json.dumps(asdict(manifest)).encode()))
        finally:
            out.close()
        rename = getattr(self._jvm.org.apache.hadoop.fs, "Options$Rename")
        options = self.spark.sparkContext._gateway.new_array(rename, 1)
        options[0] = rename.NONE
        context = self._jvm.org.apache.hadoop.fs.FileContext.getFileContext(draft.toUri() if draft.toUri().getScheme() else self._fs.getUri(), self._conf)
        try:
            context.rename(self._fs.makeQualified(draft), self._fs.makeQualified(target), options)
        except Exception as error:
            self._fs.delete(draft, False)
            if "FileAlreadyExists" in str(error):
                raise Conflict(f"version {manifest.version} of {self.path} is there already") from error
            raise

    # ---- rows

    def bucket(self) -> Column:
        """Bucket of a row; by the key's text, so that keys of another integer type find their rows."""
        return F.pmod(F.xxhash64(F.col(self.key).cast("string")), F.lit(self.buckets)).cast("int").alias(BUCKET)

    def _rows(self, manifest: Manifest, only: set[int] | None = None) -> DataFrame:
        schema = StructType.fromJson(json.loads(manifest.schema))
        folders = [f"{self.path}/{folder}" for b, folder in manifest.folders.items() if only is None or int(b) in only]
        return self.spark.read.schema(schema).parquet(*folders) if folders else self.spark.createDataFrame([], schema)

    def read(self, version: int | None = None) -> DataFrame:
        """All rows of one version; a later change does not alter what this frame reads."""
        manifest = self.manifest(version)
        if manifest is None:
            raise FileNotFoundError(f"no table at {self.path}")
        return self._rows(manifest)

    def read_keys(self, keys: DataFrame) -> DataFrame:
        """Rows of the given keys; reads their buckets only."""
        manifest = self.manifest()
        if manifest is None:
            raise FileNotFoundError(f"no table at {self.path}")
        touched = {r[0] for r in keys.select(self.bucket()).distinct().collect()}
        return self._rows(manifest, touched).join(keys.select(self.key).distinct(), self.key, "left_semi")

    def rewrite(self, keys: DataFrame, change: Callable[[DataFrame | None], DataFrame], tag: int | None = None) -> Manifest:
        """Give the buckets of ``keys`` the rows that ``change`` makes of their present rows (None: no table yet).

        At most ``buckets`` numbers reach the driver. Rows of one bucket are spread by size, so a key that holds a
        third of all rows is written by many tasks.
        """
        touched = {r[0] for r in keys.select(self.bucket()).distinct().collect()}
        for _ in range(ATTEMPTS):
            base = self.manifest()
            if base is not None and (base.key, base.buckets) != (self.key, self.buckets):
                raise ValueError(f"{self.path} is dealt by {base.key} over {base.buckets} buckets")
            rows = change(None if base is None else self._rows(base, touched))
            folder = f"data/{uuid.uuid4().hex}"
            made = self._write(rows, folder)
            if made - touched:
                self._drop(folder)
                raise ValueError("a change may only make rows of the keys it names")
            try:
                return self._publish(base, touched, {str(b): f"{folder}/{BUCKET}={b}" for b in sorted(made)}, rows.schema, tag)
            except Conflict:
                self._drop(folder)
        raise Conflict(f"{ATTEMPTS} other writers of {self.path} were faster")

    def _write(self, rows: DataFrame, folder: str) -> set[int]:
        target = f"{self.path}/{folder}"
        rows.withColumn(BUCKET, self.bucket()).hint("rebalance", BUCKET).write.partitionBy(BUCKET).parquet(target)
        names = [f.getPath().getName() for f in self._fs.listStatus(self._place(target))]
        return {int(n.split("=")[1]) for n in names if n.startswith(BUCKET + "=")}

    def _publish(self, base: Manifest | None, touched: set[int], made: dict[str, str], schema: StructType, tag: int | None) -> Manifest:
        """Commit on the newest manifest, as long as none of the touched buckets has changed since ``base``."""
        while True:
            now = self.manifest()
            before, current = ({} if m is None else m.folders for m in (base, now))
            if any(before.get(str(b)) != current.get(str(b)) for b in touched):
                raise Conflict("a touched bucket has changed")
            folders = {b: f for b, f in current.items() if int(b) not in touched} | made
            kept = json.loads(now.schema) if now is not None else None
            if kept is not None and StructType.fromJson(kept).simpleString() != schema.simpleString():
                raise AnalysisException(f"rows are {schema.simpleString()}, the table is {StructType.fromJson(kept).simpleString()}")
            new = Manifest(1 if now is None else now.version + 1, self.key, self.buckets, schema.json() if now is None else now.schema, folders, tag if tag is not None or now is None else now.tag)
            try:
                self.commit(new)
            except Conflict:
                continue
            return new

    def _drop(self, folder: str) -> None:
        remove(self.spark, f"{self.path}/{folder}")

    def vacuum(self, keep: int = 2) -> int:
        """Delete all but the last ``keep`` manifests and every folder that none of them names; returns the folders deleted.

        Call it when no write is under way: its folders are not named yet.
        """
        versions = self.versions()
        kept = versions[-keep:]
        named = {f.split("/")[1] + "/" + f.split("/")[2] for v in kept for f in self.manifest(v).folders.values()}
        for v in versions[:-keep]:
            self._fs.delete(self._place(self._manifest_file(v)), False)
        data, gone = self._place(f"{self.path}/data"), 0
        for write in self._fs.listStatus(data) if self._fs.exists(data) else []:
            name = write.getPath().getName()
            parts = [p.getPath().getName() for p in self._fs.listStatus(write.getPath())]
            buckets = [p for p in parts if p.startswith(BUCKET + "=")]
            unused = [b for b in buckets if f"{name}/{b}" not in named]
            for b in unused:
                self._drop(f"data/{name}/{b}")
            if len(unused) == len(buckets):
                self._drop(f"data/{name}")
            gone += len(unused)
        return gone


def replace_keys(table: VersionedTable, new_rows: DataFrame, keys: DataFrame | None = None) -> Manifest:
    """Replace all rows of every key in ``new_rows`` and ``keys`` in one step; a key without new rows is emptied.

    A null key is a key like any other. The new rows are written once first, so that what is read for the touched
    buckets and what is written for them are the same rows.
    """
    key = table.key
    new_rows = materialize(new_rows, "replace")
    mine = new_rows.select(key)
    every = mine if keys is None else mine.unionByName(keys.select(key))

    def change(stored: DataFrame | None) -> DataFrame:
        if stored is None:
            return new_rows
        types = lambda df: {f.name: f.dataType.simpleString() for f in df.schema}
        if types(stored) != types(new_rows):
            raise AnalysisException(f"rows are {types(new_rows)}, the table is {types(stored)}")
        gone = every.distinct().select(F.col(key).alias("_gone"))
        return stored.join(gone, F.col(key).eqNullSafe(F.col("_gone")), "left_anti").unionByName(new_rows)

    return table.rewrite(every, change)
