"""Way messages: TAB rows with a header and 13 named columns."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..plans.lineage import materialize

# Positions of the columns used.
LNG, LAT, ELE, DIST, TAGS = 0, 1, 2, 3, 9


def parse_messages(lines: DataFrame) -> DataFrame:
    """``(track_id, row_no, line)`` with the header as row 0 to typed rows; rows of up to nine columns are dropped."""
    cells = F.split("line", "\t")
    number = lambda i: F.coalesce(F.expr(f"try_cast(trim(cells[{i}]) AS BIGINT)"), F.lit(0).cast("bigint"))
    rows = lines.where("row_no > 0").withColumn("cells", cells).where(F.size("cells") > TAGS)
    return rows.select("track_id", "row_no", number(LNG).alias("key_lng"), number(LAT).alias("key_lat"), number(DIST).alias("dist_m"), F.col("cells")[TAGS].alias("way_tags"))


def numbered_lines(spark: SparkSession, paths: str | list[str]) -> DataFrame:
    """``(file, row_no, line)`` of text files, numbered from 0 in each file.

    Files are read in byte ranges, so a long one is spread over many tasks: lines carry the range they start in and
    their place in the order of reading, and only one count per range is summed along a file.
    """
    lines = spark.read.option("lineSep", "\n").text(paths).select(
        F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"),
        F.monotonically_increasing_id().alias("id"), F.regexp_replace("value", "\r$", "").alias("line"),
    )
    lines = materialize(lines, "lines")
    before = Window.partitionBy("file").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    blocks = lines.groupBy("file", "block").agg(F.min("id").alias("first"), F.count("*").alias("n"))
    blocks = blocks.select("file", "block", (F.coalesce(F.sum("n").over(before), F.lit(0)) - F.col("first")).alias("shift"))
    return lines.join(blocks, ["file", "block"]).select("file", (F.col("id") + F.col("shift")).cast("int").alias("row_no"), "line")


def read_messages(spark: SparkSession, path: str, tracks: list[int] | None = None, name: str = r"([0-9]+)\.tsv$") -> DataFrame:
    """One file per track, named ``<track_id>.tsv`` (or by a pattern for the path whose group is the track's id).

    ``tracks`` reads the files of some tracks only. Files of other names and empty lines are skipped.
    """
    lines = numbered_lines(spark, path if tracks is None else [f"{path}/{t}.tsv" for t in tracks])
    rows = lines.select(F.expr("try_cast(nullif(regexp_extract(file, {}, 1), '') AS BIGINT)".format("r'" + name + "'")).alias("track_id"), "row_no", "line")
    return parse_messages(rows.where("track_id IS NOT NULL AND line <> ''"))
