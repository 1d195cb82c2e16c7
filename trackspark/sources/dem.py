"""Elevation rasters: square big-endian int16 files to a table of cells or of bands of rows.

A band holds some whole rows of a raster as one array, and the first row of the next band, so that four neighbouring
cells always lie in one band. A lookup then moves one short array per band that is asked for.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.names import parse_dem_tile

VOID = -32768  # fixed value
BAND = 65_536  # cells of a raster decoded at a time
CELLS = "tile_lat int, tile_lng int, n int, r int, c int, ele int"
BAND_CELLS = 4096  # cells of a stored band, at least one row
BANDS = "tile_lat int, tile_lng int, n int, band int, first_row int, heights array<smallint>"
BATCH = 64  # bands of a raster in one record batch


def _cells(carry: list[str]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                n = row["n"]
                cells = np.frombuffer(row["content"], dtype=">i2")
                for first in range(0, n * n, BAND):
                    grid = cells[first : first + BAND].astype(np.int32)
                    at = np.arange(first, first + len(grid), dtype=np.int32)
                    same = lambda v, kind=np.int32: pa.array(np.full(len(grid), v, dtype=kind))  # noqa: E731, B023
                    yield pa.RecordBatch.from_arrays(
                        [same(row["tile_lat"]), same(row["tile_lng"]), same(n), pa.array(at // n), pa.array(at % n), pa.array(grid, mask=grid == VOID), *[same(row[c], np.int64) for c in carry]],
                        names=["tile_lat", "tile_lng", "n", "r", "c", "ele", *carry],
                    )

    return run


def _bands(carry: list[str]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                n, high = row["n"], max(1, BAND_CELLS // row["n"])
                cells = np.frombuffer(row["content"], dtype=">i2").reshape(n, n)
                firsts = np.arange(0, n, high)
                for some in np.split(firsts, range(BATCH, len(firsts), BATCH)):
                    parts = [cells[f : f + high + 1].ravel() for f in some.tolist()]
                    flat = np.concatenate(parts).astype(np.int16)
                    ends = np.cumsum([0, *map(len, parts)], dtype=np.int32)
                    heights = pa.ListArray.from_arrays(pa.array(ends), pa.array(flat, mask=flat == VOID))
                    same = lambda v, kind=np.int32: pa.array(np.full(len(some), v, dtype=kind))  # noqa: E731, B023
                    arrays = [same(row["tile_lat"]), same(row["tile_lng"]), same(n), pa.array((some // high).astype(np.int32)), pa.array(some.astype(np.int32)), heights]
                    yield pa.RecordBatch.from_arrays([*arrays, *[same(row[c], np.int64) for c in carry]], names=["tile_lat", "tile_lng", "n", "band", "first_row", "heights", *carry])

    return run


def rows_per_band(n: Column) -> Column:
    return F.greatest(F.lit(1), F.floor(F.lit(BAND_CELLS) / n).cast("int"))


def resolution(length: Column) -> Column:
    """Side of a square raster of that many bytes, 0 when the size is not n * n * 2."""
    n = F.floor(F.sqrt(length / 2) + 0.5).cast("bigint")
    return F.when((length > 0) & (n * n * 2 == length), n.cast("int")).otherwise(0)


def _usable(files: DataFrame, carry: list[str]) -> DataFrame:
    rows = files.withColumns({"n": resolution(F.length("content")), "t": parse_dem_tile("name")})
    return rows.where("n >= 2 AND t IS NOT NULL").select("t.tile_lat", "t.tile_lng", "n", "content", *[F.col(c).cast("bigint").alias(c) for c in carry])


def decode_rasters(files: DataFrame, carry: list[str] | None = None) -> DataFrame:
    """``(name, content)`` rows to cells; files of a wrong size or name are skipped, voids become NULL.

    Whole-number columns of ``carry``, such as the survey a file is from, come along.
    """
    carry = carry or []
    return _usable(files, carry).mapInArrow(_cells(carry), ", ".join([CELLS, *[f"{c} bigint" for c in carry]]))


def decode_bands(files: DataFrame, carry: list[str] | None = None) -> DataFrame:
    """``(name, content)`` rows to bands ``(tile_lat, tile_lng, n, band, first_row, heights)``; as :func:`decode_rasters` otherwise."""
    carry = carry or []
    return _usable(files, carry).mapInArrow(_bands(carry), ", ".join([BANDS, *[f"{c} bigint" for c in carry]]))


def _scatter(data: pa.Table) -> pa.Table:
    """The known cells of one band laid into its array."""
    lat, lng, n, band = (data.column(c)[0].as_py() for c in ("tile_lat", "tile_lng", "n", "band"))
    high = max(1, BAND_CELLS // n)
    heights = np.zeros(min(high + 1, n - band * high) * n, np.int16)
    void = np.ones(len(heights), bool)
    at = (np.asarray(data.column("r")) - band * high) * n + np.asarray(data.column("c"))
    heights[at], void[at] = np.asarray(data.column("z")), False
    whole = pa.ListArray.from_arrays(pa.array([0, len(heights)], pa.int32()), pa.array(heights, mask=void))
    row = [pa.array([v], pa.int32()) for v in (lat, lng, n, band, band * high)]
    return pa.Table.from_arrays([*row, whole], names=["tile_lat", "tile_lng", "n", "band", "first_row", "heights"])


def bands_of_cells(cells: DataFrame) -> DataFrame:
    """A cell table as bands; cells that are missing count as voids."""
    high = rows_per_band(F.col("n"))
    home = cells.withColumns({"_b": F.floor(F.col("r") / high).cast("int"), "_h": high})
    shared = F.when((F.col("r") % F.col("_h") == 0) & (F.col("r") > 0), F.col("_b") - 1)
    copies = home.withColumn("band", F.explode(F.array_compact(F.array("_b", shared))))
    known = copies.where("ele IS NOT NULL").select("tile_lat", "tile_lng", "n", "band", "r", "c", F.col("ele").cast("smallint").alias("z"))
    return known.groupBy("tile_lat", "tile_lng", "n", "band").applyInArrow(_scatter, BANDS)


def raster_files(spark: SparkSession, path: str, tiles: DataFrame | None = None) -> DataFrame:
    """``(name, content)`` of the ``.hgt`` files below a folder; of the asked ``(tile_lat, tile_lng)`` only, the others are not opened.

    Names are listed without contents. There are 64 800 one-degree tiles, which bounds the paths of the asked ones.
    """
    def load(where):
        files = spark.read.format("binaryFile").option("pathGlobFilter", "*.hgt").option("recursiveFileLookup", "true").load(where)
        return files.select("path", F.regexp_extract("path", "([^/]+)$", 1).alias("name"), "content")

    if tiles is None:
        return load(path).select("name", "content")
    listed = load(path).select("path", parse_dem_tile("name").alias("t")).where("t IS NOT NULL").select("path", "t.tile_lat", "t.tile_lng")
    asked = [r.path for r in listed.join(tiles.select("tile_lat", "tile_lng").distinct(), ["tile_lat", "tile_lng"], "left_semi").select("path").collect()]
    return load(asked).select("name", "content") if asked else spark.createDataFrame([], "name string, content binary")


def read_hgt(spark: SparkSession, path: str, tiles: DataFrame | None = None) -> DataFrame:
    """Cells of the ``.hgt`` files below a folder, or of the asked tiles."""
    return decode_rasters(raster_files(spark, path, tiles))


def read_hgt_bands(spark: SparkSession, path: str, tiles: DataFrame | None = None) -> DataFrame:
    """Bands of the ``.hgt`` files below a folder, or of the asked tiles; write the result partitioned by tile for pruned reads."""
    return decode_bands(raster_files(spark, path, tiles))
