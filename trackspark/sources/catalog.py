"""File catalogues: installed files, remote listings, tile grids, and their merge."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.names import EUROPE, dem_tile_name, in_europe, is_outdated, parse_dem_tile, parse_segment

# Fixed value: a listing row is the file's link, two words of date and time, and the size in bytes.
LISTING_ROW = '<a href="([EW]\\d+_[NS]\\d+)\\.rd5">[^<]+</a>\\s+\\S+\\s+\\S+\\s+(\\d+)'


def list_installed(spark: SparkSession, path: str, kind: str = "segment", name_pattern: str = "([^/]+)\\.[a-z0-9]+$") -> DataFrame:
    """``(name, size_bytes, installed_at)`` of installed files; only file metadata is read, other names are dropped."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path).select("path", "length", "modificationTime")
    name = F.regexp_extract("path", name_pattern, 1)
    parsed = parse_segment(name) if kind == "segment" else parse_dem_tile(name)
    rows = files.withColumns({"name": name, "p": parsed}).where("p IS NOT NULL")
    return rows.select("name", F.col("length").alias("size_bytes"), F.col("modificationTime").alias("installed_at"))


def parse_listing(pages: DataFrame) -> DataFrame:
    """Every well-named file in HTML listings: ``(page_id, name, size_bytes)``."""
    names = F.regexp_extract_all("html", F.lit(LISTING_ROW), F.lit(1))
    sizes = F.regexp_extract_all("html", F.lit(LISTING_ROW), F.lit(2))
    rows = pages.select("page_id", F.explode(F.arrays_zip(names.alias("n"), sizes.alias("s"))).alias("f"))
    rows = rows.select("page_id", F.col("f.n").alias("name"), F.col("f.s").cast("bigint").alias("size_bytes"))
    return rows.where(parse_segment("name").isNotNull())


def dem_grid(spark: SparkSession, europe_only: bool = True) -> DataFrame:
    """All one-degree tiles, north to south then west to east: ``(ord, tile_lat, tile_lng, name)``."""
    (w, e), (s, n) = (EUROPE["lng"], EUROPE["lat"]) if europe_only else ((-180, 179), (-90, 89))
    cols = e - w + 1
    rows = spark.range((n - s + 1) * cols).select(
        F.col("id").alias("ord"), (n - F.floor(F.col("id") / cols)).cast("int").alias("tile_lat"), (w + F.col("id") % cols).cast("int").alias("tile_lng")
    )
    return rows.withColumn("name", dem_tile_name("tile_lng", "tile_lat"))


def merge_catalog(remote: DataFrame, installed: DataFrame, kind: str = "segment", europe_only: bool = False) -> DataFrame:
    """Remote and installed files side by side, north to south then west to east.

    Both inputs are ``(name, size_bytes)``; adds ``lng, lat, is_installed, outdated``.
    """
    both = remote.select("name", F.col("size_bytes").alias("remote_size")).join(installed.select("name", F.col("size_bytes").alias("installed_size"), F.lit(True).alias("here")), "name", "full_outer")
    p = parse_segment("name") if kind == "segment" else parse_dem_tile("name")
    lng, lat = ("p.lng", "p.lat") if kind == "segment" else ("p.tile_lng", "p.tile_lat")
    rows = both.withColumn("p", p).where("p IS NOT NULL").select(
        "name", F.col(lng).alias("lng"), F.col(lat).alias("lat"), "remote_size", "installed_size",
        F.coalesce("here", F.lit(False)).alias("is_installed"), is_outdated("remote_size", "installed_size").alias("outdated"),
    )
    if europe_only:
        rows = rows.where(in_europe("lng", "lat"))
    return rows.orderBy(F.col("lat").desc(), "lng")
