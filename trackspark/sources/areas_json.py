"""Area catalogues in JSON: geometry to vertices, nested listings to rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

_NESTED = {2: "array<array<double>>", 3: "array<array<array<double>>>", 4: "array<array<array<array<double>>>>"}
_GEOMETRY = "struct<coordinates:string,geometries:array<struct<coordinates:string>>>"
_POLYGONS = _NESTED[4]


def _polygons(text: Column) -> Column:
    """Polygons (lists of rings) of a coordinates text; the number of opening brackets tells the kind."""
    depth = F.length(F.regexp_replace(F.regexp_substr(text, F.lit("^[\\[\\s]*")), "\\s", ""))
    parse = lambda d: F.from_json(text, _NESTED[d])
    return (
        F.when(depth == 4, parse(4)).when(depth == 3, F.array(parse(3))).when(depth == 2, F.array(F.array(parse(2))))
        .otherwise(F.expr("array()").cast(_POLYGONS))
    )


def read_areas(areas: DataFrame) -> DataFrame:
    """Vertices of GeoJSON polygons, multi-polygons, geometry collections and bare rings.

    ``areas`` is ``(area_id, geometry)`` with the geometry as JSON text; NULL or unparsable geometry yields nothing.
    Parts are numbered by position over all members; a polygon whose outer ring has fewer than three points is left out
    with its holes.
    """
    g = areas.withColumn("g", F.from_json("geometry", _GEOMETRY)).where("g IS NOT NULL")
    none = F.expr("array()").cast(_POLYGONS)
    own = F.coalesce(_polygons(F.col("g.coordinates")), none)
    members = F.flatten(F.transform("g.geometries", lambda c: F.coalesce(_polygons(c["coordinates"]), none)))
    g = g.withColumn("own", own)
    rows = g.select("area_id", F.when(F.size("own") > 0, F.col("own")).otherwise(F.coalesce(members, none)).alias("polys"))
    per = rows.select("area_id", F.posexplode("polys").alias("part_no", "rings"))
    good = lambda ring: F.filter(ring, lambda p: (F.size(p) >= 2) & p[0].isNotNull() & p[1].isNotNull())
    per = per.withColumn("rings", F.transform("rings", good)).where(F.coalesce(F.size(F.get("rings", F.lit(0))) >= 3, F.lit(False)))
    out = per.select("area_id", "part_no", F.posexplode("rings").alias("ring_no", "ring")).where(F.size("ring") >= 3)
    out = out.select("area_id", "part_no", "ring_no", F.posexplode("ring").alias("v", "pt"))
    return out.select("area_id", "part_no", "ring_no", "v", F.col("pt")[0].alias("lng"), F.col("pt")[1].alias("lat"))


def flatten_areas(bodies: DataFrame) -> DataFrame:
    """Rows of ``{"areasByLevel": {level: [{id, name}, ..]}}`` bodies; the level name is the map's key."""
    kind = "struct<areasByLevel:map<string,array<struct<id:bigint,name:string>>>>"
    level = bodies.select("body_id", F.explode(F.from_json("body", kind)["areasByLevel"]).alias("level_name", "items"))
    item = level.select("body_id", "level_name", F.explode("items").alias("a")).where("a.id IS NOT NULL")
    return item.select("body_id", "level_name", F.col("a.id").alias("area_id"), F.col("a.name").alias("name"))


def flatten_groups(bodies: DataFrame) -> DataFrame:
    """Special groups per country; a group without countries keeps one row (country 0, no selector)."""
    kind = "array<struct<id:bigint,name:string,countries:array<struct<countryId:int,selectorLevelId:int>>>>"
    group = bodies.select("body_id", F.explode(F.from_json("body", kind)).alias("g")).where("g.id IS NOT NULL")
    listed = F.coalesce(F.size("g.countries") > 0, F.lit(False))
    rows = group.select("body_id", "g", listed.alias("listed"), F.explode_outer("g.countries").alias("c"))
    rows = rows.where("NOT listed OR c.countryId IS NOT NULL")
    return rows.select("body_id", F.col("g.id").alias("group_id"), F.col("g.name").alias("name"), F.coalesce("c.countryId", F.lit(0)).alias("country_id"), F.col("c.selectorLevelId").alias("selector_level"))


def level_names(bodies: DataFrame) -> DataFrame:
    """Level id to name over all countries of each body; the last one listed wins."""
    kind = "array<struct<levels:array<struct<id:int,name:string>>>>"
    land = bodies.select("body_id", F.posexplode(F.from_json("body", kind)).alias("i", "c"))
    level = land.select("body_id", "i", F.posexplode("c.levels").alias("j", "l")).where("l.id IS NOT NULL AND l.name IS NOT NULL")
    return level.groupBy("body_id", F.col("l.id").alias("level_id")).agg(F.max_by("l.name", F.struct("i", "j")).alias("name"))
