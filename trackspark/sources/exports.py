"""GPX, GeoJSON and trace-frame output."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.names import coarse_phase
from ..operators.tracks import downsample
from .archive import archive_tracks

# XML entities, number of frame points, coordinate format.
ENTITIES = [("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&apos;")]
FRAME_POINTS = 1500
GPX_HEAD = '<?xml version="1.0" encoding="UTF-8"?>\n<gpx version="1.1" creator="trackspark" xmlns="http://www.topografix.com/GPX/1/1">'
GPX_PART = 4096


def xml_escape(text) -> Column:
    out = F.coalesce(F.col(text) if isinstance(text, str) else text, F.lit(""))
    for raw, entity in ENTITIES:
        out = F.replace(out, F.lit(raw), F.lit(entity))
    return out


def gpx_lines(drafts: DataFrame, points: DataFrame) -> DataFrame:
    """GPX text in pieces ``(group_id, day_number, draft_id, part_no, text)``, in file order by those columns.

    ``drafts`` is ``(draft_id, group_id, day_number, name)``; ``points`` is ``(draft_id, seq, lng, lat[, ele])``. A long
    track is several pieces, so no track is ever one value.
    """
    ele = F.when(F.col("ele").isNotNull(), F.concat(F.lit("<ele>"), F.col("ele").cast("string"), F.lit("</ele>"))) if "ele" in points.columns else F.lit(None)
    point = F.concat(
        F.lit('      <trkpt lat="'), F.col("lat").cast("string"), F.lit('" lon="'), F.col("lng").cast("string"), F.lit('">'),
        F.coalesce(ele, F.lit("")), F.lit("</trkpt>"),
    )
    rows = points.select("draft_id", "seq", F.floor(F.col("seq") / GPX_PART).alias("part_no"), point.alias("t"))
    body = rows.groupBy("draft_id", "part_no").agg(F.array_sort(F.collect_list(F.struct("seq", "t"))).alias("r"))
    body = body.select("draft_id", "part_no", F.array_join(F.transform("r", lambda x: x["t"]), "\n").alias("text"))
    head = F.concat(F.lit("  <trk>\n    <name>"), xml_escape("name"), F.lit("</name>\n    <trkseg>"))
    meta = drafts.select("draft_id", "group_id", "day_number", head.alias("head"))
    inner = meta.drop("head").join(body, "draft_id")
    open_tag = meta.select("draft_id", "group_id", "day_number", F.lit(-1).cast("bigint").alias("part_no"), F.col("head").alias("text"))
    close = meta.select("draft_id", "group_id", "day_number", F.lit(1 << 60).alias("part_no"), F.lit("    </trkseg>\n  </trk>").alias("text"))
    return inner.unionByName(open_tag).unionByName(close).select("group_id", "day_number", "draft_id", "part_no", "text")


def write_gpx(drafts: DataFrame, points: DataFrame, path: str) -> None:
    """One folder per group holding one GPX document; its lines stream through the writer in order."""
    lines = gpx_lines(drafts, points)
    groups = drafts.select("group_id").distinct()
    edge = lambda day, text: groups.select("group_id", F.lit(day).alias("day_number"), F.lit(day).cast("bigint").alias("draft_id"), F.lit(0).cast("bigint").alias("part_no"), F.lit(text).alias("text"))
    whole = lines.unionByName(edge(-(1 << 30), GPX_HEAD)).unionByName(edge(1 << 30, "</gpx>"))
    ordered = whole.repartition("group_id").sortWithinPartitions("group_id", "day_number", "draft_id", "part_no")
    ordered.select("group_id", "text").write.mode("overwrite").partitionBy("group_id").text(path)


def tracks_to_geojson(points: DataFrame, key: str = "track_id", part: int = 65_536) -> DataFrame:
    """LineString features of six-decimal coordinates in pieces ``(key, part_no, geojson)``.

    A track's pieces joined in the order of ``part_no`` are its one feature: head, coordinates of ``part`` points each, tail.
    """
    pair = F.format_string("[%.6f,%.6f]", "lng", "lat")
    rows = points.groupBy(key, F.floor(F.col("seq") / part).alias("part_no")).agg(F.array_sort(F.collect_list(F.struct("seq", pair.alias("p")))).alias("r"))
    coords = F.array_join(F.transform("r", lambda x: x["p"]), ",")
    head = F.concat(F.lit('{"type":"Feature","properties":{"id":'), F.col(key).cast("string"), F.lit('},"geometry":{"type":"LineString","coordinates":['))
    body = rows.select(key, "part_no", F.concat(F.when(F.col("part_no") > 0, ",").otherwise(""), coords).alias("geojson"))
    ids = points.select(key).distinct()
    open_tag = ids.select(key, F.lit(-1).cast("bigint").alias("part_no"), head.alias("geojson"))
    close = ids.select(key, F.lit(1 << 60).alias("part_no"), F.lit("]}}").alias("geojson"))
    return body.unionByName(open_tag).unionByName(close)


def areas_to_geojson(area_vertices: DataFrame) -> DataFrame:
    """Polygon features: closed rings in order, six decimals. One row per area part."""
    ring = area_vertices.groupBy("area_id", "part_no", "ring_no").agg(F.array_sort(F.collect_list(F.struct("v", F.format_string("[%.6f,%.6f]", "lng", "lat").alias("p")))).alias("r"))
    pts = F.transform("r", lambda x: x["p"])
    closed = F.concat(F.lit("["), F.array_join(F.concat(pts, F.slice(pts, 1, 1)), ","), F.lit("]"))
    part = ring.select("area_id", "part_no", F.struct("ring_no", closed.alias("t")).alias("x")).groupBy("area_id", "part_no").agg(F.array_sort(F.collect_list("x")).alias("rings"))
    text = F.array_join(F.transform("rings", lambda x: x["t"]), ",")
    return part.select("area_id", "part_no", F.concat(F.lit('{"type":"Feature","properties":{"areaId":'), F.col("area_id").cast("string"), F.lit('},"geometry":{"type":"Polygon","coordinates":['), text, F.lit("]}}")).alias("geojson"))


def trace_frames(frames: DataFrame, points: DataFrame, max_points: int = FRAME_POINTS) -> DataFrame:
    """Frames ready to publish: coarse phase, geometry of at most 1500 points, encoded.

    ``frames`` is ``(frame_id, task_id, user_id, phase, ..)``, ``points`` ``(frame_id, seq, lng, lat)``. Frames without
    ids or with fewer than two points are dropped.
    """
    good = frames.where("task_id IS NOT NULL AND user_id IS NOT NULL")
    long = points.groupBy("frame_id").agg(F.count("*").alias("n")).where("n >= 2")
    good = good.join(long.select("frame_id"), "frame_id", "left_semi").withColumn("phase", coarse_phase("phase"))
    thin = downsample(points, max_points, "uniform", key="frame_id")
    text = archive_tracks(thin.select(F.col("frame_id").alias("track_id"), F.col("i").alias("seq"), "lng", "lat"))
    return good.join(text.select(F.col("track_id").alias("frame_id"), "encoded"), "frame_id")
