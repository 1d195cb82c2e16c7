"""Polygon tables: edges, sizes, centroids, representative points.

``area_vertices`` is ``(area_id, part_no, ring_no, v, lng, lat)`` with ``v`` dense from 0 and ring 0 the outer one.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.geo import KM_PER_DEG_LAT, KM_PER_DEG_LNG, METERS_PER_DEG
from ..functions.polygons import edge_distance_sql, edge_struct, inside_cell_sql, inside_sql, nearest_in_square_sql
from ..plans.chunks import with_neighbors
from ..plans.lineage import discard, materialize

RING = ["area_id", "part_no", "ring_no"]
# Entry samples per area, their offset, tolerance of the deepest point in metres.
SAMPLE_POINTS, SAMPLE_OFFSET_DEG, SAMPLE_MAX_SHARE = 8, 0.0045, 0.5
DEEPEST_TOLERANCE_M = 220.0


def bbox(points: DataFrame) -> DataFrame:
    """One row with the bounding box; the unit square when there are no points."""
    return points.agg(
        F.coalesce(F.min("lng"), F.lit(0.0)).alias("min_lng"), F.coalesce(F.min("lat"), F.lit(0.0)).alias("min_lat"),
        F.coalesce(F.max("lng"), F.lit(1.0)).alias("max_lng"), F.coalesce(F.max("lat"), F.lit(1.0)).alias("max_lat"),
    )


def rings(area_vertices: DataFrame) -> DataFrame:
    """One row per ring: its edges ``array<struct<lng, lat, lng2, lat2>>`` with the closing one, and its size in square degrees.

    Zero-length edges are dropped, so rings may be given open or closed.
    """
    near = with_neighbors(area_vertices, RING, "v", prev={"p_lng": "lng", "p_lat": "lat"})
    edge = F.struct(F.col("p_lng").alias("lng"), F.col("p_lat").alias("lat"), F.col("lng").alias("lng2"), F.col("lat").alias("lat2"))
    at = F.struct("lng", "lat")
    per_ring = near.groupBy(*RING).agg(
        F.collect_list(F.when(F.col("p_lng").isNotNull(), edge)).alias("e"), F.min_by(at, "v").alias("a"), F.max_by(at, "v").alias("b"),
        F.count("*").alias("n"), F.sum(F.col("p_lng") * F.col("lat") - F.col("lng") * F.col("p_lat")).alias("cross"),
    )
    closing = F.struct(F.col("b.lng").alias("lng"), F.col("b.lat").alias("lat"), F.col("a.lng").alias("lng2"), F.col("a.lat").alias("lat2"))
    edges = F.filter(F.array_append("e", closing), lambda e: (e["lng"] != e["lng2"]) | (e["lat"] != e["lat2"]))
    turn = F.coalesce("cross", F.lit(0.0)) + F.col("b.lng") * F.col("a.lat") - F.col("a.lng") * F.col("b.lat")
    return per_ring.select(*RING, edges.alias("edges"), "n", F.abs(turn / 2).alias("deg2"))


def shapes(area_vertices: DataFrame) -> DataFrame:
    """One row per area: all edges and the size in square degrees, holes taken off."""
    size = F.when(F.col("n") < 3, 0.0).when(F.col("ring_no") == 0, F.col("deg2")).otherwise(-F.col("deg2"))
    return rings(area_vertices).groupBy("area_id").agg(F.flatten(F.collect_list("edges")).alias("edges"), F.sum(size).alias("deg2"))


def _km2(deg2, lat):
    return F.greatest(F.lit(0.0), F.coalesce(deg2, F.lit(0.0))) * KM_PER_DEG_LNG * F.cos(F.radians(lat)) * KM_PER_DEG_LAT


def area_km2(areas: DataFrame, area_vertices: DataFrame) -> DataFrame:
    """Shoelace size: all outer rings minus holes, never negative; 0 without a usable ring."""
    out = areas.select("area_id", "lat").join(shapes(area_vertices).select("area_id", "deg2"), "area_id", "left")
    return out.select("area_id", _km2(F.col("deg2"), F.col("lat")).alias("km2"))


def centroid(area_vertices: DataFrame) -> DataFrame:
    """Mean of all vertices of all rings."""
    return area_vertices.groupBy("area_id").agg(F.avg("lng").alias("lng"), F.avg("lat").alias("lat"))


def largest_part(area_vertices: DataFrame) -> DataFrame:
    """Part with the most outer vertices, the first one on a tie: ``(area_id, part_no, vertices)``."""
    outer = area_vertices.where("ring_no = 0").groupBy("area_id", "part_no").agg(F.count("*").alias("vertices"))
    best = F.max_by(F.struct("part_no", "vertices"), F.struct("vertices", -F.col("part_no")))
    return outer.where("vertices >= 3").groupBy("area_id").agg(best.alias("b")).select("area_id", "b.*")


def sample_ring(area_vertices: DataFrame, max_points: int) -> DataFrame:
    """Every max(1, n / max)-th vertex of each ring, renumbered; rings left with fewer than three are dropped,
    and with an outer ring its holes.

    Holes keep at most half as many points as outer rings, but at least eight.
    """
    size = area_vertices.groupBy(*RING).agg(F.count("*").alias("n"))
    allowed = F.when(F.col("ring_no") == 0, F.lit(max(1, max_points))).otherwise(F.lit(max(8, max_points // 2)))
    size = size.withColumn("step", F.greatest(F.lit(1), F.floor(F.col("n") / allowed)))
    size = size.where(F.ceil(F.col("n") / F.col("step")) >= 3)
    outer = size.where("ring_no = 0").select("area_id", "part_no")
    size = size.join(outer, ["area_id", "part_no"], "left_semi")
    out = area_vertices.join(size, RING).where(F.col("v") % F.col("step") == 0)
    return out.withColumn("v", (F.col("v") / F.col("step")).cast("int")).select(*RING, "v", "lng", "lat")


def entry_samples(areas: DataFrame, area_vertices: DataFrame) -> DataFrame:
    """Up to eight ring vertices per area, pulled towards its inner point: ``(area_id, i, lng, lat)``."""
    best = largest_part(area_vertices).select("area_id", "part_no", F.col("vertices").alias("n"))
    outer = area_vertices.where("ring_no = 0").join(best, ["area_id", "part_no"])
    m = F.least(F.lit(SAMPLE_POINTS), F.col("n"))
    step = F.greatest(F.lit(1), F.floor(F.col("n") / m))
    picked = outer.where((F.col("v") % step == 0) & (F.col("v") / step < m))
    picked = picked.select("area_id", (F.col("v") / step).cast("int").alias("i"), F.col("lng").alias("v_lng"), F.col("lat").alias("v_lat"))
    rows = areas.select("area_id", "lng", "lat").join(picked, "area_id", "left")
    dx, dy = F.col("lng") - F.col("v_lng"), F.col("lat") - F.col("v_lat")
    length = F.hypot(dx, dy)
    pull = F.when(length < 1e-9, 0.0).otherwise(F.least(SAMPLE_OFFSET_DEG / length, F.lit(SAMPLE_MAX_SHARE)))
    return rows.select(
        "area_id", F.coalesce("i", F.lit(0)).alias("i"),
        F.coalesce(F.col("v_lng") + dx * pull, F.col("lng")).alias("lng"), F.coalesce(F.col("v_lat") + dy * pull, F.col("lat")).alias("lat"),
    )


def cos_ref(areas: DataFrame):
    """Cosine of the pool's mean latitude as a scalar column."""
    return areas.agg(F.coalesce(F.cos(F.radians(F.avg("lat"))), F.lit(1.0))).scalar()


def geometry(areas: DataFrame, area_vertices: DataFrame, cos) -> DataFrame:
    """Areas with their projected edge array, bounding box and ``km2``; areas without edges are left out."""
    k = F.col("_cos")
    out = areas.join(shapes(area_vertices), "area_id").where(F.size("edges") > 0).withColumn("_cos", cos)
    edges = F.transform("edges", lambda e: edge_struct(e["lng"] * k, e["lat"], e["lng2"] * k, e["lat2"]))
    out = out.withColumns({"km2": _km2(F.col("deg2"), F.col("lat")), "edges": edges}).drop("deg2")
    box = {"x0": (F.array_min, "ax"), "y0": (F.array_min, "ay"), "x1": (F.array_max, "ax"), "y1": (F.array_max, "ay")}
    return out.withColumns({n: f(F.col("edges")[c]) for n, (f, c) in box.items()})


def with_deepest(geoms: DataFrame, tolerance_deg: float, name: str = "deepest", only=None) -> DataFrame:
    """Add ``struct(d, x, y)``: a point whose distance to the boundary is within the tolerance of the largest.

    Starts from the box centre and a grid; every round splits the cells that could still hold a deeper point, until
    cells are so small that none can.
    All inside one row, without a join. ``only`` limits the work to rows where it holds.
    """
    grid = 6
    half = "(greatest(x1 - x0, y1 - y0) / {0} / 2)".format(grid)

    mid = f"named_struct('x', (x0 + x1) / 2, 'y', (y0 + y1) / 2, 'h', {half} * {grid})"
    cells = (
        f"array_append(transform(sequence(0, {grid * grid - 1}), i -> named_struct('x', (x0 + x1) / 2 + {half} * (2 * (i % {grid}) - {grid - 1}), "
        f"'y', (y0 + y1) / 2 + {half} * (2 * (i div {grid}) - {grid - 1}), 'h', {half})), {mid})"
    )
    d = edge_distance_sql("edges", "c.x", "c.y")
    rate = f"c -> named_struct('d', CASE WHEN {inside_sql('edges', 'c.x', 'c.y')} THEN {d} ELSE -{d} END, 'x', c.x, 'y', c.y, 'h', c.h)"
    guard = "true" if only is None else only
    quarter = "named_struct('x', c.x + c.h / 2 * {0}, 'y', c.y + c.h / 2 * {1}, 'h', c.h / 2)"
    split = "array(" + ", ".join(quarter.format(a, b) for a in (-1, 1) for b in (-1, 1)) + ")"
    open_cells = f"filter(acc.cells, c -> c.d + c.h * {math.sqrt(2)}D > acc.best.d + {tolerance_deg}D)"
    finer = f"transform(flatten(transform({open_cells}, c -> {split})), {rate})"
    step = f"transform(array({finer}), f -> named_struct('cells', f, 'best', greatest(acc.best, coalesce(array_max(f), acc.best))))[0]"
    start = f"transform(array(transform({cells}, {rate})), f -> named_struct('cells', f, 'best', array_max(f)))[0]"
    rounds = f"CAST(ceil(log2(greatest(2D, {half} * {grid * 1.5}D / {tolerance_deg}D))) AS INT) + 1"
    best = f"aggregate(sequence(1, {rounds}), {start}, (acc, i) -> {step}, acc -> acc.best)"
    return geoms.withColumn(name, F.expr(f"CASE WHEN {guard} THEN {best} END"))


def deepest_in(geoms: DataFrame, tolerance_deg: float) -> DataFrame:
    """``(area_id, d, x, y)``: a point whose distance to the boundary is within the tolerance of the largest.

    Branch and bound with squares as rows. A square keeps the edges that can be nearest to one of its points and knows
    whether its corner is inside, so it is rated at its centre by few edges; each round drops the squares that cannot
    beat the best point of their area by more than the tolerance and quarters the others. Squares of one large polygon
    spread over tasks.
    """
    side = F.greatest(F.col("x1") - F.col("x0"), F.col("y1") - F.col("y0")) * 1.01 + 1e-6
    squares = geoms.select(
        "area_id", (F.col("x0") - 5e-7).alias("qx"), (F.col("y0") - 5e-7).alias("qy"), side.alias("side"), F.lit(False).alias("corner_in"), "edges",
    )
    mx, my = "(qx + side / 2)", "(qy + side / 2)"
    rated_at = f"CASE WHEN {inside_cell_sql('edges', 'corner_in', 'qx', 'qy', mx, my)} THEN 1D ELSE -1D END * {edge_distance_sql('edges', mx, my)}"
    cx, cy, half = "(qx + (k % 2) * side / 2)", "(qy + (k div 2) * side / 2)", "(side / 2)"
    child = (
        f"named_struct('qx', {cx}, 'qy', {cy}, 'side', {half}, 'corner_in', {inside_cell_sql('edges', 'corner_in', 'qx', 'qy', cx, cy)}, "
        f"'edges', {nearest_in_square_sql('edges', f'({cx} + side / 4)', f'({cy} + side / 4)', half)})"
    )
    best = None
    while True:
        rated = materialize(squares.withColumn("d", F.expr(rated_at)), "rated", spread=True)
        discard(squares)
        top = rated.groupBy("area_id").agg(F.max(F.struct("d", F.expr(mx).alias("x"), F.expr(my).alias("y"))).alias("b"))
        top = top if best is None else top.unionByName(best).groupBy("area_id").agg(F.max("b").alias("b"))
        best, old = materialize(top, "deepest"), best
        open_ = rated.join(best, "area_id").where(F.col("d") + F.col("side") * 0.5**0.5 > F.greatest(F.col("b.d"), F.lit(0.0)) + tolerance_deg)
        squares = materialize(open_.select("area_id", F.explode(F.expr(f"transform(sequence(0, 3), k -> {child})")).alias("c")).select("area_id", "c.*"), "squares", spread=True)
        discard(rated, *([old] if old is not None else []))
        if squares.isEmpty():
            return best.select("area_id", "b.*")


def deepest_points(areas: DataFrame, area_vertices: DataFrame, tolerance_m: float = DEEPEST_TOLERANCE_M) -> DataFrame:
    """Centre of (nearly) the largest inscribed circle per area: ``(area_id, lng, lat, depth_m)``.

    Areas without usable rings fall back to their given point with depth 0.
    """
    cos = cos_ref(areas)
    found = deepest_in(geometry(areas, area_vertices, cos), tolerance_m / METERS_PER_DEG).withColumn("_cos", cos)
    found = found.select("area_id", (F.col("x") / F.col("_cos")).alias("d_lng"), F.col("y").alias("d_lat"), "d")
    out = areas.select("area_id", "lng", "lat").join(found, "area_id", "left")
    good = F.col("d") > 0
    return out.select(
        "area_id", F.when(good, F.col("d_lng")).otherwise(F.col("lng")).alias("lng"), F.when(good, F.col("d_lat")).otherwise(F.col("lat")).alias("lat"),
        F.when(good, F.col("d") * METERS_PER_DEG).otherwise(0.0).alias("depth_m"),
    )
