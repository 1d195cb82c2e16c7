"""Nearest neighbours among points and distances to polylines."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.geo import KNN_KM_PER_DEG, haversine_km, point_segment_geo_km, point_segment_km, unit_xyz
from ..functions.names import category_key
from ..plans.chunks import with_neighbors
from ..plans.lineage import materialize
from ..plans.nearest import nearest

HOLE_KNN = 8  # fixed value
REWARD_SCALE_KM, REWARD_FLOOR, REWARD_UNKNOWN = 10.0, 0.1, 1.0  # fixed values
PLANAR_ROOT_KM = 1600.0
PRESENCE_KM = 200.0  # fixed value
ASKERS = 8192  # places of a square that one task asks for


def _planar(points: DataFrame, prefix: str) -> DataFrame:
    k = F.cos(F.radians("_ref"))
    return points.withColumns({
        prefix + "x": F.col("lng") * k * KNN_KM_PER_DEG, prefix + "y": F.col("lat") * KNN_KM_PER_DEG, prefix + "z": F.lit(0.0),
    })


def _with_ref(points: DataFrame, pool: DataFrame, group: list[str]) -> DataFrame:
    """Reference latitude: mean of the whole pool, or of each group's own pool."""
    if not group:
        return points.withColumn("_ref", pool.agg(F.avg("lat")).scalar())
    return points.join(pool.groupBy(*group).agg(F.avg("lat").alias("_ref")), group)


def _sites(pool: DataFrame, id_col: str, group: list[str]) -> DataFrame:
    rows = _planar(_with_ref(pool, pool, group), "s")
    return rows.select(*group, F.col(id_col).alias("sid"), "sx", "sy", "sz", F.lit(0.0).alias("sr"))


def _distance():
    return F.hypot(F.col("sx") - F.col("qx"), F.col("sy") - F.col("qy"))


def knn(points: DataFrame, k: int, id_col: str = "area_id", group: list[str] | None = None, levels: int = 5) -> DataFrame:
    """The ``k`` nearest other points of every point: ``(group, id, nbr_id, rank, km)``; ties by id.

    Planar distance in the pool's (or group's) own projection.
    """
    group = group or []
    sites = _sites(points, id_col, group)
    asks = sites.select(*group, F.col("sid").alias("qid"), F.col("sx").alias("qx"), F.col("sy").alias("qy"), F.col("sz").alias("qz"))
    out = nearest(asks, sites, _distance(), k, group, exclude=F.col("sid") == F.col("qid"), levels=levels, root=PLANAR_ROOT_KM, slack=1e-9, spare=1)
    return out.select(*group, F.col("qid").alias(id_col), F.col("sid").alias("nbr_id"), "rank", F.col("dist").alias("km"))


def nearest_dist(points: DataFrame, id_col: str = "area_id", group: list[str] | None = None) -> DataFrame:
    """Distance to the nearest other point; alone in its pool means no row."""
    return knn(points, 1, id_col, group).drop("rank", "nbr_id")


def _counts(km: float, strips: int = 24):
    """Task of :func:`count_within`: sites in strips ordered by x; per strip the sure part by bisection, the rest by distance."""
    height, flat = 2 * km / strips, pa.schema([("x", pa.float64()), ("y", pa.float64()), ("n", pa.int64())])

    def run(data: pa.Table) -> pa.Table:
        x, y, n, ask = (np.asarray(data.column(c)) for c in ("sx", "sy", "n", "ask"))
        qx, qy = x[ask], y[ask]
        x, y, n = x[~ask], y[~ask], n[~ask]
        strip = np.floor(y / height).astype(np.int64)
        order = np.lexsort((x, strip))
        x, y, n, strip = x[order], y[order], n[order], strip[order]
        upto = np.append(0, np.cumsum(n))
        total = np.zeros(len(qx), np.int64)
        for s in np.unique(strip):
            lo, hi = np.searchsorted(strip, (s, s + 1))
            xs, ys, ns = x[lo:hi], y[lo:hi], n[lo:hi]
            # Distances in y from each asker to the strip's own points, near and far.
            near = np.maximum(0.0, np.maximum(ys.min() - qy, qy - ys.max()))
            far = np.maximum(np.abs(ys.min() - qy), np.abs(ys.max() - qy))
            mine = np.flatnonzero(near < km)
            if not len(mine):
                continue
            wide = np.sqrt(km * km - near[mine] ** 2) * (1 + 1e-9) + 1e-9
            sure = np.sqrt(np.maximum(km * km - far[mine] ** 2, 0.0)) * (1 - 1e-9) - 1e-9
            px = qx[mine]
            a, d = np.searchsorted(xs, px - wide, "left"), np.searchsorted(xs, px + wide, "right")
            b, c = np.searchsorted(xs, px - sure, "left"), np.searchsorted(xs, px + sure, "right")
            some = sure > 0
            b, c = np.where(some, b, d), np.where(some, c, d)
            total[mine] += np.where(some, upto[lo + c] - upto[lo + b], 0)
            for first, last in ((a, b), (c, d)):
                for at, who in _ranges(first, last):
                    close = np.hypot(xs[at] - px[who], ys[at] - qy[mine[who]]) < km
                    np.add.at(total, mine[who[close]], ns[at[close]])
        return pa.table({"x": qx, "y": qy, "n": total}, schema=flat)

    return run


def _ranges(first: np.ndarray, last: np.ndarray, most: int = 1 << 20):
    """Positions of the ranges and the range each belongs to, in pieces of about ``most``."""
    size = np.maximum(last - first, 0)
    end = np.cumsum(size)
    at = 0
    while at < len(size):
        done = end[at - 1] if at else 0
        to = max(at + 1, int(np.searchsorted(end, done + most, "right")))
        k = size[at:to]
        if k.sum():
            who = np.repeat(np.arange(at, to), k)
            yield np.arange(len(who)) - np.repeat(np.cumsum(k) - k, k) + first[who], who
        at = to


def count_within(points: DataFrame, km: float, id_col: str = "area_id") -> DataFrame:
    """Other points strictly nearer than ``km``: ``(id, n)``.

    Places are dealt to squares of side ``km``, a crowded square's askers to several parts, and each part meets the
    places of the nine squares around. A task counts what is surely inside by bisection, so an asker is compared only with the places
    along the circle's edge.
    """
    sites = materialize(_sites(points, id_col, []).select("sid", "sx", "sy"), "sites")
    places = sites.groupBy("sx", "sy").agg(F.count("*").alias("n")).withColumns({"cx": F.floor(F.col("sx") / km), "cy": F.floor(F.col("sy") / km)})
    parts = places.groupBy("cx", "cy").agg(F.ceil(F.count("*") / ASKERS).alias("parts"))
    asks = places.join(parts, ["cx", "cy"]).withColumn("part", F.pmod(F.xxhash64("sx", "sy"), F.col("parts")))
    asks = asks.select("cx", "cy", "part", "sx", "sy", F.lit(0).cast("bigint").alias("n"), F.lit(True).alias("ask"))
    step = F.array(*[F.lit(i) for i in (-1, 0, 1)])
    around = places.withColumn("dx", F.explode(step)).withColumn("dy", F.explode(step))
    around = around.withColumns({"cx": F.col("cx") + F.col("dx"), "cy": F.col("cy") + F.col("dy")}).join(parts, ["cx", "cy"])
    around = around.withColumn("part", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("parts") - 1)))
    rows = asks.unionByName(around.select("cx", "cy", "part", "sx", "sy", "n", F.lit(False).alias("ask")))
    found = rows.groupBy("cx", "cy", "part").applyInArrow(_counts(km), "x double, y double, n bigint")
    at = (F.col("sx") == F.col("x")) & (F.col("sy") == F.col("y"))
    return sites.join(found, at).select(F.col("sid").alias(id_col), (F.col("n") - 1).alias("n"))


def nearest_to(points: DataFrame, queries: DataFrame, id_col: str = "area_id", query_id: str = "qid") -> DataFrame:
    """Nearest pool point to each outside point: ``(query_id, id, km)``; the pool's projection is used."""
    asks = _planar(_with_ref(queries, points, []), "q").select(F.col(query_id).alias("qid"), "qx", "qy", "qz")
    out = nearest(asks, _sites(points, id_col, []), _distance(), 1, levels=5, root=PLANAR_ROOT_KM, slack=1e-9)
    return out.select(F.col("qid").alias(query_id), F.col("sid").alias(id_col), F.col("dist").alias("km"))


def _globe(points: DataFrame, prefix: str, lng="lng", lat="lat") -> DataFrame:
    x, y, z = unit_xyz(lng, lat)
    return points.withColumns({prefix + "x": x, prefix + "y": y, prefix + "z": z})


def segments_of(line: DataFrame, group: str, order: str) -> DataFrame:
    """Polyline legs as search sites: ``(group, sid, a_*, b_*, s*, sr)`` with ``sid`` the end vertex's number."""
    legs = with_neighbors(line.select(group, order, "lng", "lat"), group, order, prev={"a_lng": "lng", "a_lat": "lat"}).where("a_lng IS NOT NULL")
    legs = legs.select(group, F.col(order).alias("sid"), "a_lng", "a_lat", F.col("lng").alias("b_lng"), F.col("lat").alias("b_lat"))
    legs = _globe(legs.withColumns({"_m": (F.col("a_lng") + F.col("b_lng")) / 2, "_n": (F.col("a_lat") + F.col("b_lat")) / 2}), "s", "_m", "_n")
    ax, ay, az = unit_xyz("a_lng", "a_lat")
    bx, by, bz = unit_xyz("b_lng", "b_lat")
    def reach(x, y, z):
        return F.sqrt((F.col("sx") - x) ** 2 + (F.col("sy") - y) ** 2 + (F.col("sz") - z) ** 2)
    return legs.withColumn("sr", F.greatest(reach(ax, ay, az), reach(bx, by, bz))).drop("_m", "_n")


def min_dist(points: DataFrame, line: DataFrame, form: str = "vertex", point_id: str = "area_id", group: str = "plan_id", order: str = "seq", levels: int = 5) -> DataFrame:
    """Shortest distance from points to their plan's polyline: ``(group, point_id, km, site)``.

    ``form``: ``vertex`` (to the nearest vertex) or ``segment`` (foot point in degrees, great-circle to it).
    """
    asks = _globe(points, "q").select(group, F.col(point_id).alias("qid"), "qx", "qy", "qz", F.col("lng").alias("q_lng"), F.col("lat").alias("q_lat"))
    if form == "vertex":
        sites = _globe(line, "s").select(group, F.col(order).alias("sid"), "sx", "sy", "sz", F.lit(0.0).alias("sr"), F.col("lng").alias("s_lng"), F.col("lat").alias("s_lat"))
        metric = haversine_km("q_lng", "q_lat", "s_lng", "s_lat")
    else:
        sites = segments_of(line, group, order)
        metric = point_segment_geo_km("q_lng", "q_lat", "a_lng", "a_lat", "b_lng", "b_lat")
    out = nearest(asks, sites, metric, 1, [group], levels=levels)
    return out.select(group, F.col("qid").alias(point_id), F.col("dist").alias("km"), F.col("sid").alias("site"))


def thin_line(line: DataFrame, target: int = 3000, group: str = "plan_id") -> DataFrame:
    """Every max(1, n / target)-th vertex, as the scoring baseline uses."""
    n = line.groupBy(group).agg(F.count("*").alias("n"))
    step = F.greatest(F.lit(1).cast("bigint"), F.floor(F.col("n") / target))
    keep = n.select(group, F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("n") - 1, step)).alias("seq"))
    return line.join(keep, [group, "seq"])


def cheapest_insert(points: DataFrame, route: DataFrame, point_id: str = "area_id", group: str = "plan_id") -> DataFrame:
    """Leg where inserting a point costs least: ``(group, point_id, pos, detour_km)``; the first leg wins ties."""
    asks = _globe(points, "q").select(group, F.col(point_id).alias("qid"), "qx", "qy", "qz", F.col("lng").alias("q_lng"), F.col("lat").alias("q_lat"))
    cost = (
        haversine_km("a_lng", "a_lat", "q_lng", "q_lat") + haversine_km("q_lng", "q_lat", "b_lng", "b_lat")
        - haversine_km("a_lng", "a_lat", "b_lng", "b_lat")
    )
    out = nearest(asks, segments_of(route, group, "pos"), cost, 1, [group], slack=0.02)
    return out.select(group, F.col("qid").alias(point_id), F.col("sid").alias("pos"), F.col("dist").alias("detour_km"))


def nearest_segment(points: DataFrame, route: DataFrame, max_km: float = 0.05, point_id: str = "qid", group: str = "plan_id", order: str = "pos") -> DataFrame:
    """Nearest leg of the point's own route, only when within ``max_km``."""
    asks = _globe(points, "q").select(group, F.col(point_id).alias("qid"), "qx", "qy", "qz", F.col("lng").alias("q_lng"), F.col("lat").alias("q_lat"))
    metric = point_segment_km("q_lng", "q_lat", "a_lng", "a_lat", "b_lng", "b_lat")
    out = nearest(asks, segments_of(route, group, order), metric, 1, [group], slack=0.02)
    return out.where(F.col("dist") <= max_km).select(group, F.col("qid").alias(point_id), F.col("sid").alias(order), F.col("dist").alias("km"))


def map_waypoints(waypoints: DataFrame, points: DataFrame, tolerance_km: float = 0.5) -> DataFrame:
    """Closest track vertex per way-point in the track's own flat projection, -1 beyond the tolerance."""
    group = ["track_id"]
    sites = _sites(points, "seq", group)
    asks = _planar(_with_ref(waypoints, points, group), "q").select("track_id", F.col("pos").alias("qid"), "qx", "qy", "qz")
    out = nearest(asks, sites, _distance(), 1, group, levels=5, root=PLANAR_ROOT_KM, slack=1e-9)
    idx = F.when(F.col("dist") <= tolerance_km, F.col("sid")).otherwise(-1)
    found = out.select("track_id", F.col("qid").alias("pos"), idx.alias("idx"))
    return waypoints.join(found, ["track_id", "pos"], "left").fillna(-1, ["idx"])


def category_reward(areas: DataFrame) -> DataFrame:
    """Reward per category from the mean distance to the nearest area of the same category."""
    named = areas.withColumn("category", category_key("country_id", "level_id", "special_group_id"))
    near = nearest_dist(named, "area_id", ["category"])
    size = named.groupBy("category").agg(F.count("*").alias("n"))
    sums = near.groupBy("category").agg(F.sum("km").alias("km"))
    mean = F.coalesce(F.col("km"), F.lit(0.0)) / F.col("n")
    reward = F.greatest(F.lit(REWARD_FLOOR), F.when(mean > 0, mean / REWARD_SCALE_KM).otherwise(REWARD_UNKNOWN))
    return size.join(sums, "category", "left").select("category", "n", mean.alias("mean_km"), reward.alias("reward"))


def knn_enclosed(nbrs: DataFrame, visited: DataFrame) -> DataFrame:
    """Share of each area's nearest areas that a user has visited; users without any there are left out."""
    hits = nbrs.join(visited.select("user_id", F.col("area_id").alias("nbr_id")), "nbr_id").groupBy("user_id", "area_id").agg(F.count("*").alias("hits"))
    size = nbrs.groupBy("area_id").agg(F.count("*").alias("k"))
    return hits.join(size, "area_id").select("user_id", "area_id", (F.col("hits") / F.col("k")).alias("fraction"))


def presence_check(plans: DataFrame, distances: DataFrame, radius_km: float = PRESENCE_KM) -> DataFrame:
    """Nearest candidate of every plan and whether it is near enough to plan at all; a plan without any is rejected."""
    near = plans.select("plan_id").distinct().join(distances.groupBy("plan_id").agg(F.min("km").alias("nearest_km")), "plan_id", "left")
    return near.withColumn("accepted", F.coalesce(F.col("nearest_km") <= radius_km, F.lit(False)))
