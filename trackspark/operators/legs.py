"""Routed legs: cache look-up, fallback costs, detours, reachability."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.budget import effort_km
from ..functions.geo import haversine_km
from ..functions.names import leg_key
from ..plans.chunks import with_neighbors
from .neighbors import min_dist

ROAD_FACTOR = 1.3  # fixed value: straight line to road
MAX_GAP_KM = 2.0  # fixed value
ENDS = ["a_lng", "a_lat", "b_lng", "b_lat"]


def with_key(legs: DataFrame) -> DataFrame:
    return legs.withColumn("k", leg_key(*ENDS))


def distinct_legs(legs: DataFrame) -> DataFrame:
    return with_key(legs).dropDuplicates(["k"])


def resolve_legs(requests: DataFrame, known: DataFrame) -> DataFrame:
    """One row per distinct requested leg: ``(k, requests, status, hits, misses)``.

    ``status`` is hit, miss or recompute (known only approximately). The first request of an unknown leg is the
    miss, every further one a hit.
    """
    asked = with_key(requests).groupBy("k").agg(F.count("*").alias("requests"))
    have = known.select("k", "approximate", F.lit(True).alias("found"))
    out = asked.join(have, "k", "left")
    status = F.when(F.col("found").isNull(), "miss").when(F.col("approximate"), "recompute").otherwise("hit")
    misses = F.when(F.col("found").isNull(), 1).otherwise(0)
    return out.select("k", "requests", status.alias("status"), (F.col("requests") - misses).alias("hits"), misses.alias("misses"))


def cache_ratio(resolved: DataFrame) -> DataFrame:
    """Hits, misses and hit ratio over all requests."""
    hits, misses = F.sum("hits"), F.sum("misses")
    return resolved.agg(hits.alias("hits"), misses.cast("bigint").alias("misses"), F.coalesce(hits / (hits + misses), F.lit(0.0)).alias("ratio"))


def leg_cost_or_fallback(legs: DataFrame, alpha: float = 0.1) -> DataFrame:
    """km, climb and effort; a failed leg counts 1.3 times the straight line and no climb."""
    failed = F.col("km").isNull()
    km = F.when(failed, ROAD_FACTOR * haversine_km(*ENDS)).otherwise(F.col("km"))
    out = legs.withColumns({"km": km, "climb_m": F.when(failed, 0.0).otherwise(F.col("climb_m")), "failed": failed})
    return out.withColumn("effort", effort_km("km", "climb_m", alpha))


def waypoint_detour(route: DataFrame, legs: DataFrame) -> DataFrame:
    """Extra km of each inner way-point: routed in + routed out - straight line past it, at least 0.

    A leg that is not in the table counts 1.3 times the straight line, like a failed one.
    """
    near = with_neighbors(
        route.select("plan_id", "pos", "lng", "lat"), "plan_id", "pos",
        prev={"p_lng": "lng", "p_lat": "lat"}, nxt={"n_lng": "lng", "n_lat": "lat"},
    ).drop("_chunk").where("p_lng IS NOT NULL AND n_lng IS NOT NULL")
    cost = with_key(leg_cost_or_fallback(legs)).dropDuplicates(["k"]).select("k", "km")
    near = near.withColumns({"k_in": leg_key("p_lng", "p_lat", "lng", "lat"), "k_out": leg_key("lng", "lat", "n_lng", "n_lat")})
    near = near.join(cost.select(F.col("k").alias("k_in"), F.col("km").alias("in_km")), "k_in", "left")
    near = near.join(cost.select(F.col("k").alias("k_out"), F.col("km").alias("out_km")), "k_out", "left")
    into = F.coalesce("in_km", ROAD_FACTOR * haversine_km("p_lng", "p_lat", "lng", "lat"))
    onward = F.coalesce("out_km", ROAD_FACTOR * haversine_km("lng", "lat", "n_lng", "n_lat"))
    extra = into + onward - haversine_km("p_lng", "p_lat", "n_lng", "n_lat")
    return near.select("plan_id", "pos", F.greatest(F.lit(0.0), extra).alias("detour_km"))


def unreachable(route: DataFrame, failed_keys: DataFrame, visits: DataFrame) -> DataFrame:
    """Inner way-points whose own area the track never visits, or with a failed leg in or out.

    ``route`` carries ``area_id`` (NULL outside all areas); ``visits`` is ``(plan_id, area_id)``.
    """
    near = with_neighbors(
        route.select("plan_id", "pos", "lng", "lat", "area_id"), "plan_id", "pos",
        prev={"p_lng": "lng", "p_lat": "lat"}, nxt={"n_lng": "lng", "n_lat": "lat"},
    ).drop("_chunk").where("p_lng IS NOT NULL AND n_lng IS NOT NULL")
    near = near.withColumns({"k_in": leg_key("p_lng", "p_lat", "lng", "lat"), "k_out": leg_key("lng", "lat", "n_lng", "n_lat")})
    bad = failed_keys.select("k").distinct()
    near = near.join(bad.select(F.col("k").alias("k_in"), F.lit(True).alias("bad_in")), "k_in", "left")
    near = near.join(bad.select(F.col("k").alias("k_out"), F.lit(True).alias("bad_out")), "k_out", "left")
    near = near.join(visits.select("plan_id", "area_id").distinct().withColumn("seen", F.lit(True)), ["plan_id", "area_id"], "left")
    island = F.coalesce("bad_in", "bad_out", F.lit(False))
    unseen = F.col("seen").isNull()
    return near.where(island | unseen).select("plan_id", "pos", island.alias("island"), unseen.alias("unvisited"))


def anchor_gaps(anchors: DataFrame, points: DataFrame, max_gap_km: float = MAX_GAP_KM) -> DataFrame:
    """Worst distance from a plan's anchors to its track: ``(plan_id, anchor, gap_km, reached)``.

    ``anchors`` is ``(plan_id, pos, kind, lng, lat)``: a start is compared with the first vertex, an end with the
    last, a via point with its nearest vertex. ``points`` is ``(plan_id, seq, lng, lat)``.
    """
    at = F.struct("lng", "lat")
    ends = points.groupBy("plan_id").agg(F.min_by(at, "seq").alias("f"), F.max_by(at, "seq").alias("l"))
    edge = anchors.where("kind <> 'via'").join(ends, "plan_id")
    goal = F.when(F.col("kind") == "start", F.col("f")).otherwise(F.col("l"))
    edge = edge.select("plan_id", "pos", "kind", haversine_km("lng", "lat", goal["lng"], goal["lat"]).alias("gap_km"))
    via = min_dist(anchors.where("kind = 'via'"), points, point_id="pos").select("plan_id", "pos", F.lit("via").alias("kind"), F.col("km").alias("gap_km"))
    worst = F.max_by(F.struct("kind", "gap_km"), F.struct("gap_km", -F.col("pos")))
    out = edge.unionByName(via).groupBy("plan_id").agg(worst.alias("w"))
    return out.select("plan_id", F.col("w.kind").alias("anchor"), "w.gap_km", (F.col("w.gap_km") <= max_gap_km).alias("reached"))
