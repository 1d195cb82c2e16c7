"""Choosing areas and tiles for many plans at once."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.budget import corridor_box, corridor_margin_km, detour_score
from ..functions.geo import haversine_km, hilbert_key, point_segment_deg
from ..functions.tiles import tile_center, tile_key, tile_xy
from ..plans.chunks import top_k, with_neighbors
from ..plans.lineage import cut_lineage, discard, materialize
from .adjacency import enclosed_regions, neighbor_fraction
from .metrics import reward_p95
from .neighbors import cheapest_insert

# Fixed values.
W_ADJACENT, W_HOLE, MIN_DIST_KM, DIST_POWER = 3.0, 5.0, 0.05, 1.5
JUMP_FLOOR_KM, JUMP_RATIO = 200.0, 2.0
BATCH, BATCH_PRECISE, PRECISE_FROM = 20, 6, 0.80
UPPER_BAND = 1.05
EFFORT_PER_KM = 1.3 * (1.0 + 3.0 * 0.1)
HOLE_FRACTION, DETOUR_FLOOR_KM = 0.9, 0.05
KEY = ["plan_id", "area_id"]


def score_candidates(cands: DataFrame, crossed: DataFrame, distances: DataFrame) -> DataFrame:
    """Detour of each candidate from its plan's baseline; crossed ones cost nothing: ``(plan_id, area_id, intersected, detour_km)``."""
    out = cands.join(distances.select(*KEY, "km"), KEY).join(crossed.select(*KEY, F.lit(True).alias("hit")), KEY, "left")
    hit = F.coalesce("hit", F.lit(False))
    return out.select(*KEY, hit.alias("intersected"), detour_score(hit, "km").alias("detour_km"))


def order_candidates(scored: DataFrame) -> DataFrame:
    return scored.orderBy("plan_id", "detour_km", "area_id")


def candidate_tiles(plans: DataFrame, owned: DataFrame, z: int = 14) -> DataFrame:
    """Tiles of each plan's corridor box that the plan does not own yet: ``(plan_id, x, y, tile_key)`` with the line's ends."""
    e_lng, e_lat = F.coalesce("end_lng", "start_lng"), F.coalesce("end_lat", "start_lat")
    box = corridor_box(F.least("start_lng", e_lng), F.least("start_lat", e_lat), F.greatest("start_lng", e_lng), F.greatest("start_lat", e_lat), corridor_margin_km("days", "km_per_day"))
    boxed = plans.select("plan_id", "start_lng", "start_lat", e_lng.alias("end_lng"), e_lat.alias("end_lat"), box.alias("b"))
    (x0, y0), (x1, y1) = tile_xy("b.min_lng", "b.max_lat", z), tile_xy("b.max_lng", "b.min_lat", z)
    rows = boxed.withColumn("x", F.explode(F.sequence(x0, x1))).withColumn("y", F.explode(F.sequence(y0, y1))).drop("b")
    return rows.withColumn("tile_key", tile_key("x", "y")).join(owned.select("plan_id", "tile_key"), ["plan_id", "tile_key"], "left_anti")


def owned_areas(owned: DataFrame, z: int = 14) -> DataFrame:
    """Owned tiles as context areas: negative ids per plan, their centres as points."""
    from ..plans.chunks import running_sum

    ranked = running_sum(owned.select("plan_id", "tile_key").distinct(), "plan_id", "tile_key", {"n": F.lit(1)}, size=1 << 24)
    c = tile_center(F.floor(F.col("tile_key") / 131072), F.col("tile_key") % 131072, z)
    return ranked.select("plan_id", (-F.col("n")).alias("area_id"), "tile_key", c["lng"].alias("lng"), c["lat"].alias("lat"))


def cap_tiles(tiles: DataFrame, n: int, z: int = 14) -> DataFrame:
    """Per plan the ``n`` tiles nearest the straight line from start to finish."""
    c = tile_center("x", "y", z)
    d = point_segment_deg(c["lng"], c["lat"], "start_lng", "start_lat", "end_lng", "end_lat")
    return top_k(tiles.withColumn("dist_deg", d), "plan_id", [F.col("dist_deg"), F.col("tile_key")], n)


def candidate_score(reward, fraction, hole_size, dist) -> Column:
    """reward (1 + 3 share of visited border + hole bonus) / distance^1.5."""
    bonus = F.when(F.col(hole_size).isNotNull(), W_HOLE / (1.0 + F.log(F.col(hole_size)))).otherwise(0.0)
    share = F.coalesce(F.col(fraction), F.lit(0.0))
    return F.col(reward) * (1.0 + W_ADJACENT * share + bonus) / F.pow(F.greatest(F.lit(MIN_DIST_KM), F.col(dist)), F.lit(DIST_POWER))


def score_round(cands: DataFrame, taken: DataFrame, fractions: DataFrame, holes: DataFrame, gates: DataFrame) -> DataFrame:
    """Score every free candidate of every plan: adds ``score`` and ``within`` (inside the plan's reach gate).

    ``cands`` is ``(plan_id, area_id, .., reward, dist_km)``; ``gates`` is ``(plan_id, gate_km, ..)``.
    """
    free = cands.join(taken.select(*KEY), KEY, "left_anti")
    rows = free.join(fractions.select(*KEY, "fraction"), KEY, "left").join(holes.select(*KEY, F.col("size").alias("hole_size")), KEY, "left").join(gates, "plan_id")
    rows = rows.withColumns({"score": candidate_score("reward", "fraction", "hole_size", "dist_km"), "within": F.col("dist_km") <= F.col("gate_km")})
    return rows


def filter_detour(cands: DataFrame, route: DataFrame, max_km: float) -> DataFrame:
    """Candidates whose cheapest insertion into their plan's route costs at most ``max_km``; adds ``pos, detour_km``."""
    cost = cheapest_insert(cands.select(*KEY, "lng", "lat"), route)
    return cands.join(cost, KEY).where(F.col("detour_km") <= max_km)


def pick_round(scored: DataFrame, k: int) -> DataFrame:
    """Best ``k`` candidates per plan within the gate, with ``rank``."""
    return top_k(scored.where("within"), "plan_id", [F.col("score").desc(), F.col("area_id")], k)


def round_summary(scored: DataFrame, k: int) -> DataFrame:
    """Per plan: inserted, whether the pool is used up, whether to jump ahead, and the nearest candidate beyond the gate."""
    n = scored.groupBy("plan_id").agg(F.count_if("within").alias("inside"), F.count_if(~F.col("within")).alias("beyond"), F.min(F.when(~F.col("within"), F.col("dist_km"))).alias("next_km"))
    inserted = F.least(F.col("inside"), F.lit(k).cast("bigint"))
    return n.select("plan_id", inserted.alias("inserted"), ((inserted < k) & (F.col("beyond") == 0)).alias("pool_exhausted"),
                    ((inserted == 0) & (F.col("beyond") > 0)).alias("jump_ahead"), "next_km")


def removal_candidates(selected: DataFrame, detours: DataFrame, fractions: DataFrame, rim: DataFrame, plans: DataFrame, reached: DataFrame) -> DataFrame:
    """Way-points to give up when a plan is over budget: ``(plan_id, area_id, rank, border, key)``.

    ``selected`` is ``(plan_id, area_id, pos, reward)``; ``plans`` is ``(plan_id, effort_frac)``, ``reached``
    the areas each route really visits, over which counts and percentiles are taken. Areas not enclosed
    go first; a plan whose areas are all enclosed gives up rim areas below its 95th reward percentile.
    """
    counted = selected.join(reached.select(*KEY).distinct(), KEY, "left_semi")
    rows = selected.join(detours, ["plan_id", "pos"]).join(fractions.select(*KEY, "fraction"), KEY, "left").fillna(0.0, ["fraction"])
    worth = F.col("reward") / F.greatest(F.lit(DETOUR_FLOOR_KM), F.col("detour_km")) * (1.0 + F.col("fraction"))
    rows = rows.withColumn("key", worth)
    fringe = rows.where(F.col("fraction") < HOLE_FRACTION).withColumn("border", F.lit(False))
    inner = rows.join(fringe.select("plan_id").distinct(), "plan_id", "left_anti")
    edge = inner.join(rim.select(*KEY), KEY, "left_semi").join(reward_p95(counted), "plan_id").where("reward < p95").drop("p95")
    both = fringe.unionByName(edge.withColumn("border", F.lit(True)))
    size = counted.groupBy("plan_id").agg(F.count("*").alias("n"))
    over = plans.where("effort_frac > 1").join(size, "plan_id", "left").fillna(0, ["n"])
    f = F.col("effort_frac")
    over = over.select("plan_id", F.greatest(F.lit(1), F.floor(F.col("n") * (f - 1) / f + 0.5)).alias("drop_n"))
    ranked = both.join(over, "plan_id").withColumn("rank", F.row_number().over(Window.partitionBy("plan_id").orderBy("key", "area_id")))
    return ranked.where("rank <= drop_n").select(*KEY, "rank", "border", "key")


def order_waypoints(waypoints: DataFrame, box: DataFrame) -> DataFrame:
    """Route order: first anchor, everything else along the Hilbert curve, last anchor; adds ``ord``.

    ``waypoints`` is ``(plan_id, id, kind, lng, lat)`` with kind ``first``, ``last`` or anything else; ``box`` is one row.
    """
    rows = waypoints.withColumns({c: box.select(c).scalar() for c in ("min_lng", "min_lat", "max_lng", "max_lat")})
    key = hilbert_key("lng", "lat", "min_lng", "min_lat", "max_lng", "max_lat")
    key = F.when(F.col("kind") == "first", -1).when(F.col("kind") == "last", 1 << 40).otherwise(key)
    rows = rows.withColumn("hkey", key).drop("min_lng", "min_lat", "max_lng", "max_lat")
    return rows.withColumn("ord", F.row_number().over(Window.partitionBy("plan_id").orderBy("hkey", "id")) - 1)


def route_km(ordered: DataFrame) -> DataFrame:
    step = with_neighbors(ordered, "plan_id", "ord", prev={"p_lng": "lng", "p_lat": "lat"})
    return step.groupBy("plan_id").agg(F.coalesce(F.sum(haversine_km("p_lng", "p_lat", "lng", "lat")), F.lit(0.0)).alias("km"))


def build_up(plans: DataFrame, cands: DataFrame, adj: DataFrame, perims: DataFrame, visited: DataFrame, box: DataFrame) -> DataFrame:
    """Grow all plans together, round by round, until each reaches 105 % of its effort or runs out of candidates.

    ``plans`` is ``(plan_id, target, start_lng, start_lat, end_lng, end_lat)``, ``cands`` ``(plan_id, area_id, lng, lat,
    reward, dist_km)``, ``visited`` ``(plan_id, area_id)``. Every round scores all open plans against what they have
    taken so far, takes the best batch within the reach gate and re-estimates the effort along the Hilbert order.
    Finished plans drop out. Returns ``(plan_id, area_id, round)``.
    """
    as_user = lambda df: df.withColumnRenamed("plan_id", "user_id")
    as_plan = lambda df: df.withColumnRenamed("user_id", "plan_id")
    # Every round reads these several times, so they are made once.
    cands, visited = materialize(cands, "candidates"), materialize(visited.select(*KEY), "visited")
    state = cut_lineage(plans.select("plan_id", "target", F.lit(0.0).alias("frontier"), F.lit(0.0).alias("effort")))
    chosen = cut_lineage(cands.select(*KEY, "lng", "lat", "dist_km", F.lit(0).alias("round")).limit(0))
    ends = plans.select("plan_id", F.explode(F.array(
        F.struct(F.lit(-1).cast("bigint").alias("id"), F.lit("first").alias("kind"), F.col("start_lng").alias("lng"), F.col("start_lat").alias("lat")),
        F.struct(F.lit(-2).cast("bigint").alias("id"), F.lit("last").alias("kind"), F.col("end_lng").alias("lng"), F.col("end_lat").alias("lat")),
    )).alias("a")).select("plan_id", "a.*")
    number = 0
    while not state.isEmpty():
        number += 1
        before = state, chosen
        live = cut_lineage(cands.join(state.select("plan_id"), "plan_id", "left_semi"))
        known = visited.join(state.select("plan_id"), "plan_id", "left_semi")
        taken = cut_lineage(known.unionByName(chosen.select(*KEY)).distinct())
        share = as_plan(neighbor_fraction(adj, perims, as_user(taken), as_user(live)))
        regions = enclosed_regions(adj, perims, as_user(live.select(*KEY)), as_user(taken))
        holes = as_plan(regions)
        gates = state.withColumn("gate_km", F.greatest(F.lit(JUMP_FLOOR_KM), JUMP_RATIO * F.col("frontier")))
        precise = F.col("effort") >= PRECISE_FROM * F.col("target")
        gates = gates.withColumn("k", F.when(precise, BATCH_PRECISE).otherwise(BATCH))
        scored = cut_lineage(score_round(live, taken, share, holes, gates))
        best = pick_round(scored, BATCH).where(F.col("rank") <= F.col("k"))
        picks = best.select(*KEY, "lng", "lat", "dist_km", F.lit(number).alias("round"))
        chosen = cut_lineage(chosen.unionByName(picks))
        stops = ends.unionByName(chosen.select("plan_id", F.col("area_id").alias("id"), F.lit("area").alias("kind"), "lng", "lat"))
        km = route_km(order_waypoints(stops.join(state.select("plan_id"), "plan_id", "left_semi"), box)).withColumnRenamed("km", "route_km")
        seen = scored.groupBy("plan_id").agg(F.count_if("within").alias("inside"), F.count_if(~F.col("within")).alias("beyond"), F.min(F.when(~F.col("within"), F.col("dist_km"))).alias("next_km"))
        far = picks.groupBy("plan_id").agg(F.max("dist_km").alias("reached"))
        step = gates.join(seen, "plan_id", "left").fillna(0, ["inside", "beyond"]).join(far, "plan_id", "left").join(km, "plan_id")
        jump = (F.col("inside") == 0) & (F.col("beyond") > 0)
        frontier = F.when(jump, F.col("next_km")).otherwise(F.greatest("frontier", F.coalesce("reached", F.lit(0.0))))
        effort = F.col("route_km") * EFFORT_PER_KM
        used_up = (F.col("beyond") == 0) & (F.col("inside") < F.col("k"))
        open_plans = (effort < UPPER_BAND * F.col("target")) & ~used_up
        state = cut_lineage(step.where(open_plans).select("plan_id", "target", frontier.alias("frontier"), effort.alias("effort")))
        discard(*before, live, taken, regions, scored)
    discard(state, cands, visited)
    return chosen.select(*KEY, "round")


