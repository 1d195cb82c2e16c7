"""Track sequences: distance, climb, chunking, merging, down-sampling, tiles.

Points are long-form rows ``(track_id, seq, lng, lat, ...)`` with ``seq`` dense from 0 per track.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.geo import half_up, haversine_km
from ..functions.tiles import frac_tile, tile_key
from ..plans.chunks import CHUNK, running_sum, with_neighbors

CLIMB_WINDOW = 400  # fixed value: points per climb window
WAYPOINTS_PER_CHUNK = 48  # fixed value: way-points per routing request


def with_step(points: DataFrame, key: str = "track_id", order: str = "seq", size: int = CHUNK) -> DataFrame:
    """Add ``step_km``, the distance from the point before (NULL on the first)."""
    near = with_neighbors(points, key, order, prev={"p_lng": "lng", "p_lat": "lat"}, size=size)
    return near.withColumn("step_km", haversine_km("p_lng", "p_lat", "lng", "lat")).drop("p_lng", "p_lat")


def cum_distance(points: DataFrame, key: str = "track_id", order: str = "seq", size: int = CHUNK) -> DataFrame:
    """Add ``cum_m``, metres along the track, 0 on the first point."""
    steps = with_step(points, key, order, size).withColumn("step_m", F.col("step_km") * 1000.0)
    return running_sum(steps, key, order, {"cum_m": F.col("step_m")}, size).drop("_chunk", "step_m", "step_km")


def track_length(points: DataFrame, key: str = "track_id", order: str = "seq") -> DataFrame:
    """Haversine length per track; one partial aggregation after the neighbour step."""
    km = F.coalesce(F.sum("step_km"), F.lit(0.0))
    return with_step(points, key, order).groupBy(key).agg(km.alias("km"))


def cum_effort(profile: DataFrame, alpha: float = 0.1, size: int = CHUNK) -> DataFrame:
    """Add ``cum_climb`` and ``cum_effort`` (km) to a profile ``(track_id, i, cum_m, ele)``."""
    near = with_neighbors(profile, "track_id", "i", prev={"p_m": "cum_m", "p_ele": "ele"}, size=size)
    km = F.greatest(F.lit(0.0), (F.col("cum_m") - F.col("p_m")) / 1000.0)
    climb = F.greatest(F.lit(0.0), F.col("ele") - F.col("p_ele"))
    first = F.col("p_m").isNull()
    near = near.withColumns({"_km": F.when(first, 0.0).otherwise(km), "_up": F.when(first, 0.0).otherwise(climb)})
    sums = {"cum_climb": F.col("_up"), "cum_effort": F.col("_km") + alpha * F.col("_up")}
    return running_sum(near, "track_id", "i", sums, size).drop("_chunk", "_km", "_up", "p_m", "p_ele")


def climb_m(points: DataFrame, window: int = CLIMB_WINDOW) -> DataFrame:
    """Climb per track: the gain of every window of points is rounded before the windows are added up.

    A window's steps are added in track order, since the rounding of a sum near one half would otherwise depend on how
    partial sums were put together.
    """
    up = with_neighbors(points, "track_id", "seq", prev={"p_ele": "ele"})
    gain = F.greatest(F.lit(0.0), F.col("ele") - F.col("p_ele"))
    step = up.where(F.col("p_ele").isNotNull())
    steps = F.sort_array(F.collect_list(F.struct("seq", gain.alias("up"))))
    per = step.groupBy("track_id", F.floor((F.col("seq") - 1) / window).alias("w")).agg(steps.alias("steps"))
    per = per.select("track_id", F.aggregate("steps", F.lit(0.0), lambda total, s: total + s["up"]).alias("gain"))
    return per.groupBy("track_id").agg(F.sum(half_up("gain")).alias("climb_m"))


def chunk_waypoints(waypoints: DataFrame, size: int = WAYPOINTS_PER_CHUNK) -> DataFrame:
    """Chunks of at most ``size`` way-points; neighbouring chunks share one point. Adds ``chunk, at``."""
    span = size - 1
    marked = with_neighbors(waypoints, "plan_id", "pos", nxt={"_next": "pos"}).drop("_chunk")
    pos, own = F.col("pos"), F.floor(F.col("pos") / span)
    edge = (pos % span == 0) & (pos > 0)
    closes_before = F.when(edge, own - 1)
    opens_own = F.when(~(edge & F.col("_next").isNull()), own)
    out = marked.withColumn("chunk", F.explode(F.array_compact(F.array(closes_before, opens_own)))).drop("_next")
    return out.withColumn("at", (pos - F.col("chunk") * span).cast("int"))


def leg_offsets(leg_points: DataFrame, key: str = "track_id") -> DataFrame:
    """Index of each leg's first vertex in the merged track: ``(key, leg, n, offset)``."""
    sizes = leg_points.groupBy(key, "leg").agg((F.max("i") + 1).alias("n"))
    total = running_sum(sizes, key, "leg", {"_end": F.col("n") - 1})
    return total.select(key, "leg", "n", (F.col("_end") - (F.col("n") - 1)).alias("offset"))


def merge_legs(leg_points: DataFrame, key: str = "track_id") -> DataFrame:
    """One vertex sequence per track; the first vertex of every later leg repeats and is dropped. Adds ``idx``."""
    offsets = leg_offsets(leg_points, key).select(key, "leg", "offset")
    return (
        leg_points.join(offsets, [key, "leg"])
        .where((F.col("i") > 0) | (F.col("offset") == 0) & (F.col("leg") == 0))
        .withColumn("idx", F.col("offset") + F.col("i"))
        .drop("offset")
    )


def shift_spans(spans: DataFrame, leg_points: DataFrame, key: str = "track_id") -> DataFrame:
    """Span indices of each leg moved to the merged track's vertex numbering (``offset + idx``)."""
    offsets = leg_offsets(leg_points, key).select(key, "leg", "offset")
    moved = spans.join(offsets, [key, "leg"])
    return moved.withColumns({c: F.col(c) + F.col("offset") for c in ("start_idx", "end_idx")}).drop("offset")


def split_legs(legs: DataFrame, leg_points: DataFrame, cuts: DataFrame, key: str = "track_id") -> DataFrame:
    """Cut each leg at a point on one of its segments; km and climb are shared out by haversine length.

    ``cuts`` is ``(key, leg, seg_idx, c_lng, c_lat)``; returns two rows (``half`` 1 and 2) per cut leg.
    """
    prev = {"p_lng": "lng", "p_lat": "lat"}
    steps = with_neighbors(leg_points, [key, "leg"], "i", prev=prev).drop("_chunk").where(F.col("p_lng").isNotNull())
    at = steps.join(cuts, [key, "leg"])
    whole = haversine_km("p_lng", "p_lat", "lng", "lat")
    here = F.col("i") == F.col("seg_idx") + 1
    before = F.when(here, haversine_km("p_lng", "p_lat", "c_lng", "c_lat")).when(F.col("i") <= F.col("seg_idx"), whole)
    after = F.when(here, haversine_km("c_lng", "c_lat", "lng", "lat")).when(F.col("i") > F.col("seg_idx") + 1, whole)
    size = at.groupBy(key, "leg").agg(
        F.coalesce(F.sum(before), F.lit(0.0)).alias("h1"), F.coalesce(F.sum(after), F.lit(0.0)).alias("h2")
    )
    total = F.greatest(F.lit(0.001), F.col("h1") + F.col("h2"))
    parts = F.array(F.struct(F.lit(1).alias("half"), F.col("h1").alias("h")), F.struct(F.lit(2).alias("half"), F.col("h2").alias("h")))
    out = legs.join(size.withColumns({"total": total, "part": F.explode(parts)}), [key, "leg"])
    share = F.col("part.h") / F.col("total")
    return out.select(key, "leg", "part.half", (F.col("km") * share).alias("km"), (F.col("climb_m") * share).alias("climb_m"))


def _keep_seqs(n: Column, m: int, form: str) -> Column:
    last = n - 1
    if form == "uniform":
        return F.transform(F.sequence(F.lit(0), F.lit(m - 1)), lambda i: F.least(half_up(i * (last / F.lit(float(m - 1)))), last))
    if form == "step":
        picks = F.transform(F.sequence(F.lit(0), F.lit(m - 1)), lambda i: F.least(half_up(i * (n / F.lit(float(m)))), last))
        return F.transform(picks, lambda v, i: F.when(i == m - 1, last).otherwise(v))
    if form == "every":
        step = F.greatest(F.lit(1).cast("bigint"), F.floor(n / m))
        return F.array_distinct(F.concat(F.sequence(F.lit(0).cast("bigint"), last, step), F.array(last)))
    raise ValueError(f"unknown form {form}")


def downsample(points: DataFrame, m: int, form: str = "uniform", key: str = "track_id") -> DataFrame:
    """At most about ``m`` points per track, always with the last one; short tracks are kept whole. Adds ``i``.

    ``uniform``: index round(i (n-1)/(m-1)); ``step``: round(i n/m) with the last forced; ``every``: each
    floor(n/m)-th point and the last.
    """
    n = points.groupBy(key).agg((F.max("seq") + 1).cast("bigint").alias("n"))
    short = F.sequence(F.lit(0).cast("bigint"), F.col("n") - 1)
    seqs = F.when(F.col("n") <= m, short).otherwise(_keep_seqs(F.col("n"), m, form))
    keep = n.select(key, F.posexplode(seqs).alias("i", "seq"))
    return points.join(keep, [key, "seq"])


def segment_tiles(x0: Column, y0: Column, x1: Column, y1: Column, z: int) -> Column:
    """Array of ``(t, x, y)`` cells entered by a segment in fractional tile space, four-connected.

    Every grid line crossed opens one cell; where both lines are crossed at once the row changes first.
    """
    cx, cy, ex, ey = (F.floor(v) for v in (x0, y0, x1, y1))
    dx, dy = x1 - x0, y1 - y0

    def crossings(c, e, d, origin, other0, other_d, other_c, other_e, is_x):
        lines = F.when(c < e, F.sequence(c + 1, e)).when(c > e, F.sequence(c, e + 1, F.lit(-1).cast("bigint")))

        def enter(line):
            t = (line - origin) / d
            at = other0 + other_d * t
            # On a tie a column crossing sees the row already changed, a row crossing the old column.
            up = (other_d > 0) if is_x else (other_d <= 0)
            cell = F.when(up, F.floor(at)).otherwise(F.ceil(at) - 1)
            low, high = F.least(other_c, other_e), F.greatest(other_c, other_e)
            cell = F.greatest(low, F.least(high, cell))
            own = F.when(d > 0, line).otherwise(line - 1)
            x, y = (own, cell) if is_x else (cell, own)
            return F.struct(t.alias("t"), x.alias("x"), y.alias("y"))

        return F.coalesce(F.transform(lines, enter), F.expr("array()").cast("array<struct<t:double,x:bigint,y:bigint>>"))

    start = F.array(F.struct(F.lit(0.0).alias("t"), cx.alias("x"), cy.alias("y")))
    cells = F.concat(
        start,
        crossings(cx, ex, dx, x0, y0, dy, cy, ey, True),
        crossings(cy, ey, dy, y0, x0, dx, cx, ex, False),
    )
    top = 1 << z
    return F.filter(cells, lambda c: (c["x"] >= 0) & (c["y"] >= 0) & (c["x"] < top) & (c["y"] < top))


def track_tile_visits(points: DataFrame, z: int = 14) -> DataFrame:
    """Every tile entered by every segment: the input columns plus ``tile_key, t``; nothing is shuffled after the step."""
    fx, fy = frac_tile("lng", "lat", z)
    frac = points.withColumns({"fx": fx, "fy": fy})
    near = with_neighbors(frac, "track_id", "seq", prev={"px": "fx", "py": "fy"}).drop("_chunk")
    x0, y0 = F.coalesce("px", "fx"), F.coalesce("py", "fy")
    cells = near.withColumn("c", F.explode(segment_tiles(x0, y0, F.col("fx"), F.col("fy"), z)))
    out = cells.withColumns({"tile_key": tile_key("c.x", "c.y"), "t": F.col("c.t")})
    return out.drop("fx", "fy", "px", "py", "c")


def track_tiles(points: DataFrame, z: int = 14) -> DataFrame:
    """Distinct tiles per track with where each was first entered: ``(track_id, tile_key, first_seq, first_t)``."""
    first = F.min(F.struct("seq", "t")).alias("f")
    seen = track_tile_visits(points, z).groupBy("track_id", "tile_key").agg(first)
    return seen.select("track_id", "tile_key", F.col("f.seq").alias("first_seq"), F.col("f.t").alias("first_t"))


def tile_summary(points: DataFrame, z: int = 14) -> DataFrame:
    """Per track: distinct tiles and tiles nobody had visited before (by time stamp, then track id)."""
    visits = track_tile_visits(points.select("track_id", "seq", "lng", "lat", "ts"), z)
    per_track = visits.groupBy("tile_key", "track_id").agg(F.min("ts").alias("ts"))
    winner = per_track.groupBy("tile_key").agg(F.min(F.struct("ts", "track_id")).alias("w"), F.count("*").alias("n"))
    won = winner.groupBy(F.col("w.track_id").alias("track_id")).agg(F.count("*").alias("won"))
    tiles = per_track.groupBy("track_id").agg(F.count("*").alias("tiles"))
    return tiles.join(won, "track_id", "left").fillna(0, ["won"])


def user_tiles(points: DataFrame, z: int = 14) -> DataFrame:
    """Per user and track: distinct tiles and those that no earlier track of the user entered (by time stamp, then track id).

    ``points`` carries ``user_id``; every track belongs to one user.
    """
    owner = points.select("track_id", "user_id").distinct()
    visits = track_tile_visits(points.select("track_id", "seq", "lng", "lat", "ts"), z)
    per_track = visits.groupBy("tile_key", "track_id").agg(F.min("ts").alias("ts")).join(owner, "track_id")
    winner = per_track.groupBy("user_id", "tile_key").agg(F.min(F.struct("ts", "track_id"))["track_id"].alias("track_id"))
    fresh = winner.groupBy("user_id", "track_id").agg(F.count("*").alias("fresh"))
    tiles = per_track.groupBy("user_id", "track_id").agg(F.count("*").alias("tiles"))
    return tiles.join(fresh, ["user_id", "track_id"], "left").fillna(0, ["fresh"])
