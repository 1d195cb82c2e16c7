"""Splitting tracks into equal-effort days and building the day rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.budget import budget_effort, budget_fit, effort_km
from ..functions.geo import half_up, haversine_km
from ..plans.chunks import fill_forward, with_neighbors
from ..plans.lineage import materialize
from ..plans.ranges import overlaps, points_in_ranges
from .tracks import cum_distance, cum_effort

EFFORT_BUCKET_KM = 200.0
KNOTS_PER_DAY, POINTS_PER_KNOT, ANCHOR_TOLERANCE, FEW_WAYPOINTS = 48, 50, 3, 5  # fixed values


def split_days(profile: DataFrame, days: DataFrame) -> DataFrame:
    """Cut each profile into days of equal effort: ``(track_id, day, start_i, end_i, km, gain)``.

    A day ends at the first sample reaching its share of the effort, but at least one sample after the day
    before; with f(d) that first sample, the end is ``d + max over j <= d of (f(j) - j)``. The samples meet
    the targets in an as-of scan along the effort axis, cut into buckets. The running effort is written out once,
    as the totals, the scan and both boundary look-ups read it.
    """
    cum = materialize(cum_effort(profile), "effort")
    climb = F.col("cum_climb")
    total = cum.groupBy("track_id").agg(
        F.max("i").alias("last"), F.max("cum_effort").alias("effort"), F.max("cum_climb").alias("climb"),
    )
    plan = total.join(days.where("days > 0"), "track_id")
    n = F.col("last") + 1
    d_eff = F.when(F.col("days") < n, F.col("days")).otherwise(F.greatest(F.lit(1), F.col("last")))
    plan = plan.withColumn("d_eff", d_eff).withColumn("share", F.col("effort") / F.col("d_eff"))
    targets = plan.select("track_id", "share", F.explode(F.sequence(F.lit(1), F.col("d_eff"))).alias("day"), "last", "d_eff", F.col("climb").alias("total_climb"))

    # Of samples with one effort (a standing recorder) the first decides, so no chunk holds a crowd of them.
    samples = cum.where("i > 0").groupBy("track_id", F.col("cum_effort").alias("x")).agg(F.min("i").alias("i"))
    samples = samples.select("track_id", "x", F.lit(1).alias("kind"), "i")
    wanted = targets.select("track_id", (F.col("share") * F.col("day")).alias("x"), F.lit(0).alias("kind"), F.lit(None).cast("int").alias("i"), "day", "last", "d_eff", "total_climb")
    rows = samples.unionByName(wanted, allowMissingColumns=True).withColumns({
        "_at": F.struct("x", "kind", F.coalesce("i", "day").alias("o")), "_chunk": F.floor(F.col("x") / EFFORT_BUCKET_KM),
    })
    found = fill_forward(rows, "track_id", "_at", {"f": F.col("i")}, backward=True).where("kind = 0")

    by_day = Window.partitionBy("track_id").orderBy("day")
    pushed = F.max(F.coalesce("f", "last") - F.col("day")).over(by_day.rowsBetween(Window.unboundedPreceding, 0))
    end = F.when(F.col("day") == F.col("d_eff"), F.col("last")).otherwise(F.least(F.col("last"), F.col("day") + pushed))
    cuts = found.withColumn("end_i", end.cast("int"))
    cuts = cuts.withColumn("start_i", F.coalesce(F.lag("end_i").over(by_day), F.lit(0)))
    stalled = (F.col("day") < F.col("d_eff")) & (F.col("start_i") >= F.col("last")) & (F.col("day") > 1)
    cuts = cuts.withColumn("stop", F.max(stalled.cast("int")).over(by_day.rowsBetween(Window.unboundedPreceding, 0)))
    cuts = cuts.where("stop = 0").select("track_id", "day", "start_i", "end_i", "d_eff", "total_climb")

    at = cum.select("track_id", "i", "cum_m", climb.alias("climb"))
    start = at.select("track_id", F.col("i").alias("start_i"), F.col("cum_m").alias("m0"), F.col("climb").alias("c0"))
    stop = at.select("track_id", F.col("i").alias("end_i"), F.col("cum_m").alias("m1"), F.col("climb").alias("c1"))
    out = cuts.join(start, ["track_id", "start_i"]).join(stop, ["track_id", "end_i"])
    last_day = F.col("day") == F.col("d_eff")
    gain = F.when(last_day, half_up("total_climb") - F.col("c0")).otherwise(F.col("c1") - F.col("c0"))
    return out.select("track_id", "day", "start_i", "end_i", ((F.col("m1") - F.col("m0")) / 1000.0).alias("km"), gain.alias("gain"))


def resolve_bounds(bounds: DataFrame) -> DataFrame:
    """Map sample-space day bounds to vertex indices; needs ``start_i, end_i, day, days_total, n, m`` per row.

    ``n`` vertices, ``m`` samples; the first day starts at 0, the last ends at n-1, no day is empty.
    """
    n, m = F.col("n"), F.col("m")
    step = F.when(m > 1, (n - 1.0) / (m - 1.0)).otherwise(0.0)
    start = F.when(F.col("day") == 1, F.lit(0)).otherwise(half_up(F.col("start_i") * step))
    end = F.when(F.col("day") == F.col("days_total"), n - 1).otherwise(half_up(F.col("end_i") * step))
    start, end = F.greatest(F.lit(0), start), F.least(n - 1, end)
    end = F.when(end <= start, F.least(start + 1, n - 1)).otherwise(end)
    return bounds.withColumns({"start_idx": start.cast("int"), "end_idx": end.cast("int")})


def build_days(points: DataFrame, bounds: DataFrame) -> DataFrame:
    """Per day: real km, gain and loss of its vertices. ``points`` has ``ele``; ``bounds`` has ``day, start_idx, end_idx``."""
    prev = {"p_lng": "lng", "p_lat": "lat", "p_ele": "ele"}
    steps = with_neighbors(points.select("track_id", "seq", "lng", "lat", "ele"), "track_id", "seq", prev=prev).drop("_chunk")
    steps = steps.withColumn("step_km", haversine_km("p_lng", "p_lat", "lng", "lat"))
    inner = bounds.select("track_id", "day", (F.col("start_idx") + 1).alias("lo"), F.col("end_idx").alias("hi"))
    hit = points_in_ranges(steps, inner, ["track_id"], "seq", "lo", "hi")
    d = F.col("ele") - F.col("p_ele")
    return hit.groupBy("track_id", "day").agg(
        F.coalesce(F.sum("step_km"), F.lit(0.0)).alias("km"),
        half_up(F.coalesce(F.sum(F.when(d > 0, d)), F.lit(0.0))).alias("gain"),
        half_up(F.coalesce(F.sum(F.when(d < 0, -d)), F.lit(0.0))).alias("loss"),
    )


def day_geometry(points: DataFrame, bounds: DataFrame) -> DataFrame:
    """Vertices of every day; a shared boundary vertex belongs to both days. Adds ``day, local_seq``."""
    span = bounds.select("track_id", "day", "start_idx", "end_idx")
    hit = points_in_ranges(points, span, ["track_id"], "seq", "start_idx", "end_idx")
    return hit.withColumn("local_seq", F.col("seq") - F.col("start_idx")).drop("start_idx", "end_idx")


def slice_stats(spans: DataFrame, points: DataFrame, bounds: DataFrame) -> DataFrame:
    """Spans clipped to days: ``(track_id, day, dim, start_idx, end_idx, code, meters)`` with day-local indices."""
    window = bounds.select("track_id", "day", F.col("start_idx").alias("w0"), F.col("end_idx").alias("w1"))
    cut = overlaps(spans, window, ["track_id"], "start_idx", "end_idx", "w0", "w1")
    cut = cut.withColumns({"s": F.greatest("start_idx", "w0"), "e": F.least("end_idx", "w1")})
    cum = materialize(cum_distance(points.select("track_id", "seq", "lng", "lat")), "distance")
    at = lambda i, m: cum.select("track_id", F.col("seq").alias(i), F.col("cum_m").alias(m))
    out = cut.join(at("s", "m0"), ["track_id", "s"]).join(at("e", "m1"), ["track_id", "e"])
    out = out.where(F.col("m1") > F.col("m0"))
    return out.select(
        "track_id", "day", "dim", (F.col("s") - F.col("w0")).alias("start_idx"), (F.col("e") - F.col("w0")).alias("end_idx"),
        "code", half_up(F.col("m1") - F.col("m0")).alias("meters"),
    )


def slice_totals(sliced: DataFrame) -> DataFrame:
    """Metres per day, dimension and code; each span was rounded on its own."""
    return sliced.groupBy("track_id", "day", "dim", "code").agg(F.sum("meters").alias("meters"))


def day_waypoints(waypoints: DataFrame, bounds: DataFrame, points: DataFrame) -> DataFrame:
    """Way-points of every day in order: ``(track_id, day, ord, lng, lat, source)``.

    ``waypoints`` is ``(track_id, pos, lng, lat, idx)`` with ``idx`` the nearest vertex or -1. A start or end is
    added unless a way-point lies within three vertices of it. Tracks with fewer than five way-points get evenly
    spaced knots instead.
    """
    many = waypoints.groupBy("track_id").agg(F.count("*").alias("wps"))
    spans = bounds.select("track_id", "day", "start_idx", "end_idx").join(many, "track_id", "left")
    spans = spans.withColumn("plain", F.coalesce(F.col("wps"), F.lit(0)) < FEW_WAYPOINTS).drop("wps")
    kept = spans.where("NOT plain")
    mine = points_in_ranges(waypoints.where("idx >= 0"), kept, ["track_id"], "idx", "start_idx", "end_idx")
    near_start = F.max((F.col("idx") <= F.col("start_idx") + ANCHOR_TOLERANCE).cast("int"))
    near_end = F.max((F.col("idx") >= F.col("end_idx") - ANCHOR_TOLERANCE).cast("int"))
    flags = mine.groupBy("track_id", "day").agg(near_start.alias("has_start"), near_end.alias("has_end"))
    gaps = kept.join(flags, ["track_id", "day"], "left").fillna(0, ["has_start", "has_end"])
    start = F.struct(F.col("start_idx").alias("seq"), F.lit(-1).alias("ord"), F.lit("start").alias("source"))
    end = F.struct(F.col("end_idx").alias("seq"), F.lit(1 << 30).alias("ord"), F.lit("end").alias("source"))
    added = F.array_compact(F.array(F.when(F.col("has_start") == 0, start), F.when(F.col("has_end") == 0, end)))
    anchors = gaps.select("track_id", "day", F.explode(added).alias("a")).select("track_id", "day", "a.*")

    total = F.col("end_idx") - F.col("start_idx") + 1
    target = F.least(F.lit(KNOTS_PER_DAY), F.greatest(F.lit(2), F.floor(total / POINTS_PER_KNOT).cast("int")))
    step = F.greatest(F.lit(1), F.floor(total / target).cast("int"))
    seqs = F.array_distinct(F.concat(F.sequence("start_idx", "end_idx", step), F.array("end_idx")))
    knots = spans.where("plain").select("track_id", "day", F.explode(seqs).alias("seq"))
    knots = knots.withColumns({"ord": F.col("seq"), "source": F.lit("knot")})
    on_track = anchors.unionByName(knots).join(points.select("track_id", "seq", "lng", "lat"), ["track_id", "seq"])
    own = mine.select("track_id", "day", F.col("pos").alias("ord"), "lng", "lat", F.lit("plan").alias("source"))
    return own.unionByName(on_track.select("track_id", "day", "ord", "lng", "lat", "source"))


def plan_summary(days: DataFrame, plans: DataFrame) -> DataFrame:
    """Whole-trip effort against the budget: ``(plan_id, km, gain, effort, budget, fit)``.

    ``plans`` may carry ``routed_km``, used when the days add up to nothing.
    """
    sums = days.groupBy("plan_id").agg(F.sum(F.coalesce("km", F.lit(0.0))).alias("d_km"), F.sum(F.coalesce("gain", F.lit(0))).alias("gain"))
    out = plans.join(sums, "plan_id", "left")
    km = F.when(F.col("d_km") > 0, F.col("d_km")).otherwise(F.col("routed_km"))
    out = out.withColumns({"km": km, "gain": F.coalesce("gain", F.lit(0))})
    out = out.withColumns({"effort": effort_km("km", "gain"), "budget": budget_effort("days", "km_per_day", "elev_per_day")})
    return out.select("plan_id", "km", "gain", "effort", "budget", budget_fit("effort", "budget").alias("fit"))


def day_distribution(days: DataFrame) -> DataFrame:
    return days.withColumn("effort", effort_km("km", "gain"))
