"""Elevation cells, profiles, interpolation and tunnel flattening."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.geo import half_up, linear_interp
from ..plans.chunks import fill_forward, with_neighbors
from ..plans.lineage import cut_lineage, materialize
from ..plans.ranges import points_in_ranges
from ..sources.dem import rows_per_band
from .tracks import cum_distance

WINDOW_KM = 120.0  # fixed value: length of one elevation request

_TILE = ["tile_lat", "tile_lng"]


def quads_at(asked: DataFrame, cells: DataFrame) -> DataFrame:
    """Heights of each asked cell and of those to the east, south and south-east (``h00, h01, h10, h11``).

    ``asked`` has distinct ``(tile_lat, tile_lng, n, r, c)``. Edge cells repeat their own row or column. Only tiles that
    are asked for are read, and only their cells are shuffled, once.
    """
    # At most 64 800 one-degree tiles exist.
    near = cells.join(F.broadcast(asked.select(*_TILE).distinct()), _TILE, "left_semi")
    corners = F.array(*[F.struct(F.lit(i).alias("i"), F.lit(j).alias("j")) for i in (0, 1) for j in (0, 1)])
    last = F.col("n") - 1
    rows = asked.select(*_TILE, F.col("r").alias("_r"), F.col("c").alias("_c"), "n", F.inline(corners))
    rows = rows.withColumns({"r": F.least(last, F.col("_r") + F.col("i")), "c": F.least(last, F.col("_c") + F.col("j"))})
    found = rows.drop("n").join(near.select(*_TILE, "r", "c", "ele"), [*_TILE, "r", "c"])

    def corner(i, j):
        return F.max(F.when((F.col("i") == i) & (F.col("j") == j), F.col("ele"))).cast("double")

    return found.groupBy(*_TILE, F.col("_r").alias("r"), F.col("_c").alias("c")).agg(*[corner(i, j).alias(f"h{i}{j}") for i in (0, 1) for j in (0, 1)])


def _lerp(a: Column, b: Column, f: Column) -> Column:
    return F.when(a.isNull(), b).when(b.isNull(), a).otherwise(a + (b - a) * f)


def _on_grid(points: DataFrame, dem: DataFrame) -> DataFrame:
    """Cell ``r, c`` of each point in its tile of side ``n`` and the place inside it, ``_fr, _fc``; nulls without a tile."""
    # At most 64 800 one-degree tiles exist, so this side is safe to broadcast.
    grids = dem.select(*_TILE, "n").distinct()
    at = points.withColumns({"tile_lat": F.floor("lat").cast("int"), "tile_lng": F.floor("lng").cast("int")})
    at = at.join(F.broadcast(grids), _TILE, "left")
    row = (F.col("tile_lat") + 1 - F.col("lat")) * (F.col("n") - 1)
    col = (F.col("lng") - F.col("tile_lng")) * (F.col("n") - 1)

    def clamp(v):
        return F.greatest(F.lit(0), F.least(F.col("n") - 1, F.floor(v).cast("int")))

    return at.withColumns({"r": clamp(row), "c": clamp(col), "_fr": row - F.floor(row), "_fc": col - F.floor(col)})


def _height() -> Column:
    fc, fr = F.col("_fc"), F.col("_fr")
    value = _lerp(_lerp(F.col("h00"), F.col("h01"), fc), _lerp(F.col("h10"), F.col("h11"), fc), fr)
    return F.coalesce(value, F.lit(0.0)).alias("ele")


def sample_dem(points: DataFrame, dem: DataFrame) -> DataFrame:
    """Add ``ele``: bilinear height from a table of cells or of bands; void corners are skipped, no data at all gives 0."""
    if "heights" in dem.columns:
        return sample_bands(points, dem)
    at = _on_grid(points, dem)
    asked = at.where("n IS NOT NULL").select(*_TILE, "n", "r", "c").distinct()
    hit = at.join(quads_at(asked, dem), [*_TILE, "r", "c"], "left")
    return hit.select(*points.columns, _height())


def sample_bands(points: DataFrame, bands: DataFrame) -> DataFrame:
    """:func:`sample_dem` on bands: a point's four corners lie in one band and are taken from its array by index.

    Bands that no point asks for leave before the shuffle, so what moves is bounded by the points: one short array each.
    """
    at = _on_grid(points, bands).withColumn("band", F.floor(F.col("r") / rows_per_band(F.col("n"))).cast("int"))
    key = [*_TILE, "band"]
    asked = at.where("n IS NOT NULL").select(*key).distinct()
    used = bands.join(asked, key, "left_semi").select(*key, "first_row", "heights")
    hit = at.join(used, key, "left")

    def corner(i, j):
        r, c = F.least(F.col("n") - 1, F.col("r") + i), F.least(F.col("n") - 1, F.col("c") + j)
        return F.get("heights", (r - F.col("first_row")) * F.col("n") + c).cast("double")

    return hit.withColumns({f"h{i}{j}": corner(i, j) for i in (0, 1) for j in (0, 1)}).select(*points.columns, _height())


def elevation_profile(points: DataFrame, cells: DataFrame) -> DataFrame:
    """``(track_id, i, cum_m, ele)`` of every vertex."""
    dist = cum_distance(points.select("track_id", "seq", "lng", "lat"))
    return sample_dem(dist, cells).select("track_id", F.col("seq").alias("i"), "cum_m", "ele")


def elevation_summary(profile: DataFrame) -> DataFrame:
    """Gain and loss rounded once per track, lowest and highest rounded sample."""
    near = with_neighbors(profile, "track_id", "i", prev={"p_ele": "ele"})
    d = F.col("ele") - F.col("p_ele")
    up, down = F.sum(F.when(d > 0, d)), F.sum(F.when(d < 0, -d))
    return near.groupBy("track_id").agg(
        half_up(F.coalesce(up, F.lit(0.0))).alias("gain"), half_up(F.coalesce(down, F.lit(0.0))).alias("loss"),
        F.min(half_up("ele")).alias("min_ele"), F.max(half_up("ele")).alias("max_ele"),
    )


def interp_join(points: DataFrame, profile: DataFrame, key="track_id", bucket: float = 50_000.0) -> DataFrame:
    """Add ``v`` at ``x`` from a profile ``(key, x, v)``: as-of on both sides, linear between, clamped outside.

    Both inputs are laid along ``x`` and cut into buckets, so a long track is spread over many tasks. Every place counts
    once, however many rows stand there (of samples at one place the largest), so a recorder that stands still fills no
    bucket; the rows then get the value of their place.
    """
    keys = [key] if isinstance(key, str) else list(key)
    samples = profile.groupBy(*keys, "x").agg(F.max("v").alias("v"))
    rows = samples.select(*keys, "x", F.struct("x", "v").alias("s"), F.lit(0).alias("kind"))
    places = points.select(*keys, "x").distinct()
    rows = rows.unionByName(places.select(*keys, "x", F.lit(1).alias("kind")), allowMissingColumns=True)
    rows = rows.withColumns({"_at": F.struct("x", "kind"), "_chunk": F.floor(F.col("x") / bucket)})
    rows = fill_forward(rows, keys, "_at", {"lo": F.col("s")})
    rows = rows.withColumn("_back", F.struct("x", (1 - F.col("kind")).alias("kind")))
    rows = fill_forward(rows, keys, "_back", {"hi": F.when(F.col("kind") == 0, F.col("s"))}, backward=True)
    v = linear_interp("lo.x", "lo.v", "hi.x", "hi.v", "x")
    values = rows.where(F.col("kind") == 1).select(*keys, "x", v.alias("v"))
    return points.join(values, [*keys, "x"])


def flatten_spans(points: DataFrame, spans: DataFrame) -> DataFrame:
    """Inside each flat span heights run straight from portal to portal by distance; portals keep theirs.

    ``points`` has ``track_id, seq, cum_m, ele``; ``spans`` has ``track_id, start_idx, end_idx`` and does not overlap.
    """
    ends = points.select("track_id", "seq", "cum_m", "ele")

    def portal(side):
        return ends.select("track_id", F.col("seq").alias(f"{side}_idx"), F.col("cum_m").alias(f"{side}_m"), F.col("ele").alias(f"{side}_z"))

    whole = spans.where(F.col("end_idx") > F.col("start_idx") + 1).select("track_id", "start_idx", "end_idx")
    whole = whole.join(portal("start"), ["track_id", "start_idx"]).join(portal("end"), ["track_id", "end_idx"])
    whole = whole.where(F.col("end_m") > F.col("start_m"))
    inner = whole.withColumns({"lo": F.col("start_idx") + 1, "hi": F.col("end_idx") - 1})
    hit = points_in_ranges(points, inner, ["track_id"], "seq", "lo", "hi", how="left")
    t = (F.col("cum_m") - F.col("start_m")) / (F.col("end_m") - F.col("start_m"))
    z = F.when(F.col("start_m").isNotNull(), F.col("start_z") + t * (F.col("end_z") - F.col("start_z"))).otherwise(F.col("ele"))
    keep = [F.col(c) for c in points.columns if c != "ele"]
    return hit.select(*keep, z.alias("ele"))


def elevation_windows(points: DataFrame, window_km: float = WINDOW_KM) -> DataFrame:
    """Windows of at most 120 km, each starting where the one before ended: ``(track_id, start_i, end_i)``.

    Every vertex first learns where a window opened there would end (as-of along the distance). The windows
    really opened are those reachable from vertex 0, found by pointer doubling: a logarithmic number of
    equi-joins on (track, vertex), whatever the length of one track.
    """
    reach = window_km * 1000.0
    along = materialize(cum_distance(points.select("track_id", "seq", "lng", "lat")), "distance")
    shape = along.agg(F.max("cum_m").alias("m")).first()
    samples = along.select("track_id", F.col("cum_m").alias("x"), F.lit(0).alias("kind"), F.col("seq").alias("j"), F.lit(None).cast("int").alias("i"))
    wants = along.select("track_id", (F.col("cum_m") + reach).alias("x"), F.lit(1).alias("kind"), F.lit(None).cast("int").alias("j"), F.col("seq").alias("i"))
    rows = samples.unionByName(wants).withColumns(
        {"_at": F.struct("x", "kind", F.coalesce("j", "i").alias("o")), "_chunk": F.floor(F.col("x") / reach)}
    )
    ends = fill_forward(rows, "track_id", "_at", {"last_j": F.col("j")}).where("kind = 1")
    lasts = along.groupBy("track_id").agg(F.max("seq").alias("n"))
    hop = F.least(F.greatest(F.col("last_j"), F.col("i") + 1), F.col("n"))
    jump = ends.join(lasts, "track_id").where(F.col("i") < F.col("n")).select("track_id", "i", hop.alias("nx"))
    jump = cut_lineage(jump)
    first = jump
    opened = jump.where("i = 0").select("track_id", "i")
    windows = 2 * (shape["m"] or 0.0) / reach + 2
    for _ in range(max(1, math.ceil(math.log2(windows)))):
        far = opened.join(jump, ["track_id", "i"]).select("track_id", F.col("nx").alias("i"))
        opened = cut_lineage(opened.unionByName(far).distinct())
        onward = jump.select("track_id", F.col("i").alias("nx"), F.col("nx").alias("nx2"))
        jump = cut_lineage(jump.join(onward, ["track_id", "nx"]).select("track_id", "i", F.col("nx2").alias("nx")))
    return opened.join(first, ["track_id", "i"]).select("track_id", F.col("i").alias("start_i"), F.col("nx").alias("end_i"))


def enrich_elevation(points: DataFrame, cells: DataFrame, spans: DataFrame, samples: int | None = None) -> DataFrame:
    """3-D track: a height at every vertex, tunnels and bridges flattened.

    With ``samples`` only that many vertices per window are looked up and the rest is linear in between.
    """
    along = materialize(cum_distance(points.select("track_id", "seq", "lng", "lat")), "distance")
    if samples is None:
        z = sample_dem(along, cells).select("track_id", "seq", "lng", "lat", "cum_m", "ele")
        return flatten_spans(materialize(z, "heights"), spans)
    wins = elevation_windows(points).withColumn("size", F.col("end_i") - F.col("start_i") + 1)
    picks = F.when(F.col("size") <= samples, F.sequence("start_i", "end_i")).otherwise(
        F.transform(F.sequence(F.lit(0), F.lit(samples - 1)),
                    lambda k: (F.col("start_i") + half_up(k * ((F.col("size") - 1) / F.lit(samples - 1.0)))).cast("int"))
    )
    chosen = wins.select("track_id", F.explode(picks).alias("seq")).distinct()
    known = sample_dem(along.join(chosen, ["track_id", "seq"]), cells)
    profile = known.select("track_id", F.col("cum_m").alias("x"), F.col("ele").alias("v"))
    z = interp_join(along.withColumnRenamed("cum_m", "x"), profile).select("track_id", "seq", "lng", "lat", F.col("x").alias("cum_m"), F.col("v").alias("ele"))
    return flatten_spans(materialize(z, "heights"), spans)
