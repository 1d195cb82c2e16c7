"""Elevation sampling, day splitting, span statistics."""

from __future__ import annotations

from pyspark.sql import functions as F

from trackspark.operators import days, elevation, stats, tracks
from trackspark.sources.dem import bands_of_cells

from .registry import half_up, query, r, rnd
from .scalars import ROAD, ROAD_CASE, _tag_sql
from .track_queries import CUM, STEP

LERP = "CASE WHEN {a} IS NULL THEN {b} WHEN {b} IS NULL THEN {a} ELSE {a}+({b}-{a})*{f} END"
DEM = f"""dem_at AS (SELECT t.*, floor(lat)::INT AS tl, floor(lng)::INT AS tg, (floor(lat)+1-lat)*(n-1) AS rf, (lng-floor(lng))*(n-1) AS cf, n FROM track_points t, dem_n),
 dem_ix AS (SELECT *, floor(rf)::INT AS r0, floor(cf)::INT AS c0, least(floor(rf)::INT+1, n-1) AS r1, least(floor(cf)::INT+1, n-1) AS c1, rf-floor(rf) AS fr, cf-floor(cf) AS fc FROM dem_at),
 dem_h AS (SELECT p.*, a.ele AS h00, b.ele AS h01, c.ele AS h10, d.ele AS h11 FROM dem_ix p
  LEFT JOIN dem_cells a ON a.tile_lat=tl AND a.tile_lng=tg AND a.r=r0 AND a.c=c0 LEFT JOIN dem_cells b ON b.tile_lat=tl AND b.tile_lng=tg AND b.r=r0 AND b.c=c1
  LEFT JOIN dem_cells c ON c.tile_lat=tl AND c.tile_lng=tg AND c.r=r1 AND c.c=c0 LEFT JOIN dem_cells d ON d.tile_lat=tl AND d.tile_lng=tg AND d.r=r1 AND d.c=c1),
 dem_v AS (SELECT *, {LERP.format(a='h00', b='h01', f='fc')} AS top, {LERP.format(a='h10', b='h11', f='fc')} AS bot FROM dem_h),
 ele AS (SELECT track_id, seq, coalesce({LERP.format(a='top', b='bot', f='fr')}, 0e0) AS ele FROM dem_v)"""
PROFILE = f"{DEM}, prof AS (SELECT track_id, seq AS i, cum_m, ele FROM {CUM} c JOIN ele USING (track_id, seq))"
EFFORT = f"""{PROFILE}, d AS (SELECT *, coalesce(cum_m-lag(cum_m) OVER w, 0e0)/1000e0 AS km, greatest(coalesce(ele-lag(ele) OVER w, 0e0), 0e0) AS up FROM prof WINDOW w AS (PARTITION BY track_id ORDER BY i)),
 eff AS (SELECT track_id, i, cum_m, ele, sum(up) OVER w AS cum_climb, sum(km+0.1e0*up) OVER w AS cum_effort FROM d WINDOW w AS (PARTITION BY track_id ORDER BY i))"""


def profile(v):
    return elevation.elevation_profile(v.track_points, v.dem_cells)


@query("sample_dem", f"WITH {DEM} SELECT track_id, seq, {r('ele')} AS ele FROM ele")
def _(v):
    return rnd(elevation.sample_dem(v.track_points, v.dem_cells).select("track_id", "seq", "ele"), "ele")


@query("sample_dem_bands", f"WITH {DEM} SELECT track_id, seq, {r('ele')} AS ele FROM ele")
def _(v):
    """The same heights from bands of rows."""
    return rnd(elevation.sample_dem(v.track_points, v.stored("dem_bands", lambda: bands_of_cells(v.dem_cells))).select("track_id", "seq", "ele"), "ele")


@query("elevation_profile", f"WITH {PROFILE} SELECT track_id, i, {r('cum_m')} AS cum_m, {r('ele')} AS ele FROM prof")
def _(v):
    return rnd(profile(v), "cum_m", "ele")


@query("elevation_summary", f"""WITH {PROFILE}, d AS (SELECT track_id, ele, ele-lag(ele) OVER (PARTITION BY track_id ORDER BY i) AS d FROM prof)
 SELECT track_id, {half_up('coalesce(sum(CASE WHEN d > 0 THEN d END), 0e0)')} AS gain, {half_up('coalesce(sum(CASE WHEN d < 0 THEN -d END), 0e0)')} AS loss, min({half_up('ele')}) AS min_ele, max({half_up('ele')}) AS max_ele FROM d GROUP BY 1""")
def _(v):
    return elevation.elevation_summary(profile(v))


@query("cum_effort", f"WITH {EFFORT} SELECT track_id, i, {r('cum_climb')} AS cum_climb, {r('cum_effort')} AS cum_effort FROM eff")
def _(v):
    return rnd(tracks.cum_effort(profile(v)).select("track_id", "i", "cum_climb", "cum_effort"), "cum_climb", "cum_effort")


# The sequential rule, day by day: the first sample after the last boundary that reaches the target.
SPLIT = f"""{EFFORT}, tot AS (SELECT track_id, max(i) AS last, max(cum_effort) AS e, max(cum_climb) AS climb, CAST(1+track_id%12 AS INT) AS days FROM eff GROUP BY track_id),
 tt AS (SELECT *, CASE WHEN days < last+1 THEN days ELSE greatest(1, last) END AS dd FROM tot),
 run(track_id, day, start_i, end_i, dd, last, e) AS (
  SELECT track_id, 1, 0, CASE WHEN dd = 1 THEN last ELSE (SELECT coalesce(min(f.i), t.last) FROM eff f WHERE f.track_id = t.track_id AND f.i > 0 AND f.cum_effort >= t.e/t.dd) END, dd, last, e FROM tt t
  UNION ALL SELECT t.track_id, day+1, end_i, CASE WHEN day+1 = dd THEN last ELSE (SELECT coalesce(min(f.i), t.last) FROM eff f WHERE f.track_id = t.track_id AND f.i > t.end_i AND f.cum_effort >= t.e/t.dd*(t.day+1)) END, dd, last, e FROM run t
  WHERE day < dd AND (day+1 = dd OR end_i < last))"""
DAYS_SQL = f"""WITH RECURSIVE {SPLIT} SELECT u.track_id, u.day, u.start_i, u.end_i, {r('(b.cum_m-a.cum_m)/1000')} AS km,
 {r(f"CASE WHEN u.day = u.dd THEN floor(t.climb+0.5e0)-a.cum_climb ELSE b.cum_climb-a.cum_climb END")} AS gain
 FROM run u JOIN eff a ON a.track_id = u.track_id AND a.i = u.start_i JOIN eff b ON b.track_id = u.track_id AND b.i = u.end_i JOIN tt t ON t.track_id = u.track_id"""


def day_counts(v):
    return v.track_points.select("track_id").distinct().selectExpr("track_id", "CAST(1 + track_id % 12 AS INT) AS days")


@query("split_days", DAYS_SQL)
def _(v):
    return rnd(days.split_days(profile(v), day_counts(v)), "km", "gain")


BOUNDS_SQL = """(WITH n AS (SELECT track_id, count(*)::INT AS n, least(20, count(*))::INT AS m, CAST(1+track_id%5 AS INT) AS days_total FROM track_points GROUP BY track_id),
 s AS (SELECT *, unnest(range(1, days_total+1)) AS day FROM n), b AS (SELECT *, CAST((day-1)*(m-1)//days_total AS INT) AS start_i, CAST(day*(m-1)//days_total AS INT) AS end_i FROM s),
 x AS (SELECT *, CASE WHEN day = 1 THEN 0 ELSE floor(start_i*((n-1e0)/(m-1e0))+0.5e0)::INT END AS s0, CASE WHEN day = days_total THEN n-1 ELSE floor(end_i*((n-1e0)/(m-1e0))+0.5e0)::INT END AS e0 FROM b)
 SELECT track_id, CAST(day AS INT) AS day, s0 AS start_idx, CASE WHEN e0 <= s0 THEN least(s0+1, n-1) ELSE e0 END AS end_idx FROM x)"""


def bounds(v):
    """Day bounds in a 20-sample space mapped to vertices."""
    n = v.track_points.groupBy("track_id").agg(F.count("*").cast("int").alias("n"))
    n = n.selectExpr("track_id", "n", "least(20, n) AS m", "CAST(1 + track_id % 5 AS INT) AS days_total")
    b = n.withColumn("day", F.explode(F.sequence(F.lit(1), F.col("days_total"))))
    b = b.selectExpr("*", "CAST((day-1)*(m-1) div days_total AS INT) AS start_i", "CAST(day*(m-1) div days_total AS INT) AS end_i")
    return days.resolve_bounds(b)


@query("resolve_bounds", f"SELECT * FROM {BOUNDS_SQL} b")
def _(v):
    return bounds(v).select("track_id", "day", "start_idx", "end_idx")


@query("build_days", f"""WITH {DEM}, s AS (SELECT q.track_id, q.seq, step_km, ele-lag(ele) OVER (PARTITION BY q.track_id ORDER BY q.seq) AS d FROM {STEP} q JOIN ele USING (track_id, seq))
 SELECT b.track_id, b.day, {r('coalesce(sum(step_km), 0e0)')} AS km, {half_up('coalesce(sum(CASE WHEN d > 0 THEN d END), 0e0)')} AS gain, {half_up('coalesce(sum(CASE WHEN d < 0 THEN -d END), 0e0)')} AS loss
 FROM {BOUNDS_SQL} b JOIN s ON s.track_id = b.track_id AND s.seq > b.start_idx AND s.seq <= b.end_idx GROUP BY ALL""")
def _(v):
    return rnd(days.build_days(elevation.sample_dem(v.track_points, v.dem_cells), bounds(v)), "km")


@query("day_geometry", f"SELECT t.track_id, b.day, CAST(t.seq-b.start_idx AS INT) AS local_seq, {r('lng', 6)} AS lng, {r('lat', 6)} AS lat FROM {BOUNDS_SQL} b JOIN track_points t ON t.track_id = b.track_id AND t.seq BETWEEN b.start_idx AND b.end_idx")
def _(v):
    d = days.day_geometry(v.track_points, bounds(v)).select("track_id", "day", "local_seq", "lng", "lat")
    return rnd(d, "lng", "lat", digits=6)


# Messages end on vertex row_no, so matching is by number in SQL and by coordinate key in Spark.
LONG = f"""(SELECT track_id, row_no, dist_m, dim, CASE dim WHEN 'surface' THEN sf WHEN 'smoothness' THEN sm ELSE road END AS code FROM
 (SELECT *, coalesce(lower({_tag_sql('surface')}), 'unknown') AS sf, coalesce(lower({_tag_sql('smoothness')}), 'unknown') AS sm, {ROAD_CASE} AS road FROM {ROAD} q) z, (VALUES ('surface'),('road'),('smoothness')) d(dim) WHERE dist_m > 0)"""
SPANS = f"""sp AS (SELECT track_id, dim, row_no, coalesce(lag(row_no) OVER (PARTITION BY track_id, dim ORDER BY row_no), 0) AS s, row_no AS e, code FROM {LONG} l),
 isl AS (SELECT *, sum(CASE WHEN pc = code THEN 0 ELSE 1 END) OVER (PARTITION BY track_id, dim ORDER BY row_no) AS g FROM (SELECT *, lag(code) OVER (PARTITION BY track_id, dim ORDER BY row_no) AS pc FROM sp) q),
 spans AS (SELECT track_id, dim, CAST(min(s) AS INT) AS start_idx, CAST(max(e) AS INT) AS end_idx, any_value(code) AS code FROM isl GROUP BY track_id, dim, g)"""


def matched(v):
    return stats.match_endpoints(v.messages, v.track_points)


def spans(v):
    return stats.merge_spans(stats.stat_spans(v.messages, v.track_points))


@query("match_endpoints", "SELECT track_id, row_no, row_no AS end_idx FROM messages")
def _(v):
    return matched(v).select("track_id", "row_no", "end_idx")


@query("route_stats", f"SELECT track_id, dim, code, CAST(sum(dist_m) AS BIGINT) AS meters FROM {LONG} l GROUP BY ALL")
def _(v):
    return stats.route_stats(v.messages)


@query("merge_stats", f"SELECT team, dim, code, CAST(sum(dist_m) AS BIGINT) AS meters FROM (SELECT *, track_id % 7 AS team FROM {LONG} l) q GROUP BY ALL")
def _(v):
    nested = stats.stats_maps(stats.route_stats(v.messages)).withColumn("team", F.col("track_id") % 7)
    return stats.merge_stats(nested, "team")


@query("stats_maps", f"""WITH s AS (SELECT track_id, dim, code, CAST(sum(dist_m) AS BIGINT) AS m FROM {LONG} l GROUP BY ALL)
 SELECT track_id, CAST(sum(CASE WHEN dim = 'road' THEN m END) AS BIGINT) AS total, string_agg(CASE WHEN dim = 'surface' THEN concat(code, '=', m) END, ';' ORDER BY m DESC, code) AS surface, string_agg(CASE WHEN dim = 'road' THEN concat(code, '=', m) END, ';' ORDER BY m DESC, code) AS road FROM s GROUP BY 1""")
def _(v):
    def text(c):
        return F.array_join(F.transform(F.map_entries(c), lambda e: F.concat_ws("=", e["key"], e["value"])), ";")

    d = stats.stats_maps(stats.route_stats(v.messages))
    return d.select("track_id", "total", text("surface_m").alias("surface"), text("road_m").alias("road"))


@query("tag_breakdown", f"""WITH m AS (SELECT * FROM messages WHERE dist_m > 0), tot AS (SELECT track_id, sum(dist_m) AS total FROM m GROUP BY 1),
 kv AS (SELECT track_id, split_part(t, '=', 1) AS key, t[instr(t, '=')+1:] AS value, dist_m FROM (SELECT track_id, dist_m, unnest(string_split(way_tags, ' ')) AS t FROM m) q),
 pv AS (SELECT track_id, key, value, sum(dist_m) AS meters FROM kv GROUP BY ALL), pk AS (SELECT track_id, key, sum(meters) AS tagged FROM pv GROUP BY ALL),
 a AS (SELECT * FROM pv UNION ALL SELECT track_id, key, '[no tag]', total-tagged FROM pk JOIN tot USING (track_id) WHERE total > tagged)
 SELECT track_id, key, value, CAST(meters AS BIGINT) AS meters, CAST(total AS BIGINT) AS total, {r('100e0*meters/total')} AS pct FROM a JOIN tot USING (track_id)""")
def _(v):
    return rnd(stats.tag_breakdown(v.messages), "pct")


@query("merge_spans", f"WITH {SPANS} SELECT * FROM spans")
def _(v):
    return spans(v).select("track_id", "dim", F.col("start_idx").cast("int").alias("start_idx"), F.col("end_idx").cast("int").alias("end_idx"), "code")


FLAT = """flat AS (SELECT track_id, row_no-1 AS s, row_no AS e FROM messages WHERE regexp_matches(way_tags, '(^| )(tunnel|bridge)=') AND NOT regexp_matches(way_tags, '(tunnel|bridge)=no')),
 fl AS (SELECT *, sum(CASE WHEN pe >= s THEN 0 ELSE 1 END) OVER (PARTITION BY track_id ORDER BY e) AS g FROM (SELECT *, lag(e) OVER (PARTITION BY track_id ORDER BY e) AS pe FROM flat) q),
 flats AS (SELECT track_id, CAST(min(s) AS INT) AS start_idx, CAST(max(e) AS INT) AS end_idx FROM fl GROUP BY track_id, g)"""


@query("flat_spans", f"WITH {FLAT} SELECT * FROM flats")
def _(v):
    d = stats.flat_spans(matched(v))
    return d.select("track_id", F.col("start_idx").cast("int").alias("start_idx"), F.col("end_idx").cast("int").alias("end_idx"))


FLATTEN = f"""{PROFILE}, big AS (SELECT track_id, seq0-5 AS a, seq0 AS b FROM (SELECT track_id, seq AS seq0 FROM track_points WHERE seq % 8 = 7) q),
 port AS (SELECT g.*, x.cum_m AS am, x.ele AS az, y.cum_m AS bm, y.ele AS bz FROM big g JOIN prof x ON x.track_id = g.track_id AND x.i = a JOIN prof y ON y.track_id = g.track_id AND y.i = b)"""


@query("flatten_spans", f"""WITH {FLATTEN} SELECT p.track_id, p.i AS seq, {r('CASE WHEN a IS NULL THEN ele ELSE az+(cum_m-am)/(bm-am)*(bz-az) END')} AS ele
 FROM prof p LEFT JOIN port ON port.track_id = p.track_id AND p.i > a AND p.i < b""")
def _(v):
    p = profile(v).withColumnRenamed("i", "seq")
    wide = v.track_points.where("seq % 8 = 7").select("track_id", (F.col("seq") - 5).alias("start_idx"), F.col("seq").alias("end_idx"))
    return rnd(elevation.flatten_spans(p, wide).select("track_id", "seq", "ele"), "ele")


# One window after the other: the farthest vertex within 120 km, or the next one.
WINDOWS = f"""WITH RECURSIVE c AS (SELECT track_id, seq, cum_m FROM {CUM} q), l AS (SELECT track_id, max(seq) AS last FROM c GROUP BY 1),
 w(track_id, start_i, end_i, last) AS (SELECT l.track_id, 0, (SELECT greatest(max(b.seq), 1) FROM c b WHERE b.track_id = l.track_id AND b.cum_m <= 120000), last FROM l WHERE last > 0
 UNION ALL SELECT w.track_id, end_i, (SELECT greatest(max(b.seq), w.end_i+1) FROM c b JOIN c a ON a.track_id = b.track_id WHERE b.track_id = w.track_id AND a.seq = w.end_i AND b.cum_m - a.cum_m <= 120000), last FROM w WHERE end_i < last)
 SELECT track_id, start_i, end_i FROM w"""


@query("elevation_windows", WINDOWS)
def _(v):
    return elevation.elevation_windows(v.track_points)


@query("enrich_elevation", f"""WITH {PROFILE}, {FLAT}, port AS (SELECT g.*, x.cum_m AS am, x.ele AS az, y.cum_m AS bm, y.ele AS bz FROM flats g JOIN prof x ON x.track_id = g.track_id AND x.i = start_idx JOIN prof y ON y.track_id = g.track_id AND y.i = end_idx)
 SELECT p.track_id, p.i AS seq, {r('CASE WHEN start_idx IS NULL THEN ele ELSE az+(cum_m-am)/(bm-am)*(bz-az) END', 7)} AS ele FROM prof p LEFT JOIN port ON port.track_id = p.track_id AND p.i > start_idx AND p.i < end_idx""")
def _(v):
    d = elevation.enrich_elevation(v.track_points, v.dem_cells, stats.flat_spans(matched(v)))
    return rnd(d.select("track_id", "seq", "ele"), "ele", digits=7)


SLICED = f"""WITH {SPANS}, c AS (SELECT track_id, seq, cum_m FROM {CUM} q), o AS (SELECT s.track_id, b.day, dim, greatest(s.start_idx, b.start_idx) AS s, least(s.end_idx, b.end_idx) AS e, b.start_idx AS w0, code
 FROM spans s JOIN {BOUNDS_SQL} b ON b.track_id = s.track_id AND s.start_idx < b.end_idx AND b.start_idx < s.end_idx),
 sl AS (SELECT o.track_id, day, dim, s-w0 AS start_idx, e-w0 AS end_idx, code, {half_up('b.cum_m-a.cum_m')} AS meters FROM o JOIN c a ON a.track_id = o.track_id AND a.seq = s JOIN c b ON b.track_id = o.track_id AND b.seq = e WHERE b.cum_m > a.cum_m)"""


@query("slice_stats", f"{SLICED} SELECT track_id, day, dim, CAST(start_idx AS INT) AS start_idx, CAST(end_idx AS INT) AS end_idx, code, meters FROM sl")
def _(v):
    d = days.slice_stats(spans(v), v.track_points, bounds(v))
    return d.select("track_id", "day", "dim", F.col("start_idx").cast("int").alias("start_idx"), F.col("end_idx").cast("int").alias("end_idx"), "code", "meters")


@query("slice_totals", f"{SLICED} SELECT track_id, day, dim, code, CAST(sum(meters) AS BIGINT) AS meters FROM sl GROUP BY ALL")
def _(v):
    return days.slice_totals(days.slice_stats(spans(v), v.track_points, bounds(v)))


@query("day_waypoints", f"""WITH b AS (SELECT * FROM {BOUNDS_SQL} b), cnt AS (SELECT plan_id AS track_id, count(*) AS c FROM waypoints GROUP BY 1), bb AS (SELECT b.*, coalesce(c, 0) < 5 AS plain FROM b LEFT JOIN cnt USING (track_id)),
 mine AS (SELECT bb.track_id, bb.day, w.pos, w.lng, w.lat, w.seq <= start_idx+3 AS ns, w.seq >= end_idx-3 AS ne FROM bb JOIN waypoints w ON w.plan_id = bb.track_id AND w.seq BETWEEN start_idx AND end_idx WHERE NOT plain),
 fl AS (SELECT bb.track_id, bb.day, start_idx, end_idx, coalesce(bool_or(ns), FALSE) AS hs, coalesce(bool_or(ne), FALSE) AS he FROM bb LEFT JOIN mine USING (track_id, day) WHERE NOT plain GROUP BY ALL),
 x AS (SELECT track_id, day, 'plan' AS source, pos AS ord, lng, lat FROM mine
  UNION ALL SELECT f.track_id, day, 'start', -1, lng, lat FROM fl f JOIN track_points t ON t.track_id = f.track_id AND t.seq = start_idx WHERE NOT hs
  UNION ALL SELECT f.track_id, day, 'end', 1073741824, lng, lat FROM fl f JOIN track_points t ON t.track_id = f.track_id AND t.seq = end_idx WHERE NOT he
  UNION ALL SELECT k.track_id, day, 'knot', k.seq, lng, lat FROM (SELECT DISTINCT track_id, day, unnest(list_concat(range(start_idx, end_idx+1, greatest(1, (end_idx-start_idx+1)//least(48, greatest(2, (end_idx-start_idx+1)//50)))), [end_idx])) AS seq FROM bb WHERE plain) k JOIN track_points t ON t.track_id = k.track_id AND t.seq = k.seq)
 SELECT track_id, day, source, CAST(ord AS INT) AS ord, {r('lng', 6)} AS lng, {r('lat', 6)} AS lat FROM x""")
def _(v):
    w = v.waypoints.select(F.col("plan_id").alias("track_id"), "pos", "lng", "lat", F.col("seq").alias("idx"))
    return rnd(days.day_waypoints(w, bounds(v), v.track_points), "lng", "lat", digits=6)


BUDGET = "(days*(coalesce(km_per_day,200)+0.1e0*CASE WHEN elev_per_day > 0 THEN elev_per_day ELSE greatest(300e0, coalesce(km_per_day,200)*1000e0/180e0) END))"


def plan_days(v):
    return v.drafts.select(F.col("user_id").alias("plan_id"), F.col("draft_id").alias("day"), F.col("distance_km").alias("km"), F.col("elevation_gain").alias("gain"))


@query("plan_summary", f"""WITH d AS (SELECT user_id AS plan_id, sum(distance_km) AS km, CAST(sum(elevation_gain) AS BIGINT) AS gain FROM drafts GROUP BY 1), p AS (SELECT plan_id, CASE WHEN d.km > 0 THEN d.km ELSE 123e0 END AS km, coalesce(gain, 0) AS gain, {BUDGET} AS budget FROM plans LEFT JOIN d USING (plan_id))
 SELECT plan_id, {r('km', 6)} AS km, gain, {r('km+0.1e0*gain', 6)} AS effort, {r('budget', 6)} AS budget, CASE WHEN (km+0.1e0*gain)/budget > 1.05 THEN 'OVER' WHEN (km+0.1e0*gain)/budget < 0.95 THEN 'UNDER' ELSE 'OK' END AS fit FROM p""")
def _(v):
    return rnd(days.plan_summary(plan_days(v), v.plans.withColumn("routed_km", F.lit(123.0))), "km", "effort", "budget", digits=6)


@query("day_distribution", f"SELECT user_id AS plan_id, draft_id AS day, {r('distance_km', 6)} AS km, elevation_gain AS gain, {r('distance_km+0.1e0*elevation_gain', 6)} AS effort FROM drafts")
def _(v):
    return rnd(days.day_distribution(plan_days(v)), "km", "effort", digits=6)
