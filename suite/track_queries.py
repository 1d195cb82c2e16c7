"""Track sequences: distance, chunking, merging, down-sampling, tiles."""

from __future__ import annotations

from pyspark.sql import functions as F

from trackspark.operators import elevation, tracks

from .registry import half_up, hav, query, r, rnd

STEP = f"""(SELECT *, {hav('plng', 'plat', 'lng', 'lat')} AS step_km FROM (SELECT *, lag(lng) OVER w AS plng, lag(lat) OVER w AS plat FROM track_points WINDOW w AS (PARTITION BY track_id ORDER BY seq)) q0)"""
CUM = f"(SELECT track_id, seq, lng, lat, ts, k, coalesce(sum(step_km*1000) OVER (PARTITION BY track_id ORDER BY seq), 0e0) AS cum_m FROM {STEP} q1)"

# Tiles by the stepping order of grid-line crossings, rows before columns on a tie.
FRAC = "(SELECT *, (lng+180e0)/360e0*16384e0 AS fx, (1e0-ln(tan(radians(lat))+1e0/cos(radians(lat)))/pi())/2e0*16384e0 AS fy FROM track_points)"
TILE_VISITS = f"""seg AS (SELECT track_id, seq, ts, coalesce(lag(fx) OVER w, fx) AS x0, coalesce(lag(fy) OVER w, fy) AS y0, fx AS x1, fy AS y1 FROM {FRAC} f WINDOW w AS (PARTITION BY track_id ORDER BY seq)),
 g AS (SELECT *, floor(x0)::BIGINT AS cx, floor(y0)::BIGINT AS cy, floor(x1)::BIGINT AS ex, floor(y1)::BIGINT AS ey, CASE WHEN x1 > x0 THEN 1 ELSE -1 END AS sx, CASE WHEN y1 > y0 THEN 1 ELSE -1 END AS sy FROM seg),
 cross_x AS (SELECT track_id, seq, (CASE WHEN sx > 0 THEN cx+1-x0 ELSE x0-cx END + i)/abs(x1-x0) AS t, 1 AS is_x FROM g, unnest(range(abs(ex-cx))) u(i)),
 cross_y AS (SELECT track_id, seq, (CASE WHEN sy > 0 THEN cy+1-y0 ELSE y0-cy END + i)/abs(y1-y0) AS t, 0 AS is_x FROM g, unnest(range(abs(ey-cy))) u(i)),
 steps AS (SELECT track_id, seq, sum(is_x) OVER w AS nx, sum(1-is_x) OVER w AS ny FROM (SELECT * FROM cross_x UNION ALL SELECT * FROM cross_y) e WINDOW w AS (PARTITION BY track_id, seq ORDER BY t, is_x ROWS UNBOUNDED PRECEDING)),
 visits_t AS (SELECT track_id, seq, ts, cx*131072+cy AS tile_key FROM g UNION ALL SELECT track_id, seq, ts, (cx+sx*nx::BIGINT)*131072+cy+sy*ny::BIGINT FROM g JOIN steps USING (track_id, seq)),
 tile_of AS (SELECT track_id, tile_key, min(seq) AS first_seq, min(ts) AS ts FROM visits_t GROUP BY ALL)"""


@query("track_km_and_tiles", f"""WITH {TILE_VISITS}, km AS (SELECT track_id, coalesce(sum(step_km), 0e0) AS km FROM {STEP} s GROUP BY 1)
 SELECT track_id, {r('km')} AS km, n AS tiles FROM km JOIN (SELECT track_id, count(*) AS n FROM tile_of GROUP BY 1) USING (track_id)""")
def _(v):
    km = tracks.track_length(v.track_points)
    tiles = tracks.track_tiles(v.track_points).groupBy("track_id").agg(F.count("*").alias("tiles"))
    return rnd(km.join(tiles, "track_id"), "km")


@query("cum_distance", f"SELECT track_id, seq, {r('cum_m')} AS cum_m FROM {CUM} c")
def _(v):
    return rnd(tracks.cum_distance(v.track_points).select("track_id", "seq", "cum_m"), "cum_m")


@query("track_length", f"SELECT track_id, {r('coalesce(sum(step_km), 0e0)')} AS km FROM {STEP} s GROUP BY 1")
def _(v):
    return rnd(tracks.track_length(v.track_points), "km")


def with_ele(v):
    """Track points with a made height from the sensor value."""
    return v.track_points.withColumn("ele", F.col("value") * 3.0)


@query("climb_m", f"""WITH d AS (SELECT track_id, seq, value*3e0 - lag(value*3e0) OVER (PARTITION BY track_id ORDER BY seq) AS d FROM track_points)
 SELECT track_id, CAST(sum(g) AS BIGINT) AS climb_m FROM (SELECT track_id, {half_up('sum(greatest(d, 0e0))')} AS g FROM d WHERE d IS NOT NULL GROUP BY track_id, (seq-1)//20) q GROUP BY 1""")
def _(v):
    return tracks.climb_m(with_ele(v), window=20)


@query("chunk_waypoints", """WITH n AS (SELECT plan_id, count(*) AS n FROM waypoints GROUP BY 1), c AS (SELECT plan_id, n, unnest(range(greatest(1, CAST(ceil((n-1)/7.0) AS BIGINT)))) AS chunk FROM n)
 SELECT plan_id, pos, chunk, CAST(pos - 7*chunk AS INT) AS at FROM c JOIN waypoints w USING (plan_id) WHERE w.pos BETWEEN 7*chunk AND 7*chunk+7""")
def _(v):
    return tracks.chunk_waypoints(v.waypoints, size=8).select("plan_id", "pos", "chunk", "at")


def leg_points(v):
    """Tracks cut into legs of ten segments; neighbouring legs share a vertex."""
    own = F.struct(F.expr("floor(seq/10)").alias("leg"), F.expr("CAST(seq % 10 AS INT)").alias("i"))
    prior = F.struct(F.expr("floor(seq/10) - 1").alias("leg"), F.lit(10).alias("i"))
    both = F.array_compact(F.array(own, F.when((F.col("seq") % 10 == 0) & (F.col("seq") > 0), prior)))
    return v.track_points.withColumn("l", F.explode(both)).select("track_id", "l.leg", "l.i", "lng", "lat")


@query("merge_legs", f"SELECT track_id, seq AS idx, {r('lng', 6)} AS lng, {r('lat', 6)} AS lat FROM track_points")
def _(v):
    d = tracks.merge_legs(leg_points(v)).select("track_id", F.col("idx").cast("int").alias("idx"), "lng", "lat")
    return rnd(d, "lng", "lat", digits=6)


@query("shift_spans", """WITH n AS (SELECT track_id, max(seq) AS last FROM track_points GROUP BY 1), l AS (SELECT track_id, last, unnest(range(last//10+1)) AS leg FROM n)
 SELECT track_id, leg, 10*leg AS start_idx, least(10*leg+10, last)::BIGINT AS end_idx FROM l""")
def _(v):
    lp = leg_points(v)
    spans = lp.groupBy("track_id", "leg").agg(F.lit(0).cast("bigint").alias("start_idx"), F.max("i").cast("bigint").alias("end_idx"))
    return tracks.shift_spans(spans, lp).select("track_id", "leg", "start_idx", "end_idx")


MID = "(SELECT track_id, seq//10 AS leg, lng AS c_lng, lat+0.001e0 AS c_lat FROM track_points WHERE event_type = 'error' AND seq % 10 = 4)"


def _cuts(v):
    at = v.track_points.where("event_type = 'error' AND seq % 10 = 4")
    return at.select("track_id", F.expr("floor(seq/10)").alias("leg"), F.lit(4).alias("seg_idx"), F.col("lng").alias("c_lng"), (F.col("lat") + 0.001).alias("c_lat"))


@query("split_legs", f"""WITH s AS (SELECT track_id, (seq-1)//10 AS leg, (seq-1)%10+1 AS i, plng, plat, lng, lat, step_km FROM {STEP} q WHERE step_km IS NOT NULL),
 h AS (SELECT track_id, leg, coalesce(sum(CASE WHEN i < 5 THEN step_km WHEN i = 5 THEN {hav('plng', 'plat', 'c_lng', 'c_lat')} END), 0e0) AS h1, coalesce(sum(CASE WHEN i > 5 THEN step_km WHEN i = 5 THEN {hav('c_lng', 'c_lat', 'lng', 'lat')} END), 0e0) AS h2
 FROM s JOIN {MID} m USING (track_id, leg) GROUP BY ALL)
 SELECT track_id, leg, half, {r('(10e0+leg)*CASE half WHEN 1 THEN h1 ELSE h2 END/greatest(0.001e0, h1+h2)')} AS km, {r('(50e0+leg)*CASE half WHEN 1 THEN h1 ELSE h2 END/greatest(0.001e0, h1+h2)')} AS climb_m FROM h, (VALUES (1),(2)) x(half)""")
def _(v):
    lp = leg_points(v)
    legs = lp.select("track_id", "leg").distinct().withColumns({"km": F.lit(10.0) + F.col("leg"), "climb_m": F.lit(50.0) + F.col("leg")})
    return rnd(tracks.split_legs(legs, lp, _cuts(v)), "km", "climb_m")


def _down_sql(form):
    keep = {
        "uniform": "unnest(CASE WHEN n <= 20 THEN range(n) ELSE list_transform(range(20), lambda i: CAST(floor(i*((n-1)/19e0)+0.5e0) AS BIGINT)) END)",
        "step": "unnest(CASE WHEN n <= 20 THEN range(n) ELSE list_transform(range(20), lambda i: CASE WHEN i = 19 THEN n-1 ELSE CAST(floor(i*(n/20e0)+0.5e0) AS BIGINT) END) END)",
        "every": "unnest(CASE WHEN n <= 20 THEN range(n) ELSE list_distinct(list_concat(range(0, n, greatest(1, n//20)), [n-1])) END)",
    }[form]
    return f"WITH n AS (SELECT track_id, count(*)::BIGINT AS n FROM track_points GROUP BY 1) SELECT track_id, {keep} AS seq FROM n"


def _down(form):
    query(f"downsample_{form}", _down_sql(form))(lambda v: tracks.downsample(v.track_points, 20, form).select("track_id", F.col("seq").cast("bigint").alias("seq")))


for _f in ("uniform", "step", "every"):
    _down(_f)


@query("track_tiles", f"WITH {TILE_VISITS} SELECT track_id, tile_key, first_seq FROM tile_of")
def _(v):
    return tracks.track_tiles(v.track_points).select("track_id", "tile_key", "first_seq")


@query("tile_summary", f"""WITH {TILE_VISITS}, w AS (SELECT tile_key, arg_min(track_id, struct_pack(ts := ts, t := track_id)) AS track_id FROM tile_of GROUP BY 1)
 SELECT track_id, n AS tiles, coalesce(won, 0) AS won FROM (SELECT track_id, count(*) AS n FROM tile_of GROUP BY 1) a LEFT JOIN (SELECT track_id, count(*) AS won FROM w GROUP BY 1) b USING (track_id)""")
def _(v):
    return tracks.tile_summary(v.track_points)


@query("user_tiles", f"""WITH {TILE_VISITS}, u AS (SELECT track_id // 4 AS user_id, track_id, tile_key, ts FROM tile_of), w AS (SELECT user_id, tile_key, arg_min(track_id, struct_pack(ts := ts, t := track_id)) AS track_id FROM u GROUP BY 1, 2)
 SELECT user_id, track_id, n AS tiles, coalesce(fresh, 0) AS fresh FROM (SELECT user_id, track_id, count(*) AS n FROM u GROUP BY 1, 2) a LEFT JOIN (SELECT user_id, track_id, count(*) AS fresh FROM w GROUP BY 1, 2) b USING (user_id, track_id)""")
def _(v):
    return tracks.user_tiles(v.track_points.withColumn("user_id", F.expr("track_id div 4")))


@query("distinct_tiles", f"WITH {TILE_VISITS} SELECT DISTINCT tile_key FROM tile_of")
def _(v):
    return tracks.track_tile_visits(v.track_points).select("tile_key").dropDuplicates()


DIST = f"(SELECT track_id, seq, cum_m FROM {CUM} c)"


@query("interp_join", f"""WITH p AS (SELECT track_id, seq, cum_m AS x, k*2e0 AS val FROM {CUM} c WHERE event_type_x), q AS (SELECT track_id, seq, cum_m+777e0 AS x FROM {CUM} c)
 SELECT q.track_id, q.seq, {r('CASE WHEN a.x IS NULL THEN b.val WHEN b.x IS NULL THEN a.val WHEN b.x <= a.x THEN a.val ELSE a.val+(q.x-a.x)/(b.x-a.x)*(b.val-a.val) END', 3)} AS v
 FROM q ASOF LEFT JOIN p a ON q.track_id = a.track_id AND q.x >= a.x ASOF LEFT JOIN p b ON q.track_id = b.track_id AND q.x <= b.x""".replace("event_type_x", "k % 3 <> 1"))
def _(v):
    cum = tracks.cum_distance(v.track_points)
    profile = cum.where("k % 3 <> 1").select("track_id", F.col("cum_m").alias("x"), (F.col("k") * 2.0).alias("v"))
    points = cum.select("track_id", (F.col("cum_m") + 777.0).alias("x"), "seq")
    return rnd(elevation.interp_join(points, profile).select("track_id", "seq", "v"), "v", digits=3)




