"""Adjacency, holes, rims, nearest neighbours, distances to tracks."""

from __future__ import annotations

from pyspark.sql import functions as F

from trackspark.operators import adjacency, coverage, neighbors

from .area_queries import BASE, SEG, cov, cover_cte
from .registry import hav, query, r, rnd
from .views import Views

# Closed form for squares on a grid: a side neighbour shares its side and 100 m of both adjoining sides, a corner
# neighbour 100 m of two sides; a city and its ring meet across a gap.
TOL = "(100e0/111320e0)"
KM = "111.32e0"
ADJ = f"""gr AS (SELECT sq.*, area_id AS id, w, n FROM sq, grid WHERE area_id < n), ci AS (SELECT sq.*, area_id-n AS id FROM sq, grid WHERE area_id >= n),
 nb AS (SELECT a.area_id, b.area_id AS nbr_id, CASE WHEN dy = 0 THEN 2*a.hy+2*{TOL} WHEN dx = 0 THEN 2*a.hx+2*{TOL} ELSE 2*{TOL} END AS len FROM gr a, (VALUES (-1,-1),(-1,0),(-1,1),(0,-1),(0,1),(1,-1),(1,0),(1,1)) d(dx,dy)
  JOIN gr b ON b.id = a.id+dx+dy*a.w WHERE a.id % a.w + dx BETWEEN 0 AND a.w-1),
 gap AS (SELECT g.area_id AS ring_id, c.area_id AS city_id, g.gx, g.gy, c.hx, c.hy, g.gx-c.hx AS ex, g.gy-c.hy AS ey FROM gr g JOIN ci c ON c.id = g.id),
 gl AS (SELECT *, CASE WHEN ex < {TOL} THEN 4*least(gy, hy+sqrt({TOL}*{TOL}-ex*ex)) ELSE 0e0 END + CASE WHEN ey < {TOL} THEN 4*least(gx, hx+sqrt({TOL}*{TOL}-ey*ey)) ELSE 0e0 END AS ring_len,
  CASE WHEN ex < {TOL} THEN 4*hy ELSE 4*least(hy, greatest(0e0, {TOL}-ey)) END + CASE WHEN ey < {TOL} THEN 4*hx ELSE 4*least(hx, greatest(0e0, {TOL}-ex)) END AS city_len FROM gap WHERE least(ex, ey) < {TOL}),
 adj AS (SELECT area_id, nbr_id, len*{KM} AS shared_km FROM nb UNION ALL SELECT ring_id, city_id, ring_len*{KM} FROM gl UNION ALL SELECT city_id, ring_id, city_len*{KM} FROM gl),
 per AS (SELECT area_id, (4*hx+4*hy+CASE WHEN holed THEN 4*gx+4*gy ELSE 0e0 END)*{KM} AS perimeter_km FROM sq)"""


def nidx(v: Views):
    return v.once("neighbor_index", lambda: adjacency.neighbor_index(v.areas, v.area_vertices).stored(near=False))


def adj(v):
    return v.stored("adjacency", lambda: adjacency.adjacency(nidx(v)))


def per(v):
    return adjacency.perimeters(nidx(v))


@query("adjacency", f"{BASE}, {ADJ} SELECT area_id, nbr_id, {r('shared_km', 3)} AS shared_km FROM adj")
def _(v):
    return rnd(adjacency.adjacency(nidx(v)), "shared_km", digits=3)


@query("perimeters", f"{BASE}, {ADJ} SELECT area_id, {r('perimeter_km')} AS perimeter_km FROM per")
def _(v):
    return rnd(per(v), "perimeter_km")


FRACTION = "fr AS (SELECT user_id, adj.area_id, least(1e0, sum(shared_km)/any_value(perimeter_km)) AS fraction FROM adj JOIN visits v ON v.area_id = nbr_id JOIN per ON per.area_id = adj.area_id GROUP BY ALL)"


@query("neighbor_fraction", f"{BASE}, {ADJ}, {FRACTION} SELECT user_id, area_id, {r('fraction')} AS fraction FROM fr")
def _(v):
    return rnd(adjacency.neighbor_fraction(adj(v), per(v), v.visits), "fraction")


@query("enclosed", f"{BASE}, {ADJ}, d AS (SELECT area_id, count(*) AS d FROM adj GROUP BY 1), s AS (SELECT user_id, adj.area_id, count(*) AS s FROM adj JOIN visits v ON v.area_id = nbr_id GROUP BY ALL) SELECT user_id, area_id FROM s JOIN d USING (area_id) WHERE s = d EXCEPT SELECT user_id, area_id FROM visits")
def _(v):
    return adjacency.enclosed(adj(v), v.visits)


#: Every user's scope: strips of the grid.
POOLED = "(SELECT u.user_id, area_id, country_id, level_id FROM areas JOIN (SELECT DISTINCT user_id FROM events) u ON (area_id // 64) % 16 = u.user_id % 16)"


def strips(v):
    """Users and areas with the strip that joins them."""
    users = v.events.select("user_id").distinct().withColumn("strip", F.expr("user_id % 16"))
    return users, v.areas.withColumn("strip", F.expr("(area_id div 64) % 16")).select("area_id", "country_id", "level_id", "strip")


def pool(v):
    users, areas = strips(v)
    return users.join(areas, "strip").select("user_id", "area_id", "country_id", "level_id")


REGIONS = f"""{ADJ}, node AS (SELECT user_id, area_id FROM {POOLED} p EXCEPT SELECT user_id, area_id FROM visits),
 link AS (SELECT a.user_id, a.area_id, b.area_id AS nbr_id, shared_km FROM node a JOIN adj USING (area_id) JOIN node b ON b.user_id = a.user_id AND b.area_id = adj.nbr_id),
 reach(user_id, area_id, lab) AS (SELECT user_id, area_id, area_id FROM node UNION SELECT l.user_id, l.nbr_id, reach.lab FROM reach JOIN link l ON l.user_id = reach.user_id AND l.area_id = reach.area_id),
 comp AS (SELECT user_id, area_id, min(lab) AS region FROM reach GROUP BY ALL), ii AS (SELECT user_id, area_id, sum(shared_km) AS k FROM link GROUP BY ALL),
 oo AS (SELECT n.user_id, n.area_id, sum(shared_km) AS k FROM node n JOIN adj USING (area_id) JOIN visits v ON v.user_id = n.user_id AND v.area_id = adj.nbr_id GROUP BY ALL),
 tot AS (SELECT c.user_id, region, sum(perimeter_km)-sum(coalesce(ii.k, 0)) AS outer_km, sum(coalesce(oo.k, 0)) AS walled, count(*) AS size FROM comp c JOIN per USING (area_id) LEFT JOIN ii ON ii.user_id = c.user_id AND ii.area_id = c.area_id LEFT JOIN oo ON oo.user_id = c.user_id AND oo.area_id = c.area_id GROUP BY ALL),
 hole AS (SELECT c.user_id, c.area_id, c.region, t.size FROM comp c JOIN tot t ON t.user_id = c.user_id AND t.region = c.region WHERE outer_km > 0 AND walled >= 0.9e0*outer_km)"""


def regions(v):
    users, areas = strips(v)
    scopes = areas.select(F.col("strip").alias("scope"), "area_id")
    return adjacency.enclosed_regions_in_scopes(adj(v), per(v), users.withColumnRenamed("strip", "scope"), scopes, v.visits)


@query("enclosed_regions", f"WITH RECURSIVE {BASE[5:]}, {REGIONS} SELECT * FROM hole")
def _(v):
    return regions(v)


@query("border_areas", f"{BASE}, {ADJ}, ab AS (SELECT DISTINCT adj.area_id FROM adj JOIN areas a ON a.area_id = adj.area_id JOIN areas b ON b.area_id = nbr_id WHERE a.country_id <> b.country_id), rim AS (SELECT user_id, area_id FROM visits SEMI JOIN ab USING (area_id)), d AS (SELECT area_id, count(*) AS d FROM adj GROUP BY 1), g AS (SELECT user_id, area_id, coalesce(d, 0) AS d FROM visits ANTI JOIN rim USING (user_id) LEFT JOIN d USING (area_id)) SELECT user_id, area_id FROM rim UNION ALL SELECT user_id, area_id FROM (SELECT *, max(d) OVER (PARTITION BY user_id) AS top FROM g) q WHERE d < top")
def _(v):
    return adjacency.border_areas(adj(v), v.areas, v.visits)


@query("border_areas_one_country", f"{BASE}, {ADJ}, d AS (SELECT area_id, count(*) AS d FROM adj GROUP BY 1), g AS (SELECT user_id, area_id, coalesce(d, 0) AS d FROM visits LEFT JOIN d USING (area_id)) SELECT user_id, area_id FROM (SELECT *, max(d) OVER (PARTITION BY user_id) AS top FROM g) q WHERE d < top")
def _(v):
    return adjacency.border_areas(adj(v), v.areas.withColumn("country_id", F.lit(1)), v.visits)


def wpool(v):
    """Way-points as a pool of irregular points with one id each."""
    return v.waypoints.select((F.col("plan_id") * 100000 + F.col("pos")).alias("area_id"), "plan_id", "lng", "lat", "k")


WPOOL = "wpool AS (SELECT plan_id*100000+pos AS area_id, plan_id, lng, lat, k FROM waypoints), pr AS (SELECT area_id, plan_id, k, lng*c*111e0 AS x, lat*111e0 AS y FROM wpool, (SELECT cos(radians(avg(lat))) AS c FROM wpool))"
PAIR = "nn AS (SELECT a.area_id, b.area_id AS nbr_id, sqrt(pow(a.x-b.x,2)+pow(a.y-b.y,2)) AS km FROM pr a JOIN pr b ON a.area_id <> b.area_id), rk AS (SELECT *, row_number() OVER (PARTITION BY area_id ORDER BY km, nbr_id) AS rank FROM nn)"


@query("knn", f"WITH {WPOOL}, {PAIR} SELECT area_id, nbr_id, CAST(rank AS INT) AS rank, {r('km')} AS km FROM rk WHERE rank <= 8")
def _(v):
    return rnd(neighbors.knn(wpool(v), 8), "km")


@query("nearest_dist", f"WITH {WPOOL}, {PAIR} SELECT area_id, {r('min(km)')} AS km FROM nn GROUP BY 1")
def _(v):
    return rnd(neighbors.nearest_dist(wpool(v)), "km")


@query("count_within", f"WITH {WPOOL}, {PAIR} SELECT p.area_id, count(nbr_id) AS n FROM pr p LEFT JOIN (SELECT * FROM nn WHERE km < 6) q USING (area_id) GROUP BY 1")
def _(v):
    return neighbors.count_within(wpool(v), 6.0)


@query("nearest_to", f"""WITH {WPOOL}, q AS (SELECT plan_id AS qid, start_lng*c*111e0 AS x, start_lat*111e0 AS y FROM plans, (SELECT cos(radians(avg(lat))) AS c FROM wpool))
 SELECT qid, arg_min(area_id, struct_pack(d := d, i := area_id)) AS area_id, {r('min(d)')} AS km FROM (SELECT qid, area_id, sqrt(pow(q.x-pr.x,2)+pow(q.y-pr.y,2)) AS d FROM q, pr) z GROUP BY 1""")
def _(v):
    asks = v.plans.select(F.col("plan_id").alias("qid"), F.col("start_lng").alias("lng"), F.col("start_lat").alias("lat"))
    return rnd(neighbors.nearest_to(wpool(v), asks), "km")


@query("knn_enclosed", f"WITH {WPOOL}, {PAIR} SELECT user_id, area_id, {r('hits/8e0')} AS fraction FROM (SELECT plan_id AS user_id, rk.area_id, count(*) AS hits FROM rk JOIN pr ON pr.area_id = nbr_id WHERE rank <= 8 AND k < 70 GROUP BY ALL) z")
def _(v):
    seen = wpool(v).where("k < 70").selectExpr("plan_id AS user_id", "area_id")
    return rnd(neighbors.knn_enclosed(neighbors.knn(wpool(v), 8), seen), "fraction")


@query("category_reward", f"""WITH c AS (SELECT area_id, concat(country_id, ':', level_id, ':', coalesce(CAST(special_group_id AS VARCHAR), 'null')) AS category, lng, lat FROM areas),
 k AS (SELECT category, cos(radians(avg(lat))) AS c, count(*) AS n FROM c GROUP BY 1), p AS (SELECT area_id, category, lng*c*111e0 AS x, lat*111e0 AS y FROM c JOIN k USING (category)),
 m AS (SELECT category, area_id, min(d) AS d FROM (SELECT a.category, a.area_id, sqrt(pow(a.x-b.x,2)+pow(a.y-b.y,2)) AS d FROM p a JOIN p b ON a.category = b.category AND a.area_id <> b.area_id) q GROUP BY ALL),
 s AS (SELECT category, n, coalesce(sum(d), 0e0)/n AS mean_km FROM k LEFT JOIN m USING (category) GROUP BY category, n) SELECT category, n, {r('mean_km')} AS mean_km, {r('greatest(0.1e0, CASE WHEN mean_km > 0 THEN mean_km/10e0 ELSE 1e0 END)')} AS reward FROM s""")
def _(v):
    return rnd(neighbors.category_reward(v.areas), "mean_km", "reward")


def line(v):
    return v.track_points.select(F.col("track_id").alias("plan_id"), "seq", "lng", "lat")


def wished(v):
    """Each plan's wished areas with their points."""
    return v.wishes.join(v.areas.select("area_id", "name", "lng", "lat"), "area_id")


VERT = f"vd AS (SELECT w.plan_id, w.area_id, min({hav('a.lng', 'a.lat', 't.lng', 't.lat')}) AS km FROM wishes w JOIN areas a USING (area_id) JOIN track_points t ON t.track_id = w.plan_id GROUP BY ALL)"
LEG = "lg AS (SELECT track_id, seq, lag(lng) OVER w AS ax, lag(lat) OVER w AS ay, lng AS qx, lat AS qy FROM track_points WINDOW w AS (PARTITION BY track_id ORDER BY seq))"
_T = "greatest(0e0, least(1e0, ((a.lng-ax)*(qx-ax)+(a.lat-ay)*(qy-ay))/((qx-ax)*(qx-ax)+(qy-ay)*(qy-ay))))"
SEGD = f"{LEG}, sd AS (SELECT w.plan_id, w.area_id, min({hav('a.lng', 'a.lat', f'ax+{_T}*(qx-ax)', f'ay+{_T}*(qy-ay)')}) AS km FROM wishes w JOIN areas a USING (area_id) JOIN lg ON lg.track_id = w.plan_id WHERE ax IS NOT NULL GROUP BY ALL)"


@query("min_dist_vertex", f"WITH {VERT} SELECT plan_id, area_id, {r('km')} AS km FROM vd")
def _(v):
    return rnd(neighbors.min_dist(wished(v), line(v)).select("plan_id", "area_id", "km"), "km")


@query("min_dist_segment", f"WITH {SEGD} SELECT plan_id, area_id, {r('km')} AS km FROM sd")
def _(v):
    return rnd(neighbors.min_dist(wished(v), line(v), "segment").select("plan_id", "area_id", "km"), "km")


@query("thin_line", "WITH n AS (SELECT track_id, greatest(1, count(*)//20) AS st FROM track_points GROUP BY 1) SELECT track_id AS plan_id, seq FROM track_points JOIN n USING (track_id) WHERE seq % st = 0")
def _(v):
    return neighbors.thin_line(line(v), 20).select("plan_id", F.col("seq").cast("int").alias("seq"))


ROUTE = "rt AS (SELECT plan_id, pos, lag(lng) OVER w AS ax, lag(lat) OVER w AS ay, lng AS qx, lat AS qy FROM waypoints WINDOW w AS (PARTITION BY plan_id ORDER BY pos))"
COST = hav("ax", "ay", "a.lng", "a.lat") + "+" + hav("a.lng", "a.lat", "qx", "qy") + "-" + hav("ax", "ay", "qx", "qy")
INSERT = f"{ROUTE}, ins AS (SELECT plan_id, area_id, arg_min(pos, struct_pack(c := c, p := pos)) AS pos, min(c) AS detour_km FROM (SELECT w.plan_id, w.area_id, rt.pos, {COST} AS c FROM wishes w JOIN areas a USING (area_id) JOIN rt ON rt.plan_id = w.plan_id WHERE ax IS NOT NULL) q GROUP BY ALL)"


@query("cheapest_insert", f"WITH {INSERT} SELECT plan_id, area_id, pos, {r('detour_km')} AS detour_km FROM ins")
def _(v):
    return rnd(neighbors.cheapest_insert(wished(v), v.waypoints), "detour_km")


_K = "(111.320e0*cos(radians((ay+qy)/2)))"
_TT = f"greatest(0e0, least(1e0, ((t.lng-ax)*{_K}*(qx-ax)*{_K}+(t.lat-ay)*110.574e0*(qy-ay)*110.574e0)/(pow((qx-ax)*{_K},2)+pow((qy-ay)*110.574e0,2))))"


@query("nearest_segment", f"""WITH {ROUTE}, d AS (SELECT t.track_id AS plan_id, t.seq AS qid, rt.pos, sqrt(pow((t.lng-(ax+{_TT}*(qx-ax)))*{_K},2)+pow((t.lat-(ay+{_TT}*(qy-ay)))*110.574e0,2)) AS km FROM track_points t JOIN rt ON rt.plan_id = t.track_id WHERE ax IS NOT NULL)
 SELECT plan_id, qid, {r('min(km)')} AS km FROM d GROUP BY ALL HAVING min(km) <= 1.0""")
def _(v):
    asks = line(v).withColumnRenamed("seq", "qid")
    return rnd(neighbors.nearest_segment(asks, v.waypoints, 1.0).select("plan_id", "qid", "km"), "km")


@query("map_waypoints", f"""WITH c AS (SELECT track_id, cos(radians(avg(lat))) AS c FROM track_points GROUP BY 1), d AS (SELECT p.plan_id, 0 AS pos, t.seq, sqrt(pow((p.start_lng-t.lng)*c*111e0,2)+pow((p.start_lat-t.lat)*111e0,2)) AS km FROM plans p JOIN track_points t ON t.track_id = p.plan_id JOIN c ON c.track_id = p.plan_id
  UNION ALL SELECT w.plan_id, w.pos+1, t.seq, sqrt(pow((w.lng+0.003e0-t.lng)*c*111e0,2)+pow((w.lat-t.lat)*111e0,2)) FROM waypoints w JOIN track_points t ON t.track_id = w.plan_id JOIN c ON c.track_id = w.plan_id)
 SELECT plan_id AS track_id, CAST(pos AS INT) AS pos, CASE WHEN min(km) <= 0.5 THEN arg_min(seq, km) ELSE -1 END AS idx FROM d GROUP BY ALL""")
def _(v):
    starts = v.plans.join(v.track_points.select(F.col("track_id").alias("plan_id")).distinct(), "plan_id").selectExpr("plan_id AS track_id", "0 AS pos", "start_lng AS lng", "start_lat AS lat")
    wps = v.waypoints.selectExpr("plan_id AS track_id", "pos + 1 AS pos", "lng + 0.003D AS lng", "lat")
    out = neighbors.map_waypoints(starts.unionByName(wps), v.track_points)
    return out.select("track_id", "pos", F.col("idx").cast("int").alias("idx"))


@query("presence_check", f"WITH {VERT} SELECT plan_id, {r('min(km)')} AS nearest_km, coalesce(min(km) <= 10, FALSE) AS accepted FROM plans LEFT JOIN vd USING (plan_id) GROUP BY 1")
def _(v):
    return rnd(neighbors.presence_check(v.plans, neighbors.min_dist(wished(v), line(v)), 10.0), "nearest_km")


@query("hole_report", f"""{BASE}, {SEG}, {cover_cte('credit')}, {SEGD}, ms AS (SELECT sd.*, name FROM sd ANTI JOIN (SELECT track_id AS plan_id, area_id FROM cov_credit) c USING (plan_id, area_id) JOIN areas USING (area_id)),
 nm AS (SELECT plan_id, string_agg(concat(name, '(', CAST(floor(km+0.5) AS BIGINT), 'km)'), ',' ORDER BY area_id) AS names FROM (SELECT *, row_number() OVER (PARTITION BY plan_id ORDER BY area_id) AS k FROM ms) q WHERE k <= 60 GROUP BY 1)
 SELECT plan_id, count(*) AS holes, count(*) FILTER (km <= 3) AS near, count(*) FILTER (km > 3 AND km <= 6) AS close, count(*) FILTER (km > 6 AND km <= 15) AS mid, count(*) FILTER (km > 15) AS far, any_value(names) AS names FROM ms JOIN nm USING (plan_id) GROUP BY 1""")
def _(v):
    covered = cov(v, "credit").withColumnRenamed("track_id", "plan_id")
    missed = wished(v).join(covered, ["plan_id", "area_id"], "left_anti")
    dist = neighbors.min_dist(missed, line(v), "segment").select("plan_id", "area_id", F.col("km").alias("dist_km"))
    return coverage.hole_report(dist.join(v.areas.select("area_id", "name"), "area_id"), names=60)
