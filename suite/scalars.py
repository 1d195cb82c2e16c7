"""Scalar functions over whole tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from trackspark.functions import budget, geo, names, tags, tiles

from .registry import half_up, hav, query, r, rnd

Z = 14
PAIR = "(SELECT track_id, seq, lng, lat, lead(lng) OVER w AS nlng, lead(lat) OVER w AS nlat FROM track_points WINDOW w AS (PARTITION BY track_id ORDER BY seq))"


def _pairs(v):
    from trackspark.plans.chunks import with_neighbors

    return with_neighbors(v.track_points, "track_id", "seq", nxt={"nlng": "lng", "nlat": "lat"})


@query("haversine", f"SELECT track_id, seq, {r(hav('lng', 'lat', 'nlng', 'nlat'))} AS km, {r(hav('lng', 'lat', 'nlng', 'nlat') + '*1000')} AS m FROM {PAIR} q")
def _(v):
    d = _pairs(v)
    return rnd(d.select("track_id", "seq", geo.haversine_km("lng", "lat", "nlng", "nlat").alias("km"),
                        geo.haversine_m("lng", "lat", "nlng", "nlat").alias("m")), "km", "m")


@query("planar_km", f"SELECT track_id, seq, {r('sqrt(pow((lng-15e0)*cos(radians(50e0))*111e0,2)+pow((lat-50e0)*111e0,2))')} AS km FROM track_points")
def _(v):
    km = geo.planar_km("lng", "lat", F.lit(15.0), F.lit(50.0), F.cos(F.radians(F.lit(50.0))))
    return rnd(v.track_points.select("track_id", "seq", km.alias("km")), "km")


def _seg_sql(kx: str, ky: str, out: str) -> str:
    """Distance of each leg's end to the segment from (14,49.5) to its start, coordinates scaled qy kx, ky."""
    return f"""WITH s AS (SELECT plan_id, pos, b_lng*{kx} AS px, b_lat*{ky} AS py, 14e0*{kx} AS ax, 49.5e0*{ky} AS ay, a_lng*{kx} AS qx, a_lat*{ky} AS qy, b_lng, b_lat FROM legs),
 t AS (SELECT *, CASE WHEN (qx-ax)*(qx-ax)+(qy-ay)*(qy-ay) <= 1e-12 THEN 0e0 ELSE greatest(0e0, least(1e0, ((px-ax)*(qx-ax)+(py-ay)*(qy-ay))/((qx-ax)*(qx-ax)+(qy-ay)*(qy-ay)))) END AS t FROM s)
 SELECT plan_id, pos, {r(out, 6)} AS d FROM t"""


def _seg(v, fn):
    d = fn("b_lng", "b_lat", F.lit(14.0), F.lit(49.5), "a_lng", "a_lat")
    return rnd(v.legs.select("plan_id", "pos", d.alias("d")), "d", digits=6)


_FLAT = "sqrt(pow(px-(ax+t*(qx-ax)),2)+pow(py-(ay+t*(qy-ay)),2))"


@query("point_segment_km", _seg_sql("(111.320e0*cos(radians((49.5e0+a_lat)/2)))", "110.574e0", _FLAT))
def _(v):
    return _seg(v, geo.point_segment_km)


@query("point_segment_geo_km", _seg_sql("1e0", "1e0", hav("b_lng", "b_lat", "ax+t*(qx-ax)", "ay+t*(qy-ay)")))
def _(v):
    return _seg(v, geo.point_segment_geo_km)


@query("point_segment_deg", _seg_sql("1e0", "1e0", _FLAT))
def _(v):
    return _seg(v, geo.point_segment_deg)


def _shift_sql(f: str, end: str) -> str:
    return f"""WITH d AS (SELECT *, {hav('a_lng', 'a_lat', 'b_lng', 'b_lat')}*1000 AS m, 500e0*pos AS step FROM legs)
 SELECT plan_id, pos, {r(f'CASE WHEN {end} THEN b_lng ELSE a_lng+(b_lng-a_lng)*{f} END', 7)} AS lng, {r(f'CASE WHEN {end} THEN b_lat ELSE a_lat+(b_lat-a_lat)*{f} END', 7)} AS lat FROM d"""


def _shift(v, fn):
    p = fn("a_lng", "a_lat", "b_lng", "b_lat", F.lit(500.0) * F.col("pos"))
    return rnd(v.legs.withColumn("p", p).select("plan_id", "pos", "p.lng", "p.lat"), "lng", "lat", digits=7)


@query("move_towards", _shift_sql("(step/m)", "m <= step OR m < 1e-6"))
def _(v):
    return _shift(v, geo.move_towards)


@query("extend_beyond", _shift_sql("((m+step)/m)", "m < 1e-6"))
def _(v):
    return _shift(v, geo.extend_beyond)


FX = "((lng+180e0)/360e0*16384e0)"
FY = "((1e0-ln(tan(radians(lat))+1e0/cos(radians(lat)))/pi())/2e0*16384e0)"
TX, TY = f"CAST(greatest(0, least(16383, floor({FX}))) AS BIGINT)", f"CAST(greatest(0, least(16383, floor({FY}))) AS BIGINT)"


@query("tile_xy", f"SELECT track_id, seq, {TX} AS x, {TY} AS y FROM track_points")
def _(v):
    x, y = tiles.tile_xy("lng", "lat", Z)
    return v.track_points.select("track_id", "seq", x.alias("x"), y.alias("y"))


@query("frac_tile", f"SELECT track_id, seq, {r(FX, 6)} AS fx, {r(FY, 6)} AS fy FROM track_points")
def _(v):
    x, y = tiles.frac_tile("lng", "lat", Z)
    return rnd(v.track_points.select("track_id", "seq", x.alias("fx"), y.alias("fy")), "fx", "fy", digits=6)


def _lat(y):
    return f"degrees(atan(sinh(pi()*(1e0-2e0*({y})/16384e0))))"


def _lng(x):
    return f"(({x})/16384e0*360e0-180e0)"


TILE = f"(SELECT DISTINCT {TX} AS x, {TY} AS y FROM track_points)"


def _tiles(v):
    x, y = tiles.tile_xy("lng", "lat", Z)
    return v.track_points.select(x.alias("x"), y.alias("y")).distinct()


@query("tile_bbox_center", f"""SELECT x, y, {r(_lng('x'), 7)} AS min_lng, {r(_lat('y+1'), 7)} AS min_lat, {r(_lng('x+1'), 7)} AS max_lng, {r(_lat('y'), 7)} AS max_lat,
 {r(f"({_lng('x')}+{_lng('x+1')})/2e0", 7)} AS c_lng, {r(f"({_lat('y')}+{_lat('y+1')})/2e0", 7)} AS c_lat FROM {TILE} t""")
def _(v):
    d = _tiles(v).withColumns({"b": tiles.tile_bbox("x", "y", Z), "c": tiles.tile_center("x", "y", Z)})
    d = d.select("x", "y", "b.*", F.col("c.lng").alias("c_lng"), F.col("c.lat").alias("c_lat"))
    return rnd(d, "min_lng", "min_lat", "max_lng", "max_lat", "c_lng", "c_lat", digits=7)


@query("tile_ring", f"""WITH t AS (SELECT * FROM {TILE} t), c AS (SELECT * FROM (VALUES (0,0,0),(1,1,0),(2,1,1),(3,0,1),(4,0,0)) c(i,dx,dy))
 SELECT x, y, i, {r(_lng('x+dx'), 7)} AS lng, {r(_lat('y+dy'), 7)} AS lat FROM t, c""")
def _(v):
    d = _tiles(v).select("x", "y", F.posexplode(tiles.tile_ring("x", "y", Z)).alias("i", "p")).select("x", "y", "i", "p.lng", "p.lat")
    return rnd(d, "lng", "lat", digits=7)


@query("tile_key", f"SELECT DISTINCT x*131072+y AS tile_key, x AS kx, y AS ky FROM {TILE} t")
def _(v):
    d = _tiles(v).select(tiles.tile_key("x", "y").alias("tile_key"))
    return d.select("tile_key", tiles.key_x("tile_key").alias("kx"), tiles.key_y("tile_key").alias("ky"))


@query("hilbert_key", f"""WITH RECURSIVE b AS (SELECT min(lng) AS x0, max(lng) AS x1, min(lat) AS y0, max(lat) AS y1 FROM areas),
 h(area_id, x, y, d, s) AS (SELECT area_id, {half_up('(lng-x0)/(x1-x0)*65535e0')}, {half_up('(lat-y0)/(y1-y0)*65535e0')}, 0::BIGINT, 32768::BIGINT FROM areas, b
  UNION ALL SELECT area_id, CASE WHEN (y & s) = 0 THEN CASE WHEN (x & s) > 0 THEN 65535-y ELSE y END ELSE x END, CASE WHEN (y & s) = 0 THEN CASE WHEN (x & s) > 0 THEN 65535-x ELSE x END ELSE y END,
   d + s*s*xor(CASE WHEN (x & s) > 0 THEN 3 ELSE 0 END, CASE WHEN (y & s) > 0 THEN 1 ELSE 0 END), s // 2 FROM h WHERE s > 0)
 SELECT area_id, CAST(d AS BIGINT) AS hkey FROM h WHERE s = 0""")
def _(v):
    from trackspark.operators.areas import bbox

    b = bbox(v.areas)
    d = v.areas.withColumns({c: b.select(c).scalar() for c in b.columns})
    return d.select("area_id", geo.hilbert_key("lng", "lat", *b.columns).alias("hkey"))


DEM = "concat(CASE WHEN floor(lat) >= 0 THEN 'N' ELSE 'S' END, lpad(CAST(abs(CAST(floor(lat) AS INT)) AS VARCHAR), 2, '0'), CASE WHEN floor(lng) >= 0 THEN 'E' ELSE 'W' END, lpad(CAST(abs(CAST(floor(lng) AS INT)) AS VARCHAR), 3, '0'))"
SHIFTED = "(SELECT track_id, seq, (lng-16)*30 AS lng, (lat-50)*60 AS lat FROM track_points)"


def _spread(v):
    """Track points stretched over both hemispheres."""
    return v.track_points.selectExpr("track_id", "seq", "(lng-16)*30 AS lng", "(lat-50)*60 AS lat")


@query("dem_tile_name", f"SELECT name, CAST(floor(lat) AS INT) AS tile_lat, CAST(floor(lng) AS INT) AS tile_lng, count(*) AS n FROM (SELECT *, {DEM} AS name FROM {SHIFTED} s) q GROUP BY ALL")
def _(v):
    d = _spread(v).withColumn("name", names.dem_tile_name(F.floor("lng"), F.floor("lat"))).withColumn("t", names.parse_dem_tile(F.concat("name", F.lit(".hgt"))))
    return d.groupBy("name", "t.tile_lat", "t.tile_lng").agg(F.count("*").alias("n"))


PARSED = "CAST(regexp_extract(name, '^([EW])([0-9]+)_([NS])([0-9]+)$', 2) AS INT) * CASE WHEN name[1] = 'W' THEN -1 ELSE 1 END"
PARSED_LAT = "CAST(regexp_extract(name, '^([EW])([0-9]+)_([NS])([0-9]+)$', 4) AS INT) * CASE WHEN contains(name, 'S') THEN -1 ELSE 1 END"


@query("parse_segment", f"SELECT name, {PARSED} AS lng, {PARSED_LAT} AS lat FROM seg_remote")
def _(v):
    return v.seg_remote.withColumn("p", names.parse_segment(F.concat("name", F.lit(".rd5")))).select("name", "p.lng", "p.lat")


@query("in_europe", "SELECT track_id, seq, lng >= -15 AND lng <= 45 AND lat >= 30 AND lat <= 72 AS inside FROM " + SHIFTED + " s")
def _(v):
    return _spread(v).select("track_id", "seq", names.in_europe("lng", "lat").alias("inside"))


@query("is_outdated", "SELECT name, r.size_bytes AS remote_size, i.size_bytes AS installed_size, coalesce(r.size_bytes <> i.size_bytes, FALSE) AS outdated FROM seg_remote r FULL JOIN seg_installed i USING (name)")
def _(v):
    j = v.seg_remote.withColumnRenamed("size_bytes", "remote_size").join(v.seg_installed.withColumnRenamed("size_bytes", "installed_size"), "name", "full_outer")
    return j.select("name", "remote_size", "installed_size", names.is_outdated("remote_size", "installed_size").alias("outdated"))


def _tag_sql(key):
    return f"nullif(regexp_extract(concat(' ', way_tags, ' '), ' {key}=([^ ]*) ', 1), '')"


@query("tag_value", f"SELECT track_id, row_no, {_tag_sql('highway')} AS highway, {_tag_sql('bicycle')} AS bicycle, {_tag_sql('ref')} AS ref_tag FROM messages")
def _(v):
    return v.messages.select("track_id", "row_no", *[tags.tag_value("way_tags", k).alias(a) for k, a in (("highway", "highway"), ("bicycle", "bicycle"), ("ref", "ref_tag"))])


@query("classify_surface", f"SELECT track_id, row_no, coalesce(lower({_tag_sql('surface')}), 'unknown') AS surface, coalesce(lower({_tag_sql('smoothness')}), 'unknown') AS smoothness FROM messages")
def _(v):
    return v.messages.select("track_id", "row_no", tags.classify_surface(tags.tag_value("way_tags", "surface")).alias("surface"),
                             tags.classify_smoothness(tags.tag_value("way_tags", "smoothness")).alias("smoothness"))


ROAD = f"""(SELECT *, {_tag_sql('highway')} AS hw, coalesce({_tag_sql('bicycle')}, '') AS bi, coalesce({_tag_sql('foot')}, '') AS fo, coalesce({_tag_sql('cycleway')}, '') AS cy,
 trim(regexp_extract(coalesce({_tag_sql('ref')}, ''), '^[^;,]*')) AS rf FROM messages)"""
ROAD_CASE = """CASE WHEN hw IS NULL THEN 'unknown' WHEN hw = 'cycleway' THEN CASE WHEN fo IN ('designated','yes','permissive') THEN 'cycleway_shared_foot' ELSE 'cycleway' END
 WHEN hw = 'path' THEN concat('path', CASE WHEN bi = 'designated' AND fo = 'designated' THEN '_bike_foot' WHEN bi = 'designated' THEN '_bike' WHEN fo = 'designated' THEN '_foot' ELSE '' END)
 WHEN hw IN ('footway','pedestrian') THEN concat(hw, CASE WHEN bi IN ('designated','yes','permissive') THEN '_bike_allowed' ELSE '' END)
 WHEN hw IN ('track','bridleway','steps') THEN hw
 ELSE concat(CASE WHEN hw LIKE '%_link' THEN hw[:-6] ELSE hw END, CASE WHEN bi = 'use_sidepath' THEN '_use_sidepath' WHEN cy IN ('track','lane') THEN '_with_cycleway_lane' ELSE '' END, CASE WHEN rf <> '' THEN concat(':', rf) ELSE '' END) END"""


@query("classify_road", f"SELECT track_id, row_no, {ROAD_CASE} AS road FROM {ROAD} q")
def _(v):
    return v.messages.select("track_id", "row_no", tags.road_of_tags("way_tags").alias("road"))


@query("is_tunnel_or_bridge", "SELECT track_id, row_no, regexp_matches(way_tags, '(^| )(tunnel|bridge)=') AND NOT regexp_matches(way_tags, '(tunnel|bridge)=no') AS flat FROM messages")
def _(v):
    return v.messages.select("track_id", "row_no", tags.is_tunnel_or_bridge("way_tags").alias("flat"))


@query("category_key", "SELECT area_id, concat(country_id, ':', level_id, ':', coalesce(CAST(special_group_id AS VARCHAR), 'null')) AS category, concat('C', country_id, CASE WHEN special_group_id IS NULL THEN concat('/L', level_id) ELSE concat('/sg', special_group_id) END) AS label FROM areas")
def _(v):
    d = v.areas.withColumn("category", names.category_key("country_id", "level_id", "special_group_id"))
    return d.select("area_id", "category", names.format_category("category").alias("label"))


@query("leg_key", "SELECT plan_id, pos, printf('%.5f,%.5f>%.5f,%.5f', a_lng, a_lat, b_lng, b_lat) AS k FROM legs")
def _(v):
    return v.legs.select("plan_id", "pos", names.leg_key("a_lng", "a_lat", "b_lng", "b_lat").alias("k"))


@query("effort_km", f"SELECT plan_id, pos, {r('km+0.1e0*climb_m')} AS effort FROM legs")
def _(v):
    return rnd(v.legs.select("plan_id", "pos", budget.effort_km("km", "climb_m").alias("effort")), "effort")


SCORED = "(SELECT draft_id, distance_km AS d, draft_id % 4 = 0 AS hit FROM drafts)"


@query("corridor_distance", f"SELECT draft_id, {r('CASE WHEN hit THEN 0e0 ELSE greatest(0e0, (d-0.2e0)/2) END', 7)} AS km FROM {SCORED} q")
def _(v):
    return rnd(v.drafts.select("draft_id", budget.corridor_distance_km(F.col("draft_id") % 4 == 0, "distance_km").alias("km")), "km", digits=7)


@query("detour_score", f"SELECT draft_id, {r('CASE WHEN hit THEN 0e0 ELSE 2*d+0.2e0 END', 7)} AS km FROM {SCORED} q")
def _(v):
    return rnd(v.drafts.select("draft_id", budget.detour_score(F.col("draft_id") % 4 == 0, "distance_km").alias("km")), "km", digits=7)


FORM = """(SELECT *, plan_id % 7 <> 0 AS has_country, plan_id % 6 <> 0 AS has_level, plan_id % 4 = 1 AS has_group FROM plans)"""
OPEN_END = "days > 0 AND coalesce(km_per_day, 0) > 0 AND (is_loop OR end_lng IS NOT NULL)"


def forms(v):
    """Plans as request forms with list fields."""
    p = v.plans
    return p.select(
        "*", F.struct(F.col("start_lng").alias("lng"), F.col("start_lat").alias("lat")).alias("start"),
        F.when(F.col("end_lng").isNotNull(), F.struct(F.col("end_lng").alias("lng"), F.col("end_lat").alias("lat"))).alias("end"),
        F.when(F.col("plan_id") % 7 != 0, F.expr("array(1, 2)")).alias("countries"),
        F.when(F.col("plan_id") % 6 != 0, F.expr("array(4, 4)")).alias("levels"),
        F.when(F.col("plan_id") % 4 == 1, F.expr("array(9)")).alias("groups"),
    )


@query("ready_to_calculate", f"""SELECT plan_id, CASE intent WHEN 'COVERAGE' THEN {OPEN_END} AND has_country AND (has_level OR has_group)
 WHEN 'AB' THEN days > 0 AND coalesce(km_per_day, 0) > 0 AND end_lng IS NOT NULL ELSE {OPEN_END} END AS ready FROM {FORM} q""")
def _(v):
    ready = budget.ready_to_calculate("intent", "start", "end", "is_loop", "days", "km_per_day", "countries", "levels", "groups")
    return forms(v).select("plan_id", ready.alias("ready"))


def patches(v):
    """A form patch per plan: some fields set to the stored value, some changed, some absent."""
    f = forms(v)
    cur = F.struct("countries", "levels", "groups", "is_loop", "start", "end", F.expr("array(start, start)").alias("via")).alias("cur")
    m = F.col("plan_id") % 8
    patch = F.struct(
        F.when(m == 0, F.expr("array(1, 2)")).alias("countries"), F.when(m == 1, F.expr("array(5)")).alias("levels"),
        F.expr("CAST(NULL AS ARRAY<INT>)").alias("groups"), F.when(m == 2, F.col("is_loop")).alias("is_loop"),
        F.when(m == 3, F.col("start")).when(m == 4, F.expr("struct(start.lng + 1 AS lng, start.lat AS lat)")).alias("start"),
        F.when(m == 5, F.col("end")).alias("end"),
        F.when(m == 6, F.expr("array(start, struct(start.lng AS lng, start.lat + plan_id % 3 AS lat))")).alias("via"),
        (m == 7).alias("clear_start"), F.lit(False).alias("clear_end"),
    ).alias("patch")
    return f.select("plan_id", cur, patch)


@query("shape_changed", "SELECT plan_id, CASE plan_id % 8 WHEN 0 THEN plan_id % 7 = 0 WHEN 1 THEN TRUE WHEN 4 THEN TRUE WHEN 6 THEN plan_id % 3 <> 0 WHEN 7 THEN TRUE ELSE FALSE END AS changed FROM plans")
def _(v):
    return patches(v).select("plan_id", budget.shape_changed("cur", "patch").alias("changed"))


@query("fail_reason", "SELECT plan_id, pos, CASE WHEN error LIKE '%island%' THEN 'target-island' WHEN error LIKE '%not found%' THEN 'not-mapped' END AS reason FROM legs")
def _(v):
    return v.legs.select("plan_id", "pos", names.fail_reason(F.upper("error")).alias("reason"))


@query("error_fields", "SELECT plan_id, pos, nullif(regexp_extract(error, 'datafile ([A-Z0-9_]+).rd5', 1), '') AS tile, TRY_CAST(regexp_extract(error, 'section ([0-9]+)', 1) AS INT) AS section_no FROM legs")
def _(v):
    return v.legs.select("plan_id", "pos", names.missing_tile("error").alias("tile"), names.island_section("error").alias("section_no"))


PHASE = "concat(CASE k % 4 WHEN 0 THEN 'Baseline' WHEN 1 THEN 'round0-batch' WHEN 2 THEN 'fin-grow-real' ELSE 'anchor' END, CAST(k AS STRING))"


@query("coarse_phase", f"SELECT track_id, seq, {PHASE} AS phase, CASE k % 4 WHEN 0 THEN 'BASELINE' WHEN 1 THEN 'GROWING' WHEN 2 THEN 'GROWING' ELSE 'SMOOTHING' END AS coarse FROM track_points")
def _(v):
    d = v.track_points.selectExpr("track_id", "seq", f"{PHASE} AS phase")
    return d.withColumn("coarse", names.coarse_phase("phase"))


@query("microdegrees", f"SELECT track_id, seq, {half_up('(lng+180e0)*1e6')} AS ilng, {half_up('(lat+90e0)*1e6')} AS ilat, {r('lng', 6)} AS lng, {r('lat', 6)} AS lat FROM track_points")
def _(v):
    a, b = geo.to_microdeg("lng", "lat")
    d = v.track_points.select("track_id", "seq", a.alias("ilng"), b.alias("ilat"))
    x, y = geo.from_microdeg("ilng", "ilat")
    return rnd(d.withColumns({"lng": x, "lat": y}), "lng", "lat", digits=6)


TRIP = "(SELECT p.*, coalesce(d.km, 0e0) AS km, coalesce(d.gain, 0) AS gain FROM plans p LEFT JOIN (SELECT user_id AS plan_id, sum(distance_km) AS km, CAST(sum(elevation_gain) AS BIGINT) AS gain FROM drafts GROUP BY user_id) d USING (plan_id))"


def trips(v):
    d = v.drafts.groupBy(F.col("user_id").alias("plan_id")).agg(F.sum("distance_km").alias("km"), F.sum("elevation_gain").alias("gain"))
    return v.plans.join(d, "plan_id", "left").fillna({"km": 0.0, "gain": 0})


@query("baseline_verdict", f"SELECT plan_id, CASE WHEN km_per_day > 0 AND floor(km+0.5e0) > days*km_per_day*1.05e0 THEN 'BUDGET_IMPOSSIBLE' ELSE 'OK' END AS verdict FROM {TRIP} q")
def _(v):
    return trips(v).select("plan_id", budget.baseline_verdict("km", "days", "km_per_day").alias("verdict"))


BUDGET = "(days*(coalesce(km_per_day,200)+0.1e0*CASE WHEN elev_per_day > 0 THEN elev_per_day ELSE greatest(300e0, coalesce(km_per_day,200)*1000e0/180e0) END))"


@query("budget_fit", f"""SELECT plan_id, {r(BUDGET)} AS budget, CASE WHEN (km+0.1e0*gain)/{BUDGET} > 1.05 THEN 'OVER' WHEN (km+0.1e0*gain)/{BUDGET} < 0.95 THEN 'UNDER' ELSE 'OK' END AS fit FROM {TRIP} q""")
def _(v):
    d = trips(v).withColumn("budget", budget.budget_effort("days", "km_per_day", "elev_per_day"))
    return rnd(d.select("plan_id", "budget", budget.budget_fit(budget.effort_km("km", "gain"), "budget").alias("fit")), "budget")


@query("total_limit", f"SELECT plan_id, {r('(coalesce(km_per_day,200)+0.1e0*coalesce(elev_per_day,0))*days')} AS limit_km FROM plans")
def _(v):
    return rnd(v.plans.select("plan_id", budget.total_limit("days", "km_per_day", "elev_per_day").alias("limit_km")), "limit_km")


MARGIN = "greatest(5e0, least(40e0, 0.15e0*days*coalesce(km_per_day,100)))"
BOXED = f"(SELECT *, {MARGIN} AS m, least(start_lng, coalesce(end_lng, start_lng)) AS x0, greatest(start_lng, coalesce(end_lng, start_lng)) AS x1, least(start_lat, coalesce(end_lat, start_lat)) AS y0, greatest(start_lat, coalesce(end_lat, start_lat)) AS y1 FROM plans)"
_DX = "m/(110.574e0*greatest(0.05e0, cos(radians((y0+y1)/2))))"


@query("corridor_box", f"SELECT plan_id, {r('m')} AS margin_km, {r(f'x0-{_DX}', 6)} AS min_lng, {r('y0-m/110.574e0', 6)} AS min_lat, {r(f'x1+{_DX}', 6)} AS max_lng, {r('y1+m/110.574e0', 6)} AS max_lat FROM {BOXED} q")
def _(v):
    e = {c: F.coalesce(F.col("end_" + c), F.col("start_" + c)) for c in ("lng", "lat")}
    d = v.plans.withColumn("margin_km", budget.corridor_margin_km("days", "km_per_day"))
    box = budget.corridor_box(F.least("start_lng", e["lng"]), F.least("start_lat", e["lat"]), F.greatest("start_lng", e["lng"]), F.greatest("start_lat", e["lat"]), "margin_km")
    d = d.withColumn("b", box).select("plan_id", "margin_km", "b.*")
    return rnd(rnd(d, "margin_km"), "min_lng", "min_lat", "max_lng", "max_lat", digits=6)


@query("reach_and_detour", f"SELECT plan_id, {r('greatest(22e0, 0.2e0*coalesce(km_per_day,100))')} AS reach_km, {r('3e0*distance_side')} AS detour_km FROM (SELECT *, 1.5e0+days/10.0e0 AS distance_side FROM plans) q")
def _(v):
    d = v.plans.select("plan_id", budget.reach_cap_km("km_per_day").alias("reach_km"), budget.max_detour_km(F.lit(1.5) + F.col("days") / 10.0).alias("detour_km"))
    return rnd(d, "reach_km", "detour_km")


@query("draft_names", "SELECT draft_id, regexp_replace(n, '[^A-Za-z0-9._-]', '_', 'g') AS safe, trim(n) <> '' AND length(n) <= 255 AS valid FROM (SELECT draft_id, CASE WHEN draft_id % 9 = 0 THEN '  ' WHEN draft_id % 10 = 0 THEN repeat('x', 256) ELSE concat(name, ' / Dzień') END AS n FROM drafts) q")
def _(v):
    n = F.when(F.col("draft_id") % 9 == 0, "  ").when(F.col("draft_id") % 10 == 0, F.repeat(F.lit("x"), 256)).otherwise(F.concat("name", F.lit(" / Dzień")))
    return v.drafts.select("draft_id", names.safe_file_name(n).alias("safe"), names.valid_name(n).alias("valid"))


@query("linear_interp", f"SELECT draft_id, {r('CASE WHEN x <= 100e0 THEN 5e0 WHEN x >= 400e0 THEN 80e0 ELSE 5e0+(x-100e0)/300e0*75e0 END', 7)} AS z FROM (SELECT draft_id, distance_km AS x FROM drafts) q")
def _(v):
    x = F.col("distance_km")
    lo, hi = F.when(x >= 100.0, F.lit(100.0)), F.when(x < 400.0, F.lit(400.0))
    at = geo.linear_interp(F.when(x >= 400, F.lit(400.0)).otherwise(lo), F.when(x >= 400, F.lit(80.0)).when(x >= 100, F.lit(5.0)), hi, F.when(x < 100, F.lit(5.0)).otherwise(80.0), x)
    return rnd(v.drafts.select("draft_id", at.alias("z")), "z", digits=7)
