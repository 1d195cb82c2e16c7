"""Views over the given tables, once as DataFrames and once as DuckDB text."""

from __future__ import annotations

import os
import re
from functools import cached_property
from urllib.parse import urlparse

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from trackspark.plans.chunks import dense_rank_rows, with_neighbors
from trackspark.plans.lineage import materialize

TABLES = ["customer", "supplier", "part", "orders", "events", "pages"]
NUM = "regexp_extract(props,'([0-9]+)',1)"

LNG = "14.0e0 + 4.0e0*event_id/{n} + ((event_id % 11) - 5)/1000.0e0"
LAT = f"49.5e0 + 0.05e0*(user_id % 20) + (CAST({NUM} AS INT) - 50)/2000.0e0"
TAGS = """concat('highway=', CASE k % 6 WHEN 0 THEN 'primary' WHEN 1 THEN 'cycleway' WHEN 2 THEN 'path' WHEN 3 THEN 'footway' WHEN 4 THEN 'secondary_link' ELSE 'track' END,
    CASE WHEN k % 4 = 0 THEN '' ELSE concat(' surface=', CASE k % 3 WHEN 0 THEN 'Asphalt' WHEN 1 THEN 'gravel' ELSE 'sett' END) END,
    CASE k % 5 WHEN 0 THEN ' bicycle=designated' WHEN 1 THEN ' bicycle=use_sidepath' WHEN 2 THEN ' cycleway=lane' ELSE '' END,
    CASE WHEN k % 7 = 0 THEN ' foot=designated' ELSE '' END, CASE WHEN k % 9 = 0 THEN ' tunnel=yes' WHEN k % 11 = 0 THEN ' bridge=no' ELSE '' END,
    CASE WHEN k % 6 = 0 THEN ' ref=DK7;E40' ELSE '' END, CASE WHEN k % 8 = 0 THEN ' smoothness=good' ELSE '' END)"""
SEG = "concat(CASE WHEN {a} < 0 THEN 'W' ELSE 'E' END, CAST(abs({a}) AS STRING), '_', CASE WHEN {b} < 0 THEN 'S' ELSE 'N' END, CAST(abs({b}) AS STRING))"

# Text that both engines run unchanged.
SHARED = {
    "messages": f"""SELECT track_id, seq AS row_no, CAST(floor(lng*1000000+0.5e0) AS BIGINT) AS key_lng, CAST(floor(lat*1000000+0.5e0) AS BIGINT) AS key_lat,
  CAST(floor(value*10) AS BIGINT) AS dist_m, {TAGS} AS way_tags FROM track_points WHERE seq > 0""",
    "calls": "SELECT event_id AS call_no, event_type AS reason, CAST(floor(value*10) AS BIGINT) AS ms, ts FROM events",
    "plans": """SELECT c_custkey AS plan_id, CASE c_custkey % 4 WHEN 0 THEN 'COVERAGE' WHEN 1 THEN 'AB' WHEN 2 THEN 'FREESTYLE' ELSE 'TILES' END AS intent,
  14.0e0 + (c_custkey % 40)/10.0e0 AS start_lng, 49.6e0 + (c_custkey % 9)/10.0e0 AS start_lat,
  CASE WHEN c_custkey % 5 <> 0 THEN 14.3e0 + (c_custkey % 37)/10.0e0 END AS end_lng, CASE WHEN c_custkey % 5 <> 0 THEN 49.7e0 + (c_custkey % 7)/10.0e0 END AS end_lat,
  c_custkey % 5 = 0 AS is_loop, CAST(1 + c_custkey % 12 AS INT) AS days, CAST(CASE WHEN c_custkey % 11 = 0 THEN NULL ELSE 40 + c_custkey % 90 END AS INT) AS km_per_day,
  CAST(CASE WHEN c_custkey % 3 = 0 THEN NULL ELSE 300 + c_custkey % 900 END AS INT) AS elev_per_day FROM customer""",
    "drafts": """SELECT o_orderkey AS draft_id, o_custkey AS user_id, concat('Trip ', CAST(o_orderkey % 40 AS STRING)) AS name, CAST(floor(o_orderkey/5.0e0) AS BIGINT) AS group_id,
  CAST(o_orderkey % 5 + 1 AS INT) AS day_number, o_totalprice/1000.0e0 AS distance_km, CAST(o_orderkey % 2000 AS INT) AS elevation_gain, o_orderdate AS updated_at FROM orders""",
    "plan_tasks": """SELECT o_orderkey AS task_id, o_custkey AS user_id, CASE o_orderstatus WHEN 'F' THEN 'COMPLETED' WHEN 'O' THEN 'RUNNING' ELSE 'FAILED' END AS status,
  o_orderdate AS started_at FROM orders""",
    "seg_remote": "SELECT " + SEG.format(a="a", b="b") + """ AS name, CAST(sum(p_size) AS BIGINT) AS size_bytes
  FROM (SELECT CAST(5*((p_partkey % 72) - 36) AS INT) AS a, CAST(5*(CAST(floor(p_partkey/72.0e0) AS BIGINT) % 36 - 18) AS INT) AS b, p_size FROM part) q GROUP BY a, b""",
    "seg_installed": "SELECT " + SEG.format(a="a", b="b") + """ AS name, CAST(sum(s_nationkey*2) AS BIGINT) AS size_bytes
  FROM (SELECT CAST(5*((s_suppkey*7) % 72 - 36) AS INT) AS a, CAST(5*((s_suppkey*5) % 36 - 18) AS INT) AS b, s_nationkey FROM supplier) q GROUP BY a, b""",
}

DUCK = {
    "ev_n": "SELECT count(*) AS n FROM events",
    "grid": "SELECT count(*) AS n, CAST(ceil(sqrt(2.8e0*count(*))) AS BIGINT) AS w, 4.2e0/ceil(sqrt(2.8e0*count(*))) AS p FROM customer",
    "track_points": f"""SELECT user_id AS track_id, CAST(row_number() OVER (PARTITION BY user_id ORDER BY event_id) - 1 AS INT) AS seq, event_id, ts,
  {LNG.format(n='ev_n.n')} AS lng, {LAT} AS lat, CAST({NUM} AS INT) AS k, value, event_type FROM events, ev_n""",
    "areas": """SELECT id AS area_id, concat('A', CAST(id AS STRING)) AS name, c_lng + CASE WHEN id % 10 = 0 THEN 0.65e0*half_deg ELSE 0e0 END AS lng,
  c_lat + CASE WHEN id % 10 = 0 THEN 0.65e0*half_deg ELSE 0e0 END AS lat, half_deg, c_lng, c_lat, CASE WHEN 2*(id % w) < w THEN 1 ELSE 2 END AS country_id, 4 AS level_id,
  CAST(CASE WHEN id % 37 = 0 THEN 9 END AS INT) AS special_group_id, id % 10 = 0 AS holed
  FROM (SELECT c_custkey AS id, w, p/2 AS half_deg, 13.90037e0 + p*(c_custkey % w + 0.5e0) AS c_lng, 49.30041e0 + p*(floor(c_custkey/CAST(w AS DOUBLE)) + 0.5e0) AS c_lat FROM customer, grid) q
  UNION ALL SELECT n + id, concat('C', CAST(id AS STRING)), c_lng, c_lat, half_deg, c_lng, c_lat, CASE WHEN 2*(id % w) < w THEN 1 ELSE 2 END, 4, CAST(NULL AS INT), FALSE
  FROM (SELECT c_custkey AS id, n, w, 0.18e0*p AS half_deg, 13.90037e0 + p*(c_custkey % w + 0.5e0) AS c_lng, 49.30041e0 + p*(floor(c_custkey/CAST(w AS DOUBLE)) + 0.5e0) AS c_lat FROM customer, grid WHERE c_custkey % 10 = 0) q""",
    "area_vertices": """SELECT a.area_id, 0 AS part_no, r.ring_no, c.v, a.c_lng + c.sx*CASE WHEN r.ring_no = 0 THEN a.half_deg ELSE 0.4e0*a.half_deg END AS lng,
  a.c_lat + c.sy*CASE WHEN r.ring_no = 0 THEN a.half_deg ELSE 0.4e0*a.half_deg END AS lat
  FROM areas a CROSS JOIN (SELECT 0 AS ring_no UNION ALL SELECT 1) r
  CROSS JOIN (SELECT 0 AS v, -1 AS sx, -1 AS sy UNION ALL SELECT 1, 1, -1 UNION ALL SELECT 2, 1, 1 UNION ALL SELECT 3, -1, 1) c WHERE r.ring_no = 0 OR a.holed""",
    "visits": "SELECT DISTINCT user_id, (event_id*7 + k) % g.n AS area_id FROM events, (SELECT max(n) AS n FROM grid) g, range(10) t(k)",
    "wishes": "SELECT DISTINCT user_id AS plan_id, (event_id*7) % grid.n AS area_id FROM events, grid",
    "waypoints": """SELECT track_id AS plan_id, CAST(row_number() OVER (PARTITION BY track_id ORDER BY seq) - 1 AS INT) AS pos, seq, lng, lat, k FROM track_points WHERE event_type = 'signup'""",
    "legs": """SELECT plan_id, pos, a_lng, a_lat, lng AS b_lng, lat AS b_lat, CASE WHEN (plan_id + pos) % 13 = 0 THEN concat('target island detected for section ', CAST(pos AS STRING))
    WHEN (plan_id + pos) % 17 = 0 THEN 'datafile E15_N45.rd5 not found' END AS error,
    CASE WHEN (plan_id + pos) % 13 <> 0 AND (plan_id + pos) % 17 <> 0 THEN 20.0e0 + k END AS km, CASE WHEN (plan_id + pos) % 13 <> 0 AND (plan_id + pos) % 17 <> 0 THEN 5.0e0*k END AS climb_m
  FROM (SELECT *, lag(lng) OVER (PARTITION BY plan_id ORDER BY pos) AS a_lng, lag(lat) OVER (PARTITION BY plan_id ORDER BY pos) AS a_lat FROM waypoints) q WHERE a_lng IS NOT NULL""",
    "dem_n": "SELECT CAST(ceil(sqrt(count(*)/12.0e0)) AS INT) AS n FROM orders",
    "dem_cells": """SELECT CAST(49 + floor(o_orderkey/(6.0e0*n*n)) AS INT) AS tile_lat, CAST(13 + floor((o_orderkey % (6*n*n))/CAST(n*n AS DOUBLE)) AS INT) AS tile_lng, n,
  CAST(floor((o_orderkey % (n*n))/CAST(n AS DOUBLE)) AS INT) AS r, CAST(o_orderkey % n AS INT) AS c,
  CAST(CASE WHEN o_orderkey % 97 <> 0 THEN 200 + floor(o_totalprice/1000.0e0) END AS INT) AS ele FROM orders, dem_n""",
    **SHARED,
}



def with_views(sql: str) -> str:
    """Prefix DuckDB text with the views it names, each defined once and in order."""
    needed: list[str] = []

    def add(text: str) -> None:
        for name in DUCK:
            if re.search(rf"\b{name}\b", text) and name not in needed:
                add_name(name)

    def add_name(name: str) -> None:
        body = DUCK[name]
        for dep in DUCK:
            if dep != name and dep not in needed and re.search(rf"\b{dep}\b", body):
                add_name(dep)
        if name not in needed:
            needed.append(name)

    add(sql)
    if not needed:
        return sql
    ctes = ",\n".join(f"{n} AS ({DUCK[n]})" for n in needed)
    body = sql.lstrip()
    if body[:15].upper() == "WITH RECURSIVE ":
        return f"WITH RECURSIVE {ctes},\n{body[15:]}"
    if body[:5].upper() == "WITH ":
        return f"WITH {ctes},\n{body[5:]}"
    return f"WITH {ctes}\n{body}"


_STORED: dict[tuple[str, str, str], DataFrame] = {}


def _present(made) -> bool:
    """Whether the files of a stored table are still there (scratch folders get cleared)."""
    frames = [made] if isinstance(made, DataFrame) else [made.geoms, made.cells, made.near]
    files = [urlparse(f) for df in frames for f in df.inputFiles()]
    return all(os.path.exists(f.path) for f in files if f.scheme == "file")


class Views:
    """DataFrames of one table folder.

    The track, area and way-point tables that the operators take as input are derived once per Spark application
    and kept as parquet tables; everything else is lazy.
    """

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder

    def once(self, name: str, make):
        """An input built once per Spark application and folder."""
        key = (self.spark.sparkContext.applicationId, self.folder, name)
        if key not in _STORED or not _present(_STORED[key]):
            _STORED[key] = make()
        return _STORED[key]

    def stored(self, name: str, df) -> DataFrame:
        return self.once(name, lambda: materialize(df(), name, spread=True))

    def table(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.folder}/{name}.parquet")

    def shared(self, name: str, **frames: DataFrame) -> DataFrame:
        sql = SHARED[name]
        for f in frames:
            sql = re.sub(rf"\bFROM {f}\b", f"FROM {{{f}}}", sql)
        return self.spark.sql(sql, **frames)

    @cached_property
    def events(self):
        return self.table("events")

    @cached_property
    def _customers(self):
        return self.table("customer")

    def _count(self, df):
        return df.agg(F.count("*")).scalar()

    @cached_property
    def track_points(self):
        return self.stored("track_points", self._track_points)

    def _track_points(self):
        ranked = dense_rank_rows(self.events, "user_id", "event_id", "seq")
        return ranked.withColumn("n", self._count(self.events)).selectExpr(
            "user_id AS track_id", "seq", "event_id", "ts", f"{LNG.format(n='n')} AS lng", f"{LAT} AS lat",
            f"CAST({NUM} AS INT) AS k", "value", "event_type",
        )

    @cached_property
    def grid(self):
        n = self._count(self._customers)
        return self._customers.select(F.col("c_custkey").alias("id"), n.alias("n")).selectExpr(
            "id", "n", "CAST(ceil(sqrt(2.8e0*n)) AS BIGINT) AS w", "4.2e0/ceil(sqrt(2.8e0*n)) AS p"
        ).selectExpr(
            "*", "13.90037e0 + p*(id % w + 0.5e0) AS c_lng", "49.30041e0 + p*(floor(id/CAST(w AS DOUBLE)) + 0.5e0) AS c_lat",
            "CASE WHEN 2*(id % w) < w THEN 1 ELSE 2 END AS country_id", "id % 10 = 0 AS holed",
        )

    @cached_property
    def areas(self):
        return self.stored("areas", self._areas)

    def _areas(self):
        shift = "CASE WHEN holed THEN 0.65e0*p/2 ELSE 0e0 END"
        land = self.grid.selectExpr(
            "id AS area_id", "concat('A', CAST(id AS STRING)) AS name", f"c_lng + {shift} AS lng", f"c_lat + {shift} AS lat",
            "p/2 AS half_deg", "c_lng", "c_lat", "country_id", "4 AS level_id", "CASE WHEN id % 37 = 0 THEN 9 END AS special_group_id", "holed",
        )
        city = self.grid.where("holed").selectExpr(
            "n + id AS area_id", "concat('C', CAST(id AS STRING)) AS name", "c_lng AS lng", "c_lat AS lat", "0.18e0*p AS half_deg",
            "c_lng", "c_lat", "country_id", "4 AS level_id", "CAST(NULL AS INT) AS special_group_id", "false AS holed",
        )
        return land.unionByName(city)

    @cached_property
    def area_vertices(self):
        return self.stored("area_vertices", self._area_vertices)

    def _area_vertices(self):
        corners = F.expr("array(struct(0 AS v, -1 AS sx, -1 AS sy), struct(1 AS v, 1 AS sx, -1 AS sy), struct(2 AS v, 1 AS sx, 1 AS sy), struct(3 AS v, -1 AS sx, 1 AS sy))")
        rings = F.expr("CASE WHEN holed THEN array(0, 1) ELSE array(0) END")
        rows = self.areas.withColumn("ring_no", F.explode(rings)).withColumn("c", F.explode(corners))
        h = "CASE WHEN ring_no = 0 THEN half_deg ELSE 0.4e0*half_deg END"
        return rows.selectExpr("area_id", "0 AS part_no", "ring_no", "c.v AS v", f"c_lng + c.sx*{h} AS lng", f"c_lat + c.sy*{h} AS lat")

    def _pairs(self, user: str, name: str):
        rows = self.events.withColumn("n", self._count(self._customers))
        return rows.selectExpr(f"{user} AS {name}", "(event_id*7) % n AS area_id").distinct()

    @cached_property
    def visits(self):
        rows = self.events.withColumn("n", self._count(self._customers)).withColumn("k", F.explode(F.sequence(F.lit(0), F.lit(9))))
        return rows.selectExpr("user_id", "(event_id*7 + k) % n AS area_id").distinct()

    @cached_property
    def wishes(self):
        return self._pairs("user_id", "plan_id")

    @cached_property
    def waypoints(self):
        return self.stored("waypoints", self._waypoints)

    def _waypoints(self):
        marked = self.track_points.where("event_type = 'signup'")
        return dense_rank_rows(marked, "track_id", "seq", "pos").selectExpr("track_id AS plan_id", "pos", "seq", "lng", "lat", "k")

    @cached_property
    def legs(self):
        return self.stored("legs", self._legs)

    def _legs(self):
        pairs = with_neighbors(self.waypoints, "plan_id", "pos", prev={"a_lng": "lng", "a_lat": "lat"}).where("a_lng IS NOT NULL")
        ok = "(plan_id + pos) % 13 <> 0 AND (plan_id + pos) % 17 <> 0"
        return pairs.selectExpr(
            "plan_id", "pos", "a_lng", "a_lat", "lng AS b_lng", "lat AS b_lat",
            "CASE WHEN (plan_id + pos) % 13 = 0 THEN concat('target island detected for section ', CAST(pos AS STRING)) "
            "WHEN (plan_id + pos) % 17 = 0 THEN 'datafile E15_N45.rd5 not found' END AS error",
            f"CASE WHEN {ok} THEN 20.0e0 + k END AS km", f"CASE WHEN {ok} THEN 5.0e0*k END AS climb_m",
        )

    @cached_property
    def dem_cells(self):
        orders = self.table("orders")
        return orders.withColumn("n", F.ceil(F.sqrt(self._count(orders) / F.lit(12.0))).cast("int")).selectExpr(
            "CAST(49 + floor(o_orderkey/(6.0e0*n*n)) AS INT) AS tile_lat",
            "CAST(13 + floor((o_orderkey % (6*n*n))/CAST(n*n AS DOUBLE)) AS INT) AS tile_lng", "n",
            "CAST(floor((o_orderkey % (n*n))/CAST(n AS DOUBLE)) AS INT) AS r", "CAST(o_orderkey % n AS INT) AS c",
            "CAST(CASE WHEN o_orderkey % 97 <> 0 THEN 200 + floor(o_totalprice/1000.0e0) END AS INT) AS ele",
        )

    @cached_property
    def messages(self):
        return self.shared("messages", track_points=self.track_points)

    @cached_property
    def calls(self):
        return self.shared("calls", events=self.events)

    @cached_property
    def plans(self):
        return self.shared("plans", customer=self._customers)

    @cached_property
    def drafts(self):
        return self.shared("drafts", orders=self.table("orders"))

    @cached_property
    def plan_tasks(self):
        return self.shared("plan_tasks", orders=self.table("orders"))

    @cached_property
    def seg_remote(self):
        return self.shared("seg_remote", part=self.table("part"))

    @cached_property
    def seg_installed(self):
        return self.shared("seg_installed", supplier=self.table("supplier"))
