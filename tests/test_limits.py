"""Cases beyond former limits, crowds, missing rows and streams over several tracks."""

import json
import random

import pytest
from pyspark.sql import functions as F

from trackspark.operators import areas, legs, neighbors, pools, stats, tables
from trackspark.plans import lineage
from trackspark.plans.nearest import nearest
from trackspark.sources import archive, areas_json, exports
from trackspark.streaming import jobs


def test_geojson_pieces_join_to_one_feature(spark):
    pts = spark.createDataFrame([(t, i, 14.0 + i / 10, 50.0) for t in (1, 2) for i in range(10)], "track_id bigint, seq int, lng double, lat double")
    rows = exports.tracks_to_geojson(pts, part=3).orderBy("track_id", "part_no").collect()
    for t in (1, 2):
        feature = json.loads("".join(r.geojson for r in rows if r.track_id == t))
        assert [c[0] for c in feature["geometry"]["coordinates"]] == pytest.approx([14.0 + i / 10 for i in range(10)])


def test_archive_keeps_any_delta(spark):
    pts = [(1, 0, 1.0, 2.0, 1e9), (1, 1, 1.0, 2.0, -1e9), (1, 2, 1.5, 2.5, 0.5)]
    df = spark.createDataFrame(pts, "track_id bigint, seq int, lng double, lat double, ele double")
    back = archive.unarchive_tracks(archive.archive_tracks(df)).orderBy("seq").collect()
    assert [tuple(r) for r in back] == pts


def test_polygon_without_outer_ring_is_dropped_with_its_holes(spark):
    ring, short = "[[0,0],[1,0],[1,1],[0,1]]", "[[0,0],[1,1]]"
    rows = [(1, f'{{"coordinates":[{short},{ring}]}}'), (2, f'{{"coordinates":[[{short},{ring}],[{ring},{ring}]]}}'), (3, f'{{"geometries":[{{"coordinates":[{ring}]}},{{"coordinates":[[{ring}],[{ring}]]}}]}}')]
    out = areas_json.read_areas(spark.createDataFrame(rows, "area_id bigint, geometry string"))
    assert {(r.area_id, r.part_no, r.ring_no) for r in out.collect()} == {(2, 1, 0), (2, 1, 1), (3, 0, 0), (3, 1, 0), (3, 2, 0)}
    kept = spark.createDataFrame([(1, 0, 0, v, 0.0, float(v)) for v in range(8)] + [(2, 0, 0, v, 0.0, 0.0) for v in range(2)] + [(p, 0, 1, v, 0.1, float(v)) for p in (1, 2) for v in range(8)],
                                 "area_id bigint, part_no int, ring_no int, v int, lng double, lat double")
    assert {r.area_id for r in areas.sample_ring(kept, 4).collect()} == {1}


def test_detour_of_an_unknown_leg(spark):
    route = spark.createDataFrame([(1, p, 14.0 + p / 10, 50.0 + (p % 2) / 10) for p in range(4)], "plan_id bigint, pos int, lng double, lat double")
    known = spark.createDataFrame([(14.0, 50.0, 14.1, 50.1, 30.0, 0.0)], "a_lng double, a_lat double, b_lng double, b_lat double, km double, climb_m double")
    got = {r.pos: r.detour_km for r in legs.waypoint_detour(route, known).collect()}
    assert set(got) == {1, 2} and all(v > 0 for v in got.values())


def test_sessions_replaced_by_nothing(spark, tmp_path):
    path = str(tmp_path / "t")
    tables.replace_rows(spark.createDataFrame([(s, d) for s in range(6) for d in range(3)], "session_id int, day int"), path, buckets=16)
    gone = spark.createDataFrame([(1,), (2,), (4,)], "session_id int")
    tables.replace_rows(spark.createDataFrame([(4, 9)], "session_id int, day int"), path, buckets=16, sessions=gone)
    rows = {(r.session_id, r.day) for r in tables.read_rows(spark, path).collect()}
    assert rows == {(4, 9)} | {(s, d) for s in (0, 3, 5) for d in range(3)}


def test_plans_without_candidates_are_rejected(spark):
    plans = spark.createDataFrame([(1,), (2,), (3,)], "plan_id bigint")
    near = spark.createDataFrame([(1, 5.0), (1, 700.0), (3, 300.0)], "plan_id bigint, km double")
    assert {(r.plan_id, r.nearest_km, r.accepted) for r in neighbors.presence_check(plans, near).collect()} == {(1, 5.0, True), (2, None, False), (3, 300.0, False)}


def test_spans_skip_messages_without_length_before_matching(spark):
    pts = spark.createDataFrame([(1, i, 14.0 + i / 100, 50.0) for i in range(5)], "track_id bigint, seq int, lng double, lat double")
    msgs = [(1, n + 1, 14_000_000 + i * 10_000, 50_000_000, 0 if i == 4 else 10, f"highway=x{i} surface=s{i}") for n, i in enumerate((1, 4, 2, 3))]
    m = spark.createDataFrame(msgs, "track_id bigint, row_no int, key_lng bigint, key_lat bigint, dist_m bigint, way_tags string")
    spans = stats.stat_spans(m, pts).where("dim = 'surface'").orderBy("start_idx").collect()
    assert [(r.start_idx, r.end_idx) for r in spans] == [(0, 1), (1, 2), (2, 3)]


def test_pool_has_no_limit_of_its_own(spark):
    pool = spark.range(50_000).selectExpr("1L AS user_id", "id AS area_id", "1 AS country_id", "4 AS level_id")
    seen = spark.createDataFrame([(1, 7)], "user_id bigint, area_id bigint")
    assert pools.split_visited(pool, seen).count() == 50_000
    assert pools.split_visited(pool, seen, 10).count() == 11


def test_deepest_point_of_a_wide_triangle(spark):
    ring = [(10.0, 0.0), (22.0, 1.0), (13.0, 11.0)]
    v = spark.createDataFrame([(1, 0, 0, i, x, y) for i, (x, y) in enumerate(ring)], "area_id bigint, part_no int, ring_no int, v int, lng double, lat double")
    a = spark.createDataFrame([(1, 15.0, 0.0)], "area_id bigint, lng double, lat double")
    got = areas.with_deepest(areas.geometry(a, v, F.lit(1.0)), 0.00025).select("deepest.d").first().d
    side = [((ring[i][0] - ring[i - 1][0]) ** 2 + (ring[i][1] - ring[i - 1][1]) ** 2) ** 0.5 for i in range(3)]
    twice = abs(sum(ring[i - 1][0] * ring[i][1] - ring[i][0] * ring[i - 1][1] for i in range(3)))
    assert 0 <= twice / sum(side) - got <= 0.00025


def test_crowded_sites_are_not_paired_point_by_point(spark):
    rng = random.Random(1)
    pts = [(i, 15.0 + rng.uniform(0, 0.02), 50.0 + rng.uniform(0, 0.02)) for i in range(4000)] + [(10_000 + i, 15.01, 50.01) for i in range(1500)] + [(99_999, -120.0, 10.0)]
    df = spark.createDataFrame(pts, "area_id bigint, lng double, lat double")
    sites = neighbors._sites(df, "area_id", [])
    asks = sites.select(F.col("sid").alias("qid"), F.col("sx").alias("qx"), F.col("sy").alias("qy"), F.col("sz").alias("qz"))
    out = nearest(asks, sites, neighbors._distance(), 2, exclude=F.col("sid") == F.col("qid"), levels=5, root=1600.0, slack=1e-9, spare=1)
    assert out.count() == 2 * len(pts)
    by = {r.qid: r.dist for r in out.where("rank = 1").collect()}
    for i in rng.sample(range(4000), 20):
        k = next(r for r in sites.where(F.col("sid") == i).collect())
        best = sites.where(F.col("sid") != i).agg(F.min(F.hypot(F.col("sx") - k.sx, F.col("sy") - k.sy))).first()[0]
        assert by[i] == pytest.approx(best, abs=1e-9)


def test_written_tables_are_deleted(spark):
    t = lineage.materialize(spark.range(5).toDF("id"), "x")
    assert t.count() == 5 and lineage.path_exists(spark, t.written_to)
    lineage.discard(t)
    assert not lineage.path_exists(spark, t.written_to)


def test_new_tiles_over_two_tracks_and_batches(spark, tmp_path):
    schema = "user_id bigint, track_id bigint, ts timestamp, seq int, lng double, lat double"
    rows = lambda track, hour, lng: [(1, track, f"2024-01-01 {hour:02d}:00:0{i}", i, lng + i * 0.05, 50.0) for i in range(4)]
    path = str(tmp_path / "in")
    for part in (rows(1, 8, 14.0), rows(2, 9, 16.0), rows(1, 10, 14.0)):
        data = [(u, t, ts, q + (10 if ts[12] == "0" and ts[11] == "1" else 0), x, y) for u, t, ts, q, x, y in part]
        spark.createDataFrame(data, schema.replace("timestamp", "string")).withColumn("ts", F.to_timestamp("ts")).coalesce(1).write.mode("append").parquet(path)
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(path)
    q = jobs.stream_new_tiles(stream, z=10).writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "ck")).trigger(availableNow=True).start()
    q.awaitTermination()
    tiles = [r.tile_key // 131072 for r in spark.read.parquet(str(tmp_path / "out")).collect()]
    assert len(tiles) == len(set(tiles))
    span = lambda a, b: set(range(int((a + 180) / 360 * 1024), int((b + 180) / 360 * 1024) + 1))
    assert set(tiles) == span(14.0, 14.15) | span(16.0, 16.15)


def test_silent_running_task_turns_stale(spark, tmp_path):
    schema, path = "task_id bigint, status string, ts timestamp", str(tmp_path / "in")
    for rows in ([(1, "RUNNING", "2024-01-01 08:00:00"), (2, "RUNNING", "2024-01-01 08:00:00")], [(2, "DONE", "2024-01-01 08:10:00")], [(3, "RUNNING", "2024-01-01 12:00:00")], [(4, "RUNNING", "2024-01-01 12:01:00")]):
        spark.createDataFrame(rows, schema.replace("timestamp", "string")).withColumn("ts", F.to_timestamp("ts")).coalesce(1).write.mode("append").parquet(path)
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(path)
    out = jobs.stream_latest_tasks(stream, timeout_s=3600)
    q = out.writeStream.foreachBatch(lambda b, n: b.write.mode("append").parquet(str(tmp_path / "out"))).outputMode("update").option("checkpointLocation", str(tmp_path / "ck")).trigger(availableNow=True).start()
    q.awaitTermination()
    got = {(r.task_id, r.status) for r in spark.read.parquet(str(tmp_path / "out")).collect()}
    assert got == {(1, "RUNNING"), (2, "RUNNING"), (2, "DONE"), (3, "RUNNING"), (4, "RUNNING"), (1, "STALE")}


def test_count_within_by_bisection(spark):
    """Counts against brute force, with crowds of equal and of close places dealt to several parts."""
    import numpy as np

    from trackspark.functions.geo import KNN_KM_PER_DEG
    from trackspark.operators import neighbors

    rng = np.random.default_rng(3)
    lng = np.r_[rng.uniform(15, 15.3, 400), np.full(50, 15.1), 15.2 + rng.uniform(0, 1e-4, 200)]
    lat = np.r_[rng.uniform(50, 50.2, 400), np.full(50, 50.1), 50.1 + rng.uniform(0, 1e-4, 200)]
    df = spark.createDataFrame([(i, float(a), float(b)) for i, (a, b) in enumerate(zip(lng, lat, strict=True))], "area_id long, lng double, lat double")
    x, y = lng * np.cos(np.radians(lat.mean())) * KNN_KM_PER_DEG, lat * KNN_KM_PER_DEG
    want = (np.hypot(x[:, None] - x, y[:, None] - y) < 2.0).sum(axis=1) - 1
    before, neighbors.ASKERS = neighbors.ASKERS, 100
    try:
        plan = neighbors.count_within(df, 2.0)
    finally:
        neighbors.ASKERS = before
    assert "FlatMapGroupsInArrow" in plan._jdf.queryExecution().toString()
    got = {r.area_id: r.n for r in plan.collect()}
    assert got == dict(enumerate(want.tolist()))


def test_latest_task_reads_and_writes_its_state_once(spark):
    """A task costs one read, one write and a change of timer per batch; timers are never listed."""
    from types import SimpleNamespace

    from pyspark.sql import Row

    from trackspark.streaming.state import LatestTask

    calls, held = [], {}
    state = SimpleNamespace(get=lambda: calls.append("get") or held.get("v"), update=lambda v: calls.append("update") or held.update(v=v))
    handle = SimpleNamespace(getValueState=lambda *_: state, registerTimer=lambda ms: calls.append(ms), deleteTimer=lambda ms: calls.append(-ms))
    task = LatestTask(60, 5000)
    task.init(handle)
    out = list(task.handleInputRows((7,), iter([Row(status="RUNNING", us=3_000_001), Row(status="FAILED", us=2_000_000)]), None))
    assert out == [Row(task_id=7, status="RUNNING", us=3_000_001)] and calls == ["get", "update", 63_000]
    calls.clear()
    out = list(task.handleInputRows((7,), iter([Row(status="COMPLETED", us=4_000_000)]), None))
    assert out == [Row(task_id=7, status="COMPLETED", us=4_000_000)] and calls == ["get", -63_000, "update", 9_000]
    calls.clear()
    assert list(task.handleInputRows((7,), iter([Row(status="RUNNING", us=1_000_000)]), None)) == [] and calls == ["get"]


def test_track_timers_are_moved_without_listing():
    """The state tells when a track's timer was due, so none are listed."""
    from types import SimpleNamespace

    import pandas as pd

    from trackspark.streaming.state import RunningEffort, TrackSegments

    for task, key in ((RunningEffort(5000), (7,)), (TrackSegments(10, 5000), (1, 7))):
        moves, held = [], {}
        state = SimpleNamespace(get=lambda h=held: h.get("v"), update=lambda v, h=held: h.update(v=v))
        handle = SimpleNamespace(getValueState=lambda *_, s=state: s, registerTimer=moves.append, deleteTimer=lambda ms, m=moves: m.append(-ms))
        task.init(handle)
        for second in (1, 2):
            rows = pd.DataFrame({"ts": pd.to_datetime([second], unit="s"), "seq": [second], "lng": [14.0 + second], "lat": [50.0], "ele": [0.0]})
            assert len(list(task.handleInputRows(key, iter([rows]), None))) == 1
        assert moves == [6000, -6000, 7000]
