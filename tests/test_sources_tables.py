import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from trackspark.operators import legs, selection, tables
from trackspark.sources import archive, areas_json, catalog, dem, exports, messages


def test_hgt_files(spark, tmp_path):
    grid = np.array([[0, 1, 2], [10, 11, 12], [20, -32768, 22]], dtype=">i2")
    (tmp_path / "N50E014.hgt").write_bytes(grid.tobytes())
    (tmp_path / "N51E014.hgt").write_bytes(b"12345")
    (tmp_path / "other.hgt").write_bytes(grid.tobytes())
    rows = dem.read_hgt(spark, str(tmp_path)).collect()
    assert len(rows) == 9 and {(r.tile_lat, r.tile_lng, r.n) for r in rows} == {(50, 14, 3)}
    assert {(r.r, r.c): r.ele for r in rows}[2, 1] is None
    sizes = spark.createDataFrame([(1201 * 1201 * 2,), (3601 * 3601 * 2,), (12345,)], "b bigint")
    assert [r[0] for r in sizes.select(dem.resolution(F.col("b"))).collect()] == [1201, 3601, 0]


def test_message_files_and_catalogue(spark, tmp_path):
    head = "\t".join(["Longitude", "Latitude", "Elevation", "Distance"] + ["x"] * 5 + ["WayTags"] + ["y"] * 3)
    row = "\t".join(["14000000", "50000000", "1", "25"] + ["0"] * 5 + ["highway=path"] + ["0"] * 3)
    (tmp_path / "7.tsv").write_text(f"{head}\n{row}\nshort\trow\n")
    got = messages.read_messages(spark, str(tmp_path)).collect()
    assert [(r.track_id, r.row_no, r.dist_m, r.way_tags) for r in got] == [(7, 1, 25, "highway=path")]
    store = tmp_path / "seg"
    store.mkdir()
    for name in ("E20_N50.rd5", "E21_N50.rd5", "readme.txt"):
        (store / name).write_text("abc")
    assert [(r.name, r.size_bytes) for r in catalog.list_installed(spark, str(store)).collect()] == [("E20_N50", 3)]
    assert catalog.dem_grid(spark).count() == 43 * 61
    assert catalog.dem_grid(spark, europe_only=False).orderBy("ord").first().name == "N89W180"


def test_archive_round_trip(spark):
    rng = random.Random(9)
    pts = [(t, i, round(rng.uniform(-180, 180), 6), round(rng.uniform(-90, 90), 6), round(rng.uniform(-400, 8000), 1)) for t in range(3) for i in range(50)]
    df = spark.createDataFrame(pts, "track_id bigint, seq int, lng double, lat double, ele double")
    for part in (7, 1000):
        back = archive.unarchive_tracks(archive.archive_tracks(df, part)).collect()
        assert {(r.track_id, r.seq, round(r.lng, 6), round(r.lat, 6), round(r.ele, 1)) for r in back} == set(pts)
    parts = archive.archive_tracks(df, 7).orderBy("track_id", "part_no").collect()
    whole = {r.track_id: r.encoded for r in archive.archive_tracks(df).collect()}
    assert all("".join(r.encoded for r in parts if r.track_id == t) == text for t, text in whole.items())


def test_geometry_kinds(spark):
    ring = "[[0,0],[1,0],[1,1,9],[0,1]]"
    rows = [
        (1, f'{{"type":"Polygon","coordinates":[{ring},{ring}]}}'), (2, f'{{"type":"MultiPolygon","coordinates":[[{ring}],[{ring}]]}}'),
        (3, f'{{"geometries":[{{"coordinates":[{ring}]}},{{"coordinates":[[{ring}]]}}]}}'), (4, f'{{"coordinates":{ring}}}'), (5, None), (6, "nonsense"),
        (7, '{"coordinates":[[[0,0],[1,1]]]}'),
    ]
    out = areas_json.read_areas(spark.createDataFrame(rows, "area_id bigint, geometry string"))
    got = {r.area_id: (r.parts, r.n) for r in out.groupBy("area_id").agg(F.countDistinct("part_no", "ring_no").alias("parts"), F.count("*").alias("n")).collect()}
    assert got == {1: (2, 8), 2: (2, 8), 3: (2, 8), 4: (1, 4)}


def test_gpx_document(spark, tmp_path):
    drafts = spark.createDataFrame([(1, 5, 1, "A&B"), (2, 5, 2, "C")], "draft_id bigint, group_id bigint, day_number int, name string")
    pts = spark.createDataFrame([(d, i, 14.5 + i, 50.25) for d in (1, 2) for i in range(3)], "draft_id bigint, seq int, lng double, lat double")
    exports.write_gpx(drafts, pts, str(tmp_path / "gpx"))
    text = next((tmp_path / "gpx" / "group_id=5").glob("*.txt")).read_text()
    assert text.startswith("<?xml") and text.rstrip().endswith("</gpx>") and "A&amp;B" in text and "<ele>" not in text
    assert text.index("A&amp;B") < text.index("<name>C") and text.count("<trkpt") == 6
    assert '<trkpt lat="50.25" lon="14.5"></trkpt>' in text


def test_leg_cache(spark):
    def ask(rows):
        return spark.createDataFrame(rows, "a_lng double, a_lat double, b_lng double, b_lat double")

    none = spark.createDataFrame([], "k string, approximate boolean")
    five = legs.resolve_legs(ask([(1.0, 2.0, 3.0, 4.0)] * 5), none)
    assert legs.cache_ratio(five).first().ratio == pytest.approx(0.8)
    assert legs.resolve_legs(ask([(1.0, 2.0, 3.0, 4.0), (3.0, 4.0, 1.0, 2.0)]), none).count() == 2


def test_upsert_and_replace(spark, tmp_path):
    cur = spark.createDataFrame([(1, "a"), (2, None)], "id int, v string")
    new = spark.createDataFrame([(2, "b"), (3, None)], "id int, v string")
    assert {tuple(r) for r in tables.upsert(cur, new, ["id"]).collect()} == {(1, "a"), (2, "b"), (3, None)}
    path = str(tmp_path / "t")
    days = spark.createDataFrame([(s, d) for s in range(6) for d in range(3)], "session_id int, day int")
    tables.replace_rows(days, path, buckets=2)
    tables.replace_rows(spark.createDataFrame([(4, 9)], "session_id int, day int"), path, buckets=2)
    rows = tables.read_rows(spark, path)
    assert {r.day for r in rows.where("session_id = 4").collect()} == {9} and rows.count() == 16


def test_build_up_takes_near_and_rewarding_areas_first(spark):
    plans = spark.createDataFrame([(1, 60.0, 15.0, 50.0, 15.2, 50.0), (2, 1e6, 15.0, 50.0, 15.2, 50.0)], "plan_id bigint, target double, start_lng double, start_lat double, end_lng double, end_lat double")
    cands = spark.createDataFrame([(p, a, 15.0 + a / 100, 50.05, 1.0, 1.0 + a) for p in (1, 2) for a in range(30)] + [(2, 99, 25.0, 50.0, 1.0, 700.0)],
                                  "plan_id bigint, area_id bigint, lng double, lat double, reward double, dist_km double")
    adj = spark.createDataFrame([], "area_id bigint, nbr_id bigint, shared_km double")
    per = spark.createDataFrame([(a, 10.0) for a in [*range(30), 99]], "area_id bigint, perimeter_km double")
    seen = spark.createDataFrame([(1, 0), (2, 5)], "plan_id bigint, area_id bigint")
    box = spark.createDataFrame([(15.0, 49.0, 25.0, 51.0)], "min_lng double, min_lat double, max_lng double, max_lat double")
    got = {}
    for r in selection.build_up(plans, cands, adj, per, seen, box).collect():
        got.setdefault(r.plan_id, {})[r.area_id] = r["round"]
    assert {a for a, n in got[1].items() if n == 1} == set(range(1, 21)) and len(got[1]) < 29
    later = [got[1][a] for a in sorted(got[1])]
    assert later == sorted(later) and 0 not in got[1]
    assert set(got[2]) == {*range(30), 99} - {5} and got[2][99] > max(v for a, v in got[2].items() if a != 99)


def test_build_up_makes_its_candidates_once(spark):
    made = spark.sparkContext.accumulator(0)

    def count(batches):
        for b in batches:
            made.add(b.num_rows)
            yield b

    plans = spark.createDataFrame([(1, 1e6, 15.0, 50.0, 15.2, 50.0)], "plan_id bigint, target double, start_lng double, start_lat double, end_lng double, end_lat double")
    cands = spark.createDataFrame([(1, a, 15.0 + a / 100, 50.05, 1.0, 1.0 + a) for a in range(30)], "plan_id bigint, area_id bigint, lng double, lat double, reward double, dist_km double")
    adj = spark.createDataFrame([(a, b, 1.0) for a in range(30) for b in (a - 1, a + 1) if 0 <= b < 30], "area_id bigint, nbr_id bigint, shared_km double")
    per = spark.createDataFrame([(a, 10.0) for a in range(30)], "area_id bigint, perimeter_km double")
    box = spark.createDataFrame([(15.0, 49.0, 25.0, 51.0)], "min_lng double, min_lat double, max_lng double, max_lat double")
    got = selection.build_up(plans, cands.mapInArrow(count, cands.schema), adj, per, spark.createDataFrame([(1, 0)], "plan_id bigint, area_id bigint"), box)
    assert got.count() == 29 and made.value == 30
