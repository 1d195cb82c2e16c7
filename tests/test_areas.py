import math
import random
import types

import numpy as np
import pytest
from pyspark.sql import functions as F

from suite import neighbor_queries
from trackspark.functions.geo import METERS_PER_DEG
from trackspark.operators import adjacency, areas, coverage, neighbors


def square(x, y, h, hy=None):
    hy = h if hy is None else hy
    return [(x - h, y - hy), (x + h, y - hy), (x + h, y + hy), (x - h, y + hy)]


def frames(spark, shapes, rep=None, country=None):
    """``shapes``: id -> list of parts, a part being a list of rings (outer first)."""
    rep, country = rep or {}, country or {}
    head = []
    verts = []
    for i, parts in shapes.items():
        xs, ys = zip(*parts[0][0])
        lng, lat = rep.get(i, (sum(xs) / len(xs), sum(ys) / len(ys)))
        head.append((i, f"A{i}", float(lng), float(lat), country.get(i, 1)))
        verts += [(i, p, r, v, float(pt[0]), float(pt[1])) for p, rings in enumerate(parts) for r, ring in enumerate(rings) for v, pt in enumerate(ring)]
    return (spark.createDataFrame(head, "area_id bigint, name string, lng double, lat double, country_id int"),
            spark.createDataFrame(verts, "area_id bigint, part_no int, ring_no int, v int, lng double, lat double"))


def track(spark, *lines):
    return spark.createDataFrame([(t, i, float(p[0]), float(p[1])) for t, line in enumerate(lines) for i, p in enumerate(line)], "track_id bigint, seq int, lng double, lat double")


def covered(spark, shapes, mode, *lines, **kw):
    idx = coverage.area_index(*frames(spark, shapes, **kw))
    return {(r.track_id, r.area_id) for r in coverage.area_coverage(track(spark, *lines), idx, mode).collect()}


def test_area_sizes(spark):
    a, v = frames(spark, {1: [[square(14.5, 50, 0.035, 0.027)]], 2: [[square(14.5, 50, 0.14, 0.135)]], 3: [[[(14, 50), (14.1, 50)]]]})
    km2 = {r.area_id: r.km2 for r in areas.area_km2(a, v).collect()}
    assert km2[1] == pytest.approx(30, abs=5) and km2[2] == pytest.approx(600, abs=80) and km2[3] == 0


def test_entry_lines(spark):
    shape = {1: [[square(15, 50, 0.05)]]}
    lines = [[(15.06, 50), (15.0, 50)], [(15.06, 50), (15.0495, 50)], [(15.051, 49.97), (15.051, 50.03)], [(15.01, 50.01)], [(15.2, 50.0)]]
    assert covered(spark, shape, "credit", *lines) == {(0, 1), (3, 1)}
    assert covered(spark, shape, "full", *lines) == {(0, 1), (1, 1), (3, 1)}
    assert covered(spark, shape, "deep", *lines) == {(0, 1)}


def test_narrow_area_needs_less_depth(spark):
    shape = {1: [[square(15, 50, 0.001817, 0.003)]]}
    up = lambda x: [(x, 49.99), (x, 50.01)]
    assert covered(spark, shape, "credit", up(15.000629), up(15.0013977)) == {(0, 1)}


def test_second_part_and_hole(spark):
    two = {1: [[square(15, 50, 0.05)], [square(15.5, 50, 0.04)]]}
    assert covered(spark, two, "credit", [(15.6, 50), (15.5, 50)]) == {(0, 1)}
    ring = {1: [[square(15, 50, 0.1), square(15, 50, 0.03)]], 2: [[square(15, 50, 0.025)]]}
    idx = coverage.area_index(*frames(spark, ring, rep={1: (15.065, 50.065)}))
    got = coverage.locate_points(track(spark, [(15, 50), (15.07, 50)]), ["track_id", "seq"], idx).collect()
    assert {(r.seq, r.area_id) for r in got} == {(0, 2), (1, 1)}


def star(rng, cx, cy):
    angles = sorted(rng.uniform(0, 2 * math.pi) for _ in range(rng.randrange(5, 12)))
    return [(cx + math.cos(a) * rng.uniform(0.01, 0.06), cy + math.sin(a) * rng.uniform(0.01, 0.06)) for a in angles]


def depth_at(ring, cos, x, y):
    """Signed distances to the boundary of a projected ring, positive inside."""
    x, y = np.asarray(x, float), np.asarray(y, float)
    pts = [(a * cos, b) for a, b in ring]
    inside, best = np.zeros(x.shape, bool), np.full(x.shape, 1e9)
    for (ax, ay), (bx, by) in zip(pts, pts[1:] + pts[:1]):
        inside ^= ((ay > y) != (by > y)) & (x < (bx - ax) * (y - ay) / ((by - ay) or 1e-300) + ax)
        t = np.clip(((x - ax) * (bx - ax) + (y - ay) * (by - ay)) / ((bx - ax) ** 2 + (by - ay) ** 2), 0, 1)
        best = np.minimum(best, np.hypot(x - ax - t * (bx - ax), y - ay - t * (by - ay)))
    return np.where(inside, best, -best)


def test_coverage_and_deepest_point_on_irregular_polygons(spark):
    rng = random.Random(8)
    shapes = {i: [[star(rng, 15 + 0.15 * (i % 6), 50 + 0.15 * (i // 6))]] for i in range(24)}
    rep = {i: (15 + 0.15 * (i % 6), 50 + 0.15 * (i // 6)) for i in range(24)}
    lines = [[(rng.uniform(14.9, 16), rng.uniform(49.9, 50.6)) for _ in range(4)] for _ in range(15)]
    a, v = frames(spark, shapes, rep=rep)
    idx = coverage.area_index(a, v)
    cos = a.select(F.cos(F.radians(F.avg("lat")))).first()[0]
    limit = {r.area_id: (r.credit_d, r.deep_d) for r in idx.geoms.collect()}
    pts = track(spark, *lines)
    for mode, which in (("credit", 0), ("deep", 1)):
        got = {(r.track_id, r.area_id) for r in coverage.area_coverage(pts, idx, mode).collect()}
        for t, line in enumerate(lines):
            for i, parts in shapes.items():
                steps = np.linspace(0, 1, 4001)
                d = max(depth_at(parts[0][0], cos, (p[0] + (q[0] - p[0]) * steps) * cos, p[1] + (q[1] - p[1]) * steps).max() for p, q in zip(line, line[1:]))
                need = limit[i][which]
                if abs(d - need) > 2e-4:
                    assert ((t, i) in got) == (d > need), (mode, t, i, d, need)
    for r in areas.deepest_points(a, v).collect():
        ring = shapes[r.area_id][0][0]
        xs, ys = [p[0] for p in ring], [p[1] for p in ring]
        gx, gy = np.meshgrid(np.linspace(min(xs), max(xs), 61), np.linspace(min(ys), max(ys), 61))
        best = depth_at(ring, cos, gx * cos, gy).max()
        mine = depth_at(ring, cos, r.lng * cos, r.lat) * METERS_PER_DEG
        if best > 0:
            assert mine == pytest.approx(r.depth_m, abs=1e-3) and mine >= best * METERS_PER_DEG - 220


def grid(n, pitch=0.1):
    return {r * n + c + 1: [[square(15 + c * pitch, 50 + r * pitch, pitch / 2)]] for r in range(n) for c in range(n)}


def adjacent(spark, shapes, **kw):
    a, v = frames(spark, shapes, **kw)
    idx = adjacency.neighbor_index(a, v).stored()
    return a, adjacency.adjacency(idx).cache(), adjacency.perimeters(idx)


def visited(spark, ids, user=1):
    return spark.createDataFrame([(user, i) for i in ids], "user_id bigint, area_id bigint")


def test_enclosed_and_fractions(spark):
    a, adj, per = adjacent(spark, grid(3))
    around = [1, 2, 3, 4, 6, 7, 8, 9]
    assert [r.area_id for r in adjacency.enclosed(adj, visited(spark, around)).collect()] == [5]
    assert 5 not in [r.area_id for r in adjacency.enclosed(adj, visited(spark, around[1:])).collect()]
    frac = lambda ids: {r.area_id: r.fraction for r in adjacency.neighbor_fraction(adj, per, visited(spark, ids)).collect()}.get(5, 0)
    assert frac([2, 4, 6, 8]) > 0.95
    assert 0.4 <= frac([2, 4]) <= 0.6
    assert {r.area_id for r in adjacency.border_areas(adj, a, visited(spark, around)).collect()} <= set(around)


def test_enclave(spark):
    a, adj, per = adjacent(spark, grid(4))
    hole = {6, 7, 10, 11}
    pool = visited(spark, range(1, 17))
    got = adjacency.enclosed_regions(adj, per, pool, visited(spark, set(range(1, 17)) - hole)).collect()
    assert {(r.area_id, r["size"]) for r in got} == {(i, 4) for i in hole}
    a, adj, per = adjacent(spark, grid(3))
    assert adjacency.enclosed_regions(adj, per, visited(spark, range(1, 10)), visited(spark, range(2, 10))).count() == 0


def test_regions_of_shared_scopes(spark, monkeypatch):
    """The same groups as from listed pools, of which only parts that may qualify are listed."""
    rng = random.Random(11)
    a, adj, per = adjacent(spark, grid(8))
    scopes = spark.createDataFrame([(i // 12 % 2, i) for i in range(1, 65)], "scope int, area_id bigint")
    users = spark.createDataFrame([(u, u % 2) for u in range(24)], "user_id bigint, scope int")
    rows = [(u, i) for u in range(24) for i in range(1, 65) if rng.random() < (u % 6) / 6]
    seen = spark.createDataFrame(rows, "user_id bigint, area_id bigint")
    pool = users.join(scopes, "scope").select("user_id", "area_id")
    want = {tuple(r) for r in adjacency.enclosed_regions(adj, per, pool, seen).collect()}
    listed, plain = [], adjacency.enclosed_regions
    monkeypatch.setattr(adjacency, "enclosed_regions", lambda adj, per, pool, *rest: listed.append(pool.count()) or plain(adj, per, pool, *rest))
    views = types.SimpleNamespace(visits=seen)
    monkeypatch.setattr(neighbor_queries, "adj", lambda v: adj)
    monkeypatch.setattr(neighbor_queries, "per", lambda v: per)
    monkeypatch.setattr(neighbor_queries, "strips", lambda v: (users.withColumnRenamed("scope", "strip"), scopes.withColumnRenamed("scope", "strip")))
    assert {tuple(r) for r in neighbor_queries.regions(views).collect()} == want and len(want) > 20
    assert listed[0] < 0.8 * pool.count()


def test_rim_prefers_the_country_border(spark):
    shapes = {1: [[square(15, 50, 0.05)]], 2: [[square(15.1, 50, 0.05)]], 3: [[square(14.9, 50, 0.05)]]}
    a, adj, _ = adjacent(spark, shapes, country={1: 1, 2: 2, 3: 1})
    assert {r.area_id for r in adjacency.border_areas(adj, a, visited(spark, [1, 2, 3])).collect()} == {1, 2}


def test_long_chain_is_one_component(spark):
    n = 300
    edges = spark.range(n - 1).selectExpr("1L AS user_id", "id AS area_id", "id + 1 AS nbr_id")
    edges = edges.unionByName(edges.selectExpr("user_id", "nbr_id AS area_id", "area_id AS nbr_id"))
    labels = adjacency.components(edges, spark.range(n).selectExpr("1L AS user_id", "id AS area_id"))
    assert labels.select("label").distinct().count() == 1


def test_four_points(spark):
    p = spark.createDataFrame([(0, 21.0, 52.00), (1, 21.0, 52.01), (2, 21.0, 52.02), (3, 22.0, 52.00)], "area_id bigint, lng double, lat double")
    near = {r.area_id: r.km for r in neighbors.nearest_dist(p).collect()}
    assert near[0] == pytest.approx(1.11, abs=0.01) and near[3] == pytest.approx(68.3, abs=0.5)
    assert {r.area_id: r.n for r in neighbors.count_within(p, 1.5).collect()}[1] == 2
    assert {r.area_id: r.n for r in neighbors.count_within(p, 100.0).collect()}[0] == 3
    assert [r.nbr_id for r in neighbors.knn(p, 2).where("area_id = 0").orderBy("rank").collect()] == [1, 2]
    q = spark.createDataFrame([(9, 21.0, 52.003)], "qid bigint, lng double, lat double")
    assert neighbors.nearest_to(p, q).first().area_id == 0
    assert neighbors.nearest_dist(p.where("area_id = 0")).count() == 0


def test_baseline_scores(spark):
    line = spark.createDataFrame([(1, i, 14.0 + 0.04 * i, 50.0) for i in range(100)], "plan_id bigint, seq int, lng double, lat double")
    lats = [0, 0.07, 0.15, 0.27, 0.45, 0.70]
    pts = spark.createDataFrame([(1, i, 15.0, 50.0 + d) for i, d in enumerate(lats)], "plan_id bigint, area_id bigint, lng double, lat double")
    km = {r.area_id: r.km for r in neighbors.min_dist(pts, line).collect()}
    detour = [2 * km[i] + 0.2 for i in range(6)]
    assert detour[1] == pytest.approx(15.8, abs=2) and detour[5] > 120 and detour == sorted(detour)
    a, v = frames(spark, {1: [[square(15, 50, 0.05)]]})
    samples = areas.entry_samples(a, v).collect()
    off = [max(abs(r.lng - 15), abs(r.lat - 50)) for r in samples]
    assert 1 <= len(samples) <= 5 and all(0.04 < o <= 0.05 for o in off)


def test_passages_merge_and_split(spark):
    idx = coverage.area_index(*frames(spark, {1: [[square(15, 50, 0.05)]]}))
    line = [(14.9, 50), (15.0, 50), (15.01, 50), (15.1, 50), (15.02, 50.01), (15.03, 50.01)]
    rows = coverage.passages(track(spark, line), idx).orderBy("n").collect()
    assert [r.first_seq for r in rows] == [1, 4]
    cos = math.cos(math.radians(50))
    edge = 220 / METERS_PER_DEG / cos
    assert rows[0].entry_lng == pytest.approx(14.95 + edge, abs=1e-7) and rows[0].exit_lng == pytest.approx(15.05 - edge, abs=1e-7)
    assert rows[1].exit_lng == pytest.approx(15.03)
