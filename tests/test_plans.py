import random

from pyspark.sql import functions as F

from trackspark.operators import adjacency, tracks
import trackspark.plans.nearest as module
from trackspark.plans import chunks, ranges
from trackspark.plans.nearest import nearest


def seq_frame(spark, n=100, keys=3):
    rng = random.Random(1)
    rows = [(k, i, rng.random(), rng.choice([None, rng.random()])) for k in range(keys) for i in range(n // (k + 1))]
    return spark.createDataFrame(rows, "k int, i int, x double, y double"), rows


def test_chunked_scans_equal_plain_ones(spark):
    df, rows = seq_frame(spark)
    near = {(r.k, r.i): (r.p, r.n) for r in chunks.with_neighbors(df, "k", "i", {"p": "x"}, {"n": "x"}, size=7).collect()}
    run = {(r.k, r.i): r.s for r in chunks.running_sum(df, "k", "i", {"s": F.col("x")}, size=7).collect()}
    fwd = {(r.k, r.i): r.f for r in chunks.fill_forward(df, "k", "i", {"f": F.col("y")}, size=7).collect()}
    back = {(r.k, r.i): r.f for r in chunks.fill_forward(df, "k", "i", {"f": F.col("y")}, size=7, backward=True).collect()}
    top = {(r.k, r.i): r.m for r in chunks.running_max(df, "k", "i", "x", "m", size=7).collect()}
    gaps = {(r.k, r.i): r.p for r in chunks.with_previous(df.where("i % 5 <> 0"), "k", "i", {"p": "i"}, size=7).collect()}
    by = {}
    for k, i, x, y in rows:
        by.setdefault(k, []).append((i, x, y))
    assert len(near) == len(rows)
    for k, items in by.items():
        total, last, best, prev = 0.0, None, None, None
        for j, (i, x, y) in enumerate(items):
            total += x
            last = y if y is not None else last
            assert abs(run[k, i] - total) < 1e-9 and fwd[k, i] == last and top[k, i] == best
            assert near[k, i] == (items[j - 1][1] if j else None, items[j + 1][1] if j + 1 < len(items) else None)
            assert back[k, i] == next((v for _, _, v in items[j:] if v is not None), None)
            if i % 5:
                assert gaps[k, i] == prev
                prev = i
            best = x if best is None else max(best, x)


def test_hot_key_is_spread_over_tasks(spark):
    df = spark.range(1000).selectExpr("1 AS k", "CAST(id AS INT) AS i", "1.0D AS x")
    parts = chunks.with_chunk(df, "i", 100).select("_chunk").distinct().count()
    assert parts == 10
    assert chunks.running_sum(df, "k", "i", {"s": F.col("x")}, size=100).agg(F.max("s")).first()[0] == 1000


def test_top_k(spark):
    df = spark.range(200).selectExpr("id % 3 AS k", "pmod(id * 37, 101) AS v", "id")
    got = {(r.k, r.id) for r in chunks.top_k(df, "k", [F.col("v"), F.col("id")], 5).collect()}
    rows = df.collect()
    want = {(k, r.id) for k in range(3) for r in sorted((x for x in rows if x.k == k), key=lambda x: (x.v, x.id))[:5]}
    assert got == want


def test_range_joins(spark):
    rng = random.Random(2)
    pts = [(k, rng.randrange(100)) for k in range(2) for _ in range(50)]
    spans = [(k, a, a + rng.randrange(1, 40)) for k in range(2) for a in (rng.randrange(100) for _ in range(20))]
    p, s = spark.createDataFrame(pts, "k int, x int"), spark.createDataFrame(spans, "k int, lo int, hi int")
    assert ranges.points_in_ranges(p, s, ["k"], "x", "lo", "hi", width=8).count() == sum(a == b and lo <= x <= hi for a, x in pts for b, lo, hi in spans)
    b = s.withColumnsRenamed({"lo": "lo2", "hi": "hi2"})
    got = ranges.overlaps(s, b, ["k"], "lo", "hi", "lo2", "hi2", width=8).count()
    assert got == sum(a == b and max(l1, l2) < min(h1, h2) for a, l1, h1 in spans for b, l2, h2 in spans)


def test_nearest_is_exact_with_copies_and_clusters(spark):
    rng = random.Random(3)
    sites = [(i, rng.gauss(0, 1) if i % 3 else 5.0, rng.gauss(0, 300) if i % 5 else 0.0) for i in range(300)]
    asks = [(i, rng.uniform(-400, 400), rng.uniform(-400, 400)) for i in range(60)]
    s = spark.createDataFrame(sites, "sid int, sx double, sy double").withColumns({"sz": F.lit(0.0), "sr": F.lit(0.0)})
    q = spark.createDataFrame(asks, "qid int, qx double, qy double").withColumn("qz", F.lit(0.0))
    d = F.hypot(F.col("sx") - F.col("qx"), F.col("sy") - F.col("qy"))
    for k in (1, 4):
        out = nearest(q, s, d, k, levels=4, root=1600.0, slack=1e-9).collect()
        got = {(r.qid, r["rank"]): r.sid for r in out}
        for qi, x, y in asks:
            want = sorted((((a - x) ** 2 + (b - y) ** 2) ** 0.5, i) for i, a, b in sites)[:k]
            assert [got[qi, j + 1] for j in range(k)] == [i for _, i in want]


def stepped(x0, y0, x1, y1):
    """Grid cells by stepping to the nearer grid line, rows before columns on a tie."""
    from math import floor, inf

    x, y, ex, ey = floor(x0), floor(y0), floor(x1), floor(y1)
    dx, dy = x1 - x0, y1 - y0
    sx, sy = (1 if dx > 0 else -1), (1 if dy > 0 else -1)
    tx = ((x + 1 - x0) if sx > 0 else (x0 - x)) / abs(dx) if dx else inf
    ty = ((y + 1 - y0) if sy > 0 else (y0 - y)) / abs(dy) if dy else inf
    out = {(x, y)}
    while (x, y) != (ex, ey):
        if tx < ty:
            x, tx = x + sx, tx + 1 / abs(dx)
        else:
            y, ty = y + sy, ty + 1 / abs(dy)
        out.add((x, y))
    return out


def test_segment_tiles_against_stepping(spark):
    rng = random.Random(4)
    segs = [tuple(rng.uniform(100, 108) for _ in range(4)) for _ in range(300)] + [(100.5, 100.5, 104.5, 100.5), (101.5, 104.2, 101.5, 100.1)]
    df = spark.createDataFrame([(i, *s) for i, s in enumerate(segs)], "i int, x0 double, y0 double, x1 double, y1 double")
    cells = tracks.segment_tiles(F.col("x0"), F.col("y0"), F.col("x1"), F.col("y1"), 14)
    for r in df.select("i", cells.alias("c")).collect():
        assert {(c.x, c.y) for c in r.c} == stepped(*segs[r.i])


def _guess(df) -> int:
    """Bytes the optimizer expects."""
    return int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))


def test_rounds_do_not_inflate_the_guessed_size(spark):
    n = 300
    edges = spark.range(n - 1).selectExpr("1L AS user_id", "id AS area_id", "id + 1 AS nbr_id")
    edges = edges.unionByName(edges.selectExpr("user_id", "nbr_id AS area_id", "area_id AS nbr_id"))
    labels = adjacency.components(edges, spark.range(n).selectExpr("1L AS user_id", "id AS area_id"))
    assert _guess(labels) < 1_000_000 and {(r.user_id, r.label) for r in labels.collect()} == {(1, 0)}


def test_groups_of_few_sites_are_joined_once(spark, monkeypatch):
    """Only groups of many sites walk the cells; both ways find the same."""
    rng = random.Random(8)
    place = lambda: (rng.choice([0.1, rng.random()]), rng.random(), 0.0)
    sites = spark.createDataFrame([(g, i, *place(), 0.0) for g, n in ((1, 20), (2, 400), (3, 1)) for i in range(n)], "g int, sid int, sx double, sy double, sz double, sr double")
    queries = spark.createDataFrame([(g, i, *place()) for g in (1, 2, 3, 4) for i in range(30)], "g int, qid int, qx double, qy double, qz double")
    metric = F.hypot(F.col("sx") - F.col("qx"), F.col("sy") - F.col("qy"))
    searched, plain = [], module._searched
    monkeypatch.setattr(module, "_searched", lambda q, s, *rest: searched.append((q.count(), s.count())) or plain(q, s, *rest))
    for k in (1, 3):
        pairs = {}
        for q in queries.collect():
            for s in sites.where(F.col("g") == q.g).collect() if q.qid == 0 else pairs[q.g, "s"]:
                pairs.setdefault((q.g, "s"), []).append(s) if q.qid == 0 else None
                pairs.setdefault((q.g, q.qid), []).append(((s.sx - q.qx) ** 2 + (s.sy - q.qy) ** 2, s.sid))
            pairs.setdefault((q.g, "s"), [])
        want = {(g, q, n + 1, sid) for (g, q), found in pairs.items() if q != "s" for n, (_, sid) in enumerate(sorted(found)[:k])}
        out = nearest(queries, sites, metric, k, ["g"], root=1.0, slack=1e-9)
        assert {(r.g, r.qid, r["rank"], r.sid) for r in out.collect()} == want
    assert searched == [(30, 400)] * 2
