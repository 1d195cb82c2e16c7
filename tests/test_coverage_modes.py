"""Several coverage modes in one pass, and borders: NumPy tests over batches against the expressions of one row."""

import random

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from suite import load
from suite.registry import QUERIES
from trackspark.functions import edge_batches
from trackspark.functions.geo import METERS_PER_DEG
from trackspark.functions.polygons import TOUCH, blocked_sql, gaps_sql
from trackspark.operators import adjacency, coverage

from test_area_cells import wavy
from test_areas import frames, square, track


def test_batches_equal_expressions(spark, monkeypatch):
    """Every pair of a stretch and a cell, also in many small slices; paths along edges, repeated vertices and a one-point track come along."""
    rng = random.Random(3)
    shapes = {1: [[square(15.0, 50.0, 0.02), square(15.0, 50.0, 0.008)]], 2: [[wavy(60, 0.03, 5, 0.4, 15.06, 50.01)]], 3: [[square(15.03, 50.0, 0.01)]]}
    index = coverage.area_index(*frames(spark, shapes))
    lines = [[(rng.uniform(14.96, 15.1), rng.uniform(49.97, 50.04)) for _ in range(40)] for _ in range(4)]
    lines += [[(14.98, 49.9), (14.98, 50.1)], [(15.012, 50.012)] * 3, [(15.015, 50.015)], [(15.03, 49.98), (15.03, 50.0), (15.03, 50.0)]]
    points = track(spark, *lines)
    modes = ("full", "credit", "deep")
    got = {(r.track_id, r.area_id): tuple(r[m] for m in modes) for r in coverage.area_coverages(points, index, modes).collect()}
    seg = coverage.track_segments(points, index)
    pairs = coverage.cell_pieces(seg.where("NOT lone"), index.cell).join(index.cells, ["cx", "cy"])
    want = {}
    for n, m in enumerate(modes):
        rows = pairs.withColumn("_d", F.expr(coverage.CORES[m])).withColumn("_r", F.greatest("_d", F.lit(TOUCH)))
        rows = rows.withColumn("_z", F.expr(blocked_sql("edges", "x", "y", "vx", "vy", "_r"))).withColumn("_g", F.expr(gaps_sql("_z", "t0", "t1")))
        mid = "(g.lo + g.hi) / 2"
        free = f"exists(_g, g -> {index.inside(f'(x + {mid} * vx)', f'(y + {mid} * vy)')})"
        hit = rows.where(F.expr(f"{free} OR (_d <= 0D AND exists(_z, z -> z.hi >= t0 AND z.lo <= t1))")).select("track_id", "area_id")
        if m != "deep":
            hit = hit.unionByName(coverage.locate_points(seg.where("lone"), ["track_id"], index))
        for r in hit.distinct().collect():
            want.setdefault((r.track_id, r.area_id), [False] * 3)[n] = True
    assert got == {k: tuple(f) for k, f in want.items()}
    assert {f for f in got.values()} >= {(True, True, True), (True, False, False)}
    batch = pa.RecordBatch.from_pylist([{"edges": [dict.fromkeys(("ax", "ay", "bx", "by", "ux", "uy", "len"), 0.0)] * (k % 4)} for k in range(50)])
    monkeypatch.setattr(edge_batches, "EDGES", 7)
    parts = list(edge_batches.slices(batch))
    assert sum(p.num_rows for p in parts) == 50 and len(parts) > 5
    assert np.concatenate([edge_batches.Edges(p).count for p in parts]).tolist() == [k % 4 for k in range(50)]


def test_two_modes_meet_the_cells_once(spark):
    folder = "/root/testdata/sf0.001"
    load()
    for name in ("coverage_diff", "coverage_except", "coverage_intersect"):
        plan = QUERIES[name](spark, folder)._jdf.queryExecution().optimizedPlan().toString()
        assert plan.count("MapInArrow") == 1 and "cx" in plan, name


def test_fraction_of_asked_areas_only(spark):
    """The share along visited areas, asked for some areas, equals that of all; borders equal the expressions of one row."""
    step = 0.02
    shapes = {i: [[square(15.0 + step * (i % 4), 50.0 + step * (i // 4), step / 2)]] for i in range(12)}
    shapes[12] = [[wavy(30, 0.03, 4, 0.3, 15.03, 50.02)]]
    index = adjacency.neighbor_index(*frames(spark, shapes))
    adj, per = adjacency.adjacency(index), adjacency.perimeters(index)
    visits = spark.createDataFrame([(u, (u * 5 + k * 3) % 13) for u in (1, 2) for k in range(4)], "user_id long, area_id long").distinct()
    asked = spark.createDataFrame([(1, 0), (1, 5), (1, 5), (2, 6), (2, 99), (3, 1)], "user_id long, area_id long")
    rows = lambda df: {(r.user_id, r.area_id): round(r.fraction, 9) for r in df.collect()}
    every, some = rows(adjacency.neighbor_fraction(adj, per, visits)), rows(adjacency.neighbor_fraction(adj, per, visits, asked))
    wanted = {(r.user_id, r.area_id) for r in asked.collect()}
    assert some and some == {k: f for k, f in every.items() if k in wanted}
    got = {(r.area_id, r.nbr_id): r.shared_km for r in adj.collect()}
    tol = adjacency.ADJACENCY_M / METERS_PER_DEG
    seg = index.geoms.select(F.col("area_id").alias("own_id"), F.explode("edges").alias("b")).selectExpr("own_id", "b.ax AS x", "b.ay AS y", "b.bx - b.ax AS vx", "b.by - b.ay AS vy")
    pairs = coverage.cell_pieces(seg, index.cell).join(index.cells, ["cx", "cy"]).where("own_id <> area_id").withColumn("_r", F.lit(tol))
    pairs = pairs.withColumn("_g", F.expr(gaps_sql(blocked_sql("edges", "x", "y", "vx", "vy", "_r"), "t0", "t1")))
    mid = "(g.lo + g.hi) / 2"
    out = f"aggregate(filter(_g, g -> NOT {index.inside(f'(x + {mid} * vx)', f'(y + {mid} * vy)')}), 0D, (s, g) -> s + (g.hi - g.lo))"
    km = pairs.withColumn("km", (F.expr(f"t1 - t0 - {out}")) * F.hypot("vx", "vy") * METERS_PER_DEG / 1000.0).where("km > 1e-9")
    want = {(r.own_id, r.area_id): r.km for r in km.groupBy("own_id", "area_id").agg(F.sum("km").alias("km")).collect()}
    assert set(got) == set(want) | {(b, a) for a, b in want}
    assert all(abs(v - want.get(k, 0.0)) < 1e-9 for k, v in got.items())


def test_segments_are_dealt_by_block_not_by_cell(spark, monkeypatch):
    """A long segment is one row per block before the shuffle; blocks dealt in many parts give the same pairs."""
    rng = random.Random(5)
    shapes = {i: [[square(15.0 + 0.01 * (i % 8), 50.0 + 0.01 * (i // 8), 0.004)]] for i in range(64)}
    index = coverage.area_index(*frames(spark, shapes))
    points = track(spark, *[[(rng.uniform(14.98, 15.1), rng.uniform(49.98, 50.1)) for _ in range(30)] for _ in range(3)])
    seg = coverage.track_segments(points, index).where("NOT lone")
    by_block, by_cell = coverage.cell_pieces(seg, index.cell * coverage.BLOCK).count(), coverage.cell_pieces(seg, index.cell).count()
    cells = index.cells.selectExpr("*", f"floor(cx / {coverage.BLOCK}) AS bx", f"floor(cy / {coverage.BLOCK}) AS by")
    dealt = coverage.in_blocks(seg.select("track_id", "seq", "x", "y", "vx", "vy"), cells, coverage.crowded_blocks(points, cells, index), index.cell)
    assert dealt.where("seq IS NOT NULL").count() == by_block and by_cell > 3 * by_block
    whole = {tuple(r) for r in coverage.area_coverages(points, index, ("full", "credit")).collect()}
    monkeypatch.setattr(coverage, "PART_SEGMENTS", 7)
    monkeypatch.setattr(coverage, "PART_EDGES", 40)
    assert len(whole) > 100 and {tuple(r) for r in coverage.area_coverages(points, index, ("full", "credit")).collect()} == whole
