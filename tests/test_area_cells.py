"""The cell index of areas: own edges per cell, corners, nearest edges, and no use of whole polygons."""

import math
import random
from dataclasses import replace

import numpy as np
import pytest
from pyspark.sql import functions as F

from trackspark.functions.geo import METERS_PER_DEG
from trackspark.operators import coverage
from trackspark.plans.lineage import materialize

from test_areas import depth_at, frames, square, track


def wavy(n, radius, waves, height, cx=15.0, cy=50.0):
    out = []
    for k in range(n):
        a = 2 * math.pi * k / n
        r = radius * (1 + height * math.sin(waves * a))
        out.append((cx + r * math.cos(a), cy + r * math.sin(a)))
    return out


def test_polygon_of_100_000_vertices(spark):
    ring, hole = wavy(100_000, 0.5, 900, 0.01), wavy(2_000, 0.12, 30, 0.05)
    a, v = frames(spark, {1: [[ring, hole]]}, rep={1: (15.3, 50.0)})
    idx = coverage.area_index(a, v)
    idx = replace(idx, cells=materialize(idx.cells))
    edges = 102_000
    cells = idx.cells.select("corner_in", F.size("edges").alias("n")).collect()
    assert sum(r.n for r in cells) < 3 * edges
    assert sum(r.n == 0 for r in cells) > 30 and all(r.corner_in for r in cells if r.n == 0)
    cos = math.cos(math.radians(50.0))
    rng = random.Random(2)
    where = [(15 + rng.uniform(-0.55, 0.55), 50 + rng.uniform(-0.55, 0.55)) for _ in range(150)]
    x, y = np.array([p[0] * cos for p in where]), np.array([p[1] for p in where])
    deep = np.minimum(depth_at(ring, cos, x, y), -depth_at(hole, cos, x, y))
    for core, least in (("full", 0.0), ("deep", 220 / METERS_PER_DEG)):
        found = {r.seq for r in coverage.locate_points(track(spark, where), ["track_id", "seq"], idx, core).collect()}
        assert found == set(np.flatnonzero(deep > least).tolist())


def test_depth_far_from_any_edge(spark):
    ring = wavy(3_000, 0.5, 60, 0.02)
    idx = coverage.area_index(*frames(spark, {1: [[ring]]}, rep={1: (15.3, 50.0)}))
    cos, rng = math.cos(math.radians(50.0)), random.Random(4)
    where = [(15.0, 50.0)] + [(15 + rng.uniform(-0.55, 0.55), 50 + rng.uniform(-0.55, 0.55)) for _ in range(100)]
    deep = depth_at(ring, cos, [p[0] * cos for p in where], [p[1] for p in where])
    found = {r.seq: r.depth_m for r in coverage.depths(track(spark, where), ["track_id", "seq"], idx).collect()}
    assert set(found) == set(np.flatnonzero(deep > 0).tolist()) and max(found.values()) > 30_000
    assert all(abs(found[i] - deep[i] * METERS_PER_DEG) < 1e-3 for i in found)


def test_whole_polygons_are_not_joined(spark):
    idx = coverage.area_index(*frames(spark, {1: [[square(15, 50, 0.1), square(15, 50, 0.03)]]})).stored()
    points = track(spark, [(14.8, 50.06), (15.07, 50.06), (15.2, 50.06)])
    assert "geoms" in idx.geoms._jdf.queryExecution().toString()
    for made in (coverage.passages(points, idx), coverage.entry_points(points, idx), coverage.depths(points, ["track_id", "seq"], idx), coverage.area_coverage(points, idx)):
        assert made.count() == 1 and "/geoms-" not in made._jdf.queryExecution().toString()


@pytest.mark.parametrize("cell", [0.05, 0.013])
def test_random_parts_holes_and_cell_lines(spark, cell):
    """Irregular areas against plain Python, with corners and edges on cell lines and points on them."""
    rng = random.Random(7)
    shapes = {1: [[square(15.0, 50.0, 0.1), square(15.0, 50.0, 0.05)]], 2: [[wavy(40, 0.2, 5, 0.5, 15.6, 50.3)], [square(16.2, 50.1, 0.05)]], 3: [[[(14.0, 49.9), (14.7, 50.2), (14.1, 50.25)]]]}
    idx = coverage.area_index(*frames(spark, shapes, rep={2: (15.6, 50.3)}), cell=cell)
    cos = idx.geoms.select(idx.cos).first()[0]
    where = [(rng.uniform(13.9, 16.4), rng.uniform(49.8, 50.6)) for _ in range(800)] + [(15.0 + rng.uniform(-0.2, 0.2), round(rng.uniform(49.9, 50.1) / cell) * cell + 1e-7) for _ in range(100)]
    x, y = np.array([p[0] * cos for p in where]), np.array([p[1] for p in where])
    want = {}
    for i, parts in shapes.items():
        rings = [depth_at(r, cos, x, y) for rings in parts for r in rings]
        odd = sum((d > 0).astype(int) for d in rings) % 2 == 1
        want |= {(int(k), i): min(abs(d[k]) for d in rings) * METERS_PER_DEG for k in np.flatnonzero(odd)}
    got = {(r.seq, r.area_id): r.depth_m for r in coverage.depths(track(spark, where), ["track_id", "seq"], idx).collect()}
    assert got.keys() == want.keys() and all(abs(got[k] - want[k]) < 1e-3 for k in got)
    full = {(r.seq, r.area_id) for r in coverage.members(track(spark, where), idx).collect()}
    assert full == set(want)


def test_grid_suits_small_areas(spark):
    """Many small areas in one land: a cell holds few of them and the table of cells grows with their number only."""
    step = 0.01
    shapes = {i: [[square(15.0 + step * (i % 20), 50.0 + step * (i // 20), step / 2)]] for i in range(400)}
    idx = coverage.area_index(*frames(spark, shapes))
    assert idx.cell < coverage.CELL_DEG and idx.cells.count() <= coverage.CELLS_PER_AREA * 400
    assert idx.cells.groupBy("cx", "cy").count().agg({"count": "max"}).first()[0] <= 9


def test_deep_core_without_fallback(spark):
    """An area that nowhere is 220 m deep has its credit core as deep core, or none."""
    shapes = {1: [[square(15.0, 50.0, 0.002)]]}
    where = track(spark, [(15.0, 50.0)])
    assert coverage.members(where, coverage.area_index(*frames(spark, shapes)), "deep").count() == 1
    assert coverage.members(where, coverage.area_index(*frames(spark, shapes), fallback=False), "deep").count() == 0
