import math
import random

import pytest
from pyspark.sql import functions as F

from trackspark.operators import days, elevation, stats, tracks


def profile(spark, peak):
    rows = [(1, i, i * 1_000_000 / 199, max(0.0, 3000.0 - abs(i - 60) * 100) if peak else 100.0) for i in range(200)]
    return spark.createDataFrame(rows, "track_id bigint, i int, cum_m double, ele double")


def test_flat_profile_splits_evenly(spark):
    d = spark.createDataFrame([(1, 10)], "track_id bigint, days int")
    rows = days.split_days(profile(spark, False), d).orderBy("day").collect()
    assert len(rows) == 10 and all(abs(r.km - 100) <= 10 for r in rows)
    assert sum(r.km for r in rows) == pytest.approx(1000, abs=1)
    assert days.split_days(profile(spark, False), spark.createDataFrame([(1, 0)], "track_id bigint, days int")).count() == 0


def test_hilly_profile_gives_uneven_days(spark):
    d = spark.createDataFrame([(1, 10)], "track_id bigint, days int")
    km = [r.km for r in days.split_days(profile(spark, True), d).collect()]
    assert max(km) - min(km) > 10


def sequential_days(e, n_days):
    """Day by day: the first sample after the last boundary reaching the target."""
    n = len(e)
    d = n_days if n_days < n else max(1, n - 1)
    out, start = [], 0
    for day in range(1, d + 1):
        if day == d:
            out.append((start, n - 1))
            break
        end = start
        for i in range(start + 1, n):
            end = i
            if e[i] >= e[-1] / d * day:
                break
        if end <= start:
            break
        out.append((start, end))
        start = end
    return out


def test_split_matches_sequential_rule(spark):
    rng = random.Random(5)
    rows, plan, want = [], [], {}
    for t in range(40):
        n = rng.randrange(2, 14)
        cum = 0.0
        eff = [0.0]
        for i in range(n):
            if i:
                step = rng.choice([0.0, 100.0, 900.0, 5000.0])
                cum += step
                eff.append(eff[-1] + step / 1000)
            rows.append((t, i, cum, 0.0))
        k = rng.randrange(1, 10)
        plan.append((t, k))
        want[t] = sequential_days(eff, k)
    got = {}
    frame = spark.createDataFrame(rows, "track_id bigint, i int, cum_m double, ele double")
    for r in days.split_days(frame, spark.createDataFrame(plan, "track_id bigint, days int")).orderBy("track_id", "day").collect():
        got.setdefault(r.track_id, []).append((r.start_i, r.end_i))
    assert got == want


def test_track_length(spark):
    pts = spark.createDataFrame([(1, 0, 14.0, 50.0), (1, 1, 14.0, 51.0), (1, 2, 15.0, 51.0)], "track_id bigint, seq int, lng double, lat double")
    assert tracks.track_length(pts).first().km == pytest.approx(181.2, abs=2)


def test_tile_lines(spark):
    from trackspark.functions.tiles import tile_center

    def line(cells):
        rows = spark.createDataFrame([(1, i, x, y) for i, (x, y) in enumerate(cells)], "track_id bigint, seq int, x bigint, y bigint")
        pts = rows.withColumn("c", tile_center("x", "y", 14)).select("track_id", "seq", "c.lng", "c.lat")
        return {(r.tile_key // 131072, r.tile_key % 131072) for r in tracks.track_tiles(pts).collect()}

    assert line([(8800, 5373), (8803, 5373)]) == {(x, 5373) for x in range(8800, 8804)}
    diagonal = line([(8800, 5373), (8803, 5376)])
    assert len(diagonal) >= 7 and all(any(abs(a - c) + abs(b - d) == 1 for c, d in diagonal) for a, b in diagonal)
    assert len(line([(8800, 5373)])) == 1


@pytest.fixture
def dem(spark):
    rows = [(50, 14, 3, r, c, r * 10 + c) for r in range(3) for c in range(3)]
    return spark.createDataFrame(rows, "tile_lat int, tile_lng int, n int, r int, c int, ele int")


def test_dem_sampling(spark, dem):
    pts = spark.createDataFrame([(0, 14.5, 50.5), (1, 14.25, 50.75), (2, 14.0, 50.999999999), (3, 14.999999999, 50.0), (4, 99.0, 10.0)], "i int, lng double, lat double")
    got = {r.i: r.ele for r in elevation.sample_dem(pts, dem).collect()}
    assert got[0] == pytest.approx(11) and got[1] == pytest.approx(5.5) and got[2] == pytest.approx(0, abs=1e-6)
    assert got[3] == pytest.approx(22, abs=1e-6) and got[4] == 0
    void = dem.withColumn("ele", F.when((F.col("r") == 0) & (F.col("c") == 0), None).otherwise(F.col("ele")))
    corner = spark.createDataFrame([(0, 14.0, 50.9999999999)], "i int, lng double, lat double")
    assert elevation.sample_dem(corner, void).first().ele == pytest.approx(1, abs=1e-6)


def messages(spark, rows):
    return spark.createDataFrame(rows, "track_id bigint, row_no int, key_lng bigint, key_lat bigint, dist_m bigint, way_tags string")


def test_flat_spans(spark):
    pts = spark.createDataFrame([(1, i, 14.0 + i / 100, 50.0) for i in range(3)], "track_id bigint, seq int, lng double, lat double")
    key = lambda i: (14_000_000 + i * 10_000, 50_000_000)

    def spans(a, b, end=key(2)):
        m = messages(spark, [(1, 1, *key(1), 10, a), (1, 2, *end, 10, b)])
        return [(r.start_idx, r.end_idx) for r in stats.flat_spans(stats.match_endpoints(m, pts)).collect()]

    assert spans("tunnel=yes", "highway=x") == [(0, 1)]
    assert spans("highway=x", "bridge=yes") == [(1, 2)]
    assert spans("bridge=no", "tunnel=no") == []
    assert spans("tunnel=yes", "bridge=yes") == [(0, 2)]
    assert spans("tunnel=yes", "bridge=yes", end=(1, 1)) == []


def greedy(keys, wants):
    out, ptr = [], 0
    for w in wants:
        hit = next((i for i in range(ptr, len(keys)) if keys[i] == w), None)
        out.append(hit)
        ptr = hit if hit is not None else ptr
    return out


def test_endpoint_matching_with_repeated_vertices(spark):
    rng = random.Random(6)
    pts, msgs, want = [], [], {}
    for t in range(12):
        keys = [rng.randrange(4) for _ in range(25)]
        pts += [(t, i, 14.0 + k / 100, 50.0) for i, k in enumerate(keys)]
        path = sorted(rng.sample(range(25), 8))
        asked = [keys[i] for i in path]
        msgs += [(t, r + 1, 14_000_000 + k * 10_000, 50_000_000, 10, "") for r, k in enumerate(asked)]
        want[t] = greedy(keys, asked)
    p = spark.createDataFrame(pts, "track_id bigint, seq int, lng double, lat double")
    got = {}
    for r in stats.match_endpoints(messages(spark, msgs), p).orderBy("track_id", "row_no").collect():
        got.setdefault(r.track_id, []).append(r.end_idx)
    assert got == want


def greedy_windows(cum, reach):
    out, i = [], 0
    while i < len(cum) - 1:
        j = i
        while j + 1 < len(cum) and cum[j + 1] - cum[i] <= reach:
            j += 1
        j = max(j, i + 1)
        out.append((i, j))
        i = j
    return out


def test_elevation_windows(spark):
    rng = random.Random(7)
    rows = []
    for t in range(5):
        lat = 50.0
        for i in range(rng.randrange(2, 60)):
            rows.append((t, i, 14.0, lat))
            lat += rng.choice([0.01, 0.2, 0.5, 1.5])
    p = spark.createDataFrame(rows, "track_id bigint, seq int, lng double, lat double")
    cum = {}
    for r in tracks.cum_distance(p).orderBy("track_id", "seq").collect():
        cum.setdefault(r.track_id, []).append(r.cum_m)
    got = {}
    for r in elevation.elevation_windows(p).orderBy("track_id", "start_i").collect():
        got.setdefault(r.track_id, []).append((r.start_i, r.end_i))
    assert got == {t: greedy_windows(c, 120_000.0) for t, c in cum.items() if len(c) > 1}


def test_climb_windows_are_added_in_track_order(spark):
    """Partial sums that an aggregation spills and merges again must not move a gain of about one half."""
    rng = random.Random(5)
    values, want = {}, {}
    for t in range(400):
        # Rising steps of 0.03 m times whole numbers that make up one half in the end.
        steps = [rng.randrange(1, 400) for _ in range(19)]
        steps.append((50 - sum(steps)) % 100 + 100)
        v = values[t] = [round(sum(steps[:i]) / 100, 2) * 3.0 for i in range(21)]
        total = 0.0
        for a, b in zip(v, v[1:]):
            total += max(0.0, b - a)
        want[t] = math.floor(total + 0.5)
    rows = [(t, i, x) for t, v in values.items() for i, x in enumerate(v)]
    points = spark.createDataFrame(rows, "track_id long, seq int, ele double")
    spark.conf.set("spark.sql.TungstenAggregate.testFallbackStartsAt", "20, 47")
    try:
        got = {r.track_id: r.climb_m for r in tracks.climb_m(points, window=20).collect()}
    finally:
        spark.conf.unset("spark.sql.TungstenAggregate.testFallbackStartsAt")
    assert got == want
