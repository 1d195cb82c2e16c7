import math

import pytest
from pyspark.sql import functions as F

from trackspark.functions import budget, geo, names, tags, tiles


def one(spark, **cols):
    return spark.range(1).select(*[c.alias(n) for n, c in cols.items()]).first()


def test_tile_references(spark):
    rows = [(0.0, 0.0, 14, 8192, 8192), (13.37771, 52.51628, 14, 8800, 5373), (19.94, 50.06, 14, 9099, 5552), (19.94, 50.06, 16, 36397, 22209), (5.0, 5.0, 0, 0, 0)]
    for lng, lat, z, x, y in rows:
        a, b = tiles.tile_xy(F.lit(lng), F.lit(lat), z)
        assert tuple(one(spark, x=a, y=b)) == (x, y)
    a, _ = tiles.tile_xy(F.lit(180.0), F.lit(0.0), 14)
    b, _ = tiles.tile_xy(F.lit(-180.0), F.lit(0.0), 14)
    assert tuple(one(spark, a=a, b=b)) == ((1 << 14) - 1, 0)


def test_tile_ring_is_closed(spark):
    ring = one(spark, r=tiles.tile_ring(F.lit(100), F.lit(200), 14))["r"]
    assert len(ring) == 5 and ring[0] == ring[-1]
    key = one(spark, k=tiles.tile_key(F.lit(8800), F.lit(5373)))["k"]
    back = one(spark, x=tiles.key_x(F.lit(key)), y=tiles.key_y(F.lit(key)))
    assert tuple(back) == (8800, 5373)


def test_distances(spark):
    assert one(spark, d=geo.haversine_km(F.lit(14.42), F.lit(50.08), F.lit(21.26), F.lit(48.72)))["d"] == pytest.approx(518, abs=10)
    assert one(spark, d=geo.haversine_km(F.lit(14.0), F.lit(50.0), F.lit(14.0), F.lit(50.0)))["d"] == 0
    assert one(spark, d=geo.haversine_km(F.lit(None).cast("double"), F.lit(50.0), F.lit(14.0), F.lit(50.0)))["d"] is None


def test_move_and_extend(spark):
    r = one(spark, near=geo.move_towards(F.lit(14.0), F.lit(50.0), F.lit(14.0), F.lit(50.001), F.lit(500.0)),
            part=geo.move_towards(F.lit(14.0), F.lit(50.0), F.lit(14.0), F.lit(51.0), F.lit(500.0)),
            past=geo.extend_beyond(F.lit(14.0), F.lit(50.0), F.lit(14.0), F.lit(51.0), F.lit(1000.0)))
    assert r["near"]["lat"] == 50.001
    assert (r["part"]["lat"] - 50.0) * 111.19 == pytest.approx(0.5, abs=0.01)
    assert (r["past"]["lat"] - 51.0) * 111.19 == pytest.approx(1.0, abs=0.01)


def hilbert(n, x, y):
    d, s = 0, n // 2
    while s:
        rx, ry = int(bool(x & s)), int(bool(y & s))
        d += s * s * ((3 * rx) ^ ry)
        if ry == 0:
            if rx == 1:
                x, y = n - 1 - x, n - 1 - y
            x, y = y, x
        s //= 2
    return d


def test_hilbert(spark):
    pts = [(0.0, 0.0), (1.0, 1.0), (0.3, 0.7), (0.9, 0.1), (0.5, 0.5)]
    df = spark.createDataFrame(pts, "lng double, lat double")
    got = [r[0] for r in df.select(geo.hilbert_key("lng", "lat", F.lit(0.0), F.lit(0.0), F.lit(1.0), F.lit(1.0))).collect()]
    n = 1 << 16
    assert got == [hilbert(n, math.floor(x * (n - 1) + 0.5), math.floor(y * (n - 1) + 0.5)) for x, y in pts]


def test_names(spark):
    r = one(spark, d=names.dem_tile_name(F.lit(-121), F.lit(-6)), p=names.parse_dem_tile(F.lit("N50E020.hgt")), bad=names.parse_dem_tile(F.lit("N5E2")),
            s=names.parse_segment(F.lit("W10_N45.rd5")), odd=names.parse_segment(F.lit("E7_N45")),
            t=names.missing_tile(F.lit("datafile W10_N45.rd5 not found")), i=names.island_section(F.lit("target island detected for section 3")))
    assert r["d"] == "S06W121" and tuple(r["p"]) == (50, 20) and r["bad"] is None
    assert tuple(r["s"]) == (-10, 45) and r["odd"] is None and r["t"] == "W10_N45" and r["i"] == 3


def test_microdegrees(spark):
    a, b = geo.to_microdeg(F.lit(20.0), F.lit(52.0))
    assert tuple(one(spark, a=a, b=b)) == (200_000_000, 142_000_000)


@pytest.mark.parametrize("km,days,per,want", [(850, 10, 200, "OK"), (1500, 2, 100, "BUDGET_IMPOSSIBLE"), (1050, 10, 100, "OK"), (850, None, 100, "OK")])
def test_verdict(spark, km, days, per, want):
    v = budget.baseline_verdict(F.lit(float(km)), F.lit(days).cast("int"), F.lit(per))
    assert one(spark, v=v)["v"] == want


@pytest.mark.parametrize("way,road,flat", [
    ("highway=cycleway foot=yes", "cycleway_shared_foot", False), ("highway=path bicycle=designated foot=designated", "path_bike_foot", False),
    ("highway=secondary_link ref=DK7;E40 bicycle=use_sidepath cycleway=lane", "secondary_use_sidepath:DK7", False), ("highway=primary cycleway=track", "primary_with_cycleway_lane", False),
    ("highway=footway bicycle=permissive tunnel=yes", "footway_bike_allowed", True), ("surface=gravel bridge=no", "unknown", False),
])
def test_road_classes(spark, way, road, flat):
    r = one(spark, road=tags.road_of_tags(F.lit(way)), flat=tags.is_tunnel_or_bridge(F.lit(way)))
    assert (r["road"], r["flat"]) == (road, flat)
