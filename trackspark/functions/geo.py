"""Distances, planar geometry and space-filling order as Column arithmetic."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed values that results depend on.
EARTH_RADIUS_KM = 6371.0
METERS_PER_DEG = 111_320.0
KNN_KM_PER_DEG = 111.0
KM_PER_DEG_LNG = 111.320
KM_PER_DEG_LAT = 110.574
HILBERT_ORDER = 16


def col(c) -> Column:
    return F.col(c) if isinstance(c, str) else c if isinstance(c, Column) else F.lit(c)


def half_up(x) -> Column:
    """Round to the nearest integer, ties towards positive infinity."""
    return F.floor(col(x) + F.lit(0.5)).cast("bigint")


def haversine_km(lng1, lat1, lng2, lat2) -> Column:
    """Great-circle distance; NULL when any coordinate is NULL (``least`` would skip it)."""
    lng1, lat1, lng2, lat2 = map(col, (lng1, lat1, lng2, lat2))
    s_lat = F.sin(F.radians(lat2 - lat1) / 2)
    s_lng = F.sin(F.radians(lng2 - lng1) / 2)
    h = s_lat * s_lat + F.cos(F.radians(lat1)) * F.cos(F.radians(lat2)) * s_lng * s_lng
    return F.when(h.isNotNull(), 2 * EARTH_RADIUS_KM * F.asin(F.least(F.lit(1.0), F.sqrt(h))))


def haversine_m(lng1, lat1, lng2, lat2) -> Column:
    return haversine_km(lng1, lat1, lng2, lat2) * 1000.0


def planar_km(lng1, lat1, lng2, lat2, cos_ref) -> Column:
    """Flat distance in degrees scaled by one reference cosine for the whole pool."""
    dx = (col(lng1) - col(lng2)) * col(cos_ref) * KNN_KM_PER_DEG
    dy = (col(lat1) - col(lat2)) * KNN_KM_PER_DEG
    return F.hypot(dx, dy)


def _clamp01(t: Column) -> Column:
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), t))


def _foot(px, py, ax, ay, bx, by, eps: float = 1e-12) -> tuple[Column, Column]:
    """Nearest point of segment a-b to p in the given flat coordinates."""
    dx, dy = bx - ax, by - ay
    len2 = dx * dx + dy * dy
    t = F.when(len2 <= eps, F.lit(0.0)).otherwise(_clamp01(((px - ax) * dx + (py - ay) * dy) / len2))
    return ax + t * dx, ay + t * dy


def point_segment_km(px, py, ax, ay, bx, by) -> Column:
    """Point to segment in km, degrees scaled at the segment's middle latitude."""
    px, py, ax, ay, bx, by = map(col, (px, py, ax, ay, bx, by))
    kx = KM_PER_DEG_LNG * F.cos(F.radians((ay + by) / 2))
    ky = F.lit(KM_PER_DEG_LAT)
    fx, fy = _foot(px * kx, py * ky, ax * kx, ay * ky, bx * kx, by * ky)
    return F.hypot(px * kx - fx, py * ky - fy)


def point_segment_geo_km(px, py, ax, ay, bx, by) -> Column:
    """Foot point found in raw degrees, then great-circle distance to it."""
    px, py, ax, ay, bx, by = map(col, (px, py, ax, ay, bx, by))
    fx, fy = _foot(px, py, ax, ay, bx, by)
    return haversine_km(px, py, fx, fy)


def point_segment_deg(px, py, ax, ay, bx, by) -> Column:
    """Point to segment in raw degrees; only good for ranking."""
    px, py, ax, ay, bx, by = map(col, (px, py, ax, ay, bx, by))
    fx, fy = _foot(px, py, ax, ay, bx, by)
    return F.hypot(px - fx, py - fy)


def _point(lng: Column, lat: Column) -> Column:
    return F.struct(lng.alias("lng"), lat.alias("lat"))


def move_towards(flng, flat, tlng, tlat, meters) -> Column:
    """Point ``meters`` from *from* on the way to *to*; *to* itself when that near."""
    flng, flat, tlng, tlat, meters = map(col, (flng, flat, tlng, tlat, meters))
    d = haversine_m(flng, flat, tlng, tlat)
    f = F.when((d <= meters) | (d < 1e-6), F.lit(1.0)).otherwise(meters / d)
    at_end = (d <= meters) | (d < 1e-6)
    return _point(
        F.when(at_end, tlng).otherwise(flng + (tlng - flng) * f),
        F.when(at_end, tlat).otherwise(flat + (tlat - flat) * f),
    )


def extend_beyond(flng, flat, tlng, tlat, meters) -> Column:
    """Point ``meters`` past *to* on the straight line from *from*."""
    flng, flat, tlng, tlat, meters = map(col, (flng, flat, tlng, tlat, meters))
    d = haversine_m(flng, flat, tlng, tlat)
    f = (d + meters) / d
    return _point(
        F.when(d < 1e-6, tlng).otherwise(flng + (tlng - flng) * f),
        F.when(d < 1e-6, tlat).otherwise(flat + (tlat - flat) * f),
    )


def linear_interp(x0, v0, x1, v1, x) -> Column:
    """Value at ``x`` between two samples; a missing side means clamp to the other one."""
    x0, v0, x1, v1, x = map(col, (x0, v0, x1, v1, x))
    span = x1 - x0
    return (
        F.when(x0.isNull(), v1)
        .when(x1.isNull(), v0)
        .when(span <= 0, v0)
        .otherwise(v0 + (x - x0) / span * (v1 - v0))
    )


def to_microdeg(lng, lat) -> tuple[Column, Column]:
    return half_up((col(lng) + 180.0) * 1e6), half_up((col(lat) + 90.0) * 1e6)


def from_microdeg(ilng, ilat) -> tuple[Column, Column]:
    return col(ilng) / 1e6 - 180.0, col(ilat) / 1e6 - 90.0


def vertex_key(x) -> Column:
    """Coordinate in signed micro-degrees, the join key between messages and vertices."""
    return half_up(col(x) * 1e6)


def hilbert_key(lng, lat, min_lng, min_lat, max_lng, max_lat) -> Column:
    """Position on a 2^16 x 2^16 Hilbert curve laid over the bounding box."""
    n = 1 << HILBERT_ORDER
    lng, lat, x0, y0, x1, y1 = map(col, (lng, lat, min_lng, min_lat, max_lng, max_lat))
    fx = F.when(x1 > x0, (lng - x0) / (x1 - x0)).otherwise(0.0)
    fy = F.when(y1 > y0, (lat - y0) / (y1 - y0)).otherwise(0.0)

    def grid(f):
        return F.greatest(F.lit(0), F.least(F.lit(n - 1), half_up(f * (n - 1)))).cast("bigint")

    def step(acc, bit):
        side = F.pow(F.lit(2.0), bit).cast("bigint")
        rx = (acc["x"].bitwiseAND(side) > 0).cast("bigint")
        ry = (acc["y"].bitwiseAND(side) > 0).cast("bigint")
        quadrant = F.when(rx == 0, ry).otherwise(F.lit(3) - ry)
        flip = (ry == 0) & (rx == 1)
        x2 = F.when(flip, n - 1 - acc["x"]).otherwise(acc["x"])
        y2 = F.when(flip, n - 1 - acc["y"]).otherwise(acc["y"])
        return F.struct(
            F.when(ry == 0, y2).otherwise(x2).alias("x"),
            F.when(ry == 0, x2).otherwise(y2).alias("y"),
            (acc["d"] + side * side * quadrant).alias("d"),
        )

    start = F.struct(grid(fx).alias("x"), grid(fy).alias("y"), F.lit(0).cast("bigint").alias("d"))
    bits = F.sequence(F.lit(HILBERT_ORDER - 1), F.lit(0), F.lit(-1))
    return F.aggregate(bits, start, step, lambda acc: acc["d"])


def unit_xyz(lng, lat) -> tuple[Column, Column, Column]:
    """Point on the unit sphere; chord length there grows with great-circle distance."""
    lng, lat = F.radians(col(lng)), F.radians(col(lat))
    return F.cos(lat) * F.cos(lng), F.cos(lat) * F.sin(lng), F.sin(lat)
