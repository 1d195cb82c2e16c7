"""Slippy-map tiles: forward and inverse Web-Mercator and the 64-bit tile key."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

from .geo import col

KEY_BASE = 131072  # fixed value: tile key = x * 2^17 + y


def frac_tile(lng, lat, z: int) -> tuple[Column, Column]:
    """Tile coordinates without floor or clamp."""
    n = float(1 << z)
    r = F.radians(col(lat))
    fx = (col(lng) + 180.0) / 360.0 * n
    fy = (1.0 - F.log(F.tan(r) + 1.0 / F.cos(r)) / math.pi) / 2.0 * n
    return fx, fy


def tile_xy(lng, lat, z: int) -> tuple[Column, Column]:
    """Tile coordinates clamped to the grid."""
    top = (1 << z) - 1
    fx, fy = frac_tile(lng, lat, z)

    def clamp(v):
        return F.greatest(F.lit(0).cast("bigint"), F.least(F.lit(top).cast("bigint"), F.floor(v)))

    return clamp(fx), clamp(fy)


def tile_key(x, y) -> Column:
    return col(x).cast("bigint") * KEY_BASE + col(y)


def key_x(key) -> Column:
    return F.floor(col(key) / KEY_BASE)


def key_y(key) -> Column:
    return col(key) % KEY_BASE


def _row_lat(y: Column, z: int) -> Column:
    return F.degrees(F.atan(F.sinh(F.lit(math.pi) * (1.0 - 2.0 * y / float(1 << z)))))


def tile_bbox(x, y, z: int) -> Column:
    n = float(1 << z)
    x, y = col(x), col(y)
    return F.struct(
        (x / n * 360.0 - 180.0).alias("min_lng"),
        _row_lat(y + 1, z).alias("min_lat"),
        ((x + 1) / n * 360.0 - 180.0).alias("max_lng"),
        _row_lat(y, z).alias("max_lat"),
    )


def tile_center(x, y, z: int) -> Column:
    b = tile_bbox(x, y, z)
    return F.struct(
        ((b["min_lng"] + b["max_lng"]) / 2.0).alias("lng"),
        ((b["min_lat"] + b["max_lat"]) / 2.0).alias("lat"),
    )


def tile_ring(x, y, z: int) -> Column:
    """Closed ring of five points, clockwise from the top-left corner."""
    b = tile_bbox(x, y, z)
    corners = [("min_lng", "max_lat"), ("max_lng", "max_lat"), ("max_lng", "min_lat"), ("min_lng", "min_lat")]
    corners.append(corners[0])
    return F.array(*[F.struct(b[a].alias("lng"), b[o].alias("lat")) for a, o in corners])
