"""Names, keys and message texts: parsing, formatting, classification."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .geo import col

# Name patterns and the phrases that decide a failure class, first match wins.
DEM_NAME = "^([NS])([0-9]{2})([EW])([0-9]{3})$"
SEGMENT_NAME = "^([EW])([0-9]+)_([NS])([0-9]+)$"
FAIL_PHRASES = [
    ("target-island", ["island"]),
    ("not-mapped", ["not mapped", "datafile", "not found"]),
    ("timeout", ["timeout", "killed", "watchdog"]),
]
EUROPE = {"lng": (-15, 45), "lat": (30, 72)}
MAX_NAME_LENGTH = 255


def dem_tile_name(tile_lng, tile_lat) -> Column:
    lng, lat = col(tile_lng).cast("int"), col(tile_lat).cast("int")
    return F.format_string(
        "%s%02d%s%03d",
        F.when(lat >= 0, "N").otherwise("S"),
        F.abs(lat),
        F.when(lng >= 0, "E").otherwise("W"),
        F.abs(lng),
    )


def _signed(text: Column, pattern: str, sign_group: int, negative: str) -> Column:
    number = F.regexp_extract(text, pattern, sign_group + 1).cast("int")
    return F.when(F.regexp_extract(text, pattern, sign_group) == negative, -number).otherwise(number)


def parse_dem_tile(name) -> Column:
    """struct(tile_lat, tile_lng) or NULL when the name does not parse or is out of range."""
    base = F.regexp_replace(col(name), "\\.(tif|hgt)$", "")
    ok = base.rlike(DEM_NAME)
    lat = F.when(ok, _signed(base, DEM_NAME, 1, "S"))
    lng = F.when(ok, _signed(base, DEM_NAME, 3, "W"))
    good = ok & lat.between(-90, 89) & lng.between(-180, 179)
    return F.when(good, F.struct(lat.alias("tile_lat"), lng.alias("tile_lng")))


def parse_segment(name) -> Column:
    """struct(lng, lat) of a 5-degree segment; NULL unless both are multiples of five."""
    base = F.regexp_replace(col(name), "\\.rd5$", "")
    ok = base.rlike(SEGMENT_NAME)
    lng = F.when(ok, _signed(base, SEGMENT_NAME, 1, "W"))
    lat = F.when(ok, _signed(base, SEGMENT_NAME, 3, "S"))
    good = ok & (lng % 5 == 0) & (lat % 5 == 0)
    return F.when(good, F.struct(lng.alias("lng"), lat.alias("lat")))


def in_europe(lng, lat) -> Column:
    return col(lng).between(*EUROPE["lng"]) & col(lat).between(*EUROPE["lat"])


def is_outdated(remote_size, installed_size) -> Column:
    return F.coalesce(col(remote_size) != col(installed_size), F.lit(False))


def category_key(country, level, group) -> Column:
    return F.concat_ws(
        ":", col(country).cast("string"), col(level).cast("string"), F.coalesce(col(group).cast("string"), F.lit("null"))
    )


def format_category(key) -> Column:
    parts = F.split(col(key), ":")
    tail = F.when(parts[2] != "null", F.concat(F.lit("/sg"), parts[2])).otherwise(F.concat(F.lit("/L"), parts[1]))
    return F.when(F.size(parts) < 3, col(key)).otherwise(F.concat(F.lit("C"), parts[0], tail))


def leg_key(a_lng, a_lat, b_lng, b_lat) -> Column:
    """Directional key: both ends rounded to five decimals."""
    return F.format_string("%.5f,%.5f>%.5f,%.5f", *[col(c) for c in (a_lng, a_lat, b_lng, b_lat)])


def fail_reason(message) -> Column:
    text = F.lower(col(message))
    out = None
    for reason, phrases in FAIL_PHRASES:
        hit = F.lit(False)
        for p in phrases:
            hit = hit | text.contains(p)
        out = F.when(hit, reason) if out is None else out.when(hit, reason)
    return F.when(text.isNotNull(), out.otherwise("other"))


def missing_tile(message) -> Column:
    """Tile name in a ``datafile X.rd5 not found`` message, else NULL."""
    hit = F.regexp_extract(col(message), "datafile\\s+([A-Z][0-9]+_[A-Z][0-9]+)\\.rd5\\s+not\\s+found", 1)
    return F.when(hit != "", hit)


def island_section(message) -> Column:
    hit = F.regexp_extract(col(message), "target island detected for section ([0-9]+)", 1)
    return F.when(hit != "", hit.cast("int"))


def coarse_phase(phase) -> Column:
    p = F.lower(col(phase))
    return (
        F.when(p.contains("baseline"), "BASELINE")
        .when(p.contains("grow") | p.contains("batch"), "GROWING")
        .otherwise("SMOOTHING")
    )


def safe_file_name(name) -> Column:
    return F.regexp_replace(col(name), "[^A-Za-z0-9._-]", "_")


def valid_name(name) -> Column:
    return F.coalesce((F.trim(col(name)) != "") & (F.length(col(name)) <= MAX_NAME_LENGTH), F.lit(False))
