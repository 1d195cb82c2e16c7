"""Budget, readiness and corridor rules of a trip plan."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .geo import KM_PER_DEG_LAT, col, half_up

# Fixed values.
CLIMB_WEIGHT = 0.1
OVER, UNDER = 1.05, 0.95
DEFAULT_CLIMB_PER_DAY = 300.0
CLIMB_PER_180_KM = 1000.0
DEFAULT_KM_PER_DAY = 200
TILE_KM_PER_DAY = 100
MARGIN_KM = (5.0, 40.0, 0.15)
MIN_COS = 0.05
REACH_FLOOR_KM, REACH_SHARE = 22.0, 0.2
DETOUR_TILE_SIDES = 3.0
SCORE_OFFSET_KM = 0.2


def effort_km(km, climb_m, alpha: float = CLIMB_WEIGHT) -> Column:
    return col(km) + alpha * col(climb_m)


def detour_score(intersected, min_dist_km) -> Column:
    return F.when(col(intersected), 0.0).otherwise(2 * col(min_dist_km) + SCORE_OFFSET_KM)


def corridor_distance_km(intersected, detour_km) -> Column:
    return F.when(col(intersected), 0.0).otherwise(F.greatest(F.lit(0.0), (col(detour_km) - SCORE_OFFSET_KM) / 2))


def baseline_verdict(km, days, km_per_day) -> Column:
    usable = (col(days) > 0) & (col(km_per_day) > 0)
    over = half_up(col(km)) > col(days) * col(km_per_day) * OVER
    return F.when(F.coalesce(usable & over, F.lit(False)), "BUDGET_IMPOSSIBLE").otherwise("OK")


def budget_effort(days, km_per_day, elev_per_day) -> Column:
    days = F.coalesce(col(days), F.lit(1))
    km = F.coalesce(col(km_per_day), F.lit(DEFAULT_KM_PER_DAY))
    default = F.greatest(F.lit(DEFAULT_CLIMB_PER_DAY), km * CLIMB_PER_180_KM / 180.0)
    elev = F.when(col(elev_per_day) > 0, col(elev_per_day).cast("double")).otherwise(default)
    return days * (km + CLIMB_WEIGHT * elev)


def budget_fit(trip_effort, budget) -> Column:
    frac = F.when(col(budget) > 0, col(trip_effort) / col(budget)).otherwise(1.0)
    return F.when(frac > OVER, "OVER").when(frac < UNDER, "UNDER").otherwise("OK")


def total_limit(days, km_per_day, elev_per_day, alpha: float = CLIMB_WEIGHT) -> Column:
    km = F.coalesce(col(km_per_day), F.lit(DEFAULT_KM_PER_DAY))
    elev = F.coalesce(col(elev_per_day), F.lit(0))
    return (km + alpha * elev) * F.coalesce(col(days), F.lit(1))


def corridor_margin_km(days, km_per_day) -> Column:
    low, high, share = MARGIN_KM
    budget = F.coalesce(col(days), F.lit(1)) * F.coalesce(col(km_per_day), F.lit(TILE_KM_PER_DAY)).cast("double")
    return F.greatest(F.lit(low), F.least(F.lit(high), share * budget))


def corridor_box(min_lng, min_lat, max_lng, max_lat, margin_km) -> Column:
    x0, y0, x1, y1, m = map(col, (min_lng, min_lat, max_lng, max_lat, margin_km))
    d_lat = m / KM_PER_DEG_LAT
    d_lng = m / (KM_PER_DEG_LAT * F.greatest(F.lit(MIN_COS), F.cos(F.radians((y0 + y1) / 2))))
    return F.struct(
        (x0 - d_lng).alias("min_lng"), (y0 - d_lat).alias("min_lat"),
        (x1 + d_lng).alias("max_lng"), (y1 + d_lat).alias("max_lat"),
    )


def reach_cap_km(km_per_day) -> Column:
    return F.greatest(F.lit(REACH_FLOOR_KM), REACH_SHARE * F.coalesce(col(km_per_day), F.lit(TILE_KM_PER_DAY)))


def max_detour_km(tile_side_km) -> Column:
    return DETOUR_TILE_SIDES * col(tile_side_km)


def ready_to_calculate(intent, start, end, is_loop, days, km_per_day, countries, levels, groups) -> Column:
    """Whether the form holds every field its intent needs."""
    intent, start, end = map(col, (intent, start, end))

    def filled(c):
        return F.coalesce(F.size(col(c)) > 0, F.lit(False))

    looped = F.coalesce(col(is_loop), F.lit(False))
    base = start.isNotNull() & (col(days) > 0) & (col(km_per_day) > 0)
    open_ended = base & (looped | end.isNotNull())
    ready = (
        F.when(intent == "COVERAGE", open_ended & filled(countries) & (filled(levels) | filled(groups)))
        .when(intent == "AB", base & end.isNotNull())
        .when(intent.isin("FREESTYLE", "TILES"), open_ended)
    )
    return F.coalesce(ready, F.lit(False))


def _same_point(a: Column, b: Column) -> Column:
    return (a["lng"].eqNullSafe(b["lng"])) & (a["lat"].eqNullSafe(b["lat"]))


def shape_changed(cur: str, patch: str) -> Column:
    """Whether a form patch changes the route's shape.

    ``cur`` and ``patch`` name struct columns with countries, levels, groups, is_loop, start, end, via
    (and clear_start, clear_end in the patch); way-points are compared by coordinates only.
    """
    c, d = F.col(cur), F.col(patch)
    changed = F.coalesce(d["clear_start"], F.lit(False)) | F.coalesce(d["clear_end"], F.lit(False))
    for f in ("countries", "levels", "groups", "is_loop"):
        changed = changed | (d[f].isNotNull() & ~d[f].eqNullSafe(c[f]))
    for f in ("start", "end"):
        changed = changed | (d[f].isNotNull() & ~_same_point(d[f], c[f]))
    same_via = (F.size(d["via"]) == F.size(c["via"])) & F.forall(
        F.zip_with(d["via"], c["via"], _same_point), lambda ok: F.coalesce(ok, F.lit(False))
    )
    return changed | (d["via"].isNotNull() & ~F.coalesce(same_via, F.lit(False)))
