"""Way-tag parsing and road / surface classification."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .geo import col

# Tag values that grant access, and the classes with their own rule.
ALLOWED_ACCESS = ["designated", "yes", "permissive"]
LANE_VALUES = ["track", "lane"]
PLAIN_CLASSES = ["track", "bridleway", "steps"]
FLAT_KEYS = ["tunnel", "bridge"]
UNKNOWN = "unknown"


def tag_value(way_tags, key: str) -> Column:
    """Value of the first ``key=`` token; NULL when absent or empty."""
    prefix = key + "="
    hits = F.filter(F.split(col(way_tags), " "), lambda t: t.startswith(prefix))
    token = F.get(hits, F.lit(0))
    value = F.substr(token, F.lit(len(prefix) + 1), F.length(token))
    return F.when(value != "", value)


def classify_surface(value) -> Column:
    return F.coalesce(F.when(col(value) != "", F.lower(col(value))), F.lit(UNKNOWN))


classify_smoothness = classify_surface


def classify_road(highway, bicycle, foot, cycleway, ref) -> Column:
    highway, bicycle, foot, cycleway, ref = map(col, (highway, bicycle, foot, cycleway, ref))

    def yes(c):
        return F.coalesce(c, F.lit(False))

    bike_marked, foot_marked = yes(bicycle == "designated"), yes(foot == "designated")
    bike_ok, foot_ok = yes(bicycle.isin(ALLOWED_ACCESS)), yes(foot.isin(ALLOWED_ACCESS))
    base = F.regexp_replace(highway, "_link$", "")
    side = F.when(yes(bicycle == "use_sidepath"), "_use_sidepath").when(
        yes(cycleway.isin(LANE_VALUES)), "_with_cycleway_lane"
    )
    first_ref = F.trim(F.regexp_substr(ref, F.lit("^[^;,]*")))
    number = F.when(first_ref != "", F.concat(F.lit(":"), first_ref))
    return (
        F.when(highway.isNull(), UNKNOWN)
        .when(highway == "cycleway", F.when(foot_ok, "cycleway_shared_foot").otherwise("cycleway"))
        .when(
            highway == "path",
            F.when(bike_marked & foot_marked, "path_bike_foot")
            .when(bike_marked, "path_bike")
            .when(foot_marked, "path_foot")
            .otherwise("path"),
        )
        .when(
            highway.isin("footway", "pedestrian"),
            F.when(bike_ok, F.concat(highway, F.lit("_bike_allowed"))).otherwise(highway),
        )
        .when(highway.isin(PLAIN_CLASSES), highway)
        .otherwise(F.concat(base, F.coalesce(side, F.lit("")), F.coalesce(number, F.lit(""))))
    )


def road_of_tags(way_tags) -> Column:
    keys = ["highway", "bicycle", "foot", "cycleway", "ref"]
    return classify_road(*[tag_value(way_tags, k) for k in keys])


def is_tunnel_or_bridge(way_tags) -> Column:
    def flat(token):
        starts = token.startswith(FLAT_KEYS[0] + "=") | token.startswith(FLAT_KEYS[1] + "=")
        return starts & ~token.endswith("=no")

    return F.coalesce(F.exists(F.split(col(way_tags), " "), flat), F.lit(False))
