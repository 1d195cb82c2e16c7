"""Draft, plan and task tables: upserts, patches, names, clean-up."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.versioned import VersionedTable, replace_keys

DAY_NAME = " – Dzień "  # fixed value
FORM_FIELDS = ["countries", "levels", "groups", "via", "is_loop", "days", "km_per_day", "elev_per_day", "profile"]


def replace_rows(new_rows: DataFrame, path: str, key: str = "session_id", buckets: int = 64, sessions: DataFrame | None = None) -> None:
    """Replace all rows of every session in ``new_rows`` and ``sessions`` in one step: readers see all of it or nothing.

    Only the touched buckets are written. A session listed in ``sessions`` without new rows is emptied. Read the table
    with :func:`read_rows`.
    """
    replace_keys(VersionedTable(new_rows.sparkSession, path, key, buckets), new_rows, sessions)


def read_rows(spark: SparkSession, path: str, sessions: DataFrame | None = None) -> DataFrame:
    """Rows of the newest committed version, of all sessions or of some (whose buckets alone are read)."""
    table = VersionedTable.at(spark, path)
    return table.read() if sessions is None else table.read_keys(sessions.select(table.key))


def upsert(current: DataFrame, changes: DataFrame, keys: list[str]) -> DataFrame:
    """Rows of ``changes`` replace rows with equal keys, others are added."""
    old, new = F.struct(*[F.col(c) for c in current.columns]), F.struct(*[F.col(c) for c in current.columns])
    a = current.select(*keys, old.alias("_old"))
    b = changes.select(*keys, new.alias("_new"))
    return a.join(b, keys, "full_outer").select(F.coalesce("_new", "_old").alias("r")).select("r.*")


def latest_by(df: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """Newest row per key; partial aggregation, so no key is sorted in one task."""
    row = F.struct(*[F.col(c) for c in df.columns if c not in keys])
    return df.groupBy(*keys).agg(F.max_by(row, F.struct(*order)).alias("r")).select(*keys, "r.*")


def save_expedition(days: DataFrame, names: DataFrame, waypoints: DataFrame) -> DataFrame:
    """One draft per plan day, tied together by a group: name, way-points as ``lng,lat;lng,lat``.

    ``waypoints`` is ``(plan_id, day, ord, lng, lat)``.
    """
    text = F.concat_ws(",", F.col("lng").cast("string"), F.col("lat").cast("string"))
    joined = waypoints.groupBy("plan_id", "day").agg(F.sort_array(F.collect_list(F.struct("ord", text.alias("t")))).alias("w"))
    joined = joined.select("plan_id", "day", F.array_join(F.transform("w", lambda x: x["t"]), ";").alias("waypoints"))
    out = days.join(names, "plan_id").join(joined, ["plan_id", "day"], "left")
    group = F.sha2(F.concat_ws("/", F.col("plan_id").cast("string"), "group_name"), 256)
    return out.withColumns({
        "name": F.concat(F.col("group_name"), F.lit(DAY_NAME), F.col("day").cast("string")), "group_id": group,
        "waypoints": F.coalesce("waypoints", F.lit("")),
    })


def duplicate_names(drafts: DataFrame, changes: DataFrame) -> DataFrame:
    """Changes whose trimmed name the user already uses for another draft (``draft_id`` NULL for inserts)."""
    wish = changes.withColumn("_n", F.trim("name"))
    have = drafts.groupBy("user_id", F.col("name").alias("_n")).agg(F.min("draft_id").alias("_lo"), F.max("draft_id").alias("_hi"))
    other = F.col("draft_id").isNull() | (F.col("draft_id") != F.col("_lo")) | (F.col("draft_id") != F.col("_hi"))
    return wish.join(have, ["user_id", "_n"]).where(other).select("change_id").distinct()


def apply_draft_patch(drafts: DataFrame, patch: DataFrame, fields: list[str]) -> DataFrame:
    """Patched drafts: NULL patch fields keep the old value, ``updated_at`` is the patch's."""
    p = patch.select("draft_id", F.col("updated_at").alias("_at"), *[F.col(f).alias("_" + f) for f in fields])
    new = {f: F.coalesce("_" + f, f) for f in fields} | {"updated_at": F.coalesce("_at", "updated_at")}
    return drafts.join(p, "draft_id", "left").withColumns(new).select(*drafts.columns)


def draft_summary(drafts: DataFrame) -> DataFrame:
    """Listing columns only, so that geometry is never read."""
    return drafts.select("draft_id", "user_id", "name", "group_id", "day_number", "distance_km", "elevation_gain", "updated_at")


def group_geometries(drafts: DataFrame, archive: DataFrame, users: list[int] | None = None) -> DataFrame:
    """All day geometries of the users' groups (default: of all users) in one read; archive parts keep their number."""
    mine = drafts if users is None else owned_by(drafts, users)
    return mine.select("draft_id", "group_id", "day_number", "distance_km").join(archive, "draft_id")


def order_drafts(drafts: DataFrame) -> DataFrame:
    return drafts.orderBy(F.col("updated_at").desc(), "group_id", "day_number")


def invalidate_days(days: DataFrame, changed: DataFrame) -> DataFrame:
    """Days kept after plans in ``changed`` (plan_id, changed) altered their shape."""
    return days.join(changed.where("changed").select("plan_id"), "plan_id", "left_anti")


def orphaned_tasks(tasks: DataFrame, alive: DataFrame) -> DataFrame:
    """RUNNING tasks without a live computation become FAILED."""
    live = alive.select("task_id").distinct().withColumn("alive", F.lit(True))
    lost = (F.col("status") == "RUNNING") & F.col("alive").isNull()
    return tasks.join(live, "task_id", "left").withColumn("status", F.when(lost, "FAILED").otherwise(F.col("status"))).drop("alive")


def owned_by(df: DataFrame, users: list[int]) -> DataFrame:
    return df.where(F.col("user_id").isin(list(users)))


def fold_forms(patches: DataFrame) -> DataFrame:
    """State of each form after all its patches: last non-NULL value per field since the last intent change.

    ``patches`` is ``(plan_id, pos, intent, clear_start, clear_end, start, end, ...)``; a row with an intent resets
    the form. Clearing a point wins over setting it in the same patch. Only partial aggregations, no sort.
    """
    reset = patches.where("intent IS NOT NULL").groupBy("plan_id").agg(F.max("pos").alias("reset_pos"), F.max_by("intent", "pos").alias("intent"))
    live = patches.drop("intent").join(reset, "plan_id", "left").where("reset_pos IS NULL OR pos >= reset_pos")
    def last(value, when):
        return F.max_by(value, F.when(when, F.col("pos")))

    fields = [f for f in FORM_FIELDS if f in patches.columns]
    aggs = [last(f, F.col(f).isNotNull()).alias(f) for f in fields]
    for p in ("start", "end"):
        cleared = F.coalesce(F.col("clear_" + p), F.lit(False))
        value = F.when(~cleared, F.struct(F.col(p + ".lng").alias("lng"), F.col(p + ".lat").alias("lat")))
        aggs.append(last(value, cleared | F.col(p).isNotNull()).alias(p))
    return live.groupBy("plan_id").agg(F.first("intent").alias("intent"), *aggs)
