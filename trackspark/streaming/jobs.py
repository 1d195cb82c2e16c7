"""Streaming jobs. Event-time columns are ``ts``; rows later than the watermark are dropped."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.names import coarse_phase
from ..functions.tiles import tile_key
from ..operators.tracks import segment_tiles
from ..plans.lineage import discard, materialize
from ..sources.versioned import VersionedTable
from .state import LATEST_SCHEMA, NO_TIME, RUNNING_SCHEMA, SEGMENT_SCHEMA, LatestTask, RunningEffort, TrackSegments

WATERMARK = "1 hour"
#: Seconds of event time after which a silent track or a finished task is forgotten.
FORGET_S = 30 * 24 * 3600


def stream_new_tiles(points: DataFrame, z: int = 14, watermark: str = WATERMARK, forget_s: int = FORGET_S) -> DataFrame:
    """Tiles a user enters for the first time: ``(user_id, tile_key, ts)``; exact across micro-batches.

    Points go by time within their track; no line is drawn from one track of a user to the next. Two stateful operators
    in a row: the last point of each track, kept until the track has been silent for ``forget_s`` of event time, and the
    set of (user, tile) pairs seen, which stays, as a tile is won once. The tiles of a segment are found in between by
    column expressions. ``ts`` is the time of an entry in the micro-batch that first saw the tile.
    """
    rows = points.select("user_id", "track_id", "ts", "seq", "lng", "lat").withWatermark("ts", watermark)
    segments = rows.groupBy("user_id", "track_id").transformWithStateInPandas(
        statefulProcessor=TrackSegments(z, forget_s * 1000), outputStructType=SEGMENT_SCHEMA, outputMode="Append", timeMode="EventTime", eventTimeColumnName="ts"
    )
    cells = segments.withColumn("c", F.explode(segment_tiles(F.col("x0"), F.col("y0"), F.col("x1"), F.col("y1"), z)))
    return cells.select("user_id", tile_key("c.x", "c.y").alias("tile_key"), "ts").dropDuplicates(["user_id", "tile_key"])


def stream_running_effort(points: DataFrame, watermark: str = WATERMARK, forget_s: int = FORGET_S) -> DataFrame:
    """Running distance, climb and effort of each track after every batch of its points.

    A track silent for ``forget_s`` of event time is forgotten; points after that are a new track.
    """
    rows = points.select("track_id", "ts", "seq", "lng", "lat", "ele").withWatermark("ts", watermark)
    return rows.groupBy("track_id").transformWithStateInPandas(
        statefulProcessor=RunningEffort(forget_s * 1000), outputStructType=RUNNING_SCHEMA, outputMode="Update", timeMode="EventTime"
    )


def stream_latest_tasks(tasks: DataFrame, timeout_s: int = 3600, watermark: str = WATERMARK, forget_s: int = FORGET_S) -> DataFrame:
    """Latest status per task; a task RUNNING and silent beyond the timeout is reported STALE once.

    Tasks that have ended or gone stale are forgotten after ``forget_s`` of event time.
    """
    rows = tasks.select("task_id", "status", "ts", F.unix_micros("ts").alias("us")).withWatermark("ts", watermark)
    out = rows.groupBy("task_id").transformWithState(
        statefulProcessor=LatestTask(timeout_s, forget_s * 1000), outputStructType=LATEST_SCHEMA, outputMode="Update", timeMode="EventTime"
    )
    return out.select("task_id", "status", F.timestamp_micros(F.when(F.col("us") > NO_TIME, F.col("us"))).alias("ts"))


def stream_timings(calls: DataFrame, width: str = "10 minutes", slide: str | None = None, watermark: str = WATERMARK) -> DataFrame:
    """Calls per reason in tumbling or sliding windows, with approximate percentiles."""
    win = F.window("ts", width, slide) if slide else F.window("ts", width)
    stats = calls.withWatermark("ts", watermark).groupBy(win.alias("w"), "reason").agg(
        F.count("*").alias("calls"), F.avg("ms").alias("avg_ms"), F.percentile_approx("ms", F.array(F.lit(0.5), F.lit(0.95)), 10_000).alias("q"),
        F.max("ms").alias("max_ms"),
    )
    return stats.select(F.col("w.start").alias("start"), F.col("w.end").alias("end"), "reason", "calls", "avg_ms", F.col("q")[0].alias("p50"), F.col("q")[1].alias("p95"), "max_ms")


def stream_sessions(points: DataFrame, gap: str = "6 hours", watermark: str = WATERMARK) -> DataFrame:
    """Ride sessions per user: points no more than ``gap`` apart."""
    s = points.withWatermark("ts", watermark).groupBy(F.session_window("ts", gap).alias("s"), "user_id").agg(F.count("*").alias("points"))
    return s.select("user_id", F.col("s.start").alias("start"), F.col("s.end").alias("end"), "points")


def latest_frames(frames: DataFrame) -> DataFrame:
    """Newest frame per task with its coarse phase; the batch step of the frame feed."""
    row = F.struct("ts", coarse_phase("phase").alias("phase"), "km", "covered_ids")
    return frames.groupBy("task_id").agg(F.max_by(row, "ts").alias("r")).select("task_id", "r.*")


def with_covered_levels(frames: DataFrame, areas: DataFrame) -> DataFrame:
    """Add ``covered_by_level``: covered areas per level as a map (empty without any); unknown and repeated ids do not count."""
    ids = frames.select("task_id", F.explode(F.array_distinct("covered_ids")).alias("area_id"))
    counts = ids.join(areas.select("area_id", "level_id"), "area_id").groupBy("task_id", "level_id").agg(F.count("*").alias("n"))
    levels = counts.groupBy("task_id").agg(F.map_from_entries(F.sort_array(F.collect_list(F.struct("level_id", "n")))).alias("covered_by_level"))
    none = F.map_from_arrays(F.array().cast("array<int>"), F.array().cast("array<bigint>"))
    return frames.join(levels, "task_id", "left").withColumn("covered_by_level", F.coalesce("covered_by_level", none))


def stream_latest_frames(frames: DataFrame, path: str, checkpoint: str, areas: DataFrame, buckets: int = 64, keep: int = 2):
    """Keep a table of the newest frame per task, with covered areas per level; returns the started query.

    A micro-batch rewrites only the buckets of its tasks and commits them with its number in one step
    (:class:`VersionedTable`), so a batch that is tried again changes nothing twice and readers never see half of it.
    The last ``keep`` versions stay for readers under way. Read the table with ``VersionedTable.at(spark, path).read()``.
    """
    def write(batch: DataFrame, number: int) -> None:
        table = VersionedTable(batch.sparkSession, path, "task_id", buckets)
        before = table.manifest()
        if before is not None and before.tag is not None and before.tag >= number:
            return
        new = materialize(with_covered_levels(latest_frames(batch), areas), "frames")
        table.rewrite(new, lambda stored: new if stored is None else latest_rows(stored.unionByName(new)), tag=number)
        table.vacuum(keep)
        discard(new)

    return frames.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def latest_rows(rows: DataFrame) -> DataFrame:
    """Newest row per task."""
    row = F.struct(*[c for c in rows.columns if c != "task_id"])
    return rows.groupBy("task_id").agg(F.max_by(row, "ts").alias("r")).select("task_id", "r.*").select(*rows.columns)
