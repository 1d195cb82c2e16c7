"""Way-message statistics: endpoint matching, metres per code, spans, tag breakdown."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.geo import vertex_key
from ..functions.tags import classify_smoothness, classify_surface, is_tunnel_or_bridge, road_of_tags, tag_value
from ..plans.chunks import fill_forward, islands, running_max, with_previous
from ..plans.lineage import cut_lineage, materialize

NO_TAG = "[no tag]"  # fixed value
DIMS = ["surface", "road", "smoothness"]


def classified(messages: DataFrame) -> DataFrame:
    """Long form: one row per message and dimension with its code; rows without length are dropped."""
    tags = F.col("way_tags")
    codes = {
        "surface": classify_surface(tag_value(tags, "surface")), "road": road_of_tags(tags),
        "smoothness": classify_smoothness(tag_value(tags, "smoothness")),
    }
    pairs = F.array(*[F.struct(F.lit(d).alias("dim"), codes[d].alias("code")) for d in DIMS])
    return messages.where("dist_m > 0").withColumn("c", F.explode(pairs)).select("*", "c.dim", "c.code").drop("c")


def route_stats(messages: DataFrame) -> DataFrame:
    """Metres per track, dimension and code."""
    return classified(messages).groupBy("track_id", "dim", "code").agg(F.sum("dist_m").alias("meters"))


def stats_maps(stats: DataFrame, key: str = "track_id") -> DataFrame:
    """Nested form: total and one code -> metres map per dimension, largest first."""
    pair = F.struct((-F.col("meters")).alias("o"), F.col("code").alias("code"), F.col("meters").alias("m"))
    per_dim = stats.groupBy(key, "dim").agg(F.sort_array(F.collect_list(pair)).alias("e"), F.sum("meters").alias("total"))
    cols = [F.max(F.when(F.col("dim") == d, F.col("e"))).alias(d) for d in DIMS]
    folded = per_dim.groupBy(key).agg(F.max("total").alias("total"), *cols)
    return folded.select(key, "total", *[F.map_from_entries(F.transform(d, lambda x: F.struct(x["code"], x["m"]))).alias(f"{d}_m") for d in DIMS])


def merge_stats(nested: DataFrame, key: str) -> DataFrame:
    """Add up stats rows of several legs: explode the maps, sum by code. Rows with total 0 do not count."""
    rows = None
    live = nested.where("total > 0")
    for d in DIMS:
        part = live.select(key, F.lit(d).alias("dim"), F.explode(f"{d}_m").alias("code", "meters"))
        rows = part if rows is None else rows.unionByName(part)
    return rows.groupBy(key, "dim", "code").agg(F.sum("meters").alias("meters"))


def tag_breakdown(messages: DataFrame) -> DataFrame:
    """Metres and share per (key, value) of every tag, plus what no row of that key covers."""
    rows = messages.where("dist_m > 0")
    total = rows.groupBy("track_id").agg(F.sum("dist_m").alias("total"))
    token = F.filter(F.split("way_tags", " "), lambda t: (F.instr(t, "=") > 1) & ~(F.instr(t, "=") == F.length(t)))
    tags = rows.select("track_id", "dist_m", F.explode(token).alias("t"))
    cut = F.instr(F.col("t"), "=")
    tags = tags.select("track_id", "dist_m", F.col("t").substr(F.lit(1), cut - 1).alias("key"), F.col("t").substr(cut + 1, F.length("t")).alias("value"))
    per_value = tags.groupBy("track_id", "key", "value").agg(F.sum("dist_m").alias("meters"))
    per_key = per_value.groupBy("track_id", "key").agg(F.sum("meters").alias("tagged")).join(total, "track_id")
    rest = per_key.where("total > tagged").select("track_id", "key", F.lit(NO_TAG).alias("value"), (F.col("total") - F.col("tagged")).alias("meters"))
    out = per_value.unionByName(rest).join(total, "track_id")
    return out.withColumn("pct", 100.0 * F.col("meters") / F.col("total"))


def match_endpoints(messages: DataFrame, points: DataFrame) -> DataFrame:
    """Add ``end_idx``: the first vertex with the message's key at or after the vertex matched before it.

    Starts from "first vertex with that key" and lifts each lower bound to the running maximum of the matches
    before it until nothing moves; a track without repeated vertices needs one round. Unmatched stays NULL.
    """
    vertices = points.select("track_id", vertex_key("lng").alias("key_lng"), vertex_key("lat").alias("key_lat"), F.col("seq").alias("idx"))
    keys = ["track_id", "key_lng", "key_lat"]
    wanted = messages.select(*keys, "row_no", F.lit(0).alias("bound"))
    while True:
        rows = vertices.select(*keys, F.col("idx").alias("at"), F.lit(1).alias("kind"), "idx").unionByName(
            wanted.select(*keys, F.col("bound").alias("at"), F.lit(0).alias("kind"), "row_no"), allowMissingColumns=True
        )
        rows = rows.withColumns({"_at": F.struct("at", "kind", F.coalesce("row_no", "idx").alias("o")), "_chunk": F.floor(F.col("at") / 65_536)})
        found = fill_forward(rows, keys, "_at", {"end_idx": F.col("idx")}, backward=True).where("kind = 0")
        found = found.select(*keys, "row_no", F.col("at").alias("bound"), "end_idx")
        seen = running_max(found, "track_id", "row_no", "end_idx", "seen")
        state = cut_lineage(seen)
        if state.where(F.col("end_idx") < F.col("seen")).isEmpty():
            break
        wanted = state.select(*keys, "row_no", F.greatest("bound", F.coalesce("seen", F.lit(0))).alias("bound"))
    return messages.join(state.select("track_id", "row_no", "end_idx"), ["track_id", "row_no"], "left")


def stat_spans(messages: DataFrame, points: DataFrame) -> DataFrame:
    """Spans per dimension of messages with a length, matched among themselves; one that does not advance loses only its span."""
    live = match_endpoints(messages.where("dist_m > 0"), points)
    live = running_max(live, "track_id", "row_no", "end_idx", "start_idx").withColumn("start_idx", F.coalesce("start_idx", F.lit(0)))
    return classified(live.where(F.col("end_idx") > F.col("start_idx"))).select("track_id", "dim", "row_no", "start_idx", "end_idx", "code")


def merge_spans(spans: DataFrame) -> DataFrame:
    """Join consecutive spans with the same code and touching ends.

    Each scan reads its input twice, so the classified spans and the first scan's result are written once.
    """
    near = with_previous(materialize(spans, "spans"), ["track_id", "dim"], "row_no", {"p_code": "code", "p_end": "end_idx"})
    near = materialize(near, "spans")
    new = ~((F.col("p_code") == F.col("code")) & (F.col("p_end") == F.col("start_idx")))
    runs = islands(near, ["track_id", "dim"], "row_no", F.coalesce(new, F.lit(True)))
    return runs.groupBy("track_id", "dim", "island").agg(
        F.min("start_idx").alias("start_idx"), F.max("end_idx").alias("end_idx"), F.first("code").alias("code")
    ).drop("island")


def flat_spans(matched: DataFrame) -> DataFrame:
    """Tunnel and bridge spans, touching ones joined; one unmatched message voids its whole track."""
    void = matched.where(F.col("end_idx").isNull()).select("track_id").distinct()
    good = matched.join(void, "track_id", "left_anti")
    good = with_previous(good, "track_id", "row_no", {"p_end": "end_idx"}).drop("_chunk")
    start = F.coalesce("p_end", F.lit(0))
    flat = good.withColumn("start_idx", start).where(is_tunnel_or_bridge("way_tags") & (F.col("end_idx") > start))
    flat = with_previous(flat, "track_id", "row_no", {"f_end": "end_idx"})
    runs = islands(flat, "track_id", "row_no", F.coalesce(F.col("start_idx") > F.col("f_end"), F.lit(True)))
    return runs.groupBy("track_id", "island").agg(F.min("start_idx").alias("start_idx"), F.max("end_idx").alias("end_idx")).drop("island")
