"""Even shards that keep linked documents together, by balanced label propagation.

Documents of equal text are linked. Every linked document starts in a shard chosen by a hash of its id. In each round a
group's members look at their neighbours' shards: the group's fullest shard that still has room is the target, and the
members elsewhere ask to move there. Quotas bound what a shard takes in: requests are admitted by size class, in
hashed order inside, up to its room, the last ones in part. A group above a shard's quota fills one shard after the
other; a group whose shards are all full moves as a whole to a free one. Rounds end when nothing moves. Documents without links then fill every shard to its quota, so row counts differ by one at most.

State is one row per group with at most one count per shard; documents are only numbered inside their group, shard or
the pool of unlinked ones, in buckets that no hot group can fill alone.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from trackspark.plans.lineage import discard, materialize

from .registry import query, table

SHARDS = 40
#: Hashed steps of the admission order within a size class, and the number of rounds after which remaining links stay cut.
STEPS, ROUNDS = 64, 60
#: Rounds without a move that end the propagation; the admission order differs from round to round.
PATIENCE = 2
KEY = ["text_hash", "text_crc32", "size"]


def numbered(df: DataFrame, keys: list[str], total: int, name: str) -> DataFrame:
    """Number rows from 0 per key, in buckets small against a task's share of all rows."""
    tasks = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    size = max(64, total // (4 * tasks))
    out = df.withColumn("_bucket", F.pmod(F.xxhash64("doc_id", F.lit(name)), F.floor(F.lit(total) / size) + 1))
    inner = Window.partitionBy(*keys, "_bucket").orderBy("doc_id", *KEY)
    counts = out.groupBy(*keys, "_bucket").agg(F.count(F.lit(1)).alias("_n"))
    before = Window.partitionBy(*keys).orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    counts = counts.select(*keys, "_bucket", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"))
    out = out.withColumn("_row", F.row_number().over(inner)).join(counts, [*keys, "_bucket"])
    return out.withColumn(name, F.col("_row") - 1 + F.col("_before")).drop("_bucket", "_row", "_before")


def loads(groups: DataFrame, shards: int) -> list[int]:
    """Linked documents per shard; a row for each shard reaches the driver."""
    found = {r.shard: r.n for r in groups.select(F.inline("at")).groupBy("shard").agg(F.sum("n").alias("n")).collect()}
    return [found.get(s, 0) for s in range(shards)]


def propagate(groups: DataFrame, quota: list[int], rounds: int = ROUNDS) -> DataFrame:
    """Rounds of moves towards each group's fullest shard with room; ``at`` holds a group's counts per shard."""
    shards, idle = len(quota), 0
    for number in range(rounds):
        load = loads(groups, shards)
        room = F.array(*[F.lit(max(0, q - n)) for q, n in zip(quota, load, strict=True)])
        rank = lambda x: F.struct(x["n"].alias("n"), (-x["shard"]).alias("shard"))
        open_ = groups.select(*KEY, "at").withColumn("best", F.array_max(F.transform(F.filter("at", lambda x: F.get(room, x["shard"]) > 0), rank)))  # noqa: B023
        free = [s for s in range(shards) if load[s] < quota[s]]
        chance = F.get(F.array(*map(F.lit, free)), F.pmod(F.xxhash64(*KEY, F.lit(~number)), F.lit(len(free))).cast("int")) if free else F.lit(None).cast("int")
        whole = F.aggregate("at", F.lit(0).cast("long"), lambda n, x: n + x["n"])
        # All of the group's shards are full: it may move as a whole to a free one.
        open_ = open_.withColumn("fresh", F.col("best").isNull() & (F.size("at") > 1)).withColumn("to", F.coalesce(-F.col("best.shard"), F.when(F.col("fresh"), chance)))
        goes = lambda x: F.col("fresh") | (rank(x) < F.col("best"))  # noqa: E731, B023
        asks = open_.where(F.col("to").isNotNull() & (~F.col("fresh") | (whole <= F.get(room, F.col("to")))))
        asks = asks.withColumn("asked", F.aggregate("at", F.lit(0).cast("long"), lambda n, x: n + F.when(goes(x), x["n"]).otherwise(0)))  # noqa: B023
        asks = asks.withColumn("step", (F.floor(F.log2(F.greatest(F.lit(1), "asked"))) * -STEPS + F.pmod(F.xxhash64(*KEY, F.lit(number)), F.lit(STEPS))).cast("int"))
        steps = asks.where("asked > 0").groupBy("to", "step").agg(F.sum("asked").alias("sum"))
        before = F.sum("sum").over(Window.partitionBy("to").orderBy("step").rowsBetween(Window.unboundedPreceding, -1))
        left = F.get(room, F.col("to")) - F.coalesce(before, F.lit(0))
        steps = steps.select("to", "step", "sum", F.greatest(F.lit(0), F.least(F.col("sum"), left)).alias("left"))
        # At most one row per shard and step, of which each power of two has STEPS.
        asks = asks.join(F.broadcast(steps), ["to", "step"], "left")
        part = F.when(F.col("fresh"), F.lit(0)).otherwise(F.expr("asked * left div sum"))
        asks = asks.withColumn("moved", F.when(F.col("left") >= F.col("sum"), F.col("asked")).otherwise(F.coalesce(part, F.lit(0))).cast("long"))
        at = F.when(F.col("fresh"), F.array_append("at", F.struct(F.col("to").cast("int").alias("shard"), F.lit(0).cast("long").alias("n")))).otherwise(F.col("at"))
        none = F.array().cast("array<struct<shard:int,n:bigint>>")

        def settle(s, x):
            """Members leave in the order of the shards until the admitted number is reached."""
            out = F.when(goes(x) & (x["shard"] != F.col("to")), F.least(x["n"], s["open"])).otherwise(F.lit(0).cast("long"))  # noqa: B023
            stay = x["n"] - out + F.when(x["shard"] == F.col("to"), F.col("moved")).otherwise(0)
            return F.struct((s["open"] - out).alias("open"), F.array_append(s["at"], F.struct(x["shard"].alias("shard"), stay.alias("n"))).alias("at"))

        kept = F.aggregate(at, F.struct(F.col("moved").alias("open"), none.alias("at")), settle)["at"]
        moved = asks.select(*KEY, F.filter(kept, lambda x: x["n"] > 0).alias("at"), "moved")
        stay = open_.where(F.col("to").isNull() | (F.col("fresh") & (whole > F.get(room, F.col("to"))))).select(*KEY, "at", F.lit(0).cast("long").alias("moved"))
        after = materialize(moved.union(stay), "shards")
        total = after.agg(F.sum("moved")).first()[0]
        discard(groups)
        groups = after
        idle = 0 if total else idle + 1
        if idle == PATIENCE:
            break
    return groups


def shard(docs: DataFrame, shards: int = SHARDS, doc_id: str = "doc_id", text: str = "text", rounds: int = ROUNDS) -> DataFrame:
    """``doc_id, size, text_crc32, law, shard, slot, grown_shard`` for every row of ``docs``; law ``rows``.

    Sizes are UTF-8 bytes plus 16. Null texts have size 16 and checksum 0 and are linked with nothing; empty texts are
    equal texts. Repeated rows and rows without an id are rows like others. Other columns are not looked at.
    """
    data = F.encode(F.col("text"), "UTF-8")
    base = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text")).select(
        "doc_id", (F.coalesce(F.octet_length("text"), F.lit(0)) + 16).cast("long").alias("size"),
        F.coalesce(F.crc32(data), F.lit(0)).alias("text_crc32"), F.when(F.col("text").isNotNull(), F.xxhash64("text")).alias("text_hash"))
    base = materialize(base, "sizes")
    total = base.count()
    quota = [total // shards + (s < total % shards) for s in range(shards)]
    start = F.pmod(F.xxhash64("doc_id", F.lit("start")), F.lit(shards)).cast("int").alias("shard")
    counts = base.where("text_hash is not null").groupBy(*KEY, start).agg(F.count(F.lit(1)).alias("n"))
    groups = counts.groupBy(*KEY).agg(F.sum("n").alias("members"), F.collect_list(F.struct("shard", "n")).alias("at"))
    groups = propagate(materialize(groups.where("members > 1").select(*KEY, F.array_sort("at").alias("at")), "shards"), quota, rounds)
    linked = numbered(base.join(groups.select(*KEY), KEY, "left_semi"), KEY, total, "member").join(groups, KEY)
    ends = F.aggregate("at", F.struct(F.lit(0).cast("long").alias("n"), F.lit(None).cast("int").alias("shard")), lambda s, x: F.struct(
        (s["n"] + x["n"]).alias("n"), F.when((F.col("member") >= s["n"]) & (F.col("member") < s["n"] + x["n"]), x["shard"]).otherwise(s["shard"]).alias("shard")))
    placed = numbered(linked.select("doc_id", *KEY, ends["shard"].alias("shard")), ["shard"], total, "slot")
    full = F.array(*[F.lit(q) for q in quota])
    placed = materialize(placed.withColumn("over", F.col("slot") >= F.get(full, F.col("shard"))), "placed")
    free = base.join(groups.select(*KEY), [base[k].eqNullSafe(groups[k]) for k in KEY], "left_anti")
    pool = free.select("doc_id", *KEY).union(placed.where("over").select("doc_id", *KEY))
    settled = {r.shard: r.n for r in placed.where("not over").groupBy("shard").agg(F.count(F.lit(1)).alias("n")).collect()}
    holes, at = [], 0
    for s in range(shards):
        taken = settled.get(s, 0)
        if taken < quota[s]:
            holes.append(F.struct(F.lit(at).cast("long").alias("first"), F.lit(at + quota[s] - taken).cast("long").alias("end"), F.lit(s).alias("shard"), F.lit(taken).cast("long").alias("slot")))
            at += quota[s] - taken
    out = placed.where("not over").select("doc_id", *KEY, "shard", "slot")
    if holes:
        spot = F.get(F.filter(F.array(*holes), lambda h: (F.col("place") >= h["first"]) & (F.col("place") < h["end"])), F.lit(0))
        filled = numbered(pool, [], total, "place").withColumn("spot", spot)
        out = out.union(filled.select("doc_id", *KEY, F.col("spot.shard"), F.col("spot.slot") + F.col("place") - F.col("spot.first")))
    return out.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), F.col("shard").cast("int").alias("shard"), F.col("slot").cast("long").alias("slot"), F.lit(None).cast("int").alias("grown_shard"))


@query("op10_sharding")
def op10_sharding(spark: SparkSession, folder: str) -> DataFrame:
    """Shard and slot of every document."""
    return shard(table(spark, folder, "documents"))
