"""Ordered scans over long sequences without putting a whole key into one task.

A plain ``Window.partitionBy(track).orderBy(seq)`` sends every row of a track to one task. Here each key is
cut into chunks of its order column; windows run per (key, chunk) and only one summary row per chunk is
combined per key, so one very long key is spread over many tasks.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

CHUNK = 65_536
CHUNK_COL = "_chunk"


def _keys(key) -> list[str]:
    return [key] if isinstance(key, str) else list(key)


def with_chunk(df: DataFrame, order: str, size: float = CHUNK) -> DataFrame:
    return df.withColumn(CHUNK_COL, F.floor(F.col(order) / size))


def spread(df: DataFrame, *keys: str) -> DataFrame:
    """Hash rows over all shuffle partitions, for stages whose cost is computing rather than bytes.

    Adaptive execution merges small partitions by size only, which would leave such a stage to a few tasks. A later
    window or join on the same keys reuses this partitioning.
    """
    return df.repartition(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), *keys)


def with_neighbors(df, key, order, prev=None, nxt=None, size: int = CHUNK, heavy: bool = False) -> DataFrame:
    """Add columns of the row before / after; the order column must be dense per key.

    ``prev`` and ``nxt`` map new column names to existing ones. Rows at a chunk edge are copied into the
    adjoining chunk instead of joining the chunks. ``heavy`` keeps the result spread for costly work per row.
    """
    prev, nxt = prev or {}, nxt or {}
    o = F.col(order)
    home = F.floor(o / size)
    copies = [home]
    if prev:
        copies.append(F.when((o + 1) % size == 0, home + 1))
    if nxt:
        copies.append(F.when((o % size == 0) & (o > 0), home - 1))
    out = df.withColumn("_home", home).withColumn(CHUNK_COL, F.explode(F.array_compact(F.array(*copies))))
    if heavy:
        out = spread(out, *_keys(key), CHUNK_COL)
    w = Window.partitionBy(*_keys(key), CHUNK_COL).orderBy(order)
    cols = {n: F.lag(c).over(w) for n, c in prev.items()} | {n: F.lead(c).over(w) for n, c in nxt.items()}
    return out.withColumns(cols).where(F.col("_home") == F.col(CHUNK_COL)).drop("_home")


def _carry(df, key, aggs: dict[str, Column], combine, backward: bool = False) -> DataFrame:
    """One row per (key, chunk) holding what the earlier (or later) chunks of that key amount to.

    This reads ``df`` a second time, with only the columns it needs and aggregated before the shuffle; a chain of
    scans should be written out in between (see :func:`..plans.lineage.materialize`).
    """
    keys = _keys(key)
    per_chunk = df.groupBy(*keys, CHUNK_COL).agg(*[c.alias("_c_" + n) for n, c in aggs.items()])
    w = Window.partitionBy(*keys).orderBy(F.col(CHUNK_COL).desc() if backward else CHUNK_COL)
    w = w.rowsBetween(Window.unboundedPreceding, -1)
    return per_chunk.select(*keys, CHUNK_COL, *[combine("_c_" + n).over(w).alias("_c_" + n) for n in aggs])


def _chunked(df, order, size):
    return df if CHUNK_COL in df.columns else with_chunk(df, order, size)


def running_sum(df, key, order, sums: dict[str, Column], size: int = CHUNK) -> DataFrame:
    """Cumulative sums along ``order`` (NULL counts as zero)."""
    df = _chunked(df, order, size)
    sums = {n: F.coalesce(c, F.lit(0)) for n, c in sums.items()}
    w = Window.partitionBy(*_keys(key), CHUNK_COL).orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    inner = df.withColumns({n: F.sum(c).over(w) for n, c in sums.items()})
    carry = _carry(df, key, {n: F.sum(c) for n, c in sums.items()}, F.sum)
    out = inner.join(carry, [*_keys(key), CHUNK_COL])
    total = {n: F.col(n) + F.coalesce(F.col("_c_" + n), F.lit(0)) for n in sums}
    return out.withColumns(total).drop(*["_c_" + n for n in sums])


def running_max(df, key, order: str, value: str, name: str, size: int = CHUNK) -> DataFrame:
    """Largest ``value`` over the rows before this one (NULL on the first)."""
    df = with_chunk(df, order, size)
    keys = _keys(key)
    w = Window.partitionBy(*keys, CHUNK_COL).orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    inner = df.withColumn(name, F.max(value).over(w))
    carry = _carry(df, keys, {"m": F.max(value)}, F.max)
    out = inner.join(carry, [*keys, CHUNK_COL])
    return out.withColumn(name, F.greatest(name, "_c_m")).drop("_c_m", CHUNK_COL)


def fill_forward(df, key, order, cols: dict[str, Column], size: float = CHUNK, backward=False) -> DataFrame:
    """Last non-NULL value at or before each row (``backward``: first at or after)."""
    df = _chunked(df, order, size)
    keys = _keys(key)
    o = F.col(order).desc() if backward else F.col(order)
    w = Window.partitionBy(*keys, CHUNK_COL).orderBy(o).rowsBetween(Window.unboundedPreceding, 0)
    inner = df.withColumns({n: F.last(c, ignorenulls=True).over(w) for n, c in cols.items()})
    pick = F.min_by if backward else F.max_by
    last = {n: pick(c, F.when(c.isNotNull(), F.col(order))) for n, c in cols.items()}
    carry = _carry(df, keys, last, lambda n: F.last(n, ignorenulls=True), backward)
    out = inner.join(carry, [*keys, CHUNK_COL])
    return out.withColumns({n: F.coalesce(F.col(n), F.col("_c_" + n)) for n in cols}).drop(*["_c_" + n for n in cols])


def with_previous(df, key, order, prev: dict[str, str], size: int = CHUNK) -> DataFrame:
    """Like :func:`with_neighbors` for order columns with gaps: the row before, however far back."""
    df = _chunked(df, order, size)
    keys = _keys(key)
    w = Window.partitionBy(*keys, CHUNK_COL).orderBy(order)
    row = F.struct(*[F.col(c).alias(n) for n, c in prev.items()])
    inner = df.withColumn("_p", F.lag(row).over(w))
    carry = _carry(df, keys, {"p": F.max_by(row, order)}, lambda n: F.last(n, ignorenulls=True))
    out = inner.join(carry, [*keys, CHUNK_COL]).withColumn("_p", F.coalesce("_p", "_c_p"))
    return out.withColumns({n: F.col("_p")[n] for n in prev}).drop("_p", "_c_p")


def islands(df, key, order, starts: Column, name: str = "island", size: int = CHUNK) -> DataFrame:
    """Number runs: a row where ``starts`` holds opens a new run."""
    return running_sum(df, key, order, {name: F.when(starts, 1).otherwise(0)}, size)


def dense_rank_rows(df, key, order, name: str, size: int = CHUNK) -> DataFrame:
    """Row number from 0 along a global ``order`` column, per key."""
    out = running_sum(df, key, order, {name: F.lit(1)}, size)
    return out.withColumn(name, (F.col(name) - 1).cast("int")).drop(CHUNK_COL)


def top_k(df, key, order: list[Column], k: int, rank: str = "rank", salts: int = 16) -> DataFrame:
    """First ``k`` rows per key; rows are cut per (key, salt) before a key's survivors meet in one task."""
    keys = _keys(key)
    salt = F.pmod(F.xxhash64(*[c for c in df.columns if dict(df.dtypes)[c][:3] != "map"]), F.lit(salts))
    pre = df.withColumn("_salt", salt)
    w1 = Window.partitionBy(*keys, "_salt").orderBy(*order)
    pre = pre.withColumn("_r", F.row_number().over(w1)).where(F.col("_r") <= k).drop("_r", "_salt")
    w2 = Window.partitionBy(*keys).orderBy(*order)
    return pre.withColumn(rank, F.row_number().over(w2)).where(F.col(rank) <= k)
