"""Exact top-k inner products with a pivot-distance index.

Vectors are lifted by one component, ``sqrt(M**2 - |v|**2)`` with ``M`` the largest norm, so that a larger inner product
with a query is a smaller distance: ``d**2 = |q|**2 + M**2 - 2 <q, v>``. Each vector is keyed by its nearest pivot and
its distance to it; rings of equal width around a pivot are the index's annuli, cut into blocks of bounded size. By the
triangle inequality no vector of an annulus ``[lo, hi]`` around ``p`` is closer to a query than ``d(q, p) - hi`` or
``lo - d(q, p)``. A query visits annuli in the order of that bound, round by round, and stops at the first whose bound
can't beat its k-th score.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from trackspark.plans.lineage import materialize

from .batches import map_arrow
from .registry import query, table

SCALE = 1024
#: Pivots, the vectors they are fitted on (by hash order), refinement steps, rings per pivot and vectors per block.
PIVOTS, FIT_ROWS, STEPS, RINGS, BLOCK = 64, 4096, 8, 32, 512
#: Queries that meet a block together.
QUERIES = 256
#: Vectors that a query's annuli hold in each round; the last round has all annuli within the bound.
ROUNDS = (512, 4096, None)


def quantize(df: DataFrame, vec_id: str, embedding: str, scale: int) -> DataFrame:
    """``vec_id, v`` (packed 64-bit integers), without vectors that are null or have null or non-finite components."""

    def run(batches):
        for batch in batches:
            ids, column = batch.column(0), batch.column(1)
            if isinstance(column, pa.ChunkedArray):
                column = column.combine_chunks()
            sizes = np.asarray(pc.list_value_length(column).fill_null(0))
            flat = pc.list_flatten(column)
            x = np.floor(np.asarray(flat.fill_null(np.nan).cast(pa.float64())) * scale)
            ends = np.cumsum(sizes)
            bad = np.concatenate(([0], np.cumsum(~np.isfinite(x))))
            good = np.asarray(column.is_valid()) & np.asarray(ids.is_valid()) & (bad[ends] == bad[ends - sizes])
            at = np.flatnonzero(good)
            packed = [x[ends[i] - sizes[i] : ends[i]].astype(np.int64).tobytes() for i in at]
            yield pa.RecordBatch.from_arrays([ids.take(pa.array(at)), pa.array(packed, pa.binary())], names=["vec_id", "v"])

    chosen = df.select(F.col(vec_id).cast("long").alias("vec_id"), F.col(embedding).alias("embedding"))
    return map_arrow(chosen, run, "vec_id long, v binary")


def matrix(packed: list[bytes], width: int) -> np.ndarray:
    """Rows of integers; shorter vectors end in zeros."""
    if all(len(p) == 8 * width for p in packed):
        return np.frombuffer(b"".join(packed), np.int64).reshape(len(packed), width)
    out = np.zeros((len(packed), width), np.int64)
    for i, p in enumerate(packed):
        out[i, : len(p) // 8] = np.frombuffer(p, np.int64)
    return out


def products(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Exact integer products; floating point serves where every partial sum is exact."""
    largest = float(np.abs(a).max(initial=0)) * float(np.abs(b).max(initial=0)) * max(1, a.shape[1])
    if largest < 2.0**53:
        return (a.astype(np.float64) @ b.T.astype(np.float64)).astype(np.int64)
    return a @ b.T


def lifted(v: np.ndarray, top: float) -> np.ndarray:
    x = v.astype(np.float64)
    return np.concatenate([x, np.sqrt(np.maximum(0.0, top - (x * x).sum(axis=1, keepdims=True)))], axis=1)


def distances(x: np.ndarray, pivots: np.ndarray) -> np.ndarray:
    square = (x * x).sum(axis=1)[:, None] + (pivots * pivots).sum(axis=1)[None] - 2 * (x @ pivots.T)
    return np.sqrt(np.maximum(0.0, square))


def fit_pivots(sample: np.ndarray, count: int) -> np.ndarray:
    """Centres of a few k-means steps from evenly spaced rows of the sample."""
    pivots = sample[np.unique(np.linspace(0, len(sample) - 1, min(count, len(sample))).astype(int))]
    for _ in range(STEPS):
        near = distances(sample, pivots).argmin(axis=1)
        n = np.bincount(near, minlength=len(pivots))
        total = np.zeros_like(pivots)
        np.add.at(total, near, sample)
        pivots = np.where(n[:, None] > 0, total / np.maximum(n, 1)[:, None], pivots)
    return pivots


class Index:
    """Blocks of the annuli, and the annuli's bounds (at most pivots times rings)."""

    def __init__(self, vectors: DataFrame, pivots: int, fit_rows: int):
        spark = vectors.sparkSession
        norm = F.octet_length("v")
        self.width = (vectors.agg(F.max(norm)).first()[0] or 0) // 8
        width = self.width
        sample = vectors.orderBy(F.xxhash64("vec_id"), "vec_id").limit(fit_rows).toArrow().column("v").to_pylist()

        def norms(batches):
            for batch in batches:
                x = matrix(batch.column(0).to_pylist(), width).astype(np.float64)
                yield pa.RecordBatch.from_arrays([pa.array([float((x * x).sum(axis=1).max(initial=0.0))])], names=["n"])

        top = map_arrow(vectors.select("v"), norms, "n double").agg(F.max("n")).first()[0] or 0.0
        self.top = top
        self.pivots = fit_pivots(lifted(matrix(sample, width), top), pivots) if sample else np.zeros((1, width + 1))
        wide = 2 * np.sqrt(top) / RINGS + 1e-9
        self.shipped = spark.sparkContext.broadcast((self.pivots, top, width))
        shipped = self.shipped

        def keys(batches):
            centres, top, width = shipped.value
            for batch in batches:
                d = distances(lifted(matrix(batch.column(1).to_pylist(), width), top), centres)
                near = d.argmin(axis=1) if len(d) else np.empty(0, np.int64)
                d = d[np.arange(len(d)), near]
                ring = np.minimum(RINGS - 1, (d / wide).astype(np.int64))
                yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(near * RINGS + ring, pa.int64()), pa.array(d)], names=["vec_id", "v", "cell", "d"])

        keyed = map_arrow(vectors, keys, "vec_id long, v binary, cell long, d double")
        cells = keyed.groupBy("cell").agg(F.count(F.lit(1)).alias("n"), F.min("d").alias("lo"), F.max("d").alias("hi")).collect()
        self.cells = sorted((r.cell, r.n, r.lo, r.hi) for r in cells)
        share = F.create_map(*[F.lit(x) for r in self.cells for x in (r[0], -(-r[1] // BLOCK))]) if self.cells else F.lit(None).cast("map<bigint,bigint>")
        part = F.pmod(F.xxhash64("vec_id", "v"), F.coalesce(F.element_at(share, F.col("cell")), F.lit(1)).cast("long"))

        def pack(data: pa.Table) -> pa.Table:
            out = []
            for first in range(0, len(data), BLOCK):
                rows = data.slice(first, BLOCK)
                out.append((rows.column("cell")[0].as_py(), rows.column("vec_id").to_numpy().tobytes(), matrix(rows.column("v").to_pylist(), width).tobytes()))
            return pa.table({"cell": pa.array([r[0] for r in out], pa.int64()), "ids": pa.array([r[1] for r in out], pa.binary()), "data": pa.array([r[2] for r in out], pa.binary())})

        blocks = keyed.select("cell", "vec_id", "v", part.alias("part")).groupBy("cell", "part").applyInArrow(pack, "cell long, ids binary, data binary")
        self.blocks = materialize(blocks, "blocks")

    def plan(self, queries: DataFrame, round_: int, k: int) -> DataFrame:
        """``(cell, query_id, v)`` of the annuli that a query ``(query_id, v, least, seen)`` visits in this round."""
        shipped, cells, budget = self.shipped, self.cells, ROUNDS[round_]
        earlier = ROUNDS[:round_]

        def run(batches):
            centres, top, width = shipped.value
            code, count, lo, hi = (np.array(x) for x in zip(*cells, strict=True))
            pivot = code // RINGS
            for batch in batches:
                packed = batch.column(1).to_pylist()
                q = matrix(packed, width)
                least = batch.column(2).to_numpy(zero_copy_only=False)
                x = np.concatenate([q.astype(np.float64), np.zeros((len(q), 1))], axis=1)
                d = distances(x, centres)[:, pivot]
                bound = np.maximum(0.0, np.maximum(lo - d, d - hi) * (1 - 1e-9) - 1e-6)
                best = ((x * x).sum(axis=1)[:, None] + top - bound * bound) / 2
                best = best + 1 + 1e-9 * np.abs(best)
                order = np.argsort(bound, axis=1, kind="stable")
                taken = np.cumsum(count[order], axis=1)
                before = taken - count[order]
                done = np.zeros(order.shape, bool)
                for b in earlier:
                    done |= before < b
                go = ~done if budget is None else ~done & (before < budget)
                go &= np.take_along_axis(best, order, axis=1) >= np.where(np.isnan(least), -np.inf, least)[:, None]
                r, c = np.nonzero(go)
                yield pa.RecordBatch.from_arrays([pa.array(code[order[r, c]], pa.int64()), batch.column(0).take(pa.array(r)), batch.column(1).take(pa.array(r))], names=["cell", "query_id", "v"])

        return map_arrow(queries.select("query_id", "v", F.col("least").cast("double")), run, "cell long, query_id long, v binary")

    def scan(self, visits: DataFrame, k: int) -> DataFrame:
        """The k best of every query over the blocks of its annuli, per task: ``(query_id, vec_id, score)``."""
        width = self.width
        groups = visits.withColumn("part", F.pmod(F.xxhash64("query_id"), F.lit(64)))
        tile = Window.partitionBy("cell", "part").orderBy("query_id")
        groups = groups.withColumn("tile", F.floor((F.row_number().over(tile) - 1) / QUERIES)).groupBy("cell", "part", "tile").agg(F.collect_list(F.struct("query_id", "v")).alias("queries"))
        joined = groups.join(self.blocks, "cell").select("queries", "ids", "data")

        def run(batches):
            kept: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
            size = 0

            def reduced():
                q, v, s = (np.concatenate(x) for x in zip(*kept, strict=True))
                order = np.lexsort((v, -s, q))
                q, v, s = q[order], v[order], s[order]
                first = np.flatnonzero(np.append(True, q[1:] != q[:-1]))
                rank = np.arange(len(q)) - np.repeat(first, np.diff(np.append(first, len(q))))
                return q[rank < k], v[rank < k], s[rank < k]

            for batch in batches:
                for queries, ids, data in zip(*(batch.column(i) for i in range(3)), strict=True):
                    queries = queries.as_py()
                    number = np.array([x["query_id"] for x in queries], np.int64)
                    vec = np.frombuffer(ids.as_py(), np.int64)
                    score = products(matrix([x["v"] for x in queries], width), np.frombuffer(data.as_py(), np.int64).reshape(len(vec), width))
                    own = number[:, None] == vec[None]
                    # Partition by score, then keep all that tie with the k-th, so that ties go by id.
                    masked = np.where(own, np.iinfo(np.int64).min, score)
                    if len(vec) > k:
                        bar = np.partition(masked, len(vec) - k, axis=1)[:, len(vec) - k]
                        r, c = np.nonzero((masked >= bar[:, None]) & ~own)
                    else:
                        r, c = np.nonzero(~own)
                    kept.append((number[r], vec[c], score[r, c]))
                    size += len(r)
                    if size > 200_000:
                        kept = [reduced()]
                        size = len(kept[0][0])
                        if size > 150_000:
                            yield result(*kept.pop())
                            size = 0
            if kept:
                yield result(*reduced())

        def result(q, v, s):
            return pa.RecordBatch.from_arrays([pa.array(q, pa.int64()), pa.array(v, pa.int64()), pa.array(s, pa.int64())], names=["query_id", "vec_id", "score"])

        return map_arrow(joined, run, "query_id long, vec_id long, score long")


def top_k(df: DataFrame, queries: DataFrame, k: int = 10, scale: int = SCALE, vec_id: str = "vec_id", embedding: str = "embedding", pivots: int = PIVOTS, fit_rows: int = FIT_ROWS) -> DataFrame:
    """``query_id, rank, vec_id, score``: each query's ``k`` best integer inner products over all other vectors.

    Components become ``floor(scale * x)``. Vectors that are null or empty of an id, or hold null or non-finite
    components, take no part; shorter vectors count as ending in zeros. Ties go to the smaller id; rows that share an id
    are candidates each, and never candidates of a query of that id. Repeated query rows count once. Pivots are fitted
    on a bounded sample, every vector is indexed, and results are exact. Other columns are not looked at.
    """
    vectors = materialize(quantize(df, vec_id, embedding, scale), "vectors")
    index = Index(vectors, pivots, fit_rows)
    asked = quantize(queries, vec_id, embedding, scale).select(F.col("vec_id").alias("query_id"), "v").dropDuplicates(["query_id"])
    asked = materialize(asked, "queries")
    empty = asked.select("query_id", F.lit(0).cast("long").alias("vec_id"), F.lit(0).cast("long").alias("score")).limit(0)
    if not index.cells:
        return empty.select("query_id", F.lit(1).alias("rank"), "vec_id", "score")
    best = None
    order = Window.partitionBy("query_id").orderBy(F.col("score").desc(), "vec_id")
    for round_ in range(len(ROUNDS)):
        known = asked.withColumn("least", F.lit(None).cast("double"))
        if best is not None:
            kth = best.where(F.col("rank") == k).select("query_id", F.col("score").cast("double").alias("least"))
            known = asked.join(kth, "query_id", "left")
        found = index.scan(index.plan(known, round_, k), k)
        if best is not None:
            found = found.union(best.select("query_id", "vec_id", "score"))
        best = materialize(found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k), "best")
    return best.select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")


SQL = r"""
WITH v AS (
  SELECT vec_id, [CAST(floor(1024 * CAST(x AS DOUBLE)) AS BIGINT) FOR x IN embedding] AS e FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), s AS (
  SELECT q.vec_id AS query_id, c.vec_id, CAST(list_sum(list_transform(list_zip(q.e, c.e), lambda p: p[1] * p[2])) AS BIGINT) AS score
  FROM v q JOIN v c ON c.vec_id <> q.vec_id WHERE q.vec_id % 100 = 0
), r AS (
  SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank, vec_id, score FROM s
)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 10
"""


@query("op2_exact_topk", SQL)
def op2_exact_topk(spark: SparkSession, folder: str) -> DataFrame:
    """Ten nearest vectors of every query."""
    vectors = table(spark, folder, "embeddings")
    return top_k(vectors, vectors.where("vec_id % 100 = 0"))
