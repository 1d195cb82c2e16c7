"""Near-duplicate documents by MinHash.

1. Each document becomes the set of its five-word shingles; documents of one set are one node. A node's signature is
   the minima of many universal hash functions; runs of minima are its bands.
2. Nodes that share a band are candidates. The first pass links each bucket's members to its leader only, the member
   that shares most with others. A second pass takes the buckets that still hold several components: their members
   outside the largest component meet all members of other components. Where that would be many pairs (a crowd of
   loosely similar texts), blocks of the members meet in tiles with their shingle sets: a task compares the signatures
   of two blocks column by column and the sets of what can pass, and names only as many links as join the components of
   its blocks. No list of a crowd's pairs is made.
3. Candidates pass a test of their signatures, then the exact overlap of their full shingle sets.
4. Components come from alternating large-star and small-star.

So every two members of a bucket are compared, or are in one component already. A crowd's comparisons grow with the
square of its members, those of one task do not.

A pair at the threshold shares no band with a chance of ``(1 - 0.75 ** 4) ** 40 = 2.5e-7`` and a pair above it with
less; the signature test rejects it with a chance under 1e-6 (4.9 standard deviations).
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from trackspark.plans.lineage import discard, materialize

from .batches import map_arrow
from .components import components
from .registry import query, table
from .words import SPACED_LOWER, Slice, mix, powers, slices

SHINGLE = 5
PERCENT = 75
ROWS, BANDS = 4, 40
MINIMA = ROWS * BANDS
#: Signature minima that must agree; the threshold less 4.9 standard deviations.
AGREE = round(MINIMA * (0.75 - 4.9 * (0.75 * 0.25 / MINIMA) ** 0.5))
#: Pairs per member up to which all pairs between a bucket's components are candidates.
SPARE = 2
#: Members of a crowded bucket in a tile: those outside the largest component, and all; so many shingles each on average.
ODD, ALL, SET = 2048, 4096, 512
#: Pairs that are sent to every executor as a filter (16 bytes each); above, the texts are joined by a shuffle.
SENT_PAIRS = 500_000

_random = np.random.default_rng(20_240_501)
FACTORS = (_random.integers(0, 1 << 31, MINIMA, np.int64) * 2 + 1).astype(np.uint32)
OFFSETS = _random.integers(0, 1 << 32, MINIMA, np.int64).astype(np.uint32)


def shingles(part: Slice, size: int = SHINGLE) -> tuple[np.ndarray, np.ndarray]:
    """Row and hash of every distinct shingle, ordered by row; a shorter text is one shingle."""
    at, code = part.windows(size)
    row = part.row[at]
    counts = part.counts()
    short = np.flatnonzero((counts > 0) & (counts < size))
    if len(short):
        first = (np.cumsum(counts) - counts)[short]
        up, down = powers(len(part.hash) + 1)
        total = np.zeros(len(part.hash) + 1, np.uint64)
        np.cumsum(part.hash * up[: len(part.hash)], out=total[1:])
        whole = mix((total[first + counts[short]] - total[first]) * down[first] + counts[short].astype(np.uint64))
        row, code = np.concatenate((row, short)), np.concatenate((code, whole))
    order = np.lexsort((code, row))
    row, code = row[order], code[order]
    new = np.ones(len(row), bool)
    new[1:] = (row[1:] != row[:-1]) | (code[1:] != code[:-1])
    return row[new], code[new]


def signatures(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """``doc_id, n_shingles, set1, set2, minima``: size, 128-bit identity and MinHash minima of every row's shingle set."""

    def run(batches):
        for batch in batches:
            for part in slices(batch.column(1), SPACED_LOWER):
                row, code = shingles(part)
                size = np.bincount(row, minlength=part.rows)
                filled = np.flatnonzero(size)
                first = (np.cumsum(size) - size)[filled]
                minima = np.zeros((part.rows, MINIMA), np.uint32)
                sets = np.zeros((2, part.rows), np.uint64)
                if len(filled):
                    x = (code >> np.uint64(32)).astype(np.uint32)
                    for k in range(MINIMA):
                        minima[filled, k] = np.minimum.reduceat(x * FACTORS[k] + OFFSETS[k], first)
                    sets[0, filled] = np.add.reduceat(code, first)
                    sets[1, filled] = np.add.reduceat(mix(code + np.uint64(1)), first)
                flat = pa.array(minima.view(np.int32).reshape(-1))
                yield pa.RecordBatch.from_arrays([
                    batch.column(0).slice(part.first, part.rows), pa.array(size, pa.int64()), pa.array(sets[0].view(np.int64)), pa.array(sets[1].view(np.int64)),
                    pa.ListArray.from_arrays(pa.array(np.arange(part.rows + 1, dtype=np.int32) * MINIMA), flat),
                ], names=["doc_id", "n_shingles", "set1", "set2", "minima"])

    chosen = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text"))
    return map_arrow(chosen, run, "doc_id long, n_shingles long, set1 long, set2 long, minima array<int>")


def band(number):
    """Hash of one band of a row's minima."""
    return F.xxhash64(number, F.slice("minima", number * ROWS + 1, ROWS))


def pairs_of(df: DataFrame, x: str, y: str) -> DataFrame:
    """Distinct pairs ``(a, b)``, the smaller id first."""
    return df.where(F.col(x) != F.col(y)).select(F.least(x, y).alias("a"), F.greatest(x, y).alias("b")).distinct()


def agree(left: str, right: str):
    """Number of equal minima of two signatures."""
    return F.aggregate(F.zip_with(left, right, lambda x, y: (x == y).cast("int")), F.lit(0), lambda n, x: n + x)


def similar(pairs: DataFrame, percent: int) -> DataFrame:
    """``(a, b)`` of rows ``(a, b, text_a, text_b)`` whose full shingle sets overlap by at least ``percent``."""

    def run(batches):
        for batch in batches:
            for first in range(0, len(batch), 128):
                rows = batch.slice(first, 128)
                n = len(rows)
                sides = []
                for column in (2, 3):
                    found = [(row + part.first, code) for part in slices(rows.column(column), SPACED_LOWER) for row, code in [shingles(part)]]
                    sides.append((np.concatenate([r for r, _ in found]), np.concatenate([c for _, c in found])))
                row, code = (np.concatenate(x) for x in zip(*sides, strict=True))
                size = np.bincount(row, minlength=n)
                order = np.lexsort((code, row))
                row, code = row[order], code[order]
                both = np.bincount(row[1:][(row[1:] == row[:-1]) & (code[1:] == code[:-1])], minlength=n)
                keep = np.flatnonzero((size > 0) & (100 * both >= percent * (size - both)))
                yield pa.RecordBatch.from_arrays([rows.column(k).take(pa.array(keep)) for k in (0, 1)], names=["a", "b"])

    return map_arrow(pairs, run, "a long, b long")


def sets_of(texts: DataFrame) -> DataFrame:
    """``id, codes``: the sorted hashes of every shingle set of rows ``(id, text)``, eight bytes each."""

    def run(batches):
        for batch in batches:
            for part in slices(batch.column(1), SPACED_LOWER):
                row, code = shingles(part)
                ends = np.cumsum(np.bincount(row, minlength=part.rows))
                sets = [x.tobytes() for x in np.split(code, ends[:-1])]
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(part.first, part.rows), pa.array(sets, pa.large_binary()).cast(pa.binary())], names=["id", "codes"])

    return map_arrow(texts, run, "id long, codes binary")


def low_bytes(nodes: DataFrame) -> DataFrame:
    """``id, low``: the lowest byte of every minimum; where minima agree, so do these."""

    def run(batches):
        for batch in batches:
            flat = np.asarray(batch.column(1).flatten()).astype(np.uint8).reshape(-1, MINIMA)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([x.tobytes() for x in flat], pa.binary())], names=["id", "low"])

    return map_arrow(nodes.select("id", "minima"), run, "id long, low binary")


def tile(data: pa.Table, percent: int) -> pa.Table:
    """Of two blocks of one bucket: links ``(a, b)`` that join all components with a link between the blocks.

    A member meets those of other components whose low bytes agree often enough, the closest first; the rest only while
    they are still in other components. Sets are compared in full.
    """
    side = np.asarray(data.column("odd"))
    ids = np.asarray(data.column("id"))
    parts = np.unique(np.asarray(data.column("component")), return_inverse=True)[1]
    low = np.frombuffer(b"".join(data.column("low").to_pylist()), np.uint8).reshape(-1, MINIMA)
    sets = data.column("codes").to_pylist()
    size = np.array([len(x) // 8 for x in sets], np.int64)
    first = np.cumsum(size) - size
    codes, flat = np.unique(np.frombuffer(b"".join(sets), np.uint64), return_inverse=True)
    del sets
    odd, every = np.flatnonzero(side), np.flatnonzero(~side)
    columns = np.ascontiguousarray(low[every].T)
    mark = np.zeros(len(codes), bool)
    links = []

    def linked(row: int, others: np.ndarray) -> np.ndarray:
        """Those of ``others`` whose set overlaps that of ``row`` by the threshold."""
        n = size[others]
        starts = np.cumsum(n) - n
        at = np.repeat(first[others] - starts, n) + np.arange(int(n.sum()))
        both = np.add.reduceat(mark[flat[at]], starts, dtype=np.int64)
        return others[100 * both >= percent * (size[row] + n - both)]

    for start in range(0, len(odd), 128):
        mine = odd[start : start + 128]
        same = np.zeros((len(mine), len(every)), np.uint8)
        for k in range(MINIMA):
            same += low[mine, k][:, None] == columns[k]
        for row, agreed in zip(mine, same, strict=True):
            near = np.flatnonzero(agreed >= AGREE)
            near = every[near[np.argsort(-agreed[near].astype(np.int16), kind="stable")]]
            own = flat[first[row] : first[row] + size[row]]
            mark[own] = True
            # The closest first: most members are joined to most others by it.
            for lot in (slice(0, 1), slice(1, None)):
                others = near[lot]
                others = others[parts[others] != parts[row]]
                # No more sets at once than fit into a block.
                for few in np.split(others, range(512, len(others), 512)):
                    few = few[parts[few] != parts[row]]
                    for other in linked(row, few) if len(few) else ():
                        if parts[other] != parts[row]:
                            links.append((ids[row], ids[other]))
                            parts[parts == parts[other]] = parts[row]
            mark[own] = False
    x, y = np.array(links, np.int64).reshape(-1, 2).T
    return pa.table({"a": pa.array(np.minimum(x, y), pa.int64()), "b": pa.array(np.maximum(x, y), pa.int64())})


class Search:
    """State of one search: texts and signatures of the nodes."""

    def __init__(self, docs: DataFrame, nodes: DataFrame, percent: int):
        self.docs, self.nodes, self.percent = docs, nodes, percent

    def confirm(self, pairs: DataFrame) -> DataFrame:
        """Linked pairs among candidates ``(a, b)``."""
        minima = self.nodes.select("id", "minima")
        left, right = (minima.select(F.col("id").alias(x), F.col("minima").alias(f"minima_{x}")) for x in "ab")
        close = pairs.join(left, "a").join(right, "b").where(agree("minima_a", "minima_b") >= AGREE).select("a", "b")
        close = materialize(close, "close")
        texts = self.docs
        if close.count() <= SENT_PAIRS:
            wanted = close.select(F.col("a").alias("id")).union(close.select(F.col("b"))).distinct()
            texts = texts.join(F.broadcast(wanted), "id", "left_semi")
        left, right = (texts.select(F.col("id").alias(x), F.col("text").alias(f"text_{x}")) for x in "ab")
        joined = close.join(left, "a").join(right, "b").select("a", "b", "text_a", "text_b")
        found = materialize(similar(joined, self.percent), "similar")
        discard(close)
        return found

    def open_buckets(self, members: DataFrame, label: DataFrame) -> DataFrame:
        """Members of the buckets that hold several components, with the bucket's counts."""
        named = members.join(label, "id", "left").withColumn("component", F.coalesce("component", "id"))
        parts = named.groupBy("key", "component").agg(F.count(F.lit(1)).alias("n"))
        total = parts.groupBy("key").agg(
            F.sum("n").alias("n"), F.sum(F.col("n") * F.col("n")).alias("squares"), F.max(F.struct("n", "component")).alias("main")).where("squares < n * n")
        crowded = F.expr("n * n - squares") > 2 * (F.lit(SPARE) * F.col("n") + 64)
        return named.join(total.select("key", "n", F.expr("n - main.n").alias("n_odd"), F.col("main.component").alias("main"), crowded.alias("crowded")), "key")

    def tiles(self, crowd: DataFrame) -> DataFrame:
        """Links ``(a, b)`` between the components of the buckets of ``crowd``, as many as join them."""
        wanted = materialize(crowd.select("id").distinct(), "wanted")
        few = wanted.count() <= 2 * SENT_PAIRS
        some = F.broadcast(wanted) if few else wanted
        low = low_bytes(self.nodes.join(some, "id", "left_semi"))
        sets = sets_of(self.docs.join(some, "id", "left_semi").select("id", "text"))
        facts = materialize(low.join(sets.where(F.length("codes") > 0), "id").withColumn("size", F.length("codes") / 8), "facts")
        # Blocks are bounded in members and in shingles.
        strange = F.col("component") != F.col("main")
        sized = crowd.select("key", "id", "component", "main").join(facts.select("id", "size"), "id")
        blocks = lambda n, w, most: F.greatest(F.ceil(n / most), F.ceil(w / (most * SET))).cast("long")
        counts = sized.groupBy("key").agg(
            blocks(F.count_if(strange), F.sum(F.when(strange, F.col("size")).otherwise(0)), ODD).alias("p"), blocks(F.count(F.lit(1)), F.sum("size"), ALL).alias("q"))
        members = crowd.select("key", "id", "component", "main").join(counts, "key").join(facts.drop("size"), "id")
        deal = lambda n, seed: F.pmod(F.xxhash64("id", F.lit(seed)), F.col(n))
        count = lambda n: F.explode(F.sequence(F.lit(0).cast("long"), F.col(n) - 1))
        odd = members.where(strange).select("key", deal("p", 1).alias("i"), count("q").alias("j"), "id", "component", "low", "codes", F.lit(True).alias("odd"))
        every = members.select("key", count("p").alias("i"), deal("q", 2).alias("j"), "id", "component", "low", "codes", F.lit(False).alias("odd"))
        percent = self.percent
        links = odd.union(every).groupBy("key", "i", "j").applyInArrow(lambda data: tile(data, percent), "a long, b long").distinct()
        found = materialize(links, "links")
        discard(wanted, facts)
        return found

    def joined(self, label: DataFrame, found: DataFrame) -> DataFrame:
        """The components after further links."""
        return label if found.isEmpty() else components(label.select(F.col("component").alias("a"), F.col("id").alias("b")).union(found))

    def run(self) -> DataFrame:
        """``(id, component)`` of the linked nodes."""
        bands = F.transform(F.sequence(F.lit(0), F.lit(BANDS - 1)), band)
        rows = self.nodes.select("id", F.explode(bands).alias("key"))
        buckets = rows.groupBy("key").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
        shared = materialize(rows.join(buckets, "key"), "buckets")
        # A node that shares large buckets often is close to what its neighbours have in common.
        common = shared.groupBy("id").agg(F.sum("n").alias("common"))
        members = materialize(shared.drop("n").join(common, "id"), "members")
        discard(shared)
        rank = F.struct("common", (-F.col("id")).alias("least"))
        leader = members.groupBy("key").agg((-F.max(rank)["least"]).alias("leader"))
        tried = materialize(pairs_of(members.join(leader, "key"), "leader", "id"), "stars")
        label = components(self.confirm(tried))
        open_ = materialize(self.open_buckets(members.select("key", "id"), label), "open")
        discard(members)
        small = open_.where("not crowded").select("key", "id", "component", "main")
        odd = small.where("component <> main").select("key", F.col("id").alias("x"), F.col("component").alias("of_x"))
        met = odd.join(small.select("key", F.col("id").alias("y"), F.col("component").alias("of_y")), "key").where("of_x <> of_y")
        crowd = materialize(open_.where("crowded").select("key", "id"), "crowd")
        more = materialize(pairs_of(met, "x", "y").join(tried, ["a", "b"], "left_anti"), "pairs")
        discard(open_, tried)
        if not more.isEmpty():
            label = self.joined(label, self.confirm(more))
        left = materialize(self.open_buckets(crowd, label), "crowd")
        discard(more, crowd)
        if not left.isEmpty():
            label = self.joined(label, self.tiles(left))
        discard(left)
        return label


def near_duplicates(docs: DataFrame, percent: int = PERCENT, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per row of ``docs``: ``doc_id, n_shingles, component_id, kept``.

    ``component_id`` is the smallest id reachable over links of at least ``percent`` shingle overlap; ``kept`` marks
    that row. Null and empty texts (or without words) have no shingles and stand alone. Rows without an id are kept, with
    a null component. Rows that share an id are one node, linked if any of them links. Other columns are not looked at.
    """
    base = materialize(signatures(docs, doc_id, text), "signatures")
    named = base.where("n_shingles > 0 and doc_id is not null")
    # Equal sets have equal minima.
    group = materialize(named.groupBy("set1", "set2", "n_shingles").agg(F.min("doc_id").alias("node"), F.first("minima").alias("minima")), "sets")
    member = base.select("doc_id", "n_shingles", "set1", "set2").join(group.drop("minima"), ["set1", "set2", "n_shingles"], "left")
    member = materialize(member.select("doc_id", "n_shingles", "node"), "nodes")
    discard(base)
    nodes = group.select(F.col("node").alias("id"), "minima")
    source = docs.select(F.col(doc_id).cast("long").alias("id"), F.col(text).alias("text"))
    label = Search(source, nodes, percent).run()
    # Rows that share an id but not a set.
    split = member.where("doc_id is not null and node is not null").groupBy("doc_id").agg(F.min("node").alias("a"), F.max("node").alias("b")).where("a <> b").select("a", "b")
    if not split.isEmpty():
        label = components(label.select(F.col("component").alias("a"), F.col("id").alias("b")).union(split))
    ids = member.join(label.withColumnRenamed("id", "node"), "node", "left")
    component = F.when(F.col("doc_id").isNull(), F.lit(None)).otherwise(F.coalesce("component", "node", "doc_id"))
    out = ids.select("doc_id", "n_shingles", component.cast("long").alias("component_id"))
    return out.withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)))


SQL = r"""
WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS ws FROM documents
), s AS (
  SELECT DISTINCT doc_id, array_to_string(ws[i:i+4], ' ') AS g FROM (SELECT doc_id, ws, unnest(range(1, greatest(2, len(ws) - 3))) AS i FROM w WHERE len(ws) > 0)
), n AS (
  SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id
), p AS (
  SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS k FROM s x JOIN s y ON x.g = y.g AND x.doc_id < y.doc_id GROUP BY 1, 2
), e AS (
  SELECT a, b FROM p JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * k >= 75 * (x.n + y.n - k)
), sym AS (
  SELECT a, b FROM e UNION ALL SELECT b, a FROM e
), r AS (
  SELECT doc_id AS id, doc_id AS c FROM documents UNION SELECT sym.b, r.c FROM r JOIN sym ON sym.a = r.id
), m AS (
  SELECT id, min(c) AS c FROM r GROUP BY id
)
SELECT d.doc_id, CAST(coalesce(n.n, 0) AS BIGINT) AS n_shingles, m.c AS component_id, m.c = d.doc_id AS kept
FROM documents d JOIN m ON m.id = d.doc_id LEFT JOIN n ON n.doc_id = d.doc_id
"""


@query("op9_minhash_near_dedup", SQL)
def op9_minhash_near_dedup(spark: SparkSession, folder: str) -> DataFrame:
    """Near-duplicate component of every document."""
    return near_duplicates(table(spark, folder, "documents"))
