"""Toxicity by multiple-instance learning.

A document is a bag of sentences. Each sentence has a probability from a logistic model over hashed words and word
stems; the document's probability is their noisy-or, ``1 - prod(1 - p)``. Weights are learned from document labels
alone, and the sentences that carry a document's score are then located by their own probabilities.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType, IntegerType, StructField, StructType

from .batches import map_arrow, trim
from .bpe import extended, with_columns
from .registry import query, table
from .words import ALNUM_LOWER, Slice, slices

#: Rows of each class that the model is fitted on, taken in the order of a hash of their id.
FIT_ROWS = 3000
#: Bytes of text of each class that the model is fitted on; the first document always is.
FIT_BYTES = 16 << 20
BITS = 20
#: Word starts that serve as stems, in bytes.
HEADS = (4, 5, 6)
#: Features whose shares of toxic and other fitted documents differ by this many standard errors are fitted.
STANDARD_ERRORS = 4.0
ROUNDS = 200
THRESHOLD = 0.3
HELD_OUT = 2

ENDS = np.zeros(256, np.uint8)
ENDS[[ord(c) for c in ".!?\n\r"]] = 1


@dataclass
class Sentences:
    """Features of a slice: one row of bins per word, the sentences' first words, their rows and byte spans."""

    bins: np.ndarray
    first: np.ndarray
    row: np.ndarray
    start: np.ndarray
    end: np.ndarray


def sentences(part: Slice) -> Sentences:
    shift = np.uint64(64 - BITS)
    bins = np.stack([((h + np.uint64(k)) * np.uint64(0x9E3779B97F4A7C15) >> shift).astype(np.int32) for k, h in enumerate([part.hash, *part.heads])], axis=1)
    ends = np.cumsum(ENDS[part.data], dtype=np.int64)
    at = ends[part.start] if len(part.start) else np.empty(0, np.int64)
    new = np.ones(len(at), bool)
    new[1:] = (at[1:] != at[:-1]) | (part.row[1:] != part.row[:-1])
    first = np.flatnonzero(new)
    stop = np.append(first[1:], len(at)) - 1 if len(first) else first
    return Sentences(bins, first, part.row[first], part.start[first] - part.bounds[part.row[first]], part.end[stop] - part.bounds[part.row[first]])


def sums(values: np.ndarray, first: np.ndarray) -> np.ndarray:
    return np.add.reduceat(values, first) if len(first) else np.empty(0)


def softplus(z: np.ndarray) -> np.ndarray:
    return np.logaddexp(0.0, z)


@dataclass
class Model:
    weights: np.ndarray
    bias: float

    def score(self, s: Sentences, rows: int) -> tuple[np.ndarray, np.ndarray]:
        """Sentence logits and noisy-or of each row."""
        z = sums(self.weights[s.bins].sum(axis=1, dtype=np.float64), s.first) + self.bias
        return z, -np.expm1(-np.bincount(s.row, softplus(z), rows)[:rows]) if rows else np.empty(0)


def fit(bags: list[tuple[np.ndarray, np.ndarray]], labels: np.ndarray, importance: np.ndarray) -> Model:
    """Full-batch Adam on the weighted log loss of the noisy-or; bags: (bins per word, words per sentence)."""
    if not len(labels) or labels.min() == labels.max():
        rate = float(labels.mean()) if len(labels) else 0.0
        return Model(np.zeros(1 << BITS, np.float32), 40.0 if rate else -40.0)
    seen = np.zeros((2, 1 << BITS), np.int32)
    for (bins, _), y in zip(bags, labels.tolist(), strict=True):
        seen[y, np.unique(bins)] += 1
    n0, n1 = (labels == 0).sum(), (labels == 1).sum()
    pooled = seen.sum(axis=0) / len(labels)
    error = np.sqrt(pooled * (1 - pooled) * (1 / n0 + 1 / n1))
    used = np.flatnonzero(np.abs(seen[1] / n1 - seen[0] / n0) > STANDARD_ERRORS * np.maximum(error, 1e-9))
    number = np.zeros(1 << BITS, np.int32)
    number[used] = np.arange(1, len(used) + 1)
    at = np.concatenate([number[b] for b, _ in bags])
    width = at.shape[1]
    words = np.concatenate([n for _, n in bags])
    first = np.cumsum(words) - words
    owner = np.repeat(np.arange(len(bags)), [len(n) for _, n in bags])
    sentence = np.repeat(np.arange(len(words), dtype=np.int32), words)
    keep = (at > 0).reshape(-1)
    cell, sentence = at.reshape(-1)[keep], np.repeat(sentence, width)[keep]
    size = len(used) + 1
    w, bias = np.zeros(size), -6.0
    m, v, mb, vb = np.zeros(size), np.zeros(size), 0.0, 0.0
    scale = importance / importance.sum()
    rate, decay = 0.1, 1e-5
    for step in range(1, ROUNDS + 1):
        z = np.bincount(sentence, w[cell], len(words)) + bias
        clean = np.bincount(owner, softplus(z), len(bags))
        p = np.exp(-softplus(-z))
        toxic = -np.expm1(-clean)
        pull = np.where(labels == 1, -np.exp(-clean) / np.maximum(toxic, 1e-9), 1.0) * scale
        g = pull[owner] * p
        gw = np.bincount(cell, g[sentence], size) + decay * np.sign(w)
        gb = g.sum()
        m, v = 0.9 * m + 0.1 * gw, 0.99 * v + 0.01 * gw * gw
        mb, vb = 0.9 * mb + 0.1 * gb, 0.99 * vb + 0.01 * gb * gb
        c1, c2 = 1 - 0.9**step, 1 - 0.99**step
        w -= rate * (m / c1) / (np.sqrt(v / c2) + 1e-8)
        bias -= rate * (mb / c1) / (np.sqrt(vb / c2) + 1e-8)
        w[0] = 0.0
    weights = np.zeros(1 << BITS, np.float32)
    weights[used] = w[1:]
    return Model(weights, float(bias))


def held_out(doc_id: str = "doc_id"):
    """Rows whose labels are never learned from."""
    return F.coalesce(F.crc32(F.encode(F.col(doc_id).cast("string"), "UTF-8")) % 4 == HELD_OUT, F.lit(False))


def within(sizes: list, most: int) -> list:
    """Ids of the rows ``(id, toxic, bytes)`` that come before a class has more than so many bytes; one of each class at least."""
    total: dict[int, int] = {}
    out = []
    for doc_id, toxic, size in sizes:
        before = total.get(toxic)
        total[toxic] = (before or 0) + size
        if before is None or total[toxic] <= most:
            out.append(doc_id)
    return out


def train(docs: DataFrame, labels: DataFrame, rows: int = FIT_ROWS, most: int = FIT_BYTES) -> Model:
    """Fit on a bounded sample: at most ``rows`` documents and ``most`` bytes of each class, weighted back to the classes' shares.

    Null ids, labels other than 0 / 1 and held-out ids take no part; null texts are empty bags. A label counts once per
    row of it: repeated labels weigh more, an id with both labels is learned as both, and a repeated document is fitted
    as often as it occurs, all of it within the bounds.
    """
    known = labels.select(F.col("doc_id"), F.col("toxic").cast("int").alias("toxic")).where("doc_id is not null and toxic in (0, 1)").where(~held_out())
    counts = {r.toxic: r["count"] for r in known.groupBy("toxic").count().collect()}
    order = F.xxhash64(F.lit(7), "doc_id")
    picked = [known.where(F.col("toxic") == k).orderBy(order, "doc_id").limit(rows) for k in (0, 1)]
    sample = picked[0].unionByName(picked[1])
    # Ids, labels and sizes of the sample reach the driver, at most two times ``rows``; then the texts that fit.
    size = F.sum(F.coalesce(F.octet_length("text"), F.lit(0))).cast("long").alias("bytes")
    sizes = docs.select("doc_id", "text").join(F.broadcast(sample.distinct()), "doc_id").groupBy("doc_id", "toxic").agg(size).orderBy(order, "doc_id", "toxic").collect()
    chosen = docs.sparkSession.createDataFrame([(i,) for i in sorted(set(within(sizes, most)))], StructType([StructField("doc_id", known.schema["doc_id"].dataType)]))
    sample = F.broadcast(sample.join(chosen, "doc_id", "left_semi"))
    texts = docs.select("doc_id", "text").join(sample, "doc_id")

    def bags(batches):
        for batch in batches:
            ids, toxic = batch.column(0), batch.column(2)
            for part in slices(batch.column(1), ALNUM_LOWER, HEADS):
                s = sentences(part)
                stop = np.append(s.first[1:], len(s.bins))
                size = np.bincount(s.row, minlength=part.rows)
                words = part.counts()
                w, n = np.cumsum(words), np.cumsum(size)
                yield pa.RecordBatch.from_arrays([
                    ids.slice(part.first, part.rows), toxic.slice(part.first, part.rows),
                    pa.array([s.bins[w[i] - words[i] : w[i]].tobytes() for i in range(part.rows)], pa.binary()),
                    pa.array([(stop - s.first)[n[i] - size[i] : n[i]].astype(np.int32).tobytes() for i in range(part.rows)], pa.binary()),
                ], names=["doc_id", "toxic", "bins", "words"])

    got = map_arrow(texts, bags, "doc_id long, toxic int, bins binary, words binary").toArrow().to_pylist()
    got = sorted((r for r in got if r["words"]), key=lambda r: (r["doc_id"], r["toxic"], r["bins"]))
    y = np.array([r["toxic"] for r in got], np.int64)
    share = np.array([counts[k] / max(1, (y == k).sum()) for k in y.tolist()])
    model = fit([(np.frombuffer(r["bins"], np.int32).reshape(-1, 1 + len(HEADS)), np.frombuffer(r["words"], np.int32)) for r in got], y, share)
    del got, y, share
    trim()
    return model


SPANS = ArrayType(StructType([StructField("start", IntegerType()), StructField("end", IntegerType()), StructField("p", DoubleType())]))


def score(docs: DataFrame, model: Model, text: str = "text", locate: bool = False) -> DataFrame:
    """Add ``score``; with ``locate`` also ``offending``: byte spans and probabilities of sentences at the threshold.

    Texts that are null, empty or without words score 0. Rows are independent; extra columns pass through.
    """
    schema = extended(docs, ("score", DoubleType()), *([("offending", SPANS)] if locate else []))
    shipped = docs.sparkSession.sparkContext.broadcast((model.weights, model.bias))

    def run(batches):
        known = Model(*shipped.value)
        limit = np.log(THRESHOLD / (1 - THRESHOLD))
        for batch in batches:
            for part in slices(batch.column(batch.schema.get_field_index(text)), ALNUM_LOWER, HEADS):
                s = sentences(part)
                z, p = known.score(s, part.rows)
                more = {"score": pa.array(p, pa.float64())}
                if locate:
                    found: list[list] = [[] for _ in range(part.rows)]
                    for i in np.flatnonzero(z >= limit).tolist():
                        found[s.row[i]].append({"start": int(s.start[i]), "end": int(s.end[i]), "p": float(1 / (1 + np.exp(-z[i])))})
                    more["offending"] = pa.array(found, pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32()), ("p", pa.float64())])))
                yield with_columns(batch.slice(part.first, part.rows), schema, **more)

    return map_arrow(docs, run, schema)


@query("op7_toxicity")
def op7_toxicity(spark: SparkSession, folder: str) -> DataFrame:
    """Toxicity of every document."""
    docs = table(spark, folder, "documents")
    scored = score(docs.select("doc_id", "text"), train(docs, table(spark, folder, "labels")), locate=True)
    return scored.select("doc_id", held_out().alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"), F.size("offending").alias("n_offending"))
