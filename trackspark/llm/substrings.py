"""Removal of passages that repeat from document to document.

Every window of ``size`` consecutive words has a Rabin-Karp hash. Documents are cut into groups of consecutive ids, by
the bytes of their texts; a group sends each of its hashes once (packed by hash range) to be counted, and gets back
those that also start in a group of smaller ids. Inside a group the smallest id of a hash is found locally. Overlapping
repeated windows of a document merge into maximal removal intervals. A passage in a third of all documents costs one
entry per group. A group has at most twice ``GROUP_BYTES``, or one row; an id of more bytes has groups of its own, dealt
by a hash of the whole row, so only rows alike in every column can exceed that. Rows without an id need no group.

Windows are equal if their 64-bit hashes are; the chance that a window meets a false partner is the number of windows
divided by 2**64.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, IntegerType, LongType, StringType, StructField, StructType

from .batches import map_arrow
from .bpe import extended, with_columns
from .registry import query, table
from .words import SPACED, plain, slices

WINDOW = 13
#: Bytes of text in a group and of text whose hashes form a range.
GROUP_BYTES, RANGE_BYTES = 4 << 20, 16 << 20
#: Bytes that a row counts besides its text.
ROW_BYTES = 64
GROUP = "__group"
#: A group's number is that of its range of ids, shifted, and that of the group among those of one id.
SHIFT = 20
INTERVALS = ArrayType(StructType([StructField("first", IntegerType()), StructField("last", IntegerType())]))


def window_hashes(column, size: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Of all rows: words per row, and per window its row, its first word's number in the column and its hash."""
    counts, rows, firsts, codes, words = [], [], [], [], 0
    for part in slices(column, SPACED):
        at, code = part.windows(size)
        counts.append(part.counts())
        rows.append(part.row[at] + part.first)
        firsts.append(at + words)
        codes.append(code)
        words += len(part.hash)
    join = lambda x, kind: np.concatenate(x) if x else np.empty(0, kind)
    return join(counts, np.int64), join(rows, np.int64), join(firsts, np.int64), join(codes, np.uint64)


def send(codes: np.ndarray, groups: np.ndarray, ranges: int, span: int) -> Iterator[pa.RecordBatch]:
    """Each group's distinct hashes by range."""
    for g in np.unique(groups).tolist():
        mine = np.unique(codes[groups == g])
        part = (mine // np.uint64(span)).astype(np.int64)
        new = np.flatnonzero(np.append(True, part[1:] != part[:-1])) if len(part) else np.empty(0, np.int64)
        ends = np.append(new[1:], len(part))[: len(new)]
        packed = [mine[a:b].tobytes() for a, b in zip(new.tolist(), ends.tolist(), strict=True)]
        yield pa.RecordBatch.from_arrays([pa.array(part[new], pa.int64()), pa.array([g] * len(new), pa.int64()), pa.array(packed, pa.binary())], names=["range", GROUP, "codes"])


def answer(data: pa.Table) -> pa.Table:
    """Of one range: each group's hashes that a smaller group has too."""
    groups = data.column(GROUP).to_numpy()
    packed = data.column("codes").to_pylist()
    codes = np.frombuffer(b"".join(packed), np.uint64)
    owner = np.repeat(groups, [len(p) // 8 for p in packed])
    order = np.lexsort((owner, codes))
    codes, owner = codes[order], owner[order]
    later = np.zeros(len(codes), bool)
    later[1:] = codes[1:] == codes[:-1]
    first = np.flatnonzero(~later)
    least = np.repeat(owner[first], np.diff(np.append(first, len(codes))))
    later &= owner >> SHIFT > least >> SHIFT
    codes, owner = codes[later], owner[later]
    order = np.argsort(owner, kind="stable")
    codes, owner = codes[order], owner[order]
    new = np.flatnonzero(np.append(True, owner[1:] != owner[:-1])) if len(owner) else np.empty(0, np.int64)
    ends = np.append(new[1:], len(owner))[: len(new)]
    return pa.table({GROUP: pa.array(owner[new], pa.int64()), "codes": pa.array([codes[a:b].tobytes() for a, b in zip(new.tolist(), ends.tolist(), strict=True)], pa.binary())})


def covered(data: pa.Table, repeats: np.ndarray, size: int, doc_id: str, text: str) -> tuple[np.ndarray, np.ndarray]:
    """Words per row of one group sorted by id, and which words to remove."""
    ids = data.column(doc_id)
    counts, row, first, codes = window_hashes(data.column(text), size)
    known = np.asarray(ids.is_valid())
    number = np.where(known, np.asarray(ids.fill_null(0)), 0)
    _, at, group = np.unique(codes, return_index=True, return_inverse=True)
    flagged = np.zeros(len(at), bool)
    if len(at) and len(repeats):
        unique = codes[at]
        place = np.minimum(np.searchsorted(unique, repeats), len(unique) - 1)
        flagged[place[unique[place] == repeats]] = True
    hit = (flagged[group] | (number[row[at]][group] < number[row])) & known[row] if len(at) else np.empty(0, bool)
    words = int(counts.sum())
    steps = np.bincount(first[hit], minlength=words + 1) - np.bincount(first[hit] + size, minlength=words + 1)
    return counts, np.cumsum(steps)[:-1] > 0


def drop_words(data: pa.Table, counts: np.ndarray, gone: np.ndarray, text: str) -> tuple[list, list, list]:
    """Kept text, number of removed words and maximal removal intervals (word numbers, both included) of each row."""
    kept, removed, spans = [], [], []
    ends = np.cumsum(counts)
    raw = plain(data.column(text)).cast(pa.large_binary())
    for i, value in enumerate(raw):
        flags = gone[ends[i] - counts[i] : ends[i]]
        words = value.as_py().split()
        n = int(flags.sum())
        removed.append(n)
        if not n:
            kept.append(b" ".join(words))
            spans.append([])
            continue
        edge = np.diff(np.concatenate(([0], flags.astype(np.int8), [0])))
        spans.append([{"first": a, "last": b - 1} for a, b in zip(np.flatnonzero(edge == 1).tolist(), np.flatnonzero(edge == -1).tolist(), strict=True)])
        kept.append(b" ".join([words[k] for k in np.flatnonzero(~flags).tolist()]))
    return kept, removed, spans


def edges(df: DataFrame, doc_id: str, text: str, limit: int, tasks: int) -> tuple[np.ndarray, np.ndarray]:
    """First id of every range of about ``limit`` bytes, in order, and the number of its groups; both reach the driver."""
    weight = F.coalesce(F.octet_length(text), F.lit(0)).cast("long") + ROW_BYTES
    sizes = df.where(F.col(doc_id).isNotNull()).groupBy(F.col(doc_id).cast("long").alias("id")).agg(F.sum(weight).alias("bytes"), F.count(F.lit(1)).alias("n"))

    def run(batches):
        before, last, alone = 0, -1, False
        for batch in batches:
            if not len(batch):
                continue
            ids, size, n = (np.asarray(batch.column(k)) for k in range(3))
            group = (before + np.cumsum(size) - size) // limit
            large = size > limit
            new = (group != np.append(last, group[:-1])) | large | np.append(alone, large[:-1])
            parts = np.where(large, np.minimum(np.minimum(n, -(-size // limit)), 1 << SHIFT), 1)
            before, last, alone = before + int(size.sum()), group[-1], large[-1]
            yield pa.RecordBatch.from_arrays([pa.array(ids[new], pa.int64()), pa.array(parts[new], pa.int64())], names=["id", "parts"])

    found = map_arrow(sizes.repartitionByRange(tasks, "id").sortWithinPartitions("id"), run, "id long, parts long").toArrow()
    first, parts = (np.asarray(found.column(n).combine_chunks()) for n in ("id", "parts"))
    order = np.argsort(first)
    return first[order], parts[order]


def in_groups(df: DataFrame, doc_id: str, text: str, limit: int, tasks: int) -> DataFrame:
    """The rows with an id and their group."""
    first, parts = edges(df, doc_id, text, limit, tasks)

    @F.arrow_udf("long")
    def group(ids: pa.Array, salt: pa.Array) -> pa.Array:
        at = np.searchsorted(first, np.asarray(ids), "right") - 1
        return pa.array((at << SHIFT) + np.asarray(salt) % parts[at], pa.int64())

    plain_columns = [F.col(f"`{n}`") for n, kind in df.dtypes if "map<" not in kind and "variant" not in kind]
    salt = F.xxhash64(*plain_columns) if (parts > 1).any() else F.lit(0).cast("long")
    return df.where(F.col(doc_id).isNotNull()).withColumn(GROUP, group(F.col(doc_id).cast("long"), salt))


def remove_repeats(df: DataFrame, size: int = WINDOW, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Add ``kept`` (words that stay, joined by one space), ``n_words``, ``n_removed`` and ``intervals``.

    A word goes if a window of ``size`` words around it also starts in a row with a smaller id. Null texts have no
    words. Rows without an id lose nothing and take nothing away; rows that share an id never count against each other.
    Texts shorter than a window stay. Extra columns pass through; those named like the results are replaced.
    """
    spark = df.sparkSession
    tasks = int(spark.conf.get("spark.sql.shuffle.partitions"))
    total, ids, rows = df.agg(F.sum(F.octet_length(text).cast("long")), F.count(doc_id), F.count(F.lit(1))).first()
    total = total or 0
    limit = max(1, min(GROUP_BYTES, (total + ROW_BYTES * rows) // (2 * tasks)))
    ranges = max(2 * tasks, -(-total // RANGE_BYTES))
    span = -(-(1 << 64) // ranges)
    grouped = in_groups(df, doc_id, text, limit, tasks).repartition(tasks, GROUP)

    def hashes(batches):
        for batch in batches:
            if len(batch):
                _, row, _, codes = window_hashes(batch.column(batch.schema.get_field_index(text)), size)
                owner = np.asarray(batch.column(batch.schema.get_field_index(GROUP)))[row]
                yield from send(codes, owner, ranges, span)

    sent = map_arrow(grouped, hashes, f"range long, `{GROUP}` long, codes binary")
    replies = sent.repartition(tasks, "range").groupBy("range").applyInArrow(answer, f"`{GROUP}` long, codes binary")
    schema = extended(df, ("kept", StringType()), ("n_words", LongType()), ("n_removed", LongType()), ("intervals", INTERVALS))

    def result(data: pa.Table, counts: np.ndarray, gone: np.ndarray) -> pa.Table:
        kept, removed, spans = drop_words(data, counts, gone, text)
        more = {
            "kept": pa.array(kept, pa.binary()).cast(pa.string()), "n_words": pa.array(counts, pa.int64()), "n_removed": pa.array(removed, pa.int64()),
            "intervals": pa.array(spans, pa.list_(pa.struct([("first", pa.int32()), ("last", pa.int32())]))),
        }
        return pa.table([more[n] if n in more else data.column(n) for n in schema.names], names=schema.names)

    def apply(data: pa.Table, reply: pa.Table) -> pa.Table:
        order = pc.sort_indices(data, sort_keys=[(doc_id, "ascending")])
        data = data.take(order).combine_chunks()
        repeats = np.frombuffer(b"".join(reply.column("codes").to_pylist()), np.uint64)
        return result(data, *covered(data, repeats, size, doc_id, text))

    def loose(batches):
        for batch in batches:
            if len(batch):
                counts = window_hashes(batch.column(batch.schema.get_field_index(text)), size)[0]
                yield from result(pa.Table.from_batches([batch]), counts, np.zeros(int(counts.sum()), bool)).to_batches()

    replies = replies.repartition(tasks, GROUP)
    out = grouped.groupBy(GROUP).cogroup(replies.groupBy(GROUP)).applyInArrow(apply, schema)
    return out if ids == rows else out.union(map_arrow(df.where(F.col(doc_id).isNull()), loose, schema))


SQL = r"""
WITH w AS (
  SELECT doc_id, row_number() OVER () AS r, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS ws FROM documents
), p AS (
  SELECT doc_id, r, ws, unnest(range(1, len(ws) - 11)) AS i FROM w WHERE len(ws) >= 13
), g AS (
  SELECT doc_id, r, i, md5(array_to_string(ws[i:i+12], ' ')) AS h FROM p
), m AS (
  SELECT h, min(doc_id) AS d FROM g GROUP BY h
), hit AS (
  SELECT DISTINCT g.r, unnest(range(g.i, g.i + 13)) AS i FROM g JOIN m ON g.h = m.h AND m.d < g.doc_id
), gone AS (
  SELECT r, list(i) AS cut FROM hit GROUP BY r
)
SELECT w.doc_id, CAST(len(ws) AS BIGINT) AS n_words, CAST(coalesce(len(cut), 0) AS BIGINT) AS n_removed,
  sha256(CASE WHEN cut IS NULL THEN array_to_string(ws, ' ')
    ELSE coalesce(array_to_string(list_filter(ws, lambda x, i: NOT list_contains(cut, i)), ' '), '') END) AS kept_sha256
FROM w LEFT JOIN gone USING (r)
"""


@query("op3_substring_dedup", SQL)
def op3_substring_dedup(spark: SparkSession, folder: str) -> DataFrame:
    """Words of every document outside passages that start in a smaller document too."""
    kept = remove_repeats(table(spark, folder, "documents").select("doc_id", "text"))
    return kept.select("doc_id", "n_words", "n_removed", F.sha2(F.encode("kept", "UTF-8"), 256).alias("kept_sha256"))
