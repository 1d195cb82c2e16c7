"""Benchmark decontamination with a generalised suffix automaton.

The normalised words of all benchmark items go into one suffix automaton, which is sent to the executors. Documents are
streamed through it word by word; at each word the automaton's state tells the longest run of words ending there that
some item contains. A run of ``window`` words, or a whole item of fewer, marks its words as hit.

Two neighbouring words that stand side by side in no item end every run, so only stretches of words whose neighbours
all do (found by array operations) are walked. A benchmark above ``BLOCK_WORDS`` is split into several automata, each
bounded, through which the documents pass one after the other.
"""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, BinaryType, IntegerType, LongType, StringType, StructField, StructType

from .batches import map_arrow
from .bpe import extended, with_columns
from .registry import query, table
from .words import ALNUM_LOWER, Slice, mix, slices

WINDOW = 13
#: A document is contaminated if at least one in this many words is hit.
SHARE = 20
#: Words of one automaton; larger benchmarks make several.
BLOCK_WORDS = 200_000
WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
UPPER = {c: c + 32 for c in range(65, 91)}


class Automaton:
    """Suffix automaton of word-number sequences, with the items that contain a state's words."""

    def __init__(self, items: list[tuple[str, np.ndarray]], window: int):
        """``items``: key and word hashes of each item that has words."""
        self.window = window
        self.vocabulary = np.unique(np.concatenate([w for _, w in items])) if items else np.empty(0, np.uint64)
        self.next: list[dict[int, int]] = [{}]
        self.link, self.length, self.owners, self.whole = [-1], [0], [set()], [set()]
        pairs = []
        for number, (_, words) in enumerate(items):
            ids = np.searchsorted(self.vocabulary, words).tolist()
            pairs.append(self.code(np.array(ids[:-1], np.int64), np.array(ids[1:], np.int64)))
            last = 0
            for i in ids:
                last = self._extend(last, i)
                self.owners[last].add(number)
            if len(ids) < window:
                self.whole[last].add(number)
        self.keys = [k for k, _ in items]
        self.shortest = min((min(len(w), window) for _, w in items), default=0)
        self.pairs = np.unique(np.concatenate(pairs)) if pairs else np.empty(0, np.uint64)
        self.near = self._table(self.pairs)
        self.words = self._table(mix(self.vocabulary))
        for state in sorted(range(1, len(self.next)), key=self.length.__getitem__, reverse=True):
            if self.link[state] > 0 and self.length[state] > 1:
                self.owners[self.link[state]] |= self.owners[state]
        # Nearest state on the way to the root, itself included, that is a whole short item.
        self.mark = [-1] * len(self.next)
        for state in sorted(range(1, len(self.next)), key=self.length.__getitem__):
            self.mark[state] = state if self.whole[state] else self.mark[self.link[state]]

    @staticmethod
    def code(a: np.ndarray, b: np.ndarray) -> np.ndarray:
        return mix((a.astype(np.uint64) << np.uint64(32)) | b.astype(np.uint64))

    @staticmethod
    def _table(codes: np.ndarray) -> np.ndarray:
        """Bits of a first test: at least 64 slots per code."""
        size = 1 << max(16, int(64 * len(codes) - 1).bit_length()) if len(codes) else 1 << 16
        bits = np.zeros(min(size, 1 << 26), bool)
        bits[(codes >> np.uint64(11)).astype(np.int64) & (len(bits) - 1)] = True
        return bits

    def _new(self, length: int, link: int, follow: dict) -> int:
        self.next.append(follow)
        self.length.append(length)
        self.link.append(link)
        self.owners.append(set())
        self.whole.append(set())
        return len(self.next) - 1

    def _split(self, state: int, target: int, word: int) -> int:
        """Part of ``target`` that is one word longer than ``state``."""
        copy = self._new(self.length[state] + 1, self.link[target], dict(self.next[target]))
        self.link[target] = copy
        while state >= 0 and self.next[state].get(word) == target:
            self.next[state][word] = copy
            state = self.link[state]
        return copy

    def _extend(self, last: int, word: int) -> int:
        target = self.next[last].get(word)
        if target is not None:
            return target if self.length[target] == self.length[last] + 1 else self._split(last, target, word)
        new = self._new(self.length[last] + 1, 0, {})
        state = last
        while state >= 0 and word not in self.next[state]:
            self.next[state][word] = new
            state = self.link[state]
        if state >= 0:
            target = self.next[state][word]
            self.link[new] = target if self.length[target] == self.length[state] + 1 else self._split(state, target, word)
        return new

    def stretches(self, part: Slice) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """First and last + 1 word of runs that may hold a window, and the words' numbers (-1: in no item)."""
        n = len(part.hash)
        number = np.full(n, -1, np.int64)
        if not n or not len(self.vocabulary):
            return np.empty(0, np.int64), np.empty(0, np.int64), number
        spread = mix(part.hash)
        maybe = np.flatnonzero(self.words[(spread >> np.uint64(11)).astype(np.int64) & (len(self.words) - 1)])
        at = np.minimum(np.searchsorted(self.vocabulary, part.hash[maybe]), len(self.vocabulary) - 1)
        same = self.vocabulary[at] == part.hash[maybe]
        number[maybe[same]] = at[same]
        joined = np.zeros(n, bool)
        left = np.flatnonzero((number[:-1] >= 0) & (number[1:] >= 0) & (part.row[:-1] == part.row[1:]))
        code = self.code(number[left], number[left + 1])
        near = self.near[(code >> np.uint64(11)).astype(np.int64) & (len(self.near) - 1)]
        left, code = left[near], code[near]
        if len(self.pairs):
            left = left[self.pairs[np.minimum(np.searchsorted(self.pairs, code), len(self.pairs) - 1)] == code]
        else:
            left = left[:0]
        joined[left + 1] = True
        first = np.flatnonzero(~joined & (number >= 0))
        edge = np.flatnonzero(~joined)
        stop = np.append(edge, n)[np.searchsorted(edge, first, side="right")]
        long = stop - first >= self.shortest
        return first[long], stop[long], number

    def walk(self, numbers: list[int]) -> tuple[list[tuple[int, int]], set[int]]:
        """Hit word spans (first, last + 1) of a stretch and the states of the windows found."""
        spans, states = [], set()
        state = length = 0
        follow, link, size, window, mark = self.next, self.link, self.length, self.window, self.mark
        for i, word in enumerate(numbers):
            while state and word not in follow[state]:
                state = link[state]
                length = size[state]
            if word in follow[state]:
                state = follow[state][word]
                length += 1
            if length >= window:
                spans.append((i + 1 - window, i + 1))
                s = state
                while size[link[s]] >= window:
                    s = link[s]
                states.add(s)
            s = mark[state]
            while s > 0:
                if size[s] <= length:
                    spans.append((i + 1 - size[s], i + 1))
                    states.add(-s)
                s = mark[link[s]]
        return spans, states

    def items(self, states: set[int]) -> set[str]:
        return {self.keys[k] for s in states for k in (self.owners[s] if s > 0 else self.whole[-s])} - {None}


HITS, ITEMS = "__hits", "__items"


def item_words(text: str | None) -> list[str]:
    return WORD.findall((text or "").translate(UPPER))


def automata(benchmark: DataFrame, window: int, item_id: str, text: str):
    """One automaton after the other over the benchmark's items, each of a bounded number of words."""
    block, words = [], 0
    rows = benchmark.select(F.col(item_id).cast("string").alias("k"), F.col(text).alias("t")).where("t is not null").orderBy("k", "t")
    for row in rows.toLocalIterator():
        for part in slices(pa.array([row.t]), ALNUM_LOWER):
            if len(part.hash):
                block.append((row.k, part.hash))
                words += len(part.hash)
        if words >= BLOCK_WORDS:
            yield Automaton(block, window)
            block, words = [], 0
    if block:
        yield Automaton(block, window)


def marker(df: DataFrame, automaton: Automaton, text: str):
    """Function over batches that adds the automaton's hits to the bit mask and the items of every row."""
    shipped = df.sparkSession.sparkContext.broadcast(automaton)
    schema = df.schema

    def run(batches):
        known = shipped.value
        for batch in batches:
            at = {n: batch.schema.get_field_index(n) for n in (text, HITS, ITEMS)}
            for part in slices(batch.column(at[text]), ALNUM_LOWER):
                rows = batch.slice(part.first, part.rows)
                first, stop, number = known.stretches(part)
                counts = part.counts()
                begin = np.cumsum(counts) - counts
                steps = np.zeros(len(part.hash) + 1, np.int64)
                items: dict[int, set[str]] = {}
                for a, b in zip(first.tolist(), stop.tolist(), strict=True):
                    spans, states = known.walk(number[a:b].tolist())
                    for x, y in spans:
                        steps[a + x] += 1
                        steps[a + y] -= 1
                    if states:
                        items.setdefault(int(part.row[a]), set()).update(known.items(states))
                hit = np.cumsum(steps[:-1]) > 0
                masks, names = rows.column(at[HITS]).to_pylist(), rows.column(at[ITEMS]).to_pylist()
                for r, found in items.items():
                    mine = np.packbits(hit[begin[r] : begin[r] + counts[r]])
                    if masks[r]:
                        mine = mine | np.frombuffer(masks[r], np.uint8)
                    masks[r] = mine.tobytes()
                    names[r] = sorted({*names[r], *found})
                yield with_columns(rows, schema, **{HITS: pa.array(masks, pa.binary()), ITEMS: pa.array(names, pa.list_(pa.string()))})

    return run


SPANS = ArrayType(StructType([StructField("first", IntegerType()), StructField("last", IntegerType()), StructField("start", IntegerType()), StructField("end", IntegerType())]))


def contamination(df: DataFrame, benchmark: DataFrame, window: int = WINDOW, share: int = SHARE, text: str = "text", item_id: str = "item_id", item_text: str = "text") -> DataFrame:
    """Add ``n_words``, ``n_hit``, ``items`` (sorted), ``spans`` (hit word and byte ranges) and ``contaminated``.

    A word is hit inside any occurrence of an item's window of ``window`` words, or of a whole item of fewer words; a row
    is contaminated if it has a hit and at least one word in ``share`` is hit. Null and empty texts have no words, null
    or wordless items no windows; items of one key count once, and those without a key mark words but are not listed. Rows are independent; extra columns pass through, those
    named like the results are replaced.
    """
    marked = df.withColumns({HITS: F.lit(None).cast(BinaryType()), ITEMS: F.array().cast("array<string>")})
    mark = None
    for automaton in automata(benchmark, window, item_id, item_text):
        if mark is not None:
            marked = map_arrow(marked, mark, marked.schema)
        mark = marker(marked, automaton, text)
    schema = extended(df, ("n_words", LongType()), ("n_hit", LongType()), ("items", ArrayType(StringType())), ("spans", SPANS))

    def finish(batches):
        for batch in batches:
            at = {n: batch.schema.get_field_index(n) for n in (text, HITS, ITEMS)}
            for part in slices(batch.column(at[text]), ALNUM_LOWER):
                rows = batch.slice(part.first, part.rows)
                counts = part.counts()
                begin = np.cumsum(counts) - counts
                spans: list[list[dict]] = [[] for _ in range(part.rows)]
                hits = np.zeros(part.rows, np.int64)
                for r, mask in enumerate(rows.column(at[HITS]).to_pylist()):
                    if mask:
                        bits = np.unpackbits(np.frombuffer(mask, np.uint8), count=int(counts[r])).astype(np.int8)
                        hits[r] = bits.sum()
                        edge = np.diff(np.concatenate(([0], bits, [0])))
                        for a, b in zip(np.flatnonzero(edge == 1).tolist(), np.flatnonzero(edge == -1).tolist(), strict=True):
                            spans[r].append({"first": a, "last": b - 1, "start": int(part.start[begin[r] + a] - part.bounds[r]), "end": int(part.end[begin[r] + b - 1] - part.bounds[r])})
                yield with_columns(rows, schema, n_words=pa.array(counts, pa.int64()), n_hit=pa.array(hits), items=rows.column(at[ITEMS]),
                    spans=pa.array(spans, pa.list_(pa.struct([(n, pa.int32()) for n in ("first", "last", "start", "end")]))))

    last = finish if mark is None else lambda batches: finish(mark(batches))
    return map_arrow(marked, last, schema).withColumn("contaminated", (F.col("n_hit") > 0) & (F.lit(share) * F.col("n_hit") >= F.col("n_words")))


def remove_spans(found: DataFrame, longest: int = WINDOW, share: int = SHARE, text: str = "text", cleaned: str = "cleaned") -> DataFrame:
    """Add the texts of :func:`contamination` without spans beyond a limit, and ``n_removed``, the words removed.

    A span goes if it has more than ``longest`` words; where at least one word in ``share`` is hit, every span of the
    text goes. A blank stands for what is cut out. Texts that lose nothing stay as they are, null ones too.
    """
    schema = extended(found, (cleaned, StringType()), ("n_removed", LongType()))

    def run(batches):
        for batch in batches:
            at = {n: batch.column(batch.schema.get_field_index(n)) for n in (text, "n_words", "n_hit", "spans")}
            raw = at[text].cast(pa.large_string()).cast(pa.large_binary())
            out, removed = [], []
            for value, n_words, n_hit, spans in zip(raw, *(at[n].to_pylist() for n in ("n_words", "n_hit", "spans")), strict=True):
                over = n_hit > 0 and share * n_hit >= n_words
                gone = [x for x in spans or [] if over or x["last"] - x["first"] + 1 > longest]
                removed.append(sum(x["last"] - x["first"] + 1 for x in gone))
                if not gone:
                    out.append(value.as_py())
                    continue
                data, begin, parts = value.as_py(), 0, []
                for x in gone:
                    parts.append(data[begin : x["start"]])
                    begin = x["end"]
                out.append(b" ".join([*parts, data[begin:]]))
            yield with_columns(batch, schema, **{cleaned: pa.array(out, pa.binary()).cast(pa.string()), "n_removed": pa.array(removed, pa.int64())})

    return map_arrow(found, run, schema)


SQL = r"""
WITH w AS (
  SELECT doc_id, row_number() OVER () AS r,
    regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS ws FROM documents
), b AS (
  SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS ws FROM benchmark
), i AS (
  SELECT DISTINCT item_id, least(13, len(ws)) AS n, array_to_string(ws[j:j+12], ' ') AS g
  FROM (SELECT item_id, ws, unnest(range(1, greatest(2, len(ws) - 11))) AS j FROM b WHERE len(ws) > 0)
), p AS (
  SELECT r, k.n, j, array_to_string(ws[j:j+k.n-1], ' ') AS g
  FROM (SELECT r, ws, unnest(range(1, len(ws) + 1)) AS j FROM w) d, (SELECT DISTINCT n FROM i) k WHERE j + k.n - 1 <= len(ws)
), o AS (
  SELECT p.r, p.j, p.n, i.item_id FROM p JOIN i ON p.n = i.n AND p.g = i.g
), h AS (
  SELECT r, count(DISTINCT j) AS n_hit FROM (SELECT r, unnest(range(j, j + n)) AS j FROM o) GROUP BY r
), t AS (
  SELECT r, count(DISTINCT item_id) AS n_items, array_to_string(list_sort(list(DISTINCT CAST(item_id AS VARCHAR))), ',') AS ids FROM o GROUP BY r
)
SELECT doc_id, CAST(len(ws) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit, CAST(coalesce(n_items, 0) AS BIGINT) AS n_items,
  sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(ws) AS contaminated
FROM w LEFT JOIN h USING (r) LEFT JOIN t USING (r)
"""


@query("op8_benchmark_decontamination", SQL)
def op8_benchmark_decontamination(spark: SparkSession, folder: str) -> DataFrame:
    """Hit words and benchmark items of every document."""
    found = contamination(table(spark, folder, "documents").select("doc_id", "text"), table(spark, folder, "benchmark"))
    return found.select("doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"), F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), "contaminated")
