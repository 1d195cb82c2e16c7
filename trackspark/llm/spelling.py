"""Grouping of spelling variants with a trie of letter-group counts.

Two words that differ by one inserted, deleted or replaced letter have letter counts that differ by at most one surplus
and one deficit. A first level counts a few coarse letter groups: words meet in Spark under the key of their counts, and
every word also asks at the keys that one surplus and one deficit reach. A key's words are then arranged in a trie over
the successive counts of finer groups. The search goes down depth first in blocks of askers with a budget of one surplus
and one deficit each, and compares letters at the leaves.

A key's words are cut into blocks of about ``NODE`` and its askers into parts of about ``ASKERS``, whose numbers follow
from counts, so no task holds a whole crowded key. Askers get one row per block they found something in, so links are
never expanded into lists of pairs. Forms are followed to their roots by pointer doubling; every step goes to a word
that is at least ``RATIO`` times as frequent, so chains are short and have no circles.

Null texts have no words; a null id counts as the empty string in the hash; repeated rows count again. Extra columns are
not carried.
"""

from __future__ import annotations

import zlib
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from trackspark.plans.lineage import discard, materialize

from .batches import map_arrow
from .infilling import row_slices
from .registry import query, table
from .words import MASK, mix, plain

#: Code points of a word, occurrences of a word, how much more frequent a form is, one run of so many loses a letter.
LEAST_LETTERS, LEAST_COUNT, RATIO, MISTAKES = 7, 2, 10, 31
#: Coarse letter groups; the second number is for more than ``MANY`` words.
COARSE, MANY = (3, 6), 20_000_000
#: Fine letter groups (by code point) of the trie, and the largest count that is told apart.
FINE, TOP = 32, 31
#: Words of a key in one block, and askers of a key in one part.
NODE, ASKERS = 100_000, 300_000
#: Words packed together, search states held at once, letter comparisons at once, pairs of one leaf compared one by one.
CHUNK, STATES, PAIRS, LEAF = 20_000, 200_000, 200_000, 1 << 16
#: Letters of a word up to which comparisons are made on padded rows.
WIDTH = 48

_letter = np.zeros(256, bool)
_letter[[*range(65, 91), *range(97, 123)]] = True
_lower = np.arange(256, dtype=np.uint8)
_lower[65:91] += 32
_crc = np.arange(256, dtype=np.uint32)
for _ in range(8):
    _crc = np.where(_crc & 1, (_crc >> 1) ^ np.uint32(0xEDB88320), _crc >> 1)


# ---- words of texts


def checksums(data: np.ndarray, at: np.ndarray, size: np.ndarray, seeds: np.ndarray) -> np.ndarray:
    """CRC-32 of byte runs, each carried on from a seed."""
    order = np.argsort(-size, kind="stable")
    state, place, length = seeds[order] ^ np.uint32(0xFFFFFFFF), at[order], size[order]
    active = len(order)
    for k in range(min(int(length[0]), 64) if len(order) else 0):
        active = int(np.searchsorted(-length[:active], -k, side="left"))
        now = state[:active]
        state[:active] = _crc[(now ^ data[place[:active] + k]) & 0xFF] ^ (now >> 8)
    out = np.empty_like(state)
    out[order] = state ^ np.uint32(0xFFFFFFFF)
    for i in np.flatnonzero(size > 64).tolist():
        out[i] = zlib.crc32(data[at[i] : at[i] + size[i]].tobytes(), int(seeds[i]))
    return out


def runs(data: np.ndarray, bounds: np.ndarray, seeds: np.ndarray, least: int, mistakes: int) -> pa.Array:
    """Words of consecutive rows with at least so many letters, after the letters that go have gone (UTF-8 bytes)."""
    n = len(data)
    lead = data == 0xC3
    follow = np.zeros(n, bool)
    follow[1:] = lead[:-1]
    inside = _letter[data] | lead | follow
    before, after = np.zeros(n, bool), np.zeros(n, bool)
    before[1:], after[:-1] = inside[:-1], inside[1:]
    edges = bounds[(bounds > 0) & (bounds < n)]
    before[edges] = False
    after[edges - 1] = False
    start, end = np.flatnonzero(inside & ~before), np.flatnonzero(inside & ~after) + 1
    letters = np.concatenate(([0], np.cumsum(inside & ~follow)))
    count = letters[end] - letters[start]
    long = count >= least
    start, end, count = start[long], end[long], count[long]
    row = np.searchsorted(bounds, start, side="right") - 1
    steps = np.zeros(n + 1, np.int8)
    steps[start] += 1
    steps[end] -= 1
    mine = _lower[data[np.cumsum(steps[:-1]) > 0]]
    size = end - start
    at = np.cumsum(size) - size

    h = checksums(mine, at, size, seeds[row]).astype(np.int64)
    hit = h % mistakes == 0
    keep = np.ones(len(mine), bool)
    first = np.flatnonzero((mine & 0xC0) != 0x80)
    gone = first[(np.cumsum(count) - count + h % np.maximum(count, 1))[hit]]
    two = mine[gone] == 0xC3
    keep[gone] = False
    keep[gone[two] + 1] = False
    size[hit] -= 1 + two
    count[hit] -= 1
    stays = count >= least
    keep &= np.repeat(stays, end - start)
    offsets = np.concatenate(([0], np.cumsum(size[stays])))
    return pa.Array.from_buffers(pa.large_binary(), int(stays.sum()), [None, pa.py_buffer(offsets), pa.py_buffer(mine[keep])])


def count_words(
    df: DataFrame, least: int = LEAST_LETTERS, occurrences: int = LEAST_COUNT, mistakes: int = MISTAKES, doc_id: str = "doc_id", text: str = "text",
) -> DataFrame:
    """``(word, n)`` of the runs of ASCII and Latin-1 letters with at least so many letters and occurrences."""

    def seed(value) -> int:
        return zlib.crc32((b"" if value is None else str(value).encode()) + b":")

    def run(batches):
        for batch in batches:
            ids, found = batch.column(batch.schema.get_field_index(doc_id)), []
            for first, last, bounds, data in row_slices(plain(batch.column(batch.schema.get_field_index(text)))):
                seeds = np.array([seed(i) for i in ids.slice(first, last - first).to_pylist()], np.uint32)
                found.append(runs(data, bounds, seeds, least, mistakes))
            counts = pa.chunked_array(found, pa.large_binary()).value_counts()
            yield pa.RecordBatch.from_arrays([counts.field(0).cast(pa.binary()).cast(pa.string()), counts.field(1)], names=["word", "n"])

    each = map_arrow(df.select(doc_id, text), run, "word string, n long")
    return each.groupBy("word").agg(F.sum("n").alias("n")).where(F.col("n") >= occurrences)


# ---- packed words: one byte per letter


class Words:
    """Words as Latin-1 bytes; ``at`` has their starts and the end."""

    def __init__(self, letters: np.ndarray, at: np.ndarray):
        self.letters, self.at, self.size = letters, at, np.diff(at)

    def __len__(self) -> int:
        return len(self.size)

    @classmethod
    def of(cls, column) -> Words:
        array = plain(column)
        offsets = np.frombuffer(array.buffers()[1], np.int64, len(array) + 1, array.offset * 8)
        data = np.frombuffer(array.buffers()[2], np.uint8)[offsets[0] : offsets[-1]]
        if (data > 0xC3).any():
            raise ValueError("words have code points up to 255 only")
        lead = data >= 0xC2
        lift = np.zeros(len(data), np.uint8)
        lift[1:] = np.where(data[:-1] == 0xC3, 0x40, 0)
        before = np.concatenate(([0], np.cumsum(lead)))
        return cls((data + lift)[~lead], offsets - offsets[0] - before[offsets - offsets[0]])

    @classmethod
    def unpacked(cls, sizes: list[bytes], letters: list[bytes]) -> Words:
        return cls(np.frombuffer(b"".join(letters), np.uint8), np.concatenate(([0], np.cumsum(np.frombuffer(b"".join(sizes), np.uint32), dtype=np.int64))))

    def counts(self, groups: int) -> np.ndarray:
        word = np.repeat(np.arange(len(self)), self.size)
        return np.bincount(word * groups + self.letters % groups, minlength=len(self) * groups).reshape(-1, groups)

    def take(self, rows: np.ndarray) -> Words:
        size = self.size[rows]
        at = np.concatenate(([0], np.cumsum(size)))
        return Words(self.letters[np.repeat(self.at[rows] - at[:-1], size) + np.arange(at[-1])], at)

    def padded(self, width: int) -> np.ndarray:
        out = np.zeros((len(self), width), np.uint8)
        row = np.repeat(np.arange(len(self)), self.size)
        column = np.arange(len(self.letters)) - self.at[row]
        short = column < width
        out[row[short], column[short]] = self.letters[short]
        return out

    def word(self, i: int) -> bytes:
        return self.letters[self.at[i] : self.at[i + 1]].tobytes()


def key_steps(groups: int) -> tuple[np.ndarray, np.ndarray]:
    """What each group adds to a key; and of all changes within the budget the group that loses (or -1) and the step."""
    weight = mix(np.arange(1, groups + 1, dtype=np.uint64))
    added = [*weight.tolist(), 0]  # the last for no group
    moves = [(j, added[i] - added[j] & MASK) for i in range(-1, groups) for j in range(-1, groups) if i != j or i < 0]
    steps = np.array([s for _, s in moves], np.uint64)
    if len(np.unique(steps)) < len(steps):
        raise ValueError("two changes would lead to one key")
    return weight, np.array([j for j, _ in moves]), steps


def keyed(words: Words, groups: int, around: bool) -> tuple[np.ndarray, np.ndarray]:
    """Word numbers and keys: each word's own, or all that are within the budget of it."""
    counts = words.counts(groups)
    weight, loses, steps = key_steps(groups)
    own = counts.astype(np.uint64) @ weight
    if not around:
        return np.arange(len(words)), own.view(np.int64)
    can = np.ones((len(words), len(steps)), bool)
    has = loses >= 0
    can[:, has] = counts[:, loses[has]] > 0
    row, step = np.nonzero(can)
    return row, (own[row] + steps[step]).view(np.int64)


def packed(words: DataFrame, groups: int, around: bool) -> DataFrame:
    """Rows ``(key, words, sizes, letters, counts)`` of many words each; ``counts`` only for words at their own key."""

    def pack(parts: list[pa.RecordBatch]) -> pa.RecordBatch:
        data = pa.Table.from_batches(parts)
        mine = Words.of(data.column("word"))
        n = data.column("n").to_numpy()
        row, key = keyed(mine, groups, around)
        order = np.argsort(key, kind="stable")
        row, key = row[order], key[order]
        first = np.flatnonzero(np.append(True, key[1:] != key[:-1]))
        last = np.append(first[1:], len(key))
        some = mine.take(row)
        letters, sizes, counts = some.letters.tobytes(), some.size.astype(np.uint32).tobytes(), n[row].astype(np.int64).tobytes()
        spans = list(zip(first.tolist(), last.tolist(), strict=True))
        at = some.at.tolist()
        return pa.RecordBatch.from_arrays([
            pa.array(key[first]), pa.array(last - first),
            pa.array([sizes[4 * a : 4 * b] for a, b in spans], pa.binary()), pa.array([letters[at[a] : at[b]] for a, b in spans], pa.binary()),
            pa.array([None if around else counts[8 * a : 8 * b] for a, b in spans], pa.binary()),
        ], names=["key", "words", "sizes", "letters", "counts"])

    def run(batches) -> Iterator[pa.RecordBatch]:
        parts, rows = [], 0
        for batch in batches:
            if len(batch):
                parts.append(batch)
                rows += len(batch)
            if rows >= CHUNK:
                yield pack(parts)
                parts, rows = [], 0
        if parts:
            yield pack(parts)

    return map_arrow(words, run, "key long, words long, sizes binary, letters binary, counts binary")


# ---- the trie of one block and its search


def vectors(words: Words, order: np.ndarray | None = None) -> np.ndarray:
    """Length and fine letter-group counts, large numbers as one."""
    counts = words.counts(FINE)
    counts = counts if order is None else counts[:, order]
    return np.ascontiguousarray(np.minimum(np.column_stack([words.size, counts]), np.array([255] + [TOP] * FINE)), np.uint8)


def distinct(rows: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct rows in order, the numbers of the rows sorted by them, and where each one's rows start (and the end)."""
    whole = rows.view(f"V{rows.shape[1]}").ravel()
    order = np.lexsort(rows.T[::-1]) if len(rows) < 2 else np.argsort(rows.view(f"S{rows.shape[1]}").ravel(), kind="stable")
    new = np.append(True, whole[order][1:] != whole[order][:-1]) if len(rows) else np.empty(0, bool)
    start = np.flatnonzero(new)
    return rows[order[start]], order, np.append(start, len(rows))


class Trie:
    """One level per count; ``child[level][node * width + count]`` is the node below, or -1."""

    def __init__(self, words: Words):
        self.order = np.argsort(-words.counts(FINE).var(axis=0), kind="stable")
        leaves, self.rows, self.start = distinct(vectors(words, self.order))
        change = np.argmax(leaves[1:] != leaves[:-1], axis=1)
        self.levels = leaves.shape[1]
        self.child, self.width, self.size, self.first = [], [], [], []
        above = np.zeros(len(leaves), np.int64)
        for level in range(self.levels):
            node = np.concatenate(([0], np.cumsum(change <= level)))
            width = int(leaves[:, level].max()) + 1
            below = np.full((int(above[-1]) + 1) * width, -1, np.int32)
            below[above * width + leaves[:, level]] = node
            self.child.append(below)
            self.width.append(width)
            self.size.append(np.bincount(node))
            self.first.append(np.searchsorted(node, np.arange(node[-1] + 1)))
            above = node

    def search(self, askers: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Asker and leaf numbers within the budget, block by block."""
        n = len(askers)
        stack = [(0, np.arange(n), np.zeros(n, np.int64), np.ones(n, bool), np.ones(n, bool))]
        while stack:
            level, q, node, more, less = stack.pop()
            if len(q) > STATES:
                half = len(q) // 2
                stack += [(level, q[half:], node[half:], more[half:], less[half:]), (level, q[:half], node[:half], more[:half], less[:half])]
                continue
            width, child = self.width[level], self.child[level]
            count = askers[q, level].astype(np.int64)
            parts = []
            for step, may in ((0, None), (1, more), (-1, less)):
                want = count + step
                fits = (want >= 0) & (want < width) if may is None else may & (want >= 0) & (want < width)
                i = np.flatnonzero(fits)
                below = child[node[i] * width + want[i]]
                there = below >= 0
                i, below = i[there], below[there]
                if level == 0:  # a longer or shorter word spends its whole budget on the other letter
                    parts.append((q[i], below, np.full(len(i), step >= 0), np.full(len(i), step <= 0)))
                else:
                    parts.append((q[i], below, more[i] & (step != 1), less[i] & (step != -1)))
            q, node, more, less = (np.concatenate(x) for x in zip(*parts, strict=True))
            done = self.size[level][node] == 1 if level < self.levels - 1 else np.ones(len(q), bool)
            if done.any():
                yield q[done], self.first[level][node[done]]
            if not done.all():
                go = ~done
                stack.append((level + 1, q[go], node[go].astype(np.int64), more[go], less[go]))


def near(a: bytes, b: bytes) -> bool:
    """Whether exactly one letter is inserted, deleted or replaced."""
    if len(a) > len(b):
        a, b = b, a
    if a == b or len(b) - len(a) > 1:
        return False
    n = len(a)
    x, y = np.frombuffer(a, np.uint8), np.frombuffer(b, np.uint8)
    unlike = np.flatnonzero(x != y[:n])
    i = int(unlike[0]) if len(unlike) else n
    return a[i + (len(a) == len(b)) :] == b[i + 1 :]


def compare(a: np.ndarray, b: np.ndarray, longer: np.ndarray) -> np.ndarray:
    """:func:`near` for padded rows; ``longer`` is the length of b less that of a (-1, 0 or 1)."""
    out = np.zeros(len(a), bool)
    same = longer == 0
    out[same] = (a[same] != b[same]).sum(axis=1) == 1
    for side in (1, -1):
        rows = np.flatnonzero(longer == side)
        if len(rows):
            x, y = (a[rows], b[rows]) if side == 1 else (b[rows], a[rows])
            first = np.argmax(x != y, axis=1)
            unlike = x[:, :-1] != y[:, 1:]
            last = np.where(unlike.any(axis=1), unlike.shape[1] - 1 - np.argmax(unlike[:, ::-1], axis=1), -1)
            out[rows] = last < first
    return out


def crowded(left: list[bytes], right: list[bytes]) -> Iterator[tuple[int, int]]:
    """Near pairs of a large leaf: one edit leaves the first or the last half of the shorter word as it is."""
    halves = defaultdict(list)
    for k, b in enumerate(right):
        for short in (len(b) - 1, len(b)):
            h = short // 2
            halves[len(b), short, True, b[:h]].append(k)
            halves[len(b), short, False, b[len(b) - (short - h) :]].append(k)
    for i, a in enumerate(left):
        tried = set()
        for other in (len(a) - 1, len(a), len(a) + 1):
            short = min(len(a), other)
            h = short // 2
            tried.update(halves.get((other, short, True, a[:h]), ()), halves.get((other, short, False, a[len(a) - (short - h) :]), ()))
        yield from ((i, k) for k in tried if near(a, right[k]))


def pairs_of(trie: Trie, askers: Words, words: Words) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Near pairs (asker, word), each once."""
    rows, ask_order, ask_start = distinct(vectors(askers, trie.order))
    width = int(min(WIDTH, max(askers.size.max(), words.size.max()))) + 1
    left, right = askers.padded(width), words.padded(width)

    def tested(q: np.ndarray, w: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        longer = words.size[w] - askers.size[q]
        short = (askers.size[q] < width) & (words.size[w] < width) & (np.abs(longer) <= 1)
        good = np.zeros(len(q), bool)
        good[short] = compare(left[q[short]], right[w[short]], longer[short])
        for i in np.flatnonzero(~short & (np.abs(longer) <= 1)).tolist():
            good[i] = near(askers.word(q[i]), words.word(w[i]))
        return q[good], w[good]

    for q, leaf in trie.search(rows):
        n, m = np.diff(ask_start)[q], np.diff(trie.start)[leaf]
        for i in np.flatnonzero(n * m > LEAF).tolist():
            mine, theirs = ask_order[ask_start[q[i]] : ask_start[q[i] + 1]], trie.rows[trie.start[leaf[i]] : trie.start[leaf[i] + 1]]
            found = np.array(list(crowded([askers.word(k) for k in mine], [words.word(k) for k in theirs])), np.int64).reshape(-1, 2)
            yield mine[found[:, 0]], theirs[found[:, 1]]
        few = n * m <= LEAF
        q, leaf, n, m = q[few], leaf[few], n[few], m[few]
        total = np.cumsum(n * m)
        a = 0
        while a < len(q):
            b = max(a + 1, int(np.searchsorted(total, (total[a - 1] if a else 0) + PAIRS, side="right")))
            size = (n * m)[a:b]
            which = np.repeat(np.arange(a, b), size)
            inner = np.arange(int(size.sum())) - np.repeat(np.cumsum(size) - size, size)
            yield tested(ask_order[ask_start[q[which]] + inner // m[which]], trie.rows[trie.start[leaf[which]] + inner % m[which]])
            a = b


def best_of(asks: pa.Table, stored: pa.Table) -> pa.Table:
    """Of one block and one part of its askers: how many near words each asker has there and the most frequent one."""
    names = ["word", "n_near", "best_n", "best"]
    kinds = [pa.string(), pa.int64(), pa.int64(), pa.string()]
    if not len(asks) or not len(stored):
        return pa.table([pa.array([], k) for k in kinds], names=names)
    askers, words = (Words.unpacked(t.column("sizes").to_pylist(), t.column("letters").to_pylist()) for t in (asks, stored))
    n = np.frombuffer(b"".join(stored.column("counts").to_pylist()), np.int64)
    found = list(pairs_of(Trie(words), askers, words))
    q, w = (np.concatenate([f[k] for f in found]) if found else np.empty(0, np.int64) for k in range(2))
    used, inverse = np.unique(w, return_inverse=True)
    text = [words.word(k) for k in used.tolist()]
    rank = np.empty(len(used), np.int64)
    rank[sorted(range(len(used)), key=text.__getitem__)] = np.arange(len(used))
    order = np.lexsort((rank[inverse], -n[w], q))
    q, inverse, w = q[order], inverse[order], w[order]
    first = np.flatnonzero(np.append(True, q[1:] != q[:-1])) if len(q) else np.empty(0, np.int64)
    columns = [
        [askers.word(k).decode("latin-1") for k in q[first].tolist()], np.diff(np.append(first, len(q))), n[w[first]],
        [text[k].decode("latin-1") for k in inverse[first].tolist()],
    ]
    return pa.table([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=names)


# ---- in Spark


def near_words(words: DataFrame) -> DataFrame:
    """``(word, n_near, best_n, best)`` of the words of ``(word, n)`` that have a near word; distinct words, no nulls."""
    groups = COARSE[words.count() > MANY]
    stored = packed(words, groups, around=False)
    asks = materialize(packed(words, groups, around=True), "askers")
    share = lambda total, size: F.ceil(total / size).cast("int")
    nodes = stored.groupBy("key").agg(share(F.sum("words"), NODE).alias("blocks")).join(asks.groupBy("key").agg(share(F.sum("words"), ASKERS).alias("parts")), "key")
    nodes = materialize(nodes, "nodes")
    deal = lambda number: F.pmod(F.xxhash64("sizes", "letters"), F.col(number)).cast("int")
    every = lambda number: F.explode(F.sequence(F.lit(0), F.col(number) - 1))
    left = asks.join(nodes, "key").select("key", "sizes", "letters", deal("parts").alias("part"), every("blocks").alias("block"))
    right = stored.join(nodes, "key").select("key", "sizes", "letters", "counts", deal("blocks").alias("block"), every("parts").alias("part"))
    key = ("key", "block", "part")
    met = left.groupBy(*key).cogroup(right.groupBy(*key)).applyInArrow(best_of, "word string, n_near long, best_n long, best string")
    best = F.min(F.struct((-F.col("best_n")).alias("m"), F.col("best").alias("w"))).alias("b")
    return met.groupBy("word").agg(F.sum("n_near").alias("n_near"), best).select("word", "n_near", (-F.col("b.m")).alias("best_n"), F.col("b.w").alias("best"))


def roots(forms: DataFrame) -> DataFrame:
    """``(word, root)`` of ``(word, form)``: forms followed to the last, by pointer doubling."""
    links = materialize(forms.select("word", F.col("form").alias("root")), "roots")
    while True:
        on = links.select(F.col("word").alias("root"), F.col("root").alias("next"))
        after = materialize(links.join(on, "root", "left").select("word", F.coalesce("next", "root").alias("root"), F.col("next").isNotNull().alias("moved")), "roots")
        discard(links)
        links = after.drop("moved")
        links.written_to = after.written_to
        if after.where("moved").isEmpty():
            return links


def spelling_groups(words: DataFrame, ratio: int = RATIO) -> DataFrame:
    """``word, form, root, n, n_near, form_n`` for a table ``(word, n)`` of distinct words with code points up to 255."""
    words = materialize(words.select("word", "n"), "words", spread=True)
    better = F.col("best_n") >= ratio * F.col("n")
    formed = words.join(near_words(words), "word", "left").select(
        "word", "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"),
        F.when(better, F.col("best")).alias("form"), F.when(better, F.col("best_n")).alias("form_n"),
    )
    formed = materialize(formed, "formed")
    last = roots(formed.where("form is not null"))
    return formed.join(last, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")


@query("op13_spelling_groups")
def op13_spelling_groups(spark: SparkSession, folder: str) -> DataFrame:
    """Words of the documents, their near words and the form each is a variant of."""
    return spelling_groups(count_words(table(spark, folder, "documents")))
