"""Words of text batches as NumPy arrays.

Words are cut straight from the UTF-8 buffer of an Arrow column; no Python string is made. A word's 64-bit hash is a
Rabin-Karp polynomial over its bytes, read off running sums modulo 2**64 and mixed afterwards; hashes of word windows
are polynomials over the word hashes.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa

SLICE_BYTES = 1 << 20
BASE = 0x9E3779B97F4A7C15
MASK = (1 << 64) - 1

_powers: list[np.ndarray] = []


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """BASE**i and BASE**-i modulo 2**64 for i < n."""
    if not _powers or len(_powers[0]) < n:
        size = max(n, SLICE_BYTES + 1)
        up = np.full(size, BASE, np.uint64)
        down = np.full(size, pow(BASE, -1, 1 << 64), np.uint64)
        up[0] = down[0] = 1
        up, down = np.multiply.accumulate(up), np.multiply.accumulate(down)
        if size > SLICE_BYTES + 1:
            return up, down
        _powers[:] = [up, down]
    return _powers[0][:n], _powers[1][:n]


def mix(h: np.ndarray) -> np.ndarray:
    """Spread every bit of a 64-bit value over all bits."""
    h = h ^ (h >> np.uint64(33))
    h = h * np.uint64(0xFF51AFD7ED558CCD)
    h = h ^ (h >> np.uint64(33))
    h = h * np.uint64(0xC4CEB9FE1A85EC53)
    return h ^ (h >> np.uint64(33))


@dataclass(frozen=True)
class Alphabet:
    """Which bytes belong to words and the value each byte counts as."""

    member: np.ndarray
    value: np.ndarray


def _alphabet(member, lower: bool) -> Alphabet:
    keep = np.array([bool(member(b)) for b in range(256)])
    value = np.array([b + 32 if lower and 65 <= b <= 90 else b for b in range(256)], np.uint64) + np.uint64(1)
    return Alphabet(keep, mix(value))


def _space(b: int) -> bool:
    return b == 0x20 or 0x09 <= b <= 0x0D


#: Runs of bytes other than space and the five control separators.
SPACED = _alphabet(lambda b: not _space(b), lower=False)
SPACED_LOWER = _alphabet(lambda b: not _space(b), lower=True)
#: Runs of ASCII letters, digits and all non-ASCII bytes.
ALNUM_LOWER = _alphabet(lambda b: 48 <= b <= 57 or 65 <= b <= 90 or 97 <= b <= 122 or b >= 128, lower=True)


@dataclass
class Slice:
    """Words of the rows ``first`` .. ``last - 1``; ``row`` counts from ``first``, ``start`` / ``end`` index ``data``."""

    first: int
    last: int
    data: np.ndarray
    bounds: np.ndarray
    start: np.ndarray
    end: np.ndarray
    row: np.ndarray
    hash: np.ndarray
    heads: list[np.ndarray]

    @property
    def rows(self) -> int:
        return self.last - self.first

    def counts(self) -> np.ndarray:
        return np.bincount(self.row, minlength=self.rows)

    def windows(self, size: int) -> tuple[np.ndarray, np.ndarray]:
        """Index of the first word and hash of each run of ``size`` words inside one row."""
        n = len(self.hash)
        if n < size:
            return np.empty(0, np.int64), np.empty(0, np.uint64)
        up, down = powers(n + 1)
        total = np.zeros(n + 1, np.uint64)
        np.cumsum(self.hash * up[:n], out=total[1:])
        at = np.flatnonzero(self.row[: n - size + 1] == self.row[size - 1 :])
        return at, mix((total[at + size] - total[at]) * down[at])


def plain(column) -> pa.Array:
    """One large_string array without nulls."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks() if column.num_chunks != 1 else column.chunk(0)
    column = column.cast(pa.large_string())
    return column.fill_null("") if column.null_count else column


def buffers(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Offsets (len + 1) and bytes of a plain column."""
    _, offsets, data = column.buffers()
    at = np.frombuffer(offsets, np.int64, len(column) + 1, column.offset * 8) if len(column) else np.zeros(1, np.int64)
    return at, np.frombuffer(data, np.uint8) if data is not None and data.size else np.empty(0, np.uint8)


def _cut(data: np.ndarray, bounds: np.ndarray, alphabet: Alphabet, heads: tuple[int, ...]) -> tuple[np.ndarray, ...]:
    n = len(data)
    inside = alphabet.member[data]
    before = np.zeros(n, bool)
    before[1:] = inside[:-1]
    after = np.zeros(n, bool)
    after[:-1] = inside[1:]
    edges = bounds[(bounds > 0) & (bounds < n)]
    before[edges] = False
    after[edges - 1] = False
    start = np.flatnonzero(inside & ~before)
    end = np.flatnonzero(inside & ~after) + 1
    up, down = powers(n + 1)
    sums = np.zeros(n + 1, np.uint64)
    np.cumsum(alphabet.value[data] * up[:n], out=sums[1:])
    code = lambda stop: mix((sums[stop] - sums[start]) * down[start])
    return start, end, code(end), *(code(np.minimum(start + k, end)) for k in heads)


def _long(data: np.ndarray, alphabet: Alphabet, heads: tuple[int, ...]) -> tuple[np.ndarray, ...]:
    """A row above the slice size, piece by piece; pieces end at a separator."""
    parts, at, n = [], 0, len(data)
    while at < n:
        size = SLICE_BYTES
        while True:
            stop = min(n, at + size)
            gaps = np.flatnonzero(~alphabet.member[data[at:stop]]) if stop < n else None
            if gaps is None or len(gaps):
                break
            size *= 2
        stop = n if gaps is None else at + int(gaps[-1]) + 1
        start, end, *codes = _cut(data[at:stop], np.array([0, stop - at]), alphabet, heads)
        parts.append((start + at, end + at, *codes))
        at = stop
    return tuple(np.concatenate(x) for x in zip(*parts, strict=True))


def slices(column, alphabet: Alphabet, heads: tuple[int, ...] = ()) -> Iterator[Slice]:
    """Words of a text column in slices of about ``SLICE_BYTES``; whole rows stay together. Null counts as empty.

    ``heads`` asks for the hashes of the words' first so many bytes as well.
    """
    column = plain(column)
    offsets, data = buffers(column)
    first, n = 0, len(column)
    while first < n:
        last = int(np.searchsorted(offsets, offsets[first] + SLICE_BYTES, side="right")) - 1
        last = min(n, max(last, first + 1))
        bounds = offsets[first : last + 1] - offsets[first]
        part = data[offsets[first] : offsets[last]]
        start, end, code, *more = _long(part, alphabet, heads) if len(part) > SLICE_BYTES else _cut(part, bounds, alphabet, heads)
        row = np.searchsorted(bounds, start, side="right") - 1
        yield Slice(first, last, part, bounds, start, end, row, code, more)
        first = last
