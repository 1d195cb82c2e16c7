"""Fill-in-the-middle transformation by displacement scatter, and its inverse.

A text is cut at two code points into prefix, middle and suffix, which change places around three marks. All texts of a
batch are one run of bytes: the cuts give a difference array of displacements whose running sum is the way every byte
has to go, and one NumPy scatter builds the outputs. The inverse finds the marks and gathers the bytes back. Bytes are
moved in blocks, so that a long text costs its own size and one block of displacements.

Every row is independent. A null or empty text and a text that holds a mark stay as they are (``plain``); a null id
counts as the empty string in the hash. Repeated rows give repeated results, and columns named like the results are
replaced.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StringType

from .batches import map_arrow
from .bpe import extended, with_columns
from .registry import query, table
from .words import SLICE_BYTES, buffers, plain

MARKS = {"prefix": b"<P>", "suffix": b"<S>", "middle": b"<M>"}
MARK = 3
FORMS = np.array(["plain", "psm", "spm"])
PLAIN, PSM, SPM = range(3)
#: Of 100 texts so many are transformed, and of those so many in the order suffix, prefix, middle.
RATE, SPM_RATE = 90, 20
#: Bytes whose displacements are held at once.
BLOCK = 1 << 20


def row_slices(column: pa.Array):
    """``(first, last, bounds, bytes)`` of rows that together have about ``SLICE_BYTES``; a longer row comes alone."""
    offsets, data = buffers(column)
    first, n = 0, len(column)
    while first < n:
        last = int(np.searchsorted(offsets, offsets[first] + SLICE_BYTES, side="right")) - 1
        last = min(n, max(last, first + 1))
        yield first, last, offsets[first : last + 1] - offsets[first], data[offsets[first] : offsets[last]]
        first = last


def find_marks(data: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Place, letter and row of every mark that lies inside one row."""
    at = np.flatnonzero(data[: len(data) - MARK + 1] == ord("<")) if len(data) >= MARK else np.empty(0, np.int64)
    at = at[(data[at + 2] == ord(">")) & np.isin(data[at + 1], [m[1] for m in MARKS.values()])]
    row = np.searchsorted(bounds, at, side="right") - 1
    inside = at + MARK <= bounds[row + 1] if len(at) else np.empty(0, bool)
    return at[inside], data[at[inside] + 1], row[inside]


def code_points(data: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """Code points of every row."""
    counts = np.zeros(len(bounds) - 1, np.int64)
    for a in range(0, len(data), BLOCK):
        leads = np.flatnonzero((data[a : a + BLOCK] & 0xC0) != 0x80) + a
        edges = np.searchsorted(leads, bounds)
        counts += np.diff(edges)
    return counts


def byte_cuts(data: np.ndarray, bounds: np.ndarray, cuts: np.ndarray) -> np.ndarray:
    """Byte where the given code point of each row starts (rows x cuts, both ascending); the row's end if there is none."""
    want = cuts.copy()
    out = np.repeat(bounds[1:, None], cuts.shape[1], axis=1)
    found = np.zeros(cuts.shape, bool)
    for a in range(0, len(data), BLOCK):
        leads = np.flatnonzero((data[a : a + BLOCK] & 0xC0) != 0x80) + a
        edges = np.searchsorted(leads, bounds)
        here = np.diff(edges)[:, None]
        hit = ~found & (want < here)
        out[hit] = leads[(edges[:-1, None] + np.maximum(want, 0))[hit]]
        found |= hit
        want -= here
    return out


def displaced(data: np.ndarray, starts: np.ndarray, shifts: np.ndarray, size: int) -> np.ndarray:
    """Scatter: byte ``i`` goes to ``i`` plus the shift of the segment it lies in (segments in order of ``starts``)."""
    out = np.zeros(size, np.uint8)
    steps = np.diff(shifts, prepend=0)
    for a in range(0, len(data), BLOCK):
        b = min(len(data), a + BLOCK)
        lo, hi = np.searchsorted(starts, [a, b])
        change = np.zeros(b - a, np.int64)
        np.add.at(change, starts[lo:hi] - a, steps[lo:hi])
        change[0] += shifts[lo - 1] if lo else 0
        out[np.cumsum(change) + np.arange(a, b)] = data[a:b]
    return out


def gathered(data: np.ndarray, starts: np.ndarray, shifts: np.ndarray, size: int) -> np.ndarray:
    """Inverse gather: result byte ``i`` is taken from ``i`` plus the shift of the result segment it lies in."""
    out = np.empty(size, np.uint8)
    steps = np.diff(shifts, prepend=0)
    for a in range(0, size, BLOCK):
        b = min(size, a + BLOCK)
        lo, hi = np.searchsorted(starts, [a, b])
        change = np.zeros(b - a, np.int64)
        np.add.at(change, starts[lo:hi] - a, steps[lo:hi])
        change[0] += shifts[lo - 1] if lo else 0
        out[a:b] = data[np.cumsum(change) + np.arange(a, b)]
    return out


def strings(data: np.ndarray, bounds: np.ndarray) -> pa.Array:
    """A string column over the bytes of consecutive rows."""
    offsets = pa.py_buffer(np.ascontiguousarray(bounds, np.int64))
    return pa.Array.from_buffers(pa.large_string(), len(bounds) - 1, [None, offsets, pa.py_buffer(data)]).cast(pa.string())


def hashes(ids: list, seed: str) -> np.ndarray:
    """The first four 32-bit groups of sha256 over ``seed:id`` of each row."""
    head = hashlib.sha256(f"{seed}:".encode())

    def one(value) -> bytes:
        h = head.copy()
        h.update(b"" if value is None else str(value).encode())
        return h.digest()[:16]

    return np.frombuffer(b"".join(map(one, ids)), ">u4").reshape(-1, 4).astype(np.int64)


def scatter(data: np.ndarray, bounds: np.ndarray, h: np.ndarray, rate: int, spm_rate: int) -> dict[str, pa.Array]:
    """Results of consecutive rows."""
    n, start, end = code_points(data, bounds), bounds[:-1], bounds[1:]
    marked = np.zeros(len(n), bool)
    marked[find_marks(data, bounds)[2]] = True
    form = np.where(h[:, 3] % 100 < spm_rate, SPM, PSM)
    form[(n == 0) | marked | (h[:, 2] % 100 >= rate)] = PLAIN
    cuts = np.sort(h[:, :2] % (n + 1)[:, None], axis=1)
    cut = byte_cuts(data, bounds, cuts)
    pre, mid, suf = cut[:, 0] - start, cut[:, 1] - cut[:, 0], end - cut[:, 1]

    size = end - start + np.where(form == PLAIN, 0, 3 * MARK)
    out = np.concatenate(([0], np.cumsum(size)))
    way = out[:-1] - start
    psm, spm = form == PSM, form == SPM
    shifts = np.stack([
        way + np.select([psm, spm], [MARK, 2 * MARK + suf]),
        way + np.where(form == PLAIN, 0, 3 * MARK + suf),
        way + np.select([psm, spm], [2 * MARK - mid, MARK - pre - mid]),
    ], axis=1)
    moved = displaced(data, np.stack([start, cut[:, 0], cut[:, 1]], axis=1).ravel(), shifts.ravel(), int(out[-1]))

    first = out[:-1]
    places = {
        "prefix": first + np.where(spm, MARK + suf, 0),
        "suffix": first + np.where(spm, 0, MARK + pre),
        "middle": first + 2 * MARK + pre + suf,
    }
    for name, at in places.items():
        at = at[form != PLAIN]
        moved[at[:, None] + np.arange(MARK)] = np.frombuffer(MARKS[name], np.uint8)
    none = form == PLAIN
    return {
        "n": pa.array(n, pa.int64()), "form": pa.array(FORMS[form], pa.string()), "output": strings(moved, out),
        "prefix_chars": pa.array(cuts[:, 0], pa.int64(), mask=none), "middle_chars": pa.array(cuts[:, 1] - cuts[:, 0], pa.int64(), mask=none),
    }


def gather(data: np.ndarray, bounds: np.ndarray, form: np.ndarray) -> pa.Array:
    """Texts of consecutive outputs."""
    at, letter, row = find_marks(data, bounds)
    used = form[row] != PLAIN
    at, letter, row = at[used], letter[used], row[used]
    place = {}
    for name, mark in MARKS.items():
        place[name] = bounds[:-1].copy()
        mine = letter == mark[1]
        if not np.array_equal(row[mine], np.flatnonzero(form != PLAIN)):
            raise ValueError(f"an output needs exactly one {mark.decode()}")
        place[name][row[mine]] = at[mine]
    start, end, spm, same = bounds[:-1], bounds[1:], form == SPM, form == PLAIN
    if np.any(np.where(same, False, np.where(spm, place["suffix"], place["prefix"]) != start)):
        raise ValueError("an output does not start with the mark of its form")
    pre = np.where(same, end, np.where(spm, place["middle"], place["suffix"])) - np.where(same, start, place["prefix"] + MARK)
    mid = np.where(same, 0, end - place["middle"] - MARK)
    suf = np.where(same, 0, np.where(spm, place["prefix"], place["middle"]) - place["suffix"] - MARK)
    out = np.concatenate(([0], np.cumsum(pre + mid + suf)))
    starts = np.stack([out[:-1], out[:-1] + pre, out[:-1] + pre + mid], axis=1)
    came = np.stack([np.where(same, start, place["prefix"] + MARK), place["middle"] + MARK, place["suffix"] + MARK], axis=1)
    return strings(gathered(data, starts.ravel(), (came - starts).ravel(), int(out[-1])), out)


def fill_in_middle(df: DataFrame, doc_id: str = "doc_id", text: str = "text", seed: str = "1", rate: int = RATE, spm_rate: int = SPM_RATE) -> DataFrame:
    """Add ``output``, ``form`` (plain, psm or spm), ``n``, ``prefix_chars`` and ``middle_chars`` (code points; null if plain)."""
    schema = extended(df, ("n", LongType()), ("form", StringType()), ("prefix_chars", LongType()), ("middle_chars", LongType()), ("output", StringType()))

    def run(batches):
        for batch in batches:
            ids = batch.column(batch.schema.get_field_index(doc_id))
            for first, last, bounds, data in row_slices(plain(batch.column(batch.schema.get_field_index(text)))):
                h = hashes(ids.slice(first, last - first).to_pylist(), seed)
                yield with_columns(batch.slice(first, last - first), schema, **scatter(data, bounds, h, rate, spm_rate))

    return map_arrow(df, run, schema)


def restore(df: DataFrame, output: str = "output", form: str = "form", restored: str = "restored") -> DataFrame:
    """Add the text that an output was made of, from output and form alone. A null output gives an empty text."""
    schema = extended(df, (restored, StringType()))

    def run(batches):
        for batch in batches:
            kinds = batch.column(batch.schema.get_field_index(form)).to_pylist()
            for first, last, bounds, data in row_slices(plain(batch.column(batch.schema.get_field_index(output)))):
                kind = np.array([PLAIN if k is None else FORMS.tolist().index(k) for k in kinds[first:last]])
                yield with_columns(batch.slice(first, last - first), schema, **{restored: gather(data, bounds, kind)})

    return map_arrow(df, run, schema)


SQL = r"""
WITH t AS (
  SELECT doc_id, coalesce(text, '') AS x, length(coalesce(text, '')) AS n, sha256('1:' || coalesce(CAST(doc_id AS VARCHAR), '')) AS h FROM documents
), g AS (
  SELECT *, CAST('0x' || h[1:8] AS BIGINT) % (n + 1) AS a, CAST('0x' || h[9:16] AS BIGINT) % (n + 1) AS b,
    CAST('0x' || h[17:24] AS BIGINT) % 100 AS c, CAST('0x' || h[25:32] AS BIGINT) % 100 AS d FROM t
), f AS (
  SELECT *, least(a, b) AS lo, greatest(a, b) AS hi,
    CASE WHEN n = 0 OR c >= 90 OR contains(x, '<P>') OR contains(x, '<S>') OR contains(x, '<M>') THEN 'plain' WHEN d < 20 THEN 'spm' ELSE 'psm' END AS form FROM g
), p AS (
  SELECT *, substring(x, 1, lo) AS pre, substring(x, lo + 1, hi - lo) AS mid, substring(x, hi + 1) AS suf FROM f
)
SELECT doc_id, CAST(n AS BIGINT) AS n, form, CASE WHEN form <> 'plain' THEN CAST(lo AS BIGINT) END AS prefix_chars,
  CASE WHEN form <> 'plain' THEN CAST(hi - lo AS BIGINT) END AS middle_chars,
  sha256(CASE form WHEN 'plain' THEN x WHEN 'psm' THEN '<P>' || pre || '<S>' || suf || '<M>' || mid
    ELSE '<S>' || suf || '<P>' || pre || '<M>' || mid END) AS output_sha256, sha256(x) AS restored_sha256
FROM p
"""


@query("op11_fill_in_middle", SQL)
def op11_fill_in_middle(spark: SparkSession, folder: str) -> DataFrame:
    """Every document transformed and restored, as digests."""
    made = restore(fill_in_middle(table(spark, folder, "documents").select("doc_id", "text")).drop("text"))
    digest = lambda c: F.sha2(F.encode(c, "UTF-8"), 256)
    return made.select("doc_id", "n", "form", "prefix_chars", "middle_chars", digest("output").alias("output_sha256"), digest("restored").alias("restored_sha256"))
