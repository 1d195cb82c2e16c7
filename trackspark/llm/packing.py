"""Packing of documents into training sequences: bounded-space online best fit, leftovers merged in rounds.

Every task keeps a fixed number of open windows and reads its documents once. A piece goes into the open window that it
leaves fullest; when none has room, the fullest window is emitted and a new one takes its place. Documents may be cut:
whole windows' worth of a long document are sequences of their own, and an emitted window with a gap worth filling gets
the head of the piece that found no room. What the tasks leave open is written with the rest, regrouped by task number
and packed again, until one group of windows is left; of that, all but one window are filled, and the last is cut at
powers of two, so that it needs no padding.

Each round is one table in the shared folder, written once: a task that runs again after a lost executor replaces its
own rows and nothing else is read twice. No step holds more than ``MERGED`` tasks' windows or one row of the input.

Ids are those of the tokenizer library for the file, special strings included. A byte-level file whose merges are in the
order of their ids is encoded through its ranks, which is the same and faster; texts beyond that encoder (very long white
space) and other files go through the library. Null and empty texts are documents of the end id alone; repeated rows are
packed as often as they occur; a null id stays null. Extra columns are not carried.
"""

from __future__ import annotations

import json
import re
from bisect import bisect_left, insort
from collections.abc import Iterator

import pyarrow as pa
import public_tokenizers
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import BinaryType, BooleanType, LongType, StructField, StructType

from trackspark.plans.lineage import materialize

from .batches import loaded, map_arrow
from .bpe import byte_letters, read_file
from .registry import query, table
from .words import SLICE_BYTES

VOCABULARY = public_tokenizers.path("byte_bpe_50k.json")
SEQUENCE, END = 2048, 1
#: Open windows per task, the smallest gap that a cut piece fills, and tasks whose leftovers are merged together.
OPEN, LEAST_GAP, MERGED = 64, 16, 32
#: Bytes of ids in an output batch.
FLUSH = 4 << 20
ID_BYTES = 4
#: A sequence id is round, task and number.
ROUND_BITS, TASK_BITS = 57, 32
#: Between any character and a blank with a visible ASCII letter behind it the pre-tokenizer starts afresh.
SAFE = re.compile(rb" (?=[!-~])")


class ByteLevelIds:
    """Ids of whole texts, as packed little-endian unsigned 32-bit integers."""

    def __init__(self, text: str):
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_str(text)
        self.library.no_truncation()
        self.library.no_padding()
        spec = json.loads(text)
        self.fast = self.ranked(spec) if self.ranks_suffice(spec) else None
        self.special = {t["content"] for t in spec["added_tokens"]}

    @staticmethod
    def ranks_suffice(spec: dict) -> bool:
        model, pre = spec["model"], spec["pre_tokenizer"] or {}
        if model["type"] != "BPE" or spec["normalizer"] or pre.get("type") != "ByteLevel" or pre.get("add_prefix_space") or not pre.get("use_regex"):
            return False
        if any(model.get(k) for k in ("dropout", "continuing_subword_prefix", "end_of_word_suffix", "byte_fallback")):
            return False
        if any(t["normalized"] or t["lstrip"] or t["rstrip"] or t["single_word"] or " " in t["content"] for t in spec["added_tokens"]):
            return False
        made = [model["vocab"]["".join(m.split(" ") if isinstance(m, str) else m)] for m in model["merges"]]
        return all(a < b for a, b in zip(made, made[1:], strict=False))

    @staticmethod
    def ranked(spec: dict):
        import tiktoken

        letters = {c: b for b, c in byte_letters().items()}
        added = {t["content"]: t["id"] for t in spec["added_tokens"]}
        ranks = {bytes(map(letters.__getitem__, t)): i for t, i in spec["model"]["vocab"].items() if t not in added}
        return tiktoken.Encoding("ranks", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens=added)._core_bpe

    def part(self, text: str) -> bytes:
        if self.fast is not None:
            try:
                return bytes(self.fast.encode_to_tiktoken_buffer(text, self.special))
            except ValueError:  # white space too long for the pattern's search
                pass
        return b"".join(i.to_bytes(ID_BYTES, "little") for i in self.library.encode(text, add_special_tokens=False).ids)

    def encode(self, text: str | None) -> bytes:
        if not text:
            return b""
        if self.fast is None or len(text) <= SLICE_BYTES:
            return self.part(text)
        raw, at, out = text.encode(), 0, []
        while at < len(raw):
            stop = SAFE.search(raw, at + SLICE_BYTES)
            end = stop.start() if stop else len(raw)
            out.append(self.part(raw[at:end].decode()))
            at = end
        return b"".join(out)


class Packer:
    """Open windows of one task; pieces are ``(doc_id, start, ids, doc_tokens)`` and leave through ``emit(pieces, open)``."""

    def __init__(self, emit, size: int, most: int, least: int):
        self.emit, self.size, self.most, self.least = emit, size, most, least
        self.windows: dict[int, list] = {}
        self.gaps: list[tuple[int, int]] = []
        self.made = 0

    def place(self, doc_id, start: int, ids: bytes, doc_tokens: int) -> None:
        at, end, size = 0, len(ids) // ID_BYTES, self.size
        while at < end:
            n = end - at
            take = lambda k, a: (doc_id, start + a, ids[a * ID_BYTES : (a + k) * ID_BYTES], doc_tokens)
            if n >= size:
                self.emit([take(size, at)], False)
                at += size
                continue
            i = bisect_left(self.gaps, (n, -1))
            if i == len(self.gaps) and len(self.windows) >= self.most:
                gap, window = self.gaps.pop(0)
                pieces = self.windows.pop(window)
                if gap >= self.least:
                    pieces.append(take(gap, at))
                    at += gap
                self.emit(pieces, False)
                continue
            if i < len(self.gaps):
                gap, window = self.gaps.pop(i)
            else:
                gap, window = size, self.made
                self.made += 1
                self.windows[window] = []
            self.windows[window].append(take(n, at))
            at = end
            if gap == n:
                self.emit(self.windows.pop(window), False)
            else:
                insort(self.gaps, (gap - n, window))

    def leave_open(self) -> None:
        for _, window in self.gaps:
            self.emit(self.windows[window], True)

    def close(self) -> None:
        """Fill the fullest windows from the emptiest ones; the last one is cut at powers of two."""
        rest = [(gap, self.windows[w]) for gap, w in self.gaps]
        first, last = 0, len(rest) - 1
        while first < last:
            gap, pieces = rest[first]
            donor = rest[last][1]
            doc_id, start, ids, n = donor.pop()
            moved = min(gap, len(ids) // ID_BYTES)
            pieces.append((doc_id, start, ids[: moved * ID_BYTES], n))
            if moved * ID_BYTES < len(ids):
                donor.append((doc_id, start + moved, ids[moved * ID_BYTES :], n))
            rest[first] = (gap - moved, pieces)
            if gap == moved:
                self.emit(pieces, False)
                first += 1
            if not donor:
                last -= 1
        if first == last:
            self.powers(rest[first][1])

    def powers(self, pieces: list) -> None:
        left = sum(len(p[2]) for p in pieces) // ID_BYTES
        pieces = pieces[::-1]
        while left:
            room, out = 1 << (left.bit_length() - 1), []
            left -= room
            while room:
                doc_id, start, ids, n = pieces.pop()
                k = min(room, len(ids) // ID_BYTES)
                out.append((doc_id, start, ids[: k * ID_BYTES], n))
                if k * ID_BYTES < len(ids):
                    pieces.append((doc_id, start + k, ids[k * ID_BYTES :], n))
                room -= k
            self.emit(out, False)


class Rows:
    """Emitted windows as record batches of pieces."""

    def __init__(self, schema: pa.Schema, head: int):
        self.schema, self.head, self.number, self.bytes = schema, head, 0, 0
        self.columns: list[list] = [[] for _ in schema]

    def add(self, pieces: list, still_open: bool) -> None:
        offset = 0
        for doc_id, start, ids, n in pieces:
            k = len(ids) // ID_BYTES
            for column, value in zip(self.columns, (doc_id, start, k, ids, n, self.head + self.number, offset, still_open), strict=True):
                column.append(value)
            offset += k
            self.bytes += len(ids)
        self.number += 1

    def take(self) -> pa.RecordBatch:
        arrays = [pa.array(c, f.type) for c, f in zip(self.columns, self.schema, strict=True)]
        self.columns, self.bytes = [[] for _ in self.schema], 0
        return pa.RecordBatch.from_arrays(arrays, schema=self.schema)


def _schema(df: DataFrame, doc_id: str) -> tuple[StructType, pa.Schema]:
    from pyspark.sql.pandas.types import to_arrow_schema

    long = lambda n: StructField(n, LongType())
    fields = [StructField("doc_id", df.schema[doc_id].dataType), long("start"), long("length"), StructField("ids", BinaryType())]
    spark = StructType([*fields, long("doc_tokens"), long("sequence_id"), long("offset"), StructField("open", BooleanType())])
    return spark, to_arrow_schema(spark)


def pack(
    df: DataFrame, tokenizer: str = VOCABULARY, size: int = SEQUENCE, end: int = END, most: int = OPEN, least: int = LEAST_GAP,
    merged: int = MERGED, doc_id: str = "doc_id", text: str = "text",
) -> DataFrame:
    """One row per piece: ``doc_id, start, length, ids, doc_tokens, sequence_id, offset``.

    A document is its ids and the ``end`` id. A sequence has at most ``size`` ids; ``most`` windows are open in a task.
    """
    spark = df.sparkSession
    schema, arrow = _schema(df, doc_id)
    shipped = spark.sparkContext.broadcast(read_file(tokenizer))
    tail = end.to_bytes(ID_BYTES, "little")

    def online(batches) -> Iterator[pa.RecordBatch]:
        encoder = loaded(ByteLevelIds, shipped.value)
        rows = Rows(arrow, TaskContext.get().partitionId() << TASK_BITS)
        packer = Packer(rows.add, size, most, least)
        for batch in batches:
            names = batch.schema.names
            for key, value in zip(batch.column(names.index(doc_id)).to_pylist(), batch.column(names.index(text)), strict=True):
                ids = encoder.encode(value.as_py()) + tail
                packer.place(key, 0, ids, len(ids) // ID_BYTES)
                if rows.bytes >= FLUSH:
                    yield rows.take()
        packer.leave_open()
        yield rows.take()

    def again(number: int, last: bool):
        def run(key: tuple, data: pa.Table) -> pa.Table:
            rows = Rows(arrow, (number << ROUND_BITS) + (key[0].as_py() << TASK_BITS))
            packer = Packer(rows.add, size, most, least)
            pieces = zip(*(data.column(n).to_pylist() for n in ("doc_id", "start", "ids", "doc_tokens")), strict=True)
            for piece in sorted(pieces, key=lambda p: (-len(p[2]), str(p[0]), p[1])):
                packer.place(*piece)
            packer.close() if last else packer.leave_open()
            return pa.Table.from_batches([rows.take()])

        return run

    done = [materialize(map_arrow(df.select(doc_id, text), online, schema, models=True), "packed")]
    task = F.shiftright("sequence_id", TASK_BITS).bitwiseAND((1 << (ROUND_BITS - TASK_BITS)) - 1)
    while True:
        left = done[-1].where("open")
        highest = left.agg(F.max(task)).first()[0]
        if highest is None:
            break
        group = F.floor(task / merged).cast("long")
        packed = left.withColumn("group", group).groupBy("group").applyInArrow(again(len(done), highest < merged), schema)
        done.append(materialize(packed, "packed"))
    out = done[0]
    for more in done[1:]:
        out = out.union(more)
    return out.where("not open").drop("open")


@query("op12_packing")
def op12_packing(spark: SparkSession, folder: str) -> DataFrame:
    """Every piece of every document with its place."""
    pieces = pack(table(spark, folder, "documents"))
    return pieces.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")
