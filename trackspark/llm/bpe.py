"""BPE encoding and decoding with forced-boundary splitting.

Two bytes that stand side by side in no vocabulary token can never end up in one token, so a text may be cut between
them without changing the result. Pre-tokens are cut at all such places, the fragments are encoded independently
(the last one of a pre-token with the end-of-word mark) and their ids are concatenated. White space is a forced
boundary as well, which makes the ids of a blank-separated word independent of the rest of the text: a bounded table
in each Python worker keeps the ids of the words seen last, and unseen fragments of a batch are encoded together.
"""

from __future__ import annotations

import json
import re
from array import array
from collections.abc import Iterator
from pathlib import Path

import numpy as np
import pyarrow as pa
import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import BinaryType, LongType, StringType, StructField, StructType

from .batches import loaded, map_arrow
from .registry import query, table
from .words import SLICE_BYTES, buffers, plain

VOCABULARY = public_tokenizers.path("word_bpe_49k.json")
#: Bytes of a tokenizer file that is shipped to the executors.
FILE_LIMIT = 64 << 20
#: Words and pieces kept per Python worker, and the longest word that is kept.
KEPT_WORDS, KEPT_BYTES = 200_000, 64
#: Pre-tokenizer pattern whose action on plain words (below) is known.
KNOWN_PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
#: Visible ASCII and Western European letters: lower-casing maps them one by one and composition leaves them alone.
PLAIN_WORD = re.compile(r"[!-~À-ÖØ-öø-ÿ]+")
PLAIN_PIECE = re.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[a-zß-öø-ÿ]+|[0-9]|[^a-zß-öø-ÿ0-9]+")


def read_file(path: str) -> str:
    text = Path(path).read_text(encoding="utf-8")
    if len(text) > FILE_LIMIT:
        raise ValueError(f"{path} is larger than {FILE_LIMIT} bytes")
    return text


def byte_letters() -> dict[int, str]:
    """Letter that stands for each byte: visible Latin-1 bytes for themselves, the others by number from 256 on."""
    own = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in own]
    return {b: chr(b) for b in own} | {b: chr(256 + i) for i, b in enumerate(rest)}


class Pretokenizer:
    """Words without ASCII white space to special ids (int) and pre-tokens in byte-level letters (str)."""

    def __init__(self, text: str):
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer, models

        spec = json.loads(text)
        library = Tokenizer.from_str(text)
        self.normalizer, self.pre_tokenizer = library.normalizer, library.pre_tokenizer
        model, steps = spec["model"], (spec["pre_tokenizer"] or {}).get("pretokenizers", [])
        split = next((p for p in steps if p["type"] == "Split"), None)
        if split is None or split["behavior"] != "Removed" or model["type"] != "BPE":
            raise ValueError("white space is no forced boundary of this tokenizer")
        names = [n["type"] for n in (spec["normalizer"] or {}).get("normalizers", [])]
        self.known = split["pattern"].get("Regex") == KNOWN_PATTERN and names == ["NFC", "Replace", "Lowercase"]
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        if any(t["normalized"] or t["lstrip"] or t["rstrip"] or t["single_word"] for t in spec["added_tokens"]):
            raise ValueError("added tokens must be taken from the raw text")
        self.split = re.compile("(" + "|".join(map(re.escape, self.special)) + ")") if self.special else None
        suffix = model.get("end_of_word_suffix") or ""
        merges = [tuple(m.split(" ")) if isinstance(m, str) else tuple(m) for m in model["merges"]]
        bare = lambda end: Tokenizer(models.BPE(vocab=model["vocab"], merges=merges, **({"end_of_word_suffix": end} if end else {})))
        self.build(library, bare, suffix, model["vocab"])
        letters = byte_letters()
        self.letters = {c: "".join(letters[b] for b in chr(c).encode()) for c in range(0x80, 0x100)}

    def build(self, library, bare, suffix: str, vocabulary: dict[str, int]) -> None:
        """Keep what encoding needs; the parsed file and the rest of the library's tokenizer are let go."""

    def pieces(self, word: bytes) -> list:
        text = word.decode("utf-8")
        if self.split and "<" in text:
            out = []
            for part in self.split.split(text):
                out += [self.special[part]] if part in self.special else self._pieces(part)
            return out
        return self._pieces(text)

    def _pieces(self, text: str) -> list[str]:
        if not text:
            return []
        if self.known and PLAIN_WORD.fullmatch(text):
            found = PLAIN_PIECE.findall(text.lower())
            return found if text.isascii() else [x.translate(self.letters) for x in found]
        clean = self.normalizer.normalize_str(text) if self.normalizer else text
        return [x for x, _ in self.pre_tokenizer.pre_tokenize_str(clean)]


class Kept:
    """Values of words, bounded: the first ones stay, as frequent words come first; mostly unknown batches start it anew."""

    def __init__(self, learn, limit: int = KEPT_WORDS):
        self.learn, self.limit, self.known = learn, limit, {}

    def values(self, rows: list[list]) -> dict:
        """A table that has every word of the rows."""
        words = set().union(*rows)
        new = words.difference(self.known)
        if len(self.known) >= self.limit and 2 * len(new) > len(words):
            self.known, new = {}, words
        if not new:
            return self.known
        found = self.learn(list(new))
        if len(self.known) + len(found) <= self.limit and max(map(len, found)) <= KEPT_BYTES:
            self.known.update(found)
            return self.known
        old = {w: self.known[w] for w in words if w in self.known}
        self.known.update((w, v) for w, v in found.items() if len(w) <= KEPT_BYTES and len(self.known) < self.limit)
        return old | found


class ForcedBoundaryBPE(Pretokenizer):
    """Encoder and decoder for a tokenizer file with a byte-level BPE model."""

    def build(self, library, bare, suffix: str, vocabulary: dict[str, int]) -> None:
        self.last, self.inner = bare(suffix).model, bare("").model
        self.joined = set()
        for token in vocabulary:
            token = token.removesuffix(suffix) if suffix and token != suffix else token
            self.joined.update(map("".join, zip(token, token[1:], strict=False)))
        self.dense = all(chr(a) + chr(b) in self.joined for a in range(97, 123) for b in range(97, 123))
        self.token = [library.id_to_token(i) or "" for i in range(library.get_vocab_size(with_added_tokens=True))]
        self.library = library if library.decoder is not None else None
        self.piece_ids = Kept(lambda pieces: {p: self.encode_piece(p) for p in pieces})
        self.word_ids = Kept(self.learn)

    def cut(self, piece: str) -> list[str]:
        """A pre-token in byte-level letters, cut where no token can span."""
        if self.dense and piece.isascii() and piece.isalpha():
            return [piece]
        joined, at, out = self.joined, 0, []
        for i in range(1, len(piece)):
            if piece[i - 1 : i + 1] not in joined:
                out.append(piece[at:i])
                at = i
        out.append(piece[at:])
        return out

    def encode_piece(self, piece: str) -> bytes:
        *head, tail = self.cut(piece)
        found = [t.id for x in head for t in self.inner.tokenize(x)] + [t.id for t in self.last.tokenize(tail)]
        return array("I", found).tobytes()

    def learn(self, words: list[bytes]) -> dict[bytes, bytes]:
        """Ids (little-endian unsigned 32-bit) of words without ASCII white space."""
        split = [self.pieces(w) for w in words]
        ids = self.piece_ids.values([[p for p in ps if isinstance(p, str)] for ps in split])
        return {
            w: b"".join([ids[p] if isinstance(p, str) else p.to_bytes(4, "little") for p in ps]) for w, ps in zip(words, split, strict=True)
        }

    def encode(self, texts: list[bytes]) -> list[bytes]:
        """Ids of whole texts in UTF-8, as little-endian unsigned 32-bit integers."""
        split = [t.split() for t in texts]
        get = self.word_ids.values(split).__getitem__
        return [b"".join(map(get, ws)) for ws in split]

    def decode(self, ids: bytes) -> str:
        """Tokens joined by blanks, as the library does without a decoder; with one, by the library."""
        numbers = np.frombuffer(ids, "<u4").tolist()
        if self.library is not None:
            return self.library.decode(numbers, skip_special_tokens=False)
        return " ".join(map(self.token.__getitem__, numbers))


def byte_slices(column, size: int = SLICE_BYTES) -> Iterator[tuple[int, int, list[bytes]]]:
    """Rows of a text column in runs of about ``size`` bytes."""
    column = plain(column)
    offsets, _ = buffers(column)
    raw, first, n = column.cast(pa.large_binary()), 0, len(column)
    while first < n:
        last = int(np.searchsorted(offsets, offsets[first] + size, side="right")) - 1
        last = min(n, max(last, first + 1))
        yield first, last, raw.slice(first, last - first).to_pylist()
        first = last


def extended(df: DataFrame, *fields: tuple) -> StructType:
    """The frame's schema with fields added; a column of that name is replaced."""
    names = {f[0] for f in fields}
    return StructType([f for f in df.schema.fields if f.name not in names] + [StructField(*f) for f in fields])


def with_columns(batch: pa.RecordBatch, schema: StructType, **columns) -> pa.RecordBatch:
    """The batch with columns added or replaced, in the order of a schema."""
    arrays = [columns[n] if n in columns else batch.column(batch.schema.get_field_index(n)) for n in schema.names]
    return pa.RecordBatch.from_arrays(arrays, names=schema.names)


def encode(df: DataFrame, tokenizer: str = VOCABULARY, text: str = "text", ids: str = "ids", count: str = "n_tokens", decoded: str | None = None) -> DataFrame:
    """Add the ids of every whole text (packed little-endian unsigned 32-bit integers) and their number.

    With ``decoded`` also the text of the ids, in the same pass. Null and empty texts get no ids (empty, 0). Rows are
    independent: ties, repeated rows and extra columns pass through; existing columns named like the results are replaced.
    """
    schema = extended(df, (ids, BinaryType()), (count, LongType()), *([(decoded, StringType())] if decoded else []))
    shipped = df.sparkSession.sparkContext.broadcast(read_file(tokenizer))

    def run(batches):
        bpe = loaded(ForcedBoundaryBPE, shipped.value)
        for batch in batches:
            for first, last, texts in byte_slices(batch.column(batch.schema.get_field_index(text))):
                packed = bpe.encode(texts)
                more = {ids: pa.array(packed, pa.binary()), count: pa.array([len(p) // 4 for p in packed], pa.int64())}
                if decoded:
                    more[decoded] = pa.array([bpe.decode(p) for p in packed], pa.string())
                yield with_columns(batch.slice(first, last - first), schema, **more)

    return map_arrow(df, run, schema, models=True)


def decode(df: DataFrame, tokenizer: str = VOCABULARY, ids: str = "ids", decoded: str = "decoded") -> DataFrame:
    """Add the text of packed ids; null ids count as none. The exact inverse of the library's ids, special tokens kept."""
    schema = extended(df, (decoded, StringType()))
    shipped = df.sparkSession.sparkContext.broadcast(read_file(tokenizer))

    def run(batches):
        bpe = loaded(ForcedBoundaryBPE, shipped.value)
        for batch in batches:
            column = batch.column(batch.schema.get_field_index(ids))
            for first in range(0, len(column), 500):
                part = batch.slice(first, 500)
                texts = [bpe.decode(x or b"") for x in column.slice(first, 500).to_pylist()]
                yield with_columns(part, schema, **{decoded: pa.array(texts, pa.string())})

    return map_arrow(df, run, schema, models=True)


def digests(docs: DataFrame, tokenizer: str = VOCABULARY) -> DataFrame:
    both = encode(docs.select("doc_id", "text"), tokenizer, decoded="decoded")
    return both.select("doc_id", "n_tokens", F.sha2("ids", 256).alias("ids_sha256"), F.sha2(F.encode("decoded", "UTF-8"), 256).alias("decoded_sha256"))


@query("op1_bpe")
def op1_bpe(spark: SparkSession, folder: str) -> DataFrame:
    """Ids of every text and the text of the ids, as digests."""
    return digests(table(spark, folder, "documents"))
