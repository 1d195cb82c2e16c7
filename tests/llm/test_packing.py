"""Packing: every id in exactly one piece, sequences without gaps, little padding."""

import random
import zlib
from collections import defaultdict

import numpy as np
import pytest
from tokenizers import Tokenizer

from trackspark.llm import packing

from .conftest import prose

SCHEMA = "doc_id long, text string, start string, ids string"


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(packing.VOCABULARY)


def check(pieces, want, size):
    """The pieces give back the documents (a multiset of id tuples) and fill their sequences."""
    docs, sequences = defaultdict(list), defaultdict(list)
    for p in pieces:
        assert p.length == len(p.ids) // 4 > 0
        docs[p.doc_id, p.doc_tokens].append(p)
        sequences[p.sequence_id].append(p)
    found = []
    for (doc_id, n), parts in docs.items():
        at = sorted(parts, key=lambda p: p.start)
        copies = sum(p.length for p in at) // n
        if copies == 1:
            assert [p.start for p in at] == np.cumsum([0] + [p.length for p in at])[:-1].tolist()
            found.append((doc_id, b"".join(p.ids for p in at)))
        else:
            assert sum(p.length for p in at) == copies * n
            found += [(doc_id, None)] * copies
    repeated = {x for x in want if want.count(x) > 1} if len(want) < 100 else set()
    assert sorted(((i, b) if (i, b) not in repeated else (i, None) for i, b in want), key=str) == sorted(found, key=str)
    padding = total = 0
    for parts in sequences.values():
        at = sorted(parts, key=lambda p: p.offset)
        assert [p.offset for p in at] == np.cumsum([0] + [p.length for p in at])[:-1].tolist()
        n = sum(p.length for p in at)
        assert n <= size
        total += n
        padding += 0 if n & (n - 1) == 0 else size - n
    return padding, total


def packed_ids(library, text):
    return np.array([*library.encode(text or "", add_special_tokens=False).ids, 1], "<u4").tobytes()


@pytest.mark.parametrize(("size", "most", "merged"), [(2048, 64, 32), (64, 3, 2)])
def test_pieces_cover_documents(spark, library, size, most, merged):
    rng = random.Random(size)
    texts = [None, "", "a", "<|endoftext|>", " ", "  two  \n\n blanks ", "漢字🙂", prose(rng, 9000), *(prose(rng, rng.randrange(1, 400)) for _ in range(300))]
    rows = [(i, t, "x", "y") for i, t in enumerate(texts)]
    pieces = packing.pack(spark.createDataFrame(rows, SCHEMA).repartition(9), size=size, most=most, merged=merged).collect()
    padding, total = check(pieces, [(i, packed_ids(library, t)) for i, t in enumerate(texts)], size)
    assert padding <= packing.LEAST_GAP / size * total


def test_repeated_rows_null_ids_and_empty(spark, library):
    rows = [(1, "same words here", "", ""), (1, "same words here", "", ""), (None, "no id", "", "")]
    pieces = packing.pack(spark.createDataFrame(rows, SCHEMA)).collect()
    want = [(i, packed_ids(library, t)) for i, t, *_ in rows]
    padding, total = check(pieces, want, 2048)
    assert padding == 0 and total == sum(len(b) // 4 for _, b in want)
    assert packing.pack(spark.createDataFrame([], SCHEMA)).count() == 0


def test_ids_equal_the_library(library, monkeypatch):
    rng = random.Random(5)
    encoder = packing.ByteLevelIds(packing.read_file(packing.VOCABULARY))
    assert encoder.fast is not None
    letters = list("aB1 ,.'s  \n\t\r\x0b\x1c\x85\xa0 　éß漢🙂<|>") + ["<|endoftext|>", "'ll", "   "]
    texts = ["".join(rng.choice(letters) for _ in range(rng.randrange(80))) for _ in range(500)]
    for t in texts:
        assert encoder.encode(t) == packed_ids(library, t)[:-4]
    monkeypatch.setattr(packing, "SLICE_BYTES", 20)
    for t in texts:
        assert encoder.encode(t) == packed_ids(library, t)[:-4]
    blank = "x" + " \n" * 300_000 + "y"
    assert encoder.part(blank) == packed_ids(library, blank)[:-4]


def test_crc_of_the_query(spark, tmp_path):
    spark.createDataFrame([(7, "some text")], "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    rows = packing.op12_packing(spark, str(tmp_path)).collect()
    whole = Tokenizer.from_file(packing.VOCABULARY).encode("some text").ids + [1]
    for r in rows:
        assert r.ids_crc32 == zlib.crc32(np.array(whole[r.start : r.start + r.length], "<u4").tobytes())
    assert sum(r.length for r in rows) == len(whole)
