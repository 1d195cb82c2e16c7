"""Spelling groups against plain Python."""

import random
import re
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest

from trackspark.llm import spelling

RUN = re.compile("[A-Za-zÀ-ÿ]+")
LOWER = str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})


def plain_counts(rows, least=7, occurrences=2, mistakes=31):
    counts = Counter()
    for doc_id, text, *_ in rows:
        for run in RUN.findall(text or ""):
            run = run.translate(LOWER)
            h = zlib.crc32(f"{'' if doc_id is None else doc_id}:{run}".encode())
            if h % mistakes == 0:
                k = h % len(run)
                run = run[:k] + run[k + 1 :]
            if len(run) >= least:
                counts[run] += 1
    return {w: n for w, n in counts.items() if n >= occurrences}


def one_edit(a, b):
    if len(a) > len(b):
        a, b = b, a
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b, strict=True)) == 1
    return len(b) == len(a) + 1 and any(b[:i] + b[i + 1 :] == a for i in range(len(b)))


def plain_groups(counts, ratio=10):
    near = {w: [v for v in counts if abs(len(v) - len(w)) <= 1 and one_edit(w, v)] for w in counts}
    form = {}
    for w, vs in near.items():
        best = min(vs, key=lambda v: (-counts[v], v), default=None)
        form[w] = best if best is not None and counts[best] >= ratio * counts[w] else None
    out = []
    for w, n in counts.items():
        root = w
        while form[root] is not None:
            root = form[root]
        out.append((w, form[w], root, n, len(near[w]), counts.get(form[w])))
    return sorted(out, key=str)


def texts(rng):
    letters = "abcdeéß×÷Àà"
    base = ["".join(rng.choice(letters) for _ in range(rng.randrange(6, 12))) for _ in range(60)]

    def typo(w):
        k = rng.randrange(len(w) + 1)
        return rng.choice([w[:k] + rng.choice(letters) + w[k:], w[:k] + w[k + 1 :], w[:k] + rng.choice(letters) + w[k + 1 :]])

    words = [w for i, w in enumerate(base) for _ in range(2 * 3 ** (i % 6))]
    words += [t for w in base for t in (typo(w), typo(typo(w))) for _ in range(rng.randrange(1, 5))]
    words += ["".join(rng.sample("abcdefgh", 8)) for _ in range(300)] * 2
    words += ["chainaaa"] * 4 + ["chainaab"] * 60 + ["chainabb"] * 900
    rng.shuffle(words)
    out = [None, "", "abcdefg", "x" * 400, "x" * 400 + " " + "x" * 399 + " " + "x" * 399, "q" * 60 + " " + "q" * 60, "q" * 59 + "a" + " " + "q" * 59 + "a"]
    for k in range(0, len(words), 20):
        out.append(rng.choice([" ", ", ", "1", "—", "Ā", "\n"]).join(w.upper() if rng.random() < 0.1 else w for w in words[k : k + 20]))
    return out


@pytest.mark.parametrize(("node", "askers", "states", "pairs", "leaf", "groups"), [(100_000, 300_000, 200_000, 200_000, 1 << 16, 3), (40, 60, 50, 30, 4, 6)])
def test_groups_equal_plain_version(spark, monkeypatch, node, askers, states, pairs, leaf, groups):
    for name, value in (("NODE", node), ("ASKERS", askers), ("COARSE", (groups, groups))):
        monkeypatch.setattr(spelling, name, value)
    rng = random.Random(groups)
    rows = [(i, t, "w", 1) for i, t in enumerate(texts(rng))]
    rows += [(None, "somewhere somewhere", "w", 1), (1, "abcdefg abcdefg", "w", 1), (1, "abcdefg abcdefg", "w", 1)]
    frame = spark.createDataFrame(rows, "doc_id long, text string, word string, n long")
    counts = spelling.count_words(frame, mistakes=5)
    want = plain_counts(rows, mistakes=5)
    assert {r.word: r.n for r in counts.collect()} == want
    got = sorted((tuple(r) for r in spelling.spelling_groups(counts).collect()), key=str)
    assert got == plain_groups(want)
    assert any(r[1] and r[1] != r[2] for r in got)


def test_small_blocks_and_crowded_leaves(monkeypatch):
    """The search alone, with bounds so small that every path is taken."""
    for name, value in (("STATES", 7), ("PAIRS", 5), ("LEAF", 2), ("WIDTH", 10)):
        monkeypatch.setattr(spelling, name, value)
    rng = random.Random(3)
    words = sorted({"".join(rng.choice("abcß") for _ in range(rng.randrange(4, 16))) for _ in range(500)} | {"".join(rng.sample("abcdef", 6)) for _ in range(200)})
    mine = spelling.Words.of(pa.array(words))
    found = [p for q, w in spelling.pairs_of(spelling.Trie(mine), mine, mine) for p in zip(q.tolist(), w.tolist(), strict=True)]
    want = [(i, k) for i, a in enumerate(words) for k, b in enumerate(words) if abs(len(a) - len(b)) <= 1 and one_edit(a, b)]
    assert sorted(found) == want


def test_checksums_and_keys():
    rng = random.Random(1)
    parts = [bytes(rng.randrange(256) for _ in range(rng.choice([1, 5, 64, 65, 300]))) for _ in range(50)]
    size = np.array([len(p) for p in parts])
    seeds = np.array([zlib.crc32(b"%d:" % i) for i in range(50)], np.uint32)
    got = spelling.checksums(np.frombuffer(b"".join(parts), np.uint8), np.cumsum(size) - size, size, seeds)
    assert got.tolist() == [zlib.crc32(p, zlib.crc32(b"%d:" % i)) for i, p in enumerate(parts)]
    for groups in (3, 6):
        assert len(spelling.key_steps(groups)[2]) == 1 + 2 * groups + groups * (groups - 1)
    with pytest.raises(ValueError, match="255"):
        spelling.Words.of(pa.array(["Āb"]))


def test_empty_table(spark):
    empty = spark.createDataFrame([], "doc_id long, text string")
    assert spelling.spelling_groups(spelling.count_words(empty)).count() == 0
