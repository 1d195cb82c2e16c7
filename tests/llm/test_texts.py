"""BPE, token counts, substring dedup, decontamination, near duplicates, toxicity, licenses."""

import hashlib
import random
import re
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from trackspark.llm import bpe, decontamination, licenses, neardup, substrings, token_counts, toxicity, words
from trackspark.llm.components import components

from .conftest import prose

SPLIT = re.compile(r"[^\x20\x09-\x0D]+")
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def docs(spark, texts, ids=None, extra=""):
    rows = [(i, t, "en", "s", None if t is None else len(t)) for i, t in zip(ids or range(len(texts)), texts, strict=True)]
    return spark.createDataFrame(rows, SCHEMA + extra)


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(bpe.VOCABULARY)


ODD = [
    None, "", "   \n\t ", "a", "<|endoftext|>", "x<|startoftext|>y <|ENDOFTEXT|>", "don't WE'LL 'S", "ΣΊΣΥΦΟΣ ς İstanbul ﬁ Å Å",
    "漢字 日本語　text", "🙂👩‍👩‍👧 é́ \x1c\x1f", "ñandú\xa0über straße ½Ⅷ²", "z" * 5000, "ßz ñj qq\x00w", "same", "same", "12345 3.14",
]


def test_bpe_and_counts_equal_the_library(spark, library):
    rng = random.Random(3)
    letters = list("abC  \n\t\x0b\x1c'stredlvm01.,!?<|>éÉßΣσς İıǺé　漢🙂ﬁⅧ²") + ["<|endoftext|>", "'ll", "don't"]
    texts = ODD + ["".join(rng.choice(letters) for _ in range(rng.randrange(60))) for _ in range(300)] + [prose(rng, 40_000)]
    frame = docs(spark, texts).withColumnRenamed("lang", "ids").withColumnRenamed("source", "n_tokens")
    got = {r.doc_id: r for r in bpe.decode(bpe.encode(frame)).collect()}
    counts = {r.doc_id: r.n_tokens for r in token_counts.count_tokens(frame).collect()}
    for i, t in enumerate(texts):
        ids = library.encode(t or "", add_special_tokens=False).ids
        assert np.frombuffer(got[i].ids, "<u4").tolist() == ids
        assert got[i].n_tokens == counts[i] == len(ids)
        assert got[i].decoded == library.decode(ids, skip_special_tokens=False)
    assert bpe.encode(docs(spark, [])).count() == 0


def test_forced_boundaries_are_cut(library):
    known = bpe.ForcedBoundaryBPE(bpe.read_file(bpe.VOCABULARY))
    pieces = ["".join(known.letters.get(ord(c), c) for c in w) for w in ("ßzñjq", "éèêëz", "abc")]
    assert any(len(known.cut(p)) > 1 for p in pieces)
    for p in pieces:
        assert "".join(known.cut(p)) == p
        assert all(a[-1] + b[0] not in known.joined for a, b in zip(known.cut(p), known.cut(p)[1:], strict=False))


def test_words_and_windows():
    rng = random.Random(1)
    texts = [None, "", " ", "one", " two  words\n", "Ünï cödé A-b_c9", "\t".join("abcdef"), "q" * 100, *(prose(rng, 200) for _ in range(30))]
    old, words.SLICE_BYTES = words.SLICE_BYTES, 300
    words._powers.clear()
    try:
        small = [(p.first + r, h) for p in words.slices(pa.array(texts), words.SPACED) for r, h in zip(p.row.tolist(), p.hash.tolist(), strict=True)]
    finally:
        words.SLICE_BYTES = old
        words._powers.clear()
    large = [(p.first + r, h) for p in words.slices(pa.array(texts), words.SPACED) for r, h in zip(p.row.tolist(), p.hash.tolist(), strict=True)]
    assert small == large
    assert Counter(r for r, _ in large) == Counter({i: len(SPLIT.findall(t or "")) for i, t in enumerate(texts) if SPLIT.findall(t or "")})
    by_word = {}
    for (_, h), w in zip(large, [w for t in texts for w in SPLIT.findall(t or "")], strict=True):
        assert by_word.setdefault(w, h) == h
    assert len(set(by_word.values())) == len(by_word)


def brute_repeats(rows, size):
    first = {}
    split = [(i, SPLIT.findall(t or "")) for i, t in rows]
    for i, ws in split:
        if i is not None:
            for k in range(len(ws) - size + 1):
                w = tuple(ws[k : k + size])
                first[w] = min(first.get(w, i), i)
    out = []
    for i, ws in split:
        gone = set()
        if i is not None:
            for k in range(len(ws) - size + 1):
                if first[tuple(ws[k : k + size])] < i:
                    gone.update(range(k, k + size))
        out.append((i, len(ws), len(gone), " ".join(w for k, w in enumerate(ws) if k not in gone)))
    return sorted(out, key=str)


def test_substring_dedup(spark, monkeypatch):
    rng = random.Random(5)
    common = prose(rng, 60)
    texts = [None, "", "short text", common, "\n  " + common.replace(" ", "  ") + " tail"]
    for _ in range(60):
        at = rng.randrange(3)
        texts.append(" ".join([prose(rng, 30), common if at else common[:200], prose(rng, 20), common[100:300] if at == 2 else ""]))
    texts.append(prose(rng, 30_000) + " " + common)
    ids = [*range(len(texts) - 4), 7, 7, None, 10_000_000]
    rows = list(zip(ids, texts, strict=True))
    frame = docs(spark, texts, ids).withColumnRenamed("lang", "kept").withColumnRenamed("source", "range")
    for limit in (2000, 4 << 20):
        monkeypatch.setattr(substrings, "GROUP_BYTES", limit)
        got = substrings.remove_repeats(frame).collect()
        assert sorted(((r.doc_id, r.n_words, r.n_removed, r.kept) for r in got), key=str) == brute_repeats(rows, 13)
        assert all(sum(s["last"] - s["first"] + 1 for s in r.intervals) == r.n_removed for r in got)
    assert substrings.remove_repeats(docs(spark, [])).count() == 0


def test_substring_dedup_groups(spark, monkeypatch):
    rng = random.Random(6)
    common = prose(rng, 40)
    texts = [f"{prose(rng, 30)} {common} {prose(rng, 10)}" for _ in range(300)]
    ids = [*range(100), *((3 << 40) + k for k in range(99)), 1 << 60, *[77] * 60, *[None] * 40]
    frame = docs(spark, texts, ids)
    monkeypatch.setattr(substrings, "GROUP_BYTES", 4000)
    got = substrings.remove_repeats(frame).collect()
    assert sorted(((r.doc_id, r.n_words, r.n_removed, r.kept) for r in got), key=str) == brute_repeats(list(zip(ids, texts, strict=True)), 13)
    held = Counter()
    rows = substrings.in_groups(frame, "doc_id", "text", 4000, 4).collect()
    for r in rows:
        held[r[substrings.GROUP]] += len(r.text) + substrings.ROW_BYTES
    assert len(rows) == 260 and max(held.values()) <= 4 * 4000
    assert len({r[substrings.GROUP] for r in rows if r.doc_id == 77}) > 3


def brute_hits(text, items, window):
    split = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
    ws, hit, found = split(text), set(), set()
    for key, item in items:
        iw = split(item)
        n = min(window, len(iw))
        grams = {tuple(iw[k : k + n]) for k in range(len(iw) - n + 1)} if n else set()
        for k in range(len(ws) - n + 1):
            if tuple(ws[k : k + n]) in grams:
                hit.update(range(k, k + n))
                found.add(str(key))
    return len(ws), len(hit), sorted(found)


@pytest.mark.parametrize("block", [30, 2_000_000])
def test_decontamination(spark, monkeypatch, block):
    rng = random.Random(11)
    items = [(i, prose(rng, n)) for i, n in enumerate((40, 13, 12, 3, 1, 20, 2))]
    items += [(20, items[0][1] + " more words"), (21, None), (22, "?!"), (23, "alpha alpha alpha"), (24, "alpha alpha"), (25, items[3][1])]
    texts = [None, "", "...", items[0][1].upper(), "alpha alpha alpha alpha beta", prose(rng, 20_000)]
    for _ in range(80):
        ws = [prose(rng, rng.randrange(20)), (rng.choice(items)[1] or ""), prose(rng, rng.randrange(300)), (rng.choice(items)[1] or "")]
        cut = ws[3].split()
        texts.append(", ".join([*ws[:3], " ".join(cut[rng.randrange(5) :])]))
    monkeypatch.setattr(decontamination, "BLOCK_WORDS", block)
    bench = spark.createDataFrame(items, "item_id long, text string")
    frame = docs(spark, texts).withColumnRenamed("lang", "items").withColumnRenamed("source", "spans")
    got = {r.doc_id: r for r in decontamination.contamination(frame, bench).collect()}
    for i, t in enumerate(texts):
        n, hit, found = brute_hits(t, items, 13)
        assert (got[i].n_words, got[i].n_hit, got[i]["items"]) == (n, hit, found), t
        assert got[i].contaminated == (hit > 0 and 20 * hit >= n)
        assert sum(s["last"] - s["first"] + 1 for s in got[i].spans) == hit
    none = decontamination.contamination(frame, bench.limit(0))
    assert none.where("n_hit > 0 or contaminated").count() == 0 and none.count() == len(texts)
    assert decontamination.contamination(docs(spark, []), bench).count() == 0


def brute_near(rows, percent=75, size=5):
    sets = []
    for _, t in rows:
        ws = SPLIT.findall(re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
        sets.append({tuple(ws[k : k + size]) for k in range(max(1, len(ws) - size + 1))} if ws else set())
    parent = {i: i for i, _ in rows}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a in range(len(rows)):
        for b in range(a):
            both = len(sets[a] & sets[b])
            if both and 100 * both >= percent * (len(sets[a]) + len(sets[b]) - both):
                x, y = sorted((root(rows[a][0]), root(rows[b][0])))
                parent[y] = x
    return sorted((i, len(s), root(i), root(i) == i) for (i, _), s in zip(rows, sets, strict=True))


def mutated(rng, text, edits):
    ws = text.split()
    for _ in range(edits):
        ws[rng.randrange(len(ws))] = prose(rng, 1)
    return " ".join(ws)


def test_near_duplicates(spark, monkeypatch):
    rng = random.Random(2)
    texts = [None, "", " \n", "one two", "One  TWO", "one two three four five six", "ONE two three four five six", prose(rng, 20_000)]
    for n in (60, 120, 200):
        base = prose(rng, n)
        texts += [base, base.upper(), *(mutated(rng, base, rng.randrange(1, 1 + n // 18)) for _ in range(25))]
        chain = base
        for _ in range(12):
            chain = mutated(rng, chain, n // 40)
            texts.append(chain)
    passage = prose(rng, 90)
    texts += [f"{prose(rng, 40)} {passage} {prose(rng, 40)}" for _ in range(40)]
    order = list(range(len(texts)))
    rng.shuffle(order)
    rows = [(i, texts[k]) for i, k in enumerate(order)]
    frame = docs(spark, [t for _, t in rows]).withColumnRenamed("lang", "minima").withColumnRenamed("source", "kept")
    expected = brute_near(rows)
    for sent in (neardup.SENT_PAIRS, 0):
        monkeypatch.setattr(neardup, "SENT_PAIRS", sent)
        got = sorted((r.doc_id, r.n_shingles, r.component_id, r.kept) for r in neardup.near_duplicates(frame).collect())
        assert got == expected


def test_near_duplicates_edges(spark):
    frame = docs(spark, ["a b c d e f", "a b c d e f", None, "a b c d e f"], [5, 5, None, None])
    got = sorted(((r.doc_id, r.component_id, r.kept) for r in neardup.near_duplicates(frame).collect()), key=str)
    assert got == [(5, 5, True), (5, 5, True), (None, None, True), (None, None, True)]
    assert neardup.near_duplicates(docs(spark, [])).count() == 0


def test_near_duplicates_crowd(spark, monkeypatch):
    rng = random.Random(17)
    base = prose(rng, 200)
    rows = [(i, mutated(rng, base, 5)) for i in range(160)]
    expected = brute_near(rows)
    assert len({c for _, _, c, _ in expected}) > 10
    for odd, every in ((neardup.ODD, neardup.ALL), (16, 32)):
        monkeypatch.setattr(neardup, "ODD", odd)
        monkeypatch.setattr(neardup, "ALL", every)
        assert sorted((r.doc_id, r.n_shingles, r.component_id, r.kept) for r in neardup.near_duplicates(docs(spark, [t for _, t in rows])).collect()) == expected


def test_near_duplicates_crowd_tile(spark):
    """Of a crowd a tile names only the links that join its components, not all pairs."""
    rng = random.Random(17)
    base = prose(rng, 200)
    rows = [(i, mutated(rng, base, 5)) for i in range(120)]
    frame = docs(spark, [t for _, t in rows])
    low = neardup.low_bytes(neardup.signatures(frame).withColumnRenamed("doc_id", "id"))
    made = low.join(neardup.sets_of(frame.selectExpr("doc_id AS id", "text")), "id").withColumn("component", F.col("id")).collect()
    both = [r.asDict() | {"odd": odd} for r in made for odd in (True, False)]
    links = neardup.tile(pa.Table.from_pylist(both), neardup.PERCENT).to_pylist()
    label = {i: i for i, _ in rows}
    for x in links:
        old, new = sorted((label[x["a"]], label[x["b"]]))[::-1]
        label = {i: new if c == old else c for i, c in label.items()}
    assert [label[i] for i, _ in rows] == [c for _, _, c, _ in brute_near(rows)]
    assert len(links) == 120 - len(set(label.values()))


def test_components(spark):
    rng = random.Random(9)
    edges = [(rng.randrange(300), rng.randrange(300)) for _ in range(180)] + [(k, k + 1) for k in range(1000, 1100)] + [(2000, k) for k in range(2001, 2300)] + [(5, 5)]
    parent = {x: x for e in edges for x in e}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in edges:
        x, y = sorted((root(a), root(b)))
        parent[y] = x
    got = {r.id: r.component for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    linked = {x for a, b in edges if a != b for x in (a, b)}
    assert got == {x: root(x) for x in linked}


def test_toxicity(spark):
    rng = random.Random(4)
    bad = ["grobian", "wretchling", "scumbag"]
    texts, labels = [], []
    for i in range(400):
        sentences = [prose(rng, 8) for _ in range(6)]
        toxic = i % 4 == 0
        if toxic:
            sentences[rng.randrange(6)] += f" {rng.choice(bad)}{rng.choice(['', 's', 'ly'])} you"
        texts.append(". ".join(sentences) + ".")
        labels.append((i, 1, int(toxic)))
    texts += [None, "", "...", prose(rng, 20_000)]
    labels += [(None, 1, 1), (3, 1, None), (99_999, 0, 1)]
    frame = docs(spark, texts).withColumnRenamed("lang", "score").withColumnRenamed("source", "offending")
    marks = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    model = toxicity.train(frame, marks)
    got = {r.doc_id: r for r in toxicity.score(frame, model, locate=True).collect()}
    held = {r.doc_id for r in frame.where(toxicity.held_out()).select("doc_id").collect()}
    tested = [i for i in held if i < 400]
    right = sum((got[i].score >= 0.3) == (i % 4 == 0) for i in tested)
    assert right >= 0.95 * len(tested)
    assert all(0 <= r.score <= 1 for r in got.values()) and got[400].score == got[401].score == 0
    found = [got[i].offending[0] for i in tested if i % 4 == 0 and got[i].offending]
    assert len(found) >= 0.9 * sum(i % 4 == 0 for i in tested)
    sample = next(i for i in tested if i % 4 == 0 and got[i].offending)
    span = got[sample].offending[0]
    assert any(b in texts[sample].encode()[span["start"] : span["end"]].decode() for b in bad)
    again = toxicity.train(frame, marks)
    assert np.array_equal(again.weights, model.weights) and again.bias == model.bias
    assert toxicity.score(frame, toxicity.train(frame, marks.limit(0))).where("score > 1e-9").count() == 0


def test_licenses(spark):
    rng = random.Random(8)
    texts = [None, "", "the license", "MIT", prose(rng, 20_000) + " Released under the MIT License. " + prose(rng, 50)]
    for _ in range(60):
        _, body = rng.choice(licenses.TEMPLATES)
        ws = body.split()
        for _ in range(rng.choice([0, 0, 1, 3])):
            ws[rng.randrange(len(ws))] = "license"
        texts.append(f"{prose(rng, rng.randrange(90))}\n{' '.join(ws)}\n{prose(rng, rng.randrange(60))}")
    texts += texts[-2:]
    got = sorted((r.doc_id, r.template, r.license, r.containment, r.first_word) for r in licenses.scan(docs(spark, texts).withColumnRenamed("lang", "words")).collect())
    expected = []
    grams = lambda ws: {tuple(ws[i : i + 3]) for i in range(max(1, len(ws) - 2))}
    for d, t in enumerate(texts):
        ws = licenses.words_of(t or "")
        for k, (name, body) in enumerate(licenses.TEMPLATES):
            wanted, size = grams(licenses.words_of(body)), licenses.class_size(len(licenses.words_of(body)))
            best = max(((len(grams(ws[i : i + 2 * size]) & wanted) / len(wanted), -i) for i in range(0, len(ws), size)), default=(0, 0))
            if best[0] >= 0.75:
                expected.append((d, k, name, best[0], -best[1]))
    assert got == sorted(expected)
    assert licenses.scan(docs(spark, [])).count() == 0 and licenses.scan(docs(spark, texts), []).count() == 0


def test_digest_shapes(spark):
    rows = bpe.digests(docs(spark, [None, "Hello world"])).collect()
    assert {r.doc_id: r.ids_sha256 for r in rows}[0] == hashlib.sha256(b"").hexdigest()
