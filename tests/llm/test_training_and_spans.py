"""Toxicity: noisy-or by hand, held-out labels, bounds of the sample. Decontamination: items without a key, removal of spans."""

import math
import random
import re

import numpy as np
import pyarrow as pa

from trackspark.llm import decontamination, toxicity
from trackspark.llm.words import ALNUM_LOWER, slices

from .conftest import prose

SCHEMA = "doc_id long, text string"
LABELS = "doc_id long, quality int, toxic int"


def labelled(spark, rng, n=200):
    texts = [". ".join(prose(rng, 6) + (" grobian" if i % 3 == 0 and k == i % 4 else "") for k in range(4)) for i in range(n)]
    return spark.createDataFrame(list(enumerate(texts)), SCHEMA), [(i, 1, int(i % 3 == 0)) for i in range(n)], texts


def test_score_is_the_noisy_or_of_sentences(spark):
    rng = random.Random(1)
    frame, marks, texts = labelled(spark, rng)
    model = toxicity.train(frame, spark.createDataFrame(marks, LABELS))
    got = {r.doc_id: r.score for r in toxicity.score(frame, model).collect()}
    for i in (0, 1, 2, 3, 50, 51):
        clean = 1.0
        for sentence in re.split(r"[.!?\n\r]", texts[i]):
            if not re.search(r"[A-Za-z0-9]", sentence):
                continue
            (part,) = slices(pa.array([sentence]), ALNUM_LOWER, toxicity.HEADS)
            z = model.bias + sum(float(model.weights[b]) for b in toxicity.sentences(part).bins.ravel().tolist())
            clean *= 1 - 1 / (1 + math.exp(-z))
        assert abs(got[i] - (1 - clean)) < 1e-6


def test_held_out_labels_change_nothing(spark):
    frame, marks, _ = labelled(spark, random.Random(2))
    held = {r.doc_id for r in frame.where(toxicity.held_out()).collect()}
    assert len(held) > 20
    turned = [(i, q, 1 - t if i in held else t) for i, q, t in marks]
    a, b = (toxicity.train(frame, spark.createDataFrame(m, LABELS)) for m in (marks, turned))
    assert np.array_equal(a.weights, b.weights) and a.bias == b.bias


def test_sample_is_bounded_in_bytes(spark):
    frame, marks, texts = labelled(spark, random.Random(3))
    assert toxicity.within([(1, 0, 50), (2, 0, 60), (3, 1, 500), (4, 0, 40), (5, 1, 1)], 100) == [1, 3]
    twice = marks + [(0, 1, 1), (0, 1, 0)]
    for rows, most in ((marks, 2000), (twice, toxicity.FIT_BYTES)):
        scored = toxicity.score(frame, toxicity.train(frame, spark.createDataFrame(rows, LABELS), most=most))
        assert scored.where("score >= 0 and score <= 1").count() == len(texts)


def bench(spark, rows):
    return spark.createDataFrame(rows, "item_id string, text string")


def test_items_without_a_key(spark):
    words = [f"w{i}" for i in range(40)]
    items = [(None, " ".join(words[:13])), ("b", " ".join(words[5:20])), (None, "alone"), ("c", "alone")]
    frame = spark.createDataFrame([(1, " ".join(words)), (2, "x alone y"), (3, " ".join(words[:13]))], SCHEMA)
    got = {r.doc_id: (r.n_hit, r["items"]) for r in decontamination.contamination(frame, bench(spark, items)).collect()}
    assert got == {1: (20, ["b"]), 2: (1, ["c"]), 3: (13, [])}


def test_spans_beyond_the_limits_are_removed(spark):
    rng = random.Random(9)
    item = [f"q{i}" for i in range(30)]
    short, long = " ".join(item[:13]), " ".join(item)
    pad = prose(rng, 2000)
    texts = [None, "", "nothing here", f"{pad}, {short}; {pad}", f"{pad} {long}! {pad}", f"é {long.upper()} ü", f"{long} {short}", f"{pad} {short} mid {long} {pad}"]
    frame = spark.createDataFrame(list(enumerate(texts)), SCHEMA).selectExpr("*", "'old' AS cleaned")
    found = decontamination.contamination(frame, bench(spark, [("a", long)]))
    got = {r.doc_id: (r.cleaned, r.n_removed) for r in decontamination.remove_spans(found).collect()}
    assert [got[i] for i in (0, 1, 2, 3)] == [(t, 0) for t in texts[:4]]
    assert got[4] == (f"{pad}  ! {pad}", 30) and got[5] == ("é   ü", 30) and got[6] == (" ", 43)
    assert got[7] == (f"{pad} {short} mid   {pad}", 30)
    again = decontamination.contamination(spark.createDataFrame([(i, c) for i, (c, _) in got.items()], SCHEMA), bench(spark, [("a", long)]))
    assert {r.doc_id for r in again.where("contaminated").collect()} == set()
