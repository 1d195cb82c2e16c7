"""Top-k, sharding, chat formatting and the pipeline."""

import itertools
import math
import random
from collections import Counter, defaultdict

import numpy as np
import pytest

from trackspark.llm import chat, sharding, topk

from .conftest import prose


def brute_topk(rows, queries, k):
    good = [(i, [math.floor(1024 * x) for x in v]) for i, v in rows if i is not None and v is not None and all(x is not None and math.isfinite(x) for x in v)]
    out = []
    for q, v in {i: v for i, v in good if i in queries}.items():
        scored = sorted((-sum(a * b for a, b in zip(v, w, strict=False)), i) for i, w in good if i != q)[:k]
        out += [(q, r + 1, i, -s) for r, (s, i) in enumerate(scored)]
    return sorted(out)


@pytest.mark.parametrize("clustered", [True, False])
def test_topk(spark, monkeypatch, clustered):
    rng = np.random.default_rng(6)
    centres = rng.normal(size=(6, 8))
    rows = [(i, [float(x) for x in (centres[i % 6] * 3 if clustered else 0) + rng.normal(size=8) * (0.1 if clustered else 1)]) for i in range(900)]
    rows += [(2000 + i, rows[40][1]) for i in range(300)]
    rows += [(3000, None), (3001, []), (3002, [1.0, None] * 4), (3003, [float("nan")] * 8), (3004, [float("inf")] * 8), (None, rows[0][1]), (3005, [0.0] * 8), (7, rows[7][1])]
    monkeypatch.setattr(topk, "BLOCK", 64)
    monkeypatch.setattr(topk, "ROUNDS", (32, 128, None))
    frame = spark.createDataFrame([(i, v, "x", 1) for i, v in rows], "vec_id long, embedding array<float>, cell string, score int")
    rows = [(r.vec_id, r.embedding) for r in frame.collect()]
    asked = {i for i, _ in rows if i is not None and i % 20 == 0}
    got = topk.top_k(frame, frame.where("vec_id % 20 = 0"), fit_rows=256, pivots=8).collect()
    assert sorted(map(tuple, got)) == brute_topk(rows, asked, 10)
    few = frame.where("vec_id < 4")
    assert sorted(map(tuple, topk.top_k(few, few).collect())) == brute_topk([r for r in rows if r[0] in (0, 1, 2, 3)], {0, 1, 2, 3}, 10)
    assert topk.top_k(frame.limit(0), frame.limit(0)).count() == 0


def test_topk_prunes(spark, monkeypatch):
    """Well separated clusters: later rounds visit a small part of the annuli."""
    rng = np.random.default_rng(1)
    centres = rng.normal(size=(16, 8)) * 4
    frame = spark.createDataFrame([(i, [float(x) for x in centres[i % 16] + rng.normal(size=8) * 0.05]) for i in range(3000)], "vec_id long, embedding array<float>")
    monkeypatch.setattr(topk, "ROUNDS", (64, None))
    index = topk.Index(topk.quantize(frame, "vec_id", "embedding", 1024), 16, 1000)
    asked = topk.quantize(frame.where("vec_id % 100 = 0"), "vec_id", "embedding", 1024).selectExpr("vec_id as query_id", "v")
    best = defaultdict(list)
    for r in index.scan(index.plan(asked.selectExpr("*", "cast(null as double) least"), 0, 10), 10).collect():
        best[r.query_id].append(r.score)
    kth = spark.createDataFrame([(q, float(sorted(s)[-10])) for q, s in best.items()], "query_id long, least double")
    later = index.plan(asked.join(kth, "query_id"), 1, 10).count()
    assert later < 0.5 * asked.count() * len(index.cells)


def test_sharding(spark):
    rng = random.Random(3)
    texts = ["hot"] * 400 + [f"pair {i // 2}" for i in range(200)] + [f"trio {i // 3}" for i in range(150)] + [prose(rng, 5) + str(i) for i in range(440)] + [None] * 5 + [""] * 4
    rows = [(i, t) for i, t in enumerate(texts)] + [(None, "x"), (3, "hot"), (3, "hot")]
    frame = spark.createDataFrame([(i, t, 1, "z") for i, t in rows], "doc_id long, text string, shard int, law string")
    for shards in (1, 7):
        got = sharding.shard(frame, shards).collect()
        assert Counter((r.doc_id, r["size"]) for r in got) == Counter((i, len(t or "") + 16) for i, t in rows)
        sizes = Counter(r.shard for r in got)
        assert max(sizes.values()) - min(sizes.values()) <= 1 and set(sizes) == set(range(shards))
        slots = defaultdict(list)
        for r in got:
            slots[r.shard].append(r.slot)
        assert all(sorted(s) == list(range(len(s))) for s in slots.values())
        text = dict(rows)
        homes = defaultdict(set)
        for r in got:
            if text[r.doc_id] is not None:
                homes[text[r.doc_id]].add(r.shard)
        cut = sum(len(h) > 1 for t, h in homes.items() if t != "hot")
        assert cut <= 3
        assert len(homes["hot"]) <= math.ceil(402 / (len(rows) // shards)) + 2
    assert sharding.shard(frame.limit(0)).count() == 0
    assert sorted(r.shard for r in sharding.shard(frame.limit(3), 40).collect()) == [0, 1, 2]


def legal(roles):
    if roles and roles[0] == "system":
        roles = roles[1:]
        if not roles:
            return False
    return all(r == ("user", "assistant")[i % 2] for i, r in enumerate(roles)) and len(roles) % 2 == 0


def brute_cost(roles):
    """Cheapest repair over all ways to relabel, merge and insert, by trying every output up to a length."""
    if not roles:
        return 0
    best = 10**9
    for targets in itertools.product(range(3), repeat=len(roles)):
        for merges in itertools.product([0, 1], repeat=len(roles)):
            if merges[0] or any(m and targets[i] != targets[i - 1] for i, m in enumerate(merges)):
                continue
            cost = sum(chat.NAME if chat.known(r) is None else chat.RELABEL for t, r in zip(targets, roles, strict=True) if chat.known(r) != chat.ROLES[t]) + chat.MERGE * sum(merges)
            out = [t for t, m in zip(targets, merges, strict=True) if not m]
            if any(t == 0 for t in out[1:]):
                continue
            want, need = (1, 0)
            for t in out[1:] if out[0] == 0 else out:
                if t != want:
                    need += 1
                want = 3 - t
            if want == 2:
                need += 1
            elif out == [0]:
                need += 2
            best = min(best, cost + chat.INSERT * need)
    return best


def parsed(text):
    out = []
    for block in text.split("<|end|>\n")[:-1]:
        role, _, body = block.partition("|>\n")
        out.append((role.removeprefix("<|"), body))
    return out


def test_chat(spark, monkeypatch):
    rng = random.Random(12)
    roles = ["system", "user", "assistant", "tool", None, "User "]
    rows, turns = [], {}
    for c in range(120):
        turns[c] = [(k * 3, rng.choice(roles), rng.choice([None, "", f"t{k}", "same"])) for k in range(rng.randrange(1, 6))]
        rows += [(c, *t, "x", 0) for t in turns[c]]
    frame = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string, rendered string, part int")
    for size, fan in ((64, 64), (3, 2)):
        monkeypatch.setattr(chat, "CHUNK", size)
        monkeypatch.setattr(chat, "FAN", fan)
        got = defaultdict(list)
        for r in chat.format_chats(frame).collect():
            got[r.conv_id].append(r)
        assert set(got) == set(turns)
        for c, parts in got.items():
            parts.sort(key=lambda r: r.part)
            made = parsed("".join(p.rendered for p in parts))
            assert legal([r for r, _ in made]), (turns[c], made)
            assert sum(p.n_turns for p in parts) == len(turns[c])
            assert sum(p.cost for p in parts) == brute_cost([r for _, r, _ in turns[c]])
            source = [x for _, _, x in turns[c] if x]
            assert [x for _, b in made for x in b.split("\n") if x] == source
    assert chat.format_chats(frame.limit(0)).count() == 0


def test_chat_edges(spark):
    rows = [(None, 1, "user", "a"), (None, None, "assistant", "b"), (1, 0, "user", "q"), (1, 0, "user", "q"), (2, 5, "system", "s" * 200_000)]
    got = {r.conv_id: r for r in chat.format_chats(spark.createDataFrame(rows, "conv_id int, turn int, role string, text string")).collect()}
    assert got[None].rendered == "<|user|>\na<|end|>\n<|assistant|>\nb<|end|>\n"
    assert got[1].n_merged == 1 and got[1].n_inserted == 1
    assert [r for r, _ in parsed(got[2].rendered)] in (["system", "user", "assistant"], ["user", "assistant"])


def test_chat_hot(spark):
    rng = random.Random(13)
    turns = {None: [(k % 64, rng.choice(["user", "assistant"]), f"t{k}") for k in range(700)], 1: [(None, "user", "same")] * 500, 2: [(None, rng.choice(["user", None]), f"u{k}") for k in range(300)]}
    rows = [(c, *t) for c, of in turns.items() for t in of]
    rng.shuffle(rows)
    got = defaultdict(list)
    for r in chat.format_chats(spark.createDataFrame(rows, "conv_id int, turn int, role string, text string")).collect():
        got[r.conv_id].append(r)
    for c, of in turns.items():
        parts = sorted(got[c], key=lambda r: r.part)
        assert max(p.n_turns for p in parts) <= chat.CHUNK and sum(p.n_turns for p in parts) == len(of)
        source = [t[1:] for t in sorted(of, key=lambda t: chat._order(*t))]
        leave = chat.through([chat.turn_matrix(r) for r, _ in source], chat.START, None)[-1]
        _, n = chat.repair(source, chat.START, leave)
        assert sum(p.cost for p in parts) == n["cost"] + chat.INSERT * len(chat.END[leave])
        made = parsed("".join(p.rendered for p in parts))
        assert legal([r for r, _ in made])
        assert [x for _, b in made for x in b.split("\n") if x] == [x for _, x in source]


def test_pipeline(spark, tmp_path):
    import corpus_pipeline
    from trackspark.llm.decontamination import contamination

    rng = random.Random(21)
    bad = ["grobian", "wretchling", "scumbag"]
    bench = [(i, prose(rng, 30)) for i in range(3)]
    passage = prose(rng, 60)
    docs, labels = [], []
    for i in range(300):
        text = ". ".join(prose(rng, 9) for _ in range(8))
        if i % 5 == 0:
            text += f" {bad[i % 3]} {bad[(i + 1) % 3]}."
        labels.append((i, 1, int(i % 5 == 0)))
        docs.append((i, text))
    docs += [(1000, docs[1][1]), (1001, docs[1][1] + " end"), (1002, f"{prose(rng, 20)} {passage} {prose(rng, 20)}"), (1003, f"{prose(rng, 20)} {passage} {prose(rng, 20)}"), (1004, bench[0][1]), (1005, None), (1006, "")]
    folder = str(tmp_path)
    frame = spark.createDataFrame([(i, t, "en", "s", None if t is None else len(t), 0.5) for i, t in docs], "doc_id long, text string, lang string, source string, n_chars long, score double")
    frame.write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
    spark.createDataFrame(bench, "item_id long, text string").write.parquet(f"{folder}/benchmark.parquet")
    state, seen = spark.read.parquet(f"{folder}/documents.parquet"), {}
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        out = stage(spark, state, folder)
        if k < 4:
            assert out.schema.simpleString() == state.schema.simpleString()
        out.write.parquet(f"{folder}/{name}")
        state = spark.read.parquet(f"{folder}/{name}")
        seen[name] = {r.doc_id: r for r in state.collect()}
    clean = {i for i in range(300) if i % 5}
    assert clean <= set(seen["toxicity"]) and sum(i in seen["toxicity"] for i in range(0, 300, 5)) <= 2
    assert set(seen["toxicity"]) - set(seen["near_dedup"]) == {1000, 1001}
    cut = seen["substring_dedup"]
    assert passage in cut[1002].text and passage not in cut[1003].text and cut[1003].n_chars == len(cut[1003].text)
    assert all(cut[i].text == seen["near_dedup"][i].text for i in cut if i != 1003)
    assert set(cut) - set(seen["decontamination"]) == {1004}
    assert all(r.score == 0.5 for r in seen["decontamination"].values())
    assert set(seen["bpe"]) == set(seen["decontamination"])
    assert contamination(spark.read.parquet(f"{folder}/decontamination"), spark.read.parquet(f"{folder}/benchmark.parquet")).where("contaminated").count() == 0
    assert sorted(map(tuple, corpus_pipeline.run(spark, folder).collect())) == sorted(map(tuple, state.collect()))
