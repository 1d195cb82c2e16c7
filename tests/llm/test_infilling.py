"""Fill-in-the-middle against a plain version on Python strings."""

import hashlib
import random

import pytest

from trackspark.llm import infilling

from .conftest import prose

SCHEMA = "doc_id long, text string, form string, source string, output string"


def plain_version(doc_id, text):
    text = text or ""
    h = hashlib.sha256(f"1:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h1, h2, h3, h4 = (int(h[8 * i : 8 * i + 8], 16) for i in range(4))
    n = len(text)
    lo, hi = sorted((h1 % (n + 1), h2 % (n + 1)))
    if not text or any(m in text for m in ("<P>", "<S>", "<M>")) or h3 % 100 >= 90:
        return n, "plain", None, None, text
    pre, mid, suf = text[:lo], text[lo:hi], text[hi:]
    if h4 % 100 < 20:
        return n, "spm", lo, hi - lo, f"<S>{suf}<P>{pre}<M>{mid}"
    return n, "psm", lo, hi - lo, f"<P>{pre}<S>{suf}<M>{mid}"


def texts():
    rng = random.Random(11)
    letters = list("ab <>PSMé漢🙂\n\x00ß")
    out = [None, "", "<P>", "x<S>y", "<", "<P", "P>", "🙂", "é", "<M", ">", "same text", "same text"]
    out += ["".join(rng.choice(letters) for _ in range(rng.randrange(30))) for _ in range(400)]
    return out + [prose(rng, 30_000), "é漢🙂" * 9000]


@pytest.mark.parametrize("block", [infilling.BLOCK, 7])
def test_equals_plain_version_and_round_trips(spark, block, monkeypatch):
    rows = [(i - 3, t, "f", "s", "o") for i, t in enumerate(texts())] + [(None, "no id", "f", "s", "o"), (5, "id twice", "f", "s", "o")]
    if block < infilling.BLOCK:
        import pyarrow as pa

        monkeypatch.setattr(infilling, "BLOCK", block)
        rows = [r for r in rows if len(r[1] or "") < 1000]
        column = infilling.plain(pa.array([r[1] for r in rows]))
        offsets, data = infilling.buffers(column)
        got = infilling.scatter(data, offsets, infilling.hashes([r[0] for r in rows], "1"), 90, 20)
        back = infilling.gather(*infilling.buffers(infilling.plain(got["output"]))[::-1], infilling.np.array([["plain", "psm", "spm"].index(f) for f in got["form"].to_pylist()]))
        assert back.to_pylist() == [r[1] or "" for r in rows]
        found = list(zip(*(got[c].to_pylist() for c in ("n", "form", "prefix_chars", "middle_chars", "output")), strict=True))
        assert found == [plain_version(r[0], r[1]) for r in rows]
        return
    frame = spark.createDataFrame(rows, SCHEMA)
    got = infilling.restore(infilling.fill_in_middle(frame)).collect()
    want = sorted(((r[0], r[1], *plain_version(r[0], r[1])) for r in rows), key=str)
    assert sorted(((r.doc_id, r.text, r.n, r.form, r.prefix_chars, r.middle_chars, r.output) for r in got), key=str) == want
    assert all(r.restored == (r.text or "") and r.source == "s" for r in got)
    assert {r.form for r in got} == {"plain", "psm", "spm"}


def test_empty_table_and_broken_output(spark):
    assert infilling.restore(infilling.fill_in_middle(spark.createDataFrame([], SCHEMA))).count() == 0
    broken = spark.createDataFrame([(1, "<P>a<M>b", "psm")], "doc_id long, output string, form string")
    with pytest.raises(Exception, match="exactly one <S>"):
        infilling.restore(broken).collect()
