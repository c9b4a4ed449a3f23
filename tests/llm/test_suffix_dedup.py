import hashlib
import random

import pytest

from quillgraph.llm import suffix_dedup as X

SCHEMA = "doc_id long, text string, doc int, spans string, kept long"


def brute(data):
    low = {}
    late = 1 << 70
    for d, t in data:
        raw = (t or "").encode()
        for p in range(len(raw) - 49):
            s = raw[p : p + 50]
            low[s] = min(low.get(s, late), late if d is None else d)
    for d, t in data:
        raw = (t or "").encode()
        gone = bytearray(len(raw))
        for p in range(len(raw) - 49):
            if low[raw[p : p + 50]] < (late if d is None else d):
                gone[p : p + 50] = b"\1" * 50
        kept = bytes(x for x, g in zip(raw, gone, strict=True) if not g)
        spans = sum(g and not b for g, b in zip(gone, b"\0" + bytes(gone), strict=False))
        yield d, len(raw), sum(gone), spans, hashlib.sha256(kept).hexdigest()


def rows():
    r = random.Random(21)
    words = ["".join(r.choices("abcdeéß", k=r.randint(1, 7))) for _ in range(60)]
    text = lambda n: " ".join(r.choice(words) for _ in range(n))
    passages = [text(14)[:k] for k in (48, 49, 50, 51, 60, 75, 90)] + [text(40) for _ in range(3)]
    out = []
    for i in r.sample(range(1000), 90):
        parts = [text(r.randint(0, 30)) if r.random() < 0.6 else r.choice(passages) for _ in range(r.randint(1, 6))]
        out.append((i, r.choice(["", " "]).join(parts)))
    for i in range(20):  # near and exact copies
        base = out[i][1]
        k = r.randrange(len(base) + 1)
        out.append((2000 + i, base[:k] + r.choice(["", "X", "é"]) + base[k:]))
    out += [(3000, None), (3001, ""), (3002, "x" * 49), (3003, "x" * 400), (3004, "x" * 130), (3005, "ab" * 300), (None, out[0][1]), (None, out[0][1]), (out[2][0], out[2][1]), (out[3][0], out[4][1])]
    return out


@pytest.mark.parametrize("slice_", [X.SLICE, 1, 7])
def test_against_brute_force(spark, monkeypatch, slice_):
    monkeypatch.setattr(X, "SLICE", slice_)
    data = rows()
    docs = spark.createDataFrame([(*x, 1, "clash", 2) for x in data], SCHEMA).repartition(3)
    got = [(x.doc_id, x.n_bytes, x.n_removed, x.n_spans, x.kept_sha256) for x in X.remove_repeats(docs).collect()]
    assert sorted(map(str, got)) == sorted(map(str, brute(data)))


def test_prefix_doubling_against_brute_force(spark):
    data = rows()
    docs = spark.createDataFrame([(*x, 1, "clash", 2) for x in data], SCHEMA).repartition(3)
    got = [(x.doc_id, x.n_bytes, x.n_removed, x.n_spans, x.kept_sha256) for x in X.remove_repeats(docs, find=X.doubled_spans).collect()]
    assert sorted(map(str, got)) == sorted(map(str, brute(data)))
    assert X.remove_repeats(docs.limit(0), find=X.doubled_spans).collect() == []


def test_a_string_that_very_many_documents_share(spark):
    # one rank in thousands of different contexts
    r = random.Random(8)
    common = "the one very common line that stands in every document, word by word"
    data = [(i, "".join(r.choices("abcdefgh ", k=60)) + common + "".join(r.choices("abcdefgh ", k=60))) for i in range(3000)]
    docs = spark.createDataFrame(data, "doc_id long, text string")
    got = sorted((x.doc_id, x.n_removed) for x in X.remove_repeats(docs).collect())
    assert got[0] == (0, 0) and all(n >= len(common) for _, n in got[1:]) and sum(n for _, n in got) < 3000 * (len(common) + 6)


def test_segments_give_the_same_anchors(monkeypatch):
    r = random.Random(3)
    texts = ["".join(r.choices("ab ", k=n)).encode() for n in (0, 49, 50, 51, 300, 1000)]
    whole = [set(zip(*(x.tolist() for x in X._anchor_rows(t)), strict=True)) for t in texts]
    for segment in (1, 70, 128):
        monkeypatch.setattr(X, "SEGMENT", segment)
        assert [set(zip(*(x.tolist() for x in X._anchor_rows(t)), strict=True)) for t in texts] == whole


def test_long_text_and_empty(spark):
    r = random.Random(2)
    long = "".join(r.choices("abcdefgh ", k=3_000_000))
    docs = spark.createDataFrame([(1, long), (2, "q" * 80 + long[1_500_000:2_700_000] + "q" * 80)], "doc_id long, text string")
    got = {x.doc_id: (x.n_removed, x.n_spans) for x in X.remove_repeats(docs).collect()}
    assert got == {1: (0, 0), 2: (1_200_000, 1)}
    assert X.remove_repeats(docs.limit(0)).collect() == []
