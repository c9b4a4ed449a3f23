import random

import numpy as np
import xxhash

from quillgraph.llm import simhash_dedup as S
from quillgraph.llm.common import connected_components

DOCS = "doc_id long, text string, source int, fp string, count int"  # clashing extra columns


def slow_fingerprint(text, k=4):
    words = [w for w in "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "").replace("\t", " ").replace("\n", " ").split(" ") if w]
    if not words:
        return 0
    shingles = [" ".join(words[i : i + k]) for i in range(len(words) - k + 1)] or [" ".join(words)]
    h = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if sum(x >> b & 1 for x in h) * 2 > len(h))


def brute(rows, radius):
    fps = [slow_fingerprint(t) for _, t in rows]
    comp = list(range(len(rows)))

    def root(i):
        while comp[i] != i:
            i = comp[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            if (fps[i] ^ fps[j]).bit_count() <= radius:
                a, b = root(i), root(j)
                comp[max(a, b)] = min(a, b)
    low = {}
    for i, (d, _) in enumerate(rows):
        low[root(i)] = min(low.get(root(i), d), d)
    return sorted((d, f"{fps[i]:016x}", low[root(i)]) for i, (d, _) in enumerate(rows))


def corpus():
    r = random.Random(5)
    vocab = ["".join(r.choices("abcdefghéß", k=r.randint(2, 7))) for _ in range(300)]
    rows, d = [(1, None), (2, ""), (3, " \n\t"), (4, "One"), (5, "one")], 10
    for _ in range(40):
        base = [r.choice(vocab) for _ in range(r.randint(3, 400))]
        for _ in range(r.choice([1, 1, 3, 8])):
            w = list(base)
            for _ in range(r.choice([0, 0, 1, 2, 5])):
                w[r.randrange(len(w))] = r.choice(vocab)
            rows.append((d, (" ".join(w)).title() if r.random() < 0.2 else "  ".join(w)))
            d += 1
    rows.append(rows[-1])
    rows.append((d, " ".join(r.choice(vocab) for _ in range(90_000))))
    return rows


def test_against_brute_force(spark):
    rows = corpus()
    docs = spark.createDataFrame([(d, t, 1, "x", 2) for d, t in rows], DOCS)
    got = sorted(tuple(x) for x in S.near_duplicate_components(docs).collect())
    assert got == brute(rows, 4)


def test_hot_bucket_is_split(spark, monkeypatch):
    monkeypatch.setattr(S, "BLOCK", 8)
    r = random.Random(1)
    center = r.getrandbits(64)
    fps = {center}
    for _ in range(300):
        x = center
        for b in r.sample(range(64), r.randint(1, 6)):
            x ^= 1 << b
        fps.add(x)
    fps = sorted(fps)
    signed = np.array(fps, np.uint64).view(np.int64).tolist()
    frame = spark.createDataFrame([(x,) for x in signed], "fp long")
    for radius in (4, 7):
        got = dict(tuple(x) for x in connected_components(S.fingerprint_links(frame, radius)).collect())
        lab = list(range(len(fps)))
        for i in range(len(fps)):
            for j in range(i):
                if (fps[i] ^ fps[j]).bit_count() <= radius:
                    lab = [min(lab[i], lab[j]) if x in (lab[i], lab[j]) else x for x in lab]
        groups = {}
        for i, x in enumerate(lab):
            groups.setdefault(x, set()).add(signed[i])
        assert {frozenset(g) for g in groups.values() if len(g) > 1} == {
            frozenset(n for n, c in got.items() if c == k) for k in set(got.values())
        }


def test_null_ids(spark):
    rows = [(None, "a b c d e", 1, "x", 2), (7, "a b c d e", 1, "x", 2), (None, "other words stand here alone", 1, "x", 2)]
    got = sorted(((x.doc_id, x.component_id) for x in S.near_duplicate_components(spark.createDataFrame(rows, DOCS)).collect()), key=str)
    assert got == [(7, 7), (None, 7), (None, None)]


def test_empty(spark):
    assert S.near_duplicate_components(spark.createDataFrame([], DOCS)).collect() == []
