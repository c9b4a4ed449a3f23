"""Near-duplicate removal against brute-force Jaccard similarity of whole sets of five-word shingles."""

import random

import numpy as np

from quillgraph.llm import simhash_dedup as S
from quillgraph.llm.common import contracted

DOCS = "doc_id long, text string"


def shingle_set(text, k=5):
    words = (text or "").lower().split()
    return {tuple(words[i : i + k]) for i in range(max(len(words) - k + 1, 1))} if words else set()


def jaccard(a, b):
    return len(a & b) / len(a | b) if a | b else 1.0


def edited_pairs(n, r):
    """Pairs of texts around similarity 0.8, by one or more words replaced apart from each other."""
    vocab = ["".join(r.choices("abcdefghijklmnop", k=r.randint(3, 8))) for _ in range(2000)]
    rows = []
    for i in range(n):
        base = [r.choice(vocab) for _ in range(r.choice([60, 120, 400]))]
        copy = list(base)
        for at in range(2, len(base), r.choice([30, 40, 50, 60])):
            copy[at] = "changed"
        rows += [(2 * i, " ".join(base)), (2 * i + 1, " ".join(copy))]
    return rows


def kept(spark, rows):
    return {x.doc_id for x in S.drop_near_duplicates(spark.createDataFrame(rows, DOCS)).collect()}


def test_recall_and_precision_at_the_threshold(spark):
    rows = edited_pairs(900, random.Random(8))
    sets = [shingle_set(t) for _, t in rows]
    stay = kept(spark, rows)
    true = {d for d in range(1, len(rows), 2) if jaccard(sets[d - 1], sets[d]) >= 0.8}
    border = {d for d in true if jaccard(sets[d - 1], sets[d]) < 0.85}
    gone = {d for d, _ in rows} - stay
    recall, at_border, precision = len(gone & true) / len(true), len(gone & border) / len(border), len(gone & true) / len(gone)
    print(f"pairs {len(true)} recall {recall:.4f}; 0.80-0.85 {len(border)} recall {at_border:.4f}; precision {precision:.4f}")
    assert 200 < len(true) < 800 and len(border) > 50
    assert recall >= 0.985 and at_border >= 0.97 and precision == 1.0


def test_tables_keep_recall_as_keys_grow():
    rows = edited_pairs(400, random.Random(15))
    sets = [shingle_set(t) for _, t in rows]
    true = [k for k in range(0, len(rows), 2) if 0.8 <= jaccard(sets[k], sets[k + 1]) < 0.85]
    bits = np.frombuffer(b"".join(S.signature(S.shingles(t)).tobytes() for _, t in rows), np.uint8).reshape(len(rows), -1)[:, : S.TABLES * 2]
    sizes = []
    for count in (1000, 1 << 26, 1 << 34):
        tables = S.tables_for(count)
        sizes.append((len(tables), len(tables[0])))
        keys = S.table_keys(bits, tables)
        met = [(keys[k] == keys[k + 1]).any() for k in true]
        assert len(true) > 60 and sum(met) >= 0.97 * len(true), sizes
    assert sizes[0] == (64, 16) and sizes[1][1] == 18 and sizes[2][1] == 26 and sizes[2][0] < 600


def test_equal_simhash_bits_are_not_enough(spark):
    # one shingle repeated outvotes the rest of the text, but the sets share one shingle of many
    r = random.Random(3)
    one = lambda: "spam " * 400 + " ".join(f"w{r.randrange(10**6)}" for _ in range(40))
    assert kept(spark, [(i, one()) for i in range(6)]) == set(range(6))


def copies_of(r, base, n, changes):
    out = []
    for _ in range(n):
        w = list(base)
        for _ in range(changes):
            w[r.randrange(len(w))] = f"x{r.randrange(10**6)}"
        out.append(w)
    return out


def test_groups_against_brute_force_in_small_blocks(spark, monkeypatch):
    monkeypatch.setattr(S, "BLOCK", 8)
    monkeypatch.setattr(S, "SET_BLOCK", 4)
    r = random.Random(4)
    texts = []
    for _ in range(25):
        base = [f"w{r.randrange(10**6)}" for _ in range(r.randint(40, 200))]
        texts += [" ".join(w) for w in copies_of(r, base, r.choice([1, 3, 30]), r.choice([0, 1, 2]))]
    sets = [shingle_set(t) for t in texts]
    want = list(range(len(sets)))
    for i in range(len(sets)):
        for j in range(i):
            if want[i] != want[j] and jaccard(sets[i], sets[j]) >= 0.8:
                a, b = sorted((want[i], want[j]))
                want = [a if x == b else x for x in want]
    stay = kept(spark, list(enumerate(texts)))
    assert len(stay ^ set(want)) <= 0.02 * len(set(want))
    assert stay >= set(want)


def test_links_grow_with_the_group_not_its_square(spark):
    r = random.Random(6)
    base = [f"w{r.randrange(10**6)}" for _ in range(150)]
    edges = []
    for n in (100, 400):
        texts = [" ".join(w) for w in copies_of(r, base, n, 2)]
        rows = [(i, S.signature(S.shingles(t)).tobytes()) for i, t in enumerate(texts)]
        nodes = spark.createDataFrame(rows, "node long, bits binary")
        edges.append(contracted(S.candidate_links(nodes), "test").count())
    assert edges[1] < 5 * edges[0] and edges[1] < 2 * 400
