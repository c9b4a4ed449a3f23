import itertools
import random
import zlib

import numpy as np

from quillgraph.llm import quality as Q


def brute(s, moves):
    """Marginals, pair marginals and log partition by listing every labelling of one chain."""
    n, total, good, pairs = len(s), 0.0, np.zeros(len(s)), np.zeros((2, 2))
    for y in itertools.product((0, 1), repeat=n):
        v = np.exp(sum(s[i] for i in range(n) if y[i]) + sum(moves[y[i], y[i + 1]] for i in range(n - 1)))
        total += v
        good += v * np.array(y)
        for i in range(n - 1):
            pairs[y[i], y[i + 1]] += v
    return good / total, pairs / total, np.log(total)


def test_forward_backward_against_enumeration():
    r = np.random.default_rng(0)
    length = np.array([1, 4, 7, 2, 4])
    start = np.cumsum(length) - length
    s, moves = r.normal(size=length.sum()) * 3, r.normal(size=(2, 2))
    got, pairs, log_z = Q.forward_backward(s, moves, start, length)
    want = [brute(s[a : a + n], moves) for a, n in zip(start, length, strict=True)]
    assert np.allclose(got, np.concatenate([w[0] for w in want]))
    assert np.allclose(pairs, sum(w[1] for w in want)) and np.isclose(log_z, sum(w[2] for w in want))


def test_scores_against_enumeration_end_to_end(spark):
    """Features, neighbours, standardisation, marginals and weighting, computed line by line and labelling by labelling."""
    rows, labels = corpus(120)
    docs = spark.createDataFrame(rows, "doc_id long, text string, quality string, score int")
    model = Q.train(docs, spark.createDataFrame(labels, "doc_id long, quality int, toxic int"))
    edge = [(900, "one\n\n\n\ntwo words here\n", "", 0), (901, None, "", 0), (902, " \n\n", "", 0), (903, "A. b | c !!", "", 0)]
    some = [r for r in rows if r[1].count("\n") < 7][:40] + edge
    want_scores, want_lines = {}, {}
    for d, text, *_ in some:
        own, times = [], []
        for line in (text or "").split("\n"):
            if not line.strip() and own and not own[-1][0].strip():
                times[-1] += 1
            else:
                own.append((line if line.strip() else "", None))
                times.append(1)
        feats = [[(v - m) / sd for v, m, sd in zip(np.float32(Q.line_features(x)), model.mean, model.scale, strict=True)] for x, _ in own]
        feats = [[max(-3.0, min(3.0, v)) for v in f] for f in feats]
        s = [
            sum(w * v for w, v in zip(model.weights, [1.0, *f, *(feats[k - 1] if k else f), *(feats[k + 1] if k + 1 < len(own) else f)], strict=True))
            for k, f in enumerate(feats)
        ]
        p = brute(s, model.moves)[0]
        size = [len(x) for x, _ in own]
        size = size if sum(size) else [1] * len(size)
        want_scores[d] = sum(a * b for a, b in zip(p, size, strict=True)) / sum(size)
        want_lines[d] = [v for v, t in zip(p, times, strict=True) for _ in range(t)]
    part = spark.createDataFrame(some, docs.schema)
    assert all(abs(x.score - want_scores[x.doc_id]) < 1e-5 for x in Q.scores(part, model).collect())
    got = {}
    for x in sorted(Q.line_labels(part, model).collect(), key=lambda x: (x.doc_id, x.line)):
        got.setdefault(x.doc_id, []).append(x)
    for d, text, *_ in some:
        assert [x.chars for x in got[d]] == [len(x) for x in (text or "").split("\n")]
        assert np.allclose([x.marginal for x in got[d]], want_lines[d], atol=1e-5)
        assert all(x.good == (x.marginal >= 0.5) for x in got[d])


def test_expectations_meet_the_documents_labels():
    r = np.random.default_rng(3)
    length = np.array([5, 1, 9, 30, 4])
    start = np.cumsum(length) - length
    label = np.array([1, 0, 0, 1, 1])
    s, moves = r.normal(size=length.sum()) * 2, np.array([[0.5, -0.5], [-0.3, 0.4]])
    weight = np.concatenate([w / w.sum() for w in (r.random(n) + 0.1 for n in length)])
    p, pairs = Q.expected(s, moves, start, length, weight, label)
    share = np.add.reduceat(p * weight, start)
    assert (share[label == 1] >= Q.GOOD - 1e-2).all() and (share[label == 0] <= Q.BAD + 1e-2).all()
    assert np.isclose(pairs.sum(), (length - 1).sum())
    free = Q.forward_backward(s + 20, moves, start, length)
    p, pairs = Q.expected(s + 20, moves, start, length, weight, np.ones(5, int))
    assert np.allclose(p, free[0]) and np.allclose(pairs, free[1])  # nothing to shift


def test_lines_of_mixed_documents_get_their_own_labels(spark):
    r = random.Random(9)
    good = lambda: " ".join("".join(r.choices("aeiounrst", k=r.randint(2, 8))) for _ in range(r.randint(8, 20))).capitalize() + "."
    bad = lambda: " | ".join("".join(r.choices("aeiounrst", k=4)) for _ in range(12))
    rows, labels, planted = [], [], {}
    for i in range(500):
        y = int(r.random() < 0.6)
        kinds = [int((r.random() < 0.93) == bool(y)) for _ in range(12)]
        if sum(kinds) * 2 < 12:
            y = 0
        planted[i] = kinds
        rows.append((i, "\n".join(good() if k else bad() for k in kinds)))
        labels.append((i, y, 0))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    model = Q.train(docs, spark.createDataFrame(labels, "doc_id long, quality int, toxic int"))
    held = Q.line_labels(docs.where(Q.held_out(docs["doc_id"])), model).collect()
    right = [x.good == bool(planted[x.doc_id][x.line]) for x in held]
    assert len(held) > 800 and sum(right) > 0.97 * len(right)


def test_the_sample_is_bounded_in_lines(spark, monkeypatch):
    rows, labels = corpus(80)
    docs = spark.createDataFrame(rows, "doc_id long, text string, quality string, score int")
    seen = []
    monkeypatch.setattr(Q, "fit", lambda feats, weights, labels: seen.append(sum(map(len, feats))))
    known = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    Q.train(docs, known)
    Q.train(docs, known, max_lines=100)
    Q.train(docs, known, max_train=5)
    assert seen[0] > 300 and 80 < seen[1] <= 100 and seen[2] <= 45


def corpus(n=400):
    r = random.Random(6)
    good = lambda: " ".join("".join(r.choices("aeiounrst", k=r.randint(2, 8))) for _ in range(r.randint(8, 20))).capitalize() + "."
    bad = lambda: r.choice([" | ".join("nav" for _ in range(20)), " ".join("WIN!!" for _ in range(20)), " ".join("spam" for _ in range(30))])
    rows, labels = [], []
    for i in range(n):
        y = int(r.random() < 0.7)
        lines = [good() if (r.random() < 0.9) == bool(y) else bad() for _ in range(r.randint(4, 9))]
        rows.append((i, "\n".join(lines), "label" * y, y))
        labels.append((i, y, 0))
    return rows, labels


def test_held_out_accuracy_and_edge_rows(spark):
    rows, labels = corpus()
    edge = [(900, None, None, None), (901, "", "", 0), (None, "text", "x", 1), rows[3], (902, "\n\n \n", "x", 1), (903, "word " * 50_000, "x", 1), (904, "a\n" * 20_000, "x", 1)]
    docs = spark.createDataFrame(rows + edge, "doc_id long, text string, quality string, score int")
    known = spark.createDataFrame([*labels, (5, None, 0), (None, 1, 1), (7, labels[7][1], 0), (5000, 1, 0)], "doc_id long, quality int, toxic int")
    got = Q.classify(docs, known).collect()
    assert len(got) == len(rows) + len(edge)
    by = {x.doc_id: x for x in got}
    assert all(0 <= x.score <= 1 and x.predicted == int(x.score >= 0.3) for x in got)
    assert all(x.held_out == (zlib.crc32(str(x.doc_id).encode()) % 5 == 0) for x in got if x.doc_id is not None)
    held = [(by[i].predicted, y) for i, y, _ in labels if by[i].held_out]
    assert sum(p == y for p, y in held) / len(held) > 0.95
    kept = Q.keep_good(docs, Q.train(docs, known))
    assert kept.columns == docs.columns
    assert sorted(x.doc_id for x in kept.collect() if x.doc_id is not None) == sorted(x.doc_id for x in got if x.predicted and x.doc_id is not None)


def test_labels_never_reach_the_held_out_fold(spark):
    rows, labels = corpus(60)
    docs = spark.createDataFrame(rows, "doc_id long, text string, quality string, score int")
    flipped = [(i, 1 - y if zlib.crc32(str(i).encode()) % 5 == 0 else y, t) for i, y, t in labels]
    a, b = (sorted((x.doc_id, x.score) for x in Q.classify(docs, spark.createDataFrame(k, "doc_id long, quality int, toxic int")).collect()) for k in (labels, flipped))
    assert a == b


def test_nothing_to_learn(spark):
    docs = spark.createDataFrame([(1, "x")], "doc_id long, text string")
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert Q.classify(docs, none).first().score == 0.5
    assert Q.classify(docs.limit(0), none).collect() == []
