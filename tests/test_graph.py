"""Graph operators on small graphs, against plain Python."""

import random

import pytest
from pyspark.sql import functions as F

from quillgraph.operators import graph as G
from quillgraph.operators import similarity as S


@pytest.fixture(scope="module")
def edges(spark):
    rows = [("a", "b", 1.0), ("b", "c", 0.5), ("c", "a", 0.25), ("a", "c", 0.5), ("c", "c", 1.0), ("d", "a", 1.0), ("b", "e", 0.0)]
    return spark.createDataFrame(rows, "source string, target string, weight double")


def plain_walks(rows, start, most):
    out, todo = [], [(start, ())]
    for _ in range(most):
        todo = [(t, (*w, x)) for s, w in todo for a, t, x in rows if a == s]
        out += todo
    return out


def test_walks(edges):
    rows = [tuple(r) for r in edges.collect()]
    starts = edges.select("source").distinct()
    got = {}
    for r in S.walks(starts, edges, 3).collect():
        got.setdefault((r.source, r.target), []).append((tuple(r.seen), tuple(r.weights)))
    want = {}

    def go(start, at, seen, weights):
        if len(seen) == 3:
            return
        for a, t, x in rows:
            if a == at:
                s, w = (*seen, t), (*weights, x)
                if t != start and t not in seen:
                    want.setdefault((start, t), []).append((s, w))
                go(start, t, s, w)

    for s in "abcd":
        go(s, s, (), ())
    assert {k: sorted(v) for k, v in got.items()} == {k: sorted(v) for k, v in want.items()}


def test_walk_sums_equal_the_listed_walks(spark, edges):
    r = random.Random(4)
    more = [(r.choice("abcdefg"), r.choice("abcdefg"), r.random()) for _ in range(30)]  # cycles, loops and repeated relations
    for frame in (edges, spark.createDataFrame(more, "source string, target string, weight double")):
        starts = frame.select("source").distinct()
        want = {}
        for x in S.walks(starts, frame, 3).collect():
            k = (x.source, x.target, x.length)
            weight = 0.5**x.length
            for w in x.weights:
                weight *= w
            n, total = want.get(k, (0, 0.0))
            want[k] = (n + 1, total + weight)
        got = {(x.source, x.target, x.length): (x.n, x.weight) for x in S.walk_sums(starts, frame, 3).collect()}
        assert got.keys() == want.keys() and all(got[k][0] == want[k][0] and got[k][1] == pytest.approx(want[k][1]) for k in want)


def test_first_walks_against_all_walks(spark):
    r = random.Random(7)
    nodes = [f"n{i}" for i in range(12)]
    rows = list({(r.choice(nodes), r.choice(nodes)): r.random() for _ in range(60)}.items())
    frame = spark.createDataFrame([(a, b, w) for (a, b), w in rows], "source string, target string, weight double")
    wanted = spark.createDataFrame([(a, b) for a in nodes for b in nodes if a != b], "source string, target string")
    listed = {}
    for x in S.walks(frame.select("source").distinct(), frame, 3).collect():
        weight = 0.5**x.length
        for w in x.weights:
            weight *= w
        listed.setdefault((x.source, x.target), []).append((list(x.seen), x.length, weight))
    got = {(x.source, x.target): x for x in S.first_walks(wanted, frame, (3, 2), 5).collect()}
    for k, walks in listed.items():
        for h in (2, 3):
            want = sum(w for _, _, w in sorted(x for x in walks if x[1] <= h)[:5])
            assert got[k][f"s_path_{h}"] == pytest.approx(want)
    assert got.keys() == listed.keys()


def test_path_similarity(spark):
    mentions = spark.createDataFrame([("q", "a", 1), ("q", "x", 2), ("p", "c", 1), ("p", "a", 2)], "paper_id string, entity_id string, seq int")
    edges = spark.createDataFrame([("a", "b", 0.5), ("b", "c", 0.5), ("a", "c", 1.0), ("x", "a", 1.0)], "source string, target string, weight double")
    pairs = spark.createDataFrame([("q", "p"), ("q", "none")], "query_id string, paper_id string")
    got = {r.paper_id: r.s_path for r in S.path_similarity(pairs, mentions, edges, 2).collect()}
    # a-c: 1*.5 + .25*.25; x-c: 1*1*.25; x-a: .5; a-a: none
    assert got == {"p": pytest.approx(0.5 + 0.0625 + 0.25 + 0.5), "none": 0.0}


def test_random_walk(spark, edges):
    m = {}
    for s, t, w in (tuple(r) for r in edges.collect()):
        m.setdefault(s, []).append((t, w))
    p0 = {"a": 0.5, "d": 0.5}
    p = dict(p0)
    for _ in range(20):
        new = {k: 0.15 * v for k, v in p0.items()}
        for s, out in m.items():
            total = max(sum(w for _, w in out), 1e-10)
            for t, w in out:
                new[t] = new.get(t, 0) + 0.85 * p.get(s, 0) * w / total
        p = new
    total = sum(p.values())
    seeds = spark.createDataFrame([("a",), ("d",)], "id string")
    for tolerance in (None, 1e-9):
        got = {r.id: r.score for r in G.random_walk(edges, seeds, 0.15, 20, tolerance).collect()}
        assert sum(got.values()) == pytest.approx(1)
        assert all(got.get(k, 0) == pytest.approx(v / total, abs=1e-3) for k, v in p.items())


def test_reachable_with_cycles(spark, edges):
    got = {}
    for r in G.reachable(edges, spark.createDataFrame([("d",), ("e",), ("a",)], "id string")).collect():
        got.setdefault(r.start, set()).add(r.id)
    assert got == {"d": {"a", "b", "c", "e"}, "a": {"a", "b", "c", "e"}}


def test_linking_and_upserts(spark):
    rows = [(1, "m1", "net", "task", 0.5), (2, "m2", "net", "method", 0.9), (3, "m3", "net", "metric", 0.9), (4, "m4", "graph", "other", 0.1)]
    m = spark.createDataFrame(rows, "seq long, id string, canonical string, entity_type string, weight double")
    got = {r.canonical: (r.id, r.entity_type, r.weight, r.n) for r in G.linked_entities(m).collect()}
    assert got == {"net": ("m1", "method", 0.9, 3), "graph": ("m4", "other", 0.1, 1)}
    assert [r.id for r in G.latest(m, ["canonical"], [F.desc("seq")]).orderBy("id").collect()] == ["m3", "m4"]
    e = spark.createDataFrame([("m1", "m2"), ("m1", "zz"), ("zz", "m1"), ("m4", "m4")], "source string, target string")
    assert sorted(tuple(r) for r in G.known_ends(e, m, m).select("source", "target").collect()) == [("m1", "m2"), ("m4", "m4")]
    assert sorted(tuple(r) for r in G.incident(e).where("node = 'm4'").collect()) == [("m4", "in", "m4"), ("m4", "out", "m4")]


def test_split_is_exact(spark):
    r = random.Random(0)
    for n in (0, 1, 7, 100):
        df = spark.createDataFrame([(str(r.random()),) for _ in range(n)], "id string")
        counts = {x.split: x["count"] for x in G.split(df, 0.7, 0.2, 0.1).groupBy("split").count().collect()}
        assert (counts.get("train", 0), counts.get("val", 0)) == (int(n * 0.7), int(n * 0.2)) and sum(counts.values()) == n
    with pytest.raises(ValueError):
        G.split(df, 0.5, 0.6, 0.1)


def test_entity_similarity_equals_pairwise(spark):
    r = random.Random(1)
    rows = [(p, r.choice(["task", "method"]), r.choice([0.0, 0.5, 1.0]), [r.gauss(0, 1) for _ in range(4)] if r.random() < 0.9 else None) for p in "qabc" for _ in range(5)] + [("a", "task", 1.0, [0.0] * 4)]
    named = spark.createDataFrame([(f"e{i}", *x) for i, x in enumerate(rows)], "entity_id string, paper_id string, entity_type string, weight double, v array<double>")
    profiles = S.type_profiles(named.drop("v"), S.unit_vectors(named.select("entity_id", "v")))
    pairs = spark.createDataFrame([("q", c) for c in "abcz"], "query_id string, paper_id string")
    got = {(x.paper_id, x.entity_type): x.similarity for x in S.type_similarity(pairs, profiles).collect()}
    cos = lambda a, b: sum(x * y for x, y in zip(a, b, strict=True)) / ((sum(x * x for x in a) * sum(x * x for x in b)) ** 0.5 or 1)
    for (c, t), s in got.items():
        qs, cs = ([(w, v) for p, k, w, v in rows if p == x and k == t and v] for x in ("q", c))
        scale = sum(w for w, _ in qs) * sum(w for w, _ in cs)
        assert s == pytest.approx(sum(a * b * cos(x, y) for a, x in qs for b, y in cs) / scale if scale else 0.0)
    assert {x.paper_id: x.s_entity for x in S.entity_similarity(pairs, S.type_similarity(pairs, profiles)).collect()}["z"] == 0.5


def test_walks_are_counted_for_parts_of_the_sources(spark, monkeypatch):
    from pyspark.sql import functions as F

    from quillgraph.operators import similarity as S

    r = spark.createDataFrame([(a, b, 1.0 / (a + b + 1)) for a in range(30) for b in range(30) if (a * 7 + b * 3) % 5 == 0], "source long, target long, weight double")
    whole = S.walk_sums(r.select("source"), r, 3).groupBy("source", "length").agg(F.sum("n").alias("n"), F.count("*").alias("targets"), F.round(F.sum("weight"), 8).alias("weight"))
    made, write = [], S.in_round
    monkeypatch.setattr(S, "in_round", lambda spark, make, label: made.append(label) or write(spark, make, label))
    got = S.walk_counts(r, 3, at_once=1500).withColumn("weight", F.round("weight", 8))
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, whole.collect())) and len(made) > 3
