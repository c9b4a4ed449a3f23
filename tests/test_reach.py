"""Reachability of asked pairs against brute force."""

import random

import pytest

from quillgraph.operators.reach import has_path, labels


def plain(edges):
    out = {}
    for a, b in edges:
        out.setdefault(a, set()).add(b)
    reached = {}
    for start in {x for e in edges for x in e}:
        seen, front = set(), set(out.get(start, ()))
        while front:
            seen |= front
            front = {y for x in front for y in out.get(x, ())} - seen
        reached[start] = seen
    return reached


def check(spark, edges, pairs, orders):
    e = spark.createDataFrame(edges, "source string, target string")
    p = spark.createDataFrame(pairs, "source string, target string")
    want = plain(edges)
    got = {(r.source, r.target): r.path for r in has_path(p, e, orders).collect()}
    assert got == {(s, t): t in want.get(s, ()) for s, t in pairs}


@pytest.mark.parametrize("orders", [2])
def test_random_graphs_with_cycles(spark, orders):
    r = random.Random(orders)
    edges = [(f"a{r.randrange(40)}", f"a{r.randrange(40)}") for _ in range(40)] + [(f"c{k}", f"c{(k + 1) % 7}") for k in range(7)] + [("c3", "a1"), ("loop", "loop"), ("c0", "c0")]
    names = sorted({x for e in edges for x in e}) + ["nowhere"]
    check(spark, edges, [(r.choice(names), r.choice(names)) for _ in range(400)] + [(x, x) for x in names], orders)


def test_chains_and_labels_of_a_cycle(spark):
    edges = [(f"n{k:02d}", f"n{k + 1:02d}") for k in range(9)]
    check(spark, edges, [("n00", "n09"), ("n09", "n00"), ("n04", "n05"), ("n05", "n04"), ("n05", "n05")], 1)
    ring = spark.createDataFrame([("a", "b"), ("b", "c"), ("c", "a")], "source string, target string")
    assert len({tuple(r)[1:] for r in labels(ring).collect()}) == 1


def test_nothing_asked_and_no_edges(spark):
    check(spark, [("a", "b")], [], 2)
    none = spark.createDataFrame([], "source string, target string")
    assert [tuple(r) for r in has_path(spark.createDataFrame([("a", "b")], "source string, target string"), none).collect()] == [("a", "b", False)]
