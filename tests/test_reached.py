"""Numbers of reached nodes against brute force, in small parts and in parts that are searched."""

import random

import pytest
from test_reach import plain

from quillgraph.operators.reach import reached_counts
from quillgraph.queries import ORACLE, QUERIES


@pytest.mark.parametrize(("most", "at_once"), [(1000, 1000), (0, 7), (4, 1000)])
def test_counts(spark, most, at_once):
    r = random.Random(5)
    edges = [(f"a{r.randrange(30)}", f"a{r.randrange(30)}") for _ in range(30)] + [(f"c{k}", f"c{(k + 1) % 7}") for k in range(7)]
    edges += [("x", "y"), ("x", "y"), ("loop", "loop")] + [(f"n{k:02d}", f"n{k + 1:02d}") for k in range(20)]
    want = plain(edges)
    got = [tuple(x) for x in reached_counts(spark.createDataFrame(edges, "source string, target string"), most, at_once).collect()]
    assert sorted(got) == sorted((s, len(want[s])) for s in {a for a, _ in edges})


def test_query_counts_all_reached(spark):
    """Every order that cites another has its row, not only pairs that are asked for."""
    assert "ranked" not in ORACLE["gra08_reachability"]
    assert sorted(QUERIES["gra08_reachability"](spark, "/root/testdata/sf0.001").columns) == ["reached", "start"]
