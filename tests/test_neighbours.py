"""Nearest neighbours and the vector index against brute force."""

import numpy as np
import pytest

from quillgraph.operators import neighbours as K
from quillgraph.sources.vector_index import VectorIndex


def table(spark, m, ids=None):
    rows = [(int(i), None if x is None else [float(y) for y in x]) for i, x in zip(range(len(m)) if ids is None else ids, m, strict=True)]
    return spark.createDataFrame(rows, "id long, v array<double>")


def plain(m, k, metric, queries=None):
    m = np.asarray(m, float)
    if metric == "cosine":
        size = np.sqrt((m * m).sum(1))
        scale = size[:, None] * size
        score = np.round(np.divide(m @ m.T, scale, out=np.zeros((len(m), len(m))), where=scale > 0), 6)
        order = -score
    else:
        score = np.round((m * m).sum(1)[:, None] + (m * m).sum(1) - 2 * m @ m.T, 6)
        order = score.copy()
    np.fill_diagonal(order, np.inf)
    out = set()
    for q in range(len(m)) if queries is None else queries:
        for rank, i in enumerate(np.argsort(order[q], kind="stable")[: min(k, len(m) - 1)], 1):
            out.add((q, int(i), rank))
    return out


def clustered(n, dim, groups, seed, spread=0.15):
    r = np.random.default_rng(seed)
    return r.normal(size=(groups, dim))[r.integers(0, groups, n)] + spread * r.normal(size=(n, dim))


def got(df):
    return {(r.query_id, r.id, r["rank"]) for r in df.collect()}


@pytest.mark.parametrize("metric", ["cosine", "l2"])
def test_equals_brute_force(spark, monkeypatch, metric):
    monkeypatch.setattr(K, "BLOCK", 64)
    m = clustered(900, 12, 15, 1)
    assert got(K.nearest(table(spark, m), 7, metric)) == plain(m, 7, metric)
    assert got(K.nearest(table(spark, m), 7, metric, queries=spark.range(0, 900, 50))) == plain(m, 7, metric, range(0, 900, 50))


def test_vectors_go_only_where_neighbours_may_lie(spark, monkeypatch):
    monkeypatch.setattr(K, "BLOCK", 64)
    m = clustered(1500, 12, 25, 2, 0.05)
    rows = table(spark, m)
    centres = K.pivots(rows, 94, "cosine")
    placed = K.assigned(rows, centres, "cosine")
    cells = K.cells_of(placed, centres, "cosine")
    assert cells.n.sum() == 1500 and (cells.first + cells.blocks).max() < 80
    exact = {}
    for q, i, rank in plain(m, 5, "cosine"):
        exact.setdefault(q, []).append(i)
    unit = K.unit(m, "cosine")
    kth = [(q, float(np.round(min(unit[q] @ unit[i] for i in of), 6))) for q, of in exact.items()]
    asking = placed.join(spark.createDataFrame(kth, "id long, kth double"), "id")
    sent = K.sent_to(asking, cells, True).count() + K.sent_to(asking, cells, False).count()
    total = int((cells.first + cells.blocks).max())
    assert sent < 0.3 * 1500 * total, (sent, 1500 * total)


@pytest.mark.parametrize("metric", ["cosine", "l2"])
def test_copies_zeros_nulls_and_few_rows(spark, monkeypatch, metric):
    monkeypatch.setattr(K, "BLOCK", 16)
    m = np.concatenate([np.ones((60, 3)), clustered(40, 3, 4, 3), np.zeros((5, 3)), -np.ones((2, 3))])
    df = table(spark, m).unionByName(table(spark, [None, None], [5000, -3]))
    assert got(K.nearest(df, 6, metric)) == plain(m, 6, metric)
    for few in (np.zeros((0, 2)), np.ones((1, 2)), np.array([[1.0, 0], [0, 2], [0, 0]]), np.zeros((3, 2))):
        assert got(K.nearest(table(spark, few), 4, metric)) == plain(few, 4, metric)


@pytest.mark.parametrize("metric", ["cosine", "l2"])
def test_index_recall_and_exact_search(spark, tmp_path, metric):
    m = clustered(3000, 16, 40, 4, 0.4)
    rows, asked = table(spark, m), range(0, 3000, 50)
    index = VectorIndex.build(rows, str(tmp_path / "index"), metric)
    queries = rows.where("id % 50 = 0")
    want = plain(m, 10, metric, asked)
    pairs = {(q, i) for q, i, _ in want}
    found = {(q, i) for q, i, _ in got(index.search(queries, 10, 8))}
    assert len(found & pairs) >= 0.9 * len(pairs)
    assert got(index.search(queries, 10, 4, exact=True)) == want
    assert got(VectorIndex(spark, index.path).search(queries, 10, 4, exact=True)) == want


def test_only_probed_partitions_are_read(spark, tmp_path):
    m = clustered(2000, 8, 30, 5, 0.05)
    index = VectorIndex.build(table(spark, m), str(tmp_path / "index"), "cosine", cells=30)
    assert index.vectors().count() == 2000
    near = sorted(r.cell for r in index._probed(table(spark, m[:1]), 2).collect())
    assert len(near) == 2
    assert "PartitionFilters: [cell" in index.vectors(near)._jdf.queryExecution().executedPlan().toString()
    want = got(index.search(table(spark, m[:1]), 5, 2))
    for folder in (tmp_path / "index" / "vectors").glob("cell=*"):
        if int(folder.name[5:]) not in near:
            for file in folder.glob("*.parquet"):
                file.write_bytes(b"not a table")
    assert got(VectorIndex(spark, index.path).search(table(spark, m[:1]), 5, 2)) == want


def test_index_grows_and_keeps_zeros(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(K, "BLOCK", 16)
    m = np.concatenate([clustered(300, 6, 5, 6), np.zeros((4, 6)), np.repeat(clustered(1, 6, 1, 7), 80, 0)])
    index = VectorIndex.build(table(spark, m[:200]), str(tmp_path / "index"), "cosine", cells=9)
    index = index.extend(table(spark, m[200:], range(200, len(m))).unionByName(table(spark, [None], [9999])))
    asked = [*range(0, len(m), 50), 301, 303]
    queries = table(spark, m[asked], asked).unionByName(table(spark, [None], [9999]))
    assert got(index.search(queries, 12, 1, exact=True)) == plain(m, 12, "cosine", asked)
    with pytest.raises(ValueError):
        VectorIndex.build(table(spark, np.zeros((0, 2))), str(tmp_path / "none"))


@pytest.mark.parametrize("metric", ["cosine", "l2"])
def test_blocks_are_met_where_little_is_ruled_out(spark, monkeypatch, metric):
    monkeypatch.setattr(K, "BLOCK", 64)
    monkeypatch.setattr(K, "GROUP", 3 * 64 * 8 * 24)
    sent, search = [], K.search_blocks
    monkeypatch.setattr(K, "search_blocks", lambda dealt, *rest: (sent.append(dealt.where("asks").count()), search(dealt, *rest))[1])
    m = np.concatenate([np.random.default_rng(8).normal(size=(900, 24)), np.ones((150, 24)), np.zeros((3, 24))])
    assert got(K.nearest(table(spark, m), 7, metric)) == plain(m, 7, metric)
    assert sum(sent) < 3 * len(m), sent  # to its own cell's blocks alone; without clusters all others were asked before
    assert got(K.nearest(table(spark, m), 7, metric, queries=spark.range(0, len(m), 50))) == plain(m, 7, metric, range(0, len(m), 50))
