import numpy as np

from quillgraph.llm import embedding_dedup as E

SCHEMA = "vec_id long, embedding array<float>, label int, v string, rep long"


def brute(rows, threshold=0.95):
    ok = [e is not None and len(e) == 24 and all(x is not None and np.isfinite(x) for x in e) and any(e) for _, e in rows]
    m = np.array([e if o else [0] * 24 for (_, e), o in zip(rows, ok, strict=True)], np.float32).astype(np.float64)
    norm = np.sqrt((m * m).sum(1))
    norm[norm == 0] = 1
    near = (m @ m.T) / np.outer(norm, norm) >= threshold
    np.fill_diagonal(near, False)
    comp = np.arange(len(rows))
    for i, j in zip(*np.nonzero(near), strict=True):
        comp[comp == max(comp[i], comp[j])] = min(comp[i], comp[j])
    ids = [r[0] for r in rows]
    return sorted((d, int(near[k].sum()), min(ids[x] for x in np.flatnonzero(comp == comp[k]))) for k, d in enumerate(ids))


def data(n=300, dim=24):
    r = np.random.default_rng(1)
    rows = []
    for _ in range(n):
        base = r.normal(size=dim)
        for _ in range(int(r.choice([1, 1, 2, 6]))):
            rows.append((base + r.normal(size=dim) * r.choice([0, 0.05, 0.2, 0.33])) * r.choice([1, 3, 1e-3]))
    out = [(i, [float(np.float32(x)) for x in v]) for i, v in enumerate(rows)]
    k = len(out)
    return out + [(k + 1, None), (k + 2, [0.0] * dim), (k + 3, [float("nan")] * dim), (k + 4, [None] * dim), (k + 5, [float("inf")] + [1.0] * (dim - 1)), (k + 6, []), (k + 7, [1.0] * 5), (k + 8, [-0.0] * dim), *[(k + 20 + i, out[0][1]) for i in range(40)]]


def test_against_brute_force(spark, monkeypatch):
    rows = data()
    frame = spark.createDataFrame([(*x, 1, "clash", 2) for x in rows], SCHEMA).repartition(3)
    want = brute(rows)
    linked = sum(w[1] for w in want)
    for block in (E.BLOCK, 16):
        monkeypatch.setattr(E, "BLOCK", block)
        got = sorted((x.vec_id, x.n_links, x.component_id) for x in E.near_duplicates(frame).collect())
        assert [g[0] for g in got] == [w[0] for w in want]
        assert all(g[1] <= w[1] for g, w in zip(got, want, strict=True))  # no link below the threshold
        assert sum(g[1] for g in got) >= 0.995 * linked
        assert sum(g == w for g, w in zip(got, want, strict=True)) >= 0.98 * len(want)


def test_more_vectors_take_more_cuts_and_tables_keep_recall():
    plans = [E.plan(n, 64) for n in (10, 10_000, 10**8)]
    assert [p.cuts for p in plans] == sorted(p.cuts for p in plans)
    r = np.random.default_rng(0)
    x = r.normal(size=(3000, 64))
    x /= np.sqrt((x * x).sum(1, keepdims=True))
    y = r.normal(size=x.shape)
    y -= (x * y).sum(1, keepdims=True) * x
    y = 0.95 * x + np.sqrt(1 - 0.95**2) * y / np.sqrt((y * y).sum(1, keepdims=True))
    for p in plans:
        meet = ((p.keys(x) == p.keys(y)) & (np.abs((x - y) @ p.lines[:, : p.tables]) <= p.reach)).any(1)
        count = (np.abs((x - y) @ p.lines) <= E.WINDOW * p.sigma).sum(1) >= p.least
        assert (meet & count).mean() > 0.99, p.cuts


def test_every_length_is_compared(spark):
    r = np.random.default_rng(5)
    rows, want = [], {}
    for k, d in enumerate([1, 2, 5, 24, 24, 24, 300]):
        v = r.normal(size=d) * 10.0 ** (3 * k - 9)
        near, far = v * 3 + np.linalg.norm(v) * 0.05 * r.normal(size=d) / np.sqrt(d), -v
        for i, x in enumerate((v, near, v, far)):
            rows.append((10 * k + i, [float(y) for y in x], 0, "", 0))
            want[10 * k + i] = (0, 10 * k + i) if i == 3 else (2, 10 * k)
    rows.append((99, [1e-30] * 24, 0, "", 0))
    rows.append((100, [1e30] * 24, 0, "", 0))
    want |= {99: (1, 99), 100: (1, 99)}
    frame = spark.createDataFrame(rows, SCHEMA.replace("array<float>", "array<double>"))
    assert {x.vec_id: (x.n_links, x.component_id) for x in E.near_duplicates(frame).collect()} == want


def test_dense_group_in_blocks(spark, monkeypatch):
    # each vector is near most others; what leaves the tasks grows with the group, not with its square
    monkeypatch.setattr(E, "BLOCK", 32)
    r = np.random.default_rng(6)
    base = r.normal(size=24)
    rows = [(i, [float(np.float32(x)) for x in base + 0.18 * r.normal(size=24)]) for i in range(300)]
    frame = spark.createDataFrame([(*x, 1, "", 2) for x in rows], SCHEMA)
    got = sorted((x.vec_id, x.n_links, x.component_id) for x in E.near_duplicates(frame).collect())
    want = brute(rows)
    assert sum(w[1] for w in want) > 40_000
    assert sum(g[1] for g in got) >= 0.998 * sum(w[1] for w in want) and all(g[1] <= w[1] and g[2] == w[2] for g, w in zip(got, want, strict=True))
    _, reps = E.distinct_vectors(frame)
    found = E.links(reps, 300, 0.95, 0.998)
    plan = E.plan(300, 24)
    assert found.count() < 300 * plan.tables * 2 * (300 // 32 + 1)


def test_repeated_ids_and_empty(spark):
    rows = [(1, [1.0, 0.0], 0, "", 0), (1, [1.0, 0.0], 0, "", 0), (2, [0.0, 1.0], 0, "", 0), (None, [1.0, 0.01], 0, "", 0)]
    got = sorted(map(str, (tuple(x) for x in E.near_duplicates(spark.createDataFrame(rows, SCHEMA)).collect())))
    assert got == sorted(map(str, [(1, 2, 1, True), (1, 2, 1, True), (2, 0, 2, True), (None, 2, 1, True)]))
    assert E.near_duplicates(spark.createDataFrame([], SCHEMA)).collect() == []
