import random
import re
from collections import Counter, defaultdict

from quillgraph.llm import mixing

SCHEMA = "doc_id long, text string, source string, size int, target string"


def spec_targets(sizes):
    """The stated loop: share by weight, stop at twice the size, share the excess again."""
    order = sorted((s for s in sizes if s is not None)) + ([None] if None in sizes else [])
    w = {s: (5, 2, 1)[i % 3] for i, s in enumerate(order)}
    left, t, open_ = 1.5 * sum(sizes.values()), {}, set(order)
    while open_:
        lam = left / sum(w[s] for s in open_)
        over = {s for s in open_ if lam * w[s] >= 2 * sizes[s]}
        if not over:
            return t | {s: lam * w[s] for s in open_}
        for s in over:
            t[s] = 2.0 * sizes[s]
            left -= t[s]
        open_ -= over
    return t


def rows():
    r = random.Random(4)
    out = []
    for i in range(3000):
        source = r.choice(["a"] * 6 + ["b", "ä", "Z", None, "c", "d"])
        n = r.choice([0, 1, 3, 30, 80, 200])
        out.append((i, " \t".join("w" * r.randint(1, 3) for _ in range(n)) if n else r.choice([None, "", " \n"]), source, 7, "x"))
    return out + [out[5], out[5], (None, "one two", "a", 0, ""), (9001, "lone words here", "only", 1, ""), (9002, "w " * 20_000, "b", 1, ""), (9003, None, "blank", 0, "")]


def test_targets_and_copies(spark, monkeypatch):
    monkeypatch.setattr(mixing, "FAN", 8)
    data = rows()
    got = [x.asDict() for x in mixing.mix(spark.createDataFrame(data, SCHEMA)).collect()]
    size = lambda t: len(re.findall(r"[^\x20\x09-\x0D]+", t or ""))
    sizes, largest = defaultdict(int), defaultdict(int)
    for _, t, s, *_ in data:
        sizes[s] += size(t)
        largest[s] = max(largest[s], size(t))
    want = spec_targets(sizes)
    assert Counter((x["doc_id"], x["source"], x["size"]) for x in got) == Counter((d, s, size(t)) for d, t, s, *_ in data)
    taken = defaultdict(int)
    for x in got:
        assert abs(x["target"] - want[x["source"]]) < 1e-6 and x["source_size"] == sizes[x["source"]]
        assert 0 <= x["copies"] <= 2
        taken[x["source"]] += x["copies"] * x["size"]
    for s in sizes:
        assert abs(taken[s] - want[s]) <= 0.5 * max(largest[s], 1) * (3 if s == data[5][2] else 1) + 1e-6, (s, taken[s], want[s])  # repeated rows settle as one
    assert len({x["copies"] for x in got if x["doc_id"] == data[5][0]}) == 1
    again = [x.asDict() for x in mixing.mix(spark.createDataFrame(data, SCHEMA).repartition(7)).collect()]
    key = lambda x: str((x["doc_id"], x["source"], x["size"], x["copies"]))
    assert sorted(map(key, got)) == sorted(map(key, again))


def test_rounding_keeps_expectations(spark):
    """Over many seeds, each document is rounded up about as often as its fraction says."""
    units = spark.createDataFrame([("a", i, 10 * i + 1, 10 * i + 1, p) for i, p in enumerate([0.2, 0.5, 0.9, 0.4, 0.7])], "source string, doc_id long, size long, words long, p double")
    ups = Counter()
    arrays = units.groupBy().agg(mixing.F.collect_list(mixing.F.struct("doc_id", "size", "words", "p").cast(mixing.UNIT)).alias("u"))
    seeds = arrays.select(*[mixing._fold(mixing.F.col("u"), s).alias(f"s{s}") for s in range(150)]).first()
    total = 0.0
    for f in seeds:
        mass = sum(o.size for o in f.out if o.up) + f.run.words * f.run.p
        total += abs(mass - sum((10 * i + 1) * p for i, p in enumerate([0.2, 0.5, 0.9, 0.4, 0.7])))
        for o in f.out:
            ups[o.doc_id] += o.up
        ups[f.run.doc_id] += f.run.p
    assert total < 1e-6
    for i, p in enumerate([0.2, 0.5, 0.9, 0.4, 0.7]):
        assert abs(ups[i] / 150 - p) < 0.15


def test_empty(spark):
    assert mixing.mix(spark.createDataFrame([], SCHEMA)).collect() == []
