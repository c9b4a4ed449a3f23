import hashlib
import random
import re

import xxhash

from quillgraph.llm import fingerprints as P

SCHEMA = "doc_id long, text string, bucket int, fp string, late string"


def spec(text):
    votes, total = [0] * 64, 0
    for w in re.split(r"[\x20\x09-\x0D]+", (text or "").lower()):
        h = xxhash.xxh64_intdigest(w.encode(), 42)
        total += len(w)
        for b in range(64):
            votes[b] += len(w) * (h >> b & 1)
    return sum(1 << b for b in range(64) if 2 * votes[b] > total)


def rows():
    r = random.Random(8)
    vocab = ["".join(r.choices("abcdefgÄß漢", k=r.randint(1, 6))) for _ in range(80)]
    ids = r.sample(range(-500, 5000), 120)
    out = [(i, " ".join(r.choice(vocab) for _ in range(r.randint(0, 60)))) for i in ids]
    out += [(9000, out[3][1]), (9001, None), (9002, ""), (out[0][0], out[0][1]), (out[1][0], "another"), (7000, "long " * 70_000), (7001, "👩‍👩é one")]
    return out


def expect(data):
    hashed = lambda t: (xxhash.xxh64_intdigest((t or "").encode(), 42) + (1 << 63)) % (1 << 64)  # noqa: E731  signed order
    order = sorted(data, key=lambda x: (x[0] is None, -(x[0] or 0), hashed(x[1])))
    for k, (d, t) in enumerate(order):
        t, n = t or "", order[(k + 1) % len(order)][1] or ""
        h = len(t) // 2
        e = t[: len(t) - h] + n[:h]
        a, b, c = spec(t), spec(e), spec(n)
        yield d, len(t), hashlib.sha256(e.encode()).hexdigest(), f"{a:016x}", f"{b:016x}", 1 - (a ^ b).bit_count() / 64, 1 - (a ^ c).bit_count() / 64, a


def test_against_spec(spark):
    data = rows()
    docs = spark.createDataFrame([(*x, 1, "x", "y") for x in data], SCHEMA).repartition(5)
    got = sorted(tuple(x) for x in P.edited_fingerprints(docs).collect())
    want = list(expect(data))
    near = [sum((w[7] ^ v[7]).bit_count() <= 3 for v in want) - 1 for w in want]
    assert got == sorted((*w[:7], n) for w, n in zip(want, near, strict=True))


def test_null_ids_and_one_row(spark):
    for data in ([(1, "only one")], [(None, "b x y z"), (None, "a q r s")], [(3, "x y"), (None, "null id")]):
        got = [tuple(x)[:7] for x in P.edited_fingerprints(spark.createDataFrame([(*x, 0, "", "") for x in data], SCHEMA)).collect()]
        assert sorted(got, key=str) == sorted((w[:7] for w in expect(data)), key=str)


def test_most_rows_under_one_id(spark):
    r = random.Random(6)
    words = lambda: " ".join("".join(r.choices("abcd", k=4)) for _ in range(5))
    data = [(None, words()) for _ in range(150)] + [(5, words()) for _ in range(150)] + [(i, words()) for i in range(40)] + [(-(1 << 63), words()), ((1 << 63) - 1, words())]
    docs = spark.createDataFrame([(*x, 0, "", "") for x in data], SCHEMA)
    assert sorted((tuple(x)[:7] for x in P.edited_fingerprints(docs).collect()), key=str) == sorted((w[:7] for w in expect(data)), key=str)
    held = [x["count"] for x in P.with_next(docs).groupBy("bucket").count().collect()]
    assert sum(held) == len(data) and max(held) < 80


def test_counts_of_a_dense_group(spark):
    r = random.Random(9)
    center = r.getrandbits(64)
    fps = [center ^ (1 << r.randrange(64)) ^ (1 << r.randrange(64)) for _ in range(300)]
    signed = [x - (1 << 64) if x >> 63 else x for x in fps]
    frame = spark.createDataFrame([(x,) for x in signed], "fp long")
    want = {x: sum(((x ^ y) & ((1 << 64) - 1)).bit_count() <= 3 for y in signed) - 1 for x in set(signed)}
    assert {x.fp: x.n_near for x in P.neighbour_counts(frame).collect()} == want


def test_within_radius(spark):
    r = random.Random(3)
    fps = {r.getrandbits(64) for _ in range(40)}
    for x in list(fps):
        for _ in range(4):
            y = x
            for b in r.sample(range(64), r.randint(1, 5)):
                y ^= 1 << b
            fps.add(y)
    fps = sorted(x - (1 << 64) if x >> 63 else x for x in fps)
    frame = spark.createDataFrame([(x,) for x in fps], "fp long")
    for radius in (0, 1, 3):
        got = sorted(tuple(x) for x in P.within_radius(frame, radius).collect())
        assert got == [(a, b) for i, a in enumerate(fps) for b in fps[i + 1 :] if ((a ^ b) & ((1 << 64) - 1)).bit_count() <= radius]


def test_empty(spark):
    assert P.edited_fingerprints(spark.createDataFrame([], SCHEMA)).collect() == []
    assert P.fingerprint(spark.createDataFrame([], SCHEMA)).collect() == []
