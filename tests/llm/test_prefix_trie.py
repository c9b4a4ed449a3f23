import hashlib
import random
import zlib

import pytest

from quillgraph.llm import prefix_trie

SCHEMA = "conv_id long, turn long, role string, text string"


def plain(rows, period=5, most=9):
    """The trie, turn by turn."""
    own = {}
    for c, t, r, x in rows:
        if c is not None:
            own.setdefault(c, []).append(((t is not None, t or 0), (r or "").encode(), (x or "").encode()))
    own = {c: [(r, x) for _, r, x in sorted(ts)] for c, ts in own.items()}
    full = {}
    for c, ts in own.items():
        h = zlib.crc32(str(c).encode()) % most
        full[c] = own.get(c - c % period, [])[:h] + ts[h:]
    members = {}
    for c, ts in full.items():
        for d in range(len(ts) + 1):
            members.setdefault(tuple(ts[:d]), []).append(c)
    children = {}
    for k in members:
        if k:
            children.setdefault(k[:-1], []).append(k)
    out = []
    for k, cs in members.items():
        below = [n for n in members if n[: len(k)] == k]
        ends = ",".join(str(c) for c in sorted(cs) if len(full[c]) == len(k))
        out.append((
            min(cs), len(k), min(members[k[:-1]]) if k else None, len(cs), len(children.get(k, [])), sum(n not in children for n in below),
            sum((len(members[n]) - 1) * len(n[-1][1]) for n in below if n), hashlib.sha256(ends.encode()).hexdigest(),
        ))
    return sorted(out, key=str)


def check(spark, rows):
    got = sorted((tuple(r) for r in prefix_trie.conversation_trie(spark.createDataFrame(rows, SCHEMA)).collect()), key=str)
    assert got == plain(rows)


def test_random_conversations(spark):
    r = random.Random(5)
    rows = []
    for c in [*range(40), 1000, 1003, 77_777]:
        n = r.choice([1, 2, 3, 5, 8, 9, 12, 17, 33])
        rows += [(c, t, r.choice(["user", "assistant"]), r.choice(["a", "b", "é漢"])) for t in range(n)]
    r.shuffle(rows)
    check(spark, rows)


def test_one_long_conversation_and_many_copies(spark):
    copies = [(c, t, "user", "same") for c in range(0, 150) for t in range(9)]
    check(spark, copies + [(5000, t, "user" if t % 2 else "assistant", str(t % 3)) for t in range(130)])


def test_nulls_ties_and_clashing_columns(spark):
    rows = [(None, 0, "user", "x"), (0, None, None, None), (0, 0, "user", ""), (0, 0, "user", ""), (0, 0, "assistant", "z"), (2, 7, None, "t"), (2, None, "", "t"), (3, 1, "ab", "c"), (3, 1, "a", "bc"), (10**12, 0, "a", None)]
    check(spark, rows)
    df = spark.createDataFrame([(*x, 1, 2, 3) for x in rows], SCHEMA + ", name long, node long, key long")
    assert sorted((tuple(r) for r in prefix_trie.conversation_trie(df).collect()), key=str) == plain(rows)


def test_turnless_conversations_end_at_the_root(spark):
    # no base and fewer turns than it would share: nothing is left
    c = next(c for c in range(1, 100) if c % 5 and zlib.crc32(str(c).encode()) % 9 > 3)
    rows = [(c, 0, "user", "a"), (c, 1, "assistant", "b")]
    got = prefix_trie.conversation_trie(spark.createDataFrame(rows, SCHEMA)).collect()
    assert [(r.conv_id, r.depth, r.n_convs, r.n_leaves, r.ends_sha256) for r in got] == [(c, 0, 1, 1, hashlib.sha256(str(c).encode()).hexdigest())]
    check(spark, rows)


def test_no_conversations(spark):
    assert prefix_trie.conversation_trie(spark.createDataFrame([], SCHEMA)).collect() == []
    assert prefix_trie.conversation_trie(spark.createDataFrame([(None, 1, "a", "b")], SCHEMA)).collect() == []


def test_digests_of_many_conversations_at_one_node(spark, monkeypatch):
    monkeypatch.setattr(prefix_trie, "BLOCK_BITS", 3)
    ends = spark.createDataFrame([(n, c) for n in (1, 2, 9) for c in range(n * 1000, 0, -3)], "node long, conv_id long")
    got = {r.node: r.ends_sha256 for r in prefix_trie.id_digests(ends).collect()}
    assert got == {n: hashlib.sha256(",".join(map(str, sorted(range(n * 1000, 0, -3)))).encode()).hexdigest() for n in (1, 2, 9)}


@pytest.mark.parametrize("n", [0, 1, 7, 1000])
def test_dense_names_have_no_gaps(spark, n):
    assert sorted(r.k for r in prefix_trie.dense(spark.range(n).repartition(5), "k", "t").collect()) == list(range(n))
