import hashlib
import math
import random
import re
from collections import Counter

from quillgraph.llm import secrets as S

SCHEMA = "doc_id long, text string, spans string, band int"
PATTERNS = [("assign", r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 12), ("access", r"AKIA[A-Z0-9]+", 0, 18), ("hex", r"[0-9a-f]+", 0, 16)]


def base(text):
    out = [(m.start(), k, m.end()) for k, (_, p, g, n) in enumerate(PATTERNS) for m in re.finditer(p, text or "") if len(m.group(g)) >= n]
    return sorted(out)


def listed(spans):
    return ",".join(f"{S.KINDS[k]}:{a}:{b}" for a, k, b in spans)


def evidence(t, tests):
    """The battery, computed plainly."""
    e = next(i for i, (p, _) in enumerate(S.ENCODINGS) if re.match(p, t))
    abc, o = S.ENCODINGS[e][1], tests[e]
    k, n, m = len(abc), len(t), len(t) - 1
    squares = sum(t.count(c) ** 2 for c in set(t))
    at = [abc.index(c) for c in t]
    x = [o.scores[i] for i in at]
    cross = sum(a * b for a, b in zip(x, x[1:], strict=False))
    turns = sum((a > 0) != (b > 0) for a, b in zip(x, x[1:], strict=False))
    order = sum((a - (k - 1) / 2) * (b - (k - 1) / 2) for a, b in zip(at, at[1:], strict=False))
    gates = [
        (squares * k / n - n - (k - 1)) / math.sqrt(2 * (k - 1) * (n - 1) / n),
        (turns - m * o.turns_even) / math.sqrt(m * max(o.turns_even_var, 1e-4)),
        cross / math.sqrt(m),
        order / math.sqrt(m) / ((k * k - 1) / 12),
    ]
    if max(map(abs, gates)) > S.Z:
        return 0.0
    z = mean_deviation(t, tests)
    return -math.log(max(math.erfc((z - o.centre) / o.spread / math.sqrt(2)) / 2, 1e-300))


def mean_deviation(t, tests):
    e = next(i for i, (p, _) in enumerate(S.ENCODINGS) if re.match(p, t))
    abc, o = S.ENCODINGS[e][1], tests[e]
    n, m = len(t), len(t) - 1
    x = [o.scores[abc.index(c)] for c in t]
    cross = sum(a * b for a, b in zip(x, x[1:], strict=False))
    turns = sum((a > 0) != (b > 0) for a, b in zip(x, x[1:], strict=False))
    met = sum(t.count(c) * (t.count(c) - 1) / 2 for c in set(t))
    pairs, two, three = n * (n - 1) / 2, o.same2, o.same3
    spread = pairs * (two - two**2) + 2 * pairs * (n - 2) * max(three - two**2, 0)
    up, down = 1 if o.turns_even >= o.turns else -1, 1 if o.mean <= 0 else -1
    return ((pairs * two - met - 0.5) / math.sqrt(spread) + (up * (turns - m * o.turns) - 0.5) / math.sqrt(m * o.turns_var) + down * (cross - m * o.mean) / math.sqrt(m * o.var)) / 3


def plain_words(texts):
    return {w for t in texts for w in re.findall(r"[A-Za-z0-9+/_-]+", t or "") if 1 < len(w) < S.TOKEN}


def plain_battery(texts):
    counts = plain_pairs(texts)
    tests = [S.ordinary(counts, a) for _, a in S.ENCODINGS]
    own = [[] for _ in tests]
    for w in plain_words(texts):
        if len(w) >= S.WORD:
            own[next(i for i, (p, _) in enumerate(S.ENCODINGS) if re.match(p, w))].append(mean_deviation(w, tests))
    for o, z in zip(tests, own, strict=True):
        n = len(z) + S.SHRINK
        mean = sum(z) / n
        o.centre = min(max(mean, -S.CENTRE), S.CENTRE)
        o.spread = min(max(math.sqrt((sum(x * x for x in z) + S.SHRINK) / n - mean**2), 0.5), 1.0)
    return tests


def plain_pairs(texts):
    return Counter(w[i : i + 2] for w in plain_words(texts) for i in range(len(w) - 1))


def rows():
    r = random.Random(12)
    alnum = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789"
    bits = ["password: ", "TOKEN='", "api_key=", "apikey =  \"", "secret", ":", "=", "AKIA", "é漢 ", "\n", "the und ", "passwd=", "short", " "]
    out = []
    for i in range(150):
        parts = []
        for _ in range(r.randint(0, 12)):
            parts.append(r.choice(bits))
            if r.random() < 0.5:
                parts.append("".join(r.choices(r.choice([alnum, "0123456789abcdef", alnum[:26] + "0123456789", "etaoin", alnum + "+/"]), k=r.choice([3, 11, 12, 15, 16, 20, 33, 50, 120]))))
        out.append((i, "".join(parts)))
    words = [(1000 + i, " ".join("".join(r.choices(["ein", "ung", "keit", "lich", "sch"], k=8)) for _ in range(20))) for i in range(20)]
    # ordinary text, by which randomness is judged
    syllables = ["ein", "ung", "keit", "lich", "ver", "ander", "tion", "ment", "ar", "os", "mi", "ta", "re", "con", "de"]
    words += [(1100 + i, " ".join("".join(r.choices(syllables, k=r.randint(1, 5))) for _ in range(80))) for i in range(60)]
    edge = [(2000, None), (2001, ""), (2002, "token: password: abcdefghijklmn"), (2003, "a" * 200_000), (2004, "x " * 100_000 + "token=" + "q1" * 30_000), (2005, "deadbeef" * 2), (None, "AKIA" + "Z9" * 8), (1, out[1][1]), (2006, "-" * 500 + "_" * 40)]
    return out + words + edge


def test_against_plain_version(spark):
    data = rows()
    docs = spark.createDataFrame([(*x, "clash", 0) for x in data], SCHEMA).repartition(4)
    got = {}
    for x in S.scan(docs).collect():
        got.setdefault(x.doc_id, []).append(x)
    texts = [t for _, t in data]
    assert S.symbol_pairs(S.words_of(docs)) == plain_pairs(texts)
    tests = S.battery(docs)
    for got_, want_ in zip(tests, plain_battery(texts), strict=True):
        assert abs(got_.centre - want_.centre) < 1e-6 and abs(got_.spread - want_.spread) < 1e-6
    tokens = [(d, m.start(), m.end(), evidence(m.group(), tests)) for d, t in data for m in re.finditer(r"[A-Za-z0-9+/_-]{20,}", t or "")]
    found = S.find(docs, tests).selectExpr("doc_id", "explode(found.tokens) AS t").selectExpr("doc_id", "t.start", "t.end", "t.evidence").collect()
    want = Counter((d, a, b) for d, a, b, _ in tokens)
    assert Counter((x.doc_id, x.start, x.end) for x in found) == want
    plain = {(d, a, b): e for d, a, b, e in tokens}
    most = S.STEP * S.STEPS  # evidence beyond counts as so much
    close = [abs(min(x.evidence, most) - min(plain[x.doc_id, x.start, x.end], most)) <= 0.06 + 0.01 * x.evidence for x in found]
    assert sum(close) >= 0.995 * len(close)  # the tail is an approximation, and gates have edges
    exact = {(x.doc_id, x.start, x.end): x.evidence for x in found}
    band = lambda n: sum(n >= e for e in S.BAND_EDGES)
    least = []
    for k in range(len(S.BAND_EDGES) + 1):
        own = [min(math.floor(x.evidence / S.STEP), S.STEPS) for x in found if band(x.end - x.start) == k]
        ok = [s for s in set(own) if s > 0 and math.exp(-s * S.STEP) <= 0.05 * sum(x >= s for x in own) / len(own)]
        least.append(min(ok, default=math.inf) * S.STEP)
    added = 0
    for d, t in data:
        b = base(t)
        new = {(a, 3, e) for x, a, e, _ in tokens if x == d and exact[d, a, e] >= least[band(e - a)] and not any(s <= a and e <= z for s, _, z in b)}
        row = got[d][0]
        assert (row.n_assign, row.n_access, row.n_hex) == tuple(sum(k == j for _, k, _ in b) for j in range(3)), d
        assert row.base_sha256 == hashlib.sha256(listed(b).encode()).hexdigest()
        assert row.spans == listed(sorted(b + list(new))), d
        added += len(new)
    assert added > 20 and len(got[1]) == 2
    assert not any(x.n_random for d in [*range(1000, 1020), *range(1100, 1160)] for x in got[d])


def test_redaction(spark):
    data = rows()
    docs = spark.createDataFrame([(*x, "keep", 5) for x in data], SCHEMA)
    clean = {x.doc_id: x for x in S.redact(docs).collect()}
    assert all(x.spans == "keep" and x.band == 5 for x in clean.values())
    for d, t in data:
        if t is None:
            assert clean[d].text is None
        elif "[SECRET]" not in clean[d].text:
            assert clean[d].text == t and not base(t)
    assert clean[2005].text == "[SECRET]" and clean[None].text == "[SECRET]"
    assert not any(x.n_assign + x.n_access + x.n_hex for x in S.scan(spark.createDataFrame([(9, "my password=hunter2hunter2 ok " + "0af3" * 5, "", 0)], SCHEMA).transform(S.redact)).collect())


def test_many_spans_in_one_text(spark):
    r = random.Random(2)
    keys = ["".join(r.choices("0123456789abcdef", k=24)) for _ in range(5000)]
    text = " -- ".join(keys)
    docs = spark.createDataFrame([(1, text, "", 0)], SCHEMA)
    row = S.scan(docs).first()
    assert row.n_hex == 5000 and row.spans.split(",")[4321] == f"hex:{4321 * 28}:{4321 * 28 + 24}"
    assert S.redact(docs).first().text == " -- ".join(["[SECRET]"] * 5000)


def test_clashing_names(spark):
    docs = spark.createDataFrame([(1, "token=abcdefgh12345678 x", "a", "b", "c")], "doc_id long, text string, found string, _found string, _spans string")
    assert tuple(S.redact(docs).first()) == (1, "[SECRET] x", "a", "b", "c")
    assert S.scan(docs).first().n_assign == 1


def test_empty(spark):
    none = spark.createDataFrame([], SCHEMA)
    assert S.scan(none).collect() == [] and S.redact(none).collect() == []
