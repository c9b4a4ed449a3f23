"""Secret scans: stated patterns, and a battery of randomness tests under false-discovery control.

Patterns give the base spans: assignments to telling names, access keys and long runs of hex digits. Beside them every
token of TOKEN characters or more is a candidate. Its encoding is inferred (digits, hex, letters, base 32, 36, 62 or
64), and a battery of three tests is taken in that alphabet:

- chi-squared uniformity of the symbol counts,
- runs above and below the middle of the symbols' scores,
- lag-1 serial correlation of the scores.

Each test is read twice. As a gate, by its distribution under randomness: a token that one of them rejects beyond Z
deviations is no candidate for a secret. As evidence, by its distribution in ordinary text, whose moments come from the
pairs of neighbouring symbols in all of the corpus's own words: how far beyond ordinary text it looks random. Symbol
scores are fitted per encoding, so that the serial correlation of ordinary text is farthest from zero. The three
deviations are combined by their mean, which is standardised by the means over the corpus's own words of WORD symbols or
more: the tests depend on each other, and words differ more than their pairs of symbols tell. Within bands of length,
Benjamini-Hochberg over all candidates of the corpus sets the evidence (-ln p) that a token needs, so that at
most `rate` of the tokens found are expected to be ordinary. It works on counts of candidates by band and rounded
evidence, at most BANDS x STEPS rows whatever the corpus.

Digits alone tell nothing where the corpus's own numbers are even; 16 of them are hex digits and found by that pattern.

Everything is DataFrame functions. Defined results: a null text counts as empty and has no spans (redaction leaves it
null); repeated rows each get their own row and each count as candidates; an empty table gives an empty result; other
columns are ignored by `scan` and kept by `redact`.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import before_each, free_name, let, materialize, shuffle_partitions

# The base patterns, their least lengths and the order of kinds
ASSIGN = r"""(?i:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]+"
HEX = r"[0-9a-f]+"
KINDS = ("assign", "access", "hex", "random")
LEAST = (12, 18, 16)

TOKEN = 20  # least length of a candidate
BAND_EDGES = (32, 48, 96)  # lengths at which a new band begins
STEP, STEPS = 0.25, 400  # evidence (-ln p) is counted in steps of so much, up to so many
Z = 3.29  # a test rejects randomness beyond so many deviations
PRIOR = 200  # evenly spread pairs of symbols added to the corpus's, so that few words give little evidence
WORD = 12  # least length of the words by which the combination is standardised
SHRINK = 100  # words of mean deviation 0 and variance 1 added to them
CENTRE = 0.25  # how far their mean deviation may lie from 0
SPAN = "array<struct<start:int,end:int>>"

DIGITS, LOWER, UPPER = "0123456789", "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
#: Encodings, the smaller before the larger: what holds a token, and its symbols in order
ENCODINGS = [
    (r"^[0-9]*$", DIGITS),
    (r"^[0-9a-f]*$", DIGITS + "abcdef"),
    (r"^[0-9A-F]*$", DIGITS + "ABCDEF"),
    (r"^[a-z]*$", LOWER),
    (r"^[A-Z]*$", UPPER),
    (r"^[A-Z2-7]*$", UPPER + "234567"),
    (r"^[0-9a-z]*$", DIGITS + LOWER),
    (r"^[0-9A-Z]*$", DIGITS + UPPER),
    (r"^[0-9A-Za-z]*$", DIGITS + UPPER + LOWER),
    (r"^[0-9A-Za-z_-]*$", DIGITS + UPPER + LOWER + "-_"),
    (r"^.*$", DIGITS + UPPER + LOWER + "+/-_"),
]


def _placed(text: Column, pattern: str, least: int, group: int) -> Column:
    """Spans of the leftmost non-overlapping matches of pattern whose group has the least length.

    What split leaves are the gaps between the matches; the sums of lengths in code points are the positions.
    """
    lengths = lambda parts: F.transform(parts, F.length)
    all_ = lambda k: lengths(F.regexp_extract_all(text, F.lit(pattern), F.lit(k)))
    sized = F.arrays_zip(lengths(F.split(text, pattern)).alias("gap"), all_(0).alias("size"), all_(group).alias("value"))

    def spans(told: Column) -> Column:
        at = before_each(F.transform(told, lambda x: x["gap"] + x["size"]), "int", lambda a, b: a + b, F.lit(0))
        found = F.zip_with(at, told, lambda at, x: F.struct((at + x["gap"]).alias("start"), (at + x["gap"] + x["size"]).alias("end"), x["value"].alias("value")))
        return F.transform(F.filter(found, lambda s: s["value"] >= least), lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end")))

    # the last gap has no match behind it
    return F.when(text.rlike(pattern), let(F.filter(sized, lambda x: x["size"].isNotNull()), spans)).otherwise(F.array().cast(SPAN))


def _encoding(token: Column) -> Column:
    """The number of the smallest encoding that holds the token."""
    found = F.lit(len(ENCODINGS) - 1)
    for k, (pattern, _) in reversed([*enumerate(ENCODINGS[:-1])]):
        found = F.when(token.rlike(pattern), F.lit(k)).otherwise(found)
    return found


def words_of(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """(w): the corpus's distinct words of 2 symbols to TOKEN, so that none is a candidate itself."""
    words = docs.select(F.explode(F.regexp_extract_all(F.coalesce(F.col(text_col), F.lit("")), F.lit(r"([A-Za-z0-9+/_-]+)"), F.lit(1))).alias("w"))
    return words.where((F.length("w") < TOKEN) & (F.length("w") > 1)).distinct()


def symbol_pairs(words: DataFrame) -> dict[str, int]:
    """How often each pair of neighbouring symbols stands in the words. At most 66 x 66 rows reach the driver."""
    pairs = words.select(F.explode(F.transform(F.sequence(F.lit(1), F.length("w") - 1), lambda i: F.substring(F.col("w"), i, F.lit(2)))).alias("pair"))
    return {r["pair"]: r["count"] for r in pairs.groupBy("pair").count().collect()}


@dataclass
class Ordinary:
    """Moments of the tests in ordinary text, for one encoding of k symbols."""

    scores: list[float]  # of the symbols; mean 0 and variance 1 over the alphabet
    same2: float  # sums of the squares and cubes of the symbols' shares
    same3: float
    turns: float  # how often neighbours lie on either side of the middle: in ordinary text, its variance, and at random
    turns_var: float
    turns_even: float
    turns_even_var: float
    mean: float  # of the product of neighbouring scores, and its variance
    var: float
    centre: float = 0.0  # of the words' mean deviations, and their standard deviation
    spread: float = 1.0


def ordinary(counts: dict[str, int], symbols: str) -> Ordinary:
    """From counts of pairs of neighbouring symbols; where an alphabet has one case, either case counts as that."""
    k, at = len(symbols), {c: i for i, c in enumerate(symbols)}
    for c in symbols:
        at.setdefault(c.swapcase(), at[c])
    p = np.full((k, k), PRIOR / k**2)
    for pair, n in counts.items():
        if len(pair) == 2 and pair[0] in at and pair[1] in at:
            p[at[pair[0]], at[pair[1]]] += n
    p /= p.sum()
    q, centre = (p.sum(0) + p.sum(1)) / 2, np.eye(k) - 1 / k
    value, vector = np.linalg.eigh(centre @ (p + p.T) @ centre / 2)
    x = vector[:, np.abs(value).argmax()] * math.sqrt(k)
    x = x if q @ x >= 0 else -x
    after = p / p.sum(1, keepdims=True)

    def moments(f: np.ndarray) -> tuple[float, float]:
        """Mean of f over pairs; variance a pair of its sum, with neighbouring pairs' covariance."""
        mean = float((p * f).sum())
        follows = (after * f).sum(1)
        return mean, max(float((p * f * f).sum()) - mean**2 + 2 * (float((p * f).sum(0) @ follows) - mean**2), 1e-4)

    high = x > 0
    turn = (high[:, None] != high[None, :]).astype(float)
    share = float(high.mean())
    even = 2 * share * (1 - share)
    turns, turns_var = moments(turn)
    mean, var = moments(np.outer(x, x))
    return Ordinary([float(v) for v in x], float((q**2).sum()), float((q**3).sum()), turns, turns_var, even, even * (1 - even) + 2 * (share * (1 - share) - even**2), mean, var)


def battery(docs: DataFrame, text_col: str = "text") -> list[Ordinary]:
    """The tests' distributions in the corpus's words, by encoding. Two passes over the distinct words; 11 rows of sums
    and a row for each pair of symbols reach the driver."""
    words = materialize(words_of(docs, text_col), "secrets-words")
    counts = symbol_pairs(words)
    tests = [ordinary(counts, symbols) for _, symbols in ENCODINGS]
    long = words.where(F.length("w") >= WORD).repartition(shuffle_partitions(docs.sparkSession)).select(spelled(F.lit(0), F.length("w"), F.col("w")).alias("t"))
    z = long.select("t.abc", _tested(F.col("t"), tests)["z"].alias("z"))
    for row in z.groupBy("abc").agg(F.count(F.lit(1)).alias("n"), F.sum("z").alias("sum"), F.sum(F.col("z") * F.col("z")).alias("squares")).collect():
        o, n = tests[row.abc], row.n + SHRINK
        mean = row["sum"] / n
        # held within what a mean of three tests can have, as some encodings' words are mostly keys themselves
        o.centre = min(max(mean, -CENTRE), CENTRE)
        o.spread = min(max(math.sqrt((row.squares + SHRINK) / n - mean**2), 0.5), 1.0)
    return tests


def spelled(start: Column, size: Column, token: Column) -> Column:
    """struct<start, end, band, chars, n, abc> of a token."""
    band = sum((F.when(size >= e, 1).otherwise(0) for e in BAND_EDGES), F.lit(0))
    chars = F.filter(F.split(token, ""), lambda c: c != "")
    return F.struct(start.alias("start"), (start + size).alias("end"), band.alias("band"), chars.alias("chars"), size.cast("double").alias("n"), _encoding(token).alias("abc"))


def _upper_tail(z: Column) -> Column:
    """P(normal > z), within a few hundredths of itself."""
    far = F.least(F.greatest(F.abs(z), F.lit(1e-6)), F.lit(30.0))
    tail = (1 - F.exp(-1.4 * far)) / (1.135 * math.sqrt(2 * math.pi) * far) * F.exp(-far * far / 2)
    return F.when(z >= 0, tail).otherwise(1 - tail)


def _tested(t: Column, tests: list[Ordinary]) -> Column:
    """struct<z, random>: the mean deviation of a spelled token from ordinary text towards randomness, and whether it
    passes for random."""
    symbols = F.get(F.array(*[F.lit(x) for _, x in ENCODINGS]), t["abc"])
    scores = F.get(F.array(*[F.array(*[F.lit(v) for v in o.scores]) for o in tests]), t["abc"])
    of = lambda name: F.get(F.array(*[F.lit(float(getattr(o, name))) for o in tests]), t["abc"])
    n, k = t["n"], F.length(symbols).cast("double")
    # squares of the symbols' counts, from their runs in sorted order
    squares = F.aggregate(
        F.sort_array(t["chars"]),
        F.struct(F.lit("").alias("last"), F.lit(0.0).alias("run"), F.lit(0.0).alias("sum")),
        lambda a, c: F.struct(
            c.alias("last"), F.when(a["last"] == c, a["run"] + 1).otherwise(1.0).alias("run"), (a["sum"] + F.when(a["last"] == c, 2 * a["run"] + 1).otherwise(1.0)).alias("sum")
        ),
        lambda a: a["sum"],
    )
    zero = F.struct(F.lit(-1).alias("at"), *[F.lit(0.0).alias(x) for x in ("x", "cross", "turns", "order", "steps")])

    def step(a: Column, c: Column) -> Column:
        at = F.instr(symbols, c) - 1
        x, first = F.get(scores, at), a["at"] < 0
        return F.struct(
            at.alias("at"),
            x.alias("x"),
            (a["cross"] + F.when(first, 0.0).otherwise(a["x"] * x)).alias("cross"),
            (a["turns"] + F.when(~first & ((a["x"] > 0) != (x > 0)), 1.0).otherwise(0.0)).alias("turns"),
            # products of neighbours' places in the alphabet, from its middle: sequences like 12345 aren't random either
            (a["order"] + F.when(first, 0.0).otherwise((a["at"] - (k - 1) / 2) * (at - (k - 1) / 2))).alias("order"),
            (a["steps"] + F.when(first, 0.0).otherwise(1.0)).alias("steps"),
        )

    def judge(a: Column) -> Column:
        m, pairs = a["steps"], n * (n - 1) / 2
        met = (squares - n) / 2
        # under randomness
        z_chi = (squares * k / n - n - (k - 1)) / F.sqrt(2 * (k - 1) * (n - 1) / n)
        z_runs = (a["turns"] - m * of("turns_even")) / F.sqrt(m * F.greatest(of("turns_even_var"), F.lit(1e-4)))
        z_serial = a["cross"] / F.sqrt(m)
        z_order = a["order"] / (F.sqrt(m) * (k * k - 1) / 12)
        random = (F.abs(z_chi) <= Z) & (F.abs(z_runs) <= Z) & (F.abs(z_serial) <= Z) & (F.abs(z_order) <= Z)
        # in ordinary text, towards randomness
        two, three = of("same2"), of("same3")
        spread = pairs * (two - two * two) + 2 * pairs * (n - 2) * F.greatest(three - two * two, F.lit(0.0))
        chi = (pairs * two - met - 0.5) / F.sqrt(spread)
        side = F.when(of("turns_even") >= of("turns"), 1.0).otherwise(-1.0)
        runs = (side * (a["turns"] - m * of("turns")) - 0.5) / F.sqrt(m * of("turns_var"))
        side = F.when(of("mean") <= 0, 1.0).otherwise(-1.0)
        serial = side * (a["cross"] - m * of("mean")) / F.sqrt(m * of("var"))
        return F.struct(((chi + runs + serial) / 3).alias("z"), random.alias("random"))

    return F.aggregate(t["chars"], zero, step, judge)


def _evidence(t: Column, tests: list[Ordinary]) -> Column:
    """-ln p that a spelled token is ordinary text, if it passes for random; else 0."""
    of = lambda name: F.get(F.array(*[F.lit(float(getattr(o, name))) for o in tests]), t["abc"])
    centre, spread = of("centre"), of("spread")
    judged = lambda x: F.when(x["random"], -F.log(_upper_tail((x["z"] - centre) / spread))).otherwise(0.0)
    return let(_tested(t, tests), judged)


def find(docs: DataFrame, tests: list[Ordinary], text_col: str = "text", found_col: str = "found") -> DataFrame:
    """docs with a column `found_col`, by the corpus's battery: struct<assign, access, hex: spans, tokens: array<struct<start, end, band, evidence>>>."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    spots = _placed(text, rf"[A-Za-z0-9+/_-]{{{TOKEN},}}", TOKEN, 0)

    def token(s: Column) -> Column:
        size = s["end"] - s["start"]
        return spelled(s["start"], size, F.substring(text, s["start"] + 1, size))

    def judged(t: Column) -> Column:
        return F.struct(t["start"].alias("start"), t["end"].alias("end"), t["band"].alias("band"), _evidence(t, tests).alias("evidence"))

    found = F.struct(
        _placed(text, ASSIGN, LEAST[0], 1).alias("assign"),
        _placed(text, ACCESS, LEAST[1], 0).alias("access"),
        # shorter runs of hex digits can't be part of a longer one
        _placed(text, r"[0-9a-f]{%d,}" % LEAST[2], LEAST[2], 0).alias("hex"),
        F.transform(F.transform(spots, token), judged).alias("tokens"),
    )
    return docs.withColumn(found_col, found)


def thresholds(found: DataFrame, rate: float = 0.05, found_col: str = "found") -> list[float]:
    """Least evidence by band, from what find gives: Benjamini-Hochberg at the rate over each band's candidates."""
    each = found.select(F.explode(f"{found_col}.tokens").alias("t")).select("t.band", F.least(F.floor(F.col("t.evidence") / STEP), F.lit(STEPS)).cast("int").alias("step"))
    counts = each.groupBy("band", "step").count().collect()  # at most bands x steps rows
    out = []
    for band in range(len(BAND_EDGES) + 1):
        own = {r["step"]: r["count"] for r in counts if r["band"] == band}
        total, above, least = sum(own.values()), 0, float("inf")
        for s in sorted(own, reverse=True):
            above += own[s]
            if s > 0 and 2.718281828459045 ** (-s * STEP) <= rate * above / total:
                least = s * STEP
        out.append(least)
    return out


def all_spans(found: Column, least: list[float]) -> Column:
    """array<struct<start, kind, end>> in order: base spans, and random tokens that no base span covers."""

    def of_kind(r: int):
        return lambda s: F.struct(s["start"].alias("start"), F.lit(r).alias("kind"), s["end"].alias("end"))

    base = F.concat(*[F.transform(found[k], of_kind(r)) for r, k in enumerate(KINDS[:3])])
    limit = F.array(*[F.lit(x) for x in least])
    passed = F.filter(found["tokens"], lambda t: t["evidence"] >= F.get(limit, t["band"]))
    new = F.filter(passed, lambda t: ~F.exists(base, lambda b: (b["start"] <= t["start"]) & (t["end"] <= b["end"])))
    return F.array_sort(F.concat(base, F.transform(new, of_kind(3))))


def _listed(spans: Column) -> Column:
    names = F.array(*[F.lit(k) for k in KINDS])
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.get(names, s["kind"]), s["start"], s["end"])), ",")


def scan(docs: DataFrame, rate: float = 0.05, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_assign, n_access, n_hex, n_random, base_sha256, spans) for every row of docs."""
    found = find(docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")), battery(docs, text_col)).select("doc_id", "found")
    found = materialize(found, "secrets-found")
    spans = found.withColumn("all", all_spans(F.col("found"), thresholds(found, rate)))
    count = lambda r: F.size(F.filter("all", lambda s: s["kind"] == r)).cast("long")
    return spans.select(
        "doc_id",
        *[count(r).alias(f"n_{k}") for r, k in enumerate(KINDS)],
        F.sha2(_listed(F.filter("all", lambda s: s["kind"] < 3)), 256).alias("base_sha256"),
        _listed(F.col("all")).alias("spans"),
    )


def redact(docs: DataFrame, rate: float = 0.05, mask: str = "[SECRET]", text_col: str = "text") -> DataFrame:
    """docs, all columns, with each secret in the text replaced by mask; overlapping spans by one."""
    found_col, spans_col = free_name(docs, "_found"), free_name(docs, "_spans")
    found = materialize(find(docs, battery(docs, text_col), text_col, found_col), "secrets-found")
    text = F.coalesce(F.col(text_col), F.lit(""))
    spans = F.transform(all_spans(F.col(found_col), thresholds(found, rate, found_col)), lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end")))
    # what each span, in order, leaves of the text between it and those before it
    seen = before_each(F.transform(F.col(spans_col), lambda s: s["end"]), "int", F.greatest, F.lit(0))
    last = F.coalesce(F.array_max(F.transform(F.col(spans_col), lambda s: s["end"])), F.lit(0))
    piece = lambda s, at: F.when(s["start"] >= at, F.concat(F.substring(text, at + 1, s["start"] - at), F.lit(mask))).otherwise("")
    clean = F.concat(F.array_join(F.zip_with(F.col(spans_col), seen, piece), ""), F.substring(text, last + 1, F.length(text)))
    marked = found.withColumn(spans_col, spans)
    return marked.withColumn(text_col, F.when(F.size(spans_col) > 0, clean).otherwise(F.col(text_col))).select(*docs.columns)
