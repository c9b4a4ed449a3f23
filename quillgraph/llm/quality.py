"""Quality classifier: a linear-chain conditional random field over the lines of a document.

Each line is good or bad. Its features are shares of character classes, word shapes and repetitions, of the line itself
and of the lines before and after it. Forward-backward gives each line's marginal of being good; a document's score is
their mean, weighted by the lines' lengths.

Only documents have labels, so the lines' labels are latent and the field is fitted by expectation maximisation: the
expectation step takes the lines' marginals under the field, shifted within each document by as little as makes the
length-weighted share of good lines at least GOOD in a document labelled good and at most BAD in one labelled bad
(posterior regularisation); the maximisation step follows the gradient to these expectations. It starts from lines by
themselves, so transitions are learned from where labels change within documents. The sample is bounded: the `max_train`
labelled documents with the smallest hash of their id, and of them, in that order, those that fit into `max_lines` lines
(both bounds are parameters; scoring covers every row). Only the text is ever an input of a score.

Defined results: a null or empty text is one blank line and gets a score like any other; blank lines that follow each
other are one place of the chain, with no weight in the score; without labelled rows of both kinds the score is the
labels' smoothed mean; several labels of one document count by their mean; null labels don't count; repeated rows each
get their own score; an empty table gives an empty result; other columns are kept by `keep_good` and ignored by `scores`
and `line_labels`.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from operator import eq

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import materialize

UPPER, LOWER, DIGIT, SPACE, MARK, PIPE, BANG, ODD, HIGH = range(9)


def _classes() -> bytes:
    table = bytearray([ODD]) * 256
    for span, kind in ((range(65, 91), UPPER), (range(97, 123), LOWER), (range(48, 58), DIGIT), (range(128, 256), HIGH)):
        for b in span:
            table[b] = kind
    for chars, kind in ((b" \t\r\x0b\x0c", SPACE), (b".,;:?'\"()-", MARK), (b"|", PIPE), (b"!", BANG)):
        for b in chars:
            table[b] = kind
    return bytes(table)


CLASSES = _classes()
OWN = 18  # features of a line by itself
GOOD, BAD = 0.85, 0.1  # shares of good lines in documents labelled so, at least and at most


def line_features(line: str) -> list[float]:
    """OWN numbers that describe a line by itself."""
    raw = line.encode("utf-8", "surrogatepass")
    kinds, n = raw.translate(CLASSES), max(len(raw), 1)
    words = line.split()
    m = max(len(words), 1)
    count = [kinds.count(k) / n for k in range(9)]
    letters = len(line) - (kinds.count(SPACE) + kinds.count(MARK) + kinds.count(ODD) + kinds.count(PIPE) + kinds.count(BANG) + kinds.count(DIGIT))
    up = sum(w.isupper() for w in words) / m
    again = sum(map(eq, words, words[1:])) / m
    unique = len(set(words)) / m
    return [
        *count,
        up,
        again,
        unique if len(words) >= 20 else 1.0,
        min(letters / m, 30.0) / 10,
        np.log1p(len(line)) / 5,
        float(len(words) < 6),
        float(up > 0.5),
        float(count[ODD] + count[PIPE] + count[BANG] > 0.04) + float(again > 0.3),
        float(not words),
    ]


def places(text: str | None) -> tuple[list[str], list[int]]:
    """The lines of a text and how many each stands for: blank lines that follow each other are one."""
    lines, count = [], []
    for line in (text or "").split("\n"):
        line = line if line.strip() else ""
        if line or not lines or lines[-1]:
            lines.append(line)
            count.append(1)
        else:
            count[-1] += 1
    return lines, count


def doc_features(text: str | None) -> tuple[np.ndarray, np.ndarray]:
    """(lines, OWN) features and the lines' lengths; a text without words has one place of length 1."""
    lines, _ = places(text)
    length = np.array([len(x) for x in lines], np.float64)
    return np.array([line_features(x) for x in lines], np.float32), length if length.any() else np.ones(len(lines))


def with_neighbours(x: np.ndarray, start: np.ndarray) -> np.ndarray:
    """A constant, each line's features, and those of the lines before and after it in its document."""
    first = np.zeros(len(x), bool)
    first[start] = True
    last = np.r_[first[1:], True] if len(x) else first
    before, after = np.roll(x, 1, 0), np.roll(x, -1, 0)
    before[first], after[last] = x[first], x[last]
    return np.hstack([np.ones((len(x), 1), np.float32), x, before, after])


def standard(x: np.ndarray, mean: np.ndarray, scale: np.ndarray) -> np.ndarray:
    """Standardised features, held within 3 deviations so that a line unlike any seen can't decide alone."""
    return np.clip((x - mean) / scale, -3, 3)


@dataclass
class Model:
    weights: np.ndarray  # of a line's features for good
    moves: np.ndarray  # 2 x 2 log-potentials of neighbouring labels
    mean: np.ndarray
    scale: np.ndarray
    prior: float | None = None  # the score, if nothing could be learned

    def marginals(self, x: np.ndarray, start: np.ndarray, length: np.ndarray) -> np.ndarray:
        if self.prior is not None:
            return np.full(len(x), self.prior)
        return forward_backward(with_neighbours(standard(x, self.mean, self.scale), start) @ self.weights, self.moves, start, length)[0]

    def lines(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Marginals of good and lengths of all lines of the texts, and where each text's lines start."""
        feats = [doc_features(t) for t in texts]
        length = np.array([len(x) for x, _ in feats])
        start = np.cumsum(length) - length
        return self.marginals(np.vstack([x for x, _ in feats]), start, length), np.concatenate([w for _, w in feats]), start

    def scores(self, texts: list[str | None]) -> np.ndarray:
        if not texts:
            return np.zeros(0)
        good, weight, start = self.lines(texts)
        return np.clip(np.add.reduceat(good * weight, start) / np.add.reduceat(weight, start), 0.0, 1.0)


def forward_backward(s: np.ndarray, moves: np.ndarray, start: np.ndarray, length: np.ndarray) -> tuple[np.ndarray, np.ndarray, float]:
    """Marginals of good, summed pair marginals (2 x 2), and the log of the partition function.

    s: each line's log-odds of good. All chains take each step together, the longest first.
    """
    order = np.argsort(-length, kind="stable")
    start, length = start[order], length[order]
    top = np.maximum(s, 0)
    e = np.stack([np.exp(-top), np.exp(s - top)], 1)
    m = np.exp(moves)
    alpha, beta, log_z = np.empty_like(e), np.ones_like(e), float(top.sum())
    active = [int(np.searchsorted(-length, -t, side="left")) for t in range(int(length[0]) + 1 if len(length) else 0)]
    for t in range(len(active) - 1):
        i = start[: active[t]] + t
        a = e[i] if t == 0 else (alpha[i - 1] @ m) * e[i]
        z = a.sum(1, keepdims=True)
        log_z += float(np.log(z).sum())
        alpha[i] = a / z
    pairs = np.zeros((2, 2))
    for t in range(len(active) - 3, -1, -1):
        i = start[: active[t + 1]] + t
        nxt = e[i + 1] * beta[i + 1]
        b = nxt @ m.T
        xi = alpha[i][:, :, None] * m * nxt[:, None, :]
        pairs += (xi / xi.sum((1, 2), keepdims=True)).sum(0)
        beta[i] = b / b.sum(1, keepdims=True)
    p = alpha * beta
    return p[:, 1] / p.sum(1), pairs, log_z


def expected(s: np.ndarray, moves: np.ndarray, start: np.ndarray, length: np.ndarray, weight: np.ndarray, label: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Marginals and summed pair marginals, after the least shift in each document that its label asks for.

    weight: of each line, adding up to 1 in a document. A document's lines are shifted in proportion to their weight; the
    shift is found by bisection, for all documents at once.
    """
    pull = weight / np.repeat(np.maximum.reduceat(weight, start), length)
    sign, most = np.where(label == 1, 1.0, -1.0), np.where(label == 1, GOOD, 1 - BAD)

    def short(shift: np.ndarray) -> np.ndarray:
        p = forward_backward(s + np.repeat(shift * sign, length) * pull, moves, start, length)[0]
        share = np.add.reduceat(p * weight, start)
        return np.where(label == 1, share, 1 - share) < most

    low, high = np.zeros(len(label)), np.where(short(np.zeros(len(label))), 40.0, 0.0)
    for _ in range(14):
        mid = (low + high) / 2
        under = short(mid)
        low, high = np.where(under, mid, low), np.where(under, high, mid)
    return forward_backward(s + np.repeat(high * sign, length) * pull, moves, start, length)[:2]


def fit(feats: list[np.ndarray], weights: list[np.ndarray], labels: list[int], first: int = 120, rounds: int = 5, steps: int = 40, rate: float = 0.05, ridge: float = 1.0) -> Model:
    """A field fitted to documents' features, lines' lengths and labels."""
    if not feats or len(set(labels)) < 2:
        d = 1 + 3 * OWN
        return Model(np.zeros(d), np.zeros((2, 2)), np.zeros(OWN), np.ones(OWN), (1 + sum(labels)) / (2 + len(labels)))
    label, length = np.array(labels), np.array([len(x) for x in feats])
    start = np.cumsum(length) - length
    x = np.vstack(feats).astype(np.float64)
    mean, scale = x.mean(0), x.std(0) + 1e-3
    f = with_neighbours(standard(x, mean, scale), start)
    weight = np.concatenate([w / w.sum() for w in weights])
    theta = np.zeros(f.shape[1] + 4)

    def ascend(theta: np.ndarray, target: np.ndarray, seen: np.ndarray, count: int, free: np.ndarray) -> np.ndarray:
        """Gradient steps of the free weights to the lines' targets and the pairs seen."""
        g1, g2 = np.zeros_like(theta), np.zeros_like(theta)
        for k in range(1, count + 1):
            p, pairs, _ = forward_backward(f @ theta[:-4], theta[-4:].reshape(2, 2), start, length)
            grad = free * (np.r_[f.T @ (target - p), (seen - pairs).ravel()] - ridge * theta) / len(target)
            g1, g2 = 0.9 * g1 + 0.1 * grad, 0.999 * g2 + 0.001 * grad**2
            theta = theta + rate * (g1 / (1 - 0.9**k)) / (np.sqrt(g2 / (1 - 0.999**k)) + 1e-8)
        return theta

    alone = np.r_[np.ones(1 + OWN), np.zeros(len(theta) - 1 - OWN)]  # neither neighbours nor transitions
    theta = ascend(theta, np.repeat(label, length).astype(float), np.zeros((2, 2)), first, alone)
    for _ in range(rounds):
        target, seen = expected(f @ theta[:-4], theta[-4:].reshape(2, 2), start, length, weight, label)
        theta = ascend(theta, target, seen, steps, np.ones_like(theta))
    return Model(theta[:-4], theta[-4:].reshape(2, 2), mean, scale)


def held_out(doc_id: Column) -> Column:
    """Rows that training never sees: crc32 of the id as text, modulo 5, is 0; a null id counts as an empty text."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % 5 == 0


def train(docs: DataFrame, labels: DataFrame, max_train: int = 4000, max_lines: int = 200_000) -> Model:
    """A model from at most max_train labelled documents, of at most max_lines lines, outside the held-out fold."""
    known = labels.where(F.col("quality").isNotNull() & F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id")))
    known = known.groupBy(F.col("doc_id").alias("id")).agg((F.avg("quality") >= 0.5).cast("int").alias("y"))
    present = docs.select(F.col("doc_id").alias("id")).join(known, "id").distinct()
    sample = present.orderBy(F.xxhash64("id"), "id").limit(max_train)

    def features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found = [doc_features(t.as_py()) for t in b.column(2)]
            x, w = ([f[k].astype(np.float32).ravel() for f in found] for k in (0, 1))
            n = pa.array([len(v) for v in w], pa.int64())
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), n, pa.array(x, pa.list_(pa.float32())), pa.array(w, pa.list_(pa.float32()))], ["id", "y", "n", "x", "w"])

    texts = docs.join(F.broadcast(materialize(sample, "quality-sample")), F.col("doc_id") == F.col("id")).select("id", "y", "text")
    made = materialize(texts.mapInArrow(features, "id long, y int, n long, x array<float>, w array<float>"), "quality-features", narrow=True)
    order = Window.orderBy(F.xxhash64("id"), "id", "n", F.hash("x"))  # max_train rows, and their repeats
    place = made.select("*", F.row_number().over(order).alias("k"))
    before = F.sum("n").over(Window.orderBy("k"))
    rows = place.withColumn("sum", before).where((F.col("sum") <= max_lines) & (F.col("k") <= max_train)).orderBy("k").collect()
    return fit([np.array(r.x, np.float32).reshape(-1, OWN) for r in rows], [np.array(r.w, np.float64) for r in rows], [r.y for r in rows])


def scores(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, score) for every row of docs."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for lo in range(0, b.num_rows, 256):
                part = b.slice(lo, 256)
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(model.scores(part.column(1).to_pylist()))], ["doc_id", "score"])

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    return rows.mapInArrow(run, "doc_id long, score double")


def line_labels(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, line, chars, marginal, good) for every line of every row of docs, lines numbered from 0."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for lo in range(0, b.num_rows, 256):
                part = b.slice(lo, 256)
                texts = part.column(1).to_pylist()
                good, _, _ = model.lines(texts)
                times = np.concatenate([places(t)[1] for t in texts])
                chars = [[len(x) for x in (t or "").split("\n")] for t in texts]
                size = np.array([len(c) for c in chars])
                p = np.repeat(good, times)
                line = np.arange(size.sum()) - np.repeat(np.cumsum(size) - size, size)
                ids = part.column(0).take(pa.array(np.repeat(np.arange(len(texts)), size)))
                yield pa.RecordBatch.from_arrays([ids, pa.array(line), pa.array(np.concatenate(chars).astype(np.int64)), pa.array(p), pa.array(p >= 0.5)], ["doc_id", "line", "chars", "marginal", "good"])

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    return rows.mapInArrow(run, "doc_id long, line long, chars long, marginal double, good boolean")


def keep_good(docs: DataFrame, model: Model, threshold: float = 0.3, text_col: str = "text") -> DataFrame:
    """The rows of docs, all columns, whose score reaches the threshold."""
    names = docs.columns
    at = names.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for lo in range(0, b.num_rows, 256):
                part = b.slice(lo, 256)
                yield part.filter(pa.array(model.scores(part.column(at).to_pylist()) >= threshold))

    return docs.mapInArrow(run, docs.schema)


def classify(docs: DataFrame, labels: DataFrame, threshold: float = 0.3, max_train: int = 4000) -> DataFrame:
    """(doc_id, held_out, score, predicted) for every row of docs."""
    scored = scores(docs, train(docs, labels, max_train))
    return scored.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))
