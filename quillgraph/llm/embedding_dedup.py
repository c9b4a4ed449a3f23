"""Embedding near-dedup by collision counting on sorted one-dimensional projections.

Vectors are scaled to length 1 and projected on many random lines. Along each line, a pair collides if the one lies
within a window centred on the other; the share of lines on which a pair at the cosine threshold collides is known, so
the count that such a pair reaches with probability `recall` is too (a binomial quantile). Pairs that reach the count
are verified by their cosine in double precision.

1. Spark sorts each line: a row is the vector's name, its place on the line and its places on all lines in a byte each.
   A window holds a third of all unrelated vectors whatever the line, so whole lines would cost a third of all pairs.
   Each line is therefore sorted within coarse cells, cut by `cuts` further projections at random offsets. How many
   cuts and lines there are follows from the number of vectors and the recall that is asked for.
2. Tasks walk the sorted rows, and count, for the pairs in each other's window, the collisions on all lines. The names
   of vectors with a pair that reaches the count go on; pairs are never returned.
3. Only for those are vectors brought to their cells. The pairs are walked and counted again, and verified; a pair that
   meets on several lines counts on the first. Tasks return link counts by vector and stars of links.

Equal vectors are one vector with a weight. A cell with more than BLOCK vectors is split into blocks, and each pair of
blocks is dealt out on its own. Vectors of any length are compared with those of the same length.

Defined results: a vector that is null, empty, zero or holds null or non-finite components links with nothing and
stays; repeated rows with the same id are rows of their own that link with each other; a null id names a component only
if nothing else is in it; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import connected_components, expand, local_components, materialize, shuffle_partitions, star_edges

BLOCK = 4096
LINES = 32  # lines on which collisions are counted, at least
WINDOW = 2.0  # half width of a window, in standard deviations of the difference of a pair at the threshold
CELL = 6.0  # width of a cell, in the same unit
MATES = 512  # unrelated vectors in a cell, about
BYTE = 1 / 24  # what a step of a place in a byte is
ROWS = 200_000  # rows of one task, about
VECTORS = 32 << 20  # bytes of vectors of one task, about
CHUNK = 1_000_000  # pairs compared at once


@dataclass
class Plan:
    """Lines, offsets and counts that one search shares; bounded by the dimension and the number of lines."""

    threshold: float
    sigma: float  # of a line's difference for a pair at the threshold
    lines: np.ndarray  # dim x lines, for counting; the first `tables` of them are sorted
    cutters: np.ndarray  # dim x (tables * cuts)
    offsets: np.ndarray
    tables: int
    cuts: int
    least: int  # collisions that a pair needs

    @property
    def reach(self) -> float:
        return WINDOW * self.sigma

    def keys(self, unit: np.ndarray) -> np.ndarray:
        """(n, tables) 64-bit keys of the cells of unit vectors."""
        cell = np.floor((unit @ self.cutters + self.offsets) / (CELL * self.sigma)).astype(np.int64).view(np.uint64)
        out = np.tile((np.arange(self.tables, dtype=np.uint64) << np.uint64(32)) + np.uint64(unit.shape[1]), (len(unit), 1))
        for c in range(self.cuts):
            out = (out ^ cell[:, c :: self.cuts]) * np.uint64(0x9E3779B97F4A7C15)
            out ^= out >> np.uint64(29)
        return out.view(np.int64)


def normal_within(z: float) -> float:
    return math.erf(z / math.sqrt(2))


@lru_cache(maxsize=16)
def plan(count: int, dim: int, threshold: float = 0.95, recall: float = 0.998, seed: int = 7) -> Plan:
    """How to search count vectors: a pair at the threshold is found with probability `recall` or more.

    A cut keeps a pair at the threshold together with probability `near`, and two unrelated vectors with `far`; the
    cuts are so many that a vector has about MATES unrelated ones in its cell, and the sorted lines so many that a pair
    at the threshold misses the cell or the window on all of them with probability (1 - recall) / 2 at most.
    """
    sigma = math.sqrt(2 - 2 * threshold)
    width = CELL * sigma
    near = 1 - math.sqrt(2 / math.pi) / CELL
    x = np.linspace(-6, 6, 4001)
    pdf = np.exp(-(x**2) / 4) / math.sqrt(4 * math.pi)
    far = float((np.clip(1 - np.abs(x) / width, 0, None) * pdf).sum() * (x[1] - x[0]))
    cuts = max(1, math.ceil(math.log(max(count, 2) / MATES) / -math.log(far))) if count > MATES else 1
    p = normal_within(WINDOW)
    tables = max(1, math.ceil(math.log((1 - recall) / 2) / math.log(1 - p * near**cuts)))
    lines = max(LINES, tables)
    # the most collisions that all but (1 - recall) / 2 of pairs at the threshold reach
    tail, least = 0.0, 0
    for k in range(lines + 1):
        tail += math.comb(lines, k) * p**k * (1 - p) ** (lines - k)
        if tail > (1 - recall) / 2:
            least = k
            break
    r = np.random.default_rng([seed, dim])
    return Plan(threshold, sigma, r.standard_normal((dim, lines)), r.standard_normal((dim, tables * cuts)), r.random(tables * cuts) * width, tables, cuts, least)


def _unit(raw: np.ndarray) -> np.ndarray:
    top = np.abs(raw).max(1, keepdims=True)  # squares of very large or small components stay in range
    raw = raw / top
    return raw / np.sqrt((raw * raw).sum(1, keepdims=True))


def _in_windows(group: np.ndarray, place: np.ndarray, reach: float) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Pairs of rows, sorted by group and place, that have a group in common and lie within reach, in chunks."""
    new = np.r_[True, group[1:] != group[:-1]]
    which = np.cumsum(new) - 1
    far = float(np.abs(place).max()) + reach + 1 if len(place) else 1.0
    along = which * (2 * far) + place.astype(np.float64)
    here = np.arange(len(place))
    count = np.searchsorted(along, along + reach, side="right") - here - 1
    some = count > 0
    yield from expand(here[some], here[some] + 1, count[some], CHUNK)


def _colliding(places: np.ndarray, a: np.ndarray, b: np.ndarray, reach: float, least: int) -> np.ndarray:
    """Which of the pairs (a, b) of rows of places (rows x lines) lie within reach on `least` lines."""
    lines = places.shape[1]
    at, misses = np.arange(len(a)), np.zeros(len(a), np.int16)
    for line in range(lines):
        misses += np.abs(places[a[at], line] - places[b[at], line]) > reach
        if line % 4 == 3 or line == lines - 1:
            open_ = misses <= lines - least
            at, misses = at[open_], misses[open_]
    return at


def distinct_vectors(vectors: DataFrame, id_col: str = "vec_id", vec_col: str = "embedding") -> tuple[DataFrame, DataFrame]:
    """Rows (vec_id, v: array of float or double, null where it can't link), and (rep, v, first, n) for each distinct vector."""
    kind = "array<float>" if vectors.schema[vec_col].dataType.simpleString() == "array<float>" else "array<double>"
    rows = vectors.select(F.col(id_col).cast("long").alias("vec_id"), F.col(vec_col).cast(kind).alias("v"))
    bad = F.exists("v", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    zero = F.forall("v", lambda x: x == 0)
    rows = rows.select("vec_id", F.when(F.col("v").isNotNull() & ~bad & ~zero, F.transform("v", lambda x: F.when(x == 0, F.abs(x)).otherwise(x))).alias("v"))
    reps = rows.where(F.col("v").isNotNull()).groupBy("v").agg(F.min("vec_id").alias("first"), F.count(F.lit(1)).alias("n"))
    return rows, reps.select(F.xxhash64("v").alias("rep"), "v", "first", "n")


def _by_length(column: pa.Array) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """For each length of vector: the rows that have it, and their vectors as a matrix."""
    size = np.asarray(column.value_lengths())
    for d in np.unique(size):
        at = np.flatnonzero(size == d)
        flat = (column if len(at) == len(size) else column.take(pa.array(at))).flatten()
        yield at, flat.to_numpy(zero_copy_only=False).reshape(-1, d)


def _blocks(rows: DataFrame, label: str) -> DataFrame:
    """rows (key, rep, ...) with the block pair (i, j) and the row's own block; rows of a hot key once for each block."""
    hot = rows.groupBy("key").count().where(F.col("count") > BLOCK).select("key", F.ceil(F.col("count") / BLOCK).cast("int").alias("blocks"))
    hot = materialize(hot, label)
    if hot.isEmpty():
        return rows.select("*", F.lit(0).alias("own"), F.lit(0).alias("i"), F.lit(0).alias("j"))
    blocks = F.coalesce("blocks", F.lit(1))
    rows = rows.join(hot, "key", "left").withColumn("own", F.pmod(F.xxhash64("rep"), blocks).cast("int")).withColumn("other", F.explode(F.sequence(F.lit(0), blocks - 1)))
    return rows.withColumns({"i": F.least("own", "other"), "j": F.greatest("own", "other")}).drop("blocks", "other")


def _table(batches: Iterator[pa.RecordBatch]) -> tuple[pa.Table, np.ndarray, np.ndarray, np.ndarray] | None:
    """A task's rows sorted by (key, i, j, place): table, group, own block, and whether both blocks of the pair are one."""
    rows = [b for b in batches if b.num_rows]
    if not rows:
        return None
    t = pa.Table.from_batches(rows).combine_chunks()
    key, i, j = (t.column(c).to_numpy() for c in ("key", "i", "j"))
    new = np.r_[True, (key[1:] != key[:-1]) | (i[1:] != i[:-1]) | (j[1:] != j[:-1])]
    return t, np.cumsum(new) - 1, t.column("own").to_numpy(), i == j


def candidates(reps: DataFrame, count: int, threshold: float, recall: float, seed: int = 7) -> DataFrame:
    """(key, rep): the cells in which a vector of reps (rep, v) has a pair that collides often enough."""
    spark = reps.sparkSession

    def project(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for lo in range(0, b.num_rows, 1024):
                s = b.slice(lo, 1024)
                for at, raw in _by_length(s.column(1)):
                    p = plan(count, raw.shape[1], threshold, recall, seed)
                    unit = _unit(raw.astype(np.float64))
                    keys, place = p.keys(unit), (unit @ p.lines).astype(np.float32)
                    rep = s.column(0).take(pa.array(at))
                    sketch = pa.array([x.tobytes() for x in np.clip(np.rint(place / BYTE), -127, 127).astype(np.int8)], pa.binary())
                    for t in range(p.tables):
                        yield pa.RecordBatch.from_arrays([pa.array(keys[:, t]), pa.array(place[:, t]), rep, sketch], ["key", "place", "rep", "sketch"])

    rows = materialize(reps.select("rep", "v").mapInArrow(project, "key long, place float, rep long, sketch binary"), "vectors-lines")
    size = rows.count()
    parts = max(shuffle_partitions(spark), size // ROWS + 1)
    reach, p = WINDOW * math.sqrt(2 - 2 * threshold), plan(count, 1, threshold, recall, seed)
    lines, least = p.lines.shape[1], p.least

    def walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if not (told := _table(batches)):
            return
        t, group, own, alone = told
        places = np.frombuffer(b"".join(t.column("sketch").to_pylist()), np.int8).reshape(-1, lines).astype(np.int16)
        met = np.zeros(len(group), bool)
        for a, b in _in_windows(group, t.column("place").to_numpy(), reach):
            other = alone[a] | (own[a] != own[b])
            a, b = a[other & ~(met[a] & met[b])], b[other & ~(met[a] & met[b])]
            # a byte's rounding may move places apart by one step, never a collision out of reach
            hit = _colliding(places, a, b, math.floor(reach / BYTE) + 1, least)
            met[a[hit]] = met[b[hit]] = True
        yield pa.RecordBatch.from_arrays([t.column("key").combine_chunks().filter(pa.array(met)), t.column("rep").combine_chunks().filter(pa.array(met))], ["key", "rep"])

    dealt = _blocks(rows, "vectors-hot").repartition(parts, "key", "i", "j").sortWithinPartitions("key", "i", "j", "place")
    return dealt.mapInArrow(walk, "key long, rep long").distinct()


def links(reps: DataFrame, count: int, threshold: float, recall: float, seed: int = 7) -> DataFrame:
    """Rows (rep, n_links, other) of distinct vectors (rep, v, n): a row with n_links gives the weight of vectors linked
    to rep in one cell; a row with other is a link of a star."""
    spark = reps.sparkSession
    found = materialize(candidates(reps, count, threshold, recall, seed), "vectors-candidates")
    rows = materialize(found.join(reps.select("rep", "v", "n"), "rep").select("key", "rep", "v", "n"), "vectors-cells")
    wide = 8 if reps.schema["v"].dataType.simpleString() == "array<double>" else 4
    held = rows.agg(F.sum(F.size("v") * wide)).first()[0] or 0

    def verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if not (told := _table(batches)):
            return
        t, group_, own_, alone_ = told
        key_, rep_, n_ = (t.column(c).to_numpy() for c in ("key", "rep", "n"))
        for at, raw in _by_length(t.column("v").chunk(0)):
            key, rep, n, group, own, alone = (x[at] for x in (key_, rep_, n_, group_, own_, alone_))
            p = plan(count, raw.shape[1], threshold, recall, seed)
            keys, places = np.empty((len(raw), p.tables), np.int64), np.empty((len(raw), p.lines.shape[1]), np.float32)
            for lo in range(0, len(raw), 8192):
                unit = _unit(raw[lo : lo + 8192].astype(np.float64))
                keys[lo : lo + 8192], places[lo : lo + 8192] = p.keys(unit), unit @ p.lines
            line = (keys == key[:, None]).argmax(1)
            order = np.lexsort((places[np.arange(len(raw)), line], group))
            names, node = np.unique(rep, return_inverse=True)
            total, lab = np.zeros(len(names), np.int64), np.arange(len(names))
            for a, b in _in_windows(group[order], places[order, line[order]], p.reach):
                a, b = order[a], order[b]
                other = alone[a] | (own[a] != own[b])
                a, b = a[other], b[other]
                hit = _colliding(places, a, b, p.reach, p.least)
                a, b = a[hit], b[hit]
                # the first line on which they meet: in one cell, within reach
                met = (keys[a] == keys[b]) & (np.abs(places[a, : p.tables] - places[b, : p.tables]) <= p.reach)
                first = met.argmax(1) == line[a]
                a, b = a[first], b[first]
                near = np.zeros(len(a), bool)
                for lo in range(0, len(a), 100_000):
                    u, v = _unit(raw[a[lo : lo + 100_000]].astype(np.float64)), _unit(raw[b[lo : lo + 100_000]].astype(np.float64))
                    near[lo : lo + 100_000] = (u * v).sum(1) >= threshold
                u, v = a[near], b[near]
                np.add.at(total, node[u], n[v])
                np.add.at(total, node[v], n[u])
                lab = local_components(len(names), node[u], node[v], lab)
            s, d = star_edges(names, lab)
            seen = total > 0
            none = np.r_[np.ones(seen.sum(), bool), np.zeros(len(d), bool)]
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.r_[names[seen], s]), pa.array(np.r_[total[seen], np.zeros(len(s), np.int64)]), pa.array(np.r_[np.zeros(seen.sum(), np.int64), d], mask=none)], ["rep", "n_links", "other"]
            )

    parts = max(shuffle_partitions(spark), int(held / VECTORS) + 1)
    dealt = _blocks(rows, "vectors-hot-cells").repartition(parts, "key", "i", "j").sortWithinPartitions("key", "i", "j")
    return dealt.mapInArrow(verify, "rep long, n_links long, other long")


def near_duplicates(vectors: DataFrame, threshold: float = 0.95, recall: float = 0.998, id_col: str = "vec_id", vec_col: str = "embedding") -> DataFrame:
    """(vec_id, n_links, component_id, kept) for every row of vectors."""
    rows, reps = distinct_vectors(vectors, id_col, vec_col)
    reps = materialize(reps, "vectors-distinct")
    count = reps.count()
    if count:
        found = materialize(links(reps, count, threshold, recall), "vectors-links")
    else:
        found = vectors.sparkSession.createDataFrame([], "rep long, n_links long, other long")
    degree = found.where(F.col("other").isNull()).groupBy("rep").agg(F.sum("n_links").alias("others"))
    nodes = connected_components(found.where(F.col("other").isNotNull()).select(F.col("rep").alias("src"), F.col("other").alias("dst")), "vectors")
    firsts = reps.select("rep", "first")
    named = nodes.join(firsts, F.col("node") == F.col("rep")).groupBy("component").agg(F.min("first").alias("component_id"))
    linked = nodes.join(named, "component").select(F.col("node").alias("rep"), "component_id")
    facts = reps.join(degree, "rep", "left").join(linked, "rep", "left")
    facts = facts.select("v", (F.col("n") - 1 + F.coalesce("others", F.lit(0))).alias("links"), F.coalesce("component_id", "first").alias("component"))
    facts = materialize(facts, "vectors-facts")
    out = rows.where(F.col("v").isNotNull()).join(facts, "v").select("vec_id", "links", "component")
    out = out.unionByName(rows.where(F.col("v").isNull()).select("vec_id", F.lit(0).cast("long").alias("links"), F.col("vec_id").alias("component")))
    return out.select("vec_id", F.col("links").alias("n_links"), F.col("component").alias("component_id"), F.coalesce(F.col("vec_id") == F.col("component"), F.lit(True)).alias("kept"))
