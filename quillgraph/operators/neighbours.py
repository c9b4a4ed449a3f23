"""Exact nearest neighbours by pivots and the triangle inequality.

Vectors are dealt into cells around pivots, and cells are gathered into blocks of about BLOCK vectors; a larger cell has
blocks of its own. A vector is first compared with the block of its own cell. The k-th best of what it finds there bounds
how far its neighbours can lie; by the triangle inequality only cells whose ring around their pivot comes as near as that
may hold one, and the vector goes to the blocks of those cells alone. For cosine, distances are those of unit vectors.

Where that rules little out, vectors aren't sent: blocks are packed, a row each, and met by every block that asks for them,
a broadcast group of blocks after another. What is written grows with the vectors, only the work with their square.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..sources.shared import Scratch, materialize

BLOCK = 2048  # vectors of a block
MOST_CELLS = 4096  # pivots go to every task
TRAIN = 32  # vectors of the sample that pivots are fitted to, for each pivot
DIGITS = 6  # of a score
MOST_SENT = 2  # rows by which a vector goes to other blocks, on average, before blocks are met instead
GROUP = 32 << 20  # bytes of the blocks that are met at once
BATCH = "spark.sql.execution.arrow.maxBytesPerBatch"
SLACK = 2.0 * 10**-DIGITS  # by which rounded scores and sums may differ


def unit(m: np.ndarray, metric: str) -> np.ndarray:
    """Rows as points whose distances order the metric: of length 1 for cosine (zero rows stay), as they are for l2."""
    if metric != "cosine":
        return m
    size = np.sqrt((m * m).sum(1))[:, None]
    return np.divide(m, size, out=np.zeros_like(m), where=size > 0)


def apart(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Distances of all rows of x to all rows of y."""
    return np.sqrt(np.maximum((x * x).sum(1)[:, None] + (y * y).sum(1) - 2 * x @ y.T, 0))


def matrix(column: pa.Array) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), -1)


def reach(kth: np.ndarray, metric: str) -> np.ndarray:
    """How far a neighbour may lie whose score is no worse than kth."""
    square = 2 - 2 * (kth - SLACK) if metric == "cosine" else kth + SLACK
    return np.sqrt(np.maximum(square, 0)) + 1e-7


def pivots(rows: DataFrame, cells: int, metric: str, rounds: int = 4, train: int = TRAIN) -> np.ndarray:
    """k-means over a sample of at most train * cells vectors of rows (id, v): those with the smallest hashes of their id.

    Tasks assign their part of the sample and send sums by cell; centroids, MOST_CELLS at most, are averaged from them.
    """
    cells = min(cells, MOST_CELLS)
    spark = rows.sparkSession
    sample = materialize(rows.select(F.xxhash64("id").alias("h"), "id", "v").orderBy("h", "id").limit(train * cells), "pivot-sample")
    first = sample.orderBy("h", "id").limit(cells).select("v").toArrow().column("v").combine_chunks()  # one for each cell
    if not len(first):
        return np.zeros((0, 0))
    centres = unit(matrix(first), metric)
    for _ in range(rounds if sample.count() > cells else 0):
        sent = spark.sparkContext.broadcast(centres)

        def sums(batches: Iterator[pa.RecordBatch], sent=sent) -> Iterator[pa.RecordBatch]:
            for b in batches:
                if b.num_rows:
                    x = unit(matrix(b.column(0)), metric)
                    cell, which = np.unique(apart(x, sent.value).argmin(1), return_inverse=True)
                    total = np.zeros((len(cell), x.shape[1]))
                    np.add.at(total, which, x)
                    yield pa.RecordBatch.from_arrays([pa.array(cell), pa.array(np.bincount(which)), pa.array(list(total))], ["cell", "n", "total"])

        found = sample.select("v").mapInArrow(sums, "cell long, n long, total array<double>")
        found = found.select("cell", "n", F.posexplode("total").alias("k", "x")).groupBy("cell", "k").agg(F.sum("n").alias("n"), F.sum("x").alias("x"))
        rows_ = found.groupBy("cell").agg(F.transform(F.sort_array(F.collect_list(F.struct("k", (F.col("x") / F.col("n")).alias("x")))), lambda e: e["x"]).alias("c")).collect()
        centres = centres.copy()
        for r in rows_:
            centres[r.cell] = r.c
        centres = unit(centres, metric)
        sent.unpersist()
    return centres


@dataclass
class Cells:
    """Pivots, and of each cell how many vectors it holds, the nearest and farthest to its pivot, and its blocks."""

    centres: np.ndarray
    metric: str
    n: np.ndarray
    low: np.ndarray
    high: np.ndarray
    first: np.ndarray
    blocks: np.ndarray

    def within(self, x: np.ndarray, far: np.ndarray) -> np.ndarray:
        """Whether each cell may hold a vector as near as `far` to each row of x."""
        d = apart(x, self.centres)
        return (self.n > 0) & (np.maximum(d - self.high, self.low - d) <= far[:, None])


def gathered(centres: np.ndarray, metric: str, n: np.ndarray, low: np.ndarray, high: np.ndarray) -> Cells:
    """Cells with their blocks: cells follow one another along the direction in which pivots differ most."""
    first, blocks = np.zeros(len(n), np.int64), np.maximum(1, -(-n // BLOCK)).astype(np.int64)
    around = centres - centres.mean(0) if len(centres) else centres
    order = np.argsort(around @ np.linalg.svd(around, full_matrices=False)[2][0], kind="stable") if len(centres) > 1 else np.arange(len(n))
    last, room = 0, 0  # block that is being filled
    for c in order:
        if n[c] > BLOCK:
            continue
        if n[c] > room:
            last, room = last + 1, BLOCK
        first[c], room = last, room - n[c]
    for c in order:
        if n[c] > BLOCK:
            first[c], last = last + 1, last + blocks[c]
    return Cells(centres, metric, n, low, high, first, blocks)


def assigned(rows: DataFrame, centres: np.ndarray, metric: str) -> DataFrame:
    """rows (id, v) with their cell, their distance to its pivot as `away`, and `h`, a hash of the id that isn't negative."""
    sent = rows.sparkSession.sparkContext.broadcast(centres)
    kind = rows.schema["id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                d = apart(unit(matrix(b.column(1)), metric), sent.value)
                cell = d.argmin(1)
                yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), b.column(2), pa.array(cell.astype(np.int32)), pa.array(d[np.arange(len(cell)), cell])], ["id", "v", "h", "cell", "away"])

    return rows.select("id", "v", F.xxhash64("id").bitwiseAND((1 << 62) - 1).alias("h")).mapInArrow(run, f"id {kind}, v array<double>, h long, cell int, away double")


def cells_of(placed: DataFrame, centres: np.ndarray, metric: str) -> Cells:
    """The cells of assigned vectors."""
    n, low, high = np.zeros(len(centres), np.int64), np.zeros(len(centres)), np.zeros(len(centres))
    for r in placed.groupBy("cell").agg(F.count("*").alias("n"), F.min("away").alias("low"), F.max("away").alias("high")).collect():  # MOST_CELLS rows at most
        n[r.cell], low[r.cell], high[r.cell] = r.n, r.low, r.high
    return gathered(centres, metric, n, low, high)


def search_blocks(dealt: DataFrame, k: int, metric: str, parts: int) -> DataFrame:
    """(query_id, id, score): for each row that asks (block, asks, id, v) the best k others of its block that don't."""
    kind = dealt.schema["id"].dataType.simpleString()

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        got = [b for b in batches if b.num_rows]
        if not got:
            return
        t = pa.Table.from_batches(got).combine_chunks()
        block, asks, ids = (t.column(c).to_numpy() for c in ("block", "asks", "id"))
        m = matrix(t.column("v").chunk(0))
        order = np.argsort(block, kind="stable")
        for part in np.split(order, np.flatnonzero(np.diff(block[order])) + 1):
            q, c = part[asks[part]], part[~asks[part]]
            if not len(c) or not len(q):
                continue
            c = c[np.argsort(ids[c], kind="stable")]
            cand = m[c]
            size = np.sqrt((cand * cand).sum(1))
            for lo in range(0, len(q), 512):
                some = q[lo : lo + 512]
                x = m[some]
                inner = x @ cand.T
                if metric == "cosine":
                    scale = np.sqrt((x * x).sum(1))[:, None] * size
                    score = np.round(np.divide(inner, scale, out=np.zeros_like(inner), where=scale > 0), DIGITS)
                    rank = -score
                else:
                    score = np.round((x * x).sum(1)[:, None] + size**2 - 2 * inner, DIGITS)
                    rank = score.copy()
                rank[ids[some][:, None] == ids[c][None, :]] = np.inf
                best = np.argsort(rank, axis=1, kind="stable")[:, :k]
                row, col = np.repeat(np.arange(len(some)), best.shape[1]), best.ravel()
                real = np.isfinite(rank[row, col])
                row, col = row[real], col[real]
                yield pa.RecordBatch.from_arrays([pa.array(ids[some][row]), pa.array(ids[c][col]), pa.array(score[row, col] + 0.0)], ["query_id", "id", "score"])

    return dealt.select("block", "asks", "id", "v").repartition(parts, "block").mapInArrow(search, f"query_id {kind}, id {kind}, score double")


def sent_to(asking: DataFrame, cells: Cells, own: bool) -> DataFrame:
    """asking (id, v, cell, kth) with a row for each block that it goes to: those of its own cell, or else those of all
    others that may hold a vector as good as its kth score (null: not enough found, so all)."""
    sent = asking.sparkSession.sparkContext.broadcast(cells)
    kind = asking.schema["id"].dataType.simpleString()

    def blocks(c: Cells, cell: np.ndarray) -> np.ndarray:
        return np.unique(np.concatenate([np.arange(c.first[i], c.first[i] + c.blocks[i]) for i in cell])) if len(cell) else np.zeros(0, np.int64)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = sent.value
        for whole in batches:
            for lo in range(0, whole.num_rows, 1024):
                b = whole.slice(lo, 1024)
                home, kth = b.column(2).to_numpy(), b.column(3).to_numpy(zero_copy_only=False).astype(float)
                mine = [blocks(c, [i]) for i in home]
                if own:
                    to = mine
                else:
                    far = np.where(np.isnan(kth), np.inf, reach(np.nan_to_num(kth), c.metric))
                    near = c.within(unit(matrix(b.column(1)), c.metric), far)
                    to = [np.setdiff1d(blocks(c, np.flatnonzero(near[i])), mine[i]) for i in range(b.num_rows)]
                at = np.repeat(np.arange(b.num_rows), [len(x) for x in to])
                if len(at):
                    yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(to).astype(np.int64)), b.column(0).take(pa.array(at)), b.column(1).take(pa.array(at))], ["block", "id", "v"])

    return asking.select("id", "v", "cell", "kth").mapInArrow(run, f"block long, id {kind}, v array<double>").withColumn("asks", F.lit(True))


def best(found: DataFrame, k: int, metric: str) -> DataFrame:
    """(query_id, id, score, rank): the k best of what was found, ties by id."""
    order = F.col("score").desc() if metric == "cosine" else F.col("score").asc()
    ranked = found.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy(order, "id")))
    return ranked.where(F.col("rank") <= k)


def searched(asking: DataFrame, placed: DataFrame, cells: Cells, k: int, scratch: Scratch) -> DataFrame:
    """(query_id, id, score): for rows of asking (id, v, cell) what they find among placed, a scratch table of assigned vectors,
    their k nearest others among it. Rows by which a vector asks its own blocks are shuffled, and then those by which it asks
    others, or where these are very many, blocks are met."""
    held = blocked(placed, cells)
    total = int((cells.first + cells.blocks).max(initial=1))
    parts = max(1, min(total, 4 * int(asking.sparkSession.conf.get("spark.sql.shuffle.partitions"))))
    there = held.select("block", "id", "v").withColumn("asks", F.lit(False))
    own = sent_to(asking.withColumn("kth", F.lit(None).cast("double")), cells, True)
    found = scratch.write(search_blocks(there.unionByName(own), k, cells.metric, parts), "neighbours-own")
    kth = best(found, k, cells.metric).where(F.col("rank") == k).select(F.col("query_id").alias("id"), F.col("score").alias("kth"))
    known = asking.join(kth, "id", "left")
    other = sent_to(known, cells, False)
    if other.select("block").count() > MOST_SENT * int(cells.n.sum()):
        packs = scratch.write(packed(known, held, cells, parts), "neighbours-blocks")
        scratch.drop(placed)
        return met(found, packs, cells, k, scratch)
    return found.unionByName(search_blocks(there.unionByName(other), k, cells.metric, parts))


def packed(asking: DataFrame, held: DataFrame, cells: Cells, parts: int) -> DataFrame:
    """(block, ids, v, kth, cell, needs): a block of held (block, id, v) as one row. kth and cell: those of the vectors that
    are in asking (id, cell, kth), by turns (cell -1: doesn't ask); needs: the blocks that may hold their neighbours."""
    sent = asking.sparkSession.sparkContext.broadcast(cells)
    rows = held.select("block", "id", "v").join(asking.select("id", "cell", "kth"), "id", "left")
    kind = rows.schema["id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c, got = sent.value, [b for b in batches if b.num_rows]
        if not got:
            return
        t = pa.Table.from_batches(got)
        block = t.column("block").to_numpy()
        order = np.argsort(block, kind="stable")
        for at in np.split(order, np.flatnonzero(np.diff(block[order])) + 1):
            some = t.take(pa.array(at)).combine_chunks()
            m, kth = matrix(some.column("v").chunk(0)), some.column("kth").to_numpy().astype(float)
            cell = some.column("cell").fill_null(-1).to_numpy()
            asks = cell >= 0
            need = np.zeros(len(c.n), bool)
            for lo in range(0, len(m), 512):
                x, far, own = m[lo : lo + 512], kth[lo : lo + 512], asks[lo : lo + 512]
                near = c.within(unit(x, c.metric), np.where(np.isnan(far), np.inf, reach(np.nan_to_num(far), c.metric)))
                near[np.arange(len(x))[own], cell[lo : lo + 512][own]] = False  # has been asked
                need |= near[own].any(0)
            needs = np.unique(np.concatenate([np.zeros(0, np.int64), *[np.arange(c.first[i], c.first[i] + c.blocks[i]) for i in np.flatnonzero(need)]]))
            ids = pa.array([some.column("id").to_pylist()], pa.list_(some.schema.field("id").type))
            row = [pa.array([block[at[0]]]), ids, *[pa.array([x]) for x in (m.ravel(), kth, cell, needs)]]
            yield pa.RecordBatch.from_arrays(row, ["block", "ids", "v", "kth", "cell", "needs"])

    schema = f"block long, ids array<{kind}>, v array<double>, kth array<double>, cell array<int>, needs array<long>"
    return rows.repartition(parts, "block").select("block", "id", "v", "cell", "kth").mapInArrow(run, schema)


def met(found: DataFrame, packs: DataFrame, cells: Cells, k: int, scratch: Scratch) -> DataFrame:
    """found (query_id, id, score) with the best that packed vectors find in the blocks they need, other than their cell's own.
    Both are scratch tables."""
    spark, metric = packs.sparkSession, cells.metric
    sent = spark.sparkContext.broadcast(cells)
    kind = found.schema["id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = sent.value
        for b in batches:
            for i in range(b.num_rows):
                one = b.slice(i, 1)
                of = {n: one.column(n).flatten().to_numpy(zero_copy_only=False) for n in ("ids", "v", "kth", "cell", "other_ids", "other_v")}
                asks = of["cell"] >= 0
                home, block = of["cell"][asks], one.column("other_block")[0].as_py()
                there = (c.first[home] <= block) & (block < c.first[home] + c.blocks[home])  # was searched before
                ids, x = of["ids"][asks][~there], of["v"].reshape(len(of["ids"]), -1)[asks][~there]
                kth, cand, other = of["kth"][asks][~there], of["other_v"].reshape(len(of["other_ids"]), -1), of["other_ids"]
                order = np.argsort(other, kind="stable")
                cand, other = cand[order], other[order]
                size = (cand * cand).sum(1)
                for lo in range(0, len(x), 512):
                    q = x[lo : lo + 512]
                    inner, own = q @ cand.T, (q * q).sum(1)[:, None]
                    if metric == "cosine":
                        scale = np.sqrt(own) * np.sqrt(size)
                        score = np.round(np.divide(inner, scale, out=np.zeros_like(inner), where=scale > 0), DIGITS)
                        rank = -score
                    else:
                        rank = score = np.round(own + size - 2 * inner, DIGITS)
                    worst = np.nan_to_num(kth[lo : lo + 512] * (-1 if metric == "cosine" else 1), nan=np.inf)
                    row, col = np.nonzero(rank <= worst[:, None])
                    order = np.lexsort((col, rank[row, col], row))  # ties go by id, and so do columns
                    row, col = row[order], col[order]
                    first = np.flatnonzero(np.r_[True, row[1:] != row[:-1]]) if len(row) else row
                    place = np.arange(len(row)) - np.repeat(first, np.diff(np.r_[first, len(row)]))
                    row, col = row[place < k], col[place < k]
                    if len(row):
                        yield pa.RecordBatch.from_arrays([pa.array(ids[lo : lo + 512][row]), pa.array(other[col]), pa.array(score[row, col] + 0.0)], ["query_id", "id", "score"])

    size = packs.agg(F.max(F.size("v") * 8).alias("n")).first().n or 1
    total = int((cells.first + cells.blocks).max(initial=1))
    groups = max(1, -(-total // max(1, GROUP // size)))
    others = packs.select(F.col("block").alias("other_block"), F.col("ids").alias("other_ids"), F.col("v").alias("other_v"))
    asking = packs.where(F.exists("cell", lambda c: c >= 0) & (F.size("needs") > 0))
    cores = spark.sparkContext.defaultParallelism
    batch = spark.conf.get(BATCH)
    for g in range(groups):
        some = F.broadcast(others.where(F.col("other_block") % groups == g))
        pairs = asking.repartition(min(max(total, 1), 4 * cores)).join(some, F.array_contains("needs", F.col("other_block")))
        more = pairs.select("ids", "v", "kth", "cell", "other_block", "other_ids", "other_v").mapInArrow(run, f"query_id {kind}, id {kind}, score double")
        spark.conf.set(BATCH, str(GROUP))  # a row is two blocks
        try:
            now = scratch.write(best(found.unionByName(more), k, metric).drop("rank"), "neighbours-met")
        finally:
            spark.conf.set(BATCH, batch)
        scratch.drop(found)
        found = now
    scratch.drop(packs)
    return found


def blocked(placed: DataFrame, cells: Cells) -> DataFrame:
    """Assigned vectors (id, v, h, cell, away) with their block."""
    table = placed.sparkSession.createDataFrame([(i, int(f), int(b)) for i, (f, b) in enumerate(zip(cells.first, cells.blocks, strict=True))], "cell int, first long, blocks long")
    return placed.join(F.broadcast(table), "cell").withColumn("block", F.col("first") + F.col("h") % F.col("blocks")).drop("first", "blocks")


def zero_scores(found: DataFrame, rows: DataFrame, asking: DataFrame, blank: DataFrame, zero: DataFrame, k: int) -> DataFrame:
    """found with what zero vectors add under cosine, where they score 0 with every vector: the first k + 1 zero vectors
    (zero: their ids) for each query, and the first k + 1 of all rows for queries that are zero themselves (blank)."""
    kind = rows.schema["id"].dataType

    def firsts(df: DataFrame):
        ids = [r.id for r in df.select("id").orderBy("id").limit(k + 1).collect()]
        return F.explode(F.array(*[F.lit(i).cast(kind) for i in ids]).cast(f"array<{kind.simpleString()}>"))

    more = asking.join(blank, "id", "left_anti").select(F.col("id").alias("query_id"), firsts(zero).alias("id"))
    more = more.unionByName(blank.select(F.col("id").alias("query_id"), firsts(rows).alias("id")))
    return found.unionByName(more.where("query_id <> id").withColumn("score", F.lit(0.0)))


def to_cells(asking: DataFrame, cells: Cells, probes: int | None) -> DataFrame:
    """asking (id, v, kth) with a row (id, v, cell) for each of its `probes` nearest cells, or where probes is None for each
    cell that may hold a vector as good as its kth score (null: every cell)."""
    sent = asking.sparkSession.sparkContext.broadcast(cells)
    kind = asking.schema["id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = sent.value
        for whole in batches:
            for lo in range(0, whole.num_rows, 1024):
                b = whole.slice(lo, 1024)
                x = unit(matrix(b.column(1)), c.metric)
                if probes is None:
                    kth = b.column(2).to_numpy(zero_copy_only=False).astype(float)
                    at, cell = np.nonzero(c.within(x, np.where(np.isnan(kth), np.inf, reach(np.nan_to_num(kth), c.metric))))
                else:
                    d = np.where(c.n > 0, apart(x, c.centres), np.inf)
                    cell = np.argsort(d, axis=1, kind="stable")[:, : min(probes, int((c.n > 0).sum()))]
                    at, cell = np.repeat(np.arange(len(x)), cell.shape[1]), cell.ravel()
                yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(at)), b.column(1).take(pa.array(at)), pa.array(cell.astype(np.int32))], ["id", "v", "cell"])

    return asking.select("id", "v", "kth").mapInArrow(run, f"id {kind}, v array<double>, cell int")


def nearest(vectors: DataFrame, k: int = 10, metric: str = "cosine", id_col: str = "id", vec_col: str = "v", queries: DataFrame | None = None) -> DataFrame:
    """VEC02/VEC03: (query_id, id, score, rank): the k nearest others of each vector, exact; of those only whose ids are in
    queries (id), where these are given.

    metric: cosine (larger is nearer; 0 with a zero vector) or l2, the squared distance. Scores are rounded before they
    are ranked, ties go by id. A null vector neither asks nor is found.
    """
    rows = vectors.select(F.col(id_col).alias("id"), F.col(vec_col).cast("array<double>").alias("v")).where("v IS NOT NULL")
    asking = rows if queries is None else rows.join(queries.select("id").distinct(), "id", "left_semi")
    zero = rows.where(~F.exists("v", lambda x: x != 0)).select("id") if metric == "cosine" else rows.select("id").limit(0)
    live = rows if metric != "cosine" else rows.where(F.exists("v", lambda x: x != 0))
    n = live.count()
    centres = pivots(live, min(MOST_CELLS, max(1, math.ceil(4 * n / BLOCK))), metric)
    if not len(centres):
        found = rows.select(F.col("id").alias("query_id"), "id", F.lit(0.0).alias("score")).limit(0)
    else:
        scratch = Scratch(vectors.sparkSession)
        placed = scratch.write(assigned(live, centres, metric), "neighbours-cells")
        cells = cells_of(placed, centres, metric)
        ask = placed if queries is None else placed.join(queries.select("id").distinct(), "id", "left_semi")
        found = searched(ask, placed, cells, k, scratch)
    if metric == "cosine" and not zero.isEmpty():
        found = zero_scores(found, rows, asking.select("id"), asking.join(zero, "id", "left_semi").select("id"), zero, k)
    return best(found, k, metric)
