"""Best-fit packing of documents into sequences of a fixed capacity.

Every document is a run of token ids and an end id. Runs longer than the capacity are cut into full pieces and a rest.
What has to be decided depends on nothing but how many pieces there are of each length, so the histogram of lengths (as
many numbers as the capacity at most) goes to the driver, and the work there doesn't grow with the documents:

1. Configuration program: use as few sequences as possible, each filled by a configuration (how many pieces of each
   length), so that every length is covered. It is solved by multiplicative weights. Each length has a weight; weight
   over demand is its price. A knapsack dynamic program over the capacity finds the dearest configuration, and thereby
   sum(price x demand) / (dearest) is a lower bound on the sequences. Configurations whose price is within a tolerance
   of the dearest are taken, largest length first, as long as their lengths have demand left. Lengths that ended up in
   configurations short of the dearest then gain weight, in proportion to the shortfall. Rounds go on with a tolerance
   that comes round again, until a solution meets the bound or the rounds are over; the best one is kept.
2. Rounding: configurations in turn get whole numbers of sequences, so that the running total keeps to the fractional
   one; lengths that a configuration no longer needs are left out of it.
3. What rounding has left, some pieces for each configuration, goes by best fit, longest first, into the gaps of these
   sequences or else into new ones.

The result is a table of slots: the pieces of one length with the ranks from `first` on go to `copies` sequences from
`sequence` on, `each` to a sequence, at `offset`. Spark ranks the pieces within their length (in blocks, so that a
length that a third of all pieces have is ranked by many tasks) and places each one by its rank.

Defined results: a null text counts as empty; an empty text is a piece of the end id alone; repeated rows are documents
of their own; an empty table gives an empty result; other columns are ignored; null ids are kept.
"""

from __future__ import annotations

import bisect
import math
import zlib
from collections import defaultdict
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import materialize
from .word_bpe import word_coder

CAPACITY, END = 4096, 1
ROUNDS = 12
TOLERANCE = (0.002, 0.02, 0.2, 1.0)  # of the dearest configuration's price, round by round
RATE = 0.5
BLOCK = 2000  # pieces that are ranked together, on average
PIECE = "doc_id long, piece int, start long, length long, ids_crc32 long"


def pieces(docs: DataFrame, path: str, capacity: int = CAPACITY, end: int = END) -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32) of every row's ids and the end id, cut at the capacity."""
    last = np.array([end], "<u4").tobytes()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = word_coder(path)
        for b in batches:
            for lo in range(0, b.num_rows, 256):
                part = b.slice(lo, 256)
                rows: list[tuple] = []
                for doc, ids in zip(part.column(0).to_pylist(), coder.bytes_of(part.column(1).to_pylist()), strict=True):
                    ids += last
                    for k, at in enumerate(range(0, len(ids), 4 * capacity)):
                        cut = ids[at : at + 4 * capacity]
                        rows.append((doc, k, at // 4, len(cut) // 4, zlib.crc32(cut)))
                if rows:
                    doc, k, start, length, crc = zip(*rows, strict=True)
                    yield pa.RecordBatch.from_arrays([pa.array(doc, pa.int64()), pa.array(k, pa.int32()), *(pa.array(x, pa.int64()) for x in (start, length, crc))], ["doc_id", "piece", "start", "length", "ids_crc32"])

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(run, PIECE)


def knapsack(price: np.ndarray, lengths: np.ndarray, capacity: int) -> np.ndarray:
    """The dearest price that fits into each room from 0 to the capacity, any length any number of times."""
    best = np.zeros(capacity + 1)
    fits = np.searchsorted(lengths, np.arange(capacity + 1), side="right")
    for room in range(1, capacity + 1):
        if n := fits[room]:
            best[room] = max(best[room - 1], (price[:n] + best[room - lengths[:n]]).max())
    return best


@dataclass
class Program:
    """A fractional solution: configurations (((index of length, pieces), ...) -> sequences), their number and a bound."""

    lengths: np.ndarray
    used: dict[tuple[tuple[int, int], ...], float]
    sequences: float
    bound: float


def solve(histogram: np.ndarray, capacity: int = CAPACITY, rounds: int = ROUNDS) -> Program:
    """The configuration program over histogram[length] pieces of each length up to the capacity."""
    lengths = np.flatnonzero(histogram)
    if not len(lengths):
        return Program(lengths, {}, 0.0, 0.0)
    demand = histogram[lengths].astype(float)
    weight, bound, found = demand * lengths, 0.0, None
    for k in range(rounds):
        price = weight / demand
        best = knapsack(price, lengths, capacity)
        price, best = price / best[capacity], best / best[capacity]
        bound = max(bound, float((price * demand).sum()))
        used, shortfall = cover(price, best, lengths, demand, capacity, TOLERANCE[k % len(TOLERANCE)])
        total = sum(used.values())
        if found is None or total < found[0]:
            found = total, used
        if found[0] <= math.ceil(bound - 1e-6) + 0.5:
            break
        weight = weight * np.exp(RATE * shortfall / demand)
    return Program(lengths, found[1], found[0], bound)


def cover(price: np.ndarray, best: np.ndarray, lengths: np.ndarray, demand: np.ndarray, capacity: int, tolerance: float) -> tuple[dict, np.ndarray]:
    """Configurations that cover all demand, and for each length its pieces times the shortfall of their prices."""
    left, used, shortfall = demand.copy(), {}, np.zeros(len(lengths))
    fits = np.searchsorted(lengths, np.arange(capacity + 1), side="right")
    for i in range(len(lengths) - 1, -1, -1):
        while left[i] > 0:
            chosen, room = {i: 1}, capacity - lengths[i]
            while n := fits[room]:
                value = np.where(left[:n] > 0, price[:n] + best[room - lengths[:n]], -1.0)
                near = np.flatnonzero(value >= best[room] - tolerance)
                j = int(near[-1]) if len(near) else int(value.argmax())
                if value[j] < 0:
                    break
                chosen[j] = chosen.get(j, 0) + 1
                room -= lengths[j]
            at, count = np.fromiter(chosen, int), np.fromiter(chosen.values(), float)
            x = (left[at] / count).min()
            left[at] -= count * x
            left[left < 1e-9] = 0
            used[tuple(sorted(chosen.items()))] = x
            shortfall[at] += count * x * (1 - (count * price[at]).sum())
    return used, shortfall


def rounded(program: Program, histogram: np.ndarray, capacity: int = CAPACITY) -> list[tuple[dict[int, int], int]]:
    """[(pieces by length, sequences)] that hold every piece once: the program in whole numbers, then best fit."""
    left, total, groups = histogram.astype(int).copy(), 0.0, []
    for used, x in program.used.items():
        n = math.floor(total + x + 1e-9) - math.floor(total + 1e-9)
        total += x
        while n > 0:
            some = {int(program.lengths[j]): min(a, int(left[program.lengths[j]])) for j, a in used}
            some = {length: a for length, a in some.items() if a}
            if not some:
                break
            m = min(n, *(left[length] // a for length, a in some.items()))
            for length, a in some.items():
                left[length] -= m * a
            groups.append((some, int(m)))
            n -= m
    rooms: dict[int, list[tuple[dict[int, int], int]]] = defaultdict(list)
    for some, m in groups:
        rooms[capacity - sum(length * a for length, a in some.items())].append((some, m))
    free = sorted(r for r in rooms if r)

    def put(some: dict[int, int], m: int) -> None:
        room = capacity - sum(length * a for length, a in some.items())
        if room and not rooms[room]:
            bisect.insort(free, room)
        rooms[room].append((some, m))

    for length in range(capacity, 0, -1):
        while n := int(left[length]):
            at = bisect.bisect_left(free, length)
            if at < len(free):
                some, m = rooms[free[at]].pop()
                if not rooms[free[at]]:
                    free.pop(at)
            else:
                some, m = {}, n
            # as many to each as best fit would put there: once, or to a new sequence as often as it holds
            each = 1 if some else min(n, capacity // length)
            take = min(m, n // each)
            if m > take and some:
                put(some, m - take)
            put(some | {length: some.get(length, 0) + each}, take)
            left[length] -= take * each
    return [g for room in sorted(rooms) for g in rooms[room]]


@dataclass
class Slots:
    """Arrays of slots sorted by length and first rank."""

    length: np.ndarray
    first: np.ndarray
    each: np.ndarray
    sequence: np.ndarray
    offset: np.ndarray

    def place(self, length: np.ndarray, rank: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(sequence, offset) of the pieces with these lengths and ranks from 0."""
        base = int(self.first.max(initial=0)) + int(rank.max(initial=0)) + 1
        at = np.searchsorted(self.length * base + self.first, length * base + rank, side="right") - 1
        within = rank - self.first[at]
        return self.sequence[at] + within // self.each[at], self.offset[at] + within % self.each[at] * length


def slots(groups: list[tuple[dict[int, int], int]]) -> Slots:
    rows, sequence, rank = [], 0, defaultdict(int)
    for some, m in groups:
        offset = 0
        for length in sorted(some, reverse=True):
            rows.append((length, rank[length], some[length], sequence, offset))
            rank[length] += m * some[length]
            offset += length * some[length]
        sequence += m
    return Slots(*np.array(sorted(rows), np.int64).reshape(-1, 5).T.copy())


def pack(cut: DataFrame, capacity: int = CAPACITY, rounds: int = ROUNDS) -> DataFrame:
    """Rows with a `length` of 1 to the capacity, each with its sequence_id and its offset in it. Sequence ids run from
    0 on, and a sequence has no gaps."""
    spark = cut.sparkSession
    cut = materialize(cut, "packing-pieces", narrow=True)
    histogram = np.zeros(capacity + 1, np.int64)
    for length, n in cut.groupBy("length").count().collect():  # as many rows as the capacity at most
        histogram[length] = n
    table = spark.sparkContext.broadcast(slots(rounded(solve(histogram, capacity, rounds), histogram, capacity)))
    blocks = max(1, math.ceil(int(histogram.sum()) / BLOCK))
    columns, by = cut.columns, Window.partitionBy("length", "_block")
    rows = cut.withColumn("_block", F.pmod(F.xxhash64(*columns), F.lit(blocks)))
    before = rows.groupBy("length", "_block").count()
    before = before.withColumn("_before", F.sum("count").over(Window.partitionBy("length").orderBy("_block")) - F.col("count")).drop("count")
    ranked = rows.withColumn("_rank", F.row_number().over(by.orderBy(*columns)) - 1).join(before, ["length", "_block"])

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            length = b.column(b.schema.get_field_index("length")).to_numpy()
            sequence, offset = table.value.place(length, b.column(len(columns)).to_numpy())
            yield pa.RecordBatch.from_arrays([*b.columns[: len(columns)], pa.array(sequence), pa.array(offset)], [*columns, "sequence_id", "offset"])

    out = cut.withColumn("sequence_id", F.lit(0).cast("long")).withColumn("offset", F.lit(0).cast("long")).schema
    return ranked.select(*columns, (F.col("_rank") + F.col("_before")).cast("long").alias("_rank")).mapInArrow(place, out)


def pack_documents(docs: DataFrame, path: str, capacity: int = CAPACITY, end: int = END) -> DataFrame:
    """Every document's pieces with their sequences: (doc_id, piece, start, length, ids_crc32, sequence_id, offset)."""
    return pack(pieces(docs, path, capacity, end), capacity)
