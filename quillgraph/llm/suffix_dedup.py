"""Removal of byte strings that repeat across documents.

A byte goes if it lies in a string of `LENGTH` = 50 bytes that also starts in a document with a smaller id. Two ways
find these strings, with the same rows:

`doubled_spans` is distributed prefix doubling: Spark sorts all positions by the pair of ranks of what begins there and
h bytes on, numbers the pairs anew, and goes on with h doubled; positions whose rank one document has for itself leave,
until h passes 50. It shuffles every byte's position several times, many times the corpus on disk (README has figures).

`repeated_spans`, which `remove_repeats` takes unless told otherwise, ranks sampled positions instead and loses no
repeat. Ranks are hashes that agree across documents:

1. Each window of 50 bytes has as its anchor the FIRST bytes in it with the smallest hash, so equal windows have equal
   anchors in equal places. Spark groups anchors by their rank; ranks of one document only are unique and drop out.
2. Pairs of ranks at the offsets before and behind the anchor rank it over its whole context, which holds all its
   windows. An anchor whose context occurs in an earlier document has all of its windows covered.
3. Of the rest, those go on that share half a context more, on either side, with another document. Spark groups these
   once more by rank and the half context on that side, now with the bytes around them, and ranks each of their windows
   by the pair of what lies before and behind the anchor; a window is covered if an earlier document has its rank.

Before anything is shuffled, anchors are combined within each slice of documents: those whose context an earlier
document of the slice has are settled, and are dealt out evenly. So a rank that very many documents share reaches its
task about once a slice and context.

An anchor's rank is 64 bits and a context's or window's 128. Positions with a rank of their own leave early, so what is
sorted shrinks from round to round.

Defined results: a null text counts as empty; texts under 50 bytes keep all bytes; documents with the same id are not
earlier than each other; a null id is later than all others; repeated rows each get their own row; an empty table gives
an empty result; other columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import materialize, shuffle_partitions

LENGTH, FIRST = 50, 18
SIDE = LENGTH - FIRST  # bytes of an anchor's context on either side
HALF = SIDE // 2
SEGMENT = 1 << 20  # positions hashed at once
SLICE = 1024  # documents whose anchors are combined before the shuffle
TASK = 8 << 20  # bytes of text whose anchors one task holds
BEFORE, BEHIND = 1, 2
SETTLED = 2  # in place of the 16 bits before an anchor, which are odd or 0
LAST = (1 << 63) - 1  # what a null id counts as
U = np.uint64


def _words(raw: bytes) -> np.ndarray:
    """The 8 bytes from each position of a text with SIDE bytes of 0xFF before it and behind."""
    padded = np.frombuffer(b"\xff" * SIDE + raw + b"\xff" * (SIDE + 8), np.uint8)
    return np.lib.stride_tricks.as_strided(padded, (len(padded) - 7, 8), (1, 1)).copy().view("<u8").ravel()


def _over(n: int) -> list[int]:
    """Offsets of 8-byte words that cover n bytes."""
    return [*range(0, n - 8, 8), n - 8]


def _mixed(w: np.ndarray, at: np.ndarray | slice, offsets: list[int], seed: int) -> np.ndarray:
    h = None
    for o in offsets:
        x = w[o:][at]
        h = x * U(0x9E3779B97F4A7C15) + U(seed) if h is None else (h ^ x) * U(0xD6E8FEB86659FD93)
        h ^= h >> U(32)
    return h * U(0x9FB21C651E98DF25)


def _mixed_rows(text: np.ndarray, seed: int) -> np.ndarray:
    """The same hash for whole rows of bytes."""
    size = text.shape[1]
    words = [np.ascontiguousarray(text[:, o : o + 8]).view("<u8").ravel() for o in _over(size)]
    return _mixed(np.stack(words, 1).ravel(), slice(None, None, len(words)), list(range(len(words))), seed)


def _minima(h: np.ndarray, width: int) -> np.ndarray:
    """Smallest of each `width` successive values."""
    k = 1
    while k * 2 <= width:
        h, k = np.minimum(h[:-k], h[k:]), k * 2
    return np.minimum(h[: len(h) - (width - k)], h[width - k :]) if k < width else h


def window_anchors(w: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Positions of the anchors of a text of n bytes, the hash of each position and the smallest of each window."""
    count, width = n - FIRST + 1, SIDE + 1
    if n < LENGTH:
        return np.zeros(0, np.int64), np.zeros(0, U), np.zeros(0, U)
    h = _mixed(w, slice(SIDE, SIDE + count), _over(FIRST), 1)
    m = _minima(h, width)
    # a position is an anchor if a window that holds it has its hash as smallest, that is as the largest such smallest
    low = np.zeros(width - 1, U)
    largest = ~_minima(~np.concatenate([low, m, low]), width)
    return np.flatnonzero(h == largest[:count]), h, m


def _anchor_rows(raw: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For each anchor: its rank, the rank of its sides (two of 32 bits), and its place: half a context before
    and behind (16 bits each, 0 where the text is shorter), position (32 bits)."""
    ranks, sides, places = [], [], []
    for lo in range(0, max(len(raw) - LENGTH + 1, 1), SEGMENT):
        # windows that start in the segment; bytes around it keep contexts whole
        a, b = max(0, lo - SIDE), min(len(raw), lo + SEGMENT + LENGTH - 1 + SIDE)
        w = _words(raw[a:b])
        own = min(len(raw), lo + SEGMENT + LENGTH - 1) - lo
        at, h, _ = window_anchors(w[lo - a :], own)
        p = at + (lo - a) + SIDE  # in w
        left = _mixed(w, p - SIDE, _over(SIDE), 2) >> U(32)
        right = _mixed(w, p + FIRST, _over(SIDE), 3) >> U(32)
        l12 = _mixed(w, p - HALF, _over(HALF), 4) >> U(48) | U(1)
        r12 = _mixed(w, p + FIRST, _over(HALF), 5) >> U(48) | U(1)
        pos = at + lo
        l12[pos < HALF] = 0
        r12[pos + FIRST + HALF > len(raw)] = 0
        ranks.append(h[at])
        sides.append(left << U(32) | right)
        places.append(l12 << U(48) | r12 << U(32) | pos.astype(U))
    return np.concatenate(ranks), np.concatenate(sides), np.concatenate(places)


def _run_minima(keys: list[np.ndarray], values: np.ndarray) -> np.ndarray:
    """For each row, the smallest value among the rows with equal keys."""
    order = np.lexsort(keys)
    new = np.r_[True, np.any([k[order][1:] != k[order][:-1] for k in keys], axis=0)]
    first = np.flatnonzero(new)
    out = np.empty_like(values)
    out[order] = np.minimum.reduceat(values[order], first)[np.cumsum(new) - 1]
    return out


def _judge(rank: np.ndarray, side: np.ndarray, place: np.ndarray, doc: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Rows whose context has an earlier document; rows that need their windows ranked, and on which sides of the anchor:
    BEFORE, BEHIND or both."""
    none = np.zeros(0, int)
    if not len(rank):
        return none, none, none
    order = np.argsort(rank, kind="stable")
    r = rank[order]
    new = np.r_[True, r[1:] != r[:-1]]
    first = np.flatnonzero(new)
    low, high = np.minimum.reduceat(doc[order], first), np.maximum.reduceat(doc[order], first)
    shared = np.sort(order[(low < high)[np.cumsum(new) - 1]])  # the others' ranks are unique to their document
    if not len(shared):
        return none, none, none
    rank, side, place, doc = rank[shared], side[shared], place[shared], doc[shared]
    covered = doc > _run_minima([side, rank], doc)
    left = np.flatnonzero(~covered)  # the first document of each context stands for all that have it
    if not len(left):
        return shared[covered], none, none
    rank, place, doc = rank[left], place[left], doc[left]
    l12, r12 = place >> U(48), place >> U(32) & U(0xFFFF)
    longer = np.zeros(len(left), int)
    for half, sign in ((l12, BEFORE), (r12, BEHIND)):
        longer |= sign * ((half > 0) & (_run_minima([half, rank], doc) < -_run_minima([half, rank], -doc)))
    return shared[covered], shared[left[longer > 0]], longer[longer > 0]


ROW = "rank long, side long, place long, doc long, text_hash long"
SPOT = "doc long, text_hash long, pos int, sides int"  # 0: covered


def _combined(rank: np.ndarray, side: np.ndarray, place: np.ndarray, doc: np.ndarray, th: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """rank, side and place of a slice's anchors; settled ones get a rank that only deals them out."""
    if not len(rank):
        return rank, side, place
    gone = doc > _run_minima([side, rank], doc)
    pos = place & U(0xFFFFFFFF)
    return np.where(gone, (th.view(U) ^ pos) * U(0x9E3779B97F4A7C15), rank), np.where(gone, U(0), side), np.where(gone, U(SETTLED << 48) | pos, place)


def anchors(rows: DataFrame) -> DataFrame:
    """Anchors of all rows (doc, text_hash, text), combined by slices."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for lo in range(0, b.num_rows, SLICE):
                s = b.slice(lo, SLICE)
                found = [_anchor_rows(t.as_py().encode("utf-8", "surrogatepass")) for t in s.column(2)]
                size = [len(f[0]) for f in found]
                doc, th = (np.repeat(s.column(k).to_numpy(zero_copy_only=False), size) for k in range(2))
                cols = _combined(*(np.concatenate([f[k] for f in found]) for k in range(3)), doc, th)
                yield pa.RecordBatch.from_arrays([*(pa.array(c.view(np.int64)) for c in cols), pa.array(doc), pa.array(th)], ["rank", "side", "place", "doc", "text_hash"])

    return rows.select("doc", "text_hash", "text").mapInArrow(run, ROW)


def shared_anchors(found: DataFrame, parts: int) -> DataFrame:
    """(doc, text_hash, pos, sides) of anchors that a document earlier than their own shares in part or whole."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = [b for b in batches if b.num_rows]
        if not rows:
            return
        t = pa.Table.from_batches(rows)
        rank, side, place = (t.column(c).to_numpy().view(U) for c in ("rank", "side", "place"))
        doc, th = t.column("doc").to_numpy(), t.column("text_hash").to_numpy()
        settled = place >> U(48) == U(SETTLED)
        asked = np.flatnonzero(~settled)
        covered, open_, sides = _judge(rank[asked], side[asked], place[asked], doc[asked])
        covered, open_ = np.concatenate([np.flatnonzero(settled), asked[covered]]), asked[open_]
        at = np.concatenate([covered, open_])
        pos = (place[at] & U(0xFFFFFFFF)).astype(np.int32)
        sides = np.r_[np.zeros(len(covered), np.int32), sides.astype(np.int32)]
        yield pa.RecordBatch.from_arrays([pa.array(doc[at]), pa.array(th[at]), pa.array(pos), pa.array(sides)], ["doc", "text_hash", "pos", "sides"])

    return found.repartition(parts, "rank").mapInArrow(run, SPOT)


def _windows(text: np.ndarray, n: np.ndarray, pos: np.ndarray, rank: np.ndarray, doc: np.ndarray, side_: np.ndarray) -> np.ndarray:
    """(anchors, SIDE + 1): whether the window that starts so many bytes before the anchor is in an earlier document.

    text: the contexts, as rows of bytes; n, pos: their documents' sizes and their places there; side_: BEFORE for windows
    that start HALF a side or more before the anchor, BEHIND for those that end as far behind it.
    """
    many, side = len(text), np.arange(SIDE + 1)
    # ranks of what lies up to so many bytes before the anchor, and behind it, grow byte by byte
    before, behind = np.zeros((many, SIDE + 1), U), np.zeros((many, SIDE + 1), U)
    for k in range(1, SIDE + 1):
        b = (before[:, k - 1] ^ text[:, SIDE - k].astype(U) + U(1)) * U(0x9E3779B97F4A7C15)
        before[:, k] = b ^ b >> U(29)
        b = (behind[:, k - 1] ^ text[:, SIDE + FIRST + k - 1].astype(U) + U(1)) * U(0xD6E8FEB86659FD93)
        behind[:, k] = b ^ b >> U(31)
    start = pos[:, None] - side
    inside = (start >= 0) & (start + LENGTH <= n[:, None]) & np.where(side_[:, None] == BEFORE, side >= HALF, side <= HALF)
    out = np.zeros((many, SIDE + 1), bool)
    for k in side:
        at = np.flatnonzero(inside[:, k])
        if len(at):
            out[at, k] = doc[at] > _run_minima([behind[at, SIDE - k], before[at, k], rank[at]], doc[at])
    return out


def contexts(rows: DataFrame, spots: DataFrame) -> DataFrame:
    """(key, rank, doc, text_hash, pos, size, side, context) of the anchors spots (doc, text_hash, pos, sides), a row for
    each side. The key is the rank with the HALF bytes on that side, which windows on that side all hold: a rank that
    stands in very many contexts is dealt out by its neighbours.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(batch.num_rows):
                doc, th, text = (batch.column(c)[k].as_py() for c in range(3))
                raw = text.encode("utf-8", "surrogatepass")
                found = batch.column(3)[k].values
                at, code = (found.field(f).to_numpy() for f in ("pos", "sides"))
                pos = np.concatenate([at[code & sign > 0] for sign in (BEFORE, BEHIND)])
                side = np.repeat([BEFORE, BEHIND], [(code & sign > 0).sum() for sign in (BEFORE, BEHIND)]).astype(np.int32)
                once = np.unique(pos.astype(np.int64) * 4 + side, return_index=True)[1]
                pos, side = pos[once], side[once]
                padded = np.frombuffer(b"\xff" * SIDE + raw + b"\xff" * SIDE, np.uint8)
                around = padded[pos[:, None] + np.arange(FIRST + 2 * SIDE)]
                h = _mixed_rows(around[:, SIDE : SIDE + FIRST], 1)
                near = np.where((side == BEFORE)[:, None], around[:, SIDE - HALF : SIDE], around[:, SIDE + FIRST : SIDE + FIRST + HALF])
                key = (h ^ _mixed_rows(np.ascontiguousarray(near), 6)) * U(0x9E3779B97F4A7C15) ^ side.astype(U)
                m = len(pos)
                packed = pa.FixedSizeBinaryArray.from_buffers(pa.binary(around.shape[1]), m, [None, pa.py_buffer(around.tobytes())]).cast(pa.binary())
                yield pa.RecordBatch.from_arrays(
                    [pa.array(key.view(np.int64)), pa.array(h.view(np.int64)), pa.array(np.full(m, doc)), pa.array(np.full(m, th)), pa.array(pos.astype(np.int32)), pa.array(np.full(m, len(raw))), pa.array(side), packed],
                    ["key", "rank", "doc", "text_hash", "pos", "size", "side", "context"],
                )

    lists = spots.groupBy("doc", "text_hash").agg(F.collect_list(F.struct("pos", "sides")).alias("at"))
    texts = rows.join(lists, ["doc", "text_hash"]).select("doc", "text_hash", "text", "at")
    return texts.mapInArrow(run, "key long, rank long, doc long, text_hash long, pos int, size long, side int, context binary")


def later_windows(around: DataFrame, parts: int) -> DataFrame:
    """(doc, text_hash, first, last): bytes around anchors whose windows an earlier document has."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = [b for b in batches if b.num_rows]
        if not rows:
            return
        t = pa.Table.from_batches(rows).combine_chunks()
        doc, th, pos, size, side = (t.column(c).to_numpy() for c in ("doc", "text_hash", "pos", "size", "side"))
        text = np.frombuffer(b"".join(t.column("context").to_pylist()), np.uint8).reshape(-1, FIRST + 2 * SIDE)
        gone = _windows(text, size, pos.astype(np.int64), t.column("rank").to_numpy().view(U), doc, side)
        # runs of windows: from the one that starts first to the end of the last
        edge = np.diff(np.pad(gone.astype(np.int8), ((0, 0), (1, 1))), axis=1)
        row, near = np.nonzero(edge == 1)
        far = np.nonzero(edge == -1)[1] - 1
        first, last = pos[row] - far, pos[row] - near + LENGTH
        yield pa.RecordBatch.from_arrays([pa.array(doc[row]), pa.array(th[row]), pa.array(first.astype(np.int32)), pa.array(last.astype(np.int32))], ["doc", "text_hash", "first", "last"])

    return around.repartition(parts, "key").mapInArrow(run, "doc long, text_hash long, first int, last int")


def repeated_spans(rows: DataFrame) -> DataFrame:
    """(doc, text_hash, first, last): spans of bytes in rows (doc, text_hash, text) to remove, last exclusive."""
    size = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    parts = max(shuffle_partitions(rows.sparkSession), size // TASK + 1)  # a task holds its anchors as arrays
    spots = materialize(shared_anchors(anchors(rows), parts), "suffix-anchors")
    around = materialize(contexts(rows, spots.where("sides > 0")), "suffix-contexts")
    later = materialize(later_windows(around, parts), "suffix-windows")
    whole = spots.where("sides = 0").select("doc", "text_hash", F.greatest(F.col("pos") - SIDE, F.lit(0)).alias("first"), (F.col("pos") + LENGTH).alias("last"))
    return whole.unionByName(later)


def _renumbered(pairs: DataFrame, parts: int, label: str) -> DataFrame:
    """(doc, text_hash, pos, rank) of pairs (doc, text_hash, pos, a, b): Spark sorts the pairs (a, b) and numbers them
    from 0. Positions whose pair stands in one document only leave."""
    sorted_ = pairs.repartitionByRange(parts, "a", "b").sortWithinPartitions("a", "b").withColumn("part", F.spark_partition_id())
    sorted_ = materialize(sorted_, f"{label}-sorted")
    counts = sorted_.groupBy("part").agg(F.count_distinct("a", "b").alias("n")).collect()  # one row a partition
    before, offset = {}, 0
    for row in sorted(counts, key=lambda r: r.part):
        before[row.part], offset = offset, offset + row.n
    base = F.coalesce(F.get(F.array(*[F.lit(before.get(k, 0)).cast("long") for k in range(max(before, default=0) + 1)]), F.col("part")), F.lit(0).cast("long"))
    spread = sorted_.groupBy("part", "a", "b").agg(F.min("doc").alias("low"), F.max("doc").alias("high")).where("low < high")
    number = (base + F.row_number().over(Window.partitionBy("part").orderBy("a", "b")) - 1).alias("rank")
    ranks = spread.select("a", "b", "low", number)
    return materialize(sorted_.join(ranks, ["a", "b"]).select("doc", "text_hash", "pos", "low", "rank"), f"{label}-ranks")


def doubled_spans(rows: DataFrame) -> DataFrame:
    """(doc, text_hash, first, last): the spans of repeated_spans, by prefix doubling over all positions.

    Ranks over 1, 2, 4 and 8 bytes are the bytes themselves; the rounds rank 16, 32 and, by pairs that overlap, 50 bytes.
    """
    size = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    parts = max(shuffle_partitions(rows.sparkSession), 8 * size // TASK + 1)

    def words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for doc, th, text in zip(*(b.column(k).to_pylist() for k in range(3)), strict=True):
                raw = text.encode("utf-8", "surrogatepass")
                w = _words(raw)[SIDE : SIDE + len(raw)].view(np.int64)
                for lo in range(0, len(raw) - 15 if len(raw) >= LENGTH else 0, SEGMENT):
                    pos = np.arange(lo, min(lo + SEGMENT, len(raw) - 15))
                    columns = [np.full(len(pos), doc), np.full(len(pos), th), pos.astype(np.int32), w[pos], w[pos + 8]]
                    yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], ["doc", "text_hash", "pos", "a", "b"])

    now = _renumbered(rows.select("doc", "text_hash", "text").mapInArrow(words, "doc long, text_hash long, pos int, a long, b long"), parts, "doubling-16")
    for size, step in ((32, 16), (LENGTH, LENGTH - 32)):
        later = now.select("doc", "text_hash", (F.col("pos") - step).alias("pos"), F.col("rank").alias("b"))
        pairs = now.select("doc", "text_hash", "pos", F.col("rank").alias("a")).dropDuplicates().join(later.dropDuplicates(), ["doc", "text_hash", "pos"])
        now = _renumbered(pairs, parts, f"doubling-{size}")
    return now.where("doc > low").select("doc", "text_hash", F.col("pos").alias("first"), (F.col("pos") + LENGTH).alias("last"))


def remove_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", find: Callable[[DataFrame], DataFrame] = repeated_spans) -> DataFrame:
    """(doc_id, n_bytes, n_removed, n_spans, kept: binary, kept_sha256) for every row of docs; find: repeated_spans or
    doubled_spans."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    doc_id = F.col(id_col).cast("long")
    rows = docs.select(doc_id.alias("doc_id"), F.coalesce(doc_id, F.lit(LAST)).alias("doc"), F.xxhash64(text).alias("text_hash"), text.alias("text"))
    spans = find(rows).groupBy("doc", "text_hash").agg(F.collect_list(F.struct("first", "last")).alias("spans"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = []
            for k in range(b.num_rows):
                raw = np.frombuffer(b.column(1)[k].as_py().encode("utf-8", "surrogatepass"), np.uint8)
                found = b.column(2)[k]
                depth = np.zeros(len(raw) + 1, np.int32)
                if found.is_valid and len(raw):
                    first, last = (found.values.field(f).to_numpy() for f in ("first", "last"))
                    np.add.at(depth, first, 1)
                    np.add.at(depth, np.minimum(last, len(raw)), -1)
                gone = np.cumsum(depth)[:-1] > 0
                kept = raw[~gone].tobytes()
                starts = int(gone[:1].sum() + (gone[1:] & ~gone[:-1]).sum())
                out.append((len(raw), int(gone.sum()), starts, kept, hashlib.sha256(kept).hexdigest()))
            cols = zip(*out, strict=True) if out else [[]] * 5
            types = [pa.int64(), pa.int64(), pa.int64(), pa.binary(), pa.string()]
            yield pa.RecordBatch.from_arrays([b.column(0), *(pa.array(c, t) for c, t in zip(cols, types, strict=True))], ["doc_id", "n_bytes", "n_removed", "n_spans", "kept", "kept_sha256"])

    joined = rows.join(spans, ["doc", "text_hash"], "left").select("doc_id", "text", "spans")
    return joined.mapInArrow(run, "doc_id long, n_bytes long, n_removed long, n_spans long, kept binary, kept_sha256 string")
