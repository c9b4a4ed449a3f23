"""SimHash near-dedup by multi-index hashing.

A fingerprint of 64 bits is cut into segments. Two fingerprints within the radius agree, in some segment, up to that
segment's share of the radius (pigeonhole), so each fingerprint probes a small Hamming ball around each of its
segment values, fetches the table entries there and verifies the whole distance.

Defined results: a null text counts as empty; a text without words has fingerprint zero and links like any other;
equal texts share a fingerprint; repeated rows each get their own result row; an empty table gives an empty result.
A null id is never the name of a component unless nothing else is in it. Columns other than id and text are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import block_links, connected_components, materialize, shuffle_partitions

BLOCK = 4096  # rows of one key that a block may hold before the key is split
CHUNK = 2_000_000  # pairs compared at once
SET_BLOCK, SET_CHUNK = 512, 256  # the same for whole sets of shingles
SETS = 16 << 20  # bytes of sets that a task holds, about
#: Bits of sets with Jaccard similarity 0.8 differ with p = acos(2 * 0.8 / 1.8) / pi = 0.1515: 1 - (1 - (1 - p)^16)^64
#: = 0.992 of such pairs agree in one of 64 tables of 16 bits, and 0.9997 of them differ in at most 34 of 128 bits
DIFFER, MISSED = 0.1515, 0.008
BITS, MATES = 16, 256  # least bits of a table's key, and sets that one may hold by chance before its keys grow
TABLES, NEAR = 64, 34


def fingerprint(text: str | None, words: int = 4, seed: int = 42) -> int:
    """64-bit SimHash over word shingles: a bit is set if it is set in over half of the shingles' XXH64."""
    ws = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not ws:
        return 0
    n = max(len(ws) - words + 1, 1)
    votes, xx = np.zeros(64, np.int64), xxhash.xxh64_intdigest
    for lo in range(0, n, 1 << 16):
        hi = min(n, lo + (1 << 16))
        h = np.fromiter((xx(b" ".join(ws[i : i + words]), seed) for i in range(lo, hi)), np.uint64, hi - lo)
        votes += np.unpackbits(h.astype(">u8").view(np.uint8).reshape(-1, 8), axis=1).sum(0, dtype=np.int64)
    return int.from_bytes(np.packbits(votes * 2 > n).tobytes(), "big")


def fingerprints(docs: DataFrame, words: int = 4, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, text_hash, fp: long) for every row of docs."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            fps = np.array([fingerprint(t.as_py(), words) for t in b.column(2)], np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(fps)], ["doc_id", "text_hash", "fp"])

    text = F.coalesce(F.col(text_col), F.lit(""))
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.xxhash64(text).alias("text_hash"), text.alias("text"))
    return rows.mapInArrow(run, "doc_id long, text_hash long, fp long")


def segments(radius: int) -> list[tuple[int, int, int]]:
    """(shift, width, radius) of each segment; the radii plus one add up to radius + 1, so no pair can escape."""
    m = max(1, -(-(radius + 1) // 2))
    out, shift = [], 0
    for k in range(m):
        width = 64 // m + (k < 64 % m)
        share = (radius + 1) // m + (k < (radius + 1) % m) - 1
        out.append((shift, width, share))
        shift += width
    return out


def _probes(fp: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Keys, fingerprints and whether each is a probe (else a table entry).

    A key is the segment's number and value. Of a pair one bit apart, the value without that bit probes the other's
    table entry, so only upward flips are listed.
    """
    keys, fps, probe = [], [], []
    for k, (shift, width, r) in enumerate(segments(radius)):
        value = (fp >> np.uint64(shift)) & np.uint64((1 << width) - 1)
        mark = np.uint64(k * 0x9E3779B97F4A7C15 & (1 << 64) - 1)  # keeps the segments' keys apart
        keys.append(value ^ mark)
        fps.append(fp)
        probe.append(np.zeros(len(fp), bool))
        for bit in range(width if r == 1 else 0):
            low = (value >> np.uint64(bit)) & np.uint64(1) == 0
            keys.append((value[low] | np.uint64(1 << bit)) ^ mark)
            fps.append(fp[low])
            probe.append(np.ones(int(low.sum()), bool))
    return np.concatenate(keys), np.concatenate(fps), np.concatenate(probe)


def fingerprint_links(fps: DataFrame, radius: int = 4, count: int | None = None) -> DataFrame:
    """(src, dst: long): links that connect all fingerprints of fps (fp: long, distinct) within the radius.

    One task holds rows of many keys; keys with more than BLOCK rows are split and connected as block_links says. A task
    returns stars of the links it verified, never all pairs of a bucket.
    """
    if any(r > 1 for *_, r in segments(radius)):
        raise ValueError("a segment's Hamming ball has radius 1 at most")

    def enumerate_balls(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            whole = b.column(0).to_numpy(zero_copy_only=False).view(np.uint64)
            for lo in range(0, len(whole), 50_000):
                k, f, p = _probes(whole[lo : lo + 50_000], radius)
                yield pa.RecordBatch.from_arrays([pa.array(k.view(np.int64)), pa.array(f.view(np.int64)), pa.array(p)], ["key", "node", "probe"])

    def near(t: dict[str, np.ndarray]) -> Callable[[np.ndarray, np.ndarray], np.ndarray]:
        fp = t["node"].view(np.uint64)  # bits of signed numbers count otherwise
        return lambda a, b: np.bitwise_count(fp[a] ^ fp[b]) <= radius

    balls = fps.select("fp").mapInArrow(enumerate_balls, "key long, node long, probe boolean")
    per_fp = sum(1 + w / 2 * (r == 1) for _, w, r in segments(radius))
    count = fps.count() if count is None else count
    parts = max(shuffle_partitions(fps.sparkSession), int(count * per_fp / 400_000) + 1)
    return block_links(balls, near, BLOCK, parts, CHUNK, "simhash")


def _groups(docs: DataFrame, radius: int, words: int, id_col: str, text_col: str) -> tuple[DataFrame, DataFrame]:
    """Rows (doc_id, text_hash, fp) of docs, and (fp, group, component_id) of their distinct fingerprints."""
    each = materialize(fingerprints(docs, words, id_col, text_col), "simhash-docs", narrow=True)
    fps = materialize(each.groupBy("fp").agg(F.min("doc_id").alias("first")), "simhash-distinct")
    nodes = connected_components(fingerprint_links(fps, radius), "simhash")
    named = nodes.join(fps, nodes["node"] == fps["fp"]).groupBy("component").agg(F.min("first").alias("component_id"))
    linked = nodes.join(named, "component").select(F.col("node").alias("fp"), F.col("component").alias("group"), "component_id")
    of = fps.join(linked, "fp", "left").select("fp", F.coalesce("group", "fp").alias("group"), F.coalesce("component_id", "first").alias("component_id"))
    return each, materialize(of, "simhash-components")


def near_duplicate_components(docs: DataFrame, radius: int = 4, words: int = 4, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, fingerprint: 16 hex digits, component_id) for every row of docs."""
    each, of = _groups(docs, radius, words, id_col, text_col)
    return each.join(of, "fp").select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


def shingles(text: str | None, words: int = 5, seed: int = 42) -> np.ndarray:
    """XXH64 of the distinct word shingles, ascending; a shorter text is one shingle, one without words has none."""
    ws = (text or "").encode("utf-8", "surrogatepass").lower().split()
    n, xx = max(len(ws) - words + 1, 1) if ws else 0, xxhash.xxh64_intdigest
    return np.unique(np.fromiter((xx(b" ".join(ws[i : i + words]), seed) for i in range(n)), np.uint64, n))


def signature(hashes: np.ndarray) -> np.ndarray:
    """TABLES x 16 + 128 SimHash bits of a set of shingles, as bytes: each 64 bits from hashes mixed anew."""
    size, votes = TABLES // 4 + 2, np.zeros((TABLES // 4 + 2) * 64, np.int64)
    salt = np.arange(1, size + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    for lo in range(0, len(hashes), 255):  # as many votes as a byte can count
        x = hashes[lo : lo + 255, None] + salt
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        votes += np.add.reduce(np.unpackbits((x ^ (x >> np.uint64(31))).view(np.uint8), axis=1), axis=0, dtype=np.uint8)
    return np.packbits(votes * 2 > len(hashes))


def similar(t: dict[str, np.ndarray], least: float) -> Callable[[np.ndarray, np.ndarray], np.ndarray]:
    """Whether pairs of rows have a Jaccard similarity of least or more, of their whole sets `hashes`; a and b hold 128
    SimHash bits, which pairs have to be near in first."""
    sets = [np.frombuffer(h, np.uint64) for h in t["hashes"]]
    size, x, y = np.array([len(s) for s in sets]), t["a"].view(np.uint64), t["b"].view(np.uint64)

    def near(i: np.ndarray, j: np.ndarray) -> np.ndarray:
        hit = np.bitwise_count(x[i] ^ x[j]) + np.bitwise_count(y[i] ^ y[j]) <= NEAR
        hit &= np.minimum(size[i], size[j]) >= least * np.maximum(size[i], size[j]) - 1e-9
        for k in np.flatnonzero(hit):
            u, v = sets[i[k]], sets[j[k]]
            both = len(np.intersect1d(u, v, assume_unique=True)) if i[k] != j[k] else len(u)
            hit[k] = both >= least * (len(u) + len(v) - both) - 1e-9
        return hit

    return near


def tables_for(count: int) -> list[np.ndarray]:
    """Which of the TABLES x 16 bits each table's key takes, for count sets.

    Up to MATES x 2^16 sets, each 16 successive bits are a table. Beyond, keys grow with the logarithm of the count, so
    that a key holds no more than MATES unrelated sets, and there are so many tables of bits chosen at random that as few
    pairs are missed; the bits of one pair differ a little more or less than on average, so p has a margin.
    """
    width = max(BITS, math.ceil(math.log2(max(count, 1) / MATES)))
    size = TABLES * 16
    if width == BITS:
        return list(np.arange(size).reshape(TABLES, BITS))
    margin = math.sqrt(DIFFER * (1 - DIFFER) / size)
    many = math.ceil(math.log(MISSED) / math.log(1 - (1 - DIFFER - margin) ** width))
    r = np.random.default_rng(11)
    return [np.sort(r.choice(size, width, replace=False)) for _ in range(many)]


def table_keys(bits: np.ndarray, tables: list[np.ndarray]) -> np.ndarray:
    """(rows, tables) keys of rows of packed bits; the table's number is part of the key."""
    flat = np.unpackbits(bits, axis=1)
    out = np.empty((len(bits), len(tables)), np.int64)
    for k, own in enumerate(tables):
        out[:, k] = flat[:, own] @ (1 << np.arange(len(own), dtype=np.int64)) + (k << 40)
    return out


def candidate_links(nodes: DataFrame, tables: list[np.ndarray] | None = None) -> DataFrame:
    """(src, dst: long): links that connect nodes (node: long, bits: binary) which agree in a table and are near."""
    count = nodes.count()
    tables = tables_for(count) if tables is None else tables

    def enumerate_tables(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["key", "node", "probe", "a", "b"]
        for batch in batches:
            node = batch.column(0).to_numpy(zero_copy_only=False)
            for lo in range(0, len(node), 5_000):
                bits = np.frombuffer(b"".join(x.as_py() for x in batch.column(1)[lo : lo + 5_000]), np.uint8).reshape(-1, TABLES * 2 + 16)
                key = table_keys(bits[:, : TABLES * 2], tables)
                check = np.ascontiguousarray(bits[:, TABLES * 2 :]).view(np.int64)
                each, a, b = (np.repeat(c, len(tables)) for c in (node[lo : lo + 5_000], check[:, 0], check[:, 1]))
                rows = [key.ravel(), each, np.zeros(len(each), bool), a, b]
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in rows], names)

    def near(t: dict[str, np.ndarray]) -> Callable[[np.ndarray, np.ndarray], np.ndarray]:
        x, y = t["a"].view(np.uint64), t["b"].view(np.uint64)  # bits of signed numbers count otherwise
        return lambda i, j: np.bitwise_count(x[i] ^ x[j]) + np.bitwise_count(y[i] ^ y[j]) <= NEAR

    entries = nodes.select("node", "bits").mapInArrow(enumerate_tables, "key long, node long, probe boolean, a long, b long")
    parts = max(shuffle_partitions(nodes.sparkSession), count * len(tables) // 400_000 + 1)
    return block_links(entries, near, BLOCK, parts, CHUNK, "simhash-coarse")


def _similar(docs: DataFrame, least: float, words: int, id_col: str, text_col: str) -> tuple[DataFrame, DataFrame]:
    """Rows (doc_id, text_hash, fp) of docs, fp naming the set of shingles, and (fp, group) of the distinct sets."""

    def name(hashes: np.ndarray) -> int:
        return int(np.uint64(xxhash.xxh64_intdigest(hashes.tobytes())).astype(np.int64))

    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            fps, bits = [], []
            for t in b.column(2):
                s = shingles(t.as_py(), words)
                fps.append(name(s))
                bits.append(signature(s).tobytes())
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(fps, pa.int64()), pa.array(bits, pa.binary())], ["doc_id", "text_hash", "fp", "bits"])

    text = F.coalesce(F.col(text_col), F.lit(""))
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.xxhash64(text).alias("text_hash"), text.alias("text"))
    each = materialize(rows.mapInArrow(sign, "doc_id long, text_hash long, fp long, bits binary"), "simhash-signed", narrow=True)
    pick = F.min(F.struct(F.col("doc_id").isNull(), F.col("doc_id").alias("d"), F.col("text_hash").alias("h"))).alias("pick")
    nodes = materialize(each.groupBy(F.col("fp").alias("node")).agg(F.any_value("bits").alias("bits"), pick), "simhash-nodes")
    coarse = connected_components(candidate_links(nodes), "simhash-coarse")
    # one text of each set that has a candidate is cut into its shingles once more
    wanted = nodes.join(coarse, "node").select(F.col("pick.d").alias("d"), F.col("pick.h").alias("h"), "component", "bits")
    texts = rows.join(wanted, rows["doc_id"].eqNullSafe(wanted["d"]) & (rows["text_hash"] == wanted["h"])).select("component", "text", "bits")

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        columns = ["key", "node", "probe", "a", "b", "hashes"]
        for b in batches:
            for lo in range(0, b.num_rows, 1024):
                part = b.slice(lo, 1024)
                sets = [shingles(t.as_py(), words) for t in part.column(1)]
                check = np.array([np.frombuffer(x.as_py()[-16:], np.int64) for x in part.column(2)]).reshape(-1, 2)
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), pa.array([name(s) for s in sets], pa.int64()), pa.array(np.zeros(len(sets), bool)), pa.array(check[:, 0].copy()), pa.array(check[:, 1].copy()), pa.array([s.tobytes() for s in sets], pa.binary())], columns
                )

    sets = materialize(texts.mapInArrow(cut, "key long, node long, probe boolean, a long, b long, hashes binary"), "simhash-sets")
    held = sets.agg(F.sum(F.octet_length("hashes"))).first()[0] or 0
    parts = max(shuffle_partitions(docs.sparkSession), int(held / SETS) + 1)
    links = block_links(sets, lambda t: similar(t, least), SET_BLOCK, parts, SET_CHUNK, "simhash-sets")
    groups = connected_components(links, "simhash-groups").select(F.col("node").alias("fp"), F.col("component").alias("group"))
    of = nodes.select(F.col("node").alias("fp")).join(groups, "fp", "left").select("fp", F.coalesce("group", "fp").alias("group"))
    return each.drop("bits"), materialize(of, "simhash-groups")


def drop_near_duplicates(docs: DataFrame, least: float = 0.8, words: int = 5, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row, all columns, of each group of near-duplicates: that with the smallest id (null last), then text hash.

    Groups are connected by pairs whose whole sets of word shingles have a Jaccard similarity of least or more.
    Candidates agree in the SimHash bits of a table and within NEAR of 128 others; the tables find over 99 % of the
    pairs at similarity 0.8 and more of the closer ones. Every link is then verified on the sets.
    """
    each, of = _similar(docs, least, words, id_col, text_col)
    best = F.min(F.struct(F.col("doc_id").isNull().alias("late"), F.col("doc_id").alias("d"), F.col("text_hash").alias("h")))
    stay = each.join(of, "fp").groupBy("group").agg(best.alias("b"))
    key = lambda c: F.coalesce(c, F.lit(-(1 << 63)))
    stay = stay.select(key(F.col("b.d")).alias("_d"), F.col("b.h").alias("_h")).distinct()
    rows = docs.withColumns({"_d": key(F.col(id_col).cast("long")), "_h": F.xxhash64(F.coalesce(F.col(text_col), F.lit("")))})
    # join and window share one partitioning, so the texts are shuffled once
    once = Window.partitionBy("_d", "_h").orderBy(*[F.col(c) for c in docs.columns if c != text_col])
    return rows.join(stay, ["_d", "_h"], "left_semi").withColumn("_n", F.row_number().over(once)).where(F.col("_n") == 1).select(*docs.columns)
