"""Helpers shared by the training-data operators: links within keys, in blocks, and connected components."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..sources.shared import materialize, shared_path  # noqa: F401

PART = 256  # elements of an array that a running total takes at once


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def free_name(df: DataFrame, name: str) -> str:
    """name, or a longer one that no column of df has."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body(value), with value computed once however often body names it."""
    return F.get(F.transform(F.array(value), body), 0)


def before_each(values: Column, kind: str, merge: Callable[[Column, Column], Column], zero: Column) -> Column:
    """For each element of an array, merge (an associative function) over all elements before it.

    Folded in parts of PART elements and then over the parts, so an array of m elements is copied some m / PART times less
    often than by one fold.
    """
    none = F.array().cast(f"array<{kind}>")
    start = F.struct(zero.alias("at"), none.alias("out"))
    step = lambda a, x: F.struct(merge(a["at"], x).alias("at"), F.concat(a["out"], F.array(a["at"])).alias("out"))

    def joined(parts: Column) -> Column:
        bases = F.aggregate(F.transform(parts, lambda p: p["at"]), start, step, lambda a: a["out"])
        return F.flatten(F.zip_with(parts, bases, lambda p, b: F.transform(p["out"], lambda v: merge(b, v))))

    def split(all_: Column) -> Column:
        starts = F.sequence(F.lit(0), F.greatest(F.size(all_) - 1, F.lit(0)), F.lit(PART))
        return let(F.transform(starts, lambda i: F.aggregate(F.slice(all_, i + 1, PART), start, step)), joined)

    return let(values, split)


def expand(left: np.ndarray, start: np.ndarray, count: np.ndarray, chunk: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Pairs of each of left with start, start + 1 ... (count of them), chunk pairs at once; a row's pairs may be cut."""
    ends = np.cumsum(count)
    total = int(ends[-1]) if len(ends) else 0
    for lo in range(0, total, chunk):
        at = np.arange(lo, min(total, lo + chunk))
        row = np.searchsorted(ends, at, side="right")
        yield left[row], start[row] + at - (ends[row] - count[row])


def local_components(n: int, u: np.ndarray, v: np.ndarray, labels: np.ndarray | None = None) -> np.ndarray:
    """Smallest index reachable from each of n nodes over edges (u, v), joined to what labels already connect."""
    lab = np.arange(n) if labels is None else labels
    while True:
        a, b = lab[u], lab[v]
        open_ = a != b
        if not open_.any():
            return lab
        u, v, a, b = u[open_], v[open_], a[open_], b[open_]
        np.minimum.at(lab, np.maximum(a, b), np.minimum(a, b))
        while True:
            up = lab[lab]
            if np.array_equal(up, lab):
                break
            lab = up


def star_edges(names: np.ndarray, lab: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Edges that connect each component: its first name with each other one. names are sorted, so tasks that meet the
    same nodes return the same edges."""
    child = lab != np.arange(len(lab))
    return names[lab[child]], names[child]


def connect(lab: np.ndarray, a: np.ndarray, b: np.ndarray, near: Callable[[np.ndarray, np.ndarray], np.ndarray], node: np.ndarray) -> np.ndarray:
    """lab after linking the rows (a, b) that are near; rows whose nodes are connected already aren't compared."""
    open_ = lab[node[a]] != lab[node[b]]
    a, b = a[open_], b[open_]
    hit = near(a, b)
    return local_components(len(lab), node[a[hit]], node[b[hit]], lab)


def connect_groups(group: np.ndarray, probe: np.ndarray, node: np.ndarray, size: int, near: Callable[[np.ndarray, np.ndarray], np.ndarray], chunk: int) -> np.ndarray:
    """Component of each of `size` nodes over all near pairs of rows of a group, of which one at least is no probe.

    All rows of a group are first compared with its first row. Those that are near it are connected, so only the others
    are compared further, with every row: a group of copies costs as many comparisons as it has rows.
    """
    lab, here = np.arange(size), np.arange(len(group))
    order = np.lexsort((probe, group))
    first = np.flatnonzero(np.r_[True, np.diff(group[order]) != 0]) if len(order) else np.zeros(0, int)
    which = np.repeat(np.arange(len(first)), np.diff(np.r_[first, len(order)]))
    met = np.zeros(len(group), bool)
    for lo in range(0, len(order), chunk):
        a, b = order[lo : lo + chunk], order[first[which[lo : lo + chunk]]]
        met[a] = near(a, b)
        met[b] = True
        hit = met[a]
        lab = local_components(size, node[a[hit]], node[b[hit]], lab)
    order = order[np.lexsort((~met[order], probe[order], which))]  # tables near the first, other tables, probes
    near_first, asks = met[order], probe[order]
    tables = np.bincount(which, weights=~asks, minlength=len(first)).astype(int)
    done = np.bincount(which, weights=~asks & near_first, minlength=len(first)).astype(int)
    skip = np.where(near_first, done[which], 0)
    start = first[which] + skip
    count = np.where(asks, tables[which] - skip, np.where(near_first, 0, here - start))
    some = count > 0
    for a, b in expand(here[some], start[some], count[some], chunk):
        lab = connect(lab, order[a], order[b], near, node)
    return lab


def contracted(edges: DataFrame, label: str) -> DataFrame:
    """Fewer edges (src < dst) with the same components: each node keeps its edge to its smallest neighbour, which
    takes over the node's edges to the others. Edges that many tasks found fall together; repeated while they shrink."""
    low, high = F.least("src", "dst").alias("src"), F.greatest("src", "dst").alias("dst")
    edges = materialize(edges.where(F.col("src") != F.col("dst")).select(low, high).distinct(), f"{label}-edges")
    before, now = None, edges.count()
    while before is None or now < 0.9 * before:
        m = F.min("src").over(Window.partitionBy("dst"))
        kept = edges.select("src", "dst", m.alias("m")).select(F.col("m").alias("src"), F.when(F.col("src") == F.col("m"), F.col("dst")).otherwise(F.col("src")).alias("dst"))
        edges = materialize(kept.distinct(), f"{label}-edges")
        before, now = now, edges.count()
    return edges


def connected_components(edges: DataFrame, label: str = "components") -> DataFrame:
    """(node, component) for each node of edges (src, dst: long): the smallest node reachable.

    Min-label hooking with pointer jumping; each round is three joins on narrow rows and a min by key, written to
    the shared folder. Rounds grow with the logarithm of the longest path. Nothing reaches the driver but a sum.
    """
    both = contracted(edges, label)
    both = materialize(both.unionByName(both.select(F.col("dst").alias("src"), F.col("src").alias("dst"))), f"{label}-both")
    parent = both.groupBy("src").agg(F.least(F.col("src"), F.min("dst")).alias("p")).withColumnRenamed("src", "v")
    before = None
    while True:
        parent = materialize(parent, f"{label}-round")
        total = parent.agg(F.sum(F.col("p").cast("decimal(38,0)"))).first()[0]
        if total is None or total == before:
            return parent.select(F.col("v").alias("node"), F.col("p").alias("component"))
        before = total
        up = parent.select(F.col("v").alias("p"), F.col("p").alias("g"))
        jumped = parent.join(up, "p")
        near = (
            both.join(jumped.select(F.col("v").alias("dst"), "g"), "dst").groupBy("src").agg(F.min("g").alias("m")).withColumnRenamed("src", "v")
        )
        offers = jumped.join(near, "v").select(
            F.explode(F.array(F.struct(F.col("v"), F.least("g", "m").alias("p")), F.struct(F.col("p").alias("v"), F.least("g", "m").alias("p")))).alias("o")
        )
        parent = offers.select("o.*").groupBy("v").agg(F.min("p").alias("p"))


def block_links(entries: DataFrame, near: Callable[[dict[str, np.ndarray]], Callable[[np.ndarray, np.ndarray], np.ndarray]], block: int, parts: int, chunk: int, label: str) -> DataFrame:
    """(src, dst: long): links that connect all near pairs of rows of entries (key, node: long, probe: boolean, ...) that
    have a key in common, but for pairs of probes.

    A key with more than `block` rows is split into blocks. Each block is connected by itself first; then only rows
    outside the key's largest component are compared with the other blocks, and only with rows of other components. So
    a hot group that is one component is read once, whatever its size, and no pair of it is returned.
    near(columns) gives a function of two arrays of rows. Tasks return stars, never the pairs they found.
    """
    payload = [c for c in entries.columns if c not in ("key", "node", "probe")]
    hot = entries.groupBy("key").count().where(F.col("count") > block).select("key", F.ceil(F.col("count") / block).cast("int").alias("blocks"))
    hot = materialize(hot, f"{label}-hot")
    split = not hot.isEmpty()
    blocks = F.coalesce("blocks", F.lit(1)) if split else F.lit(1)
    dealt = entries.join(hot, "key", "left") if split else entries
    dealt = dealt.select("*", F.pmod(F.xxhash64("node"), blocks).cast("int").alias("block"))

    def table(batches: Iterator[pa.RecordBatch]) -> dict[str, np.ndarray] | None:
        rows = [b for b in batches if b.num_rows]
        t = pa.Table.from_batches(rows) if rows else None
        return t and {c: t.column(c).to_numpy() for c in t.column_names}

    def inside(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if t := table(batches):
            names, node = np.unique(t["node"], return_inverse=True)
            _, group = np.unique(t["key"].view(np.uint64) * np.uint64(0x9E3779B97F4A7C15) ^ t["block"].astype(np.uint64), return_inverse=True)
            lab = connect_groups(group, t["probe"].astype(bool), node, len(names), near(t), chunk)
            u, v = star_edges(names, lab)
            yield pa.RecordBatch.from_arrays([pa.array(u), pa.array(v)], ["src", "dst"])

    columns = ["key", "block", "node", "probe", *payload]
    edges = dealt.select(*columns).repartition(parts, "key", "block").mapInArrow(inside, "src long, dst long")
    if not split:
        return edges
    edges = materialize(edges, f"{label}-inside")
    parent = connected_components(edges, f"{label}-inside").withColumnRenamed("component", "lab")
    rows = dealt.where(F.col("blocks").isNotNull()).join(parent, "node", "left")
    rows = materialize(rows.withColumn("lab", F.coalesce("lab", "node")), f"{label}-hot-rows")
    most = rows.groupBy("key", "lab").count().groupBy("key").agg(F.max_by("lab", F.struct("count", "lab")).alias("most"), F.sum("count").alias("all"), F.max("count").alias("same"))
    most = most.where(F.col("all") > F.col("same")).select("key", "most", F.ceil((F.col("all") - F.col("same")) / block).cast("int").alias("chunks"))
    rows = rows.join(materialize(most, f"{label}-most"), "key")
    each = lambda n: F.explode(F.sequence(F.lit(0), n - 1))
    told = rows.withColumn("chunk", each(F.col("chunks"))).withColumn("asks", F.lit(False))
    ask = rows.where(F.col("lab") != F.col("most")).withColumn("chunk", F.pmod(F.xxhash64("node", F.lit(1)), F.col("chunks")).cast("int"))
    ask = ask.drop("block").withColumn("block", each(F.col("blocks"))).withColumn("asks", F.lit(True))

    def across(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if t := table(batches):
            names, node = np.unique(t["lab"], return_inverse=True)
            close, probe, asks = near(t), t["probe"].astype(bool), t["asks"].astype(bool)
            mixed = (t["key"].view(np.uint64) * np.uint64(0x9E3779B97F4A7C15) ^ t["block"].astype(np.uint64)) * np.uint64(0x9E3779B97F4A7C15) ^ t["chunk"].astype(np.uint64)
            order = np.lexsort((asks, mixed))
            first = np.flatnonzero(np.r_[True, np.diff(mixed[order]) != 0])
            which = np.repeat(np.arange(len(first)), np.diff(np.r_[first, len(order)]))
            others = np.bincount(which, weights=~asks[order], minlength=len(first)).astype(int)
            at, lab = np.flatnonzero(asks[order]), np.arange(len(names))
            for a, b in expand(at, first[which[at]], others[which[at]], chunk):
                a, b = order[a], order[b]
                some = ~(probe[a] & probe[b])
                lab = connect(lab, a[some], b[some], close, node)
            u, v = star_edges(names, lab)
            yield pa.RecordBatch.from_arrays([pa.array(u), pa.array(v)], ["src", "dst"])

    columns = ["key", "block", "chunk", "asks", "lab", "node", "probe", *payload]
    crossed = told.select(*columns).unionByName(ask.select(*columns)).repartition(parts, "key", "block", "chunk").mapInArrow(across, "src long, dst long")
    return edges.unionByName(materialize(crossed, f"{label}-across"))
