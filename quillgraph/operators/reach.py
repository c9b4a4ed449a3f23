"""GRA08: whether directed paths lead between asked pairs of nodes, by labels; a search only where labels are unsure.

Every node gets, for a few random orders of all nodes, the first node that it reaches and the first that reaches it (itself
included). If a path leads from s to t, then s reaches all that t reaches, so in no order s's first node comes after t's,
and in no order t's first ancestor after s's; where one does, there is no path. Where the first node that s reaches
in some order is the first one that reaches t in some order, there is a path. Cycles need no care: all nodes of one have
the same labels. Labels are minima over edges, repeated until none changes, and only nodes whose labels changed are passed
on; rounds are as many as the longest shortest path to a first node.

Pairs that labels leave open are searched from s, edge by edge, through nodes from which labels don't exclude t. What is held
are asked pairs and the nodes that their search has met, never all pairs that are reachable.

How many nodes each node reaches is counted within connected parts of the graph: a part of few edges is one row and counted
inside its task, so its pairs are never written; parts of more edges are searched for blocks of starts, one after another.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..sources.shared import Scratch, materialize
from .graph import reachable

ORDERS = 4


def _least(names: list[str]) -> list[Column]:
    return [F.min(n).alias(n) for n in names]


def _firsts(edges: DataFrame, nodes: DataFrame, names: list[str], scratch: Scratch) -> DataFrame:
    """(id, *names): for each order the first node, as (place, id), that each node reaches over edges (a, b)."""
    state = changed = scratch.write(nodes.select("id", *[F.struct(F.xxhash64("id", F.lit(k)).alias("place"), "id").alias(n) for k, n in enumerate(names)]), "reach-labels")
    while True:
        told = edges.join(changed.withColumnRenamed("id", "b"), "b").groupBy(F.col("a").alias("id")).agg(*_least(names))
        old = state.withColumnsRenamed({n: f"_{n}" for n in names})
        better = told.join(old, "id").where(" OR ".join(f"{n} < _{n}" for n in names))
        last, changed = changed, scratch.write(better.select("id", *[F.least(n, f"_{n}").alias(n) for n in names]), "reach-changed")
        if last is not state:
            scratch.drop(last)
        if changed.isEmpty():
            scratch.drop(changed)
            return state
        was, state = state, scratch.write(state.unionByName(changed).groupBy("id").agg(*_least(names)), "reach-labels")
        scratch.drop(was)


def labels(edges: DataFrame, orders: int = ORDERS) -> DataFrame:
    """(id, to0, ..., from0, ...) of every node of edges (source, target): the first nodes it reaches, and that reach it."""
    scratch = Scratch(edges.sparkSession)
    there = scratch.write(edges.select(F.col("source").alias("a"), F.col("target").alias("b")).distinct(), "reach-edges")
    nodes = there.select(F.col("a").alias("id")).unionByName(there.select(F.col("b").alias("id"))).distinct()
    to, from_ = [f"to{k}" for k in range(orders)], [f"from{k}" for k in range(orders)]
    back = there.select(F.col("b").alias("a"), F.col("a").alias("b"))
    ahead, behind = _firsts(there, nodes, to, scratch), _firsts(back, nodes, from_, scratch)
    out = materialize(ahead.join(behind, "id"), "reach-all-labels")
    scratch.drop(there, ahead, behind)
    return out


def _excluded(s: str, t: str, orders: int) -> Column:
    """Whether labels of struct columns s and t leave no path from s to t."""
    out = F.lit(False)
    for k in range(orders):
        out = out | (F.col(f"{s}.to{k}") > F.col(f"{t}.to{k}")) | (F.col(f"{t}.from{k}") > F.col(f"{s}.from{k}"))
    return out


def _certain(s: str, t: str, orders: int) -> Column:
    """Whether labels show a node that s reaches and that reaches t."""
    out = F.lit(False)
    for k in range(orders):
        for j in range(orders):
            out = out | (F.col(f"{s}.to{k}.id") == F.col(f"{t}.from{j}.id"))
    return out


def has_path(pairs: DataFrame, edges: DataFrame, orders: int = ORDERS, known: DataFrame | None = None) -> DataFrame:
    """(source, target, path) of the distinct pairs (source, target): whether a path of one edge or more of edges (source, target)
    leads from source to target. A node leads to itself over a cycle only; an unknown node leads nowhere. known: the edges'
    labels, where they have been made."""
    known = labels(edges, orders) if known is None else known
    label = F.struct(*[c for c in known.columns if c != "id"])
    of = lambda key, name: known.select(F.col("id").alias(key), label.alias(name))
    asked = materialize(pairs.select("source", "target").distinct(), "reach-pairs")
    both = asked.join(of("source", "s"), "source").join(of("target", "t"), "target")
    same = F.col("source") == F.col("target")
    told = both.select("source", "target", "t", F.when(same, F.lit(None).cast("boolean")).when(_certain("s", "t", orders), True).when(_excluded("s", "t", orders), False).alias("path"))
    told = materialize(told, "reach-told")
    found = [told.where("path").select("source", "target")]
    # the rest step by step: (source, target, t, at) through nodes that may lead on
    edge = materialize(edges.select(F.col("source").alias("at"), F.col("target").alias("next")).distinct(), "reach-steps")
    front = told.where("path IS NULL").select("source", "target", "t", F.col("source").alias("at"))
    met = materialize(front.select("source", "target", "at").limit(0), "reach-met")
    while True:
        step = materialize(front.join(edge, "at").select("source", "target", "t", F.col("next").alias("at")).dropDuplicates(["source", "target", "at"]), "reach-front")
        if step.isEmpty():
            break
        step = step.join(of("at", "s"), "at")
        ends = step.select("source", "target", ((F.col("at") == F.col("target")) | _certain("s", "t", orders)).alias("end"), "at", "t", _excluded("s", "t", orders).alias("out"))
        ends = materialize(ends, "reach-ends")
        here = materialize(ends.where("end").select("source", "target").distinct(), "reach-found")
        found.append(here)
        left = ends.where("NOT end AND NOT out").join(here, ["source", "target"], "left_anti").join(met, ["source", "target", "at"], "left_anti")
        front = materialize(left.select("source", "target", "t", "at"), "reach-left")
        met = materialize(met.unionByName(front.select("source", "target", "at")), "reach-met")
    all_ = found[0]
    for more in found[1:]:
        all_ = all_.unionByName(more)
    return asked.join(all_.distinct().withColumn("path", F.lit(True)), ["source", "target"], "left").withColumn("path", F.coalesce("path", F.lit(False)))


def components(edges: DataFrame, scratch: Scratch) -> DataFrame:
    """(id, c) of every node of distinct edges (a, b): the smallest node that edges, followed either way, connect it with.

    Each round takes the least label of the neighbours and then that label's own, so rounds grow with the logarithm of the
    longest way rather than with the way."""
    both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    state = scratch.write(both.groupBy(F.col("a").alias("id")).agg(F.least(F.first("a"), F.min("b")).alias("c")).withColumn("moved", F.lit(True)), "part-labels")
    while True:
        near = both.join(state.select(F.col("id").alias("b"), "c"), "b").groupBy(F.col("a").alias("id")).agg(F.min("c").alias("near"))
        hooked = scratch.write(state.join(near, "id").select("id", F.col("c").alias("was"), F.least("c", "near").alias("c")), "part-hooked")
        jump = hooked.select(F.col("id").alias("c"), F.col("c").alias("far"))
        now = hooked.join(jump, "c").select("id", F.least("c", "far").alias("c"), (F.least("c", "far") != F.col("was")).alias("moved"))
        now = scratch.write(now, "part-labels")
        scratch.drop(state, hooked)
        state = now
        if state.where("moved").isEmpty():
            return state


def _counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(start, reached) of rows (a, b), the ends of a part's edges by turns: sets of nodes are bits of whole numbers."""
    for batch in batches:
        starts, reached = [], []
        for a, b in zip(batch["a"].to_pylist(), batch["b"].to_pylist(), strict=True):
            place = {name: k for k, name in enumerate(dict.fromkeys(a + b))}
            to = dict.fromkeys(a, 0)
            for x, y in zip(a, b, strict=True):
                to[x] |= 1 << place[y]
            out = {place[x]: bits for x, bits in to.items()}
            for x in to:
                seen, left = 0, to[x]
                while left:  # one node after another whose edges haven't been followed
                    low = left & -left
                    seen |= low
                    left = (left | out.get(low.bit_length() - 1, 0)) & ~seen
                starts.append(x)
                reached.append(seen.bit_count())
        yield pa.RecordBatch.from_arrays([pa.array(starts, pa.string()), pa.array(reached, pa.int64())], ["start", "reached"])


def reached_counts(edges: DataFrame, most: int = 1000, at_once: int = 1000) -> DataFrame:
    """GRA08: (start, reached) for every source of edges (source, target): how many nodes paths of one edge or more lead to.

    Parts of up to `most` edges are counted in a task; in larger ones `at_once` starts are searched at a time, so what is
    held grows with at_once times the nodes, not with all pairs."""
    scratch = Scratch(edges.sparkSession)
    edge = scratch.write(edges.select(F.col("source").alias("a"), F.col("target").alias("b")).distinct(), "part-edges")
    label = components(edge, scratch)
    placed = edge.join(label.select(F.col("id").alias("a"), "c"), "a")
    sizes = scratch.write(label.join(edge.groupBy(F.col("a").alias("id")).agg(F.count(F.lit(1)).alias("k")), "id").groupBy("c").agg(F.sum("k").alias("k")).where(F.col("k") > most), "part-sizes")
    small = placed.join(sizes, "c", "left_anti").groupBy("c").agg(F.collect_list(F.struct("a", "b")).alias("e"))
    out = materialize(small.select(F.col("e.a").alias("a"), F.col("e.b").alias("b")).mapInArrow(_counts, "start string, reached long"), "part-counts")
    if not sizes.isEmpty():
        large = scratch.write(placed.join(sizes, "c", "left_semi").select(F.col("a").alias("source"), F.col("b").alias("target")), "part-large")
        starts = large.select(F.col("source").alias("id")).distinct()
        blocks = -(-starts.count() // at_once)
        for k in range(blocks):
            some = starts.where(F.pmod(F.xxhash64("id"), F.lit(blocks)) == k)
            out = out.unionByName(materialize(reachable(large, some).groupBy("start").agg(F.count(F.lit(1)).alias("reached")), "part-counts", narrow=True))
        scratch.drop(large)
    scratch.drop(edge, label, sizes)
    return out
