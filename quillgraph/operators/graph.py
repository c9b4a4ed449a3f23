"""Operators on the citation graph: nodes and edges are DataFrames."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import constants as C
from ..sources.shared import materialize


def latest(df: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    """WIN02: one row of each key, the first in the order."""
    return df.withColumn("_n", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where("_n = 1").drop("_n")


def linked_entities(mentions: DataFrame) -> DataFrame:
    """JOIN10/AGG26: (canonical, id, entity_type, weight, n): one entity of each canonical form of rows (seq, id,
    canonical, entity_type, weight): the first one's id, and type and weight of the heaviest (the first of equals)."""
    heavy = F.min_by(F.struct("entity_type", "weight"), F.struct(-F.col("weight"), F.col("seq"))).alias("h")
    return mentions.groupBy("canonical").agg(F.min_by("id", "seq").alias("id"), heavy, F.count(F.lit(1)).alias("n")).select("canonical", "id", "h.entity_type", "h.weight", "n")


def known_ends(edges: DataFrame, sources: DataFrame, targets: DataFrame) -> DataFrame:
    """PRED03/PRED04/JOIN04: edges (source, target) of which both ends are nodes (id)."""
    return edges.join(sources.select(F.col("id").alias("source")), "source", "left_semi").join(targets.select(F.col("id").alias("target")), "target", "left_semi")


def incident(edges: DataFrame) -> DataFrame:
    """GRA03: (node, direction, other): out- and in-edges of each node; a loop counts as both."""
    out = edges.select(F.col("source").alias("node"), F.lit("out").alias("direction"), F.col("target").alias("other"))
    return out.unionByName(edges.select(F.col("target").alias("node"), F.lit("in").alias("direction"), F.col("source").alias("other")))


def transition(edges: DataFrame) -> DataFrame:
    """WIN08/AGG22/GRA10: edges with p: weight by the out-weight of the source, guarded against 0. The out-weight is
    rounded, so that p doesn't depend on the order in which weights were added."""
    total = F.round(F.sum("weight").over(Window.partitionBy("source")), 9)
    return edges.withColumn("p", F.col("weight") / F.greatest(total, F.lit(1e-10)))


def constrained(edges: DataFrame, types: DataFrame, patterns: DataFrame) -> DataFrame:
    """PRED07/GRA09: edges whose types form an allowed pattern, with their transition probability."""
    s = types.select(F.col("id").alias("source"), F.col("entity_type").alias("source_type"))
    t = types.select(F.col("id").alias("target"), F.col("entity_type").alias("target_type"))
    kept = edges.join(s, "source").join(t, "target").join(F.broadcast(patterns), ["source_type", "relation_type", "target_type"], "left_semi")
    return transition(kept.select("source", "target", "relation_type", "weight"))


def random_walk(edges: DataFrame, seeds: DataFrame, restart: float = 0.15, steps: int = 20, tolerance: float | None = 1e-6) -> DataFrame:
    """GRA07: (id, score): random walk with restart from seeds (id), at most `steps` rounds, scores summing to 1.

    With tolerance None all rounds run. Every fifth round is written out, so that plans stay short.
    """
    move = materialize(transition(edges).select("source", "target", "p"), "moves")
    n = seeds.count()
    start = seeds.select("id", F.lit(1.0 / max(n, 1)).alias("s0"))
    now = start.select("id", F.col("s0").alias("score"))
    for k in range(steps):
        moved = now.join(move, now["id"] == move["source"]).groupBy(F.col("target").alias("id")).agg((F.sum(F.col("score") * F.col("p")) * (1 - restart)).alias("m"))
        new = moved.join(start, "id", "full").select("id", (F.coalesce("m", F.lit(0.0)) + restart * F.coalesce("s0", F.lit(0.0))).alias("score"))
        if tolerance is not None or k % 5 == 4:
            new = materialize(new, "walk")
        if tolerance is not None:
            gap = new.withColumnRenamed("score", "a").join(now.withColumnRenamed("score", "b"), "id", "full")
            d = gap.select(F.sqrt(F.sum(F.pow(F.coalesce("a", F.lit(0.0)) - F.coalesce("b", F.lit(0.0)), F.lit(2)))).alias("d")).first().d
            if d is None or d < tolerance:
                now = new
                break
        now = new
    sums = now.agg(F.sum("score").alias("total"))
    return now.join(F.broadcast(sums)).select("id", (F.col("score") / F.greatest("total", F.lit(1e-10))).alias("score"))


def reachable(edges: DataFrame, starts: DataFrame, most: int | None = None) -> DataFrame:
    """GRA08: (start, id) of all nodes that directed paths of up to `most` edges lead to from starts (id).

    Only pairs that are reached are held, so ask for the starts that are needed. Each round's new pairs are written
    once and found ones aren't written again; a node that is reached keeps no path.
    """
    edge = materialize(edges.select(F.col("source").alias("at"), F.col("target").alias("next")).distinct(), "reach-edges")
    rounds = [materialize(starts.select(F.col("id").alias("start"), F.col("id").alias("at")).distinct(), "frontier")]
    found: list[DataFrame] = []
    while (most is None or len(found) < most) and not rounds[-1].isEmpty():
        step = rounds[-1].join(edge, "at").select("start", F.col("next").alias("at")).distinct()
        for old in found:
            step = step.join(old, ["start", "at"], "left_anti")
        rounds.append(materialize(step, "frontier"))
        found.append(rounds[-1])
        if len(found) == 8:  # few enough tables to look into
            found = [materialize(reduce(DataFrame.unionByName, found), "reached")]
            most = None if most is None else most - 7
    if not found:
        found = [rounds[0].limit(0)]
    return reduce(DataFrame.unionByName, found).select("start", F.col("at").alias("id"))


def split(df: DataFrame, train: float = 0.8, val: float = 0.1, test: float = 0.1, id_col: str = "id") -> DataFrame:
    """SPL01: df with column split, of exact sizes floor(n * share), the rest for test.

    Rows are ordered by the md5 of their id. Their places come from counts of 4096 leading hash values, so no task
    sorts more than one value's rows.
    """
    if abs(train + val + test - 1) > 1e-6 or not all(0 <= x <= 1 for x in (train, val, test)):
        raise ValueError("shares must lie between 0 and 1 and add up to 1")
    rows = df.withColumn("_h", F.md5(F.col(id_col).cast("string"))).withColumn("_b", F.substring("_h", 1, 3))
    counts = rows.groupBy("_b").agg(F.count(F.lit(1)).alias("_c"))
    before = Window.orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)  # 4096 rows at most
    offsets = counts.select("_b", F.coalesce(F.sum("_c").over(before), F.lit(0)).alias("_o"), F.sum("_c").over(Window.partitionBy()).alias("_n"))
    place = F.row_number().over(Window.partitionBy("_b").orderBy("_h", id_col)) + F.col("_o")
    a, b = F.floor(F.col("_n") * train), F.floor(F.col("_n") * train) + F.floor(F.col("_n") * val)
    return rows.join(F.broadcast(offsets), "_b").withColumn("_p", place).withColumn("split", F.when(F.col("_p") <= a, "train").when(F.col("_p") <= b, "val").otherwise("test")).drop("_h", "_b", "_o", "_n", "_p")


def same_split(edges: DataFrame, splits: DataFrame) -> DataFrame:
    """JOIN05: edges (source, target) whose ends are in one split, with that split."""
    s = splits.select(F.col("id").alias("source"), F.col("split").alias("split"))
    t = splits.select(F.col("id").alias("target"), F.col("split").alias("other"))
    return edges.join(s, "source").join(t, "target").where("split = other").drop("other")


def allowed(column: Column, domain: tuple[str, ...] = C.RELATION_TYPES) -> Column:
    return F.lower(column).isin(*domain)
