"""Mixing sources to target weights by pivotal dependent rounding.

Every document of a source starts with the same expected number of copies, target / source size. Its whole part is
kept; the fractions are rounded together. Within a group, a running document meets the next one and words move between
the two, in a random direction chosen so that each keeps its expectation, until one of them has a whole number of
copies; that one is settled and the other runs on. Each group leaves one residual, and the residuals are grouped and
rounded again, level by level, down to one per source, which goes to the nearer side. So a source's words miss its
target by half its largest document at most. All draws are hashes of ids and a seed, so reruns agree.

Defined results: a null text has no words; documents without words take nothing; a null source is a source of its own
that comes last; repeated rows (same id, source and size) are settled together and each get the same copies; an empty
table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import materialize

FAN = 128  # documents or residuals that meet in one group, on average
WORD = r"[^\x20\x09-\x0D]+"


def uniform(*parts: Column) -> Column:
    """A number from 0 up to 1 drawn by hash."""
    return F.xxhash64(*parts).bitwiseAND(F.lit((1 << 53) - 1)).cast("double") / float(1 << 53)


def source_targets(sizes: DataFrame, weights: tuple[float, ...] = (5, 2, 1), share: float = 1.5, most: float = 2.0) -> DataFrame:
    """(source, source_size, target) from rows (source, size).

    Sources in code-point order, null last, take the weights in turn and share `share` times all words. A target stops
    at `most` times its source's size; what lies above is shared out again by weight among the others. In the order of
    cap over weight, a source is capped if its share of what the earlier caps leave reaches its own cap.
    """
    each = sizes.groupBy("source").agg(F.coalesce(F.sum("size"), F.lit(0)).alias("source_size"))
    turn = (F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1) % len(weights)
    each = each.withColumn("w", F.element_at(F.array(*[F.lit(float(w)) for w in weights]), turn + 1)).withColumn("cap", F.col("source_size") * most)
    all_ = Window.partitionBy()
    by_cap = Window.orderBy(F.col("cap") / F.col("w"), F.col("source").asc_nulls_last())
    before = by_cap.rowsBetween(Window.unboundedPreceding, -1)
    each = each.withColumn("place", F.row_number().over(by_cap)).withColumn(
        "level",
        (F.sum("source_size").over(all_) * share - F.coalesce(F.sum("cap").over(before), F.lit(0.0))) / (F.sum("w").over(all_) - F.coalesce(F.sum("w").over(before), F.lit(0.0))),
    )
    each = each.withColumn("capped", F.col("level") * F.col("w") >= F.col("cap"))
    level = F.min_by(F.when(~F.col("capped"), F.col("level")), F.when(~F.col("capped"), F.col("place"))).over(all_)
    return each.select("source", "source_size", F.when(F.col("capped"), F.col("cap")).otherwise(level * F.col("w")).alias("target"))


UNIT = "struct<doc_id:bigint,size:bigint,words:bigint,p:double>"
SETTLED = "array<struct<doc_id:bigint,size:bigint,up:boolean>>"


def _fold(units: Column, seed: int) -> Column:
    """struct<run: the residual, out: the settled> of an array of units, by pivotal rounding in array order."""

    def settled(unit: Column, up: Column) -> Column:
        return F.array(F.struct(unit["doc_id"].alias("doc_id"), unit["size"].alias("size"), up.alias("up")))

    def left(unit: Column, words: Column) -> Column:
        return F.struct(unit["doc_id"].alias("doc_id"), unit["size"].alias("size"), unit["words"].alias("words"), (words / unit["words"]).alias("p"))

    def meet(acc: Column, x: Column) -> Column:
        run = acc["run"]
        has, room = run["p"] * run["words"], (1 - run["p"]) * run["words"]
        x_has, x_room = x["p"] * x["words"], (1 - x["p"]) * x["words"]
        gain, loss = F.least(room, x_has), F.least(has, x_room)
        up = uniform(run["doc_id"], run["size"], x["doc_id"], x["size"], F.lit(seed)) * (gain + loss) < loss
        run_done = F.when(up, gain == room).otherwise(loss == has)
        kept = F.when(run_done, left(x, F.when(up, x_has - gain).otherwise(x_has + loss))).otherwise(left(run, F.when(up, has + gain).otherwise(has - loss)))
        done = F.when(run_done, settled(run, up)).otherwise(settled(x, ~up))
        return F.struct(kept.alias("run"), F.concat(acc["out"], done).alias("out"))

    def step(acc: Column, x: Column) -> Column:
        begun = F.struct(x.cast(UNIT).alias("run"), acc["out"].alias("out"))
        return F.when(acc["run"].isNull(), begun).otherwise(meet(acc, x))

    return F.aggregate(units, F.struct(F.lit(None).cast(UNIT).alias("run"), F.array().cast(SETTLED).alias("out")), step)


def round_copies(units: DataFrame, seed: int = 0) -> DataFrame:
    """(source, doc_id, size, up) for units (source, doc_id, size, words, p), 0 < p < 1: which are rounded up."""
    rest = materialize(units, "mixing-units")
    groups = max(1, -(-rest.count() // FAN))
    out = []
    while True:
        unit = F.struct(F.xxhash64("doc_id", "size", F.lit(seed)).alias("h"), "doc_id", "size", "words", "p")
        bucket = F.pmod(F.xxhash64("doc_id", "size", F.lit(seed + 1 + len(out))), F.lit(groups))
        units_in_order = F.transform(F.sort_array(F.collect_list(unit)), lambda u: u.dropFields("h").cast(UNIT))
        met = rest.groupBy("source", bucket.alias("bucket")).agg(units_in_order.alias("units"))
        met = materialize(met.select("source", _fold(F.col("units"), seed).alias("f")).select("source", "f.run", "f.out"), "mixing-level")
        out.append(met.select("source", F.explode("out").alias("o")).select("source", "o.*"))
        left = met.select("source", "run.*")
        open_ = (F.col("p") > 0) & (F.col("p") < 1)
        out.append(left.where(~open_).select("source", "doc_id", "size", (F.col("p") >= 1).alias("up")))
        rest = left.where(open_)
        if groups == 1:
            out.append(rest.select("source", "doc_id", "size", (F.col("p") >= 0.5).alias("up")))
            return reduce(DataFrame.unionByName, out)
        groups = -(-groups // FAN)


def mix(
    docs: DataFrame, weights: tuple[float, ...] = (5, 2, 1), share: float = 1.5, most: float = 2.0, seed: int = 0, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source"
) -> DataFrame:
    """(doc_id, source, size, source_size, target, copies) for every row of docs."""
    size = F.coalesce(F.regexp_count(F.col(text_col), F.lit(WORD)), F.lit(0)).cast("long")
    sizes = materialize(docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(source_col).alias("source"), size.alias("size")), "mixing-sizes", narrow=True)
    targets = materialize(source_targets(sizes, weights, share, most), "mixing-targets").withColumnRenamed("source", "of")
    ratio = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0)
    each = sizes.join(targets, F.col("source").eqNullSafe(F.col("of"))).drop("of").withColumn("ratio", F.when(ratio > most - 1e-12, F.lit(float(most))).otherwise(ratio))
    units = (
        each.groupBy("source", "doc_id", "size", "ratio")
        .agg((F.count(F.lit(1)) * F.col("size")).alias("words"))
        .select("source", "doc_id", "size", "words", (F.col("ratio") - F.floor("ratio")).alias("p"))
        .where((F.col("words") > 0) & (F.col("p") > 0))
    )
    ups = round_copies(units, seed).select(F.col("source").alias("s"), F.col("doc_id").alias("d"), F.col("size").alias("n"), "up")
    same = F.col("source").eqNullSafe(F.col("s")) & F.col("doc_id").eqNullSafe(F.col("d")) & (F.col("size") == F.col("n"))
    copies = (F.floor("ratio") + F.coalesce(F.col("up").cast("int"), F.lit(0))).cast("int")
    return each.join(ups, same, "left").select("doc_id", "source", "size", "source_size", "target", copies.alias("copies"))
