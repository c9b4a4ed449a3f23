"""The trie of conversation prefixes, by prefix-doubling names.

Each turn (role, text) gets a dense name. Two neighbouring blocks of 2^k turns that start at a multiple of 2^(k+1) make a
block of twice the size, and each different pair of names gets a dense name again; so there are as many rounds as the
longest conversation's length has bits. The prefix of d turns is the prefix without d's lowest bit and the one aligned
block that this bit stands for: prefixes are named by the number of bits of d, one join a round. Conversations share a
prefix if and only if its name at that length is the same, so a node is a (depth, name), and grouping by it gives its
members. Sums over subtrees double as well: each node adds up what lies below it within 2^k steps and passes it to its
ancestor 2^k steps up. No walk goes turn by turn, and no list of members is gathered but for the digest of the
conversations that end at a node: those are sorted by Spark, joined to strings block by block, and only the strings of a
node meet in one task, one after the other.

Turns are ordered by turn (null first), then role and text, in one sort by range, so that a conversation with very many
turns is spread over tasks. Joins meet hot names (a turn that a third of all conversations open with) on one side only,
where adaptive execution splits them; groups are combined before they are shuffled.

Defined results: a null role or text is empty; a row without conv_id belongs to no conversation and is left out;
repeated rows are turns of their own; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import materialize, shuffle_partitions

EMPTY = hashlib.sha256(b"").hexdigest()
BLOCK_BITS = 12  # conversations that end at a node are joined to strings by up to 2^BLOCK_BITS
HEAD = 64  # characters of a role or text by which rows are dealt into ranges


def dense(df: DataFrame, name: str, label: str) -> DataFrame:
    """The rows of df, numbered from 0 without gaps in column `name`. Where df is sorted, the numbers follow its order."""
    rows = materialize(df.withColumn("_m", F.monotonically_increasing_id()), label)
    part = F.shiftright("_m", 33).alias("_p")  # as many as there were tasks
    before = rows.groupBy(part).count().select("_p", (F.sum("count").over(Window.orderBy("_p")) - F.col("count")).alias("_before"))
    rows = rows.withColumn("_p", F.shiftright("_m", 33)).join(F.broadcast(before), "_p")
    return rows.withColumn(name, F.col("_before") + F.col("_m").bitwiseAND((1 << 33) - 1)).drop("_m", "_p", "_before")


def named(rows: DataFrame, keys: list[str], name: str, label: str) -> DataFrame:
    """rows with a dense name of their keys in place of these; written."""
    names = dense(rows.select(*keys).distinct(), name, f"{label}-names")
    return materialize(rows.join(names, keys).drop(*keys), label)


def ordered_turns(said: DataFrame) -> DataFrame:
    """(conv_id, at, key, size): each turn's place in its conversation, a digest of role and text, and the text's bytes."""
    rows = said.select(F.col("conv_id").cast("long").alias("conv_id"), "turn", F.coalesce(F.col("role").cast("string"), F.lit("")).alias("role"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    rows = rows.where(F.col("conv_id").isNotNull())
    first = F.col("turn").asc_nulls_first()
    rows = rows.repartitionByRange(shuffle_partitions(said.sparkSession), "conv_id", first, F.left("role", F.lit(HEAD)), F.left("text", F.lit(HEAD)))
    key = F.unhex(F.sha2(F.concat(F.length("role").cast("string"), F.lit(":"), F.col("role"), F.col("text")), 256))
    rows = rows.sortWithinPartitions("conv_id", first, "role", "text").select("conv_id", key.alias("key"), F.octet_length("text").cast("long").alias("size"))
    rows = dense(rows, "place", "trie-turns")
    start = rows.groupBy("conv_id").agg(F.min("place").alias("start"))
    return rows.join(start, "conv_id").select("conv_id", (F.col("place") - F.col("start")).alias("at"), "key", "size")


def rebuilt(turns: DataFrame, period: int, most: int) -> tuple[DataFrame, DataFrame]:
    """(conversations, turns) where each conversation c opens with up to crc32(c) % most turns of c - c % period.

    turns: (conv_id, at, ...). Gives (conv_id, n_turns) and the turns in their new places."""
    c, base = F.col("conv_id"), (F.col("conv_id") - F.col("conv_id") % period).alias("base")
    sizes = turns.groupBy("conv_id").agg(F.count("*").alias("n"))
    convs = sizes.select(c, "n", base, (F.crc32(c.cast("string").cast("binary")) % most).alias("h"))
    there = sizes.select(c.alias("base"), F.col("n").alias("n_base"))
    convs = materialize(convs.join(there, "base", "left").withColumn("shared", F.least(F.col("h"), F.coalesce("n_base", F.lit(0)))), "trie-conversations")
    own = turns.join(convs.select("conv_id", "h", "shared"), "conv_id").where(F.col("at") >= F.col("h")).withColumn("at", F.col("at") - F.col("h") + F.col("shared"))
    opening = turns.where((F.col("at") < most) & (c % period == 0)).withColumnRenamed("conv_id", "base")
    opening = opening.join(convs.select("conv_id", "base", "shared"), "base").where(F.col("at") < F.col("shared"))
    rows = own.select(*turns.columns).unionByName(opening.select(*turns.columns))
    return convs.select("conv_id", (F.col("shared") + F.greatest(F.col("n") - F.col("h"), F.lit(0))).alias("n_turns")), rows


def block_names(turns: DataFrame, longest: int) -> DataFrame:
    """(conv_id, depth, block): for each place d of a conversation the name of the aligned block that ends there and is as
    long as d's lowest bit. turns: (conv_id, at, name)."""
    level, size = turns.select("conv_id", "at", "name"), 1
    last = []
    while size <= max(longest, 1):
        even = F.col("at") % 2 == 0
        last.append(level.where(even).select("conv_id", ((F.col("at") + 1) * size).alias("depth"), F.col("name").alias("block")))
        size *= 2
        if size <= longest:
            pairs = level.groupBy("conv_id", F.shiftright("at", 1).alias("at")).agg(F.max(F.when(even, F.col("name"))).alias("a"), F.max(F.when(~even, F.col("name"))).alias("b"))
            level = named(materialize(pairs.where(F.col("b").isNotNull()), "trie-pairs"), ["a", "b"], "name", "trie-blocks")
    out = last[0]
    for more in last[1:]:
        out = out.unionByName(more)
    return out


def prefix_names(turns: DataFrame, longest: int) -> DataFrame:
    """(conv_id, depth, name) of every prefix of one turn or more; written."""
    last = materialize(block_names(turns, longest), "trie-last")
    level = last.where(F.bit_count("depth") == 1).withColumnRenamed("block", "name")
    out, bits = level, 2
    while (1 << bits) - 1 <= longest:
        before = level.select("conv_id", F.col("depth").alias("rest"), F.col("name").alias("a"))
        rows = last.where(F.bit_count("depth") == bits).withColumn("rest", F.col("depth").bitwiseAND(F.col("depth") - 1))
        rows = materialize(rows.join(before, ["conv_id", "rest"]).select("conv_id", "depth", "a", F.col("block").alias("b"), F.col("depth").alias("d")), "trie-prefix-pairs")
        level = named(rows, ["d", "a", "b"], "name", "trie-prefixes")
        out = out.unionByName(level)
        bits += 1
    return out


def subtree_sums(nodes: DataFrame, values: list[str], deepest: int) -> DataFrame:
    """nodes (node, up: the parent's node, ...) with the sum over its subtree in place of each value."""
    state, reach = nodes, 1
    while reach <= deepest:
        below = state.where(F.col("up").isNotNull()).groupBy(F.col("up").alias("node")).agg(*[F.sum(v).alias(f"_{v}") for v in values])
        above = state.select(F.col("node").alias("up"), F.col("up").alias("_up"))
        state = state.join(above, "up", "left").drop("up").withColumnRenamed("_up", "up").join(below, "node", "left")
        state = state.withColumns({v: F.col(v) + F.coalesce(f"_{v}", F.lit(0)) for v in values}).select(*nodes.columns)
        state = materialize(state, "trie-sums")
        reach *= 2
    return state


def id_digests(ends: DataFrame) -> DataFrame:
    """(node, ends_sha256): the digest of each node's conv_ids in ascending order, joined by commas. ends: (node, conv_id)."""
    parts = shuffle_partitions(ends.sparkSession)
    rows = ends.repartitionByRange(parts, "node", "conv_id").sortWithinPartitions("node", "conv_id")
    rows = materialize(rows.withColumn("m", F.monotonically_increasing_id()), "trie-ends")
    blocks = rows.groupBy("node", F.shiftright("m", BLOCK_BITS).alias("block")).agg(F.sort_array(F.collect_list("conv_id")).alias("ids"))
    blocks = blocks.select("node", "block", F.array_join(F.col("ids").cast("array<string>"), ",").alias("ids"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        open_, sha, done = None, None, []
        for b in batches:
            for node, ids in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                if node != open_:
                    if sha:
                        done.append((open_, sha.hexdigest()))
                    open_, sha = node, hashlib.sha256(ids.encode())
                else:
                    sha.update(b"," + ids.encode())
            if len(done) > 10_000:
                yield pa.RecordBatch.from_arrays([pa.array(x) for x in zip(*done, strict=True)], ["node", "ends_sha256"])
                done = []
        if sha:
            done.append((open_, sha.hexdigest()))
            yield pa.RecordBatch.from_arrays([pa.array(x) for x in zip(*done, strict=True)], ["node", "ends_sha256"])

    blocks = blocks.repartition(parts, "node").sortWithinPartitions("node", "block").select("node", "ids")
    return blocks.mapInArrow(run, "node long, ends_sha256 string")


def trie(convs: DataFrame, turns: DataFrame) -> DataFrame:
    """The nodes of the trie of conversations (conv_id, n_turns) with turns (conv_id, at, key, size).

    (conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256): conv_id is the smallest
    member, saved_tokens the sum over the subtree of (n_convs - 1) times the bytes of the node's last text."""
    convs = materialize(convs, "trie-convs")
    turns = named(materialize(turns, "trie-rebuilt"), ["key"], "name", "trie-turn-names")
    longest = convs.agg(F.max("n_turns")).first()[0] or 0
    prefixes = materialize(prefix_names(turns, longest).join(turns.select("conv_id", (F.col("at") + 1).alias("depth"), "size"), ["conv_id", "depth"]), "trie-all-prefixes")
    nodes = prefixes.groupBy("depth", "name").agg(F.min("conv_id").alias("conv_id"), F.count("*").alias("n_convs"), F.max("size").alias("size"))
    root = convs.agg(F.min("conv_id").alias("conv_id"), F.count("*").alias("n_convs")).where(F.col("n_convs") > 0)
    root = root.select(F.lit(0).cast("long").alias("depth"), F.lit(0).cast("long").alias("name"), "conv_id", "n_convs", F.lit(0).cast("long").alias("size"))
    nodes = materialize(dense(nodes.unionByName(root), "node", "trie-node-rows"), "trie-nodes")

    # the parent holds the smallest member too, one turn earlier
    above = nodes.where(F.col("depth") > 1).select("node", F.col("conv_id"), (F.col("depth") - 1).alias("depth"))
    above = above.join(prefixes.select("conv_id", "depth", "name"), ["conv_id", "depth"]).select("node", "depth", "name")
    above = above.unionByName(nodes.where(F.col("depth") == 1).select("node", F.lit(0).cast("long").alias("depth"), F.lit(0).cast("long").alias("name")))
    named_above = nodes.select("depth", "name", F.col("node").alias("up"), F.col("conv_id").alias("parent_conv_id"))
    above = above.join(named_above, ["depth", "name"]).select("node", "up", "parent_conv_id")
    linked = materialize(nodes.join(above, "node", "left"), "trie-linked")
    children = linked.where(F.col("up").isNotNull()).groupBy(F.col("up").alias("node")).agg(F.count("*").alias("n_children"))
    linked = linked.join(children, "node", "left").withColumn("n_children", F.coalesce("n_children", F.lit(0)).cast("long"))
    linked = materialize(linked, "trie-counted")

    own = linked.select("node", "up", (F.col("n_children") == 0).cast("long").alias("n_leaves"), ((F.col("n_convs") - 1) * F.col("size")).alias("saved_tokens"))
    sums = subtree_sums(own, ["n_leaves", "saved_tokens"], longest).drop("up")
    at_end = convs.where(F.col("n_turns") > 0).join(prefixes.select("conv_id", F.col("depth").alias("n_turns"), "name"), ["conv_id", "n_turns"])
    at_end = at_end.unionByName(convs.where(F.col("n_turns") == 0).withColumn("name", F.lit(0).cast("long")))
    ends = at_end.withColumnRenamed("n_turns", "depth").join(nodes.select("depth", "name", "node"), ["depth", "name"]).select("node", "conv_id")
    out = linked.join(sums, "node").join(id_digests(ends), "node", "left")
    columns = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens"]
    return out.select(*[F.col(c).cast("long").alias(c) for c in columns], F.coalesce("ends_sha256", F.lit(EMPTY)).alias("ends_sha256"))


def conversation_trie(said: DataFrame, period: int = 5, most: int = 9) -> DataFrame:
    """The trie of rebuilt conversations: each one shares its opening with the first of its group of `period` ids."""
    turns = materialize(ordered_turns(said), "trie-ordered")
    return trie(*rebuilt(turns, period, most))
