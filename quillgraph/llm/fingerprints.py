"""Document fingerprints: 64-bit SimHash, and all fingerprints within a Hamming radius.

Terms are lower-cased words; a term votes once per occurrence with the weight of its length, on each bit for or against
by its XXH64. A bit is set where the weight for it is over half. `within_radius` finds all pairs of distinct
fingerprints within the radius from permuted block tables: 64 bits in blocks, one table for each choice of blocks that
radius differing bits leave untouched somewhere, keyed by those blocks.

Everything is DataFrame functions. Two of the 64 votes share a long, so a text may weigh up to 2^31.

Defined results: a null text counts as empty; a text without words has fingerprint zero; equal texts have equal
fingerprints; repeated rows each get their own row; null ids come last in the descending order of ids, and
rows of one id come by the XXH64 of their text; a single
document is its own next; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

from itertools import combinations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import materialize, shuffle_partitions

GAPS = r"[\x20\x09-\x0D]+"


def votes(rows: DataFrame, keys: list[str], text: Column) -> DataFrame:
    """(keys, fp: long): the fingerprint of the text of each group of equal keys; keys must tell rows apart."""
    words = rows.select(*keys, F.explode_outer(F.split(F.lower(text), GAPS)).alias("word"))
    words = words.select(*keys, F.xxhash64("word").alias("h"), F.length("word").cast("long").alias("w"))
    pair = (1 << 32) | 1
    lanes = [F.expr(f"sum((shiftrightunsigned(h, {i}) & {pair}L) * w)").alias(f"v{i}") for i in range(32)]
    sums = words.groupBy(*keys).agg(F.sum("w").alias("all"), *lanes)
    low = " | ".join(f"if((v{i} & {(1 << 32) - 1}L) * 2 > all, {1 << i}L, 0L)" for i in range(32))
    high = " | ".join(f"if(shiftrightunsigned(v{i}, 32) * 2 > all, shiftleft({1 << i}L, 32), 0L)" for i in range(32))
    return sums.select(*keys, F.expr(f"coalesce(({low}) | ({high}), 0L)").alias("fp"))


def likeness(a: Column, b: Column) -> Column:
    """Share of equal bits, 0 to 1."""
    return 1 - F.bit_count(a.bitwiseXOR(b)) / 64


def hex_digits(fp: Column) -> Column:
    return F.lpad(F.lower(F.hex(fp)), 16, "0")


def _bucket(value: Column, bounds: list[int]) -> Column:
    """How many of the sorted bounds lie below value (0 for null), by binary search."""
    if not bounds:
        return F.lit(0)
    table, steps = F.array(*[F.lit(b) for b in bounds]), [1 << k for k in range(len(bounds).bit_length() - 1, -1, -1)]

    def step(low: Column, s: Column) -> Column:
        return F.when((low + s <= len(bounds)) & (F.coalesce(F.get(table, low + s - 1), F.lit(0)) < value), low + s).otherwise(low)

    return F.reduce(F.array(*[F.lit(s) for s in steps]), F.lit(0), step)


def with_next(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(bucket, place, doc_id, text, next_id, next_text): each row with the next by descending id (null ids last, rows of
    one id by hash of the text), the first after the last.

    Ids are dealt by range into buckets, and an id with more rows than a bucket should hold has buckets of its own, by
    ranges of the hash; so one shuffle brings all texts together and no task sorts all. The last row of a bucket gets
    the first of the next one by a join of one row a bucket.
    """
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    rows = rows.withColumn("h", F.xxhash64("text"))
    parts = min(2000, 4 * shuffle_partitions(docs.sparkSession))
    found = rows.agg(F.percentile_approx("doc_id", [k / parts for k in range(1, parts)], 20_000).alias("b"), F.count(F.lit(1)).alias("n")).first()
    fair = 2 * found.n // parts + 1
    many = {r.doc_id: r["count"] // fair + 1 for r in rows.groupBy("doc_id").count().where(F.col("count") > fair).collect()}  # parts / 2 rows at most
    own = [i for i in many if i is not None]
    bounds = sorted({*(found.b or []), *own, *(i - 1 for i in own if i > -(1 << 63))})
    pieces = F.when(F.col("doc_id").isNull(), F.lit(many.get(None, 1))).otherwise(F.lit(1))
    if own:
        pieces = F.coalesce(F.element_at(F.create_map(*[F.lit(x) for i in own for x in (i, many[i])]), F.col("doc_id")), pieces)
    piece = F.least(F.floor((F.col("h") / float(1 << 64) + 0.5) * pieces).cast("int"), pieces - 1)
    at = F.when(F.col("doc_id").isNull(), F.lit(-1)).otherwise(_bucket(F.col("doc_id"), bounds))
    rows = rows.withColumn("bucket", at.cast("long") * (1 << 20) - piece)  # the order is by descending bucket
    there = sorted(r.bucket for r in rows.select("bucket").distinct().collect())  # about parts rows
    if not there:
        return rows.select("bucket", F.lit(1).alias("place"), "doc_id", "text", F.col("doc_id").alias("next_id"), F.col("text").alias("next_text"))
    order = Window.partitionBy("bucket").orderBy(F.col("doc_id").desc_nulls_last(), "h", "text")
    last = F.lead(F.lit(False), 1, True).over(order).alias("last")
    placed = rows.select("bucket", F.row_number().over(order).alias("place"), "doc_id", "text", F.lead("doc_id").over(order).alias("next_id"), F.lead("text").over(order).alias("next_text"), last)
    before = F.create_map(*[F.lit(x) for b, above in zip(there, [*there[1:], there[0]], strict=True) for x in (b, above)])
    firsts = placed.where("place = 1").select(F.element_at(before, F.col("bucket")).alias("bucket"), F.col("doc_id").alias("first_id"), F.col("text").alias("first_text"))
    joined = placed.join(firsts, "bucket")
    then = lambda a, b: F.when(F.col("last"), F.col(a)).otherwise(F.col(b)).alias(b)
    return joined.select("bucket", "place", "doc_id", "text", then("first_id", "next_id"), then("first_text", "next_text"))


def _meeting(fps: DataFrame, radius: int, spare: int) -> DataFrame:
    """(l.a, l.n, r.b, r.m) of pairs a < b of rows fps (fp, n) within the radius, each from the first table that holds it."""
    blocks = radius + spare
    edges = [64 * k // blocks for k in range(blocks + 1)]
    block = [((1 << edges[k + 1]) - (1 << edges[k])) for k in range(blocks)]
    signed = lambda x: x - (1 << 64) if x >= 1 << 63 else x
    masks = [signed(sum(block[k] for k in chosen)) for chosen in combinations(range(blocks), spare)]
    table = F.array(*[F.lit(m) for m in masks])
    keyed = fps.select("fp", "n", F.posexplode(F.transform(table, lambda m: F.col("fp").bitwiseAND(m))).alias("t", "key"))
    a, b = keyed.select(F.col("fp").alias("a"), "n", "t", "key"), keyed.select(F.col("fp").alias("b"), F.col("n").alias("m"), "t", "key")
    apart = F.col("a").bitwiseXOR(F.col("b"))
    earlier = F.exists(F.slice(table, 1, F.col("l.t")), lambda m: apart.bitwiseAND(m) == 0)
    on = (F.col("l.t") == F.col("r.t")) & (F.col("l.key") == F.col("r.key")) & (F.col("a") < F.col("b")) & (F.bit_count(apart) <= radius) & ~earlier
    return a.alias("l").join(b.alias("r"), on)


def within_radius(fps: DataFrame, radius: int = 3, spare: int = 3) -> DataFrame:
    """(a, b): all pairs a < b of the distinct fingerprints fps (fp: long) that differ in at most radius bits.

    64 bits are cut into radius + spare blocks; any pair within the radius agrees in some `spare` of them. A pair is
    returned by the first table that holds it. Documents of equal fingerprints are one; neighbour_counts doesn't list pairs.
    """
    return _meeting(fps.select("fp", F.lit(1).alias("n")), radius, spare).select("a", "b")


def neighbour_counts(fps: DataFrame, radius: int = 3, spare: int = 3) -> DataFrame:
    """(fp, n_near) for the distinct fingerprints of rows (fp): how many other rows lie within the radius of one.

    Pairs are added up in the tasks that find them, so what is shuffled grows with the fingerprints."""
    counts = materialize(fps.groupBy("fp").agg(F.count(F.lit(1)).alias("n")), "fingerprint-counts")
    either = F.explode(F.array(F.struct(F.col("a").alias("fp"), F.col("m").alias("k")), F.struct(F.col("b").alias("fp"), F.col("n").alias("k")))).alias("e")
    near = _meeting(counts, radius, spare).select(either).groupBy(F.col("e.fp").alias("fp")).agg(F.sum("e.k").alias("others"))
    return counts.join(near, "fp", "left").select("fp", (F.col("n") - 1 + F.coalesce("others", F.lit(0))).alias("n_near"))


def fingerprint(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, fingerprint: long) for every row of docs."""
    rows = docs.select(F.monotonically_increasing_id().alias("row"), F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    return votes(rows, ["row", "doc_id"], F.col("text")).select("doc_id", F.col("fp").alias("fingerprint"))


def edited_fingerprints(docs: DataFrame, radius: int = 3, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Fingerprints of each text and of the text with its second half taken from the next document, and how alike
    they are to each other and to the next document's; n_near counts the other documents within the radius."""
    rows = with_next(docs, id_col, text_col)
    n = F.length("text")
    half = F.floor(n / 2).cast("int")
    edited = F.concat(F.substring("text", F.lit(1), n - half), F.substring("next_text", F.lit(1), half))
    rows = rows.select(
        "bucket",
        "place",
        "doc_id",
        "next_id",
        F.xxhash64("text").alias("text_hash"),
        F.xxhash64("next_text").alias("next_hash"),
        n.cast("long").alias("n_chars"),
        F.explode(F.array(F.struct(F.lit(0).alias("kind"), F.col("text").alias("t")), F.struct(F.lit(1).alias("kind"), edited.alias("t")))).alias("x"),
    )
    keys = ["bucket", "place", "doc_id", "next_id", "text_hash", "next_hash", "n_chars", "kind", "sha"]
    rows = rows.select(*keys[:-2], "x.kind", F.when(F.col("x.kind") == 1, F.sha2("x.t", 256)).alias("sha"), F.col("x.t").alias("t"))
    fps = votes(rows, keys, F.col("t")).groupBy(*keys[:-2]).agg(
        F.max(F.when(F.col("kind") == 0, F.col("fp"))).alias("fp"), F.max(F.when(F.col("kind") == 1, F.col("fp"))).alias("edited_fp"), F.max("sha").alias("edited_sha256")
    )
    fps = materialize(fps, "fingerprints")
    near = materialize(neighbour_counts(fps.select("fp"), radius), "fingerprint-near").withColumnRenamed("fp", "of")
    named = fps.groupBy(F.col("doc_id").alias("nid"), F.col("text_hash").alias("nhash")).agg(F.max("fp").alias("next_fp"))
    joined = fps.join(named, F.col("next_id").eqNullSafe(F.col("nid")) & (F.col("next_hash") == F.col("nhash")), "left").join(near, F.col("fp") == F.col("of"))
    return joined.select(
        "doc_id",
        "n_chars",
        "edited_sha256",
        hex_digits(F.col("fp")).alias("fingerprint"),
        hex_digits(F.col("edited_fp")).alias("edited_fingerprint"),
        likeness(F.col("fp"), F.col("edited_fp")).alias("near_edited"),
        likeness(F.col("fp"), F.col("next_fp")).alias("near_next"),
        "n_near",
    )
