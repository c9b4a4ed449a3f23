"""Vector functions on array<double> columns."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)


def norm(a: Column) -> Column:
    return F.sqrt(dot(a, a))


def cosine(a: Column, b: Column) -> Column:
    """MATH02: 0 where a vector is zero, held within -1 and 1."""
    n = norm(a) * norm(b)
    return F.when(n > 0, F.least(F.greatest(dot(a, b) / n, F.lit(-1.0)), F.lit(1.0))).otherwise(0.0)


def normalized(a: Column) -> Column:
    """VEC04: scaled to length 1; a zero vector stays."""
    sized = lambda n: F.transform(a, lambda x: F.when(n > 0, x / n).otherwise(x))
    return F.get(F.transform(F.array(norm(a)), sized), 0)  # the norm is taken once a vector, not once a component


def resolved(triples: DataFrame, entities: DataFrame, relations: DataFrame) -> DataFrame:
    """JOIN14: (head, relation, tail, h, r, t): triples (head, relation, tail) with their vectors, by entities and relations
    (name, v); triples of which a vector is missing drop out."""
    h = entities.select(F.col("name").alias("head"), F.col("v").alias("h"))
    r = relations.select(F.col("name").alias("relation"), F.col("v").alias("r"))
    t = entities.select(F.col("name").alias("tail"), F.col("v").alias("t"))
    return triples.join(h, "head").join(r, "relation").join(t, "tail").select("head", "relation", "tail", "h", "r", "t")


def translation_distance(head: Column, relation: Column, tail: Column) -> Column:
    """VEC05: length of head + relation - tail."""
    moved = F.zip_with(F.zip_with(head, relation, lambda x, y: x + y), tail, lambda x, y: x - y)
    return norm(moved)


def margin_loss(positive: Column, negative: Column, margin: float = 1.0) -> Column:
    """AGG27: aggregate over pairs of distances."""
    return F.avg(F.greatest(F.lit(0.0), margin + positive - negative))


def initial(key: Column, dim: int, seed: int = 0, size: int | None = None) -> Column:
    """VEC06: a Xavier-uniform start vector of length dim, drawn by md5 of the key, so that every run agrees."""
    bound = (6.0 / ((size or dim) + dim)) ** 0.5
    draw = lambda k: F.conv(F.substring(F.md5(F.concat_ws(":", key.cast("string"), k.cast("string"), F.lit(seed))), 1, 8), 16, 10).cast("double") / float(1 << 32)
    return F.transform(F.sequence(F.lit(0), F.lit(dim - 1)), lambda k: (draw(k) * 2 - 1) * bound)


def initial_relation(key: Column, dim: int, seed: int = 0, size: int | None = None) -> Column:
    """VEC06: a relation's start vector: as an entity's, scaled to length 1."""
    return normalized(initial(key, dim, seed, size))
