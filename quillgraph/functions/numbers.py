"""Scores of single rows: Column in, Column out."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import constants as C
from .text import venue_key


def sigmoid(x: Column) -> Column:
    return 1 / (1 + F.exp(-x))


def clamp(x: Column, low: Column, high: Column) -> Column:
    """MATH06: share of the way from low to high, 0 to 1."""
    return F.least(F.greatest((x - low) / F.greatest(high - low, F.lit(1e-10)), F.lit(0.0)), F.lit(1.0))


def lookup(key: Column, table: dict, default) -> Column:
    pairs = [F.lit(x) for kv in table.items() for x in kv]
    return F.coalesce(F.element_at(F.create_map(*pairs), key), F.lit(default))


def venue_rank(venue: Column) -> Column:
    return lookup(venue_key(F.coalesce(venue, F.lit(""))), C.VENUE_RANKS, 0.5)


def quality(citations: Column, venue: Column, year: Column, current_year: int) -> Column:
    """MATH05: citations, venue and age."""
    return F.log1p(citations) + venue_rank(venue) + 1 / (1 + F.greatest(F.lit(0), F.lit(current_year) - year))


def fusion(function: Column, which: int) -> Column:
    """MATH07: weight of the cognitive (0) or the quality score (1)."""
    return lookup(function, {k: v[which] for k, v in C.FUSION_WEIGHTS.items()}, C.FUSION_WEIGHTS["background"][which])


def entity_weight(text: Column, entity: Column, in_title: Column) -> Column:
    """MATH04: earlier and more frequent entities weigh more."""
    low, e = F.lower(text), F.lower(entity)
    n = F.length(low)
    at = F.when(F.instr(low, e) > 0, F.instr(low, e) - 1).otherwise(n)
    count = (n - F.length(F.replace(low, e, F.lit("")))) / F.length(e)
    return sigmoid((in_title.cast("double") + 1 / (1 + at / F.greatest(n, F.lit(1)))) * F.log1p(count))


def path_weight(weights: Column, decay: float = 0.5) -> Column:
    """MATH08: product of an array of weights, decayed by its size; 0 for none."""
    product = F.aggregate(weights, F.lit(1.0), lambda a, w: a * w)
    return F.when(F.size(weights) > 0, product * F.pow(F.lit(decay), F.size(weights))).otherwise(0.0)


def blend(entity: Column, path: Column, gamma: float = 0.6) -> Column:
    """MATH09."""
    return gamma * entity + (1 - gamma) * path


def softmax(logits: Column) -> Column:
    """MATH10."""
    top = F.array_max(logits)
    powers = F.transform(logits, lambda x: F.exp(x - top))
    return F.transform(powers, lambda p: p / F.aggregate(powers, F.lit(0.0), lambda a, b: a + b))
