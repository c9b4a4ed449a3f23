"""Text functions: Column in, Column out."""

from __future__ import annotations

import re

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import constants as C

CONTROL = r"[\x00-\x1f\x7f-\x9f]"
NOT_WORD = r"[^\p{L}\p{N}_\s]"


def falsy(c: Column, kind: str = "string") -> Column:
    """null where the value is empty, zero or null."""
    return F.nullif(c, F.lit("") if kind == "string" else F.lit(0))


def simple_clean(text: Column) -> Column:
    """STR02: white space to single spaces, control characters out, trimmed."""
    return F.trim(F.regexp_replace(F.regexp_replace(text, r"\s+", " "), CONTROL, ""))


@F.pandas_udf(T.StringType())
def nfkc(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
    for s in texts:
        yield s.str.normalize("NFKC")


def tidy(text: Column) -> Column:
    """STR01 after its normal form: no control characters, single spaces, at most one blank line, lines trimmed."""
    t = F.regexp_replace(text, r"[\p{C}&&[^\n\t\r]]", "")
    t = F.regexp_replace(F.regexp_replace(t, r" +", " "), r"\n{3,}", "\n\n")
    return F.trim(F.regexp_replace(F.regexp_replace(t, r" *\n *", "\n"), r" *\t *", "\t"))


def rich_clean(text: Column) -> Column:
    return tidy(nfkc(text))


def sentences(text: Column) -> Column:
    """STR03: sentences with their final marks; a full stop that ends an abbreviation doesn't end a sentence.

    Only a mark before white space or the end counts, so it is enough to look at what stands before such a full stop."""
    short = "|".join(re.escape(a[:-1]) for a in sorted(C.ABBREVIATIONS, key=len, reverse=True))
    ended = F.regexp_replace(text, rf"((?<!(?i:{short}))\.|[!?。！？])(\s+|$)", "$1\u0004")
    return F.filter(F.transform(F.split(ended, "\u0004"), lambda s: F.trim(s)), lambda s: s != "")


def words(text: Column) -> Column:
    """Lower-cased words between white space."""
    return F.filter(F.split(F.lower(text), r"\s+"), lambda w: w != "")


def tokens(text: Column) -> Column:
    """STR04: words and single marks."""
    return F.filter(F.split(F.regexp_replace(text, f"({NOT_WORD})", " $1 "), r"\s+"), lambda w: w != "")


def stem(w: Column) -> Column:
    """STR06."""
    n = F.length(w)
    out = w
    for suffix in reversed(("ing", "ed", "er", "est", "ly", "s")):
        out = F.when(w.endswith(suffix) & (n > len(suffix) + 2), F.substring(w, F.lit(1), n - len(suffix))).otherwise(out)
    y = F.concat(F.substring(w, F.lit(1), n - 3), F.lit("y"))
    return F.when(n <= 3, w).when((w.endswith("ies") | w.endswith("ied")) & (n > 4), y).otherwise(out)


def canonical(text: Column) -> Column:
    """STR05: lower case, marks to spaces, stop words out, stemmed; if nothing is left, without marks."""
    plain = F.regexp_replace(F.lower(F.trim(text)), NOT_WORD, " ")
    kept = F.filter(F.split(plain, r"\s+"), lambda w: (w != "") & ~w.isin(C.ENTITY_STOPWORDS))
    joined = F.array_join(F.transform(kept, stem), " ")
    return F.when(joined != "", joined).otherwise(F.trim(F.regexp_replace(F.lower(text), NOT_WORD, "")))


def topics(text: Column) -> Column:
    """STR07: words of four or more Latin letters, without stop words, in order."""
    return F.filter(F.split(F.lower(text), r"[^\p{L}\p{N}_]+"), lambda w: w.rlike("^[a-z]{4,}$") & ~w.isin(C.TOPIC_STOPWORDS))


def venue_key(venue: Column) -> Column:
    """STR09."""
    return F.translate(F.lower(venue), " -", "")


def same_venue(a: Column, b: Column) -> Column:
    """STR10."""
    return F.when((F.coalesce(a, F.lit("")) != "") & (F.lower(a) == F.lower(b)), 1.0).otherwise(0.0)


def citation_function(context: Column, lexicon=C.FUNCTION_WORDS, default: str = "background") -> Column:
    """STR11: the first function of the lexicon of which a word is contained."""
    low, out = F.lower(context), F.lit(default)
    for name, some in reversed(lexicon):
        hit = F.lit(False)
        for w in some:
            hit = hit | low.contains(w)
        out = F.when(hit, F.lit(name)).otherwise(out)
    return out


def keyword_entities(text: Column, lexicon=C.ENTITY_WORDS, most: int = 10) -> Column:
    """STR12: array<struct<pos, entity_type, text>> of the lexicon's words contained in the text, at most `most`."""
    rows = [(t, w) for t, some in lexicon for w in some]
    all_ = F.array(*[F.struct(F.lit(i).alias("pos"), F.lit(t).alias("entity_type"), F.lit(w).alias("text")) for i, (t, w) in enumerate(rows)])
    low = F.lower(text)
    return F.slice(F.filter(all_, lambda e: low.contains(e["text"])), 1, most)


def preview(text: Column, n: int = 200) -> Column:
    """STR18."""
    return F.when(F.length(text) > n, F.concat(F.substring(text, 1, n), F.lit("..."))).otherwise(text)


def occurrences(text: Column, part: Column) -> Column:
    """STR19: how often part occurs in text, without overlaps."""
    return F.when(F.length(part) > 0, (F.length(text) - F.length(F.replace(text, part, F.lit("")))) / F.length(part)).otherwise(0).cast("long")


def jaccard(a: Column, b: Column) -> Column:
    """SET02/03: shared share of two arrays as sets; 0 where both are empty."""
    union = F.size(F.array_union(a, b))
    return F.when(union > 0, F.size(F.array_intersect(a, b)) / union).otherwise(0.0)
