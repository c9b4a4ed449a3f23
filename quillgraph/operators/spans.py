"""Spans of labelled words."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def decode_bio(words: DataFrame) -> DataFrame:
    """STR13: (doc_id, first_pos, entity_type, text) of rows (doc_id, pos, w, label).

    A span begins at B, or at an I that doesn't go on from a word of its own type.
    """
    by_pos = Window.partitionBy("doc_id").orderBy("pos")
    tag, kind = F.substring_index("label", "-", 1), F.substring_index("label", "-", -1)
    rows = words.select("doc_id", "pos", "w", tag.alias("tag"), kind.alias("kind"))
    begins = (F.col("tag") == "B") | (F.col("tag") == "I") & F.coalesce((F.lag("tag").over(by_pos) == "O") | (F.lag("kind").over(by_pos) != F.col("kind")), F.lit(True))
    rows = rows.withColumn("begins", begins.cast("int"))
    rows = rows.withColumn("span", F.sum("begins").over(by_pos.rowsBetween(Window.unboundedPreceding, 0))).where("tag <> 'O'")
    text = F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("pos", "w"))), lambda x: x["w"]), " ")
    return rows.groupBy("doc_id", "span").agg(F.min("pos").alias("first_pos"), F.lower(F.first("kind")).alias("entity_type"), text.alias("text")).drop("span")
