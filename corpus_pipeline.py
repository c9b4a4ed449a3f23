"""A corpus pipeline of five stages, each over all that the stage before kept.

quality classifier -> SimHash near-dedup -> secret scan -> source mixing -> BPE encoding

Every stage takes (spark, docs, sf_dir) and returns a DataFrame; run() writes each result as Parquet to the shared
folder and reads it again as the next stage's docs. All but the last return the columns of documents. Null texts count
as empty, null ids and sources are kept as they are, repeated rows are documents of their own, except that the
near-duplicate stage keeps one row of each group, and an empty table gives empty results. Columns of docs other than
those of documents are ignored.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillgraph.llm import bpe, mixing, quality, secrets, simhash_dedup
from quillgraph.llm.common import materialize

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]
#: Near-duplicates: Jaccard similarity of the whole sets of five-word shingles
WORDS, SIMILARITY = 5, 0.8


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the line-level field rejects go."""
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    docs = docs.select(*COLUMNS)
    return quality.keep_good(docs, quality.train(docs, labels), threshold=0.3)


def dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates stays: the one with the smallest id."""
    return simhash_dedup.drop_near_duplicates(docs.select(*COLUMNS), least=SIMILARITY, words=WORDS)


def secrets_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Secrets are masked in the texts; n_chars follows."""
    clean = secrets.redact(docs.select(*COLUMNS).withColumn("_before", F.length("text")))
    size = F.when(F.length("text") == F.col("_before"), F.col("n_chars")).otherwise(F.length("text").cast("long"))
    return clean.withColumn("n_chars", size).select(*COLUMNS)


def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the mix takes it: not at all, once or twice."""
    docs = docs.select(*COLUMNS)
    mixed = mixing.mix(docs)
    taken = mixed.where(F.col("copies") > 0).groupBy("doc_id", "source", "size").agg(F.max("copies").alias("copies"))
    taken = materialize(taken.withColumnsRenamed({"doc_id": "d", "source": "s"}), "pipeline-mix")
    size = F.coalesce(F.regexp_count("text", F.lit(mixing.WORD)), F.lit(0)).cast("long")
    same = F.col("doc_id").eqNullSafe(F.col("d")) & F.col("source").eqNullSafe(F.col("s")) & (F.col("words") == F.col("size"))
    # merged at every size: texts are shuffled once, whether or not the decisions are few enough to broadcast
    rows = docs.withColumn("words", size).join(taken.hint("merge"), same)
    return rows.withColumn("copy", F.explode(F.sequence(F.lit(1), "copies"))).select(*COLUMNS)


def encode_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """(doc_id, source, n_tokens, ids) of each row."""
    tokens = bpe.encode(docs.select("doc_id", "source", "text"), bpe.public_vocabulary())
    return tokens.select("doc_id", "source", F.size("ids").cast("long").alias("n_tokens"), "ids")


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("quality classifier", quality_stage),
    ("simhash near-dedup", dedup_stage),
    ("secret scan", secrets_stage),
    ("source mixing", mixing_stage),
    ("bpe encoding", encode_stage),
]

ORACLE_SQL = None  # the field, SimHash and BPE can't be expressed in SQL; tests hold each stage against a plain version


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select(*COLUMNS)
    for k, (_, stage) in enumerate(STAGES):
        docs = materialize(stage(spark, docs, sf_dir), f"pipeline-{k}")
    return docs
