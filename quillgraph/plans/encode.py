"""VEC07: texts to vectors by a model's batch function, with a cache on Parquet.

A text is named by its digest and encoded once, however often it occurs and however often encode() runs: texts that the
cache holds are found by a semi-join on the digest alone, the rest go through predict_batch_udf, so that a model is loaded
once a worker and sees batches. A batch that fails is tried text by text; a text that fails gets the zero vector, which
isn't cached, so the next run tries it again. The cache grows by files; one run writes to it at a time.

Null texts count as empty; an empty text is encoded like any other.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable

import numpy as np
from pyspark.ml.functions import predict_batch_udf
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType

from ..sources.shared import file_system, materialize

#: texts (array of str) to an array of as many rows
Predict = Callable[[np.ndarray], np.ndarray]


def paper_text(title: Column, abstract: Column) -> Column:
    return F.concat(F.coalesce(title, F.lit("")), F.lit(" "), F.coalesce(abstract, F.lit("")))


def hashed_words(dim: int) -> Callable[[], Predict]:
    """The default encoder: each lower-cased word between white space adds 1 or -1 to one of dim components, by its md5;
    scaled to length 1. A text without words has the zero vector."""

    def load() -> Predict:
        places: dict[str, tuple[int, float]] = {}

        def place(word: str) -> tuple[int, float]:
            if word not in places:
                if len(places) > 500_000:
                    places.clear()
                h = hashlib.md5(word.encode()).hexdigest()
                places[word] = int(h[:6], 16) % dim, 1.0 if h[6] < "8" else -1.0
            return places[word]

        def predict(texts: np.ndarray) -> np.ndarray:
            out = np.zeros((len(texts), dim))
            for k, text in enumerate(texts):
                found = [place(w) for w in text.lower().split()]
                if found:
                    at, sign = zip(*found, strict=True)
                    np.add.at(out[k], list(at), sign)
            size = np.sqrt((out * out).sum(1))[:, None]
            return np.divide(out, size, out=out, where=size > 0)

        return predict

    return load


def surviving(load: Callable[[], Predict], dim: int) -> Callable[[], Predict]:
    """load whose function gives a row without numbers (NaN) for a text that fails, and for one whose vector isn't dim finite
    numbers."""

    def make() -> Predict:
        predict = load()

        def checked(texts: np.ndarray) -> np.ndarray:
            out = np.asarray(predict(texts), dtype=float)
            if out.shape != (len(texts), dim):
                raise ValueError(f"{out.shape} vectors for {len(texts)} texts of {dim} components")
            return out

        def run(texts: np.ndarray) -> np.ndarray:
            texts = np.asarray(texts, dtype=object).reshape(-1)
            try:
                out = checked(texts)
            except Exception:  # whatever a model raises, the other texts go on
                out = np.full((len(texts), dim), np.nan)
                for k in range(len(texts)):
                    try:
                        out[k] = checked(texts[k : k + 1])[0]
                    except Exception:
                        pass
            out[~np.isfinite(out).all(1)] = np.nan
            return out

        return run

    return make


def cached(spark: SparkSession, path: str) -> DataFrame | None:
    """(key, v) of a cache; None where there is none yet."""
    fs, name = file_system(spark, path)
    return spark.read.schema("key string, v array<double>").parquet(path) if fs.exists(name) else None


def encode(rows: DataFrame, dim: int, cache: str, load: Callable[[], Predict] | None = None, batch: int = 256, id_col: str = "id", text_col: str = "text") -> DataFrame:
    """(id, v) of rows (id, text): each text's vector of dim components by load()'s function (default: hashed_words).

    cache: a folder for one model; another model needs another folder."""
    spark = rows.sparkSession
    keyed = materialize(rows.select(id_col, F.coalesce(F.col(text_col), F.lit("")).alias("text")).withColumn("key", F.sha2("text", 256)), "encode-keyed")
    missing = keyed.groupBy("key").agg(F.any_value("text").alias("text"))
    known = cached(spark, cache)
    if known is not None:
        missing = missing.join(known.select("key"), "key", "left_anti")
    model = predict_batch_udf(surviving(load or hashed_words(dim), dim), return_type=ArrayType(DoubleType()), batch_size=batch).asNondeterministic()  # else a filter would run it twice
    made = missing.select("key", model("text").alias("v")).where(F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x)))
    # the default commit shows all files of a run or none
    made.write.mode("append").parquet(cache)
    zero = F.array_repeat(F.lit(0.0), dim)
    found = keyed.select(id_col, "key").join(cached(spark, cache), "key", "left")
    return found.select(F.col(id_col).alias("id"), F.coalesce("v", zero).alias("v"))
