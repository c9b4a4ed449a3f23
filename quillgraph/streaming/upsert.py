"""Streams of new papers and citations into a Parquet graph, batch by batch."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..operators.graph import latest
from ..sources.shared import file_system

BUCKET = "_bucket"


def upsert_batch(path: str, keys: list[str], order: str, buckets: int = 64) -> Callable[[DataFrame, int], None]:
    """A foreachBatch function: rows of each batch replace those of the same keys, the largest `order` wins.

    Rows lie in buckets by their keys. A batch writes only the buckets that it touches, as a version numbered like the
    batch, so one that runs again after a failure writes the same version. Of each bucket the two last versions stay:
    the one that readers see, and the one that a batch that runs again starts from.
    """

    def write(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        rows = batch.withColumn(BUCKET, F.pmod(F.xxhash64(*keys), F.lit(buckets)).cast("int"))
        touched = [r[0] for r in rows.select(BUCKET).distinct().collect()]  # at most `buckets` rows
        before = current(spark, path, number - 1, touched)
        if before is not None:
            before = before.withColumn(BUCKET, F.pmod(F.xxhash64(*keys), F.lit(buckets)).cast("int"))
            rows = before.unionByName(rows, allowMissingColumns=True)
        latest(rows, keys, [F.desc(order)]).write.mode("overwrite").partitionBy(BUCKET).parquet(f"{path}/version={number:09d}")
        expire(spark, path)

    return write


def versions(spark: SparkSession, path: str, most: int | None = None) -> dict[int, list[int]]:
    """Complete versions, up to number `most`, of each bucket, the last first."""
    fs, root = file_system(spark, path)
    found: dict[int, list[int]] = {}
    for status in fs.listStatus(root) if fs.exists(root) else []:
        name = status.getPath().getName()
        if not name.startswith("version=") or not fs.exists(file_system(spark, f"{path}/{name}/_SUCCESS")[1]):
            continue
        number = int(name[8:])
        for part in fs.listStatus(status.getPath()) if most is None or number <= most else []:
            if part.getPath().getName().startswith(f"{BUCKET}="):
                found.setdefault(int(part.getPath().getName()[len(BUCKET) + 1 :]), []).append(number)
    return {b: sorted(n, reverse=True) for b, n in found.items()}


def current(spark: SparkSession, path: str, most: int | None = None, buckets: list[int] | None = None) -> DataFrame | None:
    """The rows of the last complete version of each bucket, up to number `most`; None where there is none."""
    last = [f"{path}/version={n[0]:09d}/{BUCKET}={b}" for b, n in versions(spark, path, most).items() if buckets is None or b in buckets]
    if not last:
        return None
    # versions may differ in their columns
    schemas: dict[str, list[str]] = {}
    for p in last:
        schemas.setdefault(p.split("/version=")[1][:9], []).append(p)
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), [spark.read.parquet(*p) for p in schemas.values()])


def expire(spark: SparkSession, path: str, keep: int = 2) -> None:
    """Delete all but the last `keep` versions of each bucket."""
    for bucket, numbers in versions(spark, path).items():
        for n in numbers[keep:]:
            fs, name = file_system(spark, f"{path}/version={n:09d}/{BUCKET}={bucket}")
            fs.delete(name, True)


def stream_into(source: DataFrame, path: str, checkpoint: str, keys: list[str], order: str, buckets: int = 64) -> StreamingQuery:
    """Start a stream that upserts a streaming DataFrame into path, all that is there, then stops."""
    return source.writeStream.foreachBatch(upsert_batch(path, keys, order, buckets)).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
