"""SRC17: acquisition that goes on where it stopped: a stateful stream of which the checkpoint is the point of return.

Rows that arrive in a folder are read once. Each key's first row wins: the row of the earliest run that brought one, and
of that run's rows the one with the smallest order. What has been told of a key is state (transformWithState, in RocksDB,
kept in the checkpoint), so a later run, or one after a failure, gives a key no second row, however many files came in
between, and without reading the earlier ones. State grows with the keys, by a few bytes each.
"""

from __future__ import annotations

import threading
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

PROVIDER = "spark.sql.streaming.stateStore.providerClass"
ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"

_setting = threading.Lock()


class FirstWins(StatefulProcessor):
    """Gives a key's row with the smallest order of the first batch that has one, and nothing after it."""

    def __init__(self, order: list[str]):
        self.order = order

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.told = handle.getValueState("told", "told boolean")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        known, first = self.told.exists(), None
        for frame in rows:  # Arrow batches of one key; one row of them is held
            if known or not len(frame):
                continue
            frame = frame if first is None else pd.concat([first, frame])
            first = frame.sort_values(self.order, kind="stable", na_position="first").head(1)
        if first is not None:
            self.told.update((True,))
            yield first

    def close(self) -> None:
        pass


def first_wins(stream: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """One row of each key of a streaming DataFrame, over all runs with one checkpoint."""
    return stream.groupBy(*keys).transformWithStateInPandas(statefulProcessor=FirstWins(order), outputStructType=stream.schema, outputMode="Append", timeMode="None")


def resume(spark: SparkSession, arrivals: str, schema: str, sink: str, checkpoint: str, keys: list[str], order: list[str]) -> StreamingQuery:
    """Start a run over what has arrived since the last one (Parquet files in folders under arrivals); it ends when all of
    it is in the sink, a folder of Parquet files that is read as a stream's sink, so that a run which fails half-way
    shows none of its rows."""
    stream = spark.readStream.schema(schema).option("recursiveFileLookup", "true").parquet(arrivals)
    with _setting:  # read when a query starts
        before = spark.conf.get(PROVIDER, None)
        spark.conf.set(PROVIDER, ROCKS)
        try:
            return first_wins(stream, keys, order).writeStream.format("parquet").outputMode("append").option("checkpointLocation", checkpoint).trigger(availableNow=True).start(sink)
        finally:
            if before is None:
                spark.conf.unset(PROVIDER)
            else:
                spark.conf.set(PROVIDER, before)
