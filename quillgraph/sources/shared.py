"""The folder that driver and executors share."""

from __future__ import annotations

import tempfile
import threading
import uuid
from collections.abc import Callable, Iterable, Iterator
from contextlib import contextmanager
from contextvars import ContextVar
from weakref import WeakKeyDictionary

from pyspark.sql import DataFrame, SparkSession

CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"

_made: ContextVar[list[str] | None] = ContextVar("made", default=None)  # tables that go at the end of a round
_cleanup = threading.Lock()
_writers: WeakKeyDictionary[SparkSession, int] = WeakKeyDictionary()  # writes under way
_before: WeakKeyDictionary[SparkSession, str] = WeakKeyDictionary()  # the setting before the first of them


def shared_root(spark: SparkSession) -> str:
    """spark.checkpoint.dir. Where it is unset, a folder of our own on one machine, and an error on a cluster: its
    executors wouldn't see what others wrote to their own disks."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-cluster"):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        root = "file://" + tempfile.mkdtemp(prefix="quillgraph-")
        spark.conf.set("spark.checkpoint.dir", root)
    return root.rstrip("/")


def file_system(spark: SparkSession, path: str):
    """Hadoop's file system of a path, and the path in its form."""
    name = spark._jvm.org.apache.hadoop.fs.Path(path)
    return name.getFileSystem(spark._jsc.hadoopConfiguration()), name


def shared_path(spark: SparkSession, label: str) -> str:
    """A new path in the shared folder, under a folder of the application that goes when its driver ends."""
    folder = f"{shared_root(spark)}/quillgraph/{spark.sparkContext.applicationId}"
    fs, name = file_system(spark, folder)
    if not fs.exists(name):
        fs.mkdirs(name)
        fs.deleteOnExit(name)
    return f"{folder}/{label}-{uuid.uuid4().hex}"


def materialize(df: DataFrame, label: str, narrow: bool = False) -> DataFrame:
    """Write df to the shared folder and read it again: cuts lineage and survives lost executors.

    The shuffle files that the write needed are deleted when it is done. narrow: rows are few bytes each, so they are
    gathered into files of the advisory partition size rather than one for each task that made them.
    """
    path = shared_path(df.sparkSession, label)
    if (made := _made.get()) is not None:
        made.append(path)
    _write(df.hint("rebalance") if narrow else df, path, {})
    return df.sparkSession.read.schema(df.schema).parquet(path)


def materialize_parts(parts: Iterable[DataFrame], label: str) -> DataFrame:
    """As materialize, of tables of one schema that are written one after another, so that shuffles are those of one."""
    path = schema = None
    for df in parts:
        if path is None:
            path, schema, spark = shared_path(df.sparkSession, label), df.schema, df.sparkSession
            if (made := _made.get()) is not None:
                made.append(path)
        _write(df, path, {"compression": "zstd"}, "append")
    return spark.read.schema(schema).parquet(path)


@contextmanager
def lasting() -> Iterator[None]:
    """Inside, tables are made for longer than the round that is under way."""
    token = _made.set(None)
    try:
        yield
    finally:
        _made.reset(token)


def in_round(spark: SparkSession, make: Callable[[], DataFrame | Iterable[DataFrame]], label: str) -> DataFrame:
    """What make() gives, written out; all that was materialized on the way is deleted then."""
    made: list[str] = []
    token = _made.set(made)
    try:
        df = make()
        with lasting():
            return materialize_parts([df] if isinstance(df, DataFrame) else df, label)
    finally:
        _made.reset(token)
        for path in made:
            fs, name = file_system(spark, path)
            fs.delete(name, True)


def _write(df: DataFrame, path: str, options: dict[str, str], mode: str = "errorifexists") -> None:
    spark = df.sparkSession
    with _cleanup:  # the setting is the session's, and queries may run from several threads
        _writers[spark] = _writers.get(spark, 0) + 1
        if _writers[spark] == 1:
            _before[spark] = spark.conf.get(CLEANUP, "false")
            spark.conf.set(CLEANUP, "true")
    try:
        df.write.options(**options).mode(mode).parquet(path)
    finally:
        with _cleanup:
            _writers[spark] -= 1
            if not _writers[spark]:
                spark.conf.set(CLEANUP, _before.pop(spark))
                del _writers[spark]


class Scratch:
    """Tables in the shared folder that are deleted as soon as what was made of them is written."""

    def __init__(self, spark: SparkSession):
        self.spark, self.paths = spark, {}

    def write(self, df: DataFrame, label: str) -> DataFrame:
        """As materialize, packed tighter."""
        path = shared_path(self.spark, label)
        _write(df, path, {"compression": "zstd"})
        back = self.spark.read.schema(df.schema).parquet(path)
        self.paths[id(back)] = path, back
        return back

    def drop(self, *tables: DataFrame) -> None:
        for df in tables:
            fs, name = file_system(self.spark, self.paths.pop(id(df))[0])
            fs.delete(name, True)
