"""SRC14: an inverted file of vectors on Parquet.

build() fits centroids to a bounded sample and writes every vector into the partition of its cell (`vectors/cell=<n>`),
with a table of cells: centroid, number of vectors, and the distances of the nearest and farthest one from the centroid.
search() sends each query to the cells whose centroids are nearest and reads those partitions alone; scores are exact.
With exact=True it then goes on to every cell that may still hold one of the k nearest by the triangle inequality, so
that the result is that of a search through all vectors. extend() adds vectors to the cells that there are.

A cell is read by as many tasks as it has blocks of BLOCK vectors, so a cell that holds a third of all is split. Null and
zero vectors: a null vector isn't indexed and asks nothing; a zero vector has no direction, so under cosine it is kept in
a cell of its own, scores 0 with every query, and as a query is answered by the first ids there are.
"""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import neighbours as K
from .shared import file_system, materialize

ZERO = -1  # cell of zero vectors under cosine
PER_FILE = 200_000  # vectors of a file


class VectorIndex:
    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path
        rows = spark.read.parquet(f"{path}/cells").orderBy("cell").collect()  # MOST_CELLS at most
        self.metric, self.kind = rows[0].metric, rows[0].kind
        of = lambda c: np.array([r[c] for r in rows])
        self.cells = K.gathered(np.array([r.centre for r in rows], float), self.metric, of("n").astype(np.int64), of("low").astype(float), of("high").astype(float))

    @classmethod
    def build(cls, vectors: DataFrame, path: str, metric: str = "cosine", cells: int | None = None, train: int = K.TRAIN, rounds: int = 8) -> VectorIndex:
        """vectors: (id, v). cells: by default the square root of their number, K.MOST_CELLS at most; centroids are fitted
        to `train` vectors a cell, those with the smallest hashes of their ids. All vectors are written."""
        spark = vectors.sparkSession
        live = _live(vectors, metric)
        if cells is None:
            cells = max(1, math.isqrt(live.count()))
        centres = K.pivots(live, min(cells, K.MOST_CELLS), metric, rounds, train)
        if not len(centres):
            raise ValueError("no vectors to index")
        _write(K.assigned(live, centres, metric), path)
        if metric == "cosine":
            _write(_zeros(vectors), path)
        _tell(spark, path, centres, metric)
        return cls(spark, path)

    def extend(self, vectors: DataFrame) -> VectorIndex:
        """The index with more vectors (id, v), in the cells that there are."""
        _write(K.assigned(_live(vectors, self.metric), self.cells.centres, self.metric), self.path)
        if self.metric == "cosine":
            _write(_zeros(vectors), self.path)
        _tell(self.spark, self.path, self.cells.centres, self.metric)
        return VectorIndex(self.spark, self.path)

    def vectors(self, cells: list[int] | None = None) -> DataFrame:
        """The vectors (id, v, h, away, cell) of some cells, or of all; no other partition is read."""
        rows = self.spark.read.schema(f"id {self.kind}, v array<double>, h long, away double, cell int").parquet(f"{self.path}/vectors")
        return rows if cells is None else rows.where(F.col("cell").isin(cells))

    def search(self, queries: DataFrame, k: int = 10, probes: int = 8, exact: bool = False) -> DataFrame:
        """(query_id, id, score, rank) of queries (id, v): the k nearest indexed vectors with other ids, in the `probes`
        nearest cells (and, exact: in all that may hold one). At most as many cells as there are come to the driver."""
        live = materialize(_live(queries, self.metric), "index-queries")
        sizes = {i: int(n) for i, n in enumerate(self.cells.n)}
        near = materialize(self._probed(live, probes), "index-probes")
        found = materialize(self._scored(near, k, sizes), "index-found")
        if exact:
            kth = K.best(found, k, self.metric).where(F.col("rank") == k).select(F.col("query_id").alias("id"), F.col("score").alias("kth"))
            more = self._within(live.join(kth, "id", "left")).join(near.select("id", "cell"), ["id", "cell"], "left_anti")
            found = found.unionByName(self._scored(materialize(more, "index-more"), k, sizes))
        zero = self.vectors([ZERO]).select("id") if self.metric == "cosine" else live.select("id").limit(0)
        if self.metric == "cosine":
            asking = queries.where("v IS NOT NULL").select("id")
            blank = asking.join(_zeros(queries).select("id"), "id", "left_semi")
            if not zero.isEmpty() or not blank.isEmpty():
                everything = self.vectors().select("id")
                found = K.zero_scores(found, everything, asking, blank, zero, k)
        return K.best(found, k, self.metric)

    def _probed(self, live: DataFrame, probes: int) -> DataFrame:
        return K.to_cells(live.withColumn("kth", F.lit(None).cast("double")), self.cells, probes)

    def _within(self, asking: DataFrame) -> DataFrame:
        return K.to_cells(asking, self.cells, None)

    def _scored(self, asking: DataFrame, k: int, sizes: dict[int, int]) -> DataFrame:
        """(query_id, id, score) of queries in cells (id, v, cell): each meets every block of the cell."""
        wanted = sorted(r.cell for r in asking.select("cell").distinct().collect())
        table = self.spark.createDataFrame([(c, max(1, -(-sizes[c] // K.BLOCK))) for c in wanted], "cell int, blocks int")
        there = self.vectors(wanted).join(F.broadcast(table), "cell").select(F.pmod("h", "blocks").cast("int").alias("part"), "cell", F.lit(False).alias("asks"), "id", "v")
        asks = asking.join(F.broadcast(table), "cell").select(F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("part"), "cell", F.lit(True).alias("asks"), "id", "v")
        dealt = there.unionByName(asks).withColumn("block", F.shiftleft(F.col("part").cast("long"), 32) + F.col("cell")).drop("part", "cell")
        parts = max(1, min(sum(-(-sizes[c] // K.BLOCK) for c in wanted), 4 * int(self.spark.conf.get("spark.sql.shuffle.partitions"))))
        return K.search_blocks(dealt, k, self.metric, parts)


def _live(vectors: DataFrame, metric: str) -> DataFrame:
    rows = vectors.select("id", F.col("v").cast("array<double>").alias("v")).where("v IS NOT NULL")
    return rows.where(F.exists("v", lambda x: x != 0)) if metric == "cosine" else rows


def _zeros(vectors: DataFrame) -> DataFrame:
    """Zero vectors in the form of assigned ones."""
    rows = vectors.select("id", F.col("v").cast("array<double>").alias("v")).where(F.col("v").isNotNull() & ~F.exists("v", lambda x: x != 0))
    return rows.select("id", "v", F.xxhash64("id").bitwiseAND((1 << 62) - 1).alias("h"), F.lit(ZERO).alias("cell"), F.lit(0.0).alias("away"))


def _write(placed: DataFrame, path: str) -> None:
    """Rows of one cell come together in few files; a cell of very many rows is dealt to more tasks by its size."""
    placed = materialize(placed, "index-cells")
    sizes = placed.groupBy("cell").agg(F.ceil(F.count("*") / PER_FILE).cast("int").alias("files"))
    rows = placed.join(F.broadcast(sizes), "cell").withColumn("_file", F.pmod("h", "files"))
    rows.repartition("cell", "_file").drop("files", "_file").write.mode("append").partitionBy("cell").parquet(f"{path}/vectors")


def _tell(spark: SparkSession, path: str, centres: np.ndarray, metric: str) -> None:
    """Write the table of cells: a new one beside the old one, which it then replaces."""
    placed = spark.read.parquet(f"{path}/vectors").where(F.col("cell") >= 0)
    cells = K.cells_of(placed, centres, metric)
    kind = dict(placed.dtypes)["id"]
    rows = [(i, c.tolist(), int(n), float(lo), float(hi), metric, kind) for i, (c, n, lo, hi) in enumerate(zip(centres, cells.n, cells.low, cells.high, strict=True))]
    spark.createDataFrame(rows, "cell int, centre array<double>, n long, low double, high double, metric string, kind string").coalesce(1).write.mode("overwrite").parquet(f"{path}/cells.new")
    fs, new = file_system(spark, f"{path}/cells.new")
    old = file_system(spark, f"{path}/cells")[1]
    fs.delete(old, True)
    fs.rename(new, old)
