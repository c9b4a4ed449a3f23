"""Evaluation of rankings for many queries at once: one row of metrics."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators import metrics as M


def evaluate(ranked: DataFrame, truth: DataFrame, papers: DataFrame, ks: tuple[int, ...] = (5, 10, 20), reason: Column | None = None, relations: DataFrame | None = None) -> DataFrame:
    """E2E02: P@k, R@k, MAP, MRR over queries with truth; temporal diversity, evidence and path coverage over all.

    ranked: (query_id, paper_id, rank, ...); truth: (query_id, paper_id); papers: (id, year, ...); reason: a column of
    ranked; relations: (source, target). Each part is one aggregate row; they are put side by side.
    """
    hits = M.with_hits(ranked, truth)
    rows = [
        M.at_k(hits, ks).agg(*[F.avg(f"{m}_at_{k}").alias(f"{m}_at_{k}") for k in ks for m in "pr"]),
        M.average_precision(hits).agg(F.avg("ap").alias("map")),
        M.reciprocal_rank(hits).agg(F.avg("rr").alias("mrr")),
        ranked.join(papers.select(F.col("id").alias("paper_id"), "year"), "paper_id").transform(lambda d: M.temporal_diversity(d, [])),
    ]
    if reason is not None:
        rows.append(M.evidence(ranked.select("query_id", "paper_id", reason.alias("reason")), papers, F.col("reason")).agg(F.avg("evidence").alias("evidence")))
    if relations is not None:
        rows.append(M.path_coverage(ranked, relations).agg(F.avg("path_coverage").alias("path_coverage")))
    return reduce(lambda a, b: a.join(F.broadcast(b)), rows)  # single rows
