"""Command line: python -m quillgraph MODE, over JSON files.

recommend --papers P --queries Q --out O [--top-k N] [--year Y] [--config C]
inference --papers P --query-id I --context T --out O
evaluate  --papers P --queries Q --predictions O --out M
test      --papers P --queries Q --out O          recommendations and their metrics
train     --papers P --citations C --out O        graph, profiles and splits
steps     --papers P --out O [--citations C] [--queries Q] [--step NAME] [--skip-if-exists]
demo      --out O
"""

from __future__ import annotations

import argparse

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from .plans import pipeline, steps
from .plans.recommend import Settings
from .sources import readers as R
from .sources.config import load_config, settings_from

PREDICTION = "query_id string, paper_id string, rank bigint, score double, reason string, citation_position string, confidence string, function string"
NEEDED = {"recommend": ("papers", "queries"), "inference": ("papers", "query_id", "context"), "evaluate": ("papers", "queries", "predictions"), "test": ("papers", "queries"), "train": ("papers",), "steps": ("papers",), "demo": ()}


def options(args: list[str] | None) -> argparse.Namespace:
    parser = argparse.ArgumentParser(prog="quillgraph")
    parser.add_argument("mode", choices=list(NEEDED))
    for name in ("papers", "queries", "citations", "predictions", "query-id", "context", "config"):
        parser.add_argument(f"--{name}")
    parser.add_argument("--out", required=True)
    parser.add_argument("--step", default="all", choices=["all", *steps.STEPS])
    parser.add_argument("--skip-if-exists", action="store_true")
    parser.add_argument("--lines", action="store_true", help="files hold one object a line")
    parser.add_argument("--top-k", type=int, default=10)
    parser.add_argument("--year", type=int, default=2024)
    o = parser.parse_args(args)
    missing = [n for n in NEEDED[o.mode] if not getattr(o, n)]
    if missing:
        parser.error(f"{o.mode} needs --{missing[0].replace('_', '-')}")
    return o


def main(args: list[str] | None = None) -> None:
    o = options(args)
    spark = SparkSession.builder.appName("quillgraph").getOrCreate()
    settings = settings_from(load_config(spark, o.config), Settings, "recommend") if o.config else Settings(recommended=o.top_k, current_year=o.year)
    if o.mode == "demo":
        R.write_json(steps.demo(spark, o.top_k), o.out)
        return
    if o.mode in ("train", "steps"):
        work = steps.Work(spark, o.out, o.papers, o.citations, o.queries, o.lines, settings)
        names = ["acquire", "preprocess", "extract", "build_graph", "embeddings", "train"] if o.mode == "train" else [o.step]
        for name in names:
            steps.run(work, name, o.skip_if_exists)
        return
    papers = R.lenient_papers(R.read_objects(spark, o.papers, ("papers", "data", "items"), o.lines))
    graph = pipeline.build(papers)
    if o.mode == "inference":
        asked = spark.createDataFrame([(o.query_id, o.context)], "query_id string, context string")
        known = asked.join(papers.select(F.col("id").alias("query_id")), "query_id", "left_semi")
        if known.isEmpty():
            raise ValueError(f"no paper {o.query_id}")
        R.write_json(pipeline.answer(graph, asked, settings), o.out)
        return
    queries = R.read_queries(spark, o.queries, papers, o.lines)
    asked = queries.select(F.col("query_paper_id").alias("query_id"), F.col("citation_context").alias("context"))
    truth = queries.select(F.col("query_paper_id").alias("query_id"), F.explode("ground_truth").alias("paper_id"))
    if o.mode == "evaluate":
        R.write_json(pipeline.judge(R.read_json(spark, o.predictions, PREDICTION, lines=True), truth, graph), o.out)
        return
    made = f"{o.out}/recommendations" if o.mode == "test" else o.out
    R.write_json(pipeline.answer(graph, asked, settings), made)
    if o.mode == "test":
        R.write_json(pipeline.judge(R.read_json(spark, made, PREDICTION, lines=True), truth, graph), f"{o.out}/metrics")


if __name__ == "__main__":
    main()
