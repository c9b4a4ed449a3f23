"""From papers and queries to recommendations and metrics: the end-to-end steps."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import similarity as S
from ..sources import readers as R
from ..sources.shared import materialize
from . import recommend as P
from . import stages as T
from .evaluate import evaluate


@dataclass
class Graph:
    papers: DataFrame
    mentions: DataFrame  # paper_id, seq, entity_id, entity_type, canonical, weight
    relations: DataFrame
    profiles: DataFrame


def build(papers: DataFrame, vectors: DataFrame | None = None, tagger: T.Batch | None = None, classifier: T.Batch | None = None, least: int = 50) -> Graph:
    """E2E03 (preparing, tagging, linking): a graph of cleaned papers; vectors: (entity_id, v), else entities have none."""
    clean = materialize(R.cleaned_papers(papers, least).dropDuplicates(["id"]), "papers")
    mentions = materialize(T.link(T.tag_entities(clean, tagger), clean), "mentions")
    relations = materialize(T.relate(mentions, classifier, papers=clean), "relations")
    units = S.unit_vectors(vectors) if vectors is not None else papers.sparkSession.createDataFrame([], "entity_id string, u array<double>")
    return Graph(clean, mentions, relations, materialize(S.type_profiles(mentions.select("paper_id", "entity_id", "entity_type", "weight"), units), "profiles"))


def answer(graph: Graph, queries: DataFrame, settings: P.Settings | None = None, client: T.Batch | None = None) -> DataFrame:
    """E2E01: recommendations for queries (query_id, context); client: a language model in place of the ranked responder."""
    s = settings or P.Settings()
    functions = P.functions_of(queries)
    pairs = materialize(T.candidates(queries, graph.mentions), "candidates")
    by_type = materialize(S.type_similarity(pairs, graph.profiles), "type-similarity")
    sets = materialize(T.paper_sets(T.text_sets(graph.papers), graph.mentions), "paper-sets")
    scores = T.function_scores(pairs, by_type, sets, functions).drop("function")
    if client is None:
        return P.recommend(pairs, by_type, graph.mentions, graph.relations, graph.papers, scores, functions, s)
    order = P.rerank(P.retrieve(pairs, by_type, graph.mentions, graph.relations, s), scores, graph.papers, functions, s)
    prompts = P.prompts(order.withColumnRenamed("s_final", "score"), graph.papers, F.concat(F.lit("## Query Paper "), "query_id"), max(2 * s.recommended, 100))
    return P.verified(P.parsed(T.generate(prompts, client)), graph.papers, s.least_confidence).join(functions, "query_id")


def judge(recommendations: DataFrame, truth: DataFrame, graph: Graph) -> DataFrame:
    """E2E02: one row of metrics; truth: (query_id, paper_id)."""
    ranked = recommendations.select("query_id", "paper_id", "rank", "reason")
    edges = graph.mentions.select(F.col("paper_id").alias("source"), F.col("entity_id").alias("target"))
    return evaluate(ranked, truth, graph.papers, reason=F.col("reason"), relations=edges)
