"""Joins, caps and composites that other queries use inside, each on its own."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import vectors as V
from ..operators import similarity as S
from ..plans import recommend as P
from ..plans.bindings import Tables, sql
from ..plans.evaluate import evaluate
from . import query
from .metrics import AP, RR, hit_sql, top10, truth
from .scores import DOUBLES, ENTITY, FUNCTION, PAIRS, PROFILE, all_near, canonical_mentions, held_function_scores, pairs, path_sql, scored, similarities, typed_mentions


@query("join02_candidates", sql("contains", "SELECT a.paper_id AS query_id, count(DISTINCT b.paper_id) AS candidates FROM contains a JOIN contains b ON a.entity_id = b.entity_id AND a.paper_id <> b.paper_id GROUP BY 1"))
def candidates(t: Tables) -> DataFrame:
    """Candidates by shared entities: the sparse form of every query against every paper.

    A pair that shares several is counted at the first of them, which both papers' own lists tell, so no pair is dealt."""
    own = t.numbered.groupBy("l_orderkey").agg(F.array_sort(F.collect_set("l_partkey")).alias("own"))
    each = own.select("l_orderkey", "own", F.explode("own").alias("part"))
    a, b = each.withColumnsRenamed({"l_orderkey": "q", "own": "mine"}), each.withColumnsRenamed({"l_orderkey": "p", "own": "theirs"})
    met = a.join(b, "part").where((F.col("q") != F.col("p")) & (F.get(F.array_intersect("mine", "theirs"), 0) == F.col("part")))
    return met.groupBy("q").agg(F.count(F.lit(1)).alias("candidates")).select(F.concat(F.lit("o"), "q").alias("query_id"), "candidates")


@query(
    "join03_typed_pairs",
    sql(
        "contains entities",
        f"WITH {PAIRS}, m AS MATERIALIZED (SELECT paper_id, entity_type, count(*) AS n FROM contains JOIN entities ON id = entity_id GROUP BY 1, 2), "
        "x AS MATERIALIZED (SELECT p.source, p.target, a.entity_type, a.n FROM pairs p JOIN m a ON a.paper_id = p.source) "
        "SELECT x.source AS query_id, x.target AS paper_id, CAST(sum(x.n * b.n) AS BIGINT) AS n FROM x JOIN m b ON b.paper_id = x.target AND b.entity_type = x.entity_type GROUP BY 1, 2",
    ),
)
def typed_pairs(t: Tables) -> DataFrame:
    """Pairs of entities of one type: counts by type are multiplied, not joined."""
    n = typed_mentions(t).groupBy("paper_id", "entity_type").agg(F.count(F.lit(1)).alias("n"))
    q = n.select(F.col("paper_id").alias("query_id"), "entity_type", F.col("n").alias("m"))
    return pairs(t).join(q, "query_id").join(n, ["paper_id", "entity_type"]).groupBy("query_id", "paper_id").agg(F.sum(F.col("m") * F.col("n")).alias("n"))


@query("join07_predictions_and_truth", sql("ranked citations", "WITH p AS (SELECT query_id, count(*) AS predicted FROM ranked GROUP BY 1), g AS (SELECT source, count(*) AS relevant FROM citations GROUP BY 1) SELECT query_id, predicted, relevant FROM p JOIN g ON g.source = p.query_id"))
def aligned(t: Tables) -> DataFrame:
    p = t.ranked.groupBy("query_id").agg(F.count(F.lit(1)).alias("predicted"))
    return p.join(t.citations.groupBy(F.col("source").alias("query_id")).agg(F.count(F.lit(1)).alias("relevant")), "query_id")


@query("join12_list_pairs", sql("ranked", "SELECT a.query_id, count(*) AS n FROM ranked a JOIN ranked b ON a.query_id = b.query_id AND a.rank < b.rank WHERE a.rank <= 10 AND b.rank <= 10 GROUP BY 1"))
def list_pairs(t: Tables) -> DataFrame:
    a, b = top10(t).alias("a"), top10(t).alias("b")
    return a.join(b, (F.col("a.query_id") == F.col("b.query_id")) & (F.col("a.pos") < F.col("b.pos"))).groupBy(F.col("a.query_id").alias("query_id")).agg(F.count(F.lit(1)).alias("n"))


@query("pred06_not_itself", sql("contains", f"WITH {PAIRS} SELECT source AS query_id, target AS paper_id FROM pairs WHERE source <> target"))
def not_itself(t: Tables) -> DataFrame:
    p = pairs(t)
    return p.unionByName(p.select("query_id", F.col("query_id").alias("paper_id"))).where("query_id <> paper_id")


@query("pred12_valid_items", sql("ranked", "SELECT query_id, count(*) AS n FROM ranked WHERE rank <= 6 AND rank NOT IN (2, 4) GROUP BY 1"))
def valid_items(t: Tables) -> DataFrame:
    spoilt = lambda x: x.withField("confidence", F.when(x["rank"] == 2, "sure").otherwise(x["confidence"])).withField("paper_id", F.when(x["rank"] == 4, "").otherwise(x["paper_id"]))
    r = P.reasoned_lists(t.best_lists(6), 6).withColumn("list", F.transform("list", spoilt))
    return P.parsed(P.response_of_lists(r)).groupBy("query_id").agg(F.count(F.lit(1)).alias("n"))


@query("json03_references", "SELECT l_orderkey AS k, count(*) AS n, min(l_partkey) AS low, max(l_partkey) AS high FROM lineitem GROUP BY 1")
def references(t: Tables) -> DataFrame:
    from ..sources.readers import citations_of_references

    part = F.col("l_partkey").cast("string")
    r = F.when(F.col("l_linenumber") % 3 == 0, F.to_json(F.struct(part.alias("paper_id")))).when(F.col("l_linenumber") % 3 == 1, F.to_json(F.struct(part.alias("id")))).otherwise(part)
    papers = t.lineitem.groupBy(F.concat(F.lit("o"), "l_orderkey").alias("id")).agg(F.collect_list(r).alias("references"))
    known = t.lineitem.select(part.alias("id")).distinct().withColumn("references", F.array().cast("array<string>"))
    c = citations_of_references(papers.unionByName(known))
    return c.groupBy(F.substring("source_paper_id", 2, 20).cast("long").alias("k")).agg(F.count(F.lit(1)).alias("n"), F.min(F.col("target_paper_id").cast("long")).alias("low"), F.max(F.col("target_paper_id").cast("long")).alias("high"))


@query("set01_intersection", sql("ranked citations", "SELECT r.query_id, count(*) AS shared FROM ranked r JOIN citations c ON c.source = r.query_id AND c.target = r.paper_id WHERE r.rank <= 5 GROUP BY 1"))
def intersection(t: Tables) -> DataFrame:
    return t.ranked.where("rank <= 5").join(truth(t), ["query_id", "paper_id"]).groupBy("query_id").agg(F.count(F.lit(1)).alias("shared"))


@query("top02_rerank_cap", sql("ranked", "SELECT query_id, max(rank) AS last FROM ranked WHERE rank <= 8 GROUP BY 1"))
def rerank_cap(t: Tables) -> DataFrame:
    return t.ranked.where(F.col("rank") <= 8).groupBy("query_id").agg(F.max("rank").alias("last"))


@query("top03_list_cap", sql("ranked", "SELECT query_id, count(*) AS n FROM ranked WHERE rank <= 1 * 15 GROUP BY 1"))
def list_cap(t: Tables) -> DataFrame:
    return t.ranked.where(F.col("rank") <= 1 * 15).groupBy("query_id").agg(F.count(F.lit(1)).alias("n"))


@query("top08_heads", "SELECT doc_id, array_to_string(regexp_split_to_array(text, '\\s+')[1:3], ',') AS head FROM documents")
def heads(t: Tables) -> DataFrame:
    return t.documents.select("doc_id", F.array_join(F.slice(F.split("text", r"\s+"), 1, 3), ",").alias("head"))


@query("win05_first_entities", sql("contains", "SELECT paper_id, entity_id FROM (SELECT *, row_number() OVER (PARTITION BY paper_id ORDER BY seq, entity_id) AS k FROM contains) WHERE k <= 5"))
def first_entities(t: Tables) -> DataFrame:
    return S.capped(t.contains, ["paper_id"], ["seq", "entity_id"], 5).select("paper_id", "entity_id")


@query("win07_renumbered", "SELECT l_orderkey, l_partkey, row_number() OVER (PARTITION BY l_orderkey ORDER BY seen, l_partkey) AS n FROM (SELECT l_orderkey, l_partkey, min(l_linenumber) AS seen FROM lineitem GROUP BY 1, 2)")
def renumbered(t: Tables) -> DataFrame:
    from pyspark.sql import Window

    once = t.lineitem.groupBy("l_orderkey", "l_partkey").agg(F.min("l_linenumber").alias("seen"))
    return once.select("l_orderkey", "l_partkey", F.row_number().over(Window.partitionBy("l_orderkey").orderBy("seen", "l_partkey")).cast("long").alias("n"))


def similarity_sql(kind: str) -> str:
    return sql("contains entities", f"WITH {PAIRS}, {PROFILE} SELECT query_id, paper_id, round(similarity, 6) + 0.0::DOUBLE AS similarity FROM ts WHERE entity_type = '{kind}'")


def of_type(t: Tables, kind: str) -> DataFrame:
    return scored(t, lambda r: similarities(r, kind)).select("query_id", "paper_id", F.round("similarity", 6).alias("similarity"))


@query("fun01_task_similarity", similarity_sql("task"))
def task_similarity(t: Tables) -> DataFrame:
    return of_type(t, "task")


@query("fun02_method_similarity", similarity_sql("method"))
def method_similarity(t: Tables) -> DataFrame:
    return of_type(t, "method")


@query("fun03_material_overlap", sql("contains entities graph_papers order_texts", f"WITH {PAIRS}, {PROFILE}, {FUNCTION} SELECT query_id, paper_id, round(as_, 6)::DOUBLE AS overlap FROM sf"))
def material_overlap(t: Tables) -> DataFrame:
    return S.shared_entities(pairs(t), canonical_mentions(t), "material").withColumn("overlap", F.round("overlap", 6))


@query(
    "fun09_cognitive",
    sql(
        "contains entities relations graph_papers order_texts",
        f"WITH {PAIRS}, {PROFILE}, {ENTITY}, {path_sql(2)}, {FUNCTION} SELECT query_id, paper_id, round(s_entity + s_path_2 + s_function, 5)::DOUBLE AS s_cognitive FROM se JOIN sp USING (query_id, paper_id) JOIN ff USING (query_id, paper_id)",
    ),
)
def cognitive(t: Tables) -> DataFrame:
    """Of every candidate: nothing is retrieved before, so no walk longer than ranking's is looked for."""
    return scored(t, lambda r: P.cognitive(all_near(r), held_function_scores(r)).select("query_id", "paper_id", F.round("s_cognitive", 5).alias("s_cognitive")))


@query(
    "e2e02_evaluate",
    hit_sql(
        AP + RR + ", pk AS (SELECT query_id, count(DISTINCT CASE WHEN rank <= 5 AND hit = 1 THEN paper_id END) AS n, any_value(n_truth) AS g FROM hits GROUP BY 1) SELECT (SELECT round(avg(n / 5.0::DOUBLE), 6) FROM pk) AS p_at_5, (SELECT round(avg(n / g::DOUBLE), 6) FROM pk) AS r_at_5, (SELECT round(avg(ap), 6) FROM ap) AS map, (SELECT round(avg(rr), 6) FROM rr) AS mrr, (SELECT round(stddev_pop(year), 6) FROM ranked JOIN graph_papers ON id = paper_id) AS temporal",
        "graph_papers",
    ),
)
def evaluation(t: Tables) -> DataFrame:
    row = evaluate(t.ranked, truth(t), t.graph_papers, (5,))
    return row.select(*[F.round(c, 6).alias(c) for c in ("p_at_5", "r_at_5", "map", "mrr", "temporal")])


LOGITS = (("background", 1.0, ""), ("use", 0.25, "th"), ("compare", 0.5, "on"), ("inspire", 0.75, "er"))


def counted_logits(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """In a model's place: logits by how often a function's letters occur in the context."""
    for f in frames:
        yield pd.DataFrame({name: (f["context"].str.count(letters) * scale if letters else scale) for name, scale, letters in LOGITS}, index=f.index, columns=[x[0] for x in LOGITS])


LOGIT_SQL = ", ".join(f"{scale} * ((length(coalesce(text, '')) - length(replace(coalesce(text, ''), '{letters}', ''))) / 2) AS {name}" if letters else f"{scale}::DOUBLE AS {name}" for name, scale, letters in LOGITS)


@query(
    "udf03_function_stage",
    f"WITH l AS (SELECT conv_id, turn, {LOGIT_SQL} FROM conversations), e AS (SELECT *, exp(background - top) AS eb, exp(use - top) AS eu, exp(compare - top) AS ec, exp(inspire - top) AS ei "
    "FROM (SELECT *, greatest(background, use, compare, inspire) AS top FROM l)) SELECT conv_id, turn, CASE top WHEN background THEN 'background' WHEN use THEN 'use' WHEN compare THEN 'compare' ELSE 'inspire' END AS function, "
    + ", ".join(f"round(e{n[0]} / (eb + eu + ec + ei), 6)::DOUBLE AS p_{n}" for n, _, _ in LOGITS) + " FROM e",
)
def function_stage(t: Tables) -> DataFrame:
    """The function classifier as a model's batch stage: four probabilities for each context, and the likeliest function."""
    q = t.conversations.select(F.struct("conv_id", "turn").alias("query_id"), F.col("text").alias("context"))
    q = q.select(F.to_json("query_id").alias("query_id"), "context")
    f = P.function_probabilities(q, counted_logits).withColumn("id", F.from_json("query_id", "conv_id long, turn long"))
    return f.select("id.conv_id", "id.turn", "function", *[F.round(F.get("probabilities", k), 6).alias(f"p_{name}") for k, (name, _, _) in enumerate(LOGITS)])


@query(
    "join14_triples",
    f"WITH {DOUBLES}, n AS (SELECT count(*) AS n FROM embeddings) SELECT h.vec_id, h.label, b.vec_id AS tail, round(list_sum(a.v), 6) AS head_sum, round(list_sum(r.v), 6) AS relation_sum, round(list_sum(b.v), 6) AS tail_sum "
    "FROM embeddings h JOIN e a ON a.vec_id = h.vec_id JOIN e r ON r.vec_id = h.label JOIN e b ON b.vec_id = (h.vec_id * 7 + 1) % (SELECT n FROM n)",
)
def resolved_triples(t: Tables) -> DataFrame:
    """Triples (head, relation, tail) with the vectors of all three."""
    e = t.embeddings.select("vec_id", "label", F.col("embedding").cast("array<double>").alias("v"))
    n = e.agg(F.count(F.lit(1)).alias("n"))
    triples = e.join(F.broadcast(n)).select("vec_id", "label", ((F.col("vec_id") * 7 + 1) % F.col("n")).alias("tail"))
    vectors = e.select(F.col("vec_id").alias("name"), "v")
    rows = V.resolved(triples.select(F.col("vec_id").alias("head"), F.col("label").cast("long").alias("relation"), "tail"), vectors, vectors)
    total = lambda c: F.round(F.aggregate(c, F.lit(0.0), lambda a, x: a + x), 6)
    return rows.select(F.col("head").alias("vec_id"), F.col("relation").cast("int").alias("label"), "tail", total("h").alias("head_sum"), total("r").alias("relation_sum"), total("t").alias("tail_sum"))


@query(
    "vec06_start_vectors",
    "WITH k AS (SELECT p_partkey, unnest(range(8)) AS k FROM part), d AS (SELECT p_partkey, k, (('0x' || left(md5(p_partkey || ':' || k || ':0'), 8))::BIGINT / 4294967296.0::DOUBLE * 2 - 1) * sqrt(6.0 / 16) AS x FROM k), "
    "n AS (SELECT *, sqrt(sum(x * x) OVER (PARTITION BY p_partkey)) AS size FROM d) SELECT p_partkey, CAST(k AS INT) AS k, round(x, 6) AS entity, round(x / size, 6) AS relation FROM n",
)
def start_vectors(t: Tables) -> DataFrame:
    """All components of entities' start vectors, and of relations', which have length 1."""
    from ..functions.vectors import initial, initial_relation

    key = F.col("p_partkey")
    rows = t.part.select("p_partkey", F.posexplode(F.arrays_zip(initial(key, 8).alias("e"), initial_relation(key, 8).alias("r"))).alias("k", "x"))
    return rows.select("p_partkey", "k", F.round("x.e", 6).alias("entity"), F.round("x.r", 6).alias("relation"))
