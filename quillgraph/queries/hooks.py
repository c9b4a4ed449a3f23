"""Hooks that a model may fill, with rules or plain functions in its place, and parts that other queries use inside."""

from __future__ import annotations

import json
import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import constants as C
from ..operators import graph as G
from ..operators import metrics as M
from ..operators import neighbours as K
from ..operators.similarity import abstract_similarity
from ..plans import pipeline
from ..plans import recommend as P
from ..plans import stages as T
from ..plans.bindings import Tables, sql
from ..plans.encode import encode, paper_text
from ..sources import paged
from ..sources import readers as R
from ..sources.shared import shared_path
from ..streaming.resume import resume
from . import query
from .scores import FUNCTION, KNN, PAIRS, PROFILE, by_rank, function_scores, scored
from .texts import SET

#: letters that occur in all of the documents' languages, as entities of relations
LETTERS = (("task", ("er", "tion")), ("method", ("en", "on")), ("material", ("in",)), ("metric", ("re",)))


def tagged_sql(lexicon) -> str:
    words = ", ".join(f"({i}, '{kind}', '{word}')" for i, (kind, word) in enumerate((k, w) for k, some in lexicon for w in some))
    return (
        "tagged AS (SELECT id, title, abstract, n - 1 AS pos, entity_type, word FROM (SELECT p.*, row_number() OVER (PARTITION BY p.id ORDER BY i) AS n, v.entity_type, v.word "
        f"FROM papers p JOIN (VALUES {words}) v(i, entity_type, word) ON contains(lower(p.title || ' ' || p.abstract), v.word)) WHERE n <= 10)"
    )


@query("src04_json_lines_sink", "SELECT p_type, count(*) AS n, sum(p_partkey)::BIGINT AS keys FROM part GROUP BY 1")
def json_lines_sink(t: Tables) -> DataFrame:
    path = shared_path(t.spark, "src04")
    R.write_json(t.part.select("p_partkey", "p_type"), path)
    back = R.read_objects(t.spark, path, (), lines=True).select(F.from_json("obj", "p_partkey bigint, p_type string").alias("o")).select("o.*")
    return back.groupBy("p_type").agg(F.count(F.lit(1)).alias("n"), F.sum("p_partkey").alias("keys"))


@query("src16_kept_papers", "SELECT CAST(doc_id AS VARCHAR) AS id FROM documents WHERE text <> '' AND lang <> 'de'")
def kept_papers(t: Tables) -> DataFrame:
    """Papers with id and abstract, of objects of which some have none."""
    abstract = F.when(F.col("lang") != "de", F.col("text"))
    objects = t.documents.select(F.to_json(F.struct(F.col("doc_id").cast("string").alias("id"), F.lit("t").alias("title"), abstract.alias("abstract"))).alias("obj"))
    return R.lenient_papers(objects).where("abstract <> ''").select("id")


@query("join04_citation_ends", sql("citations graph_papers", "SELECT source AS source_paper_id, target AS target_paper_id FROM citations WHERE source IN (SELECT id FROM graph_papers WHERE citation_count > 100) AND target IN (SELECT id FROM graph_papers WHERE citation_count > 100)"))
def citation_ends(t: Tables) -> DataFrame:
    c = t.citations.select(F.col("source").alias("source_paper_id"), F.col("target").alias("target_paper_id"))
    return R.among(c, t.graph_papers.where("citation_count > 100").select("id")).select("source_paper_id", "target_paper_id")


@query("top05_nearest_three", KNN + " SELECT query_id, id, rank FROM k WHERE rank <= 3")
def nearest_three(t: Tables) -> DataFrame:
    return K.nearest(t.embeddings, 3, "cosine", "vec_id", "embedding").select("query_id", "id", F.col("rank").cast("long").alias("rank"))


JSON_ROW = (
    "'{\"paper_id\":\"' || paper_id || '\",\"reason\":\"' || " + by_rank(C.RANKED_REASON, C.RANKED_REASON[0]) + " || '\",\"citation_position\":\"' || " + by_rank(C.RANKED_POSITION, "methodology")
    + " || '\",\"confidence\":\"' || " + by_rank(C.RANKED_CONFIDENCE, "medium") + " || '\",\"score\":' || CAST(round(0.9 - 0.1 * (rank - 1), 6)::DOUBLE AS VARCHAR) || '}'"
)


@query("json02_response", sql("ranked", f"SELECT query_id, md5('[' || string_agg({JSON_ROW}, ',' ORDER BY rank) || ']') AS digest FROM ranked WHERE rank <= 5 GROUP BY 1"))
def response(t: Tables) -> DataFrame:
    return P.response(P.reasoned(t.ranked, 5)).select("query_id", F.md5("response").alias("digest"))


@query(
    "fun04_abstract_similarity",
    sql(
        "papers",
        rf"""
WITH w AS (SELECT id, lead(id) OVER (PARTITION BY lang ORDER BY id) AS other FROM papers),
s AS (SELECT id, {SET.format('title')} AS t, list_distinct(list_filter(regexp_split_to_array(lower(abstract), '\s+'), lambda x: x <> '')[1:50]) AS a FROM papers)
SELECT w.id, w.other, round(CASE WHEN len(list_concat(x.t, y.t)) > 0 THEN 0.4 * len(list_intersect(x.t, y.t)) / len(list_distinct(list_concat(x.t, y.t))) ELSE 0 END
  + CASE WHEN len(list_concat(x.a, y.a)) > 0 THEN 0.6 * len(list_intersect(x.a, y.a)) / len(list_distinct(list_concat(x.a, y.a))) ELSE 0 END, 6) AS similarity
FROM w JOIN s x ON x.id = w.id JOIN s y ON y.id = w.other
""",
    ),
)
def abstracts(t: Tables) -> DataFrame:
    p = t.papers.select("id", "title", "abstract")
    order = t.papers.select("id", F.lead("id").over(Window.partitionBy("lang").orderBy("id")).alias("other")).where("other IS NOT NULL")
    rows = order.join(p, "id").join(p.withColumnsRenamed({"id": "other", "title": "title2", "abstract": "abstract2"}), "other")
    return rows.select("id", "other", F.round(abstract_similarity("title", "abstract", "title2", "abstract2"), 6).alias("similarity"))


def function_sql(name: str) -> str:
    return sql("contains entities graph_papers order_texts", f"WITH {PAIRS}, {PROFILE}, {FUNCTION} SELECT query_id, paper_id, round(s_function, 6) + 0.0::DOUBLE AS score FROM ff WHERE function = '{name}'")


def of_function(t: Tables, name: str) -> DataFrame:
    return scored(t, function_scores, name).select("query_id", "paper_id", F.round("s_function", 6).alias("score"))


@query("fun06_use", function_sql("use"))
def use(t: Tables) -> DataFrame:
    return of_function(t, "use")


@query("fun07_compare", function_sql("compare"))
def compare(t: Tables) -> DataFrame:
    return of_function(t, "compare")


@query("fun08_inspire", function_sql("inspire"))
def inspire(t: Tables) -> DataFrame:
    return of_function(t, "inspire")


@query("gra10_zero_degree", "WITH e AS (SELECT l_orderkey AS source, l_partkey AS target, CASE WHEN l_orderkey % 3 = 0 THEN 0.0 ELSE l_quantity::DOUBLE END AS weight FROM lineitem) SELECT source, round(sum(weight) / greatest(sum(weight), 1e-10), 6) AS mass, count(*) AS n FROM e GROUP BY 1")
def zero_degree(t: Tables) -> DataFrame:
    """Nodes whose edges weigh nothing pass nothing on, instead of dividing by zero."""
    weight = F.when(F.col("l_orderkey") % 3 == 0, 0.0).otherwise(F.col("l_quantity").cast("double"))
    e = G.transition(t.lineitem.select(F.col("l_orderkey").alias("source"), F.col("l_partkey").alias("target"), weight.alias("weight")))
    return e.groupBy("source").agg(F.round(F.sum("p"), 6).alias("mass"), F.count(F.lit(1)).alias("n"))


TAGGED = tagged_sql(C.ENTITY_WORDS)


@query("udf01_tag_entities", sql("papers", f"WITH {TAGGED} SELECT CAST(id AS VARCHAR) AS paper_id, pos, entity_type, word AS text FROM tagged"))
def tag_entities(t: Tables) -> DataFrame:
    """The tagger's place, filled by the lexicon."""
    papers = t.papers.withColumn("id", F.col("id").cast("string"))
    return T.tag_entities(papers).select("paper_id", F.col("pos").cast("long").alias("pos"), "entity_type", "text")


@query("udf04_similarity_function", sql("ranked graph_papers", "SELECT a.query_id, round(avg(abs(p.year - q.year) / 10.0::DOUBLE), 6) AS ild FROM ranked a JOIN ranked b ON a.query_id = b.query_id AND a.rank < b.rank JOIN graph_papers p ON p.id = a.paper_id JOIN graph_papers q ON q.id = b.paper_id WHERE a.rank <= 5 AND b.rank <= 5 GROUP BY 1"))
def similarity_function(t: Tables) -> DataFrame:
    """Intra-list distance under a caller's own distance of two papers."""
    items = t.ranked.where("rank <= 5").join(t.graph_papers.select(F.col("id").alias("paper_id"), "year"), "paper_id").withColumnRenamed("rank", "pos")
    apart = F.abs(F.col("a.year") - F.col("b.year")) / 10.0
    more = items.groupBy("query_id").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("query_id")
    return M.list_distance(items, apart, ["query_id"]).join(more, "query_id", "left_semi").select("query_id", F.round("ild", 6).alias("ild"))


def first_two(frame: pd.DataFrame) -> pd.DataFrame:
    """A client that recommends the first two papers of a prompt, and answers no query whose number ends in 7."""
    if (out := frame["query_id"].str.endswith("7")).any():
        raise T.Unanswered(frame["query_id"][out])
    told = [json.dumps([{"paper_id": i, "reason": "listed", "confidence": "high"} for i in re.findall(r"Paper ID: (\S+)", p)[:2]]) for p in frame["prompt"]]
    return pd.DataFrame({"query_id": frame["query_id"], "response": told})


@query("udf05_generate", sql("ranked", "SELECT query_id, rank - 1 AS pos, paper_id, 'high' AS confidence FROM ranked WHERE rank <= 2 AND NOT suffix(query_id, '7')"))
def generate(t: Tables) -> DataFrame:
    """Prompts to a client, batch by batch, and its responses read; a client that raises costs only its own query."""
    papers = t.graph_papers.select("id", F.lit("t").alias("title"), F.lit("").alias("abstract"), F.array(F.lit("a")).alias("authors"), "year", "venue", "citation_count")
    prompts = P.prompts(t.best(4).withColumn("score", F.lit(0.5)), papers, F.concat(F.lit("## Query "), "query_id"), 4)
    return P.parsed(T.generate(prompts, T.surviving(first_two))).select("query_id", "pos", "paper_id", "confidence")


@query("udf06_ranked_responder", sql("ranked", f"SELECT query_id, paper_id, rank, round(0.9 - 0.1 * (rank - 1), 6)::DOUBLE AS score, {by_rank(C.RANKED_POSITION, 'methodology')} AS citation_position, {by_rank(C.RANKED_CONFIDENCE, 'medium')} AS confidence FROM ranked WHERE rank <= 7"))
def ranked_responder(t: Tables) -> DataFrame:
    return P.reasoned(t.ranked, 7).select("query_id", "paper_id", "rank", "score", "citation_position", "confidence")


@query("e2e03_build", sql("papers", f"WITH {TAGGED} SELECT entity_type, count(*) AS mentions, count(DISTINCT id) AS papers, count(DISTINCT word) AS entities FROM tagged WHERE title <> '' AND length(abstract) >= 50 GROUP BY 1"))
def build(t: Tables) -> DataFrame:
    """Papers cleaned, tagged and linked into a graph by the default rules."""
    papers = t.papers.select(F.col("id").cast("string").alias("id"), "title", "abstract", "venue", "year", "citation_count")
    mentions = pipeline.build(papers).mentions
    return mentions.groupBy("entity_type").agg(F.count(F.lit(1)).alias("mentions"), F.count_distinct("paper_id").alias("papers"), F.count_distinct("text").alias("entities"))


PLACED = "('0x' || left(md5(w), 6))::BIGINT % 16 AS place, CASE WHEN substr(md5(w), 7, 1) < '8' THEN 1 ELSE -1 END AS sign"


@query(
    "vec07_encoded_papers",
    sql(
        "papers",
        f"WITH w AS (SELECT id, unnest(list_filter(regexp_split_to_array(lower(title || ' ' || abstract), '\\s+'), lambda x: x <> '')) AS w FROM papers), s AS (SELECT id, place, sum(sign)::DOUBLE AS x FROM (SELECT id, {PLACED} FROM w) GROUP BY 1, 2), "
        "n AS (SELECT id, sqrt(sum(x * x)) AS size FROM s GROUP BY 1), k AS (SELECT id, unnest(range(16)) AS place FROM papers) "
        "SELECT k.id, CAST(k.place AS INT) AS place, round(CASE WHEN n.size > 0 THEN coalesce(s.x, 0) / n.size ELSE 0 END, 6)::DOUBLE AS x FROM k LEFT JOIN s ON s.id = k.id AND s.place = k.place LEFT JOIN n ON n.id = k.id",
    ),
)
def encoded(t: Tables) -> DataFrame:
    """Papers' vectors by the default encoder; the second run finds every text in the cache."""
    rows = t.papers.select("id", paper_text(F.col("title"), F.col("abstract")).alias("text"))
    cache = shared_path(t.spark, "vector-cache")
    encode(rows, 16, cache)
    return encode(rows, 16, cache).select("id", F.posexplode("v").alias("place", "x")).withColumn("x", F.round("x", 6))


@query("src15_paged_papers", "SELECT CAST(doc_id AS VARCHAR) AS id, lang AS venue, n_chars AS citation_count FROM (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY doc_id) - 1 AS k FROM documents) WHERE text <> '' AND source <> 'src2'")
def paged_papers(t: Tables) -> DataFrame:
    """Documents as the pages of a search service, a query for each language, read back through the paged source."""
    abstract = F.when(F.col("source") != "src2", F.col("text"))
    object_ = F.to_json(F.struct(F.col("doc_id").cast("string").alias("id"), F.lit("t").alias("title"), abstract.alias("abstract"), F.col("lang").alias("venue"), F.col("n_chars").alias("citation_count")))
    place = F.row_number().over(Window.partitionBy("lang").orderBy("doc_id")) - 1
    path = shared_path(t.spark, "pages")
    rows = t.documents.select(F.col("lang").alias("query"), place.alias("place"), object_.alias("object"))
    paged.write_pages(rows, path)
    most = rows.groupBy("query").agg(F.max("place").alias("last")).collect()  # a row for each query of the service
    pages = paged.read_pages(t.spark, sorted(r["query"] for r in most), path=path, last=str(max([0, *(r["last"] for r in most)])))
    return paged.fetched_papers(pages).select("id", "venue", "citation_count")


@query("src17_resumed", "SELECT 'c' || conv_id AS id, min(turn) AS seq FROM conversations GROUP BY 1")
def resumed(t: Tables) -> DataFrame:
    """Acquisition in two runs over what has arrived: openings first, then everything; each key's first row stays."""
    at = shared_path(t.spark, "resumed")
    rows = t.conversations.select(F.concat(F.lit("c"), "conv_id").alias("id"), F.col("turn").alias("seq"))
    for k, part in enumerate((rows.where("seq < 2"), rows)):
        part.write.parquet(f"{at}/arrivals/{k}")
        resume(t.spark, f"{at}/arrivals", "id string, seq long", f"{at}/sink", f"{at}/checkpoint", ["id"], ["seq"]).awaitTermination()
    return t.spark.read.schema("id string, seq long").parquet(f"{at}/sink")


def by_context(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """In a model's place: the pattern of the types, the heavier the earlier the second word stands in the text."""
    pattern = {(a, b): r for a, r, b in C.PATH_PATTERNS}
    for f in frames:
        text = T.separated(f)
        kind = [pattern.get(x) for x in zip(f["source_type"], f["target_type"], strict=True)]
        body = [x.split(" [SEP] ", 1)[1].rsplit(" [SEP] ", 1)[0].lower() for x in text]
        weight = [1 / (1 + b.find(w)) if w in b else 0.0 for b, w in zip(body, f["target_text"], strict=True)]
        out = pd.DataFrame({"source": f["source"], "target": f["target"], "relation_type": kind, "weight": weight})
        yield out[out["relation_type"].notna()]


@query(
    "udf02_relation_hook",
    sql(
        "papers patterns",
        f"WITH {tagged_sql(LETTERS)}, r AS (SELECT a.entity_type || '_' || a.word AS source, b.entity_type || '_' || b.word AS target, p.relation_type, 1.0 / instr(lower(a.title || ' ' || a.abstract), b.word) AS weight "
        "FROM tagged a JOIN tagged b ON a.id = b.id AND a.pos < b.pos AND a.word <> b.word JOIN patterns p ON p.source_type = a.entity_type AND p.target_type = b.entity_type) "
        "SELECT source, target, arg_max(relation_type, (weight, relation_type)) AS relation_type, round(max(weight), 9)::DOUBLE AS weight FROM r WHERE weight >= 0.001 GROUP BY 1, 2",
    ),
)
def relation_hook(t: Tables) -> DataFrame:
    """A relation model's place: pairs of a paper's entities with their texts and the paper's as context."""
    papers = t.papers.select(F.col("id").cast("string").alias("id"), "title", "abstract")
    mentions = T.tag_entities(papers, lexicon=LETTERS).select("paper_id", F.col("pos").alias("seq"), F.concat_ws("_", "entity_type", "text").alias("entity_id"), "entity_type", "text")
    return T.relate(mentions, by_context, 0.001, papers).withColumn("weight", F.round("weight", 9))
