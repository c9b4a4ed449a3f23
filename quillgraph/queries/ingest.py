"""Ingest, projections, joins and splits; JSON is made from the tables and parsed back."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import constants as C
from ..functions import numbers as N
from ..operators import graph as G
from ..plans.bindings import Tables, sql
from ..sources import readers as R
from . import query

def paper_objects(t: Tables) -> DataFrame:
    d, k = t.documents, F.col("doc_id") % 4
    i, head = F.col("doc_id").cast("string"), F.substring("text", 1, 30)
    year = (F.lit(2000) + F.col("doc_id") % 24).cast("int")
    a = F.to_json(F.struct(i.alias("id"), head.alias("title"), year.alias("year"), F.col("source").alias("venue"), F.col("n_chars").alias("citation_count")))
    b = F.to_json(F.struct(i.alias("paper_id"), head.alias("paper_title"), year.cast("string").alias("publication_year"), F.array("lang", "source").alias("authors")))
    c = F.to_json(F.struct(F.lit("").alias("id"), i.alias("_id"), head.alias("title"), F.lit("n/a").alias("year"), F.array(F.struct(F.col("lang").alias("name"))).alias("author"), F.lit(0).alias("citation_count"), F.col("n_chars").alias("citations")))
    e = F.to_json(F.struct(i.alias("id"), F.lit("").alias("title"), F.lit(0).alias("year")))
    return d.select(F.when(k == 0, a).when(k == 1, b).when(k == 2, c).otherwise(e).alias("obj"))


@query(
    "prj01_paper_aliases",
    "SELECT CAST(doc_id AS VARCHAR) AS id, left(text, 30) AS title, CASE doc_id % 4 WHEN 1 THEN lang || ',' || source WHEN 2 THEN lang ELSE '' END AS authors, CASE doc_id % 4 WHEN 2 THEN 2000 ELSE CAST(2000 + doc_id % 24 AS INTEGER) END AS year, CASE doc_id % 4 WHEN 0 THEN source ELSE '' END AS venue, CASE doc_id % 4 WHEN 1 THEN 0 ELSE n_chars END AS citation_count FROM documents WHERE doc_id % 4 <> 3 AND text <> ''",
)
def paper_aliases(t: Tables) -> DataFrame:
    p = R.lenient_papers(paper_objects(t))
    return p.select("id", "title", F.array_join("authors", ",").alias("authors"), "year", "venue", "citation_count")


def citation_objects(t: Tables) -> DataFrame:
    c = t.citations
    k = F.col("step")
    a = F.to_json(F.struct(F.col("source"), F.col("target"), F.lit("c").alias("context"), F.lit("experiment").alias("position")))
    b = F.to_json(F.struct(F.col("source").alias("source_id"), F.col("target").alias("target_id"), F.lit("t").alias("text"), F.lit("nowhere").alias("citation_position")))
    e = F.to_json(F.struct(F.col("source").alias("source_paper_id"), F.col("target").alias("target_paper_id"), F.lit("x").alias("context"), F.lit("methodology").alias("position")))
    return c.select(F.when(k == 1, a).when(k == 2, b).otherwise(e).alias("obj"))


@query("prj02_citation_aliases", sql("citations", "SELECT source AS source_paper_id, target AS target_paper_id, CASE step WHEN 1 THEN 'c' WHEN 2 THEN 't' ELSE 'x' END AS context, CASE step WHEN 1 THEN 'experiment' WHEN 2 THEN 'introduction' ELSE 'methodology' END AS position FROM citations"))
def citation_aliases(t: Tables) -> DataFrame:
    return R.lenient_citations(citation_objects(t), t.ordered.select("id"))


@query("src06_strict_citations", sql("citations graph_papers", "SELECT c.source AS source_paper_id, c.target AS target_paper_id, 'methodology' AS position FROM citations c JOIN graph_papers a ON a.id = c.source JOIN graph_papers b ON b.id = c.target WHERE step = 3 AND a.citation_count > 50 AND b.citation_count > 50"))
def strict_citations(t: Tables) -> DataFrame:
    return R.strict_citations(citation_objects(t), t.graph_papers.where("citation_count > 50")).select("source_paper_id", "target_paper_id", "position")


@query("src05_strict_papers", "SELECT CAST(doc_id AS VARCHAR) AS id, length(text) AS size FROM documents WHERE doc_id % 2 = 0")
def strict_papers(t: Tables) -> DataFrame:
    whole = F.to_json(F.struct(F.col("doc_id").cast("string").alias("id"), F.lit("t").alias("title"), F.col("text").alias("abstract"), F.array("lang").alias("authors"), F.lit(2001).alias("year"), F.col("source").alias("venue"), F.col("n_chars").alias("citation_count")))
    part = F.to_json(F.struct(F.col("doc_id").cast("string").alias("id"), F.lit("t").alias("title")))
    return R.strict_papers(t.documents.select(F.when(F.col("doc_id") % 2 == 0, whole).otherwise(part).alias("obj"))).select("id", F.length("abstract").cast("long").alias("size"))


@query("prj03_clean_papers", sql("papers", r"SELECT id, md5(trim(regexp_replace(regexp_replace(abstract, '\s+', ' ', 'g'), '[\x00-\x1f\x7f-\x9f]', '', 'g'))) AS digest, year, citation_count FROM papers WHERE title <> '' AND length(abstract) >= 50"))
def clean_papers(t: Tables) -> DataFrame:
    p = R.cleaned_papers(t.papers.withColumn("id", F.col("id").cast("string")))
    return p.select(F.col("id").cast("long").alias("id"), F.md5("abstract").alias("digest"), "year", "citation_count")


@query("prj04_reference_citations", "SELECT 'o' || l_orderkey AS source_paper_id, 'o' || l_partkey AS target_paper_id, count(*) AS n FROM lineitem WHERE l_partkey IN (SELECT o_orderkey FROM orders) AND l_orderkey IN (SELECT o_orderkey FROM orders) GROUP BY 1, 2")
def reference_citations(t: Tables) -> DataFrame:
    ref = F.when(F.col("l_linenumber") % 2 == 0, F.to_json(F.struct(F.concat(F.lit("o"), "l_partkey").alias("paperId")))).otherwise(F.concat(F.lit("o"), "l_partkey"))
    refs = t.lineitem.groupBy(F.concat(F.lit("o"), "l_orderkey").alias("id")).agg(F.collect_list(ref).alias("references"))
    papers = t.ordered.select("id").join(refs, "id", "left")
    return R.citations_of_references(papers).groupBy("source_paper_id", "target_paper_id").agg(F.count(F.lit(1)).alias("n"))


@query("prj06_to_json", sql("ranked", "SELECT query_id, '{\"paper_id\":\"' || paper_id || '\",\"rank\":' || rank || '}' AS json FROM ranked WHERE rank <= 3"))
def to_json(t: Tables) -> DataFrame:
    return t.ranked.where("rank <= 3").select("query_id", F.to_json(F.struct("paper_id", "rank")).alias("json"))


@query("prj07_triples", sql("relations", "SELECT source, relation_type, target FROM relations"))
def triples(t: Tables) -> DataFrame:
    return t.relations.select("source", "relation_type", "target")


@query("pred02_domains", sql("entities", "SELECT entity_type, count(*) AS n FROM entities WHERE entity_type IN ('task', 'method', 'material', 'metric', 'other') GROUP BY 1"))
def domains(t: Tables) -> DataFrame:
    return t.entities.where(G.allowed(F.col("entity_type"), C.ENTITY_TYPES)).groupBy("entity_type").agg(F.count(F.lit(1)).alias("n"))


@query("pred04_contains_ends", sql("contains graph_papers entities", "SELECT paper_id AS source, entity_id AS target FROM contains WHERE paper_id IN (SELECT id FROM graph_papers WHERE citation_count > 100) AND entity_id IN (SELECT id FROM entities WHERE entity_type <> 'other')"))
def contains_ends(t: Tables) -> DataFrame:
    edges = t.contains.select(F.col("paper_id").alias("source"), F.col("entity_id").alias("target"))
    return G.known_ends(edges, t.graph_papers.where("citation_count > 100"), t.entities.where("entity_type <> 'other'")).select("source", "target")


@query("pred05_node_types", sql("graph_papers entities", "SELECT 'paper' AS node_type, count(*) AS n FROM graph_papers UNION ALL SELECT entity_type, count(*) FROM entities GROUP BY 1"))
def node_types(t: Tables) -> DataFrame:
    nodes = t.graph_papers.select(F.lit("paper").alias("node_type")).unionByName(t.entities.select(F.col("entity_type").alias("node_type")))
    return nodes.groupBy("node_type").agg(F.count(F.lit(1)).alias("n"))


@query("pred09_known_papers", sql("ranked graph_papers", "SELECT query_id, count(*) AS kept FROM ranked WHERE paper_id IN (SELECT id FROM graph_papers WHERE year < 2000) GROUP BY 1"))
def known_papers(t: Tables) -> DataFrame:
    known = t.graph_papers.where("year < 2000").select(F.col("id").alias("paper_id"))
    return t.ranked.join(known, "paper_id", "left_semi").groupBy("query_id").agg(F.count(F.lit(1)).alias("kept"))


@query("pred10_confidence", sql("ranked", "SELECT query_id, count(*) AS kept FROM ranked WHERE CASE WHEN rank <= 2 THEN 1.0 WHEN rank <= 4 THEN 0.5 WHEN rank = 5 THEN 0.0 ELSE 0.5 END >= 0.5 GROUP BY 1"))
def confidence(t: Tables) -> DataFrame:
    c = F.when(F.col("rank") <= 5, F.get(F.array(*[F.lit(x) for x in C.RANKED_CONFIDENCE]), F.col("rank").cast("int") - 1)).otherwise("medium")
    return t.ranked.where(N.lookup(c, C.CONFIDENCE_SCORE, 0.0) >= 0.5).groupBy("query_id").agg(F.count(F.lit(1)).alias("kept"))


@query("pred11_valid_years", "SELECT year(o_orderdate) + CASE WHEN o_orderkey % 5 = 0 THEN 300 ELSE 0 END AS year, count(*) AS n FROM orders WHERE year(o_orderdate) + CASE WHEN o_orderkey % 5 = 0 THEN 300 ELSE 0 END < 2100 GROUP BY 1")
def valid_years(t: Tables) -> DataFrame:
    from ..operators.metrics import valid_year

    y = (F.year("o_orderdate").cast("long") + F.when(F.col("o_orderkey") % 5 == 0, 300).otherwise(0)).alias("year")
    return t.orders.select(y).where(valid_year(F.col("year"))).groupBy("year").agg(F.count(F.lit(1)).alias("n"))


@query("win02_first_and_last", "SELECT l_orderkey, l_partkey, min_by(l_suppkey, (l_linenumber, l_suppkey)) AS first_supplier, max_by(l_suppkey, (l_linenumber, l_suppkey)) AS last_supplier FROM lineitem GROUP BY 1, 2")
def first_and_last(t: Tables) -> DataFrame:
    order = F.struct("l_linenumber", "l_suppkey")
    return t.lineitem.groupBy("l_orderkey", "l_partkey").agg(F.min_by("l_suppkey", order).alias("first_supplier"), F.max_by("l_suppkey", order).alias("last_supplier"))


@query("join01_entities_of_papers", sql("contains entities", "SELECT paper_id, entity_type, count(*) AS n, round(sum(weight), 6) AS weight FROM contains JOIN entities ON id = entity_id GROUP BY 1, 2"))
def entities_of_papers(t: Tables) -> DataFrame:
    e = t.entities.select(F.col("id").alias("entity_id"), "entity_type")
    return t.contains.join(e, "entity_id").groupBy("paper_id", "entity_type").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("weight"), 6).alias("weight"))


@query("join06_recommended_papers", sql("ranked graph_papers", "SELECT query_id, paper_id, venue, year FROM ranked JOIN graph_papers ON id = paper_id WHERE rank <= 5"))
def recommended(t: Tables) -> DataFrame:
    return t.ranked.where("rank <= 5").join(t.graph_papers.select(F.col("id").alias("paper_id"), "venue", "year"), "paper_id").select("query_id", "paper_id", "venue", "year")


@query("join08_truth_or_none", sql("ordered citations", "SELECT o.id, coalesce(string_agg(c.target, ',' ORDER BY c.target), '') AS truth FROM ordered o LEFT JOIN citations c ON c.source = o.id GROUP BY 1"))
def truth_or_none(t: Tables) -> DataFrame:
    c = t.citations.groupBy(F.col("source").alias("id")).agg(F.sort_array(F.collect_list("target")).alias("truth"))
    return t.ordered.select("id").join(c, "id", "left").select("id", F.coalesce(F.array_join("truth", ","), F.lit("")).alias("truth"))


@query("join09_new_citations", sql("citations", "SELECT source, target FROM citations WHERE step >= 2 AND (source, target) NOT IN (SELECT (source, target) FROM citations WHERE step = 3)"))
def new_citations(t: Tables) -> DataFrame:
    c = t.citations
    return c.where("step >= 2").select("source", "target").join(c.where("step = 3").select("source", "target"), ["source", "target"], "left_anti")


@query("join11_entity_pairs", sql("contains", "SELECT a.paper_id, count(*) AS n FROM contains a JOIN contains b ON a.paper_id = b.paper_id AND a.part_key < b.part_key GROUP BY 1"))
def entity_pairs(t: Tables) -> DataFrame:
    a, b = t.contains.select("paper_id", F.col("part_key").alias("a")), t.contains.select("paper_id", F.col("part_key").alias("b"))
    return a.join(b, "paper_id").where("a < b").groupBy("paper_id").agg(F.count(F.lit(1)).alias("n"))


@query("join13_merged_papers", "SELECT 'd' || doc_id AS id, CASE WHEN lang IN ('en', 'de') THEN 'split' ELSE 'raw' END AS origin FROM documents")
def merged_papers(t: Tables) -> DataFrame:
    """All raw papers, and those of two languages as a split: the split's rows come first."""
    rows = t.documents.select(F.concat(F.lit("d"), "doc_id").alias("id"), F.col("doc_id").alias("seq"), "lang")
    a = rows.where("lang IN ('en', 'de')").withColumn("origin", F.lit("split"))
    b = rows.withColumn("origin", F.lit("raw"))
    return R.merged(a, b).select("id", "origin")


@query("join16_venue_rank", "SELECT source AS venue, CASE source WHEN 'src1' THEN 0.95 WHEN 'src2' THEN 0.9 ELSE 0.5 END::DOUBLE AS rank, count(*) AS n FROM documents GROUP BY 1")
def venue_rank(t: Tables) -> DataFrame:
    d = t.documents.groupBy(F.col("source").alias("venue")).agg(F.count(F.lit(1)).alias("n"))
    fixture = F.when(F.col("venue") == "src1", "NeurIPS").when(F.col("venue") == "src2", "US ENIX").otherwise(F.col("venue"))
    return d.select("venue", N.venue_rank(fixture).alias("rank"), "n")


SPLIT = "SELECT id, CASE WHEN p <= floor(n * 0.8) THEN 'train' WHEN p <= floor(n * 0.8) + floor(n * 0.1) THEN 'val' ELSE 'test' END AS split FROM (SELECT 'o' || o_orderkey AS id, row_number() OVER (ORDER BY md5('o' || o_orderkey), 'o' || o_orderkey) AS p, count(*) OVER () AS n FROM orders)"


@query("spl01_exact_split", SPLIT)
def exact_split(t: Tables) -> DataFrame:
    return G.split(t.ordered.select("id"))


@query("join05_same_split", sql("citations", f"WITH s AS ({SPLIT}) SELECT c.source, c.target, a.split FROM citations c JOIN s a ON a.id = c.source JOIN s b ON b.id = c.target WHERE a.split = b.split"))
def same_split(t: Tables) -> DataFrame:
    return G.same_split(t.citations.select("source", "target"), G.split(t.ordered.select("id"))).select("source", "target", "split")


@query("spl02_split_sizes", sql("citations", f"WITH s AS ({SPLIT}) SELECT s.split, count(DISTINCT s.id) AS papers, count(c.source) AS citations FROM s LEFT JOIN (SELECT c.source FROM citations c JOIN s a ON a.id = c.source JOIN s b ON b.id = c.target WHERE a.split = b.split) c ON c.source = s.id GROUP BY 1"))
def split_sizes(t: Tables) -> DataFrame:
    s = G.split(t.ordered.select("id"))
    kept = G.same_split(t.citations.select("source", "target"), s).groupBy("split").agg(F.count(F.lit(1)).alias("citations"))
    return s.groupBy("split").agg(F.count(F.lit(1)).alias("papers")).join(kept, "split", "left").select("split", "papers", F.coalesce("citations", F.lit(0)).alias("citations"))


@query("src17_union_first_wins", "SELECT 'c' || conv_id AS id, min(turn) AS seq FROM conversations GROUP BY 1")
def union_first(t: Tables) -> DataFrame:
    rows = t.conversations.select(F.concat(F.lit("c"), "conv_id").alias("id"), F.col("turn").alias("seq"))
    return R.merged(rows).select("id", "seq")


@query("src19_batches", sql("papers", "SELECT id // 128 AS batch, count(*) AS n, string_agg(venue, ',' ORDER BY id) AS venues FROM papers GROUP BY 1"))
def batches(t: Tables) -> DataFrame:
    b = R.keyed_batches(t.papers.select(F.col("id").alias("seq"), "venue"))
    return b.select("batch", F.size("venue").cast("long").alias("n"), F.array_join("venue", ",").alias("venues"))
