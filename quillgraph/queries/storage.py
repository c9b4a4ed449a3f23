"""Readers and writers: tables go out as files to the shared folder and come back."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..plans.bindings import Tables, sql
from ..sources import readers as R
from ..sources.shared import shared_path
from . import query
from .ingest import citation_objects, paper_objects


def folder(t: Tables, name: str) -> str:
    return shared_path(t.spark, name)


def document(t: Tables, objects: DataFrame, key: str | None, name: str) -> str:
    """Write rows obj of a small fixed table as one JSON document, a list or an object with the list under key."""
    path = folder(t, name)
    body = F.concat(F.lit("["), F.array_join(F.collect_list("obj"), ",\n"), F.lit("]"))
    body = body if key is None else F.concat(F.lit(f'{{"{key}": '), body, F.lit("}"))
    objects.agg(body.alias("value")).coalesce(1).write.text(path)
    return path


def lines(t: Tables, df: DataFrame, name: str) -> str:
    path = folder(t, name)
    R.write_json(df, path)
    return path


@query("src01_json_document", "SELECT n_nationkey AS k, n_name AS name FROM nation")
def json_document(t: Tables) -> DataFrame:
    path = document(t, t.nation.select(F.to_json(F.struct(F.col("n_nationkey").alias("k"), F.col("n_name").alias("name"))).alias("obj")), None, "src01")
    return R.read_json(t.spark, path, "k int, name string")


@query("src02_json_lines", "SELECT event_id, event_type, round(value, 6) AS value FROM events")
def json_lines(t: Tables) -> DataFrame:
    return R.read_json(t.spark, lines(t, t.events.select("event_id", "event_type", F.round("value", 6).alias("value")), "src02"), "event_id bigint, event_type string, value double", lines=True)


@query("src03_json_sink", "SELECT p_partkey, p_name FROM part")
def json_sink(t: Tables) -> DataFrame:
    return R.read_json(t.spark, lines(t, t.part.select("p_partkey", "p_name"), "src03"), "p_partkey bigint, p_name string", lines=True)


@query("src07_lenient_papers", "SELECT CAST(item_id AS VARCHAR) AS id, left(text, 20) AS title, CAST(2000 AS INTEGER) AS year FROM benchmark WHERE item_id % 5 <> 0")
def lenient_papers(t: Tables) -> DataFrame:
    i, head = F.col("item_id").cast("string"), F.substring("text", 1, 20)
    obj = F.when(F.col("item_id") % 5 == 0, F.to_json(F.struct(i.alias("id")))).when(F.col("item_id") % 2 == 0, F.to_json(F.struct(i.alias("paper_id"), head.alias("paper_title")))).otherwise(F.to_json(F.struct(i.alias("id"), head.alias("title"), F.lit("?").alias("year"))))
    path = document(t, t.benchmark.select(obj.alias("obj")), "papers", "src07")
    return R.lenient_papers(R.read_objects(t.spark, path, ("papers", "data", "items"))).select("id", "title", "year")


@query("src08_lenient_citations", sql("citations", "SELECT count(*) AS n, count(*) FILTER (step = 2) AS n_default FROM citations"))
def lenient_citations(t: Tables) -> DataFrame:
    path = folder(t, "src08")
    citation_objects(t).select(F.col("obj").alias("value")).write.text(path)
    objects = t.spark.read.text(path).select(F.col("value").alias("obj"))
    return R.lenient_citations(objects).agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("position") == "introduction").alias("n_default"))


@query("src09_dataset", sql("citations ordered graph_papers", "SELECT count(*) AS n FROM citations WHERE source IN (SELECT id FROM graph_papers WHERE citation_count > 100) AND target IN (SELECT id FROM graph_papers WHERE citation_count > 100)"))
def dataset(t: Tables) -> DataFrame:
    """All papers and citations; papers of few citations come without a title, which the reader refuses."""
    title = F.when(F.col("citation_count") > 100, "t")
    objects = t.graph_papers.select(F.to_json(F.struct("id", title.alias("title"))).alias("obj"))
    return R.lenient_citations(citation_objects(t), R.lenient_papers(objects)).agg(F.count(F.lit(1)).alias("n"))


@query("src10_query_file", "SELECT 'o' || n_nationkey AS query_paper_id, 2::BIGINT AS n_truth, 'background' AS citation_function FROM nation WHERE n_nationkey IN (SELECT o_orderkey FROM orders)")
def query_file(t: Tables) -> DataFrame:
    i = F.concat(F.lit("o"), "n_nationkey")
    path = document(t, t.nation.select(F.to_json(F.struct(i.alias("query_id"), F.col("n_name").alias("context"), F.array(F.lit("a"), F.lit("b")).alias("relevant_papers"))).alias("obj")), "test_queries", "src10")
    q = R.read_queries(t.spark, path, t.ordered.select("id"))
    return q.select("query_paper_id", F.size("ground_truth").cast("long").alias("n_truth"), "citation_function")


@query("src11_graph_files", sql("graph_papers entities contains", "SELECT (SELECT count(*) FROM graph_papers) + (SELECT count(*) FROM entities) AS nodes, count(*) AS edges, count(*) FILTER (seq % 2 = 0) AS unknown, round(sum(CASE WHEN seq % 2 = 0 THEN 1 ELSE weight END), 4)::DOUBLE AS weight FROM contains"))
def graph_files(t: Tables) -> DataFrame:
    path, even = folder(t, "src11"), F.col("seq") % 2 == 0
    nodes = t.graph_papers.select("id", F.lit("paper").alias("node_type")).unionByName(t.entities.select("id", F.lit("entity").alias("node_type")))
    edges = t.contains.select(F.col("paper_id").alias("source"), F.col("entity_id").alias("target"), F.when(~even, "contains").alias("relation_type"), F.when(~even, F.col("weight")).alias("weight"))
    R.write_graph(nodes, edges, path)
    n, e = R.read_graph(t.spark, path)
    out = e.agg(F.count(F.lit(1)).alias("edges"), F.count_if(F.col("relation_type") == "unknown").alias("unknown"), F.round(F.sum("weight"), 4).alias("weight"))
    return out.join(F.broadcast(n.agg(F.count(F.lit(1)).alias("nodes")))).select("nodes", "edges", "unknown", "weight")


@query("src11_edges_by_source", sql("relations", "SELECT a.source, count(*) AS n, round(sum(a.weight * b.weight), 6)::DOUBLE AS weight FROM relations a JOIN relations b ON b.source = a.target GROUP BY 1"))
def edges_by_source(t: Tables) -> DataFrame:
    """Walks of two relations over edges that lie by their source."""
    e = R.write_edges_by_source(t.relations, folder(t, "src11-edges"), 8)
    onward = e.select(F.col("source").alias("mid"), F.col("weight").alias("w"))
    rows = t.once("relations").withColumnRenamed("target", "mid").join(onward, "mid")
    return rows.groupBy("source").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum(F.col("weight") * F.col("w")), 6).alias("weight"))


@query("src12_mention_files", sql("contains entities", "SELECT entity_type, count(*) AS n FROM contains JOIN entities ON id = entity_id GROUP BY 1"))
def mention_files(t: Tables) -> DataFrame:
    path = folder(t, "src12")
    R.write_mentions(t.contains.join(t.entities.select(F.col("id").alias("entity_id"), "entity_type"), "entity_id").select("paper_id", "entity_id", "entity_type"), path)
    return t.spark.read.schema("paper_id string, entity_id string, entity_type string").parquet(path).groupBy("entity_type").agg(F.count(F.lit(1)).alias("n"))


@query("src13_vector_files", "SELECT vec_id AS id, round(embedding[1]::DOUBLE, 6) AS first FROM embeddings")
def vector_files(t: Tables) -> DataFrame:
    path = folder(t, "src13")
    R.write_vectors(t.embeddings.select(F.col("vec_id").alias("id"), F.col("embedding").alias("v")), path)
    return t.spark.read.schema("id bigint, v array<float>").parquet(path).select("id", F.round(F.get("v", 0).cast("double"), 6).alias("first"))


@query("src20_result_files", sql("ranked", "SELECT query_id, count(*) AS n FROM ranked WHERE rank <= 10 GROUP BY 1"))
def result_files(t: Tables) -> DataFrame:
    rows = t.ranked.where("rank <= 10").groupBy("query_id").agg(F.transform(F.sort_array(F.collect_list(F.struct("rank", "paper_id"))), lambda x: x["paper_id"]).alias("recommendations"))
    back = R.read_json(t.spark, lines(t, rows, "src20"), "query_id string, recommendations array<string>", lines=True)
    return back.select("query_id", F.size("recommendations").cast("long").alias("n"))


@query("pred01_required_fields", "SELECT CAST(doc_id AS VARCHAR) AS id FROM documents WHERE doc_id % 4 <> 3 AND text <> ''")
def required(t: Tables) -> DataFrame:
    return R.lenient_papers(paper_objects(t)).select("id")
