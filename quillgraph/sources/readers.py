"""Readers and writers of papers, citations, graphs and rankings as JSON and Parquet, with explicit schemas."""

from __future__ import annotations

import hashlib

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import constants as C
from ..functions.text import falsy, simple_clean
from .shared import file_system

WHOLE = 512 << 20  # bytes of a JSON document, at most

PAPER = "id string, title string, abstract string, authors array<string>, year int, venue string, citation_count bigint, doi string"
CITATION = "source_paper_id string, target_paper_id string, context string, position string"
QUERY = "query_paper_id string, citation_context string, ground_truth array<string>, citation_function string"

# Aliases in the order in which they are tried
PAPER_FIELDS = {
    "id": ("id", "paper_id", "_id"),
    "title": ("title", "paper_title"),
    "abstract": ("abstract", "paper_abstract"),
    "authors": ("authors", "author"),
    "year": ("year", "publication_year", "pub_year"),
    "venue": ("venue", "journal", "conference"),
    "citation_count": ("citation_count", "num_citations", "citations"),
    "doi": ("doi", "DOI"),
}
CITATION_FIELDS = {
    "source_paper_id": ("source", "source_id", "source_paper_id"),
    "target_paper_id": ("target", "target_id", "target_paper_id"),
    "context": ("context", "citation_context", "text"),
    "position": ("position", "citation_position"),
}
QUERY_FIELDS = {
    "query_paper_id": ("query_paper_id", "paper_id", "query_id"),
    "citation_context": ("citation_context", "context"),
    "ground_truth": ("ground_truth", "relevant_papers"),
    "citation_function": ("citation_function", "function"),
}


def read_json(spark: SparkSession, path: str, schema: str, lines: bool = False) -> DataFrame:
    """SRC01/SRC02: a JSON document, or one object a line (empty lines skipped, a bad line raises)."""
    reader = spark.read.schema(schema)
    return reader.option("mode", "FAILFAST").json(path) if lines else reader.option("multiLine", True).json(path)


def write_json(df: DataFrame, path: str) -> None:
    """SRC03/SRC04: one object a line."""
    df.write.mode("overwrite").json(path)


def read_objects(spark: SparkSession, path: str, envelopes: tuple[str, ...], lines: bool = False) -> DataFrame:
    """Column obj (string): the objects of a JSON document, a bare list or under the first envelope key that is a list;
    lines: of files with one object a line, which are split among tasks whatever their size.

    A document is one row of one task, so one of more than WHOLE bytes is refused: write such tables as lines.
    """
    if lines:
        return spark.read.text(path).select(F.trim("value").alias("obj")).where("obj <> ''")
    fs, name = file_system(spark, path)
    for status in fs.globStatus(name) or []:
        for file in fs.listStatus(status.getPath()):
            if file.getLen() > WHOLE:
                raise ValueError(f"{file.getPath()} has more than {WHOLE} bytes; write it with one object a line")
    raw = spark.read.text(path, wholetext=True).select("value")
    root = F.trim("value")
    lists = [F.get_json_object(root, f"$.{k}") for k in envelopes]
    found = F.when(root.startswith("["), root)
    for x in lists:
        found = F.coalesce(found, F.when(x.startswith("["), x))
    return raw.select(F.explode(F.from_json(found, "array<string>")).alias("obj"))


def opened(objects: DataFrame, fields: dict[str, tuple[str, ...]]) -> DataFrame:
    """objects (obj) with struct o: the values of all aliases as strings, from one parse of each object."""
    names = {n.lower(): n for aliases in fields.values() for n in aliases}
    schema = ", ".join(f"`{n}` string" for n in names.values())
    rows = objects.select("obj", F.from_json("obj", schema).alias("o"))
    # names that differ in case only are one column to Spark
    rest = [n for aliases in fields.values() for n in aliases if names[n.lower()] != n]
    return rows.select("obj", "o", *[F.get_json_object("obj", f"$.{n}").alias(f"_{n}") for n in rest])


def field(rows: DataFrame, names: tuple[str, ...], number: bool = False) -> Column:
    """The first of the names that has a value: null, empty and [] don't count as one, nor does 0 where a number is meant."""
    none = ("", "[]", "{}", "false") + (("0", "0.0") if number else ())
    own = set(rows.schema["o"].dataType.names)
    found = [F.col("o").getField(n) if n in own else F.col(f"_{n}") for n in names]
    return F.coalesce(*[F.when(~x.isin(*none), x) for x in found])


def authors(raw: Column) -> Column:
    """Names from a JSON string, list of strings or list of objects with name or author."""
    items = F.from_json(raw, "array<string>")
    name = lambda a: F.coalesce(falsy(F.get_json_object(a, "$.name")), falsy(F.get_json_object(a, "$.author")), F.when(~a.startswith("{"), a))
    listed = F.filter(F.transform(items, name), lambda a: a.isNotNull())
    return F.when(raw.startswith("["), listed).when(raw.isNotNull(), F.array(raw)).otherwise(F.array().cast("array<string>"))


def lenient_papers(objects: DataFrame, most: int | None = None) -> DataFrame:
    """PRJ01/SRC07: papers by their aliases; year 2000 and count 0 by default; rows without id or title are skipped."""
    if most is not None:
        objects = objects.limit(most)
    o = opened(objects, PAPER_FIELDS)
    f = {k: field(o, names, k in ("year", "citation_count")) for k, names in PAPER_FIELDS.items()}
    rows = o.select(
        f["id"].alias("id"),
        f["title"].alias("title"),
        F.coalesce(f["abstract"], F.lit("")).alias("abstract"),
        authors(f["authors"]).alias("authors"),
        F.coalesce(f["year"].try_cast("int"), F.lit(2000)).alias("year"),
        F.coalesce(f["venue"], F.lit("")).alias("venue"),
        F.coalesce(f["citation_count"].try_cast("bigint"), F.lit(0)).cast("bigint").alias("citation_count"),
        f["doi"].alias("doi"),
    )
    return rows.where("id IS NOT NULL AND title IS NOT NULL")


def strict_papers(objects: DataFrame) -> DataFrame:
    """SRC05/PRED01: papers with every required field in its type; others are dropped."""
    rows = objects.select(F.from_json("obj", PAPER).alias("p")).select("p.*")
    return rows.where("id IS NOT NULL AND title IS NOT NULL AND abstract IS NOT NULL AND authors IS NOT NULL AND year IS NOT NULL AND venue IS NOT NULL AND citation_count IS NOT NULL")


def lenient_citations(objects: DataFrame, ids: DataFrame | None = None, most: int | None = None) -> DataFrame:
    """PRJ02/SRC08: citations by their aliases; an unknown position counts as introduction. most applies first."""
    if most is not None:
        objects = objects.limit(most)
    o = opened(objects, CITATION_FIELDS)
    f = {k: field(o, names) for k, names in CITATION_FIELDS.items()}
    position = F.when(f["position"].isin(*C.POSITIONS), f["position"]).otherwise("introduction")
    rows = o.select(f["source_paper_id"].alias("source_paper_id"), f["target_paper_id"].alias("target_paper_id"), F.coalesce(f["context"], F.lit("")).alias("context"), position.alias("position"))
    return among(rows.where("source_paper_id IS NOT NULL AND target_paper_id IS NOT NULL"), ids)


def strict_citations(objects: DataFrame, ids: DataFrame | None = None) -> DataFrame:
    """SRC06: citations with all four fields and a known position; others are dropped."""
    rows = objects.select(F.from_json("obj", CITATION).alias("c")).select("c.*")
    rows = rows.where("source_paper_id IS NOT NULL AND target_paper_id IS NOT NULL AND context IS NOT NULL").where(F.col("position").isin(*C.POSITIONS))
    return among(rows, ids)


def among(citations: DataFrame, ids: DataFrame | None) -> DataFrame:
    """JOIN04: both ends among ids (id)."""
    if ids is None:
        return citations
    for end in ("source_paper_id", "target_paper_id"):
        citations = citations.join(ids.select(F.col("id").alias(end)), end, "left_semi")
    return citations


def read_dataset(spark: SparkSession, papers: str, citations: str, max_papers: int | None = None, max_citations: int | None = None, lines: bool = False) -> tuple[DataFrame, DataFrame]:
    """SRC09: papers, and the citations among them."""
    p = lenient_papers(read_objects(spark, papers, ("papers", "data", "items"), lines), max_papers)
    return p, lenient_citations(read_objects(spark, citations, ("citations", "data", "items"), lines), p, max_citations)


def read_queries(spark: SparkSession, path: str, papers: DataFrame | None = None, lines: bool = False) -> DataFrame:
    """SRC10: queries by their aliases, those of known papers only."""
    rows = opened(read_objects(spark, path, ("queries", "test_queries", "data"), lines), QUERY_FIELDS)
    f = {k: field(rows, names) for k, names in QUERY_FIELDS.items()}
    out = rows.select(
        f["query_paper_id"].alias("query_paper_id"), F.coalesce(f["citation_context"], F.lit("")).alias("citation_context"),
        F.coalesce(F.from_json(f["ground_truth"], "array<string>"), F.array().cast("array<string>")).alias("ground_truth"), F.coalesce(f["citation_function"], F.lit("background")).alias("citation_function"),
    )
    return out if papers is None else out.join(papers.select(F.col("id").alias("query_paper_id")), "query_paper_id", "left_semi")


def cleaned_papers(rows: DataFrame, least: int = 50) -> DataFrame:
    """PRJ03: papers with id, title and an abstract of `least` characters before cleaning, cleaned."""
    kept = rows.where((F.coalesce("id", F.lit("")) != "") & (F.coalesce("title", F.lit("")) != "") & (F.length("abstract") >= least))
    return kept.withColumns({"title": simple_clean(F.col("title")), "abstract": simple_clean(F.col("abstract")), "year": F.coalesce(falsy(F.col("year"), "int"), F.lit(2000)), "citation_count": F.coalesce("citation_count", F.lit(0))})


def citations_of_references(papers: DataFrame) -> DataFrame:
    """PRJ04: a citation for each reference (JSON string: object or id) to a paper that is there; repeats stay."""
    rows = papers.select("id", F.explode("references").alias("r"))
    target = F.coalesce(falsy(F.get_json_object("r", "$.paper_id")), falsy(F.get_json_object("r", "$.paperId")), falsy(F.get_json_object("r", "$.id")), F.when(~F.col("r").startswith("{"), F.col("r")))
    rows = rows.select(F.col("id").alias("source_paper_id"), target.alias("target_paper_id"))
    return rows.join(papers.select(F.col("id").alias("target_paper_id")), "target_paper_id", "left_semi").select("source_paper_id", "target_paper_id", F.lit("").alias("context"), F.lit("introduction").alias("position"))


def write_graph(nodes: DataFrame, edges: DataFrame, path: str) -> None:
    """SRC11: nodes and edges as Parquet."""
    nodes.write.mode("overwrite").parquet(f"{path}/nodes")
    edges.write.mode("overwrite").parquet(f"{path}/edges")


def read_graph(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """SRC11: nodes and edges; a missing relation type is unknown, a missing weight 1."""
    edges = spark.read.parquet(f"{path}/edges")
    return spark.read.parquet(f"{path}/nodes"), edges.withColumns({"relation_type": F.coalesce("relation_type", F.lit("unknown")), "weight": F.coalesce("weight", F.lit(1.0))})


EDGE = "source string, target string, relation_type string, weight double"


def write_edges_by_source(edges: DataFrame, path: str, buckets: int = 64) -> DataFrame:
    """SRC11: edges (source, target, relation_type, weight) in `buckets` files by their source, each sorted by it, and read back: a
    join on source takes them as they lie, so in walks they are neither shuffled nor sorted. The folder's name tells the
    number of buckets; files of earlier writes go."""
    fs, root = file_system(edges.sparkSession, path)
    fs.delete(root, True)
    edges.sparkSession.sql(f"DROP TABLE IF EXISTS {_table(path, buckets)}")
    rows = edges.select(*[F.col(c.split()[0]) for c in EDGE.split(", ")]).repartition(buckets, "source")
    rows.write.bucketBy(buckets, "source").sortBy("source").format("parquet").option("path", f"{path}/by-source-{buckets}").saveAsTable(_table(path, buckets))
    return read_edges_by_source(edges.sparkSession, path)


def read_edges_by_source(spark: SparkSession, path: str) -> DataFrame:
    """SRC11: what write_edges_by_source has written, by this session or another one."""
    fs, root = file_system(spark, path)
    found = [s.getPath().getName() for s in fs.listStatus(root) if s.getPath().getName().startswith("by-source-")]
    if len(found) != 1:
        raise ValueError(f"{path} holds {len(found)} tables of edges")
    buckets = int(found[0].rpartition("-")[2])
    name = _table(path, buckets)
    spark.sql(f"CREATE TABLE IF NOT EXISTS {name} ({EDGE}) USING parquet CLUSTERED BY (source) SORTED BY (source) INTO {buckets} BUCKETS LOCATION '{path}/{found[0]}'")
    spark.catalog.refreshTable(name)
    return spark.table(name)


def _table(path: str, buckets: int) -> str:
    """A name for the session's catalog, the same for the same folder."""
    return f"edges_{hashlib.sha256(path.encode()).hexdigest()[:24]}_{buckets}"


def read_graph_json(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """SRC11: the same from nodes.json and edges.json."""
    nodes = read_json(spark, f"{path}/nodes.json", "id string, node_type string, title string, abstract string, authors array<string>, year int, venue string, citation_count bigint, doi string, text string, entity_type string, canonical string, weight double, embedding array<double>")
    edges = read_json(spark, f"{path}/edges.json", "source string, target string, relation_type string, weight double")
    return nodes, edges.withColumns({"relation_type": F.coalesce("relation_type", F.lit("unknown")), "weight": F.coalesce("weight", F.lit(1.0))})


def write_mentions(mentions: DataFrame, path: str) -> None:
    """SRC12: entities or relations of papers, partitioned by entity type."""
    mentions.write.mode("overwrite").partitionBy("entity_type").parquet(path)


def write_vectors(vectors: DataFrame, path: str) -> None:
    """SRC13: (id, v) as Parquet."""
    vectors.select("id", F.col("v").cast("array<float>").alias("v")).write.mode("overwrite").parquet(path)


def merged(*sources: DataFrame) -> DataFrame:
    """SRC17/JOIN13: papers of all sources, each id from the first that has it (rows have id and seq)."""
    from ..operators.graph import latest

    all_ = None
    for k, s in enumerate(sources):
        s = s.withColumn("_source", F.lit(k))
        all_ = s if all_ is None else all_.unionByName(s, allowMissingColumns=True)
    return latest(all_, ["id"], [F.col("_source"), F.col("seq")]).drop("_source")


def keyed_batches(papers: DataFrame, size: int = 128) -> DataFrame:
    """SRC19: rows as columns: batches of `size` successive papers with an array of each field."""
    batch = F.floor(F.col("seq") / size).alias("batch")
    fields = [c for c in papers.columns if c != "seq"]
    rows = papers.groupBy(batch).agg(F.sort_array(F.collect_list(F.struct("seq", *fields))).alias("r"))
    return rows.select("batch", *[F.col(f"r.{c}").alias(c) for c in fields])
