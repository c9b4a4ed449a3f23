"""The whole workflow in named steps, each from files to files, which may be run one by one."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.vectors import initial
from ..operators import graph as G
from ..operators import similarity as S
from ..sources import readers as R
from ..sources.shared import file_system
from . import pipeline
from . import stages as T
from .encode import Predict, encode
from .recommend import Settings


@dataclass
class Work:
    """Where files lie, and what may take the rules' places (UDF11): every stage is a field."""

    spark: SparkSession
    folder: str
    papers: str  # file of papers
    citations: str | None = None
    queries: str | None = None
    lines: bool = False  # files hold one object a line
    settings: Settings = field(default_factory=Settings)
    least: int = 50
    dim: int = 64
    tagger: T.Batch | None = None
    classifier: T.Batch | None = None
    client: T.Batch | None = None
    vectors: Callable[[DataFrame], DataFrame] | None = None  # (entity_id) to (entity_id, v)
    encoder: Callable[[], Predict] | None = None  # or a model for entities' names, through the cache in the folder

    def path(self, name: str) -> str:
        return f"{self.folder}/{name}"

    def read(self, name: str) -> DataFrame:
        return self.spark.read.parquet(self.path(name))

    def write(self, name: str, df: DataFrame) -> None:
        df.write.mode("overwrite").parquet(self.path(name))

    def done(self, name: str) -> bool:
        fs, at = file_system(self.spark, f"{self.path(name)}/_SUCCESS")
        return fs.exists(at)


def acquire(w: Work) -> None:
    """Papers with id and abstract, and the citations among them, as tables."""
    objects = R.read_objects(w.spark, w.papers, ("papers", "data", "items"), w.lines)
    w.write("papers", R.lenient_papers(objects).where("abstract <> ''"))
    if w.citations:
        c = R.read_objects(w.spark, w.citations, ("citations", "data", "items"), w.lines)
        w.write("citations", R.lenient_citations(c, w.read("papers").select("id")))


def preprocess(w: Work) -> None:
    w.write("clean", R.cleaned_papers(w.read("papers"), w.least).dropDuplicates(["id"]))


def extract(w: Work) -> None:
    clean = w.read("clean")
    w.write("mentions", T.link(T.tag_entities(clean, w.tagger), clean))
    w.write("relations", T.relate(w.read("mentions"), w.classifier, papers=clean))


def build_graph(w: Work) -> None:
    """Nodes (papers and entities) and edges (contains and relations)."""
    mentions, relations = w.read("mentions"), w.read("relations")
    contains = mentions.groupBy(F.col("paper_id").alias("source"), F.col("entity_id").alias("target")).agg(F.lit("contains").alias("relation_type"), F.max("weight").alias("weight"))
    entities = mentions.groupBy(F.col("entity_id").alias("id")).agg(F.min("entity_type").alias("node_type"))
    nodes = w.read("clean").select("id", F.lit("paper").alias("node_type")).unionByName(entities)
    R.write_graph(nodes, contains.unionByName(relations.select("source", "target", "relation_type", "weight")), w.path("graph"))


def embeddings(w: Work) -> None:
    """Vectors of entities: the start vectors, or what a model's function gives."""
    names = w.read("mentions").select("entity_id").distinct()
    if w.vectors:
        vectors = w.vectors(names)
    elif w.encoder:
        vectors = encode(names.select(F.col("entity_id").alias("id"), F.col("entity_id").alias("text")), w.dim, w.path("vector_cache"), w.encoder).withColumnRenamed("id", "entity_id")
    else:
        vectors = names.select("entity_id", initial(F.col("entity_id"), w.dim).alias("v"))
    w.write("vectors", vectors)
    mentions = w.read("mentions").select("paper_id", "entity_id", "entity_type", "weight")
    w.write("profiles", S.type_profiles(mentions, S.unit_vectors(w.read("vectors"))))


def train(w: Work) -> None:
    """Papers in exact splits, and the citations within each: what models are trained and tested on."""
    w.write("splits", G.split(w.read("clean").select("id")))
    if w.done("citations"):
        edges = w.read("citations").select(F.col("source_paper_id").alias("source"), F.col("target_paper_id").alias("target"))
        w.write("split_citations", G.same_split(edges, w.read("splits")))


def loaded(w: Work) -> pipeline.Graph:
    return pipeline.Graph(w.read("clean"), w.read("mentions"), w.read("relations"), w.read("profiles"))


def questions(w: Work) -> DataFrame:
    """Queries of the file, or else the papers of the test split that cite others."""
    if w.queries:
        return R.read_queries(w.spark, w.queries, w.read("clean"), w.lines)
    cited = w.read("split_citations").where("split = 'test'")
    return cited.groupBy(F.col("source").alias("query_paper_id")).agg(F.lit("").alias("citation_context"), F.collect_set("target").alias("ground_truth"))


def inference(w: Work) -> None:
    asked = questions(w).select(F.col("query_paper_id").alias("query_id"), F.col("citation_context").alias("context"))
    w.write("recommendations", pipeline.answer(loaded(w), asked, w.settings, w.client))


def evaluation(w: Work) -> None:
    truth = questions(w).select(F.col("query_paper_id").alias("query_id"), F.explode("ground_truth").alias("paper_id"))
    w.write("metrics", pipeline.judge(w.read("recommendations"), truth, loaded(w)))


#: E2E03: steps in order, and the table that each writes last
STEPS: dict[str, tuple[Callable[[Work], None], str]] = {
    "acquire": (acquire, "papers"),
    "preprocess": (preprocess, "clean"),
    "extract": (extract, "relations"),
    "build_graph": (build_graph, "graph/edges"),
    "embeddings": (embeddings, "profiles"),
    "train": (train, "splits"),
    "inference": (inference, "recommendations"),
    "evaluate": (evaluation, "metrics"),
}


def run(w: Work, step: str = "all", skip_if_exists: bool = False) -> list[str]:
    """E2E05: one step, or all in order; returns the names of those that ran. skip_if_exists: a step whose last table is
    complete isn't run again. A step that fails raises, and none after it runs."""
    if step != "all" and step not in STEPS:
        raise ValueError(f"unknown step {step}; one of all, {', '.join(STEPS)}")
    ran = []
    for name, (make, last) in STEPS.items():
        if step not in ("all", name) or skip_if_exists and w.done(last):
            continue
        make(w)
        ran.append(name)
    return ran


DEMO = [
    ("tides", "Forecasting tides from harbour gauges", "A regression model with a seasonal method predicts water levels; we report its accuracy on a dataset of nine harbours.", 2013, 12),
    ("pollen", "Counting pollen under the microscope", "Segmentation and classification of pollen grains, with a corpus of slides that three people labelled.", 2018, 31),
    ("drums", "Transcribing drum recordings", "We compare a model of onsets with a baseline for the transcription task; precision rises on a benchmark of live recordings.", 2009, 240),
    ("bees", "Listening to bee hives", "Hives are recorded for a year; a classification model tells swarming days, and a dataset is published.", 2016, 7),
    ("rivers", "Gauging rivers from space", "We use a method for water levels from tide models and a dataset of satellite passes for a prediction task.", 2019, 58),
    ("choirs", "Separating the voices of a choir", "A separation method and its evaluation metric, with recall and accuracy for four voices.", 2011, 95),
]


def demo(spark: SparkSession, top_k: int = 5) -> DataFrame:
    """E2E06: recommendations for one paper of a small table."""
    schema = "id string, title string, abstract string, year int, citation_count bigint"
    papers = spark.createDataFrame(DEMO, schema).withColumns({"venue": F.lit("Conference"), "authors": F.array(F.lit("A. Author"))})
    graph = pipeline.build(papers, least=0)
    asked = spark.createDataFrame([("rivers", "We use their model for the prediction of levels.")], "query_id string, context string")
    return pipeline.answer(graph, asked, Settings(recommended=top_k))
