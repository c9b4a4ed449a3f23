"""Papers to recommendations and metrics, on a handful of papers, with rules and with batch functions in their place."""

import json

import pandas as pd
import pytest
from pyspark.sql import functions as F

from quillgraph.__main__ import main
from quillgraph.plans import pipeline, steps
from quillgraph.plans.recommend import Settings
from quillgraph.plans.stages import surviving
from quillgraph.sources import readers as R
from quillgraph.sources.config import load_config, settings_from

PAD = " It is written at some length so that nobody drops it for being short."
PAPERS = [
    {"id": "q", "title": "A model for ranking", "abstract": "We use a model and a dataset to measure accuracy of the task." + PAD, "year": 2020, "venue": "ACL", "citation_count": 3},
    {"id": "a", "title": "Another model", "abstract": "A model with better accuracy on the same dataset." + PAD, "year": 2018, "venue": "ACL", "citation_count": 50},
    {"id": "b", "title": "A corpus", "abstract": "This corpus is a benchmark." + PAD, "year": 2010, "venue": "arXiv", "citation_count": 5},
    {"id": "c", "title": "The task revisited", "abstract": "A problem and a goal, with data." + PAD, "year": 2023, "venue": "Nature", "citation_count": 500},
    {"id": "d", "title": "Too short", "abstract": "model", "year": 2023},
]


def papers(spark):
    return R.lenient_papers(spark.createDataFrame([(json.dumps(p),) for p in PAPERS], "obj string"))


def test_build_and_answer(spark):
    graph = pipeline.build(papers(spark))
    assert {r.id for r in graph.papers.collect()} == {"q", "a", "b", "c"}
    assert {(r.entity_type, r.canonical) for r in graph.mentions.where("paper_id = 'a'").collect()} == {("method", "model"), ("material", "dataset"), ("material", "data"), ("metric", "accuracy")}
    queries = spark.createDataFrame([("q", "we use this"), ("b", None)], "query_id string, context string")
    got = pipeline.answer(graph, queries, Settings(recommended=5)).orderBy("query_id", "rank").collect()
    mine = [r for r in got if r.query_id == "q"]
    assert [r.rank for r in mine] == list(range(1, len(mine) + 1)) and {r.paper_id for r in mine} <= {"a", "b", "c"}
    assert {r.function for r in mine} == {"use"} and mine[0].confidence == "high"
    truth = spark.createDataFrame([("q", "a")], "query_id string, paper_id string")
    row = pipeline.judge(pipeline.answer(graph, queries), truth, graph).first()
    assert row.evidence == 1.0 and row.path_coverage == 1.0 and 0 < row.map <= 1


def test_batch_functions_take_the_rules_places(spark):
    def tagger(frames):
        for f in frames:
            yield pd.DataFrame({"paper_id": f["id"], "pos": 0, "entity_type": "task", "text": "shared thing"})

    def classifier(frames):
        for f in frames:
            yield pd.DataFrame({"source": f["source"], "target": f["target"], "relation_type": "use", "weight": 0.4})

    def client(frames):
        for f in frames:
            yield pd.DataFrame({"query_id": f["query_id"], "response": ['[{"paper_id": "a", "reason": "r"}, {"paper_id": "nobody", "reason": "r"}]'] * len(f)})

    graph = pipeline.build(papers(spark), tagger=tagger, classifier=classifier)
    assert graph.relations.count() == 0  # below the threshold
    queries = spark.createDataFrame([("q", "compare")], "query_id string, context string")
    got = pipeline.answer(graph, queries, client=client).collect()
    assert [(r.query_id, r.paper_id, r.function) for r in got] == [("q", "a", "compare")]


def test_command_line(spark, tmp_path):
    (tmp_path / "p.json").write_text(json.dumps({"papers": PAPERS}))
    (tmp_path / "q.json").write_text(json.dumps({"queries": [{"query_paper_id": "q", "context": "use", "ground_truth": ["a", "c"]}, {"query_paper_id": "unknown"}]}))
    where = ["--papers", str(tmp_path / "p.json"), "--queries", str(tmp_path / "q.json")]
    main(["recommend", *where, "--out", str(tmp_path / "o"), "--top-k", "5"])
    main(["evaluate", *where, "--predictions", str(tmp_path / "o"), "--out", str(tmp_path / "m")])
    row = spark.read.json(str(tmp_path / "m")).first()
    assert row.mrr == 1.0 and row.r_at_5 == 1.0
    assert spark.read.json(str(tmp_path / "o")).select(F.countDistinct("query_id")).first()[0] == 1


def test_a_client_that_raises(spark):
    def client(frame):
        if "b" in set(frame["query_id"]):
            raise RuntimeError("no answer")
        return pd.DataFrame({"query_id": frame["query_id"], "response": ['[{"paper_id": "a", "reason": "r"}]'] * len(frame)})

    graph = pipeline.build(papers(spark))
    queries = spark.createDataFrame([("q", "we use this"), ("b", None)], "query_id string, context string").coalesce(1)
    got = pipeline.answer(graph, queries, client=surviving(client)).collect()
    assert [(r.query_id, r.paper_id) for r in got] == [("q", "a")]


def test_steps_and_what_is_skipped(spark, tmp_path):
    (tmp_path / "p.json").write_text("\n".join(map(json.dumps, PAPERS)))
    pairs = [("q", "a"), ("a", "b"), ("b", "c"), ("q", "nobody")]
    (tmp_path / "c.json").write_text("\n".join(json.dumps({"source": a, "target": b}) for a, b in pairs))
    (tmp_path / "q.json").write_text(json.dumps({"query_paper_id": "q", "context": "use", "ground_truth": ["a", "c"]}))
    w = steps.Work(spark, str(tmp_path / "w"), str(tmp_path / "p.json"), str(tmp_path / "c.json"), str(tmp_path / "q.json"), lines=True)
    assert steps.run(w) == list(steps.STEPS)
    assert w.read("citations").count() == 3 and w.read("splits").count() == 4
    assert w.read("metrics").first().r_at_5 == 1.0
    nodes, edges = R.read_graph(spark, w.path("graph"))
    assert nodes.where("node_type = 'paper'").count() == 4 and edges.where("relation_type = 'contains'").count() > 5
    assert steps.run(w, skip_if_exists=True) == [] and steps.run(w, "extract", skip_if_exists=True) == []
    assert steps.run(w, "evaluate") == ["evaluate"]
    with pytest.raises(ValueError):
        steps.run(w, "nothing")


def test_other_modes(spark, tmp_path):
    (tmp_path / "p.json").write_text(json.dumps({"papers": PAPERS}))
    (tmp_path / "q.json").write_text(json.dumps({"queries": [{"query_paper_id": "q", "context": "use", "ground_truth": ["a", "c"]}]}))
    (tmp_path / "c.yaml").write_text("recommend:\n  recommended: 1\n  gamma: 0.5\nother:\n  deep:\n    key: 3\n")
    p, out = ["--papers", str(tmp_path / "p.json")], str(tmp_path / "o")
    main(["test", *p, "--queries", str(tmp_path / "q.json"), "--out", out, "--config", str(tmp_path / "c.yaml")])
    assert spark.read.json(f"{out}/metrics").count() == 1 and spark.read.json(f"{out}/recommendations").count() <= 5
    main(["inference", *p, "--query-id", "q", "--context", "use", "--out", f"{out}-i"])
    assert spark.read.json(f"{out}-i").where("paper_id = 'a'").count() == 1
    main(["train", *p, "--out", f"{out}-t"])
    assert spark.read.parquet(f"{out}-t/splits").count() == 4
    main(["demo", "--out", f"{out}-d"])
    assert {r.paper_id for r in spark.read.json(f"{out}-d").collect()} <= {"tides", "pollen", "drums", "bees", "choirs"}
    with pytest.raises(ValueError):
        main(["inference", *p, "--query-id", "nobody", "--context", "use", "--out", f"{out}-n"])
    with pytest.raises(SystemExit):
        main(["evaluate", *p, "--out", out])
    c = load_config(spark, str(tmp_path / "c.yaml"))
    assert c.other.deep.key == c["other.deep.key"] == 3 and c.get("other.none", 1) == 1 and "recommend.gamma" in c and "no" not in c
    assert settings_from(c, Settings, "recommend") == Settings(recommended=1, gamma=0.5)
    assert Settings(recommended=4, retrieved=None).pool == 20 and Settings(recommended=40).pool == 80
