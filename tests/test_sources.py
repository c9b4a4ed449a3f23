"""Readers on small files with every alias and edge case."""

import json

from quillgraph.operators.spans import decode_bio
from quillgraph.plans import recommend as P
from quillgraph.sources import readers as R
from quillgraph.streaming.upsert import current, stream_into

PAPERS = [
    {"id": "p1", "title": "A", "abstract": "x", "authors": "Ann", "year": "2015", "venue": "ACL", "citation_count": 3, "doi": "d"},
    {"paper_id": "p2", "paper_title": "B", "authors": [{"name": "Bo"}, {"author": "Cy"}], "pub_year": 1999, "journal": "J", "num_citations": 7},
    {"id": "", "_id": "p3", "title": "C", "author": ["Di", "Ed"], "year": "n/a", "conference": "K", "citations": 0},
    {"id": "p4"},
    {"title": "no id"},
    {"id": "0", "title": "zero", "year": 0},
]


def test_lenient_papers_and_envelopes(spark, tmp_path):
    for k, doc in enumerate([PAPERS, {"papers": PAPERS}, {"data": PAPERS}, {"items": PAPERS}]):
        path = tmp_path / f"p{k}.json"
        path.write_text(json.dumps(doc))
        got = {r.id: r for r in R.lenient_papers(R.read_objects(spark, str(path), ("papers", "data", "items"))).collect()}
        assert set(got) == {"p1", "p2", "p3", "0"}
        assert (got["p1"].authors, got["p1"].year, got["p1"].doi) == (["Ann"], 2015, "d")
        assert (got["p2"].authors, got["p2"].year, got["p2"].venue, got["p2"].citation_count) == (["Bo", "Cy"], 1999, "J", 7)
        assert (got["p3"].authors, got["p3"].year, got["p3"].citation_count, got["0"].year) == (["Di", "Ed"], 2000, 0, 2000)


def test_strict_readers(spark, tmp_path):
    whole = {"id": "a", "title": "t", "abstract": "b", "authors": ["x"], "year": 2001, "venue": "v", "citation_count": 1}
    bad = dict(whole, id="b", year="soon")
    (tmp_path / "p.json").write_text(json.dumps({"papers": [whole, bad, {"id": "c"}]}))
    papers = R.strict_papers(R.read_objects(spark, str(tmp_path / "p.json"), ("papers", "data")))
    assert [r.id for r in papers.collect()] == ["a"]
    cites = [{"source_paper_id": "a", "target_paper_id": "a", "context": "c", "position": p} for p in ("experiment", "nowhere")] + [{"source_paper_id": "a", "target_paper_id": "q", "context": "c", "position": "experiment"}]
    (tmp_path / "c.json").write_text(json.dumps(cites))
    objects = R.read_objects(spark, str(tmp_path / "c.json"), ("citations", "data"))
    assert R.strict_citations(objects, papers).count() == 1
    assert sorted(r.position for r in R.lenient_citations(objects).collect()) == ["experiment", "experiment", "introduction"]
    assert R.lenient_citations(objects, None, 1).count() == 1


def test_queries_lines_and_graph(spark, tmp_path):
    (tmp_path / "q.json").write_text(json.dumps({"test_queries": [{"query_id": "a", "context": "c", "relevant_papers": ["x", "y"]}, {"paper_id": "zz"}]}))
    ids = spark.createDataFrame([("a",)], "id string")
    q = R.read_queries(spark, str(tmp_path / "q.json"), ids).collect()
    assert [(r.query_paper_id, r.ground_truth, r.citation_function) for r in q] == [("a", ["x", "y"], "background")]
    (tmp_path / "l.jsonl").write_text('{"id": "a"}\n\n{"id": "b"}\n')
    lines = R.read_json(spark, str(tmp_path / "l.jsonl"), "id string", lines=True)
    assert lines.where("id IS NOT NULL").count() == 2
    R.write_json(lines, str(tmp_path / "out"))
    assert R.read_json(spark, str(tmp_path / "out"), "id string", lines=True).where("id IS NOT NULL").count() == 2
    edges = spark.createDataFrame([("a", "b", None, None)], "source string, target string, relation_type string, weight double")
    R.write_graph(ids, edges, str(tmp_path / "g"))
    nodes, back = R.read_graph(spark, str(tmp_path / "g"))
    assert nodes.count() == 1 and tuple(back.first()) == ("a", "b", "unknown", 1.0)


def test_references(spark):
    rows = [("a", ['{"paper_id": "b"}', "c", '{"paperId": "b"}', "zz"]), ("b", []), ("c", None)]
    got = R.citations_of_references(spark.createDataFrame(rows, "id string, references array<string>")).collect()
    assert sorted((r.source_paper_id, r.target_paper_id) for r in got) == [("a", "b"), ("a", "b"), ("a", "c")]


def test_parse_responses(spark):
    item = {"paper_id": "a", "reason": "r", "citation_position": "experiment", "confidence": "low", "score": 0.5}
    texts = {
        "list": "Sure: " + json.dumps([item, dict(item, paper_id=""), dict(item, confidence="sure"), {"paper_id": "b"}]),
        "object": "x " + json.dumps(item) + " y",
        "bracket": json.dumps([dict(item, reason="see [1] there")]),
        "none": "no json here",
        "word": json.dumps([dict(item, score="high")]),
        "null": None,
    }
    got = {}
    for r in P.parsed(spark.createDataFrame(list(texts.items()), "query_id string, response string")).collect():
        got.setdefault(r.query_id, []).append((r.paper_id, r.confidence, r.score))
    assert got == {"list": [("a", "low", 0.5), ("b", "medium", 0.0)], "object": [("a", "low", 0.5)]}


def test_bio(spark):
    labels = ["B-Task", "I-Task", "I-Method", "O", "I-Metric", "B-Metric", "O", "B-Task"]
    words = spark.createDataFrame([(1, i, f"w{i}", x) for i, x in enumerate(labels)], "doc_id int, pos int, w string, label string")
    got = sorted((r.first_pos, r.entity_type, r.text) for r in decode_bio(words).collect())
    assert got == [(0, "task", "w0 w1"), (2, "method", "w2"), (4, "metric", "w4"), (5, "metric", "w5"), (7, "task", "w7")]


def test_stream_upserts(spark, tmp_path):
    schema = "id string, title string, seq long"
    source, out = str(tmp_path / "in"), str(tmp_path / "out")
    for rows in ([("a", "old", 1), ("b", "b", 1)], [("a", "new", 2), ("c", "c", 1)]):
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(source)
        stream_into(spark.readStream.schema(schema).parquet(source), out, str(tmp_path / "ck"), ["id"], "seq").awaitTermination()
    assert sorted(tuple(r) for r in current(spark, out).select("id", "title").collect()) == [("a", "new"), ("b", "b"), ("c", "c")]


def test_edges_by_source_are_joined_as_they_lie(spark, tmp_path):
    rows = [(f"n{k % 7}", f"n{k % 11}", "use", float(k)) for k in range(60)]
    path = f"file://{tmp_path}/edges"
    for most in (60, 50):  # a second write replaces the first
        edges = R.write_edges_by_source(spark.createDataFrame(rows[:most], R.EDGE), path, 4)
        assert sorted(tuple(r) for r in edges.collect()) == sorted(rows[:most])
    again = R.read_edges_by_source(spark, path)
    assert again.count() == 50
    front = spark.createDataFrame([(f"n{k}",) for k in range(9)], "source string")
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        joined = front.join(again, "source")
        plan = joined._jdf.queryExecution().executedPlan().toString()
        assert joined.count() == 50 and plan.count("Exchange hashpartitioning") == 1, plan
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
