"""Encoding with a cache, and the paged source."""

import json

import numpy as np
import pytest

from quillgraph.plans.encode import cached, encode, hashed_words, paper_text
from quillgraph.sources import paged


def texts(spark, rows):
    return spark.createDataFrame(rows, "id string, text string")


def counting(folder):
    """An encoder that leaves a line in a file for each text, and fails on some."""

    def load():
        import os
        import uuid

        name = os.path.join(folder, uuid.uuid4().hex)

        def predict(batch):
            if any("boom" in t for t in batch):
                raise RuntimeError("no vector")
            with open(name, "a") as f:
                f.writelines(t + "\n" for t in batch)
            return np.array([[len(t), t.count("a"), 1.0] for t in batch])

        return predict

    return load


def seen(folder):
    return sorted(line for f in folder.iterdir() for line in f.read_text().splitlines())


def vectors(df):
    return {r.id: list(r.v) for r in df.collect()}


def test_each_text_is_encoded_once(spark, tmp_path):
    calls, cache = tmp_path / "calls", str(tmp_path / "cache")
    calls.mkdir()
    rows = [("1", "aa"), ("2", "aa"), ("3", "b"), ("4", None), ("5", "")]
    want = {"1": [2, 2, 1], "2": [2, 2, 1], "3": [1, 0, 1], "4": [0, 0, 1], "5": [0, 0, 1]}
    assert vectors(encode(texts(spark, rows), 3, cache, counting(str(calls)))) == want
    assert seen(calls) == ["", "aa", "b"]
    assert vectors(encode(texts(spark, rows), 3, cache, counting(str(calls)))) == want
    assert seen(calls) == ["", "aa", "b"]  # nothing was encoded again
    more = vectors(encode(texts(spark, [*rows, ("6", "new")]), 3, cache, counting(str(calls))))
    assert more == want | {"6": [3, 0, 1]} and seen(calls) == ["", "aa", "b", "new"]
    assert cached(spark, cache).count() == 4


def test_a_failing_text_has_the_zero_vector_and_is_tried_again(spark, tmp_path):
    calls, cache = tmp_path / "calls", str(tmp_path / "cache")
    calls.mkdir()
    rows = texts(spark, [("1", "a boom"), ("2", "fine"), ("3", "fine too")]).coalesce(1)
    assert vectors(encode(rows, 3, cache, counting(str(calls)))) == {"1": [0, 0, 0], "2": [4, 0, 1], "3": [8, 0, 1]}
    assert cached(spark, cache).count() == 2

    def mended():
        return lambda batch: np.full((len(batch), 3), 7.0)

    assert vectors(encode(rows, 3, cache, mended))["1"] == [7, 7, 7]


def test_vectors_of_a_wrong_size_count_as_failed(spark, tmp_path):
    assert vectors(encode(texts(spark, [("1", "a")]), 3, str(tmp_path / "cache"), lambda: lambda batch: np.ones((len(batch), 2)))) == {"1": [0, 0, 0]}


def test_default_encoder(spark, tmp_path):
    predict = hashed_words(8)()
    v = predict(np.array(["One one two", " ", "two one ONE"], dtype=object))
    assert np.allclose(v[0], v[2]) and np.isclose((v[0] ** 2).sum(), 1) and not v[1].any()
    empty = encode(texts(spark, []), 8, str(tmp_path / "cache"))
    assert empty.collect() == []
    row = spark.createDataFrame([("t", None)], "title string, abstract string").select(paper_text("title", "abstract").alias("x")).first()
    assert row.x == "t "


def flaky(query, offset, size, options):
    """Fails twice for each page, then serves it; the page of one query never comes."""
    import os

    mark = os.path.join(options["marks"], f"{query}-{offset}")
    with open(mark, "a") as f:
        f.write("x")
    if query == "lost" or os.path.getsize(mark) < 3:
        raise OSError("429")
    return json.dumps({"data": [{"id": f"{query}{offset + k}", "title": "t", "abstract": "a" if k else ""} for k in range(size if offset < 4 else 1)] + ["no object"]})


def test_pages_are_asked_for_with_patience(spark, tmp_path):
    marks = tmp_path / "marks"
    marks.mkdir()
    spark.sparkContext.addPyFile(__file__)
    options = {"transport": "test_encode:flaky", "marks": str(marks), "size": "2", "last": "4", "wait": "0.01"}
    pages = paged.read_pages(spark, ["a", "b"], **options)
    assert sorted((r.query, r.offset, r.pos) for r in pages.collect()) == sorted((q, o, p) for q in "ab" for o, n in ((0, 2), (2, 2), (4, 1)) for p in range(n))
    assert {r.id for r in paged.fetched_papers(pages).collect()} == {"a1", "a3", "b1", "b3"}
    skipping = paged.read_pages(spark, ["a", "lost"], **options, onError="skip")
    assert skipping.count() == 5
    assert (marks / "lost-0").stat().st_size == 5
    with pytest.raises(Exception, match="429"):
        paged.read_pages(spark, ["lost"], **options).collect()


def test_waits_grow_and_end():
    waits, tries = [], []

    def fail():
        tries.append(1)
        raise OSError("429")

    with pytest.raises(OSError):
        paged.patient(fail, 12, 300, waits.append)
    assert len(tries) == 12 and waits == [1, 2, 4, 8, 16, 32, 64, 128, 256, 300, 300]


def test_filters_reach_the_source():
    from pyspark.sql.datasource import EqualTo, GreaterThanOrEqual, In, IsNotNull

    reader = paged.PagedReader({"queries": '["a", "b", "c", "a"]', "path": "x"})
    assert len(reader.partitions()) == 3 * 9
    rest = IsNotNull(("query",))
    assert list(reader.pushFilters([In(("query",), ("a", "c")), GreaterThanOrEqual(("offset",), 700), rest])) == [rest]
    assert [(p.query, p.offset) for p in reader.partitions()] == [("a", 700), ("a", 800), ("c", 700), ("c", 800)]
    list(reader.pushFilters([EqualTo(("query",), "c")]))
    assert {p.query for p in reader.partitions()} == {"c"}


def test_stored_pages(spark, tmp_path):
    rows = [(q, k, json.dumps({"id": f"{q}{k}", "title": "t", "abstract": "x"})) for q, n in (("de/ü", 5), ("en", 3)) for k in range(n)]
    path = f"file://{tmp_path}/pages"
    paged.write_pages(spark.createDataFrame(rows, "query string, place long, object string"), path, 2)
    pages = paged.read_pages(spark, ["de/ü", "en", "none"], path=path, size="2", last="10")
    assert sorted((r.query, r.offset, r.pos, json.loads(r.object)["id"]) for r in pages.collect()) == sorted((q, k // 2 * 2, k % 2, f"{q}{k}") for q, k, _ in rows)
    assert pages.where("query = 'en' AND offset >= 2").count() == 1
