"""Resumed acquisition: several runs over growing input give the rows of one."""

from quillgraph.streaming.resume import resume

SCHEMA = "id string, seq long, text string"


def arrive(spark, path, rows):
    spark.createDataFrame(rows, SCHEMA).repartition(2).write.parquet(path)


def run_sorted(spark, at):
    resume(spark, f"{at}/arrivals", SCHEMA, f"{at}/sink", f"{at}/checkpoint", ["id"], ["seq", "text"]).awaitTermination()
    return sorted((str(r.id), r.seq, r.text) for r in spark.read.schema(SCHEMA).parquet(f"{at}/sink").collect())


def test_two_runs_give_the_rows_of_one(spark, tmp_path):
    first = [("a", 3, "late"), ("a", 1, "early"), ("b", 2, "x"), (None, 1, "none")]
    second = [("a", 0, "too late"), ("c", 9, "z"), ("c", 9, "y"), ("b", 2, "x"), (None, 0, "again")]
    twice, once = tmp_path / "twice", tmp_path / "once"
    arrive(spark, f"{twice}/arrivals/1", first)
    got = run_sorted(spark, twice)
    assert got == [("None", 1, "none"), ("a", 1, "early"), ("b", 2, "x")]
    assert run_sorted(spark, twice) == got  # nothing new has arrived
    arrive(spark, f"{twice}/arrivals/2", second)
    got = run_sorted(spark, twice)
    assert got == [("None", 1, "none"), ("a", 1, "early"), ("b", 2, "x"), ("c", 9, "y")]
    arrive(spark, f"{once}/arrivals/1", first)
    arrive(spark, f"{once}/arrivals/2", [r for r in second if r[0] not in ("a", None)])
    assert run_sorted(spark, once) == got
