"""Queries that do their whole job, whatever the size of their tables."""

from dataclasses import replace

from quillgraph.queries import QUERIES, scores

SF = "/root/testdata/sf0.001"


def test_cognitive_scores_of_every_candidate(spark, monkeypatch):
    """More candidates than retrieval keeps lost the others."""
    want = scores.pairs(scores.Tables(spark, SF)).count()
    monkeypatch.setattr(scores, "SETTINGS", replace(scores.SETTINGS, retrieved=3))
    assert QUERIES["fun09_cognitive"](spark, SF).count() == want > 0
