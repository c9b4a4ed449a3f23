import random
import re
from collections import Counter

import pytest
from tokenizers import Tokenizer

corpus_pipeline = pytest.importorskip("corpus_pipeline")
from quillgraph.llm import bpe, simhash_dedup  # noqa: E402


@pytest.fixture(scope="module")
def tables(spark, tmp_path_factory):
    r = random.Random(31)
    words = ["".join(r.choices("aeiorstnl", k=r.randint(2, 8))) for _ in range(400)]
    good = lambda: "\n".join(" ".join(r.choice(words) for _ in range(r.randint(6, 20))).capitalize() + "." for _ in range(5))
    bad = lambda: r.choice(["WIN!! " * 60, "nav | " * 60, ("spam " * 40 + "\n") * 4])
    rows, labels = [], []
    for i in range(300):
        y = int(r.random() < 0.75)
        rows.append((i, good() if y else bad() + f"a{i}"))
        labels.append((i, y, 0))
    for i in range(300, 360):
        base = rows[r.randrange(300)][1]
        rows.append((i, base if r.random() < 0.5 else base + " " + r.choice(words)))
    rows += [(400, good() + " password=abcdefgh12345678"), (401, good() + " 0123456789abcdef0123"), (402, None), (None, good()), rows[0], rows[0]]
    docs = [(d, t, "en", r.choice(["s0", "s0", "s1", None]), len(t or "")) for d, t in rows]
    path = str(tmp_path_factory.mktemp("tables"))
    spark.createDataFrame(docs, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{path}/labels.parquet")
    return path, dict(x[:2] for x in labels)


def test_every_stage_against_a_plain_version(spark, tables):
    path, quality = tables
    docs = spark.read.parquet(f"{path}/documents.parquet")
    names = [n for n, _ in corpus_pipeline.STAGES]
    assert len(names) == 5
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, path)
        before, after = docs.collect(), out.collect()
        if name != names[-1]:
            assert out.columns == corpus_pipeline.COLUMNS
        if name == "quality classifier":
            ids = {x.doc_id for x in after}
            assert sum((d in ids) == bool(y) for d, y in quality.items()) > 0.97 * len(quality)
        elif name == "simhash near-dedup":
            sets = [set(simhash_dedup.shingles(x.text, 5).tolist()) for x in before]
            group = list(range(len(before)))
            for i in range(len(before)):
                for j in range(i):
                    both, either = len(sets[i] & sets[j]), len(sets[i] | sets[j])
                    if both >= 0.8 * either and group[i] != group[j]:
                        a, b = sorted((group[i], group[j]))
                        group = [a if g == b else g for g in group]
            low = {}
            for x, g in zip(before, group, strict=True):
                k = (x.doc_id is None, x.doc_id or 0)
                low[g] = min(low.get(g, k), k)
            assert sorted(low.values()) == sorted((x.doc_id is None, x.doc_id or 0) for x in after)
            assert len(after) < len(before) - 20
        elif name == "secret scan":
            assert len(after) == len(before)
            by = {x.doc_id: x for x in after}
            assert by[400].text.endswith("[SECRET]") and by[401].text.endswith("[SECRET]")
            assert all(x.n_chars == len(x.text) for x in after if x.text is not None)
            assert sum("[SECRET]" in (x.text or "") for x in after) == 2
        elif name == "source mixing":
            size = lambda t: len(re.findall(r"[^\x20\x09-\x0D]+", t or ""))
            total, mixed = sum(size(x.text) for x in before), sum(size(x.text) for x in after)
            assert abs(mixed - 1.5 * total) < 4 * max(size(x.text) for x in before)
            assert max(Counter(x.doc_id for x in after).values()) <= 2
        else:
            plain = Tokenizer.from_file(bpe.public_vocabulary())
            want = sorted((str(x.doc_id), plain.encode(x.text or "", add_special_tokens=False).ids) for x in before)
            assert want == sorted((str(x.doc_id), x.ids) for x in after)
        docs = out if name == names[-1] else spark.createDataFrame(after, docs.schema)


def test_run_and_empty_tables(spark, tables, tmp_path):
    path, _ = tables
    got = corpus_pipeline.run(spark, path)
    assert got.count() > 100 and got.columns == ["doc_id", "source", "n_tokens", "ids"]
    for t in ("documents", "labels"):
        spark.read.parquet(f"{path}/{t}.parquet").limit(0).write.parquet(f"{tmp_path}/{t}.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).collect() == []


def test_clashing_columns(spark, tables):
    path, _ = tables
    docs = spark.read.parquet(f"{path}/documents.parquet")
    names = ["d", "s", "words", "copies", "copy", "size", "fp", "node", "key", "score", "ids", "_found", "_spans", "_before", "_d", "_h", "_n", "id", "y", "found"]
    more = docs.selectExpr("*", *[f"'x' AS {n}" for n in names])
    for name, stage in corpus_pipeline.STAGES:
        a, b = (sorted(map(str, stage(spark, frame, path).collect())) for frame in (docs, more))
        assert a == b, name
