import glob
import hashlib
import json
import random

import pyarrow.parquet as pq
import pytest
from tokenizers import Tokenizer

from quillgraph.llm import bpe

PATH = bpe.public_vocabulary()
PLAIN = Tokenizer.from_file(PATH)
PLAIN.no_truncation()
PLAIN.no_padding()


def texts():
    r = random.Random(3)
    alphabets = ["abcdefghij klmno", "the of and in to 's 'll don't ", "éàüßñ øå", "0123456789 .,", "!!!***###$$$   \n\n\t", "漢字かな交じり文、", "мир труд май", "  \u0085 ​﻿x", "👩‍👩‍👧‍👦🇩🇪é"]
    out = ["", " ", "a", "<|endoftext|>", "x<|endoftext|><|endoftext|> y", "'" * 700, "a" * 3000, " " * 2500 + "b", "\n" * 999, "ab" * 2000, "!" * 1111, "-'s-'ll" * 300]
    for _ in range(60):
        parts = [r.choice(alphabets) for _ in range(r.randint(1, 4))]
        out.append("".join("".join(r.choices(p, k=r.randint(1, 400))) if r.random() < 0.9 else "<|endoftext|>" for p in parts for _ in range(4)))
    words = ["".join(r.choices("thereonding", k=r.randint(1, 14))) for _ in range(500)]
    out.append(" ".join(r.choice(words) for _ in range(60_000)))
    return out


def test_tree_concatenation_equals_whole_text():
    small = [bpe.Coder(PATH, leaf) for leaf in (40, 333, 4096, bpe.LEAF)]
    for t in texts():
        want = PLAIN.encode(t, add_special_tokens=False).ids
        for c in small:
            assert c.encode(t) == want, (c.leaf, t[:80])
        assert small[0].decode(want) == PLAIN.decode(want, skip_special_tokens=False) == t


def test_random_texts_at_small_leaves():
    r = random.Random(17)
    alphabets = ["the of and in to 's 'll don't 're", "0123456789 .,", "!!!***###$$$   \n\n\t", "漢字かな交じり文、", "мир труд май", "a", "ab", " ", "\n", "'", "etaoinshrdlu", "العربية ", "é\u0301x"]
    small = [bpe.Coder(PATH, leaf) for leaf in (7, 60, 300)]
    for _ in range(400):
        parts = [r.choice(alphabets) for _ in range(r.randint(1, 4))]
        t = "".join("".join(r.choices(p, k=r.choice([1, 3, 20, 200, 600]))) for p in parts for _ in range(2))
        want = PLAIN.encode(t, add_special_tokens=False).ids
        assert [c.encode(t) for c in small] == [want] * 3, t


def test_real_documents_take_the_tree():
    found = glob.glob("/root/testdata/sf0.1/documents.parquet")
    if not found:
        pytest.skip("no test data")
    texts = pq.read_table(found[0], columns=["text"]).column("text").to_pylist()
    c = bpe.Coder(PATH)
    long = [t for t in texts if t and len(t) > bpe.LEAF]
    print(len(long), "of", len(texts), "texts,", sum(map(len, long)), "of", sum(len(t or "") for t in texts), "characters")
    assert len(long) > 0.05 * len(texts) and max(map(len, long)) > 16 * bpe.LEAF
    for t in sorted(long, key=len)[:: max(1, len(long) // 300)] + long[:50]:
        assert c.encode(t) == PLAIN.encode(t, add_special_tokens=False).ids


def test_other_formats_are_refused(tmp_path):
    spec = json.load(open(PATH, encoding="utf-8"))
    for change in ({"pre_tokenizer": {"type": "Whitespace"}}, {"normalizer": {"type": "NFC"}}, {"pre_tokenizer": spec["pre_tokenizer"] | {"add_prefix_space": True}}, {"model": spec["model"] | {"ignore_merges": True}}):
        (tmp_path / "v.json").write_text(json.dumps(spec | change), encoding="utf-8")
        with pytest.raises(ValueError):
            bpe.Coder(str(tmp_path / "v.json"))


def test_query_and_round_trip(spark):
    rows = [(i, t, "x", i) for i, t in enumerate(texts()[:30])] + [(99, None, None, None), (None, "the", "y", 1), (3, "<|endoftext|>", "x", 3)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string, ids int")
    got = sorted((tuple(x) for x in bpe.digests(docs, PATH, leaf=100).collect()), key=str)
    want = []
    for d, t, *_ in rows:
        ids = PLAIN.encode(t or "", add_special_tokens=False).ids
        want.append((d, len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256((t or "").encode()).hexdigest()))
    assert got == sorted(want, key=str)
    back = bpe.decode(bpe.encode(docs, PATH), PATH)
    assert sorted(((x.doc_id, x.text) for x in back.collect()), key=str) == sorted(((d, t or "") for d, t, *_ in rows), key=str)
    empty = spark.createDataFrame([], "doc_id long, text string")
    assert bpe.digests(empty, PATH).collect() == [] and bpe.encode(empty, PATH).collect() == []
