import hashlib
import os
import random
from collections import Counter

import pytest
import sentencepiece
from tokenizers import Tokenizer

from quillgraph.llm import alignment, bpe

A, B = bpe.public_vocabulary("byte_bpe_50k.json"), bpe.public_vocabulary("piece_bpe_32k.model")
PLAIN_A, PLAIN_B = Tokenizer.from_file(A), sentencepiece.SentencePieceProcessor(model_file=B)
PLAIN_A.encode_special_tokens = True
PLAIN_A.no_truncation()
BYTES = {c: bytes([b]) for c, b in bpe.byte_symbols().items()}


def whole_tokens(text):
    """[(id, bytes)] of A and B over the whole text."""
    a = [(i, b"".join(BYTES[c] for c in PLAIN_A.id_to_token(i))) for i in PLAIN_A.encode(" " + text, add_special_tokens=False).ids]
    b = []
    for i in PLAIN_B.encode(text):
        p = PLAIN_B.id_to_piece(i)
        b.append((i, bytes([int(p[3:5], 16)]) if PLAIN_B.is_byte(i) else p.replace("▁", " ").encode()))
    return a, b


def plain(docs):
    """One document at a time, over whole texts."""
    seen = []
    for d, text in docs:
        groups = []
        if text:
            a, b = whole_tokens(text)
            if b"".join(x for _, x in a) == b"".join(x for _, x in b) == (" " + text).encode():
                i = j = p = q = 0
                while i < len(a):
                    ga, gb = [], []
                    while True:
                        if p <= q:
                            ga.append(a[i][0])
                            p, i = p + len(a[i][1]), i + 1
                        else:
                            gb.append(b[j][0])
                            q, j = q + len(b[j][1]), j + 1
                        if p == q:
                            break
                    groups.append((ga, gb))
        seen.append((d, groups))
    held = Counter(pair for _, gs in seen for pair in {(x, y) for ga, gb in gs for x in ga for y in gb})
    most = {}
    for (x, _), n in held.items():
        most[x] = max(most.get(x, 0), n)
    out = []
    for d, gs in seen:
        links = [(x, y) for ga, gb in gs for x in ga for y in gb]
        text = ";".join(",".join(map(str, ga)) + "|" + ",".join(map(str, gb)) for ga, gb in gs)
        out.append((d, sum(len(g[0]) for g in gs), sum(len(g[1]) for g in gs), len(gs), len(links), sum(held[k] == most[k[0]] for k in links), sum(held[k] for k in links), hashlib.sha256(text.encode()).hexdigest() if gs else ""))
    return sorted(out, key=str)


def check(spark, docs):
    df = spark.createDataFrame([(d, t, 1, "x") for d, t in docs], "doc_id long, text string, u int, unit string")
    assert sorted((tuple(r) for r in alignment.align(df, A, B).collect()), key=str) == plain(docs)


def texts(n, seed):
    r = random.Random(seed)
    alphabets = ["the of and in to 's 'll don't ", "abcdefg hij", "éàüßñ øå", "0123456789 .,", "!!!***$$$   \n\n\t", "漢字かな交じり文、", "мир труд", "\u0085 ​﻿x ", "👩‍👩‍👧🇩🇪 é", "  ", "<0x41> <s> <|endoftext|> </s>"]
    return ["".join("".join(r.choices(a, k=r.randint(1, 40))) if "<s>" not in a else a for a in r.choices(alphabets, k=r.randint(1, 4))) for _ in range(n)]


def test_units_are_encoded_as_within_the_text():
    docs = [*texts(1500, 8), "a ", "a  ", " a", "  ", " ", "word\n next", "x▁y", "a. b ", "\u0000 \u0001 b"]
    pair, cut = alignment.Pair(A, B), 0
    for t in docs:
        units = alignment.units_of(t, True)
        assert "".join(" " + u for u in units) == " " + t and units == [u[1:] for u in alignment.SEAM.split(" " + t)]
        cut += len(units) > 1
        a, b = whole_tokens(t)
        got = pair.encode(units)
        assert [i for x in got for i in x[0]] == [i for i, _ in a]
        assert all(x[4] for x in got) == (b"".join(x for _, x in b) == (" " + t).encode())
        assert [i for x in got for i in x[2]] == [i for i, _ in b]
    assert cut > 500 and alignment.splits_at_spaces(B)


def test_equals_whole_texts(spark):
    docs = list(enumerate(texts(120, 3))) + [(900 + k, "the same words the same") for k in range(40)]
    check(spark, docs + [(2000, "x▁y the"), (2001, " "), (2002, "a "), (2003, "▁"), (2004, "thetheunthe " * 400), (2005, "ab" * 800)])


def test_nulls_repeats_and_empty_tables(spark):
    check(spark, [(1, None), (2, ""), (None, "one two"), (None, None), (3, "one two"), (3, "one two"), (3, "two"), (-7, "<|endoftext|> one")])
    check(spark, [(1, None), (2, "▁")])
    check(spark, [])


def test_documents_that_are_not_given_back(spark):
    check(spark, [(k, "a▁b the" if k % 2 else "the end") for k in range(9)])


def test_small_slices_and_whole_texts_as_units(spark, monkeypatch):
    monkeypatch.setattr(alignment, "SLICE", 50)
    docs = list(enumerate(texts(40, 11)))
    check(spark, docs)
    monkeypatch.setattr(alignment, "splits_at_spaces", lambda path: False)
    check(spark, docs)


@pytest.mark.skipif(not os.path.isdir("/root/testdata/sf0.01"), reason="no test tables here")
def test_real_documents(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    got = sorted((tuple(r) for r in alignment.align(docs, A, B).collect()), key=str)
    assert got == plain([(r.doc_id, r.text) for r in docs.select("doc_id", "text").collect()])


def test_units_are_grouped_and_linked_at_once(spark):
    rows = [(1, [7, 8, 7, 9], [1, 2, 1, 3], [5, 5, 6], [2, 2, 3], True), (2, [4], [3], [3], [3], True)]
    units = alignment.unit_groups(alignment.grouped(spark.createDataFrame(rows, f"u long, {alignment.TOKENS}").repartition(3, "u")))
    got = {r.u: (r.n_a, r.n_b, r.n_groups, r.n_links, r.groups, sorted((x.pair >> 32, x.pair & 0xFFFFFFFF, x.n) for x in r.links)) for r in units.collect()}
    assert got == {1: (4, 3, 2, 7, "7,8,7|5,5;9|6", [(7, 5, 4), (8, 5, 2), (9, 6, 1)]), 2: (1, 1, 1, 1, "4|3", [(4, 3, 1)])}
    plan = str(units._jdf.queryExecution().executedPlan()).split("Initial Plan")[0]
    assert plan.count("Exchange hashpartitioning") == 1 and "Join" not in plan
