"""Random keys of one character class are found; long ordinary words are not."""

import random
import string

from quillgraph.llm import secrets as S


def test_keys_of_one_class(spark):
    r = random.Random(21)
    syllables = ["ein", "ung", "keit", "lich", "ver", "ander", "tion", "ment", "ar", "os", "mi", "ta", "re", "con", "de"]
    word = lambda k: "".join(r.choice(syllables) for _ in range(k))
    rows, keys = [], {}
    for i in range(300):
        text = " ".join(word(r.randint(1, 4)) for _ in range(60))
        if i % 3 == 0:
            keys[i] = "".join(r.choices((string.ascii_lowercase, string.ascii_uppercase, string.digits)[i // 3 % 3], k=r.choice([24, 32, 40, 64])))
            text += " " + keys[i]
        elif i % 3 == 1:
            long = word(12)
            text += " " + (long.upper() if i % 2 else long)
        rows.append((i, text + " end"))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = {x.doc_id: x for x in S.scan(docs).collect()}
    for kind in range(3):
        of = [i for i in keys if i // 3 % 3 == kind]
        found = sum((got[i].n_hex if kind == 2 else got[i].n_random) == 1 for i in of)
        print(("lower", "upper", "digits")[kind], found, "of", len(of))
        assert found >= 0.9 * len(of)
    assert sum(got[i].n_random for i in range(300) if i not in keys) <= 0.05 * len(keys)
    clean = {x.doc_id: x.text for x in S.redact(docs).collect()}
    assert all((keys[i] not in clean[i]) == (got[i].n_random + got[i].n_hex > 0) for i in keys)
