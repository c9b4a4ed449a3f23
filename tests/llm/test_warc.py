import hashlib
import io
import random

import pytest

from quillgraph.llm import warc


def rows():
    r = random.Random(9)
    big = ["<html>" + "é" * r.randint(497, 900) + str(i) for i in range(6)]
    out = [(i, f"http://x/{i}", r.choice([*big, "", "tiny", "a" * 999, "a" * 1000])) for i in range(60)]
    return out + [(60, None, None), (61, "http://\r\nx", "x" * 1_500_000), (62, "u", "x" * 1_500_000), (62, "u", "x" * 1_500_000), (None, "n", "a" * 1000), (None, "n", "only" * 300), (63, "", "\r\n\r\nWARC/1.1\r\n\r\n" * 80)]


def want(data):
    last = {}
    for i, _, h in data:
        if i is not None and len((h or "").encode()) >= 1000:
            last[h] = max(last.get(h, i), i)
    for i, _, h in data:
        raw = (h or "").encode()
        again = len(raw) >= 1000 and last.get(h, i) != i
        yield i, len(raw), hashlib.sha1(raw).hexdigest(), "revisit" if again else "response", last[h] if again else None


def test_round_trip(spark):
    data = rows()
    pages = spark.createDataFrame([(*x, "clash", 1) for x in data], "page_id long, url string, html string, digest string, last int").repartition(3)
    got = warc.archive_and_read(pages)
    back = got.collect()
    assert sorted(map(str, ((x.page_id, x.payload_bytes, x.payload_digest, x.record_type, x.refers_to) for x in back))) == sorted(map(str, want(data)))
    texts = sorted(x.html for x in back if x.record_type == "response")
    assert set(texts) == {h or "" for *_, h in data}
    assert {x.url for x in back if x.page_id == 61} == {"http://%0D%0Ax"}


def test_archive_layout():
    records = [warc.record(i, f"http://a/{i}", b"<p>%d</p>" % i * 50, None) for i in range(500)]
    f = io.BytesIO()
    assert warc.write_archive(iter(records), f) == 500
    raw = f.getvalue()
    assert raw[:4] == b"\x5d\x2a\x4d\x18" and len(raw) < sum(map(len, records)) / 4
    assert list(warc.read_archive(io.BytesIO(raw))) == [warc.info(), *records]
    with pytest.raises(ValueError):
        list(warc.read_archive(io.BytesIO(raw[:-5])))
    few = io.BytesIO()
    warc.write_archive(iter(records[:1]), few)
    assert list(warc.read_archive(io.BytesIO(few.getvalue()))) == [warc.info(), *records[:1]]
    assert list(warc.read_archive(io.BytesIO())) == []


def test_a_task_begins_another_file(spark, tmp_path):
    r = random.Random(4)
    pages = spark.createDataFrame([(i, f"http://x/{i}", "".join(r.choices("abcdefghijklmnop", k=3000))) for i in range(300)], "page_id long, url string, html string").coalesce(1)
    folder = f"file://{tmp_path}/roll"
    made = warc.write(pages, folder, roll=100_000).collect()
    assert len(made) > 3 and sum(x.records for x in made) == 300 and len({x.path for x in made}) == len(made)
    manifest = spark.createDataFrame([(x.path,) for x in made], "path string")
    assert sorted(x.page_id for x in warc.read(spark, folder, manifest).collect()) == list(range(300))


def test_empty(spark):
    assert warc.archive_and_read(spark.createDataFrame([], "page_id long, url string, html string")).collect() == []
