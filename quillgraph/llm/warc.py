"""WARC archives of web pages, dictionary-compressed.

Each task writes .warc.zst files into a folder that all executors share, a new one where the last has ROLL bytes: a
dictionary is built with Zstandard from the file's first records, stored in a leading skippable frame (magic
0x184D2A5D), and each record then is a frame of its own, compressed with the dictionary; the first is a warcinfo record. Files are written under a temporary name and renamed, so a task that runs
again after a lost executor replaces its file whole.

Of records with equal payloads of at least `least` bytes the one with the largest page id is a response and the others
are revisits that refer to it; smaller payloads always are responses.

Defined results: a null html is an empty payload; a null url is written as an empty target, and white space and control
characters within one are percent-encoded; a null page id is written
and read back as null and is a revisit only if another page has the payload; repeated rows that share the largest id
are each responses; an empty table gives no archives and an empty result; other columns are ignored.
"""

from __future__ import annotations

import base64
import hashlib
import re
import struct
import uuid
from collections.abc import Iterator
from itertools import chain
from urllib.parse import quote

import pyarrow as pa
import zstandard
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import shared_path

DICT_FRAME = 0x184D2A5D  # fixed value: magic of the skippable frame that holds the dictionary
DICT_BYTES = 64 << 10
SAMPLE_BYTES = 4 << 20  # records that a file's dictionary is built from
LEVEL = 3
ROLL = 1 << 30  # compressed bytes after which a task begins another file
DATE = "2024-01-01T00:00:00Z"  # records carry a fixed date, so that archives of equal pages are equal
REVISIT = "http://netpreservation.org/warc/1.1/revisit/identical-payload-digest"  # fixed value: the profile's name


def assign(pages: DataFrame, least: int = 1000) -> DataFrame:
    """(page_id, url, html, refers_to): refers_to is set for revisits.

    Equal payloads are counted by digest before anything is joined; the join sends each page once, by its digest, and
    payloads that occur once need no partner.
    """
    html = F.coalesce(F.col("html"), F.lit(""))
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), F.coalesce(F.col("url"), F.lit("")).alias("url"), html.alias("html"), F.sha1(html.cast("binary")).alias("digest"))
    large = rows.select("page_id", "digest", "html").where(F.octet_length("html") >= least)
    repeated = large.groupBy("digest").agg(F.max("page_id").alias("last"), F.count(F.lit(1)).alias("n")).where(F.col("n") > 1)
    return rows.join(repeated.select("digest", "last"), "digest", "left").select(
        "page_id", "url", "html", F.when(~F.col("page_id").eqNullSafe(F.col("last")), F.col("last")).alias("refers_to")
    )


INFO = b"WARC/1.1\r\nWARC-Type: warcinfo\r\n"


def target(url: str) -> str:
    """A URL that fits on a header line."""
    return re.sub(r"[\s\x00-\x1f\x7f]", lambda m: quote(m.group(), safe=""), url.strip())


def info() -> bytes:
    """The record that describes an archive."""
    block = b"format: WARC File Format 1.1\r\nconformsTo: http://iipc.github.io/warc-specifications/specifications/warc-format/warc-1.1/\r\n"
    head = ["WARC/1.1", "WARC-Type: warcinfo", f"WARC-Record-ID: <urn:sha1:{hashlib.sha1(block).hexdigest()}>", f"WARC-Date: {DATE}", "Content-Type: application/warc-fields", f"Content-Length: {len(block)}"]
    return "\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def record(page_id: int | None, url: str, payload: bytes, refers_to: int | None) -> bytes:
    """One WARC/1.1 record: the response with its payload, or a revisit with the response's HTTP header only."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http + payload if refers_to is None else http
    head = [
        "WARC/1.1",
        f"WARC-Type: {'response' if refers_to is None else 'revisit'}",
        f"WARC-Record-ID: <urn:page:{'null' if page_id is None else page_id}>",
        f"WARC-Date: {DATE}",
        f"WARC-Target-URI: {target(url)}",
        f"WARC-Payload-Digest: sha1:{base64.b32encode(hashlib.sha1(payload).digest()).decode()}",
        "Content-Type: application/http; msgtype=response",
        f"Content-Length: {len(block)}",
    ]
    if refers_to is not None:
        head += [f"WARC-Profile: {REVISIT}", f"WARC-Refers-To: <urn:page:{refers_to}>"]
    return "\r\n".join(head).encode("utf-8", "surrogatepass") + b"\r\n\r\n" + block + b"\r\n\r\n"


def dictionary(records: list[bytes]) -> zstandard.ZstdCompressionDict:
    """A dictionary trained on records; where they are too few to train on, their own last bytes."""
    sample = [r[:32768] for r in records]  # what lies behind says nothing more about how records begin
    try:
        return zstandard.train_dictionary(min(DICT_BYTES, max(256, sum(map(len, sample)) // 8)), sample, level=LEVEL)
    except zstandard.ZstdError:
        return zstandard.ZstdCompressionDict(b"".join(sample)[-DICT_BYTES:].rjust(16, b" "), dict_type=zstandard.DICT_TYPE_RAWCONTENT)


def write_archive(records: Iterator[bytes], out, most: int = ROLL) -> int:
    """Write the dictionary's frame and a frame for each record, until `most` bytes are written; returns how many records
    there were, the leading warcinfo not among them."""
    first, size = [], 0
    for r in records:
        first.append(r)
        size += len(r)
        if size >= min(SAMPLE_BYTES, most):
            break
    if not first:
        return 0
    d = dictionary(first)
    packed = zstandard.ZstdCompressor(level=LEVEL).compress(d.as_bytes())
    c = zstandard.ZstdCompressor(level=LEVEL, dict_data=d, write_checksum=True)
    written = out.write(struct.pack("<II", DICT_FRAME, len(packed)) + packed) + out.write(c.compress(info()))
    n = 0
    for r in chain(first, records):
        written += out.write(c.compress(r))
        n += 1
        if n >= len(first) and written >= most:
            break
    return n


def read_archive(source) -> Iterator[bytes]:
    """The records of an archive, one at a time, from a stream."""
    head = source.read(8)
    if not head:
        return
    magic, length = struct.unpack("<II", head)
    if magic != DICT_FRAME:
        raise ValueError("the archive does not begin with a dictionary")
    raw = zstandard.ZstdDecompressor().decompress(source.read(length))
    kind = zstandard.DICT_TYPE_FULLDICT if raw[:4] == b"\x37\xa4\x30\xec" else zstandard.DICT_TYPE_RAWCONTENT
    d = zstandard.ZstdDecompressor(dict_data=zstandard.ZstdCompressionDict(raw, dict_type=kind))
    rest = b""
    frame, parts = d.decompressobj(), []
    while chunk := rest or source.read(1 << 20):
        parts.append(frame.decompress(chunk))
        rest = b""
        if frame.eof:
            yield b"".join(parts)
            rest, frame, parts = frame.unused_data, d.decompressobj(), []
    if parts:
        raise ValueError("the archive ends within a record")


def parse(raw: bytes) -> tuple[dict[str, str], bytes, bytes]:
    """A record's header fields, HTTP header and payload."""
    head, _, rest = raw.partition(b"\r\n\r\n")
    fields = dict(x.split(": ", 1) if ": " in x else (x.rstrip(":"), "") for x in head.decode("utf-8", "surrogatepass").split("\r\n")[1:])
    http, _, payload = rest[: int(fields["Content-Length"])].partition(b"\r\n\r\n")
    return fields, http, payload


def _page(urn: str | None) -> int | None:
    name = (urn or "<urn:page:null>")[len("<urn:page:") : -1]
    return None if name == "null" else int(name)


def write(pages: DataFrame, folder: str, least: int = 1000, roll: int = ROLL) -> DataFrame:
    """Write pages (page_id, url, html) as archives in folder, a URI that all executors reach; (path, records) of each."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, root = fs.FileSystem.from_uri(folder)
        part, paths, counts = TaskContext.get().partitionId(), [], []
        store.create_dir(root, recursive=True)
        rows = (r for b in batches for lo in range(0, b.num_rows, 64) for r in zip(*(c.to_pylist() for c in b.slice(lo, 64).columns), strict=True))
        records = (record(i, u, h.encode("utf-8", "surrogatepass"), t) for i, u, h, t in rows)
        while (head := next(records, None)) is not None:
            path, own = f"{root}/part-{part:05d}-{len(paths):04d}.warc.zst", f"{root}/.part-{part:05d}-{uuid.uuid4().hex}"
            with store.open_output_stream(own, compression=None) as out:
                counts.append(write_archive(chain([head], records), out, roll))
            store.move(own, path)
            paths.append(path)
        yield pa.RecordBatch.from_pydict({"path": paths, "records": counts}, pa.schema([("path", pa.string()), ("records", pa.int64())]))

    return assign(pages, least).mapInArrow(run, "path string, records long")


def read(spark: SparkSession, folder: str, manifest: DataFrame) -> DataFrame:
    """(page_id, url, html, payload_bytes, payload_digest, record_type, refers_to) of each record in the archives.

    html is null for revisits. A response whose payload contradicts its digest raises an error.
    """
    schema = pa.schema([("page_id", pa.int64()), ("url", pa.string()), ("html", pa.string()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("record_type", pa.string()), ("refers_to", pa.int64())])

    def one(raw: bytes) -> tuple:
        f, http, payload = parse(raw)
        response = f["WARC-Type"] == "response"
        digest = base64.b32decode(f["WARC-Payload-Digest"].removeprefix("sha1:")).hex()
        if response and hashlib.sha1(payload).hexdigest() != digest:
            raise ValueError(f"damaged record {f['WARC-Record-ID']}")
        size = int(next(x for x in http.split(b"\r\n") if x.startswith(b"Content-Length: "))[16:])
        html = payload.decode("utf-8", "surrogatepass") if response else None
        return _page(f["WARC-Record-ID"]), f["WARC-Target-URI"], html, size, digest, f["WARC-Type"], _page(f.get("WARC-Refers-To"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store = fs.FileSystem.from_uri(folder)[0]
        for b in batches:
            for path in b.column(0).to_pylist():
                rows, size = [], 0
                with store.open_input_stream(path, compression=None) as raw:
                    for r in read_archive(raw):
                        if r.startswith(INFO):
                            continue
                        rows.append(one(r))
                        size += len(r)
                        if size > 8 << 20:
                            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), schema.types, strict=True)], schema=schema)
                            rows, size = [], 0
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), schema.types, strict=True)], schema=schema)

    spec = "page_id long, url string, html string, payload_bytes long, payload_digest string, record_type string, refers_to long"
    return manifest.select("path").mapInArrow(run, spec)


def archive_and_read(pages: DataFrame, least: int = 1000, folder: str | None = None) -> DataFrame:
    """Write pages as archives, then read every record back."""
    spark = pages.sparkSession
    folder = folder or shared_path(spark, "warc")
    listed = f"{folder}-manifest"
    write(pages, folder, least).repartition(1).write.parquet(listed)  # a row an archive
    manifest = spark.read.parquet(listed)
    return read(spark, folder, manifest.repartition(max(1, manifest.count()), "path"))
