"""SRC15/SRC16: a paged search service as a Spark data source.

    read_pages(spark, ["graphs", "trees"], transport="package.module:function")

A partition is one page (query, offset) of at most `size` results; offsets go up to `last`. Rows are (query, offset, pos,
object), where object is the JSON text of one result. An equality or IN on query, and comparisons of offset, are pushed
down, so pages that aren't wanted are never asked for.

A transport maps (query, offset, size, options) to a page's JSON text and raises to be asked again: after 1, 2, 4, ...
seconds, `wait` at most. After `errors` failures in a row the page fails, and with it the query, or (onError = skip) it
gives no rows. A page that is shorter than `size` is the last of its query: those after it come back empty. stored()
serves pages that lie in a folder, as write_pages() puts them there.
"""

from __future__ import annotations

import importlib
import json
import time
from collections.abc import Callable, Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, EqualTo, Filter, GreaterThan, GreaterThanOrEqual, In, InputPartition, LessThan, LessThanOrEqual

SIZE, LAST = 100, 800
ERRORS, WAIT = 5, 300.0
SCHEMA = "query string, offset int, pos int, object string"

Transport = Callable[[str, int, int, dict[str, str]], str]


class Page(InputPartition):
    def __init__(self, query: str, offset: int):
        super().__init__((query, offset))
        self.query, self.offset = query, offset


def patient(ask: Callable[[], str], errors: int = ERRORS, wait: float = WAIT, sleep: Callable[[float], None] = time.sleep) -> str:
    """What ask() returns, asked again after growing waits; the last error after `errors` in a row."""
    for k in range(errors):
        try:
            return ask()
        except Exception:
            if k + 1 == errors:
                raise
            sleep(min(wait, 2.0**k))
    raise ValueError("errors must be 1 at least")


def results(text: str) -> list[str]:
    """The objects of a page: of a bare list, or of the list under data, papers or items."""
    page = json.loads(text)
    if isinstance(page, dict):
        page = next((page[k] for k in ("data", "papers", "items") if isinstance(page.get(k), list)), [])
    return [json.dumps(x, ensure_ascii=False) for x in page if isinstance(x, dict)]


class PagedReader(DataSourceReader):
    def __init__(self, options: dict[str, str]):
        self.options = dict(options)
        given = {k.lower(): v for k, v in self.options.items()}
        self.queries = list(dict.fromkeys(json.loads(given["queries"])))
        self.size, self.last = int(given.get("size", SIZE)), int(given.get("last", LAST))
        self.errors, self.wait, self.skip = int(given.get("errors", ERRORS)), float(given.get("wait", WAIT)), given.get("onerror", "fail") == "skip"
        self.transport = given.get("transport", f"{__name__}:stored")
        self.offsets = range(0, self.last + 1, self.size)

    def pushFilters(self, filters: list[Filter]) -> Iterator[Filter]:
        tests = {GreaterThan: int.__gt__, GreaterThanOrEqual: int.__ge__, LessThan: int.__lt__, LessThanOrEqual: int.__le__, EqualTo: int.__eq__}
        for f in filters:
            column = getattr(f, "attribute", None)
            if column == ("query",) and isinstance(f, EqualTo | In):
                wanted = set(f.value) if isinstance(f, In) else {f.value}
                self.queries = [q for q in self.queries if q in wanted]
            elif column == ("offset",) and type(f) in tests and isinstance(f.value, int):
                self.offsets = [o for o in self.offsets if tests[type(f)](o, f.value)]
            else:
                yield f

    def partitions(self) -> list[Page]:
        return [Page(q, o) for q in self.queries for o in self.offsets]

    def read(self, partition: Page) -> Iterator[tuple]:
        module, _, name = self.transport.partition(":")
        fetch: Transport = getattr(importlib.import_module(module), name)
        given = {k.lower(): v for k, v in self.options.items()}
        try:
            objects = results(patient(lambda: fetch(partition.query, partition.offset, self.size, given), self.errors, self.wait))
        except Exception:
            if not self.skip:
                raise
            objects = []
        for pos, text in enumerate(objects[: self.size]):
            yield partition.query, partition.offset, pos, text


class PagedSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "paged"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> PagedReader:
        return PagedReader(self.options)


def page_folder(query: str, offset: int) -> str:
    """Where a page lies: any query is a folder's name of its own."""
    return f"query={query.encode().hex()}/offset={offset}"


def stored(query: str, offset: int, size: int, options: dict[str, str]) -> str:
    """A transport: pages in the folder of option path, a file's URI or any that pyarrow opens. A page that isn't there is
    an empty one."""
    from pyarrow import fs

    files, root = fs.FileSystem.from_uri(options["path"])
    found = [f.path for f in files.get_file_info(fs.FileSelector(f"{root}/{page_folder(query, offset)}", allow_not_found=True)) if f.base_name.startswith("part-")]
    if not found:
        return "[]"
    with files.open_input_stream(sorted(found)[0]) as f:
        return f.read().decode("utf-8")


def write_pages(objects: DataFrame, path: str, size: int = SIZE) -> None:
    """Store pages of rows (query, place, object), place from 0 within a query: each page is one file, made by Spark."""
    # an object that doesn't parse can't be part of a page
    rows = objects.select(F.hex(F.encode("query", "utf-8")).alias("query"), (F.floor(F.col("place") / size) * size).cast("int").alias("offset"), "place", "object")
    rows = rows.groupBy(F.lower("query").alias("query"), "offset").agg(F.transform(F.sort_array(F.collect_list(F.struct("place", "object"))), lambda x: x["object"]).alias("list"))
    pages = rows.select("query", "offset", F.concat(F.lit('{"data": ['), F.array_join("list", ", "), F.lit("]}")).alias("value"))
    pages.repartition("query", "offset").write.mode("overwrite").partitionBy("query", "offset").text(path)


def read_pages(spark: SparkSession, queries: list[str], **options: str) -> DataFrame:
    """(query, offset, pos, object) of the service's pages for some queries."""
    spark.dataSource.register(PagedSource)
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")  # Spark refuses a reader that takes filters without it
    reader = spark.read.format("paged").option("queries", json.dumps(queries))
    for k, v in options.items():
        reader = reader.option(k, v)
    return reader.load()


def fetched_papers(pages: DataFrame) -> DataFrame:
    """SRC16: papers with id and abstract of pages; one that several queries find counts for the first of them."""
    from ..operators.graph import latest
    from .readers import lenient_papers

    first = latest(pages.withColumn("id", F.get_json_object("object", "$.id")), ["id"], [F.asc("query"), F.asc("offset"), F.asc("pos")])
    return lenient_papers(first.select(F.col("object").alias("obj"))).where("abstract <> ''")
