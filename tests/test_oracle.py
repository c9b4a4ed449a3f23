"""Every query with SQL gives the rows that DuckDB gives, on the smallest tables."""

import math
import os

import duckdb
import pytest

from quillgraph.queries import ORACLE, QUERIES

SF = "/root/testdata/sf0.001"
TYPES = {"bigint": "BIGINT", "int": "INTEGER", "double": "DOUBLE", "string": "VARCHAR", "boolean": "BOOLEAN"}


def plain(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else f"{v:.9g}"
    return str(v)


@pytest.fixture(scope="module")
def oracle():
    if not os.path.isdir(SF):
        pytest.skip("no test tables here")
    c = duckdb.connect(config={"memory_limit": "3GB"})
    for f in os.listdir(SF):
        c.execute(f"CREATE VIEW {f.split('.')[0]} AS SELECT * FROM '{SF}/{f}'")
    return c


@pytest.mark.parametrize("name", sorted(ORACLE))
def test_query(spark, oracle, name):
    df = QUERIES[name](spark, SF)
    want = oracle.sql(ORACLE[name])
    columns = sorted(df.columns)
    assert columns == sorted(want.columns)
    kinds = {c: str(t) for c, t in zip(want.columns, want.types, strict=True)}
    assert {c: TYPES[t] for c, t in df.dtypes} == kinds
    at = [want.columns.index(c) for c in columns]
    assert sorted(tuple(plain(x) for x in r) for r in df.select(*columns).collect()) == sorted(tuple(plain(r[i]) for i in at) for r in want.fetchall())


def test_rows_only_queries(spark, oracle):
    for name in set(QUERIES) - set(ORACLE):
        assert QUERIES[name](spark, SF).count() > 0
