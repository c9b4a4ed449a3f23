"""The opN queries on the smallest tables: columns by contract, one row per row, SQL where there is any."""

import os

import duckdb
import pytest

from quillgraph.llm import queries as Q

SF = "/root/testdata/sf0.001"
COLUMNS = {
    1: {"doc_id": "bigint", "n_chars": "bigint", "edited_sha256": "string", "fingerprint": "string", "edited_fingerprint": "string", "near_edited": "double", "near_next": "double"},
    2: {"vec_id": "bigint", "n_links": "bigint", "component_id": "bigint", "kept": "boolean"},
    3: {"page_id": "bigint", "payload_bytes": "bigint", "payload_digest": "string", "record_type": "string", "refers_to": "bigint"},
    4: {"doc_id": "bigint", "held_out": "boolean", "score": "double", "predicted": "int"},
    5: {"doc_id": "bigint", "n_tokens": "bigint", "ids_sha256": "string", "decoded_sha256": "string"},
    6: {"conv_id": "bigint", "n_turns": "bigint", "turns_sha256": "string", "loss_chars": "bigint", "loss_sha256": "string", "formatted_chars": "bigint"},
    7: {"doc_id": "bigint", "size": "bigint", "source_size": "bigint", "target": "double", "taken": "bigint"},
    8: {"doc_id": "bigint", "fingerprint": "string", "component_id": "bigint"},
    9: {"doc_id": "bigint", "n_bytes": "bigint", "n_removed": "bigint", "n_spans": "bigint", "kept_sha256": "string"},
    10: {"doc_id": "bigint", "n_assign": "bigint", "n_access": "bigint", "n_hex": "bigint", "base_sha256": "string", "spans": "string"},
    11: {"doc_id": "bigint", "piece": "int", "start": "bigint", "length": "bigint", "ids_crc32": "bigint", "sequence_id": "bigint", "offset": "bigint"},
    12: {"conv_id": "bigint", "depth": "bigint", "parent_conv_id": "bigint", "n_convs": "bigint", "n_children": "bigint", "n_leaves": "bigint", "saved_tokens": "bigint", "ends_sha256": "string"},
    13: {"doc_id": "bigint", "n_a": "bigint", "n_b": "bigint", "n_groups": "bigint", "n_links": "bigint", "n_best": "bigint", "count_sum": "bigint", "groups_sha256": "string"},
}
TABLE = {2: "embeddings", 3: "pages", 6: "conversations", 12: "conversations"}
NAMES = sorted(Q.queries(), key=lambda n: int(n[2:].split("_")[0]))

pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables here")


def test_there_is_one_query_for_each_operator():
    assert [int(n[2:].split("_")[0]) for n in NAMES] == list(range(1, 14))


@pytest.mark.parametrize("name", NAMES)
def test_columns_and_rows(spark, name):
    n = int(name[2:].split("_")[0])
    df = Q.queries()[name](spark, SF)
    kinds = dict(df.dtypes)
    assert {c: kinds.get(c) for c in COLUMNS[n]} == COLUMNS[n]
    rows = df.collect()
    table = spark.read.parquet(f"{SF}/{TABLE.get(n, 'documents')}.parquet")
    if n not in (11, 12):  # these return a row for each piece, and for each node
        assert len(rows) == (table.select("conv_id").distinct().count() + 1 if n == 6 else table.count())
    sql = Q.oracle_sql().get(name)
    if sql:
        c = duckdb.connect()
        for f in os.listdir(SF):
            c.execute(f"CREATE VIEW {f.split('.')[0]} AS SELECT * FROM '{SF}/{f}'")
        want = c.sql(sql)
        got = sorted(str(tuple(r[x] for x in want.columns)) for r in rows)
        assert got == sorted(str(r) for r in want.fetchall())
