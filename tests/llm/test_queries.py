from __future__ import annotations

import glob
import os

import duckdb
import pytest

import __spark_entry__ as entry
from casewright.llm.oracle import ORACLE
from casewright.llm.queries import QUERIES

SF = "/root/testdata/sf0.001"
COLUMNS = {
    1: ["doc_id", "held_out", "score", "predicted"],
    2: ["doc_id", "keep_id", "group_size", "kept", "text_sha256"],
    3: ["query_id", "rank", "vec_id", "score"],
    4: ["doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"],
    5: ["page_id", "url", "text", "n_chars"],
    6: ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"],
    7: ["doc_id", "size", "source_size", "target", "taken"],
    8: ["page_id", "host", "path", "rule", "verdict"],
    9: ["doc_id", "fingerprint", "component_id"],
    10: ["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to"],
    11: ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"],
    12: ["lang", "source", "part", "item", "value", "rank"],
    13: ["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"],
}


def test_all_are_registered():
    assert set(QUERIES) | {"pipeline"} <= set(entry.queries()) and set(ORACLE) <= set(entry.oracle_sql())
    assert sorted(int(n[2:].split("_")[0]) for n in QUERIES) == list(range(1, 14))


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_columns_and_rows(spark, name):
    number = int(name[2:].split("_")[0])
    found = QUERIES[name](spark, SF)
    assert found.columns == COLUMNS[number]
    rows = [tuple(r) for r in found.collect()]
    table = "embeddings" if number in (3, 13) else "pages" if number in (5, 8, 10) else "documents"
    if number not in (3, 6, 12, 13):
        assert len(rows) == spark.read.parquet(f"{SF}/{table}.parquet").count()
    if name in ORACLE:
        db = duckdb.connect()
        for path in glob.glob(f"{SF}/*.parquet"):
            db.sql(f"CREATE VIEW {os.path.basename(path)[:-8]} AS SELECT * FROM '{path}'")
        want = db.sql(ORACLE[name])
        order = [want.columns.index(c) for c in found.columns]
        assert sorted(map(str, rows)) == sorted(str(tuple(r[i] for i in order)) for r in want.fetchall())
