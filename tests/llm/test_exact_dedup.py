from __future__ import annotations

import hashlib
import re
from collections import defaultdict

import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from casewright.llm.exact_dedup import exact_duplicates


def expected(rows):
    groups = defaultdict(list)
    for doc_id, text in rows:
        groups[re.sub(r"[\x20\x09-\x0d]", "", text or "")].append((-len(text or ""), doc_id is None, doc_id))
    for doc_id, text in rows:
        body = re.sub(r"[\x20\x09-\x0d]", "", text or "")
        keep = min(groups[body], key=lambda g: (g[0], g[1], g[2] or 0))[2]
        yield doc_id, keep, len(groups[body]), doc_id == keep, hashlib.sha256(body.encode()).hexdigest()


def as_list(df):
    return sorted((tuple(r) for r in df.collect()), key=str)


def test_edge_cases(docs, rows):
    assert as_list(exact_duplicates(docs)) == sorted(expected([r[:2] for r in rows]), key=str)


def test_empty_table(no_docs):
    assert exact_duplicates(no_docs).collect() == []


def test_a_large_group_of_copies_and_code_points(spark):
    rows = [(n, "same text" if n % 3 else f"text {n % 40}") for n in range(600)] + [(1000, "😀😀 "), (1001, " 😀 😀"), (1002, "😀😀  ")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert as_list(exact_duplicates(df)) == sorted(expected(rows), key=str)


def test_texts_that_share_the_hash_come_apart(spark):
    rows = [(n, f"text {n % 20}") for n in range(60)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    weak = exact_duplicates(df, digest=lambda text: F.substring(F.md5(text.cast("binary")), 1, 0))
    assert as_list(weak) == sorted(expected(rows), key=str)


def test_two_texts_with_both_hashes_stop_the_query(spark, monkeypatch):
    from casewright.llm import exact_dedup

    monkeypatch.setattr(exact_dedup.F, "sha2", lambda column, bits: F.lit("same"))
    df = spark.createDataFrame([(1, "a"), (2, "b")], "doc_id long, text string")
    with pytest.raises(PySparkException, match="two different texts"):
        exact_duplicates(df, digest=lambda text: F.lit("same")).collect()
