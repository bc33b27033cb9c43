from __future__ import annotations

import base64
import hashlib

import pytest

from casewright.llm import warc
from casewright.llm.common import shared_folder

INNER = "WARC/1.1\r\nWARC-Type: response\r\nWARC-Record-ID: <urn:page-id:999>\r\nContent-Length: 3\r\n\r\nabc"
PAGES = [
    (5, "http://a.example/x", "<p>one</p>"),
    (2, "http://a.example/y", "<p>one</p>"),
    (9, None, "<p>one</p>"),
    (1, "http://b.example/", None),
    (4, "http://b.example/ spaced\r\nX: y", ""),
    (6, "", "before\r\n\r\n" + INNER + "\r\n\r\nafter"),
    (7, "u", INNER),
    (8, "u", "\r\n\r\nWARC/1.1\r\n"),
    (10, "u", "\r\n\r\nWARC/1.1\r\n\r\n\r\nWARC/1.1\r\n" * 40 + INNER + "\r\n\r\n" + INNER),
    (11, "u", "before\r\n\r\n" + INNER + "\r\n\r\nafter"),
    (12, "u", "\r\n\r\n"),
    (None, "u", "no id"),
    (13, "u", "é ü 漢字 " * 3000),
    (14, "u", "WARC/1.1\r\nContent-Length: 99999999999\r\n\r\n"),
]


def digest(text: str | None) -> str:
    return base64.b32encode(hashlib.sha1((text or "").encode()).digest()).decode()


def expected(pages):
    least = {}
    for page, _, text in pages:
        if page is not None:
            least[text or ""] = min(page, least.get(text or "", page))
    for page, _, text in pages:
        first = least.get(text or "")
        same = first is None or page == first
        yield page, len((text or "").encode()), digest(text), "response" if same else "revisit", None if same else first


def round_trip(spark, pages, parts=1):
    df = spark.createDataFrame(pages, "page_id long, url string, html string").repartition(parts)
    path = shared_folder(spark, "test-archives")
    warc.write_archive(df, path)
    return path, [tuple(r) for r in warc.page_records(warc.read_archive(spark, path)).collect()]


@pytest.mark.parametrize("split", ["128m", "97", "1k"])
def test_payloads_with_magic_survive_any_split(spark, split):
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", split)
    spark.conf.set("spark.sql.files.openCostInBytes", "1")
    try:
        _, found = round_trip(spark, PAGES)
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
        spark.conf.unset("spark.sql.files.openCostInBytes")
    assert sorted(found, key=str) == sorted(expected(PAGES), key=str)


def test_many_records_in_several_archives(spark):
    pages = [(n, f"http://h/{n}", f"page {n % 50} " * (n % 7)) for n in range(300)]
    path = shared_folder(spark, "test-archives")
    for part in range(3):
        some = spark.createDataFrame(pages[part * 100 : part * 100 + 100], "page_id long, url string, html string")
        warc.write_archive(some, f"{path}/{part}")
    records = warc.read_archive(spark, f"{path}/*")
    counts = [r["count"] for r in records.groupBy("file").count().collect()]
    assert len(counts) >= 3 and sum(counts) == 300
    bytes_read = {r["record_id"]: r["bytes"] for r in records.filter("type = 'response'").collect()}
    assert len(bytes_read) > 30 and all(bytes_read.get(f"<urn:page-id:{n}>", len(t)) == len(t) for n, _, t in pages[:50])


def test_many_repeated_payloads_are_not_broadcast(spark, monkeypatch):
    monkeypatch.setattr(warc, "SMALL_TABLE", 0)
    pages = [(n, "u", f"page {n % 9}" if n % 3 else "the same") for n in range(80)]
    assert sorted(round_trip(spark, pages, 3)[1], key=str) == sorted(expected(pages), key=str)


def test_empty_table_and_repeated_rows(spark):
    assert round_trip(spark, [])[1] == []
    twice = [(3, "u", "same"), (3, "u", "same"), (4, "v", "same")]
    assert sorted(round_trip(spark, twice)[1], key=str) == [
        (3, 4, digest("same"), "response", None),
        (3, 4, digest("same"), "response", None),
        (4, 4, digest("same"), "revisit", 3),
    ]


def test_small_payloads_may_all_be_responses(spark):
    df = spark.createDataFrame([(1, "u", "ab"), (2, "u", "ab"), (3, "u", "abc"), (4, "u", "abc")], "page_id long, url string, html string")
    path = shared_folder(spark, "test-archives")
    warc.write_archive(df, path, least=3)
    kinds = {r["page_id"]: r["record_type"] for r in warc.page_records(warc.read_archive(spark, path)).collect()}
    assert kinds == {1: "response", 2: "response", 3: "response", 4: "revisit"}
