from __future__ import annotations

import zlib
from collections import Counter

import pytest
from pyspark.sql import functions as F

import corpus_pipeline as pipeline
from casewright.llm.common import shared_folder

SF = "/root/testdata/sf0.001"
DOCS = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="module")
def labelled(spark):
    """A folder with labels for the stages that read them."""
    path = shared_folder(spark, "labels")
    spark.read.parquet(f"{SF}/labels.parquet").write.parquet(f"{path}/labels.parquet")
    return path


def test_run_is_the_stages_one_after_the_other(spark):
    packed = pipeline.run(spark, SF)
    rows = packed.collect()
    assert packed.columns == ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"] and rows
    docs, kept = spark.read.parquet(f"{SF}/documents.parquet"), []
    for _, stage in pipeline.STAGES[:4]:
        docs = stage(spark, docs, SF)
        path = shared_folder(spark, "step")
        docs.write.parquet(path)
        docs = spark.read.parquet(path)
        assert docs.columns == ["doc_id", "text", "lang", "source", "n_chars"]
        kept.append(docs.count())
    assert kept[0] >= kept[1] >= kept[2]
    assert {r["doc_id"] for r in rows} == {r["doc_id"] for r in docs.collect()}
    assert len(pipeline.STAGES) == 5 and pipeline.ORACLE_SQL is None


def test_classifier_rejects_bad_and_keeps_good(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    labels = spark.read.parquet("/root/testdata/sf0.01/labels.parquet")
    kept = pipeline.keep_good(spark, docs, "/root/testdata/sf0.01").select("doc_id", F.lit(1).alias("kept"))
    counts = Counter((r["quality"], r["kept"] is not None) for r in labels.join(kept, "doc_id", "left").collect())
    assert counts[1, False] <= 0.02 * counts[1, True] and counts[0, True] <= 0.1 * counts[0, False]


def test_exact_and_near_copies(spark):
    base = " ".join(f"word{n}" for n in range(400))
    rows = [(3, base, "en", "s", 1), (1, base + " ", "en", "s", 1), (2, base, None, None, None), (5, None, "en", "s", 0), (4, "", "en", "s", 0)]
    rows += [(6, base.replace("word77 ", "other "), "en", "s", 1), (7, "quite another text", "en", "s", 1), (7, "quite another text", "en", "s", 1)]
    docs = spark.createDataFrame(rows, DOCS)
    kept = pipeline.drop_exact_copies(spark, docs, SF)
    assert sorted(r["doc_id"] for r in kept.collect()) == [1, 4, 6, 7]
    assert sorted(r["doc_id"] for r in pipeline.drop_near_copies(spark, kept, SF).collect()) == [1, 4, 7]


def test_mix_repeats_cuts_and_leaves_out(spark):
    rows = [(n, " ".join(f"t{k}" for k in range(50)), "en", "abc"[n % 3], 9) for n in range(90)] + [(90, None, "en", "a", 0)]
    docs = spark.createDataFrame(rows, DOCS)
    out = pipeline.mix(spark, docs, SF).collect()
    words = Counter()
    for r in out:
        assert r["n_chars"] == len(r["text"]) and r["text"].split() == rows[r["doc_id"]][1].split()[: len(r["text"].split())]
        words[r["source"]] += len(r["text"].split())
    # 4500 words mix to 6750: the first source stops at twice its 1500, 2 : 1 shares the rest
    assert words == {"a": 3000, "b": 2500, "c": 1250}
    assert max(Counter(r["doc_id"] for r in out).values()) == 2 and 90 not in {r["doc_id"] for r in out}


def test_mix_takes_rows_that_share_an_id_whole(spark):
    rows = [(7, "a b c", "en", "s", 0), (7, "a b c d e f", "en", "s", 0), (7, "a b c d e f", "en", "s", 0), (8, "g h i j k", "en", "t", 0)]
    out = Counter((r["doc_id"], r["text"]) for r in pipeline.mix(spark, spark.createDataFrame(rows, DOCS), SF).collect())
    assert set(out) == {(r[0], r[1]) for r in rows}
    assert out[7, "a b c"] <= 2 and out[7, "a b c d e f"] <= 4 and out[8, "g h i j k"] <= 2


@pytest.mark.parametrize("stage", [name for name, _ in pipeline.STAGES])
def test_edge_cases_and_empty_tables(spark, docs, no_docs, labelled, stage):
    """Null, empty, long and repeated rows, and further columns named like working columns."""
    function = dict(pipeline.STAGES)[stage]
    more = docs.withColumns({n: F.lit(1) for n in ("row", "words", "id", "keep", "size", "fp", "component_id", "_id")})
    result = function(spark, more, labelled)
    if stage != pipeline.STAGES[-1][0]:
        assert result.columns == more.columns
    assert result.count() > 0
    assert function(spark, no_docs, labelled).count() == 0


def test_packed_ids_match_their_digest(spark):
    docs = spark.createDataFrame([(1, "a b c", "en", "s", 5)], DOCS)
    (row,) = pipeline.pack(spark, docs, SF).collect()[:1]
    assert row["doc_tokens"] == 4 and 0 <= row["ids_crc32"] < 1 << 32 and zlib.crc32(b"") == 0
