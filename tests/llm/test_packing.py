from __future__ import annotations

import zlib
from collections import defaultdict

import numpy as np
import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from casewright.llm.packing import Limits, pack, pack_texts


@settings(max_examples=150, deadline=None)
@given(
    st.lists(st.tuples(st.integers(0, 300), st.floats(0, 1)), max_size=40),
    st.sampled_from([Limits(64, 4, 40), Limits(32, 1, 32), Limits(64, 100, 1), Limits(7, 3, 5)]),
)
def test_every_token_once_within_all_limits(items, limits):
    lengths = np.array([n for n, _ in items], dtype=np.int64)
    free = np.array([int(n * f) for n, f in items], dtype=np.int64)
    spans = defaultdict(list)
    for placed in pack(lengths, free, limits):
        size = sum(p.length for p in placed)
        assert 0 < size <= limits.tokens and len(placed) <= limits.segments
        assert sum(p.loss for p in placed) <= limits.loss
        assert size == limits.tokens or size & (size - 1) == 0  # nothing to pad
        for p in placed:
            assert p.length > 0
            spans[p.item].append((p.start, p.end))
    for item, length in enumerate(lengths.tolist()):
        at = 0
        for start, end in sorted(spans[item]):
            assert start == at
            at = end
        assert at == length


def check(found, texts, limits):
    tokenizer = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    ids = {k: [*tokenizer.encode(t or "", add_special_tokens=False).ids, 1] for k, t in texts.items()}
    pieces, sequences = defaultdict(list), defaultdict(list)
    for r in found:
        pieces[r["doc_id"]].append(r)
        sequences[r["sequence_id"]].append(r)
    assert set(pieces) == set(ids)
    for doc_id, parts in pieces.items():
        copies = len(parts) and sum(p["length"] for p in parts) // len(ids[doc_id])
        assert sum(p["length"] for p in parts) == copies * len(ids[doc_id])
        for p in parts:
            own = np.array(ids[doc_id][p["start"] : p["start"] + p["length"]], dtype="<u4").tobytes()
            assert p["doc_tokens"] == len(ids[doc_id]) and len(own) == 4 * p["length"] and zlib.crc32(own) == p["crc"]
    for parts in sequences.values():
        at = 0
        for p in sorted(parts, key=lambda p: p["offset"]):
            assert p["offset"] == at
            at += p["length"]
        assert at <= limits.tokens and (at == limits.tokens or at & (at - 1) == 0)


def test_edge_cases(docs, rows):
    texts = {r[0]: r[1] for r in rows}
    for limits in (Limits(), Limits(256, 3, 256)):
        found = pack_texts(docs, limits=limits).withColumn("crc", F.crc32("token_ids")).collect()
        check(found, texts, limits)


def test_marks_and_odd_texts(spark):
    texts = {1: "it's <|endoftext|> DON'T", 2: "á ́b é x", 3: "İSTANBUL ΣΑΣ ǅ ﬁ ½", 4: "x" * 5000, 5: "!!! ??? ... 123456 a1b2"}
    df = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    check(pack_texts(df).withColumn("crc", F.crc32("token_ids")).collect(), texts, Limits())


def test_empty_table(no_docs):
    assert pack_texts(no_docs).collect() == []


def test_prompts_bear_no_loss(spark):
    rows = [(n, f"question number {n} " * 5, f"answer {n} " * 12) for n in range(30)] + [(99, None, None)]
    df = spark.createDataFrame(rows, "doc_id long, prompt string, text string")
    limits = Limits(128, 3, 70)
    tokenizer = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    bare = {i: len(tokenizer.encode(p or "", add_special_tokens=False).ids) for i, p, _ in rows}
    loss, many = defaultdict(int), defaultdict(int)
    for r in pack_texts(df, prompt_col="prompt", limits=limits).collect():
        loss[r["sequence_id"]] += max(0, r["start"] + r["length"] - max(r["start"], bare[r["doc_id"]]))
        many[r["sequence_id"]] += 1
    assert max(loss.values()) <= 70 and max(many.values()) <= 3


def test_limits_must_be_positive():
    with pytest.raises(ValueError, match="positive"):
        list(pack(np.array([3]), np.array([0]), Limits(0, 1, 1)))
