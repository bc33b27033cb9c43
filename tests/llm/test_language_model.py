from __future__ import annotations

import math
import re
import zlib
from collections import Counter

import numpy as np
import pytest

from casewright.llm import language_model as lm
from casewright.llm.common import shared_folder
from casewright.llm.queries import QUERIES

UPPER = {i: i + 32 for i in range(65, 91)}


def tokens(text):
    return [*[w for w in re.split(r"[\x20\x09-\x0d]+", (text or "").translate(UPPER)) if w], ""]


def in_fold(doc_id):
    return zlib.crc32(("" if doc_id is None else str(doc_id)).encode()) % 10 == 0


def brute(rows):
    """Exact columns, and the model's score with exact instead of filtered counts."""
    counts, pairs = Counter(), Counter()
    for doc_id, text in rows:
        if not in_fold(doc_id):
            t = tokens(text)
            counts.update(t)
            pairs.update(zip(["", *t], t, strict=False))
    total, mass = sum(counts.values()), sum(counts.values()) + 0.1 * (len(counts) + 1)
    level = lambda n: n.bit_length()
    mean = lambda q: (2.0**q / 2 + 2.0**q - 1) / 2 if q else 0.0
    for doc_id, text in rows:
        t = tokens(text)
        base = sum(math.log10((counts[w] + 0.1) / mass) for w in t)
        score = 0.0
        for v, w in zip(["", *t], t, strict=False):
            seen, both = mean(level(counts[v])), level(pairs[v, w])
            both = min(both, level(counts[v]), level(counts[w]))
            trust = seen / (seen + lm.TRUST)
            score += math.log10(min(1.0, trust * min(1.0, mean(both) / max(seen, 1.0)) + (1 - trust) * (mean(level(counts[w])) + 0.1) / mass))
        yield doc_id, in_fold(doc_id), len(t), sum(counts[w] > 0 for w in t), total, base, score


def compare(df, rows, close, **more):
    found = sorted((tuple(r) for r in lm.lm_scores(df, **more).collect()), key=lambda r: str(r[:5]) + f"{r[5]:.3f}")
    want = sorted(brute(rows), key=lambda r: str(r[:5]) + f"{r[5]:.3f}")
    assert [f[:5] for f in found] == [w[:5] for w in want]
    assert [f[5] for f in found] == pytest.approx([w[5] for w in want], rel=1e-9)
    # the filter errs by a few false positives
    assert [f[6] for f in found] == pytest.approx([w[6] for w in want], rel=close, abs=1)
    return found


def test_edge_cases(docs, rows):
    found = compare(docs, [r[:2] for r in rows], 0.05)
    assert all(r[6] <= 0 for r in found)


def several(spark):
    rows = [(n, " ".join(f"w{(n * k) % 89} The" for k in range(n % 30))) for n in range(300)]
    return rows, spark.createDataFrame(rows, "doc_id long, text string").repartition(3)


def test_several_chunks(spark):
    rows, df = several(spark)
    compare(df, rows, 0.05)


def test_groups_of_segments_give_the_scores_of_one(spark):
    """The filter sent in one group and in many, a segment each: every n-gram stays in the model."""
    rows, df = several(spark)
    whole = compare(df, rows, 0.05)
    assert compare(df, rows, 0.05, group_bytes=1_000) == whole
    assert compare(df, rows, 0.05, group_bytes=1) == whole


def test_empty_table_and_nothing_to_learn(spark, no_docs):
    assert lm.lm_scores(no_docs).collect() == []
    held = [n for n in range(100) if in_fold(n)][:2]
    df = spark.createDataFrame([(n, "a b") for n in held], "doc_id long, text string")
    assert [tuple(r) for r in lm.lm_scores(df).collect()] == [(n, True, 3, 0, 0, 0.0, 0.0) for n in held]


def test_filter_never_undercounts_and_rarely_overcounts(spark):
    draw = np.random.default_rng(2)
    hashes = draw.integers(-(2**63), 2**63, 40_000)
    levels = draw.integers(1, 6, 40_000)
    frame = spark.createDataFrame(list(zip(hashes.tolist(), levels.tolist(), strict=True)), "h long, level int")
    built, width = lm.unigram_segments(frame, 8 * lm.BUCKET_WORDS, 1)
    rows = [(r["ord"], r["bucket"], bytes(r["bits"])) for r in built.collect()]
    assert len(rows) == 1 << width > 4
    model = lm.CountFilter(rows, {1: width, 2: 1}, lm.EVERY)
    found = model.levels(hashes.view(np.uint64), 1)
    assert (found >= levels).all() and (found == levels).mean() > 0.85
    strangers = draw.integers(-(2**63), 2**63, 40_000).view(np.uint64)
    assert (model.levels(strangers, 1) > 0).mean() < 0.12
    assert model.levels(hashes.view(np.uint64), 1, np.full(40_000, 2)).max() <= 2
    some = lm.CountFilter(rows[:2], {1: width, 2: 1}, lm.EVERY)
    here = np.isin(lm.bucket_of(hashes.view(np.uint64), width), [r[1] for r in rows[:2]])
    assert (some.levels(hashes.view(np.uint64), 1) == np.where(here, found, 0)).all()


def test_every_bigram_is_in_its_segment(spark):
    rows, df = several(spark)
    chunks = lm.encode_chunks(df.selectExpr("doc_id", "text", "false AS held"), "bigint")
    found, width = lm.bigram_segments(chunks, 200 * lm.BUCKET_TOKENS, 1)
    model = lm.CountFilter([(r["ord"], r["bucket"], bytes(r["bits"])) for r in found.collect()], {1: 1, 2: width}, lm.EVERY)
    pairs = Counter(pair for _, text in rows for pair in zip(["", *tokens(text)], tokens(text), strict=False))
    first, second = (lm.word_hashes([p[side] for p in pairs]) for side in (0, 1))
    levels = model.levels(lm.bigram_hashes(first, second), 2)
    want = np.array([n.bit_length() for n in pairs.values()])
    assert (levels >= want).all() and (levels == want).mean() > 0.85


def test_the_query_learns_bigrams_seen_once(spark):
    """Of two held-out texts of the same words, the one whose word pairs were seen once scores higher."""
    learnt, held = [n for n in range(400) if not in_fold(n)], [n for n in range(400) if in_fold(n)][:2]
    words = [f"w{n}" for n in range(40)]
    rows = [(n, " ".join([words[n % 40], f"p{n}"])) for n in learnt[:300]] + [(learnt[300], " ".join(words))]
    rows += [(held[0], " ".join(words)), (held[1], " ".join(reversed(words)))]
    path = shared_folder(spark, "once")
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(f"{path}/documents.parquet")
    score = {r["doc_id"]: r["score"] for r in QUERIES["op4_bloom_language_model"](spark, path).collect()}
    assert score[held[0]] > score[held[1]] + 5
