from __future__ import annotations

import math

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from casewright.llm import topk

NAN, INF = float("nan"), float("inf")


def brute(rows, k=20, scale=64):
    usable = [(i, [math.floor(scale * np.float32(x).item()) for x in v]) for i, v in rows if i is not None and v is not None and all(x is not None and math.isfinite(x) for x in v)]
    queries = {(i, tuple(v)) for i, v in usable if i % 20 == 0}
    best = {}
    for q, v in queries:
        scores = [(-sum(a * b for a, b in zip(v, w, strict=True)), i) for i, w in usable if i != q and len(v) == len(w)]
        best.setdefault(q, []).extend(scores)
    for q, scores in best.items():
        for rank, (score, i) in enumerate(sorted(scores)[:k], 1):
            yield q, rank, i, -score


def search(spark, rows):
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>").withColumn("score", F.lit("x"))
    return sorted(tuple(r) for r in topk.top_k(df, F.col("vec_id") % 20 == 0).collect())


@pytest.mark.parametrize("block", [16, 100, 32_768])
def test_against_brute_force(spark, monkeypatch, block):
    monkeypatch.setattr(topk.build_index, "__defaults__", (block,))
    draw = np.random.default_rng(1)
    rows = [(int(n), [float(x) for x in draw.normal(0, 0.3, 6)]) for n in range(400)]
    rows += [(n, [0.5] * 6) for n in range(400, 480)]  # one common vector: ties
    assert search(spark, rows) == sorted(brute(rows))


def test_edge_cases(spark):
    rows = [
        (0, [0.1, -0.2]), (20, [-0.7, 3.0]), (40, None), (60, [None, 1.0]), (80, [NAN, 1.0]), (100, [INF, 1.0]), (120, [0.0, 0.0]),
        (1, [0.1, -0.2]), (2, [-INF, 0.0]), (3, [1e-9, -1e-9]), (4, [200.0, -300.5]), (5, [1.0]), (140, [2.0]), (160, []), (6, []),
        (None, [1.0, 1.0]), (-20, [1.0, 1.0]), (0, [0.1, -0.2]), (7, [0.1, -0.2]),
    ]
    assert search(spark, rows) == sorted(brute(rows))


def test_components_of_any_size(spark):
    rows = [(0, [3e7, -2.0]), (1, [2.0e7, 5.0]), (2, [-3e7, 1.0]), (3, [0.5, 2.5e7]), (20, [0.25, 1.0]), (4, [1e15, 1.0])]
    assert search(spark, rows[:5]) == sorted(brute(rows[:5]))
    assert search(spark, rows[4:]) == sorted(brute(rows[4:]))


@pytest.mark.parametrize("rows", [[(0, [1e30]), (1, [1.0])], [(0, [1e9]), (1, [1e9])], [(0, [-1e9, 1e9]), (1, [1e9, -1e9])]])
def test_what_does_not_fit_a_long_is_an_error(spark, rows):
    with pytest.raises(Exception, match="beyond a long"):
        search(spark, rows)


def test_clashing_names_and_a_very_long_vector(spark):
    rows = [(n, [(n * 7 + d) % 11 / 8 - 0.5 for d in range(3000)]) for n in range(0, 60, 5)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    df = df.selectExpr("*", "1 AS rank", "2 AS id", "3 AS q", "4 AS v", "5 AS block", "6 AS lane", "7 AS query_id")
    found = topk.top_k(df, F.col("vec_id") % 20 == 0)
    assert found.columns == ["query_id", "rank", "vec_id", "score"]
    assert sorted(tuple(r) for r in found.collect()) == sorted(brute(rows))


def test_empty_table(spark):
    assert search(spark, []) == []
    assert search(spark, [(1, [1.0])]) == []


@settings(max_examples=60, deadline=None)
@given(st.integers(1, 200), st.integers(1, 5), st.integers(0, 12), st.integers(1, 25), st.randoms(use_true_random=False))
def test_bitmap_arithmetic(size, dims, bits, k, draw):
    values = np.array([[draw.randint(-(1 << bits), 1 << bits) for _ in range(dims)] for _ in range(size)])
    weights = np.array([draw.choice([0, 1, -1, draw.randint(-100, 100)]) for _ in range(dims)])
    low, slices, width = topk.slice_rows(values)
    total = topk.weighted_sum(slices, weights)
    valid = np.packbits(np.arange(slices.shape[2] * 64) < size, bitorder="little").view("<u8")
    rows = topk.top_rows(total, valid, k)
    scores = values @ weights
    want = sorted(range(size), key=lambda r: (-scores[r], r))[:k]
    assert sorted(rows.tolist()) == sorted(want)
