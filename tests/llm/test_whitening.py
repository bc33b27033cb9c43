from __future__ import annotations

import math

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from casewright.llm import whitening

NAN, INF = float("nan"), float("inf")
COLUMNS = ["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"]


def frame(spark, rows, kind="float"):
    return spark.createDataFrame(rows, f"vec_id long, embedding array<{kind}>").withColumn("x", F.lit("x"))


def brute(rows):
    """Per row id its whole vector, deviation and the covariance, with Python integers and fractions of them."""
    usable = [(i, tuple(math.floor(256 * np.float32(c).item()) for c in v)) for i, v in rows
              if v is not None and all(c is not None and math.isfinite(c) for c in v)]
    listed = sorted({v for _, v in usable})
    n, dims = len(listed), len(listed[0])
    sums = [sum(v[d] for v in listed) for d in range(dims)]
    covariance = [[sum((n * v[i] - sums[i]) * (n * v[j] - sums[j]) for v in listed) / n**3 for j in range(dims)] for i in range(dims)]
    deviation = {i: sum((n * c - s) ** 2 for c, s in zip(v, sums, strict=True)) for i, v in usable}
    return usable, n, sums, np.array(covariance), deviation


@settings(max_examples=60, deadline=None)
@given(st.integers(1, 200), st.integers(1, 5), st.integers(0, 40), st.integers(0, 10_000))
def test_cross_products(rows, dims, bits, seed):
    block = np.random.default_rng(seed).integers(-(2**bits), 2**bits, (rows, dims))
    sums, products = whitening.scatter(block)
    exact = block.astype(object)
    assert sums == exact.sum(axis=0).tolist() and products == (exact.T @ exact).tolist()


def test_against_brute_force(spark, monkeypatch):
    monkeypatch.setattr(whitening, "BLOCK_ENTRIES", 300)  # many blocks
    draw = np.random.default_rng(5)
    rows = [(int(n), [float(c) for c in draw.normal(0.1, [0.5, 0.3, 0.2, 0.1, 0.05, 0.4])]) for n in range(400)]
    rows += [(n, [0.25, -0.5, 0.0, -0.0, 1.0, 2.0]) for n in range(400, 700)]  # one common vector counts once
    rows += [(700, None), (701, [NAN] * 6), (702, [INF] + [0.0] * 5), (703, [None] + [0.0] * 5), (None, rows[0][1]), (5, rows[5][1])]
    usable, n, sums, covariance, deviation = brute(rows)
    found = whitening.whiten(frame(spark, rows)).toPandas()
    assert list(found.columns) == COLUMNS and len(found) == 4 * len(usable)
    assert set(found.n) == {n} and (found.identity_error < 1e-9).all() and found.identity_error.nunique() == 1
    for i, group in found.dropna(subset=["vec_id"]).groupby("vec_id"):
        assert set(group.deviation) == {deviation[i]}
    values, vectors = np.linalg.eigh(covariance)
    listed = dict(usable)
    for component in range(1, 5):
        part = found[(found.component == component) & found.vec_id.notna()]
        value, vector = values[-component], vectors[:, -component]
        want = np.array([(np.array(listed[i]) - np.array(sums) / n) @ vector / np.sqrt(value) for i in part.vec_id])
        got = part.whitened.to_numpy()
        assert np.allclose(got, want, atol=1e-9) or np.allclose(got, -want, atol=1e-9)
        assert np.allclose(part.explained, value / np.trace(covariance), rtol=1e-9)
    owners = sorted({v: i for i, v in usable if i is not None}.values())  # one id for each distinct vector
    spread = found.drop_duplicates(["vec_id", "component"]).pivot(index="vec_id", columns="component", values="whitened").loc[owners]
    assert len(owners) == n and np.abs(np.cov(spread.to_numpy().T, bias=True) - np.eye(4)).max() < 1e-9


def test_odd_tables(spark):
    assert whitening.whiten(frame(spark, [])).collect() == []
    assert whitening.whiten(frame(spark, [(1, []), (2, None)])).collect() == []
    [only] = whitening.whiten(frame(spark, [(1, [0.5])])).collect()  # nothing varies
    assert tuple(only) == (1, 1, 1, 0, None, 0.0, 0.0)
    mixed = whitening.whiten(frame(spark, [(1, [0.0, 1.0]), (2, [1.0, 0.0]), (3, [1.0, 2.0, 3.0]), (4, [2.0, 2.0, 3.0])])).collect()
    assert sorted((r.vec_id, r.component, r.n) for r in mixed) == [
        *[(i, c, 2) for i in (1, 2) for c in (1, 2)], *[(i, c, 2) for i in (3, 4) for c in (1, 2, 3)]
    ]
    flat = [r for r in mixed if r.component > 1]
    assert all(r.whitened is None for r in flat) and all(abs(abs(r.whitened) - 1) < 1e-12 for r in mixed if r.component == 1)


def test_wide_and_large_vectors(spark):
    draw = np.random.default_rng(2)
    rows = [(n, [float(c) for c in draw.normal(0, 1, 300)]) for n in range(40)]
    found = whitening.whiten(frame(spark, rows)).collect()
    assert len(found) == 160 and max(r.identity_error for r in found) < 1e-4
    large = [(1, [1e9, 0.0]), (2, [-1e9, 0.0]), (3, [0.0, 1.0])]
    assert {r.vec_id: r.deviation for r in whitening.whiten(frame(spark, large, "double")).collect()} == {1: None, 2: None, 3: 262144}
    with pytest.raises(PySparkException):
        whitening.whiten(frame(spark, [(1, [1e30])], "double")).collect()
