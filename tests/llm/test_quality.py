from __future__ import annotations

import zlib

import numpy as np
from pyspark.sql import functions as F

from casewright.llm import quality


def test_gradients_match_differences():
    draw = np.random.default_rng(0)
    sizes = np.array([1, 4, 2])
    x = draw.normal(size=(7, quality.FEATURES))
    y, weight = np.array([1.0, 0.0, 0.3]), np.array([1.0, 2.0, 0.5])
    model = quality.fit([x[:1], x[1:5], x[5:]], y, weight, hidden=5, gate=3, rounds=1)
    model.p = {k: draw.normal(size=v.shape) * 0.3 for k, v in model.p.items()}

    def loss():
        s = model.score(x, sizes)
        return -(weight * (y * np.log(s) + (1 - y) * np.log(1 - s))).sum() / weight.sum()

    grads = model.gradients(x, sizes, y, weight)
    for name, p in model.p.items():
        for place in list(np.ndindex(p.shape))[:: max(1, p.size // 6)]:
            old = p[place]
            p[place] = old + 1e-6
            up = loss()
            p[place] = old - 1e-6
            down = loss()
            p[place] = old
            assert abs((up - down) / 2e-6 - grads[name][place]) < 1e-6


def test_attention_weights_sum_to_one_and_single_passages_score_alone():
    draw = np.random.default_rng(0)
    bags = [draw.normal(size=(n, quality.FEATURES)) for n in (1, 3, 8)]
    model = quality.fit(bags, np.array([1.0, 0, 1]), np.ones(3), rounds=1)
    sizes = np.array([1, 3, 8])
    f = model.forward(np.concatenate(bags), sizes)
    assert np.allclose(np.add.reduceat(f["a"], [0, 1, 4]), 1)
    assert np.allclose(model.score(np.concatenate(bags), sizes), [model.score(b, np.array([len(b)]))[0] for b in bags])


def test_encoding_does_not_depend_on_neighbours():
    texts = [b"", b"  \n", b"one", b"A b! " * 100, "Ünï 漢字 x".encode(), b"a\nb\n" * 70, b"x" * 3000]
    together, counts = quality.encode(texts)
    assert counts.tolist() == [1, 1, 1, 4, 1, 3, 1] and np.isfinite(together).all()
    parts = np.split(together, np.cumsum(counts)[:-1])
    for text, part in zip(texts, parts, strict=True):
        assert np.allclose(quality.encode([text])[0], part, atol=1e-6)
    assert len(quality.encode([])[0]) == 0


def test_held_out_accuracy(spark):
    path = "/root/testdata/sf0.1"
    docs = spark.read.parquet(f"{path}/documents.parquet").select("doc_id", "text")
    labels = spark.read.parquet(f"{path}/labels.parquet")
    model = quality.train(docs, labels, "quality")
    held = labels.filter(quality.remainder("doc_id", 5) == 0)
    rows = quality.quality_scores(docs, model).join(held, "doc_id").toPandas()
    good = rows["quality"] == 1
    assert ((rows["score"] >= 0.3) == good).mean() > 0.98
    ranks = rows["score"].rank()
    area = (ranks[good].sum() - good.sum() * (good.sum() + 1) / 2) / (good.sum() * (~good).sum())
    assert area > 0.99


def test_edge_cases(spark, docs, no_docs):
    labels = spark.createDataFrame([(1, 1), (1, 0), (2, None), (None, 1), (12, 1), (13, 0), (77, 1), (-7, 0), (7, 1)], "doc_id long, quality int")
    model = quality.train(docs, labels, "quality")
    scored = quality.quality_scores(docs, model)
    assert scored.columns == [*[c for c in docs.columns if c != "score"], "score"]
    found = scored.collect()
    assert len(found) == docs.count() and all(0 <= r["score"] <= 1 for r in found)
    assert quality.quality_scores(no_docs, model).collect() == []
    nothing = labels.limit(0)
    assert quality.train(docs, nothing, "quality") is None
    assert {r["score"] for r in quality.quality_scores(docs, None).collect()} == {0.5}
    assert quality.train(no_docs, labels, "quality") is None


def test_held_out_labels_are_not_learnt(spark, docs):
    rows = [(n, n % 2) for n in (1, 2, 3, 5, 6, 9, 12, 13, 15)]
    turned = spark.createDataFrame(rows, "doc_id long, quality int")
    held = quality.remainder("doc_id", 5) == 0
    other = turned.withColumn("quality", F.when(held, 1 - F.col("quality")).otherwise(F.col("quality")))
    one, two = (quality.train(docs, t, "quality") for t in (turned, other))
    assert all(np.array_equal(one.p[k], two.p[k]) for k in one.p)


def test_rows_that_share_an_id_count_once(spark, monkeypatch):
    """A sampled id that many rows hold sends one bag to the driver, whichever rows those are."""
    rows = [(1, f"good text number {n} " * (1 + n % 5)) for n in range(400)] + [(n, f"bad {n}") for n in range(2, 12)]
    labels = spark.createDataFrame([(n, n % 2) for n in range(1, 12)], "doc_id long, quality int")
    sampled = [n for n in range(1, 12) if zlib.crc32(str(n).encode()) % 5]
    assert 1 in sampled
    seen = []
    monkeypatch.setattr(quality, "fit", lambda bags, y, weight: seen.append((len(bags), bags[0].tobytes())))
    for part in (3, 7):
        quality.train(spark.createDataFrame(rows, "doc_id long, text string").repartition(part), labels, "quality")
    assert [n for n, _ in seen] == [len(sampled)] * 2 and seen[0] == seen[1]
