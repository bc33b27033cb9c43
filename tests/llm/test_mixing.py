from __future__ import annotations

import hashlib
import math
import re
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from casewright.llm import mixing
from casewright.llm.running import hex_cell, totals_before


def brute_targets(sizes, weights=(5, 2, 1), share=1.5, most=2.0):
    names = sorted((s for s in sizes if s is not None), key=lambda s: [ord(c) for c in s]) + [s for s in sizes if s is None]
    weight = {s: weights[n % len(weights)] for n, s in enumerate(names)}
    left, target = share * sum(sizes.values()), {}
    while True:
        rest = [s for s in names if s not in target]
        total = sum(weight[s] for s in rest)
        over = [s for s in rest if left * weight[s] / total > most * sizes[s]]
        if not over:
            return target | {s: left * weight[s] / total for s in rest}
        for s in over:
            target[s] = most * sizes[s]
        left = share * sum(sizes.values()) - sum(target.values())


def brute_taken(rows):
    count = lambda t: len(re.findall(r"[^\x20\x09-\x0d]+", t or ""))
    sources = defaultdict(list)
    for n, (doc_id, text, source) in enumerate(rows):
        key = hashlib.md5(("" if doc_id is None else str(doc_id)).encode()).hexdigest()
        sources[source].append((key, count(text), n))
    sizes = {s: sum(x[1] for x in v) for s, v in sources.items()}
    target = brute_targets(sizes) if sum(sizes.values()) else dict.fromkeys(sizes, 0.0)
    for s, v in sources.items():
        at = 0
        for _, size, n in sorted(v):
            taken = sum(max(0, min(p + at + size, math.floor(target[s])) - (p + at)) for p in (0, sizes[s]))
            yield rows[n][0], size, sizes[s], pytest.approx(target[s]), taken
            at += size


def compare(df, rows, **options):
    mix = mixing.mix_sources(df, **options)
    found = sorted((tuple(r)[:5] for r in mixing.words_taken(mix).collect()), key=str)
    want = sorted(brute_taken(rows), key=lambda r: str((r[0], r[1], r[2], r[3].expected, r[4])))
    assert len(found) == len(want)
    assert all(w == f for f, w in zip(found, want, strict=True))
    return mix


@pytest.mark.parametrize("block", [1, 7, 1024])
def test_edge_cases(docs, rows, block):
    long = (7, 8) if block == 1 else ()  # too many blocks of one word
    df = docs.filter(F.col("doc_id").isNull() | ~F.col("doc_id").isin(*long)) if long else docs
    compare(df, [(r[0], r[1], r[3]) for r in rows if r[0] not in long], block=block)


def test_hot_source_and_schedule(spark):
    rows = [(n, "w " * (n % 90), "hot" if n % 3 else f"s{n % 7}") for n in range(1500)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string")
    mix = compare(df, rows, block=16)
    pieces = mix.pieces.collect()
    assert all(0 < p["words"] <= 16 for p in pieces)
    slots = defaultdict(set)
    for p in pieces:
        slots[p["slot"]].add(p["source"])
    assert all(len(s) == 1 for s in slots.values())
    # every stretch of the schedule holds each source near its share
    order = [slots[n].pop() for n in sorted(slots)]
    shares = {s: order.count(s) / len(order) for s in set(order)}
    for start in range(0, len(order) - 200, 200):
        part = order[start : start + 200]
        assert all(abs(part.count(s) - 200 * v) <= 6 for s, v in shares.items())
    # the same mix whatever the partitions
    again = mixing.mix_sources(df.repartition(7), block=16).pieces
    names = [c for c in mix.pieces.columns]
    assert sorted(map(str, again.select(names).collect())) == sorted(map(str, mix.pieces.select(names).collect()))


def test_empty_and_wordless_tables(no_docs, spark):
    assert mixing.words_taken(mixing.mix_sources(no_docs)).collect() == []
    blank = spark.createDataFrame([(1, None, "a"), (2, " ", None)], "doc_id long, text string, source string")
    assert {r["taken"] for r in mixing.words_taken(mixing.mix_sources(blank)).collect()} == {0}


def test_totals_before_over_several_levels(spark):
    cells = spark.range(70_000).select(F.lit("x").alias("o"), hex_cell(F.col("id"), 3).alias("c"), F.lit(2).alias("n"))
    found = totals_before(cells, "o", "c", "n", 3)
    assert found.filter(F.col("before") != 2 * F.conv("c", 16, 10).cast("long")).count() == 0 and found.count() == 70_000
