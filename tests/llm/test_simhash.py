from __future__ import annotations

import random
import re

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from casewright.llm import simhash
from casewright.llm.components import connected_components

UPPER = {i: i + 32 for i in range(65, 91)}


def brute_fingerprint(text):
    words = [w for w in re.split(r"[\x20\x09-\x0d]+", (text or "").translate(UPPER)) if w]
    shingles = [" ".join(words[i : i + 3]) for i in range(len(words) - 2)] or ([" ".join(words)] if words else [])
    counts = [0] * 64
    for s in shingles:
        h = xxhash.xxh64(s.encode(), 42).intdigest()
        for b in range(64):
            counts[b] += h >> b & 1
    return sum(1 << b for b in range(64) if counts[b] * 2 > len(shingles)) if shingles else 0


def brute_components(fps):
    """Smallest id reachable by steps of two bits, for each (id, fingerprint)."""
    parent = list(range(len(fps)))

    def find(x):
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    for i, (_, a) in enumerate(fps):
        for j in range(i):
            if (a ^ fps[j][1]).bit_count() <= 2:
                parent[find(i)] = find(j)
    least = {}
    for i, (doc_id, _) in enumerate(fps):
        if doc_id is not None:
            least[find(i)] = min(doc_id, least.get(find(i), doc_id))
    return [least.get(find(i)) for i in range(len(fps))]


def test_edge_cases_against_brute_force(docs, rows):
    found = sorted((tuple(r) for r in simhash.near_duplicates(docs).collect()), key=str)
    fps = [(r[0], brute_fingerprint(r[1])) for r in rows]
    want = [(i, f"{fp:016x}", c) for (i, fp), c in zip(fps, brute_components(fps), strict=True)]
    assert found == sorted(want, key=str)


def test_empty_table(no_docs):
    assert simhash.near_duplicates(no_docs).collect() == []


def linked(spark, values):
    df = spark.createDataFrame([(v - (1 << 64) if v >> 63 else v,) for v in values], "fp long")
    roots = {r["node"] % (1 << 64): r["root"] for r in connected_components(simhash.near_links(df)).collect()}
    groups = {}
    for v in values:
        groups.setdefault(roots.get(v, ("alone", v)), set()).add(v)
    return {frozenset(g) for g in groups.values()}


def brute_groups(values):
    found = {}
    for v, c in zip(values, brute_components([(n, v) for n, v in enumerate(values)]), strict=True):
        found.setdefault(c, set()).add(v)
    return {frozenset(g) for g in found.values()}


@pytest.mark.parametrize("full", [1, 8, 10_000])
def test_links_of_dense_and_sparse_fingerprints(spark, monkeypatch, full):
    """All ways through full and other keys give the same groups; some clusters chain, some touch at three bits."""
    monkeypatch.setattr(simhash, "FULL_KEY", full)
    draw = random.Random(5)
    values = {draw.getrandbits(64) for _ in range(150)}
    for _ in range(4):
        centre = draw.getrandbits(64)
        for _ in range(60):
            near = centre
            for b in draw.sample(range(64), draw.randint(0, 4)):
                near ^= 1 << b
            values.add(near)
    chain = draw.getrandbits(64)
    for b in range(0, 64, 2):
        values.add(chain)
        chain ^= 3 << b
    assert linked(spark, sorted(values)) == brute_groups(sorted(values))


def test_long_text_and_steps():
    text = " ".join(f"w{n % 701}" for n in range(3 * simhash.HASHES_AT_ONCE // 2))
    whole = simhash.fingerprint(text.encode())
    hashes = np.array([xxhash.xxh64_intdigest(s.encode(), 42) for s in map(" ".join, zip(*(text.split()[i:] for i in range(3)), strict=False))], dtype=np.uint64)
    ones = [int(((hashes >> np.uint64(b)) & np.uint64(1)).sum()) for b in range(64)]
    assert whole == sum(1 << b for b in range(64) if 2 * ones[b] > len(hashes))


def test_limits_by_dynamic_programming():
    costs = [[0, 5, 9, 20], [0, 1, 2, 30], [0, 50, 60, 70], [0, 4, 100, 200]]
    limits = simhash.allocate(costs, -1)
    assert sum(limits) == -1
    assert sum(c[t + 1] for c, t in zip(costs, limits, strict=True)) == 6  # one bit in the second part, none in the last


def test_correlated_bits_meet_in_one_part(spark):
    draw = random.Random(3)
    rows = []
    for _ in range(400):
        v = draw.getrandbits(64)
        for a, b in ((0, 40), (1, 41), (2, 42)):
            v = v & ~(1 << b) | (v >> a & 1) << b
        rows.append((v - (1 << 64) if v >> 63 else v,))
    moments = simhash.bit_moments(spark.createDataFrame(rows, "fp long"))
    assert moments[-1, -1] == 400 and moments[3, 3] == moments[-1, 3] == sum(r[0] >> 3 & 1 for r in rows)
    for count in simhash.PART_COUNTS:
        parts = simhash.correlated_parts(moments, count)
        assert len(parts) == count and sorted(b for p in parts for b in p) == list(range(64))
        for pair in ((0, 40), (1, 41), (2, 42)):
            assert any(set(pair) <= set(p) for p in parts)


def test_plans_cover_all_close_pairs(spark):
    """Whatever the limits, two fingerprints within two bits have a key in common."""
    draw = random.Random(9)
    df = spark.createDataFrame([(draw.getrandbits(63),) for _ in range(300)], "fp long")
    plan = simhash.plan_search(df, 2)
    assert sum(plan.limits) == 2 - len(plan.parts) + 1 and sorted(b for p in plan.parts for b in p) == list(range(64))
    for parts, limits in ((plan.parts, plan.limits), (simhash.correlated_parts(simhash.bit_moments(df), 2), (1, 0)), (simhash.correlated_parts(simhash.bit_moments(df), 4), (-1, 2, -1, -1))):
        keys = simhash.Plan(parts, limits).keys(F.col("fp"))
        pairs = [(v, v ^ sum(1 << b for b in draw.sample(range(63), 2))) for v in (draw.getrandbits(63) for _ in range(200))]
        table = spark.createDataFrame([(n, v) for n, pair in enumerate(pairs) for v in pair], "pair long, fp long")
        meet = table.select("pair", F.posexplode(F.array(*keys)).alias("kind", "key")).groupBy("pair", "kind", "key").count()
        assert meet.filter("count > 1").select("pair").distinct().count() == 200


def test_components_of_a_long_chain(spark):
    edges = spark.range(300).selectExpr("id AS a", "id + 1 AS b").unionByName(spark.createDataFrame([(1000, 1001), (1001, 1000), (5, 5)], "a long, b long"))
    roots = {r["node"]: r["root"] for r in connected_components(edges).collect()}
    assert len({roots[n] for n in range(301)}) == 1 and roots[1000] == roots[1001] != roots[0]
