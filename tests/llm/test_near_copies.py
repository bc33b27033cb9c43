from __future__ import annotations

import random

import numpy as np
import pyarrow as pa

import corpus_pipeline as pipeline
from casewright.llm import components, near_copies, simhash

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def text(draw, many=304):
    return [f"w{draw.randrange(20_000)}" for _ in range(many)]


def edited(words, changed, draw):
    """A copy of 304 words that differs in ``changed`` of its 300 shingles: up to 33 leave a similarity of 0.8."""
    at = draw.randrange(10, len(words) - changed - 10)
    return words[:at] + [f"x{draw.random()}" for _ in range(changed - 4)] + words[at + changed - 4 :]


def kept(spark, rows):
    docs = spark.createDataFrame([(n, t, "en", "s", 1) for n, t in rows], DOCS).repartition(4)
    return sorted((r["doc_id"], r["text"]) for r in pipeline.drop_near_copies(spark, docs, "").collect())


def test_copies_of_a_similarity_of_four_fifths_go_and_others_stay(spark):
    draw = random.Random(3)
    rows, want = [], []
    for n in range(200):
        base = text(draw)
        changed = 10 + n % 30  # similarities of 0.94 down to 0.77
        rows += [(2 * n, " ".join(base)), (2 * n + 1, " ".join(edited(base, changed, draw)))]
        want += [2 * n] if changed <= 33 else [2 * n, 2 * n + 1]
    assert [n for n, _ in kept(spark, rows)] == want


def test_fuller_keys_are_searched_to_the_end(spark):
    draw = random.Random(4)
    base, other = text(draw), text(draw)
    rows = [(n, " ".join(edited(base, 12, draw))) for n in range(60)]
    # copies that share a key with the first text and are near each other, but not near it
    far = edited(edited(base, 30, draw), 30, draw)
    rows += [(100 + n, " ".join([*far[:-6], *(f"y{n}" for _ in range(2)), *far[-4:]])) for n in range(40)]
    rows += [(200, " ".join(other)), (201, " ".join(edited(other, 20, draw)))]
    found = [n for n, _ in kept(spark, rows)]
    sets = {n: set(near_copies.shingle_sets(pa.array([t]))[0].tolist()) for n, t in rows}
    near = lambda a, b: len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b])
    assert 0 in found and 200 in found and 201 not in found
    assert not any(near(a, b) for a in found for b in found if a < b)
    assert all(any(near(n, m) for m in sets if m != n) for n in sets if n not in found)


def test_rows_that_share_an_id_and_texts_of_few_words(spark):
    draw = random.Random(5)
    base, other = text(draw), text(draw)
    rows = [(1, " ".join(base)), (2, " ".join(edited(base, 20, draw))), (2, " ".join(other)), (3, "A b"), (4, "a  B"), (5, "a b c"), (6, ""), (7, None)]
    assert [n for n, _ in kept(spark, rows)] == [1, 2, 3, 5, 6]
    assert (2, " ".join(other)) in kept(spark, rows)


def test_sets_equal_brute_force():
    draw = random.Random(6)
    texts = [" ".join(f"w{draw.randrange(5)}" for _ in range(draw.randrange(60))) for _ in range(100)] + ["", "one", None]
    hashes, sizes = near_copies.shingle_sets(pa.array(texts))
    words = [(t or "").split() for t in texts]
    want = [{tuple(w[n : n + 5]) for n in range(max(1, len(w) - 4))} if w else set() for w in words]
    assert sizes.tolist() == [len(s) for s in want]
    assert len(np.unique(hashes)) == len(set().union(*want))


def test_fingerprints_connect_sets_within_two_bits(spark):
    draw = random.Random(7)
    fps = [draw.getrandbits(63) for _ in range(30)]
    rows = [(n, fp) for n, fp in enumerate(fps)] + [(100 + n, fp ^ 1 << n ^ 1 << 40) for n, fp in enumerate(fps)]
    rows += [(200 + n, fps[0]) for n in range(40)] + [(300, fps[1] ^ 7 << 50)]
    found = {(r.a, r.b) for r in near_copies.fingerprint_pairs(spark.createDataFrame(rows, "set_id long, fp long")).collect()}
    assert found == {(n, 100 + n) for n in range(30)} | {(0, 200 + n) for n in range(40)}


def test_the_stage_searches_fingerprints_of_its_shingles(spark, monkeypatch):
    asked = []
    monkeypatch.setattr(near_copies, "near_links", lambda fps: asked.append(fps.count()) or simhash.near_links(fps))
    draw = random.Random(8)
    base, other = text(draw), text(draw)
    rows = [(1, " ".join(base)), (2, " ".join(edited(base, 5, draw))), (3, " ".join(other)), (4, "")]
    assert [n for n, _ in kept(spark, rows)] == [1, 3, 4]
    assert asked and asked[0] >= 2


def test_links_found_before_are_not_contracted_again(spark, monkeypatch):
    asked = []
    monkeypatch.setattr(near_copies, "connected_components", lambda links: asked.append(links.count()) or components.connected_components(links))
    draw = random.Random(9)
    base, other = text(draw), text(draw)
    rows = [(1, " ".join(base)), (2, " ".join(edited(base, 12, draw))), (3, " ".join(other)), (4, " ".join(edited(other, 12, draw)))]
    assert [n for n, _ in kept(spark, rows)] == [1, 3]
    assert asked == [2]


def test_further_edges_join_components(spark):
    draw = random.Random(10)
    ends = [(draw.randrange(80), draw.randrange(80)) for _ in range(70)]
    edges = lambda some: spark.createDataFrame(some, "a long, b long")
    roots = components.connected_components(edges(ends[:40]))
    for more in (ends[40:], [], [(200, 201), (201, 202), (5, 5)]):
        roots = components.joined_components(roots, edges(more))
    want = {r["node"]: r["root"] for r in components.connected_components(edges([*ends, (200, 201), (201, 202)])).collect()}
    rows = [(r["node"], r["root"]) for r in roots.collect()]
    found = dict(rows)
    assert len(rows) == len(found) and found.keys() == want.keys()
    assert all((found[a] == found[b]) == (want[a] == want[b]) for a in want for b in want)


def test_rounds_over_few_edges_write_few_files_however_shuffles_are_dealt(spark):
    settings = {"spark.sql.shuffle.partitions": "64", "spark.sql.adaptive.coalescePartitions.enabled": "false"}
    before = {key: spark.conf.get(key) for key in settings}
    edges = lambda some: spark.createDataFrame(some, "a long, b long")
    try:
        for key, value in settings.items():
            spark.conf.set(key, value)
        roots = components.connected_components(edges([(n, n + 1) for n in range(300) if n % 3]))
        more = components.joined_components(roots, edges([(3 * n, 3 * n + 1) for n in range(1, 100)]))
        assert len(roots.inputFiles()) <= 2 and len(more.inputFiles()) <= 4
        assert more.select("node").distinct().count() == more.count() == 300
        assert more.select("root").distinct().count() == 1
    finally:
        for key, value in before.items():
            spark.conf.set(key, value)
