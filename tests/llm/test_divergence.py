from __future__ import annotations

import random
import re
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
import pytest
from hypothesis import given
from hypothesis import strategies as st

from casewright.llm import divergence


TERM = re.compile(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+")


def lower(text):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text)


def brute(rows, least=3, top=200):
    """Rows of (lang, source, text) by plain loops over every term."""
    texts = [(lang or "", source or "", TERM.findall(lower(text or ""))) for lang, source, text in rows]
    found = []
    for lang in {t[0] for t in texts}:
        here = [t for t in texts if t[0] == lang]
        held = Counter(term for _, _, words in here for term in set(words))
        kept = sorted(term for term, docs in held.items() if docs >= least)
        counts = defaultdict(Counter)
        for _, source, words in here:
            counts[source].update(w for w in words if held[w] >= least)
        share = lambda c, t: 1 + 10**9 * (c[t] + 1) // (sum(c.values()) + len(kept))
        total = sum(counts.values(), Counter())
        for source, count in counts.items():
            p = {t: share(count, t) for t in kept}
            pairs = [(-sum((p[t] - share(c, t)) ** 2 // share(c, t) for t in kept), other.encode()) for other, c in counts.items() if other != source]
            terms = [(-((p[t] - share(total, t)) ** 2 // share(total, t)), t.encode()) for t in kept if count[t] and p[t] > share(total, t)]
            for part, items in (("pair", sorted(pairs)), ("term", sorted(terms)[:top])):
                found += [(lang, source, part, item.decode(), -value, rank) for rank, (value, item) in enumerate(items, 1)]
    return sorted(found)


def audit(spark, rows, **more):
    frame = spark.createDataFrame(rows, "lang string, source string, text string")
    frame = frame.selectExpr("*", "'x' AS place", "1 AS count", "'y' AS terms", "2 AS part", "'z' AS no")
    return sorted(map(tuple, divergence.audit_sources(frame, **more).collect()))


@given(st.lists(st.text(max_size=30) | st.none(), min_size=1, max_size=5), st.integers(0, 4))
def test_terms(texts, skipped):
    column = pa.array(texts, pa.string()).slice(min(skipped, len(texts) - 1))
    want = [TERM.findall(lower(t or "")) for t in column.to_pylist()]
    assert divergence.terms_of(column).to_pylist() == want


def corpus(sources, words):
    """Documents of two languages with common, rare and repeated words; one source has no term at all."""
    rows = []
    for n in range(120):
        source, lang = f"s{n % sources:03d}", ("en", "de")[n % 7 == 0]
        text = " ".join(f"w{chr(97 + (n * k + k * k) % words % 26)}{chr(97 + (n * k + k * k) % words // 26)}" for k in range(1, 12))
        rows.append((lang, source, f"{text} The the ÉTÉ été-{'b' * (n % 3 + 1)}"))
    return rows + [("en", "empty", " 1 2 3 "), ("en", None, None), (None, "s1", "alone here"), (None, "s2", ""), ("fr", "s", "un"), ("fr", "s", "un un")]


@pytest.mark.parametrize("sources, terms, tile", [(5, 4096, 64), (9, 7, 4)])
def test_against_brute_force(spark, monkeypatch, sources, terms, tile):
    monkeypatch.setattr(divergence, "BLOCK_TERMS", terms)
    monkeypatch.setattr(divergence, "TILE", tile)
    rows = corpus(sources, 60)
    assert audit(spark, rows) == brute(rows)


def test_top_terms_ties_and_least_documents(spark):
    rows = [("en", f"s{n % 2}", f"alpha beta gamma {'delta' if n % 2 else 'Éa'}") for n in range(8)] * 2
    assert audit(spark, rows, least_docs=4, top_terms=1) == brute(rows, 4, 1)


def test_odd_tables(spark, docs, no_docs, rows):
    assert divergence.audit_sources(no_docs).collect() == []
    found = sorted(map(tuple, divergence.audit_sources(docs).collect()))
    assert found == brute([(r[2], r[3], r[1]) for r in rows])


def test_sums_are_exact_however_often_they_are_drawn_together(monkeypatch):
    monkeypatch.setattr(divergence, "HELD_ENTRIES", 7)
    draw, sums, want = random.Random(1), divergence._Sums(), Counter()
    for _ in range(40):
        rows = [(draw.choice("abc"), draw.randrange(9), draw.randrange(5)) for _ in range(draw.randrange(6))]
        names = sums.numbers([r[0] for r in rows])
        sums.add(names, np.array([r[1] for r in rows], dtype=np.int64), np.array([r[2] for r in rows], dtype=np.int64))
        for name, place, count in rows:
            want[name, place] += count
    names = {number: name for name, number in sums.names.items()}
    found = {(names[s], p): c for s, p, c in zip(*(part.tolist() for part in sums.sums()), strict=True)}
    assert found == dict(want)


def test_terms_are_written_plain(spark):
    """Building dictionaries of terms took more of a task than writing them does."""
    docs = spark.createDataFrame([("en", "s", "a b c a b c")], "lang string, source string, text string")
    (file,) = divergence._term_lists(docs).inputFiles()
    group = pq.ParquetFile(file.removeprefix("file:").replace("///", "/")).metadata.row_group(0)
    terms = next(group.column(n) for n in range(group.num_columns) if group.column(n).path_in_schema.startswith("terms"))
    assert not any("DICTIONARY" in e for e in terms.encodings)
