from __future__ import annotations

import hashlib
import random

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
import sentencepiece
from hypothesis import given, settings
from hypothesis import strategies as st

from casewright.llm import pieces

PATH = public_tokenizers.path("piece_bpe_32k.model")
LIBRARY = sentencepiece.SentencePieceProcessor(model_file=PATH)
MODEL = pieces.read_model(PATH)


def encode(texts, codec=None):
    ids, counts = (codec or pieces.codec(MODEL)).encode(pa.array(texts, pa.string()))
    return [part.tolist() for part in np.split(ids, np.cumsum(counts)[:-1])]


def decode(lists):
    return pieces.codec(MODEL).decode(pa.array(lists, pa.list_(pa.int32()))).to_pylist()


ODD = [
    "", " ", "  ", "a", " a", "a ", "a  b   c", "\n", "a\tb\r\n", "▁", "▁x", "x▁ y", "▁ ▁ ▁", "▁" * 40, " " * 100 + "x",
    "\x00a", "﻿a", "<s>", "<unk> </s><0x0A>", "é́漢😀", "the" * 50, "na" * 500, "a" * 333, "�",
]


def test_odd_texts():
    assert encode(ODD) == LIBRARY.encode(ODD)
    assert decode(LIBRARY.encode(ODD)) == LIBRARY.decode(LIBRARY.encode(ODD))


@settings(max_examples=300, deadline=None)
@given(st.lists(st.text(st.sampled_from("theanrisoing ▁  \n.,0é漢😀\x7f"), max_size=80) | st.text(max_size=40), min_size=1, max_size=5))
def test_against_the_library(texts):
    want = LIBRARY.encode(texts)
    assert encode(texts) == want and decode(want) == LIBRARY.decode(want)


def test_strings_of_pieces():
    draw, names = random.Random(3), [LIBRARY.id_to_piece(i) for i in range(3, 32_000)]
    texts = ["".join(draw.choice(names) for _ in range(draw.randint(0, 60))) for _ in range(2_000)]
    texts.append("".join(draw.choice("theanrisoi") for _ in range(30_000)))  # one long word
    assert encode(texts) == LIBRARY.encode(texts)


def test_words_forgotten_and_learned_again(monkeypatch):
    monkeypatch.setattr(pieces, "KEPT_WORDS", 5)
    codec = pieces.Codec(MODEL)
    for text in ("one two three four five six seven", "one eight", "two two"):
        assert encode([text], codec) == LIBRARY.encode([text])


@settings(max_examples=200, deadline=None)
@given(st.lists(st.integers(0, 300) | st.sampled_from([259, 28705, 264, 1318]), max_size=12))
def test_any_ids(ids):
    assert decode([ids]) == LIBRARY.decode([ids])


def test_null_lists_null_ids_and_ids_outside_the_model():
    assert decode([None, [264, None, 264], []]) == ["", "a a", ""]
    with pytest.raises(ValueError):
        decode([[32_000]])


def test_models_that_change_texts_are_refused():
    with pytest.raises(ValueError):
        pieces.Codec(MODEL.replace(b"identity\x12\x00\x18\x01 \x00", b"identity\x12\x00\x18\x01 \x01"))


def test_tables(spark, docs, no_docs, rows):
    frame = docs.withColumnRenamed("kept", "ids")  # an extra column with the name of the result gives way
    found = pieces.encode_texts(frame, MODEL)
    assert found.columns == ["doc_id", "lang", "source", "n_chars", "score", "ids"]
    want = sorted((str(r[0]), LIBRARY.encode(r[1] or "")) for r in rows)
    assert sorted((str(r.doc_id), list(r.ids)) for r in found.collect()) == want
    back = pieces.decode_ids(found, MODEL)
    digest = lambda text: hashlib.sha256(text.encode()).hexdigest()
    assert sorted((str(r.doc_id), digest(r.text)) for r in back.collect()) == sorted(
        (str(r[0]), digest(LIBRARY.decode(LIBRARY.encode(r[1] or "")))) for r in rows
    )
    once = pieces.round_trip(frame, MODEL).select("doc_id", "lang", "source", "n_chars", "score", "ids", "text")
    assert sorted((str(r.doc_id), list(r.ids)) for r in once.collect()) == want
    assert sorted((str(r.doc_id), r.text) for r in once.collect()) == sorted((str(r.doc_id), r.text) for r in back.collect())
    assert pieces.decode_ids(pieces.encode_texts(no_docs, MODEL), MODEL).collect() == []
