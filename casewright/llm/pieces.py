"""Encoding and decoding with a SentencePiece BPE model, by vectorised merge rounds."""

from __future__ import annotations

import codecs
import struct
from collections.abc import Iterable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from casewright.llm.common import steps

SPACE_MARK = "▁"
KEPT_WORDS = 200_000  # words whose ids a worker remembers, some 40 MB; beyond that it starts afresh
NO_PAIR = np.int64(2**62)
UNKNOWN_SURFACE = " ⁇ "
#: Kinds of pieces in a model file.
NORMAL, UNKNOWN, CONTROL, USER_DEFINED, UNUSED, BYTE = range(1, 7)


def _one_byte_each(error: UnicodeError) -> tuple[str, int]:
    return "�", error.start + 1


codecs.register_error("one-byte-each", _one_byte_each)


def _varint(data: bytes, at: int) -> tuple[int, int]:
    value = shift = 0
    while True:
        byte = data[at]
        value |= (byte & 127) << shift
        at, shift = at + 1, shift + 7
        if byte < 128:
            return value, at


def _fields(data: bytes) -> Iterator[tuple[int, bytes | int]]:
    """Field numbers and values of a serialised message."""
    at = 0
    while at < len(data):
        tag, at = _varint(data, at)
        if tag & 7 == 0:
            value, at = _varint(data, at)
        else:
            size = {1: 8, 5: 4}.get(tag & 7)
            if size is None:
                size, at = _varint(data, at)
            value, at = data[at : at + size], at + size
        yield tag >> 3, value


class Codec:
    """A BPE model with byte fallback that leaves texts as they are, but for spaces as marks and one put in front.

    Symbols are the ids of pieces; a character without a piece is its code point above them.
    """

    def __init__(self, model: bytes) -> None:
        pieces, trainer, normalizer = [], {}, {}
        for field, value in _fields(model):
            if field == 1:
                piece = dict(_fields(value))
                pieces.append((piece[1].decode(), struct.unpack("<f", piece.get(2, bytes(4)))[0], piece.get(3, NORMAL)))
            elif field in (2, 3):
                (trainer if field == 2 else normalizer).update(_fields(value))
        kinds = [kind for _, _, kind in pieces]
        if trainer.get(3) != 2 or not trainer.get(35):
            raise ValueError("not a BPE model with byte fallback")
        if normalizer.get(2) or normalizer.get(4, 1) or not normalizer.get(5, 1) or trainer.get(24):
            raise ValueError("the model changes texts in a way that is not supported")
        if USER_DEFINED in kinds or UNUSED in kinds:
            raise ValueError("user-defined and unused pieces are not supported")
        self.prefix = bool(normalizer.get(3, 1))
        self.symbols = len(pieces)
        self.width = self.symbols + 0x110000
        id_of = {text: i for i, (text, _, kind) in enumerate(pieces) if kind == NORMAL}
        self.byte_ids = np.zeros(256, dtype=np.int32)
        for i, (text, _, kind) in enumerate(pieces):
            if kind == BYTE:
                self.byte_ids[int(text[1:-1], 16)] = i

        self.char_symbols = np.arange(self.symbols, self.width, dtype=np.int32)
        for text, i in id_of.items():
            if len(text) == 1:
                self.char_symbols[ord(text)] = i
        self.char_symbols[ord(" ")] = self.char_symbols[ord(SPACE_MARK)]

        def symbol(text: str) -> int | None:
            found = id_of.get(text)
            return self.symbols + ord(text) if found is None and len(text) == 1 else found

        ranks = {score: rank for rank, score in enumerate(sorted({s for _, s, _ in pieces}, reverse=True))}
        pairs, neighbours = [], set()
        for text, i in id_of.items():
            neighbours.update(zip(text, text[1:], strict=False))
            for cut in range(1, len(text)):
                left, right = symbol(text[:cut]), symbol(text[cut:])
                if left is not None and right is not None:
                    pairs.append((left * self.width + right, ranks[pieces[i][1]], i))
        pairs.sort()
        self.pair_keys, self.pair_ranks, self.pair_merged = np.array(pairs or [(-1, 0, 0)], dtype=np.int64).T.copy()
        self.neighbour_keys = np.array(
            sorted(symbol(a) * self.width + symbol(b) for a, b in neighbours) or [-1], dtype=np.int64
        )
        # a text may be cut before each run of spaces if no piece goes on from another character to a mark
        self.cut_at_spaces = not any(b == SPACE_MARK and a != SPACE_MARK for a, b in neighbours)

        special = {CONTROL: lambda text: b"", UNKNOWN: lambda text: UNKNOWN_SURFACE.encode()}
        special[BYTE] = lambda text: bytes([int(text[1:-1], 16)])
        plain = lambda text: text.replace(SPACE_MARK, " ").encode()
        surfaces = [special.get(kind, plain)(text) for text, _, kind in pieces]
        # each piece once more without its first byte, for those that lead a text with a space
        self.surfaces = pa.array(surfaces + [surface[1:] for surface in surfaces], pa.large_binary())
        self.silent = np.array([kind == CONTROL for kind in kinds])
        self.leading = np.array([kind == NORMAL and text.startswith(SPACE_MARK) for text, _, kind in pieces])
        self._forget()

    def _forget(self) -> None:
        """Known words by number, and for each number where its ids begin in ``store`` and how many they are."""
        self.known: dict[str, int] = {}
        self.store, self.before, self.sizes = (np.zeros(0, dtype=kind) for kind in (np.int32, np.int64, np.int64))

    def _learn(self, words: list[str]) -> None:
        ids, counts = self.encode_words(words)
        self.known.update(zip(words, range(len(self.known), len(self.known) + len(words)), strict=True))
        self.before = np.append(self.before, len(self.store) + np.cumsum(counts) - counts)
        self.sizes, self.store = np.append(self.sizes, counts), np.append(self.store, ids)

    def _ranks(self, left: np.ndarray, right: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Rank and merged symbol of each pair; ``NO_PAIR`` for pairs that make no piece."""
        keys = left.astype(np.int64) * self.width + right
        at = np.minimum(np.searchsorted(self.pair_keys, keys), len(self.pair_keys) - 1)
        hit = self.pair_keys[at] == keys
        return np.where(hit, self.pair_ranks[at], NO_PAIR), self.pair_merged[at]

    def _rounds(self, sym: np.ndarray, word: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Symbols with no pair left and the words they belong to, in order.

        A round merges, in each word, the pair of the smallest rank wherever it stands, from the left, up to the
        first place where that makes a pair of no larger rank, which goes first. Words without a pair drop out.
        """
        place = np.arange(len(sym))
        done: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        # rank and merged symbol of the pair that starts at each place
        rank, merged = self._ranks(sym, np.append(sym[1:], -1))
        rank[np.append(word[1:] != word[:-1], True)] = NO_PAIR
        while len(sym):
            starts = np.flatnonzero(np.concatenate([[True], word[1:] != word[:-1]]))
            sizes = np.diff(np.append(starts, len(sym)))
            best = np.repeat(np.minimum.reduceat(rank, starts), sizes)
            live = best < NO_PAIR
            if not live.all():
                done.append((place[~live], sym[~live], word[~live]))
                place, sym, word, rank, merged, best = (a[live] for a in (place, sym, word, rank, merged, best))
                if not len(sym):
                    break
            at = np.flatnonzero(rank == best)
            # of places that overlap, the first, third, ...
            order = np.arange(len(at))
            fresh = np.concatenate([[True], np.diff(at) != 1])
            at = at[(order - np.maximum.accumulate(np.where(fresh, order, 0))) % 2 == 0]
            new, owner, limit = merged[at], word[at], best[at]

            before = np.where(at > 0, sym[at - 1], -1)
            joined = np.flatnonzero(np.diff(at) == 2) + 1
            before[joined] = new[joined - 1]
            left, left_merged = self._ranks(before, new)
            left[(at == 0) | (word[at - 1] != owner)] = NO_PAIR
            following = np.minimum(at + 2, len(sym) - 1)
            right, right_merged = self._ranks(new, sym[following])
            right[(at + 2 >= len(sym)) | (word[following] != owner)] = NO_PAIR
            urgent = (left <= limit) | (right <= limit)
            if urgent.any():
                earlier = np.cumsum(urgent) - urgent
                first = np.concatenate([[True], owner[1:] != owner[:-1]])
                kept = earlier == np.maximum.accumulate(np.where(first, earlier, 0))
                at, new, left, left_merged, right, right_merged = (
                    a[kept] for a in (at, new, left, left_merged, right, right_merged)
                )

            sym[at] = new
            stays = np.ones(len(sym), dtype=bool)
            stays[at + 1] = False
            place, sym, word, rank, merged = (a[stays] for a in (place, sym, word, rank, merged))
            at = at - np.arange(len(at))
            rank[at], merged[at] = right, right_merged
            # where the next place was merged as well, the pair is the one on that one's left
            inner = at > 0
            rank[at[inner] - 1], merged[at[inner] - 1] = left[inner], left_merged[inner]
        if not done:
            return sym, word
        places, syms, words = (np.concatenate(parts) for parts in zip(*done, strict=True))
        order = np.argsort(places, kind="stable")
        return syms[order], words[order]

    def encode_words(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all words, and the number of ids of each; words are any texts, marked by spaces."""
        points = np.frombuffer("".join(words).encode("utf-32-le"), dtype=np.uint32)
        sym = self.char_symbols[points]
        word = np.repeat(np.arange(len(words)), [len(w) for w in words])
        if not len(sym):
            return np.zeros(0, dtype=np.int32), np.zeros(len(words), dtype=np.int64)
        # neighbours that no piece holds side by side are never merged: cut there
        keys = sym[:-1].astype(np.int64) * self.width + sym[1:]
        at = np.minimum(np.searchsorted(self.neighbour_keys, keys), len(self.neighbour_keys) - 1)
        cut = (self.neighbour_keys[at] != keys) | (word[1:] != word[:-1])
        part = np.concatenate([[0], np.cumsum(cut)])
        home = word[np.concatenate([[0], np.flatnonzero(cut) + 1])]
        sym, part = self._rounds(sym, part)
        word = home[part]

        strange = sym >= self.symbols
        points = sym - self.symbols
        bytes_each = np.where(strange, 1 + (points >= 0x80) + (points >= 0x800) + (points >= 0x10000), 1)
        ids = np.repeat(sym, bytes_each).astype(np.int32)
        spelled = "".join(map(chr, points[strange].tolist())).encode()
        ids[np.repeat(strange, bytes_each)] = self.byte_ids[np.frombuffer(spelled, dtype=np.uint8)]
        counts = np.bincount(word, weights=bytes_each, minlength=len(words)).astype(np.int64)
        return ids, counts

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """All ids of all texts, and the number of ids of each; a null text is empty."""
        texts = pc.fill_null(texts, "").cast(pa.large_string())
        if self.prefix:
            mark = pc.if_else(pc.greater(pc.binary_length(texts), 0), pa.scalar(" ", pa.large_string()), "")
            texts = pc.binary_join_element_wise(mark, texts, pa.scalar("", pa.large_string()))
        _, ends, data = texts.buffers()
        ends = np.frombuffer(ends, dtype=np.int64)[texts.offset : texts.offset + len(texts) + 1]
        if ends[-1] == ends[0]:
            return np.zeros(0, dtype=np.int32), np.zeros(len(texts), dtype=np.int64)
        body = np.frombuffer(data, dtype=np.uint8)[: ends[-1]]
        begins = np.zeros(len(body), dtype=bool)
        if self.cut_at_spaces:
            space = body == 32
            begins[1:] = space[1:] & ~space[:-1]
            after = np.flatnonzero(begins[3:]) + 3  # a mark in the text itself is one with the spaces after it
            mark = np.frombuffer(SPACE_MARK.encode(), dtype=np.uint8)
            begins[after[(body[after - 3] == mark[0]) & (body[after - 2] == mark[1]) & (body[after - 1] == mark[2])]] = False
        begins[: ends[0]] = False
        begins[ends[:-1][ends[:-1] < ends[1:]]] = True
        starts = np.flatnonzero(begins)
        words = pa.LargeStringArray.from_buffers(
            len(starts), pa.py_buffer(np.append(starts, ends[-1]).astype(np.int64)), data
        ).dictionary_encode()
        spelled = words.dictionary.to_pylist()
        if len(self.known) > KEPT_WORDS:
            self._forget()
        unseen = [w for w in spelled if w not in self.known]
        if unseen:
            self._learn(unseen)
        number = np.array([self.known[w] for w in spelled])[words.indices.to_numpy()]
        each, before = self.sizes[number], self.before[number]
        total = np.concatenate([[0], np.cumsum(each)])
        ids = self.store[np.repeat(before - total[:-1], each) + np.arange(total[-1])]
        places = total[np.searchsorted(starts, ends)]
        return ids, np.diff(places)

    def decode(self, lists: pa.Array) -> pa.Array:
        """The text of each list of ids.

        One leading space goes if the model puts one in front. Control ids are silent, the unknown id is a double
        question mark between spaces, bytes that are no UTF-8 become one replacement character each. A null list is
        empty, null ids are skipped; ids outside the model raise an error.
        """
        lists = pc.fill_null(lists, pa.scalar([], lists.type))
        counts = pc.list_value_length(lists).to_numpy(zero_copy_only=False)
        flat = lists.flatten()
        if flat.null_count:
            filled = pc.is_valid(flat).to_numpy(zero_copy_only=False)
            before = np.concatenate([[0], np.cumsum(filled)])
            ends = np.concatenate([[0], np.cumsum(counts)])
            counts, flat = before[ends[1:]] - before[ends[:-1]], flat.drop_null()
        ids = flat.to_numpy(zero_copy_only=False).astype(np.int64)
        if len(ids) and (ids.min() < 0 or ids.max() >= self.symbols):
            raise ValueError("an id is not of this model")
        ends = np.concatenate([[0], np.cumsum(counts)])
        if self.prefix and len(ids):
            loud = np.append(np.flatnonzero(~self.silent[ids]), len(ids))
            first = loud[np.searchsorted(loud, ends[:-1])]
            first = first[first < ends[1:]]
            ids[first[self.leading[ids[first]]]] += self.symbols
        parts = pa.LargeListArray.from_arrays(pa.array(ends, pa.int64()), self.surfaces.take(pa.array(ids)))
        joined = pc.binary_join(parts, pa.scalar(b"", pa.large_binary()))
        try:
            return joined.cast(pa.large_string()).cast(pa.string())
        except pa.ArrowInvalid:
            return pa.array([b.decode("utf-8", errors="one-byte-each") for b in joined.to_pylist()], pa.string())


@lru_cache(maxsize=2)
def codec(model: bytes) -> Codec:
    return Codec(model)


def read_model(path: str) -> bytes:
    """A model file, read once by the driver and sent to the workers with the function (some 0.5 MB)."""
    with open(path, "rb") as file:
        model = file.read()
    codec(model)  # refuses a model that is not supported before any work starts
    return model


def _replaced(df: DataFrame, column: str, made: dict[str, T.DataType], function) -> DataFrame:
    """The table with the columns ``made`` in place of ``column``; ``function`` yields them with the rows they belong to."""
    others = [f for f in df.schema.fields if f.name != column and f.name not in made]
    source = df.select(*[f"`{f.name}`" for f in others], f"`{column}`")
    schema = T.StructType([*others, *[T.StructField(name, kind) for name, kind in made.items()]])

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for columns, rows in function(batch):
                yield pa.RecordBatch.from_arrays([*[rows.column(f.name) for f in others], *columns], names=schema.names)

    return source.mapInArrow(run, schema)


def _lists(ids: np.ndarray, counts: np.ndarray) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(counts)]), pa.int32()), pa.array(ids))


def encode_texts(df: DataFrame, model: bytes, text_col: str = "text", ids_col: str = "ids") -> DataFrame:
    """The table with ``ids_col``, the ids of each whole text, in place of ``text_col``.

    Words (a run of spaces and what follows up to the next) are encoded once each: a worker keeps those it has seen.
    Where the model's pieces go on over spaces, a text is one word. A null or empty text has no ids. Repeated rows come
    back as often; an empty table gives an empty one; other columns stay, one named ``ids_col`` gives way.
    """

    def encoded(batch: pa.RecordBatch):
        for part in steps([batch], text_col):
            yield [_lists(*codec(model).encode(part.column(text_col)))], part

    return _replaced(df, text_col, {ids_col: T.ArrayType(T.IntegerType())}, encoded)


def decode_ids(df: DataFrame, model: bytes, ids_col: str = "ids", text_col: str = "text") -> DataFrame:
    """The table with ``text_col``, the text of each list of ids, in place of ``ids_col``; see ``Codec.decode``.

    Other columns stay, one named ``text_col`` gives way.
    """

    def decoded(batch: pa.RecordBatch):
        yield [codec(model).decode(batch.column(ids_col))], batch

    return _replaced(df, ids_col, {text_col: T.StringType()}, decoded)


def round_trip(df: DataFrame, model: bytes, text_col: str = "text", ids_col: str = "ids") -> DataFrame:
    """The table with ``ids_col``, the ids of each text, and ``text_col``, what those ids decode to, in one pass.

    As ``encode_texts`` and ``decode_ids`` one after the other, without sending the ids to a second worker.
    """

    def both(batch: pa.RecordBatch):
        for part in steps([batch], text_col):
            lists = _lists(*codec(model).encode(part.column(text_col)))
            yield [lists, codec(model).decode(lists)], part

    return _replaced(df, text_col, {ids_col: T.ArrayType(T.IntegerType()), text_col: T.StringType()}, both)
