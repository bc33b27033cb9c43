"""Vector bin packing of examples into training sequences, by the dot-product heuristic."""

from __future__ import annotations

import os
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from casewright.llm.common import steps, whole

KEPT_PARTS = 300_000  # parts of words whose ids a worker remembers, some 50 MB


@dataclass(frozen=True)
class Limits:
    """What a sequence holds at most: tokens, pieces, and tokens that bear loss."""

    tokens: int = 2048
    segments: int = 256
    loss: int = 2048


@dataclass(frozen=True)
class Piece:
    item: int
    start: int
    end: int
    free: int
    """Tokens of the item before this place bear no loss."""

    @property
    def length(self) -> int:
        return self.end - self.start

    @property
    def loss(self) -> int:
        return max(0, self.end - max(self.start, self.free))

    def cut(self, length: int) -> tuple[Piece, Piece]:
        middle = self.start + length
        return Piece(self.item, self.start, middle, self.free), Piece(self.item, middle, self.end, self.free)

    def within(self, tokens: int, loss: int) -> int:
        """The most tokens from its start that fit."""
        return min(tokens, self.length, max(0, self.free - self.start) + loss)


class _Pool:
    """Pieces still to be placed, their demands as arrays."""

    def __init__(self, limits: Limits) -> None:
        self.scale = np.array([limits.tokens, limits.segments, max(1, limits.loss)], dtype=np.float64)
        self.pieces: list[Piece | None] = []
        self.need = np.zeros((64, 3))
        self.used = 0
        self.left = 0

    def add(self, piece: Piece) -> None:
        if self.used == len(self.need):
            self.need = np.concatenate([self.need, np.zeros_like(self.need)])
        self.need[self.used] = piece.length, 1, piece.loss
        self.pieces.append(piece)
        self.used += 1
        self.left += 1

    def take(self, room: np.ndarray, whole: bool) -> Piece | None:
        """The piece whose demand has the largest dot product with the room; ``whole``: of those that fit."""
        need = self.need[: self.used]
        score = need @ (room / self.scale / self.scale)
        fits = need[:, 0] > 0
        if whole:
            fits &= (need <= room).all(axis=1)
        score[~fits] = -1
        place = int(score.argmax()) if len(score) else -1
        if place < 0 or score[place] < 0:
            return None
        piece, self.pieces[place] = self.pieces[place], None
        self.need[place] = 0
        self.left -= 1
        if self.used > 256 and self.left < self.used // 2:
            kept = [p for p in self.pieces if p is not None]
            self.pieces, self.used, self.left = [], 0, 0
            for p in kept:
                self.add(p)
        return piece


def pack(lengths: np.ndarray, free: np.ndarray, limits: Limits) -> Iterator[list[Piece]]:
    """Sequences of pieces that hold each token of each item once.

    A sequence takes, again and again, the piece whose demand in tokens, segments and loss-bearing tokens has the
    largest dot product with the room that is left; when none fits, the best one is cut to fill it. A sequence that
    cannot be filled, because a limit other than tokens is reached or nothing is left, is cut back to a power of two,
    which needs no padding; what was cut off is placed again.
    """
    if limits.tokens < 1 or limits.segments < 1 or limits.loss < 1:
        raise ValueError("limits must be positive")
    pool, full = _Pool(limits), np.array([limits.tokens, limits.segments, limits.loss], dtype=np.float64)
    for item, (length, bare) in enumerate(zip(lengths.tolist(), free.tolist(), strict=True)):
        rest = Piece(item, 0, length, bare)
        while rest.within(limits.tokens, limits.loss) == limits.tokens:
            first, rest = rest.cut(limits.tokens)
            yield [first]
        if rest.length:
            pool.add(rest)
    while pool.left:
        placed, room = [], full.copy()
        while room[0] > 0 and room[1] >= 1 and (piece := pool.take(room, True)):
            placed.append(piece)
            room -= (piece.length, 1, piece.loss)
        if room[0] > 0 and room[1] >= 1 and (piece := pool.take(room, False)):
            first, rest = piece.cut(piece.within(int(room[0]), int(room[2])))
            if first.length:
                placed.append(first)
                room[0] -= first.length
            if rest.length:
                pool.add(rest)
        if room[0] > 0:
            filled = limits.tokens - int(room[0])
            excess = filled - (1 << (filled.bit_length() - 1))
            while excess and placed[-1].length <= excess:
                excess -= placed[-1].length
                pool.add(placed.pop())
            if excess:
                last = placed.pop()
                first, rest = last.cut(last.length - excess)
                placed.append(first)
                pool.add(rest)
        yield placed


#: Words of these characters alone are cut as the vocabulary cuts them: runs of letters, single digits, runs of marks.
#: Left out are apostrophes (contractions), ``<`` (special tokens) and what normalisation could change or compose.
LATIN = r"A-Za-z\x{C0}-\x{D6}\x{D8}-\x{F6}\x{F8}-\x{12F}\x{131}-\x{17F}"
PLAIN_WORD = rf"^[\x21-\x26\x28-\x3B\x3D-\x7E{LATIN}\x{{D7}}\x{{F7}}]+$"
PART = rf"([{LATIN}]+|[0-9]|[^{LATIN}0-9]+)"


def _gather(starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """Places of several runs, one after the other."""
    return np.repeat(starts - (np.cumsum(sizes) - sizes), sizes) + np.arange(sizes.sum())


class Words:
    """Token ids of texts, each distinct part of a word encoded once and remembered for a while.

    The vocabulary drops white space and never joins what stands on both sides of it, so a text's ids are those of its
    words; plain words are cut further, as the vocabulary's own rule cuts them, and share their parts.
    """

    def __init__(self, vocabulary: str) -> None:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # a task has one core
        import public_tokenizers
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(public_tokenizers.path(vocabulary))
        vocab = self.tokenizer.get_vocab()
        self.closes = np.zeros(max(vocab.values()) + 1, dtype=bool)  # ids that end a part
        self.closes[[i for token, i in vocab.items() if token.endswith("</w>")]] = True
        self._forget()

    def _forget(self) -> None:
        self.known: dict[str, int] = {}
        self.flat = np.zeros(0, dtype=np.uint32)
        self.starts = np.zeros(0, dtype=np.int64)
        self.sizes = np.zeros(0, dtype=np.int64)

    def _learn(self, parts: list[str], joined: bool) -> None:
        """Encode new parts, plain ones together: each ends at the one id that closes it."""
        new = [p for p in parts if p not in self.known]
        if not new:
            return
        if joined:
            lines = [" ".join(new[at : at + 2000]) for at in range(0, len(new), 2000)]
            found = [np.array(e.ids, dtype=np.uint32) for e in self.tokenizer.encode_batch_fast(lines, add_special_tokens=False)]
            ids = np.concatenate(found)
            ends = np.flatnonzero(self.closes[ids]) + 1
            if len(ends) != len(new):
                raise AssertionError("the vocabulary cuts plain words differently")
            sizes = np.diff(np.concatenate([[0], ends]))
        else:
            found = [np.array(e.ids, dtype=np.uint32) for e in self.tokenizer.encode_batch_fast(new, add_special_tokens=False)]
            ids, sizes = np.concatenate(found), np.array([len(f) for f in found], dtype=np.int64)
        self.known.update(zip(new, range(len(self.sizes), len(self.sizes) + len(new)), strict=True))
        self.starts = np.concatenate([self.starts, len(self.flat) + np.cumsum(sizes) - sizes])
        self.sizes = np.concatenate([self.sizes, sizes])
        self.flat = np.concatenate([self.flat, ids])

    def _parts_of(self, words: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Remembered parts of distinct words, in order, and how many each word has."""
        plain = pc.match_substring_regex(words, PLAIN_WORD).to_numpy(zero_copy_only=False)
        lists = pc.split_pattern(pc.replace_substring_regex(pc.ascii_lower(words.filter(pa.array(plain))), PART, r"\1 "), " ")
        cut = pc.list_value_length(lists).to_numpy(zero_copy_only=False).astype(np.int64)
        flat = lists.flatten()  # with an empty one after each word
        coded = flat.filter(pc.not_equal(flat, "")).dictionary_encode()
        shared = coded.dictionary.to_pylist()
        others = words.filter(pa.array(~plain)).to_pylist()
        if len(self.known) > KEPT_PARTS:
            self._forget()
        self._learn(shared, True)
        self._learn(["\n" + w for w in others], False)  # apart from the plain: their case counts
        known = self.known
        slots = np.fromiter(map(known.__getitem__, shared), dtype=np.int64, count=len(shared))
        counts = np.ones(len(words), dtype=np.int64)
        counts[plain] = cut - 1
        parts = np.empty(int(counts.sum()), dtype=np.int64)
        starts = np.cumsum(counts) - counts
        indices = coded.indices.to_numpy(zero_copy_only=False)
        parts[_gather(starts[plain], counts[plain])] = slots[indices] if len(slots) else indices
        parts[starts[~plain]] = [known["\n" + w] for w in others]
        return parts, counts

    def encode(self, texts: pa.Array, end: int | None) -> tuple[np.ndarray, np.ndarray]:
        """All ids, each text's followed by ``end``, and the number of ids of each text."""
        lists = pc.ascii_split_whitespace(texts)
        words_until = np.cumsum(pc.list_value_length(lists).to_numpy(zero_copy_only=False)).astype(np.int64)
        coded = lists.flatten().dictionary_encode()
        parts, counts = self._parts_of(coded.dictionary)
        codes = coded.indices.to_numpy(zero_copy_only=False).astype(np.int64)
        # ids of each distinct word, then of all words
        part_sizes = self.sizes[parts]
        of_words = self.flat[_gather(self.starts[parts], part_sizes)]
        until = np.concatenate([[0], np.cumsum(part_sizes)])
        part_ends = np.cumsum(counts)
        sizes = until[part_ends] - until[part_ends - counts]
        if end is not None:
            of_words = np.append(of_words, np.uint32(end))
            sizes = np.append(sizes, 1)
            codes = np.insert(codes, words_until, len(sizes) - 1)
            words_until = words_until + np.arange(1, len(words_until) + 1)
        starts = np.cumsum(sizes) - sizes
        many = sizes[codes]
        ids = of_words[_gather(starts[codes], many)].astype("<u4")
        upto = np.concatenate([[0], np.cumsum(many)])
        return ids, np.diff(np.concatenate([[0], upto[words_until]]))


@lru_cache(maxsize=1)
def words_for(vocabulary: str) -> Words:
    """One encoder for all tasks of a worker process; what it remembers changes its speed alone."""
    return Words(vocabulary)


def pack_texts(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    prompt_col: str | None = None,
    vocabulary: str = "word_bpe_49k.json",
    end: int | None = 1,
    limits: Limits = Limits(),
) -> DataFrame:
    """One row per piece: ``doc_id, start, length, token_ids, doc_tokens, sequence_id, offset``.

    A document's ids are those of its prompt (which bear no loss), its text, and ``end``. ``token_ids`` are the
    piece's ids as little-endian unsigned 32-bit numbers. Sequences hold at most what ``limits`` say and are 2048
    tokens or a power of two long, so they need no padding; pieces of a sequence follow each other from offset 0.

    Rows are packed where they are read, some megabytes of text at a time: nothing is shuffled, memory is bounded but
    for a single long text, and a lost task packs the same rows again. Sequence ids are unique, and repeat as long as
    the input is split alike. Null and empty texts consist of ``end`` alone; without an end they have no piece.
    Repeated rows are packed each; null ids stay null; an empty table gives an empty result.
    """
    chosen = docs.select(
        F.col(id_col).alias("doc_id"), whole(text_col).alias("text"), (whole(prompt_col) if prompt_col else F.lit("")).alias("prompt")
    )
    kind = chosen.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words, sequence = words_for(vocabulary), TaskContext.get().partitionId() << 33
        for batch in steps(batches, "text"):
            ids, sizes = words.encode(batch.column("text"), end)
            free = np.zeros(len(sizes), dtype=np.int64)
            if prompt_col:
                before, free = words.encode(batch.column("prompt"), None)
                cuts = np.cumsum(sizes)[:-1], np.cumsum(free)[:-1]
                both = zip(np.split(before, cuts[1]), np.split(ids, cuts[0]), strict=True)
                ids, sizes = np.concatenate([x for pair in both for x in pair]), sizes + free
            starts = np.cumsum(sizes) - sizes
            rows: list[tuple] = []
            for placed in pack(sizes, free, limits):
                offset = 0
                for piece in placed:
                    at = starts[piece.item]
                    rows.append((piece.item, piece.start, piece.length, ids[at + piece.start : at + piece.end].tobytes(), sequence, offset))
                    offset += piece.length
                sequence += 1
            if not rows:
                continue
            item, start, length, token_ids, sequences, offsets = zip(*rows, strict=True)
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("doc_id").take(pa.array(item)),
                    pa.array(start, pa.int64()),
                    pa.array(length, pa.int64()),
                    pa.array(token_ids, pa.binary()),
                    pa.array(sizes[list(item)], pa.int64()),
                    pa.array(sequences, pa.int64()),
                    pa.array(offsets, pa.int64()),
                ],
                ["doc_id", "start", "length", "token_ids", "doc_tokens", "sequence_id", "offset"],
            )

    schema = f"doc_id {kind}, start long, length long, token_ids binary, doc_tokens long, sequence_id long, offset long"
    return chosen.mapInArrow(run, schema)
