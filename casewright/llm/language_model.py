"""Language-model scores from a log-frequency Bloom filter of n-gram counts (Talbot and Osborne, 2007)."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from casewright.llm.common import mix, rekeyed, remainder, steps, whole, words_of, written
from casewright.session import cut_lineage

END = ""  # the token after each text, and the context of its first word: no word is empty
SEED = 42  # of Spark's xxhash64
PROBES = 3
BITS_PER_ENTRY = 6
GROUP_BYTES = 96 << 20  # of the filter, broadcast at once; a larger one goes out in several groups of segments
SMOOTHING = 0.1
TRUST = 8.0  # occurrences of a context at which its bigrams and the unigrams weigh alike
BUCKET_TOKENS = 1 << 21  # tokens whose bigrams are counted together, about
BUCKET_WORDS = 1 << 20  # words that fill a segment together, about
#: Least quantised counts kept of each order: all n-grams, those seen once too.
EVERY = {1: 1, 2: 1}


def expected_count(levels: np.ndarray) -> np.ndarray:
    """The middle of the counts that share a level: 0; 1; 2 to 3; 4 to 7; ..."""
    top = np.exp2(levels.astype(np.float64))
    return np.where(levels > 0, (top / 2 + top - 1) / 2, 0.0)


def word_hashes(words: list[str]) -> np.ndarray:
    return np.array([xxhash.xxh64_intdigest(w.encode(), SEED) for w in words], dtype=np.uint64)


def bigram_hashes(first: np.ndarray, second: np.ndarray) -> np.ndarray:
    """56 bits, the last byte is 0: enough to tell bigrams apart, and less to move."""
    with np.errstate(over="ignore"):
        return mix(mix(first * np.uint64(0x9E3779B97F4A7C15)) + second) & ~np.uint64(0xFF)


SEGMENTS = "ord int, bucket long, bits binary"


def squeeze(numbers: np.ndarray) -> bytes:
    """Numbers as compressed byte planes: the high bytes of small numbers take no room."""
    planes = numbers.view(np.uint8).reshape(len(numbers), numbers.itemsize).T
    return zstandard.ZstdCompressor(level=1).compress(planes.tobytes())


def expand(packed: bytes, kind: str) -> np.ndarray:
    planes = np.frombuffer(zstandard.ZstdDecompressor().decompress(packed), dtype=np.uint8)
    size = np.dtype(kind).itemsize
    return np.ascontiguousarray(planes.reshape(size, -1).T).view(kind).ravel()


def _places(hashes: np.ndarray, level: int, size: int | np.ndarray) -> Iterator[np.ndarray]:
    """Places of an n-gram's bits at one level, in a segment of ``size`` bits."""
    with np.errstate(over="ignore"):
        drawn = mix(hashes + np.uint64(level) * np.uint64(0xD6E8FEB86659FD93))
        step = (drawn >> np.uint64(20)) | np.uint64(1)
        for n in range(PROBES):
            yield (drawn + np.uint64(n) * step) % (np.uint64(size) if isinstance(size, int) else size)


def bucket_of(hashes: np.ndarray, width: int) -> np.ndarray:
    """The first ``width`` bits of the hashes."""
    return (hashes >> np.uint64(64 - width)).astype(np.int64)


def fill(hashes: np.ndarray, levels: np.ndarray, least: int) -> bytes:
    """A segment that holds each n-gram once for every level from ``least`` up to its own."""
    entries = int(np.maximum(levels.astype(np.int64) - least + 1, 0).sum())
    size = max(64, -(-entries * BITS_PER_ENTRY // 64) * 64)
    bits = np.zeros(size, dtype=bool)
    for level in range(least, int(levels.max(initial=0)) + 1):
        for place in _places(hashes[levels >= level], level, size):
            bits[place] = True
    return np.packbits(bits, bitorder="little").tobytes()


class CountFilter:
    """Some segments of the filter: each belongs to an order and to a bucket of hashes, and is sized by its entries.

    ``segments`` are ``(order, bucket, bits)``, ``widths`` the bits of a hash that choose the bucket of each order.
    """

    def __init__(self, segments: list[tuple[int, int, bytes]], widths: dict[int, int], least: dict[int, int]) -> None:
        self.widths, self.least = widths, least
        self.bits = np.frombuffer(b"".join(bits for _, _, bits in segments), dtype=np.uint8)
        self.start = {order: np.zeros(1 << width, dtype=np.uint64) for order, width in widths.items()}
        self.size = {order: np.zeros(1 << width, dtype=np.uint64) for order, width in widths.items()}
        at = 0
        for order, bucket, bits in segments:
            self.start[order][bucket], self.size[order][bucket] = at, 8 * len(bits)
            at += 8 * len(bits)

    def levels(self, hashes: np.ndarray, order: int, most: np.ndarray | None = None) -> np.ndarray:
        """Quantised counts: probed level by level until one is missing, or at ``most``. 0: not found, or of a segment
        that is not here."""
        bucket = bucket_of(hashes, self.widths[order])
        start, size = self.start[order][bucket], self.size[order][bucket]
        found, level = np.zeros(len(hashes), dtype=np.int64), self.least[order]
        open_ = np.flatnonzero(size > 0)
        while len(open_):
            if most is not None:
                open_ = open_[most[open_] >= level]
            held = np.ones(len(open_), dtype=bool)
            for place in _places(hashes[open_], level, size[open_]):
                place = place + start[open_]
                held &= (self.bits[place >> np.uint64(3)] >> (place & np.uint64(7)).astype(np.uint8)) & 1 == 1
            open_ = open_[held]
            found[open_] = level
            level += 1
        return found


def encode_chunks(docs: DataFrame, kind: str) -> DataFrame:
    """Texts as numbers: one row for some megabytes of text, with its own list of words, both compressed.

    ``chunk, words`` (one a line, the end last), ``codes`` of all tokens, ``sizes`` of the texts, ``ids`` and ``held``.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        chunk = TaskContext.get().partitionId() << 32
        for batch in steps(batches, "text"):
            words, counts = words_of(batch.column("text"))
            coded = words.dictionary_encode()
            codes, many = coded.indices.to_numpy(zero_copy_only=False), len(coded.dictionary)
            order = np.argsort(-np.bincount(codes, minlength=many), kind="stable")  # frequent words: small codes
            rank = np.empty(many, dtype=np.uint32)
            rank[order] = np.arange(many, dtype=np.uint32)
            listed = "\n".join([*coded.dictionary.take(pa.array(order)).to_pylist(), END])
            codes = np.insert(rank[codes], np.cumsum(counts), many).astype("<u4")
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array([chunk]),
                    pa.array([zstandard.ZstdCompressor(level=3).compress(listed.encode())], pa.binary()),
                    pa.array([squeeze(codes)], pa.binary()),
                    pa.array([squeeze((counts + 1).astype("<i8"))], pa.binary()),
                    pa.array([batch.column("doc_id").to_pylist()], pa.list_(batch.schema.field("doc_id").type)),
                    pa.array([batch.column("held").to_pylist()], pa.list_(pa.bool_())),
                ],
                ["chunk", "words", "codes", "sizes", "ids", "held"],
            )
            chunk += 1

    schema = f"chunk long, words binary, codes binary, sizes binary, ids array<{kind}>, held array<boolean>"
    return docs.mapInArrow(run, schema)


@dataclass(frozen=True)
class Chunk:
    words: list[str]
    codes: np.ndarray
    sizes: np.ndarray
    held: np.ndarray

    @staticmethod
    def read(batch: pa.RecordBatch, row: int) -> Chunk:
        get = {n: batch.column(n)[row].as_py() for n in ("words", "codes", "sizes", "held")}
        words = zstandard.ZstdDecompressor().decompress(get["words"]).decode().split("\n")
        return Chunk(words, expand(get["codes"], "<u4").astype(np.int64), expand(get["sizes"], "<i8"), np.array(get["held"], dtype=bool))

    @property
    def before(self) -> np.ndarray:
        """Codes of what stands before each token; texts follow the end of another."""
        return np.concatenate([[len(self.words) - 1], self.codes[:-1]])

    @property
    def learnt(self) -> np.ndarray:
        return np.repeat(~self.held, self.sizes)


def word_counts(chunks: DataFrame) -> DataFrame:
    """``chunk, code, word, n``: the words of each chunk and how often they occur in its texts to learn from."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in range(batch.num_rows):
                chunk = Chunk.read(batch, row)
                many = len(chunk.words)
                counts = np.bincount(chunk.codes[chunk.learnt], minlength=many).astype(np.int64)
                numbers = pa.array(np.full(many, batch.column("chunk")[row].as_py()))
                columns = [numbers, pa.array(np.arange(many, dtype=np.int32)), pa.array(chunk.words), pa.array(counts)]
                yield pa.RecordBatch.from_arrays(columns, ["chunk", "code", "word", "n"])

    return chunks.select("chunk", "words", "codes", "sizes", "held").mapInArrow(run, "chunk long, code int, word string, n long")


def packed_answers(known: DataFrame) -> DataFrame:
    """``chunk, answers``: the rows ``chunk, code, c`` of each chunk as a few compressed runs."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def packed(parts: list[list[np.ndarray]]) -> pa.RecordBatch:
            chunk, code, count = (np.concatenate(p) for p in zip(*parts, strict=True))
            order = np.lexsort((code, chunk))
            chunk, code, count = chunk[order], code[order].astype("<u4"), count[order].astype("<u8")
            cuts = np.flatnonzero(np.diff(chunk, prepend=chunk[0] - 1))
            runs = list(zip(cuts, np.append(cuts[1:], len(chunk)), strict=True))
            columns = [
                pa.array(chunk[cuts]),
                pa.array([squeeze(code[a:b]) for a, b in runs], pa.binary()),
                pa.array([squeeze(count[a:b]) for a, b in runs], pa.binary()),
            ]
            return pa.RecordBatch.from_arrays(columns, ["chunk", "codes", "counts"])

        parts: list[list[np.ndarray]] = []
        for batch in batches:
            if batch.num_rows:
                parts.append([batch.column(n).to_numpy() for n in ("chunk", "code", "c")])
            if sum(len(p[0]) for p in parts) > 1_000_000:
                yield packed(parts)
                parts = []
        if parts:
            yield packed(parts)

    runs = known.select("chunk", "code", "c").mapInArrow(run, "chunk long, codes binary, counts binary")
    return runs.groupBy("chunk").agg(F.collect_list(F.struct("codes", "counts")).alias("answers"))


def bigram_segments(chunks: DataFrame, tokens: int, least: int) -> tuple[DataFrame, int]:
    """``ord, bucket, bits``: the filter's segments for bigrams, and the bits of a hash that choose the segment.

    Bigrams are counted within chunks, and travel as sorted runs of a bucket of hashes, differences alone. There are
    as many buckets as keep each within some millions of bigrams; the task that counts a bucket fills its segment, so
    that counted bigrams are never written or moved.
    """
    width = max(6, (max(1, tokens) // BUCKET_TOKENS).bit_length())

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in range(batch.num_rows):
                chunk = Chunk.read(batch, row)
                learnt, many = chunk.learnt, len(chunk.words)
                if not learnt.any():
                    continue
                pairs, counts = np.unique(chunk.before[learnt] * many + chunk.codes[learnt], return_counts=True)
                own = word_hashes(chunk.words)
                hashes = bigram_hashes(own[pairs // many], own[pairs % many])
                order = np.argsort(hashes)
                hashes, counts = hashes[order], counts[order].astype("<u4")
                bucket = bucket_of(hashes, width)
                cuts = np.flatnonzero(np.diff(bucket, prepend=-1))
                ends = np.append(cuts[1:], len(bucket))
                runs = [(hashes[a:b] >> np.uint64(8), counts[a:b]) for a, b in zip(cuts, ends, strict=True)]
                columns = [
                    pa.array(bucket[cuts]),
                    pa.array([squeeze(np.diff(h, prepend=np.uint64(0)).astype("<u8")) for h, _ in runs], pa.binary()),
                    pa.array([squeeze(c) for _, c in runs], pa.binary()),
                ]
                yield pa.RecordBatch.from_arrays(columns, ["bucket", "steps", "counts"])

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def counted(bucket: int, runs: list[tuple[bytes, bytes]]) -> pa.RecordBatch:
            hashes = np.concatenate([np.cumsum(expand(h, "<u8")) for h, _ in runs])
            counts = np.concatenate([expand(c, "<u4") for _, c in runs]).astype(np.int64)
            order = np.argsort(hashes)
            hashes, counts = hashes[order], counts[order]
            first = np.flatnonzero(np.diff(hashes, prepend=hashes[0] ^ np.uint64(1)))
            levels = np.floor(np.log2(np.add.reduceat(counts, first))).astype(np.int32) + 1  # exact below 2 ** 48
            bits = fill(hashes[first] << np.uint64(8), levels, least)
            return pa.RecordBatch.from_arrays(
                [pa.array([2], pa.int32()), pa.array([bucket]), pa.array([bits], pa.binary())], ["ord", "bucket", "bits"]
            )

        own, runs = None, []
        for batch in batches:
            for bucket, steps_, counts in zip(*(batch.column(n).to_pylist() for n in ("bucket", "steps", "counts")), strict=True):
                if bucket != own and runs:
                    yield counted(own, runs)
                    runs = []
                own = bucket
                runs.append((steps_, counts))
        if runs:
            yield counted(own, runs)

    dealt = chunks.select("words", "codes", "sizes", "held").mapInArrow(deal, "bucket long, steps binary, counts binary")
    met = dealt.repartition(min(1 << width, 4096), "bucket").sortWithinPartitions("bucket")
    return met.mapInArrow(count, SEGMENTS), width


def unigram_segments(counts: DataFrame, distinct: int, least: int) -> tuple[DataFrame, int]:
    """``ord, bucket, bits``: the filter's segments for words ``h, level``, and the bits of a hash that choose one."""
    width = max(6, (max(1, distinct) // BUCKET_WORDS).bit_length())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def segment(bucket: int, parts: list[tuple[np.ndarray, np.ndarray]]) -> pa.RecordBatch:
            hashes, levels = (np.concatenate(part) for part in zip(*parts, strict=True))
            return pa.RecordBatch.from_arrays(
                [pa.array([1], pa.int32()), pa.array([bucket]), pa.array([fill(hashes, levels, least)], pa.binary())],
                ["ord", "bucket", "bits"],
            )

        own, parts = None, []
        for batch in batches:
            hashes, levels = batch.column("h").to_numpy().view(np.uint64), batch.column("level").to_numpy()
            buckets = bucket_of(hashes, width)
            for bucket in np.unique(buckets).tolist():
                if bucket != own and parts:
                    yield segment(own, parts)
                    parts = []
                own = bucket
                parts.append((hashes[buckets == bucket], levels[buckets == bucket]))
        if parts:
            yield segment(own, parts)

    bucket = F.shiftrightunsigned("h", 64 - width)
    dealt = counts.withColumn("bucket", bucket).repartition(min(1 << width, 4096), "bucket").sortWithinPartitions("bucket")
    return dealt.select("h", "level").mapInArrow(run, SEGMENTS), width


def segment_groups(segments: DataFrame, limit: int = GROUP_BYTES) -> list[tuple[int, int]]:
    """Runs of segments, in order of order and bucket, that hold ``limit`` bytes at most each, as first and last place.

    A segment's place is its bucket, those of bigrams after those of words. One row a segment comes to the driver.
    """
    groups: list[list[int]] = []
    size = 0
    for row in segments.select("place", F.length("bits").alias("size")).orderBy("place").collect():
        if groups and size + row["size"] <= limit:
            groups[-1][1], size = row["place"], size + row["size"]
        else:
            groups.append([row["place"], row["place"]])
            size = row["size"]
    return [(first, last) for first, last in groups]


@dataclass(frozen=True)
class Pairs:
    """The distinct pairs of neighbours in a chunk."""

    first: np.ndarray
    second: np.ndarray
    which: np.ndarray

    @staticmethod
    def of(chunk: Chunk) -> Pairs:
        many = len(chunk.words)
        pairs, which = np.unique(chunk.before * many + chunk.codes, return_inverse=True)
        return Pairs(pairs // many, pairs % many, which)


def _probed(chunks: DataFrame, shared) -> DataFrame:
    """``chunk, alone, together``: the levels of each chunk's words and pairs in the segments that are broadcast."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = CountFilter(*shared.value)
        for batch in batches:
            for row in range(batch.num_rows):
                chunk = Chunk.read(batch, row)
                own, pairs = word_hashes(chunk.words), Pairs.of(chunk)
                found = model.levels(own, 1), model.levels(bigram_hashes(own[pairs.first], own[pairs.second]), 2)
                packed = [pa.array([squeeze(levels.astype("<u1"))], pa.binary()) for levels in found]
                yield pa.RecordBatch.from_arrays([batch.column("chunk").slice(row, 1), *packed], ["chunk", "alone", "together"])

    return chunks.select("chunk", "words", "codes", "sizes", "held").mapInArrow(run, "chunk long, alone binary, together binary")


def lm_scores(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    folds: int = 10,
    group_bytes: int = GROUP_BYTES,
    least: dict[int, int] = EVERY,
) -> DataFrame:
    """``doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score`` for every row.

    The model learns from rows whose crc32(id) mod ``folds`` is not 0; tokens are the words, cut at ASCII white space
    and lower-cased A-Z, and an end. ``n_known`` and ``base_score`` use exact counts: each chunk of texts asks for the
    counts of its distinct words, joined by the word itself. ``score`` is the log10 probability under bigrams
    interpolated with unigrams, whose counts are found by probing the broadcast filter; a bigram's count is at most
    that of its words, which ends most probes early. ``least`` is the least quantised count that the model keeps of each
    order, by default all n-grams at every size: a filter of more than ``group_bytes`` is broadcast in groups of
    segments, each of which costs one more pass over the encoded texts, and what they hold is put together by chunk.

    Null and empty texts have the end alone. Repeated rows are learnt from and scored each; a null id counts as empty
    text in the fold. Without any row to learn from every base score is that of unseen tokens, log10 of 1. An empty
    table gives an empty result; other columns are ignored.
    """
    spark = docs.sparkSession
    chosen = docs.select(F.col(id_col).alias("doc_id"), whole(text_col).alias("text"), (remainder(id_col, folds) == 0).alias("held"))
    kind = chosen.schema["doc_id"].dataType.simpleString()
    chunks = cut_lineage(encode_chunks(chosen, kind))

    listed = word_counts(chunks)
    counts = written(listed.groupBy("word").agg(F.sum("n").alias("c")).filter("c > 0"), "word-counts")
    total, distinct = counts.agg(F.coalesce(F.sum("c"), F.lit(0)), F.count("*")).first()

    level = F.length(F.bin("c")).cast("int")  # exact 1 + floor(log2(c))
    words = counts.select(F.xxhash64("word").alias("h"), level.alias("level"))
    alone, narrow = unigram_segments(words, distinct, least[1])
    together, wide = bigram_segments(chunks, total, least[2])
    widths = {1: narrow, 2: wide}
    place = F.col("bucket") + F.when(F.col("ord") == 2, 1 << narrow).otherwise(0)
    segments = written(alone.unionByName(together).withColumn("place", place), "filter")
    # without any n-gram there is one group, of nothing
    groups = segment_groups(segments, group_bytes) or [(0, -1)]

    def broadcast(first: int, last: int):
        rows = segments.filter(F.col("place").between(first, last)).orderBy("place").collect()
        return spark.sparkContext.broadcast(([(r["ord"], r["bucket"], bytes(r["bits"])) for r in rows], widths, least))

    earlier = None
    for group in groups[:-1]:
        part = written(_probed(chunks, broadcast(*group)), "levels")
        earlier = part if earlier is None else earlier.unionByName(part)
    shared = broadcast(*groups[-1])

    known = listed.drop("n").join(counts.select(rekeyed(F.col("word")).alias("word"), "c"), "word")
    answers = packed_answers(known)
    # no chunk is without its end, but none of its tokens may be known
    asked = chunks.join(answers, "chunk", "left")
    if earlier is not None:
        levels = F.collect_list(F.struct("alone", "together")).alias("levels")
        asked = asked.join(earlier.groupBy("chunk").agg(levels), "chunk", "left")
    else:
        asked = asked.withColumn("levels", F.lit(None).cast("array<struct<alone:binary,together:binary>>"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = CountFilter(*shared.value)
        for batch in batches:
            for place in range(batch.num_rows):
                chunk = Chunk.read(batch, place)
                exact = np.zeros(len(chunk.words), dtype=np.int64)
                for run_ in batch.column("answers")[place].as_py() or ():
                    exact[expand(run_["codes"], "<u4")] = expand(run_["counts"], "<u8")
                parts = [
                    (expand(part["alone"], "<u1"), expand(part["together"], "<u1"))
                    for part in batch.column("levels")[place].as_py() or ()
                ]
                yield score_chunk(chunk, exact, batch.column("ids")[place].values, model, parts, total, distinct)

    schema = f"doc_id {kind}, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double"
    return asked.select("words", "ids", "held", "sizes", "codes", "answers", "levels").mapInArrow(run, schema)


def score_chunk(
    chunk: Chunk,
    exact: np.ndarray,
    ids: pa.Array,
    model: CountFilter,
    parts: list[tuple[np.ndarray, np.ndarray]],
    total: int,
    distinct: int,
) -> pa.RecordBatch:
    """Scores of a chunk's texts; ``parts`` are the levels of words and pairs found in other groups of segments."""
    codes, sizes = chunk.codes, chunk.sizes
    starts = np.cumsum(sizes) - sizes
    whole_mass = total + SMOOTHING * (distinct + 1)
    base = np.log10((exact + SMOOTHING) / whole_mass)

    own, pairs = word_hashes(chunk.words), Pairs.of(chunk)
    # each word and pair has one segment: where it is not, its level is 0
    levels = sum((alone for alone, _ in parts), model.levels(own, 1))
    seen = expected_count(levels)
    alone = (seen + SMOOTHING) / whole_mass
    first, second, which = pairs.first, pairs.second, pairs.which
    most = np.minimum(levels[first], levels[second])
    here = model.levels(bigram_hashes(own[first], own[second]), 2, most)
    together = expected_count(np.minimum(sum((pair for _, pair in parts), here), most))
    trust = seen[first] / (seen[first] + TRUST)
    share = np.minimum(1.0, together / np.maximum(seen[first], 1.0))
    smoothed = np.log10(np.minimum(1.0, trust * share + (1 - trust) * alone[second]))
    return pa.RecordBatch.from_arrays(
        [
            ids,
            pa.array(chunk.held),
            pa.array(sizes.astype(np.int64)),
            pa.array(np.add.reduceat((exact[codes] > 0).astype(np.int64), starts)),
            pa.array(np.full(len(sizes), total, dtype=np.int64)),
            pa.array(np.add.reduceat(base[codes], starts)),
            pa.array(np.add.reduceat(smoothed[which], starts)),
        ],
        ["doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"],
    )
