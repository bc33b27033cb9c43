"""Near copies by exact similarity of word shingles.

SimHash fingerprints searched by the general pigeonhole principle name the first pairs, MinHash bands (Broder, 1997)
those whose fingerprints lie further apart.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from casewright.llm.common import mix, steps, whole, words_of, written
from casewright.llm.components import connected_components, joined_components
from casewright.llm.language_model import word_hashes
from casewright.llm.simhash import fingerprints_of, near_links

#: Two sets that share 0.8 of their shingles miss each other in all bands at 3 in a million: (1 - 0.8 ** 5) ** 32.
BANDS, BAND_ROWS = 32, 5
FULL_KEY = 16  # sets of one key that are compared pair by pair
#: Sets of a fuller key that are compared with all others of the key, round by round; at last all that are left.
LEADERS = (1, 16, None)
LEADERS_A_TASK = 4096  # leaders of one key that one task compares
SKETCH_WORDS = 16  # 64-bit words of a set's parities
PAIRS_A_COPY = 256  # comparisons that one copy of a set's shingles serves
FACTORS = np.random.default_rng(5).integers(0, 2**63, BANDS * BAND_ROWS, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def shingle_sets(texts: pa.Array, size: int = 5) -> tuple[np.ndarray, np.ndarray]:
    """The hashes of each text's distinct shingles, sorted, text after text; and how many each text has.

    Words are cut at ASCII white space, A-Z lower-cased. A text of fewer than ``size`` words is one shingle.
    """
    words, counts = words_of(texts)
    coded = words.dictionary_encode()
    own = word_hashes(coded.dictionary.to_pylist())[coded.indices.to_numpy(zero_copy_only=False)]
    many = np.where(counts > 0, np.maximum(counts - size + 1, 1), 0)
    text = np.repeat(np.arange(len(counts)), many)
    ends = np.cumsum(counts)
    at = (ends - counts)[text] + np.arange(len(text)) - (np.cumsum(many) - many)[text]
    hashes = np.zeros(len(text), dtype=np.uint64)
    with np.errstate(over="ignore"):
        for step in range(size):
            inside = at + step < ends[text]
            further = mix(hashes * np.uint64(0x9E3779B97F4A7C15) + own[np.minimum(at + step, max(len(own) - 1, 0))])
            hashes = np.where(inside, further, hashes)
    order = np.lexsort((hashes, text))
    hashes = hashes[order]
    new = np.ones(len(text), dtype=bool)
    new[1:] = (hashes[1:] != hashes[:-1]) | (text[1:] != text[:-1])
    return hashes[new], np.bincount(text[new], minlength=len(counts))


def signatures(hashes: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """A number for each set, equal for equal sets; and its band keys, one column a band, for sets with shingles."""
    ids = np.zeros(len(sizes), dtype=np.uint64)
    filled = sizes > 0
    starts = (np.cumsum(sizes) - sizes)[filled]
    keys = np.zeros((int(filled.sum()), BANDS), dtype=np.uint64)
    if len(starts):
        with np.errstate(over="ignore"):
            ids[filled] = mix(np.add.reduceat(mix(hashes + np.uint64(1)), starts))
            for place, factor in enumerate(FACTORS):
                band = place // BAND_ROWS
                keys[:, band] = mix(keys[:, band] + np.minimum.reduceat(hashes * factor, starts) + np.uint64(place))
    return ids, keys


def parities(hashes: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """Whether an odd number of a set's hashes falls on each of 64 * ``SKETCH_WORDS`` places, a row of words a set.

    A hash that one of two sets lacks changes one place, so the places in which two sets differ never outnumber the
    hashes in which they differ: a bound that loses no pair.
    """
    words = np.zeros((len(sizes), SKETCH_WORDS), dtype=np.uint64)
    place = mix(hashes ^ np.uint64(0x5DEECE66D)) % np.uint64(64 * SKETCH_WORDS)
    at = np.repeat(np.arange(len(sizes)), sizes) * SKETCH_WORDS + (place >> np.uint64(6)).astype(np.int64)
    np.bitwise_xor.at(words.reshape(-1), at, np.uint64(1) << (place & np.uint64(63)))
    return words


def _described(docs: DataFrame, size: int) -> DataFrame:
    """``doc_id, body, set_id, size, fp, bands, sketch`` of every row of ``doc_id, text, body``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in steps(batches, "text"):
            hashes, sizes = shingle_sets(batch.column("text"), size)
            ids, keys = signatures(hashes, sizes)
            bands = pa.ListArray.from_arrays(
                pa.array(np.concatenate([[0], np.cumsum(np.where(sizes > 0, BANDS, 0))]).astype(np.int32)),
                pa.array(keys.ravel().view(np.int64)),
            )
            odd = parities(hashes, sizes).view(np.int64)
            sketch = pa.ListArray.from_arrays(pa.array(np.arange(len(sizes) + 1, dtype=np.int32) * SKETCH_WORDS), pa.array(odd.ravel()))
            fps = pa.array(fingerprints_of(batch.column("text"), size))
            columns = [batch.column("doc_id"), batch.column("body"), pa.array(ids.view(np.int64)), pa.array(sizes.astype(np.int64)), fps, bands, sketch]
            yield pa.RecordBatch.from_arrays(columns, ["doc_id", "body", "set_id", "size", "fp", "bands", "sketch"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.mapInArrow(run, f"doc_id {kind}, body string, set_id long, size long, fp long, bands array<long>, sketch array<long>")


def _sets(docs: DataFrame, size: int) -> DataFrame:
    """``set_id, shingles`` of every row, the shingles as sorted bytes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in steps(batches, "text"):
            hashes, sizes = shingle_sets(batch.column("text"), size)
            ids, _ = signatures(hashes, sizes)
            parts = [part.tobytes() for part in np.split(hashes, np.cumsum(sizes)[:-1])]
            yield pa.RecordBatch.from_arrays([pa.array(ids.view(np.int64)), pa.array(parts, pa.binary())], ["set_id", "shingles"])

    return docs.select("text").mapInArrow(run, "set_id long, shingles binary")


def _same(number: Column) -> Column:
    """The same number as a new expression; see ``common.rekeyed``."""
    return F.bitwise_not(F.bitwise_not(number))


def _verified(pairs: DataFrame, sets: DataFrame, least: float) -> DataFrame:
    """The distinct pairs ``a, b`` whose sets share ``least`` of their union or more.

    A set that many pairs name as ``a`` is sent once for every ``PAIRS_A_COPY`` of them, so they spread over tasks.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            near = np.zeros(batch.num_rows, dtype=bool)
            for row in range(batch.num_rows):
                mine = np.frombuffer(batch.column("mine")[row].as_buffer(), dtype=np.uint64)
                other = np.frombuffer(batch.column("other")[row].as_buffer(), dtype=np.uint64)
                both = int((other[np.minimum(np.searchsorted(other, mine), len(other) - 1)] == mine).sum())
                near[row] = both >= least * (len(mine) + len(other) - both) - 1e-9
            yield batch.select(["a", "b"]).filter(pa.array(near))

    asked = written(pairs.select("a", "b").distinct(), "pairs")
    copies = asked.groupBy("a").agg(F.ceil(F.count("*") / PAIRS_A_COPY).cast("int").alias("copies"))
    dealt = asked.join(copies.select(_same(F.col("a")).alias("a"), "copies"), "a")
    dealt = dealt.withColumn("copy", F.pmod(F.xxhash64("b"), F.col("copies")).cast("int")).drop("copies")
    other = dealt.join(sets.select(F.col("set_id").alias("b"), F.col("shingles").alias("other")), "b")
    mine = copies.join(sets.select(F.col("set_id").alias("a"), F.col("shingles").alias("mine")), "a")
    mine = mine.select("a", F.explode(F.sequence(F.lit(0), F.col("copies") - 1)).alias("copy"), "mine")
    met = other.join(mine, ["a", "copy"]).select("a", "b", "mine", "other")
    return written(met.mapInArrow(run, "a long, b long"), "near")


def _may_be_near(least: float) -> Column:
    """Whether the sets of ``a_size, a_sketch`` and ``b_size, b_sketch`` can share ``least`` of their union.

    They do exactly if they differ in at most ``(1 - least) / (1 + least)`` of both sizes.
    """
    differ = sum((F.bit_count(F.col("a_sketch")[i].bitwiseXOR(F.col("b_sketch")[i])) for i in range(SKETCH_WORDS)), F.lit(0))
    both = F.col("a_size") + F.col("b_size")
    near_sizes = F.least("a_size", "b_size") >= F.lit(least) * F.greatest("a_size", "b_size") - 1e-9
    return near_sizes & (differ <= both * F.lit((1 - least) / (1 + least)) + 1e-6)


def fingerprint_pairs(sets: DataFrame) -> DataFrame:
    """``a, b``: pairs of ``set_id, fp`` that connect all sets whose fingerprints are equal or differ in two bits or fewer.

    Of sets with one fingerprint each meets the smallest, so no group is expanded into its pairs.
    """
    low = written(sets.groupBy("fp").agg(F.min("set_id").alias("low")), "fingerprints")
    equal = sets.join(low.select(_same(F.col("fp")).alias("_fp"), "low"), F.col("fp") == F.col("_fp")).filter("set_id <> low")
    ends = [low.select(_same(F.col("fp")).alias(side), F.col("low").alias(f"{side}_low")) for side in "ab"]
    close = near_links(low.select("fp")).join(ends[0], "a").join(ends[1], "b").select("a_low", "b_low")
    pairs = equal.select(F.col("low").alias("a"), F.col("set_id").alias("b")).unionByName(
        close.select(F.least("a_low", "b_low").alias("a"), F.greatest("a_low", "b_low").alias("b"))
    )
    return written(pairs.distinct(), "close")


def _rooted(shared: DataFrame, roots: DataFrame) -> DataFrame:
    """The rows of ``shared`` with ``root``, the same for sets that links connect, where their key has several roots.

    ``minor``: the root is not the one that most sets of the key have; ``minors``: how many such rows the key has.
    Two sets of a key with different roots are never both of the most common one.
    """
    rooted = shared.join(roots, F.col("set_id") == F.col("node"), "left").drop("node")
    rooted = written(rooted.withColumn("root", F.coalesce("root", "set_id")), "rooted")
    each = rooted.groupBy("kind", "key", "root").agg(F.count("*").alias("many"))
    keys = each.groupBy("kind", "key").agg(F.max_by("root", F.struct("many", "root")).alias("_most"), F.max("many").alias("_many"), F.sum("many").alias("_all"))
    keys = keys.filter("_all > _many").select(
        _same(F.col("kind")).alias("kind"), _same(F.col("key")).alias("key"), "_most", (F.col("_all") - F.col("_many")).alias("minors")
    )
    return rooted.join(keys, ["kind", "key"]).withColumn("minor", F.col("root") != F.col("_most")).drop("_most")


def first_of_near_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", size: int = 5, least: float = 0.8) -> DataFrame:
    """``doc_id, body`` (MD5 of the text): one of each group of texts that links of near copies connect.

    Texts link when their sets of shingles have a Jaccard similarity of ``least`` or more. Pairs whose SimHash of the
    same shingles is within two bits are compared first. Pairs that share a key of MinHash bands are compared, unless links found before already connect them: that changes no group. In keys of more than ``FULL_KEY``
    sets a few sets are compared with all others first, which connects the many copies of one text, and at last all
    that are not of the key's largest group. Sizes and parities tell most pairs apart before any shingles move. Of a
    group the smallest id stays, a null id last. Null texts count as empty, texts without a word are equal, and of ids
    that repeat, each text is a row of its own. Other columns are ignored; an empty table gives an empty result.
    """
    body = F.md5(whole(text_col).cast("binary")).alias("body")
    chosen = docs.select(F.col(id_col).alias("doc_id"), whole(text_col).alias("text"), body)
    low = F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "body", "fp")).alias("low")
    distinct = _described(chosen, size).groupBy("set_id").agg(low, F.first(F.struct("size", "bands", "sketch")).alias("all"))
    distinct = distinct.select("set_id", "low.none", "low.doc_id", "low.body", "low.fp", "all.size", "all.bands", "all.sketch")
    distinct = written(distinct, "distinct")  # a checkpoint would compute its last stage a second time to write it
    close = fingerprint_pairs(distinct.filter("size > 0").select("set_id", "fp"))

    probed = distinct.select("set_id", "size", F.posexplode("bands").alias("kind", "key"))
    sizes = probed.groupBy("kind", "key").agg(F.count("*").alias("n")).filter("n > 1")
    sizes = sizes.select(_same(F.col("kind")).alias("kind"), _same(F.col("key")).alias("key"), "n")
    shared = probed.join(sizes, ["kind", "key"]).join(distinct.select(F.col("set_id").alias("_set"), "sketch"), F.col("set_id") == F.col("_set"))
    shared = written(shared.drop("_set"), "shared")
    met = shared.select("set_id").unionByName(close.select(F.explode(F.array("a", "b")).alias("set_id"))).distinct()
    named = distinct.join(met, "set_id", "left_semi").select(
        F.col("doc_id").alias("_id"), F.col("body").alias("_body")
    )
    asked = chosen.join(named, (F.col("body") == F.col("_body")) & F.col("doc_id").eqNullSafe(F.col("_id")), "left_semi")
    sets = written(_sets(asked, size).dropDuplicates(["set_id"]), "shingles")

    near = _may_be_near(least)

    def side(rows: DataFrame, name: str, *more: str) -> DataFrame:
        keys = [_same(F.col("kind")).alias("kind"), _same(F.col("key")).alias("key")]
        return rows.select(*keys, *more, *[F.col(c).alias(f"{name}_{c}") for c in ("set_id", "size", "sketch")])

    told = distinct.select("set_id", "size", "sketch")
    ends = [told.select(*[F.col(c).alias(f"{name}_{c}") for c in told.columns]) for name in "ab"]
    close = close.join(ends[0], F.col("a") == F.col("a_set_id")).join(ends[1], F.col("b") == F.col("b_set_id")).filter(near)

    some = shared.filter(F.col("n") <= FULL_KEY)
    pairs = side(some, "a").join(side(some, "b"), ["kind", "key"]).filter((F.col("a_set_id") < F.col("b_set_id")) & near)
    pairs = pairs.select(F.col("a_set_id").alias("a"), F.col("b_set_id").alias("b"))
    roots = connected_components(_verified(close.select("a", "b").unionByName(pairs), sets, least))

    full = shared.filter(F.col("n") > FULL_KEY).drop("n")
    place = F.row_number().over(Window.partitionBy("kind", "key").orderBy(F.xxhash64("set_id"), "set_id"))
    for many in LEADERS if not full.isEmpty() else ():
        open_ = written(_rooted(full, roots), "open")
        if open_.isEmpty():
            break
        leaders = open_.filter("minor")
        if many is not None:
            leaders = leaders.withColumn("_at", place).filter(F.col("_at") <= many).drop("_at")
        parts = F.ceil(F.col("minors") / LEADERS_A_TASK).cast("int") if many is None else F.lit(1)
        left = leaders.withColumn("part", F.pmod(F.xxhash64("set_id"), parts).cast("int"))
        right = open_.withColumn("part", F.explode(F.sequence(F.lit(0), parts - 1)))
        left = side(left, "a", "part", F.col("root").alias("a_root"))
        right = side(right, "b", "part", F.col("root").alias("b_root"))
        pairs = left.join(right, ["kind", "key", "part"]).filter((F.col("a_root") != F.col("b_root")) & near)
        ends = [F.least("a_set_id", "b_set_id").alias("a"), F.greatest("a_set_id", "b_set_id").alias("b")]
        roots = joined_components(roots, _verified(pairs.select(*ends), sets, least))

    rooted = distinct.join(roots, F.col("set_id") == F.col("node"), "left")
    first = F.min(F.struct("none", "doc_id", "set_id", "body")).alias("first")
    kept = rooted.groupBy(F.coalesce("root", "set_id").alias("_root")).agg(first)
    return written(kept.select("first.doc_id", "first.body"), "kept")
