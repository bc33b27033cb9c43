"""Near-duplicates by SimHash, searched by the general pigeonhole principle."""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import combinations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from casewright.llm.common import STEP_BYTES, steps, whole
from casewright.llm.components import connected_components
from casewright.session import cut_lineage

BITS = 64
PART_COUNTS = (2, 3, 4)  # numbers of parts that a plan chooses from
COUNTED = 16  # bits of a part whose values are counted, so that the counts are a small table at every input size
#: Fingerprints of one key that are compared pair by pair, so that each meets a few others. Those of a fuller key are
#: linked by their midpoints, exactly.
FULL_KEY = 16
HASHES_AT_ONCE = 255 * 400


def fingerprint(text: bytes, size: int = 3, seed: int = 42) -> int:
    """The SimHash of a lower-cased text: a bit is set if it is in over half of its shingles' XXH64."""
    words = text.split()  # at ASCII white space
    if not words:
        return 0
    joined = b" ".join(words)
    lengths = np.fromiter(map(len, words), dtype=np.int64, count=len(words))
    ends = np.cumsum(lengths + 1) - 1
    starts = ends - lengths
    last = max(1, len(words) - size + 1)
    hashed, ones = xxhash.xxh64_intdigest, np.zeros(BITS, dtype=np.int64)
    for at in range(0, last, HASHES_AT_ONCE):
        to = min(last, at + HASHES_AT_ONCE)
        close = ends[np.minimum(np.arange(at, to) + size - 1, len(words) - 1)].tolist()
        found = np.array([hashed(joined[s:e], seed) for s, e in zip(starts[at:to].tolist(), close, strict=True)], dtype=">u8")
        bits = np.unpackbits(found.view(np.uint8).reshape(-1, 8), axis=1)
        # up to 255 rows fit the counters of one byte
        ones += np.add.reduceat(bits, np.arange(0, len(bits), 255), axis=0, dtype=np.uint8).sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * ones > last).tobytes(), "big")


def fingerprints_of(texts: pa.Array, size: int = 3) -> np.ndarray:
    """The SimHash of each text as a signed long."""
    lowered = pc.ascii_lower(texts).cast(pa.binary()).to_pylist()
    return np.array([fingerprint(t, size) for t in lowered], dtype=np.uint64).view(np.int64)


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", size: int = 3) -> DataFrame:
    """``doc_id, fp`` of every row, the fingerprint as a signed long; null texts count as empty."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in steps(batches, "text", STEP_BYTES):
            found = pa.array(fingerprints_of(batch.column("text"), size))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), found], ["doc_id", "fp"])

    chosen = docs.select(F.col(id_col).alias("doc_id"), whole(text_col).alias("text"))
    kind = chosen.schema["doc_id"].dataType.simpleString()
    return chosen.mapInArrow(run, f"doc_id {kind}, fp long")


def _bits(fps: np.ndarray) -> np.ndarray:
    """Bit b of each fingerprint in column b."""
    return np.unpackbits(fps.astype("<i8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")


@dataclass(frozen=True)
class Plan:
    """``parts``: the bits of each part. ``limits``: how many bits a part may differ in; -1: it is not searched."""

    parts: tuple[tuple[int, ...], ...]
    limits: tuple[int, ...]

    def keys(self, fp: Column) -> list[Column]:
        """Equal for two fingerprints in some position exactly if some part is within its limit.

        A part within t bits has t bits without which it is equal, so each choice of t bits gives a key.
        """
        found = []
        for bits, limit in zip(self.parts, self.limits, strict=True):
            for left_out in combinations(bits, limit) if limit >= 0 else ():
                mask = sum(1 << b for b in bits if b not in left_out)
                signed = mask - (1 << 64) if mask >> 63 else mask
                found.append(fp.bitwiseAND(F.lit(signed)))
        return found


def bit_moments(fps: DataFrame) -> np.ndarray:
    """How many of all fingerprints have bits i and j set; the last row and column count those with one bit, and all."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((BITS + 1, BITS + 1))
        for batch in batches:
            ones = np.ones((batch.num_rows, BITS + 1))
            ones[:, :BITS] = _bits(batch.column("fp").to_numpy())
            total += ones.T @ ones
        cells = np.arange(total.size, dtype=np.int32)
        yield pa.RecordBatch.from_arrays([pa.array(cells), pa.array(total.ravel())], ["cell", "together"])

    sums = fps.select("fp").mapInArrow(run, "cell int, together double").groupBy("cell").agg(F.sum("together").alias("together"))
    total = np.zeros((BITS + 1) ** 2)
    for row in sums.collect():  # 65 * 65 numbers
        total[row["cell"]] = row["together"]
    return total.reshape(BITS + 1, BITS + 1)


def correlated_parts(moments: np.ndarray, parts: int) -> tuple[tuple[int, ...], ...]:
    """All bits in ``parts`` groups of nearly equal size, bits that go together in one group."""
    count = max(1.0, moments[-1, -1])
    mean = moments[-1, :BITS] / count
    spread = np.sqrt(np.maximum(mean * (1 - mean), 1e-12))
    close = np.abs((moments[:BITS, :BITS] / count - np.outer(mean, mean)) / np.outer(spread, spread))
    np.fill_diagonal(close, 0)
    free, groups = set(range(BITS)), []
    for rest in range(parts, 0, -1):
        left = sorted(free)
        group = [max(left, key=lambda b: (close[b, left].max(), -b))]
        while len(group) < -(-len(left) // rest):
            group.append(max((b for b in left if b not in group), key=lambda b: (close[b, group].sum(), -b)))
        groups.append(tuple(sorted(group)))
        free -= set(group)
    return tuple(groups)


def allocate(costs: list[list[float]], total: int) -> tuple[int, ...]:
    """Limits of -1, 0, 1, ... for the parts that sum to ``total`` at the least cost; ``costs[part][limit + 1]``."""
    best: dict[int, tuple[float, tuple[int, ...]]] = {0: (0.0, ())}
    for part in costs:
        found: dict[int, tuple[float, tuple[int, ...]]] = {}
        for spent, (cost, limits) in best.items():
            for place, more in enumerate(part):
                option = (cost + more, (*limits, place - 1))
                if spent + place - 1 not in found or option < found[spent + place - 1]:
                    found[spent + place - 1] = option
        best = found
    return best[total][1]


def plan_search(fps: DataFrame, radius: int) -> Plan:
    """Number of parts, their bits by correlation, and limits by dynamic programming on estimated candidates.

    Fingerprints within ``radius`` bits have a part within its limit whenever the limits sum to ``radius - parts + 1``.
    A limit costs a row for each key that it makes of a fingerprint, and a fingerprint's expected partners: those with
    a near value among all counts of the part's most even bits, thinned by its other bits. Where partners are too
    many to compare, the cost is that of the midpoints. All fingerprints are counted; the plan changes cost alone.
    """
    moments = bit_moments(fps)
    total = moments[-1, -1]
    uneven = np.abs(moments[-1, :BITS] / max(1.0, total) - 0.5)
    choices = [correlated_parts(moments, n) for n in PART_COUNTS]
    flat = [part for parts in choices for part in parts]
    counted_bits = [sorted(sorted(part, key=lambda b: (uneven[b], b))[:COUNTED]) for part in flat]

    def value(bits: list[int]) -> Column:
        found = F.lit(0)
        for place, bit in enumerate(bits):
            found = found + F.shiftleft(F.shiftrightunsigned(F.col("fp"), bit).bitwiseAND(F.lit(1)).cast("int"), place)
        return found

    values = F.explode(F.array(*[F.struct(F.lit(n).alias("part"), value(b).alias("value")) for n, b in enumerate(counted_bits)]))
    counted = fps.select(values.alias("v")).groupBy("v.part", "v.value").agg(F.count("*").alias("n")).toPandas()

    costs = []
    for place, part in enumerate(flat):
        own = counted[counted["part"] == place]
        counts, at = np.zeros(1 << COUNTED), np.arange(1 << COUNTED)
        counts[own["value"].to_numpy()] = own["n"]
        near, cost = np.zeros(1 << COUNTED), [0.0]
        for limit in range(radius + 1):
            for flips in combinations(range(COUNTED), limit):
                near += counts[at ^ sum(1 << b for b in flips)]
            partners = np.maximum(near - 1, 0) / 2.0 ** (len(part) - COUNTED)
            each = np.where(partners > FULL_KEY, BITS + 1, partners)
            cost.append(total * math.comb(len(part), limit) + float(counts @ each))
        costs.append(cost)

    plans = []
    for parts in choices:
        own, costs = costs[: len(parts)], costs[len(parts) :]
        limits = allocate(own, radius - len(parts) + 1)
        plans.append((sum(c[t + 1] for c, t in zip(own, limits, strict=True)), Plan(parts, limits)))
    return min(plans, key=lambda p: p[0])[1]


def near_links(fps: DataFrame, radius: int = 2) -> DataFrame:
    """``a, b``: links between distinct fingerprints ``fp`` that connect all that differ in ``radius`` bits or fewer.

    Keys that few fingerprints share give pairs, which are verified. Fingerprints that share a key with more than
    ``FULL_KEY`` others are linked by midpoints instead: two of them are within 2 bits exactly if some value is within
    1 bit of both, so each of its up to 65 neighbours is linked to the least one. Links that a chain of links replaces
    are not written, and no group is expanded into all of its pairs.
    """
    if radius != 2:
        raise ValueError("midpoints are built for a radius of 2")
    plan = plan_search(fps, radius)
    keys = plan.keys(F.col("fp"))
    probes = F.explode(F.array(*[F.struct(F.lit(n).alias("kind"), k.alias("key")) for n, k in enumerate(keys)])).alias("p")
    probed = fps.select("fp", probes).select("fp", "p.kind", "p.key")
    sizes = probed.groupBy("kind", "key").agg(F.count("*").alias("n")).filter("n > 1")
    # new expressions: the join deals out both sides, and a full key can be split
    sizes = sizes.select(F.bitwise_not(F.bitwise_not("kind")).alias("kind"), F.bitwise_not(F.bitwise_not("key")).alias("key"), "n")
    shared = cut_lineage(probed.join(sizes, ["kind", "key"]))

    some = shared.filter(F.col("n") <= FULL_KEY).select("kind", "key", "fp")
    pairs = some.withColumnRenamed("fp", "a").join(some.withColumnRenamed("fp", "b"), ["kind", "key"])
    verified = pairs.filter((F.col("a") < F.col("b")) & (F.bit_count(F.col("a").bitwiseXOR(F.col("b"))) <= radius))

    flips = [F.col("fp"), *[F.col("fp").bitwiseXOR(F.lit((1 << b) - (1 << 64) if b == 63 else 1 << b)) for b in range(BITS)]]
    crowd = shared.filter(F.col("n") > FULL_KEY).select("fp").distinct()
    around = crowd.select("fp", F.explode(F.array(*flips)).alias("middle"))
    least = F.min("fp").over(Window.partitionBy("middle"))
    linked = around.withColumn("a", least).filter("a < fp")
    return verified.select("a", "b").unionByName(linked.select("a", F.col("fp").alias("b")))


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", size: int = 3, radius: int = 2) -> DataFrame:
    """``doc_id, fingerprint, component_id`` for every row.

    Texts link when their fingerprints differ in ``radius`` bits or fewer; a component is what links reach, its id the
    smallest id in it. Null texts count as empty; texts without a word have the fingerprint zero and link like any
    other; texts of fewer than ``size`` words are one shingle. Repeated rows come back each; null ids are never the
    smallest (a component of null ids alone has a null id). An empty table gives an empty result; other columns are
    ignored.
    """
    own = cut_lineage(fingerprints(docs, id_col, text_col, size))
    distinct = cut_lineage(own.groupBy("fp").agg(F.min("doc_id").alias("_low")))
    roots = connected_components(near_links(distinct.select("fp"), radius))
    rooted = distinct.join(roots, F.col("fp") == F.col("node"), "left").select(
        "fp", "_low", F.coalesce("root", "fp").alias("_root")
    )
    smallest = rooted.groupBy("_root").agg(F.min("_low").alias("component_id"))
    named = rooted.join(smallest, "_root").select(F.bitwise_not(F.bitwise_not("fp")).alias("fp"), "component_id")
    return own.join(named, "fp").select(
        "doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id"
    )
