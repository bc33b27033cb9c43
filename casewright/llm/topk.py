"""Exact top-k inner products by a bit-sliced index: bitmaps are added by weight, then searched from the top slice."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from casewright.session import cut_lineage

BLOCK = 32_768  # candidates of an index block, at most
QUERIES = 256  # queries of a query block, at most
TASKS_A_CORE = 4  # tasks that the search has for each core, at least, where there are query blocks enough
MOST_TASKS = 20_000
INDEX = pa.schema(
    [("block", pa.int64()), ("ids", pa.binary()), ("low", pa.binary()), ("slices", pa.binary()), ("width", pa.int32())]
)


def slice_rows(values: np.ndarray) -> tuple[np.ndarray, np.ndarray, int]:
    """Least value per dimension, and bitmaps ``[dimension, bit, word]`` of what the values have above it."""
    low = values.min(axis=0)
    above = (values - low).astype(np.uint64)
    width = max(1, int(above.max(initial=0)).bit_length())
    words = -(-len(values) // 64)
    padded = np.zeros((words * 64, values.shape[1]), dtype=np.uint64)
    padded[: len(values)] = above
    slices = np.empty((values.shape[1], width, words), dtype=np.uint64)
    for bit in range(width):
        ones = ((padded >> np.uint64(bit)) & np.uint64(1)).astype(np.uint8)
        slices[:, bit] = np.packbits(np.ascontiguousarray(ones.T), axis=1, bitorder="little").view("<u8")
    return low, slices, width


def both_ways(slices: np.ndarray) -> np.ndarray:
    """All bitmaps of the slices, dimension by dimension, and then the complements of all."""
    flat = slices.reshape(slices.shape[0] * slices.shape[1], slices.shape[2])
    return np.concatenate([flat, ~flat])


def weighted_sum(slices: np.ndarray, weights: np.ndarray, bitmaps: np.ndarray | None = None) -> list[np.ndarray]:
    """Slices, least first, of the sum over dimensions of |weight| times value, complemented where a weight is negative.

    Every slice of a dimension counts 2 ** (bit + j) for each bit j of the weight. Carry-save adders turn three
    bitmaps of one place into one of that place and one of the next until a single bitmap is left at each place; all
    adders of a place that can work at once are one operation. ``bitmaps`` is ``both_ways`` of the slices.
    """
    dims, width, words = slices.shape
    bitmaps = both_ways(slices) if bitmaps is None else bitmaps
    sizes = [abs(w) for w in weights.tolist()]
    starts = np.arange(dims) * width + np.where(weights < 0, dims * width, 0)
    taken = [starts[[s >> shift & 1 == 1 for s in sizes]] for shift in range(max(sizes, default=0).bit_length())]
    total: list[np.ndarray] = []
    carried: list[np.ndarray] = []
    while carried or len(total) < width + len(taken) - 1:
        place = len(total)
        rows = [start + place - shift for shift, start in enumerate(taken) if 0 <= place - shift < width]
        stack = np.concatenate([bitmaps[np.concatenate(rows)] if rows else bitmaps[:0], *carried])
        carried = []
        while len(stack) > 2:
            third, left = divmod(len(stack), 3)
            a, b, c = stack[:third], stack[third : 2 * third], stack[2 * third : 3 * third]
            carry = a & b
            a ^= b
            np.bitwise_and(a, c, out=b)
            carry |= b
            a ^= c
            stack[third : third + left] = stack[3 * third :]
            stack = stack[: third + left]
            carried.append(carry)
        if len(stack) == 2:
            carried.append(stack[:1] & stack[1:])
            stack = stack[:1] ^ stack[1:]
        total.append(stack[0] if len(stack) else np.zeros(words, dtype=np.uint64))
    return total


def _count(bitmap: np.ndarray) -> int:
    return int(np.bitwise_count(bitmap).sum())


def _beyond(rough: np.ndarray, scores: np.ndarray) -> bool:
    """Whether a score wrapped around: then it lies far from its rough value."""
    return bool((np.abs(rough - scores.astype(np.float64)) > 2.0**62).any())


def _positions(bitmap: np.ndarray) -> np.ndarray:
    return np.flatnonzero(np.unpackbits(bitmap.view(np.uint8), bitorder="little"))


def top_rows(total: list[np.ndarray], valid: np.ndarray, k: int) -> np.ndarray:
    """The ``k`` rows of ``valid`` with the largest sums, ties to the first rows."""
    sure, open_ = np.zeros_like(valid), valid.copy()
    found = 0
    for bitmap in reversed(total):
        high = open_ & bitmap
        more = _count(high)
        if found + more > k:
            open_ = high
        else:
            sure |= high
            found += more
            open_ &= ~bitmap
            if found == k:
                break
    # what is open has one sum: the boundary
    return np.concatenate([_positions(sure), _positions(open_)[: k - found]])


def _quantised(embedding: Column, scale: int) -> Column:
    """floor(scale * x) of each component, or null for a vector that takes no part. One beyond a long is an error."""
    usable = F.forall(embedding, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf")))

    def whole(x: Column) -> Column:
        scaled = x.cast("double") * scale
        beyond = F.raise_error(F.lit("a component times the scale is beyond a long")).cast("long")
        return F.when(F.abs(scaled) < float(2**63), F.floor(scaled)).otherwise(beyond)

    return F.when(embedding.isNotNull() & F.coalesce(usable, F.lit(False)), F.transform(embedding, whole))


def _matrix(batch: pa.RecordBatch, rows: np.ndarray, dims: int) -> np.ndarray:
    return batch.column("v").take(pa.array(rows)).flatten().to_numpy(zero_copy_only=False).astype(np.int64).reshape(len(rows), dims)


def _by_length(batch: pa.RecordBatch) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Ids and values of the rows of each vector length."""
    ids = batch.column("id").to_numpy(zero_copy_only=False).astype(np.int64)
    lengths = np.diff(batch.column("v").offsets.to_numpy())[: batch.num_rows]
    for dims in np.unique(lengths):
        rows = np.flatnonzero(lengths == dims)
        yield ids[rows], _matrix(batch, rows, int(dims))


def build_index(vectors: DataFrame, block: int = BLOCK) -> DataFrame:
    """Index blocks of the rows ``id, v``: sorted ids, least values and slices of up to ``block`` vectors."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = TaskContext.get().partitionId() << 32
        waiting: dict[int, list[tuple[np.ndarray, np.ndarray]]] = {}

        def made(parts: list[tuple[np.ndarray, np.ndarray]]) -> Iterator[pa.RecordBatch]:
            nonlocal number
            ids, values = (np.concatenate(x) for x in zip(*parts, strict=True))
            order = np.argsort(ids, kind="stable")
            ids, values = ids[order], values[order]
            for at in range(0, len(ids), block):
                low, slices, width = slice_rows(values[at : at + block])
                row = {
                    "block": number,
                    "ids": ids[at : at + block].tobytes(),
                    "low": low.tobytes(),
                    "slices": slices.tobytes(),
                    "width": width,
                }
                number += 1
                yield pa.RecordBatch.from_pylist([row], INDEX)

        for batch in batches:
            for ids, values in _by_length(batch):
                parts = waiting.setdefault(values.shape[1], [])
                parts.append((ids, values))
                if sum(len(i) for i, _ in parts) >= block:
                    yield from made(waiting.pop(values.shape[1]))
        for parts in waiting.values():
            yield from made(parts)

    return vectors.mapInArrow(run, "block long, ids binary, low binary, slices binary, width int")


def top_k(
    vectors: DataFrame, is_query: Column, id_col: str = "vec_id", vector_col: str = "embedding", k: int = 20, scale: int = 64
) -> DataFrame:
    """``query_id, rank, vec_id, score``: for each query its ``k`` largest integer inner products with other rows.

    Components become floor(scale * x). Rows are indexed where they are read, in blocks; blocks of queries meet every
    index block by an equality join on its lane, so neither side is collected or broadcast, and each pair of blocks
    gives ``k`` rows a query at most. The ranks of all blocks' rows are exact scores. Rows are dealt into full blocks
    first, however many small files they come from: a query costs the same operations for a block of any size.

    Ties go to the smaller id. Vectors that are null or hold null or non-finite components take no part. Components of
    any size do; a component or a score among the result that does not fit a long stops the query. Vectors of
    different lengths do not meet. All rows that share the query's id are
    its own; a query row that repeats id and vector counts once, other repeated rows each. Rows with a null id take no
    part. An empty table gives an empty result; other columns are ignored.
    """
    usable = (
        vectors.select(F.col(id_col).cast("long").alias("id"), _quantised(F.col(vector_col), scale).alias("v"), is_query.alias("q"))
        .filter(F.col("id").isNotNull() & F.col("v").isNotNull())
    )
    full = -(-vectors.count() // BLOCK) or 1
    index = cut_lineage(build_index(usable.select("id", "v").repartition(full)))
    queries = usable.filter("q").select("id", "v").distinct().coalesce(full)

    def blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Queries of one length, up to ``QUERIES`` in a row."""
        for batch in batches:
            for ids, values in _by_length(batch):
                for at in range(0, len(ids), QUERIES):
                    part = ids[at : at + QUERIES]
                    yield pa.RecordBatch.from_arrays(
                        [pa.array([part.tobytes()], pa.binary()), pa.array([values[at : at + QUERIES].tobytes()], pa.binary())], ["q_ids", "q_data"]
                    )

    asked = cut_lineage(queries.mapInArrow(blocks, "q_ids binary, q_data binary"))
    # Every query block goes to every lane, every index block to one: the stated queries against all rows, in blocks.
    # Few lanes are copied so that all cores have work; the query blocks are dealt over the copies.
    lanes = max(1, index.count())
    copies = -(-TASKS_A_CORE * vectors.sparkSession.sparkContext.defaultParallelism // lanes)
    tasks = min(lanes * copies, MOST_TASKS)
    each_lane = F.explode(F.sequence(F.lit(0).cast("long"), F.lit(lanes - 1).cast("long")))
    sent = asked.withColumn("copy", F.pmod(F.xxhash64("q_ids"), F.lit(copies)).cast("int")).withColumn("lane", each_lane)
    kept = index.withColumn("lane", F.pmod(F.xxhash64("block"), F.lit(lanes)))
    kept = kept.withColumn("copy", F.explode(F.sequence(F.lit(0), F.lit(copies - 1))))
    met = sent.repartition(tasks, "lane", "copy").join(kept.repartition(tasks, "lane", "copy"), ["lane", "copy"])
    pairs = met.select("ids", "low", "slices", "width", "q_ids", "q_data")

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in range(batch.num_rows):
                yield from _search_block({n: batch.column(n)[row].as_py() for n in batch.schema.names}, k)

    best = pairs.mapInArrow(search, "query_id long, vec_id long, score long")
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.col("score").desc(), "vec_id"))
    return best.withColumn("rank", rank).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def _search_block(row: dict, k: int) -> Iterator[pa.RecordBatch]:
    """The best rows of one index block for each query of one query block."""
    ids, low, q_ids = (np.frombuffer(row[n], np.int64) for n in ("ids", "low", "q_ids"))
    dims, width = len(low), row["width"]
    asked = np.frombuffer(row["q_data"], np.int64).reshape(len(q_ids), -1)
    if asked.shape[1] != dims:
        return
    slices = np.frombuffer(row["slices"], np.uint64).reshape(dims, width, -(-len(ids) // 64))
    valid = np.packbits(np.arange(-(-len(ids) // 64) * 64) < len(ids), bitorder="little").view("<u8")
    bitmaps = both_ways(slices)
    found: list[np.ndarray] = []
    for query, weights in zip(q_ids, asked, strict=True):
        mine = valid.copy()
        own = np.searchsorted(ids, [query, query + 1])
        for place in range(*own.tolist()):
            mine[place >> 6] &= ~np.uint64(1 << (place & 63))
        total = weighted_sum(slices, weights, bitmaps)
        rows = top_rows(total, mine, k)
        # what the slices leave out: least values, and the complements of negative weights
        rest = sum(w * v for w, v in zip(weights.tolist(), low.tolist(), strict=True))
        rest += sum(w for w in weights.tolist() if w < 0) * ((1 << width) - 1)
        scores = np.full(len(rows), (rest + 2**63) % 2**64 - 2**63, dtype=np.int64)
        rough = np.full(len(rows), float(rest))
        for place, bitmap in enumerate(total):
            ones = (bitmap[rows >> 6] >> (rows & 63).astype(np.uint64)) & np.uint64(1)
            rough += ones * 2.0**place
            if place < 64:  # sums wrap around; what fits a long comes out right
                scores += (ones << np.uint64(place)).view(np.int64)
        if (np.abs(rough) > 2**62).any() and _beyond(rough, scores):
            raise ValueError("an inner product is beyond a long")
        found.append(np.stack([np.full(len(rows), query), ids[rows], scores]))
    if found:
        columns = np.concatenate(found, axis=1)
        yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], ["query_id", "vec_id", "score"])
