"""Whitening of embeddings: exact cross-products of integer vectors by bit slices, centred before the eigenvectors."""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

BLOCK_ENTRIES = 1 << 20  # entries of a block of vectors, at most, but for a single longer vector
#: Entries beyond this are refused: their products with others would leave the 38 digits that sums are kept in.
LARGEST = 1 << 46
RESULT = (
    ("component", T.IntegerType()),
    ("n", T.LongType()),
    ("deviation", T.LongType()),
    ("whitened", T.DoubleType()),
    ("explained", T.DoubleType()),
    ("identity_error", T.DoubleType()),
)


@dataclass(frozen=True)
class Fit:
    """Exact sums over the fit list of one length of vectors, and what follows from them."""

    n: int
    sums: list[int]
    components: np.ndarray
    """Unit eigenvectors of the covariance as columns, by falling eigenvalue."""
    values: np.ndarray
    explained: np.ndarray
    identity_error: float


def usable(vector: str | Column) -> Column:
    """True for a vector that is not null and holds no null, infinite or not-a-number entry."""
    column = F.col(vector) if isinstance(vector, str) else vector
    finite = F.forall(column, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf")))
    return F.coalesce(column.isNotNull() & finite, F.lit(False))


def whole_entries(vector: str | Column, scale: int) -> Column:
    """The entries times ``scale``, rounded down."""
    column = F.col(vector) if isinstance(vector, str) else vector
    scaled = lambda c: F.lit(float(scale)) * c.cast("double")
    large = F.raise_error(F.lit(f"an entry times {scale} is beyond {LARGEST}")).cast("long")
    return F.transform(column, lambda c: F.when(F.abs(scaled(c)) < float(LARGEST), F.floor(scaled(c))).otherwise(large))


def scatter(block: np.ndarray) -> tuple[list[int], list[list[int]]]:
    """Sums and cross-products over the rows of a block of integers, exactly.

    Each dimension is shifted to begin at zero and cut into bit planes, packed across the rows into words. The
    cross-product of two dimensions is the number of common ones of each two of their planes, weighted by the planes'
    places; the shift is taken out again with the sums, which are numbers of ones as well.
    """
    rows, dims = block.shape
    low = block.min(axis=0)
    above = (block - low).astype(np.uint64)
    bits = max(1, int(above.max(initial=0)).bit_length())
    padded = np.zeros((dims, -(-rows // 64) * 64), dtype=np.uint64)
    padded[:, :rows] = above.T
    planes = np.empty((bits, dims, padded.shape[1] // 64), dtype=np.uint64)
    for bit in range(bits):
        ones = (padded >> np.uint64(bit) & np.uint64(1)).astype(np.uint8)
        planes[bit] = np.packbits(ones, axis=1, bitorder="little").view(np.uint64)

    exact = np.int64 if 2 * bits + rows.bit_length() < 62 else object
    sums, products = np.zeros(dims, dtype=exact), np.zeros((dims, dims), dtype=exact)
    for first in range(bits):
        sums += np.bitwise_count(planes[first]).sum(axis=1, dtype=np.int64).astype(exact) * (1 << first)
        for second in range(first, bits):
            common = np.zeros((dims, dims), dtype=np.int64)
            for d in range(dims):
                # two planes of the same place meet symmetrically: half of their pairs are enough
                start = d if first == second else 0
                common[d, start:] = np.bitwise_count(planes[first, d] & planes[second, start:]).sum(axis=1, dtype=np.int64)
            common = common + (np.triu(common, 1).T if first == second else common.T)
            products += common.astype(exact) * (1 << (first + second))
    low, sums, products = low.astype(object), sums.astype(object), products.astype(object)
    products = products + np.outer(low, sums) + np.outer(sums, low) + rows * np.outer(low, low)
    return (sums + rows * low).tolist(), products.tolist()


def _scatter_rows(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The sums of the vectors that a task holds, one row for each two dimensions; ``j`` is -1 for plain sums."""
    totals: dict[int, list] = {}
    for batch in batches:
        lists = batch.column("x")
        sizes = lists.value_lengths().to_numpy()
        flat, ends = lists.flatten().to_numpy(zero_copy_only=False), np.cumsum(sizes)
        for dims in np.unique(sizes[sizes > 0]).tolist():
            rows = flat[(ends[sizes == dims] - dims)[:, None] + np.arange(dims)]
            step = max(1, BLOCK_ENTRIES // dims)
            for start in range(0, len(rows), step):
                block = rows[start : start + step]
                sums, products = (np.array(part, dtype=object) for part in scatter(block))
                n, s, p = totals.get(dims, (0, 0, 0))
                totals[dims] = n + len(block), s + sums, p + products
    kind = pa.decimal128(38, 0)
    for dims, (n, sums, products) in totals.items():
        upper = np.triu_indices(dims)
        left = np.concatenate([[-1], np.arange(dims), upper[0]])
        right = np.concatenate([[-1], np.full(dims, -1), upper[1]])
        amounts = pa.array([n, *sums.tolist(), *products[upper].tolist()], kind)
        yield pa.RecordBatch.from_arrays(
            [pa.array(np.full(len(left), dims), pa.int32()), pa.array(left, pa.int32()), pa.array(right, pa.int32()), amounts],
            names=["dims", "i", "j", "amount"],
        )


def fit_of(n: int, sums: list[int], products: list[list[int]], largest: int) -> Fit:
    """The covariance is centred in whole numbers, ``n * product - sum * sum``, and only then divided by ``n * n``.

    An eigenvalue that rounding cannot tell from zero is zero; such components whiten nothing and stay out of the
    identity error, which is 0 if there is no other.
    """
    dims = len(sums)
    covariance = np.array(
        [[(n * products[i][j] - sums[i] * sums[j]) / (n * n) for j in range(dims)] for i in range(dims)], dtype=np.float64
    )
    values, vectors = np.linalg.eigh(covariance)
    values, vectors = values[::-1], vectors[:, ::-1]
    trace = float(np.trace(covariance))
    values = np.where(values > dims * np.finfo(np.float64).eps * max(0.0, values[0]), values, 0.0)
    kept = min(largest, dims)
    values, vectors = values[:kept], vectors[:, :kept]
    real = values > 0
    projected = vectors[:, real] / np.sqrt(values[real])
    error = np.abs(projected.T @ covariance @ projected - np.eye(int(real.sum()))).max(initial=0.0)
    return Fit(n, sums, vectors, values, values / trace if trace > 0 else np.zeros(kept), float(error))


def fit_vectors(vectors: DataFrame, x_col: str = "x", largest: int = 4) -> dict[int, Fit]:
    """The fit of each length of vectors, over each distinct vector once; empty where no vector has an entry.

    Equal vectors collapse before the shuffle as well. To the driver comes one row for each two dimensions.
    """
    sums = vectors.select(F.col(x_col).alias("x")).distinct().mapInArrow(_scatter_rows, "dims int, i int, j int, amount decimal(38,0)")
    rows = sums.groupBy("dims", "i", "j").agg(F.sum("amount").alias("amount")).collect()
    fits = {}
    for dims in sorted({row.dims for row in rows}):
        n, plain, products = 0, [0] * dims, [[0] * dims for _ in range(dims)]
        for row in rows:
            if row.dims != dims:
                continue
            amount = int(row.amount)
            if row.i < 0:
                n = amount
            elif row.j < 0:
                plain[row.i] = amount
            else:
                products[row.i][row.j] = products[row.j][row.i] = amount
        fits[dims] = fit_of(n, plain, products, largest)
    return fits


def _deviations(x: np.ndarray, fit: Fit) -> list[int | None]:
    """The sum over dimensions of ``(n * x - S) ** 2``, exactly; null where it is beyond a long."""
    sums = np.array(fit.sums, dtype=object)
    widest = float(np.abs(x).max(initial=0)) * fit.n + float(max(map(abs, fit.sums), default=0))
    if widest**2 * x.shape[1] < 2**62:
        return ((fit.n * x - sums.astype(np.int64)) ** 2).sum(axis=1).tolist()
    exact = ((fit.n * x.astype(object) - sums) ** 2).sum(axis=1).tolist()
    return [value if value < 2**63 else None for value in exact]


def whiten(
    df: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", scale: int = 256, components: int = 4
) -> DataFrame:
    """One row for each usable vector and component: ``vec_id, component, n, deviation, whitened, explained, identity_error``.

    Entries become whole numbers, times ``scale`` rounded down. The covariance is that of the distinct vectors, found
    exactly; ``whitened`` is the centred vector projected on a unit eigenvector, over the root of its eigenvalue, and
    null where that is zero. ``deviation`` is null where it is beyond a long.

    Vectors that are null or hold a null, infinite or not-a-number entry take no part. Vectors of each length have a
    fit of their own; shorter ones have as many components as entries, empty ones none. Repeated rows each come back;
    a null id stays null; other columns are ignored; an empty table gives an empty result. An entry of 2 ** 46 or
    more after scaling raises an error.
    """
    vectors = df.filter(usable(vector_col)).select(
        F.col(id_col).alias("vec_id"), whole_entries(vector_col, scale).alias("x")
    )
    fits = fit_vectors(vectors, "x", components)
    schema = T.StructType([T.StructField("vec_id", vectors.schema["vec_id"].dataType)])
    for name, kind in RESULT:
        schema = schema.add(name, kind)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch.column("x")
            sizes = lists.value_lengths().to_numpy()
            flat, ends = lists.flatten().to_numpy(zero_copy_only=False), np.cumsum(sizes)
            for dims, fit in fits.items():
                here = np.flatnonzero(sizes == dims)
                if not len(here):
                    continue
                x = flat[(ends[here] - dims)[:, None] + np.arange(dims)]
                mean = np.array([total / fit.n for total in fit.sums])
                kept = len(fit.values)
                root = np.sqrt(np.where(fit.values > 0, fit.values, 1.0))
                projected = (x - mean) @ fit.components / root
                rows = len(here) * kept
                flatten = lambda values: pa.array(np.tile(values, len(here)))
                deviations = pa.array(_deviations(x, fit), pa.int64())
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column("vec_id").take(pa.array(np.repeat(here, kept))),
                        pa.array(np.tile(np.arange(1, kept + 1), len(here)), pa.int32()),
                        pa.array(np.full(rows, fit.n), pa.int64()),
                        deviations.take(pa.array(np.repeat(np.arange(len(here)), kept))),
                        pa.array(projected.ravel(), mask=np.tile(fit.values <= 0, len(here))),
                        flatten(fit.explained),
                        pa.array(np.full(rows, fit.identity_error)),
                    ],
                    names=schema.names,
                )

    return vectors.mapInArrow(run, schema)
