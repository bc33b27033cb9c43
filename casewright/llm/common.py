"""What the operators share: null-safe columns, held-out rows, and Arrow batches cut to a size that fits a worker."""

from __future__ import annotations

import uuid
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from casewright.session import ensure_checkpoint_dir

SPACES = r"[\x20\x09-\x0D]"
WORD = r"[^\x20\x09-\x0D]+"
#: Text that one step of a Python worker looks at, in bytes; a longer single text is one step of its own.
STEP_BYTES = 4_000_000


def table(spark, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_folder(spark: SparkSession, name: str) -> str:
    """A new folder under the checkpoint folder, which all executors reach."""
    ensure_checkpoint_dir(spark)
    return f"{spark.sparkContext.getCheckpointDir()}/{name}-{uuid.uuid4().hex}"


def written(df: DataFrame, name: str) -> DataFrame:
    """The rows, written to a table in the shared folder and read again: smaller than a checkpoint."""
    path = shared_folder(df.sparkSession, name)
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.parquet(path)


def whole(column: str | Column) -> Column:
    """The text, a null one as empty."""
    return F.coalesce(F.col(column) if isinstance(column, str) else column, F.lit(""))


def remainder(id_column: str | Column, modulus: int) -> Column:
    """crc32 of the id as text, modulo; a null id counts as empty text."""
    text = (F.col(id_column) if isinstance(id_column, str) else id_column).cast("string")
    return F.crc32(F.coalesce(text, F.lit("")).cast("binary")) % modulus


def rekeyed(key: Column) -> Column:
    """The same key as a new expression.

    A table that was aggregated by a key is already dealt by it, and adaptive execution splits a hot key only in a
    join that deals out both of its sides. Joining by the new expression makes Spark deal the (narrow) table again.
    """
    return F.concat(key, F.lit(""))


def steps(batches: Iterable[pa.RecordBatch], text: str, limit: int = STEP_BYTES) -> Iterator[pa.RecordBatch]:
    """The batches in runs of rows whose texts hold about ``limit`` bytes."""
    for batch in batches:
        if not batch.num_rows:
            continue
        sizes = np.cumsum(pc.fill_null(pc.binary_length(batch.column(text)), 0).to_numpy(zero_copy_only=False))
        start = 0
        while start < batch.num_rows:
            before = sizes[start - 1] if start else 0
            end = max(start + 1, int(np.searchsorted(sizes, before + limit, side="right")))
            yield batch.slice(start, end - start)
            start = end


def words_of(texts: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """All words of all texts in order, cut at ASCII white space, A-Z lower-cased, and the number of words of each text."""
    lists = pc.ascii_split_whitespace(pc.ascii_lower(pc.fill_null(texts, "")))
    words = lists.flatten()
    filled = pc.not_equal(words, "").to_numpy(zero_copy_only=False)
    counts = pc.list_value_length(lists).to_numpy(zero_copy_only=False)
    ends = np.cumsum(counts)
    kept = np.concatenate([[0], np.cumsum(filled)])
    return words.filter(pa.array(filled)), kept[ends] - kept[ends - counts]


def mix(h: np.ndarray) -> np.ndarray:
    """Spread 64-bit values over all of their bits."""
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))
