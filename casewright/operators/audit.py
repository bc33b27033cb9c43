"""The tamper-evident audit log: a hash chain per organisation, checked without ordering anything.

Each entry names the hash before it, so checking is an equi-join of every entry with its predecessor on
(org, index): a log of any size spreads evenly, however much of it belongs to one organisation.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# --- Fixed values -----------------------------------------------------------------------------------------------
GENESIS = "0" * 64
MAX_NOTE = 10_000
# ------------------------------------------------------------------------------------------------------------
CONTENT = (
    "action",
    "actor_id",
    "actor_type",
    "after",
    "before",
    "chain_index",
    "context",
    "correlation_id",
    "org_id",
    "resource_id",
    "resource_type",
    "ts",
)


def canonical_entry() -> Column:
    """An entry as JSON with sorted keys, absent values written as null."""

    def text(name: str) -> Column:
        if name == "chain_index":
            return F.col(name).cast("string")
        if name == "ts":
            value = F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss.SSSSSS'Z'")
        else:
            value = F.col(name)
        if name in ("before", "after", "context"):  # already JSON text
            return F.coalesce(value, F.lit("null"))
        quoted = F.regexp_extract(F.to_json(F.struct(value.alias("v"))), r"(?s)^\{\"v\":(.*)\}$", 1)
        return F.when(value.isNull(), F.lit("null")).otherwise(quoted)

    parts = []
    for index, name in enumerate(CONTENT):
        parts += [F.lit(("{" if index == 0 else ",") + f'"{name}":'), text(name)]
    return F.concat(*parts, F.lit("}"))


def entry_hash(prev_hash: Column) -> Column:
    return F.sha2(F.concat(prev_hash, canonical_entry()), 256)


def verify_chain(log: DataFrame) -> DataFrame:
    """Per organisation: whether the chain holds, how many entries were checked, the first break and why."""
    hashed = log.select(
        "org_id", "chain_index", "prev_hash", "entry_hash", (entry_hash(F.col("prev_hash")) == F.col("entry_hash")).alias("intact")
    )
    # An index held twice breaks at the second holder, which should have had the next index.
    entries = hashed.groupBy("org_id", "chain_index").agg(
        F.count("*").alias("copies"),
        F.min_by(F.struct("prev_hash", "entry_hash", "intact"), "entry_hash").alias("e"),
    )
    previous = entries.select(
        "org_id", (F.col("chain_index") + 1).alias("chain_index"), F.col("e.entry_hash").alias("expected_prev"), F.col("copies").alias("prev_copies")
    )
    joined = entries.join(previous, ["org_id", "chain_index"], "left")
    first = F.col("chain_index") == 0
    expected = F.when(first, F.lit(GENESIS)).otherwise(F.col("expected_prev"))
    reason = (
        F.when(expected.isNull(), F.lit("missing"))
        .when(F.col("e.prev_hash") != expected, F.lit("prev_hash does not match preceding entry"))
        .when(~F.col("e.intact"), F.lit("entry content does not match its hash"))
        .when(F.col("copies") > 1, F.lit("repeated"))
    )
    checked = joined.withColumn("problem", reason)
    broken = checked.filter(F.col("problem").isNotNull()).groupBy("org_id").agg(
        F.min(F.struct("chain_index", "problem")).alias("b")
    )
    per_org = checked.join(broken, "org_id", "left")
    # A repeated index is itself sound; the break is its second copy.
    repeated = F.col("b.problem") == "repeated"
    sound = F.col("b").isNull() | (F.col("chain_index") < F.col("b.chain_index")) | (repeated & (F.col("chain_index") == F.col("b.chain_index")))
    summary = per_org.groupBy("org_id").agg(
        F.count_if(sound).alias("entries_checked"),
        F.max_by("e.entry_hash", F.when(sound, F.col("chain_index"))).alias("head_hash"),
        F.first("b").alias("b"),
    )
    gap = F.concat(F.lit("expected chain_index "), F.col("entries_checked").cast("string"), F.lit(" (entry missing or inserted)"))
    return summary.select(
        "org_id",
        F.col("b").isNull().alias("valid"),
        "entries_checked",
        "head_hash",
        F.col("b.chain_index").alias("broken_at_index"),
        F.when(F.col("b.problem").isin("missing", "repeated"), gap).otherwise(F.col("b.problem")).alias("reason"),
    )


def audited_orgs(log: DataFrame) -> DataFrame:
    return log.select("org_id").distinct()


_APPENDED = "org_id string, position bigint, chain_index bigint, prev_hash string, entry_hash string"


def _chain(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Walk each organisation's new entries in order, holding one hash."""
    org, previous = None, GENESIS
    for batch in batches:
        out = []
        for row in batch.itertuples(index=False):
            if row.org_id != org:
                org, previous = row.org_id, row.head_hash
            own = hashlib.sha256((previous + row.content).encode()).hexdigest()
            out.append((row.org_id, row.position, row.chain_index, previous, own))
            previous = own
        yield pd.DataFrame(out, columns=["org_id", "position", "chain_index", "prev_hash", "entry_hash"])


def append_entries(entries: DataFrame, heads: DataFrame | None = None) -> DataFrame:
    """Chain new entries after each organisation's head.

    ``entries`` have the content columns but ``chain_index``, and ``position``, their order. ``heads(org_id,
    chain_index, entry_hash)`` are the last stored entries. Hashing a chain is sequential by definition, so an
    organisation's new entries pass through one task as a stream that keeps a single hash; everything else
    about an entry is computed before, in parallel.
    """
    from pyspark.sql import Window as W

    if heads is None:
        with_heads = entries.withColumns({"_next": F.lit(0).cast("long"), "head_hash": F.lit(GENESIS)})
    else:
        last = heads.select("org_id", (F.col("chain_index") + 1).alias("_next"), F.col("entry_hash").alias("head_hash"))
        with_heads = entries.join(last, "org_id", "left").withColumns(
            {"_next": F.coalesce("_next", F.lit(0).cast("long")), "head_hash": F.coalesce("head_hash", F.lit(GENESIS))}
        )
    order = W.partitionBy("org_id").orderBy("position")
    placed = with_heads.withColumn("chain_index", F.col("_next") + F.row_number().over(order) - 1)
    contents = placed.select("org_id", "position", "chain_index", "head_hash", canonical_entry().alias("content"))
    hashed = contents.sortWithinPartitions("org_id", "position").mapInPandas(_chain, _APPENDED)
    return placed.drop("_next", "head_hash").join(hashed, ["org_id", "position", "chain_index"]).drop("position")


def check_notes(notes: DataFrame) -> DataFrame:
    """Notes with their length, digest and whether they can be kept; blank and overlong ones are refused."""
    body = F.coalesce("body", F.lit(""))
    refusal = F.when(F.trim(F.regexp_replace(body, r"\s+", " ")) == "", F.lit("a note cannot be empty")).when(
        F.length(body) > MAX_NOTE, F.lit(f"a note has at most {MAX_NOTE} characters")
    )
    return notes.withColumns({"length": F.length(body), "sha256": F.sha2(body, 256), "refusal": refusal})
