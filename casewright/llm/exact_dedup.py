"""Exact duplicates: 128-bit content hash, the row that stays, and a comparison of bytes. DataFrame functions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from casewright.llm.common import SPACES, rekeyed, whole
from casewright.session import cut_lineage


def normal_text(text: str | Column) -> Column:
    """The text without ASCII white space; null as empty."""
    return F.regexp_replace(whole(text), f"{SPACES}+", "")


def exact_duplicates(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", digest=lambda text: F.md5(text.cast("binary"))
) -> DataFrame:
    """One row per input row: ``doc_id, keep_id, group_size, kept, text_sha256``.

    Rows are equal when their texts are, white space aside. The row with the most code points in its own text stays,
    of these the one with the smallest id; a null id comes last. Rows are grouped by the 128-bit hash and the SHA-256
    that is returned anyway. The bytes are compared by grouping by hash *and* text: copies collapse before the
    shuffle, so a text crosses the network about once however often it is repeated. Texts that share the 128-bit hash
    alone come apart there; two texts that shared both hashes would stop the query rather than be merged.

    Null texts are empty and equal each other. Repeated rows (same id and text) each count and each come back; all of
    those with the kept id are ``kept``. An empty table gives an empty result. Other columns are ignored.
    """
    base = docs.select(
        F.col(id_col).alias("doc_id"),
        normal_text(text_col).alias("_text"),
        F.char_length(whole(text_col)).cast("long").alias("_points"),
    ).withColumn("_hash", digest(F.col("_text")))
    sha = F.sha2(F.col("_text").cast("binary"), 256)

    # read by the groups and by the last join: written once, without texts
    rows = cut_lineage(base.select("doc_id", "_points", F.concat("_hash", sha).alias("_key"), sha.alias("text_sha256")))
    # ~id = -id - 1 reverses the order without overflow
    first = F.max(F.struct(F.col("_points"), F.bitwise_not("doc_id").alias("turned")))
    groups = rows.groupBy("_key").agg(F.count("*").alias("group_size"), first.alias("_first"))

    texts = base.groupBy("_hash", "_text").agg(F.count("*").alias("n"))
    compared = (
        texts.select(F.concat("_hash", sha).alias("_key"), "n")
        .groupBy("_key")
        .agg(F.count("*").alias("_texts"), F.sum("n").alias("_members"))
    )
    proven = (F.col("_texts") == 1) & (F.col("_members") == F.col("group_size"))
    verdict = groups.join(compared, "_key").select(
        rekeyed(F.col("_key")).alias("_key"),
        F.when(proven, F.col("group_size"))
        .otherwise(F.raise_error(F.lit("two different texts share both of their hashes")).cast("long"))
        .alias("group_size"),
        F.bitwise_not("_first.turned").alias("keep_id"),
    )
    return rows.join(verdict, "_key").select(
        "doc_id", "keep_id", "group_size", F.col("doc_id").eqNullSafe(F.col("keep_id")).alias("kept"), "text_sha256"
    )
