"""From crawled documents to packed training sequences, in five stages.

Each stage takes the documents that its predecessor kept, whole, and decides for all of them; all but the last return
the columns of ``documents``. ``doc_id`` is the key of the documents; null texts count as empty everywhere, and an empty
table passes through every stage. Columns that a stage does not know are kept.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import wraps

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from casewright.llm import exact_dedup, mixing, near_copies, packing, quality
from casewright.llm.common import shared_folder, whole
from casewright.session import configure

LEAST_QUALITY = 0.3
Stage = Callable[[SparkSession, DataFrame, str], DataFrame]
ORACLE_SQL = None  # fingerprints of XXH64 and learned scores are beyond SQL: tests compare with brute force


def stage(function: Stage) -> Stage:
    """A stage sets what the operators rely on, whoever calls it."""

    @wraps(function)
    def run_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        return function(configure(spark), docs, sf_dir)

    return run_stage


def _with_ids(docs: DataFrame, ids: DataFrame) -> DataFrame:
    """The documents whose id is among ``keep``; a null id equals a null id."""
    return docs.join(ids, docs["doc_id"].eqNullSafe(ids["keep"]), "left_semi")


@stage
def keep_good(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the attention classifier gives a score of ``LEAST_QUALITY`` or more; all, where nothing is labelled."""
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    model = quality.train(docs, labels, "quality")
    texts = docs.select(F.struct(*docs.columns).alias("row"), "text")
    scored = quality.quality_scores(texts, model)
    return scored.filter(F.col("score") >= LEAST_QUALITY).select("row.*")


@stage
def drop_exact_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of equal texts: the longest, then the one with the smallest id; of repeated rows one."""
    groups = exact_dedup.exact_duplicates(docs)
    kept = _with_ids(docs, groups.filter("kept").select(F.col("doc_id").alias("keep")))
    body = F.md5(exact_dedup.normal_text("text").cast("binary"))
    rows = kept.select(F.struct(*docs.columns).alias("row"), F.col("doc_id").alias("id"), body.alias("body"))
    return rows.dropDuplicates(["id", "body"]).select("row.*")


@stage
def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies: the one with the smallest id; see ``near_copies``.

    Near copies share 0.8 or more of their shingles of five words. SimHash, searched by the general pigeonhole
    principle, names the pairs within two bits, MinHash bands those beyond; an exact check decides on all.
    """
    kept = near_copies.first_of_near_copies(docs).select(F.col("doc_id").alias("_keep"), F.col("body").alias("_keep_body"))
    body = F.md5(whole(docs["text"]).cast("binary"))
    return docs.join(kept, (body == kept["_keep_body"]) & docs["doc_id"].eqNullSafe(kept["_keep"]), "left_semi")


@stage
def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents as often as the mix takes them, once or twice, or not at all, each time whole.

    The one document of a source at which its target ends is taken whole, so a source passes its target by less than
    a document. Documents without a word are never taken. ``n_chars`` follows the text.
    """
    # the key tells all rows apart but equal ones; those stand for each other
    keyed = docs.select(F.struct(*docs.columns).alias("row"), F.md5(F.to_json(F.struct(*docs.columns))).alias("key"))
    pieces = mixing.mix_sources(keyed.select("key", "row.text", "row.source"), id_col="key").pieces
    copies = pieces.groupBy("_src", "_at", "pass").agg(F.first("doc_id").alias("key"))
    taken = keyed.dropDuplicates(["key"]).join(copies.select("key"), "key")
    known = {"n_chars": F.char_length("row.text").cast("long")}
    return taken.select(*[known.get(c, F.col("row").getField(c)).alias(c) for c in docs.columns])


@stage
def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of the documents in sequences of up to 2048 tokens; see ``packing.pack_texts``."""
    pieces = packing.pack_texts(docs)
    return pieces.select(
        "doc_id", "start", "length", F.crc32("token_ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset"
    )


STAGES: list[tuple[str, Stage]] = [
    ("quality classifier", keep_good),
    ("exact dedup", drop_exact_copies),
    ("near-dedup", drop_near_copies),
    ("source mixing", mix),
    ("sequence packing", pack),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; what a stage kept is written to the shared folder and read by the next."""
    docs = configure(spark).read.parquet(f"{sf_dir}/documents.parquet")
    for place, (_, function) in enumerate(STAGES, 1):
        docs = function(spark, docs, sf_dir)
        if place < len(STAGES):
            path = shared_folder(spark, f"stage-{place}")
            docs.write.parquet(path)
            docs = spark.read.parquet(path)
    return docs
