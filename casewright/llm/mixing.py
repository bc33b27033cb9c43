"""Mixing sources to target weights: a low-discrepancy schedule of slots over shuffled blocks of equally many words."""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from casewright.llm.common import WORD, whole
from casewright.llm.running import hex_cell, levels_for, totals_before
from casewright.session import cut_lineage

GOLDEN = 0.6180339887498949  # the golden ratio's fractional part
GRID = 4096  # cells of the unit interval in which points meet sources
ROWS_A_CELL = 1000  # rows that are put in order together, about
SLOTS_A_CHUNK = 256
SMALL_TABLE = 10_000  # sources up to which their table is broadcast, some hundred kilobytes


@dataclass(frozen=True)
class Mix:
    """``rows``: one per input row. ``sources``: sizes and targets. ``pieces``: the mix, in the order of ``slot``."""

    rows: DataFrame
    sources: DataFrame
    pieces: DataFrame


def word_count(text: str | Column) -> Column:
    return F.regexp_count(whole(text), F.lit(WORD)).cast("long")


def _ranked(sources: DataFrame) -> DataFrame:
    """Sources by code point, null last, with ``rank`` from 0: sorted in parallel, counted by partition."""
    ordered = cut_lineage(sources.orderBy(F.col("source").asc_nulls_last()).withColumn("_part", F.spark_partition_id()))
    parts = ordered.groupBy("_part").agg(F.count("*").alias("n"))
    before = parts.select(
        "_part", F.coalesce(F.sum("n").over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_before")
    )  # one row for each partition of the sort
    within = F.row_number().over(Window.partitionBy("_part").orderBy(F.col("source").asc_nulls_last())) - 1
    return ordered.join(F.broadcast(before), "_part").select(
        *sources.columns, (F.col("_before") + within).cast("long").alias("rank")
    )


def source_targets(sources: DataFrame, weights=(5, 2, 1), share: float = 1.5, most: float = 2.0) -> DataFrame:
    """Adds ``rank`` and ``target`` to ``source, _src, source_size, n``.

    Weights repeat along the sources by code point, null last. All targets sum to ``share`` times all sizes, shared by
    weight; a target stops at ``most`` times its source's size and the excess is shared again by weight. That is one
    level: each target is the smaller of its stop and level times weight. The level rises by one aggregate a round
    until no further source stops.
    """
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (F.col("rank") % len(weights) + 1).cast("int"))
    table = cut_lineage(_ranked(sources).withColumn("_weight", weight).withColumn("_stop", F.col("source_size") * F.lit(most)))
    level, total = 0.0, None
    while True:
        stopped = F.col("_stop") < F.col("_weight") * F.lit(level)
        held, open_weight, size = table.agg(
            F.sum(F.when(stopped, F.col("_stop")).otherwise(0.0)),
            F.sum(F.when(stopped, 0.0).otherwise(F.col("_weight"))),
            F.sum("source_size"),
        ).first()
        total = share * (size or 0)
        if not open_weight:
            break
        risen = (total - held) / open_weight
        if risen <= level:
            break
        level = risen
    return table.withColumn("target", F.least("_stop", F.col("_weight") * F.lit(level))).drop("_weight", "_stop")


def schedule(sources: DataFrame, block: int) -> DataFrame:
    """``slot, _src, rank``: which source fills each slot, and how many slots it has filled before.

    Point t of the golden-ratio sequence falls into the interval of a source; intervals are as wide as the sources'
    numbers of slots. A source never gets more slots than its target has blocks; the few that it lacks, as many as the
    discrepancy of the sequence, follow at the end.
    """
    spark = sources.sparkSession
    quota = sources.select("_src", F.col("rank").alias("_order"), F.ceil(F.floor("target") / block).alias("_quota")).filter("_quota > 0")
    total, many = quota.agg(F.coalesce(F.sum("_quota"), F.lit(0)), F.count("*")).first()
    if not total:
        return quota.select(F.lit(0).cast("long").alias("slot"), "_src", F.lit(0).cast("long").alias("rank")).limit(0)
    wide = levels_for(sources.count(), 1)
    cells = quota.withColumn("_cell", hex_cell(F.col("_order"), wide)).withColumn("_all", F.lit(0))
    before = totals_before(cells, "_all", "_cell", "_quota", wide)
    bounds = cells.join(before, ["_all", "_cell"]).select(
        "_src", "_order", "_quota", (F.col("before") / total).alias("_low"), ((F.col("before") + F.col("_quota")) / total).alias("_high")
    )
    spread = bounds.withColumn(
        "_grid", F.explode(F.sequence(F.floor(F.col("_low") * GRID), F.floor(F.col("_high") * GRID)))
    )
    point = F.col("slot") * F.lit(GOLDEN)
    points = spark.range(total).withColumnRenamed("id", "slot").withColumn("_x", point - F.floor(point))
    hits = (
        points.withColumn("_grid", F.floor(F.col("_x") * GRID))
        .join(spread, "_grid")
        .filter((F.col("_x") >= F.col("_low")) & (F.col("_x") < F.col("_high")))
        .select("slot", "_src", "_quota")
    )
    deep = levels_for(math.ceil(total / SLOTS_A_CHUNK), 1)
    hits = cut_lineage(hits.withColumn("_cell", hex_cell(F.floor(F.col("slot") / SLOTS_A_CHUNK), deep)))
    counts = hits.groupBy("_src", "_cell").agg(F.count("*").alias("_n"))
    within = F.row_number().over(Window.partitionBy("_src", "_cell").orderBy("slot")) - 1
    drawn = (
        hits.withColumn("_within", within)
        .join(totals_before(counts, "_src", "_cell", "_n", deep), ["_src", "_cell"])
        .withColumn("rank", (F.col("before") + F.col("_within")).cast("long"))
        .filter("rank < _quota")
        .select("slot", "_src", "rank")
    )
    got = counts.groupBy("_src").agg(F.sum("_n").alias("_got"))
    lacking = (
        bounds.join(got, "_src", "left")
        .withColumn("_got", F.coalesce("_got", F.lit(0)))
        .filter("_got < _quota")
        .withColumn("rank", F.explode(F.sequence("_got", F.col("_quota") - 1)))
        .select(
            (F.lit(total) + (F.col("rank") - F.col("_got")) * F.lit(many + 1) + F.col("_order")).cast("long").alias("slot"),
            "_src",
            F.col("rank").cast("long").alias("rank"),
        )
    )
    return drawn.unionByName(lacking)


def mix_sources(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    source_col: str = "source",
    weights=(5, 2, 1),
    share: float = 1.5,
    most: float = 2.0,
    block: int = 1024,
) -> Mix:
    """Mix whole sources by weight, in equal blocks of words.

    The rows of a source stand in an order shuffled by a digest of their id, on a line of words that is cut into
    blocks of ``block`` words. Slot number r of a source takes block r of the line, going round again after its end;
    the last block stops at the source's target, so a source gives the whole number of words below its target and no
    word is taken more than ``ceil(most)`` times.

    Null texts have size 0 and are never taken; a null source is a source of its own, the last; a null id shuffles as
    empty text. Rows that repeat an id are rows of their own (in the digest's order, shorter first). The same input
    gives the same mix at every number of partitions. An empty table gives empty results.
    """
    named = F.when(F.col(source_col).isNull(), F.lit("n")).otherwise(F.concat(F.lit("s"), F.col(source_col).cast("string")))
    base = cut_lineage(
        docs.select(
            F.col(id_col).alias("doc_id"),
            F.col(source_col).alias("source"),
            named.alias("_src"),
            word_count(text_col).alias("size"),
            F.md5(F.coalesce(F.col(id_col).cast("string"), F.lit("")).cast("binary")).alias("_order"),
        )
    )
    sizes = base.groupBy("_src", "source").agg(F.sum("size").alias("source_size"), F.count("*").alias("n"))
    sources = cut_lineage(source_targets(sizes, weights, share, most))
    count = sources.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]

    deep = levels_for(count, ROWS_A_CELL)
    celled = base.withColumn("_cell", F.substring("_order", 1, 2 * deep))
    cells = celled.groupBy("_src", "_cell").agg(F.sum("size").alias("_words"))
    among = Window.partitionBy("_src", "_cell").orderBy("_order", "size").rowsBetween(Window.unboundedPreceding, -1)
    placed = celled.withColumn("_within", F.coalesce(F.sum("size").over(among), F.lit(0)))
    own = sources.select("_src", "source_size", "target")
    lined = (
        placed.join(totals_before(cells, "_src", "_cell", "_words", deep), ["_src", "_cell"])
        .withColumn("_at", F.col("before") + F.col("_within"))
        .join(F.broadcast(own) if sources.count() <= SMALL_TABLE else own, "_src")
        .select("doc_id", "source", "_src", "size", "source_size", "target", "_at")
    )
    rows = cut_lineage(lined)

    laid = rows.filter("size > 0").withColumn("pass", F.explode(F.sequence(F.lit(0), F.lit(math.ceil(most) - 1))))
    start = F.col("pass") * F.col("source_size") + F.col("_at")
    runs = (
        laid.withColumn("_from", start)
        .withColumn("_to", F.least(start + F.col("size"), F.floor("target")))
        .filter("_from < _to")
        .withColumn("rank", F.explode(F.sequence(F.floor(F.col("_from") / block), F.floor((F.col("_to") - 1) / block))))
    )
    first = F.greatest("_from", F.col("rank") * block)
    pieces = runs.join(schedule(sources, block), ["_src", "rank"]).select(
        "slot",
        "source",
        "doc_id",
        "pass",
        (first - F.col("_from")).alias("doc_start"),
        (F.least("_to", (F.col("rank") + 1) * block) - first).alias("words"),
        "_src",
        "_at",
    )
    return Mix(rows, sources, pieces)


def words_taken(mix: Mix) -> DataFrame:
    """One row per input row: ``doc_id, size, source_size, target, taken`` and the row's place ``_src, _at``."""
    sums = mix.pieces.groupBy("_src", "_at").agg(F.sum("words").alias("_sum"))
    placed = mix.rows.withColumn("_full", F.col("size") > 0)
    joined = placed.join(sums.withColumn("_full", F.lit(True)), ["_src", "_at", "_full"], "left")
    return joined.select(
        "doc_id", "size", "source_size", "target", F.coalesce("_sum", F.lit(0)).cast("long").alias("taken"), "_src", "_at"
    )
