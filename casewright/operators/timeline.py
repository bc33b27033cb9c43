"""Attack timelines: an incident's evidence in time order, repeated actions folded into steps.

An incident can hold a third of all evidence, so its order is never built in one task: events are cut into
chunks of time, each chunk scanned by itself, and only one summary row per chunk is carried forward.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from casewright.operators.entities import first_of, key_value, remote_key, role
from casewright.session import cut_lineage

# --- Fixed values -----------------------------------------------------------------------------------------------
STEP_GAP_MS = 10 * 60_000
MAX_VALUES = 20
# ------------------------------------------------------------------------------------------------------------
CHUNK_MS = 3_600_000

INCIDENT = "incident_id"
_KEY = ("action", "outcome", "_host", "_remote", "_process", "_parent")


def step_members(evidence: DataFrame, gap_ms: int = STEP_GAP_MS) -> DataFrame:
    """Each evidence event with the step it folds into; a step is named after its first event.

    Consecutive events fold while action, outcome, host, remote side, process and parent stay the same and no
    more than ``gap_ms`` passes between them.
    """
    keyed = evidence.withColumns(
        {
            "_host": first_of("host"),
            "_remote": remote_key(),
            "_process": first_of("process"),
            "_parent": first_of("parent_process"),
            "_chunk": F.floor(F.col("time_ms") / CHUNK_MS).cast("long"),
        }
    ).withColumn("_same", F.struct(*_KEY))
    # Read five times below; written once, so the digests behind it are computed once.
    keyed = cut_lineage(keyed)
    # The last event of each chunk, handed to the next chunk that has any.
    tails = keyed.groupBy(INCIDENT, "_chunk").agg(F.max(F.struct("time_ms", "event_uid", "_same")).alias("_tail"))
    by_chunk = W.partitionBy(INCIDENT).orderBy("_chunk")
    handed = tails.select(INCIDENT, "_chunk", F.lag("_tail").over(by_chunk).alias("_before_chunk"))

    in_chunk = W.partitionBy(INCIDENT, "_chunk").orderBy("time_ms", "event_uid")
    previous = F.coalesce(F.lag(F.struct("time_ms", "event_uid", "_same")).over(in_chunk), F.col("_before_chunk"))
    marked = keyed.join(handed, [INCIDENT, "_chunk"]).withColumn("_previous", previous)
    starts = (
        F.col("_previous").isNull()
        | ~F.col("_same").eqNullSafe(F.col("_previous")["_same"])
        | (F.col("time_ms") - F.col("_previous")["time_ms"] > gap_ms)
    )
    marked = marked.withColumn("_start", F.when(starts, F.col("event_uid")))
    # The step a chunk begins in: the last start of the chunks before it.
    opened = marked.filter(F.col("_start").isNotNull()).groupBy(INCIDENT, "_chunk").agg(
        F.max(F.struct("time_ms", "event_uid")).alias("_opened")
    )
    chunks = handed.select(INCIDENT, "_chunk").join(opened, [INCIDENT, "_chunk"], "left")
    earlier = by_chunk.rowsBetween(W.unboundedPreceding, -1)
    entered = chunks.select(
        INCIDENT, "_chunk", F.last("_opened", ignorenulls=True).over(earlier)["event_uid"].alias("_entered")
    )
    running = in_chunk.rowsBetween(W.unboundedPreceding, 0)
    return (
        marked.withColumn("_here", F.last("_start", ignorenulls=True).over(running))
        .join(entered, [INCIDENT, "_chunk"])
        .withColumn("step_id", F.coalesce("_here", "_entered"))
        .drop("_chunk", "_same", "_before_chunk", "_previous", "_start", "_here", "_entered")
    )


def timeline(evidence: DataFrame, gap_ms: int = STEP_GAP_MS) -> DataFrame:
    """The steps of each incident. Which events a step stands for is ``step_members``, one row per event."""
    members = step_members(evidence, gap_ms)
    keys = [INCIDENT, "step_id"]
    totals = members.groupBy(*keys).agg(
        F.min("time_ms").alias("first_ms"),
        F.max("time_ms").alias("last_ms"),
        F.count("*").alias("event_count"),
        F.first("action").alias("action"),
        F.first("outcome").alias("outcome"),
        F.first("_host").alias("host"),
        F.first("_remote").alias("remote"),
        F.first("_process").alias("process"),
        F.first("_parent").alias("parent_process"),
        F.slice(F.array_sort(F.collect_set("dst_port")), 1, MAX_VALUES).alias("remote_ports"),
    )

    def tagged(kind: str, values: Column) -> Column:
        return F.transform(values, lambda v, i: F.struct(F.lit(kind).alias("kind"), v.alias("value"), i.alias("pos")))

    named = members.select(
        *keys,
        "time_ms",
        "event_uid",
        F.inline(
            F.concat(
                tagged("users", F.transform(role("user"), key_value)),
                tagged("domains", F.transform(role("domain"), key_value)),
                tagged("command_lines", F.array_compact(F.array("cmd_line"))),
                tagged("entities", F.flatten(F.map_values("roles"))),
            )
        ),
    )
    # Distinct values in order of appearance, reduced per value first, at most 20 of each kind kept.
    firsts = named.groupBy(*keys, "kind", "value").agg(F.min(F.struct("time_ms", "event_uid", "pos")).alias("_at"))
    order = W.partitionBy(*keys, "kind").orderBy("_at", "value")
    kept = firsts.withColumn("_rank", F.row_number().over(order)).filter(F.col("_rank") <= MAX_VALUES)
    lists = kept.groupBy(*keys, "kind").agg(F.array_sort(F.collect_list(F.struct("_rank", "value"))).alias("_v"))
    by_kind = lists.groupBy(*keys).agg(
        F.map_from_entries(
            F.collect_list(F.struct("kind", F.transform("_v", lambda r: r["value"]).alias("values")))
        ).alias("_lists")
    )

    def values(kind: str) -> Column:
        return F.coalesce(F.try_element_at("_lists", F.lit(kind)), F.array().cast("array<string>")).alias(kind)

    def bare(name: str) -> Column:
        return key_value(F.col(name)).alias(name)

    return totals.join(by_kind, keys, "left").select(
        *keys,
        "first_ms",
        "last_ms",
        "event_count",
        "action",
        "outcome",
        bare("host"),
        values("users"),
        bare("process"),
        bare("parent_process"),
        values("command_lines"),
        bare("remote"),
        "remote_ports",
        values("domains"),
        values("entities"),
    )


def cited_events(links: DataFrame) -> DataFrame:
    """One row per link and event it cites."""
    title = F.when(F.col("kind") == "finding", F.col("rule_title")).otherwise(F.col("reason"))
    return links.select(
        INCIDENT,
        "link_id",
        "kind",
        "rule",
        title.alias("title"),
        "techniques",
        F.posexplode("evidence").alias("position", "event_uid"),
    )


def step_citations(members: DataFrame, links: DataFrame) -> DataFrame:
    """Which links cite each step, once each."""
    steps = members.select(INCIDENT, "step_id", "event_uid")
    return (
        cited_events(links)
        .join(steps, [INCIDENT, "event_uid"])
        .select(INCIDENT, "step_id", "link_id", "rule", "title", "techniques")
        .distinct()
    )


def unresolved_events(links: DataFrame, evidence: DataFrame) -> DataFrame:
    """Cited events without a digest: reported, never guessed at."""
    cited = cited_events(links).select(INCIDENT, "event_uid").distinct()
    return cited.join(evidence.select(INCIDENT, "event_uid"), [INCIDENT, "event_uid"], "left_anti")


def step_chain(steps: DataFrame) -> DataFrame:
    """Each step with the one that follows it in its incident; steps are ordered chunk by chunk."""
    chunk = F.floor(F.col("first_ms") / CHUNK_MS).cast("long")
    placed = steps.withColumn("_chunk", chunk)
    heads = placed.groupBy(INCIDENT, "_chunk").agg(F.min_by("step_id", F.struct("first_ms", "step_id")).alias("_head"))
    following = heads.select(
        INCIDENT, "_chunk", F.lead("_head").over(W.partitionBy(INCIDENT).orderBy("_chunk")).alias("_next_head")
    )
    in_chunk = W.partitionBy(INCIDENT, "_chunk").orderBy("first_ms", "step_id")
    return (
        placed.join(following, [INCIDENT, "_chunk"])
        .withColumn("next_step_id", F.coalesce(F.lead("step_id").over(in_chunk), F.col("_next_head")))
        .drop("_chunk", "_next_head")
    )
