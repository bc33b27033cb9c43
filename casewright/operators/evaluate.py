"""Scoring: detection over labelled recordings, and answers against key events."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from casewright.functions.scalars import covers_technique
from casewright.functions.text import is_harness_command

# --- Fixed values -----------------------------------------------------------------------------------------------
MOST_COMMON = 5
# ------------------------------------------------------------------------------------------------------------


def harness_events(events: DataFrame) -> DataFrame:
    """Events that are the test lab's own automation, by their command line."""
    return events.filter(is_harness_command(F.col("process.cmd_line"))).select(F.col("sx.event_uid").alias("event_uid"))


def judge_findings(findings: DataFrame, recordings: DataFrame, harness: DataFrame) -> DataFrame:
    """Findings of labelled recordings as ``matching``, ``harness`` (all evidence is the lab's) or ``other``.

    ``findings`` have ``recording``; ``recordings(recording, technique, purpose)``; ``harness(event_uid)``.
    """
    cited = findings.select("recording", "finding_id", F.explode("evidence").alias("event_uid"))
    own = harness.select("event_uid", F.lit(True).alias("_lab")).distinct()
    lab = cited.join(own, "event_uid", "left").groupBy("recording", "finding_id").agg(
        F.every(F.coalesce("_lab", F.lit(False))).alias("is_harness")
    )
    wanted = recordings.select("recording", F.col("technique").alias("_wanted"))
    judged = findings.join(lab, ["recording", "finding_id"], "left").join(wanted, "recording")
    covers = F.exists("techniques", lambda t: covers_technique(t, F.col("_wanted")))
    outcome = F.when(F.coalesce("is_harness", F.lit(False)), "harness").when(covers, "matching").otherwise("other")
    return judged.withColumn("outcome", outcome).drop("_wanted", "is_harness")


def scorecard(recordings: DataFrame, parsed: DataFrame, judged: DataFrame) -> DataFrame:
    """Per recording: events read, accepted, unsupported and rejected, findings by outcome, and whether it was detected.

    ``parsed(recording, kind)`` has one row per record, ``kind`` null when it was accepted.
    """
    read = parsed.groupBy("recording").agg(
        F.count("*").alias("events"),
        F.count_if(F.col("kind").isNull()).alias("accepted"),
        F.count_if(F.col("kind") == "unsupported").alias("unsupported"),
        F.count_if(F.col("kind").isin("parse_error", "invalid")).alias("rejected"),
    )
    found = judged.groupBy("recording").agg(
        *[F.count_if(F.col("outcome") == o).alias(o) for o in ("matching", "harness", "other")]
    )
    zero = F.lit(0).cast("long")
    joined = recordings.join(read, "recording", "left").join(found, "recording", "left")
    counts = ("events", "accepted", "unsupported", "rejected", "matching", "harness", "other")
    filled = joined.withColumns({c: F.coalesce(c, zero) for c in counts})
    return filled.withColumn("detected", F.col("matching") > 0)


def findings_by_rule(judged: DataFrame) -> DataFrame:
    return judged.groupBy("recording", "outcome", "rule_title").agg(F.count("*").alias("findings"))


def most_common_reasons(parsed: DataFrame, top: int = MOST_COMMON) -> DataFrame:
    """The most frequent reasons per recording and kind."""
    counted = parsed.filter(F.col("reason").isNotNull()).groupBy("recording", "kind", "reason").agg(F.count("*").alias("n"))
    order = W.partitionBy("recording", "kind").orderBy(F.col("n").desc(), "reason")
    return counted.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= top)


def set_scores(card: DataFrame) -> DataFrame:
    """Detected of recorded, per purpose."""
    return card.groupBy("purpose").agg(F.count_if("detected").alias("detected"), F.count("*").alias("recorded"))


def score_answers(grounded: DataFrame, techniques: DataFrame, key_events: DataFrame, expected: DataFrame) -> DataFrame:
    """Per analysis: key-event recall, unsupported rate, technique precision and recall.

    ``grounded`` from ``ground_statements``; ``techniques(analysis_id, technique_id)``; ``key_events(analysis_id,
    label, event_uid)`` with one row per event that would show the label; ``expected(analysis_id, technique_id)``.
    """
    kept = grounded.filter(F.col("reason").isNull()).select("analysis_id", F.explode("evidence").alias("event_uid")).distinct()
    hits = key_events.join(kept.withColumn("_cited", F.lit(1)), ["analysis_id", "event_uid"], "left")
    labels = hits.groupBy("analysis_id", "label").agg(F.max("_cited").alias("hit"))
    recall = labels.groupBy("analysis_id").agg(F.count("hit").alias("key_found"), F.count("*").alias("key_events"))
    base = F.substring_index("technique_id", ".", 1)
    suggested = techniques.select("analysis_id", base.alias("t")).distinct()
    wanted = expected.select("analysis_id", base.alias("t")).distinct()
    both = suggested.join(wanted, ["analysis_id", "t"], "left_semi").groupBy("analysis_id").agg(F.count("*").alias("techniques_right"))
    n_suggested = suggested.groupBy("analysis_id").agg(F.count("*").alias("techniques_suggested"))
    n_wanted = wanted.groupBy("analysis_id").agg(F.count("*").alias("techniques_expected"))
    totals = grounded.groupBy("analysis_id").agg(
        F.count("*").alias("statements"), F.count_if(F.col("reason").isNotNull()).alias("dropped")
    )
    joined = totals
    for part in (recall, both, n_suggested, n_wanted):
        joined = joined.join(part, "analysis_id", "left")
    counts = ("key_found", "key_events", "techniques_right", "techniques_suggested", "techniques_expected")
    filled = joined.withColumns({c: F.coalesce(c, F.lit(0).cast("long")) for c in counts})

    def ratio(a: str, b: str):
        return F.when(F.col(b) > 0, F.col(a) / F.col(b))

    return filled.withColumns(
        {
            "key_event_recall": ratio("key_found", "key_events"),
            "unsupported_rate": ratio("dropped", "statements"),
            "technique_precision": ratio("techniques_right", "techniques_suggested"),
            "technique_recall": ratio("techniques_right", "techniques_expected"),
        }
    )
