"""The analyst's desk: status changes, summaries, what needs attention, and the rule catalogue."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

# --- Fixed values -----------------------------------------------------------------------------------------------
STATUSES = ("new", "investigating", "closed")
RESOLUTIONS = ("true_positive", "benign_positive", "false_positive")
MAX_TITLES = 5
MAX_ANALYSES = 20
# ------------------------------------------------------------------------------------------------------------


def check_status_changes(requests: DataFrame, incidents: DataFrame) -> DataFrame:
    """Requested status changes with the reason each is refused, null where it is accepted.

    ``requests(request_id, incident_id, status, resolution, version)`` against ``incidents(incident_id, status,
    resolution, version)``.
    """
    current = incidents.select(
        "incident_id",
        F.col("status").alias("_status"),
        F.col("resolution").alias("_resolution"),
        F.col("version").alias("_version"),
    )
    closing = F.col("status") == "closed"
    refusal = (
        F.when(F.col("_status").isNull(), "no such incident")
        .when(F.col("version") != F.col("_version"), "the incident changed since it was loaded")
        .when(closing & F.col("resolution").isNull(), "closing needs a resolution")
        .when(~closing & F.col("resolution").isNotNull(), "only closed incidents have a resolution")
        .when(
            (F.col("status") == F.col("_status")) & F.col("resolution").eqNullSafe(F.col("_resolution")),
            F.concat(F.lit("the incident is already "), F.col("status")),
        )
        .when((F.col("status") == "new") & (F.col("_status") != "new"), "an incident cannot go back to new")
    )
    accepted = refusal.isNull()
    return requests.join(current, "incident_id", "left").select(
        *requests.columns,
        accepted.alias("accepted"),
        refusal.alias("refusal"),
        F.when(accepted, F.col("_version") + 1).alias("new_version"),
    )


def triage_summary(incidents: DataFrame) -> DataFrame:
    """Open, open and at least high, under investigation, and events behind the open incidents."""
    is_open = F.col("status") != "closed"
    return incidents.agg(
        F.count_if(is_open).alias("open"),
        F.count_if(is_open & (F.col("severity_id") >= 4)).alias("high_or_critical"),
        F.count_if(F.col("status") == "investigating").alias("investigating"),
        F.coalesce(F.sum(F.when(is_open, F.col("event_count"))), F.lit(0)).cast("long").alias("events"),
    )


def needs_attention(incidents: DataFrame, top: int = 5) -> DataFrame:
    """The open incidents to look at first: most severe, then most recent."""
    return (
        incidents.filter(F.col("status") != "closed")
        .orderBy(F.col("severity_id").desc(), F.col("last_ms").desc(), F.col("incident_id"))
        .limit(top)
    )


def latest_analyses(analyses: DataFrame, keep: int = MAX_ANALYSES) -> DataFrame:
    """The newest analyses of each incident."""
    order = W.partitionBy("incident_id").orderBy(F.col("created_ms").desc(), F.col("analysis_id").desc())
    return analyses.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= keep)


# ------------------------------------------------------------------------------------------------- rule catalogue
def technique_coverage(rules: DataFrame, community_prefix: str = "community/") -> DataFrame:
    """Per technique: how many rules name it, own and community, and the first five titles."""
    named = rules.select("title", "path", F.explode("techniques").alias("t")).withColumn("technique_id", F.upper("t"))
    community = F.col("path").startswith(community_prefix)
    order = W.partitionBy("technique_id").orderBy("title", "path")
    titles = (
        named.withColumn("_rank", F.row_number().over(order))
        .filter(F.col("_rank") <= MAX_TITLES)
        .groupBy("technique_id")
        .agg(F.transform(F.array_sort(F.collect_list(F.struct("_rank", "title"))), lambda r: r["title"]).alias("titles"))
    )
    counts = named.groupBy("technique_id").agg(
        F.count("*").alias("rules"), F.count_if(~community).alias("own"), F.count_if(community).alias("community")
    )
    return counts.join(titles, "technique_id")


def tactic_coverage(rules: DataFrame) -> DataFrame:
    return rules.select(F.explode("tactics").alias("tactic")).groupBy("tactic").agg(F.count("*").alias("rules"))


def coverage_totals(rules: DataFrame) -> DataFrame:
    """Rules, rules naming no technique, techniques and sub-techniques named."""
    named = rules.select(F.explode("techniques").alias("t")).select(F.upper("t").alias("t")).distinct()
    return rules.agg(F.count("*").alias("rules"), F.count_if(F.size("techniques") == 0).alias("untagged")).withColumns(
        {
            "techniques": named.agg(F.count("*")).scalar(),
            "sub_techniques": named.agg(F.count_if(F.col("t").contains("."))).scalar(),
        }
    )
