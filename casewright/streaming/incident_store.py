"""Stored incidents, laid out so that a batch reads the days its activity can reach and nothing before them.

``spans/last_day=…``     one row for an incident and batch that touched it: its extent, and the day it was opened on
``links/opened=…``       its links, under the day it was opened on, which never changes
``recorded/opened=…``    the (incident, entity, event) rows it recorded, likewise

Rows are appended, each batch under its own ``batch_id`` folder, which a retry of the batch overwrites. An incident's
newest span lies in the latest of its ``last_day`` folders, so the folders from a day on hold the newest span of every
incident that was active then or later; those name the days whose links and entities are read.
"""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from casewright.functions.ids import at_millis
from casewright.operators.correlate import CORRELATION_WINDOW_MS, OPENED
from casewright.session import cut_lineage


class Reachable(NamedTuple):
    """What earlier batches left that a batch can reach."""

    links: DataFrame
    recorded: DataFrame
    spans: DataFrame


def _day(ms: Column) -> Column:
    return F.date_format(at_millis(ms), "yyyy-MM-dd")


def day_folders(spark: SparkSession, path: str) -> list[str]:
    """The values of the partition folders directly under ``path``, in order; none before the first write."""
    folder = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    system = folder.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    if not system.exists(folder):
        return []
    names = [status.getPath().getName() for status in system.listStatus(folder)]
    return sorted(name.split("=", 1)[1] for name in names if "=" in name)


def _read(spark: SparkSession, path: str, column: str, days: list[str], before: int) -> DataFrame | None:
    """Rows of these days that batches before ``before`` wrote; other folders are not even listed."""
    if not days:
        return None
    rows = spark.read.option("basePath", path).parquet(*[f"{path}/{column}={day}" for day in days])
    return rows.filter(F.col("batch_id") < before).withColumn(column, F.col(column).cast("string"))


def reachable(spark: SparkSession, path: str, earliest_ms: int, batch_id: int) -> Reachable | None:
    """Incidents of earlier batches with activity from the correlation window before ``earliest_ms`` on."""
    start = earliest_ms - CORRELATION_WINDOW_MS
    first_day = spark.range(1).select(_day(F.lit(start))).first()[0]
    days = [day for day in day_folders(spark, f"{path}/spans") if day >= first_day]
    written = _read(spark, f"{path}/spans", "last_day", days, batch_id)
    if written is None:
        return None
    newest = F.max_by(F.struct("first_ms", "last_ms", "opened"), "batch_id").alias("span")
    spans = written.groupBy("org_id", "incident_id").agg(newest).select("org_id", "incident_id", "span.*")
    spans = cut_lineage(spans.filter(F.col("last_ms") >= start))
    opened = sorted(row[0] for row in spans.select("opened").distinct().collect())  # days
    live = spans.select("incident_id")
    parts = [_read(spark, f"{path}/{name}", "opened", opened, batch_id) for name in ("links", "recorded")]
    if parts[0] is None:
        return None
    links, recorded = (part.drop("batch_id", "opened").join(live, "incident_id", "left_semi") for part in parts)
    return Reachable(links, recorded, spans)


def store(path: str, batch_id: int, links: DataFrame, recorded: DataFrame, before: Reachable | None) -> None:
    """Add a batch's links and recorded rows, and the new extents of the incidents they touch."""
    opening = links.filter(F.col("rule") == OPENED).select("incident_id", _day(F.col("first_ms")).alias("opened"))
    touched = links.groupBy("org_id", "incident_id").agg(F.min("first_ms").alias("first_ms"), F.max("last_ms").alias("last_ms"))
    if before is not None:
        opening = opening.unionByName(before.spans.select("incident_id", "opened"))
        known = before.spans.select("incident_id", F.col("first_ms").alias("_first"), F.col("last_ms").alias("_last"))
        touched = touched.join(known, "incident_id", "left").select(
            "org_id",
            "incident_id",
            F.least("first_ms", "_first").alias("first_ms"),
            F.greatest("last_ms", "_last").alias("last_ms"),
        )
    opening = cut_lineage(opening.groupBy("incident_id").agg(F.min("opened").alias("opened")))
    spans = touched.join(opening, "incident_id").withColumn("last_day", _day(F.col("last_ms")))
    for name, rows, column in (
        ("links", links.join(opening, "incident_id"), "opened"),
        ("recorded", recorded.join(opening, "incident_id"), "opened"),
        ("spans", spans, "last_day"),
    ):
        writer = rows.withColumn("batch_id", F.lit(batch_id)).write.mode("overwrite")
        writer.option("partitionOverwriteMode", "dynamic").partitionBy(column, "batch_id").parquet(f"{path}/{name}")
