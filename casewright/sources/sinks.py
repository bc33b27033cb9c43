"""Where rows end up: create-only event tables, finding and incident tables, rejects, reports, retention."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from casewright import schema as S

# --- Fixed values -----------------------------------------------------------------------------------------------
DEFAULT_RETENTION_DAYS = 90
MAX_REPORTED_ERRORS = 50
STALE_AFTER_MS = 15 * 60_000
MAX_ATTEMPTS = 5
# ------------------------------------------------------------------------------------------------------------


def _table(spark: SparkSession, path: str) -> DataFrame | None:
    """The Parquet table at ``path``, None before its first row: an empty partitioned write leaves no data file."""
    jvm = spark.sparkContext._jvm
    folder = jvm.org.apache.hadoop.fs.Path(path)
    system = folder.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    if not system.exists(folder) or all(s.getPath().getName().startswith(("_", ".")) for s in system.listStatus(folder)):
        return None
    return spark.read.parquet(path)


def first_copies(events: DataFrame, key: Column | None = None) -> DataFrame:
    """One row per fingerprint, the first ingested, of several the one with the smallest ids and raw digest. Spark keeps
    the first row of each task before the shuffle, so a record repeated for a third of all rows sends one row per task."""
    fingerprint = F.col("sx.fingerprint") if key is None else key
    raw = [F.md5(F.col("raw_data").cast("binary"))] if "raw_data" in events.columns else []
    order = W.partitionBy("_fp").orderBy("sx.ingested_at", "sx.org_id", "sx.source_id", "sx.event_uid", *raw)
    ranked = events.withColumn("_fp", fingerprint).withColumn("_rank", F.row_number().over(order))
    return ranked.filter(F.col("_rank") == 1).drop("_fp", "_rank")


def _storable() -> Column:
    """An event needs a fingerprint, which is its identity, and a time, which decides where it is stored."""
    return F.col("sx.fingerprint").isNotNull() & F.col("time").isNotNull()


def new_events(batch: DataFrame, stored: DataFrame | None) -> DataFrame:
    """The batch's events the store does not hold yet and can hold; what is stored is never rewritten."""
    unique = first_copies(batch.filter(_storable()))
    if stored is None:
        return unique
    # Content decides the date, so only the partitions the batch touches are compared.
    keys = stored.select(F.col("sx.fingerprint").alias("_known"), *[c for c in ("event_date",) if c in stored.columns])
    if "event_date" in keys.columns:
        dates = batch.select(F.to_date("time").alias("event_date")).distinct()
        keys = keys.join(dates, "event_date", "left_semi").drop("event_date")
    return unique.join(keys, F.col("sx.fingerprint") == F.col("_known"), "left_anti")


def with_partitions(events: DataFrame) -> DataFrame:
    return events.withColumns({"category": S.lookup(S.CATEGORY_SLUGS, F.col("category_uid")), "event_date": F.to_date("time")})


def store_events(batch: DataFrame, path: str) -> None:
    """Append new events, partitioned by category and date."""
    fresh = new_events(batch, _table(batch.sparkSession, path))
    with_partitions(fresh).write.mode("append").partitionBy("category", "event_date").parquet(path)


def index_outcome(batch: DataFrame, stored: DataFrame | None) -> DataFrame:
    """How many of a batch are new, how many duplicates, within it or of stored events, and how many cannot be stored."""
    failed = batch.agg(F.count_if(~_storable()).alias("failed"))
    copies = batch.filter(_storable()).groupBy(F.col("sx.fingerprint").alias("fingerprint")).agg(F.count("*").alias("copies"))
    if stored is not None:
        known = stored.select(F.col("sx.fingerprint").alias("fingerprint"), F.lit(1).alias("known")).distinct()
        copies = copies.join(known, "fingerprint", "left")
    else:
        copies = copies.withColumn("known", F.lit(None).cast("int"))
    fresh = F.col("known").isNull()
    counted = copies.agg(
        F.count_if(fresh).alias("indexed"),
        F.coalesce(F.sum(F.col("copies") - F.when(fresh, 1).otherwise(0)), F.lit(0)).cast("long").alias("duplicates"),
    )
    return counted.join(failed)  # one row each


def retain(events: DataFrame, as_of: Column, days: int = DEFAULT_RETENTION_DAYS) -> DataFrame:
    """The events still inside the retention period: a partition filter."""
    return events.filter(F.col("event_date") >= F.date_sub(as_of, days))


def new_findings(batch: DataFrame, stored: DataFrame | None) -> DataFrame:
    """Findings not stored yet, one per (org, finding id)."""
    unique = batch.dropDuplicates(["org_id", "finding_id"])
    return unique if stored is None else unique.join(stored.select("org_id", "finding_id"), ["org_id", "finding_id"], "left_anti")


def store_findings(batch: DataFrame, path: str) -> None:
    new_findings(batch, _table(batch.sparkSession, path)).write.mode("append").partitionBy("org_id").parquet(path)


def merge_entities(stored: DataFrame, new: DataFrame, cap: int = 20) -> DataFrame:
    """Incident entities of two batches as one: widest times, stored events first, at most ``cap`` events."""
    both = stored.withColumn("_batch", F.lit(0)).unionByName(new.withColumn("_batch", F.lit(1)))
    keys = ["incident_id", "org_id", "entity_key", "entity_type", "entity_value", "links"]
    merged = both.groupBy(*keys).agg(
        F.min("first_ms").alias("first_ms"),
        F.max("last_ms").alias("last_ms"),
        F.array_sort(F.collect_list(F.struct("_batch", "events"))).alias("_lists"),  # two rows per key at most
    )
    events = F.array_distinct(F.flatten(F.transform("_lists", lambda r: r["events"])))
    return merged.withColumn("events", F.slice(events, 1, cap)).drop("_lists")


def new_links(batch: DataFrame, stored: DataFrame | None) -> DataFrame:
    """Links whose finding or event is not linked yet."""
    if stored is None:
        return batch
    linked = stored.select(F.coalesce("finding_id", F.concat_ws("|", "incident_id", "event_uid")).alias("_item"))
    item = F.coalesce("finding_id", F.concat_ws("|", "incident_id", "event_uid"))
    return batch.withColumn("_item", item).join(linked, "_item", "left_anti").drop("_item")


def store_rejects(rejects: DataFrame, path: str) -> None:
    rejects.write.mode("append").partitionBy("source_id").parquet(path)


def ingest_report(parsed: DataFrame) -> DataFrame:
    """Per source: accepted, rejected, the first 50 errors by position, the last event time.

    The errors are cut to 50 by rank before they are gathered.
    """
    from pyspark.sql import Window as W

    totals = parsed.groupBy("source_id").agg(
        F.count_if(F.col("problem").isNull()).alias("accepted"),
        F.count_if(F.col("problem").isNotNull()).alias("rejected"),
        F.max(F.when(F.col("problem").isNull(), F.unix_millis("time"))).alias("last_event_ms"),
    )
    order = W.partitionBy("source_id").orderBy("position")
    errors = (
        parsed.filter(F.col("problem").isNotNull())
        .select("source_id", "position", "problem.reason")
        .withColumn("_rank", F.row_number().over(order))
        .filter(F.col("_rank") <= MAX_REPORTED_ERRORS)
        .groupBy("source_id")
        .agg(F.array_sort(F.collect_list(F.struct("position", "reason"))).alias("errors"))
    )
    return totals.join(errors, "source_id", "left")


def source_health(sources: DataFrame, now_ms: Column, stale_after_ms: int = STALE_AFTER_MS) -> DataFrame:
    """Disabled, erroring, awaiting data, stale or healthy, from the last event and the last error."""
    recent_error = F.col("last_error_ms").isNotNull() & (now_ms - F.col("last_error_ms") < stale_after_ms)
    after_events = F.col("last_event_ms").isNull() | (F.col("last_error_ms") > F.col("last_event_ms"))
    health = (
        F.when(~F.col("is_enabled"), "disabled")
        .when(recent_error & after_events, "erroring")
        .when(F.col("last_event_ms").isNull(), "awaiting_data")
        .when(now_ms - F.col("last_event_ms") > stale_after_ms, "stale")
        .otherwise("healthy")
    )
    return sources.withColumn("health", health)


def latency(events: DataFrame, now_ms: Column) -> DataFrame:
    """Age of events since ingestion and since they happened, floored at zero, per source."""
    lag = F.greatest(F.lit(0), now_ms - F.unix_millis("sx.ingested_at"))
    age = F.greatest(F.lit(0), now_ms - F.col("time_ms"))
    return events.groupBy(F.col("sx.source_id").alias("source_id")).agg(
        F.max(lag).alias("max_lag_ms"),
        F.percentile_approx(lag, 0.5, 10_000).alias("median_lag_ms"),
        F.max(age).alias("max_age_ms"),
        F.percentile_approx(age, 0.5, 10_000).alias("median_age_ms"),
    )
