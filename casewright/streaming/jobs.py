"""Streaming jobs. Each consumer is its own query with its own checkpoint; all share the batch transforms.

Sinks are keyed: a micro-batch that is delivered again finds its rows stored, or overwrites its own folder, and
so changes nothing.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from casewright import schema as S
from casewright.functions.ids import at_millis
from casewright.operators import baseline, correlate, intel
from casewright.operators.normalize import accepted_events, parse_records, rejects_of, stamp_sources
from casewright.session import cut_lineage
from casewright.sources import sinks
from casewright.streaming import incident_store

BatchJob = Callable[[DataFrame, int], None]


def _identity() -> Column:
    """What makes two rows one event; an event ingested twice has two times of ingestion."""
    return F.struct(F.col("sx.org_id"), F.col("sx.event_uid"))


def read_events(spark: SparkSession, path: str, **options: str) -> DataFrame:
    """A stream of stored events from files; a Kafka topic of the same JSON works through ``from_json``."""
    return spark.readStream.schema(S.STORED_EVENT).options(**options).parquet(path)


def read_lines(spark: SparkSession, path: str, **options: str) -> DataFrame:
    return spark.readStream.options(**options).text(path)


def start(stream: DataFrame, job: BatchJob, checkpoint: str, *, available_now: bool = False) -> StreamingQuery:
    """Run ``job`` on every micro-batch, continuously or until the input is drained."""
    writer = stream.writeStream.foreachBatch(job).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if available_now else writer).start()


def guarded(job: BatchJob, dead_letter: str, attempts: int = sinks.MAX_ATTEMPTS) -> BatchJob:
    """Try a batch a few times, then set it aside so that it cannot hold up the ones behind it."""

    def run(batch: DataFrame, batch_id: int) -> None:
        for attempt in range(1, attempts + 1):
            try:
                return job(batch, batch_id)
            except Exception as error:  # whatever a job raises, the stream goes on
                if attempt == attempts:
                    reason = F.lit(f"{type(error).__name__}: {str(error)[:500]}")
                    aside = batch.select(F.to_json(F.struct(*batch.columns)).alias("row"), reason.alias("error"))
                    aside.write.mode("overwrite").parquet(f"{dead_letter}/batch_id={batch_id}")

    return run


def ingest_job(sources: DataFrame, events_path: str, rejects_path: str, now: Column | None = None) -> BatchJob:
    """Raw records of registered sources to the event store, rejects beside it."""

    def run(batch: DataFrame, batch_id: int) -> None:
        parsed = parse_records(stamp_sources(batch, sources), now=now).persist()
        try:
            sinks.store_events(accepted_events(parsed), events_path)
            rejects_of(parsed).write.mode("overwrite").parquet(f"{rejects_path}/batch_id={batch_id}")
        finally:
            parsed.unpersist()

    return run


def findings_job(path: str) -> BatchJob:
    """Findings to their table, each once."""

    def run(batch: DataFrame, batch_id: int) -> None:
        sinks.store_findings(batch, path)

    return run


def _stored(spark: SparkSession, path: str, before: int) -> DataFrame | None:
    """What earlier batches wrote; a retried batch does not read its own first try."""
    table = sinks._table(spark, path)
    if table is None:
        return None
    earlier = table.filter(F.col("batch_id") < before).drop("batch_id")
    return None if earlier.isEmpty() else earlier


def baseline_job(path: str) -> BatchJob:
    """Baselines of each batch in its own folder; ``read_baselines`` merges them."""

    def run(batch: DataFrame, batch_id: int) -> None:
        unique = sinks.first_copies(batch, _identity()) if "sx" in batch.columns else batch
        baseline.observe(unique).write.mode("overwrite").parquet(f"{path}/batch_id={batch_id}")

    return run


def read_baselines(spark: SparkSession, path: str) -> DataFrame:
    return baseline.merge_baselines(spark.read.parquet(path).drop("batch_id"))


def _cited(stored: DataFrame, found: DataFrame) -> DataFrame:
    """The stored events that findings cite: the date partitions they can lie in, then those events alone."""
    if "event_date" in stored.columns:
        span = found.agg(F.min("first_ms"), F.max("last_ms")).first()
        if span[0] is not None:
            day = lambda ms: F.to_date(at_millis(F.lit(ms)))
            stored = stored.filter(F.col("event_date").between(day(span[0]), day(span[1])))
    wanted = found.select(F.col("org_id").alias("_org"), F.explode("evidence").alias("_uid")).distinct()
    same = (F.col("sx.org_id") == F.col("_org")) & (F.col("sx.event_uid") == F.col("_uid"))
    return stored.join(wanted, same, "left_semi")


def correlation_job(find: Callable[[DataFrame], DataFrame], events_path: str, state_path: str) -> BatchJob:
    """Link each batch's findings and logons to the incidents earlier batches left open.

    ``find`` gives the findings of a batch of events. Of the stored incidents a batch reads those that were active
    within the window of its findings and logons; see ``incident_store``. What a batch adds goes to its own folders, so
    writing it twice leaves one copy.
    """

    def run(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        stored = sinks._table(spark, events_path)
        found = cut_lineage(find(batch))
        logons = correlate.logons(batch).select(F.min("at_ms").alias("at_ms"))
        first = found.select(F.min("first_ms").alias("at_ms")).unionByName(logons).agg(F.min("at_ms")).first()[0]
        if first is None:
            return  # nothing that could link
        # Evidence may lie in earlier batches: what the findings cite is read back from the store.
        events = batch if stored is None else _cited(stored, found).select(*batch.columns).unionByName(batch)
        events = sinks.first_copies(events, _identity())
        before = incident_store.reachable(spark, state_path, first, batch_id)
        links, recorded = correlate.link_batch(
            found,
            events,
            before and before.links,
            before and before.recorded,
            batch_id,
            arrived=batch,
        )
        incident_store.store(state_path, batch_id, links, recorded, before)

    return run


def read_incidents(spark: SparkSession, state_path: str, events: DataFrame) -> correlate.Incidents:
    """The incident tables over everything the correlation job has written."""
    links = spark.read.parquet(f"{state_path}/links").drop("batch_id", "opened")
    recorded = spark.read.parquet(f"{state_path}/recorded").drop("batch_id", "opened")
    return correlate.incident_tables(links, recorded, events)


def enrichment_job(provider_rows: DataFrame, provider: str, path: str, now_ms: Column, ttl_ms: int) -> BatchJob:
    """Answers for the indicators of each batch that have none that is fresh.

    Every distinct indicator of a batch is asked about: a provider is a table, so there is no reason to ask
    for a few at a time.
    """

    def run(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        cached = _stored(spark, path, batch_id)
        asked = batch.select(intel.parse_indicator(F.col("key")).alias("i")).filter("i is not null").select("i.*").distinct()
        answers = intel.enrich(asked, provider_rows, cached, provider, now_ms, ttl_ms)
        answers.write.mode("overwrite").parquet(f"{path}/batch_id={batch_id}")

    return run
