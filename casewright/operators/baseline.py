"""What an organisation has seen before: counted observations, and what is new about an incident."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from casewright.functions import net, scalars
from casewright.functions.ids import at_millis
from casewright.operators.entities import external_keys, first_of, key_value, role, with_roles

# --- Fixed values -----------------------------------------------------------------------------------------------
PROCESS_PAIR, REMOTE, HOST_REMOTE = "process_pair", "remote", "host_remote"
# ------------------------------------------------------------------------------------------------------------


def _observation(kind: str, key: Column) -> Column:
    return F.struct(F.lit(kind).alias("kind"), key.alias("key"))


def _observed(pair: Column, remotes: Column, host: Column) -> Column:
    per_remote = F.flatten(
        F.transform(
            remotes,
            lambda r: F.filter(
                F.array(
                    _observation(REMOTE, r),
                    _observation(HOST_REMOTE, F.concat(host, F.lit(" -> "), r)),
                ),
                lambda o: o["key"].isNotNull(),
            ),
        )
    )
    first = F.filter(F.array(_observation(PROCESS_PAIR, pair)), lambda o: o["key"].isNotNull())
    return F.concat(first, per_remote)


def observations(events: DataFrame) -> DataFrame:
    """One row per event and counted thing: parent → child, external remote, host → remote.

    The host is the first our side of the event names, which is what a digest keeps, so the two agree.
    """
    child = F.lower(scalars.blank_to_null(F.col("process.name")))
    parent = F.lower(scalars.blank_to_null(F.col("process.parent_process.name")))
    marked = with_roles(
        events.filter(F.col("time_ms").isNotNull()),
        F.col("sx.org_id").alias("org_id"),
        "time_ms",
        F.concat(parent, F.lit(" -> "), child).alias("pair"),
    )
    remote = F.filter(
        "roles",
        lambda e: ((e["type"] == "ip") & e["links"] & (e["field"] != "device.ip")) | (e["type"] == "domain"),
    )
    remotes = F.array_distinct(F.transform(remote, lambda e: e["value"]))
    host = F.get(F.filter("roles", lambda e: e["role"] == "host"), F.lit(0))["value"]
    return _listed(marked.select("org_id", "time_ms", _observed(F.col("pair"), remotes, host).alias("seen")))


def _listed(rows: DataFrame) -> DataFrame:
    """One row per element of ``seen``."""
    others = [c for c in rows.columns if c != "seen"]
    exploded = rows.select(*others, F.explode_outer("seen").alias("o")).filter(F.col("o").isNotNull())
    return exploded.select(*others, "o.kind", "o.key")


def evidence_observations(evidence: DataFrame, *scope: str) -> DataFrame:
    """The same keys read from evidence digests; the two have to agree."""
    pair = F.concat(
        F.lower(key_value(first_of("parent_process"))), F.lit(" -> "), F.lower(key_value(first_of("process")))
    )
    addresses = external_keys(F.concat(role("dst_ip"), role("src_ip"), role("answer")))
    remotes = F.array_distinct(F.transform(F.concat(addresses, role("domain")), key_value))
    host = key_value(first_of("host"))
    seen = _observed(pair, remotes, host).alias("seen")
    return _listed(evidence.select(*scope, "org_id", "event_uid", "time_ms", seen))


def observe(events: DataFrame) -> DataFrame:
    """Baselines of a batch: how often each thing was seen, first and last, in the events' own time.

    Events are unique by id once stored, so counting rows counts events. Partial aggregation reduces a hot
    key before the shuffle.
    """
    return observations(events).groupBy("org_id", "kind", "key").agg(
        F.count("*").alias("observations"), F.min("time_ms").alias("first_ms"), F.max("time_ms").alias("last_ms")
    )


def merge_baselines(*parts: DataFrame) -> DataFrame:
    """Baselines of several batches as one."""
    rows = parts[0]
    for part in parts[1:]:
        rows = rows.unionByName(part)
    return rows.groupBy("org_id", "kind", "key").agg(
        F.sum("observations").alias("observations"), F.min("first_ms").alias("first_ms"), F.max("last_ms").alias("last_ms")
    )


def coverage_span(baselines: DataFrame) -> DataFrame:
    """Since when and until when each organisation has been watched."""
    return baselines.groupBy("org_id").agg(F.min("first_ms").alias("first_ms"), F.max("last_ms").alias("last_ms"))


def novelty(evidence: DataFrame, baselines: DataFrame, incidents: DataFrame) -> DataFrame:
    """Per incident and observation: how often it was seen, since when, and whether it is new here.

    ``evidence`` are digests with ``incident_id``; ``incidents`` give each incident's ``first_ms``.
    """
    keys = evidence_observations(evidence, "incident_id").select("incident_id", "org_id", "kind", "key").distinct()
    started = incidents.select("incident_id", F.col("first_ms").alias("incident_first_ms"))
    known = baselines.select("org_id", "kind", "key", "observations", "first_ms")
    seen = keys.join(known, ["org_id", "kind", "key"], "left").join(started, "incident_id")
    new_here = F.col("first_ms").isNull() | (F.col("first_ms") >= F.col("incident_first_ms"))
    day = F.date_format(at_millis(F.col("first_ms")), "yyyy-MM-dd")
    times = F.coalesce("observations", F.lit(0)).cast("string")
    sentence = (
        F.when(F.col("first_ms").isNull(), F.concat(F.col("key"), F.lit(": never seen outside this incident")))
        .when(
            new_here,
            F.concat(F.col("key"), F.lit(": first seen in this incident ("), day, F.lit("), "), times, F.lit(" times since")),
        )
        .otherwise(F.concat(F.col("key"), F.lit(": seen "), times, F.lit(" times, first on "), day))
    )
    return seen.select(
        "incident_id",
        "org_id",
        "kind",
        "key",
        F.coalesce("observations", F.lit(0)).alias("observations"),
        "first_ms",
        new_here.alias("new_here"),
        sentence.alias("sentence"),
    )


def novelty_order() -> list[Column]:
    """New first, rarest first, then by key."""
    return [F.col("new_here").desc(), F.col("observations").asc(), F.col("key").asc()]
