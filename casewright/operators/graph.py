"""Entity graph: nodes and edges, each edge stated by a single event.

``scope`` names what the graph is grouped by: ``incident_id`` for incident graphs, nothing for a whole table.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from casewright import schema as S
from casewright.functions import net
from casewright.operators.entities import external_keys, key_value, role

# --- Fixed values -----------------------------------------------------------------------------------------------
MAX_EVENTS = 20
RELATION_LABELS = {
    "failed_logon": "failed logon to",
    "logon": "logged on to",
    "failed_logon_as": "failed logon as",
    "logon_as": "logged on as",
    "ran_as": "ran processes as",
    "started": "started",
    "spawned": "spawned",
    "image": "image",
    "hash": "hash",
    "connected_to": "connected to",
    "named": "named in the record as",
    "queried": "queried",
    "resolved_to": "resolved to",
    "file_activity": "file activity",
    "opened": "opened",
    "injected_into": "injected a thread into",
}
TYPE_ORDER = ("ip", "host", "user", "process", "file", "hash", "domain")
# ------------------------------------------------------------------------------------------------------------

_RELATION = "array<struct<source:string,relation:string,target:string>>"


def _pairs(relation: str, sources: Column, targets: Column) -> Column:
    """Source × target of one event, without self pairs; both sides are the handful one event names."""
    linked = F.transform(
        sources,
        lambda s: F.transform(
            targets, lambda t: F.struct(s.alias("source"), F.lit(relation).alias("relation"), t.alias("target"))
        ),
    )
    return F.filter(F.flatten(linked), lambda p: p["source"] != p["target"])


def _or_else(first: Column, second: Column) -> Column:
    return F.when(F.size(first) > 0, first).otherwise(second)


def relations() -> Column:
    """Everything one evidence digest states, as (source, relation, target)."""
    none = F.array().cast(_RELATION)
    class_uid, activity = F.col("class_uid"), F.col("activity_id")
    host, user, process, file = role("host"), role("user"), role("process"), role("file")
    actor, domain = role("actor_process"), role("domain")
    launch = activity.isNull() | (activity == 1)
    remote = _or_else(
        _or_else(external_keys(F.concat(role("dst_ip"), role("src_ip"))), role("dst_host")), role("dst_ip")
    )

    def logon(prefix: str) -> Column:
        return F.concat(_pairs(prefix, role("src_ip"), host), _pairs(f"{prefix}_as", host, user))

    is_logon = (class_uid == S.AUTHENTICATION) & (activity == 1)
    is_process = class_uid == S.PROCESS_ACTIVITY
    return F.coalesce(
        F.when(is_logon & (F.col("outcome") == "success"), logon("logon"))
        .when(is_logon & (F.col("outcome") == "failure"), logon("failed_logon"))
        .when(is_process & (activity == 3), _pairs("opened", actor, process))
        .when(is_process & (activity == 4), _pairs("injected_into", actor, process))
        .when(
            is_process,
            F.concat(
                _pairs("ran_as", host, user),
                F.when(
                    launch,
                    F.concat(
                        _pairs("started", _or_else(user, host), process),
                        _pairs("spawned", role("parent_process"), process),
                    ),
                ).otherwise(none),
                _pairs("image", process, file),
                _pairs("hash", file, role("hash")),
            ),
        )
        .when(
            class_uid.isin(S.NETWORK_ACTIVITY, S.HTTP_ACTIVITY),
            F.concat(
                _pairs("connected_to", host, remote),
                _pairs("connected_to", actor, remote),
                _pairs("named", remote, domain),
            ),
        )
        .when(
            class_uid == S.DNS_ACTIVITY,
            F.concat(
                _pairs("queried", host, domain),
                _pairs("queried", actor, domain),
                _pairs("resolved_to", domain, role("answer")),
            ),
        )
        .when(
            class_uid == S.FILE_ACTIVITY,
            F.concat(
                _pairs("file_activity", host, file),
                _pairs("file_activity", actor, file),
                _pairs("hash", file, role("hash")),
            ),
        ),
        none,
    )


def event_relations(evidence: DataFrame, scope: Sequence[str] = ()) -> DataFrame:
    """One row per event and relation."""
    listed = evidence.select(
        *scope, "event_uid", "time_ms", "dst_port", F.explode_outer(F.array_distinct(relations())).alias("r")
    )
    return listed.filter(F.col("r").isNotNull()).select(
        *scope, "event_uid", "time_ms", "dst_port", "r.source", "r.relation", "r.target"
    )


def edges(evidence: DataFrame, scope: Sequence[str] = ()) -> DataFrame:
    """Edges with first/last time, distinct event count, the first 20 events and the ports used."""
    keys = [*scope, "source", "relation", "target"]
    rows = event_relations(evidence, scope)
    totals = rows.groupBy(*keys).agg(
        F.min("time_ms").alias("first_ms"),
        F.max("time_ms").alias("last_ms"),
        F.count("*").alias("event_count"),
        F.array_sort(F.collect_set(F.when(F.col("relation") == "connected_to", F.col("dst_port")))).alias("ports"),
    )
    label = S.lookup(RELATION_LABELS, F.col("relation"))
    return (
        totals.join(_first_events(rows, keys), keys)
        .withColumn("edge_id", F.concat_ws("|", "source", "relation", "target"))
        .withColumn("label", label)
        .select(*scope, "edge_id", "source", "relation", "target", "label", "first_ms", "last_ms", "event_count", "events", "ports")
    )


def _first_events(rows: DataFrame, keys: Sequence[str]) -> DataFrame:
    """The first 20 events per key; rows hold each (key, event) once."""
    order = W.partitionBy(*keys).orderBy("time_ms", "event_uid")
    ranked = rows.select(*keys, "event_uid", "time_ms").withColumn("_rank", F.row_number().over(order))
    listed = ranked.filter(F.col("_rank") <= MAX_EVENTS).groupBy(*keys).agg(
        F.array_sort(F.collect_list(F.struct("_rank", "event_uid"))).alias("_ranked")
    )
    return listed.withColumn("events", F.transform("_ranked", lambda r: r["event_uid"])).drop("_ranked")


def nodes(evidence: DataFrame, scope: Sequence[str] = ()) -> DataFrame:
    """Both ends of every edge, with the same roll-up."""
    ends = event_relations(evidence, scope).select(
        *scope, "event_uid", "time_ms", F.explode(F.array("source", "target")).alias("key")
    )
    keys = [*scope, "key"]
    # An entity can sit in several relations of one event; it counts that event once.
    per_event = ends.groupBy(*keys, "event_uid").agg(F.first("time_ms").alias("time_ms"))
    totals = per_event.groupBy(*keys).agg(
        F.min("time_ms").alias("first_ms"), F.max("time_ms").alias("last_ms"), F.count("*").alias("event_count")
    )
    kind, value = F.substring_index("key", ":", 1), key_value(F.col("key"))
    external = ((kind == "ip") & net.is_external_ip(value)) | (kind == "domain")
    return (
        totals.join(_first_events(per_event, keys), keys)
        .withColumns({"type": kind, "value": value, "external": external})
        .select(*scope, "key", "type", "value", "external", "first_ms", "last_ms", "event_count", "events")
    )


def node_order() -> list[Column]:
    """Where an attack usually starts to where it ends, external first, then first seen."""
    position = F.array_position(F.array(*[F.lit(t) for t in TYPE_ORDER]), F.col("type"))
    rank = F.when(position == 0, len(TYPE_ORDER) + 1).otherwise(position)
    return [rank.asc(), F.col("external").desc(), F.col("first_ms").asc(), F.col("key").asc()]


def edge_order() -> list[Column]:
    return [F.col("first_ms").asc(), F.col("edge_id").asc()]


def connections(edge_rows: DataFrame, scope: Sequence[str] = ()) -> DataFrame:
    """Edges between the same two entities merged: their labels with counts, events, ports and total."""
    ports = F.concat_ws(",", F.transform("ports", lambda p: p.cast("string")))
    detail = F.when(F.size("ports") > 0, F.concat(F.col("label"), F.lit(" :"), ports)).otherwise(F.col("label"))
    text = F.concat(detail, F.lit(" ("), F.col("event_count").cast("string"), F.lit(")"))
    # At most one row per relation meets here: 16 relations, 20 events and the port numbers each.
    return edge_rows.groupBy(*scope, "source", "target").agg(
        F.transform(
            F.array_sort(F.collect_list(F.struct("first_ms", "edge_id", text.alias("text")))), lambda r: r["text"]
        ).alias("labels"),
        F.array_distinct(
            F.flatten(
                F.transform(
                    F.array_sort(F.collect_list(F.struct("first_ms", "edge_id", "events"))), lambda r: r["events"]
                )
            )
        ).alias("events"),
        F.array_sort(F.array_distinct(F.flatten(F.collect_list("ports")))).alias("ports"),
        F.sum("event_count").alias("event_count"),
    )
