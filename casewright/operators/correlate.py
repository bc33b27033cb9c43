"""Correlation: findings and the logons that complete them, joined into incidents with the reason for each link.

Shared-entity rule: findings are taken in order of first activity; each joins the open incident it shares the
most linking entities with, if their activity overlaps within two hours, and opens a new one otherwise. The
outcome depends on the order, so it is a fold; what makes it parallel is that findings which cannot reach each
other, through entities or in time, are folded apart.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator
from typing import NamedTuple

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from casewright.functions.ids import SEPARATOR, digest
from casewright.operators import entities as E
from casewright.operators.predicates import is_successful_logon
from casewright.session import cut_lineage

# --- Fixed values: windows, caps, rule names, severities, title phrases ------------------------------------------
CORRELATION_WINDOW_MS = 2 * 3_600_000
AUTH_SEQUENCE_WINDOW_MS = 3_600_000
BRUTE_FORCE = "T1110"
MAX_ENTITY_EVENTS = 20
MAX_MATCH_EVENTS = 5
MULTI_STAGE_TACTICS = 3
HIGH, CRITICAL = 4, 5
OPENED, SHARED_ENTITY, AUTH_SUCCESS = "opened", "shared-entity", "auth-success-after-failures"
INTEL_TYPES = ("ip", "domain", "hash")
TITLE_COMPROMISE = "Successful logon after repeated failures"
TITLE_DEFAULT = "Correlated findings"
MAX_TITLE = 255
# ------------------------------------------------------------------------------------------------------------
HOUR_MS = 3_600_000


class Incidents(NamedTuple):
    incidents: DataFrame
    links: DataFrame
    entities: DataFrame
    evidence: DataFrame
    assessments: DataFrame
    assessment_links: DataFrame


# ------------------------------------------------------------------------------------------------- components
def connected_components(edges: DataFrame) -> DataFrame:
    """``node → component`` of an undirected graph given as ``a, b`` pairs; the component is its least node.

    Each round hooks every label to its smallest neighbour, follows the pointers, and contracts the edges, so
    the edge set shrinks quickly and no vertex's neighbours are ever gathered. Rounds are checkpointed.
    """
    pairs = edges.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
    nodes = pairs.select(F.explode(F.array("a", "b")).alias("node")).distinct()
    labels = cut_lineage(nodes.withColumn("component", F.col("node")))
    live = cut_lineage(pairs.filter(F.col("a") != F.col("b")))
    while not live.isEmpty():
        hooks = live.groupBy(F.col("b").alias("label")).agg(F.min("a").alias("to"))
        # Two pointer jumps: a label that hooked to another hooked label goes to its target.
        for _ in range(2):
            ahead = hooks.select(F.col("label").alias("to"), F.col("to").alias("further"))
            hooks = hooks.join(ahead, "to", "left").select("label", F.coalesce("further", "to").alias("to"))
        labels = cut_lineage(
            labels.join(hooks, labels["component"] == hooks["label"], "left").select(
                "node", F.coalesce("to", "component").alias("component")
            )
        )

        def moved(frame: DataFrame, side: str, hooks: DataFrame = hooks) -> DataFrame:
            target = hooks.select(F.col("label").alias(side), F.col("to").alias("_to"))
            return frame.join(target, side, "left").withColumn(side, F.coalesce("_to", side)).drop("_to")

        both = moved(moved(live, "a"), "b").filter(F.col("a") != F.col("b"))
        live = cut_lineage(both.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct())
    return labels


def fold_groups(keyed: DataFrame, passes: int = 2) -> DataFrame:
    """``item_id → fold_group``: findings in different groups can never meet in an incident.

    ``keyed`` has one row per finding with ``org_id, item_id, first_ms, last_ms, keys``. Findings are grouped
    by connected linking keys, groups are cut where nothing was active for the correlation window, and what
    the cuts separate is grouped again. The fold is exact after any number of passes; more passes make
    smaller groups.
    """
    items = cut_lineage(keyed.select("item_id", "first_ms", "last_ms", "keys", F.col("org_id").alias("fold_group")))
    for _ in range(passes):
        node = lambda key: F.concat_ws(SEPARATOR, "fold_group", key)
        edges = items.select(node(F.get("keys", F.lit(0))).alias("a"), F.explode("keys").alias("_key"), "fold_group").select(
            "a", node(F.col("_key")).alias("b")
        )
        found = connected_components(edges)
        grouped = items.withColumn("node", node(F.get("keys", F.lit(0)))).join(found, "node").drop("node", "fold_group")
        hour = F.floor(F.col("first_ms") / HOUR_MS).cast("long")
        hourly = grouped.groupBy("component", hour.alias("hour")).agg(
            F.min("first_ms").alias("first_ms"), F.max("last_ms").alias("last_ms")
        )
        # One row per component and hour: two findings of one hour are never further apart than the window.
        so_far = W.partitionBy("component").orderBy("hour").rowsBetween(W.unboundedPreceding, -1)
        quiet = F.col("first_ms") - F.max("last_ms").over(so_far) > CORRELATION_WINDOW_MS
        islands = hourly.withColumn("_cut", F.coalesce(quiet, F.lit(False)).cast("int")).select(
            "component",
            "hour",
            F.sum("_cut").over(W.partitionBy("component").orderBy("hour").rowsBetween(W.unboundedPreceding, 0)).alias("island"),
        )
        items = cut_lineage(
            grouped.withColumn("hour", hour)
            .join(islands, ["component", "hour"])
            .select(
                "item_id",
                "first_ms",
                "last_ms",
                "keys",
                F.sha2(F.concat_ws(SEPARATOR, "component", F.col("island").cast("string")), 256).alias("fold_group"),
            )
        )
    return items.select("item_id", "fold_group")


# ------------------------------------------------------------------------------------------------------- fold
def _fold(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Assign findings to incidents, group by group, in order of first activity.

    Only incidents that a later finding can still reach are held: rows come sorted, so an incident whose
    activity ended more than the window before the current finding is forgotten.
    """
    group = None
    open_: dict[int, list] = {}
    holders: dict[str, set[int]] = defaultdict(set)
    opened = 0
    since_sweep = 0

    def forget(before: int) -> None:
        for number in [n for n, i in open_.items() if i[2] < before]:
            for key in open_.pop(number)[3]:
                holders[key].discard(number)
                if not holders[key]:
                    del holders[key]

    for batch in batches:
        out = []
        for row in batch.itertuples(index=False):
            if row.fold_group != group:
                group, opened, since_sweep = row.fold_group, 0, 0
                open_, holders = {}, defaultdict(set)
            keys = list(row.keys)
            if row.incident_id is not None:  # an incident that is already open
                number, opened = opened, opened + 1
                open_[number] = [row.incident_id, row.first_ms, row.last_ms, set(keys)]
                for key in keys:
                    holders[key].add(number)
                continue
            earliest, latest = row.first_ms - CORRELATION_WINDOW_MS, row.last_ms + CORRELATION_WINDOW_MS
            since_sweep += 1
            if since_sweep >= 1000:
                forget(earliest)
                since_sweep = 0
            shared: dict[int, list[str]] = defaultdict(list)
            for key in keys:
                for number in holders.get(key, ()):
                    incident = open_[number]
                    if incident[2] >= earliest and incident[1] <= latest:
                        shared[number].append(key)
            if shared:
                number = max(shared, key=lambda n: (len(shared[n]), open_[n][2], n))
                matched: list[str] | None = sorted(shared[number])
            else:
                number, matched = opened, None
                opened += 1
                open_[number] = [row.new_incident_id, row.first_ms, row.last_ms, set()]
            incident = open_[number]
            incident[1], incident[2] = min(incident[1], row.first_ms), max(incident[2], row.last_ms)
            incident[3].update(keys)
            for key in keys:
                holders[key].add(number)
            out.append((row.item_id, incident[0], matched))
        yield pd.DataFrame(out, columns=["finding_id", "incident_id", "shared"])


def new_incident_id(org_id: Column, finding_id: Column) -> Column:
    """An incident is named after the finding that opened it."""
    return digest(F.lit("incident"), org_id, finding_id)


def assign(keyed: DataFrame, open_incidents: DataFrame | None = None) -> DataFrame:
    """``finding_id → incident_id, shared``: the fold over every group.

    ``open_incidents(incident_id, org_id, first_ms, last_ms, keys)`` are those an earlier batch left open.
    Findings that cannot reach each other are folded apart, whatever their number.
    """
    items = keyed.select(
        "org_id",
        F.col("finding_id").alias("item_id"),
        "first_ms",
        "last_ms",
        "keys",
        F.lit(None).cast("string").alias("incident_id"),
        new_incident_id(F.col("org_id"), F.col("finding_id")).alias("new_incident_id"),
    )
    if open_incidents is not None:
        items = items.unionByName(
            open_incidents.select(
                "org_id",
                F.concat(F.lit("open"), F.lit(SEPARATOR), F.col("incident_id")).alias("item_id"),
                "first_ms",
                "last_ms",
                "keys",
                "incident_id",
                F.lit(None).cast("string").alias("new_incident_id"),
            )
        )
    alone = items.filter((F.size("keys") == 0) & F.col("incident_id").isNull()).select(
        F.col("item_id").alias("finding_id"),
        F.col("new_incident_id").alias("incident_id"),
        F.lit(None).cast("array<string>").alias("shared"),
    )
    linked = cut_lineage(items.filter(F.size("keys") > 0))
    grouped = linked.join(fold_groups(linked), "item_id")
    ordered = (
        grouped.select(
            "fold_group",
            F.col("incident_id").isNull().alias("is_new"),
            "first_ms",
            "item_id",
            "last_ms",
            "keys",
            "incident_id",
            "new_incident_id",
        )
        .repartition("fold_group")
        .sortWithinPartitions("fold_group", "is_new", "first_ms", "item_id")
    )
    folded = ordered.mapInPandas(_fold, "finding_id string, incident_id string, shared array<string>")
    return cut_lineage(folded.unionByName(alone))


# ------------------------------------------------------------------------------------------------------- links
def finding_sightings(findings: DataFrame, events: DataFrame) -> DataFrame:
    """The sightings in each finding's evidence; only cited events are read closely."""
    cited = findings.select("org_id", "finding_id", F.posexplode("evidence").alias("position", "event_uid"))
    wanted = cited.select("org_id", "event_uid").distinct()
    read = events.join(
        wanted,
        (F.col("sx.event_uid") == wanted["event_uid"]) & (F.col("sx.org_id") == wanted["org_id"]),
        "left_semi",
    )
    return cited.join(E.extract_sightings(read), ["org_id", "event_uid"])


def _keyed(findings: DataFrame, sightings: DataFrame) -> DataFrame:
    """Findings with their linking keys; a finding cites at most 100 events, so the list is short."""
    keys = sightings.filter("links").groupBy("org_id", "finding_id").agg(F.sort_array(F.collect_set("entity_key")).alias("keys"))
    return findings.select("org_id", "finding_id", "first_ms", "last_ms").join(
        keys, ["org_id", "finding_id"], "left"
    ).withColumn("keys", F.coalesce("keys", F.array().cast("array<string>")))


def _recorded(sightings: DataFrame, assigned: DataFrame, findings: DataFrame, phase: int) -> DataFrame:
    """(incident, entity, event) with the place it was recorded at: batch phase, then link, then position."""
    placed = sightings.join(assigned.select("finding_id", "incident_id"), "finding_id").join(
        findings.select("finding_id", "first_ms"), "finding_id"
    )
    recorded_at = F.struct(F.lit(phase).alias("phase"), "first_ms", F.col("finding_id").alias("link_key"), "position")
    return placed.select(
        "incident_id", "org_id", "entity_key", "entity_type", "entity_value", "links", "event_uid", "at_ms",
        recorded_at.alias("recorded_at"),
    )


def _first_recorded(rows: DataFrame) -> DataFrame:
    return rows.groupBy(
        "incident_id", "org_id", "entity_key", "entity_type", "entity_value", "links", "event_uid"
    ).agg(F.min("at_ms").alias("at_ms"), F.min("recorded_at").alias("recorded_at"))


def incident_entities(recorded: DataFrame) -> DataFrame:
    """Entities of each incident: first and last time, and the first 20 events that show each."""
    keys = ["incident_id", "org_id", "entity_key", "entity_type", "entity_value", "links"]
    order = W.partitionBy("incident_id", "entity_key").orderBy("recorded_at", "event_uid")
    once = _first_recorded(recorded)
    totals = once.groupBy(*keys).agg(F.min("at_ms").alias("first_ms"), F.max("at_ms").alias("last_ms"))
    kept = once.withColumn("_rank", F.row_number().over(order)).filter(F.col("_rank") <= MAX_ENTITY_EVENTS)
    lists = kept.groupBy("incident_id", "entity_key").agg(
        F.array_sort(F.collect_list(F.struct("_rank", "event_uid", "recorded_at"))).alias("recorded")
    )
    return totals.join(lists, ["incident_id", "entity_key"]).withColumn(
        "events", F.transform("recorded", lambda r: r["event_uid"])
    )


_MATCHED = "array<struct<key:string,incident_events:array<string>,new_events:array<string>>>"
LINK_COLUMNS = (
    "incident_id",
    "org_id",
    "link_id",
    "kind",
    "rule",
    "reason",
    "evidence",
    "matched",
    "first_ms",
    "last_ms",
    "finding_id",
    "event_uid",
    "rule_id",
    "rule_title",
    "rule_author",
    "rule_source",
    "severity_id",
    "techniques",
    "tactics",
    "failure_links",
)


def finding_links(
    findings: DataFrame, assigned: DataFrame, sightings: DataFrame, entities: DataFrame, phase: int = 0
) -> DataFrame:
    """One link per finding: why it is in its incident, and the events on both sides that show it."""
    joined = assigned.join(findings, "finding_id")
    link_id = digest(F.lit("link"), F.col("incident_id"), F.col("finding_id"))
    own = (
        sightings.filter("links")
        .groupBy("finding_id", "entity_key")
        .agg(F.array_sort(F.collect_list(F.struct("position", "event_uid"))).alias("_own"))
    )
    # Recorded events are in order, so those before a link are a beginning of the list: its first few are enough. They
    # are cut before they are joined to every link that shares the entity, and named before the rows move on.
    known = entities.select("incident_id", "entity_key", F.slice("recorded", 1, MAX_MATCH_EVENTS).alias("recorded"))
    place = F.struct(F.lit(phase).alias("phase"), F.col("first_ms"), F.col("finding_id").alias("link_key"), F.lit(-1).alias("position"))
    earlier = F.filter("recorded", lambda r: r["recorded_at"] < place)
    new_events = F.slice(F.array_distinct(F.transform("_own", lambda r: r["event_uid"])), 1, MAX_MATCH_EVENTS)
    matches = (
        joined.select("incident_id", "finding_id", "first_ms", F.explode("shared").alias("entity_key"))
        .join(own.select("finding_id", "entity_key", new_events.alias("new_events")), ["finding_id", "entity_key"])
        .join(known, ["incident_id", "entity_key"])
    )
    per_link = matches.select(
        "finding_id",
        F.struct(
            F.col("entity_key").alias("key"),
            F.transform(earlier, lambda r: r["event_uid"]).alias("incident_events"),
            F.col("new_events"),
        ).alias("match"),
    ).groupBy("finding_id").agg(F.array_sort(F.collect_list("match")).alias("matched"))
    window_hours = CORRELATION_WINDOW_MS // HOUR_MS
    return joined.join(per_link, "finding_id", "left").select(
        "incident_id",
        "org_id",
        link_id.alias("link_id"),
        F.lit("finding").alias("kind"),
        F.when(F.col("shared").isNull(), OPENED).otherwise(SHARED_ENTITY).alias("rule"),
        F.when(F.col("shared").isNull(), F.lit(f"no open incident shared an entity within {window_hours}h"))
        .otherwise(
            F.concat(F.lit("shares "), F.array_join("shared", ", "), F.lit(f" with activity within {window_hours}h"))
        )
        .alias("reason"),
        "evidence",
        F.coalesce("matched", F.array().cast(_MATCHED)).alias("matched"),
        "first_ms",
        "last_ms",
        "finding_id",
        F.lit(None).cast("string").alias("event_uid"),
        "rule_id",
        "rule_title",
        "rule_author",
        "rule_source",
        "severity_id",
        "techniques",
        "tactics",
        F.array().cast("array<string>").alias("failure_links"),
    )


def is_brute_force(techniques: Column) -> Column:
    return F.exists(techniques, lambda t: F.substring_index(t, ".", 1) == BRUTE_FORCE)


def _hours(first: Column, last: Column) -> Column:
    return F.explode(F.sequence(F.floor(first / HOUR_MS).cast("long"), F.floor(last / HOUR_MS).cast("long")))


def logons(events: DataFrame) -> DataFrame:
    """Successful logons with their source address, host keys and account."""
    marked = E.with_roles(
        events.filter(is_successful_logon() & F.col("sx.event_uid").isNotNull()),
        F.col("sx.org_id").alias("org_id"),
        F.col("sx.event_uid").alias("event_uid"),
        F.col("time_ms").alias("at_ms"),
    )
    source = F.get(F.filter("roles", lambda e: e["field"] == "src_endpoint.ip"), F.lit(0))
    hosts = F.array_distinct(F.transform(F.filter("roles", lambda e: e["type"] == "host"), E.entity_key))
    user = F.get(F.filter("roles", lambda e: e["type"] == "user"), F.lit(0))["value"]
    return marked.select(
        "org_id",
        "event_uid",
        "at_ms",
        E.entity_key(source).alias("source_key"),
        hosts.alias("host_keys"),
        user.alias("user"),
        "roles",
    ).filter(F.col("source_key").isNotNull() & (F.size("host_keys") > 0))


def _reached_hosts(followed: DataFrame, known: DataFrame) -> DataFrame:
    """``incident_id, entity_key, since``: from when on an incident holds a host, with what its logons bring in.

    ``known(incident_id, entity_key)`` are held from the start. A logon on a held host brings in its other hosts from
    its own place in the order on, so a later logon may match through them alone. Each round carries what changed one
    logon further and keeps the earliest place of a host; there are as many rounds as the longest such chain. Only
    logons that name several hosts can bring one in, and they meet changed hosts by incident and host.
    """
    place = F.struct("at_ms", "event_uid")
    several = followed.filter(F.size("host_keys") > 1).select("incident_id", "host_keys", place.alias("place"))
    through = cut_lineage(several.withColumn("entity_key", F.explode("host_keys")))
    start = F.struct(F.lit(-(2**63)).cast("long").alias("at_ms"), F.lit("").alias("event_uid"))
    reached = cut_lineage(known.select("incident_id", "entity_key").distinct().withColumn("since", start))
    changed = reached
    while not changed.isEmpty():
        held = changed.select("incident_id", "entity_key", "since")
        brought = (
            through.join(held, ["incident_id", "entity_key"])
            .filter(F.col("since") < F.col("place"))
            .select("incident_id", F.explode("host_keys").alias("entity_key"), F.col("place").alias("since"))
            .groupBy("incident_id", "entity_key")
            .agg(F.min("since").alias("since"))
        )
        before = reached.select("incident_id", "entity_key", F.col("since").alias("before"))
        earlier = brought.join(before, ["incident_id", "entity_key"], "left").filter(
            F.col("before").isNull() | (F.col("since") < F.col("before"))
        )
        changed = cut_lineage(earlier.select("incident_id", "entity_key", "since"))
        reached = cut_lineage(
            reached.unionByName(changed).groupBy("incident_id", "entity_key").agg(F.min("since").alias("since"))
        )
    return reached


def logon_links(
    links: DataFrame, entities: DataFrame, events: DataFrame, phase: int = 1
) -> tuple[DataFrame, DataFrame]:
    """Successful logons that follow brute-force findings from the same source against the same host.

    Returns the links and the sightings they add. An entity keeps 20 events, so at most the links citing
    those 20 can be the failures behind a logon: the join has no unbounded side per source and hour.

    Logons are taken in order of time and event: one that links records its hosts in the incident, so that a later
    logon may match through a host that only an earlier one brought in, and names that logon as the event that shows
    it. Sources need no such order: what makes a source match is an event that a finding cites, which the finding has
    recorded already.
    """
    brute = links.filter((F.col("kind") == "finding") & is_brute_force(F.col("techniques")))
    cited = brute.select(
        "incident_id", "org_id", "link_id", "first_ms", "last_ms", F.posexplode("evidence").alias("position", "event_uid")
    )
    shown = entities.filter(F.col("entity_type") == "ip").select(
        "incident_id", F.col("entity_key").alias("source_key"), F.explode("events").alias("event_uid")
    )
    failures = cited.join(shown, ["incident_id", "event_uid"]).groupBy(
        "org_id", "incident_id", "source_key", "link_id", "first_ms", "last_ms"
    ).agg(F.array_sort(F.collect_list(F.struct("position", "event_uid"))).alias("shown"))
    active = failures.withColumn("hour", _hours(F.col("first_ms"), F.col("last_ms") + AUTH_SEQUENCE_WINDOW_MS))
    attempts = logons(events).withColumn("hour", F.floor(F.col("at_ms") / HOUR_MS).cast("long"))
    after = (F.col("first_ms") <= F.col("at_ms")) & (F.col("at_ms") - F.col("last_ms") <= AUTH_SEQUENCE_WINDOW_MS)
    followed = cut_lineage(
        attempts.join(active, ["org_id", "source_key", "hour"])
        .filter(after)
        .groupBy("org_id", "incident_id", "source_key", "event_uid", "at_ms", "user", "host_keys", "roles")
        .agg(F.array_sort(F.collect_list(F.struct("first_ms", "link_id", "shown"))).alias("failures"))
    )
    known = entities.filter(F.col("entity_type") == "host").select("incident_id", "entity_key", "events")
    reached = _reached_hosts(followed, known)
    place = F.struct("at_ms", "event_uid")
    on_host = cut_lineage(
        followed.select("incident_id", "event_uid", "at_ms", F.explode("host_keys").alias("entity_key"))
        .join(reached, ["incident_id", "entity_key"])
        .filter(F.col("since") < place)
        .select("incident_id", "event_uid", "at_ms", "entity_key")
    )
    # What a host shows at a logon: the events recorded before, of which the first few are named.
    linked = followed.join(on_host.select("incident_id", "event_uid").distinct(), ["incident_id", "event_uid"], "left_semi")
    in_order = W.partitionBy("incident_id", "entity_key").orderBy("at_ms", "event_uid")
    first_logons = (
        linked.select("incident_id", "event_uid", "at_ms", F.explode("host_keys").alias("entity_key"))
        .withColumn("_rank", F.row_number().over(in_order))
        .filter(F.col("_rank") <= MAX_MATCH_EVENTS)
        .groupBy("incident_id", "entity_key")
        .agg(F.array_sort(F.collect_list(place)).alias("logons"))
    )
    none = F.array().cast("array<string>")
    sooner = F.transform(F.filter("logons", lambda l: l < place), lambda l: l["event_uid"])
    seen = F.slice(
        F.array_distinct(F.concat(F.coalesce("events", none), F.coalesce(sooner, none))), 1, MAX_MATCH_EVENTS
    )
    hosts_of = (
        on_host.join(known, ["incident_id", "entity_key"], "left")
        .join(first_logons, ["incident_id", "entity_key"], "left")
        .withColumn("seen", seen)
        .groupBy("incident_id", "event_uid")
        .agg(F.array_sort(F.collect_list(F.struct("entity_key", F.col("seen").alias("events")))).alias("hosts"))
    )
    complete = cut_lineage(followed.join(hosts_of, ["incident_id", "event_uid"]))
    failed = F.array_distinct(
        F.flatten(F.transform("failures", lambda f: F.transform(f["shown"], lambda s: s["event_uid"])))
    )
    this = F.array("event_uid")

    def match(key: Column, seen: Column) -> Column:
        return F.struct(key.alias("key"), seen.alias("incident_events"), this.alias("new_events"))

    host_names = F.array_join(F.transform("hosts", lambda h: E.key_value(h["entity_key"])), ", ")
    reason = F.concat(
        F.lit("successful logon"),
        F.coalesce(F.concat(F.lit(" as "), F.col("user")), F.lit("")),
        F.lit(" from "),
        E.key_value(F.col("source_key")),
        F.lit(" to "),
        host_names,
        F.lit(" after "),
        F.size("failures").cast("string"),
        F.lit(" brute-force finding(s) from the same source"),
    )
    rows = complete.select(
        "incident_id",
        "org_id",
        digest(F.lit("link"), F.col("incident_id"), F.col("event_uid")).alias("link_id"),
        F.lit("event").alias("kind"),
        F.lit(AUTH_SUCCESS).alias("rule"),
        reason.alias("reason"),
        this.alias("evidence"),
        F.concat(
            F.array(match(F.col("source_key"), F.slice(failed, 1, MAX_MATCH_EVENTS))),
            F.transform("hosts", lambda h: match(h["entity_key"], h["events"])),
        ).alias("matched"),
        F.col("at_ms").alias("first_ms"),
        F.col("at_ms").alias("last_ms"),
        F.lit(None).cast("string").alias("finding_id"),
        "event_uid",
        *[F.lit(None).cast("string").alias(c) for c in ("rule_id", "rule_title", "rule_author", "rule_source")],
        F.lit(None).cast("int").alias("severity_id"),
        F.array().cast("array<string>").alias("techniques"),
        F.array().cast("array<string>").alias("tactics"),
        F.transform("failures", lambda f: f["link_id"]).alias("failure_links"),
    )
    added = complete.select(
        "incident_id", "org_id", "event_uid", "at_ms", F.posexplode("roles").alias("position", "e")
    ).select(
        "incident_id",
        "org_id",
        E.entity_key(F.col("e")).alias("entity_key"),
        F.col("e.type").alias("entity_type"),
        F.col("e.value").alias("entity_value"),
        F.col("e.links").alias("links"),
        "event_uid",
        "at_ms",
        F.struct(F.lit(phase).alias("phase"), F.col("at_ms").alias("first_ms"), F.col("event_uid").alias("link_key"), "position").alias(
            "recorded_at"
        ),
    )
    return rows, added


# -------------------------------------------------------------------------------------------------- assessment
def assess(links: DataFrame, entities: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Everything that follows from the links: the incident row, its assessment, and the links behind each reason."""
    findings = links.filter(F.col("kind") == "finding")
    compromised = links.filter(F.col("rule") == AUTH_SUCCESS)
    totals = links.groupBy("org_id", "incident_id").agg(
        F.min("first_ms").alias("first_ms"),
        F.max("last_ms").alias("last_ms"),
        F.count_if(F.col("kind") == "finding").alias("finding_count"),
        F.count_if(F.col("rule") == AUTH_SUCCESS).alias("compromise_count"),
        # The most severe finding, the earliest of equals.
        F.max_by(
            F.struct("link_id", "rule_title", "severity_id"),
            F.when(
                F.col("kind") == "finding",
                F.struct("severity_id", (-F.col("first_ms")).alias("early"), F.col("link_id")),
            ),
        ).alias("top"),
        F.min_by(
            F.get(F.filter("matched", lambda m: m["key"].startswith("ip:")), F.lit(0))["key"],
            F.when(F.col("rule") == AUTH_SUCCESS, F.struct("first_ms", "link_id")),
        ).alias("first_source"),
    )
    event_counts = (
        links.select("incident_id", F.explode("evidence").alias("uid")).distinct().groupBy("incident_id").agg(F.count("*").alias("event_count"))
    )
    techniques = findings.select("incident_id", F.explode("techniques").alias("t")).groupBy("incident_id").agg(
        F.sort_array(F.collect_set("t")).alias("techniques")
    )
    tactics = (
        findings.select("incident_id", "first_ms", "link_id", F.posexplode("tactics").alias("pos", "tactic"))
        .groupBy("incident_id", "tactic")
        .agg(F.min(F.struct("first_ms", "link_id", "pos")).alias("at"))
        .groupBy("incident_id")
        .agg(F.transform(F.array_sort(F.collect_list(F.struct("at", "tactic"))), lambda r: r["tactic"]).alias("tactics"))
    )
    by_host = W.partitionBy("incident_id").orderBy("first_ms", "entity_key")
    host_rows = entities.filter(F.col("entity_type") == "host").select("incident_id", "entity_value", "first_ms", "entity_key")
    first_hosts = (
        host_rows.withColumn("rank", F.row_number().over(by_host))
        .filter(F.col("rank") <= 2)
        .groupBy("incident_id")
        .agg(F.array_sort(F.collect_list(F.struct("rank", "entity_value"))).alias("hosts"))
    )
    hosts = host_rows.groupBy("incident_id").agg(F.count("*").alias("host_count")).join(first_hosts, "incident_id")
    no_text = F.array().cast("array<string>")
    full = (
        totals.join(event_counts, "incident_id")
        .join(techniques, "incident_id", "left")
        .join(tactics, "incident_id", "left")
        .join(hosts, "incident_id", "left")
        .withColumns(
            {
                "techniques": F.coalesce("techniques", no_text),
                "tactics": F.coalesce("tactics", no_text),
                "host_count": F.coalesce("host_count", F.lit(0)),
                "hosts": F.transform(F.coalesce("hosts", F.array().cast("array<struct<rank:int,entity_value:string>>")), lambda h: h["entity_value"]),
            }
        )
    )
    compromise = F.col("compromise_count") > 0
    multi_stage = F.size("tactics") >= MULTI_STAGE_TACTICS
    severity = (
        F.when(compromise & multi_stage, CRITICAL)
        .when(compromise | multi_stage, F.greatest(F.col("top.severity_id"), F.lit(HIGH)))
        .otherwise(F.col("top.severity_id"))
    )

    def entry(rule: str, level: Column | int, because: Column) -> Column:
        level = F.lit(level) if isinstance(level, int) else level
        return F.struct(F.lit(rule).alias("rule"), level.cast("int").alias("severity_id"), because.alias("because"))

    reasons = F.array_compact(
        F.array(
            entry(
                "highest-finding-severity",
                F.col("top.severity_id"),
                F.concat(F.lit("most severe linked finding: "), F.col("top.rule_title")),
            ),
            F.when(
                compromise,
                entry("credential-compromise", HIGH, F.lit("a logon succeeded after brute-force failures from its source")),
            ),
            F.when(
                multi_stage,
                entry(
                    "multi-stage",
                    HIGH,
                    F.concat(
                        F.lit("findings span "),
                        F.size("tactics").cast("string"),
                        F.lit(" ATT&CK tactics: "),
                        F.array_join("tactics", ", "),
                    ),
                ),
            ),
            F.when(
                compromise & multi_stage,
                entry("compromise-then-activity", CRITICAL, F.lit("a compromised logon came before activity in several tactics")),
            ),
        )
    )
    incidents = full.select(
        "incident_id",
        "org_id",
        incident_title().alias("title"),
        severity.cast("int").alias("severity_id"),
        F.lit("new").alias("status"),
        "first_ms",
        "last_ms",
        "finding_count",
        "event_count",
        "techniques",
        "tactics",
    )
    assessments = full.select("incident_id", "org_id", F.inline(reasons))
    top_links = totals.select("incident_id", F.lit("highest-finding-severity").alias("rule"), F.col("top.link_id").alias("link_id"))
    stage_links = findings.filter(F.size("tactics") > 0).select("incident_id", F.lit("multi-stage").alias("rule"), "link_id")
    logon_rows = compromised.select(
        "incident_id", F.explode(F.array(F.lit("credential-compromise"), F.lit("compromise-then-activity"))).alias("rule"), "link_id"
    )
    behind = top_links.unionByName(stage_links).unionByName(logon_rows)
    stated = assessments.select("incident_id", "rule")
    return incidents, assessments, behind.join(stated, ["incident_id", "rule"], "left_semi")


def incident_title() -> Column:
    """From the compromise source, the tactics, the top finding and the hosts."""

    def listed(values: Column, shown: int) -> Column:
        pretty = F.transform(F.slice(values, 1, shown), lambda t: F.translate(t, "_", " "))
        return F.array_join(pretty, ", ")

    def more(count: Column, shown: int) -> Column:
        return F.when(count > shown, F.concat(F.lit(" and "), (count - shown).cast("string"), F.lit(" more"))).otherwise("")

    where = F.when(
        F.col("host_count") > 0,
        F.concat(F.lit(" on "), F.array_join(F.slice("hosts", 1, 2), ", "), more(F.col("host_count"), 2)),
    ).otherwise("")
    later = F.filter("tactics", lambda t: t != "credential_access")
    source = F.coalesce(F.concat(F.lit(" from "), E.key_value(F.col("first_source"))), F.lit(""))
    then = F.when(F.size(later) > 0, F.concat(F.lit(", then "), listed(later, 4), more(F.size(later), 4))).otherwise("")
    title = (
        F.when(F.col("compromise_count") > 0, F.concat(F.lit(TITLE_COMPROMISE), source, then, where))
        .when(
            F.size("tactics") >= MULTI_STAGE_TACTICS,
            F.concat(F.lit("Multi-stage activity ("), listed(F.col("tactics"), 4), F.lit(")"), where),
        )
        .otherwise(F.concat(F.coalesce(F.col("top.rule_title"), F.lit(TITLE_DEFAULT)), where))
    )
    return F.substring(title, 1, MAX_TITLE)


def incident_evidence(links: DataFrame, events: DataFrame) -> DataFrame:
    """Digests of every cited event, per incident."""
    cited = links.select("incident_id", "org_id", F.explode("evidence").alias("event_uid")).distinct()
    wanted = cited.select("org_id", "event_uid").distinct()
    read = events.join(
        wanted,
        (F.col("sx.event_uid") == wanted["event_uid"]) & (F.col("sx.org_id") == wanted["org_id"]),
        "left_semi",
    )
    return cited.join(E.digest(read), ["org_id", "event_uid"])


def open_incidents(links: DataFrame, recorded: DataFrame, earliest_ms: int, wanted: DataFrame) -> DataFrame:
    """Stored incidents that activity from ``earliest_ms`` on can still reach, with those of their linking keys
    that the batch's findings hold (``wanted``): no other key can match, so a vast incident stays a short row."""
    spans = links.groupBy("org_id", "incident_id").agg(F.min("first_ms").alias("first_ms"), F.max("last_ms").alias("last_ms"))
    live = spans.filter(F.col("last_ms") >= earliest_ms - CORRELATION_WINDOW_MS)
    held = recorded.filter("links").join(wanted, ["org_id", "entity_key"], "left_semi")
    keys = held.join(live, "incident_id", "left_semi").groupBy("incident_id").agg(
        F.sort_array(F.collect_set("entity_key")).alias("keys")
    )
    return live.join(keys, "incident_id")


def link_batch(
    findings: DataFrame,
    events: DataFrame,
    stored_links: DataFrame | None = None,
    stored_recorded: DataFrame | None = None,
    batch: int = 0,
    closed: DataFrame | None = None,
    arrived: DataFrame | None = None,
) -> tuple[DataFrame, DataFrame]:
    """The links a batch adds, and the (incident, entity, event) rows it records.

    ``events`` hold the evidence; ``arrived``, when given, are the batch's own events, whose logons are taken.

    What is already linked is left alone, so a repeated batch adds nothing. ``closed(incident_id)`` incidents
    take no new links.
    """

    def reachable(frame: DataFrame) -> DataFrame:
        return frame if closed is None else frame.join(closed, "incident_id", "left_anti")

    if stored_links is not None:
        findings = findings.join(stored_links.select("finding_id"), "finding_id", "left_anti")
    findings = cut_lineage(findings)
    sightings = cut_lineage(finding_sightings(findings, events))
    seeds = None
    if stored_links is not None:
        earliest = findings.agg(F.min("first_ms")).first()[0]
        if earliest is not None:
            wanted = sightings.filter("links").select("org_id", "entity_key").distinct()
            seeds = open_incidents(reachable(stored_links), reachable(stored_recorded), earliest, wanted)
    assigned = assign(_keyed(findings, sightings), seeds)
    recorded = _recorded(sightings, assigned, findings, 2 * batch)
    everything = recorded if stored_recorded is None else stored_recorded.unionByName(recorded)
    entities = cut_lineage(incident_entities(everything))
    from_findings = cut_lineage(finding_links(findings, assigned, sightings, entities, 2 * batch))
    all_links = from_findings if stored_links is None else stored_links.unionByName(from_findings)
    from_logons, added = logon_links(reachable(all_links), reachable(entities), events if arrived is None else arrived, 2 * batch + 1)
    if stored_links is not None:
        linked = stored_links.filter(F.col("kind") == "event").select("incident_id", "event_uid")
        from_logons = from_logons.join(linked, ["incident_id", "event_uid"], "left_anti")
        added = added.join(linked, ["incident_id", "event_uid"], "left_anti")
    return cut_lineage(from_findings.unionByName(from_logons)), recorded.unionByName(added)


def incident_tables(links: DataFrame, recorded: DataFrame, events: DataFrame) -> Incidents:
    """Everything that follows from the links and what they recorded."""
    entities = cut_lineage(incident_entities(recorded).drop("recorded"))
    incidents, assessments, behind = assess(links, entities)
    evidence = cut_lineage(incident_evidence(links, events))
    return Incidents(cut_lineage(incidents), links, entities, evidence, assessments, behind)


def correlate(findings: DataFrame, events: DataFrame) -> Incidents:
    """Findings and events to incidents, links, entities, evidence digests and the assessment.

    ``findings`` have distinct ``finding_id``; ``events`` distinct ``sx.event_uid``.
    """
    links, recorded = link_batch(findings, events)
    return incident_tables(links, recorded, events)


def linking_indicators(entities: DataFrame) -> DataFrame:
    """External addresses, domains and hashes of incidents: what threat intelligence can be asked about."""
    return (
        entities.filter(F.col("links") & F.col("entity_type").isin(*INTEL_TYPES))
        .select("org_id", "incident_id", "entity_key")
        .distinct()
    )


# --------------------------------------------------------------------------------------- standalone interval joins
def open_incidents_for(findings_keys: DataFrame, entities: DataFrame, incidents: DataFrame) -> DataFrame:
    """Candidate open incidents per finding: shared linking entities with activity within two hours.

    ``findings_keys(org_id, finding_id, first_ms, last_ms, entity_key)``. Both sides carry the two-hour slots
    their activity touches, so the equi-join key is (entity, slot) and a busy entity spreads over time.
    """
    slot_ms = CORRELATION_WINDOW_MS

    def slots(first: Column, last: Column) -> Column:
        return F.explode(F.sequence(F.floor(first / slot_ms).cast("long"), F.floor(last / slot_ms).cast("long")))

    wanted = findings_keys.select(
        "org_id",
        "finding_id",
        F.col("first_ms").alias("f_first"),
        F.col("last_ms").alias("f_last"),
        "entity_key",
        slots(F.col("first_ms") - slot_ms, F.col("last_ms") + slot_ms).alias("slot"),
    )
    spans = incidents.filter(F.col("status") != "closed").select("incident_id", "first_ms", "last_ms")
    held = entities.select("org_id", "incident_id", "entity_key").join(spans, "incident_id").withColumn(
        "slot", slots(F.col("first_ms"), F.col("last_ms"))
    )
    overlap = (F.col("last_ms") >= F.col("f_first") - slot_ms) & (F.col("first_ms") <= F.col("f_last") + slot_ms)
    return (
        wanted.join(held, ["org_id", "entity_key", "slot"])
        .filter(overlap)
        .groupBy("org_id", "finding_id", "incident_id", "entity_key")
        .agg(F.first("last_ms").alias("last_ms"))
        .groupBy("org_id", "finding_id", "incident_id")
        .agg(F.count("*").alias("shared"), F.first("last_ms").alias("last_ms"))
    )


def logons_after_failures(
    attempts: DataFrame, failures: DataFrame, window_ms: int = AUTH_SEQUENCE_WINDOW_MS
) -> DataFrame:
    """Logons with the number of failure spans still fresh from the same source against the same host.

    ``attempts(org_id, source_key, host_key, event_uid, at_ms)``, ``failures(org_id, source_key, host_key,
    first_ms, last_ms)``. A failure is fresh from its start until ``window_ms`` after its end. The count is a
    running sum over starts and ends inside (source, host, slot), so neither side is paired with the other.
    """
    keys = ["org_id", "source_key", "host_key", "slot"]
    slot_of = lambda at: F.floor(at / window_ms).cast("long")
    spans = failures.withColumn("until_ms", F.col("last_ms") + window_ms).withColumn(
        "slot", F.explode(F.sequence(slot_of(F.col("first_ms")), slot_of(F.col("until_ms"))))
    )
    none = F.lit(None).cast("string")
    starts = spans.select(
        *keys,
        F.greatest("first_ms", F.col("slot") * window_ms).alias("at"),
        F.lit(0).alias("phase"),
        F.lit(1).alias("delta"),
        none.alias("event_uid"),
    )
    ends = spans.filter(slot_of(F.col("until_ms")) == F.col("slot")).select(
        *keys, F.col("until_ms").alias("at"), F.lit(2).alias("phase"), F.lit(-1).alias("delta"), none.alias("event_uid")
    )
    asks = attempts.select(
        "org_id",
        "source_key",
        "host_key",
        slot_of(F.col("at_ms")).alias("slot"),
        F.col("at_ms").alias("at"),
        F.lit(1).alias("phase"),
        F.lit(0).alias("delta"),
        "event_uid",
    )
    order = W.partitionBy(*keys).orderBy("at", "phase").rowsBetween(W.unboundedPreceding, 0)
    counted = starts.unionByName(ends).unionByName(asks).withColumn("failures", F.sum("delta").over(order))
    return counted.filter(F.col("event_uid").isNotNull() & (F.col("failures") > 0)).select(
        "org_id", "source_key", "host_key", "event_uid", F.col("at").alias("at_ms"), "failures"
    )
