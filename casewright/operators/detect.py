"""Detection: single-event rules and sliding event-time thresholds with cooldown.

Input events are the stored form, one row per ``sx.event_uid``. Findings have one row per rule firing; their
``finding_id`` is a digest of what fired, so running twice gives the same findings.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce
from itertools import batched

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from casewright.functions import ids
from casewright.operators import predicates as P
from casewright.operators.rules import Rule
from casewright.operators.scopes import scope_named
from casewright.session import cut_lineage

# --- Fixed values -----------------------------------------------------------------------------------------------
MAX_EVIDENCE = 100
MAX_ENTITY_NAMES = 20
MAX_ENTITY_VALUES = 20
# ------------------------------------------------------------------------------------------------------------
# Rules per column of bits: one such column is one generated method, small enough for the JVM to compile.
RULES_PER_MASK = 8
# Where a test stands for as many rules, its hits are dealt out before each becomes that many findings.
SPREAD_FROM = 8
# A group with at most this many distinct firing times is folded as one array; larger ones are cut in time.
FOLD_LIMIT = 256
# A large group is cut into pieces this many windows long, or a day when that is shorter.
WINDOWS_PER_PIECE = 8
MAX_PIECE_MS = 24 * 3_600_000

FINDING_COLUMNS = (
    "org_id",
    "finding_id",
    "rule_id",
    "rule_title",
    "rule_type",
    "rule_version",
    "rule_author",
    "rule_source",
    "severity_id",
    "techniques",
    "tactics",
    "entities",
    "evidence",
    "first_ms",
    "last_ms",
)
_RULE_META = (
    "rule int, rule_id string, rule_title string, rule_type string, rule_version string, rule_author string, "
    "rule_source string, severity_id int, techniques array<string>, tactics array<string>, "
    "group_by array<string>, count_distinct string"
)


def _rule_meta(events: DataFrame, rules: list[Rule], tests: list[int] | None = None) -> DataFrame:
    """One row per rule, as many as the driver compiled; small enough to broadcast by construction.

    ``rule`` is the rule's position, or that of the first rule with its test where ``tests`` are given.
    """
    rows = [
        (
            tests[index] if tests else index,
            r.id,
            r.title,
            "threshold" if r.is_threshold else "single",
            r.version,
            r.author,
            r.source_url,
            r.severity_id,
            list(r.techniques),
            list(r.tactics),
            list(r.group_by),
            r.count_distinct,
        )
        for index, r in enumerate(rules)
    ]
    return events.sparkSession.createDataFrame(rows, _RULE_META)


def _stored(events: DataFrame) -> DataFrame:
    """Only stored, timestamped events can be evidence."""
    return events.filter(F.col("sx.event_uid").isNotNull() & (F.col("sx.event_uid") != "") & F.col("time_ms").isNotNull())


# ---------------------------------------------------------------------------------------------- single events
def _first_with_test(rules: list[Rule]) -> list[int]:
    """For each rule the position of the first that has its test."""
    first: dict[tuple[str, str], int] = {}
    return [first.setdefault((rule.scope, repr(rule.test)), index) for index, rule in enumerate(rules)]


def matched_rules(events: DataFrame, rules: list[Rule], *keep: str | Column) -> DataFrame:
    """``keep`` and ``rule``, the position of a rule that the event satisfies: one pass, whatever the number of rules.

    Rules are tested in a plain projection, eight to a column of bits, so all tests run as generated code; what
    follows looks at bits. A scope is tested once for the rules of a column. Rules with the same test share its bit.
    """
    tests = _first_with_test(rules)
    found = _matched_tests(events, rules, tests, *keep)
    if len(set(tests)) == len(rules):
        return found
    shared = F.broadcast(events.sparkSession.createDataFrame(list(zip(tests, range(len(rules)), strict=True)), "_first int, _rule int"))
    return found.join(shared, F.col("rule") == F.col("_first")).drop("rule", "_first").withColumnRenamed("_rule", "rule")


def _matched_tests(events: DataFrame, rules: list[Rule], tests: list[int], *keep: str | Column) -> DataFrame:
    """``keep`` and ``rule``, the position of the first rule with a test that the event satisfies."""
    by_scope: dict[str, list[tuple[int, Rule]]] = {}
    for index in dict.fromkeys(tests):
        by_scope.setdefault(rules[index].scope, []).append((index, rules[index]))
    masks, positions = [], []
    for name, members in by_scope.items():
        for chunk in batched(members, RULES_PER_MASK):
            bits = reduce(
                lambda a, b: a.bitwiseOR(b),
                [F.when(rule.predicate, F.lit(1 << bit)).otherwise(F.lit(0)) for bit, (_, rule) in enumerate(chunk)],
            )
            masks.append(F.when(scope_named(name).where(), bits).otherwise(F.lit(0)).alias(f"_mask_{len(masks)}"))
            positions += [index for index, _ in chunk] + [-1] * (RULES_PER_MASK - len(chunk))
    tested = events.select(*keep, *masks)
    kept = tested.columns[: len(tested.columns) - len(masks)]
    hit = tested.select(*kept, F.posexplode(F.array(*[f"_mask_{n}" for n in range(len(masks))])).alias("_column", "_bits"))
    each = hit.filter("_bits <> 0").select(
        *kept, "_column", "_bits", F.explode(F.array(*[F.lit(bit) for bit in range(RULES_PER_MASK)])).alias("_bit")
    )
    known = F.array(*[F.lit(index) for index in positions])
    rule_at = F.element_at(known, F.col("_column") * RULES_PER_MASK + F.col("_bit") + 1)
    return each.filter(F.expr("(shiftright(_bits, _bit) & 1) = 1")).select(*kept, rule_at.alias("rule"))


def entities_from_observables(observables: Column) -> Column:
    """Observable values by name: at most 20 names, at most 20 distinct values each, in order."""
    usable = F.filter(observables, lambda o: o["name"].isNotNull() & o["value"].isNotNull() & (o["value"] != ""))
    names = F.slice(F.array_distinct(F.transform(usable, lambda o: o["name"])), 1, MAX_ENTITY_NAMES)

    def values(name: Column) -> Column:
        own = F.transform(F.filter(usable, lambda o: o["name"] == name), lambda o: o["value"])
        return F.slice(F.array_distinct(own), 1, MAX_ENTITY_VALUES)

    return F.coalesce(
        F.map_from_entries(F.transform(names, lambda n: F.struct(n.alias("k"), values(n).alias("v")))),
        F.create_map().cast("map<string,array<string>>"),
    )


def detect_single(events: DataFrame, rules: list[Rule]) -> DataFrame:
    """Findings of the single-event rules: one scan whatever the number of rules, shuffled only where many share a test."""
    if not rules:
        raise ValueError("no single-event rules given")
    tests = _first_with_test(rules)
    hits = _matched_tests(
        _stored(events),
        rules,
        tests,
        F.col("sx.org_id").alias("org_id"),
        F.col("sx.event_uid").alias("event_uid"),
        F.col("time_ms"),
        F.col("observables"),
    )
    if len(rules) >= SPREAD_FROM * len(set(tests)):
        hits = hits.repartition(int(events.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    meta = F.broadcast(_rule_meta(events, rules, tests))
    return hits.join(meta, "rule").select(
        "org_id",
        ids.digest(F.col("rule_id"), F.col("event_uid")).alias("finding_id"),
        *[c for c in FINDING_COLUMNS if c.startswith("rule_")],
        "severity_id",
        "techniques",
        "tactics",
        entities_from_observables(F.col("observables")).alias("entities"),
        F.array("event_uid").alias("evidence"),
        F.col("time_ms").alias("first_ms"),
        F.col("time_ms").alias("last_ms"),
    )


# ------------------------------------------------------------------------------------------------- thresholds
GROUP = ("org_id", "rule", "group_key")


def threshold_matches(events: DataFrame, rules: list[Rule], *keep: str) -> DataFrame:
    """Every (event, threshold rule) match with its group and counted value, and the columns to keep.

    An event without a value for each grouping field belongs to no group and is not counted.
    """

    def entry(index: int, rule: Rule) -> Column:
        group = [P.first_value(path) for path in rule.group_by]
        value = P.first_value(rule.count_distinct) if rule.count_distinct else F.lit(None).cast("string")
        complete = rule.predicate
        for part in (*group, *([value] if rule.count_distinct else [])):
            complete = complete & part.isNotNull()
        return F.when(
            complete,
            F.struct(
                F.lit(index).alias("rule"),
                F.lit(rule.window_ms).cast("long").alias("window_ms"),
                F.lit(rule.threshold).alias("threshold"),
                F.concat_ws(ids.SEPARATOR, *group).alias("group_key"),
                F.array(*group).alias("group_values"),
                value.alias("value"),
            ),
        )

    matches = F.array_compact(F.array(*[entry(i, r) for i, r in enumerate(rules)]))
    return _stored(events).select(
        F.col("sx.org_id").alias("org_id"),
        F.col("sx.event_uid").alias("event_uid"),
        "time_ms",
        *keep,
        F.inline(matches),
    )


def window_counts(matches: DataFrame) -> DataFrame:
    """For each match, how many distinct values (or events) its group saw in the window ending with it.

    A value is present from one occurrence until ``window`` after it, so the count is a running sum of +1 and
    -1 steps: linear in the events, where a sliding ``collect_set`` is quadratic in a busy group. Groups are
    cut into slots of four windows; matches in the last window of a slot are copied into the next one as
    context, so a group holding a third of all rows still spreads over its time span. Events at the same
    millisecond count in ``event_uid`` order, as a replay would.
    """
    slot_ms = F.col("window_ms") * 4
    slot = F.floor(F.col("time_ms") / slot_ms).cast("long")
    near_end = F.col("time_ms") >= (slot + 1) * slot_ms - F.col("window_ms")
    here = F.struct(slot.alias("slot"), F.lit(True).alias("own"))
    following = F.struct((slot + 1).alias("slot"), F.lit(False).alias("own"))
    placed = matches.select(
        *GROUP,
        "window_ms",
        "threshold",
        "event_uid",
        "time_ms",
        F.coalesce("value", "event_uid").alias("counted"),
        F.inline(F.when(near_end, F.array(here, following)).otherwise(F.array(here))),
    )
    same_value = W.partitionBy(*GROUP, "slot", "counted").orderBy("time_ms", "event_uid")
    before, after = F.lag("time_ms").over(same_value), F.lead("time_ms").over(same_value)
    spans = placed.withColumns({"_before": before, "_after": after})
    arrives = F.col("_before").isNull() | (F.col("_before") < F.col("time_ms") - F.col("window_ms"))
    leaves = F.col("_after").isNull() | (F.col("_after") > F.col("time_ms") + F.col("window_ms"))

    def step(at: Column, phase: int, uid: Column, delta: Column, own: Column) -> Column:
        return F.struct(
            at.alias("at_ms"),
            F.lit(phase).alias("phase"),
            uid.alias("uid"),
            delta.alias("delta"),
            own.alias("own_event"),
        )

    steps = F.array_compact(
        F.array(
            step(F.col("time_ms"), 0, F.col("event_uid"), F.when(arrives, 1).otherwise(0), F.col("own")),
            F.when(
                leaves,
                step(F.col("time_ms") + F.col("window_ms"), 1, F.lit(""), F.lit(-1), F.lit(False)),
            ),
        )
    )
    order = W.partitionBy(*GROUP, "slot").orderBy("at_ms", "phase", "uid").rowsBetween(W.unboundedPreceding, 0)
    return (
        spans.select(*GROUP, "slot", "window_ms", "threshold", F.inline(steps))
        .withColumn("seen", F.sum("delta").over(order))
        .filter("own_event")
        .select(*GROUP, "window_ms", "threshold", F.col("uid").alias("event_uid"), F.col("at_ms").alias("time_ms"), "seen")
    )


def triggers(matches: DataFrame) -> DataFrame:
    """The instants at which a group has enough, with the first event that made it so."""
    enough = window_counts(matches).filter(F.col("seen") >= F.col("threshold"))
    return enough.groupBy(*GROUP, "window_ms", F.col("time_ms").alias("at_ms")).agg(
        F.min("event_uid").alias("trigger_uid")
    )


def _fold_small(groups: DataFrame) -> DataFrame:
    """Cooldown of groups with few instants: one native fold per group."""
    ordered = F.array_sort(F.collect_list(F.struct("at_ms", "trigger_uid")))
    folded = groups.groupBy(*GROUP, "window_ms").agg(ordered.alias("instants"))
    start = F.struct(
        F.lit(None).cast("long").alias("last"), F.array().cast("array<struct<at_ms:bigint,trigger_uid:string>>").alias("fires")
    )

    def step(state: Column, instant: Column) -> Column:
        fires = state["last"].isNull() | (instant["at_ms"] - state["last"] >= F.col("window_ms"))
        return F.when(
            fires,
            F.struct(instant["at_ms"].alias("last"), F.concat(state["fires"], F.array(instant)).alias("fires")),
        ).otherwise(state)

    fires = F.aggregate("instants", start, step, lambda state: state["fires"])
    return folded.select(*GROUP, "window_ms", F.inline(fires))


def _piece_ms(window_ms: Column) -> Column:
    pieces = F.floor(F.lit(MAX_PIECE_MS) / window_ms).cast("long")
    return window_ms * F.greatest(F.lit(1), F.least(F.lit(WINDOWS_PER_PIECE), pieces))


def _piece_steps(piece: pd.DataFrame) -> pd.DataFrame:
    """What one piece of a group does to the cooldown: the last firing, as a step function of the first allowed time."""
    piece = piece.sort_values("at_ms")
    at, window = piece["at_ms"].to_numpy(), int(piece["window_ms"].iloc[0])
    following = np.append(np.searchsorted(at, at + window), len(at))
    last = np.arange(len(at))
    while (moved := following[last] < len(at)).any():
        last = np.where(moved, following[last], last)
    # Only starts within one window of the piece's beginning can be reached from an earlier piece.
    reachable = at <= int(piece["piece_start"].iloc[0]) + window
    count = min(int(reachable.sum()) + 1, len(at))
    exits = at[last[:count]]
    changes = np.append(exits[1:] != exits[:-1], True)
    head = piece.iloc[:1]
    return pd.DataFrame(
        {
            **{c: head[c].iloc[0] for c in (*GROUP, "piece", "window_ms")},
            "not_after": at[:count][changes],
            "last_fired": exits[changes],
        }
    )


def _compose(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Walk the step functions of each group in time order, keeping only the last firing."""
    group = piece = fired = None
    settled = False
    for batch in batches:
        out = []
        for row in batch.itertuples(index=False):
            key = (row.org_id, row.rule, row.group_key)
            if key != group:
                group, piece, fired = key, None, None
            if row.piece != piece:
                piece, settled = row.piece, False
                out.append((*key, row.piece, fired))
            if not settled and (fired is None or fired + row.window_ms <= row.not_after):
                fired, settled = row.last_fired, True
        frame = pd.DataFrame(out, columns=[*GROUP, "piece", "entered_after"])
        yield frame.astype({"entered_after": "Int64"})


def _replay_piece(piece: pd.DataFrame) -> pd.DataFrame:
    """The firings inside one piece, given the last firing before it."""
    piece = piece.sort_values("at_ms")
    at, window = piece["at_ms"].to_numpy(), int(piece["window_ms"].iloc[0])
    entered = piece["entered_after"].iloc[0]
    index = 0 if pd.isna(entered) else int(np.searchsorted(at, int(entered) + window))
    fired = []
    while index < len(at):
        fired.append(index)
        index = int(np.searchsorted(at, at[index] + window))
    return piece.iloc[fired][[*GROUP, "window_ms", "at_ms", "trigger_uid"]]


def _fold_large(groups: DataFrame) -> DataFrame:
    """Cooldown of groups with many instants, cut into pieces of time that run in parallel.

    The next firing is the first instant at least one window after the last, so a piece maps "earliest allowed
    time" to "last firing" and pieces compose. Pieces are summarised in parallel, their summaries walked in
    order holding one number per group, and the firings then replayed in parallel.
    """
    group_columns = "org_id string, rule int, group_key string"
    length = _piece_ms(F.col("window_ms"))
    cut = groups.withColumn("piece", F.floor(F.col("at_ms") / length).cast("long")).withColumn(
        "piece_start", F.col("piece") * length
    )
    steps = cut.groupBy(*GROUP, "piece").applyInPandas(
        _piece_steps, f"{group_columns}, piece bigint, window_ms bigint, not_after bigint, last_fired bigint"
    )
    entries = (
        steps.repartition(*GROUP)
        .sortWithinPartitions(*GROUP, "piece", "not_after")
        .mapInPandas(_compose, f"{group_columns}, piece bigint, entered_after bigint")
    )
    return (
        cut.join(entries, [*GROUP, "piece"])
        .groupBy(*GROUP, "piece")
        .applyInPandas(_replay_piece, f"{group_columns}, window_ms bigint, at_ms bigint, trigger_uid string")
    )


def firings(instants: DataFrame, fold_limit: int = FOLD_LIMIT) -> DataFrame:
    """The instants at which a rule fires: the first, then each first one at least a window after the last."""
    instants = cut_lineage(instants)
    large = instants.groupBy(*GROUP).count().filter(F.col("count") > fold_limit).drop("count")
    if large.isEmpty():
        return _fold_small(instants)
    small = instants.join(large, list(GROUP), "left_anti")
    return _fold_small(small).unionByName(_fold_large(instants.join(large, list(GROUP), "left_semi")))


def firing_evidence(matches: DataFrame, fires: DataFrame) -> DataFrame:
    """The first 100 events of each firing's window, in time order.

    Firings of a group are at least a window apart, so an event belongs to two of them at most and the join
    cannot multiply rows. ``row_number() <= 100`` is applied before the shuffle too, which bounds what one
    busy window sends to a single task.
    """
    slot = F.floor(F.col("time_ms") / F.col("window_ms")).cast("long")
    events = matches.select(*GROUP, "event_uid", "time_ms", "value", "group_values", slot.alias("slot"))
    last_slot = F.floor(F.col("at_ms") / F.col("window_ms")).cast("long")
    windows = fires.withColumn("slot", F.explode(F.array(last_slot - 1, last_slot)))
    inside = (F.col("time_ms") >= F.col("at_ms") - F.col("window_ms")) & (
        (F.col("time_ms") < F.col("at_ms"))
        | ((F.col("time_ms") == F.col("at_ms")) & (F.col("event_uid") <= F.col("trigger_uid")))
    )
    order = W.partitionBy(*GROUP, "at_ms").orderBy("time_ms", "event_uid")
    return (
        events.join(windows, [*GROUP, "slot"])
        .filter(inside)
        .withColumn("rank", F.row_number().over(order))
        .filter(F.col("rank") <= MAX_EVIDENCE)
    )


def threshold_findings(matches: DataFrame, fires: DataFrame, rules: list[Rule]) -> DataFrame:
    rows = firing_evidence(matches, fires)
    grouped = rows.groupBy(*GROUP, "at_ms").agg(
        F.array_sort(F.collect_list(F.struct("time_ms", "event_uid", "value"))).alias("events"),
        F.first("group_values").alias("group_values"),
    )
    first = F.get("events", F.lit(0))
    values = F.slice(F.array_sort(F.array_distinct(F.array_compact(F.transform("events", lambda e: e["value"])))), 1, MAX_ENTITY_VALUES)
    grouping = F.map_from_arrays("group_by", F.transform("group_values", lambda v: F.array(v)))
    counted = F.when(
        F.col("count_distinct").isNotNull(), F.map_from_arrays(F.array("count_distinct"), F.array(values))
    ).otherwise(F.create_map().cast("map<string,array<string>>"))
    # A field that is both grouped by and counted keeps the counted values.
    plain = F.map_filter(grouping, lambda k, v: F.coalesce(k != F.col("count_distinct"), F.lit(True)))
    meta = F.broadcast(_rule_meta(matches, rules))
    return grouped.join(meta, "rule").select(
        "org_id",
        ids.digest(F.col("rule_id"), F.col("group_key"), F.col("at_ms"), first["event_uid"]).alias("finding_id"),
        *[c for c in FINDING_COLUMNS if c.startswith("rule_")],
        "severity_id",
        "techniques",
        "tactics",
        F.map_concat(plain, counted).alias("entities"),
        F.transform("events", lambda e: e["event_uid"]).alias("evidence"),
        first["time_ms"].alias("first_ms"),
        F.col("at_ms").alias("last_ms"),
    )


def detect_threshold(events: DataFrame, rules: list[Rule], fold_limit: int = FOLD_LIMIT) -> DataFrame:
    """Findings of the threshold rules; all rules share one window shuffle."""
    if not rules:
        raise ValueError("no threshold rules given")
    matches = threshold_matches(events, rules)
    return threshold_findings(matches, firings(triggers(matches), fold_limit), rules)


def detect(events: DataFrame, rules: list[Rule]) -> DataFrame:
    """Findings of every rule."""
    single = [r for r in rules if not r.is_threshold]
    threshold = [r for r in rules if r.is_threshold]
    parts = [detect_single(events, single)] if single else []
    parts += [detect_threshold(events, threshold)] if threshold else []
    found = parts[0]
    for part in parts[1:]:
        found = found.unionByName(part)
    return found
