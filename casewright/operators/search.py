"""Constrained search with keyset paging. Filters are plain column predicates, so they reach the Parquet scan
and prune partitions; a page is a ``TakeOrderedAndProject``."""

from __future__ import annotations

import re
from datetime import datetime, timedelta
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from casewright.functions.ids import encode_cursor
from casewright.functions.scalars import covers_technique

# --- Fixed values -----------------------------------------------------------------------------------------------
MAX_WINDOW = timedelta(days=90)
MAX_PAGE = 200
MAX_TEXT = 256
TOTAL_CAP = 10_000
IP_FIELDS = ("src_endpoint.ip", "dst_endpoint.ip", "device.ip")
USER_FIELDS = ("user.name", "actor.user.name")
HOST_FIELDS = ("device.hostname", "src_endpoint.hostname", "dst_endpoint.hostname")
TEXT_FIELDS = ("message", "raw_data", "process.cmd_line", "process.file.path")
# ------------------------------------------------------------------------------------------------------------


class SearchRefused(ValueError):
    """A search outside the allowed bounds."""


def _check(condition: bool, message: str) -> None:
    if not condition:
        raise SearchRefused(message)


def _any(fields: tuple[str, ...], test) -> Column:
    return reduce(lambda a, b: a | b, [F.coalesce(test(F.col(f)), F.lit(False)) for f in fields])


def text_matches(query: str, fields: tuple[str, ...] = TEXT_FIELDS) -> Column:
    """Words joined by AND; ``|`` starts an alternative, ``-word`` excludes, ``"a b"`` is a phrase, ``wor*`` a
    prefix. A word matches a whole token in any of the fields, without case."""
    alternatives = []
    for part in query.split("|"):
        tests = []
        for negated, phrase, word in re.findall(r'(-?)(?:"([^"]*)"|(\S+))', part):
            tokens = re.findall(r"\w+", (phrase or word).lower())
            if not tokens:
                continue
            body = r"\W+".join(re.escape(t) for t in tokens)
            end = r"\w*" if word.endswith("*") else ""
            pattern = rf"(?iU)(^|\W){body}{end}(\W|$)"
            found = _any(fields, lambda c, p=pattern: c.rlike(p))
            tests.append(~found if negated else found)
        if tests:
            alternatives.append(reduce(lambda a, b: a & b, tests))
    return reduce(lambda a, b: a | b, alternatives) if alternatives else F.lit(True)


def event_filter(
    *,
    org_id: str,
    time_from: datetime,
    time_to: datetime,
    class_uids: tuple[int, ...] = (),
    severity_min: int | None = None,
    status_id: int | None = None,
    source_id: str | None = None,
    ip: str | None = None,
    user_name: str | None = None,
    hostname: str | None = None,
    text: str | None = None,
) -> Column:
    """The conjunction an event search asks for; every search names its organisation and a bounded time range."""
    _check(time_from < time_to, "time_from must be earlier than time_to")
    _check(time_to - time_from <= MAX_WINDOW, f"a search covers at most {MAX_WINDOW.days} days")
    _check(text is None or len(text) <= MAX_TEXT, f"text is at most {MAX_TEXT} characters")
    tests = [
        F.col("sx.org_id") == org_id,
        F.col("time_ms").between(int(time_from.timestamp() * 1000), int(time_to.timestamp() * 1000)),
    ]
    if class_uids:
        tests.append(F.col("class_uid").isin(*class_uids))
    if severity_min is not None:
        tests.append(F.col("severity_id") >= severity_min)
    if status_id is not None:
        tests.append(F.col("status_id") == status_id)
    if source_id is not None:
        tests.append(F.col("sx.source_id") == source_id)
    if ip:
        tests.append(_any(IP_FIELDS, lambda c: c == ip))
    if user_name:
        tests.append(_any(USER_FIELDS, lambda c: F.lower(c) == user_name.lower()))
    if hostname:
        tests.append(_any(HOST_FIELDS, lambda c: F.lower(c) == hostname.lower()))
    if text:
        tests.append(text_matches(text))
    return reduce(lambda a, b: a & b, tests)


def in_partitions(events: DataFrame, time_from: datetime, time_to: datetime) -> DataFrame:
    """Restrict a stored events table to the date partitions a search can touch."""
    if "event_date" not in events.columns:
        return events
    return events.filter(F.col("event_date").between(time_from.date(), time_to.date()))


def _paged(df: DataFrame, order: list[Column], limit: int, cursor: Column) -> DataFrame:
    """The first ``limit`` rows with what the next request needs: ``has_more`` and ``next_cursor``.

    One row more than asked for is read; what is numbered here has ``limit + 1`` rows at most. ``next_cursor`` is the
    cursor of the page's last row, null on the last page. A page without rows says nothing: there is no next one.
    """
    _check(1 <= limit <= MAX_PAGE, f"limit must be between 1 and {MAX_PAGE}")
    probed = df.orderBy(*order).limit(limit + 1)
    whole = W.rowsBetween(W.unboundedPreceding, W.unboundedFollowing)
    placed = probed.withColumn("_place", F.row_number().over(W.orderBy(*order)))
    counted = placed.withColumn("has_more", F.max("_place").over(whole) > limit).filter(F.col("_place") <= limit)
    last = F.max_by(cursor, F.col("_place")).over(whole)
    return counted.withColumn("next_cursor", F.when(F.col("has_more"), last)).orderBy("_place").drop("_place")


def page(
    df: DataFrame, time: str, key: str, limit: int, cursor: tuple[int, str] | None = None
) -> DataFrame:
    """One page, newest first, resuming after ``cursor`` (the last row's time and id)."""
    if cursor is not None:
        at, last = cursor
        df = df.filter((F.col(time) < at) | ((F.col(time) == at) & (F.col(key) < last)))
    return _paged(df, [F.col(time).desc(), F.col(key).desc()], limit, encode_cursor(F.col(time), F.col(key)))


def search_events(events: DataFrame, *, limit: int = 50, cursor: tuple[int, str] | None = None, **filters) -> DataFrame:
    narrowed = in_partitions(events, filters["time_from"], filters["time_to"])
    found = narrowed.filter(event_filter(**filters)).withColumn("event_uid", F.col("sx.event_uid"))
    return page(found, "time_ms", "event_uid", limit, cursor)


def count_events(events: DataFrame, **filters) -> DataFrame:
    """How many events match, counted up to the cap and no further."""
    found = in_partitions(events, filters["time_from"], filters["time_to"]).filter(event_filter(**filters))
    total = found.select(F.lit(1)).limit(TOTAL_CAP + 1).agg(F.count("*").alias("n"))
    return total.select(
        F.least(F.col("n"), F.lit(TOTAL_CAP).cast("long")).alias("total"), (F.col("n") > TOTAL_CAP).alias("is_lower_bound")
    )


def get_event(events: DataFrame, org_id: str, event_uid: str) -> DataFrame:
    """One event of an organisation by id."""
    return events.filter((F.col("sx.org_id") == org_id) & (F.col("sx.event_uid") == event_uid)).limit(1)


def _range(column: str, low: int | None, high: int | None) -> list[Column]:
    tests = [] if low is None else [F.col(column) >= low]
    return tests + ([] if high is None else [F.col(column) <= high])


def search_findings(
    findings: DataFrame,
    *,
    org_id: str,
    from_ms: int | None = None,
    to_ms: int | None = None,
    severity_min: int | None = None,
    rule_id: str | None = None,
    technique: str | None = None,
    limit: int = 50,
    cursor: tuple[int, str] | None = None,
) -> DataFrame:
    tests = [F.col("org_id") == org_id, *_range("last_ms", from_ms, to_ms)]
    if severity_min is not None:
        tests.append(F.col("severity_id") >= severity_min)
    if rule_id is not None:
        tests.append(F.col("rule_id") == rule_id)
    if technique is not None:
        tests.append(F.array_contains("techniques", technique))
    return page(findings.filter(reduce(lambda a, b: a & b, tests)), "last_ms", "finding_id", limit, cursor)


def search_incidents(
    incidents: DataFrame,
    *,
    org_id: str,
    from_ms: int | None = None,
    to_ms: int | None = None,
    status: str | None = None,
    severity_min: int | None = None,
    limit: int = 50,
    cursor: tuple[int, str] | None = None,
) -> DataFrame:
    tests = [F.col("org_id") == org_id, *_range("last_ms", from_ms, to_ms)]
    if status is not None:
        tests.append(F.col("status") == status)
    if severity_min is not None:
        tests.append(F.col("severity_id") >= severity_min)
    return page(incidents.filter(reduce(lambda a, b: a & b, tests)), "last_ms", "incident_id", limit, cursor)


def search_audit(
    log: DataFrame,
    *,
    org_id: str,
    action: str | None = None,
    resource_type: str | None = None,
    actor_id: str | None = None,
    before_index: int | None = None,
    limit: int = 50,
) -> DataFrame:
    """Audit entries of an organisation, newest index first; the cursor is the last index."""
    tests = [F.col("org_id") == org_id]
    for name, wanted in (("action", action), ("resource_type", resource_type), ("actor_id", actor_id)):
        if wanted is not None:
            tests.append(F.col(name) == wanted)
    if before_index is not None:
        tests.append(F.col("chain_index") < before_index)
    found = log.filter(reduce(lambda a, b: a & b, tests))
    return _paged(found, [F.col("chain_index").desc()], limit, F.col("chain_index").cast("string"))


def rule_filter(technique: str | None = None, logsource: str | None = None) -> Column:
    """Rules for a technique (its parent and children count) and a log scope; threshold rules have no scope."""
    test = F.lit(True)
    if technique is not None:
        test = test & F.exists("techniques", lambda t: covers_technique(t, F.lit(technique)))
    if logsource is not None:
        test = test & (F.lower(F.coalesce("logsource", F.lit(""))) == logsource.lower())
    return test


def rule_page(rules: DataFrame, *, limit: int = 50, after: str | None = None, **filters) -> DataFrame:
    """Rules by title with how many there are in all, resuming after the rule ``after``; an unknown one is refused."""
    whole = W.rowsBetween(W.unboundedPreceding, W.unboundedFollowing)  # a catalogue of rules is small
    chosen = rules.filter(rule_filter(**filters)).withColumn("total", F.count("*").over(whole))
    if after is not None:
        place = chosen.filter(F.col("rule_id") == after).select(F.lower("title").alias("title")).first()
        _check(place is not None, "unknown page cursor")
        title = F.lower("title")
        chosen = chosen.filter((title > place.title) | ((title == place.title) & (F.col("rule_id") > after)))
    return _paged(chosen, [F.lower("title"), F.col("rule_id")], limit, F.col("rule_id"))
