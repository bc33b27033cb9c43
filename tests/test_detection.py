from __future__ import annotations

import random
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from casewright.operators import detect
from casewright.operators.rules import compile_threshold
from casewright.schema import conform


def logons(spark, rows):
    """``(uid, time_ms, ip, user)`` as failed logons."""
    df = spark.createDataFrame(rows, "uid string, t long, ip string, name string")
    return conform(
        df.select(
            F.lit(3002).alias("class_uid"),
            F.lit(1).alias("activity_id"),
            F.lit(2).alias("status_id"),
            F.timestamp_millis("t").alias("time"),
            F.col("t").alias("time_ms"),
            F.struct("ip").alias("src_endpoint"),
            F.struct("name").alias("user"),
            F.struct(F.lit("o").alias("org_id"), F.col("uid").alias("event_uid")).alias("sx"),
        )
    )


def spec(**more):
    return compile_threshold(
        {
            "id": "r", "title": "t", "level": "low", "match": {"class_uid": 3002}, "group_by": ["src_endpoint.ip"],
            "threshold": 3, "window": "60s",
        } | more
    )


def replay(rows, rule):
    """One event at a time, in (time, uid) order."""
    seen, fired, found = defaultdict(dict), {}, []
    for uid, at, ip, name in sorted(rows, key=lambda r: (r[1], r[0])):
        if ip is None or (rule.count_distinct and name is None):
            continue
        seen[ip].setdefault(uid, (at, uid, name))
        window = sorted(e for e in seen[ip].values() if at - rule.window_ms <= e[0] <= at)
        count = len({e[2] for e in window}) if rule.count_distinct else len(window)
        last = fired.get(ip)
        if count < rule.threshold or (last is not None and at - last < rule.window_ms):
            continue
        fired[ip] = at
        found.append((ip, at, tuple(e[1] for e in window[:100])))
    return sorted(found)


def run(spark, rows, rule, **options):
    found = detect.detect_threshold(logons(spark, rows), [rule], **options).collect()
    return sorted((r.entities["src_endpoint.ip"][0], r.last_ms, tuple(r.evidence)) for r in found)


def test_window_and_cooldown(spark):
    one = [(f"a{s:03}", s * 1000, "10.0.0.1", "a") for s in (0, 20, 40, 50, 300, 301, 302)]
    other = [(f"b{s:03}", s * 1000, "10.0.0.2", "a") for s in (1, 100, 200)]
    assert run(spark, one + other, spec()) == [
        ("10.0.0.1", 40_000, ("a000", "a020", "a040")),
        ("10.0.0.1", 302_000, ("a300", "a301", "a302")),
    ]


def test_events_without_the_group_or_counted_value_do_not_count(spark):
    rows = [("a", 0, None, "x"), ("b", 1, "1.1.1.1", "x"), ("c", 2, "1.1.1.1", None), ("d", 3, "1.1.1.1", "y"), ("e", 4, "1.1.1.1", "z")]
    assert run(spark, rows, spec(count_distinct="user.name")) == [("1.1.1.1", 4, ("b", "d", "e"))]


@pytest.mark.parametrize("distinct", [None, "user.name"])
@pytest.mark.parametrize("fold_limit", [detect.FOLD_LIMIT, 2])
def test_equals_replay_with_a_hot_group(spark, distinct, fold_limit):
    """One group holds most rows and never falls quiet; many events share a millisecond."""
    rng = random.Random(7)
    rows = []
    for n in range(1500):
        ip = "10.0.0.1" if rng.random() < 0.7 else f"10.0.0.{rng.randint(2, 6)}"
        rows.append((f"e{n:05}", rng.randrange(0, 4_000_000, 250), ip, f"u{rng.randint(0, 5)}"))
    rule = spec(count_distinct=distinct, threshold=4 if distinct else 6)
    assert run(spark, rows, rule, fold_limit=fold_limit) == replay(rows, rule)


def test_evidence_is_capped_but_counting_is_not(spark):
    rows = [(f"e{n:04}", n, "10.0.0.1", f"u{n % 30}") for n in range(400)]
    rule = spec(threshold=300, count_distinct=None)
    [(ip, at, evidence)] = run(spark, rows, rule)
    assert (at, len(evidence), evidence[0], evidence[-1]) == (299, 100, "e0000", "e0099")


def test_redelivered_events_change_nothing(spark):
    rows = [(f"e{n}", n * 1000, "10.0.0.1", "a") for n in range(5)]
    events = logons(spark, rows)
    rule = spec()
    once = {r.finding_id for r in detect.detect_threshold(events, [rule]).collect()}
    # Stored events are unique by id; the counted windows do not count a copy twice either.
    counted = detect.window_counts(detect.threshold_matches(events.unionByName(events), [rule]))
    assert max(r.seen for r in counted.collect()) == 5
    assert {r.finding_id for r in detect.detect_threshold(events, [rule]).collect()} == once


def test_story_findings(story_findings, story_events):
    titles = Counter(r.rule_title for r in story_findings.collect())
    assert titles == {
        "SSH logon tried for an account that does not exist": 3,
        "One source fails to log on as several accounts": 1,
        "One source keeps failing as one account": 1,
        "PowerShell run with an encoded command": 1,
        "Privileges or groups listed with whoami": 1,
        "Members of Domain Admins listed with net": 1,
        "One host keeps connecting to one outside address": 1,
    }
    uids = {r[0] for r in story_events.select("sx.event_uid").collect()}
    for finding in story_findings.collect():
        assert set(finding.evidence) <= uids
        assert finding.first_ms <= finding.last_ms
    spray = story_findings.filter(F.col("rule_title").contains("several accounts")).first()
    assert spray.entities["src_endpoint.ip"] == ["203.0.113.9"]
    assert spray.entities["user.name"] == ["admin", "backup", "guest", "root"]
    assert len(spray.evidence) == 4
