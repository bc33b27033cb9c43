from __future__ import annotations

import hashlib
import json
from datetime import datetime

import pytest
from pyspark.sql import functions as F

from casewright.operators import audit, grounding, intel, search


@pytest.fixture(scope="module")
def log(spark):
    rows = [
        (org, n, datetime(2026, 1, 1, 0, 0, n), "u1", "user", "incident.opened", "incident", f"é{n}", None, json.dumps({"n": n}, separators=(",", ":")), None, None)
        for org in ("a", "b")
        for n in range(6)
    ]
    entries = spark.createDataFrame(
        rows,
        "org_id string, position long, ts timestamp, actor_id string, actor_type string, action string, resource_type string, "
        "resource_id string, before string, after string, context string, correlation_id string",
    )
    return audit.append_entries(entries).cache()


def test_chain_is_what_the_standard_library_hashes(log):
    previous = "0" * 64
    for r in log.filter("org_id = 'a'").orderBy("chain_index").collect():
        content = {
            "org_id": "a", "chain_index": r.chain_index, "ts": r.ts.strftime("%Y-%m-%dT%H:%M:%S.%fZ"), "actor_id": "u1", "actor_type": "user",
            "action": r.action, "resource_type": "incident", "resource_id": r.resource_id, "before": None, "after": json.loads(r.after),
            "context": None, "correlation_id": None,
        }
        text = json.dumps(content, sort_keys=True, separators=(",", ":"), ensure_ascii=False)
        assert r.prev_hash == previous
        previous = hashlib.sha256((previous + text).encode()).hexdigest()
        assert r.entry_hash == previous


@pytest.mark.parametrize(
    ("tamper", "expected"),
    [
        (lambda d: d, (True, 6, None, None)),
        (lambda d: d.withColumn("action", F.when(F.col("chain_index") == 2, "x").otherwise(F.col("action"))), (False, 2, 2, "entry content does not match its hash")),
        (lambda d: d.filter("chain_index <> 3"), (False, 3, 4, "expected chain_index 3 (entry missing or inserted)")),
        (lambda d: d.filter("chain_index <> 0"), (False, 0, 1, "expected chain_index 0 (entry missing or inserted)")),
        (lambda d: d.withColumn("prev_hash", F.when(F.col("chain_index") == 4, "y").otherwise(F.col("prev_hash"))), (False, 4, 4, "prev_hash does not match preceding entry")),
        (lambda d: d.unionByName(d.filter("chain_index = 1")), (False, 2, 1, "expected chain_index 2 (entry missing or inserted)")),
    ],
)
def test_tampering_is_found_where_it_happened(log, tamper, expected):
    changed = tamper(log.filter("org_id = 'a'")).unionByName(log.filter("org_id = 'b'"))
    verdicts = {r.org_id: r for r in audit.verify_chain(changed).collect()}
    a = verdicts["a"]
    assert (a.valid, a.entries_checked, a.broken_at_index, a.reason) == expected
    assert verdicts["b"].valid


def test_append_continues_from_the_head(spark, log):
    head = log.groupBy("org_id").agg(F.max("chain_index").alias("chain_index"), F.max_by("entry_hash", "chain_index").alias("entry_hash"))
    more = log.filter("chain_index < 2").drop("chain_index", "prev_hash", "entry_hash").withColumn("position", F.col("resource_id").substr(2, 1).cast("long"))
    grown = log.unionByName(audit.append_entries(more, head))
    assert {(r.valid, r.entries_checked) for r in audit.verify_chain(grown).collect()} == {(True, 8)}


def test_statements_stand_only_on_what_is_known(spark):
    answer = {
        "facts": [
            {"text": "good", "evidence": ["e1", "e1"]},
            {"text": "cites more", "evidence": ["e1", "nope"]},
            {"text": "no citation", "evidence": []},
            {"text": "names 203.0.113.99", "evidence": ["e1"]},
        ],
        "inferences": [{"text": "why", "evidence": ["e1"]}, {"text": "why", "evidence": ["e1"], "reasoning": "because 198.51.100.1"}],
        "uncertainties": [{"text": "open"}, {"text": "open", "missing": "dns logs"}],
        "techniques": [
            {"technique_id": "t1110.003", "evidence": ["e1"], "kind": "fact"}, {"technique_id": "T1110.003", "evidence": ["e2", "e1"]}, {"technique_id": "x", "evidence": ["e1"]},
        ],
    }
    answers = spark.createDataFrame([("a1", "i1", "```json\n" + json.dumps(answer) + "\n```"), ("a2", "i1", "no json")], "analysis_id string, incident_id string, raw string")
    parsed = grounding.parse_answers(answers)
    known = spark.createDataFrame([("i1", "e1"), ("i1", "e2")], "incident_id string, event_uid string")
    values = spark.createDataFrame([("i1", "198.51.100.1")], "incident_id string, value string")
    rows = grounding.ground_statements(grounding.answer_statements(parsed), known, values).orderBy("position").collect()
    assert [r.reason for r in rows] == [
        None,
        "cites events that are not in the incident: nope",
        "a FACT must cite at least one event",
        "mentions 203.0.113.99, which is not in the evidence",
        "an INFERENCE must give its reasoning",
        None,
        "an UNCERTAINTY must say what information would resolve it",
        None,
    ]
    assert rows[0].evidence == ["e1"]
    merged = grounding.merge_techniques(grounding.answer_techniques(parsed)).collect()
    assert [(r.technique_id, r.evidence, r.kind) for r in merged] == [("T1110.003", ["e1", "e2"], "FACT")]
    assert parsed.filter("answer is null").count() == 1


def test_claims_are_checked_against_edges(spark):
    edges = spark.createDataFrame(
        [("i", "host:ws-1", "connected_to", "ip:192.0.2.66"), ("i", "process:winword.exe", "spawned", "process:powershell.exe"), ("i", "ip:198.51.100.2", "logon", "host:ws-1")],
        "incident_id string, source string, relation string, target string",
    )
    names = [
        "host:ws-1", "ip:192.0.2.66", "process:powershell.exe", "process:winword.exe", "file:C:\\x\\powershell.exe", "ip:198.51.100.2", "user:corp\\mkim",
    ]
    entities = spark.createDataFrame([("i", n) for n in names], "incident_id string, entity_key string")
    texts = {
        "s1": "PowerShell connected to 192.0.2.66",
        "s2": "WS-1 connected to 192.0.2.66.",
        "s3": "powershell.exe was spawned by winword.exe",
        "s4": "WINWORD spawned powershell.exe, then ws-1 connected to 198.51.100.2",
        "s5": "ws-1 logged on to 198.51.100.2 according to corp\\mkim",
        "s6": "nothing here",
    }
    statements = spark.createDataFrame([(k, "i", v) for k, v in texts.items()], "statement_id string, incident_id string, text string")
    claims = grounding.attribution_claims(statements, entities, edges).collect()
    assert sorted((r.statement_id, r.subject, r.verb, r.target, r.supported) for r in claims) == [
        ("s1", "process:powershell.exe", "connected to", "ip:192.0.2.66", False),
        ("s2", "host:ws-1", "connected to", "ip:192.0.2.66", True),
        ("s4", "host:ws-1", "connected to", "ip:198.51.100.2", False),
        ("s4", "process:winword.exe", "spawned", "process:powershell.exe", True),
        ("s5", "host:ws-1", "logged on to", "ip:198.51.100.2", True),
    ]


def test_indicators(spark):
    keys = {
        "ip:203.0.113.9": ("ip", "203.0.113.9"), "ip:10.0.0.1": None, "domain:Bad.Example.": ("domain", "bad.example"), "domain:host": None,
        "hash:" + "a" * 32: ("hash", "a" * 32), "hash:zz": None, "host:ws-1": None, "nothing": None, "ip:2001:DB8::1": ("ip", "2001:db8::1"),
    }
    df = spark.createDataFrame([(k,) for k in keys], "key string").select("key", intel.parse_indicator(F.col("key")).alias("i"))
    assert {r.key: (r.i and tuple(r.i)) for r in df.collect()} == keys


def test_cached_answers_are_asked_again_only_when_stale(spark):
    wanted = spark.createDataFrame([("ip", "1.1.1.1"), ("ip", "2.2.2.2"), ("ip", "3.3.3.3")], "type string, value string")
    rows = spark.createDataFrame([("ip", "1.1.1.1", "malicious", "s", 150)], "type string, value string, verdict string, summary string, confidence int")
    first = intel.enrich(wanted, rows, None, "p", F.lit(1000), 100)
    assert {(r.value, r.status, r.confidence, r.expires_ms) for r in first.collect()} == {
        ("1.1.1.1", "found", 100, 1100), ("2.2.2.2", "not_found", None, 1100), ("3.3.3.3", "not_found", None, 1100),
    }
    cached = first.filter("value <> '3.3.3.3'")
    assert {r.value for r in intel.enrich(wanted, rows, cached, "p", F.lit(1099), 100).collect()} == {"3.3.3.3"}
    assert intel.enrich(wanted, rows, cached, "p", F.lit(1100), 100).count() == 3
    failed = intel.intel_results(wanted.withColumns({"verdict": F.lit(None).cast("string"), "error": F.lit("timeout")}), "p", F.lit(0))
    assert {(r.status, r.expires_ms) for r in failed.collect()} == {("error", 15 * 60_000)}


def test_searches_outside_their_bounds_are_refused(spark, story_events):
    window = {"org_id": "org", "time_from": datetime(2026, 1, 1), "time_to": datetime(2026, 12, 1)}
    with pytest.raises(search.SearchRefused):
        search.search_events(story_events, **window)
    with pytest.raises(search.SearchRefused):
        search.page(story_events, "time_ms", "message", 201)


def test_pages_cover_everything_once(spark, story_events):
    window = {"org_id": "org", "time_from": datetime(2026, 3, 1), "time_to": datetime(2026, 3, 4)}
    seen, cursor = [], None
    while True:
        rows = search.search_events(story_events, limit=7, cursor=cursor, **window).select("time_ms", "event_uid").collect()
        seen += [tuple(r) for r in rows]
        if len(rows) < 7:
            break
        cursor = seen[-1]
    assert len(seen) == len(set(seen)) == story_events.count()
    assert seen == sorted(seen, reverse=True)
