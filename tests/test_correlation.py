from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

from casewright.operators import baseline, correlate, entities, graph, reports, timeline, triage
from casewright.operators.entities import digest


def by_host(tables):
    hosts = {r.incident_id: r.entity_value for r in tables.entities.filter("entity_type = 'host'").collect()}
    return {hosts[r.incident_id]: r for r in tables.incidents.collect()}


def test_each_story_is_one_incident(story_incidents):
    incidents = by_host(story_incidents)
    assert set(incidents) == {"web-7", "desk-3"}
    web, desk = incidents["web-7"], incidents["desk-3"]
    assert (web.finding_count, web.severity_id) == (4, 4)
    assert web.title == "Successful logon after repeated failures from 203.0.113.9 on web-7"
    assert (desk.finding_count, desk.severity_id) == (5, 5)
    assert desk.title == (
        "Successful logon after repeated failures from 198.51.100.77, "
        "then execution, stealth, discovery, command and control on desk-3"
    )
    assert desk.tactics == ["credential_access", "execution", "stealth", "discovery", "command_and_control"]
    rules = {(r.incident_id, r.rule) for r in story_incidents.assessments.collect()}
    assert {rule for i, rule in rules if i == desk.incident_id} == {
        "highest-finding-severity", "credential-compromise", "multi-stage", "compromise-then-activity",
    }


def test_links_name_what_joins_them(story_incidents, story_events):
    links = story_incidents.links.orderBy("first_ms", "link_id").collect()
    logons = [r for r in links if r.kind == "event"]
    assert {m.key for r in logons for m in r.matched} == {
        "ip:203.0.113.9", "host:web-7", "ip:198.51.100.77", "host:desk-3",
    }
    for link in links:
        assert link.evidence
        if link.rule != "opened":
            assert link.matched
        earlier = {u for o in links if o.incident_id == link.incident_id and o.first_ms <= link.first_ms for u in o.evidence}
        for match in link.matched:
            assert match.new_events and set(match.new_events) <= set(link.evidence)
            assert match.incident_events and set(match.incident_events) <= earlier
    beacon = next(r for r in links if r.rule_title and "keeps connecting" in r.rule_title)
    assert "host:desk-3" in {m.key for m in beacon.matched}


def test_background_stays_out(story_incidents, story_events):
    cited = {r[0] for r in story_incidents.links.select(F.explode("evidence")).distinct().collect()}
    background = story_events.filter(
        (F.col("user.name") == "dana") | (F.col("dst_endpoint.hostname") == "FILES") | (F.col("logon_type_id") == 2)
    ).select("sx.event_uid")
    assert not cited & {r[0] for r in background.collect()}
    assert "host:files" not in {r.entity_key for r in story_incidents.entities.collect()}


def test_timeline_and_graph(story_incidents):
    steps = timeline.timeline(story_incidents.evidence).orderBy("first_ms").collect()
    desk = next(r.incident_id for r in steps if r.host == "desk-3")
    told = [(r.action, r.outcome, r.event_count) for r in steps if r.incident_id == desk]
    assert told == [
        ("Failed logon", "failure", 5),
        ("Logged on", "success", 1),
        ("Process started", "success", 1),
        ("Process started", "success", 1),
        ("Process started", "success", 1),
        ("Network connection", None, 5),
    ]
    edges = {(r.source, r.relation, r.target): r for r in graph.edges(story_incidents.evidence, ["incident_id"]).collect()}
    assert edges[("ip:198.51.100.77", "failed_logon", "host:desk-3")].event_count == 5
    assert edges[("user:corp\\mkim", "started", "process:whoami.exe")].event_count == 1
    assert edges[("process:powershell.exe", "spawned", "process:whoami.exe")].label == "spawned"
    assert edges[("host:desk-3", "connected_to", "ip:192.0.2.200")].ports == [443]


def test_baseline_keys_agree_between_events_and_digests(story_events):
    from_events = {(r.kind, r.key) for r in baseline.observations(story_events).collect()}
    from_digests = {(r.kind, r.key) for r in baseline.evidence_observations(digest(story_events)).collect()}
    assert from_events == from_digests
    assert ("process_pair", "powershell.exe -> whoami.exe") in from_events
    assert ("host_remote", "desk-3 -> 192.0.2.200") in from_events


def test_exports_are_stable_and_complete(spark, story_incidents, tmp_path):
    now = F.lit("2026-04-01T00:00:00Z").cast("timestamp")
    i = story_incidents
    members = timeline.step_members(i.evidence)
    steps, citations = timeline.timeline(i.evidence), timeline.step_citations(members, i.links)

    def flow():
        rows = reports.attack_flow(i.incidents, steps, citations, members, now).orderBy("incident_id", "position")
        return [(r.incident_id, r.object) for r in rows.collect()]

    first = flow()
    assert first == flow()
    actions = [o for _, o in first if '"type":"attack-action"' in o]
    assert len(actions) == steps.count()
    assert sum('"effect_refs"' in o for o in actions) == len(actions) - 2, "all but each incident's last step point on"
    lines = reports.report_lines(i.incidents, i.assessments, steps, members, citations, i.links, i.entities, None, now)
    text = "\n".join(r.line for r in lines.orderBy("incident_id", "section", "at", "item", "line_no").collect())
    assert "# Successful logon after repeated failures from 203.0.113.9 on web-7" in text
    assert "### 1. Failed logon (failure)" in text, "steps are numbered in order"
    assert text.count("## How to check this report") == 2 and text.count("No notes.") == 2
    assert text.count("## Links between findings") <= 2
    reports.write_documents(lines, str(tmp_path / "reports"), ["section", "at", "item", "line_no"])
    written = spark.read.text(str(tmp_path / "reports"))
    assert written.select("incident_id").distinct().count() == 2
    assert written.filter("value like '# %'").count() == 2
    layers = reports.incident_layers(i.incidents, i.links, now).collect()
    assert all('"domain":"enterprise-attack"' in r.value for r in layers)
    bundle = reports.evidence_bundle(i.incidents, i.evidence, i.links, i.entities)
    digests = reports.bundle_digests(bundle).collect()
    assert sorted(digests) == sorted(reports.bundle_digests(bundle.repartition(7)).collect())
    assert {r.part for r in bundle.select("part").distinct().collect()} == {
        "incident", "event", "finding", "link", "step", "edge", "entity",
    }


def fold_one_by_one(items, window=correlate.CORRELATION_WINDOW_MS):
    incidents, placed = [], {}
    for item, first, last, keys in sorted(items, key=lambda r: (r[1], r[0])):
        best = None
        for number, held in enumerate(incidents):
            shared = held[2] & set(keys)
            if shared and held[1] >= first - window and held[0] <= last + window:
                best = max(best or (0,), (len(shared), held[1], number))
        if best is None:
            incidents.append([first, last, set(keys)])
            placed[item] = len(incidents) - 1
        else:
            held = incidents[best[2]]
            held[0], held[1] = min(held[0], first), max(held[1], last)
            held[2] |= set(keys)
            placed[item] = best[2]
    return placed


def test_parallel_fold_equals_one_by_one(spark):
    """One key sits in a third of all findings; quiet spells cut the rest into islands."""
    rng = random.Random(3)
    items = []
    for n in range(400):
        first = rng.randrange(0, 40 * 3_600_000)
        keys = {f"ip:{rng.randint(0, 60)}", f"host:{rng.randint(0, 40)}"}
        if rng.random() < 0.33 and first < 15 * 3_600_000:
            keys.add("host:hot")
        items.append((f"f{n:04}", first, first + rng.randrange(0, 1_800_000), sorted(keys)))
    items.append(("f9998", 5, 5, []))
    items.append(("f9999", 5, 5, []))
    keyed = spark.createDataFrame(items, "finding_id string, first_ms long, last_ms long, keys array<string>").withColumn("org_id", F.lit("o"))
    groups = {}
    for row in correlate.assign(keyed).collect():
        groups.setdefault(row.incident_id, set()).add(row.finding_id)
    expected = {}
    for item, number in fold_one_by_one(items[:-2]).items():
        expected.setdefault(number, set()).add(item)
    assert sorted(map(sorted, groups.values())) == sorted([*map(sorted, expected.values()), ["f9998"], ["f9999"]])


def test_components(spark):
    rng = random.Random(5)
    pairs = [(f"n{rng.randint(0, 300):03}", f"n{rng.randint(0, 300):03}") for _ in range(220)]
    pairs += [(f"c{n:03}", f"c{n + 1:03}") for n in range(120)]  # a long chain
    pairs += [("hub", f"s{n:03}") for n in range(150)]  # a hub
    parent = {}

    def root(x):
        while parent.setdefault(x, x) != x:
            x = parent[x]
        return x

    for a, b in pairs:
        ra, rb = root(a), root(b)
        parent[max(ra, rb)] = min(ra, rb)
    found = {r.node: r.component for r in correlate.connected_components(spark.createDataFrame(pairs, "a string, b string")).collect()}
    assert found == {n: root(n) for n in parent}


def test_status_changes(spark):
    current = spark.createDataFrame(
        [("i", "investigating", None, 3), ("j", "closed", "true_positive", 1)],
        "incident_id string, status string, resolution string, version int",
    )
    asked = [
        (1, "i", "closed", "benign_positive", 3), (2, "i", "closed", None, 3), (3, "i", "new", None, 3),
        (4, "i", "investigating", None, 3), (5, "i", "closed", "true_positive", 2), (6, "j", "investigating", None, 1), (7, "x", "new", None, 1),
    ]
    checked = triage.check_status_changes(
        spark.createDataFrame(asked, "request_id int, incident_id string, status string, resolution string, version int"), current
    )
    assert {r.request_id: r.refusal for r in checked.collect()} == {
        1: None,
        2: "closing needs a resolution",
        3: "an incident cannot go back to new",
        4: "the incident is already investigating",
        5: "the incident changed since it was loaded",
        6: None,
        7: "no such incident",
    }


def test_entities_keep_their_roles(spark, story_events):
    sightings = entities.extract_sightings(story_events)
    assert sightings.groupBy("event_uid", "entity_key").count().filter("count > 1").count() == 0
    linking = {(r.entity_type, r.links) for r in sightings.select("entity_type", "links").distinct().collect()}
    assert ("process", True) not in linking and ("file", True) not in linking and ("host", False) not in linking
    assert {r.entity_value for r in sightings.filter("entity_type = 'ip' and not links").collect()} == {
        "10.0.1.20", "10.0.5.3", "10.0.5.9", "10.0.0.4",
    }


@pytest.mark.parametrize("seed", range(3))
def test_hosts_that_logons_bring_in_order(spark, seed):
    """Against taking the logons one by one, with chains, ties in time and a host reached later and then earlier."""
    draw = random.Random(seed)
    logons = [
        (f"i{draw.randrange(3)}", f"e{n:03d}", draw.randrange(40), sorted(draw.sample([f"host:h{h}" for h in range(25)], draw.choice([1, 2, 2, 3]))))
        for n in range(90)
    ]
    known = [(f"i{i}", f"host:h{i}") for i in range(3)] + [("i9", "host:h9")]
    since = {pair: (-(2**63), "") for pair in known}
    for incident, event, at, hosts in sorted(logons, key=lambda r: (r[2], r[1])):
        if any((incident, h) in since for h in hosts):
            for h in hosts:
                since.setdefault((incident, h), (at, event))
    followed = spark.createDataFrame(logons, "incident_id string, event_uid string, at_ms long, host_keys array<string>")
    held = spark.createDataFrame(known, "incident_id string, entity_key string")
    found = correlate._reached_hosts(followed, held).collect()
    assert {(r.incident_id, r.entity_key): tuple(r.since) for r in found} == since
    assert len(found) == len(since) and len(since) > len(known) + 3
    assert correlate._reached_hosts(followed.limit(0), held.limit(0)).collect() == []
