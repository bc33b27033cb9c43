"""What must hold so that queries grow with their tables: plans, and work that tasks do."""

from __future__ import annotations

import json
import pickle
import re

from pyspark.sql import functions as F

from casewright.operators import correlate, grounding, reports, rules
from casewright.operators.detect import detect_single, matched_rules
from casewright.plans.queries import QUERIES
from casewright.schema import conform
from casewright.sources import records


def test_statements_are_never_broadcast(spark):
    """Their texts are larger than the records they are estimated from; the verbs alone are a fixed table."""
    statements = spark.createDataFrame([("s1", "i", "10.0.0.1 logged on to ws-1"), ("s2", "i", "ws-1 ran")], "statement_id string, incident_id string, text string")
    names = spark.createDataFrame([("i", "ip:10.0.0.1"), ("i", "host:ws-1")], "incident_id string, entity_key string")
    edges = spark.createDataFrame([("i", "ip:10.0.0.1", "logon", "host:ws-1")], "incident_id string, source string, relation string, target string")
    claims = grounding.attribution_claims(statements, names, edges)
    assert [tuple(r) for r in claims.collect()] == [("s1", "i", "ip:10.0.0.1", "logged on to", "host:ws-1", True)]
    plan = grounding.attribution_claims(statements, names, edges)._jdf.queryExecution().executedPlan().toString()
    assert len(re.findall(r"BroadcastExchange", plan)) == 1


def test_statements_are_dealt_out_by_a_number_and_once(spark, monkeypatch):
    """Ids may be long: words, spans and mentions travel without them. Ids that share a number stay apart."""
    rows = [("s" * 64, "i", "10.0.0.1 logged on to ws-1"), ("t" * 64, "i", "Then ws-1 slept; 10.0.0.1 logged on to WS-1."), ("t", "j", "10.0.0.1 logged on to ws-1"), (None, "i", "10.0.0.1 logged on to ws-1"), ("n", "i", None)]
    statements = spark.createDataFrame(rows, "statement_id string, incident_id string, text string")
    names = spark.createDataFrame([("i", "ip:10.0.0.1"), ("i", "host:ws-1"), ("i", "host:ws-2")], "incident_id string, entity_key string")
    edges = spark.createDataFrame([("i", "ip:10.0.0.1", "logon", "host:ws-1")], "incident_id string, source string, relation string, target string")
    plan = grounding.attribution_claims(statements, names, edges)._jdf.queryExecution().executedPlan().toString()
    dealt = re.findall(r"Exchange hashpartitioning\((.*?), \d+\)", plan)
    assert dealt and not [by for by in dealt if "statement_id" in by]
    # The texts three times, Spark runs equal exchanges once; spans and mentions.
    assert len([by for by in dealt if re.fullmatch(r"key#\d+L", by)]) == 5
    wanted = [("s" * 64, "i", "ip:10.0.0.1", "logged on to", "host:ws-1", True), ("t" * 64, "i", "ip:10.0.0.1", "logged on to", "host:ws-1", True)]
    assert sorted(map(tuple, grounding.attribution_claims(statements, names, edges).collect())) == wanted
    assert {(r.statement_id[0], r.start) for r in grounding.entity_mentions(statements, names).collect()} == {("s", 0), ("s", 22), ("t", 5), ("t", 17), ("t", 39)}
    monkeypatch.setattr(grounding.F, "xxhash64", lambda *columns: F.lit(7).cast("long"))
    assert sorted(map(tuple, grounding.attribution_claims(statements, names, edges).collect())) == wanted


def _rule(rule_id, **detection):
    return {"id": rule_id, "title": "t", "level": "low", "logsource": {"category": "process_creation"}, "detection": {"s": detection, "condition": "s"}}


def test_rules_are_compiled_without_a_column_so_that_tasks_can(spark):
    compiled = rules.compile_rule(_rule("a", **{"CommandLine|contains": ["x", 1, True, None]}))
    again = pickle.loads(pickle.dumps(compiled))
    assert again == compiled and str(again.predicate) == str(compiled.predicate)


def test_a_directory_is_compiled_by_tasks_with_ids_and_counted_rules_in_order(spark, tmp_path):
    pack = tmp_path / "pack"
    (pack / "theirs").mkdir(parents=True)
    base = _rule("base", CommandLine="x") | {"name": "counted"}
    count = {"id": "n", "title": "", "level": "low", "correlation": {"type": "event_count", "rules": ["counted"], "group-by": "User", "timespan": "1h", "condition": {"gte": 2}}}
    (pack / "a.json").write_text("\n---\n".join(map(json.dumps, [_rule("one", CommandLine="y"), count | {"id": "one"}, count, count])))
    (pack / "theirs" / "a.json").write_text("\n---\n".join(map(json.dumps, [_rule("one", CommandLine="z"), base, _rule("bad", Nope=1)])))
    (pack / "theirs" / "MANIFEST.json").write_text(json.dumps({"rule_base_url": "https://r/", "files": {"a.json": "a.yml"}}))
    (pack / "broken.yml").write_text("a: [")
    found = rules.load_rules(spark, str(pack))
    assert [(r.id, r.path, r.threshold, r.source_url) for r in found.rules] == [("one", "a.json#1", 0, None), ("n", "a.json#3", 2, None)]
    assert found.rules[1].title == "t", "a correlation without a title has that of the rule it counts"
    assert [p for p, _ in found.refused] == ["broken.yml", "theirs/a.json#1", "theirs/a.json#3", "a.json#2", "a.json#4"]
    assert [r for _, r in found.refused][1::2] == ["duplicate rule id one", "duplicate rule id one"]
    assert found.chosen("threshold = 2", 1)[0].id == "n"


def test_a_pack_has_one_file_a_page(spark, tmp_path):
    rows = [(n,) for n in [*range(24), 3, None]]
    spark.createDataFrame(rows, "page_id long").write.parquet(str(tmp_path / "pages.parquet"))
    out = QUERIES["loaded_rules"](spark, str(tmp_path)).collect()
    paths = {r.path for r in out}
    assert len(out) == len(paths) == 28 and {"own/d0/r0.json", "community/win/sub/r2.json", "community/count/r4.json#2"} <= paths
    assert {r.source_url for r in out} == {None, "https://rules.example/v1/w/2.yml", "https://rules.example/v1/w/14.yml"}
    assert {r.rule_id for r in out if r.path in ("own/r9.json", "community/win/sub/r8.json")} == {"r8", None}


def test_rules_with_one_test_share_a_bit(spark):
    events = conform(
        spark.createDataFrame([("u0", "x"), ("u1", "y"), ("u2", "z")], "uid string, cmd string").select(
            F.lit(1007).alias("class_uid"), F.lit(1).alias("activity_id"), F.lit(0).cast("long").alias("time_ms"),
            F.struct(F.col("cmd").alias("cmd_line")).alias("process"),
            F.struct(F.lit("o").alias("org_id"), F.col("uid").alias("event_uid")).alias("sx"),
        )
    )
    many = [rules.compile_rule(_rule(f"{c}{n}", CommandLine=c)) for n in range(40) for c in "xy"]
    found = detect_single(events, many)
    assert "_mask_1" not in found._jdf.queryExecution().analyzed().toString()
    assert sorted((r.evidence[0], r.rule_id) for r in found.collect()) == sorted([("u0", f"x{n}") for n in range(40)] + [("u1", f"y{n}") for n in range(40)])


def test_hits_of_shared_tests_are_dealt_out_and_joined_with_their_rules_once(spark):
    """A scan of few tasks must not make all findings of an event that fires thousands of rules."""
    commands = [("u0", "x"), ("u0", "x"), ("u1", "y"), (None, "x"), ("", "y"), ("u2", None)]
    events = conform(
        spark.createDataFrame(commands, "uid string, cmd string").coalesce(1).select(
            F.lit(1007).alias("class_uid"), F.lit(1).alias("activity_id"), F.lit(0).cast("long").alias("time_ms"),
            F.struct(F.col("cmd").alias("cmd_line")).alias("process"),
            F.struct(F.lit("o").alias("org_id"), F.col("uid").alias("event_uid")).alias("sx"),
        )
    )
    for copies in (20, 2):
        many = [rules.compile_rule(_rule(f"{c}{n}", CommandLine=c)) for n in range(copies) for c in "xy"]
        found = detect_single(events, many)
        plan = found._jdf.queryExecution().executedPlan().toString()
        assert ("RoundRobinPartitioning" in plan) == (copies == 20) and plan.count("BroadcastHashJoin") == 1
        fired = sorted((r.evidence[0], r.rule_id) for r in found.collect())
        assert fired == sorted([("u0", f"x{n}") for n in range(copies)] * 2 + [("u1", f"y{n}") for n in range(copies)])
        placed = matched_rules(events, many, F.col("sx.event_uid").alias("uid"))
        assert sorted((many[r.rule].id, r.uid) for r in placed.filter("uid = 'u1'").collect()) == sorted((f"y{n}", "u1") for n in range(copies))


def test_an_xml_event_is_decoded_once(spark):
    """However many of its fields are read, and whatever the number of its data."""
    data = "".join(f"<Data Name='{name}'>{value}</Data>" for name, value in (("a", " 1"), ("b", "2"), ("a", "3 "), ("", "4")))
    event = f"<Event><System><EventID>7</EventID><Channel>C</Channel></System><EventData>{data}</EventData></Event>"
    texts = spark.createDataFrame([(1, event * 2), (2, "<Event><Nothing/></Event>")], "id int, value string")
    found = records.xml_events(texts).select(
        "id", "position", "channel", F.col("record.EventID").alias("code"), F.col("record.EventData").alias("data"), F.col("problem.reason").alias("reason")
    )
    good = ("C", "7", {"b": "2", "a": "3"}, None)
    assert [tuple(r) for r in found.sort("id", "position").collect()] == [(1, 0, *good), (1, 1, *good), (2, 0, None, None, None, "event has no readable System element")]
    assert found._jdf.queryExecution().optimizedPlan().toString().lower().count("xml(") == 1


def test_a_link_names_the_first_events_before_it_and_carries_no_more(spark):
    """An entity's list is cut before it meets the links that share it, which may be most of an incident's."""
    spark.createDataFrame([(f"e{n}", n, f"f{n:02}") for n in range(20)], "event_uid string, at long, link_key string").createOrReplaceTempView("kept_events")
    entities = spark.sql(
        "select 'i' incident_id, 'ip:a' entity_key, array_sort(collect_list(struct(at + 1 as _rank, event_uid, "
        "struct(0 as phase, at as first_ms, link_key, 0 as position) as recorded_at))) recorded from kept_events"
    )
    assigned = spark.createDataFrame([("f00", "i", None), ("f03", "i", ["ip:a"]), ("f12", "i", ["ip:a"])], "finding_id string, incident_id string, shared array<string>")
    sightings = spark.createDataFrame(
        [(f, "ip:a", True, n, f"n{n % 7}") for f in ("f00", "f03", "f12") for n in range(9)], "finding_id string, entity_key string, links boolean, position int, event_uid string"
    )
    meta = {name: F.lit("r") for name in ("rule_id", "rule_title", "rule_author", "rule_source")} | {name: F.array(F.lit("t")) for name in ("techniques", "tactics", "evidence")}
    rows = spark.createDataFrame([("f00", 0), ("f03", 3), ("f12", 12)], "finding_id string, first_ms long")
    findings = rows.select("*", F.lit("o").alias("org_id"), F.col("first_ms").alias("last_ms"), F.lit(1).alias("severity_id"), *[v.alias(k) for k, v in meta.items()])
    links = correlate.finding_links(findings, assigned, sightings, entities)
    shown = {r.finding_id: [(m.key, m.incident_events, m.new_events) for m in r.matched] for r in links.collect()}
    new = [f"n{n}" for n in range(5)]
    assert shown == {"f00": [], "f03": [("ip:a", ["e0", "e1", "e2"], new)], "f12": [("ip:a", [f"e{n}" for n in range(5)], new)]}
    plan = links._jdf.queryExecution().optimizedPlan().toString()
    assert re.search(r"slice\(\S*recorded\S*, 1, 5\)", plan) or "slice(array_sort" in plan


def test_a_bundle_shuffles_the_names_links_share_without_their_events(spark, story_incidents):
    i = story_incidents
    bundle = reports.evidence_bundle(i.incidents, i.evidence, i.links, i.entities)
    kept = bundle.filter("part = 'link'").select("item", F.from_json("body", "shared_entities array<string>, events array<string>").alias("b"))
    expected = {r.link_id: [m.key for m in r.matched] for r in i.links.collect()}
    assert any(expected.values()) and {r.item: r.b.shared_entities for r in kept.collect()} == expected
    plan = kept._jdf.queryExecution().optimizedPlan().toString()
    above = plan[: plan.index("Join LeftOuter")]
    assert "transform(matched" not in above


def test_entities_are_taken_from_events_once_for_a_lookup(spark, tmp_path):
    rows = [(n, f"2024-01-05 00:00:0{n}", n, ["purchase", "view", "error"][n % 3], f'{{"k": {n}}}') for n in range(9)]
    events = spark.createDataFrame(rows, "event_id long, ts string, user_id long, event_type string, props string")
    events.withColumn("ts", F.col("ts").cast("timestamp_ntz")).write.parquet(str(tmp_path / "events.parquet"))
    spark.createDataFrame([(1, "https://site1.example/a")], "page_id long, url string").write.parquet(str(tmp_path / "pages.parquet"))
    for name in ("intel_results", "intel_lookup_report"):
        found = QUERIES[name](spark, str(tmp_path))
        plan = found._jdf.queryExecution().optimizedPlan().toString()
        assert len(re.findall(r"\bprops#\d+\] parquet", plan)) == 1, name  # the feed's own pass; entities are a written table
        assert found.filter("verdict <> 'unknown'").count() > 0, name
