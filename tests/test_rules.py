from __future__ import annotations

import json

import pytest
from pyspark.sql import functions as F

from casewright.operators import rules as R
from casewright.operators.detect import detect_single
from casewright.schema import conform


def process(spark, *commands):
    rows = [(f"u{i}", c) for i, c in enumerate(commands)]
    df = spark.createDataFrame(rows, "uid string, cmd string").select(
        F.lit(1007).alias("class_uid"),
        F.lit(1).alias("activity_id"),
        F.lit(0).cast("long").alias("time_ms"),
        F.struct(F.col("cmd").alias("cmd_line")).alias("process"),
        F.struct(F.lit("o").alias("org_id"), F.col("uid").alias("event_uid")).alias("sx"),
    )
    return conform(df)


def rule(detection, **more):
    return {
        "id": "r", "title": "t", "level": "low", "logsource": {"category": "process_creation"}, "detection": detection,
    } | more


def hits(spark, detection, *commands):
    compiled = R.compile_rule(rule(detection))
    found = detect_single(process(spark, *commands), [compiled])
    return sorted(int(r.evidence[0][1:]) for r in found.collect())


@pytest.mark.parametrize(
    ("detection", "commands", "expected"),
    [
        ({"s": {"CommandLine|contains": ["abc", "x*z"]}, "condition": "s"}, ["1abc2", "xyz", "ab"], [0, 1]),
        ({"s": {"CommandLine|contains|all": ["a", "b"]}, "condition": "s"}, ["ab", "a"], [0]),
        ({"s": {"CommandLine|endswith": ".EXE"}, "condition": "s"}, ["a.exe", "a.exe x"], [0]),
        ({"s": {"CommandLine|re|i": "^RUN\\s"}, "condition": "s"}, ["run x", "xrun "], [0]),
        ({"s": {"CommandLine|cased": "Abc"}, "condition": "s"}, ["Abc", "abc"], [0]),
        ({"s": {"CommandLine|windash|contains": " -e "}, "condition": "s"}, ["p /e x", "p -e x", "p –e x", "p +e x"], [0, 1, 2]),
        ({"s": {"CommandLine|base64offset|contains": "http://"}, "condition": "s"}, ["aHR0cDovL3g=", "xxodHRwOi8vYQ", "plain"], [0, 1]),
        ({"s": {"CommandLine": None}, "condition": "s"}, ["x", None], [1]),
        ({"s": {"CommandLine": "-"}, "condition": "s"}, ["x", "-", None], [1, 2]),
        ({"s": {"CommandLine|exists": True}, "condition": "s"}, ["x", None], [0]),
        ({"s": {"CommandLine|gte": 10}, "condition": "s"}, ["9", "10", "abc"], [1]),
        ({"a": {"CommandLine": "x"}, "b": {"CommandLine": "y"}, "condition": "1 of them"}, ["x", "y", "z"], [0, 1]),
        ({"sel": {"CommandLine|contains": "x"}, "f_a": {"CommandLine|contains": "a"}, "f_b": {"CommandLine|contains": "b"}, "condition": "sel and not 1 of f_*"}, ["x", "xa", "xb"], [0]),
        ({"sel": {"CommandLine|contains": "x"}, "f_a": {"CommandLine|contains": "a"}, "f_b": {"CommandLine|contains": "b"}, "condition": "sel and not (all of f_*)"}, ["x", "xa", "xab"], [0, 1]),
        ({"k": ["needle"], "condition": "k"}, ["a NEEDLE b", "none"], [0]),
    ],
)
def test_detections(spark, detection, commands, expected):
    assert hits(spark, detection, *commands) == expected


@pytest.mark.parametrize(
    ("document", "reason"),
    [
        (rule({"s": {"Nope": 1}, "condition": "s"}), "field 'Nope' is not mapped for logsource process_creation"),
        (rule({"s": {"CommandLine|expand": "x"}, "condition": "s"}), "unsupported modifier 'expand'"),
        (rule({"s": {"CommandLine": "x"}, "condition": "s and t"}), "condition names 't', which is not a selection"),
        (rule({"s": {"CommandLine": "x"}, "condition": "s | count() > 3"}), "unsupported condition 's | count() > 3'"),
        (rule({"s": {"CommandLine": "x"}, "condition": "s"}, logsource={"category": "proxy"}), "unsupported logsource category=proxy"),
        (rule({"s": {"CommandLine": "x"}, "condition": "s"}, level="odd"), "a rule must have a level from informational to critical"),
        ({"id": "r", "title": "t", "level": "low", "match": {"nope": 1}, "group_by": ["user.name"], "threshold": 2, "window": "1m"}, "unknown field 'nope'"),
        ({"id": "r", "title": "t", "level": "low", "match": {"class_uid": 1}, "group_by": ["user.name"], "threshold": 2, "window": "25h"}, "a window is longer than zero and at most 24h"),
        ({"id": "r", "title": "t", "level": "low", "match": {"class_uid": 1}, "group_by": ["user.name"], "threshold": 1, "window": "1m"}, "threshold must be between 2 and 10000"),
        ({"id": "r", "level": "low", "correlation": {"type": "temporal", "rules": ["x"]}}, "unsupported correlation type 'temporal'"),
    ],
)
def test_refusals_say_why(spark, document, reason):
    assert R.compile_rules([("f", json.dumps(document))]).refused == (("f", reason),)


def test_shipped_rules_load(spark, rule_set):
    assert rule_set.refused == ()
    assert len(rule_set.single) == 4 and len(rule_set.threshold) == 5
    titles = {r.title for r in rule_set.rules}
    assert "Connection to an address outside the private ranges" not in titles, "a counted rule does not fire by itself"
    counted = next(r for r in rule_set.threshold if r.count_distinct == "dst_endpoint.ip")
    assert (counted.group_by, counted.threshold, counted.window_ms) == (("src_endpoint.ip",), 10, 300_000)
    encoded = next(r for r in rule_set.single if "encoded" in r.title)
    assert encoded.tactics == ("execution", "stealth"), "a renamed tactic takes its new name"
    table = rule_set.to_dataframe(spark)
    assert table.count() == 9
    tally = {(r.outcome, r.reason): r.rules for r in R.import_tally(rule_set, spark).collect()}
    assert tally == {("selected", None): 9}


def test_one_scan_serves_many_rules(spark):
    """Hundreds of rules stay one projection without a shuffle."""
    many = [R.compile_rule(rule({"s": {"CommandLine|contains": f"w{i}x"}, "condition": "s"}) | {"id": str(i)}) for i in range(120)]
    found = detect_single(process(spark, "w7x", "w119x w3x"), many)
    assert sorted(r.rule_id for r in found.collect()) == ["119", "3", "7"]
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "Exchange hashpartitioning" not in plan


def test_selected_rules_are_copied_verbatim_with_a_manifest(spark, tmp_path):
    source = tmp_path / "pack" / "win"
    source.mkdir(parents=True)
    good = json.dumps(rule({"s": {"CommandLine": "x"}, "condition": "s"}))
    (source / "good.json").write_text(good)
    (source / "bad.json").write_text(json.dumps(rule({"s": {"Nope": "x"}, "condition": "s"}) | {"id": "b"}))
    (source / "MANIFEST.json").write_text(json.dumps({"rule_base_url": "https://rules.example", "files": {"good.json": "a/good.yml"}}))
    kept = R.write_selection(spark, str(tmp_path / "pack"), str(tmp_path / "out"), "r1")
    assert [r.source_url for r in kept.rules] == ["https://rules.example/a/good.yml"]
    assert kept.refused == (("win/bad.json", "field 'Nope' is not mapped for logsource process_creation"),)
    [row] = spark.read.parquet(str(tmp_path / "out" / "rules")).collect()
    assert (row.path, row.text) == ("win/good.json", good)
    manifest = json.loads(spark.read.text(str(tmp_path / "out" / "manifest")).first().value)
    assert manifest == {"release": "r1", "selected": 1, "files": ["win/good.json"]}


def test_conditions_read_names_of_any_shape(spark):
    parts = {"a-b": {"CommandLine|contains": "ab"}, "c_x": {"CommandLine|contains": "cx"}, "d_x": {"CommandLine|contains": "dx"}, "_hidden": {"CommandLine|contains": "hid"}}
    cases = {
        "a-b": {"ab", "ab cx"},
        "1 of *_x": {"cx", "dx", "cx dx", "ab cx"},
        "all of *_x": {"cx dx"},
        "NOT a-b AND (c_x or d_x)": {"cx", "dx", "cx dx"},
        "not a-b and not 1 of *_x": {"hid"},
        "any of them": {"ab", "cx", "dx", "cx dx", "ab cx"},
        "a-b or c_x and d_x": {"ab", "cx dx", "ab cx"},
        "not not a-b": {"ab", "ab cx"},
    }
    commands = ("ab", "cx", "dx", "cx dx", "ab cx", "hid")
    for condition, wanted in cases.items():
        compiled = R.compile_rule(rule(parts | {"condition": condition}) | {"id": condition})
        found = {r.event_uid for r in detect_single(process(spark, *commands), [compiled]).selectExpr("evidence[0] AS event_uid").collect()}
        assert len(found) == len(wanted), condition
    for broken in ("a-b and", "(a-b", "a-b)", "or a-b", "a-b c_x", "1 of zz*", ""):
        with pytest.raises(R.RuleRefused):
            R.compile_rule(rule(parts | {"condition": broken}))


def test_nested_and_long_rule_files_load_with_their_sources(spark, tmp_path):
    pack = tmp_path / "pack"
    deep, other = pack / "community" / "windows" / "process", pack / "community" / "linux" / "process"
    for folder in (deep, other, pack / "mine"):
        folder.mkdir(parents=True)
    body = rule({"s": {"CommandLine": "x"}, "condition": "s"})
    (deep / "b.json").write_text(json.dumps(body | {"id": "one"}))
    (other / "b.json").write_text(json.dumps(body | {"id": "two", "description": "p" * 1_500_000}))
    (other / "copy of+1.json").write_text(json.dumps(body | {"id": "own"}))
    (pack / "mine" / "z.json").write_text(json.dumps(body | {"id": "own"}))
    files = {"windows/process/b.json": "w/b.yml", "linux/process/b.json": "l/b.yml"}
    (pack / "community" / "MANIFEST.json").write_text(json.dumps({"rule_base_url": "https://r.example/", "files": files, "pad": "x" * 1_200_000}))
    found = R.load_rules(spark, str(pack))
    assert {r.id: r.source_url for r in found.rules} == {"own": None, "one": "https://r.example/w/b.yml", "two": "https://r.example/l/b.yml"}
    assert {r.id: r.path for r in found.rules}["own"] == "mine/z.json", "the own rule stays"
    assert found.refused == (("community/linux/process/copy of+1.json", "duplicate rule id own"),)
    tally = {(r.outcome, r.reason): r.rules for r in R.import_tally(found, spark).collect()}
    assert tally == {("selected", None): 3, ("refused", "duplicate rule id own"): 1}


def test_rule_files_are_listed_by_tasks_as_spark_would_list_them(spark, tmp_path, monkeypatch):
    pack = tmp_path / "pa ck+1%41"
    names = ["a.yml", "b.JSON", "c.json", ".d.json", "_e.json", "_f=1.json", "_metadata.json", "g.txt", "one/h i+%2B.yaml", "one/k=1/_l/m.json", "one/k=1/n=2/o.json", "_x=1/p.json", "_metadata/q.json", ".r/s.json", "one/é/t.yml"]
    for name in names:
        (pack / name).parent.mkdir(parents=True, exist_ok=True)
        (pack / name).write_bytes(f"{name}\r\n".encode() + b"\xef\xbb\xbf\xff")
    (pack / "empty.json").write_text("")
    (pack / "none").mkdir()
    rows = lambda *chosen: sorted((r.path, bytes(r.text), r.version) for r in R.rule_files(spark, str(pack), *chosen).selectExpr("path", "CAST(text AS BINARY) AS text", "version").collect())
    found = R.rule_files(spark, str(pack))
    assert "Scan text" not in found._jdf.queryExecution().executedPlan().toString(), "the driver would list every file"
    by_tasks, chosen = rows(), rows(F.col("path").startswith("one/"))
    monkeypatch.setattr(R, "_tasks_reach", lambda uri: False)
    assert "Scan text" in R.rule_files(spark, str(pack))._jdf.queryExecution().executedPlan().toString()
    assert by_tasks == rows() and len(by_tasks) >= 7
    assert chosen == rows(F.col("path").startswith("one/")) and 3 <= len(chosen) < len(by_tasks)
