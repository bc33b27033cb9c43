from __future__ import annotations

import json

import pytest
from pyspark.sql import functions as F
from stories import raw_records

from casewright.operators.normalize import normalize
from casewright.sources import records, sinks


def values(spark, *texts):
    return spark.createDataFrame([(t,) for t in texts], "value string")


def test_json_bodies(spark):
    found = records.json_records(values(spark, '[{"a":1},{"a":2}]', '{"events":[{"a":3}]}', '{"a":4}', "nope", "[5]", " "))
    rows = [(r.raw, r.problem is None) for r in found.collect()]
    assert sorted(rows) == [
        ("5", False), ("nope", False), ('{"a":1}', True), ('{"a":2}', True), ('{"a":3}', True), ('{"a":4}', True),
    ]


def test_event_xml_keeps_good_events_beside_bad_ones(spark):
    good = (
        "<Event xmlns='http://schemas.microsoft.com/win/2004/08/events/event'><System><EventID>4624</EventID>"
        "<TimeCreated SystemTime='2026-01-01T00:00:00.1Z'/><Computer>PC-1</Computer><Channel>Security</Channel></System>"
        "<EventData><Data Name='A'>one</Data><Data>no name</Data><Data Name='A'>two &amp; three</Data></EventData></Event>"
    )
    found = records.xml_events(values(spark, f"x{good}<Event><Broken</Event>{good}", f"<!DOCTYPE a>{good}"))
    rows = found.select("position", "problem.reason", "channel", "record.EventID", F.col("record.EventData")["A"].alias("a")).collect()
    kept = [r for r in rows if r.reason is None]
    assert [(r.position, r.channel, r.EventID, r.a) for r in kept] == [
        (0, "Security", "4624", "two & three"),
        (2, "Security", "4624", "two & three"),
    ]
    assert sorted(r.reason for r in rows if r.reason) == [
        "document type declarations are not allowed",
        "event has no readable System element",
    ]


RENDERED = """03/04/2026 01:19:21 PM
LogName=Security
EventCode=4672
ComputerName=DC-1
RecordNumber=7
Message=Special privileges assigned to new logon.

Subject:
	Security ID:		CORP\\mkim
	Account Name:		mkim
	Account Domain:		CORP

Privileges:		SeDebugPrivilege
			SeBackupPrivilege
03/04/2026 01:19:22 PM
LogName=Security
EventCode=4624
Message=An account was successfully logged on.

Subject:
	Account Name:		-

New Logon:
	Security ID:		S-1-5-21-7
	Account Name:		mkim

Network Information:
	Source Network Address:	198.51.100.4
	Source Port:		1

Other:
	Source Port:		2
"""


def test_rendered_text_reads_labels_by_section(spark):
    rows = records.rendered_events(values(spark, RENDERED)).orderBy("position").select("record").collect()
    first, second = (r.record for r in rows)
    assert first.TimeCreated == "2026-03-04T13:19:21Z"
    assert first.Computer == "DC-1"
    assert first.EventData == {
        "SubjectUserName": "mkim",
        "SubjectDomainName": "CORP",
        "PrivilegeList": "SeDebugPrivilege\nSeBackupPrivilege",
    }, "a resolved account is not a SID"
    assert second.EventData == {"TargetUserName": "mkim", "TargetUserSid": "S-1-5-21-7", "IpAddress": "198.51.100.4"}, (
        "a label with two meanings is left out"
    )


GOOD_XML = (
    "<Event xmlns='http://schemas.microsoft.com/win/2004/08/events/event'>\n<System><EventID>4624</EventID>"
    "<TimeCreated SystemTime='2026-01-01T00:00:00.1Z'/><Computer>PC-{0}</Computer><Channel>Security</Channel></System>\n"
    "<EventData><Data Name='A'>Ü {0}</Data></EventData></Event>"
)


@pytest.fixture(params=["1g", "700b"])
def split_size(spark, request):
    spark.conf.set("spark.sql.files.maxPartitionBytes", request.param)
    spark.conf.set("spark.sql.files.openCostInBytes", "0")
    yield request.param
    for name in ("maxPartitionBytes", "openCostInBytes"):
        spark.conf.unset(f"spark.sql.files.{name}")


def test_xml_files_are_cut_alike_at_every_split_size(spark, tmp_path, split_size):
    events = [GOOD_XML.format(n) for n in range(40)]
    files = {
        "a": "<Events>\n" + "\n".join(events) + "\n</Events>\n",
        "b": "\ufeff" + "".join(events[:3]),
        "broken_off": events[0] + "<Event><Broken</Event>" + events[1] + events[2][: -len("</Event>")],
        "declared": events[0] * 9 + "<!DOCTYPE a>" + events[1] * 9,
        "empty": "",
        "other": "no event here",
    }
    for name, text in files.items():
        (tmp_path / f"{name}.xml").write_bytes(text.encode())
    found = records.read_winxml(spark, str(tmp_path))
    if split_size != "1g":
        assert spark.read.option("lineSep", "</Event>").text(str(tmp_path / "a.xml")).rdd.getNumPartitions() > 5
    rows = found.select("position", "record.Computer", F.col("record.EventData")["A"].alias("a"), "problem.reason").collect()
    want = [(n, f"PC-{n}", f"Ü {n}", None) for n in range(40)] + [(n, f"PC-{n}", f"Ü {n}", None) for n in range(3)]
    want += [(0, "PC-0", "Ü 0", None), (2, "PC-1", "Ü 1", None), (1, None, None, "event has no readable System element")]
    want.append((0, None, None, "document type declarations are not allowed"))
    assert sorted(map(str, map(tuple, rows))) == sorted(map(str, want))


def test_rendered_files_are_read_alike_at_every_split_size(spark, tmp_path, split_size):
    many = "".join(RENDERED.replace("RecordNumber=7", f"RecordNumber={n}") for n in range(20))
    (tmp_path / "a.log").write_text("left over of an earlier event\n" + many)
    (tmp_path / "b.log").write_bytes(RENDERED.replace("\n", "\r\n").encode())
    (tmp_path / "c.log").write_text("nothing to read")
    found = records.read_wineventlog_text(spark, str(tmp_path))
    whole = records.rendered_events(values(spark, many, RENDERED.replace("\n", "\r\n")))
    shown = lambda df: sorted(str((r.record, r.channel, r.problem, r.raw)) for r in df.collect())
    assert shown(found) == shown(whole) and found.count() == 42
    lines = RENDERED.count("\n")
    first = sorted(r.position for r in found.filter("record.EventID = 4672").collect())
    assert first == sorted([0] + [1 + lines * n for n in range(20)])


def test_feed_positions_follow_the_file(spark, tmp_path, split_size):
    for name in ("1", "2"):
        (tmp_path / f"{name}.csv").write_text(",".join(records.FEED_COLUMNS) + "\n" + "".join(f"ip,10.{name}.0.{n},malicious,,,,,,,\n" for n in range(60)))
    rows = records.read_feed(spark, str(tmp_path)).orderBy("position").collect()
    assert [(r.position, r.value) for r in rows] == [(n + 60 * k, f"10.{k + 1}.0.{n}") for k in (0, 1) for n in range(60)]


def test_exports_go_to_the_parser_of_their_source_type(spark):
    rows = [
        ("XmlWinEventLog:Security", "<Event><System><EventID>4634</EventID><Channel>Security</Channel></System></Event>", "t"),
        ("WinEventLog:Security", RENDERED.split("\n", 1)[1], "2026-03-04T00:00:00Z"),
        ("linux_secure", "Mar  4 01:02:03 web sshd[1]: Failed password for root from 10.0.0.1 port 1 ssh2", "2026-03-04T01:02:03Z"),
        ("ocsf", '{"class_uid":4001}', ""),
        ("stream:dns", "x", ""),
    ]
    routed = records.route_export(spark.createDataFrame(rows, "sourcetype string, _raw string, _time string"))
    assert sorted((r.parser or r.reason) for r in routed.collect()) == [
        "linux_auth", "ocsf", "stream:dns: no parser is mapped to this sourcetype", "windows_security", "windows_security",
    ]
    parts = records.export_records(routed)
    assert {k: v.count() for k, v in parts.items()} == {"xml": 1, "rendered": 2, "line": 1, "ocsf": 1}
    line = parts["line"].withColumns({"org_id": F.lit("o"), "source_id": F.lit("s")})
    event = normalize(line, "linux_auth").events.first()
    assert (event.time_ms, event.user.name) == (1772586123000, "root"), "the export's time wins over a year-less line"


def test_feed_reader_skips_and_counts(spark, tmp_path):
    from casewright.operators import intel

    feed = tmp_path / "feed.csv"
    feed.write_text(
        "type,value,verdict,confidence,source,description,tags,reference,first_seen,last_seen\n"
        "# a comment\n"
        "ip,203.0.113.9,malicious,90,list,scanner,a;b,https://x.example/1,2026-01-01T00:00:00Z,\n"
        "ip,10.0.0.1,malicious,,,,,,,\n"
        "domain,plainhost,malicious,,,,,,,\n"
        "domain,Bad.Example.,,,,,,,,\n"
        "hash,zz,malicious,,,,,,,\n"
        "domain,bad.example,suspicious,101,,,,,,\n"
    )
    rows = intel.feed_rows(records.read_feed(spark, str(feed)))
    assert tuple(intel.feed_counts(rows).first()) == (6, 4)
    kept = {(r.type, r.value): (r.verdict, r.summary, r.tags) for r in intel.feed(rows).collect()}
    assert kept == {
        ("ip", "203.0.113.9"): ("malicious", "list: scanner", ["a", "b"]),
        ("domain", "bad.example"): ("unknown", "Listed in local feed", []),
    }


SYSMON = [
    (1, {"Image": "C:\\a\\p.exe", "User": "CORP\\j", "Hashes": "MD5=D41D8CD98F00B204E9800998ECF8427E,IMPHASH=1", "ParentImage": "C:\\q.exe"}, (1007, 1)),
    (3, {"SourceIp": "10.0.0.1", "DestinationIp": "192.0.2.1", "DestinationPort": "443", "Initiated": "true", "Protocol": "tcp"}, (4001, 1)),
    (5, {"Image": "C:\\a\\p.exe"}, (1007, 2)),
    (7, {"ImageLoaded": "C:\\a.dll", "Image": "C:\\p.exe"}, (1005, 1)),
    (8, {"TargetImage": "C:\\t.exe", "SourceImage": "C:\\s.exe", "StartModule": "C:\\m.dll"}, (1007, 4)),
    (10, {"TargetImage": "C:\\lsass.exe", "SourceImage": "C:\\s.exe", "GrantedAccess": "0x1010"}, (1007, 3)),
    (11, {"TargetFilename": "C:\\f"}, (1001, 1)),
    (12, {"EventType": "DeleteKey", "TargetObject": "HKLM\\a"}, (201001, 4)),
    (13, {"EventType": "SetValue", "TargetObject": "HKLM\\a\\b", "Details": "x"}, (201002, 2)),
    (14, {"EventType": "RenameKey", "TargetObject": "HKLM\\a", "NewName": "HKLM\\b"}, (201001, 5)),
    (22, {"QueryName": "a.example", "QueryResults": "type:  5 b.example;::ffff:192.0.2.7;"}, (4003, 1)),
    (23, {"TargetFilename": "C:\\f"}, (1001, 4)),
]


def test_every_sysmon_event_maps(spark):
    rows = [{"EventID": i, "TimeCreated": "2026-01-01T00:00:00Z", "Computer": "PC", "EventData": d} for i, d, _ in SYSMON]
    got = normalize(raw_records(spark, rows), "windows_sysmon").events
    by_id = {int(r.unmapped["event_id"]): r for r in got.collect()}
    assert {i: (by_id[i].class_uid, by_id[i].activity_id) for i, _, _ in SYSMON} == {i: want for i, _, want in SYSMON}
    assert by_id[1].process.file.hashes[0].value == "d41d8cd98f00b204e9800998ecf8427e"
    assert by_id[1].actor is None and by_id[1].process.parent_process.name == "q.exe"
    assert by_id[10].actual_permissions == 0x1010
    assert [a.rdata for a in by_id[22].answers] == ["192.0.2.7"]
    assert (by_id[14].reg_key.path, by_id[14].prev_reg_key.path) == ("HKLM\\b", "HKLM\\a")


@pytest.mark.parametrize(
    ("record", "reason"),
    [
        ({"EventID": "x"}, "record has no numeric EventID"),
        ({"EventID": 4663, "TimeCreated": "t"}, "unsupported Windows Security event 4663"),
        ({"EventID": 4624, "EventData": [1]}, "EventData must be an object"),
        ({"EventID": 4624, "EventData": {}}, "Windows event has no TimeCreated"),
        ({"EventID": 4672, "TimeCreated": "2026-01-01T00:00:00Z", "EventData": {}}, "4672 event names no account"),
        ({"EventID": 4634, "TimeCreated": "2026-01-01T00:00:00Z", "EventData": {}}, "Authentication events require user"),
        ({"EventID": 4634, "TimeCreated": "soon", "EventData": {"TargetUserName": "a"}}, "time: must be epoch milliseconds or an RFC 3339 string"),
    ],
)
def test_rejects_say_why(spark, record, reason):
    result = normalize(raw_records(spark, [record]), "windows_security")
    assert [r.reason for r in result.rejects.collect()] == [reason]


def test_fingerprints_depend_on_content_org_and_source(spark):
    row = {"EventID": 4634, "TimeCreated": "2026-01-01T00:00:00Z", "EventData": {"TargetUserName": "a"}}
    other = json.loads(json.dumps(row).replace('"a"', '"b"'))
    frames = [raw_records(spark, [row, row, other]), raw_records(spark, [row], org="org-2"), raw_records(spark, [row], source="s2")]
    events = normalize(frames[0].unionByName(frames[1]).unionByName(frames[2]), "windows_security").events
    assert events.select("sx.fingerprint").distinct().count() == 4
    assert sinks.first_copies(events).count() == 4


def test_store_keeps_the_first_copy_only(spark, story_events, tmp_path):
    path = str(tmp_path / "events")
    for _ in range(2):
        sinks.store_events(story_events, path)
    stored = spark.read.parquet(path)
    assert stored.count() == story_events.count()
    outcome = sinks.index_outcome(story_events.unionByName(story_events), stored).first()
    assert tuple(outcome) == (0, 2 * story_events.count(), 0)
    lost = story_events.withColumn("time", F.when(F.col("class_uid") != 3002, F.col("time")))
    failed = story_events.filter("class_uid = 3002").count()
    assert failed and tuple(sinks.index_outcome(lost, None).first()) == (story_events.count() - failed, 0, failed)
    sinks.store_events(lost, str(tmp_path / "some"))
    assert spark.read.parquet(str(tmp_path / "some")).count() == story_events.count() - failed
