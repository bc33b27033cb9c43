"""The registered queries: every operator over the driver's tables, results as plain columns."""

from __future__ import annotations

import hashlib
from collections.abc import Callable
from datetime import UTC, datetime
from functools import lru_cache

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from casewright import schema as S
from casewright.functions import ids, net, scalars, text
from casewright.operators import (
    audit,
    baseline,
    correlate,
    detect,
    entities,
    evaluate,
    graph,
    grounding,
    intel,
    normalize,
    predicates as P,
    reports,
    rules,
    search,
    timeline,
    triage,
)
from casewright.operators.scopes import SCOPES
from casewright.plans import rulebook as R
from casewright.plans.rulepack import write_pack
from casewright.plans.telemetry import ORG
from casewright.plans.telemetry import flat_telemetry as build_flat_telemetry
from casewright.plans.telemetry import telemetry as build_telemetry
from casewright.session import configure, cut_lineage
from casewright.sources import records, sinks

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}


def query(function: Query) -> Query:
    """Register a query under its own name."""

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return function(configure(spark), sf_dir)

    QUERIES[function.__name__] = run
    return function


def per_session(build: Query) -> Query:
    """Build a DataFrame once per session and data set: the plan is kept, nothing is computed or stored."""
    kept: dict[tuple[str, str], DataFrame] = {}

    def get(spark: SparkSession, sf_dir: str) -> DataFrame:
        key = (spark.sparkContext.applicationId, sf_dir)
        if key not in kept:
            kept[key] = build(spark, sf_dir)
        return kept[key]

    return get


flat_telemetry = per_session(build_flat_telemetry)
telemetry = per_session(build_telemetry)


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _csv(column: Column | str) -> Column:
    return F.array_join(column, ",")


c = F.col
NOW_MS = 1_707_000_000_000  # a fixed instant after the data, so results repeat


# ----------------------------------------------------------------------------------------- sources and parsers
def _lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Syslog lines written from the events: failures, successes, probes and other daemons' lines."""
    t = flat_telemetry(spark, sf_dir)
    at = F.date_format(F.timestamp_millis("time_ms"), "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'")
    head = F.concat(at, F.lit(" web-"), c("event_id") % 4, F.lit(" "))
    ssh = F.concat(F.lit("sshd["), 1000 + c("event_id") % 500, F.lit("]: "))
    origin = F.concat(c("user_name"), F.lit(" from "), c("src_ip"), F.lit(" port "), 40000 + c("event_id") % 1000)
    invalid = F.when(c("k") % 4 == 0, F.lit("invalid user ")).otherwise("")
    line = (
        F.when(c("class_uid") == 1007, F.concat(head, ssh, F.lit("Invalid user "), origin))
        .when(c("status_id") == 2, F.concat(head, ssh, F.lit("Failed password for "), invalid, origin, F.lit(" ssh2")))
        .when(c("class_uid") == 3002, F.concat(head, ssh, F.lit("Accepted publickey for "), origin, F.lit(" ssh2")))
        .when(c("class_uid") == 4001, F.concat(head, ssh, F.lit("pam_unix(sshd:session): session opened")))
        .otherwise(F.concat(head, F.lit("cron[77]: job started")))
    )
    return t.select("event_id", "org_id", "source_id", line.alias("value"))


@per_session
def _parsed_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = records.line_records(_lines(spark, sf_dir)).withColumn("position", c("event_id"))
    return normalize.parse_records(lines, "linux_auth", F.timestamp_millis(F.lit(NOW_MS)))


@query
def sshd_lines(spark, sf_dir):
    kept = records.line_records(_lines(spark, sf_dir), only_sshd=True)
    return kept.select("event_id", c("record.message").alias("message"))


@query
def linux_auth_events(spark, sf_dir):
    parsed = _parsed_lines(spark, sf_dir).filter("problem is null")
    return parsed.select(
        c("position").alias("event_id"),
        "class_uid",
        "activity_id",
        "status_id",
        "severity_id",
        F.unix_millis("time").alias("time_ms"),
        c("user.name").alias("user_name"),
        c("src_endpoint.ip").alias("src_ip"),
        c("src_endpoint.port").alias("src_port"),
        c("device.hostname").alias("host"),
        F.try_element_at("unmapped", F.lit("invalid_user")).alias("invalid_user"),
        F.try_element_at("unmapped", F.lit("auth_method")).alias("auth_method"),
    )


@query
def linux_auth_rejects(spark, sf_dir):
    rejects = normalize.rejects_of(_parsed_lines(spark, sf_dir))
    return rejects.groupBy("kind", "reason").agg(F.count("*").alias("n"))


@query
def ingest_reports(spark, sf_dir):
    report = sinks.ingest_report(_parsed_lines(spark, sf_dir))
    first = F.transform("errors", lambda e: e["position"].cast("string"))
    return report.select("source_id", "accepted", "rejected", "last_event_ms", _csv(first).alias("first_errors"))


def _windows_raw(spark: SparkSession, sf_dir: str, ids_by_slot: tuple[int, ...], data: Column) -> DataFrame:
    t = flat_telemetry(spark, sf_dir)
    event_id = F.element_at(F.array(*[F.lit(i) for i in ids_by_slot]), (c("event_id") % len(ids_by_slot) + 1).cast("int"))
    body = F.struct(
        event_id.alias("EventID"),
        c("event_id").alias("EventRecordID"),
        F.date_format(F.timestamp_millis("time_ms"), "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'").alias("TimeCreated"),
        c("device_hostname").alias("Computer"),
        data.alias("EventData"),
    )
    return t.select("org_id", "source_id", c("event_id").alias("position"), F.to_json(body).alias("raw"))


SECURITY_IDS = (4624, 4625, 4634, 4647, 4648, 4672, 4688, 4768, 4769, 4771, 4776, 4663)


def _security_raw(spark: SparkSession, sf_dir: str) -> DataFrame:
    data = F.struct(
        c("user_name").alias("TargetUserName"),
        c("user_domain").alias("TargetDomainName"),
        c("user_name").alias("SubjectUserName"),
        F.when(c("k") % 5 == 0, F.lit("-")).otherwise(c("src_ip")).alias("IpAddress"),
        (40000 + c("k")).cast("string").alias("IpPort"),
        F.when(c("k") % 2 == 0, F.lit("0x0")).otherwise(F.lit("0xc000006a")).alias("Status"),
        F.when(c("k") % 3 == 0, F.lit("NTLM")).otherwise(F.lit("Negotiate")).alias("AuthenticationPackageName"),
        F.lit("MICROSOFT_AUTHENTICATION_PACKAGE_V1_0").alias("PackageName"),
        F.element_at(F.array(F.lit("2"), F.lit("3"), F.lit("10")), (c("k") % 3 + 1).cast("int")).alias("LogonType"),
        F.when(c("k") % 10 != 9, F.lit("C:\\Windows\\System32\\cmd.exe")).alias("NewProcessName"),
        F.concat(F.lit("0x"), F.lower(F.hex(c("k") + 16))).alias("NewProcessId"),
        F.lit("C:\\Windows\\explorer.exe").alias("ParentProcessName"),
        F.lit("SeDebugPrivilege\n\t\t\tSeBackupPrivilege").alias("PrivilegeList"),
        F.lit("fs-1").alias("TargetServerName"),
        F.lit("krbtgt").alias("ServiceName"),
    )
    return _windows_raw(spark, sf_dir, SECURITY_IDS, data)


@per_session
def _security(spark: SparkSession, sf_dir: str) -> DataFrame:
    return normalize.parse_records(_security_raw(spark, sf_dir), "windows_security", F.timestamp_millis(F.lit(NOW_MS)))


@query
def windows_security_events(spark, sf_dir):
    good = _security(spark, sf_dir).filter("problem is null")
    return good.select(
        c("position").alias("event_id"),
        "class_uid",
        "activity_id",
        "status_id",
        "severity_id",
        c("user.name").alias("user_name"),
        c("src_endpoint.ip").alias("src_ip"),
        c("src_endpoint.port").alias("src_port"),
        c("dst_endpoint.hostname").alias("dst_host"),
        "auth_protocol_id",
        "logon_type",
        c("process.name").alias("process_name"),
        c("process.pid").alias("pid"),
        c("process.parent_process.name").alias("parent_name"),
        c("service.name").alias("service_name"),
        F.size("privileges").cast("long").alias("privileges"),
    ).withColumn("privileges", F.when(c("privileges") >= 0, c("privileges")))


@query
def windows_security_rejects(spark, sf_dir):
    rejects = normalize.rejects_of(_security(spark, sf_dir))
    return rejects.groupBy("kind", "reason").agg(F.count("*").alias("n"))


SYSMON_IDS = (1, 3, 5, 7, 8, 10, 11, 12, 13, 14, 22, 23, 99)


def _sysmon_raw(spark: SparkSession, sf_dir: str) -> DataFrame:
    registry = F.array(*[F.lit(t) for t in ("CreateKey", "DeleteKey", "DeleteValue", "SetValue", "RenameKey", "Unknown")])
    data = F.struct(
        F.lit("C:\\Tools\\agent.exe").alias("Image"),
        c("k").cast("string").alias("ProcessId"),
        F.concat(F.coalesce(F.concat(c("user_domain"), F.lit("\\")), F.lit("")), c("user_name")).alias("User"),
        F.lit("C:\\Windows\\explorer.exe").alias("ParentImage"),
        F.lit("C:\\Windows\\lsass.exe").alias("TargetImage"),
        F.lit("C:\\Tools\\probe.exe").alias("SourceImage"),
        F.concat(F.lit("0x"), F.hex(c("k"))).alias("GrantedAccess"),
        F.concat(F.lit("MD5="), F.md5(c("user_name")), F.lit(",SHA256="), F.sha2("user_name", 256), F.lit(",FOO=1")).alias("Hashes"),
        c("src_ip").alias("SourceIp"),
        F.concat(F.lit("::ffff:192.0.2."), c("k") % 10).alias("DestinationIp"),
        F.lit("443").alias("DestinationPort"),
        F.when(c("k") % 2 == 0, F.lit("true")).otherwise(F.lit("false")).alias("Initiated"),
        F.when(c("k") % 10 != 3, F.lit("C:\\Windows\\a.dll")).alias("ImageLoaded"),
        F.lit("C:\\Temp\\drop.txt").alias("TargetFilename"),
        F.element_at(registry, (c("k") % 6 + 1).cast("int")).alias("EventType"),
        F.concat(F.lit("HKLM\\Software\\Run\\v"), c("k")).alias("TargetObject"),
        F.concat(F.lit("site"), c("k") % 15, F.lit(".example")).alias("QueryName"),
        F.concat(F.lit("type:  5 cdn.example;::ffff:192.0.2."), c("k") % 10, F.lit(";")).alias("QueryResults"),
        F.when(c("k") % 4 == 0, F.lit("9003")).otherwise(F.lit("0")).alias("QueryStatus"),
    )
    return _windows_raw(spark, sf_dir, SYSMON_IDS, data)


@per_session
def _sysmon(spark: SparkSession, sf_dir: str) -> DataFrame:
    return normalize.parse_records(_sysmon_raw(spark, sf_dir), "windows_sysmon", F.timestamp_millis(F.lit(NOW_MS)))


@query
def sysmon_events(spark, sf_dir):
    good = _sysmon(spark, sf_dir).filter("problem is null")
    hashes = F.transform("file.hashes", lambda h: h["value"])
    return good.select(
        c("position").alias("event_id"),
        "class_uid",
        "activity_id",
        "status_id",
        c("process.name").alias("process_name"),
        c("actor.process.name").alias("actor_name"),
        c("actor.user.name").alias("actor_user"),
        c("dst_endpoint.ip").alias("dst_ip"),
        c("connection_info.direction_id").alias("direction_id"),
        "actual_permissions",
        c("file.path").alias("file_path"),
        _csv(hashes).alias("file_hashes"),
        F.coalesce("reg_key.path", "reg_value.path").alias("reg_path"),
        c("reg_value.name").alias("value_name"),
        c("query.hostname").alias("query_name"),
        _csv(F.transform("answers", lambda a: a["rdata"])).alias("answers"),
    )


@query
def sysmon_rejects(spark, sf_dir):
    return normalize.rejects_of(_sysmon(spark, sf_dir)).groupBy("kind", "reason").agg(F.count("*").alias("n"))


def _ntlm_raw(spark: SparkSession, sf_dir: str) -> DataFrame:
    data = F.struct(
        F.when(c("k") % 9 == 0, F.lit("NULL")).otherwise(c("user_name")).alias("UserName"),
        F.coalesce("user_domain", F.lit("-")).alias("DomainName"),
        F.when(c("k") % 4 == 0, F.lit("NULL")).otherwise(F.concat(F.lit("WKS"), c("k"))).alias("WorkstationName"),
    )
    return _windows_raw(spark, sf_dir, (8004, 8001), data)


@query
def ntlm_events(spark, sf_dir):
    parsed = normalize.parse_records(_ntlm_raw(spark, sf_dir), "windows_ntlm", F.timestamp_millis(F.lit(NOW_MS)))
    return parsed.select(
        c("position").alias("event_id"),
        c("problem.kind").alias("problem"),
        F.when(c("problem").isNull(), c("status_id")).alias("status_id"),
        F.when(c("problem").isNull(), c("user.name")).alias("user_name"),
        F.when(c("problem").isNull(), c("user.domain")).alias("user_domain"),
        F.when(c("problem").isNull(), c("src_endpoint.hostname")).alias("workstation"),
    )


def _ocsf_raw(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Telemetry as native OCSF JSON, some of it broken in a known way."""
    t = flat_telemetry(spark, sf_dir)
    k, kind = c("k"), c("class_uid")
    body = F.struct(
        F.when(k != 0, kind).alias("class_uid"),
        F.when(k == 1, F.lit(77)).otherwise(c("activity_id")).alias("activity_id"),
        F.when(k == 2, F.lit(9)).alias("category_uid"),
        F.when(k == 3, F.lit(1)).alias("type_uid"),
        F.when(k == 4, F.lit(42)).otherwise(c("severity_id")).alias("severity_id"),
        c("status_id"),
        F.when(k == 5, F.lit("soon")).when(k == 6, F.lit("4102444800000")).otherwise(c("time_ms").cast("string")).alias("time"),
        F.struct(
            F.when(k == 7, F.lit("2.0.0")).otherwise(F.lit("1.1.0")).alias("version"),
            F.struct(F.lit("Sensor").alias("name")).alias("product"),
        ).alias("metadata"),
        F.when((kind == 3002) & (k != 8), F.struct(c("user_name").alias("name"))).alias("user"),
        F.struct(c("device_hostname").alias("hostname")).alias("device"),
        F.when(kind.isin(3002, 4001), F.struct(c("src_ip").alias("ip"), F.when(k == 9, F.lit(70000)).otherwise(F.lit(50000)).alias("port"))).alias("src_endpoint"),
        F.when(kind == 1007, F.struct(c("process_name").alias("name"))).alias("process"),
        F.when(kind == 4003, F.struct(c("query_hostname").alias("hostname"))).alias("query"),
    )
    return t.select("org_id", "source_id", c("event_id").alias("position"), F.to_json(body).alias("raw"))


@per_session
def _ocsf(spark: SparkSession, sf_dir: str) -> DataFrame:
    return normalize.parse_records(_ocsf_raw(spark, sf_dir), "ocsf", F.timestamp_millis(F.lit(NOW_MS)))


@query
def ocsf_validation(spark, sf_dir):
    parsed = _ocsf(spark, sf_dir)
    return parsed.groupBy(c("problem.kind").alias("kind"), c("problem.reason").alias("reason")).agg(F.count("*").alias("n"))


@query
def ocsf_events(spark, sf_dir):
    good = normalize.accepted_events(_ocsf(spark, sf_dir).filter("position is not null"), F.timestamp_millis(F.lit(NOW_MS)))
    names = F.transform("observables", lambda o: F.concat(o["name"], F.lit("="), o["value"]))
    return good.select(
        "time_ms",
        "class_uid",
        "category_uid",
        "type_uid",
        "class_name",
        "category_name",
        "activity_name",
        "severity",
        "status",
        _csv(names).alias("observables"),
    )


@query
def mixed_ingest(spark, sf_dir):
    """Records of all five forms in one batch, parsed in one pass as their sources say.

    One source names a parser that does not exist, one is disabled, one is not registered.
    """
    lines = _lines(spark, sf_dir).select(
        "org_id", c("event_id").alias("position"), F.to_json(F.struct(c("value").alias("message"))).alias("raw")
    )
    forms = {
        "linux_auth": lines,
        "windows_security": _security_raw(spark, sf_dir),
        "windows_sysmon": _sysmon_raw(spark, sf_dir),
        "windows_ntlm": _ntlm_raw(spark, sf_dir),
        "ocsf": _ocsf_raw(spark, sf_dir),
        "telepathy": lines,
        "switched_off": lines,
        "unregistered": lines,
    }
    batch = None
    for name, rows in forms.items():
        part = rows.select(F.lit(f"from-{name}").alias("source_id"), "position", "raw")
        batch = part if batch is None else batch.unionByName(part)
    listed = [(f"from-{n}", "org-1", n if n != "switched_off" else "linux_auth", n != "switched_off") for n in forms if n != "unregistered"]
    sources = spark.createDataFrame(listed, "source_id string, org_id string, parser string, is_enabled boolean")
    parsed = normalize.parse_records(normalize.stamp_sources(batch, sources), now=F.timestamp_millis(F.lit(NOW_MS)))
    good = c("problem").isNull()
    return parsed.groupBy("parser", c("problem.kind").alias("kind"), F.when(good, c("class_uid")).alias("class_uid")).agg(F.count("*").alias("n"))


@query
def content_fingerprints(spark, sf_dir):
    """Every record delivered twice: the copies share a fingerprint, and so an id."""
    raw = _ocsf_raw(spark, sf_dir)
    twice = raw.unionByName(raw.withColumn("position", c("position") + 1_000_000_000))
    parsed = normalize.parse_records(twice, "ocsf", F.timestamp_millis(F.lit(NOW_MS)))
    stored = normalize.accepted_events(parsed, F.timestamp_millis(F.lit(NOW_MS)))
    per_copy = stored.groupBy(c("sx.fingerprint").alias("f"), c("sx.event_uid").alias("u")).agg(F.count("*").alias("copies"), F.max("class_uid").alias("class_uid"))
    shaped = c("u").rlike("^[0-9a-f]{8}-[0-9a-f]{4}-5[0-9a-f]{3}-[89ab][0-9a-f]{3}-[0-9a-f]{12}$")
    return per_copy.groupBy("class_uid").agg(
        F.sum("copies").cast("long").alias("rows"), F.count("*").alias("contents"), F.count_if(shaped).alias("well_formed")
    )


@query
def event_ids(spark, sf_dir):
    t = flat_telemetry(spark, sf_dir)
    return t.select("event_id", ids.digest(c("org_id"), c("source_id"), c("event_uid")).alias("fingerprint")).withColumn(
        "uid", ids.event_uid(c("fingerprint"))
    )


@query
def event_times(spark, sf_dir):
    t = flat_telemetry(spark, sf_dir)
    at = F.timestamp_millis("time_ms")
    written = (
        F.when(c("k") % 5 == 0, c("time_ms").cast("string"))
        .when(c("k") % 5 == 1, F.floor(c("time_ms") / 1000).cast("string"))
        .when(c("k") % 5 == 2, F.date_format(at, "yyyy-MM-dd'T'HH:mm:ss.SSSXXX"))
        .when(c("k") % 5 == 3, F.date_format(at, "yyyy-MM-dd HH:mm:ss"))
        .otherwise(F.lit("not a time"))
    )
    return t.select("event_id", F.unix_millis(scalars.event_time(written)).alias("read_ms"))


@query
def source_join(spark, sf_dir):
    """Records stamped by their source; a disabled source's records are left out."""
    t = flat_telemetry(spark, sf_dir).select("event_id", "source_id")
    sources = (
        flat_telemetry(spark, sf_dir)
        .groupBy("source_id")
        .agg(F.max("org_id").alias("org_id"))
        .withColumns({"is_enabled": c("source_id") != "src-1", "parser": F.lit("ocsf")})
    )
    stamped = normalize.stamp_sources(t, sources)
    return stamped.groupBy("source_id", "org_id", "parser").agg(F.count("*").alias("records"))


@query
def redacted_evidence(spark, sf_dir):
    t = telemetry(spark, sf_dir)
    shown = normalize.redact_raw(t, c("sx.source_id") == "src-0")
    return shown.select(c("sx.event_uid").alias("event_uid"), "raw_data")


@query
def xml_records(spark, sf_dir):
    t = flat_telemetry(spark, sf_dir)
    event = F.concat(
        F.lit("<Event xmlns='http://schemas.microsoft.com/win/2004/08/events/event'><System><EventID>"),
        F.when(c("k") % 2 == 0, F.lit("4624")).otherwise(F.lit("4625")),
        F.lit("</EventID><TimeCreated SystemTime='"),
        F.date_format(F.timestamp_millis("time_ms"), "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'"),
        F.lit("'/><EventRecordID>"),
        c("event_id").cast("string"),
        F.lit("</EventRecordID><Channel>Security</Channel><Computer>"),
        c("device_hostname"),
        F.lit("</Computer></System><EventData><Data Name='TargetUserName'>"),
        c("user_name"),
        F.lit("</Data><Data Name='IpAddress'>"),
        c("src_ip"),
        F.lit("</Data></EventData></Event>"),
    )
    whole = F.when(c("k") == 13, F.concat(F.lit("<!DOCTYPE x>"), event)).when(
        c("k") == 14, F.lit("<Event><Nothing/></Event>")
    ).otherwise(F.concat(F.lit("\n"), event, F.lit("\n"), event))
    found = records.xml_events(t.select("event_id", whole.alias("value")))
    data = lambda name: F.try_element_at("record.EventData", F.lit(name))
    return found.select(
        "event_id",
        c("position").cast("int").alias("position"),
        c("problem.reason").alias("problem"),
        "channel",
        c("record.EventID").alias("code"),
        c("record.Computer").alias("computer"),
        data("TargetUserName").alias("user_name"),
        data("IpAddress").alias("ip"),
    )


@query
def rendered_records(spark, sf_dir):
    t = flat_telemetry(spark, sf_dir)
    block = F.concat(
        F.date_format(F.timestamp_millis("time_ms"), "MM/dd/yyyy hh:mm:ss a"),
        F.lit("\nLogName=Security\nEventCode="),
        F.when(c("k") == 7, F.lit("none")).otherwise(F.lit("4625")),
        F.lit("\nComputerName="),
        c("device_hostname"),
        F.lit("\nMessage=An account failed to log on.\n\nSubject:\n\tSecurity ID:\t\tNULL SID\n\tAccount Name:\t\t-\n\nLogon Type:\t\t\t3\n\n"),
        F.lit("Account For Which Logon Failed:\n\tSecurity ID:\t\tS-1-5-21-"),
        c("user_id_text"),
        F.lit("\n\tAccount Name:\t\t"),
        c("user_name"),
        F.lit("\n\nNetwork Information:\n\tSource Network Address:\t"),
        c("src_ip"),
        F.when(c("k") % 6 == 0, F.lit("\n\tSource Port:\t\t1\n\nMore:\n\tSource Port:\t\t2\n")).otherwise(F.lit("\n\tSource Port:\t\t443\n")),
    )
    texts = t.withColumn("user_id_text", F.regexp_extract("user_name", r"(\d+)$", 1)).select("event_id", block.alias("value"))
    found = records.rendered_events(texts)
    data = lambda name: F.try_element_at("record.EventData", F.lit(name))
    return found.select(
        "event_id",
        c("problem.reason").alias("problem"),
        c("record.TimeCreated").alias("created"),
        c("record.Computer").alias("computer"),
        data("TargetUserName").alias("user_name"),
        data("TargetUserSid").alias("sid"),
        data("SubjectUserSid").alias("subject_sid"),
        data("LogonType").alias("logon_type"),
        data("IpAddress").alias("ip"),
        data("IpPort").alias("port"),
    )


@query
def export_routing(spark, sf_dir):
    t = flat_telemetry(spark, sf_dir)
    kinds = ("XmlWinEventLog:Security", "WinEventLog:Security", "WinEventLog:Setup", "linux_secure", "ocsf", "_json", "stream:http", "")
    sourcetype = F.element_at(F.array(*[F.lit(x) for x in kinds]), (c("k") % 8 + 1).cast("int"))
    raw = (
        F.when(c("k") % 8 == 0, F.when(c("k") % 3 == 0, F.lit("<Event><System><Channel>Setup</Channel></System></Event>")).otherwise(F.lit("<Event><System><Channel>Security</Channel></System></Event>")))
        .when(c("k") % 8 == 4, F.lit('{"class_uid":4001}'))
        .when(c("k") % 8 == 5, F.lit('{"x":1}'))
        .otherwise(F.when(c("k") % 11 == 0, F.lit(" ")).otherwise(F.lit("text")))
    )
    routed = records.route_export(t.select(sourcetype.alias("sourcetype"), raw.alias("_raw"), F.lit("t").alias("_time")))
    return routed.groupBy("parser", "reason").agg(F.count("*").alias("results"))


@query
def json_bodies(spark, sf_dir):
    t = flat_telemetry(spark, sf_dir)
    one = F.concat(F.lit('{"id":'), c("event_id").cast("string"), F.lit("}"))
    body = (
        F.when(c("k") % 4 == 0, one)
        .when(c("k") % 4 == 1, F.concat(F.lit("["), one, F.lit(","), one, F.lit("]")))
        .when(c("k") % 4 == 2, F.concat(F.lit('{"events":['), one, F.lit(","), one, F.lit(","), one, F.lit("]}")))
        .otherwise(F.lit("not json"))
    )
    found = records.json_records(t.select("event_id", body.alias("value")))
    return found.groupBy("event_id").agg(
        F.count_if(c("problem").isNull()).alias("records"),
        F.count_if(c("problem").isNotNull()).alias("problems"),
        F.max(F.get_json_object("raw", "$.id").try_cast("long")).alias("id"),
    )


@query
def replay_shift(spark, sf_dir):
    t = flat_telemetry(spark, sf_dir).select("event_id", "time_ms")
    return records.shift_to(t, F.lit(NOW_MS).cast("long"))


# ------------------------------------------------------------------------------------------------------- sinks
def _duplicated(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Telemetry with later copies: one event of three twice, one of nine thrice."""
    t = telemetry(spark, sf_dir).withColumn("_k", F.try_element_at("unmapped", F.lit("k")).cast("int"))
    copies = F.when(c("_k") % 9 == 0, F.array(F.lit(0), F.lit(1), F.lit(2))).when(c("_k") % 3 == 0, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))
    spread = t.withColumn("_copy", F.explode(copies))
    later = c("sx").withField("ingested_at", c("sx.ingested_at") + F.make_interval(secs=c("_copy")))
    return spread.withColumn("sx", later).drop("_k", "_copy")


@query
def first_copies(spark, sf_dir):
    kept = sinks.first_copies(_duplicated(spark, sf_dir))
    return kept.select(c("sx.event_uid").alias("event_uid"), F.unix_millis("sx.ingested_at").alias("ingested_ms"))


@query
def new_events(spark, sf_dir):
    stored = sinks.with_partitions(telemetry(spark, sf_dir).filter(c("time_ms") < 1_705_000_000_000))
    fresh = sinks.new_events(_duplicated(spark, sf_dir), stored)
    return fresh.groupBy("class_uid").agg(F.count("*").alias("n"))


@query
def index_outcome(spark, sf_dir):
    stored = telemetry(spark, sf_dir).filter(c("time_ms") < 1_705_000_000_000)
    unstorable = c("unmapped")["k"] == "13"  # as if these had lost their time
    return sinks.index_outcome(_duplicated(spark, sf_dir).withColumn("time", F.when(~unstorable, c("time"))), stored)


@query
def retained_events(spark, sf_dir):
    kept = sinks.retain(sinks.with_partitions(telemetry(spark, sf_dir)), F.to_date(F.lit("2024-01-31")), 10)
    return kept.groupBy("category", F.date_format("event_date", "yyyy-MM-dd").alias("day")).agg(F.count("*").alias("n"))


@query
def source_health(spark, sf_dir):
    t = flat_telemetry(spark, sf_dir)
    per_user = t.groupBy("user_name").agg(
        F.max(F.when(c("k") != 50, c("time_ms"))).alias("last_event_ms"),
        F.max(F.when(c("status_id") == 2, c("time_ms"))).alias("last_error_ms"),
        (F.max("k") != 99).alias("is_enabled"),
    )
    health = sinks.source_health(per_user, F.lit(1_706_659_200_000), 24 * 3_600_000)
    return health.groupBy("health").agg(F.count("*").alias("sources"))


@query
def ingest_latency(spark, sf_dir):
    late = sinks.latency(telemetry(spark, sf_dir), F.lit(1_705_000_000_000))
    return late.select("source_id", "max_lag_ms", "max_age_ms")


# --------------------------------------------------------------------------------------------------- predicates
@query
def field_predicates(spark, sf_dir):
    t = telemetry(spark, sf_dir)
    flags = {
        "glob_ends": P.field_match(("process.file.path",), P.glob("*\\WHOAMI.exe")),
        "glob_middle": P.field_match(("process.cmd_line",), P.glob("net*admins?*/DOMAIN")),
        "glob_cased": P.field_match(("process.name",), P.glob("Net.exe", cased=True)),
        "regex": P.field_match(("process.cmd_line",), P.regex(r"-ENC\s+a+", "i")),
        "number_text": P.field_match(("unmapped.k",), P.number_equals(7)),
        "number_below": P.field_match(("unmapped.k",), P.number_compare("lt", 10)),
        "number_other": P.field_match(("dst_endpoint.port",), P.number_compare("neq", 443)),
        "flag": P.field_match(("is_mfa",), P.bool_equals(True)),
        "in_network": P.field_match(("src_endpoint.ip", "dst_endpoint.ip"), P.cidr("192.0.2.0/29")),
        "external": P.field_match(("src_endpoint.ip",), P.external_ip()),
        "equals_text": P.field_match(("user.name",), P.equals("USER7")),
        "equals_number": P.field_match(("class_uid",), P.equals(3002)),
        "present": P.field_exists(("user.domain",)),
        "absent": P.field_is_null(("user.domain", "query.hostname")),
        "fan_out": P.field_match(("observables.value",), P.glob("10.0.0.*")),
        "neither": P.negate(P.any_of([P.field_match(("status_id",), P.equals(2)), P.field_match(("user.domain",), P.equals("corp"))])),
        "logon": P.is_successful_logon(),
    }
    return t.select(c("sx.event_uid").alias("event_uid"), *[F.coalesce(v, F.lit(False)).alias(k) for k, v in flags.items()])


@query
def text_predicates(spark, sf_dir):
    """Glob, regex and keyword tests over whole documents."""
    d = _table(spark, sf_dir, "documents")
    kind = d.schema["text"].dataType
    return d.select(
        "doc_id",
        P.glob("*the*of*")(c("text"), kind).alias("glob"),
        P.regex(r"\d{1,3}(\.\d{1,3}){3}")(c("text"), kind).alias("regex"),
        P.glob("license", open_start=True, open_end=True)(c("text"), kind).alias("keyword"),
    )


@query
def scope_counts(spark, sf_dir):
    t = telemetry(spark, sf_dir)
    scopes = [s for s in SCOPES if s.name in ("process_creation", "network_connection", "dns_query", "linux/auth", "process_access", "registry_event")]
    named = F.array_compact(F.array(*[F.when(s.where(), F.lit(s.name)) for s in scopes]))
    return t.select(F.explode(named).alias("scope")).groupBy("scope").agg(F.count("*").alias("events"))


@query
def external_addresses(spark, sf_dir):
    t = flat_telemetry(spark, sf_dir)
    octets = [(c("event_id") * m) % 256 for m in (7, 11, 13, 17)]
    address = F.concat_ws(".", *[o.cast("string") for o in octets])
    return t.select("event_id", address.alias("ip")).select("event_id", "ip", net.is_external_ip(c("ip")).alias("external"), net.ipv4_number(c("ip")).alias("number"))


@query
def host_and_user_names(spark, sf_dir):
    t = flat_telemetry(spark, sf_dir)
    host = scalars.normalise_host(F.concat(c("device_hostname"), F.lit(".")))
    return t.select(
        "event_id", host.alias("host"), scalars.scoped_user(c("user_name"), c("user_domain"), host).alias("user")
    )


@query
def page_domains(spark, sf_dir):
    """Hosts of page URLs as domains and as indicators."""
    pages = _table(spark, sf_dir, "pages")
    host = F.regexp_extract("url", r"^[a-z]+://([^/:?#]+)", 1)
    return pages.select(
        "page_id", scalars.normalise_domain(host).alias("domain"), intel.indicator_value(F.lit("domain"), host).alias("indicator")
    )


@query
def document_mentions(spark, sf_dir):
    """IPv4 addresses and digests named in whole documents."""
    d = _table(spark, sf_dir, "documents")
    return d.select("doc_id", F.explode(text.mentions(c("text"))).alias("value")).groupBy("doc_id", "value").agg(F.count("*").alias("n"))


@query
def decoded_commands(spark, sf_dir):
    t = flat_telemetry(spark, sf_dir)
    plain = F.concat(F.lit("run "), c("user_name"), F.when(c("k") % 7 == 0, F.lit(" $exec_wrapper")).otherwise(""))
    line = F.concat(
        F.element_at(F.array(*[F.lit(s) for s in ("powershell -e ", "powershell /EncodedCommand ", "powershell -file ")]), (c("k") % 3 + 1).cast("int")),
        F.base64(F.encode(plain, "UTF-16LE")),
    )
    return t.select("event_id", line.alias("line")).select(
        "event_id", text.decoded_command(c("line")).alias("decoded"), text.is_harness_command(c("line")).alias("harness")
    )


@query
def page_cursors(spark, sf_dir):
    t = flat_telemetry(spark, sf_dir)
    cursor = ids.encode_cursor(c("time_ms"), c("event_uid"))
    back = ids.decode_cursor(c("cursor"))
    return t.select("event_id", cursor.alias("cursor")).select("event_id", "cursor", back["time_ms"].alias("time_ms"), back["uid"].alias("uid"))


@query
def entity_aliases(spark, sf_dir):
    s = entities.extract_sightings(telemetry(spark, sf_dir)).select("entity_key").distinct()
    return s.select("entity_key", F.explode(text.aliases(c("entity_key"))).alias("alias"))


# ---------------------------------------------------------------------------------------------------- detection
@query
def many_rule_matches(spark, sf_dir):
    """How often each of 930 rules fires, in one scan."""
    rules = list(R.rulebook(*R.many_rules()).rules)
    return detect.detect_single(telemetry(spark, sf_dir), rules).groupBy("rule_id").agg(F.count("*").alias("n"))


@lru_cache(maxsize=4)
def _loaded(spark: SparkSession, sf_dir: str, application: str) -> rules.LoadedRules:
    return rules.load_rules(spark, write_pack(spark, sf_dir))


def loaded(spark: SparkSession, sf_dir: str) -> rules.LoadedRules:
    """The rules of a directory with one file a page, loaded once per session."""
    return _loaded(spark, sf_dir, spark.sparkContext.applicationId)


@query
def loaded_rules(spark, sf_dir):
    """What a nested rule directory yields: rules with their source, and files with the reason they were refused."""
    pack = loaded(spark, sf_dir)
    kept = pack.to_dataframe(spark).select(
        "path", "rule_id", "title", "rule_type", "severity_id", _csv("techniques").alias("techniques"), "source_url", "threshold", "window_ms", F.lit(None).cast("string").alias("reason")
    )
    return kept.unionByName(pack.refused_dataframe(spark), allowMissingColumns=True)


@query
def rule_import_tally(spark, sf_dir):
    return rules.import_tally(loaded(spark, sf_dir), spark)


@query
def selected_rule_files(spark, sf_dir):
    """The files that an import copies, verbatim, as the manifest beside them lists them."""
    out = f"{write_pack(spark, sf_dir)}-selected"
    rules.write_selection(spark, out.removesuffix("-selected"), out, "r1")
    listed = spark.read.text(f"{out}/manifest").select(F.from_json("value", "release string, selected long, files array<string>").alias("m"))
    files = listed.select("m.release", "m.selected", F.explode("m.files").alias("path"))
    rows = files.hint("shuffle_merge")  # texts are larger than the files that Spark estimates them from
    return rows.join(spark.read.parquet(f"{out}/rules"), "path").select("release", "selected", "path", F.length("text").alias("length"))


@query
def loaded_rule_matches(spark, sf_dir):
    """How often each loaded single-event rule fires; a rule's '-' also stands for a field that is absent."""
    return detect.detect_single(telemetry(spark, sf_dir), loaded(spark, sf_dir).single).groupBy("rule_id").agg(F.count("*").alias("n"))


@query
def loaded_count_findings(spark, sf_dir):
    """Findings of the loaded correlation rules that count four queries of a site within an hour."""
    four = loaded(spark, sf_dir).chosen("rule_type = 'threshold' AND threshold = 4", 1)
    found = detect.detect_threshold(telemetry(spark, sf_dir), four)
    site = F.get(F.element_at("entities", F.lit("query.hostname")), F.lit(0))
    return found.select(site.alias("site"), c("last_ms").alias("at_ms"), F.size("evidence").alias("events"))


@query
def rule_matches(spark, sf_dir):
    found = _single(spark, sf_dir)
    return found.select(
        c("rule_title"), F.get("evidence", F.lit(0)).alias("event_uid"), "finding_id", "severity_id", _csv("techniques").alias("techniques"), "first_ms"
    )


@query
def finding_entities(spark, sf_dir):
    found = _single(spark, sf_dir)
    return found.select(F.get("evidence", F.lit(0)).alias("event_uid"), "rule_title", F.explode("entities").alias("name", "values")).select(
        "event_uid", "rule_title", "name", _csv("values").alias("values")
    )


@query
def keyword_rule(spark, sf_dir):
    document = {
        "id": "b6a4c0de-0010-4c55-9d10-000000000010",
        "title": "keyword",
        "level": "low",
        "logsource": {"product": "linux", "service": "auth"},
        "detection": {"keywords": ["user1 ", "FAILED to"], "other": ["user12"], "condition": "keywords and not other"},
    }
    found = detect.detect_single(telemetry(spark, sf_dir), R.rulebook(document).single)
    return found.select(F.get("evidence", F.lit(0)).alias("event_uid"))


@query
def window_event_counts(spark, sf_dir):
    rules = R.rulebook(R.REPEATED_CONNECTIONS).threshold
    counted = detect.window_counts(detect.threshold_matches(telemetry(spark, sf_dir), rules))
    return counted.select(F.translate("group_key", "\x1f", "|").alias("group_key"), "event_uid", "time_ms", "seen")


@query
def window_distinct_counts(spark, sf_dir):
    rules = R.rulebook(R.BUSY_SOURCE).threshold
    counted = detect.window_counts(detect.threshold_matches(telemetry(spark, sf_dir), rules))
    return counted.select("group_key", "event_uid", "time_ms", "seen")


@query
def threshold_firings(spark, sf_dir):
    rules = R.rulebook(R.BUSY_SOURCE).threshold
    matches = detect.threshold_matches(telemetry(spark, sf_dir), rules)
    return detect.firings(detect.triggers(matches)).select("group_key", "at_ms", "trigger_uid")


@per_session
def _spray(spark: SparkSession, sf_dir: str) -> DataFrame:
    return detect.detect_threshold(telemetry(spark, sf_dir), R.rulebook(R.PASSWORD_SPRAY).threshold)


@per_session
def _single(spark: SparkSession, sf_dir: str) -> DataFrame:
    return detect.detect_single(telemetry(spark, sf_dir), R.rulebook(*R.SINGLE).single)


@query
def spray_findings(spark, sf_dir):
    return _spray(spark, sf_dir).select(
        F.get(F.element_at("entities", F.lit("src_endpoint.ip")), F.lit(0)).alias("src_ip"),
        "first_ms",
        "last_ms",
        F.size("evidence").cast("long").alias("events"),
        _csv("evidence").alias("evidence"),
        _csv(F.element_at("entities", F.lit("user.name"))).alias("users"),
        "finding_id",
    )


@query
def busy_source_findings(spark, sf_dir):
    found = detect.detect_threshold(telemetry(spark, sf_dir), R.rulebook(R.BUSY_SOURCE).threshold)
    return found.select(
        F.get(F.element_at("entities", F.lit("sx.source_id")), F.lit(0)).alias("source_id"),
        "first_ms",
        "last_ms",
        F.size("evidence").cast("long").alias("events"),
        _csv(F.element_at("entities", F.lit("user.name"))).alias("users"),
    )


@query
def new_findings(spark, sf_dir):
    found = _single(spark, sf_dir)
    stored = found.filter(c("first_ms") < 1_705_000_000_000)
    return sinks.new_findings(found.unionByName(found), stored).groupBy("rule_title").agg(F.count("*").alias("n"))


# ----------------------------------------------------------------------------------------- entities and graph
@per_session
def _sightings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return entities.extract_sightings(telemetry(spark, sf_dir))


@query
def entity_sightings(spark, sf_dir):
    return _sightings(spark, sf_dir).select("event_uid", "field", "entity_key", "links")


@per_session
def _evidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Digests of all telemetry, read as one incident per log source: three very large incidents."""
    digests = entities.digest(telemetry(spark, sf_dir))
    source = telemetry(spark, sf_dir).select(c("sx.event_uid").alias("event_uid"), c("sx.source_id").alias("incident_id"))
    return cut_lineage(digests.join(source, "event_uid"))  # a stored table in practice: read by many queries


@query
def evidence_digests(spark, sf_dir):
    d = entities.digest(telemetry(spark, sf_dir))
    return d.select(
        "event_uid",
        "action",
        "outcome",
        "cmd_line",
        "dst_port",
        entities.first_of("host").alias("host"),
        entities.first_of("user").alias("user"),
        entities.remote_key().alias("remote"),
        F.size(F.map_keys("roles")).cast("long").alias("roles"),
    )


@query
def event_relations(spark, sf_dir):
    return graph.event_relations(entities.digest(telemetry(spark, sf_dir))).select("event_uid", "source", "relation", "target")


@query
def graph_edges(spark, sf_dir):
    e = graph.edges(_evidence(spark, sf_dir), ["incident_id"])
    return e.select(
        "incident_id", "edge_id", "label", "first_ms", "last_ms", "event_count", _csv("events").alias("events"),
        _csv(F.transform("ports", lambda p: p.cast("string"))).alias("ports"),
    )


@query
def graph_nodes(spark, sf_dir):
    n = graph.nodes(_evidence(spark, sf_dir), ["incident_id"])
    return n.select("incident_id", "key", "type", "value", "external", "first_ms", "last_ms", "event_count", _csv("events").alias("events"))


@query
def graph_connections(spark, sf_dir):
    merged = graph.connections(graph.edges(_evidence(spark, sf_dir), ["incident_id"]), ["incident_id"])
    return merged.select(
        "incident_id", "source", "target", F.size("labels").cast("long").alias("labels"), "event_count",
        _csv(F.transform("ports", lambda p: p.cast("string"))).alias("ports"),
    )


@query
def first_graph_nodes(spark, sf_dir):
    n = graph.nodes(_evidence(spark, sf_dir).filter(c("incident_id") == "src-0"), ["incident_id"])
    return n.orderBy(*graph.node_order()).limit(25).select("key", "external", "first_ms")


# ------------------------------------------------------------------------------------------------------ timeline
@query
def timeline_members(spark, sf_dir):
    return timeline.step_members(_evidence(spark, sf_dir)).select("incident_id", "event_uid", "step_id")


@query
def timeline_steps(spark, sf_dir):
    steps = timeline.timeline(_evidence(spark, sf_dir))
    return steps.select(
        "incident_id", "step_id", "first_ms", "last_ms", "event_count", "action", "outcome", "host", "remote", "process", "parent_process",
        _csv("users").alias("users"), _csv("domains").alias("domains"), _csv("command_lines").alias("command_lines"),
        _csv(F.transform("remote_ports", lambda p: p.cast("string"))).alias("ports"),
    )


@query
def timeline_chain(spark, sf_dir):
    return timeline.step_chain(timeline.timeline(_evidence(spark, sf_dir))).select("incident_id", "step_id", "next_step_id")


@per_session
def _pseudo_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Findings of the single-event and spray rules read as links of their log source's incident."""
    events = telemetry(spark, sf_dir)
    found = _single(spark, sf_dir).unionByName(_spray(spark, sf_dir))
    source = events.select(c("sx.event_uid").alias("_uid"), c("sx.source_id").alias("incident_id"))
    placed = found.withColumn("_uid", F.get("evidence", F.lit(0))).join(source, "_uid").drop("_uid")
    return placed.select(
        "incident_id", "org_id", c("finding_id").alias("link_id"), F.lit("finding").alias("kind"), F.lit("opened").alias("rule"), F.lit("").alias("reason"),
        "evidence", "first_ms", "last_ms", "finding_id", "rule_id", "rule_title", "rule_author", "rule_source", "severity_id", "techniques", "tactics",
    )


@query
def step_citations(spark, sf_dir):
    members = timeline.step_members(_evidence(spark, sf_dir))
    cited = timeline.step_citations(members, _pseudo_links(spark, sf_dir))
    return cited.groupBy("incident_id", "step_id").agg(F.count("*").alias("links"), F.max("title").alias("last_title"))


@query
def unresolved_events(spark, sf_dir):
    evidence = _evidence(spark, sf_dir).filter(c("time_ms") < 1_705_000_000_000)
    return timeline.unresolved_events(_pseudo_links(spark, sf_dir), evidence).groupBy("incident_id").agg(F.count("*").alias("events"))


# ------------------------------------------------------------------------------------------------------ baseline
@query
def baselines(spark, sf_dir):
    return baseline.observe(telemetry(spark, sf_dir))


@query
def merged_baselines(spark, sf_dir):
    t = telemetry(spark, sf_dir)
    early, late = t.filter(c("time_ms") < 1_705_000_000_000), t.filter(c("time_ms") >= 1_705_000_000_000)
    return baseline.merge_baselines(baseline.observe(early), baseline.observe(late))


@query
def baseline_span(spark, sf_dir):
    return baseline.coverage_span(baseline.observe(telemetry(spark, sf_dir)))


@query
def evidence_observations(spark, sf_dir):
    seen = baseline.evidence_observations(entities.digest(telemetry(spark, sf_dir)))
    return seen.groupBy("kind", "key").agg(F.count("*").alias("observations"))


@query
def incident_novelty(spark, sf_dir):
    """What the second half of the data holds that the first did not, per log source."""
    half = 1_705_000_000_000
    evidence = _evidence(spark, sf_dir).filter(c("time_ms") >= half)
    started = evidence.groupBy("incident_id").agg(F.min("time_ms").alias("first_ms"))
    known = baseline.observe(telemetry(spark, sf_dir).filter(c("time_ms") < half))
    return baseline.novelty(evidence, known, started).select("incident_id", "kind", "key", "observations", "first_ms", "new_here", "sentence")


@query
def rarest_novelty(spark, sf_dir):
    return (
        incident_novelty(spark, sf_dir).filter(c("incident_id") == "src-1").orderBy(*baseline.novelty_order()).limit(20).select("kind", "key", "observations", "new_here")
    )


# --------------------------------------------------------------------------------------------------- correlation
@query
def failed_logon_followups(spark, sf_dir):
    """Successful logons within an hour after a failure from the same address on the same host."""
    t = flat_telemetry(spark, sf_dir)
    base = t.filter(c("class_uid") == 3002).select(
        "org_id", c("src_ip").alias("source_key"), scalars.normalise_host(c("device_hostname")).alias("host_key"), "event_uid", "status_id", "time_ms"
    )
    attempts = base.filter(c("status_id") == 1).withColumnRenamed("time_ms", "at_ms")
    failures = base.filter(c("status_id") == 2).withColumns({"first_ms": c("time_ms"), "last_ms": c("time_ms")})
    return correlate.logons_after_failures(attempts, failures).select("source_key", "host_key", "event_uid", "at_ms", "failures")


@query
def finding_evidence(spark, sf_dir):
    """Findings joined to the events they cite."""
    cited = _spray(spark, sf_dir).select("finding_id", F.explode("evidence").alias("event_uid"))
    events = telemetry(spark, sf_dir).select(c("sx.event_uid").alias("event_uid"), c("user.name").alias("user_name"), "time_ms")
    return cited.join(events, "event_uid").groupBy("user_name").agg(F.count("*").alias("citations"), F.min("time_ms").alias("first_ms"))


@query
def findings_with_technique(spark, sf_dir):
    found = _single(spark, sf_dir)
    return found.filter(F.array_contains("techniques", "T1033")).select("finding_id", "first_ms")


def _two_organisations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The telemetry of two organisations, in which some logons name a second host."""
    named = (c("class_uid") == 3002) & (c("status_id") == 1) & (c("unmapped")["k"].cast("int") % 4 == 0)
    host = F.concat(F.lit("WS-"), c("unmapped")["k"].cast("int") % 20)
    blank = F.struct(*[F.lit(None).cast(f.dataType).alias(f.name) for f in S.ENDPOINT.fields])
    events = telemetry(spark, sf_dir)
    org = F.when(c("sx.source_id") == "src-2", "org-2").otherwise("org-1")
    return events.withColumns(
        {
            "sx": c("sx").withField("org_id", org),
            "dst_endpoint": F.when(named, F.coalesce("dst_endpoint", blank).withField("hostname", host)).otherwise(c("dst_endpoint")),
        }
    )


@lru_cache(maxsize=4)
def _investigation(spark: SparkSession, sf_dir: str, application: str) -> correlate.Incidents:
    events = _two_organisations(spark, sf_dir)
    found = detect.detect(events, list(R.rulebook(*R.INVESTIGATION).rules))
    return correlate.correlate(found, events)


def investigation(spark: SparkSession, sf_dir: str) -> correlate.Incidents:
    """Detection and correlation of the telemetry, once per session: the tables are checkpointed."""
    return _investigation(spark, sf_dir, spark.sparkContext.applicationId)


@query
def incidents(spark, sf_dir):
    i = investigation(spark, sf_dir).incidents
    return i.select(
        "incident_id", "title", "severity_id", "first_ms", "last_ms", "finding_count", "event_count",
        _csv("techniques").alias("techniques"), _csv("tactics").alias("tactics"),
    )


@query
def incident_links(spark, sf_dir):
    return investigation(spark, sf_dir).links.select(
        "org_id", "incident_id", "link_id", "kind", "rule", "reason", F.size("evidence").alias("events"), _csv(F.transform("matched", lambda m: m["key"])).alias("matched"),
        _csv(F.transform("matched", lambda m: F.concat(F.array_join(m["incident_events"], "+"), F.lit(">"), F.array_join(m["new_events"], "+")))).alias("shown"),
    )


@query
def incident_entities(spark, sf_dir):
    return investigation(spark, sf_dir).entities.select("incident_id", "entity_key", "links", "first_ms", "last_ms", F.size("events").alias("events"))


@query
def incident_assessments(spark, sf_dir):
    return investigation(spark, sf_dir).assessments.select("incident_id", "rule", "severity_id", "because")


@query
def incident_indicators(spark, sf_dir):
    return correlate.linking_indicators(investigation(spark, sf_dir).entities)


@query
def incident_steps(spark, sf_dir):
    return timeline.timeline(investigation(spark, sf_dir).evidence).select("incident_id", "step_id", "action", "first_ms", "event_count")


@query
def incident_report_lines(spark, sf_dir):
    i = investigation(spark, sf_dir)
    members = timeline.step_members(i.evidence)
    return reports.report_lines(
        i.incidents, i.assessments, timeline.timeline(i.evidence), members, timeline.step_citations(members, i.links), i.links, i.entities, None,
        F.timestamp_millis(F.lit(NOW_MS)),
    )


@query
def incident_attack_flows(spark, sf_dir):
    i = investigation(spark, sf_dir)
    members = timeline.step_members(i.evidence)
    flow = reports.attack_flow(i.incidents, timeline.timeline(i.evidence), timeline.step_citations(members, i.links), members, F.timestamp_millis(F.lit(NOW_MS)))
    return flow.select("incident_id", F.get_json_object("object", "$.type").alias("type"), "object")


@query
def incident_layers(spark, sf_dir):
    i = investigation(spark, sf_dir)
    return reports.incident_layers(i.incidents, i.links, F.timestamp_millis(F.lit(NOW_MS)))


@query
def incident_bundles(spark, sf_dir):
    i = investigation(spark, sf_dir)
    return reports.bundle_digests(reports.evidence_bundle(i.incidents, i.evidence, i.links, i.entities))


@query
def candidate_incidents(spark, sf_dir):
    """Open incidents each spray finding could join, by shared address or host, with activity within two hours."""
    found = _spray(spark, sf_dir)
    sightings = correlate.finding_sightings(found, telemetry(spark, sf_dir)).filter("links")
    keys = sightings.select("org_id", "finding_id", "entity_key").distinct().join(found.select("finding_id", "first_ms", "last_ms"), "finding_id")
    # The snapshot: per host and day, what was active, as incidents.
    day = F.floor(c("at_ms") / 86_400_000)
    active = _sightings(spark, sf_dir).filter(c("entity_type") == "host").withColumn("incident_id", F.concat_ws("/", "entity_value", day.cast("string")))
    held = active.select("org_id", "incident_id", "entity_key").distinct()
    spans = active.groupBy("incident_id").agg(F.min("at_ms").alias("first_ms"), F.max("at_ms").alias("last_ms")).withColumn(
        "status", F.when(c("incident_id").endswith("0"), "closed").otherwise("new")
    )
    joined = correlate.open_incidents_for(keys, held, spans)
    return joined.select("finding_id", "incident_id", "shared", "last_ms")


@query
def layer_scores(spark, sf_dir):
    scored = reports.incident_technique_scores(_pseudo_links(spark, sf_dir))
    return scored.select("incident_id", "technique_id", "score", F.array_join("rules", "; ").alias("rules"))


@query
def assessed_sources(spark, sf_dir):
    """The assessment rules over findings grouped by log source."""
    links = _pseudo_links(spark, sf_dir).withColumn(
        "matched", F.array().cast("array<struct<key:string,incident_events:array<string>,new_events:array<string>>>")
    )
    held = _sightings(spark, sf_dir).join(
        telemetry(spark, sf_dir).select(c("sx.event_uid").alias("event_uid"), c("sx.source_id").alias("incident_id")), "event_uid"
    ).groupBy("incident_id", "entity_key", "entity_type", "entity_value").agg(F.min("at_ms").alias("first_ms"))
    rows, reasons, _ = correlate.assess(links, held)
    because = reasons.groupBy("incident_id").agg(F.array_join(F.array_sort(F.collect_list("rule")), ",").alias("reasons"))
    return rows.join(because, "incident_id").select(
        "incident_id", "title", "severity_id", "first_ms", "last_ms", "finding_count", "event_count",
        _csv("techniques").alias("techniques"), _csv("tactics").alias("tactics"), "reasons",
    )


@query
def merged_entities(spark, sf_dir):
    """Entities per log source stored from the first half of the data, widened by the second half."""
    half = 1_705_000_000_000
    source = telemetry(spark, sf_dir).select(c("sx.event_uid").alias("event_uid"), c("sx.source_id").alias("incident_id"))
    seen = _sightings(spark, sf_dir).join(source, "event_uid").withColumn(
        "recorded_at", F.struct(c("at_ms").alias("a"), c("event_uid").alias("b"))
    )
    early = correlate.incident_entities(seen.filter(c("at_ms") < half)).drop("recorded")
    late = correlate.incident_entities(seen.filter(c("at_ms") >= half)).drop("recorded")
    merged = sinks.merge_entities(early, late)
    return merged.select("incident_id", "entity_key", "links", "first_ms", "last_ms", _csv("events").alias("events"))


# ----------------------------------------------------------------------------------------------------- intelligence
@per_session
def _feed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An indicator feed written from page hosts and telemetry addresses; part of it is not usable."""
    pages = _table(spark, sf_dir, "pages").select(
        c("page_id").alias("position"),
        F.lit("domain").alias("type"),
        F.regexp_extract("url", r"^[a-z]+://([^/:?#]+)", 1).alias("value"),
        F.element_at(F.array(*[F.lit(v) for v in ("malicious", "Suspicious", "benign", "odd")]), (c("page_id") % 4 + 1).cast("int")).alias("verdict"),
        F.when(c("page_id") % 10 == 0, F.lit("120")).otherwise(c("page_id") % 100).cast("string").alias("confidence"),
        F.lit("pages").alias("source"),
        F.lit("a; b ;;c").alias("tags"),
    )
    addresses = flat_telemetry(spark, sf_dir).select(
        (c("event_id") + 1_000_000_000).alias("position"),
        F.lit("IP").alias("type"),
        F.coalesce("dst_ip", "src_ip").alias("value"),
        F.when(c("k") % 2 == 0, F.lit("malicious")).otherwise(F.lit("")).alias("verdict"),
        F.lit("").alias("confidence"),
        F.lit("").alias("source"),
        F.lit("").alias("tags"),
    )
    return intel.feed_rows(pages.unionByName(addresses))


@query
def feed_rows_checked(spark, sf_dir):
    return _feed(spark, sf_dir).groupBy("type", "is_valid").agg(F.count("*").alias("n"), F.count_if(c("value").isNull()).alias("no_indicator"))


@query
def feed_indicators(spark, sf_dir):
    return intel.feed(_feed(spark, sf_dir)).select("type", "value", "verdict", "confidence", "summary", _csv("tags").alias("tags"))


@per_session
def _sighted(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What was sighted, each thing once: written, as it is asked for and looked up, and events are many."""
    return cut_lineage(_sightings(spark, sf_dir).select("entity_key", "entity_type", "links").distinct())


@per_session
def _indicators(spark: SparkSession, sf_dir: str) -> DataFrame:
    keys = _sighted(spark, sf_dir).filter(c("links") & c("entity_type").isin("ip", "domain")).select("entity_key").distinct()
    return keys.select(intel.parse_indicator(c("entity_key")).alias("i")).filter("i is not null").select("i.*")


@query
def intel_results(spark, sf_dir):
    """Answers for indicators without a fresh cached one."""
    wanted = _indicators(spark, sf_dir)
    cached = wanted.filter(c("value").endswith("1")).select(
        F.lit("local").alias("provider"), "type", "value",
        F.when(c("value").endswith("11"), F.lit(NOW_MS - 1)).otherwise(F.lit(NOW_MS + 1)).alias("expires_ms"),
    )
    rows = intel.enrich(wanted, intel.feed(_feed(spark, sf_dir)), cached, "local", F.lit(NOW_MS), intel.FEED_TTL_MS)
    return rows.select("type", "value", "status", "verdict", "summary", "retrieved_ms", "expires_ms")


@query
def intel_lookup_report(spark, sf_dir):
    keys = _sighted(spark, sf_dir).select(c("entity_key").alias("key")).distinct()
    results = intel.intel_results(_indicators(spark, sf_dir).join(intel.feed(_feed(spark, sf_dir)), ["type", "value"], "left"), "local", F.lit(NOW_MS))
    return intel.lookup_report(keys, results).select("key", "invalid", "status", "verdict")


@query
def worst_verdicts(spark, sf_dir):
    usable = _feed(spark, sf_dir).filter("is_valid")
    results = usable.select(
        "type", "value", "verdict", F.concat(F.lit("p"), c("position") % 7).alias("provider"),
        F.when(c("position") % 5 == 0, F.lit("error")).otherwise(F.lit("found")).alias("status"),
    )
    return intel.worst_verdicts(results)


@query
def community_verdicts(spark, sf_dir):
    wanted = _indicators(spark, sf_dir)
    t = flat_telemetry(spark, sf_dir)
    told = t.filter(c("query_hostname").isNotNull() & (c("k") % 3 == 0)).select(
        F.lit("domain").alias("type"), c("query_hostname").alias("value"), c("event_id").alias("report_id"),
        F.concat(F.lit("r"), c("k")).alias("name"), F.array(c("source_id")).alias("tags"), c("time_ms").alias("created"), c("time_ms").alias("modified"),
    )
    allow = t.filter(c("query_hostname") == "site3.example").select(F.lit("domain").alias("type"), c("query_hostname").alias("value"), F.lit("top sites").alias("name"))
    passive = t.filter(c("dst_ip").isNotNull() & (c("k") % 10 < 5)).select(
        F.lit("ip").alias("type"), c("dst_ip").alias("value"), F.concat(F.lit("h"), c("k"), F.lit(".example")).alias("related"), c("event_id").alias("position")
    )
    answers = intel.community_answers(wanted, told, allow, passive)
    return answers.select("type", "value", "verdict", "summary", _csv("tags").alias("tags"), _csv("related").alias("related"), "provider_first_seen", "provider_last_seen")


# -------------------------------------------------------------------------------------------------------- search
def _window() -> dict:
    return {"org_id": ORG, "time_from": datetime(2024, 1, 5, tzinfo=UTC), "time_to": datetime(2024, 1, 25, tzinfo=UTC)}


@query
def event_search_page(spark, sf_dir):
    found = search.search_events(
        telemetry(spark, sf_dir), **_window(), class_uids=(3002, 1007), severity_min=1, status_id=1, source_id="src-1", limit=50
    )
    return found.select("event_uid", "time_ms", "class_uid", "has_more", "next_cursor")


@query
def event_search_next_page(spark, sf_dir):
    found = search.search_events(telemetry(spark, sf_dir), **_window(), limit=100, cursor=(1_705_500_000_000, "8"))
    return found.select("event_uid", "time_ms", "has_more", "next_cursor")


@query
def event_search_matches(spark, sf_dir):
    """Everything one set of filters selects: an address, an account, a host."""
    t = telemetry(spark, sf_dir)
    tests = {
        "by_ip": search.event_filter(**_window(), ip="198.51.100.7"),
        "by_user": search.event_filter(**_window(), user_name="USER12"),
        "by_host": search.event_filter(**_window(), hostname="ws-3.CORP.example"),
        "by_text": search.event_filter(**_window(), text='whoami -user1 | "domain admins"'),
        "by_prefix": search.event_filter(**_window(), text="power*"),
    }
    return t.select(F.explode(F.array_compact(F.array(*[F.when(v, F.lit(k)) for k, v in tests.items()]))).alias("test"), c("sx.event_uid").alias("event_uid"))


@query
def event_search_total(spark, sf_dir):
    return search.count_events(telemetry(spark, sf_dir), **_window(), class_uids=(3002,))


@query
def event_lookup(spark, sf_dir):
    uid = hashlib.sha256(b"ev42").hexdigest()
    return search.get_event(telemetry(spark, sf_dir), ORG, uid).select(c("sx.event_uid").alias("event_uid"), "time_ms", "class_uid")


@query
def finding_search_page(spark, sf_dir):
    found = _single(spark, sf_dir)
    page = search.search_findings(found, org_id=ORG, severity_min=3, technique="T1059.001", from_ms=1_704_500_000_000, limit=60)
    return page.select("finding_id", "last_ms", "has_more", "next_cursor")


def _order_incidents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders read as incidents: many rows with status, severity and times."""
    o = _table(spark, sf_dir, "orders")
    return o.select(
        F.lpad(c("o_orderkey").cast("string"), 12, "0").alias("incident_id"),
        F.concat(F.lit("org-"), c("o_custkey") % 4).alias("org_id"),
        F.when(c("o_orderstatus") == "F", "closed").when(c("o_orderstatus") == "P", "investigating").otherwise("new").alias("status"),
        F.substring("o_orderpriority", 1, 1).cast("int").alias("severity_id"),
        F.unix_millis(c("o_orderdate").cast("timestamp")).alias("last_ms"),
        (c("o_custkey") % 17).alias("event_count"),
        (c("o_orderkey") % 5 + 1).cast("int").alias("version"),
        F.when(c("o_orderstatus") == "F", F.lit("true_positive")).alias("resolution"),
    )


@query
def incident_search_page(spark, sf_dir):
    page = search.search_incidents(_order_incidents(spark, sf_dir), org_id="org-2", status="new", severity_min=3, limit=100)
    return page.select("incident_id", "last_ms", "severity_id", "has_more", "next_cursor")


@query
def attention_list(spark, sf_dir):
    return triage.needs_attention(_order_incidents(spark, sf_dir)).select("incident_id", "severity_id", "last_ms")


@query
def triage_totals(spark, sf_dir):
    return triage.triage_summary(_order_incidents(spark, sf_dir))


@query
def status_changes(spark, sf_dir):
    """A requested change per order, checked against the incident it names."""
    o = _table(spark, sf_dir, "orders")
    asked = o.select(
        c("o_orderkey").alias("request_id"),
        F.lpad((c("o_orderkey") + F.when(c("o_orderkey") % 50 == 0, 10_000_000).otherwise(0)).cast("string"), 12, "0").alias("incident_id"),
        F.element_at(F.array(F.lit("new"), F.lit("investigating"), F.lit("closed")), (c("o_custkey") % 3 + 1).cast("int")).alias("status"),
        F.when(c("o_custkey") % 6 < 3, F.lit("true_positive")).alias("resolution"),
        (c("o_custkey") % 5 + 1).cast("int").alias("version"),
    )
    checked = triage.check_status_changes(asked, _order_incidents(spark, sf_dir))
    return checked.groupBy("accepted", "refusal").agg(F.count("*").alias("n"), F.sum("new_version").cast("long").alias("versions"))


@query
def latest_analyses(spark, sf_dir):
    o = _table(spark, sf_dir, "orders").select(
        (c("o_custkey") % 40).cast("string").alias("incident_id"),
        c("o_orderkey").alias("analysis_id"),
        F.unix_millis(c("o_orderdate").cast("timestamp")).alias("created_ms"),
    )
    return triage.latest_analyses(o).select("incident_id", "analysis_id", c("rank").cast("long").alias("rank"))


@query
def checked_notes(spark, sf_dir):
    d = _table(spark, sf_dir, "documents").select("doc_id", F.when(c("doc_id") % 20 == 0, F.lit(" \n ")).otherwise(c("text")).alias("body"))
    return audit.check_notes(d).select("doc_id", c("length").cast("long").alias("length"), "sha256", "refusal")


# ------------------------------------------------------------------------------------------------- rule catalogue
@per_session
def _catalogue(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A rule catalogue as large as the documents table."""
    d = _table(spark, sf_dir, "documents")
    first = F.concat(F.lit("T10"), F.lpad((c("doc_id") % 40).cast("string"), 2, "0"))
    sub = F.concat(F.lit("T10"), F.lpad((c("doc_id") % 25).cast("string"), 2, "0"), F.lit(".00"), (c("doc_id") % 3).cast("string"))
    tactic = F.element_at(F.array(F.lit("execution"), F.lit("discovery"), F.lit("impact")), (c("doc_id") % 3 + 1).cast("int"))
    return d.select(
        c("doc_id").cast("string").alias("rule_id"),
        F.concat(c("lang"), F.lit(" rule "), c("doc_id").cast("string")).alias("title"),
        F.when(c("doc_id") % 4 == 0, F.lit("community/x")).otherwise(F.lit("single/x")).alias("path"),
        F.when(c("doc_id") % 11 == 0, F.array().cast("array<string>")).otherwise(F.array(first, sub)).alias("techniques"),
        F.array(tactic).alias("tactics"),
        F.when(c("doc_id") % 5 != 0, c("source")).alias("logsource"),
    )


@query
def technique_coverage(spark, sf_dir):
    return triage.technique_coverage(_catalogue(spark, sf_dir)).select("technique_id", "rules", "own", "community", _csv("titles").alias("titles"))


@query
def coverage_layer(spark, sf_dir):
    rules = _catalogue(spark, sf_dir)
    layer = reports.coverage_layer(
        triage.technique_coverage(rules), triage.coverage_totals(rules), F.timestamp_millis(F.lit(NOW_MS))
    )
    return layer.select(
        F.get_json_object("value", "$.name").alias("name"),
        F.get_json_object("value", "$.gradient.maxValue").cast("long").alias("top"),
        F.get_json_object("value", "$.techniques[0].techniqueID").alias("first_technique"),
        F.get_json_object("value", "$.techniques[0].comment").alias("first_comment"),
        F.get_json_object("value", "$.description").alias("description"),
    )


@query
def tactic_coverage(spark, sf_dir):
    return triage.tactic_coverage(_catalogue(spark, sf_dir))


@query
def coverage_totals(spark, sf_dir):
    return triage.coverage_totals(_catalogue(spark, sf_dir))


@query
def rules_for_technique(spark, sf_dir):
    return _catalogue(spark, sf_dir).filter(search.rule_filter(technique="T1007", logsource="SRC1")).select("rule_id", "title")


@query
def rule_page(spark, sf_dir):
    return search.rule_page(_catalogue(spark, sf_dir), limit=40, after="17").select("rule_id", "title", "total", "has_more", "next_cursor")


# -------------------------------------------------------------------------------------------------------- audit
def _audit_entries(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = _table(spark, sf_dir, "orders")
    none = F.lit(None).cast("string")
    return o.select(
        F.concat(F.lit("org-"), c("o_custkey") % 6).alias("org_id"),
        c("o_orderkey").alias("position"),
        c("o_orderdate").cast("timestamp").alias("ts"),
        c("o_custkey").cast("string").alias("actor_id"),
        F.lit("user").alias("actor_type"),
        F.concat(F.lit("order."), F.lower("o_orderstatus")).alias("action"),
        F.lit("order").alias("resource_type"),
        c("o_orderkey").cast("string").alias("resource_id"),
        none.alias("before"),
        F.concat(F.lit('{"priority":"'), c("o_orderpriority"), F.lit('"}')).alias("after"),
        none.alias("context"),
        none.alias("correlation_id"),
    )


def _audit_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    return audit.append_entries(_audit_entries(spark, sf_dir))


@query
def audit_chain(spark, sf_dir):
    return _audit_log(spark, sf_dir).select("org_id", "chain_index", "resource_id", "entry_hash")


@query
def audit_verification(spark, sf_dir):
    """The chain with one organisation's entry edited, one's deleted, one's relinked."""
    log = _audit_log(spark, sf_dir)
    edited = F.when((c("org_id") == "org-1") & (c("chain_index") == 7), F.lit("order.x")).otherwise(c("action"))
    relinked = F.when((c("org_id") == "org-3") & (c("chain_index") == 9), F.lit("f" * 64)).otherwise(c("prev_hash"))
    deleted = (c("org_id") == "org-2") & (c("chain_index") == 11)
    return audit.verify_chain(log.withColumns({"action": edited, "prev_hash": relinked}).filter(~deleted))


@query
def audit_page(spark, sf_dir):
    page = search.search_audit(_audit_log(spark, sf_dir), org_id="org-4", action="order.f", before_index=1_000, limit=50)
    return page.select("chain_index", "resource_id", "has_more", "next_cursor")


@query
def audited_organisations(spark, sf_dir):
    return audit.audited_orgs(_audit_entries(spark, sf_dir))


# --------------------------------------------------------------------------------------- grounding and evaluation
def _statements(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Conversation turns read as statements about log sources, citing telemetry by id."""
    t = _table(spark, sf_dir, "conversations")
    key = c("conv_id") * 10 + c("turn")

    def uid(number: Column) -> Column:
        return F.sha2(F.concat(F.lit("ev"), number), 256)

    return t.select(
        c("conv_id").alias("analysis_id"),
        F.lit(ORG).alias("incident_id"),
        c("turn").alias("position"),
        F.element_at(F.array(F.lit("fact"), F.lit("INFERENCE"), F.lit("UNCERTAINTY"), F.lit("GUESS")), (key % 4 + 1).cast("int")).alias("kind"),
        F.when(key % 17 == 0, F.lit(" ")).otherwise(F.concat(c("text"), F.when(key % 6 == 0, F.concat(F.lit(" from 198.51.100."), key % 20)).otherwise(""))).alias("text"),
        F.when(key % 5 == 0, F.array().cast("array<string>")).when(key % 7 == 0, F.array(uid(key), F.lit("made up"))).otherwise(F.array(uid(key % 300), uid(key % 300))).alias("evidence"),
        F.when(key % 3 == 0, F.lit("because")).alias("reasoning"),
        F.when(key % 2 == 0, F.lit("more logs")).alias("missing"),
    )


@per_session
def _grounded(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = flat_telemetry(spark, sf_dir)
    known_events = t.select(F.lit(ORG).alias("incident_id"), "event_uid")
    known_values = t.select(F.lit(ORG).alias("incident_id"), F.explode(F.array("src_ip", "dst_ip")).alias("value")).filter("value is not null")
    return grounding.ground_statements(_statements(spark, sf_dir), known_events, known_values)


@query
def answer_statements(spark, sf_dir):
    """Statements read from answers: bare, behind a think block and in a fence, within prose, too many, and none."""
    t = flat_telemetry(spark, sf_dir).select("event_id", "k")
    one = lambda text: F.struct(F.lit("FACT").alias("kind"), text.alias("text"), F.array(F.lit("e1"), text).alias("evidence"))
    name = F.concat(F.lit("f"), c("event_id").cast("string"))
    facts = F.to_json(F.struct(F.array(one(name)).alias("facts"), F.array(one(F.concat(name, F.lit("?")))).alias("uncertainties")))
    many = F.to_json(F.struct(F.transform(F.sequence(F.lit(1), F.lit(45)), lambda n: one(F.concat(name, F.lit("-"), n.cast("string")))).alias("statements")))
    raw = (
        F.when(c("k") % 5 == 0, facts)
        .when(c("k") % 5 == 1, F.concat(F.lit('<think>not {"facts":[]} this</think>\n```json\n'), facts, F.lit("\n```")))
        .when(c("k") % 5 == 2, F.concat(F.lit("Here it is: "), facts, F.lit(" as asked.")))
        .when(c("k") % 5 == 3, F.lit("I cannot { say"))
        .otherwise(many)
    )
    answers = t.select(c("event_id").alias("analysis_id"), F.lit("i").alias("incident_id"), raw.alias("raw"))
    stated = grounding.answer_statements(grounding.parse_answers(answers))
    return stated.select("analysis_id", "position", "kind", "text", _csv("evidence").alias("evidence"))


@query
def grounded_statements(spark, sf_dir):
    return _grounded(spark, sf_dir).select("analysis_id", "position", "kind", F.size("evidence").cast("long").alias("events"), "citations", "citations_valid", "reason")


@query
def validation_totals(spark, sf_dir):
    totals = grounding.validation_totals(_grounded(spark, sf_dir))
    return totals.select("analysis_id", "statements_returned", "statements_kept", "dropped", c("citations_total").cast("long").alias("citations_total"), c("citations_valid").cast("long").alias("citations_valid"))


@query
def merged_techniques(spark, sf_dir):
    t = _table(spark, sf_dir, "conversations")
    asked = t.select(
        c("conv_id").alias("analysis_id"),
        c("turn").alias("position"),
        F.concat(F.lit("t10"), F.lpad((c("turn") % 3).cast("string"), 2, "0"), F.when(c("turn") % 2 == 0, F.lit(".001")).otherwise("")).alias("technique_id"),
        F.array((c("turn") % 2).cast("string"), c("turn").cast("string")).alias("evidence"),
        F.when(c("turn") == 0, F.lit("fact")).otherwise(F.lit("inference")).alias("kind"),
    )
    return grounding.merge_techniques(asked).select("analysis_id", "technique_id", _csv("evidence").alias("evidence"), "kind")


@query
def attribution_checks(spark, sf_dir):
    """Sentences written from telemetry, checked against the entity graph of their log source."""
    t = flat_telemetry(spark, sf_dir)
    host = scalars.normalise_host(c("device_hostname"))
    sentence = (
        F.when(c("class_uid") == 1007, F.concat(c("parent_name"), F.lit(" spawned "), c("process_name"), F.lit(".")))
        .when(c("class_uid") == 4001, F.concat(F.lit("Then "), host, F.lit(" connected to "), F.when(c("k") % 3 == 0, F.lit("192.0.2.9")).otherwise(c("dst_ip"))))
        .when(c("class_uid") == 4003, F.concat(c("query_hostname"), F.lit(" was queried by "), host))
        .otherwise(F.concat(c("src_ip"), F.lit(" logged on to "), host, F.lit(" as someone")))
    )
    statements = t.select(c("event_uid").alias("statement_id"), c("source_id").alias("incident_id"), sentence.alias("text"))
    digests = entities.digest(telemetry(spark, sf_dir), incident_id=c("sx.source_id"))
    edges = cut_lineage(graph.event_relations(digests, ["incident_id"]).select("incident_id", "source", "relation", "target").distinct())
    names = edges.select("incident_id", F.explode(F.array("source", "target")).alias("entity_key")).distinct()
    claims = grounding.attribution_claims(statements, names, edges)
    return claims.groupBy("verb", "supported").agg(F.count("*").alias("claims"))


def _recordings(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Three labelled recordings (one per log source) with their findings and the lab's own events."""
    events = telemetry(spark, sf_dir)
    labels = events.select(c("sx.source_id").alias("recording")).distinct().withColumns(
        {
            "technique": F.when(c("recording") == "src-0", "T1059").when(c("recording") == "src-1", "T1033").otherwise("T1105"),
            "purpose": F.when(c("recording") == "src-2", "claims").otherwise("priority"),
        }
    )
    found = _single(spark, sf_dir)
    source = events.select(c("sx.event_uid").alias("_uid"), c("sx.source_id").alias("recording"))
    placed = found.withColumn("_uid", F.get("evidence", F.lit(0))).join(source, "_uid").drop("_uid")
    lab = flat_telemetry(spark, sf_dir).filter(c("k") % 8 == 0).select("event_uid")
    return labels, placed, lab


@query
def detection_scorecard(spark, sf_dir):
    labels, found, lab = _recordings(spark, sf_dir)
    parsed = _security(spark, sf_dir).select(c("source_id").alias("recording"), c("problem.kind").alias("kind"), c("problem.reason").alias("reason"))
    card = evaluate.scorecard(labels, parsed, evaluate.judge_findings(found, labels, lab))
    return card.select("recording", "technique", "events", "accepted", "unsupported", "rejected", "matching", "harness", "other", "detected")


@query
def detection_set_scores(spark, sf_dir):
    labels, found, lab = _recordings(spark, sf_dir)
    parsed = flat_telemetry(spark, sf_dir).select(c("source_id").alias("recording"), F.lit(None).cast("string").alias("kind"))
    return evaluate.set_scores(evaluate.scorecard(labels, parsed, evaluate.judge_findings(found, labels, lab)))


@query
def common_reject_reasons(spark, sf_dir):
    parsed = _ocsf(spark, sf_dir).select(c("source_id").alias("recording"), c("problem.kind").alias("kind"), c("problem.reason").alias("reason"))
    return evaluate.most_common_reasons(parsed, 3).select("recording", "kind", "reason", "n", c("rank").cast("long").alias("rank"))


@query
def answer_scores(spark, sf_dir):
    grounded = _grounded(spark, sf_dir)
    t = _table(spark, sf_dir, "conversations")
    key = c("conv_id") * 10 + c("turn")
    events = t.select(c("conv_id").alias("analysis_id"), (c("turn") % 3).cast("string").alias("label"), F.sha2(F.concat(F.lit("ev"), key % 300), 256).alias("event_uid")).distinct()
    technique = F.concat(F.lit("T100"), (c("turn") % 4).cast("string"))
    suggested = t.select(c("conv_id").alias("analysis_id"), F.concat(technique, F.lit(".001")).alias("technique_id"))
    expected = t.select(c("conv_id").alias("analysis_id"), F.concat(F.lit("T100"), (c("conv_id") % 4).cast("string")).alias("technique_id"))
    return evaluate.score_answers(grounded, suggested, events, expected).select(
        "analysis_id", "statements", "dropped", "key_found", "key_events", "techniques_right", "techniques_suggested", "techniques_expected"
    )
