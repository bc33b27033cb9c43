from __future__ import annotations

import random

from pyspark.sql import functions as F
from test_detection import logons, spec

from casewright.operators import baseline, detect
from casewright.streaming import incident_store, jobs
from casewright.streaming.thresholds import detect_threshold_stream


def test_stream_thresholds_equal_batch(spark, tmp_path):
    """Several files in event-time order, one delivered twice."""
    rng = random.Random(11)
    rows = sorted(
        ((f"e{n:04}", rng.randrange(0, 900_000, 100), f"10.0.0.{rng.randint(1, 3)}", f"u{rng.randint(0, 6)}") for n in range(300)),
        key=lambda r: (r[1], r[0]),
    )
    rules = [spec(count_distinct="user.name", threshold=4), spec(id="r2", threshold=6)]
    source, out = str(tmp_path / "in"), str(tmp_path / "out")
    for start in range(0, 300, 100):
        logons(spark, rows[start : start + 100]).coalesce(1).write.mode("append").parquet(source)
    logons(spark, rows[100:200]).coalesce(1).write.mode("append").parquet(source)
    stream = jobs.read_events(spark, source, maxFilesPerTrigger="1")
    found = detect_threshold_stream(stream, rules)
    jobs.start(found, jobs.findings_job(out), str(tmp_path / "cp"), available_now=True).awaitTermination(240)
    batch = detect.detect_threshold(logons(spark, rows), rules)

    def comparable(df):
        return sorted((r.finding_id, r.rule_id, tuple(r.evidence), r.first_ms, r.last_ms) for r in df.collect())

    assert comparable(spark.read.parquet(out)) == comparable(batch)


def test_a_late_event_completes_a_window(spark, tmp_path):
    rows = [(uid, 1_000_000 + at, "10.0.0.1", "u") for uid, at in (("a", 0), ("b", 10_000), ("d", 70_000), ("c", 20_000))]
    source, out = str(tmp_path / "in"), str(tmp_path / "out")
    for part in (rows[:3], rows[3:]):
        logons(spark, part).coalesce(1).write.mode("append").parquet(source)
    stream = jobs.read_events(spark, source, maxFilesPerTrigger="1")
    found = detect_threshold_stream(stream, [spec()])
    jobs.start(found, jobs.findings_job(out), str(tmp_path / "cp"), available_now=True).awaitTermination(240)
    [finding] = spark.read.parquet(out).collect()
    [want] = detect.detect_threshold(logons(spark, rows), [spec()]).collect()
    assert (finding.finding_id, finding.last_ms, finding.evidence) == (want.finding_id, 1_020_000, ["a", "b", "c"])


def test_threshold_state_is_bounded(spark, tmp_path):
    """Over many windows, with files sent twice; the state holds two windows."""
    rng = random.Random(5)
    rows = [(f"e{n:04}", n * 4_000 + rng.randrange(0, 3_000, 100), f"10.0.0.{n % 2 + 1}", f"u{rng.randint(0, 9)}") for n in range(600)]
    rules = [spec(count_distinct="user.name", threshold=6), spec(id="r2", threshold=9)]
    source, out = str(tmp_path / "in"), str(tmp_path / "out")
    for start in range(0, 600, 100):
        logons(spark, rows[start : start + 100]).coalesce(1).write.mode("append").parquet(source)
        if start % 200:
            logons(spark, rows[start : start + 100]).coalesce(1).write.mode("append").parquet(source)
    stream = jobs.read_events(spark, source, maxFilesPerTrigger="1")
    query = jobs.start(detect_threshold_stream(stream, rules), jobs.findings_job(out), str(tmp_path / "cp"), available_now=True)
    query.awaitTermination(400)
    batch = detect.detect_threshold(logons(spark, rows), rules)
    shown = lambda df: sorted((r.finding_id, r.rule_id, tuple(r.evidence), r.first_ms, r.last_ms) for r in df.collect())
    assert shown(spark.read.parquet(out)) == shown(batch) and batch.count() > 20
    state = query.lastProgress["stateOperators"][0]["numRowsTotal"]
    # two rules and two groups, nine buckets and their totals, the group's own row and its timer
    assert state <= 4 * (2 * 10 + 4), "600 events were seen"


def test_ingest_baseline_and_correlation_in_batches(spark, tmp_path, story_events, story_incidents, rule_set):
    """One file per story, then all of them again: the incidents equal the batch's."""
    source, state = str(tmp_path / "in"), str(tmp_path / "state")
    single = rule_set.rules
    ordered = story_events.orderBy("time_ms")
    early = ordered.filter(F.col("metadata.log_name") == "auth.log")
    late = ordered.filter(F.coalesce(F.col("metadata.log_name") != "auth.log", F.lit(True)))
    run = jobs.correlation_job(lambda events: detect.detect(events, list(single)), str(tmp_path / "events"), state)
    observe = jobs.baseline_job(str(tmp_path / "baselines"))
    from casewright.sources import sinks

    for number, part in enumerate((early, late, story_events)):
        if number < 2:
            observe(part, number)
        run(part, number)
        sinks.store_events(part, str(tmp_path / "events"))
    run(story_events, 2)  # the last batch again, as after a crash
    tables = jobs.read_incidents(spark, state, story_events)
    got = {(r.title, r.severity_id, r.finding_count, r.event_count) for r in tables.incidents.collect()}
    want = {(r.title, r.severity_id, r.finding_count, r.event_count) for r in story_incidents.incidents.collect()}
    assert got == want
    assert tables.links.count() == story_incidents.links.count()

    def counted(df):
        return sorted((r.kind, r.key, r.observations, r.first_ms, r.last_ms) for r in df.collect())

    assert counted(jobs.read_baselines(spark, str(tmp_path / "baselines"))) == counted(baseline.observe(story_events))
    assert source


def test_ingest_job_stores_once_and_keeps_rejects(spark, tmp_path):
    from stories import STORY_SSH, raw_records

    sources = spark.createDataFrame(
        [("ssh", "org", True, "linux_auth"), ("off", "org", False, "linux_auth")], "source_id string, org_id string, is_enabled boolean, parser string"
    )
    records = raw_records(spark, STORY_SSH, "ssh").unionByName(raw_records(spark, STORY_SSH, "off")).drop("org_id")
    run = jobs.ingest_job(sources, str(tmp_path / "events"), str(tmp_path / "rejects"))
    for batch_id in (0, 0, 1):
        run(records, batch_id)
    assert spark.read.parquet(str(tmp_path / "events")).count() == 8
    rejects = spark.read.parquet(str(tmp_path / "rejects"))
    assert {(r.batch_id, r.reason) for r in rejects.collect()} == {
        (0, "sshd message is not an authentication outcome"), (1, "sshd message is not an authentication outcome"),
    }


def test_a_batch_that_keeps_failing_is_set_aside(spark, tmp_path):
    tries = []

    def fails(batch, batch_id):
        tries.append(batch_id)
        raise ValueError("no")

    jobs.guarded(fails, str(tmp_path / "dead"), attempts=3)(spark.range(4), 9)
    assert tries == [9, 9, 9]
    aside = spark.read.parquet(str(tmp_path / "dead"))
    assert aside.count() == 4 and aside.first().error == "ValueError: no"


def test_a_batch_reads_only_the_days_it_can_reach(spark, tmp_path):
    """Days apart, an incident that goes on into the next day, a batch sent again, and one that finds nothing."""
    hour, day = 3_600_000, 86_400_000
    start = 1_704_067_200_000  # a midnight

    def attack(at, source):
        return [(f"{source}-{at + n}", at + n * 1000, source, f"u{n}") for n in range(6)]

    batches = [
        attack(start + 23 * hour, "203.0.113.1") + attack(start + hour, "203.0.113.9"),
        attack(start + day + 10 * 60_000, "203.0.113.1"),  # the same incident, past midnight
        attack(start + 3 * day, "203.0.113.2"),
        attack(start + day + hour, "203.0.113.1"),  # late, still within reach of the first incident
        [],
    ]
    rules = [spec(threshold=3, window="1h")]
    state = str(tmp_path / "state")
    run = jobs.correlation_job(lambda events: detect.detect_threshold(events, rules), str(tmp_path / "events"), state)
    for number, rows in enumerate(batches):
        run(logons(spark, rows), number)
        if number == 1:
            run(logons(spark, rows), number)  # again, as after a crash
    assert incident_store.day_folders(spark, f"{state}/links") == ["2024-01-01", "2024-01-04"]
    assert incident_store.day_folders(spark, f"{state}/spans") == ["2024-01-01", "2024-01-02", "2024-01-04"]

    third = incident_store.reachable(spark, state, start + 3 * day, 2)
    assert third is None or third.spans.count() == 0, "no folder of an earlier day is read"
    late = incident_store.reachable(spark, state, start + day + hour, 3)
    read = {part for f in late.links.inputFiles() + late.recorded.inputFiles() for part in f.split("/") if "opened=" in part}
    assert read == {"opened=2024-01-01", "opened=2024-01-04"} and late.spans.count() == 2
    tables = jobs.read_incidents(spark, state, logons(spark, [r for rows in batches for r in rows]))
    held = {r.incident_id: r.entity_value for r in tables.entities.filter("entity_type = 'ip'").collect()}
    spans = sorted((held[r.incident_id], r.first_ms - start, r.last_ms - start) for r in tables.incidents.collect())
    assert [s[0] for s in spans] == ["203.0.113.1", "203.0.113.2", "203.0.113.9"]
    assert spans[0][1] == 23 * hour and spans[0][2] >= day + hour
    assert spark.read.parquet(f"{state}/links").select("link_id").distinct().count() == spark.read.parquet(f"{state}/links").count()
