from __future__ import annotations

import sys
from pathlib import Path

import pytest
from pyspark.sql import SparkSession

ROOT = Path(__file__).resolve().parents[1]
sys.path.insert(0, str(ROOT))


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    session = (
        SparkSession.builder.master("local[8]")
        .config("spark.sql.shuffle.partitions", "4")
        .config("spark.default.parallelism", "4")
        .config("spark.driver.memory", "6g")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.python.sql.dataFrameDebugging.enabled", "false")
        .config("spark.sql.warehouse.dir", str(tmp_path_factory.mktemp("warehouse")))
        .config("spark.checkpoint.dir", str(tmp_path_factory.mktemp("checkpoints")))
        .config(
            "spark.sql.streaming.stateStore.providerClass",
            "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
        )
        .getOrCreate()
    )
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


@pytest.fixture(scope="session")
def rule_set(spark):
    from casewright.operators.rules import load_rules

    return load_rules(spark, str(ROOT / "casewright" / "rules"))


@pytest.fixture(scope="session")
def story_events(spark):
    """Two attack stories and some background, parsed from raw records, written once."""
    from casewright.operators.normalize import accepted_events, parse_records
    from casewright.session import cut_lineage
    from stories import STORY_NETWORK, STORY_SSH, STORY_WINDOWS, raw_records

    parts = [
        (STORY_SSH, "linux_auth"),
        (STORY_WINDOWS, "windows_security"),
        (STORY_NETWORK, "ocsf"),
    ]
    events = None
    for rows, parser in parts:
        part = accepted_events(parse_records(raw_records(spark, rows, parser), parser))
        events = part if events is None else events.unionByName(part)
    return cut_lineage(events)


@pytest.fixture(scope="session")
def story_findings(spark, story_events, rule_set):
    from casewright.operators.detect import detect
    from casewright.session import cut_lineage

    return cut_lineage(detect(story_events, list(rule_set.rules)))


@pytest.fixture(scope="session")
def story_incidents(spark, story_events, story_findings):
    from casewright.operators.correlate import correlate

    return correlate(story_findings, story_events)
