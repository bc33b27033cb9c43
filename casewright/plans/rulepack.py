"""A rule directory made of the ``pages`` table: own and community rules, nested, with a manifest and faults."""

from __future__ import annotations

import json
import re
import uuid
from collections.abc import Iterator
from functools import partial

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import SparkSession

from casewright.session import cut_lineage, ensure_checkpoint_dir

PLACES = 6  # kinds of files, by page_id modulo


def _dns(rule_id: str, **detection) -> dict:
    return {
        "id": rule_id,
        "title": f"Rule {rule_id}",
        "level": "low",
        "tags": ["attack.t1071.004"],
        "logsource": {"category": "dns_query"},
        "detection": {"wanted": detection, "condition": "wanted"},
    }


def rule_file(page: int) -> tuple[str, list[dict]]:
    """The path and documents of a page's rule file."""
    kind = page % PLACES
    if kind == 0:
        return f"own/d{page % 5}/r{page}.json", [_dns(f"r{page}", QueryName=f"site{page % 15}.example")]
    if kind == 1:
        return f"community/win/r{page}.json", [_dns(f"r{page}", Nope=1)]
    if kind == 2:  # absent fields are written as '-'
        return f"community/win/sub/r{page}.json", [_dns(f"r{page}", QueryName=f"site{page % 15}.example", Image="-")]
    if kind == 3:  # every other one takes the id of the community rule before it
        return f"own/r{page}.json", [_dns(f"r{page - page // PLACES % 2}", QueryName="-")]
    named = f"base{page}" if kind == 4 else f"gone{page}"
    base = _dns(f"b{page}", **{"QueryName|startswith": "site"}) | {"name": f"base{page}"}
    count = {
        "id": f"c{page}",
        "title": f"Count {page}",
        "level": "medium",
        "correlation": {
            "type": "event_count", "rules": [named], "group-by": ["QueryName"], "timespan": "1h", "condition": {"gte": 3 + page // PLACES % 4},
        },
    }
    return f"community/count/r{page}.json", [base, count]


def _store(root: str) -> tuple[fs.FileSystem, str]:
    """The file system of the folder ``root`` and the folder's path there, for a task."""
    return fs.FileSystem.from_uri(re.sub(r"^file:/(?!/)", "file:///", root))


def _write_files(root: str, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Write each page's rule file; the files that the manifest lists, and where they came from."""
    system, folder = _store(root)
    made = set()
    for batch in batches:
        listed = []
        for page in batch.column("page_id").to_pylist():
            path, documents = rule_file(page)
            parent = f"{folder}/{path}".rpartition("/")[0]
            if parent not in made:
                system.create_dir(parent, recursive=True)
                made.add(parent)
            with system.open_output_stream(f"{folder}/{path}") as out:
                out.write("\n---\n".join(map(json.dumps, documents)).encode())
            if path.startswith("community/win/"):
                listed.append({"name": path.removeprefix("community/"), "origin": f"w/{page}.yml"})
        yield pa.RecordBatch.from_pylist(listed, pa.schema([("name", pa.string()), ("origin", pa.string())]))


def _write_manifest(root: str, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One file, so one task; it is written entry by entry."""
    system, folder = _store(root)
    system.create_dir(f"{folder}/community", recursive=True)
    files = 0
    with system.open_output_stream(f"{folder}/community/MANIFEST.json") as out:
        out.write(b'{"rule_base_url": "https://rules.example/v1/", "files": {')
        for batch in batches:
            for row in batch.to_pylist():
                entry = f"{json.dumps(row['name'])}: {json.dumps(row['origin'])}"
                out.write((f", {entry}" if files else entry).encode())
                files += 1
        out.write(b"}}")
    yield pa.RecordBatch.from_pydict({"files": pa.array([files], pa.int64())})


def write_pack(spark: SparkSession, sf_dir: str) -> str:
    """The directory, written by tasks to the shared folder; its path. Pages without an id have no file."""
    ensure_checkpoint_dir(spark)
    root = f"{spark.sparkContext.getCheckpointDir()}/rules-{uuid.uuid4().hex}"
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id").filter("page_id is not null").distinct()
    origins = cut_lineage(pages.mapInArrow(partial(_write_files, root), "name string, origin string"))
    origins.repartition(1).mapInArrow(partial(_write_manifest, root), "files long").collect()
    return root
