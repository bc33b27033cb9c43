"""WARC archives: written by Spark's text writer, read back by boundary chains."""

from __future__ import annotations

import base64
import hashlib
import re
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from casewright.llm.common import rekeyed, whole, written
from casewright.session import cut_lineage

VERSION = "WARC/1.1\r\n"
RECORD_END = "\r\n\r\n"
MAGIC = RECORD_END + VERSION  # what stands before every record but the first; payloads may hold it as well
PROFILE = "http://netpreservation.org/warc/1.1/revisit/identical-payload-digest"
ID = "urn:page-id:"
SMALL_TABLE = 100_000  # rows up to which a table of some ten bytes a row is broadcast
LENGTH = re.compile(rb"^content-length:[ \t]*(\d{1,18})[ \t]*\r?$", re.I | re.M)
FIELD = re.compile(rb"^([!-9;-~]+):[ \t]*(.*?)[ \t]*\r?$", re.M)


def base32_sha1(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def _line(name: str, value: Column) -> Column:
    return F.when(value.isNotNull(), F.concat(F.lit(name + ": "), value, F.lit("\r\n"))).otherwise(F.lit(""))


def write_archive(
    pages: DataFrame,
    path: str,
    id_col: str = "page_id",
    url_col: str = "url",
    html_col: str = "html",
    least: int = 0,
    date: str = "2024-01-01T00:00:00Z",
) -> None:
    """One record per page, one archive per task, in the folder ``path``.

    Of pages whose payloads are equal (by SHA-256) and have ``least`` bytes or more, those with the smallest id are
    responses, the others revisits without a block that refer to it. Only digests that repeat are joined to the pages:
    up to ``SMALL_TABLE`` of them are broadcast, and payloads stay where they are read; more are dealt out with them.

    A null payload is empty; a null id gives an empty one and is never the smallest; a null URL gives no target line,
    and white space in a URL is percent-encoded. An empty table gives archives without records.
    """

    @F.pandas_udf("string")
    def base32(hexadecimal: pd.Series) -> pd.Series:
        return hexadecimal.map(lambda h: base64.b32encode(bytes.fromhex(h)).decode())

    payload = whole(html_col)
    rows = pages.select(
        F.col(id_col).alias("_id"), F.col(url_col).alias("_url"), payload.alias("_payload"), F.sha2(payload.cast("binary"), 256).alias("_key")
    )
    repeated = cut_lineage(
        rows.filter(F.octet_length("_payload") >= least)
        .groupBy("_key")
        .agg(F.min("_id").alias("_first"), F.count("*").alias("_n"))
        .filter((F.col("_n") > 1) & F.col("_first").isNotNull())
        .select(rekeyed(F.col("_key")).alias("_key"), "_first")
    )
    revisit = F.col("_first").isNotNull() & ~F.col("_id").eqNullSafe(F.col("_first"))
    block = F.when(revisit, F.lit("")).otherwise(F.col("_payload"))
    name = lambda c: F.concat(F.lit(f"<{ID}"), F.coalesce(c.cast("string"), F.lit("")), F.lit(">"))
    url = F.col("_url")
    for code in (0x20, *range(0x09, 0x0E)):
        url = F.replace(url, F.lit(chr(code)), F.lit(f"%{code:02X}"))
    record = F.concat(
        F.lit(VERSION),
        _line("WARC-Type", F.when(revisit, "revisit").otherwise("response")),
        _line("WARC-Record-ID", name(F.col("_id"))),
        _line("WARC-Date", F.lit(date)),
        _line("WARC-Target-URI", url),
        _line("WARC-Payload-Digest", F.concat(F.lit("sha1:"), "_digest")),
        _line("WARC-Refers-To", F.when(revisit, name(F.col("_first")))),
        _line("WARC-Profile", F.when(revisit, F.lit(PROFILE))),
        _line("Content-Type", F.lit("text/html; charset=utf-8")),
        _line("Content-Length", F.octet_length(block).cast("string")),
        F.lit("\r\n"),
        block,
    )
    few = repeated.count() <= SMALL_TABLE
    joined = rows.join(F.broadcast(repeated) if few else repeated, "_key", "left").withColumn("_digest", base32(F.sha1(F.col("_payload").cast("binary"))))
    joined.select(record.alias("value")).write.option("lineSep", RECORD_END).text(path)


def _segments(spark: SparkSession, path: str) -> DataFrame:
    """Everything between two magics, in the order of each split, with the split that it was read in."""
    lines = spark.read.option("lineSep", MAGIC).text(path)
    return lines.select(
        F.col("value").cast("binary").alias("value"),
        F.col("_metadata.file_path").alias("file"),
        F.col("_metadata.file_block_start").alias("split"),
    )


def _placed(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[str, int, int, int, bytes]]:
    """File, split, and for each segment the offset of its record and of the next, counted from the split's first."""
    own, at = None, 0
    for batch in batches:
        for value, file, split in zip(*(batch.column(n).to_pylist() for n in ("value", "file", "split")), strict=True):
            if (file, split) != own:
                own, at = (file, split), 0
            # the first segment of a file holds its version line, later ones lost theirs to the separator
            bare = value.removeprefix(VERSION.encode()) if split == 0 and at == 0 else value
            end = at + len(VERSION) + len(bare) + len(RECORD_END)
            yield file, split, at, end, bare
            at = end


NAMES = ("file", "split", "at", "end", "successor", "leaves", "record_id", "type", "url", "refers_to", "stated", "bytes", "digest")
KINDS = (pa.string(), *[pa.int64()] * 5, *[pa.string()] * 5, pa.int64(), pa.string())
SCHEMA = (
    "file string, split long, at long, end long, successor long, leaves long, record_id string, type string, "
    "url string, refers_to string, stated string, bytes long, digest string"
)


def _candidate(file: str, split: int, at: int, end: int, bare: bytes) -> dict:
    """A segment as a record: where its successor would start, its fields, and its block's digest if it holds it all."""
    # a block that starts with a version line makes the end of the head look like a magic: no block is left then
    head, _, block = bare.partition(b"\r\n\r\n")
    row: dict = dict.fromkeys(NAMES) | {"file": file, "split": split, "at": at, "end": end}
    if length := LENGTH.search(head):
        size = int(length[1])
        fields = {k.lower(): v.decode("utf-8", "replace") for k, v in FIELD.findall(head)}
        row["successor"] = at + len(VERSION) + len(head) + 4 + size + len(RECORD_END)
        for name, header in (("record_id", b"warc-record-id"), ("type", b"warc-type"), ("url", b"warc-target-uri"), ("refers_to", b"warc-refers-to"), ("stated", b"warc-payload-digest")):
            row[name] = fields.get(header)
        if size <= len(block) and row["successor"] in (end, end - len(RECORD_END)):
            row["bytes"], row["digest"] = size, base32_sha1(block[:size])
    return row


def _candidates(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The candidates of each split; ``leaves`` is where the chain that starts at a candidate leaves the split."""

    def told(rows: list[dict]) -> Iterator[pa.RecordBatch]:
        ways: dict[int, int] = {}
        for row in reversed(rows):
            if row["successor"] is not None:
                row["leaves"] = ways[row["at"]] = ways.get(row["successor"], row["successor"])
        for at in range(0, len(rows), 2000):
            part = rows[at : at + 2000]
            yield pa.RecordBatch.from_arrays([pa.array([r[n] for r in part], k) for n, k in zip(NAMES, KINDS, strict=True)], list(NAMES))

    rows: list[dict] = []
    for file, split, at, end, bare in _placed(batches):
        if rows and (rows[0]["file"], rows[0]["split"]) != (file, split):
            yield from told(rows)
            rows = []
        rows.append(_candidate(file, split, at, end, bare))
    yield from told(rows)


def reachable(candidates: DataFrame) -> DataFrame:
    """``file, off`` of the records at which the chain from each file's start enters a split.

    Pointer jumping over the places where chains leave splits: after n rounds the first 2 ** n splits of each file are
    known, and each pointer spans as many. Only candidates that some chain leads to take part, one a split or so.
    """
    ways = candidates.filter("leaves IS NOT NULL").select("file", "off", F.col("leaves").alias("to"))
    aims = ways.select("file", F.col("to").alias("off")).distinct()
    entered = ways.join(aims.withColumn("aimed", F.lit(True)), ["file", "off"], "left").filter("aimed OR off = 0")
    jumps = cut_lineage(entered.select("file", "off", "to"))
    known = jumps.filter("off = 0").select("file", "off")
    starts = jumps.select("file", F.col("off").alias("to"))
    jumps = jumps.join(starts, ["file", "to"], "left_semi").select("file", "off", "to")
    count = known.count()
    while True:
        further = known.join(jumps, ["file", "off"]).select("file", F.col("to").alias("off"))
        known = cut_lineage(known.unionByName(further))
        before, count = count, known.count()
        if count == before:
            return known
        after = jumps.select("file", F.col("off").alias("to"), F.col("to").alias("then"))
        jumps = cut_lineage(jumps.join(after, ["file", "to"]).select("file", "off", F.col("then").alias("to")))


def _walked(part: pd.DataFrame) -> pd.DataFrame:
    """Marks the records of one split: those on the chain from the entry."""
    following = dict(zip(part["off"], part["successor"], strict=True))
    real, at = set(), part["entry"].iloc[0]
    while at in following and not pd.isna(following[at]):
        real.add(at)
        at = following[at]
    return part.assign(real=part["off"].isin(real)).drop(columns="entry")


def read_archive(spark: SparkSession, path: str) -> DataFrame:
    """``file, off, record_id, type, url, refers_to, stated, bytes, digest`` of every record under ``path``.

    The reader cuts archives at the magic, so splits of one archive are read in parallel and a payload that holds the
    magic comes in several segments. Each task says where its segments lie and where the record that each seems to be
    would end, and where the chain from there leaves the split; the places of splits follow from their lengths. Only
    segments that the chain from the file's start reaches are records, the others are payload. Payloads in several segments are read again and put together, the
    only ones that move. A chain ends at a record without a length; an empty folder has no records. ``bytes`` and
    ``digest`` are those of the block as read, ``stated`` is what the record says.
    """
    found = written(_segments(spark, path).mapInArrow(_candidates, SCHEMA), "candidates")
    lengths = found.groupBy("file", "split").agg(F.max("end").alias("length"))
    before = Window.partitionBy("file").orderBy("split").rowsBetween(Window.unboundedPreceding, -1)
    bases = cut_lineage(lengths.select("file", "split", F.coalesce(F.sum("length").over(before), F.lit(0)).alias("base")))
    placed = found.join(F.broadcast(bases) if bases.count() <= SMALL_TABLE else bases, ["file", "split"])
    shifted = {n: F.col(n) + F.col("base") for n in ("end", "successor", "leaves")}
    candidates = placed.withColumns({"off": F.col("at") + F.col("base"), **shifted}).drop("base")

    entries = candidates.join(reachable(candidates), ["file", "off"], "left_semi").select("file", "split", F.col("off").alias("entry"))
    whole_splits = candidates.join(entries, ["file", "split"], "left")
    walked = whole_splits.groupBy("file", "split").applyInPandas(_walked, f"{SCHEMA}, off long, real boolean")
    marked = written(walked, "records")
    shown = ["file", "off", "record_id", "type", "url", "refers_to", "stated", "bytes", "digest"]
    complete = marked.filter("real AND digest IS NOT NULL").select(shown)
    broken = marked.filter("NOT real OR digest IS NULL")
    if broken.isEmpty():
        return complete
    # segments between two records belong to the record before them
    last = F.last(F.when(F.col("real"), F.col("off")), ignorenulls=True)
    owned = broken.withColumn("owner", last.over(Window.partitionBy("file").orderBy("off").rowsBetween(Window.unboundedPreceding, 0)))
    wanted = owned.filter("owner IS NOT NULL").select("file", "split", "at", "off", "owner")

    def raw(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for file, split, at, _, bare in _placed(batches):
            yield pa.RecordBatch.from_arrays([pa.array([x]) for x in (file, split, at, bare)], ["file", "split", "at", "bare"])

    again = _segments(spark, path).mapInArrow(raw, "file string, split long, at long, bare binary")
    parts = again.join(wanted, ["file", "split", "at"]).groupBy("file", "owner").agg(
        F.sort_array(F.collect_list(F.struct("off", "bare"))).alias("parts")
    )

    @F.pandas_udf("bytes long, digest string")
    def joined(bare: pd.Series) -> pd.DataFrame:
        """Of the block: the segments of one record with the magic between them, cut at the record's length."""
        rows = []
        for segments in bare:
            head, _, block = MAGIC.encode().join(bytes(s) for s in segments).partition(b"\r\n\r\n")
            block = block[: int(LENGTH.search(head)[1])]
            rows.append((len(block), base32_sha1(block)))
        return pd.DataFrame(rows, columns=["bytes", "digest"])

    whole_ones = parts.select("file", F.col("owner").alias("off"), joined(F.col("parts.bare")).alias("b"))
    repaired = marked.filter("real AND digest IS NULL").drop("bytes", "digest").join(whole_ones, ["file", "off"])
    return complete.unionByName(repaired.withColumns({"bytes": F.col("b.bytes"), "digest": F.col("b.digest")}).select(shown))


def page_records(records: DataFrame, id_type: str = "bigint") -> DataFrame:
    """``page_id, payload_bytes, payload_digest, record_type, refers_to`` of the records; revisits have their response's bytes."""
    page = lambda c: F.expr(f"try_cast(substring_index(substring_index({c}, '{ID}', -1), '>', 1) AS {id_type})")
    rows = records.select(
        page("record_id").alias("page_id"),
        "bytes",
        "digest",
        F.col("type").alias("record_type"),
        page("refers_to").alias("refers_to"),
        F.regexp_replace("stated", "^sha1:", "").alias("stated"),
    )
    responses = rows.filter("record_type = 'response'")
    own = responses.select("page_id", F.col("bytes").alias("payload_bytes"), F.col("digest").alias("payload_digest"), "record_type", F.lit(None).cast(id_type).alias("refers_to"))
    first = responses.groupBy(F.col("page_id").alias("refers_to"), F.col("digest").alias("stated")).agg(F.first("bytes").alias("payload_bytes"))
    first = first.select("refers_to", rekeyed(F.col("stated")).alias("stated"), "payload_bytes")
    others = rows.filter("record_type = 'revisit'").join(first, ["refers_to", "stated"], "left")
    return own.unionByName(
        others.select("page_id", "payload_bytes", F.col("stated").alias("payload_digest"), "record_type", "refers_to")
    )
