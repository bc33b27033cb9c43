"""Shared pieces of the record parsers.

A parser takes a DataFrame holding a ``record`` struct (and the ``raw`` text it came from) and adds two
columns: ``event``, the OCSF struct, and ``problem``, null or ``struct(kind, reason)`` when the record cannot
be mapped. Bad rows never raise, so they cannot hold up good ones.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from casewright import schema as S
from casewright.functions import scalars

Parser = Callable[[DataFrame], DataFrame]

UNSUPPORTED, PARSE_ERROR, INVALID = "unsupported", "parse_error", "invalid"

WINDOWS_RECORD = T.StructType(
    [
        T.StructField("EventID", T.StringType()),
        T.StructField("EventRecordID", T.StringType()),
        T.StructField("TimeCreated", T.StringType()),
        T.StructField("@timestamp", T.StringType()),
        T.StructField("timestamp", T.StringType()),
        T.StructField("Computer", T.StringType()),
        T.StructField("Channel", T.StringType()),
        T.StructField("EventData", S.TEXT_MAP),
    ]
)
LINE_RECORD = S.record(message="string", timestamp="string")


def obj(schema: T.StructType, present: Column, **parts: Column) -> Column:
    """A struct of ``schema`` with the given parts, null unless ``present``."""
    columns = [
        (parts[f.name] if f.name in parts else F.lit(None)).cast(f.dataType).alias(f.name) for f in schema.fields
    ]
    return F.when(present, F.struct(*columns))


def event(**parts: Column) -> Column:
    return obj(S.EVENT, F.lit(True), **parts)


def problem(*checks: tuple[Column, str, Column | str]) -> Column:
    """The first check that holds, as ``struct(kind, reason)``."""
    result = None
    for condition, kind, reason in checks:
        entry = F.struct(
            F.lit(kind).alias("kind"), (F.lit(reason) if isinstance(reason, str) else reason).alias("reason")
        )
        result = F.when(condition, entry) if result is None else result.when(condition, entry)
    return result


def text_map(entries: dict[str, Column]) -> Column:
    """A text map of the entries that have a value."""
    pairs = F.array(*[F.struct(F.lit(k).alias("k"), v.cast("string").alias("v")) for k, v in entries.items()])
    return F.map_from_entries(F.filter(pairs, lambda p: p["v"].isNotNull()))


def any_present(*columns: Column) -> Column:
    present = columns[0].isNotNull()
    for column in columns[1:]:
        present = present | column.isNotNull()
    return present


def any_of(event_id: Column, *ids: int) -> Column:
    return event_id.isin(*ids)


class WindowsFields:
    """Column access to a Windows record: header attributes and event data."""

    def __init__(self) -> None:
        self.record = F.col("record")
        self.event_id = F.col("_event_id")
        self.computer = scalars.clean(self.record["Computer"])
        self.record_uid = self.record["EventRecordID"]

    def data(self, name: str) -> Column:
        return F.try_element_at(self.record["EventData"], F.lit(name))

    def text(self, name: str) -> Column:
        return scalars.clean(self.data(name))

    def time_text(self, *fallback: Column) -> Column:
        header = [F.nullif(self.record.getField(name), F.lit("")) for name in ("TimeCreated", "@timestamp", "timestamp")]
        return F.coalesce(*header, *[F.nullif(f, F.lit("")) for f in fallback])

    def metadata(self, product: str, log_name: str) -> Column:
        return obj(
            S.METADATA,
            F.lit(True),
            version=F.lit(S.OCSF_VERSION),
            product=obj(
                S.METADATA["product"].dataType, F.lit(True), name=F.lit(product), vendor_name=F.lit("Microsoft")
            ),
            log_name=F.lit(log_name),
            uid=self.record_uid,
        )

    def device(self) -> Column:
        return obj(S.DEVICE, self.computer.isNotNull(), hostname=self.computer)

    def envelope_checks(self, supported: tuple[int, ...], label: str) -> list[tuple[Column, str, Column | str]]:
        return [
            (self.event_id.isNull(), PARSE_ERROR, "record has no numeric EventID"),
            (
                ~self.event_id.isin(*supported),
                UNSUPPORTED,
                F.concat(F.lit(f"unsupported {label} event "), self.event_id.cast("string")),
            ),
            (F.col("malformed_data"), PARSE_ERROR, "EventData must be an object"),
        ]


def raw_text() -> Column:
    return F.substring(F.col("raw"), 1, S.MAX_RAW_DATA)


def windows_record(df: DataFrame) -> DataFrame:
    """Decode the JSON text in ``raw`` into a Windows ``record`` unless a decoder already did."""
    if "record" not in df.columns:
        given = F.get_json_object(F.col("raw"), "$.EventData")
        df = df.withColumn("record", F.from_json("raw", WINDOWS_RECORD)).withColumn(
            "malformed_data", F.coalesce(~given.startswith("{"), F.lit(False))
        )
    if "raw" not in df.columns:
        df = df.withColumn("raw", F.to_json("record"))
    if "malformed_data" not in df.columns:
        df = df.withColumn("malformed_data", F.lit(False))
    return df.withColumn("_event_id", scalars.as_int(F.col("record")["EventID"]))
