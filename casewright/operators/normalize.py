"""Raw records to validated OCSF events, with the rejects kept beside them."""

from __future__ import annotations

from functools import reduce
from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from casewright import schema as S
from casewright.functions import ids, scalars
from casewright.operators.parsers import PARSERS
from casewright.operators.parsers.common import INVALID

MAX_OBSERVABLES = 100
# Columns that travel with a record from source to event.
ENVELOPE = ("org_id", "source_id", "position", "raw")


class Normalized(NamedTuple):
    events: DataFrame
    rejects: DataFrame


def _capped(column: Column, limit: int, label: str) -> tuple[Column, str]:
    return F.length(column) > limit, f"{label}: at most {limit} characters"


class _Fields:
    """``event["x"]`` reads column ``x``: flat columns keep Catalyst from copying a whole struct per use."""

    def __getitem__(self, name: str) -> Column:
        return F.col(name)


def validation_reason(now: Column) -> Column:
    """The first rule an event row breaks, null for a valid event."""
    event = _Fields()
    class_uid, activity = event["class_uid"], event["activity_id"]
    category = category_of(class_uid)
    allowed = F.create_map(
        *[
            part
            for uid, names in S.ACTIVITY_NAMES.items()
            for part in (F.lit(uid), F.array(*[F.lit(a) for a in (0, 99, *names)]))
        ]
    )
    hashes = F.concat(
        *[
            F.coalesce(event["process"].getField("file").getField("hashes"), _no_hashes()),
            F.coalesce(
                event["process"].getField("parent_process").getField("file").getField("hashes"), _no_hashes()
            ),
            F.coalesce(event["module"].getField("file").getField("hashes"), _no_hashes()),
            F.coalesce(event["file"].getField("hashes"), _no_hashes()),
        ]
    )
    lengths = F.create_map(*[F.lit(x) for pair in scalars.HASH_LENGTHS.items() for x in pair])

    def bad_digest(h: Column) -> Column:
        expected = F.element_at(lengths, h["algorithm_id"])
        return expected.isNotNull() & (
            (F.length(h["value"]) != expected) | ~F.lower(h["value"]).rlike("^[0-9a-f]+$")
        )

    missing_context = F.lit(None).cast("string")
    for uid, names in S.REQUIRED_CONTEXT.items():
        absent = reduce(lambda a, b: a & b, [event[name].isNull() for name in names])
        missing_context = F.when(
            (class_uid == uid) & absent, F.lit(f"{S.CLASS_NAMES[uid]} events require {' or '.join(names)}")
        ).otherwise(missing_context)

    def port_problem(side: str) -> Column:
        port = event[side]["port"]
        return F.when((port < 0) | (port > 65535), F.lit(f"{side}.port: must be between 0 and 65535"))

    caps = [
        F.when(condition, F.lit(message))
        for condition, message in (
            _capped(event["message"], 8192, "message"),
            _capped(event["user"]["name"], 255, "user.name"),
            _capped(event["device"]["hostname"], 255, "device.hostname"),
            _capped(event["src_endpoint"]["hostname"], 255, "src_endpoint.hostname"),
            _capped(event["dst_endpoint"]["hostname"], 255, "dst_endpoint.hostname"),
            _capped(event["process"]["cmd_line"], 4096, "process.cmd_line"),
            _capped(event["process"]["file"]["path"], 4096, "process.file.path"),
            _capped(event["file"]["path"], 4096, "file.path"),
            _capped(event["query"]["hostname"], 255, "query.hostname"),
            _capped(event["raw_data"], S.MAX_RAW_DATA, "raw_data"),
            (F.size(event["answers"]) > 50, "answers: at most 50 items"),
            (F.size(event["privileges"]) > 64, "privileges: at most 64 items"),
            (F.size(event["observables"]) > MAX_OBSERVABLES, "observables: at most 100 items"),
        )
    ]
    return F.coalesce(
        F.when(class_uid.isNull() | ~class_uid.isin(*S.CLASS_NAMES), F.lit("class_uid: not a supported class")),
        F.when(activity.isNull(), F.lit("activity_id: required")),
        F.when(
            event["severity_id"].isNull() | ~event["severity_id"].isin(*S.SEVERITY_NAMES),
            F.lit("severity_id: not a known severity"),
        ),
        F.when(~event["status_id"].isin(*S.STATUS_NAMES), F.lit("status_id: not a known status")),
        F.when(event["time"].isNull(), F.lit("time: must be epoch milliseconds or an RFC 3339 string")),
        F.when(
            event["metadata"]["product"]["name"].isNull(),
            F.lit("metadata.product.name: required"),
        ),
        F.when(
            ~F.coalesce(event["metadata"]["version"], F.lit(S.OCSF_VERSION)).startswith("1."),
            F.lit("metadata.version: only OCSF 1.x events are supported"),
        ),
        port_problem("src_endpoint"),
        port_problem("dst_endpoint"),
        F.when(
            ~event["http_response"]["code"].between(100, 599), F.lit("http_response.code: must be between 100 and 599")
        ),
        *caps,
        F.when(F.exists(hashes, bad_digest), F.lit("hashes: a digest does not have its algorithm's length")),
        F.when(
            F.length(F.to_json(event["unmapped"])) > S.MAX_UNMAPPED,
            F.lit(f"unmapped exceeds {S.MAX_UNMAPPED} characters"),
        ),
        F.when(
            event["category_uid"] != category,
            F.format_string("category_uid %d does not match class_uid %d", event["category_uid"], class_uid),
        ),
        F.when(
            ~F.array_contains(F.element_at(allowed, class_uid), activity),
            F.format_string("activity_id %d is not defined for %s", activity, S.lookup(S.CLASS_NAMES, class_uid)),
        ),
        F.when(
            event["type_uid"] != class_uid.cast("long") * 100 + activity,
            F.format_string("type_uid must be %d", class_uid.cast("long") * 100 + activity),
        ),
        missing_context,
        F.when(event["time"] > now + F.expr("INTERVAL 24 HOURS"), F.lit("time is more than 24 hours in the future")),
    )


def _no_hashes() -> Column:
    return F.array().cast(T.ArrayType(S.HASH))


def category_of(class_uid: Column) -> Column:
    return F.floor((class_uid % 100_000) / 1000).cast("int")


def derive_observables() -> Column:
    """The entities an event row names: distinct by (name, value), in a fixed order, at most 100."""
    event = _Fields()

    def one(name: str, type_id: int, value: Column) -> Column:
        return F.array(
            F.struct(
                F.lit(name).alias("name"),
                F.lit(type_id).alias("type_id"),
                value.alias("value"),
            )
        )

    def many(name: str, values: Column) -> Column:
        listed = F.transform(
            values,
            lambda h: F.struct(
                F.lit(name).alias("name"),
                F.lit(8).alias("type_id"),
                h["value"].alias("value"),
            ),
        )
        return F.coalesce(listed, F.array().cast(S.EVENT["observables"].dataType))

    process, module, file = event["process"], event["module"], event["file"]
    found = F.concat(
        *[
            one(f"{side}.{attribute}", kind, event[side][attribute])
            for side in ("src_endpoint", "dst_endpoint")
            for attribute, kind in (("ip", 2), ("hostname", 1), ("domain", 1))
        ],
        one("device.hostname", 1, event["device"]["hostname"]),
        one("device.ip", 2, event["device"]["ip"]),
        one("user.name", 4, event["user"]["name"]),
        one("actor.user.name", 4, event["actor"]["user"]["name"]),
        one("actor.process.name", 9, event["actor"]["process"]["name"]),
        one("process.name", 9, process["name"]),
        one("process.file.path", 7, process["file"]["path"]),
        many("process.file.hashes.value", process["file"]["hashes"]),
        many("process.parent_process.file.hashes.value", process["parent_process"]["file"]["hashes"]),
        one("module.file.path", 7, module["file"]["path"]),
        many("module.file.hashes.value", module["file"]["hashes"]),
        one("file.path", 7, file["path"]),
        many("file.hashes.value", file["hashes"]),
        one("query.hostname", 1, event["query"]["hostname"]),
        one("http_request.url.url_string", 6, event["http_request"]["url"]["url_string"]),
    )
    stated = F.filter(found, lambda o: o["value"].isNotNull() & (o["value"] != ""))
    return F.slice(F.array_distinct(stated), 1, MAX_OBSERVABLES)


def complete(df: DataFrame) -> DataFrame:
    """Fill in what follows from the rest: category, type, version, lower-case digests, observables."""

    def lowered(hashes: Column) -> Column:
        return F.transform(
            hashes,
            lambda h: F.when(
                h["algorithm_id"].isin(*scalars.HASH_LENGTHS), h.withField("value", F.lower(h["value"]))
            ).otherwise(h),
        )

    def tidy(owner: Column, *path: str) -> Column:
        """``owner`` with the digests of the file at ``path`` in lower case."""
        hashes = owner.getField("hashes") if not path else reduce(lambda c, p: c[p], path, owner)["hashes"]
        target = ".".join((*path, "hashes"))
        return F.when(hashes.isNotNull(), owner.withField(target, lowered(hashes))).otherwise(owner)

    filled = df.withColumns(
        {
            "category_uid": category_of(F.col("class_uid")),
            "type_uid": F.col("class_uid").cast("long") * 100 + F.col("activity_id"),
            "metadata": F.col("metadata").withField(
                "version", F.coalesce(F.col("metadata.version"), F.lit(S.OCSF_VERSION))
            ),
            "process": tidy(F.col("process"), "file"),
            "file": tidy(F.col("file")),
            "module": tidy(F.col("module"), "file"),
        }
    ).withColumn("process", tidy(F.col("process"), "parent_process", "file"))
    given = F.col("observables")
    return filled.withColumn("observables", F.when(F.size(given) > 0, given).otherwise(derive_observables()))


def canonical_json() -> Column:
    """An event row as JSON in schema order, absent attributes left out and map keys sorted."""
    ordered = F.map_from_entries(F.array_sort(F.map_entries("unmapped")))
    return F.to_json(
        F.struct(*[ordered.alias(f.name) if f.name == "unmapped" else F.col(f.name) for f in S.EVENT.fields])
    )


def fingerprint(org_id: Column, source_id: Column) -> Column:
    """Content identity: the same record delivered twice has the same fingerprint."""
    return ids.digest(org_id, source_id, canonical_json())


def activity_name(class_uid: Column, activity_id: Column) -> Column:
    names = {uid * 1000 + a: name for uid, table in S.ACTIVITY_NAMES.items() for a, name in table.items()}
    known = S.lookup(names, class_uid * 1000 + activity_id)
    return F.when(activity_id == 0, F.lit("Unknown")).otherwise(F.coalesce(known, F.lit("Other")))


def with_captions(df: DataFrame) -> DataFrame:
    """Add the names behind the numbers."""
    return df.withColumns(
        {
            "class_name": S.lookup(S.CLASS_NAMES, F.col("class_uid")),
            "category_name": S.lookup(S.CATEGORY_NAMES, F.col("category_uid")),
            "activity_name": activity_name(F.col("class_uid"), F.col("activity_id")),
            "severity": S.lookup(S.SEVERITY_NAMES, F.col("severity_id")),
            "status": S.lookup(S.STATUS_NAMES, F.col("status_id")),
        }
    )


def stamp_sources(records: DataFrame, sources: DataFrame) -> DataFrame:
    """Attach org and parser to each record; records of a disabled or unknown source are left out.

    ``sources`` is a registry with one row per producer. Spark picks a broadcast when its measured size
    allows one and shuffles otherwise.
    """
    enabled = sources.filter("is_enabled").select("source_id", "org_id", "parser")
    return records.join(enabled, "source_id")


def _parsed_by(records: DataFrame, name: str) -> DataFrame:
    """Records of one parser with ``problem`` and the attributes of the event."""
    parsed = PARSERS[name](records).withColumn("parser", F.lit(name))
    if "raw" not in parsed.columns:
        parsed = parsed.withColumn("raw", F.to_json("record"))
    keep = [c for c in ENVELOPE if c in parsed.columns]
    # inline() makes the mapped attributes columns in their own right. As a plain projection the mapping
    # would be copied into every later check and filter that reads one of them.
    return parsed.select(*keep, "parser", "problem", F.inline(F.array("event")))


def _parsed_by_source(records: DataFrame) -> DataFrame:
    """The same for records that name their parser, read once.

    The parsers follow each other in one projection. Each sees the text of its own records and nothing of the others,
    and its event is mapped for its own records alone, so a row costs one parse.
    """
    rows = records if "raw" in records.columns else records.withColumn("raw", F.to_json("record"))
    envelope = [c for c in ENVELOPE if c in rows.columns and c != "raw"]
    rows = rows.select(*envelope, "parser", F.col("raw").alias("_text"))
    known = F.coalesce(F.col("parser").isin(*PARSERS), F.lit(False))
    reason = F.concat(F.lit("unknown parser "), F.coalesce(F.col("parser"), F.lit("(none)")))
    unknown = F.struct(F.lit("parse_error").alias("kind"), reason.alias("reason"))
    events, problems = [], []
    for place, (name, parse) in enumerate(PARSERS.items()):
        mine = F.col("parser") == name
        done = rows.columns
        parsed = parse(rows.withColumn("raw", F.when(mine, F.col("_text"))))
        event = S.fit(F.col("event"), parsed.schema["event"].dataType, S.EVENT)
        events.append(f"_event_{place}")
        problems.append(f"_problem_{place}")
        rows = parsed.select(*done, F.when(mine, event).alias(events[-1]), F.when(mine, F.col("problem")).alias(problems[-1]))
    return rows.select(
        *envelope,
        F.col("_text").alias("raw"),
        "parser",
        F.when(known, F.coalesce(*problems)).otherwise(unknown).alias("problem"),
        F.inline(F.array(F.coalesce(*events))),
    )


def parse_records(records: DataFrame, parser: str | None = None, now: Column | None = None) -> DataFrame:
    """Records with ``event`` and ``problem``: each row goes to the parser its source names, in one scan."""
    now = F.current_timestamp() if now is None else now
    rows = _parsed_by(records, parser) if parser else _parsed_by_source(records)
    checked = rows.withColumn("_reason", F.when(F.col("problem").isNull(), validation_reason(now)))
    broken = F.when(
        F.col("_reason").isNotNull(), F.struct(F.lit(INVALID).alias("kind"), F.col("_reason").alias("reason"))
    )
    return checked.withColumn("problem", F.coalesce(F.col("problem"), broken)).drop("_reason")


def accepted_events(parsed: DataFrame, ingested_at: Column | None = None) -> DataFrame:
    """The stored form of the rows without a problem."""
    ingested_at = F.current_timestamp() if ingested_at is None else ingested_at
    good = complete(parsed.filter(F.col("problem").isNull()))
    marked = good.withColumn("_fp", fingerprint(F.col("org_id"), F.col("source_id")))
    stored = marked.withColumns(
        {
            "time_ms": F.unix_millis("time"),
            "sx": F.struct(
                F.col("org_id"),
                F.col("source_id"),
                ids.event_uid(F.col("_fp")).alias("event_uid"),
                ingested_at.alias("ingested_at"),
                F.col("_fp").alias("fingerprint"),
            ),
        }
    )
    return with_captions(stored).select(*[f.name for f in S.STORED_EVENT.fields])


def rejects_of(parsed: DataFrame) -> DataFrame:
    """The rows with a problem, with their place in the batch and the reason."""
    return parsed.filter(F.col("problem").isNotNull()).select(
        "org_id", "source_id", "position", "parser", "problem.reason", "problem.kind", "raw"
    )


def normalize(
    records: DataFrame, parser: str | None = None, *, now: Column | None = None, ingested_at: Column | None = None
) -> Normalized:
    """``records(org_id, source_id, position, raw[, record][, parser])`` to events and rejects.

    Both results read one parsed table; persist or write ``parse_records`` first when both are written.
    """
    parsed = parse_records(records, parser, now)
    return Normalized(accepted_events(parsed, ingested_at), rejects_of(parsed))


def redact_raw(df: DataFrame, can_read: bool | Column, column: str = "raw_data") -> DataFrame:
    """Null the raw record for readers without the right to see it."""
    allowed = F.lit(can_read) if isinstance(can_read, bool) else can_read
    return df.withColumn(column, F.when(allowed, F.col(column)))
