"""The ``events`` table seen as security telemetry: a deterministic view in the stored-event schema.

Everything is derived row by row from ``events``, so its size grows with the table and any operator can be
checked against SQL over the same rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from casewright import schema as S
from casewright.operators.normalize import category_of, with_captions

ORG = "org-1"


def _pick(index: Column, *options: str) -> Column:
    return F.element_at(F.array(*[F.lit(o) for o in options]), index.cast("int") + 1)


def flat_telemetry(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per event with plain columns."""
    events = spark.read.parquet(f"{sf_dir}/events.parquet").select("event_id", "ts", "user_id", "event_type", "props")
    kind, user = F.col("event_type"), F.col("user_id")
    k = F.regexp_extract("props", r'"k": ([0-9]+)', 1).cast("int")
    signup, purchase, view = kind == "signup", kind == "purchase", kind == "view"
    base = events.select("event_id", "ts", "user_id", "event_type", k.alias("k"))
    return base.select(
        "event_id",
        F.lit(ORG).alias("org_id"),
        F.concat(F.lit("src-"), user % 3).alias("source_id"),
        F.sha2(F.concat(F.lit("ev"), F.col("event_id")), 256).alias("event_uid"),
        F.unix_millis(F.col("ts").cast("timestamp")).alias("time_ms"),
        "k",
        F.when(kind.isin("error", "click"), 3002)
        .when(signup, 1007)
        .when(purchase, 4001)
        .when(view, 4003)
        .alias("class_uid"),
        F.when(purchase, 6).otherwise(1).alias("activity_id"),
        F.when(kind == "error", 2).otherwise(1).alias("status_id"),
        F.when(kind == "error", 2).otherwise(1).alias("severity_id"),
        F.concat(F.lit("WS-"), user % 20, F.lit(".corp.example")).alias("device_hostname"),
        F.when(user % 5 == 0, F.concat(F.lit("10.0.0."), user % 50))
        .otherwise(F.concat(F.lit("198.51.100."), user % 12))
        .alias("src_ip"),
        F.when(purchase, F.concat(F.lit("192.0.2."), F.col("k") % 10)).alias("dst_ip"),
        F.when(purchase, F.when(F.col("k") % 2 == 0, 443).otherwise(8080)).alias("dst_port"),
        F.concat(F.lit("user"), user).alias("user_name"),
        F.when(user % 7 != 0, F.lit("CORP")).alias("user_domain"),
        F.when(signup, _pick(F.col("k") % 4, "powershell.exe", "whoami.exe", "net.exe", "notepad.exe")).alias(
            "process_name"
        ),
        F.when(signup, F.when(F.col("k") % 3 == 0, F.lit("WINWORD.EXE")).otherwise(F.lit("explorer.exe"))).alias(
            "parent_name"
        ),
        F.when(
            signup,
            _pick(
                F.col("k") % 4,
                "powershell.exe -enc AAAA",
                "whoami /all",
                'net group "Domain Admins" /domain',
                "notepad.exe a.txt",
            ),
        ).alias("cmd_line"),
        F.when(view, F.concat(F.lit("site"), F.col("k") % 15, F.lit(".example"))).alias("query_hostname"),
    )


def telemetry(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``flat_telemetry`` as stored OCSF events."""
    flat = flat_telemetry(spark, sf_dir)

    def part(kind, present: Column | None = None, **fields: Column) -> Column:
        value = F.struct(
            *[
                (fields[f.name] if f.name in fields else F.lit(None)).cast(f.dataType).alias(f.name)
                for f in kind.fields
            ]
        )
        return value if present is None else F.when(present, value)

    c = F.col
    is_auth, is_process = c("class_uid") == 3002, c("class_uid") == 1007
    user = part(S.USER, name=c("user_name"), domain=c("user_domain"))
    nested = flat.select(
        "event_id",
        "class_uid",
        category_of(c("class_uid")).alias("category_uid"),
        "activity_id",
        (c("class_uid").cast("long") * 100 + c("activity_id")).alias("type_uid"),
        "severity_id",
        "status_id",
        F.timestamp_millis("time_ms").alias("time"),
        "time_ms",
        F.when(is_auth, F.when(c("status_id") == 2, "An account failed to log on.").otherwise("An account was successfully logged on.")).alias("message"),
        part(
            S.METADATA,
            version=F.lit(S.OCSF_VERSION),
            product=part(S.METADATA["product"].dataType, name=F.lit("Telemetry")),
            log_name=F.when(is_auth, F.lit("auth.log")).otherwise(F.lit("sensor")),
        ).alias("metadata"),
        part(S.ACTOR, is_process, user=user).alias("actor"),
        F.when(is_auth, user).alias("user"),
        part(S.DEVICE, hostname=c("device_hostname")).alias("device"),
        part(S.ENDPOINT, is_auth | (c("class_uid") == 4001), ip=c("src_ip")).alias("src_endpoint"),
        part(S.ENDPOINT, c("dst_ip").isNotNull(), ip=c("dst_ip"), port=c("dst_port")).alias("dst_endpoint"),
        part(
            S.PROCESS,
            is_process,
            name=c("process_name"),
            cmd_line=c("cmd_line"),
            file=part(
                S.FILE, path=F.concat(F.lit("C:\\Windows\\System32\\"), c("process_name")), name=c("process_name")
            ),
            parent_process=part(
                S.PARENT_PROCESS,
                name=c("parent_name"),
                file=part(S.FILE, path=F.concat(F.lit("C:\\Program Files\\"), c("parent_name")), name=c("parent_name")),
            ),
        ).alias("process"),
        part(S.QUERY, c("query_hostname").isNotNull(), hostname=c("query_hostname")).alias("query"),
        F.create_map(F.lit("k"), c("k").cast("string")).alias("unmapped"),
        F.concat_ws(" ", F.lit("event"), c("event_id").cast("string"), c("user_name"), c("cmd_line")).alias("raw_data"),
        part(
            S.SX,
            org_id=c("org_id"),
            source_id=c("source_id"),
            event_uid=c("event_uid"),
            ingested_at=F.timestamp_millis(c("time_ms") + 60_000),
            fingerprint=c("event_uid"),
        ).alias("sx"),
    )
    observables = F.filter(
        F.array(
            *[
                F.struct(F.lit(n).alias("name"), F.lit(t).alias("type_id"), v.alias("value"))
                for n, t, v in (
                    ("src_endpoint.ip", 2, c("src_endpoint.ip")),
                    ("dst_endpoint.ip", 2, c("dst_endpoint.ip")),
                    ("device.hostname", 1, c("device.hostname")),
                    ("user.name", 4, c("user.name")),
                    ("actor.user.name", 4, c("actor.user.name")),
                    ("process.name", 9, c("process.name")),
                    ("process.file.path", 7, c("process.file.path")),
                    ("query.hostname", 1, c("query.hostname")),
                )
            ]
        ),
        lambda o: o["value"].isNotNull(),
    )
    full = S.conform(with_captions(nested), S.STORED_EVENT)
    return full.withColumn("observables", observables)
