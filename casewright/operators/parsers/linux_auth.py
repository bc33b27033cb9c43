"""OpenSSH ``sshd`` lines from syslog or auth.log as OCSF Authentication events."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from casewright import schema as S
from casewright.functions import net, scalars
from casewright.operators.parsers.common import LINE_RECORD, PARSE_ERROR, event, obj, problem, text_map

# --- Fixed values: line formats --------------------------------------------------------------------------------
RFC3339_LINE = r"^(\d{4}-\d{2}-\d{2}T\d{2}:\d{2}:\d{2}(?:\.\d+)?(?:Z|[+-]\d{2}:?\d{2}))\s+(\S+)\s+sshd(?:\[(\d+)\])?:\s+(.+)$"
BSD_LINE = r"^([A-Z][a-z]{2}\s+\d{1,2}\s\d{2}:\d{2}:\d{2})\s+(\S+)\s+sshd(?:\[(\d+)\])?:\s+(.+)$"
ACCEPTED = r"^Accepted (\S+) for (\S+) from (\S+) port (\d+)"
FAILED = r"^Failed (\S+) for (invalid user )?(\S+) from (\S+) port (\d+)"
INVALID_USER = r"^Invalid user (\S+) from (\S+)(?: port (\d+))?"
# ------------------------------------------------------------------------------------------------------------


def _bsd_time(text: Column, now: Column) -> Column:
    """A syslog date has no year: this year, or last year when that would lie more than a day ahead."""
    spaced = F.regexp_replace(text, r"\s+", " ")
    this_year = F.try_to_timestamp(
        F.concat_ws(" ", F.year(now).cast("string"), spaced), F.lit("yyyy MMM d HH:mm:ss")
    )
    last_year = F.try_to_timestamp(
        F.concat_ws(" ", (F.year(now) - 1).cast("string"), spaced), F.lit("yyyy MMM d HH:mm:ss")
    )
    ahead = this_year > now + F.expr("INTERVAL 1 DAY")
    return F.when(F.coalesce(ahead, F.lit(True)), last_year).otherwise(this_year)


def parse(df: DataFrame, now: Column | None = None) -> DataFrame:
    now = F.current_timestamp() if now is None else now
    if "record" not in df.columns:
        df = df.withColumn("record", F.from_json("raw", LINE_RECORD))
    line = F.regexp_replace(F.col("record.message"), r"^\s+|\s+$", "")
    # Three narrow steps, so each regex runs once per line.
    df = df.withColumn("_line", line).withColumn("_rfc", F.col("_line").rlike(RFC3339_LINE))
    df = df.withColumn("_shaped", F.col("_rfc") | F.col("_line").rlike(BSD_LINE))

    def head(group: int) -> Column:
        return F.when(F.col("_rfc"), scalars.matched(F.col("_line"), RFC3339_LINE, group)).otherwise(
            scalars.matched(F.col("_line"), BSD_LINE, group)
        )

    df = df.select("*", head(1).alias("_at"), head(2).alias("_host"), head(3).alias("_pid"), head(4).alias("_msg"))
    message = F.col("_msg")
    accepted, failed, invalid = message.rlike(ACCEPTED), message.rlike(FAILED), message.rlike(INVALID_USER)

    def outcome(in_accepted: int | None, in_failed: int | None, in_invalid: int | None) -> Column:
        def group(pattern: str, index: int | None) -> Column:
            return F.lit(None).cast("string") if index is None else scalars.matched(message, pattern, index)

        return F.when(accepted, group(ACCEPTED, in_accepted)).when(failed, group(FAILED, in_failed)).when(
            invalid, group(INVALID_USER, in_invalid)
        )

    address = outcome(3, 4, 2)
    supplied = F.nullif(F.col("record.timestamp"), F.lit(""))
    at = (
        F.when(F.col("_rfc"), scalars.event_time(F.col("_at")))
        .when(supplied.isNotNull(), scalars.event_time(supplied))
        .otherwise(_bsd_time(F.col("_at"), now))
    )
    host = obj(S.DEVICE, F.lit(True), hostname=F.col("_host"))
    ip = net.as_ip(address)
    mapped = event(
        class_uid=F.lit(S.AUTHENTICATION),
        activity_id=F.lit(1),
        severity_id=F.when(accepted, 1).otherwise(2),
        status_id=F.when(accepted, 1).otherwise(2),
        time=at,
        message=message,
        metadata=obj(
            S.METADATA,
            F.lit(True),
            version=F.lit(S.OCSF_VERSION),
            product=obj(
                S.METADATA["product"].dataType, F.lit(True), name=F.lit("OpenSSH"), vendor_name=F.lit("OpenBSD")
            ),
            log_name=F.lit("auth.log"),
        ),
        user=obj(S.USER, F.lit(True), name=outcome(2, 3, 1)),
        src_endpoint=obj(
            S.ENDPOINT,
            F.lit(True),
            ip=ip,
            hostname=F.when(ip.isNull(), address),
            port=outcome(4, 5, 3).try_cast("int"),
        ),
        dst_endpoint=obj(S.ENDPOINT, F.lit(True), hostname=F.col("_host")),
        device=host,
        auth_protocol=F.lit("SSH"),
        logon_type=F.lit("Network"),
        logon_type_id=F.lit(3),
        unmapped=text_map(
            {
                "auth_method": outcome(1, 1, None),
                "invalid_user": F.when(accepted, F.lit("false"))
                .when(failed, F.when(scalars.matched(message, FAILED, 2).isNotNull(), "true").otherwise("false"))
                .otherwise("true"),
                "pid": F.col("_pid"),
            }
        ),
        raw_data=F.substring(F.col("_line"), 1, S.MAX_RAW_DATA),
    )
    bad = problem(
        (F.coalesce(F.col("_line") == "", F.lit(True)), PARSE_ERROR, "record has no message line"),
        (~F.col("_shaped"), PARSE_ERROR, "not an sshd syslog line"),
        (~(accepted | failed | invalid), PARSE_ERROR, "sshd message is not an authentication outcome"),
    )
    return df.withColumn("event", mapped).withColumn("problem", bad).drop(
        "_line", "_rfc", "_shaped", "_at", "_host", "_pid", "_msg"
    )
