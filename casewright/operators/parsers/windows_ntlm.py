"""NTLM operational log records (event 8004) as OCSF events. The record names no outcome, so status is Unknown."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from casewright import schema as S
from casewright.functions import scalars
from casewright.operators.parsers.common import (
    PARSE_ERROR,
    WindowsFields,
    event,
    obj,
    problem,
    raw_text,
    text_map,
    windows_record,
)

# --- Fixed values ---------------------------------------------------------------------------------------------
LOG_NAME = "Microsoft-Windows-NTLM/Operational"
AUDIT_EVENT = 8004
MESSAGE = "NTLM authentication was audited by the domain controller."
# ------------------------------------------------------------------------------------------------------------


def parse(df: DataFrame) -> DataFrame:
    df = windows_record(df)
    w = WindowsFields()

    def value(raw: Column) -> Column:
        text = scalars.clean(raw)
        return F.when(F.lower(text) != "null", text)

    user, workstation = value(w.data("UserName")), value(w.data("WorkstationName"))
    computer, time_text = value(w.record["Computer"]), w.time_text()
    mapped = event(
        class_uid=F.lit(S.AUTHENTICATION),
        activity_id=F.lit(1),
        status_id=F.lit(0),
        severity_id=F.lit(1),
        time=scalars.event_time(time_text),
        message=F.lit(MESSAGE),
        metadata=w.metadata("Microsoft Windows", LOG_NAME),
        user=obj(S.USER, F.lit(True), name=user, domain=value(w.data("DomainName"))),
        auth_protocol=F.lit("NTLM"),
        auth_protocol_id=F.lit(1),
        device=obj(S.DEVICE, computer.isNotNull(), hostname=computer),
        dst_endpoint=obj(S.ENDPOINT, computer.isNotNull(), hostname=computer),
        src_endpoint=obj(S.ENDPOINT, workstation.isNotNull(), hostname=workstation),
        raw_data=raw_text(),
        unmapped=text_map(
            {
                "event_id": w.event_id,
                "secure_channel_name": value(w.data("SChannelName")),
                "secure_channel_type": value(w.data("SChannelType")),
            }
        ),
    )
    bad = problem(
        *w.envelope_checks((AUDIT_EVENT,), "Windows NTLM"),
        (user.isNull(), PARSE_ERROR, "NTLM event 8004 has no UserName"),
        (time_text.isNull(), PARSE_ERROR, "NTLM event has no TimeCreated"),
    )
    return df.withColumn("event", mapped).withColumn("problem", bad)
