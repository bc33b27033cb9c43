"""Windows Security log records as OCSF events: logons, logoffs, privileges, Kerberos, NTLM, processes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from casewright import schema as S
from casewright.functions import net, scalars
from casewright.operators.parsers.common import (
    PARSE_ERROR,
    WindowsFields,
    any_of,
    any_present,
    event,
    obj,
    problem,
    raw_text,
    text_map,
    windows_record,
)

# --- Fixed values: event ids, their OCSF activity and message, logon types, NTLM package names --------------------
LOGON, LOGOFF, KERBEROS = (4624, 4625), (4634, 4647), (4768, 4769, 4771)
EXPLICIT_CREDENTIALS, SPECIAL_PRIVILEGES, PROCESS_CREATION, CREDENTIAL_VALIDATION = 4648, 4672, 4688, 4776
ACTIVITY = {4624: 1, 4625: 1, 4634: 2, 4647: 2, 4648: 7, 4672: 1, 4688: 1, 4768: 3, 4769: 4, 4771: 6, 4776: 1}
MESSAGE = {
    4624: "An account was successfully logged on.",
    4625: "An account failed to log on.",
    4634: "An account was logged off.",
    4647: "An account was logged off.",
    4648: "A logon was attempted using explicit credentials.",
    4672: "Special privileges assigned to new logon.",
    4688: "A new process has been created.",
    4768: "A Kerberos authentication ticket (TGT) was requested.",
    4769: "A Kerberos service ticket was requested.",
    4771: "Kerberos pre-authentication failed.",
    4776: "The computer attempted to validate the credentials for an account.",
}
LOGON_TYPES = {
    2: "Interactive",
    3: "Network",
    4: "Batch",
    5: "Service",
    7: "Unlock",
    8: "NetworkCleartext",
    9: "NewCredentials",
    10: "RemoteInteractive",
    11: "CachedInteractive",
}
NTLM_PACKAGES = ("MICROSOFT_AUTHENTICATION_PACKAGE_V1_0", "NTLM", "NtLmSsp")
SUCCESS_CODES = ("0x0", "0x00000000", "0")
# ------------------------------------------------------------------------------------------------------------


def image(path: Column, **more: Column) -> Column:
    """A process known by its image path."""
    name = scalars.windows_name(path)
    return obj(
        S.PROCESS, path.isNotNull(), name=name, file=obj(S.FILE, F.lit(True), path=path, name=name), **more
    )


def parse(df: DataFrame) -> DataFrame:
    df = windows_record(df)
    w = WindowsFields()
    id_ = w.event_id

    def account(prefix: str) -> Column:
        name, domain, sid = (w.text(prefix + part) for part in ("UserName", "DomainName", "UserSid"))
        return obj(S.USER, any_present(name, domain, sid), name=name, domain=domain, uid=sid)

    status = w.text("Status")
    granted = F.lower(F.coalesce(status, F.lit("0x0"))).isin(*SUCCESS_CODES)
    status_id = (
        F.when(any_of(id_, 4624, 4634, 4647, 4688), 1)
        .when(any_of(id_, 4625, 4771), 2)
        .when(any_of(id_, EXPLICIT_CREDENTIALS, SPECIAL_PRIVILEGES), 0)
        .otherwise(F.when(granted, 1).otherwise(2))
    )

    ip, port = net.as_ip(w.data("IpAddress")), F.nullif(scalars.as_int(w.data("IpPort")), F.lit(0))
    workstation = F.when(id_ == CREDENTIAL_VALIDATION, w.text("Workstation")).otherwise(w.text("WorkstationName"))
    has_address = any_of(id_, *LOGON, *KERBEROS, EXPLICIT_CREDENTIALS)
    source = obj(
        S.ENDPOINT,
        F.when(
            has_address,
            any_present(F.when(net.is_ip(F.trim(w.data("IpAddress"))), F.lit(1)), port, workstation),
        )
        .when(id_ == CREDENTIAL_VALIDATION, workstation.isNotNull())
        .otherwise(False),
        ip=F.when(has_address, ip),
        port=F.when(has_address, port),
        hostname=workstation,
    )
    target_host = F.when(id_ == EXPLICIT_CREDENTIALS, w.text("TargetServerName")).when(
        any_of(id_, *LOGON, *KERBEROS, CREDENTIAL_VALIDATION), w.computer
    )

    package = F.when(any_of(id_, *LOGON), w.text("AuthenticationPackageName")).when(
        id_ == CREDENTIAL_VALIDATION, w.text("PackageName")
    )
    protocol_id = (
        F.when(any_of(id_, *KERBEROS), 2)
        .when(package.isin(*NTLM_PACKAGES), 1)
        .when(any_of(id_, *LOGON) & (package == "Kerberos"), 2)
    )
    logon_type = F.when(any_of(id_, *LOGON, *LOGOFF), scalars.as_int(w.data("LogonType")))

    acting = w.text("ProcessName")
    subject = F.when(any_of(id_, EXPLICIT_CREDENTIALS, PROCESS_CREATION), account("Subject"))
    acting_process = F.when(
        any_of(id_, *LOGON, EXPLICIT_CREDENTIALS),
        image(acting, pid=F.when(id_ == EXPLICIT_CREDENTIALS, scalars.hex_int(w.data("ProcessId")))),
    )
    actor = obj(
        S.ACTOR,
        (any_of(id_, *LOGON, EXPLICIT_CREDENTIALS) & acting.isNotNull())
        | any_of(id_, EXPLICIT_CREDENTIALS, PROCESS_CREATION),
        user=subject,
        process=acting_process,
    )

    started, parent = w.text("NewProcessName"), w.text("ParentProcessName")
    parent_name = scalars.windows_name(parent)
    process = F.when(
        id_ == PROCESS_CREATION,
        image(
            started,
            pid=scalars.hex_int(w.data("NewProcessId")),
            cmd_line=w.text("CommandLine"),
            parent_process=obj(
                S.PARENT_PROCESS,
                parent.isNotNull(),
                name=parent_name,
                file=obj(S.FILE, F.lit(True), path=parent, name=parent_name),
                pid=scalars.hex_int(w.data("ProcessId")),
            ),
        ),
    )

    service_name, service_sid = w.text("ServiceName"), w.text("ServiceSid")
    lines = F.split(w.text("PrivilegeList"), r"\r\n|\r|\n")
    privileges = F.slice(F.filter(F.transform(lines, lambda p: F.trim(p)), lambda p: p != ""), 1, 64)
    time_text = w.time_text()
    kept_status = F.when(any_of(id_, 4625, *KERBEROS, CREDENTIAL_VALIDATION), status)

    def kerberos_only(name: str) -> Column:
        return F.when(any_of(id_, *KERBEROS), w.text(name))

    mapped = event(
        class_uid=F.when(id_ == SPECIAL_PRIVILEGES, S.AUTHORIZE_SESSION)
        .when(id_ == PROCESS_CREATION, S.PROCESS_ACTIVITY)
        .otherwise(S.AUTHENTICATION),
        activity_id=S.lookup(ACTIVITY, id_),
        status_id=status_id,
        severity_id=F.when(status_id == 2, 2).otherwise(1),
        time=scalars.event_time(time_text),
        message=S.lookup(MESSAGE, id_),
        metadata=w.metadata("Microsoft Windows", "Security"),
        device=w.device(),
        user=F.when(any_of(id_, *LOGON, *LOGOFF, EXPLICIT_CREDENTIALS, *KERBEROS), account("Target"))
        .when(id_ == SPECIAL_PRIVILEGES, account("Subject"))
        .when(id_ == CREDENTIAL_VALIDATION, obj(S.USER, F.lit(True), name=w.text("TargetUserName"))),
        src_endpoint=source,
        dst_endpoint=obj(S.ENDPOINT, target_host.isNotNull(), hostname=target_host),
        auth_protocol=F.when(any_of(id_, *KERBEROS), F.lit("Kerberos")).otherwise(package),
        auth_protocol_id=protocol_id,
        logon_type_id=logon_type,
        logon_type=S.lookup(LOGON_TYPES, logon_type),
        actor=actor,
        process=process,
        service=F.when(
            any_of(id_, *KERBEROS),
            obj(S.EVENT["service"].dataType, any_present(service_name, service_sid), name=service_name, uid=service_sid),
        ),
        privileges=F.when((id_ == SPECIAL_PRIVILEGES) & (F.size(privileges) > 0), privileges),
        raw_data=raw_text(),
        unmapped=text_map(
            {
                "event_id": id_,
                "status": kept_status,
                "failure_reason": F.when(id_ == 4625, w.text("FailureReason")),
                "sub_status": F.when(id_ == 4625, w.text("SubStatus")),
                "ticket_options": kerberos_only("TicketOptions"),
                "ticket_encryption_type": kerberos_only("TicketEncryptionType"),
                "pre_auth_type": kerberos_only("PreAuthType"),
                "transmitted_services": kerberos_only("TransmittedServices"),
            }
        ),
    )
    bad = problem(
        *w.envelope_checks(tuple(ACTIVITY), "Windows Security"),
        (time_text.isNull(), PARSE_ERROR, "Windows event has no TimeCreated"),
        (
            (id_ == SPECIAL_PRIVILEGES)
            & ~any_present(w.text("SubjectUserName"), w.text("SubjectDomainName"), w.text("SubjectUserSid")),
            PARSE_ERROR,
            "4672 event names no account",
        ),
        (
            (id_ == CREDENTIAL_VALIDATION) & w.text("TargetUserName").isNull(),
            PARSE_ERROR,
            "4776 event names no account",
        ),
        ((id_ == PROCESS_CREATION) & started.isNull(), PARSE_ERROR, "4688 event has no NewProcessName"),
    )
    return df.withColumn("event", mapped).withColumn("problem", bad)
