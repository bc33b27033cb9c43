"""Sysmon operational log records as OCSF events."""

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

# --- Fixed values: event ids and registry event types with their OCSF class, activity and message ------------------
LOG_NAME = "Microsoft-Windows-Sysmon/Operational"
CREATE, NETWORK, TERMINATE, IMAGE_LOAD, REMOTE_THREAD, ACCESS, DNS = 1, 3, 5, 7, 8, 10, 22
FILES, REGISTRY = (11, 23, 26), (12, 13, 14)
CLASSES = {
    1: 1007, 3: 4001, 5: 1007, 7: 1005, 8: 1007, 10: 1007, 11: 1001, 22: 4003, 23: 1001, 26: 1001,
}
ACTIVITIES = {1: 1, 3: 1, 5: 2, 7: 1, 8: 4, 10: 3, 11: 1, 22: 1, 23: 4, 26: 4}
MESSAGES = {
    1: "Process created.",
    3: "Network connection detected.",
    5: "Process terminated.",
    7: "Image loaded.",
    8: "A thread was created in another process.",
    10: "A process opened another process.",
    11: "File created.",
    22: "DNS query.",
    23: "File deleted.",
    26: "File deleted.",
}
REGISTRY_TYPES = {
    "CreateKey": (201001, 1, "Registry key created."),
    "DeleteKey": (201001, 4, "Registry key deleted."),
    "DeleteValue": (201002, 4, "Registry value deleted."),
    "SetValue": (201002, 2, "Registry value set."),
    "RenameKey": (201001, 5, "Registry object renamed."),
    "RenameValue": (201001, 5, "Registry object renamed."),
}
MAX_ANSWERS = 50
# ------------------------------------------------------------------------------------------------------------


def parse(df: DataFrame) -> DataFrame:
    df = windows_record(df)
    w = WindowsFields()
    id_ = w.event_id

    def account(name: str) -> Column:
        domain, user = scalars.split_account(w.data(name))
        return obj(S.USER, w.text(name).isNotNull(), name=user, domain=domain)

    def file(path: Column, *, described: bool = False, hashes: Column | None = None) -> Column:
        parts: dict[str, Column] = {"path": path, "name": scalars.windows_name(path)}
        if described:
            product = w.text("Product")
            parts |= {
                "hashes": scalars.hash_list(w.data("Hashes")),
                "company_name": w.text("Company"),
                "desc": w.text("Description"),
                "product": obj(S.FILE["product"].dataType, product.isNotNull(), name=product),
                "version": w.text("FileVersion"),
            }
        if hashes is not None:
            parts["hashes"] = hashes
        return obj(S.FILE, path.isNotNull(), **parts)

    def process(path: Column, pid: Column, guid: Column, kind=S.PROCESS, *, described=False, **more: Column) -> Column:
        return obj(
            kind,
            path.isNotNull(),
            name=scalars.windows_name(path),
            file=file(path, described=described),
            pid=pid,
            uid=guid,
            **more,
        )

    def number(name: str) -> Column:
        return scalars.as_int(w.data(name))

    def guid(*names: str) -> Column:
        return scalars.clean(F.coalesce(*[F.nullif(w.data(n), F.lit("")) for n in names]))

    own, target, source = w.text("Image"), w.text("TargetImage"), w.text("SourceImage")
    cross = any_of(id_, REMOTE_THREAD, ACCESS)
    reg_type, reg_target, new_name = w.text("EventType"), w.text("TargetObject"), w.text("NewName")
    is_reg = any_of(id_, *REGISTRY)
    renamed = reg_type.isin("RenameKey", "RenameValue")
    of_type = {k: {name: row[i] for name, row in REGISTRY_TYPES.items()} for i, k in enumerate(("class", "act", "msg"))}

    created = process(
        own,
        number("ProcessId"),
        guid("ProcessGuid"),
        described=True,
        cmd_line=w.text("CommandLine"),
        user=account("User"),
        integrity=w.text("IntegrityLevel"),
        working_directory=w.text("CurrentDirectory"),
        parent_process=process(
            w.text("ParentImage"),
            number("ParentProcessId"),
            guid("ParentProcessGuid"),
            S.PARENT_PROCESS,
            cmd_line=w.text("ParentCommandLine"),
            user=account("ParentUser"),
        ),
    )
    ended = process(own, number("ProcessId"), guid("ProcessGuid"), user=account("User"))
    reached = process(
        target,
        number("TargetProcessId"),
        guid("TargetProcessGuid", "TargetProcessGUID"),
        user=account("TargetUser"),
    )
    acting = process(own, number("ProcessId"), guid("ProcessGuid"))
    reaching = process(source, number("SourceProcessId"), guid("SourceProcessGuid", "SourceProcessGUID"))
    by_image = any_of(id_, NETWORK, IMAGE_LOAD, DNS, *FILES, *REGISTRY)
    actor = obj(
        S.ACTOR,
        F.when(id_ == CREATE, w.text("ParentUser").isNotNull())
        .when(cross, any_present(source, w.text("SourceUser")))
        .when(by_image, any_present(own, w.text("User")))
        .otherwise(False),
        process=F.when(cross, reaching).when(by_image, acting),
        user=F.when(id_ == CREATE, account("ParentUser")).when(cross, account("SourceUser")).when(by_image, account("User")),
    )

    def endpoint(side: str) -> Column:
        address, port, name = w.data(f"{side}Ip"), number(f"{side}Port"), w.text(f"{side}Hostname")
        ip = net.as_ip(address)
        return obj(
            S.ENDPOINT,
            (id_ == NETWORK) & any_present(F.when(net.is_ip(F.trim(address)), address), port, name),
            ip=ip,
            port=port,
            hostname=name,
        )

    initiated = F.lower(w.text("Initiated"))
    protocol = w.text("Protocol")
    direction = F.when(initiated == "true", 2).when(initiated == "false", 1)
    module = F.when(id_ == IMAGE_LOAD, obj(S.MODULE, F.lit(True), file=file(w.text("ImageLoaded"), described=True))).when(
        id_ == REMOTE_THREAD,
        obj(
            S.MODULE,
            any_present(w.text("StartModule"), w.text("StartFunction"), w.text("StartAddress")),
            file=file(w.text("StartModule")),
            function_name=w.text("StartFunction"),
            start_address=w.text("StartAddress"),
        ),
    )
    reg_key_path = F.when(renamed, F.coalesce(new_name, reg_target)).when(
        reg_type.isin("CreateKey", "DeleteKey"), reg_target
    )
    results = F.filter(
        F.transform(F.split(w.text("QueryResults"), ";"), lambda p: F.trim(p)),
        lambda p: (p != "") & ~p.startswith("type:"),
    )
    answers = F.slice(
        F.transform(
            results,
            lambda p: obj(
                S.ANSWER, F.lit(True), rdata=F.coalesce(net.as_ip(F.regexp_replace(p, "^::ffff:", "")), p)
            ),
        ),
        1,
        MAX_ANSWERS,
    )
    query_status = number("QueryStatus")
    access = w.text("GrantedAccess")
    time_text = w.time_text(w.data("UtcTime"))
    has_user = any_of(id_, CREATE, NETWORK, TERMINATE, IMAGE_LOAD, DNS, *FILES, *REGISTRY)

    def only(ids: tuple[int, ...], name: str) -> Column:
        return F.when(any_of(id_, *ids), w.text(name))

    mapped = event(
        class_uid=F.when(is_reg, S.lookup(of_type["class"], reg_type)).otherwise(S.lookup(CLASSES, id_)),
        activity_id=F.when(is_reg, S.lookup(of_type["act"], reg_type)).otherwise(S.lookup(ACTIVITIES, id_)),
        message=F.when(is_reg, S.lookup(of_type["msg"], reg_type)).otherwise(S.lookup(MESSAGES, id_)),
        status_id=F.when((id_ == DNS) & (F.coalesce(query_status, F.lit(0)) != 0), 2).otherwise(1),
        severity_id=F.lit(1),
        time=scalars.event_time(time_text),
        metadata=w.metadata("Sysmon", LOG_NAME),
        device=w.device(),
        process=F.when(id_ == CREATE, created).when(id_ == TERMINATE, ended).when(cross, reached),
        actor=actor,
        src_endpoint=endpoint("Source"),
        dst_endpoint=endpoint("Destination"),
        connection_info=F.when(
            id_ == NETWORK,
            obj(
                S.CONNECTION_INFO,
                any_present(protocol, direction),
                protocol_name=F.lower(protocol),
                direction_id=direction,
            ),
        ),
        module=module,
        injection_type=F.when(id_ == REMOTE_THREAD, F.lit("Remote Thread")),
        actual_permissions=F.when((id_ == ACCESS) & F.lower(access).startswith("0x"), scalars.hex_int(access)),
        file=F.when(any_of(id_, *FILES), file(w.text("TargetFilename"), hashes=scalars.hash_list(w.data("Hashes")))),
        reg_key=F.when(is_reg, obj(S.REG_KEY, reg_key_path.isNotNull(), path=reg_key_path)),
        prev_reg_key=F.when(is_reg, obj(S.REG_KEY, renamed, path=reg_target)),
        reg_value=F.when(
            is_reg,
            obj(
                S.REG_VALUE,
                reg_type.isin("DeleteValue", "SetValue"),
                path=reg_target,
                name=scalars.value_name(reg_target),
                data=F.when(reg_type == "SetValue", w.text("Details")),
            ),
        ),
        query=F.when(id_ == DNS, obj(S.QUERY, F.lit(True), hostname=w.text("QueryName"))),
        answers=F.when((id_ == DNS) & (F.size(answers) > 0), answers),
        raw_data=raw_text(),
        unmapped=text_map(
            {
                "event_id": id_,
                "rule_name": w.text("RuleName"),
                "original_file_name": only((CREATE, IMAGE_LOAD), "OriginalFileName"),
                "hashes": only((CREATE, IMAGE_LOAD, *FILES), "Hashes"),
                "user": F.when(has_user, w.text("User")),
                "logon_id": only((CREATE,), "LogonId"),
                "initiated": only((NETWORK,), "Initiated"),
                "signed": only((IMAGE_LOAD,), "Signed"),
                "signature": only((IMAGE_LOAD,), "Signature"),
                "signature_status": only((IMAGE_LOAD,), "SignatureStatus"),
                "start_module": only((REMOTE_THREAD,), "StartModule"),
                "granted_access": only((ACCESS,), "GrantedAccess"),
                "call_trace": only((ACCESS,), "CallTrace"),
                "event_type": F.when(is_reg, reg_type),
                "query_status": only((DNS,), "QueryStatus"),
            }
        ),
    )

    def missing(ids: tuple[int, ...], name: str) -> tuple[Column, str, Column]:
        reason = F.concat(F.lit("Sysmon event "), id_.cast("string"), F.lit(f" has no {name}"))
        return (any_of(id_, *ids) & w.text(name).isNull(), PARSE_ERROR, reason)

    bad = problem(
        *w.envelope_checks((*CLASSES, *REGISTRY), "Sysmon"),
        (time_text.isNull(), PARSE_ERROR, "Sysmon event has no TimeCreated or UtcTime"),
        missing((CREATE, TERMINATE), "Image"),
        (
            (id_ == NETWORK)
            & ~any_present(
                *[F.when(net.is_ip(F.trim(w.data(n))), w.data(n)) for n in ("SourceIp", "DestinationIp")],
                number("SourcePort"),
                number("DestinationPort"),
                w.text("SourceHostname"),
                w.text("DestinationHostname"),
            ),
            PARSE_ERROR,
            "Sysmon event 3 has no source or destination",
        ),
        missing((IMAGE_LOAD,), "ImageLoaded"),
        missing((REMOTE_THREAD, ACCESS), "TargetImage"),
        missing(FILES, "TargetFilename"),
        missing(REGISTRY, "TargetObject"),
        (
            is_reg & ~F.coalesce(reg_type.isin(*REGISTRY_TYPES), F.lit(False)),
            PARSE_ERROR,
            F.concat(F.lit("unsupported Sysmon registry EventType "), F.coalesce(reg_type, F.lit("(none)"))),
        ),
        missing((DNS,), "QueryName"),
    )
    return df.withColumn("event", mapped).withColumn("problem", bad)
