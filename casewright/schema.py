"""The nested OCSF event schema and the value tables the operators share."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

_SIMPLE = {
    "string": T.StringType(),
    "int": T.IntegerType(),
    "long": T.LongType(),
    "boolean": T.BooleanType(),
    "timestamp": T.TimestampType(),
}


def record(**fields: str | T.DataType) -> T.StructType:
    """A struct type from ``name="string"`` pairs."""
    return T.StructType(
        [T.StructField(name, _SIMPLE[kind] if isinstance(kind, str) else kind) for name, kind in fields.items()]
    )


STRINGS = T.ArrayType(T.StringType())
TEXT_MAP = T.MapType(T.StringType(), T.StringType())

USER = record(name="string", uid="string", domain="string")
OS = record(name="string", type="string")
DEVICE = record(hostname="string", ip="string", uid="string", os=OS)
ENDPOINT = record(ip="string", port="int", hostname="string", domain="string")
HASH = record(algorithm_id="int", algorithm="string", value="string")
FILE = record(
    path="string",
    name="string",
    hashes=T.ArrayType(HASH),
    company_name="string",
    desc="string",
    product=record(name="string"),
    version="string",
)
PARENT_PROCESS = record(pid="long", uid="string", name="string", cmd_line="string", file=FILE, user=USER)
PROCESS = record(
    pid="long",
    uid="string",
    name="string",
    cmd_line="string",
    file=FILE,
    user=USER,
    integrity="string",
    working_directory="string",
    parent_process=PARENT_PROCESS,
)
ACTOR = record(user=USER, process=PROCESS)
METADATA = record(
    version="string",
    product=record(name="string", vendor_name="string", version="string"),
    log_name="string",
    uid="string",
    original_time="string",
)
QUERY = record(hostname="string", type="string")
ANSWER = record(rdata="string", type="string", ttl="long")
HTTP_REQUEST = record(
    http_method="string",
    url=record(url_string="string", hostname="string", path="string", scheme="string"),
    user_agent="string",
)
HTTP_RESPONSE = record(code="int")
CONNECTION_INFO = record(protocol_name="string", direction_id="int")
TRAFFIC = record(bytes_in="long", bytes_out="long", packets_in="long", packets_out="long")
MODULE = record(file=FILE, load_type="string", function_name="string", start_address="string")
REG_KEY = record(path="string")
REG_VALUE = record(path="string", name="string", data="string", type="string")
OBSERVABLE = record(name="string", type_id="int", value="string")

# What a parser produces: the OCSF attributes, before validation fills in the derived ones.
EVENT = record(
    class_uid="int",
    category_uid="int",
    activity_id="int",
    type_uid="long",
    severity_id="int",
    status_id="int",
    time="timestamp",
    message="string",
    metadata=METADATA,
    actor=ACTOR,
    user=USER,
    device=DEVICE,
    src_endpoint=ENDPOINT,
    dst_endpoint=ENDPOINT,
    process=PROCESS,
    file=FILE,
    query=QUERY,
    answers=T.ArrayType(ANSWER),
    http_request=HTTP_REQUEST,
    http_response=HTTP_RESPONSE,
    connection_info=CONNECTION_INFO,
    traffic=TRAFFIC,
    module=MODULE,
    reg_key=REG_KEY,
    prev_reg_key=REG_KEY,
    reg_value=REG_VALUE,
    actual_permissions="long",
    injection_type="string",
    auth_protocol="string",
    auth_protocol_id="int",
    logon_type="string",
    logon_type_id="int",
    is_mfa="boolean",
    service=record(name="string", uid="string"),
    privileges=STRINGS,
    observables=T.ArrayType(OBSERVABLE),
    raw_data="string",
    unmapped=TEXT_MAP,
)

SX = record(
    org_id="string", source_id="string", event_uid="string", ingested_at="timestamp", fingerprint="string"
)

# A stored event: the OCSF attributes, the captions, the millisecond clock and the attribution block.
STORED_EVENT = T.StructType(
    [
        *EVENT.fields,
        T.StructField("time_ms", T.LongType()),
        T.StructField("class_name", T.StringType()),
        T.StructField("category_name", T.StringType()),
        T.StructField("activity_name", T.StringType()),
        T.StructField("severity", T.StringType()),
        T.StructField("status", T.StringType()),
        T.StructField("sx", SX),
    ]
)

# --- Fixed values: OCSF 1.6 class, category, activity, severity and status numbers and names ---------------
FILE_ACTIVITY, MODULE_ACTIVITY, PROCESS_ACTIVITY = 1001, 1005, 1007
AUTHENTICATION, AUTHORIZE_SESSION = 3002, 3003
NETWORK_ACTIVITY, HTTP_ACTIVITY, DNS_ACTIVITY = 4001, 4002, 4003
REGISTRY_KEY_ACTIVITY, REGISTRY_VALUE_ACTIVITY = 201001, 201002
NETWORK_CLASSES = (NETWORK_ACTIVITY, HTTP_ACTIVITY, DNS_ACTIVITY)

CLASS_NAMES = {
    1001: "File System Activity",
    1005: "Module Activity",
    1007: "Process Activity",
    3002: "Authentication",
    3003: "Authorize Session",
    4001: "Network Activity",
    4002: "HTTP Activity",
    4003: "DNS Activity",
    201001: "Registry Key Activity",
    201002: "Registry Value Activity",
}
CATEGORY_NAMES = {
    1: "System Activity",
    2: "Findings",
    3: "Identity & Access Management",
    4: "Network Activity",
    5: "Discovery",
    6: "Application Activity",
}
CATEGORY_SLUGS = {1: "system", 2: "findings", 3: "iam", 4: "network", 5: "discovery", 6: "application"}
ACTIVITY_NAMES = {
    1001: {
        1: "Create",
        2: "Read",
        3: "Update",
        4: "Delete",
        5: "Rename",
        6: "Set Attributes",
        7: "Set Security",
        8: "Get Attributes",
        9: "Get Security",
        10: "Encrypt",
        11: "Decrypt",
        12: "Mount",
        13: "Unmount",
        14: "Open",
    },
    1005: {1: "Load", 2: "Unload"},
    1007: {1: "Launch", 2: "Terminate", 3: "Open", 4: "Inject", 5: "Set User ID"},
    3002: {
        1: "Logon",
        2: "Logoff",
        3: "Authentication Ticket",
        4: "Service Ticket Request",
        5: "Service Ticket Renew",
        6: "Preauth",
        7: "Account Switch",
    },
    3003: {1: "Assign Privileges", 2: "Assign Groups", 3: "Assign Roles"},
    4001: {1: "Open", 2: "Close", 3: "Reset", 4: "Fail", 5: "Refuse", 6: "Traffic", 7: "Listen"},
    4002: {
        1: "Connect",
        2: "Delete",
        3: "Get",
        4: "Head",
        5: "Options",
        6: "Post",
        7: "Put",
        8: "Trace",
        9: "Patch",
    },
    4003: {1: "Query", 2: "Response", 6: "Traffic"},
    201001: {
        1: "Create",
        2: "Read",
        3: "Modify",
        4: "Delete",
        5: "Rename",
        6: "Set Security",
        7: "Restore",
        8: "Import",
        9: "Export",
    },
    201002: {1: "Get", 2: "Set", 3: "Modify", 4: "Delete"},
}
SEVERITY_NAMES = {
    0: "Unknown",
    1: "Informational",
    2: "Low",
    3: "Medium",
    4: "High",
    5: "Critical",
    6: "Fatal",
    99: "Other",
}
STATUS_NAMES = {0: "Unknown", 1: "Success", 2: "Failure", 99: "Other"}
OCSF_VERSION = "1.6.0"
MAX_RAW_DATA = 32_768
MAX_UNMAPPED = 16_384
# The context a class must carry to be useful for detection.
REQUIRED_CONTEXT = {
    1001: ("file",),
    1005: ("module",),
    1007: ("process",),
    3002: ("user",),
    3003: ("user",),
    4001: ("src_endpoint", "dst_endpoint"),
    4002: ("http_request",),
    4003: ("query",),
    201001: ("reg_key",),
    201002: ("reg_value",),
}
# -----------------------------------------------------------------------------------------------------------


def lookup(table: dict, key: Column) -> Column:
    """The table's value for ``key``, null when it has none."""
    pairs = [F.lit(item) for pair in table.items() for item in pair]
    return F.element_at(F.create_map(*pairs), key)


def fit(value: Column, have: T.DataType, want: T.DataType) -> Column:
    if have == want:
        return value
    if isinstance(want, T.StructType) and isinstance(have, T.StructType):
        known = {field.name: field.dataType for field in have.fields}
        parts = [
            fit(value.getField(f.name), known[f.name], f.dataType).alias(f.name)
            if f.name in known
            else F.lit(None).cast(f.dataType).alias(f.name)
            for f in want.fields
        ]
        return F.when(value.isNotNull(), F.struct(*parts))
    if isinstance(want, T.ArrayType) and isinstance(have, T.ArrayType) and isinstance(want.elementType, T.StructType):
        return F.transform(value, lambda item: fit(item, have.elementType, want.elementType))
    return value.cast(want)


def conform(df: DataFrame, schema: T.StructType = STORED_EVENT, *, keep: tuple[str, ...] = ()) -> DataFrame:
    """Give ``df`` the schema's columns: missing ones (also inside structs) become typed nulls."""
    have = {field.name: field.dataType for field in df.schema.fields}
    columns = [
        fit(F.col(f"`{f.name}`"), have[f.name], f.dataType).alias(f.name)
        if f.name in have
        else F.lit(None).cast(f.dataType).alias(f.name)
        for f in schema.fields
    ]
    return df.select(*columns, *[F.col(name) for name in keep])
