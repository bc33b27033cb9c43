"""Entities: which things an event names, in which role, and which of them may join findings.

All of it happens inside the row, so extracting entities from a table needs no shuffle.
"""

from __future__ import annotations

from functools import lru_cache

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from casewright import schema as S
from casewright.functions import net, scalars
from casewright.functions.ids import at_millis

# --- Fixed values: caps, the role a field gives an entity, and action names ----------------------------------------
MAX_MESSAGE, MAX_RAW, MAX_COMMAND = 512, 2048, 1024
FIELD_ROLES = {
    "src_endpoint.ip": "src_ip",
    "dst_endpoint.ip": "dst_ip",
    "device.ip": "host_ip",
    "answers.rdata": "answer",
    "process.name": "process",
    "process.parent_process.name": "parent_process",
    "actor.process.name": "actor_process",
}
LOGON_ACTIONS = {1: "Logged on", 2: "Failed logon"}
ACTIVITY_ACTIONS = {
    (3002, 2): "Logged off",
    (1007, 1): "Process started",
    (1007, 2): "Process terminated",
    (1007, 3): "Process opened another process",
    (1007, 4): "Thread injected into another process",
    (1001, 1): "File created",
    (1001, 4): "File deleted",
    (1005, 1): "Module loaded",
    (201001, 1): "Registry key created",
    (201001, 4): "Registry key deleted",
    (201001, 5): "Registry key renamed",
    (201002, 2): "Registry value set",
    (201002, 4): "Registry value deleted",
}
CLASS_ACTIONS = {
    3002: "Authentication",
    1007: "Process activity",
    4001: "Network connection",
    4002: "HTTP request",
    4003: "DNS query",
    1001: "File activity",
    1005: "Module activity",
    201001: "Registry key activity",
    201002: "Registry value activity",
}
# ------------------------------------------------------------------------------------------------------------

ENTITY_TYPE = "array<struct<field:string,type:string,value:string,links:boolean,role:string>>"


def _text(path: str) -> Column:
    """A field's whole trimmed text; blank counts as absent."""
    trimmed = F.trim(F.col(path).cast("string"))
    return F.when(trimmed != "", trimmed)


def _entity(field: str, kind: str, value: Column, links: Column | bool, role: str | None = None) -> Column:
    links = F.lit(links) if isinstance(links, bool) else links
    return F.struct(
        F.lit(field).alias("field"),
        F.lit(kind).alias("type"),
        value.alias("value"),
        links.alias("links"),
        F.lit(role or FIELD_ROLES.get(field, kind)).alias("role"),
    )


@lru_cache(maxsize=2)
def _role_columns(application: str) -> tuple[dict[str, Column], Column, dict[str, Column], Column]:
    """The expressions behind ``with_roles``, built once per Spark application: hosts and addresses, the scope
    of a bare account name, the other values, and the list of roles made of them all."""
    is_auth = F.col("class_uid") == S.AUTHENTICATION
    is_network = F.col("class_uid").isin(*S.NETWORK_CLASSES)

    def our_side(side: str) -> Column:
        return _text(f"{side}.ip").isNull() | ~net.is_external_ip(_text(f"{side}.ip"))

    # Named first: each is used several times below, and a column is computed once.
    hosts_and_addresses = (
        {
            "_host0": scalars.normalise_host(_text("device.hostname")),
            "_host_src": F.when(is_network & our_side("src_endpoint"), scalars.normalise_host(_text("src_endpoint.hostname"))),
            "_host_dst": F.when(
                is_auth | (is_network & our_side("dst_endpoint")), scalars.normalise_host(_text("dst_endpoint.hostname"))
            ),
            "_ip_src": net.canonical_ip(_text("src_endpoint.ip")),
            "_ip_dst": net.canonical_ip(_text("dst_endpoint.ip")),
            "_ip_dev": net.canonical_ip(_text("device.ip")),
        }
    )
    # In a network event the source side comes before the destination side.
    scope = F.coalesce("_host0", "_host_src", "_host_dst")

    def user(prefix: str) -> Column:
        return scalars.scoped_user(_text(f"{prefix}.name"), _text(f"{prefix}.domain"), F.col("_scope"))

    def far_name(side: str) -> Column:
        return F.when(is_network & ~our_side(side), scalars.normalise_domain(_text(f"{side}.hostname")))

    # Plain columns again: these are generated code, the array functions below are not.
    named = {
        ("user.name", "user", True): user("user"),
        ("actor.user.name", "user", True): user("actor.user"),
        ("process.user.name", "user", True): user("process.user"),
        ("query.hostname", "domain", True): scalars.normalise_domain(_text("query.hostname")),
        ("src_endpoint.domain", "domain", True): scalars.normalise_domain(_text("src_endpoint.domain")),
        ("dst_endpoint.domain", "domain", True): scalars.normalise_domain(_text("dst_endpoint.domain")),
        ("src_endpoint.hostname", "domain", True): far_name("src_endpoint"),
        ("dst_endpoint.hostname", "domain", True): far_name("dst_endpoint"),
        ("process.name", "process", False): F.lower(_text("process.name")),
        ("process.parent_process.name", "process", False): F.lower(_text("process.parent_process.name")),
        ("actor.process.name", "process", False): F.lower(_text("actor.process.name")),
        ("process.file.path", "file", False): _text("process.file.path"),
        ("file.path", "file", False): _text("file.path"),
    }
    columns = {key: f"_value{number}" for number, key in enumerate(named)}
    external = {f"_ext{name}": net.is_external_ip(F.col(name)) for name in ("_ip_src", "_ip_dst", "_ip_dev")}
    values = {columns[key]: value for key, value in named.items()} | external
    plain = {key[0] + key[1]: _entity(key[0], key[1], F.col(columns[key]), key[2]) for key in named}

    def of(field: str, kind: str) -> Column:
        return plain[field + kind]

    def ip(field: str, column: str) -> Column:
        return _entity(field, "ip", F.col(column), F.col(f"_ext{column}"))

    def listed(values: Column, build) -> Column:
        return F.coalesce(F.transform(values, build), F.array().cast(ENTITY_TYPE))

    def answer(item: Column) -> Column:
        address = net.canonical_ip(F.trim(item["rdata"]))
        return net.let(address, lambda a: _entity("answers.rdata", "ip", a, net.is_external_ip(a)))

    def hashes(path: str) -> Column:
        return listed(
            F.col(f"{path}.hashes"),
            lambda h: _entity(
                f"{path}.hashes.value", "hash", F.lower(F.nullif(F.trim(h["value"]), F.lit(""))), True
            ),
        )

    far_role = F.when(is_network, F.lit("dst_host")).otherwise(F.lit("host"))
    dst_host = _entity("dst_endpoint.hostname", "host", F.col("_host_dst"), True).withField("role", far_role)
    found = F.concat(
        F.array(
            _entity("device.hostname", "host", F.col("_host0"), True, "host"),
            _entity("src_endpoint.hostname", "host", F.col("_host_src"), True, "host"),
            dst_host,
            ip("src_endpoint.ip", "_ip_src"),
            ip("dst_endpoint.ip", "_ip_dst"),
            ip("device.ip", "_ip_dev"),
            of("user.name", "user"),
            of("actor.user.name", "user"),
            of("process.user.name", "user"),
            of("query.hostname", "domain"),
            of("src_endpoint.domain", "domain"),
            of("dst_endpoint.domain", "domain"),
            of("src_endpoint.hostname", "domain"),
            of("dst_endpoint.hostname", "domain"),
        ),
        listed(F.col("answers"), answer),
        F.array(
            of("process.name", "process"),
            of("process.parent_process.name", "process"),
            of("actor.process.name", "process"),
            of("process.file.path", "file"),
            of("file.path", "file"),
        ),
        hashes("process.file"),
        hashes("process.parent_process.file"),
        hashes("file"),
    )
    roles = F.array_distinct(F.filter(found, lambda e: e["value"].isNotNull()))
    return hosts_and_addresses, scope, values, roles


def with_roles(events: DataFrame, *keep: Column | str) -> DataFrame:
    """``keep`` and ``roles``: every (field, entity) pair of the event, in a fixed order, each pair once.

    The client-claimed name of an authentication is not one of our hosts; the far side of an outbound
    connection is a domain, not a host.
    """
    first, scope, values, roles = _role_columns(events.sparkSession.sparkContext.applicationId)
    prepared = events.withColumns(first).withColumn("_scope", scope).withColumns(values)
    # inline(array(struct)) makes the result columns of their own. As a plain projection the whole expression
    # would be copied into every filter and generator above it.
    return prepared.select(F.inline(F.array(F.struct(*keep, roles.alias("roles")))))


def entity_key(entity: Column) -> Column:
    return F.concat(entity["type"], F.lit(":"), entity["value"])


def extract_sightings(events: DataFrame) -> DataFrame:
    """One row per event and distinct entity, with the first field it appeared in.

    Expects events with a ``sx.event_uid``; adds no shuffle.
    """
    stored = events.filter(F.col("sx.event_uid").isNotNull() & F.col("time_ms").isNotNull())
    marked = with_roles(
        stored, F.col("sx.org_id").alias("org_id"), F.col("sx.event_uid").alias("event_uid"), F.col("time_ms").alias("at_ms")
    )
    # "First" is the position in the fixed order of the roles; repeats of an entity within a row go.
    keyed = marked.withColumn("_keys", F.transform("roles", entity_key))
    first = F.filter("roles", lambda e, i: F.array_position(F.col("_keys"), entity_key(e)) == i + 1)
    exploded = keyed.select("org_id", "event_uid", "at_ms", F.explode_outer(first).alias("e")).filter(
        F.col("e").isNotNull()
    )
    return exploded.select(
        "org_id",
        "event_uid",
        "at_ms",
        F.col("e.field").alias("field"),
        F.col("e.role").alias("role"),
        F.col("e.type").alias("entity_type"),
        F.col("e.value").alias("entity_value"),
        entity_key(F.col("e")).alias("entity_key"),
        F.col("e.links").alias("links"),
    )


def action_text() -> Column:
    """What the event says happened, in words."""
    class_uid, activity, status = F.col("class_uid"), F.col("activity_id"), F.col("status_id")
    specific = S.lookup({c * 1000 + a: text for (c, a), text in ACTIVITY_ACTIONS.items()}, class_uid * 1000 + activity)
    return (
        F.when(
            (class_uid == S.AUTHENTICATION) & (activity == 1),
            F.coalesce(S.lookup(LOGON_ACTIONS, status), F.lit("Logon attempt")),
        )
        .when(specific.isNotNull(), specific)
        .otherwise(
            F.coalesce(
                S.lookup(CLASS_ACTIONS, class_uid),
                F.nullif(F.col("activity_name"), F.lit("")),
                F.concat(F.lit("OCSF class "), class_uid.cast("string")),
            )
        )
    )


def _capped(path: str, limit: int) -> Column:
    return F.when(F.trim(F.col(path)) != "", F.substring(F.col(path), 1, limit))


def digest(events: DataFrame, **keep: Column) -> DataFrame:
    """Evidence digests: what each event says, reduced to what a timeline and a graph are built from; columns to keep."""
    stored = events.filter(
        F.col("sx.event_uid").isNotNull() & F.col("time_ms").isNotNull() & F.col("class_uid").isNotNull()
    )
    marked = with_roles(
        stored,
        F.col("sx.org_id").alias("org_id"),
        F.col("sx.event_uid").alias("event_uid"),
        "time_ms",
        "class_uid",
        "activity_id",
        "status_id",
        action_text().alias("action"),
        _capped("message", MAX_MESSAGE).alias("message"),
        _capped("raw_data", MAX_RAW).alias("raw"),
        _capped("process.cmd_line", MAX_COMMAND).alias("cmd_line"),
        F.col("src_endpoint.port").alias("src_port"),
        F.col("dst_endpoint.port").alias("dst_port"),
        "logon_type_id",
        *[column.alias(name) for name, column in keep.items()],
    )

    def keys(role: Column) -> Column:
        own = F.transform(F.filter("roles", lambda e: e["role"] == role), entity_key)
        return F.array_distinct(own)

    names = F.array_distinct(F.transform("roles", lambda e: e["role"]))
    by_role = F.map_from_entries(F.transform(names, lambda r: F.struct(r.alias("k"), keys(r).alias("v"))))
    return marked.select(
        "org_id",
        "event_uid",
        "time_ms",
        at_millis(F.col("time_ms")).alias("time"),
        "class_uid",
        "activity_id",
        "status_id",
        "action",
        S.lookup({1: "success", 2: "failure"}, F.col("status_id")).alias("outcome"),
        "message",
        "raw",
        by_role.alias("roles"),
        "cmd_line",
        "src_port",
        "dst_port",
        "logon_type_id",
        *keep,
    )


def role(name: str) -> Column:
    """The entity keys a digest holds in a role; empty when it has none."""
    return F.coalesce(F.try_element_at("roles", F.lit(name)), F.array().cast("array<string>"))


def key_value(key: Column) -> Column:
    """The value part of an entity key."""
    return F.regexp_replace(key, "^[^:]*:", "")


def first_of(name: str) -> Column:
    return F.get(role(name), F.lit(0))


def external_keys(keys: Column) -> Column:
    return F.filter(keys, lambda k: net.is_external_ip(key_value(k)))


def remote_key() -> Column:
    """The other side of a digest: the client of a logon, or the external end of a connection."""
    addresses = F.concat(role("dst_ip"), role("src_ip"))
    return F.coalesce(
        F.when(F.col("class_uid") == S.AUTHENTICATION, first_of("src_ip")),
        F.get(external_keys(addresses), F.lit(0)),
        first_of("dst_host"),
        first_of("dst_ip"),
    )
