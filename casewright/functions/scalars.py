"""Scalar building blocks the parsers and operators share."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

from casewright.functions.net import is_ip

# --- Fixed values -------------------------------------------------------------------------------------------
JUNK_HOSTS = ("", "-", "unknown", "unknown-host", "localhost", "workstation")
JUNK_USERS = (
    "",
    "-",
    "system",
    "local service",
    "network service",
    "anonymous logon",
    "dwm-1",
    "umfd-0",
    "umfd-1",
)
TACTICS = (
    "reconnaissance",
    "resource_development",
    "initial_access",
    "execution",
    "persistence",
    "privilege_escalation",
    "stealth",
    "defense_impairment",
    "credential_access",
    "discovery",
    "lateral_movement",
    "collection",
    "command_and_control",
    "exfiltration",
    "impact",
)
RENAMED_TACTICS = {"defense_evasion": "stealth"}
HASH_ALGORITHM_IDS = {"MD5": 1, "SHA1": 2, "SHA256": 3, "IMPHASH": 99}
HASH_LENGTHS = {1: 32, 2: 40, 3: 64, 4: 128}
DURATION_UNITS_MS = {"s": 1_000, "m": 60_000, "h": 3_600_000}
# ------------------------------------------------------------------------------------------------------------

_RFC3339_SHAPE = (
    r"^[0-9]{4}-[0-9]{2}-[0-9]{2}"
    r"([T ][0-9]{2}:[0-9]{2}(:[0-9]{2}([.,][0-9]+)?)?(Z|[+-][0-9]{2}:?[0-9]{2}(:[0-9]{2})?)?)?$"
)


def blank_to_null(text: Column) -> Column:
    trimmed = F.trim(text)
    return F.when(trimmed != "", trimmed)


def clean(text: Column) -> Column:
    """Trimmed text; '' and '-' are how logs write "no value"."""
    trimmed = F.trim(text)
    return F.when(~trimmed.isin("", "-"), trimmed)


def as_int(text: Column) -> Column:
    return clean(text.cast("string")).try_cast("long")


def hex_int(text: Column) -> Column:
    """A hexadecimal number, with or without 0x; null when it is not one."""
    digits = F.regexp_extract(F.lower(clean(text)), r"^(?:0x)?([0-9a-f]{1,15})$", 1)
    return F.when(digits != "", F.conv(digits, 16, 10).try_cast("long"))


def matched(text: Column, pattern: str, group: int) -> Column:
    """A regex group, null when the pattern or the group did not take part."""
    found = F.regexp_extract(text, pattern, group)
    return F.when(found != "", found)


def windows_name(path: Column) -> Column:
    """The last component of a Windows path."""
    return F.regexp_extract(F.rtrim(path, F.lit("\\/")), r"[^\\/]+$", 0)


def value_name(path: Column) -> Column:
    """The text after the last backslash of a registry path."""
    return blank_to_null(F.substring_index(path, "\\", -1))


def split_account(text: Column) -> tuple[Column, Column]:
    """``(domain, name)`` of ``DOMAIN\\name``, split on the last backslash; no domain leaves the text whole."""
    whole = clean(text)
    domain = matched(whole, r"^(.+)\\([^\\]*)$", 1)
    name = F.when(domain.isNotNull(), F.substring_index(whole, "\\", -1)).otherwise(whole)
    return domain, name


def hash_list(text: Column) -> Column:
    """``ALG=hex,…`` as hash structs; unknown algorithms and malformed digests are left out."""
    ids = F.create_map(*[F.lit(x) for pair in HASH_ALGORITHM_IDS.items() for x in pair])

    def one(part: Column) -> Column:
        algorithm = F.upper(F.trim(F.substring_index(part, "=", 1)))
        value = F.trim(F.regexp_extract(part, r"=([\s\S]*)$", 1))
        return F.struct(
            F.element_at(ids, algorithm).alias("algorithm_id"), algorithm.alias("algorithm"), value.alias("value")
        )

    def usable(h: Column) -> Column:
        return (
            h["algorithm_id"].isNotNull()
            & (h["value"] != "")
            & ((h["algorithm_id"] == 99) | h["value"].rlike(r"^(0[xX])?[0-9A-Fa-f]+$"))
        )

    found = F.filter(F.transform(F.split(clean(text), ","), one), usable)
    return F.when(F.size(found) > 0, found)


def normalise_host(text: Column) -> Column:
    """The short lower-case host name; null for addresses and placeholders."""
    name = F.lower(F.rtrim(F.trim(text), F.lit(".")))
    short = F.substring_index(name, ".", 1)
    return F.when(~is_ip(name) & ~short.isin(*JUNK_HOSTS), short)


def normalise_domain(text: Column) -> Column:
    """The lower-case domain name; it has to hold a dot and no space."""
    name = F.lower(F.rtrim(F.trim(text), F.lit(".")))
    return F.when(name.contains(".") & ~name.contains(" "), name)


def scoped_user(name: Column, domain: Column, host: Column) -> Column:
    """``domain\\name``, or ``name@host`` without a domain; built-in and machine accounts are nobody."""
    account, scope = blank_to_null(name), blank_to_null(domain)
    usable = ~F.lower(account).isin(*JUNK_USERS) & ~account.endswith("$")
    return F.when(
        usable,
        F.when(scope.isNotNull() & (scope != "-"), F.concat(F.lower(scope), F.lit("\\"), F.lower(account))).when(
            host.isNotNull(), F.concat(F.lower(account), F.lit("@"), host)
        ),
    )


def event_time(text: Column) -> Column:
    """Epoch seconds, epoch milliseconds or an RFC 3339 text as an instant; null when it is none of them."""
    trimmed = F.trim(text)
    number = F.when(trimmed.rlike(r"^-?[0-9]+(\.[0-9]+)?$"), trimmed.try_cast("double"))
    whole = F.when(trimmed.rlike(r"^-?[0-9]+$"), trimmed.try_cast("long"))
    micros = F.when(
        whole.isNotNull(), F.when(F.abs(whole) >= 100_000_000_000, whole * 1_000).otherwise(whole * 1_000_000)
    ).when(
        number.isNotNull(),
        F.when(F.abs(number) >= 1e11, F.round(number * 1e3)).otherwise(F.round(number * 1e6)).try_cast("long"),
    )
    written = F.when(
        trimmed.rlike(_RFC3339_SHAPE), F.try_to_timestamp(F.regexp_replace(trimmed, ",", "."))
    )
    return F.coalesce(F.timestamp_micros(micros), written)


def time_millis(at: Column) -> Column:
    return F.unix_millis(at)


def techniques_from_tags(tags: Column) -> Column:
    """``attack.t1110.003`` tags as technique ids, in order, once each."""
    ids = F.transform(tags, lambda t: F.upper(F.regexp_extract(F.lower(F.trim(t)), r"^attack\.(t\d{4}(?:\.\d{3})?)$", 1)))
    return F.array_distinct(F.filter(ids, lambda t: t != ""))


def tactics_from_tags(tags: Column) -> Column:
    """``attack.<tactic>`` tags as tactic names, in order, once each; a renamed tactic takes its new name."""

    def one(tag: Column) -> Column:
        name = F.translate(F.regexp_extract(F.lower(F.trim(tag)), r"^attack\.(.+)$", 1), "-", "_")
        for old, new in RENAMED_TACTICS.items():
            name = F.when(name == old, F.lit(new)).otherwise(name)
        return name

    return F.array_distinct(F.filter(F.transform(tags, one), lambda t: t.isin(*TACTICS)))


def covers_technique(tagged: Column, wanted: Column) -> Column:
    """Same technique, its parent, or one of its sub-techniques."""
    a, b = F.upper(tagged), F.upper(wanted)
    return (a == b) | b.startswith(F.concat(a, F.lit("."))) | a.startswith(F.concat(b, F.lit(".")))


def duration_ms(text: str) -> int:
    """``90s``, ``10m`` or ``1h`` in milliseconds."""
    found = re.fullmatch(r"(\d+)([smh])", text)
    if found is None:
        raise ValueError(f"a window is written like 90s, 10m or 1h, not {text!r}")
    return int(found[1]) * DURATION_UNITS_MS[found[2]]
