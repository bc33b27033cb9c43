"""Deterministic identifiers and time text."""

from __future__ import annotations

import uuid

from pyspark.sql import Column
from pyspark.sql import functions as F

SEPARATOR = "\x1f"
EVENT_NAMESPACE = uuid.UUID("0d5a2f7e-61c3-5b0e-9a44-3f1be7c8d210")
EXPORT_NAMESPACE = uuid.UUID("a3c41b96-7e02-5d6f-8c15-52b90e47f3aa")


def digest(*parts: Column) -> Column:
    """SHA-256 over the parts, each followed by the unit separator; an absent part counts as empty."""
    pieces = []
    for part in parts:
        pieces += [F.coalesce(part.cast("string"), F.lit("")), F.lit(SEPARATOR)]
    return F.sha2(F.concat(*pieces), 256)


def uuid5(namespace: uuid.UUID, name: Column) -> Column:
    """The version 5 UUID of ``name``."""
    raw = F.sha1(F.concat(F.unhex(F.lit(namespace.hex)), F.encode(name, "UTF-8")))
    nibble = F.conv(F.substring(raw, 17, 1), 16, 10).cast("int") % 4
    variant = F.element_at(F.array(*[F.lit(c) for c in "89ab"]), nibble + 1)
    return F.concat_ws(
        "-",
        F.substring(raw, 1, 8),
        F.substring(raw, 9, 4),
        F.concat(F.lit("5"), F.substring(raw, 14, 3)),
        F.concat(variant, F.substring(raw, 18, 3)),
        F.substring(raw, 21, 12),
    )


def event_uid(fingerprint: Column) -> Column:
    return uuid5(EVENT_NAMESPACE, fingerprint)


def stix_id(kind: str, incident_id: Column, discriminator: Column) -> Column:
    """A repeatable STIX identifier: exporting the same incident twice gives the same document."""
    name = F.concat_ws("|", incident_id, F.lit(kind), discriminator)
    return F.concat(F.lit(kind + "--"), uuid5(EXPORT_NAMESPACE, name))


def rfc3339_millis(at: Column) -> Column:
    return F.date_format(at, "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'")


def rfc3339_micros(at: Column) -> Column:
    return F.date_format(at, "yyyy-MM-dd'T'HH:mm:ss.SSSSSS'Z'")


def at_millis(millis: Column) -> Column:
    """The instant of an epoch-millisecond value."""
    return F.timestamp_millis(millis)


def encode_cursor(time_ms: Column, uid: Column) -> Column:
    """An opaque page cursor: url-safe base64 of ``time:id``, without padding."""
    text = F.base64(F.encode(F.concat_ws(":", time_ms.cast("string"), uid), "UTF-8"))
    return F.regexp_replace(F.translate(text, "+/", "-_"), "[=\r\n]", "")


def decode_cursor(cursor: Column) -> Column:
    """``struct(time_ms, uid)`` of a cursor, null when it is not one."""
    standard = F.translate(cursor, "-_", "+/")
    padded = F.concat(standard, F.repeat(F.lit("="), (F.lit(4) - F.length(standard) % 4) % 4))
    text = F.try_to_binary(padded, F.lit("base64")).cast("string")
    time_ms = F.regexp_extract(text, r"^(-?[0-9]+):(.+)$", 1).try_cast("long")
    uid = F.regexp_extract(text, r"^(-?[0-9]+):(.+)$", 2)
    return F.when(time_ms.isNotNull(), F.struct(time_ms.alias("time_ms"), uid.alias("uid")))
