"""Addresses: canonical text, ranges and the internal/external split, all as built-in expressions.

Validity and the internal test are one regular expression each, so they stay inside generated code. Only the
canonical spelling of an IPv6 address needs more, and that branch runs for text holding a colon alone.
"""

from __future__ import annotations

import ipaddress
from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

_OCTET = r"(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[1-9]?[0-9])"
_QUAD = rf"{_OCTET}(?:\.{_OCTET}){{3}}"
IPV4 = rf"^{_QUAD}$"

# --- Fixed values: networks that cannot be reached from outside. Documentation ranges are external on purpose.
INTERNAL_NETWORKS = (
    "10.0.0.0/8",
    "172.16.0.0/12",
    "192.168.0.0/16",
    "100.64.0.0/10",
    "127.0.0.0/8",
    "169.254.0.0/16",
    "0.0.0.0/8",
    "224.0.0.0/4",
    "::1/128",
    "fc00::/7",
    "fe80::/10",
    "::/128",
    "ff00::/8",
)
# -----------------------------------------------------------------------------------------------------------


def _ipv6_pattern() -> str:
    group = "[0-9a-f]{1,4}"
    forms = [rf"(?:{group}:){{7}}{group}", rf"(?:{group}:){{6}}{_QUAD}"]
    for left in range(8):
        before = f"{group}(?::{group}){{{left - 1}}}" if left else ""
        after = rf"(?:{group}(?::{group}){{0,{6 - left}}})?" if left < 7 else ""
        forms.append(f"{before}::{after}")
        if left < 6:
            forms.append(rf"{before}::(?:{group}:){{0,{5 - left}}}{_QUAD}")
    return f"(?i)^(?:{'|'.join(forms)})$"


def _internal_ipv4_pattern() -> str:
    """The internal IPv4 networks as text prefixes: whole octets, then the values a split octet may take."""
    prefixes = []
    for cidr in INTERNAL_NETWORKS:
        network = ipaddress.ip_network(cidr)
        if network.version == 4:
            octets = network.network_address.packed
            whole, rest = divmod(network.prefixlen, 8)
            parts = [str(octet) for octet in octets[:whole]]
            if rest:
                span = range(octets[whole], octets[whole] + (1 << (8 - rest)))
                parts.append("(?:" + "|".join(map(str, span)) + ")")
            prefixes.append(r"\.".join(parts))
    return rf"^(?:{'|'.join(prefixes)})\."


IPV6 = _ipv6_pattern()
_INTERNAL_V4 = _internal_ipv4_pattern()
# fc00::/7, fe80::/10 and ff00::/8 by their first group; ::1 and :: in any spelling.
_INTERNAL_V6 = r"(?i)^(?:f[cd][0-9a-f]{2}:|fe[89ab][0-9a-f]:|ff[0-9a-f]{2}:|[0:]+0{0,3}[01]?$)"


def let(value: Column, use: Callable[[Column], Column]) -> Column:
    """Bind ``value`` once and use it many times: without this the expression tree doubles at every use."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def is_ip(text: Column) -> Column:
    # The cheap tests come first: a name is seldom worth either pattern.
    return (text.contains(":") & text.rlike(IPV6)) | (text.substr(-1, 1).between("0", "9") & text.rlike(IPV4))


def ipv4_number(text: Column) -> Column:
    """A dotted IPv4 address as a number; null for anything else."""
    octets = F.split(text, r"\.")
    number = F.get(octets, F.lit(0)).try_cast("long")
    for index in range(1, 4):
        number = number * 256 + F.get(octets, F.lit(index)).try_cast("long")
    return F.when(text.rlike(IPV4), number)


def ipv6_digits(text: Column) -> Column:
    """An IPv6 address as 32 lower-case hex digits; null for anything else."""

    def without_quad(lowered: Column) -> Column:
        # A trailing dotted quad is two more groups.
        quad = F.regexp_extract(lowered, r":([0-9]+\.[0-9.]+)$", 1)
        return F.when(
            quad != "",
            let(
                F.lpad(F.lower(F.hex(ipv4_number(quad))), 8, "0"),
                lambda tail: F.concat(
                    F.regexp_replace(lowered, r"[0-9.]+$", ""),
                    F.substring(tail, 1, 4),
                    F.lit(":"),
                    F.substring(tail, 5, 4),
                ),
            ),
        ).otherwise(lowered)

    def groups(side: Column) -> Column:
        return F.filter(F.split(F.coalesce(side, F.lit("")), ":"), lambda g: g != "")

    def filled(sides: Column) -> Column:
        # '::' stands for as many zero groups as are missing.
        missing = F.greatest(F.lit(8) - F.size(sides["l"]) - F.size(sides["r"]), F.lit(0))
        return F.concat(sides["l"], F.array_repeat(F.lit("0"), missing), sides["r"])

    def sides(plain: Column) -> Column:
        halves = F.split(plain, "::")
        return F.struct(groups(F.get(halves, F.lit(0))).alias("l"), groups(F.get(halves, F.lit(1))).alias("r"))

    digits = let(
        let(without_quad(F.lower(text)), sides),
        lambda both: F.array_join(F.transform(filled(both), lambda g: F.lpad(g, 4, "0")), ""),
    )
    return F.when(text.rlike(IPV6), digits)


def ipv6_text(digits: Column) -> Column:
    """The short form of 32 hex digits: no leading zeros, the first longest run of zero groups as '::'."""

    def spelled(whole: Column) -> Column:
        parts = [F.regexp_replace(F.substring(whole, 1 + 4 * i, 4), "^0{1,3}", "") for i in range(8)]
        return F.concat_ws(":", *parts)

    def shortened(text: Column) -> Column:
        result = text
        for run in range(2, 9):
            zeros = ":".join(["0"] * run)
            result = F.when(
                text.rlike(rf"(^|:){zeros}(:|$)"),
                F.regexp_replace(text, rf"^(.*?)(^|:){zeros}(:|$)", "$1::"),
            ).otherwise(result)
        return result

    return F.when(digits.isNotNull(), let(let(digits, spelled), shortened))


def canonical_ip(text: Column) -> Column:
    """The address in its canonical spelling; null when the text is not an address."""
    trimmed = F.trim(text)
    return F.when(trimmed.rlike(IPV4), trimmed).when(trimmed.contains(":"), ipv6_text(ipv6_digits(trimmed)))


def as_ip(text: Column) -> Column:
    """As ``canonical_ip``, with '-' and blank read as absent and an IPv4-mapped IPv6 address read as IPv4."""

    def short(digits: Column) -> Column:
        quad = F.concat_ws(".", *[F.conv(F.substring(digits, 25 + 2 * i, 2), 16, 10) for i in range(4)])
        return F.when(digits.startswith("00000000000000000000ffff"), quad).otherwise(ipv6_text(digits))

    trimmed = F.trim(text)
    return F.when(trimmed.rlike(IPV4), trimmed).when(trimmed.contains(":"), let(ipv6_digits(trimmed), short))


def in_network(text: Column, cidr: str) -> Column:
    """Whether the address lies in ``cidr``; text that is no address, or of the other family, does not."""
    network = ipaddress.ip_network(cidr)
    low, high = int(network.network_address), int(network.broadcast_address)
    trimmed = F.trim(text)
    if network.version == 4:
        inside = ipv4_number(trimmed).between(low, high)
    else:
        digits = F.when(trimmed.contains(":"), ipv6_digits(trimmed))
        inside = let(digits, lambda d: d.between(f"{low:032x}", f"{high:032x}"))
    return F.coalesce(inside, F.lit(False))


def is_external_ip(text: Column) -> Column:
    """True for an address outside every internal network; false for internal ones and for other text."""
    trimmed = F.trim(text)
    external = F.when(trimmed.rlike(IPV4), ~trimmed.rlike(_INTERNAL_V4)).otherwise(
        trimmed.contains(":") & trimmed.rlike(IPV6) & ~trimmed.rlike(_INTERNAL_V6)
    )
    return F.coalesce(external, F.lit(False))
