"""The parser registry: every ingest source names one of these."""

from __future__ import annotations

from casewright.operators.parsers import linux_auth, ocsf, windows_ntlm, windows_security, windows_sysmon
from casewright.operators.parsers.common import Parser

PARSERS: dict[str, Parser] = {
    "ocsf": ocsf.parse,
    "linux_auth": linux_auth.parse,
    "windows_security": windows_security.parse,
    "windows_sysmon": windows_sysmon.parse,
    "windows_ntlm": windows_ntlm.parse,
}

# The Windows channels and the parser that reads each.
CHANNEL_PARSERS = {
    "Security": "windows_security",
    "Microsoft-Windows-Sysmon/Operational": "windows_sysmon",
    "Microsoft-Windows-NTLM/Operational": "windows_ntlm",
}


def register_parser(name: str, parser: Parser) -> None:
    """Add a parser: a function from a DataFrame with ``raw`` to one with ``event`` and ``problem`` added."""
    PARSERS[name] = parser
