"""The rules the telemetry plans run: written against the telemetry view's fields."""

from __future__ import annotations

import json

from casewright.operators.rules import RuleSet, compile_rules

ENCODED_COMMAND = {
    "id": "b6a4c0de-0001-4c55-9d10-000000000001",
    "title": "PowerShell run with an encoded command",
    "level": "high",
    "tags": ["attack.execution", "attack.t1059.001"],
    "logsource": {"category": "process_creation", "product": "windows"},
    "detection": {
        "image": {"Image|endswith": ["\\powershell.exe", "\\pwsh.exe"]},
        "switch": {"CommandLine|contains": [" -enc ", " -e ", " -encodedcommand "]},
        "condition": "image and switch",
    },
}
PRIVILEGE_LISTING = {
    "id": "b6a4c0de-0002-4c55-9d10-000000000002",
    "title": "Privileges listed with whoami",
    "level": "low",
    "tags": ["attack.discovery", "attack.t1033"],
    "logsource": {"category": "process_creation"},
    "detection": {
        "image": {"Image|endswith": "\\whoami.exe"},
        "wanted_all": {"CommandLine|contains": "/all"},
        "wanted_priv": {"CommandLine|contains": "/priv"},
        "condition": "image and 1 of wanted_*",
    },
}
ADMIN_GROUP = {
    "id": "b6a4c0de-0003-4c55-9d10-000000000003",
    "title": "Domain administrators listed by an office program",
    "level": "medium",
    "tags": ["attack.discovery", "attack.t1069.002"],
    "logsource": {"category": "process_creation"},
    "detection": {
        "command": {"CommandLine|re|i": "net1?\\s+group\\s+\"domain admins\""},
        "shell": {"ParentImage|endswith": "\\explorer.exe"},
        "condition": "command and not shell",
    },
}
KNOWN_SITE = {
    "id": "b6a4c0de-0004-4c55-9d10-000000000004",
    "title": "Query for a watched site",
    "level": "informational",
    "tags": ["attack.command-and-control", "attack.t1071.004"],
    "logsource": {"category": "dns_query"},
    "detection": {"names": {"QueryName": ["site1?.example", "SITE7.example"]}, "condition": "names"},
}
PASSWORD_SPRAY = {
    "id": "b6a4c0de-0005-4c55-9d10-000000000005",
    "title": "One source fails as many accounts",
    "level": "medium",
    "tags": ["attack.credential_access", "attack.t1110.003"],
    "match": {"class_uid": 3002, "status_id": 2},
    "group_by": ["src_endpoint.ip"],
    "count_distinct": "user.name",
    "threshold": 4,
    "window": "24h",
}
REPEATED_CONNECTIONS = {
    "id": "b6a4c0de-0006-4c55-9d10-000000000006",
    "title": "One source keeps connecting to one external address",
    "level": "low",
    "tags": ["attack.command_and_control", "attack.t1071"],
    "match": {"class_uid": 4001, "dst_endpoint.ip|external": True},
    "group_by": ["src_endpoint.ip", "dst_endpoint.ip"],
    "threshold": 3,
    "window": "12h",
}
BUSY_SOURCE = {
    "id": "b6a4c0de-0007-4c55-9d10-000000000007",
    "title": "Several accounts fail on one log source",
    "level": "medium",
    "tags": ["attack.credential_access", "attack.t1110"],
    "match": {"class_uid": 3002, "status_id": 2},
    "group_by": ["sx.source_id"],
    "count_distinct": "user.name",
    "threshold": 3,
    "window": "24h",
}


def many_rules() -> list[dict]:
    """930 different single-event rules, as many as a large pack holds."""
    base = {"level": "low", "tags": ["attack.discovery"]}
    accounts = [
        base
        | {
            "id": f"account-{n}",
            "title": f"Account {n} runs something unusual",
            "logsource": {"category": "process_creation"},
            "detection": {
                "who": {"User": f"user{n}"},
                "usual-tools": {"Image|endswith": ["\\whoami.exe", "\\net.exe"]},
                "condition": "who and not usual-tools",
            },
        }
        for n in range(400)
    ]
    sites = [
        base
        | {
            "id": f"site-{n}",
            "title": f"Query for site {n}",
            "logsource": {"category": "dns_query"},
            "detection": {"a_name": {"QueryName|startswith": f"site{n}."}, "b_name": {"QueryName": f"site{n}"}, "condition": "1 of *_name"},
        }
        for n in range(300)
    ]
    addresses = [
        base
        | {
            "id": f"address-{n}",
            "title": f"Connection of kind {n}",
            "logsource": {"category": "network_connection"},
            "detection": {"to": {"DestinationIp|endswith": f".{n % 10}", "DestinationPort": [443, 8000 + n]}, "condition": "to"},
        }
        for n in range(230)
    ]
    return accounts + sites + addresses


SINGLE = (ENCODED_COMMAND, PRIVILEGE_LISTING, ADMIN_GROUP, KNOWN_SITE)
INVESTIGATION = (ENCODED_COMMAND, PRIVILEGE_LISTING, ADMIN_GROUP, PASSWORD_SPRAY)


def rulebook(*documents: dict) -> RuleSet:
    """Compile rule documents; needs an active session."""
    rules = compile_rules([(d["title"], json.dumps(d)) for d in documents])
    if rules.refused:
        raise ValueError(f"rules refused: {rules.refused}")
    return rules
