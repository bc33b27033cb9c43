"""Records of the stories that several tests read."""

from __future__ import annotations

import json


def raw_records(spark, rows, source="src", org="org"):
    """Records as JSON text, in order."""
    listed = [(org, source, position, json.dumps(row)) for position, row in enumerate(rows)]
    return spark.createDataFrame(listed, "org_id string, source_id string, position long, raw string")


STORY_SSH = [
    {"message": m}
    for m in (
        "2026-03-02T08:02:11.114812+00:00 web-7 sshd[104]: Accepted publickey for dana from 10.0.1.20 port 50022 ssh2",
        "2026-03-02T08:14:02.301442+00:00 web-7 sshd[211]: Invalid user admin from 203.0.113.9 port 41822",
        "2026-03-02T08:14:04.020377+00:00 web-7 sshd[213]: Failed password for invalid user backup from 203.0.113.9 port 41840 ssh2",
        "2026-03-02T08:14:05.771120+00:00 web-7 sshd[215]: Failed password for invalid user guest from 203.0.113.9 port 41852 ssh2",
        "2026-03-02T08:14:07.498856+00:00 web-7 sshd[217]: Failed password for root from 203.0.113.9 port 41866 ssh2",
        "2026-03-02T08:14:09.210533+00:00 web-7 sshd[219]: Failed password for root from 203.0.113.9 port 41878 ssh2",
        "2026-03-02T08:14:12.688791+00:00 web-7 sshd[223]: Failed password for build from 203.0.113.9 port 41904 ssh2",
        "2026-03-02T08:14:19.590018+00:00 web-7 sshd[231]: Accepted password for build from 203.0.113.9 port 41958 ssh2",
        "2026-03-02T08:14:19.602113+00:00 web-7 sshd[231]: pam_unix(sshd:session): session opened for user build",
    )
]


def _win(event_id, at, **data):
    return {
        "EventID": event_id,
        "EventRecordID": 1,
        "TimeCreated": f"2026-03-02T{at}Z",
        "Computer": "DESK-3.corp.example",
        "EventData": data,
    }


_ACTOR = {"SubjectUserName": "mkim", "SubjectDomainName": "CORP"}
STORY_WINDOWS = [
    _win(4624, "07:55:03.412", TargetUserName="mkim", TargetDomainName="CORP", LogonType="2", IpAddress="-"),
    *[
        _win(4625, f"08:40:1{n}.101", TargetUserName="mkim", TargetDomainName="CORP", LogonType="3", IpAddress="198.51.100.77")
        for n in range(6)
    ],
    _win(4624, "08:41:02.118", TargetUserName="mkim", TargetDomainName="CORP", LogonType="10", IpAddress="198.51.100.77"),
    _win(4688, "08:42:37.550", **_ACTOR, NewProcessName="C:\\Windows\\powershell.exe", CommandLine="powershell.exe -enc SQBFAFgA", NewProcessId="0x10"),
    _win(4688, "08:43:05.019", **_ACTOR, NewProcessName="C:\\Windows\\whoami.exe", CommandLine="whoami /all", ParentProcessName="C:\\Windows\\powershell.exe"),
    _win(4688, "08:43:21.740", **_ACTOR, NewProcessName="C:\\Windows\\net.exe", CommandLine='net group "Domain Admins" /domain'),
    _win(4634, "09:05:49.300", TargetUserName="mkim", TargetDomainName="CORP", LogonType="10"),
]
STORY_NETWORK = [
    {
        "class_uid": 4001,
        "activity_id": 6,
        "severity_id": 1,
        "time": 1772441100000 + 60_000 * n,  # 2026-03-02T08:45:00Z on
        "metadata": {"version": "1.1.0", "product": {"name": "Zeek"}},
        "src_endpoint": {"ip": "10.0.5.3", "hostname": "desk-3"},
        "dst_endpoint": {"ip": "192.0.2.200", "port": 443},
    }
    for n in range(5)
] + [
    {
        "class_uid": 4001,
        "activity_id": 6,
        "severity_id": 1,
        "time": 1772441000000,
        "metadata": {"version": "1.1.0", "product": {"name": "Zeek"}},
        "src_endpoint": {"ip": "10.0.5.9", "hostname": "desk-9"},
        "dst_endpoint": {"ip": "10.0.0.4", "port": 445, "hostname": "FILES"},
    }
]
