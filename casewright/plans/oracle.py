"""The SQL each registered query is checked against: the same results straight from the driver's tables.

Written independently of the Spark operators: self-joins where they use sliding sums, recursion where they
fold, plain windows where they cut time into chunks.
"""

from __future__ import annotations

ORACLE: dict[str, str] = {}

NOW_MS = 1_707_000_000_000

TEL = """
tel AS (
  SELECT event_id, 'org-1' AS org_id, 'src-' || (user_id % 3) AS source_id, sha256('ev' || event_id) AS event_uid,
    epoch_us(ts) // 1000 AS time_ms, k, event_type, user_id,
    CASE WHEN event_type IN ('error', 'click') THEN 3002 WHEN event_type = 'signup' THEN 1007
         WHEN event_type = 'purchase' THEN 4001 WHEN event_type = 'view' THEN 4003 END AS class_uid,
    CASE WHEN event_type = 'purchase' THEN 6 ELSE 1 END AS activity_id,
    CASE WHEN event_type = 'error' THEN 2 ELSE 1 END AS status_id,
    CASE WHEN event_type = 'error' THEN 2 ELSE 1 END AS severity_id,
    'WS-' || (user_id % 20) || '.corp.example' AS device_hostname,
    'ws-' || (user_id % 20) AS host,
    CASE WHEN user_id % 5 = 0 THEN '10.0.0.' || (user_id % 50) ELSE '198.51.100.' || (user_id % 12) END AS src_ip,
    CASE WHEN event_type = 'purchase' THEN '192.0.2.' || (k % 10) END AS dst_ip,
    CASE WHEN event_type = 'purchase' THEN CASE WHEN k % 2 = 0 THEN 443 ELSE 8080 END END AS dst_port,
    'user' || user_id AS user_name,
    CASE WHEN user_id % 7 <> 0 THEN 'CORP' END AS user_domain,
    CASE WHEN user_id % 7 <> 0 THEN 'corp\\user' || user_id ELSE 'user' || user_id || '@ws-' || (user_id % 20) END AS scoped,
    CASE WHEN event_type = 'signup' THEN ['powershell.exe', 'whoami.exe', 'net.exe', 'notepad.exe'][k % 4 + 1] END AS process_name,
    CASE WHEN event_type = 'signup' THEN CASE WHEN k % 3 = 0 THEN 'WINWORD.EXE' ELSE 'explorer.exe' END END AS parent_name,
    CASE WHEN event_type = 'signup' THEN ['powershell.exe -enc AAAA', 'whoami /all',
      'net group "Domain Admins" /domain', 'notepad.exe a.txt'][k % 4 + 1] END AS cmd_line,
    CASE WHEN event_type = 'view' THEN 'site' || (k % 15) || '.example' END AS query_hostname
  FROM (SELECT *, CAST(regexp_extract(props, '"k": ([0-9]+)', 1) AS INTEGER) AS k FROM events)
)"""

# The entities of each event, in the operators' fixed order.
SIGHTINGS = """
sight AS (
  SELECT event_uid, source_id, time_ms, class_uid, 'device.hostname' AS field, 'host:' || host AS entity_key, true AS links, 1 AS ord FROM tel
  UNION ALL SELECT event_uid, source_id, time_ms, class_uid, 'src_endpoint.ip', 'ip:' || src_ip, src_ip NOT LIKE '10.%', 2 FROM tel WHERE class_uid IN (3002, 4001)
  UNION ALL SELECT event_uid, source_id, time_ms, class_uid, 'dst_endpoint.ip', 'ip:' || dst_ip, true, 3 FROM tel WHERE class_uid = 4001
  UNION ALL SELECT event_uid, source_id, time_ms, class_uid, CASE WHEN class_uid = 3002 THEN 'user.name' ELSE 'actor.user.name' END, 'user:' || scoped, true, 4
    FROM tel WHERE class_uid IN (3002, 1007)
  UNION ALL SELECT event_uid, source_id, time_ms, class_uid, 'query.hostname', 'domain:' || query_hostname, true, 5 FROM tel WHERE class_uid = 4003
  UNION ALL SELECT event_uid, source_id, time_ms, class_uid, 'process.name', 'process:' || process_name, false, 6 FROM tel WHERE class_uid = 1007
  UNION ALL SELECT event_uid, source_id, time_ms, class_uid, 'process.parent_process.name', 'process:' || lower(parent_name), false, 7 FROM tel WHERE class_uid = 1007
  UNION ALL SELECT event_uid, source_id, time_ms, class_uid, 'process.file.path', 'file:C:\\Windows\\System32\\' || process_name, false, 8 FROM tel WHERE class_uid = 1007
)"""

RELATIONS = """
rel AS (
  SELECT event_uid, source_id, time_ms, dst_port, 'ip:' || src_ip AS source, CASE WHEN status_id = 2 THEN 'failed_logon' ELSE 'logon' END AS relation, 'host:' || host AS target FROM tel WHERE class_uid = 3002
  UNION ALL SELECT event_uid, source_id, time_ms, dst_port, 'host:' || host, CASE WHEN status_id = 2 THEN 'failed_logon_as' ELSE 'logon_as' END, 'user:' || scoped FROM tel WHERE class_uid = 3002
  UNION ALL SELECT event_uid, source_id, time_ms, dst_port, 'host:' || host, 'ran_as', 'user:' || scoped FROM tel WHERE class_uid = 1007
  UNION ALL SELECT event_uid, source_id, time_ms, dst_port, 'user:' || scoped, 'started', 'process:' || process_name FROM tel WHERE class_uid = 1007
  UNION ALL SELECT event_uid, source_id, time_ms, dst_port, 'process:' || lower(parent_name), 'spawned', 'process:' || process_name FROM tel WHERE class_uid = 1007
  UNION ALL SELECT event_uid, source_id, time_ms, dst_port, 'process:' || process_name, 'image', 'file:C:\\Windows\\System32\\' || process_name FROM tel WHERE class_uid = 1007
  UNION ALL SELECT event_uid, source_id, time_ms, dst_port, 'host:' || host, 'connected_to', 'ip:' || dst_ip FROM tel WHERE class_uid = 4001
  UNION ALL SELECT event_uid, source_id, time_ms, dst_port, 'host:' || host, 'connected_to', 'ip:' || src_ip FROM tel WHERE class_uid = 4001 AND src_ip NOT LIKE '10.%'
  UNION ALL SELECT event_uid, source_id, time_ms, dst_port, 'host:' || host, 'queried', 'domain:' || query_hostname FROM tel WHERE class_uid = 4003
)"""

LABELS = """CASE relation WHEN 'failed_logon' THEN 'failed logon to' WHEN 'logon' THEN 'logged on to' WHEN 'failed_logon_as' THEN 'failed logon as'
  WHEN 'logon_as' THEN 'logged on as' WHEN 'ran_as' THEN 'ran processes as' WHEN 'started' THEN 'started' WHEN 'spawned' THEN 'spawned'
  WHEN 'image' THEN 'image' WHEN 'connected_to' THEN 'connected to' WHEN 'queried' THEN 'queried' END"""

# Evidence digests' folding key, with steps found by LAG over the whole incident.
STEPS = """
dig AS (
  SELECT event_uid, source_id AS incident_id, time_ms, host, scoped, query_hostname, cmd_line, dst_port,
    CASE WHEN class_uid = 3002 THEN CASE WHEN status_id = 2 THEN 'Failed logon' ELSE 'Logged on' END WHEN class_uid = 1007 THEN 'Process started'
         WHEN class_uid = 4001 THEN 'Network connection' ELSE 'DNS query' END AS action,
    CASE WHEN status_id = 2 THEN 'failure' ELSE 'success' END AS outcome,
    CASE WHEN class_uid = 3002 THEN src_ip WHEN class_uid = 4001 THEN dst_ip END AS remote,
    process_name AS process, lower(parent_name) AS parent, class_uid
  FROM tel
),
lagged AS (
  SELECT *, lag(time_ms) OVER w AS p_time, lag(action) OVER w AS p_action, lag(outcome) OVER w AS p_outcome, lag(host) OVER w AS p_host,
    lag(remote) OVER w AS p_remote, lag(process) OVER w AS p_process, lag(parent) OVER w AS p_parent
  FROM dig WINDOW w AS (PARTITION BY incident_id ORDER BY time_ms, event_uid)
),
starts AS (
  SELECT *, CASE WHEN p_time IS NULL OR time_ms - p_time > 600000 OR action <> p_action OR outcome <> p_outcome OR host <> p_host
    OR remote IS DISTINCT FROM p_remote OR process IS DISTINCT FROM p_process OR parent IS DISTINCT FROM p_parent THEN event_uid END AS start_uid
  FROM lagged
),
members AS (
  SELECT *, last_value(start_uid IGNORE NULLS) OVER (PARTITION BY incident_id ORDER BY time_ms, event_uid ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS step_id
  FROM starts
)"""

# Observations per event.
OBSERVED = """
remotes AS (
  SELECT event_uid, source_id, time_ms, host, src_ip AS remote FROM tel WHERE class_uid IN (3002, 4001) AND src_ip NOT LIKE '10.%'
  UNION ALL SELECT event_uid, source_id, time_ms, host, dst_ip FROM tel WHERE class_uid = 4001
  UNION ALL SELECT event_uid, source_id, time_ms, host, query_hostname FROM tel WHERE class_uid = 4003
),
observed AS (
  SELECT event_uid, source_id, time_ms, 'process_pair' AS kind, lower(parent_name) || ' -> ' || process_name AS key FROM tel WHERE class_uid = 1007
  UNION ALL SELECT event_uid, source_id, time_ms, 'remote', remote FROM remotes
  UNION ALL SELECT event_uid, source_id, time_ms, 'host_remote', host || ' -> ' || remote FROM remotes
)"""

# The single-event rules of the rulebook, as they read on the telemetry.
SINGLE = """
single AS (
  SELECT event_uid, source_id, time_ms, k, 'PowerShell run with an encoded command' AS rule_title, 'b6a4c0de-0001-4c55-9d10-000000000001' AS rule_id, 4 AS severity_id, 'T1059.001' AS technique, 'execution' AS tactic
    FROM tel WHERE class_uid = 1007 AND process_name = 'powershell.exe'
  UNION ALL SELECT event_uid, source_id, time_ms, k, 'Privileges listed with whoami', 'b6a4c0de-0002-4c55-9d10-000000000002', 2, 'T1033', 'discovery' FROM tel WHERE class_uid = 1007 AND process_name = 'whoami.exe'
  UNION ALL SELECT event_uid, source_id, time_ms, k, 'Domain administrators listed by an office program', 'b6a4c0de-0003-4c55-9d10-000000000003', 3, 'T1069.002', 'discovery'
    FROM tel WHERE class_uid = 1007 AND process_name = 'net.exe' AND parent_name <> 'explorer.exe'
  UNION ALL SELECT event_uid, source_id, time_ms, k, 'Query for a watched site', 'b6a4c0de-0004-4c55-9d10-000000000004', 1, 'T1071.004', 'command_and_control'
    FROM tel WHERE class_uid = 4003 AND (regexp_matches(query_hostname, '^site1.\\.example$') OR query_hostname = 'site7.example')
),
single_f AS (SELECT *, sha256(rule_id || chr(31) || event_uid || chr(31)) AS finding_id FROM single)"""


def _threshold(where: str, group: str, value: str, threshold: int, window_ms: int) -> str:
    """Counts by self-join, firings by recursion, evidence by rank."""
    return f"""
m AS (SELECT {group} AS g, event_uid, time_ms, {value} AS v FROM tel WHERE {where}),
counted AS (
  SELECT a.g, a.event_uid, a.time_ms, count(DISTINCT b.v) AS seen FROM m a JOIN m b
    ON b.g = a.g AND b.time_ms >= a.time_ms - {window_ms} AND (b.time_ms < a.time_ms OR (b.time_ms = a.time_ms AND b.event_uid <= a.event_uid))
  GROUP BY ALL),
q AS (SELECT g, time_ms, min(event_uid) AS trigger_uid FROM counted WHERE seen >= {threshold} GROUP BY g, time_ms),
f AS (
  SELECT g, min(time_ms) AS at_ms FROM q GROUP BY g
  UNION ALL SELECT f.g, min(q.time_ms) FROM f JOIN q ON q.g = f.g AND q.time_ms >= f.at_ms + {window_ms} GROUP BY f.g),
fired AS (SELECT f.g, f.at_ms, q.trigger_uid FROM f JOIN q ON q.g = f.g AND q.time_ms = f.at_ms),
ev AS (
  SELECT x.g, x.at_ms, m.event_uid, m.time_ms, m.v, row_number() OVER (PARTITION BY x.g, x.at_ms ORDER BY m.time_ms, m.event_uid) AS rn
  FROM fired x JOIN m ON m.g = x.g AND m.time_ms >= x.at_ms - {window_ms} AND (m.time_ms < x.at_ms OR (m.time_ms = x.at_ms AND m.event_uid <= x.trigger_uid)))"""


_SPRAY = _threshold("class_uid = 3002 AND status_id = 2", "src_ip", "user_name", 4, 86_400_000)
_BUSY = _threshold("class_uid = 3002 AND status_id = 2", "source_id", "user_name", 3, 86_400_000)
_REPEAT = _threshold("class_uid = 4001", "src_ip || '|' || dst_ip", "event_uid", 3, 43_200_000)
_SPRAY_ID = "b6a4c0de-0005-4c55-9d10-000000000005"


def sql(name: str, *ctes: str, recursive: bool = False):
    """Register ``WITH ctes <body>`` under ``name``."""

    def add(body: str) -> None:
        head = f"WITH {'RECURSIVE ' if recursive else ''}{','.join(ctes)}" if ctes else ""
        ORACLE[name] = f"{head}\n{body}"

    return add


# ----------------------------------------------------------------------------------------- sources and parsers
_LINES = """
lines AS (
  SELECT *, strftime(make_timestamp(time_ms * 1000), '%Y-%m-%dT%H:%M:%S.') || lpad((time_ms % 1000)::VARCHAR, 3, '0') || 'Z' AS stamp,
    ' web-' || (event_id % 4) || ' ' AS h, 'sshd[' || (1000 + event_id % 500) || ']: ' AS ssh,
    user_name || ' from ' || src_ip || ' port ' || (40000 + event_id % 1000) AS origin FROM tel)"""
sql("sshd_lines", TEL, _LINES)("""
SELECT event_id, stamp || h || CASE WHEN class_uid = 1007 THEN ssh || 'Invalid user ' || origin
  WHEN status_id = 2 THEN ssh || 'Failed password for ' || CASE WHEN k % 4 = 0 THEN 'invalid user ' ELSE '' END || origin || ' ssh2'
  WHEN class_uid = 3002 THEN ssh || 'Accepted publickey for ' || origin || ' ssh2' ELSE ssh || 'pam_unix(sshd:session): session opened' END AS message
FROM lines WHERE class_uid <> 4003""")
sql("linux_auth_events", TEL)("""
SELECT event_id, 3002 AS class_uid, 1 AS activity_id, CASE WHEN class_uid = 3002 AND status_id = 1 THEN 1 ELSE 2 END AS status_id,
  CASE WHEN class_uid = 3002 AND status_id = 1 THEN 1 ELSE 2 END AS severity_id, time_ms, user_name, src_ip, CAST(40000 + event_id % 1000 AS INTEGER) AS src_port,
  'web-' || (event_id % 4) AS host,
  CASE WHEN class_uid = 1007 THEN 'true' WHEN status_id = 1 THEN 'false' WHEN k % 4 = 0 THEN 'true' ELSE 'false' END AS invalid_user,
  CASE WHEN class_uid = 1007 THEN NULL WHEN status_id = 2 THEN 'password' ELSE 'publickey' END AS auth_method
FROM tel WHERE class_uid IN (3002, 1007)""")
sql("linux_auth_rejects", TEL)("""
SELECT 'parse_error' AS kind, CASE WHEN class_uid = 4001 THEN 'sshd message is not an authentication outcome' ELSE 'not an sshd syslog line' END AS reason, count(*) AS n
FROM tel WHERE class_uid IN (4001, 4003) GROUP BY ALL""")
sql("ingest_reports", TEL)("""
SELECT source_id, count(*) FILTER (class_uid IN (3002, 1007)) AS accepted, count(*) FILTER (class_uid NOT IN (3002, 1007)) AS rejected,
  max(time_ms) FILTER (class_uid IN (3002, 1007)) AS last_event_ms,
  array_to_string(list_slice(list(event_id ORDER BY event_id) FILTER (class_uid NOT IN (3002, 1007)), 1, 50), ',') AS first_errors
FROM tel GROUP BY source_id""")

_SECURITY = """
sec AS (SELECT *, [4624, 4625, 4634, 4647, 4648, 4672, 4688, 4768, 4769, 4771, 4776, 4663][event_id % 12 + 1] AS id FROM tel)"""
sql("windows_security_events", TEL, _SECURITY)("""
SELECT event_id, CASE WHEN id = 4672 THEN 3003 WHEN id = 4688 THEN 1007 ELSE 3002 END AS class_uid,
  CASE id WHEN 4624 THEN 1 WHEN 4625 THEN 1 WHEN 4634 THEN 2 WHEN 4647 THEN 2 WHEN 4648 THEN 7 WHEN 4672 THEN 1 WHEN 4688 THEN 1 WHEN 4768 THEN 3 WHEN 4769 THEN 4 WHEN 4771 THEN 6 ELSE 1 END AS activity_id,
  st AS status_id, CASE WHEN st = 2 THEN 2 ELSE 1 END AS severity_id,
  CASE WHEN id <> 4688 THEN user_name END AS user_name,
  CASE WHEN id IN (4624, 4625, 4648, 4768, 4769, 4771) AND k % 5 <> 0 THEN src_ip END AS src_ip,
  CASE WHEN id IN (4624, 4625, 4648, 4768, 4769, 4771) THEN 40000 + k END AS src_port,
  CASE WHEN id = 4648 THEN 'fs-1' WHEN id IN (4624, 4625, 4768, 4769, 4771, 4776) THEN device_hostname END AS dst_host,
  CASE WHEN id IN (4768, 4769, 4771) THEN 2 WHEN id = 4776 THEN 1 WHEN id IN (4624, 4625) AND k % 3 = 0 THEN 1 END AS auth_protocol_id,
  CASE WHEN id IN (4624, 4625, 4634, 4647) THEN ['Interactive', 'Network', 'RemoteInteractive'][k % 3 + 1] END AS logon_type,
  CASE WHEN id = 4688 THEN 'cmd.exe' END AS process_name, CASE WHEN id = 4688 THEN CAST(k + 16 AS BIGINT) END AS pid,
  CASE WHEN id = 4688 THEN 'explorer.exe' END AS parent_name, CASE WHEN id IN (4768, 4769, 4771) THEN 'krbtgt' END AS service_name,
  CASE WHEN id = 4672 THEN CAST(2 AS BIGINT) END AS privileges
FROM (SELECT *, CASE WHEN id IN (4624, 4634, 4647, 4688) THEN 1 WHEN id IN (4625, 4771) THEN 2 WHEN id IN (4648, 4672) THEN 0 WHEN k % 2 = 0 THEN 1 ELSE 2 END AS st FROM sec)
WHERE id <> 4663 AND NOT (id = 4688 AND k % 10 = 9)""")
sql("windows_security_rejects", TEL, _SECURITY)("""
SELECT CASE WHEN id = 4663 THEN 'unsupported' ELSE 'parse_error' END AS kind,
  CASE WHEN id = 4663 THEN 'unsupported Windows Security event 4663' ELSE '4688 event has no NewProcessName' END AS reason, count(*) AS n
FROM sec WHERE id = 4663 OR (id = 4688 AND k % 10 = 9) GROUP BY ALL""")

_SYSMON = """
sys AS (SELECT *, [1, 3, 5, 7, 8, 10, 11, 12, 13, 14, 22, 23, 99][event_id % 13 + 1] AS id,
  ['CreateKey', 'DeleteKey', 'DeleteValue', 'SetValue', 'RenameKey', 'Unknown'][k % 6 + 1] AS rt FROM tel)"""
sql("sysmon_events", TEL, _SYSMON)("""
SELECT event_id, CASE WHEN id IN (1, 5, 8, 10) THEN 1007 WHEN id = 3 THEN 4001 WHEN id = 7 THEN 1005 WHEN id IN (11, 23) THEN 1001 WHEN id = 22 THEN 4003
    WHEN rt IN ('DeleteValue', 'SetValue') THEN 201002 ELSE 201001 END AS class_uid,
  CASE WHEN id IN (1, 3, 7, 11, 22) THEN 1 WHEN id = 5 THEN 2 WHEN id = 8 THEN 4 WHEN id = 10 THEN 3 WHEN id = 23 THEN 4
    WHEN rt = 'CreateKey' THEN 1 WHEN rt IN ('DeleteKey', 'DeleteValue') THEN 4 WHEN rt = 'SetValue' THEN 2 ELSE 5 END AS activity_id,
  CASE WHEN id = 22 AND k % 4 = 0 THEN 2 ELSE 1 END AS status_id,
  CASE WHEN id IN (1, 5) THEN 'agent.exe' WHEN id IN (8, 10) THEN 'lsass.exe' END AS process_name,
  CASE WHEN id IN (8, 10) THEN 'probe.exe' WHEN id NOT IN (1, 5) THEN 'agent.exe' END AS actor_name,
  CASE WHEN id NOT IN (1, 5, 8, 10) THEN user_name END AS actor_user,
  CASE WHEN id = 3 THEN '192.0.2.' || (k % 10) END AS dst_ip,
  CASE WHEN id = 3 THEN CASE WHEN k % 2 = 0 THEN 2 ELSE 1 END END AS direction_id,
  CASE WHEN id = 10 THEN CAST(k AS BIGINT) END AS actual_permissions,
  CASE WHEN id IN (11, 23) THEN 'C:\\Temp\\drop.txt' END AS file_path,
  CASE WHEN id IN (11, 23) THEN md5(user_name) || ',' || sha256(user_name) END AS file_hashes,
  CASE WHEN id IN (12, 13, 14) THEN 'HKLM\\Software\\Run\\v' || k END AS reg_path,
  CASE WHEN id IN (12, 13, 14) AND rt IN ('DeleteValue', 'SetValue') THEN 'v' || k END AS value_name,
  CASE WHEN id = 22 THEN 'site' || (k % 15) || '.example' END AS query_name,
  CASE WHEN id = 22 THEN '192.0.2.' || (k % 10) END AS answers
FROM sys WHERE id <> 99 AND NOT (id = 7 AND k % 10 = 3) AND NOT (id IN (12, 13, 14) AND rt = 'Unknown')""")
sql("sysmon_rejects", TEL, _SYSMON)("""
SELECT CASE WHEN id = 99 THEN 'unsupported' ELSE 'parse_error' END AS kind,
  CASE WHEN id = 99 THEN 'unsupported Sysmon event 99' WHEN id = 7 THEN 'Sysmon event 7 has no ImageLoaded' ELSE 'unsupported Sysmon registry EventType Unknown' END AS reason, count(*) AS n
FROM sys WHERE id = 99 OR (id = 7 AND k % 10 = 3) OR (id IN (12, 13, 14) AND rt = 'Unknown') GROUP BY ALL""")
sql("ntlm_events", TEL)("""
SELECT event_id, CASE WHEN event_id % 2 = 1 THEN 'unsupported' WHEN k % 9 = 0 THEN 'parse_error' END AS problem,
  CASE WHEN event_id % 2 = 0 AND k % 9 <> 0 THEN 0 END AS status_id,
  CASE WHEN event_id % 2 = 0 AND k % 9 <> 0 THEN user_name END AS user_name,
  CASE WHEN event_id % 2 = 0 AND k % 9 <> 0 THEN user_domain END AS user_domain,
  CASE WHEN event_id % 2 = 0 AND k % 9 <> 0 AND k % 4 <> 0 THEN 'WKS' || k END AS workstation FROM tel""")

_OCSF = """
ocsf AS (SELECT *, CASE
  WHEN k = 0 THEN 'not an OCSF event: class_uid is missing'
  WHEN k = 4 THEN 'severity_id: not a known severity'
  WHEN k = 5 THEN 'time: must be epoch milliseconds or an RFC 3339 string'
  WHEN k = 7 THEN 'metadata.version: only OCSF 1.x events are supported'
  WHEN k = 9 AND class_uid IN (3002, 4001) THEN 'src_endpoint.port: must be between 0 and 65535'
  WHEN k = 2 THEN 'category_uid 9 does not match class_uid ' || class_uid
  WHEN k = 1 THEN 'activity_id 77 is not defined for ' || CASE class_uid WHEN 3002 THEN 'Authentication' WHEN 1007 THEN 'Process Activity' WHEN 4001 THEN 'Network Activity' ELSE 'DNS Activity' END
  WHEN k = 3 THEN 'type_uid must be ' || (class_uid * 100 + activity_id)
  WHEN k = 8 AND class_uid = 3002 THEN 'Authentication events require user'
  WHEN k = 6 THEN 'time is more than 24 hours in the future' END AS reason FROM tel)"""
sql("ocsf_validation", TEL, _OCSF)("""
SELECT CASE WHEN k = 0 THEN 'parse_error' WHEN reason IS NOT NULL THEN 'invalid' END AS kind, reason, count(*) AS n FROM ocsf GROUP BY ALL""")
sql("ocsf_events", TEL, _OCSF)("""
SELECT time_ms, class_uid, CASE class_uid WHEN 3002 THEN 3 WHEN 1007 THEN 1 ELSE 4 END AS category_uid, CAST(class_uid * 100 + activity_id AS BIGINT) AS type_uid,
  CASE class_uid WHEN 3002 THEN 'Authentication' WHEN 1007 THEN 'Process Activity' WHEN 4001 THEN 'Network Activity' ELSE 'DNS Activity' END AS class_name,
  CASE class_uid WHEN 3002 THEN 'Identity & Access Management' WHEN 1007 THEN 'System Activity' ELSE 'Network Activity' END AS category_name,
  CASE class_uid WHEN 3002 THEN 'Logon' WHEN 1007 THEN 'Launch' WHEN 4001 THEN 'Traffic' ELSE 'Query' END AS activity_name,
  CASE severity_id WHEN 2 THEN 'Low' ELSE 'Informational' END AS severity, CASE status_id WHEN 2 THEN 'Failure' ELSE 'Success' END AS status,
  concat_ws(',', CASE WHEN class_uid IN (3002, 4001) THEN 'src_endpoint.ip=' || src_ip END, 'device.hostname=' || device_hostname,
    CASE WHEN class_uid = 3002 THEN 'user.name=' || user_name END, CASE WHEN class_uid = 1007 THEN 'process.name=' || process_name END,
    CASE WHEN class_uid = 4003 THEN 'query.hostname=' || query_hostname END) AS observables
FROM ocsf WHERE reason IS NULL""")
ORACLE["content_fingerprints"] = f"""WITH {TEL},{_OCSF},
content AS (
  SELECT class_uid, count(*) AS n, concat_ws('|', source_id, time_ms, device_hostname,
    CASE WHEN class_uid = 3002 THEN user_name END, CASE WHEN class_uid IN (3002, 4001) THEN src_ip || '/' || (k = 9) END,
    CASE WHEN class_uid = 1007 THEN process_name END, CASE WHEN class_uid = 4003 THEN query_hostname END, severity_id, status_id,
    -- the raw record is part of the content
    k IN (0, 1, 2, 3, 4, 5, 6, 7)) AS body
  FROM ocsf WHERE reason IS NULL GROUP BY ALL)
SELECT class_uid, CAST(2 * sum(n) AS BIGINT) AS rows, count(*) AS contents, count(*) AS well_formed FROM content GROUP BY class_uid"""
sql("event_ids", TEL)("""
, fp AS (SELECT event_id, sha256(org_id || chr(31) || source_id || chr(31) || event_uid || chr(31)) AS fingerprint FROM tel),
raw AS (SELECT *, sha1(unhex('0d5a2f7e61c35b0e9a443f1be7c8d210') || encode(fingerprint)) AS h FROM fp)
SELECT event_id, fingerprint, h[1:8] || '-' || h[9:12] || '-5' || h[14:16] || '-' || '89ab'[(instr('0123456789abcdef', h[17]) - 1) % 4 + 1] || h[18:20] || '-' || h[21:32] AS uid FROM raw""")
sql("event_times", TEL)("""
SELECT event_id, CASE WHEN k % 5 IN (0, 2) THEN time_ms WHEN k % 5 IN (1, 3) THEN time_ms // 1000 * 1000 END AS read_ms FROM tel""")
sql("source_join", TEL)("""
SELECT source_id, org_id, 'ocsf' AS parser, count(*) AS records FROM tel WHERE source_id <> 'src-1' GROUP BY ALL""")
sql("redacted_evidence", TEL)("""
SELECT event_uid, CASE WHEN source_id = 'src-0' THEN concat_ws(' ', 'event', event_id, user_name, cmd_line) END AS raw_data FROM tel""")
sql("xml_records", TEL)("""
, copies AS (SELECT *, unnest(CASE WHEN k IN (13, 14) THEN [0] ELSE [0, 1] END) AS position FROM tel)
SELECT event_id, CAST(position AS INTEGER) AS position,
  CASE WHEN k = 13 THEN 'document type declarations are not allowed' WHEN k = 14 THEN 'event has no readable System element' END AS problem,
  CASE WHEN k NOT IN (13, 14) THEN 'Security' END AS channel,
  CASE WHEN k NOT IN (13, 14) THEN CASE WHEN k % 2 = 0 THEN '4624' ELSE '4625' END END AS code,
  CASE WHEN k NOT IN (13, 14) THEN device_hostname END AS computer, CASE WHEN k NOT IN (13, 14) THEN user_name END AS user_name,
  CASE WHEN k NOT IN (13, 14) THEN src_ip END AS ip FROM copies""")
sql("rendered_records", TEL)("""
SELECT event_id, CASE WHEN k = 7 THEN 'record has no numeric EventCode' END AS problem,
  CASE WHEN k <> 7 THEN strftime(make_timestamp(time_ms * 1000), '%Y-%m-%dT%H:%M:%SZ') END AS created, CASE WHEN k <> 7 THEN device_hostname END AS computer,
  CASE WHEN k <> 7 THEN user_name END AS user_name, CASE WHEN k <> 7 THEN 'S-1-5-21-' || user_id END AS sid, CAST(NULL AS VARCHAR) AS subject_sid,
  CASE WHEN k <> 7 THEN '3' END AS logon_type, CASE WHEN k <> 7 THEN src_ip END AS ip, CASE WHEN k <> 7 AND k % 6 <> 0 THEN '443' END AS port FROM tel""")
sql("export_routing", TEL)("""
, r AS (SELECT *, k % 8 AS s, k % 11 = 0 AND k % 8 NOT IN (0, 4, 5) AS blank FROM tel)
SELECT CASE WHEN s = 7 OR blank OR s IN (2, 5, 6) THEN NULL WHEN s = 0 THEN CASE WHEN k % 3 = 0 THEN NULL ELSE 'windows_security' END WHEN s = 1 THEN 'windows_security' WHEN s = 3 THEN 'linux_auth' ELSE 'ocsf' END AS parser,
  CASE WHEN s = 7 THEN 'result has no sourcetype' WHEN blank THEN 'result has no _raw' WHEN s = 6 THEN 'stream:http: no parser is mapped to this sourcetype'
    WHEN s = 0 AND k % 3 = 0 THEN 'XmlWinEventLog:Security: no parser for channel Setup' WHEN s = 2 THEN 'WinEventLog:Setup: no parser for channel Setup'
    WHEN s = 5 THEN '_json: JSON without class_uid is not an OCSF event' END AS reason, count(*) AS results
FROM r GROUP BY ALL""")
sql("json_bodies", TEL)("""
SELECT event_id, CAST(CASE k % 4 WHEN 0 THEN 1 WHEN 1 THEN 2 WHEN 2 THEN 3 ELSE 0 END AS BIGINT) AS records, CAST(CASE WHEN k % 4 = 3 THEN 1 ELSE 0 END AS BIGINT) AS problems,
  CASE WHEN k % 4 <> 3 THEN event_id END AS id FROM tel""")
sql("replay_shift", TEL)(f"""
SELECT event_id, time_ms + ({NOW_MS} - 300000 - (SELECT max(time_ms) FROM tel)) AS time_ms FROM tel""")

# ------------------------------------------------------------------------------------------------------- sinks
_COPIES = "copies AS (SELECT *, CASE WHEN k % 9 = 0 THEN 3 WHEN k % 3 = 0 THEN 2 ELSE 1 END AS n FROM tel)"
sql("first_copies", TEL)("SELECT event_uid, time_ms + 60000 AS ingested_ms FROM tel")
sql("new_events", TEL)("SELECT class_uid, count(*) AS n FROM tel WHERE time_ms >= 1705000000000 GROUP BY class_uid")
sql("index_outcome", TEL, _COPIES)("""
SELECT count(*) FILTER (time_ms >= 1705000000000) AS indexed, CAST(sum(CASE WHEN time_ms >= 1705000000000 THEN n - 1 ELSE n END) AS BIGINT) AS duplicates FROM copies""")
sql("retained_events", TEL)("""
SELECT CASE class_uid WHEN 3002 THEN 'iam' WHEN 1007 THEN 'system' ELSE 'network' END AS category, strftime(make_timestamp(time_ms * 1000), '%Y-%m-%d') AS day, count(*) AS n
FROM tel WHERE make_timestamp(time_ms * 1000) >= DATE '2024-01-21' GROUP BY ALL""")
sql("source_health", TEL)("""
, s AS (SELECT user_name, max(time_ms) FILTER (k <> 50) AS le, max(time_ms) FILTER (status_id = 2) AS er, max(k) <> 99 AS en FROM tel GROUP BY user_name)
SELECT CASE WHEN NOT en THEN 'disabled' WHEN er IS NOT NULL AND 1706659200000 - er < 86400000 AND (le IS NULL OR er > le) THEN 'erroring'
  WHEN le IS NULL THEN 'awaiting_data' WHEN 1706659200000 - le > 86400000 THEN 'stale' ELSE 'healthy' END AS health, count(*) AS sources FROM s GROUP BY ALL""")
sql("ingest_latency", TEL)("""
SELECT source_id, max(greatest(0, 1705000000000 - (time_ms + 60000))) AS max_lag_ms, max(greatest(0, 1705000000000 - time_ms)) AS max_age_ms FROM tel GROUP BY source_id""")

# --------------------------------------------------------------------------------------------------- predicates
sql("field_predicates", TEL)("""
SELECT event_uid, coalesce(process_name = 'whoami.exe', false) AS glob_ends, coalesce(process_name = 'net.exe', false) AS glob_middle, false AS glob_cased,
  coalesce(process_name = 'powershell.exe', false) AS regex, k = 7 AS number_text, k < 10 AS number_below, coalesce(dst_port <> 443, false) AS number_other, false AS flag,
  coalesce(dst_ip IS NOT NULL AND k % 10 < 8, false) AS in_network, class_uid IN (3002, 4001) AND src_ip NOT LIKE '10.%' AS external,
  class_uid = 3002 AND user_name = 'user7' AS equals_text, class_uid = 3002 AS equals_number, class_uid = 3002 AND user_domain IS NOT NULL AS present,
  NOT (class_uid = 3002 AND user_domain IS NOT NULL) AND class_uid <> 4003 AS absent, class_uid IN (3002, 4001) AND src_ip LIKE '10.0.0.%' AS fan_out,
  NOT (status_id = 2 OR (class_uid = 3002 AND user_domain IS NOT NULL)) AS neither, class_uid = 3002 AND status_id = 1 AS logon
FROM tel""")
ORACLE["text_predicates"] = """
SELECT doc_id, regexp_matches(lower(text), '^.*the.*of.*$', 's') AS glob, regexp_matches(text, '[0-9]{1,3}(\\.[0-9]{1,3}){3}') AS regex, contains(lower(text), 'license') AS keyword FROM documents"""
sql("scope_counts", TEL)("""
SELECT CASE class_uid WHEN 1007 THEN 'process_creation' WHEN 4001 THEN 'network_connection' WHEN 4003 THEN 'dns_query' ELSE 'linux/auth' END AS scope, count(*) AS events FROM tel GROUP BY ALL""")
sql("external_addresses", TEL)("""
, a AS (SELECT event_id, event_id * 7 % 256 AS o1, event_id * 11 % 256 AS o2, event_id * 13 % 256 AS o3, event_id * 17 % 256 AS o4 FROM tel)
SELECT event_id, o1 || '.' || o2 || '.' || o3 || '.' || o4 AS ip,
  NOT (o1 IN (0, 10, 127) OR (o1 = 172 AND o2 BETWEEN 16 AND 31) OR (o1 = 192 AND o2 = 168) OR (o1 = 100 AND o2 BETWEEN 64 AND 127) OR (o1 = 169 AND o2 = 254) OR o1 BETWEEN 224 AND 239) AS external,
  o1 * 16777216 + o2 * 65536 + o3 * 256 + o4 AS number FROM a""")
sql("host_and_user_names", TEL)("SELECT event_id, host, scoped AS \"user\" FROM tel")
ORACLE["page_domains"] = """
WITH h AS (SELECT page_id, lower(regexp_extract(url, '^[a-z]+://([^/:?#]+)', 1)) AS host FROM pages)
SELECT page_id, CASE WHEN contains(host, '.') THEN host END AS domain,
  CASE WHEN regexp_full_match(host, '([a-z0-9]([a-z0-9-]{0,61}[a-z0-9])?\\.)+[a-z][a-z0-9-]{1,62}') AND length(host) BETWEEN 4 AND 253 THEN host END AS indicator FROM h"""
ORACLE["document_mentions"] = r"""
WITH spaced AS (SELECT doc_id, text FROM documents),
-- A run of digits and dots is one candidate; a mention must be a whole run of four parts, a final dot aside.
runs AS (SELECT doc_id, unnest(regexp_extract_all(text, '[0-9.]+')) AS run FROM spaced),
quads AS (SELECT doc_id, regexp_replace(run, '\.+$', '') AS ip, run FROM runs),
ok AS (SELECT doc_id, ip AS value FROM quads WHERE regexp_full_match(ip, '(25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[1-9]?[0-9])(\.(25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[1-9]?[0-9])){3}')),
hexes AS (SELECT doc_id, lower(unnest(regexp_extract_all(text, '[0-9a-fA-F]+'))) AS value FROM spaced)
SELECT doc_id, value, count(*) AS n FROM (SELECT * FROM ok UNION ALL SELECT * FROM hexes WHERE length(value) IN (32, 40, 64)) GROUP BY ALL"""
sql("decoded_commands", TEL)("""
SELECT event_id, CASE WHEN k % 3 = 2 THEN '' ELSE 'run ' || user_name || CASE WHEN k % 7 = 0 THEN ' $exec_wrapper' ELSE '' END END AS decoded, k % 3 <> 2 AND k % 7 = 0 AS harness FROM tel""")
sql("page_cursors", TEL)("""
SELECT event_id, replace(replace(rtrim(to_base64(encode(time_ms || ':' || event_uid)), '='), '+', '-'), '/', '_') AS cursor, time_ms, event_uid AS uid FROM tel""")
sql("entity_aliases", TEL, SIGHTINGS)("""
, e AS (SELECT DISTINCT entity_key, split_part(entity_key, ':', 1) AS kind, regexp_replace(entity_key, '^[^:]*:', '') AS value FROM sight),
a AS (SELECT entity_key, value AS alias FROM e
  UNION SELECT entity_key, regexp_replace(regexp_replace(value, '\\.[^.]*$', ''), '^.*\\\\', '') FROM e WHERE kind IN ('process', 'file') AND contains(value, '.')
  UNION SELECT entity_key, regexp_replace(value, '^.*\\\\', '') FROM e WHERE kind = 'user' AND contains(value, '\\'))
SELECT entity_key, alias FROM a WHERE length(alias) >= 3""")

# ---------------------------------------------------------------------------------------------------- detection
sql("rule_matches", TEL, SINGLE)("SELECT rule_title, event_uid, finding_id, severity_id, technique AS techniques, time_ms AS first_ms FROM single_f")
sql("many_rule_matches", TEL)("""
SELECT 'account-' || i AS rule_id, count(*) AS n FROM tel JOIN range(400) r(i) ON user_name = 'user' || i
  WHERE class_uid = 1007 AND process_name NOT IN ('whoami.exe', 'net.exe') GROUP BY i
UNION ALL SELECT 'site-' || i, count(*) FROM tel JOIN range(300) r(i) ON query_hostname = 'site' || i || '.example' GROUP BY i
UNION ALL SELECT 'address-' || i, count(*) FROM tel JOIN range(230) r(i) ON dst_ip = '192.0.2.' || (i % 10) AND dst_port IN (443, 8000 + i)
  WHERE class_uid = 4001 GROUP BY i""")
sql("finding_entities", TEL, SINGLE)("""
, o AS (SELECT event_uid, unnest([{'n': 'device.hostname', 'v': device_hostname}, {'n': 'actor.user.name', 'v': CASE WHEN class_uid = 1007 THEN user_name END},
  {'n': 'process.name', 'v': process_name}, {'n': 'process.file.path', 'v': 'C:\\Windows\\System32\\' || process_name}, {'n': 'query.hostname', 'v': query_hostname}]) AS e FROM tel)
SELECT s.event_uid, s.rule_title, o.e.n AS name, o.e.v AS values FROM single_f s JOIN o USING (event_uid) WHERE o.e.v IS NOT NULL""")
ORACLE["keyword_rule"] = f"""WITH {TEL}, t AS (SELECT *, concat_ws(' ', 'event', event_id, user_name, cmd_line) AS raw FROM tel)
SELECT event_uid FROM t WHERE class_uid = 3002 AND (contains(raw, 'user1 ') OR status_id = 2) AND NOT contains(raw, 'user12')"""
sql("window_event_counts", TEL, _REPEAT, recursive=True)("SELECT g AS group_key, event_uid, time_ms, seen FROM counted")
sql("window_distinct_counts", TEL, _BUSY, recursive=True)("SELECT g AS group_key, event_uid, time_ms, seen FROM counted")
sql("threshold_firings", TEL, _BUSY, recursive=True)("SELECT g AS group_key, at_ms, trigger_uid FROM fired")
_SPRAY_FINDINGS = f"""
spray AS (SELECT g, at_ms, min(time_ms) AS first_ms, count(*) AS events, string_agg(event_uid, ',' ORDER BY rn) AS evidence, list(event_uid ORDER BY rn) AS uids,
  array_to_string(list_slice(list_sort(list_distinct(list(v))), 1, 20), ',') AS users,
  sha256('{_SPRAY_ID}' || chr(31) || g || chr(31) || at_ms || chr(31) || first(event_uid ORDER BY rn) || chr(31)) AS finding_id
  FROM ev WHERE rn <= 100 GROUP BY g, at_ms)"""
sql("spray_findings", TEL, _SPRAY, _SPRAY_FINDINGS, recursive=True)("""
SELECT g AS src_ip, first_ms, at_ms AS last_ms, events, evidence, users, finding_id FROM spray""")
sql("busy_source_findings", TEL, _BUSY, recursive=True)("""
SELECT g AS source_id, min(time_ms) AS first_ms, at_ms AS last_ms, count(*) AS events, array_to_string(list_slice(list_sort(list_distinct(list(v))), 1, 20), ',') AS users
FROM ev WHERE rn <= 100 GROUP BY g, at_ms""")
sql("new_findings", TEL, SINGLE)("SELECT rule_title, count(*) AS n FROM single_f WHERE time_ms >= 1705000000000 GROUP BY rule_title")

def _form(parser: str, events: str | None, rejects: str | None) -> list[str]:
    """Good rows by class and rejects by kind of one form, from the SQL of its own queries."""
    parts = []
    if events:
        parts.append(f"SELECT '{parser}' AS parser, NULL AS kind, class_uid, count(*) AS n FROM ({ORACLE[events]}) GROUP BY class_uid")
    if rejects:
        parts.append(f"SELECT '{parser}', kind, NULL, sum(n) FROM ({ORACLE[rejects]}) WHERE kind IS NOT NULL GROUP BY kind")
    return parts


_MIXED = [
    *_form("linux_auth", "linux_auth_events", "linux_auth_rejects"),
    *_form("windows_security", "windows_security_events", "windows_security_rejects"),
    *_form("windows_sysmon", "sysmon_events", "sysmon_rejects"),
    f"SELECT 'windows_ntlm', problem, CASE WHEN problem IS NULL THEN 3002 END, count(*) FROM ({ORACLE['ntlm_events']}) GROUP BY problem",
    *_form("ocsf", "ocsf_events", "ocsf_validation"),
    "SELECT 'telepathy', 'parse_error', NULL, count(*) FROM events",
]
ORACLE["mixed_ingest"] = "SELECT parser, kind, CAST(class_uid AS INTEGER) AS class_uid, CAST(n AS BIGINT) AS n FROM (" + " UNION ALL ".join(_MIXED) + ")"

# ----------------------------------------------------------------------------------------- entities and graph
sql("entity_sightings", TEL, SIGHTINGS)("SELECT event_uid, field, entity_key, links FROM sight")
sql("evidence_digests", TEL)("""
SELECT event_uid, CASE WHEN class_uid = 3002 THEN CASE WHEN status_id = 2 THEN 'Failed logon' ELSE 'Logged on' END WHEN class_uid = 1007 THEN 'Process started'
    WHEN class_uid = 4001 THEN 'Network connection' ELSE 'DNS query' END AS action, CASE WHEN status_id = 2 THEN 'failure' ELSE 'success' END AS outcome, cmd_line, dst_port,
  'host:' || host AS host, CASE WHEN class_uid IN (3002, 1007) THEN 'user:' || scoped END AS "user",
  CASE WHEN class_uid = 3002 THEN 'ip:' || src_ip WHEN class_uid = 4001 THEN 'ip:' || dst_ip END AS remote,
  CAST(CASE class_uid WHEN 3002 THEN 3 WHEN 1007 THEN 5 WHEN 4001 THEN 3 ELSE 2 END AS BIGINT) AS roles FROM tel""")
sql("event_relations", TEL, RELATIONS)("SELECT DISTINCT event_uid, source, relation, target FROM rel")
sql("graph_edges", TEL, RELATIONS)(f"""
, r AS (SELECT *, row_number() OVER (PARTITION BY source_id, source, relation, target ORDER BY time_ms, event_uid) AS rn FROM rel)
SELECT source_id AS incident_id, source || '|' || relation || '|' || target AS edge_id, {LABELS} AS label, min(time_ms) AS first_ms, max(time_ms) AS last_ms, count(*) AS event_count,
  string_agg(event_uid, ',' ORDER BY rn) FILTER (rn <= 20) AS events,
  coalesce(array_to_string(list_sort(list_distinct(list(dst_port) FILTER (relation = 'connected_to'))), ','), '') AS ports
FROM r GROUP BY source_id, source, relation, target""")
_NODES = """
ends AS (SELECT DISTINCT source_id, event_uid, time_ms, unnest([source, target]) AS key FROM rel),
ranked AS (SELECT *, row_number() OVER (PARTITION BY source_id, key ORDER BY time_ms, event_uid) AS rn FROM ends),
nodes AS (SELECT source_id AS incident_id, key, split_part(key, ':', 1) AS type, regexp_replace(key, '^[^:]*:', '') AS value,
  (key LIKE 'ip:%' AND key NOT LIKE 'ip:10.%') OR key LIKE 'domain:%' AS external, min(time_ms) AS first_ms, max(time_ms) AS last_ms, count(*) AS event_count,
  string_agg(event_uid, ',' ORDER BY rn) FILTER (rn <= 20) AS events FROM ranked GROUP BY source_id, key)"""
sql("graph_nodes", TEL, RELATIONS, _NODES)("SELECT incident_id, key, type, value, external, first_ms, last_ms, event_count, events FROM nodes")
sql("graph_connections", TEL, RELATIONS)("""
SELECT source_id AS incident_id, source, target, count(DISTINCT relation) AS labels, count(*) AS event_count,
  coalesce(array_to_string(list_sort(list_distinct(list(dst_port) FILTER (relation = 'connected_to'))), ','), '') AS ports
FROM rel GROUP BY source_id, source, target""")
sql("first_graph_nodes", TEL, RELATIONS, _NODES)("""
SELECT key, external, first_ms FROM nodes WHERE incident_id = 'src-0'
ORDER BY list_position(['ip', 'host', 'user', 'process', 'file', 'hash', 'domain'], type), external DESC, first_ms, key LIMIT 25""")

# ------------------------------------------------------------------------------------------------------ timeline
sql("timeline_members", TEL, STEPS)("SELECT incident_id, event_uid, step_id FROM members")
_STEP_ROWS = """
seen AS (SELECT incident_id, step_id, 'u' AS kind, regexp_replace(scoped, '^user:', '') AS value, time_ms, event_uid FROM members WHERE class_uid IN (3002, 1007)
  UNION ALL SELECT incident_id, step_id, 'd', query_hostname, time_ms, event_uid FROM members WHERE class_uid = 4003
  UNION ALL SELECT incident_id, step_id, 'c', cmd_line, time_ms, event_uid FROM members WHERE class_uid = 1007),
firsts AS (SELECT incident_id, step_id, kind, value, min((time_ms, event_uid)) AS seen_at FROM seen GROUP BY ALL),
ranks AS (SELECT *, row_number() OVER (PARTITION BY incident_id, step_id, kind ORDER BY seen_at, value) AS rn FROM firsts),
lists AS (SELECT incident_id, step_id, string_agg(value, ',' ORDER BY rn) FILTER (kind = 'u' AND rn <= 20) AS users,
  string_agg(value, ',' ORDER BY rn) FILTER (kind = 'd' AND rn <= 20) AS domains, string_agg(value, ',' ORDER BY rn) FILTER (kind = 'c' AND rn <= 20) AS commands
  FROM ranks GROUP BY ALL),
steps AS (SELECT incident_id, step_id, min(time_ms) AS first_ms, max(time_ms) AS last_ms, count(*) AS event_count, any_value(action) AS action, any_value(outcome) AS outcome,
  any_value(host) AS host, any_value(remote) AS remote, any_value(process) AS process, any_value(parent) AS parent_process,
  coalesce(array_to_string(list_sort(list_distinct(list(dst_port) FILTER (dst_port IS NOT NULL))), ','), '') AS ports FROM members GROUP BY incident_id, step_id)"""
sql("timeline_steps", TEL, STEPS, _STEP_ROWS)("""
SELECT s.*, coalesce(users, '') AS users, coalesce(domains, '') AS domains, coalesce(commands, '') AS command_lines FROM steps s LEFT JOIN lists USING (incident_id, step_id)""")
sql("timeline_chain", TEL, STEPS, _STEP_ROWS)("""
SELECT incident_id, step_id, lead(step_id) OVER (PARTITION BY incident_id ORDER BY first_ms, step_id) AS next_step_id FROM steps""")
_LINKS = f"""
links AS (
  SELECT source_id AS incident_id, finding_id AS link_id, rule_title AS title, severity_id, technique, tactic, time_ms AS first_ms, time_ms AS last_ms, [event_uid] AS evidence FROM single_f
  UNION ALL SELECT t.source_id, s.finding_id, 'One source fails as many accounts', 3, 'T1110.003', 'credential_access', s.first_ms, s.at_ms, s.uids
    FROM spray s JOIN tel t ON t.event_uid = s.uids[1]),
cited AS (SELECT *, unnest(evidence) AS event_uid FROM links)"""
sql("step_citations", TEL, SINGLE, _SPRAY, _SPRAY_FINDINGS, _LINKS, STEPS, recursive=True)("""
SELECT c.incident_id, m.step_id, count(DISTINCT c.link_id) AS links, max(c.title) AS last_title FROM cited c JOIN members m ON m.event_uid = c.event_uid AND m.incident_id = c.incident_id GROUP BY ALL""")
sql("unresolved_events", TEL, SINGLE, _SPRAY, _SPRAY_FINDINGS, _LINKS, recursive=True)("""
SELECT c.incident_id, count(DISTINCT c.event_uid) AS events FROM cited c JOIN tel t ON t.event_uid = c.event_uid
WHERE NOT (t.time_ms < 1705000000000 AND t.source_id = c.incident_id) GROUP BY ALL""")

# ------------------------------------------------------------------------------------------------------ baseline
_BASE = "SELECT 'org-1' AS org_id, kind, key, count(*) AS observations, min(time_ms) AS first_ms, max(time_ms) AS last_ms FROM observed GROUP BY kind, key"
sql("baselines", TEL, OBSERVED)(_BASE)
sql("merged_baselines", TEL, OBSERVED)(_BASE)
sql("baseline_span", TEL, OBSERVED)("SELECT 'org-1' AS org_id, min(time_ms) AS first_ms, max(time_ms) AS last_ms FROM observed")
sql("evidence_observations", TEL, OBSERVED)("SELECT kind, key, count(*) AS observations FROM observed GROUP BY ALL")
_NOVEL = """
started AS (SELECT source_id AS incident_id, min(time_ms) AS s FROM tel WHERE time_ms >= 1705000000000 GROUP BY ALL),
known AS (SELECT kind, key, count(*) AS n, min(time_ms) AS f FROM observed WHERE time_ms < 1705000000000 GROUP BY ALL),
novel AS (SELECT DISTINCT o.source_id AS incident_id, o.kind, o.key, coalesce(k.n, 0) AS observations, k.f AS first_ms, k.f IS NULL OR k.f >= st.s AS new_here
  FROM observed o JOIN started st ON st.incident_id = o.source_id LEFT JOIN known k ON k.kind = o.kind AND k.key = o.key WHERE o.time_ms >= 1705000000000)"""
sql("incident_novelty", TEL, OBSERVED, _NOVEL)("""
SELECT *, CASE WHEN first_ms IS NULL THEN key || ': never seen outside this incident'
  ELSE key || ': seen ' || observations || ' times, first on ' || strftime(make_timestamp(first_ms * 1000), '%Y-%m-%d') END AS sentence FROM novel""")
sql("rarest_novelty", TEL, OBSERVED, _NOVEL)("""
SELECT kind, key, observations, new_here FROM novel WHERE incident_id = 'src-1' ORDER BY new_here DESC, observations, key LIMIT 20""")

# --------------------------------------------------------------------------------------------------- correlation
sql("failed_logon_followups", TEL)("""
SELECT a.src_ip AS source_key, a.host AS host_key, a.event_uid, a.time_ms AS at_ms, count(*) AS failures
FROM tel a JOIN tel f ON f.src_ip = a.src_ip AND f.host = a.host AND f.class_uid = 3002 AND f.status_id = 2 AND f.time_ms <= a.time_ms AND a.time_ms - f.time_ms <= 3600000
WHERE a.class_uid = 3002 AND a.status_id = 1 GROUP BY ALL""")
sql("finding_evidence", TEL, _SPRAY, recursive=True)("""
SELECT v AS user_name, count(*) AS citations, min(time_ms) AS first_ms FROM ev WHERE rn <= 100 GROUP BY v""")
sql("findings_with_technique", TEL, SINGLE)("SELECT finding_id, time_ms AS first_ms FROM single_f WHERE technique = 'T1033'")
sql("candidate_incidents", TEL, _SPRAY, _SPRAY_FINDINGS, SIGHTINGS, recursive=True)("""
, keys AS (SELECT DISTINCT s.finding_id, s.first_ms, s.at_ms, x.entity_key FROM (SELECT *, unnest(uids) AS uid FROM spray) s JOIN sight x ON x.event_uid = s.uid WHERE x.links),
held AS (SELECT regexp_replace(entity_key, '^host:', '') || '/' || (time_ms // 86400000) AS incident_id, entity_key, min(time_ms) AS f, max(time_ms) AS l FROM sight WHERE entity_key LIKE 'host:%' GROUP BY ALL)
SELECT k.finding_id, h.incident_id, count(*) AS shared, any_value(h.l) AS last_ms FROM keys k JOIN held h ON h.entity_key = k.entity_key
WHERE h.incident_id NOT LIKE '%0' AND h.l >= k.first_ms - 7200000 AND h.f <= k.at_ms + 7200000 GROUP BY ALL""")
sql("layer_scores", TEL, SINGLE, _SPRAY, _SPRAY_FINDINGS, _LINKS, recursive=True)("""
SELECT incident_id, technique AS technique_id, count(DISTINCT event_uid) AS score, string_agg(DISTINCT title, '; ' ORDER BY title) AS rules FROM cited GROUP BY ALL""")
sql("assessed_sources", TEL, SINGLE, _SPRAY, _SPRAY_FINDINGS, _LINKS, recursive=True)("""
, tac AS (SELECT incident_id, string_agg(tactic, ',' ORDER BY seen_at) AS tactics, string_agg(replace(tactic, '_', ' '), ', ' ORDER BY seen_at) FILTER (rn <= 4) AS pretty, count(*) AS n
  FROM (SELECT *, row_number() OVER (PARTITION BY incident_id ORDER BY seen_at) AS rn FROM (SELECT incident_id, tactic, min((first_ms, link_id)) AS seen_at FROM links GROUP BY ALL)) GROUP BY incident_id),
tec AS (SELECT incident_id, string_agg(DISTINCT technique, ',' ORDER BY technique) AS techniques FROM links GROUP BY ALL),
hosts AS (SELECT source_id AS incident_id, host, min(time_ms) AS f FROM tel GROUP BY ALL),
hr AS (SELECT *, row_number() OVER (PARTITION BY incident_id ORDER BY f, host) AS rn FROM hosts),
ht AS (SELECT incident_id, string_agg(host, ', ' ORDER BY rn) FILTER (rn <= 2) AS two, count(*) AS n FROM hr GROUP BY ALL),
tot AS (SELECT incident_id, min(first_ms) AS first_ms, max(last_ms) AS last_ms, count(*) AS finding_count, max(severity_id) AS top FROM links GROUP BY ALL),
evn AS (SELECT incident_id, count(DISTINCT event_uid) AS event_count FROM cited GROUP BY ALL)
SELECT incident_id, 'Multi-stage activity (' || pretty || ') on ' || two || CASE WHEN ht.n > 2 THEN ' and ' || (ht.n - 2) || ' more' ELSE '' END AS title,
  greatest(top, 4) AS severity_id, first_ms, last_ms, finding_count, event_count, techniques, tactics, 'highest-finding-severity,multi-stage' AS reasons
FROM tot JOIN tac USING (incident_id) JOIN tec USING (incident_id) JOIN ht USING (incident_id) JOIN evn USING (incident_id)""")

sql("merged_entities", TEL, SIGHTINGS)("""
, r AS (SELECT *, row_number() OVER (PARTITION BY source_id, entity_key ORDER BY time_ms, event_uid) AS rn FROM (SELECT DISTINCT source_id, entity_key, links, time_ms, event_uid FROM sight))
SELECT source_id AS incident_id, entity_key, links, min(time_ms) AS first_ms, max(time_ms) AS last_ms, string_agg(event_uid, ',' ORDER BY rn) FILTER (rn <= 20) AS events FROM r GROUP BY ALL""")

# ----------------------------------------------------------------------------------------------------- intelligence
_FEED = """
raw_feed AS (
  SELECT page_id AS position, 'domain' AS type, lower(regexp_extract(url, '^[a-z]+://([^/:?#]+)', 1)) AS value, ['malicious', 'suspicious', 'benign', 'odd'][page_id % 4 + 1] AS verdict,
    CASE WHEN page_id % 10 = 0 THEN 120 ELSE CAST(page_id % 100 AS INTEGER) END AS confidence, 'Listed in pages' AS summary, 'a,b,c' AS tags FROM pages
  UNION ALL SELECT event_id + 1000000000, 'ip', coalesce(dst_ip, src_ip), CASE WHEN k % 2 = 0 THEN 'malicious' ELSE 'unknown' END, NULL, 'Listed in local feed', '' FROM tel),
feed_all AS (SELECT * REPLACE (CASE WHEN type = 'ip' AND value LIKE '10.%' THEN NULL
    WHEN type = 'domain' AND NOT regexp_full_match(value, '([a-z0-9]([a-z0-9-]{0,61}[a-z0-9])?\\.)+[a-z][a-z0-9-]{1,62}') THEN NULL ELSE value END AS value) FROM raw_feed),
marked AS (SELECT *, value IS NOT NULL AND verdict <> 'odd' AND coalesce(confidence, 0) <= 100 AS is_valid FROM feed_all),
feed AS (SELECT * FROM marked WHERE is_valid QUALIFY row_number() OVER (PARTITION BY type, value ORDER BY position DESC) = 1)"""
_WANTED = """
wanted AS (SELECT DISTINCT split_part(entity_key, ':', 1) AS type, regexp_replace(entity_key, '^[^:]*:', '') AS value FROM sight WHERE links AND (entity_key LIKE 'ip:%' OR entity_key LIKE 'domain:%'))"""
sql("feed_rows_checked", TEL, _FEED)("SELECT type, is_valid, count(*) AS n, count(*) FILTER (value IS NULL) AS no_indicator FROM marked GROUP BY ALL")
sql("feed_indicators", TEL, _FEED)("SELECT type, value, verdict, confidence, summary, tags FROM feed")
sql("intel_results", TEL, SIGHTINGS, _FEED, _WANTED)(f"""
SELECT w.type, w.value, CASE WHEN f.verdict IS NULL THEN 'not_found' ELSE 'found' END AS status, coalesce(f.verdict, 'unknown') AS verdict,
  coalesce(f.summary, 'No information from this provider.') AS summary, CAST({NOW_MS} AS BIGINT) AS retrieved_ms, CAST({NOW_MS} + 3600000 AS BIGINT) AS expires_ms
FROM wanted w LEFT JOIN feed f USING (type, value) WHERE NOT (w.value LIKE '%1' AND w.value NOT LIKE '%11')""")
sql("intel_lookup_report", TEL, SIGHTINGS, _FEED, _WANTED)("""
, keys AS (SELECT DISTINCT entity_key AS key FROM sight)
SELECT k.key, w.value IS NULL AS invalid, CASE WHEN w.value IS NULL THEN NULL WHEN f.verdict IS NULL THEN 'not_found' ELSE 'found' END AS status,
  CASE WHEN w.value IS NOT NULL THEN coalesce(f.verdict, 'unknown') END AS verdict
FROM keys k LEFT JOIN wanted w ON w.type || ':' || w.value = k.key LEFT JOIN feed f ON f.type = w.type AND f.value = w.value""")
sql("worst_verdicts", TEL, _FEED)("""
, r AS (SELECT type, value, verdict, 'p' || (position % 7) AS provider, CASE verdict WHEN 'malicious' THEN 3 WHEN 'suspicious' THEN 2 WHEN 'benign' THEN 1 ELSE 0 END AS rank
  FROM marked WHERE is_valid AND position % 5 <> 0)
SELECT type, value, provider, verdict FROM r QUALIFY row_number() OVER (PARTITION BY type, value ORDER BY rank DESC, provider) = 1""")
sql("community_verdicts", TEL, SIGHTINGS, _WANTED)("""
, told AS (SELECT 'domain' AS type, query_hostname AS value, event_id AS id, 'r' || k AS name, source_id AS tag, time_ms FROM tel WHERE query_hostname IS NOT NULL AND k % 3 = 0),
named AS (SELECT *, row_number() OVER (PARTITION BY type, value ORDER BY id) AS rn FROM told),
rep AS (SELECT type, value, count(*) AS n, min(time_ms) AS f, max(time_ms) AS l, string_agg(name, '; ' ORDER BY rn) FILTER (rn <= 3) AS names, string_agg(DISTINCT tag, ',' ORDER BY tag) AS tags FROM named GROUP BY ALL),
pas AS (SELECT 'ip' AS type, dst_ip AS value, 'h' || k || '.example' AS related, row_number() OVER (PARTITION BY dst_ip ORDER BY event_id) AS rn FROM tel WHERE dst_ip IS NOT NULL AND k % 10 < 5),
pdns AS (SELECT type, value, string_agg(related, ',' ORDER BY rn) AS related FROM pas WHERE rn <= 10 GROUP BY ALL)
SELECT type, value, CASE WHEN value = 'site3.example' THEN 'benign' WHEN n > 0 THEN 'suspicious' WHEN related IS NOT NULL THEN 'unknown' END AS verdict,
  CASE WHEN value = 'site3.example' THEN 'On an allowlist (top sites); referenced in ' || coalesce(n, 0) || ' report(s).'
    WHEN n > 0 THEN 'Referenced in ' || n || ' community report(s): ' || names WHEN related IS NOT NULL THEN 'Not referenced in any report; passive DNS only.' END AS summary,
  tags, related, CASE WHEN value <> 'site3.example' THEN f END AS provider_first_seen, CASE WHEN value <> 'site3.example' THEN l END AS provider_last_seen
FROM wanted LEFT JOIN rep USING (type, value) LEFT JOIN pdns USING (type, value)""")

# -------------------------------------------------------------------------------------------------------- search
_RANGE = "time_ms BETWEEN 1704412800000 AND 1706140800000"
def paged(columns: str, source: str, order: str, limit: int, cursor: str) -> str:
    """A page of ``source`` with whether more follows and the cursor to go on from."""
    return f"""
, placed AS (SELECT *, row_number() OVER (ORDER BY {order}) AS place FROM ({source})),
last_row AS (SELECT CAST({cursor} AS VARCHAR) AS next_cursor FROM placed WHERE place = {limit})
SELECT {columns}, (SELECT max(place) FROM placed) > {limit} AS has_more,
  CASE WHEN (SELECT max(place) FROM placed) > {limit} THEN (SELECT next_cursor FROM last_row) END AS next_cursor
FROM placed WHERE place <= {limit}"""


def time_cursor(time: str, uid: str) -> str:
    return f"replace(replace(rtrim(to_base64(encode({time} || ':' || {uid})), '='), '+', '-'), '/', '_')"


sql("event_search_page", TEL)(paged(
  "event_uid, time_ms, class_uid", f"SELECT * FROM tel WHERE {_RANGE} AND class_uid IN (3002, 1007) AND status_id = 1 AND source_id = 'src-1'",
  "time_ms DESC, event_uid DESC", 50, time_cursor("time_ms", "event_uid")))
sql("event_search_next_page", TEL)(paged(
  "event_uid, time_ms", f"SELECT * FROM tel WHERE {_RANGE} AND (time_ms < 1705500000000 OR (time_ms = 1705500000000 AND event_uid < '8'))",
  "time_ms DESC, event_uid DESC", 100, time_cursor("time_ms", "event_uid")))
sql("event_search_matches", TEL)(f"""
SELECT 'by_ip' AS test, event_uid FROM tel WHERE {_RANGE} AND class_uid IN (3002, 4001) AND src_ip = '198.51.100.7'
UNION ALL SELECT 'by_user', event_uid FROM tel WHERE {_RANGE} AND class_uid IN (3002, 1007) AND user_name = 'user12'
UNION ALL SELECT 'by_host', event_uid FROM tel WHERE {_RANGE} AND host = 'ws-3'
UNION ALL SELECT 'by_text', event_uid FROM tel WHERE {_RANGE} AND ((process_name = 'whoami.exe' AND user_name <> 'user1') OR process_name = 'net.exe')
UNION ALL SELECT 'by_prefix', event_uid FROM tel WHERE {_RANGE} AND process_name = 'powershell.exe'""")
sql("event_search_total", TEL)(f"""
SELECT least(count(*), 10000) AS total, count(*) > 10000 AS is_lower_bound FROM tel WHERE {_RANGE} AND class_uid = 3002""")
sql("event_lookup", TEL)("SELECT event_uid, time_ms, class_uid FROM tel WHERE event_id = 42")
sql("finding_search_page", TEL, SINGLE)(paged(
  "finding_id, last_ms", "SELECT finding_id, time_ms AS last_ms FROM single_f WHERE severity_id >= 3 AND technique = 'T1059.001' AND time_ms >= 1704500000000",
  "last_ms DESC, finding_id DESC", 60, time_cursor("last_ms", "finding_id")))
_ORDERS = """
inc AS (SELECT lpad(o_orderkey::VARCHAR, 12, '0') AS incident_id, 'org-' || (o_custkey % 4) AS org_id, CASE o_orderstatus WHEN 'F' THEN 'closed' WHEN 'P' THEN 'investigating' ELSE 'new' END AS status,
  CAST(o_orderpriority[1] AS INTEGER) AS severity_id, epoch_us(o_orderdate) // 1000 AS last_ms, o_custkey % 17 AS event_count, CAST(o_orderkey % 5 + 1 AS INTEGER) AS version,
  CASE WHEN o_orderstatus = 'F' THEN 'true_positive' END AS resolution FROM orders)"""
sql("incident_search_page", _ORDERS)(paged(
  "incident_id, last_ms, severity_id", "SELECT * FROM inc WHERE org_id = 'org-2' AND status = 'new' AND severity_id >= 3",
  "last_ms DESC, incident_id DESC", 100, time_cursor("last_ms", "incident_id")))
sql("attention_list", _ORDERS)("SELECT incident_id, severity_id, last_ms FROM inc WHERE status <> 'closed' ORDER BY severity_id DESC, last_ms DESC, incident_id LIMIT 5")
sql("triage_totals", _ORDERS)("""
SELECT count(*) FILTER (status <> 'closed') AS open, count(*) FILTER (status <> 'closed' AND severity_id >= 4) AS high_or_critical, count(*) FILTER (status = 'investigating') AS investigating,
  CAST(sum(event_count) FILTER (status <> 'closed') AS BIGINT) AS events FROM inc""")
sql("status_changes", _ORDERS)("""
, asked AS (SELECT lpad((o_orderkey + CASE WHEN o_orderkey % 50 = 0 THEN 10000000 ELSE 0 END)::VARCHAR, 12, '0') AS incident_id, ['new', 'investigating', 'closed'][o_custkey % 3 + 1] AS st,
  CASE WHEN o_custkey % 6 < 3 THEN 'true_positive' END AS res, o_custkey % 5 + 1 AS ver FROM orders),
j AS (SELECT a.*, i.status AS s, i.resolution AS r, i.version AS v FROM asked a LEFT JOIN inc i USING (incident_id)),
c AS (SELECT *, CASE WHEN s IS NULL THEN 'no such incident' WHEN ver <> v THEN 'the incident changed since it was loaded' WHEN st = 'closed' AND res IS NULL THEN 'closing needs a resolution'
  WHEN st <> 'closed' AND res IS NOT NULL THEN 'only closed incidents have a resolution' WHEN st = s AND res IS NOT DISTINCT FROM r THEN 'the incident is already ' || st
  WHEN st = 'new' AND s <> 'new' THEN 'an incident cannot go back to new' END AS refusal FROM j)
SELECT refusal IS NULL AS accepted, refusal, count(*) AS n, CAST(sum(CASE WHEN refusal IS NULL THEN v + 1 END) AS BIGINT) AS versions FROM c GROUP BY ALL""")
ORACLE["latest_analyses"] = """
SELECT (o_custkey % 40)::VARCHAR AS incident_id, o_orderkey AS analysis_id, row_number() OVER (PARTITION BY o_custkey % 40 ORDER BY o_orderdate DESC, o_orderkey DESC) AS rank
FROM orders QUALIFY rank <= 20"""
ORACLE["checked_notes"] = """
SELECT doc_id, length(body) AS length, sha256(body) AS sha256, CASE WHEN doc_id % 20 = 0 THEN 'a note cannot be empty' WHEN length(body) > 10000 THEN 'a note has at most 10000 characters' END AS refusal
FROM (SELECT doc_id, CASE WHEN doc_id % 20 = 0 THEN ' ' || chr(10) || ' ' ELSE text END AS body FROM documents)"""

# ------------------------------------------------------------------------------------------------- rule catalogue
_RULES = """
rules AS (SELECT doc_id, doc_id::VARCHAR AS rule_id, lang || ' rule ' || doc_id AS title, doc_id % 4 = 0 AS community,
  CASE WHEN doc_id % 11 = 0 THEN [] ELSE ['T10' || lpad((doc_id % 40)::VARCHAR, 2, '0'), 'T10' || lpad((doc_id % 25)::VARCHAR, 2, '0') || '.00' || (doc_id % 3)] END AS techniques,
  ['execution', 'discovery', 'impact'][doc_id % 3 + 1] AS tactic, CASE WHEN doc_id % 5 <> 0 THEN source END AS logsource FROM documents),
tagged AS (SELECT *, unnest(techniques) AS technique_id FROM rules)"""
sql("technique_coverage", _RULES)("""
, r AS (SELECT *, row_number() OVER (PARTITION BY technique_id ORDER BY title) AS rn FROM tagged)
SELECT technique_id, count(*) AS rules, count(*) FILTER (NOT community) AS own, count(*) FILTER (community) AS community, string_agg(title, ',' ORDER BY rn) FILTER (rn <= 5) AS titles FROM r GROUP BY ALL""")
sql("coverage_layer", _RULES)("""
, n AS (SELECT technique_id, count(*) AS rules FROM tagged GROUP BY ALL),
f AS (SELECT technique_id FROM n ORDER BY technique_id LIMIT 1),
t AS (SELECT title, row_number() OVER (ORDER BY title) AS rn FROM tagged WHERE technique_id = (SELECT technique_id FROM f))
SELECT 'Rule coverage' AS name, (SELECT max(rules) FROM n) AS top, (SELECT technique_id FROM f) AS first_technique,
  (SELECT string_agg(title, '; ' ORDER BY rn) FROM t WHERE rn <= 5) AS first_comment,
  (SELECT count(*) FROM rules) || ' rules name ' || (SELECT count(*) FROM n) || ' techniques (' || (SELECT count(*) FROM n WHERE contains(technique_id, '.')) || ' sub-techniques); '
    || (SELECT count(*) FROM rules WHERE len(techniques) = 0) || ' name none. A score counts rules; it does not say they would catch anything. Exported 2024-02-03T22:40:00.000Z.' AS description""")
sql("tactic_coverage", _RULES)("SELECT tactic, count(*) AS rules FROM rules GROUP BY ALL")
sql("coverage_totals", _RULES)("""
SELECT count(*) AS rules, count(*) FILTER (len(techniques) = 0) AS untagged, (SELECT count(DISTINCT technique_id) FROM tagged) AS techniques,
  (SELECT count(DISTINCT technique_id) FROM tagged WHERE contains(technique_id, '.')) AS sub_techniques FROM rules""")
sql("rules_for_technique", _RULES)("""
SELECT DISTINCT rule_id, title FROM tagged WHERE (technique_id = 'T1007' OR technique_id LIKE 'T1007.%') AND logsource = 'src1'""")
sql("rule_page", _RULES)(paged(
  "rule_id, title, total", """
  SELECT *, (SELECT count(*) FROM rules) AS total FROM rules
  WHERE (lower(title), rule_id) > ((SELECT lower(title) FROM rules WHERE rule_id = '17'), '17')""",
  "lower(title), rule_id", 40, "rule_id"))

# -------------------------------------------------------------------------------------------------------- audit
_AUDIT = """
entries AS (SELECT 'org-' || (o_custkey % 6) AS org_id, row_number() OVER (PARTITION BY o_custkey % 6 ORDER BY o_orderkey) - 1 AS chain_index, o_orderkey::VARCHAR AS resource_id,
  'order.' || lower(o_orderstatus) AS action, o_custkey::VARCHAR AS actor_id, o_orderdate, o_orderpriority FROM orders),
content AS (SELECT *, '{"action":"' || action || '","actor_id":"' || actor_id || '","actor_type":"user","after":{"priority":"' || o_orderpriority || '"},"before":null,"chain_index":' || chain_index
  || ',"context":null,"correlation_id":null,"org_id":"' || org_id || '","resource_id":"' || resource_id || '","resource_type":"order","ts":"' || strftime(o_orderdate, '%Y-%m-%dT%H:%M:%S.%f') || 'Z"}' AS body FROM entries),
chain AS (
  SELECT org_id, chain_index, resource_id, sha256(repeat('0', 64) || body) AS entry_hash FROM content WHERE chain_index = 0
  UNION ALL SELECT c.org_id, c.chain_index, c.resource_id, sha256(p.entry_hash || c.body) FROM chain p JOIN content c ON c.org_id = p.org_id AND c.chain_index = p.chain_index + 1)"""
sql("audit_chain", _AUDIT, recursive=True)("SELECT org_id, chain_index, resource_id, entry_hash FROM chain")
sql("audit_verification", _AUDIT, recursive=True)("""
, n AS (SELECT org_id, count(*) AS c FROM chain GROUP BY ALL),
b AS (SELECT org_id, c, CASE org_id WHEN 'org-1' THEN 7 WHEN 'org-2' THEN 12 WHEN 'org-3' THEN 9 END AS broken, CASE org_id WHEN 'org-1' THEN 7 WHEN 'org-2' THEN 11 WHEN 'org-3' THEN 9 ELSE c END AS checked FROM n)
SELECT b.org_id, broken IS NULL AS valid, CAST(checked AS BIGINT) AS entries_checked, chain.entry_hash AS head_hash, CAST(broken AS BIGINT) AS broken_at_index,
  CASE b.org_id WHEN 'org-1' THEN 'entry content does not match its hash' WHEN 'org-2' THEN 'expected chain_index 11 (entry missing or inserted)' WHEN 'org-3' THEN 'prev_hash does not match preceding entry' END AS reason
FROM b JOIN chain ON chain.org_id = b.org_id AND chain.chain_index = checked - 1""")
sql("audit_page", _AUDIT, recursive=True)(paged(
  "chain_index, resource_id", "SELECT * FROM entries WHERE org_id = 'org-4' AND action = 'order.f' AND chain_index < 1000",
  "chain_index DESC", 50, "chain_index"))
ORACLE["audited_organisations"] = "SELECT DISTINCT 'org-' || (o_custkey % 6) AS org_id FROM orders"

# --------------------------------------------------------------------------------------- grounding and evaluation
_GROUND = r"""
st AS (SELECT conv_id AS analysis_id, turn AS position, conv_id * 10 + turn AS key, text AS said FROM conversations),
s AS (SELECT *, ['FACT', 'INFERENCE', 'UNCERTAINTY', 'GUESS'][key % 4 + 1] AS kind,
  CASE WHEN key % 17 = 0 THEN NULL ELSE said || CASE WHEN key % 6 = 0 THEN ' from 198.51.100.' || (key % 20) ELSE '' END END AS text,
  CASE WHEN key % 5 = 0 THEN [] WHEN key % 7 = 0 THEN [sha256('ev' || key), 'made up'] ELSE [sha256('ev' || (key % 300)), sha256('ev' || (key % 300))] END AS evidence,
  CASE WHEN key % 3 = 0 THEN 'because' END AS reasoning, CASE WHEN key % 2 = 0 THEN 'more logs' END AS missing FROM st),
cites AS (SELECT analysis_id, position, unnest(evidence) AS uid, generate_subscripts(evidence, 1) AS nth FROM s),
checked AS (SELECT c.*, t.event_uid IS NOT NULL AS known FROM cites c LEFT JOIN tel t ON t.event_uid = c.uid),
cc AS (SELECT analysis_id, position, count(*) AS citations, count(*) FILTER (known) AS valid, string_agg(uid, ', ' ORDER BY nth) FILTER (NOT known) AS absent FROM checked GROUP BY ALL),
named AS (SELECT analysis_id, position, unnest(regexp_extract_all(concat_ws(' ', text, reasoning, missing), '[0-9.]+')) AS run FROM s),
ips AS (SELECT DISTINCT src_ip AS ip FROM tel UNION SELECT DISTINCT dst_ip FROM tel WHERE dst_ip IS NOT NULL),
un AS (SELECT analysis_id, position, list(rtrim(run, '.')) AS bad FROM named
  WHERE regexp_full_match(rtrim(run, '.'), '(25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[1-9]?[0-9])(\.(25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[1-9]?[0-9])){3}') AND rtrim(run, '.') NOT IN (SELECT ip FROM ips) GROUP BY ALL),
g AS (SELECT s.*, coalesce(citations, 0) AS citations, coalesce(valid, 0) AS citations_valid, CASE
  WHEN kind = 'GUESS' THEN 'kind must be FACT, INFERENCE or UNCERTAINTY' WHEN absent IS NOT NULL THEN 'cites events that are not in the incident: ' || absent
  WHEN text IS NULL THEN 'no text' WHEN kind <> 'UNCERTAINTY' AND len(evidence) = 0 THEN 'a ' || kind || ' must cite at least one event'
  WHEN kind = 'INFERENCE' AND reasoning IS NULL THEN 'an INFERENCE must give its reasoning' WHEN kind = 'UNCERTAINTY' AND missing IS NULL THEN 'an UNCERTAINTY must say what information would resolve it'
  WHEN bad IS NOT NULL THEN 'mentions ' || array_to_string(list_slice(bad, 1, 3), ', ') || ', which is not in the evidence' END AS reason
  FROM s LEFT JOIN cc USING (analysis_id, position) LEFT JOIN un USING (analysis_id, position))"""
sql("grounded_statements", TEL, _GROUND)("SELECT analysis_id, position, kind, len(list_distinct(evidence)) AS events, citations, citations_valid, reason FROM g")
sql("validation_totals", TEL, _GROUND)("""
SELECT analysis_id, count(*) AS statements_returned, count(*) FILTER (reason IS NULL) AS statements_kept, count(*) FILTER (reason IS NOT NULL) AS dropped,
  CAST(sum(citations) AS BIGINT) AS citations_total, CAST(sum(citations_valid) AS BIGINT) AS citations_valid FROM g GROUP BY ALL""")
ORACLE["merged_techniques"] = """
WITH e AS (SELECT conv_id, turn, 'T10' || lpad((turn % 3)::VARCHAR, 2, '0') || CASE WHEN turn % 2 = 0 THEN '.001' ELSE '' END AS technique_id, unnest([(turn % 2)::VARCHAR, turn::VARCHAR]) AS uid,
  unnest([1, 2]) AS nth FROM conversations),
f AS (SELECT conv_id, technique_id, uid, min((turn, nth)) AS first_at, min(turn) AS t FROM e GROUP BY ALL)
SELECT conv_id AS analysis_id, technique_id, string_agg(uid, ',' ORDER BY first_at) AS evidence, CASE WHEN min(t) = 0 THEN 'FACT' ELSE 'INFERENCE' END AS kind FROM f GROUP BY ALL"""
sql("attribution_checks", TEL, RELATIONS)("""
, c AS (
  SELECT 'spawned' AS verb, true AS supported FROM tel WHERE class_uid = 1007
  UNION ALL SELECT 'connected to', EXISTS (SELECT 1 FROM rel r WHERE r.source_id = t.source_id AND r.relation = 'connected_to' AND r.source = 'host:' || t.host
      AND r.target = 'ip:' || CASE WHEN t.k % 3 = 0 THEN '192.0.2.9' ELSE t.dst_ip END) FROM tel t WHERE class_uid = 4001
  UNION ALL SELECT 'logged on to', EXISTS (SELECT 1 FROM rel r WHERE r.source_id = t.source_id AND r.relation = 'logon' AND r.source = 'ip:' || t.src_ip AND r.target = 'host:' || t.host) FROM tel t WHERE class_uid = 3002)
SELECT verb, supported, count(*) AS claims FROM c GROUP BY ALL""")
_CARD = """
want AS (SELECT * FROM (VALUES ('src-0', 'T1059', 'priority'), ('src-1', 'T1033', 'priority'), ('src-2', 'T1105', 'claims')) v(recording, technique, purpose)),
judged AS (SELECT s.source_id AS recording, CASE WHEN s.k % 8 = 0 THEN 'harness'
    WHEN s.technique = w.technique OR s.technique LIKE w.technique || '.%' OR w.technique LIKE s.technique || '.%' THEN 'matching' ELSE 'other' END AS outcome
  FROM single_f s JOIN want w ON w.recording = s.source_id)"""
sql("detection_scorecard", TEL, _SECURITY, SINGLE, _CARD)("""
, r AS (SELECT source_id AS recording, count(*) AS events, count(*) FILTER (id <> 4663 AND NOT (id = 4688 AND k % 10 = 9)) AS accepted, count(*) FILTER (id = 4663) AS unsupported,
  count(*) FILTER (id = 4688 AND k % 10 = 9) AS rejected FROM sec GROUP BY ALL),
j AS (SELECT recording, count(*) FILTER (outcome = 'matching') AS matching, count(*) FILTER (outcome = 'harness') AS harness, count(*) FILTER (outcome = 'other') AS other FROM judged GROUP BY ALL)
SELECT recording, technique, events, accepted, unsupported, rejected, coalesce(matching, 0) AS matching, coalesce(harness, 0) AS harness, coalesce(other, 0) AS other, coalesce(matching, 0) > 0 AS detected
FROM want JOIN r USING (recording) LEFT JOIN j USING (recording)""")
sql("detection_set_scores", TEL, SINGLE, _CARD)("""
SELECT purpose, count(*) FILTER (EXISTS (SELECT 1 FROM judged j WHERE j.recording = want.recording AND j.outcome = 'matching')) AS detected, count(*) AS recorded FROM want GROUP BY ALL""")
sql("common_reject_reasons", TEL, _OCSF)("""
, n AS (SELECT source_id AS recording, CASE WHEN k = 0 THEN 'parse_error' ELSE 'invalid' END AS kind, reason, count(*) AS n FROM ocsf WHERE reason IS NOT NULL GROUP BY ALL)
SELECT *, row_number() OVER (PARTITION BY recording, kind ORDER BY n DESC, reason) AS rank FROM n QUALIFY rank <= 3""")
sql("answer_scores", TEL, _GROUND)("""
, kept AS (SELECT DISTINCT analysis_id, unnest(evidence) AS uid FROM g WHERE reason IS NULL),
ke AS (SELECT DISTINCT conv_id AS analysis_id, turn % 3 AS label, sha256('ev' || ((conv_id * 10 + turn) % 300)) AS uid FROM conversations),
lab AS (SELECT k.analysis_id, label, count(x.uid) > 0 AS hit FROM ke k LEFT JOIN kept x ON x.analysis_id = k.analysis_id AND x.uid = k.uid GROUP BY ALL),
l AS (SELECT analysis_id, count(*) FILTER (hit) AS key_found, count(*) AS key_events FROM lab GROUP BY ALL),
t AS (SELECT conv_id AS analysis_id, count(DISTINCT turn % 4) AS techniques_suggested, count(DISTINCT turn % 4) FILTER (turn % 4 = conv_id % 4) AS techniques_right FROM conversations GROUP BY ALL),
a AS (SELECT analysis_id, count(*) AS statements, count(*) FILTER (reason IS NOT NULL) AS dropped FROM g GROUP BY ALL)
SELECT analysis_id, statements, dropped, key_found, key_events, techniques_right, techniques_suggested, CAST(1 AS BIGINT) AS techniques_expected FROM a JOIN l USING (analysis_id) JOIN t USING (analysis_id)""")

# ---------------------------------------------------------------------------------------------- investigation
_ORG = "CASE WHEN source_id = 'src-2' THEN 'org-2' ELSE 'org-1' END"
_INV_SPRAY = _threshold("class_uid = 3002 AND status_id = 2", f"{_ORG} || '|' || src_ip", "user_name", 4, 86_400_000)
# Findings in order, one recursion a finding: the state is the list of incidents that can still be reached.
_INV = f"""
inv AS (SELECT *, {_ORG} AS org, CASE WHEN event_type = 'click' AND k % 4 = 0 AND k % 20 <> user_id % 20 THEN 'ws-' || (k % 20) END AS named FROM tel),
seen AS (
  SELECT s.event_uid, i.org, s.time_ms, s.entity_key, s.links FROM sight s JOIN inv i ON i.event_uid = s.event_uid
  UNION ALL SELECT event_uid, org, time_ms, 'host:' || named, true FROM inv WHERE named IS NOT NULL),
fnd AS (
  SELECT i.org, s.finding_id, s.time_ms AS first_ms, s.time_ms AS last_ms, [s.event_uid] AS evidence, s.rule_title, s.severity_id, s.technique, s.tactic
    FROM single_f s JOIN inv i ON i.event_uid = s.event_uid WHERE s.rule_id NOT LIKE '%-0004-%'
  UNION ALL SELECT split_part(g, '|', 1),
    sha256('{_SPRAY_ID}' || chr(31) || split_part(g, '|', 2) || chr(31) || at_ms || chr(31) || first(event_uid ORDER BY rn) || chr(31)),
    min(time_ms), at_ms, list(event_uid ORDER BY rn), 'One source fails as many accounts', 3, 'T1110.003', 'credential_access'
    FROM ev WHERE rn <= 100 GROUP BY g, at_ms),
cites AS (SELECT org, finding_id, first_ms, unnest(evidence) AS event_uid, generate_subscripts(evidence, 1) AS position FROM fnd),
shows AS (SELECT c.*, s.time_ms, s.entity_key, s.links FROM cites c JOIN seen s ON s.event_uid = c.event_uid),
lined AS (
  SELECT f.*, k.keys, row_number() OVER (PARTITION BY f.org ORDER BY f.first_ms, f.finding_id) AS n
  FROM fnd f JOIN (SELECT finding_id, list_sort(list(DISTINCT entity_key)) AS keys FROM shows WHERE links GROUP BY finding_id) k ON k.finding_id = f.finding_id),
fold AS (
  SELECT DISTINCT org, 0::BIGINT AS n, ''::VARCHAR AS finding_id, ''::VARCHAR AS incident_id, NULL::VARCHAR[] AS shared,
    []::STRUCT(num BIGINT, id VARCHAR, first_ms BIGINT, last_ms BIGINT, keys VARCHAR[])[] AS state FROM fnd
  UNION ALL
  SELECT org, n, finding_id, coalesce(best.id, new_id), list_sort(best.both), list_append(
      [i FOR i IN live IF best IS NULL OR i.num <> best.num],
      {{'num': coalesce(best.num, n), 'id': coalesce(best.id, new_id), 'first_ms': least(coalesce(best.first_ms, first_ms), first_ms),
        'last_ms': greatest(coalesce(best.last_ms, last_ms), last_ms), 'keys': list_distinct(list_concat(coalesce(best.keys, []), keys))}})
  FROM (
    SELECT *, list_sort([{{'shared': len(list_intersect(i.keys, keys)), 'last_ms': i.last_ms, 'num': i.num, 'id': i.id, 'first_ms': i.first_ms, 'keys': i.keys,
                          'both': list_intersect(i.keys, keys)}} FOR i IN live IF i.first_ms <= last_ms + 7200000 AND len(list_intersect(i.keys, keys)) > 0], 'DESC')[1] AS best
    FROM (
      SELECT o.org, o.n, o.finding_id, o.first_ms, o.last_ms, o.keys, sha256('incident' || chr(31) || o.org || chr(31) || o.finding_id || chr(31)) AS new_id,
        [i FOR i IN f.state IF i.last_ms >= o.first_ms - 7200000] AS live
      FROM fold f JOIN lined o ON o.org = f.org AND o.n = f.n + 1))),
placed AS (
  SELECT f.*, a.incident_id, a.shared, sha256('link' || chr(31) || a.incident_id || chr(31) || f.finding_id || chr(31)) AS link_id
  FROM fnd f JOIN (SELECT * FROM fold WHERE n > 0) a ON a.finding_id = f.finding_id),
rec AS (
  SELECT p.incident_id, s.org, s.entity_key, s.links, s.event_uid, s.time_ms, min({{'a': s.first_ms, 'b': s.finding_id, 'c': s.position}}) AS place
  FROM shows s JOIN placed p ON p.finding_id = s.finding_id GROUP BY ALL),
held AS (SELECT incident_id, entity_key, list(event_uid ORDER BY place, event_uid)[1:20] AS events FROM rec GROUP BY ALL),
fails AS (
  SELECT p.org, p.incident_id, h.entity_key AS source_key, p.link_id, p.first_ms, p.last_ms, list(c.event_uid ORDER BY c.position) AS uids
  FROM placed p JOIN cites c ON c.finding_id = p.finding_id JOIN held h ON h.incident_id = p.incident_id AND h.entity_key LIKE 'ip:%' AND list_contains(h.events, c.event_uid)
  WHERE p.technique LIKE 'T1110%' GROUP BY ALL),
followed AS (
  SELECT f.incident_id, i.org, i.event_uid, i.time_ms, i.scoped, f.source_key, [h FOR h IN ['host:' || i.host, 'host:' || i.named] IF h IS NOT NULL] AS hosts,
    count(*) AS failures, list_distinct(flatten(list(f.uids ORDER BY f.first_ms, f.link_id))) AS any_uids, flatten(list(f.uids ORDER BY f.first_ms, f.link_id)) AS uids
  FROM inv i JOIN fails f ON f.org = i.org AND f.source_key = 'ip:' || i.src_ip AND f.first_ms <= i.time_ms AND i.time_ms - f.last_ms <= 3600000
  WHERE i.class_uid = 3002 AND i.status_id = 1 GROUP BY ALL),
reach AS (
  SELECT incident_id, entity_key, (-1)::BIGINT AS at_ms, '' AS uid FROM held WHERE entity_key LIKE 'host:%'
  UNION SELECT l.incident_id, unnest(l.hosts), l.time_ms, l.event_uid FROM reach r
    JOIN followed l ON l.incident_id = r.incident_id AND list_contains(l.hosts, r.entity_key) AND (r.at_ms < l.time_ms OR (r.at_ms = l.time_ms AND r.uid < l.event_uid))),
onto AS (
  SELECT DISTINCT l.incident_id, l.event_uid, l.time_ms, r.entity_key FROM followed l
  JOIN reach r ON r.incident_id = l.incident_id AND list_contains(l.hosts, r.entity_key) AND (r.at_ms < l.time_ms OR (r.at_ms = l.time_ms AND r.uid < l.event_uid))),
done AS (SELECT l.* FROM followed l WHERE EXISTS (SELECT 1 FROM onto o WHERE o.incident_id = l.incident_id AND o.event_uid = l.event_uid)),
sooner AS (
  SELECT o.incident_id, o.event_uid, o.entity_key,
    list(d.event_uid ORDER BY d.time_ms, d.event_uid) FILTER (d.event_uid IS NOT NULL) AS uids
  FROM onto o LEFT JOIN done d ON d.incident_id = o.incident_id AND list_contains(d.hosts, o.entity_key) AND (d.time_ms < o.time_ms OR (d.time_ms = o.time_ms AND d.event_uid < o.event_uid))
  GROUP BY ALL),
on_hosts AS (
  SELECT s.incident_id, s.event_uid, list(s.entity_key ORDER BY s.entity_key) AS keys,
    list(array_to_string([u FOR u, n IN list_concat(coalesce(h.events, []), [v FOR v IN coalesce(s.uids, []) IF NOT list_contains(coalesce(h.events, []), v)]) IF n <= 5], '+') ORDER BY s.entity_key) AS shown
  FROM sooner s LEFT JOIN held h ON h.incident_id = s.incident_id AND h.entity_key = s.entity_key GROUP BY ALL),
firsts AS (SELECT *, list_position(uids, u) AS spot FROM (SELECT incident_id, event_uid, uids, unnest(any_uids) AS u FROM done)),
failed AS (SELECT incident_id, event_uid, array_to_string(list(u ORDER BY spot)[1:5], '+') AS shown FROM firsts GROUP BY ALL),
matches AS (
  SELECT p.link_id, r.entity_key,
    array_to_string((list(r.event_uid ORDER BY r.place, r.event_uid) FILTER ({{'a': r.place.a, 'b': r.place.b}} < {{'a': p.first_ms, 'b': p.finding_id}} AND list_contains(h.events, r.event_uid)))[1:5], '+') AS before,
    (SELECT array_to_string(list(x.event_uid ORDER BY x.position)[1:5], '+') FROM shows x WHERE x.finding_id = p.finding_id AND x.entity_key = r.entity_key AND x.links) AS own
  FROM placed p JOIN rec r ON r.incident_id = p.incident_id AND list_contains(p.shared, r.entity_key)
  JOIN held h ON h.incident_id = r.incident_id AND h.entity_key = r.entity_key GROUP BY p.link_id, p.finding_id, p.first_ms, r.entity_key),
told AS (SELECT link_id, string_agg(entity_key, ',' ORDER BY entity_key) AS matched, string_agg(coalesce(before, '') || '>' || own, ',' ORDER BY entity_key) AS shown FROM matches GROUP BY link_id),
link AS (
  SELECT p.org, p.incident_id, p.link_id, 'finding' AS kind, CASE WHEN p.shared IS NULL THEN 'opened' ELSE 'shared-entity' END AS rule,
    CASE WHEN p.shared IS NULL THEN 'no open incident shared an entity within 2h' ELSE 'shares ' || array_to_string(p.shared, ', ') || ' with activity within 2h' END AS reason,
    p.evidence, coalesce(t.matched, '') AS matched, coalesce(t.shown, '') AS shown, p.first_ms, p.last_ms, p.rule_title, p.severity_id, p.technique, p.tactic, NULL::VARCHAR AS source_key
  FROM placed p LEFT JOIN told t ON t.link_id = p.link_id
  UNION ALL SELECT d.org, d.incident_id, sha256('link' || chr(31) || d.incident_id || chr(31) || d.event_uid || chr(31)), 'event', 'auth-success-after-failures',
    'successful logon as ' || d.scoped || ' from ' || d.source_key[4:] || ' to ' || array_to_string([k[6:] FOR k IN o.keys], ', ') || ' after ' || d.failures || ' brute-force finding(s) from the same source',
    [d.event_uid], d.source_key || ',' || array_to_string(o.keys, ','),
    w.shown || '>' || d.event_uid || ',' || array_to_string([x || '>' || d.event_uid FOR x IN o.shown], ','), d.time_ms, d.time_ms, NULL::VARCHAR, NULL::INTEGER, NULL::VARCHAR, NULL::VARCHAR, d.source_key
  FROM done d JOIN on_hosts o ON o.incident_id = d.incident_id AND o.event_uid = d.event_uid JOIN failed w ON w.incident_id = d.incident_id AND w.event_uid = d.event_uid),
ents AS (
  SELECT org, incident_id, entity_key, links, min(time_ms) AS first_ms, max(time_ms) AS last_ms, least(20, count(DISTINCT event_uid)) AS events
  FROM (SELECT org, incident_id, entity_key, links, event_uid, time_ms FROM rec
        UNION SELECT d.org, d.incident_id, s.entity_key, s.links, s.event_uid, s.time_ms FROM done d JOIN seen s ON s.event_uid = d.event_uid) GROUP BY ALL)"""
_WHOLE = """,
tot AS (
  SELECT org, incident_id, min(first_ms) AS first_ms, max(last_ms) AS last_ms, count(*) FILTER (kind = 'finding') AS finding_count, count(*) FILTER (kind = 'event') > 0 AS broken,
    arg_max({'t': rule_title, 's': severity_id}, {'s': severity_id, 'e': -first_ms, 'l': link_id}) FILTER (kind = 'finding') AS top,
    first(source_key ORDER BY first_ms, link_id) FILTER (kind = 'event') AS source_key, list_sort(list(DISTINCT technique) FILTER (technique IS NOT NULL)) AS techniques
  FROM link GROUP BY org, incident_id),
tac AS (
  SELECT incident_id, list(tactic ORDER BY spot) AS tactics FROM (
    SELECT incident_id, tactic, min({'f': first_ms, 'l': link_id}) AS spot FROM link WHERE tactic IS NOT NULL GROUP BY ALL) GROUP BY incident_id),
evs AS (SELECT incident_id, count(DISTINCT u) AS event_count FROM (SELECT incident_id, unnest(evidence) AS u FROM link) GROUP BY incident_id),
hosts AS (SELECT incident_id, list(entity_key[6:] ORDER BY first_ms, entity_key) AS hosts FROM ents WHERE entity_key LIKE 'host:%' GROUP BY incident_id),
incident AS (
  SELECT t.*, c.tactics, e.event_count, len(c.tactics) >= 3 AS staged, [replace(x, '_', ' ') FOR x IN c.tactics] AS words,
    [replace(x, '_', ' ') FOR x IN c.tactics IF x <> 'credential_access'] AS later,
    ' on ' || array_to_string(h.hosts[1:2], ', ') || CASE WHEN len(h.hosts) > 2 THEN ' and ' || (len(h.hosts) - 2) || ' more' ELSE '' END AS place
  FROM tot t JOIN tac c ON c.incident_id = t.incident_id JOIN evs e ON e.incident_id = t.incident_id JOIN hosts h ON h.incident_id = t.incident_id)"""
_INVESTIGATION = (TEL, SIGHTINGS, SINGLE, _INV_SPRAY, _INV)
sql("incident_links", *_INVESTIGATION, recursive=True)("""
SELECT org AS org_id, incident_id, link_id, kind, rule, reason, CAST(len(evidence) AS INTEGER) AS events, matched, shown FROM link""")
sql("incident_entities", *_INVESTIGATION, recursive=True)("""
SELECT incident_id, entity_key, links, first_ms, last_ms, CAST(events AS INTEGER) AS events FROM ents""")
sql("incident_indicators", *_INVESTIGATION, recursive=True)("""
SELECT DISTINCT org AS org_id, incident_id, entity_key FROM ents WHERE links AND (entity_key LIKE 'ip:%' OR entity_key LIKE 'domain:%')""")
sql("incidents", *_INVESTIGATION, recursive=True)(f"""{_WHOLE}
SELECT incident_id, left(CASE
    WHEN broken THEN 'Successful logon after repeated failures from ' || source_key[4:]
      || CASE WHEN len(later) > 0 THEN ', then ' || array_to_string(later[1:4], ', ') || CASE WHEN len(later) > 4 THEN ' and ' || (len(later) - 4) || ' more' ELSE '' END ELSE '' END
    WHEN staged THEN 'Multi-stage activity (' || array_to_string(words[1:4], ', ') || ')' ELSE top.t END || place, 255) AS title,
  CAST(CASE WHEN broken AND staged THEN 5 WHEN broken OR staged THEN greatest(top.s, 4) ELSE top.s END AS INTEGER) AS severity_id,
  first_ms, last_ms, finding_count, event_count, array_to_string(techniques, ',') AS techniques, array_to_string(tactics, ',') AS tactics FROM incident""")
sql("incident_assessments", *_INVESTIGATION, recursive=True)(f"""{_WHOLE}
SELECT incident_id, 'highest-finding-severity' AS rule, CAST(top.s AS INTEGER) AS severity_id, 'most severe linked finding: ' || top.t AS because FROM incident
UNION ALL SELECT incident_id, 'credential-compromise', 4, 'a logon succeeded after brute-force failures from its source' FROM incident WHERE broken
UNION ALL SELECT incident_id, 'multi-stage', 4, 'findings span ' || len(tactics) || ' ATT&CK tactics: ' || array_to_string(tactics, ', ') FROM incident WHERE staged
UNION ALL SELECT incident_id, 'compromise-then-activity', 5, 'a compromised logon came before activity in several tactics' FROM incident WHERE broken AND staged""")

_INV_STEPS = STEPS.replace("source_id AS incident_id", "c.incident_id").replace(
    "FROM tel\n", "FROM tel JOIN (SELECT DISTINCT incident_id, unnest(evidence) AS uid FROM link) c ON c.uid = event_uid\n"
)
sql("incident_steps", *_INVESTIGATION, _INV_STEPS, recursive=True)("""
SELECT incident_id, step_id, any_value(action) AS action, min(time_ms) AS first_ms, count(*) AS event_count FROM members GROUP BY incident_id, step_id""")

# -------------------------------------------------------------------------------------------- loaded rule files
_PACK = """
pack AS (SELECT page_id AS p, page_id % 6 AS kind, page_id // 6 AS n, 'r' || page_id AS r FROM pages),
taken AS (SELECT 'r' || (p - 1) AS rule_id FROM pack WHERE kind = 3 AND n % 2 = 1),
files AS (
  SELECT *, CASE kind WHEN 0 THEN 'own/d' || (p % 5) || '/' WHEN 1 THEN 'community/win/' WHEN 2 THEN 'community/win/sub/' WHEN 3 THEN 'own/' ELSE 'community/count/' END || r || '.json' AS file,
    CASE WHEN kind = 3 AND n % 2 = 1 THEN 'r' || (p - 1) ELSE r END AS own_id FROM pack),
loaded AS (
  SELECT file AS path, own_id AS rule_id, 'Rule ' || own_id AS title, 'single' AS rule_type, 2 AS severity_id, 'T1071.004' AS techniques,
    CASE WHEN kind = 2 THEN 'https://rules.example/v1/w/' || p || '.yml' END AS source_url, NULL::INTEGER AS threshold, NULL::BIGINT AS window_ms, NULL::VARCHAR AS reason
    FROM files WHERE kind IN (0, 3) OR (kind = 2 AND own_id NOT IN (SELECT rule_id FROM taken))
  UNION ALL SELECT file || '#2', 'c' || p, 'Count ' || p, 'threshold', 3, '', NULL, 3 + n % 4, 3600000, NULL FROM files WHERE kind = 4
  UNION ALL SELECT file || '#1', 'b' || p, 'Rule b' || p, 'single', 2, 'T1071.004', NULL, NULL, NULL, NULL FROM files WHERE kind = 5
  UNION ALL SELECT file, NULL, NULL, NULL, NULL, NULL, NULL, NULL, NULL, 'field ''Nope'' is not mapped for logsource dns_query' FROM files WHERE kind = 1
  UNION ALL SELECT file, NULL, NULL, NULL, NULL, NULL, NULL, NULL, NULL, 'duplicate rule id ' || own_id FROM files WHERE kind = 2 AND own_id IN (SELECT rule_id FROM taken)
  UNION ALL SELECT file || '#2', NULL, NULL, NULL, NULL, NULL, NULL, NULL, NULL, 'no rule named ''gone' || p || '''' FROM files WHERE kind = 5)"""
sql("loaded_rules", _PACK)("SELECT * FROM loaded")
sql("rule_import_tally", _PACK)("""
SELECT CASE WHEN reason IS NULL THEN 'selected' ELSE 'refused' END AS outcome, reason, count(*) AS rules FROM loaded GROUP BY ALL""")
sql("selected_rule_files", _PACK)("""
, kept AS (SELECT DISTINCT split_part(path, '#', 1) AS path FROM loaded WHERE reason IS NULL)
SELECT 'r1' AS release, (SELECT count(*) FROM kept) AS selected, k.path, CAST(length(CASE
    WHEN f.kind = 0 THEN '{"id": "' || own_id || '", "title": "Rule ' || own_id || '", "level": "low", "tags": ["attack.t1071.004"], "logsource": {"category": "dns_query"}, "detection": {"wanted": {"QueryName": "site' || (p % 15) || '.example"}, "condition": "wanted"}}'
    WHEN f.kind = 2 THEN '{"id": "' || own_id || '", "title": "Rule ' || own_id || '", "level": "low", "tags": ["attack.t1071.004"], "logsource": {"category": "dns_query"}, "detection": {"wanted": {"QueryName": "site' || (p % 15) || '.example", "Image": "-"}, "condition": "wanted"}}'
    WHEN f.kind = 3 THEN '{"id": "' || own_id || '", "title": "Rule ' || own_id || '", "level": "low", "tags": ["attack.t1071.004"], "logsource": {"category": "dns_query"}, "detection": {"wanted": {"QueryName": "-"}, "condition": "wanted"}}'
    ELSE '{"id": "b' || p || '", "title": "Rule b' || p || '", "level": "low", "tags": ["attack.t1071.004"], "logsource": {"category": "dns_query"}, "detection": {"wanted": {"QueryName|startswith": "site"}, "condition": "wanted"}, "name": "base' || p || '"}' || chr(10) || '---' || chr(10) || '{"id": "c' || p || '", "title": "Count ' || p || '", "level": "medium", "correlation": {"type": "event_count", "rules": ["' || CASE f.kind WHEN 4 THEN 'base' ELSE 'gone' END || p || '"], "group-by": ["QueryName"], "timespan": "1h", "condition": {"gte": ' || (3 + n % 4) || '}}}' END) AS INTEGER) AS length
FROM kept k JOIN files f ON f.file = k.path""")
sql("loaded_rule_matches", TEL, _PACK)("""
SELECT l.rule_id, count(*) AS n FROM loaded l JOIN files f ON f.file = split_part(l.path, '#', 1) JOIN tel t ON t.class_uid = 4003
WHERE l.rule_type = 'single' AND CASE WHEN f.kind IN (0, 2) THEN t.query_hostname = 'site' || (f.p % 15) || '.example' WHEN f.kind = 5 THEN t.query_hostname LIKE 'site%' ELSE false END
GROUP BY l.rule_id""")
sql("loaded_count_findings", TEL, _threshold("class_uid = 4003 AND query_hostname LIKE 'site%'", "query_hostname", "event_uid", 4, 3_600_000), recursive=True)("""
SELECT g AS site, at_ms, CAST(count(*) AS INTEGER) AS events FROM ev WHERE rn <= 100 AND EXISTS (SELECT 1 FROM pages WHERE page_id % 6 = 4 AND page_id // 6 % 4 = 1) GROUP BY g, at_ms""")

# ---------------------------------------------------------------------------------------------- answers as text
sql("answer_statements", TEL)("""
, a AS (SELECT event_id, 'f' || event_id AS name, k % 5 AS form FROM tel)
SELECT event_id AS analysis_id, 0::INTEGER AS position, 'FACT' AS kind, name AS text, 'e1,' || name AS evidence FROM a WHERE form < 3
UNION ALL SELECT event_id, 1, 'UNCERTAINTY', name || '?', 'e1,' || name || '?' FROM a WHERE form < 3
UNION ALL SELECT event_id, n::INTEGER - 1, 'FACT', name || '-' || n, 'e1,' || name || '-' || n FROM a, range(1, 41) r(n) WHERE form = 4""")
ORACLE["index_outcome"] = f"""WITH {TEL},{_COPIES}
SELECT count(*) FILTER (k <> 13 AND time_ms >= 1705000000000) AS indexed,
  CAST(sum(CASE WHEN k = 13 THEN 0 WHEN time_ms >= 1705000000000 THEN n - 1 ELSE n END) AS BIGINT) AS duplicates,
  CAST(coalesce(sum(n) FILTER (k = 13), 0) AS BIGINT) AS failed FROM copies"""
