"""The registered queries in plain SQL over the same tables."""

from __future__ import annotations

from palisade.adapter import ALERTS_SQL, DENSE_SQL, LINES_SQL, SEC_SQL

DAY = "INTERVAL 1 DAY"

SSHD = r"'^([A-Za-z]{3})\s+(\d{1,2})\s+(\d\d:\d\d:\d\d)\s+(\S+)\s+sshd\[\d+\]:\s+(.*)$'"


def sec(sql: str) -> str:
    return f"WITH {SEC_SQL} {sql}"


def lines(sql: str) -> str:
    return f"WITH {LINES_SQL} {sql}"


def alerts(sql: str) -> str:
    return f"WITH {ALERTS_SQL} {sql}"


EXTERNAL = """NOT (o1 IN (0, 10, 127) OR (o1 = 169 AND o2 = 254) OR (o1 = 172 AND o2 BETWEEN 16 AND 31)
  OR (o1 = 192 AND o2 = 0 AND o3 IN (0, 2)) OR (o1 = 192 AND o2 = 168) OR (o1 = 198 AND o2 IN (18, 19))
  OR (o1 = 198 AND o2 = 51 AND o3 = 100) OR (o1 = 203 AND o2 = 0 AND o3 = 113) OR o1 >= 224)"""

FAILED = "event_type = 'ssh_login' AND status = 'failure'"
PRIVILEGED = """ "user" IN ('root', 'admin', 'administrator') AND status = 'success' AND (hour(ts) < 7 OR hour(ts) >= 20)"""


def counted(name: str, what: str, where: str, keys: str) -> str:
    return f"""{name} AS (SELECT *, count({what}) OVER (PARTITION BY {keys} ORDER BY ts
      RANGE BETWEEN INTERVAL 1 DAY PRECEDING AND CURRENT ROW) AS c FROM sec WHERE {where})"""


def fold(candidates: str, lane: str = "''") -> str:
    """Emission in time order: once per key and minute, 15 minutes between alerts of an entity.

    ``candidates`` yields ``g`` (group), ``e`` (entity), ``ts``, ``seq``, ``id``; the state of a
    group is the last emitted minute of each of its keys (``lane``) and the entities' clocks.
    """
    return f"""cand AS ({candidates}),
num AS (SELECT *, row_number() OVER (PARTITION BY g ORDER BY ts, seq) AS rn FROM cand),
walk AS (
  SELECT g, rn, id, ts, true AS emit, MAP {{{lane}: date_trunc('minute', ts)}} AS markers, MAP {{e: ts}} AS clocks FROM num n WHERE rn = 1
  UNION ALL
  SELECT n.g, n.rn, n.id, n.ts, d.emit,
    CASE WHEN d.emit THEN map_concat(w.markers, MAP {{{lane}: date_trunc('minute', n.ts)}}) ELSE w.markers END,
    CASE WHEN d.emit THEN map_concat(w.clocks, MAP {{n.e: n.ts}}) ELSE w.clocks END
  FROM walk w JOIN num n ON n.g = w.g AND n.rn = w.rn + 1,
  LATERAL (SELECT coalesce(date_trunc('minute', n.ts) <> w.markers[{lane}], true)
    AND coalesce(n.ts - w.clocks[n.e] >= INTERVAL 15 MINUTE, true) AS emit) d
)"""


def entity_fold(candidates: str, own: str = "") -> str:
    """15 minutes between alerts of an entity; the next emitted is the first one far enough on. ``own`` begins the
    names of the steps."""
    return f"""{own}cand AS ({candidates}),
{own}walk AS (
  SELECT g, min(ts) AS ts FROM {own}cand GROUP BY g
  UNION ALL
  SELECT w.g, (SELECT min(c.ts) FROM {own}cand c WHERE c.g = w.g AND c.ts >= w.ts + INTERVAL 15 MINUTE) AS ts
  FROM {own}walk w WHERE w.ts IS NOT NULL
),
emitted AS (SELECT c.* FROM {own}cand c JOIN {own}walk w ON c.g = w.g AND c.ts = w.ts)"""


def rec(sql: str) -> str:
    return f"WITH RECURSIVE {SEC_SQL}, {sql}"


ENTITY = """coalesce(src_ip, '~') || '/' || coalesce("user", '~') || '/' || coalesce(asset, '~')"""

WORD_RULE = """CASE WHEN m LIKE '%password%' OR m LIKE '%licen%' THEN 1 WHEN m LIKE '%the ent%' OR m LIKE '%élle%' THEN 2
  WHEN m LIKE '%and the%' THEN 3 WHEN m LIKE '%les %' THEN 4 END"""
DOC_ALERTS = f"""
n AS (SELECT *, lower(text) AS m, row_number() OVER (ORDER BY doc_id) AS number FROM documents),
doc_alerts AS (
  SELECT 'ALT-' || (1040 + number) AS id, number,
    ['SSH Brute Force', 'Suspicious PowerShell', 'Port Scan', 'Admin Account Created'][w] AS title,
    ['Critical', 'High', 'Medium', 'High'][w] AS severity, [94, 86, 76, 86][w] AS confidence, source, lang AS asset,
    ['Credential Access', 'Execution', 'Discovery', 'Persistence'][w] AS tactic,
    ['T1110', 'T1059.001', 'T1046', 'T1136'][w] AS technique,
    ['New', 'Investigating', 'Contained', 'Investigating'][w] AS status,
    'Review evidence and escalate if confirmed.' AS recommendation
  FROM (SELECT *, {WORD_RULE} AS w FROM n) WHERE w IS NOT NULL)
"""
OLDER_INCIDENTS = """
older AS (SELECT i.id, i.title, i.priority, i.status, i.owner, count(*) + i.pad AS related_alerts FROM doc_alerts a JOIN (VALUES
    ('Credential Access', 'INC-219', 'Suspected brute-force campaign', 'P1', 'Investigating', 'SOC L1', 13),
    ('Execution', 'INC-218', 'PowerShell execution chain', 'P2', 'Containment', 'SOC L2', 5),
    ('Persistence', 'INC-217', 'Identity privilege change', 'P2', 'Review', 'IR Team', 3)
  ) i(t, id, title, priority, status, owner, pad) ON a.tactic = i.t GROUP BY i.t, i.id, i.title, i.priority, i.status, i.owner, i.pad)
"""

FIRSTS = """
firsts AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY "user", src_ip ORDER BY ts, seq) AS f
  FROM sec WHERE {where}) WHERE f = 1),
ranked AS (SELECT *, row_number() OVER (PARTITION BY "user" ORDER BY ts, seq) AS r FROM firsts),
rare AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY "user" ORDER BY ts, seq) AS h FROM ranked
  WHERE r > 3 AND src_ip LIKE '185.%') WHERE h = 1)
"""
LOGINS = """event_type = 'ssh_login' AND status = 'success' AND "user" <> '' AND src_ip <> ''"""
SUCCESSES = """status = 'success' AND "user" <> '' AND src_ip <> ''"""

Z = "CASE WHEN count(*) OVER () < 2 OR stddev_pop(n) OVER () = 0 THEN 0 ELSE greatest(0, (n - avg(n) OVER ()) / stddev_pop(n) OVER ()) END"
VOLUMES = f"volumes AS (SELECT asset, n, first_seq, {Z} AS z FROM (SELECT asset, count(*) AS n, min(seq) AS first_seq FROM sec WHERE asset <> '' GROUP BY asset))"
FAILURES = f"""failures AS (SELECT "user", src_ip, n, first_seq, {Z} AS z FROM
  (SELECT "user", src_ip, count(*) AS n, min(seq) AS first_seq FROM sec WHERE {FAILED} GROUP BY "user", src_ip))"""
PROCESSES = """
runs AS (SELECT *, coalesce(nullif("user", ''), nullif(asset, ''), 'unknown') AS entity, lower(process_name) AS proc
  FROM sec WHERE process_name <> '' AND command_line <> ''),
proc_firsts AS (SELECT *, row_number() OVER (PARTITION BY entity ORDER BY ts, seq) AS r FROM
  (SELECT *, row_number() OVER (PARTITION BY entity, proc ORDER BY ts, seq) AS f FROM runs) WHERE f = 1),
new_processes AS (SELECT * FROM proc_firsts WHERE r > 1 AND (lower(command_line) LIKE '%-enc%'
  OR lower(command_line) LIKE '%downloadstring%' OR lower(command_line) LIKE '%frombase64string%'))
"""
ANOMALIES = f"""
{VOLUMES}, {FAILURES}, {FIRSTS.format(where=SUCCESSES)}, {PROCESSES},
anomalies AS (
  SELECT 'volume' AS family, asset AS entity, least(0.99, 0.55 + z / 5) AS score,
    'Unusual event volume for asset ' || asset AS reason, NULL AS event_id, 0 AS o1, first_seq AS o2, 0 AS o3, 0 AS o4,
    NULL AS "user", NULL AS src_ip
  FROM volumes WHERE n >= 25 AND z >= 1
  UNION ALL SELECT 'failed_logins', coalesce("user", 'None') || '@' || coalesce(src_ip, 'None'), least(0.98, 0.6 + z / 5),
    'Abnormal failed-login volume for ' || coalesce("user", 'None') || ' from ' || coalesce(src_ip, 'None'), NULL,
    1, first_seq, 0, 0, "user", src_ip FROM failures WHERE n >= 5
  UNION ALL SELECT 'rare_source', "user", 0.8, 'Rare external source IP ' || src_ip || ' for user ' || "user", id,
    2, epoch_us(ts), seq, 0, NULL, NULL FROM rare
  UNION ALL SELECT 'off_hours', "user", 0.76, 'Privileged access outside business hours', id, 2, epoch_us(ts), seq, 1, NULL, NULL
    FROM sec WHERE {PRIVILEGED}
  UNION ALL SELECT 'process', entity, 0.81, 'Unusual command usage: ' || process_name, id, 2, epoch_us(ts), seq, 2, NULL, NULL
    FROM new_processes),
top20 AS (SELECT * FROM anomalies ORDER BY score DESC, o1, o2, o3, o4 LIMIT 20)
"""

# Alerts linked by attribute: breaks where the gap exceeds 30 minutes, then the closure over
# alerts of the smallest alert id that can be reached.
COMPONENTS = """
vals AS (SELECT alert_id, ts, kind, val FROM (
    SELECT alert_id, ts, unnest(['asset', 'user', 'src_ip', 'tactic']) AS kind, unnest([asset, "user", src_ip, tactic]) AS val
    FROM alerts) WHERE val IS NOT NULL),
runs AS (SELECT *, sum(brk) OVER (PARTITION BY kind, val ORDER BY ts, alert_id) AS run FROM (
    SELECT *, CASE WHEN ts - lag(ts) OVER (PARTITION BY kind, val ORDER BY ts, alert_id) <= INTERVAL 30 MINUTE THEN 0 ELSE 1 END AS brk
    FROM vals)),
links AS (SELECT DISTINCT a.alert_id AS x, b.alert_id AS y FROM (
    SELECT alert_id, min(alert_id) OVER (PARTITION BY kind, val, run) AS head FROM runs) a
  JOIN (SELECT alert_id, min(alert_id) OVER (PARTITION BY kind, val, run) AS head FROM runs) b ON a.head = b.alert_id AND b.alert_id = a.head),
edges AS (SELECT x, y FROM links UNION SELECT y, x FROM links),
reach AS (
  SELECT alert_id, alert_id AS r FROM alerts
  UNION
  SELECT reach.alert_id, edges.y FROM reach JOIN edges ON edges.x = reach.r
),
comp AS (SELECT alert_id, min(r) AS incident FROM reach GROUP BY alert_id),
members AS (SELECT a.*, c.incident FROM alerts a JOIN comp c USING (alert_id))
"""
PRIORITY = """CASE WHEN max(severity = 'critical') OR sum(weight) >= 8 THEN 'P1'
  WHEN max(severity = 'high') OR sum(weight) >= 5 THEN 'P2' ELSE 'P3' END"""

ALERT_INCIDENTS = """incidents AS (SELECT CASE severity WHEN 'critical' THEN 'P1' WHEN 'high' THEN 'P2' ELSE 'P3' END AS priority,
  CASE tactic WHEN 'Discovery' THEN 'closed' ELSE 'open' END AS status FROM alerts)"""
RISK = """least(100, (SELECT sum(CASE severity WHEN 'critical' THEN 20 WHEN 'high' THEN 12 WHEN 'medium' THEN 6 WHEN 'low' THEN 2 ELSE 1 END) FROM alerts)
  + (SELECT sum(CASE priority WHEN 'P1' THEN 25 WHEN 'P2' THEN 14 WHEN 'P3' THEN 6 ELSE 1 END) FROM incidents WHERE status = 'open'))"""
TACTIC_ORDER = "SELECT tactic, count(*) AS n, min({'a': -weight, 'b': -confidence, 'c': -epoch_us(ts), 'd': seq}) AS place FROM alerts GROUP BY tactic ORDER BY n DESC, place LIMIT 5"

COVERAGE = """c AS (SELECT 'R-' || c_custkey AS rule_id,
  CASE WHEN c_mktsegment <> 'MACHINERY' THEN c_mktsegment ELSE 'Unknown' END AS tactic,
  CASE WHEN c_nationkey > 0 THEN 'T' || c_nationkey ELSE 'Unknown' END AS technique FROM customer)"""

JSON_EVENT = r"""'{"id":"' || id || '","timestamp":"' || strftime(ts, '%Y-%m-%dT%H:%M:%S.%f') || '+00:00","source":"' || source
  || '","event_type":"' || event_type || '","asset":"' || asset || '","user":' || coalesce('"' || "user" || '"', 'null')
  || ',"src_ip":' || coalesce('"' || src_ip || '"', 'null') || ',"dst_ip":"' || dst_ip || '","process_name":"' || process_name
  || '","command_line":"' || command_line || '","status":"' || status || '","message":"' || message
  || '","raw_log":"' || replace(raw_log, '"', '\"') || '"}'"""

EVIDENCE = """'asset=' || asset || coalesce('; user=' || "user", '') || coalesce('; src_ip=' || src_ip, '') || '; dst_ip=' || dst_ip
  || '; process_name=' || process_name || '; command_line=' || command_line || '; message=' || message"""

SRC = "coalesce(src_ip, '~')"
#: What is told of each rule besides its conditions, by number in the rule set.
RULE_TEXTS = [
    ("DET-SSH-001", "SSH brute force", "high", 0.86, "Credential Access", "T1110"),
    ("DET-SSH-002", "Successful login after multiple failures", "high", 0.84, "Initial Access", "T1078"),
    ("DET-SSH-003", "SSH password spraying across users", "high", 0.83, "Credential Access", "T1110.003"),
    ("DET-PS-001", "Encoded PowerShell execution", "critical", 0.9, "Execution", "T1059.001"),
    ("DET-NET-001", "Internal port scan", "medium", 0.78, "Discovery", "T1046"),
    ("DET-WIN-001", "New admin account creation", "critical", 0.88, "Persistence", "T1136"),
    ("DET-WAF-001", "SQL injection attempt", "high", 0.82, "Initial Access", "T1190"),
]
# By number: conditions, key, what is counted, threshold, window. Number 1 looks for failures before a success.
DEMO_TESTS = {
    0: (FAILED, SRC, "*", 5, "1 DAY"), 2: (FAILED, SRC, 'DISTINCT "user"', 8, "1 DAY"),
    4: ("event_type = 'network_connection'", SRC, "DISTINCT dst_ip", 6, "1 DAY"),
    5: ("event_type = 'admin_account_change' AND (lower(message) LIKE '%signup%' OR lower(message) LIKE '%admin%')", "''", "*", 1, "1 MINUTE"),
    6: (r"event_type = 'http_request' AND regexp_matches(message, '(?i)k=[1-4]\b|(?i)K=7|k=\d5')", "''", "*", 1, "1 MINUTE"),
}
DEFAULT_TESTS = {
    0: (FAILED, SRC, "*", 5, "5 MINUTE"), 2: (FAILED, SRC, 'DISTINCT "user"', 5, "10 MINUTE"),
    3: ("event_type = 'powershell_execution' AND regexp_matches(lower(command_line), '-enc|encodedcommand|frombase64string|bypass|hidden')",
        "''", "*", 1, "1 MINUTE"),
    4: ("event_type = 'network_connection'", SRC, "DISTINCT dst_ip", 8, "5 MINUTE"),
    5: ("event_type = 'admin_account_change' AND regexp_matches(lower(message), 'admin|administrator|created|added')", "''", "*", 1, "1 MINUTE"),
    6: (r"event_type = 'http_request' AND regexp_matches(message, '(?i)union\s+select|or\s+1=1|sqlmap|information_schema|../')", "''", "*", 1, "1 MINUTE"),
}


def detections(tests: dict[int, tuple], failures: int, before: str, events: str = SEC_SQL) -> str:
    """``detected``: the alert rows of a rule set, of rare sources and of off-hours activity; to follow WITH RECURSIVE.

    Each alert lists the events of its rule and key in the window up to the one that raised it, for number 1 the failures
    of the pair and of the address without a user, those who failed first in front, then the success.
    """
    hits = " UNION ALL ".join(f"SELECT {i} AS rule, {key} AS k, INTERVAL {win} AS win, * FROM ev WHERE {where}" for i, (where, key, _, _, win) in tests.items())
    reached = " UNION ALL ".join(f"""SELECT * FROM (SELECT rule, k, win, {i} || '/' || k AS g, e, ts, seq, id, count({what}) OVER (
        PARTITION BY k ORDER BY ts RANGE BETWEEN INTERVAL {win} PRECEDING AND CURRENT ROW) AS c FROM hits WHERE rule = {i}) WHERE c >= {least}"""
        for i, (_, _, what, least, win) in tests.items())
    texts = ", ".join(f"({i}, {', '.join(repr(x) for x in row)})" for i, row in enumerate(RULE_TEXTS))
    action = """CASE severity WHEN 'critical' THEN 'Escalate immediately, preserve evidence, and contain if confirmed.'
        WHEN 'high' THEN 'Review evidence, validate scope, and contain if unauthorized.' ELSE 'Investigate context and monitor for progression.' END"""
    return f"""{events}, ev AS (SELECT *, {ENTITY} AS e, {EVIDENCE} AS line FROM sec), hits AS ({hits}),
{fold(reached)},
failed AS (SELECT *, min(ts) OVER (PARTITION BY src_ip, "user") AS began FROM ev WHERE {FAILED}),
succeeded AS (SELECT s.id, any_value(s.e) AS e, any_value(s.ts) AS ts FROM ev s JOIN failed f
  ON f.src_ip IS NOT DISTINCT FROM s.src_ip AND (f."user" IS NOT DISTINCT FROM s."user" OR f."user" IS NULL)
  AND f.ts BETWEEN s.ts - INTERVAL {before} AND s.ts
  WHERE s.event_type = 'ssh_login' AND s.status = 'success' GROUP BY s.id HAVING count(*) >= {failures}),
{entity_fold(f"""SELECT '1/' || e AS g, 1 AS rule, ts, id FROM succeeded
  UNION ALL SELECT '8/' || e, 8, ts, id FROM ev WHERE event_type = 'ssh_login' AND {PRIVILEGED}""", "e")},
parts AS (
  SELECT n.rule, n.id AS alert, h.id, h.line, TIMESTAMP '1970-01-01' AS o, h.ts, h.seq FROM walk w JOIN num n ON n.g = w.g AND n.rn = w.rn
    JOIN hits h ON h.rule = n.rule AND h.k = n.k AND h.ts BETWEEN n.ts - n.win AND n.ts WHERE w.emit
  UNION ALL SELECT 1, s.id, f.id, f.line, f.began, f.ts, f.seq FROM emitted t JOIN ev s ON s.id = t.id JOIN failed f
    ON f.src_ip IS NOT DISTINCT FROM s.src_ip AND (f."user" IS NOT DISTINCT FROM s."user" OR f."user" IS NULL)
    AND f.ts BETWEEN s.ts - INTERVAL {before} AND s.ts WHERE t.rule = 1
  UNION ALL SELECT 1, s.id, s.id, s.line, TIMESTAMP '9999-01-01', s.ts, s.seq FROM emitted t JOIN ev s ON s.id = t.id WHERE t.rule = 1),
listed AS (SELECT rule, alert, string_agg(id, ',' ORDER BY o, ts, seq) AS event_ids,
  string_agg(line, '|' ORDER BY o, ts, seq) FILTER (back <= 10) AS evidence FROM (
    SELECT *, row_number() OVER (PARTITION BY rule, alert ORDER BY o DESC, ts DESC, seq DESC) AS back FROM parts) GROUP BY rule, alert),
texts(rule, rule_id, title, severity, confidence, tactic, technique) AS (VALUES {texts}),
{FIRSTS.format(where=LOGINS)},
detected AS (
  SELECT 'AL-' || upper(left(sha256(rule_id || '|' || replace(event_ids, ',', '|')), 10)) AS alert_id, rule_id, title, severity,
    CAST(confidence AS DOUBLE) AS confidence, tactic, technique, s.ts, s.asset, s."user", s.src_ip, event_ids, evidence,
    {action} AS recommended_action, s.seq, rule FROM listed JOIN texts USING (rule) JOIN ev s ON s.id = alert
  UNION ALL SELECT 'AL-' || upper(left(sha256('DET-AI-001|' || "user" || '|' || src_ip), 10)), 'DET-AI-001', 'Rare external source IP for user',
    'medium', 0.8, 'Initial Access', 'T1078', ts, asset, "user", src_ip, id,
    'user=' || "user" || '; src_ip=' || src_ip || '; known=[''' || (SELECT string_agg(f.src_ip, ''', ''' ORDER BY f.src_ip)
      FROM ranked f WHERE f."user" = rare."user" AND f.r < rare.r) || ''']',
    'Validate VPN/travel context and check for credential compromise.', seq, 7 FROM rare
  UNION ALL SELECT 'AL-' || upper(left(sha256('DET-AI-002|' || s.id), 10)), 'DET-AI-002', 'Off-hours privileged activity', 'medium', 0.74,
    'Privilege Escalation', 'T1078', s.ts, s.asset, s."user", s.src_ip, s.id, s.raw_log, 'Confirm approval and review session commands.', s.seq, 8
    FROM emitted t JOIN ev s ON s.id = t.id WHERE t.rule = 8)"""


DETECTED_ROW = """SELECT alert_id, rule_id, title, severity, confidence, tactic, technique, ts, asset, "user", src_ip, event_ids, evidence,
    recommended_action FROM detected"""
DEMO_DETECTIONS = detections(DEMO_TESTS, 2, "15 DAY")
DEFAULT_DETECTIONS = detections(DEFAULT_TESTS, 4, "10 MINUTE", DENSE_SQL)
DETECTED_ALERTS = """alerts AS (SELECT * EXCLUDE (event_ids), event_ids AS event_id,
    CASE severity WHEN 'critical' THEN 4 WHEN 'high' THEN 3 WHEN 'medium' THEN 2 ELSE 1 END AS weight FROM detected)"""

FORMAT = r"""CASE WHEN raw LIKE '{%' THEN 'json' WHEN regexp_matches(raw, '^\w{3}\s+\d{1,2}\s+\d\d:\d\d:\d\d\s+\S+\s+sshd\[\d+\]:') THEN 'sshd'
  WHEN raw LIKE 'WinEvent %' THEN 'windows' WHEN raw LIKE '% FW action=%' THEN 'firewall' WHEN raw LIKE '%HTTP/1.1"%' THEN 'web'
  ELSE 'unknown' END"""
OUTCOME = """CASE WHEN raw LIKE '{%' AND raw NOT LIKE '%"source":%' THEN 'event requires source and event_type' ELSE 'ok' END"""


ORACLES: dict[str, str] = {
    "event_filter": sec("""SELECT id, ts, asset, src_ip, status FROM sec WHERE event_type = 'ssh_login' AND "user" = 'root'"""),
    "event_scan_oldest": sec("SELECT id, ts, event_type FROM sec ORDER BY ts, seq LIMIT 100"),
    "storage_stats": sec("""SELECT (SELECT count(*) FROM sec) AS stored_events, source, count(*) AS n,
        (SELECT max(ts) FROM sec) AS last_ts FROM sec GROUP BY source"""),
    "event_type_distribution": sec("SELECT event_type, count(*) AS n FROM sec GROUP BY event_type"),
    "insert_ignore": sec("""SELECT id, ts, source FROM sec s WHERE NOT EXISTS
        (SELECT 1 FROM sec t WHERE t.event_type = 'ssh_login' AND t.id = s.id)"""),
    "event_json": sec(f"SELECT id, {JSON_EVENT} AS event_json, ts, message FROM sec"),
    "parse_sshd": lines(rf"""SELECT seq, date_trunc('second', ts) AS ts, regexp_extract(raw, {SSHD}, 4) AS asset,
        regexp_extract(raw, '(?:invalid user|for) (\S+) from', 1) AS "user", regexp_extract(raw, 'from (\d+\.\d+\.\d+\.\d+)', 1) AS src_ip,
        CASE WHEN raw LIKE '%]: Accepted %' THEN 'success' WHEN raw LIKE '%]: Failed %' THEN 'failure' ELSE 'unknown' END AS status,
        regexp_extract(raw, {SSHD}, 5) AS message FROM lines WHERE raw LIKE '% sshd[%'"""),
    "parse_windows": lines(r"""SELECT seq, CAST(regexp_extract(raw, 'Time=(\S+)Z', 1) AS TIMESTAMP) AS ts,
        CASE WHEN raw LIKE '%EventID=4104%' THEN 'powershell_execution' WHEN raw LIKE '%EventID=4720%' THEN 'admin_account_change'
             ELSE 'windows_event' END AS event_type, regexp_extract(raw, 'Host=(\S+)', 1) AS asset,
        regexp_extract(raw, 'User=(\S+)', 1) AS "user", regexp_extract(raw, 'Process=(\S+)', 1) AS process_name,
        regexp_extract(raw, 'CommandLine="([^"]*)"', 1) AS command_line, 'success' AS status FROM lines WHERE raw LIKE 'WinEvent %'"""),
    "parse_firewall": lines(r"""SELECT seq, CAST(regexp_extract(raw, '^(\S+)Z', 1) AS TIMESTAMP) AS ts,
        regexp_extract(raw, '^\S+\s+(\S+)', 1) AS asset, regexp_extract(raw, 'src=(\S+)', 1) AS src_ip,
        regexp_extract(raw, 'dst=(\S+)', 1) AS dst_ip, lower(regexp_extract(raw, 'action=(\S+)', 1)) AS status,
        regexp_extract(raw, 'msg="([^"]*)"', 1) || ' dst_port=' || regexp_extract(raw, 'dpt=(\d+)', 1) || ' proto='
          || regexp_extract(raw, 'proto=(\S+)', 1) AS message FROM lines WHERE raw LIKE '% FW action=%'"""),
    "parse_web": lines(r"""SELECT seq, strptime(regexp_extract(raw, '\[(\S+) ', 1), '%d/%b/%Y:%H:%M:%S') AS ts, 'waf' AS source,
        'web01' AS asset, regexp_extract(raw, '^(\S+)', 1) AS src_ip, regexp_extract(raw, '" (\d+) ', 1) AS status,
        regexp_extract(raw, '"(\S+) ', 1) || ' ' || regexp_extract(raw, '"\S+ (\S+) ', 1) || ' user_agent='
          || regexp_extract(raw, '"([^"]*)"$', 1) AS message FROM lines WHERE raw LIKE '%HTTP/1.1"%'"""),
    "json_normalize": lines("""SELECT raw->>'$.id' AS id, CAST(left(raw->>'$.timestamp', 26) AS TIMESTAMP) - INTERVAL 2 HOUR AS ts,
        7200 AS utc_offset, raw->>'$.source' AS source, raw->>'$.event_type' AS event_type, raw->>'$.asset' AS asset,
        raw->>'$.process_name' AS process_name FROM lines WHERE raw LIKE '{%' AND raw->>'$.source' IS NOT NULL"""),
    "parse_dispatch": lines(f"SELECT {FORMAT} AS format, {OUTCOME} AS outcome, count(*) AS n FROM lines GROUP BY 1, 2"),
    "parse_stats": lines(f"""SELECT count(*) FILTER (o = 'ok' AND f <> 'unknown') AS parsed_events,
        count(*) FILTER (o <> 'ok') AS parsing_failed_events, count(*) FILTER (o = 'ok' AND f = 'unknown') AS unknown_events,
        (SELECT string_agg(left(raw, 200), '|' ORDER BY seq) FROM (SELECT raw, seq FROM lines WHERE {FORMAT} = 'unknown' ORDER BY seq LIMIT 10)) AS unknown_samples
        FROM (SELECT {FORMAT} AS f, {OUTCOME} AS o FROM lines)"""),
    "quarantine": lines(f"SELECT raw, {OUTCOME} AS reason, seq FROM lines WHERE {OUTCOME} <> 'ok'"),
    "event_ids": lines(f"""SELECT seq, CASE WHEN {FORMAT} = 'json' THEN raw->>'$.id'
        ELSE 'evt-' || left(sha256('events|' || seq || '|' || raw), 12) END AS id FROM lines WHERE {OUTCOME} = 'ok'"""),
    "envelope_explode": """SELECT conv_id, CAST(row_number() OVER (PARTITION BY conv_id ORDER BY turn, role, text) - 1 AS INT) AS item,
        CASE WHEN conv_id % 3 = 1 THEN '{"source":"' || role || '","n":' || turn || '}' ELSE text END AS raw FROM conversations""",
    "json_items": """WITH numbered AS (
        SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn, role, text) - 1 AS position, conv_id % 7 AS shape FROM conversations)
        SELECT conv_id, position, CASE WHEN trim(text) = '' THEN 'empty log line' WHEN text LIKE '{%' THEN 'bad json' ELSE 'ok' END AS outcome,
            CASE WHEN trim(text) <> '' AND text NOT LIKE '{%' THEN 'unknown' END AS source FROM numbered WHERE shape IN (0, 1)
        UNION ALL SELECT DISTINCT conv_id, -1,
            CASE shape WHEN 4 THEN 'invalid json body' ELSE 'body must be a JSON object or list' END, CASE shape WHEN 4 THEN 'unknown' END FROM numbered WHERE shape IN (4, 5)
        UNION ALL SELECT DISTINCT conv_id, 0, 'ok', conv_id::VARCHAR FROM numbered WHERE shape = 6""",
    "oversize_quarantine": "SELECT doc_id, CAST(strlen(text) AS INT) AS n_bytes, 'oversize' AS reason FROM documents WHERE strlen(text) > 10240",
    "legacy_normalize": """SELECT doc_id, CASE WHEN lang = 'fr' THEN 'Untitled event' ELSE lang END AS title,
        CASE WHEN lang = 'fr' THEN source ELSE 'unknown' END AS source, 'unknown' AS asset, text AS message,
        'Review evidence and escalate if confirmed.' AS recommendation FROM documents""",
    "common_schema": sec("""SELECT id, src_ip AS source_ip, "user" AS user_name, asset AS host_name FROM sec"""),
    "cloud_audit": sec("""SELECT seq, date_trunc('second', ts) AS ts, 'cloud' AS source, 'cloud_event' AS event_type, asset,
        "user", src_ip, message FROM sec"""),
    "regex_rule": r"SELECT page_id, url FROM pages WHERE regexp_matches(url, 'page=\d') OR regexp_matches(url, '(?i)#TOP$')",
    "contains_rule": """SELECT doc_id, lang FROM documents WHERE contains(lower(text), 'license') OR contains(lower(text), 'the of')
        OR contains(lower(text), 'password')""",
    "external_ip": f"""SELECT o1 || '.' || o2 || '.' || o3 || '.' || o4 AS ip, count(*) AS n, {EXTERNAL} AS external FROM (
        SELECT l_orderkey * 7 % 256 AS o1, l_partkey * 13 % 256 AS o2, l_suppkey * 29 % 256 AS o3, l_linenumber * 41 % 256 AS o4
        FROM lineitem) GROUP BY o1, o2, o3, o4""",
    "keyword_classify": f"WITH {DOC_ALERTS} SELECT * EXCLUDE (number) FROM doc_alerts",
    "legacy_incidents": f"WITH {DOC_ALERTS}, {OLDER_INCIDENTS} SELECT id, title, priority, status, owner, related_alerts FROM older",
    "legacy_risk": f"""WITH {DOC_ALERTS}, {OLDER_INCIDENTS} SELECT CAST(least(100, 35 + 25 * count(*) FILTER (severity = 'Critical')
        + 10 * count(*) FILTER (severity = 'High') + 4 * (SELECT count(*) FROM older)) AS INT) AS risk_score FROM doc_alerts""",
    "triage_card": f"""WITH {DOC_ALERTS} SELECT id AS alert_id, severity, title || ' detected on ' || asset || ' from ' || source
        || '. Confidence is ' || confidence || '%.' AS assessment, tactic AS mitre_tactic, technique AS mitre_technique,
        recommendation || '|Validate affected asset and user context|Check related alerts and recent authentication activity|'
        || 'Document response actions in the incident record' AS recommended_actions
        FROM doc_alerts ORDER BY (severity = 'Critical') DESC, confidence DESC, number LIMIT 1""",
    "triage_latest": f"""WITH {DOC_ALERTS}, d AS (SELECT 'ALT-' || (conv_id + 1041) AS alert_id, role || '-' || turn AS action,
        CASE role WHEN 'user' THEN 'analyst' ELSE 'frontend' END AS analyst, turn FROM conversations),
        l AS (SELECT * FROM d QUALIFY row_number() OVER (PARTITION BY alert_id ORDER BY turn DESC, action DESC, analyst DESC) = 1)
        SELECT a.id AS alert_id, a.severity, l.action AS triage_action, l.analyst AS triage_analyst,
          CASE WHEN l.action IS NOT NULL THEN 'recorded' END AS triage_status FROM doc_alerts a LEFT JOIN l ON l.alert_id = a.id""",
    "burst_threshold": sec(f", {counted('b', '*', FAILED, 'src_ip')} SELECT id, src_ip, ts, c AS in_window FROM b WHERE c >= 5"),
    "distinct_burst": sec(f""", {counted('b', 'DISTINCT "user"', FAILED, 'src_ip')} SELECT id, src_ip, ts, c AS users FROM b WHERE c >= 8"""),
    "failures_then_success": sec(f"""SELECT s.id, s.src_ip, s."user", s.ts FROM sec s JOIN sec f
        ON f.src_ip IS NOT DISTINCT FROM s.src_ip AND (f."user" IS NOT DISTINCT FROM s."user" OR f."user" IS NULL)
        AND f.ts BETWEEN s.ts - INTERVAL 15 DAY AND s.ts
        WHERE s.event_type = 'ssh_login' AND s.status = 'success' AND f.event_type = 'ssh_login' AND f.status = 'failure'
        GROUP BY ALL HAVING count(*) >= 2"""),
    "off_hours": sec(f"""SELECT id, "user", ts FROM sec WHERE {PRIVILEGED}"""),
    "alerts_suppressed": rec(entity_fold(f"""
        SELECT 'r0/' || {ENTITY} AS g, 0 AS rule, ts, id FROM sec WHERE event_type = 'http_request'
        UNION ALL SELECT 'r2/' || {ENTITY}, 2, ts, id FROM sec WHERE event_type = 'ssh_login' AND {PRIVILEGED}""")
        + " SELECT CAST(rule AS INT) AS rule, id, ts FROM emitted"),
    "alerts_minute_fold": rec(f"""{counted('b', '*', FAILED, 'src_ip')},
        {fold(f"SELECT coalesce(src_ip, '~') AS g, {ENTITY} AS e, ts, seq, id FROM b WHERE c >= 2")}
        SELECT CAST(0 AS INT) AS rule, id, ts FROM walk WHERE emit"""),
    "alerts_global_fold": rec(f"""{fold(f"SELECT 'all' AS g, {ENTITY} AS e, ts, seq, id FROM sec WHERE event_type = 'http_request'")}
        SELECT CAST(0 AS INT) AS rule, id, ts FROM walk WHERE emit"""),
    "alerts_cross_key": rec(f"""{fold(f"SELECT 'all' AS g, dst_ip AS lane, {ENTITY} AS e, ts, seq, id FROM sec WHERE event_type = 'network_connection'", "n.lane")}
        SELECT CAST(0 AS INT) AS rule, id, ts FROM walk WHERE emit"""),
    "rare_source": sec(f""", {FIRSTS.format(where=LOGINS)}
        SELECT 'AL-' || upper(left(sha256('DET-AI-001|' || "user" || '|' || src_ip), 10)) AS alert_id, "user", src_ip, ts,
          'user=' || "user" || '; src_ip=' || src_ip || '; known=[''' || (SELECT string_agg(f.src_ip, ''', ''' ORDER BY f.src_ip)
            FROM ranked f WHERE f."user" = rare."user" AND f.r < rare.r) || ''']' AS evidence FROM rare"""),
    "rare_source_any_success": sec(f""", {FIRSTS.format(where=SUCCESSES)} SELECT "user", src_ip, id FROM rare"""),
    "first_seen_process": sec(f", {PROCESSES} SELECT entity, proc, id, ts FROM new_processes"),
    "alert_rows": rec(f"""ev AS (SELECT *, {ENTITY} AS g, {EVIDENCE} AS line FROM sec WHERE event_type = 'http_request'),
        {entity_fold("SELECT g, ts, id, src_ip, " + '"user", asset, seq FROM ev')},
        m AS (SELECT t.id AS tid, t.ts AS tts, t.asset, t."user", t.src_ip, ev.id, ev.line, ev.seq,
          row_number() OVER (PARTITION BY t.id ORDER BY ev.seq DESC) AS back
          FROM emitted t JOIN ev ON ev.g = t.g AND ev.ts BETWEEN t.ts - {DAY} AND t.ts),
        a AS (SELECT tid, tts, asset, "user", src_ip, string_agg(id, ',' ORDER BY seq) AS event_ids,
          string_agg(line, '|' ORDER BY seq) FILTER (back <= 10) AS evidence FROM m GROUP BY ALL)
        SELECT 'AL-' || upper(left(sha256('DET-WAF-001|' || replace(event_ids, ',', '|')), 10)) AS alert_id, 'DET-WAF-001' AS rule_id,
          'SQL injection attempt' AS title, 'high' AS severity, 0.82::DOUBLE AS confidence, 'Initial Access' AS tactic,
          'T1190' AS technique, tts AS ts, asset, "user", src_ip, event_ids, evidence,
          'Review evidence, validate scope, and contain if unauthorized.' AS recommended_action FROM a"""),
    "alerts_all_rules": f"WITH RECURSIVE {DEMO_DETECTIONS} {DETECTED_ROW}",
    "detections_default_rules": f"WITH RECURSIVE {DEFAULT_DETECTIONS} {DETECTED_ROW}",
    "detected_member_rows": f"""WITH RECURSIVE {DEMO_DETECTIONS} SELECT rule_id, alert AS trigger_id, id AS event_id FROM parts JOIN texts USING (rule)""",
    "detected_alert_ids": f"""WITH RECURSIVE {DEMO_DETECTIONS} SELECT rule_id, alert AS trigger_id,
        'AL-' || upper(left(sha256(rule_id || '|' || replace(event_ids, ',', '|')), 10)) AS alert_id, len(string_split(event_ids, ',')) AS n_events
        FROM listed JOIN texts USING (rule)""",
    "alert_event_rows": alerts("SELECT alert_id, CAST(0 AS INT) AS position, event_id FROM alerts"),
    "stable_ids": sec("SELECT id, 'AL-' || upper(left(sha256('DET-AI-002|' || id), 10)) AS alert_id FROM sec"),
    "alert_sort": alerts("SELECT alert_id, severity, confidence, ts FROM alerts"),
    "alert_filter": alerts("""SELECT alert_id, asset, "user" FROM alerts WHERE severity = 'high' AND tactic = 'Execution'"""),
    "top_confidence": alerts("SELECT alert_id, confidence, ts FROM alerts ORDER BY confidence DESC, weight DESC, ts DESC LIMIT 1"),
    "incident_components": f"WITH RECURSIVE {ALERTS_SQL}, {COMPONENTS} SELECT alert_id, incident, count(*) OVER (PARTITION BY incident) AS n_alerts FROM members",
    "incident_priority": f"WITH RECURSIVE {ALERTS_SQL}, {COMPONENTS} SELECT incident, {PRIORITY} AS priority, count(*) AS n_alerts, CAST(sum(weight) AS BIGINT) AS weight FROM members GROUP BY incident",
    "incident_rollup": f"""WITH RECURSIVE {ALERTS_SQL}, {COMPONENTS} SELECT
        'INC-' || upper(left(sha256(string_agg(alert_id || '|' || rule_id || '|' || event_id || '|' || coalesce(asset, '') || '|'
          || coalesce("user", '') || '|' || coalesce(src_ip, ''), '|' ORDER BY alert_id)), 10)) AS incident_id,
        CASE WHEN count(*) = 1 THEN min(title) ELSE 'Correlated SOC activity: ' || array_to_string(list_sort(list(DISTINCT tactic)), ', ') END AS title,
        {PRIORITY} AS priority, 'open' AS status, 'unassigned' AS owner, string_agg(alert_id, ',' ORDER BY ts, seq) AS alert_ids,
        array_to_string(list_sort(list(DISTINCT asset) FILTER (asset IS NOT NULL)), ',') AS assets,
        coalesce(array_to_string(list_sort(list(DISTINCT "user") FILTER ("user" IS NOT NULL)), ','), '') AS users,
        coalesce(array_to_string(list_sort(list(DISTINCT src_ip) FILTER (src_ip IS NOT NULL)), ','), '') AS src_ips,
        array_to_string(list_sort(list(DISTINCT title)), ' | ') AS evidence_summary,
        array_to_string(list_sort(list(DISTINCT recommended_action)), '|') AS actions,
        strftime(min(ts), '%Y-%m-%dT%H:%M:%S.%f+00:00') AS first_time FROM members GROUP BY incident""",
    "incident_ids": "SELECT incident_id, len(string_split(alert_ids, ',')) AS n_alerts FROM ({})",
    "incident_filter": "SELECT incident_id, title, alert_ids FROM ({}) WHERE priority = 'P2'",
    "incident_lookup": "SELECT incident_id, priority, status, alert_ids FROM ({}) ORDER BY incident_id LIMIT 1",
    "risk_by_asset": alerts(f""", scored AS (SELECT asset, strftime(ts, '%Y-%m-%d') AS day,
        CASE severity WHEN 'critical' THEN 20 WHEN 'high' THEN 12 WHEN 'medium' THEN 6 ELSE 2 END
        + CASE WHEN tactic = 'Discovery' THEN 0 WHEN severity = 'critical' THEN 25 WHEN severity = 'high' THEN 14 ELSE 6 END AS p FROM alerts)
        SELECT asset, day, CAST(sum(p) AS BIGINT) AS points, CAST(least(100, sum(p)) AS INT) AS risk_score FROM scored GROUP BY asset, day"""),
    "older_risk_by_source": f"""WITH {DOC_ALERTS} SELECT source, asset, 35 + 25 * count(*) FILTER (severity = 'Critical')
        + 10 * count(*) FILTER (severity = 'High') + 4 * count(DISTINCT tactic) FILTER (tactic IN ('Credential Access', 'Execution', 'Persistence')) AS points,
        CAST(least(100, points) AS INT) AS risk_score FROM doc_alerts GROUP BY source, asset""",
    "metrics_chain": f"""WITH RECURSIVE {DEFAULT_DETECTIONS}, {DETECTED_ALERTS}, {COMPONENTS},
        incidents AS (SELECT {PRIORITY} AS priority, 'open' AS status FROM members GROUP BY incident),
        points AS (SELECT (SELECT sum(CASE severity WHEN 'critical' THEN 20 WHEN 'high' THEN 12 WHEN 'medium' THEN 6 ELSE 2 END) FROM alerts)
          + (SELECT sum(CASE priority WHEN 'P1' THEN 25 WHEN 'P2' THEN 14 ELSE 6 END) FROM incidents) AS p)
        SELECT (SELECT count(*) FROM sec) AS total_events, count(*) AS total_alerts, count(*) FILTER (severity = 'critical') AS critical_alerts,
        count(*) FILTER (severity = 'high') AS high_alerts, (SELECT count(*) FROM incidents) AS open_incidents,
        (SELECT CAST(least(100, p) AS INT) FROM points) AS risk_score,
        (SELECT string_agg(tactic || '=' || n, ',' ORDER BY tactic) FROM ({TACTIC_ORDER})) AS top_tactics,
        (SELECT string_agg(priority || '=' || n, ',' ORDER BY priority) FROM (SELECT priority, count(*) AS n FROM incidents GROUP BY priority)) AS priorities,
        (SELECT CAST(p AS BIGINT) FROM points) AS points FROM alerts""",
    "volume_zscore": sec(f", {VOLUMES} SELECT asset, n, round(z, 6) AS z FROM volumes"),
    "volume_anomalies": sec(f""", {VOLUMES} SELECT asset AS entity, round(least(0.99, 0.55 + z / 5), 6) AS anomaly_score,
        'Unusual event volume for asset ' || asset AS reason FROM volumes WHERE n >= 25 AND z >= 1"""),
    "failed_login_volume": sec(f""", {FAILURES} SELECT coalesce("user", 'None') || '@' || coalesce(src_ip, 'None') AS entity,
        round(least(0.98, 0.6 + z / 5), 6) AS anomaly_score, 'Abnormal failed-login volume for ' || coalesce("user", 'None')
        || ' from ' || coalesce(src_ip, 'None') AS reason FROM failures WHERE n >= 3"""),
    "anomaly_top20": sec(f", {ANOMALIES} SELECT family, entity, round(score, 6) AS anomaly_score, reason, event_id FROM top20"),
    "anomaly_event_rows": sec(f""", {ANOMALIES}
        SELECT family, entity, o3 AS seq, event_id AS id FROM top20 WHERE event_id IS NOT NULL
        UNION ALL SELECT family, entity, s.seq, s.id FROM top20 t JOIN sec s ON s."user" IS NOT DISTINCT FROM t."user"
          AND s.src_ip IS NOT DISTINCT FROM t.src_ip AND s.status = 'failure' WHERE family = 'failed_logins'
        UNION ALL SELECT family, entity, seq, id FROM (SELECT family, entity, s.seq, s.id,
          row_number() OVER (PARTITION BY entity ORDER BY s.seq) AS r FROM top20 t JOIN sec s ON s.asset = t.entity
          WHERE family = 'volume') WHERE r <= 25"""),
    "risk_score": alerts(f", {ALERT_INCIDENTS} SELECT count(*) AS total_alerts, CAST({RISK} AS BIGINT) AS risk_score FROM alerts"),
    "metrics_summary": f"""WITH {LINES_SQL}, {SEC_SQL.replace('k_events', 's_events')}, {ALERTS_SQL.replace('k_events', 'a_events')}, {ALERT_INCIDENTS},
        p AS (SELECT count(*) FILTER ({OUTCOME} <> 'ok') AS failed, count(*) FILTER ({OUTCOME} = 'ok' AND {FORMAT} = 'unknown') AS unk FROM lines)
        SELECT (SELECT count(*) FROM sec) AS total_events, count(*) AS total_alerts, count(*) FILTER (severity = 'critical') AS critical_alerts,
        count(*) FILTER (severity = 'high') AS high_alerts, (SELECT count(*) FROM incidents WHERE status = 'open') AS open_incidents,
        CAST({RISK} AS INT) AS risk_score,
        (SELECT string_agg(tactic || '=' || n, ',' ORDER BY tactic) FROM ({TACTIC_ORDER})) AS top_tactics,
        (SELECT string_agg(source || '=' || n, ',' ORDER BY source) FROM (SELECT source, count(*) AS n FROM sec GROUP BY source)) AS sources,
        (SELECT string_agg(event_type || '=' || n, ',' ORDER BY event_type) FROM (SELECT event_type, count(*) AS n FROM sec GROUP BY event_type)) AS event_types,
        (SELECT failed FROM p) AS parsing_failed_events, (SELECT unk FROM p) AS unknown_events,
        round((SELECT unk FROM p) / greatest((SELECT count(*) FROM sec), 1) * 100, 2) AS unknown_event_rate_pct FROM alerts""",
    "top_tactics": alerts(f"SELECT tactic, n FROM ({TACTIC_ORDER})"),
    "coverage_tactics": f"WITH {COVERAGE} SELECT tactic, count(*) AS rule_count FROM c GROUP BY tactic",
    "coverage_techniques": f"""WITH {COVERAGE} SELECT technique, tactic, count(*) AS rule_count,
        string_agg(rule_id, ',' ORDER BY rule_id) AS rules FROM c GROUP BY technique, tactic""",
    "coverage_unmapped": f"WITH {COVERAGE} SELECT rule_id FROM c WHERE tactic = 'Unknown' OR technique = 'Unknown'",
}

ORACLES |= {name: ORACLES[name].format(ORACLES["incident_rollup"]) for name in ("incident_ids", "incident_filter", "incident_lookup")}
ORACLES |= {
    "stream_normalize": lines(f"""SELECT seq, CASE WHEN f = 'json' THEN raw->>'$.id'
        ELSE 'evt-' || left(sha256('events|' || seq || '|' || raw), 12) END AS id,
        CASE f WHEN 'json' THEN ts - INTERVAL 2 HOUR WHEN 'sshd' THEN date_trunc('second', ts) WHEN 'web' THEN date_trunc('second', ts) WHEN 'unknown' THEN TIMESTAMP '2024-03-01 00:00:00' ELSE ts END AS ts,
        CASE f WHEN 'json' THEN 'edr' WHEN 'sshd' THEN 'linux_auth' WHEN 'web' THEN 'waf' ELSE f END AS source,
        CASE f WHEN 'json' THEN 'process_start' WHEN 'sshd' THEN 'ssh_login' WHEN 'web' THEN 'http_request'
          WHEN 'firewall' THEN 'network_connection' WHEN 'unknown' THEN 'unknown' ELSE CASE WHEN k % 2 = 0 THEN 'admin_account_change' ELSE 'powershell_execution' END END AS event_type
        FROM (SELECT *, {FORMAT} AS f FROM lines) WHERE {OUTCOME} = 'ok'"""),
    "stream_parse_stats": f"SELECT parsed_events, parsing_failed_events, unknown_events FROM ({ORACLES['parse_stats']})",
    "stream_store": sec("SELECT source, strftime(ts, '%Y-%m-%d') AS event_date, count(*) AS n FROM sec GROUP BY ALL"),
    "stream_burst": ORACLES["alerts_minute_fold"].replace("SELECT CAST(0 AS INT) AS rule, id, ts FROM walk WHERE emit",
                                                         "SELECT id, ts FROM walk WHERE emit"),
    "stream_failures_then_success": rec(entity_fold(f"""
        SELECT 'r0/' || {ENTITY} AS g, 0 AS rule, ts, id FROM sec s WHERE event_type = 'ssh_login' AND status = 'success' AND 2 <= (
          SELECT count(*) FROM sec f WHERE f.src_ip IS NOT DISTINCT FROM s.src_ip AND (f."user" IS NOT DISTINCT FROM s."user" OR f."user" IS NULL)
          AND f.ts BETWEEN s.ts - INTERVAL 15 DAY AND s.ts AND f.event_type = 'ssh_login' AND f.status = 'failure')
        UNION ALL SELECT 'r2/' || {ENTITY}, 2, ts, id FROM sec WHERE event_type = 'ssh_login' AND {PRIVILEGED}""")
        + f" SELECT CAST(rule AS INT) AS rule, id, ts FROM emitted"),
    "stream_rare_source": sec(f""", {FIRSTS.format(where=LOGINS)} SELECT "user", src_ip, id, (SELECT string_agg(f.src_ip, ',' ORDER BY f.src_ip)
        FROM ranked f WHERE f."user" = rare."user" AND f.r < rare.r) AS known FROM rare"""),
    "stream_first_seen_process": sec(f", {PROCESSES} SELECT entity, proc, id, ts FROM new_processes"),
    "stream_incidents": ORACLES["incident_components"],
    "stream_alert_rows": ORACLES["detections_default_rules"],
    "stream_late_repair": ORACLES["detections_default_rules"],
}
