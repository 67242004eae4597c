"""The driver's tables read as security telemetry: event rows, raw log lines, alerts.

``SEC_SQL``, ``LINES_SQL`` and ``ALERTS_SQL`` say the same in SQL, for checking.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from palisade.functions.columns import lookup
from palisade.schema import ALERT_SCHEMA, as_events

EVENT_TYPES = {"error": "ssh_login", "view": "ssh_login", "click": "http_request", "purchase": "network_connection"}
SOURCES = {"error": "linux_auth", "view": "linux_auth", "click": "waf", "purchase": "firewall"}
ALERT_VALUE = 60.0
TACTICS = {"error": "Credential Access", "view": "Discovery", "click": "Initial Access", "purchase": "Execution"}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def with_k(events: DataFrame) -> DataFrame:
    return events.withColumn("k", F.expr("cast(get_json_object(props, '$.k') AS int)"))


USER = """CASE user_id % 50 WHEN 0 THEN 'root' WHEN 1 THEN 'admin' WHEN 2 THEN 'administrator' WHEN 7 THEN NULL
    ELSE concat('u', user_id % 50) END"""
ADDRESS = "CASE WHEN k = 99 THEN NULL WHEN k % 4 = 0 THEN concat('185.199.88.', k) ELSE concat('10.0.0.', k % 10) END"
HOST = "concat('host-', user_id % 20)"


def to_security(events: DataFrame) -> DataFrame:
    """Event rows of the ``events`` table, batch or stream."""
    d = with_k(events).withColumns({
        "src": lookup("event_type", SOURCES, "windows"), "kind": lookup("event_type", EVENT_TYPES, "admin_account_change"),
    })
    return as_events(d.selectExpr(
        "concat('evt-', event_id) AS id", "cast(ts AS timestamp) AS timestamp", "0 AS utc_offset", "src AS source",
        "kind AS event_type", f"{HOST} AS asset", f"{USER} AS user", f"{ADDRESS} AS src_ip",
        "concat('10.1.0.', k) AS dst_ip", "event_type AS process_name",
        "CASE WHEN k % 5 = 0 THEN 'run -enc' ELSE 'run' END AS command_line",
        "CASE WHEN event_type = 'error' THEN 'failure' ELSE 'success' END AS status",
        "concat(event_type, ' k=', k) AS message", "props AS raw_log", "event_id AS seq",
    ))


def security_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return to_security(table(spark, sf_dir, "events"))


SEC_SQL = """
k_events AS (SELECT *, CAST(json_extract_string(props, '$.k') AS INT) AS k FROM events),
sec AS (
  SELECT 'evt-' || event_id AS id, ts, event_id AS seq,
    CASE event_type WHEN 'error' THEN 'linux_auth' WHEN 'view' THEN 'linux_auth' WHEN 'click' THEN 'waf'
         WHEN 'purchase' THEN 'firewall' ELSE 'windows' END AS source,
    CASE event_type WHEN 'error' THEN 'ssh_login' WHEN 'view' THEN 'ssh_login' WHEN 'click' THEN 'http_request'
         WHEN 'purchase' THEN 'network_connection' ELSE 'admin_account_change' END AS event_type,
    'host-' || (user_id % 20) AS asset,
    CASE user_id % 50 WHEN 0 THEN 'root' WHEN 1 THEN 'admin' WHEN 2 THEN 'administrator' WHEN 7 THEN NULL
         ELSE 'u' || (user_id % 50) END AS "user",
    CASE WHEN k = 99 THEN NULL WHEN k % 4 = 0 THEN '185.199.88.' || k ELSE '10.0.0.' || (k % 10) END AS src_ip,
    '10.1.0.' || k AS dst_ip, event_type AS process_name,
    CASE WHEN k % 5 = 0 THEN 'run -enc' ELSE 'run' END AS command_line,
    CASE event_type WHEN 'error' THEN 'failure' ELSE 'success' END AS status,
    event_type || ' k=' || k AS message, props AS raw_log, value
  FROM k_events
)
"""


#: Each event of such a number starts a burst, of one of six kinds in turn.
BURST_EVERY = 211
BURST_TYPES = ["ssh_login", "ssh_login", "powershell_execution", "network_connection", "http_request", "admin_account_change"]
BURST_SOURCES = ["linux_auth", "linux_auth", "windows", "firewall", "waf", "windows"]
BURST_LAST = [8, 6, 1, 9, 1, 1]
BURST_MESSAGES = ["login", "login", "script", "probe", "GET /q?id=1 UNION SELECT name", "account added to administrators"]


def _one_of(values: list, index: str) -> str:
    return f"element_at(array({', '.join(repr(v) for v in values)}), {index} + 1)"


def burst_events(events: DataFrame) -> DataFrame:
    """What the rules look for at their own thresholds, 13 seconds apart: failures of one user and then a success, failures of
    many users, encoded commands, connections to many hosts, injection attempts, new administrators."""
    d = with_k(events).where(f"event_id % {BURST_EVERY} = 0").selectExpr("*", f"cast(event_id / {BURST_EVERY} AS int) % 6 AS kind")
    d = d.selectExpr("*", f"explode(sequence(0, {_one_of(BURST_LAST, 'kind')})) AS n")
    return as_events(d.selectExpr(
        "concat('evt-', event_id, '-', n) AS id", "cast(ts AS timestamp) + make_dt_interval(0, 0, 0, 13 * n) AS timestamp", "0 AS utc_offset",
        f"{_one_of(BURST_SOURCES, 'kind')} AS source", f"{_one_of(BURST_TYPES, 'kind')} AS event_type", f"{HOST} AS asset",
        f"CASE WHEN kind = 1 THEN concat('s', n) ELSE {USER} END AS user", "concat('10.20.', kind, '.', user_id % 200) AS src_ip",
        "CASE WHEN kind = 3 THEN concat('10.2.0.', n) ELSE '10.1.0.1' END AS dst_ip", "'burst' AS process_name",
        "CASE WHEN kind = 2 THEN 'powershell -EncodedCommand AAAA' ELSE 'run' END AS command_line",
        "CASE WHEN kind = 1 OR kind = 0 AND n < 8 THEN 'failure' ELSE 'success' END AS status",
        f"{_one_of(BURST_MESSAGES, 'kind')} AS message", "props AS raw_log", "1000000000 + event_id * 16 + n AS seq",
    ))


def dense_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Security events with bursts among them, so that each rule of the rule set fires as it is."""
    events = table(spark, sf_dir, "events")
    return to_security(events).unionByName(burst_events(events))


_BURST_LISTS = {name: "[" + ", ".join(repr(v) for v in values) + "][kind + 1]" for name, values in (
    ("source", BURST_SOURCES), ("type", BURST_TYPES), ("last", BURST_LAST), ("message", BURST_MESSAGES))}
DENSE_SQL = SEC_SQL.replace("sec AS (", "plain AS (").rstrip() + f""",
burst AS (SELECT *, unnest(range({_BURST_LISTS['last']} + 1)) AS n FROM (
  SELECT *, (event_id // {BURST_EVERY}) % 6 AS kind FROM k_events WHERE event_id % {BURST_EVERY} = 0)),
sec AS (
  SELECT id, ts, seq, source, event_type, asset, "user", src_ip, dst_ip, process_name, command_line, status, message, raw_log FROM plain
  UNION ALL SELECT 'evt-' || event_id || '-' || n, ts + to_seconds(13 * n), 1000000000 + event_id * 16 + n, {_BURST_LISTS['source']},
    {_BURST_LISTS['type']}, 'host-' || (user_id % 20),
    CASE WHEN kind = 1 THEN 's' || n WHEN user_id % 50 = 0 THEN 'root' WHEN user_id % 50 = 1 THEN 'admin' WHEN user_id % 50 = 2 THEN 'administrator'
         WHEN user_id % 50 = 7 THEN NULL ELSE 'u' || (user_id % 50) END,
    '10.20.' || kind || '.' || (user_id % 200), CASE WHEN kind = 3 THEN '10.2.0.' || n ELSE '10.1.0.1' END, 'burst',
    CASE WHEN kind = 2 THEN 'powershell -EncodedCommand AAAA' ELSE 'run' END,
    CASE WHEN kind = 1 OR kind = 0 AND n < 8 THEN 'failure' ELSE 'success' END, {_BURST_LISTS['message']}, props FROM burst
)
"""


def raw_lines(events: DataFrame) -> DataFrame:
    """A raw log line for each row of the ``events`` table, the format chosen by its type.

    Some come out as JSON objects, some of those without their mandatory fields, and some as text
    of no known format.
    """
    d = with_k(events).selectExpr(
        "*", f"{HOST} AS host", f"coalesce({USER}, 'nobody') AS who", f"coalesce({ADDRESS}, '10.9.9.9') AS ip",
        """date_format(ts, "yyyy-MM-dd'T'HH:mm:ss.SSSSSS") AS iso""",
    )
    sshd = "concat(date_format(ts, 'MMM d HH:mm:ss'), ' ', host, ' sshd[', event_id, ']: {}', who, ' from ', ip, ' port ', k + 50000, ' ssh2')"
    line = f"""CASE
        WHEN event_type = 'error' THEN {sshd.format('Failed password for invalid user ')}
        WHEN event_type = 'view' THEN {sshd.format('Accepted password for ')}
        WHEN event_type = 'click' THEN concat(ip, ' - - [', date_format(ts, 'dd/MMM/yyyy:HH:mm:ss'),
          ' +0000] "GET /item?k=', k, ' HTTP/1.1" ', k + 200, ' 123 "agent ', user_id, '"')
        WHEN event_type = 'purchase' THEN concat(iso, 'Z ', host, ' FW action=DENY src=', ip, ' dst=10.1.0.', k, ' dpt=', k,
          ' proto=TCP msg="blocked ', value, '"')
        WHEN k % 3 = 0 THEN concat('{{"id":"', event_id, CASE WHEN k % 7 = 0 THEN '"' ELSE '","source":"edr"' END,
          ',"event_type":"process_start","timestamp":"', iso, '+02:00","asset":"', host, '","process_name":"p', k, '"}}')
        WHEN k % 3 = 1 THEN concat('WinEvent Time=', iso, 'Z Host=', host, ' EventID=',
          CASE WHEN k % 2 = 0 THEN '4720' ELSE '4104' END, ' User=', who, ' Process=p.exe CommandLine="run ', k, '"')
        ELSE concat('no format of ours ', event_id) END"""
    return d.selectExpr(f"{line} AS raw", "'events' AS source_uri", "cast(event_id AS string) AS position", "event_id AS seq")


LINES_SQL = """
k_events AS (SELECT *, CAST(json_extract_string(props, '$.k') AS INT) AS k, 'host-' || (user_id % 20) AS host,
  CASE user_id % 50 WHEN 0 THEN 'root' WHEN 1 THEN 'admin' WHEN 2 THEN 'administrator' WHEN 7 THEN 'nobody'
       ELSE 'u' || (user_id % 50) END AS who,
  CASE WHEN CAST(json_extract_string(props, '$.k') AS INT) = 99 THEN '10.9.9.9'
       WHEN CAST(json_extract_string(props, '$.k') AS INT) % 4 = 0
       THEN '185.199.88.' || json_extract_string(props, '$.k')
       ELSE '10.0.0.' || (CAST(json_extract_string(props, '$.k') AS INT) % 10) END AS ip,
  strftime(ts, '%Y-%m-%dT%H:%M:%S.%f') AS iso FROM events),
lines AS (SELECT event_id AS seq, ts, k, CASE
  WHEN event_type = 'error' THEN strftime(ts, '%b %-d %H:%M:%S') || ' ' || host || ' sshd[' || event_id
    || ']: Failed password for invalid user ' || who || ' from ' || ip || ' port ' || (k + 50000) || ' ssh2'
  WHEN event_type = 'view' THEN strftime(ts, '%b %-d %H:%M:%S') || ' ' || host || ' sshd[' || event_id
    || ']: Accepted password for ' || who || ' from ' || ip || ' port ' || (k + 50000) || ' ssh2'
  WHEN event_type = 'click' THEN ip || ' - - [' || strftime(ts, '%d/%b/%Y:%H:%M:%S') || ' +0000] "GET /item?k=' || k
    || ' HTTP/1.1" ' || (k + 200) || ' 123 "agent ' || user_id || '"'
  WHEN event_type = 'purchase' THEN iso || 'Z ' || host || ' FW action=DENY src=' || ip || ' dst=10.1.0.' || k
    || ' dpt=' || k || ' proto=TCP msg="blocked ' || value || '"'
  WHEN k % 3 = 0 THEN '{"id":"' || event_id || CASE WHEN k % 7 = 0 THEN '"' ELSE '","source":"edr"' END
    || ',"event_type":"process_start","timestamp":"' || iso || '+02:00","asset":"' || host
    || '","process_name":"p' || k || '"}'
  WHEN k % 3 = 1 THEN 'WinEvent Time=' || iso || 'Z Host=' || host || ' EventID='
    || CASE WHEN k % 2 = 0 THEN '4720' ELSE '4104' END || ' User=' || who || ' Process=p.exe CommandLine="run ' || k || '"'
  ELSE 'no format of ours ' || event_id END AS raw
  FROM k_events)
"""


def value_alerts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return to_value_alerts(table(spark, sf_dir, "events"))


def to_value_alerts(events: DataFrame) -> DataFrame:
    """Alerts for every event of high value, with severity by value and tactic by type."""
    d = with_k(events).where(F.col("value") >= ALERT_VALUE)
    d = d.withColumn("kind", lookup("event_type", TACTICS, "Persistence"))
    columns = {
        "alert_id": "concat('AL-', event_id)", "rule_id": "concat('R-', event_type)",
        "title": "concat('High value ', event_type)",
        "severity": "CASE WHEN value >= 200 THEN 'critical' WHEN value >= 120 THEN 'high' WHEN value >= 80 THEN 'medium' ELSE 'low' END",
        "confidence": "round(k / 100, 2)", "tactic": "kind", "technique": "'T1078'", "timestamp": "cast(ts AS timestamp)",
        "utc_offset": "0", "asset": HOST, "user": USER, "src_ip": ADDRESS, "event_ids": "array(concat('evt-', event_id))",
        "evidence": "array(props)", "recommended_action": "concat('Review ', event_type)",
        "emit_us": "unix_micros(cast(ts AS timestamp))", "emit_seq": "event_id", "emit_rule": "0",
    }
    return d.selectExpr(*[f"cast({columns[f.name]} AS {f.dataType.simpleString()}) AS {f.name}" for f in ALERT_SCHEMA.fields])


ALERTS_SQL = """
k_events AS (SELECT *, CAST(json_extract_string(props, '$.k') AS INT) AS k FROM events),
alerts AS (
  SELECT 'AL-' || event_id AS alert_id, 'R-' || event_type AS rule_id, 'High value ' || event_type AS title,
    CASE WHEN value >= 200 THEN 'critical' WHEN value >= 120 THEN 'high' WHEN value >= 80 THEN 'medium' ELSE 'low' END AS severity,
    CASE WHEN value >= 200 THEN 4 WHEN value >= 120 THEN 3 WHEN value >= 80 THEN 2 ELSE 1 END AS weight,
    round(k / 100.0, 2)::DOUBLE AS confidence,
    CASE event_type WHEN 'error' THEN 'Credential Access' WHEN 'view' THEN 'Discovery' WHEN 'click' THEN 'Initial Access'
         WHEN 'purchase' THEN 'Execution' ELSE 'Persistence' END AS tactic,
    ts, 'host-' || (user_id % 20) AS asset,
    CASE user_id % 50 WHEN 0 THEN 'root' WHEN 1 THEN 'admin' WHEN 2 THEN 'administrator' WHEN 7 THEN NULL
         ELSE 'u' || (user_id % 50) END AS "user",
    CASE WHEN k = 99 THEN NULL WHEN k % 4 = 0 THEN '185.199.88.' || k ELSE '10.0.0.' || (k % 10) END AS src_ip,
    'evt-' || event_id AS event_id, 'Review ' || event_type AS recommended_action, event_id AS seq
  FROM k_events WHERE value >= 60
)
"""
