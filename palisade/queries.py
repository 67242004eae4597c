"""Registered queries over the driver's tables, one per operator."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import replace
from functools import wraps

from pyspark.sql import DataFrame, SparkSession, functions as F

from palisade.adapter import dense_events, raw_lines, security_events, table, to_security, value_alerts
from palisade.functions.columns import instant_us, off_hours_privileged, present, stable_id
from palisade.functions.net import is_external_ip
from palisade.operators.sliding import sliding_count
from palisade.plans import anomaly, classify, correlate, detect, report
from palisade.rules import RULES, Rule, contains_any, matches_any
from palisade.schema import ALERT_SCHEMA
from palisade.session import run_dir, stage
from palisade.sources import store
from palisade.sources.lines import size_quarantine, unwrap_payloads
from palisade.sources.normalize import (
    legacy_fields_from_json, parse_cloud_audit, parse_lines, parser_stats, quarantined, to_common_schema, valid_events,
)
from palisade.streaming import alerts as stream_alerts, counters, incidents as stream_incident_tables, ingest, rules as stream_rules

Query = Callable[[SparkSession, str], DataFrame]
REGISTRY: dict[str, Query] = {}
DAY = 24 * 60
REFERENCE_YEAR = 2024
INGEST_TIME = "2024-03-01 00:00:00"


def query(fn: Query) -> Query:
    @wraps(fn)
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        spark.conf.set("spark.sql.session.timeZone", "UTC")
        return fn(spark, sf_dir)

    REGISTRY[fn.__name__] = run
    return run


def ts(col: str = "timestamp"):
    return F.col(col).cast("timestamp_ntz").alias("ts")


def us_ts(col: str):
    return F.timestamp_micros(col).cast("timestamp_ntz").alias("ts")


# Scans, filters and the store.


@query
def event_filter(spark, sf_dir):
    found = report.filter_events(security_events(spark, sf_dir), event_type="ssh_login", user="root")
    return found.select("id", ts(), "asset", "src_ip", "status")


@query
def event_scan_oldest(spark, sf_dir):
    return store.oldest_first(security_events(spark, sf_dir), 100).select("id", ts(), "event_type")


@query
def storage_stats(spark, sf_dir):
    stats = store.storage_stats(security_events(spark, sf_dir))
    return stats.select(
        "stored_events", F.explode("source_distribution").alias("source", "n"),
        F.col("last_event_timestamp").cast("timestamp_ntz").alias("last_ts"),
    )


@query
def event_type_distribution(spark, sf_dir):
    return report.distribution(security_events(spark, sf_dir), "event_type")


@query
def insert_ignore(spark, sf_dir):
    """Logins are stored already; the whole table then comes in twice."""
    events = security_events(spark, sf_dir)
    stored = events.where(F.col("event_type") == "ssh_login")
    fresh = store.unseen(stored, events.unionByName(events))
    return fresh.select("id", ts(), "source")


@query
def event_json(spark, sf_dir):
    rows = store.to_json_rows(security_events(spark, sf_dir))
    back = store.from_json_rows(rows)
    return rows.join(back, "id").select("id", "event_json", ts(), "message")


# Normalisation.


def _parsed(spark, sf_dir):
    return parse_lines(raw_lines(table(spark, sf_dir, "events")), reference_year=REFERENCE_YEAR,
                       ingest_time=F.lit(INGEST_TIME).cast("timestamp"))


def _format(spark, sf_dir, name):
    parsed = _parsed(spark, sf_dir)
    return valid_events(parsed.where(F.col("format") == name))


@query
def parse_sshd(spark, sf_dir):
    return _format(spark, sf_dir, "sshd").select("seq", ts(), "asset", "user", "src_ip", "status", "message")


@query
def parse_windows(spark, sf_dir):
    return _format(spark, sf_dir, "windows").select(
        "seq", ts(), "event_type", "asset", "user", "process_name", "command_line", "status"
    )


@query
def parse_firewall(spark, sf_dir):
    return _format(spark, sf_dir, "firewall").select("seq", ts(), "asset", "src_ip", "dst_ip", "status", "message")


@query
def parse_web(spark, sf_dir):
    return _format(spark, sf_dir, "web").select("seq", ts(), "source", "asset", "src_ip", "status", "message")


@query
def json_normalize(spark, sf_dir):
    return _format(spark, sf_dir, "json").select("id", ts(), "utc_offset", "source", "event_type", "asset", "process_name")


@query
def parse_dispatch(spark, sf_dir):
    return _parsed(spark, sf_dir).groupBy("format", F.coalesce("reason", F.lit("ok")).alias("outcome")).agg(
        F.count("*").alias("n")
    )


@query
def parse_stats(spark, sf_dir):
    return parser_stats(_parsed(spark, sf_dir)).select(
        "parsed_events", "parsing_failed_events", "unknown_events",
        F.array_join("unknown_samples", "|").alias("unknown_samples"),
    )


@query
def quarantine(spark, sf_dir):
    return quarantined(_parsed(spark, sf_dir)).select("raw", "reason", "seq")


@query
def event_ids(spark, sf_dir):
    return valid_events(_parsed(spark, sf_dir)).select("seq", "id")


@query
def envelope_explode(spark, sf_dir):
    """One request body per conversation, in one of three envelopes."""
    turns = table(spark, sf_dir, "conversations").groupBy("conv_id").agg(
        F.array_sort(F.collect_list(F.struct("turn", "role", "text"))).alias("t")
    )
    items = F.to_json(F.transform("t", lambda x: x.getField("text")))
    objects = F.to_json(F.transform("t", lambda x: F.struct(x.getField("role").alias("source"), x.getField("turn").alias("n"))))
    shape = F.col("conv_id") % 3
    payload = (
        F.when(shape == 0, F.concat(F.lit('{"logs": '), items, F.lit("}")))
        .when(shape == 1, F.concat(F.lit('{"events": '), objects, F.lit("}"))).otherwise(items)
    )
    return unwrap_payloads(turns.select("conv_id", payload.alias("payload"))).select("conv_id", "item", "raw")


@query
def json_items(spark, sf_dir):
    """Request bodies of every shape, some empty and some malformed, down to events and quarantine."""
    turns = table(spark, sf_dir, "conversations").groupBy("conv_id").agg(
        F.array_sort(F.collect_list(F.struct("turn", "role", "text"))).alias("t"))
    texts = F.to_json(F.transform("t", lambda x: x.getField("text")))
    shapes = [texts, F.concat(F.lit('{"logs": '), texts, F.lit("}")), F.lit("[]"), F.lit('{"logs": []}'), F.concat(texts, F.lit("]")),
              F.lit('{"logs": null}'), F.to_json(F.struct(F.col("conv_id").cast("string").alias("source"), F.lit("turn").alias("event_type")))]
    payload = F.get(F.array(*shapes), (F.col("conv_id") % len(shapes)).cast("int"))
    rows = unwrap_payloads(turns.select("conv_id", payload.alias("payload"))).withColumnRenamed("item", "position")
    parsed = parse_lines(rows, reference_year=REFERENCE_YEAR, ingest_time=F.lit(INGEST_TIME).cast("timestamp"))
    return parsed.select("conv_id", F.coalesce(F.col("position").cast("bigint"), F.lit(-1)).alias("position"), F.coalesce("reason", F.lit("ok")).alias("outcome"), "source")


@query
def oversize_quarantine(spark, sf_dir):
    _, over = size_quarantine(table(spark, sf_dir, "documents"), "text", 10_240)
    return over.select("doc_id", F.octet_length("text").alias("n_bytes"), "reason")


@query
def legacy_normalize(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "source", "lang")
    title = F.when(F.col("lang") == "fr", F.struct("source", F.col("text").alias("message")))
    raw = F.coalesce(F.to_json(title), F.to_json(F.struct(F.col("lang").alias("title"), F.col("text").alias("message"))))
    return legacy_fields_from_json(docs.select("doc_id", raw.alias("raw"))).drop("raw", "timestamp")


@query
def common_schema(spark, sf_dir):
    renamed = to_common_schema(security_events(spark, sf_dir).select("id", "src_ip", "user", "asset"), "linux_auth")
    return renamed.select("id", F.col("`source.ip`").alias("source_ip"), F.col("`user.name`").alias("user_name"),
                          F.col("`host.name`").alias("host_name"))


@query
def cloud_audit(spark, sf_dir):
    e = security_events(spark, sf_dir)
    raw = F.to_json(F.struct(
        F.date_format("timestamp", "yyyy-MM-dd'T'HH:mm:ss'Z'").alias("eventTime"), F.col("message").alias("eventName"),
        F.struct(F.col("user").alias("arn")).alias("userIdentity"), F.col("src_ip").alias("sourceIPAddress"),
        F.col("asset").alias("awsRegion"),
    ))
    parsed = parse_cloud_audit(e.select("seq", raw.alias("raw")))
    return parsed.select("seq", ts(), "source", "event_type", "asset", "user", "src_ip", "message")


# Predicates and classification.


@query
def regex_rule(spark, sf_dir):
    return table(spark, sf_dir, "pages").where(matches_any("url", [r"page=\d", r"(?i)#TOP$"])).select("page_id", "url")


@query
def contains_rule(spark, sf_dir):
    return table(spark, sf_dir, "documents").where(contains_any("text", ["License", "the of", "password"])).select("doc_id", "lang")


@query
def external_ip(spark, sf_dir):
    """Addresses made of the line items' keys, all over the IPv4 space."""
    octet = lambda c, m: (F.col(c) * m % 256).cast("string")
    ip = F.concat(octet("l_orderkey", 7), F.lit("."), octet("l_partkey", 13), F.lit("."), octet("l_suppkey", 29),
                  F.lit("."), octet("l_linenumber", 41))
    rows = table(spark, sf_dir, "lineitem").select(ip.alias("ip"))
    return rows.groupBy("ip").agg(F.count("*").alias("n")).select("ip", "n", is_external_ip("ip").alias("external"))


WORDS = [
    classify.KeywordRule("W-1", "SSH Brute Force", "High", "Credential Access", "T1110", ("password", "licen")),
    classify.KeywordRule("W-2", "Suspicious PowerShell", "High", "Execution", "T1059.001", ("the ent", "élle")),
    classify.KeywordRule("W-3", "Port Scan", "Medium", "Discovery", "T1046", ("and the",)),
    classify.KeywordRule("W-4", "Admin Account Created", "High", "Persistence", "T1136", ("les ",)),
]


def _document_alerts(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select(
        F.col("doc_id").alias("seq"), F.col("text").alias("message"), "source", F.col("lang").alias("asset")
    )
    return classify.generate_alerts(classify.number_rows(classify.with_rule(docs, WORDS)), WORDS)


@query
def keyword_classify(spark, sf_dir):
    return _document_alerts(spark, sf_dir).select(
        "id", "title", "severity", "confidence", "source", "asset", "tactic", "technique", "status", "recommendation"
    )


@query
def legacy_incidents(spark, sf_dir):
    return classify.older_incidents(_document_alerts(spark, sf_dir))


@query
def legacy_risk(spark, sf_dir):
    alerts = _document_alerts(spark, sf_dir)
    return classify.older_risk_score(alerts, classify.older_incidents(alerts))


@query
def triage_card(spark, sf_dir):
    card = classify.triage_card(classify.highest_risk(_document_alerts(spark, sf_dir)))
    return card.withColumn("recommended_actions", F.array_join("recommended_actions", "|"))


@query
def triage_latest(spark, sf_dir):
    """Decisions are the conversations' turns on the alert of the same number."""
    turns = table(spark, sf_dir, "conversations").select(
        F.concat(F.lit("ALT-"), (F.col("conv_id") + 1041).cast("string")).alias("alert_id"),
        F.concat(F.col("role"), F.lit("-"), F.col("turn").cast("string")).alias("action"),
        F.when(F.col("role") == "user", F.lit("analyst")).alias("analyst"),
        F.timestamp_seconds(F.col("turn")).alias("recorded_at"),
    )
    records, _ = store.triage_records(turns)
    alerts = _document_alerts(spark, sf_dir).select(F.col("id").alias("alert_id"), "severity")
    return store.latest_triage(alerts, records)


# Windows, suppression and first-seen.

BURST = replace(RULES[0], threshold=5, time_window_minutes=DAY)
SPRAY = replace(RULES[2], threshold=8, time_window_minutes=DAY)
SCAN = replace(RULES[4], threshold=6, time_window_minutes=DAY)
AFTER_FAILURES = replace(RULES[1], threshold=2, time_window_minutes=15 * DAY)
REQUESTS = replace(RULES[6], regex={"message": [r"(?i)k=[1-4]\b", "(?i)K=7", r"k=\d5"]})
ACCOUNTS = replace(RULES[5], contains={"message": ["signup", "admin"]})
ALL_DEMO = [BURST, AFTER_FAILURES, SPRAY, SCAN, ACCOUNTS, REQUESTS]


def _failures(spark, sf_dir):
    events = detect.timed(security_events(spark, sf_dir))
    return events.where((F.col("event_type") == "ssh_login") & (F.col("status") == "failure"))


@query
def burst_threshold(spark, sf_dir):
    rows = _failures(spark, sf_dir).select("src_ip", "us", "seq", "id")
    counted = sliding_count(rows, ["src_ip"], F.lit(BURST.window_us))
    return counted.where(F.col("in_window") >= BURST.threshold).select("id", "src_ip", us_ts("us"), "in_window")


@query
def distinct_burst(spark, sf_dir):
    rows = _failures(spark, sf_dir).select("src_ip", "us", "seq", "id", present("user").alias("user"))
    counted = sliding_count(rows, ["src_ip"], F.lit(SPRAY.window_us), F.col("user"), F.col("user").isNotNull(), "users")
    return counted.where(F.col("users") >= SPRAY.threshold).select("id", "src_ip", us_ts("us"), "users")


@query
def failures_then_success(spark, sf_dir):
    events = detect.timed(security_events(spark, sf_dir))
    return detect.preceded_candidates(events, [AFTER_FAILURES], 0).select("id", "src_ip", "user", us_ts("us"))


@query
def off_hours(spark, sf_dir):
    events = detect.timed(security_events(spark, sf_dir))
    return events.where(off_hours_privileged("us")).select("id", "user", ts())


def _emitted(spark, sf_dir, rules, off_hours_rule=False):
    found = detect.triggers_of(security_events(spark, sf_dir), rules, off_hours_rule)
    return found.select(F.col("rule"), F.col("t_id").alias("id"), us_ts("t_us"))


@query
def alerts_suppressed(spark, sf_dir):
    """Each request is a candidate; one alert per entity in 15 minutes. Off-hours logins too."""
    entity = replace(REQUESTS, regex={}, group_by=("src_ip", "user", "asset"))
    return _emitted(spark, sf_dir, [entity], True)


@query
def alerts_minute_fold(spark, sf_dir):
    """Once a minute per source address, with suppression per entity, over a one-day burst."""
    return _emitted(spark, sf_dir, [replace(BURST, threshold=2)])


@query
def alerts_global_fold(spark, sf_dir):
    """A rule without a grouping key: once a minute over all entities."""
    return _emitted(spark, sf_dir, [replace(REQUESTS, regex={})])


@query
def alerts_cross_key(spark, sf_dir):
    """A rule keyed by destination: once a minute for each, and no entity twice in 15 minutes under whatever key."""
    scan = replace(SCAN, threshold=1, distinct_field=None, group_by=("dst_ip",))
    return _emitted(spark, sf_dir, [scan])


@query
def rare_source(spark, sf_dir):
    alerts = detect.rare_source_alerts(detect.timed(security_events(spark, sf_dir)), 0)
    return alerts.select("alert_id", "user", "src_ip", ts(), F.array_join("evidence", "|").alias("evidence"))


@query
def rare_source_any_success(spark, sf_dir):
    return anomaly.rare_source_hits(security_events(spark, sf_dir)).select("user", "src_ip", "id")


@query
def first_seen_process(spark, sf_dir):
    return anomaly.new_process_hits(security_events(spark, sf_dir)).select("entity", "proc", "id", us_ts("us"))


# Whole alert rows.


def _flat_alerts(alerts):
    return alerts.select(
        "alert_id", "rule_id", "title", "severity", "confidence", "tactic", "technique", ts(), "asset", "user", "src_ip",
        F.array_join("event_ids", ",").alias("event_ids"), F.array_join("evidence", "|").alias("evidence"),
        "recommended_action",
    )


@query
def alert_rows(spark, sf_dir):
    """Request alerts per entity with their events of the last day and evidence lines."""
    rule = replace(REQUESTS, regex={}, time_window_minutes=DAY, group_by=("src_ip", "user", "asset"))
    return _flat_alerts(detect.run_detections(security_events(spark, sf_dir), [rule], rare_source=False, off_hours=False))


@query
def alerts_all_rules(spark, sf_dir):
    """All rules with windows to suit the sparse data, sorted as a report."""
    return _flat_alerts(detect.sorted_detections(security_events(spark, sf_dir), ALL_DEMO))


@query
def detections_default_rules(spark, sf_dir):
    """The rule set as it is."""
    return _flat_alerts(detect.run_detections(dense_events(spark, sf_dir), RULES))


@query
def detected_member_rows(spark, sf_dir):
    """The events behind each alert of all rules, row by row."""
    return detect.alert_members(security_events(spark, sf_dir), ALL_DEMO, timed=False).select("rule_id", "trigger_id", "event_id")


@query
def detected_alert_ids(spark, sf_dir):
    """The ids of all rules' alerts, hashed without gathering an alert's events."""
    return detect.alert_ids(security_events(spark, sf_dir), ALL_DEMO).select("rule_id", "trigger_id", "alert_id", "n_events")


@query
def alert_event_rows(spark, sf_dir):
    alerts = value_alerts(spark, sf_dir)
    return detect.alert_events(alerts)


@query
def stable_ids(spark, sf_dir):
    events = security_events(spark, sf_dir)
    return events.select("id", stable_id("AL", "array('DET-AI-002', id)").alias("alert_id"))


@query
def alert_sort(spark, sf_dir):
    alerts = detect.sort_alerts(value_alerts(spark, sf_dir))
    return alerts.select("alert_id", "severity", "confidence", ts())


@query
def alert_filter(spark, sf_dir):
    found = report.filter_alerts(value_alerts(spark, sf_dir), severity="high", tactic="Execution")
    return found.select("alert_id", "asset", "user")


@query
def top_confidence(spark, sf_dir):
    return report.most_confident(value_alerts(spark, sf_dir)).select("alert_id", "confidence", ts())


# Incidents.


@query
def incident_components(spark, sf_dir):
    """Each alert with the first alert (by id) of its incident."""
    members = stage(correlate.incident_members(value_alerts(spark, sf_dir)), "members")
    first = members.groupBy("component").agg(F.min("alert_id").alias("incident"), F.count("*").alias("n_alerts"))
    return members.join(first, "component").select("alert_id", "incident", "n_alerts")


@query
def incident_priority(spark, sf_dir):
    members = stage(correlate.incident_members(value_alerts(spark, sf_dir)), "members")
    first = members.groupBy("component").agg(F.min("alert_id").alias("incident"))
    return correlate.incident_priorities(members).join(first, "component").select("incident", "priority", "n_alerts", "weight")


@query
def incident_rollup(spark, sf_dir):
    incidents = correlate.correlate(value_alerts(spark, sf_dir))
    return incidents.select(
        "incident_id", "title", "priority", "status", "owner", F.array_join("related_alert_ids", ",").alias("alert_ids"),
        F.array_join("related_assets", ",").alias("assets"), F.array_join("related_users", ",").alias("users"),
        F.array_join("related_src_ips", ",").alias("src_ips"), "evidence_summary",
        F.array_join("recommended_actions", "|").alias("actions"),
        F.get("timeline", F.lit(0)).getField("timestamp").alias("first_time"),
    )


@query
def incident_ids(spark, sf_dir):
    """The ids of all incidents, hashed without gathering an incident's alerts."""
    members = stage(correlate.incident_members(value_alerts(spark, sf_dir)), "members")
    return correlate.incident_ids(members).select("incident_id", "n_alerts")


@query
def incident_filter(spark, sf_dir):
    found = report.filter_incidents(correlate.correlate(value_alerts(spark, sf_dir)), status="open", priority="P2")
    return found.select("incident_id", "title", F.array_join("related_alert_ids", ",").alias("alert_ids"))


@query
def incident_lookup(spark, sf_dir):
    """The incident with the smallest id, by that id."""
    incidents = stage(correlate.correlate(value_alerts(spark, sf_dir)), "incidents")
    found = report.find_incident(incidents, incidents.agg(F.min("incident_id")).scalar())
    return found.select("incident_id", "priority", "status", F.array_join("related_alert_ids", ",").alias("alert_ids"))


# Anomalies.


@query
def volume_zscore(spark, sf_dir):
    return anomaly.asset_volumes(security_events(spark, sf_dir)).select("asset", "n", F.round("z", 6).alias("z"))


@query
def volume_anomalies(spark, sf_dir):
    hits = anomaly.volume_anomalies(security_events(spark, sf_dir))
    return hits.select("entity", F.round("anomaly_score", 6).alias("anomaly_score"), "reason")


@query
def failed_login_volume(spark, sf_dir):
    hits = anomaly.failed_login_anomalies(security_events(spark, sf_dir), 3)
    return hits.select("entity", F.round("anomaly_score", 6).alias("anomaly_score"), "reason")


@query
def anomaly_top20(spark, sf_dir):
    found = anomaly.detect_anomalies(security_events(spark, sf_dir))
    return found.select("family", "entity", F.round("anomaly_score", 6).alias("anomaly_score"), "reason", "event_id")


@query
def anomaly_event_rows(spark, sf_dir):
    events = security_events(spark, sf_dir)
    found = stage(anomaly.detect_anomalies(events), "anomalies")
    return anomaly.anomaly_events(events, found).join(found.select("anomaly_id", "family", "entity"), "anomaly_id").select(
        "family", "entity", "seq", F.col("event_id").alias("id")
    )


# Reports.


@query
def risk_score(spark, sf_dir):
    alerts = value_alerts(spark, sf_dir)
    incidents = _alert_incidents(alerts)
    return alerts.agg(F.count("*").alias("total_alerts")).select(
        "total_alerts", report.risk_points(alerts, incidents).cast("bigint").alias("risk_score")
    )


def _alert_incidents(alerts, *keys):
    """One single-alert incident each, as far as the scores go."""
    return alerts.select(
        *keys,
        F.when(F.col("severity") == "critical", "P1").when(F.col("severity") == "high", "P2").otherwise("P3").alias("priority"),
        F.when(F.col("tactic") == "Discovery", "closed").otherwise("open").alias("status"),
    )


def _pairs(c):
    """A map of counts as sorted text."""
    return F.array_join(F.transform(F.array_sort(F.map_entries(c)), lambda e: F.concat(
        e.getField("key"), F.lit("="), e.getField("value").cast("string"))), ",")


@query
def metrics_summary(spark, sf_dir):
    alerts = value_alerts(spark, sf_dir)
    incidents = _alert_incidents(alerts)
    row = report.calculate_metrics(security_events(spark, sf_dir), alerts, incidents, parser_stats(_parsed(spark, sf_dir)))
    return row.select(
        "total_events", "total_alerts", "critical_alerts", "high_alerts", "open_incidents", "risk_score",
        _pairs("top_tactics").alias("top_tactics"), _pairs("source_distribution").alias("sources"),
        _pairs("event_type_distribution").alias("event_types"), "parsing_failed_events", "unknown_events",
        "unknown_event_rate_pct",
    )


@query
def risk_by_asset(spark, sf_dir):
    """Risk of each asset and day, with one incident an alert."""
    alerts = value_alerts(spark, sf_dir).withColumn("day", F.date_format("timestamp", "yyyy-MM-dd"))
    return report.risk_by(alerts, _alert_incidents(alerts, "asset", "day"), "asset", "day")


@query
def older_risk_by_source(spark, sf_dir):
    return classify.older_risk_by(_document_alerts(spark, sf_dir), "source", "asset")


@query
def metrics_chain(spark, sf_dir):
    """Events to alerts of the rule set, to incidents, to metrics."""
    events = dense_events(spark, sf_dir)
    alerts = stage(detect.run_detections(events, RULES), "alerts")
    # The metrics read no list of an incident's alerts, so none is gathered in a task.
    incidents = stage(correlate.correlate(alerts).select("priority", "status"), "incidents")
    row = report.calculate_metrics(events, alerts, incidents)
    priorities = incidents.groupBy("priority").agg(F.count("*").alias("n")).agg(
        F.array_join(F.array_sort(F.collect_list(F.concat("priority", F.lit("="), F.col("n").cast("string")))), ",")).scalar()
    points = report.risk_by(alerts, incidents).select("points").scalar()
    return row.select("total_events", "total_alerts", "critical_alerts", "high_alerts", "open_incidents", "risk_score",
                      _pairs("top_tactics").alias("top_tactics"), priorities.alias("priorities"), points.alias("points"))


@query
def top_tactics(spark, sf_dir):
    return report.top_tactics(value_alerts(spark, sf_dir)).select("tactic", "n")


def _customer_rules(spark, sf_dir):
    """Rule metadata with gaps: a rule per customer, tactic by segment, technique by nation."""
    c = table(spark, sf_dir, "customer")
    return c.select(
        F.concat(F.lit("R-"), F.col("c_custkey").cast("string")).alias("id"), F.lit("").alias("tactic"),
        F.when(F.col("c_mktsegment") != "MACHINERY", F.col("c_mktsegment")).alias("mitre_tactic"),
        F.when(F.col("c_nationkey") > 0, F.concat(F.lit("T"), F.col("c_nationkey").cast("string"))).alias("technique"),
    )


@query
def coverage_tactics(spark, sf_dir):
    return report.coverage_by_tactic(_customer_rules(spark, sf_dir))


@query
def coverage_techniques(spark, sf_dir):
    found = report.coverage_by_technique(_customer_rules(spark, sf_dir))
    return found.withColumn("rules", F.array_join("rules", ","))


@query
def coverage_unmapped(spark, sf_dir):
    return report.unmapped_rules(_customer_rules(spark, sf_dir))


# Streams: the same answers from micro-batches.


def _event_stream(spark, sf_dir):
    """The events table as a stream with a watermark; state is kept in RocksDB."""
    spark.conf.set("spark.sql.streaming.stateStore.providerClass",
                   "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    schema = table(spark, sf_dir, "events").schema
    return spark.readStream.schema(schema).parquet(f"{sf_dir}/events*.parquet")


def _security_stream(spark, sf_dir):
    """Security events, and a day after the last of them one of each kind by an entity of its own, which
    raises nothing. They move the watermark past all others, so that none is held back."""
    events = to_security(_event_stream(spark, sf_dir))
    known = to_security(table(spark, sf_dir, "events"))
    end = known.agg(F.max("timestamp") + F.expr("INTERVAL 1 DAY")).scalar()
    kinds = known.select("source", "event_type", "status").distinct()
    own = {"timestamp": end, "id": F.concat_ws("-", F.lit("end"), "event_type", "status"), "seq": F.lit(-1), "utc_offset": F.lit(0),
           "command_line": F.lit("run -enc"), "event_date": F.to_date(end)}
    own |= {name: F.col(name) for name in kinds.columns} | {name: F.lit("end") for name in ("user", "src_ip", "asset", "process_name")}
    closing = stage(kinds.select(*[own.get(f.name, F.lit(None)).cast(f.dataType).alias(f.name) for f in events.schema.fields]), "end")
    folder = closing.inputFiles()[0].rsplit("/", 1)[0]
    return events.unionByName(spark.readStream.schema(events.schema).parquet(folder)).withWatermark("timestamp", "0 seconds")


@query
def stream_normalize(spark, sf_dir):
    events = ingest.normalize_stream(raw_lines(_event_stream(spark, sf_dir)), reference_year=REFERENCE_YEAR,
                                     ingest_time=F.lit(INGEST_TIME).cast("timestamp"))
    return ingest.to_table(events.select("seq", "id", "timestamp", "source", "event_type"), "normalized").select("seq", "id", ts(), "source", "event_type")


@query
def stream_parse_stats(spark, sf_dir):
    """What a stream of lines came to, as its listener has it."""
    target = run_dir(spark, "counted")
    listener = counters.ParsingCounters(spark, f"{target}/counts")
    spark.streams.addListener(listener)
    try:
        parsed = counters.counted(parse_lines(raw_lines(_event_stream(spark, sf_dir)), reference_year=REFERENCE_YEAR,
                                              ingest_time=F.lit(INGEST_TIME).cast("timestamp")))
        writer = valid_events(parsed).writeStream.format("parquet").option("path", f"{target}/data").option("checkpointLocation", f"{target}/checkpoint")
        running = writer.trigger(availableNow=True).start()
        running.awaitTermination()
        listener.wait_for(running.runId)
    finally:
        spark.streams.removeListener(listener)
    return counters.totals(spark, f"{target}/counts")


@query
def stream_store(spark, sf_dir):
    """Micro-batches into the event store; the second pass stores nothing."""
    target = run_dir(spark, "store")
    for turn in ("first", "second"):
        ingest.ingest_events(to_security(_event_stream(spark, sf_dir)), f"{target}/events", f"{target}/{turn}").awaitTermination()
    return store.read_store(spark, f"{target}/events").groupBy(
        "source", F.col("event_date").cast("string").alias("event_date")
    ).agg(F.count("*").alias("n"))


@query
def stream_burst(spark, sf_dir):
    found = stream_rules.rule_triggers(_security_stream(spark, sf_dir), [replace(BURST, threshold=2)], False)
    return ingest.to_table(found, "burst").select("id", us_ts("us"))


@query
def stream_failures_then_success(spark, sf_dir):
    found = stream_rules.rule_triggers(_security_stream(spark, sf_dir), [AFTER_FAILURES], True)
    return ingest.to_table(found, "failures").select("rule", "id", us_ts("us"))


@query
def stream_rare_source(spark, sf_dir):
    found = stream_rules.rare_sources(_security_stream(spark, sf_dir))
    return ingest.to_table(found, "rare").select("user", "src_ip", "id", F.array_join("known", ",").alias("known"))


@query
def stream_first_seen_process(spark, sf_dir):
    found = stream_rules.new_processes(_security_stream(spark, sf_dir))
    return ingest.to_table(found, "processes").select("entity", "proc", "id", us_ts("us"))


def _delivered(spark, sf_dir, parts, late=False):
    """The dense events in parts by time, and a row a day after the last that moves the watermark past all others. With
    ``late``, a tenth of the rows of each part come with the next."""
    events = dense_events(spark, sf_dir)
    low, high = events.agg(F.min(F.unix_micros("timestamp")), F.max(F.unix_micros("timestamp"))).first()
    part = F.expr(f"cast((unix_micros(timestamp) - {low}) * {parts} div {high - low + 1} AS int)")
    if late:
        part = F.when(F.pmod(F.xxhash64("id"), F.lit(10)) == 0, F.least(part + 1, F.lit(parts - 1))).otherwise(part)
    end = F.timestamp_micros(F.lit(high)) + F.expr("INTERVAL 1 DAY")
    own = {"timestamp": end, "event_date": F.to_date(end), "id": F.lit("end"), "seq": F.lit(-1), "event_type": F.lit("none")}
    closing = spark.range(1).select(*[own.get(n, F.lit(None)).cast(t).alias(n) for n, t in events.dtypes])
    dealt = stage(events.withColumn("part", part), "delivered")
    found = [dealt.where(F.col("part") == i).drop("part") for i in range(parts)]
    return [*found[:-1], found[-1].unionByName(closing)]


def _fed(spark, parts, target):
    """Each part into a store, then through the rules; up to which instant alerts are published."""
    schema = parts[0].schema
    for i, rows in enumerate(parts):
        rows.write.parquet(f"{target}/in/part={i}")
        events = spark.readStream.schema(schema).parquet(f"{target}/in/part=*")
        ingest.ingest_events(events, f"{target}/store", f"{target}/ingest", late=f"{target}/late", delay="0 seconds").awaitTermination()
        query = stream_alerts.follow_alerts(spark, f"{target}/store", f"{target}/alerts", f"{target}/rules", delay="0 seconds")
        query.awaitTermination()
        yield stream_alerts.watermark_us(query)


def _rocks(spark):
    spark.conf.set("spark.sql.streaming.stateStore.providerClass",
                   "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")


@query
def stream_alert_rows(spark, sf_dir):
    """Whole alert rows of the rule set from three micro-batches."""
    _rocks(spark)
    target = run_dir(spark, "alerts")
    for _ in _fed(spark, _delivered(spark, sf_dir, 3), target):
        pass
    return _flat_alerts(stream_alerts.published_alerts(spark, f"{target}/alerts"))


@query
def stream_late_repair(spark, sf_dir):
    """The same from two micro-batches, with rows that come late, and repaired."""
    _rocks(spark)
    target = run_dir(spark, "repair")
    upto = list(_fed(spark, _delivered(spark, sf_dir, 2, late=True), target))[-1]
    stream_alerts.repair_alerts(spark, f"{target}/store", f"{target}/alerts", f"{target}/late", f"{target}/corrections", upto)
    return _flat_alerts(stream_alerts.published_alerts(spark, f"{target}/alerts", f"{target}/corrections"))


@query
def stream_incidents(spark, sf_dir):
    """Alerts arrive in three micro-batches, none of them in the order of time; incidents grow batch by batch."""
    target = run_dir(spark, "incidents")
    alerts = stage(value_alerts(spark, sf_dir).withColumn("part", F.pmod(F.xxhash64("alert_id"), F.lit(3))), "delivered-alerts")
    for part in range(3):
        alerts.where(F.col("part") == part).drop("part").write.parquet(f"{target}/in/part={part}")
        arriving = spark.readStream.schema(ALERT_SCHEMA).parquet(f"{target}/in/part=*")
        stream_incident_tables.follow_incidents(arriving, f"{target}/alerts", f"{target}/members", f"{target}/checkpoint").awaitTermination()
    members = stage(stream_incident_tables.current_members(spark, f"{target}/members"), "members")
    first = members.groupBy("component").agg(F.min("alert_id").alias("incident"), F.count("*").alias("n_alerts"))
    return members.join(first, "component").select("alert_id", "incident", "n_alerts")
