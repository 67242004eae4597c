"""The sample from raw text to metrics, and the store."""

import json

import pytest
from pyspark.sql import functions as F

from palisade.plans.anomaly import anomaly_events, anomaly_report, detect_anomalies
from palisade.plans.correlate import correlate
from palisade.plans.detect import run_detections
from palisade.plans.report import attack_coverage, calculate_metrics, find_incident, most_confident
from palisade.rules import rules_table, strict_traversal
from palisade.session import stage
from palisade.sources.lines import read_json_items
from palisade.sources.normalize import parse_lines, parser_stats, valid_events
from palisade.sources.store import (
    from_json_rows, latest_triage, load_events, load_or_seed, read_store, save_events, storage_stats, to_json_rows,
    triage_records,
)
from tests.helpers import event, event_frame
from tests.sample import sample_items


@pytest.fixture(scope="module")
def sample(spark, tmp_path_factory):
    path = tmp_path_factory.mktemp("sample") / "logs.json"
    path.write_text(json.dumps(sample_items(), indent=1))
    parsed = parse_lines(read_json_items(spark, str(path)), reference_year=2026)
    events = stage(valid_events(parsed), "events")
    alerts = stage(run_detections(events), "alerts")
    return parsed, events, alerts, stage(correlate(alerts), "incidents")


def test_events(sample):
    parsed, events, _, _ = sample
    stats = parser_stats(parsed).first()
    assert (stats.parsed_events, stats.parsing_failed_events, stats.unknown_events) == (55, 0, 0)
    by_source = {r.source: r["count"] for r in events.groupBy("source").count().collect()}
    assert by_source == {"linux_auth": 32, "firewall": 13, "windows": 5, "waf": 3, "edr": 2}
    assets = {r.asset: r["count"] for r in events.groupBy("asset").count().collect()}
    assert assets == {"dock-7": 12, "ledger-1": 14, "gate-a": 6, "desk-3": 4, "dir-1": 3, "yard-fw": 13, "web01": 3}


def test_alerts(spark, sample):
    _, events, alerts, _ = sample
    sizes = {}
    for r in alerts.orderBy("emit_us").collect():
        sizes.setdefault(r.rule_id, []).append(len(r.event_ids))
    assert sizes == {"DET-SSH-001": [5, 5], "DET-SSH-002": [8], "DET-SSH-003": [5], "DET-AI-001": [1], "DET-AI-002": [1], "DET-PS-001": [1],
                     "DET-WIN-001": [1, 1], "DET-NET-001": [8], "DET-WAF-001": [1, 1]}
    assert run_detections(events, strict_traversal()).where("rule_id = 'DET-WAF-001'").count() == 1
    assert most_confident(alerts).first().rule_id == "DET-PS-001"


def test_incidents(sample):
    incidents = sample[3]
    got = sorted((len(i.related_alert_ids), i.priority) for i in incidents.collect())
    assert got == [(1, "P3")] * 3 + [(2, "P2")] * 3 + [(3, "P1")]
    one = incidents.where("array_contains(related_users, 'deploy')").first()
    assert one.title == "Correlated SOC activity: Credential Access, Initial Access" and one.related_src_ips == ["91.198.174.5"]
    assert [t.timestamp for t in one.timeline] == ["2026-03-04T11:00:40+00:00", "2026-03-04T11:02:00+00:00"]
    assert find_incident(incidents, one.incident_id).first().priority == "P2"
    assert find_incident(incidents, "INC-NONE").count() == 0


def test_metrics_and_coverage(spark, sample):
    parsed, events, alerts, incidents = sample
    m = calculate_metrics(events, alerts, incidents, parser_stats(parsed)).first()
    assert (m.total_events, m.total_alerts, m.critical_alerts, m.high_alerts, m.open_incidents, m.risk_score) == (55, 12, 3, 6, 7, 100)
    assert m.top_tactics == {"Initial Access": 4, "Credential Access": 3, "Persistence": 2, "Execution": 1, "Discovery": 1}
    assert m.source_distribution["waf"] == 3 and m.event_type_distribution["ssh_login"] == 32
    c = attack_coverage(rules_table(spark)).first()
    assert c.total_rules == 7 and c.unmapped_rules == []
    assert [(t.tactic, t.rule_count) for t in c.tactics][:2] == [("Credential Access", 2), ("Initial Access", 2)]
    assert [t.technique for t in c.techniques][0] == "T1110" and len(c.techniques) == 7


def test_risk_below_its_limit(sample):
    """Ledger and gate alone: two high alerts (12 each), two medium ones (6 each), incidents P2 (14) and two P3 (6 each)."""
    alerts = sample[2].where("asset IN ('ledger-1', 'gate-a')")
    incidents = sample[3].where("arrays_overlap(related_assets, array('ledger-1', 'gate-a'))")
    assert calculate_metrics(sample[1], alerts, incidents).first().risk_score == 2 * 12 + 2 * 6 + 14 + 2 * 6
    closed = incidents.withColumn("status", F.lit("closed"))
    assert calculate_metrics(sample[1], alerts, closed).first().risk_score == 2 * 12 + 2 * 6


def test_sample_anomalies(sample):
    rows = anomaly_report(sample[1]).collect()
    assert [(r.entity, round(r.anomaly_score, 2)) for r in rows] == [("deploy@91.198.174.5", 0.98), ("lian", 0.81), ("kofi", 0.8), ("admin", 0.76)]
    assert json.loads(rows[0].features_json) == {"failed_logins": 7, "z_score": 2.45} and len(rows[0].related_event_ids) == 7
    assert json.loads(rows[3].features_json)["hour"] == 5


def test_anomaly_families(spark):
    rows = [event(i, asset="noisy", user=None, status="x") for i in range(60)]
    rows += [event(100 + i, asset=f"h{i}", user=None, status="x") for i in range(3)]
    rows += [event(200 + i, seconds=200 + i, src_ip=f"10.0.0.{i}", user="ann", asset=None) for i in range(3)]
    rows += [event(210, src_ip="8.8.8.8", user="ann", asset=None), event(211, src_ip="9.9.9.9", user="ann", asset=None)]
    rows += [event(220 + i, user="bob", asset=None, status="x", process_name=p, command_line=c)
             for i, (p, c) in enumerate([("A.exe", "run"), ("a.exe", "-enc"), ("B.exe", "x -ENC y"), ("b.exe", "-enc")])]
    events = event_frame(spark, rows)
    found = detect_anomalies(events).collect()
    by_family = {r.family: r for r in found}
    assert set(by_family) == {"volume", "rare_source", "process"}
    assert by_family["volume"].entity == "noisy"
    assert json.loads(by_family["rare_source"].features_json) == {"src_ip": "8.8.8.8", "known_sources": ["10.0.0.0", "10.0.0.1", "10.0.0.2"]}
    assert by_family["process"].event_id == "e00222" and by_family["process"].entity == "bob"
    members = anomaly_events(events, detect_anomalies(events)).groupBy("anomaly_id").count().collect()
    assert sorted(r["count"] for r in members) == [1, 1, 25]
    none = event_frame(spark, [event(i, user=f"user{i}", src_ip=f"10.0.0.{i}") for i in range(1, 4)])
    assert detect_anomalies(none).count() == 0


def test_store(spark, sample, tmp_path):
    events, path = sample[1], str(tmp_path / "store")
    assert read_store(spark, path).count() == 0
    twice = events.unionByName(events)
    assert save_events(twice, path) == 55 and save_events(events, path) == 0
    assert save_events(event_frame(spark, [event(1), event(1, seconds=9), event(2)]), path) == 2
    stats = storage_stats(read_store(spark, path)).first()
    assert stats.stored_events == 57 and stats.source_distribution["waf"] == 3
    oldest = [r.timestamp for r in load_events(spark, path, 5).collect()]
    assert oldest == sorted(oldest) and len(oldest) == 5
    assert load_or_seed(spark, str(tmp_path / "seed"), events).count() == 55
    rows = to_json_rows(events).join(events.select("id", "seq"), "id")
    back = from_json_rows(rows).select(events.columns)
    assert back.exceptAll(events).count() == 0 and events.exceptAll(back).count() == 0


def test_triage(spark, sample):
    alerts = sample[2]
    first = alerts.orderBy("alert_id").first().alert_id
    decisions = spark.createDataFrame(
        [(first, "close", None, 1), (first, "escalate", "kim", 2), (first, "", "kim", 3), (None, "x", None, 4)],
        "alert_id string, action string, analyst string, at int",
    ).withColumn("recorded_at", F.timestamp_seconds("at")).drop("at")
    records, rejected = triage_records(decisions)
    assert (records.count(), rejected.count()) == (2, 2)
    assert {r.analyst for r in records.collect()} == {"frontend", "kim"}
    shown = latest_triage(alerts, records).where(F.col("alert_id") == first).first()
    assert (shown.triage_action, shown.triage_analyst, shown.triage_status) == ("escalate", "kim", "recorded")
