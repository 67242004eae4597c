"""How often plans read their input, and the risk scores of groups."""

import hashlib

from pyspark.sql import functions as F

from palisade.operators import digest
from palisade.plans import anomaly, classify, correlate, detect, report
from palisade.rules import RULES
from palisade.schema import as_events

from tests.helpers import alert, alert_frame, event, event_frame


def test_detections_and_anomalies_read_few_times(spark, tmp_path, monkeypatch):
    """Everything the two plans write or return, and the scans of the event table in it."""
    path = str(tmp_path / "events")
    as_events(spark.sql("SELECT concat('e', id) AS id, timestamp_seconds(id * 7) AS timestamp, 'ssh_login' AS event_type, 'web' AS asset, "
                        "concat('u', id % 3) AS user, concat('8.8.8.', id % 9) AS src_ip, if(id % 2 = 0, 'failure', 'success') AS status, "
                        "id AS seq FROM range(200)")).write.parquet(path)
    events, written = spark.read.parquet(path), []
    for module in (detect, anomaly):
        own = module.stage

        def noted(df, name, own=own):
            written.append(df)
            return own(df, name)

        monkeypatch.setattr(module, "stage", noted)

    def scans(df):
        """Scans of the event table in the plan before any reuse; of the written tables only one has events, with ``hits``."""
        lines = df._jdf.queryExecution().optimizedPlan().treeString().split("\n")
        return sum("Relation [" in line and "event_date#" in line and "hits#" not in line for line in lines)

    for plan, most in ((detect.run_detections, 1), (anomaly.detect_anomalies, 3)):
        written.clear()
        result = plan(events)
        assert 1 <= sum(map(scans, [*written, result])) <= most


def test_risk_by_group_adds_alerts_and_open_incidents(spark):
    alerts = spark.createDataFrame([("a", "high"), ("a", "odd"), ("b", "critical"), (None, "low")], "asset string, severity string")
    incidents = spark.createDataFrame([("a", "P3", "open"), ("a", "P1", "closed"), ("b", "P1", "open"), ("b", "P1", "open"), ("b", "P1", "open"),
                                       ("b", "P1", "open"), ("c", "P2", "open")], "asset string, priority string, status string")
    found = {r.asset: (r.points, r.risk_score) for r in report.risk_by(alerts, incidents, "asset").collect()}
    assert found == {"a": (19, 19), "b": (120, 100), "c": (14, 14), None: (2, 2)}
    assert report.risk_by(alerts.limit(0), incidents.limit(0), "asset").count() == 0


def test_older_risk_by_group(spark):
    alerts = spark.createDataFrame([("s", "High", "Execution"), ("s", "Medium", "Discovery"), ("t", "Critical", "Credential Access"),
                                    ("t", "Critical", "Credential Access"), ("t", "High", "Persistence")], "source string, severity string, tactic string")
    found = {r.source: (r.points, r.risk_score) for r in classify.older_risk_by(alerts, "source").collect()}
    assert found == {"s": (49, 49), "t": (103, 100)}


def test_members_of_alerts_agree_with_their_lists(spark):
    rows = [event(i, i * 10, status="failure", user=f"u{i % 2}", src_ip="9.9.9.9") for i in range(8)]
    rows.append(event(8, 90, user="u1", src_ip="9.9.9.9"))
    events = event_frame(spark, rows)
    lists = detect.run_detections(events, RULES, rare_source=False, off_hours=False)
    want = sorted((r.rule_id, e) for r in lists.collect() for e in r.event_ids)
    got = sorted((r.rule_id, r.event_id) for r in detect.alert_members(events, RULES).collect())
    assert got == want and {r for r, _ in got} == {"DET-SSH-001", "DET-SSH-002"}


def test_ids_without_lists(spark):
    """The running hash gives the ids that the lists give, over several batches of one group too."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "7")
    try:
        rows = [event(i, i * 3, status="failure", user=f"u{i % 7}", src_ip="9.9.9.9") for i in range(60)] + [event(61, 200, user="u1", src_ip="9.9.9.9")]
        events = event_frame(spark, rows)
        want = sorted((r.rule_id, r.alert_id, len(r.event_ids)) for r in detect.run_detections(events, RULES, False, False).collect())
        assert sorted((r.rule_id, r.alert_id, r.n_events) for r in detect.alert_ids(events, RULES).collect()) == want and len(want) >= 3
        alerts = alert_frame(spark, [alert(i, minutes=i * 20, user=f"é{i % 3}", asset=None) for i in range(40)])
        members = correlate.incident_members(alerts)
        want = sorted((r.incident_id, len(r.related_alert_ids)) for r in correlate.roll_up(members).collect())
        assert sorted((r.incident_id, r.n_alerts) for r in correlate.incident_ids(members).collect()) == want
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")


def test_a_million_rows_of_one_group(spark):
    rows = spark.range(1_000_000).select(F.lit("g").alias("g"), F.col("id").cast("string").alias("t"), F.col("id"))
    got = digest.joined_sha256(rows.repartition(16), F.col("g"), [F.col("id")], F.col("t")).collect()
    want = hashlib.sha256("|".join(map(str, range(1_000_000))).encode()).hexdigest()
    assert [tuple(r) for r in got] == [("g", want, 1_000_000)]
