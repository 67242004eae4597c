"""How work is laid out: nothing is gathered, or written in crumbs, that grows with the whole input."""

from datetime import datetime, timedelta
from pathlib import Path

from palisade import queries
from palisade.streaming import incidents
from tests.helpers import alert, alert_frame


def events_folder(spark, path, n):
    kinds = ["error", "view", "click", "purchase", "signup"]
    rows = [(i, datetime(2024, 1, 1) + timedelta(minutes=3 * i), i % 150, kinds[i % 5], float(i % 90), f'{{"k": {i % 100}}}') for i in range(n)]
    spark.createDataFrame(rows, "event_id long, ts timestamp_ntz, user_id long, event_type string, value double, props string").write.parquet(f"{path}/events.parquet")
    return str(path)


def test_metrics_gather_no_list_of_an_incident(spark, tmp_path, monkeypatch):
    plans, whole = {}, queries.stage

    def watched(df, name):
        plans[name] = df._jdf.queryExecution().optimizedPlan().toString()
        return whole(df, name)

    monkeypatch.setattr(queries, "stage", watched)
    [row] = queries.metrics_chain(spark, events_folder(spark, tmp_path, 900)).collect()
    assert row.total_alerts and row.open_incidents and row.priorities
    assert " AS lines#" not in plans["incidents"] and "collect_set" not in plans["incidents"]


def test_a_batch_writes_few_files_a_day(spark, tmp_path):
    rows = [alert(i, minutes=40 * i, asset=f"h{i % 3}") for i in range(200)]
    incidents.add_alerts(alert_frame(spark, rows).repartition(8), f"{tmp_path}/alerts", f"{tmp_path}/members", 0)
    for day in Path(f"{tmp_path}/alerts").glob("day=*/batch=0"):
        assert len(list(day.glob("*.parquet"))) == 1
    assert incidents.read_alerts(spark, f"{tmp_path}/alerts").count() == 200
