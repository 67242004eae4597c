import random
from dataclasses import replace
from datetime import timedelta

import pytest

from palisade.operators import suppress

from palisade.plans.detect import alert_events, run_detections, sort_alerts
from palisade.rules import RULES, per_entity, strict_traversal
from tests.helpers import event, event_frame, raised


def found(spark, rows, rules=RULES):
    return run_detections(event_frame(spark, rows), rules).collect()


def compare(spark, rows, rules=RULES):
    got = sorted((a.alert_id, a.rule_id, a.event_ids, a.evidence) for a in found(spark, rows, rules))
    want = sorted(raised(rows, rules))
    assert got == want
    return want


def test_each_rule_alone(spark):
    def burst(start, n, step, **same):
        return [event(start + k, seconds=10 * start + step * k, **{f: v(k) if callable(v) else v for f, v in same.items()}) for k in range(n)]

    cases = {
        "DET-SSH-001": burst(0, 7, 40, status="failure", user="cook", src_ip="172.16.9.1"),
        "DET-SSH-003": burst(1000, 5, 100, status="failure", user=lambda k: f"hand{k}", src_ip="172.16.9.2"),
        "DET-PS-001": burst(2000, 1, 1, event_type="powershell_execution", command_line="pwsh -w Hidden x"),
        "DET-NET-001": burst(3000, 9, 30, event_type="network_connection", status="deny", dst_ip=lambda k: f"172.17.0.{k}", src_ip="172.16.9.3"),
        "DET-WAF-001": burst(4000, 1, 1, event_type="http_request", message="POST /q body=information_schema.columns"),
        "DET-WIN-001": burst(5000, 2, 1000, event_type="admin_account_change", message="group member Added"),
    }
    rows = [e for part in cases.values() for e in part] + burst(6000, 4, 100, status="failure", src_ip="172.16.9.4", user=None)
    rows += [event(6100, seconds=60_301, src_ip="172.16.9.4", user="bosun")]
    alerts = compare(spark, rows)
    assert {a[1] for a in alerts} == {*cases, "DET-SSH-002"}
    assert [len(a[2]) for a in alerts if a[1] == "DET-SSH-002"] == [5]
    assert len([a for a in alerts if a[1] == "DET-WIN-001"]) == 2


def test_quiet_day(spark):
    rows = [event(k, seconds=900 * k, user=f"hand{k % 4}", src_ip=f"172.16.8.{k % 4}") for k in range(20)]
    assert compare(spark, rows) == []


def test_second_burst_within_a_quarter_of_an_hour_is_held_back(spark):
    rows = [event(k, seconds=start + 20 * k, status="failure") for start in (0, 500, 960) for k in range(5)]
    rows = [e | {"id": f"e{n}", "seq": n} for n, e in enumerate(rows)]
    assert len(compare(spark, rows, RULES[:1])) == 2


@pytest.mark.parametrize("gap", [299, 300, 301, 599, 600, 601, 899, 900, 901])
def test_bounds(spark, gap):
    rows = [event(i, seconds=0, status="failure") for i in range(4)]
    rows += [event(10 + i, seconds=gap, status="failure") for i in range(2)]
    rows += [event(20, seconds=gap, status="success"), event(30, seconds=gap + 900, status="failure")]
    compare(spark, rows)


def test_three_known_sources_then_an_external_one(spark):
    rows = [event(i, src_ip=f"10.0.0.{i}") for i in (1, 2, 3)] + [event(4, src_ip="8.8.8.8"), event(5, src_ip="9.9.9.9")]
    alerts = compare(spark, rows)
    assert [a[1] for a in alerts] == ["DET-AI-001"]
    assert "known=['10.0.0.1', '10.0.0.2', '10.0.0.3']" in alerts[0][3][0]


def test_two_entities_in_one_minute_of_a_rule_without_key(spark):
    rows = [event(i, event_type="http_request", message="GET /x?a=sqlmap", src_ip=f"1.1.1.{i}", asset="web01") for i in range(5)]
    assert len(compare(spark, rows)) == 1
    assert len(compare(spark, rows, per_entity())) == 5


def test_strict_traversal(spark):
    rows = [event(0, event_type="http_request", message="GET /api"), event(1, seconds=3000, event_type="http_request", message="GET /../etc")]
    assert len(compare(spark, rows)) == 2
    assert len(compare(spark, rows, strict_traversal())) == 1


def test_null_and_empty_keys(spark):
    rows = [event(i, status="failure", src_ip=None, user=None if i % 2 else "", asset=None) for i in range(8)]
    rows += [event(20, seconds=30, status="success", src_ip=None, user=None), event(21, seconds=31, status="success", src_ip=None, user="x")]
    compare(spark, rows)


def _random_rows(seed, n, span, offsets, entities):
    r = random.Random(seed)
    kinds = ["ssh_login"] * 5 + ["http_request", "network_connection", "admin_account_change", "powershell_execution"]
    rows = []
    for i in range(n):
        rows.append(event(
            i, seconds=r.randrange(span), event_type=r.choice(kinds), status=r.choice(["failure", "failure", "success"]),
            user=r.choice(["root", "ann", "bob", "cy", "dee", "eve", None, ""]), asset=r.choice([f"h{k}" for k in range(entities)] + [None]),
            src_ip=r.choice(["10.0.0.1", "10.0.0.2", "8.8.8.8", "9.9.9.9", None, ""]),
            dst_ip=f"10.1.0.{r.randrange(10)}", message=r.choice(["GET /a", "created admin", "sqlmap", "x"]),
            command_line=r.choice(["run -enc", "hidden", "run", None]), utc_offset=r.choice(offsets),
        ))
    return rows


@pytest.mark.parametrize("seed,span,offsets,entities", [
    (1, 900, [0], 2), (2, 7200, [0], 3), (3, 90, [0], 2), (4, 7200, [0, 7200, -3600], 3), (5, 1800, [0, 3600, 45296], 2),
    (6, 2400, [0], 60), (7, 40_000, [0, -36000], 3),
])
def test_random_events_with_ties(spark, seed, span, offsets, entities):
    rows = _random_rows(seed, 320, span, offsets, entities)
    assert compare(spark, rows)


def test_many_entities_share_a_minute(spark):
    """More entities per minute than can be held back: rows after the bound are dropped early."""
    r = random.Random(9)
    rows = [event(i, seconds=i * 6, event_type="http_request", message="sqlmap", src_ip=f"1.0.0.{r.randrange(40)}", user=None) for i in range(700)]
    rules = [replace(RULES[6], time_window_minutes=1)]
    compare(spark, rows, rules)


@pytest.mark.parametrize("key", [("dst_ip",), ("process_name",), ("src_ip", "dst_ip"), ("src_ip", "user", "asset", "dst_ip")])
def test_an_entity_is_held_back_across_keys(spark, key):
    scan = next(r for r in RULES if r.rule_id == "DET-NET-001")
    rules = [replace(scan, group_by=key, threshold=1, distinct_field=None), replace(RULES[-1], group_by=key),
             replace(RULES[0], group_by=key, threshold=2)]
    rows = [event(k, seconds=30 * k, event_type="network_connection", dst_ip=f"172.17.0.{k}", process_name=f"p{k}") for k in range(6)]
    assert len(compare(spark, rows, rules[:1])) == 1
    r = random.Random(len(key))
    rows = [e | {"process_name": r.choice("pqr"), "dst_ip": f"172.17.0.{r.randrange(4)}"} for e in _random_rows(31, 300, 5000, [0, 3600], 3)]
    compare(spark, rows, rules)


def test_order_and_long_form(spark):
    rows = _random_rows(11, 200, 3000, [0], 2)
    alerts = sort_alerts(run_detections(event_frame(spark, rows))).collect()
    rank = {"critical": 4, "high": 3, "medium": 2, "low": 1}
    keys = [(rank[a.severity], a.confidence, a.timestamp) for a in alerts]
    assert keys == sorted(keys, reverse=True)
    long = alert_events(run_detections(event_frame(spark, rows)))
    assert long.count() == sum(len(a.event_ids) for a in alerts)


@pytest.mark.parametrize("seed,span,offsets,key,rows_a_slice", [
    (41, 9000, [0], (), 5), (42, 20_000, [0, 7200, -3600], (), 20), (43, 9000, [0, 3600], ("dst_ip",), 9), (44, 40_000, [0], ("src_ip",), 3),
])
def test_slices_agree_with_one_pass(spark, monkeypatch, seed, span, offsets, key, rows_a_slice):
    """Groups cut into many slices, whose states pass on over several rounds."""
    monkeypatch.setattr(suppress, "SLICE_ROWS", rows_a_slice)
    rules = [replace(RULES[-1], group_by=key, regex={}), replace(RULES[0], group_by=key, threshold=1)]
    assert compare(spark, _random_rows(seed, 300, span, offsets, 2), rules)


def test_a_clock_runs_on_over_all_slices(spark, monkeypatch):
    """One entity, a candidate each minute: which rows are emitted is handed on from slice to slice to the end."""
    monkeypatch.setattr(suppress, "SLICE_ROWS", 4)
    rows = [event(k, seconds=60 * k, event_type="http_request", message="sqlmap") for k in range(64)]
    assert len(compare(spark, rows, [RULES[-1]])) == 5


def test_no_task_holds_a_whole_rule(spark, monkeypatch):
    """A rule without a key, and one whose key has no entity field, are folded in slices of few rows."""
    monkeypatch.setattr(suppress, "SLICE_ROWS", 50)
    seen = []
    whole = suppress._folded

    def watched(rows):
        seen.append(max(r["count"] for r in rows.where("state IS NULL").groupBy("group", "slice").count().collect()))
        return whole(rows)

    monkeypatch.setattr(suppress, "_folded", watched)
    rows = [event(k, seconds=20 * k, event_type="http_request", message="sqlmap", src_ip=f"1.0.{k % 40}.1", dst_ip=f"d{k % 5}") for k in range(600)]
    for key in ((), ("dst_ip",)):
        compare(spark, rows, [replace(RULES[-1], group_by=key)])
    # A slice ends with a whole minute, here of three rows.
    assert seen and max(seen) <= 53
