"""Lists of look-back windows: what is shuffled for them, and what they hold."""

import random
from dataclasses import replace

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from palisade import queries
from palisade.operators import lookback, ranges
from palisade.plans import detect
from palisade.plans.detect import alert_ids, alert_members, run_detections, sort_alerts
from palisade.rules import RULES
from palisade.session import stage
from tests.helpers import event, event_frame, hashed, us
from tests.test_detect import _random_rows

DAY = 24 * 60


def test_lists_are_made_of_rows_and_not_of_pairs(spark, monkeypatch):
    """One source, a failure a minute from users of their own: each alert's list holds all failures so far."""
    seen = []
    whole = lookback._ordered

    def watched(rows, window):
        out = whole(rows, window)
        seen.append(out.count())
        return out

    monkeypatch.setattr(lookback, "_ordered", watched)
    rows = [event(k, seconds=61 * k, status="failure", user=f"u{k}") for k in range(300)]
    rules = [replace(RULES[0], time_window_minutes=DAY, threshold=2)]
    found = alert_ids(event_frame(spark, rows), rules).collect()
    assert sum(r.n_events for r in found) == 300 * 301 // 2 - 1
    alerts = run_detections(event_frame(spark, rows), rules, False, False)
    assert {r.alert_id for r in found} == {r.alert_id for r in alerts.collect()}
    assert max(seen) <= 3 * 300


def test_lanes_are_cut_and_busy_slices_agree(spark, monkeypatch):
    monkeypatch.setattr(lookback, "LEAST_KEPT", 3)
    monkeypatch.setattr(lookback, "BATCH_IDS", 5)
    rows = _random_rows(71, 300, 9000, [0, 3600], 3)
    rules = [replace(r, threshold=min(r.threshold, 2)) for r in RULES]
    lists = {(a.rule_id, a.event_ids[-1], a.alert_id): len(a.event_ids) for a in run_detections(event_frame(spark, rows), rules, False, False).collect()}
    assert {(r.rule_id, r.trigger_id, r.alert_id): r.n_events for r in alert_ids(event_frame(spark, rows), rules).collect()} == lists


def test_a_success_that_comes_twice(spark):
    """It counts what is before it twice, as a join of the two would."""
    rows = [event(k, seconds=k, status="failure", user=None if k % 2 else "nadia") for k in range(6)]
    rows += [event(9, seconds=20)] * 2
    [alert] = run_detections(event_frame(spark, rows), RULES[1:2], False, False).collect()
    want = [i for k in (0, 2, 4, 1, 3, 5) for i in [f"e{k:05d}"] * 2] + ["e00009"] * 2
    assert alert.event_ids == want and alert.alert_id == hashed("DET-SSH-002", *want) and len(alert.evidence) == 10
    [found] = alert_ids(event_frame(spark, rows), RULES[1:2]).collect()
    assert (found.alert_id, found.n_events) == (alert.alert_id, 14)


def test_a_sorted_report_shuffles_and_writes_no_lists(spark, monkeypatch):
    written = []

    def watched(df, name):
        written.extend(df.columns)
        return stage(df, name)

    monkeypatch.setattr(detect, "stage", watched)
    monkeypatch.setattr(queries, "stage", watched)
    events = event_frame(spark, [*_random_rows(5, 250, 20_000, [0, 3600], 4), *[event(900 + k, seconds=40 * k, status="failure", user=f"u{k}") for k in range(60)]])
    monkeypatch.setattr(queries, "security_events", lambda spark, folder: events)
    found = queries.REGISTRY["alerts_all_rules"](spark, "")
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert plan.index("MapInArrow") < plan.index("Exchange") and plan.count("MapInArrow") == 1
    assert not {"event_ids", "evidence"} & set(written)
    right = queries._flat_alerts(sort_alerts(run_detections(events, queries.ALL_DEMO))).collect()
    assert len(right) > 20 and len({r.rule_id for r in right}) > 4
    assert found.collect() == right


def test_reports_of_any_rules_are_sorted_alike(spark):
    rules = [replace(RULES[0], time_window_minutes=DAY, threshold=2), replace(RULES[1], threshold=1, time_window_minutes=3 * DAY), *RULES[2:]]
    events = event_frame(spark, [event(k, seconds=1171 * k, status="failure" if k % 3 else "success", user=f"u{k % 4}" if k % 5 else None) for k in range(300)])
    for some in (rules, [replace(r, confidence=0.5, severity="low") for r in rules[:3]]):
        right = sort_alerts(run_detections(events, some)).collect()
        assert len(right) > 20 and detect.sorted_detections(events, some).collect() == right


def _members_by_lists(alerts):
    """Rule and event of each entry of the lists, and how often each alert's list holds what."""
    return sorted((a.rule_id, i or "") for a in alerts for i in a.event_ids)


def test_member_rows_compare_no_rows_in_pairs(spark):
    """A join on key and time cell looks at all rows of two windows for each alert."""
    rows = [event(k, seconds=61 * k, status="failure", user=f"u{k}") for k in range(300)]
    rules = [replace(RULES[0], time_window_minutes=60, threshold=2)]
    found = alert_members(event_frame(spark, rows), rules, timed=False)
    assert "Join" not in found._jdf.queryExecution().executedPlan().toString()
    assert found.columns == ["rule_id", "trigger_id", "event_id"]
    # An hour holds the row itself and the 59 before it.
    want = [(f"e{k:05d}", f"e{j:05d}") for k in range(1, 300) for j in range(max(0, k - 59), k + 1)]
    assert sorted((r.trigger_id, r.event_id) for r in found.collect()) == want


def test_member_rows_agree_with_lists(spark):
    rows = _random_rows(72, 400, 9000, [0, 3600], 3)
    rows += [event(900 + k, seconds=40 * k, status="failure", user=None if k % 3 else "nadia") for k in range(40)]
    rows += [event(990, seconds=1700), event(990, seconds=1700), *rows[-3:]]
    rules = [replace(r, threshold=min(r.threshold, 2)) for r in RULES]
    alerts = run_detections(event_frame(spark, rows), rules, False, False).collect()
    found = alert_members(event_frame(spark, rows), rules).collect()
    assert sorted((r.rule_id, r.event_id) for r in found) == sorted((a.rule_id, i) for a in alerts for i in a.event_ids)
    times = {(r["id"], r["seq"]): us(r["timestamp"]) for r in rows}
    assert all(times[r.event_id, r.seq] == r.us for r in found)


def _marked(seed, n):
    """Sorted rows and marks of two groups, as ``lookback`` passes through them."""
    rng, rows = random.Random(seed), []
    for group in ("g0", "g1"):
        some = sorted((rng.randrange(60), rng.randrange(3), rng.random() < 0.4) for _ in range(n))
        for at, seq, mark in some:
            lane = rng.choice("abc")
            rows.append({"group": group, "us": at, "seq": seq, "id": f"i{len(rows)}" if rng.random() < 0.9 else None, "mark": mark, "rule": 0,
                         "lane": lane, "lane2": rng.choice(["a", None]) if mark and lane != "a" else None, "g1": None if mark else {"a": 2, "b": 2, "c": None}[lane],
                         "g2": None if mark else 0, "times": rng.choice([1, 1, 2]) if mark else None, "ends": rng.random() < 0.5 if mark else None,
                         "asset": f"x{len(rows)}", "user": None, "src_ip": "s", "utc_offset": seq, "ev": f"line {len(rows)}"})
    types = {"bigint": pa.int64(), "int": pa.int32(), "string": pa.string(), "boolean": pa.bool_()}
    schema = pa.schema([("group", pa.string()), *[(name, types[t]) for name, t in lookback.ROW.items()]])
    return [pa.RecordBatch.from_pylist(rows[a : a + 11], schema=schema) for a in range(0, len(rows), 11)]


def _walked(batches):
    """What the pass row by row makes of them."""
    step = lookback._pass({0: 9}, 3, lambda rule, ids, last, head: (ids, last, *head), lookback.LISTS)
    return [r for b in step(iter(batches)) for r in b.to_pylist()]


def test_lists_in_pieces_agree_with_a_walk(monkeypatch):
    for seed, least, entries in ((1, 1, 3), (2, 70, 50), (3, 50_000, 200_000)):
        monkeypatch.setattr(ranges, "LEAST_ROWS", least)
        monkeypatch.setattr(ranges, "BATCH_ENTRIES", entries)
        monkeypatch.setattr(ranges, "PACKED", seed + 1)
        batches = _marked(seed, 150)
        want = [(r["t_id"], i) for r in _walked(batches) for i in r["event_ids"]]
        found = [b for b in lookback._members({0: 9}, ["id"])(iter(batches))]
        assert [(r["t_id"], i) for b in found for r in b.to_pylist() for i in r["id"]] == want and len(want) > 300
        assert max(sum(map(len, b.column("id").to_pylist())) for b in found) <= entries
        # The same in the order of a report: within a group the latest first.
        where = {r["id"]: r["group"] for b in batches for r in b.to_pylist() if r["id"]}
        given = {r["id"] for b in batches for r in b.to_pylist() if r["mark"] and r["id"]}
        lists = [r for b in lookback._lists_in_order({0: 9}, 3)(iter(batches)) for r in b.to_pylist()]
        assert sorted(map(repr, lists)) == sorted(map(repr, _walked(batches)))
        named = [r for r in lists if r["t_id"] in given]
        places = [(where[r["t_id"]], -r["t_us"], r["t_seq"]) for r in named]
        assert places == sorted(places) and len(places) > 80


def test_a_sorted_report_sorts_no_lists_and_copies_no_texts(spark, monkeypatch):
    """Two failures now and then, looked back at for days: lines and entities stay where rows are, but for the last before a span."""
    seen = []
    whole = lookback._lists_in_order
    monkeypatch.setattr(lookback, "_lists_in_order", lambda *given: seen.append(given) or whole(*given))
    rows = [event(k, seconds=600 * k, status="failure", user=f"u{k}") for k in range(400)]
    rules = [replace(RULES[0], time_window_minutes=2 * DAY, threshold=2)]
    found = detect.sorted_detections(event_frame(spark, rows), rules)
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert plan.index("MapInArrow") < plan.index("Sort") and len(seen) == 1
    right = sort_alerts(run_detections(event_frame(spark, rows), rules)).collect()
    assert found.collect() == right and max(len(r.event_ids) for r in right) > 280
    copies = found.sparkSession.createDataFrame([(r["seq"], True) for r in rows], "seq bigint, own boolean")
    marked = detect._as_rows(copies.select(F.col("seq"), (F.col("seq") * 600_000_000).alias("us"), F.col("seq").cast("string").alias("id")), group=F.lit("g"),
                             rule=F.lit(0), mark=F.lit(False), lane=F.lit("a"), times=F.lit(1), ends=F.lit(False), ev=F.lit("line"), asset=F.lit("x"))
    late = lookback.with_latest(marked, F.lit(12 * 3_600_000_000), 10)
    # 72 rows to a span, of which ten are shown in later ones.
    assert late.where("late").count() == 10 * (400 // 72) + 10


def _table(rows, groups):
    """A table of whole groups of ``us, mark, lane, lane2, g1``."""
    columns = {"group": groups, "rule": [0] * len(rows), "g2": [0] * len(rows), "times": [1] * len(rows), "ends": [False] * len(rows)}
    columns |= {name: [r[n] for r in rows] for n, name in enumerate(("us", "mark", "lane", "lane2", "g1"))}
    return pa.table({n: pa.array(v, pa.string() if n in ("lane", "lane2") else None) for n, v in columns.items()})


def test_runs_of_row_numbers():
    rows = [(1, False, "a", None, 5), (2, False, "b", None, 5), (3, False, "a", None, 5), (3, True, "a", "b", None), (4, False, "c", None, 1),
            (9, True, "c", "a", None), (9, True, None, None, None), (1, False, "a", None, 7), (1, True, "a", "b", None), (2, True, "b", None, None)]
    found = ranges.Ranges(_table(rows, [0] * 7 + [1] * 3), {0: 6})
    assert found.n.tolist() == [3, 2, 0, 1, 0]
    # Lanes of one order are merged by row; else the first order comes first, whichever lane is named first.
    assert found.entries(np.arange(5)).tolist() == [0, 1, 2, 4, 2, 7]
    assert found.head.tolist() == [2, 5, 6, 7, 9]


def test_whole_groups_of_any_batches(monkeypatch):
    rng = random.Random(5)
    groups = sorted(f"g{rng.randrange(40):02d}" for _ in range(500))
    ids = [None if n % 17 == 0 else f"i{n if n > 250 else n % 3}" for n in range(500)]
    monkeypatch.setattr(ranges, "LEAST_ROWS", 30)
    for size in (1, 7, 64, 500):
        batches = [pa.RecordBatch.from_pydict({"group": groups[a : a + size], "id": pa.array(ids[a : a + size], pa.string())}) for a in range(0, 500, size)]
        tables = list(ranges.whole_groups(iter([*batches, batches[0].slice(0, 0)]), ["id"]))
        assert [i for t in tables for i in t.column("id").cast(pa.large_string()).to_pylist()] == ids
        number = {g: n for n, g in enumerate(dict.fromkeys(groups))}
        assert [g for t in tables for g in t.column("group").to_pylist()] == [number[g] for g in groups]
        seen = [set(t.column("group").to_pylist()) for t in tables]
        assert sum(map(len, seen)) == len(number) and (len(tables) > 5 or size == 500)
