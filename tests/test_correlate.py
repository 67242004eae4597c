import random

import pytest

from palisade.operators.components import connected_components
from palisade.plans.correlate import correlate, incident_members, incident_priorities
from palisade.plans.report import filter_alerts, filter_incidents
from tests.helpers import alert, alert_frame, groups


def members(spark, rows):
    out = {}
    for r in incident_members(alert_frame(spark, rows)).collect():
        out.setdefault(r.component, set()).add(r.alert_id)
    return {frozenset(g) for g in out.values()}


def test_related_alerts_become_one_incident(spark):
    rows = correlate(alert_frame(spark, [alert(1), alert(2)])).collect()
    assert len(rows) == 1 and set(rows[0].related_alert_ids) == {"A0001", "A0002"}
    assert rows[0].status == "open" and rows[0].owner == "unassigned" and rows[0].priority == "P2"


def test_unrelated_alerts_stay_apart(spark):
    other = dict(asset="x", user="y", src_ip="9.9.9.9", tactic="Discovery")
    frame = correlate(alert_frame(spark, [alert(1), alert(2, minutes=90, **other)]))
    assert frame.count() == 2
    assert filter_incidents(frame, status="open", priority="P1").count() == 0
    assert filter_alerts(alert_frame(spark, [alert(1), alert(2, severity="low")]), severity="low", tactic="").count() == 1


def test_thirty_minutes_inclusive_and_empty_values(spark):
    rows = [alert(1, minutes=0), alert(2, minutes=30), alert(3, minutes=61)]
    assert members(spark, rows) == {frozenset({"A0001", "A0002"}), frozenset({"A0003"})}
    apart = [alert(i, minutes=i, asset="", user=None, src_ip="", tactic=f"T{i}") for i in range(3)]
    assert len(members(spark, apart)) == 3
    null_tactic = [alert(i, minutes=i, asset="", user=None, src_ip="", tactic=None) for i in range(3)]
    assert len(members(spark, null_tactic)) == 1


def test_first_copy_of_an_alert_id_counts(spark):
    rows = [alert(1, minutes=5, asset="late"), alert(1, minutes=1, asset="early")]
    one = correlate(alert_frame(spark, rows)).first()
    assert one.related_alert_ids == ["A0001"] and one.related_assets == ["early"]


@pytest.mark.parametrize("seed,n,span", [(1, 150, 3000), (2, 150, 900)])
def test_random_alerts(spark, seed, n, span):
    r = random.Random(seed)
    rows = [
        alert(i, minutes=r.randrange(span), asset=r.choice([f"h{k}" for k in range(30)] + [None, ""]),
              user=r.choice([f"u{k}" for k in range(30)] + [None]), src_ip=f"10.0.0.{r.randrange(40)}",
              tactic=f"T{r.randrange(9)}", severity=r.choice(["critical", "high", "medium", "low", "odd"]))
        for i in range(n)
    ]
    assert members(spark, rows) == groups(rows)
    placed = incident_members(alert_frame(spark, rows))
    assert sum(p.n_alerts for p in incident_priorities(placed).collect()) == n


def test_components_of_paths_stars_and_single_nodes(spark):
    edges = [(f"p{i:03d}", f"p{i + 1:03d}") for i in range(60)] + [("hub", f"s{i}") for i in range(50)] + [("alone", "alone")]
    random.Random(3).shuffle(edges)
    rows = connected_components(spark.createDataFrame(edges, "a string, b string")).collect()
    got = {}
    for r in rows:
        got.setdefault(r.component, set()).add(r.node)
    assert {k: len(v) for k, v in got.items()} == {"p000": 61, "hub": 51, "alone": 1}
    assert len(rows) == len({r.node for r in rows})
