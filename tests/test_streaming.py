"""Streams in several micro-batches give what a batch over the same rows gives."""

import json
import random
from dataclasses import replace
from types import SimpleNamespace

import pandas as pd
import pytest
from pyspark.sql import functions as F

from palisade.plans.anomaly import new_process_hits
from palisade.plans.detect import rare_source_alerts, timed, triggers_of
from palisade.rules import RULES
from palisade.schema import ALERT_SCHEMA, EVENT_SCHEMA
from palisade.sources.normalize import parse_lines, valid_events
from palisade.sources.lines import read_log_lines, stream_log_lines
from palisade.sources.store import read_store
from palisade.streaming import incidents, ingest, rules as stream_rules
from palisade.streaming.ordered import OrderedProcessor
from palisade.streaming.rules import new_processes, rare_sources, rule_triggers
from tests.helpers import alert, alert_frame, event, event_frame, groups
from tests.test_detect import _random_rows

FLUSH = dict(event_type="none", user=None, src_ip=None, status="x")


def split(spark, rows, path, parts, frame=event_frame):
    """Files by time, out of order within each, a later one per micro-batch."""
    rows = sorted(rows, key=lambda e: e["timestamp"])
    size = -(-len(rows) // parts)
    for i in range(parts):
        part = rows[i * size:(i + 1) * size]
        random.Random(i).shuffle(part)
        frame(spark, part).coalesce(1).write.mode("append").parquet(f"{path}/part={i}")


def stream(spark, path, parts, schema=EVENT_SCHEMA):
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(*[f"{path}/part=*"])


@pytest.fixture(scope="module")
def rows():
    found = _random_rows(21, 320, 700, [0, 36000], 3)
    for e in found:
        e["process_name"] = random.Random(e["seq"]).choice(["a", "B", "c", None])
    return [*found, event(9999, seconds=90_000, **FLUSH)]


@pytest.fixture(scope="module")
def source(spark, rows, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("events"))
    split(spark, rows, path, 3)
    return lambda: stream(spark, path, 3).withWatermark("timestamp", "0 seconds")


def test_rule_triggers(spark, rows, source):
    live = ingest.to_table(rule_triggers(source()), "triggers")
    got = sorted((r.rule, r.us, r.id) for r in live.collect())
    want = sorted((r.rule, r.t_us, r.t_id) for r in triggers_of(event_frame(spark, rows)).collect())
    assert got == want and {r[0] for r in got} >= {0, 1, 2, 3, 5, 6, len(RULES) + 1}


def test_triggers_of_keys_that_share_entities(spark, rows, source):
    rules = [replace(RULES[0], group_by=("dst_ip",), threshold=2), replace(RULES[-1], group_by=("src_ip", "process_name"))]
    live = ingest.to_table(rule_triggers(source(), rules, False), "crossing")
    got = sorted((r.rule, r.us, r.id) for r in live.collect())
    assert got == sorted((r.rule, r.t_us, r.t_id) for r in triggers_of(event_frame(spark, rows), rules, False).collect()) and got


def test_first_seen(spark, rows, source):
    live = ingest.to_table(rare_sources(source(), 2), "rare").collect()
    batch = rare_source_alerts(timed(event_frame(spark, rows)), 0, 2).collect()
    assert sorted((r.user, r.src_ip) for r in live) == sorted((r.user, r.src_ip) for r in batch) and live
    live = ingest.to_table(new_processes(source()), "processes").collect()
    batch = new_process_hits(event_frame(spark, rows)).collect()
    assert sorted((r.entity, r.proc, r.id) for r in live) == sorted((r.entity, r.proc, r.id) for r in batch) and live


def test_lines_into_the_store(spark, tmp_path):
    line = "Oct  2 06:30:{:02d} quay sshd[9]: Failed password for invalid user bo from 172.20.1.1 port 9 ssh2"
    (tmp_path / "logs").mkdir()
    for n in range(3):
        text = "\n".join([line.format(n), line.format(n), "{bad json", "odd"])
        (tmp_path / "logs" / f"{n}.log").write_text(text)
    folder, options = str(tmp_path / "logs"), dict(reference_year=2026)
    for turn in range(2):
        lines = stream_log_lines(spark, folder, max_files=1)
        q = ingest.ingest_lines(lines, str(tmp_path / "store"), str(tmp_path / "bad"), str(tmp_path / f"checkpoint{turn}"), **options)
        q.awaitTermination()
    stored = read_store(spark, str(tmp_path / "store"))
    batch = valid_events(parse_lines(read_log_lines(spark, folder), **options))
    assert stored.count() == 9 and {r.id for r in stored.select("id").collect()} == {r.id for r in batch.select("id").collect()}
    assert spark.read.parquet(str(tmp_path / "bad")).count() == 3


def test_incidents_grow_over_batches(spark, tmp_path):
    r = random.Random(5)
    rows = [alert(i, minutes=r.randrange(1500), asset=f"h{r.randrange(12)}", user=f"u{r.randrange(30)}",
                  src_ip=f"10.0.0.{r.randrange(30)}", tactic=f"T{r.randrange(8)}") for i in range(90)]
    shuffled = rows[:]
    r.shuffle(shuffled)
    path, target = str(tmp_path / "in"), str(tmp_path / "out")
    for i in range(3):
        alert_frame(spark, shuffled[i::3]).coalesce(1).write.mode("append").parquet(f"{path}/part={i}")
    q = incidents.follow_incidents(stream(spark, path, 3, ALERT_SCHEMA), f"{target}/alerts", f"{target}/members", f"{target}/checkpoint")
    q.awaitTermination()
    got = {}
    for m in incidents.current_members(spark, f"{target}/members").collect():
        got.setdefault(m.component, set()).add(m.alert_id)
    assert {frozenset(g) for g in got.values()} == groups(rows)
    assert incidents.read_alerts(spark, f"{target}/alerts").count() == 90


def test_state_of_a_rule_stays_small_within_a_batch():
    """A source whose failures raise an alert a minute for a month: minutes and clocks that have run out are not kept, nor are old values."""
    processor = stream_rules.RuleProcessor([(86_400_000_000, 2, False, False, True), (300_000_000, 1, True, False, True)])
    for number in (0, 1):
        state = processor.load({})
        largest = found = 0
        for k in range(30_000):
            body = {"rule": number, "lane": "", "value": f"v{k}", "minute": k, "entity": f"e{k % 100}"}
            found += processor.step(state, k * 60_000_000, body) is not None
            largest = max(largest, len(state["minutes"]) + len(state["clocks"]) + len(state["times"][""]))
        assert found == 30_000 - 1 + number and largest < 2 * stream_rules.KEPT
        again = processor.load(json.loads(json.dumps(processor.dump(state))))
        assert again["minutes"] == state["minutes"] and again["times"] == state["times"]


class _Calls:
    """State of one key that counts the entries it is given."""

    def __init__(self):
        self.entries, self.value, self.timers, self.seen = [], None, [], 0

    def getListState(self, name, schema):
        return self

    def getValueState(self, name, schema):
        return SimpleNamespace(exists=lambda: self.value is not None, get=lambda: self.value, update=lambda v: setattr(self, "value", v))

    def exists(self):
        return bool(self.entries)

    def get(self):
        return iter(self.entries)

    def appendList(self, rows):
        self.seen += len(rows)
        self.entries += rows

    def put(self, rows):
        self.entries = rows

    def clear(self):
        self.entries = []

    def registerTimer(self, at):
        self.timers.append(at)


class _Numbers(OrderedProcessor):
    def step(self, state, us, body):
        state["n"] = state.get("n", 0) + 1
        return {"n": state["n"], "v": body["v"]}


def test_rows_that_wait_are_few_entries_of_state():
    handle, processor = _Calls(), _Numbers()
    processor.init(handle)
    times = [(i * 7) % 2000 for i in range(2000)]
    chunks = [pd.DataFrame({"us": [t * 1000 for t in part], "seq": part, "id": [f"e{t}" for t in part], "body": [json.dumps({"v": t}) for t in part]})
              for part in (times[:1200], times[1200:])]
    assert list(processor.handleInputRows(("k",), iter(chunks), None)) == [] and handle.timers == [0]
    assert handle.seen == 2
    out = []
    for at in (999, 5000):
        out += [pdf for pdf in processor.handleExpiredTimer(("k",), SimpleNamespace(getCurrentWatermarkInMs=lambda: at), None)]
        assert len(handle.entries) <= 1
    rows = pd.concat(out)
    assert rows["us"].tolist() == [t * 1000 for t in range(2000)] and rows["id"].tolist() == [f"e{t}" for t in range(2000)]
    assert [json.loads(r) for r in rows["result"]] == [{"n": t + 1, "v": t} for t in range(2000)]
    assert handle.timers == [0, 1000] and handle.entries == []
