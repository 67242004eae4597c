"""Alert rows from micro-batches, incidents from them, and repairs after late events: all equal to a batch."""

import random
from dataclasses import replace
from datetime import timezone

from palisade.plans.detect import run_detections
from palisade.rules import RULES
from palisade.sources.store import read_store
from palisade.streaming import alerts as live, incidents, ingest
from palisade.schema import EVENT_SCHEMA
from tests.helpers import event, event_frame, groups
from tests.test_detect import _random_rows
from tests.test_streaming import FLUSH

FIELDS = ["alert_id", "rule_id", "event_ids", "evidence", "asset", "user", "src_ip", "timestamp", "emit_us", "emit_seq", "emit_rule"]


def content(alerts):
    return sorted(map(tuple, alerts.select(*FIELDS).collect()), key=str)


class Feed:
    """Parts of events into a store one after the other, each followed by a run of the rules."""

    def __init__(self, spark, folder, rules, delay):
        self.spark, self.folder, self.rules, self.delay = spark, str(folder), rules, delay
        self.parts = 0

    def path(self, name):
        return f"{self.folder}/{name}"

    def add(self, rows):
        event_frame(self.spark, rows).coalesce(1).write.parquet(self.path(f"in/part={self.parts}"))
        self.parts += 1
        events = self.spark.readStream.schema(EVENT_SCHEMA).parquet(self.path("in/part=*"))
        ingest.ingest_events(events, self.path("store"), self.path("ingest"), late=self.path("late"), delay=self.delay).awaitTermination()
        query = live.follow_alerts(self.spark, self.path("store"), self.path("alerts"), self.path("rules"), self.rules, self.delay)
        query.awaitTermination()
        self.upto = live.watermark_us(query)

    def batch(self, upto=None):
        """What a batch over the stored events raises."""
        found = run_detections(read_store(self.spark, self.path("store")), self.rules)
        return content(found if upto is None else found.where(f"emit_us <= {upto}"))

    def repair(self):
        return live.repair_alerts(self.spark, self.path("store"), self.path("alerts"), self.path("late"), self.path("corrections"), self.upto, self.rules)

    def published(self):
        return content(live.published_alerts(self.spark, self.path("alerts"), self.path("corrections")))


def timeline(seed, n, span, offsets=(0,), entities=3):
    return sorted(_random_rows(seed, n, span, list(offsets), entities), key=lambda e: (e["timestamp"], e["seq"]))


def test_three_micro_batches_equal_one_batch(spark, tmp_path):
    rows = timeline(51, 300, 1500, (0, 36000))
    feed = Feed(spark, tmp_path, RULES, "0 seconds")
    grow = lambda: incidents.follow_incidents(
        live.stream_alerts(spark, feed.path("alerts")), feed.path("grown/alerts"), feed.path("grown/members"), feed.path("grown/checkpoint"))
    for part in (rows[:100], rows[100:200], [*rows[200:], event(9999, seconds=90_000, **FLUSH)]):
        feed.add(part)
        grow().awaitTermination()
    assert feed.published() == feed.batch() != []
    assert {a[1] for a in feed.published()} >= {"DET-SSH-001", "DET-SSH-002", "DET-SSH-003", "DET-PS-001", "DET-WIN-001", "DET-WAF-001", "DET-AI-002"}
    members = {}
    for m in incidents.current_members(spark, feed.path("grown/members")).collect():
        members.setdefault(m.component, set()).add(m.alert_id)
    alerts = [r.asDict() for r in live.published_alerts(spark, feed.path("alerts")).collect()]
    for a in alerts:
        a["timestamp"] = a["timestamp"].replace(tzinfo=timezone.utc)
    assert {frozenset(g) for g in members.values()} == groups(alerts)


def test_late_events_are_counted_and_repaired(spark, tmp_path):
    """Some rows of the first part come with the second; one rule has keys that share entities, others none."""
    rules = [replace(r, group_by=("dst_ip",), threshold=1, distinct_field=None) if r.rule_id == "DET-NET-001" else r for r in RULES]
    rows = timeline(61, 300, 6000, (0, 36000))
    chosen = random.Random(61).sample(range(60, 200), 25)
    late, rest = [rows[i] for i in chosen], [e for i, e in enumerate(rows) if i not in set(chosen)]
    feed = Feed(spark, tmp_path, rules, "0 seconds")
    feed.add(rest[:200])
    assert feed.repair() == (0, 0)
    feed.add(late + rest[200:])
    bound = max(e["timestamp"] for e in rest[:200])
    counts = {r.batch: r.n for r in ingest.late_counts(spark, feed.path("late")).collect()}
    assert counts == {0: 0, 1: sum(e["timestamp"] < bound for e in late)}
    assert feed.published() != feed.batch(feed.upto)
    added, taken = feed.repair()
    assert added and taken
    assert feed.published() == feed.batch(feed.upto)
    # The rules go on without the late events; the next repair looks at what they published since.
    feed.add([event(9999, seconds=90_000, **FLUSH)])
    feed.repair()
    assert feed.published() == feed.batch()
    assert feed.repair() == (0, 0)


def test_late_login_changes_the_rare_source_and_a_batch_may_run_again(spark, tmp_path):
    known = [event(10 * u + i, seconds=60 * i, user=f"cook{u}", src_ip=f"10.0.0.{i}") for u in (2, 3) for i in (1, 2, 3)]
    feed = Feed(spark, tmp_path, RULES, "0 seconds")
    feed.add([*known, *[event(40 + u, seconds=600, user=f"cook{u}", src_ip="8.8.8.8") for u in (2, 3)], event(50, seconds=2000, **FLUSH)])
    before = feed.published()
    assert [a[1] for a in before] == ["DET-AI-001"] * 2
    # A checkpoint of its own starts again at batch 0 and writes over it.
    live.follow_alerts(spark, feed.path("store"), feed.path("alerts"), feed.path("rules-again"), RULES, "0 seconds").awaitTermination()
    assert feed.published() == before
    # Another external source before that alert, and one more known source: an alert goes, one comes, one tells more.
    late = [event(60, seconds=400, user="cook2", src_ip="9.9.9.9"), event(61, seconds=401, user="cook3", src_ip="10.0.0.9")]
    feed.add([*late, event(70, seconds=4000, **FLUSH)])
    assert feed.repair() == (2, 1)
    assert feed.published() == feed.batch()
    assert sorted((a[5], a[6]) for a in feed.published()) == [("cook2", "9.9.9.9"), ("cook3", "8.8.8.8")]
    assert any("10.0.0.9" in a[3][0] for a in feed.published())
