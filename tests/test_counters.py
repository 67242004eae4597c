"""Counts of a running stream, and incidents whose upkeep reads only the days of a batch."""

import random

from pyspark.sql import functions as F

from palisade.schema import ALERT_SCHEMA
from palisade.sources.normalize import parse_lines, parser_stats, valid_events
from palisade.streaming import counters, incidents
from tests.helpers import alert, alert_frame, groups

LINE = "Oct  2 06:30:{:02d} quay sshd[9]: Failed password for invalid user bo from 172.20.1.1 port 9 ssh2"


def test_counts_of_each_batch(spark, tmp_path):
    (tmp_path / "logs").mkdir()
    for n in range(3):
        (tmp_path / "logs" / f"{n}.log").write_text("\n".join([LINE.format(n)] * (n + 1) + ["{bad json", "odd", "odd too"][: n + 1]))
    listener = counters.ParsingCounters(spark, str(tmp_path / "counts"))
    spark.streams.addListener(listener)
    try:
        lines = spark.readStream.option("maxFilesPerTrigger", 1).text(str(tmp_path / "logs")).select(F.col("value").alias("raw"))
        parsed = counters.counted(parse_lines(lines, reference_year=2026))
        writer = valid_events(parsed).writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "c"))
        query = writer.trigger(availableNow=True).start()
        query.awaitTermination()
        assert listener.wait_for(query.runId)
    finally:
        spark.streams.removeListener(listener)
    rows = counters.counts_by_batch(spark, str(tmp_path / "counts")).collect()
    assert sorted((r.parsed_events, r.parsing_failed_events, r.unknown_events) for r in rows) == [(1, 1, 0), (2, 1, 1), (3, 1, 2)]
    batch = parser_stats(parse_lines(spark.read.text(str(tmp_path / "logs")).select(F.col("value").alias("raw")), reference_year=2026)).first()
    total = counters.totals(spark, str(tmp_path / "counts")).first()
    assert tuple(total) == (batch.parsed_events, batch.parsing_failed_events, batch.unknown_events) == (6, 3, 3)


def test_a_batch_reads_its_own_days_only(spark, tmp_path, monkeypatch):
    """Ten days of alerts are stored; a batch of the last day lists nothing of the days before the one next to it."""
    r = random.Random(7)
    rows = [alert(i, minutes=r.randrange(10 * 1440), asset=f"h{r.randrange(9)}", user=f"u{r.randrange(9)}", src_ip=f"10.0.0.{r.randrange(9)}",
                  tactic=f"T{r.randrange(9)}") for i in range(120)]
    places = str(tmp_path / "alerts"), str(tmp_path / "members")
    incidents.add_alerts(alert_frame(spark, rows), *places, 0)
    read = []
    whole = incidents.read_days

    def watched(spark, path, days, schema, before):
        out = whole(spark, path, days, schema, before)
        read.extend(out.inputFiles())
        return out

    monkeypatch.setattr(incidents, "read_days", watched)
    new = [alert(500 + i, minutes=10 * 1440 + i, asset=f"h{i}", user=None, src_ip=None, tactic="T1") for i in range(3)]
    incidents.add_alerts(alert_frame(spark, new), *places, 1)
    days = sorted({f.split("day=")[1].split("/")[0] for f in read if "/merges/" not in f})
    assert len(days) <= 2
    got = {}
    for m in incidents.current_members(spark, places[1]).collect():
        got.setdefault(m.component, set()).add(m.alert_id)
    assert {frozenset(g) for g in got.values()} == groups(rows + new)


def test_merges_over_many_batches_and_batches_that_run_again(spark, tmp_path):
    """Alerts one at a time, out of order, so that incidents grow together; one batch runs twice."""
    rows = [alert(i, minutes=25 * i, asset="same", user=None, src_ip=None, tactic=f"T{i}") for i in range(5)]
    places = str(tmp_path / "alerts"), str(tmp_path / "members")
    for n, i in enumerate((0, 4, 2, 1, 3)):
        for _ in range(2 if n == 3 else 1):
            incidents.add_alerts(alert_frame(spark, [rows[i]]).select(*ALERT_SCHEMA.names), *places, n)
    got = incidents.current_members(spark, places[1]).collect()
    assert len(got) == 5 and len({m.component for m in got}) == 1
    assert incidents.read_alerts(spark, places[0]).count() == 5
