"""Whole alert rows from a stream, and their repair when events come late.

Events are stored first (``ingest.ingest_events``); the rules run on a stream over the stored files. Each micro-batch joins
the triggers it got to their evidence in the store, which by then holds every event the rules have seen, and writes the
alerts under the number of the batch: a batch that runs again after a failure writes the same rows over its own.

The rules' state drops events older than the watermark. They are in the store all the same, and ``ingest_events`` keeps a
table of them. ``repair_alerts`` works out from the store what a batch run would have raised from the first late event on
and writes the difference to what was published, as additions and retractions.
"""

from __future__ import annotations

from collections.abc import Sequence
from datetime import datetime, timedelta, timezone

from pyspark.sql import DataFrame, SparkSession, functions as F, types as T
from pyspark.sql.streaming import StreamingQuery

from palisade.functions.columns import has_text, instant_us
from palisade.operators.suppress import ENTITY, SUPPRESSION_US, emitted, offsets_in_use
from palisade.plans.detect import (
    CANDIDATE, build_alerts, candidates, crossing_scopes, group_key, off_hours_alerts, rare_source_alert_rows,
    rare_source_alerts, relevant_events, source_logins, timed,
)
from palisade.rules import RULES, Rule
from palisade.schema import ALERT_SCHEMA, EVENT_SCHEMA
from palisade.session import stage
from palisade.sources.store import read_or_empty, read_store
from palisade.streaming.ingest import each_batch, late_events
from palisade.streaming.rules import rare_sources, rule_triggers

#: Minutes of a clock can come up again in another UTC offset within this time.
SAME_MINUTE_US = 28 * 60 * 60 * 1_000_000
EPOCH = datetime(1970, 1, 1, tzinfo=timezone.utc)
LOG = "alert_id string, added boolean, repair int"
RUNS = "repair int, from_us long, upto_us long, batches long"


def alert_triggers(events: DataFrame, rules: Sequence[Rule] = RULES, rare_source: bool = True, off_hours: bool = True) -> DataFrame:
    """``rule, us, seq, id, known`` of all rules' triggers on a stream with a watermark; ``known`` are the earlier sources of a
    user with a rare one."""
    none = F.lit(None).cast("array<string>").alias("known")
    found = rule_triggers(events, rules, off_hours).select("rule", "us", "seq", "id", none)
    if rare_source:
        found = found.unionByName(rare_sources(events).select(F.lit(len(rules)).alias("rule"), "us", "seq", "id", "known"))
    return found


def _days(events: DataFrame, low: int, high: int) -> DataFrame:
    """The events between two instants; whole dates outside are not read."""
    span = F.col("event_date").between(F.to_date(F.timestamp_micros(F.lit(low))), F.to_date(F.timestamp_micros(F.lit(high))))
    return events.where(span & instant_us("timestamp").between(low, high))


def _look_back(rules: Sequence[Rule]) -> int:
    return max((r.window_us for r in rules), default=0)


def _alert_rows(triggers: DataFrame, prepared: DataFrame, stored: DataFrame, rules: Sequence[Rule], off_hours: bool) -> DataFrame:
    """Alert rows of ``rule, key, t_us, t_seq, t_id``; ``prepared`` holds the events their windows reach."""
    history = timed(stored.where(instant_us("timestamp") <= triggers.agg(F.max("t_us")).scalar()))
    alerts = build_alerts(prepared, triggers, rules, history)
    if off_hours:
        alerts = alerts.unionByName(off_hours_alerts(prepared, triggers, len(rules) + 1))
    return alerts


def _as_alerts(df: DataFrame) -> DataFrame:
    return df.select(*[F.col(f.name).cast(f.dataType) for f in ALERT_SCHEMA.fields])


def stored_alerts(found: DataFrame, stored: DataFrame, rules: Sequence[Rule] = RULES, off_hours: bool = True) -> DataFrame:
    """The alert rows of ``alert_triggers`` rows, their evidence taken from stored events."""
    found = stage(found, "found")
    low, high = found.agg(F.min("us"), F.max("us")).first()
    if low is None:
        return found.sparkSession.createDataFrame([], ALERT_SCHEMA)
    span = _days(stored, low - _look_back(rules), high)
    prepared = relevant_events(span, rules, True, off_hours)
    own = found.join(prepared.select("us", "seq", "id", *_key_fields(rules)), ["us", "seq", "id"])
    plain = [i for i, r in enumerate(rules) if r.preceded_by is None]
    key = F.coalesce(group_key(rules), F.array(*ENTITY)) if plain else F.array(*ENTITY)
    triggers = stage(own.where(F.col("rule") != len(rules)).select(
        "rule", key.alias("key"), F.col("us").alias("t_us"), F.col("seq").alias("t_seq"), F.col("id").alias("t_id")), "triggers")
    alerts = _alert_rows(triggers, prepared, stored, rules, off_hours)
    rare = found.where(F.col("rule") == len(rules)).drop("rule").join(prepared, ["us", "seq", "id"])
    return _as_alerts(alerts.unionByName(rare_source_alert_rows(rare, len(rules))))


def _key_fields(rules: Sequence[Rule]) -> list[str]:
    return sorted({f for r in rules for f in r.group_by} | set(ENTITY))


def follow_alerts(spark: SparkSession, store: str, alerts: str, checkpoint: str, rules: Sequence[Rule] = RULES,
                  delay: str = "10 minutes", rare_source: bool = True, off_hours: bool = True, available_now: bool = True) -> StreamingQuery:
    """Run the rules on what comes into a store and keep a table of alert rows, a folder a batch.

    Alerts are written once the watermark, ``delay`` behind the newest event, has passed them. ``incidents.follow_incidents`` can
    follow the table with ``stream_alerts``.
    """
    events = spark.readStream.schema(EVENT_SCHEMA).parquet(store).withWatermark("timestamp", delay)

    def publish(batch: DataFrame, number: int) -> None:
        rows = stored_alerts(batch, read_store(spark, store), rules, off_hours)
        rows.write.mode("overwrite").parquet(f"{alerts}/batch={number}")

    return each_batch(alert_triggers(events, rules, rare_source, off_hours), publish, checkpoint, available_now)


def stream_alerts(spark: SparkSession, alerts: str) -> DataFrame:
    """The alert rows of ``follow_alerts`` as a stream."""
    return spark.readStream.schema(ALERT_SCHEMA).parquet(f"{alerts}/batch=*")


def published_alerts(spark: SparkSession, alerts: str, corrections: str | None = None) -> DataFrame:
    """The alerts published so far, with the last word of the repairs on each."""
    rows = read_or_empty(spark, alerts, ALERT_SCHEMA).select(*ALERT_SCHEMA.names)
    if corrections is None:
        return rows
    log = read_or_empty(spark, f"{corrections}/log", LOG)
    last = stage(log.groupBy("alert_id").agg(F.max_by(F.struct("added", "repair"), "repair").alias("l")).select("alert_id", "l.added", "l.repair"), "corrected")
    added = read_or_empty(spark, f"{corrections}/rows", T.StructType([*ALERT_SCHEMA.fields, T.StructField("run", T.IntegerType())]))
    added = added.join(last.where("added").select("alert_id", F.col("repair").alias("run")), ["alert_id", "run"], "left_semi")
    return rows.join(last, "alert_id", "left_anti").unionByName(added.select(*ALERT_SCHEMA.names))


def watermark_us(query: StreamingQuery) -> int | None:
    """Up to which instant a query of ``follow_alerts`` has published, in microseconds; None before its first batch."""
    progress = query.lastProgress
    if progress is None:
        return None
    at = datetime.fromisoformat(progress["eventTime"]["watermark"].replace("Z", "+00:00"))
    return (at - EPOCH) // timedelta(microseconds=1)


def repaired_range(spark: SparkSession, late: str, corrections: str) -> tuple[int | None, int]:
    """From which instant a repair must look again, None if nothing came late, and its number.

    The rules' state never learns of late events, so once there were any, all that was published since the last repair is
    looked at again.
    """
    runs = read_or_empty(spark, f"{corrections}/runs", RUNS)
    last = runs.orderBy(F.desc("repair")).first()
    rows = late_events(spark, late)
    low = rows.where(F.col("batch") > (last["batches"] if last else -1)).agg(F.min("us")).first()[0]
    known = [us for us in (low, last["upto_us"] if last else None) if us is not None]
    return (min(known) if known else None), (last["repair"] + 1 if last else 0)


def repair_alerts(spark: SparkSession, store: str, alerts: str, late: str, corrections: str, upto_us: int,
                  rules: Sequence[Rule] = RULES, rare_source: bool = True, off_hours: bool = True) -> tuple[int, int]:
    """Compare what was published with what a batch over all stored events raises up to ``upto_us`` (``watermark_us``), from the
    first late event on. Additions (of changed alerts too) and retractions are written; how many of each is returned.

    Only the look-back before the first late event and what follows it are read, for rare sources only the logins of users
    with late events. What was emitted before that event stands, and enters the suppression as it was.
    """
    from_us, number = repaired_range(spark, late, corrections)
    if from_us is None or from_us > upto_us:
        return 0, 0
    late_rows = stage(late_events(spark, late), "late")
    stored = read_store(spark, store)
    prepared = relevant_events(_days(stored, from_us - _look_back(rules), upto_us), rules, rare_source, off_hours)
    before = published_alerts(spark, alerts, corrections)
    published = stage(before.where(F.col("emit_us").between(from_us, upto_us)), "published")

    again = candidates(prepared, rules, off_hours).where(F.col("us") >= from_us)
    rows = _earlier_triggers(before, stored, rules, from_us).unionByName(again.select(*CANDIDATE))
    found = emitted(rows, offsets_in_use(_days(stored, from_us - SAME_MINUTE_US, upto_us)), crossing_scopes(rules))
    triggers = stage(found.where(F.col("us") >= from_us).select(
        "rule", "key", F.col("us").alias("t_us"), F.col("seq").alias("t_seq"), F.col("id").alias("t_id")), "triggers")
    right = _alert_rows(triggers, prepared, stored, rules, off_hours)
    compared = published.where(F.col("emit_rule") != len(rules))
    if rare_source:
        users = late_rows.select("user").where(has_text("user")).distinct()
        logins = timed(source_logins(stored.join(users, "user", "left_semi")).where(instant_us("timestamp") <= upto_us))
        rare = rare_source_alerts(logins, len(rules)).where(F.col("emit_us") >= from_us)
        right = right.unionByName(rare)
        compared = compared.unionByName(published.where(F.col("emit_rule") == len(rules)).join(users, "user", "left_semi").select(*published.columns))
    right = stage(_as_alerts(right), "right")
    # An alert may keep its id and change: that of a rare source tells which sources were known before.
    shown = [n for n in ALERT_SCHEMA.names if n != "alert_id"]
    same = right.select("alert_id", F.xxhash64(*shown).alias("h")).join(compared.select("alert_id", F.xxhash64(*shown).alias("h")), ["alert_id", "h"], "left_semi")
    added = stage(right.join(same, "alert_id", "left_anti").select(*ALERT_SCHEMA.names), "added")
    taken = stage(compared.join(right.select("alert_id"), "alert_id", "left_anti").select("alert_id"), "taken")
    log = added.select("alert_id", F.lit(True).alias("added")).unionByName(taken.withColumn("added", F.lit(False)))
    # Written in this order and over what a run that broke off left: only with its line in ``runs`` does a repair count as done.
    added.write.mode("overwrite").parquet(f"{corrections}/rows/run={number}")
    log.withColumn("repair", F.lit(number)).write.mode("overwrite").parquet(f"{corrections}/log/run={number}")
    batches = late_rows.agg(F.coalesce(F.max("batch"), F.lit(-1))).first()[0]
    spark.createDataFrame([(number, from_us, upto_us, batches)], RUNS).write.mode(
        "overwrite").parquet(f"{corrections}/runs/run={number}")
    return added.count(), taken.count()


def _earlier_triggers(alerts: DataFrame, stored: DataFrame, rules: Sequence[Rule], from_us: int) -> DataFrame:
    """The triggers emitted shortly before an instant, as candidates: none of them is in another's way, so the fold emits them
    all again and has their clocks and minutes when it comes to the first row after them."""
    low = from_us - max(SAME_MINUTE_US, SUPPRESSION_US)
    own = alerts.where(F.col("emit_us").between(low, from_us - 1) & (F.col("emit_rule") != len(rules))).select(
        F.col("emit_rule").alias("rule"), F.element_at("event_ids", -1).alias("id"))
    rows = timed(_days(stored, low, from_us - 1)).join(own, "id")
    limited = [i for i, r in enumerate(rules) if r.preceded_by is None]
    plain = F.col("rule").isin(limited)
    key = F.when(plain, group_key(rules)).otherwise(F.array(*ENTITY)) if limited else F.array(*ENTITY)
    return rows.withColumn("key", key).withColumn("minute", F.when(plain, F.col("minute"))).select(*CANDIDATE)
