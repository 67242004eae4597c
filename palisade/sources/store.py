"""The event table: Parquet by event date, first copy of an id wins."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from py4j.protocol import Py4JJavaError
from pyspark.sql import DataFrame, Observation, SparkSession, functions as F, types as T

from palisade.functions.columns import json_columns
from palisade.functions.timeparse import iso_text, with_iso
from palisade.schema import EVENT_JSON_FIELDS, EVENT_SCHEMA, as_events
from palisade.session import stage

# The partition column comes last, as Spark returns it when it reads the table.
STORED = [f.name for f in EVENT_SCHEMA.fields]


def read_or_empty(spark: SparkSession, path: str, schema: T.StructType | str) -> DataFrame:
    """A Parquet table; an empty one when nothing was written yet."""
    try:
        return spark.read.schema(schema).parquet(path)
    except AnalysisException as err:
        if "PATH_NOT_FOUND" not in (err.getCondition() or ""):
            raise
        return spark.createDataFrame([], schema)


def read_store(spark: SparkSession, path: str) -> DataFrame:
    """The stored events; an empty table when nothing was saved yet."""
    return read_or_empty(spark, path, EVENT_SCHEMA).select(*STORED)


def first_per_id(events: DataFrame) -> DataFrame:
    """The first row to arrive of each id; copies are combined before the shuffle."""
    order = F.struct("seq", "timestamp")
    return events.groupBy("id").agg(F.min_by(F.struct(*events.columns), order).alias("_r")).select("_r.*")


def not_stored(stored: DataFrame, fresh: DataFrame) -> DataFrame:
    """Rows of ``fresh`` whose id is not stored.

    The stored ids are first cut down to those that come in again: that join builds its small
    side from the incoming ids, so the large table is read in one column and not shuffled when
    the batch is small.
    """
    known = stored.select("id").join(fresh.select("id"), "id", "left_semi")
    return fresh.join(known, "id", "left_anti")


def unseen(stored: DataFrame, incoming: DataFrame) -> DataFrame:
    """Incoming rows whose id is not stored, one per id (the first to arrive)."""
    return not_stored(stored, first_per_id(incoming))


def save_events(events: DataFrame, path: str) -> int:
    """Append the events not stored yet; the number of rows written."""
    spark = events.sparkSession
    incoming = stage(first_per_id(as_events(events)), "incoming")
    counted = Observation()
    fresh = not_stored(read_store(spark, path), incoming).observe(counted, F.count("*").alias("n"))
    # Rebalancing splits a busy date over several files and gathers small ones.
    fresh.select(*STORED).hint("rebalance", "event_date").write.mode("append").partitionBy("event_date").parquet(path)
    return _observed(counted, "n")


def _observed(observation: Observation, name: str) -> int:
    """The observed count; 0 when adaptive execution found the result empty and left it out, which
    shows as a missing row. Any other failure is passed on."""
    try:
        return int(observation.get[name])
    except Py4JJavaError as err:
        if err.java_exception.getClass().getName() == "java.lang.AssertionError":
            return 0
        raise


def load_events(spark: SparkSession, path: str, limit: int | None = None) -> DataFrame:
    """Stored events from the oldest on; with a limit, the oldest ones only."""
    return oldest_first(read_store(spark, path), limit)


def oldest_first(events: DataFrame, limit: int | None = None) -> DataFrame:
    ordered = events.orderBy("timestamp", "seq", "id")
    return ordered.limit(limit) if limit else ordered


def storage_stats(events: DataFrame) -> DataFrame:
    """``stored_events``, ``source_distribution`` and ``last_event_timestamp`` in one pass."""
    by_source = events.groupBy("source").agg(F.count("*").alias("n"), F.max("timestamp").alias("last"))
    return by_source.agg(
        F.coalesce(F.sum("n"), F.lit(0)).alias("stored_events"),
        F.map_from_entries(F.collect_list(F.struct(F.coalesce("source", F.lit("None")), "n"))).alias("source_distribution"),
        F.max("last").alias("last_event_timestamp"),
    )


def load_or_seed(spark: SparkSession, path: str, sample: DataFrame) -> DataFrame:
    """The stored events, after saving ``sample`` when there are none."""
    if read_store(spark, path).isEmpty():
        save_events(sample, path)
    return load_events(spark, path)


def to_json_rows(events: DataFrame) -> DataFrame:
    """``id, event_json``: the event as JSON with its ISO timestamp; absent fields are null."""
    stamp = iso_text().alias("timestamp")
    fields = [stamp if c == "timestamp" else F.col(c) for c in EVENT_JSON_FIELDS]
    return events.select("id", F.to_json(F.struct(*fields), {"ignoreNullFields": "false"}).alias("event_json"))


def from_json_rows(rows: DataFrame, column: str = "event_json") -> DataFrame:
    """The reverse of ``to_json_rows``; other columns of ``rows`` (such as ``seq``) are kept."""
    others = [c for c in rows.columns if c not in (column, *EVENT_JSON_FIELDS)]
    parsed = json_columns(rows.select(column, *others), column, {f"_{c}": f"`{c}` string" for c in EVENT_JSON_FIELDS})
    parsed = with_iso(parsed, "_timestamp", "_at", "_offset")
    fields = [f"_{c} AS {c}" for c in EVENT_JSON_FIELDS if c != "timestamp"]
    return as_events(parsed.selectExpr("_at AS timestamp", "_offset AS utc_offset", *fields, *others))


TRIAGE_SCHEMA = T.StructType([
    T.StructField("alert_id", T.StringType()), T.StructField("action", T.StringType()),
    T.StructField("analyst", T.StringType()), T.StructField("status", T.StringType()),
    T.StructField("recorded_at", T.TimestampType()),
])
DEFAULT_ANALYST, RECORDED = "frontend", "recorded"


def triage_records(decisions: DataFrame) -> tuple[DataFrame, DataFrame]:
    """``(records, rejected)`` of triage decisions: alert id and action are required."""
    have = decisions.columns
    analyst = F.coalesce("analyst", F.lit(DEFAULT_ANALYST)) if "analyst" in have else F.lit(DEFAULT_ANALYST)
    at = F.col("recorded_at") if "recorded_at" in have else F.current_timestamp()
    ok = F.coalesce((F.col("alert_id") != "") & (F.col("action") != ""), F.lit(False))
    records = decisions.where(ok).select(
        "alert_id", "action", analyst.alias("analyst"), F.lit(RECORDED).alias("status"), at.alias("recorded_at")
    )
    return records, decisions.where(~ok).withColumn("reason", F.lit("alert_id and action are required"))


def save_triage(decisions: DataFrame, path: str) -> None:
    triage_records(decisions)[0].write.mode("append").parquet(path)


def latest_triage(alerts: DataFrame, records: DataFrame) -> DataFrame:
    """Alerts with their latest decision, if any."""
    order = F.struct("recorded_at", "action", "analyst")
    latest = records.groupBy("alert_id").agg(F.max_by(F.struct("action", "analyst", "status"), order).alias("d")).select(
        "alert_id", F.col("d.action").alias("triage_action"), F.col("d.analyst").alias("triage_analyst"),
        F.col("d.status").alias("triage_status"),
    )
    return alerts.join(latest, "alert_id", "left")
