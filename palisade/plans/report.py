"""Metrics, distributions, rule coverage and the filters of the query API."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from palisade.functions.columns import lookup, present, severity_rank
from palisade.plans.detect import alert_order
from palisade.rules import COVERAGE_NOTE

# Risk weights.
SEVERITY_RISK = {"critical": 20, "high": 12, "medium": 6, "low": 2}
PRIORITY_RISK = {"P1": 25, "P2": 14, "P3": 6}
TOP_TACTICS, RISK_LIMIT = 5, 100


def distribution(events: DataFrame, column: str) -> DataFrame:
    return events.groupBy(column).agg(F.count("*").alias("n"))


def _as_map(counts: DataFrame, column: str) -> DataFrame:
    return counts.groupBy(column).agg(F.sum("n").alias("n")).agg(
        F.map_from_entries(F.collect_list(F.struct(F.coalesce(column, F.lit("None")), "n"))).alias("m")
    )


def event_counts(events: DataFrame) -> DataFrame:
    """One pass over the events; all distributions are read off this small table."""
    return events.groupBy("source", "event_type").agg(F.count("*").alias("n"))


def top_tactics(alerts: DataFrame, top: int = TOP_TACTICS) -> DataFrame:
    """Most frequent tactics; equal counts in the order they first appear in the sorted alerts."""
    place = F.struct(
        (-severity_rank("severity")).alias("a"),
        (-F.col("confidence")).alias("b"), (-F.unix_micros("timestamp")).alias("c"), "emit_us", "emit_seq", "emit_rule",
    )
    return (
        alerts.groupBy("tactic").agg(F.count("*").alias("n"), F.min(place).alias("place"))
        .orderBy(F.col("n").desc(), F.col("place").asc()).limit(top).select("tactic", "n", "place")
    )


def _points(alerts: DataFrame, incidents: DataFrame, *keys: str) -> DataFrame:
    """``points`` of each alert and each open incident, with the key columns."""
    own = alerts.select(*keys, lookup("severity", SEVERITY_RISK, 1).alias("points"))
    return own.unionByName(incidents.where(F.col("status") == "open").select(*keys, lookup("priority", PRIORITY_RISK, 1).alias("points")))


def risk_points(alerts: DataFrame, incidents: DataFrame) -> Column:
    return F.least(F.lit(RISK_LIMIT), _points(alerts, incidents).agg(F.coalesce(F.sum("points"), F.lit(0))).scalar())


def risk_by(alerts: DataFrame, incidents: DataFrame, *keys: str) -> DataFrame:
    """The risk score of each group, and its points before the limit. Both tables have the key columns; null is a group."""
    return _points(alerts, incidents, *keys).groupBy(*keys).agg(F.sum("points").alias("points")).withColumn(
        "risk_score", F.least(F.lit(RISK_LIMIT), "points").cast("int"))


def calculate_metrics(events: DataFrame, alerts: DataFrame, incidents: DataFrame,
                      parser_counts: DataFrame | None = None) -> DataFrame:
    """One summary row. Alerts are read several times: pass a written or persisted table.

    With ``parser_counts`` (see ``parser_stats``) the row also has the failed and unknown counts
    and the unknown rate; ``compat_parsing_failed_events`` repeats the unknown count, which older
    dashboards read under that name.
    """
    counts = event_counts(events)
    ranked = top_tactics(alerts).agg(
        F.array_sort(F.collect_list(F.struct((-F.col("n")).alias("k"), "place", "tactic", "n"))).alias("l")
    )
    tactics = ranked.select(F.map_from_entries(F.transform(
        "l", lambda x: F.struct(F.coalesce(x.getField("tactic"), F.lit("None")), x.getField("n"))
    )))
    summary = alerts.agg(
        F.count("*").alias("total_alerts"), F.count_if(F.col("severity") == "critical").alias("critical_alerts"),
        F.count_if(F.col("severity") == "high").alias("high_alerts"),
    )
    total = F.coalesce(counts.agg(F.sum("n")).scalar(), F.lit(0))
    out = summary.select(
        total.alias("total_events"), "total_alerts", "critical_alerts", "high_alerts",
        incidents.agg(F.count_if(F.col("status") == "open")).scalar().alias("open_incidents"),
        risk_points(alerts, incidents).cast("int").alias("risk_score"),
        tactics.scalar().alias("top_tactics"),
        _as_map(counts, "source").scalar().alias("source_distribution"),
        _as_map(counts, "event_type").scalar().alias("event_type_distribution"),
    )
    if parser_counts is None:
        return out
    unknown = parser_counts.select("unknown_events").scalar()
    return out.select(
        "*", parser_counts.select("parsing_failed_events").scalar().alias("parsing_failed_events"),
        unknown.alias("unknown_events"), unknown.alias("compat_parsing_failed_events"),
        unknown_rate(unknown, F.col("total_events")).alias("unknown_event_rate_pct"),
    )


def unknown_rate(unknown: Column, total: Column) -> Column:
    return F.round(unknown / F.greatest(total, F.lit(1)) * 100, 2)


def _first_present(df: DataFrame, names: Sequence[str], default: str) -> Column:
    return F.coalesce(*[present(n) for n in names if n in df.columns], F.lit(default))


def _coverage_fields(rules: DataFrame) -> DataFrame:
    return rules.select(
        _first_present(rules, ["rule_id", "id"], "UNKNOWN").alias("rule_id"),
        _first_present(rules, ["tactic", "mitre_tactic"], "Unknown").alias("tactic"),
        _first_present(rules, ["technique", "mitre_technique"], "Unknown").alias("technique"),
    )


def coverage_by_tactic(rules: DataFrame) -> DataFrame:
    return (
        _coverage_fields(rules).groupBy("tactic").agg(F.count("*").alias("rule_count"))
        .orderBy(F.col("rule_count").desc(), "tactic")
    )


def coverage_by_technique(rules: DataFrame) -> DataFrame:
    return (
        _coverage_fields(rules).groupBy("technique", "tactic")
        .agg(F.count("*").alias("rule_count"), F.array_sort(F.collect_list("rule_id")).alias("rules"))
        .orderBy(F.col("rule_count").desc(), "tactic", "technique")
    )


def unmapped_rules(rules: DataFrame) -> DataFrame:
    return (
        _coverage_fields(rules).where((F.col("tactic") == "Unknown") | (F.col("technique") == "Unknown"))
        .select("rule_id").orderBy("rule_id")
    )


def attack_coverage(rules: DataFrame) -> DataFrame:
    """The coverage report as one row (there are only as many entries as rules)."""
    key = (-F.col("rule_count")).alias("k")
    tactics = coverage_by_tactic(rules).agg(
        F.array_sort(F.collect_list(F.struct(key, "tactic", "rule_count"))).alias("l")
    ).select(F.transform("l", lambda x: x.dropFields("k")))
    techniques = coverage_by_technique(rules).agg(
        F.array_sort(F.collect_list(F.struct(key, "tactic", "technique", "rule_count", "rules"))).alias("l")
    ).select(F.transform("l", lambda x: x.dropFields("k")))
    unmapped = unmapped_rules(rules).agg(F.array_sort(F.collect_list("rule_id")))
    return _coverage_fields(rules).agg(F.count("*").alias("total_rules")).select(
        "total_rules", tactics.scalar().alias("tactics"), techniques.scalar().alias("techniques"),
        unmapped.scalar().alias("unmapped_rules"), F.lit(COVERAGE_NOTE).alias("note"),
    )


def _where_equal(df: DataFrame, **wanted: str | None) -> DataFrame:
    """Equality filters that reach the scan; an empty argument is no filter."""
    for name, value in wanted.items():
        if value:
            df = df.where(F.col(name) == value)
    return df


def filter_events(events: DataFrame, source: str | None = None, event_type: str | None = None, asset: str | None = None,
                  user: str | None = None, src_ip: str | None = None) -> DataFrame:
    return _where_equal(events, source=source, event_type=event_type, asset=asset, user=user, src_ip=src_ip)


def filter_alerts(alerts: DataFrame, severity: str | None = None, tactic: str | None = None, asset: str | None = None,
                  user: str | None = None, src_ip: str | None = None) -> DataFrame:
    return _where_equal(alerts, severity=severity, tactic=tactic, asset=asset, user=user, src_ip=src_ip)


def filter_incidents(incidents: DataFrame, status: str | None = None, priority: str | None = None) -> DataFrame:
    return _where_equal(incidents, status=status, priority=priority)


def find_incident(incidents: DataFrame, incident_id: str | Column) -> DataFrame:
    """The incident of that id, or no row."""
    return incidents.where(F.col("incident_id") == incident_id).limit(1)


def most_confident(alerts: DataFrame) -> DataFrame:
    return alerts.orderBy(F.col("confidence").desc(), *alert_order()).limit(1)
