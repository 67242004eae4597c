"""Alerts to incidents: alerts within 30 minutes that share an asset, user, source address or
tactic belong together, directly or through others."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from palisade.functions.columns import SEVERITY_RANK, has_text, instant_us, lookup, present, severity_rank
from palisade.functions.timeparse import iso_text
from palisade.operators.components import first_copies, linked_groups
from palisade.operators.digest import joined_sha256, short_id

GAP_US = 1800 * 1_000_000


def _input_order() -> list[Column]:
    return [
        instant_us("timestamp").alias("o1"), (-severity_rank("severity")).alias("o2"),
        (-F.col("confidence")).alias("o3"), F.col("emit_us").alias("o4"), F.col("emit_seq").alias("o5"),
        F.col("emit_rule").alias("o6"), F.col("alert_id").alias("o7"),
    ]


def incident_members(alerts: DataFrame) -> DataFrame:
    """Each alert (first copy of an id) with the ``component`` it belongs to. Long form: nothing
    is gathered per incident."""
    unique = first_copies(alerts, "alert_id", _input_order())
    shares = {
        "asset": present("asset"), "user": present("user"), "src_ip": present("src_ip"),
        "tactic": F.coalesce(F.concat(F.lit("="), F.col("tactic")), F.lit("null")),
    }
    found = linked_groups(unique.select(F.col("alert_id").alias("id"), instant_us("timestamp").alias("us"), *[
        c.alias(k) for k, c in shares.items()
    ]), {k: F.col(k) for k in shares}, GAP_US)
    return unique.join(found.withColumnRenamed("id", "alert_id"), "alert_id")


def priority(has_critical: Column, has_high: Column, weight: Column) -> Column:
    return (
        F.when(has_critical | (weight >= 8), F.lit("P1")).when(has_high | (weight >= 5), F.lit("P2"))
        .otherwise(F.lit("P3"))
    )


def incident_priorities(members: DataFrame) -> DataFrame:
    """``component, priority, status, n_alerts, first_us``, combined before the shuffle."""
    weight = lookup("severity", SEVERITY_RANK, 1)
    return members.groupBy("component").agg(
        F.count("*").alias("n_alerts"), F.sum(weight).alias("weight"),
        F.max(F.coalesce(F.col("severity") == "critical", F.lit(False))).alias("has_critical"),
        F.max(F.coalesce(F.col("severity") == "high", F.lit(False))).alias("has_high"),
        F.min(instant_us("timestamp")).alias("first_us"),
    ).select(
        "component", "n_alerts", "weight", priority(F.col("has_critical"), F.col("has_high"), F.col("weight")).alias("priority"),
        F.lit("open").alias("status"), "first_us",
    )


def _named_set(col: str) -> Column:
    return F.array_sort(F.collect_set(F.when(has_text(col), F.col(col))))


def _id_part() -> Column:
    """What an alert adds to its incident's id."""
    return F.array_join(
        F.array(
            F.col("alert_id"), F.col("rule_id"), F.array_join(F.array_sort("event_ids"), ","),
            F.coalesce("asset", F.lit("")), F.coalesce("user", F.lit("")), F.coalesce("src_ip", F.lit("")),
        ), "|",
    )


def incident_ids(members: DataFrame) -> DataFrame:
    """``component, incident_id, n_alerts``: the ids of ``roll_up`` without its lists, for incidents of any size."""
    found = joined_sha256(members, F.col("component"), [F.col("alert_id"), _id_part()], _id_part())
    return found.select(F.col("group").alias("component"), short_id("INC", F.col("digest")).alias("incident_id"), F.col("n").alias("n_alerts"))


def roll_up(members: DataFrame) -> DataFrame:
    """One row per incident with its lists, as a report shows it.

    The lists hold every alert of the incident, so a row is as long as its incident; work on
    ``incident_members`` and ``incident_priorities`` when only membership or priority matters.
    """
    ordered = F.struct(*_input_order())
    line = F.struct(
        iso_text().alias("timestamp"), "alert_id", "title", "severity",
        "asset", "user", "src_ip", "tactic",
    )
    id_part = _id_part()
    weight = lookup("severity", SEVERITY_RANK, 1)
    g = members.groupBy("component").agg(
        F.array_sort(F.collect_list(F.struct(ordered.alias("o"), line.alias("line")))).alias("lines"),
        F.array_sort(F.collect_list(F.struct("alert_id", id_part.alias("part")))).alias("parts"),
        F.array_sort(F.collect_set("title")).alias("titles"), F.array_sort(F.collect_set("tactic")).alias("tactics"),
        F.array_sort(F.collect_set("recommended_action")).alias("recommended_actions"),
        _named_set("asset").alias("related_assets"), _named_set("user").alias("related_users"),
        _named_set("src_ip").alias("related_src_ips"), F.sum(weight).alias("weight"),
        F.max(F.coalesce(F.col("severity") == "critical", F.lit(False))).alias("c"),
        F.max(F.coalesce(F.col("severity") == "high", F.lit(False))).alias("h"),
    ).withColumn("timeline", F.transform("lines", lambda x: x.getField("line")))
    digest = F.sha2(F.array_join(F.transform("parts", lambda x: x.getField("part")), "|"), 256)
    title = F.when(F.size("timeline") == 1, F.get("titles", F.lit(0))).otherwise(
        F.concat(F.lit("Correlated SOC activity: "), F.array_join("tactics", ", "))
    )
    return g.select(
        F.concat(F.lit("INC-"), F.upper(F.substring(digest, 1, 10))).alias("incident_id"), title.alias("title"),
        priority(F.col("c"), F.col("h"), F.col("weight")).alias("priority"), F.lit("open").alias("status"),
        F.lit("unassigned").alias("owner"),
        F.transform("timeline", lambda x: x.getField("alert_id")).alias("related_alert_ids"),
        "related_assets", "related_users", "related_src_ips",
        F.array_join("titles", " | ").alias("evidence_summary"), "timeline", "recommended_actions",
    )


def correlate(alerts: DataFrame) -> DataFrame:
    """Incidents of an alert table."""
    return roll_up(incident_members(alerts))
