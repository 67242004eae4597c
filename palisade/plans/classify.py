"""The older keyword classifier: message keywords to alerts, fixed incidents and a triage card."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window, functions as F


@dataclass(frozen=True)
class KeywordRule:
    id: str
    name: str
    severity: str
    tactic: str
    technique: str
    keywords: tuple[str, ...]


# The classifier's rules, in order of precedence.
KEYWORD_RULES = [
    KeywordRule("DET-001", "SSH Brute Force", "High", "Credential Access", "T1110", ("failed ssh", "brute force")),
    KeywordRule("DET-002", "Suspicious PowerShell", "High", "Execution", "T1059.001", ("powershell", "encoded command")),
    KeywordRule("DET-003", "Port Scan", "Medium", "Discovery", "T1046", ("port scan",)),
    KeywordRule("DET-004", "Admin Account Created", "High", "Persistence", "T1136", ("admin account",)),
    KeywordRule("DET-005", "SQL Injection Attempt", "High", "Initial Access", "T1190", ("sql injection", "sqli")),
]
# What the older alerts, incidents and triage cards say.
FIRST_ALERT_NUMBER = 1040
BRUTE_FORCE = "SSH Brute Force"
DEFAULT_RECOMMENDATION = "Review evidence and escalate if confirmed."
OLDER_INCIDENTS = [
    ("Credential Access", "INC-219", "Suspected brute-force campaign", "P1", "Investigating", "SOC L1", 13),
    ("Execution", "INC-218", "PowerShell execution chain", "P2", "Containment", "SOC L2", 5),
    ("Persistence", "INC-217", "Identity privilege change", "P2", "Review", "IR Team", 3),
]
RISK_BASE, RISK_CRITICAL, RISK_HIGH, RISK_INCIDENT = 35, 25, 10, 4
TRIAGE_STEPS = [
    "Validate affected asset and user context",
    "Check related alerts and recent authentication activity",
    "Document response actions in the incident record",
]
EMPTY_CARD = ("N/A", "None", "No active alerts are available for triage.", "N/A", "N/A", ["Continue monitoring."])


def keyword_rule(message: Column, rules: Sequence[KeywordRule] = KEYWORD_RULES) -> Column:
    """Number of the first rule with any keyword in the lower-cased message, else null."""
    text = F.lower(F.coalesce(message, F.lit("")))
    out = None
    for i, rule in enumerate(rules):
        hit = F.lit(False)
        for word in rule.keywords:
            hit = hit | text.contains(word)
        out = F.when(hit, F.lit(i)) if out is None else out.when(hit, F.lit(i))
    return out


def _attribute(rules: Sequence[KeywordRule], name: str) -> Column:
    return F.element_at(F.array(*[F.lit(getattr(r, name)) for r in rules]), F.col("k") + 1)


def with_rule(events: DataFrame, rules: Sequence[KeywordRule] = KEYWORD_RULES) -> DataFrame:
    """The number of each event's rule, ``k``, in place of its message: what is shuffled to number the events holds no text."""
    return events.withColumn("k", keyword_rule(F.col("message"), rules)).drop("message")


def classify(events: DataFrame, rules: Sequence[KeywordRule] = KEYWORD_RULES) -> DataFrame:
    """Matched events with their rule; the others are dropped. ``k`` is used where ``with_rule`` has set it."""
    tagged = events if "k" in events.columns else events.withColumn("k", keyword_rule(F.col("message"), rules))
    tagged = tagged.where(F.col("k").isNotNull())
    return tagged.select(
        *events.columns, _attribute(rules, "id").alias("detection_id"), _attribute(rules, "name").alias("detection_name"),
        _attribute(rules, "severity").alias("rule_severity"), _attribute(rules, "tactic").alias("tactic"),
        _attribute(rules, "technique").alias("technique"),
    )


def number_rows(df: DataFrame, order: str = "seq", name: str = "number", span: int = 65_536) -> DataFrame:
    """Running number from 1 over the whole table in ``order`` (a unique integer), without one
    task seeing all rows.

    Rows are numbered within spans of the order column; a running total over one row per span
    gives each span its start.
    """
    spans = df.withColumn("_span", F.floor(F.col(order) / span))
    before = Window.orderBy("_span").rowsBetween(Window.unboundedPreceding, -1)
    starts = spans.groupBy("_span").agg(F.count("*").alias("_n")).select(
        "_span", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_start")
    )
    rank = F.row_number().over(Window.partitionBy("_span").orderBy(order))
    return spans.withColumn("_rn", rank).join(starts, "_span").select(*df.columns, F.expr("_rn + _start").alias(name))


def generate_alerts(events: DataFrame, rules: Sequence[KeywordRule] = KEYWORD_RULES) -> DataFrame:
    """Older alerts. ``number`` is the event's position in the whole input, unmatched events
    included; take it from ``number_rows`` when the input has none."""
    found = classify(events, rules)
    is_brute, is_high = F.col("detection_name") == BRUTE_FORCE, F.col("rule_severity") == "High"
    fallback = lambda name, default: (
        F.col(name) if name in events.columns else default
    )
    return found.select(
        F.concat(F.lit("ALT-"), (F.col("number") + FIRST_ALERT_NUMBER).cast("string")).alias("id"),
        fallback("title", F.col("detection_name")).alias("title"),
        F.when(is_brute, F.lit("Critical")).otherwise(F.col("rule_severity")).alias("severity"),
        F.when(is_brute, F.lit(94)).when(is_high, F.lit(86)).otherwise(F.lit(76)).alias("confidence"),
        fallback("source", F.lit("unknown")).alias("source"), fallback("asset", F.lit("unknown")).alias("asset"),
        "tactic", "technique",
        F.when(is_brute, F.lit("New")).when(is_high, F.lit("Investigating")).otherwise(F.lit("Contained")).alias("status"),
        fallback("timestamp", F.lit(None).cast("string")).alias("timestamp"),
        fallback("recommendation", F.lit(DEFAULT_RECOMMENDATION)).alias("recommendation"), "number",
    )


def older_incidents(alerts: DataFrame) -> DataFrame:
    """One fixed incident per tactic that has alerts."""
    table = alerts.sparkSession.createDataFrame(
        OLDER_INCIDENTS, "tactic string, id string, title string, priority string, status string, owner string, pad int"
    )
    counts = alerts.groupBy("tactic").agg(F.count("*").alias("n"))
    return counts.join(F.broadcast(table), "tactic").select(
        "id", "title", "priority", "status", "owner", (F.col("n") + F.col("pad")).alias("related_alerts")
    )


def older_risk_score(alerts: DataFrame, incidents: DataFrame) -> DataFrame:
    counted = alerts.agg(
        F.count_if(F.col("severity") == "Critical").alias("c"), F.count_if(F.col("severity") == "High").alias("h")
    )
    n = incidents.agg(F.count("*")).scalar()
    score = RISK_BASE + F.col("c") * RISK_CRITICAL + F.col("h") * RISK_HIGH + n * RISK_INCIDENT
    return counted.select(F.least(score, F.lit(100)).cast("int").alias("risk_score"))


def older_risk_by(alerts: DataFrame, *keys: str) -> DataFrame:
    """The older risk score of each group of alerts, and its points before the limit."""
    tactic = F.when(F.col("tactic").isin([row[0] for row in OLDER_INCIDENTS]), F.col("tactic"))
    points = (
        F.lit(RISK_BASE) + F.count_if(F.col("severity") == "Critical") * RISK_CRITICAL
        + F.count_if(F.col("severity") == "High") * RISK_HIGH + F.count_distinct(tactic) * RISK_INCIDENT
    )
    return alerts.groupBy(*keys).agg(points.alias("points")).withColumn("risk_score", F.least("points", F.lit(100)).cast("int"))


def highest_risk(alerts: DataFrame) -> DataFrame:
    """Critical first, then confidence; the earliest of equals."""
    return alerts.orderBy((F.col("severity") == "Critical").desc(), F.col("confidence").desc(), "number").limit(1)


def triage_card(alert: DataFrame) -> DataFrame:
    """The card for one alert, or the card that says there is none."""
    steps = F.array(F.coalesce("recommendation", F.lit(DEFAULT_RECOMMENDATION)), *[F.lit(s) for s in TRIAGE_STEPS])
    text = F.format_string("%s detected on %s from %s. Confidence is %s%%.", F.col("title"), F.col("asset"),
                           F.col("source"), F.col("confidence").cast("string"))
    card = alert.select(
        F.col("id").alias("alert_id"), "severity", text.alias("assessment"), F.col("tactic").alias("mitre_tactic"),
        F.col("technique").alias("mitre_technique"), steps.alias("recommended_actions"),
    )
    empty = alert.sparkSession.createDataFrame([EMPTY_CARD], card.schema)
    return card.unionByName(empty.where(alert.agg(F.count("*")).scalar() == 0))
