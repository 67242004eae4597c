"""Detection rules as data, and their compilation to column predicates.

A new rule needs no code while it uses equality, substring and pattern tests on event fields, a
threshold over a look-back window, a grouping key and a distinct field.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, field, replace

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from palisade.functions.columns import lookup, quoted


@dataclass(frozen=True)
class Rule:
    rule_id: str
    name: str
    severity: str
    confidence: float
    tactic: str
    technique: str
    field_equals: dict[str, str] = field(default_factory=dict)
    contains: dict[str, list[str]] = field(default_factory=dict)
    regex: dict[str, list[str]] = field(default_factory=dict)
    threshold: int = 1
    time_window_minutes: int = 1
    group_by: tuple[str, ...] = ()
    distinct_field: str | None = None
    # Equality tests of the earlier events a rule of kind "failures, then success" looks back for.
    preceded_by: dict[str, str] | None = None

    @property
    def window_us(self) -> int:
        return self.time_window_minutes * 60_000_000

    @property
    def is_windowed(self) -> bool:
        return self.preceded_by is None and (self.threshold > 1 or self.distinct_field is not None)


# The rule set.
RULES = [
    Rule("DET-SSH-001", "SSH brute force", "high", 0.86, "Credential Access", "T1110",
         field_equals={"event_type": "ssh_login", "status": "failure"},
         threshold=5, time_window_minutes=5, group_by=("src_ip",)),
    Rule("DET-SSH-002", "Successful login after multiple failures", "high", 0.84, "Initial Access", "T1078",
         field_equals={"event_type": "ssh_login", "status": "success"},
         threshold=4, time_window_minutes=10, group_by=("src_ip", "user"),
         preceded_by={"event_type": "ssh_login", "status": "failure"}),
    Rule("DET-SSH-003", "SSH password spraying across users", "high", 0.83, "Credential Access", "T1110.003",
         field_equals={"event_type": "ssh_login", "status": "failure"},
         threshold=5, time_window_minutes=10, group_by=("src_ip",), distinct_field="user"),
    Rule("DET-PS-001", "Encoded PowerShell execution", "critical", 0.9, "Execution", "T1059.001",
         field_equals={"event_type": "powershell_execution"},
         contains={"command_line": ["-enc", "encodedcommand", "frombase64string", "bypass", "hidden"]}),
    Rule("DET-NET-001", "Internal port scan", "medium", 0.78, "Discovery", "T1046",
         field_equals={"event_type": "network_connection"},
         threshold=8, time_window_minutes=5, group_by=("src_ip",), distinct_field="dst_ip"),
    Rule("DET-WIN-001", "New admin account creation", "critical", 0.88, "Persistence", "T1136",
         field_equals={"event_type": "admin_account_change"},
         contains={"message": ["admin", "administrator", "created", "added"]}),
    Rule("DET-WAF-001", "SQL injection attempt", "high", 0.82, "Initial Access", "T1190",
         field_equals={"event_type": "http_request"},
         regex={"message": [r"(?i)union\s+select", r"(?i)or\s+1=1", "(?i)sqlmap", "(?i)information_schema", "(?i)../"]}),
]
RARE_SOURCE = Rule("DET-AI-001", "Rare external source IP for user", "medium", 0.80, "Initial Access", "T1078")
OFF_HOURS = Rule("DET-AI-002", "Off-hours privileged activity", "medium", 0.74, "Privilege Escalation", "T1078")
RARE_SOURCE_ACTION = "Validate VPN/travel context and check for credential compromise."
OFF_HOURS_ACTION = "Confirm approval and review session commands."

COVERAGE_NOTE = "Coverage is based on implemented rule metadata, not guaranteed telemetry visibility."


def strict_traversal(rules: Sequence[Rule] = RULES) -> list[Rule]:
    """The same rules with the path traversal pattern's dots taken literally."""
    return [
        replace(r, regex={f: [r"(?i)\.\./" if p == "(?i)../" else p for p in pats] for f, pats in r.regex.items()})
        for r in rules
    ]


def per_entity(rules: Sequence[Rule] = RULES) -> list[Rule]:
    """The same rules with a key for those that have none, so that one busy source neither hides
    nor pads the alerts of another."""
    return [r if r.group_by else replace(r, group_by=("src_ip", "user", "asset")) for r in rules]


def equals_all(pairs: dict[str, str]) -> Column:
    return F.expr(_equals_all(pairs))


def _equals_all(pairs: dict[str, str]) -> str:
    return " AND ".join(f"{name} <=> {'NULL' if value is None else quoted(value)}" for name, value in pairs.items()) or "true"


def contains_any(name: str, values: Sequence[str]) -> str:
    """The lower-cased field holds any of the texts; no texts means no condition."""
    tests = [f"contains(lower(coalesce({name}, '')), {quoted(value.lower())})" for value in values]
    return "(" + " OR ".join(tests) + ")" if tests else "true"


def matches_any(name: str, patterns: Sequence[str]) -> str:
    tests = [f"coalesce({name}, '') RLIKE {quoted('(?Ud)' + pattern)}" for pattern in patterns]
    return "(" + " OR ".join(tests) + ")" if tests else "true"


def predicate(rule: Rule) -> Column:
    tests = [_equals_all(rule.field_equals)]
    tests += [contains_any(name, values) for name, values in rule.contains.items()]
    tests += [matches_any(name, patterns) for name, patterns in rule.regex.items()]
    return F.expr(" AND ".join(tests))


def rule_column(rules: Sequence[Rule], attribute: str, default=None) -> Column:
    """Value of a rule attribute for the rule number in column ``rule``."""
    return lookup("rule", {i: getattr(r, attribute) for i, r in enumerate(rules)}, default)


def rules_table(spark: SparkSession, rules: Sequence[Rule] = RULES) -> DataFrame:
    schema = (
        "rule_id string, name string, severity string, confidence double, tactic string, technique string, "
        "field_equals map<string,string>, contains map<string,array<string>>, regex map<string,array<string>>, "
        "threshold int, time_window_minutes int, group_by array<string>, distinct_field string"
    )
    rows = [
        (r.rule_id, r.name, r.severity, float(r.confidence), r.tactic, r.technique, dict(r.field_equals),
         {k: list(v) for k, v in r.contains.items()}, {k: list(v) for k, v in r.regex.items()},
         r.threshold, r.time_window_minutes, list(r.group_by), r.distinct_field)
        for r in rules
    ]
    return spark.createDataFrame(rows, schema)
