"""Small column expressions used by more than one plan.

Long expressions are written as SQL text: the plan is the same, and one call replaces dozens.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

# Weights and texts by severity.
SEVERITY_RANK = {"critical": 4, "high": 3, "medium": 2, "low": 1}
ACTIONS = {
    "critical": "Escalate immediately, preserve evidence, and contain if confirmed.",
    "high": "Review evidence, validate scope, and contain if unauthorized.",
    "medium": "Investigate context and monitor for progression.",
    "low": "Document and monitor.",
}
PRIVILEGED_USERS = ["root", "admin", "administrator"]
EVIDENCE_FIELDS = ["asset", "user", "src_ip", "dst_ip", "process_name", "command_line", "message"]


def quoted(value) -> str:
    """A value as a SQL literal."""
    if value is None:
        return "NULL"
    if isinstance(value, bool):
        return "true" if value else "false"
    if isinstance(value, int):
        return str(value)
    if isinstance(value, float):
        return f"{value!r}D"
    return "'" + str(value).replace("\\", "\\\\").replace("'", "\\'") + "'"


def computed(df: DataFrame, **columns: Column | str) -> DataFrame:
    """Add columns (SQL texts or columns) that are worked out once, however often later columns
    and filters use them.

    The optimizer writes a plain column out again wherever it is used and moves filters on it
    below it; a chain of parsing steps then grows beyond bounds. It does neither across a
    generator, here one that yields exactly one row.
    """
    cols = [(F.expr(c) if isinstance(c, str) else c).alias(name) for name, c in columns.items()]
    return df.select("*", F.inline(F.array(F.struct(*cols))))


def json_columns(df: DataFrame, text: str, fields: dict[str, str]) -> DataFrame:
    """Add the fields of JSON text as columns: name to ``key type``, null where there is no object."""
    schema = ", ".join(fields.values())
    return df.select("*", F.expr(f"inline(array(from_json({text}, '{schema}')))").alias(*fields))


def present(name: str) -> Column:
    """Null for an empty string: empty counts as missing."""
    return F.expr(f"nullif({name}, '')")


def has_text(name: str) -> Column:
    return F.expr(f"coalesce({name} <> '', false)")


def lookup(name: str, table: dict, default) -> Column:
    """Value for the contents of a column, from a small fixed table."""
    arms = " ".join(f"WHEN {name} = {quoted(k)} THEN {quoted(v)}" for k, v in table.items())
    return F.expr(f"CASE {arms} ELSE {quoted(default)} END")


def severity_rank(name: str, default: int = 0) -> Column:
    return lookup(name, SEVERITY_RANK, default)


def action_text(name: str) -> Column:
    return lookup(name, ACTIONS, ACTIONS["medium"])


def stable_id(prefix: str, parts: str) -> Column:
    """``PREFIX-`` and ten upper-case hex digits of the SHA-256 of an array joined by ``|``."""
    return F.expr(f"concat('{prefix}-', upper(substring(sha2(array_join({parts}, '|'), 256), 1, 10)))")


def text_or_none(name: str) -> Column:
    return F.expr(f"coalesce(cast({name} AS string), 'None')")


def string_list(name: str) -> Column:
    """``['a', 'b']`` as evidence texts print a list of names."""
    return F.expr(f"""CASE WHEN size({name}) = 0 THEN '[]' ELSE concat("['", array_join({name}, "', '"), "']") END""")


def evidence_text(fields: Sequence[str] = EVIDENCE_FIELDS) -> Column:
    parts = ", ".join(f"CASE WHEN {c} <> '' THEN concat('{c}=', {c}) END" for c in fields)
    return F.expr(f"concat_ws('; ', {parts})")


def instant_us(name: str = "timestamp") -> Column:
    return F.expr(f"unix_micros({name})")


def local_minute(us: str = "us", utc_offset: str = "utc_offset") -> Column:
    """Wall-clock minute in the source's own offset, as minutes since 1970."""
    return F.expr(f"floor(({us} + coalesce({utc_offset}, 0) * 1000000L) / 60000000)")


def local_hour(us: str = "us", utc_offset: str = "utc_offset") -> Column:
    return F.expr(f"cast(pmod(floor(({us} + coalesce({utc_offset}, 0) * 1000000L) / 3600000000), 24) AS int)")


def off_hours_privileged(us: str = "us") -> Column:
    """A privileged user's success before 7 or from 20 o'clock on, by the source's clock."""
    users = ", ".join(quoted(u) for u in PRIVILEGED_USERS)
    hour = f"pmod(floor(({us} + coalesce(utc_offset, 0) * 1000000L) / 3600000000), 24)"
    return F.expr(f"user IN ({users}) AND status = 'success' AND ({hour} < 7 OR {hour} >= 20)")
