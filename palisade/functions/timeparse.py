"""Timestamp text to an instant and the offset it was written in, as SQL texts.

Wall-clock arithmetic assumes ``spark.sql.session.timeZone=UTC``, which ``build_session`` sets.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from palisade.functions.columns import computed, quoted

# Month abbreviations of log lines.
MONTHS = ["jan", "feb", "mar", "apr", "may", "jun", "jul", "aug", "sep", "oct", "nov", "dec"]
WHITESPACE = " \t\n\r\x0b\x0c\x1c\x1d\x1e\x1f\x85\xa0\u2028\u2029\u3000"

ZONE = r"(Z|[+-]\d{2}:?\d{2}(:?\d{2})?)"
ISO = rf"^\d{{4}}-?\d{{2}}-?\d{{2}}([T ]\d{{2}}(:?\d{{2}}(:?\d{{2}}([.,]\d+)?)?)?{ZONE}?)?$"
USUAL = r"^\d{4}-\d{2}-\d{2}[T ]\d{2}:\d{2}:\d{2}(\.\d{1,9})?(Z|[+-]\d{2}:\d{2})?$"
# Rewrites of rarer spellings to the usual one, in order.
RARE = [
    (r"^(\d{4})(\d{2})(\d{2})", "$1-$2-$3"),
    (r"^(\S{10}[T ]\d{2})(\d{2})", "$1:$2"),
    (r"^(\S{10}[T ]\d{2}:\d{2})(\d{2})", "$1:$2"),
    (r"^(\S{10}[T ]\d{2})(?=$|[Z+-])", "$1:00:00"),
    (r"^(\S{10}[T ]\d{2}:\d{2})(?=$|[Z+-])", "$1:00"),
    (r"([+-]\d{2})(\d{2})$", "$1:$2"),
    (r"^(\S{10}[T ][0-9:]+),", "$1."),
    (r"^(\S{10})$", "$1T00:00:00"),
]


def strip(text: str) -> str:
    return f"btrim({text}, {quoted(WHITESPACE)})"


def with_iso(df: DataFrame, text: str, timestamp: str, utc_offset: str) -> DataFrame:
    """Add the instant and offset (seconds) of ISO-8601 text; both null when it is none.

    Text without an offset is UTC. The offset is how far the wall clock lies ahead of the instant.
    """
    rare = "t"
    for pattern, target in RARE:
        rare = f"regexp_replace({rare}, {quoted(pattern)}, {quoted(target)})"
    step = computed(df, t=strip(text))
    step = computed(step, t2=f"CASE WHEN t RLIKE {quoted(USUAL)} THEN t WHEN t RLIKE {quoted(ISO)} THEN {rare} END")
    step = computed(
        step,
        wall=f"try_cast(concat(regexp_replace(t2, {quoted(r'(?<=.{11})' + ZONE + '$')}, ''), 'Z') AS timestamp)",
        instant=f"try_cast(CASE WHEN t2 RLIKE {quoted('.{11}.*' + ZONE + '$')} THEN t2 ELSE concat(t2, 'Z') END AS timestamp)",
    )
    return step.select(
        *df.columns, F.expr("CASE WHEN wall IS NOT NULL THEN instant END").alias(timestamp),
        F.expr("cast((unix_micros(wall) - unix_micros(instant)) / 1000000 AS int)").alias(utc_offset),
    )


def wall_clock_utc(year: str, month: str, day: str, clock: str) -> str:
    """Instant of a date written with a month abbreviation, read as UTC; null for a bad date."""
    names = ", ".join(quoted(m) for m in MONTHS)
    number = f"nullif(array_position(array({names}), lower({month})), 0)"
    return f"try_cast(concat({year}, '-', lpad({number}, 2, '0'), '-', lpad({day}, 2, '0'), ' ', {clock}, 'Z') AS timestamp)"


def iso_text(us: str = "unix_micros(timestamp)", utc_offset: str = "utc_offset") -> Column:
    """ISO-8601 text in the source's own offset, microseconds only when there are any."""
    off = f"coalesce({utc_offset}, 0)"
    return F.expr(
        f"""concat(date_format(timestamp_micros({us} + {off} * 1000000L), "yyyy-MM-dd'T'HH:mm:ss"),
        CASE WHEN {us} % 1000000 <> 0 THEN concat('.', lpad(pmod({us}, 1000000), 6, '0')) ELSE '' END,
        CASE WHEN {off} = 0 THEN '+00:00' ELSE format_string('%s%02d:%02d', CASE WHEN {off} < 0 THEN '-' ELSE '+' END,
          cast(abs({off}) / 3600 AS int), cast(abs({off}) % 3600 / 60 AS int)) END)"""
    )
