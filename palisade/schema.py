"""Row layouts."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F, types as T

EVENT_FIELDS = ["asset", "user", "src_ip", "dst_ip", "process_name", "command_line", "status", "message"]

# ``timestamp`` is the instant, ``utc_offset`` the seconds east of UTC the source wrote it in, and
# ``seq`` the arrival order that breaks ties between equal instants.
EVENT_SCHEMA = T.StructType(
    [
        T.StructField("id", T.StringType()),
        T.StructField("timestamp", T.TimestampType()),
        T.StructField("utc_offset", T.IntegerType()),
        T.StructField("source", T.StringType()),
        T.StructField("event_type", T.StringType()),
        *[T.StructField(name, T.StringType()) for name in EVENT_FIELDS],
        T.StructField("raw_log", T.StringType()),
        T.StructField("seq", T.LongType()),
        T.StructField("event_date", T.DateType()),
    ]
)

ALERT_SCHEMA = T.StructType(
    [
        T.StructField("alert_id", T.StringType()),
        T.StructField("rule_id", T.StringType()),
        T.StructField("title", T.StringType()),
        T.StructField("severity", T.StringType()),
        T.StructField("confidence", T.DoubleType()),
        T.StructField("tactic", T.StringType()),
        T.StructField("technique", T.StringType()),
        T.StructField("timestamp", T.TimestampType()),
        T.StructField("utc_offset", T.IntegerType()),
        T.StructField("asset", T.StringType()),
        T.StructField("user", T.StringType()),
        T.StructField("src_ip", T.StringType()),
        T.StructField("event_ids", T.ArrayType(T.StringType())),
        T.StructField("evidence", T.ArrayType(T.StringType())),
        T.StructField("recommended_action", T.StringType()),
        T.StructField("emit_us", T.LongType()),
        T.StructField("emit_seq", T.LongType()),
        T.StructField("emit_rule", T.IntegerType()),
    ]
)

# Stored events, one JSON object per row with ISO timestamps.
EVENT_JSON_FIELDS = ["id", "timestamp", "source", "event_type", *EVENT_FIELDS, "raw_log"]


def as_events(df: DataFrame) -> DataFrame:
    """Complete a partial event table to ``EVENT_SCHEMA``; absent columns become null."""
    have = set(df.columns)
    cols = []
    for field in EVENT_SCHEMA.fields:
        if field.name in have:
            col = F.col(field.name).cast(field.dataType)
        elif field.name == "utc_offset":
            col = F.lit(0)
        elif field.name == "seq":
            col = F.monotonically_increasing_id()
        elif field.name == "event_date":
            col = F.to_date(F.col("timestamp"))
        elif field.name == "raw_log":
            col = F.lit("")
        else:
            col = F.lit(None).cast(field.dataType)
        cols.append(col.alias(field.name))
    return df.select(*cols)
