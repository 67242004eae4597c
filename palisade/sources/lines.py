"""Log files as rows of ``raw`` text, in batch or as a stream, and JSON request bodies."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from palisade.functions.columns import computed
from palisade.functions.timeparse import strip
from palisade.sources.normalize import with_positions

def _as_raw(df: DataFrame) -> DataFrame:
    return df.selectExpr(f"{strip('value')} AS raw", "_metadata.file_path AS source_uri")


def read_log_lines(spark: SparkSession, path: str | list[str], number_copies: bool = True) -> DataFrame:
    """Stripped non-blank lines with their file and arrival order."""
    lines = _as_raw(spark.read.text(path)).where(F.col("raw") != "")
    lines = lines.withColumn("seq", F.monotonically_increasing_id())
    return with_positions(lines) if number_copies else lines


def stream_log_lines(spark: SparkSession, path: str, max_files: int | None = None,
                     modified_after: str | None = None) -> DataFrame:
    """Follow a folder of rolled log files.

    The checkpoint of the query keeps the position. All present files are read by default;
    ``modified_after`` starts with newer ones only. Appended bytes of a file already read are not
    seen: roll files, or put a message bus in front.
    """
    reader = spark.readStream
    if max_files:
        reader = reader.option("maxFilesPerTrigger", max_files)
    if modified_after:
        reader = reader.option("modifiedAfter", modified_after)
    return _as_raw(reader.text(path)).where(F.col("raw") != "")


def unwrap_payloads(df: DataFrame, column: str = "payload") -> DataFrame:
    """One row per item of each request body: a list, ``{"logs": [...]}``, ``{"events": [...]}``
    or a single object. Strings are raw lines, objects keep their JSON text.

    A body that is none of these comes out as one row, its text in ``raw`` and a ``payload_error``
    for the quarantine. An empty list gives no row.
    """
    listed = lambda name: (
        f"CASE WHEN startswith(get_json_object(body, '$.{name}'), '[') THEN from_json(body, '{name} array<string>').{name} END"
    )
    opened = computed(df, body=strip(column))
    # Parsing alone stops after the first value; inside brackets of either kind nothing may follow it.
    inside = " AND ".join(f"try_parse_json(concat('{a}', body, '{b}')) IS NOT NULL" for a, b in (('{"x":', "}"), ("[", "]")))
    opened = computed(opened, valid=f"coalesce(try_parse_json(body) IS NOT NULL AND {inside}, false)")
    opened = computed(opened, items=f"""CASE WHEN NOT valid THEN NULL
        WHEN startswith(body, '[') THEN from_json(body, 'array<string>')
        WHEN NOT startswith(body, '{{') THEN NULL
        WHEN array_contains(json_object_keys(body), 'logs') THEN {listed('logs')}
        WHEN array_contains(json_object_keys(body), 'events') THEN {listed('events')}
        ELSE array(body) END""")
    error = """CASE WHEN NOT valid THEN 'invalid json body' WHEN items IS NULL THEN 'body must be a JSON object or list' END"""
    opened = opened.selectExpr(*df.columns, "body", "items", f"{error} AS payload_error")
    rows = opened.selectExpr(
        *df.columns, "payload_error", "posexplode(CASE WHEN payload_error IS NULL THEN items ELSE array(body) END) AS (place, raw)")
    return rows.selectExpr(*df.columns, "payload_error", "CASE WHEN payload_error IS NULL THEN place END AS item", "raw")


def read_json_items(spark: SparkSession, path: str) -> DataFrame:
    """Lines and objects of JSON list files, with file, position in the list and arrival order.

    A file that is no list or envelope is one row with a ``payload_error``, which parsing puts into
    the quarantine.
    """
    bodies = spark.read.text(path, wholetext=True).select(
        F.col("value").alias("payload"), F.col("_metadata.file_path").alias("source_uri")
    )
    return unwrap_payloads(bodies).select(
        F.coalesce("raw", F.lit("None")).alias("raw"), "source_uri", F.col("item").cast("string").alias("position"),
        F.monotonically_increasing_id().alias("seq"), "payload_error",
    )


def size_quarantine(df: DataFrame, column: str, max_bytes: int) -> tuple[DataFrame, DataFrame]:
    """Rows within and over a size limit in UTF-8 bytes."""
    over: Column = F.coalesce(F.octet_length(column) > max_bytes, F.lit(False))
    return df.where(~over), df.where(over).withColumn("reason", F.lit("oversize"))
