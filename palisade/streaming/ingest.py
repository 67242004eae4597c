"""Streams into the event store."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame, SparkSession, Window, functions as F
from pyspark.sql.streaming import StreamingQuery

from palisade.plans.detect import run_detections
from palisade.rules import RULES, Rule
from palisade.session import run_dir, stage
from palisade.sources.normalize import parse_lines, quarantined, valid_events, with_positions
from palisade.sources.store import read_or_empty, read_store, save_events

# Arrival order across micro-batches: the batch number above the row's place in the batch. Places
# have no gaps, so this leaves room for 6.8e10 rows a batch and 1.3e8 batches.
PLACE_BITS = 36


def normalize_stream(lines: DataFrame, delay: str = "10 minutes", **options) -> DataFrame:
    """Events of a line stream that carries its own ``position``, each id once within ``delay``."""
    events = valid_events(parse_lines(lines, **options))
    return events.withWatermark("timestamp", delay).dropDuplicatesWithinWatermark(["id"])


def ingest_lines(lines: DataFrame, store: str, quarantine: str, checkpoint: str, available_now: bool = True,
                 **options) -> StreamingQuery:
    """Parse a stream of log files into the store; bad lines go to the quarantine.

    Lines with a ``position`` of their own (``follow_lines_at``) keep it. Others come a file in one
    micro-batch, so equal lines get the ids a batch read gives them. A batch that runs again after
    a failure stores nothing twice: known ids are skipped, and its quarantine folder is overwritten.
    """

    def save(batch: DataFrame, number: int) -> None:
        rows = batch.withColumn("seq", F.monotonically_increasing_id())
        placed = rows if "position" in batch.columns else with_positions(rows)
        parsed = numbered(stage(parse_lines(placed, **options), "parsed"), number)
        save_events(valid_events(parsed), store)
        quarantined(parsed).write.mode("overwrite").parquet(f"{quarantine}/batch={number}")

    return each_batch(lines, save, checkpoint, available_now)


def numbered(rows: DataFrame, batch: int) -> DataFrame:
    """Replace ``seq`` as ``monotonically_increasing_id`` gives it (partition and row) by the arrival
    order over all batches."""
    row = F.col("seq").bitwiseAND(F.lit((1 << 33) - 1))
    part = F.shiftright("seq", 33)
    sizes = rows.groupBy(part.alias("_part")).agg((F.max(row) + 1).alias("_size"))
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    # One row for each task that read the batch.
    starts = sizes.select("_part", F.coalesce(F.sum("_size").over(before), F.lit(0)).alias("_start"))
    placed = rows.withColumn("_part", part).join(F.broadcast(starts), "_part")
    return placed.withColumn("seq", F.lit(batch << PLACE_BITS) + F.col("_start") + row).select(*rows.columns)


LATE_SCHEMA = "id string, us bigint, user string, src_ip string, batch bigint"


def ingest_events(events: DataFrame, store: str, checkpoint: str, available_now: bool = True, late: str | None = None,
                  delay: str = "10 minutes") -> StreamingQuery:
    """Store a stream of event rows, each id once.

    With ``late``, rows more than ``delay`` older than the newest of earlier batches are noted there too: a stream of rules
    over the store with that delay drops no others, and ``alerts.repair_alerts`` starts from them. A batch that runs again
    writes its note over its own; rows that were stored before are noted as well.
    """

    def save(batch: DataFrame, number: int) -> None:
        if late is not None:
            _note_late(batch, number, late, delay)
        save_events(batch, store)

    return each_batch(events, save, checkpoint, available_now)


def _note_late(batch: DataFrame, number: int, late: str, delay: str) -> None:
    spark = batch.sparkSession
    rows = stage(batch.select("id", F.unix_micros("timestamp").alias("us"), "user", "src_ip"), "arrived")
    # One row a batch.
    clock = read_or_empty(spark, f"{late}/clock", "newest bigint, batch bigint").where(F.col("batch") < number)
    bound = clock.agg(F.max("newest")).scalar() - F.expr(f"unix_micros(timestamp_seconds(0) + INTERVAL {delay})")
    rows.where(F.col("us") < bound).write.mode("overwrite").parquet(f"{late}/rows/batch={number}")
    rows.agg(F.max("us").alias("newest")).write.mode("overwrite").parquet(f"{late}/clock/batch={number}")


def late_events(spark: SparkSession, late: str) -> DataFrame:
    """``id, us, user, src_ip, batch`` of the rows that came late."""
    return read_or_empty(spark, f"{late}/rows", LATE_SCHEMA)


def late_counts(spark: SparkSession, late: str) -> DataFrame:
    """``batch, n``: how many rows of each batch came late, batches without any included."""
    batches = read_or_empty(spark, f"{late}/clock", "newest bigint, batch bigint").select("batch")
    counts = late_events(spark, late).groupBy("batch").agg(F.count("*").alias("n"))
    return batches.join(counts, "batch", "left").select("batch", F.coalesce("n", F.lit(0)).alias("n"))


def each_batch(stream: DataFrame, save: Callable[[DataFrame, int], None], checkpoint: str, available_now: bool) -> StreamingQuery:
    writer = stream.writeStream.foreachBatch(save).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if available_now else writer).start()


def alerts_of_day(spark: SparkSession, store: str, first_day: str, last_day: str, rules: Sequence[Rule] = RULES) -> DataFrame:
    """The batch answer over a span of stored days, late events included."""
    days = F.col("event_date").between(first_day, last_day)
    return run_detections(read_store(spark, store).where(days), rules)


def to_table(stream: DataFrame, name: str) -> DataFrame:
    """Run a stream over all that is there now and read the written result."""
    spark = stream.sparkSession
    target = run_dir(spark, name)
    writer = stream.writeStream.format("parquet").option("path", f"{target}/data").option("checkpointLocation", f"{target}/checkpoint")
    writer.trigger(availableNow=True).start().awaitTermination()
    return spark.read.schema(stream.schema).parquet(f"{target}/data")
