"""Counts of what a stream of lines came to, batch by batch, while it runs.

The counts are taken by the batch's own job (``observe``), so no line is read for them again; a listener writes them to a table
as batches end.
"""

from __future__ import annotations

import threading

from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.streaming import StreamingQueryListener

from palisade.sources.store import read_or_empty

COUNTS = ["parsed_events", "parsing_failed_events", "unknown_events"]
SCHEMA = "parsed_events bigint, parsing_failed_events bigint, unknown_events bigint"


def counted(parsed: DataFrame, name: str = "parsing") -> DataFrame:
    """Parsed lines as they are, their outcomes counted under a name that the listener knows."""
    failed, unknown = F.expr("reason IS NOT NULL"), F.expr("format = 'unknown'")
    return parsed.observe(
        name, F.count_if(~failed & ~unknown).alias("parsed_events"), F.count_if(failed).alias("parsing_failed_events"),
        F.count_if(~failed & unknown).alias("unknown_events"))


class ParsingCounters(StreamingQueryListener):
    """Writes the counts of every batch of the queries that observe under ``name``: one row under query and batch, over what an
    earlier run of that batch wrote. Add it with ``spark.streams.addListener``."""

    def __init__(self, spark: SparkSession, path: str, name: str = "parsing"):
        super().__init__()
        self.spark, self.path, self.name = spark, path, name
        self.ended: set[str] = set()
        self.change = threading.Condition()

    def onQueryStarted(self, event) -> None:
        """Nothing to count yet."""

    def onQueryProgress(self, event) -> None:
        progress = event.progress
        row = progress.observedMetrics.get(self.name)
        if row is not None:
            counts = self.spark.createDataFrame([tuple(int(row[c] or 0) for c in COUNTS)], SCHEMA)
            counts.write.mode("overwrite").parquet(f"{self.path}/query={progress.id}/batch={progress.batchId}")

    def onQueryIdle(self, event) -> None:
        """No batch, no counts."""

    def onQueryTerminated(self, event) -> None:
        with self.change:
            self.ended.add(str(event.runId))
            self.change.notify_all()

    def wait_for(self, run_id: str, seconds: float = 60.0) -> bool:
        """Until all batches of a query that has ended are written; progress comes a moment after the query."""
        with self.change:
            return self.change.wait_for(lambda: str(run_id) in self.ended, seconds)


def counts_by_batch(spark: SparkSession, path: str) -> DataFrame:
    """``query, batch`` and the counts."""
    rows = read_or_empty(spark, path, f"{SCHEMA}, query string, batch bigint")
    return rows.select("query", "batch", *COUNTS)


def totals(spark: SparkSession, path: str) -> DataFrame:
    """One row: the counts of all batches together."""
    rows = counts_by_batch(spark, path)
    return rows.agg(*[F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in COUNTS])
