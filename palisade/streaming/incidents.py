"""Incidents kept up to date batch by batch, at a cost that goes with the batch and not with what is stored.

What is stored of an incident is cut by day: its alerts, which incident each was placed in, and its value cells (a value, a half
hour, the first and last time in it). A new alert can only touch cells of its own half hour and its neighbours, so a batch reads
the cells of its own days. Where it ties stored incidents together, nothing of them is read or rewritten: a merge from the one's
name to the other's is noted, under the day that begins the name. Readers follow the merges.

Every batch writes under its own number, over what a run of it that broke off may have left, and reads only earlier numbers.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, functions as F, types as T
from pyspark.sql.streaming import StreamingQuery

from palisade.functions.columns import present
from palisade.operators.components import chain_name, connected_components, value_cells, value_rows
from palisade.plans.correlate import GAP_US
from palisade.schema import ALERT_SCHEMA
from palisade.session import stage
from palisade.sources.store import read_or_empty
from palisade.streaming.ingest import each_batch

PLACE = "day string, batch bigint"
ALERTS = T.StructType([*ALERT_SCHEMA.fields, T.StructField("day", T.StringType()), T.StructField("batch", T.LongType())])
MEMBERS = f"alert_id string, component string, {PLACE}"
CELLS = f"kind string, value string, cell bigint, first bigint, last bigint, component string, {PLACE}"
MERGES = f"component string, into string, {PLACE}"
KINDS = ["asset", "user", "src_ip", "tactic"]
#: Begins the names of what is new in a batch; names of incidents begin with a date, which sorts before it.
NEW = "~"


def read_alerts(spark: SparkSession, path: str) -> DataFrame:
    return read_or_empty(spark, path, ALERTS).select(*ALERT_SCHEMA.names)


def current_members(spark: SparkSession, path: str) -> DataFrame:
    """``alert_id, component`` of all alerts placed so far, merges followed."""
    members = read_or_empty(spark, f"{path}/members", MEMBERS).select("alert_id", "component")
    merges = read_or_empty(spark, f"{path}/merges", MERGES)
    if merges.isEmpty():
        return members
    # Merges lead to the smaller name, so an incident's last name is the smallest that hangs together with it.
    names = connected_components(merges.select(F.col("component").alias("a"), F.col("into").alias("b")))
    final = names.select(F.col("node").alias("component"), F.col("component").alias("final"))
    return members.join(final, "component", "left").select("alert_id", F.coalesce("final", "component").alias("component"))


def read_days(spark: SparkSession, path: str, days: Sequence[str], schema: T.StructType | str, before: int) -> DataFrame:
    """What batches before the given one wrote under some days; nothing else is listed or read."""
    files = spark._jvm.org.apache.hadoop.fs
    found = []
    for day in days:
        place = files.Path(f"{path}/day={day}")
        if place.getFileSystem(spark._jsc.hadoopConfiguration()).exists(place):
            found.append(f"{path}/day={day}")
    if not found:
        return spark.createDataFrame([], schema)
    return spark.read.schema(schema).option("basePath", path).parquet(*found).where(F.col("batch") < before)


def _write(rows: DataFrame, path: str, batch: int) -> None:
    # Rebalancing splits a busy day over several files; without it every task writes a file for each of its days.
    rows.withColumn("batch", F.lit(batch).cast("bigint")).hint("rebalance", "day").write.mode("overwrite").option(
        "partitionOverwriteMode", "dynamic").partitionBy("day", "batch").parquet(path)


def _day(us: str = "us") -> Column:
    return F.date_format(F.timestamp_micros(us), "yyyy-MM-dd")


def _days(rows: DataFrame, column: str = "day") -> list[str]:
    """The distinct days of some rows: as many as the batch spans."""
    return sorted(r[0] for r in rows.select(column).where(F.col(column).isNotNull()).distinct().collect())


def add_alerts(alerts: DataFrame, alerts_path: str, members_path: str, batch: int) -> None:
    """Store the alerts of a batch that are not stored yet, and place them in incidents, which may grow together."""
    spark = alerts.sparkSession
    rows = stage(alerts.select(*ALERT_SCHEMA.names).dropDuplicates(["alert_id"]).withColumns(
        {"us": F.unix_micros("timestamp"), "day": F.date_format("timestamp", "yyyy-MM-dd")}), "arrived-alerts")
    # An id hashes the alert's events, so a copy has its time and is stored under its day.
    stored = read_days(spark, alerts_path, _days(rows), ALERTS, batch).select("alert_id")
    fresh = stage(rows.join(stored, "alert_id", "left_anti"), "new-alerts")
    if fresh.isEmpty():
        return
    tactic = F.coalesce(F.concat(F.lit("="), F.col("tactic")), F.lit("null"))
    values = value_rows(fresh.withColumnRenamed("alert_id", "id"), {
        "asset": present("asset"), "user": present("user"), "src_ip": present("src_ip"), "tactic": tactic}, GAP_US)
    values = stage(values, "new-values")
    cells = stage(value_cells(values, GAP_US).withColumn("chain", F.concat(F.lit(NEW), chain_name())), "new-cells")
    links = values.join(cells.select("kind", "value", "cell", "chain"), ["kind", "value", "cell"]).select("id", "chain")
    ties = stage(links.groupBy("id").agg(F.min("chain").alias("b"), F.array_distinct(F.collect_list("chain")).alias("cs")), "ties")
    touched = stage(_touched(spark, members_path, cells, batch), "touched")
    edges = ties.select(F.explode("cs").alias("a"), "b").unionByName(touched.select(F.col("chain").alias("a"), F.col("root").alias("b")))
    placed = stage(connected_components(edges.distinct()), "placed")
    # An incident that is new is named by the day and a hash of its smallest chain.
    own = cells.groupBy("chain").agg(F.min("first").alias("us")).withColumnRenamed("chain", "component")
    named = placed.join(own, "component", "left").select("node", F.when(
        F.startswith("component", F.lit(NEW)), F.concat(_day(), F.lit("/"), F.sha2("component", 256))).otherwise(F.col("component")).alias("component"))
    named = stage(named, "named")
    new = named.where(F.startswith("node", F.lit(NEW)))
    members = ties.select(F.col("id").alias("alert_id"), F.col("b").alias("node")).join(new, "node").select("alert_id", "component")
    _write(members.join(fresh.select("alert_id", "day"), "alert_id"), f"{members_path}/members", batch)
    _write(cells.join(new.withColumnRenamed("node", "chain"), "chain").select(
        "kind", "value", "cell", "first", "last", "component", _day("first").alias("day")), f"{members_path}/cells", batch)
    merged = named.where(~F.startswith("node", F.lit(NEW)) & (F.col("node") != F.col("component")))
    _write(merged.select(F.col("node").alias("component"), F.col("component").alias("into"), F.split("node", "/")[0].alias("day")),
           f"{members_path}/merges", batch)
    _write(fresh.drop("us"), alerts_path, batch)


def _touched(spark: SparkSession, members_path: str, cells: DataFrame, batch: int) -> DataFrame:
    """``chain, root``: the stored incidents that new chains reach, by the names they go by now."""
    reach = F.explode(F.array(F.col("first") - GAP_US, F.col("first"), F.col("last"), F.col("last") + GAP_US))
    days = _days(cells.select(reach.alias("us")).select(_day().alias("day")))
    stored = read_days(spark, f"{members_path}/cells", days, CELLS, batch).select(
        "kind", "value", F.col("cell").alias("at"), F.col("first").alias("old_first"), F.col("last").alias("old_last"), "component")
    near = cells.withColumn("at", F.explode(F.sequence(F.col("cell") - 1, F.col("cell") + 1)))
    found = near.join(stored, ["kind", "value", "at"]).where(
        (F.col("at") == F.col("cell")) | ((F.col("at") < F.col("cell")) & (F.col("first") - F.col("old_last") <= GAP_US))
        | ((F.col("at") > F.col("cell")) & (F.col("old_first") - F.col("last") <= GAP_US)))
    found = found.select("chain", F.col("component").alias("root")).distinct()
    while True:
        found = stage(found, "roots")
        days = _days(found.select(F.split("root", "/")[0].alias("day")))
        merges = read_days(spark, f"{members_path}/merges", days, MERGES, batch).select(F.col("component").alias("root"), "into").distinct()
        moved = found.join(merges, "root")
        if moved.isEmpty():
            return found
        found = found.join(merges, "root", "left").select("chain", F.coalesce("into", "root").alias("root")).distinct()


def follow_incidents(alerts: DataFrame, alerts_path: str, members_path: str, checkpoint: str,
                     available_now: bool = True) -> StreamingQuery:
    """Keep the alert and incident tables up to date from a stream of alert rows."""
    return each_batch(alerts, lambda batch, n: add_alerts(batch, alerts_path, members_path, n), checkpoint, available_now)
