"""Linking rows that share a value within a time gap, and the groups that result."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Observation, Window, functions as F

from palisade.session import stage


def value_rows(df: DataFrame, value_of: dict[str, Column], gap_us: int) -> DataFrame:
    """``id, us, kind, value, cell``: a row for each row and non-null attribute, and its time cell of the gap's length."""
    values = F.filter(
        F.array(*[F.struct(F.lit(kind).alias("kind"), col.cast("string").alias("value")) for kind, col in value_of.items()]),
        lambda v: v.getField("value").isNotNull(),
    )
    return df.select("id", "us", F.explode(values).alias("v")).select(
        "id", "us", "v.kind", "v.value", F.floor(F.col("us") / gap_us).alias("cell")
    )


def value_cells(rows: DataFrame, gap_us: int) -> DataFrame:
    """``kind, value, cell, first, last, start``: the first and last time in each cell of a value, and the cell in which the
    chain of cells begins that are linked to it."""
    cells = rows.groupBy("kind", "value", "cell").agg(F.min("us").alias("first"), F.max("us").alias("last"))
    by_value = Window.partitionBy("kind", "value").orderBy("cell")
    breaks = F.coalesce(F.col("first") - F.lag("last").over(by_value) > gap_us, F.lit(True))
    return cells.withColumn("start", F.when(breaks, F.col("cell"))).withColumn(
        "start", F.last("start", ignorenulls=True).over(by_value.rowsBetween(Window.unboundedPreceding, Window.currentRow))
    )


def chain_name() -> Column:
    return F.to_json(F.struct("kind", "value", "start"))


def chains(df: DataFrame, value_of: dict[str, Column], gap_us: int) -> DataFrame:
    """Link rows with the same value at most ``gap_us`` apart, for several attributes at once.

    Returns ``id, chain, kind``: one row per row and non-null attribute. Rows of one value in one
    time cell of the gap's length are always linked, and only neighbouring cells can be; so the
    sort runs over one row per value and cell (at most one per gap of the time span), never over
    all rows of a busy value.
    """
    rows = value_rows(df, value_of, gap_us)
    cells = value_cells(rows, gap_us).select("kind", "value", "cell", "start")
    return rows.join(cells, ["kind", "value", "cell"]).select("id", chain_name().alias("chain"), "kind")


def connected_components(edges: DataFrame) -> DataFrame:
    """``node, component`` of an undirected graph given as ``a, b`` pairs of any ordered type; a
    component is named by its smallest node. Loops (``a = b``) name single nodes.

    Every round links all larger neighbours of a node to its smallest neighbour, then all smaller
    ones likewise, which needs a number of rounds that grows with the logarithm of the graph; it
    goes on until a round changes nothing. A node's minimum is a map-side combined aggregate joined
    back to its edges, so a node with very many neighbours is never gathered in one place. Each
    round is written to the shared folder, and the writing job itself sums up the edges.
    """
    def written(pairs: DataFrame, name: str) -> tuple[DataFrame, tuple]:
        seen = Observation()
        at = F.pmod(F.xxhash64("a", "b"), F.lit(1 << 40))
        table = stage(pairs.observe(seen, F.count("*").alias("n"), F.sum(at).alias("sum")), name)
        return table, (seen.get["n"], seen.get["sum"]) if not table.isEmpty() else (0, None)

    pairs = edges.where(F.col("a") != F.col("b"))
    loops = edges.where(F.col("a") == F.col("b")).select(F.col("a").alias("node")).distinct()
    current, state = written(pairs.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "edges")
    i = 0
    while state[0]:
        both = current.unionByName(current.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("m", "a").alias("m"))
        large = both.join(least, "a").where("b > a AND b <> m").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()
        least = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).unionByName(
            least.select("a", F.col("m").alias("b"))
        )
        before = state
        current, state = written(small.where("a <> b").distinct(), f"round-{i}")
        if state == before:
            break
        i += 1
    roots = current.select(F.col("b").alias("a"), "b").distinct()
    found = current.unionByName(roots).select(F.col("a").alias("node"), F.col("b").alias("component"))
    return found.unionByName(
        loops.join(found, "node", "left_anti").select("node", F.col("node").alias("component"))
    )


def linked_groups(df: DataFrame, value_of: dict[str, Column], gap_us: int) -> DataFrame:
    """``id, component``: groups of rows linked directly or through others.

    Each row ties its chains together; the graph has one node per chain, not per row.
    """
    links = stage(chains(df, value_of, gap_us), "chains")
    ties = links.groupBy("id").agg(F.min("chain").alias("b"), F.array_distinct(F.collect_list("chain")).alias("cs"))
    edges = ties.select(F.explode("cs").alias("a"), "b").distinct()
    found = connected_components(edges)
    # Every chain of a row lies in one component, so any of them names it.
    return ties.select("id", F.col("b").alias("node")).join(found, "node").select("id", "component")


def first_copies(df: DataFrame, key: str, order: Sequence[Column]) -> DataFrame:
    """The first row of each key."""
    return df.groupBy(key).agg(F.min_by(F.struct(*df.columns), F.struct(*order)).alias("_r")).select("_r.*")
