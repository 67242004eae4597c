"""Mixing sources to target weights by Pareto order sampling, in DataFrame operations only.

A source's share of the mix is a target in words. ``target / size`` is the number of copies its words have on average: the
whole copies are certain for each document, and what is left, f, is met by one more copy of some. That copy goes rather to
short documents, so that the mix repeats many texts and not a few long ones: with m the share of the source's words in
documents of lower length bands (half of the own band's words included) a document's inclusion probability is
p = f (1 + lean (1 - 2 m)). Over the words of a source m is 1/2 on average, so the expected words are those left of the target.
Documents are ranked by the odds of a random number over the odds of p, and the first ones are taken until their words fill
what is left, so the size of the sample is fixed (to half a document) and not a matter of chance.

No source is sorted as a whole: ranks are summed up in ever finer ranges, and only the range in which the target falls is
looked at again. Only its last, tiny range is ordered document by document.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from palisade.llm.common import narrow
from palisade.session import stage

#: Ranges that a range of ranks is cut into, and how often.
RANGES, ROUNDS = 4096, 2
#: How much of what keeps all probabilities between 0 and 1 they lean to short documents.
LEAN = 0.5
#: Digits of the random number; its range.
DIGITS, SPAN = 12, 16**12


def word_count(text: Column) -> Column:
    """Words of a text; 0 for null."""
    whole = F.btrim(F.coalesce(text, F.lit("")), F.lit(" \t\n\x0b\f\r"))
    return F.when(whole == "", 0).otherwise(F.size(F.split(whole, r"[\x20\x09-\x0D]+"))).cast("long")


def source_targets(sizes: DataFrame, weights: tuple[int, ...] = (5, 2, 1), share: tuple[int, int] = (3, 2), most: int = 2) -> DataFrame:
    """``source, source_size, target`` from ``source, source_size``.

    Sources in code point order, null last, have the weights in turn and share ``share`` (a fraction) of all sizes. No
    target exceeds ``most`` times its source's size: with sources ordered by size over weight, those that reach the limit
    are a prefix, which running sums find in one pass. The table has a row a source.
    """
    by_name = Window.orderBy(F.isnull("source"), "source")
    turn = F.expr(f"element_at(array({', '.join(f'{w}L' for w in weights)}), CAST((n - 1) % {len(weights)} + 1 AS INT))")
    named = sizes.withColumn("n", F.row_number().over(by_name)).withColumn("weight", turn).withColumn("cap", most * F.col("source_size"))
    # ratio of cap to weight, then the name, fixes the order in which sources fill up.
    by_fill = Window.orderBy(F.col("cap").cast("double") / F.col("weight"), "n")
    before = by_fill.rowsBetween(Window.unboundedPreceding, -1)
    up, down = share
    left = F.lit(up) * F.sum("source_size").over(Window.partitionBy()) - F.lit(down) * F.coalesce(F.sum("cap").over(before), F.lit(0))
    weight_left = F.sum("weight").over(Window.partitionBy()) - F.coalesce(F.sum("weight").over(before), F.lit(0))
    filled = named.withColumn("left", left).withColumn("weight_left", weight_left * down)
    # left / weight_left is the level if this source and all after it are not capped.
    filled = filled.withColumn("over", F.col("left").cast("double") * F.col("weight") > F.col("cap").cast("double") * F.col("weight_left"))
    level = F.first(F.when(~F.col("over"), F.struct("left", "weight_left")), ignorenulls=True).over(
        by_fill.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
    filled = filled.withColumn("level", level)
    target = F.when(F.col("over") | F.isnull("level"), F.col("cap").cast("double")).otherwise(
        (F.col("level.left") * F.col("weight")).cast("double") / F.col("level.weight_left").cast("double"))
    return filled.select("source", "source_size", target.alias("target"))


def inclusion(words: DataFrame, weights: tuple[int, ...], share: tuple[int, int], most: int) -> DataFrame:
    """``source, band, source_size, target, certain, p, need`` from ``source, band, words``: the certain copies of a document of a
    length band (binary digits of its size), the probability of one more, and the words of a source that these are to fill."""
    targets = source_targets(words.groupBy("source").agg(F.sum("words").alias("source_size")), weights, share, most)
    expected = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0)
    targets = targets.withColumn("certain", F.least(F.floor(expected), F.lit(most))).withColumn("f", expected - F.col("certain"))
    plan = words.join(targets.withColumnRenamed("source", "_source"), F.col("source").eqNullSafe(F.col("_source"))).drop("_source")
    before = Window.partitionBy("source").orderBy("band").rowsBetween(Window.unboundedPreceding, -1)
    middle = (F.coalesce(F.sum("words").over(before), F.lit(0)) + F.col("words") / 2) / F.col("source_size")
    lean = LEAN * F.least(F.lit(1.0), (1 - F.col("f")) / F.col("f"))
    plan = plan.withColumn("middle", F.when(F.col("f") > 0, middle))
    p = F.when(F.col("f") > 0, F.col("f") * (1 + lean * (1 - 2 * F.col("middle")))).otherwise(0.0)
    return plan.select("source", "band", "source_size", "target", "certain", p.alias("p"),
                       (F.col("target") - F.col("certain") * F.col("source_size")).alias("need"))


def row_keys(doc_id: Column, source: Column, text: Column) -> tuple[Column, Column]:
    return F.xxhash64(doc_id, source, text), F.xxhash64(F.lit("second"), doc_id, source, text)


def mix(docs: DataFrame, weights: tuple[int, ...] = (5, 2, 1), share: tuple[int, int] = (3, 2), most: int = 2, text: str = "text",
        doc_id: str = "doc_id", source: str = "source") -> DataFrame:
    """One row per input row: ``doc_id, source, k1, k2, size, source_size, target, copies, taken``.

    ``k1, k2`` are hashes of doc_id, source and text, ``size`` counts the words of the text (null: 0), ``copies`` how often the document is in the mix, and ``taken`` is
    ``copies * size``. A null source is a source of its own. Random numbers derive from doc_id and text, so reruns agree;
    repeated rows have the same number, and if the target falls among them some are taken and some not. Documents without
    words have size 0 and take nothing. An empty table gives an empty result. Other columns are not looked at.
    """
    rows = narrow(docs, doc_id=doc_id, text=text, source=source)
    key = F.md5(F.concat_ws("|", F.lit("mix"), F.col("doc_id").cast("string"), F.md5("text")))
    k1, k2 = row_keys(F.col("doc_id"), F.col("source"), F.col("text"))
    rows = stage(rows.select(
        "doc_id", "source", k1.alias("k1"), k2.alias("k2"), word_count(F.col("text")).alias("size"),
        ((F.conv(F.substring(key, 1, DIGITS), 16, 10).cast("double") + 0.5) / SPAN).alias("u")).withColumn("band", F.length(F.bin("size"))), "sizes")
    words = stage(rows.groupBy("source", "band").agg(F.sum("size").alias("words")), "bands")
    plan = stage(inclusion(words, weights, share, most), "inclusion")
    renamed = plan.withColumnsRenamed({"source": "_source", "band": "_band"})
    both = rows.join(renamed, F.col("source").eqNullSafe(F.col("_source")) & (F.col("band") == F.col("_band")), "left").drop("_source", "_band")
    # Odds of the random number over odds of inclusion, q; the rank q / (1 + q) lies between 0 and 1.
    q = F.col("u") / (1 - F.col("u")) * (1 - F.col("p")) / F.col("p")
    rank = F.when(F.col("p") > 0, q / (1 + q)).otherwise(1.0)
    ranked = both.withColumn("rank", rank).withColumn(
        "place", F.least(F.floor(F.col("rank") * RANGES**ROUNDS), F.lit(RANGES**ROUNDS - 1)))
    edge = _edges(ranked)
    decided = ranked.join(edge, ranked["source"].eqNullSafe(edge["_source"]), "left").drop("_source")
    clear = decided.where(F.col("edge").isNull() | (F.col("place") != F.col("edge"))).withColumn("extra", F.col("place") < F.coalesce("edge", F.lit(-1)))
    # Whoever is in the last range is taken while the middle of it still fits.
    order = Window.partitionBy("source").orderBy("rank", "doc_id", "k1", "k2")
    before = F.coalesce(F.sum("size").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)) + F.col("before")
    close = decided.where("place = edge").withColumn("extra", before + F.col("size") / 2 <= F.col("need"))
    done = clear.unionByName(close).withColumn("copies", (F.col("certain") + F.col("extra").cast("long")).cast("long"))
    return done.select("doc_id", "source", "k1", "k2", "size", "source_size", "target", "copies", (F.col("copies") * F.col("size")).alias("taken"))


def _edges(ranked: DataFrame) -> DataFrame:
    """``_source, edge, before``: for each source with a sampled part the range of ranks in which its need is met, and the
    words in the ranges below it. Sums of at most RANGES ranges of each source are ordered at a time."""
    edge, sampled = None, ranked.where("p > 0")
    for depth in range(1, ROUNDS + 1):
        step = RANGES ** (ROUNDS - depth)
        now = sampled.withColumn("range", F.expr(f"place div {step}"))
        if edge is not None:
            near = edge.withColumnRenamed("edge", "inside")
            now = now.join(near, now["source"].eqNullSafe(near["_source"]) & (F.expr(f"range div {RANGES}") == F.col("inside")))
        else:
            now = now.withColumn("before", F.lit(0).cast("long"))
        sums = now.groupBy("source", "range").agg(F.sum("size").alias("words"), F.first("need").alias("need"), F.first("before").alias("start"))
        upto = Window.partitionBy("source").orderBy("range")
        total = F.col("start") + F.sum("words").over(upto.rowsBetween(Window.unboundedPreceding, Window.currentRow))
        sums = sums.withColumn("total", total).where(F.col("total") >= F.col("need"))
        first = sums.groupBy("source").agg(F.min_by(F.struct(F.col("range").alias("edge"), (F.col("total") - F.col("words")).alias("before")), "range").alias("e"))
        edge = stage(first.select(F.col("source").alias("_source"), "e.edge", "e.before"), f"edges-{depth}")
    return edge


def expand(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", source: str = "source", **options) -> DataFrame:
    """The rows of ``docs``, all columns, as often as the mix takes them, and ``copy`` from 1 (``copy_`` and so on where the input
    has such a column).

    Rows alike in doc_id, source and text share what the mix takes of them as evenly as whole copies allow, in the order of a
    hash of their other columns.
    """
    taken = mix(docs, text=text, doc_id=doc_id, source=source, **options).groupBy("k1", "k2").agg(
        F.sum("copies").alias("copies"), F.count("*").alias("alike"))
    plan = stage(taken.where("copies > 0"), "copies")
    k1, k2 = row_keys(*[F.col(f"`{c}`") for c in (doc_id, source, text)])
    # The input's columns travel as one, so none of them can clash.
    rows = docs.select(F.struct("*").alias("row"), k1.alias("k1"), k2.alias("k2")).join(plan, ["k1", "k2"])
    order = F.when(F.col("alike") > 1, F.xxhash64(F.to_json("row")))
    turn = F.row_number().over(Window.partitionBy("k1", "k2").orderBy(order))
    own = F.expr("CAST(copies div alike AS INT)") + (turn <= F.col("copies") % F.col("alike")).cast("int")
    name = "copy"
    while name in {c.lower() for c in docs.columns}:
        name += "_"
    counted = rows.withColumn("own", own).where("own > 0").select("row", F.explode(F.expr("sequence(1, own)")).alias("_n"))
    return counted.select("row.*", F.col("_n").alias(name))
