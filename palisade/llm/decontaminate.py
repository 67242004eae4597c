"""Benchmark decontamination by size-partitioned MinHash containment search, in DataFrame operations only.

A document contains a test item if at least ``threshold`` of the item's distinct word shingles are among its own. Jaccard
similarity cannot see a short item in a long document, so only the item is sketched: its sketch holds the shingles with
the least hashes, and the document is probed with all its shingles. Items are partitioned by their number of shingles n;
with k = n - ceil(threshold * n) + 1 least hashes in the sketch of a partition's items, a document that contains the item
must hit its sketch, as no more than k - 1 shingles may be missing. Partitions of items larger than the document allows
fall out before that. Candidates are then verified by the shingles themselves.

Items are few and documents many: every document is reduced to the hits of its shingles in the sketches while it is read,
and only texts with a hit are looked at again. A text is known by two hashes of it, so copies are verified once.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from palisade.llm.common import narrow
from palisade.session import stage

#: Ratio of the sizes within one partition of the items.
GROWTH = 1.5


def words(text: Column) -> Column:
    """Words in lower case, in order."""
    whole = F.btrim(F.lower(F.coalesce(text, F.lit(""))), F.lit(" \t\n\x0b\f\r"))
    return F.when(whole == "", F.array().cast("array<string>")).otherwise(F.split(whole, r"[\x20\x09-\x0D]+"))


def _starts(tokens: str, shingle: int) -> str:
    return f"sequence(1, greatest(size({tokens}) - {shingle - 1}, least(size({tokens}), 1)), 1)"


def shingles(tokens: str, shingle: int) -> Column:
    """Distinct word shingles as texts; fewer words than ``shingle`` make one shingle, no word none."""
    return F.expr(f"CASE WHEN size({tokens}) = 0 THEN CAST(array() AS array<string>) ELSE "
                  f"array_distinct(transform({_starts(tokens, shingle)}, i -> array_join(slice({tokens}, i, {shingle}), ' '))) END")


def shingle_hashes(tokens: str, shingle: int) -> Column:
    """A hash of each word shingle, in order, repeats included."""
    return F.expr(f"CASE WHEN size({tokens}) = 0 THEN CAST(array() AS array<bigint>) ELSE "
                  f"transform({_starts(tokens, shingle)}, i -> xxhash64(slice({tokens}, i, {shingle}))) END")


def sketches(items: DataFrame, threshold: float, shingle: int) -> DataFrame:
    """``item, n, least, hash``: the MinHash sketch of each item, a row a hash. ``least`` is the number of distinct shingles
    that a document needs for the smallest item of the partition."""
    # Rounding up must not be fooled by 0.8 * 35 = 28.000000000000004.
    need = F.ceil(F.round(F.col("n") * threshold, 9))
    sized = items.select("item", "shingles", F.size("shingles").alias("n")).where("n > 0").withColumn(
        "part", F.floor(F.log("n") / F.log(F.lit(GROWTH)))).withColumn("need", need)
    smallest = sized.groupBy("part").agg(F.min("need").alias("least"))
    hashed = F.expr(f"array_sort(transform(shingles, s -> xxhash64(split(s, ' '))))")
    return sized.join(smallest, "part").select(
        "item", "n", "need", "least", F.explode(F.slice(hashed, F.lit(1), (F.col("n") - F.col("need") + 1).cast("int"))).alias("hash"))


def contaminated(docs: DataFrame, benchmark: DataFrame, threshold: float = 0.8, shingle: int = 5, text: str = "text",
                 doc_id: str = "doc_id", item_id: str = "item_id", item_text: str = "text") -> DataFrame:
    """``doc_id, k1, k2, item_id, n_shingles, found, containment``: one row for each row of ``docs`` and each benchmark item
    that its text contains; ``k1, k2`` are two hashes of the text.

    Null and empty texts contain nothing; an item without words is contained in nothing. A text of fewer words than
    ``shingle`` is one shingle, found only as a whole text. Repeated rows give repeated results, and so do repeated items.
    Null ids are passed on. If either table is empty, so is the result. Other columns are not looked at.
    """
    rows = narrow(docs, doc_id=doc_id, text=text).select("doc_id", "text", *text_keys(F.col("text")))
    found = contained_texts(rows, benchmark, threshold, shingle, item_id, item_text)
    return rows.drop("text").join(found, ["k1", "k2"]).select("doc_id", "k1", "k2", "item_id", "n_shingles", "found", "containment")


def text_keys(text: Column) -> list[Column]:
    return [F.xxhash64(text).alias("k1"), F.xxhash64(F.lit("second"), text).alias("k2")]


def contained_texts(rows: DataFrame, benchmark: DataFrame, threshold: float, shingle: int, item_id: str, item_text: str) -> DataFrame:
    """``k1, k2, item_id, n_shingles, found, containment`` for the distinct texts of ``rows`` (``text, k1, k2``)."""
    # Items with the same text are one item to search for.
    items = stage(narrow(benchmark, item_id=item_id, text=item_text).withColumn("tokens", words(F.col("text"))).select(
        "item_id", shingles("tokens", shingle).alias("shingles")).withColumn("item", F.xxhash64("shingles")), "items")
    kinds = items.dropDuplicates(["item"]).select("item", "shingles")
    sketch = stage(sketches(kinds, threshold, shingle), "sketches")
    tokens = rows.select("k1", "k2", words(F.col("text")).alias("tokens"))
    probes = tokens.select("k1", "k2", F.size("tokens").alias("words"), F.explode(shingle_hashes("tokens", shingle)).alias("hash"))
    # A document has at most (words - shingle + 1) distinct shingles, one at least.
    hits = probes.join(sketch, "hash").where(f"greatest(words - {shingle - 1}, 1) >= least AND greatest(words - {shingle - 1}, 1) >= need")
    candidates = stage(hits.select("k1", "k2", "item").distinct(), "candidates")
    texts = candidates.select("k1", "k2").distinct()
    again = rows.join(texts, ["k1", "k2"]).dropDuplicates(["k1", "k2"]).withColumn("tokens", words(F.col("text")))
    own = again.select("k1", "k2", shingles("tokens", shingle).alias("own"))
    both = own.join(candidates, ["k1", "k2"]).join(kinds, "item")
    count = F.size(F.array_intersect("shingles", "own"))
    exact = both.select("k1", "k2", "item", F.size("shingles").alias("n_shingles"), count.alias("found")).where(
        F.col("found") >= F.ceil(F.round(F.col("n_shingles") * threshold, 9)))
    named = stage(exact, "contained").join(items.select("item", "item_id"), "item")
    return named.select("k1", "k2", "item_id", "n_shingles", "found", (F.col("found") / F.col("n_shingles")).alias("containment"))


def decontaminate(docs: DataFrame, benchmark: DataFrame, threshold: float = 0.8, shingle: int = 5, text: str = "text",
                  item_id: str = "item_id", item_text: str = "text") -> DataFrame:
    """The rows of ``docs``, all columns, whose text contains no benchmark item."""
    k1, k2 = text_keys(F.col(f"`{text}`"))
    rows = docs.select(F.col(f"`{text}`").alias("text"), k1, k2)
    bad = contained_texts(rows, benchmark, threshold, shingle, item_id, item_text).select(
        F.col("k1").alias("bad1"), F.col("k2").alias("bad2")).distinct()
    # The input's columns travel as one, so none of them can clash.
    marked = docs.select(F.struct("*").alias("row"), k1.alias("own1"), k2.alias("own2"))
    return marked.join(bad, (F.col("own1") == F.col("bad1")) & (F.col("own2") == F.col("bad2")), "left_anti").select("row.*")
