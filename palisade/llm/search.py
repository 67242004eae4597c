"""Ranked lexical search of all documents by dense blocked matrix products.

An item's score of a document sums weight * impact over the terms they share: whole numbers. Items of a tile (rows of 0 and 1
over the tile's vocabulary) times documents of a tile (columns of weight * impact) is one float64 product of dense matrices
for each block of the vocabulary. Blocks are sized so that every partial sum stays below 2**53, where float64 holds whole
numbers exactly; blocks add up in 64-bit integers. Of each product a tile keeps, for each item, the k best documents with all
ties at the k-th place, then cuts ties by doc_id; a task keeps k rows an item, and they meet in two steps of grouping.

Texts are read once a batch of items: terms of the batch's vocabulary and their counts are written, and document frequencies
and lengths come from that table. A batch holds the terms of about ``BATCH_TERMS`` words of items, so what is shipped to the
executors is bounded; more items make more batches. Documents are never collected.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import partial, reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from palisade.llm.common import blocks, bytes_and_bounds, narrow, plain_words
from palisade.session import stage

#: Terms of the items of one batch, items and documents of a tile, terms of a vocabulary block, first step's groups an item.
BATCH_TERMS, ITEM_TILE, DOC_TILE, TERM_BLOCK, SPREAD = 1 << 18, 256, 512, 2048, 64
EXACT = 1 << 53


def _term_rows(batches: Iterator[pa.RecordBatch], vocabulary: dict[bytes, int]) -> Iterator[pa.RecordBatch]:
    """Each document's number of terms, and its terms of the vocabulary with their counts."""
    for batch in batches:
        n, terms, counts = [], [], []
        for text in batch.column("text"):
            words = plain_words(text.as_py())
            known = np.array([vocabulary[w] for w in words if w in vocabulary], np.int32)
            term, count = np.unique(known, return_counts=True)
            n.append(len(words))
            terms.append(term.astype(np.int32).tobytes())
            counts.append(count.astype(np.int32).tobytes())
        yield pa.RecordBatch.from_arrays(
            [batch.column("doc_id"), pa.array(n, pa.int64()), pa.array(terms, pa.binary()), pa.array(counts, pa.binary())],
            ["doc_id", "n", "terms", "counts"])


def _holders(batches: Iterator[pa.RecordBatch], size: int) -> Iterator[pa.RecordBatch]:
    total = np.zeros(size, np.int64)
    for batch in batches:
        total += np.bincount(bytes_and_bounds(batch.column("terms"))[0].view(np.int32), minlength=size)
    held = np.flatnonzero(total)
    yield pa.RecordBatch.from_arrays([pa.array(held, pa.int64()), pa.array(total[held], pa.int64())], ["term", "df"])


class Tile:
    """Items of one tile: the terms that they use, and rows of 0 and 1 over those terms."""

    def __init__(self, items: list[tuple[int, list[int]]], weights: np.ndarray, first: int):
        self.first, self.n = first, len(items)
        self.terms = np.array(sorted({t for _, terms in items for t in terms}), np.int64)
        self.rows = np.zeros((len(items), len(self.terms)))
        for row, (_, terms) in enumerate(items):
            self.rows[row, np.searchsorted(self.terms, terms)] = 1
        self.local = np.full(len(weights), -1, np.int64)
        self.local[self.terms] = np.arange(len(self.terms))
        # An impact is below 10**9 / 1000, so no sum over a block of so many terms reaches 2**53.
        heaviest = int(weights[self.terms].max(initial=0)) * 1_000_000
        self.block = max(1, min(TERM_BLOCK, EXACT // max(1, heaviest) - 1))

    def scores(self, term: np.ndarray, doc: np.ndarray, value: np.ndarray, docs: int) -> np.ndarray:
        """items x documents, exact: ``value`` is the weighted impact of ``term`` in document number ``doc``."""
        total = np.zeros((self.n, docs), np.int64)
        at = self.local[term]
        for low in range(0, len(self.terms), self.block):
            high = min(low + self.block, len(self.terms))
            here = (at >= low) & (at < high)
            if here.any():
                impacts = np.zeros((high - low, docs))
                impacts[at[here] - low, doc[here]] = value[here]
                total += (self.rows[:, low:high] @ impacts).astype(np.int64)
        return total


class Best:
    """The k best documents of each item of a tile so far."""

    def __init__(self, items: int, k: int):
        self.k = k
        self.score, self.doc = np.zeros((items, k), np.int64), np.zeros((items, k), np.int64)

    def add(self, scores: np.ndarray, docs: np.ndarray) -> None:
        # A row that reaches the k-th score so far may still win by its doc_id; 0 is no score.
        row, col = np.nonzero((scores >= self.score[:, -1:]) & (scores > 0))
        if not len(row):
            return
        touched = np.unique(row)
        old_row, old_col = np.nonzero(self.score[touched])
        item = np.concatenate([row, touched[old_row]])
        score = np.concatenate([scores[row, col], self.score[touched[old_row], old_col]])
        doc = np.concatenate([docs[col], self.doc[touched[old_row], old_col]])
        order = np.lexsort((doc, -score, item))
        item, score, doc = item[order], score[order], doc[order]
        rank = np.arange(len(item)) - np.searchsorted(item, item)
        kept = rank < self.k
        self.score[touched] = 0
        self.score[item[kept], rank[kept]] = score[kept]
        self.doc[item[kept], rank[kept]] = doc[kept]

    def rows(self, first: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        item, rank = np.nonzero(self.score)
        return item + first, self.doc[item, rank], self.score[item, rank]


def _rank_rows(batches: Iterator[pa.RecordBatch], items: list[tuple[int, list[int]]], weights: np.ndarray, total_docs: int,
               total_terms: int, k: int) -> Iterator[pa.RecordBatch]:
    tiles = [Tile(items[i : i + ITEM_TILE], weights, i) for i in range(0, len(items), ITEM_TILE)]
    best = [Best(tile.n, k) for tile in tiles]
    for whole in batches:
        for low in range(0, whole.num_rows, DOC_TILE):
            batch = whole.slice(low, DOC_TILE)
            term, bounds = bytes_and_bounds(batch.column("terms"))
            term, tf = term.view(np.int32), bytes_and_bounds(batch.column("counts"))[0].view(np.int32).astype(np.int64)
            doc = np.repeat(np.arange(batch.num_rows), np.diff(bounds) // 4)
            # Python's own whole numbers: n * N may pass 64 bits before the division.
            m = np.array([50 + 50 * n * total_docs // total_terms for n in batch.column("n").to_pylist()], np.int64)
            value = weights[term] * (1_000_000_000 * tf // (1000 * tf + 20 * m[doc]))
            ids = batch.column("doc_id").to_numpy()
            for tile, kept in zip(tiles, best):
                mine = tile.local[term] >= 0
                if mine.any():
                    kept.add(tile.scores(term[mine], doc[mine], value[mine], batch.num_rows), ids)
    found = [kept.rows(tile.first) for tile, kept in zip(tiles, best)]
    item, doc, score = (np.concatenate(c) for c in zip(*found))
    yield pa.RecordBatch.from_arrays([pa.array(item, pa.int64()), pa.array(doc, pa.int64()), pa.array(score, pa.int64())],
                                     ["item", "doc_id", "score"])


def _item_terms(items: DataFrame) -> DataFrame:
    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            terms = [sorted(set(plain_words(t.as_py()))) for t in batch.column("text")]
            yield pa.RecordBatch.from_arrays([batch.column("item_id"), pa.array(terms, pa.list_(pa.binary()))], ["item_id", "terms"])

    rows = items.select("item_id", F.coalesce("text", F.lit("")).cast("binary").alias("text"))
    kind = items.schema["item_id"].dataType.simpleString()
    return rows.mapInArrow(cut, f"item_id {kind}, terms array<binary>")


def _search_batch(docs: DataFrame, items: list[tuple[object, list[bytes]]], k: int, item_kind: str) -> DataFrame:
    spark = docs.sparkSession
    vocabulary = {t: i for i, t in enumerate(sorted({t for _, terms in items for t in terms}))}
    numbered = [(i, [vocabulary[t] for t in terms]) for i, (_, terms) in enumerate(items)]
    schema = "doc_id long, n long, terms binary, counts binary"
    rows = stage(docs.mapInArrow(partial(_term_rows, vocabulary=vocabulary), schema).where("n > 0"), "terms")
    total_docs, total_terms = rows.agg(F.count("*"), F.coalesce(F.sum("n"), F.lit(0))).first()
    size = max(1, len(vocabulary))
    holders = np.zeros(size, np.int64)
    for term, df in rows.select("terms").mapInArrow(partial(_holders, size=size), "term long, df long").groupBy("term").agg(F.sum("df")).collect():
        holders[term] = df
    weights = np.array([math.floor(1000 * math.log((2 * total_docs + 2) / (2 * df + 1))) for df in holders.tolist()], np.int64)
    ranker = partial(_rank_rows, items=numbered, weights=weights, total_docs=total_docs, total_terms=total_terms, k=k)
    found = rows.where("doc_id IS NOT NULL AND length(terms) > 0").mapInArrow(ranker, "item long, doc_id long, score long")
    step = Window.partitionBy("item", "part").orderBy(F.desc("score"), "doc_id")
    found = found.withColumn("part", F.spark_partition_id() % SPREAD).withColumn("r", F.row_number().over(step)).where(F.col("r") <= k)
    last = Window.partitionBy("item").orderBy(F.desc("score"), "doc_id")
    found = found.withColumn("rank", F.row_number().over(last)).where(F.col("rank") <= k)
    names = spark.createDataFrame([(i, item_id) for i, (item_id, _) in enumerate(items)], f"item long, item_id {item_kind}")
    return found.join(names, "item").select("item_id", "rank", "doc_id", "score")


def search(docs: DataFrame, items: DataFrame, k: int = 50, doc_id: str = "doc_id", text: str = "text", item_id: str = "item_id",
           item_text: str = "text") -> DataFrame:
    """``item_id, rank, doc_id, score``: each item's k highest-scoring documents with a score above 0, rank from 1, equal
    scores by ascending doc_id; fewer if there are fewer.

    Null and empty texts have no terms: such documents are not counted and never found, such items find nothing. Documents
    without an id (a whole number) count in the statistics and are never found; items without an id are left out, and items that share one
    are one item with the terms of all. Repeated documents are each ranked. Texts of any length are read whole. Empty tables
    give an empty result. Other columns are not looked at. Terms are runs of ASCII letters, digits and all characters beyond
    ASCII, A-Z lower-cased. Items of one batch pass through the driver.
    """
    rows = narrow(docs, doc_id=doc_id, text=text).select(
        F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).cast("binary").alias("text"))
    given = _item_terms(narrow(items, item_id=item_id, text=item_text).where("item_id IS NOT NULL"))
    kind = given.schema["item_id"].dataType.simpleString()
    terms = given.select("item_id", F.explode("terms").alias("term")).distinct().groupBy("item_id").agg(F.sort_array(F.collect_list("term")).alias("terms"))
    terms = stage(terms, "item-terms")
    words = terms.agg(F.coalesce(F.sum(F.size("terms")), F.lit(0))).first()[0]
    parts = blocks(words, BATCH_TERMS)
    found = []
    for part in range(parts):
        chosen = terms.where(F.pmod(F.xxhash64("item_id"), F.lit(parts)) == part).orderBy("item_id").collect()
        batch = [(r.item_id, [bytes(t) for t in r.terms]) for r in chosen]
        if batch:
            found.append(_search_batch(rows, batch, k, kind))
    if not found:
        return docs.sparkSession.createDataFrame([], f"item_id {kind}, rank int, doc_id long, score long")
    return reduce(DataFrame.unionByName, found)
