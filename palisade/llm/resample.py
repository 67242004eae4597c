"""Importance resampling toward a target: documents whose features look like the target's are drawn more often.

Features are all runs of 1 to ``order`` consecutive words, hashed into buckets. A document's weight is the floored mean of its
buckets' gains (log of target share over corpus share); Gumbel noise from a hash of the id turns "the k highest scores" into
a draw without replacement.

Buckets of a document are found once and written; corpus counts are one array a task, summed by bucket, and weights are
gathers from the array of gains. The k-th key (score, then doc_id) is found by a distributed quickselect: each round counts
the rows before, at and behind a few random pivot keys, exactly, and goes on with the rows between two pivots, so rounds
shrink by the number of pivots. Only the rows at or before the k-th key are sorted, over ranges, and ranked.
"""

from __future__ import annotations

import itertools
import math
import operator
from collections.abc import Iterator
from functools import partial, reduce
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

from palisade.llm.common import bytes_and_bounds, narrow, plain_words
from palisade.session import stage

#: Random pivot keys of one round of the selection.
PIVOTS = 31


def _bucket_rows(batches: Iterator[pa.RecordBatch], order: int, buckets: int) -> Iterator[pa.RecordBatch]:
    kind = np.uint16 if buckets <= 1 << 16 else np.uint32
    for batch in batches:
        words, found = [], []
        for text in batch.column("text"):
            text = text.as_py()
            row = plain_words(text)
            hashes = list(map(crc32, row))
            every = list(hashes)
            spaced = [b" " + w for w in row]
            for length in range(2, order + 1):
                # The hash of a run goes on from the hash of the run without its last word.
                hashes = list(map(crc32, spaced[length - 1 :], hashes))
                every += hashes
            words.append(len(row))
            found.append((np.array(every, np.int64) % buckets).astype(kind).tobytes())
        yield pa.RecordBatch.from_arrays(
            [batch.column("doc_id"), pa.array(words, pa.int64()), pa.array(found, pa.binary())], ["doc_id", "n_words", "buckets"])


def bucketed(docs: DataFrame, order: int = 2, buckets: int = 10_000, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """``doc_id, n_words, buckets``: the bucket of each feature of each whole text, as packed unsigned numbers."""
    rows = narrow(docs, doc_id=doc_id, text=text).select("doc_id", F.coalesce("text", F.lit("")).cast("binary").alias("text"))
    kind = rows.schema["doc_id"].dataType.simpleString()
    return rows.mapInArrow(partial(_bucket_rows, order=order, buckets=buckets), f"doc_id {kind}, n_words long, buckets binary")


def _count_rows(batches: Iterator[pa.RecordBatch], buckets: int) -> Iterator[pa.RecordBatch]:
    kind = np.uint16 if buckets <= 1 << 16 else np.uint32
    total = np.zeros(buckets, np.int64)
    for batch in batches:
        total += np.bincount(bytes_and_bounds(batch.column("buckets"))[0].view(kind), minlength=buckets)
    held = np.flatnonzero(total)
    yield pa.RecordBatch.from_arrays([pa.array(held, pa.int64()), pa.array(total[held], pa.int64())], ["bucket", "n"])


def bucket_counts(rows: DataFrame, buckets: int) -> np.ndarray:
    """How many features fell into each bucket; at most ``buckets`` rows come to the driver."""
    parts = rows.select("buckets").mapInArrow(partial(_count_rows, buckets=buckets), "bucket long, n long")
    out = np.zeros(buckets, np.int64)
    for bucket, n in parts.groupBy("bucket").agg(F.sum("n").alias("n")).collect():
        out[bucket] = n
    return out


def gains(corpus: np.ndarray, target: np.ndarray) -> np.ndarray:
    """floor(1000 * ln of target share over corpus share) of each bucket, one feature added to every bucket of both."""
    buckets, s_all, t_all = len(corpus), int(corpus.sum()), int(target.sum())
    return np.array([math.floor(1000 * math.log(float(t + 1) * float(s_all + buckets) / (float(s + 1) * float(t_all + buckets))))
                     for s, t in zip(corpus.tolist(), target.tolist())], np.int64)


def _weigh_rows(batches: Iterator[pa.RecordBatch], gain: np.ndarray) -> Iterator[pa.RecordBatch]:
    kind = np.uint16 if len(gain) <= 1 << 16 else np.uint32
    for batch in batches:
        packed, bounds = bytes_and_bounds(batch.column("buckets"))
        ends = bounds // np.dtype(kind).itemsize
        sums = np.concatenate([[0], np.cumsum(gain[packed.view(kind)])])[ends]
        n = np.diff(ends)
        weight = np.where(n > 0, np.diff(sums) // np.maximum(n, 1), 0)
        yield pa.RecordBatch.from_arrays(
            [batch.column("doc_id"), batch.column("n_words"), pa.array(n, pa.int64()), pa.array(weight, pa.int64())],
            ["doc_id", "n_words", "n_features", "weight"])


def noise(doc_id: Column, seed: int) -> Column:
    """Gumbel noise times 1000, floored, from the first 32 bits of sha256 of ``seed:doc_id``."""
    h = F.conv(F.substring(F.sha2(F.concat(F.lit(f"{seed}:"), doc_id.cast("string")), 256), 1, 8), 16, 10).cast("long")
    return F.floor(F.lit(-1000.0) * F.log(-F.log((h + F.lit(0.5)) / F.lit(4294967296.0)))).cast("long")


def _behind(score: int, doc_id: int) -> Column:
    """Whether a row's key lies behind the given one: smaller score, or equal and larger doc_id."""
    return (F.col("score") < score) | ((F.col("score") == score) & (F.col("doc_id") > doc_id))


def kth_key(keys: DataFrame, k: int, seed: int = 0) -> tuple[int, int]:
    """The k-th key of ``score, doc_id`` by descending score, then ascending doc_id; k from 1 to the number of rows.

    A round brings ``PIVOTS`` keys and at most twice as many counts to the driver, and writes the rows between two pivots.
    """
    for turn in itertools.count():
        drawn = keys.orderBy(F.xxhash64("score", "doc_id", F.lit(seed), F.lit(turn))).limit(PIVOTS).collect()
        pivots = sorted({(r.score, r.doc_id) for r in drawn}, key=lambda p: (-p[0], p[1]))
        behind = sum(_behind(s, d).cast("int") for s, d in pivots)
        at = reduce(operator.or_, [(F.col("score") == s) & (F.col("doc_id") == d) for s, d in pivots])
        placed = keys.select("score", "doc_id", behind.alias("behind"), at.alias("at"))
        counts = {(r["behind"], r["at"]): r["n"] for r in placed.groupBy("behind", "at").agg(F.count("*").alias("n")).collect()}
        for i, pivot in enumerate(pivots + [None]):
            between, equal = counts.get((i, False), 0), counts.get((i, True), 0)
            if k <= between:
                # Strictly between two pivots: the rows that are behind i of them and at none.
                keys = stage(placed.where((F.col("behind") == i) & ~F.col("at")).select("score", "doc_id"), f"between-{turn}")
                break
            if k <= between + equal:
                return pivot
            k -= between + equal
        else:
            raise ValueError("k is larger than the number of rows")


def ranked(winners: DataFrame, parts: int) -> DataFrame:
    """``winners`` with ``rank`` from 1 by score descending, doc_id, then the other numbers: sorted by ranges, each range
    numbered for itself and moved on by the sizes of those before it (one number a range)."""
    order = [F.desc("score"), F.asc("doc_id"), F.asc("n_features"), F.asc("weight")]
    dealt = stage(winners.repartitionByRange(parts, *order).withColumn("_range", F.spark_partition_id()), "winners")
    sizes = dealt.groupBy("_range").agg(F.count("*").alias("n"))
    moved = sizes.withColumn("first", F.coalesce(F.sum("n").over(Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    return dealt.join(moved.drop("n"), "_range").withColumn(
        "rank", F.col("first") + F.row_number().over(Window.partitionBy("_range").orderBy(*order))).drop("_range", "first")


def resample(docs: DataFrame, target: DataFrame, percent: int = 25, least_words: int = 20, order: int = 2, buckets: int = 10_000,
             seed: int = 7, doc_id: str = "doc_id", text: str = "text", target_text: str = "text") -> DataFrame:
    """``doc_id, n_words, n_features, weight, score, rank`` of each row of ``docs``; rank is null for rows not drawn.

    Of the N documents with at least ``least_words`` words the floor(percent * N / 100) highest scores are drawn, ties to the
    smaller doc_id. Null and empty texts have no features and weight 0. Rows without a doc_id count among the corpus'
    features, have no score, are not among the N and are never drawn. Repeated rows are documents of their own: equal keys
    take neighbouring ranks, and if only some of them fit, those with fewer features, then smaller weight, go first. A text of
    any length is scored whole. Empty tables give empty results; an empty target makes all words equally unlikely in it. Other columns
    are not looked at. Words are runs of ASCII letters, digits and all other characters beyond ASCII, A-Z lower-cased.
    """
    spark = docs.sparkSession
    rows = stage(bucketed(docs, order, buckets, doc_id, text), "buckets")
    goal = narrow(target, text=target_text).select(F.lit(0).alias("doc_id"), "text")
    gain = gains(bucket_counts(rows, buckets), bucket_counts(bucketed(goal, order, buckets), buckets))
    kind = rows.schema["doc_id"].dataType.simpleString()
    weighed = rows.mapInArrow(partial(_weigh_rows, gain=gain), f"doc_id {kind}, n_words long, n_features long, weight long")
    scored = stage(weighed.withColumn("score", F.col("weight") + noise(F.col("doc_id"), seed)), "scored")
    enough = (F.col("n_words") >= least_words) & F.col("doc_id").isNotNull()
    k = percent * scored.where(enough).count() // 100
    if not k:
        return scored.withColumn("rank", F.lit(None).cast("long"))
    score, last = kth_key(scored.where(enough).select("score", "doc_id"), k, seed)
    drawn = F.coalesce(enough & ~_behind(score, last), F.lit(False))
    winners = ranked(scored.where(drawn), int(spark.conf.get("spark.sql.shuffle.partitions")))
    # Rows that repeat the last key may be more than are still to be drawn.
    winners = winners.withColumn("rank", F.when(F.col("rank") <= k, F.col("rank")))
    return scored.where(~drawn).withColumn("rank", F.lit(None).cast("long")).unionByName(winners)
