"""Bounded samples of labelled documents, the only rows that models are fitted on."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from palisade.llm.common import narrow
from palisade.session import stage

#: Rows held out of every fit: crc32 of the doc_id as text, modulo FOLDS, is 0.
FOLDS = 5


def held_out(doc_id: str = "doc_id"):
    return F.coalesce(F.crc32(F.col(doc_id).cast("string")) % FOLDS == 0, F.lit(False))


def sample(docs: DataFrame, labels: DataFrame, label: str, most: int, hold_out: bool, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """``doc_id, label, text, part``: whole texts of at most ``most`` labelled documents of each label, written out.

    Those with the smallest hash of the doc_id are taken, so reruns agree. Labels without a value or id, and ids with several
    labels, are left out. ``part`` (0 or 1) halves the sample.
    """
    given = narrow(labels, doc_id=doc_id, label=label).where("doc_id IS NOT NULL AND label IS NOT NULL")
    if hold_out:
        given = given.where(~held_out())
    given = given.groupBy("doc_id").agg(F.min("label").alias("label"), F.max("label").alias("other")).where("label = other")
    key = F.xxhash64("doc_id", F.lit("sample"))
    chosen = None
    for value in (0, 1):
        part = given.where(F.col("label") == value).select("doc_id", "label").orderBy(key, "doc_id").limit(most)
        chosen = part if chosen is None else chosen.unionByName(part)
    # At most 2 * most rows of two numbers: small enough for every executor.
    chosen = F.broadcast(stage(chosen, "labelled-ids"))
    rows = narrow(docs, doc_id=doc_id, text=text).select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    return stage(rows.join(chosen, "doc_id").withColumn("part", F.pmod(F.xxhash64("doc_id", F.lit("half")), F.lit(2))), "labelled")
