"""A training corpus from raw documents: toxic documents go, of near copies one stays, documents that contain benchmark items
go, personal data is masked, and the sources are mixed to their target weights.

Each stage takes the documents its predecessor kept and returns the same columns, the last one also ``copy``: a document
that the mix takes twice is there twice. Stages are written as Parquet and read again, so each is computed once and its loss
of executors does not reach back beyond it. What a stage does with nulls, empty texts, ties and repeated rows is said at
the operator that it calls; further columns of ``documents`` are passed through.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

from palisade.llm import decontaminate as decontamination, mixing, pii, simhash, toxicity
from palisade.llm.common import table
from palisade.session import stage

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents less likely toxic than not; the model is fitted on labelled rows of the stage's own input."""
    return toxicity.drop_toxic(docs, toxicity.fit(docs, table(spark, sf_dir, "labels")))


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group linked by SimHash (3-word shingles, 2 bits): the one with the smallest doc_id."""
    return simhash.keep_one(docs, shingle=3, radius=2)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that contain less than 0.8 of the 5-word shingles of every benchmark item."""
    return decontamination.decontaminate(docs, table(spark, sf_dir, "benchmark"), threshold=0.8, shingle=5)


def mask_personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, personal data in their texts replaced by its kind, n_chars (where there is one) counted anew."""
    masked = pii.mask(docs)
    if "n_chars" not in docs.columns:
        return masked
    return masked.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix takes them, numbered in ``copy`` from 1."""
    return mixing.expand(docs, weights=(5, 2, 1), share=(3, 2), most=2)


STAGES: list[tuple[str, Stage]] = [
    ("toxicity", drop_toxic),
    ("near_duplicates", drop_near_copies),
    ("decontamination", drop_contaminated),
    ("personal_data", mask_personal_data),
    ("mixing", mix_sources),
]

#: The fitted models of the first and fourth stage have no SQL; the stages are tested against brute-force versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, step in STAGES[:-1]:
        docs = stage(step(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
