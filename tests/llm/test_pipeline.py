import random

import corpus_pipeline
import pytest
from palisade.llm import mixing
from pyspark.sql import functions as F
from tests.llm.helpers import documents, odd_rows, prose


@pytest.fixture
def folder(spark, tmp_path):
    rng = random.Random(1)
    clean = [(i, prose(rng, 100), f"s{i % 3}") for i in range(150)]
    item = prose(rng, 40)
    rows = clean + [(200 + i, clean[i][1], "s0") for i in range(20)] + [(300 + i, f"{prose(rng, 60)} rotter blackguard rotter {prose(rng, 9)}", "s1") for i in range(60)]
    rows += [(400, f"{prose(rng, 50)} {item} {prose(rng, 20)}", "s2"), (500, prose(rng, 50) + " me.x@mail.example.com " + prose(rng, 3), "s0")]
    rows += [(600 + i, t) for i, (_, t) in enumerate(odd_rows(rng))] + [(None, "nothing known", None)]
    documents(spark, rows).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    spark.createDataFrame([(i, 1, 0) for i in range(150)] + [(300 + i, 1, 1) for i in range(40)], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    return str(tmp_path)


def test_stages(spark, folder):
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    columns = docs.columns
    for k, (name, step) in enumerate(corpus_pipeline.STAGES):
        out = step(spark, docs, folder)
        assert out.columns == columns + ["copy"] * (name == "mixing"), name
        out.write.parquet(f"{folder}/out{k}")
        before = {r.doc_id for r in docs.collect()}
        docs = spark.read.parquet(f"{folder}/out{k}")
        ids = {r.doc_id for r in docs.collect()}
        gone = before - ids
        if name == "toxicity":
            assert gone == set(range(300, 360))
        elif name == "near_duplicates":
            assert gone >= set(range(200, 220)) and set(range(150)) <= ids
        elif name == "decontamination":
            assert gone == {400}
        elif name == "personal_data":
            assert not gone and "<EMAIL>" in docs.where("doc_id = 500").first().text
            assert docs.where("n_chars <> length(text)").count() == 0
    assert ids


def test_run(spark, folder):
    got = corpus_pipeline.run(spark, folder)
    assert {r.doc_id for r in got.collect()} <= {*range(150), 500, *range(600, 640), None}


def test_empty(spark, tmp_path):
    documents(spark, []).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).collect() == []


CLASHING = ["_found", "_own_key", "_keep_id", "own_key", "keep_id", "_own1", "_bad1", "own1", "bad1", "_own", "own", "copies", "alike", "_n", "copy", "row",
            "k1", "k2", "group_fp", "p_toxic"]


def test_no_column_of_the_input_clashes(spark, folder):
    """Every stage keeps columns that are named like its own, their values too, and does without n_chars."""
    docs = spark.read.parquet(f"{folder}/documents.parquet").drop("n_chars")
    for name in CLASHING:
        docs = docs.withColumn(name, F.concat(F.lit(f"{name}-"), F.col("doc_id").cast("string")))
    docs.write.parquet(f"{folder}/clash")
    docs = spark.read.parquet(f"{folder}/clash")
    columns = docs.columns
    for k, (name, step) in enumerate(corpus_pipeline.STAGES):
        out = step(spark, docs, folder)
        assert out.columns == columns + ["copy_"] * (name == "mixing"), name
        out.write.parquet(f"{folder}/clash{k}")
        docs = spark.read.parquet(f"{folder}/clash{k}")
        assert docs.count() > 100
        wrong = " OR ".join(f"NOT ({c} <=> concat('{c}-', cast(doc_id AS string)))" for c in CLASHING)
        assert docs.where(wrong).count() == 0, name


def test_rows_that_differ_elsewhere_are_chosen_alike(spark):
    rows = [(1, "some words here", "s")] * 5 + [(2, "other words to fill the source " * 3, "s"), (3, "of another source " * 9, "t")]
    docs = documents(spark, rows).withColumn("other", F.monotonically_increasing_id())
    runs = [sorted((r.doc_id, r.other, r.copy) for r in mixing.expand(docs.repartition(n), weights=(5, 2, 1)).collect()) for n in (1, 3, 7)]
    assert runs[0] == runs[1] == runs[2]
