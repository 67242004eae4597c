import random
import zlib

import numpy as np
from palisade.llm import quality, toxicity
from tests.llm.helpers import documents, odd_rows, prose

LABELS = "doc_id long, quality int, toxic int, text string, label string, part int"


def labels(spark, rows):
    return spark.createDataFrame([(*r, "t", "l", 1) for r in rows], LABELS)


def test_quality_on_held_out_rows(spark):
    rng = random.Random(1)
    good = lambda: prose(rng, rng.randrange(30, 200)) + "."
    bad = lambda: rng.choice([lambda: prose(rng, 60).upper().replace(" ", "!! "), lambda: " ".join(f"{w}$$$" for w in prose(rng, 80).split()),
                              lambda: " ".join([rng.choice("abcde") * 3] * 200)])()
    rows = [(i, bad() if i % 4 == 0 else good()) for i in range(600)]
    odd = [(1000 + i, r[1]) for i, r in enumerate(odd_rows(rng))] + [(None, "no id")]
    docs = documents(spark, rows + odd)
    given = labels(spark, [(i, int(i % 4 != 0), 0) for i in range(600)] + [(None, 1, 0), (5, 0, 0), (1, None, 0)])
    got = quality.score(docs, quality.fit(docs, given)).collect()
    assert len(got) == len(rows) + len(odd)
    held = [r for r in got if r.held_out and r.doc_id < 600]
    assert {r.doc_id for r in held} == {i for i in range(600) if zlib.crc32(str(i).encode()) % 5 == 0}
    assert np.mean([(r.doc_id % 4 != 0) == r.predicted for r in held]) > 0.95
    assert all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.3) for r in got)
    assert not next(r for r in got if r.doc_id is None).held_out


def test_quality_without_labels(spark):
    docs = documents(spark, [(1, "some text"), (2, None), (3, "")])
    assert {r.score for r in quality.score(docs, quality.fit(docs, labels(spark, []))).collect()} == {0.5}
    assert quality.score(documents(spark, []), quality.Model(b"", b"")).collect() == []


def test_toxicity(spark):
    rng = random.Random(2)
    insults = ["rotter", "blackguard", "scoundrel", "knave", "cad"]

    def text(i):
        words = prose(rng, 120).split()
        for _ in range((i % 5 == 0) * (1 + i % 4 * 2)):
            words.insert(rng.randrange(len(words)), rng.choice(insults))
        return " ".join(words)

    rows = [(i, text(i)) for i in range(800)]
    docs = documents(spark, rows + odd_rows(rng))
    model = toxicity.fit(docs, labels(spark, [(i, 1, int(i % 5 == 0)) for i in range(0, 800, 2)]))
    got = {r.doc_id: r for r in toxicity.assess(docs, model).collect() if r.doc_id is not None and r.doc_id > 100}
    fresh = [i for i in range(101, 800, 2)]
    assert np.mean([got[i].toxic == (i % 5 == 0) for i in fresh]) > 0.97
    assert all(0 <= r.severity <= 2 and r.p_toxic <= r.severity <= 2 * r.p_toxic + 1e-9 for r in got.values())
    mild = [got[i].severity for i in fresh if i % 20 == 5]
    severe = [got[i].severity for i in fresh if i % 20 == 15]
    assert np.mean(severe) > np.mean(mild)
    kept = toxicity.drop_toxic(docs, model)
    assert kept.columns == docs.columns
    assert kept.count() == toxicity.assess(docs, model).where("NOT toxic").count()


def test_toxicity_without_labels(spark):
    docs = documents(spark, [(1, "some text"), (2, None)])
    assert not any(r.toxic for r in toxicity.assess(docs, toxicity.fit(docs, labels(spark, []))).collect())
    assert not any(r.toxic for r in toxicity.assess(docs, toxicity.fit(docs, labels(spark, [(1, 1, 0)]))).collect())
    assert toxicity.assess(documents(spark, []), toxicity.fit(documents(spark, []), labels(spark, []))).collect() == []


def test_cumulative_link_recovers_a_known_model():
    rng = np.random.default_rng(3)
    x, w = rng.normal(size=(6000, 3)), np.array([2.0, -1.0, 0.0])
    latent = x @ w + rng.logistic(size=6000)
    grade = (latent > 0.5).astype(int) + (latent > 2.0)
    found, thresholds = toxicity.cumulative_link(x, grade, 2, shrink=0.1)
    assert np.allclose(found, w, atol=0.2) and np.allclose(thresholds, [0.5, 2.0], atol=0.2)
