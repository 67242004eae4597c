"""Toxicity by cumulative-link ordinal regression over the words of a text.

Grades 0 (clean) to K are ordered; P(grade <= k) = sigmoid(threshold_k - w.x) shares one weight vector among all
thresholds. x holds log(1 + count) of a few hundred words, those most unevenly spread between toxic and other documents of
the labelled sample. The result is the expected severity, sum of k P(grade = k).

The labels only tell toxic from clean. Toxic documents of the sample are graded mild (1) or severe (2): severe if as many
different telltale words occur in them as in the median toxic document that has any, or more.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.functions import pandas_udf

from palisade.llm import labelled
from palisade.llm.common import narrow

#: Labelled documents of each label that a fit takes at most; words of the model at most, and the least z-score of one.
MOST_LABELLED, MOST_WORDS, LEAST_Z = 5000, 400, 6.0
#: Documents with at least this probability of any toxicity are rejected.
CUT = 0.5
WORD = re.compile(r"[^\W\d_]+")


def tokens(text: str | None) -> list[str]:
    return WORD.findall((text or "").lower())


@dataclass(frozen=True)
class Model:
    words: tuple[str, ...]
    weights: np.ndarray
    thresholds: np.ndarray

    def inputs(self, texts) -> np.ndarray:
        at = {w: i for i, w in enumerate(self.words)}
        out = np.zeros((len(texts), len(self.words)))
        for i, text in enumerate(texts):
            for word, n in Counter(filter(at.__contains__, tokens(text))).items():
                out[i, at[word]] = np.log1p(n)
        return out

    def at_least(self, x: np.ndarray) -> np.ndarray:
        """P(grade >= k) for k = 1 ... K; rows are texts."""
        return 1 - _sigmoid(self.thresholds[None, :] - (x @ self.weights)[:, None])


def _sigmoid(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -50, 50)))


def cumulative_link(x: np.ndarray, grade: np.ndarray, grades: int, shrink: float = 0.5, rounds: int = 500) -> tuple[np.ndarray, np.ndarray]:
    """Weights and rising thresholds that maximise the penalised likelihood (Adam on the first threshold, the logarithms of
    the steps to the next ones, and the weights)."""
    n, d = x.shape
    share = np.array([(grade <= k).mean() for k in range(grades)]).clip(1e-3, 1 - 1e-3)
    start = np.log(share / (1 - share))
    params = np.concatenate([start[:1], np.log(np.maximum(np.diff(start), 0.1)), np.zeros(d)])
    m, v = np.zeros_like(params), np.zeros_like(params)
    for t in range(1, rounds + 1):
        thresholds, w = _unfold(params, grades)
        z = thresholds[None, :] - (x @ w)[:, None]
        upto = np.hstack([np.zeros((n, 1)), _sigmoid(z), np.ones((n, 1))])
        slope = np.hstack([np.zeros((n, 1)), _sigmoid(z) * (1 - _sigmoid(z)), np.zeros((n, 1))])
        rows = np.arange(n)
        p = np.maximum(upto[rows, grade + 1] - upto[rows, grade], 1e-12)
        # Derivative of the log-likelihood by each row's upper and lower threshold.
        by_upper, by_lower = slope[rows, grade + 1] / p, -slope[rows, grade] / p
        by_threshold = np.array([by_upper[grade == k].sum() + by_lower[grade == k + 1].sum() for k in range(grades)])
        by_step = np.cumsum(by_threshold[::-1])[::-1]
        by_step[1:] *= np.exp(params[1:grades])
        gradient = np.concatenate([by_step, -x.T @ (by_upper + by_lower) - shrink * w]) / n
        m, v = 0.9 * m + 0.1 * gradient, 0.999 * v + 0.001 * gradient**2
        params = params + 0.05 * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.999**t)) + 1e-8)
    thresholds, w = _unfold(params, grades)
    return w, thresholds


def _unfold(params: np.ndarray, grades: int) -> tuple[np.ndarray, np.ndarray]:
    thresholds = params[0] + np.concatenate([[0.0], np.cumsum(np.exp(params[1:grades]))])
    return thresholds, params[grades:]


def telltale_words(rows: DataFrame, most: int = MOST_WORDS, least_z: float = LEAST_Z) -> list[tuple[str, float]]:
    """Words by how much more often they occur in documents of label 1 than of 0 (z-score of two shares), or less often."""
    words = F.array_distinct(F.filter(F.split(F.lower("text"), r"[^\p{L}]+"), lambda w: w != ""))
    totals = {r.label: r.n for r in rows.groupBy("label").agg(F.count("*").alias("n")).collect()}
    pos, neg = totals.get(1, 0), totals.get(0, 0)
    if not pos or not neg:
        return []
    counts = rows.select("label", F.explode(words).alias("word")).groupBy("word").agg(
        F.count_if(F.col("label") == 1).alias("p"), F.count_if(F.col("label") == 0).alias("n"))
    rate = (F.col("p") + F.col("n")) / (pos + neg)
    z = (F.col("p") / pos - F.col("n") / neg) / F.sqrt(rate * (1 - rate) * (1 / pos + 1 / neg) + 1e-12)
    best = counts.withColumn("z", z).where(F.abs("z") >= least_z).orderBy(F.desc(F.abs("z")), "word").limit(most)
    return [(r.word, r.z) for r in best.select("word", "z").collect()]


def fit(docs: DataFrame, labels: DataFrame, label: str = "toxic", most: int = MOST_LABELLED, **names) -> Model:
    rows = labelled.sample(docs, labels, label, most, hold_out=False, **names)
    found = telltale_words(rows)
    toxic_words = {w for w, z in found if z > 0}
    model = Model(tuple(w for w, _ in found), np.zeros(len(found)), np.zeros(2))

    def inputs(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            x = model.inputs(frame.text.tolist())
            yield pd.DataFrame({"doc_id": frame.doc_id, "label": frame.label, "at": [np.flatnonzero(r).tolist() for r in x],
                                "x": [r[np.flatnonzero(r)].tolist() for r in x]})

    seen = rows.mapInPandas(inputs, "doc_id long, label int, at array<int>, x array<double>").collect()
    seen.sort(key=lambda r: (r.doc_id, r.label, list(r["at"]), list(r["x"])))
    x, label_of = np.zeros((len(seen), len(found))), np.array([r.label for r in seen], int)
    for i, r in enumerate(seen):
        x[i, list(r["at"])] = list(r["x"])
    telltale = (x[:, [w in toxic_words for w in model.words]] > 0).sum(axis=1)
    some = telltale[(label_of == 1) & (telltale > 0)]
    grade = label_of + ((label_of == 1) & (telltale >= max(2, np.median(some)))) if len(some) else label_of
    if not len(seen):
        return Model((), np.zeros(0), np.array([50.0, 51.0]))
    return Model(model.words, *cumulative_link(x, grade, 2))


def graded(text: Column, model: Model) -> Column:
    """Struct ``severity, p_toxic, grade`` of a text."""

    @pandas_udf("severity double, p_toxic double, grade int")
    def judge(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for texts in batches:
            above = model.at_least(model.inputs(texts.tolist()))
            edges = np.hstack([np.ones((len(above), 1)), above, np.zeros((len(above), 1))])
            yield pd.DataFrame({"severity": above.sum(axis=1), "p_toxic": above[:, 0], "grade": (edges[:, :-1] - edges[:, 1:]).argmax(axis=1).astype("int32")})

    return judge(text)


def assess(docs: DataFrame, model: Model, text: str = "text", doc_id: str = "doc_id", cut: float = CUT) -> DataFrame:
    """One row per input row: ``doc_id, severity, p_toxic, grade, toxic``.

    A null or empty text has no words and gets the model's base rate. Repeated rows have equal results, a null doc_id is
    passed on, an empty table gives an empty result. If the labelled sample lacks a class, no word tells it apart and all
    texts get one result. Other columns are not looked at.
    """
    rows = narrow(docs, doc_id=doc_id, text=text).withColumn("found", graded(F.col("text"), model))
    return rows.select("doc_id", "found.severity", "found.p_toxic", "found.grade", (F.col("found.p_toxic") >= cut).alias("toxic"))


def drop_toxic(docs: DataFrame, model: Model, text: str = "text", cut: float = CUT) -> DataFrame:
    """The rows of ``docs``, all columns, whose probability of any toxicity is below ``cut``."""
    return docs.where(graded(F.col(f"`{text}`"), model).getField("p_toxic") < cut)
