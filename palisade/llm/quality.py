"""Quality by compression: zstandard dictionaries of good and of bad labelled text.

A text is compressed with each dictionary, block by block; the one made of its like packs it better. The difference of the
two sizes over the text's size is calibrated to a score by a logistic curve, fitted on labelled rows that the
dictionaries have not seen. Text that repeats itself shrinks to nothing with either dictionary, so its difference is near 0
whatever it is like; the calibration therefore also takes the better size over the text's size.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import zstandard
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.functions import pandas_udf

from palisade.llm import labelled
from palisade.llm.common import narrow

#: Labelled documents of each label that a fit takes at most.
MOST_LABELLED = 6000
#: Pieces of a labelled document, spread over the whole of it, and bytes of each, that the dictionaries learn from.
PIECES, PIECE_BYTES = 8, 512
DICTIONARY_BYTES, BLOCK_BYTES, LEVEL = 112 << 10, 2048, 3
#: A text with at least this score is predicted good.
CUT = 0.3


def pieces(text: bytes) -> list[bytes]:
    every = range(0, len(text), PIECE_BYTES)
    step = max(1, -(-len(every) // PIECES))
    return [text[i : i + PIECE_BYTES] for i in every[::step]]


def dictionary(samples: list[bytes]) -> bytes:
    """A trained dictionary, or, where there is too little to train on, the samples themselves."""
    try:
        return zstandard.train_dictionary(DICTIONARY_BYTES, samples).as_bytes()
    except (zstandard.ZstdError, ValueError):
        return b"".join(samples)[-DICTIONARY_BYTES:]


class Compressor:
    def __init__(self, content: bytes):
        if not content:
            self.press = zstandard.ZstdCompressor(level=LEVEL, write_content_size=False)
            return
        known = zstandard.ZstdCompressionDict(content)
        known.precompute_compress(level=LEVEL)
        self.press = zstandard.ZstdCompressor(dict_data=known, level=LEVEL, write_content_size=False, write_dict_id=False)

    def size(self, text: bytes) -> int:
        return sum(len(self.press.compress(text[i : i + BLOCK_BYTES])) for i in range(0, len(text), BLOCK_BYTES))


@dataclass(frozen=True)
class Model:
    good: bytes
    bad: bytes
    weights: tuple[float, float, float] = (0.0, 0.0, 0.0)

    def inputs(self, texts) -> np.ndarray:
        """For each text 1, (size with the bad dictionary - size with the good one) / its size, and the smaller of the two
        sizes / its size; an empty text has 0 for both."""
        good, bad = Compressor(self.good), Compressor(self.bad)
        out = np.zeros((len(texts), 3))
        out[:, 0] = 1
        for i, text in enumerate(texts):
            if text:
                g, b = good.size(text), bad.size(text)
                out[i, 1:] = (b - g) / len(text), min(g, b) / len(text)
        return out

    def scores(self, texts) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.inputs(texts) @ np.array(self.weights), -50, 50)))


def calibrated(x: np.ndarray, label: np.ndarray, rounds: int = 50) -> tuple[float, ...]:
    """Logistic weights by Newton steps, with targets drawn in from 0 and 1 so that separable data has a finite fit."""
    if not len(x):
        return (0.0, 0.0, 0.0)
    good, bad = label.sum(), len(label) - label.sum()
    target = np.where(label == 1, (good + 1) / (good + 2), 1 / (bad + 2))
    w = np.zeros(x.shape[1])
    w[0] = np.log((good + 1) / (bad + 1))
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -50, 50)))
        step = np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + 1e-4 * np.eye(len(w)), x.T @ (target - p) - 1e-4 * w)
        w += np.clip(step, -20, 20)
        if np.abs(step).max() < 1e-9:
            break
    return tuple(w.tolist())


def _pieces(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for frame in frames:
        cut = [pieces(t) for t in frame.text]
        yield pd.DataFrame({"doc_id": frame.doc_id, "label": frame.label, "pieces": cut}).explode("pieces").dropna()


def fit(docs: DataFrame, labels: DataFrame, label: str = "quality", most: int = MOST_LABELLED, **names) -> Model:
    """Dictionaries from one half of the labelled sample, the calibration from the other."""
    rows = labelled.sample(docs, labels, label, most, hold_out=True, **names).withColumn("text", F.col("text").cast("binary"))
    found = rows.where("part = 0").mapInPandas(_pieces, "doc_id long, label int, pieces binary").collect()
    found.sort(key=lambda r: (r.doc_id, bytes(r.pieces)))
    model = Model(*[dictionary([bytes(r.pieces) for r in found if r.label == value]) for value in (1, 0)])

    def inputs(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            x = model.inputs(frame.text.tolist())
            yield pd.DataFrame({"doc_id": frame.doc_id, "label": frame.label, "x1": x[:, 1], "x2": x[:, 2]})

    rest = rows.where("part = 1").mapInPandas(inputs, "doc_id long, label int, x1 double, x2 double").collect()
    seen = np.array(sorted((r.doc_id, r.label, r.x1, r.x2) for r in rest), float).reshape(-1, 4)
    x = np.hstack([np.ones((len(seen), 1)), seen[:, 2:]])
    return Model(model.good, model.bad, calibrated(x, seen[:, 1]))


def score(docs: DataFrame, model: Model, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """One row per input row: ``doc_id, held_out, score, predicted``.

    A null or empty text has no size and gets the score of both inputs 0. Repeated rows have equal scores, a null
    doc_id is passed on (it is not held out), an empty table gives an empty result. Other columns are not looked at; id,
    language and source have no part in a score.
    """

    @pandas_udf("double")
    def scores(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for texts in batches:
            yield pd.Series(model.scores(texts.tolist()))

    rows = narrow(docs, doc_id=doc_id, text=text)
    scored = rows.select("doc_id", labelled.held_out().alias("held_out"), scores(F.col("text").cast("binary")).alias("score"))
    return scored.withColumn("predicted", (F.col("score") >= CUT).cast("int"))
