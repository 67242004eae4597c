"""Personal data by weak supervision.

Candidate spans come from the fixed patterns and from wider ones. Three kinds of labelers vote on each (1 personal, -1
not, 0 no opinion): checks of the pattern, gazetteers, and words in front of the span. Expectation-maximisation over the
counts of all vote patterns of the corpus estimates how reliable each labeler is. The posteriors it gives are the targets
of a logistic regression on features of the span, which judges the candidates; spans of the fixed patterns stay in any case.

Texts are read in one Spark pass that leaves a narrow table of candidates. Votes and features have few values each, so
what the models learn from is a small table of counts, whatever the size of the corpus.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import islice, takewhile

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.functions import pandas_udf

from palisade.llm.common import narrow
from palisade.session import stage

#: Fixed kinds in the order that decides between spans with the same start, and the wider ones.
KINDS = ("email", "ip", "card", "phone", "address_like", "number_like", "name_like")
BASE = 4

DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
IP = re.compile(r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++")
CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])++")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
SPELT = re.compile(r"(?<![A-Za-z0-9._-])[A-Za-z0-9._-]{1,64}\x20?[\[(](?:at|AT)[\])]\x20?[A-Za-z0-9-]{1,63}(?:\x20?(?:\.|[\[(](?:dot|DOT)[\])])\x20?[A-Za-z]{2,20}){1,4}")
NUMBER = re.compile(r"(?<![0-9])(?:\([0-9]{2,4}\)\x20?)?[0-9]{2,4}(?:[\x20.-][0-9]{2,4}){2,5}(?![0-9])")
DIGITS = re.compile(r"[0-9]")

#: Fixed word lists of the gazetteer and context labelers.
TITLES = ("Mr", "Mrs", "Ms", "Dr", "Prof", "Herr", "Frau", "Monsieur", "Madame", "Señor", "Señora", "Don", "Doña")
FIRST_NAMES = frozenset("""Anna Maria Peter Paul Thomas Michael Sarah Laura Julia David Daniel James John Robert Mary Linda
Elizabeth William Richard Hans Karl Jürgen Petra Sabine Monika Jean Pierre Marie Sophie Claire Luc José Carlos Juan Luis
Carmen Lucía Elena Pablo Miguel Antonio""".split())
MAIL_ENDS = frozenset("com org net edu gov io co de fr es uk it eu us info".split())
ISSUERS = tuple("3456")
CONTEXT = re.compile(r"(?i)\b(?:e-?mail|mail|correo|courriel|phone|tel|telefon|teléfono|téléphone|call|mobile|handy|fax|contact|kontakt|"
                     r"card|karte|tarjeta|carte|visa|account|konto|address|adresse|dirección|name|nombre|nom)\b")
AGAINST = re.compile(r"(?i)\b(?:version|invoice|rechnung|factura|facture|order|isbn|issn|page|seite|página|total|sum|id|token|sha|hash|port)\b")
NAME = re.compile(r"\b(?:" + "|".join(TITLES) + r")\.?\x20[A-ZÄÖÜÉÈÁÍÓÚÑ]\w{1,30}(?:\x20[A-ZÄÖÜÉÈÁÍÓÚÑ]\w{1,30})?"
                  r"|\b(?:" + "|".join(sorted(FIRST_NAMES)) + r")\x20[A-ZÄÖÜÉÈÁÍÓÚÑ]\w{1,30}\b")
REACH = 40


@dataclass(frozen=True)
class Candidate:
    start: int
    end: int
    kind: int
    base: bool
    #: Votes and features: single small numbers, joined by blanks.
    pattern: str


def luhn(digits: str) -> bool:
    total = 0
    for i, d in enumerate(map(int, reversed(digits))):
        d = d * 2 if i % 2 else d
        total += d - 9 if d > 9 else d
    return total % 10 == 0


def emails(text: str) -> Iterator[tuple[int, int]]:
    """Leftmost matches of local part, @ and dotted domain, found from each @ outward, so that long runs cost nothing."""
    free, at = 0, text.find("@")
    while at >= 0:
        start = at
        while start > free and text[start - 1] in LOCAL:
            start -= 1
        domain = DOMAIN.match(text, at + 1) if start < at else None
        if domain:
            yield start, domain.end()
            free = domain.end()
        at = text.find("@", max(at + 1, free))


def _matches(text: str) -> Iterator[tuple[int, int, int, bool]]:
    """``start, end, kind, passed`` of what the patterns find; ``passed``: it is a span of a fixed pattern."""
    for start, end in emails(text):
        yield start, end, 0, True
    if DIGITS.search(text):
        for m in IP.finditer(text):
            yield *m.span(), 1, all(len(p.lstrip("0")) <= 3 and int(p[-3:]) <= 255 for p in m[0].split("."))
        for m in CARD.finditer(text):
            digits = m[0].replace(" ", "").replace("-", "")
            if len(digits) >= 14:
                yield *m.span(), 2, len(digits) <= 19 and luhn(digits)
        if "+" in text:
            for m in PHONE.finditer(text):
                yield *m.span(), 3, 10 <= sum(c.isdigit() for c in m[0]) <= 15
        for m in NUMBER.finditer(text):
            if 7 <= sum(c.isdigit() for c in m[0]) <= 15:
                yield *m.span(), 5, False
    if "(at)" in text or "[at]" in text or "(AT)" in text or "[AT]" in text:
        for m in SPELT.finditer(text):
            yield *m.span(), 4, False
    for m in NAME.finditer(text):
        yield *m.span(), 6, False


def _pattern(text: str, start: int, end: int, kind: int, passed: bool) -> str:
    span = text[start:end]
    digits = [c for c in span if c.isdigit()]
    before = text[max(0, start - REACH) : start]
    by_check = (1 if passed else -1) if kind < BASE else 0
    if kind in (0, 4):
        by_list = 1 if re.split(r"[^A-Za-z]+", span)[-1].lower() in MAIL_ENDS else -1
    elif kind == 2:
        by_list = 1 if digits[0] in ISSUERS else -1
    elif kind == 6:
        by_list = 1 if set(span.split()) & FIRST_NAMES else 0
    else:
        by_list = 0
    context = bool(CONTEXT.search(before)) - bool(AGAINST.search(before))
    shape = 0
    if kind in (3, 5):
        shape = 1 if 9 <= len(digits) <= 13 and len(digits) < len(span) else -1
    features = (
        kind, min(len(digits) // 4, 4), int(any(c in " ().-" for c in span)), context, by_check,
        int(text[start - 1 : start].isalnum() or text[end : end + 1].isalnum()), min(len(set(digits)) // 3, 3),
    )
    return " ".join(map(str, (by_check, by_list, context, shape) + features))


VOTES = 4


def candidates(text: str) -> list[Candidate]:
    found = [(s, e, k, p) for s, e, k, p in _matches(text)]
    fixed = sorted((s, e) for s, e, k, p in found if p)
    out = []
    reach = 0
    for s, e, k, passed in sorted(found, key=lambda x: (x[0], x[2])):
        while reach < len(fixed) and fixed[reach][1] <= s:
            reach += 1
        # Wider candidates give way to fixed spans that they overlap.
        if passed or not any(s < b for _, b in takewhile(lambda f: f[0] < e, islice(fixed, reach, None))):
            out.append(Candidate(s, e, k, passed, _pattern(text, s, e, k, passed)))
    return out


def _extract(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for frame in frames:
        found = [candidates(t or "") for t in frame.text]
        yield pd.DataFrame({
            "doc_id": frame.doc_id, "starts": [[c.start for c in cs] for cs in found], "ends": [[c.end for c in cs] for cs in found],
            "kinds": [[c.kind for c in cs] for cs in found], "base": [[c.base for c in cs] for cs in found],
            "patterns": [[c.pattern for c in cs] for cs in found]})


def reliabilities(votes: np.ndarray, counts: np.ndarray, rounds: int = 50) -> tuple[np.ndarray, np.ndarray]:
    """Posterior of each vote pattern, and P(vote | class) as [class, labeler, vote + 1], by expectation-maximisation."""
    posterior = 1 / (1 + np.exp(-votes.sum(axis=1)))
    table = np.zeros((2, votes.shape[1], 3))
    for _ in range(rounds):
        weight = np.stack([counts * (1 - posterior), counts * posterior])
        for v in range(3):
            table[:, :, v] = weight @ (votes == v - 1) + 1
        table /= table.sum(axis=2, keepdims=True)
        prior = (weight.sum(axis=1) + 1) / (weight.sum() + 2)
        logs = np.log(prior)[:, None] + sum(np.log(table[:, j, votes[:, j] + 1]) for j in range(votes.shape[1]))
        posterior = 1 / (1 + np.exp(np.clip(logs[0] - logs[1], -50, 50)))
    return posterior, table


def _inputs(features: np.ndarray) -> np.ndarray:
    kind = np.eye(len(KINDS))[features[:, 0]]
    return np.hstack([np.ones((len(features), 1)), kind, features[:, 1:] / 2.0])


@dataclass(frozen=True)
class SpanClassifier:
    weights: tuple[float, ...] | None

    def probability(self, patterns: list[str]) -> np.ndarray:
        if self.weights is None or not len(patterns):
            return np.zeros(len(patterns))
        features = np.array([[int(x) for x in p.split(" ")[VOTES:]] for p in patterns])
        return 1 / (1 + np.exp(-np.clip(_inputs(features) @ np.array(self.weights), -50, 50)))


def fit(counted: list[tuple[str, int]], rounds: int = 400, rate: float = 0.5, shrink: float = 1e-3) -> SpanClassifier:
    """The span classifier from counts of patterns."""
    if not counted:
        return SpanClassifier(None)
    rows = np.array([[int(x) for x in p.split(" ")] for p, _ in sorted(counted)])
    counts = np.array([n for _, n in sorted(counted)], float)
    target, _ = reliabilities(rows[:, :VOTES], counts)
    x, share = _inputs(rows[:, VOTES:]), counts / counts.sum()
    weights = np.zeros(x.shape[1])
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(x @ weights, -50, 50)))
        weights -= rate * (x.T @ ((p - target) * share) + shrink * weights)
    return SpanClassifier(tuple(weights.tolist()))


def train(found: DataFrame) -> SpanClassifier:
    """From the table of candidates. The counts have at most a row for each combination of votes and features."""
    counts = found.select(F.explode("patterns").alias("pattern")).groupBy("pattern").agg(F.count("*").alias("n"))
    return fit([(r.pattern, r.n) for r in counts.collect()])


def _judge(model: SpanClassifier, at_least: float):
    def judge(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            keep = [b | (model.probability(list(p)) >= at_least) if len(p) else [] for b, p in zip(frame.base, frame.patterns)]
            out = {"doc_id": frame.doc_id}
            for name in ("starts", "ends", "kinds", "base"):
                out[name] = [[x for x, k in zip(values, ks) if k] for values, ks in zip(frame[name], keep)]
            yield pd.DataFrame(out)

    return judge


def _rows(docs: DataFrame, text: str, doc_id: str) -> DataFrame:
    return narrow(docs, doc_id=doc_id, text=text).select("doc_id", "text")


def find(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", at_least: float = 0.5) -> DataFrame:
    """One row per input row: ``doc_id, spans``, a list of ``start, order, end, kind, base`` (characters from 0, end exclusive,
    ``base`` for the fixed patterns) by start and kind.

    A null text counts as empty and has no spans. Repeated rows stay, a null doc_id is passed on, an empty table gives an
    empty result. Other columns are not looked at.
    """
    rows = _rows(docs, text, doc_id)
    id_type = rows.schema["doc_id"].dataType.simpleString()
    lists = f"doc_id {id_type}, starts array<int>, ends array<int>, kinds array<int>, base array<boolean>"
    found = stage(rows.mapInPandas(_extract, f"{lists}, patterns array<string>"), "pii-candidates")
    judged = found.mapInPandas(_judge(train(found), at_least), lists)
    names = F.array(*[F.lit(k) for k in KINDS])
    whole = F.transform(F.arrays_zip("starts", "ends", "kinds", "base"), lambda s: F.struct(
        s["starts"].alias("start"), s["kinds"].alias("order"), s["ends"].alias("end"), F.get(names, s["kinds"]).alias("kind"), s["base"].alias("base")))
    return judged.select("doc_id", F.array_sort(whole).alias("spans"))


def joined(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def number(spans: Column, kind: str) -> Column:
    return F.size(F.filter(spans, lambda s: s["kind"] == kind))


def masked(text: str | None, model: SpanClassifier, at_least: float = 0.5) -> str | None:
    """The text with each span replaced by its kind; of overlapping spans the first is named and all are covered."""
    if not text:
        return text
    found = candidates(text)
    if not found:
        return text
    keep = np.array([c.base for c in found]) | (model.probability([c.pattern for c in found]) >= at_least)
    out, at, open_until = [], 0, -1
    for c, k in zip(found, keep):
        if not k:
            continue
        if c.start >= open_until:
            out += [text[at : c.start], f"<{KINDS[c.kind].upper()}>"]
        open_until = at = max(open_until, c.end)
    return "".join(out) + text[at:]


def mask(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", at_least: float = 0.5) -> DataFrame:
    """The rows and columns of ``docs`` with personal data in the text masked. A null text stays null."""
    rows = _rows(docs, text, doc_id)
    model = train(rows.select("text").mapInPandas(_patterns, "patterns array<string>"))

    @pandas_udf("string")
    def cover(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for texts in batches:
            yield pd.Series([masked(t, model, at_least) for t in texts], dtype=object)

    return docs.withColumn(text, cover(F.col(f"`{text}`")))


def _patterns(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for frame in frames:
        yield pd.DataFrame({"patterns": [[c.pattern for c in candidates(t or "")] for t in frame.text]})
