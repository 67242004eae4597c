"""Secret scans: fixed patterns, and character Markov models for what they miss, in DataFrame operations only.

Two first-order Markov models over characters are trained from labelled samples: random strings (the values the fixed
patterns found) and ordinary identifiers (long runs of letters or of digits outside of them). A run of 16 or more token
characters is a secret if the log-likelihood ratio of the two models exceeds a threshold.

The text is read once: what the patterns find in it, with positions, goes to a narrow table that serves training and
scoring. Positions come from cutting the text at the matches: pieces and matches in turn add up to it.
"""

from __future__ import annotations

import math
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, functions as F

from palisade.llm.common import narrow
from palisade.session import stage

#: Fixed patterns, in the order that decides between spans with the same start.
ASSIGN = r"""(?i)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]{12,}"
HEX = r"[0-9a-f]{32,}"
KINDS = ("assign", "access", "hex", "markov")
#: Runs that the models judge.
RUN = 16
TOKEN = "(?<![A-Za-z0-9+/_=\ue000-])[A-Za-z0-9+/_=\ue000-]{%d,}" % RUN
#: Characters the models tell apart; all others are one more.
ALPHABET = "abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789"
SYMBOLS = len(ALPHABET) + 2  # others, and the start
#: What is added to each character's count; weight of a character's share.
SMOOTHING, BACK_OFF = 0.5, 4.0
#: Shortest value of an assignment; share of the ordinary held-out samples that may be taken for secrets.
LEAST, FALSE_SHARE = 8, 0.001
#: One sample of so many is held out of the models, to find the threshold; the least number of each class for that; the
#: threshold if there are fewer.
HOLD_OUT, LEAST_HELD_OUT, THRESHOLD = 5, 20, 6.0

ONE_SPAN = "struct<start:int,end:int,value:string>"
SPAN = f"array<{ONE_SPAN}>"
#: Matches whose places are added up in one go; the sums of whole blocks are added up in a second step.
BLOCK = 256
#: Stands for each character of an assignment in the text that is searched for runs; elsewhere in a text it becomes OTHER.
MARK, OTHER = "\ue000", "\ue001"


def _let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is worked out once, however often the body uses it."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def _cut(text: Column, pattern: str, group: int) -> Column:
    """The matches ``m`` of a pattern in turn, the value ``v`` of a group in each, and the piece of text ``p`` before each."""
    matches = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    values = F.regexp_extract_all(text, F.lit(pattern), F.lit(group))
    return _let(matches, lambda m: F.arrays_zip(m.alias("m"), values.alias("v"), F.slice(F.split(text, pattern, -1), F.lit(1), F.size(m)).alias("p")))


def located(text: Column, pattern: str, group: int = 0, only_if: Column | None = None) -> Column:
    """``start, end, value`` of each leftmost match in ``text``, in characters; value is the given group.

    Places are running sums of the lengths of pieces and matches, within blocks of matches and over whole blocks, since a
    growing array is copied with each element: the work for n matches is n * BLOCK small copies.
    """
    def whole(x: Column) -> Column:
        return F.length(x["p"]) + F.length(x["m"])

    def part(cut: Column, block: Column) -> Column:
        return F.slice(cut, block * BLOCK + 1, F.lit(BLOCK))

    def begins(cut: Column) -> Column:
        sums = F.transform(F.sequence(F.lit(0), F.floor((F.size(cut) - 1) / BLOCK).cast("int")),
                           lambda i: F.aggregate(part(cut, i), F.lit(0), lambda n, x: n + whole(x)))
        start = F.struct(F.lit(0).alias("at"), F.array().cast("array<int>").alias("found"))
        return F.aggregate(sums, start, lambda acc, n: F.struct(
            (acc["at"] + n).alias("at"), F.array_append(acc["found"], acc["at"]).alias("found")), lambda acc: acc["found"])

    def spans(cut: Column, at: Column, block: Column) -> Column:
        def step(acc: Column, x: Column) -> Column:
            start = acc["at"] + F.length(x["p"])
            span = F.struct(start.alias("start"), (start + F.length(x["m"])).alias("end"), x["v"].alias("value")).cast(ONE_SPAN)
            return F.struct((acc["at"] + whole(x)).alias("at"), F.array_append(acc["found"], span).alias("found"))

        return F.aggregate(part(cut, block), F.struct(at.alias("at"), F.array().cast(SPAN).alias("found")), step, lambda acc: acc["found"])

    found = _let(_cut(text, pattern, group), lambda cut: F.flatten(F.transform(begins(cut), lambda at, block: spans(cut, at, block))))
    hit = text.rlike(pattern) if only_if is None else only_if & text.rlike(pattern)
    return F.when(hit, found).otherwise(F.array().cast(SPAN))


def without_assignments(text: Column, least: int) -> Column:
    """The text with each assignment of a value of ``least`` characters blotted out by as many marks."""
    plain = F.translate(text, MARK, OTHER)
    blotted = _let(_cut(plain, ASSIGN, 2), lambda cut: F.concat(
        F.array_join(F.transform(cut, lambda x: F.concat(x["p"], F.when(
            F.length(x["v"]) >= least, F.repeat(F.lit(MARK), F.length(x["m"]))).otherwise(x["m"]))), ""),
        F.element_at(F.split(plain, ASSIGN, -1), -1)))
    return F.when(plain.rlike(ASSIGN), blotted).otherwise(plain)


def _codes(token: Column) -> Column:
    """The token's characters as numbers: 1 to 62 those of the alphabet, 0 any other."""
    return F.transform(F.filter(F.split(token, ""), lambda c: c != ""), lambda c: F.instr(F.lit(ALPHABET), c))


def transitions(samples: DataFrame) -> DataFrame:
    """``held_out, secret, a, b, n``: how often each character follows another (63: the start) in the samples ``held_out, secret,
    value``."""
    coded = samples.select("held_out", "secret", _codes(F.col("value")).alias("c"))
    pairs = coded.select("held_out", "secret", F.explode(F.arrays_zip(
        F.concat(F.array(F.lit(SYMBOLS - 1)), F.slice("c", F.lit(1), F.size("c") - 1)).alias("a"), F.col("c").alias("b"))).alias("t"))
    return pairs.groupBy("held_out", "secret", "t.a", "t.b").agg(F.count("*").alias("n"))


def log_ratios(counts: list[tuple[bool, int, int, int]]) -> list[float]:
    """log P(b | a, random) - log P(b | a, ordinary) at position SYMBOLS * a + b. Rare transitions lean on how often b occurs
    in the class at all: P(b | a) = (n(a, b) + BACK_OFF P(b)) / (n(a) + BACK_OFF)."""
    logs = {}
    for kind in (True, False):
        pairs = [[0] * SYMBOLS for _ in range(SYMBOLS)]
        for secret, a, b, n in counts:
            if bool(secret) == kind:
                pairs[a][b] += n
        each = [sum(row[b] for row in pairs) + SMOOTHING for b in range(SYMBOLS)]
        shares = [n / sum(each) for n in each]
        logs[kind] = [[math.log((n + BACK_OFF * p) / (sum(row) + BACK_OFF)) for n, p in zip(row, shares)] for row in pairs]
    return [r - o for row, other in zip(logs[True], logs[False]) for r, o in zip(row, other)]


def score(token: Column, ratios: list[float]) -> Column:
    """Log-likelihood ratio of a token: random against ordinary."""
    # One constant for the whole table: the cast is folded when the plan is made.
    table = F.split(F.lit(",".join(map(repr, ratios))), ",").cast("array<double>")
    def step(acc: Column, code: Column) -> Column:
        return F.struct(code.alias("at"), (acc["sum"] + F.get(table, acc["at"] * SYMBOLS + code)).alias("sum"))

    return F.aggregate(_codes(token), F.struct(F.lit(SYMBOLS - 1).alias("at"), F.lit(0.0).alias("sum")), step, lambda acc: acc["sum"])


def _tagged(spans: str, kind: str) -> Column:
    return F.transform(spans, lambda s: F.struct(s["start"].alias("start"), F.lit(KINDS.index(kind)).alias("order"), s["end"].alias("end")))


def _joined(spans: Column) -> Column:
    names = F.array(*[F.lit(k) for k in KINDS])
    return F.array_join(F.transform(F.array_sort(spans), lambda s: F.concat_ws(
        ":", F.get(names, s["order"]), s["start"].cast("string"), s["end"].cast("string"))), ",")


@dataclass(frozen=True)
class Model:
    """``recall`` and ``false_share`` are those of the held-out samples; None if they were too few to choose a threshold by."""

    ratios: list[float]
    threshold: float
    recall: float | None = None
    false_share: float | None = None


def learn(found: DataFrame, false_share: float = FALSE_SHARE) -> Model:
    """Both models from the spans of a corpus, and a threshold (``choose``) above which at most ``false_share`` of the held-out
    ordinary samples lie. Only samples as long as a run count for it, in steps of a half."""
    samples = found.select(F.lit(True).alias("secret"), F.explode("base.value").alias("value")).unionByName(
        found.select(F.lit(False).alias("secret"), F.explode("tokens.value").alias("value")).where(
            F.col("value").rlike("^([A-Za-z_-]+|[0-9]+)$")))
    # Each text once: a value copied thousands of times is one sample.
    samples = samples.distinct().withColumn("held_out", F.pmod(F.xxhash64("value"), F.lit(HOLD_OUT)) == 0)
    samples = stage(samples, "secret-samples")
    # At most two numbers for each pair of characters and class.
    counts = [tuple(r) for r in transitions(samples).collect()]
    ratios = log_ratios([rest for held, *rest in counts if not held])
    judged = samples.where(F.col("held_out") & (F.length("value") >= RUN)).select(
        "secret", F.floor(F.least(F.greatest(2 * score(F.col("value"), ratios), F.lit(-400.0)), F.lit(400.0))).cast("int").alias("step"))
    # At most 801 steps of two classes.
    steps = {(r.secret, r.step): r.n for r in judged.groupBy("secret", "step").agg(F.count("*").alias("n")).collect()}
    # The threshold is judged on samples the models have not seen; then they learn from all.
    return choose(log_ratios([rest for _, *rest in counts]), steps, false_share)


def choose(ratios: list[float], steps: dict[tuple[bool, int], int], false_share: float) -> Model:
    """The smallest threshold, ln(1 / false_share) or more, with few enough ordinary samples above it; ``steps`` count scores in
    halves."""
    n = {kind: sum(c for (secret, _), c in steps.items() if secret == kind) for kind in (True, False)}
    if min(n.values()) < LEAST_HELD_OUT:
        return Model(ratios, THRESHOLD)

    def above(kind: bool, step: int) -> float:
        return sum(c for (secret, at), c in steps.items() if secret == kind and at >= step) / n[kind]

    # A likelihood ratio above 1 / false_share comes up by chance with at most that probability, whatever the models.
    least = math.ceil(2 * math.log(1 / false_share))
    step = next(i for i in range(least, 1000) if above(False, i) <= false_share)
    return Model(ratios, step / 2, above(True, step), above(False, step))


def scan(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", threshold: float | None = None) -> DataFrame:
    """One row per input row: ``doc_id, assign, access, hex, markov, base, spans``. The four lists hold ``start, end, value``
    (characters from 0, end exclusive); ``base`` and ``spans`` are texts ``kind:start:end, ...`` of the fixed patterns and of
    all.

    A null text counts as empty and has no spans. Repeated rows stay, a null doc_id is passed on, an empty table gives an
    empty result. Runs that overlap a span of a fixed pattern add none of their own. If the corpus has no sample of a
    class, its model is uniform. Texts of any length are read whole, in time that grows with them. Of spans that begin
    together the order of kinds decides. Without a ``threshold`` that of ``learn`` is used. Other columns are not looked at.
    """
    found = spans_of(docs, text, doc_id)
    model = learn(found)
    least = model.threshold if threshold is None else threshold
    found = found.withColumn("markov", F.filter("tokens", lambda t: score(t["value"], model.ratios) > least))
    plain = F.concat(*[_tagged(k, k) for k in KINDS[:3]])
    return found.select("doc_id", "assign", "access", "hex", "markov", _joined(plain).alias("base"),
                        _joined(F.concat(plain, _tagged("markov", "markov"))).alias("spans"))


def spans_of(docs: DataFrame, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """``doc_id, assign, access, hex, base, tokens``: spans of the fixed patterns, of all of them, and the runs beside them."""
    rows = narrow(docs, doc_id=doc_id, text=text).select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    body = F.col("text")
    some = body.contains("=") | body.contains(":")
    rows = rows.withColumn("rest", F.when(some, without_assignments(body, LEAST)).otherwise(F.translate(body, MARK, OTHER)))
    found = rows.select(
        "doc_id", F.filter(located(body, ASSIGN, 2, some), lambda s: F.length(s["value"]) >= LEAST).alias("assign"),
        located(body, ACCESS, 0, body.contains("AKIA")).alias("access"), located(body, HEX).alias("hex"), located(F.col("rest"), TOKEN).alias("tokens"))
    # What the other two patterns find lies in one run, so a run that overlaps it holds it.
    free = F.filter("tokens", lambda t: ~(t["value"].contains(MARK) | t["value"].rlike(HEX) | t["value"].rlike(ACCESS)))
    return stage(found.withColumn("base", F.concat("assign", "access", "hex")).withColumn("tokens", free), "secret-spans")
