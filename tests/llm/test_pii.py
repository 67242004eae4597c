import random
import re

import numpy as np
from palisade.llm import pii
from tests.llm.helpers import documents, odd_rows, prose


def luhn(digits):
    total = 0
    for i, d in enumerate(digits[::-1]):
        total += int(d) if i % 2 == 0 else sum(map(int, str(2 * int(d))))
    return total % 10 == 0


def slow(text):
    text = text or ""
    digits = lambda s: re.sub("[^0-9]", "", s)
    spans = [(m.start(), 0, m.end()) for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", text)]
    spans += [(m.start(), 1, m.end()) for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", text) if all(int(p) <= 255 for p in m[0].split("."))]
    spans += [(m.start(), 2, m.end()) for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", text) if 14 <= len(digits(m[0])) <= 19 and luhn(digits(m[0]))]
    spans += [(m.start(), 3, m.end()) for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", text) if 10 <= len(digits(m[0])) <= 15]
    return [(s, k, e) for s, k, e in sorted(spans)]


def test_fixed_patterns_match_brute_force(spark):
    rng = random.Random(1)
    alphabet = ["a@b.c", "@", ".", "x", "-", "1", "22", "255.", "256", "+1 (212) 555-0100", "+", " ", "4111 1111 1111 1111", "4111111111111112", "é@x.com", "a.b@c-d.e@f.gg", "(", "0001.2.3.4", "\n", "9" * 20]
    texts = ["".join(rng.choice(alphabet) for _ in range(rng.randrange(14))) for _ in range(800)]
    for t in texts:
        assert sorted((c.start, c.kind, c.end) for c in pii.candidates(t) if c.base) == slow(t), t
    rows = odd_rows(rng) + list(enumerate(texts[:100], 300))
    got = pii.find(documents(spark, rows)).collect()
    base = sorted(repr((r.doc_id, [(s.start, s.order, s.end) for s in r.spans if s.base])) for r in got)
    assert base == sorted(repr((d, slow(t))) for d, t in rows)


def test_long_runs_are_linear():
    for run in ("a" * 300_000, "1" * 300_000, "1." * 100_000, "+" * 100_000, "a@" * 100_000, "1 " * 100_000, "(" * 100_000):
        pii.candidates(run)


def test_weak_supervision(spark):
    rng = random.Random(2)
    rows = [(i, f"{prose(rng, 8)} mail: {rng.choice('abc')}x{i}@mail.example.com {prose(rng, 3)} call +1 (212) 555-{i:04d} {prose(rng, 4)}") for i in range(80)]
    rows += [(200 + i, f"contact phone (212) 555-{i:04d} or ann{i} (at) example (dot) com") for i in range(30)]
    rows += [(300 + i, f"invoice total 4{i:015d} {prose(rng, 3)}") for i in range(40)]
    got = {r.doc_id: r.spans for r in pii.find(documents(spark, rows)).collect()}
    assert all({s.kind for s in got[i]} >= {"email", "phone"} for i in range(80))
    assert sum(any(s.kind in ("number_like", "address_like") for s in got[200 + i]) for i in range(30)) >= 25
    text = dict(rows)
    for i in range(40):
        digits = "4" + f"{i:015d}"
        assert [s for s in got[300 + i] if s.kind == "card"] == [] or luhn(digits), text[300 + i]


def test_mask(spark):
    rows = [(1, "write a.b@c.de now"), (2, None), (3, ""), (None, "ip 10.0.0.1, card 4111 1111 1111 1111."), (5, "plain")]
    docs = documents(spark, rows)
    out = pii.mask(docs)
    assert out.columns == docs.columns
    assert sorted(map(repr, ((r.doc_id, r.text) for r in out.collect()))) == sorted(map(repr, [
        (1, "write <EMAIL> now"), (2, None), (3, ""), (None, "ip <IP>, card <CARD>."), (5, "plain")]))


def test_reliabilities_find_the_bad_labeler():
    rng = np.random.default_rng(3)
    truth = rng.random(4000) < 0.4
    right = lambda p: np.where(rng.random(4000) < p, truth, ~truth) * 2 - 1
    rows = np.stack([right(0.9), right(0.85), right(0.8), rng.integers(-1, 2, 4000)], axis=1)
    kinds, at, counts = np.unique(rows, axis=0, return_inverse=True, return_counts=True)
    posterior, table = pii.reliabilities(kinds, counts.astype(float))
    assert ((posterior[at.ravel()] > 0.5) == truth).mean() > 0.9
    assert table[1, 0, 2] > 0.85 and abs(table[1, 3, 2] - table[0, 3, 2]) < 0.1


def test_empty(spark):
    assert pii.find(documents(spark, [])).collect() == []
    assert pii.mask(documents(spark, [])).collect() == []
