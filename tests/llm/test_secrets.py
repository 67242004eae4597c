import random
import re
import string
import time

from palisade.llm import secrets
from tests.llm.helpers import documents, odd_rows, prose

KEYWORDS = "|".join("".join(f"[{c}{c.upper()}]" if c.isalpha() else c for c in w) for w in ("password", "passwd", "secret", "token", "api_?key"))
ASSIGN = re.compile(rf"""({KEYWORDS})["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""")


def slow(text):
    text = text or ""
    spans = [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if len(m[2]) >= 8]
    spans += [(m.start(), 1, m.end()) for m in re.finditer("AKIA[A-Z0-9]+", text) if len(m[0]) >= 16]
    spans += [(m.start(), 2, m.end()) for m in re.finditer("[0-9a-f]+", text) if len(m[0]) >= 32]
    return ",".join(f"{secrets.KINDS[k]}:{s}:{e}" for s, k, e in sorted(spans))


def token(rng, n=40):
    return "".join(rng.choice(string.ascii_letters + string.digits) for _ in range(n))


def test_fixed_patterns_match_brute_force(spark):
    rng = random.Random(1)
    pieces = ["password=", "Token: ", 'api_key" : "', "APIKEY='", "secret", "paſſword=abcdefgh", "token:secret:abcdefghijk", "AKIA", "AKIAAKIA" + "Z" * 12, "AKIA" + "A1" * 5,
              "0123456789abcdef" * 2, "0123456789abcdef" * 2 + "g", "deadbeef", "é", "𝒳", " ", "\n", "passwd==longenough", "==", "a" * 33, "token = short", "hunter2hunter2"]
    rows = odd_rows(rng) + [(100 + i, "".join(rng.choice(pieces) for _ in range(rng.randrange(12)))) for i in range(150)]
    got = secrets.scan(documents(spark, rows)).select("doc_id", "base").collect()
    assert sorted(map(repr, ((r.doc_id, r.base) for r in got))) == sorted(map(repr, ((d, slow(t)) for d, t in rows)))


def test_models_add_what_patterns_miss(spark):
    rng = random.Random(2)
    ordinary = ["responsibilities", "internationalisation", "counterproductive", "misunderstandings", "characterisations", "1234567890123456", "snake_case_identifier"]
    rows = [(i, f"{prose(rng, 10)} secret = {token(rng)} and {rng.choice(ordinary)}{rng.choice(ordinary)} {prose(rng, 5)}") for i in range(60)]
    rows += [(100 + i, f"see {token(rng)} here") for i in range(20)] + [(200 + i, f"the {w} of it") for i, w in enumerate(ordinary)]
    found = {r.doc_id: r for r in secrets.scan(documents(spark, rows)).collect()}
    hits = sum(len(found[100 + i].markov) for i in range(20))
    assert hits >= 15
    for i in range(20):
        for s in found[100 + i].markov:
            assert rows[60 + i][1][s.start : s.end] == s.value and f"markov:{s.start}:{s.end}" in found[100 + i].spans
    assert not any(found[200 + i].markov for i in range(len(ordinary)))
    assert all(found[i].spans.startswith("assign:") for i in range(60))


def overlapping(text, spans):
    runs = [(m.start(), m.end()) for m in re.finditer(r"(?<![A-Za-z0-9+/_=-])[A-Za-z0-9+/_=-]{16,}", text)]
    return [(s, e) for s, e in runs if not any(a < e and s < b for a, b in spans)]


def test_runs_beside_the_patterns_match_brute_force(spark):
    """Which runs the models judge, wherever assignments, keys and hex strings touch them."""
    rng = random.Random(3)
    pieces = ["password=", "api_key: ", "secret", "abcdefghij", "KLMNOP", "=", "/+", "-_", '"', " ", ".", "AKIA" + "A1" * 6, "0123456789abcdef" * 2, "\ue000", "\ue001", "x" * 16, "é"]
    rows = [(i, "".join(rng.choice(pieces) for _ in range(rng.randrange(14)))) for i in range(400)]
    got = {r.doc_id: [(t.start, t.end) for t in r.tokens] for r in secrets.spans_of(documents(spark, rows)).collect()}
    for i, text in rows:
        spans = [tuple(map(int, s.split(":")[1:])) for s in slow(text).split(",") if s]
        assert got[i] == overlapping(text, spans), text


def test_time_grows_with_the_text(spark):
    """200,000 runs in one text; each span is where it belongs."""
    rng = random.Random(5)
    text = " ".join(token(rng, 18) if i % 3 else f"secret={token(rng, 12)}" for i in range(200_000))
    started = time.perf_counter()
    row = secrets.spans_of(documents(spark, [(1, text)])).collect()[0]
    assert time.perf_counter() - started < 60
    assert len(row.assign) == 66_667 and len(row.tokens) == 133_333
    for s in (*row.assign[::5000], *row.tokens[::5000]):
        assert text[s.start : s.end].endswith(s.value)


def test_threshold_from_held_out_samples():
    steps = {(True, 30): 70, (True, 5): 30, (False, -10): 990, (False, 6): 9, (False, 20): 1}
    model = secrets.choose([], steps, 0.001)
    assert (model.threshold, model.recall, model.false_share) == (7.0, 0.7, 0.001)
    many = {**steps, (False, 20): 40}
    assert secrets.choose([], many, 0.001).threshold == 10.5 and secrets.choose([], many, 0.1).threshold == 2.5
    assert secrets.choose([], {(True, 1): 5}, 0.01) == secrets.Model([], secrets.THRESHOLD)


def test_recall_on_held_out_samples(spark):
    docs = spark.read.parquet("/root/testdata/sf0.1/documents.parquet")
    model = secrets.learn(secrets.spans_of(docs))
    assert model.recall >= 0.9 and model.false_share <= secrets.FALSE_SHARE


def test_nothing_to_learn_from(spark):
    assert secrets.scan(documents(spark, [])).collect() == []
    row = secrets.scan(documents(spark, [(1, "x" * 5000)])).collect()[0]
    assert row.base == "" and row.markov == []
