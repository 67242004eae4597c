import math
import random
import re
from collections import Counter, defaultdict

import numpy as np
import pytest
from palisade.llm import search
from pyspark.sql import functions as F

from .helpers import documents, odd_rows, prose


def terms(text):
    lowered = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    return re.findall(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", lowered)


def slow(rows, items, k):
    docs = [(d, Counter(terms(t))) for d, t in rows if terms(t)]
    n_all, l_all = len(docs), sum(sum(c.values()) for _, c in docs)
    df = Counter(t for _, c in docs for t in c)
    wanted = defaultdict(set)
    for item, text in items:
        if item is not None:
            wanted[item] |= set(terms(text))
    out = []
    for item, some in wanted.items():
        scores = []
        for doc_id, c in docs:
            m = 50 + 50 * sum(c.values()) * n_all // l_all
            score = sum(math.floor(1000 * math.log((2 * n_all + 2) / (2 * df[t] + 1))) * (1_000_000_000 * c[t] // (1000 * c[t] + 20 * m))
                        for t in some if t in c)
            if score > 0 and doc_id is not None:
                scores.append((-score, doc_id))
        out += [(item, rank, d, -s) for rank, (s, d) in enumerate(sorted(scores)[:k], 1)]
    return sorted(out)


def check(spark, rows, items, k=50):
    docs = documents(spark, rows).withColumn("terms", F.lit("x")).withColumn("n", F.lit("y"))
    given = spark.createDataFrame([(i, t, 1, "z") for i, t in items], "item_id long, text string, item int, score string")
    assert sorted(map(tuple, search.search(docs, given, k).collect())) == slow(rows, items, k)


def odd(rng):
    rows = odd_rows(rng) + [(100 + i, prose(rng, rng.randrange(0, 60)).upper()) for i in range(200)] + [(1000 + i, "mimber same") for i in range(90)]
    items = [(i, prose(rng, 6)) for i in range(20)]
    items += [(30, None), (31, ""), (32, "mimber"), (33, "unknownword"), (None, prose(rng, 5)), (2, "lo kas"), (34, prose(rng, 300))]
    return rows, items


def test_matches_brute_force(spark):
    check(spark, *odd(random.Random(1)))


@pytest.mark.parametrize("name, value", [("TERM_BLOCK", 3), ("BATCH_TERMS", 40), ("ITEM_TILE", 4), ("DOC_TILE", 7), ("SPREAD", 2)])
def test_small_tiles_and_batches(spark, monkeypatch, name, value):
    monkeypatch.setattr(search, name, value)
    check(spark, *odd(random.Random(2)), k=5)


def test_empty_tables(spark):
    check(spark, [], [(1, "a b")])
    check(spark, [(1, "a b")], [])
    check(spark, [(1, None), (2, "--")], [(1, "a b")])


def test_products_stay_exact():
    """Sums near 2**53 are split over blocks, so each is exact."""
    weights = np.full(40, 2**31, np.int64)
    tile = search.Tile([(0, list(range(40)))], weights, 0)
    assert 1 <= tile.block < 5
    value = np.full(40, 2**31 * 999_999 + 1, np.int64)
    assert tile.scores(np.arange(40), np.zeros(40, np.int64), value, 1)[0, 0] == int(value.sum())


def test_ties_at_the_last_place():
    best = search.Best(1, 3)
    best.add(np.array([[5, 5, 5, 5, 0]]), np.array([9, 8, 7, 6, 1]))
    best.add(np.array([[5, 6, 4]]), np.array([2, 30, 1]))
    assert [list(map(int, c)) for c in best.rows(4)] == [[4, 4, 4], [30, 2, 6], [6, 5, 5]]
