import math
import random
from fractions import Fraction

from palisade.llm import topk
import pytest
from pyspark.sql import functions as F

SCHEMA = "vec_id long, embedding array<double>, label int, q string, block int, score string, rank int"


def vectors(spark, rows):
    return spark.createDataFrame([(i, v, 0, "x", 1, "y", 2) for i, v in rows], SCHEMA)


def slow(rows, every, k):
    good = [(i, [math.floor(Fraction(x) * 256) for x in v]) for i, v in rows
            if i is not None and v is not None and all(x is not None and math.isfinite(x) for x in v)]
    for n, (a, u) in enumerate(good):
        if a % every == 0:
            scores = sorted((-sum(x * y for x, y in zip(u, v)), b) for m, (b, v) in enumerate(good) if m != n)
            for rank, (s, b) in enumerate(scores[:k], 1):
                yield a, rank, b, -s


def check(spark, rows, every=5, k=5):
    got = topk.top_k(vectors(spark, rows), F.col("vec_id") % every == 0, k=k).collect()
    assert sorted(map(tuple, got)) == sorted(slow(rows, every, k))


def test_matches_brute_force(spark):
    rng = random.Random(1)
    rows = [(i, [rng.gauss(0, 0.2) for _ in range(12)]) for i in range(150)]
    rows += [(i, rows[3][1]) for i in range(200, 240)]  # many ties
    rows += [(300, None), (301, []), (302, [None] * 12), (303, [float("nan")] * 12), (304, [math.inf] * 12), (None, [0.1] * 12),
             (305, [0.5]), (307, [-1.0] * 12), (5, [0.0] * 12), (5, [0.1] * 12), (5, [0.1] * 12), (31, [3.0] * 12), (31, [0.5] * 12)]
    check(spark, rows)


def test_small_blocks(spark, monkeypatch):
    monkeypatch.setattr(topk, "BLOCK_ROWS", 40)
    monkeypatch.setattr(topk, "PART_BLOCKS", 2)
    rng = random.Random(2)
    check(spark, [(i, [rng.choice([-0.25, 0.0, 0.25]) for _ in range(5)]) for i in range(120)], every=3, k=4)


def test_few_rows(spark):
    assert topk.top_k(vectors(spark, []), F.col("vec_id") % 5 == 0).collect() == []
    check(spark, [(0, [1.0])])
    check(spark, [(0, [1.0]), (1, [2.0])])
    check(spark, [(0, []), (1, [])])


def test_large_components_rank_by_their_size(spark):
    check(spark, [(0, [1.0, 0.0]), (1, [1e6, 0.0]), (2, [2e6, 1.0]), (3, [3e6, -1e12]), (4, [-7e9, 2.5])])
    check(spark, [(0, [1e-3, 4.0]), (1, [1e15, -3.0]), (2, [2e15, 0.25]), (3, [-3e15, 1.0])])


def test_components_beyond_64_bits_count_where_scores_fit(spark):
    huge = [(1, [1e300, 2.0]), (2, [-1e308, 1.0]), (3, [1.7e308, -1.0]), (0, [0.0, 1.5])]
    check(spark, huge)


def test_score_beyond_64_bits_is_an_error(spark):
    with pytest.raises(Exception, match="does not fit 64 bits"):
        topk.top_k(vectors(spark, [(0, [1e9]), (1, [1e12])]), F.col("vec_id") % 5 == 0).collect()
    # Where k better ones exist, a score that is too small is simply not among the results.
    check(spark, [(0, [1e9]), (1, [-1e12]), (2, [1.0]), (3, [2.0])], k=2)


def test_sortable_bytes():
    numbers = sorted({s * (2**e + d) for e in (0, 7, 8, 63, 64, 1000) for d in (-1, 0, 1) for s in (-1, 1)})
    assert [topk.sortable(n) for n in numbers] == sorted(topk.sortable(n) for n in numbers)
