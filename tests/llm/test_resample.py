import hashlib
import math
import random
import re
from collections import Counter
from zlib import crc32

from palisade.llm import resample
from pyspark.sql import functions as F

from .helpers import documents, odd_rows, prose


def features(text):
    lowered = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lowered)
    return words, words + [f"{a} {b}" for a, b in zip(words, words[1:])]


def slow(rows, target, percent, least, buckets):
    """Rows of doc_id, n_features, weight, score, rank by the definition."""
    s = Counter(crc32(f.encode()) % buckets for _, t in rows for f in features(t)[1])
    t = Counter(crc32(f.encode()) % buckets for x in target for f in features(x)[1])
    s_all, t_all = sum(s.values()), sum(t.values())
    gain = {b: math.floor(1000 * math.log((t[b] + 1) * (s_all + buckets) / ((s[b] + 1) * (t_all + buckets)))) for b in range(buckets)}
    out, able = [], []
    for doc_id, text in rows:
        words, runs = features(text)
        weight = sum(gain[crc32(f.encode()) % buckets] for f in runs) // len(runs) if runs else 0
        score = None
        if doc_id is not None:
            h = int(hashlib.sha256(f"7:{doc_id}".encode()).hexdigest()[:8], 16)
            score = weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))
            if len(words) >= least:
                able.append((-score, doc_id, len(runs), weight, len(out)))
        out.append([doc_id, len(runs), weight, score, None])
    for rank, (*_, at) in enumerate(sorted(able)[: percent * len(able) // 100], 1):
        out[at][4] = rank
    return sorted(map(tuple, out), key=str)


def check(spark, rows, target, percent=25, least=20, buckets=500):
    docs = documents(spark, rows).withColumn("rank", F.lit("x")).withColumn("score", F.lit("y"))
    goal = spark.createDataFrame([(i, t, "z") for i, t in enumerate(target)], "item_id long, text string, doc_id string")
    got = resample.resample(docs, goal, percent, least, buckets=buckets).select("doc_id", "n_features", "weight", "score", "rank").collect()
    assert sorted(map(tuple, got), key=str) == slow(rows, target, percent, least, buckets)


def test_odd_rows(spark):
    rng = random.Random(1)
    rows = odd_rows(rng) + [(100 + i, prose(rng, rng.randrange(0, 60)).upper()) for i in range(150)]
    check(spark, rows, [prose(rng, 30), None, "", "ÄÖ x-y_z 12"])


def test_many_rounds_and_repeated_keys(spark, monkeypatch):
    monkeypatch.setattr(resample, "PIVOTS", 2)
    rng = random.Random(2)
    rows = [(i, prose(rng, 25)) for i in range(60)] + [(7, prose(rng, 25))] + [(500, "same words " * 15)] * 40
    check(spark, rows, [prose(rng, 40)], percent=50)
    check(spark, [(1, "same words " * 15)] * 9, ["same"], percent=50)


def test_none_and_all_drawn(spark):
    rng = random.Random(3)
    rows = [(i, prose(rng, 25)) for i in range(9)]
    check(spark, rows, [prose(rng, 9)], percent=100)
    check(spark, rows, [prose(rng, 9)], percent=0)
    check(spark, rows, [])
    check(spark, [], ["a b"])


def test_kth_key_is_the_kth(spark):
    rng = random.Random(4)
    keys = [(rng.randrange(20), i) for i in range(200)]
    df = spark.createDataFrame(keys, "score long, doc_id long")
    ordered = sorted(keys, key=lambda p: (-p[0], p[1]))
    for k in (1, 77, 200):
        assert resample.kth_key(df, k) == ordered[k - 1]
