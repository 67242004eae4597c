import math
import random

from palisade.llm import decontaminate
from tests.llm.helpers import documents, odd_rows, prose, words_of

ITEMS = "item_id long, text string, hash long, n int, own string, k1 int"


def shingles(text):
    w = words_of((text or "").lower())
    return {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()


def test_matches_brute_force(spark):
    rng = random.Random(1)
    items = [(i, prose(rng, rng.choice([3, 5, 6, 15, 40, 60]))) for i in range(40)]
    items += [(None, items[0][1]), (50, None), (51, ""), (52, items[1][1])]
    rows = odd_rows(rng)
    for i in range(120):
        w = words_of(items[i % 40][1])
        cut = w[: rng.randrange(len(w) // 2, len(w) + 1)]
        if len(cut) > 6 and i % 3 == 0:
            cut[rng.randrange(len(cut))] = "changed"
        rows.append((200 + i, " ".join([prose(rng, rng.choice([0, 30, 500])), *cut, prose(rng, 20 * (i % 2))]).upper()))
    rows.append((201, rows[-1][1]))
    bench = spark.createDataFrame([(i, t, 1, 2, "o", 3) for i, t in items], ITEMS)
    got = decontaminate.contaminated(documents(spark, rows), bench).collect()
    want = []
    for d, t in rows:
        own = shingles(t)
        for i, it in items:
            s = shingles(it)
            if s and len(s & own) >= math.ceil(round(0.8 * len(s), 9)):
                want.append((d, i, len(s), len(s & own)))
    assert len(want) > 30
    assert sorted(map(repr, ((r.doc_id, r.item_id, r.n_shingles, r.found) for r in got))) == sorted(map(repr, want))
    kept = decontaminate.decontaminate(documents(spark, rows), bench)
    bad = {t for d, t in rows if any(shingles(it) and len(shingles(it) & shingles(t)) >= math.ceil(round(0.8 * len(shingles(it)), 9)) for _, it in items)}
    assert sorted(map(repr, ((r.doc_id, r.text) for r in kept.collect()))) == sorted(map(repr, ((d, t) for d, t in rows if t not in bad)))
    assert kept.columns == documents(spark, rows).columns


def test_empty(spark):
    none = spark.createDataFrame([], ITEMS)
    rows = [(1, "a b c d e f"), (2, None)]
    assert decontaminate.contaminated(documents(spark, rows), none).collect() == []
    assert decontaminate.decontaminate(documents(spark, rows), none).count() == 2
    some = spark.createDataFrame([(1, "a b c d e f", 1, 2, "o", 3)], ITEMS)
    assert decontaminate.contaminated(documents(spark, []), some).collect() == []
