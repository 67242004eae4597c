import random

import numpy as np
import xxhash
from palisade.llm import simhash
from tests.llm.helpers import documents, odd_rows, prose, words_of


def slow_fingerprint(text):
    words = words_of("".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))
    if not words:
        return 0
    shingles = [" ".join(words[i : i + 3]) for i in range(max(1, len(words) - 2))]
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def slow_components(fps, ids, radius):
    group = list(range(len(fps)))
    for _ in fps:
        for i, a in enumerate(fps):
            for j, b in enumerate(fps):
                if (a ^ b).bit_count() <= radius:
                    group[i] = group[j] = min(group[i], group[j])
    return [min((ids[j] for j in range(len(fps)) if group[j] == g and ids[j] is not None), default=None) for g in group]


def test_matches_brute_force(spark):
    rng = random.Random(1)
    rows = odd_rows(rng)
    base = prose(rng, 400).split()
    for i in range(25):
        near = list(base)
        near[rng.randrange(len(near))] = "changed"
        rows.append((100 + i, " ".join(near).upper() if i % 2 else " ".join(near)))
    got = simhash.simhash_groups(documents(spark, rows)).collect()
    fps = [slow_fingerprint(r[1]) for r in rows]
    want = slow_components(fps, [r[0] for r in rows], 2)
    key = lambda t: (t[0] is None, t[0] or 0, t[1], t[2] is None, t[2] or 0)
    assert sorted(((r.doc_id, r.fp % 2**64, r.component_id) for r in got), key=key) == sorted(
        ((r[0], f, c) for r, f, c in zip(rows, fps, want)), key=key)
    assert len({r.component_id for r in got if (r.doc_id or 0) >= 100}) < 25


def test_links_of_random_fingerprints(spark):
    rng = np.random.default_rng(2)
    centres = rng.integers(0, 1 << 62, 20)
    fps = {int(c) ^ (1 << int(a)) ^ (1 << int(b)) for c in centres for a, b in rng.integers(0, 64, (12, 2))} | {0, 1, (1 << 64) - 1}
    signed = sorted(f - (1 << 64) if f >> 63 else f for f in fps)
    table = spark.createDataFrame([(f,) for f in signed], "fp long")
    for parts in (1, 4, 8):
        links = {frozenset((r.a, r.b)) for r in simhash.near_links(table, 2, parts).collect()}
        assert all((a % 2**64 ^ b % 2**64).bit_count() <= 2 * len(fps) for a, b in map(tuple, links))
        group = {f: f for f in signed}
        for _ in signed:
            for a, b in map(tuple, links):
                group[a] = group[b] = min(group[a], group[b])
        unsigned = [f % 2**64 for f in signed]
        want = slow_components(unsigned, signed, 2)
        assert [group[f] for f in signed] == want


def test_keep_one(spark):
    rows = [(None, "a b c d"), (7, "a b c d"), (5, "a b c d"), (5, "a b c d"), (9, "something else entirely"), (11, None), (12, "")]
    kept = simhash.keep_one(documents(spark, rows))
    assert kept.columns == documents(spark, rows).columns
    assert sorted((r.doc_id, r.text) for r in kept.collect()) == [(5, "a b c d"), (9, "something else entirely"), (11, None)]


def test_empty(spark):
    assert simhash.simhash_groups(documents(spark, [])).collect() == []
    assert simhash.keep_one(documents(spark, [])).collect() == []
