import hashlib
import random
from collections import Counter

import pytest
from palisade.llm import mixing
from tests.llm.helpers import documents, prose, words_of


def slow_targets(sizes, weights=(5, 2, 1)):
    """Reshares the excess again and again until no source is above twice its size."""
    names = sorted(sizes, key=lambda s: (s is None, (s or "").encode()))
    weight = {s: weights[i % len(weights)] for i, s in enumerate(names)}
    total, full = 1.5 * sum(sizes.values()), set()
    while True:
        left = total - sum(2 * sizes[s] for s in full)
        heavy = sum(weight[s] for s in names if s not in full)
        share = {s: 2 * sizes[s] if s in full else left * weight[s] / heavy for s in names}
        above = {s for s in names if s not in full and share[s] > 2 * sizes[s] + 1e-9}
        if not above:
            return share
        full |= above


def rows_of(rng, n=400):
    rows = [(i, prose(rng, rng.choice([0, 1, 5, 30, 200])), rng.choice(["a", "a", "a", "B", "b", "é", "z", None])) for i in range(n)]
    return rows + [(900, None, "only empty"), (901, " ", "only empty"), (None, "no id", "a"), (None, "no id", "a"), (902, "x y z", "one")]


def test_targets_and_sizes(spark):
    rows = rows_of(random.Random(1))
    got = mixing.mix(documents(spark, rows)).collect()
    assert len(got) == len(rows)
    sizes = {}
    for i, t, s in rows:
        sizes[s] = sizes.get(s, 0) + len(words_of(t))
    want = slow_targets(sizes)
    largest = {}
    taken = {}
    for r in got:
        assert r.source_size == sizes[r.source] and r.target == pytest.approx(want[r.source])
        assert r.taken == r.copies * r.size and 0 <= r.copies <= 2
        largest[r.source] = max(largest.get(r.source, 0), r.size)
        taken[r.source] = taken.get(r.source, 0) + r.taken
    for s, words in taken.items():
        assert abs(words - want[s]) <= largest[s] / 2 + 1e-6
    assert sorted(r.size for r in got) == sorted(len(words_of(t)) for _, t, _ in rows)
    again = mixing.mix(documents(spark, rows).repartition(5)).collect()
    assert sorted(map(repr, got)) == sorted(map(repr, again))


def slow_inclusion(sizes, target):
    """Certain copies, and each size's probability of one more, by the definition."""
    total = sum(sizes)
    certain = min(int(target / total), 2)
    f = target / total - certain
    words = Counter()
    for n in sizes:
        words[n.bit_length() or 1] += n
    out, before = {}, 0
    for band in sorted(words):
        middle = (before + words[band] / 2) / total
        out[band] = f * (1 + mixing.LEAN * min(1, (1 - f) / f) * (1 - 2 * middle))
        before += words[band]
    return certain, out


def source_of(rng, first, n, name):
    return [(first + i, prose(rng, rng.choice([3, 10, 40, 160])), name) for i in range(n)]


def test_order_is_by_random_odds_over_inclusion_odds(spark):
    """The extra copies of a source go to the smallest random odds over inclusion odds, which are not those of the random number."""
    rng = random.Random(2)
    rows = source_of(rng, 0, 300, "a") + source_of(rng, 300, 300, "b")
    got = {r.doc_id: r for r in mixing.mix(documents(spark, rows), weights=(3, 2)).collect()}
    differs = False
    for lo in (0, 300):
        own = range(lo, lo + 300)
        certain, p = slow_inclusion([got[i].size for i in own], got[lo].target)

        def u(i):
            digest = hashlib.md5(f"mix|{i}|{hashlib.md5(rows[i][1].encode()).hexdigest()}".encode()).hexdigest()
            return (int(digest[:12], 16) + 0.5) / 16**12

        def q(i):
            odds = p[got[i].size.bit_length()]
            return u(i) / (1 - u(i)) * (1 - odds) / odds

        copies = [got[i].copies - certain for i in sorted(own, key=q)]
        assert copies == sorted(copies, reverse=True) and 0 < sum(copies) < 300
        by_u = [got[i].copies for i in sorted(own, key=u)]
        differs = differs or by_u != sorted(by_u, reverse=True)
        need = got[lo].target - certain * got[lo].source_size
        assert sum(p[got[i].size.bit_length()] * got[i].size for i in own) == pytest.approx(need)
    assert differs


def test_realised_inclusion_follows_the_probabilities(spark):
    """Many documents of each length: the share that gets the extra copy is near p of the length, and p falls with length."""
    rng = random.Random(8)
    rows = [(i, " ".join([str(rng.random())] * rng.choice([3, 10, 40, 160])), "a" if i % 3 else "b") for i in range(12_000)]
    got = mixing.mix(documents(spark, rows), weights=(3, 2)).collect()
    for name in ("a", "b"):
        own = [r for r in got if r.source == name]
        certain, p = slow_inclusion([r.size for r in own], own[0].target)
        seen, extra = Counter(), Counter()
        for r in own:
            seen[r.size.bit_length()] += 1
            extra[r.size.bit_length()] += r.copies - certain
        assert sorted(p.values(), reverse=True) == [p[b] for b in sorted(p)] and max(p.values()) > 1.2 * min(p.values())
        for band, n in seen.items():
            assert abs(extra[band] / n - p[band]) < 4 * (p[band] * (1 - p[band]) / n) ** 0.5 + 0.01, (name, band)


def test_expand(spark):
    rows = rows_of(random.Random(3), 150) + [(1000, "w w w w", "a")] * 3
    docs = documents(spark, rows)
    plan = mixing.mix(docs).collect()
    out = mixing.expand(docs)
    assert out.columns == docs.columns + ["copy"]
    got = out.collect()
    assert len(got) == sum(r.copies for r in plan)
    assert sum(len(words_of(r.text)) for r in got) == sum(r.taken for r in plan)
    assert {r.copy for r in got} <= {1, 2}


def test_empty(spark):
    assert mixing.mix(documents(spark, [])).collect() == []
    assert mixing.expand(documents(spark, [])).collect() == []
