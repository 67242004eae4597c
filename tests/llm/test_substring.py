import hashlib
import random
from collections import Counter

import numpy as np
from palisade.llm import substring
from tests.llm.helpers import documents, odd_rows, prose, words_of


def slow(texts, length):
    words = [words_of(t) for t in texts]
    seen = Counter(tuple(w[i : i + length]) for w in words for i in range(len(w) - length + 1))
    for w in words:
        gone = [False] * len(w)
        for i in range(len(w) - length + 1):
            if seen[tuple(w[i : i + length])] > 1:
                gone[i : i + length] = [True] * length
        kept = " ".join(x for x, g in zip(w, gone) if not g)
        yield len(w), sum(gone), hashlib.sha256(kept.encode()).hexdigest(), kept


def check(spark, rows, length, gram):
    got = substring.remove_repeats(documents(spark, rows), length=length, gram=gram).collect()
    key = lambda t: (t[0] is None, t[0] or 0, *t[1:])
    assert sorted((tuple(r) for r in got), key=key) == sorted(((r[0], *s) for r, s in zip(rows, slow([r[1] for r in rows], length))), key=key)
    return got


def test_matches_brute_force(spark):
    got = check(spark, odd_rows(random.Random(3)), 35, 8)
    assert all(r.n_removed >= 60 for r in got if r.doc_id in (10, 11, 12, 13))


def test_short_windows_and_few_words(spark):
    rng = random.Random(4)
    rows = [(i, " ".join(rng.choice("abc") for _ in range(rng.randrange(30)))) for i in range(60)]
    rows.append((99, " ".join(["a"] * 50)))
    check(spark, rows, 6, 3)
    check(spark, rows, 4, 8)


def test_empty(spark):
    assert substring.remove_repeats(documents(spark, [])).collect() == []


def test_equal_hashes_of_different_words(monkeypatch):
    """Hashes only propose: with all of them equal, the words still decide."""
    monkeypatch.setattr(substring.Words, "hashes", lambda self, first, last: np.zeros(len(self.start[first]), np.uint64))
    words = substring.Words(b"a b c d e\na b x\nc d e\n")
    windows, repeats = substring.repeating(words, 3)
    assert windows[repeats].tolist() == [2, 8]


def test_blocks_settle_their_own_copies(spark, monkeypatch):
    monkeypatch.setattr(substring, "BLOCK_BYTES", 300)
    rng = random.Random(5)
    shared = prose(rng, 20)
    check(spark, [(i, f"{prose(rng, 5)} {shared}") for i in range(40)], 10, 4)
