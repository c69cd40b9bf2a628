import random
from fractions import Fraction
from itertools import pairwise

import numpy as np
import pytest
from pulseforge.llm import ngram_join as J
from pulseforge.llm.components import components

from .shared import AWKWARD, documents, empty


def shingles(text, n):
    words = (text or "").translate({c: c + 32 for c in range(65, 91)}).encode().split()
    return {tuple(words[i : i + n]) for i in range(len(words) - n + 1)} if len(words) >= n else ({tuple(words)} if words else set())


def expected(rows, n, num, den):
    """doc_id: (sizes, smallest reachable)."""
    sets = [(r[0], shingles(r[1], n)) for r in rows]
    group = {d: d for d, _ in sets if d is not None}

    def root(d):
        while group[d] != d:
            d = group[d]
        return d

    for i, (a, x) in enumerate(sets):
        for b, y in sets[:i]:
            if a is not None and b is not None and x and y and den * len(x & y) >= num * len(x | y):
                ra, rb = root(a), root(b)
                group[max(ra, rb)] = min(ra, rb)
    return sorted(((d if d is not None else -1), len(s), root(d) if d is not None else -1) for d, s in sets)


def near_copies(seed, groups=6, copies=40):
    """Groups whose members differ in some words, so that many pairs lie around the threshold."""
    r = random.Random(seed)
    rows, vocabulary = list(AWKWARD), [f"w{k}" for k in range(3000)]
    passage = r.choices(vocabulary, k=60)
    for g in range(groups):
        base = r.choices(vocabulary, k=r.choice([4, 12, 60, 200])) + (passage if g % 2 else [])
        for _ in range(copies):
            words = list(base)
            for _ in range(r.randint(0, max(1, len(words) // 25))):
                words[r.randrange(len(words))] = r.choice(vocabulary)
            rows.append((1000 + len(rows), " ".join(words[: len(words) - r.randint(0, 1)]), "en", "s"))
    rows += [(5000 + k, " ".join(f"chain{j}" for j in range(k, k + 60)), "en", "s") for k in range(12)]
    return rows


@pytest.mark.parametrize(("n", "num", "den", "block"), [(3, 90, 100, 2048), (5, 8, 10, 7), (1, 50, 100, 2048)])
def test_join(spark, monkeypatch, n, num, den, block):
    monkeypatch.setattr(J, "TILE_BLOCK", block)
    rows = near_copies(n)
    got = J.ngram_jaccard_join(documents(spark, rows, 5), n, Fraction(num, den)).collect()
    assert sorted((r[0] if r[0] is not None else -1, r[1], r[2] if r[2] is not None else -1) for r in got) == expected(rows, n, num, den)


def test_one_of_each_and_empty(spark):
    rows = near_copies(9, groups=2, copies=12)
    kept = [r["doc_id"] for r in J.one_of_each(documents(spark, rows)).collect()]
    want = [d for d, _, c in expected(rows, 5, 8, 10) if d == c]
    assert sorted(-1 if d is None else d for d in kept) == want
    assert J.ngram_jaccard_join(empty(spark)).collect() == []


def test_linked_sets_share_a_tile():
    r = np.random.default_rng(1)
    for threshold in (Fraction(9, 10), Fraction(8, 10)):
        bands = J.Bands(threshold)
        for _ in range(400):
            size = int(r.integers(1, 120))
            most = int(2 * size * (1 - threshold) / (1 + threshold))
            x = np.unique(r.integers(0, 2**63, size, dtype=np.uint64))
            change = int(r.integers(0, most + 1))
            y = np.unique(np.r_[x[change // 2 :], r.integers(0, 2**63, change - change // 2, dtype=np.uint64)])
            both = len(np.intersect1d(x, y))
            if both and J.enough(both, len(x), len(y), threshold):
                assert np.intersect1d(bands.tiles(x), bands.tiles(y)).size


def test_bitmaps_bound_the_overlap():
    r = np.random.default_rng(2)
    for _ in range(200):
        x = np.unique(r.integers(0, 2**40, int(r.integers(1, 300)), dtype=np.uint64))
        y = np.unique(np.r_[x[: len(x) // 2], r.integers(0, 2**40, int(r.integers(1, 300)), dtype=np.uint64)])
        a, b = J.bitmap(J.mix64(x)), J.bitmap(J.mix64(y))
        size = min(len(a), len(b))
        differ = int(np.bitwise_count(J.folded(a, size) ^ J.folded(b, size)).sum())
        assert len(np.intersect1d(x, y)) <= (len(x) + len(y) - differ) // 2


def test_components(spark):
    r = random.Random(4)
    pairs = [(r.randrange(400), r.randrange(400)) for _ in range(230)] + [*pairwise(range(1000, 1090))] + [(2000, k) for k in range(2001, 2200)]
    group = {}
    for a, b in pairs:
        x, y = group.setdefault(a, {a}), group.setdefault(b, {b})
        if x is not y:
            x |= y
            for d in y:
                group[d] = x
    df = spark.createDataFrame([*pairs, (None, 5), (7, None)], "lo long, hi long")
    got = {r["node"]: r["component"] for r in components(df).collect()}
    assert got == {k: min(v) for k, v in group.items() if len(v) > 1}
    assert components(df.limit(0)).collect() == []
