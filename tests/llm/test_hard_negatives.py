import math
import random

import pytest
from pyspark.sql import functions as F

from pulseforge.llm import hard_negatives

SCHEMA = "vec_id long, label int, embedding array<double>, norm string, grp int, v int"


def plain(rows, k=5, low=80, high=100, scale=256, anchor=lambda i: i % 100 == 0):
    fit = []
    for i, label, v in rows:
        if i is None or label is None or v is None or any(x is None or not math.isfinite(x) or not math.isfinite(scale * x) for x in v):
            continue
        fit.append((i, label, [math.floor(scale * x) for x in v]))
    dot = lambda a, b: max(-(2**61), min(2**61, sum(x * y for x, y in zip(a, b, strict=False))))
    out = []
    for i, label, v in fit:
        if not anchor(i):
            continue
        others = sorted((-dot(v, w), j, other == label) for j, other, w in fit if j != i)
        for p, j, same in [x for x in others if x[2]][:k]:
            fits = [(q, n) for q, n, s in others if not s and -low * p <= -100 * q <= -high * p]
            out += [(i, j, r, n, -p, -q) for r, (q, n) in enumerate(fits[:k], 1)]
    return sorted(out)


def made(spark, rows, parts=3):
    return spark.createDataFrame([(*r, "x", 1, 2) for r in rows], SCHEMA).repartition(parts)


def mined(df, **how):
    return sorted(tuple(r) for r in hard_negatives.hard_negatives(df, F.col("vec_id") % 100 == 0, **how).collect())


def vectors(n, seed, spread):
    """Vectors around a few centres, of norms between 1 and spread; every fifth is one and the same."""
    r = random.Random(seed)
    centres = [[r.gauss(0, 1) for _ in range(8)] for _ in range(4)]
    rows = []
    for k in range(n):
        label = r.randrange(3)
        size = spread ** r.random()
        v = [0.5] * 8 if k % 5 == 0 else [size * (x + r.gauss(0, 0.6)) / 3 for x in r.choice(centres)]
        rows.append((k * 4, label, v))
    return rows


AWKWARD = [
    (100, None, [1.0, 2.0]), (200, 1, None), (300, 1, [1.0, None]), (400, 1, [float("nan"), 1.0]), (None, 1, [1.0, 1.0]), (500, 1, [float("inf"), 1.0]), (500, 1, [1e307, 1.0]),
    (600, 1, []), (601, 1, [0.0, 0.0]), (602, 2, []), (700, 1, [1.0, 2.0, 3.0]), (700, 1, [1.0, 2.0, 3.0]), (701, 1, [1.0]), (702, 2, [1.0, 1.5, 3.1]), (702, 2, [1.0, 1.5, 3.1]), (703, 0, [1.0, 1.5, 3.1]),
    (800, -3, [-1.0, 0.5]), (801, -3, [-1.0, 0.25]), (802, 4, [-1.0, 0.2]), (-100, 4, [-0.9, 0.2]), (900, 7, [3e6, 2e6]), (901, 7, [3e6, 2e6]), (902, 8, [2.9e6, 2e6]), (903, 8, [2.9e6, 2e6, 1.0]), (1000, 9, [1e12, 5.0]), (1001, 9, [1e12, 5.0]), (1002, 8, [1e12, 4.0]),
]


@pytest.mark.parametrize(("spread", "sizes"), [(1, (2048, 8, 256)), (50, (16, 3, 4)), (50, (1, 1, 1))])
def test_against_all_pairs(spark, spread, sizes):
    rows = vectors(400, 5, spread) + AWKWARD
    want = plain(rows)
    assert len(want) > 50
    assert mined(made(spark, rows), per_bucket=sizes[0], per_group=sizes[1], per_block=sizes[2]) == want


def test_blocks_in_shares(spark, monkeypatch):
    monkeypatch.setattr(hard_negatives, "TASK_BLOCKS", 2)
    rows = vectors(300, 6, 10)
    assert mined(made(spark, rows), per_bucket=32, per_group=2, per_block=1, k_positives=3, k_negatives=4, low=50, high=95) == [r for r in plain_with(rows)]


def plain_with(rows):
    out = plain(rows, k=4, low=50, high=95)
    three = {}
    for r in out:
        three.setdefault(r[0], {}).setdefault((-r[4], r[1]), []).append(r)
    # The first three positives of each anchor, whether or not they have negatives.
    first = {}
    fit = [(i, label, [math.floor(256 * x) for x in v]) for i, label, v in rows]
    for i, label, v in fit:
        if i % 100 == 0:
            first[i] = {j for _, j in sorted((-sum(x * y for x, y in zip(v, w, strict=True)), j) for j, other, w in fit if j != i and other == label)[:3]}
    return [r for r in out if r[1] in first[r[0]]]


def test_buckets_are_left_out():
    import numpy as np

    def bucket(norm, n=4):
        v = np.zeros((n, 2), "<f4")
        v[:, 0] = norm
        return hard_negatives.Packed(norm, n, 2, False, np.arange(n, dtype="<i8").tobytes(), np.ones(n, "<i8").tobytes(), np.full(n, norm, "<f8").tobytes(), v.tobytes())

    seen = []
    buckets = [bucket(100.0), bucket(90.0), bucket(10.0)]
    real = hard_negatives.scores
    hard_negatives.scores = lambda a, hi, b: (seen.append(b.hi), real(a, hi, b))[1]
    try:
        anchors = hard_negatives.Packed(10.0, 1, 2, False, np.array([9], "<i8").tobytes(), np.zeros(1, "<i8").tobytes(), np.array([10.0]).tobytes(), np.array([[10, 0]], "<f4").tobytes())
        best = hard_negatives.negatives_of(anchors, buckets, 3, np.array([0]), np.array([0]), np.array([500]), np.array([2000]))
    finally:
        hard_negatives.scores = real
    assert seen == [100.0]  # 900 is below the running third score, 1000
    assert best.score.tolist() == [[1000] * 3] and best.id.tolist() == [[0, 1, 2]]


def test_nothing(spark):
    assert mined(made(spark, AWKWARD).limit(0)) == []
    assert mined(made(spark, [(1, 1, [1.0]), (2, 2, [1.0])])) == []
    assert mined(made(spark, [(100, 1, [1.0])])) == []
