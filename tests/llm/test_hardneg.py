"""Hard negatives against every pair."""

import math
import random

import pytest

from pyspark.sql import functions as F

from tongueprint.llm import hardneg

SCHEMA = "id long, vector array<double>, label long, side int, part int, anchor_key string, place int"


def whole(vector):
    return [math.floor(256 * x) for x in vector]


def product(a, b):
    return min(2**63 - 1, max(-(2**63), sum(x * y for x, y in zip(a, b))))


def brute(rows):
    good = [
        (i, label, whole(v)) for i, v, label, *_ in rows
        if i is not None and label is not None and v is not None and all(x is not None and math.isfinite(256 * x) for x in v)
    ]
    out, asked = [], set()
    for a, label, v in good:
        if a % 100 or (a, label, tuple(v)) in asked:
            continue
        asked.add((a, label, tuple(v)))
        scored = [(-product(v, w), i, other) for i, other, w in good if i != a]
        for s, p, _ in sorted(x for x in scored if x[2] == label)[:5]:
            ps = -s
            window = sorted((n, i) for n, i, other in scored if other != label and 30 * ps <= -100 * n <= 90 * ps)[:10]
            out += [(a, p, rank, i, ps, -n) for rank, (n, i) in enumerate(window, 1)]
    return sorted(out)


def check(spark, rows, **blocks):
    df = hardneg.usable(spark.createDataFrame(rows, SCHEMA).repartition(3), "id", "vector", "label")
    assert sorted(tuple(r) for r in hardneg.mine(df, df.where(F.col("id") % 100 == 0), **blocks).collect()) == brute(rows)


def made(seed, n, width=12, labels=3, spread=1.0):
    rng = random.Random(seed)
    return [(i * 20, [rng.gauss(0.2, spread) for _ in range(width)], rng.randrange(labels), 0, 0, "", 0) for i in range(n)]


@pytest.mark.parametrize("blocks", [{}, {"anchor_block": 7, "candidate_block": 40}])
def test_all_pairs(spark, blocks):
    check(spark, made(5, 160), **blocks)


def test_hot_vector_ties_and_repeats(spark):
    rows = made(6, 60)
    rows += [(5000 + i, rows[0][1], i % 2, 0, 0, "", 0) for i in range(80)] + rows[:10] + [(0, [0.1] * 12, 1, 0, 0, "", 0)]
    check(spark, rows)


def test_nulls_short_and_large_vectors(spark):
    rows = made(7, 40, width=4)
    rows += [
        (None, [1.0] * 4, 1, 0, 0, "", 0), (700, None, 1, 0, 0, "", 0), (800, [1.0, None, 0.0, 0.0], 1, 0, 0, "", 0),
        (900, [float("nan"), 0.0, 0.0, 0.0], 1, 0, 0, "", 0), (1000, [1.0] * 4, None, 0, 0, "", 0), (1100, [float("inf")] * 4, 1, 0, 0, "", 0),
        (1200, [1.0], 0, 0, 0, "", 0), (1201, [], 1, 0, 0, "", 0), (1300, [0.0] * 4, 2, 0, 0, "", 0),
        (1400, [1e6 + 0.25, 3.0, 0.0, 0.0], 0, 0, 0, "", 0), (1401, [1e7, 1.0, 0.0, 0.0], 0, 0, 0, "", 0), (1402, [9e5, 1.0, 0.0, 0.0], 1, 0, 0, "", 0),
        (1500, [1e20, 0.0, 0.0, 0.0], 0, 0, 0, "", 0), (1501, [1e19, -1e300, 0.0, 0.0], 1, 0, 0, "", 0), (1502, [-1e20, 0.0, 0.0, 0.0], 1, 0, 0, "", 0),
        (1600, [1e308] * 4, 0, 0, 0, "", 0),
    ]
    check(spark, rows)


def test_empty_and_alone(spark):
    check(spark, [])
    check(spark, [(100, [1.0, 2.0], 1, 0, 0, "", 0)])
    check(spark, [(i, [-1.0 if i else 1.0], i % 2, 0, 0, "", 0) for i in range(12)])


def test_dimensions_are_left_out_of_the_index(spark):
    """The bound spares postings and loses nothing."""
    import numpy as np

    rng = np.random.default_rng(1)
    a, c = np.floor(rng.normal(size=(20, 32)) * 40), np.floor(rng.normal(size=(500, 32)) * 40)
    least = np.full(20, 9000.0)
    at, of, scores = hardneg.join_above(a, hardneg.prefix_norms(a), c, hardneg.prefix_norms(c), least)
    every = a @ c.T
    assert set(zip(at.tolist(), of.tolist())) == set(zip(*(x.tolist() for x in np.nonzero(every >= 9000))))
    assert (scores == every[at, of]).all()
