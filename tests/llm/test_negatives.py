"""Hard negatives against plain loops, and the residue products against Python's own whole numbers."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from latelane.errors import ScoringError
from latelane.llm import hard_negatives

COLUMNS = "vec_id long, label int, embedding array<double>"


@pytest.mark.parametrize("width,bound", [(1, 10**3), (64, 70_000), (64, 2**61), (1500, 2**55), (7, 2**61)])
def test_products_are_exact(width, bound):
    draw, primes = np.random.default_rng(width), hard_negatives.moduli(bound, min(width, hard_negatives.STRIP))
    limit = math.isqrt(bound // width)
    a, b = (draw.integers(-limit, limit + 1, (9, width)) for _ in "ab")
    a[0], b[0], b[1] = limit, limit, -limit
    want = [[sum(int(x) * int(y) for x, y in zip(p, q)) for q in b] for p in a]
    assert hard_negatives.exact_products(a, b, primes).tolist() == want
    assert min(width, hard_negatives.STRIP) * (max(primes) // 2) ** 2 <= 2**24 and math.prod(primes) > 2 * bound


def brute(rows, every, positives=5, negatives=10):
    """(anchor, positive, rank, negative, positive score, negative score) by plain loops; rows are told apart by position."""
    ok = [(i, v, lab, [math.floor(256 * x) for x in e]) for i, (v, lab, e) in enumerate(rows)
          if lab is not None and e is not None and all(x is not None and math.isfinite(x) for x in e)]
    first = lambda found, k: sorted(found, key=lambda r: (-r[0], r[1] is None, r[1] or 0))[:k]
    out = []
    for i, v, lab, e in ok:
        if v is None or v % every:
            continue
        scored = [(sum(x * y for x, y in zip(e, f)), w, other) for j, w, other, f in ok if j != i]
        for ps, p, _ in first([s for s in scored if s[2] == lab], positives):
            inside = [s for s in scored if s[2] != lab and 30 * ps <= 100 * s[0] <= 90 * ps]
            out += [(v, p, r + 1, n, ps, ns) for r, (ns, n, _) in enumerate(first(inside, negatives))]
    return out


def mined(spark, rows, every, **options):
    df = spark.createDataFrame(rows, COLUMNS)
    got = hard_negatives.mine(df, F.col("label"), F.col("vec_id") % every == 0, **options)
    return [tuple(r) for r in got.select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score").collect()]


def order(rows):
    return sorted(rows, key=lambda r: tuple((x is None, x or 0) for x in r))


@pytest.mark.parametrize("blocks", [(4096, 512), (5, 2)])
def test_equals_plain_loops(spark, monkeypatch, blocks):
    monkeypatch.setattr(hard_negatives, "BLOCK_ROWS", blocks[0])
    monkeypatch.setattr(hard_negatives, "BLOCK_ANCHORS", blocks[1])
    draw = random.Random(2)
    rows = [(i, draw.randint(0, 3), [draw.uniform(-1, 1) + (1 if j == 0 else 0) for j in range(6)]) for i in range(120)]
    got = mined(spark, rows, 10)
    assert got and order(got) == order(brute(rows, 10))


def test_ties_copies_and_missing_values(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(10, 1, [1.0, 0.0]), (10, 1, [1.0, 0.0]), (20, 1, [1.0, 0.5])]
    rows += [(i, 1, [1.0, 0.0]) for i in (30, 7, 5, 3)] + [(None, 1, [1.0, 0.0])]
    rows += [(i, 2, [0.5, 0.1]) for i in range(100, 130)] + [(None, 2, [0.5, 0.1])]  # all tie
    rows += [(200, None, [1.0, 1.0]), (210, 1, None), (220, 2, [nan, 1.0]), (230, 2, [inf, 1.0]), (240, 2, [None, 1.0]), (250, 2, [])]
    rows += [(300, 3, [0.6]), (310, 3, [0.7, 0.1, 0.9]), (320, 4, [0.0, 0.0]), (330, 4, [0.0, 0.0])]  # other lengths; scores of 0
    got = mined(spark, rows, 10)
    assert order(got) == order(brute(rows, 10))


def test_many_parts_give_the_same(spark, monkeypatch):
    monkeypatch.setattr(hard_negatives, "ANCHOR_BYTES", 300)
    draw = random.Random(3)
    rows = [(i, i % 2, [draw.uniform(0, 1) for _ in range(4)]) for i in range(60)]
    assert order(mined(spark, rows, 5)) == order(brute(rows, 5))


def test_empty_and_too_large(spark):
    assert mined(spark, [], 10) == []
    assert mined(spark, [(1, 1, [1.0])], 10) == []
    assert mined(spark, [(10, 1, [1.0]), (11, 2, [1.0])], 10) == []
    with pytest.raises(ScoringError, match="64-bit"):
        mined(spark, [(10, 1, [1e30]), (11, 2, [1.0])], 10)


def test_large_components_stay_exact(spark):
    rows = [(10, 1, [3e6, 1.0]), (11, 1, [2e6, -3.0]), (12, 2, [1e6, 2.0]), (13, 2, [1e6, 1.99])]
    assert order(mined(spark, rows, 10)) == order(brute(rows, 10))


def test_clashing_columns_are_not_read(spark):
    rows = [(10, 1, [1.0], 1, 2, 3), (11, 1, [1.0], 1, 2, 3), (12, 2, [0.5], 1, 2, 3)]
    df = spark.createDataFrame(rows, COLUMNS + ", place int, numbers int, score int")
    assert hard_negatives.mine(df, F.col("label"), F.col("vec_id") % 10 == 0).count() == 1
