"""Vendor and route rules, rounding and texts on known values."""

import math
import random

import pytest
from pyspark.sql import functions as F

from latelane.functions import enrichment as E
from latelane.functions import numbers as N
from latelane.functions import texts
from latelane.plans import scoring

VENDORS = [  # on-time rate, shift, tier
    (0.548, 0.07, "AVERAGE"), (0.477, 0.15, "AVERAGE"), (0.551, 0.065, "GOOD"), (0.614, -0.04, "GOOD"),
    (0.50, 0.15, "AVERAGE"), (0.65, -0.10, "EXCELLENT"), (0.40, 0.15, "POOR"), (0.45, 0.15, "AVERAGE"),
    (0.55, 0.15 - 0.05 / 0.15 * 0.25, "GOOD"), (0.80, -0.10, "EXCELLENT"),
]


def test_vendor_shift_and_tier(spark):
    df = spark.createDataFrame([(r,) for r, _, _ in VENDORS], "r double")
    got = df.select("r", E.vendor_shift(F.col("r")).alias("s"), E.vendor_tier(F.col("r")).alias("t")).collect()
    for row, (_, shift, tier) in zip(got, VENDORS):
        assert row["s"] == pytest.approx(shift, abs=1e-12)
        assert row["t"] == tier


HISTORY = "p double, vendor_found boolean, vendor_rate double, route_found boolean, route_rate double, route_confidence double"


def test_missing_rate_gives_missing_probability_and_lowest_tier(spark):
    df = spark.createDataFrame([(p, f, r, False, None, 0.0) for p, f, r in ((0.6, True, None), (0.6, False, None), (0.95, True, 0.4))], HISTORY)
    got = scoring.with_enrichment(df, "p").select(
        "vendor_probability", E.vendor_tier(F.col("vendor_rate")), E.is_delayed(F.col("vendor_probability"))
    ).collect()
    assert [tuple(r) for r in got] == [(None, "POOR", False), (0.6, "POOR", True), (1.0, "POOR", True)]


CONFIDENCE = [  # samples, spread, confidence, model weight
    (1, None, 0.003696, 0.5), (50, 0.0, 0.75, 0.8), (50, 0.12, 0.55, 0.65), (100, 0.3, 0.496654, 0.596654),
    (100, 0.15, 0.746654, 0.8), (20, 0.2, 0.190380, 0.5), (100, 0.9, 0.496654, 0.596654),
]


def test_route_confidence_and_weight(spark):
    df = spark.createDataFrame([(n, s) for n, s, _, _ in CONFIDENCE], "n long, s double")
    c = E.route_trust(F.col("n"), F.col("s"))
    for row, (_, _, confidence, weight) in zip(df.select(c.alias("c"), E.model_weight(c).alias("w")).collect(), CONFIDENCE):
        assert row["c"] == pytest.approx(confidence, abs=1e-6)
        assert row["w"] == pytest.approx(weight, abs=1e-6)


def test_blend(spark):
    df = spark.createDataFrame([(0.67, False, None, True, 0.64, 0.55), (0.5, False, None, False, None, 0.0), (0.5, False, None, True, None, 0.9)], HISTORY)
    got = [r["enriched_probability"] for r in scoring.with_enrichment(df, "p").collect()]
    assert got[0] == pytest.approx(0.6595) and got[1:] == [0.5, None]


def test_risk_bands(spark):
    df = spark.createDataFrame([(0.0,), (0.29,), (0.3,), (0.59,), (0.6,), (1.0,), (None,)], "p double")
    assert [r[0] for r in df.select(E.risk_band(F.col("p"))).collect()] == [
        "low", "low", "medium", "medium", "high", "high", None]


def test_value_per_kg_keeps_missing_weight_missing(spark):
    df = spark.createDataFrame([(10.0, 0.5), (10.0, 4.0), (10.0, None)], "v double, w double")
    assert [r[0] for r in df.select(N.value_per_kg(F.col("v"), F.col("w"))).collect()] == [10.0, 2.5, None]


def test_rounding_equals_python(spark):
    rng = random.Random(7)
    values = [round(rng.uniform(-1, 1), rng.choice([3, 4, 5, 17])) for _ in range(3000)]
    values += [k / 1000 + 0.0005 for k in range(-500, 500)] + [0.0005, -0.0005, 0.005, 0.125, 2.675, 12.345]
    df = spark.createDataFrame([(v,) for v in values], "x double")
    got = df.select(N.round_stored(F.col("x"), 3).alias("a"), N.round_stored(F.col("x"), 2).alias("b")).collect()
    assert [(r["a"], r["b"]) for r in got] == [(round(v, 3), round(v, 2)) for v in values]


def test_texts_equal_python(spark):
    rng = random.Random(8)
    values = [round(rng.uniform(-1, 1), 3) for _ in range(500)] + [0.0, 0.0005, -0.0004, 0.5, 0.125, -0.04]
    df = spark.createDataFrame([(v, v * 100000) for v in values], "x double, y double")
    got = df.select(
        texts.percent(F.col("x")).alias("p"), texts.signed_percent(F.col("x")).alias("s"),
        N.fixed_text(F.col("y"), 0, grouped=True).alias("t"), N.fixed_text(F.col("x"), 1).alias("f"),
    ).collect()
    for r, v in zip(got, values):
        assert (r["p"], r["s"], r["f"]) == (f"{v:.1%}", f"{v:+.1%}", f"{v:.1f}"), v
        assert r["t"] == f"{v * 100000:,.0f}"


def test_labels(spark):
    df = spark.createDataFrame([("A", "B"), ("A", None)], "o string, d string")
    got = df.select(texts.route_pair(F.col("o"), F.col("d")), texts.route_label(F.col("o"), F.col("d"))).collect()
    assert [tuple(r) for r in got] == [("A->B", "A->B"), (None, "A->None")]


def test_votes_and_argmax(spark):
    row = spark.range(1).select(
        N.mean_of(F.lit(0.2), F.lit(0.4), F.lit(0.9)).alias("m"),
        N.mean_of_arrays(F.array(F.lit(0.0), F.lit(1.0)), F.array(F.lit(1.0), F.lit(0.0))).alias("a"),
        N.argmax_index(F.array(F.lit(0.1), F.lit(0.4), F.lit(0.4))).alias("i"), N.sigmoid(F.lit(0.3)).alias("s"),
    ).first()
    assert row["m"] == pytest.approx(0.5) and row["a"] == [0.5, 0.5] and row["i"] == 1
    assert row["s"] == pytest.approx(1 / (1 + math.exp(-0.3)))
