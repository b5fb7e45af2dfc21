"""Joins, ranks, splits, features and metrics against brute force."""

import math
import random
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from latelane import schemas as S
from latelane.errors import TrainingError
from latelane.operators import features, metrics, profiles, ranks, scaling, splits
from latelane.operators.joins import lookup_join, measured_bytes


def test_lookup_join_broadcasts_only_within_the_bound(spark):
    facts = spark.range(1000).select((F.col("id") % 7).cast("string").alias("k"), "id")
    lookup = spark.createDataFrame([(str(i), i) for i in range(5)], "k string, v long")
    assert measured_bytes(lookup) == 5 * (32 + 16 + 1 + 8)
    small, large = lookup_join(facts, lookup, ["k"]), lookup_join(facts, lookup, ["k"], limit_bytes=10)
    plan = lambda df: df._jdf.queryExecution().optimizedPlan().toString()
    assert "strategy=broadcast" in plan(small) and "strategy=broadcast" not in plan(large)
    assert sorted(map(tuple, small.collect()), key=str) == sorted(map(tuple, large.collect()), key=str)


def test_hot_key_is_split_in_the_shuffle_join(spark):
    settings = {
        "spark.sql.autoBroadcastJoinThreshold": "-1", "spark.sql.adaptive.autoBroadcastJoinThreshold": "-1",
        "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": "50k",
        "spark.sql.adaptive.advisoryPartitionSizeInBytes": "50k", "spark.sql.adaptive.coalescePartitions.enabled": "false",
        "spark.sql.shuffle.partitions": "32",
    }
    for k, v in settings.items():
        spark.conf.set(k, v)
    try:
        facts = spark.range(0, 200000, 1, 16).select(
            F.when(F.col("id") % 3 == 0, F.lit("hot")).otherwise(F.col("id").cast("string")).alias("k"), "id")
        lookup = spark.range(100000).select(F.col("id").cast("string").alias("k"), F.col("id").alias("v")).unionByName(
            spark.createDataFrame([("hot", -1)], "k string, v long"))
        joined = lookup_join(facts, lookup, ["k"], limit_bytes=0)
        rows = joined.toPandas()
        assert len(rows) == 200000 and (rows[rows["k"] == "hot"]["v"] == -1).all()
        assert "skew=true" in joined._jdf.queryExecution().executedPlan().toString()
    finally:
        for k in settings:
            spark.conf.unset(k)
        spark.conf.set("spark.sql.shuffle.partitions", "8")


def test_percentiles_equal_numpy(spark):
    rng = random.Random(1)
    values = [round(rng.expovariate(1), 2) for _ in range(999)] + [3.0] * 500
    df = spark.createDataFrame([(v,) for v in values] + [(None,)], "x double").repartition(5)
    row = ranks.percentiles(df, "x", {"a": 0.5, "b": 0.95, "c": 0.99, "d": 0.0, "e": 1.0}).first()
    for name, share in zip("abcde", (50, 95, 99, 0, 100)):
        assert row[name] == pytest.approx(np.percentile(values, share))


def test_auc_counts_ties_half(spark):
    rng = random.Random(2)
    rows = [(rng.randint(0, 1), round(rng.random(), 1), round(rng.random(), 3)) for _ in range(400)]
    got = {r["member"]: r["auc"] for r in metrics.roc_auc(
        spark.createDataFrame(rows, "y int, a double, b double"), "y", ["a", "b"]).collect()}
    for i, name in ((1, "a"), (2, "b")):
        pos, neg = [r[i] for r in rows if r[0]], [r[i] for r in rows if not r[0]]
        won = sum((p > n) + 0.5 * (p == n) for p in pos for n in neg)
        assert got[name] == pytest.approx(won / len(pos) / len(neg))


def _hash_ranked(rows, seed=42):
    import hashlib
    return sorted(rows, key=lambda k: hashlib.md5(f"{k}|{seed}".encode()).hexdigest())


@pytest.mark.parametrize("digits", [1, 4])
def test_stratified_split_is_exact(spark, digits):
    rows = [(f"k{i}", "hot" if i % 3 == 0 else (None if i % 50 == 1 else f"l{i % 4}")) for i in range(600)]
    df = spark.createDataFrame(rows, "k string, label string")
    got = {r["k"]: r["is_test"] for r in splits.stratified_split(df, "k", "label", digits=digits).collect()}
    folds = {r["k"]: r["fold"] for r in splits.stratified_folds(df, "k", "label", digits=digits).collect()}
    for label in {r[1] for r in rows}:
        keys = _hash_ranked([k for k, l in rows if l == label])
        n = math.floor(len(keys) * 0.2 + 0.5)
        assert [got[k] for k in keys] == [True] * n + [False] * (len(keys) - n)
        cuts = [len(keys) * f // 5 for f in range(1, 5)]
        assert [folds[k] for k in keys] == [sum(i >= c for c in cuts) for i in range(len(keys))]


def test_copies_stay_on_one_side(spark):
    rows = [("same", "a")] * 300 + [(f"k{i}", "a") for i in range(600)]
    df = spark.createDataFrame(rows, "k string, label string")
    got = splits.stratified_split(df, "k", "label").groupBy("k").agg(F.countDistinct("is_test").alias("sides"))
    assert got.filter("sides > 1").count() == 0
    assert splits.stratified_folds(df, "k", "label").count() == 900


def test_hash_split_share(spark):
    df = spark.range(20000).select(F.col("id").cast("string").alias("k"))
    share = splits.hash_split(df, "k").agg(F.avg(F.col("is_test").cast("int"))).first()[0]
    assert abs(share - 0.2) < 0.01


SHIPMENT = dict.fromkeys(S.SHIPMENTS.fieldNames())


def _shipments(spark, rows):
    return spark.createDataFrame([tuple({**SHIPMENT, **r}.values()) for r in rows], S.SHIPMENTS)


def test_training_frame_keeps_every_match(spark):
    ships = _shipments(spark, [
        {"shipment_id": "s1", "supplier_name": "v1", "on_time": "Yes", "origin_city": "A", "destination_city": "B",
         "value_inr": 10.0, "weight_kg": 0.5},
        {"shipment_id": "s2", "supplier_name": "v2", "on_time": None, "origin_city": "A", "value_inr": 10.0},
        {"shipment_id": None, "supplier_name": None, "on_time": "No"},
    ])
    vendors = spark.createDataFrame([("v1", 1, 1.0, 0.5, 1.0), ("v1", 2, 2.0, 0.6, 1.0), (None, 3, 3.0, 0.7, 1.0)], S.VENDOR_STATS)
    routes = spark.createDataFrame([("s1", "A", "B", 5.0, 0.1, 0.9, 0), ("s1", "A", "B", 6.0, 0.2, 0.8, 1), (None, "A", "B", 7.0, 0.1, 0.1, 0)], S.ROUTE_STATS)
    got = features.training_frame(ships, vendors, routes)
    assert len(got.columns) == 33
    rows = Counter((r["shipment_id"], r["vendor_on_time_rate"], r["route_distance_km"], r["will_delay"], r["value_per_kg"], r["route_pair"])
                   for r in got.collect())
    assert rows == Counter(
        [("s1", v, d, 0, 10.0, "A->B") for v in (0.5, 0.6) for d in (5.0, 6.0)]
        + [("s2", None, None, 1, None, None), (None, None, None, 1, None, None)])


def test_subsets_and_guards(spark):
    ships = _shipments(spark, [{"on_time": "No", "delay_days": d} for d in (None, 0.0, 3.0, 20.0)])
    assert sorted(r["delay_days"] for r in features.delayed_by_days(ships).collect()) == [3.0, 20.0]
    late = features.delayed_with_reason(ships.withColumn("will_delay", F.lit(1)))
    assert {r["delay_reason"] for r in late.collect()} == {"Unknown"}
    with pytest.raises(TrainingError):
        features.require_rows(ships.filter("false"), "delayed shipments")
    days = ships.select(features.clipped_days(F.col("delay_days"))).collect()
    assert [r[0] for r in days] == [None, 0.0, 3.0, 12.0]
    numbers = spark.createDataFrame([(float("inf"), None), (float("nan"), None), (2.0, None)], "x double, e double")
    assert [r[0] for r in numbers.select(features.filled(F.col("x"))).collect()] == [0.0, 0.0, 2.0]
    assert scaling.drop_entirely_missing(numbers, ["x", "e"]).columns == ["x"]
    assert [tuple(r) for r in scaling.not_finite(numbers, ["x", "e"]).collect()] == [("x", 2), ("e", 0)]


def test_route_profile_of_one_row_has_no_spread(spark):
    routes = spark.createDataFrame(
        [("1", "A", "B", 5.0, 0.1, 0.9, 0), ("2", "A", "C", 5.0, None, 0.9, 1), ("3", None, "C", 5.0, 0.1, 0.9, 1)], S.ROUTE_STATS)
    got = {(r["origin"], r["destination"]): (r["std_delay_prob"], r["sample_count"]) for r in profiles.route_profile(routes).collect()}
    assert got == {("A", "B"): (None, 1), ("A", "C"): (None, 0)}


def test_unmatched_keys(spark):
    df = spark.createDataFrame([("a",), ("b",), ("b",), (None,)], "k string")
    got = profiles.unmatched_keys(df, spark.createDataFrame([("a",)], "id string"), {"k": "id"}).collect()
    assert {r["k"]: r["rows"] for r in got} == {"b": 2, None: 1}


def test_scaling_ignores_missing_and_constant_columns(spark):
    df = spark.createDataFrame([(1.0, 5.0), (2.0, 5.0), (None, 5.0), (6.0, 5.0)], "a double, b double")
    got = scaling.scale(df, ["a", "b"], scaling.scale_statistics(df, ["a", "b"])).toPandas()
    x = np.array([1.0, 2.0, 6.0])
    assert np.allclose(got["a"].dropna(), (x - x.mean()) / x.std()) and (got["b"] == 0).all()


def test_label_numbers(spark):
    df = spark.createDataFrame([("b", "x"), ("a", "y"), (None, "x"), ("c", "x")], "p string, q string")
    numbers = scaling.label_numbers(df, ["p", "q"])
    assert {(r["column_name"], r["value"]): r["index"] for r in numbers.collect()} == {
        ("p", "a"): 0, ("p", "b"): 1, ("p", "c"): 2, ("q", "x"): 0, ("q", "y"): 1}
    assert [r["p_index"] for r in scaling.encode_labels(df, numbers, ["p"]).collect()] == [1, 0, None, 2]


def test_class_report_with_a_label_never_predicted(spark):
    pairs = [("a", "a")] * 6 + [("a", "b")] * 2 + [("b", "b")] * 3 + [("c", "a")] * 1 + [("b", "d")]
    report = metrics.class_report(metrics.confusion(spark.createDataFrame(pairs, "y string, f string"), "y", "f"))
    got = {r["label"]: (r["precision"], r["recall"], r["f1"], r["support"]) for r in report.collect()}
    f1s = {}
    for label in "abcd":
        tp = sum(y == f == label for y, f in pairs)
        said, real = sum(f == label for _, f in pairs), sum(y == label for y, _ in pairs)
        f1s[label] = 2 * tp / (said + real)
        assert got[label] == pytest.approx((tp / said if said else 0, tp / real if real else 0, f1s[label], real))
    averages = metrics.report_averages(report).first()
    assert averages["macro_f1"] == pytest.approx(np.mean(list(f1s.values())))
    assert averages["weighted_f1"] == pytest.approx(sum(f1s[y] for y, _ in pairs) / len(pairs))


def test_losses_and_their_guard(spark):
    rows = [(1, 0.3, 2.0, 0.0, 0.5, 2.0), (0, -1.2, 0.5, 0.4, 0.25, 1.0)]
    df = spark.createDataFrame(rows, "y int, logit double, d double, dh double, p double, w double")
    got = metrics.task_losses(df, "y", "logit", "d", "dh", "p", "w").first()
    b = np.mean([math.log(1 + math.exp(-0.3)), math.log(1 + math.exp(-1.2))])
    d = np.mean([1.5, 0.005])
    c = (2 * -math.log(0.5) - math.log(0.25)) / 3
    assert tuple(got) == pytest.approx((b, d, c, b + d + 0.7 * c))
    with pytest.raises(Exception, match="not finite"):
        metrics.task_losses(df.withColumn("p", F.lit(0.0)), "y", "logit", "d", "dh", "p", "w").collect()


def test_best_candidate(spark):
    scores = spark.createDataFrame([("a", 0.3, 1), ("b", 0.5, 2), ("c", 0.5, 3), ("d", float("nan"), 4)], "m string, f double, o int")
    assert metrics.best_candidate(scores, "m", "f", "o").first()["m"] == "b"
    assert metrics.best_candidate(scores.filter("m = 'd'"), "m", "f", "o").first()["m"] == "d"


def test_class_weights(spark):
    df = spark.createDataFrame([("a",)] * 6 + [("b",)] * 3, "l string")
    got = {r["l"]: (r["inverse_weight"], r["balanced_weight"]) for r in profiles.class_weights(df, "l").collect()}
    assert got["a"] == pytest.approx((2 / 3, 1.0)) and got["b"] == pytest.approx((4 / 3, 2.0))
    shares = {r["l"]: r["share"] for r in profiles.shares(df, "l").collect()}
    assert shares == pytest.approx({"a": 2 / 3, "b": 1 / 3})
    assert [r["l"] for r in profiles.rare_values(df, "l", 0.5).collect()] == ["b"]


def test_measured_bytes_of_every_type(spark):
    """A megabyte counts as one, in a binary, an array, a map or a struct as in a text."""
    big = F.repeat(F.lit("x"), 1 << 20)
    forms = {
        "text": big, "binary": big.cast("binary"), "array": F.array(big, big), "numbers": F.sequence(F.lit(1), F.lit(1 << 17)),
        "map": F.create_map(F.lit("k"), big), "struct": F.struct(F.lit(1).alias("a"), big.cast("binary").alias("b")),
        "nested": F.array(F.struct(F.array(big).alias("c"))),
    }
    for name, value in forms.items():
        size = measured_bytes(spark.range(1).select(value.alias("v")))
        assert (1 << 20) <= size <= (2 << 20) + 200, name
    nothing = spark.range(1).select(*[F.lit(None).cast(t).alias(f"c{i}") for i, t in enumerate(("string", "binary", "array<string>", "map<string,int>", "int"))])
    assert measured_bytes(nothing) < 200 and measured_bytes(nothing.limit(0)) == 0
