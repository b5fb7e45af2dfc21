"""Model bundles by property: better than the majority, repeatable, the same after loading."""

import math
import threading
import time

import pytest
from pyspark.ml.classification import GBTClassifier, LogisticRegression
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.ml.regression import GBTRegressor
from pyspark.sql import Observation
from pyspark.sql import functions as F

from latelane import schemas as S
from latelane.errors import ScoringError, TrainingError
from latelane.models import boosting, training
from latelane.models.bundles import Bundle
from latelane.models.encoding import encode_folds, feature_columns, fit_encoder
from latelane.operators import metrics, splits
from latelane.plans.predict import Predictor
from registry import models, standin
from registry.models import _stored_frame
from tests.conftest import SF

TINY = training.Settings(
    depth=3, trees=3, boosting_rounds=4, boosting_rate=0.5, logistic_rounds=10, days_rounds=5, days_rate=0.5, days_part=2,
    reason_depth=4, reason_trees=2, reason_rounds=8, reason_rate=0.5, reason_patience=2, statistics_blocks=16,
)


@pytest.fixture(scope="module")
def frame(spark):
    return _stored_frame(spark, SF)


@pytest.fixture(scope="module")
def binary(frame):
    return training.train_binary(frame, "row_key", TINY)


def test_unseen_level_is_all_zeros(spark):
    train = spark.createDataFrame([("a", 1.0, 1), ("b", None, 0), (None, 3.0, 1)], "c string, x double, y int")
    encoder, encoded = fit_encoder(train, "c", ["x"], ["c"], "y")
    new = spark.createDataFrame([("new", 2.0, 0), ("a", None, 0)], "c string, x double, y int")
    got = [r["features"].toArray().tolist() for r in encoder.transform(new).collect()]
    # x, x missing, then one place per seen level: missing, a, b
    assert got == [[2.0, 0.0, 0.0, 0.0, 0.0], [0.0, 1.0, 0.0, 1.0, 0.0]]
    assert encoded.count() == 3 and encoder.transform(train).count() == 3


def test_wide_category_becomes_target_means(spark):
    train = spark.range(400).select(
        F.col("id").cast("string").alias("k"), (F.col("id") % 100).cast("string").alias("c"), (F.col("id") % 2).cast("int").alias("y"))
    encoder, encoded = fit_encoder(train, "k", [], ["c"], "y", wide=("c",), smoothing=0.0)
    got = {r["c"]: r["features"][0] for r in encoder.transform(spark.createDataFrame([("3",), ("4",), ("new",)], "c string")).collect()}
    assert got == {"3": 1.0, "4": 0.0, "new": 0.5}
    # A training row's mean is that of the other folds: a level whose rows all share a fold has none.
    assert {r["features"][0] for r in encoded.filter("y = 1").collect()} <= {1.0, 0.5}


def test_own_target_never_enters_its_feature(spark):
    """Every level once: the other folds know nothing of it, whatever its target."""
    train = spark.range(200).select(*[F.col("id").cast("string").alias(x) for x in "kc"], (F.col("id") % 2).cast("int").alias("y"))
    _, encoded = fit_encoder(train, "k", [], ["c"], "y", wide=("c",))
    assert {round(r["features"][0], 9) for r in encoded.collect()} == {0.5}


def test_ordered_statistics_come_from_earlier_rows(spark):
    """A level's first block knows nothing of it, a later one the blocks before; new rows get the whole mean."""
    train = spark.range(600).select(F.col("id").cast("string").alias("k"), (F.col("id") % 3).cast("string").alias("c"), (F.col("id") % 3 == 1).cast("int").alias("y"))
    encoder, encoded = fit_encoder(train, "k", [], ["c"], "y", wide=("c",), smoothing=1.0, ordered=8)
    got = encoded.select("c", splits.key_bucket(F.col("k"), training.S.SPLIT_SEED + 2).alias("b"), vector_to_array("features")[0].alias("f")).collect()
    block = lambda r: r["b"] * 8 >> 32
    for r in got:
        before = sum(1 for x in got if x["c"] == r["c"] and block(x) < block(r))
        want = ((before if r["c"] == "1" else 0) + 1 / 3) / (before + 1)
        assert r["f"] == pytest.approx(want)
    assert encoder.transform(train.filter("c = '1'").limit(1)).first()["features"][0] == pytest.approx((200 + 1 / 3) / 201)


def test_folds_are_encoded_once_as_if_apart(spark):
    """Every fold's features and weights equal those computed from its own training rows alone."""
    rows = spark.range(300).select(
        F.col("id"), (F.col("id") * 7 % 5).cast("int").alias("fold"), F.concat(F.lit("L"), (F.col("id") * 13 % 11)).alias("c"),
        (F.col("id") * 3 % 7).cast("double").alias("x"), F.when(F.col("id") % 17 < 10, 0.0).when(F.col("id") % 17 < 15, 1.0).otherwise(2.0).alias("label"))
    table = encode_folds(rows, ["x"], ["c"], 3, 5, wide=("c",), smoothing=2.0)
    everything = rows.collect()
    share = lambda some, k: sum(r["label"] == k for r in some)
    for k in range(5):
        train = [r for r in everything if r["fold"] != k]
        prior = [share(train, i) / len(train) for i in range(3)]
        most = max(share(train, i) for i in range(3))
        want = {}
        for r in everything:
            known = [x for x in train if x["c"] == r["c"] and (r["fold"] == k or x["fold"] != r["fold"])]
            means = [(share(known, i) + 2 * prior[i]) / (len(known) + 2) for i in range(3)]
            values = [r["x"], *means, most / share(train, int(r["label"]))]
            want.setdefault(r["fold"] == k, []).append([round(v, 9) for v in (r["label"], *values)])
        for held, df in ((True, table.held_out(k)), (False, table.training(k))):
            got = [[round(v, 9) for v in (r["label"], *r["features"].toArray(), r["weight"])] for r in df.collect()]
            assert sorted(got) == sorted(want[held])


def test_a_fold_reads_its_own_numbers_alone(spark):
    """The stored rows hold a plain column for each number; what a fold's learner scans is the label, the fold, what all folds share and its own means."""
    rows = spark.range(60).select(
        F.col("id"), (F.col("id") % 3).cast("int").alias("fold"), F.concat(F.lit("L"), (F.col("id") * 13 % 11)).alias("c"), F.concat(F.lit("f"), F.col("id") % 4).alias("d"),
        (F.col("id") * 3 % 7).cast("double").alias("x"), (F.col("id") * 7 % 5 % 2).cast("double").alias("label"))
    table = encode_folds(rows, ["x"], ["c", "d"], 2, 3, wide=("c",))
    assert {f.dataType.simpleString() for f in table.rows.schema.fields} == {"double", "int"}
    for k in range(3):
        scanned = table.training(k)._jdf.queryExecution().executedPlan().toString().split("ReadSchema: ")[1]
        others = [m for j in range(3) if j != k for m in table.means[j]]
        assert len(table.means[k]) == 2 and all(f"{m}:" in scanned for m in table.means[k]) and not any(f"{m}:" in scanned for m in others)
        kinds = table.training(k).schema["features"].metadata["ml_attr"]["attrs"]
        assert [a["name"] for a in kinds["nominal"]] == ["__d_number"] and len(kinds["numeric"]) == 3


def test_fits_run_side_by_side_while_their_rows_fit(spark):
    assert training.fits_at_once(1_300_000, 12, 5) == 5 and training.fits_at_once(13_000_000, 12, 5) == 1 and training.fits_at_once(78_000_000, 12, 5) == 1
    assert training.fits_at_once(6_000_000, 12, 5) == 4 and training.fits_at_once(0, 12, 5) == 5
    running, most, lock = [0], [0], threading.Lock()

    def fit():
        with lock:
            running[0] += 1
            most[0] = max(most[0], running[0])
        time.sleep(0.05)
        with lock:
            running[0] -= 1
        return 7

    assert boosting.side_by_side(spark, [fit] * 5, 2) == [7] * 5 and most[0] <= 2


def test_node_numbers_leave_the_forest_as_it_is(spark):
    """A forest that holds each row's nodes has the trees that it has when it finds them again."""
    data = spark.range(500).select(F.col("id") * 37 % 101, F.col("id") * 17 % 23, (F.col("id") * 37 % 101 % 3).cast("double").alias("label"), F.lit(1.0).alias("weight"))
    data = VectorAssembler(inputCols=["a", "b"], outputCol="features").transform(data.toDF("a", "b", "label", "weight")).cache()
    trees = [training._forest(TINY, 3, 32, nodes).fit(data).toDebugString.split("\n", 1)[1] for nodes in (True, False)]
    assert trees[0] == trees[1]


def _boosted(spark, classes=3, rounds=6):
    data = spark.range(400).select((F.col("id") * 37 % 101).alias("a"), (F.col("id") * 17 % 23).alias("b"), (F.col("id") * 37 % 101 % classes).cast("double").alias("label"))
    encoder, encoded = fit_encoder(data.withColumn("k", F.col("a")), "k", ["a", "b"], [], "label", wide=())
    encoded = encoded.select("label", "features").cache()
    models = [GBTClassifier(maxIter=rounds, maxDepth=3, stepSize=0.3, seed=1).fit(
        encoded.select("features", (F.col("label") == k).cast("double").alias("label"))) for k in range(classes)]
    return encoded, models


def test_every_round_is_logged_as_a_model_of_so_many_rounds_would_score(spark):
    encoded, models = _boosted(spark)
    log = {r["iteration"]: r for r in boosting.staged(encoded, "label", models).collect()}
    assert sorted(log) == [1, 2, 3, 4, 5, 6]
    for n in (1, 4, 6):
        shorter = [GBTClassifier(maxIter=n, maxDepth=3, stepSize=0.3, seed=1).fit(
            encoded.select("features", (F.col("label") == k).cast("double").alias("label"))) for k in range(3)]
        df = encoded
        for k, m in enumerate(shorter):
            df = m.copy().setRawPredictionCol(f"raw{k}").setProbabilityCol("").setPredictionCol("").transform(df)
        rows = df.select("label", *[vector_to_array(f"raw{k}")[1].alias(f"m{k}") for k in range(3)]).collect()
        said = spark.createDataFrame([(r["label"], float(max(range(3), key=lambda k: r[f"m{k}"]))) for r in rows], "label double, said double")
        assert log[n]["macro_f1"] == pytest.approx(metrics.macro_f1(said, "label", "said").first()[0])
        p = [[1 / (1 + math.exp(-2 * r[f"m{k}"])) for k in range(3)] for r in rows]
        loss = -sum(math.log(x[int(r["label"])] / sum(x)) for x, r in zip(p, rows)) / len(rows)
        assert log[n]["loss"] == pytest.approx(loss)


def test_log_of_one_model_is_that_of_two_classes(spark):
    encoded, models = _boosted(spark, 2)
    log = boosting.staged(encoded, "label", models[1:]).orderBy("iteration").collect()
    assert len(log) == 6 and log[-1]["loss"] < log[0]["loss"]
    assert boosting.staged(encoded.limit(0), "label", models[1:]).count() == 0


def test_stopping_rule():
    assert boosting.stop_at([0.1, 0.5, 0.4, 0.5, 0.3, 0.9], 3) == (2, 5)
    assert boosting.stop_at([0.1, 0.5, 0.4, 0.6], 3) == (4, 4) and boosting.stop_at([0.2], 1) == (1, 1)


def test_boosting_goes_on_until_it_has_stopped(spark):
    """The fit is repeated with more rounds while its end still helps, and the log ends where patience did."""
    encoded, _ = _boosted(spark)
    sizes = []

    def fit(rounds):
        sizes.append(rounds)
        return [GBTClassifier(maxIter=rounds, maxDepth=2, stepSize=0.1, seed=1).fit(
            encoded.select("features", (F.col("label") == k).cast("double").alias("label"))) for k in range(3)]

    log, kept = boosting.boost_until(fit, encoded, "label", 12, 2)
    scores = [r["macro_f1"] for r in log.orderBy("iteration").collect()]
    assert sizes == sorted(set(sizes)) and scores[kept - 1] == max(scores) and max(scores[: kept - 1], default=-1) < max(scores)
    assert len(scores) == kept + 2 or len(scores) == 12 == sizes[-1]


def test_an_interrupted_ensemble_goes_on_to_the_same_model(spark, tmp_path, monkeypatch):
    data = spark.range(300).select((F.col("id") % 17).alias("a"), (F.col("id") % 7).alias("b"), ((F.col("id") % 17) * (F.col("id") % 7)).cast("double").alias("y"))
    _, encoded = fit_encoder(data.withColumn("k", F.col("a")), "k", ["a", "b"], [], "y", wide=())
    learner = lambda rounds: GBTRegressor(featuresCol="features", maxIter=rounds, maxDepth=3, stepSize=0.2, subsamplingRate=0.8, seed=3)
    whole, _ = boosting.boost_in_parts(encoded, "y", learner, 7, 3, str(tmp_path / "whole"))
    assert [m.getNumTrees for m in whole] == [3, 3, 1]
    fits = []

    def failing(rounds):
        fits.append(rounds)
        if len(fits) == 2:
            raise RuntimeError("executor lost")
        return learner(rounds)

    with pytest.raises(RuntimeError):
        boosting.boost_in_parts(encoded, "y", failing, 7, 3, str(tmp_path / "broken"))
    again, _ = boosting.boost_in_parts(encoded, "y", failing, 7, 3, str(tmp_path / "broken"))
    assert fits == [3, 3, 3, 1]  # the first part was not fitted again
    pick = lambda models: [r["p"] for r in boosting.added(encoded, models, "p").collect()]
    assert pick(whole) == pick(again)
    errors = [abs(r["p"] - r["y"]) for r in boosting.added(encoded, whole, "p").collect()]
    assert sum(errors) / len(errors) < 6  # the values spread over 0 to 96


def test_label_shares_and_too_many_levels(spark, monkeypatch):
    train = spark.range(300).select(
        F.col("id").cast("string").alias("k"), (F.col("id") % 3).cast("string").alias("c"), (F.col("id") % 3).cast("double").alias("y"))
    encoder, _ = fit_encoder(train, "k", [], ["c"], "y", classes=3, wide=("c",), smoothing=0.0)
    got = {r["c"]: r["features"].toArray().tolist() for r in encoder.transform(train.limit(3)).collect()}
    assert got == {"0": [1.0, 0.0, 0.0], "1": [0.0, 1.0, 0.0], "2": [0.0, 0.0, 1.0]}
    monkeypatch.setattr("latelane.models.encoding.MOST_LEVELS", 2)
    with pytest.raises(TrainingError, match="c has 3 levels"):
        fit_encoder(train, "k", [], ["c"], "y", wide=())


@pytest.mark.parametrize("sf", ["sf0.001", "sf0.01"])
def test_same_encoding_at_any_size(spark, sf):
    frame = _stored_frame(spark, f"/root/testdata/{sf}")
    numeric, categorical = feature_columns(frame)
    encoder, _ = fit_encoder(frame, "row_key", numeric, categorical, "will_delay")
    assert encoder.wide == ["origin_city", "destination_city", "supplier_name", "route_pair"]
    assert encoder.few_levels == ["origin_state", "destination_state", "product_category", "carrier_name", "truck_type", "month"]


def test_binary_beats_majority_and_repeats(frame, binary):
    bundle, scores = binary
    got = {r["member"]: (r["accuracy"], r["auc"]) for r in scores.collect()}
    assert set(got) == {"boosted", "forest", "logistic", "vote"}
    majority = max(r["share"] for r in frame.groupBy("will_delay").agg((F.count("*") / frame.count()).alias("share")).collect())
    assert got["vote"][0] > majority + 0.1 and got["vote"][1] > 0.8
    again = training.train_binary(frame, "row_key", TINY)[0]
    figures = lambda b: {k: v for k, v in b.scores.items() if k != "seconds_a_round"}
    assert figures(again) == pytest.approx(figures(bundle), abs=1e-6) and bundle.scores["seconds_a_round"] > 0
    assert bundle.log.count() == TINY.boosting_rounds


def test_whole_prediction_survives_saving(spark, frame, binary, tmp_path):
    look = standin.lookups(spark, SF)
    days, errors = training.train_days(frame, "row_key", TINY)
    reasons, report = training.train_reasons(frame, "row_key", 2, TINY)
    assert errors.first()["r2"] > 0.3 and reasons.scores["macro_f1"] > 0.3 and len(days.models) == 3
    assert {r["label"] for r in report.collect()} <= set(reasons.classes) and reasons.classes == sorted(reasons.classes)
    found = {r["kind"]: r for r in reasons.candidates.collect()}
    assert set(found) == {"forest", "boosted"} and reasons.scores["macro_f1"] == max(r["macro_f1"] for r in found.values())
    for r in found.values():  # every candidate can be opened again
        assert Bundle.load(spark, r["path"]).scores["macro_f1"] == r["macro_f1"]
    best = max(reasons.log.collect(), key=lambda r: (r["macro_f1"], -r["iteration"]))
    assert best["iteration"] == found["boosted"]["rounds"]
    sizes = {m.getNumTrees for m in reasons.models.values()}
    assert sizes in ({TINY.reason_trees}, {found["boosted"]["rounds"]})
    whole = Predictor(binary[0], days, reasons, look)
    whole.save(spark, str(tmp_path / "bundles"))
    loaded = Predictor.load(spark, str(tmp_path / "bundles"), look)
    assert loaded.reasons.log.count() == reasons.log.count() and loaded.reasons.candidates.count() == 2
    pick = lambda p: p.predict(frame).select("row_key", F.round("delay_probability", 9), "delay_reason", "estimated_delay_days").orderBy("row_key").toPandas()
    a, b = pick(whole), pick(loaded)
    assert len(a) == frame.count() and a.equals(b)
    gated = loaded.predict(frame).filter("not will_delay").agg(F.max("estimated_delay_days"), F.max(F.size("reason_top3"))).first()
    assert tuple(gated) == (0.0, 0)
    with pytest.raises(ScoringError):
        loaded.model_outputs(frame.drop("carrier_name"))
    with pytest.raises(ScoringError, match="absent"):
        Bundle.load(spark, str(tmp_path / "absent"))


def test_folds_are_scored_on_rows_not_trained_on(frame):
    scores = training.cross_validate_reasons(frame, "row_key", 2, TINY)
    assert scores.count() == 2 and scores.agg(F.min("macro_f1")).first()[0] > 0.2


def test_the_better_candidate_is_kept(frame):
    """A forest of one stump loses against boosted stumps, whose seeds then vote with shares."""
    weak = training.Settings(**{**TINY.__dict__, "reason_trees": 1, "reason_depth": 1, "reason_rounds": 6})
    bundle, _ = training.train_reasons(frame, "row_key", 2, weak)
    found = bundle.candidates.orderBy(F.desc("macro_f1"), "candidate").collect()
    assert found[0]["kind"] == "boosted" and len(bundle.models) == 2 * len(bundle.classes)
    late = training.prepare_reasons(frame, "row_key")[0].limit(50)
    for r in training.predict_reason(bundle, late).collect():
        assert len(r["reason_p"]) == len(bundle.classes) and sum(r["reason_p"]) == pytest.approx(1)


def test_large_tables_are_dealt_in_whole_waves():
    """29 million rows for 12 cores: 24 parts, not 15, whose last three would keep nine cores waiting."""
    assert training.even_parts(29_000_000, 12) == 24 and training.even_parts(78_000_000, 12) == 48
    assert training.even_parts(2_900_000, 12) == 12 and training.even_parts(2_900_000, 12, 7) == 2 and training.even_parts(0, 12) == 1


def test_boosting_holds_no_node_numbers_and_grows_the_same_trees(spark):
    encoded, _ = _boosted(spark, 2)
    spark.sparkContext.setCheckpointDir(training.new_path(spark, "checkpoints"))
    trees = []
    for held in ({}, {"cacheNodeIds": True}):
        learner = GBTClassifier(maxIter=5, maxDepth=4, seed=1, **{**training.Settings().long_boosting(), **held})
        trees.append(learner.fit(encoded).toDebugString.split("\n", 1)[1])
    assert trees[0] == trees[1] and "cacheNodeIds" not in training.Settings().long_boosting()


def test_missing_bundles_are_trained_side_by_side_on_one_frame(spark, monkeypatch):
    built, together, trained = [], threading.Barrier(3, timeout=60), []

    def train(spark, frame, name):
        together.wait()  # breaks unless all three are in training at once
        trained.append((name, frame))
        return name

    monkeypatch.setattr(models, "_TRAINED", {})
    monkeypatch.setattr(models, "_stored_frame", lambda spark, sf: built.append(sf) or "frame")
    monkeypatch.setattr(models, "_train", train)
    monkeypatch.setattr(models.Bundle, "load", staticmethod(lambda spark, path: path))
    names = ("binary", "days", "reasons")
    assert models._bundles(spark, SF, names) == list(names) and built == [SF]
    assert sorted(trained) == [(n, "frame") for n in names]
    assert models._bundle(spark, SF, "days") == "days" and len(trained) == 3  # a trained one is opened again


def test_models_of_two_classes_reach_the_tasks_of_a_session_that_observed_a_table(spark):
    spark.range(3).observe(Observation(), F.count(F.lit(1)).alias("n")).write.format("noop").mode("overwrite").save()
    rows = spark.range(400).select(F.col("id").alias("k"), (F.col("id") % 7).alias("x"), (F.col("id") % 7 > 3).cast("double").alias("label"))
    bundle = training.ReasonTrainer("k", 2, ["x"], [], TINY).fit(rows, "forest", [1, 2], 0)
    said = training.predict_reason(bundle, rows).select("label", F.get("reason_p", F.lit(1)).alias("p")).collect()
    assert len(said) == 400 and all((r.p > 0.5) == (r.label == 1) for r in said)
    data = VectorAssembler(inputCols=["x"], outputCol="features").transform(rows)
    model = training.fitted(LogisticRegression(), data)
    assert [r.prediction for r in model.transform(data).collect()] == [r.label for r in data.collect()]


def test_the_frame_holds_what_models_read_and_no_more(frame):
    numeric, categorical = feature_columns(frame)
    assert set(frame.columns) == {"row_key", "will_delay", "delay_days", "delay_reason", *numeric, *categorical}
    assert set(S.DEFAULT_FEATURES.categorical) <= set(categorical) and "value_per_kg" in numeric and "route_pair" in categorical


def test_folds_are_not_stored_beside_the_rows(frame, monkeypatch):
    stored, write = [], training.materialise
    monkeypatch.setattr(training, "materialise", lambda df, name: stored.append(name) or write(df, name))
    monkeypatch.setattr(training, "encode_folds", lambda rows, *_: stored.append(sorted(r[0] for r in rows.select("fold").distinct().collect())) or 1 / 0)
    with pytest.raises(ZeroDivisionError):
        training.cross_validate_reasons(frame, "row_key", 3, TINY)
    assert stored == ["reason_rows", [0, 1, 2]]
