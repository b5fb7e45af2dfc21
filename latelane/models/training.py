"""Training of the three model bundles: late or not, how many days, why.

Rows are encoded and written once before fitting, so the tree learners, which read them
many times, do not repeat the joins of the training frame.
"""

from __future__ import annotations

import json
import time
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.ml import Model
from pyspark.ml.classification import GBTClassifier, LogisticRegression, RandomForestClassifier
from pyspark.ml.feature import StringIndexer
from pyspark.ml.regression import GBTRegressor
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from latelane import schemas as S
from latelane.functions.numbers import argmax_index, at_least, mean_of, mean_of_arrays
from latelane.models import boosting
from latelane.models.bundles import Bundle
from latelane.models.encoding import encode_folds, feature_columns, fit_encoder
from latelane.operators import features, metrics, splits
from latelane.operators.joins import lookup_join
from latelane.operators.profiles import class_weights
from latelane.session import materialise, new_path, use_checkpoints


@dataclass(frozen=True)
class Settings:
    """Learner sizes.  The defaults are those of the models in use; tests take smaller ones."""

    depth: int = 6
    trees: int = 200
    boosting_rounds: int = 200
    boosting_rate: float = 0.1
    days_rounds: int = 400
    days_rate: float = 0.05
    days_part: int = 50
    subsample: float = 0.8
    logistic_rounds: int = 50
    reason_depth: int = 8
    reason_trees: int = 200
    reason_rounds: int = 2000
    reason_rate: float = 0.05
    reason_patience: int = 200
    reason_seeds: int = 5
    statistics_blocks: int = 256
    checkpoint_every: int = 10
    seed: int = S.SPLIT_SEED

    def long_boosting(self) -> dict:
        """The lineage is cut in the checkpoint folder every few rounds.

        A row's node is found again from the round's one tree: the same trees, and less to hold than a node number per row and level.
        """
        return {"checkpointInterval": self.checkpoint_every, "subsamplingRate": self.subsample}


def vote(df: DataFrame, names: list[str], prefix: str = "prediction") -> DataFrame:
    """Probability of being late of each model and their mean."""
    for n in names:
        df = df.withColumn(n, F.get(F.col(f"{prefix}_{n}"), F.lit(1))).drop(f"{prefix}_{n}")
    return df.withColumn("vote", mean_of(*[F.col(n) for n in names]))


#: Rows of a partition that learners read again and again: fewer are not worth a task, more do not fit its memory.
LEAST_PART_ROWS, PART_ROWS = 10_000, 2_000_000


def even_parts(rows: int, cores: int, fits: int = 1) -> int:
    """Parts of a table that so many ``fits`` read at once; beyond one wave of tasks, whole waves, so that no core waits for the last few."""
    parts = max(1, min(-(-cores // fits), rows // LEAST_PART_ROWS), -(-rows // PART_ROWS))
    return -(-parts // cores) * cores if parts > cores else parts


def fits_at_once(rows: int, cores: int, fits: int) -> int:
    """How many of the ``fits`` run at the same time: each holds its ``rows``, and a core has memory for one part of them."""
    return max(1, min(fits, cores * PART_ROWS // max(rows, 1)))


def _dealt(df: DataFrame, name: str, fits: int = 1) -> DataFrame:
    """``df`` written in even parts: enough for all cores when so many ``fits`` read it at once, and more of a large table."""
    stored = materialise(df, name)
    rows, cores = stored.count(), df.sparkSession.sparkContext.defaultParallelism
    return materialise(stored.repartition(even_parts(rows, cores, fits)), f"{name}_dealt")


def fitted(learner, data: DataFrame) -> Model:
    """The fitted model; one of two classes as it comes back from where it was stored, without the summary of its training.

    That summary holds the session, which no task can be sent once a table was observed in it, as the CSV readers do.
    """
    model = learner.fit(data)
    if not (getattr(model, "hasSummary", False) and model.numClasses == 2):
        return model
    path = new_path(data.sparkSession, "fitted")
    model.write().save(path)
    return type(model).load(path)


def _timed(learner, data: DataFrame) -> Callable[[], tuple[Model, float]]:
    def fit() -> tuple[Model, float]:
        begun = time.monotonic()
        model = fitted(learner, data)
        return model, time.monotonic() - begun

    return fit


def train_binary(frame: DataFrame, key: str, settings: Settings = Settings()) -> tuple[Bundle, DataFrame]:
    """Three learners and the scores of each and of their mean on the held-out fifth."""
    numeric, categorical = feature_columns(frame)
    rows = features.require_rows(frame.select(key, "will_delay", *numeric, *categorical), "training rows")
    parts = materialise(splits.stratified_split(rows, key, "will_delay", seed=settings.seed), "binary_rows")
    train, test = parts.filter(~F.col("is_test")), parts.filter("is_test")
    encoder, encoded = fit_encoder(train, key, numeric, categorical, "will_delay")
    data = _dealt(encoded.select("will_delay", "features"), "binary_train")
    common = {"featuresCol": "features", "labelCol": "will_delay"}
    use_checkpoints(frame.sparkSession)
    learners = {
        "boosted": GBTClassifier(
            **common, **settings.long_boosting(), maxDepth=settings.depth, stepSize=settings.boosting_rate,
            maxIter=settings.boosting_rounds, seed=settings.seed,
        ),
        "forest": RandomForestClassifier(
            **common, maxDepth=settings.depth, numTrees=settings.trees, subsamplingRate=settings.subsample, seed=settings.seed,
        ),
        "logistic": LogisticRegression(**common, maxIter=settings.logistic_rounds, regParam=0.001),
    }
    timed = boosting.side_by_side(frame.sparkSession, [_timed(x, data) for x in learners.values()])
    models = {name: model for name, (model, _) in zip(learners, timed)}
    bundle = Bundle(encoder, models)
    bundle.scores["seconds_a_round"] = timed[0][1] / settings.boosting_rounds
    bundle.log = materialise(boosting.staged(encoder.transform(test), "will_delay", [models["boosted"]]), "training_log")
    scored = materialise(
        vote(bundle.apply(test), list(models)).select("will_delay", *models, "vote"), "binary_scored"
    )
    scores = metrics.member_metrics(scored, "will_delay", [*models, "vote"])
    for row in scores.collect():  # one row per member
        bundle.scores[f"{row['member']}_accuracy"], bundle.scores[f"{row['member']}_auc"] = row["accuracy"], row["auc"]
    return bundle, scores


def train_days(frame: DataFrame, key: str, settings: Settings = Settings(), path: str | None = None) -> tuple[Bundle, DataFrame]:
    """Boosted regressor of the delay in days on the late rows, and its errors on the held-out fifth.

    The ensemble grows by parts stored under ``path``; given the path of a call that was interrupted, it goes on from there.
    """
    spark = frame.sparkSession
    numeric, categorical = feature_columns(frame)
    late = features.delayed_by_days(frame).select(key, "delay_days", *numeric, *categorical)
    late = materialise(splits.hash_split(features.require_rows(late, "delayed shipments"), key, seed=settings.seed), "days_rows")
    train, test = late.filter(~F.col("is_test")), late.filter("is_test")
    encoder, encoded = fit_encoder(train, key, numeric, categorical, "delay_days", scale=True)
    data = _dealt(encoded.select("delay_days", "features"), "days_train")
    use_checkpoints(spark)
    parts, seconds = boosting.boost_in_parts(data, "delay_days", lambda rounds: GBTRegressor(
        featuresCol="features", **settings.long_boosting(), maxDepth=settings.depth, stepSize=settings.days_rate,
        maxIter=rounds, seed=settings.seed,
    ), settings.days_rounds, settings.days_part, path or new_path(spark, "days_parts"))
    bundle = Bundle(encoder, {f"part_{i}": m for i, m in enumerate(parts)})
    scored = predict_days(bundle, test, "days_hat").select("delay_days", at_least(F.col("days_hat"), 0.0).alias("days_hat"))
    scores = metrics.regression_metrics(materialise(scored, "days_scored"), "delay_days", "days_hat")
    bundle.scores.update(scores.first().asDict() | {"seconds_a_round": seconds / settings.days_rounds})
    return bundle, scores


def predict_days(bundle: Bundle, df: DataFrame, output: str) -> DataFrame:
    """``df`` with the sum of the parts of the ensemble."""
    names = [f"prediction_{n}" for n in bundle.models]
    return bundle.apply(df).withColumn(output, sum((F.col(n) for n in names), F.lit(0.0))).drop(*names)


def _weighted(df: DataFrame) -> DataFrame:
    """``df`` with the balanced weight of each row's label, from these rows alone."""
    weights = materialise(class_weights(df, "label"), "class_weights").select("label", F.col("balanced_weight").alias("weight"))
    return lookup_join(df, weights, ["label"])


def prepare_reasons(frame: DataFrame, key: str) -> tuple[DataFrame, list[str], list[str], list[str]]:
    """Late rows with a numeric ``label``; (rows, classes, numeric columns, categorical columns)."""
    numeric, categorical = feature_columns(frame)
    late = features.delayed_with_reason(frame).select(key, "delay_reason", *numeric, *categorical)
    late = materialise(features.require_rows(late, "delayed shipments"), "reason_rows")
    labels = StringIndexer(inputCol="delay_reason", outputCol="label", stringOrderType="alphabetAsc").fit(late)
    return labels.transform(late), list(labels.labels), numeric, categorical


def _forest(settings: Settings, seed: int, bins: int, nodes: bool = False) -> RandomForestClassifier:
    """``nodes``: each row's node in every tree is held instead of found again, which is faster where memory holds it; the trees are the same."""
    return RandomForestClassifier(
        featuresCol="features", labelCol="label", weightCol="weight", maxDepth=settings.reason_depth,
        numTrees=settings.reason_trees, maxBins=bins, seed=seed, cacheNodeIds=nodes,
    )


class ReasonTrainer:
    """Fits forests, or boosted trees of one class against the rest, for the reasons of one frame."""

    def __init__(self, key: str, classes: int, numeric: list[str], categorical: list[str], settings: Settings):
        self.key, self.classes, self.numeric, self.categorical, self.settings = key, classes, numeric, categorical, settings

    def encoded(self, train: DataFrame, ordered: int = 0, fits: int = 1):
        """(encoder, stored and weighted rows, bins): a category number needs a bin of its own; the encoder has checked that there are few."""
        encoder, rows = fit_encoder(
            train, self.key, self.numeric, self.categorical, "label", classes=self.classes, one_hot=False, ordered=ordered
        )
        data = _dealt(_weighted(rows.select("label", "features")), "reason_train", fits)
        bins = max([32, *(len(x) + 2 for x in encoder.pipeline.stages[0].labelsArray)]) if encoder.few_levels else 32
        return encoder, data, bins

    def boosted(self, data: DataFrame, bins: int, rounds: int, seeds: list[int]) -> dict[str, Model]:
        """A model per seed and class, all fitted side by side."""
        use_checkpoints(data.sparkSession)
        fits = {}
        for seed in seeds:
            for k in range(self.classes):
                one = data.select((F.col("label") == k).cast("double").alias("label"), "features", "weight")
                learner = GBTClassifier(
                    featuresCol="features", labelCol="label", weightCol="weight", **self.settings.long_boosting(), maxBins=bins,
                    maxDepth=self.settings.reason_depth, stepSize=self.settings.reason_rate, maxIter=rounds, seed=seed,
                )
                fits[f"boosted_{seed}_{k}"] = lambda learner=learner, one=one: learner.fit(one)
        return dict(zip(fits, boosting.side_by_side(data.sparkSession, list(fits.values()))))

    def rounds_that_help(self, train: DataFrame) -> tuple[DataFrame, int]:
        """(training log, kept round) of boosting on four fifths of ``train``, stopped by the macro F1 on the last fifth."""
        settings = self.settings
        split = materialise(splits.stratified_split(train, self.key, "label", seed=settings.seed + 1), "reason_validation")
        encoder, data, bins = self.encoded(split.filter(~F.col("is_test")), settings.statistics_blocks, self.classes)
        validation = materialise(encoder.transform(split.filter("is_test")).select("label", "features"), "reason_validation_rows")
        fit = lambda rounds: list(self.boosted(data, bins, rounds, [settings.seed]).values())
        return boosting.boost_until(fit, validation, "label", settings.reason_rounds, settings.reason_patience)

    def fit(self, train: DataFrame, kind: str, seeds: list[int], rounds: int) -> Bundle:
        boosted = kind == "boosted"
        encoder, data, bins = self.encoded(train, self.settings.statistics_blocks * boosted, len(seeds) * (self.classes if boosted else 1))
        if boosted:
            return Bundle(encoder, self.boosted(data, bins, rounds, seeds))
        fits = [lambda s=s: fitted(_forest(self.settings, s, bins), data) for s in seeds]
        return Bundle(encoder, {f"forest_{s}": m for s, m in zip(seeds, boosting.side_by_side(train.sparkSession, fits))})


def predict_reason(bundle: Bundle, df: DataFrame, output: str = "reason_p") -> DataFrame:
    """``df`` with the mean class probabilities of the bundle's models; one-against-rest models give shares of a seed's total."""
    names = {n: f"prediction_{n}" for n in bundle.models}
    by_seed: dict[str, list[str]] = {}
    for n, c in names.items():
        by_seed.setdefault(n.split("_")[1], []).append(c)
    out = bundle.apply(df)
    if all(n.startswith("forest") for n in names):
        return out.withColumn(output, mean_of_arrays(*[F.col(c) for c in names.values()])).drop(*names.values())
    said = {f"__said_{s}": F.array(*[F.get(F.col(c), F.lit(1)) for c in columns]) for s, columns in by_seed.items()}
    out = out.withColumns(said).withColumns({f"{c}_of": F.aggregate(c, F.lit(0.0), lambda t, x: t + x) for c in said})
    return out.withColumn(output, mean_of_arrays(*[_divided(c, f"{c}_of") for c in said])).drop(
        *names.values(), *said, *[f"{c}_of" for c in said]
    )


def _divided(values: str, by: str) -> Column:
    return F.transform(values, lambda x: x / F.col(by))


def _predicted(bundle: Bundle, df: DataFrame) -> DataFrame:
    return predict_reason(bundle, df.select("label", *bundle.encoder.numeric, *bundle.encoder.few_levels, *bundle.encoder.wide)).select(
        "label", argmax_index(F.col("reason_p")).cast("double").alias("predicted")
    )


def cross_validate_reasons(frame: DataFrame, key: str, folds: int = S.FOLDS, settings: Settings = Settings()) -> DataFrame:
    """Macro F1 per stratified fold; nothing that a fold's model has seen comes from that fold.

    The rows are encoded once for all folds, and the forests are fitted side by side, as many as the cluster's memory holds.
    """
    rows, classes, numeric, categorical = prepare_reasons(frame, key)
    folded = splits.stratified_folds(rows, key, "label", folds, settings.seed)  # found from a row's hash again, not stored beside the rows
    table = encode_folds(folded, numeric, categorical, len(classes), folds)
    held, cores = folded.count(), frame.sparkSession.sparkContext.defaultParallelism
    fits = [
        lambda k=k: fitted(_forest(settings, settings.seed + k, table.bins, held <= cores * PART_ROWS), table.training(k)) for k in range(folds)
    ]
    scored = None
    for k, model in enumerate(boosting.side_by_side(frame.sparkSession, fits, fits_at_once(held, cores, folds))):
        part = model.transform(table.held_out(k)).select("label", F.col("prediction").alias("predicted"), F.lit(k).alias("fold"))
        scored = part if scored is None else scored.unionByName(part)
    return metrics.macro_f1(scored, "label", "predicted", ("fold",))


CANDIDATES = "candidate int, kind string, parameters string, seed int, rounds int, macro_f1 double, path string"


def train_reasons(
    frame: DataFrame, key: str, seeds: int | None = None, settings: Settings = Settings(), kinds: tuple[str, ...] = ("forest", "boosted"),
) -> tuple[Bundle, DataFrame]:
    """The better of forests and boosted trees, a vote under several seeds, fitted on all rows, and its per-class report.

    Each kind is a candidate: fitted on four fifths of the rows, stored, and scored by its macro F1 on the fifth it has not
    seen.  The table of candidates names the best one, whose stored bundle gives the report; that kind is then fitted on all
    rows.  Boosting keeps the round at which a validation part of the four fifths was predicted best.  The bundle carries
    the table (``candidates``) and the training log (``log``).
    """
    spark = frame.sparkSession
    rows, classes, numeric, categorical = prepare_reasons(frame, key)
    parts = materialise(splits.stratified_split(rows, key, "label", seed=settings.seed), "reason_parts")
    chosen = [settings.seed + 10 * i for i in range(seeds or settings.reason_seeds)]
    trainer = ReasonTrainer(key, len(classes), numeric, categorical, settings)
    train, test = parts.filter(~F.col("is_test")).drop("is_test"), parts.filter("is_test")
    log, rounds = trainer.rounds_that_help(train) if "boosted" in kinds else (None, 0)
    names = F.array(*[F.lit(c) for c in classes])
    found = []
    for place, kind in enumerate(kinds):
        bundle = trainer.fit(train, kind, chosen, rounds)
        scored = materialise(_predicted(bundle, test), "reason_scored")
        named = scored.select(*[F.get(names, F.col(c).cast("int")).alias(c) for c in ("label", "predicted")])
        report = metrics.class_report(metrics.confusion(named, "label", "predicted"))
        bundle.scores = {k: float(v) for k, v in metrics.report_averages(report).first().asDict().items()}
        bundle.classes, path = classes, new_path(spark, f"candidate_{kind}")
        bundle.report = report
        bundle.save(spark, path)
        size = {"depth": settings.reason_depth, "trees": settings.reason_trees} if kind == "forest" else {
            "depth": settings.reason_depth, "rate": settings.reason_rate}
        found.append((place, kind, json.dumps(size), settings.seed, rounds if kind == "boosted" else None, bundle.scores["macro_f1"], path))
    candidates = spark.createDataFrame(found, CANDIDATES)
    best = metrics.best_candidate(candidates, "path", "macro_f1", "candidate").first()["path"]
    kept = Bundle.load(spark, best)
    bundle = trainer.fit(parts, next(c[1] for c in found if c[-1] == best), chosen, rounds)
    bundle.classes, bundle.scores, bundle.candidates, bundle.log = classes, kept.scores, candidates, log
    return bundle, kept.report
