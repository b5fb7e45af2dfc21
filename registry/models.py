"""Registered queries that train or apply models, and the streaming ones.

What a learner finds cannot be written in SQL.  What it is given, and what must hold of what it
returns, can: the rows on each side of the split, the rows scored, and statements that must be true,
about the sizes of the models and against simple predictors computed from the data.
Learners have the depths and rates of their defaults, and the fewer trees and rounds of ``SIZES``, so that a query ends within
a minute or two on one machine (the README has the figures of the whole sizes).  A bundle is trained once in a session and
then opened from where it was saved.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from latelane.functions import enrichment as E
from latelane.models import boosting, training
from latelane.models.bundles import Bundle
from latelane.models.encoding import feature_columns
from latelane.operators import features, metrics, splits
from latelane.plans.lookups import StoredLookups
from latelane.plans.predict import Predictor
from latelane.plans.scoring import Lookups
from latelane.session import materialise, new_path
from latelane.sources import readers, writers
from latelane.sources.store import FeatureStore
from latelane.streaming import scoring as stream
from registry import standin
from registry.queries import (
    REQUEST_EXTRA, SCORED_AT, _frame, flat_rejected, flat_response, model_outputs, request_files, tidy,
)


def _stored_frame(spark: SparkSession, sf: str) -> DataFrame:
    """The frame with the key, the targets and the features; no other column of a shipment is shuffled for it or stored."""
    frame = _frame(spark, sf)
    numeric, categorical = feature_columns(frame)
    return materialise(frame.select("row_key", "will_delay", "delay_days", "delay_reason", *numeric, *categorical), "training_frame")


def _sides(rows: DataFrame, label: str, holds: dict[str, bool]) -> DataFrame:
    """Rows per label and side of a split, and the statements."""
    counted = rows.groupBy(F.col(label).cast("string").alias("label"), "is_test").agg(F.count(F.lit(1)).alias("rows"))
    return counted.withColumns({name: F.lit(bool(value)) for name, value in holds.items()})


SIZES = training.Settings(
    trees=40, boosting_rounds=30, days_rounds=40, days_part=20, days_rate=0.1, reason_trees=20, reason_rounds=100, reason_patience=10, reason_seeds=5,
)
_TRAINED: dict[tuple[str, str, str], str] = {}


def _train(spark: SparkSession, frame: DataFrame, name: str) -> str:
    """The folder of a newly trained bundle."""
    bundle, report = {
        "binary": lambda: training.train_binary(frame, "row_key", SIZES), "days": lambda: training.train_days(frame, "row_key", SIZES),
        "reasons": lambda: training.train_reasons(frame, "row_key", 1, SIZES),
        "reason_seeds": lambda: training.train_reasons(frame, "row_key", None, SIZES, ("forest",)),
    }[name]()
    bundle.report = report
    path = new_path(spark, f"bundle_{name}")
    bundle.save(spark, path)
    return path


def _bundles(spark: SparkSession, sf: str, names: tuple[str, ...], frame: DataFrame | None = None) -> list[Bundle]:
    """Trained bundles, opened from their folders; those that this session lacks are first trained side by side on one stored frame."""
    places = {name: (spark.sparkContext.applicationId, sf, name) for name in names}
    new = [name for name in names if places[name] not in _TRAINED]
    if new:
        rows = _stored_frame(spark, sf) if frame is None else frame
        for name, path in zip(new, boosting.side_by_side(spark, [lambda name=name: _train(spark, rows, name) for name in new])):
            _TRAINED[places[name]] = path
    return [Bundle.load(spark, _TRAINED[place]) for place in places.values()]


def _bundle(spark: SparkSession, sf: str, name: str, frame: DataFrame | None = None) -> Bundle:
    return _bundles(spark, sf, (name,), frame)[0]


def _trees(bundle: Bundle) -> dict[str, int]:
    return {name: len(m.treeWeights) for name, m in bundle.models.items() if hasattr(m, "treeWeights")}


def ml_binary(spark: SparkSession, sf: str) -> DataFrame:
    frame, size = _stored_frame(spark, sf), SIZES
    bundle = _bundle(spark, sf, "binary", frame)
    got = {r["member"]: r for r in bundle.report.collect()}  # one row per member
    share = frame.agg(F.avg("will_delay").alias("s")).first()["s"]
    split = splits.stratified_split(frame.select("row_key", "will_delay"), "row_key", "will_delay")
    return _sides(split, "will_delay", {
        "four_members": set(got) == {"boosted", "forest", "logistic", "vote"},
        "whole_size": _trees(bundle) == {"boosted": size.boosting_rounds, "forest": size.trees},
        "half_the_error": all(1 - got[m]["accuracy"] < 0.5 * min(share, 1 - share) for m in got), "scores_are_kept": bundle.scores["vote_auc"] == got["vote"]["auc"],
        "logged_rounds": bundle.log.count() == size.boosting_rounds,
    })


def ml_days(spark: SparkSession, sf: str) -> DataFrame:
    frame, size = _stored_frame(spark, sf), SIZES
    bundle = _bundle(spark, sf, "days", frame)
    got = bundle.report.first()
    split = splits.hash_split(features.delayed_by_days(frame).withColumn("all", F.lit("late")), "row_key")
    return _sides(split, "all", {
        "whole_size": sum(_trees(bundle).values()) == size.days_rounds, "explains_most": got["r2"] > 0.9,
        "scores_are_kept": bundle.scores["r2"] == got["r2"],
    })


def _reasons(frame: DataFrame, bundle: Bundle, holds: dict[str, bool]) -> DataFrame:
    """Split and statements, and the support of each class in the report."""
    rows = features.delayed_with_reason(frame)
    largest = rows.groupBy("delay_reason").count().agg((F.max("count") / F.sum("count")).alias("s")).first()["s"]
    split = _sides(splits.stratified_split(rows, "row_key", "delay_reason"), "delay_reason", {
        "classes_in_order": bundle.classes == sorted(bundle.classes),
        "far_above_majority": bundle.scores["macro_f1"] > 2 * largest, **holds,
    })
    return split.join(bundle.report.select("label", "support"), "label", "left")


def ml_reason(spark: SparkSession, sf: str) -> DataFrame:
    """A forest and boosted trees as candidates; boosting stopped early, the better candidate kept and fitted on all rows."""
    frame, size = _stored_frame(spark, sf), SIZES
    bundle = _bundle(spark, sf, "reasons", frame)
    found = {r["kind"]: r for r in bundle.candidates.collect()}  # two rows
    rounds = found["boosted"]["rounds"]
    return tidy(_reasons(frame, bundle, {
        "boosted_at_least_forest": found["boosted"]["macro_f1"] >= found["forest"]["macro_f1"],
        "best_is_kept": bundle.scores["macro_f1"] == max(r["macro_f1"] for r in found.values()),
        "stopped_early": bundle.log.count() < size.reason_rounds and bundle.log.count() == rounds + size.reason_patience,
        "whole_size": set(_trees(bundle).values()) in ({rounds}, {size.reason_trees}),
    }))


def ml_seed_ensemble(spark: SparkSession, sf: str) -> DataFrame:
    """Forests under five seeds."""
    frame, size = _stored_frame(spark, sf), SIZES
    bundle = _bundle(spark, sf, "reason_seeds", frame)
    return tidy(_reasons(frame, bundle, {
        "whole_size": list(_trees(bundle).values()) == [size.reason_trees] * size.reason_seeds,
    }))


def training_log(spark: SparkSession, sf: str) -> DataFrame:
    """The log that boosting the reasons wrote, as tab-separated text and read back: its best round is the one kept."""
    bundle, path = _bundle(spark, sf, "reasons"), new_path(spark, "training_log")
    writers.write_training_log(bundle.log, path)
    log = readers.read_training_log(spark, path)
    kept = bundle.candidates.filter(F.col("kind") == "boosted").select("rounds").scalar()
    facts = log.agg(F.min("iteration").alias("first"), F.max("iteration").alias("last"), F.count(F.lit(1)).alias("rounds"), F.min("loss").alias("loss"))
    return tidy(readers.best_iteration(log).join(facts).select(
        F.lit("reasons").alias("model"), (F.col("best_iteration") == kept).alias("best_is_kept"), "rounds_after_best",
        ((F.col("first") == 1) & (F.col("last") == F.col("rounds"))).alias("every_round"), (F.col("loss") > 0).alias("has_loss"),
    ))


def ml_cv(spark: SparkSession, sf: str) -> DataFrame:
    frame = _stored_frame(spark, sf)
    scores = materialise(training.cross_validate_reasons(frame, "row_key", settings=SIZES), "cv_scores")
    rows = features.delayed_with_reason(frame).select("row_key", "delay_reason")
    largest = rows.groupBy("delay_reason").count().agg((F.max("count") / F.sum("count")).alias("s")).first()["s"]
    sizes = splits.stratified_folds(rows, "row_key", "delay_reason").groupBy("fold").agg(F.count(F.lit(1)).alias("rows"))
    named = scores.select("fold", (F.col("macro_f1") > 2 * largest).alias("far_above_majority"))
    passed = metrics.cv_summary(scores).first()["passed"]
    return tidy(sizes.join(named, "fold").withColumn("passed", F.lit(passed)))


def _enriched(p: Column) -> Column:
    """The two rules over a row's own probability, written out once more."""
    shifted = F.when(F.col("vendor_found"), F.least(F.lit(1.0), F.greatest(F.lit(0.0), p + E.vendor_shift(F.col("vendor_rate"))))).otherwise(p)
    w = E.model_weight(F.col("route_confidence"))
    mixed = F.least(F.lit(1.0), F.greatest(F.lit(0.0), w * shifted + (1 - w) * F.col("route_rate")))
    return F.when(F.col("route_found"), mixed).otherwise(shifted)


def _predictor(spark: SparkSession, sf: str, frame: DataFrame | None = None) -> Predictor:
    return Predictor(*_bundles(spark, sf, ("binary", "days", "reasons"), frame), standin.lookups(spark, sf))


def ml_score(spark: SparkSession, sf: str) -> DataFrame:
    """The three bundles saved again and loaded, and every shipment scored by both in one pass; per row what must hold."""
    frame = _stored_frame(spark, sf)
    trained = _predictor(spark, sf, frame)
    folder = new_path(spark, "bundles")
    trained.save(spark, folder)
    loaded = Predictor.load(spark, folder, trained.lookups)
    outputs = ("raw_probability", "model_days", "reason_probabilities")
    before = trained.model_outputs(features.with_derived(frame)).withColumn("before", F.struct(*outputs)).drop(*outputs)
    scored = loaded.predict(before)
    p, late = F.col("delay_probability"), F.col("will_delay")
    return scored.select(
        "row_key",
        (late == (p >= 0.5)).alias("decision_follows"),
        (late | ((F.col("estimated_delay_days") == 0) & (F.col("delay_reason") == "No Delay Expected") & (F.size("reason_top3") == 0))).alias("gated"),
        (F.abs(p - _enriched(F.col("raw_probability"))) < 1e-9).alias("enriched"),
        (F.abs(F.aggregate("reason_probabilities", F.lit(0.0), lambda t, r: t + r["probability"]) - 1) < 1e-6).alias("shares_sum"),
        (F.struct(*outputs) == F.col("before")).alias("loaded_equals_saved"),
    )


def ml_stream(spark: SparkSession, sf: str) -> DataFrame:
    """Saved bundles answer the requests of a stream; every valid request is answered once."""
    loaded = _predictor(spark, sf)
    arriving = stream.read_requests(spark, request_files(spark, sf), REQUEST_EXTRA)
    out, refused = new_path(spark, "ml_scored"), new_path(spark, "ml_refused")
    stream.write_answers(
        arriving, loaded.model_outputs, loaded.lookups, out, refused, new_path(spark, "stream_state"), ("row_key",), once=True
    ).awaitTermination()
    p = F.col("prediction.delay_probability")
    return spark.read.parquet(f"{out}/run=*").select(
        "row_key", (F.col("prediction.will_delay") | (F.col("prediction.estimated_delay_days") == 0)).alias("gated"),
        p.between(0, 1).alias("is_probability"),
    )


def _streamed(spark: SparkSession, sf: str) -> tuple[str, str]:
    """The request files answered by a stream: folders of the answers and of the rejected requests."""
    arriving = stream.read_requests(spark, request_files(spark, sf), REQUEST_EXTRA)
    out, refused = new_path(spark, "scored"), new_path(spark, "refused")
    stream.write_answers(
        arriving, model_outputs, standin.lookups(spark, sf), out, refused, new_path(spark, "stream_state"), ("row_key",), once=True,
        scored_at=F.lit(SCORED_AT).cast("timestamp"),
    ).awaitTermination()
    return out, refused


def stream_score(spark: SparkSession, sf: str) -> DataFrame:
    """The requests as arriving files, answered by a stream; equal to the batch result."""
    return tidy(flat_response(spark.read.parquet(f"{_streamed(spark, sf)[0]}/run=*"), "row_key"))


def stream_rejected(spark: SparkSession, sf: str) -> DataFrame:
    """The requests that the stream refuses, with the rules they break."""
    return flat_rejected(spark.read.parquet(f"{_streamed(spark, sf)[1]}/run=*"))


def stream_counters(spark: SparkSession, sf: str) -> DataFrame:
    """Counters over all micro-batches of the same stream."""
    arriving = stream.read_requests(spark, request_files(spark, sf), REQUEST_EXTRA)
    out = new_path(spark, "counters")
    stream.write_counters(
        arriving, standin.lookups(spark, sf), out, new_path(spark, "stream_state"), once=True
    ).awaitTermination()
    return tidy(spark.read.parquet(f"{out}/run=*").agg(
        F.sum("valid_rows").alias("valid_rows"), F.sum("rejected_rows").alias("rejected_rows"),
        F.max("vendor_count").alias("vendor_count"), F.max("route_count").alias("route_count"),
    ))


def stream_lookup_versions(spark: SparkSession, sf: str) -> DataFrame:
    """Requests that arrive at a running query before and after its vendor lookup is replaced by one of every second vendor."""
    look, stored = standin.lookups(spark, sf), StoredLookups(FeatureStore(spark, new_path(spark, "store")))
    requests = spark.read.text(request_files(spark, sf))
    early = F.col("value").contains('"l_linenumber":1,')
    folder, out = new_path(spark, "arrivals"), new_path(spark, "by_version")
    stored.publish(look)
    writers.compressed(requests.filter(early).write.mode("append")).text(folder)
    query = stream.write_answers(
        stream.read_requests(spark, folder, REQUEST_EXTRA), model_outputs, stored, out, new_path(spark, "refused"),
        new_path(spark, "stream_state"), ("row_key",),
    )
    try:
        query.processAllAvailable()
        stored.publish(Lookups(look.vendors.filter(F.col("vendor_id").cast("int") % 2 == 0), look.routes))
        writers.compressed(requests.filter(~early).write.mode("append")).text(folder)
        query.processAllAvailable()
    finally:
        query.stop()
    return tidy(spark.read.parquet(f"{out}/run=*").select("row_key", "lookup_version", "enrichment.vendor_tier"))


QUERIES = [
    training_log, stream_lookup_versions, ml_binary, ml_days, ml_reason, ml_seed_ensemble, ml_cv, ml_score, ml_stream, stream_score, stream_rejected, stream_counters,
]
