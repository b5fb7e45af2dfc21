"""Evaluation metrics as DataFrame aggregates over scored rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from latelane import schemas as S
from latelane.operators.ranks import percentiles, running_totals
from latelane.session import materialise


def accuracy(actual: Column, predicted: Column) -> Column:
    return F.avg((actual == predicted).cast("double"))


def roc_auc(df: DataFrame, label: str, scores: list[str]) -> DataFrame:
    """Area under the ROC curve of each score (``member``, ``auc``), ties counting half.

    Rows are counted per distinct score; each positive is credited with the negatives
    below it and half of those at its own score.  All scores are ranked in one pass.
    """
    return _auc_of(score_counts(df, label, scores))


def score_counts(df: DataFrame, label: str, scores: list[str]) -> DataFrame:
    """Positives and negatives per distinct score of each member, NULL scores too."""
    long = df.select(label, F.inline(F.array(*[
        F.struct(F.lit(s).alias("member"), F.col(s).cast("double").alias("score")) for s in scores
    ])))
    return long.groupBy("member", "score").agg(
        F.count_if(F.col(label) == 1).alias("pos"), F.count_if(F.col(label) == 0).alias("neg")
    )


def _auc_of(counts: DataFrame) -> DataFrame:
    counts = counts.filter(F.col("score").isNotNull())
    ranked = running_totals(counts, ["member", "score"], ["pos", "neg"])
    # ``neg_below`` also holds the negatives of the members before; each positive carries the same number.
    pos, neg = F.sum("pos").cast("double"), F.sum("neg").cast("double")
    won = F.sum(F.col("pos").cast("double") * (F.col("neg_below") + F.col("neg") * 0.5)) - pos * F.min("neg_below")
    return ranked.groupBy("member").agg(F.try_divide(won, pos * neg).alias("auc"))


def binary_metrics(df: DataFrame, label: str, score: str, threshold: float = S.DECISION_THRESHOLD) -> DataFrame:
    """One row: rows, accuracy, precision, recall, F1 and AUC of the positive class."""
    counts = materialise(score_counts(df, label, [score]), "score_counts")  # the rows are read once, for this
    said = F.coalesce(F.col("score") >= threshold, F.lit(False))
    counted = counts.agg(*[
        F.coalesce(F.sum(F.when(side, F.col(n))), F.lit(0)).alias(name)
        for name, side, n in (("tp", said, "pos"), ("fp", said, "neg"), ("fn", ~said, "pos"), ("tn", ~said, "neg"))
    ])
    tp, fp, fn, tn = (F.col(c) for c in ("tp", "fp", "fn", "tn"))
    rows = tp + fp + fn + tn

    def ratio(a: Column, b: Column) -> Column:
        return F.coalesce(F.try_divide(a, b), F.lit(0.0))

    return counted.select(
        rows.alias("rows"), F.try_divide(tp + tn, rows).alias("accuracy"),
        ratio(tp, tp + fp).alias("precision"), ratio(tp, tp + fn).alias("recall"),
        ratio(2 * tp, 2 * tp + fp + fn).alias("f1"), _auc_of(counts).select("auc").scalar().alias("auc"),
    )


def member_metrics(df: DataFrame, label: str, scores: list[str], threshold: float = S.DECISION_THRESHOLD) -> DataFrame:
    """Accuracy and AUC of several scores of the same rows, one row per score."""
    accuracies = df.agg(
        *[accuracy(F.col(label), F.coalesce(F.col(s) >= threshold, F.lit(False)).cast("int")).alias(s) for s in scores]
    ).unpivot([], scores, "member", "accuracy")
    aucs = roc_auc(df, label, scores)  # one row per score
    return accuracies.join(F.broadcast(aucs), "member", "left").select("member", "accuracy", "auc")


def regression_metrics(df: DataFrame, actual: str, predicted: str) -> DataFrame:
    """One row: rows, MAE, RMSE, R2 and median absolute error."""
    error = F.col(actual) - F.col(predicted)
    sums = df.agg(
        F.count(F.lit(1)).alias("rows"), F.avg(F.abs(error)).alias("mae"),
        F.avg(error * error).alias("mse"), F.var_pop(actual).alias("variance"),
    )
    median = percentiles(df.select(F.abs(error).alias("e")), "e", {"median": 0.5}).scalar()
    return sums.select(
        "rows", "mae", F.sqrt("mse").alias("rmse"),
        (1.0 - F.try_divide(F.col("mse"), F.col("variance"))).alias("r2"), median.alias("median_error"),
    )


def confusion(df: DataFrame, actual: str, predicted: str, by: tuple[str, ...] = ()) -> DataFrame:
    """Row counts per (actual, predicted), within each ``by`` group if given."""
    return df.groupBy(*by, F.col(actual).alias("actual"), F.col(predicted).alias("predicted")).agg(
        F.count(F.lit(1)).alias("n")
    )


def class_report(counts: DataFrame, by: tuple[str, ...] = ()) -> DataFrame:
    """Precision, recall, F1 and support per label that is actual or predicted anywhere.

    Works on confusion counts: every count speaks once as actual and once as predicted.
    Undefined ratios are 0.
    """
    hit = F.when(F.col("actual") == F.col("predicted"), F.col("n")).otherwise(0)
    zero = F.lit(0).cast("long")
    voices = F.array(
        F.struct(F.col("actual").alias("label"), F.col("n").alias("support"), zero.alias("said"), hit.cast("long").alias("tp")),
        F.struct(F.col("predicted").alias("label"), zero.alias("support"), F.col("n").alias("said"), zero.alias("tp")),
    )
    per_label = counts.select(*by, F.inline(voices)).groupBy(*by, "label").agg(
        *[F.sum(c).alias(c) for c in ("support", "said", "tp")]
    )

    def ratio(a: Column, b: Column) -> Column:
        return F.coalesce(F.try_divide(a, b), F.lit(0.0))

    return per_label.select(
        *by, "label", "support", ratio(F.col("tp"), F.col("said")).alias("precision"),
        ratio(F.col("tp"), F.col("support")).alias("recall"),
        ratio(2 * F.col("tp"), F.col("said") + F.col("support")).alias("f1"),
    )


def report_averages(report: DataFrame, by: tuple[str, ...] = ()) -> DataFrame:
    """Macro and weighted averages of a class report."""
    names = ("precision", "recall", "f1")
    weighted = [F.try_divide(F.sum(F.col(n) * F.col("support")), F.sum("support")).alias(f"weighted_{n}") for n in names]
    return report.groupBy(*by).agg(
        *[F.avg(n).alias(f"macro_{n}") for n in names], *weighted, F.sum("support").alias("support")
    )


def macro_f1(df: DataFrame, actual: str, predicted: str, by: tuple[str, ...] = ()) -> DataFrame:
    """Macro F1, one row per ``by`` group."""
    report = class_report(confusion(df, actual, predicted, by), by)
    return report.groupBy(*by).agg(F.avg("f1").alias("macro_f1"))


def cv_summary(scores: DataFrame, score: str = "macro_f1", target: float = S.CV_TARGET_F1) -> DataFrame:
    """Mean, population deviation, twice that, and whether the mean beats the target."""
    return scores.agg(F.avg(score).alias("cv_mean"), F.stddev_pop(score).alias("cv_std")).select(
        "cv_mean", "cv_std", (F.col("cv_std") * 2).alias("cv_spread"), (F.col("cv_mean") > target).alias("passed")
    )


def log_loss(label: Column, logit: Column) -> Column:
    """Binary cross-entropy of a logit, in the form that cannot overflow."""
    return F.greatest(logit, F.lit(0.0)) - logit * label + F.log1p(F.exp(-F.abs(logit)))


def huber(actual: Column, predicted: Column, delta: float = S.HUBER_DELTA) -> Column:
    size = F.abs(actual - predicted)
    return F.when(size <= delta, size * size * 0.5).otherwise((size - delta * 0.5) * delta)


def cross_entropy(probability_of_actual: Column) -> Column:
    """Minus the log of the probability given to the actual class; infinite for 0, where ``log`` is NULL."""
    p = probability_of_actual
    return F.when(p > 0, -F.log(p)).when(p <= 0, F.lit(float("inf")))


def task_losses(
    df: DataFrame, label: str, logit: str, days: str, days_hat: str, p_reason: str, weight: str
) -> DataFrame:
    """One row: the three losses and their weighted total.  A total that is not finite is an error.

    The reason loss divides by the sum of the class weights of the rows.
    """
    losses = df.agg(
        F.avg(log_loss(F.col(label).cast("double"), F.col(logit))).alias("binary_loss"),
        F.avg(huber(F.col(days), F.col(days_hat))).alias("days_loss"),
        (F.sum(cross_entropy(F.col(p_reason)) * F.col(weight)) / F.sum(weight)).alias("reason_loss"),
    )
    total = F.col("binary_loss") + F.col("days_loss") + S.LOSS_WEIGHT_REASON * F.col("reason_loss")
    bad = F.isnan(total) | (F.abs(total) == float("inf"))
    return losses.withColumn(
        "total_loss", F.when(bad, F.raise_error(F.lit("loss is not finite")).cast("double")).otherwise(total)
    )


def best_candidate(scores: DataFrame, name: str, score: str, order: str) -> DataFrame:
    """The candidate with the highest score; the last one in ``order`` when no score is finite."""
    finite = F.col(score).isNotNull() & ~F.isnan(score) & (F.abs(F.col(score)) != float("inf"))
    # Rank by: has a finite score, the score, then the earliest (finite) or the latest (none finite).
    rank = F.struct(
        finite, F.when(finite, F.col(score)), F.when(finite, -F.col(order)).otherwise(F.col(order))
    )
    return scores.agg(F.max_by(name, rank).alias(name), F.max(F.when(finite, F.col(score))).alias(score))
