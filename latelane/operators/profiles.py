"""Vendor and route profiles and the reports on distributions and keys.

The profiles are algebraic aggregates: Spark combines them inside each input task, so
a vendor or route holding a third of the rows sends one partial row per task.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from latelane import schemas as S


def route_profile(routes: DataFrame) -> DataFrame:
    """History per (origin, destination): delay probability, distance, reliability, delay rate."""
    known = routes.filter(F.col("origin").isNotNull() & F.col("destination").isNotNull())
    p = F.col("delay_probability_sim")
    return known.groupBy("origin", "destination").agg(
        F.avg(p).alias("avg_delay_prob"),
        F.stddev_samp(p).alias("std_delay_prob"),
        F.count(p).alias("sample_count"),
        F.avg("distance_km").alias("avg_distance"),
        F.avg("vendor_reliability_sim").alias("avg_reliability"),
        F.avg("lateness_flag").alias("actual_delay_rate"),
    )


def vendor_profile(shipments: DataFrame) -> DataFrame:
    """Statistics per vendor, in the form of the vendor table."""
    return shipments.filter(F.col("supplier_name").isNotNull()).groupBy(F.col("supplier_name").alias("vendor_id")).agg(
        F.count(F.lit(1)).alias("shipments"),
        F.avg("delay_days").alias("avg_delay_days"),
        F.avg((F.coalesce(F.col("on_time") == "Yes", F.lit(False))).cast("double")).alias("on_time_rate"),
        F.avg("value_inr").alias("avg_cost"),
    )


def unique_vendors(vendors: DataFrame) -> DataFrame:
    """One row per vendor: the one with most shipments, then the highest of the other values.

    A missing vendor id is no key and is left out.
    """
    values = ["shipments", "on_time_rate", "avg_delay_days", "avg_cost"]
    return (
        vendors.filter(F.col("vendor_id").isNotNull()).groupBy("vendor_id")
        .agg(F.max(F.struct(*values)).alias("best")).select("vendor_id", *[f"best.{v}" for v in values])
    )


def unmatched_keys(df: DataFrame, lookup: DataFrame, on: dict[str, str]) -> DataFrame:
    """Keys of ``df`` absent from ``lookup`` with their row counts; NULL keys are absent too.

    Counts per key first, so the anti join runs on distinct keys, not on rows.
    """
    keys = df.groupBy(*on).agg(F.count(F.lit(1)).alias("rows"))
    known = lookup.select(*[F.col(theirs).alias(ours) for ours, theirs in on.items()]).distinct()
    return keys.join(known, list(on), "left_anti")


def shares(df: DataFrame, column: str) -> DataFrame:
    """Count and share of each value; missing values do not count."""
    counts = df.filter(F.col(column).isNotNull()).groupBy(column).agg(F.count(F.lit(1)).alias("n"))
    total = counts.agg(F.sum("n").alias("total")).scalar()
    return counts.withColumn("share", F.col("n") / total)


def top_shares(df: DataFrame, column: str, n: int = 10) -> DataFrame:
    """The ``n`` most frequent values, ties by value."""
    return shares(df, column).orderBy(F.desc("n"), F.asc(column)).limit(n)


def rare_values(df: DataFrame, column: str, below: float = S.RARE_CLASS_SHARE) -> DataFrame:
    return shares(df, column).filter(F.col("share") < below)


def class_weights(df: DataFrame, label: str) -> DataFrame:
    """Two weights per class: inverse frequency with mean 1, and largest count over count.

    When a weight is not finite all classes weigh 1.
    """
    counts = df.groupBy(label).agg(F.count(F.lit(1)).alias("n"))
    inverse = 1.0 / F.greatest(F.col("n"), F.lit(1))
    mean_inverse = counts.agg(F.avg(inverse).alias("m")).scalar()
    largest = counts.agg(F.max("n").alias("m")).scalar()
    weight = inverse / mean_inverse
    finite = ~F.isnan(weight) & (F.abs(weight) != float("inf"))
    return counts.select(
        label, "n",
        F.when(finite, weight).otherwise(F.lit(1.0)).alias("inverse_weight"),
        (largest / F.col("n")).alias("balanced_weight"),
    )


def dataset_facts(frame: DataFrame, vendors: DataFrame) -> DataFrame:
    """One row: rows, delay rate, vendor on-time range and the busiest route."""
    by_route = frame.filter(F.col("route_pair").isNotNull()).groupBy("route_pair").agg(F.count(F.lit(1)).alias("n"))
    # The smallest name among the busiest: max over (count, name) would take the largest.
    most = by_route.agg(F.max("n").alias("n")).scalar()
    busiest = by_route.filter(F.col("n") == most).agg(F.min("route_pair").alias("r")).scalar()
    return frame.agg(
        F.count(F.lit(1)).alias("rows"), F.avg("will_delay").alias("delay_rate")
    ).select(
        "rows", "delay_rate",
        vendors.agg(F.min("on_time_rate").alias("v")).scalar().alias("vendor_on_time_min"),
        vendors.agg(F.max("on_time_rate").alias("v")).scalar().alias("vendor_on_time_max"),
        busiest.alias("busiest_route"), most.alias("busiest_route_rows"),
    )
