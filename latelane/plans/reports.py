"""Reports: effect of the enrichment and the metrics document."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from latelane import schemas as S


def enrichment_impact(scored: DataFrame, label: str) -> DataFrame:
    """One row: mean absolute change, accuracy before and after, vendors and routes touched.

    Vendors and routes are counted by first reducing the rows to distinct keys, so no
    task holds all keys of the table.
    """
    threshold = S.DECISION_THRESHOLD

    def right(p: str):
        decision = F.coalesce(F.col(p) >= threshold, F.lit(False)).cast("int")
        return F.avg((decision == F.col(label)).cast("double"))

    vendors = scored.filter("vendor_found").groupBy("supplier_name").agg(F.lit(1).alias("k"))
    routes = scored.filter("route_found").groupBy("origin_city", "destination_city").agg(F.lit(1).alias("k"))
    change = scored.agg(
        F.avg(F.abs(F.col("enriched_probability") - F.col("raw_probability"))).alias("avg_adjustment"),
        right("raw_probability").alias("accuracy_without_enrichment"),
        right("enriched_probability").alias("accuracy_with_enrichment"),
    )
    return change.select(
        "*", (F.col("accuracy_with_enrichment") - F.col("accuracy_without_enrichment")).alias("improved_accuracy"),
        vendors.agg(F.count("k").alias("n")).scalar().alias("vendors_adjusted"),
        routes.agg(F.count("k").alias("n")).scalar().alias("routes_validated"),
    )


def metrics_document(
    facts: DataFrame, binary: DataFrame, days: DataFrame, reasons: DataFrame, impact: DataFrame, members: DataFrame,
    classes: DataFrame, latency: DataFrame,
) -> DataFrame:
    """One nested record with the sections of the metrics report.

    ``members`` has a row per learner and ``classes`` one per reason; each other input is one row.
    """

    def section(df: DataFrame, name: str):
        return df.select(F.struct(*df.columns).alias(name)).scalar().alias(name)

    def rows(df: DataFrame, name: str):
        return df.agg(F.sort_array(F.collect_list(F.struct(*df.columns))).alias(name)).scalar().alias(name)

    return facts.select(
        F.struct(*facts.columns).alias("dataset_info"),
        section(binary, "ensemble_binary_classifier"), rows(members, "members"), section(days, "delay_days_regressor"),
        section(reasons, "delay_reason_classifier"), rows(classes, "classes"), section(impact, "enrichment_impact"),
        section(latency, "latency"),
    )
