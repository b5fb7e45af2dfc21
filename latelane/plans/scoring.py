"""From model outputs to decisions: enrichment, gating, context and the response record.

The input of every step is a table of shipments that already carries the model outputs
``raw_probability``, ``model_days`` and ``reason_probabilities`` (an array of
``struct<reason, probability>``).  All steps are projections and the two lookup joins,
so one pass over the shipments does the whole scoring, in a batch or in a stream.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from latelane import schemas as S
from latelane.functions import enrichment as E
from latelane.functions import texts
from latelane.functions.numbers import at_least, clip, round_stored
from latelane.operators.joins import BROADCAST_BYTES, lookup_join
from latelane.operators.profiles import route_profile, unique_vendors
from latelane.session import materialise


@dataclass(frozen=True)
class Lookups:
    """Vendor and route history, one row per key, as stored tables."""

    vendors: DataFrame
    routes: DataFrame
    limit_bytes: int = BROADCAST_BYTES


def build_lookups(vendors: DataFrame, routes: DataFrame) -> Lookups:
    """Lookups from the store's vendor table and its per-shipment route table."""
    return Lookups(materialise(unique_vendors(vendors), "vendor_lookup"), materialise(route_profile(routes), "route_lookup"))


def with_history(df: DataFrame, lookups: Lookups) -> DataFrame:
    """Attach vendor and route history with their ``found`` flags, by two lookup joins."""
    vendor = lookups.vendors.select(
        F.col("vendor_id").alias("supplier_name"), F.lit(True).alias("vendor_found"),
        F.col("on_time_rate").alias("vendor_rate"), F.col("avg_delay_days").alias("vendor_delay"),
        F.col("shipments").alias("vendor_shipments"),
    )
    route = lookups.routes.select(
        F.col("origin").alias("origin_city"), F.col("destination").alias("destination_city"),
        F.lit(True).alias("route_found"), F.col("actual_delay_rate").alias("route_rate"),
        F.col("sample_count").alias("route_samples"), F.col("std_delay_prob").alias("route_spread"),
        F.col("avg_distance").alias("route_km"),
    )
    joined = lookup_join(df, vendor, ["supplier_name"], lookups.limit_bytes)
    joined = lookup_join(joined, route, ["origin_city", "destination_city"], lookups.limit_bytes)
    return joined.withColumns({
        "vendor_found": F.coalesce(F.col("vendor_found"), F.lit(False)),
        "route_found": F.coalesce(F.col("route_found"), F.lit(False)),
        "__trust": E.route_trust(F.col("route_samples"), F.col("route_spread")),
    }).withColumn(
        "route_confidence", F.when(F.col("route_found"), clip(F.col("__trust"), 0.0, 1.0)).otherwise(F.lit(0.0))
    ).drop("__trust")


def with_enrichment(df: DataFrame, p: str = "raw_probability", vendor_weight: float = 1.0) -> DataFrame:
    """Vendor-shifted and route-blended probability of a table with history.

    ``vendor_delta`` and ``route_delta`` are the true parts of the change.  Each value is a
    column before it is compared or clipped: Spark keeps such steps apart, where one nested
    expression would be repeated in every branch and outgrow what the JVM compiles.
    """
    w, vendor_p = F.col("model_weight"), F.col("vendor_probability")
    return (
        df.withColumns({
            "__shifted": F.col(p) + E.vendor_shift(F.col("vendor_rate")) * vendor_weight,
            "model_weight": E.model_weight(F.col("route_confidence")),
        })
        .withColumn("vendor_probability", F.when(F.col("vendor_found"), clip(F.col("__shifted"), 0.0, 1.0)).otherwise(F.col(p)))
        .withColumn("__blended", w * vendor_p + (1.0 - w) * F.col("route_rate"))
        .withColumn("enriched_probability", F.when(F.col("route_found"), clip(F.col("__blended"), 0.0, 1.0)).otherwise(vendor_p))
        .withColumns({
            "vendor_delta": vendor_p - F.col(p),
            "route_delta": F.col("enriched_probability") - vendor_p,
        })
        .drop("__shifted", "__blended")
    )


def named_probabilities(reasons: list[str], probabilities: Column) -> Column:
    """Pair the classes of a classifier with its probability array."""
    names = F.array(*[F.lit(r) for r in reasons])
    return F.arrays_zip(names, probabilities).cast("array<struct<reason:string,probability:double>>")


def top_reasons(probabilities: Column, n: int = 3) -> Column:
    """The ``n`` likeliest reasons, ties by name.

    Sorts on the natural order of (negated probability, name), which needs no comparator.
    """
    keyed = F.transform(probabilities, lambda x: F.struct((-x["probability"]).alias("minus"), x["reason"].alias("reason")))
    return F.transform(
        F.slice(F.sort_array(keyed), 1, n),
        lambda x: F.struct(x["reason"].alias("reason"), (-x["minus"]).alias("probability")),
    )


def with_decision(df: DataFrame) -> DataFrame:
    """Final probability per the row's ``apply_enrichment``, decision, gated days and reason."""
    df = df.withColumn(
        "delay_probability",
        F.when(F.col("apply_enrichment"), F.col("enriched_probability")).otherwise(F.col("raw_probability")),
    ).withColumn("will_delay", E.is_delayed(F.col("delay_probability")))
    late = F.col("will_delay")
    nothing = F.array().cast("array<struct<reason:string,probability:double>>")
    return df.withColumns({
        "estimated_delay_days": F.when(late, at_least(F.col("model_days"), 0.0)).otherwise(F.lit(0.0)),
        "reason_top3": F.when(late, top_reasons(F.col("reason_probabilities"))).otherwise(nothing),
    }).withColumn(
        "delay_reason", F.when(late, F.get("reason_top3", F.lit(0))["reason"]).otherwise(F.lit(S.NO_DELAY_TEXT))
    )


def score(df: DataFrame, lookups: Lookups) -> DataFrame:
    """All scoring columns for shipments with model outputs and options."""
    return df.transform(with_history, lookups).transform(with_enrichment).transform(with_decision)


def vendor_context() -> Column:
    """What is known about the row's vendor."""
    found = F.col("vendor_found")
    return F.struct(
        found.alias("found"), F.col("supplier_name").alias("vendor_id"),
        F.when(found, F.col("vendor_rate")).alias("on_time_rate"),
        F.when(found, F.col("vendor_delay")).alias("avg_delay_days"),
        F.when(found, F.col("vendor_shipments")).alias("total_shipments"),
        F.when(found, E.vendor_tier(F.col("vendor_rate"))).alias("reliability_tier"),
        F.when(~found, S.UNKNOWN_VENDOR_TEXT).alias("message"),
    )


def route_context() -> Column:
    """What is known about the row's route."""
    found = F.col("route_found")
    steady = F.coalesce(at_least(1.0 - F.col("route_spread"), 0.0), F.lit(0.0))
    return F.struct(
        found.alias("found"), texts.route_label(F.col("origin_city"), F.col("destination_city")).alias("route"),
        F.when(found, F.col("route_rate")).alias("historical_delay_rate"),
        F.when(found, F.col("route_samples")).alias("sample_size"),
        F.when(found, steady).alias("consistency"),
        F.when(found, F.col("route_confidence")).alias("confidence"),
        F.when(found, F.col("route_km")).alias("avg_distance_km"),
        F.when(~found, S.UNKNOWN_ROUTE_TEXT).alias("message"),
    )


def with_context(df: DataFrame) -> DataFrame:
    return df.withColumns({"vendor_context": vendor_context(), "route_context": route_context()})


def respond(df: DataFrame, keep: tuple[str, ...] = (), scored_at: Column | None = None) -> DataFrame:
    """Nested response records of scored shipments.

    ``vendor_adjustment`` holds the whole change and ``route_adjustment`` is zero, as
    consumers of the record expect; ``vendor_delta`` and ``route_delta`` beside them are
    the true parts.  The context fields are filled also where enrichment was off.
    """
    vendor, route = F.col("vendor_found"), F.col("route_found")
    zero = F.lit(0.0)
    # One array function rounds all of them: far less generated code than six copies.
    to_round = {
        "delay_probability": F.col("delay_probability"),
        "raw_model_probability": F.col("raw_probability"),
        "vendor_adjustment": F.col("delay_probability") - F.col("raw_probability"),
        "route_confidence": F.col("route_confidence"),
        "vendor_on_time_rate": F.when(vendor, F.col("vendor_rate")).otherwise(zero),
        "route_historical_delay": F.when(route, F.col("route_rate")).otherwise(zero),
    }
    df = df.withColumn("__rounded", F.transform(F.array(*to_round.values()), lambda x: round_stored(x, 3)))
    rounded = {name: F.get("__rounded", F.lit(i)).alias(name) for i, name in enumerate(to_round)}
    return df.select(
        *keep,
        F.struct(
            "will_delay", rounded["delay_probability"],
            round_stored(F.col("estimated_delay_days"), 2).alias("estimated_delay_days"), "delay_reason",
            F.coalesce(F.get("reason_top3", F.lit(0))["probability"], zero).alias("confidence"),
        ).alias("prediction"),
        F.struct(
            rounded["raw_model_probability"], rounded["vendor_adjustment"], zero.alias("route_adjustment"),
            F.when(vendor, E.vendor_tier(F.col("vendor_rate"))).otherwise(S.VENDOR_NO_TIER).alias("vendor_tier"),
            rounded["route_confidence"], rounded["vendor_on_time_rate"], rounded["route_historical_delay"],
            "vendor_delta", "route_delta",
        ).alias("enrichment"),
        F.lit(None).cast("string").alias("explanation"),
        F.struct(
            F.lit(S.MODEL_VERSION).alias("model_version"),
            (F.current_timestamp() if scored_at is None else scored_at).alias("timestamp"),
            F.col("apply_enrichment").alias("enrichment_applied"),
            texts.route_label(F.col("origin_city"), F.col("destination_city")).alias("route"),
            texts.or_missing(F.col("supplier_name")).alias("vendor"),
        ).alias("metadata"),
        F.col("reason_top3"),
    )


def waterfall(df: DataFrame, ids: list[str]) -> DataFrame:
    """Base, adjustment and final probability in percent, one row per step and shipment."""
    steps = df.select(
        *ids,
        (F.col("raw_probability") * 100.0).alias("Base Model"),
        ((F.col("delay_probability") - F.col("raw_probability")) * 100.0).alias("Vendor Adjustment"),
        (F.col("delay_probability") * 100.0).alias("Final Prediction"),
    )
    return steps.unpivot(ids, ["Base Model", "Vendor Adjustment", "Final Prediction"], "step", "value")


def band_counts(df: DataFrame, p: str = "delay_probability") -> DataFrame:
    """Shipments per gauge band and side of the decision threshold."""
    return df.groupBy(E.risk_band(F.col(p)).alias("risk_band"), E.is_delayed(F.col(p)).alias("above_threshold")).agg(
        F.count(F.lit(1)).alias("n")
    )
