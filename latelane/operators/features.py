"""The training frame and the preparation steps built on it."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from latelane import schemas as S
from latelane.errors import TrainingError
from latelane.functions import numbers as N
from latelane.functions import texts
from latelane.operators.joins import lookup_join

LOG_COLUMNS = ("value_inr", "weight_kg", "quantity")


def will_delay(on_time: Column) -> Column:
    """1 unless the shipment is marked on time; an unmarked shipment counts as late."""
    return F.when(on_time == "Yes", 0).otherwise(1)


def with_derived(df: DataFrame) -> DataFrame:
    """Add value per kilogram and the route pair."""
    return df.withColumns({
        "value_per_kg": N.value_per_kg(F.col("value_inr"), F.col("weight_kg")),
        "route_pair": texts.route_pair(F.col("origin_city"), F.col("destination_city")),
    })


def training_frame(shipments: DataFrame, vendors: DataFrame, routes: DataFrame, keep: tuple[str, ...] = ()) -> DataFrame:
    """Shipments with targets, vendor and route columns and the derived columns.

    Two left joins that keep every match, so a duplicate vendor or a shipment with
    several route rows gives several rows.  The vendor side is broadcast if it measures
    small; the route side has a row per shipment and is joined by shuffling on the id.
    ``keep`` names extra shipment columns to carry along.
    """
    primary = shipments.select(*S.SHIPMENTS.fieldNames(), *keep)
    vendor_side = vendors.select(
        F.col("vendor_id").alias("supplier_name"),
        F.col("avg_delay_days").alias("vendor_avg_delay_days"),
        F.col("on_time_rate").alias("vendor_on_time_rate"),
    )
    route_side = routes.select(
        "shipment_id",
        F.col("distance_km").alias("route_distance_km"),
        F.col("vendor_reliability_sim").alias("route_vendor_reliability_sim"),
        F.col("delay_probability_sim").alias("route_delay_probability_sim"),
    )
    # What can be found or computed after the shuffle does not travel in it.
    joined = lookup_join(primary.join(route_side, "shipment_id", "left"), vendor_side, ["supplier_name"])
    return with_derived(joined.withColumn("will_delay", will_delay(F.col("on_time")))).select(
        *S.SHIPMENTS.fieldNames(), *keep, "will_delay", "vendor_avg_delay_days", "vendor_on_time_rate",
        "route_distance_km", "route_vendor_reliability_sim", "route_delay_probability_sim",
        "value_per_kg", "route_pair",
    )


def require_rows(df: DataFrame, what: str) -> DataFrame:
    if df.isEmpty():
        raise TrainingError(f"no {what} found")
    return df


def delayed_by_days(frame: DataFrame) -> DataFrame:
    """Rows with a positive delay; a missing delay counts as none."""
    days = F.coalesce(F.col("delay_days").cast("double"), F.lit(0.0))
    return frame.withColumn("delay_days", days).filter(F.col("delay_days") > 0)


def delayed_with_reason(frame: DataFrame) -> DataFrame:
    """Late rows, a missing reason named ``Unknown``."""
    reason = F.coalesce(F.col("delay_reason"), F.lit(S.MISSING_REASON_DELAYED))
    return frame.filter(F.col("will_delay") == 1).withColumn("delay_reason", reason)


def reason_any_row(reason: Column) -> Column:
    """Reason label for every row, late or not."""
    return F.coalesce(reason, F.lit(S.MISSING_REASON_ANY))


def clipped_days(days: Column) -> Column:
    return N.clip(days, *S.DELAY_DAYS_RANGE)


def filled(c: Column) -> Column:
    """Missing and infinite numbers as 0."""
    return F.coalesce(N.finite_or_null(c.cast("double")), F.lit(0.0))


def with_logs(df: DataFrame) -> DataFrame:
    return df.withColumns({f"log_{c}": F.log1p(F.col(c).cast("double")) for c in LOG_COLUMNS})


def fill_from_lookups(requests: DataFrame, vendor_lookup: DataFrame, route_lookup: DataFrame) -> DataFrame:
    """Optional request features filled from vendor and route history where absent."""
    vendor = vendor_lookup.select(
        F.col("vendor_id").alias("supplier_name"),
        F.col("avg_delay_days").alias("__v_delay"), F.col("on_time_rate").alias("__v_rate"),
    )
    route = route_lookup.select(
        F.col("origin").alias("origin_city"), F.col("destination").alias("destination_city"),
        F.col("avg_distance").alias("__r_km"), F.col("avg_reliability").alias("__r_reliability"),
        F.col("avg_delay_prob").alias("__r_delay"),
    )
    joined = lookup_join(lookup_join(requests, vendor, ["supplier_name"]), route, ["origin_city", "destination_city"])
    sources = dict(zip(S.REQUEST_OPTIONAL, ("__v_delay", "__v_rate", "__r_km", "__r_reliability", "__r_delay")))
    return joined.withColumns({c: F.coalesce(c, s) for c, s in sources.items()}).select(*requests.columns)
