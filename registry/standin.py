"""Shipments, vendors and routes derived from the given order tables.

Every row of ``lineitem`` is a shipment from the supplier's nation to the customer's.
The joins follow foreign keys and carry no hints: Catalyst broadcasts the sides whose
files are small and shuffles the others.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from latelane import schemas as S
from latelane.functions.numbers import sigmoid
from latelane.operators.profiles import route_profile, vendor_profile
from latelane.plans.scoring import Lookups, named_probabilities
from latelane.session import materialise


# Declared, so that opening a table reads no file footers.
TABLES = {
    "region": "r_regionkey int, r_name string",
    "nation": "n_nationkey int, n_name string, n_regionkey int",
    "customer": "c_custkey bigint, c_name string, c_nationkey int, c_acctbal double, c_mktsegment string",
    "supplier": "s_suppkey bigint, s_name string, s_nationkey int, s_acctbal double",
    "part": "p_partkey bigint, p_name string, p_brand string, p_type string, p_size int, p_retailprice double",
    "orders": "o_orderkey bigint, o_custkey bigint, o_orderstatus string, o_totalprice double, "
              "o_orderdate timestamp_ntz, o_orderpriority string",
    "lineitem": "l_orderkey bigint, l_partkey bigint, l_suppkey bigint, l_linenumber int, l_quantity double, "
                "l_extendedprice double, l_discount double, l_tax double, l_returnflag string, l_linestatus string, "
                "l_shipdate timestamp_ntz",
    "events": "event_id bigint, ts timestamp_ntz, user_id bigint, event_type string, value double, props string",
}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.schema(TABLES[name]).parquet(f"{sf_dir}/{name}.parquet")


def _places(spark: SparkSession, sf_dir: str, end: str) -> DataFrame:
    nation, region = table(spark, sf_dir, "nation"), table(spark, sf_dir, "region")
    return nation.join(region, F.col("n_regionkey") == F.col("r_regionkey")).select(
        F.col("n_nationkey").alias(f"{end}_key"), F.col("n_name").alias(f"{end}_city"), F.col("r_name").alias(f"{end}_state")
    )


def _delay_days() -> Column:
    days = F.col("l_quantity") - (F.col("l_suppkey") % 20 + 18)
    return F.when(days > 0, days).otherwise(F.lit(0.0))


def _shipment_id() -> Column:
    return F.concat(F.col("l_orderkey").cast("string"), F.lit("-"), F.col("l_linenumber").cast("string"))


def _row_key() -> Column:
    """Identity of a line: its keys, price in cents and date."""
    cents = F.round(F.col("l_extendedprice") * 100).cast("long")
    parts = [F.col(c) for c in ("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey")]
    return F.concat_ws("|", *parts, cents, F.date_format("l_shipdate", "yyyy-MM-dd"))


def _lines(spark: SparkSession, sf_dir: str, parts: bool = False) -> DataFrame:
    """Line items with the numbers of the nations they come from and go to, and with their parts if asked for."""
    orders = table(spark, sf_dir, "orders").join(table(spark, sf_dir, "customer"), F.col("o_custkey") == F.col("c_custkey"))
    lines = table(spark, sf_dir, "lineitem").join(orders, F.col("l_orderkey") == F.col("o_orderkey"))
    if parts:
        lines = lines.join(table(spark, sf_dir, "part"), F.col("l_partkey") == F.col("p_partkey"))
    return lines.join(table(spark, sf_dir, "supplier"), F.col("l_suppkey") == F.col("s_suppkey"))


def _ends(spark: SparkSession, sf_dir: str, lines: DataFrame) -> DataFrame:
    """Line items with origin and destination.  The names of places come last, so that no join shuffles them."""
    return lines.join(
        _places(spark, sf_dir, "destination"), F.col("c_nationkey") == F.col("destination_key")
    ).join(_places(spark, sf_dir, "origin"), F.col("s_nationkey") == F.col("origin_key"))


def shipment_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Line items with their ``shipment_id`` and with what :func:`shipments` makes of them."""
    return _lines(spark, sf_dir, parts=True).withColumn("shipment_id", _shipment_id())


def shipments(spark: SparkSession, sf_dir: str, lines: DataFrame | None = None) -> DataFrame:
    """The shipment table, with ``row_key`` beside its declared columns; of ``lines`` if given, in the order they are dealt."""
    lines = _ends(spark, sf_dir, shipment_lines(spark, sf_dir) if lines is None else lines)
    late = F.col("delay_days") > 0
    ship_day = F.col("l_shipdate").cast("date")
    return lines.withColumn("delay_days", _delay_days()).select(
        "shipment_id",
        F.col("o_orderdate").cast("date").alias("order_date"),
        ship_day.alias("expected_delivery_date"),
        F.date_add(ship_day, F.col("delay_days").cast("int")).alias("actual_delivery_date"),
        "origin_city", "destination_city", "origin_state", "destination_state",
        F.col("p_type").alias("product_category"),
        F.col("l_suppkey").cast("string").alias("supplier_name"),
        F.col("o_orderpriority").alias("carrier_name"),
        F.col("c_mktsegment").alias("truck_type"),
        F.col("l_quantity").cast("int").alias("quantity"),
        (F.col("p_size") * F.col("l_quantity") / 50).alias("weight_kg"),
        F.col("l_extendedprice").alias("value_inr"),
        (F.col("l_tax") + 0.0).alias("gst_rate"),
        F.when(late, "No").otherwise("Yes").alias("on_time"),
        "delay_days",
        F.when(late & (F.col("l_tax") > 0), F.col("p_type")).alias("delay_reason"),
        F.col("l_returnflag").alias("weather_impact"),
        F.col("l_linestatus").alias("festival_impact"),
        (F.col("l_discount") * 10 + 0.0).alias("risk_score"),
        F.col("o_orderstatus").alias("status"),
        F.col("p_name").alias("notes"),
        F.date_format("l_shipdate", "MMMM").alias("month"),
        _row_key().alias("row_key"),
        (1.0 - F.col("l_tax") * 10).alias("route_vendor_reliability_sim"),
        "l_orderkey", "l_linenumber",
    )


def _route_columns() -> list[Column]:
    return [
        _shipment_id().alias("shipment_id"),
        (F.col("l_extendedprice") / 50).alias("distance_km"),
        (F.col("l_discount") * 5 + 0.0).alias("delay_probability_sim"),
        (1.0 - F.col("l_tax") * 10).alias("vendor_reliability_sim"),
        (_delay_days() > 0).cast("int").alias("lateness_flag"),
    ]


def route_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per-shipment route measurements without the route's ends: one scan, no join."""
    return table(spark, sf_dir, "lineitem").select(*_route_columns())


def routes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The route table: one row per shipment."""
    return _ends(spark, sf_dir, _lines(spark, sf_dir)).select(
        F.col("origin_city").alias("origin"), F.col("destination_city").alias("destination"),
        F.col("s_nationkey"), F.col("c_nationkey"), *_route_columns(),
    ).select(*S.ROUTE_STATS.fieldNames(), "s_nationkey", "c_nationkey")


def vendor_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Shipment columns a vendor profile needs, from ``lineitem`` alone."""
    return table(spark, sf_dir, "lineitem").select(
        F.col("l_suppkey").cast("string").alias("supplier_name"), _delay_days().alias("delay_days"),
        F.when(_delay_days() > 0, "No").otherwise("Yes").alias("on_time"), F.col("l_extendedprice").alias("value_inr"),
        F.col("l_suppkey"),
    )


def known_vendors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The vendor table: all vendors but those with a number divisible by 17, which stay unknown."""
    return vendor_profile(vendor_rows(spark, sf_dir).filter(F.col("l_suppkey") % 17 != 0))


def known_routes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Route profiles but for the pairs that stay unknown."""
    return route_profile(routes(spark, sf_dir).filter((F.col("s_nationkey") + F.col("c_nationkey")) % 11 != 0))


def lookups(spark: SparkSession, sf_dir: str) -> Lookups:
    return Lookups(
        materialise(known_vendors(spark, sf_dir), "vendor_lookup"),
        materialise(known_routes(spark, sf_dir), "route_lookup"),
    )


# --- Fixed formulas in place of trained models, so that SQL can repeat them ---------
BASE_MODEL = (-1.2, 0.06, -1.5, 0.8)
MEMBERS = {"member_a": (-1.2, 0.06, -1.5, 0.8), "member_b": (-1.0, 0.05, -1.0, 0.5), "member_c": (-1.6, 0.07, -0.5, 0.2)}
HAIR = 1e-8
REASONS = ("ECONOMY", "LARGE", "MEDIUM", "PROMO", "SMALL", "STANDARD")
REASON_SHARES = (0.30, 0.25, 0.20, 0.10, 0.10, 0.05)
# ----------------------------------------------------------------------------------


def logit(model: tuple[float, ...]) -> Column:
    b, q, r, v = model
    return b + F.col("quantity") * q + F.col("risk_score") * r + F.col("route_vendor_reliability_sim") * v


def probability(model: tuple[float, ...] = BASE_MODEL) -> Column:
    return sigmoid(logit(model))


def model_days() -> Column:
    """Stand-in for the days model; negative for small quantities."""
    return (F.col("quantity") - 25) * 0.22 + F.col("risk_score")


def reason_probabilities(shift: int = 0) -> Column:
    """Stand-in for one reason classifier: fixed probabilities, two of them tied, rotated by the row."""
    turn = (F.col("quantity") + F.col("l_linenumber") * (shift + 1)) % len(REASONS)
    return F.slice(F.array(*[F.lit(p) for p in REASON_SHARES * 2]), turn + 1, len(REASONS))


def with_model_outputs(ships: DataFrame) -> DataFrame:
    """Shipments with the stand-in model outputs and per-row options."""
    return ships.withColumns({
        "raw_probability": probability(),
        "model_days": model_days(),
        "reason_probabilities": named_probabilities(REASONS, reason_probabilities()),
        "apply_enrichment": F.col("l_linenumber") != 7,
        "explain": F.col("l_linenumber") == 1,
    })


def scored_inputs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return with_model_outputs(shipments(spark, sf_dir))
