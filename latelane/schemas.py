"""Declared schemas, column lists and the fixed values of the scoring rules."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import types as T

# --- Fixed values -----------------------------------------------------------------
# Vendor rule: on-time rates at or beyond these bounds give a constant shift.
VENDOR_GOOD_RATE, VENDOR_GOOD_SHIFT = 0.65, -0.10
VENDOR_POOR_RATE, VENDOR_POOR_SHIFT = 0.50, 0.15
# Vendor tiers, lowest on-time rate of each.
VENDOR_TIERS = (("EXCELLENT", 0.65), ("GOOD", 0.55), ("AVERAGE", 0.45))
VENDOR_LOWEST_TIER, VENDOR_NO_TIER = "POOR", "UNKNOWN"
# Route rule: confidence from sample size and spread, then model weight.
ROUTE_SAMPLE_SLOPE, ROUTE_SAMPLE_MIDDLE, ROUTE_SPREAD_LIMIT = 0.1, 50, 0.3
ROUTE_HIGH_CONFIDENCE, ROUTE_HIGH_WEIGHT = 0.7, 0.8
ROUTE_LOW_CONFIDENCE, ROUTE_LOW_WEIGHT = 0.4, 0.5
ROUTE_WEIGHT_SPAN = 0.3
# Decision threshold and texts.
DECISION_THRESHOLD = 0.5
NO_DELAY_TEXT = "No Delay Expected"
MISSING_REASON_DELAYED = "Unknown"
MISSING_REASON_ANY = "None"
UNKNOWN_VENDOR_TEXT = "Unknown vendor - no historical data"
UNKNOWN_ROUTE_TEXT = "Unknown route - no historical data"
MODEL_VERSION = "v2.0"
# Gauge bands on the probability in percent.
RISK_BANDS = (("low", 0, 30), ("medium", 30, 60), ("high", 60, 100))
# Other fixed limits.
DELAY_DAYS_RANGE = (0.0, 12.0)
RARE_CLASS_SHARE = 0.01
CV_TARGET_F1 = 0.45
LOSS_WEIGHT_REASON = 0.7
HUBER_DELTA = 1.0
SPLIT_SEED = 42
TEST_SHARE = 0.2
FOLDS = 5
# Texts a CSV cell may use for a missing value (pandas defaults).
MISSING_TEXTS = (
    "", "#N/A", "#N/A N/A", "#NA", "-1.#IND", "-1.#QNAN", "-NaN", "-nan", "1.#IND",
    "1.#QNAN", "<NA>", "N/A", "NA", "NULL", "NaN", "None", "n/a", "nan", "null",
)
# Choices offered by the entry form.
FORM_CHOICES = {
    "product_category": ("Electronics", "Apparel", "FMCG", "Automotive", "Pharmaceuticals"),
    "carrier_name": ("BlueDart", "DTDC", "Delhivery", "Ecom Express", "FedEx"),
    "truck_type": ("LCV", "MHCV", "Trailer"),
    "month": (
        "January", "February", "March", "April", "May", "June", "July",
        "August", "September", "October", "November", "December",
    ),
}
# Columns of a request, in the order of the record.
REQUEST_TEXT = (
    "origin_city", "destination_city", "origin_state", "destination_state", "product_category",
    "supplier_name", "carrier_name", "truck_type", "month",
)
REQUEST_NUMBERS = ("quantity", "weight_kg", "value_inr", "risk_score")
REQUEST_OPTIONAL = (
    "vendor_avg_delay_days", "vendor_on_time_rate", "route_distance_km",
    "route_vendor_reliability_sim", "route_delay_probability_sim",
)
# ----------------------------------------------------------------------------------


@dataclass(frozen=True)
class FeatureConfig:
    """Which columns feed the models, and which categories have levels without bound."""

    categorical: tuple[str, ...] = REQUEST_TEXT
    numeric: tuple[str, ...] = REQUEST_NUMBERS + REQUEST_OPTIONAL
    derived_numeric: tuple[str, ...] = ("value_per_kg",)
    derived_categorical: tuple[str, ...] = ("route_pair",)
    wide: tuple[str, ...] = ("origin_city", "destination_city", "supplier_name", "route_pair")

    def present_in(self, columns: list[str]) -> tuple[list[str], list[str]]:
        """(numeric, categorical) names that exist among ``columns``."""
        numeric = [c for c in self.numeric + self.derived_numeric if c in columns]
        categorical = [c for c in self.categorical + self.derived_categorical if c in columns]
        return numeric, categorical


DEFAULT_FEATURES = FeatureConfig()


def _struct(**columns: T.DataType) -> T.StructType:
    return T.StructType([T.StructField(name, kind) for name, kind in columns.items()])


_S, _D, _I, _B, _DAY = T.StringType(), T.DoubleType(), T.IntegerType(), T.BooleanType(), T.DateType()

SHIPMENTS = _struct(
    shipment_id=_S, order_date=_DAY, expected_delivery_date=_DAY, actual_delivery_date=_DAY,
    origin_city=_S, destination_city=_S, origin_state=_S, destination_state=_S,
    product_category=_S, supplier_name=_S, carrier_name=_S, truck_type=_S,
    quantity=_I, weight_kg=_D, value_inr=_D, gst_rate=_D,
    on_time=_S, delay_days=_D, delay_reason=_S, weather_impact=_S, festival_impact=_S,
    risk_score=_D, status=_S, notes=_S, month=_S,
)

VENDOR_STATS = _struct(
    vendor_id=_S, shipments=_I, avg_delay_days=_D, on_time_rate=_D, avg_cost=_D,
)

ROUTE_STATS = _struct(
    shipment_id=_S, origin=_S, destination=_S, distance_km=_D,
    delay_probability_sim=_D, vendor_reliability_sim=_D, lateness_flag=_I,
)

REQUESTS = _struct(
    **{c: _S for c in REQUEST_TEXT},
    quantity=_I, weight_kg=_D, value_inr=_D, risk_score=_D,
    **{c: _D for c in REQUEST_OPTIONAL},
    apply_enrichment=_B, explain=_B,
)

TRAINING_LOG = _struct(iteration=T.LongType(), macro_f1=_D, loss=_D)

STORE_TABLES = {"primary_shipments": SHIPMENTS, "vendor_stats": VENDOR_STATS, "route_stats": ROUTE_STATS}
