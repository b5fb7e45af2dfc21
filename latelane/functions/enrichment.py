"""The vendor and route rules as column expressions.

Every rule takes NULL as missing.  A NULL condition falls through to the last branch
and arithmetic on NULL gives NULL, which is what a missing statistic should do.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from latelane import schemas as S
from latelane.functions.numbers import sigmoid


def vendor_shift(on_time_rate: Column) -> Column:
    """Shift of the delay probability for a vendor's on-time rate.

    Constant beyond the two bounds, a straight line between them.
    """
    position = (on_time_rate - S.VENDOR_POOR_RATE) / (S.VENDOR_GOOD_RATE - S.VENDOR_POOR_RATE)
    return (
        F.when(on_time_rate >= S.VENDOR_GOOD_RATE, F.lit(S.VENDOR_GOOD_SHIFT))
        .when(on_time_rate <= S.VENDOR_POOR_RATE, F.lit(S.VENDOR_POOR_SHIFT))
        .otherwise(S.VENDOR_POOR_SHIFT + position * (S.VENDOR_GOOD_SHIFT - S.VENDOR_POOR_SHIFT))
    )


def vendor_tier(on_time_rate: Column) -> Column:
    """Reliability tier of a known vendor; a missing rate counts as the lowest."""
    name, lowest = S.VENDOR_TIERS[0]
    tier = F.when(on_time_rate >= lowest, name)
    for name, lowest in S.VENDOR_TIERS[1:]:
        tier = tier.when(on_time_rate >= lowest, name)
    return tier.otherwise(S.VENDOR_LOWEST_TIER)


def route_trust(sample_count: Column, spread: Column) -> Column:
    """Mean of a size part (logistic in the sample count) and a spread part.

    The spread part falls to zero at the spread limit; a missing spread gives zero.
    """
    size_part = sigmoid((sample_count - S.ROUTE_SAMPLE_MIDDLE) * S.ROUTE_SAMPLE_SLOPE)
    # ``greatest`` skips a missing value, so a missing spread gives zero.
    spread_part = F.greatest(F.lit(0.0), 1.0 - spread / S.ROUTE_SPREAD_LIMIT)
    return (size_part + spread_part) / 2.0


def model_weight(confidence: Column) -> Column:
    """Weight of the model against the route history."""
    position = (confidence - S.ROUTE_LOW_CONFIDENCE) / (S.ROUTE_HIGH_CONFIDENCE - S.ROUTE_LOW_CONFIDENCE)
    return (
        F.when(confidence >= S.ROUTE_HIGH_CONFIDENCE, F.lit(S.ROUTE_HIGH_WEIGHT))
        .when(confidence <= S.ROUTE_LOW_CONFIDENCE, F.lit(S.ROUTE_LOW_WEIGHT))
        .otherwise(S.ROUTE_LOW_WEIGHT + position * S.ROUTE_WEIGHT_SPAN)
    )


def is_delayed(p: Column, threshold: float = S.DECISION_THRESHOLD) -> Column:
    """Decision on a probability; a missing probability is no delay."""
    return F.coalesce(p >= threshold, F.lit(False))


def risk_band(p: Column) -> Column:
    """Gauge band of a probability; a band owns its lower bound, the last one both."""
    percent = p * 100.0
    band = F
    for name, _, high in S.RISK_BANDS[:-1]:
        band = band.when(percent < high, name)
    return F.when(p.isNotNull(), band.otherwise(S.RISK_BANDS[-1][0]))
