"""Small numeric expressions: rounding, clamping, sigmoid."""

from __future__ import annotations

from pyspark.sql import Column, Window
from pyspark.sql import functions as F


def clamp01(x: Column) -> Column:
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), x))


def score6(x: Column) -> Column:
    """Scores are kept to six places."""
    return F.round(x, 6)


def sigmoid(z: Column) -> Column:
    """1 / (1 + e^-z), without overflow for large |z|."""
    e = F.exp(-F.abs(z))
    return F.when(z >= 0, 1.0 / (1.0 + e)).otherwise(e / (1.0 + e))


def millionths(x: Column) -> Column:
    """A score of six places as a whole number."""
    return F.round(x * 1e6).cast("long")


def exact_score(numerator: Column, denominator: Column) -> Column:
    """A quotient of whole numbers, in millionths, as a score of six places; halves go away from zero.

    Weights are hundredths and signals millionths, so a half is met exactly and no engine's decimal print decides.
    """
    return F.round(numerator / denominator) / 1e6


def min_max(value: Column, *within: Column) -> Column:
    """Scaled to [0, 1]; 0.5 for constant values. For groups that fit in a task; ``order_stats.min_max`` takes any."""
    group = Window.partitionBy(*within)
    lo, hi = F.min(value).over(group), F.max(value).over(group)
    return F.when(hi == lo, 0.5).otherwise((value - lo) / (hi - lo))
