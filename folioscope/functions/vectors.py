"""Vector expressions and aggregates on array<double> columns."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SMALL_NORM = 1e-12


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)


def norm(a: Column) -> Column:
    return F.sqrt(F.aggregate(a, F.lit(0.0), lambda s, x: s + x * x))


def squared_distance(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: (x - y) * (x - y)), F.lit(0.0), lambda s, x: s + x)


def cosine(a: Column, b: Column) -> Column:
    """Null for vectors of different length or without a direction."""
    n = norm(a) * norm(b)
    return F.when((F.size(a) == F.size(b)) & (n > 0), dot(a, b) / n)


def scaled(a: Column, by: Column) -> Column:
    return F.transform(a, lambda x: x / by)


def finite(a: Column) -> Column:
    """Not empty, and every element a finite number."""
    return (F.size(a) > 0) & F.forall(a, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))


def mean_vectors(df: DataFrame, vector: str, *by: str) -> DataFrame:
    """The element-wise mean of each group: explode, average by position, and put together again.

    The partial averages of a position are combined before the shuffle, whatever the group's size.
    """
    each = df.select(*by, F.posexplode(vector).alias("at", "x")).groupBy(*by, "at").agg(F.avg("x").alias("x"))
    ordered = F.array_sort(F.collect_list(F.struct("at", "x")))
    return each.groupBy(*by).agg(F.transform(ordered, lambda e: e["x"]).alias("mean"))


def logistic_score(features: Column, mean: list[float], scale: list[float], weights: list[float], intercept: float) -> Column:
    """A frozen standardised logistic scorer as one expression."""
    from folioscope.functions.numeric import sigmoid

    params = F.array(*[F.struct(F.lit(float(m)).alias("m"), F.lit(float(s)).alias("s"), F.lit(float(w)).alias("w")) for m, s, w in zip(mean, scale, weights, strict=True)])
    parts = F.zip_with(features, params, lambda x, p: (x - p["m"]) / p["s"] * p["w"])
    return sigmoid(F.aggregate(parts, F.lit(float(intercept)), lambda s, x: s + x))
