"""Exact quantiles of whole groups without gathering a group in one task.

Values are counted, so equal ones are one row; the counts are dealt out by ranges of the order and each range
gets the number of values below it (``ranks.before``). A quantile is then a filter: the values whose
places hold the two positions that it lies between.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from folioscope.operators.ranks import before


def same_keys(names: list[str], other: dict[str, str]) -> Column:
    """Whether the columns ``names`` equal those they are renamed to; nulls equal nulls."""
    return reduce(lambda a, b: a & b, [F.col(n).eqNullSafe(F.col(other[n])) for n in names], F.lit(True))


def joined_back(df: DataFrame, groups: DataFrame, by: list[str]) -> DataFrame:
    """``df`` with the columns of ``groups``, which has a row for each group; without ``by`` it has one row."""
    if not by:
        return df.crossJoin(F.broadcast(groups))  # one row
    names = {b: f"_by_{b}" for b in by}
    other = groups.withColumnsRenamed(names)
    return df.join(other, same_keys(by, names), "left").drop(*names.values())


def quantiles(df: DataFrame, value: str, wanted: dict[str, float], *by: str) -> DataFrame:
    """A row for each group, with a column for each of ``wanted`` (name: share), linear between neighbours.

    Null values take no part, and groups without a value are absent; null groups are groups.
    """
    counted = df.where(F.col(value).isNotNull()).groupBy(*by, value).agg(F.count(F.lit(1)).alias("_n"))
    total = counted.groupBy(*by).agg(F.sum("_n").alias("_all"))
    placed = joined_back(before(counted, list(by), [F.col(value).asc()], {"_below": F.col("_n")}), total, list(by))

    def at(place: Column) -> Column:
        return F.max(F.when((F.col("_below") <= place) & (place < F.col("_below") + F.col("_n")), F.col(value).cast("double")))

    columns = []
    for name, share in wanted.items():
        place = F.lit(share) * (F.col("_all") - 1)
        columns += [at(F.floor(place)).alias(f"_lo_{name}"), at(F.ceil(place)).alias(f"_hi_{name}"), F.max(place - F.floor(place)).alias(f"_part_{name}")]
    found = placed.groupBy(*by).agg(*columns)
    between = [(F.col(f"_lo_{n}") + (F.col(f"_hi_{n}") - F.col(f"_lo_{n}")) * F.col(f"_part_{n}")).alias(n) for n in wanted]
    return found.select(*by, *between)


def min_max(df: DataFrame, value: str, name: str, *by: str) -> DataFrame:
    """Adds ``name``: ``value`` scaled to [0, 1] within its group; 0.5 for constant values."""
    ends = df.groupBy(*by).agg(F.min(value).alias("_lo"), F.max(value).alias("_hi"))
    scaled = F.when(F.col("_hi") == F.col("_lo"), 0.5).otherwise((F.col(value) - F.col("_lo")) / (F.col("_hi") - F.col("_lo")))
    return joined_back(df, ends, list(by)).withColumn(name, scaled).drop("_lo", "_hi")
