"""Places and running sums over whole tables, without sorting a group in one task.

Rows are dealt out by ranges of their order. Each part adds up its own rows, and gets the sum of all
parts before it from a table with one row for each part.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from folioscope.session import stored


def before(df: DataFrame, by: list[str], order: list[Column], amounts: dict[str, Column]) -> DataFrame:
    """Adds a column for each of ``amounts``: its sum over the rows of the group that come earlier in ``order``.

    The order must leave no ties. Null groups are groups.
    """
    for name, amount in amounts.items():
        df = df.withColumn(f"_of_{name}", amount)
    placed = df.repartitionByRange(*[F.col(b).asc_nulls_first() for b in by], *order).withColumn("_part", F.spark_partition_id())
    placed = stored(placed, "places")
    none = F.lit(0)
    # one row for each part and group
    per = placed.groupBy(*by, "_part").agg(*[F.sum(f"_of_{n}").alias(f"_in_{n}") for n in amounts])
    earlier = W.partitionBy(*by).orderBy("_part").rowsBetween(W.unboundedPreceding, -1)
    offsets = per.select(*[F.col(b).alias(f"_by_{b}") for b in by], F.col("_part").alias("_at"), *[F.coalesce(F.sum(f"_in_{n}").over(earlier), none).alias(f"_to_{n}") for n in amounts])
    inside = W.partitionBy(*by, "_part").orderBy(*order).rowsBetween(W.unboundedPreceding, -1)
    for n in amounts:
        placed = placed.withColumn(f"_own_{n}", F.coalesce(F.sum(f"_of_{n}").over(inside), none))
    same = reduce(lambda a, b: a & b, [F.col(b).eqNullSafe(F.col(f"_by_{b}")) for b in by], F.col("_part") == F.col("_at"))
    kept = [c for c in df.columns if not c.startswith("_of_")]
    return placed.join(offsets, same).select(*kept, *[(F.col(f"_to_{n}") + F.col(f"_own_{n}")).alias(n) for n in amounts])


def numbered(df: DataFrame, order: list[Column], name: str = "rank", by: tuple[str, ...] = ()) -> DataFrame:
    """Adds the row's place in its group, from 1."""
    return before(df, list(by), order, {name: F.lit(1)}).withColumn(name, (F.col(name) + 1).cast("int"))


def percentiles(df: DataFrame, value: str, ends: str, middle: str, by: tuple[str, ...] = ()) -> DataFrame:
    """Adds both rank percentiles of ``value`` in its group, highest first, ties averaged.

    ``ends`` is 1 for the best and 0 for the worst row (a single row has 1); ``middle`` is the middle of
    the row's share of the ranking. Only distinct values are ordered.
    """
    counted = df.groupBy(*by, value).agg(F.count(F.lit(1)).alias("_ties"))
    placed = before(counted, list(by), [F.col(value).desc_nulls_last()], {"_above": F.col("_ties")})
    sizes = counted.groupBy(*by).agg(F.sum("_ties").alias("_n"))
    keys = [*by, value]
    placed = placed.select(*[F.col(k).alias(f"_k_{k}") for k in keys], (F.col("_above") + (F.col("_ties") + 1) / F.lit(2.0)).alias("_rank"))
    out = df.join(placed, reduce(lambda a, b: a & b, [F.col(k).eqNullSafe(F.col(f"_k_{k}")) for k in keys])).drop(*[f"_k_{k}" for k in keys])
    sizes = sizes.select(*[F.col(b).alias(f"_k_{b}") for b in by], "_n")
    out = out.join(sizes, reduce(lambda a, b: a & b, [F.col(b).eqNullSafe(F.col(f"_k_{b}")) for b in by])) if by else out.crossJoin(F.broadcast(sizes))
    out = out.drop(*[f"_k_{b}" for b in by])
    n, rank = F.col("_n"), F.col("_rank")
    return out.withColumn(ends, F.when(n == 1, 1.0).otherwise(1.0 - (rank - 1.0) / (n - 1))).withColumn(middle, 1.0 - (rank - 0.5) / n).drop("_n", "_rank")
