"""Stratified samples with budgets: shares of a total, spread evenly over strata, with what one can't fill going on."""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from folioscope.session import stored


class Budget(NamedTuple):
    """A share of the total for the rows that meet ``where``, spread over the strata of the columns ``by``."""

    name: str
    share: float
    by: tuple[str, ...]
    where: Column | None = None


def quotas(total: int, budgets: list[Budget]) -> list[int]:
    """Whole quotas by largest remainder; ties go to the earlier budget."""
    exact = [total * b.share / sum(x.share for x in budgets) for b in budgets]
    floors = [int(x + 1e-9) for x in exact]
    order = sorted(range(len(budgets)), key=lambda i: (-(exact[i] - floors[i]), i))
    for i in order[: total - sum(floors)]:
        floors[i] += 1
    return floors


def hash_order(key: str, seed: str) -> Column:
    """An order that does not depend on the order of rows, and that SQL can repeat."""
    return F.md5(F.concat(F.lit(f"{seed}:"), F.col(key).cast("string")))


def spread_evenly(df: DataFrame, by: tuple[str, ...], key: str, seed: str, most: int) -> DataFrame:
    """``most`` rows with ``nth``, their place in their stratum by hash: first rows of all strata go before second ones.

    So every stratum has the same quota, and what small ones can't fill goes to the others, without a table of
    quotas. The limit on the place cuts each stratum before the shuffle.
    """
    # one partition column stands for none, so that a sample without strata is a stratum
    nth = F.row_number().over(W.partitionBy(*(by or [F.lit(0)])).orderBy(hash_order(key, seed), key))
    placed = df.withColumn("nth", nth).where(F.col("nth") <= most)
    return placed.orderBy("nth", *[F.col(b).asc_nulls_first() for b in by], hash_order(key, seed), key).limit(most)


def sample_with_budgets(df: DataFrame, key: str, seed: str, total: int, budgets: list[Budget]) -> DataFrame:
    """``total`` rows of ``df`` (fewer if there are no more), with ``bucket`` and ``nth``.

    Budgets are filled in order, from rows that earlier ones left; what one can't fill is added to the next. What the
    last can't fill is left open. Keys must be unique; null strata are strata. Only counts of bounded samples come to the driver.
    """
    left, out, carry = df, None, 0
    for budget, quota in zip(budgets, quotas(total, budgets), strict=True):
        here = left if budget.where is None else left.where(budget.where)
        got = stored(spread_evenly(here, budget.by, key, seed, quota + carry).withColumn("bucket", F.lit(budget.name)), "sample")
        carry = quota + carry - got.count()
        left = left.join(F.broadcast(got.select(key)), key, "left_anti")  # a quota at most
        out = got if out is None else out.unionByName(got)
    return out


BUDGET_SQL = """
WITH l AS (SELECT doc_id, source, quality = 1 AS good, n_chars FROM labels JOIN documents USING (doc_id)), h AS (SELECT *, md5('blind-1:' || doc_id) AS h, n_chars // 1000 AS size FROM l),
a AS (SELECT doc_id, 'good-by-source' AS bucket, nth FROM (SELECT *, row_number() OVER (PARTITION BY source ORDER BY h, doc_id) AS nth FROM h WHERE good) ORDER BY nth, source NULLS FIRST, h, doc_id LIMIT 80),
b AS (SELECT doc_id, 'rest-by-size' AS bucket, nth FROM (SELECT *, row_number() OVER (PARTITION BY size ORDER BY h, doc_id) AS nth FROM h WHERE doc_id NOT IN (SELECT doc_id FROM a)) ORDER BY nth, size NULLS FIRST, h, doc_id LIMIT 100 - (SELECT count(*) FROM a))
SELECT doc_id, bucket, CAST(nth AS INTEGER) AS nth FROM a UNION ALL SELECT doc_id, bucket, CAST(nth AS INTEGER) FROM b"""
