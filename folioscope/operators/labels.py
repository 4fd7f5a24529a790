"""Labels, folds, sampling, gates and sequential de-duplication."""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from folioscope.operators.order_stats import quantiles
from folioscope.operators.ranks import before

from folioscope.session import checkpoint_dir


def _token(label: Column) -> Column:
    return F.nullif(F.lower(F.trim(label)), F.lit(""))


def yes_no(label: Column, yes: tuple[str, ...], no: tuple[str, ...]) -> Column:
    """True, false, or null for blank and unknown labels."""
    t = _token(label)
    return F.when(t.isin(*yes), True).when(t.isin(*no), False)


def good_or_acceptable(label: Column) -> Column:
    return yes_no(label, ("good", "acceptable"), ("miss", "irrelevant"))


def surprising_or_useful(label: Column) -> Column:
    return yes_no(label, ("surprising", "useful"), ("obvious", "not_useful", "neither"))


def bridge_like(label: Column) -> Column:
    return yes_no(label, ("yes", "partial"), ("no",))


def recommendable(good: Column, bridge: Column) -> Column:
    """True if both are true, false if either is false, else null."""
    return F.when(good & bridge, True).when((good == False) | (bridge == False), False)  # noqa: E712


def conflicts(df: DataFrame, key: str, label: str) -> DataFrame:
    """Keys judged more than once: how often, and whether the judgements differ (nulls aside)."""
    g = df.groupBy(key).agg(F.count(F.lit(1)).alias("rows"), F.count_distinct(label).alias("values"), F.count(label).alias("judged"))
    return g.where("rows > 1").select(key, "rows", "judged", (F.col("values") > 1).alias("conflict"))


CONFLICTS_SQL = """
SELECT user_id, count(*) AS rows, count(y) AS judged, count(DISTINCT y) > 1 AS conflict
FROM (SELECT user_id, CASE WHEN event_type IN ('click', 'view') THEN true WHEN event_type = 'error' THEN false END AS y FROM events) GROUP BY user_id HAVING count(*) > 1"""


def votes(df: DataFrame, key: str, label: str) -> DataFrame:
    """Any-positive and majority label of each key; a tie has no majority."""
    yes, no = F.count_if(F.col(label)), F.count_if(~F.col(label))
    return df.groupBy(key).agg(F.bool_or(label).alias("any_positive"), F.when(yes > no, True).when(no > yes, False).alias("majority"))


VOTES_SQL = """
SELECT user_id, bool_or(y) AS any_positive, CASE WHEN count(*) FILTER (WHERE y) > count(*) FILTER (WHERE NOT y) THEN true WHEN count(*) FILTER (WHERE NOT y) > count(*) FILTER (WHERE y) THEN false END AS majority
FROM (SELECT user_id, CASE WHEN event_type IN ('click', 'view') THEN true WHEN event_type = 'error' THEN false END AS y FROM events) GROUP BY user_id"""


def class_balance(df: DataFrame, labels: list[str], *by: str) -> DataFrame:
    """For each label: true, false and null rows, and whether 1, 3 or 10 of both classes are there."""
    pairs = F.explode(F.array(*[F.struct(F.lit(c).alias("label"), F.col(c).alias("value")) for c in labels])).alias("p")
    g = df.select(*by, pairs).groupBy(*by, F.col("p.label").alias("label"))
    counted = g.agg(F.count_if(F.col("p.value")).alias("yes"), F.count_if(~F.col("p.value")).alias("no"), F.count_if(F.col("p.value").isNull()).alias("unknown"))
    least = F.least("yes", "no")
    return counted.select(*by, "label", "yes", "no", "unknown", *[(least >= k).alias(f"ready_{k}") for k in (1, 3, 10)])


CLASS_BALANCE_SQL = """
SELECT source, label, count(*) FILTER (WHERE v) AS yes, count(*) FILTER (WHERE NOT v) AS no, count(*) FILTER (WHERE v IS NULL) AS unknown,
  least(count(*) FILTER (WHERE v), count(*) FILTER (WHERE NOT v)) >= 1 AS ready_1, least(count(*) FILTER (WHERE v), count(*) FILTER (WHERE NOT v)) >= 3 AS ready_3, least(count(*) FILTER (WHERE v), count(*) FILTER (WHERE NOT v)) >= 10 AS ready_10
FROM (SELECT source, 'good' AS label, quality = 1 AS v FROM labels JOIN documents USING (doc_id) UNION ALL SELECT source, 'useful', toxic = 0 FROM labels JOIN documents USING (doc_id)) GROUP BY source, label"""


def stratified_folds(df: DataFrame, label: str, key: str, k: int) -> DataFrame:
    """Round-robin folds inside each class, in the order of the key, whatever the size of a class or the spread of the keys."""
    return before(df, [label], [F.col(key).asc_nulls_first()], {"_nth": F.lit(1)}).withColumn("fold", F.pmod("_nth", F.lit(k)).cast("int")).drop("_nth")


FOLDS_SQL = "SELECT doc_id, quality = 1 AS good, CAST((row_number() OVER (PARTITION BY quality ORDER BY doc_id) - 1) % 5 AS INTEGER) AS fold FROM labels JOIN documents USING (doc_id)"


def impute_and_scale(df: DataFrame, value: str, fold: str, k: int) -> DataFrame:
    """For each test fold: nulls become the median of the other folds, then z-scores by their mean and deviation.

    A feature without spread becomes 0. Each row is in k - 1 training sets: one exploded aggregation.
    """
    train = df.select(value, F.explode(F.expr(f"filter(sequence(0, {k - 1}), f -> f <> {fold})")).alias("test"))
    median = quantiles(train, value, {"median": 0.5}, "test")
    filled = train.join(median, "test", "left").withColumn("median", F.coalesce("median", F.lit(0.0))).withColumn("x", F.coalesce(value, "median"))
    stats = filled.groupBy("test").agg(F.first("median").alias("median"), F.avg("x").alias("mean"), F.stddev_pop("x").alias("sd"))
    both = df.join(stats, df[fold] == stats["test"]).withColumn("x", F.coalesce(value, "median"))
    return both.withColumn("z", F.when(F.col("sd") > 0, F.round((F.col("x") - F.col("mean")) / F.col("sd"), 5)).otherwise(0.0))


IMPUTE_SQL = """
WITH l AS (SELECT doc_id, quality, n_chars FROM labels JOIN documents USING (doc_id)),
d AS (SELECT doc_id, CAST(CASE WHEN doc_id % 7 <> 0 THEN n_chars END AS DOUBLE) AS v, CAST((row_number() OVER (PARTITION BY quality ORDER BY doc_id) - 1) % 5 AS INTEGER) AS fold FROM l),
t AS (SELECT f.test, v FROM d JOIN range(5) f(test) ON fold <> f.test), m AS (SELECT test, median(v) AS median FROM t GROUP BY test),
s AS (SELECT test, any_value(median) AS median, avg(coalesce(v, median)) AS mean, stddev_pop(coalesce(v, median)) AS sd FROM t JOIN m USING (test) GROUP BY test)
SELECT doc_id, fold, round((coalesce(v, median) - mean) / sd, 5) AS z FROM d JOIN s ON fold = test"""


def sample_by_hash(df: DataFrame, key: str, seed: str, each: int, *by: str) -> DataFrame:
    """``each`` rows of each stratum, in the order of a hash of seed and key: the same ones on every run."""
    order = F.xxhash64(F.lit(seed), F.col(key))
    nth = F.row_number().over(W.partitionBy(*by).orderBy(order, key))
    return df.withColumn("nth", nth).where(F.col("nth") <= each)


def first_bucket(df: DataFrame, key: str, buckets: list[tuple[str, Column, Column, int]]) -> DataFrame:
    """Fill buckets in order, each up to its limit; a row goes to the first bucket that takes it.

    A bucket is (name, condition, order, limit). Later buckets see what earlier ones left, so
    limits act one after the other; each step is a top-k and an anti-join.
    """
    left, out = df, None
    for name, condition, order, most in buckets:
        got = left.where(condition).orderBy(order, key).limit(most).withColumn("bucket", F.lit(name))
        left = left.join(got.select(key), key, "left_anti")
        out = got if out is None else out.unionByName(got)
    return out


def gates(metrics: DataFrame, thresholds: list[tuple[str, str, str, float]]) -> DataFrame:
    """(gate, observed, threshold, status) for one row of metrics: pass, fail, or missing for null.

    A threshold is (gate, metric column, '>=' or '<=', value).
    """
    rows = []
    for gate, column, comparison, value in thresholds:
        x = F.col(column).cast("double")
        ok = x >= value if comparison == ">=" else x <= value
        status = F.when(x.isNull(), "missing").when(ok, "pass").otherwise("fail")
        rows.append(F.struct(F.lit(gate).alias("gate"), x.alias("observed"), F.lit(float(value)).alias("threshold"), status.alias("status")))
    return metrics.select(F.explode(F.array(*rows)).alias("g")).select("g.*")


def sequential_dedup(df: DataFrame, order: str, keys: list[str], most_rounds: int = 1000) -> DataFrame:
    """Rows in order, each kept unless a kept row before it shares one of its non-null keys; adds ``dropped_by``.

    A row that was dropped doesn't reserve its keys. In each round a row whose every earlier
    sharer is decided gets its own verdict: kept if all of them were dropped. Rows without an
    earlier sharer are decided at once, so the rounds follow the longest chain of sharers.
    """
    checkpoint_dir(df.sparkSession)
    rows = df.select(order, *keys)
    waiting, decided = rows, None
    for _ in range(most_rounds):
        first = waiting
        for k in keys:
            least = waiting.where(F.col(k).isNotNull()).groupBy(k).agg(F.min(order).alias(f"_{k}"))
            first = first.join(least, k, "left")
        alone = reduce(lambda a, b: a & b, [F.col(f"_{k}").isNull() | (F.col(f"_{k}") == F.col(order)) for k in keys])
        winners = first.where(alone).select(order, *keys)
        winners = winners.checkpoint()
        lost = waiting.join(winners.select(order), order, "left_anti")
        reason = F.lit(None).cast("string")
        for k in reversed(keys):
            mine = winners.where(F.col(k).isNotNull()).select(k, F.lit(True).alias(f"_w_{k}")).distinct()
            lost = lost.join(mine, k, "left")
            reason = F.when(F.coalesce(F.col(f"_w_{k}"), F.lit(False)), k).otherwise(reason)
        lost = lost.select(order, *keys, reason.alias("dropped_by")).checkpoint()
        done = winners.select(order, F.lit(None).cast("string").alias("dropped_by")).unionByName(lost.where("dropped_by is not null").select(order, "dropped_by"))
        decided = done if decided is None else decided.unionByName(done)
        waiting = lost.where("dropped_by is null").drop("dropped_by")
        if waiting.isEmpty():
            break
    else:
        raise RuntimeError("too long a chain of shared keys")
    return df.join(decided, order)


def embed_missing(texts: DataFrame, stored: DataFrame, provider, key: str, text: str, batch: int = 32) -> DataFrame:
    """(key, vector) for the rows without one, by an injected provider: a list of texts to a list of vectors."""
    todo = texts.join(stored.select(key), key, "left_anti").select(key, text)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for lo in range(0, len(pdf), batch):
                part = pdf.iloc[lo : lo + batch]
                yield pd.DataFrame({key: part[key], "vector": provider(part[text].fillna("").tolist())})

    return todo.mapInPandas(run, f"{key} long, vector array<double>")
