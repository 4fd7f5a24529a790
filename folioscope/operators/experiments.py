"""Offline experiments: groups and holdouts, leakage, out-of-fold scores, transfer between pools, sweeps."""

from __future__ import annotations

from pyspark.ml import Pipeline
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.feature import OneHotEncoder, StandardScaler, StringIndexer, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from folioscope.operators.metrics import roc_auc
from folioscope.operators.ranks import before
from folioscope.session import stored


def canonical_groups(rows: DataFrame, key: str, row: str) -> DataFrame:
    """Each row with the smallest row id of its key: rows of one work stay together."""
    first = rows.groupBy(key).agg(F.min(row).alias("group_id"), F.count(F.lit(1)).alias("group_size"))
    return rows.join(first, key)


def holdout(rows: DataFrame, held: DataFrame, key: str) -> DataFrame:
    """Adds ``split``: 'eval' for the works in the held set, else 'train'."""
    marked = held.select(key).distinct().withColumn("_held", F.lit(True))
    return rows.join(marked, key, "left").withColumn("split", F.when(F.col("_held"), "eval").otherwise("train")).drop("_held")


def leaked(rows: DataFrame, key: str) -> DataFrame:
    """Keys that stand in both splits: there must be none."""
    return rows.groupBy(key).agg(F.count_distinct("split").alias("splits")).where("splits > 1").select(key)


def grouped_folds(rows: DataFrame, key: str, label: str, k: int, seed: str) -> DataFrame:
    """Folds by group: all rows of a work in one, and works of either label dealt out in turn.

    A work counts as positive if any of its rows is. The works of a label are numbered in the order of a
    hash, so each fold gets as many of them as any other, give or take one.
    """
    works = rows.groupBy(key).agg(F.max(F.col(label).cast("int")).alias("_class")).withColumn("_order", F.xxhash64(F.lit(seed), F.col(key)))
    placed = before(works, ["_class"], [F.col("_order"), F.col(key)], {"_nth": F.lit(1)})
    return rows.join(placed.select(key, (F.col("_nth") % k).cast("int").alias("fold")), key)


def scorer(numeric: list[str], categorical: list[str] = (), strength: float = 0.01) -> Pipeline:
    """Standardised numbers and one-hot categories into an L2 logistic regression on ``label``."""
    stages = [VectorAssembler(inputCols=numeric, outputCol="_numbers", handleInvalid="keep"), StandardScaler(inputCol="_numbers", outputCol="_scaled", withMean=True)]
    parts = ["_scaled"]
    if categorical:
        indexed, hot = [f"_{c}_index" for c in categorical], [f"_{c}_hot" for c in categorical]
        stages += [StringIndexer(inputCols=list(categorical), outputCols=indexed, handleInvalid="keep"), OneHotEncoder(inputCols=indexed, outputCols=hot)]
        parts += hot
    stages += [VectorAssembler(inputCols=parts, outputCol="features"), LogisticRegression(regParam=strength, labelCol="label", probabilityCol="_probability", rawPredictionCol="_raw", predictionCol="_predicted")]
    return Pipeline(stages=stages)


def out_of_fold(rows: DataFrame, pipeline: Pipeline, k: int) -> DataFrame:
    """Probabilities of every row from the model of the other folds; k is small, so folds go one by one."""
    out, rows = None, stored(rows, "scored-rows")  # each pass of a fit reads them, in few tasks
    for fold in range(k):
        model = pipeline.fit(rows.where(F.col("fold") != fold))
        got = model.transform(rows.where(F.col("fold") == fold)).withColumn("probability", vector_to_array("_probability")[1])
        got = got.select(*rows.columns, "probability")
        out = got if out is None else out.unionByName(got)
    return out


def transfer_matrix(rows: DataFrame, pipeline: Pipeline, pool: str) -> DataFrame:
    """AUC of the model of each pool on every pool; the pools are a handful of named sets."""
    rows = stored(rows, "pool-rows")
    names = sorted(r[0] for r in rows.select(pool).distinct().collect())
    out = None
    for name in names:
        model = pipeline.fit(rows.where(F.col(pool) == name))
        scored = model.transform(rows).withColumn("probability", vector_to_array("_probability")[1]).withColumn("good", F.col("label") == 1)
        got = roc_auc(scored, "probability", "good", pool).select(F.lit(name).alias("trained_on"), F.col(pool).alias("tested_on"), "roc_auc")
        out = got if out is None else out.unionByName(got)
    return out


def strength_sweep(rows: DataFrame, numeric: list[str], strengths: list[float], k: int) -> DataFrame:
    """Pooled out-of-fold AUC for each penalty strength."""
    out, rows = None, stored(rows, "sweep-rows")
    for s in strengths:
        scored = out_of_fold(rows, scorer(numeric, strength=s), k).withColumn("good", F.col("label") == 1)
        got = roc_auc(scored, "probability", "good").select(F.lit(float(s)).alias("strength"), F.round("roc_auc", 4).alias("roc_auc"))
        out = got if out is None else out.unionByName(got)
    return out


def moves(ranked: DataFrame, old: str, new: str, label: str, k: int) -> DataFrame:
    """Rows that a new ranking promotes into the first k or demotes out of them, by label."""
    change = F.when((F.col(old) > k) & (F.col(new) <= k), "promoted").when((F.col(old) <= k) & (F.col(new) > k), "demoted").when((F.col(old) <= k) & (F.col(new) <= k), "stayed")
    return ranked.withColumn("change", change).where("change is not null").groupBy("change").agg(F.count_if(F.col(label)).alias("yes"), F.count_if(~F.col(label)).alias("no"), F.count_if(F.col(label).isNull()).alias("unlabelled"))


MOVES_SQL = """
, r AS (SELECT row_number() OVER (ORDER BY citation_count DESC, work_id) AS o, row_number() OVER (ORDER BY year DESC, citation_count DESC, work_id) AS n, CASE WHEN work_id % 3 = 0 THEN NULL ELSE is_core_corpus END AS y FROM included),
c AS (SELECT *, CASE WHEN o > 100 AND n <= 100 THEN 'promoted' WHEN o <= 100 AND n > 100 THEN 'demoted' WHEN o <= 100 AND n <= 100 THEN 'stayed' END AS change FROM r)
SELECT change, count(*) FILTER (WHERE y) AS yes, count(*) FILTER (WHERE NOT y) AS no, count(*) FILTER (WHERE y IS NULL) AS unlabelled FROM c WHERE change IS NOT NULL GROUP BY change"""
