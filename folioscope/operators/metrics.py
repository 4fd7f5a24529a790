"""Ranking metrics over scored and labelled rows, as aggregations and windows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from folioscope.operators.order_stats import joined_back, quantiles
from folioscope.operators.ranks import before
from folioscope.session import stored


def roc_auc(df: DataFrame, score: str, label: str, *by: str) -> DataFrame:
    """Area under the ROC curve by the rank sum of the positives, ties at their mean rank.

    It equals the share of (positive, negative) pairs in the right order, ties counting half.
    Null without both labels. Scores are first counted, so the ranks come from distinct values.
    """
    counted = df.where(F.col(label).isNotNull()).groupBy(*by, score).agg(F.count(F.lit(1)).alias("n"), F.sum(F.col(label).cast("long")).alias("pos"))
    placed = before(counted, list(by), [F.col(score).asc_nulls_first()], {"_below": F.col("n")})
    ranked = placed.withColumn("rank", F.col("_below") + (F.col("n") + 1) / 2.0)
    total = ranked.groupBy(*by).agg(F.sum(F.col("pos") * F.col("rank")).alias("r"), F.sum("pos").alias("p"), F.sum("n").alias("n"))
    negatives = F.col("n") - F.col("p")
    auc = (F.col("r") - F.col("p") * (F.col("p") + 1) / 2.0) / (F.col("p") * negatives)
    return total.select(*by, "p", negatives.alias("neg"), F.when((F.col("p") > 0) & (negatives > 0), auc).alias("roc_auc"))


ROC_AUC_SQL = """
WITH l AS (SELECT source, quality = 1 AS good, n_chars % 500 / 500.0::DOUBLE AS score FROM labels JOIN documents USING (doc_id)),
r AS (SELECT *, (rank() OVER (PARTITION BY source ORDER BY score) + (count(*) OVER (PARTITION BY source, score) - 1) / 2.0::DOUBLE) AS rk FROM l)
SELECT source, CAST(sum(good::INT) AS BIGINT) AS p, CAST(sum((NOT good)::INT) AS BIGINT) AS neg,
  CASE WHEN sum(good::INT) > 0 AND sum((NOT good)::INT) > 0 THEN round((sum(CASE WHEN good THEN rk ELSE 0 END) - sum(good::INT) * (sum(good::INT) + 1) / 2.0::DOUBLE) / (sum(good::INT) * sum((NOT good)::INT)), 6) END AS roc_auc
FROM r GROUP BY source"""


def _order(score: str, label: str, key: str) -> list[Column]:
    """Best first; among equal scores negatives first, so that ties never flatter."""
    return [F.desc(score), F.asc(label), F.asc(key)]


def precision_at(df: DataFrame, score: str, label: str, key: str, ks: list[int], *by: str) -> DataFrame:
    """Precision and recall in the first k rows for each k; null where there are fewer rows."""
    place = F.row_number().over(W.partitionBy(*by).orderBy(*_order(score, label, key)))
    # only the head is ranked; totals come from one aggregation
    head = df.withColumn("place", place).where(F.col("place") <= max(ks))
    parts = []
    for k in ks:
        hit = F.sum(F.when(F.col("place") <= k, F.col(label).cast("long")).otherwise(0))
        parts.append(hit.alias(f"hit_{k}"))
    total = df.groupBy(*by).agg(F.count(F.lit(1)).alias("n"), F.sum(F.col(label).cast("long")).alias("positives"))
    out = head.groupBy(*by).agg(*parts).join(total, list(by))
    columns = []
    for k in ks:
        enough = F.col("n") >= k
        columns.append(F.when(enough, F.round(F.col(f"hit_{k}") / F.lit(float(k)), 6)).alias(f"precision_at_{k}"))
        columns.append(F.when(enough & (F.col("positives") > 0), F.round(F.col(f"hit_{k}") / F.col("positives"), 6)).alias(f"recall_at_{k}"))
    return out.select(*by, "n", *columns)


PRECISION_SQL = """
WITH l AS (SELECT doc_id, source, quality = 1 AS good, n_chars % 500 / 500.0::DOUBLE AS score FROM labels JOIN documents USING (doc_id)),
r AS (SELECT *, row_number() OVER (PARTITION BY source ORDER BY score DESC, good, doc_id) AS place FROM l)
SELECT source, count(*) AS n,
  CASE WHEN count(*) >= 5 THEN round(sum((good AND place <= 5)::INT) / 5.0::DOUBLE, 6) END AS precision_at_5,
  CASE WHEN count(*) >= 5 AND sum(good::INT) > 0 THEN round(sum((good AND place <= 5)::INT) / sum(good::INT)::DOUBLE, 6) END AS recall_at_5,
  CASE WHEN count(*) >= 20 THEN round(sum((good AND place <= 20)::INT) / 20.0::DOUBLE, 6) END AS precision_at_20,
  CASE WHEN count(*) >= 20 AND sum(good::INT) > 0 THEN round(sum((good AND place <= 20)::INT) / sum(good::INT)::DOUBLE, 6) END AS recall_at_20
FROM r GROUP BY source"""


def average_precision(df: DataFrame, score: str, label: str, key: str, *by: str) -> DataFrame:
    """Mean of the precision at each positive row; null without a positive one."""
    placed = before(df.select(*by, score, label, key), list(by), _order(score, label, key), {"rows": F.lit(1), "hits": F.col(label).cast("int")})
    precision = F.when(F.col(label), (F.col("hits") + 1) / (F.col("rows") + 1))
    return placed.groupBy(*by).agg(F.round(F.avg(precision), 6).alias("average_precision"))


AVERAGE_PRECISION_SQL = """
WITH l AS (SELECT doc_id, source, quality = 1 AS good, n_chars % 500 / 500.0::DOUBLE AS score FROM labels JOIN documents USING (doc_id)),
r AS (SELECT *, row_number() OVER w AS place, sum(good::INT) OVER (w ROWS UNBOUNDED PRECEDING) AS hits FROM l WINDOW w AS (PARTITION BY source ORDER BY score DESC, good, doc_id))
SELECT source, round(avg(CASE WHEN good THEN hits / place::DOUBLE END), 6) AS average_precision FROM r GROUP BY source"""


def confusion(df: DataFrame, predicted: str, label: str, *by: str) -> DataFrame:
    """Counts of the four cases, accuracy, balanced accuracy and macro F1."""
    p, y = F.col(predicted), F.col(label)

    def count(condition: Column) -> Column:
        return F.count_if(condition)

    c = df.where(p.isNotNull() & y.isNotNull()).groupBy(*by).agg(count(p & y).alias("tp"), count(p & ~y).alias("fp"), count(~p & y).alias("fn"), count(~p & ~y).alias("tn"))
    tp, fp, fn, tn = (F.col(x).cast("double") for x in ("tp", "fp", "fn", "tn"))

    def ratio(a: Column, b: Column) -> Column:
        return F.when(b > 0, a / b).otherwise(0.0)

    return c.select(
        *by, "tp", "fp", "fn", "tn", F.round((tp + tn) / (tp + fp + fn + tn), 6).alias("accuracy"),
        F.round((ratio(tp, tp + fn) + ratio(tn, tn + fp)) / 2, 6).alias("balanced_accuracy"), F.round((ratio(2 * tp, 2 * tp + fp + fn) + ratio(2 * tn, 2 * tn + fn + fp)) / 2, 6).alias("macro_f1"),
    )


CONFUSION_SQL = """
WITH c AS (SELECT source, count(*) FILTER (WHERE s AND y) AS tp, count(*) FILTER (WHERE s AND NOT y) AS fp, count(*) FILTER (WHERE NOT s AND y) AS fn, count(*) FILTER (WHERE NOT s AND NOT y) AS tn
  FROM (SELECT source, n_chars % 500 / 500.0::DOUBLE >= 0.5 AS s, quality = 1 AS y FROM labels JOIN documents USING (doc_id)) GROUP BY source)
SELECT source, tp, fp, fn, tn, round((tp + tn) / (tp + fp + fn + tn)::DOUBLE, 6) AS accuracy,
  round((CASE WHEN tp + fn > 0 THEN tp / (tp + fn)::DOUBLE ELSE 0 END + CASE WHEN tn + fp > 0 THEN tn / (tn + fp)::DOUBLE ELSE 0 END) / 2, 6) AS balanced_accuracy,
  round((CASE WHEN 2 * tp + fp + fn > 0 THEN 2 * tp / (2 * tp + fp + fn)::DOUBLE ELSE 0 END + CASE WHEN 2 * tn + fn + fp > 0 THEN 2 * tn / (2 * tn + fn + fp)::DOUBLE ELSE 0 END) / 2, 6) AS macro_f1
FROM c"""


def distribution(df: DataFrame, value: str, *by: str) -> DataFrame:
    """Count, nulls, distinct values, minimum, quartiles (linear interpolation), maximum and mean."""
    v = F.col(value)
    d = df.groupBy(*by).agg(F.count(v).alias("n"), F.count_if(v.isNull()).alias("nulls"), F.count_distinct(v).alias("distinct_values"), F.min(v).alias("min"), F.max(v).alias("max"), F.round(F.avg(v), 6).alias("mean"))
    names = ("p25", "median", "p75")
    d = joined_back(d, quantiles(df, value, dict(zip(names, (0.25, 0.5, 0.75), strict=True)), *by), list(by))
    return d.select(*by, "n", "nulls", "distinct_values", "min", *[F.round(n, 6).alias(n) for n in names], "max", "mean")


DISTRIBUTION_SQL = """
SELECT source_slug, count(c) AS n, count(*) - count(c) AS nulls, count(DISTINCT c) AS distinct_values, min(c) AS min, round(quantile_cont(c, 0.25), 6) AS p25,
  round(quantile_cont(c, 0.5), 6) AS median, round(quantile_cont(c, 0.75), 6) AS p75, max(c) AS max, round(avg(c), 6) AS mean
FROM (SELECT source_slug, CAST(CASE WHEN citation_count % 9 <> 0 THEN citation_count END AS DOUBLE) AS c FROM included) GROUP BY source_slug"""


def correlation(df: DataFrame, a: str, b: str, *by: str) -> DataFrame:
    """Pearson's correlation; null where it is not defined."""
    return df.groupBy(*by).agg(F.round(F.when((F.stddev_pop(a) > 0) & (F.stddev_pop(b) > 0), F.corr(a, b)), 6).alias("pearson"), F.count(F.lit(1)).alias("n"))


CORRELATION_SQL = "SELECT source_slug, round(corr(year::DOUBLE, citation_count::DOUBLE), 6) AS pearson, count(*) AS n FROM included GROUP BY source_slug"


def rank_displacement(a: DataFrame, b: DataFrame, key: str, rank: str = "rank") -> DataFrame:
    """How far shared rows move between two rankings: mean, median, 90th percentile and maximum."""
    moved = a.select(key, F.col(rank).alias("ra")).join(b.select(key, F.col(rank).alias("rb")), key).select(F.abs(F.col("ra") - F.col("rb")).alias("d"))
    moved = stored(moved, "moved")
    one = moved.agg(F.count("d").alias("shared"), F.round(F.avg("d"), 6).alias("mean"), F.max("d").alias("max"))
    found = quantiles(moved, "d", {"median": 0.5, "p90": 0.9})
    return one.crossJoin(F.broadcast(found)).select("shared", "mean", "median", F.round("p90", 6).alias("p90"), "max")  # one row each


RANK_DISPLACEMENT_SQL = """
WITH r AS (SELECT work_id, row_number() OVER (ORDER BY citation_count DESC, work_id) AS ra, row_number() OVER (ORDER BY year DESC, work_id) AS rb FROM included),
d AS (SELECT abs(ra - rb) AS d FROM r)
SELECT count(*) AS shared, round(avg(d), 6) AS mean, quantile_cont(d, 0.5)::DOUBLE AS median, round(quantile_cont(d, 0.9), 6)::DOUBLE AS p90, CAST(max(d) AS INTEGER) AS max FROM d"""


def family_context(rows: DataFrame, family: str, score: str, rank: str, targets: list[str]) -> DataFrame:
    """For each family and target: class counts, rows with a score or rank, median ranks and mean scores of both classes, AUC.

    A row without a score takes no part in the mean and the AUC, one without a rank none in the median.
    Means are cut, not rounded, to nine places, from scores in whole millionths.
    """
    pairs = F.explode(F.array(*[F.struct(F.lit(t).alias("target"), F.col(t).alias("y")) for t in targets])).alias("p")
    long = rows.select(family, F.col(score).alias("_score"), F.col(rank).alias("_rank"), pairs).select(family, "p.target", "p.y", "_score", "_rank")
    long, by = stored(long, "context"), [family, "target"]
    y, micro = F.col("y"), F.round(F.col("_score") * 1000000).cast("long")

    def mean(name: str, of: Column) -> list[Column]:
        return [F.sum(F.when(of, micro)).alias(f"_sum_{name}"), F.count_if(of & F.col("_score").isNotNull()).alias(f"_n_{name}")]

    counts = long.groupBy(*by).agg(
        F.count_if(y).alias("positive_count"), F.count_if(~y).alias("negative_count"), F.count_if(y.isNull()).alias("null_count"),
        F.count("_score").alias("rows_with_score"), F.count("_rank").alias("rows_with_rank"), *mean("positive", y), *mean("negative", ~y),
    )
    for name in ("positive", "negative"):
        whole = F.expr(f"_sum_{name} * 1000 div nullif(_n_{name}, 0)")
        counts = counts.withColumn(f"mean_score_{name}", whole / F.lit(1000000000.0)).drop(f"_sum_{name}", f"_n_{name}")
    middle = quantiles(long.where(y.isNotNull()), "_rank", {"_median": 0.5}, *by, "y")
    medians = middle.groupBy(*by).agg(F.max(F.when(y, F.col("_median"))).alias("median_rank_positive"), F.max(F.when(~y, F.col("_median"))).alias("median_rank_negative"))
    auc = roc_auc(long.where(F.col("_score").isNotNull()), "_score", "y", *by).select(*by, "roc_auc")
    return joined_back(joined_back(counts, medians, by), auc, by)


FAMILY_CONTEXT_SQL = """
, k AS (SELECT work_id, family, final_score, rank() OVER (PARTITION BY family ORDER BY final_score DESC, work_id) AS rank FROM scores),
r AS (SELECT f.family, w.work_id, final_score, rank, CASE WHEN w.work_id % 3 <> 0 THEN is_core_corpus END AS core, citation_count >= 4 AS cited
  FROM included w CROSS JOIN (VALUES ('emerging'), ('bridge'), ('undercited')) f(family) LEFT JOIN k ON k.work_id = w.work_id AND k.family = f.family),
l AS (SELECT family, 'core' AS target, core AS y, final_score, rank FROM r UNION ALL SELECT family, 'cited', cited, final_score, rank FROM r),
u AS (SELECT *, rank() OVER w + (count(*) OVER (PARTITION BY family, target, final_score) - 1) / 2.0::DOUBLE AS up FROM l WHERE y IS NOT NULL AND final_score IS NOT NULL WINDOW w AS (PARTITION BY family, target ORDER BY final_score)),
a AS (SELECT family, target, sum(y::INT) AS p, sum((NOT y)::INT) AS n, sum(CASE WHEN y THEN up END) AS s FROM u GROUP BY ALL)
SELECT family, target, count(*) FILTER (WHERE y) AS positive_count, count(*) FILTER (WHERE NOT y) AS negative_count, count(*) FILTER (WHERE y IS NULL) AS null_count,
  count(final_score) AS rows_with_score, count(rank) AS rows_with_rank,
  (sum(CAST(round(final_score * 1000000) AS BIGINT)) FILTER (WHERE y))::BIGINT * 1000 // nullif(count(final_score) FILTER (WHERE y), 0) / 1000000000.0::DOUBLE AS mean_score_positive,
  (sum(CAST(round(final_score * 1000000) AS BIGINT)) FILTER (WHERE NOT y))::BIGINT * 1000 // nullif(count(final_score) FILTER (WHERE NOT y), 0) / 1000000000.0::DOUBLE AS mean_score_negative,
  median(rank) FILTER (WHERE y) AS median_rank_positive, median(rank) FILTER (WHERE NOT y) AS median_rank_negative,
  any_value(CASE WHEN p > 0 AND n > 0 THEN round((s - p * (p + 1) / 2.0::DOUBLE) / (p * n), 6) END) AS roc_auc
FROM l LEFT JOIN a USING (family, target) GROUP BY family, target"""
