"""Reports: cluster inspection, review summaries, distinctness, coverage, hydration, parity checks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from folioscope.operators.bridges import overlap


def cluster_inspection(assigned: DataFrame, works: DataFrame, tiny: int = 3) -> DataFrame:
    """For each cluster: size, share of all works, whether it is tiny, and the years and citations of its works."""
    total = assigned.agg(F.count(F.lit(1)).alias("total"), F.count_distinct("cluster_id").alias("clusters"))
    g = assigned.join(works.select("work_id", "year", "citation_count", "source_slug"), "work_id", "left").groupBy("cluster_id")
    m = g.agg(
        F.count(F.lit(1)).alias("size"), F.min("year").alias("min_year"), F.max("year").alias("max_year"), F.floor(F.median("citation_count")).cast("int").alias("median_citations"),
        F.count_distinct("source_slug").alias("sources"), F.mode("source_slug", True).alias("main_source"),
    )
    m = m.crossJoin(F.broadcast(total))  # one row
    return m.select(
        "cluster_id", "size", F.round(F.col("size") / F.col("total"), 6).alias("share"), F.round(F.col("size") * F.col("clusters") / F.col("total"), 6).alias("imbalance"), (F.col("size") <= tiny).alias("tiny"),
        "min_year", "max_year", "median_citations", "sources", "main_source",
    )


CLUSTER_INSPECTION_SQL = """
, a AS (SELECT vec_id AS work_id, printf('c%03d', label) AS cluster_id FROM embeddings), s AS (
  SELECT cluster_id, source_slug, count(*) AS n FROM a JOIN works USING (work_id) GROUP BY 1, 2), top AS (SELECT cluster_id, source_slug AS main_source FROM (SELECT *, row_number() OVER (PARTITION BY cluster_id ORDER BY n DESC, source_slug) AS rn FROM s) WHERE rn = 1)
SELECT cluster_id, count(*) AS size, round(count(*) / (SELECT count(*) FROM a)::DOUBLE, 6) AS share, round(count(*) * (SELECT count(DISTINCT cluster_id) FROM a) / (SELECT count(*) FROM a)::DOUBLE, 6) AS imbalance, count(*) <= 3 AS tiny,
  min(year) AS min_year, max(year) AS max_year, CAST(floor(median(citation_count)) AS INTEGER) AS median_citations, count(DISTINCT source_slug) AS sources, any_value(main_source) AS main_source
FROM a LEFT JOIN works USING (work_id) LEFT JOIN top USING (cluster_id) GROUP BY cluster_id"""


def review_summary(rows: DataFrame, *by: str) -> DataFrame:
    """Shares of good, acceptable, surprising or useful and bridge-like rows in a review sheet.

    Columns relevance_label, novelty_label and bridge_like_label. Rows where the bridge label does
    not apply leave its denominator; without others its share is null.
    """
    n = F.count(F.lit(1))

    def share(condition: Column) -> Column:
        return F.round(F.count_if(condition) / n, 6)

    applies = F.coalesce(F.col("bridge_like_label") != "not_applicable", F.lit(True))
    bridge = F.count_if(applies)
    return rows.groupBy(*by).agg(
        n.alias("rows"), share(F.col("relevance_label") == "good").alias("good_only"), share(F.col("relevance_label").isin("good", "acceptable")).alias("good_or_acceptable"),
        share(F.col("novelty_label").isin("surprising", "useful")).alias("surprising_or_useful"),
        F.round(F.when(bridge > 0, F.count_if(F.col("bridge_like_label").isin("yes", "partial")) / bridge), 6).alias("bridge_like"),
    )


def pairwise_deltas(summary: DataFrame, by: str, metric: str) -> DataFrame:
    """Differences of a metric between every two groups of a summary (a handful of rows)."""
    a, b = summary.select(F.col(by).alias("a"), F.col(metric).alias("ma")), summary.select(F.col(by).alias("b"), F.col(metric).alias("mb"))
    return a.join(b, F.col("a") < F.col("b")).select("a", "b", F.round(F.col("ma") - F.col("mb"), 6).alias("delta"))


_SHEET_SQL = """
WITH r AS (SELECT o_orderpriority AS family, CASE o_orderkey % 5 WHEN 0 THEN 'good' WHEN 1 THEN 'acceptable' WHEN 2 THEN 'miss' WHEN 3 THEN 'irrelevant' END AS relevance_label,
  CASE o_orderkey % 3 WHEN 0 THEN 'surprising' WHEN 1 THEN 'obvious' ELSE 'useful' END AS novelty_label, CASE o_orderkey % 7 WHEN 0 THEN 'not_applicable' WHEN 1 THEN 'yes' WHEN 2 THEN 'partial' ELSE 'no' END AS bridge_like_label FROM orders),
s AS (SELECT family, count(*) AS rows, round(count(*) FILTER (WHERE relevance_label = 'good') / count(*)::DOUBLE, 6) AS good_only, round(count(*) FILTER (WHERE relevance_label IN ('good', 'acceptable')) / count(*)::DOUBLE, 6) AS good_or_acceptable,
  round(count(*) FILTER (WHERE novelty_label IN ('surprising', 'useful')) / count(*)::DOUBLE, 6) AS surprising_or_useful,
  round(count(*) FILTER (WHERE bridge_like_label IN ('yes', 'partial')) / count(*) FILTER (WHERE bridge_like_label <> 'not_applicable')::DOUBLE, 6) AS bridge_like FROM r GROUP BY family)"""
REVIEW_SUMMARY_SQL = _SHEET_SQL + " SELECT * FROM s"
PAIRWISE_SQL = _SHEET_SQL + " SELECT x.family AS a, y.family AS b, round(x.good_or_acceptable - y.good_or_acceptable, 6) AS delta FROM s x JOIN s y ON x.family < y.family"


def distinctness(full: DataFrame, eligible: DataFrame, emerging: DataFrame, clustered: bool, rows_with_signal: int) -> DataFrame:
    """Overlaps of three heads (one row each with ``ids``) and the step they suggest."""
    h = full.withColumnRenamed("ids", "f").crossJoin(F.broadcast(eligible.withColumnRenamed("ids", "e"))).crossJoin(F.broadcast(emerging.withColumnRenamed("ids", "m")))
    fe, fm, em = overlap(F.col("f"), F.col("e")), overlap(F.col("f"), F.col("m")), overlap(F.col("e"), F.col("m"))
    differs = F.col("f") != F.col("e")
    less = em["jaccard"] < fm["jaccard"]
    step = (
        F.when(F.lit(rows_with_signal == 0), "insufficient_bridge_signal_coverage")
        .when(~differs | (fe["jaccard"] >= 1.0), "eligible_filter_not_distinct_enough")
        .when(F.lit(not clustered), "inspect_cluster_quality_first")
        .when(less, "candidate_for_small_weight_experiment")
        .otherwise("inspect_cluster_quality_first")
    )
    return h.select(fe["shared"].alias("full_eligible_shared"), fe["jaccard"].alias("full_eligible_jaccard"), fm["jaccard"].alias("full_emerging_jaccard"), em["jaccard"].alias("eligible_emerging_jaccard"), differs.alias("differs"), less.alias("less_emerging_like"), step.alias("suggested_step"))


def coverage_by_bucket(ranked: DataFrame, labelled: str, edges: list[int]) -> DataFrame:
    """Rows and labelled rows in each bucket of ranks: up to each edge, and beyond the last."""
    bucket = F.lit(f"after {edges[-1]}")
    for e in reversed(edges):
        bucket = F.when(F.col("rank") <= e, f"up to {e}").otherwise(bucket)
    g = ranked.groupBy(bucket.alias("bucket")).agg(F.count(F.lit(1)).alias("rows"), F.count_if(F.col(labelled)).alias("labelled"))
    return g.withColumn("share", F.round(F.col("labelled") / F.col("rows"), 6))


COVERAGE_SQL = """
, r AS (SELECT row_number() OVER (ORDER BY citation_count DESC, work_id) AS rank, is_core_corpus AS y FROM included)
SELECT CASE WHEN rank <= 10 THEN 'up to 10' WHEN rank <= 50 THEN 'up to 50' WHEN rank <= 200 THEN 'up to 200' ELSE 'after 200' END AS bucket, count(*) AS rows, count(*) FILTER (WHERE y) AS labelled, round(count(*) FILTER (WHERE y) / count(*)::DOUBLE, 6) AS share
FROM r GROUP BY 1"""


def in_caller_order(ids: list[int], rows: DataFrame, key: str) -> DataFrame:
    """The rows of the given ids in their order; ValueError if one has no row or several."""
    spark = rows.sparkSession
    wanted = spark.createDataFrame(list(enumerate(ids)), f"pos int, {key} long")
    got = wanted.join(rows, key)
    bad = wanted.join(rows.groupBy(key).count(), key, "left").where("coalesce(count, 0) <> 1")
    if not bad.isEmpty():
        raise ValueError("each id needs exactly one row")
    return got.orderBy("pos")


def key_parity(a: DataFrame, b: DataFrame, key: str) -> DataFrame:
    """Keys on one side only, and on which."""
    x, y = a.select(key).distinct().withColumn("in_a", F.lit(True)), b.select(key).distinct().withColumn("in_b", F.lit(True))
    both = x.join(y, key, "full_outer").where("in_a is null or in_b is null")
    return both.select(key, F.when(F.col("in_b").isNull(), "first only").otherwise("second only").alias("side"))


PARITY_SQL = """
SELECT coalesce(l.doc_id, e.vec_id) AS doc_id, CASE WHEN e.vec_id IS NULL THEN 'first only' ELSE 'second only' END AS side FROM (SELECT DISTINCT doc_id FROM labels) l
FULL OUTER JOIN embeddings e ON e.vec_id = l.doc_id WHERE e.vec_id IS NULL OR l.doc_id IS NULL"""


def hydrated(stored: DataFrame, payload: DataFrame, key: str, columns: list[str]) -> DataFrame:
    """Stored rows with the payload's non-blank values put over them, whether a row changed, and what was added."""
    both = stored.alias("s").join(payload.alias("p"), key, "left")
    new = {c: F.coalesce(F.nullif(F.trim(F.col(f"p.{c}").cast("string")), F.lit("")), F.col(f"s.{c}").cast("string")) for c in columns}
    changed = F.lit(False)
    for c in columns:
        changed = changed | ~new[c].eqNullSafe(F.col(f"s.{c}").cast("string"))
    added = F.array_compact(F.array(*[F.when(F.col(f"s.{c}").isNull() & new[c].isNotNull(), F.lit(c)) for c in columns]))
    return both.select(key, *[new[c].alias(c) for c in columns], changed.alias("changed"), F.array_join(added, ",").alias("added"))


HYDRATED_SQL = """
, p AS (SELECT work_id, CASE WHEN work_id % 3 = 0 THEN ' ' WHEN work_id % 3 = 1 THEN 'New title' END AS title, CASE WHEN work_id % 2 = 0 THEN 'Filled' END AS abstract FROM works WHERE work_id % 5 <> 4),
n AS (SELECT w.work_id, w.title AS ot, w.abstract AS oa, coalesce(nullif(trim(p.title), ''), w.title) AS title, coalesce(nullif(trim(p.abstract), ''), w.abstract) AS abstract FROM works w LEFT JOIN p USING (work_id))
SELECT work_id, title, abstract, title IS DISTINCT FROM ot OR abstract IS DISTINCT FROM oa AS changed, CASE WHEN oa IS NULL AND abstract IS NOT NULL THEN 'abstract' ELSE '' END AS added FROM n"""


def response_trend(points: DataFrame, x: str, y: str, *by: str) -> DataFrame:
    """How a metric answers to a weight: rising, falling, flat or mixed over its points in order."""
    before = F.lag(y).over(W.partitionBy(*by).orderBy(x))
    step = points.withColumn("step", F.col(y) - before)
    g = step.groupBy(*by).agg(F.count_if(F.col("step") > 0).alias("up"), F.count_if(F.col("step") < 0).alias("down"), F.count(F.lit(1)).alias("points"))
    trend = F.when(F.col("points") < 2, "too_few").when((F.col("up") == 0) & (F.col("down") == 0), "flat").when(F.col("down") == 0, "rising").when(F.col("up") == 0, "falling").otherwise("mixed")
    return g.select(*by, "points", trend.alias("trend"))


TREND_SQL = """
, m AS (SELECT source_slug, year, round(avg(citation_count), 0) AS y FROM included WHERE year >= 1999 GROUP BY 1, 2), s AS (SELECT *, y - lag(y) OVER (PARTITION BY source_slug ORDER BY year) AS step FROM m)
SELECT source_slug, count(*) AS points, CASE WHEN count(*) < 2 THEN 'too_few' WHEN count(*) FILTER (WHERE step > 0) = 0 AND count(*) FILTER (WHERE step < 0) = 0 THEN 'flat' WHEN count(*) FILTER (WHERE step < 0) = 0 THEN 'rising'
  WHEN count(*) FILTER (WHERE step > 0) = 0 THEN 'falling' ELSE 'mixed' END AS trend FROM s GROUP BY source_slug"""
