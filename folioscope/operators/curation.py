"""Checks and repairs of a corpus before it is embedded, ranked or judged."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from folioscope.functions.text import cleaned


def repaired(works: DataFrame, columns: list[str]) -> DataFrame:
    """Works with cleaned texts and ``changed``; a null text stays null."""
    new = {c: F.when(F.col(c).isNotNull(), cleaned(F.col(c))) for c in columns}
    out = works.withColumns({f"_{c}": x for c, x in new.items()})
    changed = F.lit(False)
    for c in columns:
        changed = changed | ~F.col(f"_{c}").eqNullSafe(F.col(c))
    out = out.withColumn("changed", changed)
    return out.select(*[F.col(f"_{c}").alias(c) if c in columns else c for c in works.columns], "changed")


def repair_counts(repaired_works: DataFrame) -> DataFrame:
    """One row, scanned and changed: what a dry run reports."""
    return repaired_works.agg(F.count(F.lit(1)).alias("scanned"), F.count_if("changed").alias("changed"))


def _blank(c: str) -> Column:
    return F.length(F.trim(F.coalesce(F.col(c), F.lit("")))) == 0


def readiness(works: DataFrame, *by: str) -> DataFrame:
    """Works that lack a title, an abstract, a known type or a language; ready if there are none."""
    unknown = _blank("type") | F.lower(F.trim("type")).isin("unknown", "other")
    g = works.groupBy(*by).agg(
        F.count_if(_blank("title")).alias("missing_title"), F.count_if(_blank("abstract")).alias("missing_abstract"), F.count_if(unknown).alias("unknown_type"), F.count_if(_blank("language")).alias("missing_language")
    )
    return g.withColumn("ready", F.col("missing_title") + F.col("missing_abstract") + F.col("unknown_type") + F.col("missing_language") == 0)


READINESS_SQL = """
, w AS (SELECT source_slug, title, abstract, CASE WHEN work_id % 17 = 0 THEN 'Unknown' WHEN work_id % 19 = 0 THEN NULL ELSE 'article' END AS type, CASE WHEN work_id % 23 <> 0 THEN 'en' END AS language FROM included),
g AS (SELECT source_slug, count(*) FILTER (WHERE length(trim(title)) = 0) AS missing_title, count(*) FILTER (WHERE abstract IS NULL) AS missing_abstract, count(*) FILTER (WHERE type IS NULL OR type = 'Unknown') AS unknown_type, count(*) FILTER (WHERE language IS NULL) AS missing_language FROM w GROUP BY source_slug)
SELECT *, missing_title + missing_abstract + unknown_type + missing_language = 0 AS ready FROM g"""


def venue_match(locations: Column, source_id: str, name: Column) -> Column:
    """'source_id' if a location has the source, else 'location_name' if one's name matches, else null.

    ``locations`` is an array of (source_id, name, raw_name); ``name`` a function of a name.
    """
    by_id = F.exists(locations, lambda x: x["source_id"] == source_id)
    by_name = F.exists(locations, lambda x: name(x["name"]) | name(x["raw_name"]))
    return F.when(F.coalesce(by_id, F.lit(False)), "source_id").when(F.coalesce(by_name, F.lit(False)), "location_name")


def conference_name(name: Column) -> Column:
    """Whether a venue name means the music-retrieval conference, in any of its forms, and not the journal."""
    n = F.lower(F.trim(F.regexp_replace(F.coalesce(name, F.lit("")), "\\s+", " ")))
    known = F.contains(F.concat(F.lit(" "), n), F.lit(" ismir"))
    long_form = F.contains(n, F.lit("music information retrieval")) & (F.contains(n, F.lit("society")) | F.contains(n, F.lit("symposium")) | F.contains(n, F.lit("conference")))
    return ~F.contains(n, F.lit("transactions")) & (known | long_form)


def audit_rows(rows: DataFrame, run: str, row_id: str, order: str) -> tuple[DataFrame, DataFrame]:
    """(rows of a run's audit split, the first of each row id; one row with how many were dropped)."""
    mine = rows.where((F.col("split") == "audit_only") & (F.col("ranking_run_id") == run))
    named, anonymous = mine.where(f"coalesce({row_id}, '') <> ''"), mine.where(f"coalesce({row_id}, '') = ''")
    columns = [c for c in rows.columns if c != row_id]
    first = named.groupBy(row_id).agg(F.min_by(F.struct(*columns), F.col(order)).alias("r"), F.count(F.lit(1)).alias("n"))
    kept = first.select(*[F.col(row_id) if c == row_id else F.col(f"r.{c}").alias(c) for c in rows.columns]).unionByName(anonymous)
    return kept, first.agg(F.coalesce(F.sum(F.col("n") - 1), F.lit(0)).alias("dropped"))


def feature_summary(rows: DataFrame, features: list[str], *by: str) -> DataFrame:
    """Count, mean and median of each feature, nulls aside."""
    each = rows.select(*by, F.explode(F.array(*[F.struct(F.lit(f).alias("feature"), F.col(f).cast("double").alias("value")) for f in features])).alias("x"))
    return each.groupBy(*by, F.col("x.feature").alias("feature")).agg(F.count("x.value").alias("n"), F.round(F.avg("x.value"), 6).alias("mean"), F.round(F.median("x.value"), 6).alias("median"))


FEATURE_SUMMARY_SQL = """
, f AS (SELECT source_slug, 'year' AS feature, year::DOUBLE AS value FROM included UNION ALL SELECT source_slug, 'citation_count', citation_count::DOUBLE FROM included)
SELECT source_slug, feature, count(value) AS n, round(avg(value), 6) AS mean, round(median(value), 6) AS median FROM f GROUP BY 1, 2"""


def scoring_arms(rows: DataFrame, key: str, final: str, learned: str, final_pct: str, learned_pct: str) -> DataFrame:
    """(key, arm, score): the five fixed arms of a hybrid scoring experiment."""
    f, x, fp, xp = (F.col(c) for c in (final, learned, final_pct, learned_pct))
    arms = {
        "heuristic_final_score_baseline": f, "holdout_embedding_probability_baseline": x, "hybrid_rank_mean_50_50": 0.5 * fp + 0.5 * xp,
        "hybrid_rank_mean_75_25_heuristic": 0.75 * fp + 0.25 * xp, "hybrid_rank_mean_25_75_heuristic": 0.25 * fp + 0.75 * xp,
    }
    return rows.select(key, F.explode(F.array(*[F.struct(F.lit(n).alias("arm"), s.alias("score")) for n, s in arms.items()])).alias("a")).select(key, "a.arm", "a.score")


def mix_payload(mix: DataFrame, k: int) -> DataFrame:
    """(work_id, payload): a neighbour mix as the JSON that a score row keeps; ineligible works have no counts."""
    struct = F.struct(
        F.lit("neighbor_mix_v1").alias("signal_version"), F.lit(k).alias("k"), F.col("eligible"), F.when(F.col("eligible"), F.col("mix_score")).alias("mix_score"),
        F.when(F.col("eligible"), F.col("foreign_count")).alias("foreign_neighbor_count"),
    )
    return mix.select("work_id", F.to_json(struct).alias("payload"))


def feature_coverage(works: DataFrame, vectors: DataFrame, scores: DataFrame) -> DataFrame:
    """For each work: whether it has a vector, how many score rows, and whether it may be embedded."""
    n = scores.groupBy("work_id").agg(F.count(F.lit(1)).alias("score_rows"))
    marked = vectors.select("work_id").distinct().withColumn("has", F.lit(True))
    w = works.join(marked, "work_id", "left").join(n, "work_id", "left")
    return w.select("work_id", F.coalesce("has", F.lit(False)).alias("has_vector"), F.coalesce("score_rows", F.lit(0).cast("long")).alias("score_rows"), (F.col("inclusion_status") == "included").alias("embeddable"))


COVERAGE_SQL = """
SELECT work_id, work_id IN (SELECT vec_id FROM embeddings) AS has_vector, coalesce(n, 0) AS score_rows, inclusion_status = 'included' AS embeddable
FROM works LEFT JOIN (SELECT work_id, count(*) AS n FROM work_topics GROUP BY work_id) USING (work_id)"""


def usable_sources(rows: DataFrame, by: str, least_rows: int, least_share: float, condition: Column) -> DataFrame:
    """Sources with enough rows, and a high enough share of rows that meet a condition, best first."""
    g = rows.groupBy(by).agg(F.count(F.lit(1)).alias("rows"), F.round(F.avg(condition.cast("double")), 6).alias("share"))
    return g.withColumn("usable", (F.col("rows") >= least_rows) & (F.col("share") >= least_share)).orderBy(F.desc("usable"), F.desc("rows"), by)


USABLE_SQL = """
SELECT source_slug, count(*) AS rows, round(avg(is_core_corpus::INT::DOUBLE), 6) AS share, count(*) >= 100 AND round(avg(is_core_corpus::INT::DOUBLE), 6) >= 0.4 AS usable FROM included GROUP BY source_slug"""
