"""Every registered query over the corpus, each with its DuckDB counterpart where SQL has one."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from folioscope.functions import numeric, policy, text, vectors
from folioscope.operators import bridges, curation, descent, experiments, labels, lineage, metrics, neighbors, order_stats, ranks, samplers, vector_index
from folioscope.plans import catalog, fulltext, ranking, reports, search
from folioscope.sources import files, plan_checks, upsert
from folioscope.sources.corpus import Corpus, prelude
from folioscope.streaming import ingest

Query = Callable[[Corpus], DataFrame]
_QUERIES: dict[str, Query] = {}
_SQL: dict[str, str] = {}


def query(sql: str | None = None, mapped: bool = False) -> Callable[[Query], Query]:
    """Register a query under its function's name; ``mapped`` puts the entity mapping before its SQL."""

    def add(f: Query) -> Query:
        _QUERIES[f.__name__] = f
        if sql is not None:
            _SQL[f.__name__] = prelude(sql) if mapped else sql
        return f

    return add


# Catalog


@query(catalog.TOPIC_TRENDS_SQL, mapped=True)
def topic_trends(c: Corpus) -> DataFrame:
    return catalog.topic_trends(c, "snap-2001", since_year=2000, min_works=5, limit=20)


@query(catalog.PAPERS_SQL, mapped=True)
def papers_list(c: Corpus) -> DataFrame:
    return catalog.papers(c, 50, "building")


@query(catalog.PAPER_DETAILS_SQL, mapped=True)
def paper_detail(c: Corpus) -> DataFrame:
    return catalog.paper_details(c)


@query(catalog.UNDERCITED_FEED_SQL, mapped=True)
def undercited_feed(c: Corpus) -> DataFrame:
    return catalog.undercited_feed(c, as_of_year=2002, limit=100)


@query(catalog.MISSING_VECTORS_SQL, mapped=True)
def missing_embeddings(c: Corpus) -> DataFrame:
    return catalog.missing_vectors(c, "snap-1998")


@query(catalog.SEARCH_SQL, mapped=True)
def lexical_search(c: Corpus) -> DataFrame:
    return catalog.search_page(c, ["building", "brand#1"], 25, 10, 1996, 2000)


@query(catalog.CLUSTER_SAMPLES_SQL)
def cluster_samples(c: Corpus) -> DataFrame:
    return catalog.cluster_samples(c)


@query(
    """SELECT source_slug, count(*) AS works, count(*) FILTER (WHERE is_core_corpus) AS core, count(*) FILTER (WHERE abstract IS NULL) AS no_abstract,
    count(*) FILTER (WHERE length(trim(title)) = 0) AS no_title, count(DISTINCT venue_id) AS venues FROM included GROUP BY source_slug""",
    mapped=True,
)
def coverage_counters(c: Corpus) -> DataFrame:
    return c.included.groupBy("source_slug").agg(
        F.count(F.lit(1)).alias("works"), F.count_if("is_core_corpus").alias("core"), F.count_if(F.col("abstract").isNull()).alias("no_abstract"),
        F.count_if(F.length(F.trim("title")) == 0).alias("no_title"), F.count_distinct("venue_id").alias("venues"),
    )


# Ranking


@query(ranking.SCORE_VIEW_SQL, mapped=True)
def ranking_scores(c: Corpus) -> DataFrame:
    return ranking.score_view(c)


@query(ranking.RANKED_LIST_SQL, mapped=True)
def ranked_list(c: Corpus) -> DataFrame:
    return ranking.ranked_list(c, ranking.paper_scores(c), "emerging", 50)


@query(ranking.FAMILY_RANKS_SQL, mapped=True)
def paper_family_ranks(c: Corpus) -> DataFrame:
    return ranking.family_ranks(ranking.paper_scores(c), c.included)


@query(ranking.EXPLANATIONS_SQL, mapped=True)
def score_explanations(c: Corpus) -> DataFrame:
    return ranking.explanations(ranking.paper_scores(c))


@query(ranking.EVALUATION_SQL, mapped=True)
def eval_compare_arms(c: Corpus) -> DataFrame:
    return ranking.evaluation_arms(c, ranking.paper_scores(c))


@query(upsert.LATEST_RUNS_SQL)
def latest_run(c: Corpus) -> DataFrame:
    e = c.table("events")
    runs = e.select("user_id", F.col("event_id").alias("run_id"), F.col("ts").alias("finished_at"), F.when(F.col("event_type") == "click", "succeeded").otherwise("failed").alias("status"))
    return upsert.latest_runs(runs, ["user_id"]).select("user_id", "run_id", "finished_at")


# Vectors and bridges


@query(neighbors.SIMILAR_SQL)
def similar_papers(c: Corpus) -> DataFrame:
    found = neighbors.nearest(c.vectors, c.vectors.where("work_id % 100 = 0"), 15)
    return found.select("query_id", "work_id", "nth", F.round("similarity", 4).alias("similarity"))


@query(neighbors.NEIGHBOR_MIX_SQL)
def neighbor_mix(c: Corpus) -> DataFrame:
    return neighbors.neighbor_mix(c.vectors)


@query(neighbors.BOUNDARY_SQL)
def bridge_boundary(c: Corpus) -> DataFrame:
    return neighbors.bridge_boundary(c.vectors).select("work_id", F.round("boundary", 6).alias("boundary"))


@query(neighbors.SLICE_FIT_SQL)
def semantic_slice_fit(c: Corpus) -> DataFrame:
    return neighbors.slice_fit(c.vectors).select("work_id", F.round("fit", 6).alias("fit"))


@query()
def kmeans_clusters(c: Corpus) -> DataFrame:
    return neighbors.kmeans(c.vectors, 12)


def _emerging(c: Corpus) -> DataFrame:
    return c.vectors.select("work_id", (F.col("work_id") * 37 % 101 / 101.0).alias("score"))


@query(bridges.ELIGIBILITY_SQL)
def eligibility_top_half(c: Corpus) -> DataFrame:
    return bridges.eligibility(bridges.bridge_rows(c.vectors)).select("work_id", "bridge_score", F.round("cross_share", 6).alias("cross_share"), "eligible")


@query(bridges.SENSITIVITY_SQL)
def sensitivity_grid(c: Corpus) -> DataFrame:
    return bridges.sensitivity(bridges.eligibility(bridges.bridge_rows(c.vectors)), _emerging(c))


@query(bridges.RESIDUAL_SQL)
def residual_topk(c: Corpus) -> DataFrame:
    return bridges.residual_head(bridges.bridge_rows(c.vectors), _emerging(c), 0.5)


@query(bridges.REDESIGN_SQL)
def redesign_simulation(c: Corpus) -> DataFrame:
    return bridges.redesign(bridges.eligibility(bridges.bridge_rows(c.vectors)), _emerging(c))


@query(bridges.FAILURE_SQL)
def eligibility_failures(c: Corpus) -> DataFrame:
    return bridges.failure_analysis(bridges.sensitivity(bridges.eligibility(bridges.bridge_rows(c.vectors)), _emerging(c)))


@query()
def neighbors_by_index(c: Corpus) -> DataFrame:
    index = vector_index.build_vector_index(c.vectors)
    return vector_index.nearest_by_index(index, c.vectors.where(F.col("work_id") % 100 == 0), 15, vector_index.probes_for(index, 15))


def _head(works: DataFrame, k: int, *order) -> DataFrame:
    head = works.orderBy(*order).limit(k)
    return head.select("work_id", F.row_number().over(W.orderBy(*order)).alias("rank"))


@query(bridges.CHURN_SQL, mapped=True)
def head_churn(c: Corpus) -> DataFrame:
    # the heads are what is compared
    old = _head(c.included, 200, F.desc("citation_count"), F.asc("work_id"))
    return bridges.churn(old, _head(c.included, 200, F.desc("year"), F.desc("citation_count"), F.asc("work_id")), 200)


@query(metrics.RANK_DISPLACEMENT_SQL.replace("WITH r AS", ", r AS"), mapped=True)
def rank_displacement(c: Corpus) -> DataFrame:
    w = c.included.select("work_id", "year", "citation_count")
    old = ranks.numbered(w, [F.desc("citation_count"), F.asc("work_id")])
    return metrics.rank_displacement(old, ranks.numbered(w, [F.desc("year"), F.asc("work_id")]), "work_id")


@query(
    """, t AS (SELECT work_id, list(DISTINCT topic_id) AS ids FROM work_topics GROUP BY work_id), p AS (SELECT a.ids AS a, b.ids AS b, a.work_id FROM t a JOIN t b ON b.work_id = a.work_id + 1)
    SELECT work_id, CAST(len(list_intersect(a, b)) AS INTEGER) AS shared, round(len(list_intersect(a, b)) / (len(a) + len(b) - len(list_intersect(a, b)))::DOUBLE, 6) AS jaccard FROM p""",
    mapped=True,
)
def topic_jaccard(c: Corpus) -> DataFrame:
    t = c.work_topics.groupBy("work_id").agg(F.collect_set("topic_id").alias("a"))
    other = t.select((F.col("work_id") - 1).alias("work_id"), F.col("a").alias("b"))
    return t.join(other, "work_id").select("work_id", bridges.overlap(F.col("a"), F.col("b")).alias("o")).select("work_id", "o.shared", "o.jaccard")


@query(
    """SELECT work_id, cluster_id, round(1 - (r - 1) / greatest(1, n - 1)::DOUBLE, 6) AS ends, round(1 - (r - 0.5) / n::DOUBLE, 6) AS middle FROM (
    SELECT vec_id AS work_id, printf('c%03d', label) AS cluster_id, rank() OVER (PARTITION BY label ORDER BY vec_id % 17 DESC) + (count(*) OVER (PARTITION BY label, vec_id % 17) - 1) / 2.0::DOUBLE AS r, count(*) OVER (PARTITION BY label) AS n FROM embeddings)"""
)
def rank_percentiles(c: Corpus) -> DataFrame:
    v = c.vectors.select("work_id", "cluster_id", (F.col("work_id") % 17).alias("x"))
    p = ranks.percentiles(v, "x", "ends", "middle", ("cluster_id",))
    return p.select("work_id", "cluster_id", F.round("ends", 6).alias("ends"), F.round("middle", 6).alias("middle"))


@query(
    """WITH r AS (SELECT vec_id AS work_id, label, rank() OVER (PARTITION BY label ORDER BY vec_id % 17 DESC) + (count(*) OVER (PARTITION BY label, vec_id % 17) - 1) / 2.0::DOUBLE AS a,
      rank() OVER (PARTITION BY label ORDER BY vec_id % 23 DESC) + (count(*) OVER (PARTITION BY label, vec_id % 23) - 1) / 2.0::DOUBLE AS b, count(*) OVER (PARTITION BY label) AS n FROM embeddings)
    SELECT work_id, round(0.3 * (1 - (a - 0.5) / n) + 0.7 * (1 - (b - 0.5) / n), 6) AS hybrid, round(0.5 * (1 - (a - 1) / greatest(1, n - 1)) + 0.5 * (1 - (b - 1) / greatest(1, n - 1)), 6) AS shadow FROM r"""
)
def hybrid_blend(c: Corpus) -> DataFrame:
    v = c.vectors.select("work_id", "cluster_id", (F.col("work_id") % 17).alias("a"), (F.col("work_id") % 23).alias("b"))
    p = ranks.percentiles(ranks.percentiles(v, "a", "a_ends", "a_middle", ("cluster_id",)), "b", "b_ends", "b_middle", ("cluster_id",))
    return p.select("work_id", F.round(F.expr("0.3D * a_middle + 0.7D * b_middle"), 6).alias("hybrid"), F.round(F.expr("0.5D * a_ends + 0.5D * b_ends"), 6).alias("shadow"))


@query(
    """SELECT o_orderkey AS work_id, round(CASE WHEN mx = mn THEN 0.5 ELSE (o_totalprice - mn) / (mx - mn) END, 6) AS scaled FROM (
    SELECT o_orderkey, o_totalprice, min(o_totalprice) OVER (PARTITION BY o_orderpriority) AS mn, max(o_totalprice) OVER (PARTITION BY o_orderpriority) AS mx FROM orders)"""
)
def min_max_scores(c: Corpus) -> DataFrame:
    return order_stats.min_max(c.table("orders"), "o_totalprice", "scaled", "o_orderpriority").select(F.col("o_orderkey").alias("work_id"), F.round("scaled", 6).alias("scaled"))


@query("SELECT vec_id AS work_id, round(1 / (1 + exp(-(0.25 + (embedding[1]::DOUBLE - 0.1) / 0.2 * 1.5 + (embedding[2]::DOUBLE + 0.1) / 0.3 * -0.7))), 6) AS probability FROM embeddings")
def frozen_scorer(c: Corpus) -> DataFrame:
    p = vectors.logistic_score(F.slice("vector", 1, 2), [0.1, -0.1], [0.2, 0.3], [1.5, -0.7], 0.25)
    return c.vectors.select("work_id", F.round(p, 6).alias("probability"))


# Metrics and labels


@query(metrics.ROC_AUC_SQL)
def roc_auc(c: Corpus) -> DataFrame:
    return metrics.roc_auc(c.labels, "score", "good", "source").withColumn("roc_auc", F.round("roc_auc", 6))


@query(metrics.PRECISION_SQL)
def precision_at_k(c: Corpus) -> DataFrame:
    return metrics.precision_at(c.labels, "score", "good", "doc_id", [5, 20], "source")


@query(metrics.AVERAGE_PRECISION_SQL)
def average_precision(c: Corpus) -> DataFrame:
    return metrics.average_precision(c.labels, "score", "good", "doc_id", "source")


@query(metrics.CONFUSION_SQL)
def confusion_metrics(c: Corpus) -> DataFrame:
    return metrics.confusion(c.labels.withColumn("p", F.col("score") >= 0.5), "p", "good", "source")


@query(metrics.DISTRIBUTION_SQL, mapped=True)
def score_distribution(c: Corpus) -> DataFrame:
    v = c.included.withColumn("c", F.when(F.col("citation_count") % 9 != 0, F.col("citation_count").cast("double")))
    return metrics.distribution(v, "c", "source_slug")


@query(metrics.CORRELATION_SQL, mapped=True)
def signal_correlation(c: Corpus) -> DataFrame:
    return metrics.correlation(c.included, "year", "citation_count", "source_slug")


def _judged_events(c: Corpus) -> DataFrame:
    return c.table("events").withColumn("y", F.when(F.col("event_type").isin("click", "view"), True).when(F.col("event_type") == "error", False))


@query(labels.CONFLICTS_SQL)
def label_conflicts(c: Corpus) -> DataFrame:
    return labels.conflicts(_judged_events(c), "user_id", "y")


@query(labels.VOTES_SQL)
def majority_vote(c: Corpus) -> DataFrame:
    return labels.votes(_judged_events(c), "user_id", "y")


@query(labels.CLASS_BALANCE_SQL)
def class_balance(c: Corpus) -> DataFrame:
    return labels.class_balance(c.labels, ["good", "useful"], "source")


@query(labels.FOLDS_SQL)
def strat_folds(c: Corpus) -> DataFrame:
    return labels.stratified_folds(c.labels.select("doc_id", "good"), "good", "doc_id", 5)


@query(labels.IMPUTE_SQL)
def impute_zscore(c: Corpus) -> DataFrame:
    folds = labels.stratified_folds(c.labels.select("doc_id", "good", F.when(F.col("doc_id") % 7 != 0, F.col("n_chars").cast("double")).alias("v")), "good", "doc_id", 5)
    return labels.impute_and_scale(folds, "v", "fold", 5).select("doc_id", "fold", "z")


@query()
def logistic_gd(c: Corpus) -> DataFrame:
    d = labels.stratified_folds(c.labels.select("doc_id", "good", (F.col("n_chars") / 1000.0).alias("x"), F.col("good").cast("double").alias("y")), "good", "doc_id", 5)
    return descent.optimum(d, ["x"], "y", "fold")


@query(
    """WITH m AS (SELECT count(*) AS n, avg((quality = 1)::INT::DOUBLE) AS good, avg((toxic = 1)::INT::DOUBLE) AS toxic FROM labels), g AS (
    SELECT * FROM (SELECT 'enough_rows' AS gate, n::DOUBLE AS observed, 100.0::DOUBLE AS threshold, n >= 100 AS ok FROM m UNION ALL SELECT 'good_share', good, 0.9, good >= 0.9 FROM m UNION ALL SELECT 'toxic_share', toxic, 0.2, toxic <= 0.2 FROM m))
    SELECT gate, round(observed, 6) AS observed, threshold::DOUBLE AS threshold, CASE WHEN observed IS NULL THEN 'missing' WHEN ok THEN 'pass' ELSE 'fail' END AS status FROM g"""
)
def metric_gates(c: Corpus) -> DataFrame:
    y = c.table("labels")
    m = y.agg(F.count(F.lit(1)).alias("n"), F.avg((F.col("quality") == 1).cast("double")).alias("good"), F.avg((F.col("toxic") == 1).cast("double")).alias("toxic"))
    return labels.gates(m, [("enough_rows", "n", ">=", 100), ("good_share", "good", ">=", 0.9), ("toxic_share", "toxic", "<=", 0.2)]).withColumn("observed", F.round("observed", 6))


@query(samplers.BUDGET_SQL)
def budget_sample(c: Corpus) -> DataFrame:
    d = c.table("labels").join(c.table("documents").select("doc_id", "source", "n_chars"), "doc_id").withColumn("size", F.floor(F.col("n_chars") / 1000))
    budgets = [samplers.Budget("good-by-source", 0.8, ("source",), F.col("quality") == 1), samplers.Budget("rest-by-size", 0.2, ("size",))]
    return samplers.sample_with_budgets(d, "doc_id", "blind-1", 100, budgets).select("doc_id", "bucket", "nth")


@query()
def hash_sample(c: Corpus) -> DataFrame:
    return labels.sample_by_hash(c.labels, "doc_id", "review-1", 5, "source").select("doc_id", "source", "nth")


@query(
    """WITH l AS (SELECT doc_id, quality = 1 AS good, toxic = 1 AS tox, n_chars FROM labels JOIN documents USING (doc_id)), a AS (SELECT * FROM l WHERE tox ORDER BY n_chars, doc_id LIMIT 10),
    b AS (SELECT * FROM l WHERE NOT good AND doc_id NOT IN (SELECT doc_id FROM a) ORDER BY n_chars, doc_id LIMIT 10), d AS (SELECT * FROM l WHERE doc_id NOT IN (SELECT doc_id FROM a) AND doc_id NOT IN (SELECT doc_id FROM b) ORDER BY n_chars, doc_id LIMIT 10)
    SELECT doc_id, 'toxic' AS bucket FROM a UNION ALL SELECT doc_id, 'poor' FROM b UNION ALL SELECT doc_id, 'rest' FROM d"""
)
def review_buckets(c: Corpus) -> DataFrame:
    order = F.col("n_chars")
    buckets = [("toxic", ~F.col("useful"), order, 10), ("poor", ~F.col("good"), order, 10), ("rest", F.lit(True), order, 10)]
    return labels.first_bucket(c.labels, "doc_id", buckets).select("doc_id", "bucket")


# Text and policy


@query(
    """SELECT page_id, upper(nullif(regexp_extract(url, '(?i)(/[a-z]{2}/)', 1), '')) AS part, CASE WHEN length(t) > 80 THEN rtrim(substr(t, 1, 79)) || '...' ELSE t END AS preview,
    sha256(coalesce(url, '') || chr(9) || page_id) AS id FROM (SELECT *, trim(regexp_replace(html, '\\s+', ' ', 'g')) AS t FROM pages)"""
)
def page_keys(c: Corpus) -> DataFrame:
    p = c.table("pages")
    part = F.nullif(F.upper(F.regexp_extract("url", "(?i)(/[a-z]{2}/)", 1)), F.lit(""))
    return p.select("page_id", part.alias("part"), text.preview(F.col("html"), 80).alias("preview"), text.stable_id(F.col("url"), F.col("page_id")).alias("id"))


@query()
def text_clean(c: Corpus) -> DataFrame:
    return c.table("pages").select("page_id", text.cleaned(F.regexp_extract("html", "<title>(.*?)</title>", 1)).alias("title"))


@query(
    """WITH w AS (SELECT source, unnest(regexp_extract_all(lower(text), '[\\p{L}\\p{N}]+')) AS term FROM documents), n AS (SELECT source, term, count(*) AS n FROM w WHERE length(term) >= 3 AND term NOT IN ('a','an','and','are','as','at','be','by','for','from','in','into','is','it','of','on','or','that','the','to','with','we','this','these','those','their','our','using','use','via','study','analysis') GROUP BY source, term)
    SELECT source, term, n, CAST(nth AS INTEGER) AS nth FROM (SELECT *, row_number() OVER (PARTITION BY source ORDER BY n DESC, term) AS nth FROM n) WHERE nth <= 12"""
)
def cluster_terms(c: Corpus) -> DataFrame:
    each = c.table("documents").select("source", F.explode(text.terms(F.col("text"))).alias("term"))
    counted = each.groupBy("source", "term").agg(F.count(F.lit(1)).alias("n"))
    nth = F.row_number().over(W.partitionBy("source").orderBy(F.desc("n"), "term"))
    return counted.withColumn("nth", nth).where("nth <= 12")


_POLICY = policy.Policy(
    min_year=1996, language="en", types=("o", "f"), exclusion_terms=("furniture no 1",), strong_terms=("building", "household"), edge_terms=("machinery",),
    sources={"building": "core", "household": "core", "machinery": "edge"},
)


@query(
    """, w AS (SELECT work_id, year, lower(o_orderstatus) AS kind, abstract, source_slug, lower(title || ' ' || coalesce(abstract, '')) AS t, work_id % 13 = 0 AS retracted, work_id % 5 = 0 AS curated FROM works JOIN orders ON o_orderkey = work_id)
    SELECT work_id, CASE WHEN year < 1996 THEN 'before_year_floor' WHEN kind NOT IN ('o', 'f') THEN 'document_type_excluded' WHEN retracted THEN 'retracted' WHEN abstract IS NULL THEN 'missing_abstract'
      WHEN contains(t, 'furniture no 1') THEN 'explicit_exclusion_term'
      WHEN source_slug NOT IN ('building', 'household', 'machinery') THEN CASE WHEN (contains(t, 'building') OR contains(t, 'household')) AND curated THEN 'curated_edge_allowlist' ELSE 'source_not_allowed' END
      WHEN NOT contains(t, 'building') AND NOT contains(t, 'household') THEN CASE WHEN contains(t, 'machinery') THEN 'edge_term_without_core_signal' ELSE 'topic_gate_failed' END
      ELSE 'core_source_topic_match' END AS reason FROM w""",
    mapped=True,
)
def policy_decision(c: Corpus) -> DataFrame:
    w = c.works.join(c.table("orders").select(F.col("o_orderkey").alias("work_id"), F.lower("o_orderstatus").alias("kind")), "work_id")
    d = policy.decide(
        _POLICY, policy.blob("title", "abstract"), F.col("year"), F.lit("EN"), F.col("kind"), F.col("work_id") % 13 == 0, F.col("abstract"), F.col("source_slug"),
        F.col("work_id") % 5 == 0, F.lit(False),
    )
    return w.select("work_id", d["reason"].alias("reason"))


_NOISE = (policy.NoiseRule("noise_furniture", ("furniture",), ("no 2", "no 3")), policy.NoiseRule("noise_machinery", ("machinery",), ("no 4",)))
_BUCKET = policy.Bucket("automobiles", (("automobile",), ("no 5", "no 6", "no 7")), deferred=False)


@query(
    """, w AS (SELECT work_id, year, lower(title || ' ' || coalesce(abstract, '')) AS t FROM works), s AS (SELECT *, contains(t, 'building') OR contains(t, 'household') OR contains(t, 'machinery') AS strong,
      contains(t, 'automobile') AND (contains(t, 'no 5') OR contains(t, 'no 6') OR contains(t, 'no 7')) AS allowed FROM w)
    SELECT work_id, CASE WHEN year < 1996 THEN 'before_year_floor' WHEN contains(t, 'furniture no 1') THEN 'explicit_exclusion_term' WHEN contains(t, 'furniture') AND NOT (contains(t, 'no 2') OR contains(t, 'no 3')) THEN 'noise_furniture'
      WHEN contains(t, 'machinery') AND NOT contains(t, 'no 4') THEN 'noise_machinery' WHEN NOT strong AND NOT allowed THEN 'no_strong_topic_or_bucket_allow_signal' WHEN strong AND allowed THEN 'strong_topic_and_bucket_allow'
      WHEN strong THEN 'strong_topic_signal' ELSE 'bucket_allow_signal' END AS reason FROM s""",
    mapped=True,
)
def candidate_plan(c: Corpus) -> DataFrame:
    base = F.when(F.col("year") < 1996, "before_year_floor")
    d = policy.plan_candidate(_POLICY, _NOISE, _BUCKET, policy.blob("title", "abstract"), base)
    return c.works.select("work_id", d["reason"].alias("reason"))


@query()
def dedup_keys(c: Corpus) -> DataFrame:
    t = c.texts.select("paper_id", F.nullif(text.title_key(F.col("title")), F.lit("")).alias("title_key"), F.nullif(F.sha2("abstract", 256), F.sha2(F.lit(""), 256)).alias("abstract_key"))
    return labels.sequential_dedup(t, "paper_id", ["title_key", "abstract_key"]).select("paper_id", "dropped_by")


@query("SELECT item_id, w AS word, array_to_string(list_sort(list(p)), ',') AS positions FROM (SELECT item_id, unnest(string_split(t, ' ')) AS w, unnest(range(len(string_split(t, ' ')))) AS p FROM (SELECT item_id, trim(regexp_replace(text, '\\s+', ' ', 'g')) AS t FROM benchmark)) WHERE w <> '' GROUP BY item_id, w")
def inverted_index(c: Corpus) -> DataFrame:
    p = text.positions_of_text(c.table("benchmark"), "item_id", "text")
    return p.withColumn("positions", F.array_join(F.col("positions").cast("array<string>"), ","))


# Stored tables


@query(upsert.COMPOSE_SQL, mapped=True)
def compose_snapshot(c: Corpus) -> DataFrame:
    return upsert.compose(c.memberships, ["snap-1997", "snap-1996", "snap-1999"], "composed")


@query(upsert.UPSERT_SQL)
def upsert_latest(c: Corpus) -> DataFrame:
    e = c.table("events").select("user_id", "event_type", "value", "event_id")
    stored = upsert.latest(e.where("event_id % 2 = 0"), ["user_id", "event_type"], "event_id")
    return upsert.upsert(stored, e.where("event_id % 2 = 1"), ["user_id", "event_type"], "event_id", sticky=("event_id",))


@query(
    """, e AS (SELECT DISTINCT 'W' || l_orderkey AS a, 'W' || (l_partkey * 3) AS b FROM lineitem)
    SELECT x.work_id AS citing_id, y.work_id AS cited_id FROM e JOIN works x ON x.paper_id = a JOIN works y ON y.paper_id = b""",
    mapped=True,
)
def citation_edges(c: Corpus) -> DataFrame:
    lines = c.table("lineitem")
    edges = lines.select(F.concat(F.lit("W"), F.col("l_orderkey").cast("string")).alias("citing"), F.concat(F.lit("W"), (F.col("l_partkey") * 3).cast("string")).alias("cited"))
    return upsert.resolve_edges(edges, c.works)


@query("SELECT event_type AS source_slug, max(ts) AS updated_until, count(*) AS works FROM events GROUP BY event_type")
def ingest_watermarks(c: Corpus) -> DataFrame:
    return ingest.watermarks(c.table("events").select(F.col("event_type").alias("source_slug"), F.col("ts").alias("updated_date")))


@query("SELECT date_trunc('day', ts)::TIMESTAMP AS day, event_type, count(*) AS n, round(sum(value), 2) AS total FROM events GROUP BY 1, 2")
def windowed_events(c: Corpus) -> DataFrame:
    return ingest.windowed_counts(c.table("events"))


@query("SELECT event_type AS bucket, count(*) AS rows, array_to_string(list_sort(list(event_id::VARCHAR) FILTER (WHERE nth <= 5)), '|') AS first_keys FROM (SELECT *, row_number() OVER (PARTITION BY event_type ORDER BY event_id) AS nth FROM events) GROUP BY event_type")
def bucket_coverage(c: Corpus) -> DataFrame:
    return files.bucket_coverage(c.table("events").withColumnRenamed("event_type", "bucket"), "bucket", "event_id", 5)


# Reports and experiments


@query(reports.CLUSTER_INSPECTION_SQL, mapped=True)
def cluster_inspection(c: Corpus) -> DataFrame:
    return reports.cluster_inspection(c.vectors.select("work_id", "cluster_id"), c.works)


def _sheet(c: Corpus) -> DataFrame:
    k = F.col("o_orderkey")
    relevance = F.when(k % 5 == 0, "good").when(k % 5 == 1, "acceptable").when(k % 5 == 2, "miss").when(k % 5 == 3, "irrelevant")
    novelty = F.when(k % 3 == 0, "surprising").when(k % 3 == 1, "obvious").otherwise("useful")
    bridge = F.when(k % 7 == 0, "not_applicable").when(k % 7 == 1, "yes").when(k % 7 == 2, "partial").otherwise("no")
    return c.table("orders").select(F.col("o_orderpriority").alias("family"), relevance.alias("relevance_label"), novelty.alias("novelty_label"), bridge.alias("bridge_like_label"))


@query(reports.REVIEW_SUMMARY_SQL)
def review_summary(c: Corpus) -> DataFrame:
    return reports.review_summary(_sheet(c), "family")


@query(reports.PAIRWISE_SQL)
def review_deltas(c: Corpus) -> DataFrame:
    return reports.pairwise_deltas(reports.review_summary(_sheet(c), "family"), "family", "good_or_acceptable")


@query(
    bridges.BRIDGE_CTE
    + """, cut AS (SELECT bridge_score AS cutoff FROM (SELECT bridge_score, row_number() OVER (ORDER BY bridge_score DESC) AS rn, count(*) OVER () AS n FROM rows_ WHERE bridge_score IS NOT NULL) WHERE rn = greatest(1, (n + 1) // 2)),
    el AS (SELECT work_id, bridge_score FROM rows_, cut WHERE n >= 15 AND bridge_score >= cutoff AND cross_share >= 0.4),
    h AS (SELECT (SELECT list(work_id ORDER BY work_id) FROM (SELECT work_id FROM rows_ ORDER BY bridge_score DESC, work_id LIMIT 20)) AS f, (SELECT list(work_id ORDER BY work_id) FROM (SELECT work_id FROM el ORDER BY bridge_score DESC, work_id LIMIT 20)) AS e,
      (SELECT list(work_id ORDER BY work_id) FROM (SELECT work_id FROM em ORDER BY score DESC, work_id LIMIT 20)) AS m),
    j AS (SELECT f <> coalesce(e, []) AS differs, len(list_intersect(f, e)) AS fe, round(len(list_intersect(f, e)) / len(list_distinct(list_concat(f, e)))::DOUBLE, 6) AS jfe, round(len(list_intersect(f, m)) / len(list_distinct(list_concat(f, m)))::DOUBLE, 6) AS jfm,
      round(len(list_intersect(coalesce(e, []), m)) / len(list_distinct(list_concat(e, m)))::DOUBLE, 6) AS jem FROM h)
    SELECT CAST(coalesce(fe, 0) AS INTEGER) AS full_eligible_shared, coalesce(jfe, 0) AS full_eligible_jaccard, jfm AS full_emerging_jaccard, jem AS eligible_emerging_jaccard, differs, jem < jfm AS less_emerging_like,
      CASE WHEN NOT differs OR jfe >= 1 THEN 'eligible_filter_not_distinct_enough' WHEN jem < jfm THEN 'candidate_for_small_weight_experiment' ELSE 'inspect_cluster_quality_first' END AS suggested_step FROM j"""
)
def distinctness(c: Corpus) -> DataFrame:
    rows = bridges.eligibility(bridges.bridge_rows(c.vectors))
    full = bridges.head_ids(rows, "bridge_score", "work_id", 20)
    eligible = bridges.head_ids(rows.where("eligible"), "bridge_score", "work_id", 20)
    return reports.distinctness(full, eligible, bridges.head_ids(_emerging(c), "score", "work_id", 20), True, 1)


@query(reports.COVERAGE_SQL, mapped=True)
def coverage_by_rank(c: Corpus) -> DataFrame:
    ranked = ranks.numbered(c.included.select("work_id", "citation_count", "is_core_corpus"), [F.desc("citation_count"), F.asc("work_id")])
    return reports.coverage_by_bucket(ranked, "is_core_corpus", [10, 50, 200])


@query(reports.PARITY_SQL)
def key_parity(c: Corpus) -> DataFrame:
    return reports.key_parity(c.table("labels").select("doc_id"), c.vectors.select(F.col("work_id").alias("doc_id")), "doc_id")


@query(reports.HYDRATED_SQL, mapped=True)
def hydrate_works(c: Corpus) -> DataFrame:
    w = F.col("work_id")
    payload = c.works.where(w % 5 != 4).select("work_id", F.when(w % 3 == 0, " ").when(w % 3 == 1, "New title").alias("title"), F.when(w % 2 == 0, "Filled").alias("abstract"))
    return reports.hydrated(c.works.select("work_id", "title", "abstract"), payload, "work_id", ["title", "abstract"])


@query(reports.TREND_SQL, mapped=True)
def response_trend(c: Corpus) -> DataFrame:
    m = c.included.where("year >= 1999").groupBy("source_slug", "year").agg(F.round(F.avg("citation_count"), 0).alias("y"))
    return reports.response_trend(m, "year", "y", "source_slug")


@query(search.SEARCH_SQL)
def text_search(c: Corpus) -> DataFrame:
    return search.search(c.texts, "paper_id", ["the", "with"], none_of=["idiot"])


@query()
def search_fragments(c: Corpus) -> DataFrame:
    found = search.search(c.texts, "paper_id", ["the", "with"])
    return c.texts.join(found, "paper_id").select("paper_id", "rank", search.fragments(["the", "with"])(F.col("abstract")).alias("fragments"))


@query(fulltext.RANK_SQL)
def fulltext_rank(c: Corpus) -> DataFrame:
    return fulltext.ranked(fulltext.build_index(c.texts, "paper_id"), fulltext.ASKED)[0]


@query()
def fulltext_headlines(c: Corpus) -> DataFrame:
    return fulltext.headlines(fulltext.build_index(c.texts, "paper_id"), c.texts, fulltext.ASKED, limit=50)


@query(experiments.MOVES_SQL, mapped=True)
def rank_moves(c: Corpus) -> DataFrame:
    a, b = [F.desc("citation_count"), F.asc("work_id")], [F.desc("year"), F.desc("citation_count"), F.asc("work_id")]
    old = c.included.orderBy(*a).limit(100).select("work_id", F.row_number().over(W.orderBy(*a)).alias("o"))
    new = c.included.orderBy(*b).limit(100).select("work_id", F.row_number().over(W.orderBy(*b)).alias("n"))
    y = F.when(F.col("work_id") % 3 != 0, F.col("is_core_corpus"))
    both = old.join(new, "work_id", "full_outer").join(c.included.select("work_id", y.alias("y")), "work_id").fillna(101, ["o", "n"])
    return experiments.moves(both, "o", "n", "y", 100)


def _training(c: Corpus) -> DataFrame:
    d = c.labels.select("doc_id", "source", F.col("good").cast("double").alias("label"), F.log1p("n_chars").alias("length"), "score")
    return experiments.grouped_folds(d, "doc_id", "label", 3, "folds")


@query()
def out_of_fold_scores(c: Corpus) -> DataFrame:
    return experiments.out_of_fold(_training(c), experiments.scorer(["length", "score"], ["source"]), 3).select("doc_id", "fold", "label", F.round("probability", 4).alias("probability"))


@query()
def strength_sweep(c: Corpus) -> DataFrame:
    return experiments.strength_sweep(_training(c), ["length", "score"], [0.001, 0.1], 3)


@query(
    """WITH h AS (SELECT l.doc_id, quality = 1 AS good, min(l.doc_id) OVER (PARTITION BY md5(text)) AS group_id, count(*) OVER (PARTITION BY md5(text)) AS group_size FROM labels l JOIN documents USING (doc_id))
    SELECT doc_id, group_id, group_size, CASE WHEN group_id % 4 = 0 THEN 'eval' ELSE 'train' END AS split FROM h"""
)
def holdout_groups(c: Corpus) -> DataFrame:
    t = c.table("labels").join(c.table("documents").select("doc_id", F.md5("text").alias("work")), "doc_id").select("doc_id", "work")
    g = experiments.canonical_groups(t, "work", "doc_id")
    return experiments.holdout(g, g.where("group_id % 4 = 0").select("work"), "work").select("doc_id", "group_id", "group_size", "split")


# Curation


@query(curation.READINESS_SQL, mapped=True)
def readiness_blockers(c: Corpus) -> DataFrame:
    k = F.col("work_id")
    w = c.included.withColumn("type", F.when(k % 17 == 0, "Unknown").when(k % 19 != 0, "article")).withColumn("language", F.when(k % 23 != 0, "en"))
    return curation.readiness(w, "source_slug")


@query(curation.FEATURE_SUMMARY_SQL, mapped=True)
def feature_summary(c: Corpus) -> DataFrame:
    return curation.feature_summary(c.included, ["year", "citation_count"], "source_slug")


@query(curation.COVERAGE_SQL, mapped=True)
def feature_coverage(c: Corpus) -> DataFrame:
    return curation.feature_coverage(c.works, c.vectors, c.work_topics)


@query(curation.USABLE_SQL, mapped=True)
def usable_sources(c: Corpus) -> DataFrame:
    return curation.usable_sources(c.included, "source_slug", 100, 0.4, F.col("is_core_corpus"))


@query(
    """WITH r AS (SELECT vec_id AS work_id, (vec_id * 7 % 100) / 100.0::DOUBLE AS f, (vec_id * 13 % 100) / 100.0::DOUBLE AS x FROM embeddings), p AS (SELECT *, 1 - (rank() OVER (ORDER BY f DESC) + (count(*) OVER (PARTITION BY f) - 1) / 2.0::DOUBLE - 1) / (count(*) OVER () - 1) AS fp,
      1 - (rank() OVER (ORDER BY x DESC) + (count(*) OVER (PARTITION BY x) - 1) / 2.0::DOUBLE - 1) / (count(*) OVER () - 1) AS xp FROM r)
    SELECT work_id, arm, round(score, 6) AS score FROM (SELECT work_id, 'heuristic_final_score_baseline' AS arm, f AS score FROM p UNION ALL SELECT work_id, 'holdout_embedding_probability_baseline', x FROM p UNION ALL SELECT work_id, 'hybrid_rank_mean_50_50', 0.5 * fp + 0.5 * xp FROM p
      UNION ALL SELECT work_id, 'hybrid_rank_mean_75_25_heuristic', 0.75 * fp + 0.25 * xp FROM p UNION ALL SELECT work_id, 'hybrid_rank_mean_25_75_heuristic', 0.25 * fp + 0.75 * xp FROM p)"""
)
def scoring_arms(c: Corpus) -> DataFrame:
    r = c.vectors.select("work_id", (F.col("work_id") * 7 % 100 / 100.0).alias("f"), (F.col("work_id") * 13 % 100 / 100.0).alias("x"))
    p = ranks.percentiles(ranks.percentiles(r, "f", "fp", "f_middle"), "x", "xp", "x_middle")
    return curation.scoring_arms(p, "work_id", "f", "x", "fp", "xp").withColumn("score", F.round("score", 6))


@query()
def neighbor_mix_payloads(c: Corpus) -> DataFrame:
    return curation.mix_payload(neighbors.neighbor_mix(c.vectors), 15)


@query()
def text_repair(c: Corpus) -> DataFrame:
    return curation.repair_counts(curation.repaired(c.table("pages").select("page_id", F.regexp_extract("html", "<title>(.*?)</title>", 1).alias("title")), ["title"]))


@query(
    """WITH b AS (SELECT paper_id, CASE WHEN y IS NULL THEN 'year_missing' WHEN y <= 2018 THEN 'year_le_2018' WHEN y <= 2020 THEN 'year_2019_2020' WHEN y <= 2022 THEN 'year_2021_2022' WHEN y <= 2024 THEN 'year_2023_2024' ELSE 'year_ge_2025' END AS year_band,
      CASE WHEN n <= 0 THEN 'cite_0' WHEN n <= 9 THEN 'cite_1_9' WHEN n <= 49 THEN 'cite_10_49' WHEN n <= 199 THEN 'cite_50_199' ELSE 'cite_ge_200' END AS citation_band
      FROM (SELECT doc_id AS paper_id, CASE WHEN doc_id % 9 <> 0 THEN 2015 + doc_id % 12 END AS y, n_chars % 300 AS n FROM documents))
    SELECT year_band, citation_band, count(*) AS papers FROM b GROUP BY 1, 2"""
)
def sampling_bands(c: Corpus) -> DataFrame:
    d = c.table("documents").select(F.when(F.col("doc_id") % 9 != 0, 2015 + F.col("doc_id") % 12).alias("y"), (F.col("n_chars") % 300).alias("n"))
    return d.groupBy(text.year_band(F.col("y")).alias("year_band"), text.citation_band(F.col("n")).alias("citation_band")).agg(F.count(F.lit(1)).alias("papers"))


# Keys, hashes and keyed changes


_FOLDED = "replace(lower({0}), 'ß', 'ss')"
_COLLAPSED = "trim(regexp_replace({0}, '[ \\t\\n\\x0B\\f\\r\\x{{85}}\\x{{A0}}\\x{{1680}}\\x{{2000}}-\\x{{200A}}\\x{{2028}}\\x{{2029}}\\x{{202F}}\\x{{205F}}\\x{{3000}}]+', ' ', 'g'))"


def _identity_sql() -> str:
    doi = "trim(CASE doc_id % 3 WHEN 0 THEN 'https://doi.org/' WHEN 1 THEN ' HTTP://DOI.ORG/' ELSE '' END || CASE WHEN doc_id % 7 = 0 THEN '' ELSE '10.5/' || substr(text, 1, 12) END)"
    collapsed = _COLLAPSED.format("coalesce(text, '')")
    shown = f"CASE WHEN length({collapsed}) > 240 THEN rtrim(substr({collapsed}, 1, 239)) || '...' ELSE {collapsed} END"
    return f"""SELECT doc_id, nullif(regexp_replace({_FOLDED.format(doi)}, '^(https?://doi\\.org/)+', ''), '') AS doi_key, substr({_COLLAPSED.format(_FOLDED.format("coalesce(text, '')"))}, 1, 280) AS title_key,
  CASE WHEN doc_id % 2 = 0 THEN 'W' || doc_id END AS token, CASE WHEN {collapsed} <> '' THEN starts_with({_FOLDED.format(collapsed)}, substr({_FOLDED.format(shown)}, 1, 80)) END AS same FROM documents"""


@query(_identity_sql())
def identity_keys(c: Corpus) -> DataFrame:
    n = F.col("doc_id")
    doi = F.concat(F.when(n % 3 == 0, "https://doi.org/").when(n % 3 == 1, " HTTP://DOI.ORG/").otherwise(""), F.when(n % 7 == 0, "").otherwise(F.concat(F.lit("10.5/"), F.substring("text", 1, 12))))
    token = text.work_token(F.when(n % 2 == 0, F.concat(F.lit("https://works/w"), n)).otherwise("none"))
    return c.table("documents").select("doc_id", text.doi_key(doi).alias("doi_key"), text.title_key(F.col("text")).alias("title_key"), token.alias("token"), text.prefix_match(text.preview(F.col("text")), F.col("text")).alias("same"))


@query(f"SELECT item_id, {_COLLAPSED.format('text')} AS text FROM benchmark WHERE {_COLLAPSED.format('text')} <> ''")
def text_rebuilt(c: Corpus) -> DataFrame:
    index = text.positions_of_text(c.table("benchmark"), "item_id", "text")
    maps = index.groupBy("item_id").agg(F.map_from_entries(F.collect_list(F.struct("word", "positions"))).alias("index"))
    return maps.select("item_id", text.text_from_positions(F.col("index")).alias("text"))


@query("SELECT source_slug, sha256(string_agg(DISTINCT CAST(work_id AS VARCHAR), chr(10) ORDER BY CAST(work_id AS VARCHAR)) || chr(10)) AS set_hash FROM included GROUP BY source_slug", mapped=True)
def work_set_hashes(c: Corpus) -> DataFrame:
    return c.included.groupBy("source_slug").agg(text.set_hash(F.col("work_id").cast("string")).alias("set_hash"))


_STORED_SQL = "s AS (SELECT o_orderkey AS k, o_orderstatus AS a, CASE WHEN o_orderkey % 3 <> 0 THEN o_orderpriority END AS b FROM orders WHERE o_orderkey % 5 <> 0), n AS (SELECT o_orderkey AS k, CASE WHEN o_orderkey % 2 = 0 THEN 'new' END AS a, CASE WHEN o_orderkey % 4 = 0 THEN 'clerk' END AS b FROM orders WHERE o_orderkey % 3 = 0)"


def _keyed(c: Corpus) -> tuple[DataFrame, DataFrame]:
    o, k = c.table("orders"), F.col("o_orderkey")
    old = o.where(k % 5 != 0).select(k.alias("k"), F.col("o_orderstatus").alias("a"), F.when(k % 3 != 0, F.col("o_orderpriority")).alias("b"))
    return old, o.where(k % 3 == 0).select(k.alias("k"), F.when(k % 2 == 0, "new").alias("a"), F.when(k % 4 == 0, "clerk").alias("b"))


@query(f"WITH {_STORED_SQL} SELECT k, coalesce(n.a, s.a) AS a, coalesce(n.b, s.b) AS b FROM s FULL JOIN n USING (k)")
def upsert_keeping_values(c: Corpus) -> DataFrame:
    return upsert.upsert_coalesce(*_keyed(c), ["k"])


@query(f"WITH {_STORED_SQL} SELECT * FROM s UNION ALL SELECT * FROM n WHERE k NOT IN (SELECT k FROM s)")
def insert_if_absent(c: Corpus) -> DataFrame:
    return upsert.insert_absent(*_keyed(c), ["k"])


@query(f"WITH {_STORED_SQL} SELECT * FROM s WHERE k NOT IN (SELECT k FROM n)")
def delete_joined(c: Corpus) -> DataFrame:
    old, new = _keyed(c)
    return upsert.delete_where_joined(old, new, ["k"])


@query("SELECT l_orderkey AS citing, l_partkey AS cited FROM lineitem WHERE l_orderkey % 4 <> 0 UNION ALL SELECT l_orderkey, l_suppkey FROM lineitem WHERE l_orderkey % 4 = 0 AND l_linenumber <= 2")
def edge_rewrite(c: Corpus) -> DataFrame:
    lines = c.table("lineitem")
    old, new = lines.select(F.col("l_orderkey").alias("citing"), F.col("l_partkey").alias("cited")), lines.where("l_linenumber <= 2").select(F.col("l_orderkey").alias("citing"), F.col("l_suppkey").alias("cited"))
    return upsert.rewrite_edges(old, new, "citing", c.table("orders").where("o_orderkey % 4 = 0").select(F.col("o_orderkey").alias("citing")))


@query(
    """WITH r AS (SELECT event_id, 'run-' || user_id % 3 AS run, CASE WHEN event_id % 4 = 0 THEN 'train' ELSE 'audit_only' END AS split, CASE WHEN event_id % 11 <> 0 THEN 'row-' || user_id END AS row_id FROM events)
    SELECT event_id, row_id FROM (SELECT *, row_number() OVER (PARTITION BY row_id ORDER BY event_id) AS nth FROM r WHERE split = 'audit_only' AND run = 'run-1') WHERE nth = 1 OR row_id IS NULL"""
)
def audit_split(c: Corpus) -> DataFrame:
    e, n = c.table("events"), F.col("event_id")
    rows = e.select("event_id", F.concat(F.lit("run-"), F.col("user_id") % 3).alias("ranking_run_id"), F.when(n % 4 == 0, "train").otherwise("audit_only").alias("split"), F.when(n % 11 != 0, F.concat(F.lit("row-"), F.col("user_id"))).alias("row_id"))
    return curation.audit_rows(rows, "run-1", "row_id", "event_id")[0].select("event_id", "row_id")


# Versions of labels, candidate plans, scores of families


def _label_versions(c: Corpus) -> DataFrame:
    """Five versions of the labels, each with the rows of the one before, but for a few that it loses or alters."""
    v = c.table("labels").withColumn("version", F.explode(F.sequence(F.lit(1).cast("long"), F.lit(5).cast("long"))))
    kept = v.where((F.col("doc_id") % 5 < F.col("version")) & ~((F.col("doc_id") % 41 == 0) & (F.col("version") == 4)))
    return kept.withColumn("toxic", F.when((F.col("doc_id") % 37 == 0) & (F.col("version") >= 3), 1 - F.col("toxic")).otherwise(F.col("toxic")))


@query(lineage.CHAIN_SQL)
def label_chain(c: Corpus) -> DataFrame:
    return lineage.chain(_label_versions(c), "version", ["doc_id", "quality", "toxic"])


@query(lineage.FAULTS_SQL)
def label_faults(c: Corpus) -> DataFrame:
    return lineage.faults(_label_versions(c), "version", "doc_id", ["doc_id", "quality", "toxic"])


@query(plan_checks.VIOLATIONS_SQL)
def plan_violations(c: Corpus) -> DataFrame:
    """A plan of each customer's orders, some of them damaged."""
    k, w = F.col("o_custkey"), F.col("o_orderkey")
    year = F.year("o_orderdate")
    late = w % 19 == 0
    row = F.struct(
        w.alias("w"), F.concat(F.lit("W"), w.cast("string")).alias("openalex_id"), F.when(w % 17 == 0, " ").otherwise(F.col("o_orderpriority")).alias("title"),
        F.when(~late, year).alias("year"), F.when(late, year.cast("string")).alias("publication_year"),
    )
    each = c.table("orders").groupBy("o_custkey").agg(F.array_sort(F.collect_list(row)).alias("rows"))
    plan = F.struct(
        (F.size("rows") + F.when(k % 11 == 0, 1).otherwise(0)).alias("selected_total"), F.lit(5).alias("target_min"), F.lit(25).alias("target_max"),
        F.when(k % 13 == 0, "none").otherwise("api_key").alias("auth_mode"), F.lit(True).alias("api_key_provided"), F.when(k % 23 == 0, "x").alias("service_api_key"),
        F.array(F.lit("Dry-run only"), F.lit("no database writes")).alias("caveats"), F.transform("rows", lambda r: r.dropFields("w")).alias("selected_candidates"),
    )
    body = F.to_json(plan)
    half = F.when(k % 7 == 0, F.expr("left(body, length(body) div 2)")).otherwise(F.col("body"))
    plans = each.withColumn("body", body).select(k.alias("plan_id"), half.alias("body"))
    return plan_checks.violations(plans, "plan_id", "body")


@query(ranking.SCORES_CTE + metrics.FAMILY_CONTEXT_SQL, mapped=True)
def family_context(c: Corpus) -> DataFrame:
    scores = ranking.paper_scores(c).select("work_id", "family", "final_score")
    labelled = c.included.select("work_id", F.when(F.col("work_id") % 3 != 0, F.col("is_core_corpus")).alias("core"), (F.col("citation_count") >= 4).alias("cited"))
    # one join: scores come with their ranks, labels with their works
    placed = ranking.family_ranks(scores, labelled, ("final_score",), ("core", "cited"))
    return metrics.family_context(placed, "family", "final_score", "rank", ["core", "cited"]).withColumn("roc_auc", F.round("roc_auc", 6))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {name: (lambda spark, sf_dir, f=f: f(Corpus(spark, sf_dir))) for name, f in _QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    return dict(_SQL)


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scores of every candidate work in every family."""
    return ranking.paper_scores(Corpus(spark, sf_dir))
