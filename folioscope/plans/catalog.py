"""Paper lists, details, trends and pools: the read side of the corpus."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from folioscope.sources.corpus import LOW_CITE_MAX_CITATIONS, LOW_CITE_MIN_YEAR, Corpus


def top_topics(work_topics: DataFrame, most: int | None = 3) -> DataFrame:
    """(work_id, topics): names of the ``most`` highest-scored topics (None: of all), joined by '|'.

    One aggregation for all works replaces a lateral subquery for each.
    """
    ordered = F.array_sort(F.collect_list(F.struct((-F.col("score")).alias("s"), F.col("topic_name").alias("n"))))
    names = F.transform(ordered if most is None else F.slice(ordered, 1, most), lambda x: x["n"])
    return work_topics.groupBy("work_id").agg(F.array_join(names, "|").alias("topics"))


def topic_trends(c: Corpus, snapshot: str, since_year: int, min_works: int, limit: int) -> DataFrame:
    """Topics of a snapshot with works since a year, before it, and a growth label."""
    works = c.members(snapshot)
    recent = F.col("year") >= since_year
    found = c.work_topics.join(works, "work_id").groupBy("topic_id", "topic_name").agg(
        F.count_distinct("work_id").alias("total_works"),
        F.count_distinct(F.when(recent, F.col("work_id"))).alias("recent_works"),
        F.count_distinct(F.when(~recent, F.col("work_id"))).alias("prior_works"),
    )
    gain = F.col("recent_works") - F.col("prior_works")
    label = F.when(gain > 0, "rising").when(gain < 0, "cooling").otherwise("steady")
    order = [F.desc("recent_works"), gain.desc(), F.desc("total_works"), F.asc("topic_name")]
    return found.where(F.col("total_works") >= min_works).withColumn("growth_label", label).orderBy(*order).limit(limit)


TOPIC_TRENDS_SQL = """
SELECT topic_id, topic_name, total_works, recent_works, prior_works,
  CASE WHEN recent_works > prior_works THEN 'rising' WHEN recent_works < prior_works THEN 'cooling' ELSE 'steady' END AS growth_label
FROM (
  SELECT topic_id, topic_name, count(DISTINCT w.work_id) AS total_works, count(DISTINCT w.work_id) FILTER (WHERE year >= 2000) AS recent_works,
    count(DISTINCT w.work_id) FILTER (WHERE year < 2000) AS prior_works
  FROM work_topics t JOIN works w USING (work_id) JOIN memberships m ON m.work_id = w.work_id AND m.snapshot = 'snap-2001' AND m.inclusion_status = 'included'
  GROUP BY topic_id, topic_name)
WHERE total_works >= 5 ORDER BY recent_works DESC, recent_works - prior_works DESC, total_works DESC, topic_name LIMIT 20"""


def papers(c: Corpus, limit: int, q: str | None = None) -> DataFrame:
    """Included works with venue and top topics, newest first; ``q`` is a case-insensitive pattern inside the title."""
    w = c.included if not q else c.included.where(F.ilike("title", F.lit(f"%{q}%")))
    first = w.orderBy(F.desc("year"), F.desc("citation_count"), "work_id").limit(limit)
    full = first.join(c.venues, "venue_id", "left").join(top_topics(c.work_topics), "work_id", "left")
    return full.select("paper_id", "title", "year", "citation_count", "source_slug", "source_label", "is_core_corpus", F.coalesce("topics", F.lit("")).alias("topics"))


PAPERS_SQL = """
SELECT paper_id, title, year, citation_count, source_slug, n_name AS source_label, is_core_corpus, coalesce(topics, '') AS topics
FROM (SELECT * FROM included WHERE title ILIKE '%building%' ORDER BY year DESC, citation_count DESC, work_id LIMIT 50) w
LEFT JOIN nation ON n_nationkey = venue_id LEFT JOIN top_topics USING (work_id)"""


def paper_details(c: Corpus) -> DataFrame:
    """Every included work with all its authors in order and all its topics by score."""
    names = F.array_sort(F.collect_list(F.struct("author_position", "author_name")))
    authors = c.work_authors.join(c.authors, "author_id").groupBy("work_id").agg(F.array_join(F.transform(names, lambda x: x["author_name"]), "|").alias("authors"))
    topics = top_topics(c.work_topics, None)
    return c.included.select("work_id", "title", "year").join(authors, "work_id", "left").join(topics, "work_id", "left")


PAPER_DETAILS_SQL = """
SELECT work_id, title, year, authors, topics FROM included
LEFT JOIN (SELECT work_id, array_to_string(list(s_name ORDER BY p, s_name), '|') AS authors FROM (
  SELECT l_orderkey AS work_id, l_suppkey, min(l_linenumber) AS p FROM lineitem GROUP BY ALL) JOIN supplier ON s_suppkey = l_suppkey GROUP BY work_id) USING (work_id)
LEFT JOIN (SELECT work_id, array_to_string(list(topic_name ORDER BY score DESC, topic_name), '|') AS topics FROM work_topics GROUP BY work_id) USING (work_id)"""


def in_low_cite_pool(min_year: int = LOW_CITE_MIN_YEAR, max_citations: int = LOW_CITE_MAX_CITATIONS) -> Column:
    """Core works since a year, up to a number of citations, with a title and an abstract."""
    filled = [F.length(F.trim(F.coalesce(F.col(c), F.lit("")))) > 0 for c in ("title", "abstract")]
    return F.col("is_core_corpus") & (F.col("year") >= min_year) & (F.col("citation_count") <= max_citations) & filled[0] & filled[1]


POOL_SQL = "is_core_corpus AND year >= 1999 AND citation_count <= 30 AND length(trim(coalesce(title, ''))) > 0 AND length(trim(coalesce(abstract, ''))) > 0"


def undercited_feed(c: Corpus, as_of_year: int, limit: int, min_year: int = LOW_CITE_MIN_YEAR, max_citations: int = LOW_CITE_MAX_CITATIONS) -> DataFrame:
    """The low-citation pool, newest and least cited first, with a blend of recency and low citation."""
    pool = c.included.where(in_low_cite_pool(min_year, max_citations)).orderBy(F.desc("year"), "citation_count", "paper_id").limit(limit)
    span = max(1, as_of_year - min_year + 1)
    recency = F.greatest(F.lit(0.0), F.least(F.lit(1.0), (F.col("year") - min_year + 1) / F.lit(float(span))))
    low = 1.0 - F.least(F.lit(1.0), F.col("citation_count") / F.lit(float(max(1, max_citations) + 1)))
    return pool.select(
        "paper_id", "title", "year", "citation_count", "source_slug", F.round(recency, 4).alias("recency"), F.round(low, 4).alias("low_citation_signal"),
        F.round(0.45 * recency + 0.55 * low, 4).alias("heuristic_composite"),
    )


UNDERCITED_FEED_SQL = f"""
SELECT paper_id, title, year, citation_count, source_slug, round(r, 4) AS recency, round(l, 4) AS low_citation_signal, round(0.45 * r + 0.55 * l, 4) AS heuristic_composite
FROM (SELECT *, greatest(0.0, least(1.0, (year - 1998) / CAST(4 AS DOUBLE))) AS r, 1.0 - least(1.0, citation_count / CAST(31 AS DOUBLE)) AS l
  FROM included WHERE {POOL_SQL} ORDER BY year DESC, citation_count, paper_id LIMIT 100)"""


def missing_vectors(c: Corpus, snapshot: str) -> DataFrame:
    """Included works of a snapshot without a vector."""
    return c.members(snapshot).select("work_id").join(c.vectors.select("work_id"), "work_id", "left_anti")


MISSING_VECTORS_SQL = "SELECT work_id FROM memberships WHERE snapshot = 'snap-1998' AND inclusion_status = 'included' AND work_id NOT IN (SELECT vec_id FROM embeddings)"


def search_page(c: Corpus, words: list[str], limit: int, offset: int, year_from: int | None = None, year_to: int | None = None, source: str | None = None, topic: str | None = None, scope: str = "all") -> DataFrame:
    """A page of included works by lexical score, with the total number of matches on each row.

    Each word adds 0.55 in the title, 0.30 in the abstract and 0.15 in the topics, up to 1. All
    filters are optional and combine by AND. A page past the end is empty.
    """
    topics = top_topics(c.work_topics, None)
    w = c.included.join(topics, "work_id", "left")
    keep = [F.lit(True)]
    if scope == "core":
        keep.append(F.col("is_core_corpus"))
    if year_from is not None:
        keep.append(F.col("year") >= year_from)
    if year_to is not None:
        keep.append(F.col("year") <= year_to)
    if source is not None:
        keep.append(F.col("source_slug") == source)
    if topic is not None:
        keep.append(F.ilike(F.coalesce("topics", F.lit("")), F.lit(f"%{topic}%")))
    condition = keep[0]
    for k in keep[1:]:
        condition = condition & k
    scored = w.where(condition).withColumn("lexical_rank", lexical_score(words, "title", "abstract", "topics")).where("lexical_rank > 0")
    # the count is its own aggregate: a window without partitions would gather all rows in one task
    total = scored.agg(F.count(F.lit(1)).alias("total"))
    page = scored.orderBy(F.desc("lexical_rank"), F.desc("year"), F.desc("citation_count"), "work_id").offset(offset).limit(limit)
    return page.crossJoin(total).select("paper_id", "year", "citation_count", "lexical_rank", "total")


def lexical_score(words: list[str], title: str, abstract: str, topics: str) -> Column:
    def points(column: str, each: float, word: str) -> Column:
        return F.when(F.contains(F.lower(F.coalesce(F.col(column), F.lit(""))), F.lit(word.lower())), each).otherwise(0.0)

    total = F.lit(0.0)
    for word in words:
        total = total + points(title, 0.55, word) + points(abstract, 0.30, word) + points(topics, 0.15, word)
    return F.round(F.least(total, F.lit(1.0)), 6)


SEARCH_SQL = """
, t AS (SELECT work_id, array_to_string(list(topic_name ORDER BY score DESC, topic_name), '|') AS topics FROM work_topics GROUP BY work_id),
m AS (
  SELECT w.*, round(least(1.0, 0.55 * (contains(lower(title), 'building'))::INT + 0.30 * (contains(lower(coalesce(abstract, '')), 'building'))::INT
    + 0.15 * (contains(lower(coalesce(topics, '')), 'building'))::INT + 0.55 * (contains(lower(title), 'brand#1'))::INT
    + 0.30 * (contains(lower(coalesce(abstract, '')), 'brand#1'))::INT + 0.15 * (contains(lower(coalesce(topics, '')), 'brand#1'))::INT), 6)::DOUBLE AS lexical_rank
  FROM included w LEFT JOIN t USING (work_id) WHERE year >= 1996 AND year <= 2000)
SELECT paper_id, year, citation_count, lexical_rank, (SELECT count(*) FROM m WHERE lexical_rank > 0) AS total
FROM m WHERE lexical_rank > 0 ORDER BY lexical_rank DESC, year DESC, citation_count DESC, work_id LIMIT 25 OFFSET 10"""


def cluster_samples(c: Corpus, each: int = 5) -> DataFrame:
    """The first works of each cluster by id, with the cluster's size."""
    size = c.vectors.groupBy("cluster_id").agg(F.count(F.lit(1)).alias("size"))
    nth = F.row_number().over(W.partitionBy("cluster_id").orderBy("work_id"))
    return c.vectors.select("cluster_id", "work_id", nth.alias("nth")).where(F.col("nth") <= each).join(size, "cluster_id")


CLUSTER_SAMPLES_SQL = """
SELECT cluster_id, work_id, nth, size FROM (SELECT printf('c%03d', label) AS cluster_id, vec_id AS work_id,
  CAST(row_number() OVER (PARTITION BY label ORDER BY vec_id) AS INTEGER) AS nth, count(*) OVER (PARTITION BY label) AS size FROM embeddings) WHERE nth <= 5"""
