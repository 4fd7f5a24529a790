"""The relational corpus as DataFrames: works, topics, venues, authors, memberships, vectors, labels.

The test tables stand in for an ingested corpus. ``PRELUDE`` states the same mapping in SQL,
for the oracle queries.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import cached_property

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from folioscope.session import importable

FIRST_SNAPSHOT_YEAR, LAST_SNAPSHOT_YEAR = 1995, 2001
#: Lowest year and highest citation count of the low-citation pool.
LOW_CITE_MIN_YEAR, LOW_CITE_MAX_CITATIONS = 1999, 30


@dataclass(frozen=True)
class Corpus:
    """Views over one data directory; nothing is read before an action."""

    spark: SparkSession
    sf_dir: str

    def __post_init__(self) -> None:
        importable(self.spark)

    def table(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.sf_dir}/{name}.parquet")

    @cached_property
    def works(self) -> DataFrame:
        orders, customers = self.table("orders"), self.table("customer").select("c_custkey", "c_mktsegment", "c_nationkey")
        id_ = F.col("o_orderkey")
        return orders.join(customers, orders.o_custkey == customers.c_custkey, "left").select(
            id_.alias("work_id"),
            F.concat(F.lit("W"), id_.cast("string")).alias("paper_id"),
            F.when(id_ % 11 == 0, "  ").otherwise(F.concat(F.lit("Study "), id_.cast("string"), F.lit(" of "), F.lower("c_mktsegment"))).alias("title"),
            F.when(id_ % 7 != 0, F.concat(F.lit("An abstract on "), F.lower("c_mktsegment"), F.lit(" no "), id_.cast("string"))).alias("abstract"),
            F.year("o_orderdate").alias("year"),
            F.floor(F.col("o_totalprice") / 5000).cast("int").alias("citation_count"),
            F.lower("c_mktsegment").alias("source_slug"),
            F.col("c_nationkey").alias("venue_id"),
            F.when(F.col("o_orderstatus") == "P", "excluded").otherwise("included").alias("inclusion_status"),
            F.col("o_orderpriority").isin("1-URGENT", "2-HIGH").alias("is_core_corpus"),
        )

    @cached_property
    def included(self) -> DataFrame:
        return self.works.where("inclusion_status = 'included'")

    @cached_property
    def venues(self) -> DataFrame:
        return self.table("nation").select(F.col("n_nationkey").alias("venue_id"), F.col("n_name").alias("source_label"))

    @cached_property
    def work_topics(self) -> DataFrame:
        """One row for each (work, topic): the topic is the part's brand, the score its price in the order."""
        lines = self.table("lineitem").select("l_orderkey", "l_partkey", "l_extendedprice")
        parts = self.table("part").select("p_partkey", "p_brand")
        each = lines.join(parts, lines.l_partkey == parts.p_partkey)
        scored = each.groupBy(F.col("l_orderkey").alias("work_id"), F.col("p_brand").alias("topic_name")).agg(F.round(F.sum("l_extendedprice"), 2).alias("score"))
        # the number after the aggregation: a string in its buffer would make it sort
        return scored.withColumn("topic_id", F.regexp_extract("topic_name", r"(\d+)$", 1).cast("int"))

    @cached_property
    def work_authors(self) -> DataFrame:
        return self.table("lineitem").groupBy(F.col("l_orderkey").alias("work_id"), F.col("l_suppkey").alias("author_id")).agg(F.min("l_linenumber").alias("author_position"))

    @cached_property
    def authors(self) -> DataFrame:
        return self.table("supplier").select(F.col("s_suppkey").alias("author_id"), F.col("s_name").alias("author_name"))

    @cached_property
    def snapshots(self) -> DataFrame:
        years = self.spark.range(FIRST_SNAPSHOT_YEAR, LAST_SNAPSHOT_YEAR + 1).select(F.col("id").cast("int").alias("snapshot_year"))
        return years.withColumn("snapshot", F.concat(F.lit("snap-"), F.col("snapshot_year").cast("string")))

    @cached_property
    def memberships(self) -> DataFrame:
        """(work, snapshot): a snapshot holds the works up to its year. A snapshot list has a handful of rows."""
        made = F.sequence(F.greatest("year", F.lit(FIRST_SNAPSHOT_YEAR)), F.lit(LAST_SNAPSHOT_YEAR))
        each = self.works.where(F.col("year") <= LAST_SNAPSHOT_YEAR).select("work_id", "inclusion_status", "source_slug", F.explode(made).alias("y"))
        return each.select("work_id", F.concat(F.lit("snap-"), F.col("y").cast("string")).alias("snapshot"), "inclusion_status", "source_slug")

    def members(self, snapshot: str) -> DataFrame:
        """Included works of one snapshot: the same rows as in ``memberships``, without making the others."""
        return self.included.where(F.col("year") <= int(snapshot.rpartition("-")[2])).select("work_id", "year", "source_slug")

    @cached_property
    def vectors(self) -> DataFrame:
        """(work_id, vector, cluster_id)."""
        e = self.table("embeddings")
        return e.select(F.col("vec_id").alias("work_id"), F.col("embedding").cast("array<double>").alias("vector"), F.format_string("c%03d", "label").alias("cluster_id"))

    @cached_property
    def texts(self) -> DataFrame:
        """Documents as papers: the first sentence is the title, the rest the abstract."""
        d = self.table("documents")
        dot = F.instr("text", ".")
        return d.select(
            F.col("doc_id").alias("paper_id"),
            F.trim(F.when(dot > 0, F.substring("text", F.lit(1), dot - 1)).otherwise(F.col("text"))).alias("title"),
            F.trim(F.when(dot > 0, F.substring("text", dot + 1, F.length("text"))).otherwise("")).alias("abstract"),
            "lang",
            "source",
        )

    @cached_property
    def labels(self) -> DataFrame:
        """Judged documents with two derived labels and a score to judge by."""
        judged = self.table("labels").join(self.table("documents").select("doc_id", "source", "n_chars"), "doc_id")
        return judged.select(
            "doc_id",
            "source",
            (F.col("quality") == 1).alias("good"),
            (F.col("toxic") == 0).alias("useful"),
            F.col("n_chars"),
            (F.col("n_chars") % 500 / 500.0).alias("score"),
        )


PRELUDE = """
works AS (
  SELECT o_orderkey AS work_id, 'W' || o_orderkey AS paper_id,
    CASE WHEN o_orderkey % 11 = 0 THEN '  ' ELSE 'Study ' || o_orderkey || ' of ' || lower(c_mktsegment) END AS title,
    CASE WHEN o_orderkey % 7 <> 0 THEN 'An abstract on ' || lower(c_mktsegment) || ' no ' || o_orderkey END AS abstract,
    CAST(year(o_orderdate) AS INTEGER) AS year, CAST(floor(o_totalprice / 5000) AS INTEGER) AS citation_count, lower(c_mktsegment) AS source_slug,
    c_nationkey AS venue_id, CASE WHEN o_orderstatus = 'P' THEN 'excluded' ELSE 'included' END AS inclusion_status,
    o_orderpriority IN ('1-URGENT', '2-HIGH') AS is_core_corpus
  FROM orders LEFT JOIN customer ON o_custkey = c_custkey
), included AS (SELECT * FROM works WHERE inclusion_status = 'included'),
work_topics AS (
  SELECT l_orderkey AS work_id, p_brand AS topic_name, round(sum(l_extendedprice), 2) AS score, CAST(regexp_extract(p_brand, '([0-9]+)$', 1) AS INTEGER) AS topic_id
  FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY l_orderkey, p_brand
), memberships AS (
  SELECT work_id, 'snap-' || y AS snapshot, inclusion_status, source_slug FROM works, range(1995, 2002) t(y) WHERE year <= y
), top_topics AS (
  SELECT work_id, array_to_string(list(topic_name ORDER BY score DESC, topic_name), '|') AS topics FROM (
    SELECT *, row_number() OVER (PARTITION BY work_id ORDER BY score DESC, topic_name) AS rn FROM work_topics) WHERE rn <= 3 GROUP BY work_id
)"""


def prelude(sql: str) -> str:
    """An oracle query over the mapped entities; ``sql`` may begin with further CTEs (', name AS (...)')."""
    return f"WITH {PRELUDE} {sql}"
