"""Readers and writers of raw pages, worksheets, artifacts and manifests."""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: One work of a raw page, as far as the corpus uses it.
WORK_SCHEMA = T.StructType(
    [
        T.StructField("id", T.StringType()), T.StructField("doi", T.StringType()), T.StructField("title", T.StringType()), T.StructField("abstract", T.StringType()),
        T.StructField("abstract_text", T.StringType()), T.StructField("abstract_inverted_index", T.MapType(T.StringType(), T.ArrayType(T.IntegerType()))),
        T.StructField("publication_year", T.IntegerType()), T.StructField("language", T.StringType()), T.StructField("type", T.StringType()), T.StructField("is_retracted", T.BooleanType()),
        T.StructField("cited_by_count", T.IntegerType()), T.StructField("updated_date", T.StringType()),
        T.StructField("primary_location", T.StructType([T.StructField("source", T.StructType([T.StructField("id", T.StringType()), T.StructField("display_name", T.StringType())]))])),
        T.StructField("topics", T.ArrayType(T.StructType([T.StructField("id", T.StringType()), T.StructField("display_name", T.StringType()), T.StructField("score", T.DoubleType()), T.StructField("level", T.IntegerType())]))),
        T.StructField("authorships", T.ArrayType(T.StructType([T.StructField("author", T.StructType([T.StructField("id", T.StringType()), T.StructField("display_name", T.StringType())]))]))),
        T.StructField("referenced_works", T.ArrayType(T.StringType())),
    ]
)
PAGE_SCHEMA = T.StructType([T.StructField("source_slug", T.StringType()), T.StructField("page_index", T.IntegerType()), T.StructField("next_cursor", T.StringType()), T.StructField("results", T.ArrayType(WORK_SCHEMA))])

LABEL_COLUMNS = ("relevance_label", "novelty_label", "bridge_like_label")


@dataclass(frozen=True)
class PagePlan:
    """What to ask a paged service for; a fetcher outside the engine turns it into requests."""

    filters: dict[str, str]
    cursor: str = "*"
    per_page: int = 100
    sort: str = "publication_date:desc"


def page_plan(source_id: str, min_year: int, language: str, types: tuple[str, ...]) -> PagePlan:
    """Works of one source since a year, in a language, of some types, not retracted, with an abstract."""
    return PagePlan({"from_publication_date": f"{min_year}-01-01", "language": language, "type": "|".join(types), "is_retracted": "false", "has_abstract": "true", "primary_location.source.id": source_id})


def read_pages(spark: SparkSession, path: str) -> DataFrame:
    """Landed pages, one row for each work, with its place in the ingest order."""
    pages = spark.read.schema(PAGE_SCHEMA).json(path)
    return works_of_pages(pages)


def works_of_pages(pages: DataFrame) -> DataFrame:
    each = pages.select("source_slug", "page_index", F.posexplode("results").alias("position", "work"))
    return each.select("source_slug", "page_index", "position", "work.*").where("id is not null")


def normalized(works: DataFrame) -> DataFrame:
    """Works with a cleaned title and a chosen, cleaned abstract.

    The abstract is the given one, or the one text field, or the inverted index put together.
    """
    from folioscope.functions.text import blank_to_null, cleaned, doi_key, text_from_positions, work_token

    # a Python function cannot take a lambda expression of its own projection; the generator keeps the two apart
    works = works.withColumn("from_index", F.explode(F.array(text_from_positions(F.col("abstract_inverted_index")))))
    abstract = cleaned(F.coalesce(blank_to_null(F.col("abstract")), blank_to_null(F.col("abstract_text")), F.col("from_index"), F.lit("")))
    return works.select(
        work_token(F.col("id")).alias("paper_id"), "source_slug", "page_index", "position", cleaned(F.col("title")).alias("title"), abstract.alias("abstract"), doi_key(F.col("doi")).alias("doi"),
        F.col("publication_year").alias("year"), F.coalesce("cited_by_count", F.lit(0)).alias("citation_count"), "language", "type", F.coalesce("is_retracted", F.lit(False)).alias("is_retracted"),
        F.col("primary_location.source.id").alias("source_id"), F.col("primary_location.source.display_name").alias("source_name"), "updated_date", "topics", "authorships", "referenced_works",
    )


def work_topics(works: DataFrame) -> DataFrame:
    """(paper_id, topic_id, topic_name, score, level): a missing level is 0."""
    each = works.select("paper_id", F.explode("topics").alias("t"))
    return each.select("paper_id", F.col("t.id").alias("topic_id"), F.col("t.display_name").alias("topic_name"), F.col("t.score").alias("score"), F.coalesce("t.level", F.lit(0)).alias("level")).where("topic_id is not null")


def work_authors(works: DataFrame) -> DataFrame:
    """(paper_id, author_id, author_name, author_position): the place in the raw list, from 1."""
    each = works.select("paper_id", F.posexplode("authorships").alias("at", "a"))
    return each.select("paper_id", F.col("a.author.id").alias("author_id"), F.col("a.author.display_name").alias("author_name"), (F.col("at") + 1).alias("author_position")).where("author_id is not null")


def citation_edges(works: DataFrame) -> DataFrame:
    from folioscope.functions.text import work_token

    each = works.select(F.col("paper_id").alias("citing"), F.explode("referenced_works").alias("r"))
    return each.select("citing", work_token(F.col("r")).alias("cited")).where("cited is not null and cited <> citing").distinct()


def land_raw(df: DataFrame, path: str, by: list[str]) -> None:
    """Raw rows with a checksum of each, partitioned; a partition is written anew as a whole."""
    payload = F.to_json(F.struct(*df.columns))
    df.withColumn("payload", payload).withColumn("content_hash", F.sha2(payload, 256)).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(*by).json(path)


def manifest(landed: DataFrame, by: list[str]) -> DataFrame:
    """Rows and a checksum of the checksums for each part, independent of row order."""
    return landed.groupBy(*by).agg(F.count(F.lit(1)).alias("rows"), F.count_distinct("content_hash").alias("distinct_rows"), F.hex(F.bit_xor(F.xxhash64("content_hash"))).alias("checksum"))


def file_hashes(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.format("binaryFile").load(path).select("path", "length", F.sha2("content", 256).alias("sha256"))


def read_worksheet(spark: SparkSession, path: str, columns: list[str]) -> tuple[DataFrame, DataFrame]:
    """(labelled rows, rejected rows) of CSV review sheets, by header.

    Rows without a paper id are rejected; rows without any label are left out of both.
    """
    schema = T.StructType([T.StructField(c, T.StringType()) for c in columns])
    raw = spark.read.option("header", True).option("enforceSchema", False).schema(schema).csv(path)
    blank = F.length(F.trim(F.coalesce(F.col("paper_id"), F.lit("")))) == 0
    labelled = F.lit(False)
    for c in LABEL_COLUMNS:
        labelled = labelled | (F.length(F.trim(F.coalesce(F.col(c), F.lit("")))) > 0)
    return raw.where(labelled & ~blank), raw.where(blank)


def read_artifact(spark: SparkSession, path: str, required: tuple[str, ...] = ()) -> DataFrame:
    """A JSON document as one row; ValueError if a required key is missing."""
    df = spark.read.option("multiLine", True).json(path)
    missing = [k for k in required if k not in df.columns]
    if missing:
        raise ValueError(f"{path} lacks {', '.join(missing)}")
    return df


_WRITES = re.compile(r"\b(insert|update|delete|drop|alter|truncate|create|grant|copy)\b", re.I)


def check_select(sql: str, allowed: set[str]) -> str:
    """The statement, if it only selects from allowed tables; else ValueError."""
    body = re.sub(r"'[^']*'", "''", sql).strip()
    tables = {t.lower() for t in re.findall(r"\b(?:from|join)\s+([A-Za-z_]\w*)", body, re.I)}
    ctes = {t.lower() for t in re.findall(r"(?:\bwith|,)\s*([A-Za-z_]\w*)\s+as\s*\(", body, re.I)}
    if not re.match(r"(select|with)\b", body, re.I) or _WRITES.search(body) or ";" in body.rstrip(";") or tables - ctes - {a.lower() for a in allowed}:
        raise ValueError("only SELECT from the allowed tables")
    return sql


def source_ids(names: DataFrame, sources: DataFrame) -> DataFrame:
    """Each wanted name with the id of the source that has it as name or alias; null where none has.

    White space and case don't matter. ``sources``: source_id, display_name, aliases.
    """
    from folioscope.functions.text import casefolded, collapse

    known = sources.select("source_id", F.explode(F.array_append(F.coalesce("aliases", F.array().cast("array<string>")), F.col("display_name"))).alias("n"))
    known = known.select("source_id", casefolded(collapse(F.col("n"))).alias("key")).groupBy("key").agg(F.min("source_id").alias("source_id"))
    return names.withColumn("key", casefolded(collapse(F.col("name")))).join(known, "key", "left").drop("key")


def bucket_coverage(rows: DataFrame, bucket: str, key: str, each: int) -> DataFrame:
    """Rows of each bucket and its first ``each`` keys."""
    from pyspark.sql import Window as W

    nth = F.row_number().over(W.partitionBy(bucket).orderBy(key))
    head = rows.select(bucket, key, nth.alias("nth")).where(F.col("nth") <= each).groupBy(bucket).agg(F.array_join(F.array_sort(F.collect_list(F.col(key).cast("string"))), "|").alias("first_keys"))
    return rows.groupBy(bucket).agg(F.count(F.lit(1)).alias("rows")).join(head, bucket)
