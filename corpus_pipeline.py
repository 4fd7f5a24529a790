"""A training-data pipeline of five stages over ``documents``.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; its result is written as
Parquet and read again as the next stage's ``docs``. ``run`` deletes the tables that a stage
left in the shared folder once the stage's result is written.

Rows are told apart by doc_id and text in every stage, so an id that repeats with different
texts is as many documents; a null id is an id like any other. Null and empty texts and empty
tables are allowed everywhere, and columns beyond those of ``documents`` are dropped by ``run``.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

from folioscope.llm import decontaminate, jaccard_join, mixing, sharding, toxicity
from folioscope.llm.common import scratch_tables, shared_dir, table

#: Columns that every stage but the last passes on.
COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


def toxicity_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the network does not call toxic.

    A text without words, null texts among them, has the base rate of toxic texts as its score and
    stays; repeated rows fare alike; without labels of both kinds all rows stay.
    """
    network = toxicity.fit_toxicity(docs, table(spark, sf_dir, "labels"))
    return toxicity.without_toxic(docs, network)


def near_duplicate_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates: of the smallest doc_id, null last.

    Texts without words all stay; of repeated rows one stays.
    """
    return jaccard_join.one_of_each(docs)


def decontamination_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without ten consecutive words of a benchmark item (a shorter item: all its words).

    Null and empty texts stay; repeated rows fare alike; without items all rows stay.
    """
    return decontaminate.clean_documents(docs, table(spark, sf_dir, "benchmark"))


def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The mix: each document as often as it is taken, 0 to 3 times.

    Texts without words are never taken; a null source is a source of its own.
    """
    return mixing.mixed_documents(docs)


def sharding_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Shard and slot of each row of the mix, by doc_id; copies and repeated rows get slots of their own.

    A null text counts as empty, and a null id as a key like any other.
    """
    return sharding.assign_shards(docs)


STAGES = [
    ("toxicity", toxicity_stage),
    ("near_duplicates", near_duplicate_stage),
    ("decontamination", decontamination_stage),
    ("mixing", mixing_stage),
    ("sharding", sharding_stage),
]

#: The stages train a network and round at random, which SQL cannot express.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Apply all stages to ``documents``."""
    docs = table(spark, sf_dir, "documents").select(*COLUMNS)
    folder = f"{shared_dir(spark)}/pipeline-{uuid.uuid4().hex}"
    for name, stage in STAGES:
        with scratch_tables(spark):
            stage(spark, docs, sf_dir).write.parquet(f"{folder}/{name}")
        docs = spark.read.parquet(f"{folder}/{name}")
    return docs

