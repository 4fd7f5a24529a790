"""Incremental ingest: a file stream of raw pages or events, upserted batch by batch."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from folioscope.sources.files import PAGE_SCHEMA, normalized, works_of_pages
from folioscope.sources.upsert import latest


def ingest_pages(spark: SparkSession, pages: str, table: str, checkpoint: str, files_per_batch: int = 8) -> StreamingQuery:
    """Start a query that reads new page files once each and adds their works to ``table``.

    Each batch writes the changes it brings, in a partition of its own, and nothing else. A batch that
    runs again after a failure overwrites that partition, so each takes effect once. ``current_works``
    gives the table's state; ``compact`` keeps what it reads bounded by the number of works.
    """

    def apply(batch: DataFrame, number: int) -> None:
        works = normalized(works_of_pages(batch)).drop("topics", "authorships", "referenced_works")
        changes = latest(works.withColumn("place", F.struct("page_index", "position")), ["paper_id"], "place").drop("place")
        changes = changes.withColumn("batch", F.lit(number).cast("long"))
        changes.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("batch").parquet(table)

    stream = spark.readStream.schema(PAGE_SCHEMA).option("maxFilesPerTrigger", files_per_batch).json(pages)
    return stream.writeStream.foreachBatch(apply).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def _base_folder(spark: SparkSession, table: str):  # noqa: ANN202
    path = spark._jvm.org.apache.hadoop.fs.Path(f"{table.rstrip('/')}-base")
    return path.getFileSystem(spark._jsc.hadoopConfiguration()), path


def _bases(spark: SparkSession, table: str) -> list[int]:
    """Last batches of the finished states, ascending; one that has no success mark was never finished."""
    fs, folder = _base_folder(spark, table)
    if not fs.exists(folder):
        return []
    done = [f.getPath() for f in fs.listStatus(folder) if f.isDirectory() and fs.exists(spark._jvm.org.apache.hadoop.fs.Path(f.getPath(), "_SUCCESS"))]
    return sorted(int(p.getName().removeprefix("upto=")) for p in done)


def _state(spark: SparkSession, table: str) -> DataFrame:
    """The newest finished state and the changes after it, with the batch of each row."""
    bases = _bases(spark, table)
    changes = spark.read.parquet(table).withColumn("batch", F.col("batch").cast("long"))
    if not bases:
        return changes
    # a partition filter: batches in the state are not read
    return spark.read.parquet(f"{table.rstrip('/')}-base/upto={bases[-1]}").unionByName(changes.where(F.col("batch") > bases[-1]))


def current_works(spark: SparkSession, table: str) -> DataFrame:
    """The last change of each work: later pages win over earlier ones, and later batches over earlier ones.

    Reads the newest state that ``compact`` left and the batches since.
    """
    return latest(_state(spark, table), ["paper_id"], "batch").drop("batch", "page_index", "position")


def compact(spark: SparkSession, table: str, keep: int = 1) -> int:
    """Fold all batches so far into a state of one row for each work; the number of its last batch.

    The state is written beside the table and counts once its success mark is there, so a run that breaks
    off leaves the one before in force. Batches go on arriving meanwhile; those after the last one are
    not touched. Then batches that ``keep`` + 1 states hold are deleted, and states but the last
    ``keep`` + 1: what a reader that began before this call may still read stays. Without a new
    batch nothing is done. The last batch itself stays, as a stream may run it again.
    """
    numbers = sorted(int(r[0]) for r in spark.read.parquet(table).select("batch").distinct().collect())
    bases = _bases(spark, table)
    last = numbers[-1]
    if bases and bases[-1] >= last:
        return bases[-1]
    latest(_state(spark, table).where(F.col("batch") <= last), ["paper_id"], "batch").write.mode("overwrite").parquet(f"{table.rstrip('/')}-base/upto={last}")
    fs, folder = _base_folder(spark, table)
    held = [*bases, last]
    if len(held) > keep:
        oldest = held[-keep - 1]
        path = spark._jvm.org.apache.hadoop.fs.Path
        for n in held[: -keep - 1]:
            fs.delete(path(folder, f"upto={n}"), True)
        for n in numbers:
            if n <= oldest and n < last:
                fs.delete(path(f"{table.rstrip('/')}/batch={n}"), True)
    return last


def watermarks(works: DataFrame, by: str = "source_slug", updated: str = "updated_date") -> DataFrame:
    """Newest update seen for each source: where the next ingest goes on."""
    return works.groupBy(by).agg(F.max(updated).alias("updated_until"), F.count(F.lit(1)).alias("works"))


def windowed_counts(events: DataFrame, late: str = "1 hour", size: str = "1 day") -> DataFrame:
    """Events and their value in each window and type; works on a stream, with its watermark, and on a table."""
    marked = events.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", late) if events.isStreaming else events
    g = marked.groupBy(F.window("ts", size).alias("w"), "event_type").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("value"), 2).alias("total"))
    return g.select(F.col("w.start").alias("day"), "event_type", "n", "total")
