"""Session settings, shared folders and table access used by every operator here."""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager
from contextvars import ContextVar

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from folioscope.session import checkpoint_dir, importable

#: An Arrow batch ends at so many rows or bytes, whichever comes first; one longer text is a batch of its own.
ARROW_ROWS, ARROW_BYTES = 1024, 16 << 20


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def small_batches(spark: SparkSession) -> None:
    """Bound Arrow batches in rows and bytes, so that a worker's memory follows its longest text alone.

    Results are lazy and read these settings when they run, so they stay set in the session;
    smaller values of the caller's are kept.
    """
    importable(spark)
    for name, most in (("maxRecordsPerBatch", ARROW_ROWS), ("maxBytesPerBatch", ARROW_BYTES)):
        key = f"spark.sql.execution.arrow.{name}"
        now = int(spark.conf.get(key).lower().rstrip("b"))
        if now <= 0 or now > most:
            spark.conf.set(key, str(most))


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share, for intermediate tables."""
    return checkpoint_dir(spark)


_scratch: ContextVar[str | None] = ContextVar("scratch", default=None)


#: Whether Spark deletes an execution's shuffle files at its end, or when the driver happens to collect its garbage.
CLEAN_UP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def _write(df: DataFrame, folder: str, name: str) -> DataFrame:
    spark, path = df.sparkSession, f"{folder}/{name}-{uuid.uuid4().hex}"
    before = spark.conf.get(CLEAN_UP)
    spark.conf.set(CLEAN_UP, "true")
    try:
        df.write.parquet(path)
    finally:
        spark.conf.set(CLEAN_UP, before)
    return spark.read.schema(df.schema).parquet(path)


def written(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` once to the shared folder and read it back; cuts lineage and survives lost executors.

    The shuffle files of the write go at its end. Results read such tables later, so they stay until the
    folder is emptied, or, inside ``scratch_tables``, until that block ends.
    """
    return _write(df, _scratch.get() or shared_dir(df.sparkSession), name)


@contextmanager
def scratch_tables(spark: SparkSession) -> Iterator[Callable[[DataFrame, str], DataFrame]]:
    """Tables that ``written`` makes inside are deleted at the end; nothing lazy may outlive the block.

    What must outlive it is written by the function that the block gets: it goes where ``written`` put tables
    before. Each block has a folder of its own, so pipelines that run side by side don't touch each other's.
    """
    around = _scratch.get() or shared_dir(spark)
    folder = f"{shared_dir(spark)}/scratch-{uuid.uuid4().hex}"
    token = _scratch.set(folder)
    try:
        yield lambda df, name: _write(df, around, name)
    finally:
        _scratch.reset(token)
        path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
        path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def remainder(doc_id: str, modulus: int):
    """crc32 of the decimal text of an id, modulo ``modulus``: decides which rows are held out."""
    return F.crc32(F.col(doc_id).cast("string").cast("binary")) % F.lit(modulus)


def held_out(doc_id: str, modulus: int, which: int):
    """Whether a row is held out. A row without an id is not; it is never learned from either."""
    return F.coalesce(remainder(doc_id, modulus) == F.lit(which), F.lit(False))


def bounded_sample(df: DataFrame, keys: tuple[str, ...], bound: int, seed: int, total: int | None = None) -> DataFrame:
    """About ``bound`` distinct rows at most, chosen by a hash of ``keys``: the same rows on every run.

    ``keys`` must tell rows apart, so that an id which repeats with other texts is not chosen as a whole, and
    rows equal in them count once. Each distinct row stands alone: of N rows the chosen ones are
    within a few root ``bound`` of the bound. Only used to fit classifiers; no sort or limit gathers rows.
    """
    total = df.count() if total is None else total
    if total > bound:
        slots = 1_000_000_000
        keep = max(1, int(slots * bound / total))
        df = df.where(F.pmod(F.xxhash64(*keys, F.lit(seed)), F.lit(slots)) < keep)
    return df.dropDuplicates(list(keys))


def one_text_each(docs: DataFrame, *keys: str) -> DataFrame:
    """keys and text: of the rows with equal keys the text of the least hash, so an id that repeats gives one row."""
    return docs.groupBy(*keys).agg(F.min_by("text", F.struct(F.xxhash64("text"), "text")).alias("text"))
