"""Keyed changes to stored tables: last write wins, coalesce, insert if absent, rewrite, compose.

Parquet tables have no MERGE, so each change is a new version of the table: a DataFrame from the
old rows and the new ones. ``replace_partitions`` writes only the partitions that changed.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def latest(rows: DataFrame, keys: list[str], sequence: str) -> DataFrame:
    """The last row of each key by ``sequence``. One aggregation with partial maxima, no sort."""
    others = [c for c in rows.columns if c not in keys]
    last = rows.groupBy(*keys).agg(F.max_by(F.struct(*others), F.col(sequence)).alias("r"))
    return last.select(*keys, *[F.col(f"r.{c}") for c in others]).select(*rows.columns)


def upsert(stored: DataFrame, changes: DataFrame, keys: list[str], sequence: str, sticky: tuple[str, ...] = ()) -> DataFrame:
    """Stored rows with the changes: the last change of a key wins; ``sticky`` columns keep their first value.

    Keys may repeat in ``changes``. Null keys count as equal.
    """
    new = latest(changes, keys, sequence)
    s, n = stored.alias("s"), new.alias("n")
    on = None
    for k in keys:
        same = F.col(f"s.{k}").eqNullSafe(F.col(f"n.{k}"))
        on = same if on is None else on & same
    is_new = F.col(f"n.{sequence}").isNotNull()
    columns = []
    for c in stored.columns:
        old, fresh = F.col(f"s.{c}"), F.col(f"n.{c}")
        columns.append((F.coalesce(old, fresh) if c in sticky or c in keys else F.when(is_new, fresh).otherwise(old)).alias(c))
    return s.join(n, on, "full_outer").select(*columns)


def upsert_coalesce(stored: DataFrame, changes: DataFrame, keys: list[str]) -> DataFrame:
    """A change's null leaves the stored value; ``changes`` has one row for each key."""
    both = stored.alias("s").join(changes.alias("n"), keys, "full_outer")
    return both.select(*[F.col(c) if c in keys else F.coalesce(F.col(f"n.{c}"), F.col(f"s.{c}")).alias(c) for c in stored.columns])


def insert_absent(stored: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """Adds the new keys only; a key that repeats among them comes once."""
    return stored.unionByName(new.dropDuplicates(keys).join(stored.select(*keys), keys, "left_anti").select(*stored.columns))


#: Rows that a task of a rewrite sorts, about.
TASK_ROWS = 500_000


def rewrite_edges(stored: DataFrame, new: DataFrame, owner: str, touched: DataFrame) -> DataFrame:
    """All edges of the touched owners are replaced by the new ones. Tasks are counted by rows, as rows of numbers are small when shuffled and large when sorted."""

    def met(edges: DataFrame, how: str) -> DataFrame:
        parts = max(1, -(-edges.count() // TASK_ROWS))
        return edges.repartition(parts, owner).join(touched.select(owner).repartition(parts, owner).distinct(), owner, how)

    return met(stored, "left_anti").unionByName(met(new, "left_semi").select(*stored.columns))


def delete_where_joined(stored: DataFrame, doomed: DataFrame, keys: list[str]) -> DataFrame:
    return stored.join(doomed.select(*keys).distinct(), keys, "left_anti")


def replace_partitions(df: DataFrame, path: str, by: list[str]) -> None:
    """Writes the partitions that occur in ``df`` and leaves all others as they are."""
    df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(*by).parquet(path)


def resolve_edges(edges: DataFrame, nodes: DataFrame, key: str = "paper_id", number: str = "work_id") -> DataFrame:
    """Edges between known nodes, by number: both ends must exist. Repeated edges come once."""
    left = nodes.select(F.col(key).alias("citing"), F.col(number).alias("citing_id"))
    right = nodes.select(F.col(key).alias("cited"), F.col(number).alias("cited_id"))
    return edges.select("citing", "cited").distinct().join(left, "citing").join(right, "cited").select("citing_id", "cited_id")


def compose(memberships: DataFrame, sources: list[str], target: str) -> DataFrame:
    """A new snapshot from others: the first source in the list that has a work gives its row."""
    rank = F.array_position(F.array(*[F.lit(s) for s in sources]), F.col("snapshot"))
    rows = memberships.where(F.col("snapshot").isin(sources)).withColumn("rank", rank)
    first = rows.groupBy("work_id").agg(F.min_by(F.struct("snapshot", "inclusion_status", "source_slug"), "rank").alias("m"))
    return first.select("work_id", F.lit(target).alias("snapshot"), F.col("m.snapshot").alias("from_snapshot"), F.col("m.inclusion_status").alias("inclusion_status"), F.col("m.source_slug").alias("source_slug"))


COMPOSE_SQL = """
SELECT work_id, 'composed' AS snapshot, snapshot AS from_snapshot, inclusion_status, source_slug FROM (
  SELECT *, row_number() OVER (PARTITION BY work_id ORDER BY CASE snapshot WHEN 'snap-1997' THEN 1 WHEN 'snap-1996' THEN 2 ELSE 3 END) AS rn
  FROM memberships WHERE snapshot IN ('snap-1997', 'snap-1996', 'snap-1999')) WHERE rn = 1"""


def match_in_order(rows: DataFrame, stored: DataFrame, keys: list[str], number: str) -> DataFrame:
    """Adds the stored number: by the first of ``keys`` that finds a row."""
    out = rows
    for k in keys:
        by = stored.where(F.col(k).isNotNull()).groupBy(k).agg(F.min(number).alias(f"_by_{k}"))
        out = out.join(by, k, "left")
    return out.withColumn(number, F.coalesce(*[F.col(f"_by_{k}") for k in keys])).drop(*[f"_by_{k}" for k in keys])


def latest_runs(runs: DataFrame, by: list[str], status: str = "succeeded") -> DataFrame:
    """The newest finished run of each combination of versions; ties by the larger id."""
    done = runs.where(F.col("status") == status)
    nth = F.row_number().over(W.partitionBy(*by).orderBy(F.desc_nulls_last("finished_at"), F.desc("run_id")))
    return done.withColumn("nth", nth).where("nth = 1").drop("nth")


LATEST_RUNS_SQL = """
SELECT user_id, run_id, finished_at FROM (SELECT user_id, event_id AS run_id, ts AS finished_at, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS nth
  FROM events WHERE event_type = 'click') WHERE nth = 1"""
UPSERT_SQL = """
WITH n AS (SELECT user_id, event_type, value, event_id FROM (SELECT *, row_number() OVER (PARTITION BY user_id, event_type ORDER BY event_id DESC) AS rn FROM events WHERE event_id % 2 = 1) WHERE rn = 1),
s AS (SELECT user_id, event_type, value, event_id FROM (SELECT *, row_number() OVER (PARTITION BY user_id, event_type ORDER BY event_id DESC) AS rn FROM events WHERE event_id % 2 = 0) WHERE rn = 1)
SELECT coalesce(s.user_id, n.user_id) AS user_id, coalesce(s.event_type, n.event_type) AS event_type, CASE WHEN n.event_id IS NOT NULL THEN n.value ELSE s.value END AS value, coalesce(s.event_id, n.event_id) AS event_id
FROM s FULL OUTER JOIN n USING (user_id, event_type)"""
