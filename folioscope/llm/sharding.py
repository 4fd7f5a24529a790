"""Jump consistent hashing of stable keys to shards, with gapless slots inside each shard.

Only SQL functions. The jump walk draws its random numbers from ``xxhash64(key, bucket)``,
so the trajectory of a key does not depend on the number of shards: appending a shard
moves into it exactly the keys whose walk lands there, and no other row changes place.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

#: Rows in one (shard, block) group, on average: the unit in which slots are numbered.
ROWS_PER_BLOCK = 4096
_RANGE = 1 << 31


def _jump(key: Column, bucket: Column) -> Column:
    """The bucket to which the walk goes on from ``bucket``: always a larger one."""
    draw = F.shiftrightunsigned(F.xxhash64(key, bucket), 33) + F.lit(1)
    return F.floor((bucket + F.lit(1)).cast("double") * F.lit(float(_RANGE)) / draw).cast("long")


def jump_walk(key: Column, n_shards: int) -> Column:
    """struct(at, next): the key's bucket among ``n_shards``, and where its walk would go with more."""
    zero = F.lit(0).cast("long")
    start = F.struct(zero.alias("at"), _jump(key, zero).alias("next"))

    def step(walk: Column, _: Column) -> Column:
        on = F.struct(walk["next"].alias("at"), _jump(key, walk["next"]).alias("next"))
        return F.when(walk["next"] < n_shards, on).otherwise(walk)

    return F.aggregate(F.sequence(F.lit(1), F.lit(n_shards)), start, step)


def jump_shard(key: Column, n_shards: int) -> Column:
    return jump_walk(key, n_shards)["at"].cast("int")


def dealt_copies(groups: DataFrame, times: str, name: str, most: int) -> DataFrame:
    """Each row of ``groups`` as often as its column ``times`` says, numbered from 0 in ``name``.

    A group of more than ``most`` is first dealt out in pieces of that size, so that no task makes
    an unbounded number of rows from one.
    """
    n = F.col(times)
    few = groups.where(n <= most).withColumn(name, F.explode(F.sequence(F.lit(0).cast("long"), n - 1)))
    many = groups.where(n > most).withColumn(name, F.explode(F.sequence(F.lit(0).cast("long"), F.floor((n - 1) / most))))
    piece = F.col(name) * most
    many = many.repartition(F.col(name), F.xxhash64(*groups.columns)).withColumn(name, F.explode(F.sequence(piece, F.least(piece + most, n) - 1)))
    return few.unionByName(many)


def assign_shards(docs: DataFrame, n_shards: int = 24, rows_per_block: int = ROWS_PER_BLOCK) -> DataFrame:
    """Place every row of ``docs`` into one of ``n_shards`` by jump consistent hashing of doc_id.

    Returns doc_id, size (UTF-8 bytes plus 8), text_crc32, law ('key'), shard, slot (gapless
    from 0 inside the shard) and grown_shard (with one shard more).

    A null text counts as empty: size 8, crc32 0. A null doc_id is a key like any other.
    Rows with the same doc_id share a shard and get slots of their own; ties are broken by
    checksum and size, so reruns agree. An empty table gives an empty result. Other columns
    are ignored, whatever their names.

    Rows that are equal in all of this are counted first and numbered together, so copies of one row
    cost one row, however many there are. Slots are numbered in (shard, block) groups, where the
    block is a hash of id and text and the number of blocks follows the row count; offsets
    come from the counts. A key that holds a third of all rows still fills as many blocks as any shard.
    """
    body = F.coalesce(F.col("text"), F.lit(""))
    rows = docs.select("doc_id", (F.octet_length(body).cast("long") + 8).alias("size"), F.crc32(body.cast("binary")).alias("text_crc32"))
    rows = rows.groupBy("doc_id", "size", "text_crc32").agg(F.count(F.lit(1)).alias("copies"))
    blocks = max(1, math.ceil(docs.count() / (n_shards * rows_per_block)))
    block = F.pmod(F.xxhash64("doc_id", "size", "text_crc32", F.lit("slot")), F.lit(blocks)).cast("int")
    placed = rows.withColumn("walk", jump_walk(F.col("doc_id"), n_shards)).withColumn("block", block).select(
        "doc_id",
        "size",
        "text_crc32",
        "copies",
        F.col("walk.at").cast("int").alias("shard"),
        F.when(F.col("walk.next") < n_shards + 1, F.col("walk.next")).otherwise(F.col("walk.at")).cast("int").alias("grown_shard"),
        "block",
    )
    counts = placed.groupBy("shard", "block").agg(F.sum("copies").alias("rows"))
    before = W.partitionBy("shard").orderBy("block").rowsBetween(W.unboundedPreceding, -1)
    offsets = counts.select("shard", "block", F.coalesce(F.sum("rows").over(before), F.lit(0).cast("long")).alias("before"))
    within = W.partitionBy("shard", "block").orderBy("doc_id", "text_crc32", "size").rowsBetween(W.unboundedPreceding, -1)
    numbered = placed.withColumn("earlier", F.coalesce(F.sum("copies").over(within), F.lit(0).cast("long")))
    groups = numbered.join(offsets, ["shard", "block"]).select("doc_id", "size", "text_crc32", "copies", "shard", "grown_shard", (F.col("before") + F.col("earlier")).alias("at"))
    return dealt_copies(groups, "copies", "nth", rows_per_block).select(
        "doc_id",
        "size",
        "text_crc32",
        F.lit("key").alias("law"),
        "shard",
        (F.col("at") + F.col("nth")).alias("slot"),
        "grown_shard",
    )
