"""Connected components of an edge table, by alternating large and small stars.

Each round shortens every path to its smallest node; the graph ends as a forest of stars whose
centres are the smallest nodes. Nothing comes to the driver but a count and a checksum.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from folioscope.llm.common import written


def _both(edges: DataFrame) -> DataFrame:
    return edges.select("a", "b").unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))


def _large_star(edges: DataFrame) -> DataFrame:
    """Each node joins its larger neighbours to the smallest node it knows."""
    near = _both(edges)
    least = near.groupBy("a").agg(F.least(F.col("a"), F.min("b")).alias("m"))
    return near.where("b > a").join(least, "a").select(F.col("m").alias("a"), "b").where("a <> b").distinct()


def _small_star(edges: DataFrame) -> DataFrame:
    """Each node joins itself and its smaller neighbours to the smallest of them."""
    down = edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    least = down.groupBy("a").agg(F.min("b").alias("m"))
    met = down.join(least, "a")
    joined = met.select(F.col("m").alias("a"), "b").unionByName(least.select(F.col("m").alias("a"), F.col("a").alias("b")))
    return joined.where("a <> b").distinct()


def _state(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count(F.lit(1)), F.bit_xor(F.xxhash64("a", "b"))).first())


def components(edges: DataFrame, most_rounds: int = 100) -> DataFrame:
    """(node, root) for each node of the edges (a, b); root is the smallest node of its component.

    Edges with a null end or from a node to itself are ignored; without edges there are no rows.
    """
    now = written(edges.where("a is not null and b is not null and a <> b").select("a", "b").distinct(), "edges")
    before = _state(now)
    for _ in range(most_rounds):
        now = written(_small_star(_large_star(now)), "edges")
        after = _state(now)
        if after == before:
            break
        before = after
    else:
        raise RuntimeError("components did not settle")
    leaves = now.select(F.col("b").alias("node"), F.col("a").alias("root"))
    return leaves.unionByName(now.select(F.col("a").alias("node"), F.col("a").alias("root")).distinct())
