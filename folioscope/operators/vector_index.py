"""An inverted-file index over vectors: cells around centroids, some of which are searched, with exact rescoring.

Centroids are fitted on a bounded sample; every vector is indexed. A query looks into its ``probes`` nearest cells
and scores all vectors there exactly, so only neighbours in other cells can be missed: with as many
probes as cells the result is that of ``neighbors.nearest``, which stays the exact way. Cells and their
queries are dealt in blocks of bounded size, so a cell with a third of all vectors is many tasks.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from folioscope.functions.vectors import SMALL_NORM, norm
from folioscope.operators.neighbors import FOUND, QUERY_BLOCK, best_in_block, nearest
from folioscope.session import stored

#: Vectors that the centroids are fitted on, about; cells at most (their centroids go to every task).
SAMPLE_ROWS, MOST_CELLS, ROUNDS = 20_000, 4096, 10
#: Numbers that a task holds at once as it deals vectors to cells, about.
CELLED_NUMBERS = 2_000_000


class VectorIndex(NamedTuple):
    """rows: cell, work_id, cluster_id, vector; sizes: cell, n (a row a cell); centroids of length one."""

    rows: DataFrame
    sizes: DataFrame
    centroids: np.ndarray


def _unit(vectors) -> np.ndarray:
    x = np.array(list(vectors), float)
    return x / np.maximum(np.linalg.norm(x, axis=1), SMALL_NORM)[:, None]


def fit_centroids(sample: np.ndarray, cells: int, seed: int = 5, rounds: int = ROUNDS) -> np.ndarray:
    """Centroids by cosine: spread-out first ones, then means of what is nearest; an empty cell takes a far vector."""
    rng = np.random.default_rng(seed)
    centroids = sample[rng.choice(len(sample), min(cells, len(sample)), replace=False)]
    for _ in range(rounds):
        near = sample @ centroids.T
        of = near.argmax(1)
        total = np.zeros_like(centroids)
        np.add.at(total, of, sample)
        empty = np.flatnonzero(np.bincount(of, minlength=len(centroids)) == 0)
        total[empty] = sample[np.argsort(near.max(1), kind="stable")[: len(empty)]]
        centroids = _unit(total)
    return centroids


def _celled(df: DataFrame, centroids: np.ndarray, probes: int) -> DataFrame:
    """Each row once for each of its ``probes`` nearest cells."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            # as many rows at once as bound the products and the repeated vectors
            step = max(1, CELLED_NUMBERS // max(len(centroids), min(probes, len(centroids)) * centroids.shape[1]))
            for begin in range(0, len(pdf), step):
                part = pdf.iloc[begin : begin + step].reset_index(drop=True)
                cells = np.argsort(-(_unit(part["vector"]) @ centroids.T), axis=1, kind="stable")[:, :probes]
                out = part.loc[part.index.repeat(cells.shape[1])].reset_index(drop=True)
                out["cell"] = cells.ravel().astype("int32")
                yield out[["cell", "work_id", "cluster_id", "vector"]]

    return df.select("work_id", "cluster_id", "vector").mapInPandas(run, "cell int, work_id long, cluster_id string, vector array<double>")


def build_vector_index(vectors: DataFrame, cells: int | None = None, sample_rows: int = SAMPLE_ROWS) -> VectorIndex | None:
    """Index all vectors with a direction; None if there are none. By default there are as many cells as the root of the rows."""
    usable = vectors.where(norm(F.col("vector")) >= SMALL_NORM).select("work_id", "cluster_id", F.col("vector").cast("array<double>").alias("vector"))
    n = usable.count()
    if not n:
        return None
    slots = 1_000_000_000
    keep = slots if n <= sample_rows else int(slots * sample_rows / n)
    picked = usable.where(F.pmod(F.xxhash64("work_id", F.lit("cells")), F.lit(slots)) < keep).orderBy("work_id").select("vector").toPandas()
    centroids = fit_centroids(_unit(picked["vector"]) if len(picked) else _unit(usable.limit(1).toPandas()["vector"]), min(MOST_CELLS, cells or max(1, round(n**0.5))))
    rows = stored(_celled(usable, centroids, 1).repartitionByRange("cell", "work_id"), "vector-cells")
    return VectorIndex(rows, stored(rows.groupBy("cell").agg(F.count(F.lit(1)).alias("n")), "cell-sizes"), centroids)


def probes_for(index: VectorIndex, k: int, recall: float = 0.97, sample: int = 128) -> int:
    """The fewest probes that find ``recall`` of the k exact neighbours of ``sample`` indexed vectors, chosen by a hash.

    Each exact neighbour needs as many probes as the place of its cell in the order of its query, so one exact search of
    a bounded sample decides; sample x k rows come to the driver.
    """
    picked = stored(index.rows.orderBy(F.xxhash64("work_id", F.lit("probes")), "work_id").limit(sample).select("work_id", "cluster_id", "vector"), "probe-sample")
    exact = nearest(index.rows.select("work_id", "cluster_id", "vector"), picked, k).select("query_id", "work_id")
    met = exact.join(index.rows.select("work_id", "cell"), "work_id").select("query_id", "cell").toPandas()
    if not len(met):
        return 1
    own = picked.select("work_id", "vector").toPandas().drop_duplicates("work_id")
    order = np.argsort(-(_unit(own["vector"]) @ index.centroids.T), axis=1, kind="stable")
    place = dict(zip(own["work_id"], np.argsort(order, axis=1), strict=True))
    needed = np.sort([place[q][c] + 1 for q, c in zip(met["query_id"], met["cell"], strict=True)])
    return int(needed[min(len(needed) - 1, int(np.ceil(recall * len(needed))) - 1)])


def nearest_by_index(index: VectorIndex, queries: DataFrame, k: int, probes: int = 8, block: int = QUERY_BLOCK) -> DataFrame:
    """(query_id, work_id, cluster_id, similarity, nth) of the k nearest works that the probed cells hold, but not the query itself."""
    usable = queries.where(norm(F.col("vector")) >= SMALL_NORM).select("work_id", "cluster_id", F.col("vector").cast("array<double>").alias("vector"))
    asked = stored(_celled(usable, index.centroids, probes), "probes")
    blocks = lambda n: F.greatest(F.lit(1), F.ceil(n / F.lit(block))).cast("int")
    many = index.sizes.join(asked.groupBy("cell").agg(F.count(F.lit(1)).alias("m")), "cell").select("cell", blocks(F.col("n")).alias("row_blocks"), blocks(F.col("m")).alias("query_blocks"))
    # a row a cell, MOST_CELLS at most
    many = F.broadcast(many)

    def dealt(side: DataFrame, own: str, other: str, mark: int) -> DataFrame:
        mine = F.pmod(F.xxhash64("work_id"), F.col(f"{own}_blocks")).cast("int")
        return side.join(many, "cell").withColumn(own, mine).withColumn(other, F.explode(F.sequence(F.lit(0), F.col(f"{other}_blocks") - 1))).withColumn("side", F.lit(mark))

    columns = ["cell", "row", "query", "side", "work_id", "vector", "cluster_id"]
    both = dealt(asked, "query", "row", 0).select(columns).unionByName(dealt(index.rows, "row", "query", 1).select(columns))
    found = both.groupBy("cell", "row", "query").applyInArrow(lambda t: best_in_block(t, k), FOUND)
    nth = F.row_number().over(W.partitionBy("query_id").orderBy(F.desc("similarity"), "work_id"))
    return found.withColumn("nth", nth).where(F.col("nth") <= k)
