"""Nearest neighbours, cluster boundaries, slice fit and k-means over stored vectors.

Neighbour search is exact and in blocks: a set of stated queries meets every row in matrix
products inside tasks, each task keeps the best k for each query, and the partial lists are
merged by key. Both sides are dealt into blocks of bounded size, so that no task holds more.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from folioscope.functions.vectors import SMALL_NORM, cosine, dot, mean_vectors, norm, squared_distance

QUERY_BLOCK = 1024
#: Pairs of blocks while no block is full, blocks of rows among them, rows of a full block, and products held at once.
GROUPS, ROW_BLOCKS, MOST_ROWS, TILE = 88, 8, 65_536, 4_000_000


def similar_to(vectors: DataFrame, work_id: int, k: int) -> DataFrame:
    """The k works most similar to one work, by cosine; ties by id."""
    target = vectors.where(F.col("work_id") == work_id).select(F.col("vector").alias("target"))
    # one row, by key
    near = vectors.where(F.col("work_id") != work_id).crossJoin(F.broadcast(target)).withColumn("c", cosine(F.col("vector"), F.col("target")))
    return near.where("c is not null").orderBy(F.desc("c"), "work_id").limit(k).select("work_id", F.round("c", 4).alias("similarity"))


SIMILAR_SQL = """
WITH q AS (SELECT vec_id AS query_id, embedding::DOUBLE[] AS q FROM embeddings WHERE vec_id % 100 = 0),
p AS (SELECT query_id, vec_id AS work_id, list_cosine_similarity(embedding::DOUBLE[], q) AS s FROM embeddings, q WHERE vec_id <> query_id),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY s DESC, work_id) AS nth FROM p)
SELECT query_id, work_id, CAST(nth AS INTEGER) AS nth, round(s, 4) AS similarity FROM r WHERE nth <= 15"""


def deal(queries: int, rows: int, block: int = QUERY_BLOCK) -> tuple[int, int]:
    """Blocks that ``queries`` and ``rows`` are dealt into: of ``block`` rows while there are few, then ever larger ones.

    At most GROUPS pairs of blocks, so each side is shuffled a fixed number of times, until a block has MOST_ROWS rows.
    """
    least = [max(1, -(-n // MOST_ROWS)) for n in (queries, rows)]
    row_blocks = max(least[1], min(max(1, -(-rows // block)), ROW_BLOCKS))
    query_blocks = max(least[0], min(max(1, -(-queries // block)), max(1, GROUPS // row_blocks)))
    # a few queries leave room for more blocks of rows
    return query_blocks, max(row_blocks, min(max(1, -(-rows // block)), GROUPS // query_blocks))


def _matrix(column: pa.ChunkedArray) -> np.ndarray:
    vectors = column.combine_chunks()
    return vectors.flatten().to_numpy(zero_copy_only=False).reshape(len(vectors), -1)


def _classes(x: np.ndarray, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Groups of equal vectors: all places by (group, id), where each group begins among them, and the groups' sizes."""
    keys = np.ascontiguousarray(x).view(np.dtype((np.void, x.shape[1] * x.itemsize))).ravel()
    of = np.unique(keys, return_inverse=True)[1].ravel()
    sizes = np.bincount(of)
    return np.lexsort((ids, of)), np.cumsum(sizes) - sizes, sizes


def _spans(starts: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each span its number, repeated, and the places in it."""
    of = np.repeat(np.arange(len(sizes)), sizes)
    return of, np.arange(len(of)) - np.repeat(np.cumsum(sizes) - sizes, sizes) + starts[of]


def _first(group: np.ndarray, n: int) -> np.ndarray:
    """The places of the first n entries of each group; groups stand together."""
    new = np.flatnonzero(np.r_[True, group[1:] != group[:-1]]) if len(group) else np.zeros(0, int)
    lengths = np.diff(np.r_[new, len(group)])
    return np.flatnonzero(np.arange(len(group)) - np.repeat(new, lengths) < n)


def _similar(a: np.ndarray, b: np.ndarray, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """Cosines of the pairs of columns (i, j): sums in the order of the elements, so equal vectors tie wherever they stand."""
    dot, left, right = (np.zeros(len(i)) for _ in range(3))
    for x, y in zip(a, b, strict=True):
        u, v = x[i], y[j]
        dot += u * v
        left += u * u
        right += v * v
    return np.clip(dot / np.sqrt(left * right), -1.0, 1.0)


def _least_of_best(s: np.ndarray, k: int) -> np.ndarray:
    """A bound that the k largest entries of each row reach: the k-th of the maxima of some columns each, which is close to it."""
    width = max(256, 16 * k)
    if s.shape[1] > 4 * width:
        s = s[:, : s.shape[1] // width * width].reshape(len(s), -1, width).max(axis=1)
    if s.shape[1] <= k:
        return np.full(len(s), -np.inf, s.dtype)
    return np.partition(s, -k, axis=1)[:, -k]


def best_of(queries: tuple[np.ndarray, np.ndarray], rows: tuple[np.ndarray, np.ndarray], k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(query id, place of the row, similarity) of the k rows most similar to each query but itself; ties by smaller id.

    Both sides are (ids, vectors). Equal vectors are compared once. Single precision leaves, with a margin for its
    error, a few candidates for each query; their similarities are then computed in full.
    """
    (query_ids, x), (row_ids, y) = queries, rows
    at_q, from_q, size_q = _classes(x, query_ids)
    at_r, from_r, size_r = _classes(y, row_ids)
    # as many as the query's own id has rows may fall away
    most = k + int(np.unique(row_ids, return_counts=True)[1].max())
    a, b = x[at_q[from_q]], y[at_r[from_r]]
    unit = lambda v: (v / np.linalg.norm(v, axis=1)[:, None]).astype(np.float32)
    small_a, small_b = unit(a), unit(b).T
    margin = np.float32(4e-7 * (x.shape[1] + 8))
    a, b = np.ascontiguousarray(a.T), np.ascontiguousarray(b.T)
    step, out = max(1, TILE // len(size_r)), []
    for begin in range(0, len(size_q), step):
        s = small_a[begin : begin + step] @ small_b
        found = np.flatnonzero(s >= (_least_of_best(s, most) - margin)[:, None])
        i, j = found // s.shape[1], found % s.shape[1]
        score = _similar(a, b, i + begin, j)
        order = np.lexsort((row_ids[at_r[from_r[j]]], -score, i))
        order = order[_first(i[order], most)]
        # groups of equal vectors become rows again, first those of the row side
        pair, place = _spans(from_r[j[order]], np.minimum(size_r[j[order]], most))
        i, score, place = i[order][pair], score[order][pair], at_r[place]
        order = np.lexsort((row_ids[place], -score, i))
        order = order[_first(i[order], most)]
        i, score, place = i[order], score[order], place[order]
        starts = np.searchsorted(i, np.arange(len(s)))
        lengths = np.searchsorted(i, np.arange(len(s)), "right") - starts
        of, member = _spans(from_q[begin : begin + step], size_q[begin : begin + step])
        nth, entry = _spans(starts[of], lengths[of])
        query = at_q[member][nth]
        other = row_ids[place[entry]] != query_ids[query]
        query, entry = query[other], entry[other]
        kept = _first(query, k)
        out.append((query_ids[query[kept]], place[entry[kept]], score[entry[kept]]))
    return tuple(np.concatenate(parts) for parts in zip(*out, strict=True))


FOUND = "query_id long, work_id long, cluster_id string, similarity double"


def best_in_block(block: pa.Table, k: int) -> pa.Table:
    """The k rows (side 1) most similar to each query (side 0) of one block, but not the query itself; ties by smaller id."""
    sides = [block.filter(pc.equal(block["side"], side)) for side in (0, 1)]
    parts = []
    for t in sides:
        x = _matrix(t["vector"]).astype(np.float64, copy=False) if len(t) else np.zeros((0, 1))
        keep = np.flatnonzero(np.isfinite(x).all(axis=1))
        parts.append((t["work_id"].to_numpy()[keep], x[keep], t["cluster_id"].combine_chunks().take(pa.array(keep))))
    (query_ids, x, _), (row_ids, y, names) = parts
    none = (np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0))
    query, place, score = best_of((query_ids, x), (row_ids, y), k) if len(query_ids) and len(row_ids) else none
    return pa.table({"query_id": pa.array(query, pa.int64()), "work_id": pa.array(row_ids[place], pa.int64()), "cluster_id": names.take(pa.array(place)), "similarity": pa.array(score)})


def nearest(vectors: DataFrame, queries: DataFrame, k: int, block: int = QUERY_BLOCK) -> DataFrame:
    """(query_id, work_id, cluster_id, similarity, nth) of the k nearest works of every query but itself.

    ``vectors`` and ``queries`` have work_id, vector and cluster_id. Vectors without a
    direction take no part. Both sides are dealt into blocks; every pair of a query block and a
    row block is one group, and leaves k rows for each query.
    """
    usable = [d.where(norm(F.col("vector")) >= SMALL_NORM).select("work_id", "vector", "cluster_id") for d in (queries, vectors)]
    counts = deal(*[d.count() for d in usable], block)
    dealt = [d.withColumn("block", F.pmod(F.xxhash64("work_id"), F.lit(n))) for d, n in zip(usable, counts, strict=True)]
    left = dealt[0].withColumnRenamed("block", "qb").withColumn("rb", F.explode(F.sequence(F.lit(0), F.lit(counts[1] - 1)))).withColumn("side", F.lit(0))
    right = dealt[1].withColumnRenamed("block", "rb").withColumn("qb", F.explode(F.sequence(F.lit(0), F.lit(counts[0] - 1)))).withColumn("side", F.lit(1))
    columns = ["qb", "rb", "side", "work_id", "vector", "cluster_id"]

    found = left.select(columns).unionByName(right.select(columns)).groupBy("qb", "rb").applyInArrow(lambda t: best_in_block(t, k), FOUND)
    nth = F.row_number().over(W.partitionBy("query_id").orderBy(F.desc("similarity"), "work_id"))
    return found.withColumn("nth", nth).where(F.col("nth") <= k)


def neighbor_mix(vectors: DataFrame, k: int = 15) -> DataFrame:
    """(work_id, eligible, mix_score, foreign_count): the share of the k nearest works in other clusters.

    A work is ineligible, without a score, if it has fewer than k neighbours.
    """
    near = nearest(vectors, vectors, k).withColumnRenamed("cluster_id", "their_cluster")
    own = vectors.select(F.col("work_id").alias("query_id"), "cluster_id")
    counted = near.join(own, "query_id").groupBy("query_id").agg(F.count(F.lit(1)).alias("n"), F.sum((F.col("their_cluster") != F.col("cluster_id")).cast("long")).alias("foreign"))
    full = F.coalesce(F.col("n") >= k, F.lit(False))
    return own.join(counted, "query_id", "left").select(F.col("query_id").alias("work_id"), full.alias("eligible"), F.when(full, F.col("foreign") / F.lit(float(k))).alias("mix_score"), F.when(full, F.col("foreign")).alias("foreign_count"))


NEIGHBOR_MIX_SQL = """
WITH p AS (SELECT a.vec_id AS work_id, a.label <> b.label AS f, row_number() OVER (PARTITION BY a.vec_id ORDER BY list_cosine_similarity(a.embedding::DOUBLE[], b.embedding::DOUBLE[]) DESC, b.vec_id) AS nth
  FROM embeddings a JOIN embeddings b ON a.vec_id <> b.vec_id)
SELECT work_id, true AS eligible, sum(f::INT) / 15.0::DOUBLE AS mix_score, CAST(sum(f::INT) AS BIGINT) AS foreign_count FROM p WHERE nth <= 15 GROUP BY work_id"""


def bridge_boundary(vectors: DataFrame, epsilon: float = 1e-12) -> DataFrame:
    """(work_id, boundary): squared distance to the own centroid over that to the nearest other one.

    Clamped to [0, 1]; null with fewer than two clusters. All centroids travel in one row, so
    each work meets them inside an expression and nothing is multiplied out.
    """
    centroids = mean_vectors(vectors, "vector", "cluster_id")
    all_of_them = centroids.agg(F.collect_list(F.struct("cluster_id", "mean")).alias("centroids"))
    v = vectors.crossJoin(F.broadcast(all_of_them))
    far = F.transform("centroids", lambda c: F.struct(c["cluster_id"].alias("id"), squared_distance(F.col("vector"), c["mean"]).alias("d")))
    v = v.select("work_id", "cluster_id", far.alias("far"))
    own = F.array_min(F.transform(F.filter("far", lambda x: x["id"] == F.col("cluster_id")), lambda x: x["d"]))
    rest = F.array_min(F.transform(F.filter("far", lambda x: x["id"] != F.col("cluster_id")), lambda x: x["d"]))
    return v.select("work_id", F.when(rest.isNotNull(), F.greatest(F.lit(0.0), F.least(F.lit(1.0), own / F.greatest(rest, F.lit(epsilon))))).alias("boundary"))


BOUNDARY_SQL = """
WITH e AS (SELECT vec_id AS work_id, label, unnest(embedding)::DOUBLE AS x, unnest(range(64)) AS i FROM embeddings),
c AS (SELECT label AS cl, i, avg(x) AS m FROM e GROUP BY label, i),
d AS (SELECT work_id, label, cl, sum((x - m) * (x - m)) AS d FROM e JOIN c USING (i) GROUP BY work_id, label, cl)
SELECT work_id, round(greatest(0.0, least(1.0, min(d) FILTER (WHERE cl = label) / greatest(min(d) FILTER (WHERE cl <> label), 1e-12))), 6) AS boundary FROM d GROUP BY work_id"""


def slice_fit(vectors: DataFrame) -> DataFrame:
    """(work_id, fit): cosine to the mean vector of all works, moved to [0, 1]; 0.5 if the mean has no direction."""
    centre = mean_vectors(vectors, "vector")
    # one row
    v = vectors.crossJoin(F.broadcast(centre))
    size = norm(F.col("mean"))
    c = dot(F.col("vector"), F.col("mean")) / ((norm(F.col("vector")) + 1e-12) * (size + 1e-12))
    return v.select("work_id", F.when(size < 1e-10, 0.5).otherwise(F.greatest(F.lit(0.0), F.least(F.lit(1.0), (c + 1) / 2))).alias("fit"))


SLICE_FIT_SQL = """
WITH e AS (SELECT vec_id AS work_id, unnest(embedding)::DOUBLE AS x, unnest(range(64)) AS i FROM embeddings), c AS (SELECT i, avg(x) AS m FROM e GROUP BY i)
SELECT work_id, round((sum(x * m) / (sqrt(sum(x * x)) * sqrt(sum(m * m))) + 1) / 2, 6) AS fit FROM e JOIN c USING (i) GROUP BY work_id"""


def kmeans(vectors: DataFrame, k: int = 12, most_rounds: int = 20) -> DataFrame:
    """(work_id, cluster_id): Lloyd's algorithm from the first k vectors by id.

    Ties go to the lower cluster, an empty cluster keeps its centroid, and the last assignment
    is returned once it repeats. The k centroids (k is a parameter) are the only rows that come
    to the driver; points stay in their tasks, and only sums of each cluster are shuffled.
    """
    points = vectors.select("work_id", "vector")
    seeds = points.orderBy("work_id").limit(k).collect()
    if not seeds:
        return points.select("work_id", F.lit("").alias("cluster_id"))
    centroids = np.array([r["vector"] for r in seeds])
    before = None
    for _ in range(most_rounds):
        now = centroids.copy()

        def assign(batches: Iterator[pd.DataFrame], now: np.ndarray = now) -> Iterator[pd.DataFrame]:
            for pdf in batches:
                if len(pdf):
                    x = np.array(pdf["vector"].tolist())
                    d = np.stack([((x - c) ** 2).sum(1) for c in now], 1)
                    yield pd.DataFrame({"work_id": pdf["work_id"], "cluster": d.argmin(1), "vector": pdf["vector"]})

        assigned = points.mapInPandas(assign, "work_id long, cluster int, vector array<double>")
        mark = assigned.agg(F.bit_xor(F.xxhash64("work_id", "cluster"))).first()[0]
        if mark == before:
            break
        before = mark
        for r in mean_vectors(assigned, "vector", "cluster").collect():
            centroids[r["cluster"]] = r["mean"]
    return assigned.select("work_id", F.format_string("c%03d", "cluster").alias("cluster_id"))
