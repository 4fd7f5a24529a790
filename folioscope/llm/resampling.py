"""Target-distribution importance resampling: the documents most like a target, drawn by noisy weights.

1. All features (runs of words) of the documents and of the target texts are counted by bucket. A bucket's
   gain tells how much likelier it is in the target; the gains are one array of a fixed number of entries,
   and a document's weight is the floored mean of the entries that its features fall on.
2. Fixed noise from a hash of doc_id makes the draw a sample without replacement (Gumbel top-k).
3. The draw: the lowest drawn score follows from the counts by score, of which there are boundedly many. Rows from
   there up are sorted into bounded runs in each partition, dealt out by ranges of the order, and each
   range merges its runs by a tournament tree. Offsets are the counts of the ranges before, and the
   ranks end after exactly as many rows as are drawn.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from folioscope.llm.common import small_batches, written
from folioscope.llm.sharding import dealt_copies
from folioscope.llm.words import LOWER, PLAIN, Words, blocks, grams

#: Buckets of features, draws of a hundred eligible documents, least words of an eligible one, and the seed; fixed by the contract.
BUCKETS, PERCENT, LEAST_WORDS, SEED = 10_000, 10, 20, 2024
#: Rows of a sorted run, and of a range of the order on average.
RUN_ROWS, RANGE_ROWS = 1 << 16, 1 << 12


def feature_buckets(data: np.ndarray, w: Words, most_words: int, buckets: int) -> tuple[np.ndarray, np.ndarray]:
    """(document, bucket) of each feature of a block: crc32 of the words of a run, joined by one space.

    Each distinct run is hashed once; runs are told apart by 64-bit hashes.
    """
    h, doc = w.hashes(data), w.doc()
    docs, found = [], []
    for n in range(1, most_words + 1):
        g = grams(h, n) if n > 1 else h
        at = np.flatnonzero(doc[: len(g)] == doc[n - 1 : n - 1 + len(g)])
        _, first, which = np.unique(g[at], return_index=True, return_inverse=True)
        crc = np.zeros(len(first), np.int64)
        for k, i in enumerate(at[first].tolist()):
            crc[k] = zlib.crc32(b" ".join(data[w.start[j] : w.end[j]].tobytes() for j in range(i, i + n))) % buckets
        docs.append(doc[at])
        found.append(crc[which])
    return np.concatenate(docs), np.concatenate(found)


def _count(batches: Iterator[pa.RecordBatch], most_words: int, buckets: int) -> Iterator[pa.RecordBatch]:
    """Features by bucket of all texts of a task."""
    total = np.zeros(buckets, np.int64)
    for batch in batches:
        for _, _, data, offsets in blocks(batch.column(0)):
            data = LOWER[data]
            total += np.bincount(feature_buckets(data, Words(data, offsets, PLAIN), most_words, buckets)[1], minlength=buckets)
    some = np.flatnonzero(total)
    yield pa.RecordBatch.from_arrays([pa.array(some), pa.array(total[some])], names=["bucket", "count"])


def bucket_counts(texts: DataFrame, most_words: int = 1, buckets: int = BUCKETS) -> DataFrame:
    """bucket, count over all rows of ``texts``; buckets without a feature are absent."""
    small_batches(texts.sparkSession)
    each = texts.select("text").mapInArrow(lambda it: _count(it, most_words, buckets), "bucket long, count long")
    return each.groupBy("bucket").agg(F.sum("count").alias("count"))


def bucket_gains(docs: DataFrame, target: DataFrame, most_words: int = 1, buckets: int = BUCKETS) -> np.ndarray:
    """The gain of each bucket, in thousandths: an array of ``buckets`` whole numbers."""
    own, wanted = (bucket_counts(x, most_words, buckets).withColumnRenamed("count", n) for x, n in ((docs, "s"), (target, "t")))
    both = own.join(wanted, "bucket", "full").toPandas().fillna(0)  # a row for each bucket at most
    s, t = np.zeros(buckets), np.zeros(buckets)
    at = both["bucket"].to_numpy().astype(np.int64)
    s[at], t[at] = both["s"], both["t"]
    return np.floor(1000 * np.log((t + 1) * (s.sum() + buckets) / ((s + 1) * (t.sum() + buckets)))).astype(np.int64)


def _weigh(batches: Iterator[pa.RecordBatch], gains: np.ndarray, most_words: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for lo, hi, data, offsets in blocks(batch.column(1)):
            data = LOWER[data]
            w = Words(data, offsets, PLAIN)
            doc, bucket = feature_buckets(data, w, most_words, len(gains))
            n = np.bincount(doc, minlength=hi - lo)
            total = np.bincount(doc, gains[bucket], hi - lo).astype(np.int64)  # sums of whole numbers, exact in doubles
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).slice(lo, hi - lo), pa.array(np.diff(w.first).astype(np.int64)), pa.array(n.astype(np.int64)), pa.array(np.where(n > 0, total // np.maximum(n, 1), 0))],
                names=["doc_id", "n_words", "n_features", "weight"],
            )


def noise(doc_id: Column, seed: int) -> Column:
    """Gumbel noise in thousandths from the first 32 bits of a sha256 of seed and id; a null id counts as an empty one."""
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(doc_id.cast("string"), F.lit(""))), 256)
    h = F.conv(F.substring(digest, 1, 8), 16, 10).cast("double")
    return F.floor(F.lit(-1000.0) * F.log(-F.log((h + 0.5) / 4294967296.0)))


def scored_documents(docs: DataFrame, target: DataFrame, most_words: int = 1, buckets: int = BUCKETS, seed: int = SEED) -> DataFrame:
    """doc_id, n_words, n_features, weight and score of each row of ``docs``."""
    small_batches(docs.sparkSession)
    gains = bucket_gains(docs, target, most_words, buckets)
    weighed = docs.select(docs["doc_id"], docs["text"]).mapInArrow(lambda it: _weigh(it, gains, most_words), "doc_id long, n_words long, n_features long, weight long")
    return weighed.withColumn("score", F.col("weight") + noise(F.col("doc_id"), seed))


class Tournament:
    """A k-way merge of sorted runs: a tree of matches whose root is the run with the least row.

    Taking a row replays only the matches between that run's leaf and the root.
    """

    def __init__(self, runs: list[Iterator[tuple]]):
        self.runs = runs
        self.leaves = 1 << max(0, (len(runs) - 1).bit_length())
        self.heads: list[tuple | None] = [next(r, None) for r in runs] + [None] * (self.leaves - len(runs))
        self.winner = [0] * self.leaves + list(range(self.leaves))
        for match in range(self.leaves - 1, 0, -1):
            self.winner[match] = self._better(self.winner[2 * match], self.winner[2 * match + 1])

    def _better(self, a: int, b: int) -> int:
        x, y = self.heads[a], self.heads[b]
        return a if y is None or (x is not None and x <= y) else b

    def __iter__(self) -> Iterator[tuple]:
        while self.runs:
            won = self.winner[1] if self.leaves > 1 else 0
            row = self.heads[won]
            if row is None:
                return
            self.heads[won] = next(self.runs[won], None)
            match = (self.leaves + won) // 2
            while match:
                self.winner[match] = self._better(self.winner[2 * match], self.winner[2 * match + 1])
                match //= 2
            yield row

    def rest(self) -> Iterator[tuple]:
        """What has not been taken, run by run."""
        for head, run in zip(self.heads, self.runs, strict=False):
            if head is not None:
                yield head
                yield from run


#: Columns of a row in a run, in the order of the draw: highest score first, then smaller id, null ids last.
_KEY = ("down", "none", "doc_id", "weight", "n_features", "copies")
_RUN_DDL = "run long, " + ", ".join(f"{c} long" for c in _KEY)


def _runs(batches: Iterator[pa.RecordBatch], rows: int) -> Iterator[pa.RecordBatch]:
    """The rows of a task in sorted runs of at most ``rows``."""
    task, made, held, size = TaskContext.get().partitionId(), 0, [], 0

    def run() -> pa.RecordBatch:
        table = pa.Table.from_batches(held).combine_chunks().sort_by([(c, "ascending") for c in _KEY])
        whole = table.to_batches()[0]
        return pa.RecordBatch.from_arrays([pa.array(np.full(len(whole), (task << 32) + made, np.int64)), *whole.columns], names=["run", *_KEY])

    for batch in batches:
        for lo in range(0, batch.num_rows, rows):
            part = batch.slice(lo, rows)
            if size and size + len(part) > rows:
                yield run()
                made, held, size = made + 1, [], 0
            held.append(part)
            size += len(part)
    if size:
        yield run()


_MERGED = pa.schema([("part", pa.int64()), ("place", pa.int64()), *[(c, pa.int64()) for c in _KEY]])


def _merge(batches: Iterator[pa.RecordBatch], draw: int) -> Iterator[pa.RecordBatch]:
    """The rows of one range in order, with the number of rows before them in the range.

    The rows come run by run, each run in order; a range has some thousand rows. The merge stops when it
    has as many rows as are drawn; those that remain are drawn under no offset and all get that number.
    """
    runs: dict[int, list] = {}
    for batch in batches:
        for run, *row in zip(*[c.to_pylist() for c in batch.columns], strict=True):
            runs.setdefault(run, []).append(tuple(row))
    part, place, out = TaskContext.get().partitionId(), 0, []
    order = Tournament([iter(r) for r in runs.values()])
    for row in order:
        out.append((part, place, *row))
        place += row[-1]
        if place >= draw:
            break
    out += [(part, place, *row) for row in order.rest()]
    for lo in range(0, len(out), 1 << 14):
        yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*out[lo : lo + (1 << 14)], strict=True)], schema=_MERGED)


def merged_ranks(rows: DataFrame, draw: int, run_rows: int = RUN_ROWS, range_rows: int = RANGE_ROWS) -> DataFrame:
    """doc_id, weight, n_features, score, copies and ``before``, the number of rows earlier in the order, for distinct ``rows`` (with copies).

    Runs, ranges and the merge hold some thousand rows at a time, whatever the input; only one count a range comes to the driver.
    """
    small_batches(rows.sparkSession)
    spread = max(8, -(-rows.count() // range_rows))
    keyed = rows.select((-F.col("score")).alias("down"), F.col("doc_id").isNull().cast("long").alias("none"), F.coalesce("doc_id", F.lit(0)).alias("doc_id"), "weight", "n_features", "copies")
    runs = keyed.mapInArrow(lambda it: _runs(it, run_rows), _RUN_DDL)
    dealt = runs.repartitionByRange(spread, *_KEY).sortWithinPartitions("run", *_KEY)
    merged = written(dealt.mapInArrow(lambda it: _merge(it, draw), "part long, place long, " + ", ".join(f"{c} long" for c in _KEY)), "resample-merged")
    counts = merged.groupBy("part").agg(F.max(F.col("place") + F.col("copies")).alias("rows")).toPandas().sort_values("part")
    offsets = rows.sparkSession.createDataFrame([(int(p), int(o)) for p, o in zip(counts["part"], counts["rows"].cumsum() - counts["rows"], strict=True)], "part long, offset long")
    own = F.when(F.col("none") == 0, F.col("doc_id")).alias("doc_id")
    return merged.join(offsets, "part").select(own, "weight", "n_features", (-F.col("down")).alias("score"), "copies", (F.col("offset") + F.col("place")).alias("before"))


def importance_resample(
    docs: DataFrame, target: DataFrame, percent: int = PERCENT, least_words: int = LEAST_WORDS, most_words: int = 1, buckets: int = BUCKETS, seed: int = SEED, run_rows: int = RUN_ROWS, range_rows: int = RANGE_ROWS
) -> DataFrame:
    """doc_id, n_features, weight, score and rank of each row of ``docs``; rank is null for rows that are not drawn.

    Of the rows with at least ``least_words`` words, ``percent`` in a hundred (rounded down) are drawn, highest
    scores first, ties to the smaller doc_id; a null id comes last and has the noise of an empty one.
    Null and empty texts have no features and weight 0. Rows equal in id, weight and features have
    ranks of their own, one after the other. Empty tables are allowed on either side (an empty target
    has gains that only discount what is frequent); other columns are ignored.
    """
    rows = written(scored_documents(docs, target, most_words, buckets, seed), "resample-scored")
    eligible = F.col("n_words") >= least_words
    # a score is the sum of two bounded whole numbers, so there are some ten thousand values at most
    by_score = rows.where(eligible).groupBy("score").count().toPandas().sort_values("score", ascending=False)
    draw = int(by_score["count"].sum()) * percent // 100
    columns = ("doc_id", "n_features", "weight", "score")
    if not draw:
        return rows.select(*columns, F.lit(None).cast("long").alias("rank"))
    cut = int(by_score["score"].to_numpy()[np.searchsorted(by_score["count"].cumsum().to_numpy(), draw)])
    above = eligible & (F.col("score") >= cut)
    # repeated rows are merged as one, so one id, however frequent, is no large range
    distinct = rows.where(above).groupBy(*columns).agg(F.count(F.lit(1)).alias("copies"))
    placed = merged_ranks(written(distinct, "resample-drawn"), draw, run_rows, range_rows)
    copies = dealt_copies(placed, "copies", "nth", range_rows).withColumn("rank", F.col("before") + F.col("nth") + 1)
    ranked = copies.select(*columns, F.when(F.col("rank") <= draw, F.col("rank")).alias("rank"))
    return rows.where(~above).select(*columns, F.lit(None).cast("long").alias("rank")).unionByName(ranked)
