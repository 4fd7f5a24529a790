"""Token ids in ORC files: run-length encoded ids, row indexes, Bloom filters on document ids.

Documents are range-partitioned by doc_id, sorted, tokenized and written, so that file names
in order hold ids in ascending doc_id order and each stripe covers a narrow range of ids.
Readers get stripe-parallel scans from Spark, and a lookup by doc_id skips files, stripes and
row groups by their minima, maxima and Bloom filters.

Each row keeps the number of ids before it in its own file; a table with one row for each
file then gives global positions.

Rows of one doc_id are dealt out by a hash of their text and by their place in the input, so an id that
holds a large share of all rows fills as many files as others would.
"""

from __future__ import annotations

import math
import os
import re
import uuid
import zlib
from collections.abc import Iterator
from itertools import chain, repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from folioscope.llm.common import shared_dir, small_batches, written
from folioscope.llm.words import LOWER, SPACED, Words, blocks, same_words

END_ID = 2
#: ORC settings: rows between row-index entries, bytes of a stripe, rate of false positives of the filters.
ROW_INDEX_STRIDE, STRIPE_BYTES, BLOOM_FPP = 1000, 16 << 20, 0.01
#: Rows of a file, on average, where that needs more files than Spark's own number of shuffle partitions.
ROWS_PER_FILE = 20_000
#: Distinct pieces whose ids a worker remembers; later ones are encoded again when they return.
REMEMBERED = 1_000_000

#: Pieces that are one token group for the pre-tokenizer, so that many can go through one call.
_LETTERS = re.compile("[A-Za-zß-öø-ÿÀ-ÖØ-Þ]+")
_STOP, _SMALL = np.zeros(256, bool), np.zeros(256, bool)
_STOP[list(b".,")] = True
_SMALL[97:123] = True


def tokenizer_path(name: str = "word_bpe_49k.json") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def pieces_of(data: np.ndarray, offsets: np.ndarray) -> tuple[Words, np.ndarray]:
    """The pieces of a block between white space, and the bytes by which they are compared.

    A full stop or comma that ends a word of small letters is a piece of its own, as it is for the
    pre-tokenizer. The case of A-Z is ignored, as the tokenizer does, unless the block has
    a mark of a special token, which is looked for before lower-casing.
    """
    low = data if b"<|" in data.tobytes() else LOWER[data]
    ends = np.zeros(len(data), bool)
    ends[:-1] = ~SPACED[data[1:]]
    ends = ~ends
    ends[offsets[1:][np.diff(offsets) > 0] - 1] = True
    stop = _STOP[low] & ends
    stop[1:] &= _SMALL[low[:-1]]
    return Words(data, offsets, SPACED, np.flatnonzero(stop[1:]) + 1), low


def distinct_pieces(data: np.ndarray, offsets: np.ndarray) -> tuple[Words, np.ndarray, np.ndarray, np.ndarray]:
    """(pieces, their bytes, one piece of each distinct kind, the kind of each piece)."""
    w, low = pieces_of(data, offsets)
    _, where, at = np.unique(w.hashes(low), return_index=True, return_inverse=True)
    length = w.end - w.start
    if len(w) and not ((length == length[where][at]) & same_words(low, w.start, w.start[where][at], length)).all():
        # two kinds share a hash: tell all pieces apart by their bytes
        raw = low.tobytes()
        kinds: dict[bytes, int] = {}
        at = np.array([kinds.setdefault(raw[a:b], len(kinds)) for a, b in zip(w.start.tolist(), w.end.tolist(), strict=True)], np.int64)
        where = np.unique(at, return_index=True)[1]
    return w, low, where, at


class Encoder:
    """Encodes texts piece by piece with the tokenizers library.

    This vocabulary's pre-tokenizer drops white space and no token reaches across it, so a
    text's ids are those of its pieces, one after the other. Each distinct piece goes through
    the library once as long as it is remembered. Hashes only sort the pieces of a block:
    which are equal is decided by their bytes.
    """

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.known: dict[bytes, int] = {}
        self.flat = np.zeros(1 << 16, np.int32)
        self.begin = np.zeros(1 << 14, np.int64)

    def _ids_of(self, pieces: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """(ids, number of ids of each piece)."""
        single = np.fromiter((_LETTERS.fullmatch(p) is not None for p in pieces), bool, len(pieces))
        size, found = np.zeros(len(pieces), np.int64), []
        letters, rest = np.flatnonzero(single), np.flatnonzero(~single)
        for lo in range(0, len(letters), 512):  # words of letters: many in one call, told apart by their number
            at = letters[lo : lo + 512]
            e = self.tokenizer.encode(" ".join([pieces[i] for i in at]), add_special_tokens=False)
            size[at] = np.bincount(np.array(e.word_ids, np.int64), minlength=len(at))
            found.append(e.ids)
        others = [e.ids for e in self.tokenizer.encode_batch_fast([pieces[i] for i in rest], add_special_tokens=False)]
        size[rest] = np.fromiter(map(len, others), np.int64, len(others))
        first = np.cumsum(size) - size
        ids = np.zeros(int(size.sum()), np.int32)
        for at, coded in ((letters, found), (rest, others)):
            n = size[at]
            place = np.arange(int(n.sum())) + np.repeat(first[at] - np.cumsum(n) + n, n)
            ids[place] = np.fromiter(chain.from_iterable(coded), np.int32, int(n.sum()))
        return ids, size

    def _learn(self, keys: list[bytes], pieces: list[str]) -> None:
        """Piece number k has flat[begin[k] : begin[k + 1]]."""
        ids, size = self._ids_of(pieces)
        k = len(self.known)
        self.known.update(zip(keys, range(k, k + len(keys)), strict=True))
        ends = self.begin[k] + np.cumsum(size)
        while len(self.begin) <= len(self.known):
            self.begin = np.concatenate([self.begin, np.zeros_like(self.begin)])
        while len(self.flat) < ends[-1]:
            self.flat = np.concatenate([self.flat, np.zeros_like(self.flat)])
        self.flat[self.begin[k] : ends[-1]] = ids
        self.begin[k + 1 : len(self.known) + 1] = ends

    def encode(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all texts of a block, bounds), END_ID after each text."""
        w, low, where, at = distinct_pieces(data, offsets)
        known, raw = self.known, low.tobytes()
        keys = [raw[a:b] for a, b in zip(w.start[where].tolist(), w.end[where].tolist(), strict=True)]
        number = np.fromiter(map(known.get, keys, repeat(-1)), np.int64, len(keys))
        new = np.flatnonzero(number < 0)
        fresh = [keys[i] for i in new.tolist()]
        if fresh:
            text = data.tobytes()
            here = where[new]
            self._learn(fresh, [text[a:b].decode() for a, b in zip(w.start[here].tolist(), w.end[here].tolist(), strict=True)])
            number[new] = np.arange(len(known) - len(new), len(known))
        lengths = (self.begin[number + 1] - self.begin[number])[at]
        # each text's ids move on by one place for every end before them
        total = np.concatenate([[0], np.cumsum(lengths)])
        bounds = total[w.first] + np.arange(len(offsets))
        out = np.full(int(bounds[-1]), END_ID, np.int32)
        inside = np.ones(len(out), bool)
        inside[bounds[1:] - 1] = False
        out[inside] = self.flat[np.arange(int(total[-1])) + np.repeat(self.begin[number][at] - total[:-1], lengths)]
        if fresh and len(known) > REMEMBERED:  # full: what came last is not kept
            for h in fresh:
                del known[h]
        return out, bounds


_ENCODERS: dict[str, Encoder] = {}


def encoder_of(path: str) -> Encoder:
    """One encoder for each worker process, so that tasks profit from the pieces of earlier ones."""
    if path not in _ENCODERS:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        _ENCODERS[path] = Encoder(path)
    return _ENCODERS[path]


FILE_SCHEMA = "doc_id long, part int, before long, n_tokens long, ids array<int>"
_ARROW = pa.schema([("doc_id", pa.int64()), ("part", pa.int32()), ("before", pa.int64()), ("n_tokens", pa.int64()), ("ids", pa.list_(pa.int32()))])


def _encode_all(batches: Iterator[pa.RecordBatch], path: str) -> Iterator[pa.RecordBatch]:
    encoder, before = encoder_of(path), 0
    for batch in batches:
        for lo, hi, data, offsets in blocks(batch.column(1)):
            ids, bounds = encoder.encode(data, offsets)
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0).slice(lo, hi - lo), batch.column(2).slice(lo, hi - lo), pa.array(before + bounds[:-1]),
                    pa.array(np.diff(bounds)), pa.ListArray.from_arrays(pa.array(bounds, pa.int32()), pa.array(ids)),
                ],
                schema=_ARROW,
            )
            before += int(bounds[-1])


def write_tokens(docs: DataFrame, to: str, tokenizer: str | None = None, partitions: int | None = None) -> None:
    """Tokenize every row of ``docs`` and write ORC files under ``to`` in ascending doc_id order.

    A null or empty text has the end id alone. Rows with the same doc_id all stay, ordered by
    a hash of their text; a null doc_id sorts first, and rows equal in both stay side by side. Without rows there are no ids. Other columns
    are ignored.
    """
    spark = docs.sparkSession
    small_batches(spark)
    path = tokenizer or tokenizer_path()
    n = partitions or max(int(spark.conf.get("spark.sql.shuffle.partitions")), math.ceil(docs.count() / ROWS_PER_FILE))
    rows = docs.select("doc_id", "text", F.xxhash64("text").alias("tie"), F.xxhash64(F.monotonically_increasing_id()).alias("place"))
    ordered = rows.repartitionByRange(n, "doc_id", "tie", "place").sortWithinPartitions("doc_id", "tie")
    coded = ordered.select("doc_id", "text", F.spark_partition_id().alias("part")).mapInArrow(lambda it: _encode_all(it, path), FILE_SCHEMA)
    writer = coded.write.mode("errorifexists").option("compression", "zstd")
    writer = writer.option("orc.bloom.filter.columns", "doc_id").option("orc.bloom.filter.fpp", str(BLOOM_FPP))
    writer.option("orc.create.index", "true").option("orc.row.index.stride", str(ROW_INDEX_STRIDE)).option("orc.stripe.size", str(STRIPE_BYTES)).orc(to)


def read_tokens(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(FILE_SCHEMA).orc(path)


#: Files whose sizes are summed in one task.
FILES_PER_GROUP = 1024


def with_positions(tokens: DataFrame) -> DataFrame:
    """Adds ``start``: the number of ids of all rows before, over all files.

    One row for each file is summed up in groups of FILES_PER_GROUP, and the groups after that, so
    no task orders all files. The offsets are written, so that Spark knows that they are small.
    """
    sizes = tokens.groupBy("part").agg(F.sum("n_tokens").alias("in_part")).withColumn("group", F.floor(F.col("part") / FILES_PER_GROUP))
    before = W.rowsBetween(W.unboundedPreceding, -1)
    none = F.lit(0).cast("long")
    groups = sizes.groupBy("group").agg(F.sum("in_part").alias("in_group"))
    groups = groups.select("group", F.coalesce(F.sum("in_group").over(before.orderBy("group")), none).alias("before_group"))
    inside = F.coalesce(F.sum("in_part").over(before.partitionBy("group").orderBy("part")), none)
    offsets = sizes.withColumn("inside", inside).join(groups, "group").select("part", (F.col("before_group") + F.col("inside")).alias("offset"))
    return tokens.join(written(offsets, "token-offsets"), "part").withColumn("start", F.col("offset") + F.col("before")).drop("offset")


def lookup(tokens: DataFrame, doc_ids: list[int]) -> DataFrame:
    """Rows of some documents; the filter is pushed to the ORC reader, which prunes by it."""
    return tokens.where(F.col("doc_id").isin(doc_ids))


def _checksums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        ids = batch.column(3)
        bounds = ids.offsets.to_numpy()
        raw = memoryview(np.ascontiguousarray(ids.values.to_numpy(zero_copy_only=False).astype("<u4"))).cast("B")
        crc = [zlib.crc32(raw[4 * a : 4 * b]) for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True)]
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), batch.column(2), pa.array(crc, pa.int64())], names=["doc_id", "start", "n_tokens", "ids_crc32"])


def checksums(tokens: DataFrame) -> DataFrame:
    """doc_id, start, n_tokens and ids_crc32 of every row of the files."""
    small_batches(tokens.sparkSession)
    found = with_positions(tokens).select("doc_id", "start", "n_tokens", "ids")
    return found.mapInArrow(_checksums, "doc_id long, start long, n_tokens long, ids_crc32 long")


def token_query(docs: DataFrame, tokenizer: str | None = None) -> DataFrame:
    """Write the files of ``docs`` to the shared folder, read them back, and give ``checksums``.

    Null and empty texts have the end id alone; repeated rows stay; a null doc_id comes first; an
    empty table gives no rows; other columns are ignored.
    """
    spark = docs.sparkSession
    to = f"{shared_dir(spark)}/tokens-{uuid.uuid4().hex}"
    write_tokens(docs, to, tokenizer)
    return checksums(read_tokens(spark, to))
