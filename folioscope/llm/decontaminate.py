"""Benchmark decontamination by winnowing, in SQL functions only.

A text is a sequence of words. Each K consecutive words have a hash, and every window of
WINNOW consecutive hashes is represented by the smallest of them. K + WINNOW - 1 = SPAN, so a
shared run of SPAN words or more has at least one whole window of hashes in common, whose
minimum both sides select: no such run is missed. Documents and benchmark items are joined on
these minima, and each hit is extended to the SPAN words around it, which must be equal word
for word.

Items of fewer than SPAN words are one window each; their fingerprint is the hash of all
their words, taken from the documents at that length.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from folioscope.llm.common import written

SPAN, K = 10, 5
WINNOW = SPAN - K + 1

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_BETWEEN = "[\\x00-\\x2F\\x3A-\\x40\\x5B-\\x60\\x7B-\\x7F]+"


def lower_ascii(text: Column) -> Column:
    """A-Z to a-z and nothing else; texts of ASCII alone take the faster built-in."""
    return F.when(F.octet_length(text) == F.char_length(text), F.lower(text)).otherwise(F.translate(text, _UPPER, _LOWER))


def words_of(text: Column) -> Column:
    """The words of a text; none for null."""
    return F.array_remove(F.split(lower_ascii(F.coalesce(text, F.lit(""))), _BETWEEN), "")


def n_words_of(text: Column) -> Column:
    return F.size(F.array_remove(F.split(F.coalesce(text, F.lit("")), _BETWEEN), "")).cast("long")


def _places(n: Column, length: int) -> Column:
    """0, 1, ..., the last place at which ``length`` of n elements begin; empty if there is none."""
    return F.when(n >= length, F.sequence(F.lit(0), n - length)).otherwise(F.array().cast("array<int>"))


def _gram(i: Column, k: int) -> Column:
    return F.xxhash64(*[F.get("hashes", i + j) for j in range(k)])


def _short_print(k: int):
    return lambda i: F.xxhash64(F.lit(k), _gram(i, k))


def _smallest(i: Column) -> Column:
    return F.least(*[F.get("grams", i + j) for j in range(WINNOW)])


def _with_fingerprints(df: DataFrame, lengths: list[int]) -> DataFrame:
    """Adds ``f<length>`` for each length: the fingerprint of the window at each place of ``words``."""
    df = df.withColumn("hashes", F.transform("words", lambda w: F.xxhash64(w))).withColumn("n", F.size("words"))
    for k in lengths:
        if k < SPAN:
            df = df.withColumn(f"f{k}", F.transform(_places(F.col("n"), k), _short_print(k)))
    if SPAN in lengths:
        df = df.withColumn("grams", F.transform(_places(F.col("n"), K), lambda i: _gram(i, K)))
        df = df.withColumn(f"f{SPAN}", F.transform(_places(F.col("n"), SPAN), _smallest))
    return df


def _window(k: int):
    return lambda i: F.struct(i.alias("place"), F.lit(k).alias("length"), F.get(f"f{k}", i).alias("print"), F.array_join(F.slice("words", i + 1, k), " ").alias("text"))


def _of_length(k: int):
    return lambda w: w["length"] == k


def _printed_place(k: int):
    return lambda i: F.struct(F.lit(k).alias("length"), i.alias("place"), F.get(f"f{k}", i).alias("print"))


def _window_rows(df: DataFrame, lengths: list[int], at: Column | None = None) -> DataFrame:
    """One row for each window: key, place, length, print, text. ``at`` is an array of struct(length, place) of those to keep."""
    parts = []
    for k in lengths:
        places = _places(F.col("n"), k) if at is None else F.transform(F.filter(at, _of_length(k)), lambda w: w["place"])
        parts.append(F.transform(places, _window(k)))
    return df.select("key", "n", F.explode(F.concat(*parts)).alias("w")).select("key", "n", "w.*")


def _met_places(printed: DataFrame, prints: DataFrame, lengths: list[int]) -> DataFrame:
    """key and ``at``: the windows (length, place) whose fingerprint is one of ``prints``, found by a join."""
    each = [F.transform(_places(F.col("n"), k), _printed_place(k)) for k in lengths]
    windows = printed.select("key", F.explode(F.concat(*each)).alias("w")).select("key", "w.*")
    return windows.join(prints, "print", "left_semi").groupBy("key").agg(F.collect_list(F.struct("length", "place")).alias("at"))


def item_windows(benchmark: DataFrame) -> tuple[DataFrame, DataFrame, list[int]]:
    """(windows, groups, lengths): print, text and group of each distinct window; the items of each
    group, those that have the same windows in common; and the window lengths that occur, at most SPAN of them."""
    items = benchmark.select(F.col("item_id").alias("key"), words_of(F.col("text")).alias("words"))
    lengths = sorted(r[0] for r in items.select(F.least(F.size("words"), F.lit(SPAN)).alias("n")).where("n > 0").distinct().collect())
    spark = benchmark.sparkSession
    if not lengths:
        return spark.createDataFrame([], "print long, text string, group long"), spark.createDataFrame([], "group long, items array<string>, without boolean"), []
    # an item has windows of one length only: its own number of words, or SPAN
    rows = _window_rows(_with_fingerprints(items, lengths), lengths).where(F.col("length") == F.least("n", F.lit(SPAN)))
    of = rows.select("print", "text", F.col("key").cast("string").alias("item")).distinct()
    of = of.groupBy("print", "text").agg(F.array_sort(F.collect_list("item")).alias("items"), F.max(F.col("item").isNull()).alias("without"))
    of = of.withColumn("group", F.xxhash64("items", "without"))
    of = written(of, "bench-windows")
    return of.select("print", "text", "group"), of.select("group", "items", "without").dropDuplicates(["group"]), lengths


def _hits(docs: DataFrame, windows: DataFrame, groups: DataFrame, lengths: list[int]) -> DataFrame:
    """key, n_hit, n_items, items_sha256 of the texts with a hit."""
    texts = docs.select(_row_key().alias("key"), "text")
    printed = _with_fingerprints(texts.select("key", words_of(F.col("text")).alias("words")), lengths)
    prints = F.concat(*[F.array_distinct(f"f{n}") for n in lengths])
    known = windows.select("print").distinct()
    met = written(printed.select("key", F.explode(prints).alias("print")).join(known, "print", "left_semi").select("key").distinct(), "bench-met")
    # only texts with a fingerprint in common are taken up again; copies of a row have one key and one result, so one of them is enough
    again = texts.join(met, "key").groupBy("key").agg(F.min("text").alias("text"))
    again = written(again.select("key", words_of(F.col("text")).alias("words")), "bench-texts")
    places = _met_places(_with_fingerprints(again, lengths), known, lengths)
    found = _window_rows(_with_fingerprints(again, lengths).join(places, "key"), lengths, F.col("at"))
    # the extension: all words of the window are those of an item's
    found = written(found.join(windows, ["print", "text"]).select("key", "place", "length", "group"), "bench-found")
    by_place = W.partitionBy("key").orderBy("place", "length")
    reach = F.max(F.col("place") + F.col("length")).over(by_place.rowsBetween(W.unboundedPreceding, -1))
    end = F.col("place") + F.col("length")
    hit = found.select("key", F.greatest(F.lit(0), end - F.greatest(F.col("place"), F.coalesce(reach, F.lit(0)))).alias("new"))
    hit = hit.groupBy("key").agg(F.sum("new").alias("n_hit"))
    # texts with the same groups share one list of items; the lists are made once for each combination
    combined = found.groupBy("key").agg(F.array_sort(F.collect_set("group")).alias("groups")).withColumn("combination", F.xxhash64("groups"))
    each = combined.select("combination", "groups").dropDuplicates(["combination"]).select("combination", F.explode("groups").alias("group")).join(groups, "group")
    without = each.groupBy("combination").agg(F.max("without").alias("without"))
    items = each.select("combination", F.explode("items").alias("item")).distinct().groupBy("combination").agg(F.array_sort(F.collect_list("item")).alias("items"))
    items = without.join(items, "combination", "left").withColumn("items", F.coalesce("items", F.array().cast("array<string>")))
    items = items.select("combination", (F.size("items") + F.col("without").cast("int")).cast("long").alias("n_items"), F.sha2(F.array_join("items", ","), 256).alias("items_sha256"))
    return hit.join(combined.select("key", "combination"), "key").join(items, "combination").select("key", "n_hit", "n_items", "items_sha256")


def _row_key() -> Column:
    return F.xxhash64("doc_id", "text")


def find_contamination(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """For each row of ``docs``: doc_id, n_words, n_hit, n_items, items_sha256, contaminated.

    A word is hit if it lies inside a window of an item that stands in the text. items_sha256
    hashes the ids of all such items, sorted as strings and comma-joined (none: the empty
    string). Null and empty texts have no words; null and empty items have no windows. Items
    without an id count as one item together and add nothing to the list. An item id that
    repeats with several texts is one item with the windows of all.

    Rows are told apart by doc_id and text, so repeated rows get equal results. Without
    benchmark items nothing is contaminated. Other columns of either table are ignored.

    The fingerprints of a text are joined to those of the items; Spark broadcasts the item side
    if it measures as small, and else shuffles. Only texts with a hit are taken up again. Items
    with a window in common are one group there, so no text meets them one by one.
    """
    windows, groups, lengths = item_windows(benchmark)
    rows = docs.select("doc_id", _row_key().alias("key"), n_words_of(F.col("text")).alias("n_words"))
    nothing = F.sha2(F.lit(""), 256)
    if not lengths:
        return rows.select("doc_id", "n_words", F.lit(0).cast("long").alias("n_hit"), F.lit(0).cast("long").alias("n_items"), nothing.alias("items_sha256"), F.lit(False).alias("contaminated"))
    n_hit = F.coalesce("n_hit", F.lit(0).cast("long"))
    return rows.join(_hits(docs, windows, groups, lengths), "key", "left").select(
        "doc_id",
        "n_words",
        n_hit.alias("n_hit"),
        F.coalesce("n_items", F.lit(0).cast("long")).alias("n_items"),
        F.coalesce("items_sha256", nothing).alias("items_sha256"),
        (n_hit > 0).alias("contaminated"),
    )


def clean_documents(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The rows of ``docs`` without a hit, with all their columns.

    Each row is judged by its own text: of rows that share an id only those with a hit go, and
    rows without an id are judged like all others. Null and empty texts stay; without benchmark
    items all rows do. Columns may have any names.

    The rows to drop are written first, so that Spark knows their size and broadcasts a short list.
    """
    windows, groups, lengths = item_windows(benchmark)
    if not lengths:
        return docs
    bad = written(_hits(docs.select("doc_id", "text"), windows, groups, lengths).select("key"), "bench-bad")
    return docs.join(bad, F.xxhash64(docs["doc_id"], docs["text"]) == bad["key"], "left_anti")
