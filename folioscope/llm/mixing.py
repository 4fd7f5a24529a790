"""Mix sources to target weights by pivotal dependent rounding.

Each document of a source gets the same number of copies, target / source size, on average.
The whole part is certain. The fractional parts are rounded against each other: a pivot pairs
the longest open document with the next longest, as many of them as can take up its words, and a
random transfer of words between the two sides makes the document integral: it gets 0 or 1 extra copy.
Where all that are left cannot take up its words, the transfer stops as soon as one of them is
integral. No probability is ever cut off, so each document keeps its expectation, and the
words of both sides together stay constant under the transfer.

The documents of a source meet in chunks of bounded size, each leaving at most one undecided
document; those residuals meet again, a bounded number at a time, until one is left for each
source, which is decided by its own probability. As long documents go first, the last one is a
short one as a rule, and a source misses its target by a few words; it never misses by as
much as one document.

(With pairs of two documents only, the residual is often a long one: small sources then missed
their targets by up to a fifth.)

Rows equal in source, doc_id and text are copies of one document. They are counted first and
rounded together: of m rows, the whole part of m times the expectation is certain, and only the
rest is fractional. So a group of copies is one row of the plan, however large it is.
"""

from __future__ import annotations

import hashlib
import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from folioscope.llm.common import written
from folioscope.llm.sharding import dealt_copies
from folioscope.session import importable

MAX_COPIES = 3
#: Documents rounded in one chunk, and residuals that meet in one node of the reduction tree.
CHUNK_ROWS = 1024
FAN_IN = 64
#: A probability so near to 0 or 1 is integral.
_NEAR = 1e-9
#: Ids go as text: pandas would turn numbers with nulls among them into floats.
_STATE = "source string, node long, doc_id string, ord string, size long, rows long, whole long, part double, extra int"


def word_count(text: Column) -> Column:
    """Number of words [^\\x20\\x09-\\x0D]+; null has none."""
    return F.size(F.array_remove(F.split(F.coalesce(text, F.lit("")), "[\\x20\\x09-\\x0D]+"), "")).cast("long")


def source_targets(sizes: DataFrame, max_copies: int = MAX_COPIES) -> DataFrame:
    """(source, source_size, n_docs, target) for every source.

    Sources in code-point order, null last, weigh 1, 2, 3, repeating. They share all words by
    weight; a target stops at ``max_copies`` times the source, and the excess is shared again by
    weight. In the end the sources below their stop share at one level: sort by stop / weight,
    and find the last source for which the rest would exceed its stop.
    The table has one row for each source, so its windows hold a row for each source.
    """
    by_name = W.orderBy(F.col("source").asc_nulls_last())
    s = sizes.groupBy("source").agg(F.sum("size").alias("source_size"), F.count(F.lit(1)).alias("n_docs"))
    s = s.withColumn("weight", ((F.row_number().over(by_name) - 1) % 3 + 1).cast("double"))
    s = s.withColumn("stop", F.col("source_size").cast("double") * max_copies)
    by_level = W.orderBy(F.col("stop") / F.col("weight"), F.col("source").asc_nulls_last())
    so_far = by_level.rowsBetween(W.unboundedPreceding, -1)
    rest = by_level.rowsBetween(0, W.unboundedFollowing)
    s = s.withColumn("stopped", F.coalesce(F.sum("stop").over(so_far), F.lit(0.0)))
    s = s.withColumn("open_weight", F.sum("weight").over(rest))
    whole = W.orderBy(F.lit(1)).rowsBetween(W.unboundedPreceding, W.unboundedFollowing)
    s = s.withColumn("total", F.sum("source_size").over(whole).cast("double"))
    s = s.withColumn("level", (F.col("total") - F.col("stopped")) / F.col("open_weight"))
    # the first source in this order that stays below its stop fixes the level of all that follow
    below = F.when(F.col("level") * F.col("weight") <= F.col("stop"), F.col("level"))
    s = s.withColumn("fixed", F.first(below, ignorenulls=True).over(by_level.rowsBetween(W.unboundedPreceding, 0)))
    return s.select(
        "source",
        "source_size",
        "n_docs",
        F.coalesce(F.least("stop", F.col("fixed") * F.col("weight")), F.col("stop")).alias("target"),
    )


def _draw(seed: int, *ids: object) -> float:
    """A number in [0, 1) that depends on the seed and the pair only: reruns agree."""
    h = hashlib.blake2b("|".join(map(str, (seed, *ids))).encode(), digest_size=8).digest()
    return int.from_bytes(h, "little") / 2.0**64


def round_chunk(ids: list, size: np.ndarray, part: np.ndarray, seed: int, last: bool) -> tuple[np.ndarray, np.ndarray]:
    """Pivotal rounding of documents from the longest down: (probabilities, extra copies).

    The extra copy is 0 or 1 where decided and -1 for the one residual, which is the shortest document
    but for rare cases. With ``last`` the residual is decided too, by a draw with its own probability.
    """
    p, size = part.astype(float), size.astype(float)
    extra = np.where(p >= 1 - _NEAR, 1, np.where((p <= _NEAR) | (size <= 0), 0, -1))
    open_ = np.flatnonzero(extra < 0)
    while len(open_) > 1:
        a, rest = open_[0], open_[1:]
        words = np.cumsum(size[rest])
        give, take = np.minimum.accumulate(p[rest]) * words, (1 - np.maximum.accumulate(p[rest])) * words
        enough = (give >= (1 - p[a]) * size[a]) & (take >= p[a] * size[a])
        n = int(enough.argmax()) + 1 if enough.any() else len(rest)
        rest, words = rest[:n], words[n - 1]
        up = min((1 - p[a]) * size[a], give[n - 1])  # words that can go from the others to a
        down = min(p[a] * size[a], take[n - 1])  # and from a to the others
        moved = up if _draw(seed, ids[a], len(open_)) * (up + down) < down else -down
        p[a] += moved / size[a]
        p[rest] -= moved / words
        extra[open_] = np.where(p[open_] >= 1 - _NEAR, 1, np.where(p[open_] <= _NEAR, 0, -1))
        open_ = open_[extra[open_] < 0]
    if len(open_) and last:
        extra[open_] = int(_draw(seed, ids[open_[0]], "last") < p[open_[0]])
    return p, extra


def _rounder(seed: int, last: bool):
    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["size", "ord", "doc_id"], ascending=[False, True, True], kind="stable")
        ids = list(zip(pdf["doc_id"], pdf["ord"], strict=True))
        p, extra = round_chunk(ids, pdf["size"].to_numpy(), pdf["part"].to_numpy(), seed, last)
        return pdf.assign(part=p, extra=pd.Series(extra, pdf.index, dtype="Int32").mask(extra < 0))

    return run


def plan_mix(docs: DataFrame, seed: int = 9, chunk_rows: int = CHUNK_ROWS, fan_in: int = FAN_IN, max_copies: int = MAX_COPIES) -> DataFrame:
    """One row for each distinct (source, doc_id, text): doc_id, source, ord, size, rows, source_size, target, copies.

    ``rows`` is the number of equal rows, ``copies`` what they are taken together, and ``ord`` a hash
    of seed, id and text.
    """
    importable(docs.sparkSession)
    base = docs.select("doc_id", "source", word_count(F.col("text")).alias("size"), _ord(seed, F.col("doc_id"), F.col("text")).alias("ord"))
    base = written(base.groupBy("source", "doc_id", "ord", "size").agg(F.count(F.lit(1)).alias("rows")), "mix-sizes")
    targets = written(source_targets(base.select("source", (F.col("size") * F.col("rows")).alias("size")), max_copies), "mix-targets")
    # one row for each source: Spark broadcasts it by its measured size
    joined = base.alias("b").join(targets.alias("t"), F.col("b.source").eqNullSafe(F.col("t.source")))
    ratio = F.when(F.col("t.source_size") > 0, F.col("t.target") / F.col("t.source_size")).otherwise(0.0)
    due = F.col("b.rows") * ratio
    whole = F.least(F.floor(due + 1e-9), F.col("b.rows") * max_copies)
    some = F.col("b.size") > 0
    state = joined.select(
        F.col("b.source").alias("source"),
        F.pmod(F.xxhash64("b.ord", "b.doc_id"), F.ceil(F.col("t.n_docs") / chunk_rows)).alias("node"),
        F.col("b.doc_id").cast("string").alias("doc_id"),
        F.col("b.ord").alias("ord"),
        F.col("b.size").alias("size"),
        F.col("b.rows").alias("rows"),
        F.when(some, whole).otherwise(0).cast("long").alias("whole"),
        F.when(some, F.greatest(F.lit(0.0), due - whole)).otherwise(0.0).alias("part"),
        F.lit(None).cast("int").alias("extra"),
    )
    nodes, level, decided = max(1, math.ceil((targets.agg(F.max("n_docs")).first()[0] or 0) / chunk_rows)), 0, None
    while True:
        last = nodes == 1
        step = written(state.groupBy("source", "node").applyInPandas(_rounder(seed + 1 + level, last), _STATE), f"mix-level{level}")
        done = step.where("extra is not null")
        decided = done if decided is None else decided.unionByName(done)
        if last:
            break
        nodes, level = math.ceil(nodes / fan_in), level + 1
        state = step.where("extra is null").withColumn("node", F.floor(F.col("node") / fan_in))
    copies = F.least(F.col("d.whole") + F.col("d.extra"), F.col("d.rows") * max_copies)
    return decided.alias("d").join(targets.alias("t"), F.col("d.source").eqNullSafe(F.col("t.source"))).select(
        F.col("d.doc_id").cast(docs.schema["doc_id"].dataType).alias("doc_id"), "d.source", "d.ord", "d.size", "d.rows", "t.source_size", "t.target", copies.alias("copies")
    )


def _ord(seed: int, doc_id: Column, text: Column) -> Column:
    return F.hex(F.xxhash64(F.lit(seed), doc_id, text))


def mix_sources(docs: DataFrame, seed: int = 9, chunk_rows: int = CHUNK_ROWS, fan_in: int = FAN_IN, max_copies: int = MAX_COPIES) -> DataFrame:
    """Copies of every row of ``docs``: doc_id, size, source_size, target, copies, taken, ord.

    A null text has size 0; rows of size 0 are never taken (they hold no words). A null source
    is a source of its own, the last one; a null doc_id is an id like any other. Of m rows
    equal in source, doc_id and text each gets the same number of copies, but for a rest of
    fewer than m that go to some of them. Reruns agree. An empty table gives an empty
    result; other columns are ignored.
    """
    plan = written(plan_mix(docs, seed, chunk_rows, fan_in, max_copies), "mix-plan")
    each = dealt_copies(plan, "rows", "nth", chunk_rows)
    copies = F.floor(F.col("copies") / F.col("rows")) + F.when(F.col("nth") < F.col("copies") % F.col("rows"), 1).otherwise(0)
    each = each.withColumn("copies", copies)
    return each.select("doc_id", "size", "source_size", "target", "copies", (F.col("copies") * F.col("size")).alias("taken"), "ord")


def mixed_documents(docs: DataFrame, seed: int = 9, chunk_rows: int = CHUNK_ROWS, **options) -> DataFrame:
    """The mix itself: every row of ``docs`` as often as it is taken, with the columns of ``docs``.

    Rows equal in source, doc_id and text share one row of the plan: each is taken as often as the
    plan's copies go into their number, and the rest comes from the one with the least
    other columns (they must be orderable). Null texts and texts without words are never taken; a
    null source or doc_id is one of its own. An empty table gives an empty result; columns may
    have any names. The texts move once, by the hash that tells rows apart.
    """
    plan = written(plan_mix(docs, seed, chunk_rows, **options).where("copies > 0").select("source", "ord", "rows", "copies"), "mix-plan")
    # the plan's columns in one struct, under a name that docs doesn't have
    name = "mix_plan"
    while name in docs.columns:
        name += "_"
    plan = plan.select(F.struct("source", "ord", "rows", "copies").alias(name))
    found = docs.join(plan, docs["source"].eqNullSafe(plan[f"{name}.source"]) & (_ord(seed, docs["doc_id"], docs["text"]) == plan[f"{name}.ord"]))
    n, copies = F.col(f"{name}.rows"), F.col(f"{name}.copies")
    times = F.floor(copies / n)
    taken = found.where(times > 0).select(*[docs[c] for c in docs.columns], F.explode(F.sequence(F.lit(1).cast("long"), times)).alias(name)).drop(name)
    # only groups of several rows leave a rest
    some = found.where((n > 1) & (copies % n > 0)).groupBy(name).agg(F.min(F.struct(*[docs[c] for c in docs.columns])).alias("row"))
    rest = dealt_copies(some.select("row", (copies % n).alias("times")), "times", "nth", chunk_rows).select("row.*")
    return taken.unionByName(rest)
