"""Full-text search by query strings over a stored inverted index: matching, cover-density rank, headlines.

The index holds stems with their positions, sorted by stem, so a query reads the postings of its own
stems (the filter reaches the Parquet scan) and no text. A query string is small: words, "phrases", a minus
before what must not occur, and ``or``; it becomes rows of (clause, unit, offset, stem), and all evaluation is joins,
groups and windows by document:

* match: an occurrence of a unit is a position (of a phrase: a run of positions); a clause holds where all its
  units occur and none of its excluded ones; a document matches with any clause;
* rank: a cover is a shortest run of positions that satisfies a clause. The last occurrence of each unit up to a
  position comes from one window, and covers that contain another are dropped. Each cover gives the mean
  weight of its entries, less the more other words lie between; the sum x becomes x / (x + 1);
* headline: the best covers that do not overlap, widened to a number of words, hits in [[ ]].
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from folioscope.plans.search import words
from folioscope.session import stored

#: Weights of title and abstract in a rank.
TITLE_WEIGHT, ABSTRACT_WEIGHT = 1.0, 0.4
#: English words that are not indexed.
STOP_WORDS = """
i me my myself we our ours ourselves you your yours yourself yourselves he him his himself she her hers herself it its itself they them their theirs themselves
what which who whom this that these those am is are was were be been being have has had having do does did doing a an the and but if or because as until while
of at by for with about against between into through during before after above below to from up down in out on off over under again further then once
here there when where why how all any both each few more most other some such no nor not only own same so than too very s t can will just don should now
""".split()


class Index(NamedTuple):
    """postings: term, first, hits (array of key, at, title; of some texts, whose first key is first), by term; documents: key, for clauses that only exclude."""

    postings: DataFrame
    documents: DataFrame
    key: str


#: The public suffix rules for plurals, -ed, -ing and final y: (pattern, letters to cut, letters to add), the first that fits.
_PLURAL = (("(sses|ies)$", 2, ""), ("ss$", 0, ""), ("..s$", 1, ""))
_PAST = (("[aeiouy][^aeiouy].*eed$", 1, ""), ("eed$", 0, ""), ("[aeiouy].*ed$", 2, "?"), ("[aeiouy].*ing$", 3, "?"))
#: What is left after a cut -ed or -ing.
_LEFT = (("(at|bl|iz)$", 0, "e"), ("(bb|dd|ff|gg|mm|nn|pp|rr|tt)$", 1, ""), ("^[^aeiouy]*[aeiouy][^aeiouywx]$", 0, "e"))
_FINAL = (("[aeiouy].*y$", 1, "i"),)


def _rule(word: Column, rules: tuple, mark: bool = False) -> Column:
    out = None
    for pattern, cut, add in rules:
        to = F.substring(word, F.lit(1), F.length(word) - cut)
        to = F.concat(to, F.lit(add)) if add and (mark or add != "?") else to
        out = F.when(word.rlike(pattern), to) if out is None else out.when(word.rlike(pattern), to)
    return out.otherwise(word)


def stemmed(df: DataFrame, word: str, term: str) -> DataFrame:
    """Adds ``term``, the stem of the column ``word``. Each step is a column of its own, so it is computed once."""
    df = df.withColumn("_a", _rule(F.col(word), _PLURAL)).withColumn("_b", _rule(F.col("_a"), _PAST, True))
    left = F.regexp_replace("_b", "[?]$", "")
    df = df.withColumn("_c", left).withColumn("_d", F.when(F.endswith("_b", F.lit("?")), _rule(F.col("_c"), _LEFT)).otherwise(F.col("_c")))
    return df.withColumn(term, _rule(F.col("_d"), _FINAL)).drop("_a", "_b", "_c", "_d")


def stem(word: str) -> str:
    """The stem of one word, by the rules of ``stemmed``, for Arrow batches. Few words have an ending that any rule is about."""

    def rule(of: str, rules: tuple, ends: str | tuple[str, ...] = "", mark: bool = False) -> str:
        if of.endswith(ends):
            for pattern, cut, add in rules:
                if re.search(pattern, of):
                    return of[: max(0, len(of) - cut)] + (add if mark or add != "?" else "")
        return of

    past = rule(rule(word, _PLURAL, "s"), _PAST, ("ed", "ing"), True)
    if past.endswith("?"):
        past = rule(past[:-1], _LEFT)
    return rule(past, _FINAL, "y")


#: Words that are grouped at once, about.
BATCH_WORDS = 1_000_000


def _grouped(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(key, words, title_words) to a row for each stem of some texts, with its hits in order."""
    stop = set(STOP_WORDS)
    for batch in batches:
        lengths = batch.column(1).value_lengths().to_numpy(zero_copy_only=False)
        part, begin = np.cumsum(lengths) // BATCH_WORDS, 0
        for end in [*(np.flatnonzero(np.diff(part)) + 1).tolist(), len(lengths)]:
            key, words, title_words = batch.slice(begin, end - begin).columns
            n, begin = lengths[begin:end], end
            coded = words.flatten().dictionary_encode()
            if not len(coded):
                continue
            stems = [None if w in stop else stem(w) for w in coded.dictionary.to_pylist()]
            terms = sorted({t for t in stems if t is not None})
            number = {t: i for i, t in enumerate(terms)}
            of = np.array([number.get(t, -1) for t in stems])[coded.indices.to_numpy()]
            row, at = np.repeat(np.arange(len(n)), n), np.arange(len(of)) - np.repeat(np.cumsum(n) - n, n)
            kept = np.flatnonzero(of >= 0)
            kept = kept[np.argsort(of[kept], kind="stable")]
            first = np.flatnonzero(np.r_[True, np.diff(of[kept]) != 0]) if len(kept) else np.zeros(0, int)
            title = at[kept] < title_words.to_numpy()[row[kept]]
            hit = pa.StructArray.from_arrays([key.take(pa.array(row[kept])), pa.array(at[kept], pa.int32()), pa.array(title)], ["key", "at", "title"])
            hits = pa.ListArray.from_arrays(pa.array(np.r_[first, len(kept)], pa.int32()), hit)
            yield pa.RecordBatch.from_arrays([pa.array(terms, pa.string()).take(pa.array(of[kept[first]])), key.take(pa.array(row[kept[first]])), hits], ["term", "first", "hits"])


def build_index(papers: DataFrame, key: str) -> Index:
    """The index of title and abstract, stored in the shared folder. Positions go on from the title to the abstract.

    Null and empty texts have no words. Words are grouped by stem where their texts are read, some texts at a time.
    Postings are dealt out by ranges of (stem, first key), so a stem that every document has fills as many files as it needs.
    """
    p = papers.select(key, words(F.col("title")).alias("t"), words(F.col("abstract")).alias("a"))
    p = p.select(key, F.concat("t", "a").alias("words"), F.size("t").alias("title_words"))
    # stored, as the ranges are found by a pass of its own
    kind = papers.schema[key].dataType.simpleString()
    grouped = stored(p.mapInArrow(_grouped, f"term string, first {kind}, hits array<struct<key:{kind},at:int,title:boolean>>"), "text-stems")
    ordered = grouped.repartitionByRange("term", "first").sortWithinPartitions("term", "first")
    return Index(stored(ordered, "postings"), papers.select(key).distinct(), key)


class Unit(NamedTuple):
    """Words (offset, word) that stand in a row, wanted or excluded."""

    words: tuple[tuple[int, str], ...]
    excluded: bool


def parse(text: str) -> list[list[Unit]]:
    """Clauses of units: any clause must hold, and of a clause all units. ``or`` separates clauses.

    Stop words are dropped, from phrases too, where they keep their place; an unfinished quote ends with the text.
    """
    clauses: list[list[Unit]] = [[]]
    for minus, phrase, bare in re.findall(r'(-?)(?:"([^"]*)"?|([^\s"]+))', text):
        if bare.lower() == "or" and not minus:
            clauses.append([])
            continue
        found = enumerate(re.findall(r"[^\W_]+", (phrase or bare).lower()))
        kept = [(i, w) for i, w in found if w not in STOP_WORDS]
        if kept:
            clauses[-1].append(Unit(tuple((i - kept[0][0], w) for i, w in kept), minus == "-"))
    return [c for c in clauses if c]


def _units(spark: SparkSession, clauses: list[list[Unit]]) -> list[tuple]:
    """(clause, unit, offset, term, size, excluded) for each word of the query, stems as the index has them."""
    rows = [(c, u, offset, word, len(unit.words), unit.excluded) for c, units in enumerate(clauses) for u, unit in enumerate(units) for offset, word in unit.words]
    asked = spark.createDataFrame(rows, "clause int, unit int, offset int, word string, size int, excluded boolean")
    return [tuple(r) for r in stemmed(asked, "word", "term").select("clause", "unit", "offset", "term", "size", "excluded").collect()]  # as many as the query has words


def occurrences(index: Index, units: list[tuple]) -> DataFrame:
    """key, clause, unit, excluded, begin, end of each place where a unit stands, and whether both ends lie in the title; only postings of its stems are read."""
    spark, key = index.postings.sparkSession, index.key
    asked = spark.createDataFrame(units, "clause int, unit int, offset int, term string, size int, excluded boolean")
    hits = index.postings.where(F.col("term").isin(sorted({u[3] for u in units}))).select("term", F.inline("hits")).withColumnRenamed("key", key)
    # a row for each word of the query
    each = hits.join(F.broadcast(asked), "term").withColumn("begin", F.col("at") - F.col("offset"))
    single = each.where("size = 1").select(key, "clause", "unit", "excluded", "begin", F.col("at").alias("end"), "title", F.col("title").alias("title_end"))
    phrase = each.where("size > 1").groupBy(key, "clause", "unit", "excluded", "begin", "size").agg(F.count(F.lit(1)).alias("n"), F.max("at").alias("end"), F.max("title").alias("title"), F.min("title").alias("title_end"))
    return single.unionByName(phrase.where("n = size").select(*single.columns))


def matches(index: Index, occurring: DataFrame, clauses: list[list[Unit]]) -> DataFrame:
    """key and clause of each clause that a document satisfies."""
    key = index.key
    found = occurring.groupBy(key).agg(F.collect_set(F.struct("clause", "unit")).alias("met"))
    if any(all(u.excluded for u in units) for units in clauses):
        # a clause that only excludes holds for documents without any of the stems too
        found = index.documents.join(found, key, "left")

    def holds(c: int) -> Column:
        ok = F.lit(True)
        for u, unit in enumerate(clauses[c]):
            has = F.coalesce(F.array_contains("met", F.struct(F.lit(c).alias("clause"), F.lit(u).alias("unit"))), F.lit(False))
            ok = ok & (~has if unit.excluded else has)
        return F.when(ok, F.lit(c))

    return found.select(key, F.explode(F.array_compact(F.array(*[holds(c) for c in range(len(clauses))]))).alias("clause"))


def covers(occurring: DataFrame, matched: DataFrame, clauses: list[list[Unit]], key: str) -> DataFrame:
    """key, begin, end of the shortest runs of positions that satisfy a matched clause, none of which contains another."""
    wanted = [[u for u, unit in enumerate(units) if not unit.excluded] for units in clauses]
    here = occurring.where("not excluded").join(matched, [key, "clause"], "left_semi")
    up_to = W.partitionBy(key, "clause").orderBy("end")
    parts = []
    for c, units in enumerate(wanted):
        if units:
            latest = [F.last(F.when(F.col("unit") == u, F.col("begin")), ignorenulls=True).over(up_to) for u in units]
            begin = F.when(sum((x.isNull().cast("int") for x in latest), F.lit(0)) == 0, F.array_min(F.array(*latest)))
            parts.append(here.where(F.col("clause") == c).select(key, begin.alias("begin"), "end").where("begin is not null"))
    if not parts:
        return here.select(key, "begin", "end").limit(0)
    each = parts[0]
    for p in parts[1:]:
        each = each.unionByName(p)
    # in order of their ends, a cover that begins no later than one before it contains that one
    earlier = W.partitionBy(key).orderBy("end", F.desc("begin")).rowsBetween(W.unboundedPreceding, -1)
    return each.withColumn("_most", F.max("begin").over(earlier)).where("_most is null or begin > _most").drop("_most")


def ranked(index: Index, text: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(key, rank) of all matching documents, with their covers and entries; rank is in [0, 1), without wanted words 0."""
    key, spark = index.key, index.postings.sparkSession
    clauses = parse(text)
    if not clauses:
        none = index.documents.limit(0)
        empty = none.select(key, F.lit(0).alias("begin"), F.lit(0).alias("end"))
        return none.select(key, F.lit(0.0).alias("rank")), empty, none.select(key, F.lit(0).alias("at"))
    occurring = stored(occurrences(index, _units(spark, clauses)), "occurrences")
    matched = stored(matches(index, occurring, clauses), "matches")
    found = covers(occurring, matched, clauses, key)
    # entries are the places of wanted stems; a phrase counts at its first and last word
    wanted = occurring.where("not excluded").join(matched, [key, "clause"], "left_semi")
    ends = F.array_distinct(F.array(F.struct(F.col("begin").alias("at"), "title"), F.struct(F.col("end").alias("at"), F.col("title_end").alias("title"))))
    places = wanted.select(key, F.explode(ends).alias("e")).select(key, "e.*").groupBy(key, "at").agg(F.max("title").alias("title"))
    inverse = F.when(F.col("title"), 1 / TITLE_WEIGHT).otherwise(1 / ABSTRACT_WEIGHT)
    running = W.partitionBy(key).orderBy("at").rowsBetween(W.unboundedPreceding, 0)
    sums = places.select(key, "at", F.count(F.lit(1)).over(running).alias("n"), F.sum(inverse).over(running).alias("inv"), inverse.alias("own"))
    first = sums.select(key, F.col("at").alias("begin"), (F.col("n") - 1).alias("n0"), (F.col("inv") - F.col("own")).alias("inv0"))
    last = sums.select(key, F.col("at").alias("end"), F.col("n").alias("n1"), F.col("inv").alias("inv1"))
    size = F.col("n1") - F.col("n0")
    share = size / (F.col("inv1") - F.col("inv0")) / (1 + F.col("end") - F.col("begin") + 1 - size)
    of = found.join(first, [key, "begin"]).join(last, [key, "end"]).groupBy(key).agg(F.sum(share).alias("x"))
    x = F.coalesce("x", F.lit(0.0))
    scores = matched.select(key).distinct().join(of, key, "left").select(key, F.round(x / (x + 1.0), 6).alias("rank"))
    return scores, found, places


def search_text(index: Index, text: str, limit: int = 20) -> DataFrame:
    """The best documents for a query string: key and rank, ties by key."""
    return ranked(index, text)[0].orderBy(F.desc("rank"), index.key).limit(limit)


def headlines(index: Index, papers: DataFrame, text: str, limit: int = 20, most_words: int = 16, most_fragments: int = 2) -> DataFrame:
    """key, rank and headline of the best documents: the shortest covers that do not overlap, widened to ``most_words`` words.

    Hits stand in [[ ]], fragments are separated by `` ... ``; without a cover the headline is null. Only the texts of the ``limit`` best documents are read.
    """
    key = index.key
    scores, found, places = ranked(index, text)
    best = stored(scores.orderBy(F.desc("rank"), key).limit(limit), "best")
    by_length = F.sort_array(F.collect_list(F.struct((F.col("end") - F.col("begin")).alias("length"), "begin", "end"))).alias("covers")
    found = found.join(best, key, "left_semi").groupBy(key).agg(by_length)
    hits = places.join(best, key, "left_semi").groupBy(key).agg(F.collect_list("at").alias("hits"))
    plain = lambda c: F.filter(F.split(F.coalesce(F.col(c), F.lit("")), "[^\\p{L}\\p{N}]+"), lambda w: w != "")
    said = papers.join(best, key, "left_semi").select(key, F.concat(plain("title"), plain("abstract")).alias("words"))
    each = best.join(said, key).join(found, key, "left").join(hits, key, "left")
    # a fragment is a run of words around a cover, within the text
    pieces = F.transform("covers", lambda c: F.greatest(F.lit(0), F.least(c["begin"] - F.floor(F.greatest(F.lit(0), most_words - 1 - c["length"]) / 2), F.size("words") - most_words)).cast("int"))
    none = F.array().cast("array<int>")
    apart = lambda taken, at: F.forall(taken, lambda t: F.abs(t - at) >= most_words) & (F.size(taken) < most_fragments)
    chosen = F.aggregate(pieces, none, lambda taken, at: F.when(apart(taken, at), F.concat(taken, F.array(at))).otherwise(taken))
    each = each.withColumn("chosen", F.sort_array(chosen))
    shown = lambda at: F.array_join(F.transform(F.slice("words", at + 1, most_words), lambda w, i: F.when(F.array_contains("hits", (at + i).cast("int")), F.concat(F.lit("[["), w, F.lit("]]"))).otherwise(w)), " ")
    return each.select(key, "rank", F.array_join(F.transform("chosen", shown), " ... ").alias("headline"))


def _stem_sql(source: str) -> str:
    """SQL for ``source`` (with a column w) with the stem as column term."""

    def rule(x: str, rules: tuple, mark: bool = False) -> str:
        cases = " ".join(f"WHEN regexp_matches({x}, '{p}') THEN substr({x}, 1, length({x}) - {cut}) || '{add if mark or add != '?' else ''}'" for p, cut, add in rules)
        return f"CASE {cases} ELSE {x} END"

    s = f"(SELECT *, {rule('w', _PLURAL)} AS a FROM {source})"
    s = f"(SELECT *, {rule('a', _PAST, True)} AS b FROM {s})"
    s = f"(SELECT *, regexp_replace(b, '[?]$', '') AS c FROM {s})"
    s = f"(SELECT *, CASE WHEN suffix(b, '?') THEN {rule('c', _LEFT)} ELSE c END AS d FROM {s})"
    return f"(SELECT * EXCLUDE (a, b, c, d), {rule('d', _FINAL)} AS term FROM {s})"


#: The query of the registered searches: two clauses, an excluded word, a phrase.
ASKED = 'thor erring -que or "the er" bleed'

#: Covers by brute force: every pair of a begin and an end that satisfies a clause, without those that contain another.
RANK_SQL = f"""
WITH d AS (SELECT doc_id AS paper_id, trim(CASE WHEN strpos(text, '.') > 0 THEN substr(text, 1, strpos(text, '.') - 1) ELSE text END) AS title, trim(CASE WHEN strpos(text, '.') > 0 THEN substr(text, strpos(text, '.') + 1) ELSE '' END) AS abstract FROM documents),
v AS (SELECT paper_id, regexp_extract_all(lower(coalesce(title, '')), '[\\p{{L}}\\p{{N}}]+') AS t, regexp_extract_all(lower(coalesce(abstract, '')), '[\\p{{L}}\\p{{N}}]+') AS a FROM d),
o AS (SELECT paper_id, unnest(range(0, len(t) + len(a))) AS i, unnest(t || a) AS w, len(t) AS n FROM v),
s AS (SELECT paper_id, i, term, i < n AS title FROM {_stem_sql(f"(SELECT * FROM o WHERE w NOT IN ({', '.join(repr(w) for w in STOP_WORDS)}))")}),
m AS (SELECT paper_id, bool_or(term = 'thor') AND bool_or(term = 'er') AND NOT bool_or(term = 'que') AS one, bool_or(term = 'er') AND bool_or(term = 'bleed') AS two FROM s GROUP BY paper_id),
e AS (SELECT s.*, one, two FROM s JOIN m USING (paper_id) WHERE (one AND term IN ('thor', 'er')) OR (two AND term IN ('er', 'bleed'))),
c AS (SELECT DISTINCT x.paper_id, least(x.i, y.i) AS p, greatest(x.i, y.i) AS q FROM e x JOIN e y ON x.paper_id = y.paper_id AND ((x.one AND x.term = 'thor' AND y.term = 'er') OR (x.two AND x.term = 'er' AND y.term = 'bleed'))),
k AS (SELECT * FROM c WHERE NOT EXISTS (SELECT 1 FROM c z WHERE z.paper_id = c.paper_id AND z.p >= c.p AND z.q <= c.q AND (z.p > c.p OR z.q < c.q))),
r AS (SELECT paper_id, p, q, count(*) AS n, sum(CASE WHEN title THEN 1 ELSE 2.5 END)::DOUBLE AS inv FROM k JOIN e USING (paper_id) WHERE i BETWEEN p AND q GROUP BY paper_id, p, q),
x AS (SELECT paper_id, sum(n / inv / (1 + q - p + 1 - n)) AS x FROM r GROUP BY paper_id)
SELECT paper_id, round(coalesce(x, 0.0) / (coalesce(x, 0.0) + 1.0), 6)::DOUBLE AS rank FROM m LEFT JOIN x USING (paper_id) WHERE one OR two"""
