"""Ranked text search: weighted terms of title and abstract, required and excluded words, phrases, fragments.

A request is given as word lists, not as a query string. Words are compared as terms (lower
case, letters and digits); there is no stemming. The rank is x / (x + 1) of the weighted term
count, so it lies in [0, 1) as a normalised cover-density rank does, but counts terms instead.
"""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

TITLE_WEIGHT, ABSTRACT_WEIGHT = 1.0, 0.4


def words(text: Column) -> Column:
    return F.filter(F.split(F.lower(F.coalesce(text, F.lit(""))), "[^\\p{L}\\p{N}]+"), lambda w: w != "")


def postings(papers: DataFrame, key: str) -> DataFrame:
    """The inverted index: (key, field, term, n, positions)."""
    parts = []
    for field in ("title", "abstract"):
        each = papers.select(key, F.posexplode(words(F.col(field))).alias("at", "term"))
        parts.append(each.groupBy(key, "term").agg(F.count(F.lit(1)).alias("n"), F.array_sort(F.collect_list("at")).alias("positions")).withColumn("field", F.lit(field)))
    return parts[0].unionByName(parts[1]).select(key, "field", "term", "n", "positions")


def _count(of: Column, term: str) -> Column:
    return F.size(F.filter(of, lambda w: w == term))


def search(papers: DataFrame, key: str, all_of: list[str], any_of: list[str] = (), none_of: list[str] = (), phrase: list[str] = (), limit: int = 20) -> DataFrame:
    """The best papers that hold every word of ``all_of`` and the phrase, one of ``any_of``, and none of ``none_of``."""
    p = papers.select(key, words(F.col("title")).alias("t"), words(F.col("abstract")).alias("a"))
    both = F.concat("t", "a")
    keep = F.lit(True)
    for w in all_of:
        keep = keep & F.array_contains(both, w.lower())
    if any_of:
        keep = keep & F.arrays_overlap(both, F.array(*[F.lit(w.lower()) for w in any_of]))
    for w in none_of:
        keep = keep & ~F.array_contains(both, w.lower())
    if phrase:
        text = F.lit(f" {' '.join(w.lower() for w in phrase)} ")
        keep = keep & (F.contains(F.concat(F.lit(" "), F.array_join("t", " "), F.lit(" ")), text) | F.contains(F.concat(F.lit(" "), F.array_join("a", " "), F.lit(" ")), text))
    x = F.lit(0.0)
    for w in [*all_of, *any_of, *phrase]:
        x = x + TITLE_WEIGHT * _count(F.col("t"), w.lower()) + ABSTRACT_WEIGHT * _count(F.col("a"), w.lower())
    return p.where(keep).select(key, F.round(x / (x + 1.0), 6).alias("rank")).orderBy(F.desc("rank"), key).limit(limit)


SEARCH_SQL = """
WITH d AS (SELECT doc_id AS paper_id, trim(CASE WHEN strpos(text, '.') > 0 THEN substr(text, 1, strpos(text, '.') - 1) ELSE text END) AS title, trim(CASE WHEN strpos(text, '.') > 0 THEN substr(text, strpos(text, '.') + 1) ELSE '' END) AS abstract FROM documents),
w AS (SELECT paper_id, regexp_extract_all(lower(title), '[\\p{L}\\p{N}]+') AS t, regexp_extract_all(lower(abstract), '[\\p{L}\\p{N}]+') AS a FROM d),
x AS (SELECT *, len(list_filter(t, lambda y: y = 'the')) + len(list_filter(t, lambda y: y = 'with')) + 0.4 * (len(list_filter(a, lambda y: y = 'the')) + len(list_filter(a, lambda y: y = 'with'))) AS x FROM w
  WHERE (list_contains(t, 'the') OR list_contains(a, 'the')) AND (list_contains(t, 'with') OR list_contains(a, 'with')) AND NOT (list_contains(t, 'idiot') OR list_contains(a, 'idiot')))
SELECT paper_id, round(x / (x + 1.0), 6)::DOUBLE AS rank FROM x ORDER BY rank DESC, paper_id LIMIT 20"""


def fragments(wanted: list[str], most_words: int = 16, most_fragments: int = 2):
    """A pandas UDF: text pieces around the wanted words, which stand in [[ ]]; null where none occurs."""
    terms = {w.lower() for w in wanted}

    @F.pandas_udf(T.StringType())
    def run(text: pd.Series) -> pd.Series:
        def one(t: str | None) -> str | None:
            tokens = (t or "").split()
            hit = [any(x in terms for x in re.findall(r"\w+", w.lower())) for w in tokens]
            out, at = [], 0
            while at < len(tokens) and len(out) < most_fragments:
                if not hit[at]:
                    at += 1
                    continue
                lo = max(0, at - most_words // 4)
                hi = min(len(tokens), lo + most_words)
                out.append(" ".join(f"[[{w}]]" if h else w for w, h in zip(tokens[lo:hi], hit[lo:hi], strict=True)))
                at = hi
            return " ... ".join(out) or None

        return text.map(one)

    return run
