"""Text expressions: cleaning, keys, previews, tokens, templates, stable ids."""

from __future__ import annotations

import html
import json
import re

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Words left out of cluster terms.
STOP_WORDS = "a an and are as at be by for from in into is it of on or that the to with we this these those their our using use via study analysis".split()

_WIDE = "\\s\\u0085\\u00A0\\u1680\\u2000-\\u200A\\u2028\\u2029\\u202F\\u205F\\u3000"


def collapse(text: Column) -> Column:
    """Runs of white space become one space, none at the ends."""
    return F.trim(F.regexp_replace(text, f"[{_WIDE}]+", " "))


def ascii_punctuation(text: Column) -> Column:
    """Typographic quotes and dashes to ASCII."""
    return F.translate(text, "’‘“”–—", "''\"\"--")


def blank_to_null(text: Column) -> Column:
    return F.nullif(F.trim(text), F.lit(""))


def preview(text: Column, most: int = 240) -> Column:
    """At most ``most`` characters; a longer text is cut one short of it, and three dots follow."""
    t = collapse(text)
    cut = F.concat(F.rtrim(F.substring(t, 1, most - 1)), F.lit("..."))
    return F.when(F.length(t) > most, cut).otherwise(t)


@F.pandas_udf(T.StringType())
def casefolded(text: pd.Series) -> pd.Series:
    """Full case folding, as no built-in function has it: 'ß' becomes 'ss', a final sigma an inner one."""
    return text.str.casefold()


def doi_key(doi: Column) -> Column:
    """Case-folded and without the resolver's address; null if nothing is left."""
    return F.nullif(F.regexp_replace(casefolded(F.trim(doi)), "^(https?://doi\\.org/)+", ""), F.lit(""))


def title_key(title: Column, most: int = 280) -> Column:
    # folding makes a character one or more and leaves white space alone, so the first ones are enough
    return F.substring(casefolded(F.substring(collapse(F.coalesce(title, F.lit(""))), 1, most)), 1, most)


def prefix_match(preview: Column, full: Column, most: int = 80) -> Column:
    """Whether the full text begins as the preview does, over ``most`` characters at most; null if one is blank."""
    p, f = (casefolded(F.substring(collapse(F.coalesce(x, F.lit(""))), 1, most)) for x in (preview, full))
    return F.when((p != "") & (f != ""), F.startswith(f, F.substring(p, 1, most)))


def work_token(value: Column) -> Column:
    """The first W-number in an identifier, upper-cased; null if there is none."""
    return F.nullif(F.upper(F.regexp_extract(value, "(?i)(W\\d+)", 1)), F.lit(""))


def terms(text: Column) -> Column:
    """Alphanumeric words of at least three characters without the stop words."""
    words = F.split(F.lower(F.coalesce(text, F.lit(""))), "[^\\p{L}\\p{N}]+")
    return F.filter(words, lambda w: (F.length(w) >= 3) & ~w.isin(STOP_WORDS))


def embedding_text(title: Column, abstract: Column) -> Column:
    """The text to embed; null without a title."""
    head = F.concat(F.lit("Title: "), F.trim(title))
    body = F.when(F.length(F.trim(F.coalesce(abstract, F.lit("")))) > 0, F.concat(head, F.lit("\n\nAbstract: "), F.trim(abstract))).otherwise(head)
    return F.when(F.length(F.trim(F.coalesce(title, F.lit("")))) > 0, body)


def year_band(year: Column) -> Column:
    """The bands by which reviewers' samples are balanced."""
    return F.when(year.isNull(), "year_missing").when(year <= 2018, "year_le_2018").when(year <= 2020, "year_2019_2020").when(year <= 2022, "year_2021_2022").when(year <= 2024, "year_2023_2024").otherwise("year_ge_2025")


def citation_band(citations: Column) -> Column:
    """Fixed values, as above; a missing count is 0."""
    c = F.coalesce(citations, F.lit(0))
    return F.when(c <= 0, "cite_0").when(c <= 9, "cite_1_9").when(c <= 49, "cite_10_49").when(c <= 199, "cite_50_199").otherwise("cite_ge_200")


def stable_id(*parts: Column, separator: str = "\t") -> Column:
    """sha256 of the parts, joined by a separator; a null part counts as empty."""
    return F.sha2(F.concat_ws(separator, *[F.coalesce(p.cast("string"), F.lit("")) for p in parts]), 256)


def text_from_positions(index: Column) -> Column:
    """The text of an inverted index (map of word to positions): words in the order of their places."""
    pairs = F.flatten(F.transform(F.map_entries(index), lambda e: F.transform(e["value"], lambda p: F.struct(p.alias("at"), e["key"].alias("word")))))
    return F.array_join(F.transform(F.array_sort(pairs), lambda x: x["word"]), " ")


def positions_of_text(df: DataFrame, key: str, text: str) -> DataFrame:
    """(key, word, positions): the inverted index of each text."""
    each = df.select(key, F.posexplode(F.split(collapse(F.coalesce(F.col(text), F.lit(""))), " ")).alias("at", "word")).where("word <> ''")
    return each.groupBy(key, "word").agg(F.array_sort(F.collect_list("at")).alias("positions"))


@F.pandas_udf(T.StringType())
def html_unescaped(text: pd.Series) -> pd.Series:
    """Character references decoded, up to three times over."""

    def one(t: str | None) -> str | None:
        for _ in range(3 if t else 0):
            decoded = html.unescape(t)
            if decoded == t:
                break
            t = decoded
        return t

    return text.map(one)


#: Characters that show that UTF-8 was read in another encoding.
_MISREAD = re.compile("[ÂÃâ�]|ðŸ")


@F.pandas_udf(T.StringType())
def misread_repaired(text: pd.Series) -> pd.Series:
    """UTF-8 that was decoded as a Western single-byte encoding, decoded again."""

    def one(t: str | None) -> str | None:
        if not t or not _MISREAD.search(t):
            return t
        for codec in ("cp1252", "latin-1"):
            try:
                again = t.encode(codec).decode("utf-8")
            except UnicodeError:
                continue
            if again != t:
                return again
        return t

    return text.map(one)


#: Leftovers of misread punctuation, and their repair.
_TRUNCATED = (
    ("â\u0080\u0093", "–"), ("â\u0080\u0094", "—"), ("â€“", "–"), ("â€”", "—"),
    ("â€™", "'"), ("â€œ", '"'), ("â€\u009d", '"'), (" â ", " – "),
)


def truncated_repaired(text: Column) -> Column:
    """The four patterns below, and their repair."""
    for wrong, right in _TRUNCATED:
        text = F.replace(text, F.lit(wrong), F.lit(right))
    text = F.regexp_replace(text, "([a-z])â([A-Z])", "$1-$2")
    text = F.regexp_replace(text, "([a-z])âs\\b", "$1's")
    text = F.regexp_replace(text, " â([A-Z])", ' "$1')
    return F.regexp_replace(text, "([a-z])â:(\\s)", '$1":$2')


def cleaned(text: Column) -> Column:
    """The full cleaning, in its fixed order; null becomes empty."""
    t = collapse(F.coalesce(text, F.lit("")))
    t = misread_repaired(html_unescaped(misread_repaired(t)))
    return collapse(ascii_punctuation(truncated_repaired(t)))


@F.pandas_udf(T.StringType())
def canonical_json_hash(document: pd.Series) -> pd.Series:
    """sha256 of a JSON document with sorted keys and no white space; null for what is not JSON."""
    import hashlib

    def one(d: str | None) -> str | None:
        try:
            return hashlib.sha256(json.dumps(json.loads(d), sort_keys=True, separators=(",", ":")).encode()).hexdigest()
        except (TypeError, ValueError):
            return None

    return document.map(one)


def set_hash(values: Column) -> Column:
    """sha256 of a set of ids, one to a line in order; does not depend on the order of rows."""
    return F.sha2(F.concat(F.array_join(F.array_sort(F.collect_set(values)), "\n"), F.lit("\n")), 256)
