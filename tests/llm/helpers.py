"""Small tables with the cases that every operator must survive, and plain-Python word rules."""

import re

PLAIN = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
SPACED = re.compile(r"[^\x20\x09-\x0D]+")
_LOWER = {c: c + 32 for c in range(65, 91)}

DDL = "doc_id long, text string, lang string, source string, n_chars long, extra string, shard string, size string, copies string, labels string"

_PROSE = "The quick brown fox jumps over the lazy dog near the river bank while seven small birds sing in the old tree by the mill"
CASES = [
    (1, _PROSE, "en", "a", 1), (2, None, "en", "a", 1), (3, "", None, "b", 0), (4, "   \n\t ", "en", None, 1), (5, _PROSE, "en", "a", 1), (5, _PROSE, "en", "a", 1), (6, _PROSE + " once more", None, None, 1),
    (7, " ".join(f"w{i % 997}x{i}" for i in range(60_000)), "en", "b", 1), (8, "###", "de", "c", 3), (9, "Ünïcode wörter über älles Straße İstanbul ÉCOLE naïve", "de", "c", 9), (None, "a text without an id " * 4, "en", "a", 1), (10, "one", "fr", "c", 1),
]


def lower(text):
    return (text or "").translate(_LOWER)


def plain(text):
    return PLAIN.findall(lower(text))


def spaced(text):
    return SPACED.findall(text or "")


def table(spark, rows):
    """Rows of (doc_id, text, lang, source, n_chars), with extra columns whose names clash with those of results."""
    return spark.createDataFrame([(*r, "x", "y", "z", "c", "l") for r in rows], DDL)


def docs(spark, *texts):
    return table(spark, [(i, t, "en", "s", 0) for i, t in enumerate(texts)])


def rows(df, *columns):
    return sorted((tuple(r[c] for c in columns) for r in df.collect()), key=repr)
