"""Quality rules from repeated text: suffix arrays and longest-common-prefix intervals over words.

A block of documents is sorted by prefix doubling: ranks of single words give ranks of two,
four, eight words, and only positions whose rank is still shared are sorted again. Ranks
never tie between documents. The kept ranks of each level then give the longest common
prefix of neighbours in the suffix array by binary descent, without a pass word by word.

A neighbour pair with a common prefix of ``min_words`` or more lies inside an LCP interval,
which is one maximal repeated substring with its occurrences. Each position takes the longer
prefix of its two neighbours, and the union of these spans is the repeated part of a text.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from folioscope.llm.common import small_batches
from folioscope.llm.words import SPACED, Words, blocks, mix

#: A repeat has this many words at least.
MIN_WORDS = 5
#: Share of a text's word characters that repeats of MIN_WORDS or more may cover.
MAX_COVERED = 0.2
#: Longest single repeat: words, and share of all words. A text fails that has both more. The share
#: is 0: a repeat stands twice, so any share near the base rule's would never decide.
MAX_REPEAT_WORDS, MAX_REPEAT_SHARE = 60, 0.0
#: Fixed by the contract of the base rules.
BASE_MIN_WORDS, BASE_REPEAT_PERCENT, SYMBOLS = 10, 20, b"#*$%&|<>"

_SYMBOL = np.zeros(256, bool)
_SYMBOL[list(SYMBOLS)] = True
_POINT = np.ones(256, bool)
_POINT[0x80:0xC0] = False


def _regroup(order_key: np.ndarray, rank: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """New ranks of positions ``at``, and those of them that still share one.

    A rank is the place in the suffix array where its group begins, so a group keeps its place
    when it splits. ``order_key`` sorts inside a group.
    """
    order = np.lexsort((order_key, rank[at]))
    pos, old, key = at[order], rank[at][order], order_key[order]
    n = len(pos)
    index = np.arange(n)
    new_old = np.ones(n, bool)
    new_old[1:] = old[1:] != old[:-1]
    new_key = new_old.copy()
    new_key[1:] |= key[1:] != key[:-1]
    group_start = np.maximum.accumulate(np.where(new_old, index, 0))
    sub_start = np.maximum.accumulate(np.where(new_key, index, 0))
    fresh = old + (sub_start - group_start)
    alone = new_key.copy()
    alone[:-1] &= new_key[1:]
    rank[pos] = fresh
    return rank, pos[~alone]


def longest_repeats(word: np.ndarray, first: np.ndarray, min_words: int = MIN_WORDS) -> np.ndarray:
    """For each word position, the length of the longest substring that begins there and occurs
    again in the same document (0 if shorter than ``min_words``).

    ``word`` holds word hashes; document d has positions first[d] to first[d + 1].
    """
    n = len(word)
    longest = np.zeros(n, np.int64)
    if n < 2:
        return longest
    doc = np.repeat(np.arange(len(first) - 1), np.diff(first))
    end = first[1:][doc]
    rank = np.zeros(n, np.int64)
    rank, active = _regroup(mix(word ^ mix(doc.astype(np.uint64))), rank, np.arange(n))
    levels, span = [rank.copy()], 1
    repeated = active
    while len(active):
        follow = active + span
        inside = follow < end[active]
        key = np.where(inside, rank[np.minimum(follow, n - 1)] + 1, 0)
        rank, active = _regroup(key, rank, active)
        span *= 2
        levels.append(rank.copy())
        if span <= min_words:
            repeated = active
    if len(repeated) < 2:
        return longest
    by_suffix = repeated[np.argsort(rank[repeated])]
    a, b = by_suffix[:-1], by_suffix[1:]
    near = doc[a] == doc[b]
    a, b = a[near], b[near]
    common = np.zeros(len(a), np.int64)
    for k in range(len(levels) - 1, -1, -1):
        r = levels[k]
        ia, ib = a + common, b + common
        ok = (ia < end[a]) & (ib < end[b])
        same = ok & (r[np.minimum(ia, n - 1)] == r[np.minimum(ib, n - 1)])
        common += np.where(same, 1 << k, 0)
    common[common < min_words] = 0
    np.maximum.at(longest, a, common)
    np.maximum.at(longest, b, common)
    return longest


def covered(longest: np.ndarray) -> np.ndarray:
    """Positions inside the union of the repeats."""
    n = len(longest)
    if not n:
        return np.zeros(0, bool)
    reach = np.maximum.accumulate(np.where(longest > 0, np.arange(n) + longest, 0))
    return reach > np.arange(n)


def _per_doc(values: np.ndarray, first: np.ndarray) -> np.ndarray:
    total = np.concatenate([[0], np.cumsum(values, dtype=np.int64)])
    return total[first[1:]] - total[first[:-1]]


def _repeated_lines(data: np.ndarray, offsets: np.ndarray) -> list[int]:
    """Lines with a word that equal an earlier line of the same text."""
    out, raw = [], data.tobytes()
    for lo, hi in zip(offsets[:-1], offsets[1:], strict=True):
        lines = raw[lo:hi].split(b"\n")
        if len(lines) == 1:
            out.append(0)
            continue
        lines = [x for x in lines if x.strip(b" \t\n\x0b\x0c\r")]
        out.append(len(lines) - len(set(lines)))
    return out


OUT = pa.schema(
    [
        ("doc_id", pa.int64()), ("n_words", pa.int64()), ("word_chars", pa.int64()), ("n_symbols", pa.int64()),
        ("n_dup_lines", pa.int64()), ("n_repeat_words", pa.int64()), ("base_failed", pa.bool_()), ("kept", pa.bool_()),
        ("covered_frac", pa.float64()), ("longest_repeat", pa.int64()),
    ]
)
_DDL = "doc_id long, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, base_failed boolean, kept boolean, covered_frac double, longest_repeat long"


def block_rules(data: np.ndarray, offsets: np.ndarray) -> dict[str, np.ndarray]:
    """All measures of one block of texts."""
    w = Words(data, offsets, SPACED)
    first = w.first
    n_words = np.diff(first)
    points = np.concatenate([[0], np.cumsum(_POINT[data], dtype=np.int64)])
    chars = points[w.end] - points[w.start]
    symbols = np.concatenate([[0], np.cumsum(_SYMBOL[data], dtype=np.int64)])
    longest = longest_repeats(w.hashes(data), first)
    # spans never leave their document, so the running reach of one ends before the next begins
    inside = covered(longest)
    word_chars, repeat_words = _per_doc(chars, first), _per_doc(inside, first)
    most = np.zeros(w.n_docs, np.int64)
    if len(w):
        np.maximum.at(most, w.doc(), longest)
    frac = _per_doc(np.where(inside, chars, 0), first) / np.maximum(1, word_chars)
    failed = (n_words < BASE_MIN_WORDS) | (100 * repeat_words > BASE_REPEAT_PERCENT * n_words)
    too_long = (most > MAX_REPEAT_WORDS) & (most > MAX_REPEAT_SHARE * n_words)
    return {
        "n_words": n_words, "word_chars": word_chars, "n_symbols": symbols[offsets[1:]] - symbols[offsets[:-1]],
        "n_dup_lines": np.array(_repeated_lines(data, offsets), np.int64), "n_repeat_words": repeat_words, "base_failed": failed,
        "kept": ~failed & (frac <= MAX_COVERED) & ~too_long, "covered_frac": frac, "longest_repeat": most,
    }


def _measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        ids = batch.column(0)
        for lo, hi, data, offsets in blocks(batch.column(1)):
            found = block_rules(data, offsets)
            arrays = [ids.slice(lo, hi - lo)] + [pa.array(found[f.name], f.type) for f in list(OUT)[1:]]
            yield pa.RecordBatch.from_arrays(arrays, schema=OUT)


def repetition_rules(docs: DataFrame) -> DataFrame:
    """One row of measures and verdicts for each row of ``docs``.

    base_failed: fewer than 10 words, or more than 20 % of them in repeated 5-word windows.
    kept: not base_failed, repeats cover at most MAX_COVERED of the word characters, and no
    single repeat is longer than MAX_REPEAT_WORDS (and than MAX_REPEAT_SHARE of the words, if set).

    A null or empty text has no words and fails the base rule. Rows are judged one by one, so
    ties and repeated rows give equal rows; an empty table gives an empty result; a very long
    text is a block of its own. Other columns are ignored.
    """
    small_batches(docs.sparkSession)
    return docs.select(docs["doc_id"], docs["text"]).mapInArrow(_measure, _DDL)
