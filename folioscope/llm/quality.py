"""Quality classifier by positive-unlabelled learning with the non-negative risk estimator.

Trusted positives are rows labelled good. Unlabelled web text is a sample of all documents, whose labels
are not looked at, so there is one however many documents have labels. With class prior c, the
risk is::

    c * R_pos(+)  +  max(0, R_unl(-) - c * R_pos(-))

The second part estimates the loss on negatives from the mixture. When a batch drives it below
zero the network overfits, and the step goes the other way on that part.

The prior is estimated from positives and unlabelled texts alone: a network learns to tell the two
apart, and on texts kept back from it, the share of unlabelled texts above a cut is divided by the share
of positives above it. Where the highest-scored texts are all positives, this ratio is the
prior; the cut is the one whose ratio has the lowest upper confidence bound.

A text enters as hashed words and word pairs, whose vectors are learned, and as whole-text statistics.
Negative labels are never used.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from folioscope.llm.common import bounded_sample, held_out, one_text_each, remainder, small_batches
from folioscope.llm.words import LOWER, SPACED, Words, blocks, grams

#: Training rows at most (about): trusted positives, and unlabelled texts.
SAMPLE_POSITIVE, SAMPLE_UNLABELLED = 3000, 6000
HIDDEN, EPOCHS, RATE, DECAY = 24, 40, 0.003, 1e-3
THRESHOLD = 0.5
#: Slots of hashed words and word pairs, and their weight beside the statistics.
SLOT_BITS, SLOT_SCALE = 9, 3.0
SLOTS = 1 << SLOT_BITS
#: Confidence of the prior's bound, and the weight of its width.
PRIOR_DELTA, PRIOR_GAMMA = 0.1, 0.01

FEATURES = (
    "log_words", "word_length", "upper", "digit", "ascii_punctuation", "markup", "bars", "exclaims", "non_ascii", "mixed_words",
    "shouted_words", "ends_sentence", "short_words", "distinct_words", "distinct_grams", "repeated_next", "log_line_words", "log_lines", "long_words", "top_word",
)


def _table(codes: str | list[int]) -> np.ndarray:
    t = np.zeros(256, bool)
    t[[ord(c) if isinstance(c, str) else c for c in codes]] = True
    return t


_UPPER, _DIGIT = _table(list(range(65, 91))), _table("0123456789")
_PUNCTUATION = _table([*range(33, 48), *range(58, 65), *range(91, 97), *range(123, 127)])
_MARKUP, _BAR, _EXCLAIM, _NEWLINE = _table("#*$%&<>{}\\~^"), _table("|"), _table("!"), _table("\n")
_HIGH = _table(list(range(128, 256)))
_LETTER = _table([*range(65, 91), *range(97, 123), *range(128, 256)])


def text_features(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """FEATURES of each text of a block; all zero for a text without a word."""
    w = Words(data, offsets, SPACED)
    first, n_docs = w.first, w.n_docs
    n = np.diff(first)
    some, size = np.maximum(1, n), np.maximum(1, np.diff(offsets))

    def sums(t: np.ndarray) -> np.ndarray:
        return np.concatenate([[0], np.cumsum(t[data], dtype=np.int64)])

    def per_text(t: np.ndarray) -> np.ndarray:
        c = sums(t)
        return c[offsets[1:]] - c[offsets[:-1]]

    def per_word(t: np.ndarray) -> np.ndarray:
        c = sums(t)
        return c[w.end] - c[w.start]

    def share(of_word: np.ndarray) -> np.ndarray:
        c = np.concatenate([[0], np.cumsum(of_word, dtype=np.float64)])
        return (c[first[1:]] - c[first[:-1]]) / some

    length = w.end - w.start
    upper, punctuation, letters = per_word(_UPPER), per_word(_PUNCTUATION), per_word(_LETTER)
    last = data[w.end - 1] if len(w) else np.zeros(0, np.uint8)
    h = w.hashes(LOWER[data])
    doc = w.doc()
    next_same = np.zeros(len(h), bool)
    next_same[1:] = (h[1:] == h[:-1]) & (doc[1:] == doc[:-1])
    lines = per_text(_NEWLINE) + 1
    distinct, distinct_grams, top = np.ones(n_docs), np.ones(n_docs), np.zeros(n_docs)
    g = grams(h, 3)
    for d in np.flatnonzero(n).tolist():
        a, b = int(first[d]), int(first[d + 1])
        _, counts = np.unique(h[a:b], return_counts=True)
        # against the number of words to a power, as a text's vocabulary grows slower than it
        distinct[d], top[d] = len(counts) / (b - a) ** 0.8, counts.max() / (b - a)
        if b - a > 3:
            distinct_grams[d] = len(np.unique(g[a : b - 2])) / (b - a - 2)
    columns = [
        np.log1p(n), share(length), per_text(_UPPER) / size, per_text(_DIGIT) / size, per_text(_PUNCTUATION) / size, per_text(_MARKUP) / size,
        per_text(_BAR) / size, per_text(_EXCLAIM) / size, per_text(_HIGH) / size, share((letters > 0) & (punctuation > 1)),
        share((upper > 1) & (2 * upper > letters)), share((last == 46) | (last == 33) | (last == 63)), share(length <= 3), distinct, distinct_grams,
        share(next_same), np.log1p(n / lines), np.log1p(lines), share(length > 12), top,
    ]
    out = np.stack(columns, 1)
    out[n == 0] = 0.0
    return out


def hashed_words(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Root counts of each text's words and word pairs (A-Z lower-cased) by slot, scaled to length 1."""
    low = LOWER[data]
    w = Words(low, offsets, SPACED)
    h, doc = w.hashes(low), w.doc()
    pair = grams(h, 2)
    inside = doc[1:] == doc[:-1] if len(doc) else np.zeros(0, bool)
    shift = np.uint64(64 - SLOT_BITS)
    at = np.concatenate([doc * SLOTS + (h >> shift).astype(np.int64), (doc[1:] * SLOTS + (pair >> shift).astype(np.int64))[inside]])
    x = np.sqrt(np.bincount(at, minlength=w.n_docs * SLOTS).reshape(w.n_docs, SLOTS).astype(np.float32))
    return x / np.maximum(1e-6, np.sqrt((x * x).sum(1, keepdims=True)))


def inputs(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Statistics and hashed words of each text of a block, side by side."""
    return np.concatenate([text_features(data, offsets).astype(np.float32), SLOT_SCALE * hashed_words(data, offsets)], 1)


@dataclass
class QualityModel:
    """``mean`` and ``scale`` are those of the statistics; hashed words go in as they are."""

    mean: np.ndarray
    scale: np.ndarray
    p: dict[str, np.ndarray]
    prior: float

    def scaled(self, x: np.ndarray) -> np.ndarray:
        k = len(self.mean)
        return np.concatenate([np.clip((x[:, :k] - self.mean) / self.scale, -6, 6), x[:, k:]], 1).astype(np.float32)

    def logits(self, x: np.ndarray) -> np.ndarray:
        return np.tanh(self.scaled(x) @ self.p["w1"] + self.p["b1"]) @ self.p["w2"] + self.p["b2"]

    def scores(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.logits(x).astype(np.float64), -30, 30)))


def _risk_slope(f: np.ndarray, n_positive: int, prior: float | None) -> np.ndarray:
    """Slope of the risk of a batch with its positives first; without a prior, of telling them from the rest."""
    q = 1 / (1 + np.exp(-np.clip(f, -30, 30)))
    n_rest = len(f) - n_positive
    if prior is None:
        return np.concatenate([(q[:n_positive] - 1) / n_positive, q[n_positive:] / n_rest]) / 2
    minus = np.logaddexp(0, f)  # the loss of calling a text negative
    enough = minus[n_positive:].mean() >= prior * minus[:n_positive].mean()
    sign = 1.0 if enough else -1.0
    positive = (prior * (q[:n_positive] - 1) if enough else 0.0) - sign * prior * q[:n_positive]
    return np.concatenate([positive / n_positive, sign * q[n_positive:] / n_rest])


def train(positive: np.ndarray, unlabelled: np.ndarray, prior: float | None, seed: int = 6, epochs: int = EPOCHS, statistics: int | None = None) -> QualityModel:
    """Minimise the non-negative risk with the logistic loss by Adam. Without ``prior``, tell the two samples apart.

    The first ``statistics`` columns are standardised (all, if there are no more than those).
    """
    rng = np.random.default_rng(seed)
    k = positive.shape[1] if statistics is None else statistics
    both = np.concatenate([positive, unlabelled])
    d = both.shape[1]
    normal = lambda scale, *shape: (rng.standard_normal(shape) * scale).astype(np.float32)
    first = np.concatenate([normal(1 / np.sqrt(k), k, HIDDEN), normal(0.05, d - k, HIDDEN)])
    p = {"w1": first, "b1": np.zeros(HIDDEN, np.float32), "w2": normal(0.1, HIDDEN), "b2": np.zeros(1, np.float32)}
    model = QualityModel(both[:, :k].mean(0), both[:, :k].std(0) + 1e-6, p, prior or 0.0)
    zp, zu = model.scaled(positive), model.scaled(unlabelled)
    moments = {name: [np.zeros_like(v), np.zeros_like(v)] for name, v in p.items()}
    step, batches = 0, max(4, len(zu) // 256)
    for _ in range(epochs):
        pos, unl = np.array_split(rng.permutation(len(zp)), batches), np.array_split(rng.permutation(len(zu)), batches)
        for i, j in zip(pos, unl, strict=True):
            if not len(i) or not len(j):
                continue
            x = np.concatenate([zp[i], zu[j]])
            a = np.tanh(x @ p["w1"] + p["b1"])
            g = _risk_slope(a @ p["w2"] + p["b2"], len(i), prior).astype(np.float32)
            da = g[:, None] * p["w2"] * (1 - a**2)
            grad = {"w1": x.T @ da, "b1": da.sum(0), "w2": a.T @ g, "b2": np.array([g.sum()])}
            step += 1
            for name, v in grad.items():
                m, s = moments[name]
                m *= 0.9
                m += 0.1 * v
                s *= 0.99
                s += 0.01 * v * v
                p[name] -= (RATE * (m / (1 - 0.9**step) / (np.sqrt(s / (1 - 0.99**step)) + 1e-8) + DECAY * p[name])).astype(np.float32)
    return model


def estimate_prior(positive: np.ndarray, unlabelled: np.ndarray) -> float:
    """The share of positives in the mixture, from scores of texts that the scorer was not fitted on."""
    cut = np.unique(positive)
    above = lambda x: 1 - np.searchsorted(np.sort(x), cut, "left") / len(x)
    of_positive, of_unlabelled = above(positive), above(unlabelled)
    log = np.log(4 / PRIOR_DELTA) / 2
    width = np.sqrt(log / len(unlabelled)) + np.sqrt(log / len(positive))
    best = int(np.argmin((of_unlabelled + (1 + PRIOR_GAMMA) * width) / of_positive))
    return float(min(1.0, of_unlabelled[best] / of_positive[best]))


def fit(positive: np.ndarray, unlabelled: np.ndarray, statistics: int | None = None, seed: int = 6) -> QualityModel:
    """Estimate the prior with a third of both samples kept back, then minimise the risk on all of them."""
    rng = np.random.default_rng(seed)
    kept = [rng.random(len(x)) < 1 / 3 for x in (positive, unlabelled)]
    prior = 0.5
    if all(k.any() and not k.all() for k in kept):
        apart = train(positive[~kept[0]], unlabelled[~kept[1]], None, seed, EPOCHS // 2, statistics)
        prior = estimate_prior(apart.scores(positive[kept[0]]), apart.scores(unlabelled[kept[1]]))
    # a prior of one would leave no negatives to estimate
    return train(positive, unlabelled, min(0.98, max(0.02, prior)), seed, statistics=statistics)


_FEATURE_DDL = "doc_id long, x array<float>"


def _features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for lo, hi, data, offsets in blocks(batch.column(1)):
            x = pa.array(list(inputs(data, offsets)), pa.list_(pa.float32()))
            yield pa.RecordBatch.from_arrays([batch.column(0).slice(lo, hi - lo), x], names=["doc_id", "x"])


def _score(batches: Iterator[pa.RecordBatch], model: QualityModel | None) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for lo, hi, data, offsets in blocks(batch.column(1)):
            s = model.scores(inputs(data, offsets)) if model is not None else np.full(hi - lo, 0.5)
            yield pa.RecordBatch.from_arrays([batch.column(0).slice(lo, hi - lo), pa.array(s, pa.float64())], names=["doc_id", "score"])


def fit_quality(docs: DataFrame, labels: DataFrame, fold: int | None = 1, modulus: int = 3, sample: tuple[int, int] = (SAMPLE_POSITIVE, SAMPLE_UNLABELLED)) -> QualityModel | None:
    """Train on about ``sample`` trusted positives and unlabelled texts, both outside the held-out
    remainder; None without either. Rows without an id are not learned from; of a labelled id that
    repeats with several texts one is learned from, and repeated rows count once."""
    small_batches(docs.sparkSession)
    good = labels.select("doc_id").where("doc_id is not null and quality = 1").distinct()
    body = docs.select("doc_id", "text").where("doc_id is not null")
    if fold is not None:
        good, body = good.where(remainder("doc_id", modulus) != fold), body.where(remainder("doc_id", modulus) != fold)
    # both samples have a documented bound; only their inputs come to the driver
    positive = one_text_each(body.join(F.broadcast(bounded_sample(good, ("doc_id",), sample[0], 61)), "doc_id"), "doc_id")
    unlabelled = bounded_sample(body, ("doc_id", "text"), sample[1], 62)
    found = []
    for part in (positive, unlabelled):
        got = part.mapInArrow(_features, _FEATURE_DDL).orderBy("doc_id", "x").select("x").toPandas()
        found.append(np.array(got["x"].tolist(), np.float32))
    if not len(found[0]) or not len(found[1]):
        return None
    return fit(found[0], found[1], len(FEATURES))


def score_quality(docs: DataFrame, model: QualityModel | None) -> DataFrame:
    """doc_id and score for each row of ``docs``, from its whole text.

    A null or empty text has the features of no words and is scored like any other; without a
    model every score is 0.5. Rows are judged one by one: repeated rows give equal rows, an
    empty table an empty result. Other columns are ignored.
    """
    small_batches(docs.sparkSession)
    return docs.select(docs["doc_id"], docs["text"]).mapInArrow(lambda it: _score(it, model), "doc_id long, score double")


def quality_query(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """Fit outside the held-out fold and score every row; see ``score_quality``.

    A row without an id is never held out and never learned from.
    """
    scored = score_quality(docs, fit_quality(docs, labels))
    return scored.select("doc_id", held_out("doc_id", 3, 1).alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))
