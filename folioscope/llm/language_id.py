"""Language identification by sparse multinomial logistic regression on character n-grams.

Features are TF-IDF weights of hashed 1- to 3-grams of characters, with length 1 for each
text. Weights are trained with follow-the-regularised-leader (FTRL-proximal) under an
elastic-net penalty, which leaves most of them exactly zero, and the class scores are then
divided by a temperature fitted on training rows that took no part in the updates.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from folioscope.llm.common import bounded_sample, held_out, remainder, small_batches
from folioscope.llm.words import blocks

#: Training rows at most (about): the classifier is fitted on a hash-chosen sample of this size.
SAMPLE_ROWS = 4000
BUCKET_BITS, ORDERS = 15, (1, 2, 3)
ALPHA, BETA, L1, L2, EPOCHS = 0.5, 1.0, 1e-4, 1e-4, 3
UNKNOWN = "und"

_ASCII_LETTER = re.compile("[A-Za-z]")
_FACTOR = np.array([2654435761, 40503, 2246822519], np.uint32) | np.uint32(1)


def has_letter(text: str) -> bool:
    """Whether a character of a Unicode letter category stands in the text; digits and fractions are none."""
    return _ASCII_LETTER.search(text) is not None or any(map(str.isalpha, text))


def _characters(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Code points (ASCII lower-cased, other ASCII than letters as spaces) and document offsets in them."""
    lead = np.concatenate([[0], np.cumsum((data & 0xC0) != 0x80)])
    points = np.frombuffer(data.tobytes().decode("utf-8", "replace").encode("utf-32-le"), np.uint32)
    upper = (points >= 65) & (points < 91)
    points = points + np.uint32(32) * upper
    points[(points < 97) | ((points > 122) & (points < 128))] = 32
    return points, lead[offsets]


def term_counts(points: np.ndarray, at: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(buckets, counts) of each document's n-grams."""
    shift = np.uint32(32 - BUCKET_BITS)
    codes = []
    for n in ORDERS:
        m = max(0, len(points) - n + 1)
        c = np.full(m, np.uint32(n * 0x9E3779B1 & 0xFFFFFFFF), np.uint32)
        for k in range(n):
            c = (c ^ points[k : k + m]) * _FACTOR[k]
            c ^= c >> np.uint32(15)
        codes.append(((c * np.uint32(2654435769)) >> shift).astype(np.int32))
    for lo, hi in zip(at[:-1].tolist(), at[1:].tolist(), strict=True):
        parts = [c[lo : max(lo, hi - n + 1)] for n, c in zip(ORDERS, codes, strict=True)]
        count = np.bincount(np.concatenate(parts), minlength=1 << BUCKET_BITS)
        found = np.flatnonzero(count)
        yield found, count[found]


@dataclass
class LanguageModel:
    languages: list[str]
    idf: np.ndarray
    weights: np.ndarray
    bias: np.ndarray
    temperature: float = 1.0

    def vector(self, found: np.ndarray, count: np.ndarray) -> np.ndarray:
        x = np.log1p(count) * self.idf[found]
        return x / max(1e-12, float(np.sqrt(x @ x)))

    def scores(self, found: np.ndarray, count: np.ndarray) -> np.ndarray:
        return self.vector(found, count) @ self.weights[found] + self.bias

    def probabilities(self, found: np.ndarray, count: np.ndarray) -> np.ndarray:
        return softmax(self.scores(found, count) / self.temperature)


def softmax(z: np.ndarray) -> np.ndarray:
    e = np.exp(z - z.max(-1, keepdims=True))
    return e / e.sum(-1, keepdims=True)


def _ftrl_weights(z: np.ndarray, n: np.ndarray) -> np.ndarray:
    """Closed form of the regularised leader: exactly zero while |z| is at most L1."""
    shrunk = np.sign(z) * np.maximum(0.0, np.abs(z) - L1)
    return -shrunk / ((BETA + np.sqrt(n)) / ALPHA + L2)


def train(texts: list[str], languages: list[str], seed: int = 4) -> LanguageModel:
    """Fit on texts with their languages."""
    rows = []
    for text in texts:
        data = np.frombuffer((text or "").encode(), np.uint8)
        rows += term_counts(*_characters(data, np.array([0, len(data)])))
    return train_on_counts(rows, languages, seed)


def train_on_counts(rows: list[tuple[np.ndarray, np.ndarray]], languages: list[str], seed: int = 4) -> LanguageModel:
    """Fit on the n-gram counts of texts with their languages; a fifth of them only sets the temperature."""
    names = sorted(set(languages))
    size = 1 << BUCKET_BITS
    y = np.array([names.index(x) for x in languages], np.int64)
    seen = np.zeros(size)
    for found, _ in rows:
        seen[found] += 1
    model = LanguageModel(names, np.log((1 + len(rows)) / (1 + seen)) + 1.0, np.zeros((size, len(names))), np.zeros(len(names)))
    order = np.random.default_rng(seed).permutation(len(rows))
    held = order[: len(rows) // 5] if len(rows) >= 10 else order[:0]
    fit = order[len(held) :]
    z, n = np.zeros((size + 1, len(names))), np.zeros((size + 1, len(names)))
    vectors = {int(i): (np.append(rows[i][0], size), np.append(model.vector(*rows[i]), 1.0)) for i in fit}
    for epoch in range(EPOCHS):
        for i in np.random.default_rng(seed + epoch).permutation(fit):
            at, x = vectors[int(i)]
            w = _ftrl_weights(z[at], n[at])
            p = softmax(x @ w)
            p[y[i]] -= 1.0
            g = x[:, None] * p
            grown = n[at] + g * g
            z[at] += g - (np.sqrt(grown) - np.sqrt(n[at])) / ALPHA * w
            n[at] = grown
    full = _ftrl_weights(z, n)
    model.weights, model.bias = full[:size].astype(np.float32), full[size]
    if len(held):
        s, truth = np.stack([model.scores(*rows[i]) for i in held]), y[held]
        grid = np.exp(np.linspace(-3, 2, 101))
        loss = [-np.log(np.maximum(1e-12, softmax(s / t)[np.arange(len(s)), truth])).mean() for t in grid]
        model.temperature = float(grid[int(np.argmin(loss))])
    return model


OUT = pa.schema([("doc_id", pa.int64()), ("lang_pred", pa.string()), ("score", pa.float64())])
_DDL = "doc_id long, lang_pred string, score double"


def _predict(batches: Iterator[pa.RecordBatch], model: LanguageModel | None) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for lo, hi, data, offsets in blocks(batch.column(1)):
            named, score = [], []
            raw = data.tobytes()
            counts = term_counts(*_characters(data, offsets)) if model else iter([(None, None)] * (hi - lo))
            for a, b, (found, count) in zip(offsets[:-1], offsets[1:], counts, strict=True):
                if model is None or not has_letter(raw[a:b].decode("utf-8", "replace")):
                    named.append(UNKNOWN)
                    score.append(0.0)
                    continue
                p = model.probabilities(found, count)
                named.append(model.languages[int(p.argmax())])
                score.append(float(p.max()))
            yield pa.RecordBatch.from_arrays([batch.column(0).slice(lo, hi - lo), pa.array(named, pa.string()), pa.array(score, pa.float64())], schema=OUT)


def _count_all(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for lo, hi, data, offsets in blocks(batch.column(1)):
            found, count = zip(*term_counts(*_characters(data, offsets)), strict=True)
            columns = [batch.column(0).slice(lo, hi - lo), batch.column(2).slice(lo, hi - lo), pa.array(found, pa.list_(pa.int32())), pa.array(count, pa.list_(pa.int32()))]
            yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "lang", "found", "counts"])


def fit_language_model(docs: DataFrame, fold: int | None = 2, modulus: int = 4, sample_rows: int = SAMPLE_ROWS) -> LanguageModel | None:
    """Train on about ``sample_rows`` distinct rows with an id, a text and a language and outside the held-out
    remainder; None if there are none. The driver takes their n-gram counts, at most 2^BUCKET_BITS for
    each row whatever its length, and no text."""
    small_batches(docs.sparkSession)
    labelled = docs.where(docs["lang"].isNotNull() & docs["text"].isNotNull())
    if fold is not None:
        labelled = labelled.where(remainder("doc_id", modulus) != fold)
    picked = bounded_sample(labelled.select("doc_id", "text", "lang"), ("doc_id", "text", "lang"), sample_rows, 4)
    counted = picked.mapInArrow(_count_all, "doc_id long, lang string, found array<int>, counts array<int>")
    got = counted.orderBy("doc_id", "lang", "found", "counts").select("lang", "found", "counts").toPandas()
    return train_on_counts(list(zip(got["found"], got["counts"], strict=True)), got["lang"].tolist()) if len(got) else None


def identify_languages(docs: DataFrame, model: LanguageModel | None) -> DataFrame:
    """doc_id, lang_pred and score (probability of that language) for each row of ``docs``.

    `und` with score 0 for a null text, one without a letter, or without a model. Texts are
    read whole; rows are judged one by one, so repeated rows give equal rows and an empty
    table an empty result. lang, source and doc_id never enter a score; other columns are ignored.
    """
    small_batches(docs.sparkSession)
    return docs.select(docs["doc_id"], docs["text"]).mapInArrow(lambda it: _predict(it, model), _DDL)


def language_query(docs: DataFrame) -> DataFrame:
    """Fit on the rows outside the held-out fold and predict for every row; see ``identify_languages``.

    A row without an id is never held out and never learned from. Without labelled rows all are `und`.
    """
    found = identify_languages(docs, fit_language_model(docs))
    return found.select("doc_id", held_out("doc_id", 4, 2).alias("held_out"), "lang_pred", "score")
