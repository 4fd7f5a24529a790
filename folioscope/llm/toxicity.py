"""Toxicity by a bidirectional gated recurrent network with attention pooling, in numpy.

Every word enters as the sum of a word vector (for words seen often enough in training) and
the mean vector of its character trigrams. Two gated recurrent layers read a window of words
forwards and backwards, attention pools their states, and a linear layer scores the window.
All overlapping windows of a text are scored; the text takes its highest window, and a
logistic calibration fitted on training texts outside the network's own turns it into the
probability of the label.

The labels hold for whole texts, so training first takes every window of a toxic text as
toxic and then only those that the network itself ranks highest.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from folioscope.llm.common import bounded_sample, held_out, one_text_each, remainder, small_batches
from folioscope.llm.words import LOWER, PLAIN, Words, blocks

#: Training rows at most (about) of each label: the network is fitted on a hash-chosen sample.
SAMPLE_TOXIC, SAMPLE_CLEAN = 1500, 3000
#: Longer labelled texts (in bytes) are not trained on, so that the sample is bounded in bytes too.
LONGEST_FIT_TEXT = 1 << 17
#: Windows of one training epoch: toxic ones at most (fewer than REPEATED come several times), clean
#: ones between the two bounds, and the number of highest windows taken from each toxic text. These
#: bound the work of fitting only; scoring takes all windows of all texts.
FIT_TOXIC, REPEATED, FIT_CLEAN, FIT_HIGHEST = 3072, 1024, (2048, 6144), 2
WINDOW, STRIDE = 32, 16
DIM, HIDDEN, ATTENTION = 8, 8, 8
CHAR_BUCKETS, WORD_SLOTS = 1 << 13, 1 << 17
#: A word needs this many training texts, and this share of them, for a vector of its own.
MIN_TEXTS, MIN_TEXT_SHARE = 3, 0.002
THRESHOLD = 0.7
#: Windows scored at once: about as many numbers as fit the processor's cache.
BATCH = 1024


@dataclass
class Network:
    """Parameters by name, and the vocabulary: ``slots`` maps a hash's low bits to a row of ``words``."""

    p: dict[str, np.ndarray]
    vocabulary: np.ndarray
    slots: np.ndarray
    slope: float = 1.0
    offset: float = 0.0
    base_rate: float = 0.0
    moments: dict[str, list] = field(default_factory=dict)


def new_network(vocabulary: np.ndarray, seed: int) -> Network:
    rng = np.random.default_rng(seed)
    normal = lambda scale, *shape: (rng.standard_normal(shape) * scale).astype(np.float32)
    slots = np.full(WORD_SLOTS, len(vocabulary), np.int32)
    slots[(vocabulary & np.uint64(WORD_SLOTS - 1)).astype(np.int64)] = np.arange(len(vocabulary))
    p = {
        "words": np.zeros((len(vocabulary) + 1, DIM), np.float32), "chars": normal(0.1, CHAR_BUCKETS, DIM),
        "w_in": normal(0.4, DIM, 6 * HIDDEN), "b_in": np.zeros(6 * HIDDEN, np.float32), "u": normal(0.3, 2, HIDDEN, 3 * HIDDEN),
        "w_att": normal(0.3, 2, HIDDEN, ATTENTION), "v_att": normal(0.3, ATTENTION), "w_out": normal(0.3, 2, HIDDEN), "b_out": np.zeros(1, np.float32),
    }
    return Network(p, vocabulary, slots)


@dataclass
class Block:
    """Words of a block: vocabulary row of each, trigram bucket of each word byte, and the bounds."""

    rows: np.ndarray
    buckets: np.ndarray
    bytes_at: np.ndarray
    first: np.ndarray
    hashes: np.ndarray


def read_block(data: np.ndarray, offsets: np.ndarray, net: Network) -> Block:
    data = LOWER[data]
    w = Words(data, offsets, PLAIN)
    h = w.hashes(data)
    length = w.end - w.start
    at = np.concatenate([[0], np.cumsum(length)])
    # byte positions of all words in turn, and their neighbours inside the word
    pos = np.arange(at[-1]) + np.repeat(w.start - at[:-1], length)
    c = data[pos].astype(np.uint32)
    left, right = np.zeros_like(c), np.zeros_like(c)
    left[1:], right[:-1] = c[:-1], c[1:]
    left[at[:-1]] = 0
    right[at[1:] - 1] = 0
    code = (left * np.uint32(65599) + c) * np.uint32(40503) + right * np.uint32(2654435761)
    code ^= code >> np.uint32(15)
    code *= np.uint32(2246822519)
    buckets = (code >> np.uint32(32 - 13)).astype(np.uint16)  # CHAR_BUCKETS fit
    rows = net.slots[(h & np.uint64(WORD_SLOTS - 1)).astype(np.int64)]
    known = np.append(net.vocabulary, np.uint64(0))
    rows = np.where(known[rows] == h, rows, len(net.vocabulary))
    return Block(rows, buckets, at, w.first, h)


def read_blocks(raw: list[bytes], net: Network) -> Block:
    """Words of many texts, read in small blocks; what is joined is let go at once, as this runs on the driver."""
    rows, buckets, lengths, words = [], [], [], []
    for lo in range(0, len(raw), 64):
        some = raw[lo : lo + 64]
        b = read_block(np.frombuffer(b"".join(some), np.uint8), np.concatenate([[0], np.cumsum([len(r) for r in some])]), net)
        for parts, part in ((rows, b.rows.astype(np.int32)), (buckets, b.buckets), (lengths, np.diff(b.bytes_at).astype(np.int32)), (words, np.diff(b.first))):
            parts.append(part)

    def joined(parts: list[np.ndarray]) -> np.ndarray:
        whole = np.concatenate(parts)
        parts.clear()
        return whole

    bounds = lambda n: np.concatenate([[0], np.cumsum(n, dtype=np.int64)])
    return Block(rows=joined(rows), buckets=joined(buckets), bytes_at=bounds(joined(lengths)), first=bounds(joined(words)), hashes=np.zeros(0, np.uint64))


def document_words(raw: list[bytes], least: float) -> np.ndarray:
    """Sorted hashes of the words that at least ``least`` texts hold."""
    each = []
    for r in raw:
        data = np.frombuffer(r, np.uint8)
        w = Words(LOWER[data], np.array([0, len(data)]), PLAIN)
        each.append(np.unique(w.hashes(LOWER[data])))
    word, texts = np.unique(np.concatenate(each), return_counts=True)
    return word[texts >= least]


def windows_of(first: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(document, first word, words) of all overlapping windows; the last one ends with its text."""
    n = np.diff(first)
    count = np.where(n > 0, np.maximum(0, -(-(n - WINDOW) // STRIDE)) + 1, 0)
    doc = np.repeat(np.arange(len(n)), count)
    nth = np.arange(len(doc)) - np.repeat(np.cumsum(count) - count, count)
    start = first[:-1][doc] + nth * STRIDE
    return doc, start, np.minimum(WINDOW, first[1:][doc] - start)


def inputs(p: dict, b: Block) -> np.ndarray:
    """Input vector of each word, and a zero row for padding."""
    x = np.zeros((len(b.rows) + 1, DIM), np.float32)
    if len(b.rows):
        chars = np.add.reduceat(p["chars"][b.buckets], b.bytes_at[:-1], axis=0)
        x[:-1] = p["words"][b.rows] + chars / np.diff(b.bytes_at)[:, None].astype(np.float32)
    return x


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 0.5 + 0.5 * np.tanh(0.5 * x)


def forward(p: dict, gates: np.ndarray, index: np.ndarray, mask: np.ndarray | None, keep: bool = False):
    """Window scores. ``gates`` has the input part of all gates for each word and direction
    (2, words + 1, 3 H); ``index`` the word of each place of each window; ``mask`` is None if no
    window is padded."""
    n, length = index.shape
    h = np.zeros((2, n, HIDDEN), np.float32)
    states = np.empty((length, 2, n, HIDDEN), np.float32)
    g = np.empty((2, n, 3 * HIDDEN), np.float32)
    tape = []
    for t in range(length):
        back = length - 1 - t
        np.take(gates[0], index[:, t], axis=0, out=g[0])
        np.take(gates[1], index[:, back], axis=0, out=g[1])
        u = np.matmul(h, p["u"])
        zr = _sigmoid(g[..., : 2 * HIDDEN] + u[..., : 2 * HIDDEN])
        z, r = zr[..., :HIDDEN], zr[..., HIDDEN:]
        c = np.tanh(g[..., 2 * HIDDEN :] + r * u[..., 2 * HIDDEN :])
        new = c + z * (h - c)
        if mask is not None:
            m = np.stack([mask[:, t], mask[:, back]])[..., None]
            new = np.where(m, new, h)
        if keep:
            tape.append((h, u[..., 2 * HIDDEN :], z, r, c))
        h = new
        states[t, 0], states[back, 1] = h[0], h[1]
    look = np.tanh(np.matmul(states, p["w_att"]).sum(1))
    energy = look @ p["v_att"]
    if mask is not None:
        energy = np.where(mask.T, energy, -1e9)
    weight = np.exp(energy - energy.max(0))
    weight /= weight.sum(0)
    each = np.einsum("tdnh,dh->tn", states, p["w_out"], optimize=True)
    score = (weight * each).sum(0) + p["b_out"][0]
    return (score, states, look, weight, each, tape) if keep else score


def backward(p: dict, index: np.ndarray, mask: np.ndarray, kept: tuple, d_score: np.ndarray):
    """Gradients of the parameters above the inputs, and of ``gates`` as (direction, place) pieces."""
    _, states, look, weight, each, tape = kept
    grad = {"b_out": np.array([d_score.sum()], np.float32)}
    pooled = (weight * each).sum(0)
    d_each = weight * d_score
    d_energy = weight * (each - pooled) * d_score
    grad["w_out"] = np.einsum("tn,tdnh->dh", d_each, states, optimize=True)
    grad["v_att"] = np.einsum("tn,tna->a", d_energy, look, optimize=True)
    d_look = d_energy[..., None] * p["v_att"] * (1 - look**2)
    grad["w_att"] = np.einsum("tdnh,tna->dha", states, d_look, optimize=True)
    d_states = d_each[:, None, :, None] * p["w_out"][None, :, None, :] + np.einsum("tna,dha->tdnh", d_look, p["w_att"], optimize=True)
    length = len(tape)
    d_u = np.zeros_like(p["u"])
    d_gates = np.zeros((2, length, index.shape[0], 3 * HIDDEN), np.float32)
    dh = np.zeros_like(tape[0][0])
    for t in range(length - 1, -1, -1):
        back = length - 1 - t
        h, uc, z, r, c = tape[t]
        dh = dh + np.stack([d_states[t, 0], d_states[back, 1]])
        m = np.stack([mask[:, t], mask[:, back]])[..., None]
        live = np.where(m, dh, 0.0)
        dc = live * (1 - z) * (1 - c**2)
        dz = live * (h - c) * z * (1 - z)
        dr = dc * uc * r * (1 - r)
        dg = np.concatenate([dz, dr, dc], -1)
        du = np.concatenate([dz, dr, dc * r], -1)
        d_gates[0, t], d_gates[1, back] = dg[0], dg[1]
        d_u += np.matmul(h.transpose(0, 2, 1), du)
        dh = np.where(m, live * z, dh) + np.matmul(du, p["u"].transpose(0, 2, 1))
    grad["u"] = d_u
    return grad, d_gates


def gates_of(p: dict, x: np.ndarray) -> np.ndarray:
    g = (x @ p["w_in"] + p["b_in"]).reshape(len(x), 2, 3 * HIDDEN)
    return np.ascontiguousarray(g.transpose(1, 0, 2))


def window_scores(net: Network, b: Block) -> tuple[np.ndarray, np.ndarray]:
    """(document, score) of every window of a block."""
    doc, start, size = windows_of(b.first)
    out = np.empty(len(doc), np.float32)
    gates = gates_of(net.p, inputs(net.p, b))
    places = np.arange(WINDOW)
    for full in (True, False):
        which = np.flatnonzero((size == WINDOW) == full)
        for lo in range(0, len(which), BATCH):
            at = which[lo : lo + BATCH]
            index, mask = start[at, None] + places, None
            if not full:
                mask = places < size[at, None]
                index = np.where(mask, index, len(b.rows))
            out[at] = forward(net.p, gates, index, mask)
    return doc, out


def _adam(net: Network, grad: dict[str, np.ndarray], step: int, rate: float, decay: float) -> None:
    for k, g in grad.items():
        m, v = net.moments.setdefault(k, [np.zeros_like(g), np.zeros_like(g)])
        m *= 0.9
        m += 0.1 * g
        v *= 0.99
        v += 0.01 * g * g
        net.p[k] -= rate * (m / (1 - 0.9**step) / (np.sqrt(v / (1 - 0.99**step)) + 1e-6) + decay * net.p[k])


def _batch(b: Block, start: np.ndarray, size: np.ndarray) -> tuple[Block, np.ndarray, np.ndarray]:
    """The words of some windows only, the place of each window word among them, and the mask of padding."""
    places = np.arange(WINDOW)
    mask = places < size[:, None]
    index = start[:, None] + places
    used = np.unique(index[mask])
    spans = b.bytes_at[used + 1] - b.bytes_at[used]
    begin = np.concatenate([[0], np.cumsum(spans)])
    at = np.arange(begin[-1]) + np.repeat(b.bytes_at[used] - begin[:-1], spans)
    small = Block(b.rows[used], b.buckets[at], begin, np.zeros(0), np.zeros(0))
    return small, np.where(mask, np.searchsorted(used, index), len(used)), mask


def _fit_epoch(net: Network, b: Block, start: np.ndarray, size: np.ndarray, y: np.ndarray, rng, step: int, rate: float) -> int:
    order = rng.permutation(len(y))
    for lo in range(0, len(order), 256):
        at = order[lo : lo + 256]
        small, local, mask = _batch(b, start[at], size[at])
        used, spans = small.rows, np.diff(small.bytes_at)
        x = inputs(net.p, small)
        kept = forward(net.p, gates_of(net.p, x), local, mask, keep=True)
        d_score = ((_sigmoid(kept[0]) - y[at]) / len(at)).astype(np.float32)
        grad, d_gates = backward(net.p, local, mask, kept, d_score)
        flat = np.zeros((len(used) + 1, 2, 3 * HIDDEN), np.float32)
        for d in range(2):
            np.add.at(flat[:, d], local.T, d_gates[d])
        flat = flat.reshape(len(flat), -1)
        grad["w_in"], grad["b_in"] = x.T @ flat, flat[:-1].sum(0)
        dx = (flat @ net.p["w_in"].T)[:-1]
        grad["words"], grad["chars"] = np.zeros_like(net.p["words"]), np.zeros_like(net.p["chars"])
        np.add.at(grad["words"], small.rows, dx)
        np.add.at(grad["chars"], small.buckets, np.repeat(dx / spans[:, None].astype(np.float32), spans, axis=0))
        grad["words"][-1] = 0
        step += 1
        _adam(net, grad, step, rate, 1e-3)
    return step


def _logistic(s: np.ndarray, y: np.ndarray, w: np.ndarray) -> tuple[float, float]:
    """Slope and offset of a weighted logistic regression in one variable, by damped Newton steps."""
    theta = np.zeros(2)
    x = np.stack([s, np.ones_like(s)], 1)
    for _ in range(60):
        q = 1 / (1 + np.exp(-np.clip(x @ theta, -30, 30)))
        g = x.T @ (w * (q - y)) + np.array([1e-3, 0.0]) * theta
        hess = (x * (w * q * (1 - q))[:, None]).T @ x + np.eye(2) * 1e-3
        theta -= np.clip(np.linalg.solve(hess, g), -1, 1)
    return float(max(0.0, theta[0])), float(theta[1])


def train(texts: list[str], labels: list[int], toxic_rate: float, seed: int = 2, epochs: int = 10) -> Network | None:
    """Fit on whole labelled texts; every fourth one is kept for the calibration. None without both labels."""
    y = np.array(labels, np.int64)
    if not (y == 1).any() or not (y == 0).any():
        return None
    rng = np.random.default_rng(seed)
    raw = [(t or "").encode() for t in texts]
    fold = np.zeros(len(y), np.int64)
    for label in (0, 1):
        at = np.flatnonzero(y == label)
        fold[at] = rng.permutation(len(at)) % 4
    vocabulary = document_words([r for r, f in zip(raw, fold, strict=True) if f != 3], max(MIN_TEXTS, MIN_TEXT_SHARE * len(y)))
    net = new_network(vocabulary, seed)
    b = read_blocks(raw, net)
    del raw
    doc, start, size = windows_of(b.first)
    fit = fold[doc] != 3
    step = 0
    for epoch in range(epochs):
        toxic, clean = np.flatnonzero(fit & (y[doc] == 1)), np.flatnonzero(fit & (y[doc] == 0))
        if epoch >= 3:  # the windows that the network ranks highest in each toxic text
            s = _scores_at(net, b, start[toxic], size[toxic])
            by = np.lexsort((-s, doc[toxic]))
            of = doc[toxic][by]
            begin = np.concatenate([[True], of[1:] != of[:-1]])
            place = np.arange(len(by)) - np.maximum.accumulate(np.where(begin, np.arange(len(by)), 0))
            toxic = toxic[by][place < FIT_HIGHEST]
        many = min(len(clean), max(2 * len(toxic), FIT_CLEAN[0]), FIT_CLEAN[1])
        toxic = rng.choice(toxic, FIT_TOXIC, replace=False) if len(toxic) > FIT_TOXIC else np.tile(toxic, max(1, REPEATED // max(1, len(toxic))))
        at = np.concatenate([toxic, rng.choice(clean, many, replace=False)])
        step = _fit_epoch(net, b, start[at], size[at], y[doc[at]].astype(np.float32), rng, step, 0.01 if epoch < epochs - 3 else 0.003)
    net.moments = {}
    at = np.flatnonzero(fold[doc] == 3)
    best = np.full(len(y), -np.inf)
    np.maximum.at(best, doc[at], _scores_at(net, b, start[at], size[at]))
    ok = np.isfinite(best)
    share = {1: toxic_rate, 0: 1 - toxic_rate}
    w = np.array([share[v] / max(1, (y[ok] == v).sum()) for v in y[ok]]) * ok.sum()
    net.slope, net.offset = _logistic(best[ok], y[ok].astype(float), w)
    net.base_rate = toxic_rate
    return net


def _scores_at(net: Network, b: Block, start: np.ndarray, size: np.ndarray) -> np.ndarray:
    out = np.empty(len(start), np.float32)
    for lo in range(0, len(start), BATCH):
        small, local, mask = _batch(b, start[lo : lo + BATCH], size[lo : lo + BATCH])
        out[lo : lo + BATCH] = forward(net.p, gates_of(net.p, inputs(net.p, small)), local, mask)
    return out


def text_scores(net: Network, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Probability of the label for each text: of its highest window; the base rate without a word."""
    b = read_block(data, offsets, net)
    doc, s = window_scores(net, b)
    best = np.full(len(offsets) - 1, -np.inf)
    np.maximum.at(best, doc, s)
    z = net.slope * best + net.offset
    return np.where(np.isfinite(best), 1 / (1 + np.exp(-np.clip(z, -30, 30))), net.base_rate)


OUT = pa.schema([("doc_id", pa.int64()), ("score", pa.float64())])


def _score_all(batches: Iterator[pa.RecordBatch], net: Network | None) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for lo, hi, data, offsets in blocks(batch.column(1)):
            s = text_scores(net, data, offsets) if net is not None else np.zeros(hi - lo)
            yield pa.RecordBatch.from_arrays([batch.column(0).slice(lo, hi - lo), pa.array(s, pa.float64())], schema=OUT)


def fit_toxicity(docs: DataFrame, labels: DataFrame, fold: int | None = 1, modulus: int = 3, sample: tuple[int, int] = (SAMPLE_TOXIC, SAMPLE_CLEAN)) -> Network | None:
    """Train on about ``sample`` toxic and clean rows outside the held-out remainder; None without both labels.

    Rows without an id and labels other than 0 and 1 are not learned from. A repeated label counts once, and
    of an id that repeats with several texts one is learned from, so the rows are bounded by ``sample``.
    """
    known = labels.select("doc_id", "toxic").where("doc_id is not null and toxic in (0, 1)").distinct()
    if fold is not None:
        known = known.where(remainder("doc_id", modulus) != fold)
    count = {r["toxic"]: r["count"] for r in known.groupBy("toxic").count().collect()}
    if not count.get(0) or not count.get(1):
        return None
    picked = bounded_sample(known.where("toxic = 1"), ("doc_id", "toxic"), sample[0], 21, count[1])
    picked = picked.unionByName(bounded_sample(known.where("toxic = 0"), ("doc_id", "toxic"), sample[1], 22, count[0]))
    # the sample has a documented bound, so it may be broadcast, and only its texts come to the driver
    short = docs.select("doc_id", "text").where(F.coalesce(F.octet_length("text"), F.lit(0)) <= LONGEST_FIT_TEXT)
    got = one_text_each(short.join(F.broadcast(picked), "doc_id"), "doc_id", "toxic").orderBy("doc_id", "text", "toxic").toPandas()
    return train(got["text"].tolist(), got["toxic"].tolist(), count[1] / (count[0] + count[1]))


def score_toxicity(docs: DataFrame, net: Network | None) -> DataFrame:
    """doc_id and score for each row of ``docs``, from its whole text.

    A null or empty text, or one without a word, gets the label's base rate in training; without
    a network (no labelled rows of both kinds) every score is 0. Rows are judged one by one:
    repeated rows give equal rows, an empty table an empty result. Other columns are ignored.
    """
    small_batches(docs.sparkSession)
    return docs.select(docs["doc_id"], docs["text"]).mapInArrow(lambda it: _score_all(it, net), "doc_id long, score double")


def _score_rows(batches: Iterator[pa.RecordBatch], net: Network, column: str) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        at = batch.schema.get_field_index(column)
        for lo, hi, data, offsets in blocks(batch.column(at)):
            part = batch.slice(lo, hi - lo)
            keep = text_scores(net, data, offsets) < THRESHOLD
            yield part.filter(pa.array(keep))


def without_toxic(docs: DataFrame, net: Network | None) -> DataFrame:
    """The rows of ``docs`` that score below THRESHOLD, with all their columns; all of them without a network.

    Each row is judged by its own text: repeated ids and repeated rows are no special case, and ids are
    not looked at. A null or empty text, or one without a word, has the base rate as its score.
    An empty table stays empty; columns may have any names.
    """
    if net is None:
        return docs
    small_batches(docs.sparkSession)
    return docs.mapInArrow(lambda it: _score_rows(it, net, "text"), docs.schema)


def toxicity_query(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """Fit on the labelled rows outside the held-out fold and score every row; see ``score_toxicity``.

    A row without an id is never held out and never learned from.
    """
    scored = score_toxicity(docs, fit_toxicity(docs, labels))
    return scored.select("doc_id", held_out("doc_id", 3, 1).alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))
