"""Whole-text word segmentation and hashing on the UTF-8 bytes of an Arrow batch.

Texts are taken in blocks of about a megabyte, so that memory does not grow with
batch or document length beyond the longest single document.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa

BLOCK_BYTES = 1 << 20

#: Odd multipliers of the hashes.
_STEP = np.uint64(0x9E3779B97F4A7C15)
_GOLD = np.uint64(0xD6E8FEB86659FD93)
#: Words of more bytes are hashed one by one with BLAKE2; they are few.
LANES = 32
_LOW = np.array([(1 << (8 * k)) - 1 for k in range(8)] + [(1 << 64) - 1], np.uint64)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective scrambling of 64-bit values."""
    x = x ^ (x >> np.uint64(32))
    x = x * _GOLD
    x = x ^ (x >> np.uint64(29))
    x = x * _STEP
    return x ^ (x >> np.uint64(32))


def lowered() -> np.ndarray:
    """Byte table that lower-cases A-Z and keeps everything else."""
    t = np.arange(256, dtype=np.uint8)
    t[65:91] += 32
    return t


def spaced_words() -> np.ndarray:
    """Bytes of words [^\\x20\\x09-\\x0D]+."""
    t = np.ones(256, bool)
    t[[0x20, *range(0x09, 0x0E)]] = False
    return t


def plain_words() -> np.ndarray:
    """Bytes of words [^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+, which are taken after lower-casing."""
    t = np.ones(256, bool)
    t[0x00:0x30] = False
    t[0x3A:0x61] = False
    t[0x7B:0x80] = False
    return t


LOWER, SPACED, PLAIN = lowered(), spaced_words(), plain_words()
#: For the plain words before lower-casing: A-Z count as word bytes too.
PLAIN_ANY = PLAIN.copy()
PLAIN_ANY[65:91] = True


def blocks(texts: pa.Array, limit: int = BLOCK_BYTES) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, end row, bytes, offsets) of runs of rows; null texts have no bytes."""
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    texts = texts.cast(pa.large_binary())
    n = len(texts)
    if not n:
        return
    if texts.null_count:
        texts = texts.fill_null(b"")
    _, offs, data = texts.buffers()
    offsets = np.frombuffer(offs, np.int64)[texts.offset : texts.offset + n + 1]
    raw = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    at = 0
    while at < n:
        end = int(np.searchsorted(offsets, offsets[at] + limit, "right")) - 1
        end = min(n, max(at + 1, end))
        lo, hi = int(offsets[at]), int(offsets[end])
        yield at, end, raw[lo:hi], offsets[at : end + 1] - lo
        at = end


class Words:
    """Words of one block: byte ``start`` and ``end``, and ``first`` word of each document (one more at the end)."""

    __slots__ = ("start", "end", "first", "n_docs")

    def __init__(self, data: np.ndarray, offsets: np.ndarray, kind: np.ndarray, cuts: np.ndarray | None = None):
        """``kind`` tells word bytes; ``cuts`` are places where a word ends and another begins all the same."""
        self.n_docs = len(offsets) - 1
        inside = np.zeros(len(data) + 2, bool)
        inside[1:-1] = kind[data]
        cut = offsets[1:-1] if cuts is None else np.concatenate([offsets[1:-1], cuts])
        edge = inside[1:] != inside[:-1]
        start = np.flatnonzero(edge & inside[1:])
        end = np.flatnonzero(edge & inside[:-1])
        # a document boundary inside a run of word bytes cuts it in two
        split = np.unique(cut[(cut > 0) & (cut < len(data))]) if len(cut) else cut
        split = split[inside[split] & inside[split + 1]] if len(split) else split
        if len(split):
            start = np.sort(np.concatenate([start, split]))
            end = np.sort(np.concatenate([end, split]))
        self.start, self.end = start, end
        self.first = np.searchsorted(start, offsets)

    def __len__(self) -> int:
        return len(self.start)

    def doc(self) -> np.ndarray:
        return np.repeat(np.arange(self.n_docs), np.diff(self.first))

    def hashes(self, data: np.ndarray) -> np.ndarray:
        """A 64-bit hash of each word's bytes.

        Eight bytes at a time are mixed into the state, with shifts and products in turn, so
        the hash is no linear function of the bytes; words of up to eight bytes and one length
        never collide.
        """
        length = self.end - self.start
        h = length.astype(np.uint64) * _GOLD
        eights = lanes(data)
        at = np.flatnonzero(length <= 8 * LANES)
        place = self.start[at]
        left = length[at]
        while len(at):
            lane = eights[place] & _LOW[np.minimum(left, 8)]
            h[at] = mix(h[at] ^ lane)
            more = np.flatnonzero(left > 8)
            at, place, left = at[more], place[more] + 8, left[more] - 8
        for i in np.flatnonzero(length > 8 * LANES).tolist():
            raw = data[self.start[i] : self.end[i]].tobytes()
            h[i] = int.from_bytes(hashlib.blake2b(raw, digest_size=8).digest(), "little")
        return h


def lanes(data: np.ndarray) -> np.ndarray:
    """The eight bytes that begin at each byte, as one number; zeros follow the end."""
    padded = np.zeros(len(data) + 8, np.uint8)
    padded[: len(data)] = data
    return np.ndarray((len(data) + 1,), "<u8", padded, strides=(1,))


def same_words(data: np.ndarray, start: np.ndarray, other: np.ndarray, length: np.ndarray) -> np.ndarray:
    """Whether the ``length`` bytes from each ``start`` equal those from ``other``."""
    eights = lanes(data)
    same = np.ones(len(start), bool)
    at = np.flatnonzero(start != other)
    a, b, left = start[at], other[at], length[at]
    while len(at):
        low = _LOW[np.minimum(left, 8)]
        same[at] &= (eights[a] & low) == (eights[b] & low)
        more = np.flatnonzero((left > 8) & same[at])
        at, a, b, left = at[more], a[more] + 8, b[more] + 8, left[more] - 8
    return same


def word_hash(word: bytes) -> int:
    """The hash of a single word, equal to that of ``Words.hashes``."""
    data = np.frombuffer(word, np.uint8)
    every = np.ones(256, bool)
    return int(Words(data, np.array([0, len(data)]), every).hashes(data)[0])


_gram = np.random.default_rng(77).integers(1, 2**63, 64, dtype=np.uint64) | np.uint64(1)


def grams(h: np.ndarray, n: int) -> np.ndarray:
    """A hash of each n consecutive hashes; shorter inputs give none. Does not look at document bounds."""
    if len(h) < n:
        return np.zeros(0, np.uint64)
    m = len(h) - n + 1
    out = h[:m] * _gram[0]
    for k in range(1, n):
        out += h[k : k + m] * _gram[k]
    return mix(out)
