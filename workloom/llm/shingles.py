"""Hashes of words and word shingles, by numpy on the UTF-8 bytes of many texts at a time."""

from __future__ import annotations

import numpy as np
import pyarrow as pa

#: Bytes of text that are hashed at once; a longer word is taken whole.
CHUNK = 1 << 19

_rng = np.random.default_rng(20240501)
_draw = lambda n: _rng.integers(1, 1 << 63, n, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
#: A random value for each byte; A to Z share those of a to z, white space has 0.
_BYTE = _draw(256)
_BYTE[65:91] = _BYTE[97:123]
_SPACE = np.zeros(256, bool)
_SPACE[[32, 9, 10, 11, 12, 13]] = True
_BYTE[_SPACE] = 0
#: Odd factors of the words of a shingle, and what a shorter sequence adds by its length.
_PLACE, _SHORT = _draw(64), _draw(64)
_POWERS = np.ones(1, np.uint64)


def _powers(n: int) -> np.ndarray:
    """Powers of an odd base modulo 2**64, at least n of them."""
    global _POWERS
    if len(_POWERS) < n:
        base = np.full(max(n, 64), 0x9E3779B97F4A7C15, np.uint64)
        base[0] = 1
        _POWERS = np.multiply.accumulate(base)
    return _POWERS


def mixed(h: np.ndarray) -> np.ndarray:
    """A bijection of 64 bits that spreads every bit over all (the finalizer of MurmurHash3)."""
    h = h ^ (h >> np.uint64(33))
    h = h * np.uint64(0xFF51AFD7ED558CCD)
    h = h ^ (h >> np.uint64(33))
    h = h * np.uint64(0xC4CEB9FE1A85EC53)
    return h ^ (h >> np.uint64(33))


def _hashed(data: np.ndarray, edges: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hash and start of each word of data; edges: offsets at which a word ends in any case."""
    space = _SPACE[data]
    begins = ~space
    begins[1:] &= space[:-1]
    inner = edges[(edges > 0) & (edges < len(data))]
    begins[inner] = ~space[inner]
    starts = np.flatnonzero(begins)
    if not len(starts):
        return np.zeros(0, np.uint64), starts
    span = np.diff(np.append(starts, len(data)))
    place = np.arange(starts[0], len(data)) - np.repeat(starts, span)
    values = _BYTE[data[starts[0] :]] * _powers(int(span.max()))[place]
    return mixed(np.add.reduceat(values, starts - starts[0])), starts


def word_hashes(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all words of all texts, A to Z lower-cased, and for each text the number of words before it (and the total)."""
    texts = texts.cast(pa.large_binary())
    n = len(texts)
    if not n:
        return np.zeros(0, np.uint64), np.zeros(1, np.int64)
    _, offsets, data = texts.buffers()
    offsets = np.frombuffer(offsets, np.int64)[texts.offset : texts.offset + n + 1]
    data = np.frombuffer(data, np.uint8)[offsets[0] : offsets[-1]] if data is not None else np.zeros(0, np.uint8)
    edges = offsets - offsets[0]
    hashes, starts, at = [], [], 0
    while at < len(data):
        end = min(at + CHUNK, len(data))
        while end < len(data) and not _SPACE[data[end]]:
            step = np.flatnonzero(_SPACE[data[end : end + CHUNK]])
            end = min(len(data), end + (int(step[0]) if len(step) else CHUNK))
        low, high = np.searchsorted(edges, [at, end])
        h, s = _hashed(data[at:end], edges[low:high] - at)
        hashes.append(h)
        starts.append(s + at)
        at = end
    if not hashes:
        return np.zeros(0, np.uint64), np.zeros(n + 1, np.int64)
    return np.concatenate(hashes), np.searchsorted(np.concatenate(starts), edges).astype(np.int64)


def shingle_hashes(words: np.ndarray, k: int = 5) -> np.ndarray:
    """Hash of each run of k words; of the whole sequence if it is shorter; nothing if it is empty."""
    if not len(words):
        return words
    if len(words) < k:
        return mixed((words * _PLACE[: len(words)]).sum(keepdims=True, dtype=np.uint64) + _SHORT[len(words)])
    m = len(words) - k + 1
    total = words[:m] * _PLACE[0]
    for i in range(1, k):
        total += words[i : i + m] * _PLACE[i]
    return mixed(total)


def shingle_sets(texts: pa.Array, k: int = 5) -> list[np.ndarray]:
    """The sorted distinct shingle hashes of each text."""
    words, begin = word_hashes(texts)
    return [np.unique(shingle_hashes(words[a:b], k)) for a, b in zip(begin[:-1], begin[1:], strict=True)]
