"""Words and shingles of many texts as 64-bit hashes, computed with numpy on Arrow's buffers.

A word's hash is a polynomial in table values of its bytes, mixed with its length; a shingle's hash is a mixed sum of
its words' hashes with a multiplier for each place.  Texts are walked in bounded segments that end between words.
"""

from __future__ import annotations

import sys

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import cloudpickle

SEGMENT = 1 << 20
_rng = np.random.default_rng(20_011)
BASE = np.uint64(_rng.integers(1 << 62, 1 << 63)) | np.uint64(1)
UNBASE = np.uint64(pow(int(BASE), -1, 1 << 64))
TABLE = _rng.integers(0, 1 << 63, 256).astype(np.uint64) * np.uint64(2) + np.uint64(1)
LOWERED = TABLE.copy()
LOWERED[65:91] = TABLE[97:123]  # A-Z count as a-z
PLACES = _rng.integers(0, 1 << 63, 64).astype(np.uint64) * np.uint64(2) + np.uint64(1)
SPACE = np.zeros(256, bool)
SPACE[[0x20, *range(0x09, 0x0E)]] = True


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser: every input bit reaches every output bit."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _powers(base: np.uint64, n: int) -> np.ndarray:
    return np.concatenate([np.ones(1, np.uint64), np.cumprod(np.full(n, base, np.uint64), dtype=np.uint64)])


def text_bytes(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(all UTF-8 bytes in a row, n + 1 offsets); null is empty."""
    texts = pc.cast(pc.fill_null(texts, ""), pa.large_string())
    at = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1]
    if texts.buffers()[2] is None or at[-1] == at[0]:
        return np.empty(0, np.uint8), at - at[0]
    return np.frombuffer(texts.buffers()[2], np.uint8)[at[0] : at[-1]], at - at[0]


def word_bounds(data: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(starts, stops, n + 1 offsets into them) of the words; none crosses from one text to the next."""
    inside = ~SPACE[data]
    fresh = np.zeros(len(data) + 1, bool)
    fresh[ends] = True
    starts = inside.copy()
    starts[1:] &= ~inside[:-1] | fresh[1:-1]
    stops = inside.copy()
    stops[:-1] &= ~inside[1:] | fresh[1:-1]
    first = np.flatnonzero(starts)
    return first, np.flatnonzero(stops) + 1, np.searchsorted(first, ends)


def hash_words(data: np.ndarray, first: np.ndarray, stops: np.ndarray, table: np.ndarray = LOWERED) -> np.ndarray:
    out = np.empty(len(first), np.uint64)
    up, down, at = _powers(BASE, SEGMENT), _powers(UNBASE, SEGMENT), 0
    while at < len(first):
        to = max(at + 1, int(np.searchsorted(stops, first[at] + SEGMENT, side="right")))
        lo, hi = first[at], stops[to - 1]
        if hi - lo > SEGMENT:  # one word longer than a segment
            up, down = _powers(BASE, hi - lo), _powers(UNBASE, hi - lo)
        sums = np.zeros(hi - lo + 1, np.uint64)
        np.cumsum(table[data[lo:hi]] * up[: hi - lo], out=sums[1:])
        a, b = first[at:to] - lo, stops[at:to] - lo
        out[at:to] = mix((sums[b] - sums[a]) * down[a] + (b - a).astype(np.uint64))
        at = to
    return out


def shingle_sets(texts: pa.Array, size: int = 5) -> list[np.ndarray]:
    """Each text's sorted distinct shingle hashes; with fewer words its whole sequence is one, with none there is none."""
    data, ends = text_bytes(texts)
    first, stops, at = word_bounds(data, ends)
    words = hash_words(data, first, stops)
    n = len(words)
    runs = np.zeros(max(0, n - size + 1), np.uint64)
    for j in range(size):
        runs += words[j : j + len(runs)] * PLACES[j]
    runs = mix(runs)
    out = []
    for i in range(len(at) - 1):
        a, b = at[i], at[i + 1]
        if b - a >= size:
            out.append(np.unique(runs[a : b - size + 1]))
        elif b > a:
            short = (words[a:b] * PLACES[: b - a]).sum(dtype=np.uint64, keepdims=True)
            out.append(mix(short + np.uint64(b - a)))
        else:
            out.append(np.empty(0, np.uint64))
    return out


cloudpickle.register_pickle_by_value(sys.modules[__name__])
