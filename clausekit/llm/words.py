"""Whole texts as numpy word hashes, straight from Arrow's UTF-8 buffers.

A batch of texts is cut into chunks of bounded bytes (one long text may exceed
the bound and then is a chunk by itself).  Every word of a chunk gets a 64-bit
polynomial hash over its bytes, computed for all words at once from prefix
sums, so no Python loop runs per text or per word.
"""

from __future__ import annotations

import sys
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle

# executors need no copy of this package: its functions travel with the task
cloudpickle.register_pickle_by_value(sys.modules[__name__])

CHUNK_BYTES = 1 << 20
_MASK = (1 << 64) - 1
_BASE = 0x9E3779B97F4A7C15 | 1
_WS = (0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D)


def mix64(x: np.ndarray) -> np.ndarray:
    """Finaliser: spreads every input bit over all 64 output bits."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def byte_table(lower: bool = True, separators: bytes = bytes(_WS)) -> np.ndarray:
    """uint8 -> uint8 map: separators become 0x20, A-Z become a-z."""
    t = np.arange(256, dtype=np.uint8)
    if lower:
        t[65:91] += 32
    t[list(separators)] = 0x20
    return t


@dataclass
class Words:
    """The words of a run of texts; ``first[d]:first[d + 1]`` are those of text d."""

    hash: np.ndarray    # uint64, one per word
    start: np.ndarray   # byte offset in ``data``
    end: np.ndarray
    first: np.ndarray   # int64, texts + 1
    data: np.ndarray    # mapped bytes of the chunk
    offsets: np.ndarray  # byte offsets of the texts in ``data``

    @property
    def doc(self) -> np.ndarray:
        return np.repeat(np.arange(len(self.first) - 1), np.diff(self.first))


def utf8(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of a string column; a null is an empty text."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = column.fill_null("").cast(pa.large_string())
    n = len(column)
    _, off, dat = column.buffers()
    o = np.frombuffer(off, np.int64)[column.offset:column.offset + n + 1] if n else np.zeros(1, np.int64)
    d = np.frombuffer(dat, np.uint8) if dat is not None else np.zeros(0, np.uint8)
    return d[o[0]:o[-1]], o - o[0]


def chunks(column: pa.Array, limit: int = CHUNK_BYTES) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first text, last text + 1, bytes, offsets) for runs of texts of at most
    ``limit`` bytes, or one longer text."""
    data, off = utf8(column)
    n, lo = len(off) - 1, 0
    while lo < n:
        hi = max(lo + 1, int(np.searchsorted(off, off[lo] + limit, "right")) - 1)
        yield lo, hi, data[off[lo]:off[hi]], off[lo:hi + 1] - off[lo]
        lo = hi


class _Cache(dict):
    """Made again in every process: travels with a task's functions as empty."""

    def __reduce__(self):
        return _Cache, ()


_POWERS = _Cache()


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    have = _POWERS.get("p")
    if have is None or len(have) < n:
        n = max(n, CHUNK_BYTES + 1)
        for key, base in (("p", _BASE), ("i", pow(_BASE, -1, 1 << 64))):
            a = np.full(n, base, np.uint64)
            a[0] = 1
            _POWERS[key] = np.multiply.accumulate(a)
    return _POWERS["p"][:n], _POWERS["i"]


def _code() -> np.ndarray:
    return mix64(np.arange(1, 257, dtype=np.uint64) * np.uint64(0xD6E8FEB86659FD93))


def split_words(data: np.ndarray, offsets: np.ndarray, table: np.ndarray) -> Words:
    """Words are maximal runs of bytes that ``table`` does not map to 0x20."""
    b = table[data]
    word = b != 0x20
    prev = np.empty_like(word)
    prev[:1] = False
    prev[1:] = word[:-1]
    cut = offsets[1:-1]
    cut = cut[cut < len(b)]
    prev[cut] = False
    start = np.flatnonzero(word & ~prev)
    nxt = np.empty_like(word)
    nxt[-1:] = False
    nxt[:-1] = word[1:]
    nxt[cut[cut > 0] - 1] = False
    end = np.flatnonzero(word & ~nxt) + 1
    p, inv = _powers(len(b) + 1)
    sums = np.zeros(len(b) + 1, np.uint64)
    np.cumsum(_code()[b] * p[:len(b)], out=sums[1:])
    h = mix64((sums[end] - sums[start]) * inv[start] + (end - start).astype(np.uint64))
    first = np.searchsorted(start, offsets).astype(np.int64)
    return Words(h, start, end, first, b, offsets)


def combine(parts: list[np.ndarray]) -> np.ndarray:
    """Order-sensitive hash of equally long columns of hashes."""
    out = np.zeros(len(parts[0]), np.uint64)
    for p in parts:
        out = mix64(out * np.uint64(_BASE) + p)
    return out


def grams(w: Words, k: int, whole_short: bool = True) -> tuple[np.ndarray, np.ndarray]:
    """(hash, text) of every k-word window; a text of 1 to k - 1 words gives its
    whole sequence as one gram if ``whole_short``, an empty one gives none."""
    n = np.diff(w.first)
    if len(w.hash) >= k:
        m = len(w.hash) - k + 1
        h = combine([w.hash[j:j + m] for j in range(k)])
        doc = w.doc
        ok = doc[:m] == doc[k - 1:]
        h, d = h[ok], doc[:m][ok]
    else:
        h, d = np.zeros(0, np.uint64), np.zeros(0, np.int64)
    if whole_short:
        short = np.flatnonzero((n > 0) & (n < k))
        if len(short):
            hs = np.empty(len(short), np.uint64)
            for size in range(1, k):
                at = np.flatnonzero(n[short] == size)
                s = w.first[short[at]]
                hs[at] = combine([w.hash[s + j] for j in range(size)]) ^ np.uint64(size) if len(at) else 0
            h, d = np.concatenate([h, hs]), np.concatenate([d, short])
    return h, d
