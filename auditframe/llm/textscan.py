"""Vectorised word scan over Arrow string batches.

Words are maximal runs of bytes other than 0x20 and 0x09-0x0D after A-Z has been
lower-cased. The separators are ASCII, so scanning the UTF-8 bytes is exact. A
word's identity is a 64-bit polynomial fingerprint (finalised with a bijective
mixer); a shingle's identity combines the fingerprints of its words in order.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

#: Odd multiplier of the polynomial and its inverse modulo 2**64.
_BASE = 0x9E6C_63D0_876A_3F2B
_BASE_INV = pow(_BASE, -1, 2**64)
_SEP = np.zeros(256, bool)
_SEP[[0x20, *range(0x09, 0x0E)]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_BYTE = (np.arange(256, dtype=np.uint64) + np.uint64(1)) * np.uint64(0xD6E8_FEB8_6659_FD93)
_EMPTY = np.zeros(0, np.uint64)
_powers: list[np.ndarray] = []


def _power_tables(n: int) -> tuple[np.ndarray, np.ndarray]:
    """B**i and B**-i modulo 2**64 for i in 0..n, kept for the worker's life."""
    if not _powers or len(_powers[0]) <= n:
        size = max(n + 1, 1 << 20)
        out = []
        for base in (_BASE, _BASE_INV):
            p = np.full(size, base, np.uint64)
            p[0] = 1
            out.append(np.cumprod(p, dtype=np.uint64))
        _powers[:] = out
    return _powers[0], _powers[1]


def mix64(x: np.ndarray) -> np.ndarray:
    """Bijective 64-bit finaliser (xor-shift and multiply, twice)."""
    x = x ^ (x >> np.uint64(32))
    x = x * np.uint64(0xD6E8_FEB8_6659_FD93)
    x = x ^ (x >> np.uint64(29))
    x = x * np.uint64(0xA5CB_9243_F2A1_9E4D)
    return x ^ (x >> np.uint64(32))


def text_slices(texts: pa.Array, max_bytes: int = 1 << 17) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """Consecutive runs of rows of at most ``max_bytes`` of text (a longer row
    stands alone): (first row, bytes, row offsets into them). Null is empty."""
    texts = texts.cast(pa.large_binary())
    n = len(texts)
    if n == 0:
        return
    _, offsets, data = texts.buffers()
    offs = np.frombuffer(offsets, np.int64, n + 1, texts.offset * 8)
    raw = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    a = 0
    while a < n:
        b = max(a + 1, int(np.searchsorted(offs, offs[a] + max_bytes, "right")) - 1)
        b = min(b, n)
        yield a, raw[offs[a]:offs[b]], offs[a:b + 1] - offs[a]
        a = b


def word_hashes(raw: np.ndarray, offs: np.ndarray, lower: bool = True) -> tuple[np.ndarray, np.ndarray]:
    """(fingerprint of each word, row bounds into them): row i has words
    ``bounds[i]:bounds[i + 1]``."""
    rows = len(offs) - 1
    if not len(raw):
        return _EMPTY, np.zeros(rows + 1, np.int64)
    word = ~_SEP[raw]
    before = np.empty_like(word)
    before[0] = False
    before[1:] = word[:-1]
    heads = offs[:-1][offs[:-1] < offs[1:]]
    before[heads] = False
    starts = np.flatnonzero(word & ~before)
    after = np.empty_like(word)
    after[-1] = False
    after[:-1] = word[1:]
    after[offs[1:][offs[:-1] < offs[1:]] - 1] = False
    ends = np.flatnonzero(word & ~after) + 1
    up, down = _power_tables(len(raw))
    sums = np.empty(len(raw) + 1, np.uint64)
    sums[0] = 0
    np.cumsum(_BYTE[_LOWER[raw] if lower else raw] * down[:len(raw)], out=sums[1:])
    h = (sums[ends] - sums[starts]) * up[starts]
    return mix64(h + (ends - starts).astype(np.uint64)), np.searchsorted(starts, offs)


def shingle_hashes(words: np.ndarray, k: int) -> np.ndarray:
    """Fingerprints of the k-word shingles of one row, in order; with fewer
    than k words the whole sequence is the only shingle; none without words."""
    n = len(words)
    if n == 0:
        return _EMPTY
    k = min(k, n)
    acc = np.zeros(n - k + 1, np.uint64)
    for j in range(k):
        acc = (acc + words[j:n - k + 1 + j]) * np.uint64(_BASE)
    return mix64(acc + np.uint64(k))


def shingle_set(words: np.ndarray, k: int) -> np.ndarray:
    """Sorted distinct shingle fingerprints of one row."""
    h = np.sort(shingle_hashes(words, k))
    return h[np.concatenate([[True], h[1:] != h[:-1]])] if len(h) else h
