"""Whole batches of texts into word hashes, without a Python loop over words."""

from __future__ import annotations

import functools
import sys

import numpy as np

#: Odd multipliers of the polynomial and of the mixer.
BASE, MIX = 0x9E3779B97F4A7C15 | 1, 0xBF58476D1CE4E5B9


def mix(x: np.ndarray) -> np.ndarray:
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(MIX)
    return x ^ (x >> np.uint64(31))


@functools.cache
def alnum_table() -> np.ndarray:
    """True at the code points of letters and digits."""
    return np.frombuffer(bytes(chr(c).isalnum() for c in range(sys.maxunicode + 1)), dtype=bool)


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """BASE**i and its inverse modulo 2**64 for i < n."""
    up, down = np.full(n, np.uint64(BASE)), np.full(n, np.uint64(pow(BASE, -1, 2**64)))
    up[0] = down[0] = 1
    return np.multiply.accumulate(up), np.multiply.accumulate(down)


def code_points(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Code points of the lower-cased texts, each followed by a line end, and the offset at which each text begins."""
    lower = [t.lower() for t in texts]
    at = np.zeros(len(texts) + 1, dtype=np.int64)
    np.cumsum([len(t) + 1 for t in lower], out=at[1:])
    return np.frombuffer(("\n".join(lower) + "\n").encode("utf-32-le", "surrogatepass"), dtype=np.uint32), at


def slices(texts: list[str], chars: int = 1_000_000) -> list[tuple[int, int]]:
    """Ranges of texts of about ``chars`` characters each, so that memory doesn't follow the batch; a longer text has its own."""
    out, begin, size = [], 0, 0
    for i, t in enumerate(texts):
        if size and size + len(t) > chars:
            out.append((begin, i))
            begin, size = i, 0
        size += len(t)
    return [*out, (begin, len(texts))] if texts else out


def word_hashes(texts: list[str], table: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """64-bit hashes of all words of the texts (longest runs of letters and digits, lower case) and each text's first index, with the total last."""
    if not texts:
        return np.zeros(0, np.uint64), np.zeros(1, np.int64)
    cp, at = code_points(texts)
    inside = table[cp]
    edge = np.diff(np.concatenate([[False], inside, [False]]).astype(np.int8))
    start, end = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
    up, down = powers(len(cp) + 1)
    total = np.concatenate([[np.uint64(0)], np.cumsum(mix(cp.astype(np.uint64) + np.uint64(1)) * up[:-1])])
    return mix((total[end] - total[start]) * down[start]), np.searchsorted(start, at)


def shingle_hashes(words: np.ndarray, first: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of every run of k words that lies in one text, and each text's first index, with the total last."""
    n = len(words) - k + 1
    if n <= 0:
        return np.zeros(0, np.uint64), np.zeros(len(first), np.int64)
    out = words[:n].copy()
    for i in range(1, k):
        out = mix(out * np.uint64(BASE) + words[i : n + i])
    count = np.maximum(np.diff(first) - k + 1, 0)
    keep = np.repeat(first[:-1], count) + (np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count))
    return out[keep], np.concatenate([[0], np.cumsum(count)])
