"""Multinomial block counts by a splitting tree.

A draw picks n of n blocks with replacement. How often block i is picked follows from a binary tree
over block indices: a node that was dealt c picks gives its left child Binomial(c, left size / size) of
them and the rest to the right. Every node's number is keyed by (seed, draw, height, prefix), so any
index range can be expanded alone, and any partitioning gives the same counts.
"""

from __future__ import annotations

from functools import lru_cache

import numpy as np

MASK = np.uint64(0xFFFFFFFF)
SPREAD, DRAW_SPREAD, MIX = 2654435761, 2246822519, 73244475  # odd multipliers of the 32-bit hash
HALF_TABLE = 1024  # counts below this use one table of fair splits
WINDOW = 12.0  # standard deviations around the mode that a distribution is tabled for


def mixed(x: np.ndarray) -> np.ndarray:
    """32-bit mixing of 64-bit words that hold 32-bit values."""
    for _ in range(2):
        x = ((x ^ (x >> np.uint64(16))) * np.uint64(MIX)) & MASK
    return x ^ (x >> np.uint64(16))


def uniforms(seed: int, draws: np.ndarray, height: int, prefixes: np.ndarray) -> np.ndarray:
    """draws x prefixes uniforms in (0, 1) with 32 bits."""
    node = mixed(((prefixes.astype(np.uint64) * np.uint64(64) + np.uint64(height)) * np.uint64(SPREAD) + np.uint64(seed)) & MASK)
    draw = mixed((draws.astype(np.uint64) * np.uint64(DRAW_SPREAD) + np.uint64(1)) & MASK)
    return (mixed(node[None, :] ^ draw[:, None]).astype(np.float64) + 0.5) / 2.0**32


def distribution(n: int, p: float) -> tuple[int, np.ndarray]:
    """First value and cumulated probabilities of Binomial(n, p) around its mode."""
    mode = min(int((n + 1) * p), n)
    w = int(WINDOW * np.sqrt(n * p * (1 - p))) + 24
    lo, hi = max(0, mode - w), min(n, mode + w)
    up, down = np.arange(mode, hi, dtype=float), np.arange(mode, lo, -1, dtype=float)
    right = np.cumprod((n - up) / (up + 1) * (p / (1 - p)))
    left = np.cumprod(down / (n - down + 1) * ((1 - p) / p))[::-1]
    pmf = np.concatenate([left, [1.0], right])
    return lo, np.cumsum(pmf / pmf.sum())


@lru_cache(maxsize=1)
def _fair(size: int) -> tuple[np.ndarray, np.ndarray]:
    """All fair splits of fewer than ``size`` picks: c plus the cumulated probabilities, end to end, and where each c begins."""
    parts, start = [], np.zeros(size, np.int64)
    for c in range(size):
        lo, cdf = distribution(c, 0.5)
        full = np.zeros(c + 1)
        full[lo:lo + len(cdf)] = cdf
        full[lo + len(cdf):] = 1.0
        parts.append(c + np.minimum(full, np.nextafter(1.0, 0)))
        start[c] = start[c - 1] + c if c else 0
    return np.concatenate(parts), start


def binomial(c: np.ndarray, p: float, u: np.ndarray) -> np.ndarray:
    """Binomial(c, p) by inversion of ``u``."""
    out = np.zeros(c.shape, np.int64)
    small = (c < HALF_TABLE) & (p == 0.5)
    if small.any():
        flat, start = _fair(HALF_TABLE)
        out[small] = np.minimum(np.searchsorted(flat, c[small] + u[small], "right") - start[c[small]], c[small])
    rest = ~small & (c > 0)
    for n in np.unique(c[rest]):
        at = rest & (c == n)
        lo, cdf = distribution(int(n), p)
        out[at] = np.minimum(lo + np.searchsorted(cdf, u[at], "right"), n)
    return out


def multiplicities(seed: int, draws: np.ndarray, n_blocks: int, start: int, height: int) -> np.ndarray:
    """draws x blocks: how often each block of ``[start, start + 2**height)`` below ``n_blocks`` is picked; start is a multiple of 2**height."""
    c = np.full(len(draws), n_blocks, np.int64)
    for h in range(max(n_blocks - 1, 0).bit_length(), height, -1):
        prefix, half = start >> h, 1 << (h - 1)
        size = min(1 << h, n_blocks - (prefix << h))
        right = (start >> (h - 1)) & 1
        if size > half:
            k = binomial(c, half / size, uniforms(seed, draws, h, np.array([prefix]))[:, 0])
            c = c - k if right else k
    counts, first = c[:, None], start >> height
    for h in range(height, 0, -1):
        half, width = 1 << (h - 1), counts.shape[1]
        prefix = first + np.arange(width)
        size = np.minimum(1 << h, n_blocks - (prefix << h))
        left = counts.copy()  # a node without a right child gives all to its left
        full = size == 1 << h
        if full.any():
            left[:, full] = binomial(counts[:, full], 0.5, uniforms(seed, draws, h, prefix[full]))
        for i in np.flatnonzero((size > half) & ~full):
            left[:, i] = binomial(counts[:, i], half / size[i], uniforms(seed, draws, h, prefix[i:i + 1])[:, 0])
        both = np.empty((len(draws), 2 * width), np.int64)
        both[:, 0::2], both[:, 1::2] = left, counts - left
        first *= 2
        counts = both[:, :max(-(-(n_blocks - (first << (h - 1))) // half), 0)]
    return counts


@lru_cache(maxsize=4)
def all_multiplicities(seed: int, first: int, last: int, n_blocks: int, height: int = 10) -> np.ndarray:
    """Draws first to last - 1 over all blocks, for tasks whose blocks are few; a worker keeps the last ones."""
    draws = np.arange(first, last)
    return np.concatenate([multiplicities(seed, draws, n_blocks, a, height) for a in range(0, n_blocks, 1 << height)], 1)


@lru_cache(maxsize=8)
def day_table(seed: int, first: int, last: int, n_blocks: int) -> np.ndarray:
    """As ``all_multiplicities``, blocks x draws in floating point: the draws of a block lie side by side."""
    return np.ascontiguousarray(all_multiplicities(seed, first, last, n_blocks).T.astype(float))
