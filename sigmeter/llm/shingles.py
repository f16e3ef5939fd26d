"""Distinct word-shingle sets of texts as sorted 64-bit hashes, in numpy."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

from .chunks import HELD, slabs, utf8

WIDTH = 5
_RNG = np.random.default_rng(20240229)
_BYTE = _RNG.integers(1, 2**63, 256, np.uint64)
_SPACE = np.zeros(256, bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True
_FOLD = np.arange(256, dtype=np.uint8)
_FOLD[0x41:0x5B] += 0x20
_BASE = 0x9E3779B97F4A7C15 | 1
_INVERSE = pow(_BASE, -1, 2**64)
_STEP = np.uint64(0xD6E8FEB86659FD93)
_BLOCK = (1 << 20) + 1  # a slab of texts and one


def _powers(base: int, n: int) -> np.ndarray:
    out = np.empty(n, np.uint64)
    out[0] = 1
    if n > 1:
        out[1:] = base
        np.multiply.accumulate(out, out=out)
    return out


_TABLES: dict[str, np.ndarray] = {}
HELD["shingles"] = _TABLES.clear


def _power_tables(n: int) -> tuple[np.ndarray, np.ndarray]:
    if n > _BLOCK:  # one long text; what it needs is not kept
        return _powers(_BASE, n), _powers(_INVERSE, n)
    if not _TABLES:
        _TABLES.update(up=_powers(_BASE, _BLOCK), down=_powers(_INVERSE, _BLOCK))
    return _TABLES["up"], _TABLES["down"]


def mix(h: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit words that spreads every bit."""
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def word_hashes(data: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hash of each lower-cased word in order, and the number of words before each text (and in all)."""
    inside = ~_SPACE[data]
    opens = inside.copy()
    opens[1:] &= ~inside[:-1]
    at = starts[:-1][starts[:-1] < len(data)]
    opens[at] = inside[at]  # a text's first byte opens a word whatever ends the text before
    first = np.flatnonzero(opens)
    closes = inside.copy()
    closes[:-1] &= ~inside[1:] | opens[1:]
    last = np.flatnonzero(closes) + 1
    up, down = _power_tables(len(data) + 1)
    total = np.zeros(len(data) + 1, np.uint64)
    np.cumsum(_BYTE[_FOLD[data]] * up[:len(data)], out=total[1:])
    h = (total[last] - total[first]) * down[first] + (last - first).astype(np.uint64) * _STEP
    return mix(h), np.searchsorted(first, starts)


def sets(texts: pa.Array, budget: int = 1 << 20) -> Iterator[np.ndarray]:
    """Sorted distinct shingle hashes of each text, in order.

    Fewer than five words make one shingle of them all; no word, an empty or a null text make none.
    """
    for a, b in slabs(texts, budget):
        data, starts = utf8(texts.slice(a, b - a))
        words, before = word_hashes(data, starts)
        n = max(len(words) - WIDTH + 1, 0)
        rolled = np.zeros(n, np.uint64)
        for j in range(WIDTH):
            rolled = rolled * _STEP + words[j:j + n]
        rolled = mix(rolled)
        for i in range(b - a):
            lo, hi = int(before[i]), int(before[i + 1])
            if hi - lo >= WIDTH:
                s = np.sort(rolled[lo:hi - WIDTH + 1])
                yield s[np.concatenate([[True], s[1:] != s[:-1]])]
            elif hi > lo:
                h = np.array([hi - lo], np.uint64)
                for j in range(lo, hi):
                    h = h * _STEP + words[j:j + 1]
                yield mix(h)
            else:
                yield np.zeros(0, np.uint64)
