"""Spans of texts that consist of given bytes, coded against the distinct spans of a slab."""

from __future__ import annotations

import numpy as np
import pyarrow as pa

from .chunks import utf8

FOLD = np.arange(256, dtype=np.uint8)
FOLD[0x41:0x5B] += 0x20


def coded_spans(texts: pa.Array, member: np.ndarray) -> tuple[list[bytes], np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Maximal runs of bytes in ``member`` (a table of 256 flags), A-Z lower-cased; no run crosses texts.

    Returns the distinct chunks (runs and what lies between), and for each run in order its place among
    them, its text and its first byte; then all bytes.
    """
    data, starts = utf8(texts)
    inside = member[data]
    edge = np.zeros(len(data) + 1, bool)
    edge[starts] = True  # a text's first byte opens a run whatever ends the text before
    opens, closes = inside.copy(), inside.copy()
    opens[1:] &= ~inside[:-1] | edge[1:-1]
    closes[:-1] &= ~inside[1:] | edge[1:-1]
    first, last = np.flatnonzero(opens), np.flatnonzero(closes) + 1
    doc = np.searchsorted(starts, first, "right") - 1
    bounds = np.empty(max(2 * len(first), 1), np.int64)
    bounds[:] = 0
    bounds[0:2 * len(first):2], bounds[1:2 * len(first):2] = first, last
    # runs at even places, what lies between at odd ones
    chunk = pa.Array.from_buffers(pa.large_binary(), len(bounds) - 1, [None, pa.py_buffer(bounds), pa.py_buffer(FOLD[data])])
    coded = chunk.dictionary_encode()
    return coded.dictionary.to_pylist(), np.asarray(coded.indices)[0::2], doc, first, data
