"""Distinct-chunk table for tokenizers.

Texts are cut where no token can cross, each distinct chunk is tokenized once, and ids are joined
back by position with numpy. The table lives as long as the Python worker and starts anew when it
holds ``limit`` chunks, so memory is bounded and results never depend on what it holds.
"""

from __future__ import annotations

import ctypes
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

_LIBC = ctypes.CDLL(None)
HELD: dict[str, Callable[[], None]] = {}  # what drops the tables that a Python worker keeps between tasks

# Bytes that may open a character which is not white space, after ASCII control and space.
_OPENS_WORD = np.zeros(256, bool)
_OPENS_WORD[0x21:0x7F] = True
_OPENS_WORD[0xC3:0xE1] = True  # C2, E1, E2 and E3 also open white space
_OPENS_WORD[0xE4:0xF5] = True


def utf8(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes of all texts end to end, and the offset of each text. Null counts as empty."""
    arr = texts.cast(pa.large_binary()).fill_null(b"")
    offsets = np.frombuffer(arr.buffers()[1], np.int64)[arr.offset:arr.offset + len(arr) + 1]
    data = np.frombuffer(arr.buffers()[2] or b"", np.uint8)
    return data[offsets[0]:offsets[-1]], offsets - offsets[0]


def cut_at_space_before_word(data: np.ndarray) -> np.ndarray:
    """Positions of spaces directly before a visible character: byte-level pre-tokens never cross them."""
    return np.flatnonzero((data[:-1] == 0x20) & _OPENS_WORD[data[1:]])


def cut_at_space_after_other(data: np.ndarray) -> np.ndarray:
    """Positions of the first space of each run: pieces have markers only in front."""
    return np.flatnonzero((data[1:] == 0x20) & (data[:-1] != 0x20)) + 1


class ChunkTable:
    """chunk -> ids, filled through ``encode(list[bytes]) -> list[list[int]]``."""

    def __init__(self, encode: Callable[[list[bytes]], list[list[int]]], limit: int = 200_000):
        self.encode, self.limit = encode, limit
        self.reset()

    def reset(self) -> None:
        self.at: dict[bytes, int] = {}
        self.offsets = np.zeros(1, np.int64)
        self.ids = np.zeros(0, np.uint32)

    def rows(self, distinct: list[bytes]) -> np.ndarray:
        """Row of each chunk in the table."""
        if len(self.at) + len(distinct) > self.limit:
            self.reset()
        at = self.at
        fresh = [c for c in distinct if c not in at]
        if fresh:
            got = self.encode(fresh)
            base = len(at)
            at.update(zip(fresh, range(base, base + len(fresh))))
            sizes = np.fromiter(map(len, got), np.int64, len(got))
            flat = np.fromiter((i for g in got for i in g), np.uint32, int(sizes.sum()))
            self.offsets = np.concatenate([self.offsets, self.offsets[-1] + np.cumsum(sizes)])
            self.ids = np.concatenate([self.ids, flat])
        return np.fromiter((at[c] for c in distinct), np.int64, len(distinct))

    def cut(self, data: np.ndarray, starts: np.ndarray, cuts: Callable[[np.ndarray], np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Table rows of the distinct chunks, the distinct chunk at each position, and the number of chunks before each text."""
        inner = cuts(data) if len(data) else np.zeros(0, np.int64)
        bounds = np.sort(np.concatenate([inner, starts]), kind="stable")  # the end of the last text is among starts
        bounds = bounds[np.concatenate([[True], bounds[1:] != bounds[:-1]])]
        chunk = pa.Array.from_buffers(pa.large_binary(), len(bounds) - 1,
                                      [None, pa.py_buffer(np.ascontiguousarray(bounds, np.int64)), pa.py_buffer(data)])
        coded = chunk.dictionary_encode()
        return self.rows(coded.dictionary.to_pylist()), np.asarray(coded.indices), np.searchsorted(bounds, starts)

    def join(self, row: np.ndarray, before: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """ids of all texts end to end and the offset of each text's ids."""
        first, size = self.offsets[row], self.offsets[row + 1] - self.offsets[row]
        ends = np.cumsum(size)
        take = np.arange(int(ends[-1]) if len(ends) else 0) + np.repeat(first - (ends - size), size)
        return self.ids[take], np.concatenate([[0], ends]).astype(np.int64)[before]


def give_back() -> None:
    """Return freed memory to the system: idle Python workers stay alive beside the executor's heap."""
    pa.default_memory_pool().release_unused()
    if hasattr(_LIBC, "malloc_trim"):
        _LIBC.malloc_trim(0)


def forget_tables(but: str = "") -> None:
    """Before another operator's work in the same worker: the tables of earlier ones go; they are filled anew when wanted."""
    for name, drop in HELD.items():
        if name != but:
            drop()
    give_back()


def small(batches: Iterator[pa.RecordBatch], budget: int = 4 << 20) -> Iterator[pa.RecordBatch]:
    """The batches cut so that the texts of each take little memory as Python objects."""
    for batch in batches:
        for a, b in slabs(batch.column("text"), budget):
            yield batch.slice(a, b - a)
        give_back()


def slabs(texts: pa.Array, budget: int = 8 << 20):
    """Row ranges of about ``budget`` bytes of text (one text at least)."""
    sizes = pc.fill_null(pc.binary_length(texts), 0).to_pylist()
    start = total = 0
    for i, n in enumerate(sizes):
        if i > start and total + n > budget:
            yield start, i
            start, total = i, 0
        total += n
    if len(sizes) > start:
        yield start, len(sizes)
