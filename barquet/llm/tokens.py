"""Words of UTF-8 texts as numpy arrays: small helpers for tasks that get Arrow batches.

A batch is worked through in slices of bounded size, whatever the length of its texts; all that is kept for a slice
are arrays with an entry for each word.
"""

from __future__ import annotations

import ctypes
from collections.abc import Callable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

#: Bytes of text that a task holds in arrays at a time; a longer text is a slice of its own.
SLICE_BYTES = 4 << 20
#: Bytes that the rolling hash takes at a time.
PIECE = 1 << 20
BASE = 0x9E3779B97F4A7C15 | 1


def slices(batch: pa.RecordBatch, column: str, limit: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """Cut a batch into runs of rows whose texts take about ``limit`` bytes."""
    sizes = np.diff(text_bytes(batch.column(batch.schema.get_field_index(column)))[1])
    group = (np.cumsum(sizes) - sizes) // limit
    cuts = [0, *(np.flatnonzero(np.diff(group)) + 1), len(sizes)]
    for a, b in zip(cuts[:-1], cuts[1:], strict=True):
        if b > a:
            yield batch.slice(a, b - a)


def give_back() -> None:
    """Return to the system what this process has freed, which numpy's and Arrow's allocators would keep."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # glibc has it
    if trim:
        trim(0)


def mapped(rows: DataFrame, work: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], schema: str | T.StructType) -> DataFrame:
    """``rows.mapInArrow(work, schema)``, whose workers don't wait for their next task with the memory of the last one."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            yield from work(batches)
        finally:
            give_back()

    return rows.mapInArrow(run, schema)


def text_bytes(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """All bytes of the texts, and where each begins (one more entry than texts); null is empty. A text may be a list of words."""
    if pa.types.is_list(texts.type):
        body, at = text_bytes(texts.flatten())
        return body, at[np.concatenate([[0], np.cumsum(texts.value_lengths().fill_null(0).to_numpy(zero_copy_only=False))])]
    texts = texts.cast(pa.large_string()).fill_null("")
    if not len(texts):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    _, at, data = texts.buffers()
    offsets = np.frombuffer(at, np.int64)[texts.offset : texts.offset + len(texts) + 1]
    body = np.frombuffer(data, np.uint8)[offsets[0] : offsets[-1]] if data is not None else np.zeros(0, np.uint8)
    return body, offsets - offsets[0]


@lru_cache
def _separators() -> np.ndarray:
    """Bytes 0x20 and 0x09 to 0x0D separate words."""
    table = np.zeros(256, bool)
    table[[0x20, *range(0x09, 0x0E)]] = True
    return table


@lru_cache
def _lowered() -> np.ndarray:
    table = np.arange(256, dtype=np.uint8)
    table[ord("A") : ord("Z") + 1] += 32
    return table


def lower_ascii(data: np.ndarray) -> np.ndarray:
    return _lowered()[data]


def word_bounds(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start and end of each word, and the number of words of each text."""
    inside = ~_separators()[data]
    edge = np.zeros(len(data) + 1, bool)
    edge[offsets] = True
    before = np.concatenate([[False], inside[:-1]]) if len(data) else inside
    after = np.concatenate([inside[1:], [False]]) if len(data) else inside
    starts = np.flatnonzero(inside & (~before | edge[:-1]))
    ends = np.flatnonzero(inside & (~after | edge[1:])) + 1
    return starts, ends, np.diff(np.searchsorted(starts, offsets))


@lru_cache
def _powers() -> tuple[np.ndarray, np.ndarray, np.ndarray, np.uint64, np.uint64]:
    """Value of each byte; powers of the base and of its inverse modulo 2**64, and both for a whole piece."""
    inverse = pow(BASE, -1, 1 << 64)
    up, down = (np.full(PIECE + 1, x, np.uint64) for x in (BASE, inverse))
    up[0] = down[0] = 1
    with np.errstate(over="ignore"):
        up, down = np.cumprod(up), np.cumprod(down)
    return mix64(np.arange(1, 257, dtype=np.uint64)), up[:PIECE], down[:PIECE], up[PIECE], down[PIECE]


def mix64(x: np.ndarray) -> np.ndarray:
    """Spread 64-bit values evenly (the finalizer of SplitMix64)."""
    with np.errstate(over="ignore"):
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        return x ^ (x >> np.uint64(31))


def word_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit hash of the bytes of each word."""
    values, up, down, up_all, down_all = _powers()
    at_start, at_end = np.zeros(len(starts), np.uint64), np.zeros(len(ends), np.uint64)
    back = np.ones(len(starts), np.uint64)
    total, scale, unscale = np.uint64(0), np.uint64(1), np.uint64(1)
    with np.errstate(over="ignore"):
        for base in range(0, len(data), PIECE):
            piece = data[base : base + PIECE]
            sums = np.empty(len(piece) + 1, np.uint64)
            sums[0] = total
            np.cumsum(values[piece] * up[: len(piece)] * scale, out=sums[1:])
            sums[1:] += total
            a, b = np.searchsorted(starts, [base, base + len(piece)])
            here = starts[a:b] - base
            at_start[a:b], back[a:b] = sums[here], down[here] * unscale
            a, b = np.searchsorted(ends, [base + 1, base + len(piece) + 1])
            at_end[a:b] = sums[ends[a:b] - base]
            total, scale, unscale = sums[-1], scale * up_all, unscale * down_all
        return mix64((at_end - at_start) * back)


def combine(first: np.ndarray, second: np.ndarray) -> np.ndarray:
    """Hash of a pair of hashes, in order."""
    with np.errstate(over="ignore"):
        return mix64(first * np.uint64(0xD6E8FEB86659FD93) + second)


def code_points(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Code points of UTF-8 bytes, and where each text begins among them."""
    lead = (data & 0xC0) != 0x80
    at = np.flatnonzero(lead)
    padded = np.concatenate([data, np.zeros(3, np.uint8)]).astype(np.uint32)
    b0, b1, b2, b3 = (padded[at + k] for k in range(4))
    out = np.where(b0 < 0x80, b0, ((b0 & 0x1F) << 6) | (b1 & 0x3F))
    out = np.where(b0 >= 0xE0, ((b0 & 0x0F) << 12) | ((b1 & 0x3F) << 6) | (b2 & 0x3F), out)
    out = np.where(b0 >= 0xF0, ((b0 & 0x07) << 18) | ((b1 & 0x3F) << 12) | ((b2 & 0x3F) << 6) | (b3 & 0x3F), out)
    return np.minimum(out, 0x10FFFF), np.searchsorted(at, offsets)
