"""Arrow text columns as flat byte arrays, so that tasks can work with numpy on whole batches.

A batch of texts is one ``uint8`` array and the offsets of its rows. Nothing here builds a Python string per word.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Texts are handled in slices of about this many bytes, which bounds a task's memory; a longer text is a slice alone.
SLICE_BYTES = 500_000

#: Longest span that is hashed as one sum.
HASHED_BYTES = 128

_BASE = np.uint64(0x9E3779B97F4A7C15 | 1)


def _table(seed: int) -> np.ndarray:
    """256 pseudo-random 64-bit values."""
    return mix(np.arange(1, 257, dtype=np.uint64) * np.uint64(0xD1342543DE82EF95) + np.uint64(seed))


def mix(x: np.ndarray) -> np.ndarray:
    """Spread 64-bit values evenly (the finaliser of the public SplitMix64 generator)."""
    with np.errstate(over="ignore"):
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        return x ^ (x >> np.uint64(31))


BYTE_VALUE, OTHER_VALUE = _table(7), _table(1 << 20)
SPACE_BYTE = np.zeros(256, bool)
SPACE_BYTE[[9, 10, 11, 12, 13, 32]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
#: First bytes of code points, that is all but UTF-8 continuation bytes.
LEAD_BYTE = (np.arange(256) & 0xC0) != 0x80


@lru_cache(maxsize=1)
def _powers(size: int) -> tuple[np.ndarray, np.ndarray]:
    inverse = np.uint64(pow(int(_BASE), -1, 1 << 64))
    with np.errstate(over="ignore"):
        up = np.full(size, _BASE, np.uint64)
        up[0] = 1
        down = np.full(size, inverse, np.uint64)
        down[0] = 1
        return np.multiply.accumulate(up), np.multiply.accumulate(down)


def powers(size: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the hash base and of its inverse modulo 2**64, at least ``size`` of each."""
    return _powers(max(1 << 20, 1 << int(size).bit_length()))


def flat(column: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and int64 offsets of a string or binary column; null is empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = pc.fill_null(column, b"" if pa.types.is_binary(column.type) or pa.types.is_large_binary(column.type) else "")
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    _, where, data = column.buffers()
    offsets = np.frombuffer(where, np.int64 if wide else np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64) if len(column) else np.zeros(1, np.int64)
    raw = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return raw[offsets[0] : offsets[-1]], offsets - offsets[0]


def slices(batch: pa.RecordBatch, column: str, limit: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """Consecutive parts of a batch with about ``limit`` bytes of text each, a row at least."""
    _, offsets = flat(batch.column(column))
    start = 0
    while start < batch.num_rows:
        stop = max(start + 1, int(np.searchsorted(offsets, offsets[start] + limit, "right")) - 1)
        yield batch.slice(start, stop - start)
        start = stop


def words(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of all words, and for each row the number of words before it (one more entry than rows)."""
    full = ~SPACE_BYTE[data]
    first = full.copy()
    last = full.copy()
    if len(data):
        first[1:] &= ~full[:-1]
        last[:-1] &= ~full[1:]
        heads = offsets[:-1][offsets[:-1] < offsets[1:]]
        tails = offsets[1:][offsets[:-1] < offsets[1:]] - 1
        first[heads] = full[heads]
        last[tails] = full[tails]
    starts = np.flatnonzero(first)
    return starts, np.flatnonzero(last) + 1, np.searchsorted(starts, offsets)


def prefix_hash(data: np.ndarray, value: np.ndarray = BYTE_VALUE) -> np.ndarray:
    """Sums of byte values times powers of the base; see ``span_hash``. Another table of values gives another hash."""
    up, _ = powers(len(data) + 1)
    total = np.zeros(len(data) + 1, np.uint64)
    with np.errstate(over="ignore"):
        np.cumsum(value[data] * up[: len(data)], out=total[1:])
    return total


def _span_sums(prefix: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    _, down = powers(len(prefix))
    with np.errstate(over="ignore"):
        return mix((prefix[ends] - prefix[starts]) * down[starts] + (ends - starts).astype(np.uint64))


def span_hash(prefix: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64-bit hashes of the byte spans; equal bytes give equal hashes wherever they stand, in any batch.

    Sums of powers modulo 2**64 collide by construction for some pairs of spans of 1,024 bytes and more. So a span beyond
    ``HASHED_BYTES`` is cut into parts of that length from its start on, whose hashes are mixed with their places and added.
    """
    out = _span_sums(prefix, starts, ends)
    long = np.flatnonzero(ends - starts > HASHED_BYTES)
    if len(long):
        first, last = starts[long], ends[long]
        n = -(-(last - first) // HASHED_BYTES)
        row, place = ragged(n)
        begin = first[row] + place * HASHED_BYTES
        with np.errstate(over="ignore"):
            part = mix(_span_sums(prefix, begin, np.minimum(begin + HASHED_BYTES, last[row])) + (place + 1).astype(np.uint64) * _BASE)
            out[long] = mix(np.add.reduceat(part, np.cumsum(n) - n) + (last - first).astype(np.uint64))
    return out


def sequence_hash(values: np.ndarray, width: int) -> np.ndarray:
    """Hashes of all runs of ``width`` consecutive values; run i starts at value i."""
    if len(values) < width:
        return np.zeros(0, np.uint64)
    n = len(values) - width + 1
    out = np.zeros(n, np.uint64)
    with np.errstate(over="ignore"):
        for k in range(width):
            out = out * _BASE + values[k : k + n]
        return mix(out)


def ragged(counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For rows of the given lengths: the row of each element and its place within the row."""
    row = np.repeat(np.arange(len(counts)), counts)
    before = np.cumsum(counts) - counts
    return row, np.arange(len(row)) - before[row]
