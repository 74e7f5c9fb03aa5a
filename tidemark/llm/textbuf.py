"""Whole-batch text scanning with numpy over Arrow string buffers.

A batch of texts is one run of UTF-8 bytes plus offsets. Word boundaries and 64-bit word
hashes come from a few array passes over that run, so no Python object is made per word.
Null texts count as empty. Hashes are polynomials modulo 2**64 of random byte weights; every
use of them as a match is followed by an exact comparison or stays within one batch.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

_RNG = np.random.default_rng(20240229)
#: Odd weights of the 256 byte values, and the odd base of the polynomial.
BYTE_WEIGHT = _RNG.integers(0, 2**63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
BASE = np.uint64(0x9E3779B97F4A7C15 | 1)
_MIX = np.uint64(0xFF51AFD7ED558CCD)
_POW = {"up": np.ones(1, np.uint64), "down": np.ones(1, np.uint64)}
_INVERSE = pow(int(BASE), -1, 2**64)


def lowered() -> np.ndarray:
    """Byte table that maps A-Z to a-z and leaves all else."""
    table = np.arange(256, dtype=np.uint8)
    table[65:91] += 32
    return table


def space_table() -> np.ndarray:
    """True for the bytes of words `[^\\x20\\x09-\\x0D]+`."""
    table = np.ones(256, bool)
    table[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = False
    return table


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """BASE**i and BASE**-i for i < n; grown by doubling, kept between batches."""
    if len(_POW["up"]) < n:
        size = 1 << max(16, int(n).bit_length() if n & (n - 1) else int(n - 1).bit_length())
        for key, base in (("up", int(BASE)), ("down", _INVERSE)):
            steps = np.full(size, base, np.uint64)
            steps[0] = 1
            _POW[key] = np.multiply.accumulate(steps)
    return _POW["up"][:n], _POW["down"][:n]


def buffer_of(column: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of a string column; a null has no bytes."""
    if isinstance(column, pa.ChunkedArray):
        column = pa.concat_arrays(column.chunks) if column.num_chunks != 1 else column.chunk(0)
    column = column.cast(pa.large_string())
    n = len(column)
    if not n:
        return np.empty(0, np.uint8), np.zeros(1, np.int64)
    if column.null_count:
        column = column.fill_null("")
    _, offs, data = column.buffers()
    offs = np.frombuffer(offs, np.int64)[column.offset : column.offset + n + 1]
    raw = np.frombuffer(data, np.uint8) if data is not None else np.empty(0, np.uint8)
    return raw[offs[0] : offs[-1]], offs - offs[0]


def slices(batch: pa.RecordBatch, name: str, most_bytes: int = (2 << 20) - (64 << 10), most_rows: int = 4096):
    """Consecutive row ranges (start, stop) of `most_rows` at most whose texts hold about `most_bytes`, one row at least."""
    column = batch.column(batch.schema.get_field_index(name))
    if not len(column):
        return
    ends = np.cumsum(np.nan_to_num(np.asarray(
        pc.binary_length(column).fill_null(0).to_numpy(zero_copy_only=False), np.int64)))
    start = 0
    while start < len(ends):
        base = ends[start - 1] if start else 0
        stop = min(start + most_rows, max(start + 1, int(np.searchsorted(ends, base + most_bytes, "right"))))
        yield start, stop
        start = stop


def runs(inside: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the maximal runs of True, never across a document's bounds."""
    if not len(inside):
        return np.empty(0, np.int64), np.empty(0, np.int64)
    first = np.empty(len(inside), bool)
    first[0] = inside[0]
    np.greater(inside[1:], inside[:-1], out=first[1:])
    last = np.empty(len(inside), bool)
    last[-1] = inside[-1]
    np.greater(inside[:-1], inside[1:], out=last[:-1])
    cuts = offsets[1:-1]
    cuts = cuts[(cuts > 0) & (cuts < len(inside))]
    first[cuts] = inside[cuts]
    last[cuts - 1] = inside[cuts - 1]
    return np.flatnonzero(first), np.flatnonzero(last) + 1


def owner(starts: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """For each document the index of its first run; length documents + 1."""
    return np.searchsorted(starts, offsets, "left")


def spread(starts: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """start, start + 1, ... of `counts` places for each start, end to end."""
    before = np.cumsum(counts) - counts
    return np.repeat(starts - before, counts) + np.arange(int(counts.sum()))


def span_hash(raw: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit hash of raw[start:end] for each span; equal bytes, equal hash, at any place."""
    if not len(starts):
        return np.empty(0, np.uint64)
    up, down = _powers(len(raw) + 1)
    total = np.zeros(len(raw) + 1, np.uint64)
    np.cumsum(BYTE_WEIGHT[raw] * up[: len(raw)], out=total[1:])
    h = (total[ends] - total[starts]) * down[starts]
    h ^= (ends - starts).astype(np.uint64) * _MIX
    h ^= h >> np.uint64(32)
    h *= _MIX
    return h ^ (h >> np.uint64(29))


def window_hash(words: np.ndarray, size: int) -> np.ndarray:
    """Hash of each run of `size` consecutive word hashes; length len(words) - size + 1."""
    n = len(words) - size + 1
    if n <= 0:
        return np.empty(0, np.uint64)
    out = np.zeros(n, np.uint64)
    for k in range(size):
        out *= BASE
        out += words[k : k + n]
    out ^= out >> np.uint64(31)
    return out * _MIX
