"""Words of whole texts as numpy arrays, taken from Arrow buffers without a Python object per word.

A word is a run of bytes other than 0x20 and 0x09-0x0D, with A-Z folded to a-z. Its 64-bit hash is a polynomial over a fixed
random byte table, finished by a mixer; it depends on the word alone, not on where it stands.
"""

from __future__ import annotations

from typing import Iterator, NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column
from pyspark.sql import functions as F

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Bytes of text that are hashed at once, and bytes of one piece of running sums: what a worker holds beside its batch.
CHUNK_BYTES, PIECE = 1 << 19, 1 << 18

_BREAKS = np.zeros(256, bool)
_BREAKS[[0x20, *range(0x09, 0x0E)]] = True
_BYTES = np.random.RandomState(20011).randint(0, 2**64, 256, dtype=np.uint64)
_BYTES[65:91] = _BYTES[97:123]
_BASE = 0x9E3779B97F4A7C15
_STEPS = [np.empty(0, np.uint64), np.empty(0, np.uint64)]
_LANES = np.random.RandomState(20021).randint(0, 2**62, 64, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


class Words(NamedTuple):
    """hashes: one per word; first: index of each row's first word, with the total at the end; starts, ends: byte positions."""

    hashes: np.ndarray
    first: np.ndarray
    starts: np.ndarray
    ends: np.ndarray


def mix(x: np.ndarray) -> np.ndarray:
    """Bijective 64-bit mixer."""
    x = x ^ (x >> np.uint64(33))
    x = x * np.uint64(0xFF51AFD7ED558CCD)
    x ^= x >> np.uint64(33)
    x *= np.uint64(0xC4CEB9FE1A85EC53)
    x ^= x >> np.uint64(33)
    return x


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    if len(_STEPS[0]) < n:
        for i, base in enumerate((_BASE, pow(_BASE, -1, 2**64))):
            steps = np.full(n, base, np.uint64)
            steps[0] = 1
            _STEPS[i] = np.multiply.accumulate(steps)
    return _STEPS[0], _STEPS[1]


def words(data: np.ndarray, bounds: np.ndarray) -> Words:
    """Words of the rows data[bounds[i]:bounds[i + 1]]."""
    data, bounds = data[bounds[0] : bounds[-1]], bounds - bounds[0]
    n = len(data)
    if not n:
        none = np.empty(0, np.int64)
        return Words(np.empty(0, np.uint64), np.zeros(len(bounds), np.int64), none, none)
    gap = _BREAKS[data]
    begin, end = ~gap, ~gap
    begin[1:] &= gap[:-1]
    end[:-1] &= gap[1:]
    inner = bounds[1:-1]
    inner = inner[(inner > 0) & (inner < n)]
    begin[inner] = ~gap[inner]
    end[inner - 1] = ~gap[inner - 1]
    starts, ends = np.flatnonzero(begin), np.flatnonzero(end) + 1
    hashes = np.empty(len(starts), np.uint64)
    i = 0
    while i < len(starts):  # pieces bound the memory of very long texts
        j = max(i + 1, int(np.searchsorted(ends, starts[i] + PIECE, "right")))
        lo, hi = starts[i], ends[j - 1]
        up, down = powers(max(PIECE, int(hi - lo)))
        sums = np.zeros(hi - lo + 1, np.uint64)
        np.cumsum(_BYTES[data[lo:hi]] * up[: hi - lo], out=sums[1:])
        hashes[i:j] = (sums[ends[i:j] - lo] - sums[starts[i:j] - lo]) * down[starts[i:j] - lo]
        i = j
    return Words(mix(hashes), np.searchsorted(starts, bounds), starts, ends)


def chunks(batch: pa.RecordBatch, column: str) -> Iterator[tuple[slice, np.ndarray, np.ndarray]]:
    """Consecutive rows of about CHUNK_BYTES of text: (rows, bytes, bounds). Null texts are empty."""
    col = pc.fill_null(batch.column(column).cast(pa.large_string()), "")
    buffers = col.buffers()
    bounds = np.frombuffer(buffers[1], np.int64)[col.offset : col.offset + len(col) + 1] if len(col) else np.zeros(1, np.int64)
    data = np.frombuffer(buffers[2], np.uint8) if buffers[2] is not None and buffers[2].size else np.empty(0, np.uint8)
    i = 0
    while i < len(col):
        j = max(i + 1, int(np.searchsorted(bounds, bounds[i] + CHUNK_BYTES, "right")) - 1)
        yield slice(i, j), data, bounds[i : j + 1]
        i = j


def row_of(first: np.ndarray) -> np.ndarray:
    """The row of every word."""
    return np.repeat(np.arange(len(first) - 1), np.diff(first))


def grams(w: Words, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the k-word windows of each row, in order, and the index of each row's first. A row with fewer words, but one
    at least, gives one hash over its whole sequence."""
    n, h, first = len(w.hashes), w.hashes, w.first
    size = np.diff(first)
    last = np.repeat(first[1:], size)
    out = np.repeat(np.minimum(size, k), size).astype(np.uint64)  # the length tells short sequences from whole windows
    at = np.arange(n)
    for t in range(min(k, n)):
        part = h[t:] * _LANES[t]
        if t:
            part[at[: n - t] + t >= last[: n - t]] = 0
        out[: n - t] += part
    whole = (at + k <= last) | ((at == np.repeat(first[:-1], size)) & (np.repeat(size, size) < k))
    return mix(out[whole]), np.concatenate([[0], np.cumsum(np.where(size >= k, size - k + 1, np.minimum(size, 1)))])


def lower_ascii(text: Column) -> Column:
    return F.translate(F.coalesce(text, F.lit("")), UPPER, LOWER)


def held(doc_id: Column, folds: int, fold: int) -> Column:
    """Whether crc32 of the id as text falls into the fold; ids that are null do not."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % folds == fold, F.lit(False))


#: For SQL checks: the table of the checksum as a list t, and the unsigned crc32 of a list of bytes given t.
CRC_SQL = "crc_table AS (SELECT list_transform(range(256), lambda i: list_reduce(list_concat([i::BIGINT], range(8)), lambda c, k: CASE WHEN c % 2 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END)) AS t)"


def crc_sql(data: str) -> str:
    return f"xor(list_reduce(list_concat([4294967295::BIGINT], {data}), lambda c, b: xor(c >> 8, t[(xor(c, b) & 255) + 1])), 4294967295)"
