"""Words and word hashes of Arrow text columns as numpy arrays, for use inside tasks."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

#: Bytes of text that are worked on at once; a longer single text is worked on alone.
CHUNK_BYTES = 1 << 21

LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32

#: ``[^\x20\x09-\x0D]``
NOT_SPACE = np.ones(256, bool)
NOT_SPACE[[0x20, *range(0x09, 0x0E)]] = False
#: ``[^\x00-\x2F\x3A-\x60\x7B-\x7F]``: digits, small letters, and every byte of a non-ASCII character
ALNUM = np.zeros(256, bool)
ALNUM[0x30:0x3A] = ALNUM[0x61:0x7B] = ALNUM[0x80:] = True


#: Bytes of a batch that goes to a Python task; several are in memory at once on either side.
BATCH_BYTES = "8m"


def bounded_batches(rows: DataFrame, size: str = BATCH_BYTES) -> DataFrame:
    """``rows``, in whose session batches for Python tasks are kept small from now on, so that
    long texts do not add up to large ones."""
    rows.sparkSession.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", size)
    return rows


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads every bit over all others."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def coefficients(n: int, seed: int = 0) -> np.ndarray:
    """Odd 64-bit numbers, one for each place; the same in every process."""
    places = np.arange(1, n + 1, dtype=np.uint64) + np.uint64(seed * 0x9E3779B97F4A7C15 % 2**64)
    return mix(places) | np.uint64(1)


_PLACES = coefficients(1 << 12)


def _places(n: int) -> np.ndarray:
    return _PLACES[:n] if n <= len(_PLACES) else coefficients(n)


def text_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """All bytes of a text column, and where each text starts; null counts as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = column.fill_null("")
    kind = np.int64 if pa.types.is_large_string(column.type) else np.int32
    _, offsets, data = column.buffers()
    if not len(column) or offsets is None:
        return np.zeros(0, np.uint8), np.zeros(len(column) + 1, np.int64)
    at = np.frombuffer(offsets, kind)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    raw = np.frombuffer(data, np.uint8)[at[0] : at[-1]] if data is not None else np.zeros(0, np.uint8)
    return raw, at - at[0]


@dataclass
class Words:
    """Words of consecutive texts. ``bounds[i]:bounds[i + 1]`` are the words of the i-th one."""

    data: np.ndarray
    starts: np.ndarray
    ends: np.ndarray
    bounds: np.ndarray

    @property
    def counts(self) -> np.ndarray:
        return np.diff(self.bounds)

    def owners(self) -> np.ndarray:
        """Place of each word's text."""
        return np.repeat(np.arange(len(self.bounds) - 1), self.counts)

    def hashes(self) -> np.ndarray:
        """64-bit hash of each word."""
        if not len(self.starts):
            return np.zeros(0, np.uint64)
        lengths = self.ends - self.starts
        first = np.concatenate(([0], np.cumsum(lengths)))
        within = np.arange(first[-1]) - np.repeat(first[:-1], lengths)
        chars = self.data[np.repeat(self.starts, lengths) + within].astype(np.uint64) + np.uint64(1)
        chars *= _places(int(lengths.max()))[within]
        sums = np.add.reduceat(chars, first[:-1])
        return mix(sums + lengths.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))


def find_words(data: np.ndarray, offsets: np.ndarray, inside: np.ndarray, lower: bool = True) -> Words:
    """Longest runs of the bytes that ``inside`` marks; no run goes beyond its text."""
    if lower:
        data = LOWER[data]
    held = inside[data]
    edge = np.zeros(len(data) + 1, bool)
    edge[offsets] = True
    before = np.concatenate(([False], held[:-1])) & ~edge[:-1]
    after = np.concatenate((held[1:], [False])) & ~edge[1:]
    starts = np.flatnonzero(held & ~before)
    ends = np.flatnonzero(held & ~after) + 1
    return Words(data, starts, ends, np.searchsorted(starts, offsets))


def chunks(column: pa.Array, limit: int = CHUNK_BYTES) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """Ranges of texts of about ``limit`` bytes each: first, end, their bytes, and offsets in them."""
    data, offsets = text_bytes(column)
    n, at = len(offsets) - 1, 0
    while at < n:
        end = max(at + 1, int(np.searchsorted(offsets, offsets[at] + limit, "right")) - 1)
        yield at, min(end, n), data[offsets[at] : offsets[min(end, n)]], offsets[at : min(end, n) + 1] - offsets[at]
        at = min(end, n)


def ranges(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """``starts[i], starts[i] + 1, ...`` of ``lengths[i]`` numbers each, one after the other."""
    total = np.concatenate(([0], np.cumsum(lengths)))
    return np.arange(total[-1]) + np.repeat(starts - total[:-1], lengths)
