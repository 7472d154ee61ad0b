"""Word hashing over whole Arrow columns: numpy passes over bytes, no loop over words.

A word is a run of bytes outside a separator set; it never crosses a row. Its hash takes
its bytes eight at a time: each lane of eight is mixed, then mixed again with its place,
and the lanes' sum is mixed with the length. Words of up to eight bytes therefore have
different hashes if they are of one length, and longer ones have no algebraic structure
to collide by. Sequences of words are hashed by multiply-and-add over mixed word hashes.
Fixed seeds make all values the same on every executor and every run. Hashes choose what
is compared; operators that act on equality compare words or digests besides.
"""

from __future__ import annotations

import ctypes
from collections.abc import Iterator

import numpy as np
import pyarrow as pa

try:
    _LIBC = ctypes.CDLL("libc.so.6")
    _LIBC.malloc_trim  # noqa: B018
except (OSError, AttributeError):  # another C library: nothing to trim
    _LIBC = None

_RANDOM = np.random.default_rng(20240229)
_FACTORS = _RANDOM.integers(1, 2**64, size=(2, 64), dtype=np.uint64) | np.uint64(1)
_KEYS = (np.uint64(0x9E3779B97F4A7C15), np.uint64(0xD6E8FEB86659FD93))
#: Of the last lane, the bytes that belong to the run, by their number.
_LANE = np.array([(1 << (8 * k)) - 1 for k in range(9)], np.uint64)

BLANK_BYTES = np.zeros(256, bool)
BLANK_BYTES[[0x20, *range(0x09, 0x0E)]] = True
#: Everything in ASCII that is no letter or digit; bytes of other characters belong to words.
PUNCT_BYTES = np.array([b < 0x80 and not chr(b).isalnum() for b in range(256)])


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads every bit."""
    x = x ^ (x >> np.uint64(31))
    x = x * np.uint64(0x7FB5D329728EA185)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x81DADEF4BC2DD44D)
    x ^= x >> np.uint64(33)
    return x


def lanes(data: np.ndarray) -> np.ndarray:
    """The eight bytes at each place as one number; beyond the end they are zero."""
    padded = np.zeros(len(data) + 8, np.uint8)
    padded[: len(data)] = data
    return np.ndarray(len(data) + 1, "<u8", buffer=padded, strides=(1,))


def low_bytes(lane: np.ndarray, count: np.ndarray) -> np.ndarray:
    """The first ``count`` bytes of each lane, the others zero."""
    return lane & _LANE[np.minimum(count, 8)]


def hash_runs(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, which: int = 0) -> np.ndarray:
    """A hash of each run of bytes ``starts`` to ``ends``."""
    at, key = lanes(data), _KEYS[which]
    length = ends - starts
    total = mix(mix(low_bytes(at[starts], length) + key))
    long = np.flatnonzero(length > 8)
    if len(long):
        more = (length[long] - 1) // 8
        before = np.cumsum(more) - more
        place = np.arange(1, int(more.sum()) + 1) - np.repeat(before, more)
        own = np.repeat(long, more)
        lane = low_bytes(at[starts[own] + 8 * place], length[own] - 8 * place)
        total[long] += np.add.reduceat(mix(mix(lane + key) ^ (place.astype(np.uint64) * _KEYS[1 - which])), before)
    return mix(total + length.astype(np.uint64) * key)


class Words:
    """The words of some rows: ``starts``/``ends`` in ``data``, ``row`` of each word, and ``first`` word of each row."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray, separators: np.ndarray):
        base = int(offsets[0])
        data = data[base : int(offsets[-1])]
        offsets = offsets.astype(np.int64) - base
        inside = ~separators[data]
        before = np.empty(len(data), bool)
        before[1:] = inside[:-1]
        before[:1] = False
        cuts = offsets[:-1]
        before[cuts[cuts < len(data)]] = False
        starts = np.flatnonzero(inside & ~before)
        after = np.empty(len(data), bool)
        after[:-1] = inside[1:]
        after[-1:] = False
        cuts = offsets[1:] - 1
        after[cuts[cuts >= 0]] = False
        # A row's last byte ends a word; an empty row shares its cut with the row before.
        ends = np.flatnonzero(inside & ~after) + 1
        self.data, self.offsets, self.starts, self.ends = data, offsets, starts, ends
        self.first = np.searchsorted(starts, offsets)
        self.counts = np.diff(self.first)

    def hashes(self, which: int = 0) -> np.ndarray:
        if not len(self.starts):
            return np.zeros(0, np.uint64)
        return hash_runs(self.data, self.starts, self.ends, which)

    def joined(self) -> tuple[np.ndarray, np.ndarray]:
        """All words, each followed by one space, and where each begins (one more at the end)."""
        length = self.ends - self.starts
        begin = np.zeros(len(length) + 1, np.int64)
        np.cumsum(length + 1, out=begin[1:])
        out = np.full(int(begin[-1]), 0x20, np.uint8)
        shift = np.repeat(self.starts - begin[:-1], length + 1)
        at = np.arange(len(out)) + shift
        inside = np.ones(len(out), bool)
        inside[begin[1:] - 1] = False
        out[inside] = self.data[at[inside]]
        return out, begin

    def rows(self) -> np.ndarray:
        return np.repeat(np.arange(len(self.counts)), self.counts)


def grams(words: np.ndarray, n: int, which: int = 0) -> np.ndarray:
    """Hashes of all ``n`` consecutive words, rows not regarded: one for each possible start."""
    size = max(len(words) - n + 1, 0)
    out = np.zeros(size, np.uint64)
    for j in range(n):
        out += words[j : j + size] * _FACTORS[which][j]
    return mix(out)


def whole(counts: np.ndarray, n: int) -> np.ndarray:
    """Which starts of ``grams`` lie within one row, given each row's words."""
    total = int(counts.sum())
    size = max(total - n + 1, 0)
    left = np.repeat(np.cumsum(counts), counts)[:size] - np.arange(size)
    return left >= n


def columns(batch: pa.RecordBatch, name: str) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and offsets of a string column without nulls."""
    column = batch.column(batch.schema.get_field_index(name))
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    _, offsets, data = column.buffers()
    offsets = np.frombuffer(offsets, np.int64 if wide else np.int32)[column.offset : column.offset + len(column) + 1]
    return np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8), offsets


def trim() -> None:
    """Give freed memory back to the system; workers live for many tasks and share a machine's memory."""
    if _LIBC is not None:
        _LIBC.malloc_trim(0)


def pieces(batch: pa.RecordBatch, name: str, size: int = 1 << 20) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """Slices of a batch with about ``size`` bytes of text: (from row, to row, bytes, offsets)."""
    if not batch.num_rows:
        return
    data, offsets = columns(batch, name)
    at, n = 0, batch.num_rows
    while at < n:
        to = max(int(np.searchsorted(offsets, offsets[at] + size, side="right")) - 1, at + 1)
        to = min(to, n)
        yield at, to, data, offsets[at : to + 1]
        at = to
    trim()


def packed(values: np.ndarray, counts: np.ndarray) -> pa.Array:
    """A binary array whose rows are consecutive runs of ``values``."""
    width = values.dtype.itemsize
    offsets = np.zeros(len(counts) + 1, np.int64)
    np.cumsum(counts, out=offsets[1:])
    data = pa.py_buffer(np.ascontiguousarray(values).tobytes())
    if offsets[-1] * width >= 1 << 31:
        raise ValueError("a column of runs must stay under 2 GiB")
    return pa.Array.from_buffers(
        pa.binary(), len(counts), [None, pa.py_buffer((offsets * width).astype(np.int32).tobytes()), data]
    )
