"""Vectorised text work on Arrow string arrays: words, their hashes, shingles.  Runs in Python workers."""

from __future__ import annotations

import ctypes

import numpy as np
import pyarrow as pa

_M = np.uint64
_SPACES = (0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D)
_cache: dict = {}


def mix(x: np.ndarray) -> np.ndarray:
    """Finaliser of splitmix64."""
    x = (x ^ (x >> _M(30))) * _M(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> _M(27))) * _M(0x94D049BB133111EB)
    return x ^ (x >> _M(31))


def _tables(length: int):
    """Byte codes (A-Z as a-z), the space mask, and powers of an odd base with their inverses."""
    if "codes" not in _cache:
        lower = np.arange(256, dtype=np.uint64)
        lower[65:91] += _M(32)
        space = np.zeros(256, bool)
        space[list(_SPACES)] = True
        _cache["codes"] = (mix((lower + _M(1)) * _M(0x9E3779B97F4A7C15)), space)
    if _cache.get("length", 0) < length:
        size = 1 << max(20, int(length - 1).bit_length())
        base = 0x5851F42D4C957F2D
        with np.errstate(over="ignore"):
            up = np.full(size, base, np.uint64)
            up[0] = 1
            down = np.full(size, pow(base, -1, 1 << 64), np.uint64)
            down[0] = 1
            _cache.update(length=size, up=np.cumprod(up), down=np.cumprod(down))
    return *_cache["codes"], _cache["up"], _cache["down"]


def raw(array) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes and offsets (from 0) of a string array; null is empty."""
    if isinstance(array, pa.ChunkedArray):
        array = array.combine_chunks()
    if not pa.types.is_string(array.type):
        array = array.cast(pa.string())
    if array.null_count:
        array = array.fill_null("")
    n = len(array)
    offsets = np.frombuffer(array.buffers()[1], np.int32, n + 1, array.offset * 4).astype(np.int64)
    data = array.buffers()[2]
    data = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return data[offsets[0] : offsets[-1]], offsets - offsets[0]


def slices(batches, column: str = "text", limit: int = 1 << 20):
    """Cuts record batches between rows so that a piece holds about limit bytes of text, or one row."""
    for batch in batches:
        n = batch.num_rows
        if not n:
            continue
        _, offsets = raw(batch.column(batch.schema.get_field_index(column)))
        at = 0
        while at < n:
            to = int(np.searchsorted(offsets, offsets[at] + limit, "right")) - 1
            to = min(n, max(at + 1, to))
            yield batch.slice(at, to - at)
            at = to
    release()


def release() -> None:
    """Gives memory that this worker no longer uses back to the system; the worker outlives its task."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except AttributeError:  # a C library without it
        pass


def words(array) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(start, end, hash, first) of every word, A-Z lowered; words of row i are first[i]:first[i+1]."""
    data, offsets = raw(array)
    codes, space, up, down = _tables(len(data) + 1)
    if not len(data):
        none = np.zeros(0, np.int64)
        return none, none, np.zeros(0, np.uint64), np.zeros(len(offsets), np.int64)
    solid = ~space[data]
    edge = np.zeros(len(data) + 1, bool)  # a row begins here, or the data end
    edge[offsets] = True
    begin = solid.copy()
    begin[1:] &= ~solid[:-1] | edge[1:-1]
    stop = solid.copy()
    stop[:-1] &= ~solid[1:] | edge[1:-1]
    start, end = np.flatnonzero(begin), np.flatnonzero(stop) + 1
    with np.errstate(over="ignore"):
        total = np.zeros(len(data) + 1, np.uint64)
        np.cumsum(codes[data] * up[: len(data)], out=total[1:])
        hashed = mix((total[end] - total[start]) * down[start] + (end - start).astype(np.uint64) * _M(0xD6E8FEB86659FD93))
    return start, end, hashed, np.searchsorted(start, offsets)


_STEP = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x27D4EB2F165667C5, 0x85EBCA77C2B2AE63], np.uint64)


def sequence_hash(hashed: np.ndarray, width: int) -> np.ndarray:
    """Hash of every run of width items."""
    count = len(hashed) - width + 1
    if count <= 0:
        return np.zeros(0, np.uint64)
    with np.errstate(over="ignore"):
        out = np.full(count, _M(width), np.uint64)
        for k in range(width):
            out = mix(out * _STEP[k % 5] + hashed[k : k + count])
        return out


def shingle_sets(array, width: int = 5):
    """For each row the sorted distinct hashes of its word shingles; a shorter text is one shingle."""
    _, _, hashed, first = words(array)
    runs = sequence_hash(hashed, width)
    for i in range(len(first) - 1):
        a, b = int(first[i]), int(first[i + 1])
        if b - a >= width:
            yield np.unique(runs[a : b - width + 1])
        elif b > a:
            yield sequence_hash(hashed[a:b], b - a)
        else:
            yield runs[:0]


class Lookup:
    """Places of 64-bit keys in an array, for many queries at once; -1 where a key is unknown."""

    def __init__(self, keys: np.ndarray):
        self.keys = np.asarray(keys, np.uint64)
        n = len(self.keys)
        self.shift = _M(64 - max(4, int(4 * n).bit_length()))
        slot = (self.keys >> self.shift).astype(np.int64)
        order = np.argsort(slot, kind="stable")
        ranked = slot[order]
        depth = np.arange(n) - np.searchsorted(ranked, ranked)
        self.levels = []
        for d in range(int(depth.max()) + 1 if n else 0):
            level = np.full(1 << (64 - int(self.shift)), -1, np.int32)
            at = order[depth == d]
            level[slot[at]] = at
            self.levels.append(level)

    def __call__(self, query: np.ndarray) -> np.ndarray:
        out = np.full(len(query), -1, np.int32)
        slot = (query >> self.shift).astype(np.int64)
        open_ = np.arange(len(query))
        for level in self.levels:
            at = level[slot[open_]]
            there = at >= 0
            open_, at = open_[there], at[there]
            same = self.keys[at] == query[open_]
            out[open_[same]] = at[same]
            open_ = open_[~same]
        return out


_fold: list = []


def folded(array) -> pa.Array:
    """The texts with A-Z and Latin-1 capitals lowered and every other ASCII character but a-z as a space."""
    if not _fold:
        lut = np.arange(256, dtype=np.uint8)
        lut[:128] = 0x20
        lut[97:123] = np.arange(97, 123)
        lut[65:91] = np.arange(97, 123)
        _fold.append(lut)
    data, offsets = raw(array)
    out = _fold[0][data]
    capital = np.zeros(len(data), bool)
    capital[1:] = (data[:-1] == 0xC3) & (data[1:] >= 0x80) & (data[1:] <= 0x9E) & (data[1:] != 0x97)
    out[capital] += 0x20
    return pa.StringArray.from_buffers(len(offsets) - 1, pa.py_buffer(offsets.astype(np.int32)), pa.py_buffer(out))


class Grams:
    """Hashes of character n-grams of a string array: of() takes character places, bounds() a word's characters."""

    def __init__(self, array):
        self.data, _ = raw(array)
        codes, _, up, self.down = _tables(len(self.data) + 1)
        with np.errstate(over="ignore"):
            self.total = np.zeros(len(self.data) + 1, np.uint64)
            np.cumsum(codes[self.data] * up[: len(self.data)], out=self.total[1:])
        self.starts = np.append(np.flatnonzero((self.data & 0xC0) != 0x80), len(self.data))

    def bounds(self, start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        return np.searchsorted(self.starts, start), np.searchsorted(self.starts, end)

    def of(self, at: np.ndarray, n: int) -> np.ndarray:
        a, b = self.starts[at], self.starts[at + n]
        with np.errstate(over="ignore"):
            return mix((self.total[b] - self.total[a]) * self.down[a] + _M(n) * _STEP[1])


def spread(first: np.ndarray, last: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(owner, place) of every place in first[i]:last[i]."""
    size = last - first
    owner = np.repeat(np.arange(len(first)), size)
    begin = np.cumsum(size) - size
    return owner, np.arange(int(size.sum())) - begin[owner] + first[owner]
