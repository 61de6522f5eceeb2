"""Bloom filters of 64-bit hashes with counts on a log scale: built by a Spark job, broadcast, probed in Python workers.

A key of level q is inserted once for each level 1, 2, ..., q, and a reader probes levels until one is missing.  All
bits of a key lie in one chunk, which the upper half of the key names; so tasks build chunks of their own and none
holds the whole filter.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sluice.llm import textkit as T

#: Bytes of a chunk; its bits are numbered by the upper 16 bits of a sum of 32 bits.
CHUNK = 1 << 13


def _start(keys: np.ndarray, level: int):
    """(first place, step) of the probes of keys at a level."""
    with np.errstate(over="ignore"):
        h = T.mix(keys * np.uint64(0x9E3779B97F4A7C15) + np.uint64(level) * np.uint64(0xC2B2AE3D27D4EB4F))
    return (h & np.uint64(0xFFFFFFFF)).astype(np.uint32), (h >> np.uint64(32)).astype(np.uint32) | np.uint32(1)


class LevelBloom:
    """Levels of keys, from membership probes alone: never too low; too high, or not 0, at the filter's error rate.

    first, more: hash functions of level 1, which tells known keys from unknown ones, and of each later level.
    """

    def __init__(self, chunks: int, first: int, more: int = 14, top: int = 1, data: np.ndarray | None = None):
        self.chunks, self.first, self.more, self.top = max(1, chunks), first, more, top
        self.data = np.zeros(CHUNK * self.chunks, np.uint8) if data is None else data

    @staticmethod
    def chunks_for(level_one: int, later: int, first: int, more: int = 14) -> int:
        """The number of chunks at which about half of the bits are set."""
        return max(1, int(np.ceil((level_one * first + later * more) / np.log(2) / (8 * CHUNK))))

    def chunk(self, keys: np.ndarray) -> np.ndarray:
        return ((keys >> np.uint64(32)) * np.uint64(self.chunks) >> np.uint64(32)).astype(np.int64)

    def insert(self, keys: np.ndarray, levels: np.ndarray, base: np.ndarray | None = None) -> None:
        """base: the first byte of each key's chunk in data, where data hold some chunks only."""
        keys = np.asarray(keys, np.uint64)
        base = self.chunk(keys) * CHUNK if base is None else base
        for q in range(1, int(levels.max(initial=0)) + 1):
            mine = np.flatnonzero(levels >= q)
            h, step = _start(keys[mine], q)
            at = base[mine]
            for _ in range(self.first if q == 1 else self.more):
                place = h >> np.uint32(16)
                np.bitwise_or.at(self.data, at + (place >> 3), np.uint8(1) << (place & 7).astype(np.uint8))
                h = h + step

    def level(self, keys: np.ndarray) -> np.ndarray:
        keys = np.asarray(keys, np.uint64)
        out = np.zeros(len(keys), np.int64)
        open_ = np.arange(len(keys))
        for q in range(1, self.top + 1):
            if not len(open_):
                break
            h, step = _start(keys[open_], q)
            base = self.chunk(keys[open_]) * CHUNK
            for _ in range(self.first if q == 1 else self.more):
                place = h >> np.uint32(16)
                hit = (self.data[base + (place >> 3)] >> (place & 7).astype(np.uint8)) & 1 == 1
                if not hit.all():
                    open_, base, h, step = open_[hit], base[hit], h[hit], step[hit]
                h = h + step
            out[open_] = q
        return out


def build(rows: DataFrame, chunks: int, first: int, more: int = 14, top: int = 1) -> LevelBloom:
    """The filter of rows (key long, level int).  Each task builds the chunks that are dealt to it; the driver joins them."""
    shape = LevelBloom(chunks, first, more, top, np.zeros(0, np.uint8))

    def run(batches):
        parts = [b for b in batches if b.num_rows]
        if not parts:
            return
        key = np.concatenate([b.column(0).to_numpy() for b in parts]).view(np.uint64)
        level = np.concatenate([b.column(1).to_numpy() for b in parts])
        mine, at = np.unique(shape.chunk(key), return_inverse=True)
        own = LevelBloom(shape.chunks, first, more, top, np.zeros(len(mine) * CHUNK, np.uint8))
        own.insert(key, level, at * CHUNK)
        for i in range(0, len(mine), 64):
            data = [own.data[k * CHUNK : (k + 1) * CHUNK].tobytes() for k in range(i, min(i + 64, len(mine)))]
            yield pa.RecordBatch.from_arrays([pa.array(mine[i : i + 64]), pa.array(data, pa.binary())], ["chunk", "data"])
        T.release()

    data = np.zeros(CHUNK * shape.chunks, np.uint8)
    dealt = rows.select("key", "level").repartition(F.shiftrightunsigned(F.shiftrightunsigned("key", 32) * shape.chunks, 32))
    for r in dealt.mapInArrow(run, "chunk long, data binary").toLocalIterator():  # the filter's bytes in all
        data[r["chunk"] * CHUNK : (r["chunk"] + 1) * CHUNK] = np.frombuffer(r["data"], np.uint8)
    return LevelBloom(shape.chunks, first, more, top, data)
