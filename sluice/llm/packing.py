"""Packing documents into sequences by sum-of-squares online packing.

A document longer than a window fills whole windows; its remainder goes to the open window whose fill level makes the
sum of squared counts of partially filled windows least.  The counts live in one array with a place for each level.
Each task packs its own rows, so nothing shuffles.  The few windows that stay open at the end of a task are cut into
full ones, and the rest into sequences of a power of two, which need no padding.
"""

from __future__ import annotations

import base64
import zlib

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sluice.llm.common import ship
from sluice.llm.textkit import release

LENGTH = 2048
END = 1
SCHEMA = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"


class Encoder:
    """Ids of the vocabulary at json_path.

    Texts of Latin letters take the merge table of the same vocabulary, which is several times as fast and gives the
    same ids; any other text, and one that spells a special token, goes through the tokenizer itself.
    """

    def __init__(self, json_path: str, ranks_path: str | None = None):
        import re

        self.json_path, self._slow, self._fast = json_path, None, None
        self._latin = re.compile("[^\x00-ɏ -⁯]|<\\|")
        if ranks_path:
            import public_tokenizers
            import tiktoken

            with open(ranks_path, "rb") as f:
                ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
            self._fast = tiktoken.Encoding("table", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})

    def __call__(self, text: str) -> np.ndarray:
        if self._fast is not None and not self._latin.search(text):
            return np.asarray(self._fast.encode_to_numpy(text), np.uint32)
        if self._slow is None:
            from tokenizers import Tokenizer

            self._slow = Tokenizer.from_file(self.json_path)
        return np.array(self._slow.encode(text, add_special_tokens=False).ids, np.uint32)


class SumOfSquares:
    """Open windows by fill level.  place() returns the window for a piece and whether that fills it."""

    def __init__(self, length: int):
        self.length = length
        self.count = np.zeros(length + 1, np.int64)  # open windows of each level; level 0 and length stay 0
        self.stacks: list[list] = [[] for _ in range(length + 1)]

    def place(self, size: int, make):
        top = self.length - size  # the highest level that still takes the piece
        count = self.count
        cost = 2 * count[size : self.length + 1] + 1  # of one more window at level + size
        cost[top] = 0  # a full window is no longer open
        cost[1:] += np.where(count[1 : top + 1] > 0, 1 - 2 * count[1 : top + 1], 1 << 40)
        level = top - int(np.argmin(cost[::-1]))  # of equal costs the fullest
        window = self.stacks[level].pop() if level else make()
        if level:
            count[level] -= 1
        if level < top:
            count[level + size] += 1
            self.stacks[level + size].append(window)
        return window, level, level == top

    def open(self) -> list:
        return [w for level in range(self.length - 1, 0, -1) for w in self.stacks[level]]


def pack(documents, length: int, first_sequence: int):
    """Yields (doc_id, start, ids, doc_tokens, sequence, offset) for (doc_id, ids) pairs."""
    squares, serial = SumOfSquares(length), first_sequence

    def make():
        return []

    for doc_id, ids in documents:
        n = len(ids)
        full = n // length * length
        for start in range(0, full, length):
            yield doc_id, start, ids[start : start + length], n, serial, 0
            serial += 1
        if n > full:
            window, level, done = squares.place(n - full, make)
            window.append((doc_id, full, ids[full:], n, level))
            if done:
                for d, start, piece, total, offset in window:
                    yield d, start, piece, total, serial, offset
                serial += 1
    rest = [p for w in squares.open() for p in w]
    left = sum(len(p[2]) for p in rest)
    room, offset = min(length, left), 0
    if left and left < length:
        room = 1 << (left.bit_length() - 1)
    for d, start, piece, total, _ in rest:
        while len(piece):
            part = piece[: room - offset]
            yield d, start, part, total, serial, offset
            start, piece, offset, left = start + len(part), piece[len(part) :], offset + len(part), left - len(part)
            if offset == room:
                serial, offset = serial + 1, 0
                room = length if left >= length else 1 << (left.bit_length() - 1) if left else length


def pack_documents(docs: DataFrame, json_path: str | None = None, ranks_path: str | None = "", length: int = LENGTH, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset.

    A null or empty text is the closing id alone.  Repeated rows are packed each; null ids stay null.  Other columns
    are ignored; no rows give no rows.  Sequence ids are the task's number times 2**32 plus a serial, so a task that
    runs again over the same split gives the same ids.
    """
    ship(docs.sparkSession)
    import public_tokenizers

    json_path = json_path or public_tokenizers.path("byte_bpe_50k.json")
    ranks_path = public_tokenizers.path("byte_bpe_50k.tiktoken") if ranks_path == "" else ranks_path
    json_path, ranks_path = str(json_path), ranks_path and str(ranks_path)
    types = [pa.int64()] * 7
    names = [x.split()[0] for x in SCHEMA.split(", ")]

    def run(batches):
        encode = Encoder(json_path, ranks_path)

        def documents():
            for batch in batches:
                for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1)):
                    ids = encode(text.as_py() or "")
                    yield doc_id, np.append(ids, np.uint32(END)).astype("<u4")

        rows: list[tuple] = []
        for d, start, piece, total, seq, offset in pack(documents(), length, TaskContext.get().partitionId() << 32):
            rows.append((d, start, len(piece), zlib.crc32(piece.tobytes()), total, seq, offset))
            if len(rows) == 8192:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), types)], names)
                rows = []
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), types)], names)
        del encode
        release()

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(run, SCHEMA)
