"""Chunked text streams: chunks gather until a flush, and each flushed segment is screened as one text."""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

#: Characters before boundaries count, and the boundaries.
LEAST, EVERY = 50, 256
BOUNDARY = re.compile(r"[.!?]\s+|\n\s*\n|```\s*\n")
SCHEMA = "stream_id string, segment int, text string, is_final boolean"


def due(buffer: str, every: int = EVERY, boundary: bool = True) -> bool:
    """Whether a buffer is flushed: long enough, or with a sentence, paragraph or fence end anywhere in it."""
    return len(buffer) >= every or (boundary and len(buffer) > LEAST and BOUNDARY.search(buffer) is not None)


def gather(chunks, buffer: str = "", number: int = 0, every: int = EVERY, boundary: bool = True):
    """(segments as (number, text, final), buffer, next number) of ordered (chunk, is_final)."""
    out = []
    for chunk, final in chunks:
        buffer += chunk or ""
        if buffer and (final or due(buffer, every, boundary)):
            out.append((number, buffer, bool(final)))
            buffer, number = "", number + 1
    return out, buffer, number


def segments(chunks: DataFrame, every: int = EVERY, boundary: bool = True) -> DataFrame:
    """(stream_id, segment, text, is_final) of a table of chunks (stream_id, seq, chunk, is_final).

    A stream without a final chunk flushes what is left at its end.  A stream is gathered by one task.
    """

    def fold(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("seq")
        out, rest, number = gather(zip(pdf["chunk"], pdf["is_final"]), every=every, boundary=boundary)
        if rest:
            out.append((number, rest, True))
        return pd.DataFrame([(pdf["stream_id"].iloc[0], *s) for s in out], columns=["stream_id", "segment", "text", "is_final"])

    return chunks.groupBy("stream_id").applyInPandas(fold, SCHEMA)


def stream_segments(chunks: DataFrame, every: int = EVERY, boundary: bool = True, idle_ms: int = 600_000) -> DataFrame:
    """The same over a streaming table; the buffer is state, and a stream that falls idle flushes."""

    def step(key, frames, state: GroupState):
        buffer, number = state.get if state.exists else ("", 0)
        if state.hasTimedOut:
            state.remove()
            if buffer:
                yield pd.DataFrame([(key[0], number, buffer, True)], columns=["stream_id", "segment", "text", "is_final"])
            return
        pdf = pd.concat(list(frames)).sort_values("seq")
        out, buffer, number = gather(zip(pdf["chunk"], pdf["is_final"]), buffer, number, every, boundary)
        state.update((buffer, number))
        state.setTimeoutDuration(idle_ms)
        yield pd.DataFrame([(key[0], *s) for s in out], columns=["stream_id", "segment", "text", "is_final"])

    return chunks.groupBy("stream_id").applyInPandasWithState(step, SCHEMA, "buffer string, number int", "append", GroupStateTimeout.ProcessingTimeTimeout)


def until_violation(screened: DataFrame) -> DataFrame:
    """Segments before the first enforced violation of their stream (a screen() result with stream_id, segment)."""
    from pyspark.sql import functions as F

    first = screened.where("screen.enforced").groupBy("stream_id").agg(F.min("segment").alias("__first"))
    return screened.join(first, "stream_id", "left").where("__first is null or segment < __first").drop("__first")


def hold_tokens(text: str, pending: str) -> tuple[str, str]:
    """(what may be shown now, what waits): from the last vault token that has not closed."""
    text = pending + text
    at, end = text.rfind("{{pii:"), text.rfind("}}")
    return (text[:at], text[at:]) if at > end else (text, "")
