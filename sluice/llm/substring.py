"""Substring dedup over sliding sentence spans and word windows.

Every run of RUN consecutive sentences, or of as many more as it takes to reach LEAST_WORDS words, is hashed; the
hashes are joined globally; a sentence is removed when a repeated span covers it that is not the first of its kind in
the order of (doc_id, place).

Passages that start or end inside a sentence are cut differently in every text, so words count too: of the hashes of
all runs of WINDOW words the least in every GAP neighbours is kept, which any two copies of a passage of
WINDOW + GAP - 1 words agree on.  The kept windows are joined globally, and the words of one go when it is not the
first of its kind, with the words on both sides that agree with those around the first.

Two passes over the texts: the first counts hashes alone, the second gives places, and only of hashes that repeat.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sluice.llm import bloom
from sluice.llm import textkit as T
from sluice.llm.common import Scratch, ship

RUN = 3
#: A sentence ends after [.!?] and white space, at a line feed, or after so many words.
LONGEST = 16
#: Spans of fewer words are too short to count as a repeated passage: they take in the next sentences too.
LEAST_WORDS = 10
#: Words of a window, and windows of which one is kept: every repeated passage of 50 words is found.
WINDOW, GAP = 26, 25
#: Hash functions of the filter of repeated hashes, and its 8 kB chunks at most (32 MB).  It only
#: decides which places travel: those of a hash that it holds wrongly meet no other and are dropped.
PROBES, MOST_CHUNKS = 8, 1 << 12
#: Changed documents up to which their ids are broadcast.
FEW = 1_000_000
SPAN, WIDE = 0, 1
PLACES = "h long, kind int, doc_id long, place int, width int, before binary, after binary"


def sentences(array, longest: int = LONGEST):
    """(first word of each sentence, with the number of words as last item; sentences of row i: cut[i]:cut[i+1]; words' data)."""
    data, offsets = T.raw(array)
    start, end, hashed, first = T.words(array)
    n = len(start)
    if not n:
        return np.zeros(1, np.int64), np.zeros(len(first), np.int64), (start, end, hashed, first)
    last = data[end - 1]
    closes = (last == 0x2E) | (last == 0x21) | (last == 0x3F)
    lines = np.concatenate(([0], np.cumsum(data == 0x0A)))
    closes[:-1] |= lines[start[1:]] > lines[end[:-1]]
    begins = np.zeros(n + 1, bool)
    begins[1:n] = closes[:-1]
    begins[first[first < n]] = True
    begins[n] = False
    heads = np.flatnonzero(begins[:n])
    size = np.diff(np.append(heads, n))
    if (size > longest).any():
        within = np.arange(n) - np.repeat(heads, size)
        heads = np.flatnonzero(begins[:n] | (within % longest == 0))
    return np.append(heads, n), np.searchsorted(heads, first), (start, end, hashed, first)


def _spans(array, run: int, least: int):
    """(row, place, length, hash) of every span: run sentences, or as many more as it takes to reach least words."""
    heads, cut, (_, _, hashed, _) = sentences(array)
    if len(heads) < 2:
        return
    _, _, up, down = T._tables(len(hashed) + 1)
    with np.errstate(over="ignore"):
        total = np.concatenate(([np.uint64(0)], np.cumsum(hashed * up[: len(hashed)])))
        a, b = heads[:-1], heads[1:]
        per = T.mix((total[b] - total[a]) * down[a] + (b - a).astype(np.uint64))
        total = np.concatenate(([np.uint64(0)], np.cumsum(per * up[: len(per)])))
    places = np.arange(len(heads) - 1)
    stop = np.maximum(places + run, np.searchsorted(heads, heads[:-1] + least))
    for i in range(len(cut) - 1):
        a, b = int(cut[i]), int(cut[i + 1])
        at = places[a:b]
        if b - a < run:
            # a text of fewer sentences than a span is one span
            at = at[:1] if b > a and heads[b] - heads[a] >= least else at[:0]
            to = np.full(len(at), b)
        else:
            at = at[stop[a:b] <= b]
            to = stop[at]
        if len(at):
            with np.errstate(over="ignore"):
                yield i, at - a, to - at, T.mix((total[to] - total[at]) * down[at] + (to - at).astype(np.uint64))


def _sliding(values: np.ndarray, width: int, pick) -> np.ndarray:
    """pick (minimum or maximum) of every width items, by doubling."""
    out, have = values, 1
    while have < width:
        step = min(have, width - have)
        out, have = pick(out[: len(out) - step], out[step:]), have + step
    return out


def _windows(array):
    """(hash of the window at each word, first word of each row, place after the last window of each row, kept places)."""
    _, _, hashed, first = T.words(array)
    n = len(hashed)
    last = np.maximum(first[1:] - WINDOW + 1, first[:-1])
    if n < WINDOW + GAP - 1:
        return np.zeros(0, np.uint64), first, last, np.zeros(0, np.int64)
    _, _, up, down = T._tables(n + 1)
    with np.errstate(over="ignore"):
        total = np.concatenate(([np.uint64(0)], np.cumsum(hashed * up[:n])))
        h = T.mix((total[WINDOW:] - total[:-WINDOW]) * down[: n - WINDOW + 1] + np.uint64(WINDOW))
    least = _sliding(h, GAP, np.minimum)
    # neighbours that reach into the next text keep nothing
    inside = np.zeros(len(least) + 1, np.int64)
    whole = np.flatnonzero(last - first[:-1] >= GAP)
    inside[first[whole]] += 1
    np.subtract.at(inside, last[whole] - GAP + 1, 1)
    least[np.cumsum(inside)[:-1] == 0] = 0
    pad = np.zeros(GAP - 1, np.uint64)
    return h, first, last, np.flatnonzero(_sliding(np.concatenate((pad, least, pad)), GAP, np.maximum) == h)


def _found(array, kinds, run: int, least: int):
    """(kind, hash, row, place, width, first word) of all spans and kept windows of an array of texts."""
    if SPAN in kinds:
        found = list(_spans(array, run, least))
        if found:
            size = [len(x[1]) for x in found]
            row = np.repeat([x[0] for x in found], size)
            place, width, h = (np.concatenate([x[k] for x in found]) for k in (1, 2, 3))
            yield SPAN, h, row, place, width, None
    if WIDE in kinds:
        h, first, _, at = _windows(array)
        if len(at):
            row = np.searchsorted(first, at, "right") - 1
            # apart from the hashes of spans
            yield WIDE, T.mix(h[at] ^ np.uint64(WINDOW)), row, at - first[row], np.full(len(at), WINDOW), at


def _hashes(docs: DataFrame, kinds, run: int, least: int) -> DataFrame:
    """(h, n): how often every hash of docs (doc_id, text) occurs; added up slice by slice before the shuffle."""

    def count(batches):
        for piece in T.slices(batches):
            for _, h, *_ in _found(piece.column(1), kinds, run, least):
                key, n = np.unique(h, return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array(key.view(np.int64)), pa.array(np.minimum(n, 2).astype(np.int32))], ["h", "n"])

    return docs.mapInArrow(count, "h long, n int").groupBy("h").agg(F.sum("n").alias("n"))


def _neighbours(words: np.ndarray, start: np.ndarray, end: np.ndarray, step: int) -> pa.Array:
    """32 bits of each of the up to GAP - 1 words from start, in steps of step, before end is reached; as bytes."""
    size = np.minimum(np.abs(end - start), GAP - 1)
    owner, k = T.spread(np.zeros(len(size), np.int64), size)
    data = words[start[owner] + step * k].astype("<u4").tobytes()
    offsets = np.concatenate(([0], np.cumsum(4 * size))).astype(np.int32)
    return pa.BinaryArray.from_buffers(pa.binary(), len(size), [None, pa.py_buffer(offsets), pa.py_buffer(data)])


def _places(docs: DataFrame, repeated: bloom.LevelBloom, kinds, run: int, least: int) -> DataFrame:
    """PLACES of the hashes of docs (doc_id, text) that repeated holds; before and after: words around a window."""
    shared = docs.sparkSession.sparkContext.broadcast(repeated)
    names = [x.split()[0] for x in PLACES.split(", ")]

    def find(batches):
        for piece in T.slices(batches):
            ids = piece.column(0).to_numpy(zero_copy_only=False)
            for kind, h, row, place, width, at in _found(piece.column(1), kinds, run, least):
                keep = np.flatnonzero(shared.value.level(h) > 0)
                h, row, place, width = h[keep], row[keep], place[keep], width[keep]
                around = [pa.nulls(len(keep), pa.binary())] * 2
                if kind == WIDE:
                    _, _, hashed, first = T.words(piece.column(1))
                    word, at = (hashed >> np.uint64(32)).astype(np.uint32), at[keep]
                    around = [_neighbours(word, at - 1, first[row] - 1, -1), _neighbours(word, at + WINDOW, first[row + 1], 1)]
                columns = [pa.array(h.view(np.int64)), pa.array(np.full(len(h), kind, np.int32)), pa.array(ids[row], pa.int64())]
                yield pa.RecordBatch.from_arrays([*columns, *[pa.array(x, pa.int32()) for x in (place, width)], *around], names)

    return docs.mapInArrow(find, PLACES)


def _agree(a: pa.Array, b: pa.Array) -> np.ndarray:
    """How many leading words two columns of neighbours have in common, row by row."""
    out = np.zeros(len(a), np.int32)
    for i, (x, y) in enumerate(zip(a, b)):
        x, y = np.frombuffer(x.as_buffer(), "<u4"), np.frombuffer(y.as_buffer(), "<u4")
        n = min(len(x), len(y))
        unlike = np.flatnonzero(x[:n] != y[:n])
        out[i] = unlike[0] if len(unlike) else n
    return out


def later_occurrences(docs: DataFrame, kinds=(SPAN, WIDE), run: int = RUN, least: int = LEAST_WORDS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, kind, start, end, first_doc) of all spans (in sentences) and windows with what agrees around them (in
    words) that are not the first of their kind.  Ids and texts as in repeated_spans.

    Words of a window's first occurrence stay where a later one of the same text overlaps it.
    """
    ship(docs.sparkSession)
    scratch = Scratch(docs.sparkSession, "spans")
    rows = docs.where(F.col(id_col).isNotNull()).select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    again = scratch.write(_hashes(rows, kinds, run, least).where("n > 1").select(F.col("h").alias("key"), F.lit(1).alias("level")))
    repeated = bloom.build(again, min(MOST_CHUNKS, bloom.LevelBloom.chunks_for(again.count(), 0, PROBES)), PROBES)
    scratch.drop(again)
    places = scratch.write(_places(rows, repeated, kinds, run, least))
    first = places.groupBy("h").agg(F.count(F.lit(1)).alias("n"), F.min(F.struct("doc_id", "place", "before", "after")).alias("first")).where("n > 1")
    first = scratch.write(first.select("h", *[F.col(f"first.{c}").alias(f"first_{c}") for c in ("doc_id", "place", "before", "after")]))
    joined = places.join(first, "h").where("doc_id <> first_doc_id or place <> first_place")

    def extend(batches):
        for b in batches:
            if not b.num_rows:
                continue
            kind, place, width, first_place = (b.column(b.schema.get_field_index(c)).to_numpy() for c in ("kind", "place", "width", "first_place"))
            start, end = place.copy(), place + width
            wide = np.flatnonzero(kind == WIDE)
            if len(wide):
                part = b.take(pa.array(wide))
                left, right = (_agree(part.column(part.schema.get_field_index(c)), part.column(part.schema.get_field_index(f"first_{c}"))) for c in ("before", "after"))
                same = part.column(0).to_numpy() == part.column(1).to_numpy()
                start[wide] -= left
                end[wide] += right
                start[wide] = np.where(same, np.maximum(start[wide], first_place[wide] + WINDOW + right), start[wide])
            keep = pa.array(np.flatnonzero(start < end))
            columns = [b.column(0), pa.array(kind), pa.array(start, pa.int32()), pa.array(end, pa.int32()), b.column(1)]
            yield pa.RecordBatch.from_arrays([c.take(keep) for c in columns], ["doc_id", "kind", "start", "end", "first_doc"])

    joined = joined.select("doc_id", "first_doc_id", "kind", "place", "width", "first_place", "before", "after", "first_before", "first_after")
    return joined.mapInArrow(extend, "doc_id long, kind int, start int, end int, first_doc long").distinct()


def _by_document(later: DataFrame) -> DataFrame:
    """doc_id, spans and windows (start, end), first_doc_ids: what is gathered is bounded by the document's own text."""
    at = F.struct("start", "end")
    gathered = [F.collect_set(F.when(F.col("kind") == k, at)).alias(name) for k, name in ((SPAN, "spans"), (WIDE, "windows"))]
    return later.groupBy("doc_id").agg(*gathered, F.array_sort(F.collect_set("first_doc")).alias("first_doc_ids"))


def repeated_windows(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, ranges (start and end, in words, of what to remove; they may overlap), window_doc_ids (where it comes first).

    All words of the later copies of a passage of WINDOW + GAP - 1 words or more, wherever it starts.  A copy that
    shares more with another copy than with the first keeps up to GAP - 1 words of that at either end.
    """
    found = _by_document(later_occurrences(docs, (WIDE,), id_col=id_col, text_col=text_col))
    return found.select("doc_id", F.col("windows").alias("ranges"), F.col("first_doc_ids").alias("window_doc_ids"))


def repeated_spans(docs: DataFrame, run: int = RUN, least: int = LEAST_WORDS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, removed (sorted numbers of the sentences to remove), first_doc_ids (where their spans come first).

    Only documents that lose a sentence have a row.  Words compare without the case of A-Z and the kind of white
    space.  A text of fewer sentences than a span is one span; null, empty and wordless texts have none.  Of rows
    repeated with one id the first occurrence is the same (doc_id, place), so they keep their sentences: leave those
    to exact dedup.  Rows with a null id are left alone.  Other columns are ignored; no rows give no rows.
    """
    found = _by_document(later_occurrences(docs, (SPAN,), run, least, id_col, text_col))
    every = F.flatten(F.transform("spans", lambda s: F.sequence(s["start"], s["end"] - 1)))
    return found.select("doc_id", F.array_sort(F.array_distinct(every)).alias("removed"), "first_doc_ids")


def remove_repeated_spans(docs: DataFrame, run: int = RUN, least: int = LEAST_WORDS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The changed documents: doc_id, text without the repeated sentences and words, n_sentences, removed (numbers of the
    sentences of which nothing stays), first_doc_ids, removed_words (start and end, in words, of all that is removed).

    What stands between two kept words stays as it was before the later of them.
    """
    scratch = Scratch(docs.sparkSession, "cut")
    found = _by_document(later_occurrences(docs, run=run, least=least, id_col=id_col, text_col=text_col))
    every = F.flatten(F.transform("spans", lambda s: F.sequence(s["start"], s["end"] - 1)))
    found = scratch.write(found.select("doc_id", F.array_sort(F.array_distinct(every)).alias("removed"), "first_doc_ids", F.col("windows.start").alias("start"), F.col("windows.end").alias("end")))
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    if found.count() <= FEW:
        # at most FEW ids: texts without a repetition do not shuffle
        rows = rows.join(F.broadcast(found.select("doc_id")), "doc_id", "left_semi")
    rows = rows.join(found, "doc_id")
    schema = "doc_id long, text string, n_sentences int, removed array<int>, first_doc_ids array<long>, removed_words array<struct<start: int, end: int>>"
    ranges = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())]))

    def cut(batches):
        for piece in T.slices(batches):
            data, offsets = T.raw(piece.column(1))
            heads, at, (start, end, _, first) = sentences(piece.column(1))
            texts, counts, removed, words = [], [], [], []
            columns = [piece.column(piece.schema.get_field_index(c)) for c in ("removed", "start", "end")]
            for i in range(piece.num_rows):
                a, b, base, n = int(at[i]), int(at[i + 1]), int(first[i]), int(first[i + 1] - first[i])
                gone, begin, close = (np.asarray(c[i].as_py() or [], np.int64) for c in columns)
                gone = gone[gone < b - a]
                begin, close = np.concatenate((begin, heads[a + gone] - base)), np.concatenate((close, heads[a + gone + 1] - base))
                depth = np.zeros(n + 1, np.int64)
                np.add.at(depth, np.minimum(begin, n), 1)
                np.subtract.at(depth, np.minimum(close, n), 1)
                stay = np.cumsum(depth)[:-1] == 0
                turns = np.flatnonzero(np.diff(np.concatenate(([False], stay, [False])).astype(np.int8)))
                # a word owns the space before it, but for the first that stays
                parts = [data[end[base + x - 1] if x else start[base] : end[base + y - 1]].tobytes() for x, y in turns.reshape(-1, 2)]
                texts.append(b"".join(parts).strip(b" \t\n\v\f\r").decode("utf-8", "replace"))
                counts.append(b - a)
                kept = np.concatenate(([0], np.cumsum(stay)))
                removed.append(np.flatnonzero(kept[heads[a + 1 : b + 1] - base] == kept[heads[a:b] - base]).astype(np.int32))
                turns = np.flatnonzero(np.diff(np.concatenate(([True], stay, [True])).astype(np.int8)))
                words.append([{"start": int(x), "end": int(y)} for x, y in turns.reshape(-1, 2)])
            out = [piece.column(0), pa.array(texts, pa.string()), pa.array(counts, pa.int32()), pa.array(removed, pa.list_(pa.int32())), piece.column(piece.schema.get_field_index("first_doc_ids")), pa.array(words, ranges)]
            yield pa.RecordBatch.from_arrays(out, ["doc_id", "text", "n_sentences", "removed", "first_doc_ids", "removed_words"])

    return rows.mapInArrow(cut, schema)
