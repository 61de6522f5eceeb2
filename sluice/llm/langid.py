"""Language identification by word-first backoff.

A known word scores by its log frequency in each language.  An unseen word scores by its characters: at each place
the longest known n-gram that begins there, falling back to shorter ones, and the mean over places counts as a word.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sluice.llm import textkit as T
from sluice.llm.common import Scratch, seeded, ship

#: Documents of each language to learn from (chosen by a hash of the id), words and n-grams kept: bounds of the model.
SAMPLE = 3000
WORDS = 1 << 17
GRAMS = 1 << 16
ORDERS = (5, 4, 3, 2, 1)
FOLDS, HELD = 4, 2
UND = "und"


def remainder(doc_id, folds: int):
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit(""))) % folds


class Model:
    """langs; hashes and per-language log frequencies of words and n-grams."""

    def __init__(self, langs, words, word_logs, grams, gram_logs):
        self.langs, self.words, self.word_logs, self.grams, self.gram_logs = langs, words, word_logs, grams, gram_logs
        self._find = None

    def __getstate__(self):
        return self.__dict__ | {"_find": None}

    def scores(self, array) -> np.ndarray:
        """Sum of log frequencies, for each row and language."""
        if self._find is None:
            self._find = T.Lookup(self.words), T.Lookup(self.grams)
        find_word, find_gram = self._find
        array = T.folded(array)
        start, end, hashed, first = T.words(array)
        each = np.zeros((len(start), len(self.langs)), np.float32)
        at = find_word(hashed)
        known = at >= 0
        each[known] = self.word_logs[at[known]]
        unseen = np.flatnonzero(~known)
        if len(unseen):
            grams = T.Grams(array)
            a, b = grams.bounds(start[unseen], end[unseen])
            owner, place = T.spread(a, b)
            logs = np.zeros((len(place), len(self.langs)), np.float32)
            open_ = np.arange(len(place))
            for n in ORDERS:
                fits = place[open_] + n <= b[owner[open_]]
                at = np.full(len(open_), -1, np.int32)
                at[fits] = find_gram(grams.of(place[open_[fits]], n))
                hit = at >= 0
                logs[open_[hit]] = self.gram_logs[at[hit]]
                open_ = open_[~hit]
            each[unseen] = np.add.reduceat(logs, np.cumsum(b - a) - (b - a)) / (b - a)[:, None]
        total = np.concatenate((np.zeros((1, len(self.langs))), np.cumsum(each, 0, dtype=np.float64)))
        return total[first[1:]] - total[first[:-1]]


def _counts(batches):
    """(lang, order, key, n): order 0 are words as often as they occur, others n-grams of distinct words."""
    for piece in T.slices(batches, "text", 1 << 20):
        array = T.folded(piece.column(1))
        langs, lang_of = np.unique(np.array(piece.column(0).to_pylist(), object).astype(str), return_inverse=True)
        start, end, hashed, first = T.words(array)
        word_lang = np.repeat(lang_of, np.diff(first))
        grams = T.Grams(array)
        out = []
        for i, lang in enumerate(langs):
            mine = np.flatnonzero(word_lang == i)
            key, at, n = np.unique(hashed[mine], return_index=True, return_counts=True)
            out.append((lang, 0, key, n))
            a, b = grams.bounds(start[mine[at]], end[mine[at]])
            owner, place = T.spread(a, b)
            for order in ORDERS:
                fits = place + order <= b[owner]
                out.append((lang, order, *np.unique(grams.of(place[fits], order), return_counts=True)))
        size = [len(x[2]) for x in out]
        yield pa.RecordBatch.from_arrays(
            [
                pa.array(np.repeat([x[0] for x in out], size), pa.string()),
                pa.array(np.repeat([x[1] for x in out], size), pa.int32()),
                pa.array(np.concatenate([x[2] for x in out]).view(np.int64)),
                pa.array(np.concatenate([x[3] for x in out]).astype(np.int64)),
            ],
            ["lang", "order", "key", "n"],
        )


def train(labelled: DataFrame, sample: int = SAMPLE, seed: int = 5) -> Model:
    """Learns from (doc_id, text, lang), lang not null: at most about sample documents of each language."""
    sizes = {r["lang"]: r["n"] for r in labelled.groupBy("lang").agg(F.count(F.lit(1)).alias("n")).collect()}
    langs = sorted(sizes)
    if not langs:
        none = np.zeros(0, np.uint64)
        return Model([], none, np.zeros((0, 0), np.float32), none, np.zeros((0, 0), np.float32))
    chance = F.create_map(*[x for k, n in sizes.items() for x in (F.lit(k), F.lit(min(1.0, sample / n)))])
    draw = (F.pmod(seeded(seed, "doc_id"), F.lit(1 << 30)) / F.lit(float(1 << 30))) < chance[F.col("lang")]
    counts = labelled.where(draw).select("lang", "text").mapInArrow(_counts, "lang string, order int, key long, n long")
    counts = counts.groupBy("lang", "order", "key").agg(F.sum("n").alias("n"))
    # a row for each key with the counts of all languages; the most frequent are kept
    by_key = counts.groupBy("order", "key").agg(F.sum("n").alias("all"), F.map_from_entries(F.collect_list(F.struct("lang", "n"))).alias("by"))
    by_key = by_key.where("all > 1")
    wide = by_key.select("order", "key", "all", *[F.coalesce(F.col("by")[k], F.lit(0)).cast("int").alias(f"n{i}") for i, k in enumerate(langs)])
    wide = Scratch(labelled.sparkSession, "langid").write(wide)
    totals = counts.groupBy("lang", "order").agg(F.sum("n").alias("n")).collect()
    total = {(r["lang"], r["order"]): r["n"] for r in totals}

    def part(rows: DataFrame, most: int):
        got = rows.orderBy(F.desc("all"), "key").limit(most).toPandas()
        n = got[[f"n{i}" for i in range(len(langs))]].to_numpy(np.float64)
        whole = np.array([[total.get((k, int(o)), 0) for k in langs] for o in range(max(ORDERS) + 1)], np.float64)[got["order"].to_numpy()]
        return got["key"].to_numpy().view(np.uint64), np.log((n + 0.2) / (whole + 0.2 * max(1, len(got)))).astype(np.float32)

    return Model(langs, *part(wide.where("order = 0"), WORDS), *part(wide.where("order > 0"), GRAMS))


def identify(docs: DataFrame, model: Model, keep: bool = False) -> DataFrame:
    """doc_id, lang_pred, score for every row; with keep, the row's own columns as struct row beside them."""
    ship(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(model)  # at most WORDS + GRAMS rows of a float per language
    letters = F.coalesce(F.col("text").rlike(r"\p{L}"), F.lit(False))

    def run(batches):
        model = shared.value
        for piece in T.slices(batches):
            letter = piece.column(piece.schema.get_field_index("letters")).to_numpy(zero_copy_only=False).astype(bool)
            n = piece.num_rows
            pred, score = np.full(n, UND, object), np.zeros(n)
            if model.langs:
                s = model.scores(piece.column(piece.schema.get_field_index("text")))
                best = s.argmax(1)
                p = np.exp(s - s.max(1, keepdims=True))
                score = np.where(letter, 1 / p.sum(1), 0.0)
                pred = np.where(letter, np.array(model.langs, object)[best], UND)
            rest = [piece.column(i) for i, f in enumerate(piece.schema.names) if f not in ("text", "letters")]
            names = [f for f in piece.schema.names if f not in ("text", "letters")]
            yield pa.RecordBatch.from_arrays([*rest, pa.array(pred, pa.string()), pa.array(score)], [*names, "lang_pred", "score"])

    schema = ", ".join(f"{c} {t}" for c, t in docs.dtypes if c != "text")
    return docs.withColumn("letters", letters).mapInArrow(run, f"{schema}, lang_pred string, score double")


def language_of(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", sample: int = SAMPLE) -> DataFrame:
    """doc_id, held_out, lang_pred, score for every row of docs.

    Learns from rows with a language whose crc32 of the id (null: of '') mod 4 is not 2.  und with score 0: text
    null, empty or without a letter, or nothing to learn from.  Equal scores go to the first language in order.
    Repeated rows are rows like others; other columns are ignored; no rows give no rows.
    """
    ship(docs.sparkSession)
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"), F.col(lang_col).alias("lang"))
    held = remainder(F.col("doc_id"), FOLDS) == HELD
    model = train(rows.where(F.col("lang").isNotNull() & ~held), sample)
    return identify(rows.select("doc_id", held.alias("held_out"), "text"), model)


def drop_unidentified(docs: DataFrame, least: float = 0.5, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", sample: int = SAMPLE) -> DataFrame:
    """The rows of docs, unchanged, whose language is told with a score of least or more.

    Rejected: texts that are null or have no letter, and those torn between languages.  With nothing to learn from,
    only the former go.
    """
    ship(docs.sparkSession)
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"), F.col(lang_col).alias("lang"))
    model = train(rows.where(F.col("lang").isNotNull() & (remainder(F.col("doc_id"), FOLDS) != HELD)), sample)
    shared = docs.sparkSession.sparkContext.broadcast(model)
    at = docs.columns.index(text_col)
    # columns travel by place, so that their names cannot clash
    plain = docs.toDF(*[f"c{i}" for i in range(len(docs.columns))])

    def run(batches):
        model = shared.value
        for piece in T.slices(batches, f"c{at}"):
            if model.langs:
                s = model.scores(piece.column(at))
                piece = piece.filter(pa.array(1 / np.exp(s - s.max(1, keepdims=True)).sum(1) >= least))
            yield piece

    kept = plain.where(F.col(f"c{at}").rlike(r"\p{L}")).mapInArrow(run, plain.schema)
    return kept.toDF(*docs.columns)
