"""Toxicity by subword-bag embeddings.

A word is the mean of the vectors of its character n-grams and of itself, hashed into a table; a text is the mean of
its words; a linear softmax reads it.  Table and softmax are trained together in numpy on a bounded sample.
A trained model scores a word by one number per n-gram, so only that table is broadcast.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sluice.llm import textkit as T
from sluice.llm.common import seeded, ship
from sluice.llm.langid import remainder

#: Labelled documents of each class to learn from (chosen by a hash of the id).
SAMPLE = 2500
SLOTS = 1 << 20
DIM = 4
ORDERS = (3, 4, 5)
STEPS = 80
RATE = 0.2
#: Standard errors by which an n-gram's share of texts must differ between the classes to get a vector.
LEAST_Z = 5.0
#: Toxic texts from which an n-gram gets a vector however many labels there are, if no clean text holds it.
FEW = 8
FOLDS, HELD = 5, 0


def subwords(array, start: np.ndarray, end: np.ndarray, hashed: np.ndarray, slots: int = SLOTS):
    """(owner, slot) of the n-grams of words, and of each word as a whole."""
    grams = T.Grams(array)
    a, b = grams.bounds(start, end)
    owners, keys = [np.arange(len(start))], [hashed]
    owner, place = T.spread(a, b)
    for n in ORDERS:
        fits = place + n <= b[owner]
        owners.append(owner[fits])
        keys.append(grams.of(place[fits], n))
    owner, key = np.concatenate(owners), np.concatenate(keys)
    order = np.argsort(owner, kind="stable")
    return owner[order], (key[order] % np.uint64(slots)).astype(np.int32)


def _types(array):
    """Distinct words of an array with their places: (types' start, end, hash, type of each word, first word of each row)."""
    start, end, hashed, first = T.words(array)
    key, at, kind = np.unique(hashed, return_index=True, return_inverse=True)
    return start[at], end[at], key, kind, first


class Model:
    """weight: what a slot adds to the difference of the two classes' logits; bias: what a text has without words."""

    def __init__(self, weight: np.ndarray, bias: float):
        self.weight, self.bias = weight, bias

    def scores(self, array) -> np.ndarray:
        array = T.folded(array)
        start, end, key, kind, first = _types(array)
        n = np.diff(first)
        mean = np.zeros(len(n))
        if len(start):
            owner, slot = subwords(array, start, end, key, len(self.weight))
            size = np.bincount(owner, minlength=len(start))
            word = np.bincount(owner, self.weight[slot], len(start)) / size
            total = np.concatenate(([0.0], np.cumsum(word[kind])))
            mean = (total[first[1:]] - total[first[:-1]]) / np.maximum(n, 1)
        return 1 / (1 + np.exp(-np.clip(mean + self.bias, -40, 40)))


def _bag(texts: pa.Array, slots: int):
    """(slots of all distinct words, where each word's begin; text, word, and the word's share of the text).

    Goes through the texts in slices, so that only their distinct words are held together.
    """
    keys, sizes, held, rows, words, shares = [], [], [], [], [], []
    done = 0
    for piece in T.slices([pa.RecordBatch.from_arrays([texts], ["text"])]):
        array = T.folded(piece.column(0))
        start, end, key, kind, first = _types(array)
        n = np.diff(first)
        if len(start):
            owner, slot = subwords(array, start, end, key, slots)
            sizes.append(np.bincount(owner, minlength=len(start)))
            held.append(slot)
            keys.append(key)
            pair, times = np.unique(np.repeat(np.arange(len(n)), n) * len(start) + kind, return_counts=True)
            rows.append((pair // len(start) + done).astype(np.int32))
            words.append(key[pair % len(start)])
            shares.append((times / n[pair // len(start)]).astype(np.float32))
        done += len(n)
    if not keys:
        none = np.zeros(0, np.int32)
        return none, none, none, none, np.zeros(0, np.float32)
    key, at = np.unique(np.concatenate(keys), return_index=True)
    size = np.concatenate(sizes)
    begin = np.cumsum(size) - size
    _, place = T.spread(begin[at], begin[at] + size[at])
    slot = np.concatenate(held)[place]
    edges = np.cumsum(size[at]) - size[at]
    return slot, edges, np.concatenate(rows), np.searchsorted(key, np.concatenate(words)), np.concatenate(shares)


def telling(slot, edges, row, col, labels: np.ndarray, slots: int, least: float = LEAST_Z) -> np.ndarray:
    """Whether the classes' shares of texts that hold a slot differ by at least least standard errors, or FEW toxic
    texts hold it and no clean one."""
    held = np.zeros((2, slots), np.int64)
    ends = np.append(edges, len(slot))
    cut = np.searchsorted(row, np.arange(len(labels) + 1))
    for i, label in enumerate(labels):
        words = col[cut[i] : cut[i + 1]]
        held[int(label), np.unique(slot[T.spread(ends[words], ends[words + 1])[1]])] += 1
    n = np.bincount(labels.astype(int), minlength=2)
    share, both = held / n[:, None], held.sum(0) / n.sum()
    error = np.sqrt(both * (1 - both) * (1 / n[0] + 1 / n[1]))
    return (np.abs(share[1] - share[0]) >= least * np.maximum(error, 1e-9)) | ((held[0] == 0) & (held[1] >= FEW))


def fit(texts: pa.Array, labels: np.ndarray, steps: int = STEPS, dim: int = DIM, slots: int = SLOTS, rate: float = RATE, seed: int = 3) -> Model:
    """Trains table, softmax and bias together with Adam over all given texts.

    N-grams whose share of texts hardly differs between the classes keep the zero vector: averaged over a long text
    they would only add noise.  Both classes weigh alike.
    """
    if not len(labels) or labels.min() == labels.max():
        return Model(np.zeros(slots, np.float32), 5.0 if len(labels) and labels[0] else -5.0)
    slot, edges, row, col, share = _bag(texts, slots)
    docs, words = len(labels), len(edges)
    owner = np.repeat(np.arange(words, dtype=np.int32), np.diff(np.append(edges, len(slot))))
    parts = np.bincount(owner, minlength=words)
    real = telling(slot, edges, row, col, labels, slots)
    # from here on only n-grams that tell, the words that hold one, and their places in texts
    keep = real[slot]
    ids, slot = np.unique(slot[keep], return_inverse=True)
    used, owner = np.unique(owner[keep], return_inverse=True)
    place = np.full(words, -1)
    place[used] = np.arange(len(used))
    there = place[col] >= 0
    row, col, share = row[there], place[col[there]], share[there]
    share = share / parts[used][col]
    rng = np.random.default_rng(seed)
    table, soft, bias = rng.normal(0, 0.1, (len(ids), dim)), rng.normal(0, 1, (dim, 2)), np.zeros(2)
    state = [(np.zeros_like(p), np.zeros_like(p)) for p in (table, soft, bias)]
    weight = np.where(labels == 1, 0.5 / (labels == 1).sum(), 0.5 / (labels == 0).sum())[:, None]
    truth = np.stack([labels == 0, labels == 1], 1)

    def gather(at, values, count):
        return np.stack([np.bincount(at, values[:, d], count) for d in range(values.shape[1])], 1)

    for step in range(1, steps + 1):
        word = gather(owner, table[slot], len(used))
        text = gather(row, share[:, None] * word[col], docs)
        logit = text @ soft + bias
        p = np.exp(logit - logit.max(1, keepdims=True))
        error = (p / p.sum(1, keepdims=True) - truth) * weight
        to_word = gather(col, share[:, None] * (error @ soft.T)[row], len(used))
        grads = gather(slot, to_word[owner], len(ids)), text.T @ error, error.sum(0)
        for value, grad, (m, v) in zip((table, soft, bias), grads, state):
            m += 0.1 * (grad - m)
            v += 0.01 * (grad * grad - v)
            value -= rate * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.99**step)) + 1e-8)
    out = np.zeros(slots, np.float32)
    out[ids] = table @ (soft[:, 1] - soft[:, 0])
    return Model(out, float(bias[1] - bias[0]))


def train(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE, seed: int = 9) -> Model:
    """Learns from (doc_id, text) and (doc_id, toxic): at most about sample documents of each class."""
    known = labels.where("toxic in (0, 1) and doc_id is not null").where(remainder(F.col("doc_id"), FOLDS) != HELD)
    known = known.groupBy("doc_id").agg(F.max("toxic").alias("toxic"))  # of unlike labels the worse
    sizes = {r["toxic"]: r["n"] for r in known.groupBy("toxic").agg(F.count(F.lit(1)).alias("n")).collect()}
    chance = F.when(F.col("toxic") == 1, min(1.0, sample / max(1, sizes.get(1, 0)))).otherwise(min(1.0, sample / max(1, sizes.get(0, 0))))
    draw = F.pmod(seeded(seed, "doc_id"), F.lit(1 << 30)) / F.lit(float(1 << 30)) < chance
    picked = F.broadcast(known.where(draw))  # about 2 * sample rows
    got = docs.join(picked, "doc_id").select("doc_id", "text", F.col("toxic").cast("int")).toArrow()
    got = got.sort_by([("doc_id", "ascending"), ("text", "ascending")])
    return fit(got.column("text").combine_chunks(), got.column("toxic").to_numpy())


def score(docs: DataFrame, model: Model) -> DataFrame:
    """Adds score to docs in place of text."""
    ship(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(model)  # SLOTS numbers
    names = [c for c in docs.columns if c != "text"]

    def run(batches):
        for piece in T.slices(batches):
            at = piece.schema.get_field_index
            yield pa.RecordBatch.from_arrays([*[piece.column(at(c)) for c in names], pa.array(shared.value.scores(piece.column(at("text"))))], [*names, "score"])

    return docs.mapInArrow(run, ", ".join(f"{c} {t}" for c, t in docs.dtypes if c != "text") + ", score double")


def toxicity(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", sample: int = SAMPLE) -> DataFrame:
    """doc_id, held_out, score, predicted for every row of docs.

    Learns from rows of labels with toxic 0 or 1 whose crc32 of the id mod 5 is not 0; of unlike labels of one id the
    worse counts.  A null or wordless text scores by the bias alone; without labels, or with one class only, every
    text scores alike.  Repeated rows are rows like others; other columns are ignored; no rows give no rows.
    """
    ship(docs.sparkSession)
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    model = train(rows, labels.select("doc_id", "toxic"), sample)
    held = remainder(F.col("doc_id"), FOLDS) == HELD
    out = score(rows.select("doc_id", held.alias("held_out"), "text"), model)
    return out.select("doc_id", "held_out", "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))
