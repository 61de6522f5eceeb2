"""Language-model scoring with a log-frequency Bloom filter.

The filter holds every word pair that training has LEAST times or more, with its count on a log scale, whatever the
words: pairs are counted by a shuffle of hashes, and the filter's size follows their number.  It is broadcast, in
pieces where it is large; each piece then takes a pass over the texts.  A second filter holds the counts of words, and
what the pairs of a history add up to, for words outside the most frequent ones.

p(w|h) = m(h) * c(h, w) / C(h) + (1 - m(h)) * b(w), from membership probes alone.  c is the count that probes return,
C(h) an upper bound of the sum of c over the pairs of h, m(h) at most WEIGHT and lower where few pairs of h are held,
and b the base probability; so the probabilities after a history sum to 1 at most.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sluice.llm import bloom
from sluice.llm import textkit as T
from sluice.llm.common import Scratch, ship
from sluice.llm.langid import remainder

#: Most frequent words, whose exact counts are broadcast.  A size only: every word is counted, and makes pairs.
FREQUENT = 1 << 18
#: Count from which a pair is held.
LEAST = 2
WEIGHT = 0.9
#: Hash functions beyond the binary digits of the vocabulary's size: of 2**SURE histories one has a pair held wrongly.
#: C(h) leaves room for one such pair, so sums pass 1 where there are two: for about one history of 2**(2 * SURE + 1).
SURE = 10
#: Hash functions for words, and the 8 kB chunks of a piece of the pairs at most (128 MB).
WORD_PROBES, PIECE = 14, 1 << 14
FOLDS, HELD = 5, 1
#: The token that closes a text, and the history of its first word: key 1 stands for no word's hash in practice.
END = np.uint64(1)
#: Pairs or words that a task adds up before it hands them on.
HOLD = 1 << 19


def _tokens(array):
    """(hashes of all words and closing tokens, first token of each row)."""
    _, _, hashed, first = T.words(array)
    rows = len(first) - 1
    shifted = first + np.arange(rows + 1)
    out = np.empty(len(hashed) + rows, np.uint64)
    ends = shifted[1:] - 1
    out[ends] = END
    word = np.ones(len(out), bool)
    word[ends] = False
    out[word] = hashed
    return out, shifted


def _histories(token: np.ndarray, first: np.ndarray) -> np.ndarray:
    out = np.empty_like(token)
    out[1:] = token[:-1]
    out[first[:-1]] = END
    return out


def pair_keys(history: np.ndarray, token: np.ndarray) -> np.ndarray:
    with np.errstate(over="ignore"):
        return T.mix(T.mix(history * np.uint64(0x9E3779B97F4A7C15)) + token)


def _held_key(word: np.ndarray) -> np.ndarray:
    """The key of what a word's pairs add up to, in the filter of words."""
    return T.mix(word ^ np.uint64(0xC2B2AE3D27D4EB4F))


def level_of(count, least: int):
    """Log-scale level of a count: 1 from least, one more for each doubling; 0 below."""
    return np.where(count >= least, 1 + np.floor(np.log2(np.maximum(count, 1) / least + 1e-12)), 0).astype(np.int64)


def level_count(level, least: int):
    """The least count of a level."""
    return np.where(level > 0, least * 2.0 ** (level - 1), 0.0)


class Model:
    """words: hashes of the frequent words, END first; counts: their training counts; held: what the pairs of each
    add up to; rare: filter of counts and sums of the other words; pairs: filter of pairs; spare: what a pair held
    wrongly may add to a sum; total, distinct: of all training tokens; piece, pieces: which pairs the filter has."""

    def __init__(self, words, counts, held, rare, pairs, spare, total, distinct, piece=0, pieces=1):
        self.words, self.counts, self.held, self.rare, self.pairs = words, counts, held, rare, pairs
        self.spare, self.total, self.distinct, self.piece, self.pieces = spare, total, distinct, piece, pieces
        self._find = None

    def __getstate__(self):
        return self.__dict__ | {"_find": None}

    def find(self, token: np.ndarray) -> np.ndarray:
        if self._find is None:
            self._find = T.Lookup(self.words)
        return self._find(token)

    def base(self, count):
        return (count + 0.5) / (self.total + 0.5 * (self.distinct + 1))

    def known(self, token: np.ndarray, at: np.ndarray):
        """(a lower and an upper bound of the count, an upper bound of what its pairs add up to) of each token."""
        place = np.maximum(at, 0)
        low = self.counts[place].astype(np.float64)
        high, held = low.copy(), self.held[place].astype(np.float64)
        some = np.flatnonzero(at < 0)
        if len(some):
            word, back = np.unique(token[some], return_inverse=True)
            level = self.rare.level(word)
            low[some] = level_count(level, 1)[back]
            high[some] = (2.0**level - 1)[back]
            held[some] = (2.0 ** self.rare.level(_held_key(word)) - 1)[back]
        return low, high, held

    def log10(self, key, low, high, held) -> np.ndarray:
        """Log10 of the probability of tokens, where this piece holds their pairs, 0 elsewhere.

        key: of the pairs; low: of the tokens; high, held: of their histories.
        """
        mine = np.flatnonzero((key & np.uint64(0xFFFF)) * np.uint64(self.pieces) >> np.uint64(16) == self.piece)
        low, high, held = low[mine], high[mine], held[mine]
        weight = WEIGHT * np.minimum(1.0, held / np.maximum(high, 1.0))
        count = np.zeros(len(mine))
        some = np.flatnonzero(held > 0)
        count[some] = level_count(self.pairs.level(key[mine[some]]), LEAST)
        out = np.zeros(len(key))
        out[mine] = np.log10(weight * count / (np.maximum(held, 1.0) + self.spare) + (1 - weight) * self.base(low))
        return out


def _summed(parts):
    """(key, other, n) arrays, added up by key until HOLD keys are held."""
    held, size = [], 0

    def flush():
        key, other, n = (np.concatenate([p[i] for p in held]) for i in range(3))
        key, where, at = np.unique(key, return_index=True, return_inverse=True)
        return key, other[where], np.bincount(at, n, len(key)).astype(np.int64)

    for part in parts:
        held.append(part)
        size += len(part[0])
        if size > 2 * HOLD:
            held = [flush()]
            size = len(held[0][0])
            if size > HOLD:
                yield held[0]
                held, size = [], 0
    if held:
        yield flush()


def _word_counts(rows: DataFrame) -> DataFrame:
    """(key, n) of every training token."""

    def parts(batches):
        for piece in T.slices(batches, "text"):
            key, n = np.unique(_tokens(piece.column(0))[0], return_counts=True)
            yield key, key, n

    def run(batches):
        for key, _, n in _summed(parts(batches)):
            yield pa.RecordBatch.from_arrays([pa.array(key.view(np.int64)), pa.array(n)], ["key", "n"])

    return rows.where("train").select("text").mapInArrow(run, "key long, n long").groupBy("key").agg(F.sum("n").alias("n"))


def _pair_counts(rows: DataFrame) -> DataFrame:
    """(key, history, n) of the training pairs that occur LEAST times."""

    def parts(batches):
        for piece in T.slices(batches, "text"):
            token, first = _tokens(piece.column(0))
            history = _histories(token, first)
            key, where, n = np.unique(pair_keys(history, token), return_index=True, return_counts=True)
            yield key, history[where], n

    def run(batches):
        for key, history, n in _summed(parts(batches)):
            yield pa.RecordBatch.from_arrays([pa.array(key.view(np.int64)), pa.array(history.view(np.int64)), pa.array(n)], ["key", "history", "n"])

    counted = rows.where("train").select("text").mapInArrow(run, "key long, history long, n long")
    return counted.groupBy("key", "history").agg(F.sum("n").alias("n")).where(F.col("n") >= LEAST)


def _rare_words(rows: DataFrame, words: np.ndarray) -> DataFrame:
    """(key, doc, n) of the words of each text that are not among words; n is negative outside training."""
    shared = rows.sparkSession.sparkContext.broadcast(words)

    def run(batches):
        find = T.Lookup(shared.value)
        for piece in T.slices(batches):
            token, first = _tokens(piece.column(1))
            rare = np.flatnonzero(find(token) < 0)
            row = np.repeat(np.arange(len(first) - 1), np.diff(first))[rare]
            order = np.lexsort((token[rare], row))
            key, row = token[rare][order], row[order]
            new = np.ones(len(key), bool)
            new[1:] = (key[1:] != key[:-1]) | (row[1:] != row[:-1])
            begin = np.flatnonzero(new)
            n = np.diff(np.append(begin, len(key)))
            sign = np.where(piece.column(2).to_numpy(zero_copy_only=False).astype(bool), 1, -1)
            columns = [pa.array(key[begin].view(np.int64)), pa.array(piece.column(0).to_numpy()[row[begin]]), pa.array(n * sign[row[begin]])]
            yield pa.RecordBatch.from_arrays(columns, ["key", "doc", "n"])

    return rows.select("key", "text", "train").mapInArrow(run, "key long, doc long, n long")


def _rare_sums(counted: DataFrame, scratch: Scratch) -> DataFrame:
    """(doc, part, known): per text the sum of n * log10(c + 0.5) over its rare words, and how many are known.

    A rare word has at most a FREQUENTth of all tokens, so that no task gathers a hot one.
    """

    def run(batches):
        parts = [b for b in batches if b.num_rows]
        if not parts:
            return
        key, doc, n = (np.concatenate([p.column(i).to_numpy() for p in parts]) for i in range(3))
        del parts
        order = np.argsort(key, kind="stable")
        key, doc, n = key[order], doc[order], n[order]
        begin = np.flatnonzero(np.concatenate(([True], key[1:] != key[:-1])))
        count = np.add.reduceat(np.maximum(n, 0), begin)
        c = np.repeat(count, np.diff(np.append(begin, len(key))))
        n = np.abs(n)
        docs, at = np.unique(doc, return_inverse=True)
        part = np.bincount(at, n * np.log10(c + 0.5), len(docs))
        known = np.bincount(at, n * (c > 0), len(docs)).astype(np.int64)
        yield pa.RecordBatch.from_arrays([pa.array(docs), pa.array(part), pa.array(known)], ["doc", "part", "known"])

    rows = scratch.write(counted)
    number = max(1, -(-rows.count() // 500_000), int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    sums = rows.repartition(number, "key").mapInArrow(run, "doc long, part double, known long")
    return scratch.write(sums.groupBy("doc").agg(F.sum("part").alias("part"), F.sum("known").alias("known")))


def _log2(n):
    """The place of the highest binary digit of a column of longs."""
    return (F.length(F.bin(n)) - 1).cast("int")


def _sizes(levels: DataFrame) -> tuple[int, int, int]:
    """(keys, levels beyond the first, highest level) of (key, level)."""
    r = levels.agg(F.count(F.lit(1)).alias("n"), F.sum(F.col("level") - 1).alias("later"), F.max("level").alias("top")).first()
    return int(r["n"]), int(r["later"] or 0), int(r["top"] or 0)


def train(rows: DataFrame, scratch: Scratch, frequent: int = FREQUENT, piece: int = PIECE) -> list[Model]:
    """The model of the training rows of (key, text, train), as one for each piece of the pairs."""
    context = rows.sparkSession.sparkContext
    words = scratch.write(_word_counts(rows))
    sums = words.agg(F.sum("n").alias("n"), F.count(F.lit(1)).alias("v")).first()
    total, distinct = int(sums["n"] or 0), int(sums["v"])
    pairs = scratch.write(_pair_counts(rows))
    leveled = pairs.select("key", _log2("n").alias("level"), "history")  # as LEAST is 2
    number, later, top = _sizes(leveled)
    first = int(distinct).bit_length() + SURE
    chunks = bloom.LevelBloom.chunks_for(number, later, first)
    pieces = -(-chunks // piece)
    chunks = -(-chunks // pieces)
    # the same number as in Model.log10
    place = F.shiftright(F.col("key").bitwiseAND(F.lit(0xFFFF)) * pieces, 16)
    filters, held = [], None
    for k in range(pieces):
        own = leveled.where(place == k)
        filters.append(bloom.build(own.select("key", "level"), chunks, first, top=top))
        shared = context.broadcast(filters[-1])

        def returned(batches, shared=shared):
            for b in batches:
                count = level_count(shared.value.level(b.column(0).to_numpy().view(np.uint64)), LEAST)
                yield pa.RecordBatch.from_arrays([b.column(1), pa.array(count.astype(np.int64))], ["history", "held"])

        part = scratch.write(own.select("key", "history").mapInArrow(returned, "history long, held long").groupBy("history").agg(F.sum("held").alias("held")))
        shared.unpersist()
        held = part if held is None else held.unionByName(part)
    held = held.groupBy("history").agg(F.sum("held").alias("held"))
    known = scratch.write(words.join(held, F.col("key") == F.col("history"), "left").select("key", "n", F.coalesce("held", F.lit(0)).alias("held")))
    table = known.where(F.col("key") != int(END)).orderBy(F.desc("n"), "key").limit(frequent - 1).toArrow()
    end = known.where(F.col("key") == int(END)).first() or {"n": 0, "held": 0}
    hashes = np.concatenate(([END], table.column("key").to_numpy().view(np.uint64)))
    counts = np.concatenate(([end["n"]], table.column("n").to_numpy())).astype(np.int64)
    mass = np.concatenate(([end["held"]], table.column("held").to_numpy())).astype(np.int64)
    rest = known.where(F.col("key") != int(END))
    if table.num_rows:
        least, last = int(counts[-1]), int(hashes[-1:].view(np.int64)[0])
        rest = rest.where((F.col("n") < least) | ((F.col("n") == least) & (F.col("key") > last)))

    def entries(batches):
        for b in batches:
            key, n, sum_ = (b.column(i).to_numpy() for i in range(3))
            key, some = key.view(np.uint64), sum_ > 0
            key = np.concatenate((key, _held_key(key[some])))
            level = level_of(np.concatenate((n, sum_[some])), 1)
            yield pa.RecordBatch.from_arrays([pa.array(key.view(np.int64)), pa.array(level.astype(np.int32))], ["key", "level"])

    rest = scratch.write(rest.mapInArrow(entries, "key long, level int"))
    number, later, high = _sizes(rest)
    rare = bloom.build(rest, bloom.LevelBloom.chunks_for(number, later, WORD_PROBES), WORD_PROBES, top=high)
    spare = float(LEAST)
    return [Model(hashes, counts, mass, rare, f, spare, total, distinct, k, pieces) for k, f in enumerate(filters)]


def language_model_scores(docs: DataFrame, frequent: int = FREQUENT, piece: int = PIECE, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score for every row of docs.

    Tokens: words with A-Z lowered, then one that closes the text; a null text is empty.  Learns from rows whose
    crc32 of the id (null: of '') mod 5 is not 1.  base_score and counts are exact; score is the model's log10
    probability.  Repeated rows count and are scored each; without training rows every token is unseen.
    Other columns are ignored; no rows give no rows.
    """
    ship(docs.sparkSession)
    scratch = Scratch(docs.sparkSession, "lm")
    text, held = F.coalesce(F.col(text_col), F.lit("")), remainder(F.col(id_col), FOLDS) == HELD
    # rows alike in id and text share a key, and so what is gathered under it
    rows = docs.select(F.xxhash64(F.col(id_col), text).alias("key"), text.alias("text"), (~held).alias("train"), F.col(id_col).cast("long").alias("doc_id"))
    models = train(rows, scratch, frequent, piece)
    model = models[0]
    rare = _rare_sums(_rare_words(rows, model.words), scratch)

    def pass_over(model: Model):
        shared = docs.sparkSession.sparkContext.broadcast(model)

        def run(batches):
            m = shared.value
            logs = np.log10(m.counts + 0.5)
            for piece in T.slices(batches):
                token, first = _tokens(piece.column(1))
                at = m.find(token)
                there = at >= 0
                part, known = np.zeros(len(at)), np.zeros(len(at), np.int64)
                part[there] = logs[at[there]]
                known[there] = m.counts[at[there]] > 0
                low, high, held = m.known(token, at)
                before = np.arange(len(at)) - 1
                heads = first[:-1]
                high, held = high[before], held[before]
                high[heads], held[heads] = m.counts[0], m.held[0]
                score = m.log10(pair_keys(_histories(token, first), token), low, high, held)
                each = [pa.array(np.add.reduceat(x, heads)) for x in (part, known, score)]
                out = [piece.column(0), piece.column(3), piece.column(2), pa.array(np.diff(first)), *each]
                yield pa.RecordBatch.from_arrays(out, ["key", "doc_id", "train", "n_tokens", "part0", "known0", "score"])

        return rows.mapInArrow(run, "key long, doc_id long, train boolean, n_tokens long, part0 double, known0 long, score double")

    # rows of one key are alike, and so are their sums; a further piece adds the tokens whose pairs it holds
    scored = pass_over(model)
    for m in models[1:]:
        scored = scored.unionByName(pass_over(m))
    times = (F.count(F.lit(1)) / len(models)).cast("long")
    scored = scored.groupBy("key", "doc_id").agg(*[F.max(c).alias(c) for c in ("train", "n_tokens", "part0", "known0")], (F.sum("score") / times).alias("score"), times.alias("times"))
    out = scored.join(rare.withColumnRenamed("doc", "__doc"), F.col("key") == F.col("__doc"), "left")
    base = F.col("part0") + F.coalesce(F.col("part") / F.col("times"), F.lit(0.0)) - F.col("n_tokens") * float(np.log10(max(model.total + 0.5 * (model.distinct + 1), 0.5)))
    known = F.col("known0") + F.coalesce((F.col("known") / F.col("times")).cast("long"), F.lit(0))
    out = out.select("doc_id", (~F.col("train")).alias("held_out"), "n_tokens", known.alias("n_known"), F.lit(model.total).cast("long").alias("train_tokens"), base.alias("base_score"), "score", "times")
    out = out.withColumn("__copy", F.explode(F.sequence(F.lit(1), F.col("times").cast("int"))))
    return out.drop("times", "__copy")
