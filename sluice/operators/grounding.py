"""Grounding of responses in sources: sentences, claims, decisions and totals."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from sluice.functions import fixed as K
from sluice.functions.text import any_match, strip
from sluice.operators.vectors import dot

#: Decision thresholds.
GROUNDED, UNCERTAIN, CONTRADICTED, NEUTRAL, WEAK, FAITHFUL = 0.55, 0.3, 0.7, 0.65, 0.5, 0.5
#: Least length of what a response is checked by, and chunks that a model reads for each claim.
LEAST, CHUNKS = 20, 3
#: Pairs of claim and chunk from which a response is split into tiles, numbers of vectors on one side of a tile (32 MB),
#: and numbers of small responses that are searched in one group.
TILE, SIDE, GROUP = 1 << 18, 1 << 22, 1 << 20
#: The grounding of a blocked response; counts are 0.
SKIPPED = {"is_grounded": True, "faithfulness_score": 1.0, "has_contradiction": False}


def _parts(text: Column) -> Column:
    """Pieces between sentence ends and lines, without list marks."""
    pieces = F.split(text, r"(?U)(?<=[.!?])\s+|\n+", -1)
    clean = lambda p: F.regexp_replace(F.regexp_replace(strip(p), r"(?U)^[\-\*•]\s+", ""), r"(?U)^\d+[.)]\s+", "")
    return F.transform(pieces, clean)


def _letters(p: Column) -> Column:
    return F.length(F.regexp_replace(p, r"\P{L}", "")) / F.greatest(F.length(p), F.lit(1))


def sentences(text: Column, least: int = 10) -> Column:
    """Sentences of at least so many characters, without code; abbreviations and decimals do not end one."""
    plain = F.regexp_replace(F.coalesce(text, F.lit("")), K.CODE_BLOCK, "")
    plain = F.regexp_replace(plain, K.ABBREVIATIONS, "$1<DOT>")
    plain = F.regexp_replace(plain, r"(?U)(\d)\.(\d)", "$1<DOT>$2")
    parts = F.transform(F.split(plain, r"(?U)(?<=[.!?])\s+|\n+", -1), lambda p: strip(F.replace(p, F.lit("<DOT>"), F.lit("."))))
    parts = F.transform(parts, lambda p: F.regexp_replace(F.regexp_replace(p, r"(?U)^[\-\*•]\s+", ""), r"(?U)^\d+[.)]\s+", ""))
    return F.filter(parts, lambda p: (F.length(p) >= least) & ~p.rlike(K.INLINE_CODE) & ~p.rlike("(?U)" + K.CODE_LINE) & (_letters(p) >= 0.4))


def claims(text: Column, least: int = 25) -> Column:
    """Factual sentences; where there is none, all that are long enough."""
    plain = F.regexp_replace(F.coalesce(text, F.lit("")), K.CODE_BLOCK, "")
    pieces = F.transform(_parts(plain), lambda p: F.regexp_replace(F.regexp_replace(p, r"\*\*([^*]+)\*\*", "$1"), r"__([^_]+)__", "$1"))
    usable = lambda p: (F.length(p) >= least) & (_letters(p) >= 0.4)
    strict = F.filter(
        pieces,
        lambda p: usable(p) & ~p.rlike(K.INLINE_CODE) & ~p.rlike("(?U)" + K.CODE_LINE) & ~any_match(p, K.CLAIM_SKIP) & ~any_match(p, K.CLAIM_META) & any_match(p, K.CLAIM_FACTUAL),
    )
    loose = F.filter(_parts(plain), lambda p: usable(p) & ~p.rlike("(?U)" + K.CODE_LINE))
    return F.when(F.size(strict) > 0, strict).otherwise(loose)


def checkable(text: Column, least: int = LEAST) -> Column:
    """What a response is checked by: its claims, or its sentences where it has none."""
    found = claims(text, least)
    return F.when(F.size(found) > 0, found).otherwise(sentences(text, least))


def speed_verdict(similarity: Column) -> Column:
    return F.when(similarity >= GROUNDED, "grounded").when(similarity >= UNCERTAIN, "uncertain").otherwise("ungrounded")


def nli_verdict(entail: Column, contra: Column, neutral: Column, similarity: Column) -> Column:
    """The decision of an entailment model's three probabilities and the similarity of claim and chunk."""
    by_similarity = F.when(similarity >= NEUTRAL, "grounded").when(similarity >= WEAK, "uncertain").otherwise("ungrounded")
    return (
        F.when(entail >= GROUNDED, "grounded")
        .when(contra >= CONTRADICTED, "contradicted")
        .when((neutral > entail) & (neutral > contra), by_similarity)
        .when(entail >= UNCERTAIN, "uncertain")
        .otherwise("ungrounded")
    )


def _search():
    """The function that finds the best chunk of each claim in a group of tiles.  It travels by value: executors need
    no package.

    A product of matrices leaves for each claim the chunks within rounding of its highest similarity; those are summed
    again in the order of dot(), so scores and ties are the same as there.
    """
    import numpy as np
    import pyarrow as pa
    import pyarrow.compute as pc

    ROWS, COLUMNS = 512, 4096

    def numbers(vec):
        """(length of each vector, -1: null or with a null inside; offset of each in the numbers; the numbers)."""
        flat = vec.flatten()
        size = pc.fill_null(pc.list_value_length(vec), 0).to_numpy(zero_copy_only=False).astype(np.int64)
        at = np.cumsum(size) - size
        gone = vec.is_null().to_numpy(zero_copy_only=False).copy()
        if flat.null_count:
            owner = np.repeat(np.arange(len(size)), size)
            gone[owner[flat.is_null().to_numpy(zero_copy_only=False)]] = True
        return np.where(gone, -1, size), at, pc.fill_null(flat, 0.0).to_numpy(zero_copy_only=False)

    def in_order(a, b, i, j):
        """dot() of the columns i of a and j of b."""
        total = np.zeros(np.broadcast(i, j).shape)
        with np.errstate(all="ignore"):
            for x, y in zip(a, b):
                total += x[i] * y[j]
        return total

    def better(score, at, new, new_at):
        """Takes over what is higher, or first among equals; NaN is highest."""
        nan, old_nan = np.isnan(new), np.isnan(score)
        take = (at < 0) | (nan & ~old_nan) | (new > score) | (((new == score) | (nan & old_nan)) & (new_at < at))
        score[take], at[take] = new[take], new_at[take]

    def best(a, b):
        """(score, place) of the best row of b for each row of a; of equals the first."""
        score, at = np.zeros(len(a)), np.full(len(a), -1)
        first = np.arange(len(b))
        if b.shape[1]:
            first = np.sort(np.unique(np.ascontiguousarray(b).view(f"V{8 * b.shape[1]}").ravel(), return_index=True)[1])
        b = b[first]
        plain = lambda x: (np.abs(x) < 1e150).all(axis=1)
        pa_, pb = plain(a), plain(b)
        at_, bt = np.ascontiguousarray(a.T), np.ascontiguousarray(b.T)
        for rows, columns in ((np.flatnonzero(~pa_), np.arange(len(b))), (np.flatnonzero(pa_), np.flatnonzero(~pb))):
            for y in range(0, len(columns) if len(rows) else 0, ROWS):
                j = columns[y : y + ROWS]
                for x in range(0, len(rows), ROWS):
                    i = rows[x : x + ROWS]
                    full = in_order(at_, bt, i[:, None], j[None, :])
                    k = full.argmax(axis=1)
                    s, p = score[i], at[i]
                    better(s, p, full[np.arange(len(i)), k], first[j[k]])
                    score[i], at[i] = s, p
        rows, columns = np.flatnonzero(pa_), np.flatnonzero(pb)
        width = np.sqrt((a[rows] ** 2).sum(axis=1)) * 8 * (a.shape[1] + 2) * 2.0**-53
        for x in range(0, len(rows) if len(columns) else 0, ROWS):
            i = rows[x : x + ROWS]
            s, p, left = score[i], at[i], a[i]
            for y in range(0, len(columns), COLUMNS):
                j = columns[y : y + COLUMNS]
                near = left @ b[j].T
                slack = width[x : x + ROWS] * np.sqrt((b[j] ** 2).sum(axis=1).max()) + 1e-300
                least = near.max(axis=1) - slack
                least = np.where(p >= 0, np.fmax(least, s - slack), least)
                u, v = np.nonzero(near >= least[:, None])
                if len(u):
                    exact = np.concatenate([in_order(at_, bt, i[u[z : z + 65536]], j[v[z : z + 65536]]) for z in range(0, len(u), 65536)])
                    order = np.lexsort((v, -exact, u))
                    order = order[np.r_[True, np.diff(u[order]) > 0]]
                    u, v, exact = u[order], v[order], exact[order]
                    t, q = s[u], p[u]
                    better(t, q, exact, first[j[v]])
                    s[u], p[u] = t, q
            score[i], at[i] = s, p
        return score, at

    def search(claims: pa.Table, chunks: pa.Table) -> pa.Table:
        if not len(claims) or not len(chunks):
            return pa.table([claims["key"].slice(0, 0), claims["claim_ix"].slice(0, 0), pa.array([], pa.float64()), chunks["rank"].slice(0, 0), chunks["chunk"].slice(0, 0)], names=["key", "claim_ix", "score", "rank", "chunk"])
        keys = pa.chunked_array([*claims["key"].chunks, *chunks["key"].chunks]).combine_chunks().dictionary_encode().indices.to_numpy(zero_copy_only=False).astype(np.int64)
        tiles = np.stack([keys, *[np.concatenate([claims[c].to_numpy(), chunks[c].to_numpy()]) for c in ("a", "b")]])
        _, code = np.unique(tiles, axis=1, return_inverse=True)
        code = code.ravel()
        one = code[: len(claims)]
        # chunks of a tile lie in the order in which equals win
        order = pa.table([pa.array(code[len(claims) :]), chunks["rank"], chunks["chunk"]], names=["code", "rank", "chunk"])
        order = pc.sort_indices(order, sort_keys=[("code", "ascending"), ("rank", "descending"), ("chunk", "descending")], null_placement="at_end").to_numpy().astype(np.int64)
        two = code[len(claims) :][order]
        mine = np.argsort(one, kind="stable")
        vectors = [numbers(t["vec"].combine_chunks()) for t in (claims, chunks)]
        matrix = lambda side, rows, d: vectors[side][2][vectors[side][1][rows][:, None] + np.arange(d)[None, :]]
        who, score, null, chosen = [], [], [], []
        for c in np.intersect1d(one, two):
            left = mine[slice(*np.searchsorted(one[mine], [c, c + 1]))]
            right = order[slice(*np.searchsorted(two, [c, c + 1]))]
            found, at = np.zeros(len(left)), np.full(len(left), -1)
            for d in np.unique(vectors[0][0][left]):
                i, j = np.flatnonzero(vectors[0][0][left] == d), np.flatnonzero(vectors[1][0][right] == d)
                if d >= 0 and len(j):
                    found[i], k = best(matrix(0, left[i], d), matrix(1, right[j], d))
                    at[i] = j[k]
            who.append(left)
            score.append(found)
            null.append(at < 0)
            chosen.append(right[np.maximum(at, 0)])
        who, chosen = (pa.array(np.concatenate([np.zeros(0, np.int64), *x])) for x in (who, chosen))
        score = pa.array(np.concatenate([np.zeros(0), *score]), mask=np.concatenate([np.zeros(0, bool), *null]), from_pandas=False)
        return pa.table([claims["key"].take(who), claims["claim_ix"].take(who), score, chunks["rank"].take(chosen), chunks["chunk"].take(chosen)], names=["key", "claim_ix", "score", "rank", "chunk"])

    return search


def _tiled(left: DataFrame, right: DataFrame) -> tuple[DataFrame, DataFrame]:
    """left and right (key, ix, vec, ...) with the tile (a, b) in which a row of one meets one of the other, and its
    group: a tile of a large key, or many small keys."""
    spark = left.sparkSession
    # vectors are not evaluated for the counts: the first ones tell how long they are
    width = max([1, *[r[0] or 0 for df in (left, right) for r in df.select(F.size("vec")).where(F.size("vec") > 0).take(1)]])
    keys = left.groupBy("key").agg(F.count(F.lit(1)).cast("double").alias("na"))
    keys = keys.join(right.groupBy("key").agg(F.count(F.lit(1)).cast("double").alias("nb")), "key").persist()  # a row for each key
    try:
        pairs, rows = keys.agg(F.sum(F.col("na") * F.col("nb")), F.sum(F.col("na") + F.col("nb"))).first()
        most, side = max(float(TILE), (pairs or 0.0) / (4 * spark.sparkContext.defaultParallelism)), max(1, SIDE // width)
        tiles = F.ceil(F.col("na") * F.col("nb") / most)
        a = F.greatest(F.round(F.sqrt(tiles * F.col("na") / F.col("nb"))), F.lit(1.0), F.ceil(F.col("na") / side)).cast("int")
        b = F.greatest(F.ceil(tiles / F.col("a")), F.ceil(F.col("nb") / side)).cast("int")
        large = keys.where((tiles > 1) | (F.col("na") > side) | (F.col("nb") > side)).withColumn("a", a).select("key", "a", b.alias("b"))
        large = spark.createDataFrame(large.collect(), large.schema)  # 4 for each core, and one for SIDE numbers, at most
    finally:
        keys.unpersist()
    groups = int(max((rows or 0.0) * width / GROUP, (pairs or 0.0) / most)) + 1
    large = F.broadcast(large.withColumnsRenamed({"key": "__key", "a": "__a", "b": "__b"}))

    def dealt(df, own, other):
        rows = df.join(large, F.col("key") == F.col("__key"), "left")
        mine = F.pmod(F.xxhash64("ix"), F.coalesce(f"__{own}", F.lit(1))).cast("int")
        rows = rows.withColumn(own, mine).withColumn(other, F.explode(F.sequence(F.lit(0), F.coalesce(f"__{other}", F.lit(1)) - 1)))
        tile = F.xxhash64("key", "a", "b")
        return rows.withColumn("group", F.when(F.col("__key").isNull(), F.pmod(tile, F.lit(groups))).otherwise(tile)).drop("__key", "__a", "__b")

    return dealt(left, "a", "b"), dealt(right, "b", "a")


def speed_check(claim_rows: DataFrame, chunks: DataFrame, key: str = "resp_id") -> DataFrame:
    """(key, claim_ix, score, matched_chunk, verdict) by the most similar chunk (vec, chunk_ix, chunk) of a response.

    A response meets only its own chunks, in tiles of its claims and chunks; no pair is written.  key and claim_ix:
    plain types.  Of equal scores the lowest chunk_ix wins; a vector that is null, of another length or with a null
    inside gives a null score, which any other one beats.
    """
    kind = claim_rows.schema[key].dataType
    common = claim_rows.select(key).union(chunks.select(key)).schema[key].dataType
    rows = lambda df, ix, *more: df.where(F.col(key).isNotNull()).select(F.col(key).cast(common).alias("key"), F.col(ix).alias("ix"), *more, F.col("vec").cast("array<double>").alias("vec"))
    left, right = _tiled(rows(claim_rows, "claim_ix"), rows(chunks, "chunk_ix", (-F.col("chunk_ix")).alias("rank"), F.substring("chunk", 1, 200).alias("chunk")))
    left, right = left.withColumnRenamed("ix", "claim_ix"), right.drop("ix")
    out = T.StructType([left.schema["key"], left.schema["claim_ix"], T.StructField("score", T.DoubleType()), right.schema["rank"], right.schema["chunk"]])
    out = T.StructType([T.StructField(f.name, f.dataType) for f in out])
    found = left.groupBy("group").cogroup(right.groupBy("group")).applyInArrow(_search(), out)
    best = found.groupBy("key", "claim_ix").agg(F.max(F.struct("score", "rank", "chunk")).alias("b"))
    return best.select(F.col("key").cast(kind).alias(key), "claim_ix", "b.score", F.col("b.chunk").alias("matched_chunk"), speed_verdict(F.col("b.score")).alias("verdict"))


def accuracy_check(claim_rows: DataFrame, chunks: DataFrame, model, top: int = CHUNKS, key: str = "resp_id") -> DataFrame:
    """(key, claim_ix, entailment, contradiction, neutral, nli_entailment, matched_chunk, verdict) of each claim.

    model: claim and chunk columns -> struct (entail, contra, neutral).  It reads the top most similar chunks of a claim;
    the chunk of the highest entailment counts, of equals the more similar one.  entailment is at least the similarity
    where that alone grounds a neutral claim; nli_entailment stays the model's.  claim_rows: key, claim_ix, claim, vec;
    a claim of a response without chunks gives no row.
    """
    pairs = claim_rows.join(chunks.select(key, "chunk_ix", "chunk", F.col("vec").alias("__c")), key)
    pairs = pairs.select(key, "claim_ix", "claim", "chunk_ix", "chunk", dot(F.col("vec"), F.col("__c")).alias("__s"))
    order = Window.partitionBy(key, "claim_ix").orderBy(F.desc("__s"), "chunk_ix")
    near = pairs.withColumn("__r", F.row_number().over(order)).where(F.col("__r") <= top)
    read = near.withColumn("__p", model(F.col("claim"), F.col("chunk")))
    e, c, n, s = F.col("__p.entail"), F.col("__p.contra"), F.col("__p.neutral"), F.col("__s")
    verdict = nli_verdict(e, c, n, s)
    by_similarity = (e < GROUNDED) & (verdict == "grounded")
    found = F.struct(e.alias("nli_entailment"), (-F.col("__r")).alias("rank"), F.when(by_similarity, F.greatest(e, s)).otherwise(e).alias("entailment"), c.alias("contradiction"), n.alias("neutral"), F.substring("chunk", 1, 200).alias("matched_chunk"), verdict.alias("verdict"))
    best = read.groupBy(key, "claim_ix").agg(F.max(found).alias("b"))
    return best.select(key, "claim_ix", "b.entailment", "b.contradiction", "b.neutral", "b.nli_entailment", "b.matched_chunk", "b.verdict")


def screen_grounded(screened: DataFrame, checked: DataFrame, mode: str = "accuracy", key: str = "resp_id") -> DataFrame:
    """screened with struct grounding: that of totals() and its mode; a blocked response counts as grounded, skipped.

    checked comes from the screened text of responses (screen.text); it may leave out blocked ones.
    """
    names = [x for x in checked.columns if x != key]
    types = dict(checked.dtypes)
    held = checked.select(F.col(key).alias("__key"), F.struct(*names, F.lit(mode).alias("mode")).alias("__g"))
    skipped = F.struct(*[F.lit(SKIPPED.get(x, 0)).cast(types[x]).alias(x) for x in names], F.lit("skipped").alias("mode"))
    rows = screened.join(held, F.col(key) == F.col("__key"), "left")
    return rows.select(*[screened[x] for x in screened.columns], F.when(F.col("screen.blocked"), skipped).otherwise(F.col("__g")).alias("grounding"))


def totals(verdicts: DataFrame, responses: DataFrame, key: str = "resp_id") -> DataFrame:
    """Counts and faithfulness by response; responses: key, has_sources.

    No claims: grounded with 1.0; no sources: ungrounded with 0.0.
    """
    count = lambda v: F.count_if(F.col("verdict") == v)
    sums = verdicts.groupBy(key).agg(F.count(F.lit(1)).alias("n"), *[count(v).alias(v) for v in ("grounded", "contradicted", "ungrounded", "uncertain")])
    rows = responses.join(sums, key, "left").fillna(0, ["n", "grounded", "contradicted", "ungrounded", "uncertain"])
    share = F.when(~F.col("has_sources"), F.lit(0.0)).when(F.col("n") == 0, F.lit(1.0)).otherwise(F.round(F.col("grounded") / F.col("n"), 4))
    return rows.select(
        key,
        ((share >= FAITHFUL) & (F.col("contradicted") == 0)).alias("is_grounded"),
        share.alias("faithfulness_score"),
        (F.col("contradicted") > 0).alias("has_contradiction"),
        F.col("n").alias("sentence_count"),
        F.col("grounded").alias("grounded_count"),
        F.col("contradicted").alias("contradicted_count"),
        F.col("ungrounded").alias("ungrounded_count"),
        F.col("uncertain").alias("uncertain_count"),
    )
