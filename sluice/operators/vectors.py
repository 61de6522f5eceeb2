"""Operators on embeddings: scope, routes, BM25, threshold fitting."""

from __future__ import annotations

import hashlib
import json

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from sluice.functions import fixed as K

#: Least similarity by the width of a scope.
WIDTHS = {"narrow": 0.40, "moderate": 0.30, "broad": 0.20, "fitted": 0.30}
K1, B = 1.5, 0.75


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


#: Numbers that a broadcast profile may hold (64 MB of doubles).
MOST = 1 << 23
#: The reasons of a scope check.
REASONS = {
    "none": "No scope restriction configured.",
    "free": "Greeting or short query - allowed by default.",
    "match": "Query matches topic '%s' (similarity=%.3f, threshold=%.2f).",
    "off": "Query is off-topic. Closest topic '%s' (similarity=%.3f) below threshold (%.2f).",
}


def l2(v: Column) -> Column:
    """The unit vector; a zero vector stays."""
    n = F.sqrt(dot(v, v))
    unit = F.transform(F.array(n), lambda m: F.transform(v, lambda x: x.cast("double") / m))[0]  # one norm for all elements
    return F.when(n > 0, unit).otherwise(F.transform(v, lambda x: x.cast("double")))


def mean_vector(df: DataFrame, keys: list[str], vector: str, out: str = "centroid") -> DataFrame:
    """The normalised mean of vectors by keys."""
    parts = df.select(*keys, F.posexplode(vector).alias("pos", "x")).groupBy(*keys, "pos").agg(F.avg(F.col("x").cast("double")).alias("x"))
    rows = parts.groupBy(*keys).agg(F.transform(F.array_sort(F.collect_list(F.struct("pos", "x"))), lambda s: s["x"]).alias("v"))
    return rows.select(*keys, l2(F.col("v")).alias(out))


def _packed(profile: DataFrame, *columns: str, most: int = MOST) -> DataFrame:
    """The rows of a profile as one sorted array __profile, for broadcast; their size is checked before they are gathered."""
    n = profile.agg(F.sum(F.size("centroid") + F.lit(8))).first()[0] or 0
    if n > most:
        raise ValueError(f"a profile of {n} numbers is more than {most}")
    return F.broadcast(profile.agg(F.array_sort(F.collect_list(F.struct(*columns))).alias("__profile")))


def _nearest(queries: DataFrame, topics: DataFrame, vector: str) -> DataFrame:
    """queries with struct __best (similarity, rank, topic), null without topics."""
    rows = _packed(topics, "ix", "topic", "centroid")
    each = F.transform("__profile", lambda t: F.struct(dot(F.col(vector), t["centroid"]).alias("similarity"), (-t["ix"]).alias("rank"), t["topic"].alias("topic")))
    return queries.join(rows, F.lit(True)).select(*[F.col(f"`{c}`") for c in queries.columns], F.array_max(each).alias("__best"))


def best_topic(queries: DataFrame, topics: DataFrame, key: str = "id", vector: str = "vec") -> DataFrame:
    """(key, topic, similarity): the nearest topic of each query; ties go to the lowest index (topics: ix, topic, centroid)."""
    return _nearest(queries, topics, vector).select(key, "__best.topic", "__best.similarity")


def scope_check(queries: DataFrame, topics: DataFrame, centroid: list[float], threshold: float = WIDTHS["moderate"], key: str = "id", text: str = "text", vector: str = "vec") -> DataFrame:
    """(key, allowed, distance, matched_topic, confidence, reason); greetings and texts under three characters pass,
    and so does everything where there are no topics.  A query without a vector is off topic."""
    whole = dot(F.col(vector), F.array(*[F.lit(float(x)) for x in centroid])) if centroid else F.lit(None).cast("double")
    rows = _nearest(queries, topics, vector).withColumn("__score", F.coalesce(F.greatest(whole, F.col("__best.similarity")), F.lit(0.0)))
    plain = F.lower(F.trim(F.coalesce(F.col(text), F.lit(""))))
    none = F.col("__best").isNull()
    free = none | plain.isin(K.GREETINGS) | (F.length(plain) < 3)
    score, topic, near = F.col("__score"), F.col("__best.topic"), F.coalesce("__best.similarity", F.lit(0.0))
    allowed = score >= threshold
    limit = F.lit(float(threshold))
    reason = (
        F.when(none, REASONS["none"])
        .when(free, REASONS["free"])
        .when(allowed, F.format_string(REASONS["match"], topic, near, limit))
        .otherwise(F.format_string(REASONS["off"], topic, near, limit))
    )
    return rows.select(
        key,
        (free | allowed).alias("allowed"),
        F.when(free, F.lit(0.0)).otherwise(F.round(1 - score, 4)).alias("distance"),
        F.when(~free & (near > 0.1), topic).alias("matched_topic"),
        F.when(free, F.lit(1.0)).otherwise(F.least(F.lit(1.0), F.greatest(F.lit(0.0), score))).alias("confidence"),
        reason.alias("reason"),
    )


def routes(queries: DataFrame, utterances: DataFrame, key: str = "id", vector: str = "vec") -> DataFrame:
    """(key, matched, route_name, action, similarity) by the most similar utterance of each route.

    utterances: route_ix, route_name, action, threshold, centroid.  Matched routes at or above their threshold; the
    highest similarity wins, the first of equals, and it must be above 0.
    """
    rows = _packed(utterances, "route_ix", "route_name", "action", "threshold", "centroid")
    scored = queries.join(rows, F.lit(True)).select(
        key,
        F.transform(
            "__profile",
            lambda u: F.struct(dot(F.col(vector), u["centroid"]).alias("similarity"), (-u["route_ix"]).alias("rank"), u["route_name"].alias("route_name"), u["action"].alias("action"), u["threshold"].alias("threshold")),
        ).alias("s"),
    )
    hit = F.array_max(F.filter("s", lambda s: (s["similarity"] >= s["threshold"]) & (s["similarity"] > 0)))
    out = scored.select(key, hit.alias("hit"), F.greatest(F.array_max("s")["similarity"], F.lit(0.0)).alias("raw"))
    return out.select(key, F.col("hit").isNotNull().alias("matched"), F.col("hit.route_name").alias("route_name"), F.col("hit.action").alias("action"), F.coalesce("hit.similarity", "raw").alias("similarity"))


def bm25(queries: DataFrame, corpus: DataFrame, query_id: str = "qid", doc_id: str = "did") -> DataFrame:
    """(query_id, doc_id, score) of documents that share a term; text split at white space, lower case.

    A term that a query repeats counts each time.  idf: ln((N - df + 0.5) / (df + 0.5) + 1).
    """
    terms = lambda df, k: df.select(F.col(k), F.explode(F.filter(F.split(F.lower("text"), r"(?U)\s+"), lambda t: t != "")).alias("term"))
    postings = terms(corpus, doc_id)
    tf = postings.groupBy(doc_id, "term").agg(F.count(F.lit(1)).alias("tf"))
    size = postings.groupBy(doc_id).agg(F.count(F.lit(1)).alias("len"))
    stats = corpus.join(size, doc_id, "left").agg(F.count(F.lit(1)).alias("n"), F.avg(F.coalesce("len", F.lit(0))).alias("avg"))
    idf = tf.groupBy("term").agg(F.count(F.lit(1)).alias("df"))
    q = terms(queries, query_id).groupBy(query_id, "term").agg(F.count(F.lit(1)).alias("qf"))
    rows = q.join(idf, "term").join(tf, "term").join(size, doc_id).join(F.broadcast(stats), F.lit(True))  # stats: one row
    weight = F.ln((F.col("n") - F.col("df") + 0.5) / (F.col("df") + 0.5) + 1)
    part = F.col("qf") * weight * F.col("tf") * (K1 + 1) / (F.col("tf") + K1 * (1 - B + B * F.col("len") / F.col("avg")))
    return rows.groupBy(query_id, doc_id).agg(F.sum(part).alias("score"))


def hybrid(dense: Column, sparse: Column, top: Column, alpha: float) -> Column:
    """(1 - alpha) of the dense similarity, at least 0, and alpha of the share of the best BM25 score."""
    if not 0 <= alpha <= 1:
        raise ValueError("alpha lies between 0 and 1")
    return (1 - alpha) * F.greatest(F.lit(0.0), dense) + alpha * F.when(top > 0, sparse / top).otherwise(0.0)


def fit_threshold(scored: DataFrame, rounds: int = 500, seed: int = 0) -> tuple[float, float]:
    """(threshold, F2) with the best F2 over random thresholds; scored: similarity, wanted (boolean).  The first best wins."""
    tries = np.random.default_rng(seed).uniform(0.05, 0.85, rounds)
    # sums for all tries from one pass: rows by how many tries lie at or below them
    order = np.sort(tries)
    at = F.size(F.filter(F.array(*[F.lit(float(x)) for x in order]), lambda t: t <= F.col("similarity")))
    rows = scored.groupBy(at.alias("at")).agg(F.count_if("wanted").alias("yes"), F.count_if(~F.col("wanted")).alias("no")).collect()  # rounds + 1 rows
    yes, no = np.zeros(rounds + 1), np.zeros(rounds + 1)
    for r in rows:
        yes[r["at"]], no[r["at"]] = r["yes"], r["no"]
    best = (0.0, -1.0)
    for t in tries:
        k = int(np.searchsorted(order, t, "right"))
        tp, fp, fn = yes[k:].sum(), no[k:].sum(), yes[:k].sum()
        f2 = 5 * tp / (5 * tp + 4 * fn + fp) if tp else 0.0
        if f2 > best[1]:
            best = (float(t), float(f2))
    return best


def config_hash(config: dict) -> str:
    return hashlib.sha256(json.dumps(config, sort_keys=True).encode()).hexdigest()


def top_k(pairs: DataFrame, key: str, score: str, k: int = 3, tie: str | None = None) -> DataFrame:
    """The k best rows of each key with their rank."""
    order = [F.desc(score), *([F.col(tie)] if tie else [])]
    return pairs.withColumn("rank", F.row_number().over(Window.partitionBy(key).orderBy(*order))).where(F.col("rank") <= k)
