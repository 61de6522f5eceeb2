"""Mixing sources to target weights by subset-sum budget fitting.

Per source the documents are counted by exact length.  Every document is taken as often as the target allows for
all; the budget that remains is fitted by a bounded knapsack over the length counts, and that many documents of each
length are then selected by a seeded order.  Only source totals reach the driver.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sluice.llm.common import SPACE, Scratch, comparable, exact_rank, seeded, ship, whole

WEIGHTS = (5, 2, 1)
SHARE = 1.5
MOST = 2
#: Words of budget that are left to the exact knapsack; what is above is taken in proportion and from the longest down.
EXACT = 4096
BUCKETS = 4096
#: The seeded order of documents of one source and length.
PLACE = ("bucket", "pick", "__id")
#: Sources and lengths whose cuts are broadcast (some 50 MB).
CUTS = 1 << 19


def word_count(text: Column) -> Column:
    """Number of [^\\x20\\x09-\\x0D]+ in text; null: 0."""
    one = F.trim(F.regexp_replace(F.coalesce(text, F.lit("")), SPACE, " "))
    gaps = F.octet_length(one) - F.octet_length(F.replace(one, F.lit(" "), F.lit("")))
    return F.when(one == "", F.lit(0)).otherwise(gaps + 1).cast("long")


def targets(sizes: list[int], weights: list[float], share: float = SHARE, most: float = MOST) -> list[float]:
    """Share of all sizes by weight; what exceeds most times a source's size goes to the others by weight."""
    out, budget = [0.0] * len(sizes), share * sum(sizes)
    open_ = set(range(len(sizes)))
    while open_:
        unit = budget / sum(weights[i] for i in open_)
        above = {i for i in open_ if unit * weights[i] > most * sizes[i]}
        if not above:
            for i in open_:
                out[i] = unit * weights[i]
            break
        for i in above:
            out[i] = float(most * sizes[i])
            budget -= out[i]
        open_ -= above
    return out


def fit(lengths: np.ndarray, counts: np.ndarray, budget: int, exact: int = EXACT) -> np.ndarray:
    """How many documents of each length to take, for a sum as near to budget as found.

    lengths: distinct, positive; counts: available.  The sum is exact whenever the last exact words can be reached.
    """
    take = np.zeros(len(lengths), np.int64)
    total = int((lengths * counts).sum())
    if budget <= 0 or not total:
        return take
    if budget >= total:
        return counts.copy()
    take += np.floor(counts * (max(0, budget - exact) / total)).astype(np.int64)
    rest = budget - int((take * lengths).sum())
    for i in np.argsort(-lengths):  # the longest first, until an exact fit is small enough
        if rest <= exact:
            break
        n = int(min(counts[i] - take[i], rest // lengths[i], -(-(rest - exact) // lengths[i])))
        take[i] += n
        rest -= n * int(lengths[i])
    top = min(rest, exact) + exact // 2
    came = np.full(top + 1, -1, np.int32)  # the item by which a sum was first reached
    reach = np.zeros(top + 1, bool)
    reach[0] = True
    items: list[tuple[int, int]] = []
    for i in np.argsort(lengths):
        left, part, length = int(counts[i] - take[i]), 1, int(lengths[i])
        if length > top:
            break
        left = min(left, top // length)
        while left > 0 and not (rest <= top and reach[rest]):
            n = min(part, left)
            left -= n
            part *= 2
            new = np.zeros_like(reach)
            new[n * length :] = reach[: top + 1 - n * length]
            new &= ~reach
            came[new] = len(items)
            reach |= new
            items.append((int(i), n))
    sums = np.flatnonzero(reach)
    best = int(sums[np.argmin(np.abs(sums - rest))])
    over = [i for i in range(len(lengths)) if counts[i] > take[i] and abs(int(lengths[i]) - rest) < abs(best - rest)]
    if over:
        take[min(over, key=lambda i: abs(int(lengths[i]) - rest))] += 1
        return take
    while best:
        i, n = items[came[best]]
        take[i] += n
        best -= n * int(lengths[i])
    return take


def _fit_source(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
    pdf = pdf.sort_values("size")
    real = pdf["size"].to_numpy() > 0
    pdf["take"] = 0
    pdf.loc[real, "take"] = fit(pdf["size"].to_numpy()[real], pdf["n"].to_numpy()[real], int(pdf["rest"].iloc[0]))
    return pdf[["source", "size", "take"]]


def _fits(rows: DataFrame, scratch: Scratch) -> tuple[DataFrame, DataFrame]:
    """(source, source_size, target, base, rest) of each source, and (source, size, take) of each length: of the
    documents of a length the first take in the seeded order get one copy more than base."""
    spark = rows.sparkSession
    by_source = rows.groupBy("source").agg(F.sum("size").alias("s")).collect()  # a row for each source
    by_source.sort(key=lambda r: (r["source"] is None, r["source"] or ""))
    sizes = [int(r["s"] or 0) for r in by_source]
    goal = targets(sizes, [WEIGHTS[i % len(WEIGHTS)] for i in range(len(sizes))])
    whole_times = [min(MOST, int(t // s)) if s else 0 for t, s in zip(goal, sizes)]
    rest = [round(t - n * s) for t, n, s in zip(goal, whole_times, sizes)]
    dim = [(r["source"], *x) for r, x in zip(by_source, zip(sizes, goal, whole_times, rest))]
    dim = spark.createDataFrame(dim, "source string, source_size long, target double, base long, rest long")
    dim = F.broadcast(dim)  # one row for each source, from the driver's list
    counts = rows.groupBy("source", "size").agg(F.count(F.lit(1)).alias("n"))
    counts = counts.join(dim, counts.source.eqNullSafe(dim.source)).select(counts.source, "size", "n", "rest")
    fits = scratch.write(counts.groupBy("source").applyInPandas(_fit_source, "source string, size long, take long"))
    return dim, fits


def _plan(rows: DataFrame, scratch: Scratch) -> DataFrame:
    """rows (source, size, __id, bucket, ...) with source_size, target, times (copies that the mix holds)."""
    dim, fits = _fits(rows, scratch)
    ranked = exact_rank(rows, ["source", "size"], "bucket", ["pick", "__id"], "r")
    f = fits.select(F.col("source").alias("__src"), F.col("size").alias("__size"), "take")
    out = ranked.join(f, ranked.source.eqNullSafe(f["__src"]) & (ranked["size"] == f["__size"]))
    out = out.join(dim.withColumnRenamed("source", "__dim"), F.col("source").eqNullSafe(F.col("__dim")))
    return out.select(*rows.columns, "source_size", "target", (F.col("base") + (F.col("r") < F.col("take")).cast("long")).alias("times"))


def _rows(docs: DataFrame, seed: int, id_col: str, text_col: str, source_col: str, *more: Column) -> DataFrame:
    pick = seeded(seed, F.col(id_col))
    return docs.select(F.col(id_col).alias("__id"), F.col(source_col).cast("string").alias("source"), word_count(F.col(text_col)).alias("size"), pick.alias("pick"), F.pmod(pick, F.lit(BUCKETS)).alias("bucket"), *more)


def mix_sources(docs: DataFrame, seed: int = 7, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """doc_id, size, source_size, target, taken for every row of docs.

    size: words of the text (null: 0).  taken: words that the mix holds of it, a multiple of size, at most twice.
    Sources in code-point order, null last as a source of its own, weigh 5, 2, 1, ...  Empty texts take nothing;
    repeated rows are rows like others; ties in the seeded order go by id.  Other columns are ignored; no rows give
    no rows.  Reruns agree, as the order is a hash of the id.
    """
    ship(docs.sparkSession)
    scratch = Scratch(docs.sparkSession, "mix")
    rows = scratch.write(_rows(docs, seed, id_col, text_col, source_col))
    out = _plan(rows, scratch)
    return out.select(F.col("__id").alias("doc_id"), "size", "source_size", "target", (F.col("size") * F.col("times")).alias("taken"))


def _cuts(rows: DataFrame, fits: DataFrame, few: bool) -> DataFrame:
    """(__src, __size, cut, k) for each length of which documents are taken: those before cut in the seeded order, and
    k of the rows that share its place and id; all where cut is null."""
    f = fits.where("take > 0").select(F.col("source").alias("__src"), F.col("size").alias("__size"), "take")
    ranked = exact_rank(rows, ["source", "size"], "bucket", ["pick", "__id"], "r")
    places = ranked.groupBy("source", "size", *PLACE).agg(F.min("r").alias("first"), F.count(F.lit(1)).alias("m"))
    known = F.broadcast(f) if few else f
    at = places.join(known, places.source.eqNullSafe(f["__src"]) & (places["size"] == f["__size"])).where("first <= take and take < first + m")
    at = at.select("source", "size", F.struct(*PLACE).alias("cut"), (F.col("take") - F.col("first")).alias("k"))
    return f.join(at, f["__src"].eqNullSafe(at.source) & (f["__size"] == at["size"]), "left").select("__src", "__size", "cut", F.coalesce("k", F.lit(0)).alias("k"))


def mixed_documents(docs: DataFrame, seed: int = 7, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """The rows of the mix with all columns of docs, as often as they are taken.

    Whole rows are only scanned: the place up to which documents of a source and length are taken travels to them.
    Beyond CUTS sources and lengths they take a shuffle.
    """
    ship(docs.sparkSession)
    scratch = Scratch(docs.sparkSession, "mix")
    rows = scratch.write(_rows(docs, seed, id_col, text_col, source_col))
    dim, fits = _fits(rows, scratch)
    few = fits.where("take > 0").count() <= CUTS
    cuts = scratch.write(_cuts(rows, fits, few))
    keyed = _rows(docs, seed, id_col, text_col, source_col, F.xxhash64(comparable(docs)).alias("__hash"), whole(docs))
    known = (F.broadcast(cuts) if few else cuts).withColumn("__held", F.lit(True))
    each = keyed.join(known, keyed.source.eqNullSafe(cuts["__src"]) & (keyed["size"] == cuts["__size"]), "left")
    each = each.join(dim.select(F.col("source").alias("__dim"), "base"), F.col("source").eqNullSafe(F.col("__dim")))
    place = F.struct(*PLACE)
    more = F.col("__held").isNotNull() & (F.col("cut").isNull() | F.coalesce(place < F.col("cut"), F.lit(False)))
    shared = F.coalesce((F.col("k") > 0) & (place == F.col("cut")), F.lit(False))
    if cuts.where("k > 0").limit(1).count():
        # of rows repeated with the id of a cut, the first get a copy more
        from pyspark.sql.window import Window

        order = Window.partitionBy("__id", "source", "size").orderBy("__hash")
        last = each.where(shared).withColumn("nth", F.row_number().over(order))
        out = each.where(~shared).select("row", (F.col("base") + more.cast("long")).alias("times"))
        out = out.unionByName(last.select("row", (F.col("base") + (F.col("nth") <= F.col("k")).cast("long")).alias("times")))
    else:
        out = each.select("row", (F.col("base") + more.cast("long")).alias("times"))
    out = out.where("times > 0").select("row", F.explode(F.sequence(F.lit(1), F.col("times").cast("int"))))
    return out.select(*[F.col(f"row.`{c}`").alias(c) for c in docs.columns])
