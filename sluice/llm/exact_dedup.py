"""Exact deduplication by two-pass Bloom filtering, in DataFrame functions only.

Pass 1 counts Bloom slots of every text hash and keeps the slots that were hit twice.  Pass 2 probes them: a row
with a slot that was hit once is unique and passes straight through; only the rest shuffle, grouped by hash.

The filter has at most MAX_BITS bits whatever the input, so it may be broadcast.  Over more rows than
MAX_BITS / BITS_PER_ROW false positives rise: more rows take the shuffle (as 80-byte fingerprints), none is lost.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sluice.llm.common import SPACE, Scratch, comparable, has_map, whole

BITS_PER_ROW = 16
MAX_BITS = 1 << 28


def normalised(text: Column) -> Column:
    """Null counts as empty; each run of white space becomes one space."""
    return F.regexp_replace(F.coalesce(text, F.lit("")), SPACE, " ")


def _slots(sha: str, bits: int) -> list[Column]:
    return [F.pmod(F.xxhash64(F.lit(k), F.col(sha)), F.lit(bits)) for k in (1, 2)]


def repeated_filter(prints: DataFrame, rows: int, sha: str = "text_sha256") -> tuple[DataFrame, int]:
    """Pass 1: (word, mask) of a Bloom filter with the slots that at least two rows hit; and its bits."""
    bits = 1 << 16
    while bits < min(MAX_BITS, rows * BITS_PER_ROW):
        bits <<= 1
    slots = prints.select(F.explode(F.array(*_slots(sha, bits))).alias("slot"))
    twice = slots.groupBy("slot").agg(F.count(F.lit(1)).alias("hits")).where("hits > 1")
    word = F.shiftright("slot", 6).alias("word")
    mask = F.expr("shiftleft(1L, cast(slot & 63 as int))").alias("mask")
    return twice.select(word, mask).groupBy("word").agg(F.bit_or("mask").alias("mask")), bits


def probe(prints: DataFrame, bloom: DataFrame, bits: int, sha: str = "text_sha256") -> DataFrame:
    """Pass 2: adds maybe, false only where no other row has the hash."""
    out = prints
    tests = []
    for k, slot in enumerate(_slots(sha, bits)):
        # at most MAX_BITS / 64 rows of two longs
        side = F.broadcast(bloom.select(F.col("word").alias(f"__w{k}"), F.col("mask").alias(f"__m{k}")))
        out = out.withColumn(f"__s{k}", slot).join(side, F.shiftright(f"__s{k}", 6) == F.col(f"__w{k}"), "left")
        tests.append(F.expr(f"coalesce(shiftright(__m{k}, cast(__s{k} & 63 as int)) & 1L, 0L) = 1L"))
    return out.select(*prints.columns, (tests[0] & tests[1]).alias("maybe"))


def exact_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, keep_id, group_size, kept, text_sha256 for every row of docs.

    Texts are equal when identical after each run of [\\x20\\x09-\\x0D] has become one space; null is empty.
    Of equal texts the smallest id stays.  Repeated rows count in group_size and share keep_id; a null id loses
    against any other and stays only in a group without ids.  Other columns are ignored; no rows give no rows.
    """
    scratch = Scratch(docs.sparkSession, "exact")
    prints = scratch.write(docs.select(F.col(id_col).alias("doc_id"), F.sha2(normalised(F.col(text_col)), 256).alias("text_sha256")))
    bloom, bits = repeated_filter(prints, prints.count())
    marked = probe(prints, scratch.write(bloom), bits)
    maybe = marked.where("maybe")
    groups = maybe.groupBy("text_sha256").agg(F.min("doc_id").alias("keep_id"), F.count(F.lit(1)).alias("group_size"))
    groups = scratch.write(groups)
    again = maybe.join(groups, "text_sha256").select("doc_id", "keep_id", "group_size", "text_sha256")
    alone = marked.where("not maybe").select("doc_id", F.col("doc_id").alias("keep_id"), F.lit(1).cast("long").alias("group_size"), "text_sha256")
    out = alone.unionByName(again)
    return out.select("doc_id", "keep_id", "group_size", F.col("doc_id").eqNullSafe(F.col("keep_id")).alias("kept"), "text_sha256")


def drop_exact_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of docs that stay, with all their columns: one for each distinct normalised text.

    Rows that the filter shows to be alone never shuffle.  Among the rest each task first keeps its least row of a
    text (id, then the other columns, those with maps as JSON; null ids last), so a hot group sends one row for each task.
    """
    scratch = Scratch(docs.sparkSession, "exact")
    keyed = docs.select(F.sha2(normalised(F.col(text_col)), 256).alias("text_sha256"), F.col(id_col).isNull().alias("__none"), F.col(id_col).alias("__id"), whole(docs), *([comparable(docs).alias("__order")] if has_map(docs) else []))
    prints = scratch.write(keyed.select("text_sha256"))
    bloom, bits = repeated_filter(prints, prints.count())
    marked = probe(keyed, scratch.write(bloom), bits)
    if has_map(docs):
        least = F.min_by("row", F.struct("__none", "__id", "__order"))
    else:
        least = F.min(F.struct("__none", "__id", "row"))["row"]
    first = marked.where("maybe").groupBy("text_sha256").agg(least.alias("row"))
    rows = marked.where("not maybe").select("row").unionByName(first.select("row"))
    return rows.select(*[F.col(f"row.`{c}`").alias(c) for c in docs.columns])
