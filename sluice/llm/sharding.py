"""Sharding by balanced label propagation, in DataFrame functions only.

Documents with equal texts are linked.  Linked documents start in arbitrary shards; in each round a group votes, and
its members wish to move to the shard that holds most of them; in every second round, to the one with room that holds
most of them, if it holds more than theirs.  How many may move from shard to shard follows from the
wishes and quotas: what leaves a shard makes room in the same round, so shards swap members where all are full.  Members
move singly, and a group that is nearly together goes first.  Rounds end when no link is cut or none that is cut can
be mended.  Documents without links fill what is left, so row counts differ by at most one.  A group of more than half
a quota is first cut into chunks, which move on their own.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from sluice.llm.common import Scratch, buckets_for, exact_rank, seeded

#: Rounds at most, and rounds that may pass without more whole links; votes that tie are drawn anew in each.
ROUNDS, STALE, EARLY = 16, 2, 4


def _literal(values: list[int]):
    return F.expr("array(" + ", ".join(f"{int(v)}L" for v in values) + ")")


def _running(df: DataFrame, key: str, bucket: str, order: list[str], weight: str, out: str) -> DataFrame:
    """Adds the sum of weight over all rows of key up to this one, in the order of (bucket, order)."""
    sums = df.groupBy(key, bucket).agg(F.sum(weight).alias("__sum"))
    before = Window.partitionBy(key).orderBy(bucket).rowsBetween(Window.unboundedPreceding, -1)
    sums = sums.select(F.col(key).alias("__k"), F.col(bucket).alias("__b"), F.coalesce(F.sum("__sum").over(before), F.lit(0)).alias("__off"))
    inside = Window.partitionBy(key, bucket).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    rows = df.withColumn("__run", F.sum(weight).over(inside))
    return rows.join(sums, (rows[key] == F.col("__k")) & (rows[bucket] == F.col("__b"))).select(*df.columns, (F.col("__run") + F.col("__off")).alias(out))


def flows(wish: np.ndarray, load: np.ndarray, quota: np.ndarray) -> np.ndarray:
    """How many members may move from shard to shard: at most wish, and no shard ends above its quota.

    Starts from all wishes and cuts what flows into a shard that would be too full, which leaves others with more, until
    all fit; then what was cut too much is given back by single steps.
    """
    flow = wish.astype(np.int64).copy()
    np.fill_diagonal(flow, 0)
    while True:
        over = load + flow.sum(0) - flow.sum(1) - quota
        t = int(np.argmax(over))
        if over[t] <= 0:
            break
        into, column = int(flow[:, t].sum()), flow[:, t]
        if not into:
            raise ValueError("a shard holds more than its quota")
        # in proportion, and single members by the largest remainders
        left = max(0, into - int(over[t]))
        kept, rest = np.divmod(column * left, into)
        kept[np.argsort(-rest, kind="stable")[: left - int(kept.sum())]] += 1
        flow[:, t] = kept
    while True:
        room = quota - load - flow.sum(0) + flow.sum(1)
        more = np.minimum(wish - flow, room[None, :])
        np.fill_diagonal(more, 0)
        if more.max(initial=0) <= 0:
            return flow
        s, t = np.unravel_index(int(np.argmax(more)), more.shape)
        flow[s, t] += more[s, t]


def balanced_shards(docs: DataFrame, shards: int = 40, rounds: int = ROUNDS, seed: int = 11, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, size, text_crc32, law ('rows'), shard, slot, grown_shard (null) for every row of docs.

    size: UTF-8 bytes of the text plus 16; a null text counts as empty.  Counts of the shards differ by at most one;
    slots are gapless from 0.  Equal texts share a shard where quotas allow.  Repeated rows are rows like others;
    null ids are allowed; other columns are ignored; no rows give no rows.  Only the counts of the shards reach the driver.
    """
    scratch = Scratch(docs.sparkSession, "shards")
    text = F.coalesce(F.col(text_col), F.lit(""))
    base = docs.select(F.col(id_col).alias("doc_id"), (F.octet_length(text).cast("long") + 16).alias("size"), F.crc32(text).alias("text_crc32"), F.xxhash64(text).alias("h"))
    base = scratch.write(base)
    total = base.count()
    quota = [total // shards + (s < total % shards) for s in range(shards)]
    chunk = max(1, quota[-1] // 2)

    groups = scratch.write(base.groupBy("h", "size").agg(F.count(F.lit(1)).alias("n")).where("n > 1"))
    joined = base.join(groups, ["h", "size"], "left")
    part = F.pmod(seeded(seed, "doc_id"), F.ceil(F.col("n") / F.lit(chunk)).cast("long"))
    spread = F.pmod(seeded(seed + 1, "doc_id", "h"), F.lit(buckets_for(total)))
    rows = scratch.write(joined.select("doc_id", "size", "text_crc32", "h", F.when(F.col("n").isNotNull(), F.xxhash64("h", "size", part)).alias("g"), spread.alias("bucket")))

    linked = rows.where("g is not null")
    start = exact_rank(linked, [], "bucket", ["doc_id", "h"], "r")
    state = scratch.write(start.select(*rows.columns, F.pmod("r", F.lit(shards)).cast("int").alias("shard")))
    best, stale = -1, 0
    for turn in range(rounds):
        votes = scratch.write(state.groupBy("g", "shard").agg(F.count(F.lit(1)).alias("c")))
        load, wish = np.zeros(shards, np.int64), np.zeros((shards, shards), np.int64)
        whole = 0  # links within shards, twice over
        for r in votes.groupBy("shard").agg(F.sum("c").alias("c"), F.sum(F.col("c") * F.col("c")).alias("links")).collect():  # a row for each shard
            load[r["shard"]], whole = r["c"], whole + r["links"]
        stale, best = (0, whole) if whole > best else (stale + 1, best)
        tie = seeded(seed + turn, "g", "shard")
        open_ = F.element_at(_literal((np.array(quota) > load).astype(int).tolist()), F.col("shard") + 1) == 1 if turn % 2 and (np.array(quota) > load).any() else F.lit(True)
        to = votes.groupBy("g").agg(F.max(F.when(open_, F.struct("c", tie.alias("tie"), "shard"))).alias("to"), F.sum("c").alias("n"))
        to = to.select("g", "to", (F.col("n") - F.col("to.c")).alias("apart")).where("apart > 0")
        wishes = votes.join(to, "g").where(F.struct("c", tie.alias("tie"), "shard") < F.col("to"))
        wishes = wishes.select("g", "shard", F.col("to.shard").alias("target"), "c", "apart", F.pmod(seeded(seed, "g"), F.lit(256)).alias("lot"))
        wishes = scratch.write(wishes.withColumn("way", F.col("shard") * shards + F.col("target")))
        for r in wishes.groupBy("shard", "target").agg(F.sum("c").alias("c")).collect():  # shards squared
            wish[r["shard"], r["target"]] = r["c"]
        flow = flows(wish, load, np.array(quota))
        if stale > STALE or not wish.any() and turn % 2 == 0:
            scratch.drop(votes, wishes)
            break
        # of the members on one way the first flow go: in early rounds those of large groups, then of groups that miss few
        allowed = F.element_at(_literal(flow.reshape(-1).tolist()), F.col("way") + 1)
        far = F.least(F.col("apart"), F.lit(255))
        ordered = wishes.withColumn("lot", (255 - far if turn < EARLY else far) * 256 + F.col("lot"))
        moves = _running(ordered, "way", "lot", ["apart", "g"], "c", "sum")
        go = F.greatest(F.lit(0), F.least(F.col("c"), allowed - F.col("sum") + F.col("c")))
        moves = scratch.write(moves.select("g", "shard", "target", "c", go.cast("long").alias("go")).where("go > 0"))
        met = state.join(moves, ["g", "shard"], "left")
        target = F.when(F.col("go") == F.col("c"), F.col("target")).otherwise(F.col("shard")).alias("shard")
        halves = moves.where("go < c").limit(1).count()
        new = met.where("go is null or go = c").select(*rows.columns, target) if halves else met.select(*rows.columns, target)
        if halves:
            # one group at most on each way goes in part
            some = scratch.write(met.where("go < c").select(*rows.columns, "shard", "target", "go"))
            some = exact_rank(some, ["g", "shard"], "bucket", ["doc_id", "h"], "r")
            new = new.unionByName(some.select(*rows.columns, F.when(F.col("r") < F.col("go"), F.col("target")).otherwise(F.col("shard")).alias("shard")))
        new = scratch.write(new)
        scratch.drop(state, votes, wishes, moves)
        state = new

    load = {r["shard"]: r["c"] for r in state.groupBy("shard").agg(F.count(F.lit(1)).alias("c")).collect()}
    left, sums = 0, []
    for s, q in enumerate(quota):
        left += q - load.get(s, 0)
        sums.append(left)
    alone = exact_rank(rows.where("g is null"), [], "bucket", ["doc_id", "h"], "r")
    ends = _literal(sums)
    alone = alone.select(*rows.columns, F.size(F.filter(ends, lambda e: e <= F.col("r"))).cast("int").alias("shard"))
    placed = scratch.write(state.unionByName(alone).select("doc_id", "size", "text_crc32", "h", "shard", F.pmod(seeded(seed + 2, "doc_id"), F.lit(buckets_for(total // shards))).alias("bucket")))
    slotted = exact_rank(placed, ["shard"], "bucket", ["doc_id", "h"], "slot")
    return slotted.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))
