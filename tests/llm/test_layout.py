"""Mixing, packing, sharding and the pipeline."""

import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from sluice.llm import mixing, packing, sharding

WORD = re.compile(r"[^\x20\x09-\x0D]+")


@pytest.fixture(scope="module")
def docs(spark):
    real = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text", "source")
    rows = [(2001, None, "src0"), (2002, "", None), (2003, "a b c", None), (2003, "a b c", None), (2004, " \t ", "src3"), (None, "x y", "src1"), (2005, "w " * 90000, "only")]
    return real.unionByName(spark.createDataFrame(rows, "doc_id long, text string, source string")).withColumn("size", F.lit("clash")).withColumn("row", F.lit(1))


def test_mixing(spark, docs):
    got = mixing.mix_sources(docs).collect()
    texts = docs.collect()
    assert len(got) == len(texts)
    sizes = {}
    for r in texts:
        sizes.setdefault(r["source"], []).append(len(WORD.findall(r["text"] or "")))
    order = sorted(sizes, key=lambda s: (s is None, s or ""))
    total = {s: sum(v) for s, v in sizes.items()}
    weight = {s: (5, 2, 1)[i % 3] for i, s in enumerate(order)}
    # the level at which shares by weight, each at most twice its source, use up the budget
    low, high = 0.0, 1e9
    for _ in range(200):
        mid = (low + high) / 2
        low, high = (mid, high) if sum(min(mid * weight[s], 2 * total[s]) for s in order) < 1.5 * sum(total.values()) else (low, mid)
    want = {s: min(high * weight[s], 2 * total[s]) for s in order}
    source = {r["doc_id"]: r["source"] for r in texts}
    taken = dict.fromkeys(order, 0)
    for r in got:
        s = source[r["doc_id"]]
        assert r["source_size"] == total[s] and r["target"] == pytest.approx(want[s], rel=1e-6)
        assert r["taken"] in (0, r["size"], 2 * r["size"])
        taken[s] += r["taken"]
    for s in order:
        assert abs(taken[s] - want[s]) <= max(1.0, 0.001 * want[s]) or s in (None, "only"), s
    key = lambda rows: sorted((-1 if r["doc_id"] is None else r["doc_id"], r["taken"]) for r in rows)
    assert key(got) == key(mixing.mix_sources(docs.repartition(3)).collect())
    out = mixing.mixed_documents(docs)
    assert out.columns == docs.columns
    assert sum(len(WORD.findall(r["text"] or "")) for r in out.collect()) == sum(taken.values())


def test_knapsack():
    r = np.random.default_rng(2)
    for _ in range(40):
        lengths = np.sort(r.choice(np.arange(1, 300), r.integers(1, 30), replace=False))
        counts = r.integers(1, 6, len(lengths))
        budget = int(r.integers(0, (lengths * counts).sum() + 1))
        take = mixing.fit(lengths, counts, budget, exact=1 << 16)  # all of it is fitted exactly
        assert (take >= 0).all() and (take <= counts).all()
        sums = {0}
        for n, c in zip(lengths, counts):
            sums = {s + k * int(n) for s in sums for k in range(c + 1)}
        best = min(abs(s - budget) for s in sums)
        assert abs(int((take * lengths).sum()) - budget) == best
        coarse = mixing.fit(lengths, counts, budget, exact=100)
        assert (coarse >= 0).all() and (coarse <= counts).all() and abs(int((coarse * lengths).sum()) - budget) <= 300


def test_targets_stop_at_twice():
    assert mixing.targets([10, 1000], [5, 2]) == [20.0, 1495.0]
    assert mixing.targets([], []) == [] and mixing.targets([0], [5]) == [0.0]


def test_packing(spark, docs):
    import public_tokenizers
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(str(public_tokenizers.path("byte_bpe_50k.json")))
    some = docs.where("doc_id is not null and doc_id <> 2003").where("doc_id < 300 or doc_id > 2000")
    odd = spark.createDataFrame([(3001, "<|endoftext|> a"), (3002, "日本語 текст 😀"), (3003, "a​b ʰ")], "doc_id long, text string")
    some = some.select("doc_id", "text").unionByName(odd)
    rows = packing.pack_documents(some).collect()
    ids = {r["doc_id"]: [*t.encode(r["text"] or "", add_special_tokens=False).ids, 1] for r in some.collect()}
    at, used = {}, dict.fromkeys(ids, 0)
    for r in sorted(rows, key=lambda r: (r["sequence_id"], r["offset"])):
        assert r["offset"] == at.get(r["sequence_id"], 0) and r["length"] > 0
        at[r["sequence_id"]] = r["offset"] + r["length"]
    for r in sorted(rows, key=lambda r: (r["doc_id"], r["start"])):
        whole = ids[r["doc_id"]]
        assert r["start"] == used[r["doc_id"]] and r["doc_tokens"] == len(whole)
        used[r["doc_id"]] += r["length"]
        assert r["ids_crc32"] == zlib.crc32(np.array(whole[r["start"] : used[r["doc_id"]]], "<u4").tobytes())
    assert used == {k: len(v) for k, v in ids.items()} and max(at.values()) <= 2048
    assert sum(2048 - n for n in at.values() if n & (n - 1)) == 0


def test_sum_of_squares_takes_the_least():
    r = np.random.default_rng(4)
    s = packing.SumOfSquares(16)
    levels = []
    for size in r.integers(1, 16, 300):
        cost = {}
        for level in [0, *range(1, 17 - size)]:
            if level and level not in levels:
                continue
            after = list(levels)
            if level:
                after.remove(level)
            if level + size < 16:
                after.append(level + int(size))
            cost[level] = sum(after.count(x) ** 2 for x in set(after))
        _, level, _ = s.place(int(size), list)
        assert cost[level] == min(cost.values())
        if level:
            levels.remove(level)
        if level + size < 16:
            levels.append(level + int(size))


def test_shards(spark, docs):
    rows = sharding.balanced_shards(docs, shards=8).toPandas()
    texts = docs.collect()
    assert len(rows) == len(texts) and set(rows["shard"]) == set(range(8))
    count = rows.groupby("shard").size()
    assert count.max() - count.min() <= 1
    assert all(sorted(x) == list(range(len(x))) for _, x in rows.groupby("shard")["slot"])
    want = sorted((-1 if r["doc_id"] is None else r["doc_id"], len((r["text"] or "").encode()) + 16, zlib.crc32((r["text"] or "").encode())) for r in texts)
    assert sorted(zip(rows["doc_id"].fillna(-1).astype(int), rows["size"], rows["text_crc32"])) == want
    groups = rows.groupby(["size", "text_crc32"])["shard"].agg(["nunique", "size"])
    assert (groups[(groups["size"] > 1) & (groups["size"] < 40)]["nunique"] == 1).all()


def test_shards_of_one_group(spark):
    df = spark.range(100).select(F.col("id").alias("doc_id"), F.lit("same").alias("text"))
    count = sharding.balanced_shards(df, shards=7).groupBy("shard").count().toPandas()["count"]
    assert len(count) == 7 and count.max() - count.min() <= 1


def test_nothing(spark):
    none = spark.createDataFrame([], "doc_id long, text string, source string")
    assert mixing.mix_sources(none).count() == mixing.mixed_documents(none).count() == packing.pack_documents(none).count() == sharding.balanced_shards(none).count() == 0


def test_pipeline(spark, small):
    import corpus_pipeline as c

    docs = spark.read.parquet(f"{small}/documents.parquet")
    now = docs
    for name, stage in c.STAGES[:-1]:
        now = stage(spark, now, small)
        assert now.columns == docs.columns, name
    left = {r["doc_id"] for r in c.near(spark, c.exact(spark, c.language_id(spark, docs, small), small), small).collect()}
    out = c.run(spark, small).select("doc_id").distinct().collect()
    assert {r["doc_id"] for r in out} <= left


def test_flows_fit():
    r = np.random.default_rng(0)
    for _ in range(200):
        k = int(r.integers(2, 41))
        load = r.integers(0, 101, k)
        wish = np.array([r.multinomial(r.integers(0, n + 1), np.ones(k) / k) for n in load])
        np.fill_diagonal(wish, 0)
        flow = sharding.flows(wish, load, np.full(k, 100))
        assert (flow >= 0).all() and (flow <= wish).all() and (load + flow.sum(0) - flow.sum(1) <= 100).all()
    full = np.array([[0, 3, 0], [0, 0, 3], [3, 0, 0]])
    assert (sharding.flows(full, np.full(3, 5), np.full(3, 5)) == full).all()  # full shards swap


def _cut(rows):
    """Rows that are not in their text's fullest shard."""
    return sum(len(x) - x["shard"].value_counts().iloc[0] for _, x in rows.groupby("text_crc32"))


@pytest.mark.parametrize("text", ["id % 2000", "case when id < 1333 then -1 when id < 2533 then 10000 + id % 600 else 20000 + id end"])
def test_shards_with_little_room(spark, text):
    """All rows in pairs, so that no shard has room to spare; or a third in one group and 30 % in pairs."""
    df = spark.range(4000).select(F.col("id").alias("doc_id"), F.concat(F.lit("t"), F.expr(text).cast("string")).alias("text"))
    rows = sharding.balanced_shards(df, shards=40).toPandas()
    assert rows.groupby("shard").size().tolist() == [100] * 40
    hot = rows["text_crc32"] == zlib.crc32(b"t-1")
    assert _cut(rows[~hot]) <= 40
    assert rows[hot]["shard"].nunique() <= 30


def test_mixing_beside_a_map(spark):
    rows = [(i % 7, "w " * (i % 7 + 1), "ab"[i % 7 % 2], {"i": i}) for i in range(40)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string, more map<string,int>")
    out = mixing.mixed_documents(df)
    assert out.columns == df.columns
    taken = mixing.mix_sources(df).agg(F.sum("taken")).first()[0]
    assert sum(len(r["text"].split()) for r in out.collect()) == taken > 0


@pytest.mark.parametrize("cuts", [1 << 19, 0])
def test_mixing_scans_whole_rows(spark, docs, monkeypatch, cuts):
    """The mix holds each id as often as mix_sources takes it, repeated rows and null ids too; texts take no shuffle."""
    monkeypatch.setattr(mixing, "CUTS", cuts)
    again = docs.where("doc_id % 3 = 0").unionByName(docs.where("doc_id % 6 = 0")).unionByName(docs.where("doc_id < 40").withColumn("row", F.lit(2)))
    none = docs.where("doc_id % 50 = 1").withColumn("doc_id", F.lit(None).cast("long"))
    df = docs.unionByName(again).unionByName(none).unionByName(spark.range(60).select(F.lit(-5).alias("doc_id"), F.lit("one two").alias("text"), F.lit("rep").alias("source"), F.lit("c").alias("size"), F.col("id").cast("int").alias("row")))
    taken = {}
    for r in mixing.mix_sources(df).where("size > 0").collect():
        taken[r["doc_id"], r["size"]] = taken.get((r["doc_id"], r["size"]), 0) + r["taken"] // r["size"]
    out = mixing.mixed_documents(df)
    held, rows = {}, {}
    for r in out.collect():
        n = len(WORD.findall(r["text"] or ""))
        if n:
            held[r["doc_id"], n] = held.get((r["doc_id"], n), 0) + 1
        if r["doc_id"] == -5:
            rows[r["row"]] = rows.get(r["row"], 0) + 1
    assert held == {k: v for k, v in taken.items() if v}
    assert max(rows.values()) - min([*rows.values(), *[0] * (len(rows) < 60)]) <= 1
    unrepeated = mixing.mixed_documents(docs.dropDuplicates(["doc_id"]).localCheckpoint())
    plan = unrepeated._jdf.queryExecution().executedPlan().toString()
    assert cuts == 0 or ("SortMergeJoin" not in plan and "Exchange hashpartitioning" not in plan)
