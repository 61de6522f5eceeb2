"""Duplicates: embeddings, shingle sets, exact texts, sentence spans, against brute force."""

import hashlib
import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from sluice.llm import embed_dedup, exact_dedup, ngram_join, substring

WORD = re.compile(r"[^\x20\x09-\x0D]+")
LOWER = {c: c + 32 for c in range(65, 91)}


def docs_frame(spark, rows):
    """Rows (doc_id, text) with extra columns whose names operators use themselves."""
    return spark.createDataFrame([(i, t, "en", "s", 1, "y") for i, t in rows], "doc_id long, text string, lang string, source string, n long, sig string")


def closed(pairs, ids):
    root = {i: i for i in ids}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in pairs:
        a, b = find(a), find(b)
        root[max(a, b)] = min(a, b)
    return {i: find(i) for i in ids}


def noisy(seed=1, groups=12):
    r = random.Random(seed)
    words = [f"w{i}" for i in range(400)]
    rows = []
    for g in range(groups):
        base = [r.choice(words) for _ in range(r.choice([3, 5, 8, 40, 200, 1500]))]
        for _ in range(r.choice([1, 2, 6])):
            t = list(base)
            for _ in range(r.choice([0, 0, 1, 2, len(t) // 60])):
                t[r.randrange(len(t))] = r.choice(words)
            rows.append((len(rows), r.choice([" ", "\n", "\t "]).join(t)))
    return rows


EDGE = [(900, None), (901, ""), (902, " \t\n"), (903, "One"), (904, "one"), (905, "one  two"), (905, "one  two"), (None, "no id here at all, none"), (907, "É " * 30000)]


def sets_of(rows):
    out = []
    for i, t in rows:
        w = WORD.findall((t or "").translate(LOWER))
        out.append((i, frozenset(tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))) if w else frozenset()))
    return out


@pytest.mark.parametrize("limit, group", [(1 << 21, 4096), (0, 3)])
def test_shingle_sets(spark, limit, group):
    rows = noisy() + EDGE
    got = sorted((-1 if r["doc_id"] is None else r["doc_id"], r["n_shingles"], r["component_id"]) for r in ngram_join.similar_documents(docs_frame(spark, rows), broadcast_rows=limit, group=group).collect())
    sets = sets_of([(i if i is not None else -1, t) for i, t in rows])
    pairs = [(a, b) for a, s in sets for b, t in sets if a < b and s and t and 100 * len(s & t) >= 80 * len(s | t)]
    comp = closed([p for p in pairs if -1 not in p], [i for i, _ in sets])
    want = sorted((i, len(s), comp[i] if i != -1 else None) for i, s in sets)
    assert [g[:2] for g in got] == [w[:2] for w in want] and {g[0]: g[2] for g in got} == {w[0]: w[2] for w in want}


def test_near_duplicates_leave_one(spark):
    rows = noisy(2)
    sets = sets_of(rows)
    comp = closed([(a, b) for a, s in sets for b, t in sets if a < b and 100 * len(s & t) >= 80 * len(s | t)], [i for i, _ in sets])
    df = docs_frame(spark, rows)
    out = ngram_join.drop_near_duplicates(df)
    assert out.columns == df.columns and sorted(r["doc_id"] for r in out.collect()) == sorted(set(comp.values()))


def test_one_large_group_of_near_copies(spark):
    r = random.Random(5)
    base = [f"w{r.randrange(10**6)}" for _ in range(150)]
    rows = []
    for i in range(300):
        t = list(base)
        for _ in range(3):
            t[r.randrange(150)] = f"x{r.randrange(10**6)}"
        rows.append((i, " ".join(t)))
    sets = sets_of(rows)
    comp = closed([(a, b) for a, s in sets for b, t in sets if a < b and 100 * len(s & t) >= 80 * len(s | t)], [i for i, _ in sets])
    got = ngram_join.similar_documents(docs_frame(spark, rows), group=64).collect()
    assert {x["doc_id"]: x["component_id"] for x in got} == comp


@pytest.mark.parametrize("operator", [ngram_join.similar_documents, ngram_join.drop_near_duplicates, exact_dedup.exact_duplicates, exact_dedup.drop_exact_duplicates, substring.remove_repeated_spans])
def test_no_rows(spark, operator):
    assert operator(docs_frame(spark, [])).count() == 0


def norm(t):
    return re.sub(r"[\x20\x09-\x0D]+", " ", t or "")


def test_exact(spark):
    rows = [(5, "a b"), (3, "a\t\nb"), (4, " a b"), (3, "a b"), (None, "a b"), (None, "only"), (1, None), (2, ""), (8, "é" * 50000), (9, "é" * 50000)]
    got = exact_dedup.exact_duplicates(docs_frame(spark, rows)).collect()
    assert len(got) == len(rows)
    for r in got:
        ids = [i for i, t in rows if hashlib.sha256(norm(t).encode()).hexdigest() == r["text_sha256"]]
        least = min([i for i in ids if i is not None], default=None)
        assert (r["keep_id"], r["group_size"], r["kept"]) == (least, len(ids), r["doc_id"] == least)
    df = docs_frame(spark, rows)
    left = exact_dedup.drop_exact_duplicates(df)
    assert left.columns == df.columns
    assert sorted((r["doc_id"] is None, r["doc_id"]) for r in left.collect() if r["doc_id"]) == [(False, 1), (False, 3), (False, 4), (False, 8)] and left.count() == 5


def test_exact_with_a_full_filter(spark, monkeypatch):
    monkeypatch.setattr(exact_dedup, "BITS_PER_ROW", 0)
    monkeypatch.setattr(exact_dedup, "MAX_BITS", 1 << 16)
    rows = [(i, f"text {i % 900}") for i in range(2000)]
    got = exact_dedup.exact_duplicates(docs_frame(spark, rows)).collect()
    assert all(r["keep_id"] == r["doc_id"] % 900 for r in got)


def vectors(seed=0, n=400, d=24):
    r = np.random.default_rng(seed)
    x = r.normal(size=(n, d))
    for i in range(n // 2, n):
        x[i] = x[r.integers(0, 40)] + r.normal(size=d) * r.choice([0.01, 0.09, 0.5])  # around the threshold too
    return x


def test_vectors(spark):
    x = vectors()
    rows = [(i, v.tolist()) for i, v in enumerate(x)]
    bad = [(1000, None), (1001, []), (1002, [0.0] * 24), (1003, [None] + [1.0] * 23), (1004, [float("nan")] * 24), (1005, [float("inf")] + [0.0] * 23)]
    rows += bad + [(2000, x[0].tolist()), (2000, x[0].tolist()), (None, x[1].tolist())]
    df = spark.createDataFrame([(*r, "k") for r in rows], "vec_id long, embedding array<double>, unit string")
    got = embed_dedup.similar_vectors(df, part=64).collect()
    assert len(got) == len(rows)
    for r in got:
        if r["vec_id"] is not None and 1000 <= r["vec_id"] < 2000:
            assert (r["n_links"], r["component_id"], r["kept"]) == (0, r["vec_id"], True)
    good = [(i, np.array(v)) for i, v in rows if i is None or not 1000 <= i < 2000]
    u = np.array([v / np.linalg.norm(v) for _, v in good])
    near = u @ u.T >= 0.9
    want = {}
    for (i, _), row in zip(good, near):
        want[i] = int(row.sum()) - 1
    found = {r["vec_id"]: r["n_links"] for r in got}
    assert all(found[i] <= n for i, n in want.items())
    assert sum(found[i] for i in want) >= 0.95 * sum(want.values())


@pytest.mark.parametrize("hashes", [1, 2, 3, 4])
def test_recall_holds_as_hashes_grow(spark, hashes):
    """Pairs at a cosine just above the least, which are the hardest; single precision, 64 wide."""
    r = np.random.default_rng(hashes)
    a, b = r.normal(size=(2, 400, 64))
    a /= np.linalg.norm(a, axis=1, keepdims=True)
    b -= (a * b).sum(1, keepdims=True) * a
    b /= np.linalg.norm(b, axis=1, keepdims=True)
    x = np.concatenate((a, 0.905 * a + np.sqrt(1 - 0.905**2) * b)).astype(np.float32)
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<float>")
    got = {r["vec_id"]: r for r in embed_dedup.similar_vectors(df, hashes=hashes).collect()}
    u = x.astype(float) / np.linalg.norm(x.astype(float), axis=1, keepdims=True)
    want = (u @ u.T >= 0.9).sum(1) - 1
    found = np.array([got[i]["n_links"] for i in range(len(x))])
    assert (found <= want).all() and found.sum() >= 0.95 * want.sum()
    assert all(got[i + 400]["component_id"] == i for i in range(400) if found[i + 400] == 1 == want[i])


def test_no_vectors(spark):
    df = spark.createDataFrame([], "vec_id long, embedding array<float>")
    assert embed_dedup.similar_vectors(df).count() == 0


def sentences(text):
    """[(words)] of a text: a sentence ends after .!? or at a line feed, or after sixteen words."""
    out, now = [], []
    parts = re.split(r"([\x20\x09-\x0D]+)", text or "")
    for i in range(0, len(parts), 2):
        if parts[i]:
            now.append(parts[i].translate(LOWER))
        gap = parts[i + 1] if i + 1 < len(parts) else "\n"
        if now and (now[-1][-1] in ".!?" or "\n" in gap or len(now) == 16):
            out.append(tuple(now))
            now = []
    return out + ([tuple(now)] if now else [])


def test_spans(spark):
    r = random.Random(3)
    line = lambda k: " ".join(f"v{r.randrange(5000)}" for _ in range(k))
    passage = "\n".join(line(9) + "." for _ in range(7))
    lone = line(60)
    rows = [(i, f"{line(20)}. {line(7)}.\n{passage if i in (2, 5, 9) else line(30)}\n{line(6)}.\n{lone if i in (4, 7) else ''}") for i in range(12)]
    rows += [(50, None), (51, ""), (52, "Short."), (53, "Short."), (54, line(12) + "."), (None, passage), (5, rows[5][1])]
    rows += [(60, rows[3][1])]
    got = {x["doc_id"]: x for x in substring.remove_repeated_spans(docs_frame(spark, rows)).collect()}
    seen, gone = {}, {}
    for i, t in sorted([x for x in rows if x[0] is not None], key=lambda x: x[0]):
        s = sentences(t)
        spans = [(k, 3) for k in range(len(s) - 2)] if len(s) >= 3 else [(0, len(s))] if s else []
        for k, n in spans:
            if sum(map(len, s[k : k + n])) >= 10:
                key = tuple(s[k : k + n])
                if seen.setdefault(key, (i, k)) != (i, k):
                    gone.setdefault(i, set()).update(range(k, k + n))
    assert {i: x["removed"] for i, x in got.items()} == {i: sorted(v) for i, v in gone.items()}
    assert {5, 9, 7, 60} <= set(got) and not set(got) & {2, 4, 0, 1, 50, 51, 52, 53, 54}
    assert passage.split("\n")[3] not in got[9]["text"] and got[9]["first_doc_ids"] == [2]
    for i, x in got.items():
        s = sentences(dict(rows)[i])
        kept = [w for k, part in enumerate(s) if k not in gone[i] for w in part]
        assert WORD.findall(x["text"].translate(LOWER)) == kept


def test_spans_of_short_lines_lengthen(spark):
    r = random.Random(5)
    line = lambda k: " ".join(f"v{r.randrange(5000)}" for _ in range(k))
    menu = "\n".join(line(3) for _ in range(20))
    few = "\n".join(line(2) for _ in range(5))  # ten words
    rows = [(1, f"{line(12)}.\n{menu}\n{line(9)}."), (2, f"{line(30)}\n{menu}\n{line(11)}."), (3, f"{line(8)}.\n{few}"), (4, f"{few}\n{line(9)}."), (5, "a b\nc d\ne f"), (6, "a b\nc d\ne f")]
    got = {x["doc_id"]: x for x in substring.remove_repeated_spans(docs_frame(spark, rows)).collect()}
    assert set(got) == {2, 4}
    assert got[2]["text"].split() == rows[1][1].replace(menu, "").split()
    assert got[4]["text"].split() == rows[3][1].replace(few, "").split()


@pytest.mark.parametrize("stops", [0, 1])
def test_passages_at_any_word(spark, stops):
    r = random.Random(7)
    line = lambda k: [f"v{r.randrange(50000)}" + "." * (stops and r.random() < 0.06) for _ in range(k)]
    rows, passages = [], []
    for i in range(0, 120, 2):
        passage, long = line(r.choice([50, 51, 60, 80])), line(40)
        a, b = r.randrange(40), r.randrange(40)
        rows += [(i, " ".join(long[:a] + passage + long[a:])), (i + 1, " ".join(line(b) + passage + line(37)))]
        passages.append((b, passage))
    # one text holds a passage twice; one takes two passages that touch, of which another text has more; words that repeat
    twice, other = line(55), line(70)
    rows += [(200, " ".join(line(5) + twice + line(9) + twice + line(3))), (201, " ".join(line(21) + other)), (202, " ".join(twice + other + line(30))), (203, " ".join(["w"] * 300))]
    got = {x["doc_id"]: x for x in substring.remove_repeated_spans(docs_frame(spark, rows)).collect()}
    texts = dict(rows)
    for k, (b, passage) in enumerate(passages):
        words, left = texts[2 * k + 1].split(), got[2 * k + 1]["text"].split()
        assert left == words[:b] + words[b + len(passage) :] and 2 * k not in got
        assert got[2 * k + 1]["first_doc_ids"] == [2 * k]
        assert got[2 * k + 1]["removed_words"] == [(b, b + len(passage))]
    assert len(got[200]["text"].split()) == 5 + 55 + 9 + 3
    assert 201 not in got and got[202]["text"].split() == texts[202].split()[125:]
    assert got[203]["text"].startswith("w w w w")


def test_exact_beside_a_map(spark):
    rows = [(2, "a b", {"k": 1}, [{"x": 1}]), (1, "a  b", {"k": 3}, None), (1, "a b", {"k": 2}, None), (3, "c", None, None)]
    df = spark.createDataFrame(rows, "doc_id long, text string, more map<string,int>, deep array<map<string,int>>")
    got = exact_dedup.drop_exact_duplicates(df).collect()
    assert sorted((r["doc_id"], r["text"], (r["more"] or {}).get("k")) for r in got) == [(1, "a  b", 3), (3, "c", None)]
    assert sorted(map(str, got)) == sorted(map(str, exact_dedup.drop_exact_duplicates(df.repartition(3)).collect()))
