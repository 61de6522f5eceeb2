"""N-gram Jaccard join with signature trees.

A document is its set of word shingles; equal sets are one class.  Two sets of Jaccard similarity t or more share a
shingle among the first n - ceil(t n) + 1 of each in any one order of all shingles, so classes meet in groups, one for
each such prefix shingle that several classes have.  Frequent shingles come last in the order.  Inside a group a
signature tree prunes: a node holds the OR of its members' shingle bitmaps and their range of sizes, and a pair of
nodes is left aside when the overlap that these allow is too small.  What remains is compared on whole sets.

Work stays linear where copies abound.  Groups with the same members are one.  Active members of groups first meet in
blocks, each class once, around the least class they share a group with; links found there join classes into
components, and only groups that still hold several components are compared in full.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sluice.llm import textkit as T
from sluice.llm.common import Scratch, connected_components, seeded, ship, whole

WIDTH = 5
NUM, DEN = 4, 5  # similarity 0.8
#: Shingles in more documents than this come last in the order (found by counts of two or more in a piece of text).
FREQUENT = 100
MOST_FREQUENT = 1 << 18
#: Sizes up to which a table is broadcast; beyond, the same rows meet by a shuffle.
BROADCAST_ROWS = 1 << 21
#: Members up to which a group is pruned as one; larger groups skip to the comparison in blocks.
GROUP = 4096
#: Shingles that one block holds at a time, and members that every part of a divided block gets.
BLOCK_SHINGLES = 1 << 20
ANCHORS = 64
LEAF, FAN = 32, 8


def enough(overlap, a, b):
    """Whether sets of sizes a and b with such an overlap have Jaccard similarity NUM / DEN or more."""
    return overlap * (NUM + DEN) >= NUM * (a + b)


def bitmap(shingles: np.ndarray) -> np.ndarray:
    """A set's bitmap: two to four bits for each shingle, a power of two."""
    width = min(1 << 16, max(256, 1 << int(2 * len(shingles) - 1).bit_length()))
    at = shingles & np.uint64(width - 1)
    out = np.zeros(width // 64, np.uint64)
    np.bitwise_or.at(out, (at >> np.uint64(6)).astype(np.int64), np.uint64(1) << (at & np.uint64(63)))
    return out


def fold(bits: np.ndarray, words: int) -> np.ndarray:
    """A bitmap (or rows of them) at a smaller width."""
    while bits.shape[-1] > words:
        half = bits.shape[-1] // 2
        bits = bits[..., :half] | bits[..., half:]
    return bits


class SignatureTree:
    """Members in the order of their sizes under nodes with OR-combined bitmaps and size ranges."""

    def __init__(self, sizes: np.ndarray, maps: list[np.ndarray]):
        self.order = np.argsort(sizes, kind="stable")
        self.sizes = np.asarray(sizes, np.int64)[self.order]
        leaves = []
        to = 0
        while to < len(self.sizes):
            # sizes in a leaf are close, so that no bitmap is folded far below its own width
            at, to = to, min(to + LEAF, int(np.searchsorted(self.sizes, self.sizes[to] * DEN // NUM, "right")))
            words = min(len(maps[i]) for i in self.order[at:to])
            rows = np.stack([fold(maps[i], words) for i in self.order[at:to]])
            # shingles that share a bit with another one of the same set: what a bitmap hides of an overlap
            lost = self.sizes[at:to] - np.bitwise_count(rows).sum(1).astype(np.int64)
            leaves.append((np.bitwise_or.reduce(rows), int(self.sizes[at]), int(self.sizes[to - 1]), int(lost.max()), at, to, rows, lost, None))
        while len(leaves) > 1:
            above = []
            for at in range(0, len(leaves), FAN):
                below = leaves[at : at + FAN]
                words = min(len(x[0]) for x in below)
                joint = np.bitwise_or.reduce(np.stack([fold(x[0], words) for x in below]))
                # a narrower map hides more: at most what any member's own size leaves
                lost = max(x[3] if len(x[0]) == words else x[2] for x in below)
                above.append((joint, below[0][1], below[-1][2], lost, 0, 0, None, None, below))
            leaves = above
        self.root = leaves[0] if leaves else None

    @staticmethod
    def _far(x, y) -> bool:
        """Whether no member of x can be similar enough to one of y."""
        if x[2] * DEN < NUM * y[1] or y[2] * DEN < NUM * x[1]:
            return True
        words = min(len(x[0]), len(y[0]))
        lost = min(x[3] if len(x[0]) == words else x[2], y[3] if len(y[0]) == words else y[2])
        common = int(np.bitwise_count(fold(x[0], words) & fold(y[0], words)).sum()) + lost
        return not enough(min(common, x[2], y[2]), x[1], y[1])

    def pairs(self):
        """Dual traversal: (first, second) arrays of members that may be similar enough, each pair once."""
        if self.root is None:
            return
        stack = [(self.root, self.root)]
        while stack:
            x, y = stack.pop()
            if x is not y and self._far(x, y):
                continue
            if x[8] is None and y[8] is None:
                words = min(x[6].shape[1], y[6].shape[1])
                a, b = fold(x[6], words), fold(y[6], words)
                common = np.bitwise_count(a[:, None, :] & b[None, :, :]).sum(2).astype(np.int64)
                own = lambda n, rows, m: m[7] if rows is m[6] else n - np.bitwise_count(rows).sum(1).astype(np.int64)
                sa, sb = self.sizes[x[4] : x[5]], self.sizes[y[4] : y[5]]
                common += np.minimum(own(sa, a, x)[:, None], own(sb, b, y)[None, :])
                common = np.minimum(common, np.minimum(sa[:, None], sb[None, :]))
                near = enough(common, sa[:, None], sb[None, :])
                if x is y:
                    near = np.triu(near, 1)
                i, j = np.nonzero(near)
                if len(i):
                    yield self.order[i + x[4]], self.order[j + y[4]]
            elif x is y:
                below = x[8]
                stack += [(below[i], below[j]) for i in range(len(below)) for j in range(i, len(below))]
            elif y[8] is None or (x[8] is not None and x[2] - x[1] >= y[2] - y[1]):
                stack += [(c, y) for c in x[8]]
            else:
                stack += [(x, c) for c in y[8]]


def active(sizes: np.ndarray, maps: list[np.ndarray], homes: np.ndarray) -> np.ndarray:
    """Which members may be similar enough to one of another home."""
    out = np.zeros(len(sizes), bool)
    for i, j in SignatureTree(sizes, maps).pairs():
        other = homes[i] != homes[j]
        out[i[other]] = True
        out[j[other]] = True
    return out


def block_links(sets: list[np.ndarray], comps: np.ndarray, homes: np.ndarray) -> list[tuple[int, int]]:
    """Links between members of different components and homes, as many as join all that are linked."""
    _, root = np.unique(comps, return_inverse=True)
    root = root.copy()
    sizes = np.array([len(s) for s in sets], np.int64)
    links = []
    for i, j in SignatureTree(sizes, [bitmap(s) for s in sets]).pairs():
        other = homes[i] != homes[j]
        for a, b in zip(i[other], j[other]):
            if root[a] != root[b] and enough(_overlap(sets[a], sets[b]), sizes[a], sizes[b]):
                links.append((int(a), int(b)))
                root[root == root[b]] = root[a]
    return links


def _overlap(a: np.ndarray, b: np.ndarray) -> int:
    if len(a) > len(b):
        a, b = b, a
    at = np.searchsorted(b, a)
    at[at == len(b)] = 0
    return int((b[at] == a).sum())


def _prefix(shingles: np.ndarray, find, weight: np.ndarray) -> np.ndarray:
    """The first shingles of a set in the common order: by hash, but frequent ones last, the more frequent the later."""
    n = len(shingles)
    count = n + (-NUM * n // DEN) + 1  # n - ceil(NUM n / DEN) + 1
    at = find(shingles)
    rare = shingles[at < 0]
    if len(rare) >= count:
        return rare[:count]
    often = np.flatnonzero(at >= 0)
    often = often[np.lexsort((shingles[often], weight[at[often]]))]
    return np.concatenate((rare, shingles[often[: count - len(rare)]]))


def _sig(shingles: np.ndarray) -> bytes:
    return hashlib.blake2b(shingles.tobytes(), digest_size=12).digest()


def _sets(batches, column: str = "text"):
    """(piece, row, set, signature) for every row of batches."""
    for piece in T.slices(batches, column):
        for i, s in enumerate(T.shingle_sets(piece.column(piece.schema.get_field_index(column)), WIDTH)):
            yield piece, i, s, _sig(s)


def _batches(rows, schema: list[tuple[str, pa.DataType]], size: int = 4096):
    held = []
    for r in rows:
        held.append(r)
        if len(held) == size:
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, (_, t) in zip(zip(*held), schema)], [n for n, _ in schema])
            held = []
    if held:
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, (_, t) in zip(zip(*held), schema)], [n for n, _ in schema])


def _survey(rows: DataFrame) -> DataFrame:
    """One pass over all texts: (kind 0, id, key, n, sig) of every row, and (kind 1, key, n) of shingles that a piece
    of text has in two sets or more."""

    def run(batches):
        for piece in T.slices(batches):
            sets = list(T.shingle_sets(piece.column(2), WIDTH))
            sigs = [_sig(s) for s in sets]
            n = pa.array([len(s) for s in sets], pa.int64())
            kind = np.zeros(len(sets), np.int32)
            names = ["kind", "doc_id", "key", "n", "sig"]
            yield pa.RecordBatch.from_arrays([pa.array(kind), piece.column(0), piece.column(1), n, pa.array(sigs, pa.binary())], names)
            once = list({g: s for g, s in zip(sigs, sets)}.values())
            key, times = np.unique(np.concatenate(once), return_counts=True)
            key, times = key[times > 1], times[times > 1]
            none = pa.nulls(len(key), pa.int64())
            yield pa.RecordBatch.from_arrays([pa.array(np.ones(len(key), np.int32)), none, pa.array(key.view(np.int64)), pa.array(times.astype(np.int64)), pa.nulls(len(key), pa.binary())], names)

    return rows.mapInArrow(run, "kind int, doc_id long, key long, n long, sig binary")


def _each_set(batches):
    """(set, signature) of each text, once for each distinct set of a task."""
    seen = set()
    for _, _, s, sig in _sets(batches):
        if len(s) and sig not in seen:
            seen.add(sig)
            yield s, sig


def _groups(texts: DataFrame, often: tuple, scratch: Scratch, broadcast_rows: int, group: int):
    """(members: sig, n, bits of classes that share a prefix shingle with another; rows: gid, sig; large: the same for
    groups of more than group members)."""
    spark = texts.sparkSession
    frequent = spark.sparkContext.broadcast(often)  # at most MOST_FREQUENT keys

    def members(batches):
        find = T.Lookup(frequent.value[0])
        for s, sig in _each_set(batches):
            yield sig, len(s), bitmap(s).tobytes(), _prefix(s, find, frequent.value[1]).view(np.int64)

    schema = [("sig", pa.binary()), ("n", pa.int64()), ("bits", pa.binary()), ("ws", pa.list_(pa.int64()))]
    found = scratch.write(texts.mapInArrow(lambda b: _batches(members(b), schema), "sig binary, n long, bits binary, ws array<long>"))
    # prefix shingles of one class only need no partner; nor do the copies of a class
    met = found.select(F.explode("ws").alias("w"), F.xxhash64("sig").alias("label")).groupBy("w")
    met = met.agg(F.min("label").alias("low"), F.max("label").alias("high"), F.count(F.lit(1)).alias("m")).where("low < high")
    met = scratch.write(met.select("w", "m"))
    if met.count() <= broadcast_rows:
        wanted = spark.sparkContext.broadcast(np.sort(met.select("w").toArrow().column(0).to_numpy()))  # checked

        def meeting(batches):
            keep = wanted.value
            for b in batches:
                ws = b.column(1)
                w = ws.flatten().to_numpy()
                owner = np.repeat(np.arange(b.num_rows), np.diff(ws.offsets.to_numpy()))
                at = np.searchsorted(keep, w)
                at[at == len(keep)] = 0
                there = keep[at] == w if len(keep) else np.zeros(len(w), bool)
                yield pa.RecordBatch.from_arrays([pa.array(w[there]), b.column(0).take(pa.array(owner[there]))], ["w", "sig"])

        rows = found.select("sig", "ws").mapInArrow(meeting, "w long, sig binary").distinct()
    else:
        rows = found.select(F.explode("ws").alias("w"), "sig").join(met, "w", "left_semi").distinct()
    sizes = met.where(F.col("m") > group).select("w", "m")
    sizes = scratch.write(sizes)
    large = rows.join(sizes, "w").select(F.col("w").alias("gid"), "sig", F.lit(1).cast("long").alias("shared")) if sizes.limit(1).count() else None
    if large is not None:
        rows = rows.join(sizes, "w", "left_anti")
        large = scratch.write(large)
    # at most group members each; groups with the same members are one
    lists = rows.groupBy("w").agg(F.array_sort(F.collect_set("sig")).alias("sigs")).where(F.size("sigs") > 1)
    lists = lists.groupBy(F.xxhash64("sigs").alias("h"), "sigs").agg(F.min("w").alias("gid"), F.count(F.lit(1)).alias("shared"))
    rows = scratch.write(lists.select("gid", F.explode("sigs").alias("sig"), "shared"))
    return found.select("sig", "n", "bits").dropDuplicates(["sig"]), rows, large


def _runs(keys: list):
    """(first, last) of runs of equal keys after sorting, and the order."""
    order = sorted(range(len(keys)), key=keys.__getitem__)
    at = 0
    while at < len(order):
        to = at
        while to < len(order) and keys[order[to]] == keys[order[at]]:
            to += 1
        yield order[at:to]
        at = to


def _number(rows: DataFrame, weight: int, per: int) -> int:
    return max(int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-weight // per))


def _prune(rows: DataFrame, members: DataFrame) -> DataFrame:
    """(gid, sig) of members that a signature tree leaves a possible partner of another home (gid, sig, home)."""

    def run(batches):
        parts = [b for b in batches if b.num_rows]
        if not parts:
            return
        t = pa.Table.from_batches(parts)
        gid, sig, n = (t.column(c).to_pylist() for c in ("gid", "sig", "n"))
        home, n = t.column("home").to_numpy(), np.array(n, np.int64)
        bits = t.column("bits").combine_chunks()

        def out():
            for run in _runs(gid):
                if len(run) > 1:
                    run = np.array(run)
                    maps = [np.frombuffer(bits[int(i)].as_py(), np.uint64) for i in run]
                    for i in run[active(n[run], maps, home[run])]:
                        yield gid[i], sig[i]

        yield from _batches(out(), [("gid", pa.int64()), ("sig", pa.binary())])

    full = rows.join(members, "sig").select("gid", "sig", "home", "n", "bits")
    return full.repartition(_number(rows, rows.count(), 40_000), "gid").mapInArrow(run, "gid long, sig binary")


def _compare(blocks: DataFrame, sets: DataFrame, broadcast_rows: int) -> DataFrame:
    """(a, b): links found in blocks (block, sig, n, comp, home)."""

    def run(batches):
        parts = [b for b in batches if b.num_rows]
        if not parts:
            return
        t = pa.Table.from_batches(parts)
        block, sig, comp = (t.column(c).to_pylist() for c in ("block", "sig", "comp"))
        home, data = t.column("home").to_numpy(), t.column("shingles").combine_chunks()

        def out():
            for run in _runs(block):
                run = list({sig[i]: i for i in run}.values())  # a set may have come from several tasks
                if len(run) > 1:
                    own = [np.frombuffer(data[i].as_py(), np.uint64) for i in run]
                    for a, b in block_links(own, np.array([comp[i] for i in run], object), home[run]):
                        yield sig[run[a]], sig[run[b]]

        yield from _batches(out(), [("a", pa.binary()), ("b", pa.binary())])

    size = blocks.agg(F.count(F.lit(1)).alias("rows"), F.sum("n").alias("n")).first()
    side = blocks.select("block", "sig", "comp", "home")
    if size["rows"] <= broadcast_rows // 8:
        side = F.broadcast(side)  # checked
    full = sets.join(side, "sig").select("block", "sig", "comp", "home", "shingles")
    return full.repartition(_number(blocks, size["n"] or 0, BLOCK_SHINGLES), "block").mapInArrow(run, "a binary, b binary")


def _whole_sets(texts: DataFrame, classes: DataFrame, wanted: DataFrame, broadcast_rows: int) -> DataFrame:
    """(sig, shingles) of the wanted (sig), computed again from one text of each class."""

    def run(batches):
        yield from _batches(((sig, s.tobytes()) for s, sig in _each_set(batches)), [("sig", pa.binary()), ("shingles", pa.binary())], 256)

    keys = classes.join(wanted, "sig").select(F.col("rep").alias("key"))
    if wanted.count() <= broadcast_rows:
        keys = F.broadcast(keys)  # checked
    return texts.join(keys, "key", "left_semi").mapInArrow(run, "sig binary, shingles binary")


def similar_classes(docs: DataFrame, scratch: Scratch, id_col: str, text_col: str, broadcast_rows: int = BROADCAST_ROWS, group: int = GROUP) -> tuple[DataFrame, DataFrame]:
    """(rows: doc_id, key, n, sig of every document; components: node, component of classes with links)."""
    ship(docs.sparkSession)
    text = F.coalesce(F.col(text_col), F.lit(""))
    texts = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.xxhash64(text).alias("key"), text.alias("text"))
    survey = scratch.write(_survey(texts), "kind")
    rows = survey.where("kind = 0").select("doc_id", "key", "n", "sig")
    often = survey.where("kind = 1").groupBy("key").agg(F.sum("n").alias("n")).where(F.col("n") >= FREQUENT)
    often = often.orderBy(F.desc("n"), "key").limit(MOST_FREQUENT).toArrow()
    often = often.column("key").to_numpy().view(np.uint64), often.column("n").to_numpy()

    members, small, large = _groups(texts, often, scratch, broadcast_rows, group)
    members = scratch.write(members)
    met = small if large is None else scratch.write(small.unionByName(large))

    # every class has one home: the block around that class, the least of its group, with whose groups it shares the
    # most prefix shingles; a large block comes in parts that have some members in common
    centres = scratch.write(met.groupBy("gid").agg(F.min("sig").alias("centre")))
    home = met.join(centres, "gid").groupBy("sig", "centre").agg(F.sum("shared").alias("shared"))
    home = home.groupBy("sig").agg(F.max_by("centre", F.struct("shared", "centre")).alias("centre"))
    home = scratch.write(home.join(members.select("sig", "n"), "sig"))
    blocks = scratch.write(home.groupBy("centre").agg(F.count(F.lit(1)).alias("m"), F.ceil(F.sum("n") / F.lit(BLOCK_SHINGLES)).cast("int").alias("parts")))
    own = F.pmod(seeded(2, "sig"), F.col("parts")).cast("int")
    every = F.when(F.pmod(seeded(1, "sig"), F.col("m")) < ANCHORS, F.sequence(F.lit(0), F.col("parts") - 1)).otherwise(F.array(own))
    home = home.join(blocks, "centre").select("sig", "n", "m", F.xxhash64("centre", own).alias("home"), F.transform(every, lambda p: F.xxhash64("centre", p)).alias("blocks"))
    home = scratch.write(home)
    inside = home.where("m > 1").select("sig", "n", F.explode("blocks").alias("gid"))
    inside = scratch.write(inside)
    # the tree prunes blocks, then groups whose members have several homes; larger groups go on unpruned
    first = scratch.write(_prune(inside.select("gid", "sig", F.xxhash64("sig").alias("home")), members))
    homes = home.select("sig", "n", "home")
    far = met.drop("shared").join(homes, "sig")
    split = far.groupBy("gid").agg(F.min("home").alias("low"), F.max("home").alias("high"), F.count(F.lit(1)).alias("m")).where("low <> high")
    far = scratch.write(far.join(scratch.write(split.select("gid", "m")), "gid"))
    second = _prune(far.where(F.col("m") <= group).select("gid", "sig", "home"), members).unionByName(far.where(F.col("m") > group).select("gid", "sig"))
    second = scratch.write(second)

    classes = scratch.write(rows.groupBy("sig").agg(F.min("key").alias("rep")))
    sets = scratch.write(_whole_sets(texts, classes, scratch.write(first.select("sig").union(second.select("sig")).distinct()), broadcast_rows))
    near = first.withColumnRenamed("gid", "block").join(home.select("sig", "n"), "sig").select("block", "sig", "n", F.col("sig").alias("comp"), F.xxhash64("sig").alias("home"))
    links = scratch.write(_compare(scratch.write(near), sets, broadcast_rows).distinct())
    comps = connected_components(scratch, links)

    # groups that still hold several components from several homes
    known = second.join(homes, "sig").join(comps.withColumnRenamed("node", "sig"), "sig", "left")
    known = scratch.write(known.select("gid", "sig", "n", "home", F.coalesce("component", "sig").alias("comp")))
    ends = [f(c).alias(f"{k}_{c}") for c in ("comp", "home") for k, f in (("low", F.min), ("high", F.max))]
    split = known.groupBy("gid").agg(*ends, F.count(F.lit(1)).alias("m")).where("low_comp <> high_comp and low_home <> high_home")
    rest = scratch.write(known.join(scratch.write(split.select("gid", "m")), "gid"))
    if rest.limit(1).count():
        # groups with the same members are one; a group above the size for one task meets in pairs of its parts
        same = rest.where(F.col("m") <= group).groupBy("gid").agg(F.array_sort(F.collect_set("sig")).alias("sigs"))
        same = same.groupBy("sigs").agg(F.min("gid").alias("gid")).select("gid")
        parts = F.ceil(F.col("m") / F.lit(group)).cast("int")
        mine = F.pmod(seeded(3, "sig"), parts).cast("int")
        at = F.transform(F.sequence(F.lit(0), parts - 1), lambda x: F.concat_ws("-", F.least(x, mine), F.greatest(x, mine)))
        pieces = rest.join(scratch.write(same), "gid", "left_semi").unionByName(rest.where(F.col("m") > group))
        pieces = pieces.select("sig", "n", "comp", "home", "gid", F.explode(at).alias("at"))
        pieces = scratch.write(pieces.select("sig", "n", "comp", "home", F.xxhash64("gid", "at").alias("block")))
        more = scratch.write(_compare(pieces, sets, broadcast_rows).distinct())
        if more.limit(1).count():
            comps = connected_components(scratch, links.unionByName(more))
    return rows, comps


def _joined(rows: DataFrame, comps: DataFrame, scratch: Scratch) -> DataFrame:
    """rows with component: the class of a document's component, null for a text without words."""
    out = rows.join(comps.withColumnRenamed("node", "sig"), "sig", "left")
    return scratch.write(out.select("doc_id", "key", "n", F.when(F.col("n") > 0, F.coalesce("component", "sig")).alias("component")))


def similar_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", broadcast_rows: int = BROADCAST_ROWS, group: int = GROUP) -> DataFrame:
    """doc_id, n_shingles, component_id for every row of docs.

    A document's set are its distinct 5-word shingles over words with A-Z lowered; fewer words are one shingle; a
    null, empty or wordless text has none and links with nothing.  Sets link when 100 |A & B| >= 80 |A | B|.
    component_id is the smallest id reachable.  Rows repeated with one id are rows like others; null ids take part,
    and a component of null ids only has a null component_id.  Other columns are ignored; no rows give no rows.
    """
    scratch = Scratch(docs.sparkSession, "ngrams")
    rows, comps = similar_classes(docs, scratch, id_col, text_col, broadcast_rows, group)
    joined = _joined(rows, comps, scratch)
    least = scratch.write(joined.where("component is not null").groupBy("component").agg(F.min("doc_id").alias("component_id")))
    some = joined.join(least, "component").select("doc_id", F.col("n").alias("n_shingles"), "component_id")
    none = joined.where("component is null").select("doc_id", F.col("n").alias("n_shingles"), F.col("doc_id").alias("component_id"))
    return some.unionByName(none)


def drop_near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", broadcast_rows: int = BROADCAST_ROWS) -> DataFrame:
    """The rows of docs without those that link, over others too, with a document of a smaller id (null ids last).

    Texts without words all stay; so do rows that repeat the one that stays, text and id alike.
    """
    scratch = Scratch(docs.sparkSession, "ngrams")
    rows, comps = similar_classes(docs, scratch, id_col, text_col, broadcast_rows)
    joined = _joined(rows, comps, scratch).where("component is not null")
    order = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "key")
    least = scratch.write(joined.groupBy("component").agg(F.min(order).alias("stays")))
    gone = joined.join(least, "component").where(~order.eqNullSafe(F.col("stays")))
    gone = scratch.write(gone.select(F.col("doc_id").alias("__id"), F.col("key").alias("__key")).distinct())
    keyed = docs.select(F.col(id_col).cast("long").alias("id"), F.xxhash64(F.coalesce(F.col(text_col), F.lit(""))).alias("key"), whole(docs))
    if gone.count() <= broadcast_rows:
        gone = F.broadcast(gone)  # checked
    out = keyed.join(gone, F.col("id").eqNullSafe(F.col("__id")) & (F.col("key") == F.col("__key")), "left_anti")
    return out.select(*[F.col(f"row.`{c}`").alias(c) for c in docs.columns])
