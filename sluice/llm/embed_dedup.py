"""Embedding near-dedup by cross-polytope hashing after fast Hadamard rotations.

Each table rotates a vector by three rounds of random signs and a Hadamard transform, twice or more, and reads off the
largest coordinate with its sign: the vertex of the cross-polytope that is nearest.  A vector enters its own bucket of
every table and the next nearest ones; two vectors are candidates when they share a bucket that is the own one of
either.  Candidates are verified by their cosine in double precision, inside the bucket, and nothing but counts and a
spanning forest leaves it.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sluice.llm import textkit as T
from sluice.llm.common import Scratch, connected_components, seeded, ship

LEAST = 0.9
#: Buckets besides its own that a vector enters in each table.
PROBES = 3
#: Share of the pairs at the least cosine that tables are to find, by a measurement over TRIALS random pairs; and tables
#: at least.
RECALL, TRIALS, TABLES = 0.98, 512, 6
#: Mean vectors in a bucket, from which the number of joined hashes of a table follows.
PER_BUCKET = 128
#: Members of a bucket that one task compares at a time; a larger bucket meets in pairs of its parts.
PART = 2048
SEED = 17


def rotate(x: np.ndarray, signs: np.ndarray) -> np.ndarray:
    """Rows of x (a power of two wide) after each round of signs and a fast Hadamard transform."""
    n = x.shape[1]
    for s in signs:
        x = x * s
        h = 1
        while h < n:
            y = x.reshape(len(x), n // (2 * h), 2, h)
            x = np.stack((y[:, :, 0] + y[:, :, 1], y[:, :, 0] - y[:, :, 1]), 2).reshape(len(x), n)
            h *= 2
        x = x / np.sqrt(n)
    return x


def buckets(x: np.ndarray, hashes: int, tables: int = TABLES, probes: int = PROBES, seed: int = SEED, skip: int = 0) -> np.ndarray:
    """(rows, tables, 1 + probes) bucket numbers, the own one first; x: unit rows; skip: tables to leave out first.

    A table joins hashes vertices.  The probes are the buckets with the least loss: one or more hashes changed to
    their second nearest vertex, where that is nearly as near.
    """
    width = 1 << max(1, int(x.shape[1] - 1).bit_length())
    padded = np.zeros((len(x), width))
    padded[:, : x.shape[1]] = x
    out = np.zeros((len(x), tables, 1 + probes), np.int64)
    for t in range(tables):
        best, loss = [], []
        rng = np.random.default_rng((seed, skip + t))
        for _ in range(hashes):
            y = rotate(padded, rng.choice([-1.0, 1.0], (3, width)))
            size = np.abs(y)
            top = np.argpartition(-size, min(probes, width - 1), axis=1)[:, : min(probes, width - 1) + 1]
            top = np.take_along_axis(top, np.argsort(-np.take_along_axis(size, top, 1), axis=1, kind="stable"), 1)
            value = np.take_along_axis(y, top, 1)
            best.append(2 * top + (value < 0))
            loss.append(np.abs(value[:, :1]) - np.abs(value))
        # all ways to change one hash to its next vertices, or two hashes to their second
        ways, cost = [[0] * hashes], [np.zeros(len(x))]
        for h in range(hashes):
            for r in range(1, best[h].shape[1]):
                ways.append([r if g == h else 0 for g in range(hashes)])
                cost.append(loss[h][:, r])
        for h in range(hashes):
            for g in range(h + 1, hashes):
                if best[h].shape[1] > 1:
                    ways.append([1 if k in (g, h) else 0 for k in range(hashes)])
                    cost.append(loss[h][:, 1] + loss[g][:, 1])
        ways, cost = np.array(ways), np.stack(cost, 1)
        pick = np.argsort(cost[:, 1:], axis=1, kind="stable")[:, :probes] + 1
        pick = np.concatenate((np.zeros((len(x), 1), int), pick), 1)
        if pick.shape[1] < 1 + probes:
            pick = np.pad(pick, ((0, 0), (0, 1 + probes - pick.shape[1])))
        number = np.zeros(pick.shape, np.int64)
        for h in range(hashes):
            number = number * (2 * width) + np.take_along_axis(best[h], ways[pick, h], 1)
        out[:, t] = number * tables + t
    return out


def tables_for(width: int, hashes: int, least: float = LEAST, probes: int = PROBES, recall: float = RECALL, seed: int = SEED) -> int:
    """How many tables find recall of the pairs with a cosine of least: the more hashes are joined, the more it takes.

    Measured on random pairs of that cosine, over tables until they suffice, as tables differ in luck.
    """
    rng = np.random.default_rng(seed + 1)
    width = max(2, width)
    a, b = rng.normal(size=(2, TRIALS, width))
    a /= np.sqrt((a * a).sum(1, keepdims=True))
    b -= (a * b).sum(1, keepdims=True) * a
    b /= np.sqrt((b * b).sum(1, keepdims=True))
    b = least * a + np.sqrt(max(0.0, 1 - least * least)) * b
    met, tables = np.zeros(TRIALS, bool), 0
    while True:
        step = TABLES if tables < 4 * TABLES else 4 * TABLES
        x, y = (buckets(v, hashes, step, probes, seed, tables) for v in (a, b))
        for t in range(step):
            tables += 1
            met |= (x[:, t] == y[:, t, :1]).any(1) | (x[:, t, :1] == y[:, t]).any(1)
            if tables >= TABLES and met.mean() >= recall:
                return tables


def first_meeting(a: np.ndarray, b: np.ndarray, bucket: int, table: int) -> np.ndarray:
    """Whether bucket is the first in which the pairs of rows of a and b (bucket numbers) are candidates."""
    fresh = np.ones(len(a), bool)
    for t in range(table):
        met = (b[:, t] == a[:, t, :1]).any(1) | (a[:, t] == b[:, t, :1]).any(1)
        fresh &= ~met
    far = np.int64(np.iinfo(np.int64).max)
    one = np.where((b[:, table] == a[:, table, :1]).any(1), a[:, table, 0], far)
    two = np.where((a[:, table] == b[:, table, :1]).any(1), b[:, table, 0], far)
    return fresh & (np.minimum(one, two) == bucket)


class Forest:
    def __init__(self, n: int):
        self.root = np.arange(n)

    def join(self, a: np.ndarray, b: np.ndarray) -> list[tuple[int, int]]:
        """Joins the pairs; returns those that were apart."""
        out = []
        for x, y in zip(a, b):
            p, q = self.root[x], self.root[y]
            if p != q:
                self.root[self.root == max(p, q)] = min(p, q)
                out.append((int(x), int(y)))
        return out


def compare_bucket(x: np.ndarray, keys: np.ndarray, weight: np.ndarray, side: np.ndarray, apart: bool, bucket: int, least: float, rows: int = 256):
    """(links of each member, counted by the others' weights in their first bucket; joining pairs).

    side, apart: in a bucket that meets in parts, the part of each member, and whether only unlike parts are compared.
    """
    n, table = len(x), bucket % keys.shape[1]
    links, forest, pairs = np.zeros(n, np.int64), Forest(n), []
    for at in range(0, n, rows):
        near = x[at : at + rows] @ x[at:].T >= least
        i, j = np.nonzero(near)
        i, j = i + at, j + at
        use = i < j
        if apart:
            use &= side[i] != side[j]
        i, j = i[use], j[use]
        for k in range(0, len(i), 1 << 16):
            a, b = i[k : k + (1 << 16)], j[k : k + (1 << 16)]
            fresh = first_meeting(keys[a], keys[b], bucket, table)
            a, b = a[fresh], b[fresh]
            links += np.bincount(a, weight[b], n).astype(np.int64) + np.bincount(b, weight[a], n).astype(np.int64)
            root = forest.root
            open_ = root[a] != root[b]
            pairs += forest.join(a[open_], b[open_])
    return links, pairs


def _normal(x: np.ndarray) -> np.ndarray:
    """Rows of x, none of them zero, at length 1; scaled first, which keeps squares in range."""
    x = x / np.abs(x).max(1, initial=0, keepdims=True)
    return x / np.sqrt((x * x).sum(1, keepdims=True))


def _dense(column) -> np.ndarray:
    """The rows of a list column in double, zeros after shorter ones and NaN for null components."""
    size = pc.fill_null(pc.list_value_length(column), 0).to_numpy(zero_copy_only=False).astype(np.int64)
    values = column.flatten().to_numpy(zero_copy_only=False)
    end = np.cumsum(size)
    owner, place = T.spread(end - size, end)
    out = np.zeros((len(size), int(size.max(initial=0))))
    out[owner, place - (end - size)[owner]] = values
    return out


def _packed(column, width: int, kind) -> np.ndarray:
    """The unit rows of a column of packed components."""
    out = np.zeros((len(column), width))
    for i, v in enumerate(column):
        v = np.frombuffer(v.as_buffer(), kind)
        out[i, : len(v)] = v
    return _normal(out) if len(out) else out


def similar_vectors(
    vectors: DataFrame, least: float = LEAST, tables: int | None = None, probes: int = PROBES, id_col: str = "vec_id", vector_col: str = "embedding", part: int = PART, hashes: int | None = None
) -> DataFrame:
    """vec_id, n_links, component_id, kept for every row of vectors.

    hashes and tables follow from the number of vectors, such that RECALL of the links at least is found at every size.

    Links have a cosine of least or more in double precision.  A vector that is null, empty, zero or holds a null or
    non-finite component links with nothing.  Vectors equal in every component are one class, whose members all link.
    A shorter vector counts as padded with zeros.  Rows repeated with one id are rows like others and link as copies;
    a component of null ids only has a null component_id.  Other columns are ignored; no rows give no rows.
    """
    spark = vectors.sparkSession
    ship(spark)
    scratch = Scratch(spark, "vectors")
    single = dict(vectors.dtypes)[vector_col] == "array<float>"
    kind = "<f4" if single else "<f8"  # components travel as they came
    rows = vectors.select(F.col(id_col).cast("long").alias("vec_id"), F.col(vector_col).cast("array<float>" if single else "array<double>").alias("embedding"))

    def units(batches):
        for b in batches:
            for at in range(0, b.num_rows, 4096):
                piece = b.slice(at, 4096)
                x = _dense(piece.column(1))
                good = np.flatnonzero(np.isfinite(x).all(1) & (x != 0).any(1))
                sig, data = (np.full(len(x), None, object) for _ in range(2))
                sig[good] = [hashlib.blake2b(np.trim_zeros(u, "b").tobytes(), digest_size=16).hexdigest() for u in _normal(x[good])]
                data[good] = [np.trim_zeros(u, "b").tobytes() for u in x[good].astype(kind)]
                yield pa.RecordBatch.from_arrays([piece.column(0), pa.array(sig, pa.string()), pa.array(data, pa.binary())], ["vec_id", "sig", "unit"])

    all_ = scratch.write(rows.mapInArrow(units, "vec_id long, sig string, unit binary"))
    size = all_.agg(F.max(F.octet_length("unit")).alias("w")).first()["w"] or 8
    width = max(1, size // np.dtype(kind).itemsize)
    classes = scratch.write(all_.where("sig is not null").groupBy("sig").agg(F.count(F.lit(1)).alias("weight"), F.first("unit").alias("unit")))
    number = classes.count()
    dims = 1 << max(1, int(width - 1).bit_length())
    hashes = hashes or max(1, round(np.log(max(1, number / PER_BUCKET)) / np.log(2 * dims) + 0.25))
    tables = tables or tables_for(dims, hashes, least, probes)

    def matrix(column):
        return _packed(column, width, kind)

    def hashed(batches):
        for b in batches:
            for at in range(0, b.num_rows, 4096):
                piece = b.slice(at, 4096)
                keys = buckets(matrix(piece.column(1)), hashes, tables, probes).reshape(piece.num_rows, -1)
                yield pa.RecordBatch.from_arrays([piece.column(0), pa.array(keys.tolist(), pa.list_(pa.int64()))], ["sig", "keys"])

    keyed = scratch.write(classes.select("sig", "unit").mapInArrow(hashed, "sig string, keys array<long>"))
    entries = keyed.select("sig", F.explode(F.array_distinct("keys")).alias("bucket"))
    sizes = scratch.write(entries.groupBy("bucket").agg(F.count(F.lit(1)).alias("m")).where("m > 1"))
    parts = F.ceil(F.col("m") / F.lit(part)).cast("int")
    mine = F.pmod(seeded(4, "sig"), parts).cast("int")
    # every pair of parts once, each member in all pairs that hold its part
    pairs = F.transform(F.sequence(F.lit(0), parts - 1), lambda k: F.struct(F.least(k, mine).alias("low"), F.greatest(k, mine).alias("high")))
    met = entries.join(sizes, "bucket").select("sig", "bucket", mine.alias("side"), F.explode(pairs).alias("pair"))
    met = met.select("sig", "bucket", "side", "pair.low", "pair.high")
    full = met.join(classes, "sig").join(keyed, "sig")
    shuffles = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-number * tables * (1 + probes) // 40_000))

    def compare(batches):
        held = [b for b in batches if b.num_rows]
        if not held:
            return
        t = pa.Table.from_batches(held)
        cols = [t.column(c).to_numpy() for c in ("bucket", "low", "high", "side")]
        order = np.lexsort(cols[2::-1])
        cols = [c[order] for c in cols]
        change = np.ones(len(order), bool)
        change[1:] = (cols[0][1:] != cols[0][:-1]) | (cols[1][1:] != cols[1][:-1]) | (cols[2][1:] != cols[2][:-1])
        begin = np.append(np.flatnonzero(change), len(order))
        sig, unit = t.column("sig").combine_chunks(), t.column("unit").combine_chunks()
        keys = t.column("keys").combine_chunks().flatten().to_numpy().reshape(-1, tables, 1 + probes)
        weight = t.column("weight").to_numpy()
        found, joined = {}, []
        for a, b in zip(begin[:-1], begin[1:]):
            if b - a < 2:
                continue
            run = order[a:b]
            links, forest = compare_bucket(matrix(unit.take(pa.array(run))), keys[run], weight[run], cols[3][a:b], bool(cols[1][a] != cols[2][a]), int(cols[0][a]), least)
            for i in np.flatnonzero(links):
                found[run[i]] = found.get(run[i], 0) + int(links[i])
            joined += [(run[i], run[j]) for i, j in forest]
        name = lambda at: sig.take(pa.array(np.array(at, np.int64)))
        none = pa.nulls(len(found), pa.string())
        yield pa.RecordBatch.from_arrays([name(list(found)), none, pa.array(list(found.values()), pa.int64())], ["a", "b", "n"])
        yield pa.RecordBatch.from_arrays([name([i for i, _ in joined]), name([j for _, j in joined]), pa.nulls(len(joined), pa.int64())], ["a", "b", "n"])

    out = scratch.write(full.repartition(shuffles, "bucket", "low", "high").mapInArrow(compare, "a string, b string, n long"))
    counts = out.where("b is null").groupBy("a").agg(F.sum("n").alias("others"))
    comps = connected_components(scratch, out.where("b is not null").select("a", "b").distinct())
    known = classes.select("sig", "weight").join(counts, F.col("sig") == F.col("a"), "left").join(comps, F.col("sig") == F.col("node"), "left")
    known = scratch.write(known.select("sig", (F.col("weight") - 1 + F.coalesce("others", F.lit(0))).alias("n_links"), F.coalesce("component", "sig").alias("component")))
    named = scratch.write(all_.select("vec_id", "sig").join(known, "sig", "left"))
    least_id = scratch.write(named.where("sig is not null").groupBy("component").agg(F.min("vec_id").alias("component_id")))
    some = named.where("sig is not null").join(least_id, "component").select("vec_id", "n_links", "component_id")
    none = named.where("sig is null").select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"))
    return some.unionByName(none).withColumn("kept", F.col("vec_id").eqNullSafe(F.col("component_id")))
