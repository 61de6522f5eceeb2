"""Shared pieces: scratch tables in the shared folder, distributed ranks, connected components."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

#: Characters that separate words, as in every contract of this package.
SPACE = r"[\x20\x09-\x0D]+"
WORD = r"[^\x20\x09-\x0D]+"
ARROW_BYTES = "4m"
_ARROW_BOUND = "spark.sql.execution.arrow.maxBytesPerBatch"


def scratch_root(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir of the session.

    Only a local master may fall back to a folder of this machine.
    """
    root = spark.conf.get("spark.checkpoint.dir", None)
    if root:
        return root.rstrip("/")
    if not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-cluster"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    root = "file://" + tempfile.mkdtemp(prefix="sluice-")
    spark.conf.set("spark.checkpoint.dir", root)
    return root


class Scratch:
    """Tables written to the shared folder.  They cut lineage and outlive any executor."""

    def __init__(self, spark: SparkSession, name: str):
        self.spark = spark
        self.base = f"{scratch_root(spark)}/{name}-{uuid.uuid4().hex}"
        self.serial = 0

    def write(self, df: DataFrame, *partition_by: str) -> DataFrame:
        """Materialise df and return it as a scan; the schema is kept, so nothing is inferred."""
        self.serial += 1
        path = f"{self.base}/{self.serial}"
        writer = df.write
        if partition_by:
            writer = writer.partitionBy(*partition_by)
        writer.parquet(path)
        out = self.spark.read.schema(df.schema).parquet(path)
        out.scratch_path = path
        return out

    def drop(self, *tables: DataFrame) -> None:
        """Delete tables that no later plan reads."""
        for t in tables:
            path = self.spark._jvm.org.apache.hadoop.fs.Path(t.scratch_path)
            path.getFileSystem(self.spark._jsparkSession.sessionState().newHadoopConf()).delete(path, True)


def exact_rank(df: DataFrame, keys: list[str], bucket: str, order: list, rank: str) -> DataFrame:
    """Adds rank, gapless from 0 within keys, in the order of (bucket, order).

    No task sees more than one bucket of one key: counts by (keys, bucket) give each bucket its offset,
    and only the rows of a bucket are sorted together.  df must be cheap and safe to read twice.
    """
    counts = df.groupBy(*keys, bucket).agg(F.count(F.lit(1)).alias("__n"))
    before = Window.partitionBy(*keys).orderBy(bucket).rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select(*keys, bucket, F.coalesce(F.sum("__n").over(before), F.lit(0)).alias("__off"))
    inside = Window.partitionBy(*keys, bucket).orderBy(*order)
    numbered = df.withColumn("__rn", F.row_number().over(inside) - 1)
    on = [numbered[c].eqNullSafe(offsets[c]) for c in (*keys, bucket)]
    cond = on[0]
    for c in on[1:]:
        cond = cond & c
    return numbered.join(offsets, cond).select(*[numbered[c] for c in df.columns], (F.col("__off") + F.col("__rn")).alias(rank))


def buckets_for(rows: int, per_bucket: int = 20_000, most: int = 1 << 16) -> int:
    """How many buckets a rank needs so that each is sorted by one task."""
    return int(min(most, max(1, -(-rows // per_bucket))))


def connected_components(scratch: Scratch, edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, component): the smallest node that links reach.  Nodes without a link are not returned.

    Each round takes the least label among neighbours, then the label of that label, so chains halve.
    Hot nodes only meet in sums that start before the shuffle and in joins that AQE can split.
    Stops when a round changes nothing.
    """
    both = edges.select(F.col(a).alias("u"), F.col(b).alias("v")).where("u <> v")
    both = scratch.write(both.unionByName(both.select(F.col("v").alias("u"), F.col("u").alias("v"))).distinct())
    labels = scratch.write(both.groupBy("u").agg(F.min("v").alias("m")).select(F.col("u").alias("node"), F.least("u", "m").alias("component")))
    while True:
        heard = both.join(labels, both.v == labels.node).groupBy("u").agg(F.min("component").alias("near"))
        step = labels.join(heard, labels.node == heard.u).select("node", F.col("component").alias("was"), F.least("component", "near").alias("now"))
        jump = labels.select(F.col("node").alias("at"), F.col("component").alias("far"))
        step = step.join(jump, step.now == jump["at"], "left").select("node", "was", F.least("now", F.coalesce("far", "now")).alias("component"))
        new = scratch.write(step)
        moved = new.where("component <> was").limit(1).count()
        scratch.drop(labels)
        labels = new.select("node", "component")
        labels.scratch_path = new.scratch_path
        if not moved:
            return labels


def seeded(seed: int, *cols) -> Column:
    """A repeatable pseudo-random long for the given columns."""
    return F.xxhash64(F.lit(seed), *cols)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def whole(df: DataFrame, name: str = "row") -> Column:
    """All columns of a row as one struct, so that helper columns cannot clash with them."""
    return F.struct(*[F.col(f"`{c}`") for c in df.columns]).alias(name)


def _has_map(kind) -> bool:
    if isinstance(kind, T.ArrayType):
        return _has_map(kind.elementType)
    if isinstance(kind, T.StructType):
        return any(_has_map(f.dataType) for f in kind.fields)
    return isinstance(kind, (T.MapType, T.VariantType))


def comparable(df: DataFrame) -> Column:
    """All columns of a row as one struct that can be ordered and hashed: those with maps as JSON."""
    return F.struct(*[F.to_json(F.struct(F.col(f"`{f.name}`"))).alias(f.name) if _has_map(f.dataType) else F.col(f"`{f.name}`") for f in df.schema.fields])


def has_map(df: DataFrame) -> bool:
    """Whether a column of df can be neither ordered nor hashed."""
    return _has_map(df.schema)


def unwrap(df: DataFrame, like: DataFrame, name: str = "row") -> DataFrame:
    return df.select(*[F.col(f"{name}.`{c}`").alias(c) for c in like.columns])


def ship(spark: SparkSession) -> None:
    """Gives executors this package, once per context, as a zip that the driver serves.

    Arrow batches of the session take ARROW_BYTES at most, or one row, unless it sets a bound of its own: whole
    texts by the 10,000 would make batches as large as the texts are long, in the JVM and in Python.
    """
    if spark.conf.get(_ARROW_BOUND, None) is None:
        spark.conf.set(_ARROW_BOUND, ARROW_BYTES)
    context = spark.sparkContext
    if getattr(context, "_sluice_shipped", False):
        return
    import pathlib
    import zipfile

    import sluice

    top = pathlib.Path(sluice.__file__).parent
    if top.suffix == "" and top.is_dir():
        out = pathlib.Path(tempfile.mkdtemp(prefix="sluice-code-")) / "sluice_code.zip"
        with zipfile.ZipFile(out, "w") as z:
            for f in [top / "__init__.py", *sorted((top / "llm").glob("*.py"))]:
                z.write(f, f.relative_to(top.parent))
        context.addPyFile(str(out))
    context._sluice_shipped = True
