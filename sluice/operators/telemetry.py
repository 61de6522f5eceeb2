"""Aggregates over a log of screens: ts, gate, action, safe, category, latency_ms, pii."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Upper bounds of latency buckets, in seconds.
BUCKETS = (0.01, 0.05, 0.1, 0.5, 1.0, 5.0)


def p95(values: Column) -> Column:
    """The exact value at place floor(0.95 n) of the sorted values; 0 for five or fewer.  For bounded groups."""
    n = F.size(values)
    return F.when(n > 5, F.element_at(F.array_sort(values), F.floor(n * F.lit(0.95)).cast("int") + 1)).otherwise(F.lit(0.0))


def stats(log: DataFrame, keys: list[str] = (), exact: bool = False) -> DataFrame:
    """total, passed, blocked, masked, pii, block_rate, pii_rate, avg_latency_ms, p95_latency_ms by keys."""
    total, blocked, pii = F.count(F.lit(1)), F.count_if(F.col("action") == "block"), F.count_if("pii")
    late = F.when(F.col("latency_ms") > 0, F.col("latency_ms"))
    high = p95(F.collect_list(late)) if exact else F.coalesce(F.percentile_approx(late, 0.95), F.lit(0.0))
    return log.groupBy(*keys).agg(
        total.alias("total"),
        F.count_if(F.col("action") == "pass").alias("passed"),
        blocked.alias("blocked"),
        F.count_if(F.col("action") == "mask").alias("masked"),
        pii.alias("pii"),
        F.round(100 * blocked / total, 1).alias("block_rate"),
        F.round(100 * pii / total, 1).alias("pii_rate"),
        F.coalesce(F.avg(late), F.lit(0.0)).alias("avg_latency_ms"),
        high.alias("p95_latency_ms"),
    )


def last(log: DataFrame, n: int = 200) -> DataFrame:
    """The newest screens first."""
    return log.orderBy(F.desc("ts"), F.desc("id")).limit(n)


def counter(log: DataFrame, labels: list[str], value: Column | None = None) -> DataFrame:
    return log.groupBy(*labels).agg(F.sum(value if value is not None else F.lit(1)).alias("value"))


def histogram(log: DataFrame, labels: list[str], seconds: Column) -> DataFrame:
    """Cumulative counts by bucket, sum and count by labels."""
    sums = [F.count_if(seconds <= b).alias(f"le_{str(b).replace('.', '_')}") for b in BUCKETS]
    return log.groupBy(*labels).agg(*sums, F.count(F.lit(1)).alias("le_inf"), F.sum(seconds).alias("sum"), F.count(seconds).alias("count"))


def exposition(counts: DataFrame, name: str, labels: list[str]) -> DataFrame:
    """Lines of the text format of metrics."""
    pairs = F.concat_ws(",", *[F.concat(F.lit(f'{c}="'), F.coalesce(F.col(c).cast("string"), F.lit("")), F.lit('"')) for c in labels])
    return counts.select(F.concat(F.lit(name + "{"), pairs, F.lit("} "), F.col("value").cast("string")).alias("line"))


def windows(log: DataFrame, width: str = "10 minutes", late: str = "1 hour") -> DataFrame:
    """Counts by event-time window and action; over a stream, with a watermark."""
    return log.withWatermark("ts", late).groupBy(F.window("ts", width), "action").agg(F.count(F.lit(1)).alias("n")).select(F.col("window.start").alias("start"), "action", "n")
