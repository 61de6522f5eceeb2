"""Tables of texts in, verdict tables and audit lines out; requests with patterns of their own are checked."""

from __future__ import annotations

import os
import re

from pyspark.sql import DataFrame, SparkSession

MOST_PATTERNS, LONGEST_PATTERN = 32, 512


def read_texts(spark: SparkSession, path: str, format: str = "parquet", columns: list[str] | None = None, **options) -> DataFrame:
    """A scan of parquet, json, csv or text; columns prune it."""
    df = spark.read.format(format).options(**options).load(path)
    if format == "text":
        df = df.withColumnRenamed("value", "text")
    return df.select(*columns) if columns else df


def spread(df: DataFrame, per_core: int = 64 << 20) -> DataFrame:
    """df dealt out to all cores where the scan holds less than per_core bytes for each of them.

    A small file has fewer row groups than the cluster has cores, and texts are dear to scan.  Larger inputs keep their
    splits and take no shuffle.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    held = int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    return df.repartition(cores) if held < per_core * cores else df


def write_table(df: DataFrame, path: str, format: str = "parquet", mode: str = "errorifexists") -> None:
    df.write.format(format).mode(mode).save(path)


def checked_patterns(patterns: dict[str, str]) -> dict[str, str]:
    """The patterns, if they are few, short and compile."""
    if len(patterns) > MOST_PATTERNS:
        raise ValueError(f"more than {MOST_PATTERNS} patterns")
    for label, p in patterns.items():
        if len(p) > LONGEST_PATTERN:
            raise ValueError(f"{label}: longer than {LONGEST_PATTERN}")
        re.compile(p)
    return dict(patterns)


def read_policy(path: str):
    """(policy, unknown keys) of a YAML or JSON file."""
    import json

    from sluice.plans.policy import Policy

    with open(path) as f:
        text = f.read()
    try:
        import yaml

        values = yaml.safe_load(text) or {}
    except ImportError:
        values = json.loads(text)
    return Policy.from_dict(values)


def setting(spark: SparkSession, name: str, default, values: dict | None = None):
    """A setting by precedence: environment SLUICE_NAME, spark.sluice.name, values of a file, default; one that does
    not fit the type of default is left aside."""
    kind = type(default)
    for raw in (os.environ.get(f"SLUICE_{name.upper()}"), spark.conf.get(f"spark.sluice.{name}", None), (values or {}).get(name)):
        if raw is not None:
            try:
                return str(raw).strip().lower() in ("1", "true", "yes") if kind is bool else kind(raw)
            except ValueError:
                continue
    return default
