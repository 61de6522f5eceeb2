"""Escalation of uncertain verdicts to a slow model, with a circuit breaker."""

from __future__ import annotations

import time
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sluice.functions import text as X

#: Failures in a row that open a breaker, and the seconds that it stays open.
FAILURES, PAUSE = 3, 60.0
#: Backends of a classifier, the first available one is taken.
PREFERENCE = ["cascade", "onnx", "llamaguard"]


class Breaker:
    """Calls of a model that are left out for pause seconds after failures in a row; one for each task."""

    def __init__(self, call: Callable, failures: int = FAILURES, pause: float = PAUSE, clock=time.monotonic):
        self.call, self.failures, self.pause, self.clock = call, failures, pause, clock
        self.failed, self.until = 0, float("-inf")

    def __call__(self, text: str, must: bool = False):
        """(answer or None, how it ended); must: ask though the breaker is open."""
        if not must and self.clock() < self.until:
            return None, "breaker"
        try:
            answer = self.call(text)
        except Exception:  # whatever a model raises counts as its failure
            self.failed += 1
            if self.failed >= self.failures:
                self.until = self.clock() + self.pause
            return None, "failed"
        self.failed = 0
        return bool(answer), "answered"


def escalate(df: DataFrame, model: Callable, text: str = "text", prob: str = "prob", mode: str = "safety", fail_open: bool = False, failures: int = FAILURES, pause: float = PAUSE) -> DataFrame:
    """df with struct verdict (safe, path): that of the cascade, with the slow model asked where the fast one is unsure.

    model: text -> whether it is safe, a Python function that may raise.  It is asked of texts that are not null and
    whose probability is neither above 0.85 nor, for speed, below 0.15.  Without its answer the fast verdict counts;
    where there is none either, fail_open decides, and then an open breaker does not keep it from being asked.
    """

    @F.pandas_udf("struct<safe:boolean,ended:string>")
    def ask(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.DataFrame]:
        breaker = Breaker(model, failures, pause)
        for texts, known in batches:
            got = [breaker(t, not k) if t is not None else (None, None) for t, k in zip(texts, known)]
            yield pd.DataFrame({"safe": pd.Series([g[0] for g in got], dtype="object"), "ended": pd.Series([g[1] for g in got], dtype="object")})

    sure = F.coalesce(F.col(prob) > 0.85, F.lit(False))
    if mode == "speed":
        sure = sure | F.coalesce(F.col(prob) < 0.15, F.lit(False))
    asked = df.withColumn("__asked", ask(F.when(~sure, F.col(text)), F.col(prob).isNotNull()))
    verdict = X.cascade(F.col(prob), mode, F.col("__asked.safe"), fail_open)
    path = F.when((verdict["path"] == "fast_fallback") & (F.col("__asked.ended") == "breaker"), "escalation_skipped_breaker").when(
        (verdict["path"] == "fast_fallback") & (F.col("__asked.ended") == "failed"), "escalation_failed_fast_fallback"
    )
    out = F.struct(verdict["safe"].alias("safe"), F.coalesce(path, verdict["path"]).alias("path"))
    return asked.withColumn("verdict", out).drop("__asked")


def preferred(backends: dict) -> object | None:
    """The classifier to use of those by name that there are: by PREFERENCE, else the first."""
    return next((backends[k] for k in PREFERENCE if k in backends), next(iter(backends.values()), None))
