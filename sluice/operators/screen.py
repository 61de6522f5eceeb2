"""Composite screening of a DataFrame of texts: one projection from text and gate to a verdict."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sluice.functions import fixed as K
from sluice.functions import pii as P
from sluice.functions import text as X


@dataclass(frozen=True)
class Screening:
    """What a screen does.

    classifier (text -> probability of harm), slow (text -> whether it is safe, or null) and recogniser (text ->
    entities) are Column functions of models.  They get null in place of texts that earlier gates have blocked.
    Without them those gates are rules only.  A classifier without an answer blocks, unless fail_open.
    """

    scan_injection: bool = True
    pii_enabled: bool = True
    pii_labels: tuple = tuple(K.PII_LABELS)
    pii_action: str = "mask"
    pii_threshold: float = K.THRESHOLD
    output_pii: bool = True
    deny: tuple = ()
    allow: tuple = tuple(K.GREETINGS)
    custom_patterns: dict = field(default_factory=dict)
    context_words: dict = field(default_factory=dict)
    block_on_unsafe_input: bool = True
    block_on_unsafe_output: bool = True
    min_confidence: float = 0.0
    cascade_mode: str = "safety"
    fail_open: bool = False
    classifier: object = None
    classifier_category: str | None = "unsafe"
    slow: object = None
    recogniser: object = None


_built: dict = {}


def _once(key, build) -> Column:
    """build(), kept for the next screen of this JVM: thousands of expression nodes take seconds to put together."""
    from pyspark import SparkContext

    key = (id(SparkContext._active_spark_context), repr(key))
    if key not in _built:
        _built[key] = build()
    return _built[key]


#: Fixed value: turns of a history.
WINDOW = 6
#: Fields of a policy that a row may bring along, as resolve() gives them.
BY_ROW = ("pii_enabled", "pii_action", "pii_threshold", "block_on_unsafe_input", "block_on_unsafe_output", "cascade_mode", "fail_open")


def screen(
    df: DataFrame, policy: Screening = Screening(), text: str = "text", gate: str = "gate", policy_col: str | None = None, allowed: Column | None = None, route: Column | None = None, out: str = "screen"
) -> DataFrame:
    """df with a struct out: action, safe, blocked, category, block_category, categories, confidence, reason, path,
    degraded, entities, has_pii, text (masked where the action is mask), enforced, gates_run.  None of action, safe,
    blocked, enforced and degraded is ever null; a column that is called out already is replaced.

    Order: injection (input gates, high and medium), validation, keywords on the raw text, normalisation, classifier
    and personal data on the normalised text, scope, routes.  The first of the first three that blocks ends the chain.
    policy_col: a struct of resolve(), whose fields stand in for those of policy, row by row.  allowed: whether a text
    is in scope (null: it is); route: a struct (matched, route_name, action) as with_routes() gives it.
    Each step is a projection of its own, so nothing is computed twice.
    """
    kept = [c for c in df.columns if c != out]
    none = F.lit(None)
    first = {
        "row": F.struct(*[F.col(f"`{c}`") for c in kept]),
        "raw": F.coalesce(F.col(text), F.lit("")),
        "gate": F.coalesce(F.col(gate), F.lit("input")) if gate in df.columns else F.lit("input"),
        "allowed": F.coalesce(allowed, F.lit(True)) if allowed is not None else F.lit(True),
        "route": F.struct(*[F.coalesce(route["matched"], F.lit(False)).alias("matched"), route["route_name"].alias("name"), route["action"].alias("action")])
        if route is not None
        else F.struct(F.lit(False).alias("matched"), none.cast("string").alias("name"), none.cast("string").alias("action")),
        "own": F.struct(*[(F.coalesce(F.col(f"`{policy_col}`")[k], F.lit(getattr(policy, k))) if policy_col else F.lit(getattr(policy, k))).alias(k) for k in BY_ROW]),
    }
    if policy_col:
        first["labels"] = F.coalesce(F.col(f"`{policy_col}`")["pii_entities"], F.array(*[F.lit(x) for x in policy.pii_labels]))
    d = df.select(*[c.alias(k) for k, c in first.items()])
    c = F.col
    input_ = c("gate").isin(K.INPUT_GATES)
    if policy.scan_injection:
        d = X.with_injection(d, "raw", "found")
    else:
        d = d.withColumn("found", none.cast("struct<detected:boolean,severity:string,matched_pattern:string>"))
    d = d.withColumn("stop", F.coalesce(X.injection_blocks(c("gate"), c("found")), F.lit(False)))
    d = d.withColumn("reason", F.when(~c("stop"), _once("reason", lambda: X.validation_reason(c("raw")))))
    d = d.withColumn("word", F.when(~c("stop") & c("reason").isNull(), _once("raw", lambda: X.keyword_match(c("raw")))))
    d = d.withColumn("open", ~c("stop") & c("reason").isNull() & c("word").isNull())
    d = d.withColumn("form", X.nfkc(X.strip_invisible(F.when(c("open"), c("raw")))))
    d = d.withColumn("text", _once("form", lambda: X.after_nfkc(c("form")))).drop("form")
    d = d.withColumn("again", F.when(c("open"), _once("text", lambda: X.keyword_match(c("text"))))["category"])
    # models see what is still open only
    d = d.withColumn("prob", policy.classifier(c("text")).cast("double") if policy.classifier else none.cast("double"))
    d = d.withColumn("slow", policy.slow(c("text")).cast("boolean") if policy.slow else none.cast("boolean"))
    if policy.recogniser:
        d = d.withColumn("recognised", F.coalesce(policy.recogniser(c("text")), F.array().cast(P.ENTITIES)))
    if policy.pii_enabled or policy_col:
        wanted = c("open") & c("own.pii_enabled") & (input_ | F.lit(policy.output_pii))
        labels = list(policy.pii_labels) if not policy_col else None
        more = (list(policy.deny), list(policy.allow), policy.custom_patterns, policy.context_words)
        model, only = c("recognised") if policy.recogniser else None, c("labels") if policy_col else None
        key = ("pii", labels, more, bool(policy.recogniser), bool(policy_col))
        found = _once(key, lambda: P.detect(c("text"), labels, c("own.pii_threshold"), *more, model, only))
        d = d.withColumn("entities", F.when(wanted, found).otherwise(F.array().cast(P.ENTITIES)))
    else:
        wanted = F.lit(False)
        d = d.withColumn("entities", F.array().cast(P.ENTITIES))
    if policy.classifier:
        verdict = X.cascade(c("prob"), c("own.cascade_mode"), c("slow"), c("own.fail_open"))
        d = d.withColumn("verdict", F.when(c("open") & c("again").isNull(), verdict))
    else:
        d = d.withColumn("verdict", none.cast("struct<safe:boolean,path:string>"))
    doubted = ~F.coalesce(c("verdict.safe"), F.lit(True)) & F.coalesce(c("prob") >= policy.min_confidence, F.lit(True))
    d = d.withColumn("harm", F.coalesce(doubted, F.lit(True)))
    d = d.withColumn("unsafe", ~c("open") | c("again").isNotNull() | c("harm"))
    d = d.withColumn("has", F.size("entities") > 0)
    outside, routed = c("open") & ~c("allowed"), c("open") & c("route.matched")
    act = F.when(routed & (c("route.action") == "block"), "block").otherwise(X.action(~outside, ~c("unsafe"), c("has"), c("own.pii_action")))
    d = d.withColumn("action", act)
    category = F.when(c("stop"), "injection").when(c("reason").isNotNull(), "S0").otherwise(F.coalesce(c("word.category"), c("again"), F.when(c("harm"), F.lit(policy.classifier_category))))
    d = d.withColumn("category", category)
    by_class = F.when(input_, c("own.block_on_unsafe_input")).otherwise(c("own.block_on_unsafe_output"))
    enforced = c("stop") | outside | F.coalesce(routed & (c("route.action") == "block"), F.lit(False)) | (c("unsafe") & by_class) | (c("has") & (c("own.pii_action") == "block"))
    rest = ~c("stop") & c("reason").isNull()
    ran = [(input_ & F.lit(policy.scan_injection), "injection"), (~c("stop"), "validation"), (rest, "keyword"), (c("open"), "normalize")]
    ran += [(c("verdict").isNotNull(), "classify"), (wanted, "pii"), (c("open") & F.lit(allowed is not None), "scope"), (c("open") & F.lit(route is not None), "route")]
    result = F.struct(
        "action",
        (~c("unsafe")).alias("safe"),
        (c("action") == "block").alias("blocked"),
        "category",
        F.coalesce("category", F.when(outside, "scope"), F.when(routed, c("route.name"))).alias("block_category"),
        F.array_compact(F.array("category")).alias("categories"),
        F.coalesce("prob", F.lit(1.0)).alias("confidence"),
        F.coalesce("reason", "found.matched_pattern").alias("reason"),
        c("verdict.path").alias("path"),
        F.coalesce(c("verdict.path").isin("fail_open", "fail_closed"), F.lit(False)).alias("degraded"),
        "entities",
        c("has").alias("has_pii"),
        F.when(c("action") == "mask", _once("mask", lambda: P.mask(c("text"), c("entities")))).otherwise(c("raw")).alias("text"),
        # always true, and not deterministic to the optimiser, which else pushes filters on the verdict through all steps,
        # each step's expression put in place of its name, until the plan holds millions of them
        (F.coalesce(enforced, F.lit(True)) & (F.spark_partition_id() >= 0)).alias("enforced"),
        F.array_compact(F.array(*[F.when(x, F.lit(name)) for x, name in ran])).alias("gates_run"),
    )
    return d.select(*[c(f"row.`{k}`").alias(k) for k in kept], result.alias(out))


def enforce(screened: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(rows that pass, rows that violate), of the result of screen(); a row without a verdict violates."""
    stop = F.coalesce(F.col("screen.enforced"), F.lit(True))
    return screened.where(~stop), screened.where(stop)


def violations(screened: DataFrame, key: str, gate: str = "gate") -> DataFrame:
    """(key, gate, category, labels, description) of the rows that violate; personal data alone give the category pii
    and their labels, distinct and in order."""
    rows = enforce(screened)[1]
    data = F.coalesce(F.col("screen.has_pii"), F.lit(False)) & F.col("screen.block_category").isNull()
    labels = F.when(data, F.array_sort(F.array_distinct(F.transform("screen.entities", lambda e: e["label"]))))
    category = F.when(data, "pii").otherwise(F.col("screen.block_category"))
    found = F.concat(F.size("screen.entities").cast("string"), F.lit(" entities: "), F.array_join(labels, ", "))
    return rows.select(key, gate, category.alias("category"), labels.alias("labels"), F.when(data, found).otherwise(F.col("screen.reason")).alias("description"))


def classify(df: DataFrame, policy: Screening, text: str = "text") -> DataFrame:
    """df with struct verdict (safe, path): normalised text and classifier alone, without personal data."""
    d = df.withColumn("__norm", X.normalize(F.coalesce(F.col(text), F.lit("")))).withColumn("__prob", policy.classifier(F.col("__norm")).cast("double"))
    slow = policy.slow(F.col("__norm")) if policy.slow else None
    return d.withColumn("verdict", X.cascade(F.col("__prob"), policy.cascade_mode, slow, policy.fail_open)).drop("__norm", "__prob")


def cascade_stats(verdicts: DataFrame, path: str = "path") -> DataFrame:
    """(path, n, pct) of a cascade, in per cent with one decimal."""
    counts = verdicts.groupBy(F.col(path).alias("path")).agg(F.count(F.lit(1)).alias("n"))
    total = verdicts.agg(F.count(F.lit(1)).alias("total"))
    return counts.join(F.broadcast(total), F.lit(True)).select("path", "n", F.round(100 * F.col("n") / F.col("total"), 1).alias("pct"))  # total: one row


def first_unsafe(screened: DataFrame, key: str, order: str) -> DataFrame:
    """For each key the verdict of the first unsafe message in order; none where all are safe."""
    return screened.where(~F.col("screen.safe")).groupBy(key).agg(F.min_by("screen", order).alias("screen"), F.min(order).alias(order))


def audit(screened: DataFrame, detailed: bool = False, text: str = "text") -> DataFrame:
    """One JSON line per screen; the text only as a digest, and in detail a preview of 200 characters."""
    fields = [F.lit("screen").alias("event"), F.col("screen.action").alias("action"), F.col("screen.safe").alias("safe"), F.col("screen.category").alias("category"), F.size("screen.entities").alias("pii_count"), F.substring(F.sha2(F.col(text), 256), 1, 16).alias("digest")]
    if detailed:
        fields.append(F.substring(text, 1, 200).alias("preview"))
    return screened.select(F.to_json(F.struct(*fields)).alias("line"))


def conversation_payloads(turns: DataFrame, window: int = WINDOW, limit: int = 16_000, key: str = "conv_id", order: str = "turn") -> DataFrame:
    """turns with gate and payload: the last window turns as [ROLE] text and then the new text, the oldest dropped
    until limit characters hold them.  For histories in which nothing is blocked; see conversation() for the others."""
    from pyspark.sql.window import Window

    w = Window.partitionBy(key).orderBy(order).rowsBetween(-window, -1)
    past = F.collect_list(F.concat(F.lit("["), F.upper("role"), F.lit("] "), F.coalesce("text", F.lit("")))).over(w)
    parts = F.concat(past, F.array(F.coalesce("text", F.lit(""))))
    n = F.size(parts)
    # the longest tail within the limit, the new text at least
    fits = F.filter(F.sequence(F.lit(1), n), lambda k: (F.length(F.array_join(F.slice(parts, k, n), "\n")) <= limit) | (k == n))
    gate = F.when(F.col("role") == "user", "input").when(F.col("role") == "system", "prompt").otherwise("output")
    return turns.withColumns({"gate": gate, "payload": F.array_join(F.slice(parts, F.array_min(fits), n), "\n")})


def conversation(turns: DataFrame, verdict, window: int = WINDOW, limit: int = 16_000, store_assistant: bool = True, key: str = "conv_id", order: str = "turn", screened: str | None = None) -> DataFrame:
    """(key, order, gate, payload, blocked) by an ordered fold for each conversation: a blocked turn leaves no trace.

    verdict: payload, gate -> whether it is blocked, as a Python function.  screened: a boolean column; a turn where it
    is false joins the history as it is, whatever its role, and is not blocked.
    """
    import pandas as pd

    types = dict(turns.dtypes)

    def fold(pdf: pd.DataFrame) -> pd.DataFrame:
        held, out = [], []
        for r in pdf.sort_values(order).itertuples():
            gate = {"user": "input", "system": "prompt"}.get(r.role, "output")
            parts = [*held, r.text or ""]
            while len(parts) > 1 and len("\n".join(parts)) > limit:
                parts.pop(0)
            payload = "\n".join(parts)
            own = screened is not None and not getattr(r, screened)
            blocked = not own and bool(verdict(payload, gate))
            if own or not blocked and (r.role == "user" or store_assistant):
                held = [*held, f"[{r.role.upper()}] {r.text or ''}"][-window:]
            out.append((getattr(r, key), getattr(r, order), gate, payload, blocked))
        return pd.DataFrame(out, columns=[key, order, "gate", "payload", "blocked"])

    return turns.select(key, order, "role", "text", *([screened] if screened else [])).groupBy(key).applyInPandas(fold, f"{key} {types[key]}, {order} {types[order]}, gate string, payload string, blocked boolean")
