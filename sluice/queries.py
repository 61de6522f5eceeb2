"""The registered queries of the screening operators, over whole tables, and SQL that gives the same rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sluice.functions import fixed as K
from sluice.functions import pii as P
from sluice.functions import text as X
from sluice.operators import grounding, screen, telemetry, vectors
from sluice.plans import policy
from sluice.sources.tables import spread
from sluice.streaming import segments


def _t(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


def _docs(spark: SparkSession, d: str) -> DataFrame:
    return spread(_t(spark, d, "documents"))


def _injection(spark, d):
    return X.with_injection(_docs(spark, d).select("doc_id", "text"), "text", "i").select("doc_id", "i.detected", "i.severity", "i.matched_pattern", F.size("i.matches").alias("n_matches"))


def _validate(spark, d):
    return _docs(spark, d).select("doc_id", X.validation_reason(F.col("text")).alias("reason"))


def _keywords(spark, d):
    rows = _t(spark, d, "conversations").select("conv_id", "turn", X.keyword_match(F.col("text")).alias("k"))
    return rows.select("conv_id", "turn", F.col("k.category").alias("category"))


def _normalize(spark, d):
    return _docs(spark, d).select("doc_id", X.normalize(F.col("text")).alias("normalized"))


def _pii(spark, d):
    rows = _docs(spark, d).select("doc_id", F.explode(P.detect(F.col("text"), threshold=0.5)).alias("e"))
    return rows.select("doc_id", "e.label", "e.text", "e.score", "e.start", "e.end")


def _pii_labels(spark, d):
    rows = _docs(spark, d).select("doc_id", F.explode(P.regex_entities(F.col("text"), ["email", "ip_address", "aws_key"])).alias("e"))
    return rows.groupBy("doc_id", F.col("e.label").alias("label")).agg(F.count(F.lit(1)).alias("n"))


def _mask(spark, d):
    return _docs(spark, d).select("doc_id", P.mask(F.col("text"), P.detect(F.col("text"))).alias("masked"))


def _vault(spark, d):
    rows = _docs(spark, d).select(F.col("source").alias("session"), "text", P.detect(F.col("text")).alias("entities"))
    return P.vault_entries(rows, "text", "entities", "session", "salt").groupBy("session", "label").agg(F.count(F.lit(1)).alias("values"))


def _screen(spark, d):
    rows = screen.screen(_docs(spark, d).select("doc_id", "text").withColumn("gate", F.lit("input")))
    return rows.select("doc_id", "screen.action", "screen.category", "screen.reason", F.size("screen.entities").alias("n_entities"), F.length("screen.text").alias("n_chars"))


def _conversation(spark, d):
    rows = screen.conversation_payloads(_t(spark, d, "conversations"))
    return rows.select("conv_id", "turn", "gate", F.length("payload").alias("payload_chars"), F.sha2("payload", 256).alias("payload_sha"))


def _topics(spark, d):
    rows = _t(spark, d, "embeddings")
    return vectors.mean_vector(rows, ["label"], "embedding").select(F.col("label").alias("ix"), F.col("label").cast("string").alias("topic"), "centroid")


def _scope(spark, d):
    q = _t(spark, d, "embeddings").select(F.col("vec_id").alias("id"), vectors.l2(F.col("embedding")).alias("vec"))
    return vectors.best_topic(q, _topics(spark, d)).select("id", "topic", F.round("similarity", 6).alias("similarity"))


def _bm25(spark, d):
    corpus = _t(spark, d, "benchmark").select(F.col("item_id").alias("did"), "text")
    queries = _t(spark, d, "conversations").where("role = 'user'").select((F.col("conv_id") * 1000 + F.col("turn")).alias("qid"), "text")
    rows = vectors.bm25(queries, corpus)
    return rows.select("qid", "did", F.round("score", 6).alias("score"))


def _sentences(spark, d):
    return _docs(spark, d).select("doc_id", F.posexplode(grounding.sentences(F.col("text"))).alias("ix", "sentence"))


def _claims(spark, d):
    return _t(spark, d, "conversations").where("role = 'assistant'").select("conv_id", "turn", F.posexplode(grounding.claims(F.col("text"))).alias("ix", "claim"))


def _policies(spark, d):
    import itertools

    rows = list(itertools.product(*[policy.PROFILES[k] for k in policy.LAYERS]))
    done = policy.resolve(spark.createDataFrame(rows, ", ".join(f"{k} string" for k in policy.LAYERS)))
    return done.select(*policy.LAYERS, "policy.pii_action", "policy.pii_threshold", "policy.cascade_mode", "policy.timeout", F.array_join("policy.blocked_categories", ",").alias("blocked"))


def _log(spark, d):
    """A log of screens from the event table."""
    e = _t(spark, d, "events")
    act = F.when(F.col("event_id") % 10 == 0, "block").when(F.col("event_id") % 10 == 1, "mask").otherwise("pass")
    return e.select(F.col("event_id").alias("id"), "ts", F.col("event_type").alias("gate"), act.alias("action"), F.abs("value").alias("latency_ms"), (F.col("event_id") % 7 == 0).alias("pii"))


def _stats(spark, d):
    rows = telemetry.stats(_log(spark, d), ["gate"])
    return rows.select("gate", "total", "passed", "blocked", "masked", "pii", F.round("avg_latency_ms", 6).alias("avg_latency_ms"))


def _histogram(spark, d):
    rows = telemetry.histogram(_log(spark, d), ["gate", "action"], F.col("latency_ms") / 1000)
    return rows.withColumn("sum", F.round("sum", 6))


def _windows(spark, d):
    return telemetry.windows(_log(spark, d)).select(F.date_format("start", "yyyy-MM-dd HH:mm:ss").alias("start"), "action", "n")


def _segments(spark, d):
    c = _t(spark, d, "conversations").select(F.col("conv_id").cast("string").alias("stream_id"), F.col("turn").alias("seq"), F.col("text").alias("chunk"), F.lit(False).alias("is_final"))
    return segments.segments(c).select("stream_id", "segment", F.length("text").alias("n_chars"), "is_final")


def _verdicts(spark, d):
    """Verdict parsing over replies made from the label table."""
    raw = F.when(F.col("toxic") == 1, F.concat(F.lit("Safety: Unsafe\nS"), (F.col("doc_id") % 14 + 1).cast("string"))).when(F.col("quality") == 1, "**Safe.**").otherwise("not sure")
    v = _t(spark, d, "labels").select("doc_id", X.parse_verdict(raw).alias("v"))
    return v.select("doc_id", "v.safe", "v.category")


def _categories(spark, d):
    names = [*K.CATEGORY_ALIASES, "Self-Harm", "sexual content", "s7", "other"]
    return spark.createDataFrame([(n,) for n in names], "name string").select("name", X.resolve_category(F.col("name")).alias("code"))


def queries() -> dict:
    return {
        "validate_input": _validate,
        "injection_scan": _injection,
        "keyword_gate": _keywords,
        "normalize_text": _normalize,
        "pii_entities": _pii,
        "pii_label_counts": _pii_labels,
        "pii_mask": _mask,
        "pii_vault": _vault,
        "screen": _screen,
        "conversation_payloads": _conversation,
        "topic_centroids": lambda s, d: _topics(s, d).select("ix", F.round(F.aggregate("centroid", F.lit(0.0), lambda a, x: a + x), 6).alias("total")),
        "scope_best_topic": _scope,
        "bm25_scores": _bm25,
        "grounding_sentences": _sentences,
        "grounding_claims": _claims,
        "policy_resolution": _policies,
        "telemetry_stats": _stats,
        "telemetry_histogram": _histogram,
        "telemetry_windows": _windows,
        "stream_segments": _segments,
        "verdict_parse": _verdicts,
        "category_names": _categories,
    }


def _q(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def _sql_injection() -> str:
    items = ", ".join(
        f"case when regexp_matches(text, {_q(p)}) then {{'l': {_q(label)}, 's': {K.SEVERITY[s]}, 'i': {i}}} end" for i, (p, label, s) in enumerate(K.INJECTION)
    )
    return f"""
with m as (select doc_id, list_filter([{items}], lambda x: x is not null) as m from documents),
b as (select doc_id, len(m) as n, list_sort(list_transform(m, lambda x: {{'s': -x.s, 'i': x.i, 'l': x.l}}))[1] as b from m)
select doc_id, n > 0 as detected, case -b.s when 3 then 'high' when 2 then 'medium' when 1 then 'low' end as severity,
  b.l as matched_pattern, n as n_matches from b
"""


_LOG = """
log as (select event_id as id, ts, event_type as gate,
  case when event_id % 10 = 0 then 'block' when event_id % 10 = 1 then 'mask' else 'pass' end as action,
  abs(value) as latency_ms, event_id % 7 = 0 as pii from events)
"""


def oracle_sql() -> dict[str, str]:
    kw = " ".join(f"when regexp_matches(text, {_q('(?is)' + p)}) then {_q(c)}" for p, c in K.KEYWORDS)
    ex = " or ".join(f"regexp_matches(text, {_q('(?i)' + p)})" for p in K.KEYWORD_EXCLUSIONS)
    alias = " ".join(f"when {_q(k)} then {_q(v)}" for k, v in K.CATEGORY_ALIASES.items())
    names = ", ".join(f"({_q(n)})" for n in [*K.CATEGORY_ALIASES, "Self-Harm", "sexual content", "s7", "other"])
    pats = " union all ".join(f"select doc_id, {_q(k)} as label, len(regexp_extract_all(text, {_q(K.PII[k])})) as n from documents" for k in ("email", "ip_address", "aws_key"))
    return {
        "injection_scan": _sql_injection(),
        "keyword_gate": f"select conv_id, turn, case when {ex} then null else case {kw} end end as category from conversations",
        "pii_label_counts": f"select * from ({pats}) where n > 0",
        "validate_input": r"""
with w as (select doc_id, text, list_filter(string_split_regex(lower(text), '\s+'), lambda x: x <> '') as w from documents),
c as (select doc_id, max(n) as most from (select doc_id, x, count(*) as n from (select doc_id, unnest(w) as x from w) group by all) group by doc_id)
select w.doc_id, case when length(text) > 32768 then 'input_too_long' when not regexp_matches(text, '\S') then 'empty_input'
  when len(list_filter(range(1, length(text) - 18), lambda i: substr(text, i, 20) = repeat(substr(text, i, 1), 20) and substr(text, i, 1) <> chr(10))) > 0 then 'char_repetition'
  when len(w) >= 10 and most / len(w) > 0.3 then 'word_repetition' end as reason
from w left join c on c.doc_id = w.doc_id
""",
        "conversation_payloads": r"""
with p as (select conv_id, turn, role, text, list('[' || upper(role) || '] ' || coalesce(text, '')) over (partition by conv_id order by turn rows between 6 preceding and 1 preceding) as past from conversations),
q as (select *, array_to_string(list_append(coalesce(past, []), coalesce(text, '')), chr(10)) as payload from p)
select conv_id, turn, case role when 'user' then 'input' when 'system' then 'prompt' else 'output' end as gate,
  length(payload) as payload_chars, sha256(payload) as payload_sha from q
""",
        "bm25_scores": r"""
with c as (select item_id as did, unnest(list_filter(string_split_regex(lower(text), '\s+'), lambda x: x <> '')) as term from benchmark),
q as (select conv_id * 1000 + turn as qid, unnest(list_filter(string_split_regex(lower(text), '\s+'), lambda x: x <> '')) as term from conversations where role = 'user'),
qf as (select qid, term, count(*) as qf from q group by all), tf as (select did, term, count(*) as tf from c group by all),
len as (select did, count(*) as len from c group by all), df as (select term, count(*) as df from tf group by all),
s as (select (select count(*) from benchmark) as n, (select sum(len) from len) / (select count(*) from benchmark) as avg)
select qid, did, round(sum(qf * ln((n - df + 0.5) / (df + 0.5) + 1) * tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * len / avg))), 6) as score
from qf join df using (term) join tf using (term) join len using (did), s group by all
""",
        "telemetry_stats": f"""
with {_LOG} select gate, count(*) as total, count(*) filter (action = 'pass') as passed, count(*) filter (action = 'block') as blocked,
  count(*) filter (action = 'mask') as masked, count(*) filter (pii) as pii,
  round(coalesce(avg(latency_ms) filter (latency_ms > 0), 0), 6) as avg_latency_ms from log group by gate
""",
        "telemetry_histogram": f"""
with {_LOG} select gate, action, {", ".join(f"count(*) filter (latency_ms / 1000 <= {b}) as le_{str(b).replace('.', '_')}" for b in telemetry.BUCKETS)},
  count(*) as le_inf, round(sum(latency_ms / 1000), 6) as sum, count(latency_ms) as count from log group by gate, action
""",
        "telemetry_windows": f"""
with {_LOG} select strftime(time_bucket(interval '10 minutes', ts), '%Y-%m-%d %H:%M:%S') as start, action, count(*) as n from log group by all
""",
        "verdict_parse": """
select doc_id, toxic <> 1 and quality = 1 as safe, case when toxic = 1 then 'S' || (doc_id % 14 + 1) end as category from labels
""",
        "category_names": f"select name, coalesce(case replace(replace(lower(name), '-', '_'), ' ', '_') {alias} end, upper(name)) as code from (values {names}) t(name)",
    }
