"""Registered queries of scope, grounding by a model, escalation, violations, prompts and policies, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sluice import checks
from sluice.functions import fixed as K
from sluice.functions import pii as P
from sluice.functions import text as X
from sluice.operators import cascade, grounding, screen, vectors
from sluice.plans import policy


def _t(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


def _scope(spark, d):
    u = checks._units(spark, d)
    text = F.when(F.col("vec_id") % 50 == 0, "Hello ").when(F.col("vec_id") % 50 == 1, "ab").otherwise("what is this")
    q = u.select(F.col("vec_id").alias("id"), text.alias("text"), "vec")
    topics = vectors.mean_vector(_t(spark, d, "embeddings"), ["label"], "embedding")
    topics = topics.select(F.col("label").alias("ix"), F.col("label").cast("string").alias("topic"), "centroid")
    r = vectors.scope_check(q, topics, [], 0.8)
    return r.select("id", "allowed", "matched_topic", F.round("distance", 4).alias("distance"), F.round("confidence", 6).alias("confidence"), F.substring_index("reason", " (", 1).alias("reason"))


def _open_scope(spark, d):
    u = checks._units(spark, d).select(F.col("vec_id").alias("id"), F.lit("what is this").alias("text"), "vec")
    none = spark.createDataFrame([], "ix int, topic string, centroid array<double>")
    return vectors.scope_check(u, none, []).select("id", "allowed", "matched_topic", "distance", "confidence", "reason")


def _hybrid(spark, d):
    k = F.col("event_id")
    dense, sparse, top = k % 101 / 50.0 - 1, (k % 7).cast("double"), F.when(k % 3 == 0, 0.0).otherwise(7.0)
    return _t(spark, d, "events").select("event_id", F.round(vectors.hybrid(dense, sparse, top, 0.3), 9).alias("score"))


def _model(claim, chunk):
    """An entailment model of made-up probabilities by the number of a chunk."""
    n = F.regexp_extract(chunk, r"\d+", 0).cast("int")
    return F.struct(*[(n * k % 101 / 100.0).alias(name) for k, name in ((7, "entail"), (13, "contra"), (29, "neutral"))])


def _accuracy(spark, d):
    claims = checks._claims(spark, d).withColumn("claim", F.concat(F.lit("claim "), F.col("claim_ix").cast("string")))
    return grounding.accuracy_check(claims, checks._chunks(spark, d), _model)


def _accuracy_rows(spark, d):
    r = _accuracy(spark, d)
    return r.select("resp_id", "claim_ix", F.round("entailment", 6).alias("entailment"), "contradiction", "neutral", "nli_entailment", "matched_chunk", "verdict")


def _grounded(spark, d):
    ids = _t(spark, d, "embeddings").select(F.col("label").alias("resp_id")).distinct()
    done = grounding.totals(_accuracy(spark, d), ids.withColumn("has_sources", F.lit(True)))
    screened = ids.withColumn("screen", F.struct((F.col("resp_id") % 3 == 0).alias("blocked")))
    r = grounding.screen_grounded(screened, done)
    return r.select("resp_id", "screen.blocked", "grounding.is_grounded", "grounding.faithfulness_score", "grounding.has_contradiction", "grounding.sentence_count", "grounding.mode")


def _prompt(spark, d):
    gate = F.when(F.col("doc_id") % 2 == 0, "input").otherwise("output")
    return _t(spark, d, "documents").select("doc_id", F.sha2(X.guard_prompt(F.col("text"), gate), 256).alias("prompt_sha256"))


def _violations(spark, d):
    """Verdicts of labelled rows, made up: harm, injection, scope and personal data in turn."""
    k = F.col("doc_id")
    entity = lambda label: F.struct(F.lit(label).alias("label"))
    entities = F.when(k % 4 == 3, F.array(entity("ssn"), entity("email"), entity("ssn"))).otherwise(F.array().cast("array<struct<label:string>>"))
    verdict = F.struct(
        F.when(k % 5 == 0, None).otherwise(k % 4 != 0).alias("enforced"),
        F.when(k % 4 == 1, "injection").when(k % 4 == 2, "scope").alias("block_category"),
        (k % 4 == 3).alias("has_pii"),
        entities.alias("entities"),
        F.concat(F.lit("rule "), (k % 4).cast("string")).alias("reason"),
    )
    rows = _t(spark, d, "labels").select("doc_id", F.lit("input").alias("gate"), verdict.alias("screen"))
    return screen.violations(rows, "doc_id").select("doc_id", "gate", "category", F.array_join("labels", ",").alias("labels"), "description")


def _slow(text: str) -> bool:
    """A slow model that fails on every eleventh text."""
    n = int(text)
    if n % 11 == 0:
        raise TimeoutError(text)
    return n % 2 == 0


def _escalation(spark, d):
    k = F.col("doc_id")
    rows = _t(spark, d, "labels").select("doc_id", k.cast("string").alias("text"), F.when(k % 7 != 0, (k % 101).cast("double") / 100).alias("prob"))
    r = cascade.escalate(rows, _slow, mode="speed", failures=1 << 30)
    return r.select("doc_id", "verdict.safe", "verdict.path")


def _contexts(spark, d):
    k = F.col("event_id")
    pick = lambda layer, n: F.element_at(F.array(*[F.lit(x) for x in policy.PROFILES[layer]]), (k % n + 1).cast("int")).alias(layer)
    return _t(spark, d, "events").select(*[pick(layer, n) for layer, n in zip(policy.LAYERS, (5, 4, 3, 2, 3))])


def _rates(spark, d):
    return policy.resolver_rates(_contexts(spark, d))


def _effective(spark, d):
    r = policy.resolve(_contexts(spark, d).distinct()).select(*policy.LAYERS, policy.effective(F.col("policy")).alias("e"))
    return r.select(*policy.LAYERS, F.col("e.pii.action").alias("pii_action"), F.col("e.pii.threshold").alias("pii_threshold"), F.array_join("e.content.blocked_categories", ",").alias("blocked"))


def _empty(spark, d):
    out = None
    for layer in policy.LAYERS:
        rows = policy.profiles(spark, layer)
        rows = rows.select(F.lit(layer).alias("layer"), F.col(layer).alias("name"), policy.is_empty(F.col(f"__{layer}")).alias("empty"))
        out = rows if out is None else out.unionByName(rows)
    return out


def _sizes(spark, d):
    return P.vault_sizes(checks._tokens(spark, d))


def _cleared(spark, d):
    ended = _t(spark, d, "documents").where("source = 'src1'").select(F.col("source").alias("session"))
    return P.vault_cleared(checks._tokens(spark, d), ended)


def queries() -> dict:
    return {
        "scope_check": _scope,
        "scope_without_topics": _open_scope,
        "hybrid_scope": _hybrid,
        "grounding_accuracy": _accuracy_rows,
        "grounding_screened": _grounded,
        "guard_prompt": _prompt,
        "violations": _violations,
        "cascade_escalation": _escalation,
        "resolver_rates": _rates,
        "policy_effective": _effective,
        "override_empty": _empty,
        "vault_sizes": _sizes,
        "vault_cleared": _cleared,
    }


_NEAR = f"""{checks._SPEED},
read as (select *, chunk_ix * 7 % 101 / 100.0::double as e, chunk_ix * 13 % 101 / 100.0::double as c, chunk_ix * 29 % 101 / 100.0::double as n from ranked where rank <= 3),
best as (select *, n > e and n > c and e < 0.55 and c < 0.7 as by_similarity, row_number() over (partition by claim_ix order by e desc, rank) as k from read),
acc as (select resp_id, claim_ix, chunk_ix, case when by_similarity and score >= 0.65 then greatest(e, score) else e end as entailment, c, n, e,
  case when e >= 0.55 then 'grounded' when c >= 0.7 then 'contradicted' when by_similarity then case when score >= 0.65 then 'grounded' when score >= 0.5 then 'uncertain' else 'ungrounded' end
    when e >= 0.3 then 'uncertain' else 'ungrounded' end as verdict from best where k = 1)"""


def _sql_prompt() -> str:
    q, p = checks._q, K.PROMPT
    listed = "\n".join(f"{c}: {name}" for c, name in K.CATEGORIES.items())
    ask = lambda g: f"{q(p['head'] + p[g] + p['categories'].replace('LIST', listed) + p[f'{g}_begin'])} || coalesce(text, '') || {q(p[f'{g}_end'] + p['tail'])}"
    return f"select doc_id, sha256(case when doc_id % 2 = 0 then {ask('input')} else {ask('output')} end) as prompt_sha256 from documents"


def _sql_contexts() -> str:
    lists = {layer: "[" + ", ".join(checks._q(x) for x in policy.PROFILES[layer]) + "]" for layer in policy.LAYERS}
    picks = ", ".join(f"{v}[event_id % {n} + 1] as {k}" for (k, v), n in zip(lists.items(), (5, 4, 3, 2, 3)))
    return f"(select {picks} from events)"


def oracle_sql() -> dict[str, str]:
    r = vectors.REASONS
    match, off = (r[k].split(" (")[0].replace("'%s'", "''' || topic || '''") for k in ("match", "off"))
    greetings = ", ".join(checks._q(g) for g in K.GREETINGS)
    tokens = checks.oracle_sql()["vault_tokens"]
    empty = ", ".join(f"({checks._q(layer)}, {checks._q(k)}, {str(not o).lower()})" for layer, x in policy.PROFILES.items() for k, o in x.items())
    return {
        "scope_check": f"""with {checks._UNITS}, m as (select label, i, avg(embedding[i]::double) as x from (select label, embedding, unnest(range(1, len(embedding) + 1)) as i from embeddings) group by all),
c as (select label, list(x order by i) as x from m group by label),
t as (select label, list_transform(x, lambda y: y / sqrt(list_dot_product(x, x))) as c from c),
b as (select u.vec_id as id, t.label::varchar as topic, list_dot_product(u.v, t.c) as s, row_number() over (partition by u.vec_id order by list_dot_product(u.v, t.c) desc, t.label) as r from u cross join t),
f as (select *, lower(trim(case id % 50 when 0 then 'Hello ' when 1 then 'ab' else 'what is this' end)) as w from b where r = 1),
g as (select *, length(w) < 3 or w in ({greetings}) as free from f)
select id, free or s >= 0.8 as allowed, case when not free and s > 0.1 then topic end as matched_topic, case when free then 0.0::double else round(1 - s, 4) end as distance,
  round(case when free then 1.0::double else least(1, greatest(0, s)) end, 6) as confidence,
  case when free then {checks._q(r["free"])} when s >= 0.8 then '{match}' else '{off}' end as reason from g""",
        "scope_without_topics": f"select vec_id as id, true as allowed, null::varchar as matched_topic, 0.0::double as distance, 1.0::double as confidence, {checks._q(r['none'])} as reason from embeddings",
        "hybrid_scope": """select event_id, round(0.7 * greatest(0, event_id % 101 / 50.0::double - 1) + 0.3 * case when event_id % 3 = 0 then 0 else (event_id % 7) / 7.0::double end, 9)::double as score from events""",
        "grounding_accuracy": f"with {_NEAR} select resp_id, claim_ix, round(entailment, 6) as entailment, c as contradiction, n as neutral, e as nli_entailment, 'chunk ' || chunk_ix as matched_chunk, verdict from acc",
        "grounding_screened": f"""with {_NEAR}, t as (select resp_id, count(*) as n, count(*) filter (verdict = 'grounded') as g, count(*) filter (verdict = 'contradicted') as c from acc group by resp_id),
r as (select distinct label as resp_id from embeddings),
f as (select r.resp_id, r.resp_id % 3 = 0 as blocked, coalesce(n, 0) as n, case when n is null then 1.0::double else round(g / n, 4)::double end as share, coalesce(c, 0) > 0 as contra from r left join t using (resp_id))
select resp_id, blocked, blocked or (share >= 0.5 and not contra) as is_grounded, case when blocked then 1.0::double else share end as faithfulness_score, not blocked and contra as has_contradiction,
  case when blocked then 0 else n end::bigint as sentence_count, case when blocked then 'skipped' else 'accuracy' end as mode from f""",
        "guard_prompt": _sql_prompt(),
        "violations": """with k as (select doc_id, doc_id % 4 as k from labels where doc_id % 5 = 0 or doc_id % 4 <> 0)
select doc_id, 'input' as gate, case k when 1 then 'injection' when 2 then 'scope' when 3 then 'pii' end as category, case when k = 3 then 'email,ssn' end as labels,
  case when k = 3 then '3 entities: email, ssn' else 'rule ' || k end as description from k""",
        "cascade_escalation": """with c as (select doc_id, case when doc_id % 7 <> 0 then (doc_id % 101) / 100.0::double end as p, case when doc_id % 11 <> 0 then doc_id % 2 = 0 end as s from labels)
select doc_id, case when p > 0.85 then false when p < 0.15 then true when s is not null then s when p is not null then p < 0.5 else false end as safe,
  case when p > 0.85 then 'fast_unsafe' when p < 0.15 then 'fast_safe' when s is not null then 'escalated' when p is not null then 'escalation_failed_fast_fallback' else 'fail_closed' end as path from c""",
        "resolver_rates": f"""with c as {_sql_contexts()}, n as (select count(*) as n, (select count(*) from (select distinct * from c)) as m from c)
select m as cache_size, n - m as hits, m as misses, round((n - m) / greatest(n, 1) * 100, 1)::double as hit_rate from n""",
        "policy_effective": f"""select {", ".join("p." + x for x in policy.LAYERS)}, pii_action, pii_threshold, blocked from ({checks._sql_policies()}) p
semi join (select distinct * from {_sql_contexts()}) c using ({", ".join(policy.LAYERS)})""",
        "override_empty": f"select * from (values {empty}) t(layer, name, empty)",
        "vault_sizes": f"select session, count(*) as n from ({tokens}) group by session",
        "vault_cleared": f"select * from ({tokens}) where session not in (select source from documents where source = 'src1')",
    }
