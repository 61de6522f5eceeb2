"""The registered queries of this package: each applies its operator to the whole of its table."""

from __future__ import annotations

from sluice.llm import embed_dedup, exact_dedup, langid, lm, mixing, ngram_join, packing, sharding, substring, toxicity
from sluice.llm.common import table


def queries() -> dict:
    docs = lambda spark, d: table(spark, d, "documents")
    return {
        "op1_embedding_near_dedup": lambda s, d: embed_dedup.similar_vectors(table(s, d, "embeddings")),
        "op2_source_mixing": lambda s, d: mixing.mix_sources(docs(s, d)),
        "op3_packing": lambda s, d: packing.pack_documents(docs(s, d)),
        "op4_ngram_jaccard": lambda s, d: ngram_join.similar_documents(docs(s, d)),
        "op5_exact_dedup": lambda s, d: exact_dedup.exact_duplicates(docs(s, d)),
        "op6_lm_scoring": lambda s, d: lm.language_model_scores(docs(s, d)),
        "op7_language_id": lambda s, d: langid.language_of(docs(s, d)),
        "op8_toxicity": lambda s, d: toxicity.toxicity(docs(s, d), table(s, d, "labels")),
        "op9_substring_dedup": lambda s, d: substring.remove_repeated_spans(docs(s, d)),
        "op10_sharding": lambda s, d: sharding.balanced_shards(docs(s, d)),
    }


_CLOSURE = """
reach(a, b) as (select a, b from links union select r.a, l.b from reach r join links l on r.b = l.a)
"""

_OP1 = f"""
with recursive v as (
  select vec_id, embedding::double[] as e,
    coalesce(len(embedding) > 0 and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0
      and len(list_filter(embedding, lambda x: x <> 0)) > 0, false) as good from embeddings),
links as (
  select a.vec_id as a, b.vec_id as b from v a join v b on a.vec_id <> b.vec_id
  where a.good and b.good and case when a.good and b.good then list_cosine_similarity(a.e, b.e) end >= 0.9),
{_CLOSURE}
select v.vec_id, (select count(*) from links l where l.a = v.vec_id) as n_links,
  least(v.vec_id, coalesce((select min(b) from reach r where r.a = v.vec_id), v.vec_id)) as component_id,
  v.vec_id <= coalesce((select min(b) from reach r where r.a = v.vec_id), v.vec_id) as kept
from v
"""

_OP4 = f"""
with recursive w as (
  select doc_id, list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
    'abcdefghijklmnopqrstuvwxyz'), '[\\x20\\x09-\\x0D]+'), lambda x: x <> '') as w from documents),
sh as (
  select distinct doc_id, array_to_string(w[i : i + 4], ' ') as s
  from (select doc_id, w, unnest(range(1, greatest(len(w) - 4, 1) + 1)) as i from w where len(w) > 0)),
n as (select doc_id, count(*) as n from sh group by doc_id),
common as (select a.doc_id as a, b.doc_id as b, count(*) as c from sh a join sh b on a.s = b.s and a.doc_id <> b.doc_id group by all),
links as (
  select a, b from common join n x on x.doc_id = a join n y on y.doc_id = b where 100 * c >= 80 * (x.n + y.n - c)),
{_CLOSURE},
low as (select a, min(b) as b from reach group by a)
select w.doc_id, coalesce(n.n, 0) as n_shingles, least(w.doc_id, coalesce(low.b, w.doc_id)) as component_id
from w left join n on n.doc_id = w.doc_id left join low on low.a = w.doc_id
"""

_OP5 = """
with t as (
  select doc_id, sha256(regexp_replace(coalesce(text, ''), '[\\x20\\x09-\\x0D]+', ' ', 'g')) as text_sha256 from documents)
select doc_id, min(doc_id) over g as keep_id, count(*) over g as group_size,
  doc_id is not distinct from min(doc_id) over g as kept, text_sha256
from t window g as (partition by text_sha256)
"""


def oracle_sql() -> dict[str, str]:
    """Queries that SQL can express.  The others are held against brute force, round trips or held-out rows in tests."""
    return {"op1_embedding_near_dedup": _OP1, "op4_ngram_jaccard": _OP4, "op5_exact_dedup": _OP5}
