"""Queries over the training-data operators, and their SQL where SQL can express them."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from . import source_budgets, token_rollups
from .bit_planes import plane_digests
from .bpe_automaton import bpe_digests
from .common import table
from .histogram_topk import histogram_topk
from .jaccard_join import jaccard_components
from .language_profiles import language_ids
from .learned_partitions import nearest
from .maxent_scores import lm_scores
from .periodic_runs import run_digests
from .prefix_trie import prefix_trie
from .secret_ledger import secret_spans
from .wu_manber import hit_digests

WORD_BPE, BYTE_BPE = "word_bpe_49k.json", "byte_bpe_50k.json"


def op1_bit_planes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return plane_digests(table(spark, sf_dir, "documents"), public_tokenizers.path(WORD_BPE))


def op2_rank_profiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language_ids(table(spark, sf_dir, "documents"))


def op3_histogram_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return histogram_topk(table(spark, sf_dir, "embeddings"))


def op4_maxent_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lm_scores(table(spark, sf_dir, "documents"))


def op5_source_budgets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return source_budgets.mixed(table(spark, sf_dir, "documents"))


def op6_secret_ledger(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secret_spans(table(spark, sf_dir, "documents"))


def op7_learned_partitions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return nearest(table(spark, sf_dir, "embeddings"))


def op8_token_rollups(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_rollups.token_totals(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op9_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_components(table(spark, sf_dir, "documents"))


def op10_bpe_automaton(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe_digests(table(spark, sf_dir, "documents"), public_tokenizers.path(BYTE_BPE))


def op11_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return run_digests(table(spark, sf_dir, "documents"))


def op12_wu_manber(spark: SparkSession, sf_dir: str) -> DataFrame:
    return hit_digests(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op13_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prefix_trie(table(spark, sf_dir, "conversations"))


_CASE = lambda column, weights: f"case {column} " + " ".join(f"when '{k}' then {v}" for k, v in weights.items()) + " else 1 end"


def _shared(name: str, source: str, keys: str, node: str, amount: str, weight: str) -> str:
    """The CTEs that share amount among the siblings of source; source has cap."""
    part = f"partition by {keys}" if keys else ""
    return f"""
{name}_w as (select *, {weight}::double as w, cap / ({weight})::double as lvl from {source}),
{name}_l as (select *, greatest({amount} - coalesce(sum(cap) over (x rows between unbounded preceding and 1 preceding), 0), 0)
    / sum(w) over (x rows between current row and unbounded following) as water from {name}_w window x as ({part} order by lvl, {node})),
{name}_m as (select *, max(case when lvl > water then water end) over ({part}) as top from {name}_l),
{name} as (select *, case when lvl <= water then cap else least(cap, w * top) end as got from {name}_m)"""


ORACLE: dict[str, str] = {
    "op3_histogram_topk": """
with v as (select vec_id, [floor(1024 * x::double) for x in embedding] as e from embeddings),
s as (select q.vec_id as query_id, c.vec_id, list_inner_product(q.e, c.e)::bigint as score from v q join v c on q.vec_id % 100 = 0 and q.vec_id <> c.vec_id),
r as (select *, (row_number() over (partition by query_id order by score desc, vec_id))::int as rank from s)
select query_id, rank, vec_id, score from r where rank <= 10""",
    "op5_source_budgets": f"""
with rows_ as (select doc_id, coalesce(source, 'unknown') as source, coalesce(lang, 'und') as lang,
    case when regexp_extract(coalesce(source, 'unknown'), '([0-9]{{1,9}})$', 1) = '' then 'other'
      else 'domain' || (nullif(regexp_extract(coalesce(source, 'unknown'), '([0-9]{{1,9}})$', 1), '')::bigint % 3)::varchar end as domain,
    coalesce(len(regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+')), 0)::bigint as n_tokens from documents),
leaves as (select domain, lang, source, sum(n_tokens)::bigint as tokens, sum(n_tokens)::double * {source_budgets.EPOCHS} as cap from rows_ group by all),
d0 as (select domain, sum(cap) as cap, (select sum(tokens) from leaves) * {source_budgets.SHARE} as amount from leaves group by all),
{_shared("d", "d0", "", "domain", "amount", _CASE("domain", source_budgets.DOMAIN_WEIGHTS))},
l0 as (select leaves.domain, lang, sum(leaves.cap) as cap, any_value(d.got) as amount from leaves join d on leaves.domain = d.domain group by all),
{_shared("l", "l0", "domain", "lang", "amount", _CASE("lang", source_budgets.LANGUAGE_WEIGHTS))},
s0 as (select leaves.*, l.got as amount from leaves join l on leaves.domain = l.domain and leaves.lang = l.lang),
{_shared("s", "s0", "domain, lang", "source", "amount", _CASE("source", source_budgets.SOURCE_WEIGHTS))},
plan as (select domain, lang, source, tokens, floor(got + 0.001)::bigint as budget from s),
plan2 as (select *, case when tokens > 0 then budget // tokens else 0 end as whole, budget - (case when tokens > 0 then budget // tokens else 0 end) * tokens as rest from plan),
at_ as (select r.*, p.whole, p.rest from rows_ r join plan2 p on r.domain = p.domain and r.lang = p.lang and r.source = p.source),
part as (select *, coalesce(sum(n_tokens) over (partition by domain, lang, source order by md5('{source_budgets.SEED}:' || whole || ':' || doc_id), doc_id, n_tokens rows between unbounded preceding and 1 preceding), 0) as before_ from at_ where rest > 0)
select doc_id, domain, lang, source, n_tokens, e.epoch::int as epoch from at_ join (select unnest(range({source_budgets.EPOCHS})) as epoch) e on e.epoch < at_.whole
union all select doc_id, domain, lang, source, n_tokens, whole::int from part where before_ < rest""",
    "op8_token_rollups": """
with kept as (select source, lang, text from documents where doc_id not in (select doc_id from labels where toxic = 1 and doc_id is not null)),
counts as (select source, lang, 'words-1' as tokenizer, coalesce(len(regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+')), 0) as tokens from kept
  union all select source, lang, 'runs-2', coalesce(len(regexp_extract_all(text, '[A-Za-z0-9]+|[^A-Za-z0-9\\x20\\x09-\\x0D]')), 0) from kept)
select source, lang, tokenizer, count(*)::bigint as docs, sum(tokens)::bigint as tokens from counts group by all""",
}


QUERIES = {
    f.__name__: f
    for f in (op1_bit_planes, op2_rank_profiles, op3_histogram_topk, op4_maxent_scores, op5_source_budgets, op6_secret_ledger, op7_learned_partitions, op8_token_rollups, op9_jaccard_join, op10_bpe_automaton, op11_periodic_runs, op12_wu_manber, op13_prefix_trie)
}
