"""Batch scoring with user models."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rulewell.functions.prompts import short_prompt
from rulewell.operators import retrieval, scoring
from rulewell.operators.parallel import spread
from rulewell.workload.q_retrieval import CANDIDATES, RERANKED, _resolved, documents_by_id
from rulewell.workload.registry import query
from rulewell.workload.stubs import DigestModel, length_generator
from rulewell.workload.tables import Tables, sql

_SCORED = """numbered as (select row_id, (row_number() over (order by row_id) - 1) // 12 + 1 as batch_number from wide),
 scored as (select row_id, cast(batch_number as bigint) as batch_number, min(row_id) over (partition by batch_number) % 7 = 3 as bad,
  cast(concat('0x', substr(md5(cast(row_id as varchar)), 1, 4)) as bigint) / 65535 as p from numbered)"""


def _scores(t: Tables) -> DataFrame:
    return scoring.predict_batches(t.wide_with(), DigestModel, "row_id", ["test_comment"])


@query(
    "g01_predict_batches",
    sql(
        """select row_id, batch_number, case when bad then 'Error' when p > 0.5 then 'Yes' else 'No' end as prediction,
        not bad and p > 0.5 as is_violation, round(case when bad then 0 else p end, 6) as violation_probability,
        round(case when bad then 0 else greatest(p, 1 - p) end, 6) as confidence,
        case when bad then concat('Batch ', cast(batch_number as varchar), ' failed: unusable batch') end as error,
        bad as batch_error from scored""",
        _SCORED,
    ),
)
def predict_batches(t: Tables) -> DataFrame:
    rounded = {c: F.round(c, 6) for c in ("violation_probability", "confidence")}
    return _scores(t).withColumns(rounded)


@query(
    "g02_failed_batches",
    sql(
        """select batch_number, count(*) as failed_rows, min(row_id) as first_failed, max(row_id) as last_failed
        from scored where bad group by batch_number""",
        _SCORED,
    ),
)
def failed_batches(t: Tables) -> DataFrame:
    return scoring.failed_batches(_scores(t), "row_id")


@query(
    "g03_generate_batches",
    sql(
        """select row_id, cast((row_number() over (order by row_id) - 1) // 50 + 1 as bigint) as batch_number,
        case when n % 13 = 0 or n % 11 = 0 then null else concat('Formatted Rule: ', cast(n as varchar), chr(10), 'Violates Rule: ',
        case when n % 2 = 1 then 'Yes' else 'No' end) end as response, case when n % 13 = 0 then 'quota exceeded' end as error
        from (select row_id, length(concat('r/', subreddit, chr(10), 'Comment: ', test_comment)) as n from wide) z"""
    ),
)
def generate_batches(t: Tables) -> DataFrame:
    prompts = t.wide_with().select("row_id", short_prompt("test_comment").alias("prompt"))
    return scoring.generate_batches(prompts, length_generator, "row_id", "prompt")


@query(
    "g04_embed_texts",
    sql(
        r"""select doc_id, cast(slot as int) as slot, round(n / sqrt(sum(n * n) over (partition by doc_id)), 6) as weight from (
        select doc_id, cast(concat('0x', substr(md5(w), 1, 4)) as bigint) % 64 as slot, cast(count(*) as double) as n from (
        select doc_id, unnest(regexp_extract_all(lower(text), '[\p{L}\p{N}_]{2,}')) as w from documents) x group by all) z"""
    ),
)
def embed_texts(t: Tables) -> DataFrame:
    vector = scoring.embed_texts("text", scoring.hashed_word_embedder(64))
    docs = spread(t.given("documents")).select("doc_id", vector.alias("v"))
    slots = docs.select("doc_id", F.posexplode("v").alias("slot", "w")).filter(F.col("w") > 0)
    return slots.select("doc_id", "slot", F.round("w", 6).alias("weight"))


@query(
    "g05_rerank_pairs",
    sql("select query_id, row_id, round(similarity, 6) as similarity, round(rerank_score, 6) as rerank_score, final_rank from reranked", f"{CANDIDATES}, {RERANKED}"),
)
def rerank_pairs(t: Tables) -> DataFrame:
    found = retrieval.rule_candidates(_resolved(t), t.corpus, 20, exclude_self=True)
    queries, texts = documents_by_id(t)
    best = retrieval.rerank(found, queries, texts, 4)
    shown = [F.round(c, 6).alias(c) for c in ("similarity", "rerank_score")]
    return best.select("query_id", "row_id", *shown, "final_rank")
