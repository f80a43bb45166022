"""Similarity and retrieval."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from rulewell.functions import vectors
from rulewell.functions.stopwords import ENGLISH
from rulewell.operators import evaluation, retrieval, similarity
from rulewell.operators.nearest import nearest
from rulewell.operators.parallel import spread
from rulewell.operators.scoring import hashed_word_embedder
from rulewell.plans.classify import RetrievalSettings, classify, query_prompts
from rulewell.session import written
from rulewell.sources import csvfiles, vector_index
from rulewell.workload.q_reshape import corpus_sql, text_corpus
from rulewell.workload.registry import query
from rulewell.workload.sqltext import RATIOS, cells_sql, dot_sql, scrub_sql
from rulewell.workload.tables import Tables, sql


def _exploded(df: DataFrame, vector) -> DataFrame:
    rows = df.select("vec_id", F.posexplode(vector).alias("pos", "x"))
    return rows.select("vec_id", "pos", F.round("x", 6).alias("x"))


def _unit_sql(values: str) -> str:
    return (
        "select vec_id, cast(unnest(range(len(v))) as int) as pos, round(unnest(v) / sqrt(list_inner_product(v, v)), 6) as x "
        f"from (select vec_id, {values} as v from embeddings) z"
    )


_SCALED = "list_transform(embedding, lambda x: x::double * (1 + vec_id % 3))"


@query("h01_l2_normalize", _unit_sql(_SCALED))
def l2_normalize(t: Tables) -> DataFrame:
    scale = 1 + F.col("vec_id") % 3
    scaled = F.transform("embedding", lambda x: x.cast("double") * scale)
    return _exploded(t.given("embeddings"), vectors.l2_normalize(scaled))


@query("h02_truncate_renorm", _unit_sql("embedding[1:16]::double[]"))
def truncate_renorm(t: Tables) -> DataFrame:
    return _exploded(t.given("embeddings"), vectors.truncate_renorm("embedding", 16))


@query(
    "h03_cosine_pairs",
    sql(
        """select c.row_id, round(list_cosine_similarity(c.embedding::double[], r.embedding::double[]), 6) as similarity
        from corpus c join corpus_rules r on c.rule = r.rule"""
    ),
)
def cosine_pairs(t: Tables) -> DataFrame:
    pairs = t.corpus.join(t.corpus_rules.withColumnRenamed("embedding", "rule_vector"), "rule")
    return pairs.select("row_id", F.round(vectors.cosine("embedding", "rule_vector"), 6).alias("similarity"))


_TFIDF = (
    r"""all_text as (select 'rule' as side, item_id as id, text from benchmark union all select 'document', doc_id, text from documents),
 tf as (select side, id, w, count(*) as n from (select side, id, unnest(regexp_extract_all(lower(text), '[\p{L}\p{N}_]{2,}')) as w
  from all_text) x where w not in ("""
    + ", ".join(f"'{w}'" for w in ENGLISH)
    + """) group by all),
 vocabulary as (select w, row_number() over (order by w) - 1 as term_id, df from (
  select w, sum(n) as total, count(*) as df from tf group by w order by total desc, w limit 1000) x),
 raw as (select side, id, term_id, n * (ln((1 + (select count(*) from all_text)) / (1 + df)) + 1) as wt from tf join vocabulary using (w)),
 tfidf as (select side, id, term_id, wt / sqrt(sum(wt * wt) over (partition by side, id)) as weight from raw)"""
)


@query("h04_tfidf", sql("select side, id, cast(term_id as int) as term_id, round(weight, 6) as weight from tfidf", _TFIDF))
def tfidf(t: Tables) -> DataFrame:
    rules = t.given("benchmark").select(F.lit("rule").alias("side"), F.col("item_id").alias("id"), "text")
    docs = t.given("documents").select(F.lit("document").alias("side"), F.col("doc_id").alias("id"), "text")
    both = spread(rules.unionByName(docs)).select(F.struct("side", "id").alias("key"), "text")
    vocabulary = similarity.fit_vocabulary(both, "text")
    terms = similarity.tfidf_vectors(both, "key", "text", vocabulary)
    entry = F.explode(F.arrays_zip("vector.indices", "vector.values")).alias("e")
    return terms.select("key", entry).select(
        "key.side", "key.id", F.col("e.indices").alias("term_id"), F.round("e.values", 6).alias("weight")
    )


_BEST = f"""{_TFIDF}, best as (select doc_id, item_id, max_similarity from (select d.doc_id, b.item_id, coalesce(s.sim, 0.0) as max_similarity,
  row_number() over (partition by d.doc_id order by coalesce(s.sim, 0.0) desc, b.item_id) as r
  from documents d cross join benchmark b left join (select x.id as doc_id, y.id as item_id, round(sum(x.weight * y.weight), 12) as sim
  from tfidf x join tfidf y using (term_id) where x.side = 'document' and y.side = 'rule' group by all) s
  on s.doc_id = d.doc_id and s.item_id = b.item_id) z where r = 1)"""


_SIDES = ("doc_id", "text", "item_id", "text")


def matches_above(t: Tables, threshold: float = 0.3) -> DataFrame:
    docs, rules = t.given("documents").select("doc_id", "text"), t.given("benchmark")
    return similarity.tfidf_matches(docs, rules, *_SIDES, threshold)


_BEST_EMBEDDED = rf"""{_BEST}, e_slots as (select side, id, cast(concat('0x', substr(md5(w), 1, 4)) as bigint) % 64 as slot,
  cast(count(*) as double) as n from (select side, id, unnest(regexp_extract_all(lower(text), '[\p{{L}}\p{{N}}_]{{2,}}')) as w from all_text) x group by all),
 e_dense as (select t.side, t.id, list(coalesce(s.n, 0) order by g.slot) as v from all_text t cross join (select unnest(range(64)) as slot) g
  left join e_slots s on s.side = t.side and s.id = t.id and s.slot = g.slot group by t.side, t.id),
 e_unit as (select side, id, list_transform(v, lambda x: x / greatest(sqrt(list_inner_product(v, v)), 1e-300)) as v from e_dense),
 e_best as (select doc_id, item_id, max_similarity from (select d.id as doc_id, b.id as item_id, {dot_sql('d.v', 'b.v')} as max_similarity,
  row_number() over (partition by d.id order by {dot_sql('d.v', 'b.v')} desc, b.id) as r
  from e_unit d join e_unit b on d.side = 'document' and b.side = 'rule') z where r = 1)"""


@query(
    "h05_max_similarity_filter",
    sql(
        """select m.method, m.doc_id, m.item_id, round(m.max_similarity, 6) as max_similarity, k.text as clean_rule from (
        select 'terms' as method, * from best where max_similarity >= 0.3 union all
        select 'embeddings', * from e_best where max_similarity >= 0.7) m join benchmark k using (item_id)""",
        _BEST_EMBEDDED,
    ),
)
def max_similarity_filter(t: Tables) -> DataFrame:
    """Both methods with their own thresholds: term vectors (0.3) and embeddings (0.7, the default)."""
    docs, rules = t.given("documents").select("doc_id", "text"), t.given("benchmark")
    embedded = similarity.embedding_best_match(
        docs, rules, "doc_id", "text", "item_id", "text", hashed_word_embedder(64)
    )
    by_terms = matches_above(t).withColumn("method", F.lit("terms"))
    by_vectors = similarity.similar_to_clean(embedded, 0.7).withColumn("method", F.lit("embeddings"))
    kept = by_terms.unionByName(by_vectors).withColumn("max_similarity", _shown("max_similarity"))
    return kept.join(rules.withColumnRenamed("text", "clean_rule"), "item_id")


@query("c05_nlargest", sql("select doc_id, item_id, round(max_similarity, 6) as max_similarity from best order by best. max_similarity desc, doc_id limit 5", _BEST))
def nlargest(t: Tables) -> DataFrame:
    docs, rules = t.given("documents").select("doc_id", "text"), t.given("benchmark")
    top = similarity.tfidf_most_similar(docs, rules, 5, *_SIDES)
    return top.withColumn("max_similarity", _shown("max_similarity"))


_GLOBAL = f"""near as (select query_id, row_id, value, similarity, rank from (select q.query_id, c.row_id, (c.value + 1) // 2 as value,
 {dot_sql('q.embedding', 'c.embedding')} as similarity, row_number() over (partition by q.query_id
 order by {dot_sql('q.embedding', 'c.embedding')} desc, c.row_id) as rank
 from asked q join corpus c on c.row_id <> q.query_id) z where rank <= 20)"""


def _shown(name: str = "similarity") -> Column:
    """Similarities are ranked on all digits and shown on six."""
    return F.round(name, 6).alias(name)


def _global(t: Tables) -> DataFrame:
    flagged = t.corpus.withColumn("value", (F.col("value") == 1).cast("int"))
    return nearest(t.asked, flagged, 20, carry=("value",), exclude_self=True)


@query("h06_global_topk", sql("select query_id, row_id, round(similarity, 6) as similarity, rank from near", _GLOBAL))
def global_topk(t: Tables) -> DataFrame:
    return _global(t).select("query_id", "row_id", _shown(), "rank")


@query(
    "h07_mean_vote",
    sql(
        """select query_id, round(avg(value), 6) as rule_violation, count(*) as num_retrieved,
        case when avg(value) > 0.5 then 1 else 0 end as decision from near group by query_id""",
        _GLOBAL,
    ),
)
def mean_vote(t: Tables) -> DataFrame:
    """The vote over the global neighbours, here from an index of the corpus that skips cells."""
    flagged = t.corpus.withColumn("value", (F.col("value") == 1).cast("int"))
    index = vector_index.build_index(flagged, t.scratch("index"), carry=("value",))
    near = index.search(t.asked, 20, exclude_own="query_id")
    return retrieval.mean_vote(near).withColumn("rule_violation", F.round("rule_violation", 6))


RESOLVED = f"""resolved as (select q.rule as query_rule, q.rule as matched_rule, 'exact' as rule_match_type
  from query_rules q where q.rule in (select rule from corpus_rules)
  union all select query_rule, matched_rule, concat('similar (similarity: ', format('{{:.3f}}', s), ')') from (
  select q.rule as query_rule, c.rule as matched_rule, {dot_sql('q.embedding', 'c.embedding')} as s, row_number() over (
  partition by q.rule order by {dot_sql('q.embedding', 'c.embedding')} desc, c.rule) as r from query_rules q cross join corpus_rules c
  where q.rule not in (select rule from corpus_rules)) z where r = 1),
 placed_queries as (select a.*, m.matched_rule, m.rule_match_type from asked a join resolved m using (query_rule))"""

CANDIDATES = f"""{RESOLVED}, candidates as (select query_id, row_id, value, similarity, rank from (select q.query_id, c.row_id, c.value,
 {dot_sql('q.embedding', 'c.embedding')} as similarity, row_number() over (partition by q.query_id
 order by {dot_sql('q.embedding', 'c.embedding')} desc, c.row_id) as rank
 from placed_queries q join corpus c on c.rule = q.matched_rule and c.row_id <> q.query_id) z where rank <= 20)"""

RERANKED = r"""bags as (select doc_id, list_distinct(regexp_extract_all(lower(text), '[\p{L}\p{N}_]{2,}')) as ws from documents),
 reranked as (select * from (select *, row_number() over (partition by query_id order by rerank_score desc, similarity desc, row_id) as final_rank
 from (select c.*, len(list_intersect(a.ws, b.ws)) / greatest(len(a.ws), 1) as rerank_score from candidates c
 join bags a on a.doc_id = c.query_id join bags b on b.doc_id = c.row_id) x) z where final_rank <= 4)"""


def _resolved(t: Tables, fallback: bool = True) -> DataFrame:
    name = "resolved" if fallback else "resolved_exact"
    rules = t.stored(name, lambda: retrieval.resolve_rules(t.query_rules, t.corpus_rules, fallback=fallback))
    return retrieval.attach_rules(t.asked, rules)


def _candidates(t: Tables, k: int = 20) -> DataFrame:
    return retrieval.rule_candidates(_resolved(t), t.corpus, k, exclude_self=True)


def documents_by_id(t: Tables) -> tuple[DataFrame, DataFrame]:
    """Word sets of the documents, once as query texts and once as corpus texts."""
    docs = spread(t.given("documents")).select("doc_id", retrieval.word_keys("text").alias("words"))
    return (
        docs.select(F.col("doc_id").alias("query_id"), F.col("words").alias("query_text")),
        docs.select(F.col("doc_id").alias("row_id"), F.col("words").alias("doc_text")),
    )


def _reranked(t: Tables) -> DataFrame:
    words = spread(t.given("documents")).select("doc_id", retrieval.word_keys("text").alias("words"))
    queries, rows = (words.withColumnRenamed("doc_id", name) for name in ("query_id", "row_id"))
    return retrieval.rerank_by_overlap(_candidates(t), queries, rows, 4)


@query("h08_rule_topk", sql("select query_id, row_id, value, round(similarity, 6) as similarity, rank from candidates where rank <= 10", CANDIDATES))
def rule_topk(t: Tables) -> DataFrame:
    return _candidates(t, 10).select("query_id", "row_id", "value", _shown(), "rank")


@query("h09_similar_rule_fallback", sql("select * from resolved", RESOLVED))
def similar_rule_fallback(t: Tables) -> DataFrame:
    return retrieval.resolve_rules(t.query_rules, t.corpus_rules)


def _rounded(df: DataFrame) -> DataFrame:
    return df.withColumn("rule_violation", F.round("rule_violation", 6))


@query(
    "h10_not_found",
    sql(
        """select q.query_id as row_id, round(coalesce(v.s, 0.5), 6) as rule_violation,
        case when v.s >= 0 then 1 else 0 end as decision, case when v.s is not null then q.query_rule end as matched_rule,
        case when v.s is not null then 'exact' else 'not_found' end as rule_match_type,
        cast(coalesce(v.n, 0) as int) as num_retrieved, false as reranked
        from asked q left join (select query_id, round(sum(similarity * value), 9) as s, count(*) as n from candidates
        join resolved_types using (query_id) where rank <= 10 and rule_match_type = 'exact' group by query_id) v on v.query_id = q.query_id""",
        CANDIDATES + ", resolved_types as (select query_id, rule_match_type from placed_queries)",
    ),
)
def not_found(t: Tables) -> DataFrame:
    asked = _resolved(t, fallback=False)
    found = retrieval.rule_candidates(asked, t.corpus, 10, exclude_self=True)
    return _rounded(retrieval.batch_decisions(asked, retrieval.weighted_vote(found), reranked=False))


@query(
    "h11_rerank_topk",
    sql("select query_id, row_id, value, round(similarity, 6) as similarity, round(rerank_score, 6) as rerank_score, final_rank from reranked", f"{CANDIDATES}, {RERANKED}"),
)
def rerank_topk(t: Tables) -> DataFrame:
    return _reranked(t).select("query_id", "row_id", "value", _shown(), _shown("rerank_score"), "final_rank")


def vote_sql(source: str, score: str) -> str:
    return f"""select query_id, round(s, 6) as rule_violation, n as num_retrieved, case when s >= 0 then 1 else 0 end as decision
     from (select query_id, round(sum({score} * value), 9) as s, count(*) as n from {source} group by query_id) z"""


@query("h12_weighted_vote", sql(vote_sql("(select * from candidates where rank <= 10)", "similarity"), CANDIDATES))
def weighted_vote(t: Tables) -> DataFrame:
    return _rounded(retrieval.weighted_vote(_candidates(t, 10)))


# As RERANKED, but of all rows of the rule.
_RERANKED_ALL = f"""{RESOLVED}, candidates as (select q.query_id, c.row_id, c.value, {dot_sql('q.embedding', 'c.embedding')} as similarity
 from placed_queries q join corpus c on c.rule = q.matched_rule and c.row_id <> q.query_id), {RERANKED}"""


@query("h13_fused_vote", sql(vote_sql("reranked", "(0.999 * similarity + 0.001 * rerank_score)"), _RERANKED_ALL))
def fused_vote(t: Tables) -> DataFrame:
    """All rows of a query's rule are reranked, however small their similarity."""
    words = spread(t.given("documents")).select("doc_id", retrieval.word_keys("text").alias("words"))
    queries, rows = (words.withColumnRenamed("doc_id", name) for name in ("query_id", "row_id"))
    best = retrieval.best_by_overlap(_resolved(t), t.corpus, queries, rows, 4, exclude_self=True)
    return _rounded(retrieval.fused_vote(best, 0.999, 0.001))


@query(
    "h14_retrieve_detail",
    sql(
        """select p.query_id, p.matched_rule, p.rule_match_type, x.listed, coalesce(n.num_examples_in_rule, 0) as num_examples_in_rule, true as reranked,
        cast(20 as int) as retrieval_k, cast(coalesce(x.k, 0) as int) as final_k from placed_queries p left join (select query_id, count(*) as k,
        string_agg(concat(cast(row_id as varchar), ':', cast(value as varchar)), ',' order by final_rank) as listed from reranked
        group by query_id) x using (query_id) left join (select rule as matched_rule, count(*) as num_examples_in_rule from corpus group by rule) n
        using (matched_rule)""",
        f"{CANDIDATES}, {RERANKED}",
    ),
)
def retrieve_detail(t: Tables) -> DataFrame:
    detail = retrieval.retrieval_detail(_resolved(t), _reranked(t), t.corpus, 20, reranked=True)
    entry = F.transform("examples", lambda x: F.concat_ws(":", x["row_id"].cast("string"), x["value"].cast("string")))
    return detail.withColumn("listed", F.array_join(entry, ",")).drop("examples")


TASK = "Given a comment, find comments that the same rule was applied to"
_ASKED_RULE = "case when row_id % 10 = 3 then concat('Unlisted: ', rule) else rule end"
_INSTRUCT = f"concat('Instruct: {TASK}', chr(10), 'Query: ', {{}})"

_FLAGSHIP = rf"""{corpus_sql()},
 texts as (select 'c' as side, row_id * 8 + source_rank as id, rule, body, value from text_corpus union all
  select 'q', row_id, {_ASKED_RULE}, {scrub_sql("concat('r/', subreddit, chr(10), 'Comment: ', test_comment)")}, rule_violation from train),
 encoded as (select side, cast(id as varchar) as id, {_INSTRUCT.format('body')} as body from texts union all
  select 'r', rule, {_INSTRUCT.format("concat('rule: ', rule)")} from (select distinct rule from texts) r),
 words as (select side, id, unnest(regexp_extract_all(lower(body), '[\p{{L}}\p{{N}}_]{{2,}}')) as w from encoded),
 slots as (select side, id, cast(concat('0x', substr(md5(w), 1, 4)) as bigint) % 64 as slot, cast(count(*) as double) as n from words group by all),
 dense as (select t.side, t.id, list(coalesce(s.n, 0) order by g.slot) as v from encoded t cross join (select unnest(range(64)) as slot) g
  left join slots s on s.side = t.side and s.id = t.id and s.slot = g.slot group by t.side, t.id),
 unit as (select side, id, list_transform(v, lambda x: x / greatest(sqrt(list_inner_product(v, v)), 1e-300)) as v from dense),
 known as (select distinct rule from texts where side = 'c'),
 unknown as (select distinct rule from texts where side = 'q' and rule not in (select rule from known)),
 matched as (select rule as query_rule, rule as matched_rule, 'exact' as rule_match_type from known union all
  select query_rule, matched_rule, concat('similar (similarity: ', format('{{:.3f}}', s), ')') from (select u.rule as query_rule,
  k.rule as matched_rule, {dot_sql('a.v', 'b.v')} as s, row_number() over (partition by u.rule order by {dot_sql('a.v', 'b.v')} desc, k.rule) as r
  from unknown u cross join known k join unit a on a.side = 'r' and a.id = u.rule join unit b on b.side = 'r' and b.id = k.rule) z where r = 1),
 bags as (select side, id, list_distinct(regexp_extract_all(lower(body), '[\p{{L}}\p{{N}}_]{{2,}}')) as ws from texts),
 found as (select * from (select *, row_number() over (partition by query_id order by similarity desc, cid) as rank from (
  select q.id as query_id, c.id as cid, c.value, {dot_sql('u.v', 'w.v')} as similarity from texts q
  join matched m on m.query_rule = q.rule join texts c on c.rule = m.matched_rule and c.side = 'c' and q.side = 'q'
  join unit u on u.side = 'q' and u.id = cast(q.id as varchar) join unit w on w.side = 'c' and w.id = cast(c.id as varchar)) x) y where rank <= 100),
 best4 as (select * from (select *, row_number() over (partition by query_id order by rerank desc, similarity desc, cid) as fr from (
  select f.*, len(list_intersect(a.ws, b.ws)) / greatest(len(a.ws), 1) as rerank from found f
  join bags a on a.side = 'q' and a.id = f.query_id join bags b on b.side = 'c' and b.id = f.cid) x) y where fr <= 4),
 flagship as (select t.row_id, m.matched_rule, m.rule_match_type, round(v.s, 6) as rule_violation, case when v.s >= 0 then 1 else 0 end as decision,
  cast(v.n as int) as num_retrieved, t.rule_violation as truth from (select *, {_ASKED_RULE} as asked_rule from train) t
  join matched m on m.query_rule = t.asked_rule join (
  select query_id, round(sum((0.999 * similarity + 0.001 * rerank) * value), 9) as s, count(*) as n from best4 group by query_id) v
  on v.query_id = t.row_id),
 metrics as (select {RATIOS} from (select {cells_sql('truth', 'decision')} from flagship) z)"""


def flagship_decisions(t: Tables) -> DataFrame:
    """Decisions for every labelled comment against the corpus of labelled and sampled rows.

    One comment in ten asks for a rule that the corpus does not have.
    """
    asked = F.when(F.col("row_id") % 10 == 3, F.concat(F.lit("Unlisted: "), F.col("rule"))).otherwise(F.col("rule"))

    def query_rows() -> DataFrame:
        return query_prompts(t.train_with().withColumnRenamed("test_comment", "body")).select(F.col("row_id").alias("query_id"), asked.alias("rule"), "body")

    # The scrubbed texts are read by the embedder and by the reranker: write them once.
    corpus = t.stored("text_corpus", lambda: text_corpus(t))
    queries = t.stored("text_queries", query_rows)
    settings = RetrievalSettings(similarity_weight=0.999, rerank_weight=0.001, instruction=TASK)
    return classify(queries, corpus, settings)


@query(
    "h15_end_to_end_classify",
    sql(
        """select row_id, rule_violation, decision, decision as submitted, matched_rule, rule_match_type, num_retrieved,
        true as reranked, truth, accuracy, precision, recall, f1 from flagship cross join metrics""",
        _FLAGSHIP,
    ),
)
def end_to_end_classify(t: Tables) -> DataFrame:
    """Decisions, the submission file read back, and the scores of the whole run on every row."""
    truth = t.train_with().select("row_id", F.col("rule_violation").alias("truth"))
    judged = written(_rounded(flagship_decisions(t)).join(truth, "row_id"), "decisions")
    path = t.scratch("submission")
    csvfiles.write_submission(judged, path, decision="decision")
    submission = csvfiles.csv_scan(t.spark, path, T.StructType.fromDDL("row_id long, rule_violation int"))
    both = judged.join(submission.withColumnRenamed("rule_violation", "submitted"), "row_id")
    scores = evaluation.binary_metrics(judged, "truth", "decision")
    names = ("accuracy", "precision", "recall", "f1")
    return both.withColumns({c: F.round(scores.select(c).scalar(), 6) for c in names})
