"""Profiling and evaluation."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rulewell.functions import responses
from rulewell.operators import evaluation, profiling, retrieval, sampling
from rulewell.operators.reshape import melt_scores, unpivot_with_main
from rulewell.workload.q_cleaning import _BOOL, ALL_TEXTS, _words
from rulewell.workload.q_parsing import _RESULTS, result_rows
from rulewell.workload.q_reshape import _IDS, _KEEP, _MAIN, _MELTED, _MODELS, _long_sql
from rulewell.workload.q_retrieval import (
    _BEST,
    CANDIDATES,
    _candidates,
    matches_above,
    not_found,
)
from rulewell.workload.registry import SQL, query
from rulewell.workload.sqltext import RATIOS as _RATIOS
from rulewell.workload.sqltext import cells_sql as _cells_sql
from rulewell.workload.tables import Tables, sql


@query("i01_value_counts", sql("select violates_rule, count(*) as count from wide where violates_rule is not null group by 1"))
def value_counts(t: Tables) -> DataFrame:
    return profiling.value_counts(t.wide_with(), "violates_rule")


@query(
    "i02_group_size_stats",
    sql(
        f"""select count(*) as groups, round(avg(n), 6) as mean_size, median(n) as median_size, min(n) as min_size, max(n) as max_size
        from (select rule, count(*) as n from ({_long_sql('train', _KEEP, _MAIN)}) x group by rule) z"""
    ),
)
def group_size_stats(t: Tables) -> DataFrame:
    long = unpivot_with_main(t.train, ["row_id", "rule"], "test_comment", "rule_violation")
    return profiling.group_size_stats(long, "rule").withColumn("mean_size", F.round("mean_size", 6))


_COUNTED = ("subreddit", "rule", "violates_rule", "positive_example_1")


@query(
    "i03_distinct_count",
    sql(" union all ".join(f"select '{c}' as column_name, count(distinct {c}) as distinct_values from wide" for c in _COUNTED)),
)
def distinct_count(t: Tables) -> DataFrame:
    return profiling.distinct_counts(t.wide_with("positive_example_1"), _COUNTED)


@query(
    "i04_histogram",
    sql(
        """select column_name, cast(least(99, floor((w - case when hi = lo then lo - 0.5 else lo end) /
        (case when hi = lo then 0.01 else (hi - lo) / 100 end))) as int) as bin, count(*) as frequency
        from (select *, min(w) over (partition by column_name) as lo, max(w) over (partition by column_name) as hi from (
        """
        + " union all ".join(f"select '{c}' as column_name, {_words(c)} as w from wide" for c in ALL_TEXTS)
        + ") x) y group by 1, 2"
    ),
)
def histogram(t: Tables) -> DataFrame:
    return profiling.word_histogram(t.wide, ALL_TEXTS)


@query(
    "i05_generation_summary",
    sql(
        """select count(*) as total, count(*) filter (where error is null) as succeeded, count(error) as failed,
        round((count(*) - count(error)) * 100.0 / count(*), 6) as success_percent, round(count(error) * 100.0 / count(*), 6) as error_percent,
        count(distinct subreddit) as communities, count(distinct rule) as rules, count(formatted_rule) as formatted,
        count(positive_example_1) as with_examples from (select r.*, t.subreddit, t.rule from (
        select row_id, formatted_rule, positive_example_1, error from results) r join train t using (row_id)) z""",
        _RESULTS,
    ),
)
def generation_summary(t: Tables) -> DataFrame:
    rows = result_rows(t).select("row_id", "formatted_rule", "positive_example_1", "error")
    summary = profiling.generation_summary(rows.join(t.train_with().select("row_id", "subreddit", "rule"), "row_id"))
    return summary.withColumns({c: F.round(c, 6) for c in ("success_percent", "error_percent")})


@query(
    "i06_clarity_counts",
    sql(
        """select row_id, clear, unclear from (select row_id, response, count(*) filter (where response like '%' || chr(10) || 'Clarity Tag: Clear' || chr(10) || '%') over () as clear,
        count(*) filter (where response like '%' || chr(10) || 'Clarity Tag: Unclear' || chr(10) || '%') over () as unclear from responses) z where response like '%' || chr(10) || 'Clarity Tag: Unclear' || chr(10) || '%' order by row_id limit 5"""
    ),
)
def clarity_counts(t: Tables) -> DataFrame:
    """The counts, beside the first few rows that were found unclear."""
    labelled = responses.labelled_lines("response", responses.RULE_FORMAT).alias("p")
    parsed = t.responses.select("row_id", labelled).select("row_id", "p.*")
    counts = profiling.clarity_counts(parsed)
    sample = profiling.unclear_rows(parsed, "row_id").select("row_id")
    return sample.withColumns({c: counts.select(c).scalar() for c in counts.columns})


@query(
    "i07_class_balance",
    sql(
        """select count(*) as total, count(*) filter (where rule_violation = 1) as positives,
        count(*) filter (where rule_violation = 0) as negatives from wide"""
    ),
)
def class_balance(t: Tables) -> DataFrame:
    return profiling.class_balance(t.wide_with())


@query(
    "i08_max_text_width",
    sql(
        """select distinct scoring_dataset, train_dataset, pred_model_type, concat(
        rpad(scoring_dataset, cast((select max(length(scoring_dataset)) from melted) as int), ' '), ' | ',
        rpad(train_dataset, cast((select max(length(train_dataset)) from melted) as int), ' '), ' | ', pred_model_type) as label from melted""",
        _MELTED,
    ),
)
def max_text_width(t: Tables) -> DataFrame:
    long = melt_scores(t.scores, _IDS, _MODELS)
    return profiling.padded_labels(long, "scoring_dataset", "train_dataset", "pred_model_type")


_PROFILED = SQL["h10_not_found"].replace(
    "select q.query_id as row_id,",
    "select regexp_extract(rule_match_type, '^[a-z_]+') as match_kind, num_retrieved, reranked, count(*) as queries "
    "from (select q.query_id as row_id,",
)


@query("i09_retrieval_profile", f"{_PROFILED}) final group by 1, 2, 3")
def retrieval_profile(t: Tables) -> DataFrame:
    return profiling.retrieval_profile(not_found(t))


@query(
    "i10_similarity_reduction",
    sql(
        """select count(*) as original, count(*) filter (where max_similarity >= 0.3) as kept,
        round((1 - count(*) filter (where max_similarity >= 0.3) / count(*)) * 100, 6) as reduction_percent from best""",
        _BEST,
    ),
)
def similarity_reduction(t: Tables) -> DataFrame:
    every = t.given("documents").select("doc_id").join(matches_above(t, 0.3), "doc_id", "left")
    report = profiling.reduction_report(every, "max_similarity", 0.3)
    return report.withColumn("reduction_percent", F.round("reduction_percent", 6))


_METRICS = ("accuracy", "precision", "recall", "f1")


def _rounded_metrics(df: DataFrame, *more: str) -> DataFrame:
    return df.withColumns({c: F.round(c, 6) for c in (*_METRICS, *more) if c in df.columns})


@query("j01_confusion", sql(f"select {_cells_sql('rule_violation', 'predicted')} from predicted"))
def confusion(t: Tables) -> DataFrame:
    return evaluation.confusion(t.predicted, "rule_violation", "predicted")


@query(
    "j02_binary_metrics",
    sql(f"select rule, tp, fp, fn, tn, {_RATIOS} from (select rule, {_cells_sql('rule_violation', 'predicted')} from predicted group by rule) z"),
)
def binary_metrics(t: Tables) -> DataFrame:
    return _rounded_metrics(evaluation.binary_metrics(t.predicted, "rule_violation", "predicted", by=["rule"]))


_REPORT = f"""cells as (select {_cells_sql('rule_violation', 'predicted')} from predicted),
 per_class as (select 'No Violation' as label, tn / nullif(tn + fn, 0) as p, tn / nullif(tn + fp, 0) as r,
  2 * tn / nullif(2 * tn + fn + fp, 0) as f, tn + fp as support from cells
  union all select 'Violation', tp / nullif(tp + fp, 0), tp / nullif(tp + fn, 0), 2 * tp / nullif(2 * tp + fp + fn, 0), tp + fn from cells),
 weighted as (select sum(p * support) / sum(support) as p, sum(r * support) / sum(support) as r, sum(f * support) / sum(support) as f,
  sum(support) as support from per_class)"""


@query(
    "j03_class_report",
    sql(
        """select label, round(coalesce(p, 0), 6) as precision, round(coalesce(r, 0), 6) as recall, round(coalesce(f, 0), 6) as f1,
        cast(support as bigint) as support from (select * from per_class union all select 'weighted avg', * from weighted
        union all select 'macro avg', avg(p), avg(r), avg(f), sum(support) from per_class
        union all select 'accuracy', (tp + tn) / (tp + fp + fn + tn), (tp + tn) / (tp + fp + fn + tn), (tp + tn) / (tp + fp + fn + tn),
        tp + fp + fn + tn from cells) z""",
        _REPORT,
    ),
)
def class_report(t: Tables) -> DataFrame:
    return _rounded_metrics(evaluation.class_report(t.predicted, "rule_violation", "predicted"))


_ARGMAX = """decided as (select row_id, rule_violation, case when y > n then 1 else 0 end as predicted from (select row_id, rule_violation,
 coalesce(max(logprob) filter (where token = 'Yes'), -9.0) as y, coalesce(max(logprob) filter (where token = 'No'), -9.0) as n
 from token_rows group by row_id, rule_violation) z)"""


@query(
    "j04_weighted_metrics",
    sql(
        """select round((tp + tn) / (tp + fp + fn + tn), 6) as accuracy, round(w.p, 6) as precision, round(w.r, 6) as recall,
        round(w.f, 6) as f1 from weighted w, cells""",
        _ARGMAX + ", " + _REPORT.replace("from predicted)", "from decided)"),
    ),
)
def weighted_metrics(t: Tables) -> DataFrame:
    def logit(token: str):
        hit = F.try_element_at(F.filter("tokens", lambda x: x["token"] == token), F.lit(1))["logprob"]
        return F.coalesce(hit, F.lit(-9.0))

    decision = responses.softmax_decision(F.array(logit("No"), logit("Yes")))["prediction"]
    decided = t.tokens.withColumn("predicted", (decision == "Yes").cast("int"))
    return _rounded_metrics(evaluation.weighted_metrics(decided, "rule_violation", "predicted"))


@query(
    "j05_coverage_summary",
    sql(
        f"""select total_rows, valid_rows, round(valid_rows * 100 / total_rows, 6) as success_rate, tp, fp, fn, tn, {_RATIOS} from (
        select count(*) as total_rows, count(*) filter (where ok) as valid_rows, {_cells_sql('a', 'b')} from (
        select ok, case when ok then cast(a as int) end as a, case when ok then cast(b as int) end as b from (
        select a, b, coalesce(a is not null and b is not null and prediction <> 'Error', false) as ok from (
        select {_BOOL.format('violates_rule')} as a, {_BOOL.format('prediction')} as b, prediction from predicted) x) y) z) q"""
    ),
)
def coverage_summary(t: Tables) -> DataFrame:
    return _rounded_metrics(evaluation.coverage_summary(t.predicted, "violates_rule", "prediction"), "success_rate")


@query(
    "j06_threshold",
    sql(
        r"""select row_id, cast((case when x is null then 0.5 else least(greatest(case when x > 1 then x / 100 else x end, 0.0), 1.0) end) >= 0.5 as int) as decision
        from (select row_id, try_cast(regexp_extract(string_split(scored_text, '### Response:')[-1], '(\d+\.?\d*)', 1) as double) as x
        from answers) z"""
    ),
)
def threshold(t: Tables) -> DataFrame:
    scored = t.answers.select("row_id", responses.probability("scored_text").alias("p"))
    return scored.select("row_id", evaluation.threshold("p").alias("decision"))


_KS = [1, 5, 10, 20]
_SWEEP = f"""{CANDIDATES}, swept as (select k.k as top_k, c.query_id, case when round(sum(similarity * value), 9) >= 0 then 1 else 0 end as decision
 from candidates c join (select unnest({_KS}) as k) k on c.rank <= k.k group by 1, 2),
 sweep as (select top_k, tp, fp, fn, tn, {_RATIOS} from (select top_k, {_cells_sql('truth', 'decision')} from swept join asked using (query_id)
 group by top_k) z)"""


def _sweep(t: Tables) -> DataFrame:
    votes = retrieval.sweep_votes(_candidates(t), _KS)
    judged = votes.join(t.asked.select("query_id", "truth"), "query_id")
    return _rounded_metrics(evaluation.binary_metrics(judged, "truth", "decision", by=["top_k"]))


@query("j07_topk_sweep", sql("select * from sweep", _SWEEP))
def topk_sweep(t: Tables) -> DataFrame:
    return _sweep(t)


@query("c06_best_config", sql("select top_k, f1 from sweep order by f1 desc, top_k limit 1", _SWEEP))
def best_config(t: Tables) -> DataFrame:
    return sampling.best_row(_sweep(t), "f1", "top_k").select("top_k", "f1")


@query(
    "j08_standardised_f1",
    sql(
        rf"""select total_rows, valid_rows, standardised_rows, tp, fp, fn, tn, {_RATIOS} from (select count(*) as total_rows,
        count(*) filter (where answer <> '') as valid_rows, count(*) filter (where answer <> '' and said is not null) as standardised_rows,
        {_cells_sql('truth', "case when answer <> '' then said end")} from (select answer, case when regexp_matches(answer, '(?i)(^|[^\p{{L}}\p{{N}}_])(yes|y)($|[^\p{{L}}\p{{N}}_])') then 1
        when regexp_matches(answer, '(?i)(^|[^\p{{L}}\p{{N}}_])(no|n)($|[^\p{{L}}\p{{N}}_])') then 0 end as said, case when trim(violates_rule) in ('True', 'Yes') then 1
        when trim(violates_rule) in ('False', 'No') then 0 end as truth from answers) x) z"""
    ),
)
def standardised_f1(t: Tables) -> DataFrame:
    return _rounded_metrics(evaluation.standardised_f1(t.answers, "violates_rule", "answer"))


@query(
    "j09_centred_decision",
    sql(
        f"""select query_id, round(c, 6) as centred, case when round(c, 9) > 0 then 1 else 0 end as decision from (
        select query_id, s / 10 - avg(s / 10) over () as c from (
        select query_id, round(sum(similarity * value), 9) as s from candidates where rank <= 10 group by query_id) x) z""",
        CANDIDATES,
    ),
)
def centred_decision(t: Tables) -> DataFrame:
    votes = retrieval.weighted_vote(_candidates(t, 10)).select("query_id", "rule_violation")
    decided = evaluation.centred_decision(votes, "rule_violation", 10)
    return decided.select("query_id", F.round("centred", 6).alias("centred"), "decision")
