"""Model-response parsing."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rulewell.functions import responses
from rulewell.operators.scoring import compare_variants
from rulewell.workload.registry import query
from rulewell.workload.tables import Tables, sql


def _field_sql(label: str, column: str = "response") -> str:
    """Last line that starts with the label, label removed, stripped."""
    lines = f"list_transform(string_split({column}, chr(10)), lambda s: regexp_replace(s, '^\\s+|\\s+$', '', 'g'))"
    last = f"list_filter({lines}, lambda s: starts_with(s, '{label}'))[-1]"
    return f"regexp_replace(replace({last}, '{label}', ''), '^\\s+|\\s+$', '', 'g')"


def _fields_sql(fields: dict[str, str]) -> str:
    return ", ".join(f"{_field_sql(label)} as {name}" for label, name in fields.items())


def _parsed(t: Tables, fields: dict[str, str]) -> DataFrame:
    parsed = t.responses.withColumn("p", responses.labelled_lines("response", fields))
    return parsed.select("row_id", *[F.col(f"p.{name}") for name in fields.values()])


@query("f01_parse_moderation", sql(f"select row_id, {_fields_sql(responses.MODERATION)} from responses"))
def parse_moderation(t: Tables) -> DataFrame:
    return _parsed(t, responses.MODERATION)


@query("f02_parse_formatted", sql(f"select row_id, {_fields_sql(responses.FORMATTED)} from responses"))
def parse_formatted(t: Tables) -> DataFrame:
    return _parsed(t, responses.FORMATTED)


@query("f03_parse_examples14", sql(f"select row_id, {_fields_sql(responses.NUMBERED_EXAMPLES)} from responses"))
def parse_examples(t: Tables) -> DataFrame:
    return _parsed(t, responses.NUMBERED_EXAMPLES)


@query("f04_parse_rule_format", sql(f"select row_id, {_fields_sql(responses.RULE_FORMAT)} from responses"))
def parse_rule_format(t: Tables) -> DataFrame:
    return _parsed(t, responses.RULE_FORMAT)


_RESULTS = f"""results as (select row_id, {_fields_sql(responses.FORMATTED)}, response as raw_response, error from (
 select row_id, case when row_id % 10 = 7 then null else response end as response, case when row_id % 10 = 7 then 'quota exceeded'
 when response is null then 'No response from model' end as error from responses) q)"""


def result_rows(t: Tables) -> DataFrame:
    failed = t.responses.withColumn("failure", F.when(F.col("row_id") % 10 == 7, F.lit("quota exceeded")))
    return failed.select("row_id", *responses.result_fields("response", responses.FORMATTED, error="failure"))


@query("f05_result_rows", sql("select * from results", _RESULTS))
def results(t: Tables) -> DataFrame:
    return result_rows(t)


@query(
    "f06_yes_no",
    sql(
        r"""select row_id, case when regexp_matches(answer, '(?i)(^|[^\p{L}\p{N}_])(yes|y)($|[^\p{L}\p{N}_])') then 'Yes'
        when regexp_matches(answer, '(?i)(^|[^\p{L}\p{N}_])(no|n)($|[^\p{L}\p{N}_])') then 'No' end as said from answers"""
    ),
)
def yes_no(t: Tables) -> DataFrame:
    return t.answers.select("row_id", responses.yes_no("answer").alias("said"))


@query("f07_contains_yes", sql("select row_id, coalesce(cast(contains(lower(answer), 'yes') as int), 0) as flag from answers"))
def contains_yes(t: Tables) -> DataFrame:
    return t.answers.select("row_id", responses.contains_yes("answer").alias("flag"))


@query(
    "f08_extract_probability",
    sql(
        r"""select row_id, round((case when x is null then 0.5 else least(greatest(case when x > 1 then x / 100 else x end, 0.0), 1.0) end), 6) as probability
        from (select row_id, try_cast(regexp_extract(string_split(scored_text, '### Response:')[-1], '(\d+\.?\d*)', 1) as double) as x
        from answers) z"""
    ),
)
def extract_probability(t: Tables) -> DataFrame:
    return t.answers.select("row_id", F.round(responses.probability("scored_text"), 6).alias("probability"))


_PROBABILITIES = """probs as (select row_id, rule_violation, coalesce(max(exp(logprob)) filter (where token = 'Yes'), 0) as y,
 coalesce(max(exp(logprob)) filter (where token = 'No'), 0) as n, arg_min(token, row(-logprob, token_id)) as best
 from token_rows group by row_id, rule_violation)"""


@query(
    "f09_logprob_score",
    sql(
        """select row_id, trim(best) as prediction, y / (y + n + 1e-15) > 0.5 as is_violation,
        round(y / (y + n + 1e-15), 6) as violation_probability, round(greatest(y, n) / (y + n + 1e-15), 6) as confidence,
        round(y, 6) as raw_probability, round(greatest(y, n), 6) as raw_confidence from probs""",
        _PROBABILITIES,
    ),
)
def logprob_score(t: Tables) -> DataFrame:
    scored = t.tokens.select(
        "row_id",
        responses.logprob_score("tokens").alias("s"),
        responses.logprob_score("tokens", normalize=False).alias("r"),
    )
    return scored.select(
        "row_id",
        "s.prediction",
        "s.is_violation",
        F.round("s.violation_probability", 6).alias("violation_probability"),
        F.round("s.confidence", 6).alias("confidence"),
        F.round("r.violation_probability", 6).alias("raw_probability"),
        F.round("r.confidence", 6).alias("raw_confidence"),
    )


@query(
    "f10_token_topk",
    sql(
        """select row_id, rank, token_id, token, round(exp(logprob), 6) as probability, yes_rank, no_rank from (select *,
        max(case when token = 'Yes' then rank end) over (partition by row_id) as yes_rank,
        max(case when token = 'No' then rank end) over (partition by row_id) as no_rank from (select *,
        row_number() over (partition by row_id order by logprob desc, token_id) as rank from token_rows) y) z where rank <= 3"""
    ),
)
def token_topk(t: Tables) -> DataFrame:
    ranked = t.tokens.withColumn("ranked", responses.ranked_tokens("tokens"))
    listed = ranked.select(
        "row_id",
        responses.token_rank("ranked", "Yes").alias("yes_rank"),
        responses.token_rank("ranked", "No").alias("no_rank"),
        F.posexplode(F.slice("ranked", 1, 3)).alias("pos", "x"),
    )
    return listed.select(
        "row_id",
        (F.col("pos") + 1).cast("long").alias("rank"),
        F.col("x.token_id"),
        F.col("x.token"),
        F.round(F.exp("x.logprob"), 6).alias("probability"),
        "yes_rank",
        "no_rank",
    )


@query(
    "f11_ab_compare",
    sql(
        """select row_id, token_id, round(a, 6) as probability_a, round(b, 6) as probability_b, round(coalesce(b, 0) - coalesce(a, 0), 6) as delta
        from (select coalesce(x.row_id, y.row_id) as row_id, coalesce(x.token_id, y.token_id) as token_id, x.p as a, y.p as b
        from (select row_id, token_id, exp(logprob) as p from token_rows where not (token_id = 3 and row_id % 2 = 0)) x
        full outer join (select row_id, token_id, exp(logprob * 2) as p from token_rows where token_id <> 4) y
        on x.row_id = y.row_id and x.token_id = y.token_id) z"""
    ),
)
def ab_compare(t: Tables) -> DataFrame:
    listed = t.tokens.select("row_id", F.inline("tokens"))
    base = listed.filter(~((F.col("token_id") == 3) & (F.col("row_id") % 2 == 0)))
    tuned = listed.filter(F.col("token_id") != 4).withColumn("logprob", F.col("logprob") * 2)
    both = compare_variants(base, tuned, ["row_id", "token_id"])
    return both.select(
        "row_id",
        "token_id",
        F.round("probability_a", 6).alias("probability_a"),
        F.round("probability_b", 6).alias("probability_b"),
        F.round("delta", 6).alias("delta"),
    )


@query(
    "f12_softmax_decision",
    sql(
        """select row_id, case when y > n then 'Yes' else 'No' end as prediction,
        round(greatest(exp(y), exp(n)) / (exp(y) + exp(n)), 6) as confidence from (select row_id,
        coalesce(max(logprob) filter (where token = 'Yes'), -9.0) as y, coalesce(max(logprob) filter (where token = 'No'), -9.0) as n
        from token_rows group by row_id) z"""
    ),
)
def softmax_decision(t: Tables) -> DataFrame:
    def logit(token: str):
        hit = F.try_element_at(F.filter("tokens", lambda x: x["token"] == token), F.lit(1))["logprob"]
        return F.coalesce(hit, F.lit(-9.0))

    decided = t.tokens.select("row_id", responses.softmax_decision(F.array(logit("No"), logit("Yes"))).alias("d"))
    return decided.select("row_id", "d.prediction", F.round("d.confidence", 6).alias("confidence"))
