"""Projections, filters, label and text cleaning."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rulewell.functions import labels, text
from rulewell.operators import cleaning
from rulewell.operators.parallel import spread
from rulewell.operators.reshape import signed_values
from rulewell.schemas import EXAMPLE_COLUMNS, TRAINING_COLUMNS
from rulewell.workload.registry import query
from rulewell.workload.sqltext import scrub_sql
from rulewell.workload.tables import Tables, sql

_TEXTS = (*EXAMPLE_COLUMNS, "test_comment")
_STRIPPED = r"regexp_replace(violates_rule, '^\s+|\s+$', '', 'g')"
_UNQUOTED = f"""regexp_replace(regexp_replace({_STRIPPED}, '^"+|"+$', '', 'g'), '^''+|''+$', '', 'g')"""


def _present(*columns: str) -> str:
    return " and ".join(f"{c} is not null" for c in columns)


@query("b01_drop_incomplete", sql(f"select row_id, {', '.join(TRAINING_COLUMNS)} from wide where {_present(*TRAINING_COLUMNS)}"))
def drop_incomplete(t: Tables) -> DataFrame:
    return cleaning.drop_incomplete(t.wide, ["row_id", *TRAINING_COLUMNS])


@query("b02_drop_null_subset", sql("select row_id, violates_rule, positive_example_1 from wide where violates_rule is not null"))
def drop_null_subset(t: Tables) -> DataFrame:
    return cleaning.drop_missing(t.wide_with("positive_example_1"), ["violates_rule"]).select("row_id", "violates_rule", "positive_example_1")


@query(
    "b03_null_audit",
    sql(
        " union all ".join(
            f"select '{c}' as column_name, count(*) filter (where {c} is null) as dropped_rows, count(*) as rows_before, "
            f"count(*) filter (where {_present(*TRAINING_COLUMNS)}) as rows_after from wide"
            for c in TRAINING_COLUMNS
        )
    ),
)
def null_audit(t: Tables) -> DataFrame:
    return cleaning.null_audit(t.wide, TRAINING_COLUMNS)


def _labelled(t: Tables, column) -> DataFrame:
    return t.wide_with().select("row_id", column.alias("label"))


@query(
    "b04_norm_strict",
    sql(
        f"""select row_id, case when s in ('True', 'Yes') then 'Yes' when s in ('False', 'No') then 'No' end as label from (
        select row_id, regexp_replace(regexp_replace({_STRIPPED}, '^["'']|["'']$', '', 'g'), '^\\s+|\\s+$', '', 'g') as s from wide) z"""
    ),
)
def norm_strict(t: Tables) -> DataFrame:
    return _labelled(t, labels.strict("violates_rule"))


@query(
    "b05_norm_lenient",
    sql(
        f"""select row_id, case when s in ('yes', 'true', '1', 'y', 't') then 'Yes' when s in ('no', 'false', '0', 'n', 'f') then 'No' end as label
        from (select row_id, lower(regexp_replace({_UNQUOTED}, '^\\s+|\\s+$', '', 'g')) as s from wide) z"""
    ),
)
def norm_lenient(t: Tables) -> DataFrame:
    return _labelled(t, labels.lenient("violates_rule"))


@query(
    "b06_norm_plain",
    sql(
        f"""select row_id, label from (select row_id, case when {_STRIPPED} in ('True', 'Yes') then 'Yes'
        when {_STRIPPED} in ('False', 'No') then 'No' end as label from wide) z where label in ('Yes', 'No')"""
    ),
)
def norm_plain(t: Tables) -> DataFrame:
    return _labelled(t, labels.plain("violates_rule")).filter(F.col("label").isin("Yes", "No"))


@query(
    "b07_norm_eval",
    sql(f"select row_id, case when lower({_UNQUOTED}) = 'yes' then 1 when lower({_UNQUOTED}) = 'no' then 0 end as label from wide"),
)
def norm_eval(t: Tables) -> DataFrame:
    return _labelled(t, labels.evaluation("violates_rule"))


@query(
    "b08_norm_unknown",
    sql(
        f"""select row_id, case when s in ('Yes', 'No') then s else 'Unknown' end as label from (
        select row_id, upper(substr(u, 1, 1)) || lower(substr(u, 2)) as s from (select row_id, {_UNQUOTED} as u from wide) y) z"""
    ),
)
def norm_unknown(t: Tables) -> DataFrame:
    return _labelled(t, labels.or_unknown("violates_rule"))


@query(
    "b09_norm_bool",
    sql(
        f"""select row_id, case when lower({_STRIPPED}) in ('true', '1', 'yes', 'y') then true
        when lower({_STRIPPED}) in ('false', '0', 'no', 'n') then false end as label from wide"""
    ),
)
def norm_bool(t: Tables) -> DataFrame:
    return _labelled(t, labels.to_boolean("violates_rule"))


@query("b10_norm_truefalse", sql("select row_id, violates_rule from wide where violates_rule in ('True', 'False')"))
def norm_truefalse(t: Tables) -> DataFrame:
    return t.wide_with().filter(labels.is_true_false("violates_rule")).select("row_id", "violates_rule")


@query(
    "b11_label_to_int",
    sql(
        """select row_id, case violates_rule when 'Yes' then 1 when 'No' then 0 end as as_int,
        case rule_violation when 1 then 'Yes' when 0 then 'No' end as as_yes_no,
        case when rule_violation = 1 then 'True' else 'False' end as as_true_false from wide"""
    ),
)
def label_to_int(t: Tables) -> DataFrame:
    return t.wide_with().select(
        "row_id",
        labels.yes_no_to_int("violates_rule").alias("as_int"),
        labels.int_to_yes_no("rule_violation").alias("as_yes_no"),
        labels.int_to_true_false("rule_violation").alias("as_true_false"),
    )


@query(
    "b12_signed_value",
    sql(
        """select row_id, rule_violation, case when rule_violation = 0 then -1 else rule_violation end as value
        from (select row_id, coalesce(rule_violation, 100) as rule_violation from wide) z where rule_violation in (0, 1)"""
    ),
)
def signed_value(t: Tables) -> DataFrame:
    marked = t.wide_with().select("row_id", F.coalesce("rule_violation", F.lit(100)).alias("rule_violation"))
    return signed_values(marked)


def _words(c: str) -> str:
    return rf"len(regexp_extract_all(coalesce({c}, 'nan'), '\S+'))"


# Every text column of the training table.
ALL_TEXTS = ["subreddit", "rule", *EXAMPLE_COLUMNS, "test_comment", "violates_rule"]


@query(
    "b13_word_count",
    sql(f"select row_id, {', '.join(f'{_words(c)} as {c}_word_count' for c in ALL_TEXTS)} from wide"),
)
def word_count(t: Tables) -> DataFrame:
    counted = cleaning.add_word_counts(t.wide, ALL_TEXTS)
    return counted.select("row_id", *[f"{c}_word_count" for c in ALL_TEXTS])


@query(
    "b14_max_words",
    sql(f"select row_id, rule, test_comment from wide where {' and '.join(f'{_words(c)} <= 120' for c in ALL_TEXTS)}"),
)
def max_words(t: Tables) -> DataFrame:
    return cleaning.max_words(t.wide, ALL_TEXTS).select("row_id", "rule", "test_comment")


@query("b15_min_words", sql(f"select row_id from wide where {' and '.join(f'{_words(c)} >= 1' for c in _TEXTS)}"))
def min_words(t: Tables) -> DataFrame:
    return cleaning.min_words(t.wide, _TEXTS).select("row_id")


@query("b16_blank_filter", sql(r"select row_id, positive_example_1 from wide where regexp_matches(positive_example_1, '\S')"))
def blank_filter(t: Tables) -> DataFrame:
    return cleaning.drop_blank(t.wide_with("positive_example_1"), "positive_example_1").select("row_id", "positive_example_1")


@query(
    "b17_scrub",
    sql(
        f"""select 'document' as kind, doc_id as id, {scrub_sql('text')} as cleaned from documents
        union all select 'url', page_id, {scrub_sql('url')} from pages
        union all select 'html', page_id, {scrub_sql('html')} from pages"""
    ),
)
def scrub(t: Tables) -> DataFrame:
    docs = t.given("documents").select(F.lit("document").alias("kind"), F.col("doc_id").alias("id"), F.col("text").alias("c"))
    pages = t.given("pages")
    sides = [pages.select(F.lit(kind).alias("kind"), F.col("page_id").alias("id"), F.col(kind).alias("c")) for kind in ("url", "html")]
    return spread(docs.unionAll(sides[0]).unionAll(sides[1])).select("kind", "id", text.scrub("c").alias("cleaned"))


@query(
    "b18_concat_collapse",
    sql(
        r"""select row_id, regexp_replace(regexp_replace(concat(coalesce(violates_rule, ''), ' ', coalesce(positive_example_1, ''), ' ',
        coalesce(test_comment, '')), '^\s+|\s+$', '', 'g'), '\s+', ' ', 'g') as combined from wide"""
    ),
)
def concat_collapse(t: Tables) -> DataFrame:
    joined = text.concat_collapse("violates_rule", "positive_example_1", "test_comment")
    return t.wide_with("positive_example_1").select("row_id", joined.alias("combined"))


@query(
    "b19_dedupe_first",
    sql(
        """select row_id, subreddit, rule_violation, body from (select *, row_number() over (partition by body order by row_id) as r
        from snip) z where r = 1"""
    ),
)
def dedupe_first(t: Tables) -> DataFrame:
    return cleaning.keep_first(t.comments, ["body"], ["row_id"])


@query(
    "b20_seen_once_ci",
    sql(
        """select row_id, name from (select row_id, name, row_number() over (partition by lower(name) order by row_id) as r from (
        select row_id, case when row_id % 2 = 0 then upper(subreddit) else subreddit end as name from snip) y) z where r = 1"""
    ),
)
def seen_once(t: Tables) -> DataFrame:
    name = F.when(F.col("row_id") % 2 == 0, F.upper("subreddit")).otherwise(F.col("subreddit"))
    return cleaning.first_seen(t.comments.select("row_id", name.alias("name")), "name", ["row_id"])


@query("b21_distinct_values", sql("select distinct violates_rule from wide"))
def distinct_values(t: Tables) -> DataFrame:
    return cleaning.distinct_values(t.wide_with(), "violates_rule")


_BOOL = r"""case when lower(regexp_replace({0}, '^\s+|\s+$', '', 'g')) in ('true', '1', 'yes', 'y') then true
 when lower(regexp_replace({0}, '^\s+|\s+$', '', 'g')) in ('false', '0', 'no', 'n') then false end"""


@query(
    "b22_valid_mask",
    sql(
        f"""select row_id, violates_rule, prediction from predicted where {_BOOL.format('violates_rule')} is not null
        and {_BOOL.format('prediction')} is not null and prediction <> 'Error'"""
    ),
)
def valid_mask(t: Tables) -> DataFrame:
    keep = cleaning.valid_mask("violates_rule", "prediction")
    return t.predicted.filter(keep).select("row_id", "violates_rule", "prediction")
