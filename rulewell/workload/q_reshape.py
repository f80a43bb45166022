"""Sampling, reshaping and augmentation."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from rulewell.functions import templates
from rulewell.functions.labels import strict
from rulewell.functions.prompts import fewshot_block
from rulewell.operators import reshape, sampling
from rulewell.plans.classify import retrieval_corpus
from rulewell.schemas import EXAMPLE_COLUMNS
from rulewell.session import written
from rulewell.functions.sampling_keys import ROUNDS, WALK
from rulewell.workload.registry import query
from rulewell.workload.sqltext import hash_int_sql, hash_sql, render_sql, scrub_sql
from rulewell.workload.tables import Tables, sql


@query(
    "c01_shuffle",
    sql(
        f"""select doc_id, md5(text) as text_md5, lang, source, n_chars,
        row_number() over (order by {hash_sql('doc_id', 21)}) - 1 as position from documents"""
    ),
)
def shuffle(t: Tables) -> DataFrame:
    """Whole rows in shuffled order; the position of a row follows from the order of the partitions."""
    docs = t.given("documents").withColumn("text_md5", F.md5("text")).drop("text")
    shuffled = sampling.shuffle(docs, "doc_id", 21)
    # Rows of a range-sorted table keep their order inside a partition; numbers of partitions ascend.
    placed = shuffled.withColumns({"part": F.spark_partition_id(), "at": F.monotonically_increasing_id()})
    stored = written(placed, "shuffled")
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    first = stored.groupBy("part").agg(F.count(F.lit(1)).alias("n"), F.min("at").alias("low"))
    offsets = first.select("part", "low", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("offset"))
    numbered = stored.join(offsets, "part").withColumn("position", F.col("offset") + F.col("at") - F.col("low"))
    return numbered.select("doc_id", "text_md5", "lang", "source", "n_chars", "position")


@query("c02_sample_n", sql(f"select row_id, subreddit, body from snip order by {hash_sql('row_id', 42)}, row_id limit 200"))
def sample_n(t: Tables) -> DataFrame:
    return sampling.sample_n(t.comments.select("row_id", "subreddit", "body"), 200, "row_id", 42)


@query(
    "c03_sample_fraction",
    sql(
        f"""select row_id, rule from (select row_id, rule, row_number() over (order by {hash_sql('row_id', 21)}) as r,
        count(*) over () as n from test) z where r <= round_even(0.7 * n, 0)"""
    ),
)
def sample_fraction(t: Tables) -> DataFrame:
    return sampling.sample_fraction(t.test_with().select("row_id", "rule"), 0.7, "row_id", 21)


@query("c04_head_slice", sql("select row_id, test_comment from train order by row_id limit 24"))
def head_slice(t: Tables) -> DataFrame:
    return sampling.head(t.train_with().select("row_id", "test_comment"), 24, "row_id")


def drawn_pairs_sql(n: int, seed: int) -> str:
    """The first ``n`` pair numbers of the keyed permutation, as (pair_id, ci, ri)."""
    mixed = "cast(concat('0x', substr(md5(concat(cast({x} as varchar), '|" + str(seed) + "|', cast(r as varchar))), 1, 15)) as bigint)"
    odd, even = mixed.format(x="(acc % b)"), mixed.format(x="(acc // b)")
    once = f"""list_reduce([{{x}}] || range(1, {ROUNDS + 1}), lambda acc, r: case when r % 2 = 1 then ((acc // b + {odd}) % a) * b + acc % b
      else (acc // b) * b + (acc % b + {even}) % b end)"""
    walk = f"list_reduce([{once.format(x='i')}] || range({WALK}), lambda x, step: case when x < pairs then x else {once.format(x='x')} end)"
    return f"""select p as pair_id, p // nr as ci, p % nr as ri from (select nr, case when {n} >= pairs then i else {walk} end as p
      from (select *, (pairs + a - 1) // a as b, unnest(range(least({n}, pairs))) as i from (select *, cast(ceil(sqrt(pairs)) as bigint) as a
      from (select nc * nr as pairs, nr from (select count(*) as nc from communities) c, (select count(*) as nr from rules) q) s) t) u) d"""


_NUMBERED = "cn as (select subreddit, row_number() over (order by id) - 1 as cnum from communities)"


@query(
    "d01_cross_combos",
    sql(
        f"select pair_id, subreddit, rule from ({drawn_pairs_sql(500, 21)}) d join cn on cn.cnum = d.ci join rules r on r.n = d.ri",
        _NUMBERED,
    ),
)
def cross_combos(t: Tables) -> DataFrame:
    rules = t.rules.withColumnRenamed("rule_id", "id")
    return reshape.community_rule_pairs(t.communities, rules, 500)


@query(
    "d02_random_pairs",
    sql(
        f"""select i as pair_id, subreddit, rule from (select i, {hash_int_sql('i', 21)} % (select count(*) from communities) as ci,
        {hash_int_sql('i', 22)} % (select count(*) from rules) as ri from (select unnest(range(500)) as i) q) d
        join cn on cn.cnum = d.ci join rules r on r.n = d.ri""",
        _NUMBERED,
    ),
)
def random_pairs(t: Tables) -> DataFrame:
    rules = t.rules.withColumnRenamed("rule_id", "id")
    return reshape.random_pairs(t.communities, rules, 500)


@query(
    "d03_attach_random_fewshot",
    sql(
        f"""select t.row_id, t.rule as asked_rule, d.row_id as donor_id, {render_sql(templates.FEWSHOT_BLOCK, 'd')} as example_comments
        from test t join donors d on d.num = {hash_int_sql('t.row_id', 21)} % (select count(*) from train)""",
        "donors as (select *, row_number() over (order by row_id) - 1 as num from train)",
    ),
)
def attach_random_fewshot(t: Tables) -> DataFrame:
    asked = t.test_with().select("row_id", F.col("rule").alias("asked_rule"))
    shown = reshape.attach_random_row(asked, t.train, "row_id", "row_id", 21)
    return shown.select(
        "row_id", "asked_rule", F.col("example.row_id").alias("donor_id"), fewshot_block("example").alias("example_comments")
    )


def _long_sql(table: str, keep: str, main: str | None) -> str:
    parts = [main] if main else []
    parts += [
        f"select {keep}, {i + 1} as source_rank, {c} as body, {1 if c.startswith('pos') else 0} as rule_violation from {table}"
        for i, c in enumerate(EXAMPLE_COLUMNS)
    ]
    return " union all ".join(parts)


_KEEP = "row_id, rule, subreddit"
_MAIN = f"select {_KEEP}, 0 as source_rank, test_comment as body, rule_violation from train"


@query(
    "d04_unpivot_with_main",
    sql(
        f"""select row_id, rule, subreddit, source_rank, body, rule_violation,
        case when rule_violation = 0 then -1 else rule_violation end as value from ({_long_sql('train', _KEEP, _MAIN)}) z"""
    ),
)
def unpivot_with_main(t: Tables) -> DataFrame:
    long = reshape.unpivot_with_main(t.train, ["row_id", "rule", "subreddit"], "test_comment", "rule_violation")
    return reshape.signed_values(long)


@query("d05_unpivot_examples_only", sql(f"select *, case when rule_violation = 0 then -1 else 1 end as value from ({_long_sql('test', _KEEP, None)}) z"))
def unpivot_examples(t: Tables) -> DataFrame:
    return reshape.signed_values(reshape.unpivot_examples(t.test, ["row_id", "rule", "subreddit"]))


@query(
    "d06_combine_dedupe",
    sql(
        f"""select row_id, rule, subreddit, source_rank, body, rule_violation from (select *,
        row_number() over (partition by body, rule, subreddit order by source_rank, row_id) as r from (
        {_MAIN} union all select * from ({_long_sql('test', _KEEP, None)}) e where regexp_matches(body, '\\S')) u) z where r = 1"""
    ),
)
def combine_dedupe(t: Tables) -> DataFrame:
    return reshape.combine_dedupe(t.train_with().withColumnRenamed("test_comment", "body"), t.test)


def _swap_sql() -> str:
    parts = []
    for label, side in (("Yes", "positive"), ("No", "negative")):
        for i in (1, 2):
            slot = f"{side}_example_{i}"
            shown = ", ".join(f"test_comment as {c}" if c == slot else c for c in EXAMPLE_COLUMNS)
            parts.append(
                f"select row_id, rule, violates_rule, '{slot}' as swapped, {slot} as test_comment, {shown} "
                f"from clean where violates_rule = '{label}' and {slot} is not null"
            )
    return " union all ".join(parts)


_CLEAN = """clean as (select row_id, subreddit, rule, positive_example_1, positive_example_2, negative_example_1, negative_example_2,
 test_comment, case when s in ('True', 'Yes') then 'Yes' when s in ('False', 'No') then 'No' end as violates_rule from (
 select *, regexp_replace(regexp_replace(violates_rule, '^\\s+|\\s+$', '', 'g'), '^["'']|["'']$', '', 'g') as s from train) q)"""


@query("d07_swap_augment", sql(_swap_sql(), _CLEAN))
def swap_augment(t: Tables) -> DataFrame:
    rows = t.train.drop("rule_violation", "subreddit").withColumn("violates_rule", strict("violates_rule"))
    return reshape.swap_examples(rows)


@query(
    "d08_chunk5_donor",
    sql(
        """select r.row_id, r.rule, r.subreddit, d.body, d.label as rule_violation,
        case when d.label = 1 then 'Yes' else 'No' end as rule_violation_yn
        from placed r join (select rule, chunk, body, label, row_number() over (partition by rule, chunk order by h) - 1 as slot from (
          """
        + " union all ".join(
            f"select rule, chunk, {c} as body, {1 if c.startswith('pos') else 0} as label, "
            f"md5(concat(cast(row_id as varchar), '|21|{i}')) as h from placed where pos5 = 4"
            for i, c in enumerate(EXAMPLE_COLUMNS)
        )
        + """) x) d on r.rule = d.rule and r.chunk = d.chunk and r.pos5 = d.slot""",
        """placed as (select *, rn // 5 as chunk, rn % 5 as pos5 from (
          select *, row_number() over (partition by rule order by row_id) - 1 as rn from wide) q)""",
    ),
)
def chunk_donor(t: Tables) -> DataFrame:
    rows = t.wide_with().select("row_id", "rule", "subreddit")
    donated = reshape.donate_examples(rows, examples=t.with_examples)
    return donated.select("row_id", "rule", "subreddit", "body", "rule_violation", "rule_violation_yn")


def corpus_sql() -> str:
    """View text of the text corpus: sampled unlabelled rows' examples and labelled long rows."""
    cleaned = scrub_sql("concat('r/', subreddit, chr(10), 'Comment: ', coalesce(body, 'nan'))")
    sampled = f"""(select * from (select *, row_number() over (order by {hash_sql('row_id', 21)}) as r, count(*) over () as n from test) y
      where r <= round_even(0.7 * n, 0))"""
    return f"""text_corpus as (select row_id, source_rank, rule, {cleaned} as body, rule_violation,
      case when rule_violation = 0 then -1 else 1 end as value from (
      {_long_sql('train', _KEEP, _MAIN)} union all {_long_sql(sampled, _KEEP, None)}) z)"""


def text_corpus(t: Tables) -> DataFrame:
    train = t.train_with().withColumnRenamed("test_comment", "body")
    return retrieval_corpus(train, t.test_with().select("row_id", "rule", "subreddit"), examples=t.with_examples)


@query("d09_corpus_from_train_and_test", sql("select row_id, source_rank, rule, body, rule_violation, value from text_corpus", corpus_sql()))
def corpus_from_train_and_test(t: Tables) -> DataFrame:
    return text_corpus(t).select(F.col("source_row").alias("row_id"), "source_rank", "rule", "body", "rule_violation", "value")


_IDS = ("train_dataset", "pred_model_type", "scoring_dataset")
_MODELS = ("model_a", "model_b", "model_c")
_MELTED = "melted as (select * from ({}) q where score is not null)".format(
    " union all ".join(
        f"select {', '.join(_IDS)}, '{m}' as model, try_cast({m} as double) as score from scores" for m in _MODELS
    )
)


@query("d10_melt_scores", sql("select * from melted", _MELTED))
def melt_scores(t: Tables) -> DataFrame:
    return reshape.melt_scores(t.scores, _IDS, _MODELS)


@query(
    "d11_positional_attach",
    sql("select w.row_id, w.rule, p.predicted, p.prediction from wide w left join predicted p on w.row_id = p.row_id"),
)
def positional_attach(t: Tables) -> DataFrame:
    return reshape.attach_by_key(t.wide_with().select("row_id", "rule"), t.predicted.select("row_id", "predicted", "prediction"))


@query(
    "d12_unique_combinations",
    sql(
        """select m.*, c.combination from melted m join (select *, row_number() over (partition by scoring_dataset
        order by train_dataset, pred_model_type) as combination from (select distinct scoring_dataset, train_dataset, pred_model_type
        from melted) d) c using (scoring_dataset, train_dataset, pred_model_type)""",
        _MELTED,
    ),
)
def unique_combinations(t: Tables) -> DataFrame:
    long = reshape.melt_scores(t.scores, _IDS, _MODELS)
    return reshape.number_combinations(long, "scoring_dataset", "train_dataset", "pred_model_type")


@query(
    "d13_stack_unlabelled",
    sql(f"select * from ({_MAIN} union all select * from ({_long_sql('test', _KEEP, None)}) e) z"),
)
def stack_unlabelled(t: Tables) -> DataFrame:
    names = ["row_id", "rule", "subreddit"]
    main = t.train_with().select(*names, F.lit(0).alias("source_rank"), F.col("test_comment").alias("body"), "rule_violation")
    return reshape.stack(main, reshape.unpivot_examples(t.test, names))
