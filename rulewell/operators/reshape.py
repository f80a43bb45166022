"""Unions, unpivots and augmentations of the wide training table."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from rulewell.functions.labels import signed
from rulewell.functions.sampling_keys import hash_int, permuted
from rulewell.functions.text import has_text
from rulewell.operators.cleaning import keep_first
from rulewell.operators.numbering import number_rows
from rulewell.schemas import EXAMPLE_COLUMNS
from rulewell.session import written

def stack(*frames: DataFrame) -> DataFrame:
    """UNION ALL by column name."""
    return reduce(lambda a, b: a.unionByName(b), frames)


def _numbered(df: DataFrame, key: str) -> DataFrame:
    return number_rows(df, key, into="__n")


def community_rule_pairs(
    communities: DataFrame, rules: DataFrame, n: int | None, seed: int = 21, key: str = "id"
) -> DataFrame:
    """``n`` distinct (community, rule) pairs, or every pair when ``n`` is null or too large.

    Pair number p stands for (p div rules, p mod rules). A sample is the first ``n`` numbers of a keyed
    permutation of all pair numbers, so it costs ``n`` digests whatever the sizes of the tables, and
    neither the product nor its numbers are ever built. Both tables carry a unique numeric ``key``.
    """
    spark = communities.sparkSession
    n_rules = rules.count()
    pairs = communities.count() * n_rules
    draws = spark.range(pairs if n is None else min(n, pairs))
    if n is not None and n < pairs:
        draws = draws.select(permuted("id", pairs, seed).alias("id"))
    draws = draws.selectExpr("id AS pair_id", f"id div {max(1, n_rules)} AS __c", f"id % {max(1, n_rules)} AS __r")
    left = _numbered(communities, key).withColumnRenamed("__n", "__c").drop(key)
    right = _numbered(rules, key).withColumnRenamed("__n", "__r").drop(key)
    return draws.join(left, "__c").join(right, "__r").drop("__c", "__r")


def random_pairs(communities: DataFrame, rules: DataFrame, n: int, seed: int = 21, key: str = "id") -> DataFrame:
    """``n`` pairs drawn with replacement."""
    spark = communities.sparkSession
    n_left = communities.agg(F.count(F.lit(1))).scalar()
    n_right = rules.agg(F.count(F.lit(1))).scalar()
    draws = spark.range(n).select(
        F.col("id").alias("pair_id"),
        (hash_int("id", seed) % n_left).alias("__c"),
        (hash_int("id", seed + 1) % n_right).alias("__r"),
    )
    left = _numbered(communities, key).withColumnRenamed("__n", "__c").drop(key)
    right = _numbered(rules, key).withColumnRenamed("__n", "__r").drop(key)
    return draws.join(left, "__c").join(right, "__r").drop("__c", "__r")


def attach_random_row(
    df: DataFrame, donors: DataFrame, key: str, donor_key: str, seed: int = 21, into: str = "example"
) -> DataFrame:
    """Give every row one donor row, drawn by the digest of its key, as a struct column."""
    n = donors.agg(F.count(F.lit(1))).scalar()
    numbered = _numbered(donors, donor_key).select(
        F.col("__n"), F.struct(*[F.col(c) for c in donors.columns]).alias(into)
    )
    return df.withColumn("__n", hash_int(key, seed) % n).join(numbered, "__n").drop("__n")


def _slots(body: str | None, label: Column, text_as: str, label_as: str) -> list[Column]:
    rows = [(0, F.col(body), label)] if body else []
    rows += [(i + 1, F.col(c), F.lit(1 if c.startswith("pos") else 0)) for i, c in enumerate(EXAMPLE_COLUMNS)]
    return [
        F.struct(
            F.lit(rank).alias("source_rank"), text.alias(text_as), value.cast("int").alias(label_as)
        )
        for rank, text, value in rows
    ]


def _explode(df: DataFrame, keep: Sequence[str], slots: list[Column]) -> DataFrame:
    return df.select(*keep, F.explode(F.array(*slots)).alias("__s")).select(*keep, "__s.*")


def unpivot_with_main(
    df: DataFrame, keep: Sequence[str], body: str, label: str, text_as: str = "body", label_as: str = "rule_violation"
) -> DataFrame:
    """The row's own comment and its four examples as five rows; nulls and repeats stay."""
    return _explode(df, keep, _slots(body, F.col(label), text_as, label_as))


def unpivot_examples(
    df: DataFrame, keep: Sequence[str], text_as: str = "body", label_as: str = "rule_violation"
) -> DataFrame:
    return _explode(df, keep, _slots(None, F.lit(None), text_as, label_as))


def combine_dedupe(train: DataFrame, test: DataFrame, key: str = "row_id") -> DataFrame:
    """Labelled comments plus the examples of unlabelled rows, one row per (body, rule, subreddit).

    Blank example rows go; on a label conflict the earliest source wins, in the order labelled
    rows, positive examples 1 and 2, negative examples 1 and 2.
    """
    names = [key, "rule", "subreddit"]
    main = train.select(
        *names, F.lit(0).alias("source_rank"), "body", F.col("rule_violation").cast("int").alias("rule_violation")
    )
    examples = unpivot_examples(test, names).filter(has_text("body"))
    return keep_first(stack(main, examples), ["body", "rule", "subreddit"], ["source_rank", key])


def swap_examples(df: DataFrame, label: str = "violates_rule", comment: str = "test_comment") -> DataFrame:
    """Per row up to two new rows: the comment changes places with an example of its own label.

    Yes rows use the positive examples, No rows the negative ones, null examples are skipped.
    """
    others = [c for c in df.columns if c not in (comment, *EXAMPLE_COLUMNS)]

    def exchanged(slot: str) -> Column:
        fields = {c: F.col(comment) if c == slot else F.col(c) for c in EXAMPLE_COLUMNS}
        return F.struct(
            F.lit(slot).alias("swapped"), F.col(slot).alias(comment), *[v.alias(n) for n, v in fields.items()]
        )

    def pair(side: str) -> Column:
        return F.array(exchanged(f"{side}_example_1"), exchanged(f"{side}_example_2"))

    choice = F.when(F.col(label) == "Yes", pair("positive")).when(F.col(label) == "No", pair("negative"))
    usable = F.filter(choice, lambda s: s[comment].isNotNull())
    return df.select(*others, F.explode(usable).alias("__s")).select(*others, "__s.*")


def with_swaps(df: DataFrame, label: str = "violates_rule", comment: str = "test_comment") -> DataFrame:
    return stack(df, swap_examples(df, label, comment).select(*df.columns))


def donate_examples(
    df: DataFrame, key: str = "row_id", seed: int = 21, examples: Callable[[DataFrame], DataFrame] | None = None
) -> DataFrame:
    """Rows of a rule in key order, five at a time: the fifth gives its examples to the other four.

    The four examples are shuffled by digest, one per receiver, and become body and label. The
    donor itself and an incomplete last chunk are not emitted. ``examples`` adds the example columns to
    the rows it is given, for a ``df`` without them: only donors need theirs.
    """
    numbered = number_rows(df.filter(F.col("rule").isNotNull()), key, into="__rn", within=("rule",))
    # Written, as donors and receivers must see the same numbers where keys repeat.
    numbered = written(numbered.selectExpr("*", "__rn div 5 AS __chunk", "__rn % 5 AS __pos"), "numbered")
    donors = numbered.filter(F.col("__pos") == 4)
    if examples is not None:
        donors = examples(donors.select(key, "rule", "__chunk"))
    offered = F.array(
        *[
            F.struct(
                F.md5(F.concat(F.col(key).cast("string"), F.lit(f"|{seed}|{i}")).cast("binary")).alias("h"),
                F.col(c).alias("body"),
                F.lit(1 if c.startswith("pos") else 0).alias("label"),
            )
            for i, c in enumerate(EXAMPLE_COLUMNS)
        ]
    )
    donated = donors.select("rule", "__chunk", F.array_sort(offered).alias("__donated"))
    receivers = numbered.filter(F.col("__pos") < 4).join(donated, ["rule", "__chunk"])
    mine = F.get(F.col("__donated"), F.col("__pos").cast("int"))
    return receivers.select(*numbered.columns, "__donated").withColumns(
        {
            "body": mine["body"],
            "rule_violation": mine["label"],
            "rule_violation_yn": F.when(mine["label"] == 1, F.lit("Yes")).otherwise(F.lit("No")),
        }
    ).drop("__rn", "__chunk", "__pos", "__donated")


def melt_scores(df: DataFrame, ids: Sequence[str], models: Sequence[str]) -> DataFrame:
    """Wide score table to (model, score) rows; what is not a number is dropped."""
    long = df.unpivot(list(ids), list(models), "model", "raw_score")
    return long.select(*ids, "model", F.col("raw_score").try_cast("double").alias("score")).na.drop(subset=["score"])


def attach_by_key(rows: DataFrame, outputs: DataFrame, key: str = "row_id") -> DataFrame:
    """Put model outputs back on their rows; rows without an output keep nulls."""
    return rows.join(outputs, key, "left")


def number_combinations(long: DataFrame, scoring: str, *parts: str) -> DataFrame:
    """Points with the number of their combination inside the scoring set.

    Only the distinct combinations are ranked, never the points.
    """
    combos = long.select(scoring, *parts).distinct()
    order = Window.partitionBy(scoring).orderBy(*parts)
    ranked = combos.withColumn("combination", F.row_number().over(order))
    return long.join(ranked, [scoring, *parts])


def signed_values(df: DataFrame, label: str = "rule_violation") -> DataFrame:
    """Add value = +1/-1 and drop rows whose label is neither."""
    return df.withColumn("value", signed(label)).filter(F.col("value").isin(1, -1))
