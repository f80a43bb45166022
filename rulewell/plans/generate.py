"""Synthetic generation runs: pairs, few-shot prompts, generator calls, parsed result rows."""

from __future__ import annotations

from collections.abc import Callable
from typing import Any

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rulewell.functions import prompts, responses
from rulewell.operators.reshape import attach_random_row, community_rule_pairs
from rulewell.operators.scoring import generate_batches


def fewshot_requests(
    communities: DataFrame, rules: DataFrame, examples: DataFrame, n: int | None, example_key: str = "row_id", seed: int = 21
) -> DataFrame:
    """(pair_id, subreddit, rule, example_comments, prompt): sampled pairs with one example each."""
    pairs = community_rule_pairs(communities, rules, n, seed)
    shown = attach_random_row(pairs, examples, "pair_id", example_key, seed)
    texts = shown.withColumn("example_comments", prompts.fewshot_block("example")).drop("example")
    force = prompts.coin("pair_id", seed)
    return texts.withColumn("prompt", prompts.generate_fewshot(F.col("example_comments"), force))


def run_generation(
    requests: DataFrame,
    generate: Callable[[], Callable[[list[str]], list[Any]]],
    fields: dict[str, str] = responses.NUMBERED_EXAMPLES,
    batch_size: int = 200,
) -> DataFrame:
    """Call the generator and parse its answers; failed rows keep their error text."""
    answers = generate_batches(requests, generate, "pair_id", "prompt", batch_size)
    parsed = answers.select(
        "pair_id", "batch_number", *responses.result_fields("response", fields, error="error")
    )
    return requests.drop("prompt").join(parsed, "pair_id")
