"""Model-response parsing as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from rulewell.functions.text import column, strip
from rulewell.functions.vectors import argmax, softmax

# Response labels and the field each one fills.
MODERATION = {
    "Positive Example 1:": "positive_example_1",
    "Negative Example 1:": "negative_example_1",
    "Positive Example 2:": "positive_example_2",
    "Negative Example 2:": "negative_example_2",
    "Test Comment:": "test_comment",
    "Violates Rule:": "violates_rule",
}
FORMATTED = {"Formatted Rule:": "formatted_rule", **MODERATION}
NUMBERED_EXAMPLES = {
    "Formatted Rule:": "formatted_rule",
    "Example 1:": "positive_example_1",
    "Example 2:": "positive_example_2",
    "Example 3:": "negative_example_1",
    "Example 4:": "negative_example_2",
    "Test Comment:": "test_comment",
    "Violates Rule:": "violates_rule",
}
RULE_FORMAT = {
    "Formatted Rule Name:": "formatted_rule_name",
    "Formatted Rule Description:": "formatted_rule_description",
    "Final Formatted Rule:": "final_formatted_rule",
    "Clarity Tag:": "clarity_tag",
    "Clarity Reason:": "clarity_reason",
}
NO_RESPONSE = "No response from model"


def labelled_lines(response: Column | str, fields: dict[str, str]) -> Column:
    """STRUCT with one text field per label.

    A line counts when it starts with the label after stripping; the last such line wins, the
    label is removed wherever it occurs in that line, and an absent label gives null.
    """
    lines = F.transform(F.split(strip(response), "\n"), strip)

    def value(rows: Column, label: str) -> Column:
        last = F.try_element_at(F.filter(rows, lambda line: line.startswith(label)), F.lit(-1))
        return strip(F.replace(last, F.lit(label), F.lit("")))

    # Going through a one-element array binds the line list, so that it is split once, not per label.
    bound = F.transform(
        F.array(lines), lambda rows: F.struct(*[value(rows, label).alias(field) for label, field in fields.items()])
    )
    return F.get(bound, F.lit(0))


def result_fields(response: Column | str, fields: dict[str, str], error: Column | str | None = None) -> list[Column]:
    """Parsed fields, the raw response and an error text; a missing response is an error row."""
    response = column(response)
    failure = F.lit(None).cast("string") if error is None else column(error)
    raw = F.when(failure.isNull(), response)
    parsed = labelled_lines(raw, fields)
    message = F.coalesce(failure, F.when(response.isNull(), F.lit(NO_RESPONSE)))
    return [
        *[parsed[field].alias(field) for field in fields.values()],
        raw.alias("raw_response"),
        message.alias("error"),
    ]


def yes_no(response: Column | str) -> Column:
    """Yes when a word yes/y occurs, else No when no/n occurs, else null."""
    c = column(response)
    return F.when(F.regexp_like(c, F.lit(r"(?iU)\b(yes|y)\b")), F.lit("Yes")).when(
        F.regexp_like(c, F.lit(r"(?iU)\b(no|n)\b")), F.lit("No")
    )


def contains_yes(response: Column | str) -> Column:
    return F.coalesce(F.contains(F.lower(column(response)), F.lit("yes")).cast("int"), F.lit(0))


def probability(response: Column | str) -> Column:
    """First number after the last response header, percentages scaled, clamped; 0.5 without one."""
    tail = F.substring_index(column(response), "### Response:", -1)
    number = F.regexp_extract(tail, r"(\d+\.?\d*)", 1).try_cast("double")
    scaled = F.when(number > 1.0, number / 100.0).otherwise(number)
    # least/greatest skip nulls, so a missing number is handled before the clamp.
    return F.when(number.isNull(), F.lit(0.5)).otherwise(F.least(F.greatest(scaled, F.lit(0.0)), F.lit(1.0)))


def token_probability(tokens: Column | str, token: str) -> Column:
    """exp(logprob) of a token; 0 when the token is not listed."""
    hits = F.filter(column(tokens), lambda x: x["token"] == token)
    return F.coalesce(F.exp(F.try_element_at(hits, F.lit(1))["logprob"]), F.lit(0.0))


def logprob_score(tokens: Column | str, yes: str = "Yes", no: str = "No", normalize: bool = True) -> Column:
    """STRUCT<prediction, is_violation, violation_probability, confidence> out of token log-probabilities."""
    tokens = column(tokens)
    p_yes, p_no = token_probability(tokens, yes), token_probability(tokens, no)
    total = (p_yes + p_no + F.lit(1e-15)) if normalize else F.lit(1.0)
    missing = tokens.isNull() | (F.size(tokens) <= 0)
    p = F.when(missing, F.lit(0.5)).otherwise(p_yes / total)
    best = F.array_sort(
        tokens, lambda a, b: F.when(a["logprob"] > b["logprob"], -1).when(a["logprob"] < b["logprob"], 1).otherwise(0)
    )
    text = F.when(missing, F.lit("Error")).otherwise(strip(F.try_element_at(best, F.lit(1))["token"]))
    return F.struct(
        text.alias("prediction"),
        (p > 0.5).alias("is_violation"),
        p.alias("violation_probability"),
        F.when(missing, F.lit(0.5)).otherwise(F.greatest(p_yes, p_no) / total).alias("confidence"),
    )


def ranked_tokens(tokens: Column | str) -> Column:
    """Tokens by falling log-probability, ties by token id."""
    return F.array_sort(
        column(tokens),
        lambda a, b: F.when(a["logprob"] > b["logprob"], -1)
        .when(a["logprob"] < b["logprob"], 1)
        .when(a["token_id"] < b["token_id"], -1)
        .otherwise(1),
    )


def token_rank(ranked: Column | str, token: str) -> Column:
    """One-based rank in a ranked list; null when the token is not listed."""
    return F.nullif(F.array_position(F.transform(column(ranked), lambda x: x["token"]), token), F.lit(0).cast("long"))


def softmax_decision(logits: Column | str) -> Column:
    """STRUCT<prediction Yes/No, confidence> from two class logits (No, Yes)."""
    probabilities = softmax(logits)
    return F.struct(
        F.when(argmax(probabilities) == 1, F.lit("Yes")).otherwise(F.lit("No")).alias("prediction"),
        F.array_max(probabilities).alias("confidence"),
    )
