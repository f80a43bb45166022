"""Table schemas. Labels are always read as text: their spelling is cleaned later.

Fixed values: all column names and their order in this file are those of the input and output files.
"""

from __future__ import annotations

from pyspark.sql import types as T

EXAMPLE_COLUMNS = (
    "positive_example_1",
    "positive_example_2",
    "negative_example_1",
    "negative_example_2",
)

TRAINING_COLUMNS = (
    "subreddit",
    "rule",
    "positive_example_1",
    "negative_example_1",
    "positive_example_2",
    "negative_example_2",
    "test_comment",
    "violates_rule",
)

GENERATION_COLUMNS = (
    "Subreddit",
    "Rule Name",
    "Formatted Rule",
    "Positive Example 1",
    "Negative Example 1",
    "Positive Example 2",
    "Negative Example 2",
    "Test Comment",
    "Violates Rule",
    "Raw Response",
    "Error",
)

# Names given by position to the generation columns above.
GENERATION_RENAMED = (
    "subreddit",
    "Rule Name",
    "rule",
    "positive_example_1",
    "negative_example_1",
    "positive_example_2",
    "negative_example_2",
    "test_comment",
    "violates_rule",
    "Raw Response",
    "Error",
)

FORMATTED_RULE_COLUMNS = (
    "Subreddit",
    "Original_Rule_Name",
    "Original_Rule_Description",
    "Formatted_Rule_Name",
    "Formatted_Rule_Description",
    "Final_Formatted_Rule",
    "Clarity_Tag",
    "Clarity_Reason",
    "Raw_Response",
    "Error",
)

CRAWLED_RULE_COLUMNS = ("Subreddit", "Rule Name", "Rule Description")


def text_schema(*names: str) -> T.StructType:
    return T.StructType([T.StructField(name, T.StringType()) for name in names])


TRAINING = text_schema(*TRAINING_COLUMNS)
GENERATION_BATCH = text_schema(*GENERATION_COLUMNS)
FORMATTED_RULES = text_schema(*FORMATTED_RULE_COLUMNS)
CRAWLED_RULES = text_schema(*CRAWLED_RULE_COLUMNS)

COMPETITION_TEST = T.StructType(
    [T.StructField("row_id", T.LongType())]
    + [T.StructField(name, T.StringType()) for name in ("body", "rule", "subreddit", *EXAMPLE_COLUMNS)]
)
COMPETITION_TRAIN = T.StructType(
    [*COMPETITION_TEST.fields, T.StructField("rule_violation", T.IntegerType())]
)

MESSAGES = T.ArrayType(
    T.StructType([T.StructField("role", T.StringType()), T.StructField("content", T.StringType())])
)
TOKENS = T.ArrayType(
    T.StructType(
        [
            T.StructField("token_id", T.LongType()),
            T.StructField("token", T.StringType()),
            T.StructField("logprob", T.DoubleType()),
        ]
    )
)
