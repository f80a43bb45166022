"""Golden edge rows of the text functions and label normalisers."""

from __future__ import annotations

import math

import pytest
from pyspark.sql import functions as F

from rulewell.functions import labels, responses, text, vectors

def run(spark, values, column, kind="string"):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], f"i int, v {kind}")
    return [r.x for r in df.select("i", column.alias("x")).orderBy("i").collect()]


# One line per text: the text, then what each normaliser makes of it.
#   text          strict  lenient  evaluation  or_unknown  to_boolean  plain
GOLDEN = [
    ("Yes",        "Yes",  "Yes",   1,          "Yes",      True,       "Yes"),
    (' "Yes" ',    "Yes",  "Yes",   1,          "Yes",      None,       None),
    ("'Yes'",      "Yes",  "Yes",   1,          "Yes",      None,       None),
    ("'\"Yes\"'",  None,   None,    None,       "Unknown",  None,       None),
    ("\"'Yes'\"",  None,   "Yes",   1,          "Yes",      None,       None),
    ('""Yes""',    None,   "Yes",   1,          "Yes",      None,       None),
    ('"Yes',       "Yes",  "Yes",   1,          "Yes",      None,       None),
    ('" Yes"',     "Yes",  "Yes",   None,       "Unknown",  None,       None),
    ("YES",        None,   "Yes",   1,          "Yes",      True,       None),
    ("True",       "Yes",  "Yes",   None,       "Unknown",  True,       "Yes"),
    ("TRUE",       None,   "Yes",   None,       "Unknown",  True,       None),
    ("t",          None,   "Yes",   None,       "Unknown",  None,       None),
    ("1",          None,   "Yes",   None,       "Unknown",  True,       None),
    ("y",          None,   "Yes",   None,       "Unknown",  True,       None),
    ("No",         "No",   "No",    0,          "No",       False,      "No"),
    (" No\u3000",  "No",   "No",    0,          "No",       False,      "No"),
    ("no",         None,   "No",    0,          "No",       False,      None),
    ("False",      "No",   "No",    None,       "Unknown",  False,      "No"),
    ("FALSE",      None,   "No",    None,       "Unknown",  False,      None),
    ("f",          None,   "No",    None,       "Unknown",  None,       None),
    ("n",          None,   "No",    None,       "Unknown",  False,      None),
    ("0",          None,   "No",    None,       "Unknown",  False,      None),
    ("\x1cYes\x1f", "Yes", "Yes",   1,          "Yes",      True,       "Yes"),
    ("maybe",      None,   None,    None,       "Unknown",  None,       None),
    ("nan",        None,   None,    None,       "Unknown",  None,       None),
    ("",           None,   None,    None,       "Unknown",  None,       None),
    (None,         None,   None,    None,       "Unknown",  None,       None),
]
NORMALISERS = (labels.strict, labels.lenient, labels.evaluation, labels.or_unknown, labels.to_boolean, labels.plain)


@pytest.mark.parametrize("place", range(len(NORMALISERS)), ids=[n.__name__ for n in NORMALISERS])
def test_normalisers(spark, place):
    texts = [row[0] for row in GOLDEN]
    assert run(spark, texts, NORMALISERS[place]("v")) == [row[place + 1] for row in GOLDEN]


def test_boolean_column_reads_as_yes_no(spark):
    assert run(spark, [True, False, None], labels.or_unknown("v", boolean=True), "boolean") == ["Yes", "No", "Unknown"]


def test_words_follow_unicode_whitespace(spark):
    values = ["a b　c\td", "", None, "  one  two\n", "\x1c", "x"]
    assert run(spark, values, text.word_count("v")) == [len((v if v is not None else "nan").split()) for v in values]
    assert run(spark, values, text.strip("v")) == [None if v is None else v.strip() for v in values]
    assert run(spark, values[:2], text.has_text("v")) == [True, False]


def test_tokens_and_scrub(spark):
    import re

    values = ["Ça va_1 ü x ß2 Été — I'm", "", "A b CC"]
    assert run(spark, values, text.words("v")) == [re.findall(r"\w\w+", v.lower()) for v in values]
    shown = run(spark, ["Mail x.19@mail5.example.com or +1 (743) 555-3824, see https://a.b/c?d=1 Été ½"], text.scrub("v"))
    assert shown == ["Mail <EMAIL> or <PHONE>, see <URL> Ete 12"]


def test_concat_collapse(spark):
    df = spark.createDataFrame([(" a\n", None, "b \t c ")], "x string, y string, z string")
    assert df.select(text.concat_collapse("x", "y", "z")).first()[0] == "a b c"


RESPONSE = "Formatted Rule: r1\n  Test Comment: first\n**Violates Rule:** No\nTest Comment: last Test Comment: x\nPositive Example 1:\n"


def test_labelled_lines(spark):
    row = run(spark, [RESPONSE, "", None], responses.labelled_lines("v", responses.FORMATTED))
    assert row[0].formatted_rule == "r1"
    assert row[0].test_comment == "last  x"
    assert row[0].positive_example_1 == ""
    assert row[0].violates_rule is None and row[0].negative_example_2 is None
    assert all(v is None for v in row[1]) and all(v is None for v in row[2])


def test_result_fields(spark):
    df = spark.createDataFrame([(RESPONSE, None), (None, None), (RESPONSE, "boom")], "v string, e string")
    rows = df.select(*responses.result_fields("v", responses.MODERATION, error="e")).collect()
    assert [r.error for r in rows] == [None, responses.NO_RESPONSE, "boom"]
    assert [r.test_comment for r in rows] == ["last  x", None, None]


def test_yes_no_and_probability(spark):
    said = ["Yes.", "no", "NO and yes", "y'all", "nothing", "", None, "enç"]
    assert run(spark, said, responses.yes_no("v")) == ["Yes", "No", "Yes", "Yes", None, None, None, None]
    numbers = ["0.85", "85%", "150", "1.0", "none", None, "9 ### Response: Violates rule: 0.2 3", "### Response: 2024"]
    assert run(spark, numbers, responses.probability("v")) == [0.85, 0.85, 1.0, 1.0, 0.5, 0.5, 0.2, 1.0]
    assert run(spark, ["well YES", None, "no"], responses.contains_yes("v")) == [1, 0, 0]


def test_logprob_score(spark):
    kind = "array<struct<token_id:bigint,token:string,logprob:double>>"
    both = [(1, "Yes", math.log(0.6)), (2, "No", math.log(0.2))]
    got = run(spark, [both, both[1:], [], None], responses.logprob_score("v"), kind)
    assert got[0].violation_probability == pytest.approx(0.75) and got[0].is_violation and got[0].prediction == "Yes"
    assert got[1].violation_probability == 0.0 and got[1].confidence == pytest.approx(1.0)
    assert [got[2].prediction, got[2].violation_probability, got[2].confidence] == ["Error", 0.5, 0.5]
    assert got[3].prediction == "Error" and not got[3].is_violation


def test_vectors(spark):
    rows = [[3.0, 4.0], [0.0, 0.0]]
    assert run(spark, rows, vectors.l2_normalize("v"), "array<double>") == [[0.6, 0.8], [0.0, 0.0]]
    assert run(spark, rows, vectors.truncate_renorm("v", 1), "array<double>") == [[1.0], [0.0]]
    assert run(spark, rows, vectors.cosine("v", F.array(F.lit(3.0), F.lit(4.0))), "array<double>") == [1.0, 0.0]
    soft = run(spark, [[1000.0, 1000.0 + math.log(3)]], vectors.softmax("v"), "array<double>")[0]
    assert soft == pytest.approx([0.25, 0.75])
    assert run(spark, [[1.0, 1.0]], vectors.argmax("v"), "array<double>") == [0]


def test_hashed_words_equal_the_python_embedder(spark):
    import numpy as np

    from rulewell.operators.scoring import hashed_word_embedder

    values = ["spam spam links and more Spam links", "", None, "one", "Ça va_1 ü bien bien"]
    got = run(spark, values, vectors.hashed_words("v", 16))
    want = hashed_word_embedder(16)()([v or "" for v in values])
    for row, counts in zip(got, want):
        dense = np.zeros(16)
        dense[row.indices] = row["values"]
        assert dense == pytest.approx(counts / (np.linalg.norm(counts) or 1.0))
