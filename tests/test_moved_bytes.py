"""Texts and vectors move no more often than the work needs, with the same results."""

from __future__ import annotations

import re

import numpy as np
from pyspark.sql import functions as F

from rulewell.operators import reshape, retrieval
from rulewell.operators.numbering import number_rows
from rulewell.plans.classify import retrieval_corpus
from rulewell.schemas import EXAMPLE_COLUMNS


def _explained(df):
    return df._sc._jvm.PythonSQLUtils.explainString(df._jdf.queryExecution(), "formatted")


def _wide(spark, ids):
    named = [F.concat(F.lit(f"{c} "), F.col("row_id").cast("string")).alias(c) for c in EXAMPLE_COLUMNS]
    rows = spark.createDataFrame([(i, f"r{i % 3}") for i in ids], "row_id long, rule string")
    return rows, lambda df: df.select("*", *named)


def test_only_donors_get_examples(spark):
    rows, attach = _wide(spark, range(100, 147))
    asked = []
    some = reshape.donate_examples(rows, examples=lambda df: asked.append(df) or attach(df))
    whole = reshape.donate_examples(attach(rows)).select(*some.columns)
    assert sorted(map(tuple, some.collect())) == sorted(map(tuple, whole.collect())) and some.count() == 36
    assert asked[0].count() == 9  # three rules of 15 or 16 rows


def test_rows_are_moved_once_for_their_numbers(spark):
    rows = spark.createDataFrame([(i * 7 % 101, i % 2, "text") for i in range(100)] + [(None, 1, "a"), (3, None, "b")], "id long, g int, body string")
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        numbered = number_rows(rows, "id", within=("g",), total="n", side=3)
        moved = len(re.findall(r"\) Exchange\nInput \[\d+\]: \[[^\]]*body", _explained(numbered)))
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    assert moved == 1 and numbered.columns == ["id", "g", "body", "n", "rn"]
    want = {}
    for g in (0, 1, None):
        keys = sorted((r.id for r in rows.collect() if r.g == g), key=lambda i: (i is not None, i))
        want |= {(g, key): (len(keys), at) for at, key in enumerate(keys)}
    assert {(r.g, r.id): (r.n, r.rn) for r in numbered.collect()} == want and numbered.count() == 102


def test_words_travel_short_and_whole(spark):
    sets = [[3, 5, -9, 2**62], [], [70], [-(2**63), 6]]
    df = spark.createDataFrame([(i, w) for i, w in enumerate(sets)], "id long, words array<long>").coalesce(1)
    for known in (np.array([-9, 3, 70], np.int64), np.zeros(0, np.int64)):
        got = df.select("id", retrieval.pack_words(F.col("words"), known).alias("p")).collect()
        assert {r.id: sorted(retrieval.unpack_words(bytes(r.p), known).tolist()) for r in got} == {i: sorted(w) for i, w in enumerate(sets)}
        assert sum(len(r.p) for r in got) == 4 * 4 + sum(2 if w in known else 8 for s in sets for w in s)


def test_only_drawn_rows_get_examples(spark):
    train, attach = _wide(spark, range(20))
    test, _ = _wide(spark, range(50, 90))
    train, test = (df.withColumns({"subreddit": F.lit("s"), "body": F.lit("b"), "rule_violation": F.lit(1)}) for df in (train, test))
    asked = []
    some = retrieval_corpus(train, test, 0.5, examples=lambda df: asked.append(df) or attach(df))
    whole = retrieval_corpus(attach(train), attach(test), 0.5)
    assert sorted(map(tuple, some.collect())) == sorted(map(tuple, whole.collect())) and some.count() == 20 * 5 + 20 * 4
    assert [df.count() for df in asked] == [20, 20]


def test_all_rows_of_a_group_are_reranked(spark, monkeypatch):
    rng = np.random.default_rng(6)
    for name, value in (("HELD_QUERIES", 9), ("DENSE_WORDS", 5), ("STREAM_ROWS", 4), ("SHORT_WORDS", 12)):
        monkeypatch.setattr(retrieval, name, value)
    monkeypatch.setattr("rulewell.operators.nearest.LEAST_PART", 6)
    n = 70
    words = [[int(w) for w in rng.choice(25, rng.integers(0, 9), replace=False)] for _ in range(n)]
    words[4] = None
    vectors = np.round(rng.normal(size=(n, 3)), 1)
    group = [None if i == 11 else f"g{i % 2}" for i in range(n)]
    rows = [(i, group[i], [float(x) for x in vectors[i]], i % 3) for i in range(n)]
    corpus = spark.createDataFrame(rows, "row_id long, rule string, embedding array<double>, value int")
    asked = corpus.select(F.col("row_id").alias("query_id"), F.col("rule").alias("matched_rule"), "embedding")
    texts = spark.createDataFrame([(i, words[i]) for i in range(n - 3)], "row_id long, words array<long>")
    got = retrieval.best_by_overlap(asked, corpus, texts.withColumnRenamed("row_id", "query_id"), texts, 4, exclude_self=True)
    pairs = retrieval.rule_candidates(asked, corpus, n, exclude_self=True)
    want = retrieval.rerank_by_overlap(pairs, texts.withColumnRenamed("row_id", "query_id"), texts, 4).select(*got.columns)
    listed = [sorted((*r[:3], round(r.similarity, 9), round(r.rerank_score, 9), r.final_rank) for r in df.collect()) for df in (got, want)]
    assert listed[0] == listed[1] and len(listed[0]) == 66 * 4
    few = retrieval.rerank_by_overlap(pairs.filter("rank <= 10"), texts.withColumnRenamed("row_id", "query_id"), texts, 4)
    assert {(r.query_id, r.row_id) for r in few.collect()} != {x[:2] for x in listed[0]}
