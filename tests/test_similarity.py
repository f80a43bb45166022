"""Frequent terms by summaries, and the sparse threshold join, against plain versions."""

from __future__ import annotations

from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from rulewell.operators import similarity, sparse_join

VECTOR = "struct<indices:array<int>,values:array<double>>"


@pytest.fixture(scope="module")
def tokens(spark):
    rng = np.random.default_rng(2)
    rows = [[f"w{int(x)}" for x in np.minimum(rng.zipf(1.4, rng.integers(0, 60)), 4000)] for _ in range(500)]
    return spark.createDataFrame([(r,) for r in rows + [[], None]], "t array<string>").repartition(7), rows


def exact(rows):
    total, df = Counter(), Counter()
    for r in rows:
        total.update(r)
        df.update(set(r))
    return total, df


@pytest.mark.parametrize("summary,limit", [(1, 1 << 18), (3, 1 << 18), (16, 1 << 18), (100, 1 << 18), (16, 10)])
def test_most_frequent_terms_whatever_the_summary(tokens, monkeypatch, summary, limit):
    monkeypatch.setattr(similarity, "SUMMARY", summary)
    monkeypatch.setattr(similarity, "CANDIDATE_LIMIT", limit)
    frame, rows = tokens
    total, df = exact(rows)
    want = sorted(total, key=lambda w: (-total[w], w))[:25]
    found = similarity.frequent_terms(frame, 25).filter("total > 0").orderBy(F.desc("total"), "term").limit(25).collect()
    assert [(r.term, r.total, r.df) for r in found] == [(w, total[w], df[w]) for w in want]


def test_summaries_bound_the_counts(tokens):
    frame, rows = tokens
    total, _ = exact(rows)
    for kept in (5, 40, 10_000):
        found = similarity.term_summaries(frame, kept).collect()
        tasks = sum(r.term is None for r in found)
        assert len(found) - tasks <= kept * tasks
        error = sum(r.least for r in found if r.term is None)
        least = Counter()
        for r in found:
            if r.term is not None:
                least[r.term] += r.least
        assert all(least[w] <= n <= least[w] + error for w, n in total.items())
        assert (error == 0) == (kept == 10_000)


def test_fewer_terms_than_wanted_and_none(spark, tokens):
    few = spark.createDataFrame([(["b", "a", "b"],), ([],)], "t array<string>")
    assert sorted((r.term, r.total, r.df) for r in similarity.frequent_terms(few, 10).collect()) == [("a", 1, 1), ("b", 2, 1)]
    assert similarity.frequent_terms(few.filter("false"), 10).filter("total > 0").collect() == []


def sparse_rows(seed, n, dims=40, most=12):
    rng = np.random.default_rng(seed)
    rows = []
    for i in range(n):
        terms = np.sort(rng.choice(dims, rng.integers(0, most), replace=False))
        values = rng.random(len(terms)) + 0.05
        length = np.sqrt((values**2).sum()) or 1.0
        rows.append((i, ([int(t) for t in terms], [float(v) for v in values / length])))
    rows[n // 2] = (n // 2, rows[0][1])  # a tie
    return rows


def dense(rows, dims=40):
    out = np.zeros((len(rows), dims))
    for at, (_, vector) in enumerate(rows):
        if vector:
            out[at, vector[0]] = vector[1]
    return out


@pytest.mark.parametrize("threshold", [1e-12, 0.3, 0.7, 0.999999])
@pytest.mark.parametrize("block", [32 << 20, 400])
def test_threshold_join_equals_brute_force(spark, monkeypatch, threshold, block):
    monkeypatch.setattr(sparse_join, "BLOCK_BYTES", block)
    monkeypatch.setattr(sparse_join, "PIECE", 37)
    left, right = sparse_rows(1, 150) + [(500, None)], sparse_rows(2, 60) + [(600, None)]
    right[7] = (7, left[3][1])
    similar = np.round(dense(left) @ dense(right).T, 12)
    want = []
    for at, (key, vector) in enumerate(left):
        if vector:
            best = max(range(60), key=lambda j: (similar[at, j], -j))
            if similar[at, best] >= threshold:
                want.append((key, best, similar[at, best]))
    rows = spark.createDataFrame(left, f"id long, vector {VECTOR}").repartition(3)
    held = spark.createDataFrame(right, f"cid long, vector {VECTOR}").repartition(3)
    found = sorted((r.id, r.cid, r.similarity) for r in sparse_join.best_above(rows, held, threshold, "id", "cid").collect())
    assert [f[:2] for f in found] == [w[:2] for w in want]
    assert np.allclose([f[2] for f in found], [w[2] for w in want], atol=2e-12)


def test_threshold_join_of_empty_sides(spark):
    rows = spark.createDataFrame(sparse_rows(1, 20), f"id long, vector {VECTOR}")
    assert sparse_join.best_above(rows, rows.selectExpr("id as cid", "vector").filter("false"), 0.3, "id", "cid").collect() == []
    assert sparse_join.best_above(rows.filter("false"), rows.selectExpr("id as cid", "vector"), 0.3, "id", "cid").collect() == []
    with pytest.raises(ValueError):
        sparse_join.best_above(rows, rows, 0.0, "id", "id")


def test_rows_that_cannot_reach_the_threshold_meet_nothing():
    """The bound by per-term maxima drops rows before any list is read."""
    import pyarrow as pa

    kind = pa.struct([("indices", pa.list_(pa.int32())), ("values", pa.list_(pa.float64()))])
    entry = lambda i, v: {"indices": i, "values": v}
    block = pa.table({"cid": [1, 2], "vec": pa.array([entry([0, 1], [0.1, 0.9]), entry([1, 2], [0.2, 0.1])], kind)})
    postings = sparse_join.Postings(block, 0.5)
    rows = np.array([0, 0, 1])
    assert postings.top.tolist() == [0.1, 0.9, 0.1]
    left, right = postings._candidates(rows, np.array([0, 2, 1]), np.array([0.7, 0.7, 1.0]))
    assert (left.tolist(), right.tolist()) == ([1, 1], [0, 1])


def test_most_similar_rows_below_the_threshold(spark):
    docs = spark.createDataFrame([(1, "red green"), (2, "blue"), (3, "red"), (4, None), (5, "yellow tree")], "id long, text string")
    clean = spark.createDataFrame([(10, "green green grass"), (11, "red red red rose")], "cid long, text string")
    got = similarity.tfidf_most_similar(docs, clean, 4, "id", "text", "cid", "text").collect()
    assert [(r.id, r.cid) for r in got][:2] in ([(3, 11), (1, 10)], [(3, 11), (1, 11)])
    assert [(r.id, r.cid, r.max_similarity) for r in got][2:] == [(2, 10, 0.0), (4, 10, 0.0)]
    assert similarity.tfidf_most_similar(docs, clean.filter("false"), 2, "id", "text", "cid", "text").collect() == []
