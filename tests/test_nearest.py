"""Blocked nearest neighbours and retrieval against brute force."""

from __future__ import annotations

import numpy as np
import pytest
from pyspark.sql import functions as F

from rulewell.operators import retrieval, similarity
from rulewell.operators.nearest import nearest
from rulewell.plans.classify import RetrievalSettings, classify


@pytest.fixture(scope="module")
def points(spark):
    """240 vectors of which many are exact copies; one rule holds most of them."""
    rng = np.random.default_rng(7)
    base = rng.normal(size=(60, 8))
    vectors = base[rng.integers(0, 60, 240)]
    vectors /= np.linalg.norm(vectors, axis=1, keepdims=True)
    rules = ["hot" if i % 4 else f"rule{i % 3}" for i in range(240)]
    rows = [(i, rules[i], [float(x) for x in vectors[i]], 1 if i % 3 else -1) for i in range(240)]
    df = spark.createDataFrame(rows, "row_id long, rule string, embedding array<double>, value int").repartition(6)
    return df.cache(), vectors, np.array(rules)


def brute(vectors, k, rules=None, exclude_self=False):
    out = {}
    similar = np.round(vectors @ vectors.T, 12)
    for q in range(len(vectors)):
        ids = [c for c in range(len(vectors)) if (rules is None or rules[c] == rules[q]) and not (exclude_self and c == q)]
        out[q] = sorted(ids, key=lambda c: (-similar[q, c], c))[:k]
    return out


def result(df):
    got = df.orderBy("query_id", "rank").collect()
    out = {}
    for r in got:
        out.setdefault(r.query_id, []).append(r.row_id)
    return out


@pytest.mark.parametrize("block_rows,least_part", [(4096, 4096), (50, 30), (17, 7)])
@pytest.mark.parametrize("grouped", [False, True])
def test_blocks_do_not_change_the_result(points, block_rows, least_part, grouped, monkeypatch):
    monkeypatch.setattr("rulewell.operators.nearest.LEAST_PART", least_part)
    df, vectors, rules = points
    queries = df.withColumnRenamed("row_id", "query_id")
    got = nearest(
        queries, df, 9, within=("rule", "rule") if grouped else None, exclude_self=True, block_rows=block_rows
    )
    assert result(got) == brute(vectors, 9, rules if grouped else None, exclude_self=True)


def test_short_groups_give_fewer_rows_and_nested_results(points):
    df, vectors, rules = points
    queries = df.withColumnRenamed("row_id", "query_id")
    wide = result(nearest(queries, df, 200, within=("rule", "rule"), block_rows=40))
    sizes = {r: int((rules == r).sum()) for r in set(rules)}
    assert all(len(found) == min(200, sizes[rules[q]]) for q, found in wide.items())
    small = result(nearest(queries, df, 3, within=("rule", "rule")))
    assert all(wide[q][:3] == found for q, found in small.items())


def test_small_arrow_batches_give_the_same(spark, points):
    df, vectors, rules = points
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "7")
    try:
        got = result(nearest(df.withColumnRenamed("row_id", "query_id"), df, 9, within=("rule", "rule"), block_rows=20))
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert got == brute(vectors, 9, rules)


def test_close_neighbours_are_ranked_on_all_digits(spark):
    rows = [(1, [1.0, 0.0]), (2, [1.0 + 1e-8, 0.0])]
    corpus = spark.createDataFrame(rows, "row_id long, embedding array<double>")
    asked = spark.createDataFrame([(9, [1.0, 0.0])], "query_id long, embedding array<double>")
    assert [r.row_id for r in nearest(asked, corpus, 2).orderBy("rank").collect()] == [2, 1]


def test_own_rows_are_left_out_by_source(spark):
    corpus = spark.createDataFrame([(8, 1, [1.0]), (9, 1, [1.0]), (16, 2, [0.5])], "row_id long, source long, embedding array<double>")
    asked = spark.createDataFrame([(1, [1.0]), (8, [1.0])], "query_id long, embedding array<double>")
    got = result(nearest(asked, corpus, 3, exclude_self=("query_id", "source")))
    assert got == {1: [16], 8: [8, 9, 16]}


def test_ragged_and_null_vectors(spark):
    kind = "row_id long, embedding array<double>"
    good = spark.createDataFrame([(1, [1.0, 0.0]), (2, None), (3, [0.0, 1.0])], kind)
    asked = good.withColumnRenamed("row_id", "query_id")
    assert result(nearest(asked, good, 5)) == {1: [1, 3], 3: [3, 1]}
    ragged = spark.createDataFrame([(1, [1.0, 0.0]), (2, [1.0])], kind).coalesce(1)
    for left, right in ((asked, ragged), (ragged.withColumnRenamed("row_id", "query_id"), good)):
        with pytest.raises(Exception, match="unequal length"):
            nearest(left, right, 1).collect()


def test_sparse_vectors(spark):
    rows = [(0, ([0, 2], [0.6, 0.8])), (1, ([], [])), (2, ([2], [1.0]))]
    kind = "row_id long, embedding struct<indices:array<int>,values:array<double>>"
    df = spark.createDataFrame(rows, kind)
    got = nearest(df.withColumnRenamed("row_id", "query_id"), df, 1, dims=3).orderBy("query_id").collect()
    assert [(r.query_id, r.row_id, r.similarity) for r in got] == [(0, 0, 1.0), (1, 0, 0.0), (2, 2, 1.0)]


def test_empty_sides(spark, points):
    df, _, _ = points
    queries = df.withColumnRenamed("row_id", "query_id")
    assert nearest(queries.filter("false"), df, 3).count() == 0
    assert nearest(queries, df.filter("false"), 3).count() == 0


def test_rule_resolution(spark):
    known = spark.createDataFrame([("a", [1.0, 0.0]), ("b", [0.0, 1.0]), ("c", [1.0, 0.0])], "rule string, embedding array<double>")
    asked = spark.createDataFrame([("a", [0.0, 1.0]), ("x", [0.8, 0.6])], "rule string, embedding array<double>")
    got = {r.query_rule: (r.matched_rule, r.rule_match_type) for r in retrieval.resolve_rules(asked, known).collect()}
    assert got == {"a": ("a", "exact"), "x": ("a", "similar (similarity: 0.800)")}
    off = {r.query_rule: r.matched_rule for r in retrieval.resolve_rules(asked, known, fallback=False).collect()}
    assert off == {"a": "a", "x": None}


def test_votes(spark):
    rows = [(1, 0, 1, 0.5, 0.2), (1, 1, -1, 0.5, 0.4), (2, 0, -1, 0.9, 0.9)]
    df = spark.createDataFrame(rows, "query_id long, row_id long, value int, similarity double, rerank_score double")
    weighted = {r.query_id: (r.rule_violation, r.decision) for r in retrieval.weighted_vote(df).collect()}
    assert weighted == {1: (0.0, 1), 2: (-0.9, 0)}
    fused = {r.query_id: r.decision for r in retrieval.fused_vote(df).collect()}
    assert fused == {1: 0, 2: 0}
    mean = {r.query_id: r.decision for r in retrieval.mean_vote(df, cut=0.0).collect()}
    assert mean == {1: 0, 2: 0}


def test_tfidf_matches_a_dictionary_version(spark):
    import math
    import re
    from collections import Counter

    from rulewell.functions.stopwords import ENGLISH

    docs = ["Spam links and more spam links", "Be kind to each other, kind people", "the and of", "zebra spam kind"]
    df = spark.createDataFrame(list(enumerate(docs)), "id long, text string")
    counts = [Counter(w for w in re.findall(r"\w\w+", d.lower()) if w not in ENGLISH) for d in docs]
    totals = Counter()
    for c in counts:
        totals.update(c)
    chosen = sorted(sorted(totals, key=lambda w: (-totals[w], w))[:4])
    idf = {w: math.log((1 + len(docs)) / (1 + sum(w in c for c in counts))) + 1 for w in chosen}
    vocabulary = similarity.fit_vocabulary(df, "text", 4)
    assert [r.term for r in vocabulary.orderBy("term_id").collect()] == chosen
    for row in similarity.tfidf_vectors(df, "id", "text", vocabulary).collect():
        raw = {i: counts[row.id][w] * idf[w] for i, w in enumerate(chosen) if counts[row.id][w]}
        length = math.sqrt(sum(x * x for x in raw.values())) or 1.0
        assert dict(zip(row.vector.indices, row.vector["values"])) == pytest.approx({i: x / length for i, x in raw.items()})


def test_classify_finds_the_twin(spark):
    corpus = spark.createDataFrame(
        [(1, "r1", "buy cheap pills now", 1), (2, "r1", "what a lovely photo", -1), (3, "r2", "buy cheap pills now", -1)],
        "row_id long, rule string, body string, value int",
    )
    queries = spark.createDataFrame(
        [(1, "r1", "cheap pills here now"), (2, "r2", "buy pills"), (3, "r9 new", "lovely photo")],
        "query_id long, rule string, body string",
    )
    got = {r.row_id: r for r in classify(queries, corpus, RetrievalSettings(top_k=1)).collect()}
    assert [got[i].decision for i in (1, 2)] == [1, 0]
    assert got[1].rule_match_type == "exact" and got[3].rule_match_type.startswith("similar")
    assert got[1].num_retrieved == 1 and got[1].reranked


def test_classify_on_a_retrieval_corpus_equals_brute_force(spark):
    """The README's call: corpus and queries from one table, checked against plain Python."""
    import hashlib
    import random
    import re

    from rulewell.plans.classify import query_prompts, retrieval_corpus

    draw = random.Random(5)
    vocabulary = "spam link buy cheap photo lovely garden kind rude insult help thanks".split()
    say = lambda: " ".join(draw.choices(vocabulary, k=6))
    names = "row_id long, subreddit string, rule string, body string, rule_violation int, positive_example_1 string, negative_example_1 string, positive_example_2 string, negative_example_2 string"
    rows = [(i, "s", f"r{i % 3}", say(), i % 2, say(), say(), say(), say()) for i in range(40)]
    train = spark.createDataFrame(rows, names)
    test = spark.createDataFrame([(100 + r[0], *r[1:4], None, *r[5:]) for r in rows[:10]], names)
    corpus = retrieval_corpus(train, test)
    held = corpus.collect()
    assert len({r.row_id for r in held}) == len(held)
    queries = query_prompts(train).select(F.col("row_id").alias("query_id"), "rule", "body")
    got = {r.row_id: r for r in classify(queries, corpus, RetrievalSettings(retrieval_k=7, top_k=3, exclude_self=True)).collect()}
    assert len(got) == 40
    tokens = lambda text: re.findall(r"\w{2,}", text.lower())

    def vector(text):
        v = np.bincount([int(hashlib.md5(w.encode()).hexdigest()[:4], 16) % 64 for w in tokens(text)], minlength=64)
        return v / np.linalg.norm(v)

    for q in queries.collect():
        near = [(-round(float(vector(q.body) @ vector(c.body)), 12), c.row_id, c) for c in held if c.rule == q.rule and c.source_row != q.query_id]
        near = sorted(near, key=lambda x: x[:2])[:7]
        mine = set(tokens(q.body))
        scored = sorted((-len(mine & set(tokens(c.body))) / len(mine), s, i, c.value) for s, i, c in near)[:3]
        score = sum((0.5 * -s + 0.5 * -r) * value for r, s, _, value in scored)
        assert got[q.query_id].rule_violation == pytest.approx(score, abs=1e-8)
    doubled = corpus.withColumn("row_id", F.col("source_row"))
    with pytest.raises(ValueError, match="unique"):
        classify(queries, doubled)


def test_overlap_bound_and_late_words_give_the_same_rows(spark, monkeypatch):
    """Reranking with words for few candidates equals reranking with words for all, ties and empty sets included."""
    rng = np.random.default_rng(4)
    pool = rng.integers(-(2**62), 2**62, 90).tolist()

    def some(n):
        return [int(x) for x in rng.choice(pool, n, replace=False)]

    docs = [(i, some(int(rng.integers(0, 60)))) for i in range(80)] + [(80, []), (81, None)]
    asked = [(i, some(int(rng.integers(0, 40)))) for i in range(25)] + [(25, []), (26, None)]
    listed = [(q, d, float(rng.integers(0, 5)) / 4) for q, _ in asked for d, _ in docs if rng.random() < 0.5]
    corpus = spark.createDataFrame(docs, "row_id long, words array<long>")
    queries = spark.createDataFrame(asked, "query_id long, words array<long>")
    found = spark.createDataFrame(listed, "query_id long, row_id long, similarity double").withColumn("value", F.lit(1))
    plain = retrieval.rerank(
        found, queries.select("query_id", F.coalesce("words", F.array().cast("array<long>")).alias("query_text")),
        corpus.select("row_id", F.coalesce("words", F.array().cast("array<long>")).alias("doc_text")), 4,
    )
    want = sorted((r.query_id, r.final_rank, r.row_id, r.rerank_score) for r in plain.collect())
    for bits in (64, 1024):
        monkeypatch.setattr(retrieval, "SIGNATURE_BITS", bits)
        late = retrieval.rerank_by_overlap(found, queries, corpus, 4)
        assert sorted((r.query_id, r.final_rank, r.row_id, r.rerank_score) for r in late.collect()) == want
    monkeypatch.setattr(retrieval, "SIGNATURE_BITS", 1024)
    both = found.join(corpus.withColumnRenamed("words", "d"), "row_id").join(queries.withColumnRenamed("words", "q"), "query_id")
    empty = F.array().cast("array<long>")
    q, d = F.coalesce("q", empty), F.coalesce("d", empty)
    bound = both.select(retrieval.overlap_bound(retrieval.word_sketch(q), retrieval.word_sketch(d)).alias("b"), retrieval.token_overlap(q, d).alias("s"))
    rows = bound.collect()
    assert all(r.b >= r.s for r in rows) and sum(r.b - r.s < 0.1 for r in rows) > 0.8 * len(rows)


def test_sweep_by_running_sums(spark):
    rows = [(q, r, (q * r) % 7 / 7, 1 if (q + r) % 3 else -1) for q in range(12) for r in range(1, 4 + 2 * q) if not (q == 3 and r < 4)]
    near = spark.createDataFrame(rows, "query_id long, rank int, similarity double, value int")
    want = []
    for q in range(12):
        for k in (1, 3, 5, 20):
            own = [s * v for x, r, s, v in rows if x == q and r <= k]
            if own:
                total = round(sum(own), 9)
                want.append((q, k, total, int(total >= 0)))
    got = retrieval.sweep_votes(near, [5, 1, 3, 20, 5])
    assert "Generate" in got._jdf.queryExecution().executedPlan().toString()  # of the sums, after the aggregate
    assert sorted((r.query_id, r.top_k, round(r.rule_violation, 9) + 0.0, r.decision) for r in got.collect()) == sorted(want)
