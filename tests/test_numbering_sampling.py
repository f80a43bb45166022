"""Distributed row numbers and seeded samples against brute force."""

from __future__ import annotations

import hashlib

import pytest
from pyspark.sql import functions as F

from rulewell.operators import sampling
from rulewell.operators.numbering import number_rows, number_rows_by_hash


def digest(key, seed):
    return hashlib.md5(f"{key}|{seed}".encode()).hexdigest()


@pytest.fixture(scope="module")
def rows(spark):
    """Sparse ids; one group holds most rows and one group is null."""
    ids = spark.range(3000).select((F.col("id") * F.col("id") * 7 + 3).alias("id"))
    hot = F.when(F.col("id") % 10 < 7, F.lit("hot")).when(F.col("id") % 10 == 7, F.lit("small"))
    return ids.withColumn("g", hot).repartition(5).cache()


def test_global_numbers(rows):
    got = number_rows(rows, "id", total="n").toPandas().sort_values("id")
    assert got.rn.tolist() == list(range(3000)) and set(got.n) == {3000}


def test_numbers_within_a_hot_group(rows):
    got = number_rows(rows, "id", within=("g",), total="n").toPandas()
    for _, part in got.groupby("g", dropna=False):
        assert part.sort_values("id").rn.tolist() == list(range(len(part)))
        assert set(part.n) == {len(part)}


def test_numbers_of_few_rows(spark):
    got = number_rows(spark.range(3).repartition(2), "id").toPandas().sort_values("id")
    assert got.rn.tolist() == [0, 1, 2]


def test_hash_numbers(rows):
    got = number_rows_by_hash(rows, "id", 5).toPandas().sort_values("rn")
    assert got.id.tolist() == sorted(got.id, key=lambda i: digest(i, 5))


def test_samples(spark, rows, monkeypatch):
    ordered = sorted((r.id for r in rows.collect()), key=lambda i: digest(i, 42))
    want = set(ordered[:500])
    assert {r.id for r in sampling.sample_n(rows, 500, "id").collect()} == want
    monkeypatch.setattr(sampling, "BUCKET_ROWS", 10)
    assert {r.id for r in sampling.sample_n(rows, 500, "id").collect()} == want
    assert sampling.sample_n(rows, 5000, "id").count() == 3000
    part = sampling.sample_fraction(rows.repartition(3), 0.7, "id", 42)
    assert {r.id for r in part.collect()} == set(ordered[:2100])
    assert sampling.sample_fraction(spark.range(5), 0.5, "id").count() == round(2.5)


def test_shuffle_and_top(rows):
    ids = [r.id for r in sampling.shuffle(rows, "id", 9).collect()]
    assert ids == sorted(ids, key=lambda i: digest(i, 9))
    top = sampling.n_largest(rows, 3, "id", "id").collect()
    assert [r.id for r in top] == sorted(ids)[::-1][:3]


def test_samples_with_repeated_and_null_keys(spark, monkeypatch):
    keys = [None if i % 30 == 0 else i // 100 for i in range(3000)]
    df = spark.createDataFrame([(k, i) for i, k in enumerate(keys)], "k long, v long").repartition(4)
    for rows_per_bucket in (200_000, 10):
        monkeypatch.setattr(sampling, "BUCKET_ROWS", rows_per_bucket)
        drawn = sampling.sample_n(df, 150, "k").collect()
        assert len(drawn) == 150 and len({r.v for r in drawn}) == 150
        assert sampling.sample_fraction(df, 0.05, "k").count() == 150
        assert {tuple(r) for r in drawn} == {tuple(r) for r in sampling.sample_n(df.repartition(7), 150, "k").collect()}
    nulls = {sampling.sample_n(df, 1500, "k", seed).filter("k is null").count() > 0 for seed in range(6)}
    assert nulls == {True, False}


def test_pairs_are_spread_whatever_the_sizes(spark):
    from rulewell.operators.reshape import community_rule_pairs

    communities = spark.range(31).selectExpr("id", "concat('c', id) as subreddit")
    rules = spark.range(40).selectExpr("id", "concat('r', id) as rule")
    drawn = community_rule_pairs(communities, rules, 200).collect()
    assert len({(r.subreddit, r.rule) for r in drawn}) == 200
    assert len({r.subreddit for r in drawn}) >= 29 and len({r.rule for r in drawn}) >= 37
    assert community_rule_pairs(communities, rules, None).count() == 31 * 40
    assert community_rule_pairs(communities.filter("false"), rules, 5).count() == 0


def test_keyed_permutation_is_one_to_one(spark):
    from rulewell.functions.sampling_keys import halves, permuted

    for size in (1, 2, 3, 7, 50, 997, 1024):
        a, b = halves(size)
        assert size <= a * b < size + a
        got = [r.p for r in spark.range(size).select(permuted("id", size, 5).alias("p")).collect()]
        assert sorted(got) == list(range(size))
    large = 10**12 + 39
    got = [r.p for r in spark.range(3000).select(permuted("id", large, 5).alias("p")).collect()]
    assert len(set(got)) == 3000 and 0 <= min(got) < large / 500 and large > max(got) > large - large / 500
    other = [r.p for r in spark.range(50).select(permuted("id", 1024, 6).alias("p")).collect()]
    assert other != [r.p for r in spark.range(50).select(permuted("id", 1024, 5).alias("p")).collect()]


def test_samples_of_a_huge_product_cost_what_they_draw(spark):
    from rulewell.functions.sampling_keys import permuted

    draws = spark.range(200).select(permuted("id", 10**11, 21).alias("p"))
    assert draws.distinct().count() == 200  # 10^11 pair numbers, 200 digests


def test_bounds_are_a_table_of_levels(spark):
    from rulewell.operators.numbering import number_rows

    frame = spark.range(0, 3000, 3).selectExpr("id as k")
    numbered = number_rows(frame, "k", side=40)
    assert [r.rn for r in numbered.orderBy("k").collect()] == list(range(1000))
    assert len(numbered._jdf.queryExecution().analyzed().toString()) < 60_000


def test_scratch_of_the_application_can_be_removed(spark, tmp_path, monkeypatch):
    from rulewell import session

    own = f"{tmp_path}/rulewell-{spark.sparkContext.applicationId}"
    assert session._scratch_base(spark).endswith(f"rulewell-{spark.sparkContext.applicationId}")
    monkeypatch.setattr(session, "_scratch_base", lambda spark: own)
    (tmp_path / "rulewell-other").mkdir()
    assert session.written(spark.range(5), "five").count() == 5
    assert session.scratch_folder(spark, "x").startswith(f"{own}/x-")
    assert session.clear_scratch(spark) and not session.clear_scratch(spark)
    assert [p.name for p in tmp_path.iterdir() if not p.name.startswith(".")] == ["rulewell-other"]
