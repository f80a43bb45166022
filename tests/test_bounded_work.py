"""Work that a task holds at a time stays bounded, with the same results."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pytest

from rulewell.operators import nearest as search
from rulewell.operators import retrieval, sampling, similarity, sparse_join


@pytest.mark.parametrize("own", [False, True])
def test_cells_under_the_floor_are_not_ranked(own):
    rng = np.random.default_rng(3)
    products = np.round(rng.normal(size=(40, 300)), 2)
    mine, theirs = (rng.integers(0, 9, n) if own else None for n in (40, 300))
    none = np.full(40, -np.inf)
    rows, cols, scores = search.best_cells(products, none, 7, 12, mine, theirs)
    floor = np.where(np.arange(40) % 3 > 0, np.bincount(rows, scores, 40) / 7, -np.inf)
    got = sorted(zip(*search.best_cells(products, floor, 7, 12, mine, theirs)))
    assert got == sorted((r, c, s) for r, c, s in zip(rows, cols, scores) if s >= floor[r]) and len(got) < len(rows)


def test_held_results_bound_the_query_blocks(spark, monkeypatch):
    seen = []
    grid = search._grid
    monkeypatch.setattr(search, "_grid", lambda *a: seen.append(a[-1]) or grid(*a))
    df = spark.range(30).selectExpr("id AS query_id", "id AS row_id", "array(double(id), 1d) AS embedding")
    assert search.nearest(df, df, 25).count() == 30 * 25
    assert seen == [min(search.BLOCK_BYTES // 16, search.BLOCK_FOUND // 25)]


def test_one_task_ranks_a_small_digest_bucket(spark):
    rows = spark.range(200_000)
    kept = sampling.sample_n(rows, 1_000, "id", 5)
    # Sixteen buckets would give one task 12,500 rows with all their columns.
    assert ", 1, 2)" in kept._jdf.queryExecution().toString() and kept.count() == 1_000


def test_pieces_of_batches_and_of_lists():
    batch = pa.RecordBatch.from_arrays([pa.array([["a", "b"]] * 1_300)], names=["t"])
    pieces = list(similarity._pieces(iter([batch])))
    assert sum(p.num_rows for p in pieces) == 1_300 and max(p.num_rows for p in pieces) <= similarity.PIECE_ROWS


def test_lists_are_read_piece_by_piece(monkeypatch):
    rng = np.random.default_rng(4)

    def vectors(n):
        terms = [np.sort(rng.choice(30, 6, replace=False)).astype(np.int32) for _ in range(n)]
        kind = pa.struct([("indices", pa.list_(pa.int32())), ("values", pa.list_(pa.float64()))])
        return pa.chunked_array([pa.array([{"indices": t, "values": rng.random(6)} for t in terms], kind)])

    held, asked = vectors(50), vectors(80)
    postings = sparse_join.Postings(pa.table({"cid": pa.array(range(50)), "vec": held}), 0.5)
    whole = [x.tolist() for x in postings.best(asked)]
    sizes = []
    one = sparse_join.Postings._candidates
    monkeypatch.setattr(sparse_join.Postings, "_candidates", lambda self, rows, *a: sizes.append(len(set(rows.tolist()))) or one(self, rows, *a))
    monkeypatch.setattr(sparse_join, "PIECE", 200)
    assert [x.tolist() for x in postings.best(asked)] == whole and len(whole[0]) > 40
    assert max(sizes) < 20 and sum(sizes) <= 80


def test_overlap_beside_the_group_words_equals_the_bounded_one(spark, monkeypatch):
    rng = np.random.default_rng(5)
    monkeypatch.setattr(retrieval, "HELD_ROWS", 7)
    words = [[int(w) for w in rng.choice(40, rng.integers(0, 12), replace=False)] for _ in range(90)]
    words[3], words[50] = None, []
    group = [i % 3 for i in range(90)]
    docs = spark.createDataFrame([(i, words[i], group[i]) for i in range(30, 90)], "row_id long, words array<long>, group long")
    asked = spark.createDataFrame([(i, words[i], group[i]) for i in range(30)], "query_id long, words array<long>, group long")
    pairs = [(q, c, float(rng.integers(0, 3)), int(c)) for q in range(29) for c in range(30, 90) if group[q] == group[c] and rng.random() < 0.6]
    found = spark.createDataFrame(pairs, "query_id long, row_id long, similarity double, value int")
    plain = retrieval.rerank_by_overlap(found, asked.drop("group"), docs.drop("group"), 4)
    beside = retrieval.rerank_by_overlap(found, asked, docs, 4, group="group")
    assert sorted(map(tuple, beside.select(*plain.columns).collect())) == sorted(map(tuple, plain.collect()))
    assert plain.count() > 100 and len({r[0] for r in pairs}) == 29
