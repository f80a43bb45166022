"""The stored index against a search through all rows."""

from __future__ import annotations

import numpy as np
import pytest
from pyspark.sql import functions as F

from rulewell.operators.nearest import nearest
from rulewell.sources import vector_index as vi

KIND = "row_id long, rule string, embedding array<double>, value int"


def clustered(seed, n, dims=6, centres=12, lengths=False):
    rng = np.random.default_rng(seed)
    middle = rng.normal(size=(centres, dims))
    points = middle[rng.integers(0, centres, n)] + 0.15 * rng.normal(size=(n, dims))
    if not lengths:
        points /= np.linalg.norm(points, axis=1, keepdims=True)
    points[n // 2] = points[0]  # a tie
    return points


@pytest.fixture(scope="module", params=[False, True], ids=["unit", "any length"])
def corpus(request, spark):
    points = clustered(3, 400, lengths=request.param)
    rows = [(i, "hot" if i % 3 else f"r{i % 5}", [float(x) for x in p], i % 2) for i, p in enumerate(points)]
    rows += [(1000, None, rows[0][2], 1), (1001, "hot", None, 1), (1002, "hot", [0.0] * 6, 0)]
    return spark.createDataFrame(rows, KIND).repartition(5).cache()


def listed(df):
    return sorted((r.query_id, r["rank"], r.row_id, round(r.similarity, 9), r.value) for r in df.collect())


@pytest.mark.parametrize("group", [None, "rule"])
@pytest.mark.parametrize("n_cells,chunk", [(None, 1 << 20), (1, 500), (40, 300)])
def test_same_rows_as_a_flat_search(spark, tmp_path, monkeypatch, corpus, group, n_cells, chunk):
    monkeypatch.setattr(vi, "CHUNK_BYTES", chunk)
    monkeypatch.setattr(vi, "QUERY_ROWS", 90)
    found = vi.build_index(corpus, str(tmp_path / "i"), group=group, carry=("value",), n_cells=n_cells)
    asked = corpus.withColumnRenamed("row_id", "query_id").filter("query_id % 5 = 0 or query_id > 900")
    within = (group, group) if group else None
    flat = corpus if group else corpus.filter("embedding is not null")
    want = nearest(asked, flat, 7, within=within, carry=("value",))
    got = vi.open_index(spark, str(tmp_path / "i")).search(asked, 7, query_group=group)
    assert listed(got) == listed(want)
    own = found.search(asked, 400, query_group=group, exclude_own="query_id")
    assert listed(own) == listed(nearest(asked, flat, 400, within=within, carry=("value",), exclude_self=True))


def test_cells_are_skipped(spark, tmp_path, corpus):
    found = vi.build_index(corpus, str(tmp_path / "i"), n_cells=25)
    asked = corpus.withColumnRenamed("row_id", "query_id").filter("query_id % 50 = 0 and query_id < 900")
    read = found.cells_read(asked, 5).agg(F.sum("cells_read").alias("r"), F.sum("cells").alias("c"), F.count(F.lit(1)).alias("n")).first()
    assert read.n == 8 and 0 < read.r < 0.6 * read.c


def test_only_folders_of_wanted_cells_are_scanned(spark, tmp_path, corpus):
    found = vi.build_index(corpus, str(tmp_path / "i"), n_cells=25)
    some = found.rows.filter(F.col("cell").isin([1, 2]))
    assert "PartitionFilters: [cell" in some._jdf.queryExecution().executedPlan().toString()


def test_bound_is_never_below_an_inner_product():
    import pyarrow as pa

    for seed in range(30):
        points = clustered(seed, 80, lengths=True)
        centroids = vi.k_means(points, 7)
        cell = (vi._unit(points) @ centroids.T).argmax(axis=1)
        rows = []
        for c in np.unique(cell):
            own = points[cell == c]
            angle = np.arccos(np.clip(vi._unit(own) @ centroids[c], -1, 1)).max()
            length = np.linalg.norm(own, axis=1)
            rows.append((c, len(own), 1, angle, length.min(), length.max()))
        choice = vi._Choice(pa.table(dict(zip(["cell", "n", "chunks", "angle", "low", "high"], map(list, zip(*rows)), strict=True))), centroids)
        queries = clustered(100 + seed, 20, lengths=True)
        close, first = choice.closest(queries, 10)
        bound = choice.bound(queries, close)
        assert (first.sum(axis=1) >= 1).all() and ((first * choice.n).sum(axis=1) >= 10).all()
        for at, c in enumerate(choice.cell):
            assert ((queries @ points[cell == c].T).max(axis=1) <= bound[:, at]).all()


def test_edges(spark, tmp_path, corpus):
    empty = vi.build_index(corpus.filter("false"), str(tmp_path / "e"), carry=("value",))
    asked = corpus.withColumnRenamed("row_id", "query_id")
    assert empty.search(asked, 3).count() == 0
    found = vi.build_index(corpus, str(tmp_path / "i"), carry=("value",))
    assert found.search(asked.filter("false"), 3).count() == 0
    with pytest.raises(FileNotFoundError):
        vi.open_index(spark, str(tmp_path / "absent"))
    ragged = spark.createDataFrame([(1, "a", [1.0], 0), (2, "a", [1.0, 2.0], 0)], KIND)
    with pytest.raises(ValueError, match="unequal length"):
        vi.build_index(ragged, str(tmp_path / "r"))
    short = asked.withColumn("embedding", F.slice("embedding", 1, 3))
    with pytest.raises(Exception, match="unequal length"):
        found.search(short, 3).collect()


def test_a_query_goes_to_a_part_once(spark, tmp_path, monkeypatch, corpus):
    monkeypatch.setattr(vi, "PART_BYTES", 4000)
    monkeypatch.setattr(vi, "WAITING_ROWS", 50)
    found = vi.build_index(corpus, str(tmp_path / "i"), carry=("value",), n_cells=40)
    asked = corpus.withColumnRenamed("row_id", "query_id").filter("query_id % 3 = 0")
    sent = []
    sweep = vi.VectorIndex._sweep
    monkeypatch.setattr(vi.VectorIndex, "_sweep", lambda self, a, visits, *rest: sent.append(visits) or sweep(self, a, visits, *rest))
    got = found.search(asked, 60, exclude_own="query_id")
    flat = corpus.filter("embedding is not null")
    assert listed(got) == listed(nearest(asked, flat, 60, carry=("value",), exclude_self=True))
    parts = found._parts().select("part").distinct().count()
    visits = sent[0].groupBy("qid").count().agg(F.max("count"), F.avg("count")).first()
    far = found._visits(found._asked(asked, "query_id", "embedding", None, None), 61, found._first(found._asked(asked, "query_id", "embedding", None, "query_id"), 60, True)[2])
    assert 3 <= parts < 12 and visits[0] <= parts and far.count() > 2 * sent[0].count()
