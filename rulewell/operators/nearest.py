"""Exact nearest neighbours by inner product, over a grid of query blocks and corpus streams.

The queries of a group are cut into blocks that fit in memory; the corpus is cut only as far as the
wanted number of tasks asks for it. One grid cell is one query block against one corpus part: the
block is held, the part streams past it in Arrow batches, and a running best ``k`` is all that is
kept. With more query blocks than tasks no query is copied at all, and the corpus is copied once per
query block. A group of any size spreads over its cells. Partial lists are merged by a window.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from rulewell.session import written

# What the queries held by one task may weigh as doubles, how many best rows it may hold for them, and corpus rows
# below which a part is not cut further.
BLOCK_BYTES, BLOCK_FOUND, LEAST_PART = 64 << 20, 1 << 20, 4096
# Decimal digits that the order of a sum cannot change; similarities are ranked on them.
DIGITS = 12
_CHUNK_CELLS = 1 << 20
# More than rounding to DIGITS can add to a product.
_SLACK = 1e-11
_CELL = ["__g", "__a", "__b"]


def dense_matrix(array: pa.ChunkedArray | pa.Array, dims: int | None) -> np.ndarray:
    """Matrix from a list column, or from a struct<indices, values> column of ``dims`` width."""
    merged = array.combine_chunks() if isinstance(array, pa.ChunkedArray) else array
    merged = merged.chunk(0) if isinstance(merged, pa.ChunkedArray) else merged
    if not pa.types.is_struct(merged.type):
        lengths = pc.list_value_length(merged).to_numpy(zero_copy_only=False)
        if len(lengths) and lengths.min() != lengths.max():
            raise ValueError(f"vectors of unequal length: {lengths.min()} to {lengths.max()}")
        flat = merged.flatten().to_numpy(zero_copy_only=False)
        return flat.astype(np.float64).reshape(len(merged), -1)
    indices, values = merged.field("indices"), merged.field("values")
    out = np.zeros((len(merged), dims))
    rows = np.repeat(np.arange(len(merged)), pc.list_value_length(indices).to_numpy(zero_copy_only=False))
    out[rows, indices.flatten().to_numpy(zero_copy_only=False)] = values.flatten().to_numpy(zero_copy_only=False)
    return out


def round_half_up(x: np.ndarray, digits: int) -> np.ndarray:
    scale = 10.0**digits
    return np.copysign(np.floor(np.abs(x) * scale + 0.5), x) / scale + 0.0


def best_places(similar: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """(row, column) of each row's best k, ties by column; -inf cells never count."""
    k = min(k, similar.shape[1])
    floor = np.partition(similar, similar.shape[1] - k, axis=1)[:, similar.shape[1] - k]
    rows, cols = np.nonzero((similar >= floor[:, None]) & np.isfinite(similar))
    return _cut(rows, cols, similar[rows, cols], k)


def _cut(rows: np.ndarray, order: np.ndarray, scores: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """The entries (rows, order) that are among the k best of their row."""
    kept = cut_places(rows, order, scores, k)
    return rows[kept], order[kept]


def cut_places(rows: np.ndarray, order: np.ndarray, scores: np.ndarray, k: int) -> np.ndarray:
    place = np.lexsort((order, -scores, rows))
    sorted_rows = rows[place]
    starts = np.searchsorted(sorted_rows, sorted_rows)
    return place[np.arange(len(place)) - starts < k]


def best_cells(
    products: np.ndarray, floor: np.ndarray, k: int, digits: int, own: np.ndarray | None = None, theirs: np.ndarray | None = None
) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, column, rounded product) of each row's best k; of rows with a floor only what reaches it.

    Cells under the floor of their row are neither rounded nor ranked. Cells with ``own`` of the row
    equal to ``theirs`` of the column never count.
    """
    known = floor > -np.inf
    parts = []
    if not known.all():
        some = np.flatnonzero(~known)
        similar = round_half_up(products if len(some) == len(products) else products[some], digits)
        if own is not None:
            similar[own[some, None] == theirs[None, :]] = -np.inf
        rows, cols = best_places(similar, k)
        parts.append((some[rows], cols, similar[rows, cols]))
    if known.any():
        least = np.where(known, floor - _SLACK * np.maximum(1, np.abs(floor)) - 10.0**-digits, np.inf)
        rows, cols = np.nonzero(products >= least[:, None])
        scores = round_half_up(products[rows, cols], digits)
        fits = (scores >= floor[rows]) & np.isfinite(scores)
        if own is not None:
            fits &= own[rows] != theirs[cols]
        rows, cols, scores = rows[fits], cols[fits], scores[fits]
        kept = cut_places(rows, cols, scores, k)
        parts.append((rows[kept], cols[kept], scores[kept]))
    rows, cols, scores = (np.concatenate(x) for x in zip(*parts))
    return rows, cols, scores


class _CellSearch:
    """One grid cell: its queries, and the best corpus rows seen so far for each of them."""

    def __init__(self, k: int, dims: int | None, exclude: bool, columns: list[str], digits: int):
        self.k, self.dims, self.exclude, self.columns, self.digits = k, dims, exclude, columns, digits
        self.held: list[pa.Table] = []
        self.queries: pa.Table | None = None
        self.rows = self.order = np.zeros(0, np.int64)
        self.scores = np.zeros(0)
        self.taken: pa.Table | None = None
        self.seen = 0

    def add(self, part: pa.Table) -> None:
        is_query = part["__side"].to_numpy() == 0
        n = int(is_query.sum())  # queries are sorted before the corpus
        if n:
            self.held.append(part.slice(0, n))
        if n < part.num_rows and self.held:
            self._stream(part.slice(n))

    def _stream(self, corpus: pa.Table) -> None:
        if self.queries is None:
            self.queries = pa.concat_tables(self.held)
            self.left = dense_matrix(self.queries["__vec"], self.dims)
            self.own = self.queries["__self"].to_numpy() if self.exclude else None
            # What a row must exceed to come among the best k seen so far.
            self.floor = np.full(len(self.left), -np.inf)
        right = dense_matrix(corpus["__vec"], self.dims)
        if right.shape[1] != self.left.shape[1]:
            raise ValueError(f"vectors of unequal length: {self.left.shape[1]} and {right.shape[1]}")
        ids = corpus["__self"].to_numpy() if self.exclude else None
        step = max(1, _CHUNK_CELLS // max(1, len(right)))
        found = []
        for at in range(0, len(self.left), step):
            floor = self.floor[at : at + step]
            own = self.own[at : at + step] if self.exclude else None
            rows, cols, scores = best_cells(self.left[at : at + step] @ right.T, floor, self.k, self.digits, own, ids)
            better = scores > floor[rows]  # equal ones stand behind those seen before
            found.append((rows[better] + at, cols[better] + self.seen, scores[better]))
        self._merge(corpus.select(self.columns), *(np.concatenate(x) for x in zip(*found)))
        self.seen += corpus.num_rows

    def _merge(self, corpus: pa.Table, rows: np.ndarray, order: np.ndarray, scores: np.ndarray) -> None:
        """Put what one part of the corpus adds among the best; only its queries are ranked anew."""
        if self.taken is None:
            self.taken = corpus.slice(0, 0)
        if not len(rows):
            return
        touched = np.zeros(len(self.left), bool)
        touched[rows] = True
        stays, old = np.flatnonzero(~touched[self.rows]), np.flatnonzero(touched[self.rows])
        rows, order, scores = (
            np.concatenate([have[old], new]) for have, new in ((self.rows, rows), (self.order, order), (self.scores, scores))
        )
        kept = cut_places(rows, order, scores, self.k)
        last = kept[np.r_[rows[kept][1:] != rows[kept][:-1], True]]  # each query's least
        full = np.bincount(rows[kept], minlength=len(self.left))[rows[last]] == self.k
        self.floor[rows[last[full]]] = scores[last[full]]
        stays, new = np.concatenate([stays, old[kept[kept < len(old)]]]), kept[kept >= len(old)]
        self.taken = pa.concat_tables([self.taken.take(pa.array(stays)), corpus.take(pa.array(order[new] - self.seen))]).combine_chunks()
        self.rows = np.concatenate([self.rows[stays], rows[new]])
        self.order = np.concatenate([self.order[stays], order[new]])
        self.scores = np.concatenate([self.scores[stays], scores[new]])

    def result(self, names: list[str]) -> pa.RecordBatch | None:
        if self.taken is None or not len(self.rows):
            return None
        ids = self.queries["__qid"].take(pa.array(self.rows))
        columns = [ids, *[self.taken[c] for c in self.columns], pa.array(self.scores, pa.float64())]
        return pa.table(columns, names=names).combine_chunks().to_batches()[0]


def key_runs(batches: Iterator[pa.RecordBatch], keys: list[str]) -> Iterator[tuple[bool, pa.Table]]:
    """(a new key begins, rows) for runs of one key in a stream sorted by ``keys``."""
    last = None
    for batch in batches:
        if not batch.num_rows:
            continue
        table = pa.Table.from_batches([batch])
        change = np.zeros(table.num_rows - 1, bool)
        for name in keys:
            values = batch.column(name)
            change |= pc.not_equal(values[1:], values[:-1]).to_numpy(zero_copy_only=False)
        bounds = [0, *(np.flatnonzero(change) + 1).tolist(), table.num_rows]
        for lo, hi in zip(bounds[:-1], bounds[1:]):
            key = tuple(batch.column(c)[lo].as_py() for c in keys)
            yield key != last, table.slice(lo, hi - lo)
            last = key


def nearest(
    queries: DataFrame,
    corpus: DataFrame,
    k: int,
    query_id: str = "query_id",
    query_vector: str = "embedding",
    corpus_id: str = "row_id",
    corpus_vector: str = "embedding",
    within: tuple[str, str] | None = None,
    carry: tuple[str, ...] = (),
    exclude_self: bool | tuple[str, str] = False,
    dims: int | None = None,
    digits: int = DIGITS,
    block_rows: int | None = None,
    sizes_from: tuple[DataFrame, DataFrame] | None = None,
) -> DataFrame:
    """(query_id, corpus_id, *carry, similarity, rank): each query's ``k`` best corpus rows.

    ``within`` names the query and corpus column that must be equal. Ties go to the smaller corpus
    id; a group with fewer than ``k`` rows gives fewer. ``carry`` copies small corpus columns.
    ``exclude_self`` leaves out corpus rows that stem from the query's own row: those with the same
    id, or with the same value in the named (query, corpus) columns. Vectors are ARRAY columns, or
    STRUCT<indices, values> with ``dims`` given; rows without a vector or a group take no part, and
    vectors of unequal length raise. ``sizes_from`` are cheaper tables with the same rows (and group
    columns) to count instead of the inputs. A task holds ``block_rows`` queries, by default as
    many as weigh BLOCK_BYTES and have BLOCK_FOUND best rows together.
    """
    own = exclude_self if isinstance(exclude_self, tuple) else (query_id, corpus_id)
    q = queries.select(
        (F.col(within[0]) if within else F.lit(0)).alias("__g"),
        F.col(query_id).alias("__qid"),
        F.col(query_vector).alias("__vec"),
        (F.col(own[0]) if exclude_self else F.lit(0)).alias("__self"),
    ).filter(F.col("__g").isNotNull() & F.col("__vec").isNotNull())
    c = corpus.select(
        (F.col(within[1]) if within else F.lit(0)).alias("__g"),
        F.col(corpus_id).alias("__cid"),
        F.col(corpus_vector).alias("__vec"),
        (F.col(own[1]) if exclude_self else F.lit(0)).alias("__self"),
        *carry,
    ).filter(F.col("__g").isNotNull() & F.col("__vec").isNotNull())
    q_rows, c_rows = sizes_from or (queries, corpus)
    if block_rows is None:
        first = None if dims else q.select(F.size("__vec")).first()
        block_rows = max(1, min(BLOCK_BYTES // (8 * max(1, dims or (first[0] if first else 1))), BLOCK_FOUND // k))
    grid = _grid(q_rows, c_rows, within, block_rows)

    def placed(df: DataFrame, id_column: str, mine: str, theirs: str, side: int) -> DataFrame:
        sized = df.join(grid, "__g")
        block = F.pmod(F.xxhash64(id_column), F.col(f"{mine}s")).cast("int")
        across = F.explode(F.sequence(F.lit(0), F.col(f"{theirs}s") - 1))
        spread = sized.withColumn(mine, block).withColumn(theirs, across).withColumn("__side", F.lit(side))
        return spread.drop("__as", "__bs")

    both = placed(q, "__qid", "__a", "__b", 0).unionByName(placed(c, "__cid", "__b", "__a", 1), allowMissingColumns=True)
    columns = ["__cid", *carry]
    names = [query_id, corpus_id, *carry, "similarity"]
    schema = T.StructType(
        [
            T.StructField(query_id, q.schema["__qid"].dataType),
            T.StructField(corpus_id, c.schema["__cid"].dataType),
            *[T.StructField(name, c.schema[name].dataType) for name in carry],
            T.StructField("similarity", T.DoubleType()),
        ]
    )
    exclude = bool(exclude_self)

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cell = None
        for new, part in key_runs(batches, _CELL):
            if new:
                if cell is not None and (done := cell.result(names)) is not None:
                    yield done
                cell = _CellSearch(k, dims, exclude, columns, digits)
            cell.add(part)
        if cell is not None and (done := cell.result(names)) is not None:
            yield done

    ordered = both.repartition(*_CELL).sortWithinPartitions(*_CELL, "__side", "__cid")
    partial = ordered.mapInArrow(search, schema)
    order = Window.partitionBy(query_id).orderBy(F.col("similarity").desc(), F.col(corpus_id))
    return partial.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)


def _grid(queries: DataFrame, corpus: DataFrame, within: tuple[str, str] | None, block_rows: int) -> DataFrame:
    """(__g, __as, __bs): into how many query blocks and corpus parts each group is cut.

    Counted once and written, one row per group. Tasks go to groups by their share of all products.
    """
    tasks = int(queries.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    names = within or (None, None)

    def counted(df: DataFrame, name: str | None, into: str) -> DataFrame:
        group = F.col(name) if name else F.lit(0)
        rows = df.select(group.alias("__g")).filter(F.col("__g").isNotNull())
        return rows.groupBy("__g").agg(F.count(F.lit(1)).alias(into))

    sizes = counted(queries, names[0], "nq").join(counted(corpus, names[1], "nc"), "__g")
    sizes = written(sizes, "sizes")
    work = F.col("nq").cast("double") * F.col("nc")
    total = sizes.agg(F.sum(work)).scalar()
    blocks = F.ceil(F.col("nq") / block_rows)
    wanted = F.ceil(F.lit(float(tasks)) * work / total / blocks)
    parts = F.greatest(F.lit(1), F.least(wanted, F.ceil(F.col("nc") / LEAST_PART)))
    return sizes.select("__g", blocks.cast("int").alias("__as"), parts.cast("int").alias("__bs"))
