"""Best match above a threshold between sparse vectors, through inverted lists with per-term maxima.

One side is held in blocks: for every term the list of rows that have it, and the largest weight in the list. The
other side streams past. No inner product of a row with the block exceeds the sum of its weights times the maxima, so
a row whose sum stays under the threshold is dropped at once. Of the others, terms are taken in the
order of what they can contribute until the rest cannot reach the threshold; only rows of the block that share one of
these terms are candidates, and their inner products are computed from the sparse entries. Vectors are never made dense.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from rulewell.operators.nearest import DIGITS, key_runs, round_half_up
from rulewell.session import written

# The held side may weigh so many bytes in a task; one block of at most this size is given to all tasks, several are dealt out.
BLOCK_BYTES, ENTRY_BYTES = 32 << 20, 16
# Entries of inverted lists read, and candidate entries compared, at a time.
PIECE = 1 << 20
SLACK = 1e-9


def _entries(vectors: pa.ChunkedArray | pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, term, weight) of a STRUCT<indices, values> column, in row order; null vectors have no entries."""
    merged = vectors.combine_chunks() if isinstance(vectors, pa.ChunkedArray) else vectors
    merged = merged.chunk(0) if isinstance(merged, pa.ChunkedArray) else merged
    indices, values = pc.struct_field(merged, "indices"), pc.struct_field(merged, "values")
    sizes = pc.fill_null(pc.list_value_length(indices), 0).to_numpy(zero_copy_only=False)
    rows = np.repeat(np.arange(len(merged)), sizes)
    return rows, indices.flatten().to_numpy(zero_copy_only=False).astype(np.int64), values.flatten().to_numpy(zero_copy_only=False)


class Postings:
    """The inverted lists of one block; its rows stand in the order of their ids."""

    def __init__(self, block: pa.Table, threshold: float):
        self.ids, self.threshold = block["cid"], threshold
        rows, terms, weights = _entries(block["vec"])
        by_term = np.lexsort((rows, terms))
        self.rows, self.weights = rows[by_term], weights[by_term]
        terms = terms[by_term]
        self.n_terms = int(terms[-1]) + 1 if len(terms) else 0
        self.start = np.searchsorted(terms, np.arange(self.n_terms + 1))
        self.top = np.zeros(self.n_terms)
        np.maximum.at(self.top, terms, np.abs(self.weights))
        self.key = terms * len(block) + self.rows  # ascending: one place for every (term, row)

    def _candidates(self, rows: np.ndarray, terms: np.ndarray, weights: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Distinct (query row, block row) that share a term which the threshold cannot do without."""
        most = np.abs(weights) * self.top[terms]
        order = np.lexsort((-most, rows))
        rows, terms, most = rows[order], terms[order], most[order]
        begins = np.flatnonzero(np.r_[True, rows[1:] != rows[:-1]]) if len(rows) else np.zeros(0, np.intp)
        total = np.add.reduceat(most, begins) if len(begins) else np.zeros(0)
        place = np.cumsum(np.r_[True, rows[1:] != rows[:-1]]) - 1 if len(rows) else np.zeros(0, np.intp)
        before = np.cumsum(most) - most
        rest = total[place] - (before - before[begins][place])  # what this term and the later ones can still bring
        needed = rest >= self.threshold - SLACK
        rows, terms = rows[needed], terms[needed]
        sizes = self.start[terms + 1] - self.start[terms]
        within = np.arange(sizes.sum()) - np.repeat(np.cumsum(sizes) - sizes, sizes)
        partner = self.rows[np.repeat(self.start[terms], sizes) + within]
        pair = np.unique(np.repeat(rows, sizes) * len(self.ids) + partner)
        return pair // len(self.ids), pair % len(self.ids)

    def best(self, vectors: pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(query row, block row, similarity): the best block row of each query row that reaches the threshold."""
        rows, terms, weights = _entries(vectors)
        known = terms < self.n_terms
        rows, terms, weights = rows[known], terms[known], weights[known]
        bound = np.bincount(rows, np.abs(weights) * self.top[terms], minlength=len(vectors))
        open_rows = bound[rows] >= self.threshold - SLACK
        rows, terms, weights = rows[open_rows], terms[open_rows], weights[open_rows]
        # Whole rows together, as many as their lists allow.
        read = self.start[terms + 1] - self.start[terms]
        piece = ((np.cumsum(read) - read) // PIECE)[np.searchsorted(rows, rows)]
        cuts = [0, *(np.flatnonzero(np.diff(piece)) + 1).tolist(), len(rows)]
        parts = [self._best(rows[lo:hi], terms[lo:hi], weights[lo:hi]) for lo, hi in zip(cuts[:-1], cuts[1:], strict=True)]
        left, right, similar = (np.concatenate(x) for x in zip(*parts, strict=True))
        return left, right, similar

    def _best(self, rows: np.ndarray, terms: np.ndarray, weights: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        left, right = self._candidates(rows, terms, weights)
        first, sizes = np.searchsorted(rows, left), np.searchsorted(rows, left, "right") - np.searchsorted(rows, left)
        similar = np.zeros(len(left))
        cuts = np.searchsorted(np.cumsum(sizes), np.arange(0, sizes.sum() + PIECE, PIECE)).tolist()
        for lo, hi in zip(cuts, [*cuts[1:], len(left)], strict=True):
            n = sizes[lo:hi]
            if not n.sum():
                continue
            pair = np.repeat(np.arange(hi - lo), n)
            at = np.repeat(first[lo:hi], n) + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
            wanted = terms[at] * len(self.ids) + right[lo:hi][pair]
            place = np.minimum(np.searchsorted(self.key, wanted), len(self.key) - 1)
            hit = self.key[place] == wanted
            similar[lo:hi] = np.bincount(pair[hit], weights[at][hit] * self.weights[place[hit]], minlength=hi - lo)
        similar = round_half_up(similar, DIGITS)
        kept = similar >= self.threshold
        left, right, similar = left[kept], right[kept], similar[kept]
        order = np.lexsort((right, -similar, left))
        top = order[np.r_[True, left[order][1:] != left[order][:-1]]] if len(order) else order
        return left[top], right[top], similar[top]


def best_above(
    rows: DataFrame, held: DataFrame, threshold: float, key: str, held_key: str, vector: str = "vector"
) -> DataFrame:
    """(key, held_key, similarity): each row's most similar held row, for rows that reach ``threshold`` (above 0).

    Vectors are STRUCT<indices, values> with ascending indices. Equal similarities (to 12 digits) go to the smaller held key;
    rows without a vector match nothing. The held side is given to all tasks if its counted entries fit one
    block, else both sides are dealt out by block and part.
    """
    if threshold <= 0:
        raise ValueError("the threshold must be above 0")
    spark = rows.sparkSession
    asked = rows.select(F.col(key).alias("qid"), F.col(vector).alias("vec")).filter(F.col("vec").isNotNull())
    stored = written(held.select(F.col(held_key).alias("cid"), F.col(vector).alias("vec")).filter(F.col("vec").isNotNull()), "held")
    entries = stored.agg(F.sum(F.size("vec.indices") + 1)).first()[0] or 0
    blocks = -(-entries * ENTRY_BYTES // BLOCK_BYTES)
    schema = T.StructType([
        T.StructField(key, asked.schema["qid"].dataType), T.StructField(held_key, stored.schema["cid"].dataType), T.StructField("similarity", T.DoubleType())
    ])

    def matched(postings: Postings, queries: pa.Table) -> Iterator[pa.RecordBatch]:
        left, right, similar = postings.best(queries["vec"])
        if len(left):
            columns = [queries["qid"].take(pa.array(left)), postings.ids.take(pa.array(right)), pa.array(similar)]
            yield from pa.table(columns, names=[key, held_key, "similarity"]).combine_chunks().to_batches()

    if blocks <= 1:
        shared = spark.sparkContext.broadcast(stored.orderBy("cid").toArrow())

        def stream(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            postings = Postings(shared.value, threshold)
            for batch in batches:
                if batch.num_rows and len(postings.ids):
                    yield from matched(postings, pa.Table.from_batches([batch]))

        return asked.mapInArrow(stream, schema)

    parts = max(1, int(spark.conf.get("spark.sql.shuffle.partitions")) // blocks)
    deal = lambda name, n: F.pmod(F.xxhash64(name), F.lit(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    left = stored.withColumns({"block": deal("cid", blocks), "part": every(parts), "side": F.lit(0)})
    right = asked.withColumns({"part": deal("qid", parts), "block": every(blocks), "side": F.lit(1)})
    keys = ["block", "part"]
    both = left.unionByName(right, allowMissingColumns=True)

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pieces, postings = [], None
        for new, piece in key_runs(batches, keys):
            if new:
                pieces, postings = [], None
            n = int((piece["side"].to_numpy() == 0).sum())
            if n:
                pieces.append(piece.slice(0, n))
            if n < piece.num_rows and pieces:
                postings = postings or Postings(pa.concat_tables(pieces), threshold)
                yield from matched(postings, piece.slice(n))

    ordered = both.repartition(*keys).sortWithinPartitions(*keys, "side", "cid")
    order = Window.partitionBy(key).orderBy(F.col("similarity").desc(), F.col(held_key))
    found = ordered.mapInArrow(search, schema).withColumn("__r", F.row_number().over(order))
    return found.filter(F.col("__r") == 1).drop("__r")
