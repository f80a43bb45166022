"""A stored vector index that finds exact nearest neighbours by inner product and skips what cannot count.

Building. Directions of a bounded sample are clustered (spherical k-means), and every row of the corpus goes
to the cell of its closest centroid. Rows are stored by cell, and a small table keeps for each group and
cell its size, the widest angle between a row and the centroid, and the range of lengths. The sample
decides how much can be skipped, never what is found.

Searching. By the triangle inequality of angles no row of a cell has a larger inner product with a query than
its length, times the largest length in the cell, times the cosine of the angle to the centroid less the cell's
widest angle. A query first reads the closest cells that hold k rows; its k-th similarity there
is a floor, and then it reads those other cells whose bound reaches the floor. The rest is never read.

On a cluster. First a task holds one chunk of a cell and streams the queries that are closest to it. For the other
cells a task holds a part, many cells together, and a query goes to it once, however many of these cells it must read:
the task knows from the bound which, and gives the best rows of the part, not of every cell. Stored rows are moved
once a step, and again only where the queries of a part are dealt to several tasks for their number. Only folders of
cells that some query asked for are scanned. Centroids, at most ``MAX_CELLS``, are the one thing every task receives.
"""

from __future__ import annotations

import json
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from rulewell.operators.nearest import DIGITS, best_cells, cut_places, dense_matrix, key_runs
from rulewell.session import written

MAX_CELLS, K_MEANS_ROUNDS = 1024, 8
# What the sample, a held chunk of a cell, and one product of a chunk with queries may weigh.
SAMPLE_BYTES, CHUNK_BYTES, PRODUCT_CELLS = 32 << 20, 16 << 20, 1 << 20
# What the cells held together as a part may weigh, and found rows that wait to be ranked.
PART_BYTES, WAITING_ROWS = 32 << 20, 1 << 18
# Queries of one group that look at the list of its cells in one task.
QUERY_ROWS = 65_536
# Angles and lengths are rounded sums; the bound gives way by this much.
SLACK = 1e-9
_GROUP = ["g", "salt"]
_VISIT = ["g", "cell", "chunk", "block"]
_PLACE = ["g", "part", "block"]


def _unit(matrix: np.ndarray) -> np.ndarray:
    length = np.linalg.norm(matrix, axis=1, keepdims=True)
    return matrix / np.where(length == 0, 1.0, length)


def k_means(sample: np.ndarray, n_cells: int, rounds: int = K_MEANS_ROUNDS) -> np.ndarray:
    """Unit centroids of at most ``n_cells`` clusters of the directions of ``sample``, the same in every run."""
    points = np.unique(_unit(sample), axis=0)
    if len(points) <= n_cells:
        return points
    draw = np.random.default_rng(11)
    centroids = points[np.sort(draw.choice(len(points), n_cells, replace=False))]
    for _ in range(rounds):
        closest = (points @ centroids.T).argmax(axis=1)
        sums = np.zeros_like(centroids)
        np.add.at(sums, closest, points)
        length = np.linalg.norm(sums, axis=1)
        centroids = np.where((length > 1e-12)[:, None], _unit(sums), centroids)
    return centroids


def build_index(
    corpus: DataFrame,
    path: str,
    row_id: str = "row_id",
    vector: str = "embedding",
    group: str | None = None,
    carry: tuple[str, ...] = (),
    own: str | None = None,
    n_cells: int | None = None,
) -> VectorIndex:
    """Store the rows of ``corpus`` that have a vector and a group under ``path``, a new folder.

    ``group`` names a column that queries can be bound to, ``carry`` small columns that results bring
    along, ``own`` a column by which queries can leave out their own rows (``row_id`` if not given).
    Without ``n_cells`` there are about as many cells as the root of the number of rows. Vectors of
    unequal length raise ValueError.
    """
    spark = corpus.sparkSession
    rows = corpus.select(
        (F.col(group) if group else F.lit(0)).alias("g"), F.col(row_id).alias("id"), F.col(own or row_id).alias("own"),
        F.col(vector).alias("vec"), F.struct(*carry).alias("carry") if carry else F.lit(None).cast("int").alias("carry"),
    ).filter(F.col("g").isNotNull() & F.col("vec").isNotNull())
    size = rows.agg(F.count(F.lit(1)).alias("n"), F.min(F.size("vec")).alias("least"), F.max(F.size("vec")).alias("most")).first()
    if size["least"] != size["most"]:
        raise ValueError(f"vectors of unequal length: {size['least']} to {size['most']}")
    dims = max(1, size["most"] or 1)
    wanted = min(MAX_CELLS, n_cells or max(1, round(size["n"] ** 0.5)))
    drawn = rows.orderBy(F.xxhash64("id"), "id").select(F.col("vec").cast("array<double>")).limit(max(1, SAMPLE_BYTES // (8 * dims)))
    centroids = k_means(dense_matrix(drawn.toArrow()["vec"], None), wanted) if size["n"] else np.zeros((0, dims))

    schema = T.StructType([*rows.schema.fields, T.StructField("cell", T.IntegerType()), T.StructField("angle", T.DoubleType()), T.StructField("length", T.DoubleType())])

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            matrix = dense_matrix(batch.column("vec"), None)
            close = _unit(matrix) @ centroids.T
            cell = close.argmax(axis=1)
            angle = np.arccos(np.clip(close[np.arange(len(cell)), cell], -1, 1))
            more = [pa.array(cell, pa.int32()), pa.array(angle), pa.array(np.linalg.norm(matrix, axis=1))]
            yield pa.RecordBatch.from_arrays([*batch.columns, *more], names=[*batch.schema.names, "cell", "angle", "length"])

    placed = written(rows.mapInArrow(assign, schema), "placed")
    chunks = F.ceil(F.count(F.lit(1)) * F.lit(8 * dims) / F.lit(CHUNK_BYTES)).cast("int")
    cells = placed.groupBy("g", "cell").agg(
        F.count(F.lit(1)).alias("n"), chunks.alias("chunks"), F.max("angle").alias("angle"), F.min("length").alias("low"), F.max("length").alias("high")
    )
    cells.write.parquet(f"{path}/cells")
    listed = [(i, [float(x) for x in c]) for i, c in enumerate(centroids)]
    spark.createDataFrame(listed, "cell int, centroid array<double>").coalesce(1).write.parquet(f"{path}/centroids")
    chunked = placed.join(spark.read.parquet(f"{path}/cells").select("g", "cell", "chunks"), ["g", "cell"])
    chunk = F.pmod(F.xxhash64("id"), F.col("chunks")).cast("int")
    stored = chunked.withColumn("chunk", chunk).select("g", "chunk", "id", "own", "vec", "carry", "cell")
    spark.createDataFrame([(stored.schema.json(),)], "rows string").coalesce(1).write.parquet(f"{path}/kind")
    # Adaptive execution may deal a large cell to several writers.
    stored.hint("rebalance", "cell").write.partitionBy("cell").parquet(f"{path}/rows")
    return open_index(spark, path)


def open_index(spark: SparkSession, path: str) -> VectorIndex:
    try:
        found = spark.read.parquet(f"{path}/centroids").orderBy("cell").collect()
        kind = spark.read.parquet(f"{path}/kind").first()["rows"]
        centroids = np.array([r["centroid"] for r in found]).reshape(len(found), len(found[0]["centroid"]) if found else 1)
        return VectorIndex(spark, path, centroids, T.StructType.fromJson(json.loads(kind)))
    except AnalysisException as error:
        if error.getCondition() == "PATH_NOT_FOUND":
            raise FileNotFoundError(f"no index at {path}") from error
        raise


class _Choice:
    """Which cells the queries of one group read, from the list of its cells."""

    def __init__(self, listed: pa.Table, centroids: np.ndarray):
        column = lambda name: listed[name].to_numpy()
        order = np.argsort(column("cell"))
        self.cell, self.n, self.chunks = (column(c)[order].astype(np.int64) for c in ("cell", "n", "chunks"))
        self.angle, self.low, self.high = (column(c)[order] for c in ("angle", "low", "high"))
        self.centroids = centroids[self.cell]
        if "parts" in listed.column_names:
            lists = listed["parts"].take(pa.array(order)).combine_chunks()
            self.parts, at = np.unique(lists.flatten().to_numpy(), return_inverse=True)
            self.members = np.zeros((len(order), len(self.parts)), np.float32)
            self.members[np.repeat(np.arange(len(order)), pc.list_value_length(lists).to_numpy()), at] = 1

    def closest(self, queries: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
        """(cosines to the centroids, mask of the closest cells that hold k rows together)."""
        close = np.clip(_unit(queries) @ self.centroids.T, -1, 1)
        order = np.argsort(-close, axis=1, kind="stable")
        before = np.cumsum(self.n[order], axis=1) - self.n[order]
        first = np.zeros(close.shape, bool)
        np.put_along_axis(first, order, before < k, axis=1)
        return close, first

    def bound(self, queries: np.ndarray, close: np.ndarray) -> np.ndarray:
        """What no inner product with a row of the cell exceeds."""
        best = np.cos(np.maximum(0, np.arccos(close) - self.angle))
        length = np.linalg.norm(queries, axis=1, keepdims=True)
        return length * np.where(best >= 0, self.high, self.low) * best + SLACK * (1 + length * self.high)


def _compared(column: pa.ChunkedArray) -> np.ndarray:
    """Values to be compared, as numbers where they are whole ones without nulls."""
    if pa.types.is_integer(column.type) and not column.null_count:
        return column.to_numpy()
    return np.array(column.to_pylist(), object)


class _Part:
    """The rows of some cells of a group, and the best of them for queries that read a choice of the cells."""

    def __init__(self, held: pa.Table, centroids: np.ndarray, exclude: bool):
        self.held = held
        number = held["cell"].to_numpy()
        order = np.argsort(number, kind="stable")  # inside a cell rows stay in the order of ids
        matrix = dense_matrix(held["vec"], None)[order]
        cell, starts = np.unique(number[order], return_index=True)
        ends = [*starts[1:].tolist(), len(order)]
        self.rows = [(order[lo:hi], matrix[lo:hi].T) for lo, hi in zip(starts, ends, strict=True)]
        self.own = _compared(held["own"]) if exclude else None
        close = np.einsum("ij,ij->i", _unit(matrix), centroids[number[order]])
        length = np.linalg.norm(matrix, axis=1)
        sizes = {"cell": cell, "n": ends - starts, "chunks": np.ones(len(cell), np.int64), "angle": np.arccos(np.clip(np.minimum.reduceat(close, starts), -1, 1))}
        self.choice = _Choice(pa.table(sizes | {"low": np.minimum.reduceat(length, starts), "high": np.maximum.reduceat(length, starts)}), centroids)

    def best(
        self, left: np.ndarray, floor: np.ndarray, seen: pa.ListArray, own: np.ndarray | None, k: int
    ) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(query, place, similarity) of each query's best k that reach its floor, outside the cells it has seen."""
        bound = self.choice.bound(left, np.clip(_unit(left) @ self.choice.centroids.T, -1, 1))
        known = seen.flatten().to_numpy()
        at = np.minimum(np.searchsorted(self.choice.cell, known), len(self.choice.cell) - 1)
        asking = np.repeat(np.arange(len(left)), pc.fill_null(pc.list_value_length(seen), 0).to_numpy())
        here = self.choice.cell[at] == known
        bound[asking[here], at[here]] = np.nan
        floor = floor.copy()
        none = np.zeros(0, np.int64)
        found, waiting = [(none, none, np.zeros(0))], 0
        for i, (places, right) in enumerate(self.rows):
            asking = np.flatnonzero(bound[:, i] >= floor)
            step = max(1, PRODUCT_CELLS // len(places))
            for lo in range(0, len(asking), step):
                some = asking[lo : lo + step]
                mine, theirs = (None, None) if own is None else (own[some], self.own[places])
                rows, cols, scores = best_cells(left[some] @ right, floor[some], k, DIGITS, mine, theirs)
                found.append((some[rows], places[cols], scores))
                waiting += len(rows)
            if waiting > WAITING_ROWS or i + 1 == len(self.rows):
                rows, cols, scores = (np.concatenate(x) for x in zip(*found, strict=True))
                kept = cut_places(rows, cols, scores, k)
                rows, cols, scores = rows[kept], cols[kept], scores[kept]
                found, waiting = [(rows, cols, scores)], 0
                last = np.flatnonzero(np.r_[rows[1:] != rows[:-1], np.ones(min(1, len(rows)), bool)])
                full = last[np.bincount(rows, minlength=len(left))[rows[last]] == k]
                floor[rows[full]] = scores[full]
        return found[0]


@dataclass
class VectorIndex:
    spark: SparkSession
    path: str
    centroids: np.ndarray
    kind: T.StructType

    @property
    def rows(self) -> DataFrame:
        """g, chunk, id, own, vec, carry, cell of every stored row."""
        return self.spark.read.schema(self.kind).parquet(f"{self.path}/rows")

    @property
    def cells(self) -> DataFrame:
        return self.spark.read.parquet(f"{self.path}/cells")

    def _asked(self, queries: DataFrame, query_id: str, vector: str, group: str | None, own: str | None) -> DataFrame:
        asked = queries.select(
            (F.col(group) if group else F.lit(0)).alias("g"), F.col(query_id).alias("qid"), F.col(vector).alias("vec"),
            (F.col(own) if own else F.lit(None).cast("int")).alias("own"),
        )
        return asked.filter(F.col("g").isNotNull() & F.col("vec").isNotNull())

    def _parts(self) -> DataFrame:
        """(g, cell, chunk, rows, part): chunks of cells put together to parts that weigh PART_BYTES, in the order of cells."""
        chunk = F.explode(F.sequence(F.lit(0), F.col("chunks") - 1)).alias("chunk")
        units = self.cells.select("g", "cell", chunk, (F.col("n") / F.col("chunks")).alias("rows"))
        before = Window.partitionBy("g").orderBy("cell", "chunk").rowsBetween(Window.unboundedPreceding, -1)
        weight = F.coalesce(F.sum("rows").over(before), F.lit(0.0)) * F.lit(8 * self.centroids.shape[1])
        return units.withColumn("part", F.floor(weight / F.lit(PART_BYTES)).cast("int"))

    def _visits(self, asked: DataFrame, k: int, floors: DataFrame | None = None, parts: DataFrame | None = None) -> DataFrame:
        """(qid, g, cell, n, chunks): the closest cells of every query, or with floors the others that it must read.

        With parts, (qid, g, part): the parts that these others are in.
        """
        sizes = asked.groupBy("g").agg(F.ceil(F.count(F.lit(1)) / QUERY_ROWS).cast("int").alias("salts"))
        names = ["cell", "n", "chunks", "angle", "low", "high"]
        lists = self.cells.join(sizes, "g").withColumns({"salt": F.explode(F.sequence(F.lit(0), F.col("salts") - 1)), "side": F.lit(0)}).drop("salts")
        mine = asked.select("g", "qid", "vec").join(sizes, "g").withColumns({"salt": F.pmod(F.xxhash64("qid"), F.col("salts")).cast("int"), "side": F.lit(1)})
        if floors is not None:
            mine = mine.join(floors.select("qid", "floor"), "qid", "left")
        if parts is not None:
            names.append("parts")
            lists = lists.join(parts.groupBy("g", "cell").agg(F.collect_set("part").alias("parts")), ["g", "cell"])
        both = mine.drop("salts").unionByName(lists, allowMissingColumns=True)
        if floors is None:
            both = both.withColumn("floor", F.lit(None).cast("double"))
        group, qid = both.schema["g"].dataType, both.schema["qid"].dataType
        listed = [("cell", T.IntegerType()), ("n", T.LongType()), ("chunks", T.IntegerType())] if parts is None else [("part", T.IntegerType())]
        schema = T.StructType([T.StructField("g", group), T.StructField("qid", qid), *[T.StructField(*x) for x in listed]])
        centroids, second, by_part = self.centroids, floors is not None, parts is not None

        def choose(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            held, choice = [], None
            for new, part in key_runs(batches, _GROUP):
                if new:
                    held, choice = [], None
                n = int((part["side"].to_numpy() == 0).sum())
                if n:
                    held.append(part.slice(0, n).select(names))
                if n == part.num_rows or not held:
                    continue
                if choice is None:
                    choice = _Choice(pa.concat_tables(held), centroids)
                rest = part.slice(n)
                matrix = dense_matrix(rest["vec"], None)
                if matrix.shape[1] != centroids.shape[1]:
                    raise ValueError(f"vectors of unequal length: {matrix.shape[1]} and {centroids.shape[1]}")
                step = max(1, PRODUCT_CELLS // max(1, len(choice.cell)))
                for at in range(0, len(matrix), step):
                    some = matrix[at : at + step]
                    close, wanted = choice.closest(some, k)
                    if second:
                        floor = rest["floor"].slice(at, len(some)).to_numpy().astype(np.float64)
                        floor = np.where(np.isnan(floor), -np.inf, floor)
                        wanted = ~wanted & (choice.bound(some, close) >= floor[:, None])
                    row, col = np.nonzero(wanted.astype(np.float32) @ choice.members if by_part else wanted)
                    if len(row):
                        ids = pa.array(row + at)
                        if by_part:
                            made = [pa.array(choice.parts[col], pa.int32())]
                        else:
                            made = [pa.array(choice.cell[col], pa.int32()), pa.array(choice.n[col], pa.int64()), pa.array(choice.chunks[col], pa.int32())]
                        yield from pa.table([rest["g"].take(ids), rest["qid"].take(ids), *made], names=schema.names).combine_chunks().to_batches()

        ordered = both.select("g", "salt", "side", "qid", "vec", "floor", *names).repartition(*_GROUP).sortWithinPartitions(*_GROUP, "side")
        return ordered.mapInArrow(choose, schema)

    def _read(self, asked: DataFrame, visits: DataFrame, k: int, exclude: bool) -> DataFrame:
        """(qid, id, carry, similarity): each query's best k of every chunk it asked for."""
        tasks = int(self.spark.conf.get("spark.sql.shuffle.partitions"))
        loads = visits.groupBy("g", "cell", "n", "chunks").agg(F.count(F.lit(1)).alias("nq"))
        loads = written(loads, "loads")
        work = loads.agg(F.sum(F.col("nq").cast("double") * F.col("n"))).first()[0]
        share = max(1.0, (work or 0.0) / (4 * tasks))
        blocks = F.least(F.col("nq"), F.ceil(F.col("nq").cast("double") * F.col("n") / F.col("chunks") / F.lit(share))).cast("int")
        loads = loads.select("g", "cell", blocks.alias("blocks"))
        some = [r["cell"] for r in loads.select("cell").distinct().collect()]  # at most MAX_CELLS numbers
        # Only the folders of these cells are scanned.
        kept = self.rows.filter(F.col("cell").isin(some)).join(loads, ["g", "cell"])
        held = kept.withColumns({"block": F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)), "side": F.lit(0)}).drop("blocks")
        placed = visits.join(loads, ["g", "cell"]).withColumns(
            {"block": F.pmod(F.xxhash64("qid"), F.col("blocks")).cast("int"), "chunk": F.explode(F.sequence(F.lit(0), F.col("chunks") - 1)), "side": F.lit(1)}
        )
        stream = placed.select("g", "cell", "chunk", "block", "side", "qid").join(asked.select("qid", "vec", "own"), "qid")
        both = held.unionByName(stream, allowMissingColumns=True)
        kinds = both.schema
        schema = T.StructType([kinds["qid"], kinds["id"], kinds["carry"], T.StructField("similarity", T.DoubleType())])

        def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            parts, corpus, right, mine = [], None, None, None
            for new, part in key_runs(batches, _VISIT):
                if new:
                    parts, corpus = [], None
                n = int((part["side"].to_numpy() == 0).sum())
                if n:
                    parts.append(part.slice(0, n))
                if n == part.num_rows or not parts:
                    continue
                if corpus is None:
                    corpus = pa.concat_tables(parts).combine_chunks()
                    right = dense_matrix(corpus["vec"], None).T
                    mine = _compared(corpus["own"]) if exclude else None
                queries = part.slice(n)
                left = dense_matrix(queries["vec"], None)
                theirs = _compared(queries["own"]) if exclude else None
                floor = np.full(len(left), -np.inf)
                step = max(1, PRODUCT_CELLS // max(1, right.shape[1]))
                for at in range(0, len(left), step):
                    own = theirs[at : at + step] if exclude else None
                    rows, cols, scores = best_cells(left[at : at + step] @ right, floor[at : at + step], k, DIGITS, own, mine)
                    if len(rows):
                        picked, found = pa.array(cols), pa.array(rows + at)
                        columns = [queries["qid"].take(found), corpus["id"].take(picked), corpus["carry"].take(picked), pa.array(scores)]
                        yield from pa.table(columns, names=["qid", "id", "carry", "similarity"]).combine_chunks().to_batches()

        ordered = both.select(*_VISIT, "side", "qid", "id", "own", "vec", "carry").repartition(*_VISIT).sortWithinPartitions(*_VISIT, "side", "id")
        return ordered.mapInArrow(search, schema)

    def _sweep(self, asked: DataFrame, visits: DataFrame, k: int, exclude: bool, floors: DataFrame, parts: DataFrame) -> DataFrame:
        """(qid, id, carry, similarity): each query's best k of every part it visits, of those that reach its floor."""
        tasks = int(self.spark.conf.get("spark.sql.shuffle.partitions"))
        loads = written(visits.groupBy("g", "part").agg(F.count(F.lit(1)).alias("nq")), "loads")
        sized = loads.join(parts.groupBy("g", "part").agg(F.sum("rows").alias("rows")), ["g", "part"])
        work = F.col("nq") * F.col("rows")
        share = max(1.0, (sized.agg(F.sum(work)).first()[0] or 0.0) / tasks)
        blocks = F.least(F.col("nq"), F.ceil(work / F.lit(share))).cast("int")
        loads = sized.select("g", "part", blocks.alias("blocks"))
        places = parts.join(loads, ["g", "part"]).drop("rows")
        some = [r["cell"] for r in places.select("cell").distinct().collect()]  # at most MAX_CELLS numbers
        kept = self.rows.filter(F.col("cell").isin(some)).join(places, ["g", "cell", "chunk"])
        held = kept.withColumns({"block": F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)), "side": F.lit(0)}).drop("blocks", "chunk")
        block = F.pmod(F.xxhash64("qid"), F.col("blocks")).cast("int").alias("block")
        placed = visits.join(loads, ["g", "part"]).select("g", "part", block, F.lit(1).alias("side"), "qid")
        stream = placed.join(asked.select("qid", "vec", "own").join(floors, "qid"), "qid")
        both = held.unionByName(stream, allowMissingColumns=True)
        kinds = both.schema
        schema = T.StructType([kinds["qid"], kinds["id"], kinds["carry"], T.StructField("similarity", T.DoubleType())])
        centroids = self.centroids

        def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            pieces, part = [], None
            for new, rows in key_runs(batches, _PLACE):
                if new:
                    pieces, part = [], None
                n = int((rows["side"].to_numpy() == 0).sum())
                if n:
                    pieces.append(rows.slice(0, n))
                if n == rows.num_rows or not pieces:
                    continue
                if part is None:
                    part = _Part(pa.concat_tables(pieces).combine_chunks(), centroids, exclude)
                step = max(1, PRODUCT_CELLS // len(part.rows))
                for at in range(n, rows.num_rows, step):
                    queries = rows.slice(at, step)
                    floor = queries["floor"].to_numpy().astype(np.float64)
                    floor = np.where(np.isnan(floor), -np.inf, floor)
                    own = _compared(queries["own"]) if exclude else None
                    found, places, scores = part.best(dense_matrix(queries["vec"], None), floor, queries["seen"].combine_chunks(), own, k)
                    if len(found):
                        picked = part.held.select(["id", "carry"]).take(pa.array(places))
                        columns = [queries["qid"].take(pa.array(found)), picked["id"], picked["carry"], pa.array(scores)]
                        yield from pa.table(columns, names=["qid", "id", "carry", "similarity"]).combine_chunks().to_batches()

        names = [*_PLACE, "side", "qid", "id", "cell", "own", "vec", "carry", "floor", "seen"]
        ordered = both.select(*names).repartition(*_PLACE).sortWithinPartitions(*_PLACE, "side", "id")
        return ordered.mapInArrow(search, schema)

    def search(
        self,
        queries: DataFrame,
        k: int,
        query_id: str = "query_id",
        query_vector: str = "embedding",
        query_group: str | None = None,
        row_id: str = "row_id",
        exclude_own: str | None = None,
    ) -> DataFrame:
        """(query_id, row_id, *carry, similarity, rank): each query's ``k`` best rows, those of its group alone.

        The rows are those of a search through all of them: ties go to the smaller id, a group with
        fewer than ``k`` rows gives fewer, and with ``exclude_own`` rows whose ``own`` value is the
        query's value in that column take no part. ``query_id`` is unique; queries without a vector
        or a group have no rows.
        """
        asked, exclude = self._asked(queries, query_id, query_vector, query_group, exclude_own), exclude_own is not None
        _, first, floors = self._first(asked, k, exclude)
        parts = written(self._parts(), "parts")
        far = written(self._visits(asked, k + 1 if exclude else k, floors, parts), "visits")
        found = _best(first.drop("rank").unionByName(self._sweep(asked, far, k, exclude, floors, parts)), k)
        kind = self.kind["carry"].dataType
        carried = [F.col(f"carry.{name}") for name in (kind.names if isinstance(kind, T.StructType) else ())]
        return found.select(F.col("qid").alias(query_id), F.col("id").alias(row_id), *carried, "similarity", "rank")

    def cells_read(self, queries: DataFrame, k: int, query_id: str = "query_id", query_vector: str = "embedding", query_group: str | None = None) -> DataFrame:
        """(query_id, cells_read, cells): how many of its group's cells a search reads for each query."""
        asked = self._asked(queries, query_id, query_vector, query_group, None)
        near, _, floors = self._first(asked, k, False)
        visits = near.unionByName(self._visits(asked, k, floors))
        read = visits.groupBy("qid").agg(F.count(F.lit(1)).alias("cells_read"))
        total = self.cells.groupBy("g").agg(F.count(F.lit(1)).alias("cells"))
        return asked.select("g", "qid").join(read, "qid").join(total, "g").select(F.col("qid").alias(query_id), "cells_read", "cells")

    def _first(self, asked: DataFrame, k: int, exclude: bool) -> tuple[DataFrame, DataFrame, DataFrame]:
        """The visits (qid, g, cell, ...) to the closest cells, the best rows there, and by qid its floor and the cells seen."""
        near = written(self._visits(asked, k + 1 if exclude else k), "visits")
        first = written(_best(self._read(asked, near, k, exclude), k), "first")
        floors = first.filter(F.col("rank") == k).select("qid", F.col("similarity").alias("floor"))
        seen = near.groupBy("qid").agg(F.collect_set("cell").alias("seen"))
        return near, first, written(seen.join(floors, "qid", "left"), "floors")


def _best(found: DataFrame, k: int) -> DataFrame:
    by_rank = Window.partitionBy("qid").orderBy(F.col("similarity").desc(), F.col("id"))
    return found.withColumn("rank", F.row_number().over(by_rank)).filter(F.col("rank") <= k)
