"""Near-duplicate groups by an exact n-gram Jaccard join over count-vector trees.

Method. A text's word shingles are hashed; its set is also counted into groups by the leading bits of
the hashes. The counts are a point, and the sum of coordinate minima of two points bounds how many
shingles the sets can share. A tree over points keeps the coordinate maxima of every node, so a
query leaves out a node when even the minima with those maxima fall short. Pairs that survive are
verified on the whole sets.

On a cluster. In many dimensions no tree over all texts prunes well, so trees are built per cell: the
texts of one size band that share a shingle of their prefixes. With n shingles and the threshold t a
prefix holds the first n - ceil(t n) + 1 shingles of an order that is the same for all texts, and two
texts that reach t always share a prefix shingle; so cells lose nothing. The order goes by how many texts hold
a shingle, rarest first, as counted over all shingles of all texts in a sketch of ``SKETCH`` counters; that
keeps cells small and decides nothing else.

Equal sets are one class from the start, so copies are never paired. Links are found in three steps, and after each
one only cells whose texts are still of several components go on:

1. each text meets one other, the one that most of its cells name as their smallest number;
2. in the ``DRAWN_CELLS`` cells of a text with the smallest hashes, its tree finds the text a partner drawn at random;
3. all pairs of different components in the cells that are left, through their trees.

Count vectors travel in the last two steps only, so they are sent for texts that are still apart. A cell of
more than ``CELL_ROWS`` texts is cut into blocks, and pairs of blocks are separate tasks. No link between
different sets is lost, and large groups of near copies do not make all their pairs. Components are
found by star contraction, written to the shared folder in each step.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from rulewell.session import written

CELL_ROWS = 2048
SMALL_CELL = 8
LEAF_ROWS = 32
# Counters of the sketch that orders prefixes, a byte each, and the blocks they are added up in. This bounds what a
# task sends and what is broadcast; the order is for speed, any order gives the same rows.
SKETCH, SKETCH_BLOCKS, COUNT_BATCH = 1 << 22, 64, 2_000_000
# Cells in which a text looks for a drawn partner.
DRAWN_CELLS = 4
# About two shingles to a group keep the bound tight; trees read at most TREE_GROUPS of them.
LEAST_GROUPS, MOST_GROUPS, PER_GROUP, TREE_GROUPS = 8, 1 << 13, 2, 1024
# Bits of the filter that leaves texts out before their sets are made again; a fixed 2 MB.
FILTER_BITS = 24

_DRAW = np.random.default_rng(20240601)
_BYTE = _DRAW.integers(1, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_BYTE[65:91] = _BYTE[97:123]  # A-Z count as a-z
_BLANK = np.zeros(256, bool)
_BLANK[[9, 10, 11, 12, 13, 32]] = True
_PRIME = 0x9E3779B97F4A7C15
_SLICE = 1 << 16


def _powers(base: int) -> np.ndarray:
    out = np.empty(_SLICE + 1, np.uint64)
    value = 1
    for i in range(len(out)):
        out[i] = value
        value = value * base % (1 << 64)
    return out


_UP, _DOWN = _powers(_PRIME), _powers(pow(_PRIME, -1, 1 << 64))


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def word_hashes(text: str) -> np.ndarray:
    """64-bit hashes of the words (runs without ASCII white space), A-Z as a-z.

    A word's hash is a polynomial over its bytes, taken from running sums of slices that are cut at
    white space, so that memory and exponents stay bounded; a longer word than a slice is hashed alone.
    """
    data = np.frombuffer(text.encode("utf-8", "replace"), np.uint8)
    found, start = [], 0
    while start < len(data):
        end = min(len(data), start + _SLICE)
        if end < len(data):
            blanks = np.flatnonzero(_BLANK[data[start:end]])
            if len(blanks):
                end = start + int(blanks[-1]) + 1
            else:  # no white space in a slice: take the whole word
                later = np.flatnonzero(_BLANK[data[end:]])
                end = end + int(later[0]) if len(later) else len(data)
        found.append(_slice_hashes(data[start:end]))
        start = end
    return np.concatenate(found) if found else np.zeros(0, np.uint64)


def _slice_hashes(data: np.ndarray) -> np.ndarray:
    blank = _BLANK[data]
    edge = np.flatnonzero(np.diff(np.concatenate([[True], blank, [True]]).view(np.int8)))
    starts, ends = edge[::2], edge[1::2]
    if not len(starts):
        return np.zeros(0, np.uint64)
    if len(data) > _SLICE:  # one word beyond the slice size
        total = np.uint64(0)
        for at in range(starts[0], ends[0], _SLICE):
            part = _BYTE[data[at : min(at + _SLICE, ends[0])]]
            total = _mix(np.array([total + (part * _UP[: len(part)]).sum(dtype=np.uint64)], np.uint64))[0]
        return np.array([total], np.uint64)
    sums = np.zeros(len(data) + 1, np.uint64)
    np.cumsum(_BYTE[data] * _UP[: len(data)], out=sums[1:])
    return _mix((sums[ends] - sums[starts]) * _DOWN[starts])


def shingles(text: str | None, size: int) -> np.ndarray:
    """Sorted distinct 64-bit hashes of ``size`` consecutive words; fewer words are one shingle."""
    words = word_hashes(text or "")
    if not len(words):
        return words
    width = min(size, len(words))
    total = np.zeros(len(words) - width + 1, np.uint64)
    for k in range(width):
        total = _mix(total + words[k : k + len(total)]) + np.uint64(k)
    return np.unique(_mix(total + np.uint64(width)))


def n_groups(n: int) -> int:
    """A power of two near n / PER_GROUP, so that the counts of texts of like sizes compare."""
    groups = LEAST_GROUPS
    while groups < MOST_GROUPS and groups * PER_GROUP < n:
        groups *= 2
    return groups


def count_vector(found: np.ndarray) -> np.ndarray:
    """How many shingles fall in each group; groups are leading bits, so neighbours add up."""
    bits = n_groups(len(found)).bit_length() - 1
    return np.bincount((found >> np.uint64(64 - bits)).astype(np.intp), minlength=1 << bits)


def packed(counts: np.ndarray) -> bytes:
    """Counts in half a byte each where all fit, else in one byte or four."""
    top = counts.max()
    if top < 16:
        pairs = counts.astype(np.uint8)
        return (pairs[::2] << 4 | pairs[1::2]).tobytes()
    return counts.astype("<u4" if top > 255 else "<u1").tobytes()


def _vector(held: bytes, n: int, groups: int) -> np.ndarray:
    """The counts of a set of n shingles, added up to ``groups`` groups."""
    own = n_groups(n)
    counts = np.frombuffer(held, "<u4" if len(held) == 4 * own else "<u1")
    if 2 * len(held) == own:
        counts = np.stack([counts >> 4, counts & 15], axis=1).ravel()
    return counts.reshape(groups, own // groups).sum(axis=1, dtype=np.int32)


def needed(n: np.ndarray, m: np.ndarray, percent: int) -> np.ndarray:
    """The least overlap of sets of n and m shingles at which 100 i >= percent (n + m - i)."""
    return -(-percent * (n + m) // (100 + percent))


def _pairs_in(sizes: np.ndarray, points: np.ndarray, percent: int, allowed: Callable, draw: Callable | None):
    """(later, earlier) places of pairs that the bound lets through, in the order of size.

    ``allowed(rows, row)`` tells which of the rows may meet the row. With ``draw(rows, row)`` each row
    keeps one partner only, the one with the largest drawn number. A node is cut in two at the median of its
    widest coordinate, so that its halves hold like points; coordinate maxima and the smallest and largest size
    of a node bound all its rows.
    """
    found_a, found_b = [], []
    partner, drawn = np.full(len(sizes), -1), np.zeros(len(sizes), np.uint64)

    def visit(rows: np.ndarray, queries: np.ndarray) -> None:
        smallest, largest = sizes[rows].min(), sizes[rows].max()
        queries = queries[queries > rows.min()]  # partners come earlier in the order
        queries = queries[100 * largest >= percent * sizes[queries]]
        if not len(queries):
            return
        if len(rows) > LEAF_ROWS:
            shared = np.minimum(points[queries], points[rows].max(axis=0)).sum(axis=1)
            queries = queries[shared >= needed(sizes[queries], smallest, percent)]
            widest = np.ptp(points[rows], axis=0).argmax()
            order = rows[np.argsort(points[rows, widest], kind="stable")]
            for half in np.array_split(order, 2):
                visit(np.sort(half), queries)
            return
        for at in rows.tolist():
            own = queries[(queries > at) & allowed(queries, at)]
            own = own[100 * sizes[at] >= percent * sizes[own]]
            if len(own):
                shared = np.minimum(points[own], points[at]).sum(axis=1)
                own = own[shared >= needed(sizes[own], sizes[at], percent)]
                if draw is None:
                    found_a.append(own)
                    found_b.append(np.full(len(own), at))
                elif len(own):
                    number = draw(own, at)
                    won = own[number >= drawn[own]]
                    partner[won], drawn[won] = at, number[number >= drawn[own]]

    visit(np.arange(len(sizes)), np.arange(len(sizes)))
    if draw is not None:
        later = np.flatnonzero(partner >= 0)
        return later, partner[later]
    if not found_a:
        return np.zeros(0, np.intp), np.zeros(0, np.intp)
    return np.concatenate(found_a), np.concatenate(found_b)


def _cell_pairs(cell: pd.DataFrame, percent: int, every: bool) -> pd.DataFrame:
    """Candidate pairs of one block pair of one cell; rows of one block meet only if it is alone."""
    cell = cell.sort_values(["n", "doc_id"], kind="stable")
    sizes, ids = cell["n"].to_numpy(np.int64), cell["doc_id"].to_numpy(np.int64)
    groups = min(TREE_GROUPS, *(n_groups(int(n)) for n in sizes))
    points = np.stack([_vector(p, int(n), groups) for p, n in zip(cell["vector"], sizes, strict=True)])
    own, side, apart = cell["own"].to_numpy(bool), cell["side"].to_numpy(), cell["apart"].to_numpy(np.int64)
    cross = bool(cell["cross"].iat[0])

    def allowed(rows: np.ndarray, row: int) -> np.ndarray:
        # A pair belongs to the band of its larger text, and to the block pair that holds both.
        fits = (own[rows] | own[row]) & (apart[rows] != apart[row])
        return fits & (side[rows] != side[row]) if cross else fits

    token = _mix(np.array([cell["token"].iat[0]], np.int64).view(np.uint64))

    def draw(rows: np.ndarray, row: int) -> np.ndarray:
        # Partners differ from cell to cell, so a text tries many members of a large group at once.
        return _mix(ids[rows].view(np.uint64) * np.uint64(3) ^ _mix(ids[row : row + 1].view(np.uint64) ^ token))

    later, earlier = _pairs_in(sizes, points, percent, allowed, None if every else draw)
    return pd.DataFrame({"a": ids[later], "b": ids[earlier]})


def _grouped(batches: Iterator[pd.DataFrame], keys: list[str]) -> Iterator[pd.DataFrame]:
    """Whole groups of a partition that is sorted by ``keys``; holds one batch and one group."""
    rest = None
    for batch in batches:
        if not len(batch):
            continue
        frame = batch if rest is None else pd.concat([rest, batch], ignore_index=True)
        values = frame[keys].to_numpy()
        change = np.flatnonzero((values[1:] != values[:-1]).any(axis=1)) + 1
        bounds = [0, *change.tolist()]
        for lo, hi in zip(bounds[:-1], bounds[1:], strict=True):
            yield frame.iloc[lo:hi]
        rest = frame.iloc[bounds[-1] :]
    if rest is not None and len(rest):
        yield rest


def _slot(found: np.ndarray, counters: int) -> np.ndarray:
    return (found >> np.uint64(8)) & np.uint64(counters - 1)


def shingle_ranks(docs: DataFrame, size: int) -> np.ndarray:
    """A byte per counter of the sketch: how many texts hold its shingles, on a scale of logarithms.

    Every task counts all shingles of its texts, up to 255 a counter; tasks are added up block by block.
    """
    width = SKETCH // SKETCH_BLOCKS

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        counters, seen, total = np.zeros(SKETCH, np.uint16), set(), 0
        for batch in batches:
            for text in batch["text"]:
                found = shingles(text, size)
                mark = hash(found.tobytes())
                if mark in seen:  # a copy of a set in this stretch adds nothing to the order
                    continue
                seen.add(mark)
                np.add.at(counters, _slot(found, SKETCH).astype(np.intp), 1)
                total += len(found)
                if total >= COUNT_BATCH:
                    np.minimum(counters, 255, out=counters)
                    seen, total = set(), 0
        parts = np.minimum(counters, 255).astype(np.uint8).reshape(SKETCH_BLOCKS, width)
        some = [i for i in range(SKETCH_BLOCKS) if parts[i].any()]
        if some:
            yield pd.DataFrame({"block": np.array(some, np.int32), "counts": [parts[i].tobytes() for i in some]})

    def total(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        sums: dict[int, np.ndarray] = {}
        for batch in batches:
            for block, counts in zip(batch["block"].tolist(), batch["counts"], strict=True):
                own = sums.setdefault(block, np.zeros(width, np.int64))
                own += np.frombuffer(counts, np.uint8)
        ranks = [np.minimum(255, np.round(12 * np.log2(1 + own))).astype(np.uint8).tobytes() for own in sums.values()]
        if ranks:
            yield pd.DataFrame({"block": np.array(list(sums), np.int32), "ranks": ranks})

    counted = docs.select("text").mapInPandas(count, "block int, counts binary").repartition("block")
    out = np.zeros((SKETCH_BLOCKS, width), np.uint8)
    for row in counted.mapInPandas(total, "block int, ranks binary").collect():  # SKETCH bytes
        out[row["block"]] = np.frombuffer(row["ranks"], np.uint8)
    return out.ravel()


def sketches(docs: DataFrame, size: int, percent: int) -> DataFrame:
    """Per row: doc_id, n, two set hashes, the prefix shingles and the count vector."""
    shared = docs.sparkSession.sparkContext.broadcast(shingle_ranks(docs, size))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        ranks = shared.value
        for batch in batches:
            rows = []
            for doc_id, text in zip(batch["doc_id"], batch["text"], strict=True):
                found = shingles(text, size)
                n = len(found)
                length = n + percent * n // -100 + 1 if n else 0
                # The sort is stable, so shingles of one rank stay in the order of their hashes.
                prefix = found[np.argsort(ranks[_slot(found, len(ranks))], kind="stable")[:length]]
                high = int(_mix(found).sum(dtype=np.uint64).view(np.int64)) if n else 0
                low = int(_mix(found ^ np.uint64(0xA5A5A5A5A5A5A5A5)).sum(dtype=np.uint64).view(np.int64)) if n else 0
                vector = packed(count_vector(found)) if n else b""
                rows.append((doc_id, n, high, low, prefix.view(np.int64), vector))
            yield pd.DataFrame(rows, columns=["id", "n", "high", "low", "prefix", "vector"])

    text_id = docs.select(F.col("doc_id").cast("string").alias("doc_id"), "text")  # nulls stay exact in pandas
    schema = "id string, n long, high long, low long, prefix array<long>, vector binary"
    sketched = text_id.mapInPandas(run, schema)
    return sketched.select(F.col("id").cast("long").alias("doc_id"), "n", "high", "low", "prefix", "vector")


def _band(n: Column, percent: int) -> Column:
    """Sizes that can reach the threshold are in one band or in neighbouring ones."""
    return F.floor(F.log(n) / F.log(F.lit(100.1 / percent))).cast("int")


def _cells(reps: DataFrame, percent: int) -> DataFrame:
    """(token, band, doc_id, n, own, m, hub) of every cell that can hold a pair; m is its row count, hub its smallest number.

    A text stands in the cells of its own band and, as the smaller partner, of the next one. A pair's first
    common shingle stands early in the smaller set: with n shingles there, and the least overlap o of two sets of n,
    among the first n - o + 1. So only those places ask for a larger or equal partner, and a cell without one of them
    holds no pair. One shuffle by token serves all windows.
    """
    least = F.expr(f"({2 * percent} * n + {99 + percent}) div {100 + percent}")
    tokens = reps.select("doc_id", "n", F.posexplode("prefix").alias("place", "token"))
    tokens = tokens.select("token", "doc_id", "n", (F.col("place") <= F.col("n") - least).alias("early"))
    order = Window.partitionBy("token").orderBy("n", "doc_id")
    smaller = F.last(F.when(F.col("early"), F.col("n")), ignorenulls=True).over(order.rowsBetween(Window.unboundedPreceding, -1))
    near = tokens.withColumns({"before": smaller, "after": F.lead("n").over(order)})
    meets_smaller = F.coalesce(100 * F.col("before") >= percent * F.col("n"), F.lit(False))
    reach = meets_smaller | (F.col("early") & (100 * F.col("n") >= percent * F.col("after")))
    band = _band(F.col("n"), percent)
    own, lower = F.struct(band.alias("band"), F.lit(True).alias("own")), F.struct((band + 1).alias("band"), F.lit(False).alias("own"))
    places = F.when(F.col("early"), F.array(own, lower)).otherwise(F.array(own))
    spread = near.where(reach).select("token", "doc_id", "n", "early", F.explode(places).alias("s"))
    cell = Window.partitionBy("token", "s.band")
    hub = F.min(F.struct("doc_id", "n", "s.own")).over(cell)
    some = F.max("s.own").over(cell) & F.max("early").over(cell)
    counted = spread.withColumns({"m": F.count(F.lit(1)).over(cell), "any": some, "hub": hub})
    return counted.where((F.col("m") > 1) & F.col("any")).select("token", "s.band", "doc_id", "n", "s.own", "m", "hub")


def _fits(x: Column, y: Column, percent: int) -> Column:
    """Whether two rows of a cell may be a pair: one is in its own band, and sizes allow the threshold."""
    sizes = (100 * F.least(x["n"], y["n"]) >= percent * F.greatest(x["n"], y["n"])) & (x["doc_id"] != y["doc_id"])
    return (x["own"] | y["own"]) & sizes


def _hub_pairs(cells: DataFrame, percent: int) -> DataFrame:
    """(a, b) with a > b: each text with the hub that most of its cells name, the smallest of several."""
    fits = _fits(F.struct("doc_id", "n", "own"), F.col("hub"), percent)
    named = cells.where(fits).groupBy("doc_id", F.col("hub.doc_id").alias("hub")).agg(F.count(F.lit(1)).alias("times"))
    best = named.groupBy("doc_id").agg(F.max(F.struct("times", (-F.col("hub")).alias("less"))).alias("best"))
    return best.select(F.col("doc_id").alias("a"), (-F.col("best.less")).alias("b"))


def _open_cells(cells: DataFrame, joined: DataFrame) -> DataFrame:
    """Rows of the cells that hold several components, with ``apart``, the component so far; written.

    ``joined`` has the component of every text with a link.
    """
    known = joined.select(F.col("node").alias("doc_id"), F.col("component"))
    labelled = cells.drop("apart").join(known, "doc_id", "left").withColumn("apart", F.coalesce("component", "doc_id")).drop("component")
    ends = labelled.groupBy("token", "band").agg(F.min("apart").alias("x"), F.max("apart").alias("y")).where("x <> y")
    return written(labelled.join(ends.select("token", "band"), ["token", "band"], "left_semi"), "open")


def _small_pairs(cells: DataFrame, percent: int) -> DataFrame:
    """Pairs of different components in cells with at most SMALL_CELL rows, by sorted neighbours at distance 1, 2, ..."""
    order = Window.partitionBy("token", "band").orderBy("n", "doc_id")
    row = F.struct("doc_id", "n", "own", "apart")
    columns = {f"x{k}": F.lag(row, k).over(order) for k in range(1, SMALL_CELL)}
    rows = cells.where(F.col("m") <= SMALL_CELL).withColumns(columns)
    partners = F.array_compact(F.array(*columns))
    fits = F.filter(partners, lambda x: _fits(x, row, percent) & (x["apart"] != F.col("apart")))
    found = rows.select(F.col("doc_id").alias("a"), F.explode(fits).alias("x")).select("a", F.col("x.doc_id").alias("b"))
    return found.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()


def _drawn_cells(cells: DataFrame) -> DataFrame:
    """The rows of each text in its DRAWN_CELLS open large cells with the smallest hashes, which near copies share."""
    order = Window.partitionBy("doc_id").orderBy(F.xxhash64("token"), "token", "band")
    few = cells.where(F.col("m") > SMALL_CELL).withColumn("place", F.row_number().over(order)).where(F.col("place") <= DRAWN_CELLS)
    counts = few.groupBy("token", "band").agg(F.count(F.lit(1)).alias("m")).where("m > 1")
    return few.drop("place", "m").join(counts, ["token", "band"])


def _large_pairs(large: DataFrame, percent: int, every: bool) -> DataFrame:
    """Pairs of cells with more rows, through their trees, block pair by block pair."""
    blocks = F.ceil(F.col("m") / CELL_ROWS).cast("int")
    own = F.pmod(F.xxhash64("doc_id"), blocks).cast("int")
    cut = large.withColumns({"blocks": blocks, "side": own})
    dealt = cut.select("*", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("other"))
    dealt = dealt.select(
        "token", "band", F.least("side", "other").alias("i"), F.greatest("side", "other").alias("j"),
        (F.col("side") != F.col("other")).alias("cross"), "side", "doc_id", "n", "own", "vector", "apart",
    )
    # A block pair (i, j) gets the rows of both; the rows of (i, i) meet each other.
    keys = ["token", "band", "i", "j"]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for cell in _grouped(batches, keys):
            if len(cell) > 1:
                yield _cell_pairs(cell, percent, every)

    ordered = dealt.repartition(*keys).sortWithinPartitions(*keys)
    found = ordered.mapInPandas(run, "a long, b long")
    return found.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()


def bounded(pairs: DataFrame, sketch: DataFrame, percent: int) -> DataFrame:
    """The pairs whose count vectors, with all their groups, let the threshold be reached; written."""
    vectors = sketch.select("doc_id", "n", "vector").dropDuplicates(["doc_id", "n", "vector"])
    both = pairs.join(vectors.toDF("a", "n_a", "v_a"), "a").join(vectors.toDF("b", "n_b", "v_b"), "b")

    def bound(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            keep = []
            for n, m, v, w in zip(batch["n_a"], batch["n_b"], batch["v_a"], batch["v_b"], strict=True):
                groups = min(n_groups(n), n_groups(m))
                shared = int(np.minimum(_vector(v, n, groups), _vector(w, m, groups)).sum())
                keep.append(shared >= -(-percent * (n + m) // (100 + percent)))
            yield batch.loc[keep, ["a", "b"]]

    return written(both.mapInPandas(bound, "a long, b long"), "pairs")


def _filter_place(ids: np.ndarray) -> np.ndarray:
    return (_mix(ids.astype(np.int64).view(np.uint64)) >> np.uint64(64 - FILTER_BITS)).astype(np.int64)


def _filter(ids: DataFrame) -> np.ndarray:
    """A bit per hashed number, of fixed size: at most 2^FILTER_BITS / 64 words reach the driver."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            place = _filter_place(batch["doc_id"].to_numpy())
            yield pd.DataFrame({"word": place >> 6, "bit": np.int64(1) << (place & 63)})

    words = ids.mapInPandas(run, "word long, bit long").groupBy("word").agg(F.bit_or("bit").alias("bits")).toPandas()
    bits = np.zeros(1 << (FILTER_BITS - 6), np.int64)
    bits[words["word"].to_numpy(np.int64)] = words["bits"].to_numpy(np.int64)
    return bits


def sets_of(docs: DataFrame, ids: DataFrame, size: int) -> DataFrame:
    """(doc_id, found) with the packed whole sets of the documents in ``ids``; written.

    The texts are read again rather than stored as sets or shuffled. A filter of fixed size lets all
    wanted documents through and few others; an exact join takes those out.
    """
    wanted = written(ids.distinct(), "wanted")
    shared = docs.sparkSession.sparkContext.broadcast(_filter(wanted))

    def sets(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        bits = shared.value
        for batch in batches:
            place = _filter_place(batch["doc_id"].to_numpy(np.int64))
            kept = batch[(bits[place >> 6] >> (place & 63) & 1) == 1]
            found = [shingles(t, size).tobytes() for t in kept["text"]]
            yield pd.DataFrame({"doc_id": kept["doc_id"], "found": found})

    numbered = docs.where(F.col("doc_id").isNotNull()).select("doc_id", "text")
    made = numbered.mapInPandas(sets, "doc_id long, found binary").join(wanted, "doc_id", "left_semi")
    return written(made.dropDuplicates(["doc_id", "found"]), "sets")


def verified(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs whose whole sets reach the threshold; written."""
    both = pairs.join(sets.toDF("a", "set_a"), "a").join(sets.toDF("b", "set_b"), "b")

    def verify(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            keep = []
            for x, y in zip(batch["set_a"], batch["set_b"], strict=True):
                p, q = np.frombuffer(x, "<u8"), np.frombuffer(y, "<u8")
                shared = len(np.intersect1d(p, q, assume_unique=True))
                keep.append(100 * shared >= percent * (len(p) + len(q) - shared))
            yield batch.loc[keep, ["a", "b"]]

    return written(both.mapInPandas(verify, "a long, b long"), "edges")


def components(edges: DataFrame, rounds: int = 60) -> DataFrame:
    """(node, component) with the smallest node of each component, for nodes with an edge.

    Alternating star contraction: every node's larger neighbours, then its smaller ones, are hung on
    the smallest node it sees, until nothing changes. Each step is written to the shared folder. Its joins meet by
    shuffles at any size: broadcasts of small steps would pile up in the driver's memory, two a round.
    """
    current = written(edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u <> v").distinct(), "stars")

    def state(df: DataFrame) -> tuple:
        row = df.agg(F.count(F.lit(1)).alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("h")).first()
        return (row["n"], row["h"])

    before = state(current)
    if not before[0]:
        return current.toDF("node", "component")
    for _ in range(rounds):
        both = current.union(current.select("v", "u"))
        least = both.groupBy(F.col("u").alias("w")).agg(F.least(F.min("v"), F.min("u")).alias("m"))
        large = both.join(least.hint("merge"), F.col("u") == F.col("w")).where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        large = large.where("u <> v").distinct()
        least = large.groupBy(F.col("u").alias("w")).agg(F.min("v").alias("m"))
        hung = large.join(least.hint("merge"), F.col("u") == F.col("w"))
        small = hung.where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        small = small.union(least.select(F.col("w").alias("u"), F.col("m").alias("v")))
        current = written(small.where("u <> v").distinct(), "stars")
        after = state(current)
        if after == before:
            return current.toDF("node", "component")
        before = after
    raise RuntimeError("star contraction did not settle")


def near_duplicates(docs: DataFrame, size: int = 5, percent: int = 80) -> DataFrame:
    """doc_id, n_shingles, component_id for every row.

    Two documents link when 100 x shared >= percent x union of their sets of word shingles. The
    component is the smallest doc_id reachable by links. Null or empty texts have no shingles and
    no links; rows that share a number are one document to the links, each with its own
    n_shingles; a row without a number has no component. Columns other than doc_id and text are left out.
    """
    rows = docs.select("doc_id", "text")
    sketch = written(sketches(rows, size, percent), "sketch")
    linked = sketch.where((F.col("n") > 0) & F.col("doc_id").isNotNull())
    classes = written(linked.groupBy("high", "low", "n").agg(F.min("doc_id").alias("rep")), "classes")
    same = classes.withColumnsRenamed({"high": "__h", "low": "__l", "n": "__n"})
    on = (F.col("doc_id") == F.col("rep")) & (F.col("high") == F.col("__h")) & (F.col("low") == F.col("__l"))
    reps = linked.join(same, on).select("doc_id", "n", "prefix", "vector").dropDuplicates(["doc_id", "n", "vector"])
    cells = written(_cells(reps, percent), "cells")
    pairs = bounded(_hub_pairs(cells, percent), sketch, percent)
    sets = sets_of(rows, pairs.select(F.explode(F.array("a", "b")).alias("doc_id")), size)
    edges = verified(pairs, sets, percent)
    left = _open_cells(cells.drop("hub"), components(edges))
    if not left.isEmpty():
        vectors = reps.select("doc_id", "vector")
        known = sets.select("doc_id").distinct()
        sets = sets.union(sets_of(rows, left.select("doc_id").distinct().join(known, "doc_id", "left_anti"), size))
        drawn = _large_pairs(_drawn_cells(left).join(vectors, "doc_id"), percent, every=False)
        drawn = bounded(drawn.join(pairs, ["a", "b"], "left_anti"), sketch, percent)
        pairs, edges = pairs.union(drawn), edges.union(verified(drawn, sets, percent))
        left = _open_cells(left, components(edges))
        large = left.where(F.col("m") > SMALL_CELL).join(vectors, "doc_id")
        rest = _small_pairs(left, percent).union(_large_pairs(large, percent, every=True)).distinct()
        rest = bounded(rest.join(pairs, ["a", "b"], "left_anti"), sketch, percent)
        edges = edges.union(verified(rest, sets, percent))
    # A class hangs on its representative, and representatives hang together by links.
    hung = linked.join(classes, ["high", "low", "n"]).select(F.col("doc_id").alias("a"), F.col("rep").alias("b"))
    found = components(edges.select("a", "b").union(hung))
    joined = sketch.join(found, F.col("doc_id") == F.col("node"), "left")
    return joined.select("doc_id", F.col("n").alias("n_shingles"), F.coalesce("component", "doc_id").alias("component_id"))


def one_of_each(docs: DataFrame, size: int = 5, percent: int = 80) -> DataFrame:
    """The rows of ``docs`` whose doc_id is the smallest of its near-duplicate group.

    Rows without a number stay. Of rows that share a number, those with equal texts are one row; those
    with different texts all stay, as none of them is known to be the other's copy.
    """
    kept = near_duplicates(docs, size, percent).where(F.col("doc_id") == F.col("component_id"))
    chosen = kept.select(F.col("doc_id").alias("__kept")).distinct()
    numbered = docs.join(chosen, F.col("doc_id") == F.col("__kept"), "left_semi").dropDuplicates(["doc_id", "text"])
    return numbered.unionByName(docs.where(F.col("doc_id").isNull()))


# The same rows as near_duplicates(size=4, percent=85) in SQL over the given table: all sets joined by
# shingle, and reachability by recursion.
SQL = r"""
with recursive words as (
  select doc_id, list_filter(regexp_split_to_array(
    translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[\x20\x09-\x0D]+'), lambda x: x <> '') as w
  from documents
), shingle as (
  select doc_id, unnest(case when len(w) = 0 then [] when len(w) < 4 then [array_to_string(w, ' ')]
    else list_distinct(list_transform(range(1, len(w) - 2), lambda i: array_to_string(w[i:i + 3], ' '))) end) as g
  from words
), size as (
  select doc_id, count(*) as n from shingle group by doc_id
), link as (
  select x, y from (
    select a.doc_id as x, b.doc_id as y, count(*) as shared
    from shingle a join shingle b on a.g = b.g and a.doc_id < b.doc_id group by all
  ) p join size m on m.doc_id = x join size n on n.doc_id = y
  where 100 * shared >= 85 * (m.n + n.n - shared)
), edge as (
  select x as u, y as v from link union all select y, x from link
), reach as (
  select doc_id as d, doc_id as c from documents
  union select e.v, r.c from reach r join edge e on e.u = r.d
)
select r.d as doc_id, coalesce(max(s.n), 0)::bigint as n_shingles, min(r.c) as component_id
from reach r left join size s on s.doc_id = r.d group by r.d
"""
