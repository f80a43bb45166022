"""Term vectors and the similarity filter against a clean reference set."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from rulewell.functions.stopwords import ENGLISH
from rulewell.functions.text import NON_WORD, words
from rulewell.operators.nearest import DIGITS, nearest
from rulewell.operators.parallel import spread
from rulewell.operators.sampling import n_largest
from rulewell.operators.scoring import embed_texts
from rulewell.operators.sparse_join import best_above
from rulewell.session import written


def _terms(text: str, stop_words: Sequence[str]) -> Column:
    if not stop_words:
        return words(text)
    pieces = F.split(F.lower(F.col(text)), NON_WORD)
    return F.filter(pieces, lambda w: (F.length(w) >= 2) & ~w.isin(*stop_words))


# Terms a task keeps in its summary, as a multiple of the terms wanted, and candidates that are counted exactly.
SUMMARY, CANDIDATE_LIMIT = 16, 1 << 18


# Rows of an Arrow batch whose tokens are held as arrays at a time.
PIECE_ROWS = 512


def _pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for at in range(0, batch.num_rows, PIECE_ROWS):
            yield batch.slice(at, PIECE_ROWS)


def _flat(tokens: pa.Array) -> tuple[np.ndarray, pa.Array]:
    """(row, token) of a list column; null lists have none."""
    sizes = pc.fill_null(pc.list_value_length(tokens), 0).to_numpy(zero_copy_only=False)
    return np.repeat(np.arange(len(tokens)), sizes), tokens.flatten()


def term_summaries(tokens: DataFrame, kept: int) -> DataFrame:
    """(term, least) rows of one summary a task, and one row without a term whose ``least`` is the task's error.

    Misra-Gries counters: a task holds at most ``kept`` terms; when there are more, the count of the first one too many
    is taken off all, and what is left of none falls out. A term's count in the task is ``least`` or up to
    the error more, and at most the error if the task does not name it.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, error = pa.table({"term": pa.array([], pa.string()), "n": pa.array([], pa.int64())}), 0
        for batch in _pieces(batches):
            counts = _flat(batch.column(0))[1].value_counts()
            new = pa.table({"term": counts.field("values").cast(pa.string()), "n": counts.field("counts")})
            held = pa.concat_tables([held, new]).group_by("term").aggregate([("n", "sum")]).rename_columns(["term", "n"])
            if held.num_rows > kept:
                off = int(np.partition(held["n"].to_numpy(), held.num_rows - kept - 1)[held.num_rows - kept - 1])
                held = held.set_column(1, "n", pc.subtract(held["n"], off)).filter(pc.field("n") > 0)
                error += off
        out = pa.concat_tables([held, pa.table({"term": pa.array([None], pa.string()), "n": pa.array([error], pa.int64())})])
        yield from out.rename_columns(["term", "least"]).combine_chunks().to_batches()

    return tokens.mapInArrow(run, "term string, least long")


def frequent_terms(tokens: DataFrame, wanted: int) -> DataFrame:
    """(term, total, df) of a set of terms that surely holds the ``wanted`` most frequent ones, exactly counted.

    The first pass gives summaries; no term outside the candidates can reach the ``wanted``-th largest
    least count even with all errors added. The second pass counts the candidates. Only summaries are
    shuffled, not the distinct terms of the table. With more than CANDIDATE_LIMIT candidates all terms are counted.
    """
    spark = tokens.sparkSession
    found = written(term_summaries(tokens, SUMMARY * wanted).groupBy("term").agg(F.sum("least").alias("least")), "summaries")
    errors = found.filter(F.col("term").isNull()).first()
    error = errors["least"] if errors else 0
    terms = found.filter(F.col("term").isNotNull())
    last = terms.select("least").orderBy(F.desc("least")).limit(wanted).agg(F.min("least"), F.count(F.lit(1))).first()
    floor = last[0] - error if last[1] == wanted else 0
    chosen = terms.filter(F.col("least") >= floor).select("term")
    # Without errors the summaries name all terms; with them a term that no summary names may count up to the error.
    if (error and floor <= 0) or chosen.count() > CANDIDATE_LIMIT:
        flagged = tokens.select(F.array_sort(F.col(tokens.columns[0])).alias("t"))
        first = F.transform("t", lambda w, i: F.struct(w.alias("term"), ((i == 0) | (w != F.get("t", i - 1))).alias("first")))
        exploded = flagged.select(F.explode(first).alias("x"))
        return exploded.groupBy(F.col("x.term").alias("term")).agg(F.count(F.lit(1)).alias("total"), F.count_if("x.first").alias("df"))
    shared = spark.sparkContext.broadcast(chosen.orderBy("term").limit(CANDIDATE_LIMIT).toArrow()["term"].combine_chunks())

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        listed = shared.value
        total, df = np.zeros(len(listed), np.int64), np.zeros(len(listed), np.int64)
        for batch in _pieces(batches):
            rows, flat = _flat(batch.column(0))
            place = pc.fill_null(pc.index_in(flat, value_set=listed.cast(flat.type)), -1).to_numpy(zero_copy_only=False)
            rows, place = rows[place >= 0], place[place >= 0].astype(np.int64)
            total += np.bincount(place, minlength=len(listed))
            df += np.bincount(np.unique(rows * len(listed) + place) % max(1, len(listed)), minlength=len(listed))
        yield pa.RecordBatch.from_arrays([listed, pa.array(total), pa.array(df)], names=["term", "total", "df"])

    return tokens.mapInArrow(count, "term string, total long, df long").groupBy("term").agg(F.sum("total").alias("total"), F.sum("df").alias("df"))


def fit_vocabulary(
    docs: DataFrame, text: str, max_features: int = 1000, stop_words: Sequence[str] = ENGLISH
) -> DataFrame:
    """(term, term_id, idf) of the most frequent terms, ties by term."""
    counts = frequent_terms(docs.select(_terms(text, stop_words).alias("t")), max_features)
    top = counts.filter("total > 0").orderBy(F.col("total").desc(), F.col("term")).limit(max_features)
    n = docs.agg(F.count(F.lit(1))).scalar()
    by_term = Window.partitionBy(F.lit(0)).orderBy("term")
    return top.select(
        "term",
        (F.row_number().over(by_term) - 1).alias("term_id"),
        (F.log((1 + n) / (1 + F.col("df"))) + 1.0).alias("idf"),
    )


def tfidf_vectors(
    docs: DataFrame, key: str, text: str, vocabulary: DataFrame, stop_words: Sequence[str] = ENGLISH
) -> DataFrame:
    """(key, vector STRUCT<indices, values>) of unit length, empty where no term matched.

    The vocabulary, bounded by its ``max_features``, goes to every task; a document's vector is made
    where its text is, and nothing is shuffled.
    """
    listed = vocabulary.orderBy("term_id").toArrow()
    terms, idf = listed["term"].combine_chunks(), listed["idf"].to_numpy()
    tokens = docs.select(key, _terms(text, stop_words).alias("t"))
    vector = T.StructType([T.StructField("indices", T.ArrayType(T.IntegerType())), T.StructField("values", T.ArrayType(T.DoubleType()))])

    def weigh(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in _pieces(batches):
            rows, flat = _flat(batch.column(1))
            place = pc.fill_null(pc.index_in(flat, value_set=terms.cast(flat.type)), -1).to_numpy(zero_copy_only=False)
            pair, tf = np.unique(rows[place >= 0] * max(1, len(terms)) + place[place >= 0], return_counts=True)
            row, term = pair // max(1, len(terms)), pair % max(1, len(terms))
            weight = tf * idf[term]
            length = np.sqrt(np.bincount(row, weight * weight, minlength=batch.num_rows))
            offsets = pa.array(np.searchsorted(row, np.arange(batch.num_rows + 1)).astype(np.int32))
            parts = [pa.array(term.astype(np.int32)), pa.array(weight / length[row])]
            made = pa.StructArray.from_arrays([pa.ListArray.from_arrays(offsets, p) for p in parts], names=["indices", "values"])
            yield pa.RecordBatch.from_arrays([batch.column(0), made], names=[key, "vector"])

    return tokens.mapInArrow(weigh, T.StructType([tokens.schema[key], T.StructField("vector", vector)]))


def best_match(
    rows: DataFrame, clean: DataFrame, key: str, clean_key: str, vector: str = "vector", **options
) -> DataFrame:
    """(key, clean_key, max_similarity): the closest clean row, first one on ties."""
    found = nearest(
        rows, clean, 1, query_id=key, query_vector=vector, corpus_id=clean_key, corpus_vector=vector, **options
    )
    return found.select(key, clean_key, F.col("similarity").alias("max_similarity"))


def tfidf_sides(
    rows: DataFrame, clean: DataFrame, key: str, text: str, clean_key: str, clean_text: str,
    max_features: int = 1000, stop_words: Sequence[str] = ENGLISH,
) -> tuple[DataFrame, DataFrame]:
    """(key, vector) and (clean_key, vector) by TF-IDF fitted on both sets together."""
    rows, clean = spread(rows), spread(clean)
    both = clean.select(F.col(clean_text).alias("__text")).unionByName(rows.select(F.col(text).alias("__text")))
    vocabulary = written(fit_vocabulary(both, "__text", max_features, stop_words), "vocabulary")
    left = tfidf_vectors(rows, key, text, vocabulary, stop_words)
    return left, tfidf_vectors(clean, clean_key, clean_text, vocabulary, stop_words)


def tfidf_matches(
    rows: DataFrame, clean: DataFrame, key: str, text: str, clean_key: str, clean_text: str, threshold: float = 0.3, **options
) -> DataFrame:
    """(key, clean_key, max_similarity): the best clean match of the rows whose best one reaches ``threshold``."""
    left, right = tfidf_sides(rows, clean, key, text, clean_key, clean_text, **options)
    return best_above(left, right, threshold, key, clean_key).withColumnRenamed("similarity", "max_similarity")


def tfidf_most_similar(
    rows: DataFrame, clean: DataFrame, n: int, key: str, text: str, clean_key: str, clean_text: str, threshold: float = 0.3, **options
) -> DataFrame:
    """(key, clean_key, max_similarity) of the ``n`` rows with the best clean matches, ties by key.

    Rows are looked for from ``threshold`` up; only if too few reach it, among all, where a row that shares
    no term with any clean row has similarity 0 to the first of them.
    """
    left, right = (written(side, "vectors") for side in tfidf_sides(rows, clean, key, text, clean_key, clean_text, **options))

    def above(least: float) -> DataFrame:
        return best_above(left, right, least, key, clean_key).withColumnRenamed("similarity", "max_similarity")

    top = n_largest(above(threshold), n, "max_similarity", key)
    if top.count() < n:
        first = right.agg(F.min(clean_key)).scalar()
        every = left.select(key).join(above(10.0**-DIGITS), key, "left")
        every = every.select(key, F.coalesce(clean_key, first).alias(clean_key), F.coalesce("max_similarity", F.lit(0.0)).alias("max_similarity"))
        top = n_largest(every.filter(F.col(clean_key).isNotNull()), n, "max_similarity", key)
    return top


def embedding_best_match(
    rows: DataFrame,
    clean: DataFrame,
    key: str,
    text: str,
    clean_key: str,
    clean_text: str,
    embedder: Callable[[], Callable[[list[str]], np.ndarray]],
) -> DataFrame:
    """Best clean match of every row by the cosine of embeddings; each text is embedded once."""
    left = spread(rows).select(key, embed_texts(text, embedder).alias("vector"))
    right = spread(clean).select(clean_key, embed_texts(clean_text, embedder).alias("vector"))
    return best_match(left, right, key, clean_key, sizes_from=(rows, clean))


def similar_to_clean(matches: DataFrame, threshold: float) -> DataFrame:
    """Rows whose best similarity reaches the threshold (0.7 for embeddings, 0.3 for term vectors)."""
    return matches.filter(F.col("max_similarity") >= threshold)
