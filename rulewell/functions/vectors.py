"""Vector expressions over ARRAY columns. Arithmetic is in DOUBLE."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from rulewell.functions.text import column, words


def dot(a: Column | str, b: Column | str) -> Column:
    products = F.zip_with(column(a), column(b), lambda x, y: x.cast("double") * y.cast("double"))
    return F.aggregate(products, F.lit(0.0), lambda acc, x: acc + x)


def norm(v: Column | str) -> Column:
    return F.sqrt(F.aggregate(column(v), F.lit(0.0), lambda acc, x: acc + x.cast("double") * x.cast("double")))


def _divide(v: Column, scale: Column) -> Column:
    # Zipping with a repeated array evaluates the divisor once per row; inside a transform it
    # would be evaluated once per element.
    return F.zip_with(v, F.array_repeat(scale, F.size(v)), lambda x, s: x.cast("double") / s)


def hashed_words(text: Column | str, dims: int = 64) -> Column:
    """Sparse unit vector STRUCT<indices, values> of word counts hashed into ``dims`` slots.

    The stand-in for a neural embedder as column functions: slots are sorted inside the row and their
    runs counted. One-element arrays bind a list once for all its uses.
    """

    def slot(word: Column) -> Column:
        return (F.conv(F.substring(F.md5(word.cast("binary")), 1, 4), 16, 10).cast("int") % dims).cast("int")

    def bound(values: Column, use: Callable[[Column], Column]) -> Column:
        return F.get(F.transform(F.array(values), use), F.lit(0))

    def runs(t: Column) -> Column:
        first = F.transform(t, lambda x, i: F.when((i == 0) | (x != F.get(t, i - 1)), i))

        def counted(s: Column) -> Column:
            return F.transform(
                s, lambda at, i: F.struct(F.get(t, at).alias("slot"), (F.coalesce(F.get(s, i + 1), F.size(t)) - at).alias("n"))
            )

        return bound(F.array_compact(first), counted)

    def unit(pairs: Column) -> Column:
        length = F.sqrt(F.aggregate(pairs, F.lit(0.0), lambda total, x: total + x["n"] * x["n"]))
        values = bound(length, lambda d: F.transform(pairs, lambda x: x["n"] / d))
        return F.struct(F.transform(pairs, lambda x: x["slot"]).alias("indices"), values.alias("values"))

    slots = F.array_sort(F.transform(words(F.coalesce(column(text), F.lit(""))), slot))
    return bound(bound(slots, runs), unit)


def l2_normalize(v: Column | str) -> Column:
    """Unit length; an all-zero vector stays as it is."""
    length = norm(v)
    return _divide(column(v), F.when(length == 0, F.lit(1.0)).otherwise(length))


def truncate_renorm(v: Column | str, dims: int) -> Column:
    """First ``dims`` coordinates, renormalised; vectors already that short only get normalised."""
    return l2_normalize(F.slice(column(v), 1, dims))


def cosine(a: Column | str, b: Column | str) -> Column:
    """Cosine similarity; 0 when either side has no length."""
    return F.coalesce(F.try_divide(dot(a, b), norm(a) * norm(b)), F.lit(0.0))


def softmax(logits: Column | str) -> Column:
    logits = column(logits)
    tops = F.array_repeat(F.array_max(logits), F.size(logits))
    exps = F.zip_with(logits, tops, lambda x, top: F.exp(x - top))
    return _divide(exps, F.aggregate(exps, F.lit(0.0), lambda acc, x: acc + x))


def argmax(v: Column | str) -> Column:
    """Zero-based position of the largest value, first on ties."""
    return (F.array_position(column(v), F.array_max(column(v))) - 1).cast("int")
