"""Quality rules by distribution divergence, in DataFrame operations only.

A document's character classes and common words are counted into two histograms. The references are
the same histograms summed over the whole table per language (a handful of rows). A document is as
far from a reference as the Jensen-Shannon distance of the histograms (0 to 1, base 2) says; its
distance is that to the nearest reference. Texts with fewer characters or words than a histogram
needs to be telling are not judged by it.

The bound on the word distance comes from the table. By chance alone a text of n words lies about
1 / sqrt(n) away, so the spread is the median of distance times sqrt(n) over the well-formed documents.
A text passes within WORD_SPREADS of it, or within NO_COMMON_SHARE of the distance that a text without
a single common word has; with more than about (WORD_SPREADS * spread / that distance) ** 2 words such
a text fails.
"""

from __future__ import annotations

from functools import reduce
from math import log2, sqrt

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rulewell.llm.common import split_words
from rulewell.session import written

# Frequent function words by language; a word of two languages is one histogram bin.
COMMON_WORDS = {
    "de": "der die und das ist".split(),
    "en": "the of and to in".split(),
    "es": "de la que el en".split(),
    "fr": "de la et le les".split(),
}
VOCABULARY = sorted({w for words in COMMON_WORDS.values() for w in words})
OTHER = "other"
# Largest distances to the nearest reference that still pass, and the sizes from which they count.
MAX_CLASS_DISTANCE, MIN_CHARS = 0.2, 200
MAX_WORD_DISTANCE, MIN_WORDS = 0.35, 50
# The table's own bound on word distances: spreads of chance, and share of the distance without common words.
WORD_SPREADS, NO_COMMON_SHARE = 2.2, 0.85
# Fixed values of the base rule: least words, and the share of repeated words in percent.
LEAST_WORDS, MAX_REPEATED = 50, 50


def _without(text: Column, pattern: str) -> Column:
    return F.length(F.regexp_replace(text, pattern, ""))


def _sized(rows: DataFrame) -> DataFrame:
    """Add n_words, n_chars, word_chars and n_symbols to rows of text and words."""
    return rows.select(
        "*",
        F.size("words").cast("long").alias("n_words"),
        F.length("text").cast("long").alias("n_chars"),
        F.length(F.array_join("words", "")).cast("long").alias("word_chars"),
        (F.length("text") - _without(F.col("text"), r"[#*$%&|<>]+")).cast("long").alias("n_symbols"),
    )


def base_counts(docs: DataFrame) -> DataFrame:
    """doc_id, lang, text and words with the base counts; everything stays inside the row."""
    text = F.coalesce(F.col("text"), F.lit(""))
    rows = docs.select("doc_id", "lang", text.alias("text"), split_words(F.col("text")).alias("words"))
    lines = F.filter(F.split("text", "\n", -1), lambda x: F.regexp_like(x, F.lit(r"[^\x20\x09-\x0D]")))
    counted = _sized(rows).select("*", lines.alias("lines"), F.transform("words", lambda w: F.xxhash64(w)).alias("h"))
    n = F.col("n_words").cast("int") - 2
    pair = F.zip_with(F.slice("h", 1, n), F.slice("h", 2, n), lambda a, b: F.xxhash64(a, b))
    window = F.zip_with(pair, F.slice("h", 3, n), lambda a, b: F.xxhash64(a, b))
    windows = F.when(F.col("n_words") >= 3, window).otherwise(F.array().cast("array<long>"))
    return counted.select(
        "*",
        (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long").alias("n_dup_lines"),
        windows.alias("windows"),
    ).drop("lines", "h")


def measured(docs: DataFrame) -> DataFrame:
    """base_counts with n_repeat_words; only texts with a repeated window are sorted.

    Windows are sorted by hash; equal neighbours give the places of the windows that occur twice or
    more; each place covers three words, or as many as there are up to the next place.
    """
    counted = base_counts(docs)
    repeats = F.size(F.array_distinct("windows")) < F.size("windows")
    placed = F.sort_array(F.transform("windows", lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
    none = F.array().cast("array<int>")
    held = counted.withColumn("placed", F.when(repeats, placed)).drop("windows")
    m = F.size("placed") - 1
    twins = F.zip_with(
        F.slice("placed", 1, m), F.slice("placed", 2, m), lambda a, b: F.when(a.h == b.h, F.array(a.i, b.i))
    )
    places = F.sort_array(F.array_distinct(F.flatten(F.array_compact(twins))))
    found = held.withColumn("places", F.when(F.col("placed").isNull(), none).otherwise(places)).drop("placed")
    gaps = F.zip_with(
        F.slice("places", 1, F.size("places") - 1),
        F.slice("places", 2, F.size("places") - 1),
        lambda a, b: F.least(b - a, F.lit(3)),
    )
    covered = F.aggregate(gaps, F.lit(3), lambda total, gap: total + gap)
    n = F.when(F.size("places") == 0, F.lit(0)).otherwise(covered)
    return found.withColumn("n_repeat_words", n.cast("long")).drop("places")


def _histograms(rows: DataFrame) -> DataFrame:
    """Add ``classes`` (white space, symbols, upper case, digits, punctuation, the rest) and
    ``common`` (each common word, all other words), both arrays of counts."""
    n = F.col("n_chars")
    upper = n - _without(F.col("text"), "[A-Z]+")
    digit = n - _without(F.col("text"), "[0-9]+")
    stop = n - _without(F.col("text"), r"[.,;:!?'\"()-]+")
    counts = rows.select("*", upper.alias("__upper"), digit.alias("__digit"), stop.alias("__stop"))
    bins = [n - F.col("word_chars"), F.col("n_symbols"), F.col("__upper"), F.col("__digit"), F.col("__stop")]
    rest = reduce(lambda a, b: a - b, bins, n)
    known = F.filter("words", lambda w: w.isin(VOCABULARY))
    place = F.transform(known, lambda w: F.array_position(F.array(*map(F.lit, VOCABULARY)), w).cast("int"))
    counts = counts.select(
        "*", F.transform(F.array(*bins, rest), lambda x: x.cast("double")).alias("classes"), place.alias("__place")
    )

    def count_of(k: int) -> Column:
        return F.size(F.filter("__place", lambda p: p == k + 1))

    common = [count_of(k) for k in range(len(VOCABULARY))]
    others = F.col("n_words") - F.size("__place")
    counted = F.transform(F.array(*[c.cast("long") for c in common], others), lambda x: x.cast("double"))
    return counts.withColumn("common", counted).drop("__place", "__upper", "__digit", "__stop")


def well_formed() -> Column:
    """Long enough for both histograms and not full of symbols."""
    fit = (F.col("n_words") >= MIN_WORDS) & (F.col("n_chars") >= MIN_CHARS)
    return fit & (100 * F.col("n_symbols") <= F.col("n_chars"))


def references(measures: DataFrame) -> dict[str, dict[str, list[float]]]:
    """Histogram shares per language over the well-formed documents of the whole table; one row per
    language of COMMON_WORDS, and one for all others, reaches the driver."""
    language = F.when(F.col("lang").isin(list(COMMON_WORDS)), F.col("lang")).otherwise(F.lit(OTHER))
    sizes = {"classes": 6, "common": len(VOCABULARY) + 1}
    sums = [F.sum(F.get(name, F.lit(k))).alias(f"{name}_{k}") for name, size in sizes.items() for k in range(size)]
    found: dict[str, dict[str, list[float]]] = {name: {} for name in sizes}
    for row in measures.where(well_formed()).groupBy(language.alias("lang")).agg(*sums).collect():
        for name, size in sizes.items():
            counts = [row[f"{name}_{k}"] or 0.0 for k in range(size)]
            if sum(counts) > 0:
                found[name][row["lang"]] = [c / sum(counts) for c in counts]
    return found


def distance(counts: Column, total: Column, reference: list[float]) -> Column:
    """Jensen-Shannon distance (base 2) of a histogram of counts to reference shares."""

    def part(x: Column, m: Column) -> Column:
        return F.when(x > 0, x * F.log2(x / m)).otherwise(0.0)

    def both(count: Column, p: Column) -> Column:
        q = count / total
        return part(q, (p + q) / 2) + part(p, (p + q) / 2)

    terms = F.zip_with(counts, F.array(*map(F.lit, reference)), both)
    return F.sqrt(F.greatest(F.lit(0.0), F.aggregate(terms, F.lit(0.0), lambda a, x: a + x) / 2))


def word_spread(measures: DataFrame) -> float:
    """Median of word_distance times sqrt(n_words) over the well-formed documents of the whole table.

    Counted in hundredths up to 100, so at most 10,001 rows reach the driver.
    """
    scaled = F.round(F.least(F.col("word_distance") * F.sqrt("n_words"), F.lit(100.0)), 2)
    counts = measures.where(well_formed()).groupBy(scaled.alias("x")).agg(F.count(F.lit(1)).alias("n")).collect()
    left = sum(r["n"] for r in counts) / 2
    for row in sorted(counts, key=lambda r: r["x"]):
        left -= row["n"]
        if left <= 0:
            return row["x"]
    return 0.0


def no_common_distance(found: dict[str, list[float]]) -> float:
    """Distance to the nearest reference of a text whose words are all other words."""

    def one(p: list[float]) -> float:
        q = p[-1]
        return sqrt(max(0.0, (sum(p[:-1]) + log2(2 / (1 + q)) + (q * log2(2 * q / (1 + q)) if q > 0 else 0.0)) / 2))

    return min(map(one, found.values()), default=0.0)


def word_bound(measures: DataFrame, found: dict[str, list[float]]) -> Column:
    """Largest word distance that passes; where no reference has common words the distance says nothing."""
    without = no_common_distance(found)
    if without == 0.0:
        return F.lit(MAX_WORD_DISTANCE)
    by_chance = F.lit(WORD_SPREADS * word_spread(measures)) / F.sqrt("n_words")
    return F.least(F.lit(MAX_WORD_DISTANCE), F.greatest(F.lit(NO_COMMON_SHARE * without), by_chance))


def judged(docs: DataFrame) -> DataFrame:
    """All measures per document: the base counts, both distances, base_failed and kept.

    Null and empty texts have no words and fail the base rule. A distance is 0 below the minimum
    length, or while there is no reference. Repeated rows are judged alike; other columns are left out.
    """
    # The text is read once: its measures, a few hundred bytes a document, are written and read again.
    rows = written(_histograms(measured(docs)).drop("text", "words"), "measures")
    found = references(rows)

    def nearest(counts: str, total: Column, enough: Column) -> Column:
        known = [distance(F.col(counts), total, r) for _, r in sorted(found[counts].items())]
        least = F.array_min(F.array(*known)) if known else F.lit(0.0)
        return F.when(enough, least).otherwise(0.0)

    n = F.col("n_words")
    apart = rows.select(
        "*",
        nearest("classes", F.col("n_chars"), F.col("n_chars") >= MIN_CHARS).alias("class_distance"),
        nearest("common", n, n >= MIN_WORDS).alias("word_distance"),
        ((n < LEAST_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEATED * n)).alias("base_failed"),
    )
    near = (n < MIN_WORDS) | (F.col("word_distance") <= word_bound(apart, found["common"]))
    passes = (F.col("class_distance") <= MAX_CLASS_DISTANCE) & near
    return apart.select(
        "doc_id",
        "n_words",
        "word_chars",
        "n_symbols",
        "n_dup_lines",
        "n_repeat_words",
        "base_failed",
        (~F.col("base_failed") & passes).alias("kept"),
        "class_distance",
        "word_distance",
    )
