"""License scan: an exact set-similarity join of text blocks with notice templates, in DataFrame
operations only.

A block matches a template when it contains at least ``threshold`` of the template's distinct words.
Blocks are the lines of a text, and for notices wrapped over lines all runs of up to |words of the
template| / ``threshold`` words of the whole text, whatever breaks and comment signs stand between
them. A block must also hold the template's own word (OWN_WORDS), if it has one. The join is exact and prefix-filtered:

* the words of all templates are ordered by the number of documents that have them, over the whole
  table, rarest first;
* a template's prefix is its first |T| - need + 1 words in that order, where ``need`` words must be
  shared: a block without any of them cannot match, and only blocks with one are joined, by that word;
* length filter: a block with fewer than ``need`` distinct words cannot match;
* positional filter: when the first shared prefix word stands at place p of the template's order, at
  most |T| - p words can be shared;
* what is left is verified by the true intersection. For runs the filters apply to the text as a
  whole, which holds all words of its runs; then each run that starts at a word of the template and
  has as many of its words as are needed is compared.

The templates are a fixed list, so their side of the join is a few dozen rows whatever the input.
"""

from __future__ import annotations

from functools import reduce
from math import ceil

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rulewell.llm.common import lower_ascii

# The phrases of the base rule and their labels.
PHRASES = {
    "gnu general public license": "gpl",
    "apache license": "apache",
    "cc by": "cc-by",
    "mit license": "mit",
}

# Short public license notices, by the label the join gives.
TEMPLATES = {
    "gpl-3.0-notice": "this work is licensed under the gnu general public license version 3",
    "gpl-notice": "this program is free software you can redistribute it and or modify it under the terms of the "
    "gnu general public license as published by the free software foundation",
    "apache-2.0-notice": "licensed under the apache license version 2 0",
    "cc-by-nc-4.0-notice": "licensed under cc by nc 4 0",
    "cc-by-4.0-notice": "this work is licensed under a creative commons attribution 4 0 international license",
    "mit-notice": "released under the mit license",
    "mit-permission": "permission is hereby granted free of charge to any person obtaining a copy of this software "
    "and associated documentation files",
    "bsd-notice": "redistribution and use in source and binary forms with or without modification are permitted "
    "provided that the following conditions are met",
    "mpl-2.0-notice": "this source code form is subject to the terms of the mozilla public license v 2 0",
}
# The word that tells a template from its neighbours ("released under the bsd license").
OWN_WORDS = {
    "gpl-3.0-notice": "gnu",
    "gpl-notice": "gnu",
    "apache-2.0-notice": "apache",
    "cc-by-nc-4.0-notice": "nc",
    "cc-by-4.0-notice": "commons",
    "mit-notice": "mit",
    "mpl-2.0-notice": "mozilla",
}
THRESHOLD = 0.8
SEPARATORS = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"


def spaced_words(text: Column) -> Column:
    """The words of a text, each with one space before it, and one space at the end (words only)."""
    plain = F.regexp_replace(lower_ascii(F.coalesce(text, F.lit(""))), SEPARATORS, " ")
    return F.concat(F.lit(" "), F.btrim(plain), F.lit(" "))


def _spaces(text: Column) -> Column:
    return (F.length(text) - F.length(F.replace(text, F.lit(" "), F.lit("")))).cast("long")


def _base(docs: DataFrame) -> DataFrame:
    """doc_id, __text and the columns of the base rule; one pass over the text, no shuffle."""
    spaced = docs.select("doc_id", F.xxhash64("text").alias("__text"), spaced_words(F.col("text")).alias("s"))
    n_words = F.when(F.length("s") <= 2, F.lit(0).cast("long")).otherwise(_spaces(F.col("s")) - 1)
    counted = spaced.withColumn("n_words", n_words)
    places, firsts, lasts, labels = [], [], [], []
    for phrase, label in PHRASES.items():
        present = F.contains("s", F.lit(f" {phrase} "))
        around = F.split("s", f" {phrase}(?= )", -1)
        places.append(F.when(present, (F.size(around) - 1).cast("long")).otherwise(F.lit(0).cast("long")))
        firsts.append(F.when(present, _spaces(F.element_at(around, 1))))
        after = _spaces(F.element_at(around, -1)) - 1
        lasts.append(F.when(present, F.col("n_words") - after - len(phrase.split())))
        labels.append(F.when(present, F.lit(label)))
    return counted.select(
        "doc_id",
        "__text",
        "n_words",
        reduce(lambda a, b: a + b, places).alias("n_base"),
        F.least(*firsts).alias("first_word"),
        F.greatest(*lasts).alias("last_word"),
        F.sort_array(F.array_compact(F.array(*labels))).alias("__base"),
    )


def _vocabulary(templates: dict[str, str]) -> list[str]:
    return sorted({w for text in templates.values() for w in text.split()})


def word_order(docs: DataFrame, templates: dict[str, str]) -> list[str]:
    """The templates' words, rarest first by documents over the whole table; ties by the word.

    At most one row per template word is counted up and reaches the driver.
    """
    words = F.array_distinct(F.split(spaced_words(F.col("text")), " "))
    known = F.array(*map(F.lit, _vocabulary(templates)))
    found = docs.select(F.explode(F.array_intersect(words, known)).alias("w"))
    counts = {r["w"]: r["n"] for r in found.groupBy("w").agg(F.count(F.lit(1)).alias("n")).collect()}
    return sorted(_vocabulary(templates), key=lambda w: (counts.get(w, 0), w))


def prefix_side(docs: DataFrame, templates: dict[str, str], threshold: float) -> tuple[list[str], DataFrame]:
    """The prefix words, and one row per template and prefix word with what the filters need."""
    place = {w: i for i, w in enumerate(word_order(docs, templates))}
    prefixes, rows = set(), []
    for label, text in templates.items():
        words = sorted(set(text.split()), key=place.__getitem__)
        need = max(1, ceil(threshold * len(words) - 1e-9))
        span, own = ceil(len(text.split()) / threshold - 1e-9), OWN_WORDS.get(label)
        for p, word in enumerate(words[: len(words) - need + 1]):
            prefixes.add(word)
            rows.append((word, label, p, need, words, span, own))
    schema = "w string, template string, p int, need int, words array<string>, span int, own string"
    # As long as the fixed list of templates.
    return sorted(prefixes), docs.sparkSession.createDataFrame(rows, schema)


def _candidates(blocks: DataFrame, prefixes: list[str], side: DataFrame) -> DataFrame:
    """Blocks of ``tokens`` with each template of which they hold the needed words; ``shared`` has those."""
    hits = F.array_intersect(F.array(*map(F.lit, prefixes)), "tokens")
    candidates = blocks.select("*", F.explode(hits).alias("w")).join(F.broadcast(side), "w")
    shared = F.array_intersect("words", "tokens")  # in the template's order
    kept = candidates.where(
        (F.size("tokens") >= F.col("need"))
        & (F.size("words") - F.col("p") >= F.col("need"))
        & (F.element_at(shared, 1) == F.col("w"))
        & (F.size(shared) >= F.col("need"))
        & (F.col("own").isNull() | F.array_contains("tokens", F.col("own")))
    )
    return kept.withColumn("shared", shared)


def matches(
    docs: DataFrame,
    templates: dict[str, str] | None = None,
    threshold: float = THRESHOLD,
    joined: tuple[list[str], DataFrame] | None = None,
) -> DataFrame:
    """Every (doc_id, __text, pos, template, containment) of a line that meets the threshold.

    Null texts have no lines. Repeated rows give repeated matches. ``joined`` is prefix_side(), where
    it is known already.
    """
    joined = joined or prefix_side(docs, TEMPLATES if templates is None else templates, threshold)
    lines = docs.select("doc_id", F.xxhash64("text").alias("__text"), F.posexplode(F.split("text", "\n", -1)).alias("pos", "line"))
    tokens = F.array_distinct(F.split(F.btrim(spaced_words(F.col("line"))), " "))
    kept = _candidates(lines.select("doc_id", "__text", "pos", tokens.alias("tokens")), *joined)
    return kept.select("doc_id", "__text", "pos", "template", (F.size("shared") / F.size("words")).alias("containment"))


def run_matches(
    docs: DataFrame,
    templates: dict[str, str] | None = None,
    threshold: float = THRESHOLD,
    joined: tuple[list[str], DataFrame] | None = None,
) -> DataFrame:
    """(doc_id, __text, template, containment) of each text with a run of words that meets the threshold.

    The containment is that of the text's best run. Arguments and repeated rows as in matches().
    """
    joined = joined or prefix_side(docs, TEMPLATES if templates is None else templates, threshold)
    texts = docs.select("doc_id", F.xxhash64("text").alias("__text"), spaced_words(F.col("text")).alias("s"))
    kept = _candidates(texts.select("doc_id", "__text", F.split(F.btrim("s"), " ").alias("tokens")), *joined)
    places = F.array_compact(F.transform("tokens", lambda w, i: F.when(F.array_contains(F.col("words"), w), i)))
    placed = kept.select("doc_id", "__text", "template", "tokens", "words", "need", "span", "own", places.alias("at"))
    # A run with ``need`` words of the template has as many places inside its span.
    n = F.greatest(F.size("at") - F.col("need") + 1, F.lit(0))
    near = F.zip_with(
        F.slice("at", 1, n), F.slice("at", F.col("need"), n), lambda a, b: F.when(b - a < F.col("span"), a)
    )

    def best(start: Column) -> Column:
        run = F.slice("tokens", start + 1, F.col("span"))
        own = F.col("own").isNull() | F.array_contains(run, F.col("own"))
        return F.when(own, F.size(F.array_intersect("words", run))).otherwise(0)

    starts = placed.withColumn("starts", F.array_compact(near)).where(F.size("starts") > 0)
    found = starts.select("*", F.array_max(F.transform("starts", best)).alias("n")).where(F.col("n") >= F.col("need"))
    return found.select("doc_id", "__text", "template", (F.col("n") / F.size("words")).alias("containment"))


def scan(docs: DataFrame) -> DataFrame:
    """doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score per document.

    Null and empty texts have no words, no labels and the score 0. The score is 1 where a phrase of
    the base rule stands, else the largest containment of a template in a line or run that meets the
    threshold, else 0. Rows are told apart by number and text, so repeated rows get equal results.
    """
    rows = docs.select("doc_id", "text")
    joined = prefix_side(rows, TEMPLATES, THRESHOLD)
    both = matches(rows, joined=joined).drop("pos").unionByName(run_matches(rows, joined=joined))
    found = both.groupBy(F.col("doc_id").alias("__d"), F.col("__text").alias("__t")).agg(
        F.collect_set("template").alias("__found"), F.max("containment").alias("__contained")
    )
    on = F.col("doc_id").eqNullSafe(F.col("__d")) & (F.col("__text") == F.col("__t"))
    empty = F.array().cast("array<string>")
    return _base(rows).join(found, on, "left").select(
        "doc_id",
        "n_words",
        "n_base",
        "first_word",
        "last_word",
        F.array_join("__base", ",").alias("base_labels"),
        F.array_join(F.sort_array(F.array_union("__base", F.coalesce("__found", empty))), ",").alias("labels"),
        F.when(F.col("n_base") > 0, 1.0).otherwise(F.coalesce("__contained", F.lit(0.0))).alias("score"),
    )


def twin() -> str:
    """The same rows in SQL over the given table: every line and every run of words against every template."""
    lower = "translate(coalesce({}, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
    words = "list_filter(regexp_split_to_array({}, '[\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+'), lambda x: x <> '')"
    templates = ", ".join(
        f"('{k}', {sorted(set(v.split()))}, '{OWN_WORDS.get(k, '')}', {ceil(len(v.split()) / THRESHOLD - 1e-9)})" for k, v in TEMPLATES.items()
    )
    phrases = ", ".join(f"('{p}', '{label}', {len(p.split())})" for p, label in PHRASES.items())
    return rf"""
with doc as (
  select doc_id, text, {words.format(lower.format("text"))} as w from documents
), phrase(phrase, label, n) as (values {phrases}), place as (
  select d.doc_id, p.label, i as spot
  from doc d, phrase p, unnest(range(0, len(d.w)::bigint)) as t(i)
  where contains(lower(coalesce(d.text, '')), split_part(p.phrase, ' ', 1))
    and array_to_string(d.w[i + 1 : i + p.n], ' ') = p.phrase
), base as (
  select doc_id, count(*) as n_base, min(spot) as first_word, max(spot) as last_word,
         list(distinct label) as found from place group by doc_id
), template(template, tw, own, span) as (values {templates}), line as (
  select doc_id, unnest(string_split(text, chr(10))) as line from documents
), block as (
  select doc_id, list_distinct({words.format(lower.format("line"))}) as b from line
), long as (
  select doc_id, w, template, tw, own, span from doc, template
  where len(list_intersect(list_distinct(w), tw)) >= ceil({THRESHOLD} * len(tw) - 1e-9)
), run as (
  select doc_id, template, tw, own, list_distinct(w[i : i + span - 1]) as b
  from (select *, unnest(range(1, len(w) + 1)) as i from long) p where list_contains(tw, w[i])
), hit as (
  select doc_id, list(distinct template) as found, max(len(list_intersect(b, tw)) / len(tw)) as contained
  from (select doc_id, template, tw, own, b from block, template union all select * from run) q
  where len(list_intersect(b, tw)) >= ceil({THRESHOLD} * len(tw) - 1e-9) and (own = '' or list_contains(b, own))
  group by doc_id
)
select d.doc_id, len(d.w)::bigint as n_words, coalesce(b.n_base, 0)::bigint as n_base,
       b.first_word, b.last_word,
       coalesce(array_to_string(list_sort(b.found), ','), '') as base_labels,
       coalesce(array_to_string(list_sort(list_distinct(list_concat(b.found, h.found))), ','), '') as labels,
       case when b.n_base > 0 then 1.0 else coalesce(h.contained, 0.0) end::double as score
from doc d left join base b using (doc_id) left join hit h using (doc_id)
"""
