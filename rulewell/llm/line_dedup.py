"""Line deduplication that returns keep bitmaps, in DataFrame operations only.

Every line with a key becomes a 128-bit hash with its document and position. Hashes are range-partitioned and
sorted by document and position; salts by document cut a line that a third of all documents share into
many groups. That one stream is read twice: a row whose predecessor is of another document is the
document's first occurrence, and their number over all salts is the number of documents with the line; then the rows
of the lines that are frequent enough become the bitmaps of dropped lines. A bitmap is compressed: 64 lines to a
word, words without a dropped line left out. Texts are joined with their bitmaps in the end.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from rulewell.llm.common import lower_ascii

STRIPPED = " \t\n\x0b\f\r"
SALTS = 64
WORD_BITS = 64
_ID = ("doc_id", "__text")


def line_key(line: Column) -> Column:
    return lower_ascii(F.btrim(line, F.lit(STRIPPED)))


def lines_of(text: Column | str) -> Column:
    """The text cut at line feeds; null or empty text is one empty line."""
    return F.split(F.coalesce(F.col(text) if isinstance(text, str) else text, F.lit("")), "\n", -1)


def _identified(docs: DataFrame) -> DataFrame:
    """Rows are told apart by number and text, so rows that share a number do not mix."""
    return docs.select(F.col("doc_id").alias("doc_id"), F.xxhash64("text").alias("__text"), "text")


def _stream(docs: DataFrame) -> DataFrame:
    """(high, low, salt, doc_id, __text, pos, first): every line with a non-empty key, in the order of hash, salt,
    document and position; ``first`` marks the first line with the key in its document.

    A document is a number; rows without a number are told apart by their texts.
    """
    lines = _identified(docs).select(*_ID, F.posexplode(lines_of("text")).alias("pos", "line"))
    keyed = lines.select(*_ID, "pos", line_key(F.col("line")).alias("key")).where(F.length("key") >= 1)
    salt = F.pmod(F.xxhash64(F.coalesce("doc_id", "__text")), F.lit(SALTS)).cast("int")
    hashed = keyed.select(F.xxhash64("key").alias("high"), F.xxhash64(F.lit(1), "key").alias("low"), salt.alias("salt"), *_ID, "pos")
    group, order = ["high", "low", "salt"], [*_ID, "pos"]
    ranged = hashed.repartitionByRange(*group).sortWithinPartitions(*group, *order)
    before = F.lag(F.struct("doc_id", F.when(F.col("doc_id").isNull(), F.col("__text")).alias("t"))).over(Window.partitionBy(*group).orderBy(*order))
    own = F.struct("doc_id", F.when(F.col("doc_id").isNull(), F.col("__text")).alias("t"))
    return ranged.withColumn("first", ~own.eqNullSafe(before))


def _counts(stream: DataFrame) -> DataFrame:
    """Per key hash: how many numbered documents have the line, and the first one."""
    numbered = F.col("first") & F.col("doc_id").isNotNull()
    # The groups of the stream are whole in their partitions: this needs no shuffle. Salts are few rows a line.
    salted = stream.groupBy("high", "low", "salt").agg(F.count_if(numbered).alias("documents"), F.min("doc_id").alias("first_doc"))
    return salted.groupBy("high", "low").agg(F.sum("documents").alias("documents"), F.min("first_doc").alias("first_doc"))


def line_counts(docs: DataFrame) -> DataFrame:
    """Per key hash: high, low, documents, first_doc."""
    return _counts(_stream(docs))


def drop_bitmaps(docs: DataFrame, min_documents: int = 2, keep_first: bool = True) -> DataFrame:
    """Per document with dropped lines: ``doc_id, __text, n_dropped, words``.

    A line is dropped when its key is found in at least ``min_documents`` documents; with
    ``keep_first`` the first line of the first document that has it stays. ``words`` maps the number
    of a 64-line word to the bits of its dropped lines. Keys are lines stripped of ASCII white space
    at both ends with A-Z lower-cased; empty keys are never dropped. Null texts are one empty line.
    Rows that share a number are one document to the count, each with its own bitmap. Rows
    without a number do not count as documents; they lose frequent lines like others, and with
    ``keep_first`` never hold a first occurrence.
    """
    stream = _stream(docs)
    frequent = _counts(stream).where(F.col("documents") >= min_documents)
    # Plain equi-join: the planner broadcasts few frequent lines, or splits a hot hash's partition.
    hit = stream.join(frequent, ["high", "low"])
    if keep_first:
        hit = hit.where(~(F.col("doc_id").eqNullSafe(F.col("first_doc")) & F.col("first")))
    bits = hit.groupBy(*_ID, (F.col("pos") / WORD_BITS).cast("int").alias("word")).agg(
        F.expr(f"bit_or(shiftleft(1L, cast(pos % {WORD_BITS} as int)))").alias("bits")
    )
    return bits.groupBy(*_ID).agg(
        F.sum(F.bit_count("bits")).cast("long").alias("n_dropped"),
        F.map_from_entries(F.collect_list(F.struct("word", "bits"))).alias("words"),
    )


def with_kept_text(docs: DataFrame, bitmaps: DataFrame, into: str = "kept_text") -> DataFrame:
    """All columns of ``docs``, the text without its dropped lines, n_lines and n_dropped (long).

    Columns of ``docs`` that are called like the three new ones are replaced; all others come back as they are.
    """
    taken = {c.lower() for c in docs.columns}

    def free(name: str) -> str:
        while name in taken:
            name += "_"
        return name

    key, doc, dropped, words = (free(n) for n in ("__key", "__bitmap_doc", "__dropped", "__words"))
    found = bitmaps.select(F.col("doc_id").alias(doc), F.col("__text").alias(f"{key}_b"), F.col("n_dropped").alias(dropped), F.col("words").alias(words))
    marked = docs.withColumn(key, F.xxhash64("text"))
    joined = marked.join(found, F.col("doc_id").eqNullSafe(F.col(doc)) & (F.col(key) == F.col(f"{key}_b")), "left")

    def kept(_: Column, i: Column) -> Column:
        word = F.try_element_at(F.col(words), (i / WORD_BITS).cast("int"))
        return word.isNull() | (F.getbit(word, (i % WORD_BITS).cast("int")) == 0)

    text = F.coalesce(F.col("text"), F.lit(""))
    cut = F.when(F.col(dropped).isNull(), text).otherwise(F.array_join(F.filter(lines_of("text"), kept), "\n"))
    n_lines = (F.length(text) - F.length(F.replace(text, F.lit("\n"), F.lit(""))) + 1).cast("long")
    return joined.select(
        *[F.col(f"`{c}`") for c in docs.columns if c.lower() not in (into.lower(), "n_lines", "n_dropped")],
        cut.alias(into),
        n_lines.alias("n_lines"),
        F.coalesce(dropped, F.lit(0)).cast("long").alias("n_dropped"),
    )


def digests(docs: DataFrame, min_documents: int = 10) -> DataFrame:
    """doc_id, n_lines, n_dropped, kept_sha256: frequent lines lose all their places."""
    rows = docs.select("doc_id", "text")
    kept = with_kept_text(rows, drop_bitmaps(rows, min_documents, keep_first=False))
    return kept.select("doc_id", "n_lines", "n_dropped", F.sha2("kept_text", 256).alias("kept_sha256"))


# The same rows in SQL over the given table.
SQL = r"""
with line as (
  select doc_id, unnest(string_split(coalesce(text, ''), chr(10))) as line,
         generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) as pos
  from documents
), keyed as (
  select doc_id, pos, line,
         translate(trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)),
                   'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') as key
  from line
), frequent as (
  select key from keyed where key <> '' group by key having count(distinct doc_id) >= 10
)
select k.doc_id, count(*) as n_lines, count(f.key) as n_dropped,
       sha256(coalesce(string_agg(k.line, chr(10) order by k.pos) filter (where f.key is null), '')) as kept_sha256
from keyed k left join frequent f on k.key = f.key
group by k.doc_id
"""
