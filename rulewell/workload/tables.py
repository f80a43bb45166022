"""Moderation tables derived from the given tables, for Spark and as SQL views.

Documents are the comments, their source is the community, ``labels.toxic`` is the violation flag
(null = unlabelled), benchmark items are the rules, and embeddings with their label are the vector
corpus. Whole tables and whole texts are used throughout.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from rulewell.operators.numbering import number_rows
from rulewell.operators.parallel import spread
from rulewell.schemas import EXAMPLE_COLUMNS
from rulewell.session import COMPRESSION, scratch_folder

SQL_VIEWS = """
rules as (
 select item_id as rule_id, concat('No ', replace(text, chr(10), ' ')) as rule,
  row_number() over (order by item_id) - 1 as n, count(*) over () as c from benchmark),
communities as (
 select source as subreddit, min(doc_id) as id from documents group by source),
snip as (
 select d.doc_id as row_id, d.source as subreddit, d.text as body, l.toxic as rule_violation
 from documents d left join labels l on d.doc_id = l.doc_id),
pos as (
 select body, row_number() over (order by row_id) - 1 as n, count(*) over () as c
 from snip where rule_violation = 1),
neg as (
 select body, row_number() over (order by row_id) - 1 as n, count(*) over () as c
 from snip where rule_violation = 0),
wide as (
 select s.row_id, s.subreddit, r.rule,
  case when s.row_id % 31 = 3 then null else p1.body end as positive_example_1,
  p2.body as positive_example_2, n1.body as negative_example_1, n2.body as negative_example_2,
  s.body as test_comment, s.rule_violation,
  case when s.rule_violation is null or s.row_id % 29 = 0 then null
   when s.row_id % 7 = 0 then case when s.rule_violation = 1 then 'True' else 'False' end
   when s.row_id % 7 = 1 then case when s.rule_violation = 1 then '"Yes"' else '"No"' end
   when s.row_id % 7 = 2 then case when s.rule_violation = 1 then ' yes ' else ' no ' end
   when s.row_id % 7 = 3 then case when s.rule_violation = 1 then 'Y' else 'f' end
   when s.row_id % 7 = 4 then 'maybe'
   else case when s.rule_violation = 1 then 'Yes' else 'No' end end as violates_rule
 from snip s join rules r on r.n = s.row_id % r.c
 join pos p1 on p1.n = s.row_id % p1.c join pos p2 on p2.n = (s.row_id + 1) % p2.c
 join neg n1 on n1.n = s.row_id % n1.c join neg n2 on n2.n = (s.row_id + 1) % n2.c),
train as (select * from wide where rule_violation is not null),
test as (select * from wide where rule_violation is null),
responses as (
 select row_id, violates_rule, case when row_id % 13 = 0 then null else concat(
  'Formatted Rule: ', rule, chr(10),
  'Positive Example 1: ', replace(positive_example_2, chr(10), ' '), chr(10),
  ' Negative Example 1: ', replace(negative_example_1, chr(10), ' '), chr(10),
  case when row_id % 5 = 0 then '**Test Comment:** bold'
   else concat('  Test Comment: ', replace(test_comment, chr(10), ' ')) end, chr(10),
  'Positive Example 2: ', subreddit, ' one', chr(10), 'Negative Example 2: ', subreddit, ' two', chr(10),
  'Example 1: first ', rule, chr(10), 'Example 2: second', chr(10),
  'Example 3: ', replace(negative_example_2, chr(10), ' '), chr(10), 'Example 4:  fourth  ', chr(10),
  'Formatted Rule Name: name of ', cast(row_id as varchar), chr(10), 'Formatted Rule Description: about ', subreddit, chr(10),
  'Final Formatted Rule: name: about', chr(10),
  'Clarity Tag: ', case when row_id % 3 = 0 then 'Unclear' else 'Clear' end, chr(10),
  'Clarity Reason: ', case when row_id % 3 = 0 then 'too broad' else '' end, chr(10),
  'Violates Rule: ', coalesce(violates_rule, ''),
  case when row_id % 11 = 0 then concat(chr(10), 'Violates Rule: No') else '' end) end as response
 from train),
answers as (
 select row_id, rule_violation, violates_rule,
  case when row_id % 13 = 0 then null
   when row_id % 13 = 1 then ''
   when row_id % 13 = 2 then 'cannot tell'
   when row_id % 3 = 0 then concat('y: ', test_comment)
   when row_id % 3 = 1 then concat('NO. ', test_comment)
   else test_comment end as answer,
  case when row_id % 17 = 0 then concat('### Response: 9 ', test_comment)
   when row_id % 17 = 1 then concat(test_comment, '### Response: 4### Response: none')
   else concat('7 ', test_comment, '### Response: Violates rule: ', case when row_id % 5 = 0 then '0.'
    when row_id % 5 = 1 then '1' else '' end, cast(row_id % 190 as varchar), case when row_id % 2 = 0 then '%' else '.' end)
   end as scored_text
 from train),
token_rows as (
 select row_id, rule_violation, token_id, token, logprob from (
  select row_id, rule_violation, 1 as token_id, 'Yes' as token,
   case when row_id % 17 = 0 then null else cast(-0.01 * (1 + row_id % 97) as double) end as logprob from train
  union all select row_id, rule_violation, 2, 'No',
   case when row_id % 19 = 0 then null else cast(-0.02 * (1 + row_id % 53) as double) end from train
  union all select row_id, rule_violation, 3, ' maybe', cast(-0.03 * (1 + row_id % 31) as double) from train
  union all select row_id, rule_violation, 4, 'yes', cast(-0.015 * (1 + row_id % 41) as double) from train) z
 where logprob is not null),
predicted as (
 select row_id, rule_violation, violates_rule, rule,
  case when row_id % 23 = 0 then 'Error' when row_id % 29 = 1 then null
   when (rule_violation = 1 and row_id % 4 <> 0) or row_id % 6 = 5 then 'yes' else 'FALSE ' end as prediction,
  case when (rule_violation = 1 and row_id % 4 <> 0) or row_id % 6 = 5 then 1 else 0 end as predicted
 from train),
corpus as (
 select vec_id as row_id, concat('rule ', cast(label as varchar)) as rule, embedding,
  case when vec_id % 3 = 0 then 1 else -1 end as value from embeddings),
asked as (
 select row_id as query_id, case when row_id % 10 = 9 then concat(rule, ' (amended)') else rule end as query_rule,
  embedding, case when value = 1 then 1 else 0 end as truth from corpus),
corpus_rules as (select rule, arg_min(embedding, row_id) as embedding from corpus group by rule),
query_rules as (select query_rule as rule, arg_min(embedding, query_id) as embedding from asked group by query_rule),
scores as (
 select d.lang as train_dataset,
  case when l.quality = 1 then 'good' when l.quality = 0 then 'poor' else 'base' end as pred_model_type,
  d.source as scoring_dataset, cast(max(d.n_chars) as varchar) as model_a,
  case when count(*) % 3 = 0 then 'n/a' else cast(count(*) as varchar) end as model_b,
  case when min(d.n_chars) < 100 then null else cast(min(d.n_chars) as varchar) end as model_c
 from documents d left join labels l on d.doc_id = l.doc_id group by 1, 2, 3)
"""


def sql(body: str, extra: str = "") -> str:
    """A query over the views above, with further views in ``extra``."""
    return f"with {SQL_VIEWS.strip()}{', ' + extra if extra else ''}\n{body}"


# By the label of the donors: the columns of the donor at the row's own place and of the one after it.
DONORS = {1: ("positive_example_1", "positive_example_2"), 0: ("negative_example_1", "negative_example_2")}

# Places of a block of rows that share copies of donors, and numbers of a place; their product bounds the numbers of a block.
BLOCK, TURNS = 32, 32

_STORED: dict[tuple[str, str, str], str] = {}


class Tables:
    """The same tables as DataFrames. Numbered donors are written once per session and data set, the wide table on demand."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.sf_dir = spark, sf_dir.rstrip("/")

    def given(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.sf_dir}/{name}.parquet")

    def scratch(self, name: str) -> str:
        return scratch_folder(self.spark, name)

    def _key(self, name: str) -> tuple[str, str, str]:
        return self.spark.sparkContext.applicationId, self.sf_dir, name

    def stored(self, name: str, build: Callable[[], DataFrame]) -> DataFrame:
        key = self._key(name)
        if key not in _STORED:
            path = self.scratch(name)
            spread(build()).write.option("compression", COMPRESSION).parquet(path)
            _STORED[key] = path
        return self.spark.read.parquet(_STORED[key])

    @property
    def rules(self) -> DataFrame:
        return self.given("benchmark").select(
            F.col("item_id").alias("rule_id"), F.concat(F.lit("No "), F.replace("text", F.lit("\n"), F.lit(" "))).alias("rule")
        )

    @property
    def communities(self) -> DataFrame:
        return self.given("documents").groupBy(F.col("source").alias("subreddit")).agg(F.min("doc_id").alias("id"))

    @property
    def comments(self) -> DataFrame:
        labels = self.given("labels").select("doc_id", F.col("toxic").alias("rule_violation"))
        return (
            self.given("documents")
            .join(labels, "doc_id", "left")
            .select(
                F.col("doc_id").alias("row_id"),
                F.col("source").alias("subreddit"),
                F.col("text").alias("body"),
                "rule_violation",
            )
        )

    def _numbered(self, name: str, df: DataFrame, key: str, **options) -> DataFrame:
        return self.stored(name, lambda: number_rows(df, key, into="n", **options))

    def _slot_count(self, label: int) -> F.Column:
        """Rows with a label, as a subquery; counted once, without the texts."""
        counted = self.comments.groupBy("rule_violation").agg(F.count(F.lit(1)).alias("rows"))
        rows = self.stored("sizes", lambda: counted).filter(F.col("rule_violation") == label)
        return rows.agg(F.coalesce(F.sum("rows"), F.lit(0))).scalar()

    def _attach_examples(self, df: DataFrame, wanted: dict[int, dict[int, str]]) -> DataFrame:
        """Add the bodies of the donors of each label, one or two places on from the row's number.

        ``wanted`` has by label, and by places on, the column. Rows are dealt out once, in blocks, and each block gets one
        copy of every donor that its rows ask for. A row's place in a label is its number modulo the label's donors; a block has
        BLOCK places of the label with fewer donors and up to TURNS numbers a place, so that rows that follow each other,
        or ask for the same donors, are together. In a block, rows and donors are put in the order of places, label by label,
        where a row's donors are the last ones before it. Only numbers travel to find the donors of a block.
        """
        size = {label: self._slot_count(label) for label in wanted}
        labelled = self.comments.filter(F.col("rule_violation").isin(0, 1)).select("row_id", "rule_violation", "body")
        donors = self._numbered("donors", labelled, "row_id", within=("rule_violation",))
        donors = donors.select(F.col("rule_violation").alias("__label"), F.col("n").alias("__n"), F.struct("body").alias("__donor"))
        id_, least = F.col("row_id"), F.least(*size.values()) if len(size) > 1 else next(iter(size.values()))
        blocks = {"__block": F.floor(id_ % least / BLOCK), "__turn": F.floor(F.floor(id_ / least) / TURNS)}
        places = {f"__place{label}": id_ % size[label] for label in wanted}
        asked = [
            F.struct(F.lit(label).alias("__label"), (F.col(f"__place{label}") + shift).alias("__place"), ((id_ + shift) % size[label]).alias("__n"))
            for label, columns in wanted.items()
            for shift in columns
        ]
        numbers = df.select("row_id").withColumns(blocks | places).select(*blocks, F.explode(F.array(*asked)).alias("__asked"))
        copies = numbers.select(*blocks, "__asked.*").distinct().join(donors, ["__label", "__n"]).drop("__n")
        out = df.withColumns(blocks | places).unionByName(copies, allowMissingColumns=True)
        found = {}
        # Clean donors go first: as a rule they are more, and a label's copies are left behind with its window.
        for label, columns in sorted(wanted.items()):
            # The donor at a place goes before the rows for which it is the last one.
            here, further = F.col("__label") == label, max(columns)
            order = Window.partitionBy(*blocks).orderBy(F.coalesce(f"__place{label}", F.col("__place") - further), F.col("__label").isNull())
            before = F.last(F.when(here, F.col("__donor")), ignorenulls=True).over(order.rowsBetween(Window.unboundedPreceding, -1))
            pair = {further: F.col("__donor.body")} | ({further - 1: before["body"]} if len(columns) > 1 else {})
            out = out.withColumn("__pair", F.when(here, F.struct(*[c.alias(columns[shift]) for shift, c in pair.items()])))
            last = F.last("__pair", ignorenulls=True).over(order.rowsBetween(Window.unboundedPreceding, 0))
            out = out.withColumn(f"__found{label}", last).filter(F.col("__label").isNull() | (F.col("__label") != label))
            found |= {into: F.col(f"__found{label}.{into}") for into in columns.values()}
        return out.select(*df.columns, *[c.alias(into) for into, c in found.items()])

    def wide_with(self, *examples: str) -> DataFrame:
        """The wide table with only the named example columns; only their texts are attached.

        Rows are the same whatever is named: one whose number has no donor for some example is not among them.
        """
        if self._key("wide") in _STORED:
            return self.stored("wide", self._all_examples).drop(*[c for c in EXAMPLE_COLUMNS if c not in examples])
        rows, id_ = self.comments.withColumnRenamed("body", "test_comment"), F.col("row_id")
        rules = self._numbered("rules", self.rules, "rule_id").select(F.col("n").alias("__n"), "rule")
        out = rows.withColumn("__n", id_ % rules.agg(F.count(F.lit(1))).scalar()).join(rules, "__n").drop("__n")
        wanted = {}
        for label, columns in DONORS.items():
            size = self._slot_count(label)
            out = out.filter((id_ % size >= 0) & ((id_ + 1) % size >= 0))
            wanted[label] = {shift: into for shift, into in enumerate(columns) if into in examples}
        wanted = {label: columns for label, columns in wanted.items() if columns}
        if wanted:
            out = self._attach_examples(out, wanted)
        yes = F.col("rule_violation") == 1

        def spelled(one: str, zero: str):
            return F.when(yes, F.lit(one)).otherwise(F.lit(zero))

        seven = id_ % 7
        label = (
            F.when(F.col("rule_violation").isNull() | (id_ % 29 == 0), F.lit(None).cast("string"))
            .when(seven == 0, spelled("True", "False"))
            .when(seven == 1, spelled('"Yes"', '"No"'))
            .when(seven == 2, spelled(" yes ", " no "))
            .when(seven == 3, spelled("Y", "f"))
            .when(seven == 4, F.lit("maybe"))
            .otherwise(spelled("Yes", "No"))
        )
        shown = {"positive_example_1": F.when(id_ % 31 != 3, F.col("positive_example_1")).alias("positive_example_1")}
        return out.select(
            "row_id",
            "subreddit",
            "rule",
            *[shown.get(c, F.col(c)) for c in EXAMPLE_COLUMNS if c in examples],
            "test_comment",
            "rule_violation",
            label.alias("violates_rule"),
        )

    def with_examples(self, df: DataFrame) -> DataFrame:
        """Some rows of ``wide_with()`` with all their examples: only the texts that these rows ask for are attached."""
        out = self._attach_examples(df, {label: dict(enumerate(columns)) for label, columns in DONORS.items()})
        return out.withColumn("positive_example_1", F.when(F.col("row_id") % 31 != 3, F.col("positive_example_1")))

    def _all_examples(self) -> DataFrame:
        return self.wide_with(*EXAMPLE_COLUMNS)

    def store_wide(self) -> DataFrame:
        """Write the whole wide table for the queries to come, where many are asked of the same tables."""
        return self.stored("wide", self._all_examples)

    @property
    def wide(self) -> DataFrame:
        return self._all_examples()

    def train_with(self, *examples: str) -> DataFrame:
        return self.wide_with(*examples).filter("rule_violation is not null")

    def test_with(self, *examples: str) -> DataFrame:
        return self.wide_with(*examples).filter("rule_violation is null")

    @property
    def train(self) -> DataFrame:
        return self.train_with(*EXAMPLE_COLUMNS)

    @property
    def test(self) -> DataFrame:
        return self.test_with(*EXAMPLE_COLUMNS)

    @property
    def responses(self) -> DataFrame:
        id_, flat = F.col("row_id"), lambda c: F.replace(F.col(c), F.lit("\n"), F.lit(" "))
        comment = F.when(id_ % 5 == 0, F.lit("**Test Comment:** bold")).otherwise(
            F.concat(F.lit("  Test Comment: "), flat("test_comment"))
        )
        text = F.concat(
            F.lit("Formatted Rule: "), F.col("rule"),
            F.lit("\nPositive Example 1: "), flat("positive_example_2"),
            F.lit("\n Negative Example 1: "), flat("negative_example_1"),
            F.lit("\n"), comment,
            F.lit("\nPositive Example 2: "), F.col("subreddit"), F.lit(" one\nNegative Example 2: "), F.col("subreddit"),
            F.lit(" two\nExample 1: first "), F.col("rule"), F.lit("\nExample 2: second"),
            F.lit("\nExample 3: "), flat("negative_example_2"), F.lit("\nExample 4:  fourth  "),
            F.lit("\nFormatted Rule Name: name of "), id_.cast("string"),
            F.lit("\nFormatted Rule Description: about "), F.col("subreddit"), F.lit("\nFinal Formatted Rule: name: about"),
            F.lit("\nClarity Tag: "), F.when(id_ % 3 == 0, F.lit("Unclear")).otherwise(F.lit("Clear")),
            F.lit("\nClarity Reason: "), F.when(id_ % 3 == 0, F.lit("too broad")).otherwise(F.lit("")),
            F.lit("\nViolates Rule: "), F.coalesce("violates_rule", F.lit("")),
            F.when(id_ % 11 == 0, F.lit("\nViolates Rule: No")).otherwise(F.lit("")),
        )
        rows = self.train_with("positive_example_2", "negative_example_1", "negative_example_2")
        return rows.select("row_id", "violates_rule", F.when(id_ % 13 != 0, text).alias("response"))

    @property
    def answers(self) -> DataFrame:
        id_, comment = F.col("row_id"), F.col("test_comment")
        answer = (
            F.when(id_ % 13 == 0, F.lit(None).cast("string"))
            .when(id_ % 13 == 1, F.lit(""))
            .when(id_ % 13 == 2, F.lit("cannot tell"))
            .when(id_ % 3 == 0, F.concat(F.lit("y: "), comment))
            .when(id_ % 3 == 1, F.concat(F.lit("NO. "), comment))
            .otherwise(comment)
        )
        lead = F.when(id_ % 5 == 0, F.lit("0.")).when(id_ % 5 == 1, F.lit("1")).otherwise(F.lit(""))
        end = F.when(id_ % 2 == 0, F.lit("%")).otherwise(F.lit("."))
        scored = (
            F.when(id_ % 17 == 0, F.concat(F.lit("### Response: 9 "), comment))
            .when(id_ % 17 == 1, F.concat(comment, F.lit("### Response: 4### Response: none")))
            .otherwise(
                F.concat(
                    F.lit("7 "), comment, F.lit("### Response: Violates rule: "), lead, (id_ % 190).cast("string"), end
                )
            )
        )
        return self.train_with().select(
            "row_id", "rule_violation", "violates_rule", answer.alias("answer"), scored.alias("scored_text")
        )

    @property
    def tokens(self) -> DataFrame:
        """(row_id, rule_violation, tokens ARRAY<STRUCT<token_id, token, logprob>>)."""
        id_ = F.col("row_id")

        def entry(number: int, token: str, logprob) -> F.Column:
            return F.struct(
                F.lit(number).alias("token_id"), F.lit(token).alias("token"), logprob.cast("double").alias("logprob")
            )

        def tenth(milli: int, modulus: int) -> F.Column:
            return -F.lit(milli) * (1 + id_ % modulus) / 1000.0

        listed = F.array(
            entry(1, "Yes", F.when(id_ % 17 != 0, tenth(10, 97))),
            entry(2, "No", F.when(id_ % 19 != 0, tenth(20, 53))),
            entry(3, " maybe", tenth(30, 31)),
            entry(4, "yes", tenth(15, 41)),
        )
        present = F.filter(listed, lambda x: x["logprob"].isNotNull())
        return self.train_with().select("row_id", "rule_violation", present.alias("tokens"))

    @property
    def predicted(self) -> DataFrame:
        id_ = F.col("row_id")
        positive = ((F.col("rule_violation") == 1) & (id_ % 4 != 0)) | (id_ % 6 == 5)
        text = (
            F.when(id_ % 23 == 0, F.lit("Error"))
            .when(id_ % 29 == 1, F.lit(None).cast("string"))
            .when(positive, F.lit("yes"))
            .otherwise(F.lit("FALSE "))
        )
        return self.train_with().select(
            "row_id", "rule_violation", "violates_rule", "rule", text.alias("prediction"),
            positive.cast("int").alias("predicted"),
        )

    @property
    def corpus(self) -> DataFrame:
        return self.given("embeddings").select(
            F.col("vec_id").alias("row_id"),
            F.concat(F.lit("rule "), F.col("label").cast("string")).alias("rule"),
            "embedding",
            F.when(F.col("vec_id") % 3 == 0, F.lit(1)).otherwise(F.lit(-1)).alias("value"),
        )

    @property
    def asked(self) -> DataFrame:
        """Every vector as a query; one in ten asks for a rule name the corpus does not have."""
        amended = F.concat("rule", F.lit(" (amended)"))
        return self.corpus.select(
            F.col("row_id").alias("query_id"),
            F.when(F.col("row_id") % 10 == 9, amended).otherwise(F.col("rule")).alias("query_rule"),
            "embedding",
            (F.col("value") == 1).cast("int").alias("truth"),
        )

    @property
    def corpus_rules(self) -> DataFrame:
        return self.corpus.groupBy("rule").agg(F.min_by("embedding", "row_id").alias("embedding"))

    @property
    def query_rules(self) -> DataFrame:
        return self.asked.groupBy(F.col("query_rule").alias("rule")).agg(
            F.min_by("embedding", "query_id").alias("embedding")
        )

    @property
    def scores(self) -> DataFrame:
        quality = F.col("quality")
        kind = F.when(quality == 1, F.lit("good")).when(quality == 0, F.lit("poor")).otherwise(F.lit("base"))
        n, low = F.count(F.lit(1)), F.min("n_chars")
        return (
            self.given("documents")
            .select("doc_id", "lang", "source", "n_chars")
            .join(self.given("labels").select("doc_id", "quality"), "doc_id", "left")
            .groupBy(
                F.col("lang").alias("train_dataset"), kind.alias("pred_model_type"), F.col("source").alias("scoring_dataset")
            )
            .agg(
                F.max("n_chars").cast("string").alias("model_a"),
                F.when(n % 3 == 0, F.lit("n/a")).otherwise(n.cast("string")).alias("model_b"),
                F.when(low >= 100, low.cast("string")).alias("model_c"),
            )
        )
