"""Multi-line CSV by splits against the reader that takes a file whole."""

from __future__ import annotations

import csv
import random

import pytest
from pyspark.sql import types as T

from rulewell.sources.csvfiles import csv_scan
from rulewell.sources.splitcsv import records, split_csv_scan

NAMES = ["id", "comment", "label"]


def write(path, rows, names=NAMES, end="\n"):
    with open(path, "w", newline="", encoding="utf-8") as out:
        writer = csv.writer(out, lineterminator=end)
        writer.writerow(names)
        writer.writerows(rows)


def some_rows(n, seed):
    draw = random.Random(seed)
    bits = ["plain", 'a "quoted" word', "two\nlines", "", "x,y", '"', "\n\n", "NaN", " spaced ", "é", "end\n", '""\n"']
    return [(i, " ".join(draw.choice(bits) for _ in range(draw.randint(0, 6))), draw.choice(["Yes", "No", ""])) for i in range(n)]


@pytest.fixture
def small_splits(spark):
    held = {"spark.sql.files.maxPartitionBytes": "997", "spark.sql.files.openCostInBytes": "1"}
    for key, value in held.items():
        spark.conf.set(key, value)
    yield
    for key in held:
        spark.conf.unset(key)


@pytest.mark.parametrize("end", ["\n", "\r\n"])
def test_same_rows_from_many_tasks(spark, tmp_path, small_splits, end):
    write(tmp_path / "a.csv", some_rows(400, 1), end=end)
    write(tmp_path / "b.csv", [(9, "long " * 900 + "\n" * 40 + '"' * 7, "No"), (10, "\n" * 3000, "Yes"), (11, "last", "No")], end=end)
    path = str(tmp_path / "*.csv")
    kind = T.StructType().add("id", "long").add("comment", "string").add("label", "string")
    for schema in (None, kind):
        split, whole = split_csv_scan(spark, path, schema), csv_scan(spark, path, schema)
        assert split.schema.simpleString() == whole.schema.simpleString()
        assert sorted(map(str, split.collect())) == sorted(map(str, whole.collect()))
    assert whole.rdd.getNumPartitions() < 3 and records(spark, path).select("start").distinct().count() > 10


def test_headers_and_quotes_are_checked(spark, tmp_path):
    write(tmp_path / "a.csv", some_rows(5, 1))
    with pytest.raises(ValueError, match="the header is"):
        split_csv_scan(spark, str(tmp_path / "a.csv"), T.StructType().add("id", "long").add("other", "string").add("label", "string"))
    write(tmp_path / "b.csv", some_rows(5, 2), names=["id", "text", "label"])
    with pytest.raises(Exception, match="another header in"):
        split_csv_scan(spark, str(tmp_path / "*.csv")).collect()
    (tmp_path / "c.csv").write_text('id,comment,label\n1,"open,No\n')
    with pytest.raises(ValueError, match="do not pair up"):
        split_csv_scan(spark, str(tmp_path / "c.csv"))
    with pytest.raises(FileNotFoundError):
        split_csv_scan(spark, str(tmp_path / "absent.csv"))


def test_only_a_header(spark, tmp_path):
    write(tmp_path / "a.csv", [])
    found = split_csv_scan(spark, str(tmp_path / "a.csv"))
    assert found.columns == NAMES and found.collect() == []
