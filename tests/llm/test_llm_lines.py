"""Line dedup, license scan and quality rules against brute force and their SQL twins."""

from __future__ import annotations

import collections
import hashlib
import random
import re

import duckdb
import pytest
from pyspark.sql import functions as F

from rulewell.llm import license_scan, line_dedup, quality_rules

BLANKS = " \t\n\x0b\f\r"
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def key(line):
    return line.strip(BLANKS).translate(LOWER)


def brute_lines(rows, least):
    documents = collections.Counter(k for _, k in {(d, key(x)) for d, t in rows if d is not None for x in (t or "").split("\n")} if k)
    out = []
    for d, t in rows:
        all_lines = (t or "").split("\n")
        kept = [x for x in all_lines if not (key(x) and documents[key(x)] >= least)]
        out.append((d, len(all_lines), len(all_lines) - len(kept), hashlib.sha256("\n".join(kept).encode()).hexdigest()))
    return sorted(out, key=str)


def line_rows():
    draw = random.Random(4)
    pool = ["Footer", " footer\t", "FOOTER\r", "É", "é", "", "  ", " x", "Menu | Home", "line"]
    rows = [(i, "\n".join(draw.choice(pool + [f"own {i} {j}" for j in range(6)]) for j in range(draw.randint(0, 9)))) for i in range(60)]
    rows += [(100, None), (101, ""), (102, "\n"), (103, "Footer\n" * 300), (7, rows[7][1]), (8, "another text\nFooter"), (None, "Footer\nno number")]
    rows += [(200, "\n".join(["Footer" if i % 3 == 0 else f"long {i}" for i in range(5000)]))]
    return rows


@pytest.mark.parametrize("least", [2, 10, 1000])
def test_line_digests_equal_brute_force(docs_of, least):
    rows = line_rows()
    got = line_dedup.digests(docs_of(rows), least).collect()
    assert sorted([tuple(r) for r in got], key=str) == brute_lines(rows, least)


def test_line_dedup_keeps_the_first(docs_of):
    rows = [(1, "a\nb\nA"), (2, "b\nc"), (3, "c\n a \nd"), (4, None)]
    kept = line_dedup.with_kept_text(docs_of(rows), line_dedup.drop_bitmaps(docs_of(rows), 2, keep_first=True))
    texts = {r.doc_id: (r.kept_text, r.n_dropped) for r in kept.collect()}
    assert texts == {1: ("a\nb", 1), 2: ("c", 1), 3: ("d", 2), 4: ("", 0)}
    assert "host" in kept.columns


def test_rows_of_one_number_are_one_document(docs_of):
    """Ten rows of one number with a line are one document with it, as in the SQL twin."""
    rows = [(1, f"the line\n{i}") for i in range(10)] + [(None, f"the line\n{i}") for i in range(9)] + [(2, "the line")]
    got = line_dedup.digests(docs_of(rows), 3).collect()
    assert {r.n_dropped for r in got} == {0}
    counts = {r.documents for r in line_dedup.line_counts(docs_of(rows)).collect()}
    assert counts == {2, 1, 0} or counts == {2, 1}


def test_bitmaps_come_from_one_sorted_stream(docs_of):
    """Lines are range-partitioned and sorted once; counts and bitmaps both read that exchange."""
    frame = line_dedup.drop_bitmaps(docs_of(line_rows()), 2, keep_first=False)
    frame.collect()
    plan = frame._jdf.queryExecution().executedPlan().toString()
    assert plan.count("rangepartitioning(high") >= 1 and "Window" in plan and "lag(" in plan


def test_columns_of_the_caller_come_back(docs_of):
    names = ["__text", "__n", "__words", "__key", "__bitmap_doc", "__dropped", "words", "high", "first"]
    frame = docs_of(line_rows()).select("doc_id", "text", *[F.concat(F.lit(f"{n} of "), F.coalesce("text", F.lit("-"))).alias(n) for n in names])
    kept = line_dedup.with_kept_text(frame, line_dedup.drop_bitmaps(frame, 2, keep_first=False)).collect()
    assert len(kept) == len(line_rows())
    assert all(r[n] == f"{n} of {'-' if r.text is None else r.text}" for r in kept for n in names)


def test_line_dedup_of_nothing(docs_of):
    assert line_dedup.digests(docs_of([])).collect() == []


def test_bitmaps_leave_out_untouched_words(docs_of):
    rows = [(i, "\n".join(["shared" if j == 130 else f"{i} {j}" for j in range(200)])) for i in range(3)]
    words = line_dedup.drop_bitmaps(docs_of(rows), 3, keep_first=False).collect()
    assert all(r.words == {2: 4} and r.n_dropped == 1 for r in words)


def brute_scan(rows):
    split = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
    out = []
    for d, t in rows:
        words = split.findall((t or "").translate(LOWER))
        at = [(i, label) for p, label in license_scan.PHRASES.items() for i in range(len(words)) if words[i : i + len(p.split())] == p.split()]
        base, found, best = {x for _, x in at}, set(), 0.0
        lines = [set(split.findall(line.translate(LOWER))) for line in (t or "").split("\n")]
        for label, template in license_scan.TEMPLATES.items():
            wanted, own = set(template.split()), license_scan.OWN_WORDS.get(label)
            span = -(-len(template.split()) * 5 // 4)  # words / 0.8, rounded up
            runs = [set(words[i : i + span]) for i in range(len(words))] if len(wanted & set(words)) >= 0.8 * len(wanted) else []
            for block in lines + runs:
                share = len(block & wanted) / len(wanted)
                if share >= license_scan.THRESHOLD and (own is None or own in block):
                    found.add(label)
                    best = max(best, share)
        places = [i for i, _ in at]
        out.append((d, len(words), len(at), min(places, default=None), max(places, default=None), ",".join(sorted(base)), ",".join(sorted(base | found)), 1.0 if at else best))
    return sorted(out, key=str)


def scan_rows():
    draw = random.Random(8)
    rows = [(i, t) for i, t in enumerate(license_scan.TEMPLATES.values())]
    for i, t in enumerate(list(license_scan.TEMPLATES.values()) * 3):
        words = t.split()
        words = [w for w in words if draw.random() > 0.15] + draw.choices(["the", "é", "x9"], k=3)
        draw.shuffle(words)
        rows.append((50 + i, "before\n" + ", ".join(words).upper() + "\nafter"))
    rows += [(900, None), (901, ""), (902, "..."), (903, "cc by cc by CC-BY. mit license mit"), (904, "xcc by, cc byx"), (905, "MIT\nLicense"),
             (906, "word " * 5000 + "Apache License"), (909, "Released under the BSD License"), (910, "Released under\nthe MIT"), (903, "cc by"), (None, "mit license"), (907, "GNU  General-Public License"), (908, "éCC BY")]
    return rows


def test_scan_equals_brute_force(docs_of):
    rows = scan_rows()
    got = [tuple(r) for r in license_scan.scan(docs_of(rows)).collect()]
    assert sorted(got, key=str) == brute_scan(rows)
    assert {r[0]: r[6] for r in got}[909] == ""
    assert license_scan.scan(docs_of([])).collect() == []


def test_every_threshold_finds_all_blocks(docs_of):
    rows = scan_rows()
    split = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
    for threshold in (0.3, 0.5, 1.0):
        want = collections.Counter()
        for d, t in rows:
            for pos, line in enumerate((t or "").split("\n")):
                block = set(split.findall(line.translate(LOWER)))
                for label, template in license_scan.TEMPLATES.items():
                    wanted, own = set(template.split()), license_scan.OWN_WORDS.get(label)
                    if len(block & wanted) >= threshold * len(wanted) and (own is None or own in block):
                        want[d, pos, label] += 1
        got = license_scan.matches(docs_of(rows), threshold=threshold).collect()
        assert collections.Counter((r.doc_id, r.pos, r.template) for r in got) == want


WRAPPED = {
    "gpl-notice": "    This program is free software: you can redistribute it and/or modify\n    it under the terms of the GNU General "
    "Public License as published by\n    the Free Software Foundation, either version 3 of the License, or",
    "mit-permission": " * Permission is hereby granted, free of charge, to any person obtaining a copy\n * of this software and "
    "associated documentation files (the \"Software\"), to deal",
    "bsd-notice": "# Redistribution and use in source and binary forms, with or without\n# modification, are permitted provided "
    "that the following conditions are met:",
    "mpl-2.0-notice": "// This Source Code Form is subject to the terms of the Mozilla Public\r\n//\r\n// License, v. 2.0.",
}


def test_notices_wrapped_over_lines(docs_of):
    rows = list(enumerate(WRAPPED.values()))
    rows += [(10 + i, "word\n" * 3000 + t + "\nword" * 3000) for i, t in enumerate(WRAPPED.values())]
    rows += [(20 + i, "\n".join(f"{w} and other words" for w in t.split())) for i, t in enumerate(WRAPPED.values())]
    rows += [(30, "Released under\nthe BSD License"), (31, "Released\nunder the MIT\nLicense"), (32, "Licensed under CC\nBY 4.0"),
             (33, "Released\nunder\nthe\nlicense\n" + "far " * 50 + "mit"), (34, None), (35, "")]
    got = {r.doc_id: r.labels.split(",") for r in license_scan.scan(docs_of(rows)).collect()}
    for i, label in enumerate(WRAPPED):
        assert label in got[i] and label in got[10 + i] and label not in got[20 + i]
    assert got[30] == [""] and got[31] == ["mit", "mit-notice"] and got[32] == ["cc-by"] and got[33] == [""]
    assert got[34] == [""] and got[35] == [""]


def test_twins_on_the_given_tables(spark, data_dir):
    from rulewell.llm import queries

    db = duckdb.connect()
    for name in ("documents", "labels", "pages", "conversations"):
        db.execute(f"create view {name} as select * from '{data_dir}/{name}.parquet'")
    for name, sql in queries.SQL.items():
        want = db.execute(sql)
        names = sorted(d[0] for d in want.description)
        order = [[d[0] for d in want.description].index(c) for c in names]
        got = queries.QUERIES[name](spark, data_dir)
        assert sorted(got.columns) == names
        expected = sorted([tuple(r[i] for i in order) for r in want.fetchall()], key=str)
        assert sorted([tuple(r) for r in got.select(*names).collect()], key=str) == expected


def brute_rules(t):
    t = t or ""
    words = re.findall(r"[^\x20\x09-\x0D]+", t)
    windows = collections.Counter(zip(words, words[1:], words[2:], strict=False))
    covered = {i + k for i in range(len(words) - 2) if windows[tuple(words[i : i + 3])] > 1 for k in range(3)}
    full = [x for x in t.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    n = len(words)
    failed = n < 50 or 100 * len(covered) > 50 * n
    return (n, sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", t)), len(full) - len(set(full)), len(covered), failed)


def rule_rows():
    draw = random.Random(2)
    vocabulary = ["the", "of", "and", "der", "la", "cat", "hat", "é", " ", "b#", "|", "<x>"]
    rows = [(i, " ".join(draw.choice(vocabulary) for _ in range(draw.randint(0, 120)))) for i in range(60)]
    rows += [(100, None), (101, ""), (102, " \n\t"), (103, "a b c a b c"), (104, "a a a a"), (105, "a b"), (106, "x\nx\n\n\nx\n x"),
             (107, "la la la " * 4000), (108, " ".join(f"w{i}" for i in range(20000))), (3, rows[3][1]), (None, "no number")]
    return rows


def test_rules_equal_brute_force(docs_of):
    rows = rule_rows()
    got = quality_rules.judged(docs_of(rows)).collect()
    have = sorted([(r.doc_id, *tuple(r)[1:7]) for r in got], key=str)
    assert have == sorted([(d, *brute_rules(t)) for d, t in rows], key=str)
    assert all(not (r.kept and r.base_failed) for r in got)
    assert quality_rules.judged(docs_of([])).collect() == []


def test_divergence_sorts_odd_texts_out(spark, docs_of):
    draw = random.Random(6)
    words = quality_rules.COMMON_WORDS["en"] + [f"thing{c}" for c in "abcdefgh"]
    clean = [(i, " ".join(draw.choice(words) for _ in range(200)) + ".") for i in range(60)]
    odd = [(100, " ".join("#$%" + str(i * 7919) for i in range(200))), (101, " ".join(f"QQ{chr(65 + i % 26)}{chr(65 + i // 26)}X" for i in range(200)))]
    got = {r.doc_id: r for r in quality_rules.judged(docs_of(clean + odd)).collect()}
    assert all(got[d].kept for d, _ in clean) and not any(got[d].kept for d, _ in odd)
    assert all(0 <= r.class_distance <= 1 and 0 <= r.word_distance <= 1 for r in got.values())


def test_long_texts_without_common_words_go(docs_of):
    draw = random.Random(16)
    other = ["".join(draw.choices("aeinorstlmd", k=draw.randint(2, 8))) + "x" for _ in range(300)]
    common = quality_rules.COMMON_WORDS["en"]

    def text(n, share):
        return " ".join(draw.choice(common) if draw.random() < share else draw.choice(other) for _ in range(n)) + "."

    clean = [(i, text(draw.randint(60, 900), 0.12)) for i in range(80)]
    odd = [(100 + n, text(n, 0.0)) for n in (150, 400, 3000)]
    got = {r.doc_id: r for r in quality_rules.judged(docs_of(clean + odd)).collect()}
    assert all(got[d].kept for d, _ in clean)
    for d, _ in odd:
        assert not got[d].kept and not got[d].base_failed and got[d].class_distance <= quality_rules.MAX_CLASS_DISTANCE
    alone = quality_rules.judged(docs_of([(i, text(300, 0.0)) for i in range(5)])).collect()
    assert all(r.kept for r in alone)  # no reference has common words


def test_distance_is_jensen_shannon(spark):
    from math import log2, sqrt

    q, p = [3.0, 1.0, 0.0], [0.2, 0.3, 0.5]
    frame = spark.createDataFrame([(q, 4.0)], "h array<double>, t double")
    from pyspark.sql import functions as F

    got = frame.select(quality_rules.distance(F.col("h"), F.col("t"), p).alias("d")).first().d
    s = [x / 4 for x in q]
    m = [(a + b) / 2 for a, b in zip(s, p, strict=True)]
    kl = lambda x: sum(a * log2(a / c) for a, c in zip(x, m, strict=True) if a > 0)
    assert abs(got - sqrt((kl(s) + kl(p)) / 2)) < 1e-12
