"""Fingerprints and the Jaccard join against brute force."""

from __future__ import annotations

import hashlib
import random
import re

import numpy as np
import pytest

from rulewell.llm import fingerprint as fp
from rulewell.llm import jaccard_join as jj

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def prose(seed, n):
    draw = random.Random(seed)
    return " ".join("".join(draw.choice("abcdefghij") for _ in range(draw.randint(2, 8))) for _ in range(n))


def test_fingerprint_shape_and_locality():
    assert fp.fingerprint("") == "3::"
    text = prose(1, 700)
    mark = fp.fingerprint(text)
    block, first, second = mark.split(":")
    assert 32 <= len(first) <= 64 and len(second) <= 64 and int(block) >= 3
    assert fp.fingerprint(text) == mark
    middle = text[:2000] + " inserted words " + text[2000:]
    assert fp.likeness(mark, fp.fingerprint(middle)) > 0.85
    assert fp.likeness(mark, fp.fingerprint(prose(2, 700))) < 0.2
    assert 0.4 < fp.likeness(mark, fp.fingerprint(fp.edited(text, prose(3, 700)))) < 0.95
    assert fp.likeness(mark, fp.fingerprint("short")) == 0.0 and fp.likeness("3::", "3::") == 1.0


def test_chunk_hash_does_not_depend_on_the_place(monkeypatch):
    chunk = np.frombuffer(b"the same chunk of bytes", np.uint8)
    lead = np.frombuffer(b"x" * 150_000, np.uint8)
    data = np.concatenate([chunk, lead, chunk])
    ends = np.array([len(chunk) - 1, len(chunk) + len(lead) - 1, len(data) - 1])
    hashes = fp._chunk_hashes(data, ends)
    assert hashes[0] == hashes[2] != hashes[1]


def test_common_length_is_the_longest_common_subsequence():
    draw = random.Random(3)

    def brute(a, b):
        row = [0] * (len(b) + 1)
        for x in a:
            last = 0
            for j, y in enumerate(b, 1):
                row[j], last = (last + 1 if x == y else max(row[j], row[j - 1])), row[j]
        return row[-1]

    for _ in range(300):
        a, b = ("".join(draw.choice("abcd") for _ in range(draw.randint(0, 64))) for _ in range(2))
        assert fp._common_length(a, b) == brute(a, b)


@pytest.mark.parametrize("ranges", [1, 3, 40])
def test_next_documents_in_descending_order(docs_of, ranges):
    rows = [(i * 7 - 50, prose(i, 30 + i)) for i in range(60)]
    rows += [(10**15 + 1, "é" * 50), (5000, None), (5001, ""), (5002, "x"), (5002, "a"), (9007199254740993, "big"), (None, "no number")]
    order = sorted(rows, key=lambda r: (-(r[0] if r[0] is not None else -(10**18)), r[1] or ""))
    want = []
    for i, (d, t) in enumerate(order):
        t, follow = t or "", order[(i + 1) % len(order)][1] or ""
        n = len(t) // 3
        changed = t[: len(t) - n] + follow[:n]
        marks = [fp.fingerprint(x) for x in (t, changed, follow)]
        want.append((d, len(t), hashlib.sha256(changed.encode()).hexdigest(), marks[0], marks[1], fp.likeness(marks[0], marks[1]), fp.likeness(marks[0], marks[2])))
    got = [tuple(r) for r in fp.with_next(docs_of(rows), ranges).collect()]
    assert sorted(got, key=str) == sorted(want, key=str)


def test_next_of_few_documents(docs_of):
    assert fp.with_next(docs_of([])).collect() == []
    one = fp.with_next(docs_of([(0, "abcdef")])).collect()
    assert len(one) == 1 and one[0].near_next == 1.0
    assert len(fp.with_next(docs_of([(None, "abc"), (None, None)])).collect()) == 2


def words(text):
    return re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(LOWER))


def shingle_set(text, size):
    w = words(text)
    if not w:
        return frozenset()
    return frozenset(tuple(w[i : i + size]) for i in range(len(w) - size + 1)) or frozenset([tuple(w)])


def brute_components(rows, size, percent):
    sets = {}
    for d, t in rows:
        if d is not None:
            sets.setdefault(d, []).append(shingle_set(t, size))
    parent = {d: d for d in sets}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    ids = sorted(sets)
    for i, a in enumerate(ids):
        for b in ids[:i]:
            if any(s and t and 100 * len(s & t) >= percent * len(s | t) for s in sets[a] for t in sets[b]):
                x, y = root(a), root(b)
                parent[max(x, y)] = min(x, y)
    return sorted([(d, len(shingle_set(t, size)), None if d is None else root(d)) for d, t in rows], key=str)


def mutated(text, changes, seed):
    draw, w = random.Random(seed), text.split()
    for _ in range(changes):
        w[draw.randrange(len(w))] = f"new{draw.randint(0, 10**6)}"
    return " ".join(w)


def near_rows():
    rows = []
    for base in range(6):
        text = prose(base, 40 * (base + 1))
        rows += [(1000 * base + i, mutated(text, i % 9, 100 * base + i)) for i in range(25)]
    passage = prose(77, 60)
    rows += [(20000 + i, prose(500 + i, 25) + " " + passage + " " + prose(900 + i, 10)) for i in range(40)]
    rows += [(30000 + i, prose(3, 120).upper() if i % 2 else prose(3, 120)) for i in range(12)]
    rows += [(40000, None), (40001, ""), (40002, " \n "), (40003, "one two"), (40004, "ONE\ttwo"), (40005, "one two three"), (None, "one two")]
    rows += [(40006, "é É"), (40007, "É é"), (40008, prose(9, 6000)), (40009, mutated(prose(9, 6000), 30, 1)), (40003, "one two")]
    return rows


@pytest.mark.parametrize("size,percent", [(4, 85), (2, 50)])
def test_components_equal_brute_force(docs_of, monkeypatch, size, percent):
    monkeypatch.setattr(jj, "SMALL_CELL", 3)
    monkeypatch.setattr(jj, "LEAF_ROWS", 4)
    monkeypatch.setattr(jj, "CELL_ROWS", 12)
    rows = near_rows()
    got = jj.near_duplicates(docs_of(rows, 4), size, percent).collect()
    assert sorted([tuple(r) for r in got], key=str) == brute_components(rows, size, percent)


def test_default_cells_give_the_same(docs_of):
    rows = near_rows()
    got = jj.near_duplicates(docs_of(rows, 4), 4, 85).collect()
    assert sorted([tuple(r) for r in got], key=str) == brute_components(rows, 4, 85)


def test_order_of_the_prefix_decides_nothing(docs_of, monkeypatch):
    monkeypatch.setattr(jj, "SKETCH", 64)
    monkeypatch.setattr(jj, "SKETCH_BLOCKS", 4)
    monkeypatch.setattr(jj, "COUNT_BATCH", 500)
    rows = near_rows()
    got = jj.near_duplicates(docs_of(rows, 1), 4, 85).collect()
    assert sorted([tuple(r) for r in got], key=str) == brute_components(rows, 4, 85)


def test_ranks_grow_with_the_number_of_texts(docs_of, monkeypatch):
    monkeypatch.setattr(jj, "COUNT_BATCH", 300)
    rows = [(i, "the same words here " + prose(i, 20)) for i in range(60)] + [(100, None), (101, "the same words here")]
    ranks = jj.shingle_ranks(docs_of(rows, 5), 4)
    common, rare = jj.shingles("the same words here", 4), jj.shingles(prose(3, 20), 4)
    assert len(ranks) == jj.SKETCH and ranks[jj._slot(common, jj.SKETCH)].min() > 60 and ranks[jj._slot(rare, jj.SKETCH)].max() <= 24


def test_one_of_each_group(docs_of):
    rows = near_rows()
    kept = [r.doc_id for r in jj.one_of_each(docs_of(rows), 4, 85).collect()]
    want = {c for d, _, c in brute_components(rows, 4, 85) if d is not None}
    assert sorted(d for d in kept if d is not None) == sorted(want) and kept.count(None) == 1
    shared = [(7, prose(1, 40)), (7, prose(2, 40)), (7, prose(1, 40)), (8, prose(3, 40))]
    texts = sorted((r.doc_id, r.text) for r in jj.one_of_each(docs_of(shared), 4, 85).collect())
    assert texts == sorted(set(shared))
    assert jj.near_duplicates(docs_of([])).collect() == []
    assert [tuple(r) for r in jj.near_duplicates(docs_of([(1, "a"), (2, "b")])).orderBy("doc_id").collect()] == [(1, 1, 1), (2, 1, 2)]


def test_word_hashes_over_slices(monkeypatch):
    text = " ".join(f"Word{i % 50}É" for i in range(400)) + " " + "y" * 500 + " tail"
    whole = jj.word_hashes(text)
    assert len(whole) == 402 and len(set(whole.tolist())) == 52
    monkeypatch.setattr(jj, "_SLICE", 64)
    cut = jj.word_hashes(text)
    assert cut[:400].tolist() == whole[:400].tolist() and cut[401] == whole[401]
    assert jj.word_hashes("A b").tolist() == jj.word_hashes("a\tB").tolist()
    assert jj.word_hashes("É").tolist() != jj.word_hashes("é").tolist()


def test_counts_are_packed_without_loss():
    for top in (3, 15, 16, 255, 256, 70000):
        counts = np.random.default_rng(top).integers(0, top + 1, 64)
        counts[5] = top
        assert jj._vector(jj.packed(counts), 100, 64).tolist() == counts.tolist()


def test_bound_is_never_below_the_overlap():
    draw = np.random.default_rng(1)
    for _ in range(100):
        pool = draw.integers(0, 1 << 63, 900, dtype=np.uint64) * np.uint64(2)
        a = np.unique(pool[: draw.integers(1, 900)])
        b = np.unique(pool[draw.integers(0, 800) :])
        groups = min(jj.n_groups(len(a)), jj.n_groups(len(b)))
        p, q = (jj._vector(jj.packed(jj.count_vector(x)), len(x), groups) for x in (a, b))
        assert np.minimum(p, q).sum() >= len(np.intersect1d(a, b))


def test_cells_need_an_early_shingle(spark):
    # 100 shingles, 80 %: a prefix of 21, and an overlap of 89 at least, so that a pair meets in the first 12 of one set.
    def rep(doc_id, n, length, **shared):
        prefix = [1000 * doc_id + i for i in range(length)]
        for token, place in shared.items():
            prefix[place] = -int(token[1:])
        return doc_id, n, prefix

    rows = [
        rep(1, 100, 21, t1=20, t2=11, t3=12, t5=19),
        rep(2, 100, 21, t1=18, t2=19, t3=20),
        rep(3, 90, 19, t5=9),  # early in the smaller set only
    ]
    reps = spark.createDataFrame(rows, "doc_id long, n long, prefix array<long>")
    cells = {(r.token, r.doc_id) for r in jj._cells(reps, 80).collect()}
    assert cells == {(-2, 1), (-2, 2), (-5, 1), (-5, 3)}


def test_star_contraction_makes_no_broadcasts(spark, monkeypatch):
    plans, written = [], jj.written

    def kept(df, name):
        plans.append(df._jdf.queryExecution().executedPlan().toString())
        return written(df, name)

    monkeypatch.setattr(jj, "written", kept)
    edges = spark.createDataFrame([(1, 2), (2, 3), (3, 4), (7, 9)], "a long, b long")
    assert sorted(map(tuple, jj.components(edges).collect())) == [(2, 1), (3, 1), (4, 1), (9, 7)]
    assert any("SortMergeJoin" in p for p in plans) and not any("Broadcast" in p for p in plans)
