"""Periodic runs against comparison of all words for all periods."""

from __future__ import annotations

import hashlib
import random
import zlib

import numpy as np
import pytest

from rulewell.llm import periodic_runs as pr

LETTERS = [bytes([c]) for c in range(97, 123)]


def brute_runs(ids):
    n, out = len(ids), []
    for q in range(1, n // 4 + 1):
        at = 0
        while at + q < n:
            if ids[at] != ids[at + q]:
                at += 1
                continue
            end = at
            while end + q < n and ids[end] == ids[end + q]:
                end += 1
            length = end - at + q
            s = ids[at : at + length]
            if length >= max(6, 4 * q) and not any(all(s[i] == s[i + d] for i in range(length - d)) for d in range(1, q)):
                out.append((at, length, q))
            at = end
    return sorted(out, key=lambda r: (r[0], r[2]))


def brute_row(doc_id, text, damage=True):
    words = (text or "").encode().split()
    n = len(words)
    h = 0 if doc_id is None else zlib.crc32(str(doc_id).encode())
    if damage and doc_id is not None and h % 10 == 0 and n:
        a = (h // 10) % n
        p = 1 + (n - a) // (3 + (h // 10) % 8)
        words = [words[i] if i < a else words[a + (i - a) % p] for i in range(n)]
    runs = brute_runs(words)
    dropped = {i for s, length, q in runs for i in range(s + q, s + length)}
    best = min(runs, key=lambda r: (-r[1] / r[2], r[0], r[2])) if runs else (None, None, None)
    listed = "".join(f"{s},{n},{q}\n" for s, n, q in runs)
    kept = b" ".join(w for i, w in enumerate(words) if i not in dropped)
    milli = 1000 * best[1] // best[2] if runs else None
    return (doc_id, len(runs), *best, milli, hashlib.sha256(listed.encode()).hexdigest(), hashlib.sha256(kept).hexdigest())


def periodic_words(draw, most=150):
    n, letters = draw.randint(0, most), draw.choice([1, 2, 3, 5, 26])
    words = [LETTERS[draw.randrange(letters)] for _ in range(n)]
    for _ in range(draw.randint(0, 4)):
        if n > 8:
            p, s = draw.randint(1, n // 5 or 1), draw.randrange(n)
            for i in range(s + p, min(n, s + draw.randint(1, 7) * p + draw.randint(0, p))):
                words[i] = words[i - p]
    return words


def stitched(words, block):
    held = {}
    for q, lo, hi in pr.fragments(pr.numbered(words), block):
        held.setdefault(q, []).append((lo, hi))
    out = []
    for q, spans in held.items():
        spans.sort()
        whole = [list(spans[0])]
        for lo, hi in spans[1:]:
            if lo <= whole[-1][1]:
                whole[-1][1] = max(whole[-1][1], hi)
            else:
                whole.append([lo, hi])
        out += [(lo, q, hi - lo + q) for lo, hi in whole if hi - lo >= pr.least_interval(q)]
    return [(s, n, q) for s, q, n in pr._primitive(out)]


@pytest.mark.parametrize("block", [2, 16, 1 << 16])
def test_tiles_find_all_runs(block):
    draw = random.Random(block)
    for _ in range(600):
        words = periodic_words(draw)
        assert sorted(stitched(words, block), key=lambda r: (r[0], r[2])) == brute_runs(words), words


def test_long_texts_in_many_blocks():
    for period in (1, 3, 700):
        ids = np.concatenate([np.arange(50_000) % period, -1 - np.arange(20_000)])
        found = stitched([str(i).encode() for i in ids.tolist()], 1 << 12)
        assert found == [(0, 50_000, period)]


def rows():
    draw = random.Random(8)
    out = [(i * 13 - 40, b" ".join(periodic_words(draw)).decode()) for i in range(250)]
    out += [(5000, None), (5001, ""), (5002, " \n\t "), (5003, "a a a a a a"), (5003, "a a a a a"), (5003, "a a a a a a"), (None, "b b b b b b b"), (None, None)]
    out += [(9007199254740993, "x y " * 9), (5004, "a a a a a a a a a a a a"), (5005, "é É " * 6), (5006, "A a " * 6)]
    ten = [i for i in range(9000, 9400) if zlib.crc32(str(i).encode()) % 10 == 0]
    return out + [(i, " ".join(f"w{j * j % 97}" for j in range(i % 190))) for i in ten]


@pytest.mark.parametrize("block", [8, 1 << 16])
def test_query_equals_brute_force(docs_of, monkeypatch, block):
    monkeypatch.setattr(pr, "BLOCK_WORDS", block)
    found = rows()
    got = [tuple(r) for r in pr.digests(docs_of(found, 4), pr.repeated_tail).collect()]
    assert sorted(got, key=str) == sorted([brute_row(*r) for r in found], key=str)


def test_runs_without_damage(docs_of):
    got = pr.runs(docs_of([(1, "a b " * 5 + "c " * 7), (2, "nothing here"), (1, "other words")])).collect()
    assert sorted(tuple(r) for r in got) == [(1, 0, 10, 2), (1, 10, 7, 1)]
    assert pr.runs(docs_of([])).collect() == [] and pr.digests(docs_of([])).collect() == []


def test_z_function():
    draw = random.Random(3)
    for _ in range(300):
        s = [draw.randrange(2) for _ in range(draw.randint(0, 40))]
        want = [next((k for k in range(len(s) - i) if s[k] != s[i + k]), len(s) - i) for i in range(len(s))]
        assert pr.z_function(s) == want
