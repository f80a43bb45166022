"""Conversation repair against a search over all edits."""

from __future__ import annotations

import hashlib
import heapq
import random
import re
import zlib
from collections import Counter

import pytest
from pyspark.sql import types as T

from rulewell.llm import conversation_repair as cr

ROWS = T.StructType(
    [T.StructField("conv_id", T.LongType()), T.StructField("turn", T.LongType()), T.StructField("role", T.StringType()), T.StructField("text", T.StringType())]
)


@pytest.fixture(scope="module")
def rows_of(spark):
    def make(rows, partitions=3):
        frame = spark.createDataFrame(rows, ROWS).repartition(partitions)
        return frame.selectExpr("*", "'x' as conv", "1 as part", "2 as copy", "'y' as symbols", "3 as n")

    return make


def search(rows):
    """Cheapest, then least audit and its rows, by best-first search over edits of (role, text, fault)."""
    heap = [(0, "", 0, "", [])]
    settled = set()
    while heap:
        cost, audit, at, roles, out = heapq.heappop(heap)
        state = (at, roles[-1:] if roles else "", roles[:1] == "s" and len(roles) == 1)
        if at == len(rows) and re.fullmatch("(s?(ua)+)?", roles):
            return cost, audit, out
        if (state, audit) in settled or len(roles) > len(rows) + 4:
            continue
        settled.add((state, audit))

        def move(extra, edit, at, role, text, cost=cost, audit=audit, roles=roles, out=out):
            new = roles + role[:1]
            if re.fullmatch("s?(ua)*u?", new):
                heapq.heappush(heap, (cost + extra, audit + edit, at, new, [*out, f"{role}:{text}"]))

        if at < len(rows):
            role, text, fault = rows[at]
            heapq.heappush(heap, (cost + 2, audit + "D", at + 1, roles, out))
            if fault not in ("blank", "duplicate"):
                more = 5 if fault == "truncated" else 0
                if role[:1] in ("s", "u", "a"):
                    move(more, "K", at + 1, role, text)
                move(1 + more, "R", at + 1, "user", text)
                move(1 + more, "R", at + 1, "assistant", text)
        move(5, "I", at, "user", "")
        move(5, "I", at, "assistant", "")
    raise AssertionError


def brute(rows, damage):
    """All result columns, conversation by conversation."""
    held, every = {}, {r[0] for r in rows}
    for conv, turn, role, text in rows:
        role, text = (" " if role is None else role), (" " if text is None else text)
        copies = 1
        if damage:
            kind = zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20
            if kind == 0:
                continue
            text = "" if kind == 1 else re.sub("[.!?]", "", text) if kind == 2 else text
            copies, role = (2 if kind == 3 else 1), ("user" if kind == 4 else role)
        held.setdefault(conv, []).extend([(turn, role, text)] * copies)
    want = []
    for conv in every:
        own = sorted(held.get(conv, []), key=lambda r: (r[0] is not None, r[0] or 0, r[1].encode(), hashlib.sha256(r[2].encode()).hexdigest()))
        seen, faulty, counts = set(), [], Counter()
        for _, role, text in own:
            solid = re.sub(r"[\x20\x09-\x0D]+$", "", text)
            fault = "blank" if not solid else "duplicate" if (role, text) in seen else "" if solid[-1] in ".!?" else "truncated"
            seen.add((role, text))
            counts[fault] += 1
            faulty.append((role, text, fault))
        turns = [t for t, _, _ in own if t is not None]
        gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
        illegal = sum(a[1][:1] + b[1][:1] not in ("su", "ua", "au") for a, b in zip(own, own[1:], strict=False))
        cost, audit, out = search(faulty)
        digest = hashlib.sha256("\n".join(out).encode()).hexdigest()
        want.append((conv, gaps, counts["blank"], counts["duplicate"], counts["truncated"], illegal, cost, audit, digest))
    return sorted(want, key=str)


def some_rows(seed, conversations=150):
    draw = random.Random(seed)
    texts = ["Yes.", "No!", "Why?  ", "It broke off", "and", "", " \n", None, "é.", "one\ntwo."]
    rows = []
    for conv in range(conversations):
        roles = draw.choice([["user", "assistant"], ["user", "assistant", "system"], ["user", "assistant", "tool", "", None]])
        for turn in range(draw.randint(1, 7)):
            text = f"Text {conv} {turn}." if draw.random() < 0.5 else draw.choice(texts)
            role = ("user", "assistant")[turn % 2] if draw.random() < 0.6 else draw.choice(roles)
            rows.append((conv, draw.choice([turn, turn, turn, turn + 3, None]), role, text))
    rows += [(None, 0, "user", "Hello."), (None, 1, "assistant", "Hello."), (9007199254740993, 9007199254740993, "user", "Large.")]
    rows += [(777, 4, "user", "Same."), (777, 4, "user", "Same."), (777, 5, "assistant", "Reply.")] + [(778, None, None, None)] * 2
    return rows


@pytest.mark.parametrize("damage", [False, True])
def test_repair_equals_a_search(rows_of, damage):
    rows = some_rows(5 + damage)
    table = rows_of(rows)
    got = cr.digests(cr.damaged(table) if damage else table, every=table).collect()
    assert sorted([tuple(r) for r in got], key=str) == brute(rows, damage)


def test_few_rules_give_the_same(rows_of, monkeypatch):
    monkeypatch.setattr(cr, "MAX_RULES", 3)
    rows = some_rows(9, 60)
    got = cr.digests(rows_of(rows, 1)).collect()
    assert sorted([tuple(r) for r in got], key=str) == brute(rows, False)


def test_repaired_rows_are_what_is_hashed(rows_of):
    rows = some_rows(11, 40)
    lines = {}
    for r in cr.repaired(rows_of(rows)).orderBy("conv_id", "place").collect():
        lines.setdefault(r.conv_id, []).append((r.place, f"{r.role}:{r.text}"))
    for r in cr.digests(rows_of(rows)).collect():
        own = lines.get(r.conv_id, [])
        assert [p for p, _ in own] == list(range(len(own)))
        assert hashlib.sha256("\n".join(t for _, t in own).encode()).hexdigest() == r.repaired_sha256


def test_empty_tables_and_lost_conversations(rows_of):
    assert cr.digests(rows_of([])).collect() == [] and cr.repaired(rows_of([])).collect() == []
    lost = next(i for i in range(200) if zlib.crc32(f"{i}:0".encode()) % 20 == 0)
    table = rows_of([(lost, 0, "user", "Hi.")])
    got = cr.digests(cr.damaged(table), every=table).collect()
    assert [tuple(r) for r in got] == [(lost, 0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest())]


def test_long_conversation(rows_of):
    """Far more rows than a batch holds; one answer is missing in the middle, so one of two questions goes."""
    rows = [(1, i, ("user", "assistant")[i % 2], f"Text {i} " + "long " * 20 + ".") for i in range(25_000)]
    del rows[12_001]
    got = cr.digests(rows_of(rows)).collect()[0]
    assert (got.gaps, got.illegal, got.cost) == (1, 1, 2) and got.audit == "K" * 12_000 + "D" + "K" * 12_998
    kept = [f"{r}:{t}" for at, (_, _, r, t) in enumerate(rows) if at != 12_000]
    assert got.repaired_sha256 == hashlib.sha256("\n".join(kept).encode()).hexdigest()


def test_grammar_shares_matrices_and_keeps_results():
    draw = random.Random(2)
    texts = ["".join(draw.choice("xsuaoSUAO") for _ in range(draw.randint(0, 30))) for _ in range(200)] + ["ua" * 500, "u" * 501]
    counts = Counter()
    for t in texts:
        cr.pair_counts(t, counts)
    rules = cr.apart(counts.most_common(20))
    second = Counter()
    for t in texts:
        cr.pair_counts(cr.Grammar(rules).compressed(t), second)
    grammar = cr.Grammar(rules + cr.apart(second.most_common(60)))
    plain = cr.Grammar()
    assert any(ord(a) >= cr.FIRST_RULE or ord(b) >= cr.FIRST_RULE for a, b in grammar.rules)
    for t in texts:
        assert grammar.cheapest(t) == plain.cheapest(t)
        assert len(grammar.compressed(t)) <= len(t)


def test_rope_order_is_that_of_strings():
    draw = random.Random(4)

    def rope(text):
        if len(text) < 2 or draw.random() < 0.3:
            return cr.Rope(text)
        cut = draw.randrange(len(text) + 1)
        return cr.joined(rope(text[:cut]), rope(text[cut:]))

    for _ in range(2000):
        a, b = ("".join(draw.choice("DI") for _ in range(draw.randint(0, 6))) for _ in range(2))
        assert cr.precedes(rope(a), rope(b)) == (a < b) and str(rope(a)) == a


def test_pair_counts_do_not_overlap():
    counts = Counter()
    cr.pair_counts("aaaaabab", counts)
    assert counts == {"aa": 2, "ab": 2, "ba": 1}
    assert cr.apart([("ab", 9), ("bc", 8), ("ca", 7), ("aa", 6), ("ad", 5), ("dd", 4), ("ee", 3)]) == ["ab", "ad", "ee"]
