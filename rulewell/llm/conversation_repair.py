"""Cheapest repair of conversation structure by dynamic programming over a shared grammar.

A conversation is read as a sequence of symbols, one a row: what the row must not stay for (blank, or
seen before), else its role initial and whether its text breaks off. Its roles have to read as an
optional system row and one or more user-assistant turns, or as nothing. Four states say what stands
so far (nothing, a system row, a user row, an assistant row), and a symbol is a four by four matrix
over (cost, audit): keep, rerole or delete the row, after any insertions. Matrices multiply in the
min-plus way; of equal costs the audit that is least in ASCII wins.

Sequences repeat, within a conversation and across them. Re-Pair rules, learned over all distinct
sequences, stand for pairs of symbols; a rule's matrix is the product of its two parts and is made once
a task, bottom-up, and its audits are ropes that share the parts' audits. A sequence is the product of
the few symbols that its compressed form has. Equal sequences are one row, solved once.

On a cluster. Rows go to their conversation twice: first without their texts (roles, turns, digests) for
the symbols, then with them and the audit for the result. Both passes stream sorted partitions and hold
one conversation's symbols or audit, a byte a row, never its texts; the audit is a column of the result,
so that much is there in any case. A SHA-256 over a conversation's texts has no parallel form.

Rows of equal turn stand in the order of role, then of the SHA-256 of their text. Null roles and texts
count as one space; rows without a conv_id are one conversation; rows without a turn come first. Rows
repeated in the input are rows like others, so all but the first are duplicates. An empty table gives
no conversations. Other columns are left out.
"""

from __future__ import annotations

import hashlib
from collections import Counter
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from rulewell.session import written

KEEP, REROLE, DELETE, INSERT = "K", "R", "D", "I"
COST = {KEEP: 0, REROLE: 1, DELETE: 2, INSERT: 5}
BROKEN_COST = 5
# Symbols: a row that must go; whole rows by role (system, user, assistant, other), and broken-off ones.
GONE, WHOLE, BROKEN = "x", "suao", "SUAO"
# At most so many rules, learned in so many passes over the distinct sequences. They bound what the
# driver holds and the tasks receive; a sequence that rules do not cover is multiplied symbol by symbol.
MAX_RULES, MAX_PASSES, RULES_A_PASS = 1024, 12, 128
FIRST_RULE = 0x4E00

NOTHING, SYSTEM, USER, ASSISTANT = range(4)
FOLLOWING = {NOTHING: USER, SYSTEM: USER, USER: ASSISTANT, ASSISTANT: USER}
KEPT = {"s": {NOTHING: SYSTEM}, "u": {NOTHING: USER, SYSTEM: USER, ASSISTANT: USER}, "a": {USER: ASSISTANT}, "o": {}}
ACCEPTED = (NOTHING, ASSISTANT)
ROLE = {USER: "user", ASSISTANT: "assistant"}


class Rope:
    """A string as a tree of shared parts."""

    __slots__ = ("left", "right", "text")

    def __init__(self, text: str = "", left: Rope | None = None, right: Rope | None = None):
        self.text, self.left, self.right = text, left, right

    def parts(self) -> Iterator[str]:
        stack = [self]
        while stack:
            node = stack.pop()
            if node.left is None:
                if node.text:
                    yield node.text
            else:
                stack += [node.right, node.left]

    def __str__(self) -> str:
        return "".join(self.parts())


EMPTY = Rope()


def joined(a: Rope, b: Rope) -> Rope:
    if a is EMPTY:
        return b
    return a if b is EMPTY else Rope("", a, b)


def precedes(a: Rope, b: Rope) -> bool:
    """Whether a stands before b in ASCII order; parts that both share are skipped, not read."""
    one, two = [a], [b]
    while one and two:
        x, y = one.pop(), two.pop()
        if x is y:
            continue
        if x.left is not None:
            one += [x.right, x.left]
            two.append(y)
        elif y.left is not None:
            one.append(x)
            two += [y.right, y.left]
        else:
            n = min(len(x.text), len(y.text))
            if x.text[:n] != y.text[:n]:
                return x.text[:n] < y.text[:n]
            if len(x.text) > n:
                one.append(Rope(x.text[n:]))
            if len(y.text) > n:
                two.append(Rope(y.text[n:]))
    return not one and any(node.left is not None or node.text for node in two)


Matrix = dict[tuple[int, int], tuple[int, Rope]]


def offer(cells: Matrix, place: tuple[int, int], cost: int, audit: Rope) -> None:
    """Keep the cheaper of what is there and what is offered, of equal costs the earlier audit.

    Two audits of one cell and cost are never prefixes of each other, as the rest of the longer one
    would be insertions, which cost; so the order of parts decides the order of wholes.
    """
    held = cells.get(place)
    if held is None or cost < held[0] or (cost == held[0] and precedes(audit, held[1])):
        cells[place] = (cost, audit)


def product(a: Matrix, b: Matrix) -> Matrix:
    out: Matrix = {}
    for (p, r), (cost, audit) in a.items():
        for q in range(4):
            step = b.get((r, q))
            if step is not None:
                offer(out, (p, q), cost + step[0], joined(audit, step[1]))
    return out


def insertions() -> Matrix:
    """Ways between states by insertions alone, none included."""
    out: Matrix = {}
    for start in range(4):
        state, cost, audit = start, 0, EMPTY
        while (start, state) not in out:
            out[(start, state)] = (cost, audit)
            state, cost, audit = FOLLOWING[state], cost + COST[INSERT], joined(audit, Rope(INSERT))
    return out


def symbol_matrix(symbol: str) -> Matrix:
    edits: Matrix = {}
    for state in range(4):
        offer(edits, (state, state), COST[DELETE], Rope(DELETE))
        if symbol == GONE:
            continue
        extra = BROKEN_COST if symbol in BROKEN else 0
        offer(edits, (state, FOLLOWING[state]), COST[REROLE] + extra, Rope(REROLE))
        after = KEPT[symbol.lower()].get(state)
        if after is not None:
            offer(edits, (state, after), COST[KEEP] + extra, Rope(KEEP))
    return product(insertions(), edits)


class Grammar:
    """Re-Pair rules in the order they were made, and their transfer matrices."""

    def __init__(self, rules: list[str] = ()):
        self.rules = list(rules)
        self._matrices: dict[str, Matrix] = {}

    def compressed(self, symbols: str, since: int = 0) -> str:
        for number, pair in enumerate(self.rules[since:], since):
            symbols = symbols.replace(pair, chr(FIRST_RULE + number))
        return symbols

    def matrix(self, symbol: str) -> Matrix:
        if not self._matrices:
            self._matrices = {s: symbol_matrix(s) for s in GONE + WHOLE + BROKEN}
            for number, (a, b) in enumerate(self.rules):  # parts are made before what they are part of
                self._matrices[chr(FIRST_RULE + number)] = product(self._matrices[a], self._matrices[b])
        return self._matrices[symbol]

    def cheapest(self, symbols: str) -> tuple[int, str]:
        """The least cost and its audit; an empty sequence costs nothing."""
        ways: Matrix = {(NOTHING, NOTHING): (0, EMPTY)}
        for symbol in self.compressed(symbols):
            ways = product(ways, self.matrix(symbol))
        best: Matrix = {}
        for (_, state), (cost, audit) in product(ways, insertions()).items():
            if state in ACCEPTED:
                offer(best, (0, 0), cost, audit)
        cost, audit = best[(0, 0)]
        return cost, str(audit)


def pair_counts(symbols: str, counts: Counter) -> None:
    """Adds how often each pair could be replaced; 'aaa' holds 'aa' once."""
    last = -2
    for at, pair in enumerate(zip(symbols, symbols[1:], strict=False)):
        if pair[0] == pair[1] and last == at - 1:
            last = -2
            continue
        counts["".join(pair)] += 1
        last = at if pair[0] == pair[1] else -2


def apart(pairs: list[tuple[str, int]]) -> list[str]:
    """The most frequent pairs of which none begins with another's end: they never overlap in a text."""
    begins, ends, chosen = set(), set(), []
    for pair, _ in pairs:
        a, b = pair
        if a in ends or b in begins or (a == b and (a in begins or b in ends)):
            continue
        chosen.append(pair)
        begins.add(a)
        ends.add(b)
    return chosen


def learned(sequences: DataFrame) -> Grammar:
    """Rules for the pairs that stand twice or more in the distinct ``sequences`` (column symbols).

    Each pass compresses the sequences by the rules so far, counts pairs in the tasks, adds the counts
    up by pair, and takes the most frequent ones that cannot overlap. Ties go by pair.
    """
    grammar = Grammar()

    for _ in range(MAX_PASSES):
        rules = list(grammar.rules)

        def count(batches: Iterator[pd.DataFrame], rules: list[str] = rules) -> Iterator[pd.DataFrame]:
            held, counts = Grammar(rules), Counter()
            for batch in batches:
                for symbols in batch["symbols"]:
                    pair_counts(held.compressed(symbols), counts)
            if counts:
                yield pd.DataFrame({"pair": list(counts.keys()), "n": list(counts.values())})

        found = sequences.select("symbols").mapInPandas(count, "pair string, n long").groupBy("pair").agg(F.sum("n").alias("n"))
        room = min(RULES_A_PASS, MAX_RULES - len(rules))
        top = found.where("n >= 2").orderBy(F.desc("n"), "pair").limit(room).collect()
        if not top:
            break
        grammar = Grammar(rules + apart([(r["pair"], r["n"]) for r in top]))
        if len(grammar.rules) >= MAX_RULES:
            break
    return grammar


def damaged(rows: DataFrame) -> DataFrame:
    """Seeded faults for tests of a repair: conv_id, turn, role, text, with rows lost, emptied, cut, doubled.

    crc32 of ``conv_id:turn`` modulo 20 decides: 0 drops a row, 1 empties its text, 2 takes its . ! ?
    away, 3 doubles it, 4 makes its role user. Nulls count as one space.
    """
    word = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    kind = F.crc32(F.concat(word("conv_id"), F.lit(":"), word("turn"))) % 20
    text = F.when(kind == 1, F.lit("")).when(kind == 2, F.translate(word("text"), ".!?", "")).otherwise(word("text"))
    role = F.when(kind == 4, F.lit("user")).otherwise(word("role"))
    copies = F.explode(F.when(kind == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0))))
    kept = rows.select("conv_id", "turn", role.alias("role"), text.alias("text"), kind.alias("kind")).where("kind <> 0")
    return kept.select("conv_id", "turn", "role", "text", copies.alias("copy")).drop("copy")


def _key() -> Column:
    """The conversation as text, one space for none, so that no number passes through a float."""
    return F.coalesce(F.col("conv_id").cast("string"), F.lit(" "))


def _prepared(rows: DataFrame) -> DataFrame:
    text, role = F.coalesce(F.col("text"), F.lit(" ")), F.coalesce(F.col("role"), F.lit(" "))
    return rows.select(_key().alias("conv"), F.col("turn").cast("long").alias("turn"), role.alias("role"), text.alias("text"), F.sha2(text, 256).alias("digest"))


def _symbols(rows: DataFrame) -> DataFrame:
    """(conv, turn, role, digest, symbol, fault) of every row, in conversation partitions."""
    solid = F.btrim("text", F.lit(" \t\n\x0b\f\r"))
    slim = _prepared(rows).select(
        "conv", "turn", "role", "digest", (solid == "").alias("blank"), (~F.substring(solid, -1, 1).isin(".", "!", "?")).alias("broken")
    )
    # One shuffle; both orders are sorts within the partitions.
    seen = Window.partitionBy("conv", "role", "digest").orderBy(F.asc_nulls_first("turn"))
    numbered = slim.repartition("conv").withColumn("again", F.row_number().over(seen) > 1)
    fault = F.when(F.col("blank"), 1).when(F.col("again"), 2).when(F.col("broken"), 3).otherwise(0)
    initial = F.substring("role", 1, 1)
    whole = F.when(initial.isin("s", "u", "a"), initial).otherwise("o")
    symbol = F.when(fault.isin(1, 2), F.lit(GONE)).when(fault == 3, F.upper(whole)).otherwise(whole)
    return numbered.select("conv", "turn", "role", "digest", symbol.alias("symbol"), fault.alias("fault"), initial.alias("initial"))


def _in_order(rows: DataFrame, *first: str) -> DataFrame:
    order = [F.asc_nulls_first("turn"), "role", "digest"]
    return rows.sortWithinPartitions("conv", *first, *order)


_READ = "conv string, symbols string, gaps long, blank long, duplicate long, truncated long, illegal long"


def sequences(rows: DataFrame) -> DataFrame:
    """Per conversation: its symbols in order, the gaps in its turns, and its faults by kind."""

    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        conv, symbols, counts, last, turns = None, [], [0] * 4, None, [None, None, 0]
        illegal = 0

        def row() -> tuple:
            first, final, distinct = turns
            gaps = 0 if first is None else final - first + 1 - distinct
            return (conv, "".join(symbols), gaps, *counts[1:], illegal)

        for batch in batches:
            done = []
            columns = (batch[c].tolist() for c in ("conv", "turn", "symbol", "fault", "initial"))
            for key, turn, symbol, fault, initial in zip(*columns, strict=True):
                if key != conv:
                    if conv is not None:
                        done.append(row())
                    conv, symbols, counts, last, turns, illegal = key, [], [0] * 4, None, [None, None, 0], 0
                symbols.append(symbol)
                counts[fault] += 1
                if last is not None and last + initial not in ("su", "ua", "au"):
                    illegal += 1
                last = initial
                if turn is not None:
                    turn = int(turn)
                    if turn != turns[1]:
                        turns = [turn if turns[0] is None else turns[0], turn, turns[2] + 1]
            yield pd.DataFrame(done, columns=[c.split()[0] for c in _READ.split(", ")])
        if conv is not None:
            yield pd.DataFrame([row()], columns=[c.split()[0] for c in _READ.split(", ")])

    # Turns travel as text: a null among long numbers would make them floats.
    ordered = _in_order(_symbols(rows)).withColumn("turn", F.col("turn").cast("string"))
    return ordered.select("conv", "turn", "symbol", "fault", "initial").mapInPandas(read, _READ)


def audits(found: DataFrame) -> DataFrame:
    """(symbols, cost, audit) for every distinct sequence of ``found``."""
    distinct = written(found.select("symbols").distinct(), "sequences")
    rules = learned(distinct).rules

    def solve(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        grammar = Grammar(rules)
        for batch in batches:
            solved = [grammar.cheapest(s) for s in batch["symbols"]]
            yield pd.DataFrame({"symbols": batch["symbols"], "cost": [c for c, _ in solved], "audit": [a for _, a in solved]})

    return distinct.mapInPandas(solve, "symbols string, cost long, audit string")


def assessed(rows: DataFrame, every: DataFrame | None = None) -> DataFrame:
    """Per conversation: gaps, blank, duplicate, truncated, illegal, cost, audit; written.

    ``every`` may name conversations (conv_id) that have no rows left: zeros and an empty audit.
    """
    found = written(sequences(rows), "conversations")
    known = found.join(audits(found), "symbols").drop("symbols")
    if every is not None:
        known = every.select(_key().alias("conv")).distinct().join(known, "conv", "left")
    counts = [F.coalesce(F.col(c), F.lit(0).cast("long")).alias(c) for c in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")]
    return written(known.select("conv", *counts, F.coalesce("audit", F.lit("")).alias("audit")), "audits")


def _with_audits(rows: DataFrame, known: DataFrame) -> DataFrame:
    """Each conversation's audit, then its rows in order, in sorted partitions."""
    heads = known.select("conv", F.col("audit").alias("text"))
    body = _prepared(rows).withColumn("part", F.lit(1))
    both = heads.withColumn("part", F.lit(0)).unionByName(body, allowMissingColumns=True)
    return _in_order(both.repartition("conv"), "part").select("conv", "part", "role", "text")


class _Editor:
    """Carries out one audit on the rows of a conversation as they come."""

    def __init__(self, audit: str):
        self.audit, self.at, self.state = audit, 0, NOTHING

    def _inserted(self) -> Iterator[tuple[str, str, str]]:
        while self.at < len(self.audit) and self.audit[self.at] == INSERT:
            self.at += 1
            self.state = FOLLOWING[self.state]
            yield INSERT, ROLE[self.state], ""

    def row(self, role: str, text: str) -> Iterator[tuple[str, str, str]]:
        yield from self._inserted()
        edit = self.audit[self.at]
        self.at += 1
        if edit == REROLE:
            self.state = FOLLOWING[self.state]
            yield edit, ROLE[self.state], text
        elif edit == KEEP:
            self.state = KEPT[role[:1]][self.state]
            yield edit, role, text

    def end(self) -> Iterator[tuple[str, str, str]]:
        yield from self._inserted()


def _edited(batches: Iterator[pd.DataFrame]) -> Iterator[list]:
    """Lists of (conversation, edit, role, text), and of (conversation, None, None, None) at its end."""
    conv, editor = None, None
    for batch in batches:
        out = []
        for key, part, role, text in zip(*(batch[c].tolist() for c in ("conv", "part", "role", "text")), strict=True):
            if part == 0:
                if editor is not None:
                    out += [(conv, *e) for e in editor.end()] + [(conv, None, None, None)]
                conv, editor = key, _Editor(text)
            else:
                out += [(conv, *e) for e in editor.row(role, text)]
        yield out
    if editor is not None:
        yield [(conv, *e) for e in editor.end()] + [(conv, None, None, None)]


def _number() -> Column:
    return F.when(F.col("conv") != " ", F.col("conv").cast("long")).alias("conv_id")


def repaired(rows: DataFrame) -> DataFrame:
    """The repaired conversations: conv_id, place (from 0), edit, role, text of every row that stands."""
    known = assessed(rows)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        place = 0
        for out in _edited(batches):
            kept = []
            for conv, edit, role, text in out:
                if edit is None:
                    place = 0
                else:
                    kept.append((conv, place, edit, role, text))
                    place += 1
            yield pd.DataFrame(kept, columns=["conv", "place", "edit", "role", "text"])

    streamed = _with_audits(rows, known).mapInPandas(run, "conv string, place long, edit string, role string, text string")
    return streamed.select(_number(), "place", "edit", "role", "text")


def digests(rows: DataFrame, every: DataFrame | None = None) -> DataFrame:
    """Per conversation of ``every`` or of ``rows``: faults, cost, audit, and the SHA-256 of the repaired rows.

    The digest is of ``role:text`` of the repaired rows, joined by line feeds; without rows, of nothing.
    """
    known = assessed(rows, every)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        digest, first = hashlib.sha256(), True
        for out in _edited(batches):
            done = []
            for conv, edit, role, text in out:
                if edit is None:
                    done.append((conv, digest.hexdigest()))
                    digest, first = hashlib.sha256(), True
                else:
                    digest.update(f"{'' if first else chr(10)}{role}:{text}".encode("utf-8", "replace"))
                    first = False
            yield pd.DataFrame(done, columns=["conv", "repaired_sha256"])

    hashed = _with_audits(rows, known).mapInPandas(run, "conv string, repaired_sha256 string")
    return known.join(hashed, "conv").select(_number(), "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256")


# The digests of the damaged table in SQL: crc32 by a table made from its polynomial, and the dynamic
# program as a recursion over rows that carries the best cost and audit of each state.
SQL = r"""
with recursive crc as (
  select list(v order by i) as t from (
    select i, list_reduce([i] || range(8), lambda c, k: case when c & 1 = 1 then xor(c >> 1, 3988292384) else c >> 1 end) as v
    from range(256) as r(i))
), source as (
  select conv_id, turn, coalesce(role, ' ') as role, coalesce(text, ' ') as text,
    coalesce(conv_id::varchar, ' ') || ':' || coalesce(turn::varchar, ' ') as k from conversations
), keyed as (
  select s.*, xor(list_reduce([4294967295::bigint] || list_transform(string_split(k, ''), lambda x: ascii(x)::bigint),
    lambda c, b: xor(c >> 8, t[(xor(c, b) & 255) + 1])), 4294967295) % 20 as h from source s, crc
), hurt as (
  select conv_id, turn, case when h = 4 then 'user' else role end as role,
    case when h = 1 then '' when h = 2 then translate(text, '.!?', '') else text end as text,
    unnest(case when h = 3 then [0, 1] else [0] end) as copy from keyed where h <> 0
), faulty as (
  select *, sha256(text) as digest, row_number() over (partition by conv_id order by turn nulls first, role, sha256(text), copy) as pos,
    case when not regexp_matches(text, '[^\x20\x09-\x0D]') then 1
      when row_number() over (partition by conv_id, role, text order by turn nulls first, copy) > 1 then 2
      when not regexp_matches(text, '[.!?][\x20\x09-\x0D]*$') then 3 else 0 end as fault,
    lag(left(role, 1)) over (partition by conv_id order by turn nulls first, role, sha256(text), copy) as before
  from hurt
), counted as (
  select conv_id, coalesce(max(turn) - min(turn) + 1 - count(distinct turn), 0) as gaps, count(*) filter (fault = 1) as blank,
    count(*) filter (fault = 2) as duplicate, count(*) filter (fault = 3) as truncated,
    count(*) filter (before is not null and before || left(role, 1) not in ('su', 'ua', 'au')) as illegal, count(*) as n
  from faulty group by conv_id
), way as (
  select conv_id, n, 0::bigint as pos, [{'c': 0, 'a': ''}, null, null, null] as v from counted
  union all
  select conv_id, n, pos,
    [{'c': i[1].c + 2, 'a': i[1].a || 'D'},
     list_min([{'c': i[2].c + 2, 'a': i[2].a || 'D'}, case when r = 's' then {'c': i[1].c + e, 'a': i[1].a || 'K'} end]),
     list_min([{'c': i[3].c + 2, 'a': i[3].a || 'D'}, case when g then {'c': f.c + 1 + e, 'a': f.a || 'R'} end,
       case when r = 'u' then {'c': f.c + e, 'a': f.a || 'K'} end]),
     list_min([{'c': i[4].c + 2, 'a': i[4].a || 'D'}, case when g then {'c': i[3].c + 1 + e, 'a': i[3].a || 'R'} end,
       case when r = 'a' then {'c': i[3].c + e, 'a': i[3].a || 'K'} end])]
  from (
    select conv_id, n, pos, r, e, g, i, list_min([i[1], i[2], i[4]]) as f from (
      select w.conv_id, w.n, w.pos + 1 as pos, case when fault in (1, 2) then 'x' else left(role, 1) end as r,
        case when fault = 3 then 5 else 0 end as e, fault not in (1, 2) as g, [v[1], v[2],
          list_min([v[3], {'c': v[1].c + 5, 'a': v[1].a || 'I'}, {'c': v[2].c + 5, 'a': v[2].a || 'I'}, {'c': v[4].c + 5, 'a': v[4].a || 'I'}]),
          list_min([v[4], {'c': v[3].c + 5, 'a': v[3].a || 'I'}, {'c': v[1].c + 10, 'a': v[1].a || 'II'}, {'c': v[2].c + 10, 'a': v[2].a || 'II'}])
        ] as i
      from way w join faulty f on f.conv_id is not distinct from w.conv_id and f.pos = w.pos + 1))
), best as (
  select conv_id, list_min([v[1], v[4], {'c': v[3].c + 5, 'a': v[3].a || 'I'}, {'c': v[1].c + 10, 'a': v[1].a || 'II'},
    {'c': v[2].c + 10, 'a': v[2].a || 'II'}]) as b from way where pos = n
), letter as (
  select conv_id, k, substr(b.a, k, 1) as e, length(replace(left(b.a, k), 'I', '')) as pos
  from (select conv_id, b, unnest(range(1, length(b.a) + 1)) as k from best)
), standing as (
  select l.conv_id, l.e, row_number() over (partition by l.conv_id order by k) as place, role, text,
    first_value(l.e = 'K' and left(role, 1) = 's') over (partition by l.conv_id order by k) as led
  from letter l left join faulty f on f.conv_id is not distinct from l.conv_id and f.pos = l.pos where l.e <> 'D'
), whole as (
  select conv_id, sha256(string_agg(case when e = 'K' then role when (place - led::int) % 2 = 1 then 'user' else 'assistant' end
    || ':' || case when e = 'I' then '' else text end, chr(10) order by place)) as s from standing group by conv_id
)
select o.conv_id, coalesce(gaps, 0)::bigint as gaps, coalesce(blank, 0)::bigint as blank, coalesce(duplicate, 0)::bigint as duplicate,
  coalesce(truncated, 0)::bigint as truncated, coalesce(illegal, 0)::bigint as illegal, coalesce(b.c, 0)::bigint as cost,
  coalesce(b.a, '') as audit, coalesce(s, sha256('')) as repaired_sha256
from (select distinct conv_id from conversations) o
left join counted c on c.conv_id is not distinct from o.conv_id
left join best z on z.conv_id is not distinct from o.conv_id
left join whole w on w.conv_id is not distinct from o.conv_id
"""
