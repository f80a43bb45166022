"""Main text of web pages: markup roles, and a host's repeated substrings where markup leaves furniture standing.

Every page is cut into blocks of text. A block inside a menu, header, footer, sidebar, notice, advert, form or
comment section (by element, ARIA role or class name) is page furniture and goes. The tokens of all other blocks, in
page order, are the page's stream. The streams of a host are concatenated and their suffixes sorted; neighbours in
that order that begin with the same ``RUN_TOKENS`` tokens are one repeated substring, and the different pages it
stands on are counted. What enough pages of a host share is boilerplate: outside article markup
``LOOSE_PAGES`` pages and a share of ``LOOSE_SHARE`` of the host, inside it, as markup's vote for it, ``ARTICLE_PAGES``
and ``ARTICLE_SHARE``. Covered tokens are removed and the unique runs between them kept; a covered
stretch of more than ``LONGEST`` tokens stays, as a passage or a copied article and not boilerplate.

Copies of a page count once. Inside articles near copies count once as well: pages are told apart there by the
smallest hash of five consecutive tokens, which near copies share.

On a cluster. Pages go to their host, in chunks by content where a host is large, and a chunk's suffixes are sorted
in one task. A substring that a share of the host holds is held by at least half that share in nearly every chunk;
chunks report those, and reports are added up, so no text goes for less than its share. Pages are parsed
again for the result rather than stored or shuffled a second time.
"""

from __future__ import annotations

import hashlib
import html
import re
import zlib
from collections import Counter
from collections.abc import Iterator
from itertools import count

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rulewell.session import written

RUN_TOKENS, LONGEST = 6, 50
LOOSE_PAGES, LOOSE_SHARE = 3, 0.2
ARTICLE_PAGES, ARTICLE_SHARE = 10, 0.6
# Characters of html whose streams one task sorts at a time.
CHUNK_CHARS = 4_000_000
# So many boilerplate substrings are given to all tasks; beyond, they are joined to the pages of their host.
SHARED_RUNS = 500_000
NEAR_TOKENS = 5
# A quoted attribute value is looked for in so many characters; bounds the cost of broken markup.
TAG_CHARS = 65_536

# Element names and attribute words of HTML by what they hold.
HIDDEN = frozenset("script style noscript template iframe object canvas svg math head title select textarea option audio video".split())
RAW = frozenset("script style textarea title noscript template iframe".split())
FURNITURE = frozenset("nav header footer aside form dialog menu button fieldset label".split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
INLINE = frozenset(
    "a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd mark q s samp small span strike strong sub "
    "sup time tt u var wbr img".split()
)
WHOLE = frozenset("html body article main".split())
ROLES = frozenset("navigation banner contentinfo complementary search form alert alertdialog dialog menu menubar".split())
WORDS = frozenset(
    "ad ads advert adverts advertisement advertising sponsor sponsored promo banner cookie cookies consent gdpr notice "
    "alert popup modal overlay newsletter subscribe signup login sidebar nav navbar navigation menu breadcrumb "
    "breadcrumbs footer header masthead comment comments disqus replies share sharing social related recommended "
    "pagination pager toolbar widget".split()
)

_NAME = re.compile(r"(/?)([a-zA-Z][^\s/>]*)")
_STOP = re.compile(r"[>\"']")
_ATTRIBUTE = re.compile(r"""([^\s=/"']+)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))""")
_HIDDEN_FLAG = re.compile(r"(?:^|\s)hidden(?:\s|=|/|$)", re.I)
_WORD = re.compile(r"[a-z]+")
_CLOSE = {name: re.compile(rf"</{name}\b[^>]*>", re.I) for name in RAW}

ARTICLE, LOOSE, OTHER = "article", "loose", "other"


def _role(name: str, attributes: str, inside: str) -> str:
    """The role of an element's content, given the role of what it stands in."""
    if inside == OTHER or name in HIDDEN:
        return OTHER
    if name in FURNITURE and not (name == "header" and inside == ARTICLE):  # an article's own heading
        return OTHER
    if attributes and "=" in attributes:
        for key, *values in _ATTRIBUTE.findall(attributes):
            key, value = key.lower(), "".join(values).lower()
            if key == "role" and value in ROLES or key == "aria-hidden" and value == "true":
                return OTHER
            named = key in ("class", "id") and name not in WHOLE and name not in HEADINGS
            if named and not WORDS.isdisjoint(_WORD.findall(value)):
                return OTHER
    if attributes and _HIDDEN_FLAG.search(attributes):
        return OTHER
    return ARTICLE if name in ("article", "main") else inside


def _tag_end(page: str, at: int) -> int:
    """Where the ``>`` of a tag stands whose name ends at ``at``; one inside quotes only if none stands outside. -1 without one."""
    place, limit = at, min(len(page), at + TAG_CHARS)
    while True:
        stop = _STOP.search(page, place, limit)
        if not stop:
            return page.find(">", at)
        if stop[0] == ">":
            return stop.start()
        close = page.find(stop[0], stop.end(), limit)
        if close < 0:
            return page.find(">", at)
        place = close + 1


def tags(page: str) -> Iterator[tuple[int, int, str, str, str]]:
    """(start, end, closing slash, name, attributes) of markup in order; comments and declarations have no name.

    The caller may send the place where to go on. A ``<`` that begins nothing is text. The cost is
    proportional to the page: without any ``>`` ahead no tag is looked for.
    """
    at, last = 0, page.rfind(">")
    while True:
        start = page.find("<", at)
        if start < 0:
            return
        if page.startswith("<!--", start):
            end = page.find("-->", start + 4)
            found = (start, len(page) if end < 0 else end + 3, "", "", "")
        elif start > last:
            return
        elif page[start + 1 : start + 2] in ("!", "?"):
            found = (start, page.find(">", start) + 1, "", "", "")
        else:
            name = _NAME.match(page, start + 1)
            end = _tag_end(page, name.end()) if name else -1
            if end < 0:
                at = start + 1
                continue
            found = (start, end + 1, name[1], name[2], page[name.end() : end])
        sent = yield found
        at = max(found[1], sent or 0)


def blocks(page: str) -> list[tuple[str, str]]:
    """(role, text) of the blocks of a page in page order; white space is one space, references decoded.

    Elements left open end with the element around them; an opening block ends an open paragraph.
    """
    found: list[tuple[str, str]] = []
    held: list[str] = []
    stack: list[tuple[str, str]] = []
    open_names: Counter[str] = Counter()
    role, at, skip = LOOSE, 0, None

    def close_block() -> None:
        text = " ".join("".join(held).split())
        if text:
            found.append((role, text))
        held.clear()

    def hold(text: str) -> None:
        if text:
            held.append(html.unescape(text) if "&" in text else text)

    markup = tags(page)
    while True:
        try:
            tag = markup.send(skip)
        except StopIteration:
            break
        skip = None
        start, end, closing, name, attributes = tag
        hold(page[at:start])
        at = end
        if not name:
            continue
        name = name.lower()
        if name not in INLINE:
            close_block()
        if closing:
            if open_names[name]:
                while stack:
                    open_name, before = stack.pop()
                    open_names[open_name] -= 1
                    if before != role:
                        close_block()
                        role = before
                    if open_name == name:
                        break
            continue
        if name in RAW:
            close = _CLOSE[name].search(page, at)
            at = skip = close.end() if close else len(page)
            continue
        if name in VOID or attributes.endswith("/"):
            continue
        if name not in INLINE:
            while open_names["p"] and (stack[-1][0] in INLINE or stack[-1][0] == "p"):
                open_name, before = stack.pop()
                open_names[open_name] -= 1
                role = before
                if open_name == "p":
                    break
        new = _role(name, attributes, role)
        stack.append((name, role))
        open_names[name] += 1
        if new != role:
            close_block()
            role = new
    hold(page[at:])
    close_block()
    return found


def stream(page: str) -> tuple[list[str], np.ndarray]:
    """The tokens of all blocks that markup does not call furniture, and which of them stand in an article."""
    tokens: list[str] = []
    inside: list[bool] = []
    for role, text in blocks(page):
        if role != OTHER:
            own = text.split(" ")
            tokens += own
            inside += [role == ARTICLE] * len(own)
    return tokens, np.array(inside, bool)


def _long(data: bytes) -> int:
    return int.from_bytes(hashlib.blake2b(data, digest_size=8).digest(), "little", signed=True)


def run_key(tokens: list[str]) -> int:
    return _long(" ".join(tokens).encode("utf-8", "replace"))


def near_key(tokens: list[str], inside: np.ndarray, content: int) -> int:
    """The smallest hash of NEAR_TOKENS consecutive article tokens; the content's own without that many."""
    own = [t for t, i in zip(tokens, inside.tolist(), strict=True) if i]
    if len(own) < NEAR_TOKENS:
        return content
    one = np.fromiter((zlib.crc32(t.encode("utf-8", "replace")) for t in own), np.uint64, len(own))
    total = np.zeros(len(own) - NEAR_TOKENS + 1, np.uint64)
    for k in range(NEAR_TOKENS):
        total = (total ^ one[k : k + len(total)]) * np.uint64(0x9E3779B97F4A7C15)
        total ^= total >> np.uint64(29)
    return int((total >> np.uint64(2)).min())


def repeats(streams: list[list[str]], contents: list[int], nears: list[int], least: int) -> Iterator[tuple[int, int, int]]:
    """(key, pages, pages but for near copies) of the runs of RUN_TOKENS tokens on ``least`` contents or more.

    Suffixes of all streams are sorted by doubling: ranks of one token, then of two, four, ..., each from the
    ranks of half the length. Every stream ends with a token of its own, so no run goes over its end.
    """
    number: dict[str, int] = {}  # each token as the place where it first stands
    parts, owner, size = [], [], 0
    for at, tokens in enumerate(streams):
        parts += [np.fromiter(map(number.setdefault, tokens, count(size)), np.int64, len(tokens)), np.array([-1 - at])]
        owner.append(np.full(len(tokens) + 1, at))
        size += len(tokens)
    if not parts:
        return
    text, owner = np.concatenate(parts), np.concatenate(owner)
    rank = np.unique(text, return_inverse=True)[1].astype(np.int64)
    length = 1
    while length < RUN_TOKENS:
        ahead = min(length, RUN_TOKENS - length)
        second = np.concatenate([rank[ahead:], np.full(ahead, -1)])
        pair = rank * (len(rank) + 1) + second + 1
        rank = np.unique(pair, return_inverse=True)[1].astype(np.int64)  # the order of suffixes to this depth
        length += ahead
    order = np.argsort(rank, kind="stable")
    group, page = rank[order], owner[order]
    content = np.unique(np.array(contents, np.int64), return_inverse=True)[1][page]
    near = np.unique(np.array(nears, np.int64), return_inverse=True)[1][page]

    def distinct(of: np.ndarray) -> np.ndarray:
        pair = np.sort(group * (len(streams) + 1) + of)
        first = np.concatenate([[True], pair[1:] != pair[:-1]])
        return np.bincount(pair[first] // (len(streams) + 1), minlength=int(group[-1]) + 1)

    pages, apart = distinct(content), distinct(near)
    first = order[np.searchsorted(group, np.arange(len(pages)))]
    starts = np.cumsum([0] + [len(s) + 1 for s in streams])
    for run in np.flatnonzero(pages >= least).tolist():
        at = int(first[run])
        place = at - int(starts[owner[at]])
        found = streams[owner[at]][place : place + RUN_TOKENS]
        if len(found) == RUN_TOKENS:
            yield run_key(found), int(pages[run]), int(apart[run])


def _host(url: Column) -> Column:
    return F.lower(F.regexp_extract(F.coalesce(url, F.lit("")), r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)", 1))


def _chunked(pages: DataFrame) -> DataFrame:
    """(host, chunk, content, near, text): the streams of all pages that have enough tokens for a run."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for host, chunks, page in zip(batch["host"], batch["chunks"].tolist(), batch["html"], strict=True):
                tokens, inside = stream(page or "")
                if len(tokens) >= RUN_TOKENS:
                    text = " ".join(tokens)
                    content = _long(text.encode("utf-8", "replace"))
                    rows.append((host, content % chunks, content, near_key(tokens, inside, content), text))
            yield pd.DataFrame(rows, columns=["host", "chunk", "content", "near", "text"])

    hosted = pages.select(_host(F.col("url")).alias("host"), "html")
    chunks = F.ceil(F.sum(F.length("html") + 1) / CHUNK_CHARS).cast("int")
    # Hosts of one chunk are not listed. A table of known size: where it is small, pages are not shuffled for it.
    large = written(hosted.groupBy("host").agg(chunks.alias("chunks")).where("chunks > 1"), "hosts")
    sized = hosted.join(large, "host", "left").select("host", F.coalesce("chunks", F.lit(1)).alias("chunks"), "html")
    return sized.mapInPandas(run, "host string, chunk int, content long, near long, text string")


def boilerplate(pages: DataFrame) -> DataFrame:
    """(host, run, article): keys of the runs that are boilerplate, ``article`` if inside articles too; written."""
    keys = ["host", "chunk"]

    def found(host: str, chunk: int, streams: dict[int, tuple[int, str]]) -> list[tuple]:
        contents, nears = list(streams), [n for n, _ in streams.values()]
        least = max(2, int(len(contents) * LOOSE_SHARE / 2)) if len(contents) >= LOOSE_PAGES else len(contents) + 1
        texts = [t.split(" ") for _, t in streams.values()]
        rows = [(host, k, p, n) for k, p, n in repeats(texts, contents, nears, least)]
        return [*rows, (host, None, len(contents), len(set(nears)))]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        last, held = None, {}
        for batch in batches:
            out = []
            for host, chunk, content, near, text in zip(*(batch[c].tolist() for c in (*keys, "content", "near", "text")), strict=True):
                if (host, chunk) != last:
                    if last is not None:
                        out += found(*last, held)
                    last, held = (host, chunk), {}
                held.setdefault(content, (near, text))
            if out:
                yield _frame(out)
        if last is not None:
            yield _frame(found(*last, held))

    ordered = _chunked(pages).repartition(*keys).sortWithinPartitions(*keys)
    counted = written(ordered.mapInPandas(run, "host string, run string, pages long, apart long"), "runs")
    sums = counted.groupBy("host", "run").agg(F.sum("pages").alias("pages"), F.sum("apart").alias("apart"))
    hosts = sums.where(F.col("run").isNull()).select("host", F.col("pages").alias("all"), F.col("apart").alias("all_apart"))
    judged = sums.where(F.col("run").isNotNull()).join(hosts, "host")
    loose = (F.col("pages") >= LOOSE_PAGES) & (F.col("pages") >= LOOSE_SHARE * F.col("all"))
    article = (F.col("apart") >= ARTICLE_PAGES) & (F.col("apart") >= ARTICLE_SHARE * F.col("all_apart"))
    return written(judged.where(loose).select("host", F.col("run").cast("long").alias("run"), article.alias("article")), "boilerplate")


def _frame(rows: list[tuple]) -> pd.DataFrame:
    # Keys travel as text: a null among long numbers would make them floats.
    named = [(h, None if k is None else str(k), p, a) for h, k, p, a in rows]
    return pd.DataFrame(named, columns=["host", "run", "pages", "apart"])


def main_text(page: str, known: dict[int, bool]) -> str:
    """The page's stream without boilerplate; ``known`` has the host's runs, True for those that count inside articles."""
    tokens, inside = stream(page)
    if known and len(tokens) >= RUN_TOKENS:
        covered = np.zeros(len(tokens), bool)
        for at in range(len(tokens) - RUN_TOKENS + 1):
            article = known.get(run_key(tokens[at : at + RUN_TOKENS]))
            if article or article is not None and not inside[at : at + RUN_TOKENS].any():
                covered[at : at + RUN_TOKENS] = True
        edge = np.flatnonzero(np.diff(np.concatenate([[False], covered, [False]]).view(np.int8)))
        for lo, hi in zip(edge[::2].tolist(), edge[1::2].tolist(), strict=True):
            if hi - lo > LONGEST:
                covered[lo:hi] = False
        tokens = [t for t, c in zip(tokens, covered.tolist(), strict=True) if not c]
    return " ".join(tokens)


def extract(pages: DataFrame) -> DataFrame:
    """page_id, url, text, n_chars for every page; text is empty where there is no main text.

    Null and empty html give empty text; a null url belongs to the host without a name; repeated
    rows give repeated results; columns other than page_id, url and html are left out.
    """
    rows = pages.select(F.col("page_id").cast("string").alias("page_id"), "url", "html")
    runs = boilerplate(rows)
    hosted = rows.withColumn("host", _host(F.col("url")))
    few = runs.limit(SHARED_RUNS + 1).count() <= SHARED_RUNS
    if few:
        listed: dict[str, dict[int, bool]] = {}
        for r in runs.collect():  # at most SHARED_RUNS
            listed.setdefault(r["host"], {})[r["run"]] = r["article"]
        shared = pages.sparkSession.sparkContext.broadcast(listed)
        given = hosted.withColumns({"runs": F.lit(None).cast("array<long>"), "articles": F.lit(None).cast("array<boolean>")})
    else:
        shared = None
        pair = F.array_sort(F.collect_list(F.struct("run", "article")))
        per_host = runs.groupBy("host").agg(pair.alias("r")).select("host", F.col("r.run").alias("runs"), F.col("r.article").alias("articles"))
        given = hosted.join(per_host, "host", "left")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            texts = []
            for host, page, runs, articles in zip(batch["host"], batch["html"], batch["runs"], batch["articles"], strict=True):
                known = shared.value.get(host) if shared else None if runs is None else dict(zip(runs, articles, strict=True))
                texts.append(main_text(page or "", known or {}))
            yield pd.DataFrame({"page_id": batch["page_id"], "url": batch["url"], "text": texts})

    made = given.select("page_id", "url", "host", "html", "runs", "articles").mapInPandas(run, "page_id string, url string, text string")
    return made.select(F.col("page_id").cast("long").alias("page_id"), "url", "text", F.length("text").cast("long").alias("n_chars"))
