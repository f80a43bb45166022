"""HTML extraction: markup, character references, and the host suffix array."""

from __future__ import annotations

import pytest

from rulewell.llm import html_extract
from rulewell.llm.html_extract import blocks


def article(page):
    return " ".join(t for r, t in blocks(page) if r == "article")


PAGE = """<!DOCTYPE html><html><head><title>T</title><style>p{}</style><script>var t="</p><article>";</script></head>
<body class="news"><header><h1>Site</h1></header><nav><ul><li><a href="/a">A</a></ul></nav><!-- <p>ad</p> -->
<div class="ad-slot">Buy</div><div role="navigation">Go</div><article class="post comment-free"><header><h1>Head &amp; line</h1></header>
<p>One<b>two</b> <br>three&nbsp;&eacute;<p class=x>Four &lt;b&gt; &#233; &am 5 < 6<div id="comments"><p>I disagree</div>
<form><input name=q><p>Search</p></form><aside>Side</aside><p title="a > b">Five</p><footer>By me</footer></article>
<p>after</p><footer>&copy; all</footer>"""


def test_blocks_of_an_article():
    assert article(PAGE) == "Head & line Onetwo three é Four <b> é &am 5 < 6 Five"


@pytest.mark.parametrize("page,want", [
    ("", ""),
    ("plain text", ""),
    ("<article>", ""),
    ("<article><p>a<p>b", "a b"),
    ("<article><p>a</p></section></div><p>b</article><p>c", "a b"),
    ("<article>a<script>if (a < b) { x('</p>') }</script>b</article>", "a b"),
    ("<article>a<!-- x", "a"),
    ("<ARTICLE><P>A</P></ARTICLE>", "A"),
    ("<main><p>m</p></main>", "m"),
    ("<article><p hidden>h</p><p aria-hidden='true'>h</p><p>s</p></article>", "s"),
    ("<article><a title='x>y\"'>l</a><img src=x>i<br/>j</article>", "li j"),
    ("<article><p><b>t<br><p>u</p></article>", "t u"),
])
def test_small_pages(page, want):
    assert article(page) == want


def pages_of(spark, rows):
    return spark.createDataFrame(rows, "page_id long, url string, html string").selectExpr("*", "'x' as host", "1 as content", "'t' as text").repartition(3)


def test_extract_uses_markup_and_repeats(spark):
    menu = "<div>home news sport weather travel money more</div>"
    tail = "<div>all rights are reserved by the owner of this site</div>"
    rows = [(i, f"http://h.example/{i}", f"<body>{menu}<p>unique{i} story{i} number{i} word{i} told here once{i}</p>{tail}") for i in range(5)]
    rows += [(50, "http://other.example/x", f"<body>{menu}<p>only page</p>")]
    rows += [(60, "http://h.example/a", f"<nav>x</nav><article><p>home news sport weather travel money more</p></article>{tail}")]
    rows += [(70, None, None), (71, "bad url", ""), (72, "http://h.example/z", "<p>" + "long " * 20000 + "</p>"), (0, rows[0][1], rows[0][2])]
    got = [tuple(r) for r in html_extract.extract(pages_of(spark, rows)).collect()]
    assert len(got) == len(rows)
    by_id = {r[0]: r for r in got}
    for i in range(5):
        assert by_id[i][2] == f"unique{i} story{i} number{i} word{i} told here once{i}", by_id[i]
    assert by_id[50][2] == "home news sport weather travel money more only page"
    assert by_id[60][2] == "home news sport weather travel money more"
    assert by_id[70][2:] == ("", 0) and by_id[71][2:] == ("", 0)
    assert by_id[72][3] == 5 * 20000 - 1
    assert html_extract.extract(pages_of(spark, []).limit(0)).collect() == []


def test_copies_of_a_page_do_not_erase_it(spark):
    page = "<body><p>the very same story with many words in it</p>"
    rows = [(i, "http://h.example/", page) for i in range(4)]
    assert {r.text for r in html_extract.extract(pages_of(spark, rows)).collect()} == {"the very same story with many words in it"}


SHARE = "share this story with all of your friends now please"


def said(i, n=60):
    return " ".join(f"w{(i * 7919 + j * j * 31) % 5003}" for j in range(n))


def texts_of(spark, rows):
    return {r.page_id: r.text for r in html_extract.extract(pages_of(spark, rows)).collect()}


def test_boilerplate_inside_the_articles_of_a_host(spark):
    rows = [(i, "http://h.example/", f"<article><p>{said(i)}</p><p>{SHARE}</p></article>") for i in range(20)]
    rows += [(100, "http://few.example/", f"<article><p>{SHARE}</p><p>{said(100)}</p></article>")]
    got = texts_of(spark, rows)
    assert all(got[i] == said(i) for i in range(20)) and got[100] == f"{SHARE} {said(100)}"


def test_text_after_the_article_stays(spark):
    rows = [(1, "http://h.example/1", f"<article><p>{said(1)}</p></article><p>{said(2)}</p>")]
    assert texts_of(spark, rows) == {1: f"{said(1)} {said(2)}"}


def test_a_phrase_on_two_pages_stays(spark):
    phrase = "he said that he would be back soon"
    rows = [(i, "http://h.example/", f"<p>{said(i)} {phrase} {said(50 + i)}</p>") for i in range(2)]
    assert texts_of(spark, rows) == {i: f"{said(i)} {phrase} {said(50 + i)}" for i in range(2)}


def test_quoted_passages_and_near_copies_stay(spark):
    """A long passage in all articles of a host, and a host of near copies of one article."""
    passage = said(999, 80)
    rows = [(i, "http://q.example/", f"<article><p>{said(i)}</p><p>{passage}</p></article>") for i in range(15)]
    copies = {}
    for i in range(15):
        words = said(500, 400).split()
        words[i * 20 + 3] = f"edit{i}"
        copies[100 + i] = " ".join(words)
    rows += [(k, "http://n.example/", f"<article><p>{t}</p></article>") for k, t in copies.items()]
    got = texts_of(spark, rows)
    assert all(got[i] == f"{said(i)} {passage}" for i in range(15)) and all(got[k] == t for k, t in copies.items())


@pytest.mark.parametrize("chunk", [4_000_000, 3000])
@pytest.mark.parametrize("limit", [500_000, 0])
def test_chunks_and_joined_runs_give_the_same(spark, monkeypatch, chunk, limit):
    monkeypatch.setattr(html_extract, "CHUNK_CHARS", chunk)
    monkeypatch.setattr(html_extract, "SHARED_RUNS", limit)
    menu = "home news sport weather travel money more"
    rows = [(i, "http://h.example/", f"<div>{menu}</div><article>{said(i)}</article><div>{SHARE}</div>") for i in range(60)]
    assert texts_of(spark, rows) == {i: said(i) for i in range(60)}


def test_repeats_equal_brute_force():
    import random

    draw = random.Random(5)
    for _ in range(40):
        streams = [[draw.choice("abc") for _ in range(draw.randint(1, 25))] for _ in range(draw.randint(1, 8))]
        contents = [draw.randint(0, 5) for _ in streams]
        nears = [c % 3 for c in contents]
        pages, apart = {}, {}
        for tokens, content, near in zip(streams, contents, nears, strict=True):
            for i in range(len(tokens) - html_extract.RUN_TOKENS + 1):
                run = tuple(tokens[i : i + html_extract.RUN_TOKENS])
                pages.setdefault(run, set()).add(content)
                apart.setdefault(run, set()).add(near)
        want = sorted((html_extract.run_key(list(r)), len(p), len(apart[r])) for r, p in pages.items() if len(p) >= 2)
        assert sorted(html_extract.repeats(streams, contents, nears, 2)) == want


@pytest.mark.parametrize("part", ["<a ", '<a "', "<a '>", '<a ">', "<", "<!--", "<p>x", '<a href="x>', "<script>", "<b>", "</x>", "<div><b>", "&"])
def test_broken_markup_costs_in_proportion(part):
    import time

    begin = time.time()
    html_extract.blocks("<article>" + part * 100_000 + "</b>" * 1000 + "</article>")
    assert time.time() - begin < 20
