"""Main texts of hand-written pages; templates against a count of their own."""

from collections import Counter

import pytest

from codequarry.llm import html

RICH = """<!DOCTYPE html><html><head><title>T</title><style>p{}</style><meta charset=utf-8></head>
<body class="has-sidebar nav-open"><header id="top"><h1>The Site</h1></header><div class="cookie-notice">We use cookies</div>
<nav role=navigation><ul><li><a href="/a">A</a><li><a href="/b">B</a></ul></nav>
<div class="wrap menu"><main><article class="post comment-open"><header><h1>Big &amp; small</h1></header>
<p>First <b>bold</b>
 line<br>goes on &eacute;&#233;<script>var x = "</p><p>no";</script>.
<p>Second one<div class=ad>Buy now</div><aside><p>Beside</p></aside>
<ul><li>one<li>two <i>too</i></ul><form><p>Name <input></form>
<table><tr><td>a</td><td>b</td></tr><tr><td>c</table><!-- no <p>comment</p> -->
<blockquote>Quote 1 < 2</blockquote></article></main></div>
<section id="comments"><article class="comment"><p>Nice!</p></article></section><div class="share social">Share</div>
<div role="complementary">Side</div><footer>&copy; all</footer></body></html>"""
WANT = "Big & small\nFirst bold line goes on éé .\nSecond one\none\ntwo too\na\nb\nc\nQuote 1 < 2"


def test_rich_page():
    assert html.Page(RICH).main_text(set()) == WANT


@pytest.mark.parametrize("source, want", [
    ("", ""), ("   ", ""), ("plain &lt;text&gt; only", "plain <text> only"), ("<p>a<p>b</div></p>c", "a\nb\nc"),
    ("<article><p>open <b>end", "open end"), ("<script>never closed <p>x", ""), ("<p class='x>y'>a</p>", "a"),
    ("<p title=\"unclosed>a</p>", "a"), ("a\xa0b\n\t c", "a b c"), ("<main><h2>x</h2>y</main><div>z</div>", "x\ny"),
    ("<div>x<div>y</div>z</div>", "x\ny\nz"), ("<article><p>1</p></article><article><p>2</p></article>", "1\n2"),
    ("&amp;amp;", "&amp;"), ("<a class=share>s</a> t <span>u</span>", "t u"), ("<br><p></p><hr>", ""),
])
def test_small_pages(source, want):
    assert html.Page(source).main_text(set()) == want


def _pages(spark):
    rows = []
    for i in range(12):
        rows.append((i, "http://one.example/p%d" % i, f"<div><p>About this site</p></div><div><p>Story {i}</p><p>Refrain</p></div>"))
    for i in range(12, 24):
        rows.append((i, "https://USER@two.example:80/p", f"<div>only {i}</div><article><p>Story {i}</p><p>Refrain</p></article>"))
    rows += [(30, None, "<p>Lone</p>"), (31, "not a url", None), (32, "http://one.example/x", ""), (33, "http://one.example/long", "<p>" + "word " * 100_000)]
    rows += [(0, rows[0][1], rows[0][2])]
    return spark.createDataFrame([r + (7,) for r in rows], "page_id bigint, url string, html string, text int")


def test_site_templates_are_counted_per_host(spark):
    pages = _pages(spark)
    found = {(r.host, r.hash) for r in html.site_templates(pages).collect()}
    counts, sizes = Counter(), Counter()
    for r in pages.collect():
        name = {"http://one": "one.example", "https://USE": "two.example"}.get((r.url or "")[:10 + (r.url or "").startswith("https")], "")
        sizes[name] += 1
        counts.update((name, h) for h in html.Page(r.html or "").candidates())
    assert found == {k for k, n in counts.items() if n >= 5 and n >= 0.3 * sizes[k[0]]} and found


@pytest.mark.parametrize("limit", [200_000, 0])
def test_texts_with_either_join(spark, monkeypatch, limit):
    monkeypatch.setattr(html, "BROADCAST_ROWS", limit)
    pages = _pages(spark)
    rows = html.main_texts(pages).collect()
    assert len(rows) == pages.count() and all(r.n_chars == len(r.text) for r in rows)
    text = {r.page_id: r.text for r in rows}
    assert text[3] == "Story 3" and text[15] == "Story 15\nRefrain"  # an article's own paragraphs stay
    assert (text[30], text[31], text[32]) == ("Lone", "", "") and len(text[33]) == 499_999
    assert html.main_texts(pages.limit(0)).count() == 0


STORY = "<p>A long story that goes on and on for the whole page</p>"


@pytest.mark.parametrize("source, want", [
    (f"<main><h1>Title</h1>{STORY}</main><article>Teaser</article>", "Title\nA long story that goes on and on for the whole page\nTeaser"),
    (f"<div>{STORY}</div><article>Teaser</article>", "A long story that goes on and on for the whole page\nTeaser"),
    (f"<article>{STORY}</article><aside><article>Teaser</article></aside>", "A long story that goes on and on for the whole page"),
    (f"<main>{STORY}<footer><article>Teaser</article></footer></main>", "A long story that goes on and on for the whole page"),
    (f"<nav><a>Home</a><main>{STORY}</main>", "Home\nA long story that goes on and on for the whole page"),
])
def test_main_text_outside_of_articles(source, want):
    assert set(want.split("\n")) - {"Teaser", "Home"} <= set(html.Page(source).main_text(set()).split("\n")) <= set(want.split("\n"))


def test_templates_on_many_pages_of_a_large_host(spark):
    rows = [(i, "http://big.example/", f"<div>Story {i}</div>" + "<div>Section notice</div>" * (i < 8)) for i in range(60)]
    pages = spark.createDataFrame(rows, "page_id bigint, url string, html string")
    text = {r.page_id: r.text for r in html.main_texts(pages, html.site_templates(pages, many=8)).collect()}
    assert text[3] == "Story 3" and html.site_templates(pages).count() == 0
