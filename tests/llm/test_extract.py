import html
import random
import re
import time

import pytest

from fathom.llm import extract


def article_of(page):
    parts = re.split(r"</?(?:p|h1)>", re.search(r"<article>(.*)</article>", page, re.S)[1])
    texts = [" ".join(html.unescape(re.sub(r"<[^>]*>", "", p.replace("<br>", " "))).split()) for p in parts]
    return "\n\n".join(t for t in texts if t)


def test_pages(spark, sf_dir):
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet")
    rows = {r["page_id"]: r for r in extract.main_text(pages).collect()}
    for r in pages.collect():
        got = rows[r["page_id"]]
        assert got["text"] == article_of(r["html"]) and got["n_chars"] == len(got["text"]) and got["url"] == r["url"]


PAGE = """<!doctype html><html><head><title>T</title><style>p{}</style></head><body>
<header class="site-header"><h2>The name of the site</h2><form><label>Find<input></label></form></header>
<nav><ul><li><a href=/>Home</a></li><li><a href=/a>About</a></ul></nav>
<div id="cookie-notice"><p>We use cookies, and this is a long notice about how we use them for all of you.</p></div>
<div class="layout"><div class="main-content"><h1>Title &amp; more</h1><p>First   paragraph of the story,
with <a href=x>a link</a> in it.<br>And a line.<ul><li>one item</li><li>two</li></ul><p>Short.<!-- no --><script>if (a < b && c > d) { x = "</p>"; }</script></div>
<div class="sidebar"><h3>Most read</h3><p>A very long teaser that speaks about something else entirely, with commas, and stops.</p></div></div>
<div class="advert"><p>Buy this thing now, it is very good, and it is very cheap, and it is yours.</p></div>
<section id="comments"><h3>Comments</h3><p>I think, that this is great. Really a long comment is this, with many words in it.</p></section>
<footer><p>&copy; 2020 The site, and all who sail in her, with all rights reserved for ever.</p></footer></body></html>"""


def test_parts_of_a_page():
    assert extract.extract(PAGE).split("\n\n") == ["Title & more", "First paragraph of the story, with a link in it. And a line.", "one item", "two", "Short."]


@pytest.mark.parametrize("page", [None, "", "   ", "<", "<p", "<p>", "</p></div>", "<script>x", "<!--", "&amp;", "<a href='", "<div " * 500, "<p>a" * 300, "<div>" * 3000 + "x", "a < b > c & d", "<p class=\"a>b"])
def test_broken_markup(page):
    assert isinstance(extract.extract(page), str)


BODY = "<p>The first paragraph of the article, with words in it.</p><p>And then a second one, which is longer than that by far.</p>"
TEXT = "The first paragraph of the article, with words in it.\n\nAnd then a second one, which is longer than that by far."
WRAPS = ["tags-page", "social-science", "header-on-top", "has-sidebar", "search-engines", "menu-planning", "ad-hoc-notes", "share-of-voice", "css-1x9", "page"]


@pytest.mark.parametrize("wrap", WRAPS)
@pytest.mark.parametrize("inner", ["<article>%s</article>", "<div>%s</div>", '<div class="content">%s</div>'])
def test_wrappers_of_any_name(wrap, inner):
    menu = "<nav><ul><li><a href=/>Home</a></li><li><a href=/a>About</a></li></ul></nav>"
    foot = "<footer>&copy; 2020 The site, all rights reserved.</footer>"
    assert extract.extract(f'<body><div class="{wrap}">{menu}{inner % BODY}{foot}</div>') == TEXT


@pytest.mark.parametrize(
    "page,text",
    [
        ("<p class='it's'>Hello it's me, and you are there.", "Hello it's me, and you are there."),
        ('<p style="color:red"">Text of the page, red.', "Text of the page, red."),
        ('<p title="5" tall">Text of the page, tall.', "Text of the page, tall."),
        ("<p title='a>b'>Text of the page, quoted.", "Text of the page, quoted."),
        ("<p title=a>Text of the page, bare.", "Text of the page, bare."),
        ("<p data-x = \"1\" y>Text of the page, spaced.", "Text of the page, spaced."),
        ("<p/>Text of the page, closed.", "Text of the page, closed."),
        ("<p>One <b ti'tle>bold</b> word, one <i>more</i>.", "One bold word, one more."),
        ("<p>5 < 6 and 7 > 3, they say.", "5 < 6 and 7 > 3, they say."),
        ("<!--> <p>Text after an empty comment, all of it.", "Text after an empty comment, all of it."),
        ("</3><p>Text after a false end tag, all of it.", "Text after a false end tag, all of it."),
        (f'<form id="whole"><input>{BODY}</form>', TEXT),
        (f'<article>{BODY}<div class="search-results"><p>A third one, under another name.</p></div></article>', TEXT + "\n\nA third one, under another name."),
        ("<article><p>The sum <math><mi>x</mi><mo>=</mo><mn>2</mn></math> is right, they say.</p></article>", "The sum x=2 is right, they say."),
        (f'<main>{BODY}</main><div class="comments"><article><p>I say, it is good, and so is this.</p></article></div>', TEXT),
        (f'<article>{BODY}<form><label>Your name, please</label><input></form></article>', TEXT),
    ],
)
def test_markup(page, text):
    assert extract.extract(page) == text


def test_generated_layouts():
    """Held-out layouts of the generator that the weights are learnt on."""
    from fathom.llm import extract_training

    wrong = blocks = 0
    for i in range(300):
        page = extract_training.Layout(random.Random(77_000_000 + i))
        own = extract.labelled(extract.blocks(page.html))
        wrong += sum(a != b for a, b in zip(own, page.labels))
        blocks += len(own)
    assert wrong < 0.01 * blocks


def test_weights_are_those_of_the_training():
    from fathom.llm import extract_training

    assert extract_training.fit() == extract.WEIGHTS


@pytest.mark.parametrize("page", [BODY * 42_000, "<b " * 1_000_000, '<b x="' * 500_000, "<div>" * 200_000 + "x" + "</p>" * 200_000, "<!" * 1_000_000, "<a x=<" * 500_000, "<div><i>" * 100_000 + "</b>" * 100_000])
def test_long_pages_take_linear_time(page):
    began = time.time()
    text = extract.extract(page)
    assert time.time() - began < 20 and (not page.startswith("<p>") or len(text) > 4_000_000)


def test_clashing_columns(spark):
    df = spark.sql("SELECT 1L AS page_id, 'u' AS url, '<article><p>Hello there, reader of this page.</p></article>' AS html, 'x' AS text, 2 AS n_chars")
    assert [tuple(r) for r in extract.main_text(df).collect()] == [(1, "u", "Hello there, reader of this page.", 33)]


def test_frame_of_odd_rows(spark):
    df = spark.createDataFrame([(1, None, None), (1, None, None), (None, "u", "<article><p>Hello there, reader of this page.</p></article>")], "page_id long, url string, html string")
    got = sorted(((r["page_id"] or 0, r["text"], r["n_chars"]) for r in extract.main_text(df).collect()))
    assert got == [(0, "Hello there, reader of this page.", 33), (1, "", 0), (1, "", 0)]
    assert extract.main_text(df.limit(0)).count() == 0


def brute_cut(content, away, edges):
    n = len(content)
    best = None
    for m in range(1 << n):
        cost = sum(away[i] if m >> i & 1 else content[i] for i in range(n)) + sum(w for u, v, w in edges if (m >> u & 1) != (m >> v & 1))
        best = cost if best is None else min(best, cost)
    return best


def test_min_cut_is_minimal():
    rng = random.Random(8)
    for _ in range(60):
        n = rng.randrange(1, 9)
        c, a = [rng.random() * 3 for _ in range(n)], [rng.random() * 3 for _ in range(n)]
        e = [(i, j, rng.random()) for i in range(n) for j in range(i) if rng.random() < 0.5]
        keep = extract.min_cut(c, a, e)
        cost = sum(a[i] if keep[i] else c[i] for i in range(n)) + sum(w for u, v, w in e if keep[u] != keep[v])
        assert abs(cost - brute_cut(c, a, e)) < 1e-6
