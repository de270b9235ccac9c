"""HTML extraction: blocks, the cut against all labellings, and pages with every kind of boilerplate."""

import itertools
import random

import pytest

from factloom.llm import extract

PROSE = "A paragraph of the article that goes on for some time, as paragraphs of articles do, until it ends."


def test_cut_is_minimal():
    r = random.Random(2)
    for _ in range(80):
        n = r.randint(1, 7)
        odds = [r.uniform(-3, 3) for _ in range(n)]
        near = [{} for _ in range(n)]
        for i, j in itertools.combinations(range(n), 2):
            if r.random() < 0.5:
                near[i][j] = near[j][i] = r.uniform(0, 2)

        def cost(side, odds=odds, near=near, n=n):
            return sum(max(o, 0) if not s else max(-o, 0) for o, s in zip(odds, side, strict=True)) + sum(
                near[i].get(j, 0) for i in range(n) for j in range(i) if side[i] != side[j])
        best = min(cost(s) for s in itertools.product([False, True], repeat=n))
        assert abs(cost(extract.minimum_cut(odds, near)) - best) < 1e-6


def test_boilerplate_of_every_kind():
    page = f"""<!DOCTYPE html><html><head><title>T</title><style>p{{x}}</style><script>var a="</p><p>no";</script></head><body class="home single-post">
    <header><h2>Site</h2></header><nav><ul><li><a href="/">Home</a></li><li><a href='/a>b'>About us all</a></li></ul></nav><!-- <p>hidden</p> -->
    <div class="ad">Buy this now. It is very good, and cheap, and long enough to look like a paragraph of text, really it is.</div>
    <article><header><h1>Head &amp; line</h1></header><p>{PROSE}</p><p>Short.</p><aside>See also</aside><ul><li>One</li><li>T<b>w</b>o&nbsp;&#233;</li></ul>
    <form><label>Mail</label><input><button>Go</button></form><p>Last <a href="x">link</a><br>line&hellip;</p></article>
    <div id="comments"><p>{PROSE} says a reader.</p></div><section class="cookie-notice"><p>We use cookies.</p></section>
    <div class="sidebar"><p>{PROSE}</p></div><noscript>Enable it</noscript><footer>&copy; Site</footer></body></html>"""
    assert extract.main_text(page) == f"Head & line {PROSE} Short. One Two é Last link line…"


def test_pages_without_an_article_tag():
    page = f"<html><body><div class='menu'><a href=/>Home</a> <a href=/b>More</a></div><div class=wrap><div><p>{PROSE}</p><p>Mid.</p><p>{PROSE}</p></div></div><div class='footer'>c</div></body></html>"
    assert extract.main_text(page) == f"{PROSE} Mid. {PROSE}"


@pytest.mark.parametrize("page", ['<main class="with-sidebar">{}</main>', '<article class="post category-notices tag-social">{}</article>', '<div id="content" class="no-comments">{}</div>',
                                  '<div class="page has-share">{}</div>', '<div class="main-content sidebar">{}</div>', "<body>{}</body>"])
def test_names_that_tell_a_state_lose_nothing(page):
    assert extract.main_text(page.format(f"<p>{PROSE}</p><p>Hello there</p>")) == f"{PROSE} Hello there"


@pytest.mark.parametrize("name", ["comment-list", "post-comments", "shareButtons", "widget related-posts", "cookie_banner", "ad", "site-footer"])
def test_names_of_boilerplate(name):
    assert extract.main_text(f'<article><p>{PROSE}</p><div class="{name}"><p>{PROSE}</p></div></article>') == PROSE


def test_long_undecided_runs():
    """Blocks that only the flow can decide; a chain of them has the labels that a pass along it gives."""
    r = random.Random(1)
    for n in (300, 20_000):
        odds = [r.choice([-0.5, 0.5, 0.8, -0.8, 1.2]) for _ in range(n)]
        near = [{j: 2.0 for j in (i - 1, i + 1) if 0 <= j < n} for i in range(n)]
        # least cost of a prefix that ends in boilerplate, in content
        low, high = max(odds[0], 0), max(-odds[0], 0)
        for o in odds[1:]:
            low, high = min(low, high + 2) + max(o, 0), min(high, low + 2) + max(-o, 0)
        side = extract.minimum_cut(odds, near)
        cost = sum(max(-o, 0) if s else max(o, 0) for o, s in zip(odds, side, strict=True)) + 2 * sum(a != b for a, b in itertools.pairwise(side))
        assert abs(cost - min(low, high)) < 1e-6


def test_odd_markup():
    assert extract.main_text("") == ""
    assert extract.main_text("<nav>a</nav>") == ""
    assert extract.main_text("<article><p>x <b>y</p><p>un&amp;closed &am") == "x y un&closed &am"
    assert extract.main_text("<article><p>cut <a href=\"x") == "cut"
    assert extract.main_text("<article><p>1 < 2 and 3 > 2</p></article>") == "1 < 2 and 3 > 2"
    assert extract.main_text("<article>" + "<div>" * 3000 + "deep" + "</div>" * 3000 + "</article>") == "deep"
    assert extract.main_text("<article><script>open") == ""
    assert extract.main_text("<article>" + "<p>w.</p>" * 5000) == " ".join(["w."] * 5000)


def test_rows_in_spark(spark):
    rows = [(1, "u", "<article><p>x</p></article>"), (1, "u", "<article><p>x</p></article>"), (2, None, None), (None, "v", "<p></p>")]
    df = spark.createDataFrame([(*r, 5) for r in rows], "page_id long, url string, html string, n_chars int")
    assert sorted((r.page_id or 0, r.url or "", r.text, r.n_chars) for r in extract.extract(df).collect()) == [(0, "v", "", 0), (1, "u", "x", 1), (1, "u", "x", 1), (2, "", "", 0)]
    assert extract.extract(df.where("false")).count() == 0


def test_the_given_pages(spark):
    pages = spark.read.parquet("/root/testdata/sf0.001/pages.parquet")
    import html
    import re
    for r, page in zip(extract.extract(pages).orderBy("page_id").collect(), pages.orderBy("page_id").collect(), strict=True):
        body = re.sub(r"<(?:/?\w[^>]*(?:>|$)|$)", lambda m: " " if re.match(r"</?(?:p|br|h1|article)\b", m[0]) else "", page.html[page.html.index("<article>"):].split("</article>")[0].split("<footer")[0])
        assert r.text == " ".join(html.unescape(body).split()) and r.n_chars == len(r.text)
