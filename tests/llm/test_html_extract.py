"""Main text of pages: fixtures, and the synthetic pages against their own article."""

import html
import re
import time

import pytest

from spendgrid.llm.html_extract import extract, main_text

LONG = "A long paragraph of running text that goes on for quite a while, with many words in it."


@pytest.mark.parametrize(
    "page, want",
    [
        (None, ""),
        ("", ""),
        ("<p></p>", ""),
        ("plain text", "plain text"),
        (f"<nav>Menu</nav><article><h1>Title</h1><p>{LONG}</p><p>Short.</p></article><footer>f</footer>", f"Title {LONG} Short."),
        (f"<article><p>{LONG}<br>next <b>bold</b>ness<p>a&nbsp;&lt;b&#x41;&amp", f"{LONG} next boldness a <bA&"),
        (f"<article><p>{LONG}</p><aside>no</aside><div class='reader-comments'>zz</div><form>name</form></article>", LONG),
        (f"<main><header>By me</header><p>{LONG}</p></main><header>site</header>", f"By me {LONG}"),
        (f"<body class='has-sidebar'><div><ul><li><a href=1>Home</a><li><a href=2>News</a></ul></div><div><p>{LONG}<p>Short.<p>{LONG}</div><div id=comments>{LONG}</div>", f"{LONG} Short. {LONG}"),
        (f"<div class='cookie notice'>{LONG}</div><div><p>{LONG}</p></div><div class=ad>{LONG}</div>", LONG),
        (f"<script>var t='</p><p>no</p>';</script><style>p{{}}</style><p>{LONG}</p><!-- <p>no</p> -->", LONG),
        ("<div>" * 3000 + LONG, LONG),
        (f"<div class='page with-sidebar'><div class='nav'>Menu one</div><article><p>{LONG}</p></article></div>", LONG),
        (f"<div id=page class='has-banner'><div class=sidebar>Links here</div><div><p>{LONG}</p><p>{LONG}</p></div></div>", f"{LONG} {LONG}"),
        (f"<div class=ad>{LONG}</div><article><p>Tiny.</p></article>", "Tiny."),
        (f"<article><p>{LONG}</p></article><div class=comments><article class=comment>{LONG * 9}</article></div>", LONG),
    ],
)
def test_fixtures(page, want):
    assert main_text(page) == want


MENU = "<ul><li><a href=1>Home</a><li><a href=2>News</a></ul>"
FORMULA = "<math><semantics><mrow><mi>x</mi><mo>=</mo><mn>2</mn></mrow><annotation encoding='application/x-tex'>x=2</annotation></semantics></math>"


@pytest.mark.parametrize(
    "page, want",
    [
        (f"{MENU}<div><h1>Title</h1><p>Lead</p><div class=body><p>{LONG}</p><p>{LONG}</p></div><div><p>Last.</p></div></div>{MENU}", f"Title Lead {LONG} {LONG} Last."),
        (f"<div>{MENU}<h1><a href=3>Title</a></h1><p><a href=4>Jane</a></p></div><div><p>{LONG}</p><p>{LONG}</p></div>{MENU}<p>Far</p>", f"Title Jane {LONG} {LONG}"),
        (f"{MENU}<div><p>{LONG * 20}</p></div><div><p>{LONG}</p></div>", f"{LONG * 20} {LONG}"),
        (f"{MENU}<div><p>{LONG * 9}</p></div>{MENU}<div><p>{LONG * 9}</p></div>{MENU}", f"{LONG * 9} {LONG * 9}"),
        (f"{MENU}<div><p>{LONG * 9}</p></div>{MENU}<div><p><a href=1>{LONG * 20}</a></p></div>", f"{LONG * 9} {LONG * 20}"),
        (f"{MENU}<h1>Title</h1><article><p>{LONG}</p><p>{LONG}</p></article><h2>Part</h2><div><p>{LONG}</p></div>{MENU}", f"Title {LONG} {LONG} Part {LONG}"),
        (f"<article><p>{LONG * 9}</p><p>{LONG}</p></article>{MENU}<div><p>{LONG * 8}</p></div>{MENU}", f"{LONG * 9} {LONG} {LONG * 8}"),
        (f"<article><p>{LONG} {FORMULA}.</p></article>", f"{LONG} x = 2."),
    ],
)
def test_text_beside_the_region_and_formulas(page, want):
    assert main_text(page) == want


NINE = [f"{LONG} Part {i}." for i in range(9)]


def blocks(texts):
    return "".join(f"<p>{t}</p>" for t in texts)


@pytest.mark.parametrize("inside", range(1, 10))
def test_a_place_in_a_class_name_drops_nothing_at_any_share(inside):
    page = f"<body><div class='col has-sidebar'>{blocks(NINE[:inside])}</div>{blocks(NINE[inside:])}</body>"
    assert main_text(page) == " ".join(NINE)


@pytest.mark.parametrize(
    "page, want",
    [
        (f"<article><p>{LONG}</p><p class='no-ads'>No adverts here.</p></article>", f"{LONG} No adverts here."),
        (f"<article><p>{LONG}</p><p class='related-work'>{LONG}</p></article>", f"{LONG} {LONG}"),
        (f"<article><p>{LONG}</p><section id='search-for-truth'><p>{LONG}</p><p>So.</p></section></article>", f"{LONG} {LONG} So."),
        (f"<article><div class='lead-notice'>{LONG}</div><p>{LONG}</p></article>", f"{LONG} {LONG}"),
        (f"<article><div class='notice'><p>{LONG}</p></div><p>{LONG}</p></article>", f"{LONG} {LONG}"),
        (f"<article><p>{LONG}</p><div class='share'>Tell all</div><div class='related'><a href=1>{LONG}</a></div><p>{LONG}</p></article>", f"{LONG} {LONG}"),
        (f"<body><div class='article-header'><h1>Title</h1><p>Lead.</p></div><div><p>{LONG}</p><p>{LONG}</p></div></body>", f"Title Lead. {LONG} {LONG}"),
        (f"<body><div class='site-header'>Brand</div><div><p>{LONG}</p></div><div class='cookieNotice'>{LONG}</div><div id='ad-slot-3'>{LONG}</div></body>", LONG),
        (f"<article><p>{LONG}</p><div class='ad'><p>{LONG * 3}</p></div><div class='post-comments'><p>{LONG * 3}</p></div></article>", LONG),
        (f"<article><p>{LONG} Press the <button>OK</button> key. Result was <output>42</output> as shown.</p><button>Buy</button></article>", f"{LONG} Press the OK key. Result was 42 as shown."),
        (f"<div class='sidebar'><p>{LONG}</p></div>", LONG),
        (f"<div><p>{LONG}</p><div><a href=1>Home</a> <a href=2>News</a></div><p>{LONG}</p></div>", f"{LONG} {LONG}"),
        (f"<article><p>Teaser.</p></article><div><p>{LONG * 9}</p><p>Short.</p><p>{LONG * 9}</p></div>", f"Teaser. {LONG * 9} Short. {LONG * 9}"),
        (f"<article><p>{LONG}</p><![foo[ x ]]><![if !IE]><p>{LONG}</p></article>", f"{LONG} {LONG}"),
        (f"<article><p>{LONG} 1 <2 and a <!-- b<p>{LONG}</article><footer>x <y", f"{LONG} 1 <2 and a <!-- b {LONG}"),
    ],
)
def test_names_controls_menus_and_unfinished_markup(page, want):
    assert main_text(page) == want


@pytest.mark.parametrize(
    "part", ["<a ", "<!--", "<!-- ", "</", "</a", "<![", "<!", "<?", "<", "<a x=\"", "<a x='y", "<a/", "&#", "&", "<p>", "<b>", "<a>x<p>", "<script></", "<svg><p>", "<div class=ad>x", "--", "<li><a>x</a>"]
)
def test_a_megabyte_of_broken_markup(part):
    """Linear in the page, whatever never ends: a sixteenth of it takes no more than its share and a second."""
    text = f"<p>{LONG}</p>"

    def seconds(size):
        start = time.process_time()
        assert isinstance(main_text(text + part * (size // len(part)) + ">" * (part != "<a ") + text), str)
        return time.process_time() - start

    assert seconds(1 << 20) < 16 * 2 * seconds(1 << 16) + 1


def own_article(page):
    inner = re.search(r"<article>(.*?)(</article>|$)", page, re.S)[1]
    blocks = (" ".join(html.unescape(re.sub(r"</?b>", "", b)).split()) for b in re.split(r"</?(?:p|h1|br)>", inner))
    return " ".join(b for b in blocks if b)


def test_synthetic_pages(spark):
    pages = spark.read.parquet("/root/testdata/sf0.01/pages.parquet")
    source = {r.page_id: r for r in pages.collect()}
    got = extract(pages).collect()
    assert len(got) == len(source) > 100
    for r in got:
        assert r.text == own_article(source[r.page_id].html) and r.n_chars == len(r.text) and r.url == source[r.page_id].url


def test_nulls_repeats_long_and_extra_columns(spark):
    schema = "page_id bigint, url string, html string, text string, id string"
    rows = [(None, None, None, "t", "i"), (1, "u", "<p>x", "t", "i"), (1, "u", "<p>x", "t", "i"), (2, "u", "<p>" + "word " * 200_000, "t", "i")]
    got = sorted((r.n_chars, r.page_id) for r in extract(spark.createDataFrame(rows, schema)).collect())
    assert got == [(0, None), (1, 1), (1, 1), (999_999, 2)]
    assert extract(spark.createDataFrame([], schema)).collect() == []
