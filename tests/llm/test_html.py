import html
import re

import duckdb
import pytest

from spokeflow.llm import html_text, registry
from tests.oracle import SF


def plain(page):
    inner = re.search(r"<article>(.*?)(?:</article>|\Z)", page, re.S).group(1)
    blocks = (" ".join(html.unescape(re.sub(r"<[^>]*>", "", b.replace("<br>", " "))).split()) for b in re.split(r"</?(?:p|h1)>", inner))
    return "\n\n".join(b for b in blocks if b)


def test_query(spark):
    pages = dict(duckdb.sql(f"select page_id, html from '{SF}/pages.parquet'").fetchall())
    out = registry.op4_html(spark, SF).collect()
    assert len(out) == len(pages)
    assert all(r.text == plain(pages[r.page_id]) and r.n_chars == len(r.text) for r in out)


PAGE = """<html><head><title>T</title><style>p{}</style></head><body><header><h1>Site</h1><ul><li><a href=1>a</a></ul></header><div id=wrap>
<div class="cookie-notice">We use cookies, all of them, always, and so on and so forth.</div>
<div class="main-col"><h1>Head &amp; line</h1><p>First para with text, and a comma, enough of it to count as a real paragraph of prose.
<p>Second   para&nbsp;here is also long enough, I think, to count in the score, surely.</p><blockquote><p>Quote text.</p></blockquote>
<ul><li>one<li>two</ul><div class="share"><a href=#>Share</a></div>
<div class=comments><p>I, for one, think, that this is a long comment by a reader, with commas, a lot.</p></div></div>
<div class=sidebar><p>Some side text, with a comma, that is rather long and would score a bit too.</p></div></div>
<form><p>Sign up, now, for the newsletter of the century please do it</p></form><footer>c</footer></body></html>"""


def test_page_parts():
    assert html_text.main_text(PAGE).split("\n\n") == [
        "Head & line", "First para with text, and a comma, enough of it to count as a real paragraph of prose.",
        "Second para here is also long enough, I think, to count in the score, surely.", "Quote text.", "one", "two",
    ]


@pytest.mark.parametrize(
    "page,want",
    [
        (None, ""), ("", ""), (" ", ""), ("<p", ""), ("<p>short", "short"), ("plain text", "plain text"), ("<script>if(a<b){}", ""), ("<!-- x", ""),
        ("<div><p>unclosed <b>bold <i>it</p><p>x", "unclosed bold it\n\nx"), ("<table><tr><td>a<td>b<tr><td>c</table>", "a\n\nb\n\nc"),
        ("a &lt;b&gt; &copy &#x41; &bogus;", "a <b> © A &bogus;"), ("<p hidden>no<p>yes", "yes"), ("a<br>b", "a b"),
    ],
)
def test_odd_pages(page, want):
    assert html_text.main_text(page) == want


def test_deep_and_long_pages(spark):
    assert html_text.main_text("<div>" * 5000 + "x, y " * 50 + "</div>" * 5000).startswith("x, y")
    df = spark.createDataFrame([(1, None, None, 2), (1, "u", "<p>a", 2)], "page_id long, url string, html string, text int")
    assert sorted(map(tuple, html_text.extract(df).collect()), key=repr) == [(1, "u", "a", 1), (1, None, "", 0)]
    assert html_text.extract(df.limit(0)).count() == 0


PROSE = "A sentence of the article, with a comma, that goes on for long enough to count as a paragraph of prose. "


@pytest.mark.parametrize("inside", [
    '<section id="related-work">{}</section>', '<section id="discussion">{}</section>', '<div id="share-of-income">{}</div>', '<div id="popular-culture">{}</div>',
    '<p id="social-impact">{}</p>', '<div class="header"><h1>{}</h1></div>', '<section class="cookie-recipes">{}</section>', '<div id="related">{}</div>',
])
@pytest.mark.parametrize("around", ["<article>{}</article>", "<main>{}</main>", "<div class=post>{}</div>"])
@pytest.mark.parametrize("said", ["Short, own words.", PROSE * 4])
def test_headings_as_ids_keep_their_text(inside, around, said):
    page = "<body><nav>menu</nav>" + around.format(f"<p>{PROSE}</p><p>{PROSE}</p>{inside.format(said)}<p>{PROSE}</p>") + "<div class=comments>" + f"<p>{PROSE}</p>" * 9 + "</div></body>"
    assert html_text.main_text(page).split("\n\n") == [PROSE.strip()] * 2 + [said.strip(), PROSE.strip()]


@pytest.mark.parametrize("part", [
    '<div class="comments"><p>{0}</p></div>', '<div id="comments"><p>{0}</p></div>', '<div class="sidebar-left"><p>{0}</p></div>', '<div class="related-posts"><p>{0}</p></div>',
    '<div class="cookie-banner"><p>{0}</p></div>', '<div id="share-buttons">{0}</div>', '<div class="widget social"><p>{0}</p></div>', '<div id="related-reading"><a href=1>{0}</a><a href=2>{0}</a></div>',
])
def test_named_parts_go(part):
    page = f"<article><p>{PROSE}</p>{part.format(PROSE * 3)}<p>{PROSE}</p></article>"
    assert html_text.main_text(page) == f"{PROSE.strip()}\n\n{PROSE.strip()}"


def test_many_doubtful_names():
    assert html_text.main_text("<div class=share-of-x>" * 5000 + PROSE * 5 + "</div>" * 5000) == (PROSE * 5).strip()


LONG = PROSE.strip()
REFERENCES = "".join(f"<li><a href=/r{i}>Reference number {i}</a></li>" for i in range(5))
MENU = "<ul>" + "".join(f"<li><a href=/{i}>menu {i}</a></li>" for i in range(6)) + "</ul>"


@pytest.mark.parametrize("page,want", [
    # an article keeps its own lists of links
    (f"<body><nav>{MENU}</nav><article><h1>Head</h1><p>{PROSE}</p><p>{PROSE}</p><ol>{REFERENCES}</ol></article></body>", ["Head", LONG, LONG, *[f"Reference number {i}" for i in range(5)]]),
    (f"<body><div class=post><p>{PROSE}</p><p>{PROSE}</p><table><tr><td><a href=1>one</a><td><a href=2>two</a><td><a href=3>three</a> so</table></div></body>", [LONG, LONG, "one", "two", "three so"]),
    # names of headings
    (f'<article><p>{PROSE}</p><div class="text related-work"><p>{PROSE}</p></div><section class="tags"><p>{PROSE}</p></section><div class="comment-policy-discussion"><p>{PROSE}</p></div></article>', [LONG] * 4),
    (f'<article><p>{PROSE}</p><section class="popular"><h2>Popular views</h2><p>{PROSE}</p></section><section class="alert"><p>Own words.</p></section></article>', [LONG, "Popular views", LONG, "Own words."]),
    # a headline beside the article
    (f"<div><h1>Head</h1><article><p>{PROSE}</p><p>{PROSE}</p></article></div>", ["Head", LONG, LONG]),
    (f"<body><h1>The site</h1><article><h1>Head</h1><p>{PROSE}</p></article></body>", ["Head", LONG]),
    # a form around the page, and one in it
    (f"<form action=x><h1>Head</h1><div class=content><p>{PROSE}</p><p>{PROSE}</p></div><footer>foot</footer></form>", ["Head", LONG, LONG]),
    (f"<main><p>{PROSE}</p><form><label>Mail</label><input name=m><p>{PROSE}</p></form><p>{PROSE}</p></main>", [LONG, LONG]),
    # old pages of tables
    (f"<table><tr><td class=menu>{MENU}</td><td><p>{PROSE}<p>{PROSE}</td></tr></table>", [LONG, LONG]),
    # a page without any container
    (f"{MENU}<p>{PROSE}<p>{PROSE}", [LONG, LONG]),
    # boxes inside the article
    (f'<article><header><h1>Head</h1><p>By a writer</p></header><p>{PROSE}</p><aside>{PROSE}</aside><div class="ad">{PROSE}</div><div class="share"><a href=1>Share</a></div><div class=notice>{PROSE}</div>'
     f'<p>{PROSE}</p><div id=comments><p>{PROSE * 5}</p></div><footer>x</footer></article>', ["Head", "By a writer", LONG, LONG]),
    # character references and white space
    ("<article><p>a&nbsp; b c\n\t d &amp;amp; &#169;<br>e</p><p>   </p><pre>x\n  y</pre></article>", ["a b c d &amp; © e", "x y"]),
    # articles side by side, and one list of short ones
    (f"<main><article><p>{PROSE}</p><p>{PROSE}</p></article><article><p>{PROSE}</p><p>{PROSE}</p></article></main>", [LONG] * 4),
    # inline elements with blocks in them, text beside blocks
    (f"<article>Lead <span>in <div>box</div> after</span><p>{PROSE}</p> tail</article>", ["Lead in", "box", "after", LONG, "tail"]),
    # formulas are text
    (f"<article><p>{PROSE}</p><p>Let <math><mi>x</mi><mo>=</mo><mn>1</mn></math> hold.</p></article>", [LONG, "Let x=1 hold."]),
])
def test_page_forms(page, want):
    assert html_text.main_text(page).split("\n\n") == want


def climbed(root, density):
    """Points passed up paragraph by paragraph, as the method words it."""
    score, seen = {}, {}
    for n, said in html_text._paragraphs(root):
        if len(said) < 25 or n.tag in ("html", "figcaption", "caption", "summary"):
            continue
        points = (1 + sum(map(said.count, ",،、，")) + min(len(said) / 100, 3)) * (1 - density(n))
        holder, share = (n if n.tag in ("article", "main", "section", "div", "td") else n.up), 1.0
        while holder is not None:
            score.setdefault(id(holder), html_text._bonus(holder))
            seen[id(holder)] = holder
            score[id(holder)] += points * share
            holder, share = holder.up, share / 2 if share == 1.0 else share / 3
    return score


def test_points_against_climbing():
    import random

    r = random.Random(4)
    pages = [h for _, h in duckdb.sql(f"select page_id, html from '{SF}/pages.parquet' order by 1 limit 40").fetchall()]
    tags = ["div", "section", "p", "ul", "li", "article", "td", "b", "blockquote", "h1", "span"]
    for _ in range(300):
        pages.append("".join(r.choice([f"<{r.choice(tags)}>", f"</{r.choice(tags)}>", PROSE, "few words ", "<a href=1>link, here</a>", '<div class="post">', '<div class="related">']) for _ in range(40)))
    for page in pages:
        root = html_text.parse(page)
        html_text.prune(root)
        size = html_text._measures(root)
        density = lambda n: size[id(n)][1] / size[id(n)][0] if size[id(n)][0] else 0.0  # noqa: E731, B023
        got = {i: x for i, (_, x) in html_text._scores(root, density).items()}
        want = climbed(root, density)
        assert got.keys() == want.keys() and all(abs(got[i] - want[i]) < 1e-6 for i in want)


@pytest.mark.parametrize("page", [
    "<div>" * 100_000 + PROSE + "</div>" * 100_000, f"<div><p>{PROSE}" * 20_000, "<b><div>" * 80_000 + PROSE, "</i>" * 200_000 + PROSE, "<i><table><td>" + "<div>" * 30_000 + "</i>" * 100_000 + PROSE,
    "<ul><li>" * 60_000 + PROSE, "<header>" * 100_000 + PROSE, "<p " + "\"'" * 300_000, f"<section><header>{PROSE}</header>" * 20_000,
])
def test_large_nested_pages_in_seconds(page):
    import time

    began = time.perf_counter()
    html_text.main_text(page)
    assert time.perf_counter() - began < 20


def test_clashing_columns(spark):
    df = spark.createDataFrame([(1, "u", "<p>a", 2, "x", "y"), (1, "u", "<p>a", 2, "x", "y")], "page_id long, url string, html string, text int, _id string, n_chars string")
    assert sorted(map(tuple, html_text.extract(df).collect())) == [(1, "u", "a", 1)] * 2


LONG = "The harbour lay quiet that morning, and the boats, all of them, stood still upon the grey water while the town slept on. " * 3
MORE = "Later in the day the wind rose, the nets were taken in, and nobody, not even the oldest of the men, went out again. " * 3
CLEAN = f"{LONG.strip()}\n\n{MORE.strip()}"
SAID = "I was there that day, and I can say that it was not at all like this, believe me, whatever the paper writes."
BUY = "Buy the new boat shoes, now at half the price, and walk on any deck, wet or dry, without a slip, in all sizes."


@pytest.mark.parametrize("block", [
    f'<div class="user-comments"><div class="row"><span class="author">Ann</span><p>{SAID}</p></div><div class="row"><span class="author">Bob</span><p>{SAID}</p></div></div>',
    f'<div class="user-comments"><p>{SAID}</p></div>',
    f'<div id="discussion"><h2>Discussion</h2><div class="e"><b class="user">Ann</b><time>3 May</time><p>{SAID}</p></div><div class="e"><b class="user">Bob</b><time>4 May</time><p>{SAID}</p></div></div>',
    f'<div class="promo-card"><p>{BUY}</p></div>', f'<div class="sponsored-content"><p>{BUY}</p></div>', f'<div class="ad-300x250"><p>{BUY}</p></div>',
    f'<div id="google_ads"><p>{BUY}</p></div>', f'<section class="newsletter-cta"><h3>Our letter</h3><p>{BUY}</p></section>',
    f'<section class="reader-comments-v2"><ol><li class="c"><cite>Ann</cite> {SAID}</li><li class="c"><cite>Bob</cite> {SAID}</li></ol></section>',
])
@pytest.mark.parametrize("outer", ["article", "main"])
def test_what_is_no_article_goes_by_its_structure(block, outer):
    page = f"<html><body><{outer}><p>{LONG}</p>{block}<p>{MORE}</p></{outer}></body></html>"
    assert html_text.main_text(page) == CLEAN


@pytest.mark.parametrize("block,want", [
    (f'<section id="related-work"><h2>Related work</h2><p>{SAID}</p></section>', f"Related work\n\n{SAID}"),
    (f'<section id="discussion"><h2>Discussion</h2><p>{SAID}</p><p>{BUY}</p></section>', f"Discussion\n\n{SAID}\n\n{BUY}"),
    (f'<section id="the-first-newsletter-of-1890"><h2>The first newsletter of 1890</h2><p>{SAID}</p></section>', f"The first newsletter of 1890\n\n{SAID}"),
    (f'<div class="ad-hoc-networks"><p>{SAID}</p></div>', SAID),
    ('<ul class="related-work"><li><a href="/a">The sea chart</a>, which all pilots of that coast still use today</li><li><a href="/b">Tides</a>, a table of the year</li></ul>',
     "The sea chart, which all pilots of that coast still use today\n\nTides, a table of the year"),
    (f'<div class="share-of-income"><p>{SAID}</p></div>', SAID),
])
def test_what_is_article_stays(block, want):
    page = f"<html><body><article><p>{LONG}</p>{block}<p>{MORE}</p></article></body></html>"
    assert html_text.main_text(page) == f"{LONG.strip()}\n\n{want}\n\n{MORE.strip()}"


def test_siblings_of_one_form_stay_together():
    page = f"<html><body><div><div><p>{LONG}</p></div><div><p>Short middle.</p></div><div><p>{MORE}</p></div><div><p>Short end.</p></div></div><footer>x</footer></body></html>"
    assert html_text.main_text(page) == f"{LONG.strip()}\n\nShort middle.\n\n{MORE.strip()}\n\nShort end."
    page = f'<html><body><div class="a"><p>{LONG}</p></div><div class="a"><p>{MORE}</p></div><div class="links"><a href="/x">One</a></div><div class="a"><p>far</p></div></body></html>'
    assert html_text.main_text(page) == CLEAN
