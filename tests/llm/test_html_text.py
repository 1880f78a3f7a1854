import html
import re
import time

import numpy as np
import pytest

from assayer.llm import html_text
from assayer.llm.html_text import Blocks, content_lines, extract_pages, main_text

PAGE = """<!doctype html><html><head><title>T</title><style>.x{}</style></head><body class="has-sidebar"><header><a href=/>Home</a> Site &amp; Co</header><nav><ul><li>Menu<li>Two</ul></nav>
<div id="wrap"><div class="cookie-notice">We use cookies.</div><main><article><header><h1>Title &lt;x&gt;</h1><div class=byline>By me</div></header><p>First   para with <a href=x>link</a> &nbsp;here.<p>Second para<br>line<ul><li>one<li>two</ul><script>var a="<p>no</p>";</script><table><tr><td>c1<td>c2</table>
<aside>side stuff</aside><div class="ad-slot">Buy!</div><form>Email<input></form><p hidden>not seen</article><section id=comments><article class=comment><p>I disagree with a long comment that is really quite long indeed, so long it would win.</p></article></section></main><div class=sidebar>links</div></div><footer>&copy; 2020</footer></body></html>"""


def test_article_without_the_rest():
    assert main_text(PAGE).split("\n") == ["Title <x>", "First para with link here.", "Second para", "line", "one", "two", "c1", "c2"]


def test_clusters_find_the_article_without_landmarks():
    page = """<body><div><a href=1>one</a> <a href=2>two</a> <a href=3>three</a></div><div id=x><div><p>Long text of the story goes here and it is quite long, you see, and more of it still.</p>
    <p>Short.</p><p>Another long paragraph of the story with many words that are dense in text.</p></div></div><div><a href=1>x</a> tiny <a href=2>y</a></div></body>"""
    got = main_text(page).split("\n")
    assert got[0].startswith("Long text") and got[1:] == ["Short.", "Another long paragraph of the story with many words that are dense in text."]


STORY = "The story is told here in a good number of words, as stories are, so that it is dense."


@pytest.mark.parametrize(
    "other",
    [
        '<div class="comments"><p>X, said a reader.</p></div>',
        '<section id="comment-list"><p>X</p></section>',
        '<article class="comment"><p>X</p></article>',
        '<article itemprop="comment"><p>X</p></article>',
        '<div class="side-bar left"><p>X</p></div>',
        "<aside><p>X</p></aside>",
        '<form action="/s"><p>X</p><select><option>X</select></form>',
        '<div role="alert">X</div>',
        '<div id="cookie-banner">X</div>',
        '<div class="ad">X</div>',
        '<ins class="adsbygoogle">X</ins>',
        '<div data-ad-slot="1">X</div>',
        '<div class="newsletter-form">X</div>',
        '<div style="display: none">X</div>',
        "<noscript>X</noscript>",
        "<template><p>X</p></template>",
        "<header><p>X</p></header>",
        '<div class="article-footer">X</div>',
        "<!-- X -->",
        "<style>X</style>",
        "<button>X</button>",
    ],
)
@pytest.mark.parametrize("frame", ["<article>{}</article>", "<body><article>{}</article></body>", '<div class="content no-sidebar"><div class="post with-comments">{}</div></div>'])
def test_what_is_left_out(frame, other):
    page = frame.format(f"<h1>Title</h1><p>{STORY}</p>{other}<p>Short.</p><p>{STORY}</p>")
    assert main_text(page) == f"Title\n{STORY}\nShort.\n{STORY}"


def test_own_headers_keep_their_headings():
    for head in ("<header><h1>Title</h1><p>By me</p></header>", '<div class="entry-header"><h1>Title</h1><span>By me</span></div>'):
        assert main_text(f"<article>{head}<p>{STORY}</p></article>") == f"Title\n{STORY}"
    assert main_text(f'<div><div class="post-header"><h1>Title</h1></div><p>{STORY}</p></div>') == f"Title\n{STORY}"
    assert main_text(f'<div class="site-header"><h1>Site</h1></div><article><p>{STORY}</p></article>') == STORY


@pytest.mark.parametrize(
    "page, want",
    [
        (None, ""),
        ("", ""),
        ("plain text", "plain text"),
        ("<p>cut off <b", "cut off"),
        ("<p>cut off <a href='x", "cut off"),
        ("<p>cut off</p></di", "cut off"),
        ("<p>a</p><!-- never closed <p>b</p>", "a"),
        ("a <3 b", "a <3 b"),
        ("<article><p>a &am", "a &am"),
        ("<nav>only a menu</nav>", ""),
        ("<p>a<p>b<div>c</div>d", "a\nb\nc\nd"),
        ("<p>&eacute;&#x41;&#66; &amp;amp;</p>", "éAB &amp;"),
        ("<pre>a\n  b\tc</pre>", "a b c"),
        ("</div></p>stray<p>", "stray"),
        ("<script>x</script><p>y</p><style>z", "y"),
        ("<p>" + "<b>" * 3000 + "deep", "deep"),
    ],
)
def test_odd_pages(page, want):
    assert main_text(page) == want


def test_smoothing_and_threshold():
    import numpy as np

    hit = content_lines(np.array([2.0, 1, 300, 200, 3, 250, 1, 1, 1, 1]), np.ones(10))
    assert hit[2:6].all() and not hit[-3:].any()
    assert content_lines(np.array([5.0]), np.array([1.0])).all()


def test_driver_pages_give_their_articles(spark):
    pages = spark.read.parquet("/root/testdata/sf0.001/pages.parquet")
    got = {r.page_id: r for r in extract_pages(pages).collect()}
    assert len(got) == pages.count()
    for r in pages.collect():
        inner = re.search(r"<article>(.*?)</article>", r.html, re.S)[1]
        want = [" ".join(html.unescape(re.sub(r"<[^>]+>", "", x)).split()) for x in re.split(r"</?(?:p|h1|br)>", inner)]
        assert got[r.page_id].text == "\n".join(x for x in want if x)
        assert got[r.page_id].n_chars == len(got[r.page_id].text)


def test_rows_stay(spark):
    rows = [(1, "u", PAGE), (1, "u", PAGE), (None, None, None), (2, "", "<p>" + "long " * 200_000)]
    got = extract_pages(spark.createDataFrame(rows, "page_id long, url string, html string").selectExpr("*", "1 as text", "2 as n_chars")).collect()
    assert len(got) == 4 and max(r.n_chars for r in got) == 5 * 200_000 - 1
    assert extract_pages(spark.createDataFrame([], "page_id long, url string, html string")).count() == 0


def test_parser_streams():
    p = Blocks()
    for c in PAGE:
        p.feed(c)
    assert [b[1] for b in p.finish()][:3] == ["Home Site & Co", "Menu", "Two"]


@pytest.mark.parametrize(
    "page",
    [
        "<html><head><title>T</title><body><article><p>{0}</p></article></body></html>",
        "<html><head><title>T</title><meta charset=utf-8><style>p {{}}</style><script>x()</script><article><p>{0}</p></article></html>",
        "<head><title>T</title><noscript><img src=x></noscript><link rel=a href=b><p>{0}",
        "<head><title>T</title>{0}",
        "<html><head><template><p>not this</p></template></head><body><p>{0}</p></body></html>",
        "<html><head><title>T</title></head><body><p>{0}</p></body></html>",
    ],
)
def test_open_head_ends_where_the_body_begins(page):
    text = "The river rose by two metres in the night and took the old bridge with it."
    assert main_text(page.format(text)) == text


def without_landmarks(page, footer=False):
    """A page whose article, menu and advert, and footer, nothing but their text tells apart."""
    names = "article|nav|footer" if footer else "article|nav"
    return re.sub(rf"</?(?:{names})>|<div class=\"ad\">", lambda m: {"</": "</div>"}.get(m[0][:2], "<div>"), page)


def articles(spark):
    for r in spark.read.parquet("/root/testdata/sf0.01/pages.parquet").collect():
        inner = re.search(r"<article>(.*?)</article>", r.html, re.S)[1]
        lines = [" ".join(html.unescape(re.sub(r"<[^>]+>", "", x)).split()) for x in re.split(r"</?(?:p|h1|br)>", inner)]
        yield r.html, "\n".join(x for x in lines if x)


def test_articles_are_found_without_landmarks(spark):
    got = [main_text(without_landmarks(page)) == want for page, want in articles(spark)]
    assert sum(got) >= 0.98 * len(got)


def test_the_clusters_decide(spark, monkeypatch):
    pages = list(articles(spark))
    right = lambda: sum(main_text(without_landmarks(page, footer=True)) == want for page, want in pages) / len(pages)
    with_clusters = right()
    monkeypatch.setattr(html_text, "content_lines", lambda plain, tags: np.ones(len(plain), bool))
    assert with_clusters >= 0.6 > 0.45 >= right()


LONG = "The river rose by two metres in the night and took the old bridge with it, and nobody saw it go."
ARTICLE = f"<h1>Title</h1><p>{LONG} {LONG}</p><p>Short.</p><p>{LONG}</p>"
WANTED = f"Title\n{LONG} {LONG}\nShort.\n{LONG}"


@pytest.mark.parametrize(
    "page",
    [
        "<form id=aspnetForm><div><nav><a href=1>x</a></nav><div class=content>{0}</div><footer>foot</footer></div></form>",
        "<form id=aspnetForm><article>{0}</article></form>",
        "<div class='layout sidebar-right'><article>{0}</article><div class=sidebar>{1}</div></div>",
        "<div class='layout sidebar-right'><div>{0}</div><div class=sidebar>{1}</div></div>",
        "<div id='search-layout'><div>{0}</div></div>",
        "<nav><ul><li><a href=1>x</a><li><a href=2>y</a></ul><article>{0}</article><footer>f</footer>",
        "<div class='legal-history'><article>{0}</article></div>",
        "<article><section class='social-policy'>{0}</section></article>",
        "<article>{0}</article><section class=related><article><h3>Other</h3><p>{1} {1} {1} {1}</p></article></section>",
        "<div class=post>{0}</div><div class=reader-comments><p>{1} {1} {1}</p><p>{1} {1} {1} {1}</p></div>",
        "<div>{0}</div><footer><p>{1} {1} {1} {1} {1} {1}</p></footer>",
        "<ul><li><a href=1>Home</a><li><a href=1>News</a><li><a href=1>Sport</a></ul>{0}<ul><li><a href=1>Imprint</a><li><a href=1>Privacy</a></ul>",
        "<article><div><a href=1>a</a> <a href=2>b</a></div>{0}<div><a href=1>c</a> <a href=2>d</a></div></article>",
    ],
)
def test_names_around_the_article_and_lists_beside_it(page):
    assert main_text("<html><head><title>T</title></head><body>" + page.format(ARTICLE, LONG)) == WANTED


def test_comments_are_never_the_article():
    assert main_text(f"<div class=comments><p>{LONG}</p><p>{LONG}</p></div>") == ""


@pytest.mark.parametrize("page", ["<div>a", "<blockquote><b>a", "<td><p>a", "<b>", "<li><ul>a", "a</x></y>", "<body><head>a"])
def test_deep_pages_take_time_in_proportion(page):
    begin = time.process_time()
    main_text(page * 20_000)
    assert time.process_time() - begin < 10
