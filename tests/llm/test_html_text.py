import html
import re
import time

import pytest

from plantpulse.llm import html_text as H
from plantpulse.llm.common import table


def test_generated_pages_equal_a_direct_reading(spark, sf):
    pages = {r.page_id: r for r in table(spark, sf, "pages").collect()}
    rows = H.extract_text(table(spark, sf, "pages")).collect()
    assert len(rows) == len(pages)
    for r in rows:
        article = re.search(r"<article>(.*?)</article>", pages[r.page_id].html, re.S).group(1)
        parts = re.split(r"</?(?:p|h1)>", re.sub(r"</?b>", "", article.replace("<br>", " ")))
        parts = [" ".join(html.unescape(p).split()) for p in parts]
        assert r.text == "\n".join(p for p in parts if p) and r.n_chars == len(r.text) and r.url == pages[r.page_id].url


@pytest.mark.parametrize("page, text", [
    ("<p>One<p>Two <b>bold<p>Three", "One\nTwo bold\nThree"),
    ("<div class='sidebar'><p>no no no no no</p></div><div id=main><p>yes yes yes &amp; more&nbsp;yes</p></div>", "yes yes yes & more yes"),
    ("<article><header><p>by me</p></header><h1>Title</h1><p>Body text.</p><div class='ad-box'>Buy</div><ul><li>a<li>b</ul></article>"
     "<div class='comments'><p>first!!</p></div>", "Title\nBody text.\na\nb"),
    ("<script>if (a < b) { x = '<p>no</p>' }</script><style>p{}</style><p>shown</p><!-- <p>hidden</p> --><noscript>off</noscript>", "shown"),
    ("<p>cut off in a ta", "cut off in a ta"), ("<p>text</p><a href='x", "text"), ("plain words", "plain words"), ("", ""), (None, ""),
    ("</div></p><p>stray &lt;tags&gt; &#233; &eacute;</p></section>", "stray <tags> é é"),
    ("<form><p>name</p></form><nav><p>menu menu menu</p></nav><p>  white \n\t space  </p>", "white space"),
    ("<table><tr><td>left<td>right<tr><td>below</table>", "left\nright\nbelow"),
])
def test_single_pages(page, text):
    assert H.extract(page, None) == text


def test_host_outvotes_a_page(spark):
    usual = "<body><div class='story{}'><p>{}</p></div><div class='links'><p>{}</p></div></body>"
    rows = [(i, f"http://h.example/{i}", usual.format(i, "main text of the page " * 9, "short")) for i in range(5)]
    rows += [(9, "https://h.example:80/odd", usual.format(7, "brief main text", "very long list of other things " * 20))]
    rows += [(10, "http://other.example/", usual.format(7, "brief main text", "very long list of other things " * 20)), (11, None, "<p>no url</p>")]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").selectExpr("*", "'x' AS text", "1 AS host", "2 AS path")
    texts = {r.page_id: r.text for r in H.extract_text(pages).collect()}
    assert texts[9] == "brief main text" and texts[10].startswith("very long") and texts[11] == "no url"


def test_null_empty_and_repeated(spark):
    rows = [(1, None, None), (2, "x", ""), (3, "http://a", "<p>t</p>"), (3, "http://a", "<p>t</p>"), (None, "http://a", "<p>u</p>")]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string")
    out = sorted((str(r.page_id), r.text, r.n_chars) for r in H.extract_text(pages).collect())
    assert out == [("1", "", 0), ("2", "", 0), ("3", "t", 1), ("3", "t", 1), ("None", "u", 1)]
    assert H.extract_text(pages.limit(0)).count() == 0


def test_deep_and_long_pages():
    page = "<b>" * 20_000 + "<p>" + "word " * 50_000
    assert len(H.extract(page, None)) == 5 * 50_000 - 1


LONG = "a sentence of the body that goes on for a while. " * 20


@pytest.mark.parametrize("page, text", [
    (f"<body><div class=post><h1>Title</h1><p>{LONG[:150]}</p><div class=body><p>{LONG}</p></div></div></body>", ("Title", LONG[:150], LONG)),
    (f"<body><div class=post><h1>Title</h1><div class=body><p>{LONG}</p></div></div></body>", ("Title", LONG)),
    (f"<div class=post><p>{LONG[:60]}</p><ul><li>{LONG}</ul><p>{LONG[:70]}</p></div>", (LONG[:60], LONG, LONG[:70])),
    (f"<div><table><tr><td><div>{LONG}</div></table><p>{LONG[:40]}</div>", (LONG, LONG[:40])),
])
def test_no_part_of_the_article_is_cut(page, text):
    assert H.extract(page, None) == "\n".join(" ".join(t.split()) for t in text)


def test_page_of_another_template_is_kept_whole(spark):
    usual = f"<body><div class=story><p>{LONG}</p></div><div class=foot><p>usual words at the foot of each page</p></div></body>"
    odd = f"<body><div class=story><p>one short block</p></div><div class=report><p>{LONG}</p></div><div class=foot><p>usual words at the foot</p></div></body>"
    rows = [(i, f"http://h.example/{i}", usual.replace("<div class=foot>", "<div class='foot'>")) for i in range(5)] + [(9, "http://h.example/9", odd)]
    texts = {r.page_id: r.text for r in H.extract_text(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert "one short block" in texts[9] and LONG.strip() in texts[9]
    assert all(LONG.strip() in texts[i] for i in range(5))


@pytest.mark.parametrize("mark", [
    "class='content has-sidebar'", "class='layout no-comments'", "class='post share-enabled'", "class='page-with-banner'",
    "id='content-search-results'", "class='sidebar'", "class='widget'", "role=search"])
def test_a_word_does_not_remove_the_article(mark):
    page = f"<body><div class=menu>short list</div><div {mark}><h1>Title</h1><p>{LONG}</p><div class='site-footer'>usual words at the foot</div></div></body>"
    assert H.extract(page, None) == "Title\n" + LONG.strip()
    small = f"<body><div class=news><div {mark.replace('sidebar', 'story').replace('widget', 'story').replace('role=search', '')}><p>{LONG[:90]}</p></div><p>{LONG}</p></div></body>"
    assert H.extract(small, None) == LONG[:90].strip() + "\n" + LONG.strip()


@pytest.mark.parametrize("name", [
    "sidebar-left", "nav-primary", "header-top", "related-posts", "share-buttons", "comment-thread", "ad-leaderboard",
    "cookie-consent-dialog", "adsbygoogle", "social-media", "user-reviews", "comments", "sidebar", "post-comments", "main-nav"])
@pytest.mark.parametrize("inside", [False, True])
def test_named_parts_are_left_out_whatever_their_size(name, inside):
    article, other = f"<h1>Title</h1><p>{LONG[:150]}</p>", f"<section class='x {name}'><p>{LONG * 5}</p></section>"
    page = f"<article>{article}{other}</article>" if inside else f"<div class=post>{article}</div>{other}"
    assert H.extract(page, None) == "Title\n" + LONG[:150].strip()


@pytest.mark.parametrize("page, text", [
    ("<p data-x=it's>Hello", "Hello"), ('<p><a href="x>link</a> and text of the page', "link and text of the page"),
    ('<p title="a > b">shown</p>', "shown"), ("<p title='<b>'>shown</p>", "shown"), ("<p alt=\"it's\">one</p><p>it's two</p>", "one\nit's two"),
    ("<div hidden><p>secret secret secret secret secret</p></div><p>open</p>", "open"), ("<p hidden='hidden'>no</p><p>open</p>", "open"),
    ("<p style='color:red; display: none'>no</p><p>open</p>", "open"), ("<p class='hidden-gem'>open</p>", "open"),
    ("<article><header><h1>Title</h1><p>by me</p></header><p>Body</p></article>", "Title\nBody"),
    ("<header><h1>Site</h1></header><article><p>Body</p></article>", "Body"),
    (f"<div class=comments><p>{LONG}</p></div>", ""),
])
def test_markup_and_hidden_parts(page, text):
    assert H.extract(page, None) == text


@pytest.mark.parametrize("page", ["<p>a<div></p>" * 5000, "<div>" * 20_000 + "<p>" + "word " * 100, "<ul><li>a" * 5000, "<div class=a>b" * 8000, '<p a="' * 8000])
def test_cost_does_not_explode_with_depth(page):
    start = time.process_time()
    H.votes(page)
    H.extract(page, 1, [2])
    assert time.process_time() - start < 1.0
