"""Main text of pages: the given pages against their articles, page layouts by hand, odd and broken markup."""

import html
import re
import time

import pytest

from tallyfield.llm import html_text
from tallyfield.llm.catalog import op13_html_text
from tallyfield.llm.html_text import main_text

ONE = "The council met on Monday and agreed that the bridge over the river will be closed for repairs until the end of the year."
TWO = "It is the second time in ten years that the town has had to close it, and most of the shops near the bridge are worried."
AD = "This is the best offer that you will see in the whole year, and it is only for you and for your friends, so do not wait."
MENU = '<ul><li><a href="/a">Home</a></li><li><a href="/b">News of the day</a></li></ul>'


def article_of(source):
    inside = re.search(r"<article>(.*?)</article>", source, re.S)[1]
    blocks = (re.sub(r"<br>", " ", re.sub(r"</?b>", "", b)) for b in re.split(r"</?(?:h1|p)>", inside))
    return " ".join(t for b in blocks if (t := " ".join(html.unescape(b).split())))


def test_query_finds_every_article(spark):
    sf = "/root/testdata/sf0.01"
    pages = {r.page_id: r for r in spark.read.parquet(f"{sf}/pages.parquet").collect()}
    got = op13_html_text(spark, sf).collect()
    assert len(got) == len(pages)
    for r in got:
        assert r.text == article_of(pages[r.page_id].html) and r.n_chars == len(r.text) and r.url == pages[r.page_id].url


@pytest.mark.parametrize(
    "around",
    [
        f"<header><h2>The Daily</h2>{MENU}</header>{{}}<footer>{AD}</footer>",
        f'<div class="page-header">The Daily</div><div id="nav">{MENU}</div>{{}}<div class="footer">{AD}</div>',
        f'<div class="cookie-notice"><p>{AD}</p><button>Accept</button></div>{{}}<aside><p>{AD}</p></aside>',
        f'<div class="content has-sidebar">{{}}</div><div class="sidebar"><h3>Most read</h3><p>{AD}</p>{MENU}</div>',
        f'<div class="adBox">{AD}</div>{{}}<section id="comments"><h3>Comments</h3><div class="comment"><p>{AD}</p></div></section>',
        f'<form action="/"><nav>{MENU}</nav>{{}}<input name="q"></form>',
        f'{{}}<form><label>Your mail</label><p>{AD}</p><select><option>a</option></select><textarea>{AD}</textarea></form>',
        f'{{}}<div role="complementary">{AD}</div><div hidden>{AD}</div><p style="display: none">{AD}</p><noscript>{AD}</noscript>',
        f"<table><tr><td>{MENU}</td><td>{{}}</td></tr></table>",
        f'<script>var a = "</p><p>{AD}";</script><style>p {{{{}}}}</style><!-- <p>{AD}</p> -->{{}}<svg><text>{AD}</text></svg>',
    ],
)
@pytest.mark.parametrize("inner", ["<article>{}</article>", "<main><div>{}</div></main>", '<div class="entry-content">{}</div>'])
def test_layouts(around, inner):
    body = f"<h1>A bridge closes</h1><p>{ONE}</p><p>By then.</p><ul><li>Short one</li><li>Short two</li></ul><p>{TWO}</p>"
    page = f"<!DOCTYPE html><html><head><title>{AD}</title></head><body>{around.format(inner.format(body))}</body></html>"
    assert main_text(page) == f"A bridge closes {ONE} By then. Short one Short two {TWO}"


def test_furniture_within_an_article():
    page = f'<article class="post comments-open"><header><h1>A bridge</h1><p>By A. Writer</p></header><p>{ONE}</p><div class="ad">{AD}</div><aside>{AD}</aside><p class="share-links"><a href="/x">Share</a></p><p>{TWO}</p><footer>{AD}</footer><section class="comments"><article class="comment"><p>{AD}</p></article></section></article><div><p>{AD}</p></div>'
    assert main_text(page) == f"A bridge By A. Writer {ONE} {TWO}"


def test_open_blocks_follow_their_neighbours():
    links = " ".join(f'<p><a href="/{i}">Link number {i}</a></p>' for i in range(5))
    assert main_text(f"{links}<p>Tags</p>{links}<h2>Title</h2><p>{ONE}</p><p>Short.</p><p>{TWO}</p><p>The end.</p>{links}<p>Imprint</p>") == f"Title {ONE} Short. {TWO} The end."
    assert main_text(f"<p>{ONE}</p><p>{'xqz ' * 60}</p>") == ONE
    assert main_text(f"<article><p>{ONE}</p><p>{'xqz ' * 60}</p></article>") == f"{ONE} {('xqz ' * 60).strip()}"
    foreign = "Sala xodre mivana torpes lunaki redo bastun " * 5
    assert main_text(f"<nav>{MENU}</nav><div><p>{foreign}</p></div><footer>Imprint</footer>") == foreign.strip()


@pytest.mark.parametrize(
    ("source", "want"),
    [
        (f"<article><p><b>{ONE}<br><p>a<i>b</i>c<br/>d\n\t e&nbsp;&amp;amp; &#x41;&lt;p&gt;", f"{ONE} abc d e &amp; A<p>"),
        (f"<article><p>{ONE}<p>{TWO}</article", f"{ONE} {TWO}"),
        (f"<article><p>{ONE}</p><!-- open <p>{TWO}", ONE),
        (f"<article><p>{ONE}</p><p class='a <p>{TWO}", ONE),
        (f"<ARTICLE><P CLASS=a>{ONE}</P><P title='<p>' data-x=\"a>b\" it's>{TWO}</P></ARTICLE>", f"{ONE} {TWO}"),
        (f"<article><p>{ONE} 1 < 2 <3 <> &am &amp</p></p></b></div></article>", f"{ONE} 1 < 2 <3 <> &am &"),
        (f"<article><!--><p>{ONE}</p><!-- a --><?x y?><p>{TWO}</p></article>", f"{ONE} {TWO}"),
        (f"<article><ul><li>{ONE}<li>{TWO}<ul><li>c</ul></ul><table><tr><td>d<td>e<tr><td>f</table></article>", f"{ONE} {TWO} c d e f"),
        (f"<div><article><p>{ONE}</p></div><p>{AD}</p>", ONE),
        ("", ""),
        (None, ""),
        ("no tags", ""),
        ("<html><head><title>only</title></head></html>", ""),
    ],
)
def test_broken_markup(source, want):
    assert main_text(source) == want


@pytest.mark.parametrize("part", ["<div>", "<p>", "</p>", "<!--", "<a href='", "<script>", "<span>", "</span><b>", "<li><ul>", "<table><tr><td>", "&", "<", "<article>", "<!", "<td a='", "<form><aside>"])
def test_work_grows_with_the_page_only(part):
    began = time.process_time()
    main_text(part * 100_000)
    assert time.process_time() - began < 20


def test_odd_rows(spark):
    rows = [(1, None, None), (2, "u", ""), (None, None, f"<p>{ONE}</p>"), (4, "u", f"<p>{ONE}</p>"), (4, "u", f"<p>{ONE}</p>"), (5, "u", "<article>" + f"<p>{ONE}</p>" * 20_000), (6, "u", "<p>é\U0001f600")]
    table = spark.createDataFrame([(*r, "t", 1) for r in rows], "page_id int, url string, html string, text string, n_chars int")
    got = sorted((r.page_id or 0, r.url, r.text, r.n_chars) for r in html_text.extract(table).collect())
    long = " ".join([ONE] * 20_000)
    assert got == [(0, None, ONE, len(ONE)), (1, None, "", 0), (2, "u", "", 0), (4, "u", ONE, len(ONE)), (4, "u", ONE, len(ONE)), (5, "u", long, len(long)), (6, "u", "", 0)]
    assert html_text.extract(table.limit(0)).collect() == []
