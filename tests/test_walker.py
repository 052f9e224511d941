"""Blocks of pages with nested, unclosed and crossed tags."""

import re
from html import unescape

import pytest

from quarryline.sources import walker


@pytest.mark.parametrize(
    ("html", "want"),
    [
        ("<p>One<p>Two <b>bold<p>Three</b> end", [("p", "One"), ("p", "Two bold"), ("p", "Three end")]),
        ("<div>a<div>b</div>c</div>d", [("div", "ac"), ("div>div", "b"), ("", "d")]),
        ("<ul><li>1<li>2<ul><li>2a</ul><li>3</ul>", [("ul>li", "1"), ("ul>li", "2"), ("ul>li>ul>li", "2a"), ("ul>li", "3")]),
        ("<table><tr><td>1<td>2<tr><td>3</table>x", [("table>tr>td", "1"), ("table>tr>td", "2"), ("table>tr>td", "3"), ("", "x")]),
        ("<p>a<script>var p = '</p>';</script>b<style>p{}</style>", [("p", "ab")]),
        ("<p>a<!-- <p>no --> b&amp;c &lt;d&gt;&nbsp;e<br>f<br/>g", [("p", "a b&c <d> e f g")]),
        ("</p>lost</div><p>kept", [("", "lost"), ("p", "kept")]),
        ("<div><p>in<span>side</div>after", [("div>p", "inside"), ("", "after")]),
        ("<p>un<b>closed", [("p", "unclosed")]),
        ("<article><h1>T</h1><p>a<blockquote>q<p>r</blockquote>s</article>", [("article>h1", "T"), ("article>p", "a"), ("article>blockquote", "q"), ("article>blockquote>p", "r"), ("article", "s")]),
        ("plain & text", [("", "plain & text")]),
        ("<p> </p>", []),
        ("", []),
        (None, []),
    ],
)
def test_blocks(html, want):
    found = [(path, text) for path, text, _ in walker.blocks_of(html)]
    assert sorted(found) == sorted((path, text) for path, text in want)


def test_pages(spark, sf_dir):
    """Blocks of the table's pages: paragraphs are those that a pattern finds in pages this plain, and all text of the body is in some block."""
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet")
    got = {}
    for r in walker.page_blocks(pages, "page_id", "html").orderBy("page_id", "pos").collect():
        got.setdefault(r.page_id, []).append(r)
    squeeze = lambda t: re.sub(r"\s+", "", t)
    for page_id, html in pages.select("page_id", "html").collect():
        whole = re.sub(r"(?is)<(script|style)[^>]*>.*?</\1>|<!--.*?-->|<[^>]*>", "", html)
        assert sorted(squeeze("".join(r.text for r in got.get(page_id, [])))) == sorted(squeeze(unescape(whole)))
        assert [r.pos for r in got.get(page_id, [])] == list(range(len(got.get(page_id, []))))
    none = walker.page_blocks(spark.createDataFrame([(1, None), (2, "")], "page_id int, html string"), "page_id", "html")
    assert none.count() == 0


def test_links_and_long_pages(spark):
    html = "<nav>" + "<a href='/x'>x</a> " * 5000 + "</nav>" + "<div>" * 2000 + "deep" + "<p>w</p>" * 100
    rows = walker.page_blocks(spark.createDataFrame([(7, html)], "page_id long, html string"), "page_id", "html").collect()
    assert sum(r.links for r in rows) == 5000 and rows[0].tag == "nav" and len(rows) == 102
