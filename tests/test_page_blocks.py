from __future__ import annotations

import time

import pytest

from tests.conftest import DATA
from vellumine.functions import page_blocks as P
from vellumine.operators import pages


def md(page):
    return P.to_markdown(P.main_blocks(page))


MARKDOWN = {
    "<h1>A &amp; b</h1><p>one <b>two</b> <i>three</i></p>": "# A & b\n\none **two** *three*",
    "<p>see <a href='/x?a=1&amp;b=2'>this <em>thing</em></a>.</p>": "see [this *thing*](/x?a=1&b=2).",
    "<ul><li>a<li>b<ul><li>c<li>d</ul><li>e</ul>": "- a\n- b\n  - c\n  - d\n- e",
    "<ol start=3><li><p>one</p><p>more</p></li><li>two</li></ol>": "3. one\n\n   more\n\n4. two",
    "<blockquote><p>q1</p><ul><li>i</li></ul></blockquote><p>after</p>": "> q1\n\n> - i\n\nafter",
    "<table><tr><th>a<th>b<tr><td>1<td><b>2</b> | 3</table>": "| a | b |\n| --- | --- |\n| 1 | **2** \\| 3 |",
    "<table><tr><td>1</td></tr><tr><td>2</td><td>3</td></tr></table>": "|  |  |\n| --- | --- |\n| 1 |  |\n| 2 | 3 |",
    "<pre><code>x = 1\n  y = `2`\n</code></pre>": "```\nx = 1\n  y = `2`\n```",
    "<pre>a ``` b</pre>": "````\na ``` b\n````",
    "<p>use <code>a*b</code> and 2*3 _x_ [y]</p>": "use `a*b` and 2\\*3 \\_x\\_ \\[y\\]",
    "<p># no head</p><p>- no item</p><p>1. no number</p>": "\\# no head\n\n\\- no item\n\n1\\. no number",
    "<p>one<br>two<br></p>": "one  \ntwo",
    "a<hr>b": "a\n\n---\n\nb",
    "<p><b> spaced </b>out</p>": "**spaced** out",
    "<p><b>open<p>next</b> end": "**open**\n\nnext end",
    "<p><img src=a.png alt='A [pic]'> x</p>": "![A \\[pic\\]](a.png) x",
    "<nav>menu</nav><main><header><h1>T</h1></header><p>x</p><aside>no</aside></main><p>out</p>": "# T\n\nx",
    "<header>site</header><article><h2>A</h2></article><div class='side-bar sidebar'>s</div><article>B</article>": "## A\n\nB",
    "<p>1 < 2 && 3 > 2</p>": "1 \\< 2 && 3 \\> 2",
    "<p>a<!-- no --><script>x('</p>')</script>b<![CDATA[<c>]]></p>": "ab\\<c\\>",
    "": "",
    "plain": "plain",
    "<dl><dt>t<dd>d<dt>u</dl>": "t\n\nd\n\nu",
}


@pytest.mark.parametrize("page", MARKDOWN)
def test_markdown(page):
    assert md(page) == MARKDOWN[page]


def test_items_that_start_with_a_list_and_deep_ones():
    assert md("<ul><li><ul><li>x</li></ul></li></ul>") == "- - x"
    assert md("<ol><li>a<ul><li>b<ol><li>c") == "1. a\n   - b\n     1. c"
    assert md("<ul><li>a<blockquote>q<ul><li>b</ul></blockquote></ul>") == "- a\n\n  > q\n\n  > - b"


def test_nested_tables_are_one():
    assert md("<table><tr><td>a<table><tr><td>b<td>c</table></td><td>d</table>") == "|  |  |\n| --- | --- |\n| a b c | d |"


HUGE = {
    "divs": "<div>some text " * 30_000,
    "unfinished": "<a " * 300_000,
    "quotes": '<a =">"' * 120_000,
    "apostrophes": "<a x='" * 120_000 + ">",
    "items": "<ul><li>x" * 2_000,
    "closed in vain": "<div>" * 50_000 + "</x>" * 100_000,
    "bold": "<b>x" * 3_000,
    "brackets": "<" * 900_000,
    "cells": "<table>" + "<tr><td>a<td>b" * 20_000,
    "comments": "<!-- " * 200_000,
    "paragraphs": "<p>a paragraph, with <a href=/x>a link</a>" * 20_000,
}


@pytest.mark.parametrize("name", HUGE)
def test_time_grows_with_the_page(name):
    began = time.process_time()
    md(HUGE[name])
    assert time.process_time() - began < 8


def test_pages_and_columns(spark):
    frame = spark.createDataFrame([(1, None, "t"), (1, None, "t"), (None, "<title>N</title><p>🙂 <b>x</b>", "t")], "page_id long, html string, markdown string")
    rows = sorted(map(tuple, pages.page_content(frame).collect()), key=str)
    assert rows == [(1, None, "", "", 0), (1, None, "", "", 0), (None, "N", "🙂 x", "🙂 **x**", 1)]
    assert pages.page_content(frame.where("false")).count() == 0


def test_driver_pages(spark):
    for r in pages.page_content(spark.read.parquet(f"{DATA}/pages.parquet")).collect():
        assert r.markdown.startswith("# ") and r.n_blocks == len(r.text.split("\n"))
