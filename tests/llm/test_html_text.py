from __future__ import annotations

import html
import re
import time

import pytest

from tests.conftest import DATA
from vellumine.llm import html_text as X

PARAGRAPH = "This is a paragraph of the article, long enough, with some commas, to be told from a menu."


def page(body):
    return f"<!DOCTYPE html><html><head><title>T</title><style>p{{}}</style></head><body>{body}</body></html>"


def test_article_without_its_surroundings():
    body = f"""<header>Site name</header><nav><ul><li><a href=/a>Menu</a></li></ul></nav><div class="ad">Buy, now, and more, and more of it all, today.</div>
    <article><h1>Head &amp; line</h1><p>{PARAGRAPH}<br>after the break</p><script>var t="</p>";</script><p>Second&nbsp; one,
    with   space.</p><ul><li>item one<li>item two</ul><form>Name <input> please, do, tell, us, now</form></article>
    <aside>Related, things, to, read</aside><div id="comments"><p>{PARAGRAPH} {PARAGRAPH}</p></div><footer>&copy; all</footer>"""
    assert X.main_text(page(body)) == f"Head & line\n{PARAGRAPH} after the break\nSecond one, with space.\nitem one\nitem two"


@pytest.mark.parametrize("name", ["cookie-notice", "sidebar", "widget promo", "post-comments", "newsletter_signup", "advert"])
def test_boilerplate_by_name(name):
    assert X.main_text(page(f'<div class="content"><p>{PARAGRAPH}</p><div class="{name}"><p>{PARAGRAPH}</p></div></div>')) == PARAGRAPH


@pytest.mark.parametrize("name", ["has-sidebar content", "with-footer", "shadow", "loads", "adapter"])
def test_names_that_only_look_like_boilerplate(name):
    assert X.main_text(page(f'<div class="{name}"><p>{PARAGRAPH}</p></div>')) == PARAGRAPH


def test_best_container_and_its_siblings():
    links = "".join(f'<p><a href="/{i}">A link, with commas, and enough of a text to count</a></p>' for i in range(20))
    body = f'<div><div id="x">{links}</div><div id="y"><h2>Head</h2><p>{PARAGRAPH}</p><p>{PARAGRAPH}</p></div><p>{PARAGRAPH}</p></div>'
    assert X.main_text(page(body)) == f"Head\n{PARAGRAPH}\n{PARAGRAPH}\n{PARAGRAPH}"


def test_unclosed_and_misnested_markup():
    assert X.main_text(page(f"<article><h1>H</h1><p><b>{PARAGRAPH}<br><p>Two</b> words<p>three</article>")) == f"H\n{PARAGRAPH}\nTwo words\nthree"
    assert X.main_text(f"<article><p>{PARAGRAPH}") == PARAGRAPH
    assert X.main_text(f"<article><p>{PARAGRAPH}</p><!-- never closed <p>x</p>") == PARAGRAPH
    assert X.main_text(f"<article><p>{PARAGRAPH}</p><script>never closed <p>x</p>") == PARAGRAPH


def test_odd_attributes():
    assert X.main_text(f"<article><p data=it's>{PARAGRAPH}</p><p title='a > b' x = \"</p>\">two</p><p class=\"open>three</p></article>").startswith(f"{PARAGRAPH}\ntwo")
    assert X.main_text(f"<p>{PARAGRAPH}</p><a " + 'x="y" ' * 5000) == PARAGRAPH


@pytest.mark.parametrize(("raw", "text"), [("", ""), (" \n ", ""), ("plain words", "plain words"), ("a &lt; b &#233; &eacute;", "a < b é é"), ("1 < 2 and 3 > 2", "1 < 2 and 3 > 2"), ("<nav>only a menu</nav>", ""), ("<p></p>", ""), ("<div hidden>no</div>", "")])
def test_small_pages(raw, text):
    assert X.main_text(raw) == text


def test_deep_and_long_pages():
    assert X.main_text("<div>" * 3000 + PARAGRAPH + "</div>" * 3000) == PARAGRAPH
    assert len(X.main_text(page("<article>" + f"<p>{PARAGRAPH}</p>" * 5000 + "</article>")).split("\n")) == 5000


def expected(raw):
    """The article of the driver's pages, by the marks that these pages have."""
    body = re.search(r"(?s)<article>(.*?)</article>", raw)[1].replace("<b>", "")
    blocks = [re.sub(r"\s+", " ", html.unescape(re.sub(r"<[^>]+>", " ", b))).strip() for b in re.split(r"</?(?:p|h1)>", body)]
    return "\n".join(b for b in blocks if b)


def test_driver_pages_and_columns(spark):
    pages = spark.read.parquet(f"{DATA}/pages.parquet")
    found = X.extract_pages(pages).collect()
    raw = {r.page_id: r for r in pages.collect()}
    assert len(found) == len(raw)
    for r in found:
        assert r.text == expected(raw[r.page_id].html)
        assert (r.url, r.n_chars) == (raw[r.page_id].url, len(r.text))


def test_nulls_repeats_and_clashing_columns(spark):
    frame = spark.createDataFrame([(1, None, None, "t"), (1, None, None, "t"), (None, "u", "🙂", "t")], "page_id long, url string, html string, text string")
    assert sorted((str(r.page_id), r.text, r.n_chars) for r in X.extract_pages(frame).collect()) == [("1", "", 0), ("1", "", 0), ("None", "🙂", 1)]
    assert X.extract_pages(frame.where("false")).count() == 0


HUGE = {
    "nested": "<div>some text, with commas, that is long enough to count " * 15_000,
    "unfinished": "<a " * 300_000,
    "quotes": '<a =">"' * 120_000,
    "cdata": "<![CDATA[" * 100_000,
    "declarations": "<!x " * 250_000,
    "closed in vain": "<div>" * 80_000 + "</x>" * 100_000,
    "items": "<span>" * 50_000 + "<li>a" * 50_000,
    "brackets": "<" * 900_000,
    "siblings": "<div>" + f"<p>{PARAGRAPH}</p>" * 10_000,
}


@pytest.mark.parametrize("name", HUGE)
def test_time_grows_with_the_page(name):
    began = time.process_time()
    X.main_text(HUGE[name])
    assert time.process_time() - began < 5


def test_what_an_article_keeps():
    body = f"""<header>Site</header><article><header class="header"><h1>Title</h1></header><p>{PARAGRAPH}</p><p>Where <math><mi>x</mi><mo>=</mo><mn>2</mn></math> holds.</p>
    <section id="discussion"><h2>Discussion</h2><p>{PARAGRAPH}</p></section><footer>Filed under</footer><div id="comments"><p>{PARAGRAPH} {PARAGRAPH}</p></div></article>"""
    assert X.main_text(page(body)) == f"Title\n{PARAGRAPH}\nWhere x=2 holds.\nDiscussion\n{PARAGRAPH}"
    # without an article, the same names are boilerplate
    assert X.main_text(page(f'<div><p>{PARAGRAPH}</p><section id="discussion"><p>{PARAGRAPH}</p></section></div>')) == PARAGRAPH


def test_brackets_and_broken_quotes_lose_no_text():
    assert X.main_text("a < b and 1<2 <3 </ x <p>next") == "a < b and 1<2 <3 </ x\nnext"
    assert X.main_text('<p class="x>one</p><p>two</p>') == X.main_text("<p>one</p><p>two</p>")


COMMENT = "A comment of a reader, which is rather long, with many, many commas, and words, and opinions, on everything, all of it."


@pytest.mark.parametrize("name", ["notice", "menu", "promotion", "related", "share social", "alert", "recommended"])
def test_sections_of_an_article_that_never_are_content(name):
    body = f'<article><h1>T</h1><p>{PARAGRAPH}</p><section class="{name}"><h2>x</h2><p>{COMMENT}</p></section><p>{PARAGRAPH}</p></article>'
    assert X.main_text(page(body)) == f"T\n{PARAGRAPH}\n{PARAGRAPH}"


def test_sections_of_an_article_in_doubt():
    def article(section):
        return page(f"<article><h1>T</h1><p>{PARAGRAPH}</p>{section}</article>")

    prose = f"<h2>Discussion</h2><p>{PARAGRAPH}</p><p>{PARAGRAPH}</p>"
    assert X.main_text(article(f'<section id="discussion">{prose}</section>')) == f"T\n{PARAGRAPH}\nDiscussion\n{PARAGRAPH}\n{PARAGRAPH}"
    # readers, links, and no heading
    readers = f'<h2>2 voices</h2><div><span class="author">Al</span><p>{COMMENT}</p></div><div><span class="author">Bo</span><p>{COMMENT}</p></div>'
    links = "<h2>Tags</h2>" + "".join(f'<a href="/{i}">a tag that is long enough to be a paragraph of prose, were it not a link</a>' for i in range(4))
    for section in (f'<section id="discussion">{readers}</section>', f'<section class="tags">{links}</section>', f'<section class="discussion"><p>{COMMENT}</p></section>'):
        assert X.main_text(article(section)) == f"T\n{PARAGRAPH}"


def test_articles_in_an_article_are_comments():
    inner = f"<article><p>{COMMENT} {COMMENT} {COMMENT}</p><article><p>{COMMENT}</p></article></article>"
    assert X.main_text(page(f"<article><h1>T</h1><p>{PARAGRAPH}</p>{inner}<p>{PARAGRAPH}</p></article>")) == f"T\n{PARAGRAPH}\n{PARAGRAPH}"
    # but one in a wrapper is the article
    assert X.main_text(page(f"<article><h2>News</h2><article><h1>T</h1><p>{PARAGRAPH}</p></article></article>")) == f"T\n{PARAGRAPH}"
    many = "".join(f"<article><h2>{k}</h2><p>{PARAGRAPH}</p></article>" for k in range(3))
    assert X.main_text(page(f"<article>{many}</article>")) == "\n".join(f"{k}\n{PARAGRAPH}" for k in range(3))


SPLIT = {
    "classes": '<div class="part"><h1>Title</h1></div><div class="part"><p>short intro</p></div><div class="part"><p>{p}</p><p>{p}</p></div><div class="ad"><p>{c}</p></div><div class="part"><p>{p}</p></div><div class="part"><p>The end.</p></div>',
    "bare": "<h1>Title</h1><div><p>short intro</p></div><div><p>{p}</p><p>{p}</p></div><div><p>{p}</p></div><div><p>The end.</p></div>",
    "rows": '<div class="row"><div class="col"><h1>Title</h1></div></div><div class="row"><div class="col"><p>short intro</p></div></div><div class="row"><div class="col"><p>{p}</p><p>{p}</p></div></div><div class="row"><div class="col"><p>{p}</p></div></div><div class="row"><div class="col"><p>The end.</p></div></div>',
}


@pytest.mark.parametrize("name", SPLIT)
@pytest.mark.parametrize("around", ["{}", "<div>{}</div>", '<div id="page"><div class="nav"><a href="/">Home</a></div>{}</div>'])
def test_article_over_siblings(name, around):
    body = around.format(SPLIT[name].format(p=PARAGRAPH, c=COMMENT)) + "<footer>end</footer>"
    assert X.main_text(page(body)) == f"Title\nshort intro\n{PARAGRAPH}\n{PARAGRAPH}\n{PARAGRAPH}\nThe end."


THREADS = {
    "apart": '<div class="content">{body}</div><div class="thread">' + '<div class="item"><p>{c}</p></div>' * 20 + "</div>",
    "names": '<div class="wrap">{body}<div class="list">' + '<div class="item"><p>Ann, 3 days ago</p><p>{c}</p></div>' * 20 + "</div></div>",
    "heading": '<div class="wrap">{body}<h2>Comments (20)</h2><div class="list">' + '<div class="item"><p>{c}</p></div>' * 20 + "</div></div>",
    "replies": '<div class="wrap">{body}<ul class="list">' + '<li><p>{c}</p><a href="#">Reply</a></li>' * 20 + "</ul></div>",
    "classes": '<div class="wrap">{body}<div class="stream">' + '<div class="row"><b class="username">x</b><p>{c}</p></div>' * 20 + "</div></div>",
    "headings": '<div class="wrap">{body}<div class="stream">' + '<div class="row"><h4 class="author">x</h4><p>{c}</p></div>' * 20 + "</div></div>",
    "in an article": "<article>{body}<div>" + '<div class="row"><span class="user-name">x</span><p>{c}</p><time>now</time></div>' * 20 + "</div></article>",
}


@pytest.mark.parametrize("name", THREADS)
def test_comments_under_neutral_names(name):
    body = f"<h1>T</h1><p>{PARAGRAPH}</p><p>{PARAGRAPH}</p>"
    assert X.main_text(page(THREADS[name].replace("{body}", body).replace("{c}", COMMENT))) == f"T\n{PARAGRAPH}\n{PARAGRAPH}"


def test_lists_of_an_article_are_no_thread():
    steps = "".join(f'<div class="step"><span>Step {k}</span><p>{PARAGRAPH}</p></div>' for k in range(4))
    books = "".join(f'<li><span class="author">Ann B.</span> A title of a book, which is long, {k}</li>' for k in range(4))
    live = "".join(f'<div class="entry"><h3>Event {k}</h3><span class="timestamp">10:3{k}</span><p>{PARAGRAPH}</p></div>' for k in range(4))
    text = X.main_text(page(f"<article><h1>T</h1><p>{PARAGRAPH}</p>{steps}<ul>{books}</ul>{live}</article>"))
    assert text.count(PARAGRAPH) == 9 and text.count("Ann B.") == 4 and "Step 3" in text and "10:33" in text


def test_sections_of_an_article_are_no_thread():
    parts = "".join(f'<div class="section"><h2>Part {k}</h2><p>{PARAGRAPH}</p></div>' for k in range(5))
    expected = "T\n" + "\n".join(f"Part {k}\n{PARAGRAPH}" for k in range(5))
    assert X.main_text(page(f'<div class="post"><h1>T</h1>{parts}</div>')) == expected
    assert X.main_text(page(f'<article><h1>T</h1><p class="author">By Ann</p>{parts}</article>')) == expected.replace("T\n", "T\nBy Ann\n", 1)
    plain = "".join(f'<div class="part"><p>{PARAGRAPH}</p></div>' for _ in range(5))
    assert X.main_text(page(f'<div class="post"><h1>T</h1><p>{PARAGRAPH}</p>{plain}</div>')).count(PARAGRAPH) == 6
