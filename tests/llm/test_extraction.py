"""Main text of pages with marked and unmarked articles, held against the text that was put in."""

import pytest

from tracklens.llm import extraction
from tracklens.llm.extraction import Weights, main_text

LINES = ["Rivers carry fine sand & silt from the hills", "A long second paragraph tells how the valley was cut over very many years by slow water", "The last part says what the farmers do when the fields are under water in spring"]
MENU = "".join(f'<li><a href="/{w}">{w}</a></li>' for w in ("home", "news", "sport", "weather", "about us", "contact"))
CHATTER = "I disagree with all of this and want to say so at some length here in public"

PLAIN = f"""<html><body class="page"><div id="header"><div class="logo">The Daily Site</div><ul class="menu">{MENU}</ul></div>
<div class="sidebar"><h3>Most read</h3><p>Ten things you never knew about the local council and its many members</p></div>
<div class="content"><h1>{LINES[0].replace("&", "&amp;")}</h1><p>{LINES[1]}</p><div class="ad"><p>Buy the best garden hose of the year now, only here</p></div><p>{LINES[2]}</p></div>
<div id="comments"><h3>Comments</h3><p>{CHATTER}</p><p>{CHATTER}</p></div><div class="footer"><p>Copyright 2020 The Daily Site, all rights reserved worldwide</p></div></body></html>"""
MAIN = f"""<!doctype html><head><title>x</title><script>if (a<b) {{ document.write("<p>no</p>") }}</script></head><body><header><h1>Site name</h1><nav><ul>{MENU}</ul></nav></header>
<div class="cookie-notice"><p>We use cookies to make this site work, do you agree to all of them?</p></div>
<main><h1>{LINES[0].replace("&", "&#38;")}</h1><!-- <p>old</p> --><p>{LINES[1][:20]}<em>{LINES[1][20:]}</em><form action=/x><label>Your mail</label><input name=a><button>Send it</button></form>
<aside><p>Related: read this other story too</p></aside><p>
{LINES[2].replace(" ", "  ")}
</main><footer>Imprint</footer>"""
NESTED = f"""<body><nav>{MENU}</nav><article><header><h1>{LINES[0].replace("&", "&amp")}</h1></header><p>{LINES[1]}<p>{LINES[2]}
<section class="comments"><article class="comment"><p>{CHATTER}</p></article></section></article><div>Other <a href=/>stories</a></div></body>"""
LISTED = f"""<body><div id=nav><ul>{MENU}</ul></div><div class="post"><h2>{LINES[0]}</h2><ul><li>{LINES[1]}</li><li>{LINES[2]}</li></ul></div><div class="social-share"><a>Share</a></div></body>"""


@pytest.fixture(scope="module")
def learnt(spark):
    return extraction.fit(spark.read.parquet("/root/testdata/sf0.001/pages.parquet"))


@pytest.mark.parametrize("page", [PLAIN, MAIN, NESTED, LISTED], ids=["plain", "main", "nested", "listed"])
def test_templates(learnt, page):
    for weights in (Weights(), learnt):
        assert main_text(page, weights) == " ".join(LINES)


def test_odd_pages(learnt):
    text = " ".join(f"word{i}" for i in range(50))
    for page, wanted in [
        (None, ""), ("", ""), ("<html><body></body></html>", ""), ("<nav>menu</nav>", ""), ("<p>a < b and c > d</p>", "a < b and c > d"),
        (f"<article><p>{text}<script>never closed {text}", text), (f"<article>{text}<!-- open {text}", text), (f"<article><p>{text}</p><p title='x>y'>one&nbsp;two</p></article>", f"{text} one two"),
        ("<article><h1></h1></article><footer>foot and much more of it</footer>", ""), (f"<article><p>x<b>y</b>z<br>{text}</article>", f"xyz {text}"), (f"<p>{text}</p><", f"{text} <"),
    ]:
        assert main_text(page, learnt) == wanted


def test_long_page(learnt):
    text = "Words of a very long page. " * 40_000
    assert main_text(f"<ul>{MENU}</ul><article><p>{text}</p></article><footer>end</footer>" + "<a b='c' " * 2000, learnt) == text.strip()


def test_table(spark, learnt):
    rows = [(1, "u", PLAIN, "x"), (1, "u", PLAIN, "x"), (None, None, None, "x"), (3, "v", "", None)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string, text string")
    got = sorted(map(tuple, extraction.extract(pages, learnt).collect()), key=repr)
    joined = " ".join(LINES)
    assert got == sorted([(1, "u", joined, len(joined)), (1, "u", joined, len(joined)), (None, None, "", 0), (3, "v", "", 0)], key=repr)
    assert extraction.extract(pages.limit(0), learnt).count() == 0
    assert extraction.fit(pages.limit(0)) == Weights()


def test_weights_are_learnt(spark):
    page = "<div class='zebra'><p>{0}</p></div><article><div class='lion'><p>{0}</p></div></article>".format("w " * 60)
    pages = spark.createDataFrame([(i, "u", page) for i in range(6)], "page_id long, url string, html string")
    weights = extraction.fit(pages)
    assert weights.features["name:zebra"] < -2 and weights.features["name:lion"] > 2
    unmarked = "<div class='lion'><p>{}</p></div><div class='zebra'><p>{}</p></div>".format("good " * 20, "bad " * 40)
    assert main_text(unmarked, weights) == ("good " * 20).strip()
