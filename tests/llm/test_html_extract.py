import html
import re
import time
from itertools import product

import numpy as np
import pytest

from strata.llm import html_extract as h

SF = "/root/testdata/sf0.01"
P = "This is a sentence of the article that says something about its subject, and it goes on for a while."


def cut_value(source, sink, links, labels):
    total = sum(b if x else a for a, b, x in zip(source, sink, labels))
    return total + sum(c for i, j, c in links if labels[i] != labels[j])


def test_cut_is_minimal():
    rng = np.random.default_rng(0)
    for _ in range(200):
        n = int(rng.integers(1, 9))
        source, sink = rng.random(n).tolist(), rng.random(n).tolist()
        links = [(i, j, float(rng.random())) for i in range(n) for j in range(i) if rng.random() < 0.5]
        got = cut_value(source, sink, links, h.minimum_cut(source, sink, links))
        assert abs(got - min(cut_value(source, sink, links, x) for x in product((True, False), repeat=n))) < 1e-6


def test_long_pages_end():
    page = "<body>" + "".join(f"<p>{P} {i}</p><p><a href=x>go</a></p>" for i in range(3000)) + "</body>"
    assert h.main_text(page).count(P) == 3000
    assert h.main_text("<div>" * 20_000 + P) == P
    assert h.main_text("<p " + "a='" * 20_000) == ""


PAGES = [
    (f"<html><head><title>T</title></head><body><header><a href=/>Site</a></header><nav><ul><li><a href=a>A</a></li></ul></nav>"
     f"<main><article><h1>Head &amp; tail</h1><p>{P}</p><p>Short.</p><ul><li>one</li><li>two</li></ul></article></main>"
     f"<aside><p>{P}</p></aside><section id=comments><article class=comment><p>{P}</p></article></section>"
     f"<footer>&copy; 2020 Site</footer></body></html>", ["Head & tail", P, "Short.", "one", "two"]),
    (f"<body><div class='nav-bar'><a href=a>Home</a> <a href=b>News</a></div><div id=content><h2>Title here</h2><p>{P}</p>"
     f"<div class='ad'>{P}</div><p>Then<br>more &nbsp; text.</p><form><p>Your mail <input></p></form><p>{P}</p></div>"
     f"<div class='cookie-notice'>We use cookies.</div><div class=sidebar><p>{P}</p></div>", ["Title here", P, "Then more text.", P]),
    (f"<article><p>One {P}<p>Two <b>bold<script>var x = '<p>no</p>';</script><style>p{{}}</style><!-- <p>no</p> --></article>",
     [f"One {P}", "Two bold"]),
    (f"<div class='comments-wrapper with-sidebar'></div><p>{P}</p><p>{P}</p>", [P, P]),
    (f"<article><p>{P}</p><p>cut off &lt;here&gt; &am", [P, "cut off <here> &am"]),
    (f"<article><p>{P}</p><p>cut <a hre", [P, "cut"]),
    (f"<article><p>a < b and c > d.</p><p title='x > y'>{P}</p></article>", ["a < b and c > d.", P]),
    ("", []), (None, []), ("plain words", ["plain words"]), ("   ", []), ("<p></p><br>", []),
    ("<nav><a href=x>only a menu</a></nav>", []),
]


@pytest.mark.parametrize("page, want", PAGES[:9] + PAGES[11:])
def test_pages(page, want):
    assert h.main_text(page) == "\n\n".join(want)


def brute(page):
    """The article of the given pages' layout, by cutting it out."""
    inner = page.split("<article>", 1)[1].split("</article>", 1)[0] if "<article>" in page else ""
    parts = re.split(r"</?(?:p|h1)>", inner)
    plain = (" ".join(html.unescape(re.sub(r"<[^>]*(>|$)", "", part.replace("<br>", " "))).split()) for part in parts)
    return "\n\n".join(p for p in plain if p)


def test_given_pages(spark):
    pages = spark.read.parquet(f"{SF}/pages.parquet")
    want = {r.page_id: (r.url, brute(r.html)) for r in pages.collect()}
    got = h.extract(pages).collect()
    assert {r.page_id: (r.url, r.text) for r in got} == want and len(got) == len(want)
    assert all(r.n_chars == len(r.text) for r in got)


def test_odd_rows(spark):
    rows = [(1, None, None, "x"), (None, "u", "<p>Hello there, this is a text of some length.</p>", "x"), (2, "v", "", None), (2, "v", "", None)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string, text string")
    got = h.extract(pages).collect()
    assert sorted((str(r.page_id), r.n_chars) for r in got) == [("1", 0), ("2", 0), ("2", 0), ("None", len("Hello there, this is a text of some length."))]
    assert h.extract(pages.limit(0)).count() == 0


WRAPPERS = [
    "main class='main-content no-sidebar'", "article class='post has-sidebar'", "main class=sidebar", "article class=related",
    "article class='post has-comments'", "div class='content-area has-sidebar'", "div class='page-content two-columns right-rail'",
    "div class='post-entry with-toc'", "div class='story-body naval'", "div class='sidebar-layout'", "div id=overlay",
    "div class='widget content'",
]


@pytest.mark.parametrize("wrapper", WRAPPERS)
def test_a_name_does_not_decide_for_the_page(wrapper):
    box = f"<div class=sidebar><p>{P}</p></div>"
    page = (f"<body>{box}<{wrapper}><h2>Title here</h2><p>{P}</p><p>Then more.</p><p>{P}</p><div class=ad>{P}</div><p>{P}</p>"
            f"</{wrapper.split()[0]}>{box}<div class='ad text-center'><p>{P}</p></div><div class='post-nav'><p>{P}</p></div>")
    assert h.main_text(page) == "\n\n".join(["Title here", P, "Then more.", P, P])


def test_many_open_boxes_end():
    assert h.main_text(f"<article><p>{P}</p></article>" + f"<div class=ad>{P}" * 5) == P
    assert P in h.main_text(f"<div class=ad><p>{P}</p>" * 5000)


TITLED = ["Title here", P, "Then more.", P]
TEXT = f"<h2>Title here</h2><p>{P}</p><p>Then more.</p><p>{P}</p>"
CONTROL = "<label>Your mail <input></label><select><option>one</select><button>Send it</button>"
FORM_PAGES = [
    f"<body><form id=aspnetForm><nav><a href=x>Home</a></nav>{TEXT}{CONTROL}<div class=sidebar><p>{P}</p></div></form>",
    f"<body><form id=form1 class=form><fieldset><div><main>{TEXT}</main>{CONTROL}</div></fieldset></form>",
    f"<form><article>{TEXT}{CONTROL}</article></form><form><p>Your mail <input></p></form>",
    f"<form>{TEXT}<form class=search><p>Search this site</p></form></form>",
    f"<dialog open><article>{TEXT}</article></dialog><dialog><p>{P}</p></dialog>",
    f"<div id=content>{TEXT}</div><form><p>Your mail <input></p><p>Your name <input></p></form>",
    f"<div id=content>{TEXT}</div><div class=sidebar><form><p>{P}</p></form></div><form class=newsletter><p>{P}</p></form>",
]
HEAD_PAGES = [
    f"<html><head><title>T</title><meta charset=x><style>p{{}}</style><h2>Title here</h2><p>{P}</p><p>Then more.</p><p>{P}</p>",
    f"<head><link rel=x> <script>var a = '<p>no</p>';</script>\n<div>{TEXT}</div></head>",
    f"<head><title>T</title><head><article>{TEXT}</article>",
    f"<head><meta charset=x><noscript>no</noscript><br>{TEXT}",
    f"<head><title>T</title></head>{TEXT}",
]


@pytest.mark.parametrize("page", FORM_PAGES + HEAD_PAGES)
def test_forms_and_open_heads_hold_text(page):
    assert h.main_text(page) == "\n\n".join(TITLED)


def test_text_ends_an_open_head():
    assert h.main_text(f"<head><title>T</title> {P}<p>{P}") == f"{P}\n\n{P}"
    long = f"{P} {P} {P}"
    assert h.main_text(f"<div id=content><p>{P}</p></div><form><p>{long}</p>{CONTROL}</form>") == f"{P}\n\n{long}"


@pytest.mark.parametrize(
    "page",
    [
        "<b>" * 200_000 + "</i>" * 200_000,
        "<a'" * 200_000,
        "<a \"'>" * 200_001,
        "<a href='" + '<b>"x' * 100_000,
        "<p><div>" + "<b>" * 100_000 + "<li>" * 100_000,
        "<div>" * 100_000 + "text" + "</div>" * 100_000,
    ],
)
def test_one_hostile_page_takes_linear_time(page):
    began = time.time()
    h.main_text(page)
    assert time.time() - began < 20
