"""Main texts of hand-made pages, of generated pages with known articles, and of the table's pages against a plain pattern."""

import html
import random
import re

import pytest

from panelgrid.llm.maintext import extract, main_texts

LONG = "This sentence is long enough, has commas, and says something about the subject of the page."

PAGES = {
    "plain text": ("just text &amp; more", "just text & more"),
    "empty": ("", ""),
    "only a menu": ("<nav><a href=/>Home</a></nav>", ""),
    "unclosed": (f"<body><article><h1>Head</h1><p>{LONG}<br>again<p><b>Two</article><footer>foot</footer>", f"Head\n{LONG} again\nTwo"),
    "script with tags": (f"<script>var t='</p><p>no';</script><article><p>{LONG}</p></article><style>p{{}}</style>", LONG),
    "open comment": (f"<article><p>{LONG}</p><!-- never closed <p>no</p></article>", LONG),
    "open script": (f"<article><p>{LONG}</p></article><script>if (a < b) {{", LONG),
    "references": ("<article><p>&lt;b&gt; &eacute;&#233;&#xe9; &nbsp;&amp;amp; &copy</p></article>", "<b> ééé &amp; ©"),
    "no article element": (f"<div id=top class='site-menu'><ul><li><a>One</a><li><a>Two</a></ul></div><div><p>{LONG}</p><p>{LONG}</p><p>Short.</p></div><div>About us</div>", f"{LONG}\n{LONG}\nShort."),
    "sections are siblings": (f"<body><div><p>{LONG}</p><p>{LONG}</p></div><div><p>{LONG}</p></div><div><a href=/a>{LONG}</a></div>", "\n".join([LONG] * 3)),
    "comments and forms": (f"<main><p>{LONG}</p><form><p>Your mail, please</p><input></form></main><section class=comments><article class=comment><p>{LONG}</p></article></section>", LONG),
    "notices by class": (f"<div class=cookieBanner><p>{LONG}</p></div><div role=banner>{LONG}</div><article><p>Short.</p></article><div hidden><p>{LONG}</p></div><p style='display: none'>{LONG}</p>", "Short."),
    "menu list inside": ("<article><p>Text.</p><ul><li><a href=1>One</a><li><a href=2>Two</a><li><a href=3>Three</a></ul><ul><li>First, item<li>Second <a href=4>link</a></ul></article>", "Text.\nFirst, item\nSecond link"),
    "own header": (f"<header><h1>Site</h1></header><article><header><h1>Title</h1></header><p>{LONG}</p><footer>tags</footer></article>", f"Title\n{LONG}"),
    "class around the article": (f"<div class='with-sidebar page-header'><article><p>{LONG}</p></article><div class=sidebar><p>{LONG}</p></div></div>", LONG),
    "table layout": (f"<table><tr><td><a href=1>a</a><td><p>{LONG}<p>{LONG}</table>", f"{LONG}\n{LONG}"),
    "whole page in a form": (f"<form><div><p>{LONG}</p><p>{LONG}</p></div></form>", f"{LONG}\n{LONG}"),
    "odd attributes": (f"<article data-x=\"a>b\" title='c>d'><p class=>{LONG}</p ><p a=\"open>{LONG}</p></article>", f"{LONG}\n{LONG}"),
}


@pytest.mark.parametrize("name", PAGES)
def test_page(name):
    page, want = PAGES[name]
    assert extract(page) == want


def test_null_and_very_long_pages():
    assert extract(None) == ""
    assert extract("<div>" * 50_000 + "<p>deep</p>") == "deep"
    many = "\n".join(f"Paragraph {i}, with words." for i in range(20_000))
    assert extract("<article>" + "".join(f"<p>{p}" for p in many.split("\n")) + "</article>") == many
    word = "long, text " * 200_000
    assert extract(f"<body><p>{word}</p>") == word.strip()
    assert extract("<p><b><i>" * 20_000 + "end") == "end"
    assert extract("<" * 100_000) == "<" * 100_000 and extract("<a " * 50_000) == ""


def generated(seed):
    pick = random.Random(seed)

    def sentence(least=4):
        return " ".join(pick.choice(["word", "über", "x<y", "R&D", "tail,", "“quoted”", "end"]) for _ in range(pick.randint(least, 30))) + "."

    body = [sentence() for _ in range(pick.randint(1, 8))]
    tag = pick.choice([("article", ""), ("main", " id=content"), ("div", " class=post")])
    inner = "".join(pick.choice(["<p>{}</p>", "<p>{}", "<p>\n  {}\n</p><!-- c -->"]).format(html.escape(p)) for p in body)
    other = ["<nav><ul><li><a href=/>Home</a></li></ul></nav>", f"<div class=ad>{html.escape(sentence())}</div>", f"<aside><p>{html.escape(sentence())}</p></aside>", f"<form><label>{sentence()[:9]}</label><input></form>",
             f"<div class='comments'><p>{html.escape(sentence())}</p></div>", f"<footer>&copy; {html.escape(sentence())}</footer>", "<script>document.write('<p>no</p>')</script>", f"<div id=cookie-notice>{html.escape(sentence())}</div>"]
    pick.shuffle(other)
    at = pick.randrange(len(other))
    page = "".join(other[:at]) + f"<{tag[0]}{tag[1]}><h1>A heading</h1>{inner}</{tag[0]}>" + "".join(other[at:])
    return f"<!DOCTYPE html><html><head><title>t</title></head><body>{page}</body></html>", "\n".join(["A heading", *body])


def test_generated_pages():
    for seed in range(400):
        page, want = generated(seed)
        assert extract(page) == want, seed


def test_table(spark):
    pages = spark.read.parquet("/root/testdata/sf0.01/pages.parquet")
    got = {r.page_id: r for r in main_texts(pages).collect()}
    assert len(got) == pages.count()
    for r in pages.collect():
        inner = re.search(r"<article>(.*?)</article>", r.html, re.S)[1]
        parts = (" ".join(html.unescape(re.sub(r"<[^>]*>", "", b)).split()) for b in re.split(r"</?(?:p|h1)>", inner))
        text = "\n".join(p for p in parts if p)
        assert got[r.page_id].text == text and got[r.page_id].url == r.url and got[r.page_id].n_chars == len(text)


def test_odd_rows(spark):
    rows = [(1, "u", None, "x", 1), (None, None, "<p>Ünï</p>", "x", 1), (2, "u", "", None, 1), (2, "u", "", None, 1)]
    frame = spark.createDataFrame(rows, "page_id long, url string, html string, text string, n_chars int")
    got = sorted((r.page_id or 0, r.url, r.text, r.n_chars) for r in main_texts(frame).collect())
    assert got == [(0, None, "Ünï", 3), (1, "u", "", 0), (2, "u", "", 0), (2, "u", "", 0)]
    assert main_texts(frame.limit(0)).count() == 0
