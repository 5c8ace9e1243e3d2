"""Page text: articles inside wrappers with misleading names, unclosed elements, whole rows."""

from __future__ import annotations

import random

import pytest

from riskweave.llm import html_text

RNG = random.Random(1)
PARAGRAPHS = [" ".join(RNG.choice("river stone market evening letter garden".split()) for _ in range(60)) for _ in range(4)]
TEXT = "\n".join(["A title", *PARAGRAPHS])
ARTICLE = "<h1>A title</h1>" + "".join(f"<p>{p}</p>" for p in PARAGRAPHS)
MENU = '<nav><a href="/">Home</a> <a href="/n">News</a></nav>'
END = '<footer><p>All rights reserved by the owners of this page and its parts.</p></footer>'


@pytest.mark.parametrize("body", [
    f'<div class="layout has-sidebar"><main><article>{ARTICLE}</article></main></div>',
    f'<div class="layout has-sidebar"><main><article>{ARTICLE}</article></main><div class="sidebar"><p>{PARAGRAPHS[0]}</p></div></div>',
    f'<div class="post-with-related">{ARTICLE}</div>',
    f'<div id="search-page">{ARTICLE}</div>',
    f'<div class="hentry tags-news">{ARTICLE}</div>',
    f'<article class="hentry tags-news">{ARTICLE}</article>',
    f'<form action="/page" method="post">{ARTICLE}</form>',
    f"<article>{ARTICLE}</article>",
    f'<svg><path d="M0 0"><article>{ARTICLE}</article>',
    f'<svg><path d="M0 0"><article>{ARTICLE}</article><svg><text>icon</text></svg>',
    f'<button class="open"><article>{ARTICLE}</article>',
    f"<select><option>one<article>{ARTICLE}</article>",
    f'<article>{ARTICLE}<div class="ad"><p>{PARAGRAPHS[1]}</p></div></article>',
    f'<article>{ARTICLE}</article><section id="comments"><article><p>{" ".join(PARAGRAPHS * 20)}</p></article></section>',
    f'<article>{ARTICLE}</article><div class="related"><article><p>{PARAGRAPHS[2]}</p></article></div>',
    f'<article>{ARTICLE}</article><form><p>{PARAGRAPHS[3]}</p></form>',
    f'{ARTICLE}<div class="cookie-notice"><p>{PARAGRAPHS[3]}</p></div>',
    f'{ARTICLE}<p>{PARAGRAPHS[0]}<span class="sponsored">Buy this</span></p>',
])
def test_articles_are_kept_and_other_parts_are_not(body):
    want = TEXT + ("\n" + PARAGRAPHS[0] if "Buy this" in body else "")
    for page in (f"<html><head><title>t</title></head><body>{MENU}{body}{END}</body></html>", f"<html><head><title>t</title><body>{MENU}{body}"):
        assert html_text.main_text(page) == want


def test_scripts_take_what_they_hold():
    assert html_text.main_text(f"<article>{ARTICLE}<script>var a = '<p>no text</p>'</script></article>") == TEXT
    assert html_text.main_text(f"<article>{ARTICLE}</article><script>var a = '<p>no text</p>'") == TEXT


def test_many_unclosed_elements_take_linear_time():
    assert html_text.main_text("<svg><p>word</p>" * 50_000 + f"<article>{ARTICLE}</article>") == TEXT


def test_held_counts_the_words_of_nested_parts():
    found = html_text.blocks('<form><p>a b c d</p><div class="ad"><p>e</p></div></form><div class="promo">f <a>g h</a></div>')
    assert [round(b.held, 3) for b in found] == [round(5 / 6, 3), round(1 / 6, 3), round(1 / 6, 3)]


def test_rows_of_any_kind(spark):
    long = "<article>" + "<p>word</p>" * 100_000 + "</article>"
    pages = spark.createDataFrame([(1, "u", long, "t", 7), (1, "u", long, "t", 7), (None, None, None, "t", 7)], "page_id long, url string, html string, text string, n_chars int")
    got = sorted(((r.page_id or 0, r.n_chars) for r in html_text.extract(pages).collect()))
    assert got == [(0, 0), (1, 499_999), (1, 499_999)]
    assert html_text.extract(pages.limit(0)).count() == 0
