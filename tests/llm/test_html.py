"""Main text: shapes that markup gets wrong, endless markup, and what the clusters decide."""

import re
import time

import pandas as pd
import pytest

from tidelog.llm import html_text

LONG = "A sentence of the text that goes on for a good while, as they do. " * 4
PAGES = "/root/testdata/sf0.01/pages.parquet"


def article_of(html):
    """The article by patterns, for the simple pages of the tables."""
    inside = re.search(r"<article[^>]*>(.*?)</article>", html, re.S)[1]
    inside = re.sub(r'<(script|style)\b.*?</\1>|<!--.*?-->|<div class="ad">.*?</div>', "\n", inside, flags=re.S)
    from html import unescape

    return " ".join(unescape(re.sub(r"<[^>]+>", "\n", re.sub("</?b>", "", inside))).split())


def test_tables():
    pages = pd.read_parquet(PAGES)
    for html in pages.html:
        assert html_text.main_text(html) == article_of(html)


def test_without_landmarks(monkeypatch):
    """Elements and names that say what is what taken out: the ratios alone decide, and worse with no cut."""
    pages = pd.read_parquet(PAGES).html.tolist()
    bare = [re.sub(r"<(/?)(article|nav|footer)\b", r"<\1div", h).replace(' class="ad"', "") for h in pages]

    def extra():
        found = [html_text.main_text(h) for h in bare]
        assert all(article_of(h) in f for h, f in zip(pages, found))
        return sum(len(f) - len(article_of(h)) for h, f in zip(pages, found)) / sum(map(len, found))

    chosen = extra()
    monkeypatch.setattr(html_text, "CUT", 0.0)
    assert chosen < 0.02 < extra()


@pytest.mark.parametrize(
    ("page", "want"),
    [
        (f"<article class='post tags'><p>{LONG}</p></article>", LONG),
        (f"<form action='/'><div><p>{LONG}</p><p>End.</p></div></form>", f"{LONG} End."),
        (f"<form><article><p>{LONG}</p></article></form><form>Name</form>", LONG),
        (f"<main><h1>Title</h1><article><p>{LONG}</p></article></main>", f"Title {LONG}"),
        (f"<article><p>{LONG}{LONG}</p></article><article><p>Second. {LONG}</p></article>", f"{LONG}{LONG} Second. {LONG}"),
        (f"<article><h2 class='section header'>Part</h2><p>{LONG}</p></article>", f"Part {LONG}"),
        (f"<article><p>{LONG}</p><p>So.</p><p>It.</p></article>", f"{LONG} So. It."),
        (f"<article><p>{LONG}</p><ul><li>One</li><li>Two</li></ul></article>", f"{LONG} One Two"),
        (f"<head><title>T</title><body><div id=top><a href=/>Home</a></div><div><h1>H</h1><p>{LONG}<p>Short.</div><div><a>x</a></div>", f"H {LONG} Short."),
        (f"<!-- open <article><p>{LONG}</p></article>", LONG),
        (f"<article><p>{LONG} 1 < 2 &lt;b&gt; <a href='x", f"{LONG} 1 < 2 <b> <a href='x"),
        ("<div class='ad'>Only this.</div>", "Only this."),
        ("<p>a</p><p>b</p>", "a b"),
    ],
)
def test_shapes(page, want):
    assert html_text.main_text(page) == " ".join(want.split())


@pytest.mark.parametrize("junk", ["<div>", "x</b>", "<a x=", "<a x='", "<!--", "<![x", "<p", "</p", "<?", '<div class="ad">x', "<article>x</article>", "<td>"])
def test_time_is_linear(junk):
    began = time.process_time()
    html_text.main_text("<div>" * 20_000 + junk * 40_000)
    assert time.process_time() - began < 12


def test_odd_rows(spark):
    schema = "html string, page_id long, text string, url string, n_chars string, tags int"
    rows = [("<p>x</p>", 1, "t", "u", "n", 1), (None, None, None, None, None, None), ("", 2, "t", "u", "n", 1), ("<p>x</p>", 1, "t", "u", "n", 1)]
    df = spark.createDataFrame(rows, schema)
    got = html_text.extract(df)
    assert got.columns == ["page_id", "url", "text", "n_chars"]
    assert sorted((r.page_id or 0, r.url or "", r.text, r.n_chars) for r in got.collect()) == [(0, "", "", 0), (1, "u", "x", 1), (1, "u", "x", 1), (2, "u", "", 0)]
    assert html_text.extract(df.limit(0)).count() == 0
