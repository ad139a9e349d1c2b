"""Page extraction: pages written and labelled by hand, pages of the test tables, odd and very long pages."""

import re
import time
from html import unescape

import pytest

from tessera.llm import html
from tessera.llm.common import load

# What a reader would call the article of each page, block by block; none of them comes from the training pages' generator.
BY_HAND = [
    (
        """<!doctype html><html><head><meta charset=utf-8><title>Bread at home - The Oven Post</title><link rel=stylesheet href=a.css></head>
<body class="post-template"><div id="page"><header class="site-header"><div class="logo"><a href="/">The Oven Post</a></div>
<nav class="main-navigation"><ul><li><a href="/r">Recipes</a></li><li><a href="/t">Tools</a></li><li><a href="/about">About us</a></li></ul></nav></header>
<main><article class="post"><h1>Bread at home</h1>
<p>Baking bread needs little more than flour, water, salt and time. Most beginners use too much yeast and too little patience.</p>
<h2>What you need</h2><ul><li>500 g of strong flour</li><li>350 g of water</li><li>10 g of salt</li></ul>
<p>Mix everything, cover the bowl and leave it overnight. In the morning fold the dough twice &amp; let it rest for an hour.</p></article></main>
<aside class="sidebar"><h3>Popular posts</h3><ul><li><a href="/1">Ten pans</a></li><li><a href="/2">Salt, explained</a></li></ul></aside>
<footer class="site-footer"><p>&copy; 2021 The Oven Post. All rights reserved.</p></footer></div><script>ga('send')</script></body></html>""",
        ["Bread at home", "Baking bread needs little more than flour, water, salt and time. Most beginners use too much yeast and too little patience.", "What you need", "500 g of strong flour", "350 g of water", "10 g of salt", "Mix everything, cover the bowl and leave it overnight. In the morning fold the dough twice & let it rest for an hour."],
    ),
    (
        """<html><body><div class="cookie-consent"><p>We use cookies to improve your visit. By going on you agree to our policy.</p><button>Accept</button></div>
<div id="nav"><a href="/">Home</a> | <a href="/news">News</a> | <a href="/sport">Sport</a></div>
<div class="content"><h1>River floods three villages</h1><p>The river rose by two metres in one night, the mayor said on Monday. Nobody was hurt.
<p>Volunteers filled sandbags until the morning. "We have never seen anything like it," said one of them, who has lived there for sixty years.
<div class="ad">Buy two tyres and get one free. Only this week.</div>
<p>The water is expected to fall from Wednesday.</div>
<div class="comments"><h3>2 comments</h3><div class="comment"><b>ann</b><p>Stay safe, everybody. We are thinking of you.</p></div><div class="comment"><b>bob</b><p>Why was the dam not opened earlier?</p></div></div>
<div class="footer">Contact | Imprint | Privacy</div></body></html>""",
        ["River floods three villages", "The river rose by two metres in one night, the mayor said on Monday. Nobody was hurt.", 'Volunteers filled sandbags until the morning. "We have never seen anything like it," said one of them, who has lived there for sixty years.', "The water is expected to fall from Wednesday."],
    ),
    (
        """<HTML><HEAD><TITLE>Notes on lenses</TITLE></HEAD><BODY BGCOLOR=white><FORM ID="aspnetForm" ACTION="page.aspx" METHOD=post><INPUT TYPE=hidden NAME=__VIEWSTATE VALUE="x">
<DIV ID="header"><A HREF="/">Optics club</A></DIV><UL CLASS="menu"><LI><A HREF=a>Start</A><LI><A HREF=b>Members</A><LI><A HREF=c>Meetings</A></UL>
<DIV CLASS="article-body"><H1>Notes on lenses</H1><P>A lens bends light because light is slower in glass than in air. The thicker the glass, the longer the way.</P>
<P>Two lenses in a row make a telescope, as spectacle makers found out long ago.</P></DIV><DIV ID="footer">Optics club, founded 1974</DIV></FORM></BODY></HTML>""",
        ["Notes on lenses", "A lens bends light because light is slower in glass than in air. The thicker the glass, the longer the way.", "Two lenses in a row make a telescope, as spectacle makers found out long ago."],
    ),
    (
        """<body><nav role="navigation"><a href="/docs">Docs</a><a href="/blog">Blog</a></nav><section class="article-body"><h1>Sorting by merging</h1>
<p>Merge sort cuts the list in two, sorts both halves and merges them.</p><pre>def sort(x):
    return merge(sort(left), sort(right))</pre><blockquote><p>It is the oldest of the fast methods.</p></blockquote>
<table><tr><th>Case</th><th>Steps</th></tr><tr><td>best</td><td>n log n</td></tr></table></section>
<div class="newsletter"><p>Get our letter every Friday.</p><form><input name=mail><button>Subscribe</button></form></div>
<div class="share"><a href=x>Share</a> <a href=y>Print</a></div><footer><ul><li><a href="/imprint">Imprint</a></li></ul></footer></body>""",
        ["Sorting by merging", "Merge sort cuts the list in two, sorts both halves and merges them.", "def sort(x): return merge(sort(left), sort(right))", "It is the oldest of the fast methods.", "Case", "Steps", "best", "n log n"],
    ),
    (
        """<html><body><div class="banner">Autumn sale: all coats half price</div><article><header><h1>Un jardin en ville</h1></header>
<p>Il suffit d&#39;un balcon et de quelques pots. Les tomates aiment le soleil, la menthe pr&eacute;f&egrave;re l&rsquo;ombre.</p><p>Arrosez le soir.</p>
<figure><img src=a.jpg><figcaption>Un balcon au mois de mai</figcaption></figure></article><ol class="comment-list"><li><b>Luc</b><p>Merci pour ces conseils, j&#8217;ai commenc&#xE9; hier.</p></li></ol></body></html>""",
        ["Un jardin en ville", "Il suffit d'un balcon et de quelques pots. Les tomates aiment le soleil, la menthe préfère l’ombre.", "Arrosez le soir.", "Un balcon au mois de mai"],
    ),
    (
        """<div class="menu"><ul><li><a href=1>One</a><li><a href=2>Two</a></ul></div><div id="content"><div class="post"><h2>A short note</h2>Plain text without a paragraph, then <b>bold</b> text<br>and a new line.<p>The end.</p></div></div><div class="related"><h4>See also</h4><ul><li><a href=3>Another note</a></ul></div>""",
        ["A short note", "Plain text without a paragraph, then bold text and a new line.", "The end."],
    ),
]


def test_pages_labelled_by_hand():
    chain = html.model()
    wrong = total = 0
    for page, want in BY_HAND:
        got = html.main_text(page, chain).split("\n\n")
        every = [b.text for b in html.leaf_blocks(page)]
        assert set(want) <= set(every)
        wrong += sum((b in got) != (b in want) for b in every)
        total += len(every)
    assert total >= 60 and wrong <= 0.05 * total, (wrong, total)


def test_pages_of_the_tables(spark):
    """Their articles, cut out by a pattern, whatever the blocks: no character more or less."""
    cut = re.compile(r"<article[^>]*>(.*)</article>", re.S)
    bare = lambda x: "".join(unescape(re.sub(r"<(script|style)[^>]*>.*?</\1>|<!--.*?-->|<[^>]*>", " ", x, flags=re.S)).split())
    pages = {r["page_id"]: r["html"] for r in load(spark, "/root/testdata/sf0.01", "pages").collect()}
    right = sum("".join(r["text"].split()) == bare(cut.search(pages[r["page_id"]])[1]) and r["n_chars"] == len(r["text"]) for r in html.op10(spark, "/root/testdata/sf0.01").collect())
    assert right >= 0.99 * len(pages)


LONG = ["<div>x", "<a ", '<a "', "<", "</", "<!", "<!-- ", "<!-- a --", "<p>x", "<ul><li>x", "<div class='a b c'>x", "<form>x</form>", "<div><form></form>", "<table><tr><td>x", "&#0000000001", "&#99999999999", "&amp", "<a b='", "<script>", "</div>", "<a      =     ", "x ", "<b><i><a href=x>y"]


@pytest.mark.parametrize("piece", LONG)
def test_a_megabyte_of_anything_takes_seconds(piece):
    chain, page = html.model(), piece * ((1 << 20) // len(piece))
    for own in (page, page + '">'):
        began = time.perf_counter()
        html.main_text(own, chain)
        assert time.perf_counter() - began < 20


def test_scores_are_those_of_the_named_features():
    chain = html.model()
    for page in [p for p, _ in BY_HAND] + html.training_pages(10, seed=3):
        named, scored = html.leaf_blocks(page), html.leaf_blocks(page, chain.weights)
        assert [b.text for b in named] == [b.text for b in scored] and [b.linked for b in named] == [b.linked for b in scored]
        assert [sum(chain.weights.get(f, 0.0) for f in b.features) for b in named] == pytest.approx([b.score for b in scored])


def test_other_columns_and_repeated_rows(spark):
    """Columns named as the query's own, null ids, addresses and pages, rows that repeat; the table may be empty."""
    page = "<article><h1>A b</h1><p>One two three.</p></article><footer>&copy; x</footer>"
    data = [(1, "u", page), (1, "u", page), (None, None, page), (2, "v", None), (3, "w", "")]
    named = spark.createDataFrame([(*r, "x", 7, "y") for r in data], "page_id long, url string, html string, text string, n_chars int, own string")
    plain = spark.createDataFrame(data, "page_id long, url string, html string")
    told = lambda df: sorted(map(repr, html.extracted(df).collect()))
    assert told(named) == told(plain) and len(told(plain)) == len(data)
    got = {(r["page_id"], r["text"], r["n_chars"]) for r in html.extracted(named).collect()}
    assert got == {(1, "A b\n\nOne two three.", 19), (None, "A b\n\nOne two three.", 19), (2, "", 0), (3, "", 0)}
    assert html.extracted(named.limit(0)).columns == html.extracted(plain).columns and html.extracted(named.limit(0)).count() == 0
