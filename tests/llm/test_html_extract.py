"""Main-text extraction: parsing, exact marginals, held-out pages and pages written by hand."""

from __future__ import annotations

import itertools

import numpy as np
import pytest

from deskspark.llm import html_extract
from deskspark.llm.html_extract import Forest, Page


@pytest.fixture(scope="module")
def model():
    return html_extract.learn(html_extract.labelled_pages())


HAND = [
("""<html><body><header class="site-header"><a href="/">The Daily Post</a><p>News since 1900</p></header>
<nav class="menu"><ul><li><a href="/a">World</a></li><li><a href="/b">Sport</a></li></ul></nav>
<div class="cookie-banner"><p>We use cookies to improve your visit. By staying you agree to our policy.</p><button>OK</button></div>
<article><h1>River levels rise</h1><p class="byline">By A. Writer</p><p>The river rose by two metres on Monday, and the lower town was closed to traffic. People moved their cars uphill.</p>
<aside class="related"><h3>Related</h3><ul><li><a href="/x">Older floods</a></li></ul></aside>
<p>Officials said that the <a href="/w">water</a> would fall by Wednesday.</p></article>
<section id="comments"><h3>2 comments</h3><div class="comment"><b>Sam</b><p>I remember the flood of 1970, it was far worse than this one and lasted for weeks.</p></div></section>
<footer><p>&copy; 2024 The Daily Post. All rights reserved.</p></footer></body></html>""",
"River levels rise\nBy A. Writer\nThe river rose by two metres on Monday, and the lower town was closed to traffic. People moved their cars uphill.\nOfficials said that the water would fall by Wednesday."),
("""<body><div id="top"><div id="logo">Bakers Forum</div><form action="/s"><input name=q><input type=submit value=Go></form></div>
<div id="wrap"><div id="left"><ul><li><a href=1>Home<li><a href=2>Breads<li><a href=3>Cakes</ul></div>
<div id="center"><div class="post"><h2>How to keep a starter</h2><div class="entry">Feed it once a day.<br>Use equal weights of flour and water.<p>Keep it warm.<p>Discard half before each feed, or it will grow without end &amp; spill over the jar.</div></div>
<div class="ad"><p>Buy the best mixer now! Only today.</p></div></div>
<div id="right" class="sidebar"><h4>Archive</h4><ul><li><a href=4>May</a><li><a href=5>June</a></ul></div></div>
<div id="footer">Powered by bread. <a href=7>Contact</a></div></body>""",
"How to keep a starter\nFeed it once a day. Use equal weights of flour and water.\nKeep it warm.\nDiscard half before each feed, or it will grow without end & spill over the jar."),
("""<!doctype html><title>x</title><main><h1>Notes on tuning</h1><p>Strings stretch.</p><ul><li>Tune up to the note.</li><li>Never down.</li></ul><blockquote>Patience is all.</blockquote><table><tr><td>E</td><td>329.6</td></tr></table></main><aside><p>Subscribe to our newsletter for weekly tips, offers and news from the workshop.</p></aside><footer>Imprint</footer>""",
"Notes on tuning\nStrings stretch.\nTune up to the note.\nNever down.\nPatience is all.\nE\n329.6"),
("""<html><body><table><tr><td><a href=1>Home</a><br><a href=2>Links</a></td><td><h1>My garden</h1><p>This year I planted beans, peas and two kinds of squash along the fence. The beans did best.</p><p>Next year I will try tomatoes again, because the new wall keeps the wind off.</p></td></tr></table><p><font size=1>Copyright 1999</font></p></body></html>""",
"My garden\nThis year I planted beans, peas and two kinds of squash along the fence. The beans did best.\nNext year I will try tomatoes again, because the new wall keeps the wind off."),
("""<body><div class="x1"><div class="x2"><a href=/>Home</a> <a href=/n>News</a> <a href=/s>Shop</a></div><div class="x3"><h1>Late trains</h1><p>Trains ran late on Friday after a tree fell on the line near the old mill.</p><p>No one was hurt.</p></div><div class="x4"><a href=1>Bus fares up</a><a href=2>Bridge shut</a><a href=3>Park opens</a></div><div class="x5">&copy; Local Paper</div></div>""",
"Late trains\nTrains ran late on Friday after a tree fell on the line near the old mill.\nNo one was hurt."),
]


def texts(source):
    return [t for t in Page(source).texts if t is not None]


def test_parsing():
    assert texts("a &amp; b&nbsp;c<p>d<p>e<b>f<p>g</b>h") == ["a & b c", "d", "ef", "gh"]
    assert texts("<ul><li>a<ul><li>b</ul><li>c</ul>") == ["a", "b", "c"]
    assert texts("x<script>var a = '<p>no</p>'</script><style>p{}</style>y<!-- z --><br>w") == ["x", "y w"]
    assert texts("<div>a</p></span></table>b</div>c") == ["a", "b", "c"]
    assert texts("<table><tr><td>a<td>b<tr><th>c</table>d &lt;e&gt; &#233; &amp") == ["a", "b", "c", "d <e> é &"]
    assert texts("") == [] and texts("<div><p>") == []
    deep = Page("<div>" * 50_000 + "x")
    assert deep.texts[-1] == "x" and len(deep.parent) == 50_002


def test_marginals_are_exact():
    rng = np.random.default_rng(1)
    forest = Forest([Page("<div><p>a</p><ul><li>b<li>c</ul></div>d"), Page("x")])
    own, pair = rng.normal(size=(len(forest.parent), 2)), rng.normal(size=(len(forest.parent), 2, 2))
    one, both = html_extract.marginals(forest, own, pair)
    n = len(forest.parent)
    want, joint, total = np.zeros((n, 2)), np.zeros((n, 2, 2)), 0
    for y in itertools.product((0, 1), repeat=n):
        p = np.exp(sum(own[i, y[i]] + (pair[i, y[u], y[i]] if u >= 0 else 0) for i, u in enumerate(forest.parent)))
        total += p
        for i, u in enumerate(forest.parent):
            want[i, y[i]] += p
            if u >= 0:
                joint[i, y[u], y[i]] += p
    assert np.allclose(one, want / total) and np.allclose(both, joint / total)


def test_held_out_pages(model):
    pages = [Page(s) for s in html_extract.labelled_pages(200, seed=1234)]
    forest = Forest(pages)
    one, _ = html_extract.marginals(forest, *forest.potentials(*model))
    right = (one[:, 1] >= 0.5) == np.array([v for p in pages for v in html_extract.labels(p)])
    text = np.array([t is not None for p in pages for t in p.texts])
    assert right[text].mean() > 0.99
    assert np.mean([right[text & (forest.owner == k)].all() for k in range(len(pages))]) > 0.9


def test_pages_written_by_hand(model):
    got = html_extract.main_texts([h for h, _ in HAND], model)
    assert got == [w for _, w in HAND]


def test_extract(spark, model, monkeypatch):
    monkeypatch.setattr(html_extract, "SOURCE_CHARS", 500)
    long = "<nav><a href=1>menu</a></nav><article>" + "".join(f"<p>This is line {i} of a rather long article.</p>" for i in range(20_000)) + "</article>"
    rows = [(1, HAND[0][0], 7, "old"), (None, None, 8, None), (3, "", 9, None), (3, long, 9, None), (1, HAND[0][0], 7, "old")]
    df = spark.createDataFrame(rows, "page_id long, html string, n_chars int, text string")
    out = html_extract.extract(df.repartition(2), model)
    assert out.columns == ["page_id", "n_chars", "text"]
    got = sorted(map(tuple, out.collect()), key=str)
    whole = "\n".join(f"This is line {i} of a rather long article." for i in range(20_000))
    assert got == sorted([(1, 7, HAND[0][1])] * 2 + [(None, 8, ""), (3, 9, ""), (3, 9, whole)], key=str)
    assert html_extract.extract(df.limit(0), model).count() == 0
    assert html_extract.extract(df.select("html"), model).count() == 5
