"""Main text against the pages' own markup, against layouts that the tree wasn't grown on, and broken markup."""

import re
from html import unescape

import numpy as np
import pytest
from pyspark.sql import functions as F

pytest.importorskip("tracklens.llm")
from tracklens.llm import html, queries, training  # noqa: E402

DATA = "/root/testdata/sf0.001"


def text_of(page):
    return "\n\n".join(html.kept_blocks(page, html.standard())[0])


def test_given_pages_give_their_articles(spark):
    """In the given tables an article's markup is plain: its blocks can be read off by a pattern."""
    pages = {r.page_id: r for r in spark.read.parquet(f"{DATA}/pages.parquet").collect()}
    got = queries.op11_main_text(spark, DATA).collect()
    assert sorted(r.page_id for r in got) == sorted(pages)
    for r in got:
        article = re.search(r"<article>(.*?)</article>", pages[r.page_id].html, re.S)[1].replace("<br>", " ")
        blocks = [" ".join(unescape(re.sub(r"<[^>]*>", "", b)).split()) for b in re.split(r"</?(?:p|h1)>", article)]
        assert r.text == "\n\n".join(b for b in blocks if b)
        assert r.url == pages[r.page_id].url and r.n_chars == len(r.text)


LONG = "A rather long sentence that goes on about one thing and then about another thing, so that it has some words."
PAGES = [
    # (page, text)
    (f"<html><head><title>T</title></head><body><div id='top' class='site-header'><h1>Site</h1><p>{LONG}</p></div><div class='post'><h2>Title here</h2><p>{LONG}</p><div class='ad-slot'>Buy now. {LONG}</div><p>No.</p></div><div class='comments-area'><p>{LONG}</p></div></body></html>", ["Title here", LONG, "No."]),
    (f"<body><header><p>{LONG}</p></header><main><article><header><h1>Head</h1></header><p>{LONG}</p><aside><p>{LONG}</p></aside><footer>Tags: x</footer></article><section id=comments><article><p>{LONG}</p></article></section></main><footer><p>{LONG}</p></footer>", ["Head", LONG]),
    (f"<body><div role=dialog><p>We use cookies. {LONG}</p></div><article><p>One <b>bold</b> and <a href=x>a link</a> here.<form><p>{LONG}</p><input></form><p>Last.</article>", ["One bold and a link here.", "Last."]),
    (f"<div class='wrap'><p>{LONG}</p><p>{LONG}</p><p>So it is.</p><p>{LONG}</p></div><ul><li><a href=1>One two</a><li><a href=2>Three</a></ul>", [LONG, LONG, "So it is.", LONG]),
    (f"<body class='has-comments comments-open'><section class='entry-content'><h1>Head</h1><p>{LONG}</p></section><ol class=commentlist><li>{LONG}</ol>", ["Head", LONG]),
    (f"<h1>One head of a page</h1><p>{LONG}</p><div id=comments>" + f"<p>{LONG}</p>" * 4 + "</div>", ["One head of a page", LONG]),
    ("<nav><a href=/>x</a></nav><footer>(c) 2020</footer>", []),
    ("", []),
]


def test_layouts_that_were_not_learnt():
    for page, blocks in PAGES:
        assert text_of(page) == "\n\n".join(blocks), page


def test_held_out_layouts(monkeypatch):
    """Labelled pages from another seed, with the pieces in other company: nearly all blocks as labelled."""
    tree = html.standard()
    monkeypatch.setattr(training, "SEED", 12)
    right = n = 0
    for page in training.pages():
        found = html.text_blocks(page.replace(html.KEEP, html.MARK))
        label = np.array([html.MARK in b.text for b in found])
        for b in found:
            b.text = b.text.replace(html.MARK, "").strip()
            b.words = len(b.text.split())
        right += int(((tree.judge(html.features(found)) >= 0.5) == label).sum())
        n += len(found)
    assert right / n > 0.98


def test_broken_markup():
    a = "<article>"
    for page, text in [
        (a + "<p>1 < 2 && 3 > 2 &amp &lt;b&gt; &eacute; &#233; &#xe9;</p>", "1 < 2 && 3 > 2 & <b> é é é"),
        (a + "<p>x<script>var t='</p>';</script>y<style>p{}</style>z</p>", "x\n\ny\n\nz"),
        (a + "<p>x<!-- <p>no</p> -->y<!-->z</p>", "xyz"),
        (a + "<p>kept</p><!-- open <p>gone</p>", "kept"),
        (a + "<p>kept</p><script>open <p>gone</p>", "kept"),
        (a + "<p>kept</p><a href='cut", "kept"),
        (a + "<p title='a > b' data-x=\"</p>\">in</p >out</ p>", "in\n\nout"),
        (a + "<p>don't <i title=it's>stop</i> now</p>", "don't stop now"),
        (a + "<p> two \n\t words  &nbsp; here<br>next<p>new", "two words here next\n\nnew"),
        (a + "<P>upper</P><LI>item<LI>other", "upper\n\nitem\n\nother"),
        (a + "<p>a<b>b<p>c</b>d</p>e", "ab\n\ncd\n\ne"),
        (a + "<table><tr><td>1<td>2<tr><td>3</table>", "1\n\n2\n\n3"),
        (a + "\x00<p>nul \x00 char &#0;</p>", "\x00\n\nnul \x00 char �"),
        (a + "<p>" + "w " * 100_000 + "</p>", ("w " * 100_000).strip()),
    ]:
        assert text_of(page) == text, page[:80]
    for odd in ("<" * 50_000, "<a " * 20_000, "<a b='" * 20_000, "<b>" * 30_000 + "x", "</p>" * 20_000, "<!--" * 20_000, "&" * 50_000, "<div>" * 5_000 + "deep"):
        html.kept_blocks(odd, html.standard())


def test_tree_is_gini(monkeypatch):
    """The first split against one found by trying every cut of every feature."""
    rng = np.random.default_rng(2)
    x, y = rng.integers(0, 6, (60, 4)).astype(float), rng.integers(0, 2, 60).astype(float)
    tree = html.Tree()
    tree.grow(x, y, 1, 3)
    impurity = lambda v: v.mean() * (1 - v.mean()) * len(v)
    tried = [(impurity(y[x[:, f] <= c]) + impurity(y[x[:, f] > c]), f, c) for f in range(4) for c in np.unique(x[:, f])[:-1] + 0.5 if min((x[:, f] <= c).sum(), (x[:, f] > c).sum()) >= 3]
    best = min(t[0] for t in tried)
    f, c = tree.feature[0], tree.cut[0]
    assert impurity(y[x[:, f] <= c]) + impurity(y[x[:, f] > c]) == pytest.approx(best)
    judged = tree.judge(x)
    for f_, low in ((True, x[:, f] <= c), (False, x[:, f] > c)):
        assert judged[low] == pytest.approx(y[low].mean())


def test_odd_rows(spark):
    rows = [(1, None, "n", 1), (2, "", "n", 2), (None, PAGES[0][0], "n", 3), (3, PAGES[0][0], None, 4), (3, PAGES[0][0], None, 4)]
    df = spark.createDataFrame(rows, "page_id bigint, html string, main_text string, blocks int")
    got = html.extract(df).orderBy(F.col("blocks")).collect()
    text = "\n\n".join(PAGES[0][1])
    assert [(r.page_id, r.main_text, r.blocks) for r in got] == [(1, "", 1), (2, "", 2), (None, text, 3), (3, text, 4), (3, text, 4)]
    assert html.extract(spark.createDataFrame([], df.schema)).count() == 0
