from __future__ import annotations

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from galena.llm import html_text as H
from galena.llm import queries

PAGE = """<!DOCTYPE html><html><head><title>T</title><style>p{}</style><script>var t="</p>";</script></head><body>
<nav><ul><li><a href="/a">Home</a></li><li><a href="/b">News</a></li></ul></nav><!-- ad 1 --><div class="ad">Buy now.</div>
<article><h1>A title &amp; more</h1><p><b>First &lt;b&gt; paragraph
  of   words.<br><p>Second&nbsp;one &#233;&#x41;.</p><ul><li>one item here<li>two items here</ul></article>
<section id="comments"><div class="comment"><p>Great post</p></div></section><footer>&copy; site &middot; words of the foot.</footer></body></html>"""


def test_a_page(spark):
    text = spark.createDataFrame([(PAGE,)], "html string").select(H.extract(F.col("html"), spark).alias("t")).first().t
    assert text == "A title & more\n\nFirst <b> paragraph of words.\n\nSecond one éA.\n\none item here\n\ntwo items here"


def test_blocks_of_broken_markup():
    texts = lambda p: [b[1] for b in H.blocks(p)]
    assert texts("") == [] and texts("plain") == ["plain"] and texts("<p>a<p>b</div>c") == ["a", "b", "c"] or texts("<p>a<p>b</div>c") == ["a", "bc"]
    assert texts("<div>x<!-- never closed") == ["x"]
    assert texts("<p>1 < 2 & 3 > 2</p>") == ["1 < 2 & 3 > 2"]
    assert texts("<script>a<p>b</script><p title='>'>c</p><textarea>d</textarea>") == ["c"]
    assert texts("<p>a<br>b<b>c</b>d<img src=x>e</p>") == ["a bcde"]
    assert texts("<![CDATA[x < y]]>") == ["x < y"]
    assert texts("<div>" * 3000 + "deep" + "</div>" * 3000) == ["deep"]


@pytest.mark.parametrize(("named", "least"), [(1.0, 0.99), (0.0, 0.95)])
def test_held_out_composed_pages(named, least):
    """Pages with telling names, and pages whose names (random words) no training page has."""
    w, rng = H.train(), random.Random(4711)
    right = total = 0
    for _ in range(150):
        page, labels = H.sample_page(rng, named)
        own = H.blocks(page)
        assert len(own) == len(labels)
        right += int((H.label([own], w)[0] == np.array(labels, bool)).sum())
        total += len(labels)
    assert total > 1000 and right / total >= least


def test_pages_of_other_templates(spark):
    story = ["A title of some words", "The first paragraph of the text says what happened, and to whom.", "The second one goes on, with a link and more words than before.", "So it ends."]
    inner = f"<h1>{story[0]}</h1><div class='mw-parser-output'>" + "".join(f"<p>{x}</p>" for x in story[1:]) + "</div>"
    menu = "<ul>" + "".join(f"<li><a href='/{x}'>{x}</a></li>" for x in ("Start", "World", "Money")) + "</ul>"
    pages = [
        f"<html><body>{menu}<div id='bodyContent'>{inner}</div></body></html>",
        f"<html><body><div class='q7z'>{menu}</div><div class='zzkk'><div>{inner}</div></div><div>&copy; 2023 Some Company</div></body></html>",
        f"<body><div id='tnav_1'>{menu}</div><center><div class='gfx'>{inner}</div></center><div class='bt'>{menu}</div></body>",
    ]
    got = [r.t for r in spark.createDataFrame([(i, p) for i, p in enumerate(pages)], "i int, html string").orderBy("i").select(H.extract(F.col("html"), spark).alias("t")).collect()]
    assert got == ["\n\n".join(story)] * 3


def test_shown_text_within_blocks_stays():
    texts = lambda p: [b.text for b in H.blocks(p)]
    assert texts("<p>The area is <math><mi>x</mi><mo>=</mo><mn>2</mn></math> times pi.</p>") == ["The area is x=2 times pi."]
    assert texts("<p>a <object>b</object></p><noscript>c</noscript><svg><text>d</text></svg>") == ["a", "b", "c", "d"]
    assert texts("<p>a<select><option>b</select></p><select><option>b<p>c</select>d") == ["a", "d"]
    assert texts("<p>a<i>b<b>c</i>d</b>e</p>") == ["abcde"] and texts("<a 'x>y</a> z") == ["y z"]


@pytest.mark.parametrize("unit", ["<div>x", "<b>x", "</i>", "<a \"", "<blockquote>x<hr>", "<i><b></i>", "<li>x", "<x><dd>y"])
def test_hostile_markup_takes_linear_time(unit):
    import time

    def seconds(n):
        t = time.process_time()
        H.blocks(unit * n)
        return time.process_time() - t

    seconds(1000)
    assert seconds(100_000) < 30 * seconds(10_000) + 2


def test_a_page_of_very_many_blocks():
    w = H.train()
    page = "<nav><a href='/'>Home</a></nav><article>" + "<p>words of a long page here.</p>" * 20_000 + "</article><footer>&copy; x</footer>"
    own = H.blocks(page)
    got = H.label([own], w)[0]
    assert len(own) > H.PIECE and got.sum() == 20_000 and not got[0] and not got[-1]
    short = own[:300]
    x = H.vectors(short)[:, None, :]
    assert np.allclose(H._long(short, w), H.forward(x, np.ones((300, 1), np.float32), w)[:, 0], atol=1e-3)


def test_gradients_equal_differences():
    rng = np.random.default_rng(0)
    w = {"wo": rng.normal(0, 0.3, (2 * H.HIDDEN + H.WIDTH, 1)), "bo": np.zeros(1)}
    for s in "fb":
        w |= {"wx" + s: rng.normal(0, 0.2, (H.WIDTH, 4 * H.HIDDEN)), "wh" + s: rng.normal(0, 0.2, (H.HIDDEN, 4 * H.HIDDEN)), "b" + s: np.zeros(4 * H.HIDDEN)}
    x, mask = rng.normal(size=(4, 2, H.WIDTH)), np.array([[1, 1], [1, 1], [1, 1], [1, 0]], float)
    y = rng.integers(0, 2, (4, 2)).astype(float)

    def loss():
        z = H.forward(x, mask, w)
        return float(((np.logaddexp(0, z) - y * z) * mask).sum() / mask.sum())

    g = H._gradients(x, mask, y, w)
    for name in w:
        at = tuple(int(rng.integers(n)) for n in w[name].shape)
        keep, eps = w[name][at], 1e-3
        w[name][at] = keep + eps
        up = loss()
        w[name][at] = keep - eps
        assert abs((up - loss()) / (2 * eps) - g[name][at]) < 1e-3
        w[name][at] = keep


def test_query_takes_every_article_and_nothing_else(spark, small):
    import re
    from html import unescape

    got = {r.page_id: r for r in queries.op5_html_text(spark, small).collect()}
    pages = spark.read.parquet(f"{small}/pages.parquet").collect()
    assert len(got) == len(pages)
    for p in pages:
        inner = re.search(r"<article>(.*)</article>", p.html, re.S)[1]
        parts = [re.sub(r"\s+", " ", unescape(re.sub(r"<br>", " ", x).replace("<b>", "").replace("</b>", ""))).strip() for x in re.split(r"</?(?:p|h1)>", inner)]
        want = "\n\n".join(x for x in parts if x)
        assert got[p.page_id].text == want and got[p.page_id].n_chars == len(want)


def test_awkward_rows(spark):
    rows = [(1, None), (2, ""), (3, " \n"), (4, "<article>" + "<p>words of a long page here.</p>" * 5000 + "</article>"), (None, "<nav>x</nav>"), (4, "<!-- -->")]
    d = spark.createDataFrame(rows, "page_id long, html string").withColumns({"text": F.lit(1), "n_chars": F.lit("x"), "more": F.lit(2)})
    out = H.extract_pages(d)
    assert set(out.columns) == set(d.columns)
    got = {(r.page_id, r.html): r for r in out.collect()}
    assert got[1, None].text == "" == got[2, ""].text and got[1, None].n_chars == 0
    assert got[rows[3]].text.count("\n\n") == 4999
    assert H.extract_pages(d.limit(0)).count() == 0
