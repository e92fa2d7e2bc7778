"""Block reader, conditional random field and the op11 query: held-out pages, awkward rows, likelihood by brute force."""

from __future__ import annotations

import html
import itertools
import re
from pathlib import Path

import numpy as np
import pytest

from orrery.llm import html_extract as H
from orrery.llm.html_blocks import blocks

SF = Path("/root/testdata/sf0.001")
SHAPE = "page_id long, url string, html string, text string, n_chars int, lang string"
PROSE = ["The first thing that was said about it was true, and it stayed so for years.", "Nobody who came here later could tell what had stood on the hill before."]


@pytest.fixture(scope="module")
def model():
    return H.fit_pages(H.dressed_pages([f"<p>{x}</p>" for x in PROSE] + ["<li>About us</li>", "<li>More news</li>"], number=900))


def texts(page):
    return [b.text for b in blocks(page)]


def test_blocks_of_untidy_pages():
    assert texts("<p>a<p>b<br>c<div>d <b>e</b>f</div>g") == ["a", "b c", "d ef", "g"]
    assert texts("<ul><li>one<li>two<ul><li>in</ul></ul>x") == ["one", "two", "in", "x"]
    assert texts("<table><tr><td>a<td>b<tr><td>c</table>") == ["a", "b", "c"]
    assert texts('<script>var t="</p>";</script><style>p{}</style>x<!-- <p>no</p> -->y<noscript>z</noscript>') == ["xy"]
    assert texts("<head><title>t</title><p>no body tag</p>") == ["no body tag"]
    assert texts("a &amp; b &lt;i&gt; &#233;&nbsp;&eacute; &unknown; &amp") == ["a & b <i> é é &unknown; &"]
    assert texts('<p title="a > b">x</p><p title="open>y</p>') == ["x", "y"]
    assert texts("cut <p>off <a href=") == ["cut", "off"]
    assert texts("1 < 2 and </nothing> 3 </p> 4") == ["1 < 2 and 3 4"] or texts("1 < 2 and </nothing> 3 </p> 4") == ["1 < 2 and 3", "4"]
    assert texts("") == [] and texts("<div></div>") == [] and texts("just text") == ["just text"]
    assert [e.tag for e in blocks("<article><p>x</article><footer>y")[1].path] == ["footer"]
    assert blocks('<p>ab <a href="x">cd</a></p>')[0].linked == 2
    assert len(texts("<p>x " * 20_000)) == 20_000 and len(texts('<a "' * 20_000)) <= 1  # linear in the page


def test_decoding_equals_the_best_of_all_labellings(model):
    page = blocks('<nav><a href="/">Home</a></nav><article><h1>Title</h1><p>It was said, and it was so.</p><div class="ad">Buy!</div><p>End of it, here.</p></article><footer>x</footer>')
    scores = model.scores(page)

    def value(y):
        return sum(s for s, k in zip(scores, y, strict=True) if k) + sum(model.step[H.together(page[k - 1], page[k]), y[k - 1], y[k]] for k in range(1, len(y)))

    best = max(itertools.product((0, 1), repeat=len(page)), key=value)
    assert list(map(bool, best)) == model.decode(page) == [False, True, True, False, True, False]


def test_the_fit_is_a_maximum():
    pages = [blocks(p) for p in H.dressed_pages(["<p>Some words that go on for long enough, and end.</p>"], number=12, seed=1)]
    pages = [p[:7] for p in pages]
    labels = [[any(e.main == "1" for e in b.path) for b in p] for p in pages]
    m = H.fit_blocks(pages, labels, rounds=600)

    def loss(m):
        total = -0.25 * ((m.weights**2).sum() + (m.step**2).sum())
        for p, y in zip(pages, labels, strict=True):
            m.paths, m.shapes = {}, {}
            scores = m.scores(p)
            all_ = [sum(s for s, k in zip(scores, z, strict=True) if k) + sum(m.step[H.together(p[k - 1], p[k]), z[k - 1], z[k]] for k in range(1, len(z))) for z in itertools.product((0, 1), repeat=len(p))]
            own = sum(s for s, k in zip(scores, y, strict=True) if k) + sum(m.step[H.together(p[k - 1], p[k]), int(y[k - 1]), int(y[k])] for k in range(1, len(y)))
            total += own - np.logaddexp.reduce(all_)
        return total

    best, rng = loss(m), np.random.default_rng(1)
    for _ in range(5):
        off = H.Model(m.weights + rng.normal(0, 0.05, len(m.weights)) * (m.weights != 0), m.step + rng.normal(0, 0.05, (2, 2, 2)))
        assert loss(off) < best


def test_held_out_layouts(model):
    right = wrong = 0
    for p in H.dressed_pages([f"<p>{x}</p>" for x in PROSE], number=300, seed=99):
        b = blocks(p)
        y = [next((e.main for e in reversed(x.path) if e.main), "0") == "1" for x in b]
        hit = sum(g == w for g, w in zip(model.decode(b), y, strict=True))
        right, wrong = right + hit, wrong + len(b) - hit
    assert right / (right + wrong) > 0.97
    assert H.fit_blocks([], []).decode(blocks("<p>x</p>")) == [True]  # a field without weights keeps all


def test_extract_on_awkward_rows(spark, model):
    long = "<article>" + "<p>A sentence that is said again and again, as it must be.</p>" * 5000 + "</article>"
    rows = [(1, "u", None), (2, None, ""), (3, "u", "<nav>x</nav>"), (3, "u", "<nav>x</nav>"), (None, "n", "<article><p>Kept text of it, surely.</p></article>"), (5, "l", long)]
    df = spark.createDataFrame([(*r, "clash", 7, "en") for r in rows], SHAPE).repartition(3)
    got = sorted(H.extract(df, model).collect(), key=lambda r: (r.page_id is None, r.page_id or 0))
    assert [(r.page_id, r.url) for r in got] == [(1, "u"), (2, None), (3, "u"), (3, "u"), (5, "l"), (None, "n")]
    assert [r.text for r in got[:4]] == [""] * 4 and got[5].text == "Kept text of it, surely."
    assert got[4].text.count("\n") == 4999 and all(r.n_chars == len(r.text) for r in got)
    assert H.extract(df.limit(0), model).collect() == []
    assert H.sample_pages(df, most=2, longest=1000) == H.sample_pages(df.repartition(5), most=2, longest=1000) and len(H.sample_pages(df, most=2)) == 2
    assert H.sample_pages(df.limit(0)) == [] and H.fit_pages(H.dressed_pages([], number=5), rounds=2).decode(blocks("<p>x</p>")) in ([True], [False])


@pytest.mark.skipif(not SF.exists(), reason="no test tables")
def test_query_gives_the_article_of_every_page(spark):
    from orrery.llm.queries import QUERIES

    def want(page):
        inside = re.search(r"<article>(.*?)(</article>|$)", page, re.S)[1]
        parts = (" ".join(html.unescape(re.sub(r"<[^>]*>", " ", x)).split()) for x in re.split(r"</?(?:p|h1)>", inside))
        return "\n".join(filter(None, parts))

    pages = {r.page_id: r.html for r in spark.read.parquet(f"{SF}/pages.parquet").collect()}
    got = {r.page_id: r.text for r in QUERIES["op11_html_extraction"](spark, str(SF)).collect()}
    assert got == {k: want(v) for k, v in pages.items()}
