import random
import time
from itertools import product

import numpy as np

from skein.llm import html_text

PAGE = """<html lang=en><body class="has-sidebar"><header class="site-header"><h1>Site</h1><a href=/>Home</a></header>
<div class="cookie-notice"><p>We use cookies on this site to make it better for you and for all the others.</p></div>
<div id="content"><div class="post"><h2>Title &amp; more</h2><p>First paragraph with a <a href=x>link</a> and text that goes on.
<p>Short.<p>Last &lt;b&gt; words&nbsp;here.</p><form><label>Your name</label></form></div>
<div id="comments"><p>I like this very much, thanks for posting it, a long comment indeed, one could say.</p></div></div>
<aside><p>Related posts that one could read with pleasure on a sunday.</p></aside><footer><p>&copy; 2024</p></footer></body></html>"""


def test_content_without_furniture():
    assert html_text.main_text(PAGE) == "Title & more\nFirst paragraph with a link and text that goes on.\nShort.\nLast <b> words here."


def test_article_pages_keep_all_and_only_the_article():
    page = '<nav><ul><li><a href="/a">a</a></li></ul></nav><!-- x --><div class="ad">Buy.</div><article><h1>T</h1><p><b>One<br><p>Two</p><p>x</p></article><footer>f</footer><script>var t="</p>";</script>'
    assert html_text.main_text(page) == "T\nOne\nTwo\nx"


def test_min_cut_is_minimal():
    rng = random.Random(1)
    for _ in range(60):
        n = rng.randint(1, 7)
        scores = [rng.uniform(-3, 3) for _ in range(n)]
        links = [(i, j, rng.uniform(0, 2)) for i in range(n) for j in range(i + 1, n) if rng.random() < 0.5]

        def cost(keep):
            return sum(max(-s, 0) if k else max(s, 0) for s, k in zip(scores, keep)) + sum(w for i, j, w in links if keep[i] != keep[j])

        got = html_text.min_cut(scores, links)
        assert cost(got) <= min(cost(k) for k in product([False, True], repeat=n)) + 1e-6


def test_rows(spark):
    rows = [(1, "u", PAGE, 3), (1, "u", PAGE, 3), (2, None, None, 3), (3, "v", "", 3), (None, "w", "<p>" + "word " * 50000, 3), (5, "x", "<<<p> a < b <div 'unclosed", 3)]
    frame = spark.createDataFrame(rows, "page_id long, url string, html string, n_chars int")
    got = html_text.extract(frame).collect()
    assert len(got) == 6 and all(r.n_chars == len(r.text) for r in got)
    assert {r.page_id: r.text for r in got if r.page_id in (2, 3)} == {2: "", 3: ""}
    assert html_text.extract(frame.limit(0)).count() == 0


def test_elimination_equals_flow_on_nested_and_crossing_edges():
    rng = random.Random(4)
    for _ in range(200):
        n = rng.randint(2, 9)
        scores = [rng.choice([-1, 1]) * rng.randint(1, 9) / 2 for _ in range(n)]
        links = [(k, k + 1, rng.randint(0, 6) / 4) for k in range(n - 1)] + [(i, j, rng.randint(1, 6) / 4) for i in range(n) for j in range(i + 2, n) if rng.random() < 0.6]

        def cost(keep):
            return sum(max(-s, 0) if k else max(s, 0) for s, k in zip(scores, keep)) + sum(w for i, j, w in links if keep[i] != keep[j])

        assert cost(html_text.min_cut(scores, links)) == min(cost(k) for k in product([False, True], repeat=n))


def test_time_follows_the_length():
    for unit in ("<p>some words</p><ul class=menu>", "<p>a</i><b>b<b>c</i> text", "<div><b>text <p>x"):
        took = []
        for n in (2000, 16000):
            start = time.thread_time()
            html_text.main_text(unit * n)
            took.append(time.thread_time() - start)
        assert took[1] < 40 * took[0] + 0.2


def own_pages(spark, n=120):
    return [r.html for r in spark.read.parquet("/root/testdata/sf0.01/pages.parquet").orderBy("page_id").limit(n).collect()]


def test_learned_weights_and_the_cut_s_share(spark):
    """Costs are fitted to marked pages. With the length of a block as the only evidence, the cut mends labels that it alone gets wrong."""
    pages = own_pages(spark)
    model = html_text.learn(pages[:60])
    assert (model.weights != html_text.WEIGHTS).any() and model.smoothness in html_text.SMOOTH
    only = np.array([f in ("length", "always") for f in html_text.FEATURES])
    alone = cut = moved = mended = 0
    for page in pages[60:]:
        found = html_text.blocks(page)
        truth = [b.holder.home and not b.holder.away for b in found]
        scores = html_text.features(found) @ (html_text.WEIGHTS * only)
        by_score = (scores > 0).tolist()
        by_cut = html_text.min_cut(scores.tolist(), html_text.edges(found))
        alone += sum(a != t for a, t in zip(by_score, truth))
        cut += sum(a != t for a, t in zip(by_cut, truth))
        moved += sum(a != b for a, b in zip(by_score, by_cut))
        mended += sum(a != b and b == t for a, b, t in zip(by_score, by_cut, truth))
        assert html_text.main_text(page, model) == "\n".join(b.text for b, t in zip(found, truth) if t)
    print(f"blocks wrong by length alone {alone}, after the cut {cut}; moved {moved}, of these mended {mended}")
    assert 0 < mended and cut < alone


def test_blocks_without_evidence_follow_their_neighbours():
    page = "<body><div class=menu><div>Home</div><div>Ab</div></div><div class=x><p>" + "A long paragraph of the text. " * 9 + "</p><div>Oh.</div><p>" + "Another long paragraph here. " * 9 + "</p></div></body>"
    found = html_text.blocks(page)
    scores = html_text.features(found) @ html_text.WEIGHTS
    assert [b.text for b, s in zip(found, scores) if s < 0][-1] == "Oh."
    assert "Oh." in html_text.main_text(page).split("\n") and "Home" not in html_text.main_text(page)
    assert html_text.learn(["<p>no mark", ""]).weights is html_text.WEIGHTS
