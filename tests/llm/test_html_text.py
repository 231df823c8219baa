import re

import numpy as np
import pytest

from facetta.llm import html_text as H
from tests.llm.html_pages import PAGES


def body(p):
    """The article of the driver's own template, by its tags."""
    inner = re.search(r"<article>(.*?)(</article>|\Z)", p, re.S)
    return "" if not inner else "\n".join(x for x in (" ".join(H.entities.unescape(re.sub(r"<[^<>]*>|<[^<>]*\Z", " ", b)).split()) for b in re.split(r"</?(?:p|h1)[^>]*>", inner[1])) if x)


def test_pages_of_the_tables(spark, sf):
    rows = spark.read.parquet(f"{sf}/pages.parquet").collect()
    got = {r.page_id: r for r in H.main_texts(spark.read.parquet(f"{sf}/pages.parquet")).collect()}
    assert len(got) == len(rows)
    good = sum(got[r.page_id].text == body(r.html) for r in rows)
    assert good >= 0.98 * len(rows)
    assert all(r.n_chars == len(r.text) for r in got.values())


def test_unseen_templates():
    writer, model = H.Writer(987), H.train()
    f1, n = 0.0, 150
    for _ in range(n):
        page = H.parse(writer.page())
        y = H.truth(page)
        keep = H.decode(page, model.margin(H.features(page)))
        size = np.array([len(t) for t in page.text])
        want = np.array([y[o] > 0 for o in page.owner])
        have = np.array([bool(keep[o]) for o in page.owner])
        f1 += 2 * size[want & have].sum() / max(1, size[want].sum() + size[have].sum())
    assert f1 / n > 0.95


PAGE = """<html><head><title>T</title></head><body><header class="site-header"><h1>The Daily Paper</h1><p>News since long ago.</p></header>
<nav><ul><li><a href=/>Home</a></li><li><a href=/x>World</a></li></ul></nav><div class="cookie-notice"><p>We use cookies to improve this site. Please accept.</p></div>
<main><article><h1>A long day &amp; night</h1><p>It began in the morning, when the first of the boats came in. Nobody had seen them before.</p><div class="ad">Buy now, cheap things here for you.</div>
<p>By noon the harbour&nbsp;was full,\n and the people came down to look at it.</p></article><section id="comments"><h3>Comments</h3><div class="comment"><p>I liked this story very much, thank you for it.</p></div></section></main>
<aside class="sidebar"><h3>Most read</h3><ul><li><a href=/1>One thing</a></li><li><a href=/2>Another</a></li></ul></aside>
<form class="newsletter"><label>Your mail</label><input><button>Go</button></form><footer><p>Copyright. All rights are reserved.</p></footer></body></html>"""


def test_a_page_with_everything():
    want = "A long day & night\nIt began in the morning, when the first of the boats came in. Nobody had seen them before.\nBy noon the harbour was full, and the people came down to look at it."
    assert H.extract([PAGE], H.train())[0] == want


def test_hand_made_pages():
    """Pages that neither the generator nor the tables made: every block of the article, no other."""
    for (page, want), got in zip(PAGES, H.extract([p for p, _ in PAGES], H.train())):
        assert got == want


def test_unlisted_elements_keep_their_text():
    extra = "<math><mi>E</mi><mo>=</mo><mi>m</mi></math> <svg><text>drawn</text></svg> <noscript>plain</noscript> <video>film</video> <object>thing</object> <canvas>grid</canvas>"
    page = PAGE.replace("Nobody had seen them before.", f"Nobody had seen them before. {extra} <script>var a='<p>no</p>'</script><style>p{{}}</style>")
    assert "Nobody had seen them before. E=m drawn plain film thing grid\n" in H.extract([page], H.train())[0]


@pytest.mark.parametrize("source", ["<div>{n}</p></li></td>", "<ul><li><ul><div>{n}<li></li>", "<div>{n}x</div>"])
def test_deep_pages_take_linear_time(source):
    import time

    head, tail = source.split("{n}")
    seconds = []
    for n in (8_000, 64_000):
        began = time.perf_counter()
        H.features(H.parse(head * n + tail * n))
        seconds.append(time.perf_counter() - began)
    assert seconds[1] < 24 * seconds[0] + 1


def test_edges(spark):
    rows = [(1, "u", None), (2, None, ""), (3, "u", "plain words only"), (4, "u", "<p>a" * 5000), (5, "u", "<" * 2000), (6, "u", "<div class='x"), (7, "u", "</p></div><li></li></ul>"), (None, "u", PAGE), (8, "u", PAGE), (8, "u", PAGE), (9, "u", '<script>var a="<p>no</p>"'), (10, "u", "<div>" * 3000 + "x"), (11, "u", "<a " + "'" * 3000), (12, "u", "<p " * 3000)]
    pages = spark.createDataFrame([(*r, "e") for r in rows], "page_id long, url string, html string, text string")
    got = H.main_texts(pages).collect()
    assert len(got) == len(rows)
    by = {r.page_id: r.text for r in got}
    assert by[1] == by[2] == by[6] == by[7] == by[9] == "" and by[8] == by[None]
    assert H.main_texts(pages.limit(0)).collect() == []


def test_labels_are_consistent():
    writer, model = H.Writer(5), H.train()
    for _ in range(40):
        page = H.parse(writer.page())
        keep = H.decode(page, model.margin(H.features(page)))
        over = [False] * len(keep)  # inside somewhere above
        cut = [False] * len(keep)
        for i in range(1, len(keep)):
            p = page.parent[i]
            over[i] = over[p] or keep[p]
            cut[i] = cut[p] or (over[i] and not keep[i])
            assert not (cut[p] and keep[i])


@pytest.mark.parametrize("limit", [1, 3])
def test_boosting_fits(limit):
    rng = np.random.default_rng(1)
    x = rng.normal(size=(2000, 4)).astype(np.float32)
    y = ((x[:, 0] > 0) ^ (x[:, 1] > 0.3)).astype(float)
    model = H.boost(x, y, np.ones(2000), trees=60, depth=limit + 1)
    assert ((model.margin(x) > 0) == y).mean() > 0.9
