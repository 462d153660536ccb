"""Page extraction: scores and regions by plain loops, pages that only the ratios can decide, odd markup, edges."""

import math
import random

import numpy as np
import pytest

from saltmarsh.llm import html_extract as he

LONG = "A sentence long enough to be counted as the text of an article about the river and its banks."
PAGE = "page_id long, url string, html string"


def events_of(html):
    events = he.Events()
    events.feed(html)
    events.finish()
    return events


def test_scores_by_hand():
    html = f"<body><div>Home <a href=1>News</a> <a href=2>Sport</a></div><p>{LONG}</p><div class=ad>{LONG}</div><article><h2>Title</h2><div class=related>{LONG}</div><p>a<b>b</b><i>c</i></p></article><nav>menu</nav></body>"
    own, marked = he.scores(events_of(html))
    n = len(LONG.replace(" ", ""))
    assert own.tolist() == pytest.approx([4 / 2, n * 1.25, n * 0.02, 5 * 2, n / 2, 3 / 2 * 2 * 1.25, 4 * 0.005])
    assert marked.tolist() == [False, False, True, False, True, False, True]


def plain(own, marked, headings, inside):
    """The choice by loops: Gaussian of sigma 1 over seven places, two centres of logarithms, whole articles, trimmed regions."""
    n, weights = len(own), [math.exp(-k * k / 2) for k in range(-3, 4)]
    smoothed = [sum(w * own[min(max(i + k, 0), n - 1)] for k, w in zip(range(-3, 4), weights, strict=True)) / sum(weights) for i in range(n)]
    logs = [math.log(1 + s) for s in smoothed]
    low, high = min(logs), max(logs)
    for _ in range(20):
        below = [x for x in logs if x < (low + high) / 2]
        above = [x for x in logs if x >= (low + high) / 2]
        if not below or not above:
            break
        low, high = sum(below) / len(below), sum(above) / len(above)
    least = max(math.exp((low + high) / 2) - 1, 3.0)
    above, i = [s >= least for s in smoothed], 0
    article = [x and not m for x, m in zip(inside, marked, strict=True)]
    while i < n:
        j = i
        while j < n and inside[j]:
            j += 1
        if any(smoothed[k] >= least and article[k] for k in range(i, j)):
            for k in range(i, j):
                above[k] = above[k] or article[k]
        i = j + 1
    keep, i = [False] * n, 0
    while i < n:
        if not above[i]:
            i += 1
            continue
        j = i
        while j < n and above[j]:
            j += 1
        a, b = i, j
        while a < b and own[a] < least and not article[a] and not (headings[a] and not marked[a]):
            a += 1
        while a < b and own[b - 1] < least and not article[b - 1]:
            b -= 1
        while a < b and a and headings[a - 1] and not marked[a - 1]:
            a -= 1
        for k in range(a, b):
            keep[k] = not marked[k] or own[k] >= least
        i = j
    return keep if any(keep) else [x > 0 for x in own]


def test_regions_against_plain_loops():
    rng = random.Random(2)
    for _ in range(400):
        n = rng.randrange(1, 40)
        own = np.array([rng.choice((0.0, 1.0, 2.5, 5.0, 14.0, 80.0, 300.0)) * rng.random() for _ in range(n)])
        marked, headings = (np.array([rng.random() < p for _ in range(n)]) for p in (0.2, 0.1))
        begin, end = sorted(rng.choices(range(n + 1), k=2))
        inside = np.array([begin <= i < end and rng.random() < 0.9 for i in range(n)])
        assert he.chosen(own, marked, headings, inside).tolist() == plain(own.tolist(), marked.tolist(), headings.tolist(), inside.tolist())


BARE = f"<body><div><a href=1>Home</a></div><div><a href=2>News</a></div><div>Tel</div><h1>The river</h1><div>{LONG}</div><div>Short.</div><div>{LONG}</div><div>x <a href=3>terms</a></div><div><a href=4>Imprint</a></div></body>"


def test_without_names_the_ratios_decide(monkeypatch):
    want = f"The river {LONG} Short. {LONG}"
    assert he.main_text(BARE).endswith(want) and "Imprint" not in he.main_text(BARE) and "Home" not in he.main_text(BARE)
    monkeypatch.setattr(he, "chosen", lambda own, marked, headings, inside: ~marked)  # the method switched off
    assert he.main_text(BARE) != want and "Imprint" in he.main_text(BARE)


@pytest.mark.parametrize(
    "html,want",
    [
        (f"<body><article><p>{LONG}</p></article><div class=ad>{LONG}</div><article><p>Second {LONG}</p></article></body>", f"{LONG} Second {LONG}"),
        (f"<body><article><p>One {LONG}</p><div class='related-note'><p>{LONG}</p></div><p>Two.</p></article></body>", f"One {LONG} {LONG} Two."),
        (f"<article><p>x<script>var a;</script>y and {LONG}</p></article>", f"xy and {LONG}"),
        (f"<div class='content has-sidebar'><p>{LONG}</p></div>", LONG),
        (f"<div class='sidebar-layout'><h1>T</h1><p>{LONG}</p></div>", f"T {LONG}"),
        (f"<head><title>T</title><meta charset=utf-8><body><p>{LONG}</p>", LONG),
        (f"<head><title>T</title><p>{LONG}</p>", LONG),
        (f"<article><p>{LONG}</p><ul class=related><li><a href=1>Other story of the day</a></li></ul><p>End.</p></article>", f"{LONG} End."),
        (f"<article><p>{LONG}</p></article><section id=comments><article class=comment><p>{LONG}</p></article></section>", LONG),
        (f"<article><p>a &amp; b &#233; {LONG}<br>next</p></article>", f"a & b é {LONG} next"),
        ("ok", "ok"),
        # A name alone rules nothing out.
        (f"<div class='post share-page'><p>{LONG}</p></div>", LONG),
        (f"<article class='post comments-open'><p>{LONG}</p></article>", LONG),
        (f"<article><p>{LONG}</p><div class='social-history'><h2>Social history</h2><p>{LONG}</p></div><p class='banner-caption'>{LONG}</p><p>End.</p></article>", f"{LONG} Social history {LONG} {LONG} End."),
        (f"<footer>{LONG}</footer>", LONG),
        (f"<article><p>{LONG}</p></article><div class='cookie-banner'>{LONG}</div><footer>{LONG * 4}</footer>", LONG),
        ("<p></p></div></b>", ""),
        (f"<div hidden>{LONG}</div><p>{LONG} seen</p>", f"{LONG} seen"),
    ],
)
def test_pages(html, want):
    assert he.main_text(html) == want


def test_the_threshold_decides_on_the_test_pages(spark):
    """With every line that has a score kept, most pages would have more text than their article."""
    pages = [r.html for r in spark.read.parquet("/root/testdata/sf0.01/pages.parquet").select("html").collect()]
    changed = 0
    for html in pages:
        events = he.Events()
        events.feed(html)
        lines = events.finish()
        own, _ = he.scores(events)
        changed += " ".join(w for x, s in zip(lines, own.tolist(), strict=True) if s > 0 for w in x.words) != he.main_text(html)
    assert changed > 0.9 * len(pages)


def test_edges_of_the_table(spark):
    deep = "<div>" * 30_000 + LONG + "</div>" * 30_000
    long = "<article>" + f"<p>{LONG}</p>" * 20_000 + "</article>"
    rows = [(1, "u", deep, "x"), (1, "u", deep, "x"), (2, None, long, "y"), (None, "v", None, None), (3, "w", "", "z")]
    got = he.extract(spark.createDataFrame(rows, "page_id long, url string, html string, text string")).collect()
    assert sorted((r["page_id"] or 0, r["n_chars"]) for r in got) == [(0, 0), (1, len(LONG)), (1, len(LONG)), (2, 20_000 * (len(LONG) + 1) - 1), (3, 0)]
    assert he.extract(spark.createDataFrame([], PAGE)).collect() == []
    assert all(r["n_chars"] == len(r["text"]) for r in got)
