"""Main text: the style tree against a plain recount, names as hints, deep pages, both ways of handing out judged paths."""

from __future__ import annotations

import collections
import math
import tracemalloc

from llm import html

SHAPE = "page_id long, url string, html string"


def _site(k: int) -> str:
    menu = '<ul><li><a href="/a">Start</a></li><li><a href="/b">Shop</a></li></ul>'
    return (
        f'<html><body><nav>{menu}</nav><div class="top"><p>Since 1990</p></div><div><h1>Title {k}</h1><p>Story {k} of the day.</p>'
        f'<p>More {k * 7} of it.</p></div><div class="ad">Buy {k}</div><footer>Imprint</footer></body></html>'
    )


def test_importance_equals_a_plain_recount(spark):
    sources = [_site(k % 30) for k in range(40)] + ["<html><body><nav>Only a menu</nav></body></html>", None, ""]
    df = spark.createDataFrame([("h", s) for s in sources], "host string, html string")
    got = {r.path: (r.nodes, round(r.importance, 9)) for r in html.style_tree(df.repartition(5)).collect()}
    pages = {}
    for s in sources:
        page = html.Page(s or "")
        if page.nodes():
            pages.setdefault(page.told_apart_by(), page.nodes())
    by_path = collections.defaultdict(list)
    for at, nodes in pages.items():
        for path, style, content in nodes:
            by_path[path].append((at, style, content))

    def entropy(values):
        counts, n = collections.Counter(values), len(values)
        return -sum(c / n * math.log(c / n) for c in counts.values()) / math.log(n)

    assert len(pages) == 31 and len(by_path) == len(got)
    for path, rows in by_path.items():
        apart = len({at for at, _, _ in rows}) > 1
        importance = max(entropy([s for _, s, _ in rows]), entropy([c for _, _, c in rows])) if apart else 1.0
        assert got[path] == (len(rows), round(importance, 9))


def test_the_tree_judges_first(spark, monkeypatch):
    rows = [(k, f"http://h.org/{k}", _site(k)) for k in range(30)]
    df = spark.createDataFrame(rows, SHAPE)
    judged = html.style_tree(df.select(html.host_of(df.url).alias("host"), "html")).where(f"nodes >= {html.LEAST_NODES} and importance < {html.LEAST_IMPORTANCE}")
    low = frozenset(r.path for r in judged.collect())
    page = html.Page(rows[0][2])
    by = dict(zip(page.tag, page.judged(low), strict=True))
    assert by["nav"] == by["footer"] == html._TREE and by["h1"] == by["p"] == html._KEPT
    want = {k: f"Title {k}\nStory {k} of the day.\nMore {k * 7} of it." for k in range(30)}
    assert {r.page_id: r.text for r in html.main_text(df).collect()} == want
    monkeypatch.setattr(html, "BROADCAST_PATHS", 0)
    assert {r.page_id: r.text for r in html.main_text(df).collect()} == want


def test_names_are_hints():
    text = {
        '<article><h1 class="article-header">Head</h1><p>x</p></article>': "Head\nx",
        '<body><div class="page-with-sidebar"><p>Text</p></div></body>': "Text",
        '<article><p>Long text of it.</p><section id="related-work"><p>Work</p></section></article>': "Long text of it.\nWork",
        '<article><p>Long text of it.</p><div class="social-history">History</div></article>': "Long text of it.\nHistory",
        '<article><p>Long text of it.</p><section id="discussion"><p>Results</p></section></article>': "Long text of it.\nResults",
        '<article><p>Long text of the article.</p><div class="ad">Buy</div><p>It ends.</p><ol class="comment-list"><li>Nice</ol></article>': "Long text of the article.\nIt ends.",
        '<div class="cookie-notice">We use</div><p>Long text of the page.</p>': "Long text of the page.",
        '<article><p>Long text of it.</p><div class="related"><a href="/1">One</a> <a href="/2">Two</a></div></article>': "Long text of it.",
    }
    assert {s: html.Page(s).text() for s in text} == text


def test_deep_pages_and_strange_tables(spark):
    tracemalloc.start()
    page = html.Page("<div>" * 100_000 + "end")
    assert len(page.nodes()) == 100_000 and page.text() == "end"
    assert tracemalloc.get_traced_memory()[1] < 100 << 20
    tracemalloc.stop()
    long = "<p>" + "word " * 300_000 + "</p>"
    rows = [(1, "http://h.org/", long, "a", "b", "c")] * 2 + [(None, None, None, None, None, None), (3, "", "<p>x", "", "", "")]
    df = spark.createDataFrame(rows, SHAPE + ", host string, low string, c0 string")
    got = sorted((r.page_id or 0, r.host, r.low, r.c0, r.text) for r in html.main_text(df).collect() if r.page_id)
    assert got == [(1, "a", "b", "c", ("word " * 300_000).strip())] * 2 + [(3, "", "", "", "x")]
    assert html.main_text(df).where("page_id is null and text = '' and n_chars = 0").count() == 1
