"""Pages with the text that should come out."""

import time

import pytest

from plumbline.llm import html_text as ht

LONG = "A sentence of the body that is long enough to stand out among the rest. " * 4
BODY = "".join(f"<p>{k} {LONG}</p>" for k in range(4))
TEXT = " ".join(f"{k} {LONG.strip()}" for k in range(4))
LINKS = "<div>" + "".join(f"<a href='/{k}'>Link {k}</a><br>" for k in range(12)) + "</div>"
PAGES = {
    "main with modifier": (f'<body><main class="content no-sidebar">{BODY}</main></body>', TEXT),
    "layout with modifier": (f'<body><div class="layout has-sidebar"><article>{BODY}</article><div class="sidebar">gone</div></div></body>', TEXT),
    "layout named like a part": (f'<body><div class="widget"><article>{BODY}</article></div><div class="widget">gone</div></body>', TEXT),
    "teaser article": (f"<body><article><h2>Teaser</h2><p>Short.</p></article><div>{BODY}</div></body>", f"Teaser Short. {TEXT}"),
    "small articles beside": (f"<body><article>{BODY}</article><article><p>More to read</p></article></body>", TEXT),
    "no article element": (f"<body><div>{LINKS}</div><h1>Head</h1><div>{BODY}</div><section><p>Last</p></section></body>", f"Head {TEXT} Last"),
    "unclosed tags": (f"<body><nav><ul><li>Menu</ul></nav><article><h1>Head<p>{LONG}<p>{LONG}<ul><li>One<li>Two", f"Head {LONG.strip()} {LONG.strip()} One Two"),
    "head left open": (f"<head><title>t</title><body><article>{BODY}</article>", TEXT),
    "reader comments": (f'<body><article>{BODY}<section class="comments"><article class="comment"><p>{LONG}</p></article></section></article></body>', TEXT),
    "headline outside": (f"<body><h1>Head</h1><p>{LONG}</p><article>{BODY}</article><p>Foot</p></body>", f"Head {LONG.strip()} {TEXT}"),
    "small second article": (f"<body><article>{BODY * 8}</article><article><h2>Two</h2><p>{LONG}</p></article></body>", f"{' '.join([TEXT] * 8)} Two {LONG.strip()}"),
    "menu left open": (f"<body><nav><a>Menu</a><article><h1>Head</h1>{BODY}</article>", f"Head {TEXT}"),
    "form around the page": (f"<body><form><article>{BODY}</article></form></body>", TEXT),
    "formula": (f"<article><p>Let <math><mi>x</mi></math> be. {LONG}</p></article>", f"Let x be. {LONG.strip()}"),
    "links beside": (f"<body>{LINKS}<article>{BODY}</article>{LINKS}</body>", TEXT),
    "references": ("<article><p>a &amp; b&#33; &lt;c&gt; &eacute;\n\t d</p></article>", "a & b! <c> é d"),
}


@pytest.mark.parametrize("name", PAGES)
def test_pages(name):
    page, want = PAGES[name]
    assert ht.main_text(page) == want


def test_clusters_select_the_regions(monkeypatch):
    pages = [PAGES["teaser article"][0], PAGES["no article element"][0], PAGES["small articles beside"][0]]
    before = [ht.main_text(p) for p in pages]
    monkeypatch.setattr(ht, "clustered", lambda lines: [True] * len(lines))
    everything = [ht.main_text(p) for p in pages]
    assert everything[1] != before[1]


def test_clusters_decide_beside_articles(monkeypatch):
    pages = [PAGES[n][0] for n in ("headline outside", "small second article")]
    before = [ht.main_text(p) for p in pages]
    monkeypatch.setattr(ht, "clustered", lambda lines: [k == 0 for k in range(len(lines))])
    assert all(a != b for a, b in zip(before, [ht.main_text(p) for p in pages]))


UNFINISHED = ["<a ", "<a b=", "<a b='", '<a b="', "<!--", "<!-- >", "<!", "<?", "</", "</a ", "<![CDATA[", "<a/", "<script>", "<title>", "&", "&#", "<", "<nav>", "<nav><article>", "<form><article>"]


@pytest.mark.parametrize("piece", UNFINISHED)
def test_unfinished_pieces_take_linear_time(piece):
    for page in ("x" + piece * 100_000, "x" + piece * 100_000 + ">"):
        began = time.time()
        assert ht.main_text(page).startswith("x")
        assert time.time() - began < 5


def test_deep_and_long_pages():
    for page in ("<div>" * 100000 + "x", "<div>x" * 100000, "<p>x" * 100000, "<b>" * 100000 + "x", "</div>" * 100000 + "x", "<div>" * 50000 + "x" + "</section>" * 50000, "x " * 3000000, "<b><p>x</p>" * 50000):
        began = time.time()
        assert ht.main_text(page).startswith("x")
        assert time.time() - began < 20


def test_awkward_rows(spark):
    page = PAGES["references"][0]
    rows = [(1, "u", page, "old", 1), (1, "u", page, "old", 1), (2, None, None, "old", None), (None, "u", "", None, 2)]
    got = ht.extract(spark.createDataFrame(rows, "page_id long, url string, html string, text string, tags int"))
    assert got.columns == ["page_id", "url", "tags", "text"]
    assert sorted((r.page_id or 0, r.text) for r in got.collect()) == [(0, ""), (1, "a & b! <c> é d"), (1, "a & b! <c> é d"), (2, "")]
    assert ht.extract(spark.createDataFrame([], "page_id long, url string, html string")).count() == 0
