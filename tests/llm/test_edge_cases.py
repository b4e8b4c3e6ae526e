"""Training-data operators against brute force, on small tables with awkward rows."""

import re
import zlib
from collections import Counter

import numpy as np
import pytest

from plumbline.llm import decontaminate, html_text, language_model, near_dedup, token_files

WORDS = [f"w{i}" for i in range(400)]
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, node string, id string"


def text(seed, n):
    rng = np.random.default_rng(seed)
    return " ".join(WORDS[i] for i in rng.integers(0, len(WORDS), n))


@pytest.fixture(scope="module")
def rows():
    base = text(1, 120)
    edited = base.replace(base.split()[50], "edited")
    shared = text(2, 40)
    texts = [base, base, edited, f"{text(3, 60)} {shared} {text(4, 30)}", f"{text(5, 20)} {shared}", None, "", " \n\t", text(6, 3), text(7, 6000), text(8, 90), text(8, 90)]
    out = [(i, t, "en", "s", len(t or ""), "x", None) for i, t in enumerate(texts)]
    return out + [out[10], (None, text(9, 50), None, None, None, None, None)]


@pytest.fixture(scope="module")
def docs(spark, rows):
    return spark.createDataFrame(rows, SCHEMA)


def empty(docs):
    return docs.limit(0)


def test_language_model(docs, rows):
    got = language_model.score(docs).collect()
    find = re.compile(r"[^\x20\x09-\x0D]+").findall
    held = lambda i: zlib.crc32(("" if i is None else str(i)).encode()) % 10 == 0
    tokens = [(r[0], find(r[1] or "") + [None]) for r in rows]
    c = Counter(x for i, w in tokens if not held(i) for x in w)
    n, v = sum(c.values()), len(c)
    want = sorted((str(i), held(i), len(w), sum(c[x] > 0 for x in w), n, round(sum(np.log10((c[x] + 0.1) / (n + 0.1 * (v + 1))) for x in w), 6)) for i, w in tokens)
    assert want == sorted((str(r.doc_id), r.held_out, r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 6)) for r in got)
    assert all(r.score <= 0 for r in got)
    assert language_model.score(empty(docs)).count() == 0


def test_alignment_is_exact():
    rng = np.random.default_rng(3)
    for _ in range(300):
        a = rng.integers(0, 30, rng.integers(1, 50)).astype(np.uint64)
        b = np.delete(a, rng.integers(0, len(a), rng.integers(0, 6)))
        b = np.insert(b, rng.integers(0, len(b) + 1, 3), rng.integers(0, 30, 3).astype(np.uint64))
        d = np.zeros((len(a) + 1, len(b) + 1), int)
        for i, x in enumerate(a):
            for j, y in enumerate(b):
                d[i + 1, j + 1] = d[i, j] + 1 if x == y else max(d[i, j + 1], d[i + 1, j])
        assert near_dedup.alike(a, b, 0.8) == (d[-1, -1] >= 0.8 * max(len(a), len(b)) - 1e-9)


def test_simple8b_round_trip():
    rng = np.random.default_rng(4)
    for k in range(60):
        n = int(rng.integers(0, 900))
        v = [rng.integers(0, 50000, n), rng.integers(0, 2, n), np.zeros(n), rng.integers(0, 2**61, n)][k % 4].astype(np.uint64)
        assert (token_files.decode(token_files.encode(v), n) == v).all()


PAGE = """<html><head><title>t</title><script>var x = "</p>";</script></head><body><header>Site</header><nav><a>m</a></nav><div class="ad">buy</div>
<article><h1>Head</h1><p><b>Bold &amp; more<br>line<p>Second  paragraph with   text.</p><ul><li>item</li></ul><form>f</form><section class="comments">bad</section></article>
<aside>side</aside><footer>&copy; foot</footer></body></html>"""


def test_html(spark):
    df = spark.createDataFrame([(1, "u", PAGE), (2, None, None), (3, "u", "")], "page_id long, url string, html string")
    got = {r.page_id: r.text for r in html_text.extract(df).collect()}
    assert got == {1: "Head Bold & more line Second paragraph with text. item", 2: "", 3: ""}


def edited(words, at, mark):
    """words with those at the given places replaced."""
    out = list(words)
    for k in at:
        out[k] = f"{mark}{k}"
    return out


def class_of(spark, texts):
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    return {r.doc_id: r.class_id for r in near_dedup.classes(df).collect()}


def test_near_dedup_meets_the_hubs_class(spark):
    # chains: each text is alike the next one, the ends are not, and any of the three may be a group's hub
    chains = []
    for c in range(12):
        base = text(1000 + c, 100).split()
        first = edited(base, range(40, 55), f"a{c}x")
        chains += [" ".join(base), " ".join(first), " ".join(edited(first, range(58, 73), f"b{c}x"))]
    got = class_of(spark, chains)
    assert got == {i: i // 3 * 3 for i in range(36)}


def test_html_without_article_element(spark):
    long, more = "long " * 1000, [f"{k} " + "short " * 50 for k in range(10)]
    page = "<html><body><h1>Head</h1><p>Lead</p><div><p>" + long + "</p>" + "".join(f"<p>{x}</p>" for x in more) + "</div><section><p>Last</p></section></body></html>"
    want = " ".join(" ".join(["Head", "Lead", long, *more, "Last"]).split())
    assert html_text.main_text(page) == want


def test_html_modifiers_are_no_sidebars():
    for tag, name in (("div", "content with-sidebar"), ("article", "post comments-open"), ("main", "has-banner"), ("div", "entry share-enabled"), ("article", "sponsored"), ("div", "sidebar")):
        assert html_text.main_text(f'<body><{tag} class="{name}"><p>Some text</p></{tag}></body>') == "Some text"
    for name in ("sidebar", "widget sidebar-right", "post-comments", "site_footer", "ad-slot", "share-buttons"):
        assert html_text.main_text(f'<body><p>Some text</p><div class="{name}">gone</div></body>') == "Some text"


def test_decontamination_of_shortened_items(spark):
    words = text(70, 59).split()
    short = " ".join(words[:30] + words[31:])
    docs = spark.createDataFrame([(1, short), (2, " ".join(words[:40])), (3, " ".join(words))], "doc_id long, text string")
    items = spark.createDataFrame([(1, " ".join(words))], "item_id long, text string")
    got = {r.doc_id: (r.start, round(r.similarity, 6)) for r in decontaminate.matches(docs, items).collect()}
    assert got == {1: (0, round(50 / 55, 6)), 3: (0, 1.0)}
    assert [r.doc_id for r in decontaminate.without(docs, items).collect()] == [2]
