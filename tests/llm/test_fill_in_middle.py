"""Fill-in-middle against a version that cuts texts into tokens."""

import hashlib
import re

import pytest
from hypothesis import given
from hypothesis import strategies as st
from pyspark.sql import functions as F

from plumbline.llm import fill_in_middle as fim

UNIT = re.compile(r"[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+")


def plain(text, key):
    text = text or ""
    units = UNIT.findall(text)
    digest = hashlib.sha256(f"42:{'' if key is None else key}".encode()).hexdigest()
    h1, h2, h3, h4 = (int(digest[8 * k : 8 * k + 8], 16) for k in range(4))
    n = len(units)
    if not text or any(x in text for x in ("<P>", "<S>", "<M>")) or h3 % 100 >= 50:
        return n, "plain", None, None, text
    a, b = sorted((h1 % (n + 1), h2 % (n + 1)))
    p, m, s = ("".join(x) for x in (units[:a], units[a:b], units[b:]))
    form = "spm" if h4 % 100 < 80 else "psm"
    return n, form, len(p), len(m), f"<S>{s}<P>{p}<M>{m}" if form == "spm" else f"<P>{p}<S>{s}<M>{m}"


@given(st.text(alphabet="ab \t\n\v\f\r\x1c é😀<PSM>", max_size=60))
def test_units_end_where_tokens_end(text):
    ends, marked = fim.scanned(text)
    assert [m.end() for m in UNIT.finditer(text)] == list(ends)
    assert marked == any(x in text for x in ("<P>", "<S>", "<M>"))


TEXTS = [None, "", " ", "\n\t ", "one", " one", "one ", "a<P>b c", "x <S> y", "<M>", "<P", "a <<S b", "😀 é x 𝄞", "\x1cend ", "word " * 50_000, "<" * 9, "P> S> M>", "a\r\nb\v\fc"]


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(k * 100 + j, t, "x", "y") for k, t in enumerate(TEXTS) for j in range(12)] + [(None, "a b c d", None, None)] * 2
    return spark.createDataFrame(rows, "doc_id long, text string, output string, form string").repartition(3)


def test_against_plain(docs):
    out = fim.transform(docs)
    assert out.columns == [*docs.columns, "fim"]
    got = out.select("doc_id", "text", "fim.*", fim.restored(F.col("fim.output"), F.col("fim.form")).alias("back")).collect()
    assert len(got) == 12 * len(TEXTS) + 2 and {r.form for r in got} == {"plain", "psm", "spm"}
    for r in got:
        assert (r.n, r.form, r.prefix_chars, r.middle_chars, r.output) == plain(r.text, r.doc_id)
        assert r.back == (r.text or "")


def test_clashes_and_empty_tables(docs):
    assert fim.transform(docs.limit(0)).count() == 0
    with pytest.raises(ValueError):
        fim.transform(docs, into="Text")
