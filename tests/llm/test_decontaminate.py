"""Benchmark passages against a comparison of all windows."""

from collections import Counter

import numpy as np
import pyarrow as pa
import pytest

from plumbline.llm import decontaminate as dc

WORDS = [f"w{i}" for i in range(500)]


def shares(words, item, k=5):
    k = min(k, len(item))
    own = Counter(tuple(item[i : i + k]) for i in range(len(item) - k + 1))
    spans = range(max(1, len(words) - len(item) + 1))
    for s in spans:
        window = words[s : s + len(item)]
        got = Counter(tuple(window[i : i + k]) for i in range(len(window) - k + 1))
        yield sum((own & got).values()) / sum(own.values())


def edited(rng, item, edits, at_ends):
    out = list(item)
    for _ in range(edits):
        k = rng.choice([0, len(out) - 1]) if at_ends else rng.integers(0, len(out))
        out[k] = f"e{rng.integers(1e6)}"
        if at_ends:
            out = out[1:] if k == 0 else out[:-1]
    return out


@pytest.fixture(scope="module")
def planted():
    rng = np.random.default_rng(0)
    items = [[WORDS[k] for k in rng.integers(0, 500, rng.integers(20, 80))] for _ in range(60)]
    docs = []
    for i in range(400):
        before, behind = ([WORDS[k] for k in rng.integers(0, 500, rng.integers(0, 60))] for _ in range(2))
        docs.append(before + edited(rng, items[i % 60], i % 5, i % 2 == 0) + behind)
    return items, docs


def test_recall_against_all_windows(spark, planted):
    items, docs = planted
    want = {(d, i) for d, words in enumerate(docs) for i in [d % 60] if max(shares(words, items[i])) >= 0.8}
    df = spark.createDataFrame([(i, " ".join(w)) for i, w in enumerate(docs)], "doc_id long, text string")
    benchmark = spark.createDataFrame([(i, " ".join(w).upper()) for i, w in enumerate(items)], "item_id long, text string")
    got = {(r.doc_id, r.item_id) for r in dc.matches(df, benchmark).collect()}
    assert got <= want and len(got) >= 0.95 * len(want) and len(want) > 200


def test_index_proposes_few_and_finds_all_near_ones():
    rng = np.random.default_rng(1)
    items = pa.array([" ".join(WORDS[k] for k in rng.integers(0, 500, 40)) for _ in range(300)])
    index = dc.Index.build(pa.array(range(300)), items, dc.RADIUS, dc.SIMILARITY)
    prints = rng.integers(0, 1 << 16, (300, dc.BLOCKS)).astype(np.uint16)
    which, _ = index.proposed(prints, 40)
    assert len(which) < 0.03 * 300 * 300
    for far in range(dc.RADIUS + 1):  # any bits of any item
        bits = np.unpackbits(index.prints.view(np.uint8), axis=1, bitorder="little")
        for row in bits:
            row[rng.choice(bits.shape[1], far, replace=False)] ^= 1
        which, item = index.near(np.packbits(bits, axis=1, bitorder="little").view("<u2"), 40)
        assert set(zip(range(300), range(300))) <= set(zip(which.tolist(), item.tolist()))


@pytest.mark.parametrize("kind", ["string", "int", "long"])
def test_blocks_of_items_and_types_of_ids(spark, planted, monkeypatch, kind):
    items, docs = planted
    df = spark.createDataFrame([(i, " ".join(w), i) for i, w in enumerate(docs)], "doc_id long, text string, item int").selectExpr(f"cast(doc_id as {kind}) doc_id", "text", "item")
    benchmark = spark.createDataFrame([(i, " ".join(w)) for i, w in enumerate(items)], "item_id long, text string").selectExpr(f"cast(item_id as {kind}) item_id", "text")
    whole = sorted(map(tuple, dc.matches(df, benchmark).collect()))
    monkeypatch.setattr(dc, "ITEMS", 40)
    assert sorted(map(tuple, dc.matches(df, benchmark).collect())) == whole
    clean = dc.without(df, benchmark)
    assert clean.columns == df.columns and {str(r.doc_id) for r in clean.collect()} == {str(i) for i in range(400)} - {str(r[0]) for r in whole}


def test_awkward_rows(spark):
    item = " ".join(WORDS[:30])
    docs = spark.createDataFrame([(1, item), (1, item), (2, None), (3, ""), (4, "w1 " * 100000 + item + " w2" * 100000), (None, item)], "doc_id long, text string")
    benchmark = spark.createDataFrame([(1, item), (1, item), (2, None), (3, "")], "item_id long, text string")
    got = sorted((r.doc_id or 0, r.item_id, r.start) for r in dc.matches(docs, benchmark).collect())
    assert got == [(0, 1, 0)] * 2 + [(1, 1, 0)] * 4 + [(4, 1, 100000)] * 2
    assert sorted(r.doc_id for r in dc.without(docs, benchmark).collect()) == [2, 3]
    assert dc.matches(docs.limit(0), benchmark).count() == 0 and dc.without(docs.limit(0), benchmark).count() == 0
    assert dc.matches(docs, benchmark.limit(0)).count() == 0 and dc.without(docs, benchmark.limit(0)).count() == 6
