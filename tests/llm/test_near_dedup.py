"""Near-duplicates against all pairs."""

import numpy as np
import pytest

from plumbline.llm import near_dedup as nd

WORDS = [f"w{i}" for i in range(3000)]


def common(a, b):
    """Length of the longest common subsequence, one row at a time."""
    at = {}
    for x in (*a, *b):
        at.setdefault(x, len(at))
    a, b = np.array([at[x] for x in a]), [at[x] for x in b]
    row = np.zeros(len(a) + 1, np.int64)
    for x in b:
        take = np.where(a == x, row[:-1] + 1, 0)
        row[1:] = np.maximum.accumulate(np.maximum(row[1:], take))
    return int(row[-1])


def alike(a, b):
    longer = max(len(a), len(b))
    return min(len(a), len(b)) >= nd.SIMILARITY * longer and len(set(a) & set(b)) >= 0.3 * longer and common(a, b) >= nd.SIMILARITY * longer - 1e-9


def pairs_at(share, seed, n, words):
    rng = np.random.default_rng(seed)
    texts = []
    for k in range(n):
        base = [WORDS[i] for i in rng.integers(0, 3000, words)]
        other = list(base)
        for i in rng.choice(words, int(share * words), replace=False):
            other[i] = f"e{k}x{i}"
        texts += [base, other]
    return texts


def class_of(spark, texts):
    df = spark.createDataFrame([(i, " ".join(t)) for i, t in enumerate(texts)], "doc_id long, text string")
    return {r.doc_id: r.class_id for r in nd.classes(df).collect()}


def test_recall_of_edits(spark):
    shares, each = (0.02, 0.05, 0.08, 0.11, 0.145), 80
    texts = [t for k, share in enumerate(shares) for t in pairs_at(share, k, each, 400)]
    got = class_of(spark, texts)
    found = [sum(got[2 * (each * k + i)] == got[2 * (each * k + i) + 1] for i in range(each)) / each for k in range(len(shares))]
    assert min(found) >= 0.85 and sum(found) / len(found) >= 0.95, found
    assert all(got[2 * i] >= 2 * i for i in range(len(texts) // 2))


def test_against_all_pairs(spark):
    rng = np.random.default_rng(5)
    texts = []
    while len(texts) < 500:
        base = [WORDS[i] for i in rng.integers(0, 3000, rng.integers(1, 150))]
        texts.append(base)
        for _ in range(rng.integers(0, 4)):
            t = list(texts[-1]) if rng.random() < 0.5 else list(base)
            for _ in range(int(rng.integers(0, 1 + len(t) // 4))):
                k = int(rng.integers(0, len(t) + 1))
                if rng.random() < 0.5 and k < len(t) and len(t) > 1:
                    del t[k]
                else:
                    t.insert(k, WORDS[rng.integers(0, 3000)])
            texts.append(t)
    home = list(range(len(texts)))

    def root(x):
        while home[x] != x:
            x = home[x]
        return x

    links = [(i, j) for i in range(len(texts)) for j in range(i) if alike(texts[i], texts[j])]
    for i, j in links:
        home[max(root(i), root(j))] = min(root(i), root(j))
    got = class_of(spark, texts)
    assert all(root(i) == root(got[i]) for i in got)  # no class joins what links don't
    together = sum(got[i] == got[j] for i, j in links)
    assert len(links) > 100 and together >= 0.9 * len(links), (together, len(links))


def test_thue_morse_words_are_no_copies(spark):
    s = [0]
    while len(s) < 4096:
        s += [1 - x for x in s]
    texts = [["ab"[x] for x in s], ["ba"[x] for x in s]]
    df = spark.createDataFrame([(i, " ".join(t)) for i, t in enumerate(texts)], "doc_id long, text string")
    assert [r.copies for r in nd.classes(df).collect()] == [1, 1]


@pytest.mark.parametrize("room", [4])
def test_group_size_changes_nothing(spark, monkeypatch, room):
    """Strangers that share a template, and a copy of each."""
    monkeypatch.setattr(nd, "ROOM", room)
    template, texts = [WORDS[i] for i in range(230)], []
    for c in range(20):
        own = template + [f"t{c}x{k}" for k in range(70)]
        texts += [own, [*own[:290], *(f"c{c}x{k}" for k in range(10))]]
    assert class_of(spark, texts) == {i: i // 2 * 2 for i in range(40)}


@pytest.mark.parametrize("loud", [1])
def test_awkward_rows(spark, monkeypatch, loud):
    monkeypatch.setattr(nd, "LOUD", loud)
    long = "a b c d e f g h i j " * 20000
    rows = [("b", None), ("a", ""), ("c", " \n"), ("d", "X y z"), ("e", "x Y  z"), (None, "x y z"), ("f", long), ("g", long + "end"), ("g", long)]
    df = spark.createDataFrame([(i, t, "n", k) for k, (i, t) in enumerate(rows)], "doc_id string, text string, node string, label int")
    got = sorted((r.doc_id or "", r.class_id, r.class_size, r.copies) for r in nd.classes(df).collect())
    assert got == [("", "d", 3, 3), ("a", "a", 3, 3), ("b", "a", 3, 3), ("c", "a", 3, 3), ("d", "d", 3, 3), ("e", "d", 3, 3), ("f", "f", 3, 2), ("g", "f", 3, 1), ("g", "f", 3, 2)]
    kept = nd.keep_one(df)
    assert kept.columns == df.columns and sorted(r.doc_id for r in kept.collect()) == ["a", "d", "f"]
    assert nd.classes(df.limit(0)).count() == 0 and nd.keep_one(df.limit(0)).count() == 0
