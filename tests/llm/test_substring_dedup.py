"""Repeats against brute force, on each way that windows can take."""

import re
from collections import Counter

import numpy as np
import pytest

from plumbline.llm import substring_dedup as sd


def brute(texts, window):
    words = [re.findall(r"[^\x20\x09-\x0D]+", t or "") for t in texts]
    seen = Counter(tuple(w[i : i + window]) for w in words for i in range(len(w) - window + 1))
    out = []
    for w in words:
        gone = {i + k for i in range(len(w) - window + 1) if seen[tuple(w[i : i + window])] > 1 for k in range(window)}
        out.append((len(w), len(gone), " ".join(x for i, x in enumerate(w) if i not in gone)))
    return sorted(out)


def corpus(seed):
    rng = np.random.default_rng(seed)
    word = lambda n: [f"w{k}" for k in rng.integers(0, 900, n)]
    passages = [word(int(n)) for n in rng.integers(10, 80, 6)]
    texts = []
    for _ in range(120):
        parts = [word(int(rng.integers(0, 60)))]
        for k in rng.integers(0, 6, rng.integers(0, 3)):
            parts += [passages[k], word(int(rng.integers(0, 40)))]
        texts.append(" ".join(sum(parts, [])))
    copies = [texts[0]] * 40 + [texts[1]] * 2 + ["a b c"] * 30
    return [*texts, *copies, None, "", " \n ", "x " * 3000, "x " * 3000 + "y", "long " + " ".join(word(20000)), " ".join(["p", "q"] * 40)]


@pytest.mark.parametrize("few,window", [(1000, 35), (5, 35), (1, 8)])
def test_against_brute_force(spark, monkeypatch, few, window):
    monkeypatch.setattr(sd, "FEW", few)
    texts = corpus(few)
    df = spark.createDataFrame([(str(i), t, "k", i) for i, t in enumerate(texts)], "doc_id string, text string, key string, copies int")
    got = sd.remove_repeats(df, window=window)
    assert got.columns == ["doc_id", "n_words", "n_removed", "text"]
    assert sorted((r.n_words, r.n_removed, r.text) for r in got.collect()) == brute(texts, window)


def test_runs_grow_with_the_texts(spark):
    """Repeats come back as few ranges, whatever the number of buckets."""
    rng = np.random.default_rng(9)
    shared = " ".join(f"w{k}" for k in rng.integers(0, 5000, 400))
    df = spark.createDataFrame([(i, f"{shared} own{i}") for i in range(20)], "id long, text string").selectExpr("id", "text", "unhex(md5(text)) key", "1L copies", "array(0, 18, 36, 54, 72, 90) at")
    nothing = spark.sparkContext.broadcast((np.zeros(0, np.uint64), np.zeros(0, np.uint64)))
    few, many = (sd.repeated_windows(df, 18, 35, n, nothing, nothing).count() for n in (4, 64))
    assert many <= 1.5 * few
