"""Scores against a plain absolute-discount model with quantised counts."""

import pickle
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest

from plumbline.llm import language_model as lm
from plumbline.llm import scratch

EXACT = (24, 24)  # no level is misread
VOCABULARY = [f"w{i}" for i in range(60)]


def corpus(seed, n):
    rng = np.random.default_rng(seed)
    weights = 1 / np.arange(1, 61)
    return [(i, " ".join(VOCABULARY[k] for k in rng.choice(60, rng.integers(0, 60), p=weights / weights.sum()))) for i in range(n)]


def brute_scores(rows, order=3, least=2):
    find = re.compile(r"[^\x20\x09-\x0D]+").findall
    held = lambda i: zlib.crc32(str(i).encode()) % 10 == 0
    texts = {i: [*find((t or "").lower()), None] for i, t in rows}
    train = [w for i, w in texts.items() if not held(i)]
    quantised = lambda c, floor: floor * lm.BASE ** (np.floor(np.log(c / floor) / np.log(lm.BASE) + 1e-9) + 0.5)
    counts = [Counter(tuple(w[i : i + k]) for w in train for i in range(len(w) - k + 1)) for k in range(1, order + 1)]
    kept = [{g: quantised(c, 1 if k == 0 else least) for g, c in of.items() if k == 0 or c >= least} for k, of in enumerate(counts)]
    behind = defaultdict(list)
    for of in kept[1:]:
        for g, c in of.items():
            behind[g[:-1]].append(c)
    words, n, v = sum(kept[0].values()), sum(counts[0].values()), len(counts[0])
    unseen = lm.ADD * (v + 1) / (n + lm.ADD * (v + 1))

    def probability(context, word):
        p = (1 - unseen) * kept[0].get((word,), 0) / words + unseen / (v + 1)
        for k in range(1, min(len(context), order - 1) + 1):
            c = tuple(context[-k:])
            if c not in behind:
                break
            z = sum(behind[c])
            p = max(kept[k].get((*c, word), 0) - lm.DISCOUNT, 0) / z + lm.DISCOUNT * len(behind[c]) / z * p
        return p

    return {i: sum(np.log10(probability(w[:k], w[k])) for k in range(len(w))) for i, w in texts.items()}


@pytest.mark.parametrize("least", [1, 2])
def test_scores(spark, least):
    rows = corpus(0, 150)
    got = {r.doc_id: r.score for r in lm.score(spark.createDataFrame(rows, "doc_id long, text string"), min_count=least, probes=EXACT).collect()}
    want = brute_scores(rows, least=least)
    assert max(abs(got[i] - want[i]) for i in want) < 1e-6


def test_shards_one_at_a_time(spark, monkeypatch):
    rows = corpus(1, 120)
    df = spark.createDataFrame(rows, "doc_id long, text string")
    monkeypatch.setattr(lm, "SHARD", 2000)
    monkeypatch.setattr(lm, "ROOM", 3000)
    got = {r.doc_id: r.score for r in lm.score(df, probes=EXACT).collect()}
    want = brute_scores(rows)
    assert max(abs(got[i] - want[i]) for i in want) < 1e-6


def test_probabilities_sum_to_one(spark):
    rows = corpus(2, 200)
    docs = spark.createDataFrame(rows, "doc_id long, text string").select("text")
    counts = scratch.staged(lm.counted(docs, 4), "tokens")
    model = lm.train(docs, counts, 4, 3, 2)
    vocabulary = [*VOCABULARY, "never-seen"]
    hashes = np.array([next(lm.tokens(pa.array([w])))[1][0] for w in vocabulary] + [lm.END])
    rng = np.random.default_rng(3)
    for _ in range(40):
        context = rng.choice(hashes[:-1], rng.integers(0, 4))
        texts = np.concatenate([np.r_[context, h] for h in hashes]).astype(np.uint64)
        first = np.arange(len(hashes) + 1) * (len(context) + 1)
        p = model.probabilities(texts, first)[len(context) :: len(context) + 1]
        assert abs(p.sum() - 1) < 1e-6 and p.min() > 0


def test_filter_gives_levels_back():
    rng = np.random.default_rng(0)
    h, q = rng.integers(1, 2**62, 3000).astype(np.uint64), np.arange(3000) % 9
    b = lm.bucket(h, 1)
    shard = lm.Shard.of_bucket(0, lm.named(h[q > 0], b[q > 0]), q[q > 0], lm.PROBES)
    got = shard.levels(h, b)
    assert (got >= q).all() and ((got > 0) == (q > 0)).all() and (got == q).mean() > 0.98
    assert (shard.maybe(h, b) >= (q > 0)).all()


def test_contexts_are_sent_as_whole_numbers():
    """Their bytes stay in the driver's memory, as long as the broadcast lives."""
    rng = np.random.default_rng(0)
    b = np.sort(rng.integers(5, 9, 5000))
    h = rng.integers(0, 1 << 48, 5000).astype(np.uint64)
    key = ((b - 5).astype(np.uint64) << lm.LOW_BITS) | h
    order = np.argsort(key)
    levels = [rng.integers(1, 12, rng.integers(1, 9)) for _ in key]
    z, m = np.array([lm.decoded(q, 2).sum() for q in levels])[order], np.array([len(q) for q in levels])[order]
    sent = pickle.dumps(lm.Contexts.of(5, 2, key[order], z, m))
    assert len(sent) < 15 * len(key) + 2000
    total, rest = pickle.loads(sent).find(np.r_[h[order], np.uint64(7)], np.r_[b[order], 5])
    assert np.allclose(total, [*z, 0], rtol=1e-14) and np.allclose(rest, [*lm.DISCOUNT * m / z, 1], rtol=1e-14)


def test_the_driver_keeps_no_garbage_of_shards(spark, monkeypatch):
    rows = corpus(1, 120)
    collected = []
    monkeypatch.setattr(lm, "SHARD", 2000)
    monkeypatch.setattr(scratch, "collect_garbage", lambda spark, at_once=False: collected.append(at_once))
    docs = spark.createDataFrame(rows, "doc_id long, text string").select("text")
    model = lm.train(docs, scratch.staged(lm.counted(docs, 4), "tokens"), 4, 3, 2)
    assert sum(collected) >= sum(len(of) for of in model.shards) > 3


def test_hashes_are_looked_up_in_the_order_of_shards(spark, monkeypatch):
    """Out of order each probe and each search would miss the processor's cache."""
    rows = corpus(1, 120)
    monkeypatch.setattr(lm, "SHARD", 2000)
    docs = spark.createDataFrame(rows, "doc_id long, text string").select("text")
    model = lm.train(docs, scratch.staged(lm.counted(docs, 4), "tokens"), 4, 3, 2)
    (_, h, first), *_ = lm.tokens(pa.array([t for _, t in rows]))
    whole, lengths, sought = model.probabilities(h, first), [], []
    take, search = lm.Shard.run_has, lm.place_of
    monkeypatch.setattr(lm, "RUN", 50)
    monkeypatch.setattr(lm.Shard, "run_has", lambda self, key, *rest: lengths.append(len(key)) or take(self, key, *rest))
    monkeypatch.setattr(lm, "place_of", lambda keys, x: sought.append(x) or search(keys, x))
    assert np.array_equal(model.probabilities(h, first), whole)
    assert 0 < max(lengths) <= 50 < len(h)
    assert len(sought) > 3 and all((x[1:] > x[:-1]).all() for x in sought)


def test_distinct_hashes():
    rng = np.random.default_rng(0)
    h = rng.integers(0, 1 << 62, 300).astype(np.uint64)[rng.integers(0, 300, 2000)]
    for n in (1, 7, 1 << 16, (1 << 16) + 1, 1 << 20):
        u, b, back = lm.distinct(h, n)
        assert np.array_equal(u[back], h) and len(u) == len(np.unique(h)) and np.array_equal(b, lm.bucket(u, n))
        assert (np.lexsort((u & lm.LOW, b)) == np.arange(len(u))).all()
    assert [len(x) for x in lm.distinct(h[:0], 5)] == [0, 0, 0]


def test_awkward_rows(spark):
    rows = [(1, None), (2, ""), (3, " \n"), (None, "a b"), (None, "a b"), (4, "a " * 20000), (4, "A é 漢字 a b")]
    df = spark.createDataFrame([(i, t, "x", 0) for i, t in rows], "doc_id long, text string, bucket string, n_tokens int")
    got = lm.score(df).collect()
    assert sorted(r.n_tokens for r in got) == [1, 1, 1, 3, 3, 5, 20001] and all(r.score < 0 for r in got)
    assert lm.score(df.limit(0)).count() == 0
