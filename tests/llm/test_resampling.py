"""Importance resampling against a plain version."""

import hashlib
import math
import re
import zlib
from collections import Counter

import pytest

from plumbline.llm import resampling

SCHEMA = "text string, doc_id long, id string, text_hash long, rank int, _row string"


def features(text):
    small = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    w = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", small)
    runs = [" ".join(w[i : i + k]) for i in range(len(w)) for k in (1, 2, 3) if i + k <= len(w)]
    return len(w), [zlib.crc32(f.encode()) % 10000 for f in runs]


def plain(rows, target, min_words=20, per_cent=5):
    docs = [(i, *features(t)) for t, i in rows]
    s, t = Counter(b for _, _, own in docs for b in own), Counter(b for x in target for b in features(x)[1])
    all_s, all_t = sum(s.values()), sum(t.values())
    gain = [math.floor(1000 * math.log((t[b] + 1.0) * (all_s + 10000.0) / ((s[b] + 1.0) * (all_t + 10000.0)))) for b in range(10000)]
    out = []
    for i, n, own in docs:
        h = int(hashlib.sha256(f"42:{'' if i is None else i}".encode()).hexdigest()[:8], 16)
        weight = sum(gain[b] for b in own)
        out.append([i, n, len(own), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))])
    fit = sorted((x for x in out if x[1] >= min_words), key=lambda x: (-x[4], x[0] is None, x[0]))
    for k, x in enumerate(fit[: len(fit) * per_cent // 100]):
        x.append(k + 1)
    return [tuple((x + [None])[:6]) for x in out]


ROWS = [(f"The quick Brown fox no. {k} jumps Über {k % 7} lazy dogs — and it's {'very ' * (k % 30)}LATE" if k % 9 else "ÀÉ Straße x2 " * (k % 40), k * 7919 % 1009) for k in range(300)]
ROWS += [(None, 5001), ("", 5002), (" \n--", 5003), ("one", 5004), ("word " * 4000, 5005), ("a b " * 15, None), (None, None)] + [("same text " * 12, 5006)] * 3
TARGET = ["the lazy dogs jumps", None, "", "very very late"]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame([(t, i, "x", 1, 2, None) for t, i in ROWS], SCHEMA).repartition(5)


def target(spark):
    return spark.createDataFrame([(x,) for x in TARGET], "text string")


def same(got, want):
    assert sorted(map(repr, got)) == sorted(map(repr, want))


def test_against_plain(spark, docs):
    for per_cent in (5, 60):
        got = resampling.sampled(docs, target(spark), per_cent=per_cent).collect()
        same([(r.id, r.n_words, r.n_features, r.weight, r.score, r["rank"]) for r in got], plain(ROWS, TARGET, per_cent=per_cent))


def test_drawn_rows_keep_their_columns(spark, docs):
    got = resampling.drawn(docs, target(spark), per_cent=60)
    assert got.columns == docs.columns
    want = [(t, x[0]) for (t, _), x in zip(ROWS, plain(ROWS, TARGET, per_cent=60)) if x[5]]
    same([(r.text, r.doc_id) for r in got.collect()], want)


def test_empty_tables(spark, docs):
    assert resampling.sampled(docs.limit(0), target(spark)).count() == 0
    got = resampling.sampled(docs, target(spark).limit(0)).collect()
    same([(r.id, r.n_words, r.n_features, r.weight, r.score, r["rank"]) for r in got], plain(ROWS, []))


def test_no_python_in_the_plan(spark, docs):
    plan = resampling.weighted(docs, target(spark))._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "BroadcastHashJoin" in plan and "BroadcastNestedLoopJoin" not in plan
