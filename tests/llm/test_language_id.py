"""Language identification: exact sums, held-out accuracy, awkward rows."""

import os
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from plumbline.llm import language_id as li

DIR = "/root/testdata/sf0.01"


def plain_symbols(text):
    out = [0]
    for c in text or "":
        s = li.symbol(ord(c))
        if s or out[-1]:
            out.append(s)
    return out + [0] * (out[-1] != 0)


def plain_vector(text):
    s, total = plain_symbols(text), np.zeros(li.DIMENSIONS)
    for run, n in Counter(zip(s, s[1:], s[2:])).items():
        a, b, c = (li.letter(x).astype(int) for x in run)
        total += n * np.roll(a, 2) * np.roll(b, 1) * c
    return total


TEXTS = ["", None, "a", "1 2 3", "Hello, world!", "ÇA và: été?", "ab" * 40, "İstanbul नमस्ते 世界", "x " * 30, " lead and trail ", "\ud800 lone"]


@pytest.mark.parametrize("piece", [1 << 19, 7, 2, 1])
def test_vectors_are_exact_sums(monkeypatch, piece):
    monkeypatch.setattr(li, "PIECE", piece)
    got = {}
    for numbers, own in li.vectors(TEXTS):
        for no, v in zip(numbers, own):
            got[no] = got.get(no, 0) + v
    for no, text in enumerate(TEXTS):
        assert (got.get(no, np.zeros(li.DIMENSIONS)) == plain_vector(text)).all()


SAMPLES = {"en": "the house of the king and the way to the river with the others", "fr": "la maison du roi et le chemin vers la rivière avec les autres", "de": "das Haus des Königs und der Weg zum Fluss mit den anderen"}


def test_awkward_rows(spark, monkeypatch):
    rows = [(k, t, lang, "s") for k, (lang, t) in enumerate(SAMPLES.items())] + [(9, "learn me not", None, "s")]
    rows += [(20, None, "en", "s"), (21, "", "fr", "s"), (22, "12 . !", "de", "s"), (23, "the king of the river " * 20_000, None, None), (24, "die Wege des Königs und den Fluss", "zz", "s"), (None, "les chemins vers la maison", "zz", "s")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, score string")
    monkeypatch.setattr(li, "PIECE", 1000)
    out = li.identify(docs, F.col("doc_id") < 10)
    assert out.columns == [*docs.columns, "language"]
    got = {r.doc_id: r.language for r in out.collect()}
    assert {k: v.lang_pred for k, v in got.items()} == {0: "en", 1: "fr", 2: "de", 9: got[9].lang_pred, 20: "und", 21: "und", 22: "und", 23: "en", 24: "de", None: "fr"}
    assert all(0 <= v.score <= 1 for v in got.values()) and got[20].score == 0
    nothing = li.identify(docs, F.col("doc_id") > 1000).select("language.lang_pred").distinct().collect()
    assert [r.lang_pred for r in nothing] == ["und"]
    assert li.identify(docs.limit(0), F.lit(True)).count() == 0
    one = li.identify(docs, F.col("doc_id") == 0).where("doc_id = 1").first().language
    assert one.lang_pred == "en"
    with pytest.raises(ValueError):
        li.learned(docs, "text", "lang", most=2)


@pytest.mark.skipif(not os.path.isdir(DIR), reason="no test tables here")
def test_held_out_accuracy(spark):
    docs = spark.read.parquet(f"{DIR}/documents.parquet")
    held_out = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3 == 1
    out = li.identify(docs, ~held_out).where(held_out).agg(F.avg((F.col("lang") == F.col("language.lang_pred")).cast("int")).alias("right"), F.count("*").alias("n")).first()
    assert out.n > 300 and out.right >= 0.99
