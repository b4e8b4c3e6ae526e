"""The pipeline on documents whose way through it is known."""

import re
import zlib

import numpy as np
import pytest

import corpus_pipeline as cp
from plumbline.llm import pseudonyms, quality, scratch, tokens

PROSE = "the of and to in a that is was for it with on are this by ".split()
KEY = "a key for the pipeline"


def prose(seed, n=160):
    """Words of which half are common ones, as in the others of the language."""
    rng = np.random.default_rng(seed)
    return [PROSE[rng.integers(0, 16)] if rng.random() < 0.5 else "".join(rng.choice(list("abcdefgh"), 5)) for _ in range(n)]


def rows():
    base, item = prose(1), prose(2, 50)
    near = [*base[:40], "edited", *base[41:]]
    texts = {
        1: base, 2: near, 3: base,  # one class
        4: prose(3), 5: ["mail", "x@y.org", "or", "4111111111111111", *prose(4)],
        6: [*prose(5, 60), *item, *prose(6, 60)],  # holds an item
        7: ["short"], 8: ("again and again we say it here now " * 30).split(),  # fail the base rules
        9: prose(7, 3000), 10: [f"{i}{i}{i}" for i in range(200)],  # long; strays from the language
    }
    out = [(i, " ".join(t), "en", "s", len(" ".join(t)), "extra") for i, t in texts.items()]
    return [*out, (11, None, "en", "s", None, "extra"), (12, "", None, None, 0, None), out[3], (None, out[3][1], "en", "s", 0, "extra")], [(1, " ".join(item)), (2, None)]


@pytest.fixture
def folder(spark, tmp_path):
    docs, items = rows()
    spark.createDataFrame(docs, "doc_id long, text string, lang string, source string, n_chars long, `row_number` string").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    spark.conf.set(pseudonyms.KEY_SETTING, KEY)
    yield str(tmp_path)
    spark.conf.unset(pseudonyms.KEY_SETTING)


def test_documents_take_their_way(spark, folder):
    from tokenizers import Tokenizer

    docs = spark.read.parquet(f"{folder}/documents.parquet")
    kept = scratch.staged(cp.STAGES[0][1](spark, docs, folder), "kept")
    assert kept.columns == docs.columns and sorted(r.doc_id or 0 for r in kept.collect()) == [0, 1, 2, 3, 4, 4, 5, 6, 9]
    once = scratch.staged(cp.STAGES[1][1](spark, kept, folder), "once")
    assert once.columns == docs.columns and sorted(r.doc_id for r in once.collect()) == [1, 4, 5, 6, 9]
    clean = cp.STAGES[2][1](spark, once, folder)
    assert clean.columns == docs.columns and sorted(r.doc_id for r in clean.collect()) == [1, 4, 5, 9]
    hidden = {r.doc_id: r for r in cp.STAGES[3][1](spark, clean, folder).collect()}
    assert hidden[5].text != rows()[0][4][1] and "x@y.org" not in hidden[5].text and "4111111111111111" not in hidden[5].text
    assert all(hidden[i].text == rows()[0][i - 1][1] for i in (1, 4, 9)) and all(r.n_chars == len(r.text) for r in hidden.values())
    own = Tokenizer.from_file(tokens.default_path())
    got = cp.run(spark, folder).collect()
    by = {}
    for r in sorted(got, key=lambda r: r.start):
        by.setdefault(r.doc_id, []).append(r)
    assert set(by) == set(hidden)
    for i, pieces in by.items():
        ids = np.array([*own.encode(hidden[i].text, add_special_tokens=False).ids, 1], "<u4")
        assert [(r.start, r.length) for r in pieces] == [(s, min(2048, len(ids) - s)) for s in range(0, len(ids), 2048)]
        assert all(r.ids_crc32 == zlib.crc32(ids[r.start : r.start + r.length].tobytes()) and r.doc_tokens == len(ids) for r in pieces)
    assert not re.search("plumbline", KEY) and quality.MIN_WORDS == 10


def test_empty_table(spark, folder, tmp_path):
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    docs.limit(0).write.parquet(f"{tmp_path}/none/documents.parquet")
    spark.read.parquet(f"{folder}/benchmark.parquet").write.parquet(f"{tmp_path}/none/benchmark.parquet")
    assert cp.run(spark, f"{tmp_path}/none").count() == 0
