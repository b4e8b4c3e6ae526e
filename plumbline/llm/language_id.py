"""Language identification by hyperdimensional profiles.

Each letter has a random vector of +1 and -1, made from its code point. The
vector of a run of three symbols is the product of its letters' vectors, rotated
by their places (binding); a text's vector is the sum of those of its runs
(bundling), and a language's prototype that of all its training texts. A text
belongs to the language whose prototype has the largest cosine with its vector,
after the mean of the prototypes, which all languages share, is taken off both.

Symbols are small letters with their marks, and one blank for everything
between words. Only texts and the languages of training texts are read. The
prototypes are sums over all training texts: each task adds up what it has seen
and sends one vector a language. They are ``DIMENSIONS`` numbers for each of
``LANGUAGES`` languages at most, which is checked before they are broadcast.

Null texts and texts without a letter are ``und`` with score 0, as is
everything where there is no training text with a letter. Texts with a null
language aren't learned from. Of equal cosines the alphabetically first language wins.
Repeated rows count each. Very long texts are summed up in pieces of ``PIECE``
characters that overlap, so that none is too long. All columns are kept; what is
found comes in one struct column whose name the caller chooses and no column
has. An empty table gives an empty table.
"""

from __future__ import annotations

import unicodedata
from collections import defaultdict
from collections.abc import Iterable, Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

DIMENSIONS, RUN, SEED = 1024, 3, 42
LANGUAGES = 8192
PIECE, TEXTS = 1 << 19, 256  # symbols and texts that are summed up at a time
UNKNOWN = "und"
LIMIT = 0x110000


@lru_cache(1)
def _known() -> np.ndarray:
    """For each code point its symbol: a small letter, 0 for a blank, -1 if not looked up yet."""
    return np.full(LIMIT, -1, np.int32)


def symbol(point: int) -> int:
    c = chr(point)
    return ord(c.lower()[0]) if unicodedata.category(c)[0] in "LM" else 0


def symbols(text: str) -> np.ndarray:
    """Letters of a text with single blanks between words."""
    points = np.frombuffer(text.encode("utf-32-le", "replace"), np.uint32)
    known = _known()
    out = known[points]
    if (new := out < 0).any():
        for p in np.unique(points[new]):
            known[p] = symbol(int(p))
        out = known[points]
    blank = out == 0
    return out[~(blank & np.concatenate(([False], blank[:-1])))]


@lru_cache(1 << 16)
def letter(point: int) -> np.ndarray:
    """The random vector of a symbol."""
    return np.random.Generator(np.random.Philox(key=[SEED, point])).integers(0, 2, DIMENSIONS, np.int8) * np.int8(2) - np.int8(1)


def run_vectors(runs: np.ndarray) -> np.ndarray:
    """Vectors of runs of symbols, one a row."""
    points, at = np.unique(runs, return_inverse=True)
    at, out = at.reshape(runs.shape), None
    base = np.stack([letter(int(p)) for p in points])
    for k in range(RUN):
        turned = np.roll(base, RUN - 1 - k, axis=1)[at[:, k]]
        out = turned if out is None else out * turned
    return out


def pieces(texts: Iterable[str | None]) -> Iterator[tuple[int, np.ndarray]]:
    """(number of the text, symbols with a blank at both ends): long texts in
    pieces that share RUN - 1 symbols."""
    for no, text in enumerate(texts):
        if not text:
            continue
        tail = np.zeros(1, np.int32)
        for lo in range(0, len(text), PIECE):
            own = symbols(text[lo : lo + PIECE])
            if len(own) and own[0] == 0 and tail[-1] == 0:
                own = own[1:]
            last = lo + PIECE >= len(text)
            whole = np.concatenate((tail, own, np.zeros(int(last and (len(own) == 0 and tail[-1] != 0 or len(own) > 0 and own[-1] != 0)), np.int32)))
            if len(whole) >= RUN:
                yield no, whole
            tail = whole[1 - RUN :] if len(whole) >= RUN - 1 else whole


def summed(cell: list[tuple[int, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    """Numbers of the texts of a cell, and the vector of each."""
    numbers, owner = np.unique([no for no, _ in cell], return_inverse=True)
    all_runs = np.concatenate([np.lib.stride_tricks.sliding_window_view(s, RUN) for _, s in cell])
    key = all_runs[:, 0].astype(np.int64)
    for k in range(1, RUN):
        key = key * LIMIT + all_runs[:, k]
    distinct, first, at = np.unique(key, return_index=True, return_inverse=True)
    row = np.repeat(owner, [len(s) - RUN + 1 for _, s in cell])
    counts = np.bincount(row * len(distinct) + at, minlength=len(numbers) * len(distinct)).reshape(len(numbers), -1)
    return numbers, counts.astype(np.float32) @ run_vectors(all_runs[first]).astype(np.float32)


def vectors(texts: Iterable[str | None]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """For some texts at a time their numbers and vectors; texts without a
    letter have none. A text that spans cells comes with a part in each."""
    cell, held, seen = [], 0, set()
    for no, own in pieces(texts):
        cell.append((no, own))
        seen.add(no)
        held += len(own)
        if held >= PIECE or len(seen) >= TEXTS:
            yield summed(cell)
            cell, held, seen = [], 0, set()
    if cell:
        yield summed(cell)


def prototypes(docs: DataFrame, text_col: str, lang_col: str) -> DataFrame:
    """language, at, value: the sums of all training texts, DIMENSIONS rows a language."""
    rows = docs.select(F.col(lang_col).cast("string").alias("language"), F.col(text_col).alias("text")).where("language is not null and text is not null")

    def added(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = defaultdict(lambda: np.zeros(DIMENSIONS))
        for batch in batches:
            langs = np.array(batch.column("language").to_pylist(), object)
            for numbers, found in vectors(x.as_py() for x in batch.column("text")):
                for lang in set(langs[numbers]):
                    sums[lang] += found[langs[numbers] == lang].sum(0, dtype=np.float64)
        if sums:
            yield pa.RecordBatch.from_arrays([pa.array(list(sums)), pa.array([v.astype(np.int64) for v in sums.values()], pa.list_(pa.int64()))], ["language", "vector"])

    parts = rows.mapInArrow(added, "language string, vector array<long>")
    return parts.select("language", F.posexplode("vector").alias("at", "value")).groupBy("language", "at").agg(F.sum("value").alias("value"))


def learned(docs: DataFrame, text_col: str, lang_col: str, most: int = LANGUAGES) -> tuple[list[str], np.ndarray]:
    """The languages in order, and their prototypes as unit vectors."""
    rows = prototypes(docs, text_col, lang_col).groupBy("language").agg(F.array_sort(F.collect_list(F.struct("at", "value"))).alias("v")).select("language", "v.value")
    table = rows.limit(most + 1).toArrow()
    if table.num_rows > most:
        raise ValueError(f"{lang_col} has more than {most} values")
    if not table.num_rows:
        return [], np.zeros((0, DIMENSIONS), np.float32)
    names = table["language"].to_pylist()
    order = np.argsort(np.array(names, object))
    found = np.array(table["value"].to_pylist(), np.float64)[order]
    return [names[i] for i in order], (found / np.maximum(np.linalg.norm(found, axis=1, keepdims=True), 1e-9)).astype(np.float32)


def identify(docs: DataFrame, train: DataFrame | Column, text_col: str = "text", lang_col: str = "lang", into: str = "language") -> DataFrame:
    """docs with a struct column: lang_pred, score (the cosine, from 0 to 1).
    train: the rows of docs to learn from, as a condition, or other labelled rows."""
    if into.lower() in (c.lower() for c in docs.columns):
        raise ValueError(f"there is a column {into} already")
    names, units = learned(train if isinstance(train, DataFrame) else docs.where(train), text_col, lang_col)
    mean = units.mean(0) if len(names) > 1 else np.zeros(DIMENSIONS, np.float32)
    centred = units - mean
    centred /= np.maximum(np.linalg.norm(centred, axis=1, keepdims=True), 1e-9)
    shared = docs.sparkSession.sparkContext.broadcast((np.array(names, object), mean, centred))

    @F.pandas_udf("lang_pred string, score double")
    def found(parts: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        names, mean, centred = shared.value
        for text in parts:
            lang, score = np.full(len(text), UNKNOWN, object), np.zeros(len(text))

            def judge(numbers: np.ndarray, own: np.ndarray) -> None:
                own = own / np.maximum(np.linalg.norm(own, axis=1, keepdims=True), 1e-9) - mean
                cosine = (own / np.maximum(np.linalg.norm(own, axis=1, keepdims=True), 1e-9)) @ centred.T
                best = cosine.argmax(1)
                lang[numbers], score[numbers] = names[best], np.clip(cosine[np.arange(len(best)), best], 0, 1)

            last, part = -1, None  # a text whose vector is not whole yet
            for numbers, own in vectors(text if len(names) else ()):
                if part is not None and numbers[0] == last:
                    own[0] += part
                elif part is not None:
                    judge(np.array([last]), part[None])
                last, part = numbers[-1], own[-1]
                if len(numbers) > 1:
                    judge(numbers[:-1], own[:-1])
            if part is not None:
                judge(np.array([last]), part[None])
            yield pd.DataFrame({"lang_pred": lang, "score": score})

    return docs.withColumn(into, found(F.col(f"`{text_col}`")))
