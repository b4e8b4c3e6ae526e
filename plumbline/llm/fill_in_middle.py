"""Fill-in-middle transformation: a text is cut at two places between units and
its parts are put in another order around sentinels.

A unit is a word with the white space before it; white space at the end is a
unit of its own. One Aho-Corasick automaton of the white-space characters and
the sentinels scans a text once. Its events are the only places where anything
can change: a gap between two of them is a word and ends a unit, so the units
are counted by arithmetic on the places of the events, and the end of unit k is
looked up by its rank, without cutting the text into tokens.

Where the cuts are, and which form a text takes, depends on the seed and the
document's id alone. Null texts count as empty, and empty ones stay plain, as
do texts that hold a sentinel. A null id counts as the empty string. Equal ids
take equal decisions, so repeated rows have equal results; ties don't arise.
Very long texts are scanned whole, with eight bytes held for each event; one
must fit into a worker's memory. All columns are kept; what is found comes in
one struct column whose name the caller chooses and no column has. An empty
table gives an empty table.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"
SPACES = " \t\n\v\f\r"
RATE, SPM_RATE = 50, 80  # per cent of texts that are cut, and of these in the order suffix, prefix, middle
PLAIN, PSM, SPM = "plain", "psm", "spm"
KIND = "n long, form string, prefix_chars long, middle_chars long, output string"


@lru_cache(1)
def automaton():
    """Gives the length of each pattern: 1 for white space, more for sentinels."""
    import ahocorasick

    out = ahocorasick.Automaton()
    for x in (*SPACES, PREFIX, SUFFIX, MIDDLE):
        out.add_word(x, len(x))
    out.make_automaton()
    return out


def scanned(text: str) -> tuple[np.ndarray, bool]:
    """Where the units end, in code points from the text's start, and whether
    there is a sentinel."""
    events = np.fromiter((at * 4 + size for at, size in automaton().iter(text)), np.int64)  # places and sizes of up to 3
    space = events[(events & 3) == 1] >> 2
    gaps = np.diff(space, prepend=-1, append=len(text)) > 1  # a word before each space, and one before the end
    ends = np.append(space, len(text))[gaps]
    if len(space) and space[-1] == len(text) - 1:
        ends = np.append(ends, len(text))
    return ends, len(space) < len(events)


def cut(text: str, h1: int, h2: int, h3: int, h4: int) -> tuple[int, str, int | None, int | None, str]:
    """n, form, prefix_chars, middle_chars, output."""
    ends, marked = scanned(text)
    n = len(ends)
    if not text or marked or h3 % 100 >= RATE:
        return n, PLAIN, None, None, text
    first, last = (int(ends[k - 1]) if k else 0 for k in sorted((h1 % (n + 1), h2 % (n + 1))))
    prefix, middle, suffix = text[:first], text[first:last], text[last:]
    if h4 % 100 < SPM_RATE:
        return n, SPM, first, last - first, f"{SUFFIX}{suffix}{PREFIX}{prefix}{MIDDLE}{middle}"
    return n, PSM, first, last - first, f"{PREFIX}{prefix}{SUFFIX}{suffix}{MIDDLE}{middle}"


def transformed(parts: Iterator[tuple[pd.Series, ...]]) -> Iterator[pd.DataFrame]:
    names = [x.split()[0] for x in KIND.split(", ")]
    for text, *h in parts:
        rows = [cut(*row) for row in zip(text, *h)]
        out = pd.DataFrame(rows, columns=names)
        yield out.astype({"prefix_chars": "Int64", "middle_chars": "Int64", "n": "int64"})


def draws(key: Column, seed: int) -> list[Column]:
    """Four unsigned 32-bit numbers that depend on seed and key alone."""
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(key.cast("string"), F.lit(""))), 256)
    return [F.conv(F.substring(digest, 8 * k + 1, 8), 16, 10).cast("long") for k in range(4)]


def transform(docs: DataFrame, text_col: str = "text", id_col: str = "doc_id", seed: int = 42, into: str = "fim") -> DataFrame:
    """docs with a struct column: n (units), form, prefix_chars, middle_chars
    (null if plain), output."""
    if into.lower() in (c.lower() for c in docs.columns):
        raise ValueError(f"there is a column {into} already")
    cut_up = F.pandas_udf(transformed, KIND)
    return docs.withColumn(into, cut_up(F.coalesce(F.col(f"`{text_col}`"), F.lit("")), *draws(F.col(f"`{id_col}`"), seed)))


def restored(output: Column, form: Column) -> Column:
    """The text that an output was made of. Texts that were cut hold no
    sentinel, and none arises where parts meet, so the sentinels are the only ones."""
    def after(mark: str, rest: Column) -> Column:
        return F.substring(rest, F.instr(rest, mark) + len(mark), F.char_length(rest))

    def before(mark: str, rest: Column) -> Column:
        return F.substring(rest, F.lit(1), F.instr(rest, mark) - 1)

    middle = after(MIDDLE, output)
    psm = F.concat(before(SUFFIX, after(PREFIX, output)), middle, before(MIDDLE, after(SUFFIX, output)))
    spm = F.concat(before(MIDDLE, after(PREFIX, output)), middle, before(PREFIX, after(SUFFIX, output)))
    return F.when(form == PSM, psm).when(form == SPM, spm).otherwise(output)
