"""Quality rules by distribution divergence.

A document's histogram of character classes and its histogram of common words
are compared with those of its language over the whole table, by the
Jensen-Shannon distance (base 2, from 0 to 1). A distance counts only from a
minimum length on, as short texts stray from any reference by chance. A few
base rules on length and repetition come first.

Null and empty texts have no words, and so are rejected as too short. Very long
texts are split once; one must fit into a task's memory. Null or unknown
languages share one reference. Repeated rows count each; ties don't arise.
Every column of the input is kept as it is; the verdicts come in one struct
column whose name the caller chooses and no column has. An empty table gives an
empty table.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plumbline.llm import scratch
from plumbline.llm.exprs import let, total, unused, words

# Common words of each language.
COMMON = {
    "en": ["the", "of", "and", "to", "in", "a", "that", "is", "was", "for", "it", "with", "on", "are", "this", "by"],
    "fr": ["de", "la", "le", "et", "les", "des", "en", "un", "du", "est", "que", "pour", "une", "qui", "dans", "au"],
    "de": ["der", "die", "und", "in", "den", "von", "zu", "das", "mit", "sich", "des", "auf", "ist", "im", "dem", "ein"],
    "es": ["de", "la", "que", "el", "en", "y", "a", "los", "se", "del", "las", "un", "por", "con", "no", "es"],
}
OTHER = "other"
LISTS = {**COMMON, OTHER: [w for lang in COMMON for w in COMMON[lang][:4]]}
SYMBOLS, PUNCTUATION = "[#*$%&|<>]", "[.,;:!?'\"()-]"
MIN_WORDS, MAX_REPEATED = 10, 20  # base rules: words at least, per cent of words in repeated windows at most
CHARS_FROM, WORDS_FROM = 500, 100  # lengths from which the distances count: characters, words
CHARS_MOST, WORDS_MOST = 0.25, 0.25  # the largest distances that pass


def language(lang: Column) -> Column:
    return F.when(lang.isin(list(COMMON)), lang).otherwise(F.lit(OTHER))


def removed(text: Column, pattern: str) -> Column:
    """How many characters of the pattern's class a text has."""
    return F.char_length(text) - F.char_length(F.regexp_replace(text, pattern + "+", ""))


def classes(text: Column, letters: Column) -> Column:
    """Counts of white space, digits, capitals, punctuation, symbols, bytes
    beyond a character's first, and the rest; letters: characters in words."""
    n = F.char_length(text)
    parts = [n - letters, removed(text, "[0-9]"), removed(text, "[A-Z]"), removed(text, PUNCTUATION), removed(text, SYMBOLS), F.octet_length(text) - n]
    return let(F.array(*[F.greatest(p.cast("long"), F.lit(0).cast("long")) for p in parts]), lambda c: F.concat(c, F.array(F.greatest(n - total(c, F.lit(0).cast("long")), F.lit(0).cast("long")))))


def spellings(own: list[str]) -> list[str]:
    """Words in small letters, with a capital, and in capitals."""
    return list(dict.fromkeys(x for w in own for x in (w, w.capitalize(), w.upper())))


def common_counts(found: Column, lang: Column) -> Column:
    """Counts of each common word of the language, then of all other words."""

    def count(own: list[str]) -> Column:
        def of(hits: Column) -> Column:
            each = [(F.size(hits) - F.size(F.array_remove(hits, w))).cast("long") for w in own]
            return F.array(*each, (F.size(found) - F.size(hits)).cast("long"))

        return let(F.transform(F.filter(found, lambda x: x.isin(spellings(own))), F.lower), of)

    out = count(LISTS[OTHER])
    for name, own in COMMON.items():
        out = F.when(lang == name, count(own)).otherwise(out)
    return out


def repeated_words(found: Column) -> Column:
    """Words that lie in windows of five words found twice or more in the text."""
    hashes = F.when(F.size(found) >= 5, F.transform(F.sequence(F.lit(0), F.size(found) - 5), lambda i: F.xxhash64(*[F.get(found, i + k) for k in range(5)])))

    def covered(at: Column) -> Column:
        return total(F.transform(at, lambda x, i: F.least(F.lit(5), F.coalesce(F.get(at, i + 1), x + 5) - x)), F.lit(0))

    def among(s: Column) -> Column:
        same = F.filter(s, lambda x, i: (x["h"] == F.get(s, i - 1)["h"]) | (x["h"] == F.get(s, i + 1)["h"]))
        return let(F.sort_array(F.transform(same, lambda x: x["i"])), covered)

    def count(h: Column) -> Column:
        ordered = F.sort_array(F.transform(h, lambda x, i: F.struct(x.alias("h"), i.alias("i"))))
        return F.when(h.isNull() | (F.size(F.array_distinct(h)) == F.size(h)), F.lit(0)).otherwise(let(ordered, among))

    return let(hashes, count).cast("long")


def distance(p: Column, q: Column) -> Column:
    """Jensen-Shannon distance of two histograms of counts."""

    def part(x: Column, m: Column) -> Column:
        return F.when(x > 0, x * F.log2(x / m)).otherwise(F.lit(0.0))

    def of(sums: Column) -> Column:
        terms = F.zip_with(p, q, lambda a, b: let(F.struct((a / sums["p"]).alias("a"), (b / sums["q"]).alias("b")), lambda s: part(s["a"], (s["a"] + s["b"]) / 2) + part(s["b"], (s["a"] + s["b"]) / 2)))
        return F.sqrt(F.greatest(total(terms, F.lit(0.0)) / 2, F.lit(0.0)))

    zero = F.lit(0).cast("long")
    return let(F.struct(total(p, zero).cast("double").alias("p"), total(q, zero).cast("double").alias("q")), of)


LONGEST = max(map(len, LISTS.values())) + 1


def facts(text: Column, lang: Column) -> Column:
    """Everything that is measured in a text: words, lines, repeats, and the two
    histograms (common words of the language, then all other words)."""

    def of(w: Column) -> Column:
        letters = F.char_length(F.array_join(w, ""))
        lines = let(F.filter(F.split(text, "\n", -1), lambda x: x.rlike(r"[^\x20\x09-\x0D]")), lambda x: F.size(x) - F.size(F.array_distinct(x)))
        return let(
            classes(text, letters),
            lambda c: F.struct(
                F.size(w).cast("long").alias("n_words"), letters.cast("long").alias("word_chars"), F.get(c, F.lit(4)).alias("n_symbols"), lines.cast("long").alias("n_dup_lines"),
                repeated_words(w).alias("n_repeat_words"), F.char_length(text).alias("n_chars"), c.alias("chars"), common_counts(w, lang).alias("words"),
            ),
        )

    return let(words(text), of)


def references(measured: DataFrame, own: str, fact: str) -> DataFrame:
    """Pooled histograms of each language over the whole table: five rows at most."""
    sums = [F.sum(F.coalesce(F.get(f"{fact}.chars", F.lit(i)), F.lit(0))).alias(f"c{i}") for i in range(7)] + [F.sum(F.get(f"{fact}.words", F.lit(i))).alias(f"w{i}") for i in range(LONGEST)]
    out = measured.groupBy(own).agg(*sums)
    return out.select(own, F.array(*[f"c{i}" for i in range(7)]).alias("chars"), F.filter(F.array(*[f"w{i}" for i in range(LONGEST)]), lambda x: x.isNotNull()).alias("words"))


def judge(docs: DataFrame, text_col: str = "text", lang_col: str = "lang", verdict: str = "quality") -> DataFrame:
    """docs with a struct column: n_words, word_chars, n_symbols, n_dup_lines,
    n_repeat_words, char_distance, word_distance, base_failed, kept. Texts are
    measured once; rows with their measures are written and read back, first
    for the references, then for the verdicts."""
    if verdict in docs.columns:
        raise ValueError(f"there is a column {verdict} already")
    ref, own, fact = (unused(docs, f"{verdict}_{n}") for n in ("reference", "language", "facts"))
    lang = language(F.col(lang_col))
    measured = scratch.staged(docs.withColumns({own: lang, fact: facts(F.coalesce(F.col(text_col), F.lit("")), lang)}), "measured")
    refs = references(measured, own, fact).select(own, F.struct("chars", "words").alias(ref))
    v, r = F.col(fact), F.col(ref)
    by_chars = F.when(v["n_chars"] >= CHARS_FROM, distance(v["chars"], r["chars"]))
    by_words = F.when(v["n_words"] >= WORDS_FROM, distance(v["words"], r["words"]))
    base = (v["n_words"] < MIN_WORDS) | (100 * v["n_repeat_words"] > MAX_REPEATED * v["n_words"])
    found = F.struct(*[v[c].alias(c) for c in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")], by_chars.alias("char_distance"), by_words.alias("word_distance"), base.alias("base_failed"))

    def decided(x: Column) -> Column:
        kept = ~x["base_failed"] & (F.coalesce(x["char_distance"], F.lit(0.0)) <= CHARS_MOST) & (F.coalesce(x["word_distance"], F.lit(0.0)) <= WORDS_MOST)
        return x.withField("kept", kept)

    return measured.join(F.broadcast(refs), own, "left").withColumn(verdict, let(found, decided)).drop(own, ref, fact)
