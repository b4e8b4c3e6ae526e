"""Quality measures against plain Python."""

import math
import re
from collections import Counter

from pyspark.sql import functions as F

from plumbline.llm import quality as q

PROSE = "the cat of the house and the dog in a garden that is for it with this by sun rain wind tree stone river road light "
TEXTS = [("en", PROSE * 6), ("en", " ".join(f"{w}{i}" for i in range(40) for w in PROSE.split())), ("fr", "de la le et " * 60), ("xx", "zzz " * 150), (None, "#* a|b\n#* a|b\n\n \n12 <x>\n12 <x>"), ("en", None), ("en", ""), ("en", "a"), ("en", "1 2 3 4 5 6 7 8 9 10 11 12"), ("de", "漢字 é " * 200), ("en", "w " * 50000)]


def distance(p, r):
    p, r = [x / sum(p) for x in p], [x / sum(r) for x in r]
    part = lambda x, y: x * math.log2(x / ((x + y) / 2)) if x else 0.0
    return math.sqrt(max(sum(part(x, y) + part(y, x) for x, y in zip(p, r)) / 2, 0))


def measured(lang, text):
    t = text or ""
    w = re.findall(r"[^\x20\x09-\x0D]+", t)
    letters = sum(map(len, w))
    lines = [x for x in t.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    grams = Counter(tuple(w[i : i + 5]) for i in range(len(w) - 4))
    covered = {i + k for i in range(len(w) - 4) if grams[tuple(w[i : i + 5])] > 1 for k in range(5)}
    count = lambda pattern: len(re.findall(pattern, t))
    chars = [len(t) - letters, count("[0-9]"), count("[A-Z]"), count(q.PUNCTUATION), count(q.SYMBOLS), len(t.encode()) - len(t)]
    chars.append(max(len(t) - sum(chars), 0))
    own = q.LISTS[lang if lang in q.COMMON else q.OTHER]
    spelled = set(q.spellings(own))
    hits = Counter(x.lower() for x in w if x in spelled)
    return {"n": len(w), "letters": letters, "symbols": chars[4], "dup": len(lines) - len(set(lines)), "repeat": len(covered), "chars": chars, "words": [hits[x] for x in own] + [len(w) - sum(hits.values())], "length": len(t)}


def test_against_python(spark):
    df = spark.createDataFrame([(i, lang, t, "c", "d") for i, (lang, t) in enumerate(TEXTS * 2)], "doc_id int, lang string, text string, quality_language string, quality_reference string")
    got = {r.doc_id: r.quality for r in q.judge(df).collect()}
    own = [measured(lang, t) for lang, t in TEXTS * 2]
    name = lambda lang: lang if lang in q.COMMON else q.OTHER
    pooled = {}
    for (lang, _), m in zip(TEXTS * 2, own):
        c, w = pooled.setdefault(name(lang), ([0] * 7, [0] * len(m["words"])))
        pooled[name(lang)] = [a + b for a, b in zip(c, m["chars"])], [a + b for a, b in zip(w, m["words"])]
    for i, (lang, _) in enumerate(TEXTS * 2):
        m, g = own[i], got[i]
        assert (g.n_words, g.word_chars, g.n_symbols, g.n_dup_lines, g.n_repeat_words) == (m["n"], m["letters"], m["symbols"], m["dup"], m["repeat"]), i
        chars = distance(m["chars"], pooled[name(lang)][0]) if m["length"] >= q.CHARS_FROM else None
        words = distance(m["words"], pooled[name(lang)][1]) if m["n"] >= q.WORDS_FROM else None
        for a, b in ((g.char_distance, chars), (g.word_distance, words)):
            assert (a is None) == (b is None) and (a is None or abs(a - b) < 1e-9), i
        failed = m["n"] < 10 or 100 * m["repeat"] > 20 * m["n"]
        assert g.base_failed == failed and g.kept == (not failed and (chars or 0) <= q.CHARS_MOST and (words or 0) <= q.WORDS_MOST)


def test_columns_stay(spark):
    df = spark.createDataFrame([(1, "en", "a b", "c", "d")], "doc_id int, lang string, text string, quality_language string, quality_facts string")
    out = q.judge(df)
    assert out.columns == [*df.columns, "quality"] and out.drop("quality").collect() == df.collect()
    assert q.judge(df.limit(0)).count() == 0
    plan = q.judge(df)._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan
    assert q.judge(df.withColumn("lang", F.lit(None).cast("string"))).count() == 1
