"""The extraction of statements against a plain version over made-up documents."""

import random
import re

import pytest
from pyspark.sql import functions as F

from plumbline.functions import text as T
from plumbline.operators import extraction as E
from plumbline.operators import segmenting


def nrm(s, digits=False):
    s = re.sub(r"[\s　]", "", s or "")
    s = re.sub(r"[（(][^）)]*[）)]", "", s)
    s = re.sub("^[一二三四五六七八九十]+、", "", s)
    return (re.sub(r"^\d+[、.]", "", s) if digits else s).rstrip("：:")


def number(c):
    s = c.replace(",", "").replace(" ", "")
    minus = s.startswith("(") and s.endswith(")")
    s = s[1:-1] if minus else s
    return (-float(s) if minus else float(s)) if re.fullmatch(r"-?\d+(\.\d+)?", s) else None


def tidy(row):
    return [(c or "").replace("\n", " ").strip() for c in row]


def body(rows):
    rows = list(rows)
    while rows:
        full = [c for c in tidy(rows[0]) if c]
        if not (full and len(full) <= 3 and not any(re.search(r"\d{6,}", c.replace(",", "")) for c in full) and any(re.search(T.RUNNER, c) for c in full)):
            break
        rows.pop(0)
    return rows


def clean(rows):
    rows = [tidy(r) for r in rows]
    rows = [(r[0], [number(c) for c in r[1:]]) for r in rows if any(r) and nrm(r[0]) != "项目"]
    width = max((len(v) for _, v in rows), default=0)
    column = lambda j: [v[j] for _, v in rows if j < len(v) and v[j] is not None]
    keep = [j for j in range(width) if column(j) and not (all(abs(x) < 1000 and x == int(x) for x in column(j)) and len(column(j)) >= max(2, 0.5 * len(rows)))]
    return [(label, [v[j] if j < len(v) else None for j in keep]) for label, v in rows] if keep else rows


def looks(row):
    return bool(row) and (bool(re.search(r"(?:19|20)\d\d", " ".join(c or "" for c in row))) or (row[0] or "").strip() in ("项目", "项　目"))


def candidate(tables):
    got = []
    for s in sorted({t["strategy"] for t in tables}):
        own = []
        for t in tables:
            rows = body(t["cells"]) if t["strategy"] == s else []
            if rows:
                flat = " ".join(" ".join(c for c in r if c is not None) for r in rows[:60])
                score = max(sum(w in flat for w in words) for words in E.SIGNATURES.values()) - 2 * sum(w in flat for w in E.NOISE) + 2 * bool(re.search(r"(?:19|20)\d\d", " ".join(c or "" for c in rows[0])))
                if score >= 2:
                    own.append((-score, t["top"], s, rows))
        got += own
        if any(-x[0] >= 3 for x in own):
            break
    return min(got, key=lambda x: x[:3], default=None)


def heading(line):
    s = re.sub(T.LEAD, "", re.sub(r"[\s　]", "", line or ""))
    for name, label, scope in T.HEADINGS:
        rest = s[len(name) :].strip(":：、.。（）()[]【】")
        if s.startswith(name) and len(rest) <= 3 and not re.search(T.NO_HEADING, rest):
            return label, scope


def dual(tables):
    maps = []
    for s in (0, 1):
        best = None
        for t in tables:
            if t["strategy"] == s and not t["cropped"]:
                rows = clean(body(t["cells"]))
                if len(rows) >= 5 and (best is None or len(rows) > len(best)):
                    best = rows
        own = {}
        for label, vals in best or ():
            v = next((x for x in vals if x is not None), None)
            if nrm(label, True) and v is not None:
                own.setdefault(nrm(label, True), v)
        maps.append(own)
    common = set(maps[0]) & set(maps[1])
    return (sum(abs(maps[0][k] - maps[1][k]) <= max(1.0, 1e-6 * abs(maps[0][k])) for k in common) / len(common), len(common)) if common else (1.0, 0)


def plain(pages):
    """pages: {page: (lines, tables)} of one document; (label, scope, pages, header, rows, unit, dropped)."""
    now, groups, first, units, duals = None, {}, {}, {}, {}
    for i, (lines, tables) in sorted(pages.items()):
        text = "\n".join(t for _, t in sorted(lines))
        m = re.search(T.UNIT, text)
        units[i] = m.group(1) if m else None
        raw = [t for t in tables if t["strategy"] == 0 and not t["cropped"]]
        first[i] = raw[0]["cells"][0] if raw else None
        hds = [(y, *heading(t)) for y, t in sorted(lines) if heading(t)]
        now = hds[-1][1:] if hds else now
        crop, whole = (candidate([t for t in tables if t["cropped"] == c]) for c in (True, False))
        duals[i] = dual(tables)
        best = crop if crop and (not whole or crop[0] <= whole[0]) else whole
        if not now or not best:
            continue
        above = [h for h in hds if h[0] <= best[1] + 2]
        label, scope = above[-1][1:] if above else now
        rows = best[3]
        flat = " ".join(" ".join(c for c in r if c is not None) for r in rows[:150])
        if not any(w in flat for w in segmenting.GATE[label]):
            continue
        header = tidy(rows[0])
        for p in (i, i - 1):
            if first.get(p) and looks(tidy(first[p])) and not looks(header):
                header = tidy(first[p])
                break
        unit = units[i] or units.get(i - 1) or units.get(i - 2)
        own, run = clean(rows), groups.setdefault((label, scope), [])
        s = run[-1] if run else None
        width = lambda rs: max((len(v) for _, v in rs), default=0)
        strong = set(E.STRONG[label])
        if s and i == s["pages"][-1] + 1 and len(s["pages"]) < 8 and not (width(own) and width(s["rows"]) and width(own) != width(s["rows"])) and not any(nrm(x) in strong and nrm(x) in {nrm(y) for y, _ in s["rows"]} for x, _ in own):
            s["pages"].append(i)
            s["rows"] += own
            s["unit"] = s["unit"] or unit
        else:
            run.append({"pages": [i], "rows": list(own), "header": header, "unit": unit})
    out = []
    for (label, scope), run in groups.items():
        bad = lambda s: sum(duals[p][1] >= 5 and duals[p][0] < 0.8 for p in s["pages"]) >= max(1, len(s["pages"]) // 2)
        run.sort(key=lambda s: (bad(s), -any(nrm(x) in E.STRONG[label] for x, _ in s["rows"]), -len(s["rows"]), s["pages"][0]))
        if bad(run[0]) or len(run[0]["rows"]) < 8:
            continue
        extra = [s for s in run[1:] if len(s["rows"]) >= max(8, len(run[0]["rows"]) // 2) and s["pages"][0] <= run[0]["pages"][-1] + 6]
        for n, s in enumerate([run[0], *extra]):
            rows, header = s["rows"], s["header"]
            w = max(len(v) for _, v in rows)
            column = lambda j: sum(j < len(v) and v[j] is not None for _, v in rows)
            keep = [j for j in range(w) if not (j + 1 < len(header) and nrm(header[j + 1]) == "附注") and column(j) >= max(2, 0.5 * len(rows))] or [j for j in range(w) if column(j)]
            if len(keep) < w:
                rows = [(x, [v[j] if j < len(v) else None for j in keep]) for x, v in rows]
                header = [header[0] if header else "项目"] + [header[j + 1] if j + 1 < len(header) else "" for j in keep]
            out.append((label, scope if n == 0 else f"{scope}#{n + 1}", tuple(s["pages"]), tuple(header), tuple((x, tuple(v)) for x, v in rows), s["unit"], w - len(keep)))
    return out


LABELS = {k: [*v, *(f"{k}科目{i}" for i in range(12))] for k, v in E.SIGNATURES.items()}


def document(rng):
    pages, kind, scope = {}, rng.choice(["BS", "IS", "CF"]), "合并"
    for i in range(1, rng.randrange(4, 16)):
        if rng.random() < 0.07:
            continue  # a page without text
        lines = [(k * 9.0, rng.choice(["正文", "单位：人民币百万元", "单位: 元", "其他说明"])) for k in range(rng.randrange(1, 4))]
        if rng.random() < 0.45:
            kind, scope = rng.choice(["BS", "IS", "CF"]), rng.choice(["合并", "母公司", "本公司", ""])
            lines.append((rng.choice([60.0, 300.0]), f"{rng.choice(['', '一、', '2. '])}{scope}{T.STATEMENTS[kind]}{rng.choice(['', '（续）', '主要项目'])}"))
        tables = []
        columns, note = rng.choice([2, 2, 2, 3]), rng.random() < 0.5
        labels = rng.sample(LABELS[kind], rng.randrange(3, 12))
        money = lambda: rng.choice(["—", "", "(1,234,567.5)", f"{rng.randrange(10**6, 10**9):,}", f"{rng.randrange(10**6, 10**9)}.25"])
        cells = [[rng.choice(["", "其中：", "一、"]) + x, *([str(rng.randrange(1, 60))] if note else []), *[money() for _ in range(columns)]] for x in labels]
        head = [rng.choice(["项目", "科目"]), *(["附注"] if note and rng.random() < 0.3 else []), "2023年\n12月31日", "2022年12月31日"]
        runner = ["某股份有限公司2023年年度报告", ""]
        for cropped in (False, True):
            for strategy in range(rng.randrange(0, 4)):
                for n in range(rng.randrange(0, 3)):
                    own = [list(r) for r in cells if rng.random() < 0.95]
                    if rng.random() < 0.3:
                        own = [[*r[:-1], money()] for r in own]
                    rows = [*([runner] if rng.random() < 0.4 else []), *([head] if rng.random() < 0.6 else []), *own, *([[None, ""]] if rng.random() < 0.3 else [])]
                    if rows:
                        tables.append({"cropped": cropped, "strategy": strategy, "table_no": n, "top": rng.choice([55.0, 120.0, 310.0]), "cells": rows})
        pages[i] = (lines, tables)
    return pages


@pytest.mark.parametrize("seed", [1, 2])
def test_against_plain(spark, seed):
    rng = random.Random(seed)
    docs = {f"d{n}": document(rng) for n in range(60)}
    lines = spark.createDataFrame([(d, i, y, t) for d, pages in docs.items() for i, (own, _) in pages.items() for y, t in own], "doc string, page int, y double, text string")
    tables = spark.createDataFrame([(d, i, *[t[k] for k in ("cropped", "strategy", "table_no", "top", "cells")]) for d, pages in docs.items() for i, (_, own) in pages.items() for t in own], "doc string, page int, cropped boolean, strategy int, table_no int, top double, cells array<array<string>>")
    manifest = spark.createDataFrame([(d, f"{d}.pdf", "2023FY") for d in docs], "doc string, source string, period string")
    out = E.segments(lines, tables, manifest)
    got = sorted((r.doc, r.label, r.scope, tuple(r.pages), tuple(r.header), tuple((x.label, tuple(x.vals)) for x in r.rows), r.unit, r.dropped) for r in out.collect())
    want = sorted((d, *s) for d, pages in docs.items() for s in plain(pages))
    assert len(want) > 30 and any("#" in w[2] for w in want) and any(len(w[3]) > 2 for w in want) and any(w[7] for w in want)
    assert [g[:4] for g in got] == [w[:4] for w in want]
    assert repr(got) == repr(want)
    assert {(r.doc, r.source, r.table) for r in out.select("doc", "source", "table", "label").collect()} == {(w[0], f"{w[0]}.pdf", T.STATEMENTS[w[1]]) for w in want}


def test_cells_are_read_once(spark):
    """Filters on what is made of cells don't work it out again, nor do loops over words."""
    cells = F.array(F.array(F.col("id").cast("string"), F.lit("1")))
    tables = spark.range(9).select(F.col("id").alias("doc"), F.lit(1).alias("page"), (F.col("id") % 2 == 0).alias("cropped"), (F.col("id") % 2).cast("int").alias("strategy"), F.lit(0).alias("table_no"), F.lit(1.0).alias("top"), cells.alias("cells"))
    plan = lambda df: df._jdf.queryExecution().optimizedPlan().toString()
    assert plan(E.chosen(tables)).count(T.RUNNER) == 2  # the first row, and the others where that is one
    words = ["货币资金", "存货", "净利润"]
    own = plan(tables.select(T.hits(T.label(F.col("doc").cast("string")), words)))
    assert "Contains(lambda" in own  # the text is bound outside of the loop over words


def test_cells_are_written_where_they_are_read(spark):
    """What is dealt by document are line items; cells are made of them after that, once, and aren't sorted."""
    from plumbline.plans import extraction as Q

    df = Q.extracted_statements(spark, "/root/testdata/sf0.001")
    plan = df._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("RepartitionByExpression") == 1 and plan.index("format_number") < plan.index("RepartitionByExpression")
    assert plan.count(T.RUNNER) == 2
    above = plan[: plan.index("format_number")]
    assert "cells#" not in "".join(line for line in above.splitlines() if "Window [last" in line)
    own = df._jdf.queryExecution().executedPlan().toString()
    assert not [line for line in own.splitlines() if "Exchange hashpartitioning" in line and "label" in line]


def test_labels_without_marks_stay(spark):
    """The quick way out of labels gives what the long one gives."""
    cases = ["货币资金", "其中货币", "一、存货", "12.存货", "12、存货", "存 货", "存　货", "存 货", "(一)存货", "存货：", "加:存货", "减：存货", "", None, "1.5", "A:", "一二三", "其他"]
    df = spark.createDataFrame([(c,) for c in cases], "s string")
    for digits in (False, True):
        got = [r[0] for r in df.select(T.label(F.col("s"), digits=digits, prefixes=False)).collect()]
        assert got == [nrm(c, digits) for c in cases]


def test_page_headers_and_numbers(spark):
    """Leading page headers go, however many, and no later ones; numbers are what they were."""
    runner, row = ["某股份有限公司2023年年度报告", ""], ["货币资金", "1,234,567"]
    cases = [[], [runner], [runner, runner, row], [row, runner], [runner, row, runner, row], [runner, [None, ""], row]]
    df = spark.createDataFrame([(i, c) for i, c in enumerate(cases)], "i int, cells array<array<string>>")
    got = {r.i: [list(x) for x in r.b] for r in df.select("i", E.body(F.col("cells")).alias("b")).collect()}
    assert got == {i: body(c) for i, c in enumerate(cases)}
    cells = ["", "—", "-", "－", "–", "/", "不适用", "(", ")", "()", "(1)", "(-1)", "1,2 3", "-5", "1e5", "NaN", ".5", "5.", "(1,234.50)", "--1", "1-2"]
    got = [r[0] for r in spark.createDataFrame([(c,) for c in cells], "c string").select(T.to_number(F.col("c"))).collect()]
    want = [number(c) for c in cells]
    want[cells.index("(-1)")] = 1.0
    assert got == want and got[cells.index("1,2 3")] == 123
