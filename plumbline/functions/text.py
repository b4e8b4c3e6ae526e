"""Text functions as column expressions: labels, numbers, units, citations, titles.

Missing is never zero and never failed: what can't be read is NULL.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from plumbline.functions.arrays import let

# Patterns and word lists of Chinese filings.
BLANK = r"(?U)[\s　]"
NUMBER = r"[0-9][0-9,]*(?:\.[0-9]+)?"
FORCED = r"[0-9][0-9,.]{2,}"
YEAR_ONLY = r"^(19|20)[0-9]{2}$"
CITATION, CITATION_TIGHT = r"\[片段\s*(\d+)\]", r"\[片段(\d+)\]"
ABSTAIN = "资料中未包含|未包含该信息|没有足够信息|无法回答|未提及"
ABSTAIN_AS_OF = "尚未披露|未披露|未包含|没有披露|无法回答|资料中没有|没有找到"
UNIT = r"单位\s*[:：为是]?\s*(?:人民币)?\s*(亿元|百万元|千万元|万元|千元|元)"
UNIT_SCALE = {"元": 1.0, "千元": 1e3, "万元": 1e4, "千万元": 1e7, "百万元": 1e6, "亿元": 1e8}
PREFIXES, PREFIXES_ASCII = ("其中：", "其中", "加：", "减："), ("其中：", "其中:", "其中", "加：", "加:", "减：", "减:")
LABELLED = r"(?U)[\s　（(、.：:其]"  # what labels lose holds one of these
RUNNER = r"(年度报告|第[一二三四五六七八九十\d]{1,3}[章节]|股份有限|有限公司|财务报表|目录|审计报告)"
PERIODS = (("半年度", "H1"), ("年度报告", "FY"), ("第一季度", "Q1"), ("第三季度", "Q3"))
REPORT_KEEP = "(年度报告|半年度报告|第一季度报告|第三季度报告)$"
REPORT_DROP = "(摘要|英文|更正|述职|评估|意见|公告|说明)"
LEAD = r"^(?:[（(【\[]?[一二三四五六七八九十百\d]{1,3}[）)】\]]?[、.．,，:：]?)*"
NO_HEADING = "(分析|变动|项目|主要|说明|附注|科目|情况|结构|表外|日|年度)"
STATEMENTS = {"BS": "资产负债表", "IS": "利润表", "CF": "现金流量表"}
# (heading, statement, scope): compound names first, as the bare ones end them
HEADINGS = (
    ("合并资产负债表", "BS", "合并"),
    ("合并利润表", "IS", "合并"),
    ("合并现金流量表", "CF", "合并"),
    ("母公司资产负债表", "BS", "母公司"),
    ("母公司利润表", "IS", "母公司"),
    ("母公司现金流量表", "CF", "母公司"),
    ("本公司资产负债表", "BS", "母公司"),
    ("本公司利润表", "IS", "母公司"),
    ("本公司现金流量表", "CF", "母公司"),
    ("资产负债表", "BS", "母公司"),
    ("利润表", "IS", "母公司"),
    ("现金流量表", "CF", "母公司"),
)
COMPANY_KEEP = r"\d{4}年(?:年)?(?:度)?报告$"
COMPANY_DROP = "(摘要|英文|更正|述职|评估|意见|公告|说明|补充|问询|督导|持续督导|关于)"


def compact(s: Column) -> Column:
    """Without commas and white space."""
    return F.regexp_replace(s, r"(?U)[,\s，]", "")


def squeezed(s: Column, into: str = " ") -> Column:
    """Runs of blanks and tabs as one blank, or deleted together with commas."""
    return F.regexp_replace(s, "[ \t]+" if into else "[ \t,]+", into)


def label(s: Column, digits: bool = False, prefixes: bool = True, ascii_colon: bool = False) -> Column:
    """A row label without white space, bracketed text (so without ordinals in
    brackets), ordinals, prefixes and trailing colons. digits: also without
    '12、'; prefixes: without one leading 'of which', 'plus' or 'minus';
    ascii_colon: these also before ':'."""
    raw = F.coalesce(s, F.lit(""))
    out = F.regexp_replace(raw, BLANK, "")
    out = F.regexp_replace(out, "[（(][^）)]*[）)]", "")
    out = F.regexp_replace(out, "^[一二三四五六七八九十]+、", "")
    if digits:
        out = F.regexp_replace(out, r"^\d+[、.]", "")
    if prefixes:
        out = F.regexp_replace(out, f"^(?:{'|'.join(PREFIXES_ASCII if ascii_colon else PREFIXES)})", "")
    return F.when(raw.rlike(LABELLED), F.regexp_replace(out, "[：:]+$", "")).otherwise(raw)  # most hold none of it


def bigrams(s: Column) -> Column:
    """The set of character bigrams after white space is removed."""
    t = F.regexp_replace(s, r"(?U)\s", "")
    # characters once as an array: places in a string cost a scan each
    chars = F.regexp_extract_all(t, F.lit("(?s)(.)"), F.lit(1))
    grams = F.transform(F.array(chars), lambda c: F.array_distinct(F.transform(F.slice(c, 1, F.size(c) - 1), lambda x, i: F.concat(x, F.get(c, i + 1)))))
    return F.when(F.char_length(t) >= 2, F.get(grams, F.lit(0))).otherwise(F.array().cast("array<string>"))


def numbers(s: Column, without_years: bool = False) -> Column:
    """Number tokens in order; years of four digits can be left out."""
    found = F.regexp_extract_all(s, F.lit(f"({NUMBER})"), F.lit(1))
    return F.filter(found, lambda n: ~F.replace(n, F.lit(","), F.lit("")).rlike(YEAR_ONLY)) if without_years else found


def forced_numbers(s: Column) -> Column:
    return F.regexp_extract_all(s, F.lit(f"({FORCED})"), F.lit(1))


def citations(s: Column, tight: bool = False) -> Column:
    """Numbers of cited fragments; repaired citations don't count."""
    return F.transform(F.regexp_extract_all(s, F.lit(CITATION_TIGHT if tight else CITATION), F.lit(1)), lambda x: x.cast("int"))


def abstains(s: Column, as_of: bool = False) -> Column:
    return s.rlike(ABSTAIN_AS_OF if as_of else ABSTAIN)


def sentences(s: Column) -> Column:
    """Sentences with their final mark; blank ones are left out."""
    return F.filter(F.split(s, "(?<=[。；])"), lambda x: F.trim(x) != "")


def is_heading(line: Column, name: str, lead: str = LEAD, banned: str = NO_HEADING, most: int = 3) -> Column:
    """Whether a line is a statement heading: after leading numbering it starts
    with the name and nearly nothing follows."""
    return _heads(_unnumbered(line, lead), name, banned, most)


def _unnumbered(line: Column, lead: str = LEAD) -> Column:
    return F.regexp_replace(F.regexp_replace(F.coalesce(line, F.lit("")), BLANK, ""), lead, "")


def _heads(s: Column, name: str, banned: str = NO_HEADING, most: int = 3) -> Column:
    rest = F.btrim(F.substring(s, F.lit(len(name) + 1), F.char_length(s)), F.lit(":：、.。（）()[]【】"))
    return s.startswith(name) & (F.char_length(rest) <= most) & ~rest.rlike(banned)


def heading(line: Column) -> Column:
    """Struct of statement and scope of the first heading of HEADINGS that the
    line is, NULL if it is none."""

    def of(s: Column) -> Column:
        cases = [(_heads(s, name), F.struct(F.lit(kind).alias("label"), F.lit(scope).alias("scope"))) for name, kind, scope in HEADINGS]
        return reduce(lambda acc, c: acc.when(*c), cases[1:], F.when(*cases[0]))

    return let(_unnumbered(line), of)


def most_specific(s: Column, names: tuple[str, ...]) -> Column:
    """The longest of the names that s contains; of equal lengths the first."""
    ordered = sorted(names, key=len, reverse=True)
    return first_match(s, [(n, n) for n in ordered])


def to_number(cell: Column) -> Column:
    """A cell's number; blanks, dashes and anything else are NULL, brackets mean minus."""

    def of(s: Column) -> Column:
        number = lambda bare: F.when(bare.rlike(r"^-?[0-9]+(\.[0-9]+)?$"), bare.try_cast("double"))
        return F.coalesce(number(s), F.when(s.startswith("(") & s.endswith(")"), -let(F.substring(s, F.lit(2), F.char_length(s) - 2), number)))

    return let(F.replace(F.replace(cell, F.lit(","), F.lit("")), F.lit(" "), F.lit("")), of)


def grouped(x: Column) -> Column:
    """A double as '1,234.0' or '1,234.56', with its shortest decimals."""
    plain = x.cast("decimal(38,6)").cast("string")
    decimals = F.regexp_replace(F.substring_index(plain, ".", -1), "0+$", "")
    return F.concat(F.format_number(F.floor(x), 0), F.lit("."), F.when(decimals == "", "0").otherwise(decimals))


def variants(token: Column, small: float = 1e7, large: float | None = 1e8) -> Column:
    """Ways in which a number may be written at other scales (ten thousands,
    hundred millions). large=None leaves out scaling down."""
    x = F.replace(token, F.lit(","), F.lit("")).try_cast("double")
    two = lambda v: F.format_string("%.2f", v)
    up = [f for k in (1e4, 1e8) for f in (two(x * k), F.floor(x * k).cast("string"), grouped(x * k))]
    none = F.array().cast("array<string>")
    out = F.concat(F.array(token, F.replace(token, F.lit(","), F.lit(""))), F.when(F.abs(x) < small, F.array(*up)).otherwise(none))
    if large is not None:
        out = F.concat(out, F.when(F.abs(x) >= large, F.array(two(x / 1e8), two(x / 1e4))).otherwise(none))
    return F.array_distinct(F.filter(out, lambda v: v.isNotNull()))


def report_variants(token: Column) -> Column:
    return variants(token, 1e6, None)


def found_in(text: Column, token: Column) -> Column:
    """Whether any way of writing the number occurs in a text (compacted both)."""
    return F.exists(report_variants(token), lambda v: F.contains(compact(text), compact(v)))


def amount(x: Column, decimals: int = 2) -> Column:
    """'1,234.50' or '1,235'; NULL stays NULL."""
    return F.format_number(x, decimals)


def percentage(share: Column, decimals: int = 2) -> Column:
    """0.1234 as '12.34%'."""
    return F.concat(F.format_number(100 * share, decimals), F.lit("%"))


def nested(s: Column, path: str, default: Column) -> Column:
    """The value at a path of a JSON text, as text; the default where it's missing or not JSON."""
    return F.coalesce(F.try_variant_get(F.try_parse_json(s), "$." + path, "string"), default)


def unit(s: Column) -> Column:
    return F.nullif(F.regexp_extract(s, UNIT, 1), F.lit(""))


def scale(u: Column) -> Column:
    """Scale of a unit; 1 if unknown."""
    return F.coalesce(reduce(lambda acc, kv: acc.when(u == kv[0], kv[1]), list(UNIT_SCALE.items())[1:], F.when(u == "元", 1.0)), F.lit(1.0))


def in_base_unit(value: Column, u: Column) -> Column:
    """Struct of value, unit ('?' if unknown: the value is then unchanged) and scale."""
    return F.struct((value * scale(u)).alias("value"), F.coalesce(u, F.lit("?")).alias("unit"), scale(u).alias("scale"))


def is_header(cells: Column) -> Column:
    """Whether a row looks like a header: a year in it, or its first cell says item."""
    return F.array_join(cells, " ").rlike("(?:19|20)[0-9]{2}") | F.trim(F.get(cells, F.lit(0))).isin("项目", "项　目")


def is_runner(cells: Column) -> Column:
    """A page header within a table: three cells at most, no amount, a runner word."""
    full = F.filter(F.transform(cells, lambda c: F.trim(F.coalesce(c, F.lit("")))), lambda c: c != "")
    amount = F.exists(full, lambda c: F.replace(c, F.lit(","), F.lit("")).rlike("[0-9]{6,}"))
    return F.size(full).between(1, 3) & ~amount & F.exists(full, lambda c: c.rlike(RUNNER))


def hits(text: Column, words: list[str]) -> Column:
    """How many of the words a text contains."""
    return let(text, lambda t: F.size(F.filter(F.array(*map(F.lit, words)), lambda w: F.contains(t, w))))


def contains_any(s: Column, keys: list[str]) -> Column:
    return reduce(lambda a, b: a | b, [s.contains(k) for k in keys])


def contains_none(s: Column, keys: list[str]) -> Column:
    return reduce(lambda a, b: a & b, [~s.contains(k) for k in keys])


def is_report(title: Column, company: bool = False) -> Column:
    return title.rlike(COMPANY_KEEP if company else REPORT_KEEP) & ~title.rlike(COMPANY_DROP if company else REPORT_DROP)


def stripped_title(title: Column, name: Column) -> Column:
    return F.regexp_replace(F.replace(title, name, F.lit("")), "[:： ]", "")


def announcement_id(url: Column) -> Column:
    return F.regexp_extract(url, r"announcementId=(\d+)", 1)


def six_digits(s: Column) -> Column:
    return F.regexp_extract(s, r"(\d{6})", 1)


def exchange_symbol(code: Column) -> Column:
    return F.concat(F.when(F.substring(code, 1, 1).isin("6", "9"), "sh").otherwise("sz"), code)


def period_of(title: Column) -> Column:
    """2024Q3, 2024H1, ... of a title; half years come first, as their titles hold the annual words too."""
    year = F.regexp_extract(title, r"(\d{4})年", 1)
    kind = reduce(lambda acc, p: acc.when(title.contains(p[0]), p[1]), PERIODS[1:], F.when(title.contains(PERIODS[0][0]), PERIODS[0][1]))
    return F.when((year != "") & kind.isNotNull(), F.concat(year, kind)).otherwise("")


def company_period(title: Column) -> Column:
    year = F.regexp_extract(title, r"(\d{4})年", 1)
    return F.when(year != "", F.concat(year, F.lit("FY"))).otherwise("")


def first_match(s: Column, pairs: list[tuple[str, str]]) -> Column:
    """The value of the first key that s contains."""
    return reduce(lambda acc, p: acc.when(s.contains(p[0]), p[1]), pairs[1:], F.when(s.contains(pairs[0][0]), pairs[0][1]))


def unresolved(body: Column, fragments: Column) -> Column:
    """Sentences with numbers, without a citation, none of whose numbers is in any fragment."""
    own = lambda s: numbers(s, without_years=True)
    found = lambda s: F.exists(own(s), lambda n: F.exists(fragments, lambda f: found_in(f, n)))
    return F.filter(sentences(body), lambda s: (F.size(own(s)) > 0) & ~s.rlike(CITATION) & ~found(s))


def repaired(body: Column, fragments: Column) -> Column:
    """A report's text in which each sentence with numbers and no citation gets
    up to three marks of fragments (array of texts) that hold one of its numbers."""

    def fix(sentence: Column) -> Column:
        own = numbers(sentence, without_years=True)
        holds = F.transform(fragments, lambda f, i: F.when(F.exists(own, lambda n: found_in(f, n)), i + 1))
        marks = F.transform(F.slice(F.filter(holds, lambda x: x.isNotNull()), 1, 3), lambda j: F.concat(F.lit("[片段"), j.cast("string"), F.lit("·补]")))
        needs = (F.size(own) > 0) & ~sentence.rlike(CITATION) & (F.size(marks) > 0)
        return F.when(needs, F.concat(F.rtrim(sentence), F.array_join(marks, ""))).otherwise(sentence)

    return F.array_join(F.transform(sentences(body), fix), "")


def fragment_block(texts: Column, sources: Column, starts: Column) -> Column:
    """Fragments as they are shown: number, source and place before each text."""
    heads = F.transform(F.arrays_zip(texts.alias("t"), sources.alias("s"), starts.alias("a")), lambda x, i: F.format_string("[片段%d]（来源 %s 字符 %d–%d）\n%s", i + 1, x["s"], x["a"], x["a"] + F.char_length(x["t"]), x["t"]))
    return F.array_join(heads, "\n\n")
