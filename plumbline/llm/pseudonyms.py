"""Format-preserving pseudonyms for personal data, by keyed Feistel networks.

Found in one pass over a text: e-mail addresses, long hexadecimal secrets,
IBANs, IPv6 and IPv4 addresses, phone numbers (international ones of 7 to 15
digits behind a plus, North American ones without), dates, social security
numbers and card numbers. Numbers and dates are validated: card numbers by
Luhn, IBANs by their remainder, social security numbers by the ranges in use,
addresses by octets, phone numbers by their country code's length, dates by the
calendar, day first where that gives a day, else month first. A card number is
found beside other numbers if it is written as cards are (one group, or groups
of 4-4-4-4, 4-6-5, 4-6-4). What fails stays as it is, long numbers that are no
card numbers too. Not looked for: secrets that aren't hexadecimal, addresses
with letters beyond ASCII, dates with names of months, bare local numbers.
Valid ones are permuted within their format: a Feistel network of eight rounds
over two parts with their own moduli, so that each value of a format has exactly
one pseudonym, and equal values stay linked wherever they stand. Separators and
country codes stay, card numbers and IBANs keep right check digits, social
security numbers stay in the ranges in use, dates stay dates of 1800 to 2199.
What has no small domain (local parts of addresses, secrets, IPv6) takes a keyed
digest of its own length.

The caller gives the key; whoever has it can undo the permutations. Spark's
plans and event logs show a digest of it that serves as well, so they need the
same care as the key.

Null texts stay null, empty ones empty. Very long texts and runs of any
character are scanned in time linear in their length, without recursion.
Repeated rows are treated each; ties don't arise. All other columns are kept as
they are; a column named like ``found`` is an error. An empty table gives an
empty table.
"""

from __future__ import annotations

import hashlib

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from plumbline.llm.exprs import let, unused

OCTET = r"(?:25[0-5]|2[0-4][0-9]|1[0-9]{2}|[1-9]?[0-9])"
EMAIL = r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]++@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)++"  # possessive: Java's greedy groups recurse
SECRET = r"(?<![0-9A-Za-z])[0-9a-fA-F]{32,128}(?![0-9A-Za-z])"
IBAN = r"(?<![0-9A-Za-z])[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?(?![0-9A-Za-z])"
IPV6 = r"(?<![0-9A-Za-z:])(?:(?:[0-9a-fA-F]{1,4}:){7}[0-9a-fA-F]{1,4}|(?:[0-9a-fA-F]{1,4}:){1,6}(?::[0-9a-fA-F]{1,4}){1,6})(?![0-9A-Za-z:])"
IPV4 = rf"(?<![0-9.]){OCTET}(?:\.{OCTET}){{3}}(?![0-9])(?!\.[0-9])"
PHONE = r"(?<![0-9+])\+[1-9](?:[ .()/-]{0,2}[0-9]){6,14}(?![0-9])"
NATIONAL = r"(?<![0-9A-Za-z(+-])(?:\([2-9][0-9]{2}\)[ -]?|[2-9][0-9]{2}[.-])[2-9][0-9]{2}[.-][0-9]{4}(?![0-9A-Za-z-])"
SSN = r"(?<![0-9-])(?!000|666|9)[0-9]{3}-(?!00)[0-9]{2}-(?!0000)[0-9]{4}(?![0-9-])"
DATE = r"(?<![0-9/.-])(?:[0-9]{4}-[0-9]{2}-[0-9]{2}|[0-9]{2}[./][0-9]{2}[./][0-9]{4})(?![0-9])(?![/.-][0-9])"
SEP = "[ -]"
# a card as cards are written: one group, four groups of four and perhaps a shorter one, or four, six and four or five digits
FOURS = rf"[0-9]{{4}}(?:{SEP}[0-9]{{4}}){{3,7}}(?:{SEP}[0-9]{{1,3}})?"
WRITTEN = rf"(?:[0-9]{{13,19}}|{FOURS}|[0-9]{{4}}{SEP}[0-9]{{6}}{SEP}[0-9]{{4,5}})(?![0-9])"
# else any grouping, but for a card that short numbers stand before
CARD = rf"(?<![0-9])(?:{WRITTEN}|(?!(?:[0-9]{{1,3}}{SEP}){{1,3}}{WRITTEN})[0-9](?:[ -]?[0-9]){{12,18}}(?![0-9]))"
ANY = "|".join((EMAIL, SECRET, IBAN, IPV6, IPV4, PHONE, NATIONAL, DATE, SSN, CARD))
# Country codes of two digits; 1 and 7 have one, all others three.
TWO_DIGIT_CODES = "20 27 30 31 32 33 34 36 39 40 41 43 44 45 46 47 48 49 51 52 53 54 55 56 57 58 60 61 62 63 64 65 66 81 82 84 86 90 91 92 93 94 95 98".split()
ROUNDS = 8
FIRST_DAY, DAYS = "1800-01-01", (189, 773)  # 400 years have 189 * 773 days
KEY_SETTING = "spark.plumbline.pseudonyms.key"


def configured_key(spark: SparkSession) -> str:
    """The key that the session is configured with."""
    key = spark.conf.get(KEY_SETTING, None)
    if not key:
        raise ValueError(f"set {KEY_SETTING} to a secret key")
    return key


def keyed(key: str, *parts: Column) -> Column:
    return F.sha2(F.concat_ws("|", F.lit(key), *[p.cast("string") for p in parts]), 256)


def feistel(left: Column, right: Column, a: Column, b: Column, tweak: Column, key: str) -> Column:
    """A permutation of the pairs (left < a, right < b), as a struct of both."""

    def turn(i: Column, value: Column, modulus: Column) -> Column:
        return F.pmod(F.conv(F.substring(keyed(key, tweak, i, value), 1, 15), 16, 10).cast("long"), modulus)

    def step(s: Column, i: Column) -> Column:
        even = i % 2 == 0
        l = F.when(even, F.pmod(s["l"] + turn(i, s["r"], a), a)).otherwise(s["l"])
        r = F.when(even, s["r"]).otherwise(F.pmod(s["r"] + turn(i, s["l"], b), b))
        return F.struct(l.cast("long").alias("l"), r.cast("long").alias("r"))

    return F.aggregate(F.sequence(F.lit(0), F.lit(ROUNDS - 1)), F.struct(left.cast("long").alias("l"), right.cast("long").alias("r")), step)


def power(n: Column) -> Column:
    """10 ** n as a whole number."""
    return F.rpad(F.lit("1"), n + 1, "0").cast("long")


def permuted_digits(digits: Column, kind: str, key: str) -> Column:
    """Another string of as many digits (up to 36)."""
    n = F.length(digits)
    half = F.floor(n / 2).cast("int")
    out = feistel(F.substring(digits, F.lit(1), half), F.substring(digits, half + 1, n), power(half), power(n - half), F.concat(F.lit(kind), n.cast("string")), key)
    return let(out, lambda s: F.concat(F.lpad(s["l"].cast("string"), half, "0"), F.lpad(s["r"].cast("string"), n - half, "0")))


def luhn(digits: Column) -> Column:
    """The sum in which every second digit from the right is doubled."""

    def add(acc: Column, i: Column) -> Column:
        d = F.substring(digits, i, F.lit(1)).cast("int")
        return acc + F.when((F.length(digits) - i) % 2 == 0, d).when(d > 4, 2 * d - 9).otherwise(2 * d)

    return F.aggregate(F.sequence(F.lit(1), F.length(digits)), F.lit(0), add)


def card(digits: Column, key: str) -> Column:
    """The payload permuted, with a check digit that fits."""

    def valid(payload: Column) -> Column:
        return F.concat(payload, F.pmod(-luhn(F.concat(payload, F.lit("0"))), F.lit(10)).cast("string"))

    return let(permuted_digits(F.substring(digits, F.lit(1), F.length(digits) - 1), "card", key), valid)


def whole_card(m: Column, key: str) -> Column:
    """m with its digits permuted as one card's, NULL if they are none's."""
    return let(only_digits(m), lambda d: F.when((F.length(d) <= 19) & (luhn(d) % 10 == 0), filled(m, card(d, key))))


def cards(m: Column, key: str) -> Column:
    """The card in a match of CARD: all of it, or else the first four groups of
    four with a valid number that starts as cards do, or else the first four if
    they are valid. What stands beside stays, as does what is no card."""

    def window(k: int, starts: str) -> Column:
        lo, n = 5 * k, 19  # four groups and the separators between
        part = F.substring(m, lo + 1, n)
        fits = (F.length(part) == n) & part.rlike(starts)
        return F.when(fits, let(whole_card(part, key), lambda x: F.concat(F.substring(m, 1, lo), x, F.substring(m, F.lit(lo + n + 1), F.length(m)))))

    rest = F.when(m.rlike(f"^{FOURS}$"), F.coalesce(*[window(k, "^[3-6]") for k in range(5)], window(0, "^[0-9]")))
    return F.coalesce(whole_card(m, key), rest, m)


def remainder(iban: Column) -> Column:
    """The remainder by 97 of an IBAN without spaces, letters as 10 to 35."""
    moved = F.concat(F.substring(iban, F.lit(5), F.length(iban) - 4), F.substring(iban, 1, 4))

    def add(acc: Column, c: Column) -> Column:
        code = F.ascii(c)
        return F.when(code < 65, (acc * 10 + code - 48) % 97).otherwise((acc * 100 + code - 55) % 97)

    return F.aggregate(F.filter(F.split(moved, ""), lambda c: c != ""), F.lit(0), add)


def iban(m: Column, key: str) -> Column:
    """Digits of the account permuted, check digits that fit; invalid ones stay."""

    def changed(bare: Column) -> Column:
        account = F.substring(bare, F.lit(5), F.length(bare) - 4)
        new = let(filled(account, permuted_digits(only_digits(account), "iban", key)), lambda x: F.concat(F.substring(bare, 1, 2), F.lpad((98 - remainder(F.concat(F.substring(bare, 1, 2), F.lit("00"), x))).cast("string"), 2, "0"), x))
        digits = F.length(only_digits(account))
        return F.when((remainder(bare) == 1) & (F.length(bare) >= 15) & (digits >= 2), let(new, lambda x: filled(m, only_digits(x)))).otherwise(m)

    return let(F.regexp_replace(m, " ", ""), changed)


def ssn(m: Column, key: str) -> Column:
    """Another number with an area of 001 to 899 but 666, a group and a serial that aren't zero."""
    part = lambda at, n: F.substring(m, at, n).cast("long")
    area = part(1, 3) - F.when(part(1, 3) > 666, 2).otherwise(1)
    out = feistel(area * 99 + part(5, 2) - 1, part(8, 4) - 1, F.lit(898 * 99), F.lit(9999), F.lit("ssn"), key)

    def shown(s: Column) -> Column:
        a = F.floor(s["l"] / 99)
        return F.concat(F.lpad((a + F.when(a >= 665, 2).otherwise(1)).cast("string"), 3, "0"), F.lit("-"), F.lpad((s["l"] % 99 + 1).cast("string"), 2, "0"), F.lit("-"), F.lpad((s["r"] + 1).cast("string"), 4, "0"))

    return let(out, shown)


def phone(m: Column, key: str) -> Column:
    """The digits behind the country code permuted."""

    def changed(d: Column) -> Column:
        two = F.substring(d, 1, 2)
        code = F.when(~m.startswith("+"), 0).when(F.substring(d, 1, 1).isin("1", "7"), 1).when(two.isin(TWO_DIGIT_CODES), 2).otherwise(3)
        return filled(m, let(code, lambda k: F.concat(F.substring(d, F.lit(1), k), permuted_digits(F.substring(d, k + 1, F.length(d)), "phone", key))))

    return let(only_digits(m), changed)


def filled(shape: Column, digits: Column) -> Column:
    """shape with its digits replaced by the given ones, in order."""

    def at(i: Column) -> Column:
        c = F.substring(shape, i, F.lit(1))
        return F.when(c.between("0", "9"), F.substring(digits, F.length(F.regexp_replace(F.substring(shape, F.lit(1), i), "[^0-9]", "")), F.lit(1))).otherwise(c)

    return F.array_join(F.transform(F.sequence(F.lit(1), F.length(shape)), at), "")


def only_digits(s: Column) -> Column:
    return F.regexp_replace(s, "[^0-9]", "")


def address(octets: Column, key: str) -> Column:
    o = lambda i: F.get(octets, F.lit(i)).cast("long")
    side = F.lit(65536)
    out = feistel(o(0) * 256 + o(1), o(2) * 256 + o(3), side, side, F.lit("ip"), key)
    return let(out, lambda s: F.concat_ws(".", *[x.cast("string") for h in ("l", "r") for x in (F.floor(s[h] / 256), s[h] % 256)]))


def date(m: Column, key: str) -> Column:
    """Calendar days of 1800 to 2199; anything else stays. The day comes first
    where it can, else the month, and the pseudonym keeps that order."""
    iso, dotted = m.contains("-"), F.translate(m, "/", ".")
    day_first = F.try_to_date(dotted, "dd.MM.yyyy")
    d = F.when(iso, F.try_to_date(m, "yyyy-MM-dd")).otherwise(F.coalesce(day_first, F.try_to_date(dotted, "MM.dd.yyyy")))

    def move(day: Column) -> Column:
        n = F.date_diff(day, F.to_date(F.lit(FIRST_DAY)))
        out = feistel(F.floor(n / DAYS[1]), n % DAYS[1], F.lit(DAYS[0]), F.lit(DAYS[1]), F.lit("date"), key)
        new = let(out, lambda s: F.date_add(F.to_date(F.lit(FIRST_DAY)), (s["l"] * DAYS[1] + s["r"]).cast("int")))
        shown = let(new, lambda x: F.when(iso, F.date_format(x, "yyyy-MM-dd")).when(day_first.isNotNull(), filled(m, F.date_format(x, "ddMMyyyy"))).otherwise(filled(m, F.date_format(x, "MMddyyyy"))))
        return F.when(day.between("1800-01-01", "2199-12-31"), shown).otherwise(m)

    return let(d, move)


def digest(s: Column, kind: str, key: str, n: Column) -> Column:
    return F.substring(F.repeat(keyed(key, F.lit(kind), s), F.lit(2)), F.lit(1), n)


def email(m: Column, key: str) -> Column:
    """A local part of its own; the domain stays. Capitals don't matter."""
    local = F.concat(F.lit("u"), digest(F.lower(m), "email", key, F.lit(15)))
    return F.concat(local, F.substring(m, F.instr(m, "@"), F.length(m)))


def ipv6(m: Column, key: str) -> Column:
    """A keyed digest in place of the digits; capitals don't matter."""
    shape = F.regexp_replace(m, "[0-9a-fA-F]", "0")
    return filled(shape, digest(F.lower(m), "ipv6", key, F.length(F.regexp_replace(m, ":", ""))))


def pseudonym(m: Column, key: str) -> Column:
    """The pseudonym of one match of ANY."""
    return (
        F.when(m.contains("@"), email(m, key))
        .when(m.rlike(f"^{SECRET}$") & (F.length(m) > 19), digest(F.lower(m), "secret", key, F.length(m)))
        .when(m.rlike("^[A-Z]{2}[0-9]"), iban(m, key))
        .when(m.contains(":"), ipv6(m, key))
        .when(m.rlike(f"^{IPV4}$"), address(F.split(m, r"\."), key))
        .when(m.startswith("+") | m.rlike(f"^{NATIONAL}$"), phone(m, key))
        .when(m.rlike(f"^{DATE}$"), date(m, key))
        .when(m.rlike(f"^{SSN}$"), ssn(m, key))
        .otherwise(cards(m, key))
    )


def pseudonymise(docs: DataFrame, key: str, text_col: str = "text", found: str | None = None) -> DataFrame:
    """docs with text_col rewritten and, if found names one, a new column that
    counts what was changed."""
    if not key:
        raise ValueError("pseudonyms need a key")
    if found in docs.columns:
        raise ValueError(f"there is a column {found} already")
    derived = hashlib.sha256(f"plumbline|{key}".encode()).hexdigest()
    text = F.col(text_col)
    maybe = text.rlike("[0-9@]|::") & text.rlike(ANY)

    def rewrite(hits: Column) -> Column:
        new = F.transform(hits, lambda m: pseudonym(m, derived))
        return let(new, lambda x: F.struct(F.array_join(F.zip_with(F.split(text, ANY, -1), x, lambda a, b: F.concat(a, F.coalesce(b, F.lit("")))), "").alias("text"), F.size(F.filter(F.zip_with(hits, x, lambda a, b: a != b), lambda y: y)).alias("n")))

    whole = F.when(maybe, let(F.regexp_extract_all(text, F.lit(ANY), F.lit(0)), rewrite))
    if not found:
        return docs.withColumn(text_col, F.coalesce(whole["text"], text))
    temporary = unused(docs, "pseudonyms")
    out = docs.withColumn(temporary, whole)
    return out.withColumns({text_col: F.coalesce(F.col(f"`{temporary}`.text"), text), found: F.coalesce(F.col(f"`{temporary}`.n"), F.lit(0)).cast("long")}).drop(temporary)
