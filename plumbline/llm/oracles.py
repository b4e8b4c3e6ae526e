"""DuckDB SQL for the queries that SQL can express."""

from plumbline.llm import fill_in_middle, quality, resampling

WORDS = r"list_filter(regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda w: w <> '')"


def removed(pattern: str) -> str:
    return f"(length(t) - length(regexp_replace(t, '{pattern}+', '', 'g')))".replace("'\"", "''\"")


def quoted(own: list[str]) -> str:
    return "[" + ", ".join(f"'{w}'" for w in own) + "]"


def js(p: str, q: str) -> str:
    """Jensen-Shannon distance of two lists of counts."""
    a, b = f"(x[1] / list_sum({p}))", f"(x[2] / list_sum({q}))"
    part = lambda x: f"(CASE WHEN {x} > 0 THEN {x} * log2({x} / (({a} + {b}) / 2)) ELSE 0.0 END)"
    return f"sqrt(greatest(coalesce(list_sum(list_transform(list_zip({p}, {q}), lambda x: {part(a)} + {part(b)})), 0) / 2, 0))"


def quality_sql() -> str:
    punctuation = quality.PUNCTUATION.replace("'", "''")
    lists = " ".join(f"WHEN '{k}' THEN {quoted(v)}" for k, v in quality.LISTS.items())
    classes = ["length(t) - letters", removed("[0-9]"), removed("[A-Z]"), f"(length(t) - length(regexp_replace(t, '{punctuation}+', '', 'g')))", removed(quality.SYMBOLS), "octet_length(encode(t)) - length(t)"]
    spelled = " ".join(f"WHEN '{k}' THEN {quoted(quality.spellings(v))}" for k, v in quality.LISTS.items())
    known = ", ".join(f"'{k}'" for k in quality.COMMON)
    return rf"""
WITH base AS (
  SELECT doc_id, coalesce(text, '') AS t, CASE WHEN lang IN ({known}) THEN lang ELSE '{quality.OTHER}' END AS l, {WORDS} AS w,
    row_number() OVER () AS r
  FROM documents
), counted AS (
  SELECT *, len(w) AS n_words, coalesce(list_sum(list_transform(w, lambda x: length(x))), 0)::BIGINT AS letters,
    CASE l {lists} END AS own, CASE l {spelled} END AS spelled
  FROM base
), more AS (
  SELECT *, list_transform([{", ".join(classes)}], lambda x: greatest(x, 0)::BIGINT) AS c6 FROM counted
), hist AS (
  SELECT *, list_append(c6, greatest(length(t) - list_sum(c6), 0)::BIGINT) AS chars,
    list_transform(list_filter(w, lambda x: list_contains(spelled, x)), lambda x: lower(x)) AS hits
  FROM more
), full_hist AS (
  SELECT *, list_append(list_transform(own, lambda o: len(list_filter(hits, lambda x: x = o))), len(w) - len(hits)) AS commons FROM hist
), char_ref AS (
  SELECT l, list(s ORDER BY i) AS ref_chars FROM (
    SELECT l, i, sum(x)::DOUBLE AS s FROM (SELECT l, unnest(chars) AS x, generate_subscripts(chars, 1) AS i FROM full_hist) GROUP BY l, i) GROUP BY l
), word_ref AS (
  SELECT l, list(s ORDER BY i) AS ref_words FROM (
    SELECT l, i, sum(x)::DOUBLE AS s FROM (SELECT l, unnest(commons) AS x, generate_subscripts(commons, 1) AS i FROM full_hist) GROUP BY l, i) GROUP BY l
), windows AS (
  SELECT r, i, w[i : i + 4] AS g FROM (SELECT r, w, unnest(range(1, len(w) - 3)) AS i FROM base WHERE len(w) >= 5)
), repeated AS (
  SELECT r, i FROM (SELECT r, i, count(*) OVER (PARTITION BY r, g) AS n FROM windows) WHERE n > 1
), covered AS (
  SELECT r, count(DISTINCT i + k) AS n_repeat_words FROM repeated, (SELECT unnest(range(5)) AS k) GROUP BY r
), lines AS (
  SELECT r, count(*) - count(DISTINCT x) AS n_dup_lines FROM (SELECT r, unnest(string_split(t, chr(10))) AS x FROM base)
  WHERE regexp_matches(x, '[^\x20\x09-\x0D]') GROUP BY r
), judged AS (
  SELECT doc_id, n_words, letters AS word_chars, {removed(quality.SYMBOLS)} AS n_symbols, coalesce(n_dup_lines, 0) AS n_dup_lines, coalesce(n_repeat_words, 0) AS n_repeat_words,
    CASE WHEN length(t) >= {quality.CHARS_FROM} THEN {js("chars", "ref_chars")} ELSE 0 END AS dc,
    CASE WHEN n_words >= {quality.WORDS_FROM} THEN {js("commons", "ref_words")} ELSE 0 END AS dw
  FROM full_hist LEFT JOIN covered USING (r) LEFT JOIN lines USING (r) LEFT JOIN char_ref USING (l) LEFT JOIN word_ref USING (l)
)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words,
  n_words < {quality.MIN_WORDS} OR 100 * n_repeat_words > {quality.MAX_REPEATED} * n_words AS base_failed,
  NOT (n_words < {quality.MIN_WORDS} OR 100 * n_repeat_words > {quality.MAX_REPEATED} * n_words) AND dc <= {quality.CHARS_MOST} AND dw <= {quality.WORDS_MOST} AS kept
FROM judged"""


OP4 = r"""
WITH base AS (SELECT row_number() OVER () AS r, doc_id, list_filter(regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda w: w <> '') AS w FROM documents),
windows AS (SELECT r, i, md5(array_to_string(w[i : i + 34], ' ')) AS g FROM (SELECT r, w, unnest(range(1, len(w) - 33)) AS i FROM base WHERE len(w) >= 35)),
repeated AS (SELECT r, i FROM (SELECT r, i, count(*) OVER (PARTITION BY g) AS n FROM windows) WHERE n > 1),
gone AS (SELECT DISTINCT r, i + k AS i FROM repeated, (SELECT unnest(range(35)) AS k)),
words AS (SELECT r, unnest(w) AS x, generate_subscripts(w, 1) AS i FROM base),
kept AS (SELECT r, string_agg(x, ' ' ORDER BY i) AS s, count(*) AS n FROM words ANTI JOIN gone USING (r, i) GROUP BY r)
SELECT doc_id, len(w) AS n_words, len(w) - coalesce(n, 0) AS n_removed, sha256(coalesce(s, '')) AS kept_sha256 FROM base LEFT JOIN kept USING (r)"""

OP9 = """
WITH rows AS (SELECT page_id, coalesce(html, '') AS h FROM pages),
sized AS (SELECT page_id, octet_length(encode(h)) AS payload_bytes, sha1(h) AS payload_digest FROM rows),
kept AS (SELECT *, CASE WHEN payload_bytes >= 1000 THEN max(page_id) OVER (PARTITION BY payload_digest) END AS keeper FROM sized)
SELECT page_id, payload_bytes, payload_digest, CASE WHEN keeper <> page_id THEN 'revisit' ELSE 'response' END AS record_type,
  CASE WHEN keeper <> page_id THEN keeper END AS refers_to FROM kept"""

UNSIGNED = "('0x' || substr(hex, {}, 8))::BIGINT"


def resampling_sql() -> str:
    """The crc32 has no function in DuckDB, so it is folded over the bytes by its table of 256 remainders."""
    table = "list_transform(range(256), lambda n: list_reduce(range(8), lambda c, k: CASE WHEN (c & 1) = 1 THEN xor(3988292384, (c >> 1)) ELSE (c >> 1) END, n))"
    one_byte = "lambda c, b: xor((c >> 8), t[(xor(c, b) & 255) + 1])"
    gain = f"floor(1000 * ln((t + 1)::DOUBLE * (ss + {resampling.BUCKETS})::DOUBLE / ((s + 1)::DOUBLE * (tt + {resampling.BUCKETS})::DOUBLE)))::BIGINT"
    return rf"""
WITH crc AS (SELECT {table} AS t),
texts AS (SELECT row_number() OVER () AS r, doc_id, true AS own, coalesce(text, '') AS x FROM documents UNION ALL SELECT NULL, NULL, false, coalesce(text, '') FROM benchmark),
split AS (SELECT r, own, list_filter(regexp_split_to_array(translate(x, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda w: w <> '') AS w FROM texts),
placed AS (SELECT r, own, w, unnest(range(1, len(w) + 1)) AS i FROM split),
features AS (SELECT r, own, unnest(list_filter([w[i], w[i] || ' ' || w[i + 1], w[i] || ' ' || w[i + 1] || ' ' || w[i + 2]], lambda f: f IS NOT NULL)) AS f FROM placed),
counted AS (SELECT r, own, f, count(*) AS n FROM features GROUP BY ALL),
coded AS (SELECT f, xor(list_reduce(list_transform(range(octet_length(encode(f))), lambda k: ('0x' || substr(hex(encode(f)), 2 * k + 1, 2))::BIGINT), {one_byte}, 4294967295), 4294967295) % {resampling.BUCKETS} AS b
  FROM (SELECT DISTINCT f FROM counted), crc),
bucketed AS (SELECT r, own, b, n FROM counted JOIN coded USING (f)),
sums AS (SELECT b, coalesce(sum(n) FILTER (own), 0) AS s, coalesce(sum(n) FILTER (NOT own), 0) AS t FROM bucketed GROUP BY b),
gains AS (SELECT b, {gain} AS gain FROM (SELECT *, (SELECT sum(s) FROM sums) AS ss, (SELECT sum(t) FROM sums) AS tt FROM sums)),
weights AS (SELECT r, sum(n)::BIGINT AS n_features, sum(n * gain)::BIGINT AS weight FROM bucketed JOIN gains USING (b) WHERE own GROUP BY r),
scored AS (
  SELECT doc_id, len(w) >= {resampling.MIN_WORDS} AS fit, coalesce(n_features, 0) AS n_features, coalesce(weight, 0) AS weight,
    coalesce(weight, 0) + floor(-1000 * ln(-ln(({UNSIGNED.format(1)} + 0.5::DOUBLE) / 4294967296)))::BIGINT AS score
  FROM (SELECT r, doc_id, sha256('42:' || coalesce(doc_id::VARCHAR, '')) AS hex FROM texts WHERE own) JOIN split USING (r) LEFT JOIN weights USING (r)),
ordered AS (SELECT *, row_number() OVER (PARTITION BY fit ORDER BY score DESC, doc_id NULLS LAST) AS k, count(*) FILTER (fit) OVER () AS total FROM scored)
SELECT doc_id, n_features, weight, score, CASE WHEN fit AND k <= {resampling.PER_CENT} * total // 100 THEN k END AS rank FROM ordered"""


def fill_in_middle_sql() -> str:
    p, s, m = (f"'{x}'" for x in (fill_in_middle.PREFIX, fill_in_middle.SUFFIX, fill_in_middle.MIDDLE))
    part = lambda a, b: f"array_to_string(u[{a}:{b}], '')"
    return rf"""
WITH hashed AS (SELECT doc_id, coalesce(text, '') AS x, sha256('42:' || coalesce(doc_id::VARCHAR, '')) AS hex FROM documents),
cut AS (SELECT doc_id, x, {", ".join(f"{UNSIGNED.format(8 * k + 1)} AS h{k + 1}" for k in range(4))}, regexp_extract_all(x, '[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+') AS u FROM hashed),
placed AS (SELECT *, least(h1 % (len(u) + 1), h2 % (len(u) + 1)) AS a, greatest(h1 % (len(u) + 1), h2 % (len(u) + 1)) AS b,
  CASE WHEN x = '' OR contains(x, {p}) OR contains(x, {s}) OR contains(x, {m}) OR h3 % 100 >= {fill_in_middle.RATE} THEN 'plain' WHEN h4 % 100 < {fill_in_middle.SPM_RATE} THEN 'spm' ELSE 'psm' END AS form FROM cut),
parts AS (SELECT *, {part("1", "a")} AS prefix, {part("a + 1", "b")} AS middle, {part("b + 1", "len(u)")} AS suffix FROM placed)
SELECT doc_id, len(u) AS n, form, CASE WHEN form <> 'plain' THEN length(prefix) END AS prefix_chars, CASE WHEN form <> 'plain' THEN length(middle) END AS middle_chars,
  sha256(CASE form WHEN 'plain' THEN x WHEN 'psm' THEN {p} || prefix || {s} || suffix || {m} || middle ELSE {s} || suffix || {p} || prefix || {m} || middle END) AS output_sha256,
  sha256(x) AS restored_sha256 FROM parts"""


ORACLES = {"op3_quality": quality_sql(), "op4_substring_dedup": OP4, "op9_warc": OP9, "op11_resampling": resampling_sql(), "op13_fill_in_middle": fill_in_middle_sql()}
