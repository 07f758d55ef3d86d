"""Queries over texts: normal forms, words, sentences, readability, scripts, cells and identifiers."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import text as T
from ..functions.constants import STOP_WORDS
from ..operators import readability as R
from ..sources import pages as P
from ..operators import rewriting as W
from ..sources.shared import by_document
from .literals import ABBREVIATED, IRREGULAR, SCRIPT_BLOCKS, STOPS_SQL
from .registry import documents, query, table

S = r"[ \t\n\r\f]"
WORDS_SQL = r"regexp_extract_all(c, '\b[A-Za-z0-9](?:[A-Za-z0-9''-]*[A-Za-z0-9])?\b')"
TRIMMED = r"trim(coalesce(text, ''))"


def lines_of(spark, sf_dir):
    """(doc_id, line_no, line): trimmed non-blank lines of all documents."""
    docs = table(spark, sf_dir, "documents")
    lines = docs.select("doc_id", F.posexplode(F.filter(F.transform(F.split("text", "\n"), lambda x: F.trim(x)), lambda x: x != "")).alias("line_no", "line"))
    return lines.withColumn("line_no", (F.col("line_no") + 1).cast("long"))


LINES_SQL = """lines AS (
  SELECT doc_id, unnest(l) AS line, CAST(unnest(range(1, len(l) + 1)) AS BIGINT) AS line_no
  FROM (SELECT doc_id, list_filter(list_transform(string_split(text, chr(10)), lambda x: trim(x)), lambda x: x <> '') AS l FROM documents)
)"""


@query("scan_doc_pages", """
WITH p AS (SELECT doc_id, list_filter(string_split(replace(text, chr(10), chr(12)), chr(12)), lambda x: x <> '') AS l FROM documents)
SELECT doc_id, unnest(l) AS page_text, CAST(unnest(range(1, len(l) + 1)) AS BIGINT) AS page_no FROM p
""")
def scan_doc_pages(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").withColumn("text", F.translate("text", "\n", "\f"))
    return P.scan_doc_pages(docs).select("doc_id", "page_no", F.col("text").alias("page_text"))


@query("text_normalize", rf"""
SELECT doc_id, n AS normalized, substring(n, 1, 80) AS excerpt FROM (SELECT doc_id, trim(regexp_replace(lower(text), '{S}+', ' ', 'g')) AS n FROM documents)
""")
def text_normalize(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", T.normalize(F.col("text")).alias("normalized")).withColumn("excerpt", F.substring("normalized", 1, 80))


@query("strip_control_chars", r"""
SELECT event_id, regexp_replace(props || chr(7) || event_type || chr(127), '[\x00-\x08\x0B\x0C\x0E-\x1F\x7F-\x{9F}]', '', 'g') AS clean FROM events
""")
def strip_control_chars(spark, sf_dir):
    raw = F.concat("props", F.lit("\x07"), "event_type", F.lit("\x7f"))
    return table(spark, sf_dir, "events").select("event_id", T.strip_control(raw).alias("clean"))


@query("clean_cell", rf"""
WITH {LINES_SQL}
SELECT doc_id, line_no, trim(regexp_replace(trim(regexp_replace(trim(regexp_replace('|~ ' || line || ' __', '[\r\n]+', ' ', 'g')), '^[|~_—]+|[|~_—]+$', '', 'g')), '\s+', ' ', 'g')) AS cell FROM lines
""")
def clean_cell(spark, sf_dir):
    return lines_of(spark, sf_dir).select("doc_id", "line_no", T.clean_cell(F.concat(F.lit("|~ "), "line", F.lit(" __"))).alias("cell"))


@query("infer_cell_type", r"""
WITH cells AS (
  SELECT event_id, unnest([CAST(event_id AS VARCHAR), event_type, CASE WHEN event_id % 3 = 0 THEN '$' || CAST(event_id AS VARCHAR) ELSE strftime(ts, '%Y-%m-%d') END, '0' || CAST(user_id AS VARCHAR)]) AS v, unnest([0, 1, 2, 3]) AS k FROM events
)
SELECT event_id, k, v, CASE
  WHEN regexp_matches(v, '^[$€£₹¥]\s*-?[\d,]+(\.\d+)?$|^-?[\d,]+(\.\d+)?\s*[$€£₹¥]$') THEN 'currency'
  WHEN regexp_matches(v, '^\d{1,2}[/.-]\d{1,2}[/.-]\d{2,4}$|^\d{4}[/-]\d{1,2}[/-]\d{1,2}$') THEN 'date'
  WHEN regexp_matches(v, '^0\d+$') THEN 'text'
  WHEN regexp_matches(v, '^-?(\d+|\d{1,3}(,\d{3})+)(\.\d+)?%?$') THEN 'number' ELSE 'text' END AS kind
FROM cells
""")
def infer_cell_type(spark, sf_dir):
    e = table(spark, sf_dir, "events")
    third = F.when(F.col("event_id") % 3 == 0, F.concat(F.lit("$"), F.col("event_id").cast("string"))).otherwise(F.date_format("ts", "yyyy-MM-dd"))
    cells = e.select("event_id", F.posexplode(F.array(F.col("event_id").cast("string"), F.col("event_type"), third, F.concat(F.lit("0"), F.col("user_id").cast("string")))).alias("k", "v"))
    return cells.withColumn("kind", P.cell_type(F.col("v")))


@query("mask_sensitive", """
SELECT c_custkey, CASE WHEN length(c_name) <= 4 THEN '••••' ELSE c_name[1:1] || repeat('•', CAST(least(10, greatest(4, length(c_name) - 2)) AS BIGINT)) || right(c_name, 1) END AS masked,
  CASE WHEN length(c_mktsegment[1:4]) <= 4 THEN '••••' END AS short_masked FROM customer
""")
def mask_sensitive(spark, sf_dir):
    c = table(spark, sf_dir, "customer")
    return c.select("c_custkey", T.mask_sensitive(F.col("c_name")).alias("masked"), T.mask_sensitive(F.substring("c_mktsegment", 1, 4)).alias("short_masked"))


@query("luhn_valid", r"""
WITH d AS (SELECT o_orderkey, lpad(CAST(o_orderkey * 7919 + 4000000000000 AS VARCHAR), 16, '4') AS digits FROM orders),
s AS (SELECT o_orderkey, digits, list_sum(list_transform(range(1, len(digits) + 1), lambda i: CASE WHEN (len(digits) - i) % 2 = 0 THEN CAST(digits[i] AS INT) ELSE CAST(digits[i] AS INT) * 2 - CASE WHEN CAST(digits[i] AS INT) > 4 THEN 9 ELSE 0 END END)) AS total FROM d)
SELECT o_orderkey, digits, len(digits) BETWEEN 13 AND 19 AND total % 10 = 0 AS valid FROM s
""")
def luhn_valid(spark, sf_dir):
    o = table(spark, sf_dir, "orders").select("o_orderkey", F.lpad((F.col("o_orderkey").cast("long") * 7919 + 4000000000000).cast("string"), 16, "4").alias("digits"))
    return o.withColumn("valid", T.luhn_valid(F.col("digits")))


@query("id_number_valid", r"""
WITH v AS (SELECT o_orderkey, CAST(o_orderkey * 104729 + 198765432101 AS VARCHAR) AS nat, upper(substring(md5(CAST(o_orderkey AS VARCHAR)), 1, 5)) || '1234' || 'F' AS tax FROM orders)
SELECT o_orderkey, regexp_full_match(nat, '[2-9]\d{11}') AS national_valid, regexp_full_match(tax, '[A-Z]{5}\d{4}[A-Z]') AS tax_valid FROM v
""")
def id_number_valid(spark, sf_dir):
    key = F.col("o_orderkey").cast("long")
    v = table(spark, sf_dir, "orders").select("o_orderkey", (key * 104729 + 198765432101).cast("string").alias("nat"), F.concat(F.upper(F.substring(F.md5(key.cast("string")), 1, 5)), F.lit("1234F")).alias("tax"))
    return v.select("o_orderkey", F.col("nat").rlike(r"^[2-9]\d{11}$").alias("national_valid"), F.col("tax").rlike(r"^[A-Z]{5}\d{4}[A-Z]$").alias("tax_valid"))


@query("ean13_check", r"""
WITH v AS (SELECT p_partkey, lpad(CAST(p_partkey * 1299709 AS VARCHAR), 12, '0') AS code FROM part),
c AS (SELECT p_partkey, code, CAST((10 - list_sum(list_transform(range(1, 13), lambda i: CAST(code[i] AS INT) * CASE WHEN i % 2 = 1 THEN 1 ELSE 3 END)) % 10) % 10 AS BIGINT) AS digit FROM v)
SELECT p_partkey, code || CAST(digit AS VARCHAR) AS full_code, digit = CAST(code[12] AS INT) AS repeats_last FROM c
""")
def ean13_check(spark, sf_dir):
    v = table(spark, sf_dir, "part").select("p_partkey", F.lpad((F.col("p_partkey").cast("long") * 1299709).cast("string"), 12, "0").alias("code"))
    digit = T.ean13_check(F.col("code"))
    return v.select("p_partkey", F.concat("code", digit.cast("string")).alias("full_code"), (digit == F.substring("code", 12, 1).cast("int")).alias("repeats_last"))


_COUNTS = ", ".join(f"len(regexp_extract_all(s, '{SCRIPT_BLOCKS[n]}')) AS {n}" for n in SCRIPT_BLOCKS)
_TOTAL = " + ".join(SCRIPT_BLOCKS)
_TOP = "CASE " + " ".join(f"WHEN {n} = greatest({', '.join(SCRIPT_BLOCKS)}) THEN '{n}'" for n in SCRIPT_BLOCKS) + " END"


@query("script_distribution", rf"""
WITH c AS (SELECT doc_id, {_COUNTS} FROM (SELECT doc_id, text AS s FROM documents)),
t AS (SELECT *, {_TOTAL} AS total, greatest({', '.join(SCRIPT_BLOCKS)}) AS top FROM c)
SELECT doc_id, CASE WHEN total = 0 THEN 'unknown' ELSE {_TOP} END AS script, CAST(total AS BIGINT) AS script_chars,
  CAST(CASE WHEN total = 0 THEN 0 ELSE floor(latin * 100.0::DOUBLE / total + 0.5) END AS BIGINT) AS latin_percent,
  CAST(CASE WHEN total = 0 THEN 0 ELSE least(99, floor(top::DOUBLE / total * 100 * least(1.0::DOUBLE, total::DOUBLE / 15) + 0.5)) END AS BIGINT) AS confidence FROM t
""")
def script_distribution(spark, sf_dir):
    return P.script_distribution(table(spark, sf_dir, "documents")).select("doc_id", "script", "script_chars", "latin_percent", "confidence")


@query("script_label", r"""
SELECT event_id, CASE WHEN regexp_matches(t, '[\x{0900}-\x{097F}]') THEN 'devanagari' WHEN regexp_matches(t, '[\x{0980}-\x{09FF}]') THEN 'bengali'
  WHEN regexp_matches(t, '[\x{0A00}-\x{0A7F}]') THEN 'gurmukhi' ELSE 'latin' END AS label
FROM (SELECT event_id, event_type || chr(CAST(CASE event_id % 4 WHEN 0 THEN 2309 WHEN 1 THEN 2437 WHEN 2 THEN 2565 ELSE 97 END AS INT)) AS t FROM events)
""")
def script_label(spark, sf_dir):
    letter = F.element_at(F.array(*map(F.lit, "अঅਅa")), (F.col("event_id") % 4 + 1).cast("int"))
    return table(spark, sf_dir, "events").select("event_id", P.script_label(F.concat("event_type", letter)).alias("label"))


_CLEAN = "regexp_replace(lower({0}), '[^a-z]', '', 'g')"
_TABLE = "CASE {c} " + " ".join(f"WHEN '{k}' THEN {v}" for k, v in IRREGULAR.items()) + " ELSE greatest(1, len(regexp_extract_all(regexp_replace({c}, '(?:tion|sion|cial|tial|cious|tious)', 'xun', 'g'), '[aeiouy]+')) - CAST(regexp_matches({c}, 'e$') AND NOT regexp_matches({c}, '(?:ee|oe)$') AND (NOT regexp_matches({c}, 'le$') OR regexp_matches({c}, '[aeiouy]le$')) AS INT) - CAST(regexp_matches({c}, '[^td]ed$') AS INT) - CAST(regexp_matches({c}, '[^szxc]es$') AND NOT regexp_matches({c}, 'shes$') AS INT)) END"


def syllables_sql(word: str) -> str:
    c = _CLEAN.format(word)
    return f"CASE WHEN length({c}) = 0 THEN 0 WHEN length({c}) <= 3 THEN 1 ELSE {_TABLE.format(c=c)} END"


@query("syllable_count", rf"""
WITH w AS (SELECT DISTINCT unnest({WORDS_SQL}) AS word FROM (SELECT coalesce(text, '') AS c FROM documents))
SELECT word, CAST({syllables_sql("word")} AS BIGINT) AS syllables FROM w
""")
def syllable_count(spark, sf_dir):
    """Distinct words first: the rules run once a word, whatever its frequency."""
    w = table(spark, sf_dir, "documents").select(F.explode(T.words(F.coalesce("text", F.lit("")))).alias("word")).distinct()
    return w.withColumn("syllables", T.syllables(F.col("word"), plain=True).cast("long"))


SENTENCES_SQL = rf"list_filter(list_transform(string_split(regexp_replace(regexp_replace(regexp_replace(regexp_replace(c, '(?i)\b({ABBREVIATED})\.', '\1_DOT_', 'g'), '\b([A-Z])\.', '\1_DOT_', 'g'), '([.!?]){S}+', '\1' || chr(1), 'g'), '\n+', chr(1), 'g'), chr(1)), lambda p: trim(replace(p, '_DOT_', '.'))), lambda p: regexp_matches(p, '[A-Za-z0-9]'))"


@query("sentence_split", f"""
WITH s AS (SELECT doc_id, {SENTENCES_SQL} AS l FROM (SELECT doc_id, {TRIMMED} AS c FROM documents))
SELECT doc_id, unnest(l) AS sentence, CAST(unnest(range(1, len(l) + 1)) AS BIGINT) AS sentence_no FROM s
""")
def sentence_split(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    s = docs.select("doc_id", F.posexplode(T.sentences(F.trim(F.coalesce("text", F.lit(""))))).alias("k", "sentence"))
    return s.select("doc_id", "sentence", (F.col("k") + 1).cast("long").alias("sentence_no"))


SUMMARY_SQL = rf"list_filter(list_transform(string_split(regexp_replace(regexp_replace(text, '{S}+', ' ', 'g'), '([.!?])\s+([A-Z0-9\x{{0900}}-\x{{097F}}\x{{0980}}-\x{{09FF}}\x{{0A00}}-\x{{0A7F}}])', '\1' || chr(1) || '\2', 'g'), chr(1)), lambda p: trim(p)), lambda p: length(p) > 25 AND len(regexp_split_to_array(p, ' +')) >= 5)"


@query("sentence_split_summary", f"""
SELECT doc_id, CAST(len(l) AS BIGINT) AS n, l[1] AS first_sentence, l[len(l)] AS last_sentence FROM (SELECT doc_id, {SUMMARY_SQL} AS l FROM documents)
""")
def sentence_split_summary(spark, sf_dir):
    l = F.col("l")
    return table(spark, sf_dir, "documents").select("doc_id", T.summary_sentences(F.col("text")).alias("l")).select("doc_id", F.size(l).cast("long").alias("n"), F.try_element_at(l, F.lit(1)).alias("first_sentence"), F.try_element_at(l, F.lit(-1)).alias("last_sentence"))


@query("tokenize_search", f"""
WITH t AS (SELECT doc_id, list_filter(regexp_split_to_array(lower(text), '[^a-z0-9\\x{{0900}}-\\x{{097F}}\\x{{0980}}-\\x{{09FF}}\\x{{0A00}}-\\x{{0A7F}}]+'), lambda x: length(x) > 1 AND x NOT IN {STOPS_SQL}) AS l FROM documents)
SELECT doc_id, unnest(l) AS term, CAST(unnest(range(1, len(l) + 1)) AS BIGINT) AS pos FROM t
""")
def tokenize_search(spark, sf_dir):
    return P.search_tokens(table(spark, sf_dir, "documents"))


@query("tokenize_diff", rf"""
SELECT conv_id, turn, CAST(len(l) AS BIGINT) AS n, l[1] AS first_token, l[len(l)] AS last_token FROM (SELECT conv_id, turn, list_filter(regexp_split_to_array(text, '{S}+'), lambda x: x <> '') AS l FROM conversations)
""")
def tokenize_diff(spark, sf_dir):
    w = F.col("w")
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", T.spaced_words(F.col("text")).alias("w")).select("conv_id", "turn", F.size(w).cast("long").alias("n"), F.try_element_at(w, F.lit(1)).alias("first_token"), F.try_element_at(w, F.lit(-1)).alias("last_token"))


HEADING_SQL = rf"""(len(w) > 0 AND len(w) <= 12 AND NOT (line LIKE '%.' AND len(w) > 6) AND (
  regexp_matches(line, '(?i)^(\d+(\.\d+)*|[A-Z]\.|\b(Section|Chapter|Part|Article|Clause)\b)')
  OR (line = upper(line) AND len(w) <= 8 AND regexp_matches(line, '[A-Z]'))
  OR (len(list_filter(w, lambda x: NOT (regexp_matches(x, '^[A-Z]') OR lower(x) IN {STOPS_SQL}))) = 0 AND len(w) <= 6 AND length(line) < 50)))"""
LINE_WORDS = rf"list_filter(regexp_split_to_array(line, '{S}+'), lambda x: x <> '') AS w"


@query("heading_flag", f"""
WITH {LINES_SQL} SELECT doc_id, line_no, {HEADING_SQL} AS heading FROM (SELECT *, {LINE_WORDS} FROM lines)
""")
def heading_flag(spark, sf_dir):
    return lines_of(spark, sf_dir).select("doc_id", "line_no", T.is_heading(F.col("line")).alias("heading"))


_SECTIONS = r"""marked AS (SELECT doc_id, text AS t, CASE doc_id % 3 WHEN 0 THEN 'intro' || chr(10) || '# One' || chr(10) || text || chr(10) || '## Two' || chr(10) || '### Three' || chr(10) || 'end #4' WHEN 1 THEN text || chr(12) || 'second' ELSE coalesce(text, '') END AS m FROM documents),
parts AS (SELECT doc_id, m, list_filter(string_split(m, chr(12)), lambda x: x <> '') AS pages, list_filter(string_split(regexp_replace('# Introduction' || chr(10) || m, '(?m)^#{1,3}[ \t]+', chr(1), 'g'), chr(1)), lambda x: x <> '') AS h FROM marked),
heads AS (SELECT doc_id, m, pages, list_filter(list_transform(h, lambda x: {'title': trim(regexp_extract(x, '^([^\n]*)', 1)), 'content': trim(regexp_replace(x, '^[^\n]*\n?', ''), chr(10) || chr(13) || chr(9) || ' ')}), lambda s: s.content <> '') AS h FROM parts),
listed AS (SELECT doc_id, CASE WHEN contains(m, chr(12)) THEN list_transform(range(1, len(pages) + 1), lambda i: {'title': 'Page ' || i, 'content': trim(pages[i], chr(10) || chr(13) || chr(9) || ' ')}) WHEN len(h) > 1 THEN h ELSE [{'title': 'Full Document', 'content': trim(m, chr(10) || chr(13) || chr(9) || ' ')}] END AS l FROM heads),
sections AS (SELECT doc_id, unnest(range(1, len(l) + 1)) AS section, unnest(l) AS s FROM listed)"""


@query("section_split", f"WITH {_SECTIONS} SELECT doc_id, CAST(section AS BIGINT) AS section, s.title AS title, s.content AS content FROM sections")
def section_split(spark, sf_dir):
    return P.section_split(marked_documents(spark, sf_dir))


def marked_documents(spark, sf_dir):
    """Documents of three kinds: with headings, with a form feed, as they are."""
    k, n = F.col("doc_id") % 3, F.lit("\n")
    headed = F.concat(F.lit("intro\n# One\n"), "text", n, F.lit("## Two\n### Three\nend #4"))
    text = F.when(k == 0, headed).when(k == 1, F.concat("text", F.lit("\fsecond"))).otherwise(F.coalesce("text", F.lit("")))
    return documents(spark, sf_dir).select("doc_id", text.alias("text"))


@query("heading_sections", f"""
WITH {LINES_SQL}, h AS (SELECT doc_id, line_no, line, {HEADING_SQL} AS heading FROM (SELECT *, {LINE_WORDS} FROM lines)),
g AS (SELECT *, sum(CAST(heading AS INT)) OVER (PARTITION BY doc_id ORDER BY line_no) AS section FROM h)
SELECT doc_id, CAST(section AS BIGINT) AS section, coalesce(max(line) FILTER (heading), 'Introduction') AS title, count(*) FILTER (NOT heading) AS n_lines,
  coalesce(string_agg(line, ' ' ORDER BY line_no) FILTER (NOT heading), '') AS content FROM g GROUP BY doc_id, section
""")
def heading_sections(spark, sf_dir):
    return P.heading_sections(lines_of(spark, sf_dir))


@query("find_literal", r"""
WITH h AS (SELECT doc_id, string_split(text, 'tion') AS s FROM documents), k AS (SELECT doc_id, s, unnest(range(1, len(s))) AS k FROM h)
SELECT doc_id, CAST(k AS BIGINT) AS hit, CAST(list_sum(list_transform(s[1:k], lambda x: length(x))) + (k - 1) * 4 AS BIGINT) AS "at", 'tion' AS found FROM k
""")
def find_literal(spark, sf_dir):
    return P.find_literal(documents(spark, sf_dir), "tion", case_sensitive=True)


@query("find_count", r"""
SELECT doc_id, CAST(len(regexp_extract_all(text, '(?i)\bthe\b')) AS BIGINT) AS whole_word_hits, CAST(len(string_split(lower(text), 'tion')) - 1 AS BIGINT) AS substring_hits FROM documents
""")
def find_count(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    return docs.select("doc_id", P.find_count(F.col("text"), "the", whole_word=True).alias("whole_word_hits"), P.find_count(F.col("text"), "tion").alias("substring_hits"))


@query("find_snippets", """
WITH p AS (SELECT doc_id, text, string_split(lower(text), ' the ') AS parts FROM documents WHERE contains(lower(text), ' the ')),
h AS (SELECT doc_id, text, unnest(range(1, len(parts))) AS k, parts FROM p),
o AS (SELECT doc_id, text, k, CAST(list_sum(list_transform(parts[1:k], lambda x: length(x))) + (k - 1) * 5 AS BIGINT) AS "at" FROM h)
SELECT doc_id, CAST(k AS BIGINT) AS match_index, "at", substring(text, greatest(1, "at" - 39), CAST(least("at", 40) + 5 + 40 AS BIGINT)) AS snippet FROM o
""")
def find_snippets(spark, sf_dir):
    return P.find_snippets(table(spark, sf_dir, "documents"), " the ")


@query("replace_terms", r"""
SELECT doc_id, regexp_replace(regexp_replace(replace(replace(text, 'tion', 'TION'), '(a+)', '[a]'), '\bthe\b', 'THE', 'g'), '\band\b', '&', 'g') AS replaced,
  regexp_replace(regexp_replace(regexp_replace(text, '\bOF\b', 'FROM', 'g'), '\bOf\b', 'From', 'g'), '\b(of|oF)\b', 'from', 'g') AS cased FROM documents
""")
def replace_terms(spark, sf_dir):
    """Rules in order; one is a pattern that the dictionary's guard turns into a literal."""
    rules = W.checked_rules([("literal", "tion", "TION"), ("regex", "(a+)", "[a]"), ("word", "the", "THE"), ("word", "and", "&"), ("word", "of", "of")])
    return table(spark, sf_dir, "documents").select("doc_id", P.replace_terms(F.col("text"), rules).alias("replaced"), P.replace_terms(F.col("text"), [("cased_word", "of", "from")]).alias("cased"))


@query("glossary_translate", r"""
SELECT doc_id, t AS translated, CASE WHEN length(text) > 0 THEN floor(length(t)::DOUBLE / length(text) * 100 + 0.5) / 100 END AS expansion,
  regexp_replace(regexp_replace(regexp_replace(regexp_replace(text, '(?i)\bof the\b', 'vom', 'g'), '(?i)\bthe\b', 'der $1', 'g'), '(?i)\band\b', 'und\\1', 'g'), '(?i)\bof\b', 'von', 'g') AS phrases FROM (
  SELECT doc_id, text, regexp_replace(regexp_replace(regexp_replace(text, '(?i)\bthe\b', 'le', 'g'), '(?i)\band\b', '$1 et\\2', 'g'), '(?i)\bof\b', 'de', 'g') AS t FROM documents)
""")
def glossary_translate(spark, sf_dir):
    """A lexicon in order, each entry on what the one before left, and phrases of a table, the longest first."""
    lexicon = [("the", "le"), ("and", "$1 et\\2"), ("of", "de")]
    docs = table(spark, sf_dir, "documents").withColumn("translated", P.glossary(F.col("text"), lexicon))
    docs = docs.select("doc_id", "translated", F.when(F.length("text") > 0, T.rounded(F.length("translated") / F.length("text"), 2)).alias("expansion"), F.col("text").alias("phrases"))
    entries = spark.createDataFrame([("the", "der $1"), ("Of the", "vom"), ("of", "von"), ("and", "und\\1")], "find string, to string")
    return W.rewrite(docs, entries, "phrases")


@query("spelling_variants", r"""
WITH w AS (SELECT DISTINCT unnest(list_filter(regexp_split_to_array(text, '[^A-Za-z0-9]+'), lambda x: length(x) > 2)) AS word FROM documents),
v AS (SELECT word, list_filter([replace(word, '0', 'O'), replace(word, '1', 'l'), replace(word, 'rn', 'm'), replace(word, 'cl', 'd'), replace(word, 'vv', 'w'), replace(word, '5', 'S'), replace(word, '8', 'B'), replace(word, 'O', '0'), replace(word, 'l', '1'), replace(word, 'm', 'rn'), upper(word[1:1]) || lower(word[2:])], lambda x: x <> word) AS c FROM w)
SELECT word, list_transform(list_filter(list_transform(range(1, len(c) + 1), lambda i: CASE WHEN list_position(c, c[i]) = i THEN c[i] END), lambda x: x IS NOT NULL)[1:5], lambda x: x) AS variants FROM v
""")
def spelling_variants(spark, sf_dir):
    w = table(spark, sf_dir, "documents").select(F.explode(F.filter(F.split("text", "[^A-Za-z0-9]+"), lambda x: F.length(x) > 2)).alias("word")).distinct()
    return w.select("word", P.spelling_variants(F.col("word")).alias("variants"))


_STATS_SQL = rf"""stats AS (
  SELECT doc_id, len(y) AS words, length(c) AS chars, length(regexp_replace(c, '\s+', '', 'g')) AS chars_no_space,
    CASE WHEN len(y) > 0 THEN greatest(1, sn) ELSE 0 END AS sentences, CASE WHEN len(y) > 0 THEN list_sum(y) ELSE 0 END AS syllables, len(list_filter(y, lambda x: x >= 3)) AS complex_words
  FROM (SELECT doc_id, c, list_transform({WORDS_SQL}, lambda q: {syllables_sql("q")}) AS y, len({SENTENCES_SQL}) AS sn
        FROM (SELECT doc_id, {TRIMMED} AS c FROM documents))
)"""


def stats_of(spark, sf_dir):
    return R.doc_statistics(documents(spark, sf_dir).select("doc_id", "text")).drop("text")


@query("doc_statistics", f"""
WITH {_STATS_SQL} SELECT doc_id, CAST(words AS BIGINT) AS words, CAST(chars AS BIGINT) AS chars, CAST(chars_no_space AS BIGINT) AS chars_no_space, CAST(sentences AS BIGINT) AS sentences, CAST(syllables AS BIGINT) AS syllables, CAST(complex_words AS BIGINT) AS complex_words,
  CASE WHEN words > 0 THEN floor(words::DOUBLE / greatest(1, sentences) * 10 + 0.5) / 10 ELSE 0.0::DOUBLE END AS words_per_sentence, CASE WHEN words > 0 THEN floor(syllables::DOUBLE / words * 100 + 0.5) / 100 ELSE 0.0::DOUBLE END AS syllables_per_word FROM stats
""")
def doc_statistics(spark, sf_dir):
    return stats_of(spark, sf_dir)


_SCORES_SQL = f"""{_STATS_SQL}, scores AS (
  SELECT doc_id, CASE WHEN words = 0 THEN 100.0::DOUBLE ELSE floor((206.835::DOUBLE - 1.015::DOUBLE * (words::DOUBLE / greatest(1, sentences)) - 84.6::DOUBLE * (syllables::DOUBLE / words)) * 10 + 0.5) / 10 END AS reading_ease,
    CASE WHEN words = 0 THEN 0.0::DOUBLE ELSE greatest(0.0::DOUBLE, floor((0.39::DOUBLE * (words::DOUBLE / greatest(1, sentences)) + 11.8::DOUBLE * (syllables::DOUBLE / words) - 15.59::DOUBLE) * 10 + 0.5) / 10) END AS grade_level,
    CASE WHEN words = 0 THEN 0.0::DOUBLE ELSE greatest(0.0::DOUBLE, floor(0.4::DOUBLE * (words::DOUBLE / greatest(1, sentences) + 100 * (complex_words::DOUBLE / words)) * 10 + 0.5) / 10) END AS fog_index FROM stats)"""
_BAND = "CASE WHEN reading_ease >= 80 THEN 'easy' WHEN reading_ease >= 60 OR grade_level BETWEEN 7 AND 10 THEN 'moderate' ELSE 'dense' END"


@query("readability_scores", f"WITH {_SCORES_SQL} SELECT doc_id, reading_ease, grade_level, fog_index, {_BAND} AS band FROM scores")
def readability_scores(spark, sf_dir):
    return R.readability_scores(stats_of(spark, sf_dir)).select("doc_id", "reading_ease", "grade_level", "fog_index", "band")


@query("complexity_band", f"WITH {_SCORES_SQL} SELECT lang, {_BAND} AS band, count(*) AS n FROM scores JOIN documents USING (doc_id) GROUP BY lang, {_BAND}")
def complexity_band(spark, sf_dir):
    docs = R.readability_scores(R.doc_statistics(documents(spark, sf_dir).select("lang", "text")))
    return docs.groupBy("lang", "band").agg(F.count("*").alias("n"))


@query("reading_times", rf"""
SELECT doc_id, floor(n / 200.0::DOUBLE * 100 + 0.5) / 100 AS silent_minutes, CAST(floor(n / 200.0::DOUBLE * 60 + 0.5) AS BIGINT) AS silent_seconds, floor(n / 130.0::DOUBLE * 100 + 0.5) / 100 AS aloud_minutes, CAST(floor(n / 130.0::DOUBLE * 60 + 0.5) AS BIGINT) AS aloud_seconds
FROM (SELECT doc_id, len({WORDS_SQL}) AS n FROM (SELECT doc_id, {TRIMMED} AS c FROM documents))
""")
def reading_times(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", F.size(T.words(F.trim(F.coalesce("text", F.lit(""))))).alias("words"))
    return R.reading_times(docs).drop("words")


@query("doc_profile", rf"""
WITH {LINES_SQL}, w AS (SELECT doc_id, sum(len(w)) AS n, count(*) FILTER (length(line) > 60) AS p FROM (SELECT doc_id, line, {LINE_WORDS} FROM lines) GROUP BY doc_id)
SELECT d.doc_id, CAST(coalesce(n, 0) AS BIGINT) AS word_count, length(text) AS char_count, CAST(greatest(1, ceil(coalesce(n, 0) / 200.0::DOUBLE)) AS BIGINT) AS reading_minutes, coalesce(n, 0) >= 25 AS is_reliable, CAST(coalesce(p, 0) AS BIGINT) AS n_paragraphs FROM documents d LEFT JOIN w USING (doc_id)
""")
def doc_profile(spark, sf_dir):
    return R.doc_profile(table(spark, sf_dir, "documents").select("doc_id", "text")).drop("text")


@query("keywords_topk", rf"""
WITH w AS (SELECT doc_id, regexp_replace(lower(unnest(l)), '[^a-z0-9]', '', 'g') AS word, unnest(range(1, len(l) + 1)) AS pos, len(l) AS total FROM (SELECT doc_id, list_filter(regexp_split_to_array(text, '{S}+'), lambda x: x <> '') AS l FROM documents)),
c AS (SELECT doc_id, word, count(*) AS n, min(pos) AS first, max(total) AS total FROM w WHERE length(word) > 2 AND word NOT IN {STOPS_SQL} GROUP BY doc_id, word),
r AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY n DESC, first) AS rank FROM c)
SELECT doc_id, word, n, CAST(least(100, floor(n::DOUBLE / greatest(1, total) * 1000 + 0.5)) AS BIGINT) AS score, rank FROM r WHERE rank <= 15
""")
def keywords_topk(spark, sf_dir):
    return P.keywords(documents(spark, sf_dir), 15)


@query("section_readability", f"""
WITH {_SECTIONS}, t AS (SELECT doc_id, CAST(section AS BIGINT) AS section, trim(s.content) AS c FROM sections)
SELECT doc_id, section, CAST(len({WORDS_SQL}) AS BIGINT) AS words, CAST(coalesce(list_sum(list_transform({WORDS_SQL}, lambda q: {syllables_sql("q")})), 0) AS BIGINT) AS syllables FROM t
""")
def section_readability(spark, sf_dir):
    s = P.section_split(marked_documents(spark, sf_dir)).select("doc_id", "section", F.col("content").alias("text"))
    return R.doc_statistics(s).select("doc_id", "section", "words", "syllables")


@query("sentence_split_clause", r"""
WITH p AS (SELECT doc_id, list_filter(list_transform(string_split(regexp_replace(text, '([.!?])\s+([A-Z0-9])', '\1' || chr(1) || '\2', 'g'), chr(1)), lambda x: trim(x)), lambda x: length(x) > 10) AS l FROM documents)
SELECT doc_id, CAST(len(l) AS BIGINT) AS n, l[1] AS first_sentence, l[len(l)] AS last_sentence FROM p
""")
def sentence_split_clause(spark, sf_dir):
    l = F.col("l")
    d = table(spark, sf_dir, "documents").select("doc_id", T.clause_sentences(F.col("text")).alias("l"))
    return d.select("doc_id", F.size(l).cast("long").alias("n"), F.try_element_at(l, F.lit(1)).alias("first_sentence"), F.try_element_at(l, F.lit(-1)).alias("last_sentence"))


@query("tokenize", rf"""
WITH w AS (SELECT doc_id, regexp_replace(lower(unnest(l)), '[^a-z0-9\x{{0900}}-\x{{097F}}\x{{0980}}-\x{{09FF}}\x{{0A00}}-\x{{0A7F}}]', '', 'g') AS word FROM (SELECT doc_id, list_filter(regexp_split_to_array(text, '{S}+'), lambda x: x <> '') AS l FROM documents))
SELECT doc_id, count(*) AS n, count(DISTINCT word) AS n_distinct, max(word) AS last_word FROM w WHERE length(word) > 2 AND word NOT IN {STOPS_SQL} GROUP BY doc_id
""")
def tokenize(spark, sf_dir):
    """The keyword variant: marks go inside words, words of over two characters that are no stop words."""
    w = by_document(table(spark, sf_dir, "documents").select("doc_id", "text")).select("doc_id", F.explode(T.spaced_words(F.col("text"))).alias("raw"))
    w = w.select("doc_id", F.regexp_replace(F.lower("raw"), r"[^a-z0-9\x{0900}-\x{097F}\x{0980}-\x{09FF}\x{0A00}-\x{0A7F}]", "").alias("word"))
    w = w.filter((F.length("word") > 2) & ~F.col("word").isin(STOP_WORDS))
    c = w.groupBy("doc_id", "word").agg(F.count("*").alias("n"))
    return c.groupBy("doc_id").agg(F.sum("n").alias("n"), F.count("*").alias("n_distinct"), F.max("word").alias("last_word"))
