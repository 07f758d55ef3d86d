"""Queries over the corpus: duplicates, retrieval, summaries, personal data, pages and drift."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import duplicates as D
from ..operators import search as Q
from ..operators import sensitive as P
from ..sources import pages as G
from ..sources.shared import by_document, scratch
from .literals import PRESET_PATTERNS, STOPS_SQL
from .registry import documents, query, table
from .text_queries import SUMMARY_SQL, S, marked_documents

NORM = f"trim(regexp_replace(lower(text), '{S}+', ' ', 'g'))"
DUPS = f"""k AS (SELECT doc_id, sha256({NORM}) AS h FROM documents WHERE {NORM} <> ''), g AS (SELECT h, min(doc_id) AS group_id, count(*) AS size FROM k GROUP BY h HAVING count(*) > 1), dups AS (SELECT doc_id, group_id, size, doc_id = group_id AS keep FROM k JOIN g USING (h))"""


@query("exact_dups", f"WITH {DUPS} SELECT * FROM dups")
def exact_dups(spark, sf_dir):
    return D.exact_dups(table(spark, sf_dir, "documents"), "doc_id")


@query("drop_duplicates_keep_first", f"WITH {DUPS} SELECT doc_id, source FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM dups WHERE NOT keep)")
def drop_duplicates_keep_first(spark, sf_dir):
    return D.drop_duplicates_keep_first(table(spark, sf_dir, "documents"), "doc_id").select("doc_id", "source")


@query("dup_report_totals", f"WITH {DUPS} SELECT source, sum(keep::INT)::BIGINT AS groups, count(*) AS members, (count(*) - sum(keep::INT))::BIGINT AS found, sum((NOT keep)::INT)::BIGINT AS to_remove FROM dups JOIN documents USING (doc_id) GROUP BY source")
def dup_report_totals(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    return D.dup_report_totals(D.exact_dups(docs, "doc_id").join(docs.select("doc_id", "source"), "doc_id"), [F.col("source")])


@query("select_flagged", "SELECT doc_id, source FROM documents WHERE doc_id IN (SELECT doc_id FROM labels WHERE toxic = 1)")
def select_flagged(spark, sf_dir):
    return table(spark, sf_dir, "documents").join(table(spark, sf_dir, "labels").filter("toxic = 1"), "doc_id", "left_semi").select("doc_id", "source")


_BITS = " + ".join(f"CASE WHEN embedding[{i + 1}] >= 0 THEN {1 << i}::HUGEINT ELSE 0 END" for i in range(64))
SIGNS = f"s AS (SELECT vec_id, label, {_BITS} AS h FROM embeddings)"


@query("near_dups", f"""WITH RECURSIVE {SIGNS}, e AS (SELECT a.vec_id AS a, b.vec_id AS b FROM s a JOIN s b ON a.vec_id <> b.vec_id AND bit_count(xor(a.h, b.h)) <= 4),
reach(v, r) AS (SELECT vec_id, vec_id FROM s UNION SELECT e.b, reach.r FROM reach JOIN e ON e.a = reach.v), c AS (SELECT v, min(r) AS g FROM reach GROUP BY v),
reps AS (SELECT h, min(vec_id) AS v FROM s GROUP BY h), p AS (SELECT x.v AS a, y.v AS b, bit_count(xor(x.h, y.h)) AS d FROM reps x JOIN reps y ON x.v < y.v AND bit_count(xor(x.h, y.h)) <= 4), m AS (SELECT g, CAST(floor(avg(d) + 0.5) AS BIGINT) AS distance FROM p JOIN c ON c.v = p.a GROUP BY g)
SELECT v AS vec_id, c.g AS group_id, count(*) OVER (PARTITION BY c.g) AS size, v = c.g AS keep, distance FROM c LEFT JOIN m ON m.g = c.g""")
def near_dups(spark, sf_dir):
    """Sign hashes of the embeddings within 4 bits."""
    h = table(spark, sf_dir, "embeddings").select("vec_id", D.sign_hash(F.col("embedding")).alias("h"))
    return D.near_dups(h, "vec_id", "h", 4)


@query("connected_components", """WITH RECURSIVE e AS (SELECT o_orderkey AS a, o_custkey + 1000000000000 AS b FROM orders),
u AS (SELECT a, b FROM e UNION SELECT b, a FROM e), reach(id, r) AS (SELECT a, a FROM u UNION SELECT u.b, reach.r FROM reach JOIN u ON u.a = reach.id) SELECT id, min(r) AS component FROM reach GROUP BY id""")
def connected_components(spark, sf_dir):
    e = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("a"), (F.col("o_custkey") + 1000000000000).alias("b"))
    ids = e.select(F.explode(F.array("a", "b")).alias("id")).distinct()
    return D.connected_components(ids, e)


@query("text_similarity", f"""WITH w AS (SELECT conv_id, turn, list_distinct(list_filter(regexp_split_to_array(lower(text), '{S}+'), lambda x: x <> '')) AS w FROM conversations)
SELECT a.conv_id, a.turn, CASE WHEN len(a.w) = 0 AND len(b.w) = 0 THEN 1.0::DOUBLE ELSE len(list_intersect(a.w, b.w))::DOUBLE / greatest(1, len(list_distinct(list_concat(a.w, b.w)))) END AS similarity, len(list_intersect(a.w, b.w))::BIGINT AS shared
FROM w a JOIN w b ON a.conv_id = b.conv_id AND b.turn = a.turn + 1""")
def text_similarity(spark, sf_dir):
    w = T.spaced_words(F.lower("text"))
    c = table(spark, sf_dir, "conversations").select("conv_id", "turn", F.array_distinct(w).alias("w"))
    n = c.select("conv_id", (F.col("turn") - 1).alias("turn"), F.col("w").alias("v"))
    return c.join(n, ["conv_id", "turn"]).select("conv_id", "turn", D.jaccard(F.col("w"), F.col("v")).alias("similarity"), F.size(F.array_intersect("w", "v")).cast("long").alias("shared"))


@query("set_intersection_size", f"""WITH w AS (SELECT DISTINCT conv_id, turn, unnest(list_filter(regexp_split_to_array(lower(text), '{S}+'), lambda x: x <> '')) AS w FROM conversations)
SELECT c.conv_id, c.turn, (SELECT count(*) FROM w a JOIN w b ON a.w = b.w WHERE a.conv_id = c.conv_id AND b.conv_id = c.conv_id AND a.turn = c.turn AND b.turn = c.turn + 1) AS shared FROM conversations c JOIN conversations n ON n.conv_id = c.conv_id AND n.turn = c.turn + 1""")
def set_intersection_size(spark, sf_dir):
    return text_similarity(spark, sf_dir).select("conv_id", "turn", "shared")


@query("set_diff_added_removed", f"""WITH w AS (SELECT DISTINCT conv_id, turn, unnest(list_filter(regexp_split_to_array(lower(text), '{S}+'), lambda x: x <> '')) AS w FROM conversations), c AS (SELECT DISTINCT conv_id, turn FROM conversations)
SELECT w.conv_id, w.turn - 1 AS turn, w, 'added' AS change FROM w JOIN c ON c.conv_id = w.conv_id AND c.turn = w.turn - 1 WHERE NOT EXISTS (SELECT 1 FROM w o WHERE o.conv_id = w.conv_id AND o.turn = w.turn - 1 AND o.w = w.w)
UNION ALL SELECT w.conv_id, w.turn, w, 'removed' FROM w JOIN c ON c.conv_id = w.conv_id AND c.turn = w.turn + 1 WHERE NOT EXISTS (SELECT 1 FROM w o WHERE o.conv_id = w.conv_id AND o.turn = w.turn + 1 AND o.w = w.w)""")
def set_diff_added_removed(spark, sf_dir):
    """Words that every turn adds to the one before, and leaves out of it."""
    c = table(spark, sf_dir, "conversations").select("conv_id", "turn", F.array_distinct(T.spaced_words(F.lower("text"))).alias("a"))
    n = c.select("conv_id", (F.col("turn") - 1).alias("turn"), F.col("a").alias("b"))
    return D.set_changes(c.join(n, ["conv_id", "turn"]), ["conv_id", "turn"], "a", "b").withColumnRenamed("value", "w")


@query("dedupe_first_seen", f"""WITH w AS (SELECT doc_id, lower(unnest(l)) AS w, unnest(l) AS seen_as, unnest(range(1, len(l) + 1)) AS p FROM (SELECT doc_id, list_filter(regexp_split_to_array(text, '{S}+'), lambda x: x <> '') AS l FROM documents))
SELECT doc_id, w, seen_as, CAST(p AS BIGINT) AS p FROM (SELECT *, row_number() OVER (PARTITION BY doc_id, w ORDER BY p) AS k FROM w) WHERE k = 1""")
def dedupe_first_seen(spark, sf_dir):
    w = by_document(table(spark, sf_dir, "documents").select("doc_id", "text")).select("doc_id", F.posexplode(T.spaced_words(F.col("text"))).alias("k", "seen_as"))
    return w.groupBy("doc_id", F.lower("seen_as").alias("w")).agg(F.min(F.struct("k", "seen_as")).alias("f")).select("doc_id", "w", "f.seen_as", (F.col("f.k") + 1).cast("long").alias("p"))


TERMS = "list_filter(regexp_split_to_array(lower(text), '[^a-z0-9\\x{0900}-\\x{097F}\\x{0980}-\\x{09FF}\\x{0A00}-\\x{0A7F}]+'), lambda x: length(x) > 1 AND x NOT IN " + STOPS_SQL + ")"


_BM25_SQL = f"""WITH t AS (SELECT doc_id, unnest({TERMS}) AS term FROM documents), q AS (SELECT item_id AS query_id, unnest({TERMS}) AS term FROM benchmark),
l AS (SELECT doc_id, len({TERMS}) AS len FROM documents), n AS (SELECT count(*) AS N, avg(len) AS avgdl FROM l),
f AS (SELECT doc_id, term, count(*) AS tf FROM t WHERE term IN (SELECT term FROM q) GROUP BY 1, 2), d AS (SELECT term, count(*) AS df FROM f GROUP BY term), w AS (SELECT query_id, term, count(*) AS times FROM q GROUP BY 1, 2),
s AS (SELECT query_id, doc_id, round(sum(times * ln(1 + (N - df + 0.5::DOUBLE) / (df + 0.5::DOUBLE)) * tf * 2.2::DOUBLE / (tf + 1.2::DOUBLE * (0.25::DOUBLE + 0.75::DOUBLE * len / avgdl))), 6) AS score FROM f JOIN l USING (doc_id) JOIN d USING (term) JOIN w USING (term), n GROUP BY 1, 2),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) AS rank, max(score) OVER (PARTITION BY query_id) AS top FROM s WHERE score > 0)
SELECT query_id, doc_id, score, rank, CAST(least(99, greatest(30, floor(score / top * 95 + 0.5))) AS BIGINT) AS confidence FROM r WHERE rank <= 3 AND top >= 0.15"""


@query("bm25_search", _BM25_SQL)
def bm25_search(spark, sf_dir):
    """Whole documents as units."""
    q = table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("query_id"), F.col("text").alias("query"))
    return Q.bm25(documents(spark, sf_dir).select("doc_id", "text"), q, ["doc_id"], "text")


@query("bm25_stored", _BM25_SQL)
def bm25_stored(spark, sf_dir):
    """The same search from postings that are written first; the search itself reads no text."""
    path = scratch(spark, "postings")
    Q.write_postings(documents(spark, sf_dir).select("doc_id", "text"), ["doc_id"], "text", path)
    q = table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("query_id"), F.col("text").alias("query"))
    return Q.search_postings(spark, path, q, ["doc_id"])


@query("bm25_chunks")
def bm25_chunks(spark, sf_dir):
    """Paragraphs as units, searched in documents with a language; tests hold it against a plain version."""
    q = table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("query_id"), F.col("text").alias("query"))
    units = Q.chunks(documents(spark, sf_dir), keep=("lang",))
    return Q.bm25(units, q, ["doc_id", "chunk_no"], "chunk", df_scope="loaded", enabled=F.col("lang").isNotNull())


QUESTIONS = {1: ["the", "tion", "onst", "ered"], 2: ["que", "ment", "les"], 3: ["der", "und", "ung", "heit", "zu"], 4: ["xyzzy", "ness"], 5: ["ción", "para", "los"]}


@query("passage_overlap_search", f"""WITH s AS (SELECT doc_id, {SUMMARY_SQL} AS l FROM documents), p AS (SELECT doc_id, unnest(range(1, len(l) + 1, 2)) AS k, l FROM s), x AS (SELECT doc_id, CAST((k + 1) // 2 AS BIGINT) AS passage_no, lower(array_to_string(l[k:k + 2], ' ')) AS t FROM p),
q AS ({' UNION ALL '.join(f"SELECT CAST({q} AS BIGINT) AS query_id, doc_id, passage_no, ({' + '.join(f'contains(t, {chr(39)}{w}{chr(39)})::INT' for w in ws)})::DOUBLE / {len(ws)} AS score FROM x WHERE length(t) > 20" for q, ws in QUESTIONS.items())})
SELECT query_id, score, doc_id, passage_no, rank FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id, passage_no) AS rank FROM q WHERE score > 0.2) WHERE rank <= 3""")
def passage_overlap_search(spark, sf_dir):
    asked = spark.createDataFrame([(q, w) for q, ws in QUESTIONS.items() for w in ws], "query_id long, term string")
    return Q.passage_overlap(table(spark, sf_dir, "documents"), asked)


_KEYS = f"""w AS (SELECT doc_id, regexp_replace(lower(unnest(l)), '[^a-z0-9]', '', 'g') AS word, unnest(range(1, len(l) + 1)) AS pos FROM (SELECT doc_id, list_filter(regexp_split_to_array(text, '{S}+'), lambda x: x <> '') AS l FROM documents)),
c AS (SELECT doc_id, word, count(*) AS n, min(pos) AS first FROM w WHERE length(word) > 2 AND word NOT IN {STOPS_SQL} GROUP BY doc_id, word), r AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY n DESC, first) AS k FROM c),
m AS (SELECT doc_id, map_from_entries(list((word, n))) AS m FROM r WHERE k <= 15 GROUP BY doc_id), s AS (SELECT doc_id, {SUMMARY_SQL} AS l FROM documents), e AS (SELECT doc_id, unnest(l) AS sentence, unnest(range(0, len(l))) AS k FROM s),
z AS (SELECT doc_id, k + 1 AS sentence_no, sentence, round(coalesce(list_sum(list_transform(regexp_split_to_array(lower(sentence), '\\s+'), lambda x: coalesce(m[regexp_replace(x, '[^a-z0-9]', '', 'g')], 0))), 0)::DOUBLE / greatest(1, len(regexp_split_to_array(lower(sentence), '\\s+'))) * CASE WHEN k = 0 THEN 1.4::DOUBLE WHEN k < 3 THEN 1.2::DOUBLE ELSE 1.0::DOUBLE END, 6) AS score FROM e JOIN m USING (doc_id)),
ranked AS (SELECT doc_id, sentence_no, sentence, score, row_number() OVER (PARTITION BY doc_id ORDER BY score DESC, sentence_no) AS rank FROM z)"""


def ranked_sentences(spark, sf_dir):
    return Q.sentence_rank(documents(spark, sf_dir))


@query("sentence_rank", f"WITH {_KEYS} SELECT doc_id, sentence_no, score, rank FROM ranked")
def sentence_rank(spark, sf_dir):
    return ranked_sentences(spark, sf_dir).select("doc_id", "sentence_no", "score", "rank")


@query("extractive_summary", f"""WITH {_KEYS} SELECT doc_id, coalesce(string_agg(sentence, ' ' ORDER BY rank) FILTER (rank <= 3), '') AS short, string_agg(sentence, ' ' ORDER BY sentence_no) AS detailed, count(*) FILTER (rank <= 5) AS key_points FROM ranked WHERE rank <= 6 GROUP BY doc_id""")
def extractive_summary(spark, sf_dir):
    return Q.extractive_summary(ranked_sentences(spark, sf_dir))


@query("section_highlights")
def section_highlights(spark, sf_dir):
    """The best sentence of every section; tests hold it against sentence_rank of the section alone."""
    return Q.section_highlights(G.section_split(marked_documents(spark, sf_dir)))


def _ascii(p: str) -> str:
    return p.replace("(?<![A-Za-z0-9_])", r"\b").replace("(?![A-Za-z0-9_])", r"\b").replace("'", "''")


_LUHN = "(len(regexp_replace({m}, '\\D', '', 'g')) BETWEEN 13 AND 19 AND list_sum(list_transform(range(1, len(regexp_replace({m}, '\\D', '', 'g')) + 1), lambda i: CASE WHEN (len(regexp_replace({m}, '\\D', '', 'g')) - i) % 2 = 0 THEN CAST(regexp_replace({m}, '\\D', '', 'g')[i] AS INT) ELSE CAST(regexp_replace({m}, '\\D', '', 'g')[i] AS INT) * 2 - CASE WHEN CAST(regexp_replace({m}, '\\D', '', 'g')[i] AS INT) > 4 THEN 9 ELSE 0 END END)) % 10 = 0)"
_VALID = {"phone": "len(regexp_replace(match, '\\D', '', 'g')) BETWEEN 10 AND 15", "credit_card": _LUHN.format(m="match"), "national_id": "regexp_full_match(regexp_replace(match, '\\D', '', 'g'), '[2-9]\\d{11}')"}
_SCAN = " UNION ALL ".join(f"SELECT doc_id, '{k}' AS kind, CAST(n AS BIGINT) AS match_no, match FROM (SELECT doc_id, unnest(m) AS match, unnest(range(1, len(m) + 1)) AS n FROM (SELECT doc_id, regexp_extract_all(text, '{_ascii(p)}') AS m FROM documents)) WHERE {_VALID.get(k, 'true')}" for k, p in PRESET_PATTERNS.items())
_MASK = "CASE WHEN length(match) <= 4 THEN '••••' ELSE match[1:1] || repeat('•', CAST(least(10, greatest(4, length(match) - 2)) AS BIGINT)) || right(match, 1) END"


@query("pii_scan", f"WITH s AS ({_SCAN}) SELECT doc_id, kind, match_no, match, {_MASK} AS masked FROM s")
def pii_scan(spark, sf_dir):
    return P.pii_scan(documents(spark, sf_dir)).select("doc_id", "kind", "match_no", "match", "masked")


_EMAIL, _PHONE = _ascii(PRESET_PATTERNS["email"]), _ascii(PRESET_PATTERNS["phone"])


@query("pii_redact", f"""SELECT doc_id, length(text)::BIGINT AS n_before, len(regexp_extract_all(text, '{_EMAIL}'))::BIGINT AS hits,
  array_to_string(list_transform(range(1, len(p) + 1), lambda i: p[i] || CASE WHEN i < len(p) THEN repeat(' ', length(m[i])) ELSE '' END), '') AS redacted
FROM (SELECT doc_id, text, regexp_split_to_array(text, '{_EMAIL}') AS p, regexp_extract_all(text, '{_EMAIL}') AS m FROM documents) WHERE len(m) > 0""")
def pii_redact(spark, sf_dir):
    d = table(spark, sf_dir, "documents").filter(F.col("text").rlike(P.PRESETS["email"]))
    return d.select("doc_id", F.length("text").cast("long").alias("n_before"), F.regexp_count("text", F.lit(P.PRESETS["email"])).cast("long").alias("hits"), P.pii_redact(F.col("text"), ["email"]).alias("redacted"))


@query("pii_verify", f"""WITH s AS ({_SCAN}), t AS (SELECT doc_id, kind = 'email' AND doc_id % 5 = 0 AS leak, kind <> 'email' AS kept, kind = 'email' AND doc_id % 5 = 1 AND match_no = 1 AS risk FROM s WHERE kind IN ('email', 'phone'))
SELECT doc_id, count(*) FILTER (NOT leak AND NOT kept AND NOT risk) AS verified, count(*) FILTER (risk) AS residual_risk, count(*) FILTER (leak OR kept) AS failed, count(*) FILTER (leak) AS in_metadata, count(*) FILTER (leak OR kept OR risk) = 0 AS all_purged FROM t GROUP BY doc_id""")
def pii_verify(spark, sf_dir):
    """E-mail addresses are blanked and phone numbers are not; every fifth document keeps its addresses as metadata, and
    the first address of others is marked as a residual risk."""
    docs = table(spark, sf_dir, "documents")
    risk = F.when((F.col("kind") == "email") & (F.col("doc_id") % 5 == 1) & (F.col("match_no") == 1), "residual_risk")
    targets = P.pii_scan(docs, ["email", "phone"]).select("doc_id", F.col("match").alias("target"), risk.alias("reason"))
    kept = F.when(F.col("doc_id") % 5 == 0, F.array_join(F.regexp_extract_all("text", F.lit(P.PRESETS["email"]), 0), " "))
    outputs = docs.select("doc_id", P.pii_redact(F.col("text"), ["email"]).alias("text"), kept.alias("metadata"))
    return P.pii_report(P.pii_verify(targets, outputs, "metadata"))


@query("privacy_score", f"""WITH s AS ({_SCAN}), g AS (SELECT d.doc_id, max((kind = 'email')::INT) AS em, max((kind = 'phone')::INT) AS ph, max((kind = 'credit_card')::INT) AS cc, max((kind = 'date')::INT) AS dt FROM documents d LEFT JOIN s USING (doc_id) GROUP BY d.doc_id),
v AS (SELECT doc_id, coalesce(em, 0) AS em, coalesce(ph, 0) AS ph, coalesce(cc, 0) AS cc, coalesce(dt, 0) AS dt FROM g), p AS (SELECT *, least(CASE WHEN cc = 1 THEN 65 ELSE 100 END, greatest(0, 100 - 15 * em - 15 * ph - 25 * cc - 10 * dt)) AS score FROM v),
l AS (SELECT *, least(CASE WHEN score >= 95 AND em + ph + cc + dt = 0 THEN 5 WHEN score >= 85 THEN 4 WHEN score >= 70 THEN 3 WHEN score >= 55 THEN 2 WHEN score >= 40 THEN 1 ELSE 0 END, CASE WHEN cc = 1 THEN 2 ELSE 5 END, CASE WHEN em = 1 THEN 4 ELSE 5 END) AS level FROM p)
SELECT doc_id, CAST(score AS BIGINT) AS score, ['F', 'D', 'C', 'B', 'A', 'A+'][level + 1] AS grade FROM l""")
def privacy_score(spark, sf_dir):
    """Found personal data as signals: email as name, phone as device, card as gps, date as software."""
    docs = table(spark, sf_dir, "documents")
    signal = F.when(F.col("kind") == "email", "name").when(F.col("kind") == "phone", "device").when(F.col("kind") == "credit_card", "gps").when(F.col("kind") == "date", "software").otherwise("other")
    found = P.pii_scan(docs).select("doc_id", signal.alias("signal"), F.lit(1).alias("count"))
    return P.privacy_score(found.unionByName(docs.select("doc_id", F.lit("none").alias("signal"), F.lit(0).alias("count"))))


@query("html_clean", r"""WITH p AS (SELECT page_id, html || '<script>a</style>b</script><SELECT><option>x</SELECT><input value="q"><noscript>n</noscript><math>m</math>' AS h FROM pages),
a AS (SELECT page_id, regexp_replace(h, '(?s)<!--.*?-->', ' ', 'g') AS h FROM p), """ + ", ".join(f"""a{k} AS (SELECT page_id, regexp_replace(h, '(?is)<{t}\\b[^>]*>.*?</{t}\\s*>', ' ', 'g') AS h FROM a{k - 1 if k else ''})""" for k, t in enumerate(["script", "noscript", "iframe", "object", "applet", "form", "button", "select", "textarea", "style", "svg"])) + r"""
SELECT page_id, trim(regexp_replace(replace(replace(replace(replace(replace(replace(regexp_replace(h, '<[^>]*>', ' ', 'g'), '&nbsp;', ' '), '&lt;', '<'), '&gt;', '>'), '&quot;', '"'), '&#39;', chr(39)), '&amp;', '&'), '[ \t\n\r\f]+', ' ', 'g')) AS body FROM a10""")
def html_clean(spark, sf_dir):
    """Pages with some disallowed elements behind them."""
    planted = '<script>a</style>b</script><SELECT><option>x</SELECT><input value="q"><noscript>n</noscript><math>m</math>'
    return table(spark, sf_dir, "pages").select("page_id", P.html_text(F.concat("html", F.lit(planted))).alias("body"))


@query("html_sanitize", r"""SELECT page_id, '<p class="a"> ' || CASE WHEN page_id % 2 = 0 THEN '<a>x</a>' ELSE '<a href="https://e.com/' || page_id || '">x</a>' END || '</p>' AS clean FROM pages""")
def html_sanitize(spark, sf_dir):
    """Fragments made of page ids: handlers, forbidden addresses and disallowed elements go."""
    link = F.when(F.col("page_id") % 2 == 0, F.lit("javascript:alert(1)")).otherwise(F.concat(F.lit("https://e.com/"), F.col("page_id").cast("string")))
    html = F.concat(F.lit('<p class="a" onclick="go()"><script>evil</script><a href="'), link, F.lit('">x</a></p>'))
    return table(spark, sf_dir, "pages").select("page_id", P.html_sanitized(html).alias("clean"))


@query("url_risk_filter", r"""WITH u AS (SELECT page_id, unnest(list_concat(regexp_extract_all(html, '(?i)href="([^"]*)"', 1), [url, CASE page_id % 4 WHEN 0 THEN 'javascript:x' WHEN 1 THEN 'http://10.0.0.' || page_id % 250 || '/a' WHEN 2 THEN 'http://172.20.1.1' ELSE 'http://LOCALHOST:80' END])) AS url FROM pages)
SELECT page_id, count(*) AS urls, count(*) FILTER (regexp_matches(lower(trim(url)), '^(javascript|vbscript|file|ftp):') OR regexp_matches(lower(trim(url)), '169\.254\.169\.254|localhost|127\.0\.0\.1|0\.0\.0\.0|\[::1\]|metadata\.google\.internal') OR regexp_matches(lower(trim(url)), '(?:^|//)(?:10\.\d{1,3}\.\d{1,3}\.\d{1,3}|192\.168\.\d{1,3}\.\d{1,3}|172\.(?:1[6-9]|2\d|3[0-1])\.\d{1,3}\.\d{1,3})(?::\d+)?(?:/|$)')) AS forbidden FROM u GROUP BY page_id""")
def url_risk_filter(spark, sf_dir):
    """Links of the pages, their own address and one planted address each."""
    planted = F.element_at(F.array(F.lit("javascript:x"), F.concat(F.lit("http://10.0.0."), (F.col("page_id") % 250).cast("string"), F.lit("/a")), F.lit("http://172.20.1.1"), F.lit("http://LOCALHOST:80")), (F.col("page_id") % 4 + 1).cast("int"))
    u = table(spark, sf_dir, "pages").select("page_id", F.explode(F.concat(F.regexp_extract_all("html", F.lit('(?i)href="([^"]*)"'), 1), F.array("url", planted))).alias("url"))
    return u.groupBy("page_id").agg(F.count("*").alias("urls"), F.sum(P.forbidden_url(F.col("url")).cast("long")).alias("forbidden"))


@query("fingerprint_drift", """WITH a AS (SELECT conv_id AS doc, turn AS page, md5(text) AS c, role AS m FROM conversations WHERE (conv_id + turn) % 11 <> 0), b AS (SELECT conv_id AS doc, turn AS page, md5(CASE WHEN conv_id % 4 = 1 AND turn = 1 THEN text || 'x' ELSE text END) AS c, CASE WHEN conv_id % 4 = 2 THEN upper(role) ELSE role END AS m FROM conversations WHERE (conv_id + turn) % 13 <> 0),
j AS (SELECT coalesce(a.doc, b.doc) AS doc, coalesce(a.page, b.page) AS page, CASE WHEN a.doc IS NULL THEN 'added' WHEN b.doc IS NULL THEN 'missing' WHEN a.c <> b.c THEN 'modified' WHEN a.m = b.m THEN 'matched' ELSE 'metadata' END AS k FROM a FULL JOIN b ON a.doc = b.doc AND a.page = b.page)
SELECT doc, coalesce(list(page ORDER BY page) FILTER (k IN ('matched', 'metadata')), []) AS matched, coalesce(list(page ORDER BY page) FILTER (k = 'modified'), []) AS modified, coalesce(list(page ORDER BY page) FILTER (k = 'missing'), []) AS missing, coalesce(list(page ORDER BY page) FILTER (k = 'added'), []) AS added,
  CASE WHEN count(*) FILTER (k IN ('modified', 'missing', 'added')) > 0 THEN 'content_drift' WHEN count(*) FILTER (k = 'metadata') > 0 THEN 'metadata_only' ELSE 'identical' END AS status FROM j GROUP BY doc""")
def fingerprint_drift(spark, sf_dir):
    """Conversations as documents and turns as pages: some changed, some with other metadata, some on one side only."""
    c = table(spark, sf_dir, "conversations").select(F.col("conv_id").alias("doc"), F.col("turn").alias("page_no"), "text", "role")
    old = c.filter((F.col("doc") + F.col("page_no")) % 11 != 0).select("doc", "page_no", F.md5("text").alias("content"), F.col("role").alias("metadata"))
    edited = F.when((F.col("doc") % 4 == 1) & (F.col("page_no") == 1), F.concat("text", F.lit("x"))).otherwise(F.col("text"))
    new = c.filter((F.col("doc") + F.col("page_no")) % 13 != 0).select("doc", "page_no", F.md5(edited).alias("content"), F.when(F.col("doc") % 4 == 2, F.upper("role")).otherwise(F.col("role")).alias("metadata"))
    return D.fingerprint_drift(old, new, "doc")


@query("metadata_drift", """WITH a AS (SELECT c_custkey || ':' || k AS key, v FROM (SELECT c_custkey, unnest(['name', 'segment']) AS k, unnest([c_name, c_mktsegment]) AS v FROM customer)), b AS (SELECT c_custkey || ':' || k AS key, v FROM (SELECT c_custkey, unnest(['name', 'segment', 'nation']) AS k, unnest([c_name, CASE WHEN c_custkey % 3 = 0 THEN lower(c_mktsegment) ELSE c_mktsegment END, CAST(c_nationkey AS VARCHAR)]) AS v FROM customer))
SELECT key, a.v AS old, b.v AS "new", CASE WHEN a.v IS NULL THEN 'added' WHEN b.v IS NULL THEN 'removed' WHEN a.v = b.v THEN 'identical' ELSE 'changed' END AS status FROM a FULL JOIN b USING (key)""")
def metadata_drift(spark, sf_dir):
    c = table(spark, sf_dir, "customer")
    long = lambda **kv: c.select(F.explode(F.array(*[F.struct(F.concat_ws(":", "c_custkey", F.lit(k)).alias("key"), v.alias("v")) for k, v in kv.items()])).alias("x")).select("x.*")
    segment = F.when(F.col("c_custkey") % 3 == 0, F.lower("c_mktsegment")).otherwise(F.col("c_mktsegment"))
    return D.drift(long(name=F.col("c_name"), segment=F.col("c_mktsegment")), long(name=F.col("c_name"), segment=segment, nation=F.col("c_nationkey").cast("string")), "key", "v")


@query("name_collisions", "SELECT p_name AS name, count(DISTINCT p_brand) AS sources, list_sort(list(DISTINCT p_brand)) AS brands FROM part GROUP BY p_name HAVING count(DISTINCT p_brand) > 1")
def name_collisions(spark, sf_dir):
    d = table(spark, sf_dir, "part").select(F.col("p_name").alias("name"), "p_brand").distinct()
    return d.groupBy("name").agg(F.count("*").alias("sources"), F.array_sort(F.collect_list("p_brand")).alias("brands")).filter("sources > 1")
