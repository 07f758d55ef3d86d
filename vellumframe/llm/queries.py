"""The registered queries of this subpackage and their DuckDB SQL."""

from __future__ import annotations

from .attention import score as attention_score
from .common import table
from .filter_audit import audit
from .hyperminhash import near_duplicates
from .importance import resample
from .languages import identify
from .mixing import mix
from .packing import pack_documents
from .projections import nearest
from .quantise import near_vectors
from .quotations import link_quotations
from .token_counts import count_tokens
from .toxicity import score as toxicity_score
from .wavelet import read_documents, write_tokens

#: The text with A-Z lower-cased, split at ASCII white space.
WORDS_SQL = r"list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '')"


def op10_hyperminhash(spark, sf_dir):
    return near_duplicates(table(spark, sf_dir, "documents"), shingle=3, percent=85)


OP10_SQL = f"""
WITH RECURSIVE words AS MATERIALIZED (
  SELECT doc_id, {WORDS_SQL} AS w FROM documents
), sets AS MATERIALIZED (
  SELECT doc_id, list_distinct(CASE WHEN len(w) >= 3 THEN list_transform(range(1, len(w) - 1), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2])
         WHEN len(w) > 0 THEN [array_to_string(w, ' ')] ELSE [] END) AS s FROM words
), posted AS MATERIALIZED (
  SELECT doc_id, len(s) AS n, unnest(s) AS g FROM sets
), links AS MATERIALIZED (
  SELECT a.doc_id AS a, b.doc_id AS b FROM posted a JOIN posted b ON a.g = b.g AND a.doc_id <> b.doc_id
  GROUP BY a.doc_id, b.doc_id, a.n, b.n HAVING 100 * count(*) >= 85 * (a.n + b.n - count(*))
), reach(doc_id, r) AS (
  SELECT doc_id, doc_id FROM documents
  UNION
  SELECT l.b, reach.r FROM reach JOIN links l ON l.a = reach.doc_id
)
SELECT s.doc_id, CAST(len(s.s) AS BIGINT) AS n_shingles, min(r) AS component_id, s.doc_id = min(r) AS kept
FROM sets s JOIN reach USING (doc_id) GROUP BY s.doc_id, s.s
"""



def op1_best_fit_packing(spark, sf_dir):
    return pack_documents(table(spark, sf_dir, "documents"))


def op2_wavelet_tokens(spark, sf_dir):
    return read_documents(write_tokens(table(spark, sf_dir, "documents")))


def op3_quotation_linking(spark, sf_dir):
    return link_quotations(table(spark, sf_dir, "conversations"))


def op4_toxicity(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return toxicity_score(docs, table(spark, sf_dir, "labels")).select("doc_id", "held_out", "score", "predicted")


def op5_projected_neighbours(spark, sf_dir):
    return nearest(table(spark, sf_dir, "embeddings"))


def op6_iterative_quantisation(spark, sf_dir):
    return near_vectors(table(spark, sf_dir, "embeddings"))


def op7_attention_score(spark, sf_dir):
    return attention_score(table(spark, sf_dir, "documents"))


def op9_language_field(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    return identify(docs).select("doc_id", "held_out", "lang_pred", "score")


def op8_mixing(spark, sf_dir):
    rows, _ = mix(table(spark, sf_dir, "documents"))
    return rows.select("doc_id", "size", "source_size", "target", "taken")


OP8_SQL = rf"""
WITH sized AS (
  SELECT doc_id, source, CAST(len({WORDS_SQL}) AS BIGINT) AS size, md5('11:' || coalesce(CAST(doc_id AS VARCHAR), 'text ' || md5(coalesce(text, '')))) AS k FROM documents
), sources AS (
  SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM sized GROUP BY source
), numbered AS (
  SELECT *, row_number() OVER (ORDER BY source NULLS LAST) - 1 AS n FROM sources
), weighed AS (
  SELECT *, CAST(CASE n % 3 WHEN 0 THEN 5 WHEN 1 THEN 2 ELSE 1 END AS DOUBLE) AS w, CAST(3 * source_size AS DOUBLE) AS cap FROM numbered
), levelled AS (
  SELECT *, cap / w AS r, (CAST(sum(source_size) OVER () AS DOUBLE) - coalesce(sum(cap) OVER (ORDER BY cap / w, n ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
    / sum(w) OVER (ORDER BY cap / w, n ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level FROM weighed
), lev AS (
  SELECT arg_min(level, r) AS level FROM levelled WHERE r >= level
), targets AS (
  SELECT source, source_size, CASE WHEN lev.level IS NULL OR r < lev.level THEN cap ELSE w * lev.level END AS target FROM levelled, lev
), placed AS (
  SELECT doc_id, size, source_size, target, CAST(floor(target + 0.5) AS BIGINT) AS words,
    CAST(sum(size) OVER (PARTITION BY s.source ORDER BY k, size ROWS UNBOUNDED PRECEDING) - size AS BIGINT) AS c
  FROM sized s JOIN targets t ON s.source IS NOT DISTINCT FROM t.source
)
SELECT doc_id, size, source_size, target,
  CAST(CASE WHEN source_size = 0 THEN 0 ELSE words // source_size * size + greatest(0, least(size, words % source_size - c)) END AS BIGINT) AS taken
FROM placed
"""


OP3_SQL = r"""
WITH RECURSIVE messages AS MATERIALIZED (
  SELECT row_number() OVER () AS msg, CAST(conv_id AS BIGINT) AS conv_id, coalesce(CAST(CAST(conv_id AS BIGINT) AS VARCHAR), 'none') AS conv, CAST(turn AS BIGINT) AS turn, role, coalesce(text, '') AS text FROM conversations
), raw AS (
  SELECT msg, conv, turn, unnest(l) AS raw, unnest(range(0, len(l))) AS pos FROM (SELECT *, regexp_split_to_array(text, '\r?\n') AS l FROM messages)
), marked AS (
  SELECT *, regexp_extract(raw, '^(?:[ \t]{0,3}>)+[ \t]?') AS mark FROM raw
), levelled AS (
  SELECT msg, conv, turn, pos, length(mark) - length(replace(mark, '>', '')) AS level, substring(raw, length(mark) + 1) AS line FROM marked
), normal AS (
  SELECT *, lower(trim(regexp_replace(line, '\s+', ' ', 'g'))) AS norm FROM levelled
), near AS (
  SELECT *, level = 0 AND lead(level, 1, 0) OVER w > 0 AND regexp_matches(line, '(?i)(wrote|writes|said|schrieb|a écrit|escribió)\s*:\s*$') AS intro,
    level <> lag(level, 1, -1) OVER w OR lag(norm, 1, '') OVER w = '' AS new FROM normal WINDOW w AS (PARTITION BY msg ORDER BY pos)
), lines AS MATERIALIZED (
  SELECT *, sum(new::INT) OVER (PARTITION BY msg ORDER BY pos) AS passage FROM near
), said AS (
  SELECT * FROM lines WHERE level = 0 AND NOT intro AND norm <> ''
), units AS (
  SELECT conv, turn, norm AS said FROM said
  UNION ALL SELECT conv, turn, string_agg(norm, ' ' ORDER BY pos) FROM said GROUP BY msg, conv, turn, passage
  UNION ALL SELECT conv, turn, string_agg(norm, ' ' ORDER BY pos) FROM said GROUP BY msg, conv, turn
), here AS (
  SELECT said, conv, min(turn) AS origin FROM units WHERE turn IS NOT NULL GROUP BY 1, 2
), anywhere AS (
  SELECT DISTINCT said FROM units WHERE turn IS NOT NULL
), quoted AS (
  SELECT * FROM lines WHERE level > 0 AND norm <> ''
), asked AS (
  SELECT msg, conv, turn, level, passage, string_agg(norm, ' ' ORDER BY pos) AS said FROM quoted GROUP BY 1, 2, 3, 4, 5
  UNION ALL SELECT msg, conv, turn, level, passage, norm FROM quoted
), met AS MATERIALIZED (
  SELECT a.*, CASE WHEN h.origin < a.turn THEN h.origin END AS origin, s.said IS NOT NULL AS somewhere
  FROM asked a LEFT JOIN here h ON h.said = a.said AND h.conv = a.conv LEFT JOIN anywhere s ON s.said = a.said
), per AS (
  SELECT msg, level, passage, max((origin IS NOT NULL)::INT) AS linked, max(somewhere::INT) AS seen FROM met GROUP BY 1, 2, 3
), counts AS (
  SELECT msg, count(*) AS n_quotes, sum(linked) AS n_linked, sum(seen * (1 - linked)) AS n_elsewhere, max(level) AS max_level, min(level) FILTER (linked = 1) AS outermost FROM per GROUP BY msg
), votes AS (
  SELECT msg, origin, sum(length(said)) AS size FROM met JOIN counts USING (msg) WHERE origin IS NOT NULL AND level = outermost GROUP BY 1, 2
), parents AS MATERIALIZED (
  SELECT msg, arg_max(origin, (size, origin)) AS parent_turn FROM votes GROUP BY msg
), up AS MATERIALIZED (
  SELECT conv, turn, min(parent_turn) AS parent FROM messages JOIN parents USING (msg) GROUP BY 1, 2
), climb(conv, turn, "at") AS (
  SELECT conv, turn, parent FROM up UNION SELECT c.conv, c.turn, u.parent FROM climb c JOIN up u ON u.conv = c.conv AND u.turn = c."at"
), roots AS (
  SELECT conv, turn, min("at") AS root FROM climb GROUP BY 1, 2
), bodies AS (
  SELECT msg, string_agg(line, chr(10) ORDER BY pos) AS body FROM lines WHERE level = 0 AND NOT intro GROUP BY msg
), whole AS (
  SELECT m.*, parent_turn, coalesce(root, m.turn) AS thread_turn FROM messages m LEFT JOIN parents USING (msg) LEFT JOIN roots r ON r.conv = m.conv AND r.turn = m.turn
)
SELECT conv_id, turn, role, regexp_replace(coalesce(body, ''), '^\n+|\n+$', '', 'g') AS body, CAST(coalesce(n_quotes, 0) AS BIGINT) AS n_quotes, CAST(coalesce(n_linked, 0) AS BIGINT) AS n_linked,
  CAST(coalesce(n_elsewhere, 0) AS BIGINT) AS n_elsewhere, CAST(coalesce(max_level, 0) AS BIGINT) AS max_level, parent_turn, thread_turn,
  row_number() OVER (PARTITION BY conv ORDER BY thread_turn NULLS FIRST, turn NULLS FIRST, msg) - 1 AS position
FROM whole LEFT JOIN counts USING (msg) LEFT JOIN bodies USING (msg)
"""

OP6_SQL = """
WITH RECURSIVE good AS MATERIALIZED (
  SELECT vec_id, label, list_transform(embedding, lambda x: CAST(x AS DOUBLE)) AS v FROM embeddings
  WHERE label IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(embedding, lambda x: x <> 0)) > 0
), links AS MATERIALIZED (
  SELECT a.vec_id AS a, b.vec_id AS b FROM good a JOIN good b ON a.label = b.label AND a.vec_id <> b.vec_id
  WHERE list_cosine_similarity(a.v, b.v) >= 0.93
), reach(vec_id, r) AS (
  SELECT vec_id, vec_id FROM embeddings
  UNION
  SELECT l.b, reach.r FROM reach JOIN links l ON l.a = reach.vec_id
), comp AS (
  SELECT vec_id, min(r) AS component_id FROM reach GROUP BY vec_id
), counted AS (
  SELECT a AS vec_id, count(*) AS n FROM links GROUP BY a
)
SELECT e.vec_id, CAST(coalesce(n, 0) AS BIGINT) AS n_links, component_id, e.vec_id = component_id AS kept
FROM embeddings e JOIN comp USING (vec_id) LEFT JOIN counted USING (vec_id)
"""


def op11_token_counts(spark, sf_dir):
    return count_tokens(table(spark, sf_dir, "documents").select("doc_id", "text")).drop("text")


def op12_importance(spark, sf_dir):
    docs, target = (table(spark, sf_dir, t) for t in ("documents", "benchmark"))
    return resample(docs.select("doc_id", "text"), target).select("doc_id", "n_features", "weight", "score", "rank")


#: crc32 a byte at a time, over its table of 256 values; doubles and floors as the operator's.
OP12_SQL = r"""
WITH step AS (
  SELECT list(c ORDER BY i) AS t FROM (
    SELECT i, list_reduce(list_prepend(i, range(8)), lambda c, k: CASE WHEN c % 2 = 1 THEN xor(CAST(3988292384 AS BIGINT), c // 2) ELSE c // 2 END) AS c FROM (SELECT unnest(range(256)) AS i)
  )
), texts AS MATERIALIZED (
  SELECT 's' AS side, row_number() OVER () AS r, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents
  UNION ALL SELECT 't', row_number() OVER (), NULL, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') FROM benchmark
), features AS MATERIALIZED (
  SELECT side, r, unnest(list_concat(w, list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1]))) AS g FROM texts
), posted AS MATERIALIZED (
  SELECT side, r, g, count(*) AS n FROM features GROUP BY 1, 2, 3
), spelled AS (
  SELECT g, hex(encode(g)) AS x FROM (SELECT DISTINCT g FROM posted)
), hashed AS MATERIALIZED (
  SELECT g, xor(list_reduce(list_prepend(CAST(4294967295 AS BIGINT), list_transform(range(0, len(x) // 2), lambda i: CAST('0x' || substring(x, 2 * i + 1, 2) AS BIGINT))),
    lambda c, b: xor(t[xor(c, b) % 256 + 1], c // 256)), CAST(4294967295 AS BIGINT)) % 10000 AS b FROM spelled, step
), counts AS (
  SELECT b, sum(n) FILTER (side = 's') AS s, sum(n) FILTER (side = 't') AS t FROM posted JOIN hashed USING (g) GROUP BY b
), totals AS (
  SELECT CAST(coalesce(sum(s), 0) + 10000 AS DOUBLE) AS s_all, CAST(coalesce(sum(t), 0) + 10000 AS DOUBLE) AS t_all FROM counts
), gains AS (
  SELECT b, CAST(floor(1000 * ln(CAST(coalesce(t, 0) + 1 AS DOUBLE) * s_all / (CAST(coalesce(s, 0) + 1 AS DOUBLE) * t_all))) AS BIGINT) AS gain FROM counts, totals
), weighed AS (
  SELECT r, CAST(sum(n) AS BIGINT) AS n_features, CAST(floor(CAST(sum(n * gain) AS DOUBLE) / sum(n)) AS BIGINT) AS weight FROM posted JOIN hashed USING (g) JOIN gains USING (b) WHERE side = 's' GROUP BY r
), scored AS (
  SELECT doc_id, coalesce(n_features, 0) AS n_features, coalesce(weight, 0) AS weight, len(w) >= 20 AS may,
    coalesce(weight, 0) + CAST(floor(-1000 * ln(-ln((CAST('0x' || substring(sha256('7:' || coalesce(CAST(doc_id AS VARCHAR), '')), 1, 8) AS BIGINT) + 0.5::DOUBLE) / 4294967296::DOUBLE))) AS BIGINT) AS score
  FROM texts LEFT JOIN weighed USING (r) WHERE side = 's'
), ranked AS (
  SELECT *, row_number() OVER (PARTITION BY may ORDER BY score DESC, doc_id) AS k, count(*) OVER (PARTITION BY may) AS n FROM scored
)
SELECT doc_id, n_features, weight, score, CASE WHEN may AND k <= 25 * n // 100 THEN k END AS rank FROM ranked
"""


def op13_filter_audit(spark, sf_dir):
    return audit(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


OP13_SQL = r"""
WITH marked AS (
  SELECT id, max(quality = 1) AS good, max(toxic = 1) AS toxic FROM (SELECT doc_id AS id, quality, toxic FROM labels) GROUP BY id
), split AS (
  SELECT doc_id, coalesce(source, '') AS part, coalesce(text, '') AS t, list_filter(string_split_regex(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w FROM documents
), failed AS (
  SELECT part, [len(w) < 50, 100 * len(list_distinct(w)) < 65 * len(w), 100 * length(regexp_replace(t, '[^A-Z]+', '', 'g')) > 5 * length(t), regexp_matches(t, '[#$%&*|]'),
    doc_id > min(doc_id) OVER (PARTITION BY t)] AS f, coalesce(good, false) AS good, coalesce(toxic, false) AS toxic
  FROM split LEFT JOIN marked ON id = doc_id
), cells AS MATERIALIZED (
  SELECT part, f, count(*) AS n, count(*) FILTER (good) AS good, count(*) FILTER (toxic) AS toxic FROM failed GROUP BY part, f
), letters AS (
  SELECT unnest(range(1, 6)) AS k
), orders AS (
  SELECT [a.k, b.k, c.k, d.k, e.k] AS o FROM letters a, letters b, letters c, letters d, letters e WHERE len(list_distinct([a.k, b.k, c.k, d.k, e.k])) = 5
), steps AS MATERIALIZED (
  SELECT o, array_to_string(list_transform(o, lambda k: 'ABCDE'[k]), '') AS filter_order, unnest(range(1, 6)) AS step FROM orders
), counted AS (
  SELECT part, filter_order, step, o[step] AS own,
    sum(n) FILTER (NOT list_bool_or(list_transform(o[:step], lambda k: f[k]))) AS kept,
    sum(n) FILTER (f[o[step]] AND NOT coalesce(list_bool_or(list_transform(o[:step - 1], lambda k: f[k])), false)) AS removed,
    sum(n) FILTER (f[o[step]] AND coalesce(list_bool_or(list_transform(o[:step - 1], lambda k: f[k])), false)) AS redundant,
    sum(n) FILTER (f[o[step]] AND len(list_filter(f, lambda x: x)) = 1) AS unique_fails,
    sum(good) FILTER (f[o[step]] AND NOT coalesce(list_bool_or(list_transform(o[:step - 1], lambda k: f[k])), false)) AS good_lost,
    sum(toxic) FILTER (f[o[step]] AND NOT coalesce(list_bool_or(list_transform(o[:step - 1], lambda k: f[k])), false)) AS toxic_lost
  FROM cells, steps GROUP BY part, filter_order, step, own
)
SELECT part, filter_order, CAST(step AS INTEGER) AS step, CAST(coalesce(kept, 0) AS BIGINT) AS kept, CAST(coalesce(removed, 0) AS BIGINT) AS removed, CAST(coalesce(redundant, 0) AS BIGINT) AS redundant,
  CAST(coalesce(unique_fails, 0) AS BIGINT) AS unique_fails, CAST(coalesce(good_lost, 0) AS BIGINT) AS good_lost, CAST(coalesce(toxic_lost, 0) AS BIGINT) AS toxic_lost,
  CAST(sum(coalesce(removed, 0)) OVER (PARTITION BY part, own) AS BIGINT) AS shapley
FROM counted
"""

QUERIES = {
    "op1_best_fit_packing": op1_best_fit_packing,
    "op2_wavelet_tokens": op2_wavelet_tokens,
    "op3_quotation_linking": op3_quotation_linking,
    "op4_toxicity": op4_toxicity,
    "op5_projected_neighbours": op5_projected_neighbours,
    "op6_iterative_quantisation": op6_iterative_quantisation,
    "op7_attention_score": op7_attention_score,
    "op8_mixing": op8_mixing,
    "op9_language_field": op9_language_field,
    "op10_hyperminhash": op10_hyperminhash,
    "op11_token_counts": op11_token_counts,
    "op12_importance": op12_importance,
    "op13_filter_audit": op13_filter_audit,
}
ORACLE_SQL = {
    "op3_quotation_linking": OP3_SQL,
    "op6_iterative_quantisation": OP6_SQL,
    "op8_mixing": OP8_SQL,
    "op10_hyperminhash": OP10_SQL,
    "op12_importance": OP12_SQL,
    "op13_filter_audit": OP13_SQL,
}
