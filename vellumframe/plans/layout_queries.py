"""Queries over positioned tokens made of the events table (page: user, words: event types), and paragraphs."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import layout as L
from ..operators import ordering as O
from ..sources import csv as C
from ..sources.shared import scratch
from .registry import documents, query, table

TOKENS = """tok AS (SELECT event_id, user_id AS page, event_type AS text, (k % 6) * 90 + event_id % 3 + 0.0::DOUBLE AS x, (k // 6) * 14 + event_id % 2 + 0.0::DOUBLE AS y, CASE WHEN event_type = 'purchase' THEN 70.0::DOUBLE ELSE 50.0::DOUBLE END AS width, 10.0::DOUBLE AS height,
  CASE WHEN event_id % 4 > 0 THEN event_id % 100 + 0.0::DOUBLE END AS confidence, k + 1 AS pos, CASE event_type WHEN 'signup' THEN 18.0::DOUBLE WHEN 'error' THEN 14.0::DOUBLE ELSE 10.0::DOUBLE END AS size FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS k FROM events))"""


def tokens(spark, sf_dir):
    e = O.positioned(table(spark, sf_dir, "events"), "user_id", "ts", "event_id").withColumn("k", F.col("pos") - 1)
    return e.select(
        "event_id", F.col("user_id").alias("page"), F.col("event_type").alias("text"), ((F.col("k") % 6) * 90 + F.col("event_id") % 3).cast("double").alias("x"), (F.floor(F.col("k") / 6) * 14 + F.col("event_id") % 2).cast("double").alias("y"),
        F.when(F.col("event_type") == "purchase", 70.0).otherwise(50.0).alias("width"), F.lit(10.0).alias("height"), F.when(F.col("event_id") % 4 > 0, (F.col("event_id") % 100).cast("double")).alias("confidence"),
        "pos", F.when(F.col("event_type") == "signup", 18.0).when(F.col("event_type") == "error", 14.0).otherwise(10.0).alias("size"),
    )


@query("lines_from_tokens", f"WITH {TOKENS} SELECT page, CAST(l + 1 AS BIGINT) AS line_no, min(y) + l // 4 * 30 AS y, string_agg(text, ' ' ORDER BY x, text) AS text, CAST(1 + l // 4 AS BIGINT) AS paragraph FROM (SELECT *, (pos - 1) // 6 AS l FROM tok) GROUP BY page, l")
def lines_from_tokens(spark, sf_dir):
    """Every fourth line steps further down, which starts a paragraph."""
    t = tokens(spark, sf_dir).withColumn("y", F.col("y") + F.floor(F.floor((F.col("pos") - 1) / 6) / 4) * 30).withColumn("height", F.lit(20.0))
    return L.lines_from_tokens(t, "page")


@query("tables_from_tokens", f"WITH {TOKENS}, r AS (SELECT *, (pos - 1) // 6 AS l, count(*) OVER (PARTITION BY page, (pos - 1) // 6) AS c FROM tok), d AS (SELECT *, dense_rank() OVER (PARTITION BY page ORDER BY l) - 1 AS row FROM r WHERE c >= 2), n AS (SELECT page, row, row_number() OVER (PARTITION BY page, row ORDER BY x, text) - 1 AS col, text FROM d), w AS (SELECT page, max(row) AS rows, max(col) AS cols FROM n GROUP BY page), g AS (SELECT page, unnest(range(0, rows + 1)) AS row, cols FROM w WHERE rows >= 1), h AS (SELECT page, row, unnest(range(0, cols + 1)) AS col FROM g) SELECT page, CAST(row AS BIGINT) AS row, CAST(col AS BIGINT) AS col, coalesce(text, '') AS text FROM h LEFT JOIN n USING (page, row, col)")
def tables_from_tokens(spark, sf_dir):
    return L.tables_from_tokens(tokens(spark, sf_dir), "page")


@query("table_grid_from_words", f"""WITH {TOKENS}, u AS (SELECT DISTINCT page, unnest(range(CAST(floor(x) AS BIGINT), CAST(floor(x + width) AS BIGINT) + 1)) AS u FROM tok), g AS (SELECT page, u, lag(u) OVER (PARTITION BY page ORDER BY u) AS p FROM u), e AS (SELECT page, min(x) AS lo, max(x + width) AS hi FROM tok GROUP BY page),
b AS (SELECT page, (pos - 1) // 6 AS l, min(y) AS top, max(y) + 10 AS bottom FROM tok GROUP BY 1, 2), n AS (SELECT page, bottom, lead(top) OVER (PARTITION BY page ORDER BY l) AS below FROM b)
SELECT page, 'column' AS axis, (p + u) / 2.0::DOUBLE AS divider FROM g JOIN e USING (page) WHERE u - p - 1 >= 8 AND (p + u) / 2.0 > lo + 15 AND (p + u) / 2.0 < hi - 15 UNION ALL SELECT page, 'row', floor((bottom + below) / 2 + 0.5) FROM n WHERE below IS NOT NULL""")
def table_grid_from_words(spark, sf_dir):
    return L.table_grid(tokens(spark, sf_dir), "page")


@query("cells_from_grid", f"""WITH {TOKENS}, g AS (SELECT DISTINCT page, c AS cell, c % 3 * 180.0::DOUBLE AS "left", c // 3 * 56.0::DOUBLE AS top, c % 3 * 180.0::DOUBLE + 180 AS "right", c // 3 * 56.0::DOUBLE + 56 AS bottom FROM tok, (SELECT unnest(range(0, 12)) AS c)),
j AS (SELECT g.page, g.cell, t.x, t.text, t.confidence, t.page IS NOT NULL AS hit FROM g LEFT JOIN tok t ON g.page = t.page AND t.x + t.width / 2 BETWEEN "left" - 3 AND "right" + 3 AND t.y + t.height / 2 BETWEEN top - 3 AND bottom + 3)
SELECT page, CAST(cell AS BIGINT) AS cell, coalesce(string_agg(text, ' ' ORDER BY x, text), '') AS text, CAST(coalesce(floor(avg(CASE WHEN hit THEN coalesce(confidence, 80.0::DOUBLE) END) + 0.5), 85) AS BIGINT) AS confidence FROM j GROUP BY page, cell""")
def cells_from_grid(spark, sf_dir):
    t = tokens(spark, sf_dir)
    c = F.col("cell")
    g = t.select("page").distinct().withColumn("cell", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(11).cast("long"))))
    g = g.withColumn("left", c % 3 * 180.0).withColumn("top", F.floor(c / 3) * 56.0).withColumn("right", F.col("left") + 180).withColumn("bottom", F.col("top") + 56)
    return L.cells_from_grid(g, t, "page")


@query("multi_column_flag", f"WITH {TOKENS} SELECT page, count(*) >= 6 AND count(*) FILTER (x + width < 260) >= 3 AND count(*) FILTER (x > 280) >= 3 AS two_columns FROM tok GROUP BY page")
def multi_column_flag(spark, sf_dir):
    return L.multi_column_flag(tokens(spark, sf_dir), "page", 540.0)


_BLOCKS = f"""{TOKENS}, s AS (SELECT *, CASE WHEN x < 260 AND x + width > 280 THEN 0 WHEN x + width / 2 < 270 THEN 1 ELSE 2 END AS c FROM tok), l AS (SELECT *, lag(c) OVER w AS pc, abs(y - lag(y) OVER w) AS dy, abs(x - lag(x) OVER w) AS dx, row_number() OVER w AS p FROM s WINDOW w AS (PARTITION BY page ORDER BY c, y DESC, x, text)),
b AS (SELECT *, sum(CASE WHEN coalesce(c = pc AND dy < 24 AND (dx < 40 OR dy < 18), false) THEN 0 ELSE 1 END) OVER (PARTITION BY page ORDER BY p) AS block FROM l), blocks AS (SELECT page, CAST(block AS BIGINT) AS block, CAST(min(c) AS BIGINT) AS "column", string_agg(text, ' ' ORDER BY p) AS text, min(x) AS "left", max(x + width) AS "right", max(size) AS size FROM b GROUP BY page, block)"""


@query("reading_blocks", f'WITH {_BLOCKS} SELECT page, block, "column", text, "left", "right" FROM blocks')
def reading_blocks(spark, sf_dir):
    return L.reading_blocks(tokens(spark, sf_dir), "page", 540.0).select("page", "block", "column", "text", "left", "right")


@query("block_tags", r"""SELECT conv_id, turn, CASE WHEN size >= 18 AND n <= 15 THEN 'H1' WHEN size >= 14 AND n <= 20 THEN 'H2' WHEN regexp_matches(t, '^\s*([•\-*]|\d+[.)])\s') THEN 'list' WHEN regexp_matches(t, '\|.*\||\t.*\t') THEN 'table' WHEN t = upper(t) AND regexp_matches(t, '[A-Z]') AND n <= 8 THEN 'H3' WHEN regexp_matches(t, ':\s*$') AND n <= 10 THEN 'H3' ELSE 'paragraph' END AS tag
FROM (SELECT conv_id, turn, t, size, len(regexp_split_to_array(trim(t), '\s+')) AS n FROM (SELECT conv_id, turn, CASE turn % 5 WHEN 0 THEN '- ' || text WHEN 1 THEN upper(text[1:20]) WHEN 2 THEN '| ' || text || ' | x |' WHEN 3 THEN text[1:15] || ':' ELSE text END AS t, 8 + conv_id % 12 AS size FROM conversations))""")
def block_tags(spark, sf_dir):
    k = F.col("turn") % 5
    t = F.when(k == 0, F.concat(F.lit("- "), "text")).when(k == 1, F.upper(F.substring("text", 1, 20))).when(k == 2, F.concat(F.lit("| "), "text", F.lit(" | x |"))).when(k == 3, F.concat(F.substring("text", 1, 15), F.lit(":"))).otherwise(F.col("text"))
    c = table(spark, sf_dir, "conversations").select("conv_id", "turn", t.alias("t"), (8 + F.col("conv_id") % 12).alias("size"))
    return c.select("conv_id", "turn", L.block_tag(F.col("t"), F.col("size")).alias("tag"))


@query("headings_from_runs", f"WITH {TOKENS}, m AS (SELECT page, size AS body, row_number() OVER (PARTITION BY page ORDER BY count(*) DESC, size) AS k FROM tok GROUP BY page, size), h AS (SELECT t.page, t.pos, t.size FROM tok t JOIN m ON m.page = t.page AND k = 1 WHERE t.size >= body * 1.15) SELECT page, pos, dense_rank() OVER (PARTITION BY page ORDER BY size DESC) AS level FROM h")
def headings_from_runs(spark, sf_dir):
    return L.headings_from_runs(tokens(spark, sf_dir), "page").select("page", "pos", "level")


@query("heading_tree", f"WITH {TOKENS}, h AS (SELECT page, pos, event_id % 4 + 1 AS level FROM tok) SELECT a.page, a.pos, a.level, max(b.pos) AS parent FROM h a LEFT JOIN h b ON a.page = b.page AND b.pos < a.pos AND b.level < a.level GROUP BY a.page, a.pos, a.level")
def heading_tree(spark, sf_dir):
    h = tokens(spark, sf_dir).select("page", "pos", (F.col("event_id") % 4 + 1).alias("level"))
    return L.heading_tree(h, "page")


_BOX = """SELECT v.doc, v.key, '{variant}' AS variant, coalesce(page, 1) AS page, CAST(coalesce({left}, {x}) AS DOUBLE) AS "left", CAST(coalesce({top}, {y} + v.doc * 24) AS DOUBLE) AS top,
  CAST(CASE WHEN page IS NULL THEN {x} + least({most}, greatest({least}, floor(length(v) * {each}::DOUBLE + 0.5))) ELSE {left} + least({wide}, greatest({narrow}, floor(r - l + 0.5))) END AS DOUBLE) AS "right",
  CAST(CASE WHEN page IS NULL THEN {y} + {high} + v.doc * 24 ELSE {top} + least({tall}, greatest({low}, floor(b - t + 0.5))) END AS DOUBLE) AS bottom, page IS NOT NULL AS found
FROM v LEFT JOIN (SELECT doc, key, {pages} AS page, min(x) AS l, min(y) AS t, max(x + width) AS r, max(y + height) AS b, row_number() OVER (PARTITION BY doc, key ORDER BY count(*) DESC, min(page)) AS k FROM m WHERE {where} GROUP BY doc, key{by}) h ON h.doc = v.doc AND h.key = v.key AND k = 1"""
_LONG = "(length({c}) >= 4 OR length({c}) >= 2 AND regexp_matches({c}, '[0-9]'))"
_PAGE = _BOX.format(variant="page", left="CASE WHEN l IS NOT NULL THEN greatest(0, floor(l + 0.5)) END", top="CASE WHEN t IS NOT NULL THEN greatest(0, floor(t + 0.5)) END", x=72, y=100, most=450, least=60, each="7.5", wide=600, narrow=15, tall=300, low=12, high=18, pages="page", by=", page",
                    where=f"vc = tc OR {_LONG.format(c='tc')} AND contains(vc, tc) OR {_LONG.format(c='vc')} AND contains(tc, vc)")
_ALL = _BOX.format(variant="all", left="floor(l + 0.5)", top="floor(t + 0.5)", x=40, y=40, most=480, least=80, each="9", wide=1 << 30, narrow=10, tall=1 << 30, low=10, high=20, pages="min(page)", by="", where="contains(vc, tc) OR contains(tc, vc)")


@query("locate_bbox", f"""WITH {TOKENS}, k AS (SELECT page % 10 AS doc, page, x, y, width, height, CASE event_id % 5 WHEN 0 THEN '(INV-' || event_id % 40 || '),' WHEN 1 THEN 'A' || event_id % 10 ELSE text END AS text FROM tok),
v AS (SELECT DISTINCT doc, key, v FROM k, (SELECT unnest(['a', 'b', 'c', 'd', 'e']) AS key, unnest(['signup error', 'Purchase!', 'nothing', 'inv-15', 'Order A6-INV 20']) AS v)),
m AS (SELECT v.doc, v.key, k.page, x, y, width, height, regexp_replace(lower(v), '[^a-z0-9]', '', 'g') AS vc, regexp_replace(lower(text), '[^a-z0-9]', '', 'g') AS tc FROM v JOIN k ON k.doc = v.doc)
{_PAGE} UNION ALL {_ALL}""")
def locate_bbox(spark, sf_dir):
    """Tokens with marks around them, values of which tokens are parts and the other way round, in both variants."""
    k = F.col("event_id")
    text = F.when(k % 5 == 0, F.concat(F.lit("(INV-"), (k % 40).cast("string"), F.lit("),"))).when(k % 5 == 1, F.concat(F.lit("A"), (k % 10).cast("string"))).otherwise(F.col("text"))
    t = tokens(spark, sf_dir).withColumn("doc", F.col("page") % 10).withColumn("text", text)
    pairs = F.array(*[F.struct(F.lit(k).alias("key"), F.lit(v).alias("value")) for k, v in (("a", "signup error"), ("b", "Purchase!"), ("c", "nothing"), ("d", "inv-15"), ("e", "Order A6-INV 20"))])
    values = t.select("doc").distinct().withColumn("p", F.explode(pairs)).select("doc", "p.*", F.col("doc").alias("line_index"))
    found = [L.locate_bbox(values, t, "doc", v).withColumn("variant", F.lit(v)) for v in ("page", "all")]
    return found[0].unionByName(found[1])


@query("paragraph_split")
def paragraph_split(spark, sf_dir):
    """Packing carries state from part to part, so SQL has no equal; tests hold it against a plain version."""
    return L.paragraph_split(documents(spark, sf_dir))


@query("streaming_history", "SELECT user_id, event_id FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS k FROM events) WHERE k <= 10")
def streaming_history(spark, sf_dir):
    """The stream itself over the events, run until all rows there are read, and the history it leaves."""
    path = scratch(spark, "history")
    schema = table(spark, sf_dir, "events").schema
    stream = spark.readStream.schema(schema).parquet(f"{sf_dir}/events.parquet*")
    C.streaming_history(stream, path, scratch(spark, "check"), "user_id", "ts", "event_id", 10).awaitTermination()
    return C.read_history(spark, path, schema, "user_id", "ts", "event_id", 10).select("user_id", "event_id")
