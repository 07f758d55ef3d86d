"""Queries over ordered rows: splits, permutations, merges, labels, allowances and histories (events by user)."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..operators import ordering as O
from ..operators import records as R
from ..operators import reports as P
from ..streaming import events as S
from .literals import NUMERALS
from .registry import query, table

EV = "ev AS (SELECT *, CAST(row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS BIGINT) AS pos, CAST(count(*) OVER (PARTITION BY user_id) AS BIGINT) AS n FROM events)"


def rows(spark, sf_dir):
    return O.positioned(table(spark, sf_dir, "events"), "user_id", "ts", "event_id")


@query("split_every_n", f"WITH {EV} SELECT event_id, CAST((pos - 1) // 10 AS BIGINT) + 1 AS part FROM ev")
def split_every_n(spark, sf_dir):
    return O.split_every_n(rows(spark, sf_dir), 10).select("event_id", "part")


@query("split_n_parts", "SELECT event_id, CAST(ntile(7) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS BIGINT) AS part FROM events")
def split_n_parts(spark, sf_dir):
    return O.split_n_parts(rows(spark, sf_dir), 7).select("event_id", "part")


@query("split_after", f"WITH {EV} SELECT event_id, CAST(1 + (pos > 3)::INT + (pos > 10)::INT + (pos > 25)::INT AS BIGINT) AS part FROM ev")
def split_after(spark, sf_dir):
    return O.split_after(rows(spark, sf_dir), [10, 3, 25]).select("event_id", "part")


@query("split_ranges", f"""WITH {EV}, r AS (SELECT unnest([1, 2, 3]) AS part, unnest([1, 5, 8]) AS a, unnest([3, 5, 12]) AS b)
SELECT event_id, CAST(part AS BIGINT) AS part FROM ev JOIN r ON pos BETWEEN a AND b""")
def split_ranges(spark, sf_dir):
    return O.split_ranges(rows(spark, sf_dir), "1-3,5,12-8").select("event_id", "part")


@query("compact_ranges", f"""WITH {EV}, c AS (SELECT user_id, pos, pos - row_number() OVER (PARTITION BY user_id ORDER BY pos) AS g FROM ev WHERE event_type <> 'click'),
r AS (SELECT user_id, min(pos) AS a, max(pos) AS b FROM c GROUP BY user_id, g)
SELECT user_id, string_agg(CASE WHEN a = b THEN CAST(a AS VARCHAR) ELSE a || '-' || b END, ',' ORDER BY a) AS ranges FROM r GROUP BY user_id""")
def compact_ranges(spark, sf_dir):
    return O.compact_ranges(rows(spark, sf_dir).filter("event_type <> 'click'"), "user_id")


@query("split_on_value_change", f"""WITH {EV}, v AS (SELECT *, CASE WHEN event_type <> 'error' THEN event_type END AS val FROM ev),
p AS (SELECT *, last_value(val IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS before FROM v)
SELECT event_id, CAST(1 + sum(CASE WHEN val IS NOT NULL AND before IS NOT NULL AND val <> before THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY pos) AS BIGINT) AS part FROM p""")
def split_on_value_change(spark, sf_dir):
    df = rows(spark, sf_dir).withColumn("val", F.when(F.col("event_type") != "error", F.col("event_type")))
    return O.split_on_value_change(df, "user_id", "val").select("event_id", "part")


@query("split_on_divider", f"""WITH {EV}, d AS (SELECT *, sum((event_type = 'error')::INT) OVER (PARTITION BY user_id ORDER BY pos) AS k, last_value(CASE WHEN event_type = 'error' THEN props END IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY pos) AS part_label FROM ev)
SELECT event_id, CAST(dense_rank() OVER (PARTITION BY user_id ORDER BY k) AS BIGINT) AS part, part_label FROM d WHERE event_type <> 'error'""")
def split_on_divider(spark, sf_dir):
    df = rows(spark, sf_dir).withColumn("divider", F.col("event_type") == "error")
    return O.split_on_divider(df, "user_id", "divider", "props").select("event_id", "part", "part_label")


@query("split_on_bookmark", f"WITH {EV} SELECT event_id, CAST(sum(coalesce((CASE WHEN event_type IN ('signup', 'purchase') THEN event_id % 3 END) <= 1, false)::INT) OVER (PARTITION BY user_id ORDER BY pos) AS BIGINT) AS part FROM ev")
def split_on_bookmark(spark, sf_dir):
    df = rows(spark, sf_dir).withColumn("level", F.when(F.col("event_type").isin("signup", "purchase"), F.col("event_id") % 3))
    return O.split_on_bookmark(df, "user_id", "level", 1).select("event_id", "part")


@query("split_max_size", f"""WITH RECURSIVE {EV}, sized AS (SELECT user_id, pos, event_id, CAST(floor(value * 10) AS BIGINT) AS size FROM ev),
f AS (SELECT user_id, pos, event_id, size AS used, 1 AS part FROM sized WHERE pos = 1
  UNION ALL SELECT s.user_id, s.pos, s.event_id, CASE WHEN f.used + s.size > 500 THEN s.size ELSE f.used + s.size END, CASE WHEN f.used + s.size > 500 THEN f.part + 1 ELSE f.part END FROM f JOIN sized s ON s.user_id = f.user_id AND s.pos = f.pos + 1)
SELECT event_id, CAST(part AS BIGINT) AS part FROM f""")
def split_max_size(spark, sf_dir):
    df = rows(spark, sf_dir).select("user_id", "pos", "event_id", F.floor(F.col("value") * 10).cast("long").alias("size"))
    return O.split_max_size(df, "user_id", "size", 500).select("event_id", "part")


@query("interleave", f"""WITH {EV} SELECT event_id, CAST(row_number() OVER (ORDER BY CASE WHEN user_id % 2 = 1 THEN n + 1 - pos ELSE pos END, user_id) AS BIGINT) AS out_pos FROM ev""")
def interleave(spark, sf_dir):
    """A source of rows is a user; odd users are read backwards."""
    place = F.when(F.col("user_id") % 2 == 1, F.col("n") + 1 - F.col("pos")).otherwise(F.col("pos"))
    return O.interleave(rows(spark, sf_dir).withColumn("round", place), "user_id").select("event_id", "out_pos")


@query("insert_at", f"""WITH {EV}, b AS (SELECT * FROM ev WHERE event_type <> 'signup'), bp AS (SELECT user_id, event_id, row_number() OVER (PARTITION BY user_id ORDER BY pos) AS p, count(*) OVER (PARTITION BY user_id) AS c FROM b),
x AS (SELECT user_id, event_id, row_number() OVER (PARTITION BY user_id ORDER BY pos) AS p, count(*) OVER (PARTITION BY user_id) AS c FROM ev WHERE event_type = 'signup'), nb AS (SELECT user_id, max(c) AS c FROM bp GROUP BY user_id), nx AS (SELECT user_id, max(c) AS c FROM x GROUP BY user_id)
SELECT event_id, CAST(p + CASE WHEN p > least(20, bp.c) THEN coalesce(nx.c, 0) ELSE 0 END AS BIGINT) AS out_pos, false AS inserted FROM bp LEFT JOIN nx USING (user_id)
UNION ALL SELECT event_id, CAST(least(20, coalesce(nb.c, 0)) + p AS BIGINT), true FROM x LEFT JOIN nb USING (user_id)""")
def insert_at(spark, sf_dir):
    e = table(spark, sf_dir, "events")
    base = O.positioned(e.filter("event_type <> 'signup'"), "user_id", "ts", "event_id")
    extra = O.positioned(e.filter("event_type = 'signup'"), "user_id", "ts", "event_id")
    nb, nx = e.groupBy("user_id").agg(F.sum((F.col("event_type") != "signup").cast("long")).alias("base_n")), e.groupBy("user_id").agg(F.sum((F.col("event_type") == "signup").cast("long")).alias("extra_n"))
    return O.insert_at(base.join(nx, "user_id"), extra.join(nb, "user_id"), 20).select("event_id", F.col("out_pos").cast("long"), "inserted")


@query("merge_plan", """WITH s AS (SELECT s_suppkey, 3 + s_suppkey % 5 AS n, s_suppkey % 4 AS k FROM supplier), p AS (SELECT s_suppkey, n, CASE k WHEN 0 THEN range(1, n + 1) WHEN 1 THEN [3, 1, 2] WHEN 2 THEN list_reverse(range(1, n + 1)) ELSE range(1, n + 1) END AS pages, k = 3 AS invalid FROM s)
SELECT s_suppkey, list_transform(pages, lambda x: CAST(x AS BIGINT)) AS pages, CAST(sum(len(pages)) OVER (ORDER BY s_suppkey DESC) - len(pages) + 1 AS BIGINT) AS first_out, invalid FROM p""")
def merge_plan(spark, sf_dir):
    """Sources by natural name, last first; some with a subset, one in four with one that cannot be read."""
    k, n = F.col("s_suppkey") % 4, (3 + F.col("s_suppkey") % 5).cast("long")
    subset = F.when(k == 1, " 3, 1-2,3 ").when(k == 2, F.concat(n.cast("string"), F.lit(" - 1"))).when(k == 3, "1,x")
    s = table(spark, sf_dir, "supplier").select("s_suppkey", F.col("s_name").alias("name"), n.alias("n_pages"), subset.alias("subset"))
    return O.merge_plan(s, "s_suppkey", O.natural_key(F.col("name")).desc()).select("s_suppkey", "pages", "first_out", "invalid")


@query("toc_positions", """WITH s AS (SELECT n_nationkey, 1 + n_nationkey % 4 AS pages FROM nation)
SELECT n_nationkey, CAST(1 + 2 + sum(pages + 1) OVER (ORDER BY n_nationkey) - pages AS BIGINT) AS starts_at FROM s""")
def toc_positions(spark, sf_dir):
    """Cover and contents take two pages; a separator goes before each source."""
    s = table(spark, sf_dir, "nation").select("n_nationkey", (1 + F.col("n_nationkey") % 4).alias("pages"))
    return O.toc_positions(s, "pages", ["n_nationkey"]).select("n_nationkey", "starts_at")


@query("serial_stamp", """WITH f AS (SELECT user_id, count(*) AS n FROM events GROUP BY user_id), b AS (SELECT *, sum(n) OVER (ORDER BY user_id) - n AS before FROM f),
x AS (SELECT user_id, CAST(995 + before * 5 AS BIGINT) AS first_number, CAST(995 + (before + n - 1) * 5 AS BIGINT) AS last_number FROM b)
SELECT user_id, CASE WHEN length(CAST(first_number AS VARCHAR)) < 4 THEN lpad(CAST(first_number AS VARCHAR), 4, '0') ELSE CAST(first_number AS VARCHAR) END AS first_stamp,
  CASE WHEN length(CAST(last_number AS VARCHAR)) < 4 THEN lpad(CAST(last_number AS VARCHAR), 4, '0') ELSE CAST(last_number AS VARCHAR) END AS last_stamp, length(CAST(last_number AS VARCHAR)) > 4 AS overflow FROM x""")
def serial_stamp(spark, sf_dir):
    files = table(spark, sf_dir, "events").groupBy("user_id").agg(F.count("*").alias("n"))
    return O.serial_stamps(files, ["user_id"], 995, 5, 4).select("user_id", "first_stamp", "last_stamp", "overflow")


@query("split_by_source", f"""WITH {EV}, k AS (SELECT user_id, pos FROM ev WHERE value > 120), g AS (SELECT user_id, pos, pos - row_number() OVER (PARTITION BY user_id ORDER BY pos) AS g FROM k), r AS (SELECT user_id, min(pos) AS a, max(pos) AS b, count(*) AS n FROM g GROUP BY user_id, g),
l AS (SELECT user_id, CAST(sum(n) AS BIGINT) AS pages, string_agg(CASE WHEN a = b THEN CAST(a AS VARCHAR) ELSE a || '-' || b END, ',' ORDER BY a) AS numbers FROM r GROUP BY user_id)
SELECT user_id, row_number() OVER (ORDER BY user_id) AS part, pages, numbers, CAST(sum(pages) OVER (ORDER BY user_id) - pages AS BIGINT) AS before, CAST(sum(pages) OVER () AS BIGINT) AS total FROM l""")
def split_by_source(spark, sf_dir):
    """The parts of source_tray's sources that have pages left, with their page numbers and the pages before them."""
    return P.split_by_source(source_tray(spark, sf_dir), "user_id", "user_id")


@query("permute", f"""WITH {EV} SELECT event_id, n + 1 - pos AS reversed, CAST(CASE WHEN pos % 2 = 1 THEN (pos + 1) // 2 ELSE ceil(n / 2.0::DOUBLE) + pos // 2 END AS BIGINT) AS odd_even,
  CAST(CASE WHEN pos <= ceil(n / 2.0::DOUBLE) THEN 2 * pos - 1 ELSE 2 * (pos - ceil(n / 2.0::DOUBLE)) END AS BIGINT) AS merged, CAST(CASE WHEN pos <= ceil(n / 2.0::DOUBLE) THEN 2 * pos - 1 ELSE 2 * (n + 1 - pos) END AS BIGINT) AS duplex FROM ev""")
def permute(spark, sf_dir):
    p = O.permuted
    return rows(spark, sf_dir).select("event_id", p("reverse").alias("reversed"), p("odd_even").alias("odd_even"), p("odd_even_merge").alias("merged"), p("duplex").alias("duplex"))


@query("order_expression", f"""WITH {EV}, o AS (SELECT unnest([7, 1, 2, 3, 9, 8, 3]) AS p, unnest([1, 2, 3, 4, 5, 6, 7]) AS k) SELECT event_id, CAST(k AS BIGINT) AS out_pos FROM ev JOIN o ON p = pos""")
def order_expression(spark, sf_dir):
    return O.arrange(rows(spark, sf_dir), "7,1-3;9-8,3", 50).select("event_id", "out_pos")


@query("select_range_odd_even", f"WITH {EV} SELECT event_id, pos % 2 = 1 AS odd, pos % 2 = 0 AS even, pos BETWEEN 5 AND 15 AS in_range, NOT pos BETWEEN 5 AND 15 AS inverted FROM ev")
def select_range_odd_even(spark, sf_dir):
    p = F.col("pos")
    return rows(spark, sf_dir).select("event_id", (p % 2 == 1).alias("odd"), (p % 2 == 0).alias("even"), p.between(5, 15).alias("in_range"), (~p.between(5, 15)).alias("inverted"))


@query("tile_grid", """WITH p AS (SELECT p_partkey, 200.0::DOUBLE + p_size * 20 AS width, 300.0::DOUBLE + p_partkey % 700 AS height FROM part),
c AS (SELECT *, greatest(1, ceil((width - 10) / 200)) AS ux, greatest(1, ceil((height - 10) / 287)) AS uy, greatest(1, ceil((width - 10) / 287)) AS lx, greatest(1, ceil((height - 10) / 200)) AS ly FROM p),
d AS (SELECT *, lx * ly < ux * uy AS turn FROM c), e AS (SELECT *, CASE WHEN turn THEN 297.0::DOUBLE ELSE 210.0::DOUBLE END AS tw, CASE WHEN turn THEN 210.0::DOUBLE ELSE 297.0::DOUBLE END AS th, CAST(CASE WHEN turn THEN lx ELSE ux END AS BIGINT) AS nx, CAST(CASE WHEN turn THEN ly ELSE uy END AS BIGINT) AS ny FROM d),
x AS (SELECT *, unnest(range(0, nx)) AS "column" FROM e), y AS (SELECT *, unnest(range(0, ny)) AS "row" FROM x)
SELECT p_partkey, "column", "row", greatest(0.0::DOUBLE, least("column" * (tw - 10), width - tw)) AS x, greatest(0.0::DOUBLE, least("row" * (th - 10), height - th)) AS y FROM y""")
def tile_grid(spark, sf_dir):
    p = table(spark, sf_dir, "part").select("p_partkey", (200.0 + F.col("p_size") * 20).alias("width"), (300.0 + F.col("p_partkey") % 700).alias("height"))
    return O.tile_grid(p, 210.0, 297.0, 10.0).select("p_partkey", F.col("column").cast("long"), F.col("row").cast("long"), "x", "y")


@query("gutter_valley", f"""WITH {EV}, i AS (SELECT user_id, pos - 1 AS x, CASE WHEN event_type IN ('click', 'view', 'error') THEN 0 ELSE 1 END AS ink, n AS width FROM ev),
l AS (SELECT *, x - row_number() OVER (PARTITION BY user_id ORDER BY x) AS g FROM i WHERE abs(x - (width - 1) / 2.0::DOUBLE) <= 0.18::DOUBLE * width AND ink <= 0),
r AS (SELECT user_id, min(x) AS "start", max(x) AS "end", max(width) AS width FROM l GROUP BY user_id, g),
k AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY "end" - "start" DESC, abs(("start" + "end") / 2.0::DOUBLE - (width - 1) / 2.0::DOUBLE), "start") AS k FROM r) SELECT user_id, "start", "end" FROM k WHERE k = 1""")
def gutter_valley(spark, sf_dir):
    ink = F.when(F.col("event_type").isin("click", "view", "error"), 0).otherwise(1)
    return O.gutter_valley(rows(spark, sf_dir).select("user_id", (F.col("pos") - 1).alias("x"), ink.alias("ink"), F.col("n").alias("width")), "user_id")


_ROMAN = "CASE WHEN n BETWEEN 1 AND 3999 THEN " + " || ".join(f"repeat('{s}', CAST((n{''.join(f' % {w}' for w, _ in NUMERALS[:k])}) // {v} AS BIGINT))" for k, (v, s) in enumerate(NUMERALS)) + " ELSE CAST(n AS VARCHAR) END"



@query("page_label_asof", f"""WITH {EV}, r AS (SELECT user_id, pos - pos % 2 AS start, pos, CASE event_id % 4 WHEN 0 THEN 'roman-lower' WHEN 1 THEN 'letters-upper' WHEN 2 THEN 'none' ELSE 'decimal' END AS style, 'P-' AS prefix, event_id % 5 AS first FROM ev WHERE event_type IN ('signup', 'error')),
u AS (SELECT user_id, start, arg_max(style, pos) AS style, arg_max(prefix, pos) AS prefix, arg_max(greatest(1, first), pos) AS first FROM r WHERE start >= 1 GROUP BY 1, 2),
j AS (SELECT e.user_id, e.pos, u.*, row_number() OVER (PARTITION BY e.event_id ORDER BY u.start DESC NULLS LAST) AS k FROM ev e LEFT JOIN u ON u.user_id = e.user_id AND u.start <= e.pos),
l AS (SELECT user_id, pos, coalesce(style, 'decimal') AS style, coalesce(prefix, '') AS prefix, CAST(pos - coalesce(start, 1) + coalesce(first, 1) AS BIGINT) AS n FROM j WHERE k = 1),
t AS (SELECT user_id, pos, style, prefix, n AS number, prefix || CASE style WHEN 'decimal' THEN CAST(n AS VARCHAR) WHEN 'roman-lower' THEN lower({_ROMAN}) WHEN 'letters-upper' THEN repeat(chr(CAST((n - 1) % 26 + 65 AS INT)), CAST(ceil(n / 26.0::DOUBLE) AS BIGINT)) ELSE '' END AS label FROM l)
SELECT *, count(*) OVER (PARTITION BY user_id, label) > 1 AS duplicate FROM t""")
def page_label_asof(spark, sf_dir):
    """Ranges of signups and errors, of which some start at one page; labels that a user's pages share are marked."""
    df, k = rows(spark, sf_dir), F.col("event_id")
    style = F.when(k % 4 == 0, "roman-lower").when(k % 4 == 1, "letters-upper").when(k % 4 == 2, "none").otherwise("decimal")
    ranges = df.filter("event_type IN ('signup', 'error')").select("user_id", (F.col("pos") - F.col("pos") % 2).alias("start"), style.alias("style"), F.lit("P-").alias("prefix"), (k % 5).alias("first"), F.col("pos").alias("at"))
    out = O.label_asof(df, ranges, "user_id", "at")
    shared = O.duplicate_labels(out, "user_id").select("user_id", "label", F.lit(True).alias("_d"))
    return out.join(shared, ["user_id", "label"], "left").select("user_id", "pos", "style", "prefix", "number", "label", F.coalesce("_d", F.lit(False)).alias("duplicate"))


@query("to_roman", f"SELECT p_partkey, {_ROMAN} AS roman, CASE WHEN n >= 1 THEN repeat(chr(CAST((n - 1) % 26 + 97 AS INT)), CAST(ceil(n / 26.0::DOUBLE) AS BIGINT)) ELSE CAST(n AS VARCHAR) END AS letters FROM (SELECT p_partkey, p_partkey * 3 % 4100 AS n FROM part)")
def to_roman(spark, sf_dir):
    n = F.col("p_partkey") * 3 % 4100
    return table(spark, sf_dir, "part").select("p_partkey", O.to_roman(n).alias("roman"), O.to_letters(n).alias("letters"))


@query("topk_per_group", "SELECT event_type, event_id, k AS rank FROM (SELECT *, row_number() OVER (PARTITION BY event_type ORDER BY value DESC, event_id) AS k FROM events) WHERE k <= 10")
def topk_per_group(spark, sf_dir):
    w = Window.partitionBy("event_type").orderBy(F.desc("value"), "event_id")
    return table(spark, sf_dir, "events").withColumn("rank", F.row_number().over(w).cast("long")).filter("rank <= 10").select("event_type", "event_id", "rank")


@query("keep_first", "SELECT user_id, event_type, min(event_id) AS event_id FROM (SELECT *, row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts, event_id) AS k FROM events) WHERE k = 1 GROUP BY user_id, event_type")
def keep_first(spark, sf_dir):
    e = table(spark, sf_dir, "events")
    return e.groupBy("user_id", "event_type").agg(F.min(F.struct("ts", "event_id")).alias("f")).select("user_id", "event_type", "f.event_id")


@query("recent_distinct", "SELECT user_id, event_type, last_ts, rank FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY last_ts DESC, event_type) AS rank FROM (SELECT user_id, event_type, max(ts) AS last_ts FROM events GROUP BY 1, 2)) WHERE rank <= 3")
def recent_distinct(spark, sf_dir):
    return S.recent_distinct(table(spark, sf_dir, "events"), "user_id", "event_type", "ts", 3)


@query("history_last_n", "SELECT user_id, event_id FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS k FROM events) WHERE k <= 20")
def history_last_n(spark, sf_dir):
    return S.history_last_n(table(spark, sf_dir, "events"), "user_id", "ts", "event_id", 20).select("user_id", "event_id")


@query("cooldown_dedup", """WITH RECURSIVE k AS (SELECT event_id, user_id, epoch_us(ts) / 1000.0::DOUBLE AS ms, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS p FROM events),
f AS (SELECT event_id, user_id, p, ms AS last, true AS kept FROM k WHERE p = 1
  UNION ALL SELECT k.event_id, k.user_id, k.p, CASE WHEN k.ms - f.last >= 21600000 THEN k.ms ELSE f.last END, k.ms - f.last >= 21600000 FROM f JOIN k ON k.user_id = f.user_id AND k.p = f.p + 1)
SELECT event_id, user_id FROM f WHERE kept""")
def cooldown_dedup(spark, sf_dir):
    return S.cooldown_dedup(table(spark, sf_dir, "events"), "user_id", "ts", "event_id", 6 * 3600 * 1000).select("event_id", "user_id")


@query("session_dedup", """WITH l AS (SELECT *, sum((event_type = 'error')::INT) OVER (PARTITION BY user_id, props ORDER BY ts, event_id) AS life FROM events)
SELECT event_id FROM (SELECT *, row_number() OVER (PARTITION BY user_id, props, life ORDER BY ts, event_id) AS k FROM l WHERE event_type <> 'error') WHERE k = 1""")
def session_dedup(spark, sf_dir):
    """Errors take a payload away, so the next one is let in again."""
    return S.session_dedup(table(spark, sf_dir, "events"), ["user_id", "props"], "ts", "event_id", F.col("event_type") == "error").select("event_id")


@query("daily_allowance", """WITH d AS (SELECT *, CAST(ts AS DATE) AS day FROM events), f AS (SELECT user_id, day, event_type, min(ts) AS t, arg_min(event_id, (ts, event_id)) AS e FROM d GROUP BY 1, 2, 3),
r AS (SELECT user_id, day, event_type, row_number() OVER (PARTITION BY user_id, day ORDER BY t, e) <= 2 AS granted FROM f) SELECT event_id, granted FROM d JOIN r USING (user_id, day, event_type)""")
def daily_allowance(spark, sf_dir):
    return S.daily_allowance(table(spark, sf_dir, "events"), "user_id", "event_type", "ts", "event_id", 2).select("event_id", "granted")


@query("quota_gate", f"""WITH {EV}, b AS (SELECT event_id, event_type, coalesce(sum((event_type <> 'error')::INT) OVER (PARTITION BY user_id ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS done FROM ev)
SELECT event_id, CASE WHEN done >= 30 THEN 'skipped_quota' WHEN event_type <> 'error' THEN 'completed' ELSE 'failed' END AS status FROM b""")
def quota_gate(spark, sf_dir):
    df = rows(spark, sf_dir).withColumn("ok", F.col("event_type") != "error")
    return S.quota_gate(df, "user_id", "pos", "ok", 30).select("event_id", "status")


@query("batch_run_summary", f"""WITH {EV}, b AS (SELECT user_id, event_type, coalesce(sum((event_type <> 'error')::INT) OVER (PARTITION BY user_id ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS done FROM ev),
s AS (SELECT user_id, CASE WHEN done >= 30 THEN 'skipped' WHEN event_type <> 'error' THEN 'completed' ELSE 'failed' END AS status FROM b)
SELECT user_id, count(*) FILTER (status = 'completed') AS completed, count(*) FILTER (status = 'failed') AS failed, count(*) FILTER (status = 'skipped') AS skipped, count(*) FILTER (status = 'completed') > 0 AS success FROM s GROUP BY user_id""")
def batch_run_summary(spark, sf_dir):
    df = rows(spark, sf_dir).withColumn("ok", F.col("event_type") != "error")
    n = lambda s: F.sum((F.col("status") == s).cast("long"))
    return S.quota_gate(df, "user_id", "pos", "ok", 30).groupBy("user_id").agg(n("completed").alias("completed"), n("failed").alias("failed"), n("skipped_quota").alias("skipped"), (n("completed") > 0).alias("success"))


@query("date_shift", "SELECT event_id, coalesce(CASE WHEN event_id % 3 = 1 THEN ts END, CASE WHEN event_id % 3 = 2 THEN ts + INTERVAL 1 DAY END, TIMESTAMP '2024-01-01') + INTERVAL 2 DAY - INTERVAL 3 HOUR + INTERVAL 30 SECOND AS shifted, TIMESTAMP '2020-02-29 12:00:00' AS forced FROM events")
def date_shift(spark, sf_dir):
    """Dates taken, else created, else modified, two days on, three hours back; and one that takes the place of all."""
    k, ts = F.col("event_id") % 3, F.col("ts")
    dates = F.when(k == 1, ts), F.when(k == 2, ts + F.expr("INTERVAL 1 DAY")), F.lit("2024-01-01").cast("timestamp_ntz")
    return table(spark, sf_dir, "events").select("event_id", P.date_shift(*dates, days=2, hours=-3, seconds=30).alias("shifted"), P.date_shift(*dates, days=2, override=dt.datetime(2020, 2, 29, 12)).alias("forced"))


@query("history_filter", "SELECT event_id, event_type FROM events WHERE contains(lower(event_type), 'i') AND contains(lower(props), '7')")
def history_filter(spark, sf_dir):
    return table(spark, sf_dir, "events").filter(F.contains(F.lower("event_type"), F.lit("i")) & F.contains(F.lower("props"), F.lit("7"))).select("event_id", "event_type")


@query("catalog_search", "SELECT p_partkey FROM part WHERE contains(lower(p_name), 'ring') OR contains(lower(p_type), 'econ') OR len(list_filter(string_split(p_name, ' '), lambda x: contains(lower(x), 'red'))) > 0")
def catalog_search(spark, sf_dir):
    hit = F.contains(F.lower("p_name"), F.lit("ring")) | F.contains(F.lower("p_type"), F.lit("econ")) | F.exists(F.split("p_name", " "), lambda x: F.contains(F.lower(x), F.lit("red")))
    return table(spark, sf_dir, "part").filter(hit).select("p_partkey")


@query("related_items", """WITH l AS (SELECT x.p_partkey, o.p_partkey AS other, place FROM (SELECT p_partkey, unnest([p_partkey + 7, p_partkey, p_partkey + 3]) AS o, unnest([1, 2, 3]) AS place FROM part WHERE p_partkey % 3 = 0) x JOIN part o ON o.p_partkey = x.o AND o.p_partkey <> x.p_partkey),
u AS (SELECT p_partkey, other, place, 0 AS p FROM l UNION ALL SELECT a.p_partkey, b.p_partkey, NULL, 1 FROM part a JOIN part b ON a.p_brand = b.p_brand AND a.p_size = b.p_size AND a.p_partkey <> b.p_partkey WHERE (a.p_partkey, b.p_partkey) NOT IN (SELECT (p_partkey, other) FROM l))
SELECT p_partkey, other, rank FROM (SELECT *, row_number() OVER (PARTITION BY p_partkey ORDER BY p, place, other) AS rank FROM u) WHERE rank <= 4""")
def related_items(spark, sf_dir):
    """Explicit relations first, then items of the same brand and size."""
    p, k = table(spark, sf_dir, "part"), F.col("p_partkey")
    links = p.filter(k % 3 == 0).select("p_partkey", F.posexplode(F.array(k + 7, k, k + 3)).alias("place", "other"))
    return R.related(p, "p_partkey", ["p_brand", "p_size"], links, 4)


@query("placement_peak", """WITH p AS (SELECT l_partkey, l_orderkey, l_extendedprice / l_quantity AS dpi FROM lineitem), o AS (SELECT DISTINCT l_partkey, l_orderkey FROM p), b AS (SELECT l_orderkey, sum(p_size) AS bytes FROM o JOIN part ON p_partkey = l_partkey GROUP BY 1),
k AS (SELECT l_partkey, max(dpi) AS peak, count(DISTINCT l_orderkey) AS n_pages, min(l_orderkey) AS first_page, max(l_orderkey) AS last_page FROM p GROUP BY 1)
SELECT l_partkey, peak, n_pages, first_page, last_page, CAST(bytes AS BIGINT) AS first_page_bytes FROM k JOIN b ON l_orderkey = first_page""")
def placement_peak(spark, sf_dir):
    """Parts as images, orders as pages: the peak of each image, its pages, and what the images of its first page weigh."""
    placed = table(spark, sf_dir, "lineitem").select("l_partkey", "l_orderkey", (F.col("l_extendedprice") / F.col("l_quantity")).alias("dpi"))
    images = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("l_partkey"), "p_size")
    weights = P.image_bytes_by_page(placed, images, "l_partkey", "l_orderkey", "p_size").select(F.col("l_orderkey").alias("first_page"), F.col("bytes").alias("first_page_bytes"))
    return P.placement_peaks(placed, "l_partkey", "l_orderkey", "dpi").join(weights, "first_page").select("l_partkey", "peak", "n_pages", "first_page", "last_page", "first_page_bytes")


@query("source_tray", f"""WITH {EV}, k AS (SELECT user_id, pos FROM ev WHERE value > 120), g AS (SELECT user_id, pos, pos - row_number() OVER (PARTITION BY user_id ORDER BY pos) AS g FROM k), r AS (SELECT user_id, min(pos) AS a, max(pos) AS b, count(*) AS n FROM g GROUP BY user_id, g),
l AS (SELECT user_id, sum(n) AS n, string_agg(CASE WHEN a = b THEN CAST(a AS VARCHAR) ELSE a || '-' || b END, ',' ORDER BY a) AS numbers FROM r GROUP BY user_id)
SELECT user_id, original, CAST(coalesce(l.n, 0) AS BIGINT) AS remaining, l.n IS NULL AS emptied, coalesce(numbers, '') AS numbers FROM (SELECT user_id, count(*) AS original FROM events GROUP BY 1) LEFT JOIN l USING (user_id)""")
def source_tray(spark, sf_dir):
    """Users as sources, their events over 120 as the pages left; sources with none left stay."""
    pages = rows(spark, sf_dir)
    return P.source_tray(pages.groupBy("user_id").agg(F.count("*").alias("n")), pages.filter("value > 120"), "user_id", "pos", "n")


@query("confidence_stats", """WITH r AS (SELECT event_type, floor(least(100, value) + 0.5) AS r, least(100, value) AS v FROM events), c AS (SELECT event_type, count(*) AS n, count(*) FILTER (r >= 85) AS high, count(*) FILTER (r >= 60 AND r < 85) AS medium, count(*) FILTER (r < 60) AS low, floor(sum(r)::DOUBLE / count(*) + 0.5) AS a FROM r GROUP BY event_type)
SELECT event_type, high, medium, low, CAST(floor(high * 100.0::DOUBLE / n + 0.5) AS BIGINT) AS high_percent, CAST(floor(medium * 100.0::DOUBLE / n + 0.5) AS BIGINT) AS medium_percent, CAST(floor(low * 100.0::DOUBLE / n + 0.5) AS BIGINT) AS low_percent, CAST(a AS BIGINT) AS average FROM c""")
def confidence_stats(spark, sf_dir):
    e = table(spark, sf_dir, "events").withColumn("confidence", F.least(F.lit(100), F.col("value")))
    return O.confidence_stats(e, "confidence", ["event_type"])


@query("group_by_size", """WITH s AS (SELECT p_partkey, CASE WHEN p_partkey % 2 = 1 THEN h ELSE w END AS w, CASE WHEN p_partkey % 2 = 1 THEN w ELSE h END AS h FROM (SELECT p_partkey, floor(p_size * 10 + 0.3 + 0.5) AS w, floor(300.6 - p_size + 0.5) AS h FROM part)),
g AS (SELECT CAST(w AS BIGINT) AS width_pt, CAST(h AS BIGINT) AS height_pt, CASE WHEN abs(w - h) < 1 THEN 'square' WHEN w > h THEN 'landscape' ELSE 'portrait' END AS orientation, count(*) AS n, min(p_partkey) AS first FROM s GROUP BY 1, 2, 3)
SELECT *, row_number() OVER (ORDER BY n DESC, first) AS rank, floor(width_pt / (72 / 25.4::DOUBLE) * 10 + 0.5) / 10 AS width_mm, floor(height_pt / (72 / 25.4::DOUBLE) * 10 + 0.5) / 10 AS height_mm FROM g""")
def group_by_size(spark, sf_dir):
    """Sizes after rotation (odd keys lie on their side), in fractions of a point."""
    turn = F.when(F.col("p_partkey") % 2 == 1, F.when(F.col("p_partkey") % 3 == 0, -90).otherwise(270)).otherwise(F.when(F.col("p_partkey") % 3 == 0, 180))
    p = table(spark, sf_dir, "part").select("p_partkey", (F.col("p_size") * 10 + 0.3).alias("w"), (300.6 - F.col("p_size")).alias("h"), turn.alias("turn"))
    return P.group_by_size(P.with_page_size(p, "w", "h", F.col("turn")), "p_partkey")


@query("orientation_vote", """WITH e AS (SELECT user_id % 40 AS page, CASE WHEN user_id % 3 = 0 AND event_id % 10 > 0 THEN 90 ELSE event_id % 4 * 90 END AS angle, CAST(floor(value) AS BIGINT) AS chars FROM events WHERE user_id % 40 > 0 OR event_id < 5), a AS (SELECT page, angle, sum(chars) AS w FROM e GROUP BY 1, 2), t AS (SELECT page, sum(w) AS chars, max(w) AS top, arg_max(angle, (w, -angle)) AS angle FROM a GROUP BY page)
SELECT page, angle, CAST(chars AS BIGINT) AS chars, CASE WHEN chars < 10 OR top::DOUBLE / greatest(1, chars) < 0.7 THEN 'review' WHEN angle = 0 THEN 'upright' ELSE 'rotate' END AS decision FROM t""")
def orientation_vote(spark, sf_dir):
    """Events as runs of text on 40 pages; a third of the users mostly write at 90 degrees."""
    k, u = F.col("event_id"), F.col("user_id")
    e = table(spark, sf_dir, "events").filter((u % 40 > 0) | (k < 5)).select((u % 40).alias("page"), F.when((u % 3 == 0) & (k % 10 > 0), 90).otherwise(k % 4 * 90).cast("long").alias("angle"), F.floor("value").cast("long").alias("chars"))
    return O.orientation_vote(e, "page", "angle", "chars")


@query("blank_report", "SELECT user_id, count(*) AS pages, count(*) FILTER (value <= 12 AND event_type <> 'purchase') AS blank, coalesce(min(event_id) FILTER (value <= 12 AND event_type <> 'purchase'), -1) AS first_blank FROM events GROUP BY user_id")
def blank_report(spark, sf_dir):
    """Blank: no text (no purchase) and ink at most the threshold."""
    blank = (F.col("value") <= 12) & (F.col("event_type") != "purchase")
    return table(spark, sf_dir, "events").groupBy("user_id").agg(F.count("*").alias("pages"), F.sum(blank.cast("long")).alias("blank"), F.coalesce(F.min(F.when(blank, F.col("event_id"))), F.lit(-1)).alias("first_blank"))


@query("comment_summary", """WITH t AS (SELECT conv_id, conv_id % 7 AS page, conv_id * 37 % 101 AS y, max(turn) % 2 = 0 AS resolved, count(*) - 1 AS replies FROM conversations GROUP BY conv_id)
SELECT conv_id, page, row_number() OVER (ORDER BY page, y, conv_id) AS position, CASE WHEN resolved THEN 'Resolved' ELSE 'Open' END AS status, replies FROM t""")
def comment_summary(spark, sf_dir):
    """Conversations as threads on pages: their first turn opens them, the others are replies."""
    c, k = table(spark, sf_dir, "conversations"), F.col("conv_id")
    first = c.groupBy("conv_id").agg(F.min("turn").alias("turn"), (F.max("turn") % 2 == 0).alias("resolved"))
    threads = first.select("conv_id", (k % 7).alias("page"), (k * 37 % 101).alias("y"), "resolved")
    replies = c.join(first.select("conv_id", F.col("turn").alias("_first")), "conv_id").filter("turn > _first")
    return P.comment_summary(threads, replies, "conv_id", "page", "y", "resolved").select("conv_id", "page", "position", "status", "replies")


@query("to_letters", "SELECT o_orderkey, CASE WHEN n >= 1 THEN repeat(chr(CAST((n - 1) % 26 + 97 AS INT)), CAST(ceil(n / 26.0::DOUBLE) AS BIGINT)) ELSE CAST(n AS VARCHAR) END AS letters FROM (SELECT o_orderkey, o_orderkey % 80 AS n FROM orders)")
def to_letters(spark, sf_dir):
    return table(spark, sf_dir, "orders").select("o_orderkey", O.to_letters(F.col("o_orderkey") % 80).alias("letters"))
