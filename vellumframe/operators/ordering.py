"""Splits, merges and orders of positioned rows. Rows carry doc, pos (from 1) and n (rows of the doc).

Plans are projections, or running values over ranges of a document's rows; nothing leaves the executors, and a document
that holds a third of all rows is spread over tasks.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources.shared import stage
from .running import along


def positioned(df: DataFrame, doc: str, *order: str) -> DataFrame:
    """Adds pos (from 1, in the given order) and n within each document."""
    one = F.lit(1).cast("long")
    out = along(df, [doc], list(order), before={"pos": one}, total={"n": one})
    return out.withColumn("pos", F.col("pos") + 1)


def split_every_n(df: DataFrame, size: int) -> DataFrame:
    return df.withColumn("part", F.floor((F.col("pos") - 1) / size).cast("long") + 1)


def split_n_parts(df: DataFrame, parts: int) -> DataFrame:
    """At most `parts` parts of nearly equal size, longer ones first."""
    k = F.least(F.lit(parts), F.col("n"))
    short, extra = F.floor(F.col("n") / k), F.col("n") % k
    long = extra * (short + 1)
    part = F.when(F.col("pos") <= long, F.floor((F.col("pos") - 1) / (short + 1))).otherwise(extra + F.floor((F.col("pos") - 1 - long) / F.greatest(F.lit(1), short)))
    return df.withColumn("part", part.cast("long") + 1)


def split_after(df: DataFrame, positions: list[int]) -> DataFrame:
    """A new part after each listed position."""
    return df.withColumn("part", sum(((F.col("pos") > p).cast("long") for p in sorted(set(positions))), F.lit(1).cast("long")))


def parse_ranges(text: str) -> list[tuple[int, int]]:
    """`1-3,5` as inclusive ranges; a descending range is read upwards."""
    out = []
    for part in filter(None, (p.strip() for p in text.split(","))):
        m = re.fullmatch(r"(\d+)(?:\s*-\s*(\d+))?", part)
        if not m:
            raise ValueError(f"not a range: {part!r}")
        a, b = int(m[1]), int(m[2] or m[1])
        out.append((min(a, b), max(a, b)))
    return out


def split_ranges(df: DataFrame, text: str) -> DataFrame:
    """Rows of each comma range as a part of its own; a row in two ranges is in both parts."""
    spans = F.array(*[F.struct(F.lit(k + 1).cast("long").alias("part"), F.lit(a).alias("a"), F.lit(b).alias("b")) for k, (a, b) in enumerate(parse_ranges(text))])
    return df.withColumn("_r", F.explode(F.filter(spans, lambda r: F.col("pos").between(r["a"], r["b"])))).withColumn("part", F.col("_r.part")).drop("_r")


def compact_ranges(df: DataFrame, doc: str) -> DataFrame:
    """Positions back to compact text per document: runs as a-b."""
    placed = along(df.select(doc, "pos"), [doc], ["pos"], before={"_k": F.lit(1).cast("long")})
    runs = placed.withColumn("_g", F.col("pos") - F.col("_k")).groupBy(doc, "_g").agg(F.min("pos").alias("a"), F.max("pos").alias("b"))
    name = F.when(F.col("a") == F.col("b"), F.col("a").cast("string")).otherwise(F.concat_ws("-", "a", "b"))
    return runs.groupBy(doc).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("a", name.alias("t")))), lambda x: x["t"]), ",").alias("ranges"))


def split_on_value_change(df: DataFrame, doc: str, value: str) -> DataFrame:
    """A new part where a non-null value differs from the last non-null one; nulls change nothing."""
    seen = along(df.filter(F.col(value).isNotNull()).select(doc, "pos", F.col(value).alias("_v")), [doc], ["pos"], before={"_k": F.lit(1).cast("long")})
    # a value meets the one before it by their places among the values
    one, other = seen.alias("one"), seen.select(F.col(doc).alias("_d"), (F.col("_k") + 1).alias("_n"), F.col("_v").alias("_u")).alias("other")
    new = one.join(other, F.col(f"one.{doc}").eqNullSafe(F.col("_d")) & (F.col("_k") == F.col("_n")) & (F.col("_v") != F.col("_u"))).select(F.col(f"one.{doc}").alias("_d"), F.col("pos").alias("_p"), F.lit(1).cast("long").alias("_c"))
    marked = df.join(new, df[doc].eqNullSafe(new["_d"]) & (df["pos"] == new["_p"]), "left").select(*[df[c] for c in df.columns], F.coalesce("_c", F.lit(0)).alias("_c"))
    return along(marked, [doc], ["pos"], before={"part": F.col("_c")}).withColumn("part", F.col("part") + F.col("_c") + 1).drop("_c")


def split_on_divider(df: DataFrame, doc: str, divider: str, label: str) -> DataFrame:
    """Divider rows go; the next content row opens a part, labelled by the last divider before it."""
    shown = F.when(F.col(divider), F.struct(F.col(label).alias("v")))
    df = along(df, [doc], ["pos"], before={"_d": F.col(divider).cast("long")}, last={"_l": shown}).filter(~F.col(divider))
    parts = along(df.select(doc, "_d").distinct(), [doc], ["_d"], before={"part": F.lit(1).cast("long")}).select(F.col(doc).alias("_doc"), F.col("_d").alias("_e"), (F.col("part") + 1).alias("part"))
    joined = df.join(parts, df[doc].eqNullSafe(parts["_doc"]) & (df["_d"] == parts["_e"]))
    return joined.withColumn("part_label", F.col("_l.v")).drop("_d", "_l", "_doc", "_e")


def split_on_bookmark(df: DataFrame, doc: str, level: str, most: int) -> DataFrame:
    """A new part at rows whose bookmark level is at most `most`; rows before the first are part 0."""
    mark = F.coalesce(F.col(level) <= most, F.lit(False)).cast("long")
    return along(df.withColumn("_m", mark), [doc], ["pos"], before={"part": F.col("_m")}).withColumn("part", F.col("part") + F.col("_m")).drop("_m")


def bookmark_marks(bookmarks: DataFrame, doc: str, page: str, level: str, title: str, order: str, most: int = 1) -> DataFrame:
    """(doc, page, level, title): the shallowest bookmark of each page among those of level `most` or less, the first in
    `order` of equals."""
    top = F.min(F.struct(level, order, title)).alias("_b")
    return bookmarks.filter((F.col(level) <= most) & F.col(page).isNotNull()).groupBy(doc, page).agg(top).select(doc, page, F.col(f"_b.{level}").alias(level), F.col(f"_b.{title}").alias(title))


def greedy_starts(rows: DataFrame, group: list[str], at: str, reach: str, id: str, strict: bool = False) -> DataFrame:
    """(group, id) of the rows where a greedy walk stops: each group's first row, and from a row the first one behind it
    whose `at` is at least (strict: over) the row's `reach`. Rows of a group are ordered by at and id.

    Every row finds its next stop in one order of rows and reaches together, over ranges of it. Stops are then the rows
    that the first one leads to; a round doubles the distance that is followed, so a walk of n stops takes log2(n) rounds
    of equi-joins and no group is ever held as a whole. Stops and jumps meet by sorting: Spark reckons their size by that
    of compressed files and would send them through the driver.
    """
    # in ascending order a reach stands before the rows at it, or behind them where these do not count
    place = lambda at, kind: F.struct(F.col(at).alias("a"), F.lit(kind).alias("k"))
    asked = rows.select(*group, place(reach, 1 if strict else -1).alias("_at"), F.col(id).alias("_id"), F.lit(False).alias("_row"))
    both = rows.select(*group, place(at, 0).alias("_at"), F.col(id).alias("_id"), F.lit(True).alias("_row")).unionByName(asked)
    to = along(both, group, ["_at", "_id"], following={"_to": F.when(F.col("_row"), F.col("_id"))}).filter("not _row")
    jump = stage(to.select(*group, F.col("_id").alias("_from"), "_to").filter(F.col("_to").isNotNull() & (F.col("_to") != F.col("_from"))), "jumps")
    seen = stage(rows.groupBy(*group).agg(F.min(F.struct(at, id)).alias("_f")).select(*group, F.col(f"_f.{id}").alias("_id")), "stops")
    found = seen.count()
    while True:
        new = seen.join(jump.withColumnRenamed("_from", "_id").hint("merge"), [*group, "_id"]).select(*group, F.col("_to").alias("_id"))
        seen = stage(seen.unionByName(new).distinct(), "stops")
        if (more := seen.count()) == found:
            return seen.withColumnRenamed("_id", id)
        found = more
        onward = jump.select(*group, F.col("_from").alias("_to"), F.col("_to").alias("_far"))
        jump = stage(jump.join(onward.hint("merge"), [*group, "_to"]).select(*group, "_from", F.col("_far").alias("_to")), "jumps")


def split_max_size(df: DataFrame, doc: str, size: str, ceiling: float) -> DataFrame:
    """Adds part: greedy longest runs of rows whose sizes (0 or more) stay within the ceiling; a larger row is a part
    alone.

    With sizes summed up, a part ends before the first row whose sum exceeds the sum before the part by more than the
    ceiling, so parts are the stops of a greedy walk.
    """
    summed = along(df.select(doc, "pos", F.col(size).alias("_size")), [doc], ["pos"], before={"_end": F.col("_size")}).withColumn("_end", F.col("_end") + F.coalesce("_size", F.lit(0)))
    # a row over the ceiling is left by the very next row, also by one without a size
    place = F.struct("_end", "pos")
    reach = F.when(F.col("_size") > ceiling, F.struct(F.col("_end"), F.col("pos"))).otherwise(F.struct((F.col("_end") - F.col("_size") + ceiling).cast(dict(summed.dtypes)["_end"]).alias("_end"), F.lit(1 << 62).alias("pos")))
    starts = greedy_starts(summed.select(doc, "pos", place.alias("at"), reach.alias("reach")), [doc], "at", "reach", "pos", strict=True)
    marked = df.join(starts.withColumn("_start", F.lit(1).cast("long")).hint("merge"), [doc, "pos"], "left").withColumn("_start", F.coalesce("_start", F.lit(0).cast("long")))
    return along(marked, [doc], ["pos"], before={"part": F.col("_start")}).withColumn("part", F.col("part") + F.col("_start")).select(*df.columns, "part")


def interleave(df: DataFrame, source: str) -> DataFrame:
    """Round robin over sources by `round` (a row's turn within its source): adds out_pos. The order is that of rounds and
    of sources within them, over ranges of it."""
    return along(df, [], ["round", source], before={"out_pos": F.lit(1).cast("long")}).withColumn("out_pos", F.col("out_pos") + 1)


def insert_at(base: DataFrame, extra: DataFrame, anchor: int, after: bool = True) -> DataFrame:
    """Rows of `extra` before or after the anchor (clamped to the document): adds out_pos."""
    at = F.greatest(F.lit(0 if after else 1), F.least(F.lit(anchor), F.col("n")))
    first = at if after else at - 1
    kept = base.withColumn("out_pos", F.col("pos") + F.when(F.col("pos") > first, F.col("extra_n")).otherwise(0)).withColumn("inserted", F.lit(False))
    new = extra.withColumn("out_pos", F.greatest(F.lit(0), F.least(F.lit(anchor), F.col("base_n"))) - (0 if after else 1) + F.col("pos")).withColumn("inserted", F.lit(True))
    return kept.unionByName(new, allowMissingColumns=True)


def permuted(mode: str) -> Column:
    """New position of a row: reverse, odd_even (odds first), duplex (front and back halves interleaved), booklet-free."""
    pos, n = F.col("pos"), F.col("n")
    half = F.ceil(n / 2)
    if mode == "reverse":
        out = n + 1 - pos
    elif mode == "odd_even":
        out = F.when(pos % 2 == 1, (pos + 1) / 2).otherwise(half + pos / 2)
    elif mode == "odd_even_merge":
        out = F.when(pos <= half, 2 * pos - 1).otherwise(2 * (pos - half))
    elif mode == "duplex":
        out = F.when(pos <= half, 2 * pos - 1).otherwise(2 * (n + 1 - pos))
    else:
        raise ValueError(mode)
    return out.cast("long")


def natural_key(name: Column) -> Column:
    """Sort key that orders digit runs by value: each run without leading zeros behind its length."""
    bare = lambda x: F.regexp_replace(x, "^0+", "")
    run = lambda x: F.when(x.rlike(r"^[0-9]"), F.concat(F.lpad(F.length(bare(x)).cast("string"), 9, "0"), bare(x))).otherwise(x)
    return F.array_join(F.transform(F.regexp_extract_all(F.lower(name), F.lit("([0-9]+|[^0-9]+)"), 1), run), "")


def serial_stamps(files: DataFrame, order: list[str], start: int = 1, step: int = 1, width: int = 6) -> DataFrame:
    """One counter over all files in order: first and last stamp of each, padded to the width but never cut."""
    files, before = along(files, [], order, before={"_before": F.col("n")}), F.col("_before")

    def stamp(x: Column) -> Column:
        t = x.cast("string")
        return F.when(F.length(t) < width, F.lpad(t, width, "0")).otherwise(t)

    out = files.withColumn("first_number", (start + before * step).cast("long")).withColumn("last_number", (start + (before + F.col("n") - 1) * step).cast("long"))
    return out.withColumn("first_stamp", stamp(F.col("first_number"))).withColumn("last_stamp", stamp(F.col("last_number"))).withColumn("overflow", F.length(F.col("last_number").cast("string")) > width).drop("_before")


def label_asof(rows: DataFrame, ranges: DataFrame, doc: str, order: str | None = None) -> DataFrame:
    """The label range with the latest start at or before each position, by one ordered union; none: plain decimal.

    ranges: (doc, start, style, prefix, first), and a column `order`: of ranges with one start the last holds (without
    such a column, the one with the greatest style, prefix and first). Starts below 1 are left out, first values below
    1 are 1. Styles: decimal, roman-lower, roman-upper, letters-lower, letters-upper and none. Rows gain style, prefix,
    number and label.
    """
    kept = ranges.filter(F.col("start") >= 1).withColumn("_r", F.struct("start", "style", F.coalesce("prefix", F.lit("")).alias("prefix"), F.greatest(F.lit(1), F.coalesce("first", F.lit(1))).alias("first")))
    last = F.struct(order, "_r") if order else F.struct("_r")
    marks = kept.groupBy(doc, F.col("start").alias("pos")).agg(F.max(last)["_r"].alias("_r")).select(doc, "pos", F.lit(0).alias("_k"), "_r")
    both = marks.unionByName(rows.select(doc, "pos", F.lit(1).alias("_k"), F.lit(None).cast(marks.schema["_r"].dataType).alias("_r")))
    held = along(both.withColumnRenamed("_r", "_own"), [doc], ["pos", "_k"], last={"_r": F.col("_own")}).filter("_k = 1")
    start, first = F.coalesce(F.col("_r.start"), F.lit(1)), F.coalesce(F.col("_r.first"), F.lit(1))
    out = held.select(doc, "pos", F.coalesce(F.col("_r.style"), F.lit("decimal")).alias("style"), F.coalesce(F.col("_r.prefix"), F.lit("")).alias("prefix"), (F.col("pos") - start + first).cast("long").alias("number"))
    return out.withColumn("label", F.concat("prefix", page_number(F.col("number"), F.col("style"))))


def page_number(n: Column, style: Column) -> Column:
    """A number in a style of label_asof; `none` and unknown styles give an empty text."""
    out = F.when(style == "decimal", F.greatest(F.lit(1), n).cast("string"))
    for name, f in (("roman", to_roman), ("letters", to_letters)):
        out = out.when(style == f"{name}-lower", F.lower(f(n))).when(style == f"{name}-upper", F.upper(f(n)))
    return out.otherwise("")


def duplicate_labels(labelled: DataFrame, doc: str) -> DataFrame:
    """(doc, label, n): labels that more than one position of a document has; empty ones do not count."""
    return labelled.filter("label <> ''").groupBy(doc, "label").agg(F.count("*").alias("n")).filter("n > 1")


# Roman numerals by falling worth.
ROMAN = [(1000, "M"), (900, "CM"), (500, "D"), (400, "CD"), (100, "C"), (90, "XC"), (50, "L"), (40, "XL"), (10, "X"), (9, "IX"), (5, "V"), (4, "IV"), (1, "I")]


def to_roman(n: Column) -> Column:
    """Upper-case Roman numeral of 1 to 3999, else the number itself."""
    out, rest = F.lit(""), n
    for worth, sign in ROMAN:
        out = F.concat(out, F.repeat(F.lit(sign), F.floor(rest / worth).cast("int")))
        rest = rest % worth
    return F.when(n.between(1, 3999), out).otherwise(n.cast("string"))


def to_letters(n: Column) -> Column:
    """a to z, then aa, bb and so on."""
    return F.when(n >= 1, F.repeat(F.char(((n - 1) % 26 + 97).cast("int")), F.ceil(n / 26).cast("int"))).otherwise(n.cast("string"))


def order_expression(text: str, n: int) -> list[int]:
    """Positions of `1,3,4-6`, `2n`, `2n+1`, `reverse` joined by , ; or +; duplicates kept, positions over n dropped."""
    out: list[int] = []
    for part in filter(None, (p.strip().lower() for p in re.split(r"[,;]|\+(?!\s*\d+\s*(?:[,;]|$))", text))):
        if part == "reverse":
            out += range(n, 0, -1)
        elif m := re.fullmatch(r"(\d*)n(?:\s*([+-])\s*(\d+))?", part):
            a, b = int(m[1] or 1), int(m[3] or 0) * (-1 if m[2] == "-" else 1)
            out += [x for k in range(n + 1) if 1 <= (x := a * k + b) <= n] if a else []
        else:
            for lo, hi in parse_ranges(part):
                a, b = (int(x) for x in (part.split("-") * 2)[:2])
                out += [x for x in (range(a, b + 1) if a <= b else range(a, b - 1, -1)) if 1 <= x <= n]
    return out


def arrange(rows: DataFrame, expression: str, longest: int) -> DataFrame:
    """Rows in the order of an expression: adds out_pos. The expression is a small argument; rows stay distributed."""
    order = order_expression(expression, longest)
    spots = F.array(*[F.struct(F.lit(k + 1).cast("long").alias("out"), F.lit(p).cast("long").alias("at")) for k, p in enumerate(order)])
    return rows.withColumn("_s", F.explode(F.filter(spots, lambda s: s["at"] == F.col("pos")))).withColumn("out_pos", F.col("_s.out")).drop("_s")


def tile_grid(pages: DataFrame, tile_w: float, tile_h: float, overlap: float, most: int | None = None) -> DataFrame:
    """Tiles that cover each page (width, height): column, row, x, y; the last tile of a line is pulled back.

    Orientation with fewer tiles wins (portrait on ties). With `most`, a page that needs more tiles has an empty plan.
    """

    def count(size: Column, tile: float) -> Column:
        return F.greatest(F.lit(1), F.ceil((size - overlap) / (tile - overlap))).cast("int")

    w, h = F.col("width"), F.col("height")
    upright, lying = count(w, tile_w) * count(h, tile_h), count(w, tile_h) * count(h, tile_w)
    turn = lying < upright
    df = pages.withColumn("_tw", F.when(turn, tile_h).otherwise(tile_w)).withColumn("_th", F.when(turn, tile_w).otherwise(tile_h))
    df = df.withColumn("_nx", F.when(turn, count(w, tile_h)).otherwise(count(w, tile_w))).withColumn("_ny", F.when(turn, count(h, tile_w)).otherwise(count(h, tile_h)))
    df = df.filter(F.col("_nx") * F.col("_ny") <= most) if most else df
    df = df.withColumn("column", F.explode(F.sequence(F.lit(0), F.col("_nx") - 1))).withColumn("row", F.explode(F.sequence(F.lit(0), F.col("_ny") - 1)))
    df = df.withColumn("x", F.greatest(F.lit(0.0), F.least(F.col("column") * (F.col("_tw") - overlap), w - F.col("_tw"))))
    return df.withColumn("y", F.greatest(F.lit(0.0), F.least(F.col("row") * (F.col("_th") - overlap), h - F.col("_th")))).drop("_tw", "_th", "_nx", "_ny")


def gutter_valley(ink: DataFrame, page: str, tolerance: float = 0.0, band: float = 0.18) -> DataFrame:
    """(page, x, ink, width) -> the longest low-ink run in the centre band (ties: nearest the centre): start, end."""
    mid = (F.col("width") - 1) / 2
    low = ink.filter((F.abs(F.col("x") - mid) <= band * F.col("width")) & (F.col("ink") <= tolerance))
    w = Window.partitionBy(page).orderBy("x")
    runs = low.withColumn("_g", F.col("x") - F.row_number().over(w)).groupBy(page, "_g").agg(F.min("x").alias("start"), F.max("x").alias("end"), F.max("width").alias("width"))
    best = F.max(F.struct((F.col("end") - F.col("start")).alias("size"), (-F.abs((F.col("start") + F.col("end")) / 2 - mid)).alias("near"), (-F.col("start")).alias("s"), "start", "end"))
    return runs.groupBy(page).agg(best.alias("b")).select(page, F.col("b.start").alias("start"), F.col("b.end").alias("end"))


def confidence_stats(words: DataFrame, confidence: str, by: list[str]) -> DataFrame:
    """Words of high (85 and more), medium (60 and more) and low rounded confidence, their shares in whole percent, and
    the rounded mean of the rounded values."""
    r = F.floor(F.col(confidence) + 0.5)
    n = lambda c: F.sum(c.cast("long"))
    tiers = {"high": F.col("_r") >= 85, "medium": (F.col("_r") >= 60) & (F.col("_r") < 85), "low": F.col("_r") < 60}
    g = words.withColumn("_r", r).groupBy(*by).agg(*[n(c).alias(k) for k, c in tiers.items()], F.count("*").alias("_n"), F.sum("_r").alias("_s"))
    whole = lambda x: F.floor(x + 0.5).cast("long")
    return g.select(*by, *tiers, *[whole(F.col(k) * 100.0 / F.col("_n")).alias(f"{k}_percent") for k in tiers], whole(F.col("_s") / F.col("_n")).alias("average"))


def orientation_vote(runs: DataFrame, page: str, angle: str, chars: str, share: float = 0.7, least: int = 10) -> DataFrame:
    """Per page the angle that most characters have (ties: the smaller) and what follows: review for under `least`
    characters or a share below `share`, else upright at 0 and rotate at other angles."""
    by = runs.groupBy(page, angle).agg(F.sum(chars).alias("w"))
    t = by.groupBy(page).agg(F.sum("w").alias("chars"), F.max(F.struct("w", (-F.col(angle)).alias("o"), F.col(angle).alias("angle"))).alias("m"))
    sure = (F.col("chars") >= least) & (F.col("m.w") / F.greatest(F.col("chars"), F.lit(1)) >= share)
    return t.select(page, F.col("m.angle").alias("angle"), "chars", F.when(~sure, "review").when(F.col("m.angle") == 0, "upright").otherwise("rotate").alias("decision"))


def subset_pages(expression: Column, n: Column) -> Column:
    """Pages of an ordered subset such as `5,1-2` or `3-1`, repeats dropped; null where it cannot be read. Blank: all."""
    all_pages = F.when(n > 0, F.sequence(F.lit(1).cast("long"), n)).otherwise(F.array().cast("array<bigint>"))
    parts = F.filter(F.transform(F.split(F.coalesce(expression, F.lit("")), ","), lambda p: F.trim(p)), lambda p: p != "")
    first, last = (lambda p: F.regexp_extract(p, r"^(\d+)", 1).try_cast("long")), (lambda p: F.regexp_extract(p, r"(\d+)$", 1).try_cast("long"))
    good = F.forall(parts, lambda p: F.coalesce(p.rlike(r"^\d+(\s*-\s*\d+)?$") & first(p).between(1, n) & last(p).between(1, n), F.lit(False)))
    pages = F.array_distinct(F.flatten(F.transform(parts, lambda p: F.sequence(first(p), last(p)))))
    return F.when(F.trim(F.coalesce(expression, F.lit(""))) == "", all_pages).when(good & (F.size(parts) > 0), pages)


def merge_plan(sources: DataFrame, key: str, order: Column | None = None) -> DataFrame:
    """(key, n_pages, subset) in the order given -> key, pages, first_out (output position of the first one), invalid.

    Sources are sorted by `order`, ties by key, so that equal ones keep their place; a subset that cannot be read takes
    the whole source and is marked; sources without pages go.
    """
    whole = F.when(F.col("n_pages") > 0, F.sequence(F.lit(1).cast("long"), F.col("n_pages").cast("long"))).otherwise(F.array().cast("array<bigint>"))
    df = sources.withColumn("_p", subset_pages(F.col("subset"), F.col("n_pages").cast("long"))).withColumn("invalid", F.col("_p").isNull())
    df = df.withColumn("pages", F.coalesce("_p", whole)).filter(F.size("pages") > 0)
    keyed = df.withColumn("_n", F.size("pages").cast("long"))
    out = along(keyed, [], [*([order] if order is not None else []), key], before={"first_out": F.col("_n")})
    return out.withColumn("first_out", F.col("first_out") + 1).drop("_p", "_n")


def toc_positions(sources: DataFrame, pages: str, order: list[str], cover: int = 1, contents: int = 1, separator: int = 1) -> DataFrame:
    """Adds starts_at, the output page where a source begins: behind the cover and the contents, and, before each source,
    `separator` pages of its own. Pages of 0 or less count as none."""
    taken = F.greatest(F.lit(0), F.coalesce(F.col(pages), F.lit(0))).cast("long") + separator
    out = along(sources, [], order, before={"starts_at": taken})
    return out.withColumn("starts_at", (F.col("starts_at") + cover + contents + separator + 1).cast("long"))
