"""Positioned tokens: lines, tables, grids and their cells, reading order, headings and their tree.

Tokens carry doc, page, text, x, y, width, height. Order-dependent folds run per page, which bounds their groups.
"""

from __future__ import annotations

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import rounded
from ..sources.shared import by_document


def lines_from_tokens(tokens: DataFrame, page: str, reach: float = 3.0, gap: float = 1.4) -> DataFrame:
    """(page, text, x, y[, height]) -> page, line_no, y, text, paragraph: tokens within `reach` of a line's first token
    join it, left to right; a step down of over `gap` heights (12 where unknown) starts a paragraph, from 1."""
    tall = F.coalesce(F.col("height").cast("double"), F.lit(12.0)) if "height" in tokens.columns else F.lit(12.0)

    def run(f: pd.DataFrame) -> pd.DataFrame:
        f = f.sort_values(["y", "x", "text"], kind="stable")
        out, anchor, height, held, part = [], None, 12.0, [], 1
        for t in f.itertuples():
            if anchor is None or abs(t.y - anchor) > reach:
                if held:
                    out.append((anchor, held, part))
                    part += abs(t.y - anchor) > gap * height
                anchor, height, held = t.y, t.tall, []
            held.append((t.x, t.text))
        if held:
            out.append((anchor, held, part))
        name = f[page].iloc[0]
        return pd.DataFrame([(name, k, y, " ".join(w for _, w in sorted(h)), p) for k, (y, h, p) in enumerate(out, 1)], columns=[page, "line_no", "y", "text", "paragraph"])

    kind = dict(tokens.dtypes)[page]
    return tokens.select(page, "text", "x", "y", tall.alias("tall")).groupBy(page).applyInPandas(run, f"{page} {kind}, line_no long, y double, text string, paragraph long")


def tables_from_tokens(tokens: DataFrame, page: str, reach: float = 4.0) -> DataFrame:
    """Cells of a page's table: rows of tokens near the first one's y, with at least two columns, if there are two rows."""

    def run(f: pd.DataFrame) -> pd.DataFrame:
        f = f.sort_values(["y", "x", "text"], kind="stable")
        rows, anchor = [], None
        for t in f.itertuples():
            if anchor is None or abs(t.y - anchor) > reach:
                rows.append([])
                anchor = t.y
            rows[-1].append((t.x, t.text))
        rows = [sorted(r) for r in rows if len(r) >= 2]
        wide = max(map(len, rows), default=0)
        cells = [(f[page].iloc[0], r, c, row[c][1] if c < len(row) else "") for r, row in enumerate(rows) for c in range(wide)] if len(rows) >= 2 else []
        return pd.DataFrame(cells, columns=[page, "row", "col", "text"])

    kind = dict(tokens.dtypes)[page]
    return tokens.groupBy(page).applyInPandas(run, f"{page} {kind}, row long, col long, text string")


def column_dividers(tokens: DataFrame, page: str, gutter: int = 8, margin: int = 15) -> DataFrame:
    """(page, x, width) -> page, divider: middles of runs of at least `gutter` x units that no token covers."""
    a, b = F.floor("x").cast("int"), F.floor(F.col("x") + F.col("width")).cast("int")
    seen = tokens.select(page, "x", (F.col("x") + F.col("width")).alias("_r"), F.when(b.isNotNull(), F.least(a, b)).alias("_a"), F.when(b.isNotNull(), F.greatest(a, b)).alias("_b"))
    # tokens that begin at one unit are one row; what is covered so far ends before the next one begins, or there is no gap
    spans = seen.groupBy(page, "_a").agg(F.max("_b").alias("_b"), F.min("x").alias("lo"), F.max("_r").alias("hi"))
    whole = Window.partitionBy(page)
    before = whole.orderBy("_a").rowsBetween(Window.unboundedPreceding, -1)
    gaps = spans.withColumns({"prev": F.max("_b").over(before), "lo": F.min("lo").over(whole), "hi": F.max("hi").over(whole)}).filter(F.col("_a") - F.col("prev") - 1 >= max(1, gutter))
    mid = (F.col("prev") + F.col("_a")) / 2
    return gaps.select(page, mid.alias("divider"), "lo", "hi").filter((F.col("divider") > F.col("lo") + margin) & (F.col("divider") < F.col("hi") - margin)).select(page, "divider")


def row_dividers(tokens: DataFrame, page: str) -> DataFrame:
    """(page, y, height) -> page, divider: middles between bands of words, top to bottom.

    Words go by y; a word joins the first band whose first word's centre is within 0.75 of the page's median height.
    The fold depends on the order of a page's words. Pages are dealt and sorted by Spark and stream through a task, which
    holds the words of one page.
    """
    kind = dict(tokens.dtypes)[page]

    def cuts(words: list[tuple[float, float]]) -> list[float]:
        tall = sorted(h for _, h in words if h == h)
        half = len(tall) // 2
        median = ((tall[half] if len(tall) % 2 else (tall[half - 1] + tall[half]) / 2) if tall else float("nan")) or 16.0
        bands: list[list[float]] = []
        for y, h in words:
            centre = y + (h or median) / 2
            band = next((b for b in bands if abs(centre - b[0]) <= 0.75 * median), None)
            if band is None:
                bands.append([centre, y, y, y + h])
            else:
                band[2], band[3] = min(band[2], y), max(band[3], y + h)
        bands.sort(key=lambda b: b[1])
        return [float(int((a[3] + b[2]) / 2 + 0.5)) for a, b in zip(bands, bands[1:])]

    def run(batches):
        names, places, name, words, key = [], [], None, [], None

        def close():
            found = cuts(words)
            names.extend([name] * len(found))
            places.extend(found)

        def out():
            done = pa.RecordBatch.from_arrays([pa.array(names, key), pa.array(places, pa.float64())], names=[page, "divider"])
            names.clear()
            places.clear()
            return done

        for b in batches:
            key = b.column(0).type
            for p, y, h in zip(*(c.to_pylist() for c in b.columns), strict=True):
                if words and p != name:
                    close()
                    words = []
                name = p
                words.append((float("nan") if y is None else y, float("nan") if h is None else h))
            if len(names) > 8192:
                yield out()
        if words:
            close()
            yield out()

    last = [F.col(c).asc_nulls_last() for c in ("y", "x", "text")]
    words = by_document(tokens.select(page, F.col("y").cast("double").alias("y"), F.col("height").cast("double").alias("height"), "x", "text"), page).sortWithinPartitions(page, *last)
    return words.select(page, "y", "height").mapInArrow(run, f"{page} {kind}, divider double")


def table_grid(tokens: DataFrame, page: str, gutter: int = 8, margin: int = 15) -> DataFrame:
    """Dividers of a page's table: page, axis (column or row), divider."""
    cols = column_dividers(tokens, page, gutter, margin).select(page, F.lit("column").alias("axis"), "divider")
    return cols.unionByName(row_dividers(tokens, page).select(page, F.lit("row").alias("axis"), "divider"))


def cells_from_grid(grid: DataFrame, words: DataFrame, page: str, slack: float = 3.0, tile: float = 64.0) -> DataFrame:
    """Words whose centre lies in a cell (page, cell, left, top, right, bottom), give or take the slack, joined by x.

    Adds text and confidence (rounded mean of the words', 80 where unknown; 85 for empty cells); a word near a border may
    lie in two cells. A cell is dealt to every tile of the page that it touches and a word to the one of its centre, so
    words meet the cells of their own tile by an equi-join before the exact test. Cells that are wide for their page meet
    tiles as much larger: a cell touches at most some 64 of them. Spark sizes rows before they are dealt to tiles, so the
    hint keeps it from sending the dealt cells through the driver.
    """
    w = words.select(page, (F.col("x") + F.col("width") / 2).alias("_cx"), (F.col("y") + F.col("height") / 2).alias("_cy"), "x", F.col("text").alias("_t"), F.coalesce("confidence", F.lit(80.0)).alias("_conf"))
    # tiles double in size until a cell touches at most 8 a side; words meet the sizes that their page has
    side = F.greatest(F.col("right") - F.col("left"), F.col("bottom") - F.col("top"), F.lit(0.0)) + 2 * slack
    level = F.greatest(F.lit(0), F.ceil(F.log2(F.greatest(side / (tile * 7), F.lit(1.0))))).cast("int")
    size, at = F.pow(F.lit(2.0), F.col("_level")) * tile, lambda c: F.floor(c / size)
    spread = lambda lo, hi: F.explode(F.sequence(at(F.col(lo) - slack), at(F.col(hi) + slack)))
    whole = (F.col("left") <= F.col("right")) & (F.col("top") <= F.col("bottom"))
    dealt = grid.filter(whole).withColumn("_level", level).withColumn("_tx", spread("left", "right")).withColumn("_ty", spread("top", "bottom"))
    levels = dealt.select(page, "_level").distinct()
    placed = w.join(levels, page).withColumn("_tx", at(F.col("_cx"))).withColumn("_ty", at(F.col("_cy")))
    inside = F.col("_cx").between(F.col("left") - slack, F.col("right") + slack) & F.col("_cy").between(F.col("top") - slack, F.col("bottom") + slack)
    met = dealt.hint("merge").join(placed, [page, "_level", "_tx", "_ty"]).filter(inside).groupBy(page, "cell")
    text = F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("x", "_t"))), lambda s: s["_t"]), " ")
    found = met.agg(text.alias("text"), rounded(F.avg("_conf")).cast("long").alias("confidence"))
    return grid.select(page, "cell").join(found, [page, "cell"], "left").select(page, "cell", F.coalesce("text", F.lit("")).alias("text"), F.coalesce("confidence", F.lit(85).cast("long")).alias("confidence"))


def multi_column_flag(tokens: DataFrame, page: str, page_width: float) -> DataFrame:
    """page, two_columns: at least 6 items, 3 wholly left of the middle less 10 and 3 starting right of it plus 10."""
    mid = page_width / 2
    n = lambda c: F.sum(c.cast("int"))
    flag = (F.count("*") >= 6) & (n(F.col("x") + F.col("width") < mid - 10) >= 3) & (n(F.col("x") > mid + 10) >= 3)
    return tokens.groupBy(page).agg(flag.alias("two_columns"))


def reading_blocks(tokens: DataFrame, page: str, page_width: float) -> DataFrame:
    """Blocks in reading order: full-width items, then the left and the right column, each from the top (largest y).

    An item joins the block of the item before it when they are near: dy < 24 and (dx < 40 or dy < 18).
    """
    mid = page_width / 2
    side = F.when((F.col("x") < mid - 10) & (F.col("x") + F.col("width") > mid + 10), 0).when(F.col("x") + F.col("width") / 2 < mid, 1).otherwise(2)
    t = tokens.withColumn("column", side)
    w = Window.partitionBy(page).orderBy("column", F.desc("y"), "x", "text")
    dy, dx = F.abs(F.col("y") - F.lag("y").over(w)), F.abs(F.col("x") - F.lag("x").over(w))
    near = (F.col("column") == F.lag("column").over(w)) & (dy < 24) & ((dx < 40) | (dy < 18))
    t = t.withColumn("_new", (~F.coalesce(near, F.lit(False))).cast("long")).withColumn("_p", F.row_number().over(w))
    t = t.withColumn("block", F.sum("_new").over(w))
    text = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("_p", "text"))), lambda s: s["text"]), " ")
    return t.groupBy(page, "block").agg(F.min("column").cast("long").alias("column"), text.alias("text"), F.min("x").alias("left"), F.min("y").alias("bottom"), F.max(F.col("x") + F.col("width")).alias("right"), F.max(F.col("y") + F.col("height")).alias("top"), F.max("height").alias("size"))


def block_tag(text: Column, size: Column) -> Column:
    """H1, H2, H3, list, table or paragraph by size, bullets, tabs, capitals and a closing colon."""
    words = F.size(F.split(F.trim(text), r"\s+"))
    return (
        F.when((size >= 18) & (words <= 15), "H1").when((size >= 14) & (words <= 20), "H2").when(text.rlike(r"^\s*([•\-*]|\d+[.)])\s"), "list").when(text.rlike(r"\|.*\||\t.*\t"), "table")
        .when((text == F.upper(text)) & text.rlike("[A-Z]") & (words <= 8), "H3").when(text.rlike(r":\s*$") & (words <= 10), "H3").otherwise("paragraph")
    )


def headings_from_runs(runs: DataFrame, doc: str, ratio: float = 1.15, most: int = 120) -> DataFrame:
    """(doc, pos, text, size) -> heading runs with a level of 1 to 3.

    The body size is the most frequent half-point size (ties: the smaller); headings are at least `ratio` times as
    large. Distinct sizes within 8 % of a level's first share the level; only they are folded, per document.
    """
    half = rounded(F.col("size") * 2) / 2
    modal = runs.groupBy(doc, half.alias("_h")).agg(F.count("*").alias("_n")).groupBy(doc).agg(F.max(F.struct("_n", (-F.col("_h")).alias("neg"))).getField("neg").alias("_neg"))
    big = runs.join(modal, doc).filter((F.col("size") >= -F.col("_neg") * ratio) & (F.length("text") <= most)).drop("_neg")
    sizes = big.groupBy(doc).agg(F.sort_array(F.collect_set("size"), asc=False).alias("_s"))
    start = F.struct(F.lit(0).alias("level"), F.lit(None).cast("double").alias("first"), F.expr("cast(map() as map<double,int>)").alias("m"))

    def step(acc, s):
        new = acc["first"].isNull() | (s < acc["first"] * 0.92)
        level = F.when(new, acc["level"] + 1).otherwise(acc["level"])
        return F.struct(level.alias("level"), F.when(new, s).otherwise(acc["first"]).alias("first"), F.map_concat(acc["m"], F.create_map(s, F.least(F.lit(3), level))).alias("m"))

    return big.join(sizes.select(doc, F.aggregate("_s", start, step)["m"].alias("_m")), doc).withColumn("level", F.element_at("_m", F.col("size")).cast("long")).drop("_m")


def heading_tree(headings: DataFrame, doc: str, levels: int = 6) -> DataFrame:
    """Adds parent: position of the nearest earlier heading of a smaller level, by one window a level, or null."""
    w = Window.partitionBy(doc).orderBy("pos").rowsBetween(Window.unboundedPreceding, -1)
    above = [F.last(F.when(F.col("level") < k, F.col("pos")), ignorenulls=True).over(w) for k in range(1, levels + 1)]
    parent = F.lit(None).cast("long")
    for k, a in enumerate(above, 1):
        parent = F.when(F.col("level") == k, a).otherwise(parent)
    return headings.withColumn("parent", parent)


def locate_bbox(values: DataFrame, tokens: DataFrame, doc: str, variant: str = "page") -> DataFrame:
    """(doc, key, value[, line_index]) and tokens -> page, left, top, right, bottom and found of each value.

    Value and token meet by their letters and digits alone, where one holds the other. Variant "all" takes every such
    token and the first one's page. Variant "page" wants four characters, or two with a digit, of what is held, unless both
    are equal, and takes the page with most such tokens (ties: the first). The box is the union of the tokens, in whole
    points of a least size. A value without a token gets a box that its line index and length suggest, with found false.

    The values of a document, a row each field, meet its tokens as one array, so that no pairs are made but those that
    match.
    """
    if variant not in ("page", "all"):
        raise ValueError(variant)
    page = variant == "page"
    line = F.col("line_index") if "line_index" in values.columns else F.lit(0)
    clean = lambda c: F.regexp_replace(F.lower(F.coalesce(c, F.lit(""))), "[^a-z0-9]", "")
    long = lambda c: (F.length(c) >= 4) | (F.length(c) >= 2) & c.rlike("[0-9]") if page else F.lit(True)
    asked = values.select(doc, "key", "value", F.coalesce(line, F.lit(0)).alias("_line"))
    per = asked.select(doc, "key", clean(F.col("value")).alias("_v")).filter("_v <> ''").groupBy(doc).agg(F.collect_set(F.struct("key", "_v")).alias("_vs"))
    t = F.col("_c")
    meets = lambda v: (v["_v"] == t) | long(t) & F.contains(v["_v"], t) | long(v["_v"]) & F.contains(t, v["_v"])
    met = tokens.withColumn("_c", clean(F.col("text"))).filter("_c <> ''").join(per, doc).withColumn("_m", F.filter("_vs", meets)).drop("_vs", "key").withColumn("key", F.explode("_m.key"))
    edges = [F.min("x").alias("left"), F.min("y").alias("top"), F.max(F.col("x") + F.col("width")).alias("right"), F.max(F.col("y") + F.col("height")).alias("bottom")]
    hit = met.groupBy(doc, "key", *(["page"] if page else [])).agg(F.count("*").alias("n"), F.min("page").alias("_page"), *edges)
    best = hit.groupBy(doc, "key").agg(F.max(F.struct("n", (-F.col("_page")).alias("p"), F.col("_page").alias("page"), "left", "top", "right", "bottom")).alias("b"))
    j, none = asked.join(best, [doc, "key"], "left"), F.col("b").isNull()
    # Least and greatest sizes, and where an unseen value is drawn.
    (narrow, wide, low, tall) = (15, 600, 12, 300) if page else (10, 1 << 30, 10, 1 << 30)
    (x, y, least, most, each, high) = (72, 100, 60, 450, 7.5, 18) if page else (40, 40, 80, 480, 9, 20)
    left, top = (F.greatest(F.lit(0), rounded(F.col(f"b.{c}"))) if page else rounded(F.col(f"b.{c}")) for c in ("left", "top"))
    size = lambda a, b, lo, hi: F.least(F.lit(hi), F.greatest(F.lit(lo), rounded(F.col(f"b.{b}") - F.col(f"b.{a}"))))
    guessed = F.when(F.coalesce("value", F.lit("")) == "", 120).otherwise(F.least(F.lit(most), F.greatest(F.lit(least), rounded(F.length("value") * each))))
    box = {"left": (F.lit(x), left), "top": (y + F.col("_line") * 24, top), "right": (x + guessed, left + size("left", "right", narrow, wide)), "bottom": (y + F.col("_line") * 24 + high, top + size("top", "bottom", low, tall))}
    edges = [F.when(none, g.cast("double")).otherwise(c.cast("double")).alias(k) for k, (g, c) in box.items()]
    return j.select(doc, "key", F.when(none, 1).otherwise(F.col("b.page")).cast("long").alias("page"), *edges, (~none).alias("found"))


def paragraph_split(docs: DataFrame, text: str = "text", pack: int = 300, gate: int = 350, keep: tuple[str, ...] = ()) -> DataFrame:
    """doc_id, paragraph_no, paragraph, and columns to `keep`: parts at blank lines, else at lines, else, for texts over `gate` characters, packs
    of sentences of about `pack`.

    Headings (short parts without a stop, or short numbered or named ones) go in front of the next paragraph, or at the
    end of the last one; parts of at most 25 characters join the one before. Text behind the last stop is kept; blank
    and null texts give no rows.
    """
    t = F.coalesce(F.col(text), F.lit(""))
    full = lambda a: F.filter(F.transform(a, lambda x: F.regexp_replace(x, r"^\s+|\s+$", "")), lambda x: x != "")
    df = docs.select("doc_id", *keep, t.alias("_t"), full(F.split(t, r"\n\s*\n")).alias("_blank"), full(F.split(t, r"\n+")).alias("_lines"))
    state = F.struct(F.lit("").alias("cur"), F.array().cast("array<string>").alias("out"))

    def packed(acc, s):
        full = (F.length(F.trim(F.concat(acc["cur"], F.lit(" "), s))) > pack) & (F.length(acc["cur"]) > 50)
        joined = F.concat(acc["cur"], F.when(acc["cur"] != "", " ").otherwise(""), s)
        return F.struct(F.when(full, s).otherwise(joined).alias("cur"), F.when(full, F.array_append(acc["out"], F.trim(acc["cur"]))).otherwise(acc["out"]).alias("out"))

    sentences = F.regexp_extract_all("_t", F.lit(r"([^.!?]+[.!?]+(?:\s+|$)|[^.!?]+$)"), 1)
    packs = F.aggregate(sentences, state, packed, lambda acc: F.when(F.trim(acc["cur"]) != "", F.array_append(acc["out"], F.trim(acc["cur"]))).otherwise(acc["out"]))
    parts = F.when(F.size("_blank") > 1, F.col("_blank")).when(F.size("_lines") > 1, F.col("_lines")).when((F.length("_t") > gate) & (F.size("_blank") > 0), packs).otherwise(F.col("_blank"))
    df = df.select("doc_id", *keep, F.filter(F.transform(parts, lambda p: F.trim(F.regexp_replace(p, r"\s+", " "))), lambda p: p != "").alias("_p"))
    longer = lambda out, more: F.concat(F.slice(out, F.lit(1), F.size(out) - 1), F.array(F.concat(F.element_at(out, -1), F.lit(" "), more)))

    def carried(acc, p):
        heading = (F.length(p) < 90) & (~p.rlike(r"[.!?]$") | p.rlike(r"(?i)^(Section|Chapter|Part|Article|\d+\.)"))
        whole = F.concat(F.when(acc["cur"] != "", F.concat(acc["cur"], F.lit(". "))).otherwise(""), p)
        kept = F.when((F.length(whole) > 25) | (F.size(acc["out"]) == 0), F.array_append(acc["out"], whole)).otherwise(longer(acc["out"], whole))
        named = F.concat(F.when(acc["cur"] != "", F.concat(acc["cur"], F.lit(": "))).otherwise(""), p)
        return F.struct(F.when(heading, named).otherwise("").alias("cur"), F.when(heading, acc["out"]).otherwise(kept).alias("out"))

    done = lambda acc: F.when(acc["cur"] == "", acc["out"]).when(F.size(acc["out"]) > 0, longer(acc["out"], acc["cur"])).otherwise(F.array(acc["cur"]))
    # outer: the filter that Spark adds to a plain explode would make the paragraphs once more
    out = df.select("doc_id", *keep, F.posexplode_outer(F.aggregate("_p", state, carried, done)).alias("k", "paragraph")).filter("k is not null")
    return out.select("doc_id", (F.col("k") + 1).cast("long").alias("paragraph_no"), "paragraph", *keep)
