"""Names, templates, mappings, merges, audits and comparisons of records."""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.constants import B, E
from ..functions.text import rounded
from .running import along


def unit_to_px(value: Column, unit: Column, dpi: Column) -> Column:
    """Pixels of in, mm, cm or px at a resolution (300 outside 50 to 2400)."""
    d = F.when(dpi.between(50, 2400), dpi).otherwise(300)
    return rounded(F.when(unit == "in", value * d).when(unit == "mm", value / 25.4 * d).when(unit == "cm", value / 2.54 * d).otherwise(value)).cast("long")


def safe_filename(name: Column, variant: str = "strict", most: int | None = None) -> Column:
    """A name without paths and marks that file systems mind. Variants:

    "strict" (60): letters, digits, dots, dashes and underscores, runs of others one underscore; `document` if empty.
    "title" (60): only marks no file system takes and white space become underscores; other letters stay; may be empty.
    "shared" (120): the last part of a path without leading dots, others one underscore each; `shared_file` if empty.
    """
    n = F.coalesce(name, F.lit(""))
    if variant == "strict":
        out = F.regexp_replace(F.regexp_replace(F.trim(n), r"[^A-Za-z0-9._-]+", "_"), r"^[._]+|[._]+$", "")
        out = F.substring(out, 1, most or 60)
        return F.when(out == "", "document").otherwise(out)
    if variant == "title":
        ends = r"^[._-]+|[._-]+$"
        out = F.regexp_replace(F.regexp_replace(F.regexp_replace(n, r'[\\/:*?"<>|\x00]', "_"), r"[\s_]+", "_"), ends, "")
        return F.when(F.length(out) > (most or 60), F.regexp_replace(F.substring(out, 1, most or 60), ends, "")).otherwise(out)
    if variant == "shared":
        out = F.regexp_replace(F.regexp_replace(F.regexp_extract(n, r"([^/\\]*)$", 1), r"^\.+", ""), r"[^a-zA-Z0-9._-]", "_")
        out = F.substring(out, 1, most or 120)
        return F.when(out == "", "shared_file").otherwise(out)
    raise ValueError(variant)


def render(template: str, values: dict[str, Column]) -> Column:
    """Replace {name} tokens by columns: of that name, else of that name in any case; null values are empty and other
    tokens stay."""
    parts: list[Column] = []
    known = {n.lower(): c for n, c in reversed(values.items())}
    for k, piece in enumerate(re.split(r"\{([^}]+)\}", template)):
        name = piece.strip()
        if k % 2 and (name in values or name.lower() in known):
            parts.append(F.coalesce(values.get(name, known[name.lower()]).cast("string"), F.lit("")))
        elif piece:
            parts.append(F.lit("{" + piece + "}" if k % 2 else piece))
    return F.concat(*parts) if parts else F.lit("")


def record_file_name(pattern: str, values: dict[str, Column], index: Column) -> Column:
    """A file name for a record: {index} and {rowIndex} (from 1) and {column} tokens, whatever the case; no way out of a
    folder and no marks that file systems mind; Document_{index}.pdf where nothing is left, .pdf behind every name."""
    n = index.cast("string")
    named = render(re.sub(r"(?i)\{rowIndex\}", "{index}", pattern.strip() or "Document_{index}.pdf"), {**values, "index": n})
    safe = F.regexp_replace(F.regexp_replace(named, r"(?i)%2e%2e|\.\.[/\\]|\.\.", ""), r"^[.\s\\/]+", "")
    safe = F.trim(F.regexp_replace(F.regexp_replace(safe, r'[\\/:*?"<>|\x00-\x1F]+', "_"), "_+", "_"))
    safe = F.when(safe.isin("", ".pdf", "_"), F.concat(F.lit("Document_"), n, F.lit(".pdf"))).otherwise(safe)
    return F.when(F.lower(safe).endswith(".pdf"), safe).otherwise(F.concat(safe, F.lit(".pdf")))


def mail_merge(rows: DataFrame, fields: dict[str, str], pattern: str, index: Column, key: str) -> DataFrame:
    """Records of a merge: (key, file_name, field, value), one row a mapped field. `fields` maps a field of the template
    to a column; cells without a value are empty."""
    cells = F.array(*[F.struct(F.lit(f).alias("field"), F.coalesce(F.col(c).cast("string"), F.lit("")).alias("value")) for f, c in fields.items()])
    name = record_file_name(pattern, {c: F.col(c) for c in rows.columns}, index)
    return rows.select(key, name.alias("file_name"), F.explode(cells).alias("_f")).select(key, "file_name", "_f.field", "_f.value")


def padded(n: Column, width: int) -> Column:
    """Zero-padded, never cut."""
    t = n.cast("string")
    return F.when(F.length(t) < width, F.lpad(t, width, "0")).otherwise(t)


def name_uniquify(df: DataFrame, name: str, order: str, first: int = 2) -> DataFrame:
    """Adds unique_name: the first row of a name keeps it, later ones become name_2, name_3 and so on (from `first`).

    Names that rows bear are theirs: a made name skips every number that would give one of them, so that no two rows
    share a name whatever the order. Rows of a name and the numbers taken from it are numbered by running counts over
    ranges, so a name that a third of all rows bear is spread over tasks.
    """
    one = F.lit(1).cast("long")
    form = r"^(.*)_([1-9][0-9]{0,17})$"
    numbered = df.select(F.regexp_extract(name, form, 1).alias("_stem"), F.regexp_extract(name, form, 2).try_cast("long").alias("_s")).filter(F.col("_s") >= first).distinct()
    # with i numbers taken before it, the number s stands behind s - first - i free ones
    taken = along(numbered, ["_stem"], ["_s"], before={"_i": one}).select(F.col("_stem").alias(name), (F.col("_s") - first - F.col("_i")).alias("_free"), F.lit(0).alias("_row"), F.lit(None).cast(df.schema[order].dataType).alias(order))
    placed = along(df.select(name, order), [name], [order], before={"_k": one})
    later = placed.filter("_k > 0").select(name, (F.col("_k") - 1).alias("_free"), F.lit(1).alias("_row"), order)
    met = along(taken.join(later.select(name).distinct(), name, "left_semi").unionByName(later), [name], ["_free", "_row", order], before={"_passed": (F.col("_row") == 0).cast("long")}).filter("_row = 1")
    made = met.select(F.col(name).alias("_name"), F.col(order).alias("_order"), F.concat_ws("_", F.col(name), (F.col("_free") + first + F.col("_passed")).cast("string")).alias("_made"))
    joined = df.join(made, df[name].eqNullSafe(made["_name"]) & df[order].eqNullSafe(made["_order"]), "left")
    return joined.withColumn("unique_name", F.coalesce("_made", F.col(name))).drop("_name", "_order", "_made")


def csv_guard(value: Column, policy: str) -> Column:
    """Formula-injection guard: strict (after left trim, also | and %), numeric (trimmed, plain numbers stay), raw."""
    v = F.coalesce(value, F.lit(""))
    if policy == "strict":
        return F.when(F.ltrim(v).rlike(r"^[=+\-@\t\r|%]"), F.concat(F.lit("'"), v)).otherwise(v)
    if policy == "numeric":
        t = F.trim(v)
        return F.when(t.rlike(r"^[+-]?(?:\d{1,3}(?:,\d{3})+|\d+)(?:\.\d+)?%?$"), t).when(t.rlike(r"^[=+\-@\t\r]"), F.concat(F.lit("'"), t)).otherwise(t)
    if policy == "raw":
        return F.when(v.rlike(r"^[=+\-@\t\r]"), F.concat(F.lit("'"), v)).otherwise(v)
    raise ValueError(policy)


def csv_quote(value: Column) -> Column:
    """RFC 4180 quoting where it is needed."""
    return F.when(value.rlike('[,"\n\r]'), F.concat(F.lit('"'), F.replace(value, F.lit('"'), F.lit('""')), F.lit('"'))).otherwise(value)


def csv_delimiter(head: Column) -> Column:
    """Delimiter of a file from its first five lines: most frequent of tab, semicolon, pipe and comma, in that order."""
    five = F.array_join(F.slice(F.split(head, "\n"), 1, 5), "\n")
    n = {d: F.regexp_count(five, F.lit(p)) for d, p in (("\t", "\t"), (";", ";"), ("|", r"\|"), (",", ","))}
    top = F.greatest(*n.values())
    out = F.lit(",")
    for d in reversed(n):
        out = F.when((n[d] == top) & (top > 0), d).otherwise(out)
    return out


# Fixed values below: likeness of equal names, of equal letters and digits, and of names that hold each other.
def similarity(a: Column, b: Column) -> Column:
    """1 if equal, .95 if equal in letters and digits, .7 to .9 if one contains the other, else 1 - edits / length."""
    x, y = F.lower(F.trim(a)), F.lower(F.trim(b))
    cx, cy = F.regexp_replace(x, "[^a-z0-9]", ""), F.regexp_replace(y, "[^a-z0-9]", "")
    longest = F.greatest(F.length(cx), F.length(cy), F.lit(1))
    inside = (cx != "") & (cy != "") & (F.contains(cx, cy) | F.contains(cy, cx))
    return F.when(x == y, 1.0).when((cx != "") & (cx == cy), 0.95).when(inside, F.greatest(F.lit(0.7), 0.9 - F.abs(F.length(cx) - F.length(cy)) / longest * 0.2)).otherwise(F.greatest(F.lit(0.0), 1 - F.levenshtein(cx, cy) / longest))


def fuzzy_column_map(fields: DataFrame, headers: DataFrame, least: float = 0.6) -> DataFrame:
    """(field), (header, rank) -> field, header or null, confidence: the most similar header, ties to the first.

    Both sides are column names of a schema, so their pairs are few; the join is theta by nature.
    """
    s = F.round(similarity(F.col("field"), F.col("header")), 6)
    p = fields.join(headers, F.length("header") > 0).withColumn("s", s)
    best = p.groupBy("field").agg(F.max(F.struct("s", (-F.col("rank")).alias("r"), "header")).alias("b"))
    return best.select("field", F.when(F.col("b.s") >= least, F.col("b.header")).alias("header"), rounded(F.col("b.s"), 2).alias("confidence"))


def tiered_key_match(names: DataFrame, data: DataFrame) -> DataFrame:
    """(name), (key) -> name, key, tier: exact, then case-insensitive, then letters and digits; three equi-joins. Names
    without a key are `unmatched`, keys that no name takes are `unused` with a null name."""
    forms = [("exact", lambda c: c), ("case", F.lower), ("alnum", lambda c: F.regexp_replace(F.lower(c), "[^a-z0-9]", ""))]
    left, out = names.select("name"), None
    for tier, f in forms:
        keys = data.select(f(F.col("key")).alias("_f"), "key").groupBy("_f").agg(F.min("key").alias("key"))
        hit = left.withColumn("_f", f(F.col("name"))).join(keys, "_f").select("name", "key", F.lit(tier).alias("tier"))
        out = hit if out is None else out.unionByName(hit)
        left = left.join(hit.select("name"), "name", "left_anti")
    none = F.lit(None).cast("string")
    unused = data.select("key").distinct().join(out.select("key"), "key", "left_anti").select(none.alias("name"), "key", F.lit("unused").alias("tier"))
    return out.unionByName(left.select("name", none.alias("key"), F.lit("unmatched").alias("tier"))).unionByName(unused)


#: Bytes of bit rows that one comparison keeps for its way back; beyond that it is cut in two.
ROWS_KEPT = 64 << 20
#: Tokens that a comparison keeps before it hands them on.
TOKENS_KEPT = 16384


def _bit_rows(a: list, b: list) -> Iterator[int]:
    """For every prefix of a, a number whose zero bits are the steps of the longest common lengths along b."""
    where: dict = {}
    for j, x in enumerate(b):
        where[x] = where.get(x, 0) | 1 << j
    full = (1 << len(b)) - 1
    row = full
    for x in a:
        on = row & where.get(x, 0)
        row = ((row + on) | (row - on)) & full
        yield row


def _lengths(a: list, b: list) -> np.ndarray:
    """Longest common length of a and each prefix of b."""
    row = (1 << len(b)) - 1
    for row in _bit_rows(a, b):
        pass
    bits = np.unpackbits(np.frombuffer(row.to_bytes(len(b) // 8 + 1, "little"), np.uint8), bitorder="little")[: len(b)]
    return np.concatenate([[0], np.cumsum(1 - bits.astype(np.int64))])


def longest_common(a: list, b: list) -> list[tuple[int, int]]:
    """Index pairs of a longest common subsequence.

    Equal ends are taken off first. Rows of the table are bits of one number each, so a pair of n and m words costs n
    operations on m bits whatever repeats in it; long pairs are halved where both halves together reach the whole length,
    so that what is kept stays bounded.
    """
    lo = 0
    while lo < min(len(a), len(b)) and a[lo] == b[lo]:
        lo += 1
    hi = 0
    while hi < min(len(a), len(b)) - lo and a[-1 - hi] == b[-1 - hi]:
        hi += 1
    out = [(k, k) for k in range(lo)]
    x, y = a[lo : len(a) - hi], b[lo : len(b) - hi]
    if x and y:
        if len(x) > 1 and len(x) * len(y) // 8 > ROWS_KEPT:
            half = len(x) // 2
            reach = _lengths(x[:half], y) + _lengths(x[half:][::-1], y[::-1])[::-1]
            at = int(reach.argmax())
            found = longest_common(x[:half], y[:at]) + [(half + i, at + j) for i, j in longest_common(x[half:], y[at:])]
        else:
            rows, found, i, j = list(_bit_rows(x, y)), [], len(x), len(y)
            while i and j:
                if rows[i - 1] >> (j - 1) & 1:
                    j -= 1
                elif i > 1 and not rows[i - 2] >> (j - 1) & 1:
                    i -= 1
                else:
                    i, j = i - 1, j - 1
                    found.append((i, j))
            found.reverse()
        out += [(lo + i, lo + j) for i, j in found]
    return out + [(len(a) - hi + k, len(b) - hi + k) for k in range(hi)]


def text_diff(pairs: DataFrame, key: list[str], ignore_case: bool = False, ignore_whitespace: bool = True) -> DataFrame:
    """(key, a, b) -> tokens of both texts with a change: unchanged, removed, added; a removed run followed by an added
    one is changed. One row a token: side, pos, token, change.

    `ignore_case` compares lower-cased tokens; without `ignore_whitespace` the runs of white space are tokens too. A
    pair of texts is one unit of work, bounded by their lengths; no pair meets another, and tokens are handed on as they
    come, so a task holds those of one pair.
    """
    schema = pairs.select(*key).schema.add("side", "string").add("pos", "long").add("token", "string").add("change", "string")

    def tokens(t: str | None) -> list[str]:
        return (t or "").split() if ignore_whitespace else [x for x in re.split(r"(\s+)", t or "") if x]

    def run(frames):
        rows = []
        for f in frames:
            for *k, x, y in zip(*(f[c] for c in (*key, "a", "b")), strict=True):
                a, b = tokens(x), tokens(y)
                same = longest_common([x.lower() for x in a], [x.lower() for x in b]) if ignore_case else longest_common(a, b)
                i = j = 0
                for x, y in [*same, (len(a), len(b))]:
                    both = x > i and y > j
                    rows += [(*k, "old", p, a[p], "changed" if both else "removed") for p in range(i, x)]
                    rows += [(*k, "new", p, b[p], "changed" if both else "added") for p in range(j, y)]
                    if x < len(a):
                        rows.append((*k, "both", x, a[x], "unchanged"))
                    i, j = x + 1, y + 1
                    if len(rows) >= TOKENS_KEPT:
                        yield pd.DataFrame(rows, columns=[*key, "side", "pos", "token", "change"])
                        rows = []
        yield pd.DataFrame(rows, columns=[*key, "side", "pos", "token", "change"])

    return pairs.select(*key, "a", "b").mapInPandas(run, schema)


def diff_counts(pairs: DataFrame, key: list[str], ignore_case: bool = False, ignore_whitespace: bool = True) -> DataFrame:
    """(key, a, b) -> words added, removed and changed of every pair: where removed words meet added ones, the last
    removed and the first added are one changed word."""
    schema = pairs.select(*key).schema.add("added", "long").add("removed", "long").add("changed", "long")

    def run(frames):
        for f in frames:
            rows = []
            for r in f.to_dict("records"):
                a, b = ((r[c] or "").lower() if ignore_case else r[c] or "" for c in ("a", "b"))
                a, b = (x.split() if ignore_whitespace else [t for t in re.split(r"(\s+)", x) if t] for x in (a, b))
                added = removed = changed = i = j = 0
                for x, y in [*longest_common(a, b), (len(a), len(b))]:
                    both = int(x > i and y > j)
                    added, removed, changed = added + y - j - both, removed + x - i - both, changed + both
                    i, j = x + 1, y + 1
                rows.append((*[r[k] for k in key], added, removed, changed))
            yield pd.DataFrame(rows, columns=[*key, "added", "removed", "changed"])

    return pairs.select(*key, "a", "b").mapInPandas(run, schema)


def diff_summary(aligned: DataFrame, pages: DataFrame, pair: str, **options) -> DataFrame:
    """page_align's rows and its pages -> per pair: pages compared, identical, changed, added and removed, and total
    words added, removed and changed (all words of pages on one side only)."""
    side = lambda s, no, t: pages.filter(F.col("side") == s).select(pair, F.col("page_no").alias(no), F.coalesce("text", F.lit("")).alias(t))
    both = aligned.join(side("old", "old_no", "a"), [pair, "old_no"], "left").join(side("new", "new_no", "b"), [pair, "new_no"], "left")
    d = diff_counts(both, [pair, "old_no", "new_no"], **options)
    n = lambda c: F.sum(c.cast("long"))
    old, new = F.col("old_no").isNotNull(), F.col("new_no").isNotNull()
    same = F.col("added") + F.col("removed") + F.col("changed") == 0
    return d.groupBy(pair).agg(
        F.greatest(n(old), n(new)).alias("pages_compared"), n(old & new & same).alias("pages_identical"), n(old & new & ~same).alias("pages_changed"), n(~old).alias("pages_added"), n(~new).alias("pages_removed"),
        F.sum("added").alias("words_added"), F.sum("removed").alias("words_removed"), F.sum("changed").alias("words_changed"),
    )


def page_align(pages: DataFrame, pair: str, gap: float = -0.15, alike: float = 0.3, unlike: float = -0.2) -> DataFrame:
    """(pair, side, page_no, text) -> aligned pages: pair, old_no, new_no, similarity, in page order.

    Equal counts with every page similar stay one to one; otherwise an order-preserving alignment by word similarity: pages
    at least `alike` gain their similarity, others that are put together cost `unlike`, one left alone costs `gap`.

    Similarities come from the words that pages share, a row of them at a time, and only pairs of at least `alike` are
    kept. The alignment is the best chain of such pairs: what lies between two of them costs by its numbers of pages
    alone, so no table of all pairs is made. A version is a unit of work; versions are spread over tasks.
    """

    def run(f: pd.DataFrame) -> pd.DataFrame:
        f = f.sort_values("page_no")
        a, b = ([(n, set((t or "").lower().split())) for n, t in zip(g.page_no, g.text)] for g in (f[f.side == "old"], f[f.side == "new"]))
        like = lambda x, y: 1.0 if not x and not y else len(x & y) / max(1, len(x | y))
        if len(a) == len(b) and all(like(x, y) >= 0.2 for (_, x), (_, y) in zip(a, b)):
            way = [(k, k) for k in range(len(a))]
        else:
            way = aligned([x for _, x in a], [y for _, y in b], gap, alike, unlike)
        rows = [(f[pair].iloc[0], a[i][0] if i is not None else None, b[j][0] if j is not None else None, like(a[i][1], b[j][1]) if i is not None and j is not None else 0.0) for i, j in way]
        return pd.DataFrame(rows, columns=[pair, "old_no", "new_no", "similarity"]).astype({"old_no": "Int64", "new_no": "Int64"})

    schema = pages.select(pair).schema.add("old_no", "long").add("new_no", "long").add("similarity", "double")
    return pages.groupBy(pair).applyInPandas(run, schema)


def shared_pages(a: list[set], b: list[set], alike: float) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """For every page of a, the pages of b that are at least `alike`, and how alike they are."""
    where: dict = {}
    for j, words in enumerate(b):
        for w in words:
            where.setdefault(w, []).append(j)
    places = {w: np.array(js) for w, js in where.items()}
    sizes = np.array([len(y) for y in b])
    for i, x in enumerate(a):
        both = np.zeros(len(b), np.int64)
        for w in x:
            if w in places:
                both[places[w]] += 1
        like = np.where((sizes == 0) & (len(x) == 0), 1.0, both / np.maximum(1, len(x) + sizes - both))
        near = np.flatnonzero(like >= alike)
        yield i, near, like[near]


#: Pairs a page, on average, beyond which an alignment goes by a table.
DENSE = 16


def aligned_table(a: list[set], b: list[set], gap: float, alike: float, unlike: float) -> list[tuple[int | None, int | None]]:
    """The same alignment row by row: one row of values, and a byte a pair for the way back."""
    m = len(b)
    steps = gap * np.arange(m + 1)
    row, ways = steps, np.zeros((len(a) + 1, m + 1), np.int8)
    ways[0] = 2
    for i, js, likes in shared_pages(a, b, alike):
        worth = np.full(m, unlike)
        worth[js] = likes
        both, up = np.append(-np.inf, row[:-1] + worth), row + gap
        over = np.maximum(both, up)
        bare = over - steps
        most = np.maximum.accumulate(bare)
        ways[i + 1] = np.where(most > bare, 2, np.where(both >= up, 0, 1))
        row = most + steps
    out, i, j = [], len(a), m
    while i or j:
        way = int(ways[i, j])
        i, j = i - (way != 2), j - (way != 1)
        out.append((i if way != 2 else None, j if way != 1 else None))
    return out[::-1]


def aligned(a: list[set], b: list[set], gap: float, alike: float, unlike: float) -> list[tuple[int | None, int | None]]:
    """The best order-preserving alignment, as pairs of indices with None for a page alone: the best chain over pairs that
    are alike. `unlike` costs no more than two gaps (ValueError otherwise), so that between links as many pages as
    possible are put together. Where most pairs are alike, so that they are a table themselves, a table of bytes serves."""
    if unlike < 2 * gap:
        raise ValueError("two pages alone must not cost less than two put together")
    I, J, best, back = [], [], [], []  # noqa: E741  chain ends: places, value up to there, the one before

    def between(p, q):
        return unlike * np.minimum(p, q) + gap * np.abs(p - q)

    for i, js, likes in shared_pages(a, b, alike):
        if len(I) > DENSE * (len(a) + len(b)):
            return aligned_table(a, b, gap, alike, unlike)
        ends_i, ends_j, value = np.array(I, np.int64), np.array(J, np.int64), np.array(best)
        for j, s in zip(js.tolist(), likes.tolist()):
            top, at = between(i, j), -1
            if len(value):
                way = np.where(ends_j < j, value + between(i - ends_i - 1, j - ends_j - 1), -np.inf)
                k = int(way.argmax())
                if way[k] > top:
                    top, at = way[k], k
            I.append(i)
            J.append(j)
            best.append(float(top + s))
            back.append(at)
    n, m, k = len(a), len(b), -1
    if best:
        way = np.array(best) + between(n - np.array(I) - 1, m - np.array(J) - 1)
        k = int(way.argmax())
        if way[k] < between(n, m):
            k = -1
    chain = []
    while k >= 0:
        chain.append((I[k], J[k]))
        k = back[k]
    out, i, j = [], 0, 0
    for x, y in [*reversed(chain), (n, m)]:
        both = min(x - i, y - j)
        out += [(i + t, j + t) for t in range(both)] + [(t, None) for t in range(i + both, x)] + [(None, t) for t in range(j + both, y)]
        if x < n:
            out.append((x, y))
        i, j = x + 1, y + 1
    return out


def slot_of(name: Column, mime: Column, target: str = "photo") -> Column:
    """The requirement slot of a file: pdf for PDF files, else what the profile is made for."""
    return F.when((F.lower(F.coalesce(mime, F.lit(""))) == "application/pdf") | F.lower(name).endswith(".pdf"), "pdf").otherwise(target)


def file_format(name: Column, mime: Column) -> Column:
    """PDF, PNG, WEBP or JPEG by type, else by ending; UNKNOWN otherwise."""
    t, n = F.lower(F.coalesce(mime, F.lit(""))), F.lower(F.coalesce(name, F.lit("")))
    kinds = [("PDF", ["pdf"], [".pdf"]), ("PNG", ["png"], [".png"]), ("WEBP", ["webp"], [".webp"]), ("JPEG", ["jpeg", "jpg"], [".jpg", ".jpeg"])]
    out = F.lit("UNKNOWN")
    for kind, types, ends in reversed(kinds):
        is_kind = F.lit(False)
        for x in types:
            is_kind = is_kind | F.contains(t, F.lit(x))
        for x in ends:
            is_kind = is_kind | n.endswith(x)
        out = F.when(is_kind, kind).otherwise(out)
    return out


def batch_audit(files: DataFrame, profile: dict, key: str) -> DataFrame:
    """Files (key, name, type, bytes, width, height; null width: not decodable) against a profile -> key, slot, failed
    (names of failed rules), passed, fixable.

    profile: target (photo or signature), dpi, and requirements by slot (photo, signature, pdf), each with format, min_kb,
    max_kb, width, height, unit, dpi, aspect_ratio, all optional. A slot without requirements takes the first there is of
    photo, signature and pdf. Rules: format (JPG is JPEG), size in whole KB (2,048 for PDF, 200 else, unless stated),
    and for images dimensions to the pixel and a ratio within 0.05. A failed rule is fixable but for a PDF's format, an
    image that should be a PDF, a file too small and one that cannot be decoded; a file is if all its failed rules are.
    """
    pdf = F.col("_slot") == "pdf"
    df = files.withColumn("_slot", slot_of(F.col("name"), F.col("type"), profile.get("target") or "photo"))
    kb, w, h = rounded(F.col("bytes") / 1024), F.col("width"), F.col("height")
    actual = file_format(F.col("name"), F.col("type"))
    rules = F.array().cast("array<struct<rule:string,ok:boolean,fixable:boolean>>")
    rule = lambda n, ok, fixable: F.struct(F.lit(n).alias("rule"), ok.alias("ok"), fixable.alias("fixable"))
    for slot in ("pdf", "photo", "signature"):
        need = profile.get(slot) or profile.get("photo") or profile.get("signature") or profile.get("pdf") or {}
        is_pdf = slot == "pdf"
        expected = (need.get("format") or ("PDF" if is_pdf else "JPEG")).upper()
        least, most = need.get("min_kb") or 0, need.get("max_kb") or (2048 if is_pdf else 200)
        found = [rule("format", actual == ("JPEG" if expected == "JPG" else expected), F.lit(not is_pdf and "PDF" not in expected)), rule("size", (kb <= most) & ((kb >= least) if least else F.lit(True)), kb > most)]
        if not is_pdf:
            seen = w.isNotNull() & h.isNotNull()
            found.append(F.when(~seen, rule("decoding", F.lit(False), F.lit(False))))
            if need.get("width") and need.get("height"):
                dpi, unit = F.lit(need.get("dpi") or profile.get("dpi") or 300), F.lit(need.get("unit") or "px")
                wide, high = (F.coalesce(F.lit(need.get(f"{c}_px")), unit_to_px(F.lit(need[c]), unit, dpi)) for c in ("width", "height"))
                found.append(F.when(seen, rule("dimensions", (w == wide) & (h == high), F.lit(True))))
            if need.get("aspect_ratio"):
                parts = [float(m[0]) if (m := re.match(r"\s*[0-9.]+", p)) else 0.0 for p in re.split("[:/]", need["aspect_ratio"])]
                known = len(parts) == 2 and all(parts)
                near = F.abs(w / F.nullif(h, F.lit(0)) - parts[0] / parts[1]) < 0.05 if known else F.lit(True)
                found.append(F.when(seen, rule("aspect_ratio", F.coalesce(near | (w == 0), F.lit(True)), F.lit(True))))
        rules = F.when(F.col("_slot") == slot, F.array_compact(F.array(*found))).otherwise(rules)
    out = df.select(key, F.col("_slot").alias("slot"), F.filter(rules, lambda r: ~r["ok"]).alias("_f"))
    return out.select(key, "slot", F.transform("_f", lambda r: r["rule"]).alias("failed"), (F.size("_f") == 0).alias("passed"), ((F.size("_f") > 0) & F.forall("_f", lambda r: r["fixable"])).alias("fixable"))


def audit_totals(audited: DataFrame) -> DataFrame:
    """One row: files, compliant, non_compliant, fixable and unfixable ones."""
    n = lambda c: F.coalesce(F.sum(c.cast("long")), F.lit(0))
    return audited.agg(F.count("*").alias("files"), n(F.col("passed")).alias("compliant"), n(~F.col("passed")).alias("non_compliant"), n(F.col("fixable")).alias("fixable"), n(~F.col("passed") & ~F.col("fixable")).alias("unfixable"))


# Rules of a preflight and whether a miss fails or warns.
PREFLIGHT = {
    "max_file_size": "fail", "page_count_range": "fail", "page_size_uniformity": "fail", "orientation_uniformity": "fail", "min_image_dpi": "warn", "fonts_embedded": "warn", "no_encryption": "fail",
    "no_javascript": "fail", "no_attachments": "fail", "searchable_text": "warn", "no_blank_pages": "warn",
}
# Two profiles; a rule that a profile does not name is not applied.
PROFILES = {
    "200kb_a4": {"max_bytes": 200 * 1024, "min_pages": 1, "max_pages": 2, "uniform_size": True, "uniform_orientation": True, "min_dpi": 150, "fonts": True, "no_encryption": True, "no_javascript": True, "no_attachments": True, "searchable": True, "no_blank": True},
    "1mb_standard": {"max_bytes": 1024 * 1024, "min_pages": 1, "max_pages": 10, "uniform_orientation": True, "min_dpi": 150, "no_encryption": True, "no_javascript": True, "no_attachments": True, "searchable": True, "no_blank": True},
}


def preflight(files: DataFrame, pages: DataFrame, key: str, profile: dict) -> DataFrame:
    """Eleven rules of a profile: files (key, bytes, encrypted, scripts, attachments, loose_fonts), pages (key, width,
    height, dpi, chars) -> key, a status (pass, fail, warn; null where the profile has no such rule) for each rule, counts
    of each and passed (nothing fails; warnings are allowed).

    Sizes are compared in whole units, images by the lowest dpi of pages that have one, text by 50 characters in all,
    blank pages by none. A file without pages has none.
    """
    d = lambda c: F.coalesce(c, F.lit(0))
    size = F.struct(rounded(F.col("width")).alias("w"), rounded(F.col("height")).alias("h"))
    wide = (F.col("width") > F.col("height")).cast("int")
    g = pages.groupBy(key).agg(F.count("*").alias("_n"), F.countDistinct(size).alias("_sizes"), F.countDistinct(wide).alias("_kinds"), F.min("dpi").alias("_dpi"), F.sum(d(F.col("chars"))).alias("_chars"), F.sum((d(F.col("chars")) == 0).cast("long")).alias("_blank"))
    df = files.join(g, key, "left")
    n = d(F.col("_n"))
    on = lambda *names: any(profile.get(x) for x in names)
    checks = {
        "max_file_size": F.col("bytes") <= profile["max_bytes"] if on("max_bytes") else None,
        "page_count_range": n.between(profile.get("min_pages", 1), profile.get("max_pages", 9999)) if on("min_pages", "max_pages") else None,
        "page_size_uniformity": d(F.col("_sizes")) <= 1 if on("uniform_size") else None,
        "orientation_uniformity": d(F.col("_kinds")) <= 1 if on("uniform_orientation") else None,
        "min_image_dpi": F.col("_dpi").isNull() | (F.col("_dpi") >= profile["min_dpi"]) if on("min_dpi") else None,
        "fonts_embedded": d(F.col("loose_fonts")) == 0 if on("fonts") else None,
        "no_encryption": ~F.coalesce("encrypted", F.lit(False)) if on("no_encryption") else None,
        "no_javascript": d(F.col("scripts")) == 0 if on("no_javascript") else None,
        "no_attachments": d(F.col("attachments")) == 0 if on("no_attachments") else None,
        "searchable_text": d(F.col("_chars")) >= 50 if on("searchable") else None,
        "no_blank_pages": d(F.col("_blank")) == 0 if on("no_blank") else None,
    }
    status = {r: F.lit(None).cast("string") if ok is None else F.when(ok, "pass").otherwise(PREFLIGHT[r]) for r, ok in checks.items()}
    out = df.select(key, *[c.alias(r) for r, c in status.items()])
    count = lambda s: sum((F.coalesce((F.col(r) == s).cast("long"), F.lit(0)) for r in status), F.lit(0))
    return out.withColumn("passes", count("pass")).withColumn("fails", count("fail")).withColumn("warns", count("warn")).withColumn("passed", F.col("fails") == 0)


# Units of a requirement.
UNITS = ("px", "mm", "cm", "in")
_REQUIREMENT = "maxKb string, minKb string, width string, height string, unit string, dpi string"
PROFILE_SCHEMA = f"version string, id string, name string, photo struct<{_REQUIREMENT.replace(' ', ':').replace(',:', ',')}>, signature struct<{_REQUIREMENT.replace(' ', ':').replace(',:', ',')}>, pdf struct<{_REQUIREMENT.replace(' ', ':').replace(',:', ',')}>"


def profile_error(text: Column, most: int = 102_400) -> Column:
    """Why a requirement profile in JSON is not valid, the first reason only; null if it is valid."""
    t = F.trim(F.coalesce(text, F.lit("")))
    p = F.from_json(t, PROFILE_SCHEMA, {"mode": "PERMISSIVE"})
    blank = lambda c: F.trim(F.coalesce(c, F.lit(""))) == ""
    keys = F.coalesce(F.json_object_keys(t), F.array().cast("array<string>"))
    checks: list[tuple[Column, str]] = [
        (t != "", "Empty input: Please provide valid profile JSON text."),
        (F.length(t) <= most, f"Payload too large: Profile JSON cannot exceed {most // 1024} KB."),
        (~t.rlike(r'(?i)"(?:__proto__|constructor|prototype)"\s*:'), "Security violation: Prototype pollution attempt detected."),
        (F.try_parse_json(t).isNotNull(), "Malformed JSON: The provided text is not valid JSON syntax."),
        (t.startswith("{"), "Malformed JSON: Expected a JSON object definition."),
        (F.array_contains(keys, "version"), "Missing required field 'version'"),
        (p["version"] == "1.0", "Unsupported profile version. Only version '1.0' is supported."),
        (~blank(p["id"]), "Missing required field 'id'"),
        (~blank(p["name"]), "Missing required field 'name'"),
        (p["photo"].isNotNull() | p["signature"].isNotNull() | p["pdf"].isNotNull(), "Profile must contain at least one specification section: 'photo', 'signature', or 'pdf'."),
    ]
    for s in ("photo", "signature", "pdf"):
        r = p[s]
        number = lambda c, r=r: r[c].try_cast("double")
        optional = lambda c, ok, s=s, r=r: r.isNull() | r[c].isNull() | F.coalesce(ok, F.lit(False))
        checks += [
            (r.isNull() | r["maxKb"].isNotNull(), f"Field '{s}.maxKb' is required and must be a positive number."),
            (optional("maxKb", number("maxKb") > 0), f"Field '{s}.maxKb' must be a positive number."),
            (optional("minKb", number("minKb") >= 0), f"Field '{s}.minKb' must be a non-negative number."),
            (optional("minKb", number("minKb") <= number("maxKb")), f"Field '{s}.minKb' cannot exceed '{s}.maxKb'."),
            *[(optional(c, number(c) > 0), f"Field '{s}.{c}' must be a positive number.") for c in ("width", "height")],
            (optional("unit", r["unit"].isin(*UNITS)), f"Field '{s}.unit' must be one of 'px', 'mm', 'cm', or 'in'."),
            (optional("dpi", number("dpi") > 0), f"Field '{s}.dpi' must be a positive number."),
        ]
    return first_error(checks)


# Sizes in KB or MB and their order of trial, sizes in length units, and ratios of known formats.
_N, _KB = r"(\d{1,8}(?:\.\d{1,4})?)", r"(kb|kbytes?|mb|mbytes?)"
_D, _UNIT = r"(\d{1,6}(?:\.\d{1,4})?)", r'(px|pixels?|mm|cms?|centimeters?|millimeters?|in|inch(?:es)?|")'
SIZES = {
    "range": rf"(?i)(?:between|from)?\s{{0,20}}{_N}\s{{0,20}}{_KB}\s{{0,20}}(?:to|and|-|–)\s{{0,20}}{_N}\s{{0,20}}{_KB}",
    "short": rf"(?i)(?:size[\s:]{{0,10}})?{_N}\s{{0,20}}(?:-|–|to)\s{{0,20}}{_N}\s{{0,20}}{_KB}",
    "min": rf"(?i)(?:min(?:imum)?\.?|not\s+less\s+than|at\s+least|above|>=?)[\s:]{{0,10}}{_N}\s{{0,20}}{_KB}",
    "max": rf"(?i)(?:max(?:imum)?\.?|not\s+(?:more\s+than|exceeding)|up\s+to|less\s+than|within|<=?)[\s:]{{0,10}}{_N}\s{{0,20}}{_KB}",
    "after": rf"(?i){_N}\s{{0,20}}{_KB}\s{{0,20}}(?:max(?:imum)?|\(maximum\)|or\s+less)",
    "plain": rf"(?i)(?:file\s*size|size)[\s:]{{0,10}}{_N}\s{{0,20}}{_KB}",
}
DIMENSIONS = {
    "both": rf'(?i){_D}\s{{0,10}}(px|mm|cms?|in|inch(?:es)?|")?\s{{0,10}}(?:x|×|\*|by)\s{{0,10}}{_D}\s{{0,10}}{_UNIT}{E}',
    "width": rf"(?i)(?:width|w)[\s:]{{0,10}}{_D}\s{{0,10}}{_UNIT}?",
    "height": rf"(?i)(?:height|h)[\s:]{{0,10}}{_D}\s{{0,10}}{_UNIT}?",
    "width_after": rf"(?i){_D}\s{{0,10}}{_UNIT}?\s{{0,10}}(?:\(width\)|width{E})",
    "height_after": rf"(?i){_D}\s{{0,10}}{_UNIT}?\s{{0,10}}(?:\(height\)|height{E})",
}
KNOWN_RATIOS = {(3.5, 4.5): "3.5:4.5", (35.0, 45.0): "3.5:4.5", (350.0, 450.0): "3.5:4.5", (200.0, 230.0): "20:23"}


def parse_requirements(docs: DataFrame, text: str = "text") -> DataFrame:
    """Adds min_kb, max_kb, width, height, unit, ratio, dpi, formats, format and confidence of an upload instruction.

    Sizes come from the first of five patterns that matches, dimensions from the first of three (joint, width and
    height, the same behind their numbers). Ratios are stated, or of known formats, or by the greatest common divisor.
    Without sizes and dimensions parsed is false and the rest null.
    """
    df = docs.withColumn("_t", F.trim(F.coalesce(F.col(text), F.lit(""))))
    g = lambda p, k: F.regexp_extract("_t", p, k)
    num = lambda p, k: g(p, k).try_cast("double")
    kb = lambda p, v, u: rounded(F.when(F.lower(g(p, u)).startswith("m"), num(p, v) * 1024).otherwise(num(p, v))).cast("long")
    s, d = SIZES, DIMENSIONS
    ranges = [(g(s["range"], 1) != "", kb(s["range"], 1, 2), kb(s["range"], 3, 4)), (g(s["short"], 1) != "", kb(s["short"], 1, 3), kb(s["short"], 2, 3))]
    either = (g(s["min"], 1) != "") | (g(s["max"], 1) != "")
    low = F.when(ranges[0][0], F.least(*ranges[0][1:])).when(ranges[1][0], F.least(*ranges[1][1:])).when(either, kb(s["min"], 1, 2))
    high = F.when(ranges[0][0], F.greatest(*ranges[0][1:])).when(ranges[1][0], F.greatest(*ranges[1][1:])).when(either, kb(s["max"], 1, 2)).when(g(s["after"], 1) != "", kb(s["after"], 1, 2)).when(g(s["plain"], 1) != "", kb(s["plain"], 1, 2))
    two = lambda a, b: (g(d[a], 1) != "") & (g(d[b], 1) != "")
    some = lambda *cs: F.coalesce(*[F.when(c != "", c) for c in cs], F.lit("px"))
    joint, apart, after = g(d["both"], 1) != "", two("width", "height"), two("width_after", "height_after")
    pick = lambda x, y, z: F.when(joint, x).when(apart, y).when(after, z)
    unit = F.lower(pick(some(g(d["both"], 4), g(d["both"], 2)), some(g(d["width"], 2), g(d["height"], 2)), some(g(d["width_after"], 2), g(d["height_after"], 2))))
    named = F.when(unit.startswith("mm") | F.contains(unit, F.lit("milli")), "mm").when(unit.startswith("cm") | F.contains(unit, F.lit("centi")), "cm").when(unit.startswith("in") | (unit == '"'), "in").when(unit.isNotNull(), "px")
    df = df.withColumn("min_kb", low).withColumn("max_kb", high).withColumn("width", pick(num(d["both"], 1), num(d["width"], 1), num(d["width_after"], 1))).withColumn("height", pick(num(d["both"], 3), num(d["height"], 1), num(d["height_after"], 1))).withColumn("unit", named)
    said = [r"(?i)(?:aspect\s+ratio|ratio)[\s:]*(\d+(?:\.\d+)?)\s*[:/]\s*(\d+(?:\.\d+)?)", r"(?i)(\d+(?:\.\d+)?)\s*[:/]\s*(\d+(?:\.\d+)?)\s+aspect\s+ratio"]
    w, h = F.col("width"), F.col("height")
    ratio = F.when(g(said[0], 1) != "", F.concat_ws(":", g(said[0], 1), g(said[0], 2))).when(g(said[1], 1) != "", F.concat_ws(":", g(said[1], 1), g(said[1], 2))).when((w > 0) & (w == h), "1:1")
    for (x, y), name in KNOWN_RATIOS.items():
        ratio = ratio.when((w == x) & (h == y), name)
    a, b = rounded(w * 10).cast("long"), rounded(h * 10).cast("long")
    # Euclid's rule as a fold; numbers of seven digits need at most 33 steps
    step = lambda acc, _: F.when(acc["b"] == 0, acc).otherwise(F.struct(acc["b"].alias("a"), (acc["a"] % F.greatest(acc["b"], F.lit(1))).alias("b")))
    gcd = F.aggregate(F.sequence(F.lit(1), F.lit(40)), F.struct(a.alias("a"), b.alias("b")), step, lambda acc: acc["a"])
    df = df.withColumn("_g", F.when((w > 0) & (h > 0), gcd)).withColumn("ratio", ratio.when(F.col("_g") > 1, F.concat_ws(":", (a / F.col("_g")).cast("long").cast("string"), (b / F.col("_g")).cast("long").cast("string"))))
    dpi = g(rf"(?i)(?:resolution[\s:]*)?(\d{{2,4}})\s*(?:dpi|dots\s+per\s+inch){E}", 1).try_cast("long")
    df = df.withColumn("dpi", F.when(dpi.between(50, 2400), dpi)).withColumn("formats", F.array_distinct(F.transform(F.regexp_extract_all("_t", F.lit(rf"(?i){B}(jpeg|jpg|png|pdf){E}"), 1), lambda x: F.upper(x))))
    has = lambda f: F.array_contains("formats", f)
    df = df.withColumn("format", F.when(has("PDF"), "PDF").when(has("JPEG"), "JPEG").when(has("JPG"), "JPG").when(has("PNG"), "PNG").otherwise("JPEG"))
    size, shape = F.col("min_kb").isNotNull() | F.col("max_kb").isNotNull(), w.isNotNull() & h.isNotNull()
    sure = 0.4 + F.when(size, 0.25).otherwise(0.0) + F.when(shape, 0.25).otherwise(0.0) + F.when(F.col("dpi").isNotNull(), 0.05).otherwise(0.0) + F.when(F.size("formats") > 0, 0.05).otherwise(0.0)
    df = df.withColumn("parsed", size | shape).withColumn("confidence", F.when(F.col("parsed"), F.round(F.least(F.lit(1.0), sure), 2)))
    for c in ("ratio", "dpi", "formats", "format"):
        df = df.withColumn(c, F.when(F.col("parsed"), F.col(c)))
    return df.drop("_t", "_g")


def form_format(text: Column) -> Column:
    """json for objects and lists, else csv."""
    return F.when(F.trim(text).rlike(r"^[{\[]"), "json").otherwise("csv")


def csv_cells(line: Column) -> Column:
    """Cells of one CSV record: commas part them outside of quotes, doubled quotes are one."""
    raw = F.regexp_extract_all(line, F.lit(r'(?:^|,)("(?:[^"]|"")*"|[^,"]*)'), 1)
    return F.transform(raw, lambda c: F.when(c.startswith('"'), F.replace(F.substring(c, F.lit(2), F.length(c) - 2), F.lit('""'), F.lit('"'))).otherwise(c))


def form_fields(forms: DataFrame, id: str, text: str = "text") -> DataFrame:
    """(id, text) -> id, format, key, value of filled-in forms: JSON objects, or CSV with a line of names and one of values.

    Names are trimmed, cells get back the formula mark that a guard has quoted; nested JSON with a value gives that;
    fields named __proto__, constructor or prototype go; blank and malformed forms give no rows.
    """
    df = forms.select(id, F.trim(F.coalesce(F.col(text), F.lit(""))).alias("_t")).withColumn("format", form_format(F.col("_t")))
    given = F.from_json("_t", "map<string,string>")
    js = F.transform(F.map_entries(given), lambda e: F.struct(e["key"].alias("key"), F.coalesce(F.get_json_object(F.when(e["value"].startswith("{"), e["value"]), "$.value"), e["value"]).alias("value")))
    bare = lambda v: F.regexp_replace(v, r"^'(?=[=+\-@\t\r])", "")
    records = F.regexp_extract_all("_t", F.lit(r'((?:"(?:[^"]|"")*"|[^"\r\n])+)'), 1)
    names, values = csv_cells(F.try_element_at(records, F.lit(1))), csv_cells(F.try_element_at(records, F.lit(2)))
    cs = F.when(F.size(records) > 1, F.transform(names, lambda n, i: F.struct(bare(F.trim(n)).alias("key"), bare(F.coalesce(F.try_element_at(values, i + 1), F.lit(""))).alias("value"))))
    out = df.select(id, "format", F.explode(F.when(F.col("format") == "json", js).otherwise(cs)).alias("p")).select(id, "format", "p.key", "p.value")
    return out.filter((F.col("key") != "") & ~F.col("key").isin("__proto__", "constructor", "prototype"))


def related(items: DataFrame, key: str, group: list[str], links: DataFrame, limit: int = 4) -> DataFrame:
    """(key, group...), explicit (key, other, place) -> key, other, rank: explicit relations in their order first, then
    the first others of the same group by key, `limit` in all; nothing is related to itself.

    Of a group only the first rows can be anybody's fillers, so each item meets a bounded list, not its whole group.
    """
    known = items.select(key).distinct().withColumnRenamed(key, "other")
    own = links.filter(F.col(key) != F.col("other")).join(known, "other").groupBy(key, "other").agg(F.min("place").alias("place"))
    own = own.withColumn("rank", F.row_number().over(Window.partitionBy(key).orderBy("place", "other"))).filter(F.col("rank") <= limit)
    first = items.withColumn("_n", F.row_number().over(Window.partitionBy(*group).orderBy(key))).filter(F.col("_n") <= 2 * limit + 1)
    lists = first.groupBy(*group).agg(F.array_sort(F.collect_list(key)).alias("_all"))  # at most 2 * limit + 1 keys
    mine = own.groupBy(key).agg(F.transform(F.array_sort(F.collect_list(F.struct("rank", "other"))), lambda x: x["other"]).alias("_own"))
    df = items.select(key, *group).join(lists, group).join(mine, key, "left").withColumn("_own", F.coalesce("_own", F.array().cast(dict(lists.dtypes)["_all"])))
    picked = F.slice(F.concat("_own", F.filter("_all", lambda x: (x != F.col(key)) & ~F.array_contains("_own", x))), 1, limit)
    return df.select(key, F.posexplode(picked).alias("_k", "other")).select(key, "other", (F.col("_k") + 1).cast("long").alias("rank"))


def first_error(checks: list[tuple[Column, str]]) -> Column:
    """Message of the first check that fails, else null."""
    return F.coalesce(*[F.when(~F.coalesce(ok, F.lit(False)), F.lit(m)) for ok, m in checks])
