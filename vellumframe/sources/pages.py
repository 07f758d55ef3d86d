"""Documents to rows: pages, lines, sections, tokens, hits, keywords and cells."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as T
from ..functions.constants import QA_STOP_WORDS, STOP_WORDS, B, E
from .shared import by_document


def scan_doc_pages(docs: DataFrame, text: str = "text") -> DataFrame:
    """One row a page; pages part at form feeds, empty ones are dropped before numbering from 1."""
    pages = F.filter(F.split(F.col(text), "\f"), lambda x: x != "")
    rest = [c for c in docs.columns if c != text]
    return docs.select(*rest, F.posexplode(pages).alias("_k", text)).withColumn("page_no", (F.col("_k") + 1).cast("long")).drop("_k")


def cell_type(v: Column) -> Column:
    """currency, date, number or text, tried in that order; integers with a leading 0 are text."""
    money = v.rlike(r"^[$€£₹¥]\s*-?[\d,]+(\.\d+)?$|^-?[\d,]+(\.\d+)?\s*[$€£₹¥]$")
    date = v.rlike(r"^\d{1,2}[/.-]\d{1,2}[/.-]\d{2,4}$|^\d{4}[/-]\d{1,2}[/-]\d{1,2}$")
    number = v.rlike(r"^-?(\d+|\d{1,3}(,\d{3})+)(\.\d+)?%?$") & ~v.rlike(r"^0\d+$")
    return F.when(money, "currency").when(date, "date").when(number, "number").otherwise("text")


def script_distribution(docs: DataFrame, text: str = "text", cap: int | None = None) -> DataFrame:
    """Adds script (most characters; ties in table order), script_chars, a percentage per family and confidence.

    Whole texts are counted; `cap` limits it to their first characters.
    """
    whole = F.coalesce(F.col(text), F.lit(""))
    df = docs.withColumn("_s", whole if cap is None else F.substring(whole, 1, cap))
    for name in T.SCRIPTS:
        df = df.withColumn(f"_{name}", F.regexp_count("_s", F.lit(T.script_class(name))))
    counts = {n: F.col(f"_{n}") for n in T.SCRIPTS}
    total, top = sum(counts.values(), F.lit(0)), F.greatest(*counts.values())
    script = F.lit("unknown")
    for n in reversed(T.SCRIPTS):
        script = F.when(counts[n] == top, n).otherwise(script)
    df = df.withColumn("script_chars", total.cast("long")).withColumn("_top", top)
    none = F.col("script_chars") == 0
    df = df.withColumn("script", F.when(none, "unknown").otherwise(script))
    for n in T.SCRIPTS:
        df = df.withColumn(f"{n}_percent", F.when(none, 0).otherwise(T.rounded(counts[n] * 100.0 / F.greatest(F.lit(1), F.col("script_chars")))).cast("long"))
    sure = T.rounded(F.col("_top") / F.greatest(F.lit(1), F.col("script_chars")) * 100 * F.least(F.lit(1.0), F.col("script_chars") / 15))
    return df.withColumn("confidence", F.when(none, 0).otherwise(F.least(F.lit(99), sure)).cast("long")).drop("_s", "_top", *[f"_{n}" for n in T.SCRIPTS])


def script_label(text: Column) -> Column:
    """The first of three Indic blocks that occurs at all, else latin."""
    out = F.lit("latin")
    for n in ("gurmukhi", "bengali", "devanagari"):
        out = F.when(text.rlike(T.script_class(n)), n).otherwise(out)
    return out


def search_tokens(docs: DataFrame, text: str = "text") -> DataFrame:
    """(doc_id, term, pos): search terms of over one character that are no stop words."""
    parts = F.split(F.lower(F.col(text)), r"[^a-z0-9\x{0900}-\x{097F}\x{0980}-\x{09FF}\x{0A00}-\x{0A7F}]+")
    terms = F.filter(parts, lambda x: (F.length(x) > 1) & ~x.isin(QA_STOP_WORDS))
    return docs.select("doc_id", F.posexplode(terms).alias("pos", "term")).select("doc_id", "term", (F.col("pos") + 1).cast("long").alias("pos"))


def heading_sections(lines: DataFrame) -> DataFrame:
    """(doc_id, line_no, line) -> sections that start at lines that look like headings: section, title, n_lines, content."""
    df = lines.withColumn("heading", T.is_heading(F.col("line")))
    df = df.withColumn("section", F.sum(F.col("heading").cast("long")).over(Window.partitionBy("doc_id").orderBy("line_no")))
    body = F.array_join(F.transform(F.array_sort(F.collect_list(F.when(~F.col("heading"), F.struct("line_no", "line")))), lambda x: x["line"]), " ")
    return df.groupBy("doc_id", "section").agg(F.coalesce(F.max(F.when(F.col("heading"), F.col("line"))), F.lit("Introduction")).alias("title"), F.sum((~F.col("heading")).cast("long")).alias("n_lines"), body.alias("content"))


def section_split(docs: DataFrame, text: str = "text") -> DataFrame:
    """(doc_id, text) -> section (from 1), title, content: parts at form feeds, else at `#` to `###` lines if these give
    two sections with text, else the whole. Null texts are one empty section.

    A heading names the lines up to the next one; lines before the first are the Introduction; headings without text
    below them give no section.
    """
    t = F.coalesce(F.col(text), F.lit(""))
    trim = lambda x: F.regexp_replace(x, r"^\s+|\s+$", "")
    row = lambda title, body: F.struct(title.alias("title"), trim(body).alias("content"))
    pages = F.transform(F.filter(F.split(t, "\f"), lambda p: p != ""), lambda p, i: row(F.concat(F.lit("Page "), (i + 1).cast("string")), p))
    # a mark before every heading line parts the text; each part but the first begins with its heading
    parts = F.split(F.regexp_replace(F.concat(F.lit("# Introduction\n"), F.regexp_replace(t, "\r\n", "\n")), r"(?m)^#{1,3}[ \t]+(?=\S)", "\x01"), "\x01")
    named = F.transform(F.filter(parts, lambda p: p != ""), lambda p: row(F.trim(F.regexp_extract(p, r"^([^\n]*)", 1)), F.regexp_replace(p, r"^[^\n]*\n?", "")))
    named = F.filter(named, lambda s: s["content"] != "")
    whole = F.array(row(F.lit("Full Document"), t))
    sections = F.when(F.contains(t, F.lit("\f")), pages).when(F.size(named) > 1, named).otherwise(whole)
    out = docs.select("doc_id", F.posexplode(sections).alias("_k", "_s"))
    return out.select("doc_id", (F.col("_k") + 1).cast("long").alias("section"), "_s.title", "_s.content")


def literal_pattern(term: str, case_sensitive: bool = False, whole_word: bool = False) -> str:
    """Pattern of a literal term; word edges are ASCII."""
    pattern = B + re.escape(term) + E if whole_word else re.escape(term)
    return pattern if case_sensitive else "(?i)" + pattern


def find_count(text: Column, term: str, case_sensitive: bool = False, whole_word: bool = False) -> Column:
    """Hits of a literal term."""
    return F.regexp_count(text, F.lit(literal_pattern(term, case_sensitive, whole_word))).cast("long")


def find_literal(docs: DataFrame, term: str, case_sensitive: bool = False, whole_word: bool = False, text: str = "text") -> DataFrame:
    """(doc_id, text) -> every hit of a literal term: hit (from 1), at (from 0) and the matched text."""
    p = literal_pattern(term, case_sensitive, whole_word)
    df = docs.select("doc_id", F.split(F.col(text), p, -1).alias("_s"), F.regexp_extract_all(F.col(text), F.lit(f"({p})"), 1).alias("_m")).filter(F.size("_m") > 0)
    # one fold carries the place along, so a text's hits cost its length once
    start = F.struct(F.lit(0).cast("long").alias("at"), F.array().cast("array<bigint>").alias("all"))
    place = F.aggregate("_s", start, lambda acc, part: F.struct((acc["at"] + F.length(part) + len(term)).alias("at"), F.array_append(acc["all"], acc["at"] + F.length(part)).alias("all")))["all"]
    df = df.select("doc_id", F.posexplode(F.arrays_zip(F.slice(place, F.lit(1), F.size("_m")).alias("at"), F.col("_m").alias("found"))).alias("_k", "_h"))
    return df.select("doc_id", (F.col("_k") + 1).cast("long").alias("hit"), F.col("_h.at").alias("at"), F.col("_h.found").alias("found"))


def find_snippets(docs: DataFrame, term: str, around: int = 40) -> DataFrame:
    """(doc_id, text) -> every case-insensitive hit: match_index, at (0-based), snippet of 40 characters around it.

    Hits are cut out of the text in the row that holds it, so that no hit carries the whole text along.
    """
    low, n = term.lower(), len(term)
    df = docs.filter(F.contains(F.lower("text"), F.lit(low))).select("doc_id", F.col("text").alias("_x"), F.split(F.lower("text"), re.escape(low), -1).alias("_parts"))
    start = F.struct(F.lit(0).alias("at"), F.array().cast("array<int>").alias("all"))
    places = F.aggregate("_parts", start, lambda acc, p: F.struct((acc["at"] + F.length(p) + n).alias("at"), F.array_append(acc["all"], acc["at"] + F.length(p)).alias("all")))["all"]

    def cut(at: Column, x: Column) -> Column:
        return F.substring(x, F.greatest(F.lit(1), at - around + 1), F.least(at, F.lit(around)) + n + around)

    hits = T.let(F.struct(F.col("_x").alias("x"), F.slice(places, F.lit(1), F.size("_parts") - 1).alias("p")), lambda h: F.transform(h["p"], lambda at: F.struct(at.cast("long").alias("at"), cut(at, h["x"]).alias("snippet"))))
    out = df.select("doc_id", F.posexplode(hits).alias("_k", "_h"))
    return out.select("doc_id", (F.col("_k") + 1).cast("long").alias("match_index"), "_h.at", "_h.snippet")


def cased(match: Column, to: Column) -> Column:
    """The replacement in the case of what it replaces: all capitals, one capital in front, else lower."""
    head, tail = (lambda c: F.substring(c, 1, 1)), (lambda c: F.substr(c, F.lit(2)))
    shout, one = (match == F.upper(match)) & (match != F.lower(match)), (head(match) == F.upper(head(match))) & (tail(match) == F.lower(tail(match)))
    return F.when(shout, F.upper(to)).when(one, F.concat(F.upper(head(to)), F.lower(tail(to)))).otherwise(F.lower(to))


def replace_terms(text: Column, rules: list[tuple[str, str, str]]) -> Column:
    """Apply (kind, find, replacement) rules in order; kinds: literal, word (whole words), regex, and cased or cased_word,
    which match any case and keep that of each hit."""
    for kind, find, to in rules:
        if kind == "literal":
            text = F.replace(text, F.lit(find), F.lit(to))
        elif kind in ("cased", "cased_word"):
            pattern = literal_pattern(find, whole_word=kind == "cased_word")
            hits = F.transform(F.regexp_extract_all(text, F.lit(f"({pattern})"), 1), lambda m: cased(m, F.lit(to)))  # noqa: B023  built at once
            pairs = F.zip_with(F.split(text, pattern, -1), hits, lambda a, b: F.concat(a, F.coalesce(b, F.lit(""))))
            text = F.array_join(pairs, "")
        else:
            pattern = find if kind == "regex" else B + re.escape(find) + E
            text = F.regexp_replace(text, pattern, to.replace("\\", "\\\\").replace("$", "\\$") if kind == "word" else to)
    return text


def glossary(text: Column, lexicon: list[tuple[str, str]]) -> Column:
    """Whole-word substitution in lexicon order, each on what the one before left."""
    for find, to in lexicon:
        text = F.regexp_replace(text, f"(?i){B}{re.escape(find)}{E}", to.replace("\\", "\\\\").replace("$", "\\$"))
    return text


# Look-alike swaps tried in order.
SWAPS = [("0", "O"), ("1", "l"), ("rn", "m"), ("cl", "d"), ("vv", "w"), ("5", "S"), ("8", "B"), ("O", "0"), ("l", "1"), ("m", "rn")]


def spelling_variants(word: Column, most: int = 5) -> Column:
    """Distinct other spellings by look-alike swaps and title case, at most five."""
    title = F.concat(F.upper(F.substring(word, 1, 1)), F.lower(F.substring(word, 2, 1 << 20)))
    tried = F.array(*[F.replace(word, F.lit(a), F.lit(b)) for a, b in SWAPS], title)
    return F.slice(F.array_distinct(F.filter(tried, lambda x: x != word)), 1, most)


def keywords(docs: DataFrame, k: int = 15, text: str = "text") -> DataFrame:
    """The k most frequent words of each text (ties: first occurrence): doc_id, word, n, score, rank."""
    dealt = by_document(docs.select("doc_id", F.col(text).alias("_text")))
    w = dealt.withColumn("_w", T.spaced_words(F.col("_text"))).select("doc_id", F.size("_w").alias("total"), F.posexplode("_w").alias("pos", "raw"))
    w = w.withColumn("word", F.regexp_replace(F.lower("raw"), "[^a-z0-9ऀ-ॿঀ-৿਀-੿]", "")).filter((F.length("word") > 2) & ~F.col("word").isin(STOP_WORDS))
    c = w.groupBy("doc_id", "word").agg(F.count("*").alias("n"), F.min("pos").alias("first"), F.max("total").alias("total"))
    c = c.withColumn("rank", F.row_number().over(Window.partitionBy("doc_id").orderBy(F.desc("n"), "first"))).filter(F.col("rank") <= k)
    return c.select("doc_id", "word", "n", F.least(F.lit(100), T.rounded(F.col("n") / F.greatest(F.lit(1), F.col("total")) * 1000)).cast("long").alias("score"), F.col("rank").cast("long").alias("rank"))
