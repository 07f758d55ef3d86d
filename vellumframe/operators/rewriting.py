"""Texts rewritten by a dictionary table: longest phrases by equi-joins, put together again in order."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import let
from ..sources.pages import cased

#: A dictionary of at most so many phrases is one pattern of the plan, a larger one a table.
FEW = 64
#: Words and what stands between them.
PARTS = "([A-Za-z0-9_]+|[^A-Za-z0-9_]+)"


def dictionary_pattern_ok(pattern: str | None) -> bool:
    """The dictionary's guard: a regular expression of at most 100 characters without + or *, and without a counted
    repetition inside a repeated group. Another guard than the one of redactions, safe_pattern."""
    if not pattern or len(pattern) > 100 or re.search(r"[+*]|\([^)]*\{[0-9]+,[0-9]*\}[^)]*\)\{", pattern):
        return False
    try:
        re.compile(pattern)
    except re.error:
        return False
    return True


def checked_rules(rules: list[tuple[str, str, str]]) -> list[tuple[str, str, str]]:
    """Rules of replace_terms as a dictionary takes them: a regular expression that its guard rejects is a literal, rules
    without a target, over 100 characters or that change nothing go."""
    kept = [(k, find, to) for k, find, to in rules if find and find != to and max(len(find), len(to)) <= 100]
    return [("literal" if k == "regex" and not dictionary_pattern_ok(find) else k, find, to) for k, find, to in kept]


def parts_of(text: Column) -> Column:
    return F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(PARTS), 1)


def rewrite(docs: DataFrame, entries: DataFrame, text: str = "text", match_case: bool = False, keep_case: bool = False, few: int = FEW) -> DataFrame:
    """docs with whole-word phrases of `text` replaced: entries are (find, to[, rank]); of equal phrases the lowest rank
    holds. From left to right the longest phrase that begins at a word is taken, and what is put in is not looked at
    again. `keep_case` gives what is put in the case of what it replaces. A null text stays null.

    Phrases begin and end with a letter, digit or underscore (ValueError otherwise: replace_terms takes those). At most
    `few` phrases are one pattern, which a text is searched for where it lies. Of more, and where case beyond A-Z is to be
    looked through, a word meets the first words of phrases, then the phrases of the lengths that begin so, each by an equi-join; hits of a text
    come back to it by a digest of its row, which is the one time that texts are moved.
    """
    if entries.filter(~F.col("find").rlike(r"^[A-Za-z0-9_](?s:.*[A-Za-z0-9_])?$")).limit(1).count():
        raise ValueError("a phrase begins and ends with a letter, digit or underscore")
    low = (lambda c: c) if match_case else F.lower
    rank = F.col("rank") if "rank" in entries.columns else F.lit(0)
    known = entries.select(low(F.col("find")).alias("_phrase"), "to", rank.alias("_k")).groupBy("_phrase").agg(F.min(F.struct("_k", "to"))["to"].alias("_to"))
    listed = known.limit(few + 1).collect()
    if len(listed) <= few and all(r["_to"] is not None and (match_case or r["_phrase"].isascii()) for r in listed):
        return docs.withColumn(text, _put_few(F.col(text), {r["_phrase"]: r["_to"] for r in listed}, match_case, keep_case)) if listed else docs
    known = known.withColumn("_n", F.size(parts_of(F.col("_phrase")))).withColumn("_first", F.get(parts_of(F.col("_phrase")), F.lit(0)))
    longest = known.agg(F.coalesce(F.max("_n"), F.lit(1))).first()[0]  # one number
    firsts = known.groupBy("_first").agg(F.collect_set("_n").alias("_ns"))
    keyed = docs.withColumn("_key", F.md5(F.to_json(F.struct(*[F.col(c).alias(f"c{k}") for k, c in enumerate(docs.columns)]))))
    windows = let(parts_of(F.col(text)), lambda p: F.filter(F.transform(p, lambda w, i: F.struct(low(w).alias("w"), i.alias("i"), F.slice(p, i + 1, longest).alias("p"))), lambda x: x["w"].rlike("^[A-Za-z0-9_]")))
    words = keyed.select("_key", F.explode(windows).alias("_x")).select("_key", F.col("_x.w").alias("_first"), F.col("_x.i").alias("_i"), F.col("_x.p").alias("_p"))
    tried = words.join(firsts, "_first").select("_key", "_i", "_p", F.explode("_ns").alias("_n"))
    tried = tried.select("_key", "_i", "_n", low(F.array_join(F.slice("_p", F.lit(1), F.col("_n")), "")).alias("_phrase"))
    hits = tried.join(known.select("_phrase", "_n", "_to"), ["_phrase", "_n"]).select("_key", "_i", "_n", "_to").distinct()
    # a text's hits in order, longest first; one that begins inside the one before goes
    ordered = F.sort_array(F.collect_list(F.struct(F.col("_i").alias("i"), (-F.col("_n")).alias("m"), F.col("_n").alias("n"), F.col("_to").alias("to"))))
    start = F.struct(F.lit(0).alias("at"), F.array().cast("array<struct<i:int,n:int,to:string>>").alias("all"))
    take = lambda a, h: F.when(h["i"] >= a["at"], F.struct((h["i"] + h["n"]).alias("at"), F.array_append(a["all"], F.struct(h["i"].alias("i"), h["n"].alias("n"), h["to"].alias("to"))).alias("all"))).otherwise(a)
    chosen = hits.groupBy("_key").agg(ordered.alias("_h")).select("_key", F.aggregate("_h", start, take)["all"].alias("_h"))

    def put(p: Column, h: Column) -> Column:
        end = lambda x: x["i"] + x["n"]
        between = lambda a, b: F.array_join(F.slice(p, a + 1, b - a), "")
        shown = lambda x: cased(between(x["i"], end(x)), x["to"]) if keep_case else x["to"]
        each = F.transform(h, lambda x, j: F.concat(between(F.coalesce(end(F.get(h, j - 1)), F.lit(0)), x["i"]), shown(x)))
        return F.concat(F.array_join(each, ""), between(end(F.try_element_at(h, F.lit(-1))), F.size(p)))

    out = keyed.join(chosen, "_key", "left")
    new = let(F.struct(parts_of(F.col(text)).alias("p"), F.col("_h").alias("h")), lambda x: put(x["p"], x["h"]))
    return out.withColumn(text, F.when(F.col("_h").isNull(), F.col(text)).otherwise(new)).select(*docs.columns)


def _put_few(text: Column, to: dict[str, str], match_case: bool, keep_case: bool) -> Column:
    """The text with phrases replaced by a pattern that tries the longest first; letters are A-Z where their case is not
    looked at."""
    word = "[A-Za-z0-9_]"
    found = f"(?<!{word})(?:{'|'.join(map(re.escape, sorted(to, key=len, reverse=True)))})(?!{word})"
    case = "" if match_case else "(?i)"
    table = F.create_map(*[F.lit(x) for pair in to.items() for x in pair])

    def put(hit: Column) -> Column:
        new = F.element_at(table, hit if match_case else F.lower(hit))
        return cased(hit, new) if keep_case else new

    hits, between = F.regexp_extract_all(text, F.lit(f"{case}({found})"), 1), F.split(text, case + found, -1)
    return F.array_join(F.zip_with(between, hits, lambda a, h: F.when(h.isNull(), a).otherwise(F.concat(a, put(h)))), "")
