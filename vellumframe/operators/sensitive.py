"""Personal data in texts: scan, redact, verify, and privacy scores; unsafe URLs and HTML."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as T
from ..functions.constants import B, E

# Patterns of the presets.
PRESETS = {
    "email": rf"{B}[a-zA-Z0-9._%+-]+@[a-zA-Z0-9.-]+\.[a-zA-Z]{{2,}}{E}",
    "phone": rf"(?:\+91[\-\s]?)?[6-9]\d{{4}}[\-\s]?\d{{5}}{E}|(?:\+91[\-\s]?)?[6-9]\d{{9}}{E}|(?:\+?1[\-\s]?)?\(?\d{{3}}\)?[\-\s]?\d{{3}}[\-\s]?\d{{4}}{E}",
    "credit_card": rf"{B}(?:\d{{4}}[-\s]?){{3}}\d{{4}}{E}|{B}\d{{13,19}}{E}",
    "national_id": rf"{B}[2-9]\d{{3}}[\s\-]?[0-9]{{4}}[\s\-]?[0-9]{{4}}{E}",
    "tax_id": rf"{B}[A-Z]{{5}}[0-9]{{4}}[A-Z]{E}",
    "date": rf"(?i){B}\d{{1,2}}[/\-\.]\d{{1,2}}[/\-\.]\d{{2,4}}{E}|{B}\d{{4}}[-\/]\d{{2}}[-\/]\d{{2}}{E}|{B}(?:Jan|Feb|Mar|Apr|May|Jun|Jul|Aug|Sep|Oct|Nov|Dec)[a-z]*\s+\d{{1,2}},?\s+\d{{4}}{E}",
}

# what every match of a preset holds: simple patterns, so that a text without one is not searched at each of its places
HOLDS = {
    "email": "@", "phone": r"\d[\d)\-\s]{8,11}\d", "credit_card": r"\d[\d\-\s]{11,17}\d", "national_id": r"\d[\d\-\s]{10,12}\d", "tax_id": r"[A-Z]{5}[0-9]{4}[A-Z]",
    "date": r"\d(?:[/\-.]\d|,?\s+\d{4})",
}


def valid(kind: str, match: Column) -> Column:
    digits = F.regexp_replace(match, r"\D", "")
    if kind == "phone":
        return F.length(digits).between(10, 15)
    if kind == "credit_card":
        return T.luhn_valid(match)
    if kind == "national_id":
        return digits.rlike(r"^[2-9]\d{11}$")
    return F.lit(True)


def safe_pattern(pattern: str, most: int = 1000) -> str:
    """The guard of redactions and rule packs: reject patterns that are blank, longer than `most` or may backtrack without
    end: repeated groups that hold a repetition or an alternation, and two `.*`. The guard of dictionaries is another,
    dictionary_pattern_ok."""
    nested = r"\([^)]*(?:[+*]|\{[0-9]+,[0-9]*\})[^)]*\)\s*[+*{]"
    if not pattern.strip() or len(pattern) > most or re.search(nested, pattern) or re.search(r"\([^)]*\|[^)]*\)\s*[+*{]", pattern) or pattern.count(".*") > 1:
        raise ValueError(f"pattern may backtrack without end: {pattern!r}")
    re.compile(pattern)
    return pattern


def pii_scan(docs: DataFrame, kinds: list[str] | None = None, custom: dict[str, str] | None = None, text: str = "text") -> DataFrame:
    """One row a valid match: doc_id, kind, match_no (from 1, per kind, before validation), match, masked, before, after."""
    patterns = {k: PRESETS[k] for k in kinds or PRESETS} | {k: safe_pattern(p) for k, p in (custom or {}).items()}
    df = docs.select("doc_id", F.col(text).alias("_t"))
    none = F.array().cast("array<string>")
    for k, (kind, p) in enumerate(patterns.items()):
        hits = F.regexp_extract_all("_t", F.lit(f"({p})" if not p.startswith("(?i)") else f"(?i)({p[4:]})"), 1)
        if kind in HOLDS and kind not in (custom or {}):
            hits = F.when(F.col("_t").rlike(HOLDS[kind]), hits).otherwise(none)
        df = df.withColumn(f"_m{k}", hits)
    # texts are cut only at kinds that they hold
    df = df.withColumns({f"_s{k}": F.when(F.size(f"_m{k}") > 0, F.split("_t", p, -1)).otherwise(none) for k, p in enumerate(patterns.values())})
    # one fold carries the place along, so a text's hits cost its length once
    start = F.struct(F.lit(0).alias("at"), F.array().cast("array<struct<match_no:bigint,match:string,at:int>>").alias("all"))

    def matches(k: int, kind: str) -> Column:
        def one(acc: Column, x: Column) -> Column:
            place = acc["at"] + F.length(x["s"])
            hit = F.struct((F.size(acc["all"]) + 1).cast("long").alias("match_no"), x["m"].alias("match"), place.alias("at"))
            return F.struct((place + F.length(x["m"])).alias("at"), F.array_append(acc["all"], hit).alias("all"))

        zipped = F.arrays_zip(F.slice(f"_s{k}", F.lit(1), F.size(f"_m{k}")).alias("s"), F.col(f"_m{k}").alias("m"))
        return F.transform(F.aggregate(zipped, start, one)["all"], lambda h: F.struct(F.lit(kind).alias("kind"), h["match_no"].alias("match_no"), h["match"].alias("match"), h["at"].alias("at")))

    found = F.flatten(F.array(*[matches(k, kind) for k, kind in enumerate(patterns)]))
    # outer: the filter that Spark adds to a plain explode would search the texts once more
    df = df.select("doc_id", "_t", F.explode_outer(found).alias("f")).filter("f is not null").select("doc_id", "_t", "f.*")
    ok = F.lit(True)
    for kind in patterns:
        ok = F.when(F.col("kind") == kind, valid(kind, F.col("match"))).otherwise(ok)
    return df.filter(ok).select(
        "doc_id", "kind", "match_no", "match", T.mask_sensitive(F.col("match")).alias("masked"), F.trim(F.substring(F.col("_t"), F.greatest(F.lit(1), F.col("at") - 19), F.least(F.lit(20), F.col("at")))).alias("before"),
        F.trim(F.substring(F.col("_t"), F.col("at") + F.length("match") + 1, F.lit(20))).alias("after"),
    )


def pii_redact(text: Column, kinds: list[str]) -> Column:
    """Matched text blanked in place, character for character."""
    for k in kinds:
        p = PRESETS[k]
        parts = F.split(text, p, -1)
        hits = F.regexp_extract_all(text, F.lit(f"({p})" if not p.startswith("(?i)") else f"(?i)({p[4:]})"), 1)
        blanks = F.transform(hits, lambda m: F.repeat(F.lit(" "), F.length(m)))
        text = F.array_join(F.flatten(F.zip_with(parts, blanks, lambda a, b: F.array(F.coalesce(a, F.lit("")), F.coalesce(b, F.lit(""))))), "")
    return text


def pii_verify(targets: DataFrame, outputs: DataFrame, metadata: str | None = None) -> DataFrame:
    """Targets (doc_id, target[, reason]) against outputs (doc_id, text[, metadata]): status of each target.

    failed where the text or the metadata still holds the target, white space and case aside; else residual_risk where
    the reason says so, else verified. A document without output cannot hold anything.
    """
    flat = lambda c: F.regexp_replace(F.lower(F.coalesce(c, F.lit(""))), r"\s+", "")
    extra = flat(F.col(metadata)) if metadata else F.lit("")
    j = targets.join(outputs.select("doc_id", flat(F.col("text")).alias("_o"), extra.alias("_x")), "doc_id", "left").withColumn("_f", flat(F.col("target")))
    here = lambda c: F.coalesce((F.col("_f") != "") & F.contains(c, F.col("_f")), F.lit(False))
    j = j.withColumn("in_text", here("_o")).withColumn("in_metadata", here("_x"))
    risky = F.coalesce(F.col("reason") == "residual_risk", F.lit(False)) if "reason" in targets.columns else F.lit(False)
    return j.withColumn("status", F.when(F.col("in_text") | F.col("in_metadata"), "failed").when(risky, "residual_risk").otherwise("verified")).drop("_o", "_x", "_f")


def pii_report(verified: DataFrame) -> DataFrame:
    """Per document of pii_verify: counts by status, leaks in metadata, and all_purged if every target is verified."""
    n = lambda c: F.sum(c.cast("long"))
    s = F.col("status")
    return verified.groupBy("doc_id").agg(n(s == "verified").alias("verified"), n(s == "residual_risk").alias("residual_risk"), n(s == "failed").alias("failed"), n(F.col("in_metadata")).alias("in_metadata"), (n(s != "verified") == 0).alias("all_purged"))


# Points a privacy signal takes off, and the ceiling it sets.
SIGNALS = [("name", 15, 100), ("image_name", 15, 75), ("software", 10, 100), ("device", 15, 100), ("gps", 25, 65), ("hidden", 20, 100), ("attachments", 30, 100), ("script", 30, 55)]


def privacy_score(signals: DataFrame, doc: str = "doc_id") -> DataFrame:
    """(doc, signal, count) -> doc, score, grade: 100 less the points of present signals, under their ceilings.

    Documents without any counted signal score 100 and A+ when they have a row with count 0.
    """
    points, ceiling = F.lit(0), F.lit(100)
    for name, p, c in SIGNALS:
        points, ceiling = F.when(F.col("signal") == name, p).otherwise(points), F.when(F.col("signal") == name, c).otherwise(ceiling)
    s = signals.groupBy(doc, "signal").agg(F.max("count").alias("count")).withColumn("on", F.col("count") > 0)
    s = s.withColumn("p", F.when(F.col("on"), points).otherwise(0)).withColumn("c", F.when(F.col("on"), ceiling).otherwise(100))
    has = lambda n: F.max(F.when((F.col("signal") == n) & F.col("on"), 1).otherwise(0)).alias(f"_{n}")
    g = s.groupBy(doc).agg(F.sum("p").alias("off"), F.min("c").alias("cap"), F.sum(F.col("on").cast("int")).alias("k"), *[has(n) for n in ("gps", "image_name", "name", "script")])
    g = g.withColumn("score", F.least(F.col("cap"), F.greatest(F.lit(0), 100 - F.col("off"))).cast("long"))
    level = F.when((F.col("score") >= 95) & (F.col("k") == 0), 5).when(F.col("score") >= 85, 4).when(F.col("score") >= 70, 3).when(F.col("score") >= 55, 2).when(F.col("score") >= 40, 1).otherwise(0)
    top = F.least(F.when((F.col("_gps") == 1) | (F.col("_script") == 1), 2).otherwise(5), F.when(F.col("_image_name") == 1, 3).otherwise(5), F.when(F.col("_name") == 1, 4).otherwise(5))
    return g.select(doc, "score", F.element_at(F.array(*map(F.lit, ("F", "D", "C", "B", "A", "A+"))), F.least(level, top) + 1).alias("grade"))


# Elements that go; those with text of their own go with it.
WITH_TEXT = "script|noscript|iframe|object|applet|form|button|select|textarea|style|svg"
EMPTY = "frame|embed|meta|link|base|input"


def html_sanitized(html: Column) -> Column:
    """The page without comments, disallowed elements, event handlers, and addresses that are forbidden."""
    out = F.regexp_replace(F.coalesce(html, F.lit("")), r"(?s)<!--.*?-->", " ")
    out = F.regexp_replace(out, rf"(?is)<({WITH_TEXT})\b[^>]*>.*?</\1\s*>", " ")
    out = F.regexp_replace(out, rf"(?i)</?(?:{WITH_TEXT}|{EMPTY})\b[^>]*>", " ")
    out = F.regexp_replace(out, r"(?i)(<[^>]*?)\s+on[a-z]+\s*=\s*(?:\"[^\"]*\"|'[^']*'|[^\s>]+)", "$1")
    address = r"(?i)\s(?:href|src|action)\s*=\s*(?:\"([^\"]*)\"|'([^']*)')"
    found = F.zip_with(F.regexp_extract_all(out, F.lit(address), 0), F.zip_with(F.regexp_extract_all(out, F.lit(address), 1), F.regexp_extract_all(out, F.lit(address), 2), lambda a, b: F.concat(a, b)), lambda whole, url: F.when(forbidden_url(url), F.lit("")).otherwise(whole))
    return F.array_join(F.zip_with(F.split(out, address, -1), found, lambda a, b: F.concat(a, F.coalesce(b, F.lit("")))), "")


def html_text(html: Column) -> Column:
    """Text of a page: disallowed elements, comments and tags go, common entities are decoded."""
    out = F.regexp_replace(html, r"(?s)<!--.*?-->", " ")
    out = F.regexp_replace(out, rf"(?is)<({WITH_TEXT})\b[^>]*>.*?</\1\s*>", " ")
    out = F.regexp_replace(out, r"<[^>]*>", " ")
    for name, sign in (("&nbsp;", " "), ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&amp;", "&")):
        out = F.replace(out, F.lit(name), F.lit(sign))
    return F.trim(F.regexp_replace(out, r"[ \t\n\r\f]+", " "))


def forbidden_url(url: Column) -> Column:
    """Script pseudo-protocols, loopback and metadata hosts, private address ranges."""
    u = F.lower(F.trim(url))
    return u.rlike(r"^(javascript|vbscript|file|ftp):") | u.rlike(r"169\.254\.169\.254|localhost|127\.0\.0\.1|0\.0\.0\.0|\[::1\]|metadata\.google\.internal") | u.rlike(r"(?:^|//)(?:10\.\d{1,3}\.\d{1,3}\.\d{1,3}|192\.168\.\d{1,3}\.\d{1,3}|172\.(?:1[6-9]|2\d|3[0-1])\.\d{1,3}\.\d{1,3})(?::\d+)?(?:/|$)")
