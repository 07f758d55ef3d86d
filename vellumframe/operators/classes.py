"""Document classes by weighted terms, tags and file names drawn from texts."""

from __future__ import annotations

import json
import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, StructType

from ..functions.constants import TAG_STOP_WORDS, B, E
from ..functions.text import let, rounded
from .sensitive import safe_pattern

Rules = dict[str, list[tuple[str, int]]]

# Terms and weights of the generic classes, in order of preference.
GENERIC: Rules = {
    "Receipt": [("receipt", 30), ("cash receipt", 35), ("tax receipt", 35), ("subtotal", 20), ("tendered", 25), ("change due", 25), ("pos terminal", 25), ("cashier", 20), ("store #", 20), ("items purchased", 20), ("card txn", 20), ("register #", 20), ("merchant copy", 25), ("customer copy", 20), ("payment method", 15)],
    "Invoice": [("invoice", 30), ("tax invoice", 35), ("bill to", 25), ("billed to", 25), ("invoice date", 25), ("invoice no", 25), ("inv #", 25), ("due date", 20), ("po #", 20), ("purchase order", 25), ("gstin", 20), ("vat #", 20), ("terms: net", 25), ("amount due", 20), ("balance due", 20), ("remit to", 20), ("payment terms", 20), ("medical bill", 35), ("hospital bill", 35), ("patient name", 25), ("consultation fee", 25), ("pharmacy bill", 25)],
    "Utility Bill": [("utility bill", 35), ("electricity bill", 35), ("water bill", 35), ("gas bill", 35), ("telecom bill", 35), ("broadband bill", 35), ("meter reading", 30), ("units consumed", 30), ("kwh", 25), ("consumer number", 25), ("consumer id", 25), ("tariff", 20), ("billing cycle", 25), ("power distribution", 25), ("disconnection date", 25), ("previous reading", 20), ("current reading", 20)],
    "ID Document": [("identity card", 35), ("identification", 30), ("id card", 35), ("national id", 35), ("date of birth", 30), ("dob", 25), ("gender", 20), ("valid until", 25), ("expiry date", 25), ("nationality", 25), ("card number", 25), ("holder name", 25), ("blood group", 25), ("id number", 25), ("place of birth", 20)],
    "Certificate": [("certificate", 30), ("this is to certify", 35), ("certifies that", 35), ("awarded to", 35), ("completion", 20), ("achievement", 25), ("authorized signatory", 25), ("in witness whereof", 20), ("conferred upon", 35), ("diploma", 30), ("degree", 25), ("university degree", 35), ("bachelor of", 30), ("master of", 30), ("doctor of", 30), ("academic year", 25), ("certificate of merit", 35), ("in recognition of", 25)],
    "Official Letter": [("to whom it may concern", 35), ("dear sir", 25), ("dear madam", 25), ("formal request", 25), ("memorandum", 25), ("office memo", 30), ("yours faithfully", 30), ("letter of intent", 30), ("with reference to", 20), ("kindly request", 20), ("formal notice", 25), ("subject:", 15)],
    "Financial Statement": [("financial statement", 35), ("bank statement", 35), ("balance sheet", 35), ("income statement", 35), ("profit and loss", 35), ("cash flow", 30), ("opening balance", 30), ("closing balance", 30), ("credit", 15), ("debit", 15), ("ledger", 25), ("account statement", 35), ("transaction history", 30), ("assets and liabilities", 30)],
    "Notes": [("meeting notes", 35), ("minutes of meeting", 35), ("action items", 30), ("summary notes", 30), ("lecture notes", 35), ("brainstorming", 25), ("key takeaways", 30), ("memo notes", 30), ("discussion points", 25), ("attendees:", 25), ("notes:", 20)],
    "Contract": [("agreement", 25), ("contract", 25), ("terms and conditions", 25), ("memorandum of understanding", 35), ("non-disclosure agreement", 35), ("between the parties", 30), ("party of the first part", 35), ("party of the second part", 35), ("whereas", 25), ("covenant", 25), ("hereby agree", 30), ("governing law", 30), ("indemnification", 25), ("severability", 25), ("employment contract", 35), ("employment agreement", 35), ("employer", 25), ("employee", 25), ("remuneration", 25), ("job title", 20)],
}

# Terms of the five simple classes, 20 points each.
SIMPLE_TERMS = {
    "RECEIPT": ["receipt", "cash receipt", "tax receipt", "pos terminal", "cashier", "store #", "item total", "subtotal", "tendered", "change due", "thank you", "card txn", "register #"],
    "INVOICE": ["invoice", "invoice no", "inv #", "bill to", "billed to", "invoice date", "due date", "po number", "purchase order", "tax invoice", "gstin", "gst #", "vat no", "terms: net", "payment due"],
    "UTILITY_BILL": ["utility bill", "electricity bill", "water bill", "meter reading", "units consumed", "consumer number", "consumer id", "tariff", "billing cycle", "telecom bill", "broadband bill", "gas bill", "kwh", "bill date", "due date", "disconnection"],
    "ID_DOCUMENT": ["identity card", "identification", "id card", "date of birth", "dob", "gender", "valid until", "expiry date", "nationality", "card number", "holder name", "id number", "blood group", "issued on"],
    "BANK_STATEMENT": ["bank statement", "account statement", "account number", "account holder", "opening balance", "closing balance", "deposit", "withdrawal", "statement period", "transaction date", "cheque", "branch code", "ifsc", "swift", "iban", "ledger"],
}
SIMPLE: Rules = {c: [(t, 20) for t in terms] for c, terms in SIMPLE_TERMS.items()}

# Classes that gain points where their first terms count: (class, one page or several, points).
STRUCTURE = [("Receipt", "one", 15), ("ID Document", "one", 15), ("Contract", "several", 15)]
HINT_WEIGHT = 0.8

# Words that name a subject, and the tag each gives, looked for in this order.
SUBJECTS = {
    "electricity": "Electricity", "water": "Water", "gas": "Gas", "broadband": "Broadband", "telecom": "Telecom", "paid": "Paid", "unpaid": "Unpaid", "due": "Due", "pending": "Pending", "overdue": "Overdue",
    "confidential": "Confidential", "agreement": "Agreement", "tax": "Tax", "gst": "GST", "vat": "VAT", "audit": "Audit", "medical": "Medical", "travel": "Travel", "ticket": "Ticket", "flight": "Flight",
    "academic": "Academic", "salary": "Salary", "payroll": "Payroll", "subscription": "Subscription", "retail": "Retail", "hardware": "Hardware", "groceries": "Groceries", "meeting": "Meeting", "minutes": "Minutes",
    "statement": "Statement", "certificate": "Certificate", "identity": "Identity", "national": "National", "employment": "Employment", "contract": "Contract", "hospital": "Hospital", "patient": "Patient", "university": "University", "degree": "Degree",
}

# Words that speak for a calendar event or for a contact, 10 points each.
EVENT_WORDS = ["meeting", "webinar", "conference", "schedule", "am -", "pm -", "zoom", "google meet", "teams.microsoft", "agenda", "dtstart", "session", "workshop", "invitation", "venue:", "time:"]
CONTACT_WORDS = ["director", "manager", "founder", "ceo", "consultant", "advocate", "engineer", "mob:", "cell:", "tel:", "pvt ltd", "corp", "associate", "ph:", "designation:", "office:"]


def check_rules(rules: Rules) -> Rules:
    """Rules with named classes and terms that are lower-case, not blank and weigh something; ValueError otherwise."""
    for name, terms in rules.items():
        if not name.strip():
            raise ValueError("a class needs a name")
        for term, weight in terms:
            if not term.strip() or term != term.lower() or weight <= 0:
                raise ValueError(f"{name}: {term!r} must be lower-case text with a weight over 0")
    return rules


def term_table(classes: list[list[dict]], schema: str = "term string, weight bigint") -> Column:
    """Rules of each class as one constant: an array of arrays of structs. Whatever the number of rules, the plan holds one
    literal, so that generated code does not grow with them."""
    return F.from_json(F.lit(json.dumps(classes, ensure_ascii=False)), ArrayType(ArrayType(StructType.fromDDL(schema))))


def class_points(text: Column, classes: Column, hit=lambda t, r: F.contains(t, r["term"])) -> Column:
    """Points of each class of a term_table, in its order: the weights of its rules that hold.

    The text travels in the fold's state, so that it is made once a row and not once a rule.
    """
    points = lambda t, terms: F.aggregate(F.filter(terms, lambda r: hit(t, r)), F.lit(0).cast("bigint"), lambda p, r: p + r["weight"])
    start = F.struct(text.alias("t"), F.array().cast("array<bigint>").alias("all"))
    return F.aggregate(classes, start, lambda acc, terms: F.struct(acc["t"].alias("t"), F.array_append(acc["all"], points(acc["t"], terms)).alias("all")))["all"]


def rules_table(rules: Rules) -> Column:
    return term_table([[{"term": t, "weight": w} for t, w in terms] for terms in check_rules(rules).values()])


def winner(points: Column, names: list[str], least: float, fallback: str) -> Column:
    """The first class with the most points, the fallback below `least` of them."""
    named = lambda p, top: F.when(top < least, fallback).otherwise(F.element_at(F.array(*map(F.lit, names)), F.array_position(p, top).cast("int")))
    return let(points, lambda p: named(p, F.array_max(p)))


def classify_generic(docs: DataFrame, text: str = "text", pages: str | None = None, hint: str | None = None, rules: Rules | None = None) -> DataFrame:
    """Adds category, points, confidence and secondary (other classes of 20 points or more, surest first).

    `pages` names a column with the page count, 1 without one; `hint` one with file name and title, whose terms weigh
    0.8. Below 20 points the class is Other with confidence 15.
    """
    rules = rules or GENERIC
    names, terms = list(rules), rules_table(rules)
    low = lambda c: F.lower(F.coalesce(F.col(c), F.lit("")))
    df = docs.withColumn("_own", class_points(low(text), terms)).withColumn("_n", F.coalesce(F.col(pages), F.lit(1)) if pages else F.lit(1))
    df = df.withColumn("_hint", class_points(low(hint), terms) if hint else F.array_repeat(F.lit(0).cast("bigint"), len(names)))
    bonus = [next(((which, p) for k, which, p in STRUCTURE if k == c), ("one", 0)) for c in names]
    extra = F.from_json(F.lit(json.dumps([{"several": w == "several", "points": p} for w, p in bonus])), "array<struct<several: boolean, points: bigint>>")
    gained = lambda own, i: F.when((own > 0) & (F.get(extra, i)["several"] == (F.col("_n") > 1)) & ((F.col("_n") > 1) | (F.col("_n") == 1)), F.get(extra, i)["points"]).otherwise(0)
    df = df.withColumn("_points", F.transform("_own", lambda own, i: F.round(own + gained(own, i) + F.get("_hint", i) * HINT_WEIGHT, 6)))
    df = df.withColumn("points", F.array_max("_points")).withColumn("category", winner(F.col("_points"), names, 20, "Other"))
    sure = lambda x, base, most: F.least(F.lit(most), rounded(base + x / 130 * 44)).cast("long")
    df = df.withColumn("confidence", F.when(F.col("category") == "Other", 15).otherwise(sure(F.col("points"), 55, 99)).cast("long"))
    others = F.transform("_points", lambda p, k: F.struct((-sure(p, 45, 95)).alias("o"), k.alias("k"), F.get(F.array(*map(F.lit, names)), k).alias("category"), p.alias("p")))
    others = F.filter(others, lambda x: (x["p"] >= 20) & (x["category"] != F.col("category")))
    return df.withColumn("secondary", F.transform(F.sort_array(others), lambda x: F.struct(x["category"].alias("category"), (-x["o"]).alias("confidence")))).drop("_own", "_n", "_hint", "_points")


def classify_simple(docs: DataFrame, text: str = "text", rules: Rules | None = None) -> DataFrame:
    """Adds category, points and confidence: 0 for blank texts, 30 below 15 points, else 40 and the points, 50 to 98."""
    rules = rules or SIMPLE
    df = docs.withColumn("_points", class_points(F.lower(F.coalesce(F.col(text), F.lit(""))), rules_table(rules)))
    df = df.withColumn("points", F.array_max("_points")).withColumn("category", winner(F.col("_points"), list(rules), 15, "UNKNOWN"))
    blank = F.trim(F.coalesce(F.col(text), F.lit(""))) == ""
    sure = F.when(blank, 0).when(F.col("points") < 15, 30).otherwise(F.least(F.lit(98), F.greatest(F.lit(50), 40 + F.col("points"))))
    return df.withColumn("confidence", sure.cast("long")).drop("_points")


def rule_pack(rules: DataFrame, most: int = 10_000, most_regex: int = 200) -> list[dict]:
    """(category, kind, pattern, weight, rank) as checked rules by rank; ValueError for more than `most` of them or
    `most_regex` regular expressions, unknown kinds, blank patterns, weights of 0 or less, and regular expressions that may
    backtrack without end.

    Kinds: term (anywhere in the text), marker (whole words) and regex; none minds the case of A-Z.
    """
    rows = [r.asDict() for r in rules.select("category", "kind", "pattern", "weight", "rank").orderBy("rank").limit(most + 1).collect()]
    if len(rows) > most or sum(r["kind"] == "regex" for r in rows) > most_regex:
        raise ValueError(f"a pack has at most {most} rules, {most_regex} of them regular expressions")
    for r in rows:
        if r["kind"] not in ("term", "marker", "regex") or not (r["category"] or "").strip() or not (r["pattern"] or "").strip() or not (r["weight"] or 0) > 0:
            raise ValueError(f"not a rule: {r}")
        if r["kind"] == "regex":
            safe_pattern(r["pattern"])
    return rows


#: A-Z in small letters and nothing else changed.
_CAPITALS, _SMALL = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def apply_rules(docs: DataFrame, rules: list[dict], least: int, fallback: str, text: str = "text") -> DataFrame:
    """Adds score and category: weights of the rules that hold, summed by category, the largest (ties: the category whose
    first rule comes first), the fallback below `least`.

    Terms and markers are one constant of the plan and looked for by one fold over the text; a marker's edges are
    looked at only where its letters are there. Only regular expressions are expressions of their own.
    """
    t = F.coalesce(F.col(text), F.lit(""))
    names = list(dict.fromkeys(r["category"] for r in rules))
    low = str.maketrans(_CAPITALS, _SMALL)
    plain = [[{"term": r["pattern"].translate(low), "edged": f"{B}{re.escape(r['pattern'].translate(low))}{E}" if r["kind"] == "marker" else None, "weight": int(r["weight"])} for r in rules if r["category"] == c and r["kind"] != "regex"] for c in names]
    hit = lambda t, r: F.contains(t, r["term"]) & (r["edged"].isNull() | F.rlike(t, r["edged"]))
    points = class_points(F.translate(t, _CAPITALS, _SMALL), term_table(plain, "term string, edged string, weight bigint"), hit)
    patterns = [[r for r in rules if r["category"] == c and r["kind"] == "regex"] for c in names]
    if any(patterns):
        more = F.array(*[sum((t.rlike(f"(?i)(?:{r['pattern']})").cast("bigint") * int(r["weight"]) for r in own), F.lit(0).cast("bigint")) for own in patterns])
        points = F.zip_with(points, more, lambda a, b: a + b)
    df = docs.withColumn("_points", points if names else F.array(F.lit(0).cast("bigint")))
    return df.withColumn("score", F.array_max("_points")).withColumn("category", winner(F.col("_points"), names or [fallback], least, fallback)).drop("_points")


def contact_or_event(text: Column) -> Column:
    """event where its words have strictly more points than a contact's."""
    words = rules_table({"event": [(w, 10) for w in EVENT_WORDS], "contact": [(w, 10) for w in CONTACT_WORDS]})
    points = class_points(F.lower(F.coalesce(text, F.lit(""))), words)
    return F.when(F.aggregate(points, F.lit(0).cast("bigint"), lambda acc, p: p - acc) < 0, "event").otherwise("contact")


# Months as tags know them, in the order of the year.
TAG_MONTHS = "Jan(?:uary)?|Feb(?:ruary)?|Mar(?:ch)?|Apr(?:il)?|May|Jun(?:e)?|Jul(?:y)?|Aug(?:ust)?|Sep(?:tember)?|Oct(?:ober)?|Nov(?:ember)?|Dec(?:ember)?"
ISO = rf"{B}(20\d\d[-/.](?:0[1-9]|1[0-2])[-/.](?:0[1-9]|[12]\d|3[01])){E}"


def date_tag(text: Column) -> Column:
    """The first month with a year, or else the first year-month-day date; null without one."""
    month = F.regexp_extract(text, rf"(?i){B}({TAG_MONTHS})\s+(20\d\d){E}", 1), F.regexp_extract(text, rf"(?i){B}({TAG_MONTHS})\s+(20\d\d){E}", 2)
    iso = F.regexp_extract(text, ISO, 1)
    return F.when(month[1] != "", F.concat_ws(" ", *month)).when(iso != "", F.translate(iso, "./", "--"))


def iso_date_of(text: Column, created: Column | None = None) -> Column:
    """The date a document states: year-month-day, day-month-year, day month year, month and year; else `created`, else
    null."""
    g = lambda p, k: F.regexp_extract(text, p, k)
    dmy = rf"{B}(0[1-9]|[12]\d|3[01])[-/.](0[1-9]|1[0-2])[-/.](20\d\d){E}"
    named, month = rf"{B}(\d{{1,2}})[\s-]+([A-Za-z]{{3,9}})[\s-]+(20\d\d){E}", rf"{B}([A-Za-z]{{3,9}})\s+(20\d\d){E}"
    at = lambda name: F.instr(F.lit("janfebmaraprmayjunjulaugsepoctnovdec"), F.lower(F.substring(name, 1, 3)))
    number = lambda name: F.when((F.length(name) > 0) & (at(name) % 3 == 1), F.lpad(((at(name) + 2) / 3).cast("int").cast("string"), 2, "0"))
    # a pattern is tried once a row
    first = let(g(ISO, 1), lambda d: F.when(d != "", F.translate(d, "./", "--")).otherwise(let(g(dmy, 0), lambda d: F.when(d != "", F.concat_ws("-", F.substring(d, 7, 4), F.substring(d, 4, 2), F.substring(d, 1, 2))))))
    third = let(g(named, 2), lambda m: let(number(m), lambda n: F.when(n.isNotNull(), F.concat_ws("-", g(named, 3), n, F.lpad(g(named, 1), 2, "0")))))
    fourth = let(g(month, 1), lambda m: let(number(m), lambda n: F.when(n.isNotNull(), F.concat_ws("-", g(month, 2), n))))
    return F.coalesce(first, third, fourth, *([F.date_format(created, "yyyy-MM-dd")] if created is not None else []))


def tags(docs: DataFrame, text: str = "text", category: str | None = None, most: int = 5) -> DataFrame:
    """Adds tags, three to `most`: up to two subjects, a date, headings among the first ten lines until there are four,
    frequent words of four letters or more, and where these are fewer than three the class, Reviewed and Document."""
    t = F.coalesce(F.col(text), F.lit(""))
    low = F.lower(t)
    found = F.filter(F.array(*[F.when(F.contains(low, F.lit(k)), F.lit(v)) for k, v in SUBJECTS.items()]), lambda x: x.isNotNull())
    # a capital is one letter: Java spells that of ß, and of ligatures, with two
    one = lambda c: F.when(c == "ß", "ẞ").when(F.length(F.upper(c)) == 1, F.upper(c)).otherwise(c)
    capital = lambda w: F.concat(one(F.substring(w, 1, 1)), F.lower(F.substr(w, F.lit(2))))
    useful = lambda w: (F.length(F.trim(w)) >= 3) & ~F.lower(F.trim(w)).isin(TAG_STOP_WORDS) & ~w.rlike(r"^\d+$")
    lines = F.slice(F.filter(F.transform(F.split(t, "\n"), lambda x: F.trim(x)), lambda x: x != ""), 1, 10)
    fit = F.filter(lines, lambda l: F.length(l).between(4, 35) & ~F.contains(l, F.lit("http")) & ~F.contains(l, F.lit("@")))
    phrases = F.transform(fit, lambda l: F.filter(F.split(l, r"\s+"), useful))
    phrases = F.transform(F.filter(phrases, lambda w: F.size(w).between(1, 3)), lambda w: F.array_join(F.transform(w, capital), " "))
    phrases = F.filter(phrases, lambda p: (F.length(p) > 3) & ~F.lower(p).isin(TAG_STOP_WORDS))
    df = docs.withColumn("_first", F.array_distinct(F.array_compact(F.concat(F.slice(found, 1, 2), F.array(date_tag(t))))))
    df = df.withColumn("_head", F.slice(F.array_distinct(F.concat("_first", phrases)), 1, 4))
    words = F.transform(F.filter(F.regexp_extract_all(t, F.lit(r"([A-Za-z\x{0900}-\x{097F}\x{0980}-\x{09FF}\x{0A00}-\x{0A7F}]{3,})"), 1), useful), capital)
    # words in order with their places: each run of equal words is a count and a first place, for texts of any length
    def runs(w: Column) -> Column:
        begins = F.filter(F.transform(w, lambda x, k: F.when((k == 0) | (x["w"] != F.get(w, k - 1)["w"]), k)), lambda k: k.isNotNull())
        return let(begins, lambda b: F.transform(b, lambda k, j: F.struct((k - F.coalesce(F.get(b, j + 1), F.size(w))).alias("n"), F.get(w, k)["i"].alias("i"), F.get(w, k)["w"].alias("w"))))

    counted = let(F.sort_array(F.transform(words, lambda w, i: F.struct(w.alias("w"), i.alias("i")))), runs)
    ranked = F.transform(F.sort_array(F.filter(counted, lambda x: F.length(x["w"]) >= 4)), lambda x: x["w"])
    df = df.withColumn("_all", F.slice(F.array_distinct(F.concat("_head", ranked)), 1, most))
    own = F.regexp_replace(F.col(category), r"\s+", "") if category else F.lit(None).cast("string")
    spare = F.array_compact(F.array(F.when(own != "Other", own), F.lit("Reviewed"), F.lit("Document")))
    return df.withColumn("tags", F.when(F.size("_all") < 3, F.slice(F.array_distinct(F.concat("_all", spare)), 1, 3)).otherwise(F.col("_all"))).drop("_first", "_head", "_all")


def pdf_name(name: Column, most: int = 60) -> Column:
    """A file name of letters, digits, underscores and hyphens with .pdf behind it; Document.pdf where nothing is left."""
    base = F.regexp_replace(F.regexp_replace(F.regexp_replace(F.coalesce(name, F.lit("")), r"\x00|\.\.+", ""), r"\.[^/.]+$", ""), r"[^A-Za-z0-9_-]", "_")
    base = F.regexp_replace(F.regexp_replace(F.regexp_replace(base, "_+", "_"), "-+", "-"), r"^[_.-]+|[_.-]+$", "")
    short = let(base, lambda b: F.when(F.length(b) > most, F.regexp_replace(F.substring(b, 1, most), r"[_.-]+$", "")).otherwise(b))
    return F.concat(let(short, lambda b: F.when(b == "", "Document").otherwise(b)), F.lit(".pdf"))


def rename_proposal(category: Column, entity: Column, date: Column) -> Column:
    """{Category}_{Entity}_{Date}.pdf, without the date where there is none; Other is called Document."""
    kind = F.regexp_replace(F.when(category == "Other", "Document").otherwise(category), r"\s+", "")
    return pdf_name(F.concat(kind, F.lit("_"), F.coalesce(entity, F.lit("")), F.coalesce(F.concat(F.lit("_"), date), F.lit("")), F.lit(".pdf")))


# Words before the name of what a document is about, in order of trial.
ENTITY_PATTERNS = [
    r"(?i)(?:Vendor|Merchant|Company|Store|Billed From|From|Provider|Employer|Organization|Institution|University|College|Hospital|Clinic)\s*[:\-]\s*([A-Za-z0-9&'.\t ]{2,30})",
    r"(?i)(?:Bill To|Billed To|Customer|Client|Issued To|Certifies That|Awarded To|Dear|Patient Name|Patient|Employee)\s*[:\-]?\s*([A-Za-z0-9&'.\t ]{2,30})",
    r"(?i)(?:Power Distribution|Electricity|Water Board|Telecom|Bank|Hospital|University|Logistics)\s*([A-Za-z0-9&'.\t ]{0,25})",
]


def entity_of(text: Column, title: Column | None = None, name: Column | None = None) -> Column:
    """What a document is about: a name behind a word that announces one, else its title, else its first word that says
    something, else its file name; underscores for white space."""
    whole = lambda v: F.substring(F.regexp_replace(F.regexp_replace(F.regexp_replace(F.trim(v), r"\.\.+", ""), r"\s+", "_"), r"^[_.\-]+|[_.\-]+$", ""), 1, 25)
    found = [let(whole(F.regexp_extract(text, p, 1)), lambda v: F.when(F.length(v) >= 2, v)) for p in ENTITY_PATTERNS]
    useful = F.filter(F.split(F.coalesce(text, F.lit("")), r"\s+"), lambda w: (F.length(w) >= 3) & ~F.lower(w).isin(TAG_STOP_WORDS) & ~w.rlike(r"^\d+$"))
    rest: list[Column] = []
    if title is not None:
        rest.append(F.when(F.length(title) >= 3, F.substring(F.regexp_replace(F.trim(title), r'[\\/:*?"<>|\s]', "_"), 1, 25)))
    rest.append(F.substring(F.try_element_at(useful, F.lit(1)), 1, 20))
    if name is not None:
        base = F.substring(F.regexp_replace(F.regexp_replace(F.regexp_replace(name, r"\.[^/.]+$", ""), "[^A-Za-z0-9]", "_"), "_+", "_"), 1, 20)
        rest.append(F.when(F.length(base) >= 2, base))
    return F.coalesce(*found, *rest, F.lit("Document"))
