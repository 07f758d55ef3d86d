"""Queries over records and texts derived from orders, parts and customers: extraction, classes, names, audits, diffs."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..operators import classes as C
from ..operators import extraction as X
from ..operators import ordering as O
from ..operators import recipes as Y
from ..operators import records as R
from ..operators import sensitive as P
from ..sources import csv as V
from ..sources.shared import by_document, scratch, spread
from .literals import GENERIC_TERMS, MARKERS_SQL, SIMPLE_CLASSES, SUBJECT_TAGS, TAG_STOPS_SQL
from .registry import documents, query, table

# Contract-like texts made of the orders table, the same in both engines.
PAPERS_SQL = """papers AS (SELECT o_orderkey AS doc_id, 'Services Agreement' || chr(10) || 'Contract No: CT-' || o_orderkey || chr(10) || 'Effective Date: ' || strftime(o_orderdate, '%Y-%m-%d') || chr(10)
  || 'This agreement is entered into between Customer ' || o_custkey || ' Ltd and Acme ' || (o_orderkey % 50) || ' Inc.' || chr(10) || 'Total Amount: $' || CAST(CAST(o_totalprice AS DECIMAL(18, 2)) AS VARCHAR) || chr(10)
  || CASE o_orderkey % 3 WHEN 0 THEN 'The customer shall pay within ' || (o_orderkey % 60 + 1) || ' days of receipt.' WHEN 1 THEN 'A penalty of USD 500.00 applies on breach or default.' ELSE 'The vendor is entitled to terminate no later than 5 March 2024.' END || chr(10)
  || 'Invoice Date: ' || strftime(o_orderdate, '%d/%m/%Y') || chr(10) || 'Due Date: 12/31/2024' || chr(10) || 'Vendor: ' || o_orderpriority || chr(10) || CASE o_orderkey % 4 WHEN 0 THEN 'The tenant may occupy the flat freely.' WHEN 1 THEN 'The customer shall pay at once.' WHEN 2 THEN 'Deposit 0.00 USD and USD 1,200.50' ELSE 'Nothing more' END AS text FROM orders)"""


def papers(spark, sf_dir, dealt=False):
    """`dealt`: by key, for what groups or orders the lines of a text; orders are moved instead of texts and lines."""
    o = table(spark, sf_dir, "orders")
    o = by_document(o.select("o_orderkey", "o_custkey", "o_totalprice", "o_orderdate", "o_orderpriority"), "o_orderkey") if dealt else spread(o, "o_orderkey")
    k, s = F.col("o_orderkey"), lambda c: c.cast("string")
    clause = F.when(k % 3 == 0, F.concat(F.lit("The customer shall pay within "), s(k % 60 + 1), F.lit(" days of receipt."))).when(k % 3 == 1, "A penalty of USD 500.00 applies on breach or default.").otherwise("The vendor is entitled to terminate no later than 5 March 2024.")
    text = F.concat_ws(
        "\n", F.lit("Services Agreement"), F.concat(F.lit("Contract No: CT-"), s(k)), F.concat(F.lit("Effective Date: "), F.date_format("o_orderdate", "yyyy-MM-dd")),
        F.concat(F.lit("This agreement is entered into between Customer "), s(F.col("o_custkey")), F.lit(" Ltd and Acme "), s(k % 50), F.lit(" Inc.")),
        F.concat(F.lit("Total Amount: $"), s(F.col("o_totalprice").cast("decimal(18,2)"))), clause, F.concat(F.lit("Invoice Date: "), F.date_format("o_orderdate", "dd/MM/yyyy")),
        F.lit("Due Date: 12/31/2024"), F.concat(F.lit("Vendor: "), F.col("o_orderpriority")),
        F.when(k % 4 == 0, "The tenant may occupy the flat freely.").when(k % 4 == 1, "The customer shall pay at once.").when(k % 4 == 2, "Deposit 0.00 USD and USD 1,200.50").otherwise("Nothing more"),
    )
    return o.select(k.alias("doc_id"), text.alias("text"))


LINES = PAPERS_SQL + ", lines AS (SELECT doc_id, unnest(l) AS line, CAST(unnest(range(1, len(l) + 1)) AS BIGINT) AS line_no FROM (SELECT doc_id, string_split(text, chr(10)) AS l FROM papers))"


# The SQL states its own patterns: value pattern with its group, what names it (a text, or SQL over the line), SQL of the key.
_LINE = lambda *cases, other: "CASE " + " ".join(f"WHEN {' OR '.join(f'contains(lower(line), {chr(39)}{w}{chr(39)})' for w in ws)} THEN '{name}'" for ws, name in cases) + f" ELSE '{other}' END"
_DATES = _LINE((["effective date", "effective as of"], "Effective Date"), (["execution date", "signed date", "agreement date"], "Execution Date"), (["termination date", "expiration date"], "Expiration Date"), (["due date", "payment due"], "Payment Due Date"), (["commencement date", "start date"], "Commencement Date"), other="Date")
_AMOUNTS = _LINE((["total", "aggregate"], "Total Amount"), (["penalty", "liquidated damages", "fine"], "Penalty Amount"), (["fee", "compensation"], "Fee"), (["deposit", "security"], "Security Deposit"), (["rent"], "Rent"), other="Monetary Amount")
_MONTHS = "(?:Jan(?:uary)?|Feb(?:ruary)?|Mar(?:ch)?|Apr(?:il)?|May|Jun(?:e)?|Jul(?:y)?|Aug(?:ust)?|Sep(?:tember)?|Oct(?:ober)?|Nov(?:ember)?|Dec(?:ember))"
_NUMBER = r"[0-9]{1,3}(?:[,\s][0-9]{2,3})*(?:\.[0-9]{1,2})?|[0-9]+(?:\.[0-9]{1,2})?"
_BETWEEN = r"(?i)(?:by\s+and\s+between|between|entered\s+into\s+between)\s+([A-Z0-9][A-Za-z0-9&.,\s]{1,80}?)\s+and\s+([A-Z0-9][A-Za-z0-9&.,\s]{1,80}?)(?:\s*\(|\.|,|$|\n)"
_ROLE = r"(?i)(Party\s+[AB]|First\s+Party|Second\s+Party|Employer|Employee|Client|Contractor|Customer|Vendor|Licensor|Licensee|Lender|Borrower|Landlord|Tenant|Purchaser|Supplier|Buyer|Seller|Disclosing\s+Party|Receiving\s+Party)\s*[:=-]\s*([A-Za-z0-9&.,\s]{3,50})(?:[;\r\n]|$)"
_COMPANY = r"\b([A-Z][A-Za-z0-9&.,\s]{1,40}\b(?:Inc\.?|LLC|Ltd\.?|Limited|Corp\.?|Corporation|Pvt\.?\s*Ltd\.?|Private\s+Limited|LLP|GmbH|PLC))\b"
ENTITY_SQL = {
    "date": ([(rf"(?i)\b(\d{{1,2}}(?:st|nd|rd|th)?\s+{_MONTHS}[,\s]+\d{{4}})\b", 1, _DATES), (rf"(?i)\b({_MONTHS}\s+\d{{1,2}}(?:st|nd|rd|th)?[,\s]+\d{{4}})\b", 1, _DATES), (r"\b(\d{4}[-/.]\d{1,2}[-/.]\d{1,2})\b", 1, _DATES), (r"\b(\d{1,2}[-/.]\d{1,2}[-/.]\d{2,4})\b", 1, _DATES)], " ", "value <> ''", "lower(value)"),
    "amount": ([(rf"(?i)((?:\$|€|£|₹|Rs\.?|INR|USD|EUR|GBP)\s*(?:{_NUMBER})|(?:{_NUMBER})\s*(?:USD|EUR|GBP|INR|dollars|rupees))", 1, _AMOUNTS)], " ", "TRY_CAST(regexp_extract(replace(value, ',', ''), '([0-9]+(?:\\.[0-9]{1,2})?)', 1) AS DOUBLE) > 0", "regexp_replace(lower(value), '\\s+', '', 'g')"),
    "party": ([(_BETWEEN, 1, "'First Party'"), (_BETWEEN, 2, "'Second Party'"), (_ROLE, 2, 1), (_COMPANY, 1, "'Contracting Entity'")], " \t,;:\"''()", "length(value) >= 3 AND lower(value) NOT IN ('and', 'the', 'this', 'agreement', 'contract', 'between', 'by', 'party')", "lower(value)"),
    "deadline": ([(r"(?i)\b(within\s+(?:\d+|[a-z]+)\s+(?:calendar\s+|business\s+)?(?:days|weeks|months))\b", 1, _D := _LINE((["notice"], "Notice Period"), (["pay"], "Payment Deadline"), other="Deadline")), (r"(?i)\b((?:no\s+later\s+than|on\s+or\s+before|due\s+on)\s+[A-Za-z0-9/-]+(?:\s+[A-Za-z0-9]+){0,2})", 1, _D), (r"(?i)\b(notice\s+period\s+of\s+\d+\s+\w+)\b", 1, _D)], " ", "value <> ''", "lower(value)"),
    "reference": ([(r"(?i)\b(?:Account|Invoice|Contract|Agreement|Policy|Order|Reference|Case)\s*(?:No\.?|Number|#|ID)\s*[:=]?\s*([A-Z0-9][A-Z0-9/-]{2,30})", 1, _R := _LINE((["invoice"], "Invoice Number"), (["contract"], "Contract Number"), other="Reference")), (r"\b([A-Z]{5}[0-9]{4}[A-Z])\b", 1, _R)], " ", "value <> ''", "lower(value)"),
}


def entity_sql(kind: str) -> str:
    patterns, strip, good, key = ENTITY_SQL[kind]
    q = lambda p: p.replace("'", "''")
    found = " UNION ALL ".join(
        f"SELECT doc_id, line_no, line, {k} AS p, unnest(range(1, len(m) + 1)) AS n, trim(unnest(m), '{strip}') AS value, {'trim(unnest(l))' if isinstance(label, int) else 'CAST(NULL AS VARCHAR)'} AS given, {'NULL' if isinstance(label, int) else label} AS named "
        f"FROM (SELECT *, {f'[regexp_extract(line, {chr(39)}{q(p)}{chr(39)}, {g})]' if p == _BETWEEN else f'regexp_extract_all(line, {chr(39)}{q(p)}{chr(39)}, {g})'} AS m{f', regexp_extract_all(line, {chr(39)}{q(p)}{chr(39)}, {label}) AS l' if isinstance(label, int) else ''} FROM lines)"
        for k, (p, g, label) in enumerate(patterns)
    )
    return f"SELECT doc_id, '{kind}' AS kind, coalesce(given, named) AS label, value, line_no FROM (SELECT *, row_number() OVER (PARTITION BY doc_id, {key} ORDER BY line_no, p, n) AS k FROM ({found}) WHERE {good}) WHERE k = 1"


def _entity(e: X.Entity, name: str, more: str = "", extra=None) -> None:
    @query(name, f"WITH {LINES} SELECT *{more} FROM ({entity_sql(e.kind)})")
    def run(spark, sf_dir):
        out = X.extract_texts(papers(spark, sf_dir), e).drop("context")
        return extra(out) if extra else out


_ISO = "CASE WHEN regexp_full_match(value, '\\d{4}-\\d{2}-\\d{2}') THEN value WHEN regexp_full_match(value, '\\d{2}/\\d{2}/\\d{4}') THEN coalesce(strftime(try_strptime(value, '%m/%d/%Y'), '%Y-%m-%d'), value) WHEN regexp_full_match(value, '\\d{1,2} [A-Za-z]+ \\d{4}') THEN coalesce(strftime(try_strptime(value, '%d %B %Y'), '%Y-%m-%d'), value) ELSE value END AS iso"
_entity(X.ENTITIES[0], "extract_dates", ", " + _ISO, lambda d: d.withColumn("iso", X.iso_date(F.col("value"))))
_entity(X.ENTITIES[1], "extract_amounts", ", CAST(regexp_extract(replace(value, ',', ''), '([0-9]+(?:\\.[0-9]{1,2})?)', 1) AS DOUBLE) AS amount", lambda d: d.withColumn("amount", X.amount_value(F.col("value"))))
for _e, _n in zip(X.ENTITIES[2:], ("extract_parties", "extract_deadlines", "extract_references"), strict=True):
    _entity(_e, _n)
ALL_SQL = " UNION ALL ".join(f"({entity_sql(k)})" for k in ENTITY_SQL)


@query("entities_union", f"WITH {LINES} {ALL_SQL}")
def entities_union(spark, sf_dir):
    return X.extract_all(papers(spark, sf_dir)).drop("context")


@query("entity_summary", f"WITH {LINES}, a AS ({ALL_SQL}) SELECT doc_id, " + ", ".join(f"count(*) FILTER (kind = '{k}') AS n_{k}" for k in ENTITY_SQL) + " FROM a GROUP BY doc_id")
def entity_summary(spark, sf_dir):
    return X.extract_all(papers(spark, sf_dir)).groupBy("doc_id").agg(*[F.sum((F.col("kind") == e.kind).cast("long")).alias(f"n_{e.kind}") for e in X.ENTITIES])


_HITS = ", ".join(f"regexp_matches(segment, '(?i){p}')::INT AS m{k}" for k, (p, _) in enumerate(MARKERS_SQL))
_WEIGHTS = {"penalty": 30, "deadline": 25, "right": 20, "obligation": 20}
_BY = ", ".join(f"({' + '.join(f'm{k}' for k, (_, d) in enumerate(MARKERS_SQL) if d == c)}) * {w} AS w_{c}" for c, w in _WEIGHTS.items())
# lines end clauses in these texts at stops and colons alone, and none starts a section
SEGMENTS = rf"""seg AS (SELECT doc_id, line_no, trim(line) AS line, sum(coalesce(shut, 1)) OVER (PARTITION BY doc_id ORDER BY line_no) AS part FROM (SELECT *, lag(regexp_matches(line, '[.;:]$')::INT) OVER (PARTITION BY doc_id ORDER BY line_no) AS shut FROM lines WHERE trim(line) <> '')),
whole AS (SELECT doc_id, part, string_agg(line, ' ' ORDER BY line_no) AS t FROM seg GROUP BY 1, 2), cuts AS (SELECT doc_id, part, list_filter(list_transform(string_split(regexp_replace(t, '([.!?])\s+([A-Z0-9])', '\1' || chr(1) || '\2', 'g'), chr(1)), lambda x: trim(x)), lambda x: length(x) > 10) AS l FROM whole),
flat AS (SELECT doc_id, part, unnest(range(0, len(l))) AS k, regexp_replace(unnest(l), '\s+', ' ', 'g') AS segment FROM cuts), segments AS (SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY part, k) AS segment_no, segment FROM flat)"""


@query("extract_clauses", f"""WITH {LINES}, {SEGMENTS}, h AS (SELECT *, {_HITS} FROM segments WHERE length(segment) >= 15), w AS (SELECT doc_id, segment_no, segment, {' + '.join(f'm{k}' for k in range(len(MARKERS_SQL)))} AS markers, {_BY} FROM h),
f AS (SELECT *, row_number() OVER (PARTITION BY doc_id, lower(segment) ORDER BY segment_no) AS k FROM w WHERE markers > 0)
SELECT doc_id, segment_no, segment, CAST(markers AS BIGINT) AS markers, CASE greatest({', '.join('w_' + c for c in _WEIGHTS)}) {' '.join(f"WHEN w_{c} THEN '{c}'" for c in _WEIGHTS)} END AS category, CAST(least(98, 80 + 5 * markers) AS BIGINT) AS confidence FROM f WHERE k = 1""")
def extract_clauses(spark, sf_dir):
    s = X.contract_segments(X.lines(papers(spark, sf_dir, dealt=True)))
    return X.extract_clauses(s).select("doc_id", "segment_no", "segment", "markers", "category", "confidence")


# All papers are invoices to the simple classifier; the values follow from how the texts are made.
_FIELDS_SQL = f"""{PAPERS_SQL}, p AS (SELECT o_orderkey AS doc_id, strftime(o_orderdate, '%Y-%m-%d') AS d, CAST(CAST(o_totalprice AS DECIMAL(18, 2)) AS VARCHAR) AS total, 'CT-' || o_orderkey AS ct FROM orders),
kv AS (SELECT doc_id, unnest(['date', 'dueDate', 'grandTotal', 'subtotal', 'taxAmount', 'balanceDue', 'invoiceNumber', 'orderNumber', 'vendorName', 'customerName', 'address']) AS key,
  unnest([d, NULL, '$' || CASE WHEN length(total) > 6 THEN total[1:3] ELSE total END, NULL, NULL, NULL, NULL, NULL, 'Services Agreement', NULL, CASE WHEN doc_id BETWEEN 10000 AND 999999 THEN 'Contract No: ' || ct END]) AS value, unnest([95, 0, 95, 0, 0, 0, 0, 0, 82, 0, 84]) AS sure, unnest([3, 0, 5, 0, 0, 0, 0, 0, 1, 0, 2]) AS at_line FROM p),
fields AS (SELECT doc_id, key, value, CAST(CASE WHEN value IS NULL THEN 0 ELSE sure END AS BIGINT) AS confidence, CASE WHEN value IS NOT NULL THEN CAST(at_line AS BIGINT) END AS line_no FROM kv)"""


@query("extract_fields", f"WITH {_FIELDS_SQL} SELECT * FROM fields")
def extract_fields(spark, sf_dir):
    return X.extract_fields(C.classify_simple(spread(papers(spark, sf_dir), "doc_id")))


@query("field_summary", f"WITH {_FIELDS_SQL} SELECT doc_id, count(*) FILTER (confidence > 0) AS detected, count(*) FILTER (confidence >= 80) AS high, count(*) FILTER (confidence > 0 AND confidence < 80) AS low, count(*) FILTER (confidence = 0) AS absent FROM fields GROUP BY doc_id")
def field_summary(spark, sf_dir):
    n = lambda c: F.sum(c.cast("long"))
    c = F.col("confidence")
    return extract_fields(spark, sf_dir).groupBy("doc_id").agg(n(c > 0).alias("detected"), n(c >= 80).alias("high"), n((c > 0) & (c < 80)).alias("low"), n(c == 0).alias("absent"))


@query("json_fields_sink", f"WITH {_FIELDS_SQL} SELECT doc_id, key, value || ' \"q\" \\' AS value FROM fields WHERE value IS NOT NULL")
def json_fields_sink(spark, sf_dir):
    """One JSON object a document, written as files and read again; values hold quotes and backslashes."""
    path = scratch(spark, "json")
    X.json_fields(extract_fields(spark, sf_dir).withColumn("value", F.concat("value", F.lit(' "q" \\'))), path)
    back = spark.read.schema("doc_id long, fields map<string,string>").json(path)
    return back.select("doc_id", F.explode("fields").alias("key", "value"))


_NAMED = {c: f"c{k}" for k, c in enumerate(GENERIC_TERMS)}


def _points(rules, source: str) -> str:
    return ", ".join(f"({' + '.join(f'contains({source}, {chr(39)}{t}{chr(39)})::INT * {w}' for t, w in terms)})" + f" AS {{}}{k}" for k, terms in enumerate(rules.values()))


def _first(names: dict[str, str], least: int, fallback: str) -> str:
    top = f"greatest({', '.join(names.values())})"
    return f"CASE WHEN {top} < {least} THEN '{fallback}' ELSE CASE {top} {' '.join(f'WHEN {c} THEN {chr(39)}{n}{chr(39)}' for n, c in names.items())} END END"


SIMPLE_SQL = f"s AS (SELECT doc_id, text, {_points(SIMPLE_CLASSES, 't').replace('{}', 'c')} FROM (SELECT doc_id, text, lower(text) AS t FROM papers))"
_KINDS = {c: f"c{k}" for k, c in enumerate(SIMPLE_CLASSES)}


@query("classify_simple", f"WITH {PAPERS_SQL}, {SIMPLE_SQL}, b AS (SELECT doc_id, {_first(_KINDS, 15, 'UNKNOWN')} AS category, greatest({', '.join(_KINDS.values())}) AS points FROM s) SELECT doc_id, category, CAST(points AS BIGINT) AS points, CAST(CASE WHEN points < 15 THEN 30 ELSE least(98, greatest(50, 40 + points)) END AS BIGINT) AS confidence FROM b")
def classify_simple(spark, sf_dir):
    return C.classify_simple(papers(spark, sf_dir)).select("doc_id", "category", "points", "confidence")


GENERIC_SQL = f"""raw AS (SELECT doc_id, text, o_orderkey % 2 + 1 AS pages, {_points(GENERIC_TERMS, 't').replace('{}', 'p')}, {_points(GENERIC_TERMS, 'h').replace('{}', 'h')} FROM (SELECT doc_id, text, lower(text) AS t, CASE doc_id % 3 WHEN 0 THEN 'tax invoice ' || doc_id WHEN 1 THEN 'scan' ELSE 'cash receipt' END AS h FROM papers) JOIN orders ON o_orderkey = doc_id),
g AS (SELECT doc_id, text, pages, {', '.join(f"round(p{k} + {'CASE WHEN p' + str(k) + ' > 0 AND pages = 1 THEN 15 ELSE 0 END' if c in ('Receipt', 'ID Document') else 'CASE WHEN p' + str(k) + ' > 0 AND pages > 1 THEN 15 ELSE 0 END' if c == 'Contract' else '0'} + h{k} * 0.8::DOUBLE, 6) AS c{k}" for k, c in enumerate(GENERIC_TERMS))} FROM raw),
generic AS (SELECT *, {_first(_NAMED, 20, 'Other')} AS category, greatest({', '.join(_NAMED.values())}) AS points FROM g)"""


def generic_papers(spark, sf_dir):
    """The papers with page counts and file names."""
    k = F.col("doc_id")
    hint = F.when(k % 3 == 0, F.concat(F.lit("tax invoice "), k.cast("string"))).when(k % 3 == 1, "scan").otherwise("cash receipt")
    return C.classify_generic(papers(spark, sf_dir).withColumn("pages", k % 2 + 1).withColumn("hint", hint), pages="pages", hint="hint")


@query("classify_generic", f"""WITH {PAPERS_SQL}, {GENERIC_SQL} SELECT doc_id, category, points, CAST(CASE WHEN category = 'Other' THEN 15 ELSE least(99, floor(55 + points / 130 * 44 + 0.5)) END AS BIGINT) AS confidence,
  list_transform(list_sort(list_filter([{', '.join(f"{{'o': -CAST(least(95, floor(45 + c{k} / 130 * 44 + 0.5)) AS BIGINT), 'k': {k}, 'n': '{c}', 'p': c{k}}}" for k, c in enumerate(GENERIC_TERMS))}], lambda x: x.p >= 20 AND x.n <> category)), lambda x: x.n || ':' || -x.o) AS others FROM generic""")
def classify_generic(spark, sf_dir):
    others = F.transform("secondary", lambda x: F.concat_ws(":", x["category"], x["confidence"].cast("string")))
    return generic_papers(spark, sf_dir).select("doc_id", "category", "points", "confidence", others.alias("others"))


@query("rule_packs", r"""WITH h AS (SELECT doc_id, lower(text) AS t, text FROM documents), c AS (SELECT doc_id, contains(t, 'tion')::INT * 10 + regexp_matches(text, '(?i)\bof the\b')::INT * 15 AS a, regexp_matches(text, '(?i)\bque\b')::INT * 20 + regexp_matches(text, '(?i)(?:mente(s)?)')::INT * 10 AS b, regexp_matches(text, '(?i)\bund\b')::INT * 25 AS c FROM h)
SELECT doc_id, CAST(greatest(a, b, c) AS BIGINT) AS score, CASE WHEN greatest(a, b, c) < 15 THEN 'none' WHEN a = greatest(a, b, c) THEN 'english' WHEN b = greatest(a, b, c) THEN 'spanish' ELSE 'german' END AS category FROM c""")
def rule_packs(spark, sf_dir):
    """A pack of terms, markers of several words and a regular expression."""
    rules = spark.createDataFrame([("english", "term", "tion", 10, 1), ("english", "marker", "of the", 15, 2), ("spanish", "marker", "que", 20, 3), ("spanish", "regex", "mente(s)?", 10, 4), ("german", "marker", "und", 25, 5)], "category string, kind string, pattern string, weight int, rank int")
    return C.apply_rules(table(spark, sf_dir, "documents"), C.rule_pack(rules), 15, "none").select("doc_id", "score", "category")


@query("rename_proposal", rf"""WITH {PAPERS_SQL}, {GENERIC_SQL}, n AS (SELECT doc_id, CASE WHEN category = 'Other' THEN 'Document' ELSE replace(category, ' ', '') END AS c, regexp_replace(replace(trim(regexp_extract(text, 'Customer ([A-Za-z0-9&. ]{{2,30}})', 1)), ' ', '_'), '[_.]+$', '')[1:25] AS e,
  CASE WHEN year(o_orderdate) >= 2000 THEN '_' || strftime(o_orderdate, '%Y-%m-%d') WHEN doc_id % 3 = 2 THEN '_2024-03-05' ELSE '' END AS d FROM generic JOIN orders ON o_orderkey = doc_id)
SELECT doc_id, regexp_replace(replace(c || '_' || e || d, '.', '_'), '_+', '_', 'g') || '.pdf' AS name FROM n""")
def rename_proposal(spark, sf_dir):
    g = generic_papers(spark, sf_dir)
    return g.select("doc_id", C.rename_proposal(F.col("category"), C.entity_of(F.col("text")), C.iso_date_of(F.col("text"))).alias("name"))


@query("organize_batch", f"""WITH {PAPERS_SQL}, {GENERIC_SQL} SELECT doc_id, CASE WHEN o_orderstatus = 'F' THEN category ELSE NULL END AS folder, CASE WHEN o_orderstatus = 'F' THEN 'applied' ELSE 'skipped' END AS status FROM generic JOIN orders ON o_orderkey = doc_id""")
def organize_batch(spark, sf_dir):
    """Only approved proposals (orders with status F) are applied."""
    ok = table(spark, sf_dir, "orders").filter("o_orderstatus = 'F'").select(F.col("o_orderkey").alias("doc_id"), F.lit(True).alias("ok"))
    c = generic_papers(spark, sf_dir).join(ok, "doc_id", "left")
    return c.select("doc_id", F.when(F.col("ok"), F.col("category")).alias("folder"), F.when(F.col("ok"), "applied").otherwise("skipped").alias("status"))


# Month and year, or a year-month-day date; words and phrases that may be tags.
_MONTH_YEAR = r"(?i)\b(Jan(?:uary)?|Feb(?:ruary)?|Mar(?:ch)?|Apr(?:il)?|May|Jun(?:e)?|Jul(?:y)?|Aug(?:ust)?|Sep(?:tember)?|Oct(?:ober)?|Nov(?:ember)?|Dec(?:ember)?)\s+(20\d\d)\b"
_YMD = r"\b(20\d\d[-/.](?:0[1-9]|1[0-2])[-/.](?:0[1-9]|[12]\d|3[01]))\b"
_USEFUL = "length(trim({w})) >= 3 AND lower(trim({w})) NOT IN " + TAG_STOPS_SQL + r" AND NOT regexp_full_match({w}, '[0-9]+')"
_ONCE = "list_filter({l}, lambda v, k: list_position({l}, v) = k)"
AUTO_TAGS_SQL = rf"""WITH base AS MATERIALIZED (
  SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS t, lower(coalesce(text, '')) AS low FROM documents
), scored AS (
  SELECT r, {_points(GENERIC_TERMS, 't').replace('{}', 'p')} FROM (SELECT r, low AS t FROM base)
), bonus AS (
  SELECT r, {', '.join(f"p{k} + {'CASE WHEN p' + str(k) + ' > 0 THEN 15 ELSE 0 END' if c in ('Receipt', 'ID Document') else '0'} AS c{k}" for k, c in enumerate(GENERIC_TERMS))} FROM scored
), named AS (
  SELECT r, {_first(_NAMED, 20, 'Other')} AS category FROM bonus
), starts AS (
  SELECT r, list_filter([{', '.join(f"CASE WHEN contains(low, '{k}') THEN '{v}' END" for k, v in SUBJECT_TAGS)}], lambda x: x IS NOT NULL)[:2] AS subjects,
    CASE WHEN regexp_matches(t, '{_MONTH_YEAR}') THEN regexp_extract(t, '{_MONTH_YEAR}', 1) || ' ' || regexp_extract(t, '{_MONTH_YEAR}', 2) WHEN regexp_matches(t, '{_YMD}') THEN replace(replace(regexp_extract(t, '{_YMD}', 1), '.', '-'), '/', '-') END AS day,
    list_filter(list_filter(list_transform(string_split(t, chr(10)), lambda x: trim(x)), lambda x: x <> '')[:10], lambda l: length(l) BETWEEN 4 AND 35 AND NOT contains(l, 'http') AND NOT contains(l, '@')) AS fit FROM base
), phrases AS (
  SELECT r, subjects, day, list_filter(list_transform(list_filter(list_transform(fit, lambda l: list_filter(string_split_regex(l, '[ \t\n\x0B\f\r]+'), lambda w: {_USEFUL.format(w='w')})), lambda p: len(p) BETWEEN 1 AND 3),
    lambda p: array_to_string(list_transform(p, lambda w: upper(w[1]) || lower(w[2:])), ' ')), lambda p: length(p) > 3 AND lower(p) NOT IN {TAG_STOPS_SQL}) AS p FROM starts
), heads AS (
  SELECT r, {_ONCE.format(l='l')}[:4] AS head FROM (SELECT r, list_concat({_ONCE.format(l='f')}, p) AS l FROM (SELECT r, p, list_concat(subjects, list_filter([day], lambda x: x IS NOT NULL)) AS f FROM phrases))
), words AS (
  SELECT r, unnest(w) AS w, unnest(range(len(w))) AS i FROM (SELECT r, regexp_extract_all(t, '[A-Za-z\x{{0900}}-\x{{097F}}\x{{0980}}-\x{{09FF}}\x{{0A00}}-\x{{0A7F}}]{{3,}}') AS w FROM base)
), counted AS (
  SELECT r, upper(w[1]) || lower(w[2:]) AS w, count(*) AS n, min(i) AS i FROM words WHERE {_USEFUL.format(w='w')} GROUP BY 1, 2
), ranked AS (
  SELECT r, list(w ORDER BY n DESC, i) AS ranked FROM counted WHERE length(w) >= 4 GROUP BY r
), joined AS (
  SELECT r, {_ONCE.format(l='l')}[:5] AS l FROM (SELECT r, list_concat(head, coalesce(ranked, [])) AS l FROM heads LEFT JOIN ranked USING (r))
), spare AS (
  SELECT r, l, list_concat(l, CASE WHEN category = 'Other' THEN [] ELSE [replace(category, ' ', '')] END, ['Reviewed', 'Document']) AS s FROM joined JOIN named USING (r)
), tags AS (
  SELECT r, CASE WHEN len(l) < 3 THEN {_ONCE.format(l='s')}[:3] ELSE l END AS tags FROM spare
)
SELECT doc_id, CAST(unnest(range(1, len(tags) + 1)) AS BIGINT) AS rank, unnest(tags) AS tag FROM tags JOIN base USING (r)"""


@query("auto_tags", AUTO_TAGS_SQL)
def auto_tags(spark, sf_dir):
    """Tags of the corpus."""
    docs = C.classify_generic(documents(spark, sf_dir))
    return C.tags(docs, category="category").select("doc_id", F.posexplode_outer("tags").alias("k", "tag")).select("doc_id", (F.col("k") + 1).cast("long").alias("rank"), "tag")


_AMB = r"\b(0?[1-9]|1[0-2])[/-](0?[1-9]|1[0-2])[/-](\d{4})\b"


@query("ambiguous_dates", f"""WITH t AS (SELECT o_orderkey AS doc_id, 'seen ' || strftime(o_orderdate, '%d/%m/%Y') || ' end' AS text FROM orders), m AS (SELECT doc_id, regexp_extract(text, '{_AMB}') AS raw, regexp_extract(text, '{_AMB}', 1) AS a, regexp_extract(text, '{_AMB}', 2) AS b, regexp_extract(text, '{_AMB}', 3) AS y FROM t)
SELECT doc_id, raw, y || '-' || lpad(a, 2, '0') || '-' || lpad(b, 2, '0') AS month_first, y || '-' || lpad(b, 2, '0') || '-' || lpad(a, 2, '0') AS day_first FROM m WHERE raw <> '' AND CAST(a AS INT) <> CAST(b AS INT)""")
def ambiguous_dates(spark, sf_dir):
    p = r"(?<![A-Za-z0-9_])(0?[1-9]|1[0-2])[/-](0?[1-9]|1[0-2])[/-](\d{4})(?![A-Za-z0-9_])"
    t = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("doc_id"), F.concat(F.lit("seen "), F.date_format("o_orderdate", "dd/MM/yyyy"), F.lit(" end")).alias("text"))
    g = lambda k: F.regexp_extract("text", p, k)
    m = t.select("doc_id", g(0).alias("raw"), g(1).alias("a"), g(2).alias("b"), g(3).alias("y")).filter((F.col("raw") != "") & (F.col("a").cast("int") != F.col("b").cast("int")))
    return m.select("doc_id", "raw", F.concat_ws("-", "y", F.lpad("a", 2, "0"), F.lpad("b", 2, "0")).alias("month_first"), F.concat_ws("-", "y", F.lpad("b", 2, "0"), F.lpad("a", 2, "0")).alias("day_first"))


@query("contact_or_event", """WITH t AS (SELECT c_custkey, lower(CASE c_custkey % 4 WHEN 0 THEN 'Zoom session, venue: hall' WHEN 1 THEN 'Director of Sales, tel: 1' WHEN 2 THEN 'Meeting with the manager' ELSE c_name END) AS t FROM customer)
SELECT c_custkey, CASE WHEN contains(t, 'zoom')::INT + contains(t, 'session')::INT + contains(t, 'venue:')::INT + contains(t, 'meeting')::INT > contains(t, 'director')::INT + contains(t, 'tel:')::INT + contains(t, 'manager')::INT THEN 'event' ELSE 'contact' END AS kind FROM t""")
def contact_or_event(spark, sf_dir):
    """10 points a keyword; an event only if strictly ahead."""
    k = F.col("c_custkey") % 4
    t = F.when(k == 0, "Zoom session, venue: hall").when(k == 1, "Director of Sales, tel: 1").when(k == 2, "Meeting with the manager").otherwise(F.col("c_name"))
    return table(spark, sf_dir, "customer").select("c_custkey", C.contact_or_event(t).alias("kind"))


@query("parse_requirements", """WITH t AS (SELECT p_partkey, p_size + 10 AS a, p_size + 60 AS b, p_partkey % 300 + 100 AS w, p_partkey % 400 + 120 AS h, p_partkey % 5 AS k FROM part),
v AS (SELECT p_partkey, k, CASE k WHEN 0 THEN a WHEN 1 THEN a * 1024 WHEN 2 THEN a END AS min_kb, CASE k WHEN 0 THEN b WHEN 1 THEN b * 1024 WHEN 2 THEN b WHEN 3 THEN b END AS max_kb, CASE k WHEN 0 THEN w::DOUBLE WHEN 1 THEN 3.5::DOUBLE WHEN 3 THEN w::DOUBLE END AS width, CASE k WHEN 0 THEN h::DOUBLE WHEN 1 THEN 4.5::DOUBLE WHEN 3 THEN w::DOUBLE END AS height, w, h FROM t)
SELECT p_partkey, CAST(min_kb AS BIGINT) AS min_kb, CAST(max_kb AS BIGINT) AS max_kb, width, height, CASE k WHEN 0 THEN 'px' WHEN 1 THEN 'cm' WHEN 3 THEN 'px' END AS unit,
  CASE k WHEN 0 THEN CASE WHEN w = h THEN '1:1' WHEN w = 200 AND h = 230 THEN '20:23' WHEN w = 350 AND h = 450 THEN '3.5:4.5' ELSE (w * 10 // gcd(w * 10, h * 10)) || ':' || (h * 10 // gcd(w * 10, h * 10)) END WHEN 1 THEN '3.5:4.5' WHEN 3 THEN '3:4' END AS ratio, CASE WHEN k = 0 THEN CAST(p_partkey % 3 * 100 + 100 AS BIGINT) END AS dpi,
  CASE k WHEN 0 THEN 'JPEG' WHEN 1 THEN 'JPG' WHEN 2 THEN 'PDF' WHEN 3 THEN 'JPEG' END AS format, k < 4 AS parsed, CASE k WHEN 0 THEN 1.0::DOUBLE WHEN 1 THEN 0.95::DOUBLE WHEN 2 THEN 0.7::DOUBLE WHEN 3 THEN 0.9::DOUBLE END AS confidence FROM v""")
def parse_requirements(spark, sf_dir):
    """Five kinds of instruction made of the parts. A lone `h` counts as height, also the one that ends `width`."""
    k, s = F.col("p_partkey"), lambda c: c.cast("string")
    a, b, w, h = s(F.col("p_size") + 10), s(F.col("p_size") + 60), s(k % 300 + 100), s(k % 400 + 120)
    kinds = [
        F.concat(F.lit("File size "), a, F.lit("KB-"), b, F.lit(" KB, "), w, F.lit("x"), h, F.lit(" pixels, JPEG or PNG, "), s(k % 3 * 100 + 100), F.lit(" dpi")),
        F.concat(F.lit("Photo 3.5 cm x 4.5 cm as jpg; between "), a, F.lit(" MB and "), b, F.lit(" MB")),
        F.concat(F.lit("At least "), a, F.lit(" kb, up to "), b, F.lit(" kbytes. PDF")),
        F.concat(b, F.lit(" KB or less, width: "), w, F.lit(" px, height: "), h, F.lit(" px, aspect ratio 3:4")),
        F.lit("Bring two photos"),
    ]
    t = table(spark, sf_dir, "part").select("p_partkey", F.element_at(F.array(*kinds), (k % 5 + 1).cast("int")).alias("text"))
    return R.parse_requirements(t).select("p_partkey", "min_kb", "max_kb", "width", "height", "unit", "ratio", "dpi", "format", "parsed", "confidence")


@query("form_fields_parse", """WITH c AS (SELECT event_id, props, event_type, user_id FROM events)
SELECT event_id, 'json' AS format, unnest(json_keys(props)) AS key, json_extract_string(props, '$.' || unnest(json_keys(props))) AS value FROM c WHERE event_id % 2 = 0
UNION ALL SELECT event_id, 'csv', unnest(['id', 'kind, quoted', 'sum']), unnest([CAST(user_id AS VARCHAR), event_type || ' "x", y', '=1+' || event_id]) FROM c WHERE event_id % 2 = 1""")
def form_fields_parse(spark, sf_dir):
    """JSON for even events, CSV with quotes, commas and a guarded formula for odd ones."""
    cells = F.concat(F.lit(' id ,"kind, quoted",sum\r\n'), F.col("user_id").cast("string"), F.lit(',"'), "event_type", F.lit(' ""x"", y",\'=1+'), F.col("event_id").cast("string"))
    e = table(spark, sf_dir, "events").select("event_id", F.when(F.col("event_id") % 2 == 0, F.col("props")).otherwise(cells).alias("text"))
    return R.form_fields(e, "event_id")


@query("profile_validate", """SELECT event_id, CASE event_id % 8 WHEN 0 THEN 'Empty input: Please provide valid profile JSON text.' WHEN 1 THEN 'Malformed JSON: The provided text is not valid JSON syntax.' WHEN 2 THEN 'Missing required field ''version''' WHEN 3 THEN 'Missing required field ''name'''
  WHEN 4 THEN 'Profile must contain at least one specification section: ''photo'', ''signature'', or ''pdf''.' WHEN 5 THEN CASE WHEN user_id % 50 > 20 THEN 'Field ''photo.minKb'' cannot exceed ''photo.maxKb''.' END WHEN 6 THEN 'Field ''pdf.unit'' must be one of ''px'', ''mm'', ''cm'', or ''in''.' END AS error FROM events""")
def profile_validate(spark, sf_dir):
    """Profiles made of the events, one kind of fault each; every eighth is valid."""
    low = (F.col("user_id") % 50).cast("string")
    kinds = [
        F.lit("  "), F.lit("{oops"), F.lit('{"id": "a"}'), F.lit('{"version": "1.0", "id": "a", "name": " "}'), F.lit('{"version": "1.0", "id": "a", "name": "n"}'),
        F.concat(F.lit('{"version": "1.0", "id": "a", "name": "n", "photo": {"maxKb": 20, "minKb": '), low, F.lit("}}")), F.lit('{"version": "1.0", "id": "a", "name": "n", "pdf": {"maxKb": 20, "unit": "ft"}}'),
        F.lit('{"version": "1.0", "id": "a", "name": "n", "signature": {"maxKb": 20, "width": 3.5, "unit": "cm"}}'),
    ]
    text = F.element_at(F.array(*kinds), (F.col("event_id") % 8 + 1).cast("int"))
    return table(spark, sf_dir, "events").select("event_id", R.profile_error(text).alias("error"))


@query("csv_safe_sink", r"""WITH v AS (SELECT event_id, ['=', '+', '-', '@', '|', ' =', ''][event_id % 7 + 1] || event_type || ',"x"' AS a, ['=', '+', '-', '@', '|', ' =', ''][event_id % 7 + 1] || event_id AS b FROM events)
SELECT CAST(event_id AS VARCHAR) AS event_id, CASE WHEN regexp_matches(ltrim(a), '^[=+\-@\t\r|%]') THEN '''' || a ELSE a END AS "text", CASE WHEN regexp_matches(ltrim(b), '^[=+\-@\t\r|%]') THEN '''' || b ELSE b END AS "number",
  CASE WHEN regexp_matches(trim(b), '^[+-]?(?:\d{1,3}(?:,\d{3})+|\d+)(?:\.\d+)?%?$') THEN trim(b) WHEN regexp_matches(trim(b), '^[=+\-@\t\r]') THEN '''' || trim(b) ELSE trim(b) END AS "numeric", CASE WHEN regexp_matches(b, '^[=+\-@\t\r]') THEN '''' || b ELSE b END AS raw FROM v""")
def csv_safe_sink(spark, sf_dir):
    """Guarded files of all three policies, read back as they stand."""
    lead = F.element_at(F.array(*map(F.lit, ["=", "+", "-", "@", "|", " =", ""])), (F.col("event_id") % 7 + 1).cast("int"))
    e = table(spark, sf_dir, "events").select("event_id", F.concat(lead, "event_type", F.lit(',"x"')).alias("text"), F.concat(lead, F.col("event_id").cast("string")).alias("number"))
    back = {}
    for policy in ("strict", "numeric", "raw"):
        path = scratch(spark, "csv")
        V.csv_safe(e, path, policy)
        back[policy] = spark.read.csv(path, header=True, quote='"', escape='"', ignoreLeadingWhiteSpace=False, ignoreTrailingWhiteSpace=False)
    out = back["strict"].join(back["numeric"].select("event_id", F.col("number").alias("numeric")), "event_id")
    return out.join(back["raw"].select("event_id", F.col("number").alias("raw")), "event_id")


@query("csv_unescape_formula", r"""SELECT event_id, CASE WHEN regexp_matches(v, '^''[=+\-@\t\r]') THEN v[2:] ELSE v END AS cell FROM (SELECT event_id, '''' || ['=', '+', 'a', '@'][event_id % 4 + 1] || event_type AS v FROM events)""")
def csv_unescape_formula(spark, sf_dir):
    lead = F.element_at(F.array(*map(F.lit, ["'=", "'+", "'a", "'@"])), (F.col("event_id") % 4 + 1).cast("int"))
    return table(spark, sf_dir, "events").select("event_id", F.regexp_replace(F.concat(lead, "event_type"), r"^'(?=[=+\-@\t\r])", "").alias("cell"))


@query("csv_delimiter_profile", r"""WITH t AS (SELECT doc_id, replace(replace(text, ' ', CASE doc_id % 4 WHEN 0 THEN chr(9) WHEN 1 THEN ';' WHEN 2 THEN '|' ELSE ',' END), '.', ';') AS t FROM documents), f AS (SELECT doc_id, array_to_string(string_split(t, chr(10))[1:5], chr(10)) AS f FROM t),
n AS (SELECT doc_id, len(string_split(f, chr(9))) - 1 AS a, len(string_split(f, ';')) - 1 AS b, len(string_split(f, '|')) - 1 AS c, len(string_split(f, ',')) - 1 AS d FROM f)
SELECT doc_id, CASE WHEN greatest(a, b, c, d) = 0 THEN ',' WHEN a = greatest(a, b, c, d) THEN chr(9) WHEN b = greatest(a, b, c, d) THEN ';' WHEN c = greatest(a, b, c, d) THEN '|' ELSE ',' END AS delimiter FROM n""")
def csv_delimiter_profile(spark, sf_dir):
    d = F.element_at(F.array(*map(F.lit, ["\t", ";", "|", ","])), (F.col("doc_id") % 4 + 1).cast("int"))
    t = F.replace(F.replace(F.col("text"), F.lit(" "), d), F.lit("."), F.lit(";"))
    return table(spark, sf_dir, "documents").select("doc_id", R.csv_delimiter(t).alias("delimiter"))


@query("batch_log_sink", """SELECT 'order "' || o_orderkey || '", ' || o_orderpriority AS name, CAST(o_orderkey * 10 AS VARCHAR) AS size, CASE o_orderstatus WHEN 'F' THEN 'completed' WHEN 'O' THEN 'skipped' ELSE 'failed' END AS status,
  CASE WHEN o_orderstatus = 'F' THEN CAST(o_orderkey * 7 AS VARCHAR) END AS out_size, CASE WHEN o_orderstatus = 'P' THEN 'partial, retry' END AS reason FROM orders""")
def batch_log_sink(spark, sf_dir):
    """The written log scanned again: names with quotes and commas, sizes, status and reason."""
    o, s = table(spark, sf_dir, "orders"), F.col("o_orderstatus")
    status = F.when(s == "F", "completed").when(s == "O", "skipped").otherwise("failed")
    runs = o.select(F.concat(F.lit('order "'), F.col("o_orderkey").cast("string"), F.lit('", '), "o_orderpriority").alias("name"), (F.col("o_orderkey") * 10).alias("size"), status.alias("status"), F.when(s == "F", F.col("o_orderkey") * 7).alias("out_size"), F.when(s == "P", "partial, retry").alias("reason"))
    path = scratch(spark, "log")
    V.batch_log(runs, path)
    return V.csv_scan(spark, path)


@query("unit_to_px", "SELECT p_partkey, CAST(floor(CASE p_partkey % 4 WHEN 0 THEN p_size * d WHEN 1 THEN p_size / 25.4::DOUBLE * d WHEN 2 THEN p_size / 2.54::DOUBLE * d ELSE p_size END + 0.5) AS BIGINT) AS px FROM (SELECT p_partkey, p_size, CASE WHEN p_partkey % 3000 BETWEEN 50 AND 2400 THEN p_partkey % 3000 ELSE 300 END AS d FROM part)")
def unit_to_px(spark, sf_dir):
    unit = F.element_at(F.array(*map(F.lit, ["in", "mm", "cm", "px"])), (F.col("p_partkey") % 4 + 1).cast("int"))
    return table(spark, sf_dir, "part").select("p_partkey", R.unit_to_px(F.col("p_size"), unit, F.col("p_partkey") % 3000).alias("px"))


@query("rename_template", """SELECT event_id, event_type || '-' || CAST(n AS VARCHAR) || '-' || CASE WHEN n < 100 THEN lpad(CAST(n AS VARCHAR), 3, '0') ELSE CAST(n AS VARCHAR) END || '_' || strftime(ts, '%Y%m%d') || '{x}' AS name,
  CASE event_id % 3 WHEN 0 THEN 'etc_' || event_type || '_' || n || '_' || user_id || '.pdf' WHEN 1 THEN 'a_b c_' || n || '_' || user_id || '.pdf' ELSE n || '_' || user_id || '.pdf' END AS file FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS n FROM events)""")
def rename_template(spark, sf_dir):
    """Names by a pattern, and file names of records whose cells try to leave their folder."""
    n = F.row_number().over(Window.partitionBy("user_id").orderBy("ts", "event_id"))
    e = table(spark, sf_dir, "events").withColumn("n", n)
    name = R.render("{name}-{n}-{nnn}_{yyyy}{mm}{dd}{x}", {"name": F.col("event_type"), "n": F.col("n"), "nnn": R.padded(F.col("n"), 3), "yyyy": F.date_format("ts", "yyyy"), "mm": F.date_format("ts", "MM"), "dd": F.date_format("ts", "dd")})
    cell = F.when(F.col("event_id") % 3 == 0, F.concat(F.lit("../../etc/"), "event_type", F.lit("_"))).when(F.col("event_id") % 3 == 1, '/a<:b c\\"').otherwise("%2E%2e./ ")
    file = R.record_file_name(" {Cell}{rowIndex}_{user_id} ", {"cell": cell, "User_ID": F.col("user_id")}, F.col("n"))
    return e.select("event_id", name.alias("name"), file.alias("file"))


@query("page_template", "SELECT event_id, 'Page ' || row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) || ' of ' || count(*) OVER (PARTITION BY user_id) || ' - user' || user_id AS header FROM events")
def page_template(spark, sf_dir):
    w = Window.partitionBy("user_id")
    e = table(spark, sf_dir, "events").withColumn("p", F.row_number().over(w.orderBy("ts", "event_id"))).withColumn("t", F.count("*").over(w))
    return e.select("event_id", R.render("Page {PAGE} of {totalPages} - {filename}", {"page": F.col("p"), "totalpages": F.col("t"), "filename": F.concat(F.lit("user"), F.col("user_id").cast("string"))}).alias("header"))


@query("safe_filename", r"SELECT p_partkey, CASE WHEN n = '' THEN 'document' ELSE n END AS name, CASE WHEN length(t) > 60 THEN regexp_replace(t[1:60], '^[._-]+|[._-]+$', '', 'g') ELSE t END AS title, s AS shared FROM (SELECT p_partkey, regexp_replace(regexp_replace(trim('../' || p_name || ': ' || p_type || ' é?'), '[^A-Za-z0-9._-]+', '_', 'g'), '^[._]+|[._]+$', '', 'g')[1:60] AS n, regexp_replace(regexp_replace(regexp_replace('../' || p_name || ': ' || p_type || ' é?', '[\\/:*?\"<>|]', '_', 'g'), '[\s_]+', '_', 'g'), '^[._-]+|[._-]+$', '', 'g') AS t, regexp_replace(p_name || ': ' || p_type || ' é?', '[^a-zA-Z0-9._-]', '_', 'g')[1:120] AS s FROM part)")
def safe_filename(spark, sf_dir):
    name = F.concat(F.lit("../"), "p_name", F.lit(": "), "p_type", F.lit(" é?"))
    return table(spark, sf_dir, "part").select("p_partkey", R.safe_filename(name).alias("name"), R.safe_filename(name, "title").alias("title"), R.safe_filename(name, "shared").alias("shared"))


@query("name_uniquify", """WITH n AS (SELECT p_partkey, CASE p_partkey % 6 WHEN 0 THEN p_brand || '_' || (p_partkey % 7 + 2) ELSE p_brand END AS name FROM part), taken AS (SELECT DISTINCT name FROM n), c AS (SELECT name, count(*) AS c FROM n GROUP BY name),
free AS (SELECT name, i, row_number() OVER (PARTITION BY name ORDER BY i) + 1 AS k FROM (SELECT name, unnest(range(2, c + 20)) AS i FROM c) WHERE name || '_' || i NOT IN (SELECT name FROM taken)), r AS (SELECT *, row_number() OVER (PARTITION BY name ORDER BY p_partkey) AS k FROM n)
SELECT p_partkey, CASE WHEN r.k = 1 THEN r.name ELSE r.name || '_' || i END AS unique_name FROM r LEFT JOIN free ON free.name = r.name AND free.k = r.k""")
def name_uniquify(spark, sf_dir):
    """Brands as names, some rows with a numbered one already."""
    k = F.col("p_partkey")
    n = table(spark, sf_dir, "part").select("p_partkey", F.when(k % 6 == 0, F.concat_ws("_", "p_brand", (k % 7 + 2).cast("string"))).otherwise(F.col("p_brand")).alias("name"))
    return R.name_uniquify(n, "name", "p_partkey").select("p_partkey", "unique_name")


@query("mail_merge", """WITH c AS (SELECT c_custkey, c_name, lower(c_mktsegment) AS segment, n_name FROM customer LEFT JOIN nation ON c_nationkey = n_nationkey AND n_nationkey % 5 <> 0)
SELECT c_custkey, 'Letter ' || CASE WHEN n_name IS NULL THEN '' ELSE n_name || ' ' END || c_custkey || '.pdf' AS file_name, f AS field, CASE f WHEN 'Text' THEN 'Dear ' || c_name || ', your ' || segment || ' account in ' || coalesce(n_name, '') || ' {missing}' WHEN 'Name' THEN c_name ELSE coalesce(n_name, '') END AS value
FROM c, (SELECT unnest(['Name', 'Country', 'Text']) AS f)""")
def mail_merge(spark, sf_dir):
    """Named records, a row a field. Cells without a value are empty; unknown placeholders stay."""
    c = table(spark, sf_dir, "customer").join(table(spark, sf_dir, "nation").filter("n_nationkey % 5 <> 0").select(F.col("n_nationkey").alias("c_nationkey"), "n_name"), "c_nationkey", "left")
    c = c.withColumn("text", R.render("Dear {c_NAME}, your { segment } account in {nation} {missing}", {"c_name": F.col("c_name"), "segment": F.lower("c_mktsegment"), "nation": F.col("n_name")}))
    c = c.withColumn("to", F.when(F.col("n_name").isNull(), "").otherwise(F.concat("n_name", F.lit(" "))))
    return R.mail_merge(c, {"Name": "c_name", "Country": "n_name", "Text": "text"}, "Letter {TO}{index}", F.col("c_custkey"), "c_custkey")


_CLEAN = "regexp_replace(lower(trim({0})), '[^a-z0-9]', '', 'g')"


@query("fuzzy_column_map", f"""WITH f AS (SELECT DISTINCT p_brand AS field FROM part), h AS (SELECT n_nationkey AS rank, CASE n_nationkey % 3 WHEN 0 THEN 'brand ' || n_nationkey WHEN 1 THEN 'BRAND_' || n_nationkey || '_x' ELSE 'brnd' || n_nationkey END AS header FROM nation),
p AS (SELECT field, header, rank, {_CLEAN.format('field')} AS a, {_CLEAN.format('header')} AS b FROM f, h), s AS (SELECT *, round(CASE WHEN lower(trim(field)) = lower(trim(header)) THEN 1.0::DOUBLE WHEN a = b THEN 0.95::DOUBLE WHEN contains(a, b) OR contains(b, a) THEN greatest(0.7::DOUBLE, 0.9::DOUBLE - abs(length(a) - length(b))::DOUBLE / greatest(length(a), length(b)) * 0.2::DOUBLE) ELSE greatest(0.0::DOUBLE, 1 - levenshtein(a, b)::DOUBLE / greatest(length(a), length(b))) END, 6) AS s FROM p),
b AS (SELECT *, row_number() OVER (PARTITION BY field ORDER BY s DESC, rank) AS k FROM s) SELECT field, CASE WHEN s >= 0.6 THEN header END AS header, floor(s * 100 + 0.5) / 100 AS confidence FROM b WHERE k = 1""")
def fuzzy_column_map(spark, sf_dir):
    k = F.col("n_nationkey")
    h = table(spark, sf_dir, "nation").select(k.alias("rank"), F.when(k % 3 == 0, F.concat(F.lit("brand "), k.cast("string"))).when(k % 3 == 1, F.concat(F.lit("BRAND_"), k.cast("string"), F.lit("_x"))).otherwise(F.concat(F.lit("brnd"), k.cast("string"))).alias("header"))
    return R.fuzzy_column_map(table(spark, sf_dir, "part").select(F.col("p_brand").alias("field")).distinct(), h)


@query("tiered_key_match", """WITH n AS (SELECT DISTINCT p_brand AS name FROM part), d AS (SELECT CASE n_nationkey % 4 WHEN 0 THEN 'Brand#' || n_nationkey WHEN 1 THEN 'BRAND#' || n_nationkey WHEN 2 THEN 'brand ' || n_nationkey ELSE 'other' || n_nationkey END AS key FROM nation),
a AS (SELECT name, min(key) AS key, 'exact' AS tier FROM n JOIN d ON name = key GROUP BY name), b AS (SELECT name, min(key) AS key, 'case' AS tier FROM n JOIN d ON lower(name) = lower(key) WHERE name NOT IN (SELECT name FROM a) GROUP BY name),
c AS (SELECT name, min(key) AS key, 'alnum' AS tier FROM n JOIN d ON regexp_replace(lower(name), '[^a-z0-9]', '', 'g') = regexp_replace(lower(key), '[^a-z0-9]', '', 'g') WHERE name NOT IN (SELECT name FROM a UNION ALL SELECT name FROM b) GROUP BY name), u AS (SELECT * FROM a UNION ALL SELECT * FROM b UNION ALL SELECT * FROM c)
SELECT * FROM u UNION ALL SELECT name, NULL, 'unmatched' FROM n WHERE name NOT IN (SELECT name FROM u) UNION ALL SELECT DISTINCT NULL, key, 'unused' FROM d WHERE key NOT IN (SELECT key FROM u)""")
def tiered_key_match(spark, sf_dir):
    k, s = F.col("n_nationkey"), F.col("n_nationkey").cast("string")
    d = table(spark, sf_dir, "nation").select(F.when(k % 4 == 0, F.concat(F.lit("Brand#"), s)).when(k % 4 == 1, F.concat(F.lit("BRAND#"), s)).when(k % 4 == 2, F.concat(F.lit("brand "), s)).otherwise(F.concat(F.lit("other"), s)).alias("key"))
    return R.tiered_key_match(table(spark, sf_dir, "part").select(F.col("p_brand").alias("name")).distinct(), d)


@query("batch_audit", """WITH f AS (SELECT p_partkey, CASE p_partkey % 5 WHEN 0 THEN 'PDF' WHEN 1 THEN 'PNG' WHEN 4 THEN 'UNKNOWN' ELSE 'JPEG' END AS format, p_partkey % 5 = 0 AS pdf, floor(p_partkey * 37 % 230000 / 1024 + 0.5) AS kb, CASE WHEN p_partkey % 11 > 0 THEN CASE WHEN p_size > 20 THEN 413 ELSE 300 + p_size END END AS w, 531 AS h FROM part),
r AS (SELECT p_partkey, CASE WHEN pdf THEN 'pdf' ELSE 'photo' END AS slot, list_filter([CASE WHEN format <> CASE WHEN pdf THEN 'PDF' ELSE 'JPEG' END THEN 'format' END, CASE WHEN kb > CASE WHEN pdf THEN 150 ELSE 200 END OR NOT pdf AND kb < 20 THEN 'size' END,
  CASE WHEN NOT pdf AND w IS NULL THEN 'decoding' END, CASE WHEN NOT pdf AND w <> 413 THEN 'dimensions' END, CASE WHEN NOT pdf AND NOT abs(w::DOUBLE / h - 35.0::DOUBLE / 45) < 0.05 THEN 'aspect_ratio' END], lambda x: x IS NOT NULL) AS failed, NOT pdf AND kb < 20 AS small FROM f)
SELECT p_partkey, slot, failed, len(failed) = 0 AS passed, len(failed) > 0 AND NOT list_contains(failed, 'decoding') AND NOT small AS fixable FROM r""")
def batch_audit(spark, sf_dir):
    """Parts as files: a profile of 35 by 45 mm photos at 300 dpi and of PDF files up to 150 KB."""
    k = F.col("p_partkey")
    name = F.concat(F.lit("f"), k.cast("string"), F.when(k % 5 == 0, ".PDF").when(k % 5 == 1, ".x").when(k % 5 == 2, ".JPG").when(k % 5 == 3, ".jpeg").otherwise(".gif"))
    wide = F.when(k % 11 > 0, F.when(F.col("p_size") > 20, 413).otherwise(300 + F.col("p_size")))
    files = table(spark, sf_dir, "part").select("p_partkey", name.alias("name"), F.when(k % 5 == 1, "image/png").alias("type"), (k * 37 % 230000).alias("bytes"), wide.alias("width"), F.lit(531).alias("height"))
    photo = {"format": "jpg", "min_kb": 20, "width": 35, "height": 45, "unit": "mm", "aspect_ratio": "35:45"}
    return R.batch_audit(files, {"target": "photo", "dpi": 300, "photo": photo, "pdf": {"max_kb": 150}}, "p_partkey")


@query("preflight_rules", """WITH p AS (SELECT l_orderkey, l_linenumber, CASE l_returnflag WHEN 'R' THEN 842 ELSE 595 END AS w, CASE WHEN l_returnflag = 'R' THEN 595 ELSE 842 END AS h, CASE WHEN l_quantity > 10 THEN CAST(l_quantity * 20 AS BIGINT) END AS dpi, CASE WHEN l_quantity < 3 THEN 0 ELSE CAST(l_quantity AS BIGINT) END AS chars FROM lineitem),
g AS (SELECT l_orderkey, count(*) AS n, count(DISTINCT (w, h)) AS sizes, count(DISTINCT w > h) AS kinds, min(dpi) AS dpi, sum(chars) AS chars, count(*) FILTER (chars = 0) AS blank FROM p GROUP BY 1),
f AS (SELECT o_orderkey, o_orderkey % 300 * 1024 AS bytes, o_orderkey % 10 = 0 AS enc, o_orderkey % 7 = 0 AS js, o_orderkey % 9 = 0 AS att, o_orderkey % 4 = 0 AS loose, coalesce(n, 0) AS n, coalesce(sizes, 0) AS sizes, coalesce(kinds, 0) AS kinds, dpi, coalesce(chars, 0) AS chars, coalesce(blank, 0) AS blank FROM orders LEFT JOIN g ON l_orderkey = o_orderkey),
c AS (SELECT o_orderkey, (bytes > 204800)::INT + (n NOT BETWEEN 1 AND 2)::INT + (sizes > 1)::INT + (kinds > 1)::INT + enc::INT + js::INT + att::INT AS fails, coalesce(dpi < 150, false)::INT + loose::INT + (chars < 50)::INT + (blank > 0)::INT AS warns, CASE WHEN chars < 50 THEN 'warn' ELSE 'pass' END AS searchable_text FROM f)
SELECT o_orderkey, CAST(11 - fails - warns AS BIGINT) AS passes, CAST(fails AS BIGINT) AS fails, CAST(warns AS BIGINT) AS warns, fails = 0 AS passed, searchable_text FROM c""")
def preflight_rules(spark, sf_dir):
    """Orders as files and their items as pages, against the strict profile."""
    k, q = F.col("o_orderkey"), F.col("l_quantity")
    files = table(spark, sf_dir, "orders").select("o_orderkey", (k % 300 * 1024).alias("bytes"), (k % 10 == 0).alias("encrypted"), (k % 7 == 0).cast("int").alias("scripts"), (k % 9 == 0).cast("int").alias("attachments"), (k % 4 == 0).cast("int").alias("loose_fonts"))
    wide = F.col("l_returnflag") == "R"
    pages = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("o_orderkey"), F.when(wide, 842).otherwise(595).alias("width"), F.when(wide, 595).otherwise(842).alias("height"), F.when(q > 10, (q * 20).cast("long")).alias("dpi"), F.when(q < 3, 0).otherwise(q.cast("long")).alias("chars"))
    return R.preflight(files, pages, "o_orderkey", R.PROFILES["200kb_a4"]).select("o_orderkey", "passes", "fails", "warns", "passed", "searchable_text")


@query("recipe_pipeline", r"""SELECT event_id, 'EVENT ' || upper(event_type) || ' ' || repeat(' ', length('u' || user_id || '@x.org')) AS note, value + 5 AS value, CASE WHEN event_id % 3 = 0 THEN CAST(event_id AS INT) END AS code, pos, CAST((pos - 1) // 20 + 1 AS BIGINT) AS part, CASE WHEN event_id % 3 <> 0 THEN 6 END AS failed_step
FROM (SELECT *, CAST(row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS BIGINT) AS pos FROM events) WHERE value >= 20""")
def recipe_pipeline(spark, sf_dir):
    """Seven steps of the library's operators; codes that are no numbers fail in the sixth and their rows go on."""
    e = O.positioned(table(spark, sf_dir, "events"), "user_id", "ts", "event_id")
    note = F.concat(F.lit("evt "), "event_type", F.lit(" u"), F.col("user_id").cast("string"), F.lit("@x.org"))
    e = e.select("event_id", note.alias("note"), "value", F.when(F.col("event_id") % 3 == 0, F.col("event_id").cast("string")).otherwise(F.concat(F.lit("x"), F.col("event_id").cast("string"))).alias("code"), "pos")
    steps = [("filter_min", {"column": "value", "least": "20"}), ("replace", {"column": "note", "find": "evt", "to": "event", "whole_word": True}), ("redact", {"column": "note", "kind": "email"}), ("upper", {"column": "note"}), ("add", {"column": "value", "amount": 5}), ("to_int", {"column": "code"}), ("split", {"size": 20})]
    return Y.run_recipe(e, Y.load_recipe(Y.dump_recipe("demo", [{"tool": t, "parameters": p} for t, p in steps])))


def turns(spark, sf_dir):
    c = table(spark, sf_dir, "conversations")
    return c.select("conv_id", "turn", F.col("text").alias("a")).join(c.select("conv_id", (F.col("turn") - 1).alias("turn"), F.col("text").alias("b")), ["conv_id", "turn"])


@query("text_diff")
def text_diff(spark, sf_dir):
    """Longest common subsequences are not for SQL; tests hold the counts against both texts."""
    return R.text_diff(turns(spark, sf_dir), ["conv_id", "turn"])


@query("diff_summary")
def diff_summary(spark, sf_dir):
    """Pages and words of the aligned conversations; tests hold the counts against a plain version."""
    pages = paired_pages(spark, sf_dir)
    return R.diff_summary(R.page_align(pages, "pair"), pages, "pair")


def paired_pages(spark, sf_dir):
    """Even conversations as old and the next odd one as new versions."""
    c = table(spark, sf_dir, "conversations")
    return c.select(F.floor(F.col("conv_id") / 2).cast("long").alias("pair"), F.when(F.col("conv_id") % 2 == 0, "old").otherwise("new").alias("side"), F.col("turn").alias("page_no"), "text")


@query("page_align")
def page_align(spark, sf_dir):
    """The alignment is a dynamic program, not SQL."""
    return R.page_align(paired_pages(spark, sf_dir), "pair")


CARDS_SQL = """cards AS (SELECT c_custkey AS doc_id, c_nationkey, c_custkey % 4 AS k FROM customer)"""


@query("extract_contact", f"""WITH {CARDS_SQL} SELECT doc_id, unnest(['name', 'title', 'organization', 'mobile', 'work', 'email', 'url', 'address', 'postal_code']) AS key, unnest(['Jane Doe', 'Senior Engineer', 'Acme ' || c_nationkey || ' Solutions', '+442079460' || lpad(CAST(doc_id % 1000 AS VARCHAR), 3, '0'), CASE WHEN k = 1 THEN '02055501' || lpad(CAST(doc_id % 100 AS VARCHAR), 2, '0') END,
  CASE WHEN k > 0 THEN 'c' || doc_id || '@example.com' END, 'www.example.com/' || doc_id, CASE WHEN k = 2 THEN '12 Baker Street, London NW1 6XE' END, CASE WHEN k = 2 THEN 'NW1 6XE' END]) AS value FROM cards""")
def extract_contact(spark, sf_dir):
    c = table(spark, sf_dir, "customer")
    k, s = F.col("c_custkey"), lambda x: x.cast("string")
    text = F.concat_ws(
        "\n", F.lit("Jane Doe"), F.lit("Senior Engineer"), F.concat(F.lit("Acme "), s(F.col("c_nationkey")), F.lit(" Solutions")), F.when(k % 4 > 0, F.concat(F.lit("mail: c"), s(k), F.lit("@example.com"))), F.concat(F.lit("+44 20 7946 0"), F.lpad(s(k % 1000), 3, "0")),
        F.when(k % 4 == 1, F.concat(F.lit("Office: 020 555 01"), F.lpad(s(k % 100), 2, "0"))), F.concat(F.lit("www.example.com/"), s(k)), F.when(k % 4 == 2, "12 Baker Street"), F.when(k % 4 == 2, "London NW1 6XE"),
    )
    d = c.select(k.alias("doc_id"), text.alias("text"))
    return X.extract_contact(X.lines(d), d)


_AMPM = "lpad(CAST((hour({t}) + 11) % 12 + 1 AS VARCHAR), 2, '0') || strftime({t}, ':%M') || CASE WHEN hour({t}) >= 12 THEN ' PM' ELSE ' am' END"


@query("extract_event", f"""SELECT event_id AS doc_id, CASE WHEN event_id % 3 = 0 THEN 'Board of ' || event_type ELSE 'Review of ' || event_type END AS title, strftime(ts, '%Y-%m-%d') AS date, CASE WHEN event_id % 4 <> 2 THEN strftime(ts, '%H:%M') END AS start,
  CASE event_id % 4 WHEN 0 THEN lpad(CAST((hour(ts) + 1) % 24 AS VARCHAR), 2, '0') || strftime(ts, ':%M') WHEN 1 THEN '23:59' WHEN 3 THEN strftime(ts + INTERVAL 90 MINUTE, '%H:%M') END AS "end", event_id % 4 = 2 AS all_day,
  CASE WHEN event_id % 5 = 0 THEN 'Room ' || user_id WHEN event_id % 7 = 0 THEN 'Online Meeting' END AS location, CASE WHEN event_id % 7 = 0 THEN 'https://meet.google.com/abc-' || event_id END AS link,
  CASE WHEN event_id % 7 <> 0 THEN '' ELSE CASE WHEN event_id % 3 = 0 THEN 'Title - Board of ' || event_type || ' ' ELSE '' END || CASE event_id % 4 WHEN 0 THEN strftime(ts, '%Y/%m/%d at %H:%M') WHEN 1 THEN strftime(ts, '%d.%m.%Y') || ' from ' || {_AMPM.format(t='ts')} || ' – 11:59 pm'
    WHEN 2 THEN day(ts) || 'th ' || strftime(ts, '%B, %Y') ELSE lpad(CAST(day(ts) AS VARCHAR), 2, '0') || '-' || strftime(ts, '%b-%Y') || ', ' || {_AMPM.format(t='ts')} || ' and ' || {_AMPM.format(t='(ts + INTERVAL 90 MINUTE)')} END || CASE WHEN event_id % 5 = 0 THEN ' Venue - Room ' || user_id ELSE '' END END AS description FROM events""")
def extract_event(spark, sf_dir):
    """Four ways to state a date, with a 24-hour clock, a range of two halves of the day, no time, and two single times."""
    e, k = table(spark, sf_dir, "events"), F.col("event_id")
    form = lambda f, t=F.col("ts"): F.date_format(t, f)
    half = lambda t: F.concat(form("hh:mm", t), F.when(F.hour(t) >= 12, " PM").otherwise(" am"))
    when = (
        F.when(k % 4 == 0, F.concat(form("yyyy/MM/dd"), F.lit(" at "), form("HH:mm"))).when(k % 4 == 1, F.concat(form("dd.MM.yyyy"), F.lit(" from "), half(F.col("ts")), F.lit(" – 11:59 pm")))
        .when(k % 4 == 2, F.concat(form("d"), F.lit("th "), form("MMMM, yyyy"))).otherwise(F.concat(form("dd-MMM-yyyy"), F.lit(", "), half(F.col("ts")), F.lit(" and "), half(F.col("ts") + F.expr("INTERVAL 90 MINUTES"))))
    )
    title = F.concat(F.when(k % 3 == 0, "Title - Board of ").otherwise("Review of "), F.col("event_type"))
    text = F.concat_ws("\n", title, F.concat(F.lit(" <b>"), when, F.lit("</b>")), F.when(k % 5 == 0, F.concat(F.lit("Venue - Room "), F.col("user_id").cast("string"))), F.when(k % 7 == 0, F.concat(F.lit("Join https://meet.google.com/abc-"), k.cast("string"))))
    return X.extract_event(e.select(k.alias("doc_id"), text.alias("text")))


def _csv_rows(spark, sf_dir):
    e = table(spark, sf_dir, "events")
    note = F.concat(F.lit(' say "'), "event_type", F.lit('",\nnext '), F.col("event_id").cast("string"))
    return e.select(F.col("event_id").cast("string").alias("id"), note.alias("note"), F.when(F.col("event_id") % 2 == 0, F.col("event_type")).alias("kind"))


@query("csv_scan", """SELECT CAST(event_id AS VARCHAR) AS id, 'say "' || event_type || '",' || chr(10) || 'next ' || event_id AS note, CASE WHEN event_id % 2 = 0 THEN event_type END AS kind FROM events""")
def csv_scan(spark, sf_dir):
    """Rows with quotes, commas and newlines written as CSV and scanned again."""
    path = scratch(spark, "csv")
    _csv_rows(spark, sf_dir).write.csv(path, header=True, quoteAll=True, escape='"')
    return V.csv_scan(spark, path)


@query("csv_all_quoted_sink", r"""SELECT '"' || event_id || '","' || event_type || ' ""x"", ' || user_id || '","' || CASE WHEN event_id % 2 = 0 THEN CAST(user_id AS VARCHAR) ELSE '' END || '"' AS line, count(*) AS n FROM events GROUP BY 1""")
def csv_all_quoted_sink(spark, sf_dir):
    """The written lines themselves: a mark and plain names first, every field of a row quoted, CRLF ends."""
    path = scratch(spark, "csv")
    note = F.concat("event_type", F.lit(' "x", '), F.col("user_id").cast("string"))
    V.csv_all_quoted(table(spark, sf_dir, "events").select("event_id", note.alias("note"), F.when(F.col("event_id") % 2 == 0, F.col("user_id")).alias("user_id")), path)
    lines = spark.read.option("lineSep", "\r\n").text(path).filter(~F.col("value").endswith("event_id,note,user_id"))
    return lines.groupBy(F.col("value").alias("line")).agg(F.count("*").alias("n"))


@query("regex_safety_check", r"""SELECT p_partkey, p_name, regexp_matches(p_name, 'r(ed|ing)') AS hit FROM part""")
def regex_safety_check(spark, sf_dir):
    """A user's pattern is checked before any row is read."""
    return table(spark, sf_dir, "part").select("p_partkey", "p_name", F.col("p_name").rlike(P.safe_pattern("r(ed|ing)")).alias("hit"))


@query("recipe_io", "SELECT event_id, upper(event_type) AS event_type FROM events WHERE value >= 50")
def recipe_io(spark, sf_dir):
    """A recipe exported to JSON, loaded again and run."""
    text = Y.dump_recipe("upper", [{"tool": "filter_min", "parameters": {"column": "value", "least": 50}}, {"tool": "upper", "parameters": {"column": "event_type"}}])
    return Y.run_recipe(table(spark, sf_dir, "events").select("event_id", "event_type", "value"), Y.load_recipe(text)).select("event_id", "event_type")
