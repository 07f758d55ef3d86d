"""Cases that the tables do not hold: edges, hostile texts, streams, sequences and invariants."""

import datetime as dt
import math
import random
import re

import pytest
from pyspark.sql import functions as F

from vellumframe.functions import text as T
from vellumframe.operators import classes as K
from vellumframe.operators import duplicates as D
from vellumframe.operators import extraction as X
from vellumframe.operators import ordering as O
from vellumframe.operators import readability as R
from vellumframe.operators import recipes as Y
from vellumframe.operators import records as C
from vellumframe.operators import search as Q
from vellumframe.operators import sensitive as P
from vellumframe.sources import pages as G
from vellumframe.streaming import events as S


def one(spark, value, f):
    return spark.createDataFrame([(value,)], "x string").select(f(F.col("x")).alias("y")).first()["y"]


@pytest.mark.parametrize("word,n", [("queue", 1), ("table", 2), ("nation", 2), ("walked", 1), ("wanted", 2), ("a", 1), ("boxes", 2), ("readability", 5), ("", 0), ("created", 2)])
def test_syllables(spark, word, n):
    assert one(spark, word, T.syllables) == n


def test_words_and_sentences(spark):
    assert one(spark, "Don't stop-over, éabc x_y 12", T.words) == ["Don't", "stop-over", "abc", "12"]
    assert one(spark, "Dr. Who met A. Smith. He left!\nFine?", T.sentences) == ["Dr. Who met A. Smith.", "He left!", "Fine?"]


def test_readability_of_blank_and_hostile_texts(spark):
    docs = spark.createDataFrame([(1, None), (2, "   "), (3, "x" * 51_000), (4, "a " * 75_000)], "doc_id long, text string")
    rows = {r["doc_id"]: r for r in R.readability_scores(R.doc_statistics(docs)).collect()}
    assert rows[1]["words"] == rows[2]["words"] == 0 and rows[1]["reading_ease"] == 100 and rows[1]["band"] == "easy"
    assert rows[3]["words"] == 1 and rows[3]["sentences"] == 1
    assert docs.filter("doc_id = 3").select(T.sentence_count(F.col("text"), 1500)).first()[0] == 34 and docs.filter("doc_id = 3").select(F.length(T.words(F.col("text"), 60)[0])).first()[0] == 60
    assert rows[4]["words"] == 75_000


def test_check_digits_and_masks(spark):
    assert one(spark, "4111 1111 1111 1111", T.luhn_valid) and not one(spark, "4111111111111112", T.luhn_valid)
    assert one(spark, "400638133393", T.ean13_check) == 1
    assert one(spark, "abcd", T.mask_sensitive) == "••••" and one(spark, "secret-value", T.mask_sensitive) == "s••••••••••e"


def test_pii_contexts_and_redaction(spark):
    docs = spark.createDataFrame([(1, "mail me at jo@ex.org now, card 4111 1111 1111 1111 ok, id ABCDE1234F")], "doc_id long, text string")
    got = {r["kind"]: r for r in P.pii_scan(docs).collect()}
    assert got["email"]["match"] == "jo@ex.org" and got["email"]["before"] == "mail me at" and got["email"]["after"].startswith("now, card")
    assert got["credit_card"]["match"] == "4111 1111 1111 1111" and got["tax_id"]["match"] == "ABCDE1234F"
    red = docs.select(P.pii_redact(F.col("text"), ["email"]).alias("t")).first()["t"]
    assert len(red) == len(docs.first()["text"]) and "jo@" not in red
    for bad in ("(a+)+", "(a|b)*x", ".*x.*"):
        with pytest.raises(ValueError):
            P.safe_pattern(bad)


def test_privacy_grades(spark):
    s = spark.createDataFrame([(1, "gps", 1), (2, "none", 0), (3, "script", 2), (4, "image_name", 1)], "doc_id long, signal string, count int")
    assert {r["doc_id"]: (r["score"], r["grade"]) for r in P.privacy_score(s).collect()} == {1: (65, "C"), 2: (100, "A+"), 3: (55, "C"), 4: (75, "B")}


def test_duplicates_do_not_depend_on_row_order(spark):
    rows = [(i, f"Text  number {i % 7}") for i in range(40)] + [(99, None), (98, " ")]
    want = None
    for seed in range(3):
        random.Random(seed).shuffle(rows)
        got = sorted(map(tuple, D.exact_dups(spark.createDataFrame(rows, "id long, text string").repartition(seed + 1), "id").collect()))
        want = want or got
        assert got == want
    assert len(want) == 40 and sum(r[3] for r in want) == 7


def test_hamming_pairs_find_all(spark):
    rnd = random.Random(3)
    base = [rnd.getrandbits(64) for _ in range(30)]
    hashes = [(i, h) for i, h in enumerate(base)] + [(100 + i, h ^ sum(1 << b for b in rnd.sample(range(64), i % 6))) for i, h in enumerate(base)]
    signed = [(i, h - (1 << 64) if h >> 63 else h) for i, h in hashes]
    got = {(r["a"], r["b"]) for r in D.hamming_pairs(spark.createDataFrame(signed, "id long, h long"), "id", "h").collect()}
    uniq = {}
    for i, h in hashes:
        uniq.setdefault(h, i)
    want = {(min(i, j), max(i, j)) for h, i in uniq.items() for g, j in uniq.items() if i < j and bin(h ^ g).count("1") <= 4}
    assert got == want


def test_components_of_a_path(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(40)] + [(100, 101)], "a long, b long")
    ids = spark.createDataFrame([(i,) for i in [*range(41), 100, 101, 500]], "id long")
    got = {r["id"]: r["component"] for r in D.connected_components(ids, edges).collect()}
    assert all(got[i] == 0 for i in range(41)) and got[101] == 100 and got[500] == 500


def test_cooldown_compares_with_the_last_accepted(spark, tmp_path):
    t0 = dt.datetime(2024, 1, 1)
    rows = [(k, "p", t0 + dt.timedelta(milliseconds=ms)) for k, ms in enumerate([0, 2000, 3500, 5000, 6600])]
    df = spark.createDataFrame(rows, "id long, payload string, ts timestamp")
    assert sorted(r["id"] for r in S.cooldown_dedup(df, "payload", "ts", "id").collect()) == [0, 2, 4]
    df.coalesce(1).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(df.schema).parquet(str(tmp_path / "in"))
    q = S.cooldown_stream(stream, "payload", "ts").writeStream.format("memory").queryName("cooled").outputMode("append").option("checkpointLocation", str(tmp_path / "cp")).start()
    q.processAllAvailable()
    q.stop()
    assert sorted(r["id"] for r in spark.table("cooled").collect()) == [0, 2, 4]


def test_ranges_and_orders():
    assert O.parse_ranges("1-3, 5,9-7") == [(1, 3), (5, 5), (7, 9)]
    assert O.order_expression("2n", 6) == [2, 4, 6] and O.order_expression("2n+1", 6) == [1, 3, 5] and O.order_expression("reverse", 3) == [3, 2, 1]
    with pytest.raises(ValueError):
        O.parse_ranges("1-x")


def test_roman_and_letters(spark):
    df = spark.createDataFrame([(n,) for n in (1, 4, 9, 1994, 3999, 4000, 27, 28)], "n long")
    assert [tuple(r) for r in df.select(O.to_roman(F.col("n")), O.to_letters(F.col("n"))).collect()][:4] == [("I", "a"), ("IV", "d"), ("IX", "i"), ("MCMXCIV", "r" * 77)]
    assert df.filter("n = 4000").select(O.to_roman(F.col("n"))).first()[0] == "4000"


def test_diff_counts_fit_both_texts(spark):
    pairs = spark.createDataFrame([(1, "the quick brown fox jumps", "the slow brown fox leaps high"), (2, "", "a b"), (3, None, None)], "k long, a string, b string")
    rows = C.text_diff(pairs, ["k"]).collect()
    for k, a, b in [(1, 5, 6), (2, 0, 2), (3, 0, 0)]:
        own = [r for r in rows if r["k"] == k]
        same = sum(r["change"] == "unchanged" for r in own)
        assert same + sum(r["side"] == "old" for r in own) == a and same + sum(r["side"] == "new" for r in own) == b
    assert sum(r["change"] == "unchanged" for r in rows if r["k"] == 1) == 3


def test_pages_align_around_an_insertion(spark):
    text = {"a": "alpha beta gamma delta", "b": "one two three four", "c": "red green blue pink", "x": "new page entirely different words"}
    rows = [(1, "old", i, text[c]) for i, c in enumerate("abc", 1)] + [(1, "new", i, text[c]) for i, c in enumerate("axbc", 1)]
    got = [(r["old_no"], r["new_no"]) for r in C.page_align(spark.createDataFrame(rows, "pair long, side string, page_no long, text string"), "pair").collect()]
    assert got == [(1, 1), (None, 2), (2, 3), (3, 4)]


@pytest.mark.parametrize("seed", range(3))
def test_names_stay_unique(spark, seed):
    rnd = random.Random(seed)
    names = ["x", "x", "x_2", "x_3", "x"] + [rnd.choice(["x", "y", "x_2", "x_2_2", "x_3", "y_10", "_2", ""]) for _ in range(60)]
    df = spark.createDataFrame(list(enumerate(names)), "id long, name string")
    got = {r["id"]: r["unique_name"] for r in C.name_uniquify(df, "name", "id").collect()}
    assert len(set(got.values())) == len(names) and {got[names.index(n)] for n in set(names)} == set(names)


def test_recipes_are_validated():
    with pytest.raises(ValueError):
        Y.validate_recipe([{"tool": "nothing", "parameters": {}}])
    with pytest.raises(ValueError):
        Y.validate_recipe([{"tool": "upper", "parameters": {}}])
    with pytest.raises(ValueError):
        Y.validate_recipe([{"tool": "upper", "parameters": {"column": "x"}}] * 11)
    steps = [{"tool": "upper", "parameters": {"column": "x"}}]
    assert Y.load_recipe(Y.dump_recipe("r", steps)) == steps


def test_bm25_prefers_the_answering_page(spark):
    docs = spark.createDataFrame([(1, "Employees get 20 days of paid vacation each year", True), (2, "Billing schedule and invoice terms", True), (3, "Vacation photos", True), (4, "paid vacation days", False)], "doc_id long, text string, fine boolean")
    q = spark.createDataFrame([(1, "Paid vacation days?"), (2, "zebra"), (3, "the of")], "query_id long, query string")
    got = Q.bm25(docs, q, ["doc_id"], "text", enabled=F.col("fine")).orderBy("query_id", "rank").collect()
    assert [(r["query_id"], r["doc_id"]) for r in got] == [(1, 1), (1, 3)] and got[0]["confidence"] == 95
    assert Q.bm25(docs, q, ["doc_id"], "text", least=1e9).count() == 0
    loaded = Q.bm25(docs, q, ["doc_id"], "text", enabled=F.col("fine"), df_scope="loaded").filter("rank = 1").first()["score"]
    assert loaded < got[0]["score"]


def test_bm25_of_paragraphs_against_a_plain_version(spark):
    rnd = random.Random(4)
    words = "lease rent tenant deposit garden window door roof notice repair".split()
    texts = ["\n\n".join(" ".join(rnd.choice(words) for _ in range(12)) + "." for _ in range(4)) for _ in range(8)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    q = spark.createDataFrame([(1, "tenant deposit deposit")], "query_id long, query string")
    got = [(r["doc_id"], r["chunk_no"], r["score"]) for r in Q.bm25(Q.chunks(docs), q, ["doc_id", "chunk_no"], "chunk", k=5).orderBy("rank").collect()]
    units = {(d, k): p.lower().rstrip(".").split() for d, t in enumerate(texts) for k, p in enumerate(t.split("\n\n"), 1)}
    mean = sum(map(len, units.values())) / len(units)
    df = {t: sum(t in u for u in units.values()) for t in ("tenant", "deposit")}
    idf = {t: math.log(1 + (len(units) - n + 0.5) / (n + 0.5)) for t, n in df.items()}
    score = {u: round(sum(idf[t] * w.count(t) * 2.2 / (w.count(t) + 1.2 * (0.25 + 0.75 * len(w) / mean)) for t in ("tenant", "deposit", "deposit")), 6) for u, w in units.items()}
    want = sorted(((d, k, v) for (d, k), v in score.items() if v > 0), key=lambda x: (-x[2], x[0], x[1]))[:5]
    assert [g[:2] for g in got] == [w[:2] for w in want] and all(abs(g[2] - w[2]) < 2e-6 for g, w in zip(got, want))


def test_entities_first_seen(spark):
    text = "Effective Date: 2024-01-05\nsigned 2024-01-05, again 5 March 2024\nTotal: USD 1,200.50 and $85, USD  1,200.50, $0.00\nby and between Acme Corp. and Beta Holdings Ltd, the buyers\nVendor: Gamma Works\nparty: the"
    docs = spark.createDataFrame([(1, text)], "doc_id long, text string")
    rows = X.extract_all(docs).withColumn("iso", X.iso_date(F.col("value"))).withColumn("n", X.amount_value(F.col("value"))).collect()
    got = {(r["kind"], r["value"]): r for r in rows}
    assert got["date", "2024-01-05"]["label"] == "Effective Date" and got["date", "2024-01-05"]["context"].startswith("Effective") and got["date", "5 March 2024"]["iso"] == "2024-03-05"
    assert got["amount", "USD 1,200.50"]["label"] == "Total Amount" and got["amount", "USD 1,200.50"]["n"] == 1200.5 and [k for k in got if k[0] == "amount"] == [("amount", "USD 1,200.50"), ("amount", "$85")] or len([k for k in got if k[0] == "amount"]) == 2
    assert got["party", "Acme Corp."]["label"] == "First Party" and got["party", "Beta Holdings Ltd"]["label"] == "Second Party" and got["party", "Gamma Works"]["label"] == "Vendor"


@pytest.mark.parametrize("raw,iso", [("12/31/2024", "2024-12-31"), ("31/12/2024", "31/12/2024"), ("2024/2/3", "2024-02-03"), ("1.2.99", "1999-01-02"), ("March 5, 2024", "2024-03-05"), ("5th March 2024", "5th March 2024"), ("2024-02-31", "2024-02-31")])
def test_iso_dates(spark, raw, iso):
    assert one(spark, raw, X.iso_date) == iso


def test_clauses_are_segments_with_markers(spark):
    text = "1. Use. The tenant may occupy the flat freely.\nThe tenant shall pay the rent\nwithin 10 days of notice.\n2. Breach\nA penalty applies. The tenant shall pay the rent within 10 days of notice.\nSo it is"
    docs = spark.createDataFrame([(1, text)], "doc_id long, text string")
    segments = [r["segment"] for r in X.contract_segments(X.lines(docs)).orderBy("segment_no").collect()]
    assert "The tenant may occupy the flat freely." in segments and segments.count("The tenant shall pay the rent within 10 days of notice.") == 2
    got = {r["segment"]: r["category"] for r in X.extract_clauses(X.contract_segments(X.lines(docs))).collect()}
    assert got["The tenant may occupy the flat freely."] == "right" and got["The tenant shall pay the rent within 10 days of notice."] == "deadline" and len(got) == 3


FIELD_TEXTS = {
    "RECEIPT": ("Corner Shop\nReceipt no: R-77\n03/04/2025\nSubtotal 10.00\nVAT 2.00\nTotal $12.00", {"date": "03/04/2025", "grandTotal": "$12.00", "subtotal": "10.00", "taxAmount": "2.00", "receiptNumber": "R-77", "orderNumber": None, "vendorName": "Corner Shop", "customerName": None, "address": None}),
    "ID_DOCUMENT": ("Identity card\nName: Jane Roe\nDOB 01/02/1990\nIssued 2020-05-06\nValid until 2030-05-06\nCard no: AB-123", {"date": "2020-05-06", "dob": "01/02/1990", "expiryDate": "2030-05-06", "idNumber": "AB-123", "customerName": "Jane Roe", "address": None}),
    "UTILITY_BILL": ("From: City Electric\nBill to:\nJohn Doe\n12 Main Street\nSpringfield 90210\nConsumer id: C-9\nDue date: 2025-01-31\nAmount due: Rs. 300", {"date": None, "dueDate": "2025-01-31", "grandTotal": None, "balanceDue": "Rs. 300", "referenceId": None, "orderNumber": None, "accountNumber": "C-9", "vendorName": "City Electric", "customerName": "John Doe", "address": "12 Main Street, Springfield 90210"}),
}


@pytest.mark.parametrize("kind", FIELD_TEXTS)
def test_fields_by_kind_of_document(spark, kind):
    text, want = FIELD_TEXTS[kind]
    rows = X.extract_fields(spark.createDataFrame([(1, text, kind), (2, None, kind)], "doc_id long, text string, category string")).collect()
    assert {r["key"]: r["value"] for r in rows if r["doc_id"] == 1} == want
    assert all((r["confidence"] == 0) == (r["value"] is None) for r in rows) and all(r["value"] is None for r in rows if r["doc_id"] == 2)


def test_classes_by_hand(spark):
    docs = spark.createDataFrame([(1, "Cash receipt: subtotal 5", 1, None), (2, "AGREEMENT between the parties", 3, None), (3, "hello", 1, "tax invoice 7.pdf"), (4, None, None, None)], "doc_id long, text string, pages int, hint string")
    got = {r["doc_id"]: (r["category"], r["points"], r["confidence"], [tuple(x) for x in r["secondary"]]) for r in K.classify_generic(docs, pages="pages", hint="hint").collect()}
    assert got[1] == ("Receipt", 100.0, 89, []) and got[2] == ("Contract", 70.0, 79, []) and got[3] == ("Invoice", 52.0, 73, []) and got[4] == ("Other", 0.0, 15, [])
    simple = {r["doc_id"]: (r["category"], r["confidence"]) for r in K.classify_simple(docs).collect()}
    assert simple == {1: ("RECEIPT", 98), 2: ("UNKNOWN", 30), 3: ("UNKNOWN", 30), 4: ("UNKNOWN", 0)}


def test_tags_and_names(spark):
    docs = spark.createDataFrame([(1, "Electricity and Water\nCity Power Works\nfor March 2025\nmeter meter reading", "Utility Bill"), (2, "", "Other"), (3, None, "Official Letter")], "doc_id long, text string, category string")
    got = {r["doc_id"]: r["tags"] for r in K.tags(docs, category="category").collect()}
    assert got[1][:3] == ["Electricity", "Water", "March 2025"] and len(got[1]) == 5 and len(set(got[1])) == 5
    assert got[2] == ["Reviewed", "Document"] and got[3] == ["OfficialLetter", "Reviewed", "Document"]
    assert one(spark, "Vendor: Blue Sky Ltd\nOn 5 March 2024", lambda x: K.rename_proposal(F.lit("Utility Bill"), K.entity_of(x), K.iso_date_of(x))) == "UtilityBill_Blue_Sky_Ltd_2024-03-05.pdf"
    assert one(spark, "../..", K.pdf_name) == "Document.pdf" and one(spark, "due 31/12/2024", K.iso_date_of) == "2024-12-31"


def test_rule_packs_are_checked(spark):
    schema = "category string, kind string, pattern string, weight int, rank int"
    for bad in (("a", "regex", "(x+)+", 5, 1), ("a", "glob", "x", 5, 1), ("", "term", "x", 5, 1), ("a", "term", " ", 5, 1), ("a", "term", "x", 0, 1)):
        with pytest.raises(ValueError):
            K.rule_pack(spark.createDataFrame([bad], schema))
    with pytest.raises(ValueError):
        K.rule_pack(spark.createDataFrame([("a", "term", "x", 1, k) for k in range(4)], schema), most=3)


@pytest.mark.parametrize("raw,text", [
    ("<script>a</style>b</script>c", "c"), ("a<STYLE>x</style >b<frame src=x>c", "a b c"), ("<!-- <script> -->ok", "ok"), ("<form><button>no</button></form>&lt;yes&gt;", "<yes>"), ("<select><select>x</select>y", "y"),
])
def test_html_text(spark, raw, text):
    assert one(spark, raw, P.html_text) == text


def test_html_loses_handlers_and_bad_addresses(spark):
    got = one(spark, "<a onclick='x()' href=\"http://10.0.0.1/a\">k</a><img src='https://ok.org/i' onerror=go()><meta x><b>t</b>", P.html_sanitized)
    assert "onclick" not in got and "onerror" not in got and "10.0.0.1" not in got and "https://ok.org/i" in got and "<meta" not in got and "<b>t</b>" in got


def test_verification_states(spark):
    targets = spark.createDataFrame([(1, "Jane  Doe", None), (1, "555", "residual_risk"), (2, "x", None), (3, "y", None)], "doc_id long, target string, reason string")
    out = spark.createDataFrame([(1, "here is JANE DOE", None), (2, "none", "X")], "doc_id long, text string, meta string")
    got = {(r["doc_id"], r["target"]): r["status"] for r in P.pii_verify(targets, out, "meta").collect()}
    assert got == {(1, "Jane  Doe"): "failed", (1, "555"): "residual_risk", (2, "x"): "failed", (3, "y"): "verified"}


@pytest.mark.parametrize("name,strict,title,shared", [("../a b/é:x.pdf", "a_b_x.pdf", "a_b_é_x.pdf", "__x.pdf"), ("", "document", "", "shared_file"), ("..hidden", "hidden", "hidden", "hidden")])
def test_filename_variants(spark, name, strict, title, shared):
    assert [one(spark, name, lambda x, v=v: C.safe_filename(x, v)) for v in ("strict", "title", "shared")] == [strict, title, shared]


def test_near_groups_need_similar_words(spark):
    a, b = "alpha beta gamma delta epsilon zeta eta", "one two three four five six seven"
    rows = [(1, 0, a), (2, 1, a + " theta"), (3, 3, b), (4, 0, a), (5, 0x0F0F0F0F0F0F0F0F, None), (6, 0x0F0F0F0F0F0F0F0E, None), (7, 0, b + " x y z w v u t s r")]
    got = {r["id"]: (r["group_id"], r["size"], r["distance"]) for r in D.near_dups(spark.createDataFrame(rows, "id long, h long, text string"), "id", "h", text="text").collect()}
    assert got[1][0] == got[2][0] == got[4][0] == 1 and got[3] == (3, 1, None) and got[7][1] == 1 and got[5][0] == got[6][0] == 5 and got[5][2] == 1
    alone = D.near_dups(spark.createDataFrame([(1, 0, a), (2, 0, a)], "id long, h long, text string"), "id", "h", text="text").collect()
    assert {r["group_id"] for r in alone} == {1, 2}  # an exact pair is no near pair


def test_exact_groups_by_image_where_there_is_no_text(spark):
    rows = [(1, "A b", 7), (2, "a  B", 8), (3, None, 7), (4, "", 7), (5, None, 9), (6, "c", 9)]
    got = {r["id"]: r["group_id"] for r in D.exact_dups(spark.createDataFrame(rows, "id long, text string, img long"), "id", image="img").collect()}
    assert got == {1: 1, 2: 1, 3: 3, 4: 3}


def test_requirements(spark):
    rows = ["20-50 KB", "size: 2 MB", "100 KB max, 3.5 x 4.5 cm, 16:9 aspect ratio", "140 px (width) by 60 px (height)", "35 mm x 45 mm at 30 dpi", None]
    got = [r.asDict() for r in C.parse_requirements(spark.createDataFrame(list(enumerate(rows)), "k long, text string")).orderBy("k").collect()]
    assert (got[0]["min_kb"], got[0]["max_kb"], got[0]["confidence"]) == (20, 50, 0.65) and got[1]["max_kb"] == 2048 and (got[2]["max_kb"], got[2]["unit"], got[2]["ratio"]) == (100, "cm", "16:9")
    assert (got[3]["width"], got[3]["height"], got[3]["ratio"]) == (140, 60, "7:3") and (got[4]["unit"], got[4]["ratio"], got[4]["dpi"]) == ("mm", "3.5:4.5", None) and not got[5]["parsed"] and got[5]["format"] is None


def test_forms(spark):
    rows = [(1, '{"a": 1, "b": {"value": "x", "type": "t"}, "__proto__": 2}'), (2, 'a,"b ""q"""\n1,\'=2'), (3, "only names"), (4, None)]
    got = {(r["id"], r["key"]): r["value"] for r in C.form_fields(spark.createDataFrame(rows, "id long, text string"), "id").collect()}
    assert got == {(1, "a"): "1", (1, "b"): "x", (2, "a"): "1", (2, 'b "q"'): "=2"}


@pytest.mark.parametrize("subset,pages", [("5,1-2", [5, 1, 2]), ("3-1", [3, 2, 1]), ("", [1, 2, 3, 4, 5]), (None, [1, 2, 3, 4, 5]), ("2,2,1-3", [2, 1, 3]), ("9", None), ("1;2", None), (",", None)])
def test_merge_subsets(spark, subset, pages):
    assert spark.createDataFrame([(subset,)], "s string").select(O.subset_pages(F.col("s"), F.lit(5).cast("long")).alias("p")).first()["p"] == pages


def test_sections(spark):
    rows = [(1, "pre\n# A\nx\n## B\n\n### C\ny\n#### no"), (2, "a\fb\f"), (3, "# only\nx"), (4, None), (5, "#nospace\nx")]
    got = {}
    for r in G.section_split(spark.createDataFrame(rows, "doc_id long, text string")).orderBy("doc_id", "section").collect():
        got.setdefault(r["doc_id"], []).append((r["title"], r["content"]))
    assert got == {1: [("Introduction", "pre"), ("A", "x"), ("C", "y\n#### no")], 2: [("Page 1", "a"), ("Page 2", "b")], 3: [("Full Document", "# only\nx")], 4: [("Full Document", "")], 5: [("Full Document", "#nospace\nx")]}


def test_literal_hits_and_cased_terms(spark):
    docs = spark.createDataFrame([(1, "The cat, the CAT. Catalog"), (2, None)], "doc_id long, text string")
    assert [(r["hit"], r["at"], r["found"]) for r in G.find_literal(docs, "cat", whole_word=True).collect()] == [(1, 4, "cat"), (2, 13, "CAT")]
    assert docs.filter("doc_id = 1").select(G.replace_terms(F.col("text"), [("cased_word", "cat", "dog"), ("cased", "the", "a")]).alias("t")).first()["t"] == "A dog, a DOG. Catalog"


def test_key_tiers_on_both_sides(spark):
    n, d = spark.createDataFrame([("A",), ("b",), ("c d",), ("zz",)], "name string"), spark.createDataFrame([("A",), ("B",), ("C_D",), ("q",)], "key string")
    assert {tuple(r) for r in C.tiered_key_match(n, d).collect()} == {("A", "A", "exact"), ("b", "B", "case"), ("c d", "C_D", "alnum"), ("zz", None, "unmatched"), (None, "q", "unused")}


def test_diff_summary_against_a_plain_version(spark):
    rows = [(1, "old", 1, "a b c d"), (1, "old", 2, "p q r s"), (1, "new", 1, "a b x d e"), (1, "new", 2, "k l m n"), (1, "new", 3, "p q r s")]
    pages = spark.createDataFrame(rows, "pair long, side string, page_no long, text string")
    got = C.diff_summary(C.page_align(pages, "pair"), pages, "pair").first().asDict()
    assert got == {"pair": 1, "pages_compared": 3, "pages_identical": 1, "pages_changed": 1, "pages_added": 1, "pages_removed": 0, "words_added": 5, "words_removed": 0, "words_changed": 1}
    one_pair = spark.createDataFrame([(1, "A  b", "a b")], "k long, a string, b string")
    assert C.diff_counts(one_pair, ["k"], ignore_case=True).first()[1:] == (0, 0, 0) and C.diff_counts(one_pair, ["k"], ignore_case=True, ignore_whitespace=False).first()["changed"] == 1


def greedy(times, cooldown):
    kept, last = [], None
    for k, t in enumerate(times):
        if last is None or t - last >= cooldown:
            kept.append(k)
            last = t
    return kept


@pytest.mark.parametrize("seed", range(2))
def test_long_chains_are_walked_whole(spark, seed):
    rnd = random.Random(seed)
    times = sorted(rnd.randrange(0, 400_000) for _ in range(700))
    t0 = dt.datetime(2024, 1, 1)
    df = spark.createDataFrame([(k, "p", t0 + dt.timedelta(milliseconds=t)) for k, t in enumerate(times)], "id long, payload string, ts timestamp")
    assert sorted(r["id"] for r in S.cooldown_dedup(df, "payload", "ts", "id").collect()) == greedy(times, 3000)
    sizes = [rnd.choice([0, 1, 5, 9, 30]) for _ in range(300)]
    got = [r["part"] for r in O.split_max_size(spark.createDataFrame([(1, k + 1, s) for k, s in enumerate(sizes)], "doc long, pos long, size long"), "doc", "size", 20).orderBy("pos").collect()]
    part, used, want = 0, None, []
    for s in sizes:
        part, used = (part + 1, s) if used is None or used + s > 20 else (part, used + s)
        want.append(part)
    assert got == want


def replay(spark, tmp_path, df, build, name, parts=3):
    """What a stream puts out for rows that come in order of time over several triggers."""
    rows = df.orderBy("ts", "id").collect()
    step = -(-len(rows) // parts)
    for k in range(parts):
        spark.createDataFrame(rows[k * step : (k + 1) * step], df.schema).coalesce(1).write.parquet(str(tmp_path / f"{name}/b={k}"))
    stream = spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / name))
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "1")  # one state store
    q = build(stream).writeStream.format("memory").queryName(name).outputMode("append").option("checkpointLocation", str(tmp_path / f"{name}-cp")).start()
    spark.conf.set("spark.sql.shuffle.partitions", before)
    q.processAllAvailable()
    q.stop()
    return spark.table(name)


def test_streams_equal_their_batch_forms(spark, tmp_path):
    rnd = random.Random(8)
    t0 = dt.datetime(2024, 1, 1, 22)
    rows = [(k, rnd.choice("ab"), rnd.choice(["p", "q", "r", "s"]), t0 + dt.timedelta(seconds=60 * k), rnd.random() < 0.3) for k in range(150)]
    df = spark.createDataFrame(rows, "id long, user string, op string, ts timestamp, gone boolean")
    ids = lambda d: sorted(r["id"] for r in d.select("id").collect())
    cool = replay(spark, tmp_path, df, lambda s: S.cooldown_stream(s, "op", "ts", 150_000), "cool")
    assert ids(cool) == ids(S.cooldown_dedup(df, "op", "ts", "id", 150_000))
    session = replay(spark, tmp_path, df, lambda s: S.session_stream(s, ["user", "op"], "ts", "gone", "6 hours"), "session")
    assert ids(session) == ids(S.session_dedup(df, ["user", "op"], "ts", "id", F.col("gone")))
    first = replay(spark, tmp_path, df, lambda s: S.session_stream(s, ["user", "op"], "ts", session="6 hours"), "first")
    assert len(ids(first)) == len(ids(S.session_dedup(df, ["user", "op"], "ts", "id")))
    allowed = replay(spark, tmp_path, df, lambda s: S.allowance_stream(s, "user", "op", "ts", 2), "allowed")
    assert sorted((r["id"], r["granted"]) for r in allowed.collect()) == sorted((r["id"], r["granted"]) for r in S.daily_allowance(df, "user", "op", "ts", "id", 2).collect())
    quota = replay(spark, tmp_path, df.withColumn("ok", ~F.col("gone")), lambda s: S.quota_stream(s, "user", "ts", "ok", 20), "quota")
    batch = S.quota_gate(df.withColumn("ok", ~F.col("gone")), "user", "id", "ok", 20)
    assert sorted((r["id"], r["status"]) for r in quota.collect()) == sorted((r["id"], r["status"]) for r in batch.collect())


def test_history_stream_keeps_the_newest(spark, tmp_path):
    from vellumframe.sources.csv import compact_history, read_history, streaming_history

    t0 = dt.datetime(2024, 1, 1)
    rows = [(u, k, t0 + dt.timedelta(minutes=k)) for u in (1, 2) for k in range(30)]
    df = spark.createDataFrame(rows, "user long, id long, ts timestamp")
    for part in range(3):
        df.filter(F.col("id") % 3 == part).coalesce(1).write.parquet(str(tmp_path / f"in/p={part}"))
    schema = "user long, id long, ts timestamp"
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    streaming_history(stream, str(tmp_path / "out"), str(tmp_path / "cp"), "user", "ts", "id", 7).awaitTermination()
    got = sorted((r["user"], r["id"]) for r in read_history(spark, str(tmp_path / "out"), schema, "user", "ts", "id", 7).collect())
    assert got == [(u, k) for u in (1, 2) for k in range(23, 30)]
    compact_history(spark, str(tmp_path / "out"), str(tmp_path / "small"), schema, "user", "ts", "id", 7)
    assert sorted((r["user"], r["id"]) for r in read_history(spark, str(tmp_path / "small"), schema, "user", "ts", "id", 7).collect()) == got


def test_paragraphs_keep_all_words(spark):
    from vellumframe.operators.layout import paragraph_split

    docs = spark.createDataFrame([(1, "First part here is long enough.\n\nSecond part is long enough too.\n\nShort"), (2, "A. " * 400), (3, None), (4, "One line that is long enough to stay.\nAnother line that is long enough.")], "doc_id long, text string")
    got = {}
    for r in paragraph_split(docs).collect():
        got.setdefault(r["doc_id"], []).append((r["paragraph_no"], r["paragraph"]))
    assert len(got[1]) == 2 and got[1][1][1].endswith("Short") and len(got[4]) == 2 and 3 not in got
    assert " ".join(p for _, p in sorted(got[2])).split() == ("A. " * 400).split() and len(got[2]) >= 4


def test_paragraphs_against_a_plain_version(spark):
    from vellumframe.operators.layout import paragraph_split

    rnd = random.Random(5)
    bits = ["Section 4", "Overview", "Short.", "This sentence is long enough to stand alone.", "And another one of that sort, with a comma!", "ends without a stop though it is quite long and goes on and on until ninety characters are full", "3. Numbered"]
    texts = [rnd.choice(["\n\n", "\n", " "]).join(rnd.choice(bits) for _ in range(rnd.randrange(1, 30))) for _ in range(40)] + ["", "  ", "tail without stop " * 40]

    def plain(text):
        parts = [p.strip() for p in re.split(r"\n\s*\n", text) if p.strip()]
        if len(parts) <= 1 and "\n" in text:
            lines = [p.strip() for p in re.split(r"\n+", text) if p.strip()]
            parts = lines if len(lines) > 1 else parts
        if len(parts) == 1 and len(text) > 350 and "\n" not in text.strip():
            chunks, cur = [], ""
            for sentence in re.findall(r"[^.!?]+[.!?]+(?:\s+|$)|[^.!?]+$", text):
                if len((cur + " " + sentence).strip()) > 300 and len(cur) > 50:
                    chunks.append(cur.strip())
                    cur = sentence
                else:
                    cur += (" " if cur else "") + sentence
            parts = chunks + ([cur.strip()] if cur.strip() else [])
        out, held = [], ""
        for p in (" ".join(p.split()) for p in parts):
            if len(p) < 90 and (p[-1] not in ".!?" or re.match(r"(?i)(Section|Chapter|Part|Article|\d+\.)", p)):
                held = f"{held}: {p}" if held else p
                continue
            p, held = (f"{held}. {p}" if held else p), ""
            if len(p) > 25 or not out:
                out.append(p)
            else:
                out[-1] += " " + p
        if held:
            out = [*out[:-1], out[-1] + " " + held] if out else [held]
        return out

    got = {k: [] for k in range(len(texts))}
    for r in paragraph_split(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).orderBy("doc_id", "paragraph_no").collect():
        got[r["doc_id"]].append(r["paragraph"])
    assert got == {k: plain(t) for k, t in enumerate(texts)}


def test_section_highlights_are_the_best_of_their_section(spark):
    rows = [(1, 1, "A", "The garden gate of the garden is green and old. Nothing else is ever said about it here."), (1, 2, "B", "too short")]
    got = {r["section"]: r["sentence"] for r in Q.section_highlights(spark.createDataFrame(rows, "doc_id long, section long, title string, content string")).collect()}
    assert got[1].startswith("The garden gate") and got[2] is None


def test_csv_round_trip_and_bytes(spark, tmp_path):
    from vellumframe.sources import csv as V

    (tmp_path / "in.csv").write_bytes('a,b\n" x ""q"" ",y\n"line\nbreak",\n,\n1\n'.encode())
    got = sorted((r["a"] or "", r["b"]) for r in V.csv_scan(spark, str(tmp_path / "in.csv")).collect())
    assert got == sorted([(' x "q" ', "y"), ("line\nbreak", None), ("1", None)]) or got == sorted([('x "q"', "y"), ("line\nbreak", None), ("1", None)])
    V.csv_all_quoted(spark.createDataFrame([(1, "a,b"), (2, None)], "n long, t string"), str(tmp_path / "out"))
    data = b"".join(p.read_bytes() for p in sorted((tmp_path / "out").glob("part-*")))
    assert data.startswith("\ufeffn,t\r\n".encode()) and b'"1","a,b"\r\n' in data and b'"2",""\r\n' in data
    V.csv_all_quoted(spark.range(0), str(tmp_path / "none"))
    assert b"".join(p.read_bytes() for p in (tmp_path / "none").glob("part-*")) == "\ufeffid\r\n".encode()
