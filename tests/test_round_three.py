"""Rules in numbers, long texts and the rules of single operators, against plain versions."""

import random
import re
from collections import Counter

import pytest
from pyspark.sql import functions as F

from vellumframe.operators import classes as K


def test_a_thousand_rules_are_one_constant(spark):
    rng = random.Random(1)
    word = lambda: "".join(rng.choice("abcdeé") for _ in range(rng.randrange(2, 6)))
    rules = [(f"c{k % 40}", "marker" if k % 3 == 0 else "term", word() if k % 5 else f"{word()} {word()}", 1 + k % 7, k) for k in range(1000)]
    rules += [("c3", "regex", "a[bc]d", 4, 1000), ("x", "regex", "eee$", 9, 1001)]
    texts = [" ".join(rng.choice([str.upper, str.lower])(word()) for _ in range(rng.randrange(120))) for _ in range(60)] + [None, "", "x_ab ab_x ab"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    pack = K.rule_pack(spark.createDataFrame(rules, "category string, kind string, pattern string, weight int, rank int"))
    out = K.apply_rules(docs, pack, 5, "none")
    assert len(out._jdf.queryExecution().analyzed().toString()) < 200_000
    low = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    names = list(dict.fromkeys(r[0] for r in rules))
    for r in out.collect():
        t, points = (texts[r["doc_id"]] or "").translate(low), Counter()
        for category, kind, p, weight, _ in rules:
            p = p if kind == "regex" else re.escape(p.translate(low))
            points[category] += weight * bool(re.search(rf"(?<![A-Za-z0-9_]){p}(?![A-Za-z0-9_])" if kind == "marker" else p, t))
        top = max(points.values())
        assert (r["score"], r["category"]) == (top, next(c for c in names if points[c] == top) if top >= 5 else "none")
    with pytest.raises(ValueError):
        K.rule_pack(spark.createDataFrame(rules, "category string, kind string, pattern string, weight int, rank int"), most=100)
    assert K.apply_rules(docs, [], 5, "none").filter("category <> 'none' or score <> 0").count() == 0


def test_class_filters_do_not_spell_rules_out_again(spark):
    docs = spark.createDataFrame([(1, "invoice no 7, bill to x"), (2, "nothing"), (3, None)], "doc_id long, text string")
    out = K.classify_simple(docs).filter("category = 'INVOICE' and points > 20")
    assert [r["doc_id"] for r in out.collect()] == [1]
    assert out._jdf.queryExecution().optimizedPlan().toString().count("opening balance") <= 8


def test_tags_of_long_texts(spark):
    rng = random.Random(2)
    words = ["".join(rng.choice("abcdefghijkl") for _ in range(6)) for _ in range(20_000)]
    often = ["Zebra"] * 40 + ["yodel"] * 30
    text = " ".join(rng.sample([*words, *often], len(words) + len(often)))
    docs = spark.createDataFrame([(1, text), (2, None), (3, "one two")], "doc_id long, text string")
    got = {r["doc_id"]: r["tags"] for r in K.tags(docs).filter(F.size("tags") > 0).select("doc_id", "tags").collect()}
    assert got[1][-5:][:2] == ["Zebra", "Yodel"] or got[1][:2] == ["Zebra", "Yodel"]
    assert got[2] == ["Reviewed", "Document"] and got[3] == ["One Two", "Reviewed", "Document"]


def test_calendar_entries(spark):
    from vellumframe.operators import extraction as X

    texts = [
        "Standup\nJoin https://acme.zoom.us/j/12?p=1\n2:30 PM – 4:00 PM on 12/05/2024\nVenue: Hall 3\nbring <b>notes</b>",
        "Event: Board review\nmeeting - Second title\n3rd March, 2025 at 12:15 am",
        "https://x.example/a\n2024-02-01\nabc\nLunch plan",
        None,
        "Call at 23:30",
        "Where - Annex\nTeams https://teams.microsoft.com/l/x\n9:05, 10:10 and 11:15",
    ]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r["doc_id"]: r for r in X.extract_event(docs, today=F.lit("2030-01-01")).collect()}
    assert tuple(got[0])[1:8] == ("Standup", "2024-05-12", "14:30", "16:00", False, "Hall 3", "https://acme.zoom.us/j/12?p=1")
    assert got[0]["description"] == "2:30 PM – 4:00 PM on 12/05/2024 Venue: Hall 3 bring notes"
    assert tuple(got[1])[1:] == ("Second title", "2025-03-03", "00:15", "01:15", False, None, None, "")
    assert tuple(got[2])[1:4] == ("Lunch plan", "2024-02-01", None) and got[2]["all_day"]
    assert tuple(got[3])[1:] == ("Scheduled Event", "2030-01-01", None, None, True, None, None, "")
    assert (got[4]["start"], got[4]["end"]) == ("23:30", "00:30")
    assert tuple(got[5])[3:7] == ("09:05", "10:10", False, "Annex")
    bare = X.extract_event(spark.createDataFrame([(1, "x https://meet.google.com/ab")], "doc_id long, text string")).first()
    assert (bare["location"], bare["date"]) == ("Online Meeting", None)


def test_label_ranges_of_one_start(spark):
    from vellumframe.operators import ordering as O

    rows = spark.createDataFrame([("d", p) for p in range(1, 8)], "doc string, pos int")
    for order in ([0, 1], [1, 0]):
        ranges = [("d", 3, "roman-lower", "a", 0, 1), ("d", 3, "letters-upper", None, 27, 2), ("d", 0, "none", "z", 1, 3), ("d", 6, "none", "", 1, 4)]
        df = spark.createDataFrame([ranges[k] for k in order] + ranges[2:], "doc string, start int, style string, prefix string, first int, at int")
        out = O.label_asof(rows, df, "doc", "at").orderBy("pos")
        assert [r["label"] for r in out.collect()] == ["1", "2", "AA", "BB", "CC", "", ""]
    same = O.label_asof(rows, df.filter("start = 6").withColumn("style", F.lit("none")).withColumn("prefix", F.lit("cover")), "doc")
    assert [tuple(r) for r in O.duplicate_labels(same, "doc").collect()] == [("d", "cover", 2)]


def test_record_names_stay_in_their_folder(spark):
    from vellumframe.operators import records as C

    cells = ["../../etc/x", "%2e%2E/..\\y", "", None, "a/b:c*?", ". / z", "ok.PDF", "$1\\2"]
    df = spark.createDataFrame([(k, c) for k, c in enumerate(cells)], "n int, Cell string")
    name = C.record_file_name("{cell}", {"Cell": F.col("Cell")}, F.col("n") + 1)
    got = [r["f"] for r in df.select("n", name.alias("f")).orderBy("n").collect()]
    assert got == ["etc_x.pdf", "y.pdf", "Document_3.pdf", "Document_4.pdf", "a_b_c_.pdf", "z.pdf", "ok.PDF", "$1_2.pdf"]
    merged = C.mail_merge(df.filter("n < 4"), {"A": "Cell", "B": "n"}, "", F.col("n") + 1, "n").collect()
    assert {r["file_name"] for r in merged} == {f"Document_{k}.pdf" for k in range(1, 5)} and sum(r["value"] == "" for r in merged) == 2


def test_replacements_are_literal(spark):
    from vellumframe.sources import pages as G

    df = spark.createDataFrame([("cost of it",)], "t string")
    assert df.select(G.glossary(F.col("t"), [("cost", "$5 \\1"), ("of", "a\\")]).alias("t")).first()["t"] == "$5 \\1 a\\ it"


def test_boxes_by_letters_and_digits(spark):
    from vellumframe.operators import layout as L

    tokens = spark.createDataFrame([("d", p, t, x, y, 20.0, 10.0) for p, t, x, y in [(1, '"INV-77,"', 10.4, 5.0), (1, "of", 50.0, 5.0), (2, "inv77", 30.0, 9.0), (2, "INV", 60.0, 9.0), (2, "--", 0.0, 0.0), (3, "xINV77x", -3.0, 1.0)]], "doc string, page int, text string, x double, y double, width double, height double")
    values = spark.createDataFrame([("d", "a", "INV-77", 2), ("d", "b", "of", 0), ("d", "c", "--", 1), ("d", "e", None, 1), ("x", "a", "INV-77", 0)], "doc string, key string, value string, line_index int")
    page = {(r["doc"], r["key"]): tuple(r)[2:] for r in L.locate_bbox(values, tokens, "doc").collect()}
    every = {(r["doc"], r["key"]): tuple(r)[2:] for r in L.locate_bbox(values, tokens, "doc", "all").collect()}
    assert page["d", "a"] == (1, 10.0, 5.0, 30.0, 17.0, True) and page["d", "b"] == (1, 50.0, 5.0, 70.0, 17.0, True)
    assert every["d", "a"] == (1, -3.0, 1.0, 80.0, 19.0, True)
    assert page["d", "c"] == (1, 72.0, 124.0, 132.0, 142.0, False) and page["d", "e"][3] == 192.0 and not page["x", "a"][-1]


@pytest.mark.parametrize("seed", [1, 2])
def test_running_values_against_a_plain_version(spark, seed):
    from vellumframe.operators.running import along

    rng = random.Random(seed)
    rows = [(rng.choice(["hot", "hot", "a", "b", None]), k, rng.choice([None, 1, 2, 5])) for k in range(300)]
    rng.shuffle(rows)
    df = spark.createDataFrame(rows, "g string, o int, v int")
    out = along(df, ["g"], ["o"], before={"b": F.coalesce("v", F.lit(0)), "pos": F.lit(1)}, last={"l": F.col("v")}, following={"f": F.col("v")}, total={"t": F.lit(1)})
    got = {(r["g"], r["o"]): (r["b"], r["pos"], r["l"], r["f"], r["t"]) for r in out.collect()}
    for g in {r[0] for r in rows}:
        own = sorted((r for r in rows if r[0] == g), key=lambda r: r[1])
        for k, r in enumerate(own):
            up, on = [x[2] for x in own[: k + 1] if x[2] is not None], [x[2] for x in own[k:] if x[2] is not None]
            assert got[g, r[1]] == (sum(x[2] or 0 for x in own[:k]), k, up[-1] if up else None, on[0] if on else None, len(own))
    every = {r["o"]: r["b"] for r in along(df, [], [F.col("o").desc()], before={"b": F.lit(1)}).collect()}
    assert every == {k: 299 - k for k in range(300)}
    assert along(df.limit(0), ["g"], ["o"], before={"b": F.lit(1)}).collect() == []


def test_a_third_of_all_rows_is_spread(spark):
    """The ranges of one group that holds a third of all rows are of about the size of all others."""
    from vellumframe.operators import ordering as O

    df = spark.range(30_000).select(F.when(F.col("id") % 3 == 0, -1).otherwise(F.col("id") % 50).alias("doc"), F.col("id").alias("k"), (F.col("id") % 7).alias("size"))
    out = O.positioned(df, "doc", "k")
    files = [r["n"] for r in out.groupBy(F.spark_partition_id()).agg(F.count("*").alias("n")).collect()]
    assert sum(files) == 30_000 and out.filter("doc = -1").agg(F.max("pos"), F.min("n")).first() == (10_000, 10_000)
    staged = out._jdf.queryExecution().optimizedPlan().toString()
    assert "Window" in staged and "_along_range" in staged.split("windowspecdefinition(")[1].split(",")[0]
    ranges = spark.read.parquet(*sorted(set(p.rsplit("/", 1)[0] for p in out.inputFiles()))).groupBy("_along_range").count().collect()
    sizes = sorted(r["count"] for r in ranges)
    assert len(sizes) > 1 and sizes[-1] <= 2 * sizes[len(sizes) // 2]
    parts = O.split_max_size(out.select("doc", "k", "pos", "n", "size"), "doc", "size", 100).groupBy("doc", "part").agg(F.sum("size").alias("s")).agg(F.max("s")).first()[0]
    assert parts <= 100


def test_natural_order_of_long_numbers(spark):
    from vellumframe.operators import ordering as O

    names = ["f9", "f10", "f0123456789012345", "f123456789012346", "f", "f9a", "F09", "g1", "-1", "f999999999999999999999"]
    df = spark.createDataFrame([(n,) for n in names], "n string")
    got = [r["n"] for r in df.orderBy(O.natural_key(F.col("n")), "n").collect()]
    assert got == ["-1", "f", "F09", "f9", "f9a", "f10", "f0123456789012345", "f123456789012346", "f999999999999999999999", "g1"]


def test_shallowest_bookmark_of_a_page(spark):
    from vellumframe.operators import ordering as O

    marks = spark.createDataFrame([("d", 2, 2, "deep", 1), ("d", 2, 1, "first", 2), ("d", 2, 1, "second", 3), ("d", 5, 3, "too deep", 4), ("d", None, 1, "lost", 5)], "doc string, page int, level int, title string, at int")
    assert [tuple(r) for r in O.bookmark_marks(marks, "doc", "page", "level", "title", "at", 2).collect()] == [("d", 2, 1, "first")]
    df = spark.createDataFrame([("a", 2, 0), ("b", None, 1), ("c", 3, 2)], "s string, pages int, k int")
    assert [(r["s"], r["starts_at"]) for r in O.toc_positions(df, "pages", ["k"]).orderBy("k").collect()] == [("a", 4), ("b", 7), ("c", 8)]


def test_phrases_of_a_large_dictionary(spark):
    from vellumframe.operators import rewriting as W

    rng = random.Random(11)
    word = lambda: "".join(rng.choice("abcAB1_") for _ in range(rng.randrange(1, 4)))
    phrases = {}
    while len(phrases) < 10_000:
        phrases.setdefault(rng.choice([" ", "-", ", "]).join(word() for _ in range(rng.randrange(1, 5))).lower(), f"<{len(phrases)}$1\\2>")
    texts = [rng.choice([" ", "-", ", ", "é"]).join(word() for _ in range(rng.randrange(80))) for _ in range(80)] + [None, "", "a" * 30_000, "-- é --"]
    docs = spark.createDataFrame([(k % 70, t, "x") for k, t in enumerate(texts)], "doc_id long, text string, find string")
    entries = spark.createDataFrame([(f, t, 0) for f, t in phrases.items()] + [(next(iter(phrases)).upper(), "never", 1)], "find string, to string, rank int")
    one = re.compile("(?<![A-Za-z0-9_])(?:" + "|".join(map(re.escape, sorted(phrases, key=len, reverse=True))) + ")(?![A-Za-z0-9_])", re.I)
    want = Counter((k % 70, None if t is None else one.sub(lambda m: phrases[m[0].lower()], t)) for k, t in enumerate(texts))
    assert Counter((r["doc_id"], r["text"]) for r in W.rewrite(docs, entries).collect()) == want
    few = spark.createDataFrame([("a b", "x y"), ("b", "Zed")], "find string, to string")
    shown = spark.createDataFrame([("A B b B a b",)], "text string")
    assert W.rewrite(shown, few, keep_case=True).first()[0] == "X Y zed ZED x y"
    assert W.rewrite(shown, few, match_case=True).first()[0] == "A B Zed B x y"
    assert W.rewrite(shown, few.limit(0)).first()[0] == "A B b B a b"
    with pytest.raises(ValueError):
        W.rewrite(shown, spark.createDataFrame([("c++", "d")], "find string, to string"))


def test_phrases_equal_the_fold_where_they_do_not_meet(spark):
    from vellumframe.operators import rewriting as W
    from vellumframe.sources import pages as G

    docs = spark.createDataFrame([(1, "The cat and the dog. THE END of_it and"), (2, None)], "doc_id long, text string")
    lexicon = [("the", "le"), ("and", "et"), ("dog", "chien")]
    a = W.rewrite(docs, spark.createDataFrame(lexicon, "find string, to string"))
    b = docs.withColumn("text", G.glossary(F.col("text"), lexicon))
    assert sorted(map(tuple, a.collect())) == sorted(map(tuple, b.collect()))


def test_both_guards():
    from vellumframe.operators import rewriting as W
    from vellumframe.operators import sensitive as P

    for p in ("(a{2,})+", "(a+)+", "(a|b)*", ".*x.*", "", " ", "a" * 1001, "(a*){2}"):
        with pytest.raises(ValueError):
            P.safe_pattern(p)
    assert P.safe_pattern("r(ed|ing) a+") and not W.dictionary_pattern_ok("a+") and W.dictionary_pattern_ok(r"r(ed|ing)\d{2}") and not W.dictionary_pattern_ok("(") and not W.dictionary_pattern_ok("x" * 101)
    assert W.checked_rules([("regex", "a+", "b"), ("regex", "ab?", "c"), ("word", "x", "x"), ("word", "", "y")]) == [("literal", "a+", "b"), ("regex", "ab?", "c")]


@pytest.mark.parametrize("block,k,scope", [(2, 1, "enabled"), (3, 3, "loaded"), (4096, 3, "enabled")])
def test_stored_postings_give_the_same_rows(spark, tmp_path, block, k, scope):
    from vellumframe.operators import search as Q

    rng = random.Random(block)
    vocab = [f"term{n}" for n in range(30) for _ in range(30 - n)]
    texts = [" ".join(rng.choice(vocab) for _ in range(rng.randrange(40))) for _ in range(150)] + [None, "", "the of"]
    units = spark.createDataFrame([(n % 50, n, t, n % 4 > 0) for n, t in enumerate(texts)], "doc_id int, part int, text string, ok boolean")
    asked = spark.createDataFrame([(1, "term0 term29 term29"), (2, "term1 term2 term3"), (3, "nothing here"), (4, None), (5, "term28")], "query_id long, query string")
    whole = Q.bm25(units, asked, ["doc_id", "part"], "text", k=k, df_scope=scope, enabled=F.col("ok"))
    Q.write_postings(units, ["doc_id", "part"], "text", str(tmp_path / "p"), df_scope=scope, enabled=F.col("ok"), block=block, buckets=8)
    found = Q.search_postings(spark, str(tmp_path / "p"), asked, ["doc_id", "part"], k=k, buckets=8)
    rows = lambda df: sorted((r["query_id"], r["doc_id"], r["part"], r["score"], r["rank"], r["confidence"]) for r in df.collect())
    assert rows(found) == rows(whole) and len(rows(found)) >= 3
    if block == 2:  # blocks that cannot reach the best score are left out
        import json

        plan = json.dumps(found._jdf.queryExecution().optimizedPlan().toString())
        assert "text#" not in plan and "_kth" in plan


def test_questions_are_one_constant(spark):
    from vellumframe.operators import search as Q

    docs = spark.createDataFrame([(1, "The green garden gate was old. It creaked in the wind all night. Nobody minded the noise.")], "doc_id long, text string")
    asked = spark.createDataFrame([(7, "gate"), (7, "garden"), (7, "zebra"), (8, "zebra")], "query_id long, term string")
    assert [(r["query_id"], round(r["score"], 3), r["rank"]) for r in Q.passage_overlap(docs, asked).collect()] == [(7, 0.667, 1)]
    with pytest.raises(ValueError):
        Q.passage_overlap(docs, asked, most=3)


def test_longest_common_runs_of_any_texts(monkeypatch):
    import time

    from vellumframe.operators import records as C

    def plain(a, b):
        row = [0] * (len(b) + 1)
        for x in a:
            new = [0]
            for j, y in enumerate(b):
                new.append(row[j] + 1 if x == y else max(new[j], row[j + 1]))
            row = new
        return row[-1]

    rng = random.Random(6)
    for kept in (64 << 20, 1):
        monkeypatch.setattr(C, "ROWS_KEPT", kept)
        for _ in range(150):
            a, b = ([rng.choice("abcd") for _ in range(rng.randrange(25))] for _ in range(2))
            got = C.longest_common(a, b)
            assert len(got) == plain(a, b) and all(a[i] == b[j] for i, j in got)
            assert all(x < y and u < v for (x, u), (y, v) in zip(got, got[1:]))
    monkeypatch.setattr(C, "ROWS_KEPT", 64 << 20)
    began = time.time()
    same = ["again"] * 20_000
    assert len(C.longest_common(same, same)) == 20_000
    two = [rng.choice("xy") for _ in range(20_000)]
    assert len(C.longest_common(two, two[::-1])) > 10_000 and time.time() - began < 30


def test_alignments_against_a_table(monkeypatch):
    from vellumframe.operators import records as C

    def value(way, a, b):
        total = 0.0
        for i, j in way:
            s = None if i is None or j is None else 1.0 if not a[i] | b[j] else len(a[i] & b[j]) / len(a[i] | b[j])
            total += -0.15 if s is None else s if s >= 0.3 else -0.2
        assert [i for i, _ in way if i is not None] == list(range(len(a))) and [j for _, j in way if j is not None] == list(range(len(b)))
        return total

    def best(a, b):
        row = [-0.15 * j for j in range(len(b) + 1)]
        for i, x in enumerate(a):
            new = [-0.15 * (i + 1)]
            for j, y in enumerate(b):
                s = 1.0 if not x | y else len(x & y) / len(x | y)
                new.append(max(row[j] + (s if s >= 0.3 else -0.2), row[j + 1] - 0.15, new[j] - 0.15))
            row = new
        return row[-1]

    rng = random.Random(3)
    for dense in (16, 0):
        monkeypatch.setattr(C, "DENSE", dense)
        for _ in range(120):
            a, b = ([{rng.choice("abcdefgh") for _ in range(rng.randrange(5))} for _ in range(rng.randrange(9))] for _ in range(2))
            assert abs(value(C.aligned(a, b, -0.15, 0.3, -0.2), a, b) - best(a, b)) < 1e-9
    monkeypatch.setattr(C, "DENSE", 16)
    pages = [{f"w{rng.randrange(4000)}" for _ in range(60)} | {"the", "of"} for _ in range(1000)]
    other = pages[:300] + [{"new", str(k)} for k in range(40)] + pages[350:]
    way = C.aligned(pages, other, -0.15, 0.3, -0.2)
    assert sum(i is not None and j is not None and pages[i] == other[j] for i, j in way) == 950
    with pytest.raises(ValueError):
        C.aligned(pages[:1], other[:1], -0.05, 0.3, -0.2)


def test_cells_of_any_size(spark):
    from vellumframe.operators import layout as L

    rng = random.Random(9)
    cells = [("p", k, x, y, x + w, y + h) for k, (x, y, w, h) in enumerate([(rng.uniform(-50, 900), rng.uniform(-50, 900), rng.choice([0.0, 5.0, 60.0, 700.0, 9000.0]), rng.choice([0.0, 12.0, 300.0])) for _ in range(60)])]
    cells += [("q", 0, 0.0, 0.0, 10.0, 10.0), ("p", 90, 5.0, 5.0, 1.0, 9.0)]
    words = [("p", f"w{k}", rng.uniform(-60, 1000), rng.uniform(-60, 1000), 4.0, 2.0, rng.choice([None, 50.0, 91.0])) for k in range(400)]
    grid = spark.createDataFrame(cells, "page string, cell int, left double, top double, right double, bottom double")
    df = spark.createDataFrame(words, "page string, text string, x double, y double, width double, height double, confidence double")
    got = {(r["page"], r["cell"]): (r["text"], r["confidence"]) for r in L.cells_from_grid(grid, df, "page").collect()}
    assert len(got) == len(cells)
    for p, c, left, top, right, bottom in cells:
        own = sorted((w[2], w[1], w[6] if w[6] is not None else 80.0) for w in words if w[0] == p and left - 3 <= w[2] + 2 <= right + 3 and top - 3 <= w[3] + 1 <= bottom + 3)
        assert got[p, c] == (" ".join(w[1] for w in own), int(sum(w[2] for w in own) / len(own) + 0.5) if own else 85)


def test_audit_slots_and_totals(spark):
    from vellumframe.operators import records as C

    rows = [(1, "a.pdf", None, 3_000_000, None, None), (2, "b.jpeg", "", 10_000, 413, 531), (3, "c.webp", "image/jpeg", 100_000, 0, 5), (4, "d.bin", "image/png", 300_000, 531, 413), (5, "e.jpg", None, 100_000, None, None)]
    files = spark.createDataFrame(rows, "k int, name string, type string, bytes long, width int, height int")
    out = C.batch_audit(files, {"signature": {"min_kb": 50, "width": 413, "height": 531, "aspect_ratio": "3/4"}, "target": "signature"}, "k")
    got = {r["k"]: (r["slot"], r["failed"], r["passed"], r["fixable"]) for r in out.collect()}
    assert got[1] == ("pdf", ["size"], False, True)
    assert got[2] == ("signature", ["size"], False, False)
    assert got[3] == ("signature", ["format", "dimensions"], False, True)  # a WEBP ending before a JPEG type
    assert got[4] == ("signature", ["format", "size", "dimensions", "aspect_ratio"], False, True)
    assert got[5] == ("signature", ["decoding"], False, False)
    assert C.audit_totals(out).first() == (5, 0, 5, 3, 2)
    assert C.audit_totals(out.limit(0)).first() == (0, 0, 0, 0, 0)


def test_wide_rows_and_delimiters(spark, tmp_path):
    from vellumframe.sources import csv as V

    (tmp_path / "a.csv").write_text('a;b\n1;2;3; 4 \n"x;\ny";z\n;;\n5\n')
    out = V.csv_scan(spark, str(tmp_path / "a.csv"))
    assert out.columns == ["a", "b", "column_3", "column_4"]
    assert sorted(map(tuple, out.collect())) == sorted([("1", "2", "3", "4"), ("x;\ny", "z", None, None), ("5", None, None, None)])


def test_recipe_parameters_by_kind(spark):
    from vellumframe.operators import recipes as Y

    bad = [{"tool": "add", "parameters": {"column": "v", "amount": "x"}}, {"tool": "add", "parameters": {"column": " ", "amount": True}}, {"tool": "redact", "parameters": {"column": "t", "kind": "names"}}, {"tool": "split", "parameters": {"size": 0}}, {"tool": "replace", "parameters": {"column": "t", "find": "a", "whole_word": "maybe"}}, {"tool": 3}]
    errors = Y.recipe_errors(bad, " ")
    assert [e.split(": ", 1)[-1] for e in errors] == ["a recipe needs a name", "amount must be a number", "column cannot be empty", "amount must be a number", "kind has invalid value 'names'", "size cannot be less than 1", "whole_word must be true or false", "unknown tool 3"]
    assert Y.recipe_errors([]) and Y.recipe_errors("x") and not Y.recipe_errors([{"tool": "upper", "parameters": {"column": "t"}}], "n")
    df = spark.createDataFrame([("<b>Mail</b> a@b.org",)], "t string")
    steps = [{"tool": "page_text", "parameters": {"column": "t"}}, {"tool": "redact", "parameters": {"column": "t", "kind": "email"}}, {"tool": "guard", "parameters": {"column": "t", "policy": "strict"}}, {"tool": "classify", "parameters": {"column": "t"}}]
    got = Y.run_recipe(df, steps).first()
    assert got["t"].strip() == "Mail" and got["category"] == "UNKNOWN" and got["failed_step"] is None
