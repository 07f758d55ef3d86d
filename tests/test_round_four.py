"""Findings of round three: what fails without the change that answers it."""

from pyspark.sql import functions as F

from vellumframe.operators import classes as C
from vellumframe.operators import extraction as X
from vellumframe.operators import layout as L
from vellumframe.plans import QUERIES
from vellumframe.sources import pages as G


def plan(df) -> str:
    """The plan that ran, after its adaptive changes."""
    df.collect()
    return df._jdf.queryExecution().executedPlan().toString()


def test_cells_are_not_broadcast(spark):
    """cells dealt to tiles are many times what Spark reckons, so they may not go through the driver."""
    pages = spark.range(40).withColumnRenamed("id", "page").repartition(4).distinct()
    k = F.col("cell")
    grid = pages.withColumn("cell", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(11).cast("long"))))
    grid = grid.select("page", "cell", (k % 3 * 180.0).alias("left"), (F.floor(k / 3) * 56.0).alias("top"), (k % 3 * 180.0 + 180).alias("right"), (F.floor(k / 3) * 56.0 + 56).alias("bottom"))
    words = pages.select("page", F.lit("w").alias("text"), F.lit(10.0).alias("x"), F.lit(10.0).alias("y"), F.lit(5.0).alias("width"), F.lit(5.0).alias("height"), F.lit(50.0).alias("confidence"))
    out = L.cells_from_grid(grid, words, "page")
    assert out.filter("text = 'w' and confidence = 50").count() == 40
    assert "SortMergeJoin [page" in plan(out) and "_tx" in plan(out).split("SortMergeJoin")[1]
    assert not any("_tx" in line for line in plan(out).splitlines() if "BroadcastHashJoin" in line)


def test_entities_are_found_without_a_shuffle(spark):
    """a text's matches are put in order in its own row, and are those of its lines."""
    text = "Between Alpha Co and Beta Ltd, on 5 March 2024 and 2024-01-02\nTotal USD 5, usd 5 and 0.00 USD\nVendor: Blue Sky Inc.\nBETWEEN alpha co AND Gamma LLC.\nPay within 3 days, 2024-01-02\nInvoice No: AB-12"
    docs = spark.createDataFrame([(1, text), (2, None), (3, ""), (4, "Nothing"), (5, text.lower())], "doc_id long, text string")
    key = lambda r: tuple(map(str, r))
    got, want = X.extract_texts(docs, X.ENTITIES), X.extract(X.lines(docs), X.ENTITIES)
    assert sorted(map(tuple, got.collect()), key=key) == sorted(map(tuple, want.collect()), key=key)
    assert {r["value"] for r in got.filter("doc_id = 1 and kind = 'amount'").collect()} == {"USD 5"}
    assert "Exchange" not in plan(X.extract_all(docs))


def test_a_capital_is_one_letter(spark):
    """a word that starts with ß."""
    docs = spark.createDataFrame([(1, "Chung ßst."), (2, "Ring ﬁst.")], "doc_id long, text string")
    tags = {r["doc_id"]: r["tags"] for r in C.tags(docs).collect()}
    assert "Chung ẞst." in tags[1] and "Ring ﬁst." in tags[2]


def test_words_of_a_text_are_not_shuffled(spark):
    """A text is dealt once; its words are counted and ranked where it lies."""
    docs = spark.createDataFrame([(k, "alpha beta beta gamma alpha beta") for k in range(20)], "doc_id long, text string")
    out = G.keywords(docs, 2)
    assert [(r["word"], r["n"], r["rank"]) for r in out.filter("doc_id = 3").orderBy("rank").collect()] == [("beta", 3, 1), ("alpha", 2, 2)]
    assert plan(out).split("== Initial Plan ==")[-1].count("Exchange ") == 1


def test_lines_of_clauses_are_not_shuffled(spark):
    """orders are dealt by key, and the lines made of them stay where they are."""
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "7")
    try:
        out = plan(QUERIES["extract_clauses"](spark, "/root/testdata/sf0.001")).split("== Initial Plan ==")[-1]
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
    assert out.count("Exchange ") == 1 and "hashpartitioning(o_orderkey" in out
    assert ", 7)" in out.split("hashpartitioning(o_orderkey")[1].splitlines()[0]
