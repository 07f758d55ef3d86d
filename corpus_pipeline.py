"""From raw documents to packed training sequences, each stage written as Parquet and read again by the next.

Rows are carried by doc_id. A row without one, and rows that share one but differ in text (all but the one with the
smallest digest), are carried by a digest of their own above 2^62 instead, so that only true copies are taken for
copies. The stages see only what their predecessor kept. Defined cases: null and empty texts are not toxic, have no
language and so go in the second stage; repeated rows count as near copies; very long texts are read whole; columns
beyond those of documents pass through whatever their names; an empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from vellumframe.llm.common import free_name, ready, staged, table
from vellumframe.llm.hyperminhash import near_duplicates
from vellumframe.llm.languages import identify
from vellumframe.llm.mixing import mix
from vellumframe.llm.packing import pack_documents
from vellumframe.llm.toxicity import score

#: Below this mean posterior no language is believed; ordinary texts lie above 0.5.
LEAST_LANGUAGE = 0.3


def _keyed(docs: DataFrame) -> tuple[DataFrame, str]:
    """docs with a column that names a document: equal for rows with equal doc_id and text only; and that column's name."""
    key = free_name(docs.columns, "_key")
    digest = F.xxhash64(F.coalesce("text", F.lit("")))
    own = F.shiftrightunsigned(F.xxhash64("doc_id", "text"), 2) + F.lit(1 << 62)
    several = docs.groupBy(F.col("doc_id").alias(f"{key}id")).agg(F.min(digest).alias(f"{key}first"), F.max(digest).alias(f"{key}last"))
    several = staged(several.filter(F.col(f"{key}id").isNotNull() & (F.col(f"{key}first") != F.col(f"{key}last"))).drop(f"{key}last"), "several")
    doc_id = F.col("doc_id").cast("long")
    if several.isEmpty():
        return docs.withColumn(key, F.coalesce(doc_id, own)), key
    joined = docs.join(several, docs["doc_id"] == several[f"{key}id"], "left")
    return joined.withColumn(key, F.when(digest == F.coalesce(f"{key}first", digest), F.coalesce(doc_id, own)).otherwise(own)).drop(f"{key}id", f"{key}first"), key


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the positive-unlabelled classifier does not predict to be toxic."""
    predicted = free_name(docs.columns, "predicted")
    return score(docs, table(spark, sf_dir, "labels")).filter(F.col(predicted) == 0).select(docs.columns)


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in a recognised language: not `und`, and with a mean posterior of at least LEAST_LANGUAGE."""
    found, sure = (F.col(free_name(docs.columns, c)) for c in ("lang_pred", "score"))
    return identify(docs).filter((found != "und") & (sure >= LEAST_LANGUAGE)).select(docs.columns)


def near_duplicate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document with the smallest doc_id of every near-duplicate group (five-word shingles, similarity 0.8)."""
    keyed, key = _keyed(docs)
    kept = near_duplicates(keyed.select(F.col(key).alias("doc_id"), "text"), shingle=5, percent=80).filter("kept").select(F.col("doc_id").alias(key))
    number = free_name([*docs.columns, key], "_n")
    first = Window.partitionBy(key).orderBy("text", "source", "lang")
    rows = keyed.join(kept, key, "left_semi").withColumn(number, F.row_number().over(first))
    return rows.filter(F.col(number) == 1).select(docs.columns)


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """As many copies of each document as the mix places (0 to 3); the copy that reaches a target stays whole."""
    keyed, key = _keyed(docs)
    _, placed = mix(keyed.select(F.col(key).alias("doc_id"), "text", "source"))
    number = free_name([*docs.columns, key], "_n")
    copies = placed.groupBy(F.col("doc_id").alias(key)).agg(F.count("*").cast("int").alias(number))
    return keyed.join(copies, key).select(*docs.columns, F.explode(F.sequence(F.lit(1), F.col(number))).alias(f"{number}copy")).select(docs.columns)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Places of all pieces of all documents in sequences of 2048 tokens."""
    return pack_documents(docs)


STAGES = [("toxicity", toxicity), ("language", language), ("near_duplicate", near_duplicate), ("mixing", mixing), ("packing", packing)]

#: No SQL: the first two stages are trained models. tests/llm checks the rows against a plain version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Apply all stages to the documents table."""
    docs = table(ready(spark), sf_dir, "documents")
    for name, stage in STAGES:
        docs = staged(stage(spark, docs, sf_dir), f"stage-{name}")
    return docs
