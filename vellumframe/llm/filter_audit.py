"""Filter interaction audit: what each of several filters removes in every order in which they can be applied.

Documents are reduced to failure masks; counts by part and mask say everything about any order. A walk in Gray code
order over the subsets of filters toggles one filter at a time and keeps, for every mask, how many active filters it
fails, and the running number of survivors; the survivors of all subsets are stored, and every step of every order is
the difference of two of them.
"""

from __future__ import annotations

from itertools import permutations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import ready, staged

FILTERS = "ABCDE"
WHITE = r"[\x20\x09-\x0D]+"


def text_failures(text: Column) -> list[Column]:
    """Failure of A to D: few words, few distinct words, many capitals, odd characters."""
    words = F.array_remove(F.split(text, WHITE), "")
    n, capitals = F.size(words), F.length(F.regexp_replace(text, "[^A-Z]+", ""))
    return [n < 50, 100 * F.size(F.array_distinct(words)) < 65 * n, 100 * capitals > 5 * F.length(text), text.rlike(r"[#$%&*|]")]


def failure_masks(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """part, mask, n, good, toxic: documents by failure mask (bit k: the k-th of FILTERS), with those labelled.

    The texts are read once: their digests and masks are stored. Copies are told by digest; the first of a group is the
    smallest doc_id there, found by a minimum a digest and met again by an equi-join on digest and doc_id together, so
    that a group of copies is never dealt to one task.
    """
    text = F.coalesce("text", F.lit(""))
    mask = sum((F.when(f, F.lit(1 << k)).otherwise(0) for k, f in enumerate(text_failures(F.col("_t")))), F.lit(0))
    # a digest for each text, a tenth of a document's bytes at most
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("source").cast("string"), F.lit("")).alias("part"), text.alias("_t"))
    rows = staged(rows.select("doc_id", "part", F.unhex(F.sha2("_t", 256)).alias("digest"), mask.cast("int").alias("mask")), "masks")
    firsts = rows.groupBy("digest").agg(F.min("doc_id").alias("first"))
    known = labels.select(F.col("doc_id").cast("long").alias("id"), (F.col("quality") == 1).cast("long").alias("good"), (F.col("toxic") == 1).cast("long").alias("toxic"))
    known = known.filter("id is not null and (good = 1 or toxic = 1)").groupBy("id").agg(F.max(F.coalesce("good", F.lit(0))).alias("good"), F.max(F.coalesce("toxic", F.lit(0))).alias("toxic"))
    r, f = rows.alias("r"), firsts.select(F.col("digest").alias("d"), "first", F.lit(True).alias("is_first"))
    told = r.join(f, (F.col("r.digest") == F.col("d")) & F.col("r.doc_id").eqNullSafe(F.col("first")), "left")
    told = told.join(known, F.col("r.doc_id") == F.col("id"), "left")
    last = 1 << len(FILTERS) - 1
    whole = F.col("mask") + F.when(F.col("is_first"), 0).otherwise(last)
    count = lambda c: F.sum(F.coalesce(c, F.lit(0))).alias(c)
    return told.groupBy("part", whole.alias("mask")).agg(F.count("*").alias("n"), count("good"), count("toxic"))


def survivors(cells: np.ndarray) -> np.ndarray:
    """cells (parts, masks, counts) -> what passes every filter of a subset (parts, subsets, counts), by a Gray-code walk."""
    parts, masks, kinds = cells.shape
    out = np.zeros((parts, masks, kinds), np.int64)
    failing = np.zeros(masks, np.int64)  # active filters that a mask fails
    running, subset = cells.sum(axis=1), 0
    out[:, 0] = running
    for step in range(1, masks):
        bit = step & -step  # the filter that the next Gray code toggles
        subset ^= bit
        touched = np.flatnonzero(np.arange(masks) & bit)
        if subset & bit:
            gone = touched[failing[touched] == 0]
            failing[touched] += 1
            running = running - cells[:, gone].sum(axis=1)
        else:
            failing[touched] -= 1
            back = touched[failing[touched] == 0]
            running = running + cells[:, back].sum(axis=1)
        out[:, subset] = running
    return out


def report(cells: np.ndarray, filters: str = FILTERS) -> dict[str, np.ndarray]:
    """Per part, order and step (parts, orders * steps): the audit's counts, by differences of survivors."""
    left = survivors(cells)
    k = len(filters)
    orders = list(permutations(range(k)))
    before = np.array([[sum(1 << f for f in o[:s]) for s in range(k)] for o in orders]).ravel()
    bit = np.array([[1 << f for f in o] for o in orders]).ravel()
    gone = left[:, before] - left[:, before | bit]
    everything = (1 << k) - 1
    alone = left[:, [everything ^ 1 << f for f in range(k)], 0] - left[:, [everything], 0]
    failed = left[:, [0], 0] - left[:, [1 << f for f in range(k)], 0]
    own = np.array(orders).ravel()
    total = np.stack([gone[:, own == f, 0].sum(axis=1) for f in range(k)], axis=1)
    return {
        "kept": left[:, before | bit, 0], "removed": gone[:, :, 0], "redundant": failed[:, own] - gone[:, :, 0], "unique_fails": alone[:, own],
        "good_lost": gone[:, :, 1], "toxic_lost": gone[:, :, 2], "shapley": total[:, own],
    }


COUNTS = ["kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley"]


def audit(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """part, filter_order, step and the counts of COUNTS: one row a part, order of FILTERS and step.

    docs: doc_id, text, source; labels: doc_id, quality, toxic. Defined cases: a null text is an empty one, and copies of
    it are copies; a null source is the part of the empty string; a null doc_id comes after all others, so it fails E
    where a text has a numbered copy; rows that repeat with one doc_id are not copies of each other; labels given twice
    count where one of them does; other columns are not looked at; an empty table gives an empty result.
    """
    ready(docs.sparkSession)
    cells = failure_masks(docs, labels)
    per = cells.groupBy("part").agg(F.collect_list(F.struct("mask", "n", "good", "toxic")).alias("cells"))  # at most 32 a part
    orders = ["".join(o) for o in permutations(FILTERS)]
    steps = len(FILTERS)

    def run(batches):
        for whole in batches:
            for at in range(0, whole.num_rows, 64):
                b = whole.slice(at, 64)
                counts = np.zeros((b.num_rows, 1 << steps, 3), np.int64)
                for i, found in enumerate(b.column(1).to_pylist()):
                    for c in found:
                        counts[i, c["mask"]] = c["n"], c["good"], c["toxic"]
                rows = len(orders) * steps
                got = report(counts)
                names = b.column(0).take(pa.array(np.repeat(np.arange(b.num_rows), rows)))
                order = pa.array(np.repeat(orders, steps).tolist() * b.num_rows)
                step = pa.array(np.tile(np.arange(1, steps + 1), b.num_rows * len(orders)), pa.int32())
                yield pa.RecordBatch.from_arrays([names, order, step, *(pa.array(got[c].ravel()) for c in COUNTS)], names=["part", "filter_order", "step", *COUNTS])

    return per.mapInArrow(run, "part string, filter_order string, step int, " + ", ".join(f"{c} long" for c in COUNTS))
