"""Mixing sources to target weights: exact block quotas per output shard from a multivariate-hypergeometric tree.

Each source's documents are put in one pseudo-random order (a digest of seed and doc_id) and cut into blocks of words.
A source whose target is r whole passes and a remainder takes every block r times and the first blocks once more. A
splitting tree over the output shards draws, at every node, how many of each source's blocks go left; every shard
walks its own path from the same seeds, so quotas are exact and blocks disjoint with nothing exchanged. A shard then
shuffles its documents locally.
"""

from __future__ import annotations

import math
import zlib

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import ready, staged

WEIGHTS = (5, 2, 1)
WORD = r"[^\x20\x09-\x0D]+"


def source_targets(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, most: int = 3) -> DataFrame:
    """(source, size) -> source, source_size, target; one row a source.

    Sources by code point, nulls last, weigh `weights` in turn. A target stops at `most` times its source's size and
    the excess is reshared by weight: with sources in order of cap per unit of weight, exactly a first part is capped.
    """
    by = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    order = F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1
    by = by.withColumn("_k", order).withColumn("_w", F.element_at(F.array(*map(F.lit, weights)), (F.col("_k") % len(weights) + 1).cast("int")).cast("double"))
    by = by.withColumn("_cap", (most * F.col("source_size")).cast("double")).withColumn("_r", F.col("_cap") / F.col("_w"))
    w = Window.orderBy("_r", "_k")
    before = F.coalesce(F.sum("_cap").over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0))
    rest = F.sum("_w").over(w.rowsBetween(0, Window.unboundedFollowing))
    everything = F.sum("source_size").over(Window.partitionBy(F.lit(1))).cast("double")
    by = by.withColumn("_level", (everything - before) / rest)
    level = F.min(F.when(F.col("_r") >= F.col("_level"), F.struct("_r", "_k", "_level"))).over(Window.partitionBy(F.lit(1)))
    by = by.withColumn("_at", level.getField("_level"))
    target = F.when(F.col("_at").isNull() | (F.col("_r") < F.col("_at")), F.col("_cap")).otherwise(F.col("_w") * F.col("_at"))
    return by.select("source", "source_size", target.alias("target"))


def shard_blocks(catalogue: list[tuple[int, int, int, int]], shards: int, seed: int, spans: pd.Series) -> pd.DataFrame:
    """Blocks of the given shards: source number, pass, block, shard. catalogue: (number, units, blocks a pass, ...)."""
    units = np.array([c[1] for c in catalogue], np.int64)
    total = int(units.sum())
    upto = lambda i: total * i // shards
    turn = []
    for c in catalogue:  # a bijection of each source's units, so that passes and blocks come in mixed order
        k = max(1, c[1])
        a = zlib.crc32(f"{seed}:{c[0]}:a".encode()) % k or 1
        while math.gcd(a, k) != 1:
            a += 1
        turn.append((a, zlib.crc32(f"{seed}:{c[0]}:b".encode()) % k))
    parts = []
    for shard in spans.tolist():
        lo, hi, at, own = 0, shards, np.zeros(len(units), np.int64), units.copy()
        while hi - lo > 1:
            mid = (lo + hi) // 2
            rng = np.random.default_rng([seed, lo, hi])
            left = rng.multivariate_hypergeometric(own, upto(mid) - upto(lo), method="marginals")
            if shard < mid:
                own, hi = left, mid
            else:
                at, own, lo = at + left, own - left, mid
        for c, (a, b), first, n in zip(catalogue, turn, at.tolist(), own.tolist(), strict=True):
            if n:
                u = (np.arange(first, first + n) * a + b) % c[1]
                parts.append(pd.DataFrame({"_s": c[0], "pass": u // c[2], "block": u % c[2], "shard": shard}))
    return pd.concat(parts, ignore_index=True) if parts else pd.DataFrame({k: np.zeros(0, np.int64) for k in ("_s", "pass", "block", "shard")})


def mix(docs: DataFrame, weights: tuple[int, ...] = WEIGHTS, most: int = 3, seed: int = 11, block_words: int = 1 << 14, shard_units: int = 256) -> tuple[DataFrame, DataFrame]:
    """Mix (doc_id, text, source) to target weights.

    Returns per-document rows (doc_id, source, size, source_size, target, taken) and placements (doc_id, source, pass,
    block, words, shard, position): where each taken copy goes, and its place in the shard's local shuffle.

    Defined cases: null or blank texts have size 0 and are taken 0 times; a null source is a source of its own; rows
    that repeat are rows of their own; rows with null doc_id go by a digest of their text; an empty table
    gives empty results. The last copy that reaches a source's target is cut there, so targets are met to the word.
    Sources are a catalogue of bounded size (a row each on the driver), documents are not.
    """
    spark = ready(docs.sparkSession)
    size = F.coalesce(F.regexp_count("text", F.lit(WORD)), F.lit(0)).cast("long")
    rows = staged(docs.select(F.col("doc_id").cast("long"), "source", size.alias("size"), F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.concat(F.lit("text "), F.md5(F.coalesce("text", F.lit(""))))))).alias("_key")), "sizes")
    targets = staged(source_targets(rows, weights, most), "targets")
    n = rows.count()
    digits = max(1, math.ceil(math.log(max(n, 1) / 500 + 1, 16)))
    rows = rows.withColumn("_b", F.substring("_key", 1, digits))
    sums = rows.groupBy("source", "_b").agg(F.sum("size").alias("_n"))
    before = sums.withColumn("_before", F.sum("_n").over(Window.partitionBy("source").orderBy("_b")) - F.col("_n")).drop("_n")
    names = targets.select("source", "source_size", "target", (F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1).cast("long").alias("_s"))
    words = F.floor(F.col("target") + 0.5).cast("long")
    full = F.when(F.col("source_size") > 0, F.floor(words / F.greatest(F.col("source_size"), F.lit(1)))).otherwise(0).cast("long")
    names = staged(names.withColumn("_full", full).withColumn("_rest", words - F.col("_full") * F.col("source_size")), "sources")
    inside = Window.partitionBy("source", "_b").orderBy("_key", "size").rowsBetween(Window.unboundedPreceding, 0)
    placed = rows.withColumn("_c", F.sum("size").over(inside) - F.col("size"))
    same = placed["source"].eqNullSafe(before["source"]) & (placed["_b"] == before["_b"])
    placed = placed.join(before, same).select(placed["doc_id"], placed["source"], "size", (F.col("_c") + F.col("_before")).alias("_c"), "_key")
    placed = placed.join(names, placed["source"].eqNullSafe(names["source"])).select("doc_id", placed["source"], "size", "source_size", "target", "_s", "_c", "_full", "_rest", "_key")
    part = F.greatest(F.lit(0), F.least(F.col("size"), F.col("_rest") - F.col("_c")))
    placed = placed.withColumn("_part", part)

    listed = [(r["_s"], r["_full"] * -(-r["source_size"] // block_words) + -(-r["_rest"] // block_words), max(1, -(-r["source_size"] // block_words))) for r in names.orderBy("_s").collect()]
    catalogue = [(*r, 0) for r in listed if r[1]]
    units = sum(r[1] for r in catalogue)
    shards = max(1, -(-units // shard_units))

    def draw(frames):
        for f in frames:
            yield shard_blocks(catalogue, shards, seed, f["id"])

    drawn = spark.range(shards if catalogue else 0).mapInPandas(draw, "_s long, pass long, block long, shard long")
    copies = placed.filter("size > 0").withColumn("pass", F.explode(F.sequence(F.lit(0).cast("long"), F.col("_full"))))
    copies = copies.withColumn("words", F.when(F.col("pass") < F.col("_full"), F.col("size")).otherwise(F.col("_part"))).filter("words > 0").withColumn("block", F.floor(F.col("_c") / block_words))
    went = copies.join(drawn, ["_s", "pass", "block"])
    local = F.row_number().over(Window.partitionBy("shard").orderBy(F.xxhash64("shard", "pass", "_key"), "_s", "_c"))
    placements = went.withColumn("position", local - 1)
    taken = went.groupBy("_s", "_c").agg(F.sum("words").alias("taken"))
    rest = placed.filter("size > 0").join(taken, ["_s", "_c"], "left").select("doc_id", "source", "size", "source_size", "target", F.coalesce("taken", F.lit(0)).alias("taken"))
    empty = placed.filter("size = 0").select("doc_id", "source", "size", "source_size", "target", F.lit(0).cast("long").alias("taken"))
    return rest.unionByName(empty), placements.select("doc_id", "source", "pass", "block", "words", "shard", "position")
