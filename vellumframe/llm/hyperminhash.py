"""MinHash near-duplicates by HyperMinHash registers.

Every document's distinct word shingles fall into buckets; a bucket keeps the leading-zero count and the next
mantissa bits of its smallest value in 16 bits. Groups of buckets are banded by the values before they are cut to 16
bits, where a bucket without one borrows that of another, so that a band of a short text speaks of as many values as one
of a long text and texts that share a shingle or two do not meet. Candidates pass a collision-corrected Jaccard estimate
before the full shingle sets confirm them.
"""

from __future__ import annotations

import functools
import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import drop, ready, staged
from .components import connected_components
from .words import Words, batch, binary, mix, pieces, shingle_sets

ROWS = 6
MANTISSA = 10
EMPTY = 0xFFFF
NOTHING = np.iinfo(np.int64).max
PARITY = 32  # 64-bit words of a set's parity sketch
#: Members of a pivot that are paired in one group, and parts a pivot's rows are dealt to before that.
BLOCK, SALT = 512, 32


def bands_for(threshold: float, miss: float = 1e-6) -> int:
    """Bands of ROWS registers so that a pair at the threshold shares none with at most the given chance."""
    return math.ceil(math.log(miss) / math.log1p(-(threshold**ROWS)))


def minima(sets: list[np.ndarray], k: int) -> np.ndarray:
    """(documents, k) int64: each bucket's smallest value, NOTHING without one."""
    sizes = np.array([len(s) for s in sets], np.int64)
    flat = np.concatenate(sets) if sets else np.zeros(0, np.uint64)
    cell = np.repeat(np.arange(len(sets)), sizes) * k + (flat % np.uint64(k)).astype(np.int64)
    value = mix(flat ^ np.uint64(0xD6E8FEB86659FD93)) >> np.uint64(1)
    least = np.full(len(sets) * k, NOTHING, np.int64)
    np.minimum.at(least, cell, np.minimum(value.astype(np.int64), NOTHING - 1))
    return least.reshape(len(sets), k)


def registers(sets: list[np.ndarray], k: int) -> np.ndarray:
    """(documents, k) uint16: leading zeros above MANTISSA bits of each bucket's smallest value, EMPTY without one."""
    return compressed(minima(sets, k))


def compressed(least: np.ndarray) -> np.ndarray:
    """The registers of minima."""
    part, exponent = np.frexp(np.maximum(least, 1).astype(np.float64))
    zeros = np.clip(63 - exponent, 0, 62)
    out = ((zeros.astype(np.int64) << MANTISSA) | np.minimum(((part - 0.5) * 2 * (1 << MANTISSA)).astype(np.int64), (1 << MANTISSA) - 1)).astype(np.uint16)
    out[least == NOTHING] = EMPTY
    return out


@functools.cache
def donors(k: int) -> np.ndarray:
    """(k, k): the buckets that each bucket asks for a value where it has none, in its own fixed order."""
    return np.argsort(mix(np.arange(k * k, dtype=np.uint64) + np.uint64(1 << 40)).reshape(k, k), axis=1, kind="stable")


def band_keys(least: np.ndarray) -> np.ndarray:
    """(documents, bands) int64: a hash of each band's ROWS values. A bucket without a value takes that of the first of
    its donors with one, which is the same bucket for two sets as often as they share their values."""
    k = least.shape[1]
    full, free = least.copy(), least == NOTHING
    row, at = np.nonzero(free & ~free.all(axis=1)[:, None])
    order = donors(k)
    for step in range(k):
        if not len(row):
            break
        donor = order[at, step]
        has = ~free[row, donor]
        full[row[has], at[has]] = least[row[has], donor[has]]
        row, at = row[~has], at[~has]
    bands = full.astype(np.uint64).reshape(len(least), -1, ROWS)
    key = np.tile(np.arange(1, bands.shape[1] + 1, dtype=np.uint64), (len(least), 1))
    for j in range(ROWS):
        key = mix(key + bands[:, :, j])
    return key.view(np.int64)


def parity(sets: list[np.ndarray]) -> pa.Array:
    """Parity sketches, PARITY longs a set: every element flips one bit, so two sketches differ in no more bits than
    their sets have elements apart - a bound that never rules out a link."""
    out = np.zeros((len(sets), PARITY * 64), np.uint8)
    for row, s in zip(out, sets, strict=True):
        row[:] = np.bincount((s >> np.uint64(40)).astype(np.int64) % (PARITY * 64), minlength=PARITY * 64) & 1
    longs = np.packbits(out, axis=1, bitorder="little").view(np.int64).ravel()
    return pa.ListArray.from_arrays(pa.array(np.arange(len(sets) + 1) * PARITY, pa.int32()), pa.array(longs))


def estimate(a: np.ndarray, b: np.ndarray, na: np.ndarray, nb: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Jaccard estimate per row without the expected chance collisions of compressed registers, and its buckets in use."""
    k = a.shape[1]
    used = ((a != EMPTY) | (b != EMPTY)).sum(axis=1)
    same = ((a == b) & (a != EMPTY)).sum(axis=1)
    lz = np.arange(48)
    hi, lo = 2.0 ** -lz, 2.0 ** -(lz + 1.0)

    def falls(n: np.ndarray) -> np.ndarray:
        m = np.maximum(n[:, None] / k, 1e-9)
        return (1 - lo) ** m - np.where(hi >= 1, 0.0, (1 - hi) ** m)

    chance = (falls(na) * falls(nb)).sum(axis=1) / (1 << MANTISSA)
    share = same / np.maximum(used, 1)
    return np.clip((share - chance) / (1 - chance), 0, 1), used


def sketch(docs: DataFrame, shingle: int, k: int) -> DataFrame:
    """(doc_id, text) -> doc_id, n_shingles, two 64-bit digests of the set, the registers, the parity sketch and the keys of
    the bands."""

    def run(batches):
        for b in pieces(batches):
            sets = shingle_sets(Words(b.column(1)), shingle)
            least = minima(sets, k)
            yield batch(
                doc_id=b.column(0),
                n_shingles=np.array([len(s) for s in sets], np.int64),
                h1=np.array([s.sum(dtype=np.uint64) for s in sets], np.uint64).view(np.int64),
                h2=np.array([mix(s + np.uint64(77)).sum(dtype=np.uint64) for s in sets], np.uint64).view(np.int64),
                registers=binary(list(compressed(least))),
                parity=parity(sets),
                keys=pa.ListArray.from_arrays(pa.array(np.arange(len(sets) + 1) * (k // ROWS), pa.int32()), pa.array(band_keys(least).ravel())),
            )

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, n_shingles long, h1 long, h2 long, registers binary, parity array<long>, keys array<long>")


def _likely(pairs: DataFrame, reps: DataFrame, k: int, threshold: float) -> DataFrame:
    """Pairs (a, b) whose register estimate is not more than five standard errors below the threshold."""
    side = lambda x: reps.select(F.col("doc_id").alias(x), F.col("n_shingles").alias(f"n{x}"), F.col("registers").alias(f"r{x}"))

    def run(batches):
        for b in batches:
            if not b.num_rows:
                continue
            ra, rb = (np.frombuffer(b"".join(b.column(c).to_pylist()), np.uint16).reshape(-1, k) for c in ("ra", "rb"))
            j, used = estimate(ra, rb, b.column("na").to_numpy().astype(float), b.column("nb").to_numpy().astype(float))
            keep = j >= threshold - 5 * np.sqrt(threshold * (1 - threshold) / np.maximum(used, 1)) - 0.01
            t = b.select(["a", "b"]).filter(pa.array(keep))
            if t.num_rows:
                yield t

    return pairs.join(side("a"), "a").join(side("b"), "b").select("a", "b", "na", "nb", "ra", "rb").mapInArrow(run, "a long, b long")


def _verified(pairs: DataFrame, docs: DataFrame, shingle: int, percent: int) -> DataFrame:
    """Pairs whose full shingle sets have 100 * intersection >= percent * union."""

    def sets_of(batches):
        for b in pieces(batches):
            yield batch(doc_id=b.column(0), shingles=binary(shingle_sets(Words(b.column(1)), shingle)))

    ids = pairs.select(F.explode(F.array("a", "b")).alias("doc_id")).distinct()
    sets = staged(docs.select("doc_id", "text").join(ids, "doc_id", "left_semi").mapInArrow(sets_of, "doc_id long, shingles binary"), "shingles")

    def run(batches):
        for b in batches:
            keep = []
            for x, y in zip(b.column("sa"), b.column("sb"), strict=True):
                p, q = (np.frombuffer(s.as_buffer(), np.uint64) for s in (x, y))
                both = len(np.intersect1d(p, q, assume_unique=True))
                keep.append(100 * both >= percent * (len(p) + len(q) - both))
            t = b.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))
            if t.num_rows:
                yield t

    side = lambda x: sets.select(F.col("doc_id").alias(x), F.col("shingles").alias(f"s{x}"))
    out = staged(pairs.join(side("a"), "a").join(side("b"), "b").select("a", "b", "sa", "sb").mapInArrow(run, "a long, b long"), "links")
    drop(sets)
    return out


def _across(side: DataFrame, parity: DataFrame, percent: int, near) -> DataFrame:
    """Pairs (a, b) of members of different components c that met the same pivot, from (a, b, n, c).

    The members outside a pivot's largest component meet all its members, dealt to blocks so that no group holds more
    than about BLOCK of either; members of one component are not paired with each other.
    """
    groups = side.groupBy("a", "c").agg(F.count("*").alias("m"))
    pivots = groups.groupBy("a").agg(F.max(F.struct("m", "c")).alias("home"), F.sum("m").alias("all")).filter(F.col("all") > F.col("home.m"))
    parts = lambda x: F.ceil(x / BLOCK).cast("int")
    pivots = pivots.select("a", F.col("home.c").alias("home"), parts(F.col("all")).alias("wide"), parts(F.col("all") - F.col("home.m")).alias("deep"), F.explode(F.sequence(F.lit(0), F.lit(SALT - 1))).alias("salt"))
    held = side.withColumn("salt", F.pmod(F.xxhash64(F.lit(3), "b"), F.lit(SALT)).cast("int")).join(pivots, ["a", "salt"]).join(parity, "b").drop("salt")
    held = staged(held, "mixed")
    dealt = lambda seed, n: F.pmod(F.xxhash64(F.lit(seed), "b"), F.col(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    x = held.withColumn("i", dealt(1, "wide")).withColumn("j", every("deep"))
    y = held.filter("c <> home").withColumn("j", dealt(2, "deep")).withColumn("i", every("wide"))
    # few bytes but many comparisons: as many tasks as the session shuffles to, not as few as the bytes suggest
    tasks = int(side.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    x, y = x.repartition(tasks, "a", "i", "j").alias("x"), y.repartition(tasks, "a", "i", "j").alias("y")
    apart = sum((F.bit_count(F.col("x.parity")[i].bitwiseXOR(F.col("y.parity")[i])) for i in range(1, PARITY)), F.bit_count(F.col("x.parity")[0].bitwiseXOR(F.col("y.parity")[0])))
    close = (100 + percent) * apart <= (100 - percent) * (F.col("x.n") + F.col("y.n"))
    once = (F.col("x.c") == F.col("x.home")) | (F.col("x.b") < F.col("y.b"))
    same = (F.col("x.a") == F.col("y.a")) & (F.col("x.i") == F.col("y.i")) & (F.col("x.j") == F.col("y.j"))
    pairs = x.join(y, same & (F.col("x.c") != F.col("y.c")) & once & near(F.col("x.n"), F.col("y.n")) & close)
    out = staged(pairs.select(F.least("x.b", "y.b").alias("a"), F.greatest("x.b", "y.b").alias("b")).distinct(), "across")
    drop(held)
    return out


def near_duplicates(docs: DataFrame, shingle: int = 5, percent: int = 80) -> DataFrame:
    """Groups of near-duplicate documents: one row per input row (doc_id, n_shingles, component_id, kept).

    Two documents are linked when 100 * |A and B| >= percent * |A or B| over their distinct word shingles. Equal sets
    become one class before anything is paired, so a group of copies of any size costs one row a document. In each band
    bucket every class is first compared with the bucket's smallest id; what one round has joined is not paired
    again, and the second round compares, in blocks of bounded size, the members of a pivot that are outside its largest
    component with its members of other components, those whose parity sketches are not already too far apart.

    Defined cases: null or blank texts have n_shingles 0 and are linked with nothing; rows with a null doc_id are
    not linked, have a null component_id and are kept; rows that share a doc_id are one vertex; other columns are
    ignored; an empty table gives an empty result.
    """
    ready(docs.sparkSession)
    threshold = percent / 100
    bands = bands_for(threshold)
    k = bands * ROWS
    sig = staged(sketch(docs, shingle, k), "sketch")
    some = sig.filter("n_shingles > 0 and doc_id is not null")
    classes = some.groupBy("n_shingles", "h1", "h2").agg(F.min("doc_id").alias("rep"))
    reps = staged(some.join(classes, ["n_shingles", "h1", "h2"]).filter("doc_id = rep").dropDuplicates(["doc_id", "n_shingles", "h1", "h2"]).select("doc_id", "n_shingles", "registers", "parity", "keys"), "reps")
    buckets = reps.select("doc_id", F.col("n_shingles").alias("n"), F.explode("keys").alias("key"))
    near = lambda x, y: (100 * F.least(x, y) >= percent * F.greatest(x, y))  # noqa: E731  sizes alone rule the others out

    shared = buckets.groupBy("key").agg(F.min(F.struct("doc_id", "n")).alias("pivot"), F.max("doc_id").alias("last")).filter("pivot.doc_id <> last")
    met = buckets.join(shared.select("key", "pivot"), "key").filter(F.col("doc_id") != F.col("pivot.doc_id"))
    met = staged(met.select(F.col("pivot.doc_id").alias("a"), F.col("doc_id").alias("b"), F.col("pivot.n").alias("na"), F.col("n").alias("nb")).distinct(), "met")
    first = met.filter(near(F.col("na"), F.col("nb"))).select("a", "b")
    links = _verified(staged(_likely(first, reps, k, threshold), "pairs"), docs, shingle, percent)
    found = connected_components(links)

    side = met.join(found.select(F.col("v").alias("b"), "component"), "b", "left").select("a", "b", F.col("nb").alias("n"), F.coalesce("component", "b").alias("c"))
    again = _across(side, reps.select(F.col("doc_id").alias("b"), "parity"), percent, near)
    more = _verified(staged(_likely(again, reps, k, threshold), "pairs"), docs, shingle, percent)
    drop(met)
    whole = connected_components(links.unionByName(more))
    groups = classes.join(whole.select(F.col("v").alias("rep"), "component"), "rep", "left").select("n_shingles", "h1", "h2", F.coalesce("component", "rep").alias("group"))
    out = sig.select("doc_id", "n_shingles", "h1", "h2").join(groups, ["n_shingles", "h1", "h2"], "left")
    own = F.when((F.col("n_shingles") > 0) & F.col("doc_id").isNotNull(), F.coalesce("group", "doc_id")).otherwise(F.col("doc_id"))
    return out.select("doc_id", "n_shingles", own.alias("component_id")).withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)))
