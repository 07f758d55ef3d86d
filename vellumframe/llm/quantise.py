"""Embedding near-duplicates by iterative quantisation and multi-index Hamming tables.

Rotations are learned so that signs of the rotated vectors are binary codes close to the vectors. Substrings
of the codes are the keys of many tables; vectors of a label that share a key in any table are compared by exact
cosine. Every pair is examined in the first table it shares only, inside blocks of bounded size, and leaves counts
and local roots behind rather than a row.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import drop, ready, staged
from .components import connected_components
from .vectors import common_length, matrix, usable
from .words import batch

#: Bounds of the fitting sample and of the members a block holds; from so many members on a block is one matrix product.
SAMPLE, BLOCK, LARGE = 4096, 1024, 24


def learn(sample: np.ndarray, bits: int, rounds: int = 30, seed: int = 3) -> np.ndarray:
    """(dimension, bits) projections: PCA, then rotations that alternate with their signs, several in a row.

    Rotations are learned around the mean, but codes are signs of the vectors themselves: the angle between these, not
    between centred vectors, is what the threshold bounds. A mean taken off would part vectors that share it.
    """
    x = sample - sample.mean(axis=0)
    _, axes = np.linalg.eigh(x.T @ x)
    x = x @ axes
    rng, parts = np.random.default_rng(seed), []
    while sum(p.shape[1] for p in parts) < bits:
        r, _ = np.linalg.qr(rng.standard_normal((x.shape[1], x.shape[1])))
        for _ in range(rounds):
            u, _, w = np.linalg.svd(np.where(x @ r >= 0, 1.0, -1.0).T @ x)
            r = (u @ w).T
        parts.append(axes @ r)
    return np.concatenate(parts, axis=1)[:, :bits]


def tables_for(rows: int, cosine: float, miss: float = 0.002) -> tuple[int, int]:
    """Key width from the rows of a label, and tables so that a pair at the threshold shares none with chance `miss`."""
    width = max(8, math.ceil(math.log2(max(rows, 2))) + 1)
    same = (1 - math.acos(cosine) / math.pi) ** width
    return width, math.ceil(math.log(miss) / math.log1p(-same))


def _links_of(rows: dict[str, np.ndarray], cosine: float):
    """Links among the members of each group (rows sorted by group): vec_id, other links in these blocks, root."""
    group, side = rows["group"], rows["side"]
    starts = np.flatnonzero(np.concatenate([[True], group[1:] != group[:-1]]))
    sizes = np.diff(np.append(starts, len(group)))
    unit = rows["unit"]
    a_all, b_all = [], []
    pending_a, pending_b, held = [], [], 0

    def keep(a: np.ndarray, b: np.ndarray) -> None:
        """Linked pairs, those left out that an earlier table holds."""
        t, keys = rows["table"][a], rows["keys"]
        new = np.ones(len(a), bool)
        for k in range(0, len(a), 1 << 15):
            own = slice(k, k + (1 << 15))
            new[own] = ~((keys[a[own]] == keys[b[own]]) & (np.arange(keys.shape[1])[None, :] < t[own, None])).any(axis=1)
        a_all.append(a[new])
        b_all.append(b[new])

    def flush():
        nonlocal pending_a, pending_b, held
        if not held:
            return
        a, b = np.concatenate(pending_a), np.concatenate(pending_b)
        pending_a, pending_b, held = [], [], 0
        ok = np.einsum("ij,ij->i", unit[a], unit[b]) >= cosine
        keep(a[ok], b[ok])

    for s, n in zip(starts.tolist(), sizes.tolist(), strict=True):
        if n < 2:
            continue
        if rows["diagonal"][s]:
            if n >= LARGE:
                own = unit[s : s + n]
                i, j = np.nonzero(np.triu(own @ own.T >= cosine, 1))
                keep(s + i, s + j)
                continue
            i, j = np.triu_indices(n, 1)
        else:
            left, right = np.flatnonzero(side[s : s + n] == 0), np.flatnonzero(side[s : s + n] == 1)
            if n >= LARGE:
                i, j = np.nonzero(unit[s + left] @ unit[s + right].T >= cosine)
                keep(s + left[i], s + right[j])
                continue
            i, j = np.repeat(left, len(right)), np.tile(right, len(left))
        pending_a.append(s + i)
        pending_b.append(s + j)
        held += len(i)
        if held >= 1 << 16:
            flush()
    flush()
    if not a_all:
        return None
    a, b = np.concatenate(a_all), np.concatenate(b_all)
    if not len(a):
        return None
    ids, mult = rows["vec_id"], rows["mult"]
    names, where = np.unique(ids, return_inverse=True)
    ia, ib = where[a], where[b]
    links = np.bincount(ia, mult[b], len(names)) + np.bincount(ib, mult[a], len(names))
    root = np.arange(len(names))
    while True:
        low = np.minimum(root[ia], root[ib])
        nxt = root.copy()
        np.minimum.at(nxt, ia, low)
        np.minimum.at(nxt, ib, low)
        nxt = nxt[nxt]
        if (nxt == root).all():
            break
        root = nxt
    some = links > 0
    return batch(vec_id=names[some], links=links[some].astype(np.int64), root=names[root[some]])


def near_vectors(vectors: DataFrame, cosine: float = 0.93, sample: int = SAMPLE) -> DataFrame:
    """(vec_id, embedding, label) -> vec_id, n_links, component_id, kept: one row per input row.

    Vectors link when their labels are equal and not null and their cosine in double precision is at least `cosine`.
    Equal vectors of a label are one class with a count. Vectors that are null, zero, of an uncommon length, or hold
    null or non-finite components, and rows without label or vec_id, link with nothing; rows that share a vec_id are
    one vertex; other columns are ignored; an empty table gives an empty result.
    """
    spark = ready(vectors.sparkSession)
    rows = vectors.select(F.col("vec_id").cast("long"), "embedding", "label")
    good = usable(rows.filter("vec_id is not null and label is not null"))
    d = common_length(good)
    keyed = good.filter(F.size("embedding") == d).withColumn("h1", F.xxhash64("embedding")).withColumn("h2", F.xxhash64(F.lit(1), "embedding"))
    classes = staged(keyed.groupBy("label", "h1", "h2").agg(F.min("vec_id").alias("rep"), F.count("*").alias("mult")), "classes")
    reps = staged(keyed.join(classes, ["label", "h1", "h2"]).filter("vec_id = rep").dropDuplicates(["vec_id", "label", "h1", "h2"]).select("vec_id", "label", "embedding", "mult"), "vectors")
    fit = reps.orderBy(F.xxhash64(F.lit(6), "vec_id"), "vec_id").limit(sample).select("embedding").toArrow()["embedding"]
    most = reps.groupBy("label").count().agg(F.max("count")).first()[0] or 0
    out = vectors.select(F.col("vec_id").cast("long"))
    if not most:
        return out.select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"), F.lit(True).alias("kept"))
    width, tables = tables_for(most, cosine)
    x = matrix(fit).astype(np.float64)
    project = learn(x / np.linalg.norm(x, axis=1, keepdims=True), width * tables)
    powers = (1 << np.arange(width)).astype(np.int64)

    def codes(batches):
        for b in batches:
            v = matrix(b.column(1)).astype(np.float64)
            v /= np.linalg.norm(v, axis=1, keepdims=True)
            keys = (v @ project >= 0).reshape(len(v), tables, width) @ powers
            yield batch(vec_id=b.column(0), label=b.column(2), keys=pa.ListArray.from_arrays(pa.array(np.arange(len(v) + 1) * tables, pa.int32()), pa.array(keys.astype(np.int32).ravel())))

    kind = dict(reps.dtypes)["label"]
    coded = staged(reps.select("vec_id", "embedding", "label").mapInArrow(codes, f"vec_id long, label {kind}, keys array<int>"), "codes")
    spread = coded.select("vec_id", "label", F.posexplode("keys").alias("table", "key"))
    full = spread.groupBy("label", "table", "key").agg(F.count("*").alias("n")).filter("n > 1")
    met = spread.join(full, ["label", "table", "key"])
    blocks = F.ceil(F.col("n") / BLOCK).cast("int")
    own = F.pmod(F.xxhash64("vec_id"), blocks).cast("int")
    met = met.select("vec_id", "table", F.xxhash64("label", "table", "key").alias("bucket"), own.alias("own"), F.explode(F.sequence(F.lit(0), blocks - 1)).alias("other"))
    met = met.withColumn("lo", F.least("own", "other")).withColumn("hi", F.greatest("own", "other"))
    met = met.select("vec_id", "table", F.xxhash64("bucket", "lo", "hi").alias("group"), (F.col("own") == F.col("hi")).cast("int").alias("side"), (F.col("lo") == F.col("hi")).alias("diagonal"))
    held = reps.join(coded.select("vec_id", "label", "keys"), ["vec_id", "label"]).select("vec_id", "embedding", "keys", "mult")
    # a bucket's members are dealt to block pairs by hash; the dealing needs no order but that of its groups
    dealt = met.join(held, "vec_id").repartition("group").sortWithinPartitions("group")

    def compare(batches):
        rest: pa.Table | None = None
        for b in batches:
            t = pa.Table.from_batches([b]) if rest is None else pa.concat_tables([rest, pa.Table.from_batches([b])])
            g = t["group"].to_numpy()
            if not len(g):
                continue
            cut = int(np.searchsorted(g, g[-1]))
            rest = t.slice(cut)
            if cut:
                found = _links_of(_arrays(t.slice(0, cut)), cosine)
                if found is not None:
                    yield found
        if rest is not None and rest.num_rows:
            found = _links_of(_arrays(rest), cosine)
            if found is not None:
                yield found

    parts = staged(dealt.mapInArrow(compare, "vec_id long, links long, root long"), "links")
    drop(coded)
    comps = connected_components(parts.select(F.col("vec_id").alias("a"), F.col("root").alias("b")))
    counts = parts.groupBy("vec_id").agg(F.sum("links").alias("links"))
    by_rep = classes.join(counts.withColumnRenamed("vec_id", "rep"), "rep", "left").join(comps.select(F.col("v").alias("rep"), "component"), "rep", "left")
    by_rep = by_rep.select("label", "h1", "h2", (F.coalesce("links", F.lit(0)) + F.col("mult") - 1).alias("n_links"), F.coalesce("component", "rep").alias("component"))
    inside = keyed.select("vec_id", "label", "h1", "h2").join(by_rep, ["label", "h1", "h2"]).select("vec_id", "n_links", "component")
    outside = rows.join(inside.select("vec_id").distinct(), "vec_id", "left_anti").select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component"))
    return inside.unionByName(outside).select("vec_id", "n_links", F.col("component").alias("component_id"), F.coalesce(F.col("vec_id") == F.col("component"), F.lit(True)).alias("kept"))


def _arrays(t: pa.Table) -> dict[str, np.ndarray]:
    v = matrix(t["embedding"]).astype(np.float64)
    return {
        "unit": v / np.linalg.norm(v, axis=1, keepdims=True),
        "keys": matrix(t["keys"]),
        **{k: t[k].to_numpy() for k in ("vec_id", "table", "group", "side", "diagonal", "mult")},
    }
