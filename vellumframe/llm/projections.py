"""Nearest neighbours through low-dimensional stable projections in kd-trees.

Vectors are projected by Gaussian (2-stable) directions to a few dimensions. The upper part of one kd-tree, built on a
bounded sample, parts all rows into regions; every region gets the rest of its tree where it is searched. A query
verifies rows by exact inner product in order of projected distance, leaf by leaf, until a chi-square test says that no
row further away in the projection is likely to be nearer. It starts in its own region and carries the distance found
there to the regions that the test does not rule out. Largest inner products become smallest distances by centring the
rows, one added coordinate and queries scaled to the longest row.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import ready, staged
from .vectors import common_length, matrix, usable
from .words import batch

DIMENSIONS, LEAF = 24, 32
#: Rows a region's part holds, queries searched in it at once, and rows of the sample that the regions are cut from.
BLOCK, CHUNK, SAMPLE = 8192, 8192, 65_536
NOBODY = -(1 << 63)


def chi_square(p: float, m: int) -> float:
    """Quantile of the chi-square distribution with an even number m of degrees of freedom."""
    lo, hi = 0.0, 100.0 + 10 * m
    for _ in range(100):
        x = (lo + hi) / 2
        term, total = 1.0, 0.0
        for k in range(m // 2):
            total += term
            term *= x / 2 / (k + 1)
        lo, hi = (x, hi) if 1 - math.exp(-x / 2) * total < p else (lo, x)
    return hi


def kd_leaves(points: np.ndarray, leaf: int = LEAF) -> list[np.ndarray]:
    """Index arrays of the leaves of a kd-tree that halves at the median of the widest dimension."""
    todo, out = [np.arange(len(points))], []
    while todo:
        idx = todo.pop()
        if len(idx) <= leaf:
            out.append(idx)
            continue
        p = points[idx]
        order = np.argsort(p[:, int(np.argmax(p.max(axis=0) - p.min(axis=0)))], kind="stable")
        todo += [idx[order[len(idx) // 2 :]], idx[order[: len(idx) // 2]]]
    return out


class Space:
    """The projection: rows get one more coordinate that makes them equally long, queries are scaled to that length."""

    def __init__(self, mean: np.ndarray, longest: float, seed: int = 17):
        self.mean, self.longest = mean, longest
        self.direction = np.random.default_rng(seed).standard_normal((len(mean) + 1, DIMENSIONS))

    def rows(self, x: np.ndarray) -> np.ndarray:
        x = x - self.mean
        extra = np.sqrt(np.maximum(0, self.longest**2 - np.einsum("ij,ij->i", x, x)))
        return (x @ self.direction[:-1] + extra[:, None] * self.direction[-1]).astype(np.float32)

    def scale(self, q: np.ndarray) -> np.ndarray:
        return self.longest / np.linalg.norm(q, axis=1)

    def queries(self, q: np.ndarray) -> np.ndarray:
        return (q @ self.direction[:-1] * self.scale(q)[:, None]).astype(np.float32)

    def squared(self, q: np.ndarray, product: np.ndarray) -> np.ndarray:
        """Squared distance of scaled queries to rows with the given inner products; infinite without one."""
        found = np.isfinite(product)
        return np.where(found, 2 * self.longest**2 - 2 * self.scale(q) * (np.where(found, product, 0) - q @ self.mean), np.inf)

    def reach(self, q: np.ndarray, product: np.ndarray, limit: float) -> np.ndarray:
        """Largest squared projected distance that the stopping test lets pass, with room for rounding."""
        return limit * (np.maximum(0, self.squared(q, product)) + 1e-6 * self.longest**2)


def away(at: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> np.ndarray:
    """(queries, boxes) squared projected distances."""
    out = np.zeros((len(at), len(lo)), np.float32)
    for j in range(at.shape[1]):
        x = at[:, j : j + 1]
        out += np.maximum(0, np.maximum(lo[:, j] - x, x - hi[:, j])) ** 2
    return out


def search(ids: np.ndarray, rows: np.ndarray, keys: np.ndarray, queries: np.ndarray, own: np.ndarray, least: np.ndarray, k: int, space: Space, limit: float) -> tuple[pd.DataFrame, int]:
    """Per query the k rows with the largest inner product, no row named `own`, that can exceed `least`; pairs verified."""
    n = len(ids)
    points = space.rows(rows)
    leaves = kd_leaves(points)
    order = np.concatenate(leaves)
    ids, rows, points = ids[order], rows[order], points[order]
    ends = np.cumsum([len(x) for x in leaves])
    starts = ends - [len(x) for x in leaves]
    lo, hi = (f.reduceat(points, starts, axis=0) for f in (np.minimum, np.maximum))
    short, verified, out = rows.astype(np.float32), 0, []
    length = np.linalg.norm(rows, axis=1).max(initial=0)
    for c in range(0, len(queries), 256):
        q, key, mine = queries[c : c + 256], keys[c : c + 256], own[c : c + 256]
        at, brief = space.queries(q), q.astype(np.float32)
        slack = 1e-5 * np.linalg.norm(q, axis=1) * length  # of single-precision products
        box = away(at, lo, hi)
        turn = np.argsort(np.argsort(box, axis=1, kind="stable"), axis=1)
        got = np.full((len(q), n), -np.inf, np.float32)
        reach = space.reach(q, least[c : c + 256], limit)
        size2 = np.einsum("ij,ij->i", at, at)
        first, step = 0, 8
        while first < len(leaves):
            due = (turn >= first) & (turn < first + step) & (box <= reach[:, None])
            for m in np.flatnonzero(due.any(axis=0)).tolist():
                who, part = np.flatnonzero(due[:, m]), points[starts[m] : ends[m]]
                gap = size2[who, None] + np.einsum("ij,ij->i", part, part) - 2 * (at[who] @ part.T)
                a, b = np.nonzero(gap <= reach[who, None])
                a, b = who[a], b + starts[m]
                got[a, b] = np.einsum("ij,ij->i", brief[a], short[b])
                verified += len(a)
            named = np.flatnonzero(mine != NOBODY)
            got[named] = np.where(mine[named, None] == ids[None, :], -np.inf, got[named])
            if n > k:
                kth = np.partition(got, n - k, axis=1)[:, n - k] - slack
                reach = np.minimum(reach, space.reach(q, kth, limit))
            first, step = first + step, step * 2
        for i in range(len(q)):
            seen = np.flatnonzero(np.isfinite(got[i]))
            if len(seen) > k:
                seen = seen[got[i, seen] >= np.partition(got[i, seen], len(seen) - k)[len(seen) - k] - 2 * slack[i]]
            if not len(seen):
                continue
            exact = (rows[seen] * q[i]).sum(axis=1)
            best = np.lexsort((ids[seen], -exact))[:k]
            out.append((np.full(len(best), key[i]), ids[seen][best], exact[best]))
    if not out:
        return _none(), verified
    key, vec, score = (np.concatenate(x) for x in zip(*out, strict=True))
    return pd.DataFrame({"key": key, "vec_id": vec, "score": score}), verified


def _none() -> pd.DataFrame:
    return pd.DataFrame({"key": np.zeros(0, np.int64), "vec_id": np.zeros(0, np.int64), "score": np.zeros(0)})


class Regions:
    """The upper kd-tree: splits in level order; a point goes down to the region that is its leaf."""

    def __init__(self, points: np.ndarray, regions: int):
        self.depth = max(0, math.ceil(math.log2(max(1, regions))))
        self.axis, self.cut = np.zeros((1 << self.depth) - 1, np.int64), np.zeros((1 << self.depth) - 1)
        held = {0: points}
        for node in range(len(self.axis)):
            p = held.pop(node)
            if len(p):
                self.axis[node] = np.argmax(p.max(axis=0) - p.min(axis=0))
                self.cut[node] = np.median(p[:, self.axis[node]])
            below = p[:, self.axis[node]] < self.cut[node]
            held[2 * node + 1], held[2 * node + 2] = p[below], p[~below]

    def of(self, points: np.ndarray) -> np.ndarray:
        node = np.zeros(len(points), np.int64)
        for _ in range(self.depth):
            node = 2 * node + 1 + (points[np.arange(len(points)), self.axis[node]] >= self.cut[node])
        return node - len(self.axis)


def nearest(vectors: DataFrame, every: int = 20, k: int = 20, confidence: float = 0.9) -> DataFrame:
    """(vec_id, embedding) -> query_id, rank, vec_id, score for queries with vec_id divisible by `every`.

    Every row but the query's own is a candidate; ranks go by inner product in double precision, ties to the smaller
    vec_id. `confidence` is the chance the stopping test gives the k-th neighbour; nearer ones have a larger one. Equal
    vectors are searched for once, and of equal rows only the k + 1 smallest vec_ids can be in a result. Null, zero and
    non-finite vectors, uncommon lengths and null vec_ids take no part; rows that share vec_id and vector are one
    candidate, rows that share a vec_id alone are never neighbours of each other; fewer candidates than k are all
    returned; other columns are ignored; an empty table gives an empty result.
    """
    spark = ready(vectors.sparkSession)
    good = usable(vectors.filter("vec_id is not null").select(F.col("vec_id").cast("long"), "embedding"))
    d = common_length(good)
    good = good.filter(F.size("embedding") == d).withColumn("h1", F.xxhash64("embedding")).withColumn("h2", F.xxhash64(F.lit(1), "embedding"))
    good = good.dropDuplicates(["vec_id", "h1", "h2"])
    equal = Window.partitionBy("h1", "h2").orderBy("vec_id")
    rows = staged(good.withColumn("_n", F.row_number().over(equal)).filter(F.col("_n") <= k + 1).select("vec_id", "embedding"), "rows")
    # a vec_id with several vectors leaves all of them out; others leave themselves out of the k + 1 found for their vector
    asked = good.filter(F.col("vec_id") % every == 0)
    several = asked.groupBy("vec_id").agg((F.count("*") > 1).alias("several"))
    asked = asked.join(several, "vec_id").withColumn("own", F.when(F.col("several"), F.col("vec_id")).otherwise(F.lit(NOBODY)))
    asked = staged(asked.select("vec_id", "own", "h1", "h2", "embedding"), "asked")
    queries = asked.groupBy("h1", "h2", "own").agg(F.first("embedding").alias("embedding")).withColumn("key", F.xxhash64("h1", "h2", "own"))

    n, m = rows.count(), asked.count()
    if not n or not m:
        return asked.select(F.col("vec_id").alias("query_id"), F.lit(0).alias("rank"), "vec_id", F.lit(0.0).alias("score")).limit(0)
    mean = np.array(rows.agg(*[F.avg(F.col("embedding")[j].cast("double")) for j in range(d)]).first(), float)
    away2 = F.aggregate(F.zip_with("embedding", F.array(*[F.lit(float(x)) for x in mean]), lambda x, c: (x - c) * (x - c)), F.lit(0.0), lambda a, x: a + x)
    space = Space(mean, math.sqrt(rows.agg(F.max(away2)).first()[0]))
    limit = chi_square(confidence, DIMENSIONS)
    wanted = min(SAMPLE // LEAF, -(-n // BLOCK))
    picked = rows.orderBy(F.xxhash64(F.lit(5), "vec_id"), "vec_id").limit(min(SAMPLE, 64 * wanted)).select("embedding").toArrow()["embedding"]  # at most SAMPLE rows
    regions = Regions(space.rows(matrix(picked).astype(np.float64)), wanted)

    def place(batches):
        for b in batches:
            at = space.rows(matrix(b.column(1)).astype(np.float64))
            yield batch(vec_id=b.column(0), embedding=b.column(1), region=regions.of(at).astype(np.int32))

    kind = dict(rows.dtypes)["embedding"]
    placed = staged(rows.mapInArrow(place, f"vec_id long, embedding {kind}, region int"), "placed")

    def measure(batches):
        size = 1 << regions.depth
        lo, hi, count = np.full((size, DIMENSIONS), np.inf, np.float32), np.full((size, DIMENSIONS), -np.inf, np.float32), np.zeros(size, np.int64)
        for b in batches:
            at, own = space.rows(matrix(b.column(1)).astype(np.float64)), b.column(2).to_numpy()
            np.minimum.at(lo, own, at)
            np.maximum.at(hi, own, at)
            count += np.bincount(own, minlength=size)
        some = np.flatnonzero(count)
        for j in range(DIMENSIONS):
            yield batch(region=some.astype(np.int32), axis=np.full(len(some), j, np.int32), lo=lo[some, j], hi=hi[some, j], n=count[some])

    told = placed.mapInArrow(measure, "region int, axis int, lo float, hi float, n long").groupBy("region", "axis").agg(F.min("lo").alias("lo"), F.max("hi").alias("hi"), F.sum("n").alias("n"))
    told = told.orderBy("region", "axis").toArrow()  # at most SAMPLE / LEAF regions
    names = told["region"].to_numpy()[::DIMENSIONS]
    lo, hi = (told[c].to_numpy().reshape(-1, DIMENSIONS) for c in ("lo", "hi"))
    parts = np.maximum(1, -(-told["n"].to_numpy()[::DIMENSIONS] // BLOCK))
    chunks = max(1, -(-m // CHUNK))
    shape = spark.createDataFrame([(int(r), int(p)) for r, p in zip(names, parts, strict=True)], "region int, parts int")
    blocks = placed.join(F.broadcast(shape), "region").withColumn("part", F.pmod(F.xxhash64(F.lit(4), "vec_id"), F.col("parts")).cast("int")).drop("parts")

    def home(batches):
        for b in batches:
            q = matrix(b.column(1)).astype(np.float64)
            near = away(space.queries(q), lo, hi).argmin(axis=1) if len(q) else np.zeros(0, np.int64)
            part = b.column(0).to_numpy() % parts[near]
            yield batch(key=b.column(0), embedding=b.column(1), own=b.column(2), least=np.full(len(q), -np.inf), region=names[near].astype(np.int32), part=part.astype(np.int32))

    def further(batches):
        for b in batches:
            q, least = matrix(b.column(1)).astype(np.float64), b.column(3).to_numpy()
            at = space.queries(q)
            box = away(at, lo, hi)
            who, which = np.nonzero(box <= space.reach(q, least, limit)[:, None])
            first = box.argmin(axis=1)
            seen = b.column(0).to_numpy() % parts[first]
            times = parts[which]
            part = np.arange(times.sum()) - np.repeat(np.cumsum(times) - times, times)
            who, which = np.repeat(who, times), np.repeat(which, times)
            new = (which != first[who]) | (part != seen[who])
            who, which, part = who[new], which[new], part[new]
            for i in range(0, len(who), 65_536):
                w = pa.array(who[i : i + 65_536])
                yield batch(key=b.column(0).take(w), embedding=b.column(1).take(w), own=b.column(2).take(w), least=b.column(3).take(w), region=names[which[i : i + 65_536]].astype(np.int32), part=part[i : i + 65_536].astype(np.int32))

    def run(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        if not len(left) or not len(right):
            return _none()
        as_matrix = lambda f: np.stack(f["embedding"].to_numpy()).astype(np.float64)
        return search(left["vec_id"].to_numpy(), as_matrix(left), right["key"].to_numpy(), as_matrix(right), right["own"].to_numpy(), right["least"].to_numpy(), k + 1, space, limit)[0]

    def met(routed: DataFrame) -> DataFrame:
        at = ["region", "part", "chunk"]
        routed = routed.withColumn("chunk", F.pmod(F.xxhash64(F.lit(2), "key"), F.lit(chunks)).cast("int"))
        there = routed.select(*at).distinct().toDF("region", "part", "_chunk")
        held = blocks.join(there, ["region", "part"]).withColumn("chunk", F.col("_chunk") + 0).drop("_chunk")  # rows go only where queries are
        return held.groupBy(*at).cogroup(routed.groupBy(*at)).applyInPandas(run, "key long, vec_id long, score double")

    routed = f"key long, embedding {kind}, own long, least double, region int, part int"
    start = staged(queries.select("key", "embedding", "own").mapInArrow(home, routed), "queries")
    first = staged(met(start), "first")
    by_score = Window.partitionBy("key").orderBy(F.desc("score"), "vec_id")
    bound = first.withColumn("_n", F.row_number().over(by_score)).filter(F.col("_n") == k + 1).select("key", F.col("score").alias("least"))
    start = start.select("key", "embedding", "own").join(bound, "key", "left").select("key", "embedding", "own", F.coalesce("least", F.lit(float("-inf"))).alias("least"))
    second = met(staged(start.mapInArrow(further, routed), "routed"))
    best = first.unionByName(second).withColumn("_n", F.row_number().over(by_score)).filter(F.col("_n") <= k + 1).select("key", F.col("vec_id").alias("found"), "score")
    own = Window.partitionBy("vec_id", "h1", "h2").orderBy(F.desc("score"), "found")
    out = asked.select("vec_id", "h1", "h2", F.xxhash64("h1", "h2", "own").alias("key")).join(best, "key").filter("vec_id <> found").withColumn("rank", F.row_number().over(own))
    return out.filter(F.col("rank") <= k).select(F.col("vec_id").alias("query_id"), "rank", F.col("found").alias("vec_id"), "score")
