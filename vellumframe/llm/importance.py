"""Target-distribution importance resampling over hashed word n-grams, counted by batch concatenation.

A batch's texts are joined with a sentinel that no text can hold; one pass of a regular expression finds the words of all
of them; document offsets, located among the words by searchsorted, mask the n-grams that would cross from one text
into the next; what is left is hashed and counted by bincount. Weights are taken from the two bucket tables in a second
pass over the texts, and a draw without replacement is the top of the weights with Gumbel noise.
"""

from __future__ import annotations

import math
import re
import zlib
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import free_name, ready, staged

BUCKETS = 10_000
#: Stands between the texts of a batch: a byte that UTF-8 never has.
SENTINEL = b"\xff"
WORD = re.compile(rb"([0-9a-z\x80-\xfe]+)")
LOWER = bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))
#: Bytes of text that are joined at a time, but for a single longer text.
CHUNK = 4 << 20
#: Words up to this many bytes are chained by table, longer ones one by one.
TABLED = 64


@lru_cache(maxsize=1)
def _chain() -> np.ndarray:
    """For n zero bytes (first index), what each of a checksum's four bytes turns into when they follow it."""
    out = np.zeros((TABLED + 2, 4, 256), np.uint32)
    for n in range(TABLED + 2):
        zeros = bytes(n)
        for k in range(4):
            out[n, k] = [zlib.crc32(zeros, (x << 8 * k) ^ 0xFFFFFFFF) ^ 0xFFFFFFFF for x in range(256)]
    return out


def followed(crc: np.ndarray, n: np.ndarray) -> np.ndarray:
    """Checksums once n more bytes follow, but for those bytes' own part: crc32(a + b) = followed(crc32(a), len(b)) ^ crc32(b)."""
    t = _chain()
    return t[n, 0, crc & 255] ^ t[n, 1, crc >> 8 & 255] ^ t[n, 2, crc >> 16 & 255] ^ t[n, 3, crc >> 24]


class Features:
    """Buckets of the word n-grams (one and two words) of joined texts.

    ``ones`` and ``twos`` are in reading order; document i owns places first[i]:first[i + 1] of both, and the places
    of ``twos`` where ``inside`` is false would begin a pair that crosses into another document.
    """

    def __init__(self, texts: list[bytes | None], buckets: int = BUCKETS):
        texts = [t or b"" for t in texts]
        parts = WORD.split(SENTINEL.join(texts).translate(LOWER))  # gap, word, gap, ... in one pass
        ends = np.cumsum(np.fromiter(map(len, parts), np.int64, len(parts)))
        starts, words = ends[0:-1:2], parts[1::2]
        offsets = np.cumsum([0, *(len(t) + 1 for t in texts)])
        self.first = np.searchsorted(starts, offsets)
        found = pa.array(words, pa.binary()).dictionary_encode()
        codes, names = found.indices.to_numpy(), found.dictionary.to_pylist()
        plain = np.array([zlib.crc32(w) for w in names], np.uint32)
        self.ones = plain[codes].astype(np.int64) % buckets if len(codes) else np.zeros(0, np.int64)
        if len(codes) > 1:
            behind = np.array([zlib.crc32(b" " + w) for w in names], np.uint32)
            size = np.array([len(w) + 1 for w in names], np.int64)
            a, b = codes[:-1], codes[1:]
            pairs = followed(plain[a], np.minimum(size, TABLED + 1)[b]) ^ behind[b]
            for k in np.flatnonzero(size[b] > TABLED + 1).tolist():
                pairs[k] = zlib.crc32(b" " + names[b[k]], int(plain[a[k]]))
            self.twos = np.append(pairs.astype(np.int64) % buckets, 0)
        else:
            self.twos = np.zeros(len(codes), np.int64)
        self.inside = np.ones(len(codes), bool)
        edge = self.first[1:]
        self.inside[edge[(edge > 0)] - 1] = False

    def counts(self, buckets: int) -> np.ndarray:
        return np.bincount(self.ones, minlength=buckets) + np.bincount(self.twos[self.inside], minlength=buckets)

    def sums(self, gains: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Words of each document, and the sum of gains over its features."""
        both = gains[self.ones] + np.where(self.inside, gains[self.twos], 0)
        return np.diff(self.first), np.diff(np.concatenate([[0], np.cumsum(both)])[self.first])


def runs(text: pa.Array):
    """The texts as lists of bytes, in runs of about CHUNK bytes."""
    sizes = pc.fill_null(pc.binary_length(text), 0).to_numpy().astype(np.int64)
    ends, k = np.cumsum(sizes), 0
    while k < len(sizes):
        upto = max(k + 1, int(np.searchsorted(ends, (ends[k - 1] if k else 0) + CHUNK, "right")))
        yield text.slice(k, upto - k).cast(pa.binary()).to_pylist()
        k = upto


def bucket_counts(texts: DataFrame, buckets: int = BUCKETS) -> DataFrame:
    """bucket, n: how often features of the texts fall into a bucket; a task counts its own texts before the shuffle."""

    def run(batches):
        total = np.zeros(buckets, np.int64)
        for b in batches:
            for part in runs(b.column(0)):
                total += Features(part, buckets).counts(buckets)
        some = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(some), pa.array(total[some])], names=["bucket", "n"])

    return texts.select("text").mapInArrow(run, "bucket long, n long").groupBy("bucket").agg(F.sum("n").alias("n"))


def bucket_gains(source: np.ndarray, target: np.ndarray) -> np.ndarray:
    """A thousandth of a nat: floor(1000 ln((t + 1)(S + B) / ((s + 1)(T + B)))) a bucket, in doubles."""
    B = len(source)
    S, T = float(source.sum() + B), float(target.sum() + B)
    return np.array([math.floor(1000 * math.log(float(t + 1) * S / (float(s + 1) * T))) for s, t in zip(source.tolist(), target.tolist(), strict=True)], np.int64)


def resample(docs: DataFrame, target: DataFrame, percent: int = 25, least_words: int = 20, buckets: int = BUCKETS, seed: int = 7) -> DataFrame:
    """All columns but the text, and n_features, n_words, weight, score and rank (with underscores behind a name that is taken).

    docs and target have a column text, docs a doc_id. Of the N documents with at least `least_words` words the
    floor(percent * N / 100) highest scores are drawn, ranked from 1, ties to the smaller doc_id (null last).

    Defined cases: null texts and texts without words have no features, weight 0, and a score; a null doc_id draws its
    noise as an empty id; repeated rows are drawn as rows of their own; long texts are read whole; an empty table gives an
    empty result, and an empty target a weight from the documents' counts alone.
    """
    spark = ready(docs.sparkSession)

    def tally(df: DataFrame) -> np.ndarray:
        out = np.zeros(buckets, np.int64)
        for r in bucket_counts(df, buckets).collect():  # at most one row a bucket
            out[r["bucket"]] = r["n"]
        return out

    gains = bucket_gains(tally(docs), tally(target))
    given = docs.columns
    kept = [c for c in given if c != "text"]
    features, n_words, weight, score, rank = (free_name(docs.columns, c) for c in ("n_features", "n_words", "weight", "score", "rank"))
    part = free_name(docs.columns, "_part")
    text = given.index("text")

    def run(batches):
        for b in batches:
            n, w = [], []
            for some in runs(b.column(text)):
                size, total = Features(some, buckets).sums(gains)
                n.append(size)
                w.append(total // np.maximum(1, 2 * size - 1))
            own = [c for c, name in zip(b.columns, given, strict=True) if name != "text"]
            yield pa.RecordBatch.from_arrays([*own, pa.array(np.concatenate(n)), pa.array(np.concatenate(w))], names=[*kept, n_words, weight])

    schema = docs.select(*kept, F.lit(0).cast("long").alias(n_words), F.lit(0).cast("long").alias(weight)).schema
    weighed = docs.mapInArrow(run, schema)
    h = F.conv(F.substring(F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit(""))), 256), 1, 8), 16, 10).cast("double")
    noise = F.floor(-1000 * F.log(-F.log((h + 0.5) / 4294967296))).cast("long")
    n_features = F.greatest(2 * F.col(n_words) - 1, F.lit(0)).cast("long")
    may = F.col(n_words) >= least_words
    order = [F.col(score).desc(), F.col("doc_id").asc_nulls_last()]
    scored = weighed.withColumn(features, n_features).withColumn(score, F.col(weight) + noise).withColumn(rank, F.when(may, F.lit(1)).otherwise(0))
    # rows in order of score over ranges of about equal size; the stored range number makes later reads agree
    spread = max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))
    ranged = scored.repartitionByRange(spread, F.col(rank).desc(), *order).withColumn(part, F.spark_partition_id())
    rows = staged(ranged, "scores")
    sizes = sorted((r[part], r["n"]) for r in rows.filter(F.col(rank) == 1).groupBy(part).agg(F.count("*").alias("n")).collect())  # one row a range
    draw = percent * sum(n for _, n in sizes) // 100
    before, entries = 0, []
    for p, n in sizes:
        entries.append((p, before))
        before += n
    starts = F.broadcast(spark.createDataFrame(entries, f"{part} int, {part}before long"))
    place = F.row_number().over(Window.partitionBy(part).orderBy(F.col(rank).desc(), *order)) + F.col(f"{part}before")
    placed = rows.join(starts, part, "left").withColumn(f"{part}place", F.when(F.col(rank) == 1, place))
    drawn = F.when(F.col(f"{part}place") <= draw, F.col(f"{part}place")).cast("long")
    return placed.withColumn(rank, drawn).select(*kept, features, n_words, weight, score, rank)
