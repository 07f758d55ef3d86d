"""Toxicity by non-negative positive-unlabelled learning.

A linear numpy classifier over word and affix features is trained from confirmed toxic documents and unlabelled text
by the class-prior-corrected risk  pi E_P[l(g)] + max(0, E_U[l(-g)] - pi E_P[l(-g)]).
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import free_name, give_back, ready
from .words import Words, batch, binary, pieces

#: Bounds of the fitting sample, in documents, and of the features kept.
POSITIVES, UNLABELLED, FEATURES = 1500, 4500, 2048
#: Longest text, in characters, that takes part in fitting; longer ones are scored like all others.
LONGEST = 1_000_000
#: Share of the documents with a feature that must be toxic for it to count, less its standard error.
PURITY = 0.7
EDGES = "".join(chr(c) for c in range(33, 127) if not chr(c).isalnum()) + "¡¿«»…–—“”‘’"


def word_features(vocab: pa.Array) -> np.ndarray:
    """(words, 4) 32-bit hashes: the lower-cased word without edge marks and its first 4, 5 and 6 characters; 0: none."""
    bare = pc.utf8_trim(pc.utf8_lower(vocab), characters=EDGES)
    size = pc.utf8_length(bare).to_numpy()
    out = np.zeros((len(vocab), 4), np.uint32)
    if len(vocab):
        for k, n in enumerate((0, 4, 5, 6)):
            part = bare if not n else pc.utf8_slice_codeunits(bare, 0, n)
            h = pd.util.hash_array(part.to_numpy(zero_copy_only=False), categorize=False) ^ np.uint64(n * 0x9E3779B97F4A7C15 % 2**64)
            out[:, k] = np.where(size >= max(1, n), (h >> np.uint64(32)).astype(np.uint32), np.uint32(0))
    return out


@dataclass
class Model:
    features: np.ndarray  # sorted 32-bit hashes
    weights: np.ndarray
    bias: float

    def score(self, text: pa.Array) -> np.ndarray:
        """Probability per text; a feature counts once a document."""
        words = Words(text, lower=False)
        if np.isneginf(self.bias):  # nothing was learned
            return np.zeros(len(words))
        raw = np.full(len(words), self.bias)
        if len(self.features) and len(words.codes):
            h = word_features(words.vocab)
            at = np.minimum(np.searchsorted(self.features, h), len(self.features) - 1)
            hit = self.features[at] == h
            some = hit.any(axis=1)[words.codes]
            doc, code = words.docs()[some], words.codes[some]
            own = hit[code]
            pair = np.unique((doc[:, None] * len(self.features) + at[code])[own])
            raw += np.bincount(pair // len(self.features), self.weights[pair % len(self.features)], len(words))
        return 1 / (1 + np.exp(-np.clip(raw, -40, 40)))


def document_features(docs: DataFrame) -> DataFrame:
    """(doc_id, text, ...) -> doc_id, distinct feature hashes as bytes."""

    def run(batches):
        for b in pieces(batches):
            words = Words(b.column(1), lower=False)
            h = word_features(words.vocab)
            sets = [np.unique(h[words.codes[x:y]]) for x, y in zip(words.offsets[:-1], words.offsets[1:], strict=True)]
            yield batch(doc_id=b.column(0), features=binary(sets))

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, features binary")


def without_copies(sets: list[np.ndarray], bands: int = 12, rows: int = 3) -> list[np.ndarray]:
    """The sets without those of Jaccard similarity 0.7 or more to an earlier one: copies would pass chance words off
    as frequent. Candidates come from banded minima of the (bounded) sample."""
    kept: list[np.ndarray] = []
    seen: dict[tuple, int] = {}
    for s in sets:
        if not len(s):
            continue
        least = [int((s.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) * np.uint64(2 * k + 1) ^ np.uint64(k * 0xD6E8FEB86659FD93 % 2**64)).min()) for k in range(bands * rows)]
        keys = [(k, *least[k : k + rows]) for k in range(0, bands * rows, rows)]
        near = {seen[k] for k in keys if k in seen}
        if any(10 * (both := len(np.intersect1d(s, kept[i], assume_unique=True))) >= 7 * (len(s) + len(kept[i]) - both) for i in near):
            continue
        for k in keys:
            seen.setdefault(k, len(kept))
        kept.append(s)
    return kept


def fit(positive: list[np.ndarray], unlabelled: list[np.ndarray], prior: float, most: int = FEATURES, steps: int = 250) -> Model:
    """nnPU with the logistic loss, Adam and full batches, over features that positives have more often than others."""
    if not positive or not unlabelled:
        return Model(np.zeros(0, np.uint32), np.zeros(0), -np.inf)
    positive, unlabelled = without_copies(positive) or positive, without_copies(unlabelled) or unlabelled
    names, n_pos = np.unique(np.concatenate(positive), return_counts=True)
    some = (n_pos >= min(2, len(positive))) & (names != 0)
    names, n_pos = names[some], n_pos[some]
    n_un = np.zeros(len(names))
    for s in unlabelled:
        at = np.searchsorted(names, s)
        at = at[at < len(names)] if len(names) else at[:0]
        n_un[at[np.isin(names[at], s, assume_unique=False)]] += 1
    p, u = n_pos / len(positive), n_un / len(unlabelled)
    neg = np.maximum(0, u - prior * p) / (1 - prior)
    gain = p * np.log((p + 0.5 / len(positive)) / (neg + 0.5 / len(unlabelled)))
    by_chance = len(positive) * np.maximum(u, 0.5 / len(unlabelled))
    surprise = 2 * (n_pos * np.log(n_pos / by_chance) - n_pos + by_chance)  # likelihood ratio against chance
    gain[(surprise < 20) | (n_pos < by_chance) | (prior * p < (PURITY - 1 / np.sqrt(n_pos)) * u)] = 0  # mostly of positives, and not by chance
    keep = np.sort(np.argsort(-gain, kind="stable")[:most])
    keep = keep[gain[keep] > 0]
    names, odds = names[keep], np.log((p + 0.5 / len(positive)) / (neg + 0.5 / len(unlabelled)))[keep]

    def matrix(sets):
        rows, cols = [], []
        for i, s in enumerate(sets):
            at = np.minimum(np.searchsorted(names, s), max(0, len(names) - 1))
            at = at[names[at] == s] if len(names) else at[:0]
            rows.append(np.full(len(at), i))
            cols.append(at)
        return np.concatenate(rows), np.concatenate(cols), len(sets)

    P, U = matrix(positive), matrix(unlabelled)
    w, bias = 0.5 * np.clip(odds, 0, 6), float(np.log(prior / (1 - prior)))
    m, v = np.zeros(len(names) + 1), np.zeros(len(names) + 1)
    sigmoid = lambda x: 1 / (1 + np.exp(-np.clip(x, -40, 40)))
    raw = lambda X: np.bincount(X[0], w[X[1]], X[2]) + bias
    for step in range(1, steps + 1):
        gp, gu = raw(P), raw(U)
        corrected = np.logaddexp(0, gu).mean() - prior * np.logaddexp(0, gp).mean()
        dp = -prior * sigmoid(-gp) / P[2]
        du = np.zeros(U[2])
        if corrected >= 0:
            dp -= prior * sigmoid(gp) / P[2]
            du += sigmoid(gu) / U[2]
        else:  # the negative part overfits: step back on it alone
            dp = prior * sigmoid(gp) / P[2]
            du = -sigmoid(gu) / U[2]
        grad = np.bincount(P[1], dp[P[0]], len(names)) + np.bincount(U[1], du[U[0]], len(names)) + 2e-5 * w
        g = np.append(grad, dp.sum() + du.sum())
        m, v = 0.9 * m + 0.1 * g, 0.99 * v + 0.01 * g * g
        move = 0.1 * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.99**step)) + 1e-8)
        w -= move[:-1]
        bias -= float(move[-1])
    return Model(names, w, bias)


def train(docs: DataFrame, labels: DataFrame, positives: int = POSITIVES, unlabelled: int = UNLABELLED) -> Model:
    """Fit on the rows whose crc32(doc_id as text) mod 3 is not 1: at most `positives` toxic and `unlabelled` other ones,
    those with the smallest hashes among documents with a text that is not blank and has at most LONGEST characters, a row
    each. The class prior is the toxic share of all those labels that have a document (0.001 to 0.5)."""
    own = lambda df: df.filter(F.crc32(F.col("doc_id").cast("string")) % 3 != 1)
    known = own(labels.filter("toxic is not null").select(F.col("doc_id").cast("long"), "toxic")).groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    usable = (F.length("text") <= LONGEST) & (F.trim("text") != "")
    there = docs.groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.max(F.coalesce(usable, F.lit(False))).alias("usable"))
    known = known.join(there, "doc_id")
    stats = known.agg(F.count("*"), F.sum((F.col("toxic") == 1).cast("long"))).first()
    prior = min(0.5, max(0.001, (stats[1] or 0) / max(1, stats[0])))
    order = [F.xxhash64(F.lit(4), "doc_id"), "doc_id"]
    pos = known.filter("toxic = 1 and usable").select("doc_id").orderBy(*order).limit(positives)
    un = own(there.filter("usable").select("doc_id")).orderBy(*order).limit(unlabelled)
    picked = pos.withColumn("p", F.lit(1)).unionByName(un.withColumn("p", F.lit(0)))
    ids = picked.groupBy("doc_id").agg(F.max("p").alias("p"), (F.min("p") == 0).alias("u"))
    text = docs.select(F.col("doc_id").cast("long"), "text").join(F.broadcast(ids.select("doc_id")), "doc_id", "left_semi")  # at most positives + unlabelled ids
    text = text.filter(usable).groupBy("doc_id").agg(F.min("text").alias("text"))  # one row an id
    sets = document_features(text).join(F.broadcast(ids), "doc_id").toArrow()
    rows = sorted(zip(sets["doc_id"].to_pylist(), sets["p"].to_pylist(), sets["u"].to_pylist(), (np.frombuffer(x.as_buffer(), np.uint32) for x in sets["features"]), strict=True), key=lambda r: (r[0], len(r[3]), r[3].tobytes()))
    model = fit([r[3] for r in rows if r[1]], [r[3] for r in rows if r[2]], prior)
    del rows, sets
    give_back()
    return model


def score(docs: DataFrame, labels: DataFrame, threshold: float = 0.7) -> DataFrame:
    """All input columns and rows plus held_out, score and predicted (with underscores behind a name that is taken).

    Null and empty texts get the score of a text without features; a null doc_id is not held out and trains nothing;
    without any toxic training label every score is 0; labels given twice count as toxic if one is; repeated rows are
    scored alike; an empty table gives an empty result.
    """
    ready(docs.sparkSession)
    model = train(docs, labels)
    return apply(docs, model, threshold)


def apply(docs: DataFrame, model: Model, threshold: float = 0.7) -> DataFrame:
    own, text = docs.columns, docs.columns.index("text")
    held_out, scores, predicted = (free_name(own, c) for c in ("held_out", "score", "predicted"))

    def run(batches):
        for b in pieces(batches):
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(model.score(b.column(text)))], names=[*own, scores])

    scored = docs.mapInArrow(run, docs.select("*", F.lit(0.0).alias(scores)).schema)
    held = F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 3 == 1, F.lit(False))
    return scored.select(*own, held.alias(held_out), scores, (F.col(scores) >= threshold).cast("int").alias(predicted))
