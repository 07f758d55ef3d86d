"""Language of every word by a linear-chain conditional random field, and of every text from its words.

Emissions are hashed affix, character n-gram and whole-word (lexicon) features, transitions are learned on sequences
that switch between languages, and forward-backward gives each word's posterior.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import free_name, give_back, ready
from .toxicity import EDGES, LONGEST
from .words import Words, batch, pieces

#: Bound of the fitting sample, documents of each language, and buckets, ever fewer, that share the work of a frequent one.
PER_LANGUAGE, SALTS = 300, (512, 16, 1)
#: Languages that are learned at most; each has its own weights.
LANGUAGES = 200
BITS, WIDE = 17, 24


def features(vocab: list[str]) -> np.ndarray:
    """(words, features) hashed indices; 0 is no feature. Words have at most WIDE characters."""
    size = np.fromiter(map(len, vocab), np.int64, len(vocab))
    if not len(vocab):
        return np.zeros((0, 1), np.int64)
    chars = np.zeros((len(vocab), WIDE + 4), np.uint32)
    chars[:, 1 : WIDE + 1] = np.array([w[:WIDE] for w in vocab], dtype=f"U{WIDE}").view(np.uint32).reshape(len(vocab), WIDE)
    tail = np.array([w[-4:][::-1] for w in vocab], dtype="U4").view(np.uint32).reshape(len(vocab), 4)
    chars[:, 0] = 2
    last = np.minimum(size, WIDE) + 1
    chars[np.arange(len(vocab)), last] = 3
    c = chars.astype(np.uint64)

    def slot(h: np.ndarray, kind: int) -> np.ndarray:
        h = (h + np.uint64(kind)) * np.uint64(0x9E3779B97F4A7C15)
        h ^= h >> np.uint64(29)
        return ((h * np.uint64(0xBF58476D1CE4E5B9)) >> np.uint64(64 - BITS)).astype(np.int64)

    m = [np.uint64(x) for x in (1, 1000003, 998244353, 19260817)]
    two = c[:, :-1] * m[1] + c[:, 1:]
    three = two[:, :-1] * m[2] + c[:, 2:] * m[3]
    at = np.arange(two.shape[1])
    out = [np.where(at[None, :] < last[:, None], slot(two, 1), 0), np.where(at[None, :-1] < last[:, None] - 1, slot(three, 2), 0)]
    whole = np.zeros(len(vocab), np.uint64)
    for k in range(1, WIDE + 1):
        whole = whole * m[1] + c[:, k]
    ends = tail.astype(np.uint64)
    own = [slot(whole + size.astype(np.uint64) * m[3], 3)]
    h = t = np.zeros(len(vocab), np.uint64)
    for k in range(4):
        h, t = h * m[2] + c[:, k + 1], t * m[2] + ends[:, k]
        if k != 1:
            own += [np.where(size > k, slot(h, 10 + k), 0), np.where(size > k, slot(t, 20 + k), 0)]
    return np.concatenate([*out, np.stack(own, axis=1)], axis=1)


@dataclass
class Field:
    languages: list[str]
    weights: np.ndarray  # (2 ** BITS, languages) float32
    trans: np.ndarray  # (languages, languages) log potentials, from row to column

    def emissions(self, vocab: list[str]) -> np.ndarray:
        out = np.zeros((len(vocab), len(self.languages)), np.float32)
        for k in range(0, len(vocab), 8192):
            f = features(vocab[k : k + 8192])
            for j in range(f.shape[1]):
                out[k : k + len(f)] += self.weights[f[:, j]]
        return out


def posteriors(emit: np.ndarray, offsets: np.ndarray, trans: np.ndarray) -> np.ndarray:
    """Word posteriors by forward-backward over many sequences at once: step t of all that are longer than t."""
    counts = np.diff(offsets)
    order = np.argsort(-counts, kind="stable")
    starts, counts = offsets[:-1][order], counts[order]
    e = np.exp(emit - emit.max(axis=1, keepdims=True)) if len(emit) else emit
    move = np.exp(trans - trans.max()).astype(np.float32)
    alpha = np.empty_like(e)
    active = np.searchsorted(-counts, -np.arange(1, (counts[0] if len(counts) else 0) + 1), side="right")
    a = None
    for t, n in enumerate(active.tolist()):
        at = starts[:n] + t
        a = e[at] if t == 0 else (a[:n] @ move) * e[at]
        a /= a.sum(axis=1, keepdims=True)
        alpha[at] = a
    b = np.ones((len(counts), e.shape[1] if e.ndim == 2 else 1), np.float32)
    for t in range(len(active) - 1, -1, -1):
        n = int(active[t])
        at = starts[:n] + t
        cur = b[:n]
        post = alpha[at] * cur
        alpha[at] = post / post.sum(axis=1, keepdims=True)
        nxt = (e[at] * cur) @ move.T
        b[:n] = nxt / nxt.sum(axis=1, keepdims=True)
    return alpha


def script(char: str) -> int:
    """Coarse script of a letter: Latin, Chinese and Japanese, or its block of 256 characters."""
    c = ord(char)
    if c < 0x250 or 0x1E00 <= c < 0x1F00:
        return 0
    return 1 if 0x2E80 <= c < 0xA000 or 0xF900 <= c < 0xFB00 or c >= 0x20000 else 2 + (c >> 8)


def parts_of(word: str) -> list[str]:
    """The word, cut where its script changes and into even parts of at most WIDE characters; parts without a letter go."""
    runs = [word]
    if not word.isascii() and max(word) >= "\u0250":
        runs, first, last = [], 0, -1
        for i, char in enumerate(word):
            if char.isalpha():
                now = script(char)
                if last not in (-1, now):
                    runs.append(word[first:i])
                    first = i
                last = now
        runs.append(word[first:])
    out = []
    for r in runs:
        n = -(-len(r) // WIDE)
        out += [r[len(r) * k // n : len(r) * (k + 1) // n] for k in range(n)]
    return [w for w in out if len(out) == 1 or any(map(str.isalpha, w))]


def sequence_words(text: pa.Array) -> tuple[np.ndarray, np.ndarray, list[str]]:
    """Codes, offsets and vocabulary of the words that hold a letter, lower-cased and without edge marks.

    Where a run without white space is long or mixes scripts, its parts stand in sequence as words of their own.
    """
    words = Words(text, lower=False)
    bare = pc.utf8_trim(pc.utf8_lower(words.vocab), characters=EDGES + "0123456789").dictionary_encode()
    lettered = pc.match_substring_regex(bare.dictionary, r"\p{L}").to_numpy(zero_copy_only=False) if len(bare.dictionary) else np.zeros(0, bool)
    codes = bare.indices.to_numpy().astype(np.int64)[words.codes] if len(words.codes) else words.codes
    vocab: dict[str, int] = {}
    flat, sizes = [], np.zeros(len(lettered), np.int64)
    for k, (word, some) in enumerate(zip(bare.dictionary.to_pylist(), lettered.tolist(), strict=True)):
        own = (parts_of(word) if len(word) > WIDE or not word.isascii() else [word]) if some else []
        sizes[k] = len(own)
        flat += [vocab.setdefault(w, len(vocab)) for w in own]
    first = np.cumsum(sizes) - sizes
    n = sizes[codes] if len(codes) else np.zeros(0, np.int64)
    ends = np.cumsum(n)
    offsets = np.concatenate([[0], ends])[words.offsets]
    at = np.repeat(first[codes] - (ends - n), n) + np.arange(int(n.sum())) if len(codes) else np.zeros(0, np.int64)
    return np.array(flat, np.int64)[at], offsets, list(vocab)


def fit(texts: list[str], langs: list[str], length: int = 96, sequences: int = 6000, seed: int = 5) -> Field:
    """Train by gradient steps on sequences stitched from spans of 8 to 40 words of random documents."""
    languages = sorted(set(langs))
    codes, offsets, vocab = sequence_words(pa.array(texts, pa.string()))
    owner = np.array([languages.index(x) for x in langs], np.int64)
    weights = np.zeros((1 << BITS, len(languages)), np.float32)
    trans = np.zeros((len(languages), len(languages)))
    usable = np.flatnonzero(np.diff(offsets) > 0)
    if not len(usable):
        return Field(languages, weights, trans)
    rng = np.random.default_rng(seed)
    by = [usable[owner[usable] == k] for k in range(len(languages))]
    by = [b for b in by if len(b)]
    table = np.zeros((len(vocab), features(vocab[:1]).shape[1]), np.int32)
    for k in range(0, len(vocab), 2048):
        table[k : k + 2048] = features(vocab[k : k + 2048])
    x = np.empty((sequences, length), np.int32)
    y = np.empty((sequences, length), np.int16)
    for s in range(sequences):
        at = 0
        while at < length:
            group = by[int(rng.integers(len(by)))]
            d = int(group[int(rng.integers(len(group)))])
            lo, hi = int(offsets[d]), int(offsets[d + 1])
            n = min(int(rng.integers(8, 41)), length - at, hi - lo)
            first = lo + int(rng.integers(hi - lo - n + 1))
            x[s, at : at + n], y[s, at : at + n] = codes[first : first + n], owner[d]
            at += n
    L = len(languages)
    square = np.zeros_like(weights)
    tsquare = np.full(trans.shape, 1e-6)
    for k in range(0, sequences, 48):
        xs, ys = x[k : k + 48], y[k : k + 48]
        f = table[xs.ravel()]
        emit = weights[f].sum(axis=1).reshape(len(xs), length, L)
        e = np.exp(emit - emit.max(axis=2, keepdims=True)).astype(np.float64)
        move = np.exp(trans - trans.max())
        a = np.empty_like(e)
        b = np.ones_like(e)
        a[:, 0] = e[:, 0] / e[:, 0].sum(axis=1, keepdims=True)
        for t in range(1, length):
            a[:, t] = (a[:, t - 1] @ move) * e[:, t]
            a[:, t] /= a[:, t].sum(axis=1, keepdims=True)
        for t in range(length - 2, -1, -1):
            b[:, t] = (e[:, t + 1] * b[:, t + 1]) @ move.T
            b[:, t] /= b[:, t].sum(axis=1, keepdims=True)
        post = a * b
        post /= post.sum(axis=2, keepdims=True)
        left, right = a[:, :-1].reshape(-1, L), (e[:, 1:] * b[:, 1:]).reshape(-1, L)
        pair = move * ((left / ((left @ move) * right).sum(axis=1, keepdims=True)).T @ right)
        gold = np.zeros_like(trans)
        np.add.at(gold, (ys[:, :-1].ravel(), ys[:, 1:].ravel()), 1)
        g = (pair - gold) / len(xs) + 0.01 * trans
        tsquare += g * g
        trans -= 0.5 * g / np.sqrt(tsquare)
        post[np.arange(len(xs))[:, None], np.arange(length), ys] -= 1
        d = (post.reshape(-1, L) / len(xs)).astype(np.float32)
        used, back = np.unique(f, return_inverse=True)
        back = back.reshape(f.shape)
        grad = np.stack([np.bincount(back.ravel(), np.repeat(d[:, j], f.shape[1]), len(used)) for j in range(L)], axis=1).astype(np.float32)
        grad[used == 0] = 0
        square[used] += grad * grad
        weights[used] -= 0.1 * grad / np.sqrt(square[used] + 1e-8)
    weights[0] = 0
    return Field(languages, weights, trans.astype(np.float32))


def train(docs: DataFrame, per_language: int = PER_LANGUAGE, most: int = LANGUAGES) -> Field:
    """Fit on documents with a lang whose crc32(doc_id as text) mod 3 is not 1: of every language, among texts that hold a
    letter and have at most LONGEST characters, the `per_language` with the smallest hashes, a row each and whole.

    More than `most` values of lang are a ValueError: every one of them has weights of its own.
    """
    usable = F.col("lang").isNotNull() & (F.length("text") <= LONGEST) & F.col("text").rlike(r"\p{L}")
    texts = docs.select(F.col("doc_id").cast("long"), "lang", "text").filter(usable & (F.crc32(F.col("doc_id").cast("string")) % 3 != 1))
    own = texts.select("doc_id", "lang").distinct().withColumn("h", F.xxhash64(F.lit(9), "doc_id"))
    for salts in SALTS:
        first = Window.partitionBy("lang", F.pmod("h", F.lit(salts))).orderBy("h", "doc_id")
        own = own.withColumn("n", F.row_number().over(first)).filter(F.col("n") <= per_language).drop("n")
    picked = own.limit(per_language * most + 1).collect()  # a lang value gives at most per_language rows
    if len({r["lang"] for r in picked}) > most or len(picked) > per_language * most:
        raise ValueError(f"more than {most} languages")
    ids = docs.sparkSession.createDataFrame([(r["doc_id"], r["lang"]) for r in picked], "doc_id long, lang string")
    rows = texts.join(F.broadcast(ids), ["doc_id", "lang"], "left_semi").groupBy("doc_id", "lang").agg(F.min("text").alias("text")).collect()
    rows.sort(key=lambda r: (r["doc_id"], r["lang"]))
    field = fit([r["text"] for r in rows], [r["lang"] for r in rows])
    del rows
    give_back()
    return field


def predict(text: pa.Array, field: Field) -> tuple[list[str], np.ndarray]:
    """Language and mean posterior per text; `und` and 0 without a letter."""
    codes, offsets, vocab = sequence_words(text)
    n = len(offsets) - 1
    if not len(codes) or not field.languages:
        return ["und"] * n, np.zeros(n)
    post = posteriors(field.emissions(vocab)[codes], offsets, field.trans)
    sums = np.stack([np.bincount(np.repeat(np.arange(n), np.diff(offsets)), post[:, k], n) for k in range(post.shape[1])], axis=1)
    counts = np.diff(offsets)
    best = sums.argmax(axis=1)
    score = np.where(counts > 0, sums.max(axis=1) / np.maximum(counts, 1), 0.0)
    return [field.languages[k] if c else "und" for k, c in zip(best.tolist(), counts.tolist(), strict=True)], np.clip(score, 0, 1)


def label_words(docs: DataFrame, field: Field) -> DataFrame:
    """Spans of one language inside each text: doc_id, first word, words, lang (over the words, or parts of
    long runs, that hold a letter)."""
    shared = ready(docs.sparkSession).sparkContext.broadcast(field)

    def run(batches):
        field = shared.value
        for b in pieces(batches):
            codes, offsets, vocab = sequence_words(b.column(1))
            if not len(codes) or not field.languages:
                continue
            best = posteriors(field.emissions(vocab)[codes], offsets, field.trans).argmax(axis=1)
            doc = np.repeat(np.arange(len(offsets) - 1), np.diff(offsets))
            new = np.flatnonzero(np.concatenate([[True], (doc[1:] != doc[:-1]) | (best[1:] != best[:-1])]))
            size = np.diff(np.append(new, len(best)))
            yield batch(doc_id=b.column(0).take(pa.array(doc[new])), first=pa.array(new - offsets[doc[new]], pa.int64()), words=pa.array(size, pa.int64()), lang=pa.array([field.languages[k] for k in best[new]], pa.string()))

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, "doc_id long, first long, words long, lang string")


def identify(docs: DataFrame, field: Field | None = None) -> DataFrame:
    """All input columns and rows plus held_out, lang_pred and score (with underscores behind a name that is taken).

    Null texts and texts without a letter are `und` with score 0, and so is every text if no language was learned;
    a null doc_id is not held out and trains nothing; ties go to the language that sorts first; repeated rows are
    labelled alike; an empty table gives an empty result.
    """
    ready(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(field or train(docs))  # 2^BITS weights a language, at most LANGUAGES of them
    own, text = docs.columns, docs.columns.index("text")
    held_out, found, scores = (free_name(own, c) for c in ("held_out", "lang_pred", "score"))

    def run(batches):
        for b in pieces(batches):
            lang, score = predict(b.column(text), shared.value)
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(lang, pa.string()), pa.array(score, pa.float64())], names=[*own, found, scores])

    out = docs.mapInArrow(run, docs.select("*", F.lit("").alias(found), F.lit(0.0).alias(scores)).schema)
    held = F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 3 == 1, F.lit(False))
    return out.select(*own, held.alias(held_out), found, scores)
