"""Token counts of whole texts by a two-tier map-side lookup, without a shuffle of pre-tokens.

A text is cut where a byte-level vocabulary never merges across: before white space, and between an ASCII letter or
digit and ASCII characters of another kind. The token counts of frequent pieces are broadcast as one compact table
(pieces in one byte pool, a length each, looked up by Arrow's hash index); pieces that are not in it go through a cache
of the worker, and only what the cache does not hold is encoded by the tokenizers library.
"""

from __future__ import annotations

import json
import os
import re
from functools import lru_cache
from pathlib import Path

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import free_name, ready

#: The table is made from at most this many texts of at most LONGEST characters, and holds at most this many pieces.
SAMPLE, LONGEST, FREQUENT = 1000, 20_000, 65_536
#: Pieces a worker remembers beside the table, none longer than REMEMBERED bytes; a full cache starts anew.
CACHE, REMEMBERED = 400_000, 64
#: Bytes of text that are cut at a time, but for a single longer text.
CHUNK = 4 << 20

#: Kinds of bytes: 0 beyond ASCII, 1 white space, 2 letters, 3 digits, 4 other ASCII.
_KIND = np.array([0 if c > 127 else 1 if c in b" \t\n\v\f\r" else 2 if chr(c).isalpha() else 3 if chr(c).isdigit() else 4 for c in range(256)], np.uint8)


def _wide_space(data: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Whether the characters that end right before the places `at` are white space outside ASCII."""
    last = data[at - 1]
    two = np.where(at >= 2, data[at - 2], 0)
    three = np.where(at >= 3, data[at - 3], 0)
    out = (two == 0xC2) & ((last == 0x85) | (last == 0xA0))
    out |= (three == 0xE1) & (two == 0x9A) & (last == 0x80)
    out |= (three == 0xE2) & (two == 0x80) & ((last >= 0x80) & (last <= 0x8A) | (last == 0xA8) | (last == 0xA9) | (last == 0xAF))
    out |= (three == 0xE2) & (two == 0x81) & (last == 0x9F)
    return out | (three == 0xE3) & (two == 0x80) & (last == 0x80)


def cut(data: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """Places where pieces begin in the bytes of texts that begin at `starts`."""
    kind = _KIND[data]
    before, here = kind[:-1], kind[1:]
    begins = np.zeros(len(data), bool)
    begins[1:] = (here == 1) & (before != 1) | (before == 2) & (here != 2) & (here != 0) | (before == 3) & (here != 3) & (here != 0)
    after = np.flatnonzero((before == 0) & (here == 1)) + 1
    begins[after[_wide_space(data, after)]] = False  # within white space
    begins[starts[starts < len(data)]] = True
    return np.flatnonzero(begins)


class Counter:
    """Counts tokens of batches of texts, with a cache of its own."""

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        spec = json.loads(Path(path).read_text(encoding="utf-8"))
        split = spec.get("pre_tokenizer") or {}
        added = spec.get("added_tokens") or []
        if split.get("type") != "ByteLevel" or split.get("add_prefix_space") or not split.get("use_regex", True) or spec.get("normalizer"):
            raise ValueError("only byte-level vocabularies without a normaliser or added space are cut into pieces here")
        if any(t.get(k) for t in added for k in ("single_word", "lstrip", "rstrip", "normalized")):
            raise ValueError("added tokens that take in their surroundings are not supported")
        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        self.special = "|".join(re.escape(t["content"]) for t in sorted(added, key=lambda t: -len(t["content"])))
        self.known: dict[bytes, int] = {}

    def lengths(self, pieces: pa.Array) -> np.ndarray:
        """Tokens of each (distinct) piece, through the cache."""
        names = pieces.to_pylist()
        out = np.fromiter(map(self.known.get, names, [-1] * len(names)), np.int64, len(names))
        new = np.flatnonzero(out < 0)
        for k in range(0, len(new), 4096):
            some = new[k : k + 4096].tolist()
            for i, e in zip(some, self.tokenizer.encode_batch_fast([names[i].decode() for i in some], add_special_tokens=False), strict=True):
                out[i] = len(e)
        if len(self.known) + len(new) > CACHE:
            self.known = {}
        self.known.update((names[i], int(out[i])) for i in new.tolist()[:CACHE] if len(names[i]) <= REMEMBERED)
        return out

    def pieces(self, text: pa.Array) -> tuple[pa.DictionaryArray, np.ndarray, np.ndarray]:
        """Pieces in reading order, their places by text, and how many special tokens each text holds."""
        text = pc.fill_null(text, "")
        extra = np.zeros(len(text), np.int64)
        owner = np.arange(len(text) + 1)
        if self.special and pc.any(pc.match_substring_regex(text, self.special)).as_py():
            parts = pc.split_pattern_regex(text, self.special)
            owner = parts.offsets.to_numpy() - parts.offsets[0].as_py()
            extra, text = np.diff(owner) - 1, parts.flatten()
        sizes = pc.binary_length(text).to_numpy().astype(np.int64)
        begins = np.concatenate([[0], np.cumsum(sizes)])
        joined = b"".join(text.cast(pa.binary()).to_pylist())
        data = np.frombuffer(joined, np.uint8)
        at = cut(data, begins[:-1])
        edges = np.append(at, len(data)).astype(np.int32)
        found = pa.Array.from_buffers(pa.binary(), len(at), [None, pa.py_buffer(edges), pa.py_buffer(joined)]).dictionary_encode()
        return found, np.searchsorted(at, begins)[owner], extra

    def count(self, text: pa.Array, table: tuple[pa.Array, np.ndarray] | None) -> np.ndarray:
        found, places, extra = self.pieces(text)
        names = found.dictionary
        size = np.zeros(len(names), np.int64)
        missed = np.ones(len(names), bool)
        if table is not None and len(table[0]) and len(names):
            hit = pc.fill_null(pc.index_in(names, value_set=table[0]), -1).to_numpy()
            missed = hit < 0
            size[~missed] = table[1][hit[~missed]]
        if missed.any():
            size[missed] = self.lengths(names.filter(pa.array(missed)))
        upto = np.concatenate([[0], np.cumsum(size[found.indices.to_numpy()])])
        return np.diff(upto[places]) + extra


@lru_cache(maxsize=2)
def counter(path: str) -> Counter:
    """One counter a worker process; its cache lives across tasks."""
    return Counter(path)


def chunks(text: pa.Array) -> list[pa.Array]:
    """The texts in runs of at most CHUNK bytes, a longer text alone."""
    ends = np.cumsum(pc.fill_null(pc.binary_length(text), 0).to_numpy().astype(np.int64))
    out, k = [], 0
    while k < len(text):
        upto = int(np.searchsorted(ends, (ends[k - 1] if k else 0) + CHUNK, "right"))
        upto = max(upto, k + 1)
        out.append(text.slice(k, upto - k))
        k = upto
    return out


def frequent_lengths(docs: DataFrame, path: str, sample: int = SAMPLE, most: int = FREQUENT) -> tuple[pa.Array, np.ndarray]:
    """The commonest pieces of at most `sample` texts and their token counts: at most `most` entries.

    The texts are the first that Spark comes to, so that no second scan is needed. They only decide which pieces are
    looked up in the table rather than in a worker's cache; no count depends on them.
    """
    texts = pa.array([r["text"] for r in docs.filter(F.length("text") <= LONGEST).select("text").take(sample)], pa.string())
    own, totals = counter(path), {}
    for part in chunks(texts):
        found = own.pieces(part)[0]
        n = np.bincount(found.indices.to_numpy(), minlength=len(found.dictionary))
        for name, k in zip(found.dictionary.to_pylist(), n.tolist(), strict=True):
            totals[name] = totals.get(name, 0) + k
    names = sorted((k for k in totals if len(k) <= REMEMBERED), key=lambda k: (-totals[k], k))[:most]
    pool = pa.array(names, pa.binary())
    return pool, own.lengths(pool).astype(np.uint16)


def default_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def count_tokens(docs: DataFrame, path: str | None = None, limit: int = 512, sample: int = SAMPLE, most: int = FREQUENT) -> DataFrame:
    """All input columns and rows plus n_bytes, n_tokens and over_limit (with underscores behind a name that is taken).

    Counts are those of ``Tokenizer.encode(text, add_special_tokens=False)`` without truncation or padding, strings of
    special tokens counting as one token. Null and empty texts have 0 bytes and 0 tokens; texts of any length are read
    whole; repeated rows are counted alike; no other column is looked at, so null ids are no matter; an empty table
    gives an empty result.
    """
    spark = ready(docs.sparkSession)
    path = path or default_path()
    names, sizes = frequent_lengths(docs, path, sample, most)
    table = spark.sparkContext.broadcast((names, sizes))  # at most `most` pieces of at most REMEMBERED bytes

    @F.arrow_udf("bigint")
    def tokens(text: pa.Array) -> pa.Array:
        own = counter(path)
        return pa.array(np.concatenate([np.zeros(0, np.int64), *(own.count(part, table.value) for part in chunks(text))]))

    n_bytes, n_tokens, over = (free_name(docs.columns, c) for c in ("n_bytes", "n_tokens", "over_limit"))
    counted = docs.withColumns({n_bytes: F.coalesce(F.octet_length("text"), F.lit(0)).cast("long"), n_tokens: tokens("text")})
    return counted.withColumn(over, F.col(n_tokens) > limit)
