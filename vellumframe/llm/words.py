"""Batches of whole texts as flat numpy word arrays (runs inside Arrow tasks)."""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc


class Words:
    """Words of a batch: ``codes`` index ``vocab`` in reading order, document i owns codes[offsets[i]:offsets[i+1]].

    Words are maximal runs of bytes other than 0x20 and 0x09-0x0D. Null texts have none.
    """

    def __init__(self, text: pa.Array, lower: bool = True):
        if isinstance(text, pa.ChunkedArray):
            text = text.combine_chunks()
        text = pc.fill_null(text, "").take(pa.array(np.arange(len(text))))  # a copy of its own: some kernels misread slices
        if lower:
            text = pc.ascii_lower(text)
        split = pc.ascii_split_whitespace(text)
        offsets = split.offsets.to_numpy()
        found = split.values.slice(offsets[0], offsets[-1] - offsets[0]).dictionary_encode()
        offsets = offsets - offsets[0]
        codes, vocab = found.indices.to_numpy().astype(np.int64, copy=False), found.dictionary
        empty = pc.index(vocab, pa.scalar("", vocab.type)).as_py()
        if empty >= 0:
            keep = codes != empty
            offsets = np.concatenate([[0], np.cumsum(keep)])[offsets]
            codes = codes[keep]
        self.codes, self.vocab, self.offsets = codes, vocab, offsets
        self.counts = np.diff(offsets)

    def __len__(self) -> int:
        return len(self.counts)

    def docs(self) -> np.ndarray:
        """Index of the owning document, per word."""
        return np.repeat(np.arange(len(self.counts)), self.counts)

    def hashes(self, lower: bool = False) -> np.ndarray:
        """64-bit hash per vocabulary entry; depends on the word alone, lower-cased A-Z if asked."""
        values = (pc.ascii_lower(self.vocab) if lower else self.vocab).to_numpy(zero_copy_only=False)
        return pd.util.hash_array(values, categorize=False) if len(values) else np.zeros(0, np.uint64)


def mix(x: np.ndarray) -> np.ndarray:
    """The splitmix64 finaliser."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def shingle_sets(words: Words, size: int) -> list[np.ndarray]:
    """Sorted distinct hashes of each document's word shingles; a shorter text is one shingle, none without words."""
    step = np.uint64(0x9E3779B97F4A7C15)
    own = words.hashes()[words.codes] if len(words.codes) else np.zeros(0, np.uint64)
    n = len(own)
    whole = np.zeros(max(0, n - size + 1), np.uint64)
    for j in range(size):
        whole = whole * step + own[j : j + len(whole)]
    whole = mix(whole)
    sets = []
    for a, b in zip(words.offsets[:-1], words.offsets[1:], strict=True):
        if b - a >= size:
            sets.append(np.unique(whole[a : b - size + 1]))
        elif b > a:
            h = np.zeros(1, np.uint64)
            for w in own[a:b]:
                h = h * step + w
            sets.append(mix(h + np.uint64(b - a)))
        else:
            sets.append(np.zeros(0, np.uint64))
    return sets


def binary(arrays: list[np.ndarray]) -> pa.Array:
    """Arrow binary column of the arrays' little-endian bytes."""
    return pa.array([np.ascontiguousarray(a).tobytes() for a in arrays], pa.binary())


def batch(**columns) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([c if isinstance(c, pa.Array) else pa.array(c) for c in columns.values()], names=list(columns))


def pieces(batches, rows: int = 1024):
    """Split record batches so that a task holds few texts at once."""
    for b in batches:
        for k in range(0, b.num_rows, rows):
            yield b.slice(k, rows)
