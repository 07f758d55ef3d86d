"""Subword ids of whole texts with a given tokenizer file, fast through per-word caching (runs inside Arrow tasks)."""

from __future__ import annotations

import os
import re
from functools import lru_cache

import numpy as np

from .words import Words

#: Words of these characters are composed, lower-cased and split alike by every library.
PLAIN = re.compile("[!-~À-ÖØ-öø-ÿ]+")
SPLIT = re.compile("'s|'t|'re|'ve|'m|'ll|'d|[a-zß-öø-ÿ]+|[0-9]|[^\\sa-zß-öø-ÿ0-9]+")


def byte_letters() -> dict[int, str]:
    """For Latin-1 characters: the printable stand-ins of their UTF-8 bytes, as byte-level vocabularies spell them."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in shown]
    letter = {b: chr(b) for b in shown} | {b: chr(256 + k) for k, b in enumerate(rest)}
    return {c: "".join(letter[b] for b in chr(c).encode()) for c in range(33, 256)}


class Encoder:
    """ids of texts, as ``Tokenizer.encode(text, add_special_tokens=False)`` gives them.

    The vocabulary this is for drops white space and never joins across it, so a text's ids are its words' ids in
    order. Words are looked up in a bounded cache; words outside PLAIN go through the whole tokenizer.
    """

    def __init__(self, path: str, cap: int = 400_000):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer, self.cap = Tokenizer.from_file(path), cap
        self.model, self.letters = self.tokenizer.model, byte_letters()
        self.known: dict[str, int] = {}
        self.marks: dict[str, list[int]] = {"": []}
        self.pool, self.used = np.empty(1 << 18, np.int32), 0

    def word(self, w: str) -> list[int]:
        core = w.rstrip(".,")
        if core.isalpha() and (core.isascii() or PLAIN.fullmatch(core)):  # one run of letters, perhaps with marks behind
            bare = core.lower()
            ids = [t.id for t in self.model.tokenize(bare if core.isascii() else bare.translate(self.letters))]
            if len(core) < len(w):
                tail = w[len(core) :]
                if tail not in self.marks:
                    if len(self.marks) > 1000:
                        self.marks = {"": []}
                    self.marks[tail] = [t.id for t in self.model.tokenize(tail)]
                ids += self.marks[tail]
            return ids
        if PLAIN.fullmatch(w) and "<|" not in w:
            out: list[int] = []
            for p in SPLIT.findall(w.lower()):
                out += [t.id for t in self.model.tokenize(p.translate(self.letters))]
            return out
        return self.tokenizer.encode(w, add_special_tokens=False).ids

    def encode(self, text, words: Words | None = None) -> tuple[np.ndarray, np.ndarray]:
        """Flat ids (int32) and the offsets of the documents in them; `words` are the texts' own, case kept, if at hand."""
        words = words or Words(text, lower=False)
        vocab = words.vocab.to_pylist()
        place = np.fromiter(map(self.known.get, vocab, [-1] * len(vocab)), np.int64, len(vocab))
        extra: list[int] = []
        base = self.used
        new: list[tuple[str, int]] = []
        for k in np.flatnonzero(place < 0).tolist():
            ids = self.word(vocab[k])
            at = (base + len(extra)) << 16 | len(ids) if len(ids) < 1 << 16 else -1
            if at < 0:  # one giant word: encoded with the batch only
                at = (base + len(extra)) << 16
                self.long = getattr(self, "long", {})
                self.long[k] = len(ids)
            elif len(self.known) + len(new) < self.cap and len(ids) <= 16:
                new.append((vocab[k], at))
            place[k] = at
            extra += ids
        more = np.array(extra, np.int32)
        flat = np.concatenate([self.pool[:base], more]) if base else more
        start, size = place >> 16, place & 0xFFFF
        for k, n in getattr(self, "long", {}).items():
            size[k] = n
        self.long = {}
        if new:
            kept = 0
            if base + len(more) > len(self.pool):
                self.pool = np.concatenate([self.pool[:base], np.empty(max(len(self.pool), len(more)), np.int32)])
            # what is remembered is packed to the front of the free space
            for w, at in new:
                s, n = (at >> 16) - base, at & 0xFFFF
                self.pool[base + kept : base + kept + n] = more[s : s + n]
                self.known[w] = (base + kept) << 16 | n
                kept += n
            self.used = base + kept
        n = size[words.codes] if len(words.codes) else np.zeros(0, np.int64)
        ends = np.concatenate([[0], np.cumsum(n)])
        ids = flat[np.repeat(start[words.codes] - ends[:-1], n) + np.arange(ends[-1])] if ends[-1] else np.zeros(0, np.int32)
        return ids, ends[words.offsets]


@lru_cache(maxsize=2)
def encoder(path: str) -> Encoder:
    """One encoder a worker process; its cache lives across tasks."""
    return Encoder(path)


@lru_cache(maxsize=8)
def vocabulary_size(path: str) -> int:
    from tokenizers import Tokenizer

    return Tokenizer.from_file(path).get_vocab_size()


def default_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")
