"""The cached encoder gives the tokenizer's ids for any text."""

import pyarrow as pa
from hypothesis import given, settings
from hypothesis import strategies as st

from vellumframe.llm.subwords import Encoder, default_path

ENC = Encoder(default_path(), cap=40)
PIECES = st.sampled_from(["a", "B", "é", "É", "ß", "ñ", "'s", "'LL", "’", " ", "\t", "\n", "\x0b", "\x1c", "\x85", "\xa0", " ", "́", "̌", "J", "ﬁ", "İ", "Σ", "ς", "1", "²", "½", "ª", "µ", ".", ",", "...", "-", "_", "<|", "|>", "<|endoftext|>", "日", "🙂", "‍", "﻿", "Ǆ", "ÿ", "Ÿ", "×"])


@settings(max_examples=400, deadline=None)
@given(st.lists(st.one_of(st.lists(PIECES, max_size=12).map("".join), st.text(max_size=20)), min_size=1, max_size=4))
def test_ids(texts):
    texts = [t.encode("utf-8", "ignore").decode() for t in texts]
    ids, off = ENC.encode(pa.array(texts, pa.string()))
    assert [ids[a:b].tolist() for a, b in zip(off[:-1], off[1:])] == [e.ids for e in ENC.tokenizer.encode_batch(texts, add_special_tokens=False)]
