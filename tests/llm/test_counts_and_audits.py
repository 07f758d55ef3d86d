"""Token counts, importance resampling and the filter audit against plain versions."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter
from itertools import permutations

import numpy as np
import pyarrow as pa
import pytest

from vellumframe.llm import filter_audit, importance, token_counts

ODD = ["", None, " ", "\n\n", "a  b", " lead", "trail  ", "it's we'll 'tis", "x  y　 z \u0085", "<|endoftext|>", "one<|endoftext|><|endoftext|> two <|endoftext", "3rd 42a a42", "naïve éclair, über", "word " * 30_000, "w" * 30_000, "中文 字符。", "\x1c\x1d a\x00b"]


def frame(spark, rows):
    return spark.createDataFrame(rows, "doc_id long, text string, source string")


def library():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(token_counts.default_path())


def test_pieces_count_as_whole_texts():
    whole, rng = library(), random.Random(7)
    letters = [*"ab1'sStl .,\n\t\r\x0b\x1c\x85\xa0 　éß中٣-_́\U0001f600", "<|endoftext|>", "'ll", " 's", "  ", "<|endof"]
    texts = ["".join(rng.choice(letters) for _ in range(rng.randrange(30))) for _ in range(3000)] + ODD
    want = [len(whole.encode(t or "", add_special_tokens=False).ids) for t in texts]
    own = token_counts.Counter(token_counts.default_path())
    for table in (None, (pa.array([b" a", b"word", b" word"], pa.binary()), np.array([1, 1, 1], np.uint16))):
        assert np.concatenate([own.count(p, table) for p in token_counts.chunks(pa.array(texts))]).tolist() == want


def test_cache_starts_anew(monkeypatch):
    monkeypatch.setattr(token_counts, "CACHE", 10)
    own, whole = token_counts.Counter(token_counts.default_path()), library()
    text = " ".join(f"w{k} x{k}y" for k in range(200))
    assert own.count(pa.array([text, text]), None).tolist() == [len(whole.encode(text).ids)] * 2
    assert len(own.known) <= 10


def test_other_vocabularies_are_refused():
    import public_tokenizers

    with pytest.raises(ValueError):
        token_counts.Counter(public_tokenizers.path("word_bpe_49k.json"))


def test_token_counts_of_a_table(spark):
    whole = library()
    rows = [(k, t, None) for k, t in enumerate(ODD)] + [(None, "null id", "s"), (3, ODD[3], None), (900, "many words " * 300, "s")]
    docs = frame(spark, rows).selectExpr("*", "1 as N_TOKENS", "2 as over_limit")
    got = token_counts.count_tokens(docs, limit=512)
    assert got.columns == [*docs.columns, "n_bytes", "n_tokens_", "over_limit_"]
    out = got.collect()
    assert len(out) == len(rows)
    for r in out:
        n = len(whole.encode(r["text"] or "", add_special_tokens=False).ids)
        assert (r["n_bytes"], r["n_tokens_"], r["over_limit_"]) == (len((r["text"] or "").encode()), n, n > 512)
    assert token_counts.count_tokens(docs.limit(0)).collect() == []
    assert [r["n_tokens"] for r in token_counts.count_tokens(frame(spark, [(1, None, None)])).collect()] == [0]


def words_of(text):
    lower = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lower)


def features_of(text):
    w = words_of(text)
    return [zlib.crc32(g.encode()) % 10000 for g in [*w, *(f"{a} {b}" for a, b in zip(w, w[1:], strict=False))]]


def drawn(docs, target):
    s = Counter(b for _, t in docs for b in features_of(t))
    t = Counter(b for x in target for b in features_of(x))
    S, T = sum(s.values()), sum(t.values())
    gain = {b: math.floor(1000 * math.log((t[b] + 1) * (S + 10000) / ((s[b] + 1) * (T + 10000)))) for b in range(10000)}
    rows = []
    for i, text in docs:
        f = features_of(text)
        weight = sum(gain[b] for b in f) // len(f) if f else 0
        h = int(hashlib.sha256(f"7:{'' if i is None else i}".encode()).hexdigest()[:8], 16)
        rows.append((i, len(f), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), len(words_of(text))))
    order = sorted((r for r in rows if r[4] >= 20), key=lambda r: (-r[3], r[0] is None, r[0] or 0))
    rank = {r[0]: k for k, r in enumerate(order[: 25 * len(order) // 100], 1)}
    return [(*r[:4], rank.get(r[0])) for r in rows]


def test_checksums_chain():
    for a, b in [(b"x", b" y"), (b"", b" " + b"z" * 64), (b"ab" * 9, b" \xc3\xa9")]:
        assert int(importance.followed(np.array([zlib.crc32(a)], np.uint32), np.array([len(b)]))[0]) ^ zlib.crc32(b) == zlib.crc32(a + b)


def test_batches_keep_documents_apart():
    rng = random.Random(5)
    texts = ["one", "", None, "Two three", "é È a-b\x00c\x7fd", "a" * 70 + " " + "b" * 200 + " c", "x", "last one"] + [" ".join(rng.choice(["foo", "Bar", "bäz", "q"]) for _ in range(rng.randrange(6))) for _ in range(200)]
    for part in (texts, texts[:1], [None], [""], ["", "a b", ""]):
        got = importance.Features([t.encode() if t else None for t in part])
        want = Counter(b for t in part for b in features_of(t))
        counts = got.counts(10000)
        assert {b: int(counts[b]) for b in np.flatnonzero(counts)} == dict(want)
        n, total = got.sums(np.arange(10000))
        assert n.tolist() == [len(words_of(t)) for t in part] and total.tolist() == [sum(features_of(t)) for t in part]


def test_resampling_of_a_table(spark, monkeypatch):
    monkeypatch.setattr(importance, "CHUNK", 200)
    rng = random.Random(9)
    vocab = ["alpha", "Beta", "gamma", "delta9", "été", "x"]
    docs = [(k, " ".join(rng.choice(vocab) for _ in range(rng.randrange(60)))) for k in range(200)]
    docs += [(500, None), (501, ""), (502, "?!"), (None, "alpha " * 30), (503, "word gamma " * 20_000), (504, docs[0][1])]
    target = ["gamma alpha " * 5, None, "", "zeta"]
    bench = spark.createDataFrame([(str(k), t) for k, t in enumerate(target)], "item_id string, text string")
    df = frame(spark, [(i, t, "s") for i, t in docs]).selectExpr("*", "'mine' as weight", "0 as _part").repartition(5)
    got = importance.resample(df, bench)
    assert got.columns == ["doc_id", "source", "weight", "_part", "n_features", "n_words", "weight_", "score", "rank"]
    key = lambda r: (r[0] is None, r[0] or 0)
    assert sorted(((r["doc_id"], r["n_features"], r["weight_"], r["score"], r["rank"]) for r in got.collect()), key=key) == sorted(drawn(docs, target), key=key)
    assert importance.resample(df.limit(0), bench).collect() == []
    none = importance.resample(df, bench.limit(0)).select("doc_id", "n_features", "weight_", "score", "rank").collect()
    assert sorted(map(tuple, none), key=key) == sorted(drawn(docs, []), key=key)


def test_equal_scores_go_by_id(spark):
    df = frame(spark, [(k % 3, "a " * 30, None) for k in range(12)])
    got = importance.resample(df, df.limit(0).select("text"))
    best = max(r["score"] for r in got.collect())
    assert sorted((r["rank"], r["score"]) for r in got.filter("rank is not null").collect()) == [(k, best) for k in (1, 2, 3)]


def fails(docs):
    out = []
    for i, text, _ in docs:
        t = text or ""
        w = re.findall(r"[^\x20\x09-\x0D]+", t)
        ids = [j for j, u, _ in docs if (u or "") == t and j is not None]
        first = min(ids) if ids else None
        later = first is not None and (i is None or i > first)
        out.append([len(w) < 50, 100 * len(set(w)) < 65 * len(w), 100 * len(re.findall("[A-Z]", t)) > 5 * len(t), bool(re.search(r"[#$%&*|]", t)), later])
    return out


def audited(docs, labels):
    found, out = fails(docs), {}
    good, toxic = ({r[0] for r in labels if r[k] == 1 and r[0] is not None} for k in (1, 2))  # a null id meets no label
    for part in {d[2] or "" for d in docs}:
        own = [(d[0], f) for d, f in zip(docs, found, strict=True) if (d[2] or "") == part]
        shapley = Counter()
        rows = {}
        for order in permutations(range(5)):
            left = own
            name = "".join("ABCDE"[k] for k in order)
            for step, k in enumerate(order, 1):
                gone = [x for x in left if x[1][k]]
                left = [x for x in left if not x[1][k]]
                shapley[k] += len(gone)
                rows[part, name, step] = [len(left), len(gone), sum(x[1][k] for x in own) - len(gone), sum(x[1][k] and sum(x[1]) == 1 for x in own), sum(x[0] in good for x in gone), sum(x[0] in toxic for x in gone), k]
        out |= {key: (*v[:6], shapley[v[6]]) for key, v in rows.items()}
    return out


def test_gray_code_walk_equals_sums_of_subsets():
    rng = np.random.default_rng(3)
    cells = rng.integers(0, 9, (4, 32, 3))
    left = filter_audit.survivors(cells)
    for subset in range(32):
        assert (left[:, subset] == cells[:, [m for m in range(32) if not m & subset]].sum(axis=1)).all()


def test_audit_of_a_table(spark):
    rng = random.Random(4)
    docs = []
    for k in range(150):
        w = [rng.choice("abcdefghij") * rng.randrange(1, 9) for _ in range(rng.choice([3, 49, 50, 60]))]
        w += [rng.choice(["#", "&x", "LOUD" * 9, "ok", "ok"])] * rng.randrange(2)
        docs.append((k, " ".join(w), rng.choice(["web", "book", None, ""])))
    docs += [(200, None, "web"), (201, "", "book"), (None, docs[0][1], "web"), (None, "only null ids", None), (None, "only null ids", "web"), (5, docs[5][1], "web"), (150, docs[5][1], "xé"), (202, "Tab\t\x0bword " * 20_000, "web")]
    docs += [(300 + k, docs[7][1], "copies") for k in range(40)]
    labels = [(k, k % 2, k % 3 % 2) for k in range(0, 320, 2)] + [(5, 0, 1), (5, 1, None), (None, 1, 1), (9999, 1, 1)]
    lab = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    df = frame(spark, docs).selectExpr("*", "1 as mask", "2 as part", "3 as first").repartition(4)
    got = filter_audit.audit(df, lab)
    found = {(r["part"], r["filter_order"], r["step"]): tuple(r[c] for c in filter_audit.COUNTS) for r in got.collect()}
    want = audited(docs, labels)
    assert len(found) == len(want) == got.count() and found == want
    assert filter_audit.audit(df.limit(0), lab).collect() == []
    assert len(filter_audit.audit(df, lab.limit(0)).filter("good_lost + toxic_lost > 0").collect()) == 0
