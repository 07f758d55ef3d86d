"""The pipeline's stages over a small table: each decision takes effect, and every stage's rows equal a plain version's:
the trained models applied text by text, shingle sets compared pair by pair, SQL for the mix, ids cut by hand."""

import re
import zlib

import duckdb
import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from vellumframe.llm import languages, toxicity
from vellumframe.llm.queries import OP8_SQL


def plain_near(rows):
    """rows without those that have a smaller doc_id in their group: five-word shingles, similarity 0.8, pair by pair."""
    cut = lambda t: [x for x in re.split("[\x20\x09-\x0d]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or "")) if x]
    sets = {}
    for r in rows:
        w = cut(r["text"])
        sets[r["doc_id"]] = {tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set()
    up = {i: i for i in sets}

    def root(i):
        while up[i] != i:
            i = up[i]
        return i

    ids = sorted(sets)
    for k, a in enumerate(ids):
        for b in ids[k + 1 :]:
            both = len(sets[a] & sets[b])
            if both and 100 * both >= 80 * len(sets[a] | sets[b]):
                x, y = sorted((root(a), root(b)))
                up[y] = x
    return [r for r in rows if root(r["doc_id"]) == r["doc_id"]]


def plain_pieces(rows):
    """(doc_id, piece, start, length, ids_crc32) of all pieces, in order."""
    import public_tokenizers
    from tokenizers import Tokenizer

    whole, out = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json")), []
    for r in rows:
        ids = [*whole.encode(r["text"] or "", add_special_tokens=False).ids, 0]
        for k in range(0, len(ids), 2048):
            part = ids[k : k + 2048]
            out.append((r["doc_id"], k // 2048, k, len(part), zlib.crc32(np.array(part, "<u4").tobytes())))
    return sorted(out)


def test_every_stage_equals_a_plain_version(spark, tmp_path):
    corpus_pipeline = pytest.importorskip("corpus_pipeline")
    rng = np.random.default_rng(12)
    syllables = "ba ko mi tu ren sol var dig pel nu".split()
    words = {lang: ["".join(rng.choice(syllables, 2)) + end for _ in range(150)] for lang, end in (("en", "ing"), ("fr", "eau"))}
    rows = []
    for i in range(260):
        lang = ("en", "fr")[i % 2]
        t = list(rng.choice(words[lang], int(rng.integers(20, 80))))
        if i % 7 == 0:
            t[:3] = ["vilefoo", "vilebar", "grumpex"]
        rows.append((i, " ".join(t), lang, f"s{i % 3}" if i % 5 else None))
    rows += [(400 + i, rows[3 * i + 1][1] + (" tail" if i % 2 else ""), "en", "s1") for i in range(30)]
    rows += [(500, " ".join(rng.choice(words["en"], 5000)), "en", "s0"), (501, "77 88", "en", "s1"), (502, None, None, None), (503, "", "fr", "s2")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")
    labels = spark.createDataFrame([(i, 1, int(i % 7 == 0)) for i in range(260)], "doc_id long, quality int, toxic int")
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    labels.write.parquet(str(tmp_path / "labels.parquet"))
    key = lambda r: tuple((x is None, str(x)) for x in r)
    before = docs
    for name, stage in corpus_pipeline.STAGES:
        stage(spark, before, str(tmp_path)).write.parquet(str(tmp_path / name))
        after, given = spark.read.parquet(str(tmp_path / name)), before.collect()
        got = sorted(map(tuple, after.collect()), key=key)
        if name == "toxicity":
            model = toxicity.train(before, labels)
            want = [r for r in given if model.score(pa.array([r["text"]], pa.string()))[0] < 0.7]
        elif name == "language":
            field = languages.train(before)
            said = [languages.predict(pa.array([r["text"]], pa.string()), field) for r in given]
            want = [r for r, (lang, sure) in zip(given, said, strict=True) if lang[0] != "und" and sure[0] >= corpus_pipeline.LEAST_LANGUAGE]
        elif name == "near_duplicate":
            want = plain_near(given)
        elif name == "mixing":
            con = duckdb.connect()
            con.register("documents", before.toPandas())
            taken = {r[0]: (r[1], r[2]) for r in con.execute(f"SELECT doc_id, size, taken FROM ({OP8_SQL})").fetchall()}
            want = [r for r in given for _ in range(-(-taken[r["doc_id"]][1] // max(1, taken[r["doc_id"]][0])))]
        else:
            pieces = after.collect()
            got, want = sorted(tuple(r)[:5] for r in after.select("doc_id", "piece", "start", "length", "ids_crc32").collect()), plain_pieces(given)
            room = {}
            for r in sorted(pieces, key=lambda r: (r["sequence_id"], r["offset"])):
                assert r["offset"] == room.get(r["sequence_id"], 0)
                room[r["sequence_id"]] = r["offset"] + r["length"]
            assert max(room.values()) <= 2048 and len(room) == -(-sum(r["length"] for r in pieces) // 2048)
        assert len(want) < len(given) or name in ("mixing", "packing")
        assert got == (want if name == "packing" else sorted(map(tuple, want), key=key)), name
        before = after


def test_stages(spark, tmp_path):
    corpus_pipeline = pytest.importorskip("corpus_pipeline")
    rng = np.random.default_rng(1)
    words = np.array("alder basil cumin dill endive fennel garlic hyssop iris juniper kale lemon mint nettle onion parsley quince rue sage thyme".split())
    words = np.array([a + b for a in words for b in words])
    rows = []
    for i in range(300):
        t = rng.choice(words, 40).astype(object)
        if i % 6 == 0:
            t[:3] = ["vilefoo", "vilebar", "grumpex"]
        rows.append((i, " ".join(t), "en", f"s{i % 4}", 0))
    rows += [(400 + i, rows[i * 6 + 1][1] + " tail", "en", "s1", 0) for i in range(20)] + [(500, "123 456", "en", "s0", 0), (501, None, None, None, None), (None, "alder basil cumin mint sage rue", "en", None, 0)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    labels = spark.createDataFrame([(i, 1, int(i % 6 == 0)) for i in range(300)], "doc_id long, quality int, toxic int")
    labels.write.parquet(str(tmp_path / "labels.parquet"))
    cur, seen = docs, {}
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, cur, str(tmp_path))
        if name != "packing":
            assert out.columns == docs.columns
        out.write.parquet(str(tmp_path / name))
        cur = seen[name] = spark.read.parquet(str(tmp_path / name))
    ids = {n: [r["doc_id"] for r in seen[n].select("doc_id").collect()] for n in seen}
    clean = {i for i in range(300) if i % 6} | set(range(400, 420)) | {500, 501, None}
    assert set(ids["toxicity"]) == clean
    assert set(ids["language"]) == clean - {500, 501}
    assert set(ids["near_duplicate"]) == clean - {500, 501} - set(range(400, 420)) and len(ids["near_duplicate"]) == len(set(ids["near_duplicate"]))
    assert set(ids["mixing"]) <= set(ids["near_duplicate"]) and max(ids["mixing"].count(i) for i in set(ids["mixing"])) <= 3
    pieces = seen["packing"].groupBy("doc_id").count().collect()
    assert {r["doc_id"]: r["count"] for r in pieces} == {i: ids["mixing"].count(i) for i in set(ids["mixing"])}
    assert corpus_pipeline.run(spark, str(tmp_path)).agg(F.sum("length")).first()[0] == seen["packing"].agg(F.sum("length")).first()[0]


def test_odd_tables(spark, tmp_path):
    """Empty tables, clashing columns, very long, repeated and equally named rows go through every stage."""
    corpus_pipeline = pytest.importorskip("corpus_pipeline")
    rng = np.random.default_rng(3)
    syllables = "ba ko mi tu ren sol var dig pel nu".split()
    say = lambda n: " ".join("".join(rng.choice(syllables, 3)) for _ in range(n))
    one, other = say(50), say(50)
    rows = [(i, say(60), "en", "s") for i in range(40)]
    rows += [(100, say(30_000), "en", "s"), (101, one, "en", "s"), (101, one, "en", "s"), (101, other, "en", "s"), (102, one, "en", None), (-5, say(50), None, "t"), (None, say(50), "en", "t"), (None, say(50), "en", "t"), (103, "", None, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")
    for c in ("_key", "_n", "Score", "predicted", "lang_pred", "kept", "size"):
        docs = docs.withColumn(c, F.lit("x"))
    spark.createDataFrame([(0, 1, 0)], "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    cur = docs
    for name, stage in corpus_pipeline.STAGES[:4]:
        out = stage(spark, cur, str(tmp_path))
        assert out.columns == docs.columns
        out.write.parquet(str(tmp_path / name))
        cur = spark.read.parquet(str(tmp_path / name))
        assert {tuple(r)[4:] for r in cur.collect()} == {("x",) * 7}
        if name == "near_duplicate":
            left = sorted((r["doc_id"] is None, r["doc_id"] or 0, r["text"]) for r in cur.collect())
            same = {(False, 101, one), (False, 102, one)}  # one of these stays, whichever has the smaller key
            assert len(left) == len(set(left)) and len(same & set(left)) == 1
            assert set(left) - same == {(d is None, d or 0, t) for d, t, *_ in rows if t} - same
        assert stage(spark, docs.limit(0), str(tmp_path)).count() == 0
    assert corpus_pipeline.packing(spark, docs.limit(0), str(tmp_path)).count() == 0
