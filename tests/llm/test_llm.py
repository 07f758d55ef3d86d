"""The training-data operators against brute force, round trips and held-out labels, with edge cases for each."""

import math
import re
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from vellumframe.llm import attention, hyperminhash, languages, mixing, packing, projections, quantise, quotations, toxicity, wavelet
from vellumframe.llm.components import connected_components
from vellumframe.llm.subwords import Encoder, default_path
from vellumframe.llm.words import Words

SPLIT = re.compile("[\x20\x09-\x0d]+")
LOWER = {i: i + 32 for i in range(65, 91)}


def frame(spark, rows, extra=False):
    """documents with nulls; with `extra`, columns whose names clash with those the operators add."""
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")
    if extra:
        for c in ("Score", "predicted", "held_out", "lang_pred", "length", "component_id", "kept", "size", "words", "row", "sequence_id"):
            df = df.withColumn(c, F.lit("x"))
    return df


WORDS = "amber birch cedar delta ember fjord grove heron inlet jetty knoll larch maple north ocean pearl quartz river stone tulip umber vale willow xenon yarrow zephyr".split()


def text(rng, n, words=WORDS):
    return " ".join(rng.choice(words, n))


@pytest.fixture(scope="module")
def docs():
    rng = np.random.default_rng(1)
    rows = [(i, text(rng, int(rng.integers(1, 60))), "en", f"s{i % 3}") for i in range(60)]
    rows += [(100 + i, rows[i][1], "en", "s0") for i in range(20)]
    near = text(rng, 200).split()
    for i in range(12):
        w = list(near)
        w[int(rng.integers(200))] = "edited"
        rows.append((200 + i, " ".join(w), "en", None))
    rows += [(300, None, None, None), (301, "", "en", "s1"), (302, " \t\n", "en", "s1"), (None, "no id here", "en", "s2"), (303, "One", "en", "s2"), (304, "one", "en", "s2"), (305, "long " * 30_000, "en", "s2"), (5, rows[5][1], "en", "s2")]
    return rows


def shingles(t, k):
    w = [x for x in SPLIT.split((t or "").translate(LOWER)) if x]
    return {tuple(w[i : i + k]) for i in range(len(w) - k + 1)} if len(w) >= k else ({tuple(w)} if w else set())


def roots(n, edges):
    up = {i: i for i in n}

    def find(x):
        while up[x] != x:
            x = up[x]
        return x

    for a, b in edges:
        x, y = find(a), find(b)
        up[max(x, y)] = min(x, y)
    return {i: find(i) for i in n}


def test_near_duplicates_against_brute_force(spark, docs):
    got = hyperminhash.near_duplicates(frame(spark, docs, extra=True), 3, 85).collect()
    assert len(got) == len(docs)
    sets = {d: shingles(t, 3) for d, t, _, _ in docs if d is not None}
    ids = sorted(sets)
    links = [(a, b) for i, a in enumerate(ids) for b in ids[i + 1 :] if sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= 85 * len(sets[a] | sets[b])]
    want = roots(ids, links)
    for r in got:
        if r["doc_id"] is None:
            assert r["component_id"] is None and r["kept"]
        else:
            assert (r["component_id"], r["n_shingles"]) == (want[r["doc_id"]], len(sets[r["doc_id"]])) and r["kept"] == (want[r["doc_id"]] == r["doc_id"])
    assert hyperminhash.near_duplicates(frame(spark, [])).count() == 0


def test_register_estimates_are_near_the_truth():
    rng = np.random.default_rng(2)
    both = rng.integers(0, 2**63, 3000).astype(np.uint64)
    a, b = both[:2700], both[300:]
    k = 600
    j, used = hyperminhash.estimate(hyperminhash.registers([a], k), hyperminhash.registers([b], k), np.array([2700.0]), np.array([2700.0]))
    assert abs(j[0] - 2400 / 3000) < 0.08 and used[0] > 580


def test_components(spark):
    edges = [(i, i + 1) for i in range(30)] + [(50, 60), (60, 55), (70, 70)]
    got = {r["v"]: r["component"] for r in connected_components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {**{i: 0 for i in range(31)}, 50: 50, 55: 50, 60: 50}


def test_encoder_equals_the_tokenizer():
    enc = Encoder(default_path(), cap=50)
    odd = ["It's DON'T café ÉCOLE", "<|endoftext|> x <|ENDOFTEXT|>", "J̌ á ǅ ß² 1234 ½", "Σας ΟΔΟΣ", "日本語 テスト", "a\tb\x0bc\x1cd\x85e\xa0f", "!!!---??? a.,. b.", "", " ", "ª µ º ÿ Ÿ", "don't stop.... e.g., x,y", "﻿bom ‍zwj"]
    for _ in range(2):
        ids, off = enc.encode(pa.array([*odd, None]))
        want = [e.ids for e in enc.tokenizer.encode_batch([*odd, ""], add_special_tokens=False)]
        assert [ids[a:b].tolist() for a, b in zip(off[:-1], off[1:])] == want


def test_packing_places_every_piece_once(spark, docs):
    got = packing.pack_documents(frame(spark, docs, extra=True)).collect()
    enc = Encoder(default_path())
    spans = {}
    for r in got:
        spans.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for s in spans.values():
        at = 0
        for offset, length in sorted(s):
            assert offset == at
            at += length
        assert at <= 2048
    want = Counter()
    for d, t, _, _ in docs:
        ids = [*enc.tokenizer.encode(t or "", add_special_tokens=False).ids, 0]
        for p in range(0, len(ids), 2048):
            part = np.array(ids[p : p + 2048], "<u4")
            want[d, p // 2048, p, len(part), zlib.crc32(part.tobytes())] += 1
    assert Counter((r["doc_id"], r["piece"], r["start"], r["length"], r["ids_crc32"]) for r in got) == want
    total = sum(r["length"] for r in got)
    assert len(spans) <= math.ceil(total / 2048) + 1
    assert packing.pack_documents(frame(spark, [])).count() == 0


@pytest.mark.parametrize("seed", range(6))
def test_bin_completion_is_no_worse_than_best_fit(seed):
    rng = np.random.default_rng(seed)
    counts = Counter(rng.integers(1, 101, int(rng.integers(1, 200))).tolist())
    plan, plain = packing.bin_completion(dict(counts), 100), packing.best_fit(dict(counts), 100)
    for p in (plan, plain):
        used = Counter()
        for times, items in p:
            assert times > 0 and sum(k * n for k, n in items) <= 100
            for k, n in items:
                used[k] += n * times
        assert used == counts
    size = sum(t for t, _ in plan)
    assert packing.lower_bound(dict(counts), 100) <= size <= sum(t for t, _ in plain)


def test_bin_completion_beats_best_fit_where_it_can():
    counts = {60: 1, 50: 1, 40: 1, 30: 2, 20: 2, 10: 1, 25: 4, 15: 1}
    assert sum(t for t, _ in packing.bin_completion(counts, 100)) == packing.lower_bound(counts, 100)


def test_bin_completion_fills_with_many_pieces():
    lengths = (441, 389, 332, 444, 442, 399, 394, 382, 307, 294, 272, 230, 358, 244, 309, 309, 346, 252)
    counts = {k: 1000 * n for k, n in Counter(lengths).items()}
    plan, used = packing.bin_completion(counts, 2048), Counter()
    for times, items in plan:
        assert times > 0 and sum(k * n for k, n in items) <= 2048
        for k, n in items:
            used[k] += n * times
    assert used == counts and sum(t for t, _ in plan) < 0.98 * sum(t for t, _ in packing.best_fit(counts, 2048))


def test_fillings_are_all_undominated_ones():
    rng = np.random.default_rng(14)
    for _ in range(20):
        free = np.bincount(rng.integers(3, 30, 7), minlength=41)
        found = {w for w in packing.fillings(free, 40, 40) if w is not None}
        items = np.repeat(np.arange(41), free).tolist()
        best = max(sum(x for k, x in enumerate(items) if m >> k & 1) for m in range(1 << 7) if sum(x for k, x in enumerate(items) if m >> k & 1) <= 40)
        assert max(map(sum, found)) == best and all(not Counter(w) - Counter(items) and sum(w) <= 40 for w in found)


def test_wavelet_matrix():
    rng = np.random.default_rng(3)
    x = np.concatenate([rng.integers(0, 50_000, 3000), np.full(500, 7)]).astype(np.uint32)
    rng.shuffle(x)
    m, ids, known, sizes = wavelet.from_bytes(wavelet.to_bytes(wavelet.WaveletMatrix.build(x, 16), np.array([3, 4]), np.array([1, 0]), np.array([1000, 2500])))
    assert (m.values() == x).all() and ids.tolist() == [3, 4] and known.tolist() == [True, False] and sizes.tolist() == [1000, 2500]
    for v in (7, int(x[10]), 49_999, 65_000):
        assert m.count(v) == (x == v).sum() and m.occurrences(v).tolist() == np.flatnonzero(x == v).tolist() and m.rank(v, 1234) == (x[:1234] == v).sum()
    assert [m.access(i) for i in (0, 5, 3499)] == x[[0, 5, 3499]].tolist() and m.select(7, 2) == np.flatnonzero(x == 7)[2]
    with pytest.raises(IndexError):
        m.select(7, 10_000)
    ends = rng.integers(0, 3501, 50)
    assert m.ranks(7, ends).tolist() == [(x[:e] == 7).sum() for e in ends]
    empty = wavelet.WaveletMatrix.build(np.zeros(0, np.uint32), 16)
    assert len(empty.values()) == 0


def test_look_ups_inflate_only_what_they_touch():
    x = np.random.default_rng(23).integers(0, 4, 3_000_000).astype(np.uint32)
    m, *_ = wavelet.from_bytes(wavelet.to_bytes(wavelet.WaveletMatrix.build(x, 2), np.zeros(0), np.zeros(0), np.zeros(0)))
    assert m.access(1_234_567) == x[1_234_567] and m.rank(3, 200_000) == (x[:200_000] == 3).sum() and m.select(2, 5) == np.flatnonzero(x == 2)[5]
    assert sum(p.inflated for p in m.planes) <= 8 < sum(len(p.chunks) for p in m.planes)


def test_token_files_round_trip(spark, docs):
    enc = Encoder(default_path())
    files = wavelet.write_tokens(frame(spark, docs, extra=True), "test", shard_tokens=500)
    assert files.count() > 3
    got = sorted(wavelet.read_documents(files).collect(), key=lambda r: r["start"])
    at = 0
    for r, (d, t, _, _) in zip(got, sorted(docs, key=lambda x: (x[0] is not None, x[0] or 0, x[1] or ""))):
        ids = np.array([*enc.tokenizer.encode(t or "", add_special_tokens=False).ids, 1], "<u4")
        assert (r["doc_id"], r["start"], r["n_tokens"], r["ids_crc32"], r["n_ends"]) == (d, at, len(ids), zlib.crc32(ids.tobytes()), (ids == 1).sum())
        at += len(ids)
    amber = enc.tokenizer.encode("amber", add_special_tokens=False).ids
    hits = {}
    for r in wavelet.look_up(files, amber[0]).collect():
        hits[r["doc_id"]] = hits.get(r["doc_id"], 0) + r["n"]
    assert hits.get(3, 0) == enc.tokenizer.encode(docs[3][1], add_special_tokens=False).ids.count(amber[0])
    assert wavelet.read_documents(wavelet.write_tokens(frame(spark, []), "none")).count() == 0


def test_quotations_link_and_order(spark):
    rows = [
        (1, 0, "u", "Hello there.\nHow do I sort a list?"), (1, 1, "a", "On Monday u wrote:\n> How do I  sort a LIST?\nUse sorted()."),
        (1, 2, "u", "> > How do I sort a list?\n> Use sorted().\n\nThanks"), (1, 3, "x", "> Hello there.\nHi!"), (2, 0, "u", "plain"), (2, 1, "a", None),
        (2, 2, "b", "> How do I sort a list?\n> plain\nok"), (2, 3, "b", "> never said\n>\nhm"), (None, None, "q", ">\n> "), (-1, 0, "u", "minus one"), (None, 1, "q", "> minus one"), (7, 5, "z", "far " * 20_000), (7, 6, "z", "> " + "far " * 20_000), (1, 3, "x", "> Hello there.\nHi!"),
    ]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    got = quotations.link_quotations(df.withColumn("body", F.lit("x")).withColumn("msg", F.lit("x")).withColumn("level", F.lit("x"))).collect()
    assert len(got) == len(rows)
    by = {(r["conv_id"], r["turn"]): r for r in got}
    assert by[1, 1]["parent_turn"] == 0 and by[1, 1]["body"] == "Use sorted()." and by[1, 2]["parent_turn"] == 1 and by[1, 2]["max_level"] == 2 and by[1, 2]["n_linked"] == 2
    assert by[None, 1]["n_linked"] == 0 and by[None, 1]["n_elsewhere"] == 1 and by[7, 6]["parent_turn"] == 5 and by[None, 1]["position"] + by[None, None]["position"] == 1
    assert by[1, 3]["parent_turn"] == 0 and by[1, 2]["thread_turn"] == 0 and by[2, 2]["parent_turn"] == 0 and by[2, 3]["n_linked"] == 0 and by[2, 3]["n_quotes"] == 1
    for conv in (1, 2):
        own = sorted((r for r in got if r["conv_id"] == conv), key=lambda r: r["position"])
        assert [r["position"] for r in own] == list(range(len(own)))
        place = {r["turn"]: r["position"] for r in reversed(own)}
        assert all(place[r["parent_turn"]] < r["position"] for r in own if r["parent_turn"] is not None)
    assert quotations.link_quotations(df.limit(0)).count() == 0
    import duckdb

    from vellumframe.llm.queries import OP3_SQL

    conversations = pa.table({c: [r[i] for r in rows] for i, c in enumerate(df.columns)})  # noqa: F841  read by the SQL
    names = [d[0] for d in duckdb.execute(OP3_SQL).description]
    want = Counter(duckdb.execute(OP3_SQL).fetchall())
    assert Counter(tuple(r[n] for n in names) for r in got) == want


def test_toxicity_on_held_out_rows(spark):
    rng = np.random.default_rng(5)
    many = [a + b for a in WORDS for b in WORDS]
    rows, labels = [], []
    for i in range(600):
        t = text(rng, 30, many).split()
        if i % 5 == 0:
            for w in rng.choice(["vilefoo", "vilebar", "grumpex"], 3):
                t[int(rng.integers(30))] = str(w)
        rows.append((i, " ".join(t), "en", "s"))
        if i % 2 == 0:
            labels.append((i, 1, int(i % 5 == 0)))
    rows += [(9000, None, None, None), (9001, "", None, None), (None, "vilefoo vilebar", None, None), (9002, "vilefoo grumpex vilebar " * 5000, None, None)]
    lab = spark.createDataFrame([*labels, (5, None, None), (4, 1, 0)], "doc_id long, quality int, toxic int")
    got = toxicity.score(frame(spark, rows), lab).collect()
    assert len(got) == len(rows) and all(0 <= r["score"] <= 1 for r in got)
    by = {r["doc_id"]: r for r in got}
    assert sum(by[i]["predicted"] == int(any(w in by[i]["text"] for w in ("vile", "grump"))) for i in range(600)) >= 590
    assert by[9002]["predicted"] == 1 and by[9000]["predicted"] == 0 and not by[None]["held_out"]
    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 3 == 1) for r in got if r["doc_id"] is not None)
    assert {r["score"] for r in toxicity.score(frame(spark, rows[:5]), lab.limit(0)).collect()} == {0.0}
    clash = toxicity.score(frame(spark, rows[:9], extra=True), lab)
    assert {(r["Score"], r["predicted"], r["held_out"]) for r in clash.collect()} == {("x", "x", "x")} and {"score_", "predicted_", "held_out_"} <= set(clash.columns)
    assert toxicity.score(frame(spark, [], extra=True), lab).count() == 0


def test_fitting_samples_take_usable_texts_only(spark):
    """Null, blank and over-long texts do not take the places of usable ones, whatever their hashes."""
    rng = np.random.default_rng(41)
    say = lambda words: " ".join(rng.choice(words, 30))
    french, english = [a + "eau" for a in WORDS], [a + "ing" for a in WORDS]
    hashes = {r["id"]: r["h"] for r in spark.range(2400).select("id", F.xxhash64(F.lit(9), "id").alias("h")).collect()}
    order = sorted((i for i in hashes if zlib.crc32(str(i).encode()) % 3 != 1), key=hashes.get)
    odd = {i: [None, "", " ", "12 34", "x" * 1_000_001][k % 5 if k % 50 == 4 else k % 4] for k, i in enumerate(order[:320])}
    rows = [(i, odd[i] if i in odd else say(french), "fr", "s") for i in order[:700]] + [(5000 + i, say(english), "en", "s") for i in range(700)]
    field = languages.train(frame(spark, rows))
    assert field.languages == ["en", "fr"]
    got, _ = languages.predict(pa.array([say(french) for _ in range(20)]), field)
    assert got == ["fr"] * 20
    with pytest.raises(ValueError):
        languages.train(frame(spark, rows), most=1)
    hashes = {r["id"]: r["h"] for r in spark.range(600).select("id", F.xxhash64(F.lit(4), "id").alias("h")).collect()}
    order = sorted((i for i in hashes if zlib.crc32(str(i).encode()) % 3 != 1), key=hashes.get)
    bad, fine = order[:200], order[200:]
    rows = [(i, [None, "", "  "][k % 3] if k < 100 else say(WORDS) + " vilefoo vilebar", "en", "s") for k, i in enumerate(bad)] + [(i, say(WORDS), "en", "s") for i in fine]
    labels = spark.createDataFrame([(i, 1, int(i in set(bad))) for i in order], "doc_id long, quality int, toxic int")
    model = toxicity.train(frame(spark, rows), labels, positives=100, unlabelled=300)
    vile, mild = model.score(pa.array(["amber vilefoo vilebar", "amber birch"]))
    assert len(model.features) and vile > 0.5 and vile > mild


def test_toxicity_scores_against_a_plain_version():
    import pandas as pd

    rng = np.random.default_rng(24)
    mark = lambda w: int(pd.util.hash_array(np.array([w], object), categorize=False)[0])
    salt = lambda n: n * 0x9E3779B97F4A7C15 % 2**64

    def plain(word):
        bare = word.lower().strip(toxicity.EDGES)
        return {(mark(bare[: n or None]) ^ salt(n)) >> 32 for n in (0, 4, 5, 6) if len(bare) >= max(1, n)}

    texts = ["Vile grumpexes, vile!", "", None, "(amber) BIRCH birchwood 12", "é " * 3]
    known = sorted({f for t in texts for w in (t or "").split() for f in plain(w)})
    names = np.array(known[::2], np.uint32)
    model = toxicity.Model(names, rng.standard_normal(len(names)), -0.3)
    weight = dict(zip(names.tolist(), model.weights.tolist()))
    want = [1 / (1 + math.exp(-(model.bias + sum(weight.get(f, 0.0) for f in {f for w in (t or "").split() for f in plain(w)})))) for t in texts]
    assert np.allclose(model.score(pa.array(texts)), want)


def test_non_negative_risk_falls_and_never_turns_negative():
    rng = np.random.default_rng(25)
    bad = [np.unique(np.append(rng.integers(100, 400, 30), rng.integers(1, 9, 3))).astype(np.uint32) for _ in range(120)]
    fine = [np.unique(rng.integers(100, 400, 30)).astype(np.uint32) for _ in range(400)]
    model = toxicity.fit(bad, fine + bad[:40], 0.1)
    raw = lambda sets: np.array([model.bias + model.weights[np.isin(model.features, s)].sum() for s in sets])
    assert set(model.features.tolist()) <= set(range(1, 9)) and (raw(bad) > 0).mean() > 0.95 and (raw(fine) < 0).mean() > 0.99


SYL = {"xx": ["ba", "ko", "mi", "tu"], "yy": ["gré", "çou", "éla", "ñor"], "zz": ["sch", "ung", "keit", "ver"]}


def sample_language(rng, lang, n):
    return " ".join("".join(rng.choice(SYL[lang], int(rng.integers(1, 4)))) for _ in range(n))


def test_languages_on_held_out_and_switched_texts(spark):
    rng = np.random.default_rng(6)
    rows = [(i, sample_language(rng, lang, 40), lang, "s") for i in range(240) for lang in [("xx", "yy", "zz")[i % 3]]]
    rows += [(900, None, "xx", "s"), (901, "12 34 !!", "xx", "s"), (902, sample_language(rng, "xx", 30) + " " + sample_language(rng, "zz", 20), None, "s"), (None, "ba ko", "xx", "s"), (903, sample_language(rng, "zz", 30_000), None, "s")]
    df = frame(spark, rows)
    got = {r["doc_id"]: r for r in languages.identify(df).collect()}
    assert len(got) == len(rows) and all(got[i]["lang_pred"] == got[i]["lang"] for i in range(240))
    assert got[900]["lang_pred"] == got[901]["lang_pred"] == "und" and got[900]["score"] == 0 and got[902]["lang_pred"] == "xx" and got[903]["lang_pred"] == "zz"
    spans = sorted((r["first"], r["words"], r["lang"]) for r in languages.label_words(df.filter("doc_id = 902"), languages.train(df)).collect())
    assert spans == [(0, 30, "xx"), (30, 20, "zz")]
    assert languages.identify(frame(spark, [])).count() == 0 and {(r["lang_pred"], r["lang_pred_"], r["Score"]) for r in languages.identify(frame(spark, [(1, "abc", None, "s")], extra=True)).collect()} == {("x", "und", "x")}


def test_long_runs_are_read_to_their_end(spark):
    rng = np.random.default_rng(16)
    rows = [(i, sample_language(rng, lang, 40), lang, "s") for i in range(240) for lang in [("xx", "yy", "zz")[i % 3]]]
    field = languages.train(frame(spark, rows))
    glued = sample_language(rng, "xx", 12).replace(" ", "") + sample_language(rng, "zz", 300).replace(" ", "")
    got = languages.label_words(frame(spark, [(1, glued, None, "s")]), field).collect()
    assert languages.predict(pa.array([glued]), field)[0] == ["zz"] and {r["lang"] for r in got} >= {"xx", "zz"}
    assert "".join(languages.parts_of(glued)) == glued and max(map(len, languages.parts_of(glued))) <= languages.WIDE
    assert languages.parts_of("tokyo東京です") == ["tokyo", "東京です"] and languages.parts_of("l’été") == ["l’été"]


def test_rare_languages_are_learned(spark):
    rng = np.random.default_rng(15)
    ids = [r["id"] for r in spark.range(12_000).orderBy(F.xxhash64(F.lit(9), "id")).collect()]
    rare = set(ids[-12:])
    rows = [(i, sample_language(rng, "zz" if i in rare else "xx", 12), "zz" if i in rare else "xx", "s") for i in ids]
    df = frame(spark, rows)
    field = languages.train(df)
    assert field.languages == ["xx", "zz"]
    assert {r["lang_pred"] for r in languages.identify(df.filter("lang = 'zz'"), field).collect()} == {"zz"}


def test_posteriors_against_enumeration():
    rng = np.random.default_rng(7)
    emit, trans = rng.standard_normal((7, 3)).astype(np.float32), rng.standard_normal((3, 3))
    got = languages.posteriors(emit, np.array([0, 4, 4, 7]), trans)
    for lo, hi in ((0, 4), (4, 7)):
        n, want = hi - lo, np.zeros((hi - lo, 3))
        for path in np.ndindex(*[3] * n):
            p = math.exp(sum(emit[lo + t, y] for t, y in enumerate(path)) + sum(trans[a, b] for a, b in zip(path, path[1:])))
            for t, y in enumerate(path):
                want[t, y] += p
        assert np.allclose(got[lo:hi], want / want.sum(axis=1, keepdims=True), atol=1e-4)


def vectors(spark, rows):
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int, score string, rank string, links string")
    return df.withColumn("n_links", F.lit("x")).withColumn("component_id", F.lit("x")).withColumn("kept", F.lit("x")).withColumn("query_id", F.lit("x"))


@pytest.fixture(scope="module")
def vecs():
    rng = np.random.default_rng(8)
    rows = [(i, rng.standard_normal(16).astype(np.float32).tolist(), i % 3, "x", "y", "z") for i in range(300)]
    base = rng.standard_normal(16)
    for i in range(60):
        rows.append((1000 + i, (base + rng.standard_normal(16) * 0.05).astype(np.float32).tolist(), 1, "x", "y", "z"))
    rows += [(2000 + i, rows[3][1], 0, "x", "y", "z") for i in range(30)] + [(3000, None, 1, "", "", ""), (3001, [0.0] * 16, 1, "", "", ""), (3020, [float("nan")] * 16, 1, "", "", ""), (3040, rows[0][1][:15] + [None], 0, "", "", ""), (3060, [1.0, 2.0], 1, "", "", ""), (3080, rows[3][1], None, "", "", ""), (None, rows[3][1], 0, "", "", "")]
    return rows


def test_near_vectors_against_brute_force(spark, vecs):
    got = quantise.near_vectors(vectors(spark, vecs)).collect()
    assert len(got) == len(vecs)
    good = [(i, np.array(v, float), lab) for i, v, lab, *_ in vecs if i is not None and lab is not None and v and len(v) == 16 and None not in v and np.isfinite(v).all() and any(v)]
    links = [(a, b) for k, (a, x, p) in enumerate(good) for b, y, q in good[k + 1 :] if p == q and x @ y / np.linalg.norm(x) / np.linalg.norm(y) >= 0.93]
    want, n = roots([i for i, *_ in vecs if i is not None], links), Counter(x for p in links for x in p)
    miss = 0
    for r in got:
        if r["vec_id"] is not None:
            miss += abs(r["n_links"] - n[r["vec_id"]])
            assert r["component_id"] == want[r["vec_id"]]
    assert miss <= 0.01 * len(links)
    assert quantise.near_vectors(vectors(spark, [])).count() == 0


def test_near_vectors_with_a_strong_common_component(spark):
    rng = np.random.default_rng(13)
    common = np.zeros(32)
    common[0] = 0.85
    own = rng.standard_normal((300, 31))
    own = np.concatenate([own, own[:, :] + rng.standard_normal((300, 31)) * 0.75])
    own = own / np.linalg.norm(own, axis=1, keepdims=True) * np.sqrt(1 - 0.85**2)
    x = (common + np.concatenate([np.zeros((600, 1)), own], axis=1)).astype(np.float32)
    unit = x / np.linalg.norm(x.astype(float), axis=1, keepdims=True)
    near = unit @ unit.T >= 0.93
    np.fill_diagonal(near, False)
    got = {r["vec_id"]: r["n_links"] for r in quantise.near_vectors(vectors(spark, [(i, v.tolist(), 1, "", "", "") for i, v in enumerate(x)])).collect()}
    assert near.sum() > 200 and sum(got.values()) >= 0.98 * near.sum() and all(got[i] <= near[i].sum() for i in range(600))


def test_nearest_against_brute_force(spark, vecs):
    got = projections.nearest(vectors(spark, vecs)).collect()
    good = [(i, np.array(v, float)) for i, v, *_ in vecs if i is not None and v and len(v) == 16 and None not in v and np.isfinite(v).all() and any(v)]
    hits = total = 0
    for i, x in good:
        if i % 20 == 0:
            want = sorted(((-float((x * y).sum()), j) for j, y in good if j != i))[:20]
            own = sorted((r for r in got if r["query_id"] == i), key=lambda r: r["rank"])
            assert [r["rank"] for r in own] == list(range(1, 21))
            assert all(a["score"] > b["score"] or (a["score"] == b["score"] and a["vec_id"] < b["vec_id"]) for a, b in zip(own, own[1:]))
            hits, total = hits + len({j for _, j in want} & {r["vec_id"] for r in own}), total + 20
    assert hits >= 0.97 * total
    assert projections.nearest(vectors(spark, [])).count() == 0 and projections.nearest(vectors(spark, vecs[:4])).count() == 3
    clash = vectors(spark, vecs[:40]).withColumn("query_id", F.lit("x")).withColumn("key", F.lit("x")).withColumn("own", F.lit("x"))
    assert projections.nearest(clash).count() == 40


def test_nearest_with_repeated_ids_and_equal_vectors(spark):
    rng = np.random.default_rng(20)
    one, other = rng.standard_normal((2, 8)).astype(np.float32).tolist()
    rows = [(i, one) for i in range(100, 160)] + [(-20, one), (-20, other), (-20, one), (200, other), (201, other)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    got = {}
    for r in projections.nearest(df, k=5).orderBy("query_id", "rank").collect():
        got.setdefault(r["query_id"], []).append(r["vec_id"])
    if np.dot(one, one) > np.dot(one, other):
        assert got[100] == [-20, 101, 102, 103, 104] and got[120] == [-20, 100, 101, 102, 103]
    assert sorted(got[-20])[:5] and -20 not in got[-20] and len(got[-20]) == 10


def test_the_stop_spares_most_rows_of_clustered_vectors():
    rng = np.random.default_rng(21)
    centres = rng.standard_normal((40, 64))
    rows = centres[rng.integers(40, size=6000)] + rng.standard_normal((6000, 64)) * 0.3
    space = projections.Space(rows.mean(axis=0), float(np.linalg.norm(rows - rows.mean(axis=0), axis=1).max()))
    queries = rows[::20]
    limit = projections.chi_square(0.9, projections.DIMENSIONS)
    got, verified = projections.search(np.arange(6000), rows, np.arange(300), queries, np.full(300, projections.NOBODY), np.full(300, -np.inf), 21, space, limit)
    best = np.argsort(-(queries @ rows.T), axis=1, kind="stable")[:, :21]
    hits = sum(len(set(best[k]) & set(g)) for k, g in got.groupby("key")["vec_id"])
    assert hits >= 0.9 * best.size and verified < 300 * 6000 / 3


def test_regions_part_all_points():
    points = np.random.default_rng(22).standard_normal((1000, projections.DIMENSIONS))
    regions = projections.Regions(points, 8)
    sizes = np.bincount(regions.of(points), minlength=8)
    assert sizes.min() >= 100 and sizes.sum() == 1000 and set(projections.Regions(points[:0], 4).of(points)) <= {0, 1, 2, 3}


def test_chi_square_quantiles():
    assert abs(projections.chi_square(0.95, 8) - 15.507) < 1e-3 and abs(projections.chi_square(0.5, 2) - 1.386) < 1e-3


def test_attention_scores(spark):
    rng = np.random.default_rng(9)
    rows = [(i, text(rng, 60), "en", "s") for i in range(150)]
    rows += [(900, None, "en", "s"), (901, "", "en", "s"), (None, "amber birch", "en", "s"), (902, "amber " * 20_000, "en", "s"), (3, rows[3][1], "en", "s")]
    got = attention.score(frame(spark, rows, extra=True), sample=150).collect()
    assert len(got) == len(rows)
    words = {d: [x for x in SPLIT.split((t or "").translate(LOWER)) if x] for d, t, *_ in rows}
    train = [t for d, t, *_ in rows if d is not None and zlib.crc32(str(d).encode()) % 7 != 2]
    c = Counter(x for t in train for x in SPLIT.split((t or "").translate(LOWER)) if x) + Counter({None: len(train)})
    n, v = sum(c.values()), len(c)
    for r in got:
        w = [*words[r["doc_id"]], None]
        assert (r["n_tokens"], r["n_known"], r["train_tokens"]) == (len(w), sum(c[x] > 0 for x in w), n)
        assert abs(r["base_score"] - sum(math.log10((c[x] + 1) / (n + v + 1)) for x in w)) < 1e-6 * len(w) and r["score"] < 0
    assert attention.score(frame(spark, [])).count() == 0


def test_attention_sees_only_the_past_and_scores_each_token_once():
    rng = np.random.default_rng(10)
    docs = [rng.integers(0, 40, int(k)) for k in (0, 1, 15, 16, 17, 33, 200)]
    net = attention.fit(docs, np.bincount(np.concatenate(docs), minlength=50) + 1, 49, epochs=1).prepared()
    whole = net.score(docs, 49)
    assert np.allclose(whole, [net.score([d], 49)[0] for d in docs], atol=1e-3)
    p = np.exp(net.inside)
    assert np.allclose(np.bincount(net.group, p, attention.CLASSES)[np.unique(net.group)], 1, atol=1e-6)
    d = docs[-1]
    probs = [math.exp(net.score([np.append(d[:20], k)], 49)[0] - net.score([np.append(d[:20], k)], k)[0]) for k in (1, 2)]
    assert all(x > 0 for x in probs)


def test_mixing_meets_targets(spark, docs):
    rows, placed = mixing.mix(frame(spark, docs, extra=True), block_words=64, shard_units=4)
    got = rows.collect()
    assert len(got) == len(docs)
    by = {}
    for r in got:
        by.setdefault(r["source"], []).append(r)
    for own in by.values():
        assert abs(sum(r["taken"] for r in own) - own[0]["target"]) <= 1 and sum(r["size"] for r in own) == own[0]["source_size"] and own[0]["target"] <= 3 * own[0]["source_size"] + 1e-6
        assert all(0 <= r["taken"] <= 3 * r["size"] for r in own)
    assert abs(sum(o[0]["target"] for o in by.values()) - sum(r["size"] for r in got)) < 1e-6
    again = sorted(tuple(r) for r in mixing.mix(frame(spark, docs).repartition(3), block_words=64, shard_units=4)[0].select("source", "size", "taken").fillna("", ["source"]).collect())
    assert again == sorted((r["source"] or "", r["size"], r["taken"]) for r in got)
    places = placed.collect()
    assert len({(p["shard"], p["position"]) for p in places}) == len(places) and sum(p["words"] for p in places) == sum(r["taken"] for r in got)
    assert mixing.mix(frame(spark, []))[0].count() == 0


def test_splitting_tree_draws_exact_disjoint_quotas():
    import pandas as pd

    catalogue = [(0, 37, 10, 0), (1, 5, 5, 0), (2, 118, 40, 0)]
    got = mixing.shard_blocks(catalogue, 7, 11, pd.Series(range(7)))
    assert len(got) == 160 and not got.duplicated(["_s", "pass", "block"]).any() and got.groupby("shard").size().between(22, 23).all()
    parts = pd.concat([mixing.shard_blocks(catalogue, 7, 11, pd.Series([k])) for k in range(7)], ignore_index=True)
    assert parts.equals(got)


def test_words_split_at_ascii_space_only():
    w = Words(pa.array([" A\tb\x0bC ", None, "", "x\xa0y \x85"]))
    got = [w.vocab.to_pylist()[c] for c in w.codes]
    assert got == ["a", "b", "c", "x\xa0y", "\x85"] and w.offsets.tolist() == [0, 3, 3, 3, 5]


def test_attention_learns_from_texts_outside_the_sample(spark):
    rng = np.random.default_rng(12)
    rows = [(i, " ".join(WORDS[(s + k) % len(WORDS)] for k in range(200)), "en", "s") for i in range(700) for s in [int(rng.integers(len(WORDS)))]]
    got = [r for r in attention.score(frame(spark, rows), sample=1).collect() if r["held_out"]]
    assert sum(r["score"] for r in got) > 1.5 * sum(r["base_score"] for r in got)


def test_attention_against_a_token_by_token_model():
    rng = np.random.default_rng(17)
    docs = [rng.integers(0, 40, int(k)) for k in (0, 5, 16, 40, 75)]
    net = attention.fit(docs, np.bincount(np.concatenate(docs), minlength=50) + 1, 49, epochs=1).prepared()
    s = attention.STRIDE
    for d, got in zip(docs, net.score(docs, 49), strict=True):
        inputs, targets, total = [*[50] * s, 51, *d.tolist()], [*d.tolist(), 49], 0.0
        e = net.embed.astype(float)
        for i, t in enumerate(targets):
            first = i // s * s  # the window's first position; its later half holds this token
            seen = inputs[first : s + i + 1]
            q = e[inputs[s + i]] @ net.wq / math.sqrt(attention.HEAD)
            w = np.array([q @ (e[x] @ net.wk) + net.near[s + i - (first + k)] for k, x in enumerate(seen)])
            w = np.exp(w - w.max())
            state = e[inputs[s + i]] + sum(a * (e[x] @ net.wv) for a, x in zip(w / w.sum(), seen))
            z = state @ net.wo + net.bias
            z -= z.max()
            total += z[net.group[t]] - math.log(np.exp(z).sum()) + net.inside[t]
        assert abs(got - total) < 1e-3 * len(targets)


def test_phrases_depend_on_their_own_text_and_cover_it():
    rng = np.random.default_rng(18)
    docs = [rng.integers(0, 500, int(k)) for k in (300, 0, 1, 900)]
    at, h = attention.phrases(docs, 999)
    begins = attention.starts_of(docs)
    assert set(begins) <= set(at) and len(at) == len(h) and 20 < len(at) < 120
    for d, a in zip(docs, begins):
        own, hashes = attention.phrases([d], 999)
        inside = (at >= a) & (at <= a + len(d))
        assert (at[inside] - a).tolist() == own.tolist() and h[inside].tolist() == hashes.tolist()


def test_repeated_texts_are_recalled_and_a_text_does_not_recall_itself(spark):
    rng = np.random.default_rng(19)
    many = [a + b for a in WORDS for b in WORDS]
    rows = [(i, text(rng, 120, many), "en", "s") for i in range(120)]
    rows += [(1000 + i, rows[i][1], "en", "s") for i in range(20)]
    got = {r["doc_id"]: r for r in attention.score(frame(spark, rows), sample=100).collect()}
    learned = {i for i in got if not got[i]["held_out"]}
    again = [i for i in range(20) if 1000 + i in learned] + [1000 + i for i in range(20) if i in learned]
    each = lambda ids: np.array([got[i]["score"] / got[i]["n_tokens"] for i in ids])
    assert each(again).min() > each(range(20, 120)).max() + 0.3
    alone = [i for i in range(20, 120)]
    trained, unseen = each([i for i in alone if i in learned]), each([i for i in alone if i not in learned])
    assert abs(trained.mean() - unseen.mean()) < 0.3


def test_attention_learns_from_every_window_of_every_training_text(spark, monkeypatch):
    rng = np.random.default_rng(23)
    docs = [rng.integers(0, 40, int(k)) for k in rng.integers(0, 200, 60)]
    targets, texts = [], []
    monkeypatch.setattr(attention.Trainer, "step", lambda self, x, t, rate: targets.append(t[t >= 0]))
    attention.Trainer({"embed": np.zeros((52, attention.WIDTH), np.float32)}, np.zeros(50, np.int64), 49).learn(docs, lambda _: 0.01, each=8)
    assert np.concatenate(targets).tolist() == [x for d in docs for x in [*d.tolist(), 49]]
    monkeypatch.setattr(attention, "_round", lambda trained, *_: texts.append([bytes(r["ids"]) for r in trained.collect()]))
    rows = spark.createDataFrame([(i, bytearray(d.astype("<u2").tobytes())) for i, d in enumerate(docs)], "row long, ids binary")
    attention.refine(rows, None, "<u2", 10**6)
    assert len(texts) == len(attention.ROUNDS) and sorted(x for t in texts for x in t) == sorted(d.astype("<u2").tobytes() for d in docs)


def test_attention_scores_do_not_depend_on_how_much_the_shared_tables_list(spark, monkeypatch):
    rng = np.random.default_rng(24)
    many = [a + b for a in WORDS for b in WORDS]
    rows = [(i, text(rng, 90, many if i % 3 else [f"w{int(k)}" for k in rng.integers(0, 3000, 90)]), "en", "s") for i in range(90)]
    rows += [(1000 + i, rows[i][1], "en", "s") for i in range(30)] + [(2000 + i, rows[i][1], "en", "s") for i in range(9)]
    counts = spark.createDataFrame([(1, 9), (2, 5), (3, 5), (4, 2), (5, 1)], "h long, n long")
    assert attention.listed_from(counts, 22) == 2
    monkeypatch.setattr(attention, "_round", lambda *_: None)
    monkeypatch.setattr(attention, "OWN", 8)
    columns = lambda: {r["doc_id"]: r for r in attention.score(frame(spark, rows).coalesce(2)).collect()}
    whole = columns()
    monkeypatch.setattr(attention, "LISTED", 2)
    monkeypatch.setattr(attention, "FREQUENT", 0.002)
    assert attention.listed_from(counts, 2500) == 5
    short = columns()
    for i, r in whole.items():
        assert r["n_known"] == short[i]["n_known"] and abs(r["base_score"] - short[i]["base_score"]) < 1e-6 * r["n_tokens"]
