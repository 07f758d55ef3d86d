"""Findings of round four on near duplicates: what fails without the change that answers it."""

import numpy as np

from vellumframe.llm import hyperminhash

NAMES = "doc_id long, text string"


def made(spark, rows, monkeypatch, shingle=3, percent=85):
    """The result, and the rows of each table that was staged."""
    staged, sizes = hyperminhash.staged, {}

    def counted(df, name, **options):
        out = staged(df, name, **options)
        sizes.setdefault(name, []).append(out.count())
        return out

    monkeypatch.setattr(hyperminhash, "staged", counted)
    got = hyperminhash.near_duplicates(spark.createDataFrame(rows, NAMES), shingle, percent).collect()
    return {r["doc_id"]: r for r in got}, sizes


def test_short_texts_with_a_common_phrase_do_not_meet(spark, monkeypatch):
    """texts that share a few shingles met in buckets (3,314 times here), and those of a bucket are held against each other."""
    rows = [(k, "to whom it may concern " + " ".join(f"w{k}x{j}" for j in range(12))) for k in range(2000)]
    rows += [(5000 + k, rows[k][1] + " end") for k in range(0, 2000, 100)]
    got, sizes = made(spark, rows, monkeypatch)
    assert sorted(r["doc_id"] for r in got.values() if not r["kept"]) == [5000 + k for k in range(0, 2000, 100)]
    assert all(got[5000 + k]["component_id"] == k for k in range(0, 2000, 100))
    assert sum(sizes["met"]) < 100


def test_short_near_copies_are_found(spark, monkeypatch):
    """pairs at the threshold whose sets fill few buckets, and sets of one shingle."""
    rng = np.random.default_rng(3)
    rows, pairs = [], 0
    for n in (9, 16, 24, 40, 90, 200, 420):
        for _ in range(30):
            words = [f"w{rng.integers(1 << 40)}" for _ in range(n)]
            rows += [(2 * pairs, " ".join(words)), (2 * pairs + 1, " ".join([*words, "more"]))]
            pairs += 1
    rows += [(10_000, "one"), (10_001, "one two"), (10_002, "one two three"), (10_003, "ONE two"), (10_004, ""), (10_005, None)]
    got, _ = made(spark, rows, monkeypatch)
    assert all(got[2 * k]["component_id"] == got[2 * k + 1]["component_id"] == 2 * k for k in range(pairs))
    assert [got[k]["component_id"] for k in range(10_000, 10_006)] == [10_000, 10_001, 10_002, 10_001, 10_004, 10_005]


def test_keys_of_bands_do_not_depend_on_the_batch():
    sets = [np.unique(np.random.default_rng(k).integers(0, 2**63, n).astype(np.uint64)) for k, n in enumerate((0, 1, 2, 7, 60, 900))]
    k = 180
    together = hyperminhash.band_keys(hyperminhash.minima(sets, k))
    alone = np.concatenate([hyperminhash.band_keys(hyperminhash.minima([s], k)) for s in sets])
    assert (together == alone).all() and together.shape == (6, k // hyperminhash.ROWS)
