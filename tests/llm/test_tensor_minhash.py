import math

import numpy as np
import pytest

from rastertab.llm import tensor_minhash as t
from tests.llm.test_ngram_join import scene, slow_classes


def got(spark, rows, size, percent):
    docs = spark.createDataFrame([(i, x, "x", 0) for i, x in rows], "doc_id bigint, text string, component_id string, comp int")
    return sorted((str(r.doc_id), r.n_shingles, str(r.component_id)) for r in t.classes(docs, size, percent).collect())


@pytest.mark.parametrize("size,percent,block", [(4, 80, 1024), (5, 85, 3)])
def test_classes_equal_brute_force(spark, monkeypatch, size, percent, block):
    monkeypatch.setattr(t, "BLOCK", block)
    monkeypatch.setattr(t, "CHUNK", 2 if block == 3 else t.CHUNK)
    rows = scene(size * percent + 1)
    assert got(spark, rows, size, percent) == slow_classes(rows, size, percent)


def test_links_that_no_centre_finds(spark, monkeypatch):
    """Without centres the tables alone must join everything."""
    monkeypatch.setattr(t, "DIRECT", 1)
    rows = scene(77)
    assert got(spark, rows, 4, 80) == slow_classes(rows, 4, 80)


def test_a_chain_of_links(spark):
    words = [f"w{i}" for i in range(400)]
    rows = [(k, " ".join(words[8 * k : 8 * k + 120])) for k in range(30)]  # neighbours link, ends have nothing in common
    want = slow_classes(rows, 4, 80)
    assert len({c for *_, c in want}) == 1
    assert got(spark, rows, 4, 80) == want


def test_empty_table_and_no_shingles(spark):
    assert got(spark, [], 4, 80) == []
    assert got(spark, [(1, None), (2, ""), (None, None)], 4, 80) == [("1", 0, "1"), ("2", 0, "2"), ("None", 0, "None")]


def test_one_very_long_text(spark):
    long = " ".join(f"w{i}" for i in range(60_000))
    rows = [(1, long), (2, long + " end"), (3, "w1 w2 w3 w4 w5")]
    assert got(spark, rows, 4, 80) == [("1", 59_997, "1"), ("2", 59_998, "1"), ("3", 2, "3")]


def test_keep_one_of_each_class(spark):
    docs = spark.createDataFrame([(1, "a b c d e f"), (2, "a b c d e f"), (3, "g h"), (None, "a b c d e f")], "doc_id bigint, text string")
    kept = t.drop_near_duplicates(docs, 4, 80)
    assert kept.columns == ["doc_id", "text"]
    assert sorted(str(r.doc_id) for r in kept.collect()) == ["1", "3", "None"]


def test_agreement_of_half_keys_follows_similarity():
    rng = np.random.default_rng(1)
    hasher, share = t.Hasher(80), []
    for n in (60, 300, 1500):
        for _ in range(20):
            pool = rng.integers(0, 2**63, n * 10 // 9).astype(np.uint64)
            x, y = pool[: n * 10 // 10], pool[len(pool) - n * 10 // 10 :]
            both = len(np.intersect1d(x, y)) / len(np.union1d(x, y))
            a, b = hasher.keys([hasher.minima(x), hasher.minima(y)])
            share.append((a == b).mean() - both**t.HALF)
    assert abs(np.mean(share)) < 4 * math.sqrt(0.25 / (60 * hasher.count))


def test_tensor_counts():
    m = t.half_keys(80)
    assert 2 * (1 - 0.8**t.HALF) ** m <= t.MISS < 2 * (1 - 0.8**t.HALF) ** (m - 1)
    assert t.least_agreement(80) >= 4
