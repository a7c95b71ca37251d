import random
import re

import numpy as np
import pytest

from rastertab.llm import ngram_join as j


def words_set(text, size):
    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    n = min(size, len(words))
    return {tuple(words[i : i + n]) for i in range(len(words) - n + 1)} if words else set()


def slow_classes(rows, size, percent):
    sets = [words_set(t, size) for _, t in rows]
    ids = [i for i, _ in rows]
    root = {i: i for i in ids if i is not None}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a in range(len(rows)):
        for b in range(a):
            if ids[a] is None or ids[b] is None or not sets[a] or not sets[b]:
                continue
            both = len(sets[a] & sets[b])
            if 100 * both >= percent * (len(sets[a]) + len(sets[b]) - both):
                x, y = sorted((find(ids[a]), find(ids[b])))
                root[y] = x
    return sorted((str(i), len(s), str(i if i is None else find(i))) for i, s in zip(ids, sets))


def scene(seed, families=12, copies=7):
    rng = random.Random(seed)
    vocab = ["w%d" % i for i in range(60)]
    rows = [(None, "a b c d e f"), (900, "a b c d e f"), (901, None), (902, ""), (903, " \n\t "), (904, "One two"),
            (905, "one TWO"), (906, "É a b c d"), (907, "é a b c d"), (900, "twice the same id")]
    for f in range(families):
        base = [rng.choice(vocab) for _ in range(rng.choice((5, 12, 40, 120, 300)))]
        for c in range(copies):
            text = list(base)
            for _ in range(rng.randrange(1 + len(base) // 40)):
                text[rng.randrange(len(text))] = rng.choice(vocab)
            rows.append((f * copies + c, " ".join(text + [rng.choice(vocab) for _ in range(rng.randrange(3))])))
    return rows


@pytest.mark.parametrize("size,percent,block", [(4, 85, 1024), (5, 80, 3), (2, 50, 5)])
def test_classes_equal_brute_force(spark, size, percent, block):
    rows = scene(size * percent)
    docs = spark.createDataFrame([(i, t, "x", 0) for i, t in rows], "doc_id bigint, text string, component_id string, n int")
    got = j.classes(docs, size, percent, block).collect()
    assert sorted((str(r.doc_id), r.n_shingles, str(r.component_id)) for r in got) == slow_classes(rows, size, percent)


def test_linked_sets_share_a_signature():
    rng = np.random.default_rng(3)
    for percent in (50, 80, 85, 95):
        signer = j.Signer(percent)
        for n in [*range(1, 60), 200, 1000]:
            x = np.unique(rng.integers(0, 2**63, n).astype(np.uint64) * np.uint64(2))
            for _ in range(5):
                away = rng.integers(0, max(1, len(x) * (100 - percent) // 100) + 1)
                y = np.delete(x, rng.choice(len(x), min(away, len(x) - 1), replace=False)) if len(x) > 1 else x
                y = np.union1d(y, rng.integers(0, 2**63, 2).astype(np.uint64))
                both = len(np.intersect1d(x, y))
                if 100 * both >= percent * (len(x) + len(y) - both):
                    assert set(signer.sign(x)) & set(signer.sign(y))
                    for share in (0.1, 0.6, 1.0):
                        flags = rng.random(1 << j.SKETCH) < share
                        assert set(signer.sign(x, flags)) & set(signer.sign(y, flags))


def test_divide_skip_finds_what_a_double_loop_finds():
    rng = np.random.default_rng(4)
    base = rng.integers(0, 2**60, 200).astype(np.uint64)
    sets = [np.unique(np.concatenate((rng.choice(base, 180, replace=False), rng.integers(0, 2**60, rng.integers(1, 30)).astype(np.uint64)))) for _ in range(60)]
    for percent in (60, 70, 80, 85):
        every = np.arange(len(sets))
        found = j.divide_skip(sets, every, every, percent)
        want = [(a, b) for a in every for b in every if a < b and 100 * len(np.intersect1d(sets[a], sets[b])) >= percent * len(np.union1d(sets[a], sets[b]))]
        group = {frozenset(c) for c in components(found, len(sets))}
        assert group == {frozenset(c) for c in components(want, len(sets))}


def components(links, n):
    group = {i: {i} for i in range(n)}
    for a, b in links:
        if group[a] is not group[b]:
            group[a] |= group[b]
            for x in group[b]:
                group[x] = group[a]
    return list({id(g): g for g in group.values()}.values())


def test_one_document_of_each_class_stays(spark):
    rows = scene(9)
    docs = spark.createDataFrame([(t, i) for i, t in rows], "text string, doc_id bigint")
    kept = j.drop_near_duplicates(docs)
    least = {c for i, _, c in slow_classes(rows, 5, 80)}
    assert kept.columns == ["text", "doc_id"]
    assert {str(r.doc_id) for r in kept.collect()} == least
    assert j.drop_near_duplicates(docs.limit(0)).count() == 0


def test_bucket_counts_are_few_rows_whatever_the_tasks(spark):
    """Every task handed on a row for each bucket it had met, more rows than documents."""
    import numpy as np

    from rastertab.llm import ngram_join as j

    texts = [" ".join(f"w{(i * 31 + k) % 997}" for k in range(40)) for i in range(300)]
    docs = spark.createDataFrame([(t,) for t in texts], "text string").repartition(9)
    rows = j.sketch_counts(docs, 4).collect()
    assert len(rows) <= 1 << (j.SKETCH - j.PART_BITS)
    got = np.zeros(1 << j.SKETCH, np.int64)
    for r in rows:
        got[r.part << j.PART_BITS : (r.part + 1) << j.PART_BITS] += np.frombuffer(r.counts, np.int64)
    want = np.zeros(1 << j.SKETCH, np.int64)
    for t in texts:
        np.add.at(want, j.sketch_buckets(j.shingle_set(t, 4)), 1)
    assert (got == want).all()
