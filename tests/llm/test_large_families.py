import random

import numpy as np
import pytest

from rastertab.functions.state import settle
from rastertab.llm import ngram_join as j
from tests.llm.test_ngram_join import slow_classes


def crowd(n=40, copies=4):
    """Texts of a long passage and words of their own, two thirds to one, and near copies of one of them."""
    rng = random.Random(5)
    words = lambda k: [f"w{rng.randrange(10**6)}" for _ in range(k)]
    passage = words(200)
    texts = [passage + words(100) for _ in range(n)]
    for i in range(copies):
        text = list(texts[7])
        text[3 + 40 * i] = "changed"
        texts.append(text)
    return [(i, " ".join(t)) for i, t in enumerate(texts)] + [(8, "the same id once more")]


@pytest.mark.parametrize("volume", [1 << 21, 900])
def test_texts_of_a_passage_are_not_copied_for_each_block_of_their_family(spark, monkeypatch, volume):
    """A family of m texts was copied m / block times over, although hardly one of them could link."""
    given, search = [], j.family_links
    monkeypatch.setattr(j, "SPLIT", 4)
    monkeypatch.setattr(j, "VOLUME", volume, raising=False)
    monkeypatch.setattr(j, "frequent_buckets", lambda *_: np.zeros(1 << j.SKETCH, bool))  # as if too rare to tell
    monkeypatch.setattr(j, "family_links", lambda members, *a: given.append(members.count()) or search(members, *a))
    rows = crowd()
    docs = spark.createDataFrame(rows, "doc_id bigint, text string")
    got = j.classes(docs, 5, 80, 3).collect()
    assert sorted((str(r.doc_id), r.n_shingles, str(r.component_id)) for r in got) == slow_classes(rows, 5, 80)
    assert 5 <= given[0] <= len(rows)


@pytest.mark.parametrize("part", [100, 60, 1])
def test_what_too_few_shingles_are_shared_with_goes_and_nothing_else(spark, part):
    texts = [(1, "a b c d e f g h i j"), (2, "a b c d e f g h x y"), (3, "a b c d e z z z z z"), (4, "a b c d e f g h i j"),
             (5, "a b c d e f g h i j"), (5, "q q q q q")]
    member = [(1, 1, 10, 1), (2, 1, 10, 1), (3, 1, 6, 1), (4, 9, 10, 1), (5, 8, 10, 2)]  # 4 and 5 are families of one
    found = j.unlinked(
        spark.createDataFrame(texts, "doc_id bigint, text string"),
        spark.createDataFrame(member, "doc_id bigint, family bigint, n bigint, texts bigint"), 1, 80, part,
    )
    low = (j.shingle_set(texts[3][1], 1) <= np.uint64((2**64 - 1) * part // 100)).sum()
    assert (part, low > 2) in ((100, True), (60, True), (1, False))
    assert sorted(r.doc_id for r in found.collect()) == [4] * int(low > 2)  # 3 has one word in six for itself


def test_a_written_round_leaves_no_shuffle_files(spark):
    """They stayed until the driver collected its garbage."""

    def held():
        tracker = spark._jvm.org.apache.spark.SparkEnv.get().mapOutputTracker()
        return set(filter(None, tracker.shuffleStatuses().keys().mkString(",").split(",")))

    free = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before, was = held(), spark.conf.get(free, None)
    rounds = settle(spark.range(1000).selectExpr("id % 7 AS k", "id").repartition(5, "k").groupBy("id").count(), "test")
    assert not held() - before
    assert rounds.count() == 1000
    assert spark.conf.get(free, None) == was
