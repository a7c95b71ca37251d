import random

import numpy as np
import pytest

from rastertab.llm import ordinal_quality as o

VOCAB = {0: ["foul", "nasty"], 1: ["!!", "|"], 2: ["kind", "gentle"]}


def say(rng, grade):
    words = [rng.choice("the of river stone under light a in".split()) for _ in range(40)]
    return " ".join(words + [rng.choice(VOCAB[grade]) for _ in range(6)])


@pytest.fixture(scope="module")
def tables(spark):
    rng = random.Random(6)
    rows = [(i, say(rng, i % 3), "x") for i in range(450)] + [(500, None, "x"), (501, "", "x"), (None, say(rng, 2), "x"), (4, say(rng, 1), "x")]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, kept string")
    ratings = spark.createDataFrame([(i, i % 3) for i in range(300)] + [(7, None), (8, 9)], "doc_id bigint, grade int")
    return docs, ratings


def test_unrated_documents_are_graded(tables):
    docs, ratings = tables
    model = o.fit(docs, ratings)
    assert np.all(np.diff(model.cuts) > 0)
    rows = {r.doc_id: r for r in o.grade(docs, model).collect() if r.doc_id is None or r.doc_id >= 300}
    for i in range(300, 450):
        r = rows[i]
        assert round(r.expected_grade) == i % 3 and r.kept == (i % 3 == 2)
        assert r.tails[0] >= r.tails[1] and abs(sum(r.tails) - r.expected_grade) < 1e-9
    assert rows[None].kept
    assert rows[500].tails == rows[501].tails


def test_gradient_descent_beats_the_base_rate():
    rng = random.Random(7)
    texts = [say(rng, i % 3) for i in range(150)]
    w, cuts = o.train(texts, np.arange(150) % 3, 3, steps=150)
    model = o.Model(w, cuts, 0.5)
    assert np.mean([round(model.tails(t).sum()) == i % 3 for i, t in enumerate(texts)]) > 0.95


def test_without_ratings_all_stay_and_no_rows_give_none(tables):
    docs, ratings = tables
    model = o.fit(docs, ratings.limit(0))
    assert {r.kept for r in o.grade(docs, model).collect()} == {True}
    assert o.grade(docs.limit(0), o.fit(docs.limit(0), ratings)).count() == 0
