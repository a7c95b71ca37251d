"""Benchmark texts that share an item_id or have none."""

import pytest

from rastertab.llm import positional_index as p
from tests.llm.test_positional_index import low_words


@pytest.fixture(scope="module")
def tables(spark):
    text = lambda c, n: " ".join(f"{c}{k}" for k in range(n))
    items = [("q", text("alpha", 25)), ("q", text("beta", 25)), ("q", text("gamma", 12)), (None, text("delta", 14)),
             (None, text("eps", 14)), ("z", text("beta", 25))]
    docs = [(i, f"some words {t} and more words") for i, (_, t) in enumerate(items)] + [(10, "nothing of these here")]
    docs += [(11, "x " + " ".join(low_words(items[1][1])[13:23])), (12, items[3][1] + " " + items[2][1])]
    return items, docs, spark.createDataFrame(docs, "doc_id bigint, text string"), spark.createDataFrame(items, "item_id string, text string")


def test_every_text_of_an_id_and_texts_without_one_are_hit(tables):
    items, docs, d, b = tables
    want = {}
    for doc, text in docs:
        words, hit, found = low_words(text), set(), set()
        for item, body in items:
            ws = low_words(body)
            for k in range(len(words) - 9):
                if any(words[k : k + 10] == ws[j : j + 10] for j in range(len(ws) - 9)):
                    hit |= set(range(k, k + 10))
                    found |= {item} - {None}
        want[doc] = (len(hit), sorted(found), bool(hit))
    assert {r.doc_id: (r.n_hit, r["items"], r.contaminated) for r in p.contamination(d, b).collect()} == want
    assert [r.doc_id for r in p.drop_contaminated(d, b).collect()] == [10]


def test_proximity_with_shared_and_missing_ids(spark):
    first, second, third = ("one two three four", "five six seven eight", "red green blue pink")
    docs = [(1, "four three two one"), (2, "eight seven six five"), (3, "pink blue green red"), (4, third)]
    d = spark.createDataFrame(docs, "doc_id bigint, text string")
    b = spark.createDataFrame([("q", first), ("q", second), (None, third)], "item_id string, text string")
    got = sorted((r.doc_id, r.kind) for r in p.matches(d, b).collect())
    assert got == [(1, "proximity"), (2, "proximity"), (3, "proximity"), (4, "phrase")]
