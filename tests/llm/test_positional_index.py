import random
import re

import pytest

from rastertab.llm import positional_index as p


def low_words(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


def brute(docs, items, window=10):
    out = []
    for doc, text in docs:
        words, hit, found = low_words(text), set(), set()
        for item, body in items:
            ws = low_words(body)
            n = min(window, len(ws))
            runs = {tuple(ws[k : k + n]) for k in range(len(ws) - n + 1)} if ws else set()
            for k in range(len(words) - n + 1):
                if n and tuple(words[k : k + n]) in runs:
                    hit.update(range(k, k + n))
                    found.add(str(item))
        out.append((str(doc), len(words), len(hit), sorted(found)))
    return sorted(out)


@pytest.fixture(scope="module")
def tables(spark):
    rng = random.Random(8)
    vocab = "a b the of river Stone Élan naïve x9 10 delta".split()
    say = lambda n: " ".join(rng.choice(vocab) for _ in range(n))
    items = [(1, say(30)), (2, say(12)), (10, "a b a b a b a b a b a b"), (3, "short item"), (4, None), (5, "!!"), (6, say(30))]
    docs = []
    for i in range(60):
        body = rng.choice([t for _, t in items if t])
        docs.append((i if i else None, f"{say(20)}, {body.replace(' ', '-')}! {say(9)}" if i % 3 else say(60)))
    docs += [(70, None), (71, ""), (72, "a b " * 40), (5, docs[4][1]), (5, docs[4][1]), (73, "SHORT\nitem"), (74, "É" * 3000)]
    d = spark.createDataFrame([(i, t, "q") for i, t in docs], "doc_id bigint, text string, term string")
    b = spark.createDataFrame([(i, t, 1) for i, t in items], "item_id bigint, text string, n int")
    return docs, items, d, b


def test_hits_equal_brute_force(tables):
    docs, items, d, b = tables
    rows = p.contamination(d, b).collect()
    assert sorted((str(r.doc_id), r.n_words, r.n_hit, r["items"]) for r in rows) == brute(docs, items)
    assert all(r.contaminated == (r.n_hit > 0) and r.n_items == len(r["items"]) for r in rows)
    clean = p.drop_contaminated(d, b)
    assert clean.columns == d.columns
    assert clean.count() == sum(not x[2] for x in brute(docs, items))


def test_proximity_finds_a_window_with_words_moved(spark):
    item = "one two three four five six seven eight nine ten"
    docs = [(1, item), (2, "one two four three five six uh seven eight nine ten"), (3, "one two three x x x x x x x x x ten"), (4, None)]
    d = spark.createDataFrame(docs, "doc_id bigint, text string")
    b = spark.createDataFrame([(9, item)], "item_id bigint, text string")
    assert sorted((r.doc_id, r.kind) for r in p.matches(d, b).collect()) == [(1, "phrase"), (2, "proximity")]


def test_without_rows_nothing_is_hit(tables):
    _, _, d, b = tables
    assert p.contamination(d.limit(0), b).count() == 0
    assert {r.n_hit for r in p.contamination(d, b.limit(0)).collect()} == {0}
    assert p.drop_contaminated(d, b.limit(0)).count() == d.count()
