import random
import re

import pytest

from rastertab.llm import quality_llr as q


def slow_rules(text):
    text = text or ""
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    windows = [tuple(words[i : i + 3]) for i in range(len(words) - 2)]
    hit = {i + k for i, w in enumerate(windows) if windows.count(w) > 1 for k in range(3)}
    lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    dup = sum(x in lines[:i] for i, x in enumerate(lines))
    return len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text), dup, len(hit)


def test_text_rules_equal_a_slow_loop():
    rng = random.Random(1)
    for n in range(200):
        text = "".join(rng.choice("ab é#|\n\t\x0b\x1c ") for _ in range(n))
        assert q.text_rules(text) == slow_rules(text)
    assert q.text_rules(None) == slow_rules(None) == (0, 0, 0, 0, 0)


@pytest.fixture(scope="module")
def corpus(spark):
    rng = random.Random(2)
    good = lambda: " ".join(rng.choice("alpha beta gamma delta river stone under light".split()) + str(rng.random())[2:4] for _ in range(80))
    bad = lambda: " ".join(rng.choice("XXQ!! ZZW## QQK$$ PPV%%".split()) + str(rng.random())[2:4] for _ in range(80))
    rows = [(i, good() if i % 4 else bad()) for i in range(200)] + [(200, None), (201, ""), (None, good()), (3, good())]
    clashing = "doc_id bigint, text string, score string, quality string, kept string, toxic string, n_words string, bucket string"
    docs = spark.createDataFrame([(*r, *"xxxxxx") for r in rows], clashing)
    labels = spark.createDataFrame([(i, int(i % 4 > 0), 0) for i in range(0, 120)], "doc_id bigint, quality int, toxic int")
    return docs, labels


def test_unlabelled_documents_are_told_apart(corpus):
    docs, labels = corpus
    model = q.fit(docs, labels)
    rows = q.judge(docs, model).collect()
    assert len(rows) == 204
    for r in rows:
        if r.doc_id in (200, 201):
            assert r.base_failed and not r.kept and r.score == 0.0
        else:
            assert r.kept == (r.doc_id is None or r.doc_id % 4 > 0)
    kept = q.keep_good(docs, model)
    assert kept.columns == docs.columns and kept.count() == sum(r.kept for r in rows)


def test_without_labels_or_rows_only_the_base_rules_judge(spark, corpus):
    docs, labels = corpus
    model = q.fit(docs, labels.limit(0))
    assert {r.kept for r in q.judge(docs, model).where("n_words >= 50").collect()} == {True}
    none = docs.limit(0)
    assert q.judge(none, q.fit(none, labels)).count() == 0


def test_every_labelled_document_takes_part(spark):
    """Of more than 20 000 labelled documents only so many were looked at."""
    words = [f"w{k}" for k in range(300)]
    rng = random.Random(4)
    rows = [(i, " ".join(rng.choices(words[: 300 if i % 5 else 40], k=50)), int(i % 5 > 0)) for i in range(21_000)]
    docs = spark.createDataFrame([r[:2] for r in rows], "doc_id bigint, text string").repartition(8)
    labels = spark.createDataFrame([(i, k, 0) for i, _, k in rows], "doc_id bigint, quality int, toxic int")
    model = q.fit(docs, labels)
    odd = {r[0] for r in docs.selectExpr("doc_id", "xxhash64(doc_id, 7) % 2 <> 0 AS odd").where("odd").collect()}
    trusted = labels.where("quality = 1").join(docs, "doc_id", "left_semi")
    counted = q.gram_counts(docs, trusted).selectExpr("sum(target)").first()[0]
    assert counted == sum(len(q.buckets(t.encode())) for _, t, k in rows if k)
    judged = [(k, model.score(t)) for i, t, k in rows if i in odd]
    good = sorted(s for k, s in judged if k)
    low = good[int(q.LOSS * len(good))]
    below = [s for k, s in judged if not k and s < low]
    assert model.threshold == pytest.approx((low + max(below)) / 2 if below else low - 1e-9, abs=1e-12)


def test_texts_are_dealt_out_once_at_most(spark, tmp_path, monkeypatch):
    """Labels that were sent to every task at a small size made all texts move, twice, at a larger one."""
    rows = [(i, f"alpha beta {i} " * 60) for i in range(400)]
    spark.createDataFrame(rows, "doc_id bigint, text string").write.parquet(f"{tmp_path}/documents")
    spark.createDataFrame([(i, int(i % 4 > 0)) for i in range(300)], "doc_id bigint, quality int").write.parquet(f"{tmp_path}/labels")
    docs, labels = spark.read.parquet(f"{tmp_path}/documents"), spark.read.parquet(f"{tmp_path}/labels")
    plan = lambda df: df._jdf.queryExecution().optimizedPlan().toString() + df._jdf.queryExecution().executedPlan().toString()
    seen = []
    real = q.settle
    monkeypatch.setattr(q, "settle", lambda df, label: seen.append(plan(df)) or real(df, label))
    q.fit(docs, labels)
    counts = plan(q.gram_counts(docs, labels.where("quality = 1")))
    assert "Broadcast" not in counts + seen[0]
    moved = [line for line in seen[0].splitlines() if "Join" in line]
    assert moved and all("text" not in line for line in moved)
    below = seen[0][seen[0].index("Join") :]
    assert "hashpartitioning" in seen[0] and not any("Exchange" in line and "text" in line for line in below.splitlines())


def test_labels_may_have_ids_of_another_type(corpus):
    docs, labels = corpus
    model, other = q.fit(docs, labels), q.fit(docs, labels.selectExpr("cast(doc_id AS bigint) AS doc_id", "quality"))
    assert (model.weights == other.weights).all() and model.threshold == other.threshold
    narrow = docs.selectExpr("cast(doc_id AS int) AS doc_id", "text")
    narrow = q.fit(narrow, labels)
    assert (model.weights == narrow.weights).all() and model.threshold == narrow.threshold
