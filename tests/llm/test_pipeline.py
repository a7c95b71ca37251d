"""The whole pipeline on a planted corpus, against its stages once more in plain Python."""

import random

import corpus_pipeline as cp
from rastertab.llm import quality_llr
from tests.llm.test_byte_bpe import reference
from tests.llm.test_line_templates import slow_templates
from tests.llm.test_ngram_join import slow_classes
from tests.llm.test_positional_index import brute
from tests.llm.test_quality_llr import slow_rules


def corpus():
    rng = random.Random(11)
    syllables = "ba de fi go lu mar nel pos tri ven sha kor".split()
    word = lambda: "".join(rng.choice(syllables) for _ in range(rng.randrange(2, 4)))
    prose = lambda n=90, line=15: "\n".join(" ".join(word() for _ in range(line)) for _ in range(n // line))
    junk = lambda: " ".join(rng.choice(("XXQ!!", "ZZW##", "QQK$$")) + str(rng.random())[2:5] for _ in range(90))
    notice = "All rights are with the river press and nobody else"
    passage = [" ".join(word() for _ in range(16)) for _ in range(4)]  # 64 words that recur across documents
    item = " ".join(word() for _ in range(14))
    docs = {}
    for i in range(60):
        docs[i] = prose(450) if i % 4 else junk()  # enough text for the trusted counts
    for i in range(60, 80):
        docs[i] = f"{prose()}\n{notice}"
    for i in range(80, 100):
        docs[i] = f"{prose(60)}\n" + "\n".join(passage) + f"\n{prose(60)}"
    for i in range(100, 106):  # near copies of one text
        words = docs[61].split(" ")
        words[i - 80] = "changed"
        docs[i] = " ".join(words)
    docs[106] = f"{prose()}\nso {item.upper()} it went"
    docs |= {107: None, 108: "", 109: "too short", 110: docs[1], 111: prose(3000)}
    rows = [(i, t, "en", "web", len(t or ""), "x") for i, t in docs.items()]
    rows += [(None, prose(), "en", "web", 1, "x"), (2, docs[2], "en", "web", 1, "x")]
    labels = [(i, int(i % 4 > 0), 0) for i in range(40)]
    return rows, labels, [("a", item), ("b", None), (None, "nothing like it here at all")], notice, passage


COLUMNS = "doc_id bigint, text string, lang string, source string, n_chars bigint, quality string"


def write(spark, tmp_path, rows, labels, items):
    spark.createDataFrame(rows, COLUMNS).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame(labels, "doc_id bigint, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame(items, "item_id string, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    return str(tmp_path)


def test_stages_equal_plain_loops(spark, tmp_path):
    rows, labels, items, notice, passage = corpus()
    sf = write(spark, tmp_path / "sf", rows, labels, items)
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    model = quality_llr.fit(docs, spark.read.parquet(f"{sf}/labels.parquet"))
    kept = []
    for doc, text, *_ in rows:
        n, _, _, _, repeats = slow_rules(text)
        if n >= 50 and 100 * repeats <= 50 * n and model.score(text) >= model.threshold:
            kept.append((doc, text))
    assert {d for d, _ in kept} == {None, *(i for i in range(107) if i >= 60 or i % 4), 110, 111}
    hot = slow_templates(sorted({t for _, t in kept}))
    kept = [(d, "\n".join(x for i, x in enumerate(t.split("\n")) if (t, i) not in hot)) for d, t in kept]
    assert not any(notice in t or line in t for _, t in kept for line in passage)
    classes = {d: c for d, _, c in slow_classes(kept, 5, 80)}
    kept = [(d, t) for d, t in kept if d is None or classes[str(d)] == str(d)]
    assert not {101, 105, 110} & {d for d, _ in kept}
    hit = {d: n for d, _, n, _ in brute(kept, items)}
    kept = [(d, t) for d, t in kept if not hit[str(d)]]
    assert 106 not in {d for d, _ in kept} and len(kept) > 60
    lib = reference()
    want = sorted((str(d), lib.encode_ordinary(t)) for d, t in kept)
    got = cp.run(spark, sf).collect()
    assert sorted((str(r.doc_id), r.ids) for r in got) == want
    assert all(r.round_trip and r.n_tokens == len(r.ids) for r in got)


def test_stages_keep_the_columns_and_take_empty_tables(spark, tmp_path):
    rows, labels, items, *_ = corpus()
    sf = write(spark, tmp_path / "sf", rows[:1], labels[:0], items[:0])
    docs = spark.read.parquet(f"{sf}/documents.parquet").limit(0)
    for _, stage in cp.STAGES[:-1]:
        out = stage(spark, docs, sf)
        assert out.columns == docs.columns and out.count() == 0
    assert cp.STAGES[-1][1](spark, docs, sf).count() == 0
