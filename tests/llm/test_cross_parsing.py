import random

import numpy as np
import pytest

from rastertab.llm import cross_parsing as cp

WORDS = {
    "aa": "lorem ipsum dolor sit amet elit sed do".split(),
    "bb": "ther wend shol mighte quath wyth hwat ðorn".split(),
    "cc": "ça où être garçon œuvre naître déjà là".split(),
}


def say(rng, lang, n):
    return " ".join(rng.choice(WORDS[lang]) for _ in range(n))


@pytest.fixture(scope="module")
def train(spark):
    rng = random.Random(1)
    rows = [(i, say(rng, k, 30), k) for i, k in enumerate(list(WORDS) * 40)] + [(900, None, "aa"), (901, "x", None), (902, "12", "zz")]
    return spark.createDataFrame(rows, "doc_id bigint, text string, lang string")


def test_automaton_knows_every_substring_and_no_other():
    rng = random.Random(2)
    text = [rng.randrange(1, 4) for _ in range(40)]
    nexts = cp.automaton(text)
    edges = cp.Edges(nexts, 4)
    for state, out in enumerate(nexts):
        assert edges.find(np.full(4, state, np.int32), np.arange(4)).tolist() == [out.get(c, 0) for c in range(4)]
    subs = {tuple(text[a:b]) for a in range(40) for b in range(a + 1, 41)}
    for n in range(1, 7):
        for _ in range(300):
            word = tuple(rng.randrange(1, 4) for _ in range(n))
            state = 0
            for c in word:
                state = nexts[state].get(c, 0)
                if not state:
                    break
            assert bool(state) == (word in subs)


def slow_phrases(symbols, sample):
    count = 0
    for at in range(0, len(symbols), cp.LANE):
        part, i = symbols[at : at + cp.LANE], 0
        while i < len(part):
            n = 1
            while i + n < len(part) and tuple(part[i : i + n + 1]) in sample:
                n += 1
            i += n
            count += 1
    return count


def test_phrases_equal_a_slow_parse(spark, train):
    rng = random.Random(3)
    model = cp.fit(train)
    assert model.langs == list(WORDS)
    texts = [say(rng, "aa", 5), say(rng, "bb", 400), "", "zzz lorem qqq", "É À où?!"]
    counts, lengths = model.phrases(texts)
    rows = train.where("lang = 'aa'").count()
    assert rows
    for k, lang in enumerate(model.langs):
        root = model.roots[k]

        class Sample:
            def __contains__(self, word):
                state = root  # noqa: B023
                for c in word:
                    state = model.edges.find(np.array([state]), np.array([int(c)]))[0]
                    if not state:
                        return False
                return True

        for i, t in enumerate(texts):
            assert counts[i, k] == slow_phrases(model.symbols(t), Sample()), (lang, t)
    assert lengths[2] == 0


def test_held_out_texts_and_odd_ones(spark, train):
    rng = random.Random(5)
    rows = [(i, say(rng, k, 1 + i % 20), "?") for i, k in enumerate(list(WORDS) * 30)]
    odd = [(1, None, "?"), (None, "", "?"), (2, "12 !? 34", "?"), (2, "12 !? 34", "?"), (3, say(rng, "cc", 30_000), "?")]
    docs = spark.createDataFrame(rows + odd, "doc_id bigint, text string, score string")
    model = cp.fit(train)
    got = cp.languages(docs, model, ("doc_id", "text")).collect()
    assert len(got) == len(rows) + len(odd)
    want = {t: k for (_, t, _), k in zip(rows, list(WORDS) * 30)}
    assert np.mean([r.lang_pred == want[r.text] for r in got if r.text in want]) > 0.97
    assert {(r.lang_pred, r.score) for r in got if r.text in (None, "", "12 !? 34")} == {("und", 0.0)}
    assert all(0 <= r.score <= 1 for r in got)
    empty = cp.fit(train.limit(0))
    assert {r.lang_pred for r in cp.languages(docs, empty).collect()} == {"und"}
    assert cp.languages(docs.limit(0), model).count() == 0


def test_a_stray_label_wins_nothing(spark, train):
    rng = random.Random(6)
    stray = train.union(spark.createDataFrame([(5000, "a", "dd"), (5001, "lorem ipsum", "ee")], train.schema))
    model = cp.fit(stray)
    assert set(model.langs) == {*WORDS, "dd", "ee"}
    texts = [say(rng, k, 30) for k in list(WORDS) * 30]
    assert np.mean([p == k for p, k in zip(model.predict(texts)[0], list(WORDS) * 30)]) > 0.97


def test_many_scripts_keep_their_letters(spark, train):
    rng = random.Random(7)
    scripts = {f"s{at:x}": [chr(c) for c in range(at, at + 60) if cp.LETTER.match(chr(c))] for at in
               (0x430, 0x3B1, 0x5D0, 0x628, 0x905, 0xE01, 0x10D0, 0x561, 0x1200, 0xAC00, 0x4E00, 0xA000)}
    word = lambda k: "".join(rng.choice(scripts[k]) for _ in range(4))
    words = {k: [word(k) for _ in range(9)] for k in scripts}
    speak = lambda k, n: " ".join(rng.choice(words[k]) for _ in range(n))
    rows = [(6000 + i, speak(k, 30), k) for i, k in enumerate(list(scripts) * 20)]
    model = cp.fit(train.union(spark.createDataFrame(rows, train.schema)))
    assert model.width > 300
    langs = list(WORDS) * 10 + list(scripts) * 10
    texts = [say(rng, k, 30) if k in WORDS else speak(k, 30) for k in langs]
    assert np.mean([p == k for p, k in zip(model.predict(texts)[0], langs)]) > 0.97


def test_numbers_that_look_like_letters_are_none(spark, train):
    assert cp.fit(train).predict(["½ ² Ⅷ ① 12", "²", "ª"])[0][:2] == ["und", "und"]


def test_forty_languages_stay_small():
    rng = np.random.default_rng(8)
    nexts = []
    for _ in range(4):
        nexts += [{c: len(nexts) + to for c, to in out.items()} for out in cp.automaton(rng.zipf(1.5, 32_000).clip(0, 299).tolist())]
    edges = cp.Edges(nexts, 300)
    assert 10 * (edges.base.nbytes + edges.owner.nbytes + edges.target.nbytes) < 100_000_000
    for state in rng.choice(len(nexts), 300):
        assert edges.find(np.full(300, state, np.int32), np.arange(300)).tolist() == [nexts[state].get(c, 0) for c in range(300)]
