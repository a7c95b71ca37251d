import random
import re
import struct
from collections import Counter, defaultdict

import pytest
import xxhash

from rastertab.llm import line_templates as lt


@pytest.fixture(scope="module")
def docs(spark):
    own = lambda i, k: f"w{chr(97 + i % 26)}{i}{k}x opens its own line number{k} here"
    rows = [(i, f"{own(i, 1)}\nCopyright {1990 + i} by the river press\n{own(i, 2)}", "x", 0) for i in range(8)]
    copy = "\n".join(f"shared prose of one copied text part {w}" for w in ("one", "two", "three"))
    rows += [(100 + i, copy, "x", 0) for i in range(9)]
    rows += [(200, None, "x", 0), (201, "", "x", 0), (202, "\n\n", "x", 0), (203, "too short\ntoo short", "x", 0)]
    rows += [(None, f"{own(50, 1)}\nCopyright 2020 by the river press", "x", 0), (7, "another text with this id", "x", 0)]
    return spark.createDataFrame(rows, "doc_id bigint, text string, line_no string, n_chars bigint")


def test_recurring_templates_go_and_copies_stay(docs):
    out = lt.drop_template_lines(docs)
    assert out.columns == docs.columns
    rows = out.collect()
    assert len(rows) == docs.count()
    before = {(r.doc_id, r.text) for r in docs.collect()}
    for r in rows:
        assert "Copyright" not in (r.text or "")
        assert r.n_chars == (None if r.text is None else len(r.text))
        if r.doc_id is not None and 7 < r.doc_id or r.doc_id == 7 and "another" in r.text:
            assert (r.doc_id, r.text) in before
        elif r.doc_id is not None:
            assert len(r.text.split("\n")) == 2
    found = lt.template_lines(docs).collect()
    assert {r.template for r in found} == {"Copyright <*> by the river press"}
    assert len(found) == 9


def test_counts_and_no_rows(spark, docs):
    rows = lt.drop_template_lines(docs, counts=True).collect()
    assert sum(r.n_dropped for r in rows) == 9
    assert {r.n_lines for r in rows if r.text is None} == {0}
    assert lt.drop_template_lines(docs.limit(0)).count() == 0


def slow_templates(texts):
    """{(text, line_no): template} by plain loops: the rule of ``text_templates`` once more."""
    general = lambda x: [w for w in re.split(r"[\x20\x09-\x0D]+", re.sub("[0-9]+", "0", x)) if w]
    mark = lambda x: struct.unpack("<q", struct.pack("<Q", xxhash.xxh64_intdigest(x.encode(), 42)))[0]
    lines = []
    for text in texts:
        for i, line in enumerate(text.split("\n")):
            w = general(line)
            if len(w) >= 4:
                anchors = [mark(" ".join(w[:8])), mark("end " + " ".join(w[-8:]))] if len(w) >= 16 else [mark(" ".join(w))]
                lines.append((text, i, [t for t in re.split(r"[\x20\x09-\x0D]+", line) if t], (len(w), " ".join(w[:3])), anchors))
    holders = defaultdict(set)
    for text, _, _, _, anchors in lines:
        for a in anchors:
            holders[a].add(text)
    named, led = {}, {}
    for text in texts:
        mine = [x for x in lines if x[0] == text]
        shared = sorted({a for x in mine for a in x[4] if len(holders[a]) > 1})
        if sum(any(len(holders[a]) > 1 for a in x[4]) for x in mine) > 2 / 3 * len(mine):
            named[text] = shared[0]
            if len(shared) > 1:
                led[shared[1]] = min(shared[0], led.get(shared[1], shared[0]))
    group = {t: led.get(a, a) for t, a in named.items()}
    places = defaultdict(set)
    for text, _, _, leaf, _ in lines:
        places[leaf].add(text)
    inside = [x for x in lines if len(places[x[3]]) >= 5]
    often = Counter((x[3], p, t) for x in inside for p, t in enumerate(x[2]) if not re.search("[0-9]", t))
    made, met = {}, defaultdict(set)
    for text, i, words, leaf, _ in inside:
        known = [often[leaf, p, t] >= 5 for p, t in enumerate(words)]
        if 2 * sum(known[3:]) >= len(known[3:]):
            made[text, i] = " ".join(t if k else "<*>" for t, k in zip(words, known))
            met[made[text, i]].add(group.get(text, text))
    return {k: t for k, t in made.items() if len(met[t]) >= 5}


@pytest.mark.parametrize("sf", ["0.001", "0.01"])
def test_brute_force_templates(spark, sf):
    docs = spark.read.parquet(f"/root/testdata/sf{sf}/documents.parquet").select("doc_id", "text")
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    hot = slow_templates(sorted({t for _, t in rows if t}))
    by_text = defaultdict(list)
    for (text, i), template in hot.items():
        by_text[text].append((i, template))
    want = sorted({(d, i, template) for d, t in rows for i, template in by_text[t]})
    assert want
    assert sorted((r.doc_id, r.line_no, r.template) for r in lt.template_lines(docs).collect()) == want


def words_of(rng, n):
    return " ".join("".join(rng.choice("bcdfghklmnprst") + rng.choice("aeiou") for _ in range(3)) for _ in range(n))


def test_notices_go_from_texts_with_common_openings(spark):
    rng = random.Random(1)
    openings = ["he said that", "on the other", "there was a", "it is the", "in the end", "as soon as", "at last they", "one of the"]
    notices = ["printed by the old river press", "all rights are with the house", "write to us for a licence", "no part may be sold again"]
    rows = [(i, f"{rng.choice(openings)} {words_of(rng, 6)}\n{rng.choice(openings)} {words_of(rng, 6)}\n{notices[i % 4]}") for i in range(200)]
    rows += [(1000 + i, "\n".join(f"{rng.choice(openings)} {words_of(rng, 7)}" for _ in range(4)) + "\nthis page was made by hand") for i in range(600)]
    out = {r.doc_id: r.text for r in lt.drop_template_lines(spark.createDataFrame(rows, "doc_id bigint, text string")).collect()}
    for i, text in rows:
        assert out[i].split("\n") == text.split("\n")[:-1]


def test_header_and_footer_around_one_own_line_go(spark):
    rng = random.Random(2)
    rows = [(i, f"a header of the old house\n{words_of(rng, 8)}\na footer of the old house") for i in range(200)]
    out = {r.doc_id: r.text for r in lt.drop_template_lines(spark.createDataFrame(rows, "doc_id bigint, text string")).collect()}
    assert out == {i: t.split("\n")[1] for i, t in rows}


def test_prose_with_one_opening_stays(spark):
    rng = random.Random(3)
    rows = [(i, "\n".join([words_of(rng, 9), f"he said that {words_of(rng, 3)}", words_of(rng, 9)])) for i in range(40)]
    out = lt.drop_template_lines(spark.createDataFrame(rows, "doc_id bigint, text string"))
    assert sorted((r.doc_id, r.text) for r in out.collect()) == rows


def test_a_text_of_very_many_lines(spark):
    rng = random.Random(4)
    long = "\n".join(f"{words_of(rng, 6)}\nprinted by the old river press" for _ in range(3000))
    rows = [(0, long)] + [(1 + i, f"{words_of(rng, 6)}\nprinted by the old river press\n{words_of(rng, 6)}") for i in range(6)]
    out = {r.doc_id: r.text for r in lt.drop_template_lines(spark.createDataFrame(rows, "doc_id bigint, text string")).collect()}
    assert out[0].split("\n") == long.split("\n")[::2]
