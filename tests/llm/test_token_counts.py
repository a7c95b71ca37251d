import random

import numpy as np
import pytest
from public_tokenizers import path
from tokenizers import Tokenizer

from rastertab.llm import token_counts as tc
from rastertab.llm.byte_bpe import encoder


def texts():
    rng = random.Random(3)
    yield from (None, "", "\n", "\n\n\n a", "no end", "end\n", "é\n漢字🙂\n🙂🙂")
    for n in range(150):
        yield "".join(rng.choice("abc  é漢🙂.\n\n") for _ in range(n))


def test_spans_equal_the_library_offsets():
    lib, bpe = Tokenizer.from_file(path("byte_bpe_50k.json")), encoder()
    for text in filter(None, texts()):
        ids = np.frombuffer(bpe.encode([text])[0], "<i4")
        starts, ends = tc.token_spans(text, np.array([len(bpe.bytes_of[i]) for i in ids.tolist()]))
        made = lib.encode(text, add_special_tokens=False)
        assert made.ids == ids.tolist()
        if text.isascii():
            assert list(zip(starts, ends)) == made.offsets
        assert starts[0] == 0 and ends[-1] == len(text)


@pytest.mark.parametrize("rule", tc.RULES)
def test_sections_equal_a_slow_loop(spark, rule):
    rows = [(i if i % 5 else None, t, "x") for i, t in enumerate(texts())] + [(2, "twice\ntwice", "x")] * 2
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, tokens string")
    bpe = encoder()
    got = tc.section_tokens(docs, rule, section_end="\n", keep=("doc_id", "text")).collect()
    assert len(got) == len(rows)
    for r in got:
        text = r.text or ""
        begins = [0] + [i + 1 for i, c in enumerate(text) if c == "\n" and i + 1 < len(text)]
        assert r.begins == begins
        section = [sum(b <= i for b in begins) - 1 for i in range(len(text))]
        want, cross, at = np.zeros(len(begins)), 0, 0
        raw_char = [i for i, c in enumerate(text) for _ in c.encode()]
        for t in np.frombuffer(bpe.encode([text])[0], "<i4").tolist():
            size = len(bpe.bytes_of[t])
            held = sorted(set(raw_char[at : at + size]))
            at += size
            inside = [section[c] for c in held]
            cross += len(set(inside)) > 1
            if rule == "first":
                want[inside[0]] += 1
            elif rule == "most":
                want[max(sorted(set(inside)), key=inside.count)] += 1
            else:
                for s in inside:
                    want[s] += 1 / len(inside)
        assert np.allclose(r.tokens, want) and r.n_crossing == cross and abs(sum(r.tokens) - r.n_tokens) < 1e-9


def test_no_rows_and_an_unknown_rule(spark):
    docs = spark.createDataFrame([], "doc_id bigint, text string")
    assert tc.section_tokens(docs).count() == 0
    with pytest.raises(ValueError):
        tc.section_tokens(docs, "last")
