import random

import numpy as np
from public_tokenizers import path
from tokenizers import Tokenizer

from rastertab.llm import token_files as t


def test_streams_round_trip():
    rng = np.random.default_rng(1)
    for n in (0, 1, 3, 4, 5, 1000):
        for top in (2, 200, 70_000, 2**24 + 5, 2**32):
            values = rng.integers(0, top, n).astype(np.uint32)
            control, data = t.pack(values)
            assert len(control) == -(-n // 4)
            assert np.array_equal(t.unpack(control, data, n), values)


def test_files_hold_what_the_library_encodes(spark, tmp_path):
    rng = random.Random(3)
    letters = "abJKs ,.'\n\t019éßİΣ漢🙂̌́  "
    texts = [None, "", "It's,", "x',", "J̌ow", "ÀÉ." * 30, "<|endoftext|> a", "a.b.,", "ΑΣ ΣΑΣ", "été, École. ÿß µ x.", "\xa0a\x85b\x1cc"]
    texts += ["a <|endoftext|> b", "x<|endoftext|>y  z", "<|STARTOFTEXT|> z", " <|endoftext|>\n", "<|endoftext|><|endoftext|>", "<|endoftext| >", "É<|startoftext|>É́"]
    texts += ["".join(rng.choice(letters) for _ in range(n)) for n in range(300)]
    rows = [(3 * i % 1000 if i else None, x, "s") for i, x in enumerate(texts)] + [(3, "again", "s")] * 2
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, start string")
    lib = Tokenizer.from_file(path("word_bpe_49k.json"))
    want = sorted((-1 if d is None else d, lib.encode(x or "", add_special_tokens=False).ids + [1]) for d, x, _ in rows)
    got = t.token_files(docs, str(tmp_path / "f")).orderBy("start").collect()
    upto = 0
    for r in got:
        assert (r.start, r.n_tokens * 4) == (upto, len(r.ids))
        upto += r.n_tokens
    order = [-1 if r.doc_id is None else r.doc_id for r in got]
    assert order == sorted(order)
    assert sorted((d, np.frombuffer(r.ids, "<u4").tolist()) for d, r in zip(order, got)) == want


def test_no_rows(spark):
    assert t.token_files(spark.createDataFrame([], "doc_id bigint, text string")).count() == 0
