import base64
import random

import tiktoken
from public_tokenizers import PATTERN, path

import corpus_pipeline as cp
from rastertab.llm import byte_bpe
from rastertab.llm.byte_bpe import decode, encode, encoder, round_trip


def reference():
    lines = map(bytes.split, open(path("byte_bpe_50k.tiktoken"), "rb"))
    return tiktoken.Encoding(
        "own", pat_str=PATTERN, mergeable_ranks={base64.b64decode(a): int(b) for a, b in lines}, special_tokens={}
    )


def texts():
    rng = random.Random(5)
    letters = "abcdeeeiinst   .,'\n\t019éß漢🙂́"
    yield from (None, "", " ", "\n\n  a", "a" * 5000, "<|endoftext|>", "ÀÉ" * 40, "the the the")
    for n in range(300):
        yield "".join(rng.choice(letters) for _ in range(n))


def test_encoding_equals_the_library_and_decodes_to_the_text(spark):
    want = reference()
    rows = [(i if i % 7 else None, t, "x") for i, t in enumerate(texts())] + [(3, "twice", "y")] * 2
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, ids string")
    got = decode(encode(docs, keep=("doc_id", "text"))).collect()
    assert len(got) == len(rows)
    for r in got:
        assert r.ids == want.encode_ordinary(r.text or "")
        assert bytes(r.decoded).decode() == (r.text or "")


def test_lower_ranks_that_come_up_late_go_first():
    bpe = encoder()
    for word in ("ababab", "aaaaaaa", "abcabcabc", "xxyyxxyyxx"):
        from rastertab.llm.byte_bpe import MergeReplay

        ranks = {bytes([b]): b for b in range(256)} | {b"bc": 256, b"xy": 257, b"aa": 258, b"abc": 259, b"ab": 260, b"bca": 255 + 6}
        small = MergeReplay(ranks)
        lib = tiktoken.Encoding("s", pat_str=r"\S+", mergeable_ranks=ranks, special_tokens={})
        packed = small.replay([word.encode(), b"zz"])[0]
        ids = [int.from_bytes(packed[i : i + 4], "little") for i in range(0, len(packed), 4)]
        assert ids == lib.encode_ordinary(word)
    assert bpe.bytes_of[0]


def test_no_rows(spark):
    assert decode(encode(spark.createDataFrame([], "doc_id bigint, text string"))).count() == 0


def test_round_trip_needs_one_worker_a_task(spark):
    """Two passes held two workers with the whole rank table in every task."""
    rows = [(i if i % 7 else None, t) for i, t in enumerate(texts())] + [(3, "twice")] * 2
    docs = spark.createDataFrame(rows, "doc_id bigint, text string")
    both = round_trip(docs, keep=("doc_id", "text"))
    assert both._jdf.queryExecution().executedPlan().toString().count("MapInArrow") == 1
    want = reference()
    got = both.collect()
    assert len(got) == len(rows) and all(r.round_trip and r.ids == want.encode_ordinary(r.text or "") for r in got)
    encoded = cp.encode_tokens(spark, docs, "")
    assert encoded._jdf.queryExecution().executedPlan().toString().count("MapInArrow") == 1
    assert encoder().decode((65).to_bytes(4, "little") * 2) == encoder().bytes_of[65] * 2


def test_long_texts_are_split_run_by_run(monkeypatch):
    some = list(texts())
    whole = encoder().encode(some)
    monkeypatch.setattr(byte_bpe, "RUN_CHARS", 50)
    assert encoder().encode(some) == whole and encoder().encode([]) == []
