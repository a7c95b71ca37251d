"""Byte-level BPE encoding and decoding by merge replay over a corpus block.

The distinct pre-tokens of a block are laid side by side, one slot per byte. An inverted index holds, for every
token that a pair of neighbours can merge into, the slots where that pair stands. Merges are applied in rank order,
at all their slots at once; only the two neighbours of a merged slot enter the index anew. Texts are then looked up
pre-token by pre-token. Blocks are what a task holds of its partition, so nothing is shuffled and a lost task only
repeats its own block.
"""

from __future__ import annotations

import base64
import heapq
from functools import lru_cache

import numpy as np
import pyarrow as pa
import regex
from public_tokenizers import PATTERN, path
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from rastertab.llm.common import lists_of, over_texts

RANKS = "byte_bpe_50k.tiktoken"
KNOWN = 600_000  # pre-tokens a worker remembers before it starts over; a bound on memory only
RUN_CHARS = 1_000_000  # characters of texts that are split into pre-tokens at once; a bound on memory only


class MergeReplay:
    """Encoder for one rank table; ``ids`` maps pre-tokens to packed little-endian int32 ids."""

    def __init__(self, ranks: dict[bytes, int], pattern: str = PATTERN):
        self.ranks, self.pattern = ranks, regex.compile(pattern)
        self.size = max(ranks.values()) + 1
        self.bytes_of: dict[int, bytes] = {i: b for b, i in ranks.items()}
        self.first = np.array([ranks[bytes([b])] for b in range(256)], np.int64)
        self.pair = {
            ranks[a] * self.size + ranks[b]: i
            for token, i in ranks.items()
            for cut in range(1, len(token))
            if (a := token[:cut]) in ranks and (b := token[cut:]) in ranks
        }
        self.pair_of_bytes = np.full((256, 256), -1, np.int64)
        for a in range(256):
            for b in range(256):
                self.pair_of_bytes[a, b] = self.pair.get(int(self.first[a]) * self.size + int(self.first[b]), -1)
        self.known: dict[str, bytes] = {}

    def replay(self, words: list[bytes]) -> list[bytes]:
        """Packed ids of each non-empty word, all words merged together."""
        size, pair = self.size, self.pair
        raw = np.frombuffer(b"".join(words), np.uint8)
        ends = np.cumsum([len(w) for w in words])
        last = np.zeros(len(raw), bool)
        last[ends - 1] = True
        follows = np.where(last, -1, np.arange(1, len(raw) + 1))
        token, right = self.first[raw].tolist(), follows.tolist()
        left = np.concatenate(([-1], np.where(last, -1, np.arange(len(raw)))[:-1])).tolist()
        made = np.full(len(raw), -1, np.int64)
        made[:-1] = np.where(last[:-1], -1, self.pair_of_bytes[raw[:-1], raw[1:]])
        slots = np.flatnonzero(made >= 0)
        slots = slots[np.argsort(made[slots], kind="stable")]
        ranked, begins = np.unique(made[slots], return_index=True)
        index = {int(r): s.tolist() for r, s in zip(ranked, np.split(slots, begins[1:]))}
        heap = list(index)
        heapq.heapify(heap)
        get, push, pop = pair.get, heapq.heappush, heapq.heappop
        while heap:
            rank = pop(heap)
            places = index.pop(rank, None)
            if places is None:
                continue
            if len(places) > 1:
                places.sort()
            base = rank * size
            for done, i in enumerate(places):
                j = right[i]
                if j < 0 or get(token[i] * size + token[j]) != rank:
                    continue  # the pair has gone since it was indexed
                after, before, sooner = right[j], left[i], False
                token[i], token[j], right[i], right[j] = rank, -1, after, -1
                if after >= 0:
                    left[after] = i
                    merged = get(base + token[after])
                    if merged is not None:
                        sooner = merged < rank
                        if merged in index:
                            index[merged].append(i)
                        else:
                            index[merged] = [i]
                            push(heap, merged)
                if before >= 0:
                    merged = get(token[before] * size + rank)
                    if merged is not None:
                        sooner |= merged < rank
                        if merged in index:
                            index[merged].append(before)
                        else:
                            index[merged] = [before]
                            push(heap, merged)
                if sooner and done + 1 < len(places):  # a lower rank has come up: it goes first
                    if rank not in index:
                        index[rank] = []
                        push(heap, rank)
                    index[rank].extend(places[done + 1 :])
                    break
        tokens = np.array(token, np.int64)
        stays = tokens >= 0
        upto = np.concatenate(([0], np.cumsum(stays)))[np.concatenate(([0], ends))]
        flat, cuts = tokens[stays].astype("<i4").tobytes(), (4 * upto).tolist()
        return [flat[a:b] for a, b in zip(cuts, cuts[1:])]

    def learn(self, words: set[str]) -> None:
        """Add the ids of new pre-tokens; a pre-token that is itself in the table is one id."""
        todo, raws = [], []
        for w in words:
            raw = w.encode()
            if raw in self.ranks:
                self.known[w] = self.ranks[raw].to_bytes(4, "little")
            else:
                todo.append(w)
                raws.append(raw)
        if todo:
            self.known.update(zip(todo, self.replay(raws)))

    def encode(self, texts: list[str | None]) -> list[bytes]:
        """Packed int32 ids of each text; None and "" have none."""
        out, run, held = [], [], 0
        for text in texts:
            run.append(text)
            held += len(text or "")
            if held >= RUN_CHARS:
                out += self._encode_run(run)
                run, held = [], 0
        return out + self._encode_run(run)

    def _encode_run(self, texts: list[str | None]) -> list[bytes]:
        split = [self.pattern.findall(t) if t else [] for t in texts]
        if len(self.known) > KNOWN:
            self.known.clear()
        self.learn({w for w in set().union(*split) if w not in self.known})
        get = self.known.__getitem__
        return [b"".join(map(get, words)) for words in split]

    def decode(self, packed: bytes) -> bytes:
        """The bytes that packed int32 ids stand for."""
        return b"".join(map(self.bytes_of.__getitem__, np.frombuffer(packed, "<i4").tolist()))


@lru_cache(maxsize=2)
def encoder(ranks_file: str = RANKS, pattern: str = PATTERN) -> MergeReplay:
    """The worker's encoder for a rank file (a name of the tokenizer package, or a path on every executor)."""
    name = ranks_file if "/" in ranks_file else path(ranks_file)
    with open(name, "rb") as lines:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
    return MergeReplay(ranks, pattern)


def encode(docs: DataFrame, ranks_file: str = RANKS, pattern: str = PATTERN, keep=("doc_id",)) -> DataFrame:
    """(``keep``…, ids array<int>) of every whole text, without special tokens.

    NULL and empty texts give an empty array. Rows are independent: repeated rows and repeated or NULL ids are
    encoded as they come, an empty table gives an empty result, and other columns are left out.
    """

    def start():
        bpe = encoder(ranks_file, pattern)

        def step(texts):
            packed = bpe.encode(texts)
            return [lists_of(np.frombuffer(b"".join(packed), "<i4"), [len(p) // 4 for p in packed], pa.int32())]

        return step

    return over_texts(docs, start, "ids array<int>", keep)


def decode(rows: DataFrame, ranks_file: str = RANKS, ids: str = "ids", out: str = "decoded") -> DataFrame:
    """``rows`` with the bytes that each array of ids stands for (binary: ids may end inside a character).

    A NULL array gives NULL, an empty one no bytes; an id outside the table is an error.
    """
    fields = [f for f in rows.schema if f.name != out]
    at = [f.name for f in fields].index(ids)
    names = [*(f.name for f in fields), out]

    def run(batches):
        table = encoder(ranks_file).bytes_of
        for batch in batches:
            column = batch.column(at)
            made = [None if v is None else b"".join(map(table.__getitem__, v.tolist())) for v in _arrays(column)]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(made, pa.binary())], names=names)

    schema = T.StructType([*fields, T.StructField(out, T.BinaryType())])
    return rows.select(*(f.name for f in fields)).mapInArrow(run, schema)


def round_trip(docs: DataFrame, ranks_file: str = RANKS, pattern: str = PATTERN, keep=("doc_id",)) -> DataFrame:
    """(``keep``…, ids array<int>, round_trip boolean): :func:`encode`, and whether the ids decode to the whole text.

    One pass: each row is decoded where it was encoded, so neither its text nor its decoded bytes go to a second
    worker. NULL and empty texts have no ids, which decode to no bytes.
    """

    def start():
        bpe = encoder(ranks_file, pattern)

        def step(texts):
            packed = bpe.encode(texts)
            same = [bpe.decode(p) == (t or "").encode() for t, p in zip(texts, packed)]
            return [lists_of(np.frombuffer(b"".join(packed), "<i4"), [len(p) // 4 for p in packed], pa.int32()), same]

        return step

    return over_texts(docs, start, "ids array<int>, round_trip boolean", keep)


def _arrays(column: pa.Array):
    values, ends = column.values.to_numpy(zero_copy_only=False), column.offsets.to_numpy()
    valid = column.is_valid().to_numpy(zero_copy_only=False)
    return (values[a:b] if ok else None for a, b, ok in zip(ends[:-1], ends[1:], valid))
