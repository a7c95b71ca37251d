"""Token files: frequency-ranked ids in byte-aligned variable-length coding with separate control bytes.

A file holds documents in ascending doc_id order. Ids are replaced by their rank in the corpus frequency order, so
frequent ids take one byte. A document's ranks are cut into quads: a control byte holds the four byte counts
(less one) of two bits each, the data bytes follow in a stream of their own. Decoding looks the lengths and shifts of
all control bytes up in numpy tables and never loops over ids.

Files are written by Spark's writer, one Parquet file per range of doc_ids, so a lost executor leaves no torn file and
any store that Spark reaches will do; columns ``control`` and ``data`` are the two streams of a document.
"""

from __future__ import annotations

import re
import string
from array import array
from bisect import bisect_left
from functools import lru_cache

import numpy as np
import pyarrow as pa
from public_tokenizers import path as tokenizer_path
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from tokenizers import Tokenizer, normalizers, pre_tokenizers

from rastertab.functions.state import new_path
from rastertab.llm.common import over_texts

TOKENIZER = "word_bpe_49k.json"
END = 1
KEY = ("doc_id", "text_hash")
KNOWN = 500_000  # chunks a worker remembers; a bound on memory only
COMBINING = re.compile("[̀-ͯ]")

LENGTHS = (np.arange(256)[:, None] >> np.array([0, 2, 4, 6]) & 3) + 1  # of the four numbers of a control byte


def pack(values: np.ndarray) -> tuple[bytes, bytes]:
    """(control, data) streams of unsigned 32-bit numbers; the last quad is filled with zeros."""
    v = np.zeros(-(-len(values) // 4) * 4, np.uint32)
    v[: len(values)] = values
    width = 2 if v.max(initial=0) < 1 << 16 else 4
    codes = (v >= 1 << 8).view(np.uint8)
    if width > 2:
        codes = codes + (v >= 1 << 16) + (v >= 1 << 24)
    quads = codes.reshape(-1, 4)
    control = quads[:, 0] | quads[:, 1] << 2 | quads[:, 2] << 4 | quads[:, 3] << 6
    raw = v.astype(f"<u{width}").view(np.uint8).reshape(-1, width)
    return control.tobytes(), raw[np.arange(width) <= codes[:, None]].tobytes()


def unpack(control: bytes, data: bytes, count: int) -> np.ndarray:
    """The ``count`` numbers of the two streams."""
    length = LENGTHS[np.frombuffer(control, np.uint8)].ravel()
    ends = np.cumsum(length)
    raw = np.concatenate((np.frombuffer(data, np.uint8), np.zeros(3, np.uint8))).astype(np.uint32)
    at = ends - length
    out = raw[at]
    for k in range(1, 4):
        out |= np.where(length > k, raw[at + k] << np.uint32(8 * k), np.uint32(0))
    return out[:count]


LETTERS = re.compile(rb"(?:[a-z]++|\xc3[\x9f-\xb6\xb8-\xbf])++")  # lower-case Latin-1 letters in UTF-8
MARKS = string.punctuation.encode()
NOT_LATIN = re.compile("[^\x00-\xff]")


class Chunks(dict):
    """Packed ids of chunks between blanks, encoded by the library when first met.

    Blanks end a word for the tokenizer, so a text's ids are those of its chunks in turn. Chunks of lower-case letters
    are single words that normalising leaves alone; all new ones of a piece are encoded in a few calls, without
    normalising, and cut where a token ends a word. ASCII marks after letters are a word of their own. A chunk met for
    the first time stands in its texts as an empty buffer that ``learn`` fills, so each word is looked up once. A text
    that spells a token which the library cuts out beforehand is left to the library as a whole.
    """

    def __init__(self, name: str):
        file = name if "/" in name else tokenizer_path(name)
        self.tokenizer, self.plain = Tokenizer.from_file(file), Tokenizer.from_file(file)
        self.special = sorted(t.content.lower() for t in self.tokenizer.get_added_tokens_decoder().values())
        self.first = {c for t in self.special for c in (t[0], t[0].upper())}
        self.plain.normalizer = normalizers.Sequence([])
        self.plain.pre_tokenizer = pre_tokenizers.Sequence(
            [pre_tokenizers.WhitespaceSplit(), pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)]
        )
        vocabulary = self.plain.get_vocab()
        self.ends = np.zeros(max(vocabulary.values()) + 1, bool)
        for token, i in vocabulary.items():
            self.ends[i] = token.endswith("</w>")
        self.cut = bool(self.ends.any())
        self.new: list[bytes] = []
        self.buffers: list[bytearray] = []

    def __missing__(self, chunk: bytes) -> bytearray:
        made = self[chunk] = bytearray()
        self.new.append(chunk)
        self.buffers.append(made)
        return made

    def known(self, chunk: bytes) -> bytes:
        """Packed ids of one chunk, by the library unless they are known."""
        made = self.get(chunk)
        if type(made) is not bytes:
            ids = self.tokenizer.encode(chunk.decode(), add_special_tokens=False).ids
            made = self[chunk] = array("I", ids).tobytes()
        return made

    def learn(self) -> None:
        """Fill the buffers of all chunks met since the last call."""
        words, slots, ended, match = [], [], [], LETTERS.fullmatch
        for chunk, buffer in zip(*self.taken()):
            head = chunk.rstrip(MARKS)
            if not match(head) or not self.cut:
                buffer[:] = self.known(chunk)
            elif len(head) == len(chunk):
                words.append(chunk)
                slots.append(buffer)
            else:
                self[head]  # a word of its own to learn, unless known
                ended.append((chunk, head, buffer))
        for all_of, more in zip((words, slots), self.taken()):
            all_of += more
        lines = [words[i : i + 500] for i in range(0, len(words), 500)]
        made = self.plain.encode_batch_fast([b" ".join(x).decode() for x in lines], add_special_tokens=False)
        slot = iter(slots)
        for line, e in zip(lines, made):
            ids = np.array(e.ids, "<u4")
            cuts = np.flatnonzero(self.ends[ids]) + 1
            if len(cuts) == len(line):
                flat, at = ids.tobytes(), [0, *(4 * cuts).tolist()]
                parts = [flat[a:b] for a, b in zip(at, at[1:])]
                self.update(zip(line, parts))
            else:
                parts = [self.known(word) for word in line]
            for part in parts:
                next(slot)[:] = part
        marks = {c: self.known(c) for c in {chunk[len(head) :] for chunk, head, _ in ended}}
        for chunk, head, buffer in ended:
            buffer[:] = self[chunk] = self[head] + marks[chunk[len(head) :]]

    def spells_special(self, text: str) -> bool:
        if not any(first in text for first in self.first):
            return False
        low = text.lower()
        return any(token in low for token in self.special)

    def taken(self) -> tuple[list[bytes], list[bytearray]]:
        """Chunks met since the last call and their buffers."""
        met = self.new, self.buffers
        self.new, self.buffers = [], []
        return met

    def encode(self, texts: list[str | None]) -> list[bytes]:
        """Packed uint32 ids of each text; None and "" have none."""
        if len(self) > KNOWN:
            self.clear()
        get, found = self.__getitem__, []
        for text in texts:
            text = text or ""
            if text.isascii() or not NOT_LATIN.search(text):  # lowering first changes nothing in the result
                raw = text.lower().encode()
            else:
                raw = text.encode()
                raw = raw if COMBINING.search(text) else raw.lower()
            if self.spells_special(text):
                found.append([array("I", self.tokenizer.encode(text, add_special_tokens=False).ids).tobytes()])
            else:
                found.append(list(map(get, raw.split())))
        self.learn()
        return [b"".join(parts) for parts in found]


@lru_cache(maxsize=2)
def chunks(name: str) -> Chunks:
    return Chunks(name)


def token_ids(docs: DataFrame, tokenizer: str = TOKENIZER, end: int | None = END) -> DataFrame:
    """(doc_id, text_hash, n, ids): packed little-endian uint32 ids of every whole text, with the end id.

    NULL and empty texts have the end id alone.
    """
    tail = b"" if end is None else np.array([end], "<u4").tobytes()

    def start():
        known = chunks(tokenizer)

        def step(texts):
            packed = [p + tail for p in known.encode(texts)]
            return [[len(p) // 4 for p in packed], packed]

        return step

    named = docs.select("doc_id", F.xxhash64("text").alias("text_hash"), "text")
    return over_texts(named, start, "n bigint, ids binary", ("doc_id", "text_hash"))


def frequency_ranks(tokens: DataFrame) -> np.ndarray:
    """Ids in descending order of frequency over all documents, equal ones ascending; one row per id is collected."""

    def run(batches):
        total = np.zeros(0, np.int64)
        for batch in batches:
            for value in batch.column(0):
                counts = np.bincount(np.frombuffer(value.as_buffer(), "<u4"))
                if len(counts) > len(total):
                    total, counts = counts, total
                total[: len(counts)] += counts
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(total[at])], ["id", "n"])

    counts = tokens.select("ids").mapInArrow(run, "id bigint, n bigint").groupBy("id").agg(F.sum("n").alias("n"))
    rows = counts.collect()  # as many as the vocabulary has entries
    ids, n = np.array([r.id for r in rows], np.int64), np.array([r.n for r in rows], np.int64)
    return ids[np.lexsort((ids, -n))]


def order_of(doc_id: int | None, text_hash: int) -> tuple[bool, int, int]:
    """A document's place in the files: NULL first, equal ids by their text."""
    return doc_id is not None, doc_id or 0, text_hash


def range_ends(keys: DataFrame, n: int) -> list[tuple[bool, int, int]]:
    """The last key of each of up to ``n`` even ranges of ``keys``, ascending; only keys are exchanged."""
    last = keys.repartitionByRange(n, *KEY).groupBy(F.spark_partition_id().alias("part")).agg(F.max(F.struct(*KEY)).alias("last"))
    return sorted(order_of(*row.last) for row in last.collect())


FILE = "shard int, start bigint, doc_id bigint, n bigint, control binary, data binary"


def write_files(tokens: DataFrame, path: str, ranks: np.ndarray) -> None:
    """Write ``tokens`` in ascending doc_id order (NULL first, equal ids by their text) as token files at ``path``.

    Documents are coded before they are dealt out by ranges of doc_id, so the exchange moves the coded streams; the
    ranges come from the keys alone, so nothing is coded twice. A file holds one range, and each document its start in
    the file. The id of each rank is part of ``path``/ranks, so the files can be read without anything else.
    """
    spark = tokens.sparkSession
    rank_of = np.zeros(int(ranks.max()) + 1 if len(ranks) else 1, np.uint32)
    rank_of[ranks] = np.arange(len(ranks))
    shared = spark.sparkContext.broadcast(rank_of)  # vocabulary size
    tokens = tokens.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text_hash", "n", "ids")
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    lasts = spark.sparkContext.broadcast(range_ends(tokens.select(*KEY), n)[:-1])  # one key per file

    def code(batches):
        for batch in batches:
            made = [pack(shared.value[np.frombuffer(v.as_buffer(), "<u4")]) for v in batch.column(3)]
            control, data = (pa.array([m[k] for m in made], pa.binary()) for k in (0, 1))
            keys = zip(*(column.to_pylist() for column in batch.columns[:2]))
            shards = pa.array([bisect_left(lasts.value, order_of(*key)) for key in keys], pa.int32())
            yield pa.RecordBatch.from_arrays([shards, *batch.columns[:3], control, data], ["shard", *names[2:3], "text_hash", *names[3:]])

    def place(batches):
        from pyspark import TaskContext

        shard, upto = TaskContext.get().partitionId(), 0
        for batch in batches:
            ends = upto + np.cumsum(batch.column(1).to_numpy())
            starts = pa.array(ends - batch.column(1).to_numpy())
            upto = int(ends[-1]) if len(ends) else upto
            shards = pa.array(np.full(len(ends), shard, np.int32))
            yield pa.RecordBatch.from_arrays([shards, starts, *batch.columns], names)

    names = T.StructType.fromDDL(FILE).names
    coded = tokens.mapInArrow(code, "shard int, doc_id bigint, text_hash bigint, n bigint, control binary, data binary")
    order = coded.repartitionById(n, "shard")
    order.sortWithinPartitions(*KEY).select("doc_id", "n", "control", "data").mapInArrow(place, FILE).write.option(
        "compression", "zstd"
    ).parquet(f"{path}/files")
    spark.createDataFrame([(ranks.tolist(),)], "ids array<bigint>").write.parquet(f"{path}/ranks")


def read_files(spark, path: str) -> DataFrame:
    """(doc_id, start, n_tokens, ids) of every document in the files; start counts the ids of all before it.

    A document knows its start in its file; only the files' id totals are added up across files.
    """
    files = spark.read.schema(FILE).parquet(f"{path}/files")
    ranks = np.array(spark.read.parquet(f"{path}/ranks").first().ids, "<u4")
    shared = spark.sparkContext.broadcast(ranks)
    totals = files.groupBy("shard").agg(F.max(F.col("start") + F.col("n")).alias("n")).orderBy("shard").collect()
    upto = np.concatenate(([0], np.cumsum([r.n for r in totals], dtype=np.int64)))  # one number per file
    first = spark.sparkContext.broadcast({r.shard: int(n) for r, n in zip(totals, upto)})

    def run(batches):
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                shard, start, doc, n, control, data = batch.slice(at, 256).columns
                counts = n.to_numpy()
                quads = -(-counts // 4) * 4  # numbers coded, the filling included
                values = unpack(b"".join(control.to_pylist()), b"".join(data.to_pylist()), int(quads.sum()))
                begins = np.cumsum(quads) - quads
                ids = shared.value[values].tobytes()
                begin = np.array([first.value[s] for s in shard.to_pylist()], np.int64)
                parts = [ids[4 * b : 4 * (b + c)] for b, c in zip(begins.tolist(), counts.tolist())]
                yield pa.RecordBatch.from_arrays(
                    [doc, pa.array(start.to_numpy() + begin), n, pa.array(parts, pa.binary())],
                    ["doc_id", "start", "n_tokens", "ids"],
                )

    return files.mapInArrow(run, "doc_id bigint, start bigint, n_tokens bigint, ids binary")


def token_files(docs: DataFrame, path: str | None = None, tokenizer: str = TOKENIZER, end: int | None = END) -> DataFrame:
    """Encode ``docs``, write their token files and return what the files hold, as ``read_files`` does.

    Without a path the files go to the shared checkpoint folder. NULL and empty texts are documents with the end id
    alone; a NULL doc_id comes first; rows with equal ids follow each other by the hash of their text, and repeated
    rows all stay. No rows make files without documents. Other columns are left out.
    """
    spark = docs.sparkSession
    path = path or new_path(spark, "token-files")
    held, found = f"{path}/ids", token_ids(docs, tokenizer, end)
    found.write.option("compression", "zstd").parquet(held)
    tokens = spark.read.schema(found.schema).parquet(held)
    write_files(tokens, path, frequency_ranks(tokens))
    return read_files(spark, path)
