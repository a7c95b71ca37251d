"""Quality rules with a hashed n-gram log-likelihood ratio between trusted and raw text.

Byte n-grams of every document feed the raw multinomial, those of the trusted documents the target.
A document's score is the mean log ratio of its n-grams; the threshold is set once from labelled documents that the
multinomials have not seen, and applied to every document alike.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from rastertab.functions.state import settle
from rastertab.llm.common import over_texts

BITS = 16  # 2^16 buckets for all n-grams: a fixed size, whatever the corpus
GRAMS = (3, 5)
LOSS = 0.001  # share of trusted documents that the threshold may reject
SYMBOLS = "#*$%&|<>"
BLANKS = " \t\n\x0b\x0c\r"
WORD = re.compile(r"[^\x20\x09-\x0D]")


def buckets(raw: bytes) -> np.ndarray:
    """Bucket of every n-gram of the bytes, all sizes one after the other; texts shorter than that have none."""
    x = np.frombuffer(raw, np.uint8).astype(np.uint64)
    out = []
    for n in GRAMS:
        if len(x) >= n:
            h = np.zeros(len(x) - n + 1, np.uint64)
            for k in range(n):
                h |= x[k : len(x) - n + 1 + k] << np.uint64(8 * k)
            h = (h + np.uint64(n)) * np.uint64(0x9E3779B97F4A7C15)
            out.append((h >> np.uint64(64 - BITS)).astype(np.int64))
    return np.concatenate(out) if out else np.zeros(0, np.int64)


def text_rules(text: str | None) -> tuple[int, int, int, int, int]:
    """(n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words) of one text; None counts as empty."""
    if not text:
        return 0, 0, 0, 0, 0
    words = text.encode().split()  # bytes split at exactly \x20 and \x09-\x0D
    chars = len(text) - sum(map(text.count, BLANKS))
    symbols = sum(map(text.count, SYMBOLS))
    lines = [line for line in text.split("\n") if WORD.search(line)]
    repeated = 0
    if len(words) > 3:
        known: dict[bytes, int] = {}
        ids = np.array([known.setdefault(w, len(known)) for w in words], np.int64)
        two = np.unique(ids[:-2] * len(known) + ids[1:-1], return_inverse=True)[1]
        _, three, often = np.unique(two * len(known) + ids[2:], return_inverse=True, return_counts=True)
        if len(often) < len(three):
            starts = np.flatnonzero(often[three] >= 2)
            hit = np.zeros(len(words), bool)
            hit[starts] = hit[starts + 1] = hit[starts + 2] = True
            repeated = int(hit.sum())
    return len(words), chars, symbols, len(lines) - len(set(lines)), repeated


@dataclass
class Model:
    weights: np.ndarray  # log(target / raw) by bucket
    threshold: float

    def score(self, text: str | None) -> float:
        """Mean log ratio; 0 (no evidence) for texts without n-grams."""
        at = buckets((text or "").encode())
        return float(self.weights[at].mean()) if len(at) else 0.0


def _bucket_counts(texts: DataFrame) -> DataFrame:
    """(bucket, n) of the n-grams of column ``text``, added up by each task, so that no text leaves its task."""

    def run(batches):
        counts = np.zeros(1 << BITS, np.int64)
        for batch in batches:
            for text in batch.column(0):
                some = np.bincount(buckets((text.as_py() or "").encode()), minlength=0)
                counts[: len(some)] += some
        at = np.flatnonzero(counts)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(counts[at])], ["bucket", "n"])

    return texts.select("text").mapInArrow(run, "bucket bigint, n bigint")


def gram_counts(docs: DataFrame, trusted: DataFrame, where: Column | None = None) -> DataFrame:
    """(bucket, raw, target): n-gram counts of all documents and of those whose id is in ``trusted``.

    Each task adds up its documents and hands on one row per bucket, so a hot source or id costs nothing more. Only
    texts that meet ``where``, a condition on doc_id that holds for all trusted documents, are dealt out by their id;
    labels cover any share of the documents, so they are never sent to every executor.
    """
    raw = _bucket_counts(docs).select("bucket", F.col("n").alias("raw"), F.lit(0).cast("bigint").alias("target"))
    ids = trusted.select("doc_id").distinct().hint("shuffle_hash")
    some = docs if where is None else docs.where(where)
    own = _bucket_counts(some.select("doc_id", "text").join(ids, "doc_id"))
    parts = raw.unionByName(own.select("bucket", F.lit(0).cast("bigint").alias("raw"), F.col("n").alias("target")))
    return parts.groupBy("bucket").agg(F.sum("raw").alias("raw"), F.sum("target").alias("target"))


def fit(docs: DataFrame, labels: DataFrame, loss: float = LOSS) -> Model:
    """Counts over all documents, target counts and threshold over all labelled ones.

    Labelled documents with an even hash fit the target and the others set the threshold: midway between the lowest
    trusted scores (the share ``loss`` aside) and the highest rejected score below them; without rejected labels
    below, just under the trusted ones. Without trusted labels every ratio is 0 and the threshold keeps all.
    """
    labelled = labels.select("doc_id", "quality").dropna().distinct()
    half = lambda doc_id: F.xxhash64(doc_id, F.lit(7)) % 2 == 0
    even = half(F.col("doc_id"))
    own = half(F.col("doc_id").try_cast(labelled.schema["doc_id"].dataType))  # the same of documents, whatever their type
    trusted = labelled.where((F.col("quality") == 1) & even)
    raw, target = np.full(1 << BITS, 0.5), np.full(1 << BITS, 0.5)
    for row in gram_counts(docs, trusted, own).collect():  # at most one row per bucket
        raw[row.bucket] += row.raw
        target[row.bucket] += row.target
    if target.sum() < len(target):
        return Model(np.zeros(1 << BITS), -np.inf)
    # shrink the target towards the raw shares, so that buckets it hardly saw weigh little
    share = raw / raw.sum()
    prior = 0.05 * target.sum()
    weights = np.log((target + prior * share) / (target.sum() + prior) / share)
    model = Model(weights, -np.inf)
    # scores meet the labels, not texts: a row is a few bytes, and the texts stay where they are
    judged = scores(docs.where(~own), model).select("doc_id", "score", "n_words")
    rows = settle(judged.join(labelled.where(~even).hint("shuffle_hash"), "doc_id").select("quality", "score", "n_words"), "judged")
    good = rows.where("quality = 1 AND n_words >= 50").select("score")
    n = good.count()
    if n:
        low = good.orderBy("score").offset(int(loss * n)).first().score
        below = rows.where((F.col("quality") == 0) & (F.col("score") < F.lit(low))).agg(F.max("score").alias("m")).first().m
        model.threshold = float(low - 1e-9 if below is None else (low + below) / 2)
    return model


def scores(docs: DataFrame, model: Model, keep=("doc_id",)) -> DataFrame:
    """(``keep``…, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, score) of every whole text."""
    shared = docs.sparkSession.sparkContext.broadcast(model)  # 2^BITS doubles

    def step(texts):
        rules = zip(*map(text_rules, texts))
        return [*(rules if texts else [()] * 5), list(map(shared.value.score, texts))]

    added = "n_words bigint, word_chars bigint, n_symbols bigint, n_dup_lines bigint, n_repeat_words bigint, score double"
    return over_texts(docs, lambda: step, added, keep)


def judge(docs: DataFrame, model: Model, keep=("doc_id",), min_words: int = 50, max_repeat_percent: int = 50) -> DataFrame:
    """``scores`` with base_failed and kept.

    base_failed: fewer than ``min_words`` words, or more than ``max_repeat_percent`` % of them in repeated 3-word
    windows; kept: not base_failed and a score at or above the threshold. NULL and empty texts have no words and
    fail. Rows are judged one by one, so repeated rows and NULL or repeated ids get equal verdicts.
    """
    failed = (F.col("n_words") < min_words) | (100 * F.col("n_repeat_words") > max_repeat_percent * F.col("n_words"))
    return scores(docs, model, keep).withColumn("base_failed", failed).withColumn(
        "kept", ~failed & (F.col("score") >= F.lit(model.threshold))
    )


def keep_good(docs: DataFrame, model: Model) -> DataFrame:
    """The documents that pass, with their columns as they were."""
    names = docs.columns
    numbered = docs.toDF(*(f"c{i}" for i in range(len(names))))
    at = names.index("text")
    held = numbered.withColumns({"text": F.col(f"c{at}")})
    return judge(held, model, tuple(f"c{i}" for i in range(len(names)))).where("kept").select(
        *(F.col(f"c{i}").alias(n) for i, n in enumerate(names))
    )
