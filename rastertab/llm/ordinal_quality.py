"""Quality classifier: ordinal cumulative-link regression on graded ratings.

One weight per hashed token is shared by all grades; ordered thresholds cut the weighted sum into grades:
P(grade >= k) = sigmoid(w . x - cut_k). Selection uses the tail probability of a grade; the expected grade is the sum
of the tails.
"""

from __future__ import annotations

import re
import zlib
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rastertab.llm.common import bounded_sample, over_texts

BITS = 18
PER_GRADE = 2500  # rated documents used of each grade at most, four fifths to fit and the rest to set the cut-off
STEPS = 250
DECAY = 2e-5
LOSS = 0.01  # share of the top grade that the cut-off may give up
TOKEN = re.compile(rb"[a-z\x80-\xff]+|[^a-z\x80-\xff\s]")


def features(text: str | None) -> tuple[np.ndarray, np.ndarray]:
    """Buckets of a text's tokens (words in lower case, other characters singly) and their weights: log(1 + count),
    scaled to unit length."""
    tokens = TOKEN.findall((text or "").encode().lower())
    at, n = np.unique(np.fromiter(map(zlib.crc32, tokens), np.uint32, len(tokens)) >> np.uint32(32 - BITS), return_counts=True)
    x = np.log1p(n)
    return at.astype(np.int64), x / max(np.sqrt((x * x).sum()), 1e-12)


@dataclass
class Model:
    weights: np.ndarray
    cuts: np.ndarray  # ascending, one less than there are grades
    cutoff: float  # of the top grade's tail probability

    def tails(self, text: str | None) -> np.ndarray:
        """P(grade >= k) for k = 1, 2, …"""
        at, x = features(text)
        return 1 / (1 + np.exp(self.cuts - (self.weights[at] * x).sum()))


def train(texts: list, grades: np.ndarray, n_grades: int, steps: int = STEPS, decay: float = DECAY) -> tuple[np.ndarray, np.ndarray]:
    """(weights, cuts) by Adam on the mean negative log likelihood; cuts are a first one plus positive gaps.

    Grades weigh alike however many rows they have.
    """
    made = [features(t) for t in texts]
    size = np.array([len(a) for a, _ in made])
    at, x = np.concatenate([a for a, _ in made]), np.concatenate([v for _, v in made])
    row = np.repeat(np.arange(len(made)), size)
    share = 1 / np.maximum(np.bincount(grades, minlength=n_grades), 1)
    weight = share[grades] / share[grades].sum()
    w, cut = np.zeros(1 << BITS), np.concatenate(([0.0], np.zeros(n_grades - 2)))
    state = [np.zeros_like(v) for v in (w, w, cut, cut)]
    sigmoid = lambda v: 1 / (1 + np.exp(-np.clip(v, -40, 40)))
    for step in range(1, steps + 1):
        gaps = np.exp(cut[1:])
        bounds = np.concatenate(([-40.0], cut[0] + np.concatenate(([0.0], np.cumsum(gaps))), [40.0]))
        z = np.bincount(row, weights=w[at] * x, minlength=len(made))
        low, high = sigmoid(z - bounds[grades]), sigmoid(z - bounds[grades + 1])
        p = np.maximum(low - high, 1e-12)
        dlow, dhigh = low * (1 - low) / p, high * (1 - high) / p
        dz = -weight * (dlow - dhigh)
        db = np.zeros(n_grades + 1)
        np.add.at(db, grades, weight * dlow)
        np.add.at(db, grades + 1, -weight * dhigh)
        inner = db[1:-1]
        dcut = np.concatenate(([inner.sum()], np.cumsum(inner[::-1])[::-1][1:] * gaps))
        dw = np.bincount(at, weights=x * dz[row], minlength=len(w)) + decay * w
        for k, (value, grad, rate) in enumerate(((w, dw, 0.5), (cut, dcut, 0.05))):
            m, v = state[2 * k], state[2 * k + 1]
            m += 0.1 * (grad - m)
            v += 0.01 * (grad * grad - v)
            value -= rate * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.99**step)) + 1e-9)
    return w, cut[0] + np.concatenate(([0.0], np.cumsum(np.exp(cut[1:]))))


def fit(docs: DataFrame, ratings: DataFrame, n_grades: int = 3, per_grade: int = PER_GRADE) -> Model:
    """Model from ``ratings`` (doc_id, grade 0 … n_grades - 1), ``per_grade`` of each grade at most, trained in one
    task on that bounded sample.

    The cut-off of the top grade's tail is set on rated documents the training left out: midway between the score
    under which the share ``LOSS`` of the top grade's documents lie and the highest lower-graded one beneath it. Without ratings,
    or with a single grade, all weights are 0 and the cut-off keeps every document.
    """
    rated = ratings.dropna().select("doc_id", F.col("grade").cast("int").alias("grade")).where(F.col("grade").between(0, n_grades - 1))
    parts = [bounded_sample(rated.where(F.col("grade") == g), "doc_id", per_grade) for g in range(n_grades)]
    chosen = parts[0]
    for p in parts[1:]:
        chosen = chosen.union(p)
    sample = docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id")  # at most per_grade x n_grades ids

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["doc_id", "grade"]).reset_index(drop=True)
        grades = pdf["grade"].to_numpy(np.int64)
        aside = (pdf["doc_id"].map(lambda d: zlib.crc32(str(d).encode())) % 5 == 0).to_numpy()
        if len(set(grades[~aside])) < 2:
            return pd.DataFrame({"weights": [b""], "cuts": [[0.0] * (n_grades - 1)], "cutoff": [-1.0]})
        texts = pdf["text"].where(pdf["text"].notna(), None)
        w, cuts = train(texts[~aside].tolist(), grades[~aside], n_grades)
        model = Model(w.astype(np.float32), cuts, 0.0)
        top = np.array([model.tails(t)[-1] for t in texts[aside]])
        good, rest = np.sort(top[grades[aside] == n_grades - 1]), top[grades[aside] < n_grades - 1]
        if len(good):
            low = good[int(LOSS * len(good))]
            under = rest[rest < low]
            model.cutoff = float((low + under.max()) / 2) if len(under) else float(low)
        return pd.DataFrame({"weights": [model.weights.tobytes()], "cuts": [cuts.tolist()], "cutoff": [model.cutoff]})

    row = sample.withColumn("all", F.lit(0)).groupBy("all").applyInPandas(run, "weights binary, cuts array<double>, cutoff double").first()
    if row is None or not row.weights:
        return Model(np.zeros(1 << BITS, np.float32), np.zeros(n_grades - 1), -1.0)
    return Model(np.frombuffer(row.weights, np.float32), np.array(row.cuts), row.cutoff)


def grade(docs: DataFrame, model: Model, keep=("doc_id",)) -> DataFrame:
    """(``keep``…, expected_grade, tails, kept) of every whole text; kept: the top grade's tail reaches the cut-off.

    NULL and empty texts have no tokens and get the tails of the cuts alone. Only the text decides, so repeated rows
    and NULL ids need no care; no rows give no rows.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def step(texts):
        model = shared.value
        tails = [model.tails(t) for t in texts]
        return [[float(t.sum()) for t in tails], [t.tolist() for t in tails], [bool(t[-1] >= model.cutoff) for t in tails]]

    return over_texts(docs, lambda: step, "expected_grade double, tails array<double>, kept boolean", keep)
