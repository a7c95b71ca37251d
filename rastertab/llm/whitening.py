"""Embedding whitening by shifted CholeskyQR.

The distinct integer vectors are the rows of a tall matrix Y, centred on their mean. Each Gram pass sums YᵀY over all
partitions; the driver factors the small matrix, tasks multiply their rows with the inverse factor while they read them
again, and the next pass starts from rows that are closer to orthonormal. The first factorisation is shifted so that it
can't break down, two more make Q orthogonal to working precision. Singular values and right vectors of the composed R
are those of Y: squared over n they are the covariance's eigenvalues, without its squared condition number.

The driver holds square matrices of the dimension, never rows: 64 dimensions are 32 KB, 4096 are 134 MB.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rastertab.functions.state import settle

# The grid of the integer vectors.
SCALE, OFFSET = 64, 1_000_000
PASSES = 3  # the first is shifted
TOP = 16  # components that are returned
NIL = 1e-12  # share of the total variance under which a direction counts as constant
SAFE = 1 << 53  # largest |64 c| that a double tells from its neighbours
ROWS = 4096


@dataclass
class Whitening:
    n: int
    sums: list[int]  # per dimension, exact
    values: np.ndarray  # eigenvalues, falling
    vectors: np.ndarray  # a column per component
    trace: float
    identity_error: float


def integer_vectors(embeddings: DataFrame, *keep: str) -> DataFrame:
    """Columns ``keep`` and x (int64 values, little-endian) of every usable row.

    Unusable are NULL vectors, vectors with NULL or non-finite entries or entries beyond 2^53 / 64, and empty ones.
    """
    n = len(keep)
    kept = [embeddings.schema[c] for c in keep]

    def run(batches):
        for batch in batches:
            column = batch.column(n)
            lists = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
            picked, out = [], []
            for k in range(batch.num_rows):
                if not lists[k].is_valid:
                    continue
                values = lists[k].values
                if values.null_count or not len(values):
                    continue
                x = np.asarray(values.to_numpy(zero_copy_only=False), np.float64) * SCALE
                if np.isfinite(x).all() and np.abs(x).max() < SAFE:
                    picked.append(k)
                    out.append((np.floor(x).astype("<i8") + OFFSET).tobytes())
            rows = batch.take(pa.array(picked, pa.int64()))
            yield pa.RecordBatch.from_arrays([*rows.columns[:n], pa.array(out, pa.binary())], names=[*keep, "x"])

    ddl = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in kept)
    return embeddings.select(*keep, F.col("embedding").alias("_v")).mapInArrow(run, f"{ddl}, x binary" if ddl else "x binary")


def _blocks(batches, column: int):
    """int64 matrices of at most ROWS rows from binary vectors."""
    for batch in batches:
        for at in range(0, batch.num_rows, ROWS):
            some = batch.column(column).slice(at, ROWS).to_pylist()
            if some:
                yield np.frombuffer(b"".join(some), "<i8").reshape(len(some), -1)


def _summed(fit: DataFrame, rows_of, width: int) -> np.ndarray:
    """Sum over all partitions of the square matrices that ``rows_of`` makes from integer blocks."""

    def run(batches):
        total = np.zeros((width, width))
        for x in _blocks(batches, 0):
            y = rows_of(x)
            total += y.T @ y
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(width)), pa.array(list(total), pa.list_(pa.float64()))], ["i", "g"])

    parts = fit.select("x").mapInArrow(run, "i bigint, g array<double>")
    cells = parts.select("i", F.posexplode("g").alias("j", "v")).groupBy("i", "j").agg(F.sum("v").alias("v"))
    out = np.zeros((width, width))
    for r in cells.groupBy("i").agg(F.collect_list(F.struct("j", "v")).alias("row")).toLocalIterator():  # width rows
        for j, v in r.row:
            out[r.i, j] = v
    return (out + out.T) / 2


def fit(vectors: DataFrame) -> Whitening | None:
    """Whitening of the distinct ``x`` of ``vectors``; None if there are none.

    Vectors of another length than most (the shorter, if tied) are left out.
    """
    distinct = settle(vectors.select("x").distinct(), "distinct")
    sizes = distinct.groupBy((F.length("x") / 8).cast("int").alias("d")).agg(F.count(F.lit(1)).alias("n"))
    first = sizes.orderBy(F.desc("n"), "d").first()  # one row per length
    if first is None:
        return None
    d, n = first.d, first.n
    distinct = distinct.where(F.length("x") == 8 * d)

    def add(batches):
        low, high = np.zeros(d, np.int64), np.zeros(d, np.int64)
        for x in _blocks(batches, 0):  # halves, so that no partition's sum leaves 63 bits
            high += (x >> 32).sum(axis=0)
            low += (x & 0xFFFFFFFF).sum(axis=0)
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(d)), pa.array(high), pa.array(low)], ["i", "high", "low"])

    parts = distinct.mapInArrow(add, "i bigint, high bigint, low bigint")
    total = {r.i: (int(r.high) << 32) + int(r.low) for r in parts.groupBy("i").agg(F.sum("high").alias("high"), F.sum("low").alias("low")).collect()}
    sums = [total[i] for i in range(d)]
    base = np.array([s // n for s in sums]), np.array([(s % n) / n for s in sums])
    centre = lambda x: (x - base[0]).astype(np.float64) - base[1]

    gram = _summed(distinct, centre, d)
    trace = float(np.trace(gram)) / n
    nothing = Whitening(n, sums, np.zeros(0), np.zeros((d, 0)), trace, 0.0)
    if not trace > 0:
        return nothing
    # Directions without variance (constant or dependent dimensions, fewer rows than dimensions) have no factor: the
    # tour through R runs on the others, in a rotated basis if there are any.
    values, basis = np.linalg.eigh(gram)
    alive = values > NIL * values.sum()
    basis = np.eye(d) if alive.all() else basis[:, alive]
    width = basis.shape[1]
    r, back = np.eye(width), basis
    unit = np.finfo(float).eps / 2
    for k in range(PASSES):
        gram = (basis.T @ gram @ basis) if k == 0 else _summed(distinct, lambda x, b=back: centre(x) @ b, width)
        shift = 11 * (n * width + width * (width + 1)) * unit * np.linalg.norm(gram, 2) if k == 0 else 0.0
        shift = min(shift, 1e-3 * np.linalg.norm(gram, 2))
        upper = np.linalg.cholesky(gram + shift * np.eye(width)).T
        r = upper @ r
        # triangular solve: rows y of Y become y R^-1
        back = np.linalg.solve(r.T, basis.T).T
    _, sing, right = np.linalg.svd(r)
    kept = min(TOP, width)
    model = Whitening(n, sums, sing[:kept] ** 2 / n, basis @ right[:kept].T, trace, 0.0)
    project = model.vectors / np.sqrt(model.values)
    cov = _summed(distinct, lambda x: centre(x) @ project, kept) / n
    model.identity_error = float(np.abs(cov - np.eye(kept)).max())
    return model


def whiten(embeddings: DataFrame, *keep: str) -> DataFrame:
    """Columns ``keep``, n, deviation, whitened, explained and identity_error of every usable row.

    ``whitened`` and ``explained`` are arrays over at most 16 components, by falling eigenvalue; directions with less
    than 1e-12 of the variance are none. ``deviation`` is exact and NULL where it leaves 63 bits. Unusable rows (see
    :func:`integer_vectors`) and vectors of another length are left out; copies count once for the fit, and each of
    them is whitened. Extra columns are ignored. No usable row gives no rows.
    """
    vectors = settle(integer_vectors(embeddings, *keep), "vectors")
    model = fit(vectors)
    n_keep = len(keep)
    added = "n bigint, deviation bigint, whitened array<double>, explained array<double>, identity_error double"
    ddl = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in vectors.schema if f.name != "x")
    if model is None:
        return vectors.where("false").select(*keep, *(F.lit(None).cast(c.split(" ")[1]).alias(c.split(" ")[0]) for c in added.split(", ")))
    # a matrix of 16 columns and two vectors of the dimension travel with the task
    n, d, sums = model.n, len(model.sums), np.array(model.sums, object)
    whole = np.array([s // n for s in model.sums])
    rest = np.array([s % n for s in model.sums])
    project = model.vectors / np.sqrt(model.values)
    explained = (model.values / model.trace).tolist() if len(model.values) else []
    error = model.identity_error

    def deviations(x: np.ndarray) -> list[int | None]:
        away = x - whole
        most = int(np.abs(away).max()) + 1
        if (most * n) ** 2 * d < 2**63:
            return ((away * n - rest) ** 2).sum(axis=1).tolist()
        exact = [sum(int(v) ** 2 for v in row) for row in x.astype(object) * n - sums]
        return [v if v < 2**63 else None for v in exact]

    def run(batches):
        for batch in batches:
            at = 0
            for x in _blocks([batch], n_keep):
                m = len(x)
                values = ((x - whole).astype(np.float64) - rest / n) @ project
                yield pa.RecordBatch.from_arrays(
                    [
                        *(c.slice(at, m) for c in batch.columns[:n_keep]), pa.array(np.full(m, n)), pa.array(deviations(x), pa.int64()),
                        pa.array(list(values), pa.list_(pa.float64())), pa.array([explained] * m, pa.list_(pa.float64())), pa.array(np.full(m, error)),
                    ],
                    names=[*keep, "n", "deviation", "whitened", "explained", "identity_error"],
                )
                at += m

    usable = vectors.where(F.length("x") == 8 * d).select(*keep, "x")
    return usable.mapInArrow(run, f"{ddl}, {added}" if ddl else added)
