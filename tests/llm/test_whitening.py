import math

import numpy as np
import pytest

from rastertab.llm import whitening as w
from rastertab.llm.queries import whitened_rows

SCHEMA = "vec_id bigint, embedding array<float>, n int, x string, deviation int"


def frame(spark, rows):
    return spark.createDataFrame([(i, v, 0, "x", 1) for i, v in rows], SCHEMA)


def usable(rows):
    out = []
    for i, v in rows:
        if v and all(e is not None and math.isfinite(e) for e in v):
            out.append((i, tuple(math.floor(64 * float(np.float32(e))) + 1_000_000 for e in v)))
    return out


def check(got, rows, rank=None):
    kept = usable(rows)
    fit = sorted({x for _, x in kept})
    n, d = len(fit), len(fit[0])
    sums = [sum(x[k] for x in fit) for k in range(d)]
    y = np.array([[x[k] - sums[k] / n for k in range(d)] for x in fit])
    cov = y.T @ y / n
    e, vectors = np.linalg.eigh(cov)
    e, vectors = e[::-1], vectors[:, ::-1]
    k = min(16, d) if rank is None else rank
    assert len(got) == k * len(kept)
    by = {}
    for r in got:
        by.setdefault(r.component, []).append(r)
    order = sorted(kept, key=lambda r: str(r))
    for c in range(1, k + 1):
        mine = sorted(by[c], key=lambda r: str((r.vec_id, next(x for i, x in kept if i == r.vec_id))))
        assert [r.vec_id for r in mine] == [i for i, _ in order]
        want = np.array([np.dot(np.array(x) - np.array(sums) / n, vectors[:, c - 1]) for _, x in order]) / math.sqrt(e[c - 1])
        have = np.array([r.whitened for r in mine])
        assert min(np.abs(have - want).max(), np.abs(have + want).max()) < 1e-6
        for r, (_, x) in zip(mine, order):
            assert r.n == n and r.deviation == sum((n * a - s) ** 2 for a, s in zip(x, sums))
            assert abs(r.explained - e[c - 1] / e.sum()) < 1e-9 and r.identity_error < 1e-9


def random_rows(seed, n, d, spread=8.0):
    rng = np.random.default_rng(seed)
    mix = rng.normal(size=(d, d)) * np.geomspace(1, spread, d)
    return [(i, [float(v) for v in (rng.normal(size=d) @ mix).astype(np.float32)]) for i in range(n)]


@pytest.mark.parametrize("d", [3, 24])
def test_equals_eigenvectors(spark, d):
    rows = random_rows(d, 120, d)
    rows += [(1000 + i, rows[0][1]) for i in range(80)]  # copies count once in the fit
    rows += [(2000, None), (2001, [None] + rows[0][1][1:]), (2002, [float("nan")] + rows[0][1][1:]), (2003, [float("inf")] + rows[0][1][1:]), (2004, [])]
    check(whitened_rows(frame(spark, rows)).collect(), rows)


def test_badly_scaled_columns(spark):
    rows = random_rows(5, 200, 6, spread=1e4)
    check(whitened_rows(frame(spark, rows)).collect(), rows)


def test_constant_and_dependent_dimensions(spark):
    rng = np.random.default_rng(1)
    a = rng.integers(-50, 50, (60, 2)) / 4
    rows = [(i, [float(p), 3.0, float(q), float(p + q)]) for i, (p, q) in enumerate(a)]
    check(whitened_rows(frame(spark, rows)).collect(), rows, rank=2)


def test_no_rows_one_row_and_other_lengths(spark):
    assert whitened_rows(frame(spark, [])).collect() == []
    assert whitened_rows(frame(spark, [(1, None)])).collect() == []
    assert whitened_rows(frame(spark, [(1, [1.0, 2.0]), (2, [1.0, 2.0])])).collect() == []  # no variance, no component
    rows = random_rows(9, 30, 3)
    check(whitened_rows(frame(spark, [*rows, (99, [1.0, 2.0])])).collect(), rows)


def test_vec_id_may_be_missing_or_repeated(spark):
    rows = [(None, v) for _, v in random_rows(4, 5, 2)] + [(7, v) for _, v in random_rows(6, 5, 2)]
    assert len(whitened_rows(frame(spark, rows)).collect()) == 20


def test_deviation_beyond_64_bits_is_null(spark):
    got = w.whiten(frame(spark, [(1, [1e13, 0.0]), (2, [0.0, 1.0])]), "vec_id").collect()
    assert [r.deviation for r in got] == [None, None]
