import numpy as np
import pytest

from rastertab.llm.stars import forest, roots


def slow(edges):
    root = {}

    def find(x):
        while root.setdefault(x, x) != x:
            x = root[x]
        return x

    for a, b in edges:
        x, y = sorted((find(a), find(b)))
        root[y] = x
    return sorted((x, find(x)) for x in root if find(x) != x)


def scenes():
    rng = np.random.default_rng(2)
    yield [(i, i + 1) for i in range(300)]
    yield [(5000, i) for i in range(400)] + [(7, 7), (9001, 9000)]
    yield [tuple(map(int, e)) for e in rng.integers(0, 400, (260, 2))]


@pytest.mark.parametrize("edges", list(scenes()))
def test_roots_equal_a_slow_search(spark, edges):
    got = roots(spark.createDataFrame(edges, "a bigint, b bigint"))
    assert sorted((r.node, r.root) for r in got.collect()) == slow(edges)
    a, b = forest(*np.array(edges).T)
    assert sorted(zip(a.tolist(), b.tolist())) == slow(edges)


def test_no_edges(spark):
    assert roots(spark.createDataFrame([(3, 3)], "a bigint, b bigint")).count() == 0
