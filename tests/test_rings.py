import numpy as np
import pytest

from rastertab.operators import outlines, regions, rings
from rastertab.operators.components import components
from tests.grids import cells

RIGHT, DOWN, LEFT, UP = (1, 0), (0, 1), (-1, 0), (0, -1)


def labels(mask):
    """Component name (first cell in row-major order) of every cell by flooding."""
    name = {}
    for r, c in zip(*np.nonzero(mask)):
        if (r, c) in name:
            continue
        todo, name[r, c] = [(r, c)], (r, c)
        while todo:
            y, x = todo.pop()
            for q in ((y - 1, x), (y + 1, x), (y, x - 1), (y, x + 1)):
                if 0 <= q[0] < mask.shape[0] and 0 <= q[1] < mask.shape[1] and mask[q] and q not in name:
                    name[q] = (r, c)
                    todo.append(q)
    return name


def slow_rings(mask):
    """{(component, corners from the leftmost-topmost one)}: walks that keep the same empty cell on the left."""
    name, out = labels(mask), set()
    for comp in set(name.values()):
        inside = lambda y, x: name.get((y, x)) == comp  # noqa: B023, E731
        edges = {}
        for (y, x), owner in name.items():
            if owner != comp:
                continue
            for away, start, step in (((y - 1, x), (x, y), RIGHT), ((y, x + 1), (x + 1, y), DOWN), ((y + 1, x), (x + 1, y + 1), LEFT), ((y, x - 1), (x, y + 1), UP)):
                if not inside(*away):
                    edges[start, step] = None
        while edges:
            start = next(iter(edges))
            walk, now = [], start
            while now in edges:
                del edges[now]
                end = (now[0][0] + now[1][0], now[0][1] + now[1][1])
                turn = (now[1][1], -now[1][0])  # to the left, with y downwards
                options = [d for d in (turn, now[1], (-now[1][1], now[1][0])) if (end, d) in edges or (end, d) == start]
                walk.append((end, now[1] != options[0]))
                now = (end, options[0])
            corners = [p for p, turns in walk if turns]
            at = corners.index(min(corners))
            out.add((comp[0] * 2**32 + comp[1], tuple(corners[at:] + corners[:at])))
    return out


def found(spark, mask, block):
    c = cells(spark, {1: np.where(mask, 3, 1)})
    rows = rings.ring_vertices(outlines.outline_edges(components(c.where("class = 3"))), block).collect()
    by = {}
    for r in rows:
        by.setdefault((r.component, r.ring), []).append((r.seq, (r.x, r.y), r.is_hole))
    out = set()
    for (comp, ring), points in by.items():
        points.sort()
        assert [p[0] for p in points] == list(range(len(points)))
        assert ring == points[0][1][0] * 2**32 + points[0][1][1]
        out.add((comp, tuple(p[1] for p in points)))
    holes = {k: {p[2] for p in v} for k, v in by.items()}
    for comp in {k[0] for k in by}:
        assert sum(v == {False} for k, v in holes.items() if k[0] == comp) == 1
    return out


@pytest.mark.parametrize("block", [1, 3, 64])
def test_random_masks(spark, block):
    for seed, share in ((1, 0.5), (2, 0.7)):
        mask = np.random.default_rng(seed).random((13, 11)) < share
        assert found(spark, mask, block) == slow_rings(mask)


def test_outline_that_touches_its_hole(spark):
    mask = np.array([[1, 1, 0], [1, 0, 1], [1, 1, 1]], bool)
    got = found(spark, mask, 64)
    assert got == slow_rings(mask)
    assert {len(p) for _, p in got} == {4, 6}  # the hole is a square, the outline has one inner corner


def test_a_building_in_the_court_of_another(spark):
    mask = np.ones((7, 7), bool)
    mask[1:6, 1:6] = False
    mask[3, 3] = True
    for block in (2, 64):
        assert found(spark, mask, block) == slow_rings(mask)


def test_a_long_spiral_over_many_blocks(spark):
    mask = np.zeros((41, 41), bool)
    for k in range(0, 20, 4):
        mask[k, k : 41 - k] = mask[k : 41 - k, 40 - k] = mask[40 - k, k : 41 - k] = True
        mask[k + 4 : 41 - k, k] = True
        mask[k + 4, k : k + 5] = True
    assert found(spark, mask, 4) == slow_rings(mask)


def test_footprints_are_normalised(spark):
    mask = np.zeros((4, 8), bool)
    mask[1:3, 2:6] = True
    c = cells(spark, {1: np.where(mask, 3, 1)}, height={1: np.where(mask, 9.0, 0.0)})
    rows = sorted(regions.building_footprints(c).collect(), key=lambda r: r.seq)
    assert [(r.x, r.z, r.is_hole) for r in rows] == [(-0.25, -0.25, False), (0.25, -0.25, False), (0.25, 0.25, False), (-0.25, 0.25, False)]
    one = regions.buildings(c).join(regions.building_footprints(c), ["tile_id", "component"])
    assert one.count() == 4
