import numpy as np
import pytest

from rastertab.operators import containment


def star(rng, n, cx, cz, low, high):
    turn = np.sort(rng.random(n)) * 2 * np.pi
    reach = low + (high - low) * rng.random(n)
    return np.stack([cx + reach * np.cos(turn), cz + reach * np.sin(turn)], axis=1)


def edges_of(tile, region, ring):
    return [(tile, region, *map(float, a), *map(float, b)) for a, b in zip(ring, np.roll(ring, -1, axis=0))]


def even_odd(points, edges):
    out = set()
    for tile, name, x, z in points:
        for region in {e[1] for e in edges if e[0] == tile}:
            hits = sum((z1 > z) != (z2 > z) and x < (x1 - x2) * (z - z2) / (z1 - z2) + x2 for t, r, x1, z1, x2, z2 in edges if (t, r) == (tile, region))
            if hits % 2:
                out.add((tile, name, region))
    return out


def scene(seed, crowd):
    rng = np.random.default_rng(seed)
    edges = edges_of(1, 0, star(rng, crowd, 0.0, 0.0, 0.2, 0.45)) + edges_of(1, 0, star(rng, 40, 0.0, 0.0, 0.02, 0.1))  # with a hole
    edges += edges_of(1, 1, star(rng, 9, 0.1, 0.1, 0.1, 0.4)) + edges_of(2, 0, star(rng, 5, 0.3, -0.3, 0.01, 0.3))
    edges += edges_of(1, 2, star(rng, 150, 0.2, -0.2, 0.0005, 0.001))  # very small and very rich
    edges += edges_of(3, 7, np.array([(-2.0, -2.0), (2.0, -2.0), (2.0, 2.0), (-2.0, 2.0)]))  # beyond the unit square
    points = [(int(t), k, *map(float, rng.uniform(-0.6, 0.6, 2))) for k, t in enumerate(rng.integers(1, 4, 250))]
    points += [(1, 1000 + k, *map(float, rng.uniform((0.1985, -0.2015), (0.2015, -0.1985)))) for k in range(60)]
    return points, edges


@pytest.mark.parametrize("seed,crowd,crowded", [(1, 60, 64), (2, 700, 8)])
def test_adaptive_grid_equals_the_even_odd_rule(spark, seed, crowd, crowded):
    points, edges = scene(seed, crowd)
    p = spark.createDataFrame(points, "tile_id long, point_id long, x double, z double")
    e = spark.createDataFrame(edges, "tile_id long, region long, x1 double, z1 double, x2 double, z2 double")
    got = {(r.tile_id, r.point_id, r.region) for r in containment.points_in_polygons(p, e, crowded=crowded).collect()}
    assert got == even_odd(points, edges)


def test_odd_input(spark):
    p = spark.createDataFrame([(1, 1, 0.0, 0.0), (1, 2, None, 0.0), (1, 3, float("nan"), 0.0), (1, 1, 0.0, 0.0)], "tile_id long, point_id long, x double, z double")
    ring = edges_of(1, 5, np.array([(-0.1, -0.1), (0.1, -0.1), (0.1, 0.1), (-0.1, 0.1)]))
    e = spark.createDataFrame([*ring, (1, 6, None, 0.0, 0.1, 0.1)], "tile_id long, region long, x1 double, z1 double, x2 double, z2 double")
    assert {(r.point_id, r.region) for r in containment.points_in_polygons(p, e).collect()} == {(1, 5)}
    assert containment.points_in_polygons(p.limit(0), e.limit(0)).count() == 0
