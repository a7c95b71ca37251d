import heapq

import numpy as np
import pytest
from pyspark.sql import functions as F

from rastertab.operators import road_overlay
from rastertab.operators import routes as rt
from tests.grids import cells

REQ = "route_id bigint, tile_id bigint, start_row int, start_col int, dest_row int, dest_col int, profile string, avoid_water boolean"
BLOCKED = "route_id bigint, row int, col int"


def ladder(size=9, rungs=(0, 4, 8), rails=(1, 7)):
    """Two road rails joined by rungs."""
    m = np.zeros((size, size), dtype=int)
    for rail in rails:
        m[:, rail] = 5
    for rung in rungs:
        m[rung, rails[0] : rails[1] + 1] = 5
    return m


def unit_length(m, start, dest, blocked=()):
    cost = {(r, c): 1.0 for r, c in zip(*np.nonzero(m == 5)) if (r, c) not in blocked}
    return dijkstra(cost, start, dest)[0]


def test_shortest_paths_and_debris(spark):
    broken = ladder()
    broken[3, 1] = broken[5, 7] = 0
    torn = ladder(rungs=(0,))
    torn[0, 4] = 0  # two rails and nothing between them
    tiles = {1: ladder(), 2: ladder(), 3: broken, 4: torn}
    c = cells(spark, tiles)
    ends = {1: ((2, 1), (6, 7)), 2: ((2, 1), (6, 7)), 3: ((2, 1), (7, 7)), 4: ((1, 1), (1, 7))}
    hit = {2: [(4, 3)], 3: [(0, 5)]}
    req = spark.createDataFrame([(t, t, *s, *d, "fastest", True) for t, (s, d) in ends.items()], REQ)
    blocked = spark.createDataFrame([(t, r, c) for t, cut in hit.items() for r, c in cut], BLOCKED)
    want = {t: unit_length(tiles[t], s, d, hit.get(t, ())) for t, (s, d) in ends.items()}
    assert (want[1], want[2], want[3], want[4]) == (10, 14, None, None)
    for block in (2, 64):
        got = {r["route_id"]: (r["distance_cells"], r["status"]) for r in rt.shortest_distance(req, rt.road_hazards(c), blocked, block).collect()}
        assert got == {t: (n, "unreachable" if n is None else "reached") for t, n in want.items()}
    counts = {r["route_id"]: r for r in rt.hazard_counts(req, c, blocked).collect()}
    assert (counts[2]["debris_cells"], counts[2]["blocked_road_cells"], counts[2]["water_cells"]) == (1, 1, 0)


def test_problems(spark):
    wet = np.full((6, 6), 5)
    wet[3, 1] = 4
    c = cells(spark, {1: ladder(), 2: wet}, height={1: np.zeros((9, 9)), 2: np.zeros((6, 6))})
    rows = [
        (1, 1, 1, 3, 8, 7, "fastest", True), (2, 1, 2, 1, 8, 7, "scenic", True), (3, 1, 2, 1, 9, 7, "fastest", True),
        (4, 2, 2, 2, 3, 5, "fastest", True), (5, 2, 2, 2, 3, 5, "fastest", False), (6, 1, 2, 1, 8, 7, "fastest", True),
    ]
    got = {r["route_id"]: r["problem"] for r in rt.route_problems(spark.createDataFrame(rows, REQ), c, spark.createDataFrame([(6, 8, 7)], BLOCKED)).collect()}
    assert got == {
        1: "start_not_road", 2: "unknown_profile", 3: "destination_outside", 4: "start_beside_water", 6: "endpoint_in_debris",
    }


def two_ways():
    """A short road over steep steps and a flat one that is four cells longer."""
    m = ladder(12, rungs=(2, 4), rails=(0, 11))
    m[:2, [0, 11]] = m[5:, [0, 11]] = 0
    h = np.zeros((12, 12))
    h[2, 1:11:2] = 25.0
    return m, h


def test_profiles_differ_on_steep_steps(spark):
    m, h = two_ways()
    c = cells(spark, {1: m}, height={1: h})
    req = spark.createDataFrame([(1, 1, 2, 0, 2, 11, "fastest", True), (2, 1, 2, 0, 2, 11, "safest", True)], REQ)
    out, paths = rt.ranked_routes(req, c, spark.createDataFrame([], BLOCKED), block=3)
    rows = out.orderBy("route_id", "place").collect()
    fast, safe = ([r for r in rows if r["route_id"] == i] for i in (1, 2))
    scores = [r["profile_score"] for r in fast]
    assert len(fast) >= 2 and scores == sorted(scores)
    assert (fast[0]["distance_cells"], safe[0]["distance_cells"]) == (11, 15)
    assert safe[0]["risk_score"] < fast[0]["risk_score"]
    assert [(p["row"], p["column"]) for p in fast[0]["path"]] == [(2, k) for k in range(12)]


def dijkstra(cost, start, dest):
    """Distances by a priority queue, path by smallest (row, col) predecessor."""
    dist, queue = {start: 0.0}, [(0.0, start)]
    near = lambda p: [q for q in ((p[0] - 1, p[1]), (p[0], p[1] - 1), (p[0], p[1] + 1), (p[0] + 1, p[1])) if q in cost]
    while queue:
        d, p = heapq.heappop(queue)
        if d > dist[p]:
            continue
        for q in near(p):
            if d + cost[q] < dist.get(q, np.inf):
                dist[q] = d + cost[q]
                heapq.heappush(queue, (dist[q], q))
    if dest not in dist:
        return None, None
    path = [dest]
    while path[-1] != start:
        p = path[-1]
        path.append(min(q for q in near(p) if q in dist and dist[q] + cost[p] <= dist[p] + 1e-9))
    return dist[dest], path[::-1]


@pytest.mark.parametrize("block,region", [(4, 1), (3, 2), (64, 8)])
def test_weighted_search_matches_dijkstra(spark, monkeypatch, block, region):
    monkeypatch.setattr(road_overlay, "REGION", region)  # small regions, so that searches take rounds
    rng = np.random.default_rng(6)
    tiles = {t: np.where(rng.random((15, 15)) < 0.75, 5, 1) for t in range(4)}
    for m in tiles.values():
        m[0, 0] = m[14, 14] = 5
    heights = {t: rng.exponential(20, (15, 15)) for t in tiles}
    c = cells(spark, tiles, height=heights)
    req = spark.createDataFrame([(10 + t, t, 0, 0, 14, 14, "safest", False) for t in tiles], REQ)
    roads = rt.cell_risk(c)
    costs, path = rt.cheapest_path(req, roads, block=block)
    got = {r["route_id"]: r["cost"] for r in costs.collect()}
    walked = {}
    for r in path.orderBy("route_id", "seq").collect():
        walked.setdefault(r["route_id"], []).append((r["row"], r["col"]))
    per_tile = {}
    for r in roads.collect():
        per_tile.setdefault(r["tile_id"], {})[r["row"], r["col"]] = 1.0 + r["risk_dry"] / 100.0 + r["accessibility"] * 0.2 / 100.0
    for t in tiles:
        d, p = dijkstra(per_tile[t], (0, 0), (14, 14))
        if d is None:
            assert 10 + t not in got
        else:
            assert got[10 + t] == pytest.approx(d)
            assert walked[10 + t] == p


def test_small_blocks_share_a_call(spark):
    cells = spark.range(600).selectExpr(
        "id div 3 AS route_id", "0 AS bi", "int(id div 300) AS bj", "0 AS row", "int(id % 3) AS col", "1.0 + id div 3 AS cost"
    )
    ends = cells.where("col <> 1").selectExpr("route_id", "bi", "bj", "row", "col", "0.0 AS value", "0 AS kind")

    def counted(rows):
        out = road_overlay._fill_tables(road_overlay.AT)(rows)
        return out.assign(calls=[1] + [0] * (len(out) - 1))

    shape = "route_id bigint, bi int, bj int, cell array<bigint>, cost array<double>, dist array<double>, calls bigint"
    got = road_overlay._in_batches(cells, ends, road_overlay.AT, counted, shape).collect()
    assert {r.route_id: (r.bj, r.cell, r.dist) for r in got} == {
        i: (int(3 * i >= 300), [0, 2], [0.0, 2.0 * (1 + i), 2.0 * (1 + i), 0.0]) for i in range(200)
    }
    assert sum(r.calls for r in got) <= 2 * int(spark.conf.get("spark.sql.shuffle.partitions"))  # a batch, and its last group


def test_debris_zone_is_clipped_and_scene_mapping_rounds(spark):
    zones = spark.createDataFrame([(1, 0, 0), (1, 0, 1)], BLOCKED)
    sizes = spark.createDataFrame([(1, 5, 5)], "route_id bigint, rows int, cols int")
    assert {(r["row"], r["col"]) for r in rt.debris_cells(zones, sizes).collect()} == {(r, c) for r in (0, 1) for c in (0, 1, 2)}
    path = spark.createDataFrame([(1, 0, 0, 6), (1, 1, 3, 3)], "route_id bigint, seq int, row int, col int")
    scene = spark.createDataFrame([(1, 7, 256)], "route_id bigint, route_size int, scene_size int")
    got = {r["seq"]: (r["row"], r["col"]) for r in rt.route_to_scene(path, scene).collect()}
    assert got == {0: (0, 255), 1: (128, 128)}


def test_uncertainty_and_buildings_raise_risk(spark):
    m = np.full((5, 5), 5)
    m[1, 0] = 3
    u = np.zeros((5, 5))
    u[2, 2] = 1.0
    c = cells(spark, {1: m}, height={1: np.zeros((5, 5))}, uncertainty={1: u})
    req = spark.createDataFrame([(1, 1, 2, 0, 2, 4, "safest", True)], REQ)
    out, _ = rt.ranked_routes(req, c, spark.createDataFrame([], BLOCKED))
    best = out.where(F.col("selected")).first()
    assert best["risk_score"] > 0 and "prediction uncertainty" in best["avoided_hazards"]
