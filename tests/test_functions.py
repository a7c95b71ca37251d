import numpy as np
import pytest
from pyspark.sql import functions as F

from rastertab.functions.grid import core, gather, row_major_rank, with_halo
from rastertab.functions.quantiles import axis_sql, exact_quantiles
from rastertab.functions.ranking import prefix_extreme, spread_rank, value_rank

SIDES = {"n_ul": (-1, -1), "n_u": (-1, 0), "n_ur": (-1, 1), "n_l": (0, -1), "n_r": (0, 1), "n_dl": (1, -1), "n_d": (1, 0), "n_dr": (1, 1)}


def test_quantiles_match_numpy_on_awkward_values(spark):
    rng = np.random.default_rng(3)
    groups = {
        0: rng.normal(size=301) * 10.0 ** rng.integers(-6, 6, 301),
        1: np.zeros(50),
        2: np.array([1.0]),
        3: np.concatenate([np.full(200, 7.25), [-1e12, 1e-305, -1e-305, 0.0]]),
        4: np.round(rng.exponential(50, 997), 2),
    }
    df = spark.createDataFrame([(g, float(v)) for g, vs in groups.items() for v in vs], "g int, v double")
    got = {
        r["g"]: r for r in exact_quantiles(
            df, ["g"], "v", {"a": 0.0, "b": 0.1, "c": 0.5, "d": 0.72, "e": 1.0, "u": "upper"}, count_name="n"
        ).collect()
    }
    for g, vs in groups.items():
        want = np.percentile(vs, [0, 10, 50, 72, 100])
        assert [got[g][c] for c in "abcde"] == pytest.approx(list(want), rel=1e-12, abs=1e-300)
        assert got[g]["u"] == np.sort(vs)[len(vs) // 2]
        assert got[g]["n"] == len(vs)


def test_bucket_axis_is_monotone(spark):
    rng = np.random.default_rng(5)
    v = rng.normal(size=4000) * 10.0 ** rng.integers(-300, 300, 4000)
    edges = np.array([s * 2.0**e for s in (1, -1) for e in range(-40, 40)])
    edges = np.concatenate([edges, np.nextafter(edges, 0), np.nextafter(edges, np.inf)])
    df = spark.createDataFrame([(float(x),) for x in np.concatenate([v, edges])], "v double")
    xs = np.array([r[0] for r in df.orderBy("v").select(F.expr(axis_sql("v"))).collect()])
    assert (np.diff(xs) >= 0).all()


@pytest.mark.parametrize("diagonals", [True, False])
def test_gather_on_sparse_tiles_with_small_blocks(spark, diagonals):
    rng = np.random.default_rng(11)
    present = {(t, int(r), int(c)): int(rng.integers(100)) for t in (1, 2) for r in range(13) for c in range(11) if rng.random() < 0.6}
    df = spark.createDataFrame([(*k, v) for k, v in present.items()], "tile_id bigint, row int, col int, v int")
    rows = core(gather(with_halo(df, 1, 4), ["v"], diagonals), 4).collect()
    assert len(rows) == len(present)
    for r in rows:
        for name, (dr, dc) in SIDES.items():
            if name in r:
                want = present.get((r["tile_id"], r["row"] + dr, r["col"] + dc))
                assert (r[name]["v"] if r[name] is not None else None) == want


def test_ranks_agree_with_plain_sorting(spark):
    rng = np.random.default_rng(2)
    rows = [(int(rng.integers(3)), int(rng.integers(40)), int(i), float(rng.integers(20))) for i in range(400)]
    df = spark.createDataFrame(rows, "tile_id bigint, row int, col int, v double")
    ranked = row_major_rank(df, "rank").collect()
    for t in range(3):
        mine = sorted((r for r in ranked if r["tile_id"] == t), key=lambda r: (r["row"], r["col"]))
        assert [r["rank"] for r in mine] == list(range(1, len(mine) + 1))
    byvalue = value_rank(df, ["tile_id"], "v", "col", "rank", "n").collect()
    for t in range(3):
        mine = sorted((r for r in byvalue if r["tile_id"] == t), key=lambda r: r["rank"])
        assert [r["rank"] for r in mine] == list(range(1, len(mine) + 1))
        assert [r["v"] for r in mine] == sorted(r["v"] for r in mine)
        assert {r["n"] for r in mine} == {len(mine)}
    spread = spread_rank(df, ["tile_id"], F.col("v") / 20, ["col"], "rank", buckets=4).collect()
    for t in range(3):
        mine = sorted((r for r in spread if r["tile_id"] == t), key=lambda r: (r["v"], r["col"]))
        assert [r["rank"] for r in mine] == list(range(1, len(mine) + 1))


def test_prefix_extreme_over_chunks(spark):
    rng = np.random.default_rng(4)
    values = rng.normal(size=100)
    df = spark.createDataFrame([(1, i, float(v)) for i, v in enumerate(values)], "k int, o int, v double")
    got = prefix_extreme(df, ["k"], "o", F.col("v"), "m", largest=False, inclusive=False, chunk=7).orderBy("o").collect()
    assert got[0]["m"] is None
    assert [r["m"] for r in got[1:]] == list(np.minimum.accumulate(values)[:-1])


def test_quantiles_stay_between_their_neighbours_and_agree_with_their_sql(spark):
    """Between two equal values lies that value, however a blend of them rounds; and the SQL twin rounds alike."""
    import duckdb

    from rastertab.plans.registry import quantile_sql

    flat = [0.45, 0.9, 1.8, 0.93, 1.86, 1.95]  # blends of each of these with itself miss it by rounding
    rows = [(g, v) for g, v in enumerate(flat) for _ in range(1024)]
    rows += [(100 + g, round(0.01 * ((g * 104729 + i * 7919) % 5003), 2)) for g in range(20) for i in range(1024)]
    df = spark.createDataFrame(rows, "g int, v double")
    got = {r["g"]: (r["a"], r["b"]) for r in exact_quantiles(df, ["g"], "v", {"a": 0.72, "b": 0.98}).collect()}
    assert [got[g] for g in range(len(flat))] == [(v, v) for v in flat]
    con = duckdb.connect()
    con.register("t", df.toPandas())
    sql = f"SELECT g, {quantile_sql('v', 0.72)}, {quantile_sql('v', 0.98)} FROM t GROUP BY g"
    assert {g: (a, b) for g, a, b in con.execute(sql).fetchall()} == got


def test_small_blocks_come_whole_and_many_in_a_call(spark):
    """One call a block made tiny blocks cost as much as large ones; a block beyond a batch still comes whole."""
    from rastertab.functions.grid import block_numbers, over_blocks

    rows = [(t, r, c) for t in range(300) for r in range(4) for c in range(4)] + [(900, r, c) for r in range(40) for c in range(40)]
    df = spark.createDataFrame(rows, "tile_id bigint, row int, col int")

    def step(pdf):
        which = block_numbers(pdf)
        sizes = pdf.assign(which=which, calls=0).groupby("which", as_index=False).agg(tile_id=("tile_id", "first"), n=("row", "size"), calls=("calls", "sum"))
        sizes.loc[0, "calls"] = 1
        return sizes[["tile_id", "n", "calls"]]

    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "500")
    try:
        small = over_blocks(df, ("row", "col"), 2, step, "tile_id bigint, n bigint, calls bigint").collect()
        large = over_blocks(df, ("row", "col"), 64, step, "tile_id bigint, n bigint, calls bigint").collect()
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert len(small) == 300 * 4 + 400 and all(r["n"] == 4 for r in small)
    assert sum(r["calls"] for r in small) < 60
    assert sorted((r["tile_id"], r["n"]) for r in large) == [(t, 16) for t in range(300)] + [(900, 1600)]
