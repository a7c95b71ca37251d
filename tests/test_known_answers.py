import json

import numpy as np
import pytest
from pyspark.sql import functions as F

from rastertab.operators import audit, calibrate, catalog, metrics, reports, tiles
from rastertab.sources import io
from tests.grids import cells, grid

HISTOGRAM = "class int, n bigint"


def test_audit_building_fraction_and_non_finite(spark):
    labels = np.full((4, 5), 1)
    labels[0, :] = 3
    labels[1, :4] = [2, 5, 6, 6]
    h = np.arange(20, dtype=float).reshape(4, 5)
    h[0, 0] = np.nan
    c = cells(spark, {1: labels}, height={1: h}).withColumn("split", F.lit("train"))
    r = audit.audit_samples(c).first()
    assert r["building_pixel_fraction"] == pytest.approx(4 / 19)
    assert r["invalid_pixels"]["height_nonfinite"] == 1
    assert sorted(r["class_ids"]) == ["1", "2", "3", "5", "6"]
    splits = audit.audit_splits(c, audit.audit_samples(c)).first()
    assert (splits["sample_count"], splits["valid_pixel_count"], splits["invalid_pixel_count"]) == (1, 19, 1)


def test_illegal_class_is_reported(spark):
    labels = np.ones((3, 3), dtype=int)
    labels[1, 1], labels[0, 0] = 99, 255
    bad = audit.invalid_class_ids(cells(spark, {4: labels})).collect()
    assert [(r["tile_id"], r["class"], r["pixels"]) for r in bad] == [(4, 99, 1)]


def test_balanced_weights_are_scale_free(spark):
    counts = [10, 1000, 400, 500, 30, 300, 0]
    hist = spark.createDataFrame(list(enumerate(counts)), HISTOGRAM)
    got = np.array([r["weight"] for r in audit.class_weights(hist).orderBy("class").collect()])
    n = np.maximum(np.array(counts, dtype=float), 1)
    raw = np.sqrt(sum(counts) / (7 * n))
    assert got == pytest.approx(np.clip(raw / raw.mean(), 0.5, 3.0))


def test_pairing_suffixes_and_orphans(spark):
    paths = [("train", "images", "images/train/DC_01_RGB.h5"), ("train", "heights", "heights/train/dc_01_AGL.h5"),
             ("train", "classes", "classes/train/DC_01_CLASS_CLS.h5"), ("train", "heights", "heights/train/unmatched_AGL.h5")]
    files = spark.createDataFrame(paths, "split string, kind string, path string")
    assert [r["key"] for r in catalog.pair_triplets(files).collect()] == ["DC_01"]
    assert [(r["kind"], r["key"]) for r in catalog.orphan_targets(files).collect()] == [("heights", "UNMATCHED")]


def test_group_split_holds_out_the_last_group(spark):
    s = spark.createDataFrame([("a", "city-a"), ("b", "city-b")], "key string, group string")
    assert {r["group"]: r["role"] for r in catalog.split_by_group(s).collect()} == {"city-a": "train", "city-b": "validation"}
    assert catalog.split_problems(s).count() == 0
    one = s.where("group = 'city-a'")
    assert {r["problem"] for r in catalog.split_problems(one).collect()} == {"fewer_than_two_groups", "empty_train"}


def test_palette_lookup(spark):
    rows = [(1, 0, 0, b, v) for b, v in enumerate((10, 20, 30))] + [(1, 0, 1, b, v) for b, v in enumerate((40, 50, 60))]
    bands = spark.createDataFrame(rows, "tile_id bigint, row int, col int, band int, value int")
    palette = spark.createDataFrame([(10, 20, 30, 0), (40, 50, 60, 2)], "r int, g int, b int, class int")
    assert list(grid(audit.decode_palette(bands, palette), "class", (1, 2)).ravel()) == [0, 2]
    assert audit.palette_problems(bands).first()["colours"] == 2


def test_perfect_prediction_and_constant_arrays(spark):
    c = cells(spark, {1: np.full((4, 4), 3)}, height={1: np.ones((4, 4))})
    p = c.withColumn("pred_height", F.col("height")).withColumn("pred_class", F.col("class"))
    r = metrics.tile_metrics(p, []).first()
    assert (r["rmse"], r["mae"], r["semantic_miou"], r["building_f1"], r["boundary_f1"]) == (0, 0, 1, 1, 1)
    assert r["correlation"] is None


def test_calibration_known_answers(spark):
    labels = np.ones((8, 8), dtype=int)
    labels[2:6, 2:6] = 3
    h = np.where(labels == 3, 4.0, 0.0)
    valid = np.ones((8, 8), dtype=bool)
    masked = valid.copy()
    masked[3:5, :] = False
    flat, ones = np.zeros((8, 8)), np.ones((8, 8), dtype=int)
    c = cells(
        spark, {1: labels, 2: ones, 3: ones, 4: labels, 5: ones},
        height={1: h, 2: flat, 3: flat + 1, 4: flat, 5: flat}, valid={1: valid, 2: valid, 3: masked, 4: valid, 5: valid},
    )
    points = lambda *p: json.dumps([{"pixelX": x, "pixelY": y, "elevation": e} for x, y, e in p])
    scenes = spark.createDataFrame(
        [
            (1, True, "EPSG:1", 120.5, None, None), (2, True, "EPSG:1", None, points((0, 0, 100), (7, 0, 107), (0, 7, 114)), None),
            (3, True, "EPSG:1", 100.0, None, "map"), (4, True, "EPSG:1", None, points((0, 0, 100), (7, 0, 107), (3, 3, 106)), None),
            (5, True, "EPSG:1", None, points((0, 0, 1), (1, 1, 2), (2, 2, 3)), None),
        ],
        "tile_id bigint, calibrate boolean, crs string, ground_elevation double, gcps_json string, provenance string",
    )
    status = calibrate.calibration_status(scenes, c)
    got = {r["tile_id"]: r for r in status.collect()}
    assert {t: r["status"] for t, r in got.items()} == {
        1: "calibrated", 2: "calibrated", 3: "calibrated", 4: "invalid_ground_control_points", 5: "invalid_ground_control_points",
    }
    assert got[1]["residual"] == pytest.approx(0) and got[2]["residual"] == pytest.approx(0, abs=1e-9)
    assert got[3]["ground_pixel_count"] == 48 and got[3]["accuracy_status"] == "provenance_provided_unverified"
    dsm = calibrate.apply_dsm(c, status)
    one, two, three = (grid(dsm.where(F.col("tile_id") == t), "dsm", (8, 8)) for t in (1, 2, 3))
    assert (one[0, 0], one[3, 3]) == (120.5, 124.5)
    assert two[7, 7] == pytest.approx(121.0)
    assert all(v is None for v in three[3:5].ravel()) and three[0, 0] is not None


def test_control_point_texts(spark):
    texts = [(1, '[{"pixelX": 0, "pixelY": 1, "elevation": 100}]'), (2, "[{"), (3, '{"x": 1}'), (4, "[3]"), (5, '[{"x": 1, "y": 2}]'), (6, None)]
    scenes = spark.createDataFrame(texts, "tile_id bigint, gcps_json string")
    got = {r["tile_id"]: (r["x"], r["y"], r["elevation"], r["problem"]) for r in calibrate.explode_gcps(scenes).collect()}
    assert got[1] == (0.0, 1.0, 100.0, None)
    assert {t: got[t][3] for t in (2, 3, 4, 5)} == {2: "bad_json", 3: "not_a_list", 4: "not_an_object", 5: "missing_field"}
    assert 6 not in got


def test_pins_clamp_and_round(spark):
    p = spark.createDataFrame([(-4.0, 99.0, 8), (2.6, 3.4, 8)], "r double, c double, n int")
    row, col = calibrate.clamp_pin(F.col("r"), F.col("c"), F.col("n"))
    assert [tuple(r) for r in p.select(row, col).collect()] == [(0, 7), (3, 3)]


def test_pack_and_explode_are_inverse_in_chunks(spark):
    h = np.round(np.random.default_rng(0).random((9, 9)), 3)
    c = cells(spark, {1: np.ones((9, 9))}, value={1: h})
    chunks = io.pack_grid(c, band_rows=4).orderBy("first_row").collect()
    assert [(r["first_row"], len(r["values"])) for r in chunks] == [(0, 36), (4, 36), (8, 9)]
    flat = [v for r in chunks for v in r["values"]]
    assert flat == pytest.approx(list(h.ravel()))
    packed = io.pack_grid(c)
    assert packed.count() == 1
    back = grid(io.explode_grid(packed, 9), "value", (9, 9)).astype(float)
    assert back == pytest.approx(h)
    with pytest.raises(Exception, match="gridSize"):
        io.explode_grid(packed, 8).collect()


def test_training_log_lines(spark):
    lines = [
        ("12.5s 7 Epoch 03/40 | Train Loss: 0.9125 | Val RMSE: 2.250m | MAE: 1.125m | Pearson R: 0.955 | LR: 3.25e-04",),
        ("12.6s 8 -> Best model saved",),
    ]
    (r,) = io.parse_training_log(spark.createDataFrame(lines, "value string")).collect()
    assert (r["epoch"], r["epochs"], r["train_loss"], r["rmse"], r["mae"], r["correlation"], r["lr"], r["elapsed_sec"]) == (
        3, 40, 0.9125, 2.25, 1.125, 0.955, 3.25e-04, 12.5,
    )


def test_scan_prunes_by_tile(spark, tmp_path):
    c = cells(spark, {t: np.ones((3, 3)) for t in range(4)}, height={t: np.ones((3, 3)) for t in range(4)}, boundary={t: np.ones((3, 3)) for t in range(4)})
    io.write_cells(c.select("tile_id", "row", "col", "height", "class", "boundary"), str(tmp_path / "cells"), 2)
    picked = io.scan_cells(spark, str(tmp_path / "cells"), [1, 3]).select("tile_id", "height")
    assert picked.count() == 18
    plan = picked._jdf.queryExecution().executedPlan().toString()
    assert "PushedFilters: [In(tile_id" in plan and "boundary" not in plan.split("ReadSchema")[1]


def test_bootstrap_covers_the_mean_and_repeats(spark):
    v = np.random.default_rng(8).normal(5, 1, 200)
    t = spark.createDataFrame([(i, float(x)) for i, x in enumerate(v)], "tile_id bigint, rmse double")
    a, b = (reports.bootstrap_ci(t, ["rmse"], iterations=200).first() for _ in range(2))
    assert a == b and a["low"] < v.mean() < a["high"]
    assert a["high"] - a["low"] == pytest.approx(2 * 1.96 / np.sqrt(200), rel=0.3)


def test_seeded_samples_are_stable_and_spread(spark):
    c = cells(spark, {1: np.ones((40, 40))}, height={1: np.ones((40, 40))})
    pick = lambda s: {(r["row"], r["col"]) for r in tiles.sample_pixels(c.repartition(s), 200).collect()}
    one, two = pick(3), pick(7)
    assert one == two and len(one) == 200
    assert 14 < np.mean([r for r, _ in one]) < 25  # not the first lines


def test_photometric_is_deterministic_and_bounded(spark):
    rows = [(t, r, c, b, float(20 * r + 5 * c + b)) for t in range(6) for r in range(8) for c in range(8) for b in range(3)]
    bands = spark.createDataFrame(rows, "tile_id bigint, row int, col int, band int, value double")
    key = ["tile_id", "row", "col", "band"]
    one, two = (tiles.photometric(b, 3).orderBy(*key).collect() for b in (bands, bands.repartition(5)))
    assert [r["value"] for r in one] == [r["value"] for r in two]
    assert all(0 <= r["value"] <= 255 for r in one)


def test_last_fifth_of_many_groups_is_held_out(spark):
    names = [f"g{i:04d}" for i in range(503)] + [None]
    samples = spark.createDataFrame([(g, k) for g in names for k in range(2)], "`group` string, key int")
    roles = catalog.split_by_group(samples).groupBy("group", "role").count().collect()
    assert all(r["count"] == 2 for r in roles) and len(roles) == len(names)
    assert sorted(r.group for r in roles if r.role == "validation") == names[403:503]
    assert catalog.split_by_group(samples.limit(0)).count() == 0


def test_rolled_up_counts(spark):
    rows = [("a", 1, 0, 0, 1.0, 3), ("a", 1, 0, 1, None, 3), ("a", 2, 0, 0, 2.0, 255), (None, 3, 0, 0, 2.0, 3)]
    cells = spark.createDataFrame(rows, "split string, tile_id bigint, row int, col int, height double, class int")
    got = sorted(map(tuple, audit.building_fraction(cells).collect()), key=str)
    want = [
        ("a", 1, 1, 1, 1.0), ("a", 2, 0, 0, 0.0), ("a", None, 1, 1, 1.0), (None, 3, 1, 1, 1.0), (None, None, 1, 1, 1.0),
        (None, None, 2, 2, 1.0),
    ]
    assert got == sorted(want, key=str)
    assert audit.building_fraction(cells.limit(0)).count() == 0
