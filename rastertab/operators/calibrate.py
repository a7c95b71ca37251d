"""Calibration of relative heights against ground evidence, and georeferencing checks."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rastertab.functions.columns import finite, js_round
from rastertab.functions.grid import attach, tile_shape
from rastertab.functions.quantiles import exact_quantiles
from rastertab.functions.state import settle
from rastertab.operators.stencil import slope_degrees
from rastertab.schema import GROUND

NODATA = -9999.0


def explode_gcps(scenes: DataFrame, text: str = "gcps_json") -> DataFrame:
    """Control points of each scene's JSON list: (tile_id, seq, x, y, elevation, problem).

    A text that is no JSON or no list gives one row with ``problem`` and no ``seq``; an empty text gives
    no row. ``pixelX``/``pixelY`` are preferred over ``x``/``y``.
    """
    given = scenes.where(F.coalesce(F.length(F.trim(text)), F.lit(0)) > 0)
    parsed = given.withColumn("_v", F.try_parse_json(text))
    whole = F.when(F.col("_v").isNull(), "bad_json").when(~F.trim(text).startswith("["), "not_a_list")
    items = F.when(whole.isNull(), F.from_json(text, "array<variant>"))
    broken = parsed.where(whole.isNotNull()).select(
        "tile_id", F.lit(None).cast("int").alias("seq"),
        *[F.lit(None).cast("double").alias(n) for n in ("x", "y", "elevation")], whole.alias("problem"),
    )
    points = parsed.select("tile_id", F.posexplode(items).alias("seq", "_p"))

    def number(*names: str) -> Column:
        return F.coalesce(*[F.try_variant_get("_p", f"$.{n}", "double") for n in names])

    typed = points.select(
        "tile_id", "seq", number("pixelX", "x").alias("x"), number("pixelY", "y").alias("y"),
        number("elevation").alias("elevation"), F.schema_of_variant("_p").startswith("OBJECT").alias("_object"),
    )
    absent = F.col("x").isNull() | F.col("y").isNull() | F.col("elevation").isNull()
    problem = (
        F.when(~F.coalesce(F.col("_object"), F.lit(False)), "not_an_object")
        .when(absent, "missing_field")
        .when(~(finite("x") & finite("y") & finite("elevation")), "non_finite")
    )
    return typed.withColumn("problem", problem).drop("_object").unionByName(broken)


def _usable() -> Column:
    return F.coalesce(F.col("valid"), F.lit(False)) & finite("height")


def _with_valid(cells: DataFrame) -> DataFrame:
    return cells if "valid" in cells.columns else cells.withColumn("valid", F.lit(True))


def ground_evidence(cells: DataFrame) -> DataFrame:
    """Valid ground cells per tile and how many are required: max(25, 1% of the tile)."""
    return _with_valid(cells).groupBy("tile_id").agg(
        F.count_if(_usable() & (F.col("class") == GROUND)).alias("ground_pixels"),
        F.greatest(F.lit(25), F.floor(F.count(F.lit(1)) * 0.01)).alias("required"),
        (F.count("class") > 0).alias("has_classes"),
    )


def match_gcps(gcps: DataFrame, cells: DataFrame) -> DataFrame:
    """Control points on their cell (half-to-even rounding): adds row, col, inside, on_valid, on_ground, height."""
    placed = gcps.where(F.col("x").isNotNull()).withColumn("row", F.bround("y").cast("int")).withColumn(
        "col", F.bround("x").cast("int")
    )
    looked_up = _with_valid(cells).select(
        "tile_id", "row", "col", "height", _usable().alias("_ok"), (F.col("class") == GROUND).alias("_g"), F.lit(True).alias("_in")
    )
    joined = placed.join(looked_up, ["tile_id", "row", "col"], "left")
    no = F.lit(False)
    return joined.select(
        *placed.columns, F.coalesce("_in", no).alias("inside"), F.coalesce("_ok", no).alias("on_valid"),
        F.coalesce(F.col("_ok") & F.col("_g"), no).alias("on_ground"), "height",
    )


def fit_ground_plane(gcps: DataFrame) -> DataFrame:
    """Least squares elevation = a x + b y + c per tile; ``usable`` needs three points not on a line.

    Solved in closed form from centred moments, so points combine map-side.
    """
    m = gcps.groupBy("tile_id").agg(
        F.count(F.lit(1)).alias("points"),
        F.var_pop("x").alias("sxx"), F.var_pop("y").alias("syy"), F.covar_pop("x", "y").alias("sxy"),
        F.covar_pop("x", "elevation").alias("sxz"), F.covar_pop("y", "elevation").alias("syz"),
        F.avg("x").alias("mx"), F.avg("y").alias("my"), F.avg("elevation").alias("mz"),
    )
    det = F.col("sxx") * F.col("syy") - F.col("sxy") * F.col("sxy")
    m = m.withColumn("_det", det).withColumn(
        "usable", (F.col("points") >= 3) & (F.col("_det") > 1e-12 * F.greatest(F.col("sxx") * F.col("syy"), F.lit(1e-300)))
    )
    a = F.try_divide(F.col("sxz") * F.col("syy") - F.col("syz") * F.col("sxy"), F.col("_det"))
    b = F.try_divide(F.col("syz") * F.col("sxx") - F.col("sxz") * F.col("sxy"), F.col("_det"))
    return m.withColumn("a", F.when(F.col("usable"), a)).withColumn("b", F.when(F.col("usable"), b)).select(
        "tile_id", "points", "usable", "a", "b", (F.col("mz") - F.col("a") * F.col("mx") - F.col("b") * F.col("my")).alias("c")
    )


def plane_residual(matched: DataFrame, fit: DataFrame) -> DataFrame:
    """RMSE of plane + h - median(h) - elevation over the points, baseline median(h) and scale."""
    baseline = exact_quantiles(matched, ["tile_id"], "height", {"baseline": 0.5})
    rows = attach(matched, fit.join(baseline, "tile_id"), how="inner")
    error = F.col("a") * F.col("x") + F.col("b") * F.col("y") + F.col("c") + F.col("height") - F.col("baseline") - F.col("elevation")
    return rows.groupBy("tile_id").agg(
        F.sqrt(F.avg(error * error)).alias("residual"),
        F.first("baseline").alias("baseline"),
        F.greatest(F.max("elevation") - F.min("elevation"), F.lit(1.0)).alias("scale"),
    )


def flat_ground(cells: DataFrame, elevations: DataFrame) -> DataFrame:
    """Baseline = median ground height, RMSE about it, scale max(|elevation|, 1).

    ``elevations`` is (tile_id, ground_elevation).
    """
    ground = _with_valid(cells).where(_usable() & (F.col("class") == GROUND))
    baseline = exact_quantiles(ground, ["tile_id"], "height", {"baseline": 0.5})
    spread = attach(ground, baseline, how="inner").groupBy("tile_id").agg(
        F.sqrt(F.avg((F.col("height") - F.col("baseline")) ** 2)).alias("residual"), F.first("baseline").alias("baseline")
    )
    return spread.join(elevations, "tile_id").select(
        "tile_id", "residual", "baseline", F.greatest(F.abs("ground_elevation"), F.lit(1.0)).alias("scale")
    )


def calibration_status(scenes: DataFrame, cells: DataFrame) -> DataFrame:
    """One calibration row per scene.

    ``scenes`` has tile_id, calibrate, crs, ground_elevation, gcps_json, provenance. Besides the
    report (status, method, confidence, residual, count, accuracy) the row carries baseline and the
    plane a, b, c that :func:`apply_dsm` needs.
    """
    # control points and everything per tile are small beside the cells; each is written once and read where needed
    gcps = settle(explode_gcps(scenes), "gcps")
    matched = settle(match_gcps(gcps, cells), "matched")
    fit = settle(fit_ground_plane(matched), "plane")
    points = gcps.groupBy("tile_id").agg(
        F.count("seq").alias("n_points"), F.count("problem").alias("n_problems")
    )
    placed = matched.groupBy("tile_id").agg(F.bool_and("on_ground").alias("all_on_ground"))
    plane = plane_residual(matched, fit).select(
        "tile_id", F.col("residual").alias("p_res"), F.col("baseline").alias("p_base"), F.col("scale").alias("p_scale")
    )
    flat = flat_ground(cells, scenes.select("tile_id", "ground_elevation")).select(
        "tile_id", F.col("residual").alias("f_res"), F.col("baseline").alias("f_base"), F.col("scale").alias("f_scale")
    )
    joined = scenes.select("tile_id", "calibrate", "crs", "ground_elevation", "provenance")
    for part in (settle(ground_evidence(cells), "evidence"), points, placed, fit.drop("points"), settle(plane, "residuals"), settle(flat, "flat")):
        joined = joined.join(part, "tile_id", "left")
    n = F.coalesce("n_points", F.lit(0))
    ground = F.coalesce("ground_pixels", F.lit(0))
    status = (
        F.when(~F.coalesce("calibrate", F.lit(False)), "not_applicable")
        .when(F.col("crs").isNull(), "missing_spatial_reference")
        .when(F.coalesce("n_problems", F.lit(0)) > 0, "malformed_ground_control_points")
        .when((n > 0) & (n < 3), "invalid_ground_control_points")
        .when((n > 0) & ~F.coalesce("has_classes", F.lit(False)), "insufficient_ground_evidence")
        .when((n > 0) & ~(F.coalesce("all_on_ground", F.lit(False)) & F.coalesce("usable", F.lit(False))), "invalid_ground_control_points")
        .when(n > 0, "calibrated")
        .when(ground < F.col("required"), "insufficient_ground_evidence")
        .when(finite("ground_elevation"), "calibrated")
        .otherwise("insufficient_ground_evidence")
    )
    joined = joined.withColumn("status", status).withColumn("_gcp", n > 0)
    done = F.col("status") == "calibrated"
    method = F.when(F.col("_gcp") & F.col("status").isin("calibrated", "invalid_ground_control_points"), "ground_control_points").when(
        F.col("_gcp") & (F.col("status") == "insufficient_ground_evidence"), "ground_control_points"
    ).when(done, "ground_pixels_plus_ground_elevation")
    evidence = F.when(done & F.col("_gcp"), F.greatest(ground, n)).when(
        F.col("status").isin("not_applicable", "missing_spatial_reference"), F.lit(0)
    ).otherwise(ground)
    residual = F.when(done, F.when(F.col("_gcp"), F.col("p_res")).otherwise(F.col("f_res")))
    scale = F.when(F.col("_gcp"), F.col("p_scale")).otherwise(F.col("f_scale"))
    confidence = F.exp(-residual / scale) * F.least(F.lit(1.0), evidence / F.greatest(F.col("required") * 4, F.lit(1)))
    text = F.nullif(F.trim(F.col("provenance")), F.lit(""))
    attempted = ~F.col("status").isin("not_applicable", "missing_spatial_reference", "malformed_ground_control_points")
    accuracy = F.when(attempted & F.col("_gcp"), "unverified").when(
        attempted & F.col("ground_elevation").isNotNull(),
        F.when(text.isNotNull(), "provenance_provided_unverified").otherwise("unverified"),
    )
    zero = F.lit(0.0)
    return joined.select(
        "tile_id", "status", method.alias("method"),
        F.coalesce(F.when(done, F.greatest(zero, F.least(F.lit(1.0), confidence))), zero).alias("confidence"),
        residual.alias("residual"), evidence.cast("bigint").alias("ground_pixel_count"), accuracy.alias("accuracy_status"),
        F.when(done, F.when(F.col("_gcp"), F.col("p_base")).otherwise(F.col("f_base"))).alias("baseline"),
        F.when(done, F.when(F.col("_gcp"), F.col("a")).otherwise(zero)).alias("a"),
        F.when(done, F.when(F.col("_gcp"), F.col("b")).otherwise(zero)).alias("b"),
        F.when(done, F.when(F.col("_gcp"), F.col("c")).otherwise(F.col("ground_elevation"))).alias("c"),
    )


def apply_dsm(cells: DataFrame, calibration: DataFrame, nodata: float | None = None) -> DataFrame:
    """Adds ``dsm`` = height - baseline + ground surface where valid, else NULL (or ``nodata``)."""
    keep = calibration.select("tile_id", *[F.col(c).alias(f"_{c}") for c in ("baseline", "a", "b", "c")])
    rows = attach(_with_valid(cells), keep)
    surface = F.col("_a") * F.col("col") + F.col("_b") * F.col("row") + F.col("_c")
    dsm = F.when(_usable(), F.col("height") - F.col("_baseline") + surface)
    if nodata is not None:
        dsm = F.coalesce(dsm, F.lit(nodata))
    return rows.withColumn("dsm", dsm).select(*cells.columns, "dsm")


def affine_fit(pred: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """scale, offset minimising the squared error of scale * pred_height + offset to height."""
    use = finite("pred_height") & finite("height")
    if "valid" in pred.columns:
        use = use & F.col("valid")
    p, t = F.when(use, F.col("pred_height")), F.when(use, F.col("height"))
    return pred.groupBy(*by).agg(F.regr_slope(t, p).alias("scale"), F.regr_intercept(t, p).alias("offset"))


def absolute_from_ground(cells: DataFrame, ground: DataFrame, gcps: DataFrame | None = None) -> DataFrame:
    """height + ground raster, shifted by the mean control-point error of the tile.

    ``ground`` is (tile_id, row, col, ground), ``gcps`` (tile_id, row, col, elevation).
    """
    summed = cells.join(ground.select("tile_id", "row", "col", "ground"), ["tile_id", "row", "col"]).withColumn(
        "dsm", F.col("height") + F.col("ground")
    )
    if gcps is None:
        return summed
    errors = gcps.join(summed.select("tile_id", "row", "col", "dsm"), ["tile_id", "row", "col"]).groupBy("tile_id").agg(
        F.avg(F.col("elevation") - F.col("dsm")).alias("_shift")
    )
    return attach(summed, errors).withColumn("dsm", F.col("dsm") + F.coalesce("_shift", F.lit(0.0))).drop("_shift")


def _affine(i: int) -> Column:
    return F.get(F.col("transform"), F.lit(i))


def cell_coordinates(cells: DataFrame, scenes: DataFrame) -> DataFrame:
    """World x, y of each cell centre by the scene's affine transform (a, b, c, d, e, f, …)."""
    rows = attach(cells, scenes.select("tile_id", "transform"))
    c, r = F.col("col") + 0.5, F.col("row") + 0.5
    return rows.withColumn("x", _affine(0) * c + _affine(1) * r + _affine(2)).withColumn(
        "y", _affine(3) * c + _affine(4) * r + _affine(5)
    ).drop("transform")


def scene_bounds(scenes: DataFrame) -> DataFrame:
    """left, bottom, right, top from transform, width and height."""
    a, b, c, d, e, f = (_affine(i) for i in range(6))
    w, h = F.col("width"), F.col("height")
    xs = [c, c + a * w, c + b * h, c + a * w + b * h]
    ys = [f, f + d * w, f + e * h, f + d * w + e * h]
    return scenes.select(
        "tile_id", F.least(*xs).alias("left"), F.least(*ys).alias("bottom"), F.greatest(*xs).alias("right"), F.greatest(*ys).alias("top")
    )


def resample_ground(coarse: DataFrame, cells: DataFrame, scenes: DataFrame) -> DataFrame:
    """Bilinear sample of a coarser grid of the same reference system at every cell centre.

    ``coarse`` is (tile_id, row, col, value), ``scenes`` has tile_id, transform and coarse_transform
    (both without rotation). Each cell meets its four corners by an equi-join on the coarse index.
    """
    rows = attach(cell_coordinates(cells.select("tile_id", "row", "col"), scenes), scenes.select("tile_id", "coarse_transform"))
    t = [F.get(F.col("coarse_transform"), F.lit(i)) for i in range(6)]
    u, v = (F.col("x") - t[2]) / t[0] - 0.5, (F.col("y") - t[5]) / t[4] - 0.5
    rows = rows.withColumn("_u", u).withColumn("_v", v).withColumn("_c", F.floor("_u")).withColumn("_r", F.floor("_v"))
    corners = F.array(
        *[
            F.struct(
                (F.col("_r") + dr).cast("int").alias("cr"), (F.col("_c") + dc).cast("int").alias("cc"),
                ((1 - F.abs(F.col("_v") - F.col("_r") - dr)) * (1 - F.abs(F.col("_u") - F.col("_c") - dc))).alias("w"),
            )
            for dr in (0, 1) for dc in (0, 1)
        ]
    )
    wanted = rows.select("tile_id", "row", "col", F.inline(F.filter(corners, lambda k: k["w"] > 0)))
    known = coarse.select("tile_id", F.col("row").alias("cr"), F.col("col").alias("cc"), "value")
    met = wanted.join(known, ["tile_id", "cr", "cc"])
    return met.groupBy("tile_id", "row", "col").agg((F.sum(F.col("w") * F.col("value")) / F.sum("w")).alias("ground"))


def check_georeference(scenes: DataFrame) -> DataFrame:
    """Problems of the spatial metadata per scene; an empty list passes.

    Needs crs, transform, width, height, rows, cols, bounds STRUCT<left, bottom, right, top> and
    resolution ARRAY of two.
    """
    box = scene_bounds(scenes).select("tile_id", F.struct("left", "bottom", "right", "top").alias("_box"))
    joined = scenes.join(box, "tile_id")
    a, b, d, e = _affine(0), _affine(1), _affine(3), _affine(4)
    complete = F.col("transform").isNotNull() & (F.size("transform") == 9) & F.forall("transform", finite)
    sides = [F.abs(F.col(f"_box.{s}") - F.col(f"bounds.{s}")) <= 1e-9 for s in ("left", "bottom", "right", "top")]
    same_box = sides[0] & sides[1] & sides[2] & sides[3]
    steps = (F.abs(F.abs(a) - F.get("resolution", F.lit(0))) <= 1e-12) & (F.abs(F.abs(e) - F.get("resolution", F.lit(1))) <= 1e-12)
    no = F.lit(False)
    checks = [
        ("missing_crs", F.col("crs").isNull() | (F.trim("crs") == "")),
        ("invalid_transform", ~F.coalesce(complete, no)),
        ("singular_transform", F.coalesce(complete & (a * e - b * d == 0), no)),
        ("size_mismatch", ~F.coalesce((F.col("width") == F.col("cols")) & (F.col("height") == F.col("rows")), no)),
        ("bounds_mismatch", ~F.coalesce(same_box, no)),
        ("resolution_mismatch", ~F.coalesce(steps, no)),
    ]
    problems = F.filter(F.array(*[F.when(c, F.lit(n)) for n, c in checks]), lambda p: p.isNotNull())
    return joined.select("tile_id", problems.alias("problems"))


def result_labels(calibration: DataFrame) -> DataFrame:
    """result_type, height_reference and the display texts of a calibration row."""
    done = F.col("status") == "calibrated"
    percent = F.concat(F.bround(F.col("confidence") * 100).cast("int").cast("string"), F.lit("%"))
    residual = F.coalesce(F.format_string("%.2f m", F.col("residual")), F.lit("-"))
    return calibration.select(
        "*",
        F.when(done, "metric_dsm").otherwise("estimated_ndsm").alias("result_type"),
        F.when(done, "absolute").otherwise("relative").alias("height_reference"),
        F.when(done, F.concat(F.lit("fit "), percent, F.lit(", residual "), residual))
        .otherwise(F.concat(F.lit("unavailable: "), F.replace("status", F.lit("_"), F.lit(" "))))
        .alias("fit_text"),
    )


def pin_heights(points: DataFrame, cells: DataFrame, exaggeration: float = 1.0) -> DataFrame:
    """Scene points (tile_id, point_id, x, z in world units) to cell, height (default 0) and slope."""
    shape = tile_shape(cells)
    placed = attach(points, shape, how="inner", spread=["point_id"])

    def cell(value: Column, size: Column) -> Column:
        return F.greatest(F.lit(0), F.least(size - 1, js_round(value))).cast("int")

    at = placed.select(
        "tile_id", "point_id",
        cell((F.col("z") / 11.0 + 0.5) * (F.col("rows") - 1), F.col("rows")).alias("row"),
        cell((F.col("x") / 15.0 + 0.5) * (F.col("cols") - 1), F.col("cols")).alias("col"),
    )
    surface = slope_degrees(cells.select("tile_id", "row", "col", "height"), exaggeration)
    return at.join(surface, ["tile_id", "row", "col"], "left").na.fill(0.0, ["height", "slope"])


def clamp_pin(row, col, size) -> tuple[Column, Column]:
    """Round half up and clamp a grid point into 0..size-1."""
    low, high = F.lit(0), F.greatest(size - 1, F.lit(0))
    return tuple(F.greatest(low, F.least(high, js_round(v))) for v in (row, col))

