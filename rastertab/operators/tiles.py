"""Tile algebra: overlapping tiles, blending, resampling, crops and augmentation.

Resampling and tiling are written source-first: every cell emits the targets it contributes to, by
index arithmetic. Nothing is matched by a range join.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rastertab.functions.columns import as_col, finite, unit_hash
from rastertab.functions.grid import attach, stencil, tile_shape
from rastertab.functions.quantiles import exact_quantiles
from rastertab.functions.ranking import spread_rank
from rastertab.operators.metrics import edge_of
from rastertab.schema import BUILDING


def tile_stride(size: int, overlap: float, rounding: str = "round") -> int:
    raw = size * (1 - overlap)
    return max(1, round(raw) if rounding == "round" else int(raw))


def tile_starts(
    extents: DataFrame, size: int = 518, overlap: float = 0.5, rounding: str = "round", length: str = "length"
) -> DataFrame:
    """0, stride, … and the final start for each extent; a single 0 when it fits one tile."""
    last = F.col(length) - size
    regular = F.sequence(F.lit(0), F.greatest(last, F.lit(0)).cast("int"), F.lit(tile_stride(size, overlap, rounding)))
    starts = F.when(last <= 0, F.array(F.lit(0))).otherwise(F.array_union(regular, F.array(last.cast("int"))))
    return extents.withColumn("start", F.explode(starts))


def _covering(position: Column, length: Column, size: int, stride: int) -> Column:
    """Starts of the tiles along one axis that cover ``position``."""
    last = F.greatest(length - size, F.lit(0))
    low = F.greatest(F.lit(0), F.floor((position - size) / stride) + 1)
    high = F.least(F.floor(position / stride), F.floor(last / stride))
    regular = F.when(low <= high, F.transform(F.sequence(low, high), lambda k: (k * stride).cast("int")))
    final = F.when(position >= last, F.array(last.cast("int")))
    empty = F.array().cast("array<int>")
    return F.array_union(F.coalesce(regular, empty), F.coalesce(final, empty))


def assign_tiles(cells: DataFrame, size: int = 518, overlap: float = 0.5, rounding: str = "round") -> DataFrame:
    """Every cell once per covering tile: adds top, left, local_row, local_col."""
    stride = tile_stride(size, overlap, rounding)
    shape = tile_shape(cells).select("tile_id", F.col("rows").alias("_rows"), F.col("cols").alias("_cols"))
    placed = attach(cells, shape, how="inner")
    placed = placed.withColumn("top", F.explode(_covering(F.col("row"), F.col("_rows"), size, stride)))
    placed = placed.withColumn("left", F.explode(_covering(F.col("col"), F.col("_cols"), size, stride)))
    return placed.withColumn("local_row", F.col("row") - F.col("top")).withColumn(
        "local_col", F.col("col") - F.col("left")
    ).drop("_rows", "_cols")


def _mirror_targets(index: str, length: str, size: int) -> Column:
    """Positions below ``size`` whose reflection (edge not repeated) is ``index``."""
    period = F.greatest(2 * (F.col(length) - 1), F.lit(1))

    def every(first: Column) -> Column:
        return F.when(first < size, F.sequence(first, F.lit(size - 1), period)).otherwise(F.array().cast("array<int>"))

    inner = (F.col(index) > 0) & (F.col(index) < F.col(length) - 1)
    return F.when(
        inner, F.array_union(every(F.col(index)), every((period - F.col(index)).cast("int")))
    ).otherwise(every(F.col(index)))


def reflect_pad(cells: DataFrame, size: int, values: Sequence[str] = ("value",), constant: float = 0.0) -> DataFrame:
    """Mirror each tile to size x size without repeating the edge; constant fill if an axis has one cell."""
    shape = tile_shape(cells).select("tile_id", F.col("rows").alias("_rows"), F.col("cols").alias("_cols"))
    placed = attach(cells, shape, how="inner")
    flat = (F.col("_rows") == 1) | (F.col("_cols") == 1)
    mirrored = (
        placed.where(~flat)
        .withColumn("_r", F.explode(_mirror_targets("row", "_rows", size)))
        .withColumn("_c", F.explode(_mirror_targets("col", "_cols", size)))
    )
    out = mirrored.select("tile_id", F.col("_r").alias("row"), F.col("_c").alias("col"), *values)
    kept = placed.where(flat & (F.col("row") < size) & (F.col("col") < size)).select("tile_id", "row", "col", *values)
    line = F.sequence(F.lit(0), F.lit(size - 1))
    filler = (
        shape.where(flat)
        .withColumn("row", F.explode(line))
        .withColumn("col", F.explode(line))
        .where((F.col("row") >= F.col("_rows")) | (F.col("col") >= F.col("_cols")))
        .select("tile_id", "row", "col", *[F.lit(constant).alias(v) for v in values])
    )
    return out.unionByName(kept).unionByName(filler)


def hann(index, size: int) -> Column:
    """Symmetric Hann window."""
    if size == 1:
        return F.lit(1.0)
    return 0.5 - 0.5 * F.cos(as_col(index) * (2.0 * math.pi / (size - 1)))


def hann_weight(row, col, size: int, floor: str = "product") -> Column:
    """Outer Hann product with a floor of 1e-3 on the "product" or on each "line"."""
    low = F.lit(1e-3)
    if floor == "line":
        return F.greatest(hann(row, size), low) * F.greatest(hann(col, size), low)
    return F.greatest(hann(row, size) * hann(col, size), low)


def hann_weights(spark, size: int, floor: str = "product") -> DataFrame:
    """The weight grid itself."""
    lines = spark.range(size).select(F.col("id").cast("int").alias("row"))
    grid = lines.withColumn("col", F.explode(F.sequence(F.lit(0), F.lit(size - 1))))
    return grid.withColumn("weight", hann_weight("row", "col", size, floor))


def mosaic(
    tile_preds: DataFrame, size: int, values: Sequence[str] = ("value",), by: Sequence[str] = (), floor: str = "product"
) -> DataFrame:
    """Hann-weighted blend of overlapping tiles back to scene cells, per extra key such as a channel.

    Input rows carry tile_id, row, col (scene) and local_row, local_col. Sums combine map-side.
    """
    w = hann_weight("local_row", "local_col", size, floor)
    weighted = tile_preds.withColumn("_w", w)
    total = F.greatest(F.sum("_w"), F.lit(1e-6))
    return weighted.groupBy("tile_id", "row", "col", *by).agg(
        *[(F.sum(F.col("_w") * F.col(v)) / total).alias(v) for v in values]
    )


def uniform_mosaic(tile_preds: DataFrame, values: Sequence[str] = ("value",), by: Sequence[str] = ()) -> DataFrame:
    """Unweighted mean of overlapping tiles."""
    return tile_preds.groupBy("tile_id", "row", "col", *by).agg(*[F.avg(v).alias(v) for v in values])


def flip_average(
    pred: DataFrame, flipped: DataFrame, values: Sequence[str] = ("value",), by: Sequence[str] = (), floor_zero: bool = False
) -> DataFrame:
    """Mean of a prediction and the column-mirrored prediction of the mirrored input."""
    shape = tile_shape(flipped).select("tile_id", F.col("cols").alias("_cols"))
    back = attach(flipped, shape, how="inner").select(
        "tile_id", "row", (F.col("_cols") - 1 - F.col("col")).cast("int").alias("col"), *by,
        *[F.col(v).alias(f"_f_{v}") for v in values],
    )
    joined = pred.join(back, ["tile_id", "row", "col", *by])
    out = {v: (F.col(v) + F.col(f"_f_{v}")) * 0.5 for v in values}
    if floor_zero:
        out = {v: F.greatest(c, F.lit(0.0)) for v, c in out.items()}
    return joined.withColumns(out).select(*pred.columns)


def _ceil_div(a: Column, b: Column) -> Column:
    return F.ceil(a / b)


def _nearest_targets(index: str, source: str, target: int, rule: str) -> Column:
    i, n = F.col(index).cast("bigint"), F.col(source).cast("bigint")
    if rule == "centre":
        low, high = _ceil_div(2 * target * i - n, 2 * n), _ceil_div(2 * target * (i + 1) - n, 2 * n) - 1
    elif rule == "corner":
        low, high = _ceil_div(target * i, n), _ceil_div(target * (i + 1), n) - 1
    else:
        raise ValueError(f"unknown resize rule {rule!r}")
    return F.when(low <= high, F.transform(F.sequence(low, high), lambda t: t.cast("int")))


def resize_nearest(cells: DataFrame, rows: int, cols: int, rule: str = "centre") -> DataFrame:
    """Nearest resampling; "centre" takes floor((i + 1/2) in/out), "corner" takes floor(i in/out).

    A narrow transformation: each cell emits the output cells that take it, without join or shuffle
    of the cells themselves.
    """
    shape = tile_shape(cells).select("tile_id", F.col("rows").alias("_rows"), F.col("cols").alias("_cols"))
    placed = attach(cells, shape, how="inner")
    placed = placed.withColumn("_r", F.explode(_nearest_targets("row", "_rows", rows, rule)))
    placed = placed.withColumn("_c", F.explode(_nearest_targets("col", "_cols", cols, rule)))
    rest = [c for c in cells.columns if c not in ("row", "col")]
    return placed.select(*rest, F.col("_r").alias("row"), F.col("_c").alias("col")).select(*cells.columns)


def _triangle_targets(rows: DataFrame, index: str, source: str, target: int, at: str, weight: str) -> DataFrame:
    """A row per output position ``at`` that a cell reaches, with its triangle ``weight`` there.

    Plain columns on exploded positions: functions over arrays are interpreted value by value, which took most of the
    time of a resampling.
    """
    scale = F.col(source) / F.lit(float(target))
    support = F.greatest(scale, F.lit(1.0))
    centre = F.col(index) + 0.5
    low = F.greatest(F.lit(0), F.ceil((centre - support) / scale - 0.5 - 1e-9).cast("int"))
    high = F.least(F.lit(target - 1), F.floor((centre + support) / scale - 0.5 + 1e-9).cast("int"))
    reached = rows.withColumn(at, F.explode(F.when(low <= high, F.sequence(low, high))))
    w = 1.0 - F.abs(centre - (F.col(at) + 0.5) * scale) / support
    return reached.withColumn(weight, w).where(F.col(weight) > 0)


def resize_bilinear(
    cells: DataFrame, rows: int, cols: int, values: Sequence[str] = ("value",), by: Sequence[str] = (),
    valid: str | None = None,
) -> DataFrame:
    """Triangle-filter resampling, widened by the scale when shrinking.

    With a ``valid`` column values are averaged over valid cells only and are 0 where the valid
    share of the weight is <= 1e-6. One aggregation by output cell with map-side combine.
    """
    shape = tile_shape(cells).select("tile_id", F.col("rows").alias("_rows"), F.col("cols").alias("_cols"))
    placed = attach(cells, shape, how="inner")
    placed = _triangle_targets(placed, "row", "_rows", rows, "_r", "_rw")
    placed = _triangle_targets(placed, "col", "_cols", cols, "_c", "_cw")
    placed = placed.withColumn("_w", F.col("_rw") * F.col("_cw"))
    use = F.col(valid) if valid else F.lit(True)
    own = F.when(use, F.col("_w")).otherwise(0.0)
    aggs = [F.sum(own * F.when(use, F.col(v)).otherwise(0.0)).alias(v) for v in values]
    sums = placed.groupBy("tile_id", F.col("_r").alias("row"), F.col("_c").alias("col"), *by).agg(
        *aggs, F.sum(own).alias("_own"), F.sum("_w").alias("_all")
    )
    covered = F.col("_own") / F.col("_all") > 1e-6
    return sums.select(
        "tile_id", "row", "col", *by,
        *[F.when(covered, F.col(v) / F.col("_own")).otherwise(0.0).alias(v) for v in values],
    )


def argmax_class(logits: DataFrame) -> DataFrame:
    """Class with the largest logit per cell, lowest id on ties."""
    best = F.max(F.struct("logit", (-F.col("class")).alias("_c")))
    return logits.groupBy("tile_id", "row", "col").agg(best.alias("_b")).select(
        "tile_id", "row", "col", (-F.col("_b._c")).cast("int").alias("class")
    )


def scene_labels(
    logits: DataFrame, size: int, boundary: DataFrame | None = None, valid: DataFrame | None = None
) -> DataFrame:
    """Resize class evidence first, then take the best class and clean the labels; invalid cells class 0.

    ``boundary`` is (tile_id, row, col, boundary) at source size, ``valid`` (…, valid) likewise.
    """
    from rastertab.operators.regions import clean_labels

    labels = argmax_class(resize_bilinear(logits, size, size, ["logit"], ["class"]))
    if boundary is not None:
        scaled = resize_bilinear(boundary, size, size, ["boundary"])
        labels = labels.join(scaled, ["tile_id", "row", "col"], "left")
    cleaned = clean_labels(labels)
    if valid is not None:
        mask = resize_nearest(valid.select("tile_id", "row", "col", "valid"), size, size)
        cleaned = cleaned.join(mask, ["tile_id", "row", "col"], "left").withColumn(
            "class", F.when(F.col("valid"), F.col("class")).otherwise(0)
        )
    return cleaned


def sigmoid(x) -> Column:
    """Logistic function with the argument clipped to +-30."""
    return 1.0 / (1.0 + F.exp(-F.greatest(F.lit(-30.0), F.least(F.lit(30.0), as_col(x)))))


def boundary_probability(cells: DataFrame, logit: str = "logit") -> DataFrame:
    """Adds probability in 0..1 from a boundary logit; 0 where invalid."""
    return cells.withColumn("probability", F.when(F.col("valid"), sigmoid(logit)).otherwise(0.0))


def boundary_confidence(cells: DataFrame) -> DataFrame:
    """Mean of max(p, 1 - p) over valid cells per tile."""
    p = F.when(F.col("valid"), F.col("probability"))
    return cells.groupBy("tile_id").agg(F.avg(F.greatest(p, 1.0 - p)).alias("boundary_confidence"))


def dihedral(cells: DataFrame) -> DataFrame:
    """All eight flips and turns of each tile: adds flip (0/1, mirrors columns first) and turns (0..3)."""
    shape = tile_shape(cells).select("tile_id", F.col("rows").alias("_rows"), F.col("cols").alias("_cols"))
    placed = attach(cells, shape, how="inner")
    variants = []
    for flip in (0, 1):
        r, c = F.col("row"), (F.col("_cols") - 1 - F.col("col")) if flip else F.col("col")
        last_r, last_c = F.col("_rows") - 1, F.col("_cols") - 1
        turned = [(r, c), (last_c - c, r), (last_r - r, last_c - c), (c, last_r - r)]
        for turns, (nr, nc) in enumerate(turned):
            variants.append(
                F.struct(
                    F.lit(flip).alias("flip"), F.lit(turns).alias("turns"),
                    nr.cast("int").alias("row"), nc.cast("int").alias("col"),
                )
            )
    rest = [c for c in cells.columns if c not in ("row", "col")]
    return placed.select(*rest, F.inline(F.array(*variants)))


def photometric(bands: DataFrame, seed: int = 7) -> DataFrame:
    """Seeded gain/offset (p 0.6), contrast (0.4), gamma (0.25) and noise (0.15); clip, truncate.

    **Departure**: the random numbers are hashes of (tile, seed), noise of (tile, cell, band, seed).
    """
    means = bands.groupBy("tile_id", "band").agg(F.avg("value").alias("_mean"))
    tile = F.col("tile_id")

    def chance(i: int, p: float) -> Column:
        return unit_hash(tile, seed, i) < p

    def uniform(i: int, low: float, high: float) -> Column:
        return low + (high - low) * unit_hash(tile, seed, i)

    # the draws of a tile are made once per band and joined with its mean
    drawn = means.withColumns(
        {
            "_gain": F.when(chance(1, 0.6), uniform(2, 0.85, 1.15)), "_offset": uniform(3, -8.0, 8.0),
            "_contrast": F.when(chance(4, 0.4), uniform(5, 0.9, 1.1)), "_gamma": F.when(chance(6, 0.25), uniform(7, 0.9, 1.1)), "_noisy": chance(8, 0.15),
        }
    )
    rows = attach(bands, drawn, ["tile_id", "band"])
    changed = F.col("_gain").isNotNull()
    v = F.when(changed, F.col("value") * F.col("_gain") + F.col("_offset")).otherwise(F.col("value"))
    mean = F.when(changed, F.col("_mean") * F.col("_gain") + F.col("_offset")).otherwise(F.col("_mean"))
    v = F.when(F.col("_contrast").isNotNull(), (v - mean) * F.col("_contrast") + mean).otherwise(v)
    unit = F.greatest(F.lit(0.0), F.least(F.lit(1.0), v / 255.0))
    v = F.when(F.col("_gamma").isNotNull(), 255.0 * F.pow(unit, F.col("_gamma"))).otherwise(v)
    cell = (tile, F.col("row"), F.col("col"), F.col("band"))
    normal = F.sqrt(-2.0 * F.log(1.0 - unit_hash(*cell, seed, 9))) * F.cos(2.0 * math.pi * unit_hash(*cell, seed, 10))
    v = F.when(F.col("_noisy"), v + 2.0 * normal).otherwise(v)
    clipped = F.floor(F.greatest(F.lit(0.0), F.least(F.lit(255.0), v))).cast("int")
    return rows.withColumn("value", clipped).drop("_mean", "_gain", "_offset", "_contrast", "_gamma", "_noisy")


def focus_crops(cells: DataFrame, size: int, per_tile: int = 1, seed: int = 7) -> DataFrame:
    """Crop windows (tile_id, crop, focus, top, left) centred on a random cell of a focus set.

    25% building, 15% height >= p90 of valid cells, 10% building boundary, 50% valid; clamped to the
    tile, centred when the tile is smaller. **Departure**: the random cell is the one with the least
    hash, found by a minimum with map-side combine; an empty focus set centres on any cell.
    """
    high = exact_quantiles(cells.where("valid"), ["tile_id"], "height", {"_p90": 0.9})
    rows = stencil(cells.withColumn("_b", F.col("class") == BUILDING), ["_b"], diagonals=False)
    rows = attach(rows.withColumn("_edge", edge_of("_b")), high)
    crops = rows.withColumn("crop", F.explode(F.sequence(F.lit(0), F.lit(per_tile - 1))))
    choice = unit_hash(F.col("tile_id"), F.col("crop"), seed)
    focus = F.when(choice < 0.25, "building").when(choice < 0.40, "high").when(choice < 0.50, "edge").otherwise("valid")
    crops = crops.withColumn("focus", focus)
    inside = (
        F.when(F.col("focus") == "building", F.col("_b"))
        .when(F.col("focus") == "high", F.coalesce(F.col("height") >= F.col("_p90"), F.lit(False)))
        .when(F.col("focus") == "edge", F.col("_edge"))
        .otherwise(F.col("valid"))
    )
    draw = F.struct(
        F.when(inside, 0).otherwise(1).alias("miss"),
        unit_hash(F.col("tile_id"), F.col("crop"), F.col("row"), F.col("col"), seed).alias("h"), "row", "col",
    )
    picked = crops.groupBy("tile_id", "crop", "focus").agg(F.min(draw).alias("_d")).join(tile_shape(cells), "tile_id")

    def start(axis: str, length: str) -> Column:
        n = F.col(length)
        free = F.greatest(F.lit(0), F.least(F.col(f"_d.{axis}") - size // 2, n - size))
        small = F.greatest(F.lit(0), F.floor((n - size) / 2).cast("int"))
        fits = (F.col("rows") > size) & (F.col("cols") > size)
        return F.when(fits, free).otherwise(small).cast("int")

    return picked.select(
        "tile_id", "crop", "focus", start("row", "rows").alias("top"), start("col", "cols").alias("left"),
        (F.col("_d.miss") == 0).alias("focused"),
    )


def crop_cells(cells: DataFrame, windows: DataFrame, size: int) -> DataFrame:
    """Cells of each crop window with crop-local coordinates."""
    joined = attach(cells, windows.select("tile_id", "crop", "top", "left"), how="inner")
    r, c = F.col("row") - F.col("top"), F.col("col") - F.col("left")
    return joined.where(r.between(0, size - 1) & c.between(0, size - 1)).withColumn("row", r).withColumn("col", c)


def sample_pixels(cells: DataFrame, k: int, seed: int = 7) -> DataFrame:
    """Uniform sample of k cells per tile: the k smallest hashes, not the first k cells."""
    usable = cells.where(finite("height"))
    order = unit_hash(F.col("tile_id"), F.col("row"), F.col("col"), seed)
    return spread_rank(usable, ["tile_id"], order, ["row", "col"], "_rank", limit=F.lit(k)).drop("_rank")
