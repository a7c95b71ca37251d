"""Neighbourhood operators. Each shuffles the cells once by block, whatever the window."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rastertab.functions.columns import finite, middle_median, popcount_true, with_upper_median
from rastertab.functions.grid import (
    EIGHT, FOUR, attach, core, drop_neighbours, gather, stencil, tile_shape, with_halo,
)
from rastertab.functions.quantiles import exact_quantiles
from rastertab.functions.state import settle
from rastertab.operators.metrics import dilate4_wrap, height_boundary, with_boundaries
from rastertab.operators.losses import gradient_report
from rastertab.schema import BUILDING, GROUND, LOW_VEGETATION, OTHERS, ROAD, TREE, WATER

__all__ = [
    "abs_error", "base_height", "dilate4_wrap", "gradient_report", "ground_buildings", "height_boundary",
    "local_relief", "majority_filter", "mask_boundary", "median_filter3", "neighbours", "prepare_terrain",
    "slope_degrees", "smooth_ground_vegetation", "smooth_same_class", "suppress_green_spikes", "terrain_heights",
]

PROTECTED_BOUNDARY = 0.65


def neighbours(cells: DataFrame, connectivity: int = 4, include_self: bool = False) -> DataFrame:
    """(tile_id, row, col, n_row, n_col) pairs inside a tile."""
    rows = stencil(cells.select("tile_id", "row", "col"), ["row", "col"], diagonals=connectivity == 8)
    around = [F.col(f"n_{d}") for d in (EIGHT if connectivity == 8 else FOUR)]
    if include_self:
        around.append(F.struct("row", "col"))
    pairs = F.filter(F.array(*around), lambda n: n.isNotNull())
    return rows.select("tile_id", "row", "col", F.explode(pairs).alias("n")).select(
        "tile_id", "row", "col", F.col("n.row").alias("n_row"), F.col("n.col").alias("n_col")
    )


def _window(name: str) -> Column:
    """The up to nine values of a 3 x 3 window, absent cells as NULL."""
    return F.array(F.col(name), *[F.col(f"n_{d}.{name}") for d in EIGHT])


def majority_filter(cells: DataFrame, min_votes: int = 6) -> DataFrame:
    """Replace a class by the most frequent one of its 3 x 3 window, if it has at least ``min_votes``.

    Of equally frequent classes the smallest counts. Cells whose boundary confidence is >= 0.65 stay.
    """
    rows = stencil(cells, ["class"])
    votes = F.sort_array(F.filter(_window("class"), lambda c: c.isNotNull()))
    rows = rows.withColumn("_votes", votes)
    ranked = F.transform(
        F.array_distinct("_votes"),
        lambda c: F.struct(F.size(F.filter("_votes", lambda v: v == c)).alias("n"), (-c).alias("neg"), c.alias("c")),
    )
    rows = rows.withColumn("_best", F.array_max(ranked)).withColumn("_top", F.col("_best.c"))
    count = F.col("_best.n")
    free = F.lit(True)
    if "boundary" in cells.columns:
        free = ~F.coalesce(F.nanvl("boundary", F.lit(0.0)) >= PROTECTED_BOUNDARY, F.lit(False))
    changed = free & (count >= min_votes)
    out = rows.withColumn("class", F.when(changed, F.col("_top")).otherwise(F.col("class")))
    return drop_neighbours(out).drop("_votes", "_best", "_top").select(*cells.columns)


def _smooth_pass(blocked: DataFrame) -> DataFrame:
    rows = gather(blocked, ["class"])
    around = [F.col(f"n_{d}.class") for d in EIGHT]
    ground = popcount_true([c == GROUND for c in around])
    green = popcount_true([c == LOW_VEGETATION for c in around])
    rows = rows.withColumn("_g", ground).withColumn("_v", green)
    target = F.when(F.col("_g") >= F.col("_v"), F.lit(GROUND)).otherwise(F.lit(LOW_VEGETATION))
    smoothable = F.col("class").isin(OTHERS, GROUND, LOW_VEGETATION)
    changed = smoothable & (F.greatest("_g", "_v") >= 6)
    return drop_neighbours(rows.withColumn("class", F.when(changed, target).otherwise(F.col("class")))).drop("_g", "_v")


def smooth_ground_vegetation(cells: DataFrame, passes: int = 2) -> DataFrame:
    """Others, ground and low vegetation follow six or more like neighbours; ground wins ties.

    All passes run on one halo of that width, so there is one shuffle however many passes.
    """
    blocked = with_halo(cells, passes)
    for _ in range(passes):
        blocked = _smooth_pass(blocked)
    return core(blocked).select(*cells.columns)


def mask_boundary(cells: DataFrame, mask: Column, name: str = "edge") -> DataFrame:
    """True cells of ``mask`` with a 4-neighbour that is false or outside the tile."""
    return with_boundaries(cells, {name: mask})


# Extent of the viewer scene and its vertical scale.
WORLD_X, WORLD_Z, VERTICAL = 15.0, 11.0, 3.6


def slope_degrees(cells: DataFrame, exaggeration: float = 1.0, cell_size: tuple[float, float] | None = None) -> DataFrame:
    """Central-difference slope, clamped at the edge; an invalid or non-finite neighbour counts as the own height.

    By default in scene units (15 x 11 world, vertical 3.6 / max(maximum height, 1)); with
    ``cell_size`` = (x, z) in metres it is the slope of the heights as they are.
    """
    extra = {} if "valid" in cells.columns else {"valid": F.lit(True)}
    rows = stencil(cells.withColumns(extra), ["height", "valid"], diagonals=False)
    scalars = cells.groupBy("tile_id").agg(
        F.max(F.when(finite("height"), F.col("height"))).alias("_max"),
        (F.max("row") + 1).alias("_rows"), (F.max("col") + 1).alias("_cols"),
    )
    rows = attach(rows, scalars)

    def at(d: str) -> Column:
        usable = F.col(f"n_{d}.valid") & finite(F.col(f"n_{d}.height"))
        return F.when(usable, F.col(f"n_{d}.height")).otherwise(F.col("height"))

    if cell_size is None:
        vertical = F.lit(VERTICAL * exaggeration) / F.greatest(F.col("_max"), F.lit(1.0))
        step_x = F.lit(WORLD_X) / F.greatest(F.col("_cols") - 1, F.lit(1))
        step_z = F.lit(WORLD_Z) / F.greatest(F.col("_rows") - 1, F.lit(1))
    else:
        vertical, step_x, step_z = F.lit(exaggeration), F.lit(cell_size[0]), F.lit(cell_size[1])
    gx = (at("r") - at("l")) * vertical / F.greatest(step_x * 2, F.lit(0.001))
    gz = (at("d") - at("u")) * vertical / F.greatest(step_z * 2, F.lit(0.001))
    return rows.withColumn("slope", F.degrees(F.atan(F.hypot(gx, gz)))).select(*cells.columns, "slope")


def _relief(rows: DataFrame) -> Column:
    steps = [F.abs(F.col("height") - F.col(f"n_{d}.height")) for d in FOUR]
    steps = [F.when(finite(s), s) for s in steps]
    return F.least(F.lit(1.0), F.coalesce(F.greatest(*steps), F.lit(0.0)) / F.greatest(F.col("_range"), F.lit(1.0)))


def height_span(cells: DataFrame) -> DataFrame:
    h = F.when(finite("height"), F.col("height"))
    return cells.groupBy("tile_id").agg((F.max(h) - F.min(h)).alias("_range"))


def local_relief(cells: DataFrame) -> DataFrame:
    """Largest 4-neighbour step over max(height range of the tile, 1), at most 1."""
    rows = attach(stencil(cells, ["height"], diagonals=False), height_span(cells))
    return rows.withColumn("relief", _relief(rows)).select(*cells.columns, "relief")


def median_filter3(cells: DataFrame) -> DataFrame:
    """3 x 3 median of heights; beyond the edge the nearest line is repeated."""
    rows = stencil(cells, ["height"])
    h = F.col("height")
    side = {d: F.coalesce(F.col(f"n_{d}.height"), h) for d in FOUR}
    corner = {
        d: F.coalesce(F.col(f"n_{d}.height"), F.col(f"n_{d[1]}.height"), F.col(f"n_{d[0]}.height"), h)
        for d in ("ul", "ur", "dl", "dr")
    }
    return rows.withColumn("height", middle_median(h, *side.values(), *corner.values())).select(*cells.columns)


def base_height(cells: DataFrame) -> DataFrame:
    """Per tile the upper median of ground heights, else of valid non-building heights, else 0."""
    label = F.col("class")
    kinds = F.filter(
        F.array(F.when(label == GROUND, F.lit("g")), F.when((label >= 0) & (label != BUILDING), F.lit("n"))),
        lambda k: k.isNotNull(),
    )
    medians = exact_quantiles(
        cells.select("tile_id", "height", F.explode(kinds).alias("_kind")), ["tile_id", "_kind"], "height", {"_m": "upper"}
    )
    picked = medians.groupBy("tile_id").agg(
        F.coalesce(
            F.max(F.when(F.col("_kind") == "g", F.col("_m"))), F.max(F.when(F.col("_kind") == "n", F.col("_m")))
        ).alias("base_height")
    )
    return cells.select("tile_id").distinct().join(picked, "tile_id", "left").na.fill(0.0, ["base_height"])


def _terrain() -> tuple[list[Column], Column]:
    """Heights to take the median of, and the new height; needs base_height and max_height."""
    open_land = [
        F.when((F.col(f"n_{d}.class") >= 0) & (F.col(f"n_{d}.class") != BUILDING), F.col(f"n_{d}.height")) for d in EIGHT
    ]
    ceiling = F.col("base_height") + F.greatest(F.col("max_height") * 0.08, F.lit(0.5))
    return open_land, (
        F.when(F.col("class") == BUILDING, F.coalesce("_median", "base_height"))
        .when(F.col("class").isin(WATER, ROAD), F.col("base_height"))
        .otherwise(F.least(F.col("height"), ceiling))
    )


def _same_class() -> tuple[list[Column], Column]:
    alike = [F.when(F.col(f"n_{d}.class") == F.col("class"), F.col(f"n_{d}.height")) for d in FOUR]
    return [F.col("height"), *alike], (
        F.when(F.col("class") == BUILDING, F.col("height"))
        .when(F.col("class").isin(WATER, ROAD), F.col("base_height"))
        .otherwise(F.col("_median"))
    )


def _green() -> tuple[list[Column], Column]:
    soft = [F.when(~F.col(f"n_{d}.class").isin(BUILDING, ROAD, WATER), F.col(f"n_{d}.height")) for d in EIGHT]
    return [F.col("height"), *soft], F.when(
        F.col("class").isin(LOW_VEGETATION, TREE), F.col("_median")
    ).otherwise(F.col("height"))


def _height_pass(blocked: DataFrame, rule, diagonals: bool) -> DataFrame:
    """One height pass on blocked cells; the median of a window is computed once per cell."""
    values, height = rule()
    kept = blocked.columns
    rows = drop_neighbours(with_upper_median(gather(blocked, ["height", "class"], diagonals), values))
    return rows.withColumn("height", height).select(*kept)


def terrain_heights(cells: DataFrame) -> DataFrame:
    """Ground surface under each cell; needs base_height and max_height columns."""
    return core(_height_pass(with_halo(cells), _terrain, True)).select(*cells.columns)


def smooth_same_class(cells: DataFrame) -> DataFrame:
    """Upper median of a cell and its like 4-neighbours; buildings stay, water and road take the base."""
    return core(_height_pass(with_halo(cells), _same_class, False)).select(*cells.columns)


def suppress_green_spikes(cells: DataFrame) -> DataFrame:
    """Vegetation and trees take the upper median of their soft 3 x 3 surroundings."""
    return core(_height_pass(with_halo(cells), _green, True)).select(*cells.columns)


def ground_buildings(cells: DataFrame, footprints: DataFrame, edges: DataFrame) -> DataFrame:
    """Building cells take the ground height of the first footprint containing their centre.

    ``footprints`` is (tile_id, region, ground_height), lowest ``region`` first; ``edges`` its
    outline in normalised coordinates (tile_id, region, x1, z1, x2, z2).
    """
    from rastertab.operators.outlines import rasterize

    covered = rasterize(edges, tile_shape(cells)).join(
        cells.where(F.col("class") == BUILDING).select("tile_id", "row", "col"), ["tile_id", "row", "col"]
    )
    usable = footprints.where(finite("ground_height"))
    first = covered.join(usable, ["tile_id", "region"]).groupBy("tile_id", "row", "col").agg(F.min_by("ground_height", "region").alias("_ground"))
    return cells.join(first, ["tile_id", "row", "col"], "left").withColumn(
        "height", F.coalesce("_ground", "height")
    ).select(*cells.columns)


def prepare_terrain(
    cells: DataFrame, footprints: DataFrame | None = None, edges: DataFrame | None = None
) -> DataFrame:
    """Class smoothing, base height, terrain, same-class smoothing, grounding, spike suppression.

    Unknown classes become ground, invalid cells class -1. Two halo shuffles without footprints: one
    two cells wide for the class passes, one three cells wide for the height passes.
    """
    label = F.when(F.col("class").between(OTHERS, TREE), F.col("class")).otherwise(F.lit(GROUND))
    if "valid" in cells.columns:
        label = F.when(F.col("valid"), label).otherwise(F.lit(-1))
    safe = F.when(finite("height"), F.greatest(F.col("height"), F.lit(0.0))).otherwise(0.0)
    start = cells.select("tile_id", "row", "col", safe.alias("height"), label.cast("int").alias("class"))
    tops = start.groupBy("tile_id").agg(F.max("height").alias("max_height"))
    smooth = settle(smooth_ground_vegetation(start), "smooth")  # read by the base height and by the passes
    scaled = attach(smooth, base_height(smooth).join(tops, "tile_id"), how="inner")
    blocked = _height_pass(with_halo(scaled, 3), _terrain, True)
    blocked = _height_pass(blocked, _same_class, False)
    if footprints is None:
        return core(_height_pass(blocked, _green, True))
    return suppress_green_spikes(ground_buildings(core(blocked), footprints, edges))


def abs_error(pred: DataFrame, ref: DataFrame) -> DataFrame:
    """Absolute height error per cell of two tables."""
    return pred.select("tile_id", "row", "col", F.col("height").alias("_p")).join(
        ref.select("tile_id", "row", "col", F.col("height").alias("_t")), ["tile_id", "row", "col"]
    ).select("tile_id", "row", "col", F.abs(F.col("_p") - F.col("_t")).alias("abs_error"))
