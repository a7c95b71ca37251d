"""Building regions: cleanup, components, statistics, roof families, viewer reports."""

from __future__ import annotations


from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rastertab.functions.columns import finite, python_round
from rastertab.functions.grid import EIGHT, OFFSETS, attach, row_major_rank, stencil, tile_shape
from rastertab.functions.quantiles import exact_quantiles
from rastertab.functions.state import settle, shuffled
from rastertab.operators.components import BLOCK, component_area, components, drop_below
from rastertab.operators.rings import footprints
from rastertab.operators.outlines import outline_edges, outline_rings
from rastertab.operators.stencil import PROTECTED_BOUNDARY, majority_filter
from rastertab.schema import BUILDING, GROUND, OTHERS, TREE

COMP = ["tile_id", "component"]
CELL = ["tile_id", "row", "col"]


def threshold_mask(cells: DataFrame) -> DataFrame:
    """Cells of the height fallback mask: h >= max(p72 of h above max(min, 0.001), 0.2 max h, 0.75)."""
    usable = cells.where(finite("height"))
    limits = usable.groupBy("tile_id").agg(F.min("height").alias("_min"), F.max("height").alias("_max"))
    rows = attach(usable, limits)
    raised = rows.where(F.col("height") > F.greatest(F.col("_min"), F.lit(1e-3)))
    p72 = exact_quantiles(raised, ["tile_id"], "height", {"_p72": 0.72})
    cut = F.greatest(F.col("_p72"), F.col("_max") * 0.2, F.lit(0.75))
    return attach(rows, p72, how="inner").where(F.col("height") >= cut).drop("_min", "_max", "_p72")


def _around(cells: DataFrame) -> DataFrame:
    """Each of the given cells with its eight positions n_row, n_col (which may not exist)."""
    moves = F.array(*[F.struct(F.lit(r).alias("dr"), F.lit(c).alias("dc")) for r, c in (OFFSETS[d] for d in EIGHT)])
    return cells.withColumn("_o", F.explode(moves)).withColumns(
        {"n_row": F.col("row") + F.col("_o.dr"), "n_col": F.col("col") + F.col("_o.dc")}
    ).drop("_o")


def drop_small_buildings(cells: DataFrame, area: int = 4, block: int = BLOCK) -> DataFrame:
    """Building components under ``area`` cells take the most frequent class around them.

    Neighbours count once per touching cell, ties go to the lowest id, none means ground.
    **Departure**: all components at once; a row-by-row pass differs only when two small
    components touch diagonally.
    """
    labelled = components(cells.where(F.col("class") == BUILDING), block)
    sizes = component_area(labelled).where(F.col("area") < max(1, area)).drop("area")
    small = attach(labelled, sizes, COMP, "inner")
    around = cells.where(F.col("class") != BUILDING).select(
        "tile_id", F.col("row").alias("n_row"), F.col("col").alias("n_col"), F.col("class").alias("_n")
    )
    votes = _around(small).join(shuffled(around), ["tile_id", "n_row", "n_col"]).groupBy(*COMP, "_n").agg(F.count(F.lit(1)).alias("n"))
    best = votes.groupBy(*COMP).agg(F.max(F.struct("n", (-F.col("_n")).alias("_c"))).alias("_b"))
    replaced = small.join(shuffled(best), COMP, "left").select(
        *CELL, F.coalesce((-F.col("_b._c")).cast("int"), F.lit(GROUND)).alias("_new")
    )
    return cells.join(shuffled(replaced), CELL, "left").withColumn("class", F.coalesce("_new", "class")).select(*cells.columns)


def fill_small_holes(cells: DataFrame, area: int = 4, block: int = BLOCK) -> DataFrame:
    """Enclosed non-building components of at most ``area`` cells become building.

    Not when they touch the tile edge, hold a protected boundary cell, or have any 8-neighbour
    outside themselves that is not building.
    """
    labelled = components(cells.where(F.col("class") != BUILDING), block)
    sizes = component_area(labelled).where(F.col("area") <= max(0, area)).drop("area")
    small = attach(labelled, sizes, COMP, "inner")
    outside = labelled.select(
        "tile_id", F.col("row").alias("n_row"), F.col("col").alias("n_col"), F.col("component").alias("_other")
    )
    extent = tile_shape(cells).select("tile_id", F.col("rows").alias("_rows"), F.col("cols").alias("_cols"))
    sized = attach(small, extent)
    edge = (F.col("row") == 0) | (F.col("col") == 0) | (F.col("row") == F.col("_rows") - 1) | (F.col("col") == F.col("_cols") - 1)
    open_side = _around(small).join(shuffled(outside), ["tile_id", "n_row", "n_col"]).where(F.col("_other") != F.col("component"))
    bad = sized.where(edge).select(*COMP).unionByName(open_side.select(*COMP))
    if "boundary" in cells.columns:
        strong = cells.where(F.nanvl("boundary", F.lit(0.0)) >= PROTECTED_BOUNDARY).select(*CELL)
        bad = bad.unionByName(small.join(shuffled(strong), CELL).select(*COMP))
    filled = small.join(shuffled(bad.distinct()), COMP, "left_anti").select(*CELL, F.lit(True).alias("_fill"))
    return cells.join(shuffled(filled), CELL, "left").withColumn(
        "class", F.when(F.col("_fill"), BUILDING).otherwise(F.col("class"))
    ).select(*cells.columns)


def clean_labels(cells: DataFrame, building_area: int = 4, hole_area: int = 4, block: int = BLOCK) -> DataFrame:
    """Majority filter, small buildings removed, small holes filled."""
    # Each step reads its input several times, so the steps are written once in between.
    kept = [c for c in ("tile_id", "row", "col", "class", "boundary") if c in cells.columns]
    voted = settle(majority_filter(cells.select(*kept)), "voted")
    solid = settle(drop_small_buildings(voted, building_area, block), "solid")
    cleaned = fill_small_holes(solid, hole_area, block)
    if kept == cells.columns:
        return cleaned
    return cells.drop("class").join(cleaned.select(*CELL, "class"), CELL).select(*cells.columns)


def split_on_seams(cells: DataFrame, threshold: float = PROTECTED_BOUNDARY, max_fraction: float = 0.04) -> DataFrame:
    """Adds ``building``: class 3 minus sparse seams of strong boundary between building cells.

    Seams are only cut when they are at most ``max_fraction`` of the building cells of the tile.
    """
    rows = stencil(cells.withColumn("_b", F.col("class") == BUILDING), ["_b"], diagonals=False)
    side = {d: F.coalesce(F.col(f"n_{d}._b"), F.lit(False)) for d in "udlr"}
    strong = F.coalesce(F.nanvl("boundary", F.lit(0.0)) >= threshold, F.lit(False))
    rows = rows.withColumn("_seam", strong & F.col("_b") & ((side["l"] & side["r"]) | (side["u"] & side["d"])))
    rows = rows.select(*cells.columns, "_b", "_seam")
    share = rows.groupBy("tile_id").agg(
        (F.count_if("_seam") / F.greatest(F.count_if("_b"), F.lit(1)) <= max_fraction).alias("_cut")
    )
    return attach(rows, share).withColumn(
        "building", F.col("_b") & ~(F.col("_seam") & F.coalesce(F.col("_cut"), F.lit(False)))
    ).drop("_b", "_seam", "_cut")


def building_boxes(labelled: DataFrame, shape: DataFrame) -> DataFrame:
    """Area, bounds, centre and size in normalised scene coordinates per component."""
    sums = labelled.groupBy(*COMP).agg(
        F.count(F.lit(1)).alias("area"),
        F.min("row").alias("min_row"), F.max("row").alias("max_row"),
        F.min("col").alias("min_col"), F.max("col").alias("max_col"),
    )
    sized = attach(sums, shape, how="inner", spread=["component"])
    cols, rows = F.col("cols"), F.col("rows")
    return sized.select(
        *COMP, "area", "min_row", "max_row", "min_col", "max_col",
        ((F.col("min_col") + F.col("max_col") + 1) / 2 / cols - 0.5).alias("center_x"),
        ((F.col("min_row") + F.col("max_row") + 1) / 2 / rows - 0.5).alias("center_z"),
        ((F.col("max_col") - F.col("min_col") + 1) / cols).alias("width"),
        ((F.col("max_row") - F.col("min_row") + 1) / rows).alias("depth"),
    )


def with_component(cells: DataFrame, labelled: DataFrame) -> DataFrame:
    return cells.join(labelled.select(*CELL, "component"), CELL, "left")


def ground_height(labelled: DataFrame, cells: DataFrame) -> DataFrame:
    """Median height around each component over label-0 cells, else over any cell, else 0.

    A surrounding cell counts once per component cell it touches.
    """
    rows = stencil(with_component(cells, labelled).select(*CELL, "component", "height", "class"), ["height", "class", "component"])
    around = F.filter(
        F.array(*[F.col(f"n_{d}") for d in EIGHT]),
        lambda n: n.isNotNull() & finite(n["height"]) & ~F.coalesce(n["component"] == F.col("component"), F.lit(False)),
    )
    seen = rows.where(F.col("component").isNotNull()).select(*COMP, F.explode(around).alias("n"))
    kinds = F.filter(F.array(F.lit("any"), F.when(F.col("n.class") == OTHERS, F.lit("zero"))), lambda k: k.isNotNull())
    medians = exact_quantiles(
        seen.select(*COMP, F.col("n.height").alias("height"), F.explode(kinds).alias("kind")),
        [*COMP, "kind"], "height", {"m": 0.5},
    )
    picked = medians.groupBy(*COMP).agg(
        F.coalesce(F.max(F.when(F.col("kind") == "zero", F.col("m"))), F.max("m")).alias("ground_height")
    )
    return labelled.select(*COMP).distinct().join(picked, COMP, "left").na.fill(0.0, ["ground_height"])


# Limits of the roof families.
FLAT_SPREAD, FLAT_SHARE, GABLE_RATIO = 0.8, 0.06, 0.55
RING_INNER, RING_OUTER, DOME_DROP, DOME_RESIDUAL = 0.38, 0.85, 0.9, 0.45


def roof_profiles(labelled: DataFrame, cells: DataFrame) -> DataFrame:
    """Everything roof families are judged by, one row per component.

    All medians (whole roof, per row, per column, per ring) come from one quantile pass.
    """
    # Heights arrive with the labels, so one join serves all statistics.
    rows = labelled.join(cells.select(*CELL, "height"), CELL).where(finite("height")).select(*COMP, "row", "col", "height")
    box = rows.groupBy(*COMP).agg(
        F.min("row").alias("_r0"), F.max("row").alias("_r1"), F.min("col").alias("_c0"), F.max("col").alias("_c1")
    )
    rows = attach(rows, box, COMP, "inner")

    def offset(axis: str, low: str, high: str) -> Column:
        half = F.greatest(F.col(high) - F.col(low), F.lit(1)) / 2.0
        return (F.col(axis) - (F.col(low) + F.col(high)) / 2.0) / half

    rows = rows.withColumn("r", F.hypot(offset("row", "_r0", "_r1"), offset("col", "_c0", "_c1")))
    rows = rows.withColumn("r2", F.col("r") * F.col("r"))
    ring = F.when(F.col("r") < RING_INNER, 0).when(F.col("r") < RING_OUTER, 1).otherwise(2)
    slices = F.array(
        *[
            F.struct(F.lit(k).alias("kind"), i.cast("int").alias("i"))
            for k, i in (("all", F.lit(0)), ("row", F.col("row")), ("col", F.col("col")), ("ring", ring))
        ]
    )
    medians = exact_quantiles(
        rows.select(*COMP, "height", F.inline(slices)), [*COMP, "kind", "i"], "height",
        {"p10": 0.1, "p50": 0.5, "p90": 0.9},
    )

    def pick(kind: str, column: str, i: int | None = None) -> Column:
        here = F.col("kind") == kind
        return F.when(here if i is None else here & (F.col("i") == i), F.col(column))

    profiles = medians.groupBy(*COMP).agg(
        F.max(pick("all", "p10")).alias("p10"), F.max(pick("all", "p90")).alias("p90"),
        (F.max(pick("row", "p50")) - F.min(pick("row", "p50"))).alias("row_variation"),
        (F.max(pick("col", "p50")) - F.min(pick("col", "p50"))).alias("col_variation"),
        *[F.max(pick("ring", "p50", i)).alias(f"ring{i}") for i in range(3)],
    )
    moments = rows.groupBy(*COMP).agg(
        F.var_pop("r").alias("s11"), F.var_pop("r2").alias("s22"), F.covar_pop("r", "r2").alias("s12"),
        F.covar_pop("r", "height").alias("s1v"), F.covar_pop("r2", "height").alias("s2v"), F.var_pop("height").alias("svv"),
    )
    linear = F.col("svv") - F.coalesce(F.try_divide(F.col("s1v") * F.col("s1v"), F.col("s11")), F.lit(0.0))
    det = F.col("s11") * F.col("s22") - F.col("s12") * F.col("s12")
    gain = F.try_divide(
        F.col("s1v") * F.col("s1v") * F.col("s22") - 2 * F.col("s1v") * F.col("s2v") * F.col("s12")
        + F.col("s2v") * F.col("s2v") * F.col("s11"),
        det,
    )
    quadratic = F.when(det > 1e-12 * F.col("s11") * F.col("s22"), F.col("svv") - gain).otherwise(F.col("_linear"))
    fits = moments.withColumn("_linear", linear).select(
        *COMP, F.col("_linear").alias("linear_residual"), quadratic.alias("quadratic_residual")
    )
    return profiles.join(fits, COMP)


def roof_family() -> Column:
    """Flat, gabled, dome or hipped from the columns of roof_profiles."""
    low, high = F.least("row_variation", "col_variation"), F.greatest("row_variation", "col_variation")
    inner, outer = F.col("ring0") - F.col("ring1"), F.col("ring1") - F.col("ring2")
    dome_rings = (inner >= 0) & (outer > 0) & (F.try_divide(inner, outer) < DOME_DROP)
    dome_fit = (F.col("linear_residual") > 1e-9) & (
        F.col("quadratic_residual") < F.col("linear_residual") * DOME_RESIDUAL
    )
    flat = F.col("p90") - F.col("p10") <= F.greatest(
        F.lit(FLAT_SPREAD), F.greatest(F.col("p90"), F.lit(1.0)) * FLAT_SHARE
    )
    return (
        F.when(F.col("p90").isNull() | flat, "flat")
        .when((high > 0) & (low < high * GABLE_RATIO), "gabled")
        .when(F.coalesce(dome_rings, F.lit(False)) | F.coalesce(dome_fit, F.lit(False)), "dome")
        .otherwise("hipped")
    )


def roof_type(labelled: DataFrame, cells: DataFrame) -> DataFrame:
    """(tile_id, component, roof_type); components without a finite height are flat."""
    profiles = roof_profiles(labelled, cells)
    return labelled.select(*COMP).distinct().join(profiles, COMP, "left").select(*COMP, roof_family().alias("roof_type"))


def _noise() -> Column:
    """Single cells without prominence; needs area, roof_height and ground_height."""
    prominence = F.col("roof_height") - F.col("ground_height")
    return (F.col("area") == 1) & (prominence < F.greatest(F.lit(0.5), F.abs("ground_height") * 0.25))


def building_grounds(labelled: DataFrame, cells: DataFrame) -> DataFrame:
    """(tile_id, component, ground_height) of the buildings in :func:`building_heights`.

    Which buildings those are depends on the roofs of single cells only, so no other roof is looked at: the roof of a
    single cell is its height.
    """
    sizes = component_area(labelled)
    single = labelled.join(sizes.where("area = 1").select(*COMP), COMP, "left_semi")
    roofs = single.join(cells.select(*CELL, "height"), CELL).where(finite("height")).select(*COMP, F.col("height").alias("_roof"))
    joined = sizes.join(ground_height(labelled, cells), COMP).join(roofs, COMP, "left")
    joined = joined.withColumn("roof_height", F.coalesce("_roof", "ground_height"))
    return joined.where(~_noise()).select(*COMP, "ground_height")


def building_heights(labelled: DataFrame, cells: DataFrame) -> DataFrame:
    """Ground, roof, relative, wall and rise heights; single cells without prominence are dropped."""
    ground = ground_height(labelled, cells)
    sizes = component_area(labelled)
    profiles = roof_profiles(labelled, cells).withColumn("roof_type", roof_family())
    joined = sizes.join(ground, COMP).join(profiles.select(*COMP, "p90", "roof_type"), COMP, "left")
    joined = joined.withColumn("roof_height", F.coalesce("p90", "ground_height")).withColumn(
        "roof_type", F.coalesce("roof_type", F.lit("flat"))
    )
    relative = F.greatest(F.col("roof_height") - F.col("ground_height"), F.lit(0.05))
    joined = joined.where(~_noise()).withColumn("height", relative)
    rise = F.when(F.col("roof_type") == "flat", 0.0).otherwise(F.greatest(F.col("height") * 0.28, F.lit(0.05)))
    return joined.withColumn("roof_rise", rise).withColumn("wall_height", F.col("height") - F.col("roof_rise")).select(
        *COMP, "area", "ground_height", "roof_height", "height", "roof_type", "wall_height", "roof_rise"
    )


def labelled_buildings(
    cells: DataFrame, source: str = "semantic_head", min_area: int = 1, block: int = BLOCK
) -> tuple[DataFrame, DataFrame]:
    """(cells, labelled): cells with the labels that ``source`` means, and the cells of their buildings."""
    if source == "height_threshold_fallback":
        mask = threshold_mask(cells).select(*CELL, F.lit(BUILDING).alias("_l"))
        cells = cells.join(mask, CELL, "left").withColumn("class", F.coalesce("_l", F.lit(OTHERS))).drop("_l")
    masked = split_on_seams(cells) if "boundary" in cells.columns else cells.withColumn("building", F.col("class") == BUILDING)
    return cells, settle(drop_below(components(masked.where("building"), block), min_area), "buildings")


def building_footprints(
    cells: DataFrame, source: str = "semantic_head", min_area: int = 1, block: int = BLOCK
) -> DataFrame:
    """Polygons of the buildings of all tiles, one row per corner: (tile_id, component, ring, is_hole, seq, x, z).

    Corners follow each other by ``seq`` around their ring; polygons join :func:`buildings` by (tile_id, component).
    """
    cells, labelled = labelled_buildings(cells, source, min_area, block)
    return footprints(outline_edges(labelled), tile_shape(cells), block)


def buildings(
    cells: DataFrame, source: str = "semantic_head", min_area: int = 1, block: int = BLOCK
) -> DataFrame:
    """The building table of all tiles: seams, components, boxes, heights, roofs and ring counts.

    ``source`` "semantic_head" takes class 3, "height_threshold_fallback" the height mask (whose
    cells become label 3 and all others label 0).
    """
    cells, labelled = labelled_buildings(cells, source, min_area, block)
    rings = outline_rings(outline_edges(labelled), block)
    outline = rings.groupBy(*COMP).agg(
        F.count_if("is_hole").alias("holes"), F.sum(F.when(~F.col("is_hole"), F.col("corners"))).alias("corners")
    )
    boxes = building_boxes(labelled, tile_shape(cells)).drop("area")
    table = building_heights(labelled, cells).join(boxes, COMP).join(outline, COMP)
    four = {c: python_round(c, 4) for c in ("height", "ground_height", "roof_height", "wall_height", "roof_rise")}
    return table.withColumns(four).withColumn("source", F.lit(source))


def threshold_regions(cells: DataFrame, min_area: int = 8, block: int = BLOCK) -> DataFrame:
    """Simple regions of h >= max(0.62 max h, 1): area >= 8, mean height floored at 0.18 max h, boxes."""
    tops = cells.groupBy("tile_id").agg(
        F.max(F.when(finite("height"), F.col("height"))).alias("_max"),
        (F.max("row") + 1).alias("rows"), (F.max("col") + 1).alias("cols"),
    )
    raised = attach(cells, tops).where(finite("height")).where(F.col("height") >= F.greatest(F.col("_max") * 0.62, F.lit(1.0)))
    labelled = components(raised, block).join(cells.select(*CELL, "height"), CELL)
    sums = labelled.groupBy(*COMP).agg(
        F.count(F.lit(1)).alias("area"), F.avg("height").alias("_mean"),
        F.min("row").alias("r0"), F.max("row").alias("r1"), F.min("col").alias("c0"), F.max("col").alias("c1"),
    ).where(F.col("area") >= min_area)
    sized = attach(sums, tops, how="inner", spread=["component"])
    cols, rows = F.col("cols"), F.col("rows")
    return sized.select(
        *COMP, "area",
        ((F.col("c0") + F.col("c1")) / 2 / (cols - 1) - 0.5).alias("center_x"),
        ((F.col("r0") + F.col("r1")) / 2 / (rows - 1) - 0.5).alias("center_z"),
        F.greatest((F.col("c1") - F.col("c0") + 1) / cols, F.lit(0.02)).alias("width"),
        F.greatest((F.col("r1") - F.col("r0") + 1) / rows, F.lit(0.02)).alias("depth"),
        F.greatest(F.col("_mean"), F.col("_max") * 0.18).alias("height"),
        (F.col("c0") / cols - 0.5).alias("x0"), (F.col("r0") / rows - 0.5).alias("z0"),
        ((F.col("c1") + 1) / cols - 0.5).alias("x1"), ((F.col("r1") + 1) / rows - 0.5).alias("z1"),
    )


def flatten_roofs(cells: DataFrame, block: int = BLOCK) -> DataFrame:
    """Building cells take the median height of their component."""
    labelled = components(cells.where(F.col("class") == BUILDING), block)
    rows = with_component(cells, labelled)
    medians = exact_quantiles(rows.where(F.col("component").isNotNull()), COMP, "height", {"_m": 0.5})
    return attach(rows, medians, COMP).withColumn("height", F.coalesce("_m", "height")).select(*cells.columns)


# Detail levels and the scene budget.
LOD2_RADIUS, LOD1_RADIUS = 0.36, 0.74
VERTEX_BUDGET, MAX_INSTANCES = 220_000, 512


def detail_level(table: DataFrame) -> DataFrame:
    """Adds detail_level by distance of the centre and the vertex estimate 2 x footprint corners.

    A missing corner count, and every distant building, is estimated as four corners.
    """
    reach = F.hypot("center_x", "center_z")
    level = F.when(reach <= LOD2_RADIUS, "lod2").when(reach <= LOD1_RADIUS, "lod1").otherwise("distant")
    corners = F.col("corners") if "corners" in table.columns else F.lit(None).cast("int")
    near = F.coalesce(corners, F.lit(4))
    return table.withColumn("detail_level", level).withColumn(
        "vertices", 2 * F.when(F.col("detail_level") == "distant", F.lit(4)).otherwise(near)
    )


def scene_quality(cells: DataFrame, table: DataFrame, min_grid: int = 128) -> DataFrame:
    """Quality report per tile: coverage, grounded walls, finite geometry, placement, vertex budget."""
    grid = cells.groupBy("tile_id").agg(
        F.count(F.lit(1)).alias("cells"), (F.max("row") + 1).alias("rows"), (F.max("col") + 1).alias("cols"),
        F.bool_and(finite("height")).alias("finite"), F.max(F.when(finite("height"), F.col("height"))).alias("top"),
    )
    rated = detail_level(table)
    numbers = ("center_x", "center_z", "width", "depth", "height", "wall_height", "ground_height", "roof_rise")
    # A missing optional number is fine, a non-finite one is not.
    sound = F.lit(True)
    for name in numbers:
        if name in table.columns:
            sound = sound & (F.col(name).isNull() | finite(name))
    wall = F.when(finite("wall_height"), F.col("wall_height")).otherwise(F.col("height"))
    base = F.coalesce(F.col("ground_height"), F.lit(0.0))
    placed = (
        finite("center_x") & finite("center_z") & finite("width") & finite("depth") & finite(base) & finite(wall)
        & (F.col("width") >= 0) & (F.col("depth") >= 0) & (wall >= 0)
    )
    sums = rated.groupBy("tile_id").agg(
        F.bool_and((base >= 0) & (wall >= 0)).alias("grounded"),
        F.bool_and(sound).alias("sound"), F.bool_and(placed).alias("placed"), F.sum("vertices").alias("vertices"),
        *[F.count_if(F.col("detail_level") == lv).alias(lv) for lv in ("lod2", "lod1", "distant")],
    )
    joined = grid.join(sums, "tile_id", "left")

    def yes(name: str) -> Column:
        return F.coalesce(F.col(name), F.lit(True))

    budget = F.col("rows").cast("bigint") * F.col("cols") + F.coalesce("vertices", F.lit(0))
    square = (F.col("cells") == F.col("rows") * F.col("cols")) & (F.col("rows") == F.col("cols"))
    return joined.select(
        "tile_id",
        (square & (F.col("rows") >= min_grid)).alias("full_grid_coverage"),
        yes("grounded").alias("grounded_walls"),
        (F.col("finite") & F.coalesce(F.col("top") >= 0, F.lit(False))).alias("continuous_terrain"),
        yes("sound").alias("finite_building_geometry"),
        yes("placed").alias("valid_building_placement"),
        (yes("sound") & yes("placed")).alias("fallback_safe"),
        budget.alias("estimated_vertices"),
        (budget <= VERTEX_BUDGET).alias("within_browser_budget"),
        *[F.coalesce(lv, F.lit(0)).alias(n) for lv, n in
          (("lod2", "detailed_buildings"), ("lod1", "medium_buildings"), ("distant", "distant_buildings"))],
    )


def instance_points(cells: DataFrame, class_id: int = TREE, budget: int = MAX_INSTANCES, exaggeration: float = 1.0) -> DataFrame:
    """Strided points of one class with deterministic jitter and scale, numbered by ``seq`` in row-major order.

    The stride is ceil(sqrt(count / budget)). All points on it are returned; a viewer that draws ``budget`` of them
    filters by ``seq``. Scales ignore heights that are not finite.
    """
    scalars = cells.groupBy("tile_id").agg(
        F.count_if(F.col("class") == class_id).alias("_n"), F.max(F.when(finite("height"), F.col("height"))).alias("_max"),
        (F.max("row") + 1).alias("_rows"), (F.max("col") + 1).alias("_cols"),
    )
    stride = F.greatest(F.lit(1), F.ceil(F.sqrt(F.col("_n") / budget)))
    on_grid = attach(cells.where(F.col("class") == class_id), scalars, how="inner").where(
        (F.col("row") % stride == 0) & (F.col("col") % stride == 0)
    )
    kept = row_major_rank(on_grid, "seq")
    jitter = ((F.col("row") * 17 + F.col("col") * 31) % 9 - 4) / 12.0
    scale = 3.6 / F.greatest(F.col("_max"), F.lit(1.0)) * exaggeration
    return kept.select(
        "tile_id", "row", "col", "seq",
        (((F.col("col") + 0.5 + jitter) / F.col("_cols") - 0.5) * 15.0).alias("x"),
        (F.col("height") * scale + 0.03).alias("y"),
        (((F.col("row") + 0.5 - jitter) / F.col("_rows") - 0.5) * 11.0).alias("z"),
        (0.84 + ((F.col("row") * 13 + F.col("col") * 7) % 5) * 0.08).alias("scale"),
    )
