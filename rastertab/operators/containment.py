"""Points in polygons over an adaptive grid.

Edges are filed under the grid cells they pass through, and every cell knows, for each region, whether its lower right
corner lies inside. A point then asks its own cell only: the parity of that corner, changed by every edge between the
corner and the point. Cells that hold many edges are split in four, level by level, until few edges are left in each;
the corners of the parts are points of the cell they come from.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from rastertab.functions.state import settle, shuffled

GRID = 64  # cells of the first level per unit of length
SHIFT = 0.3183098861837907  # grid lines are moved off round numbers, where vertices are
CROWDED = 64  # edges of a cell from which it is split
DEPTH = 16  # levels at most; edges that meet in one point can't be parted further
CELL = ["tile_id", "_l", "_i", "_j"]
ENDS = ("x1", "z1", "x2", "z2")


def _along(v: Column, level: Column) -> Column:
    return ((v + 0.5) * GRID + SHIFT) * F.pow(F.lit(2.0), level)


def _line(index: Column, level: Column) -> Column:
    return (index / F.pow(F.lit(2.0), level) - SHIFT) / GRID - 0.5


def _file(edges: DataFrame) -> DataFrame:
    """Edges under the cells of their level that they pass through, row of cells by row of cells."""
    level = F.col("_l")
    low, high = F.least("z1", "z2"), F.greatest("z1", "z2")
    row = F.explode(F.sequence(F.floor(_along(low, level) - 1e-9), F.floor(_along(high, level) + 1e-9)))
    cut = edges.withColumn("_j", row)
    slope = F.when(high > low, (F.col("x2") - F.col("x1")) / (F.col("z2") - F.col("z1")))

    def x_at(z: Column) -> Column:
        return F.col("x1") + (F.greatest(low, F.least(high, z)) - F.col("z1")) * slope

    a = F.coalesce(x_at(_line(F.col("_j"), level)), F.col("x1"))
    b = F.coalesce(x_at(_line(F.col("_j") + 1, level)), F.col("x2"))
    column = F.explode(F.sequence(F.floor(_along(F.least(a, b), level) - 1e-9), F.floor(_along(F.greatest(a, b), level) + 1e-9)))
    return cut.withColumn("_i", column)


def _place(points: DataFrame) -> DataFrame:
    level = F.col("_l")
    return points.withColumn("_i", F.floor(_along(F.col("x"), level))).withColumn("_j", F.floor(_along(F.col("z"), level)))


def _first_corners(edges: DataFrame) -> DataFrame:
    """(cell, region) of the first level whose lower right corner lies inside, from the crossings of grid lines."""
    zero = F.lit(0.0)
    low, high = F.least("z1", "z2"), F.greatest("z1", "z2")
    lines = edges.where(low < high).withColumn("_j", F.explode(F.sequence(F.floor(_along(low, zero)), F.floor(_along(high, zero)) + 1)))
    z = _line(F.col("_j"), zero)
    at = (F.col("x1") - F.col("x2")) * (z - F.col("z2")) / (F.col("z1") - F.col("z2")) + F.col("x2")
    hits = lines.where((F.col("z1") > z) != (F.col("z2") > z)).select("tile_id", "region", "_j", at.alias("at"))
    w = Window.partitionBy("tile_id", "region", "_j").orderBy("at")
    spans = hits.withColumn("_n", F.row_number().over(w)).withColumn("_to", F.lead("at").over(w)).where("_n % 2 = 1 AND _to IS NOT NULL")
    first, last = F.ceil(_along(F.col("at"), zero) - 1), F.ceil(_along(F.col("_to"), zero) - 1) - 1
    return spans.where(first <= last).select("tile_id", F.lit(0).alias("_l"), F.explode(F.sequence(first, last)).alias("_i"), "_j", "region")


def _parities(points: DataFrame, key: Sequence[str], corners: DataFrame, edges: DataFrame) -> DataFrame:
    """(key…, region) of the points that lie inside; ``points`` are (cell, key…, x, z)."""
    level = F.col("_l")
    right, bottom = _line(F.col("_i") + 1, level), _line(F.col("_j"), level)
    met = points.join(shuffled(edges.select(*CELL, "region", *ENDS)), CELL)
    x, z = F.col("x"), F.col("z")
    at = F.try_divide((F.col("x1") - F.col("x2")) * (z - F.col("z2")), F.col("z1") - F.col("z2")) + F.col("x2")
    beside = ((F.col("z1") > z) != (F.col("z2") > z)) & (x < at) & (at <= right)
    height = F.try_divide((right - F.col("x1")) * (F.col("z2") - F.col("z1")), F.col("x2") - F.col("x1")) + F.col("z1")
    below = ((F.col("x1") > right) != (F.col("x2") > right)) & (height > bottom) & (height <= z)
    crossed = F.coalesce(beside, F.lit(False)).cast("int") + F.coalesce(below, F.lit(False)).cast("int")
    votes = met.where(crossed > 0).select(*key, "region", crossed.alias("_v"))
    inside = points.join(shuffled(corners.select(*CELL, "region")), CELL).select(*key, "region", F.lit(1).alias("_v"))
    return votes.unionByName(inside).groupBy(*key, "region").agg(F.sum("_v").alias("_v")).where("_v % 2 = 1").drop("_v")


def _children(cells: DataFrame) -> DataFrame:
    """The four parts of each cell, with the cell as _pl, _pi, _pj and their lower right corner as x, z."""
    parts = F.array(*[F.struct(F.lit(a).alias("a"), F.lit(b).alias("b")) for a in (0, 1) for b in (0, 1)])
    four = cells.select("tile_id", F.col("_l").alias("_pl"), F.col("_i").alias("_pi"), F.col("_j").alias("_pj"), F.inline(parts))
    named = four.select("tile_id", "_pl", "_pi", "_pj", (F.col("_pl") + 1).alias("_l"), (F.col("_pi") * 2 + F.col("a")).alias("_i"), (F.col("_pj") * 2 + F.col("b")).alias("_j"))
    return named.withColumn("x", _line(F.col("_i") + 1, F.col("_l"))).withColumn("z", _line(F.col("_j"), F.col("_l")))


def points_in_polygons(points: DataFrame, edges: DataFrame, point_key: Sequence[str] = ("point_id",), crowded: int = CROWDED) -> DataFrame:
    """(tile_id, point_key…, region) for points inside a region by the even-odd rule, holes excluded.

    ``points`` is (tile_id, point_key…, x, z), ``edges`` (tile_id, region, x1, z1, x2, z2) of closed rings. A point
    meets the edges of its own cell and no others; a cell has at most ``crowded`` of them unless they meet in one point.
    Points and edges without finite coordinates take no part. Runs a job per level of the grid that is needed.
    """
    key = ["tile_id", *point_key]
    usable = lambda df, names: df.where(" AND ".join(f"abs(`{c}`) < double('inf')" for c in names))
    edges = usable(edges.select("tile_id", "region", *(F.col(c).cast("double").alias(c) for c in ENDS)), ENDS)
    points = usable(points.select(*key, F.col("x").cast("double").alias("x"), F.col("z").cast("double").alias("z")), ("x", "z")).distinct()
    filed = settle(_file(edges.withColumn("_l", F.lit(0))), "filed")
    corners, placed = settle(_first_corners(edges), "corners"), _place(points.withColumn("_l", F.lit(0)))
    done = None
    for _ in range(DEPTH):
        full = settle(filed.groupBy(*CELL).agg(F.count(F.lit(1)).alias("_n")).where(F.col("_n") > crowded).select(*CELL), "crowded")
        if full.isEmpty():
            break
        calm = _parities(placed.join(shuffled(full), CELL, "left_anti"), key, corners, filed)
        done = calm if done is None else done.unionByName(calm)
        parts = _children(full)
        # corners of the parts, as points of the cell they come from
        names = ["_cl", "_ci", "_cj"]
        asked = parts.select("tile_id", F.col("_pl").alias("_l"), F.col("_pi").alias("_i"), F.col("_pj").alias("_j"), *(F.col(a).alias(b) for a, b in zip(CELL[1:], names)), "x", "z")
        found = _parities(asked, ["tile_id", *names], corners, filed)
        deeper = filed.join(shuffled(full), CELL, "left_semi").select("tile_id", "region", *ENDS, F.col("_l").alias("_pl"), F.col("_i").alias("_pi"), F.col("_j").alias("_pj"))
        again = _file(deeper.withColumn("_l", F.col("_pl") + 1)).where((F.floor(F.col("_i") / 2) == F.col("_pi")) & (F.floor(F.col("_j") / 2) == F.col("_pj")))
        below = placed.join(shuffled(full), CELL, "left_semi").withColumn("_l", F.col("_l") + 1)
        placed = settle(_place(below.drop("_i", "_j")), "placed")
        corners = settle(found.select("tile_id", *(F.col(b).alias(a) for a, b in zip(CELL[1:], names)), "region"), "corners")
        filed = settle(again.select(*CELL, "region", *ENDS), "filed")
    last = _parities(placed, key, corners, filed)
    return last if done is None else done.unionByName(last)
