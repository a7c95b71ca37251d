"""Connected components that survive one giant component.

Cells are labelled inside fixed-size blocks first (bounded work per group), then only the labels that
meet at block seams form a graph, which is contracted by alternating large-star and small-star
steps. Rounds grow with the logarithm of the seam graph, not with the diameter of a component.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rastertab.functions.grid import attach, block_numbers, over_blocks
from rastertab.functions.state import settle, shuffled

BLOCK = 256
CODE = 1 << 32  # label of a cell: row * CODE + col, ordered row-major


GRID_CELLS = 1 << 21  # cells of the grids that are labelled at once


def _label_blocks(pdf: pd.DataFrame) -> pd.DataFrame:
    """4-connected labels of whole blocks: least row-major code, spread along row and column runs.

    The blocks stand below each other in one grid, an empty line apart.
    """
    r, c, which = pdf["row"].to_numpy(), pdf["col"].to_numpy(), block_numbers(pdf)
    first = np.flatnonzero(np.diff(which, prepend=-1))
    r0 = r - np.minimum.reduceat(r, first)[which]
    c0 = c - np.minimum.reduceat(c, first)[which]
    lines = np.cumsum(np.maximum.reduceat(r0, first) + 2)
    part = ((lines - 1) // max(1, GRID_CELLS // (int(c0.max()) + 1)))[which]
    r0 = r0 + np.concatenate([[0], lines[:-1]])[which]
    code = np.unique(pdf["layer"].to_numpy(), return_inverse=True)[1]  # so that -1 means no cell
    own, local = r.astype(np.int64) * CODE + c, np.empty(len(pdf), np.int64)
    ends = np.flatnonzero(np.diff(part, append=part[-1] + 1)) + 1
    for low, high in zip([0, *ends[:-1]], ends):
        some = slice(low, high)
        local[some] = _label_grid(r0[some] - r0[some].min(), c0[some], code[some], own[some])
    return pd.DataFrame({"tile_id": pdf["tile_id"], "layer": pdf["layer"], "row": r, "col": c, "local": local})


def _label_grid(r0: np.ndarray, c0: np.ndarray, code: np.ndarray, own: np.ndarray) -> np.ndarray:
    layer = np.full((r0.max() + 1, c0.max() + 1), -1, dtype=np.int64)
    layer[r0, c0] = code
    label = np.zeros(layer.shape, dtype=np.int64)
    label[r0, c0] = own
    axes = []
    for turned in (False, True):
        grid = layer.T if turned else layer
        starts = np.ones(grid.shape, dtype=bool)
        starts[:, 1:] = grid[:, 1:] != grid[:, :-1]
        axes.append((turned, np.flatnonzero(starts), np.cumsum(starts.ravel()) - 1))
    while True:
        before = label.copy()
        for turned, starts, run in axes:
            flat = (label.T if turned else label).ravel()
            low = np.minimum.reduceat(flat, starts)[run].reshape((label.T if turned else label).shape)
            label = np.ascontiguousarray(low.T) if turned else low
        if np.array_equal(before, label):
            break
    return label[r0, c0]


def contract(edges: DataFrame, keys: Sequence[str]) -> DataFrame | None:
    """(keys…, node, root) for every non-root node of the graph ``edges`` (keys…, a, b); None if empty.

    One star step pair per round; the edge list is written to the shared folder between rounds and
    two numbers per round reach the driver.
    """
    keys = list(keys)
    current = settle(
        edges.where("a <> b").select(*keys, F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(),
        "edges",
    )
    mark = F.struct(F.count(F.lit(1)).alias("n"), F.sum(F.xxhash64(*keys, "a", "b").cast("decimal(20,0)")).alias("h"))
    seen = current.agg(mark.alias("m")).first()["m"]
    if seen["n"] == 0:
        return None
    while True:  # each pair of steps shrinks what is left; rounds grow with the logarithm of the graph
        both = current.unionByName(current.select(*keys, F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy(*keys, "a").agg(F.least(F.min("b"), F.first("a")).alias("m"))
        large = attach(both.where("b > a"), least, [*keys, "a"], "inner", spread=["b"]).select(
            *keys, F.col("b").alias("a"), F.col("m").alias("b")
        ).distinct()
        least = large.groupBy(*keys, "a").agg(F.min("b").alias("m"))
        small = attach(large, least, [*keys, "a"], "inner", spread=["b"])
        moved = small.where("b <> m").select(*keys, F.col("b").alias("a"), F.col("m").alias("b"))
        current = settle(
            moved.unionByName(small.select(*keys, "a", F.col("m").alias("b"))).distinct(), "edges"
        )
        now = current.agg(mark.alias("m")).first()["m"]
        if now == seen:
            return current.select(*keys, F.col("a").alias("node"), F.col("b").alias("root"))
        seen = now


def _seams(local: DataFrame, block: int) -> DataFrame:
    """Label pairs that touch across a block border."""
    pairs = []
    for axis in ("row", "col"):
        ahead = local.where((F.col(axis) + 1) % block == 0).withColumn(axis, F.col(axis) + 1)
        behind = local.where(F.col(axis) % block == 0)
        pairs.append(
            ahead.withColumnRenamed("local", "a").join(
                shuffled(behind.withColumnRenamed("local", "b")), ["tile_id", "layer", "row", "col"]
            ).select("tile_id", "layer", "a", "b")
        )
    return pairs[0].unionByName(pairs[1])


def components(mask: DataFrame, block: int = BLOCK, layer: str | None = None) -> DataFrame:
    """4-connected components of the cells given: (tile_id, row, col, [layer,] component).

    ``component`` is row * 2^32 + col of the first cell in row-major order. With ``layer`` (an integer
    column) cells connect only inside their layer. Runs jobs: block labels are written once.
    """
    tag = F.col(layer) if layer else F.lit(0)
    cells = mask.select("tile_id", "row", "col", tag.cast("bigint").alias("layer"))
    shape = "tile_id bigint, layer bigint, row int, col int, local bigint"
    local = settle(over_blocks(cells, ("row", "col"), block, _label_blocks, shape), "labels")
    stars = contract(_seams(local, block), ["tile_id", "layer"])
    if stars is None:
        labelled = local.withColumn("component", F.col("local"))
    else:
        labelled = local.join(
            stars.withColumnRenamed("node", "local"), ["tile_id", "layer", "local"], "left"
        ).withColumn("component", F.coalesce("root", "local"))
    out = ["tile_id", "row", "col", *(["layer"] if layer else []), "component"]
    return labelled.select(*out)


def component_area(labelled: DataFrame, by: Sequence[str] = ("tile_id", "component")) -> DataFrame:
    return labelled.groupBy(*by).agg(F.count(F.lit(1)).alias("area"))


def drop_below(labelled: DataFrame, min_area: int) -> DataFrame:
    """Only components of at least ``min_area`` cells."""
    if min_area <= 1:
        return labelled
    kept = component_area(labelled).where(F.col("area") >= min_area).drop("area")
    return attach(labelled, kept, ["tile_id", "component"], "inner")


def _label_edges(pdf: pd.DataFrame) -> pd.DataFrame:
    """Least point per connected piece of the unit edges of each of the given blocks."""
    ends = [pdf["tile_id"], pdf["component"], pd.Series(block_numbers(pdf))]
    nodes = pd.concat(
        [pd.DataFrame({"tile_id": ends[0], "which": ends[2], "component": ends[1], "point": pdf[p]}) for p in ("p1", "p2")], ignore_index=True
    )
    ids = nodes.groupby(["which", "component", "point"], sort=True).ngroup().to_numpy()  # ordered as the points of a piece are
    n = len(pdf)
    a, b = ids[:n], ids[n:]
    label = np.arange(ids.max() + 1)
    while True:
        low, now = np.minimum(label[a], label[b]), label.copy()
        for at in (a, b, label[a], label[b]):
            np.minimum.at(now, at, low)
        now = now[now]
        if np.array_equal(now, label):
            break
        label = now
    points = np.empty(len(label), np.int64)
    points[ids] = nodes["point"].to_numpy()
    out = nodes.assign(local=points[label[ids]]).drop_duplicates(["which", "component", "point"])
    return out[["tile_id", "component", "point", "local"]]


def edge_pieces(edges: DataFrame, block: int = BLOCK) -> DataFrame:
    """Connected pieces of unit edges: (tile_id, component, point, ring), ring = least point code.

    ``edges`` has tile_id, component, p1, p2 (point codes y * 2^32 + x) and y1, x1.
    """
    keys = ["tile_id", "component"]
    slim = edges.select("tile_id", "component", "p1", "p2", "y1", "x1")
    shape = "tile_id bigint, component bigint, point bigint, local bigint"
    local = settle(over_blocks(slim, ("y1", "x1"), block, _label_edges, shape), "rings")
    # A point on a block border is seen by at most four blocks.
    shared = local.groupBy(*keys, "point").agg(F.min("local").alias("a"), F.collect_set("local").alias("_all"))
    links = shared.where(F.size("_all") > 1).select(*keys, "a", F.explode("_all").alias("b"))
    stars = contract(links, keys)
    points = local.groupBy(*keys, "point").agg(F.min("local").alias("local"))
    if stars is None:
        return points.withColumnRenamed("local", "ring")
    return points.join(stars.withColumnRenamed("node", "local"), [*keys, "local"], "left").select(
        *keys, "point", F.coalesce("root", "local").alias("ring")
    )
