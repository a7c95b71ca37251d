"""Outline rings with their vertices in order.

Every unit edge knows its successor: the edge that leaves its end point, or, where two leave a diagonal vertex, the one
to the left, which stays at the same empty area. Rings are therefore simple, and an outline that touches its own hole
does not run into it. Successors make circular lists; blocks of a tile close the rings that lie inside them, all others
become pieces, one per passage through a block, whose circles are ranked by pointer doubling.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rastertab.functions.columns import python_round
from rastertab.functions.grid import attach, block_numbers, over_blocks
from rastertab.functions.state import settle
from rastertab.operators.components import BLOCK, CODE

EDGE = ["tile_id", "edge"]
_PIECES = "tile_id bigint, component bigint, edge bigint, head bigint, place bigint, turns boolean, next bigint, tail boolean, x int, y int, ring bigint"


def successors(edges: DataFrame) -> DataFrame:
    """(tile_id, component, edge, next, turns, x1, y1, x2, y2) of unit edges; numbers are 4 (y 2^32 + x) + direction."""
    heading = F.expr("CASE WHEN x2 > x1 THEN 0 WHEN y2 > y1 THEN 1 WHEN x2 < x1 THEN 2 ELSE 3 END")
    point = lambda y, x: F.col(y).cast("bigint") * CODE + F.col(x)
    coded = edges.withColumn("d", heading).withColumn("p1", point("y1", "x1")).withColumn("p2", point("y2", "x2"))
    keys = ["tile_id", "component"]
    leaving = coded.groupBy(*keys, F.col("p1").alias("p2")).agg(F.min("d").alias("_a"), F.max("d").alias("_b"))
    met = coded.join(leaving, [*keys, "p2"])
    nd = F.when(F.col("_a") == F.col("_b"), F.col("_a")).otherwise((F.col("d") + 3) % 4)
    return met.select(
        *keys, (F.col("p1") * 4 + F.col("d")).alias("edge"), (F.col("p2") * 4 + nd).alias("next"), (nd != F.col("d")).alias("turns"),
        "x1", "y1", "x2", "y2",
    )


def _places(before: np.ndarray, turns: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First edge of the piece of each edge, and the turns before it; ``before`` is its own place for a first edge."""
    jump, place = before.copy(), np.where(before == np.arange(len(before)), 0, turns[before].astype(np.int64))
    for _ in range(max(1, int(len(before)).bit_length())):
        place, jump = place + place[jump], jump[jump]
    return jump, place


def _join_blocks(pdf: pd.DataFrame) -> pd.DataFrame:
    """Edges of whole blocks: closed rings are ranked from their least corner, pieces of others from their first edge."""
    # edges are numbered anew, block after block, as their numbers are known in one tile only
    names, code = np.unique(np.concatenate([pdf["edge"], pdf["next"]]), return_inverse=True)
    which, n = block_numbers(pdf) * len(names), len(pdf)
    order = np.argsort(which + code[:n], kind="stable")
    own, wanted = (which + code[:n])[order], (which + code[n:])[order]
    pdf = pdf.iloc[order].reset_index(drop=True)
    edge, after, turns = pdf["edge"].to_numpy(), pdf["next"].to_numpy(), pdf["turns"].to_numpy()
    spot = np.minimum(np.searchsorted(own, wanted), n - 1)
    here = own[spot] == wanted
    every = np.arange(len(edge))
    before = every.copy()
    before[spot[here]] = every[here]
    first = np.ones(len(edge), bool)
    first[spot[here]] = False
    head, place = _places(before, turns)
    closed = ~first[head]  # never comes to a first edge
    # corners are named column first, so that a ring starts at its leftmost, then topmost one
    name = pdf["x2"].to_numpy().astype(np.int64) * CODE + pdf["y2"].to_numpy()
    least, jump = np.where(turns, name, np.iinfo(np.int64).max), np.where(here, spot, every)
    for _ in range(int(len(edge)).bit_length()):
        least, jump = np.minimum(least, least[jump]), jump[jump]
    cut = closed & turns & (least == name)
    before[cut] = every[cut]
    head, place = _places(before, turns)
    ring = pd.array(np.where(closed, least, 0), dtype="Int64")
    ring[~closed] = pd.NA
    return pd.DataFrame(
        {
            "tile_id": pdf["tile_id"], "component": pdf["component"], "edge": edge, "head": edge[head], "place": place, "turns": turns,
            "next": after, "tail": ~here, "x": pdf["x2"], "y": pdf["y2"], "ring": ring,
        }
    )


def ring_vertices(edges: DataFrame, block: int = BLOCK) -> DataFrame:
    """(tile_id, component, ring, is_hole, seq, x, y): corners of every ring in order, in cell units.

    ``edges`` is the output of :func:`~rastertab.operators.outlines.outline_edges`. ``ring`` is x * 2^32 + y of the
    ring's leftmost, then topmost corner, which has seq 0; the interior lies to the right. Points on straight sides are
    left out. Rings that touch at a vertex are rings of their own. The ring of the largest area is the outline, all
    others are holes. Runs jobs.
    """
    linked = successors(edges)
    local = settle(over_blocks(linked, ("y1", "x1"), block, _join_blocks, _PIECES), "rings")
    whole = local.where("ring IS NOT NULL").select("tile_id", "component", "ring", F.col("place").alias("seq"), "turns", "edge", "x", "y")
    pieces = local.where("ring IS NULL")
    if not pieces.isEmpty():
        whole = whole.unionByName(_across_blocks(pieces))
    whole = settle(whole, "ranked")
    # twice the area, from each edge's end point and heading
    d = F.col("edge") % 4
    dx = F.when(d == 0, 1).when(d == 2, -1).otherwise(0)
    dy = F.when(d == 1, 1).when(d == 3, -1).otherwise(0)
    rings = whole.groupBy("tile_id", "component", "ring").agg(F.abs(F.sum(F.col("x").cast("bigint") * dy - F.col("y").cast("bigint") * dx)).alias("a"))
    outer = rings.groupBy("tile_id", "component").agg(F.max(F.struct("a", (-F.col("ring")).alias("r"))).alias("_o"))
    corners = attach(whole.where("turns"), outer, ["tile_id", "component"], "inner", spread=["edge"])
    return corners.select("tile_id", "component", "ring", (-F.col("_o.r") != F.col("ring")).alias("is_hole"), "seq", "x", "y")


def _across_blocks(pieces: DataFrame) -> DataFrame:
    """Ring and place of the edges of rings that no single block holds."""
    key = ["tile_id", "id"]  # an edge belongs to one component of its tile
    name = F.when(F.col("turns"), F.col("x").cast("bigint") * CODE + F.col("y"))
    least = F.min(F.struct(name.isNull().alias("none"), name.alias("m"), F.col("place").alias("at")))
    made = pieces.groupBy("tile_id", F.col("head").alias("id")).agg(
        F.min("component").alias("component"), F.max(F.when(F.col("tail"), F.col("next"))).alias("to"), F.count_if("turns").alias("w"), least.alias("_l"),
    )
    most = F.lit((1 << 63) - 1)
    made = settle(made.select(*key, "component", "to", "w", F.coalesce("_l.m", most).alias("m"), F.col("_l.at").alias("at")), "pieces")
    # least corner of each circle: the way looked ahead doubles, until no piece learns of a smaller one
    now = made.select(*key, "to", "m")
    while True:
        ahead = now.select("tile_id", F.col("id").alias("to"), F.col("to").alias("_to"), F.col("m").alias("_m"))
        now = settle(
            now.join(ahead, ["tile_id", "to"]).select(*key, F.col("_to").alias("to"), F.least("m", "_m").alias("m"), (F.col("_m") < F.col("m")).alias("less")), "least"
        )
        if now.where("less").isEmpty():
            break
    named = settle(made.join(now.select(*key, F.col("m").alias("ring")), key).withColumn("first", F.col("m") == F.col("ring")), "named")
    # the circle is cut before the piece of its least corner, and the corners up to the end are counted
    starts = named.where("first").select("tile_id", F.col("id").alias("to"), F.lit(True).alias("_s"))
    left = named.join(starts, ["tile_id", "to"], "left").select(*key, F.when(F.col("_s").isNull(), F.col("to")).alias("to"), "w")
    left = settle(left, "left")
    while not left.where("to IS NOT NULL").isEmpty():
        ahead = left.select("tile_id", F.col("id").alias("to"), F.col("to").alias("_to"), F.col("w").alias("_w"))
        left = settle(
            left.join(ahead, ["tile_id", "to"], "left").select(*key, F.col("_to").alias("to"), (F.col("w") + F.coalesce("_w", F.lit(0))).alias("w")), "left"
        )
    placed = named.join(left.select(*key, F.col("w").alias("rest")), key)
    # a component and the hole it fills may share their least corner, two rings of one component do not
    ring = ["tile_id", "component", "ring"]
    totals = placed.where("first").select(*ring, F.col("rest").alias("total"), F.col("at").alias("from"))
    offsets = placed.join(totals, ring).select(*key, "ring", "total", (F.col("total") - F.col("rest") - F.col("from")).alias("shift"))
    edges = pieces.select("tile_id", "component", F.col("head").alias("id"), "place", "turns", "edge", "x", "y")
    return edges.join(offsets, key).select(
        "tile_id", "component", "ring", F.pmod(F.col("place") + F.col("shift"), F.col("total")).alias("seq"), "turns", "edge", "x", "y"
    )


def footprints(edges: DataFrame, shape: DataFrame, block: int = BLOCK) -> DataFrame:
    """:func:`ring_vertices` in normalised scene coordinates x, z, rounded to six digits; ``shape`` has rows and cols."""
    corners = attach(ring_vertices(edges, block), shape, how="inner", spread=["ring", "seq"])
    return corners.select(
        "tile_id", "component", "ring", "is_hole", "seq",
        python_round(F.col("x") / F.col("cols") - 0.5, 6).alias("x"), python_round(F.col("y") / F.col("rows") - 0.5, 6).alias("z"),
    )
