"""Outlines as edge tables: unit edges, rings, containment, crossings, polygon checks."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from rastertab.functions.columns import finite, python_round
from rastertab.functions.grid import attach, stencil
from rastertab.functions.state import settle, shuffled
from rastertab.operators.components import BLOCK, CODE, edge_pieces
from rastertab.operators.containment import points_in_polygons

TOLERANCE = 1e-9


def outline_edges(labelled: DataFrame) -> DataFrame:
    """Directed unit edges (x1, y1) -> (x2, y2) in cell units where a side leaves the component."""
    rows = stencil(labelled.select("tile_id", "row", "col", "component"), ["component"], diagonals=False)
    r, c = F.col("row"), F.col("col")
    sides = {"u": (c, r, c + 1, r), "r": (c + 1, r, c + 1, r + 1), "d": (c + 1, r + 1, c, r + 1), "l": (c, r + 1, c, r)}
    entries = [
        F.when(
            ~F.coalesce(F.col(f"n_{d}.component") == F.col("component"), F.lit(False)),
            F.struct(*[v.cast("int").alias(n) for v, n in zip(ends, ("x1", "y1", "x2", "y2"))]),
        )
        for d, ends in sides.items()
    ]
    return rows.select(
        "tile_id", "component", F.inline(F.filter(F.array(*entries), lambda e: e.isNotNull()))
    )


def _code(y: str, x: str) -> Column:
    return F.col(y).cast("bigint") * CODE + F.col(x)


def outline_rings(edges: DataFrame, block: int = BLOCK) -> DataFrame:
    """Rings of each component: edges, signed area (cells), corners, hole flag.

    The signed area needs no vertex order; the largest ring is the outer one. **Departure**: rings
    that meet at one diagonal vertex share an id.
    """
    keys = ["tile_id", "component"]
    coded = edges.withColumn("p1", _code("y1", "x1")).withColumn("p2", _code("y2", "x2"))
    points = edge_pieces(coded, block)
    area = F.sum(F.col("x1").cast("bigint") * F.col("y2") - F.col("x2").cast("bigint") * F.col("y1")) / 2
    sums = (
        coded.join(points.withColumnRenamed("point", "p1"), [*keys, "p1"])
        .groupBy(*keys, "ring")
        .agg(F.count(F.lit(1)).alias("edges"), area.alias("area"))
    )
    heading = F.struct((F.col("x2") - F.col("x1")).alias("dx"), (F.col("y2") - F.col("y1")).alias("dy"))
    ends = F.inline(
        F.array(
            F.struct(F.col("p1").alias("point"), heading.alias("out"), F.lit(None).cast("struct<dx:int,dy:int>").alias("into")),
            F.struct(F.col("p2").alias("point"), F.lit(None).cast("struct<dx:int,dy:int>").alias("out"), heading.alias("into")),
        )
    )
    turns = coded.select(*keys, ends).groupBy(*keys, "point").agg(
        F.when(F.count("out") > 1, F.count("out")).otherwise((F.max("out") != F.max("into")).cast("bigint")).alias("corners")
    )
    corners = turns.join(points, [*keys, "point"]).groupBy(*keys, "ring").agg(F.sum("corners").alias("corners"))
    rings = sums.join(corners, [*keys, "ring"])
    outer = rings.groupBy(*keys).agg(F.max(F.struct(F.abs("area").alias("a"), (-F.col("ring")).alias("r"))).alias("_o"))
    return attach(rings, outer, keys, "inner", spread=["ring"]).select(
        *keys, "ring", "edges", "area", "corners", (-F.col("_o.r") != F.col("ring")).alias("is_hole")
    )


def polygon_edges(polygons: DataFrame, points: str = "points") -> DataFrame:
    """Segments of closed rings: input (tile_id, region, ring, points ARRAY<STRUCT<x, z>>)."""
    n = F.size(points)
    # Every ring is one array already, so the next vertex is an element access and not a window.
    following = F.transform(
        F.sequence(F.lit(0), n - 1),
        lambda i: F.struct(
            i.alias("seq"), F.get(F.col(points), i).alias("a"), F.get(F.col(points), (i + 1) % n).alias("b")
        ),
    )
    return polygons.where(n > 0).select(
        "tile_id", "region", "ring", n.alias("n"), F.explode(following).alias("s")
    ).select(
        "tile_id", "region", "ring", "n", F.col("s.seq").alias("seq"),
        F.col("s.a.x").alias("x1"), F.col("s.a.z").alias("z1"), F.col("s.b.x").alias("x2"), F.col("s.b.z").alias("z2"),
    )


def normalized_edges(edges: DataFrame, shape: DataFrame) -> DataFrame:
    """Unit edges in cell units to normalised scene coordinates."""
    sized = attach(edges, shape, how="inner", spread=["x1", "y1"])
    return sized.select(
        "tile_id", F.col("component").alias("region"),
        (F.col("x1") / F.col("cols") - 0.5).alias("x1"), (F.col("y1") / F.col("rows") - 0.5).alias("z1"),
        (F.col("x2") / F.col("cols") - 0.5).alias("x2"), (F.col("y2") / F.col("rows") - 0.5).alias("z2"),
    )


def rasterize(edges: DataFrame, shape: DataFrame) -> DataFrame:
    """(tile_id, row, col, region) of the cells whose centre lies inside a region, by scanlines.

    Every edge emits its crossing with each cell-centre line it spans; consecutive crossings of a
    region on a line bound a span; a span emits its cells. Nothing is compared pairwise.
    """
    sized = attach(edges, shape, how="inner", spread=["x1", "z1"])
    low, high = F.least("z1", "z2"), F.greatest("z1", "z2")
    first = F.greatest(F.lit(0), F.ceil((low + 0.5) * F.col("rows") - 0.5 - 1e-9)).cast("int")
    last = F.least(F.col("rows") - 1, F.floor((high + 0.5) * F.col("rows") - 0.5 + 1e-9)).cast("int")
    lines = sized.where((low < high) & (first <= last)).withColumn("row", F.explode(F.sequence(first, last)))
    z = (F.col("row") + 0.5) / F.col("rows") - 0.5
    straddles = (F.col("z1") > z) != (F.col("z2") > z)
    at = F.try_divide((F.col("x1") - F.col("x2")) * (z - F.col("z2")), F.col("z1") - F.col("z2")) + F.col("x2")
    hits = lines.where(straddles).select("tile_id", "region", "row", "cols", at.alias("x"))
    w = Window.partitionBy("tile_id", "region", "row").orderBy("x")
    spans = hits.withColumn("_i", F.row_number().over(w)).withColumn("_to", F.lead("x").over(w)).where(
        (F.col("_i") % 2 == 1) & F.col("_to").isNotNull()
    )
    # A centre c is inside when x <= c < x_to.
    left = F.greatest(F.lit(0), F.ceil((F.col("x") + 0.5) * F.col("cols") - 0.5 - 1e-9)).cast("int")
    right = F.least(F.col("cols") - 1, F.ceil((F.col("_to") + 0.5) * F.col("cols") - 0.5 - 1e-9) - 1).cast("int")
    return spans.where(left <= right).select("tile_id", "row", F.explode(F.sequence(left, right)).alias("col"), "region")


def _side(ax, az, bx, bz, px, pz) -> Column:
    return (bx - ax) * (pz - az) - (bz - az) * (px - ax)


def _segments_meet() -> Column:
    """Proper crossing or touching within 1e-9 of segment (x1, z1)-(x2, z2) with segment o_(…)."""
    x1, z1, x2, z2 = (F.col(n) for n in ("x1", "z1", "x2", "z2"))
    u1, v1, u2, v2 = (F.col(f"o_{n}") for n in ("x1", "z1", "x2", "z2"))
    s = [
        _side(x1, z1, x2, z2, u1, v1), _side(x1, z1, x2, z2, u2, v2),
        _side(u1, v1, u2, v2, x1, z1), _side(u1, v1, u2, v2, x2, z2),
    ]

    def opposite(a: Column, b: Column) -> Column:
        return ((a > TOLERANCE) & (b < -TOLERANCE)) | ((a < -TOLERANCE) & (b > TOLERANCE))

    def on(ax, az, bx, bz, px, pz) -> Column:
        return px.between(F.least(ax, bx) - TOLERANCE, F.greatest(ax, bx) + TOLERANCE) & pz.between(
            F.least(az, bz) - TOLERANCE, F.greatest(az, bz) + TOLERANCE
        )

    flat = [F.abs(v) <= TOLERANCE for v in s]
    touches = (
        (flat[0] & on(x1, z1, x2, z2, u1, v1)) | (flat[1] & on(x1, z1, x2, z2, u2, v2))
        | (flat[2] & on(u1, v1, u2, v2, x1, z1)) | (flat[3] & on(u1, v1, u2, v2, x2, z2))
    )
    return (opposite(s[0], s[1]) & opposite(s[2], s[3])) | touches


def segment_crossings(edges: DataFrame, grid: float = 1.0 / 64) -> DataFrame:
    """Intersecting pairs of non-adjacent segments of a region: (tile_id, region, ring, seq, o_ring, o_seq).

    Segments are filed under the grid buckets of their bounding box; a pair is tested once, in the
    first bucket both boxes share.
    """

    def bucket(v: Column, pad: float) -> Column:
        return F.floor((v + pad) / grid)

    boxed = edges.withColumns(
        {
            "bx0": bucket(F.least("x1", "x2"), -2 * TOLERANCE), "bx1": bucket(F.greatest("x1", "x2"), 2 * TOLERANCE),
            "bz0": bucket(F.least("z1", "z2"), -2 * TOLERANCE), "bz1": bucket(F.greatest("z1", "z2"), 2 * TOLERANCE),
        }
    )
    filed = boxed.withColumn("_bx", F.explode(F.sequence("bx0", "bx1"))).withColumn(
        "_bz", F.explode(F.sequence("bz0", "bz1"))
    )
    keys = ["tile_id", "region", "_bx", "_bz"]
    other = filed.select(*keys, *[F.col(c).alias(f"o_{c}") for c in filed.columns if c not in keys])
    pairs = filed.join(shuffled(other), keys).where(
        ((F.col("ring") < F.col("o_ring")) | ((F.col("ring") == F.col("o_ring")) & (F.col("seq") < F.col("o_seq"))))
        & (F.col("_bx") == F.greatest("bx0", "o_bx0"))
        & (F.col("_bz") == F.greatest("bz0", "o_bz0"))
    )
    same = F.col("ring") == F.col("o_ring")
    step = F.col("o_seq") - F.col("seq")
    adjacent = same & ((step == 1) | (step == F.col("n") - 1))
    return pairs.where(~adjacent & _segments_meet()).select("tile_id", "region", "ring", "seq", "o_ring", "o_seq")


def ring_areas(edges: DataFrame) -> DataFrame:
    return edges.groupBy("tile_id", "region", "ring").agg(
        F.abs(F.sum(F.col("x1") * F.col("z2") - F.col("x2") * F.col("z1")) / 2).alias("area")
    )


def safe_holes(edges: DataFrame, outer: int = 0) -> DataFrame:
    """Rings accepted as holes of ring ``outer``: (tile_id, region, ring, area).

    A hole must be simple, start inside the outer ring, not meet it, and not meet a hole accepted
    before it (larger area first). Acceptance resolves in rounds over the table of meeting pairs, see :func:`outranked`.
    """
    keys = ["tile_id", "region"]
    meets = settle(segment_crossings(edges).select(*keys, "ring", "o_ring").distinct(), "crossings")
    areas = ring_areas(edges).where(F.col("ring") != outer)
    starts = edges.where((F.col("seq") == 0) & (F.col("ring") != outer)).select(
        *keys, "ring", F.col("x1").alias("x"), F.col("z1").alias("z")
    )
    outer_edges = edges.where(F.col("ring") == outer).select(*keys, "x1", "z1", "x2", "z2")
    # Candidate pairs share the region, so the region joins the tile in the point key.
    tagged = F.concat_ws(":", "tile_id", "region")
    inside = points_in_polygons(
        starts.select(tagged.alias("tile_id"), "ring", "x", "z"),
        outer_edges.select(tagged.alias("tile_id"), "region", "x1", "z1", "x2", "z2"), ["ring"],
    )
    blocked = meets.where(F.col("ring") == F.col("o_ring")).select(*keys, "ring").unionByName(
        meets.where((F.col("ring") == outer) & (F.col("o_ring") != outer)).select(*keys, F.col("o_ring").alias("ring"))
    ).unionByName(meets.where((F.col("o_ring") == outer) & (F.col("ring") != outer)).select(*keys, "ring")).distinct()
    candidates = settle(
        areas.join(
            shuffled(inside.select(tagged_split("tile_id").alias("tile_id"), "region", "ring")), [*keys, "ring"], "left_semi"
        ).join(shuffled(blocked), [*keys, "ring"], "left_anti"),
        "holes",
    )
    # Ordered conflicts: ``first`` outranks ``then``.
    rank = F.struct((-F.col("area")).alias("a"), F.col("ring").alias("r"))
    ranked = candidates.select(*keys, "ring", rank.alias("rank"))
    conflicts = (
        meets.where(F.col("ring") != F.col("o_ring"))
        .join(shuffled(ranked), [*keys, "ring"])
        .join(shuffled(ranked.select(*keys, F.col("ring").alias("o_ring"), F.col("rank").alias("o_rank"))), [*keys, "o_ring"])
        .select(*keys, F.least("rank", "o_rank")["r"].alias("first"), F.greatest("rank", "o_rank")["r"].alias("then"))
    )
    dropped = outranked(conflicts.distinct(), keys)
    return candidates if dropped is None else candidates.join(shuffled(dropped), [*keys, "ring"], "left_anti")


def outranked(conflicts: DataFrame, keys: Sequence[str]) -> DataFrame | None:
    """(keys…, ring) of the rings that an accepted ring outranks; None without conflicts. All other rings are accepted.

    ``conflicts`` is (keys…, first, then). A ring is accepted when no ring that outranks it is. A ring that one open
    ring alone outranks has the opposite fate, and so on along a chain: chains are resolved by pointer jumping, with
    the parity of the way, so rounds grow with the logarithm of a chain. Every round also settles whatever an accepted
    ring outranks.
    """
    keys, gone = list(keys), None
    left = settle(conflicts.select(*keys, "first", "then"), "conflicts")
    while not left.isEmpty():
        over = left.groupBy(*keys, F.col("then").alias("ring")).agg(F.count(F.lit(1)).alias("n"), F.min("first").alias("to"))
        over = settle(over, "over")
        now = over.where("n = 1").select(*keys, "ring", "to", F.lit(True).alias("odd"))
        while True:
            ahead = now.select(*keys, F.col("ring").alias("to"), F.col("to").alias("_to"), F.col("odd").alias("_odd"))
            step = now.join(shuffled(ahead), [*keys, "to"], "left").select(
                *keys, "ring", F.coalesce("_to", "to").alias("to"), (F.col("odd") != F.coalesce("_odd", F.lit(False))).alias("odd"),
                F.col("_to").isNotNull().alias("moved"),
            )
            now = settle(step, "chains")
            if now.where("moved").isEmpty():
                break
            now = now.drop("moved")
        tops = left.select(*keys, F.col("first").alias("ring")).distinct().join(shuffled(over), [*keys, "ring"], "left_anti")
        ended = now.join(shuffled(tops.withColumnRenamed("ring", "to")), [*keys, "to"], "left_semi")
        accepted = tops.unionByName(ended.where("NOT odd").select(*keys, "ring"))
        beaten = left.join(shuffled(accepted.withColumnRenamed("ring", "first")), [*keys, "first"], "left_semi")
        lost = settle(beaten.select(*keys, F.col("then").alias("ring")).distinct(), "lost")
        gone = lost if gone is None else gone.unionByName(lost)
        settled = accepted.unionByName(lost).distinct()
        left = settle(
            left.join(shuffled(settled.withColumnRenamed("ring", "first")), [*keys, "first"], "left_anti").join(
                shuffled(settled.withColumnRenamed("ring", "then")), [*keys, "then"], "left_anti"
            ),
            "conflicts",
        )
    return gone


def tagged_split(name: str) -> Column:
    return F.substring_index(F.col(name), ":", 1).cast("bigint")


def polygon_checks(polygons: DataFrame, holes: str | None = "holes") -> DataFrame:
    """Validity, convexity and safe height of footprints.

    Input (tile_id, region, points ARRAY<STRUCT<x, z>>, [holes ARRAY<ARRAY<…>>,] height, wall_height).
    Valid: at least three finite vertices, holes too. Convex: turns of one sign within 1e-8. Safe
    height: wall height, else height, floored at 0; 0.05 when neither is finite.
    """

    def usable(ring: Column) -> Column:
        return (F.size(ring) >= 3) & F.forall(ring, lambda p: finite(p["x"]) & finite(p["z"]))

    points = F.col("points")
    n = F.size(points)

    def turn(i: Column) -> Column:
        a, b, c = (F.get(points, (i + k) % n) for k in range(3))
        cross = (b["x"] - a["x"]) * (c["z"] - b["z"]) - (b["z"] - a["z"]) * (c["x"] - b["x"])
        return F.when(F.abs(cross) < 1e-8, F.lit(0.0)).otherwise(F.signum(cross))

    turns = F.array_distinct(F.filter(F.transform(F.sequence(F.lit(0), n - 1), turn), lambda t: t != 0))
    valid = usable(points)
    if holes and holes in polygons.columns:
        valid = valid & F.forall(F.coalesce(F.col(holes), F.array()), usable)
    chosen = F.when(finite("wall_height"), F.col("wall_height")).otherwise(F.col("height"))
    return polygons.select(
        "tile_id", "region",
        F.coalesce(valid, F.lit(False)).alias("valid"),
        F.coalesce(F.when(n > 0, F.size(turns) == 1), F.lit(False)).alias("convex"),
        F.when(finite(chosen), F.greatest(chosen, F.lit(0.0))).otherwise(0.05).alias("safe_height"),
    )


def rounded_outline(edges: DataFrame, digits: int = 6) -> DataFrame:
    return edges.select(
        "tile_id", "region", *[python_round(c, digits).alias(c) for c in ("x1", "z1", "x2", "z2")]
    )
