"""Routing over road cells for many requests at once, on the two-level graph of :mod:`rastertab.operators.road_overlay`."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from rastertab.functions.columns import finite, js_round, python_round
from rastertab.functions.grid import EIGHT, FOUR, attach, stencil, tile_shape
from rastertab.functions.state import settle
from rastertab.operators.road_overlay import BLOCK, Roads, Search, prepare
from rastertab.operators.stencil import _relief, height_span
from rastertab.schema import BUILDING, CLASS_COUNT, ROAD, WATER

# Weights of the route profiles, hazard limits and rates.
PROFILES = {
    "fastest": (1.0, 0.04, 0.02),
    "safest": (0.55, 1.0, 0.2),
    "accessible": (0.7, 0.5, 1.0),
}
PENALTY, MINUTES_PER_CELL, UNCERTAIN = 2.25, 1.2, 0.35
REQUEST = ("route_id", "tile_id", "avoid_water", "profile", "start_row", "start_col", "dest_row", "dest_col")


def debris_cells(zones: DataFrame, sizes: DataFrame) -> DataFrame:
    """3 x 3 cells around each zone, clipped to the grid, each once: (route_id, row, col).

    ``zones`` is (route_id, row, col), ``sizes`` (route_id, rows, cols).
    """
    near = lambda axis: F.sequence(F.col(axis) - 1, F.col(axis) + 1)
    spread = zones.join(sizes, "route_id").withColumn("_r", F.explode(near("row"))).withColumn("_c", F.explode(near("col")))
    inside = (F.col("_r") >= 0) & (F.col("_c") >= 0) & (F.col("_r") < F.col("rows")) & (F.col("_c") < F.col("cols"))
    return spread.where(inside).select("route_id", F.col("_r").alias("row"), F.col("_c").alias("col")).distinct()


def road_hazards(cells: DataFrame) -> DataFrame:
    """Road cells with ``beside_water`` (8-neighbour of a water cell); other cells have no part in it."""
    rows = stencil(cells.where(F.col("class").isin(ROAD, WATER)).select("tile_id", "row", "col", "class"), ["class"])
    wet = F.lit(False)
    for d in EIGHT:
        wet = wet | F.coalesce(F.col(f"n_{d}.class") == WATER, F.lit(False))
    return rows.where(F.col("class") == ROAD).select("tile_id", "row", "col", wet.alias("beside_water"))


def hazard_counts(requests: DataFrame, cells: DataFrame, blocked: DataFrame) -> DataFrame:
    """Hazard numbers per request: water, beside-water road, debris and blocked road cells."""
    water = cells.groupBy("tile_id").agg(F.count_if(F.col("class") == WATER).alias("_water"))
    beside = road_hazards(cells).groupBy("tile_id").agg(F.count_if("beside_water").alias("_beside"))
    debris = blocked.join(requests.select("route_id", "tile_id"), "route_id")
    classes = cells.select("tile_id", "row", "col", (F.col("class") == ROAD).alias("_road"))
    debris = debris.join(classes, ["tile_id", "row", "col"], "left").groupBy("route_id").agg(
        F.count(F.lit(1)).alias("_debris"), F.count_if("_road").alias("_blocked")
    )
    joined = requests.join(water, "tile_id", "left").join(beside, "tile_id", "left").join(debris, "route_id", "left")
    avoid, zero = F.col("avoid_water"), F.lit(0)
    return joined.select(
        "route_id",
        F.when(avoid, F.coalesce("_water", zero)).otherwise(0).alias("water_cells"),
        F.when(avoid, F.coalesce("_beside", zero)).otherwise(0).alias("water_blocked_road_cells"),
        F.coalesce("_debris", zero).alias("debris_cells"),
        F.coalesce("_blocked", zero).alias("blocked_road_cells"),
    )


def route_problems(requests: DataFrame, cells: DataFrame, blocked: DataFrame) -> DataFrame:
    """First reason why a request cannot be routed: (route_id, problem); valid requests are absent."""
    bad_number = ~finite("height")
    if "uncertainty" in cells.columns:
        bad_number = bad_number | ~finite("uncertainty")
    grid = cells.groupBy("tile_id").agg(
        F.count(F.lit(1)).alias("_n"), (F.max("row") + 1).alias("_rows"), (F.max("col") + 1).alias("_cols"),
        F.count_if(~F.coalesce(F.col("class").between(0, CLASS_COUNT - 1), F.lit(False))).alias("_odd"),
        F.count_if(bad_number).alias("_bad"),
    )
    ends = requests.join(grid, "tile_id", "left")
    roads = road_hazards(cells)
    debris = blocked.select("route_id", "row", "col").distinct().withColumn("_hit", F.lit(True))
    for end in ("start", "dest"):
        at = [f"{end}_row", f"{end}_col"]
        ends = ends.join(
            roads.select("tile_id", F.col("row").alias(at[0]), F.col("col").alias(at[1]), F.col("beside_water").alias(f"_{end}_wet")),
            ["tile_id", *at], "left",
        ).join(
            debris.select("route_id", F.col("row").alias(at[0]), F.col("col").alias(at[1]), F.col("_hit").alias(f"_{end}_debris")),
            ["route_id", *at], "left",
        )
    outside = debris.join(requests.select("route_id", "tile_id"), "route_id").join(grid, "tile_id").where(
        (F.col("row") < 0) | (F.col("col") < 0) | (F.col("row") >= F.col("_rows")) | (F.col("col") >= F.col("_cols"))
    ).select("route_id").distinct().withColumn("_outside", F.lit(True))
    ends = ends.join(outside, "route_id", "left")

    def off(end: str) -> Column:
        r, c = F.col(f"{end}_row"), F.col(f"{end}_col")
        return ~F.coalesce((r >= 0) & (c >= 0) & (r < F.col("_rows")) & (c < F.col("_cols")), F.lit(False))

    yes = lambda name: F.coalesce(F.col(name), F.lit(False))
    square = (F.col("_rows") == F.col("_cols")) & (F.col("_n") == F.col("_rows").cast("bigint") * F.col("_cols")) & (F.col("_rows") >= 2)
    problem = (
        F.when(~F.coalesce(F.col("profile").isin(*PROFILES), F.lit(False)), "unknown_profile")
        .when(~F.coalesce(square, F.lit(False)), "wrong_grid_size")
        .when(F.col("_odd") > 0, "unknown_class")
        .when(off("start"), "start_outside")
        .when(off("dest"), "destination_outside")
        .when(F.col("_start_wet").isNull(), "start_not_road")
        .when(F.col("_dest_wet").isNull(), "destination_not_road")
        .when(yes("_outside"), "blocked_cell_outside")
        .when(yes("_start_debris") | yes("_dest_debris"), "endpoint_in_debris")
        .when(F.col("avoid_water") & yes("_start_wet"), "start_beside_water")
        .when(F.col("avoid_water") & yes("_dest_wet"), "destination_beside_water")
        .when(F.col("_bad") > 0, "non_finite_features")
    )
    return ends.select("route_id", problem.alias("problem")).where(F.col("problem").isNotNull())


def cell_risk(cells: DataFrame) -> DataFrame:
    """Risk, accessibility and hazard names of every road cell.

    ``risk`` counts water, ``risk_dry`` does not (for requests that do not avoid water); likewise
    ``hazards`` and ``hazards_dry``. One 8-neighbour stencil serves relief, buildings and water.
    """
    given = cells if "uncertainty" in cells.columns else cells.withColumn("uncertainty", F.lit(0.0))
    rows = stencil(given.select("tile_id", "row", "col", "class", "height", "uncertainty"), ["class", "height"])
    rows = attach(rows.where(F.col("class") == ROAD), height_span(cells))
    wet, built = F.lit(False), F.lit(False)
    for d in EIGHT:
        wet = wet | F.coalesce(F.col(f"n_{d}.class") == WATER, F.lit(False))
    for d in FOUR:
        built = built | F.coalesce(F.col(f"n_{d}.class") == BUILDING, F.lit(False))
    rows = rows.withColumns(
        {
            "relief": _relief(rows), "_wet": wet, "_built": built,
            "_u": F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.col("uncertainty"))),
        }
    )
    dry = F.col("relief") * 38.0 + F.col("_u") * 42.0 + F.when(F.col("_built"), 12.0).otherwise(0.0)
    top = F.lit(100.0)
    names = [F.when(F.col("_built"), F.lit("building proximity")), F.when(F.col("_u") >= UNCERTAIN, F.lit("prediction uncertainty"))]

    def listed(*flags) -> Column:
        return F.filter(F.array(*flags), lambda n: n.isNotNull())

    return rows.select(
        "tile_id", "row", "col", F.col("_wet").alias("beside_water"),
        F.least(top, dry + F.when(F.col("_wet"), 20.0).otherwise(0.0)).alias("risk"), F.least(top, dry).alias("risk_dry"),
        (F.col("relief") * 100.0).alias("accessibility"),
        listed(*names, F.when(F.col("_wet"), F.lit("water"))).alias("hazards"), listed(*names).alias("hazards_dry"),
    )


def _weight(which: int) -> Column:
    out = F.lit(None).cast("double")
    for name, weights in PROFILES.items():
        out = F.when(F.col("profile") == name, F.lit(weights[which])).otherwise(out)
    return out


def prepare_roads(roads: DataFrame, block: int = BLOCK) -> Roads:
    """Road cells and block borders, written once for all rounds of all searches."""
    return prepare(roads, block)


def _search(
    requests: DataFrame, roads: DataFrame | Roads, blocked: DataFrame | None, penalties: DataFrame | None, weighted: bool, block: int
) -> Search:
    """Least costs of ``requests``. ``roads`` is the output of :func:`cell_risk`, :func:`road_hazards` or :func:`prepare_roads`.

    Entering a cell costs 1 + risk w_r / 100 + accessibility w_a / 100 + 2.25 if penalised, or just 1 when not
    ``weighted``. Every cost is at least 1, so nothing beyond the best arrival at the destination is followed.
    """
    keys = ["route_id", "row", "col"]
    ask = requests.select(*REQUEST)
    changed = [df.select(*keys).join(ask.select("route_id"), "route_id", "left_semi") for df in (blocked, penalties) if df is not None]

    def price(work: DataFrame, single: bool) -> DataFrame:
        work = work.where(~(F.col("avoid_water") & F.col("beside_water")))
        cost = F.lit(1.0)
        if weighted:
            risk = F.when(F.col("avoid_water"), F.col("risk")).otherwise(F.col("risk_dry"))
            cost = 1.0 + risk * _weight(1) / 100.0 + F.col("accessibility") * _weight(2) / 100.0
        if single and blocked is not None:
            work = work.join(blocked.select(*keys).distinct(), keys, "left_anti")
        if single and penalties is not None:
            marked = penalties.select(*keys).distinct().withColumn("_p", F.lit(True))
            end = ((F.col("row") == F.col("start_row")) & (F.col("col") == F.col("start_col"))) | (
                (F.col("row") == F.col("dest_row")) & (F.col("col") == F.col("dest_col"))
            )
            work = work.join(marked, keys, "left")
            cost = cost + F.when(F.coalesce("_p", F.lit(False)) & ~end, PENALTY).otherwise(0.0)
        return work.withColumn("cost", cost)

    ready = roads if isinstance(roads, Roads) else prepare(roads, block)
    union = None if not changed else changed[0] if len(changed) == 1 else changed[0].unionByName(changed[1])
    return Search(ask, ready, price, union, ("avoid_water", "profile") if weighted else ("avoid_water",)).forward()


def shortest_distance(
    requests: DataFrame, roads: DataFrame | Roads, blocked: DataFrame | None = None, block: int = BLOCK
) -> DataFrame:
    """Unit-cost path length per request; NULL and "unreachable" when no road leads there."""
    requests = settle(requests.select(*REQUEST), "requests")
    goal = _search(requests, roads, blocked, None, False, block).costs()
    return requests.select("route_id").join(goal, "route_id", "left").select(
        "route_id", F.col("cost").cast("bigint").alias("distance_cells"),
        F.when(F.col("cost").isNull(), "unreachable").otherwise("reached").alias("status"),
    )


def cheapest_path(
    requests: DataFrame, roads: DataFrame | Roads, blocked: DataFrame | None = None, penalties: DataFrame | None = None,
    block: int = BLOCK,
) -> tuple[DataFrame, DataFrame]:
    """(costs, path): (route_id, cost) of reached requests and their path rows (route_id, seq, row, col)."""
    found = _search(settle(requests.select(*REQUEST), "requests"), roads, blocked, penalties, True, block)
    return found.costs(), found.paths()


def ranked_routes(
    requests: DataFrame, cells: DataFrame, blocked: DataFrame, rounds: int = 3, block: int = BLOCK
) -> tuple[DataFrame, DataFrame]:
    """(routes, paths): up to ``rounds`` alternatives per valid request with scores, best first.

    Each round penalises the interior of earlier paths; a request stops when a path repeats.
    Invalid requests are left out, see :func:`route_problems`.
    """
    valid = settle(requests.join(route_problems(requests, cells, blocked), "route_id", "left_anti"), "requests")
    roads = prepare_roads(cell_risk(cells), block)
    paths, open_requests = None, valid
    for alt in range(rounds):
        penalties = None
        if paths is not None:
            inner = paths.join(paths.groupBy("route_id", "alt").agg(F.max("seq").alias("_last")), ["route_id", "alt"])
            penalties = inner.where((F.col("seq") > 0) & (F.col("seq") < F.col("_last"))).select("route_id", "row", "col").distinct()
        _, path = cheapest_path(open_requests, roads, blocked, penalties, block)
        path = settle(path.withColumn("alt", F.lit(alt)), "path")
        if paths is not None:
            # A path repeats when it equals an earlier one cell by cell.
            size = path.groupBy("route_id").agg(F.count(F.lit(1)).alias("_n"))
            earlier = paths.groupBy("route_id", "alt").agg(F.count(F.lit(1)).alias("_m"))
            same = paths.join(path.select("route_id", "seq", "row", "col"), ["route_id", "seq", "row", "col"]).groupBy(
                "route_id", "alt"
            ).agg(F.count(F.lit(1)).alias("_s"))
            repeated = same.join(earlier, ["route_id", "alt"]).join(size, "route_id").where(
                (F.col("_s") == F.col("_n")) & (F.col("_s") == F.col("_m"))
            ).select("route_id").distinct()
            path = path.join(repeated, "route_id", "left_anti")
            paths = settle(paths.unionByName(path), "paths")
        else:
            paths = path
        open_requests = open_requests.join(
            paths.where(F.col("alt") == alt).select("route_id").distinct(), "route_id", "left_semi"
        )
        if alt + 1 < rounds and open_requests.isEmpty():
            break
    return rank_alternatives(score_paths(valid, roads.cells, cells, blocked, paths)), paths


def score_paths(requests: DataFrame, roads: DataFrame, cells: DataFrame, blocked: DataFrame, paths: DataFrame) -> DataFrame:
    """Distance, minutes, mean risk and accessibility, avoided hazards, profile score, path and its text."""
    ask = requests.select("route_id", "tile_id", "avoid_water", "profile")
    wet = F.col("avoid_water")
    placed = paths.join(ask, "route_id").join(roads, ["tile_id", "row", "col"])
    hazards = F.when(wet, F.col("hazards")).otherwise(F.col("hazards_dry"))
    # One path is one value of the result, so its array is as long as the path and no longer.
    points = F.transform(
        F.sort_array(F.collect_list(F.struct("seq", "row", "col"))), lambda p: F.struct(p["row"].alias("row"), p["col"].alias("column"))
    )
    sums = placed.groupBy("route_id", "alt").agg(
        (F.count(F.lit(1)) - 1).alias("distance_cells"),
        F.avg(F.when(wet, F.col("risk")).otherwise(F.col("risk_dry"))).alias("_risk"),
        F.avg("accessibility").alias("_access"), points.alias("path"),
    )
    point = lambda p: F.format_string("{'row': %d, 'column': %d}", p["row"], p["column"])
    text = F.concat(F.lit("["), F.array_join(F.transform("path", point), ", "), F.lit("]"))
    sums = sums.withColumn("path_text", text)
    met = placed.select("route_id", "alt", F.explode(hazards).alias("hazard")).distinct()
    tile_names = roads.select(
        "tile_id", F.explode("hazards").alias("hazard")
    ).distinct()
    on_roads = ask.join(tile_names, "tile_id").where(wet | (F.col("hazard") != "water")).select("route_id", "hazard")
    debris = blocked.select("route_id").distinct().withColumn("hazard", F.lit("debris"))
    flood = ask.where(wet).join(
        cells.where(F.col("class") == WATER).select("tile_id").distinct(), "tile_id", "left_semi"
    ).select("route_id", F.lit("water").alias("hazard"))
    known = on_roads.unionByName(debris).unionByName(flood).distinct()
    avoided = known.join(sums.select("route_id", "alt"), "route_id").join(
        met, ["route_id", "alt", "hazard"], "left_anti"
    ).groupBy("route_id", "alt").agg(F.sort_array(F.collect_set("hazard")).alias("avoided_hazards"))  # at most four names
    scored = sums.join(avoided, ["route_id", "alt"], "left").join(ask, "route_id")
    scored = scored.withColumn("risk_score", python_round(F.col("_risk"), 1)).withColumn(
        "accessibility_score", python_round(F.col("_access"), 1)
    )
    score = F.col("distance_cells") * _weight(0) + F.col("risk_score") * _weight(1) + F.col("accessibility_score") * _weight(2)
    return scored.select(
        "route_id", "alt", "profile", "distance_cells",
        python_round(F.col("distance_cells") * MINUTES_PER_CELL, 1).alias("travel_time_minutes"),
        "risk_score", "accessibility_score",
        F.coalesce("avoided_hazards", F.array().cast("array<string>")).alias("avoided_hazards"),
        python_round(score, 3).alias("profile_score"), "path", "path_text",
    )


def rank_alternatives(routes: DataFrame) -> DataFrame:
    """Adds ``place`` by score, distance, path text, and ``selected`` for the first."""
    order = Window.partitionBy("route_id").orderBy("profile_score", "distance_cells", "path_text")  # at most three rows
    return routes.withColumn("place", F.row_number().over(order)).withColumn("selected", F.col("place") == 1)


def reroute_compare(before: DataFrame, after: DataFrame) -> DataFrame:
    """Selected route before and after hazards, side by side; ``after`` may be missing."""
    columns = ("distance_cells", "travel_time_minutes", "risk_score", "accessibility_score", "profile_score")

    def side(routes: DataFrame, prefix: str) -> DataFrame:
        return routes.where("selected").select("route_id", *[F.col(c).alias(f"{prefix}_{c}") for c in columns])

    joined = side(before, "baseline").join(side(after, "hazard"), "route_id", "left")
    return joined.withColumn("reachable", F.col("hazard_distance_cells").isNotNull()).withColumn(
        "extra_cells", F.col("hazard_distance_cells") - F.col("baseline_distance_cells")
    )


def route_to_scene(path: DataFrame, sizes: DataFrame) -> DataFrame:
    """Route cells on a scene grid of another size; ``sizes`` is (route_id, route_size, scene_size)."""

    def scaled(axis: str) -> Column:
        top = F.greatest(F.col("scene_size") - 1, F.lit(0))
        value = js_round(F.col(axis) / F.greatest(F.col("route_size") - 1, F.lit(1)) * F.greatest(F.col("scene_size") - 1, F.lit(1)))
        return F.greatest(F.lit(0), F.least(top, value)).cast("int")

    return attach(path, sizes, ["route_id"], "inner").select(
        "route_id", "seq", scaled("row").alias("row"), scaled("col").alias("col")
    )


# The limitation texts of a brief.
LIMITS = {
    "always": "Decision support only; verify road status with field teams before dispatch.",
    "relative": "Terrain heights are relative estimates, not surveyed elevations.",
    "absolute": "Terrain heights are calibrated metric estimates.",
    "trained": "Semantic hazards come from a trained model and may contain classification uncertainty.",
    "fixture": "Semantic hazards come from a deterministic fixture mask.",
}


def route_brief(
    routes: DataFrame, requests: DataFrame, predictions: DataFrame, hazards: DataFrame, sizes: DataFrame, generated_at: Column | None = None
) -> DataFrame:
    """(route_id, brief): evacuation brief per selected route as one JSON text.

    ``predictions`` is (tile_id, height_reference, semantic_source, boundary_confidence), ``hazards`` the output of
    :func:`hazard_counts`, ``sizes`` that of :func:`grid_sizes`. ``generated_at`` is a timestamp, by default now; the
    brief has it in UTC. Unknown numbers are null in the text and not left out.
    """
    joined = (
        routes.where("selected")
        .join(requests.select("route_id", "tile_id", "avoid_water", "start_row", "start_col", "dest_row", "dest_col"), "route_id")
        .join(hazards, "route_id", "left")
        .join(sizes, "route_id", "left")
        .join(predictions, "tile_id", "left")
    )
    limits = F.array(
        F.lit(LIMITS["always"]),
        F.when(F.col("height_reference") == "relative", LIMITS["relative"]).otherwise(LIMITS["absolute"]),
        F.when(F.col("semantic_source") == "trained", LIMITS["trained"]).otherwise(LIMITS["fixture"]),
    )
    at = F.current_timestamp() if generated_at is None else generated_at
    utc = F.convert_timezone(None, F.lit("UTC"), at.cast("timestamp_ntz"))

    def point(end: str) -> Column:
        return F.struct(F.col(f"{end}_row").alias("row"), F.col(f"{end}_col").alias("column"))

    brief = F.struct(
        F.lit("evacuation-decision-support").alias("briefType"),
        F.date_format(utc, "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'").alias("generatedAt"),
        point("start").alias("origin"), point("dest").alias("destination"), F.col("rows").alias("gridSize"), "profile",
        F.col("distance_cells").alias("distanceCells"), F.col("travel_time_minutes").alias("estimatedTravelTimeMinutes"),
        F.col("risk_score").alias("riskScore"), F.col("accessibility_score").alias("accessibilityScore"),
        F.col("avoided_hazards").alias("avoidedHazards"),
        F.struct(
            F.col("water_cells").alias("waterCells"), F.col("water_blocked_road_cells").alias("waterBlockedRoadCells"),
            F.col("debris_cells").alias("debrisCells"), F.col("blocked_road_cells").alias("blockedRoadCells"),
            F.col("avoid_water").alias("waterAvoidance"),
        ).alias("hazards"),
        F.struct(
            F.col("semantic_source").alias("semanticSource"), F.col("boundary_confidence").alias("boundaryConfidence"),
            limits.alias("limitations"),
        ).alias("prediction"),
        F.col("path").alias("route"),
    )
    return joined.select("route_id", F.to_json(brief, {"ignoreNullFields": "false"}).alias("brief"))


def grid_sizes(requests: DataFrame, cells: DataFrame) -> DataFrame:
    """(route_id, rows, cols) of each request's tile."""
    return requests.select("route_id", "tile_id").join(tile_shape(cells), "tile_id").drop("tile_id")
