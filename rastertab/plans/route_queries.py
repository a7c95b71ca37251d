"""Routing queries (survey group 2.8)."""

from __future__ import annotations

from pyspark.sql import functions as F

from rastertab.operators import routes as rt
from rastertab.plans import fixtures as fx
from rastertab.plans.registry import query, rounded


def requests(spark, sf_dir):
    """Two requests per tile from its first to its last road cell, without and with water avoidance."""
    c = fx.cells(spark, sf_dir)
    at = F.struct("row", "col")
    ends = c.where(F.col("class") == 5).groupBy("tile_id").agg(F.min(at).alias("s"), F.max(at).alias("d"))
    variant = ends.withColumn("v", F.explode(F.array(F.lit(0), F.lit(1))))
    route = F.col("tile_id") * 2 + F.col("v")
    profile = F.element_at(F.array(*[F.lit(p) for p in ("fastest", "safest", "accessible")]), (F.col("tile_id") % 3 + 1).cast("int"))
    return variant.select(
        route.alias("route_id"), "tile_id", F.col("s.row").alias("start_row"), F.col("s.col").alias("start_col"),
        F.col("d.row").alias("dest_row"), F.col("d.col").alias("dest_col"), profile.alias("profile"), (F.col("v") == 1).alias("avoid_water"),
    )


def zones(spark, sf_dir):
    """Debris zones of the second request of every tile: road cells with k = 7."""
    c = fx.cells(spark, sf_dir)
    return c.where((F.col("class") == 5) & (F.col("k") == 7)).select((F.col("tile_id") * 2 + 1).alias("route_id"), "row", "col")


def blocked(spark, sf_dir):
    """The zone centres themselves, without their surroundings."""
    return zones(spark, sf_dir)


def risky(spark, sf_dir):
    c = fx.cells(spark, sf_dir)
    return c.select("tile_id", "row", "col", "class", "height", (F.col("boundary") * 0.5).alias("uncertainty"))


_REQ = """en AS (SELECT tile_id, min("row"*100+col) AS s, max("row"*100+col) AS d FROM cells WHERE class=5 GROUP BY tile_id),
rq AS (SELECT tile_id*2+v AS route_id, tile_id, (s//100)::INT AS start_row, (s%100)::INT AS start_col, (d//100)::INT AS dest_row, (d%100)::INT AS dest_col, ['fastest','safest','accessible'][tile_id%3+1] AS profile, v=1 AS avoid_water FROM en, (SELECT unnest([0,1]) AS v)),
bl AS (SELECT tile_id*2+1 AS route_id, "row", col FROM cells WHERE class=5 AND k=7),
rd AS (SELECT c.tile_id, c."row", c.col, EXISTS (SELECT 1 FROM cells n WHERE n.tile_id=c.tile_id AND n.class=4 AND n."row" BETWEEN c."row"-1 AND c."row"+1 AND n.col BETWEEN c.col-1 AND c.col+1) AS beside_water FROM cells c WHERE class=5)"""


@query("rt01_debris_cells", f"""WITH {_REQ}, sh AS (SELECT tile_id, max("row")+1 AS rs, max(col)+1 AS cs FROM cells GROUP BY tile_id)
SELECT DISTINCT route_id, (b."row"+dr)::INT AS "row", (b.col+dc)::INT AS col FROM bl b JOIN sh ON sh.tile_id=route_id//2 CROSS JOIN off9 o WHERE b."row"+dr BETWEEN 0 AND rs-1 AND b.col+dc BETWEEN 0 AND cs-1""")
def rt01(spark, sf_dir):
    r = requests(spark, sf_dir)
    return rt.debris_cells(zones(spark, sf_dir), rt.grid_sizes(r, fx.cells(spark, sf_dir)))


@query("rt02_road_hazards", f"WITH {_REQ} SELECT * FROM rd")
def rt02(spark, sf_dir):
    return rt.road_hazards(fx.cells(spark, sf_dir))


@query("rt02_hazard_counts", f"""WITH {_REQ}, w AS (SELECT tile_id, count(*) FILTER (class=4) AS w FROM cells GROUP BY tile_id), b AS (SELECT tile_id, count(*) FILTER (beside_water) AS b FROM rd GROUP BY tile_id), d AS (SELECT route_id, count(*) AS d FROM bl GROUP BY route_id)
SELECT rq.route_id, CASE WHEN avoid_water THEN w ELSE 0 END AS water_cells, CASE WHEN avoid_water THEN b ELSE 0 END AS water_blocked_road_cells, coalesce(d,0) AS debris_cells, coalesce(d,0) AS blocked_road_cells FROM rq JOIN w USING (tile_id) JOIN b USING (tile_id) LEFT JOIN d ON d.route_id=rq.route_id""")
def rt02b(spark, sf_dir):
    return rt.hazard_counts(requests(spark, sf_dir), fx.cells(spark, sf_dir), blocked(spark, sf_dir))


_PROB = """pb AS (SELECT rq.route_id, CASE WHEN g.n<>g.rs*g.cs OR g.rs<>g.cs THEN 'wrong_grid_size' WHEN EXISTS (SELECT 1 FROM bl WHERE bl.route_id=rq.route_id AND ((bl."row"=start_row AND bl.col=start_col) OR (bl."row"=dest_row AND bl.col=dest_col))) THEN 'endpoint_in_debris'
 WHEN avoid_water AND s.beside_water THEN 'start_beside_water' WHEN avoid_water AND e.beside_water THEN 'destination_beside_water' END AS problem FROM rq JOIN (SELECT tile_id, count(*) AS n, max("row")+1 AS rs, max(col)+1 AS cs FROM cells GROUP BY tile_id) g USING (tile_id)
 JOIN rd s ON s.tile_id=rq.tile_id AND s."row"=start_row AND s.col=start_col JOIN rd e ON e.tile_id=rq.tile_id AND e."row"=dest_row AND e.col=dest_col)"""


@query("rt03_route_problems", f"""WITH {_REQ}, {_PROB} SELECT route_id, problem FROM pb WHERE problem IS NOT NULL
UNION ALL SELECT route_id+1000000, CASE WHEN tile_id%3=0 THEN 'unknown_profile' WHEN size<>1024 THEN 'wrong_grid_size' WHEN tile_id%3=1 THEN 'start_outside' ELSE 'destination_not_road' END FROM rq JOIN (SELECT tile_id, count(*) AS size FROM cells GROUP BY tile_id) USING (tile_id)""")
def rt03(spark, sf_dir):
    r = requests(spark, sf_dir)
    m = F.col("tile_id") % 3
    broken = r.withColumns(
        {
            "route_id": F.col("route_id") + 1000000,
            "profile": F.when(m == 0, "scenic").otherwise(F.col("profile")),
            "start_row": F.when(m == 1, -1).otherwise(F.col("start_row")),
            "dest_row": F.when(m == 2, 4).otherwise(F.col("dest_row")),
            "dest_col": F.when(m == 2, 4).otherwise(F.col("dest_col")),
        }
    )
    return rt.route_problems(r.unionByName(broken), fx.cells(spark, sf_dir), blocked(spark, sf_dir))


_RISK = """hs AS (SELECT tile_id, greatest(max(height)-min(height),1) AS rg FROM cells GROUP BY tile_id),
nb AS (SELECT c.tile_id, c."row", c.col, max(abs(c.height-n.height)) AS st, bool_or(n.class=3) AS bu FROM cells c CROSS JOIN off4 o JOIN cells n ON n.tile_id=c.tile_id AND n."row"=c."row"+o.dr AND n.col=c.col+o.dc WHERE c.class=5 GROUP BY ALL),
rk AS (SELECT rd.*, least(1,st/rg) AS relief, c.boundary*0.5 AS u, bu FROM rd JOIN nb USING (tile_id,"row",col) JOIN hs USING (tile_id) JOIN cells c USING (tile_id,"row",col)),
rv AS (SELECT *, least(100, relief*38+u*42+CASE WHEN bu THEN 12 ELSE 0 END+CASE WHEN beside_water THEN 20 ELSE 0 END) AS risk, least(100, relief*38+u*42+CASE WHEN bu THEN 12 ELSE 0 END) AS risk_dry, relief*100 AS access FROM rk)"""


@query("rt04_cell_risk", f"""WITH {_REQ}, {_RISK} SELECT tile_id, "row", col, beside_water, round(risk,6) AS risk, round(risk_dry,6) AS risk_dry, round(access,6) AS accessibility,
array_to_string(list_filter([CASE WHEN bu THEN 'building proximity' END, CASE WHEN u>=0.35 THEN 'prediction uncertainty' END, CASE WHEN beside_water THEN 'water' END], lambda x: x IS NOT NULL), ',') AS hazards FROM rv""")
def rt04(spark, sf_dir):
    out = rt.cell_risk(risky(spark, sf_dir)).drop("hazards_dry")
    return rounded(out.withColumn("hazards", F.array_join("hazards", ",")))


_STEP = 'AND abs(n."row"-c."row")+abs(n.col-c.col)=1'


def _dist(name: str, pass_cte: str, roots: str) -> str:
    """Recursive CTE of the least cost to each passable cell (route_id, row, col, cost)."""
    return f"""{name}(route_id, "row", col, d) USING KEY (route_id, "row", col) AS (SELECT p.route_id, p."row", p.col, CASE WHEN p."row"=q.start_row AND p.col=q.start_col THEN 0.0::DOUBLE ELSE 1e18::DOUBLE END FROM {pass_cte} p JOIN {roots} q ON q.route_id=p.route_id
 UNION SELECT n.route_id, n."row", n.col, min(c.d+p.cost) FROM {name} c CROSS JOIN off4 o JOIN recurring.{name} n ON n.route_id=c.route_id AND n."row"=c."row"+o.dr AND n.col=c.col+o.dc JOIN {pass_cte} p ON p.route_id=n.route_id AND p."row"=n."row" AND p.col=n.col
 WHERE c.d<1e17 AND c.d+p.cost<n.d GROUP BY n.route_id, n."row", n.col)"""


_PASS_UNIT = """ps AS (SELECT q.route_id, r."row", r.col, 1.0::DOUBLE AS cost FROM rq q JOIN rd r USING (tile_id) WHERE NOT (avoid_water AND beside_water) AND NOT EXISTS (SELECT 1 FROM bl b WHERE b.route_id=q.route_id AND b."row"=r."row" AND b.col=r.col))"""


@query("rt05_shortest_distance", f"""WITH RECURSIVE {_REQ}, {_PASS_UNIT}, {_dist('ds', 'ps', 'rq')}
SELECT q.route_id, CASE WHEN d<1e17 THEN d::BIGINT END AS distance_cells, CASE WHEN d<1e17 THEN 'reached' ELSE 'unreachable' END AS status FROM rq q LEFT JOIN ds ON ds.route_id=q.route_id AND ds."row"=q.dest_row AND ds.col=q.dest_col""")
def rt05(spark, sf_dir):
    return rt.shortest_distance(requests(spark, sf_dir), rt.road_hazards(fx.cells(spark, sf_dir)), blocked(spark, sf_dir))


@query("rt05_shortest_distance_across_blocks", f"""WITH RECURSIVE {_REQ}, {_PASS_UNIT}, {_dist('ds', 'ps', 'rq')}
SELECT q.route_id, CASE WHEN d<1e17 THEN d::BIGINT END AS distance_cells, CASE WHEN d<1e17 THEN 'reached' ELSE 'unreachable' END AS status FROM rq q LEFT JOIN ds ON ds.route_id=q.route_id AND ds."row"=q.dest_row AND ds.col=q.dest_col""")
def rt05b(spark, sf_dir):
    """Blocks of 20 cells, so that every search crosses borders."""
    return rt.shortest_distance(
        requests(spark, sf_dir), rt.road_hazards(fx.cells(spark, sf_dir)), blocked(spark, sf_dir), block=20
    )


_W = """wt AS (SELECT * FROM (VALUES ('fastest',1.0,0.04,0.02),('safest',0.55,1.0,0.2),('accessible',0.7,0.5,1.0)) v(profile,wd,wr,wa)),
vq AS (SELECT rq.* FROM rq JOIN pb USING (route_id) WHERE problem IS NULL)"""


def _round_sql(i: int) -> str:
    """CTEs of search round i: passable cells, distances, predecessors, path pt{i}."""
    penal = " OR ".join(f'EXISTS (SELECT 1 FROM pt{j} z WHERE z.route_id=q.route_id AND z."row"=r."row" AND z.col=r.col)' for j in range(i)) or "false"
    asked = "vq" if i == 0 else f"(SELECT * FROM vq WHERE route_id IN (SELECT route_id FROM kp{i - 1}))"
    same = " OR ".join(f"sg{i}.sig=(SELECT sig FROM sg{j} WHERE sg{j}.route_id=sg{i}.route_id)" for j in range(i)) or "false"
    return f"""q{i} AS (SELECT * FROM {asked}),
ps{i} AS (SELECT q.route_id, r."row", r.col, 1+(CASE WHEN avoid_water THEN risk ELSE risk_dry END)*wr/100+access*wa/100+CASE WHEN ({penal}) AND NOT (r."row"=start_row AND r.col=start_col) AND NOT (r."row"=dest_row AND r.col=dest_col) THEN 2.25 ELSE 0 END AS cost
 FROM q{i} q JOIN wt USING (profile) JOIN rv r USING (tile_id) WHERE NOT (avoid_water AND beside_water) AND NOT EXISTS (SELECT 1 FROM bl b WHERE b.route_id=q.route_id AND b."row"=r."row" AND b.col=r.col)),
{_dist(f'ds{i}', f'ps{i}', f'q{i}')},
pd{i} AS (SELECT c.route_id, c."row", c.col, min(n."row"*100+n.col) AS p FROM ds{i} c CROSS JOIN off4 o JOIN ds{i} n ON n.route_id=c.route_id AND n."row"=c."row"+o.dr AND n.col=c.col+o.dc JOIN ps{i} k ON k.route_id=c.route_id AND k."row"=c."row" AND k.col=c.col
 WHERE c.d>0 AND c.d<1e17 AND n.d+k.cost<=c.d+1e-9 GROUP BY ALL),
wk{i}(route_id, "row", col, back) AS (SELECT q.route_id, dest_row, dest_col, 0 FROM q{i} q JOIN ds{i} d ON d.route_id=q.route_id AND d."row"=dest_row AND d.col=dest_col WHERE d<1e17
 UNION ALL SELECT w.route_id, (p//100)::INT, (p%100)::INT, back+1 FROM wk{i} w JOIN pd{i} p ON p.route_id=w.route_id AND p."row"=w."row" AND p.col=w.col),
sg{i} AS (SELECT route_id, string_agg("row"||','||col, ';' ORDER BY back) AS sig FROM wk{i} GROUP BY route_id),
kp{i} AS (SELECT route_id FROM sg{i} WHERE NOT ({same})),
fp{i} AS (SELECT route_id, max(back) OVER (PARTITION BY route_id)-back AS seq, "row", col, max(back) OVER (PARTITION BY route_id) AS lst FROM wk{i} WHERE route_id IN (SELECT route_id FROM kp{i})),
pt{i} AS (SELECT * FROM fp{i} WHERE seq>0 AND seq<lst)"""


@query("rt06_cheapest_path", f"""WITH RECURSIVE {_REQ}, {_PROB}, {_RISK}, {_W}, {_round_sql(0)} SELECT f.route_id, seq::BIGINT AS seq, f."row", f.col, round(d,6) AS cost FROM fp0 f JOIN vq q USING (route_id) JOIN ds0 d ON d.route_id=f.route_id AND d."row"=dest_row AND d.col=dest_col""")
def rt06(spark, sf_dir):
    r, b, c = requests(spark, sf_dir), blocked(spark, sf_dir), risky(spark, sf_dir)
    valid = r.join(rt.route_problems(r, c, b), "route_id", "left_anti")
    costs, path = rt.cheapest_path(valid, rt.cell_risk(c), b)
    return rounded(path.join(costs, "route_id"))


_THREE = f"{_REQ}, {_PROB}, {_RISK}, {_W}, {_round_sql(0)}, {_round_sql(1)}, {_round_sql(2)}"
_ALTS = """fa AS (SELECT 0 AS alt, * FROM fp0 UNION ALL SELECT 1, * FROM fp1 UNION ALL SELECT 2, * FROM fp2),
sc AS (SELECT route_id, alt, any_value(profile) AS profile, count(*)-1 AS distance_cells, round_even(avg(CASE WHEN avoid_water THEN risk ELSE risk_dry END),1) AS risk_score, round_even(avg(access),1) AS accessibility_score,
 bool_or(bu) AS hb, bool_or(u>=0.35) AS hu, bool_or(avoid_water AND beside_water) AS hw, string_agg('{''row'': '||f."row"||', ''column'': '||f.col||'}', ', ' ORDER BY seq) AS txt FROM fa f JOIN vq USING (route_id) JOIN rv ON rv.tile_id=vq.tile_id AND rv."row"=f."row" AND rv.col=f.col GROUP BY route_id, alt),
al AS (SELECT vq.route_id, bool_or(bu) AS ab, bool_or(u>=0.35) AS au, bool_or(avoid_water AND (beside_water OR vq.tile_id IN (SELECT tile_id FROM cells WHERE class=4))) AS aw, any_value(EXISTS (SELECT 1 FROM bl WHERE bl.route_id=vq.route_id)) AS ad FROM vq JOIN rv ON rv.tile_id=vq.tile_id GROUP BY vq.route_id),
fs AS (SELECT sc.*, array_to_string(list_filter([CASE WHEN ab AND NOT hb THEN 'building proximity' END, CASE WHEN ad THEN 'debris' END, CASE WHEN au AND NOT hu THEN 'prediction uncertainty' END, CASE WHEN aw AND NOT hw THEN 'water' END], lambda x: x IS NOT NULL), ',') AS avoided_hazards,
 round_even(distance_cells*wd+risk_score*wr+accessibility_score*wa,3) AS profile_score, round_even(distance_cells*1.2,1) AS travel_time_minutes FROM sc JOIN al USING (route_id) JOIN wt USING (profile)),
rn AS (SELECT *, row_number() OVER (PARTITION BY route_id ORDER BY profile_score, distance_cells, txt) AS place FROM fs)"""


@query("rt07_ranked_routes", f"""WITH RECURSIVE {_THREE}, {_ALTS} SELECT route_id, alt, profile, distance_cells, risk_score, accessibility_score, travel_time_minutes, avoided_hazards, profile_score FROM fs""")
def rt07(spark, sf_dir):
    out, _ = rt.ranked_routes(requests(spark, sf_dir), risky(spark, sf_dir), blocked(spark, sf_dir))
    return out.withColumn("avoided_hazards", F.array_join("avoided_hazards", ",")).drop("path", "path_text", "place", "selected")


@query("rt08_rank_alternatives", """
WITH e AS (SELECT user_id AS route_id, event_type AS path_text, round(avg(value),3) AS profile_score, count(*) AS distance_cells FROM events GROUP BY ALL)
SELECT *, row_number() OVER (PARTITION BY route_id ORDER BY profile_score, distance_cells, path_text) AS place, row_number() OVER (PARTITION BY route_id ORDER BY profile_score, distance_cells, path_text)=1 AS selected FROM e""")
def rt08(spark, sf_dir):
    """Event types of a user stand in for its alternatives."""
    e = fx.table(spark, sf_dir, "events").groupBy(F.col("user_id").alias("route_id"), F.col("event_type").alias("path_text")).agg(
        F.round(F.avg("value"), 3).alias("profile_score"), F.count(F.lit(1)).alias("distance_cells")
    )
    return rt.rank_alternatives(e)


@query("rt09_reroute_compare", f"""WITH RECURSIVE {_THREE}, {_ALTS}, b AS (SELECT route_id//2 AS t, * FROM rn WHERE place=1 AND route_id%2=0), h AS (SELECT route_id//2 AS t, * FROM rn WHERE place=1 AND route_id%2=1)
SELECT b.t AS route_id, b.distance_cells AS baseline_distance_cells, b.travel_time_minutes AS baseline_travel_time_minutes, b.risk_score AS baseline_risk_score, b.accessibility_score AS baseline_accessibility_score, b.profile_score AS baseline_profile_score,
 h.distance_cells AS hazard_distance_cells, h.travel_time_minutes AS hazard_travel_time_minutes, h.risk_score AS hazard_risk_score, h.accessibility_score AS hazard_accessibility_score, h.profile_score AS hazard_profile_score,
 h.t IS NOT NULL AS reachable, h.distance_cells-b.distance_cells AS extra_cells FROM b LEFT JOIN h USING (t)""")
def rt09(spark, sf_dir):
    """Both variants of every tile are searched together, then set side by side."""
    out, _ = rt.ranked_routes(requests(spark, sf_dir), risky(spark, sf_dir), blocked(spark, sf_dir))
    out = out.withColumn("_v", F.col("route_id") % 2).withColumn("route_id", F.floor(F.col("route_id") / 2))
    return rt.reroute_compare(out.where("_v = 0"), out.where("_v = 1"))


@query("rt10_route_to_scene", f"""SELECT tile_id AS route_id, event_id AS seq, greatest(0,least(255,floor("row"/31.0*255+0.5)))::INT AS "row", greatest(0,least(255,floor(col/31.0*255+0.5)))::INT AS col FROM cells WHERE class=5""")
def rt10(spark, sf_dir):
    c = fx.cells(spark, sf_dir).where(F.col("class") == 5)
    path = c.select(F.col("tile_id").alias("route_id"), F.col("event_id").alias("seq"), "row", "col")
    sizes = c.select(F.col("tile_id").alias("route_id")).distinct().withColumns({"route_size": F.lit(32), "scene_size": F.lit(256)})
    return rt.route_to_scene(path, sizes)


_ONE = f"""{_REQ}, {_PROB}, {_RISK}, {_W}, {_round_sql(0)}, {_ALTS.replace(" UNION ALL SELECT 1, * FROM fp1 UNION ALL SELECT 2, * FROM fp2", "")}"""
_BRIEF = (
    "briefType string, generatedAt string, origin struct<row int, column int>, destination struct<row int, column int>, gridSize int, profile string, "
    "distanceCells bigint, estimatedTravelTimeMinutes double, riskScore double, accessibilityScore double, avoidedHazards array<string>, "
    "hazards struct<waterCells bigint, waterBlockedRoadCells bigint, debrisCells bigint, blockedRoadCells bigint, waterAvoidance boolean>, "
    "prediction struct<semanticSource string, boundaryConfidence double, limitations array<string>>, route array<struct<row int, column int>>"
)


@query("rt11_route_brief", f"""WITH RECURSIVE {_ONE}, w AS (SELECT tile_id, count(*) FILTER (class=4) AS w FROM cells GROUP BY tile_id), b AS (SELECT tile_id, count(*) FILTER (beside_water) AS b FROM rd GROUP BY tile_id), d AS (SELECT route_id, count(*) AS d FROM bl GROUP BY route_id),
p AS (SELECT route_id, string_agg("row"||','||col, ';' ORDER BY seq) AS route FROM fp0 GROUP BY route_id), g AS (SELECT tile_id, max("row")+1 AS rs FROM cells GROUP BY tile_id)
SELECT route_id, 'evacuation-decision-support' AS brief_type, '2024-05-01T12:30:00.000Z' AS generated_at, start_row, start_col, dest_row, dest_col, rs::INT AS grid_size, f.profile, distance_cells::BIGINT AS distance, travel_time_minutes AS minutes, risk_score AS risk, accessibility_score AS access,
avoided_hazards AS avoided, CASE WHEN avoid_water THEN w ELSE 0 END AS water, CASE WHEN avoid_water THEN b ELSE 0 END AS water_roads, coalesce(d,0) AS debris, coalesce(d,0) AS blocked, avoid_water, 'trained' AS source, CASE WHEN tile_id%3>0 THEN 0.9::DOUBLE END AS confidence,
'{rt.LIMITS['always']} '||CASE WHEN tile_id%2=0 THEN '{rt.LIMITS['relative']}' ELSE '{rt.LIMITS['absolute']}' END||' {rt.LIMITS['trained']}' AS limitations, route
FROM fs f JOIN vq USING (route_id) JOIN w USING (tile_id) JOIN b USING (tile_id) JOIN g USING (tile_id) JOIN p USING (route_id) LEFT JOIN d USING (route_id)""")
def rt11(spark, sf_dir):
    """Every field of the brief, read back from its JSON text."""
    r, b, c = requests(spark, sf_dir), blocked(spark, sf_dir), risky(spark, sf_dir)
    ranked, _ = rt.ranked_routes(r, c, b, rounds=1)
    kinds = c.select("tile_id").distinct().select(
        "tile_id", F.when(F.col("tile_id") % 2 == 0, "relative").otherwise("absolute").alias("height_reference"),
        F.lit("trained").alias("semantic_source"), F.when(F.col("tile_id") % 3 > 0, 0.9).alias("boundary_confidence"),
    )
    at = F.timestamp_seconds(F.lit(1714566600))
    text = rt.route_brief(ranked, r, kinds, rt.hazard_counts(r, c, b), rt.grid_sizes(r, c), at)
    j = text.select("route_id", F.from_json("brief", _BRIEF).alias("j"))
    return j.select(
        "route_id", F.col("j.briefType").alias("brief_type"), F.col("j.generatedAt").alias("generated_at"),
        F.col("j.origin.row").alias("start_row"), F.col("j.origin.column").alias("start_col"), F.col("j.destination.row").alias("dest_row"),
        F.col("j.destination.column").alias("dest_col"), F.col("j.gridSize").alias("grid_size"), "j.profile", F.col("j.distanceCells").alias("distance"),
        F.col("j.estimatedTravelTimeMinutes").alias("minutes"), F.col("j.riskScore").alias("risk"), F.col("j.accessibilityScore").alias("access"),
        F.array_join("j.avoidedHazards", ",").alias("avoided"), F.col("j.hazards.waterCells").alias("water"),
        F.col("j.hazards.waterBlockedRoadCells").alias("water_roads"), F.col("j.hazards.debrisCells").alias("debris"),
        F.col("j.hazards.blockedRoadCells").alias("blocked"), F.col("j.hazards.waterAvoidance").alias("avoid_water"),
        F.col("j.prediction.semanticSource").alias("source"), F.col("j.prediction.boundaryConfidence").alias("confidence"),
        F.array_join("j.prediction.limitations", " ").alias("limitations"),
        F.array_join(F.transform("j.route", lambda p: F.concat_ws(",", p["row"].cast("string"), p["column"].cast("string"))), ";").alias("route"),
    )
