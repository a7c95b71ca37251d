"""Region queries (survey group 2.6)."""

from __future__ import annotations

from pyspark.sql import functions as F

from rastertab.functions.grid import tile_shape
from rastertab.operators import components as cc
from rastertab.operators import outlines, regions, rings, stencil, tiles
from rastertab.plans import fixtures as fx
from rastertab.plans.registry import quantile_sql, query, rounded
from rastertab.plans.stencil_queries import base_sql, green_sql, majority_sql, same_class_sql, smooth_sql, terrain_sql

_SH = 'sh AS (SELECT tile_id, max("row")+1 AS rs, max(col)+1 AS cs FROM cells GROUP BY tile_id)'
_BUILT = 'SELECT tile_id, "row", col FROM cells WHERE class=3'


def label_sql(name: str, mask: str) -> str:
    """Recursive CTE ``name`` with the least row-major code per 4-connected component of ``mask``."""
    return f"""{name}(tile_id, "row", col, component) USING KEY (tile_id, "row", col) AS (
SELECT tile_id, "row", col, "row"::BIGINT*4294967296+col FROM ({mask}) UNION
SELECT n.tile_id, n."row", n.col, min(c.component) FROM {name} c CROSS JOIN off4 o JOIN recurring.{name} n ON n.tile_id=c.tile_id AND n."row"=c."row"+o.dr AND n.col=c.col+o.dc
WHERE c.component<n.component GROUP BY n.tile_id, n."row", n.col)"""


def small_sql(src: str, p: str) -> str:
    """CTEs that remove small buildings of ``src``; the result is ``{p}_out``."""
    cond = f"n.tile_id=s.tile_id AND n.\"row\"=s.\"row\"+o.dr AND n.col=s.col+o.dc"
    return f"""{label_sql(p + '_lab', f'SELECT tile_id, "row", col FROM {src} WHERE class=3')},
{p}_small AS (SELECT l.* FROM {p}_lab l JOIN (SELECT tile_id, component FROM {p}_lab GROUP BY ALL HAVING count(*)<4) USING (tile_id, component)),
{p}_vote AS (SELECT s.tile_id, s.component, n.class, count(*) AS n FROM {p}_small s CROSS JOIN off8 o JOIN {src} n ON {cond} WHERE n.class<>3 GROUP BY ALL),
{p}_best AS (SELECT tile_id, component, first(class ORDER BY n DESC, class) AS new FROM {p}_vote GROUP BY ALL),
{p}_out AS (SELECT c.tile_id, c."row", c.col, CASE WHEN s.component IS NULL THEN c.class ELSE coalesce(b.new,1) END AS class, c.boundary FROM {src} c
 LEFT JOIN {p}_small s ON s.tile_id=c.tile_id AND s."row"=c."row" AND s.col=c.col LEFT JOIN {p}_best b ON b.tile_id=s.tile_id AND b.component=s.component)"""


def holes_sql(src: str, p: str) -> str:
    return f"""{label_sql(p + '_lab', f'SELECT tile_id, "row", col FROM {src} WHERE class<>3')},
{p}_small AS (SELECT l.* FROM {p}_lab l JOIN (SELECT tile_id, component FROM {p}_lab GROUP BY ALL HAVING count(*)<=4) USING (tile_id, component)),
{p}_sh AS (SELECT tile_id, max("row") AS mr, max(col) AS mc FROM {src} GROUP BY tile_id),
{p}_bad AS (SELECT tile_id, component FROM {p}_small JOIN {p}_sh USING (tile_id) WHERE "row" IN (0, mr) OR col IN (0, mc)
 UNION SELECT s.tile_id, s.component FROM {p}_small s JOIN {src} c ON c.tile_id=s.tile_id AND c."row"=s."row" AND c.col=s.col WHERE c.boundary>=0.65
 UNION SELECT s.tile_id, s.component FROM {p}_small s CROSS JOIN off8 o JOIN {p}_lab n ON n.tile_id=s.tile_id AND n."row"=s."row"+o.dr AND n.col=s.col+o.dc WHERE n.component<>s.component),
{p}_fill AS (SELECT s.tile_id, s."row", s.col FROM {p}_small s WHERE NOT EXISTS (SELECT 1 FROM {p}_bad b WHERE b.tile_id=s.tile_id AND b.component=s.component)),
{p}_out AS (SELECT c.tile_id, c."row", c.col, CASE WHEN f.tile_id IS NULL THEN c.class ELSE 3 END AS class, c.boundary FROM {src} c LEFT JOIN {p}_fill f ON f.tile_id=c.tile_id AND f."row"=c."row" AND f.col=c.col)"""


def clean_sql(src: str, p: str) -> str:
    return f"{p}_m AS ({majority_sql(src)}), {small_sql(p + '_m', p + '_s')}, {holes_sql(p + '_s_out', p + '_h')}"


def _labels(spark, sf_dir):
    return fx.cells(spark, sf_dir).select("tile_id", "row", "col", "class", "boundary")


def _built(spark, sf_dir):
    return cc.components(fx.cells(spark, sf_dir).where(F.col("class") == 3))


@query("rg01_components", f"WITH RECURSIVE {label_sql('lab', _BUILT)} SELECT * FROM lab")
def rg01(spark, sf_dir):
    return _built(spark, sf_dir)


@query("rg01_components_across_blocks", f"""WITH RECURSIVE {label_sql('lab', 'SELECT tile_id, "row", col FROM cells WHERE class<>3')} SELECT * FROM lab""")
def rg01b(spark, sf_dir):
    """Small blocks, so that every large component is merged over seams."""
    return cc.components(fx.cells(spark, sf_dir).where(F.col("class") != 3), block=8)


_MASK = f"""q0 AS (SELECT tile_id, min(height) AS mn, max(height) AS mx FROM cells GROUP BY tile_id),
q1 AS (SELECT tile_id, greatest({quantile_sql("height", 0.72)}, any_value(mx)*0.2, 0.75) AS th FROM cells JOIN q0 USING (tile_id) WHERE height>greatest(mn,1e-3) GROUP BY tile_id),
tm AS (SELECT tile_id, "row", col FROM cells JOIN q1 USING (tile_id) WHERE height>=th)"""


@query("rg02_threshold_mask", f"WITH {_MASK} SELECT * FROM tm")
def rg02(spark, sf_dir):
    return regions.threshold_mask(fx.cells(spark, sf_dir)).select("tile_id", "row", "col")


_CLS = 'tile_id, "row", col, class'


@query("rg03_drop_small_buildings", f"WITH RECURSIVE {small_sql('cells', 's')} SELECT {_CLS} FROM s_out")
def rg03(spark, sf_dir):
    return regions.drop_small_buildings(_labels(spark, sf_dir)).drop("boundary")


@query("rg04_fill_small_holes", f"WITH RECURSIVE {holes_sql('cells', 'h')} SELECT {_CLS} FROM h_out")
def rg04(spark, sf_dir):
    return regions.fill_small_holes(_labels(spark, sf_dir)).drop("boundary")


@query("rg05_clean_labels", f"WITH RECURSIVE {clean_sql('cells', 'c')} SELECT {_CLS} FROM c_h_out")
def rg05(spark, sf_dir):
    return regions.clean_labels(_labels(spark, sf_dir)).drop("boundary")


_SCALED_LOGITS = """rs AS (SELECT l.tile_id, l.class, t.i AS "row", u.i AS col, sum(logit*greatest(0,1-abs((l."row"+0.5)-(t.i+0.5)*0.5))*greatest(0,1-abs((l.col+0.5)-(u.i+0.5)*0.5))) /
 sum(greatest(0,1-abs((l."row"+0.5)-(t.i+0.5)*0.5))*greatest(0,1-abs((l.col+0.5)-(u.i+0.5)*0.5))) AS logit FROM logits l CROSS JOIN (SELECT unnest(range(6))::INT AS i) t CROSS JOIN (SELECT unnest(range(6))::INT AS i) u GROUP BY ALL),
am AS (SELECT tile_id, "row", col, first(class ORDER BY logit DESC, class) AS class, 0.0 AS boundary FROM rs GROUP BY tile_id, "row", col)"""


@query("tl11_scene_labels", f"WITH RECURSIVE {_SCALED_LOGITS}, {clean_sql('am', 'c')} SELECT {_CLS} FROM c_h_out")
def tl11(spark, sf_dir):
    return tiles.scene_labels(fx.logits(spark, sf_dir), 6)


def seam_sql(frac: str) -> str:
    return f"""sm AS (SELECT c.tile_id, c."row", c.col, c.class=3 AS b, c.class=3 AND c.boundary>=0.65 AND ((coalesce(l.class=3,false) AND coalesce(r.class=3,false)) OR (coalesce(u.class=3,false) AND coalesce(d.class=3,false))) AS seam FROM cells c
 LEFT JOIN cells l ON l.tile_id=c.tile_id AND l."row"=c."row" AND l.col=c.col-1 LEFT JOIN cells r ON r.tile_id=c.tile_id AND r."row"=c."row" AND r.col=c.col+1
 LEFT JOIN cells u ON u.tile_id=c.tile_id AND u.col=c.col AND u."row"=c."row"-1 LEFT JOIN cells d ON d.tile_id=c.tile_id AND d.col=c.col AND d."row"=c."row"+1),
sf AS (SELECT tile_id, count(*) FILTER (seam)::DOUBLE/greatest(count(*) FILTER (b),1)<={frac} AS cut FROM sm GROUP BY tile_id),
bm AS (SELECT tile_id, "row", col, b AND NOT (seam AND cut) AS building FROM sm JOIN sf USING (tile_id))"""


@query("rg06_split_on_seams", f"WITH {seam_sql('0.25')} SELECT * FROM bm")
def rg06(spark, sf_dir):
    """The fixture's boundary is dense noise, so the allowed share is raised to let seams be cut."""
    return regions.split_on_seams(fx.cells(spark, sf_dir), max_fraction=0.25).select("tile_id", "row", "col", "building")


def parts_sql(mask: str) -> str:
    """CTEs of every building statistic for the cells selected by ``mask``."""
    return f"""{label_sql('lab', mask)}, {_SH},
pc AS (SELECT l.*, c.height, c.class FROM lab l JOIN cells c USING (tile_id, "row", col)),
bx AS (SELECT tile_id, component, count(*) AS area, min("row") AS r0, max("row") AS r1, min(col) AS c0, max(col) AS c1 FROM pc GROUP BY ALL),
gs AS (SELECT p.tile_id, p.component, n.height, n.class FROM lab p CROSS JOIN off8 o JOIN cells n ON n.tile_id=p.tile_id AND n."row"=p."row"+o.dr AND n.col=p.col+o.dc
 WHERE NOT EXISTS (SELECT 1 FROM lab x WHERE x.tile_id=n.tile_id AND x."row"=n."row" AND x.col=n.col AND x.component=p.component)),
gh AS (SELECT tile_id, component, coalesce(median(height) FILTER (class=0), median(height)) AS g FROM gs GROUP BY ALL),
rr AS (SELECT p.*, sqrt(((p."row"-(r0+r1)/2.0)/(greatest(r1-r0,1)/2.0))^2 + ((p.col-(c0+c1)/2.0)/(greatest(c1-c0,1)/2.0))^2) AS r FROM pc p JOIN bx USING (tile_id, component)),
st AS (SELECT tile_id, component, quantile_cont(height,0.1) AS p10, quantile_cont(height,0.9) AS p90, median(height) FILTER (r<0.38) AS m0, median(height) FILTER (r>=0.38 AND r<0.85) AS m1, median(height) FILTER (r>=0.85) AS m2,
 var_pop(r) AS s11, var_pop(r*r) AS s22, covar_pop(r,r*r) AS s12, covar_pop(r,height) AS s1v, covar_pop(r*r,height) AS s2v, var_pop(height) AS svv FROM rr GROUP BY ALL),
rv AS (SELECT tile_id, component, max(m)-min(m) AS rv FROM (SELECT tile_id, component, "row", median(height) AS m FROM pc GROUP BY ALL) GROUP BY ALL),
cv AS (SELECT tile_id, component, max(m)-min(m) AS cv FROM (SELECT tile_id, component, col, median(height) AS m FROM pc GROUP BY ALL) GROUP BY ALL),
fit AS (SELECT *, svv-CASE WHEN s11=0 THEN 0 ELSE s1v*s1v/s11 END AS lin, s11*s22-s12*s12 AS det FROM st JOIN rv USING (tile_id, component) JOIN cv USING (tile_id, component)),
rt AS (SELECT tile_id, component, p10, p90, CASE WHEN p90-p10<=greatest(0.8, greatest(p90,1)*0.06) THEN 'flat' WHEN greatest(rv,cv)>0 AND least(rv,cv)<greatest(rv,cv)*0.55 THEN 'gabled'
 WHEN (m0-m1>=0 AND m1-m2>0 AND (m0-m1)/nullif(m1-m2,0)<0.9) OR (lin>1e-9 AND (CASE WHEN det>1e-12*s11*s22 THEN svv-(s1v*s1v*s22-2*s1v*s2v*s12+s2v*s2v*s11)/det ELSE lin END)<lin*0.45) THEN 'dome' ELSE 'hipped' END AS roof_type FROM fit),
bh AS (SELECT *, CASE WHEN roof_type='flat' THEN 0 ELSE greatest(height*0.28,0.05) END AS roof_rise FROM (SELECT b.tile_id, b.component, area, coalesce(g,0) AS ground_height, p90 AS roof_height, greatest(p90-coalesce(g,0),0.05) AS height, roof_type
 FROM bx b JOIN rt USING (tile_id, component) LEFT JOIN gh USING (tile_id, component) WHERE NOT (area=1 AND p90-coalesce(g,0)<greatest(0.5,abs(coalesce(g,0))*0.25)))),
sd AS (SELECT * FROM (VALUES ('u',-1,0,0,0,1,0),('r',0,1,1,0,1,1),('d',1,0,1,1,0,1),('l',0,-1,0,1,0,0)) v(s,dr,dc,ax,ay,zx,zy)),
eg AS (SELECT l.tile_id, l.component, (l.col+ax)::INT AS x1, (l."row"+ay)::INT AS y1, (l.col+zx)::INT AS x2, (l."row"+zy)::INT AS y2 FROM lab l CROSS JOIN sd LEFT JOIN lab n ON n.tile_id=l.tile_id AND n."row"=l."row"+dr AND n.col=l.col+dc WHERE n.component IS DISTINCT FROM l.component),
pt(tile_id, component, p, ring) USING KEY (tile_id, component, p) AS (SELECT DISTINCT tile_id, component, y1::BIGINT*4294967296+x1, y1::BIGINT*4294967296+x1 FROM eg UNION
 SELECT n.tile_id, n.component, n.p, min(c.ring) FROM pt c JOIN (SELECT tile_id, component, y1::BIGINT*4294967296+x1 AS a, y2::BIGINT*4294967296+x2 AS b FROM eg UNION ALL SELECT tile_id, component, y2::BIGINT*4294967296+x2, y1::BIGINT*4294967296+x1 FROM eg) e
 ON e.tile_id=c.tile_id AND e.component=c.component AND e.a=c.p JOIN recurring.pt n ON n.tile_id=e.tile_id AND n.component=e.component AND n.p=e.b WHERE c.ring<n.ring GROUP BY n.tile_id, n.component, n.p),
er AS (SELECT e.*, ring FROM eg e JOIN pt ON pt.tile_id=e.tile_id AND pt.component=e.component AND pt.p=e.y1::BIGINT*4294967296+e.x1),
tn AS (SELECT tile_id, component, ring, x, y, CASE WHEN count(o)>1 THEN count(o) ELSE (max(o)<>max(i))::INT END AS corners FROM (SELECT tile_id, component, ring, x1 AS x, y1 AS y, (x2-x1)||','||(y2-y1) AS o, NULL AS i FROM er UNION ALL SELECT tile_id, component, ring, x2, y2, NULL, (x2-x1)||','||(y2-y1) FROM er) GROUP BY ALL),
rg AS (SELECT e.tile_id, e.component, e.ring, count(*) AS edges, sum(x1*y2-x2*y1)/2.0 AS area FROM er e GROUP BY ALL),
ri AS (SELECT rg.*, corners::BIGINT AS corners, rg.ring<>first(rg.ring) OVER (PARTITION BY rg.tile_id, rg.component ORDER BY abs(area) DESC, rg.ring) AS is_hole FROM rg JOIN (SELECT tile_id, component, ring, sum(corners) AS corners FROM tn GROUP BY ALL) k USING (tile_id, component, ring))"""


_PARTS = parts_sql(_BUILT)
_BOX = """tile_id, component, area, r0 AS min_row, r1 AS max_row, c0 AS min_col, c1 AS max_col, round((c0+c1+1)/2.0/cs-0.5,6) AS center_x, round((r0+r1+1)/2.0/rs-0.5,6) AS center_z,
round((c1-c0+1)/cs::DOUBLE,6) AS width, round((r1-r0+1)/rs::DOUBLE,6) AS depth"""


@query("rg07_building_boxes", f"WITH RECURSIVE {_PARTS} SELECT {_BOX} FROM bx JOIN sh USING (tile_id)")
def rg07(spark, sf_dir):
    return rounded(regions.building_boxes(_built(spark, sf_dir), tile_shape(fx.cells(spark, sf_dir))))


@query("rg08_ground_height", f"WITH RECURSIVE {_PARTS} SELECT tile_id, component, round(coalesce(g,0),6) AS ground_height FROM bx LEFT JOIN gh USING (tile_id, component)")
def rg08(spark, sf_dir):
    return rounded(regions.ground_height(_built(spark, sf_dir), fx.cells(spark, sf_dir)))


@query("rg09_building_heights", f"""WITH RECURSIVE {_PARTS} SELECT tile_id, component, area, round(ground_height,6) AS ground_height, round(roof_height,6) AS roof_height, round(height,6) AS height, roof_type,
round(height-roof_rise,6) AS wall_height, round(roof_rise,6) AS roof_rise FROM bh""")
def rg09(spark, sf_dir):
    return rounded(regions.building_heights(_built(spark, sf_dir), fx.cells(spark, sf_dir)))


@query("rg10_roof_type", f"WITH RECURSIVE {_PARTS} SELECT tile_id, component, roof_type FROM rt")
def rg10(spark, sf_dir):
    return regions.roof_type(_built(spark, sf_dir), fx.cells(spark, sf_dir))


@query("rg11_outline_edges", f"WITH RECURSIVE {_PARTS} SELECT * FROM eg")
def rg11(spark, sf_dir):
    return outlines.outline_edges(_built(spark, sf_dir))


@query("rg12_outline_rings", f"WITH RECURSIVE {_PARTS} SELECT tile_id, component, ring, edges, area, corners, is_hole FROM ri")
def rg12(spark, sf_dir):
    return outlines.outline_rings(outlines.outline_edges(_built(spark, sf_dir)))


@query("rg12_outline_rings_across_blocks", f"WITH RECURSIVE {_PARTS} SELECT tile_id, component, ring, edges, area, corners, is_hole FROM ri")
def rg12b(spark, sf_dir):
    return outlines.outline_rings(outlines.outline_edges(_built(spark, sf_dir)), block=4)


def _polygons(spark, sf_dir):
    """A quadrilateral and two triangles per embedding vector, in normalised coordinates."""
    e = fx.table(spark, sf_dir, "embeddings")
    at = lambda i: F.col("embedding")[i].cast("double") / 10.0
    ring = lambda r, s, n: F.struct(
        F.lit(r).alias("ring"),
        F.array(*[F.struct(at(s + 2 * i).alias("x"), at(s + 2 * i + 1).alias("z")) for i in range(n)]).alias("points"),
    )
    return e.select(
        F.col("vec_id").alias("tile_id"), F.lit(0).alias("region"), F.inline(F.array(ring(0, 0, 4), ring(1, 8, 3), ring(2, 14, 3)))
    )


def _seg_sql() -> str:
    rows = []
    for ring, start, n in ((0, 0, 4), (1, 8, 3), (2, 14, 3)):
        for i in range(n):
            j = (i + 1) % n
            a, b = start + 2 * i + 1, start + 2 * j + 1
            rows.append(f"SELECT vec_id AS tile_id, {ring} AS ring, {n} AS n, {i} AS seq, embedding[{a}]::DOUBLE/10 AS x1, embedding[{a + 1}]::DOUBLE/10 AS z1, embedding[{b}]::DOUBLE/10 AS x2, embedding[{b + 1}]::DOUBLE/10 AS z2 FROM embeddings")
    return "sg AS (" + " UNION ALL ".join(rows) + ")"


@query("rg13_points_in_polygons", f"""
WITH {_seg_sql()}, p AS (SELECT vec_id AS tile_id, i AS point_id, embedding[21+2*i]::DOUBLE/10 AS x, embedding[22+2*i]::DOUBLE/10 AS z FROM embeddings, (SELECT unnest(range(20))::INT AS i)),
h AS (SELECT p.tile_id, p.point_id, count(*) AS n FROM p JOIN sg s ON s.tile_id=p.tile_id AND (s.z1>p.z)<>(s.z2>p.z) WHERE p.x < (s.x1-s.x2)*(p.z-s.z2)/(s.z1-s.z2)+s.x2 GROUP BY ALL)
SELECT tile_id, point_id, 0 AS region FROM h WHERE n%2=1""")
def rg13(spark, sf_dir):
    edges = outlines.polygon_edges(_polygons(spark, sf_dir))
    at = lambda i: F.col("embedding")[i].cast("double") / 10.0
    points = fx.table(spark, sf_dir, "embeddings").select(
        F.col("vec_id").alias("tile_id"),
        F.inline(F.array(*[F.struct(F.lit(i).alias("point_id"), at(20 + 2 * i).alias("x"), at(21 + 2 * i).alias("z")) for i in range(20)])),
    )
    return outlines.points_in_polygons(points, edges)




_SIDES = "(x2-x1)*(v1-z1)-(z2-z1)*(u1-x1) AS s1, (x2-x1)*(v2-z1)-(z2-z1)*(u2-x1) AS s2, (u2-u1)*(z1-v1)-(v2-v1)*(x1-u1) AS s3, (u2-u1)*(z2-v1)-(v2-v1)*(x2-u1) AS s4"
_MEET = """((s1>1e-9 AND s2<-1e-9) OR (s1<-1e-9 AND s2>1e-9)) AND ((s3>1e-9 AND s4<-1e-9) OR (s3<-1e-9 AND s4>1e-9))
 OR (abs(s1)<=1e-9 AND u1 BETWEEN least(x1,x2)-1e-9 AND greatest(x1,x2)+1e-9 AND v1 BETWEEN least(z1,z2)-1e-9 AND greatest(z1,z2)+1e-9)
 OR (abs(s2)<=1e-9 AND u2 BETWEEN least(x1,x2)-1e-9 AND greatest(x1,x2)+1e-9 AND v2 BETWEEN least(z1,z2)-1e-9 AND greatest(z1,z2)+1e-9)
 OR (abs(s3)<=1e-9 AND x1 BETWEEN least(u1,u2)-1e-9 AND greatest(u1,u2)+1e-9 AND z1 BETWEEN least(v1,v2)-1e-9 AND greatest(v1,v2)+1e-9)
 OR (abs(s4)<=1e-9 AND x2 BETWEEN least(u1,u2)-1e-9 AND greatest(u1,u2)+1e-9 AND z2 BETWEEN least(v1,v2)-1e-9 AND greatest(v1,v2)+1e-9)"""


@query("rg14_segment_crossings", f"""
WITH {_seg_sql()}, pr AS (SELECT a.*, b.ring AS o_ring, b.seq AS o_seq, b.x1 AS u1, b.z1 AS v1, b.x2 AS u2, b.z2 AS v2 FROM sg a JOIN sg b ON a.tile_id=b.tile_id AND (a.ring<b.ring OR (a.ring=b.ring AND a.seq<b.seq))
 WHERE NOT (a.ring=b.ring AND (b.seq-a.seq=1 OR b.seq-a.seq=a.n-1))),
o AS (SELECT *, {_SIDES} FROM pr)
SELECT tile_id, 0 AS region, ring, seq, o_ring, o_seq FROM o WHERE {_MEET}""")
def rg14(spark, sf_dir):
    return outlines.segment_crossings(outlines.polygon_edges(_polygons(spark, sf_dir)))


def hole_polygons(spark, sf_dir):
    """A square outer ring and four small triangles per embedding vector."""
    e = fx.table(spark, sf_dir, "embeddings")
    at = lambda i: F.col("embedding")[i].cast("double")
    p = lambda x, z: F.struct(x.alias("x"), z.alias("z"))
    half = F.lit(0.1) + F.abs(at(0)) / 10.0
    square = F.array(p(-half, -half), p(half, -half), p(half, half), p(-half, half))
    rings = [F.struct(F.lit(0).alias("ring"), square.alias("points"))]
    for r in range(1, 5):
        x, z, s = at(4 * r) / 10.0, at(4 * r + 1) / 10.0, F.lit(0.01) + F.abs(at(4 * r + 2)) / 10.0
        rings.append(F.struct(F.lit(r).alias("ring"), F.array(p(x, z), p(x + s, z), p(x + s / 3, z + s)).alias("points")))
    return e.select(F.col("vec_id").alias("tile_id"), F.lit(0).alias("region"), F.inline(F.array(*rings)))


def _hole_sql() -> str:
    """Segments of hole_polygons, as pieces (ring, n, seq, x1, z1, x2, z2)."""
    e = lambda i: f"embedding[{i + 1}]::DOUBLE"
    half = f"(0.1+abs({e(0)})/10)"
    rings = {0: [(f"-{half}", f"-{half}"), (half, f"-{half}"), (half, half), (f"-{half}", half)]}
    for r in range(1, 5):
        x, z, s = f"{e(4 * r)}/10", f"{e(4 * r + 1)}/10", f"(0.01+abs({e(4 * r + 2)})/10)"
        rings[r] = [(x, z), (f"{x}+{s}", z), (f"{x}+{s}/3", f"{z}+{s}")]
    rows = []
    for r, points in rings.items():
        for i, (a, b) in enumerate(zip(points, [*points[1:], points[0]])):
            rows.append(f"SELECT vec_id AS tile_id, {r} AS ring, {len(points)} AS n, {i} AS seq, {a[0]} AS x1, {a[1]} AS z1, {b[0]} AS x2, {b[1]} AS z2 FROM embeddings")
    return "sg AS (" + " UNION ALL ".join(rows) + ")"


@query("rg15_safe_holes", f"""WITH RECURSIVE {_hole_sql()},
pr AS (SELECT a.*, b.ring AS o_ring, b.seq AS o_seq, b.x1 AS u1, b.z1 AS v1, b.x2 AS u2, b.z2 AS v2 FROM sg a JOIN sg b ON a.tile_id=b.tile_id AND (a.ring<b.ring OR (a.ring=b.ring AND a.seq<b.seq)) WHERE NOT (a.ring=b.ring AND (b.seq-a.seq=1 OR b.seq-a.seq=a.n-1))),
o AS (SELECT *, {_SIDES} FROM pr), mt AS (SELECT DISTINCT tile_id, ring, o_ring FROM o WHERE {_MEET}),
bad AS (SELECT tile_id, ring FROM mt WHERE ring=o_ring UNION SELECT tile_id, o_ring FROM mt WHERE ring=0),
ar AS (SELECT tile_id, ring, abs(sum(x1*z2-x2*z1)/2) AS area FROM sg WHERE ring>0 GROUP BY ALL),
ins AS (SELECT p.tile_id, p.ring FROM sg p JOIN sg s ON s.tile_id=p.tile_id AND s.ring=0 AND (s.z1>p.z1)<>(s.z2>p.z1) WHERE p.ring>0 AND p.seq=0 AND p.x1 < (s.x1-s.x2)*(p.z1-s.z2)/(s.z1-s.z2)+s.x2 GROUP BY ALL HAVING count(*)%2=1),
cd AS (SELECT ar.*, row_number() OVER (PARTITION BY tile_id ORDER BY area DESC, ring) AS k FROM ar JOIN ins USING (tile_id, ring) ANTI JOIN bad USING (tile_id, ring)),
cf AS (SELECT tile_id, ring, list(o_ring) AS foes FROM (SELECT tile_id, ring, o_ring FROM mt UNION ALL SELECT tile_id, o_ring, ring FROM mt) GROUP BY ALL),
rk AS (SELECT cd.*, coalesce(foes, []) AS foes FROM cd LEFT JOIN cf USING (tile_id, ring)),
go(tile_id, k, acc) AS (SELECT DISTINCT tile_id, 0::BIGINT, []::INT[] FROM cd UNION ALL SELECT g.tile_id, r.k, CASE WHEN list_has_any(acc, foes) THEN acc ELSE list_append(acc, r.ring) END FROM go g JOIN rk r ON r.tile_id=g.tile_id AND r.k=g.k+1)
SELECT tile_id, 0 AS region, ring, round(area,6) AS area FROM cd JOIN (SELECT tile_id, unnest(last(acc ORDER BY k)) AS ring FROM go GROUP BY tile_id) USING (tile_id, ring)""")
def rg15(spark, sf_dir):
    return rounded(outlines.safe_holes(outlines.polygon_edges(hole_polygons(spark, sf_dir))))


@query("rg16_buildings", f"""WITH RECURSIVE {seam_sql('0.04')}, {parts_sql('SELECT tile_id, "row", col FROM bm WHERE building')},
ol AS (SELECT tile_id, component, count(*) FILTER (is_hole) AS holes, (sum(corners) FILTER (NOT is_hole))::BIGINT AS corners FROM ri GROUP BY ALL)
SELECT {_BOX}, round(ground_height,4) AS ground_height, round(roof_height,4) AS roof_height, round(height,4) AS height, roof_type, round(height-roof_rise,4) AS wall_height, round(roof_rise,4) AS roof_rise,
holes, corners, 'semantic_head' AS source FROM bh JOIN (SELECT * EXCLUDE (area) FROM bx) USING (tile_id, component) JOIN ol USING (tile_id, component) JOIN sh USING (tile_id)""")
def rg16(spark, sf_dir):
    return rounded(regions.buildings(fx.cells(spark, sf_dir)))


def ring_sql() -> str:
    """CTEs after parts_sql: successor edges nx, walks from each ring's leftmost-topmost corner, corners rv."""
    return """ed AS (SELECT *, CASE WHEN x2>x1 THEN 0 WHEN y2>y1 THEN 1 WHEN x2<x1 THEN 2 ELSE 3 END AS d, x2::BIGINT*4294967296+y2 AS code FROM eg),
nx AS (SELECT e.*, n.d AS nd FROM ed e JOIN ed n ON n.tile_id=e.tile_id AND n.component=e.component AND n.x1=e.x2 AND n.y1=e.y2
 QUALIFY row_number() OVER (PARTITION BY e.tile_id, e.component, e.x1, e.y1, e.d ORDER BY (n.d<>(e.d+3)%4)::INT)=1),
wl(tile_id, component, ring, sx, sy, sd, n, x1, y1, x2, y2, d, nd) AS (SELECT tile_id, component, code, x1, y1, d, 0, x1, y1, x2, y2, d, nd FROM nx WHERE nd<>d
 UNION ALL SELECT w.tile_id, w.component, w.ring, sx, sy, sd, n+1, e.x1, e.y1, e.x2, e.y2, e.d, e.nd FROM wl w JOIN nx e ON e.tile_id=w.tile_id AND e.component=w.component AND e.x1=w.x2 AND e.y1=w.y2 AND e.d=w.nd
 WHERE NOT (e.x1=sx AND e.y1=sy AND e.d=sd) AND (e.nd=e.d OR e.code>w.ring)),
cl AS (SELECT w.tile_id, w.component, ring, sx, sy, sd, sum(w.x1::BIGINT*w.y2-w.x2::BIGINT*w.y1)/2.0 AS area FROM wl w GROUP BY w.tile_id, w.component, ring, sx, sy, sd HAVING bool_or(EXISTS (SELECT 1 FROM nx e WHERE e.tile_id=w.tile_id AND e.component=w.component AND e.x1=w.x2 AND e.y1=w.y2 AND e.d=w.nd AND e.x1=w.sx AND e.y1=w.sy AND e.d=w.sd))),
oc AS (SELECT tile_id, component, first(ring ORDER BY abs(area) DESC, ring) AS outer_ring FROM cl GROUP BY ALL),
rc AS (SELECT w.tile_id, w.component, w.ring, row_number() OVER (PARTITION BY w.tile_id, w.component, w.ring ORDER BY n)-1 AS seq, x2 AS x, y2 AS y FROM wl w JOIN cl USING (tile_id, component, ring, sx, sy, sd) WHERE w.nd<>w.d)"""


_CORNERS = "SELECT rc.tile_id, rc.component, ring, ring<>outer_ring AS is_hole, seq, x, y FROM rc JOIN oc USING (tile_id, component)"


@query("rg12_ring_vertices", f"WITH RECURSIVE {_PARTS}, {ring_sql()} {_CORNERS}")
def rg12c(spark, sf_dir):
    return rings.ring_vertices(outlines.outline_edges(_built(spark, sf_dir)))


@query("rg12_ring_vertices_across_blocks", f"WITH RECURSIVE {_PARTS}, {ring_sql()} {_CORNERS}")
def rg12d(spark, sf_dir):
    return rings.ring_vertices(outlines.outline_edges(_built(spark, sf_dir)), block=2)


@query("rg16_footprints", f"""WITH RECURSIVE {seam_sql('0.04')}, {parts_sql('SELECT tile_id, "row", col FROM bm WHERE building')}, {ring_sql()}
SELECT rc.tile_id, rc.component, ring, ring<>outer_ring AS is_hole, seq, round(x/cs::DOUBLE-0.5,6) AS x, round(y/rs::DOUBLE-0.5,6) AS z FROM rc JOIN oc USING (tile_id, component) JOIN sh USING (tile_id)""")
def rg16c(spark, sf_dir):
    return regions.building_footprints(fx.cells(spark, sf_dir))


@query("rg16_buildings_from_heights", f"""WITH RECURSIVE {_MASK}, {label_sql('lab', 'SELECT * FROM tm')} SELECT tile_id, component, count(*) AS area FROM lab GROUP BY ALL HAVING count(*)>=4""")
def rg16b(spark, sf_dir):
    """Areas only: the statistics are those of rg16."""
    c = fx.cells(spark, sf_dir).drop("boundary")
    return regions.buildings(c, "height_threshold_fallback", min_area=4).select("tile_id", "component", "area")


@query("rg17_threshold_regions", f"""WITH RECURSIVE {_SH}, tp AS (SELECT tile_id, max(height) AS mx FROM cells GROUP BY tile_id),
{label_sql('lab', 'SELECT c.tile_id, c."row", c.col FROM cells c JOIN tp USING (tile_id) WHERE height>=greatest(mx*0.62,1)')},
s AS (SELECT tile_id, component, count(*) AS area, avg(height) AS h, min("row") AS r0, max("row") AS r1, min(col) AS c0, max(col) AS c1 FROM lab JOIN cells USING (tile_id,"row",col) GROUP BY ALL)
SELECT tile_id, component, area, round((c0+c1)/2.0/(cs-1)-0.5,6) AS center_x, round((r0+r1)/2.0/(rs-1)-0.5,6) AS center_z, round(greatest((c1-c0+1)/cs::DOUBLE,0.02),6) AS width, round(greatest((r1-r0+1)/rs::DOUBLE,0.02),6) AS depth,
round(greatest(h,mx*0.18),6) AS height, round(c0/cs::DOUBLE-0.5,6) AS x0, round(r0/rs::DOUBLE-0.5,6) AS z0, round((c1+1)/cs::DOUBLE-0.5,6) AS x1, round((r1+1)/rs::DOUBLE-0.5,6) AS z1 FROM s JOIN sh USING (tile_id) JOIN tp USING (tile_id)""")
def rg17(spark, sf_dir):
    """Peaks of the fixture are single cells, so the area limit is set to one."""
    return rounded(regions.threshold_regions(fx.cells(spark, sf_dir), min_area=1))


@query("rg18_flatten_roofs", f"""WITH RECURSIVE {label_sql('lab', _BUILT)}, m AS (SELECT tile_id, component, median(height) AS m FROM lab JOIN cells USING (tile_id,"row",col) GROUP BY ALL)
SELECT c.tile_id, c."row", c.col, round(coalesce(m, c.height),6) AS height FROM cells c LEFT JOIN lab USING (tile_id,"row",col) LEFT JOIN m USING (tile_id, component)""")
def rg18(spark, sf_dir):
    return rounded(regions.flatten_roofs(fx.cells(spark, sf_dir).select("tile_id", "row", "col", "height", "class")).drop("class"))


def _footprints(spark, sf_dir):
    p = _polygons(spark, sf_dir).where(F.col("ring") == 0)
    v = F.col("tile_id")
    return p.select(
        "tile_id", "region",
        F.when(v % 11 == 0, F.slice("points", 1, 2)).otherwise(F.col("points")).alias("points"),
        F.when(v % 5 == 0, float("nan")).otherwise(v / 10.0).alias("wall_height"),
        F.when(v % 25 == 0, float("nan")).otherwise(v / 7.0 - 3).alias("height"),
    )


_TURN = "((x{b}-x{a})*(z{c}-z{b})-(z{b}-z{a})*(x{c}-x{b}))"
_FOUR = [_TURN.format(a=a, b=(a + 1) % 4, c=(a + 2) % 4) for a in range(4)]
_TWO = [_TURN.format(a=a, b=(a + 1) % 2, c=a) for a in range(2)]


@query("rg19_polygon_checks", f"""
WITH p AS (SELECT vec_id AS v, {", ".join(f"embedding[{2 * i + 1}]::DOUBLE/10 AS x{i}, embedding[{2 * i + 2}]::DOUBLE/10 AS z{i}" for i in range(4))} FROM embeddings),
t AS (SELECT v, CASE WHEN v%11=0 THEN [{", ".join(_TWO)}] ELSE [{", ".join(_FOUR)}] END AS ts FROM p),
s AS (SELECT v, list_distinct(list_transform(list_filter(ts, lambda x: abs(x)>=1e-8), lambda x: sign(x))) AS sg FROM t)
SELECT v AS tile_id, 0 AS region, v%11<>0 AS valid, len(sg)=1 AS convex, round(CASE WHEN v%5<>0 THEN greatest(v/10.0,0) WHEN v%25<>0 THEN greatest(v/7.0-3,0) ELSE 0.05 END,6) AS safe_height FROM s""")
def rg19(spark, sf_dir):
    return rounded(outlines.polygon_checks(_footprints(spark, sf_dir)))


_LVL = "CASE WHEN sqrt(cx*cx+cz*cz)<=0.36 THEN 'lod2' WHEN sqrt(cx*cx+cz*cz)<=0.74 THEN 'lod1' ELSE 'distant' END"
_RATED = f"lv AS (SELECT *, {_LVL} AS detail_level FROM (SELECT *, (c0+c1+1)/2.0/cs-0.5 AS cx, (r0+r1+1)/2.0/rs-0.5 AS cz FROM bx JOIN sh USING (tile_id)))"


@query("rg20_detail_level", f"WITH RECURSIVE {_PARTS}, {_RATED} SELECT tile_id, component, detail_level, 8 AS vertices FROM lv")
def rg20(spark, sf_dir):
    boxes = regions.building_boxes(_built(spark, sf_dir), tile_shape(fx.cells(spark, sf_dir)))
    return regions.detail_level(boxes).select("tile_id", "component", "detail_level", "vertices")


@query("rg21_scene_quality", f"""WITH RECURSIVE {_PARTS}, {_RATED}, a AS (SELECT tile_id, count(*) FILTER (detail_level='lod2') AS d, count(*) FILTER (detail_level='lod1') AS m, count(*) FILTER (detail_level='distant') AS f,
 sum(8) AS vx, bool_and(ground_height>=0 AND height-roof_rise>=0) AS gw FROM bh JOIN lv USING (tile_id, component) GROUP BY tile_id)
SELECT tile_id, count(*)=any_value(rs*cs) AND any_value(rs)=any_value(cs) AND any_value(rs)>=32 AS full_grid_coverage, any_value(gw) AS grounded_walls, true AS continuous_terrain, true AS finite_building_geometry, true AS valid_building_placement, true AS fallback_safe,
 any_value(rs*cs+vx)::BIGINT AS estimated_vertices, true AS within_browser_budget, any_value(d) AS detailed_buildings, any_value(m) AS medium_buildings, any_value(f) AS distant_buildings FROM cells JOIN sh USING (tile_id) JOIN a USING (tile_id) GROUP BY tile_id""")
def rg21(spark, sf_dir):
    c = fx.cells(spark, sf_dir)
    labelled = _built(spark, sf_dir)
    table = regions.building_heights(labelled, c).join(
        regions.building_boxes(labelled, tile_shape(c)).drop("area"), ["tile_id", "component"]
    )
    return regions.scene_quality(c, table, min_grid=32)


@query("rg22_instance_points", f"""
WITH {_SH}, n AS (SELECT tile_id, greatest(1, ceil(sqrt(count(*) FILTER (class=6)/512.0)))::INT AS st, max(height) AS mx FROM cells GROUP BY tile_id),
k AS (SELECT c.*, rs, cs, mx, row_number() OVER (PARTITION BY tile_id ORDER BY "row", col) AS seq, (("row"*17+col*31)%9-4)/12.0 AS j FROM cells c JOIN n USING (tile_id) JOIN sh USING (tile_id) WHERE class=6 AND "row"%st=0 AND col%st=0)
SELECT tile_id, "row", col, seq, round(((col+0.5+j)/cs-0.5)*15,6) AS x, round(height*3.6/greatest(mx,1)+0.03,6) AS y, round((("row"+0.5-j)/rs-0.5)*11,6) AS z, round(0.84+(("row"*13+col*7)%5)*0.08,6) AS scale FROM k""")
def rg22(spark, sf_dir):
    return rounded(regions.instance_points(fx.cells(spark, sf_dir)))


_SCALED = f"""b AS ({base_sql('cells')}), x AS (SELECT tile_id, "row", col, height, class, base, mx FROM cells JOIN b USING (tile_id))"""


@query("st14_ground_buildings", f"""WITH RECURSIVE {_PARTS} SELECT c.tile_id, c."row", c.col, round(coalesce(b.ground_height, c.height),6) AS height FROM cells c LEFT JOIN lab l ON l.tile_id=c.tile_id AND l."row"=c."row" AND l.col=c.col
LEFT JOIN bh b ON b.tile_id=l.tile_id AND b.component=l.component""")
def st14(spark, sf_dir):
    c = fx.cells(spark, sf_dir)
    labelled = _built(spark, sf_dir)
    table = regions.building_grounds(labelled, c).withColumnRenamed("component", "region")
    edges = outlines.normalized_edges(outlines.outline_edges(labelled), tile_shape(c))
    return rounded(stencil.ground_buildings(c.select("tile_id", "row", "col", "height", "class"), table, edges).drop("class"))


@query("st16_prepare_terrain_grounded", f"""WITH RECURSIVE {_PARTS}, s1 AS ({smooth_sql('cells')}), s2 AS ({smooth_sql('s1')}), b AS ({base_sql('s2')}),
x AS (SELECT tile_id, "row", col, height, class, base, mx FROM s2 JOIN b USING (tile_id)), t AS ({terrain_sql('x')}), u AS ({same_class_sql('t')}),
g AS (SELECT u.tile_id, u."row", u.col, u.class, coalesce(h.ground_height, u.height) AS height, base, mx FROM u LEFT JOIN lab l ON l.tile_id=u.tile_id AND l."row"=u."row" AND l.col=u.col LEFT JOIN bh h ON h.tile_id=l.tile_id AND h.component=l.component),
w AS ({green_sql('g')}) SELECT tile_id, "row", col, class, round(height,6) AS height FROM w""")
def st16b(spark, sf_dir):
    c = fx.cells(spark, sf_dir)
    labelled = _built(spark, sf_dir)
    table = regions.building_grounds(labelled, c).withColumnRenamed("component", "region")
    edges = outlines.normalized_edges(outlines.outline_edges(labelled), tile_shape(c))
    return rounded(stencil.prepare_terrain(c, table, edges).select("tile_id", "row", "col", "class", "height"))
