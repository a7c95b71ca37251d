"""Neighbourhood queries (survey group 2.4)."""

from __future__ import annotations

from pyspark.sql import functions as F

from rastertab.operators import stencil
from rastertab.plans import fixtures as fx
from rastertab.plans.registry import quantile_sql, query, rounded

_AT = 'n.tile_id=c.tile_id AND n."row"=c."row"+o.dr AND n.col=c.col+o.dc'


def _near(src: str, offsets: str) -> str:
    return f"{src} c CROSS JOIN {offsets} o JOIN {src} n ON {_AT}"


def majority_sql(src: str) -> str:
    return f"""SELECT c.tile_id, c."row", c.col, coalesce(v.class, c.class) AS class, c.boundary FROM {src} c LEFT JOIN
(SELECT c.tile_id, c."row", c.col, n.class FROM {_near(src, 'off9')} WHERE c.boundary<0.65 GROUP BY ALL HAVING count(*)>=6) v
ON v.tile_id=c.tile_id AND v."row"=c."row" AND v.col=c.col"""


def smooth_sql(src: str) -> str:
    return f"""SELECT c.* EXCLUDE (class), CASE WHEN c.class IN (0,1,2) AND greatest(g,v)>=6 THEN (CASE WHEN g>=v THEN 1 ELSE 2 END) ELSE c.class END AS class FROM {src} c LEFT JOIN
(SELECT c.tile_id, c."row", c.col, count(*) FILTER (n.class=1) AS g, count(*) FILTER (n.class=2) AS v FROM {_near(src, 'off8')} GROUP BY ALL) k USING (tile_id, "row", col)"""


def _um(x: str, where: str = "true") -> str:
    return f"list_sort(list({x}) FILTER ({where}))[count(*) FILTER ({where}) // 2 + 1]"


def terrain_sql(src: str) -> str:
    return f"""SELECT c.tile_id, c."row", c.col, c.class, CASE WHEN c.class=3 THEN coalesce(m, base) WHEN c.class IN (4,5) THEN base ELSE least(c.height, base+greatest(0.08*mx,0.5)) END AS height, base, mx
FROM {src} c LEFT JOIN (SELECT c.tile_id, c."row", c.col, {_um('n.height')} AS m FROM {_near(src, 'off8')} WHERE c.class=3 AND n.class>=0 AND n.class<>3 GROUP BY ALL) k USING (tile_id,"row",col)"""


def same_class_sql(src: str) -> str:
    return f"""SELECT c.tile_id, c."row", c.col, c.class, CASE WHEN c.class=3 THEN c.height WHEN c.class IN (4,5) THEN base ELSE m END AS height, base, mx
FROM {src} c JOIN (SELECT c.tile_id, c."row", c.col, {_um('n.height')} AS m FROM {_near(src, 'off9')} WHERE (dr=0 OR dc=0) AND n.class=c.class GROUP BY ALL) k USING (tile_id,"row",col)"""


def green_sql(src: str) -> str:
    return f"""SELECT c.tile_id, c."row", c.col, c.class, CASE WHEN c.class IN (2,6) THEN m ELSE c.height END AS height, base, mx
FROM {src} c LEFT JOIN (SELECT c.tile_id, c."row", c.col, {_um('n.height')} AS m FROM {_near(src, 'off9')} WHERE n.class NOT IN (3,4,5) GROUP BY ALL) k USING (tile_id,"row",col)"""


def base_sql(src: str) -> str:
    return f"""SELECT tile_id, coalesce({_um('height', 'class=1')}, {_um('height', 'class>=0 AND class<>3')}, 0) AS base, max(height) AS mx FROM {src} GROUP BY tile_id"""


_SCALED = f"""b AS ({base_sql('cells')}), x AS (SELECT tile_id, "row", col, height, class, base, mx FROM cells JOIN b USING (tile_id))"""


@query("st01_neighbours", """SELECT c.tile_id, c."row", c.col, n."row" AS n_row, n.col AS n_col FROM """ + _near("cells", "off9"))
def st01(spark, sf_dir):
    return stencil.neighbours(fx.cells(spark, sf_dir), 8, include_self=True)


@query("st01_neighbours4", """SELECT c.tile_id, c."row", c.col, n."row" AS n_row, n.col AS n_col FROM """ + _near("cells", "off4"))
def st01b(spark, sf_dir):
    return stencil.neighbours(fx.cells(spark, sf_dir), 4)


def _labels(spark, sf_dir):
    return fx.cells(spark, sf_dir).select("tile_id", "row", "col", "class", "boundary")


@query("st02_majority_filter", majority_sql("cells"))
def st02(spark, sf_dir):
    return stencil.majority_filter(_labels(spark, sf_dir))


# The fixture's open land is too mixed for six like neighbours; merging classes by row makes plenty.
_SOFT = """soft AS (SELECT tile_id, "row", col, CASE WHEN class IN (0,1,2,6) THEN CASE WHEN k%9=0 THEN 2 WHEN "row"%16<8 THEN 1 ELSE 2 END ELSE class END AS class FROM cells)"""


@query("st03_smooth_ground_vegetation", f"""WITH {_SOFT}, s1 AS ({smooth_sql('soft')}), s2 AS ({smooth_sql('s1')}) SELECT tile_id, "row", col, class FROM s2""")
def st03(spark, sf_dir):
    soft = F.when(F.col("k") % 9 == 0, 2).when(F.col("row") % 16 < 8, 1).otherwise(2)
    c = fx.cells(spark, sf_dir).withColumn(
        "class", F.when(F.col("class").isin(0, 1, 2, 6), soft).otherwise(F.col("class"))
    )
    return stencil.smooth_ground_vegetation(c.select("tile_id", "row", "col", "class"))


@query("st04_mask_boundary", """SELECT c.tile_id, c."row", c.col, c.class=3 AND (SELECT count(*) FROM off4 o JOIN cells n ON n.tile_id=c.tile_id AND n."row"=c."row"+o.dr AND n.col=c.col+o.dc WHERE n.class=3)<4 AS edge FROM cells c""")
def st04(spark, sf_dir):
    return stencil.mask_boundary(fx.cells(spark, sf_dir), F.col("class") == 3).select("tile_id", "row", "col", "edge")


@query("st05_height_boundary", f"""
WITH q AS (SELECT tile_id, greatest({quantile_sql("height", 0.72)}, 0.75) AS th FROM cells GROUP BY tile_id), m AS (SELECT tile_id, "row", col, height>=th AS a FROM cells JOIN q USING (tile_id))
SELECT c.tile_id, c."row", c.col, c.a AND (SELECT count(*) FROM off4 o JOIN m n ON n.tile_id=c.tile_id AND n."row"=c."row"+dr AND n.col=c.col+dc WHERE n.a)<4 AS edge_height FROM m c""")
def st05(spark, sf_dir):
    return stencil.height_boundary(fx.cells(spark, sf_dir)).select("tile_id", "row", "col", "edge_height")


@query("st06_dilate4_wrap", """
WITH sh AS (SELECT tile_id, max("row")+1 AS rs, max(col)+1 AS cs FROM cells GROUP BY tile_id)
SELECT DISTINCT c.tile_id, ((c."row"+dr+rs)%rs)::INT AS "row", ((c.col+dc+cs)%cs)::INT AS col FROM cells c JOIN sh USING (tile_id) CROSS JOIN off9 o WHERE class=4 AND (dr=0 OR dc=0)""")
def st06(spark, sf_dir):
    c = fx.cells(spark, sf_dir)
    return stencil.dilate4_wrap(c.where(F.col("class") == 4).select("tile_id", "row", "col"), stencil.tile_shape(c))


@query("st07_slope_degrees", """
WITH s AS (SELECT tile_id, max(height) AS mx, max("row")+1 AS rs, max(col)+1 AS cs FROM cells GROUP BY tile_id),
g AS (SELECT c.tile_id, c."row", c.col, coalesce(r.height,c.height)-coalesce(l.height,c.height) AS dx, coalesce(d.height,c.height)-coalesce(u.height,c.height) AS dz FROM cells c
 LEFT JOIN cells l ON l.tile_id=c.tile_id AND l."row"=c."row" AND l.col=c.col-1 LEFT JOIN cells r ON r.tile_id=c.tile_id AND r."row"=c."row" AND r.col=c.col+1
 LEFT JOIN cells u ON u.tile_id=c.tile_id AND u.col=c.col AND u."row"=c."row"-1 LEFT JOIN cells d ON d.tile_id=c.tile_id AND d.col=c.col AND d."row"=c."row"+1)
SELECT tile_id, "row", col, round(degrees(atan(sqrt((dx*3.6/greatest(mx,1)/(2*15.0/greatest(cs-1,1)))^2 + (dz*3.6/greatest(mx,1)/(2*11.0/greatest(rs-1,1)))^2))),6) AS slope FROM g JOIN s USING (tile_id)""")
def st07(spark, sf_dir):
    return rounded(stencil.slope_degrees(fx.cells(spark, sf_dir)).select("tile_id", "row", "col", "slope"))


@query("st08_local_relief", f"""
WITH s AS (SELECT tile_id, greatest(max(height)-min(height),1) AS rg FROM cells GROUP BY tile_id),
m AS (SELECT c.tile_id, c."row", c.col, max(abs(c.height-n.height)) AS d FROM {_near('cells', 'off4')} GROUP BY ALL)
SELECT tile_id, "row", col, round(least(1, d/rg),6) AS relief FROM m JOIN s USING (tile_id)""")
def st08(spark, sf_dir):
    return rounded(stencil.local_relief(fx.cells(spark, sf_dir)).select("tile_id", "row", "col", "relief"))


@query("st09_gradients", """
SELECT p.tile_id, p."row", p.col, round(r.height-p.height,6) AS dx, round(d.height-p.height,6) AS dy, round(r.pred_height-p.pred_height,6) AS pred_dx, round(d.pred_height-p.pred_height,6) AS pred_dy
FROM pred p LEFT JOIN pred r ON r.tile_id=p.tile_id AND r."row"=p."row" AND r.col=p.col+1 LEFT JOIN pred d ON d.tile_id=p.tile_id AND d.col=p.col AND d."row"=p."row"+1""")
def st09(spark, sf_dir):
    return rounded(stencil.gradient_report(fx.pred(spark, sf_dir)).select("tile_id", "row", "col", "dx", "dy", "pred_dx", "pred_dy"))


_SIDES = {"u": (-1, 0), "d": (1, 0), "l": (0, -1), "r": (0, 1), "ul": (-1, -1), "ur": (-1, 1), "dl": (1, -1), "dr": (1, 1)}
_EIGHT_JOINS = " ".join(
    f'LEFT JOIN cells {n} ON {n}.tile_id=c.tile_id AND {n}."row"=c."row"+({r}) AND {n}.col=c.col+({q})' for n, (r, q) in _SIDES.items()
)
_MIRRORED = ", ".join(
    [f"coalesce({n}.height, c.height)" for n in "udlr"]
    + [f"coalesce({n}.height, {n[1]}.height, {n[0]}.height, c.height)" for n in ("ul", "ur", "dl", "dr")]
)


@query("st10_median_filter3", f"""SELECT c.tile_id, c."row", c.col, list_sort([c.height, {_MIRRORED}])[5] AS height FROM cells c {_EIGHT_JOINS}""")
def st10(spark, sf_dir):
    return stencil.median_filter3(fx.cells(spark, sf_dir).select("tile_id", "row", "col", "height"))


@query("st11_base_height", f"SELECT tile_id, base AS base_height FROM ({base_sql('cells')})")
def st11(spark, sf_dir):
    return stencil.base_height(fx.cells(spark, sf_dir))


def _scaled(spark, sf_dir):
    c = fx.cells(spark, sf_dir).select("tile_id", "row", "col", "height", "class")
    top = c.groupBy("tile_id").agg(F.max("height").alias("max_height"))
    return stencil.attach(c, stencil.base_height(c).join(top, "tile_id"))


_OUT = ("tile_id", "row", "col", "height")


@query("st12_terrain_heights", f"""WITH {_SCALED}, t AS ({terrain_sql('x')}) SELECT tile_id, "row", col, round(height,6) AS height FROM t""")
def st12(spark, sf_dir):
    return rounded(stencil.terrain_heights(_scaled(spark, sf_dir)).select(*_OUT))


@query("st13_smooth_same_class", f"""WITH {_SCALED}, t AS ({same_class_sql('x')}) SELECT tile_id, "row", col, round(height,6) AS height FROM t""")
def st13(spark, sf_dir):
    return rounded(stencil.smooth_same_class(_scaled(spark, sf_dir)).select(*_OUT))


@query("st15_suppress_green_spikes", f"""WITH {_SCALED}, t AS ({green_sql('x')}) SELECT tile_id, "row", col, round(height,6) AS height FROM t""")
def st15(spark, sf_dir):
    return rounded(stencil.suppress_green_spikes(_scaled(spark, sf_dir)).select(*_OUT))


@query("st16_prepare_terrain", f"""
WITH s1 AS ({smooth_sql('cells')}), s2 AS ({smooth_sql('s1')}), b AS ({base_sql('s2')}),
x AS (SELECT tile_id, "row", col, height, class, base, mx FROM s2 JOIN b USING (tile_id)), t AS ({terrain_sql('x')}), u AS ({same_class_sql('t')}), w AS ({green_sql('u')})
SELECT tile_id, "row", col, class, round(height,6) AS height, base AS base_height FROM w""")
def st16(spark, sf_dir):
    return rounded(stencil.prepare_terrain(fx.cells(spark, sf_dir)).select("tile_id", "row", "col", "class", "height", "base_height"))


@query("st17_abs_error", """SELECT tile_id, "row", col, round(abs(pred_height-height),6) AS abs_error FROM pred""")
def st17(spark, sf_dir):
    p = fx.pred(spark, sf_dir)
    return rounded(stencil.abs_error(p.drop("height").withColumnRenamed("pred_height", "height"), fx.cells(spark, sf_dir)))
