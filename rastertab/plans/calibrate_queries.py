"""Calibration and georeferencing queries (survey group 2.7)."""

from __future__ import annotations

from pyspark.sql import functions as F

from rastertab.functions.grid import row_major_rank, tile_shape
from rastertab.operators import calibrate as ca
from rastertab.plans import fixtures as fx
from rastertab.plans.registry import query, rounded

# Every tile offers the 1st, 9th, 45th and 90th ground cell as control points.
_G = """gr AS (SELECT tile_id, "row", col, height, row_number() OVER (PARTITION BY tile_id ORDER BY "row", col) AS rk FROM cells WHERE class=1),
gp AS (SELECT tile_id, "row", col, height, (rk>1)::INT+(rk>9)::INT+(rk>45)::INT AS seq, col::DOUBLE AS x, "row"::DOUBLE AS y, 100.0+col+2*"row"+(rk%7)*0.25 AS elevation FROM gr WHERE rk IN (1,9,45,90)),
tl AS (SELECT tile_id, count(*) AS size, count(*) FILTER (class=1) AS ground FROM cells GROUP BY tile_id),
np AS (SELECT tile_id, count(*) AS n FROM gp GROUP BY tile_id)"""


def scenes(spark, sf_dir):
    c = fx.cells(spark, sf_dir)
    ranked = row_major_rank(c.where(F.col("class") == 1), "rk").where(F.col("rk").isin(1, 9, 45, 90))
    seq = (F.col("rk") > 1).cast("int") + (F.col("rk") > 9).cast("int") + (F.col("rk") > 45).cast("int")
    elevation = 100.0 + F.col("col") + 2 * F.col("row") + (F.col("rk") % 7) * 0.25
    # At most four points per tile, written as the JSON text that the parser reads.
    point = F.to_json(F.struct(F.col("col").alias("pixelX"), F.col("row").alias("pixelY"), elevation.alias("elevation")))
    texts = ranked.groupBy("tile_id").agg(
        F.concat(
            F.lit("["), F.concat_ws(",", *[F.max(F.when(seq == i, point)) for i in range(4)]), F.lit("]")
        ).alias("gcps_json")
    )
    t = F.col("tile_id")
    return tile_shape(c).join(texts, "tile_id", "left").select(
        "tile_id", "rows", "cols",
        F.col("cols").alias("width"), F.when(t % 6 == 5, F.col("rows") + 1).otherwise(F.col("rows")).alias("height"),
        (t % 9 != 8).alias("calibrate"),
        F.when(t % 7 != 5, F.lit("EPSG:32618")).alias("crs"),
        F.when(t % 2 == 1, 100.0 + t).alias("ground_elevation"),
        F.when(t % 2 == 0, F.when(t % 8 == 6, '[{"pixelX": 1}]').when(t % 8 == 4, '{"x": 1').otherwise(F.col("gcps_json"))).alias("gcps_json"),
        F.when(t % 4 == 1, F.lit(" survey ")).alias("provenance"),
        F.array(*[F.lit(v).cast("double") for v in (0.5, 0.0)], 1000.0 + t * 16, F.lit(0.0), F.when(t % 5 == 4, 0.0).otherwise(-0.5),
                F.lit(2000.0), F.lit(0.0), F.lit(0.0), F.lit(1.0)).alias("transform"),
        F.array(F.lit(2.0), F.lit(0.0), 998.0 + t * 16, F.lit(0.0), F.lit(-2.0), F.lit(2002.0)).alias("coarse_transform"),
    )


@query("ca01_explode_gcps", f"""WITH {_G} SELECT tile_id, seq, x, y, elevation, NULL AS problem FROM gp WHERE tile_id%2=0 AND tile_id%8 NOT IN (4,6)
UNION ALL SELECT tile_id, 0, 1.0, NULL, NULL, 'missing_field' FROM tl WHERE tile_id%8=6 UNION ALL SELECT tile_id, NULL, NULL, NULL, NULL, 'bad_json' FROM tl WHERE tile_id%8=4""")
def ca01(spark, sf_dir):
    return ca.explode_gcps(scenes(spark, sf_dir))


@query("ca02_ground_evidence", """SELECT tile_id, count(*) FILTER (class=1 AND k%5<>0) AS ground_pixels, greatest(25, floor(count(*)*0.01))::BIGINT AS required, true AS has_classes FROM cells GROUP BY tile_id""")
def ca02(spark, sf_dir):
    return ca.ground_evidence(fx.cells(spark, sf_dir).withColumn("valid", F.col("k") % 5 != 0))


def _gcps(spark, sf_dir):
    """Control points of every scene, moved by half cells so that rounding matters."""
    s = scenes(spark, sf_dir)
    c = fx.cells(spark, sf_dir)
    ranked = row_major_rank(c.where(F.col("class") == 1), "rk").where(F.col("rk").isin(1, 9, 45, 90))
    seq = (F.col("rk") > 1).cast("int") + (F.col("rk") > 9).cast("int") + (F.col("rk") > 45).cast("int")
    return ranked.join(s.select("tile_id"), "tile_id").select(
        "tile_id", seq.alias("seq"), F.col("col").cast("double").alias("x"), F.col("row").cast("double").alias("y"),
        (100.0 + F.col("col") + 2 * F.col("row") + (F.col("rk") % 7) * 0.25).alias("elevation"),
    )


@query("ca03_match_gcps", f"""WITH {_G}, h AS (SELECT *, x+0.5 AS hx, round_even(x+0.5,0)::INT AS hc FROM gp)
SELECT h.tile_id, seq, hx AS x, y, elevation, h."row", hc AS col, c.tile_id IS NOT NULL AS inside, c.tile_id IS NOT NULL AS on_valid, coalesce(c.class=1,false) AS on_ground, c.height FROM h LEFT JOIN cells c ON c.tile_id=h.tile_id AND c."row"=h."row" AND c.col=hc""")
def ca03(spark, sf_dir):
    return ca.match_gcps(_gcps(spark, sf_dir).withColumn("x", F.col("x") + 0.5), fx.cells(spark, sf_dir))


_FIT = """f AS (SELECT tile_id, count(*) AS points, var_pop(x) AS sxx, var_pop(y) AS syy, covar_pop(x,y) AS sxy, covar_pop(x,elevation) AS sxz, covar_pop(y,elevation) AS syz, avg(x) AS mx, avg(y) AS my, avg(elevation) AS mz FROM gp GROUP BY tile_id),
pl AS (SELECT *, mz-a*mx-b*my AS c FROM (SELECT *, (sxz*syy-syz*sxy)/(sxx*syy-sxy*sxy) AS a, (syz*sxx-sxz*sxy)/(sxx*syy-sxy*sxy) AS b FROM f WHERE points>=3)),
pb AS (SELECT tile_id, median(height) AS bs FROM gp GROUP BY tile_id),
pr AS (SELECT g.tile_id, sqrt(avg((a*x+b*y+c+height-bs-elevation)^2)) AS residual, any_value(bs) AS baseline, greatest(max(elevation)-min(elevation),1) AS scale FROM gp g JOIN pl USING (tile_id) JOIN pb USING (tile_id) GROUP BY g.tile_id)"""


@query("ca04_fit_ground_plane", f"WITH {_G}, {_FIT} SELECT tile_id, points, true AS usable, round(a,6) AS a, round(b,6) AS b, round(c,6) AS c FROM pl")
def ca04(spark, sf_dir):
    return rounded(ca.fit_ground_plane(_gcps(spark, sf_dir)))


@query("ca05_plane_residual", f"WITH {_G}, {_FIT} SELECT tile_id, round(residual,6) AS residual, round(baseline,6) AS baseline, round(scale,6) AS scale FROM pr")
def ca05(spark, sf_dir):
    g = _gcps(spark, sf_dir)
    return rounded(ca.plane_residual(ca.match_gcps(g, fx.cells(spark, sf_dir)), ca.fit_ground_plane(g)))


_FLAT = """fb AS (SELECT tile_id, median(height) AS m FROM cells WHERE class=1 GROUP BY tile_id),
fl AS (SELECT tile_id, sqrt(avg((height-m)^2)) AS residual, any_value(m) AS baseline, greatest(abs(100.0+tile_id),1) AS scale FROM cells JOIN fb USING (tile_id) WHERE class=1 GROUP BY tile_id)"""


@query("ca06_flat_ground", f"WITH {_FLAT} SELECT tile_id, round(residual,6) AS residual, round(baseline,6) AS baseline, round(scale,6) AS scale FROM fl")
def ca06(spark, sf_dir):
    c = fx.cells(spark, sf_dir)
    return rounded(ca.flat_ground(c, c.select("tile_id").distinct().withColumn("ground_elevation", 100.0 + F.col("tile_id"))))


_STATUS = f"""{_G}, {_FIT}, {_FLAT},
cs AS (SELECT tl.tile_id, CASE WHEN tile_id%9=8 THEN 'not_applicable' WHEN tile_id%7=5 THEN 'missing_spatial_reference' WHEN tile_id%8 IN (4,6) THEN 'malformed_ground_control_points'
 WHEN tile_id%2=0 AND n<3 THEN 'invalid_ground_control_points' WHEN tile_id%2=0 THEN 'calibrated' WHEN ground<greatest(25,floor(size*0.01)) THEN 'insufficient_ground_evidence' ELSE 'calibrated' END AS status,
 ground, greatest(25,floor(size*0.01)) AS required, n FROM tl LEFT JOIN np USING (tile_id)),
cal AS (SELECT s.tile_id, status, CASE WHEN status='calibrated' AND s.tile_id%2=1 THEN 'ground_pixels_plus_ground_elevation' WHEN s.tile_id%2=0 AND status IN ('calibrated','invalid_ground_control_points') THEN 'ground_control_points' END AS method,
 CASE WHEN status='calibrated' THEN CASE WHEN s.tile_id%2=0 THEN pr.residual ELSE fl.residual END END AS residual, CASE WHEN s.tile_id%2=0 THEN pr.scale ELSE fl.scale END AS scale, required,
 CASE WHEN status IN ('not_applicable','missing_spatial_reference') THEN 0 WHEN status='calibrated' AND s.tile_id%2=0 THEN greatest(ground,n) ELSE ground END AS cnt,
 CASE WHEN status IN ('not_applicable','missing_spatial_reference','malformed_ground_control_points') THEN NULL WHEN s.tile_id%2=0 THEN 'unverified' WHEN s.tile_id%4=1 THEN 'provenance_provided_unverified' ELSE 'unverified' END AS accuracy_status,
 CASE WHEN status='calibrated' THEN CASE WHEN s.tile_id%2=0 THEN pr.baseline ELSE fl.baseline END END AS baseline, CASE WHEN status='calibrated' THEN CASE WHEN s.tile_id%2=0 THEN a ELSE 0 END END AS a,
 CASE WHEN status='calibrated' THEN CASE WHEN s.tile_id%2=0 THEN b ELSE 0 END END AS b, CASE WHEN status='calibrated' THEN CASE WHEN s.tile_id%2=0 THEN c ELSE 100.0+s.tile_id END END AS c
 FROM cs s LEFT JOIN pr USING (tile_id) LEFT JOIN fl USING (tile_id) LEFT JOIN pl USING (tile_id))"""
_CONF = "CASE WHEN status='calibrated' THEN greatest(0,least(1,exp(-residual/scale)*least(1.0,cnt/(required*4)))) ELSE 0 END"


@query("ca07_calibration_status", f"WITH {_STATUS} SELECT tile_id, status, method, round({_CONF},6) AS confidence, round(residual,6) AS residual, cnt::BIGINT AS ground_pixel_count, accuracy_status, round(baseline,6) AS baseline, round(a,6) AS a, round(b,6) AS b, round(c,6) AS c FROM cal")
def ca07(spark, sf_dir):
    return rounded(ca.calibration_status(scenes(spark, sf_dir), fx.cells(spark, sf_dir)))


@query("ca08_apply_dsm", f"""WITH {_STATUS} SELECT x.tile_id, x."row", x.col, round(coalesce(CASE WHEN k%5<>0 THEN x.height-baseline+a*x.col+b*x."row"+c END, -9999),6) AS dsm FROM cells x LEFT JOIN cal USING (tile_id)""")
def ca08(spark, sf_dir):
    c = fx.cells(spark, sf_dir)
    status = ca.calibration_status(scenes(spark, sf_dir), c)
    marked = c.withColumn("valid", F.col("k") % 5 != 0)
    return rounded(ca.apply_dsm(marked, status, ca.NODATA).select("tile_id", "row", "col", "dsm"))


@query("ca09_affine_fit", "SELECT landscape, round(regr_slope(height,pred_height+boundary),6) AS scale, round(regr_intercept(height,pred_height+boundary),6) AS \"offset\" FROM pred GROUP BY landscape")
def ca09(spark, sf_dir):
    p = fx.pred(spark, sf_dir).withColumn("pred_height", F.col("pred_height") + F.col("boundary"))
    return rounded(ca.affine_fit(p, ["landscape"]))


@query("ca09_affine_fit_pairs", 'SELECT round(regr_slope(height,pred_height),6) AS scale, round(regr_intercept(height,pred_height),4) AS "offset" FROM pairs')
def ca09b(spark, sf_dir):
    fit = ca.affine_fit(fx.pairs(spark, sf_dir))
    return fit.select(F.round("scale", 6).alias("scale"), F.round("offset", 4).alias("offset"))


@query("ca10_absolute_from_ground", f"""WITH {_G}, d AS (SELECT tile_id, "row", col, height+50+boundary*10 AS dsm FROM cells), e AS (SELECT g.tile_id, avg(elevation-dsm) AS s FROM gp g JOIN d USING (tile_id,"row",col) GROUP BY g.tile_id)
SELECT d.tile_id, d."row", d.col, round(dsm+coalesce(s,0),6) AS dsm FROM d LEFT JOIN e USING (tile_id)""")
def ca10(spark, sf_dir):
    c = fx.cells(spark, sf_dir)
    ground = c.select("tile_id", "row", "col", (50 + F.col("boundary") * 10).alias("ground"))
    g = _gcps(spark, sf_dir).select("tile_id", F.col("y").cast("int").alias("row"), F.col("x").cast("int").alias("col"), "elevation")
    return rounded(ca.absolute_from_ground(c, ground, g).select("tile_id", "row", "col", "dsm"))


@query("ca11_resample_ground", """
WITH co AS (SELECT tile_id, "row"//4 AS r, col//4 AS c, avg(height) AS v FROM cells GROUP BY ALL),
p AS (SELECT tile_id, "row", col, (0.5*(col+0.5)+2)/2.0-0.5 AS u, (0.5*("row"+0.5)+2)/2.0-0.5 AS w FROM cells WHERE tile_id%5<>4
 UNION ALL SELECT tile_id, "row", col, (0.5*(col+0.5)+2)/2.0-0.5, 2.0/2.0-0.5 FROM cells WHERE tile_id%5=4),
k AS (SELECT p.*, (floor(w)+dr)::INT AS r, (floor(u)+dc)::INT AS c, (1-abs(w-floor(w)-dr))*(1-abs(u-floor(u)-dc)) AS wt FROM p, (SELECT unnest([0,1]) AS dr), (SELECT unnest([0,1]) AS dc))
SELECT k.tile_id, k."row", k.col, round(sum(wt*v)/sum(wt),9) AS ground FROM k JOIN co ON co.tile_id=k.tile_id AND co.r=k.r AND co.c=k.c WHERE wt>0 GROUP BY ALL""")
def ca11(spark, sf_dir):
    c = fx.cells(spark, sf_dir)
    coarse = c.groupBy("tile_id", F.floor(F.col("row") / 4).cast("int").alias("r"), F.floor(F.col("col") / 4).cast("int").alias("c")).agg(
        F.avg("height").alias("value")
    ).select("tile_id", F.col("r").alias("row"), F.col("c").alias("col"), "value")
    return rounded(ca.resample_ground(coarse, c, scenes(spark, sf_dir)), 9)


def _with_metadata(spark, sf_dir):
    s = scenes(spark, sf_dir)
    t = F.col("tile_id")
    bounds = F.struct(
        (1000.0 + t * 16).alias("left"), (2000.0 - F.col("rows") * 0.5).alias("bottom"),
        (1000.0 + t * 16 + F.col("cols") * 0.5).alias("right"), F.lit(2000.0).alias("top"),
    )
    return s.withColumn("bounds", bounds).withColumn("resolution", F.array(F.lit(0.5), F.when(t % 4 == 3, 0.6).otherwise(0.5)))


@query("ca12_check_georeference", """
WITH s AS (SELECT tile_id AS t, max("row")+1 AS rs FROM cells GROUP BY tile_id)
SELECT t AS tile_id, array_to_string(list_filter([CASE WHEN t%7=5 THEN 'missing_crs' END, CASE WHEN t%5=4 THEN 'singular_transform' END, CASE WHEN t%6=5 THEN 'size_mismatch' END,
CASE WHEN t%5=4 OR t%6=5 THEN 'bounds_mismatch' END, CASE WHEN t%5=4 OR t%4=3 THEN 'resolution_mismatch' END], lambda x: x IS NOT NULL), ',') AS problems FROM s""")
def ca12(spark, sf_dir):
    return ca.check_georeference(_with_metadata(spark, sf_dir)).select("tile_id", F.array_join("problems", ",").alias("problems"))


@query("ca13_cell_coordinates", """SELECT tile_id, "row", col, 1000.0+tile_id*16+0.5*(col+0.5) AS x, 2000-CASE WHEN tile_id%5=4 THEN 0 ELSE 0.5*("row"+0.5) END AS y FROM cells""")
def ca13(spark, sf_dir):
    c = fx.cells(spark, sf_dir).select("tile_id", "row", "col")
    return ca.cell_coordinates(c, scenes(spark, sf_dir))


@query("ca13_scene_bounds", """SELECT tile_id, 1000.0+tile_id*16 AS "left", 2000-CASE WHEN tile_id%5=4 THEN 0 ELSE 0.5*(max("row")+1+(tile_id%6=5)::INT) END AS bottom, 1000.0+tile_id*16+0.5*(max(col)+1) AS "right", 2000.0 AS top FROM cells GROUP BY tile_id""")
def ca13b(spark, sf_dir):
    return ca.scene_bounds(scenes(spark, sf_dir))


@query("ca14_result_labels", f"""WITH {_STATUS} SELECT tile_id, CASE WHEN status='calibrated' THEN 'metric_dsm' ELSE 'estimated_ndsm' END AS result_type, CASE WHEN status='calibrated' THEN 'absolute' ELSE 'relative' END AS height_reference,
CASE WHEN status='calibrated' THEN NULL ELSE 'unavailable: '||replace(status,'_',' ') END AS reason FROM cal""")
def ca14(spark, sf_dir):
    out = ca.result_labels(ca.calibration_status(scenes(spark, sf_dir), fx.cells(spark, sf_dir)))
    reason = F.when(F.col("fit_text").startswith("unavailable"), F.col("fit_text"))
    return out.select("tile_id", "result_type", "height_reference", reason.alias("reason"))


@query("ca15_pin_heights", """
WITH s AS (SELECT tile_id, max("row")+1 AS rs, max(col)+1 AS cs FROM cells GROUP BY tile_id),
p AS (SELECT event_id AS point_id, tile_id, greatest(0,least(rs-1,floor(((boundary*14-7)/11.0+0.5)*(rs-1)+0.5)))::INT AS "row", greatest(0,least(cs-1,floor(((height/20.0-8)/15.0+0.5)*(cs-1)+0.5)))::INT AS col FROM cells JOIN s USING (tile_id))
SELECT p.tile_id, point_id, p."row", p.col, coalesce(c.height,0) AS height FROM p LEFT JOIN cells c ON c.tile_id=p.tile_id AND c."row"=p."row" AND c.col=p.col""")
def ca15(spark, sf_dir):
    c = fx.cells(spark, sf_dir)
    points = c.select(
        "tile_id", F.col("event_id").alias("point_id"), (F.col("height") / 20.0 - 8).alias("x"), (F.col("boundary") * 14 - 7).alias("z")
    )
    return ca.pin_heights(points, c).drop("slope")
