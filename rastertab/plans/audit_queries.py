"""Pixel audit queries (survey group 2.3)."""

from __future__ import annotations

from pyspark.sql import functions as F

from rastertab.operators import audit
from rastertab.plans import fixtures as fx
from rastertab.plans.registry import quantile_sql, query, rounded
from rastertab.schema import CLASS_NAMES

_Q = ", ".join(
    f"round(quantile_cont(h,{p / 100}),6) AS p{str(p).replace('.', '_')}" for p in audit.STAT_PERCENTILES
)
_QS = ", ".join(
    f"round(quantile_cont(h,{p / 100}),6) AS p{str(p).replace('.', '_')}" for p in audit.SPLIT_PERCENTILES
)
_FIN = "height IS NOT NULL AND NOT isnan(height)"


@query("au01_with_validity", 'SELECT tile_id, "row", col, valid FROM dirty_ok')
def au01(spark, sf_dir):
    return audit.with_validity(fx.cells_dirty(spark, sf_dir)).select("tile_id", "row", "col", "valid")


@query("au02_clean_invalid", f'SELECT tile_id, "row", col, CASE WHEN {_FIN} THEN height ELSE 0 END AS height, CASE WHEN valid THEN class ELSE 0 END AS class FROM dirty_ok')
def au02(spark, sf_dir):
    return audit.clean_invalid(fx.cells_dirty(spark, sf_dir)).select("tile_id", "row", "col", "height", "class")


@query("au03_clamp_height", f'SELECT tile_id, "row", col, CASE WHEN {_FIN} THEN least(300.0::DOUBLE, greatest(0.0::DOUBLE, height)) ELSE 0.0 END AS height FROM dirty_ok')
def au03(spark, sf_dir):
    return audit.clamp_height(fx.cells_dirty(spark, sf_dir)).select("tile_id", "row", "col", "height")


@query("au04_invalid_class_ids", "SELECT tile_id, class, count(*) AS pixels FROM cells_dirty WHERE class NOT BETWEEN 0 AND 6 AND class <> 255 GROUP BY ALL")
def au04(spark, sf_dir):
    return audit.invalid_class_ids(fx.cells_dirty(spark, sf_dir))


@query("au05_shape_mismatch", """
WITH m AS (SELECT tile_id, 'height' AS modality, "row", col FROM cells UNION ALL SELECT tile_id, 'class', "row", col FROM cells WHERE NOT (tile_id % 3 = 0 AND "row" > 20)),
s AS (SELECT tile_id, modality, max("row")+1 AS rs, max(col)+1 AS cs FROM m GROUP BY ALL)
SELECT tile_id, count(*) AS modalities, min(rs) AS min_rows, min(cs) AS min_cols, max(rs) AS max_rows, max(cs) AS max_cols FROM s
GROUP BY tile_id HAVING min(rs)<>max(rs) OR min(cs)<>max(cs)""")
def au05(spark, sf_dir):
    c = fx.cells(spark, sf_dir).select("tile_id", "row", "col")
    both = c.withColumn("modality", F.lit("height")).unionByName(
        c.where(~((F.col("tile_id") % 3 == 0) & (F.col("row") > 20))).withColumn("modality", F.lit("class"))
    )
    return audit.shape_mismatch(both)


@query("au06_height_stats", f"SELECT tile_id, count(h) AS finite_count, min(h) AS min, max(h) AS max, {_Q} FROM (SELECT tile_id, CASE WHEN {_FIN} THEN height END AS h FROM cells_dirty) GROUP BY tile_id")
def au06(spark, sf_dir):
    return rounded(audit.height_stats(fx.cells_dirty(spark, sf_dir)))


_SAMPLE = f"""s AS (SELECT split, height AS h FROM cells_dirty WHERE {_FIN})"""


@query("au07_split_height_sample", f"WITH {_SAMPLE} SELECT split, {_QS}, count(*) AS sampled FROM s GROUP BY split")
def au07(spark, sf_dir):
    return rounded(audit.split_height_percentiles(fx.cells_dirty(spark, sf_dir), ))


@query("au08_class_histogram", """
WITH n AS (SELECT unnest(range(7))::INT AS class), g AS (SELECT split, tile_id, class, count(*) AS n FROM dirty_ok WHERE valid GROUP BY ALL),
k AS (SELECT DISTINCT split, tile_id FROM dirty_ok WHERE valid),
t AS (SELECT k.split, k.tile_id, n.class, coalesce(g.n,0) AS n FROM k CROSS JOIN n LEFT JOIN g ON g.split=k.split AND g.tile_id=k.tile_id AND g.class=n.class)
SELECT split, tile_id, class, sum(n)::BIGINT AS pixels FROM t GROUP BY GROUPING SETS ((split,tile_id,class),(split,class),(class))""")
def au08(spark, sf_dir):
    return audit.class_histogram(fx.cells_dirty(spark, sf_dir))


@query("au09_invalid_pixel_counts", f"""SELECT split, tile_id, count(*) FILTER (NOT ({_FIN})) AS height_nonfinite, count(*) FILTER (class NOT BETWEEN 0 AND 6 AND class<>255) AS class_illegal,
count(*) FILTER (class=255) AS void, count(*) FILTER (NOT valid) AS total_invalid, count(*) FILTER (valid) AS valid_pixels FROM dirty_ok GROUP BY ROLLUP (split, tile_id)""")
def au09(spark, sf_dir):
    return audit.invalid_pixel_counts(fx.cells_dirty(spark, sf_dir))


@query("au10_building_fraction", """SELECT split, tile_id, building, valid_pixels, round(building::DOUBLE/greatest(valid_pixels,1),6) AS fraction FROM
(SELECT split, tile_id, count(*) FILTER (valid AND class=3) AS building, count(*) FILTER (valid) AS valid_pixels FROM dirty_ok GROUP BY ROLLUP (split, tile_id))""")
def au10(spark, sf_dir):
    return rounded(audit.building_fraction(fx.cells_dirty(spark, sf_dir)))


@query("au11_audit_samples", f"""SELECT split, tile_id, max("row")+1 AS rows, max(col)+1 AS cols, count(*) FILTER ({_FIN}) AS finite_count, round(quantile_cont(CASE WHEN {_FIN} THEN height END, 0.95),6) AS p95,
count(*) FILTER (valid AND class=5) AS roads, count(*) FILTER (NOT valid) AS total_invalid, count(*) FILTER (valid) AS valid_pixel_count,
round(count(*) FILTER (valid AND class=3)::DOUBLE/greatest(count(*) FILTER (valid),1),6) AS building_pixel_fraction FROM dirty_ok GROUP BY split, tile_id""")
def au11(spark, sf_dir):
    r = audit.audit_samples(fx.cells_dirty(spark, sf_dir))
    return rounded(r.select(
        "split", "tile_id", F.col("shape")[0].alias("rows"), F.col("shape")[1].alias("cols"),
        F.col("height_stats.finite_count").alias("finite_count"), F.col("height_stats.percentiles")["95"].alias("p95"),
        F.coalesce(F.col("class_counts")["5"], F.lit(0)).alias("roads"), "invalid_pixels.total_invalid",
        "valid_pixel_count", "building_pixel_fraction",
    ))


@query("au11_audit_splits", f"""
WITH q AS (SELECT split, round(quantile_cont(height,0.5),6) AS p50 FROM cells_dirty WHERE {_FIN} GROUP BY split),
t AS (SELECT split, count(DISTINCT tile_id) AS sample_count, count(*) FILTER (valid AND class=3) AS buildings, count(*) FILTER (valid) AS valid_pixel_count, count(*) FILTER (NOT valid) AS invalid_pixel_count FROM dirty_ok GROUP BY split)
SELECT split, sample_count, p50, buildings, valid_pixel_count, invalid_pixel_count, round(buildings::DOUBLE/valid_pixel_count,6) AS building_pixel_fraction FROM t JOIN q USING (split)""")
def au11_splits(spark, sf_dir):
    c = fx.cells_dirty(spark, sf_dir)
    r = audit.audit_splits(c, audit.audit_samples(c))
    return rounded(r.select(
        "split", "sample_count", F.col("height_stats.percentiles")["50"].alias("p50"),
        F.coalesce(F.col("class_counts")["3"], F.lit(0)).alias("buildings"), "valid_pixel_count",
        "invalid_pixel_count", "building_pixel_fraction",
    ))


def _weights(expr: str, clip: bool) -> str:
    w = "r / greatest(avg(r) OVER (), 1e-6)"
    w = f"greatest(0.5, least(3.0, {w}))" if clip else w
    return f"""
WITH n AS (SELECT c.class, count(d.class) AS n FROM (SELECT unnest(range(7))::INT AS class) c LEFT JOIN (SELECT class FROM dirty_ok WHERE valid) d ON d.class=c.class GROUP BY c.class),
r AS (SELECT class, n, {expr} AS r FROM n) SELECT class, n, round({w},6) AS weight FROM r"""


@query("au12_class_weights_balanced", _weights("sqrt(greatest(sum(n) OVER (),1)/(7.0*greatest(n,1)))", True))
def au12(spark, sf_dir):
    return rounded(audit.class_weights(audit.class_totals(fx.cells_dirty(spark, sf_dir)), "balanced"))


@query("au12_class_weights_inv_sqrt", _weights("1.0/sqrt(greatest(n,1))", False))
def au12b(spark, sf_dir):
    return rounded(audit.class_weights(audit.class_totals(fx.cells_dirty(spark, sf_dir)), "inv_sqrt"))


@query("au13_height_scale", f"""
SELECT round(greatest(1, quantile_cont(height,0.995)),6) AS height_scale FROM cells_dirty WHERE {_FIN} AND split='val'""")
def au13(spark, sf_dir):
    return rounded(audit.height_scale(fx.cells_dirty(spark, sf_dir), split="val"))


_CLASS_BANDS = "SELECT tile_id, \"row\", col, CASE WHEN tile_id%2=0 THEN class ELSE class%5*40 END AS r, CASE WHEN tile_id%2=0 THEN class ELSE class%5*50+class//6 END AS g, CASE WHEN tile_id%2=0 THEN class ELSE class%5*10 END AS b FROM cells"


def _class_bands(spark, sf_dir):
    c, even = fx.cells(spark, sf_dir), F.col("tile_id") % 2 == 0
    odd = F.floor(F.col("class") / 6)  # class 6 gets a colour that no palette row has
    shade = [
        F.when(even, F.col("class")).otherwise(F.col("class") % 5 * m + (odd if m == 50 else 0)).cast("int")
        for m in (40, 50, 10)
    ]
    return c.select("tile_id", "row", "col", F.posexplode(F.array(*shade)).alias("band", "value"))


@query("au14_decode_palette", f"""
WITH p AS (SELECT CAST(r_regionkey*40 AS INT) AS r, CAST(r_regionkey*50 AS INT) AS g, CAST(r_regionkey*10 AS INT) AS b, r_regionkey AS class FROM region),
x AS ({_CLASS_BANDS}), q AS (SELECT tile_id, bool_and(r=g AND g=b) AS grey FROM x GROUP BY tile_id)
SELECT x.tile_id, x."row", x.col, CASE WHEN grey THEN x.r ELSE coalesce(p.class,-1) END AS class FROM x JOIN q USING (tile_id) LEFT JOIN p ON p.r=x.r AND p.g=x.g AND p.b=x.b""")
def au14(spark, sf_dir):
    key = F.col("r_regionkey")
    palette = fx.table(spark, sf_dir, "region").select(
        (key * 40).cast("int").alias("r"), (key * 50).cast("int").alias("g"), (key * 10).cast("int").alias("b"), key.alias("class")
    )
    return audit.decode_palette(_class_bands(spark, sf_dir), palette)


@query("au14_palette_problems", f"WITH x AS ({_CLASS_BANDS}) SELECT tile_id, count(DISTINCT (r,g,b)) AS colours FROM x GROUP BY tile_id HAVING NOT bool_and(r=g AND g=b)")
def au14b(spark, sf_dir):
    return audit.palette_problems(_class_bands(spark, sf_dir))


@query("au15_normalize_bands", f"""
WITH q AS (SELECT tile_id, band, {quantile_sql("value", 0.02)} AS lo, {quantile_sql("value", 0.98)} AS hi FROM bands WHERE valid GROUP BY tile_id, band)
SELECT b.tile_id, "row", col, b.band, CASE WHEN hi>lo THEN floor(greatest(0,least(255,(value-lo)/(hi-lo)*255)))::INT ELSE 0 END AS value FROM bands b LEFT JOIN q ON q.tile_id=b.tile_id AND q.band=b.band""")
def au15(spark, sf_dir):
    return audit.normalize_bands(fx.bands(spark, sf_dir)).drop("valid")


@query("au15_normalize_integer_bands", 'SELECT tile_id, "row", col, band, floor(greatest(0,least(255, floor(value)*100/65535*255)))::INT AS value FROM bands')
def au15b(spark, sf_dir):
    b = fx.bands(spark, sf_dir).withColumn("value", F.floor("value") * 100.0)
    return audit.normalize_bands(b, "uint16").drop("valid")


@query("au16_fill_nodata_median", """
WITH q AS (SELECT tile_id, band, trunc(median(value)) AS m FROM bands WHERE valid GROUP BY ALL)
SELECT b.tile_id, "row", col, b.band, CASE WHEN valid THEN value ELSE coalesce(m,0) END AS value FROM bands b LEFT JOIN q ON q.tile_id=b.tile_id AND q.band=b.band""")
def au16(spark, sf_dir):
    return audit.fill_nodata_median(fx.bands(spark, sf_dir)).drop("valid")


@query("au17_valid_fraction", "SELECT tile_id, round(avg(valid::INT),6) AS valid_fraction, avg(valid::INT)=0 AS no_valid_pixels FROM dirty_ok GROUP BY tile_id")
def au17(spark, sf_dir):
    return rounded(audit.valid_fraction(audit.with_validity(fx.cells_dirty(spark, sf_dir))))


@query("au18_rescale_unit_images", """
WITH x AS (SELECT tile_id, "row", col, band, CASE WHEN tile_id%2=0 THEN value/256 ELSE value END AS value FROM bands),
t AS (SELECT tile_id, max(value) AS m FROM x GROUP BY tile_id)
SELECT tile_id, "row", col, band, floor(greatest(0,least(255, CASE WHEN m<=1.5 THEN value*255 ELSE value END)))::INT AS value FROM x JOIN t USING (tile_id)""")
def au18(spark, sf_dir):
    b = fx.bands(spark, sf_dir).drop("valid")
    return audit.rescale_unit_images(b.withColumn("value", F.when(F.col("tile_id") % 2 == 0, F.col("value") / 256).otherwise(F.col("value"))))


@query("au19_standardize_bands", 'SELECT tile_id, "row", col, band, round((value/255 - [0.485,0.456,0.406][band+1]::DOUBLE)/[0.229,0.224,0.225][band+1]::DOUBLE, 6) AS value FROM bands')
def au19(spark, sf_dir):
    return rounded(audit.standardize_bands(fx.bands(spark, sf_dir)).drop("valid"))


@query("au20_prediction_gate", """
WITH p AS (SELECT tile_id, "row", col, CASE WHEN tile_id=1 THEN 5.0 WHEN tile_id=2 AND k=7 THEN 'nan'::DOUBLE ELSE pred_height END AS h, CASE WHEN tile_id=3 AND k=5 THEN 9 ELSE pred_class END AS c FROM pred),
s AS (SELECT tile_id, count(*)<>(max("row")+1)*(max(col)+1) AS a, bool_or(isnan(h)) AS b, coalesce(stddev_pop(CASE WHEN NOT isnan(h) THEN h END),0)<=1e-8 AS d, bool_or(c NOT BETWEEN 0 AND 6) AS e FROM p GROUP BY tile_id)
SELECT tile_id, array_to_string(list_filter([CASE WHEN a THEN 'missing_cells' END, CASE WHEN b THEN 'non_finite' END, CASE WHEN d THEN 'constant_height' END, CASE WHEN e THEN 'class_out_of_range' END], lambda x: x IS NOT NULL), ',') AS problems FROM s""")
def au20(spark, sf_dir):
    p = fx.pred(spark, sf_dir)
    t, k = F.col("tile_id"), F.col("k")
    bad = p.withColumn("pred_height", F.when(t == 1, 5.0).when((t == 2) & (k == 7), float("nan")).otherwise(F.col("pred_height")))
    bad = bad.withColumn("pred_class", F.when((t == 3) & (k == 5), 9).otherwise(F.col("pred_class")))
    return audit.prediction_gate(bad).select("tile_id", F.array_join("problems", ",").alias("problems"))


@query("au21_non_finite_report", f"""SELECT 'height' AS "column", count(*) FILTER (NOT ({_FIN})) AS non_finite FROM cells_dirty
UNION ALL SELECT 'class', count(*) FILTER (class IS NULL) FROM cells_dirty UNION ALL SELECT 'boundary', count(*) FILTER (boundary IS NULL) FROM cells_dirty""")
def au21(spark, sf_dir):
    return audit.non_finite_report(fx.cells_dirty(spark, sf_dir).select("height", "class", "boundary"))


@query("au22_class_fractions", f"SELECT tile_id, {', '.join(f'round(avg((class={c})::INT),6) AS {n}' for c, n in enumerate(CLASS_NAMES))} FROM cells GROUP BY tile_id")
def au22(spark, sf_dir):
    return rounded(audit.class_fractions(fx.cells(spark, sf_dir)))


@query("au23_height_range", f"""
WITH h AS (SELECT tile_id, "row", col, valid, CASE WHEN valid THEN greatest(height-40,0) ELSE 0 END AS height FROM dirty_ok),
l AS (SELECT tile_id, min(height) FILTER (valid) AS min_height, max(height) FILTER (valid) AS max_height FROM h GROUP BY tile_id)
SELECT tile_id, "row", col, round(height,6) AS height, round(min_height,6) AS min_height, round(max_height,6) AS max_height, floor(greatest(0,least(255,height/greatest(max_height,1e-6)*255)))::INT AS preview FROM h JOIN l USING (tile_id)""")
def au23(spark, sf_dir):
    c = audit.with_validity(fx.cells_dirty(spark, sf_dir)).withColumn("height", F.col("height") - 40)
    return rounded(audit.height_range(c).select("tile_id", "row", "col", "height", "min_height", "max_height", "preview"))
