"""Tile and resampling queries (survey group 2.5)."""

from __future__ import annotations

from pyspark.sql import functions as F

from rastertab.operators import tiles
from rastertab.plans import fixtures as fx
from rastertab.plans.registry import query, rounded, unit_sql

_SH = 'sh AS (SELECT tile_id, max("row")+1 AS rs, max(col)+1 AS cs FROM cells GROUP BY tile_id)'
# Starts of 16-wide tiles with half overlap for each axis length up to 32.
_COVER = f"""{_SH}, tt AS (SELECT tile_id, rs, cs, t.s AS top, l.s AS "left" FROM sh,
 (SELECT unnest(range(0,33)) AS s) t, (SELECT unnest(range(0,33)) AS s) l
 WHERE (t.s = greatest(rs-16,0) OR (t.s%8=0 AND t.s<=rs-16)) AND (l.s = greatest(cs-16,0) OR (l.s%8=0 AND l.s<=cs-16))),
a AS (SELECT c.tile_id, "row", col, height, class, top, "left", "row"-top AS local_row, col-"left" AS local_col FROM cells c JOIN tt ON tt.tile_id=c.tile_id AND "row">=top AND "row"<top+16 AND col>="left" AND col<"left"+16)"""
_HANN = "(0.5-0.5*cos(2*pi()*{}/15))"


@query("tl01_tile_starts", """SELECT doc_id, n_chars, unnest(CASE WHEN n_chars<=518 THEN [0] ELSE list_distinct(list_append(range(0, n_chars-517, 259), n_chars-518)) END)::INT AS start FROM documents""")
def tl01(spark, sf_dir):
    d = fx.table(spark, sf_dir, "documents").select("doc_id", "n_chars")
    return tiles.tile_starts(d, length="n_chars")


def _assigned(spark, sf_dir):
    return tiles.assign_tiles(fx.cells(spark, sf_dir).select("tile_id", "row", "col", "height", "class"), 16, 0.5)


@query("tl02_assign_tiles", f'WITH {_COVER} SELECT * FROM a')
def tl02(spark, sf_dir):
    return _assigned(spark, sf_dir)


@query("tl03_reflect_pad", f"""
WITH {_SH}, n AS (SELECT unnest(range(40)) AS i), g AS (SELECT tile_id, r.i AS "row", c.i AS col, least(r.i%(2*(rs-1)), 2*(rs-1)-r.i%(2*(rs-1))) AS sr, least(c.i%(2*(cs-1)), 2*(cs-1)-c.i%(2*(cs-1))) AS sc FROM sh, n r, n c)
SELECT g.tile_id, g."row"::INT AS "row", g.col::INT AS col, height AS value FROM g JOIN cells s ON s.tile_id=g.tile_id AND s."row"=sr AND s.col=sc""")
def tl03(spark, sf_dir):
    c = fx.cells(spark, sf_dir).select("tile_id", "row", "col", F.col("height").alias("value"))
    return tiles.reflect_pad(c, 40)


@query("tl04_hann_weights", """
WITH h AS (SELECT tile_id, "row", col, 0.5-0.5*cos(2*pi()*"row"/31) AS a, 0.5-0.5*cos(2*pi()*col/31) AS b FROM cells)
SELECT tile_id, "row", col, round(greatest(a*b,1e-3),6) AS product_floor, round(greatest(a,1e-3)*greatest(b,1e-3),6) AS line_floor FROM h""")
def tl04(spark, sf_dir):
    return rounded(fx.cells(spark, sf_dir).select(
        "tile_id", "row", "col", tiles.hann_weight("row", "col", 32).alias("product_floor"),
        tiles.hann_weight("row", "col", 32, "line").alias("line_floor"),
    ))


_W = f"greatest({_HANN.format('local_row')}*{_HANN.format('local_col')},1e-3)"


@query("tl05_mosaic", f"""WITH {_COVER} SELECT tile_id, "row", col, round(sum({_W}*(height+top*0.5))/greatest(sum({_W}),1e-6),6) AS value FROM a GROUP BY tile_id, "row", col""")
def tl05(spark, sf_dir):
    return rounded(tiles.mosaic(_assigned(spark, sf_dir).withColumn("value", F.col("height") + F.col("top") * 0.5), 16))


@query("tl05_mosaic_channels", f"""WITH {_COVER}, ch AS (SELECT *, unnest(range(7))::INT AS channel FROM a)
SELECT tile_id, "row", col, channel, round(sum({_W}*(CASE WHEN class=channel THEN 1.0 ELSE "left"*0.01 END))/sum({_W}),6) AS value FROM ch GROUP BY ALL""")
def tl05b(spark, sf_dir):
    a = _assigned(spark, sf_dir).withColumn("channel", F.explode(F.sequence(F.lit(0), F.lit(6))))
    v = F.when(F.col("class") == F.col("channel"), 1.0).otherwise(F.col("left") * 0.01)
    return rounded(tiles.mosaic(a.withColumn("value", v), 16, by=["channel"]))


@query("tl06_flip_average", f"""WITH {_SH} SELECT c.tile_id, c."row", c.col, round(greatest((c.height-60+m.boundary*20)*0.5,0),6) AS value FROM cells c JOIN sh USING (tile_id) JOIN cells m ON m.tile_id=c.tile_id AND m."row"=c."row" AND m.col=cs-1-c.col""")
def tl06(spark, sf_dir):
    c = fx.cells(spark, sf_dir)
    direct = c.select("tile_id", "row", "col", (F.col("height") - 60).alias("value"))
    mirrored = c.select("tile_id", "row", "col", (F.col("boundary") * 20).alias("value"))
    return rounded(tiles.flip_average(direct, mirrored, floor_zero=True))


@query("tl07_uniform_mosaic", f"""WITH {_COVER} SELECT tile_id, "row", col, round(avg(height+top*0.5),6) AS value FROM a GROUP BY tile_id, "row", col""")
def tl07(spark, sf_dir):
    return rounded(tiles.uniform_mosaic(_assigned(spark, sf_dir).withColumn("value", F.col("height") + F.col("top") * 0.5)))


def _nearest(expr: str) -> str:
    return f"""WITH {_SH}, n AS (SELECT unnest(range(20)) AS i) SELECT sh.tile_id, r.i::INT AS "row", c.i::INT AS col, s.class FROM sh CROSS JOIN n r CROSS JOIN n c
JOIN cells s ON s.tile_id=sh.tile_id AND s."row"={expr.format(t='r.i', n='rs')} AND s.col={expr.format(t='c.i', n='cs')}"""


@query("tl08_resize_nearest_centre", _nearest("((2*{t}+1)*{n})//40"))
def tl08(spark, sf_dir):
    return tiles.resize_nearest(fx.cells(spark, sf_dir).select("tile_id", "row", "col", "class"), 20, 20)


@query("tl08_resize_nearest_corner", _nearest("({t}*{n})//20"))
def tl08b(spark, sf_dir):
    return tiles.resize_nearest(fx.cells(spark, sf_dir).select("tile_id", "row", "col", "class"), 20, 20, "corner")


def _bilinear(n: int, use: str) -> str:
    tri = "greatest(0, 1-abs(({i}+0.5)-({t}+0.5)*{s}::DOUBLE/%d)/greatest({s}::DOUBLE/%d,1))" % (n, n)
    return f"""WITH {_SH}, n AS (SELECT unnest(range({n})) AS i),
w AS (SELECT c.tile_id, r.i AS tr, q.i AS tc, height, {use} AS ok, {tri.format(i='c."row"', t='r.i', s='rs')} * {tri.format(i='c.col', t='q.i', s='cs')} AS w FROM cells c JOIN sh USING (tile_id) CROSS JOIN n r CROSS JOIN n q)
SELECT tile_id, tr::INT AS "row", tc::INT AS col, round(CASE WHEN sum(w) FILTER (ok)/sum(w)>1e-6 THEN sum(w*height) FILTER (ok)/sum(w) FILTER (ok) ELSE 0 END,9) AS value FROM w WHERE w>0 GROUP BY ALL"""


def _valued(spark, sf_dir):
    return fx.cells(spark, sf_dir).select("tile_id", "row", "col", F.col("height").alias("value"), (F.col("k") % 3 != 0).alias("valid"))


@query("tl09_resize_bilinear_down", _bilinear(12, "k%3<>0"))
def tl09(spark, sf_dir):
    return rounded(tiles.resize_bilinear(_valued(spark, sf_dir), 12, 12, valid="valid"), 9)


@query("tl09_resize_bilinear_up", _bilinear(40, "true"))
def tl09b(spark, sf_dir):
    return rounded(tiles.resize_bilinear(_valued(spark, sf_dir), 40, 40), 9)


@query("tl10_argmax_class", """SELECT tile_id, "row", col, first(class ORDER BY logit DESC, class) AS class FROM logits GROUP BY tile_id, "row", col""")
def tl10(spark, sf_dir):
    return tiles.argmax_class(fx.logits(spark, sf_dir))


_P = "CASE WHEN k%7<>0 THEN 1/(1+exp(-greatest(-30,least(30,pred_boundary_logit*20)))) ELSE 0 END"


@query("tl12_boundary_probability", f"""WITH p AS (SELECT tile_id, k%7<>0 AS valid, {_P} AS p FROM pred) SELECT tile_id, round(avg(greatest(p,1-p)) FILTER (valid),6) AS boundary_confidence FROM p GROUP BY tile_id""")
def tl12(spark, sf_dir):
    p = fx.pred(spark, sf_dir).withColumn("valid", F.col("k") % 7 != 0).withColumn("logit", F.col("pred_boundary_logit") * 20)
    return rounded(tiles.boundary_confidence(tiles.boundary_probability(p)))


@query("tl13_dihedral", f"""
WITH {_SH}, f AS (SELECT c.tile_id, height, 0 AS flip, "row" AS r, col AS c, rs, cs FROM cells c JOIN sh USING (tile_id) UNION ALL SELECT c.tile_id, height, 1, "row", cs-1-col, rs, cs FROM cells c JOIN sh USING (tile_id))
SELECT tile_id, height, flip, 0 AS turns, r AS "row", c AS col FROM f UNION ALL SELECT tile_id, height, flip, 1, cs-1-c, r FROM f
UNION ALL SELECT tile_id, height, flip, 2, rs-1-r, cs-1-c FROM f UNION ALL SELECT tile_id, height, flip, 3, c, rs-1-r FROM f""")
def tl13(spark, sf_dir):
    return tiles.dihedral(fx.cells(spark, sf_dir).select("tile_id", "row", "col", "height"))


def _draws_sql() -> str:
    u = lambda i: unit_sql("tile_id", "7", str(i))
    between = lambda i, low, high: f"({low}+({high}-({low}))*{u(i)})"
    cell = lambda i: unit_sql("tile_id", '"row"', "col", "band", "7", str(i))
    return f"""bn AS (SELECT tile_id, "row", col, unnest([0,1,2])::INT AS band, unnest([k*2.5, height/2.0, (k+class*10)::DOUBLE]) AS value FROM cells),
dr AS (SELECT tile_id, band, avg(value) AS mean, any_value({u(1)}<0.6) AS p_gain, any_value({between(2, 0.85, 1.15)}) AS gain, any_value({between(3, -8.0, 8.0)}) AS shift, any_value({u(4)}<0.4) AS p_con, any_value({between(5, 0.9, 1.1)}) AS con,
 any_value({u(6)}<0.25) AS p_gam, any_value({between(7, 0.9, 1.1)}) AS gam, any_value({u(8)}<0.15) AS p_noise FROM bn GROUP BY tile_id, band),
v1 AS (SELECT b.*, p_con, con, p_gam, gam, p_noise, CASE WHEN p_gain THEN value*gain+shift ELSE value END AS v, CASE WHEN p_gain THEN mean*gain+shift ELSE mean END AS mn FROM bn b JOIN dr USING (tile_id, band)),
v2 AS (SELECT * REPLACE (CASE WHEN p_con THEN (v-mn)*con+mn ELSE v END AS v) FROM v1),
v3 AS (SELECT * REPLACE (CASE WHEN p_gam THEN 255.0*pow(greatest(0.0,least(1.0,v/255.0)),gam) ELSE v END AS v) FROM v2),
v4 AS (SELECT * REPLACE (CASE WHEN p_noise THEN v+2.0*(sqrt(-2.0*ln(1.0-{cell(9)}))*cos(2.0*pi()*{cell(10)})) ELSE v END AS v) FROM v3)"""


@query("tl14_photometric", f"""WITH {_draws_sql()} SELECT tile_id, "row", col, band, floor(greatest(0.0,least(255.0,v)))::INT AS value FROM v4""")
def tl14(spark, sf_dir):
    return tiles.photometric(fx.bands(spark, sf_dir).drop("valid"))


@query("tl15_focus_crops", f"""WITH {_SH}, p AS (SELECT tile_id, quantile_cont(height,0.9) AS p90 FROM cells GROUP BY tile_id),
e AS (SELECT c.*, class=3 AS b, class=3 AND (SELECT count(*) FROM off4 o JOIN cells n ON n.tile_id=c.tile_id AND n."row"=c."row"+o.dr AND n.col=c.col+o.dc WHERE n.class=3)<4 AS edge, height>=p90 AS high FROM cells c JOIN p USING (tile_id)),
x AS (SELECT e.*, crop, {unit_sql("tile_id", "crop", "7")} AS u, {unit_sql("tile_id", "crop", '"row"', "col", "7")} AS h FROM e, (SELECT unnest(range(3))::INT AS crop)),
f AS (SELECT *, CASE WHEN u<0.25 THEN 'building' WHEN u<0.4 THEN 'high' WHEN u<0.5 THEN 'edge' ELSE 'valid' END AS focus, CASE WHEN u<0.25 THEN b WHEN u<0.4 THEN high WHEN u<0.5 THEN edge ELSE true END AS fits FROM x),
d AS (SELECT tile_id, crop, focus, first("row" ORDER BY (NOT fits)::INT, h, "row", col) AS r, first(col ORDER BY (NOT fits)::INT, h, "row", col) AS c, bool_or(fits) AS focused FROM f GROUP BY ALL)
SELECT tile_id, crop, focus, (CASE WHEN rs>8 AND cs>8 THEN greatest(0,least(r-4,rs-8)) ELSE greatest(0,floor((rs-8)/2.0)) END)::INT AS top, (CASE WHEN rs>8 AND cs>8 THEN greatest(0,least(c-4,cs-8)) ELSE greatest(0,floor((cs-8)/2.0)) END)::INT AS "left", focused FROM d JOIN sh USING (tile_id)""")
def tl15(spark, sf_dir):
    return tiles.focus_crops(fx.cells(spark, sf_dir).withColumn("valid", F.lit(True)), 8, 3)


@query("tl16_sample_pixels", f"""SELECT tile_id, "row", col FROM (SELECT *, row_number() OVER (PARTITION BY tile_id ORDER BY {unit_sql("tile_id", '"row"', "col", "7")}, "row", col) AS i FROM cells) WHERE i<=100""")
def tl16(spark, sf_dir):
    return tiles.sample_pixels(fx.cells(spark, sf_dir), 100).select("tile_id", "row", "col")
