"""Evaluation queries (survey group 2.9)."""

from __future__ import annotations

from pyspark.sql import functions as F

from rastertab.operators import losses, metrics, reports
from rastertab.plans import fixtures as fx
from rastertab.plans.registry import quantile_sql, query, rounded
from rastertab.schema import CLASS_COUNT, CLASS_NAMES

_H = "sqrt(avg((pred_height-height)^2)) AS rmse, avg(abs(pred_height-height)) AS mae, corr(pred_height,height) AS correlation, count(*) AS n"


def _r(*names: str, digits: int = 6) -> str:
    return ", ".join(f"round({n}, {digits}) AS {n}" for n in names)


@query("flagship_landscape_scores", f"""
WITH h AS (SELECT landscape, {_H} FROM pred GROUP BY landscape),
u AS (SELECT landscape, {", ".join(f"count(*) FILTER (class={c} AND pred_class={c})::DOUBLE / nullif(count(*) FILTER (class={c} OR pred_class={c}),0) AS iou_{CLASS_NAMES[c]}" for c in range(7))}
 FROM pred GROUP BY landscape)
SELECT landscape, {_r("rmse", "mae", "correlation")}, n, {_r(*[f"iou_{n}" for n in CLASS_NAMES])} FROM h JOIN u USING (landscape)""")
def flagship(spark, sf_dir):
    p = fx.pred(spark, sf_dir)
    heights = metrics.height_metrics(p, ["landscape"])
    iou = metrics.class_iou(p, ["landscape"]).groupBy("landscape").agg(
        *[F.max(F.when(F.col("class") == c, F.col("iou"))).alias(f"iou_{CLASS_NAMES[c]}") for c in range(CLASS_COUNT)]
    )
    return rounded(heights.join(iou, "landscape"))


@query("mt01_height_metrics", f"SELECT tile_id, {_r('rmse', 'mae', 'correlation')}, n FROM (SELECT tile_id, {_H} FROM pred GROUP BY tile_id)")
def mt01(spark, sf_dir):
    return rounded(metrics.height_metrics(fx.pred(spark, sf_dir)))


@query("mt02_pooled_metrics", f"""SELECT split, {_r('rmse', 'mae', digits=4)}, round(correlation,6) AS correlation, n FROM
(SELECT l_returnflag || l_linestatus AS split, {_H} FROM pairs GROUP BY 1)""")
def mt02(spark, sf_dir):
    p = fx.pairs(spark, sf_dir).withColumn("split", F.concat("l_returnflag", "l_linestatus"))
    out = metrics.pooled_metrics(p)
    return out.select("split", F.round("rmse", 4).alias("rmse"), F.round("mae", 4).alias("mae"),
                      F.round("correlation", 6).alias("correlation"), "n")


@query("mt03_masked_metrics", f"""
WITH m AS (SELECT *, unnest(list_filter(['all', CASE WHEN class=1 THEN 'ground' END, CASE WHEN class<>1 THEN 'non_ground' END,
 CASE WHEN class=3 THEN 'building' END, CASE WHEN height>=10 THEN 'tall_structure' END, CASE WHEN height>=0 AND height<2 THEN '0_2m' END,
 CASE WHEN height>=2 AND height<10 THEN '2_10m' END, CASE WHEN height>=10 THEN '10m_plus' END], lambda x: x IS NOT NULL)) AS mask FROM pred)
SELECT mask, {_r('rmse', 'mae', 'correlation')}, n FROM (SELECT mask, {_H} FROM m GROUP BY mask)""")
def mt03(spark, sf_dir):
    return rounded(metrics.masked_metrics(fx.pred(spark, sf_dir)))


@query("mt04_confusion_matrix", f"""SELECT t.target, {", ".join(f"count(p.class) FILTER (p.pred_class={c}) AS p{c}" for c in range(7))}
FROM (SELECT unnest(range(7))::INT AS target) t LEFT JOIN pred p ON p.class = t.target GROUP BY t.target""")
def mt04(spark, sf_dir):
    return metrics.confusion_matrix(fx.pred(spark, sf_dir))


@query("mt04_confusion_labels", """SELECT quality AS target, count(*) FILTER (toxic=0) AS p0, count(*) FILTER (toxic=1) AS p1 FROM labels GROUP BY quality""")
def mt04_labels(spark, sf_dir):
    b = fx.table(spark, sf_dir, "labels").select(F.col("quality").alias("class"), F.col("toxic").alias("pred_class"), F.lit(0).alias("g"))
    return metrics.confusion_matrix(b, ["g"]).select("target", "p0", "p1")


@query("mt05_class_iou", """
WITH g AS (SELECT DISTINCT landscape FROM pred), n AS (SELECT unnest(range(7))::INT AS class),
s AS (SELECT p.landscape, n.class, count(*) FILTER (p.class=n.class AND p.pred_class=n.class) AS intersection,
 count(*) FILTER (p.class=n.class OR p.pred_class=n.class) AS "union" FROM pred p, n GROUP BY ALL)
SELECT landscape, class, intersection, "union", round(intersection::DOUBLE / nullif("union",0), 6) AS iou FROM s""")
def mt05(spark, sf_dir):
    return rounded(metrics.class_iou(fx.pred(spark, sf_dir), ["landscape"]).drop("name"))


@query("mt06_mean_iou", """
WITH n AS (SELECT unnest(range(7))::INT AS class),
s AS (SELECT p.tile_id, n.class, count(*) FILTER (p.class=n.class AND p.pred_class=n.class) AS i,
 count(*) FILTER (p.class=n.class OR p.pred_class=n.class) AS u FROM pred p, n GROUP BY ALL)
SELECT tile_id, round(avg(i::DOUBLE/nullif(u,0)),6) AS mean_iou, count(i::DOUBLE/nullif(u,0)) AS n_classes FROM s GROUP BY tile_id""")
def mt06(spark, sf_dir):
    return rounded(metrics.mean_iou(fx.pred(spark, sf_dir)))


_B = """count(*) FILTER (class=3 AND pred_class=3) AS tp, count(*) FILTER (pred_class=3) AS predicted, count(*) FILTER (class=3) AS target"""
_S = """tile_id, tp, predicted, target, round(tp::DOUBLE/nullif(predicted+target-tp,0),6) AS iou, round(tp::DOUBLE/nullif(predicted,0),6) AS precision,
 round(tp::DOUBLE/nullif(target,0),6) AS recall, round(2.0*tp/nullif(predicted+target,0),6) AS f1"""


@query("mt07_building_scores", f"SELECT {_S} FROM (SELECT tile_id, {_B} FROM pred GROUP BY tile_id)")
def mt07(spark, sf_dir):
    return rounded(metrics.building_scores(fx.pred(spark, sf_dir)))


@query("mt07_binary_labels", """SELECT round(tp::DOUBLE/nullif(predicted+target-tp,0),6) AS iou, round(2.0*tp/nullif(predicted+target,0),6) AS f1, tp, predicted, target
FROM (SELECT count(*) FILTER (quality=1 AND toxic=1) AS tp, count(*) FILTER (toxic=1) AS predicted, count(*) FILTER (quality=1) AS target FROM labels)""")
def mt07_labels(spark, sf_dir):
    b = fx.table(spark, sf_dir, "labels").select(F.col("quality").alias("class"), F.col("toxic").alias("pred_class"))
    return rounded(metrics.building_scores(b, [], class_id=1).select("iou", "f1", "tp", "predicted", "target"))


_EDGE = """count(*) FILTER (target_edge AND pred_edge) AS tp, count(*) FILTER (pred_edge) AS predicted, count(*) FILTER (target_edge) AS target"""


@query("mt08_boundary_f1", f"SELECT tile_id, tp, predicted, target, round(2.0*tp/nullif(predicted+target,0),6) AS f1 FROM (SELECT tile_id, {_EDGE} FROM edges GROUP BY tile_id)")
def mt08(spark, sf_dir):
    return rounded(metrics.boundary_f1(fx.pred(spark, sf_dir)))


@query("mt09_boundary_f1_tolerant", """
WITH sh AS (SELECT tile_id, max("row")+1 AS rs, max(col)+1 AS cs FROM cells GROUP BY tile_id),
near AS (SELECT DISTINCT e.tile_id, (e."row"+dr+rs)%rs AS "row", (e.col+dc+cs)%cs AS col FROM edges e JOIN sh USING (tile_id),
 (SELECT dr, dc FROM off9 WHERE dr=0 OR dc=0) WHERE target_edge),
s AS (SELECT e.tile_id, count(*) FILTER (pred_edge AND n.tile_id IS NOT NULL) AS tp, count(*) FILTER (pred_edge) AS predicted,
 count(*) FILTER (target_edge) AS target FROM edges e LEFT JOIN near n ON n.tile_id=e.tile_id AND n."row"=e."row" AND n.col=e.col GROUP BY e.tile_id)
SELECT tile_id, tp, predicted, target, round(2.0*tp/greatest(predicted+target,1),6) AS f1 FROM s""")
def mt09(spark, sf_dir):
    return rounded(metrics.boundary_f1_tolerant(fx.pred(spark, sf_dir)))


@query("mt10_height_boundary_f1", f"""
WITH q AS (SELECT tile_id, greatest({quantile_sql("height", 0.72)}, 0.75) AS th FROM pred GROUP BY tile_id),
m AS (SELECT p.tile_id, "row", col, height>=th AS a, pred_height>=th AS b FROM pred p JOIN q USING (tile_id)),
e AS (SELECT m.tile_id, a AND (SELECT count(*) FROM off4 o JOIN m n ON n.tile_id=m.tile_id AND n."row"=m."row"+dr AND n.col=m.col+dc WHERE n.a)<4 AS ta,
 b AND (SELECT count(*) FROM off4 o JOIN m n ON n.tile_id=m.tile_id AND n."row"=m."row"+dr AND n.col=m.col+dc WHERE n.b)<4 AS tb FROM m)
SELECT tile_id, tp, predicted, target, round(coalesce(2.0*tp/nullif(predicted+target,0),0),6) AS f1 FROM
(SELECT tile_id, count(*) FILTER (ta AND tb) AS tp, count(*) FILTER (tb) AS predicted, count(*) FILTER (ta) AS target FROM e GROUP BY tile_id)""")
def mt10(spark, sf_dir):
    return rounded(metrics.height_boundary_f1(fx.pred(spark, sf_dir)))


@query("mt11_boundary_head_f1", """SELECT tile_id, tp, predicted, target, round(2.0*tp/nullif(predicted+target,0),6) AS f1 FROM
(SELECT tile_id, count(*) FILTER (target_edge AND pred_boundary_logit>=0) AS tp, count(*) FILTER (pred_boundary_logit>=0) AS predicted,
 count(*) FILTER (target_edge) AS target FROM edges GROUP BY tile_id)""")
def mt11(spark, sf_dir):
    return rounded(metrics.boundary_head_f1(fx.pred(spark, sf_dir)))


@query("mt12_footprint_f1", f"SELECT tile_id, round(2.0*tp/nullif(predicted+target,0),6) AS footprint_f1 FROM (SELECT tile_id, {_B} FROM pred GROUP BY tile_id)")
def mt12(spark, sf_dir):
    return rounded(metrics.footprint_f1(fx.pred(spark, sf_dir)))


def _tiles(spark, sf_dir):
    return metrics.tile_metrics(fx.pred(spark, sf_dir))


_M = metrics.TILE_METRICS


@query("mt13_tile_metrics", f"""SELECT tile_id, landscape, {_r(*_M)}, valid_pixels,
{", ".join(f"round(iou{c},6) AS iou_{n}" for c, n in enumerate(CLASS_NAMES))} FROM tiles""")
def mt13(spark, sf_dir):
    flat = [F.col("per_class_iou")[n].alias(f"iou_{n}") for n in CLASS_NAMES]
    t = _tiles(spark, sf_dir)
    return rounded(t.select(*[c for c in t.columns if c != "per_class_iou"], *flat))


_MACRO = (
    ", ".join(f"round(avg({m}),6) AS macro_{m}, round(stddev_pop({m}),6) AS std_{m}" for m in _M)
    + ", sum(valid_pixels)::BIGINT AS pooled_valid_pixels, "
    + ", ".join(f"round(avg(iou{c}),6) AS iou_{n}" for c, n in enumerate(CLASS_NAMES))
    + ", count(*) AS sample_count"
)


@query("mt14_macro_metrics", f"SELECT {_MACRO} FROM tiles")
def mt14(spark, sf_dir):
    return rounded(reports.macro_metrics(_tiles(spark, sf_dir)))


@query("mt15_by_group", f"SELECT landscape, {_MACRO} FROM tiles GROUP BY ROLLUP (landscape)")
def mt15(spark, sf_dir):
    return rounded(reports.by_group(_tiles(spark, sf_dir)))


_WEIGHT = "+".join(f"(u>={c!r}::DOUBLE)::INT" for c in reports.poisson_steps())
_MEANS = " UNION ALL ".join(f"SELECT '{m}' AS metric, sum(w*{m})/nullif(sum(w) FILTER ({m} IS NOT NULL),0) AS mean FROM wt GROUP BY r" for m in _M)


@query("mt16_bootstrap_ci", f"""WITH ab AS (SELECT *, ('0x'||md5(tile_id||'|7')[1:7])::BIGINT AS a, ('0x'||md5(tile_id||'|7')[8:14])::BIGINT AS b FROM tiles),
un AS (SELECT *, ((a+r*b)%{reports.RESIDUES})/{reports.RESIDUES}.0::DOUBLE AS u FROM ab, (SELECT unnest(range(1,1001)) AS r)), wt AS (SELECT *, {_WEIGHT} AS w FROM un), ms AS ({_MEANS})
SELECT metric, round(quantile_cont(mean,0.025),6) AS low, round(quantile_cont(mean,0.975),6) AS high, 0.95::DOUBLE AS confidence FROM ms WHERE mean IS NOT NULL GROUP BY metric""")
def mt16(spark, sf_dir):
    return rounded(reports.bootstrap_ci(_tiles(spark, sf_dir)))


@query("mt17_landscape_report", f"SELECT landscape, {', '.join(f'round(avg({m}),6) AS {m}' for m in ('rmse', 'mae', 'correlation'))}, count(*) AS num_samples FROM tiles GROUP BY landscape")
def mt17(spark, sf_dir):
    return rounded(reports.landscape_report(_tiles(spark, sf_dir)))


@query("mt18_ecdf", """SELECT event_id, rmse, rank, round(rank::DOUBLE / count(*) OVER (), 6) AS ecdf FROM
(SELECT event_id, round(value,1) AS rmse, min(rnk) OVER (PARTITION BY round(value,1)) AS rank FROM
 (SELECT event_id, value, row_number() OVER (ORDER BY round(value,1)) AS rnk FROM events))""")
def mt18(spark, sf_dir):
    """Ranks of equal values are an arbitrary order, so the first rank of each value is compared."""
    e = fx.table(spark, sf_dir, "events").select("event_id", F.round("value", 1).alias("rmse"))
    out = reports.ecdf(e, "rmse", tie="event_id").withColumn("n", F.round(F.col("rank") / F.col("ecdf")).cast("bigint"))
    first = out.groupBy("rmse").agg(F.min("rank").alias("rank"), F.first("n").alias("n"))
    out = out.select("event_id", "rmse").join(first, "rmse")
    return out.select("event_id", "rmse", "rank", F.round(F.col("rank") / F.col("n"), 6).alias("ecdf"))


def _event_errors(spark, sf_dir):
    return fx.table(spark, sf_dir, "events").select(F.col("event_id").alias("tile_id"), F.col("value").alias("rmse"))


@query("mt19_error_summary", "SELECT round(median(value),6) AS median, round(quantile_cont(value,0.9),6) AS p90, round(avg(value),6) AS mean, max(value) AS worst FROM events")
def mt19(spark, sf_dir):
    return rounded(reports.error_summary(_event_errors(spark, sf_dir)))


@query("mt19_error_histogram", """
WITH l AS (SELECT min(value) AS lo, max(value) AS hi FROM events),
c AS (SELECT least(floor((value-lo)*30/(hi-lo))+1, 30)::BIGINT AS bin, count(*) AS tiles FROM events, l GROUP BY 1)
SELECT b.bin, coalesce(tiles,0) AS tiles FROM (SELECT unnest(range(1,31)) AS bin) b LEFT JOIN c USING (bin)""")
def mt19_hist(spark, sf_dir):
    return reports.error_histogram(_event_errors(spark, sf_dir))


@query("mt19_worst_tiles", "SELECT event_id AS tile_id, value AS rmse FROM events ORDER BY value DESC, event_id LIMIT 10")
def mt19_worst(spark, sf_dir):
    return reports.worst_tiles(_event_errors(spark, sf_dir))


@query("mt20_best_epoch", """SELECT run_id, epoch, rmse, mae, round(correlation,6) AS correlation FROM history
QUALIFY row_number() OVER (PARTITION BY run_id ORDER BY rmse, mae, correlation DESC, epoch)=1""")
def mt20(spark, sf_dir):
    return rounded(reports.best_epoch(fx.history(spark, sf_dir)))


@query("mt21_early_stop", """
WITH h AS (SELECT *, min(rmse) OVER (PARTITION BY run_id ORDER BY epoch ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS bf FROM history),
i AS (SELECT *, max(CASE WHEN bf IS NULL OR rmse<bf THEN epoch END) OVER (PARTITION BY run_id ORDER BY epoch ROWS UNBOUNDED PRECEDING) AS lst FROM h),
s AS (SELECT run_id, min(epoch) FILTER (epoch-lst>=10) AS stop_epoch, max(lst) AS fin FROM i GROUP BY run_id)
SELECT s.run_id, s.stop_epoch, coalesce(i.lst, s.fin) AS best_epoch FROM s LEFT JOIN i ON i.run_id=s.run_id AND i.epoch=s.stop_epoch""")
def mt21(spark, sf_dir):
    return reports.early_stop(fx.history(spark, sf_dir))


@query("mt22_compare_models", """
WITH m AS (SELECT CASE WHEN tile_id%2=0 THEN 'base' ELSE 'tuned' END AS model, rmse, mae, correlation FROM tiles),
a AS (SELECT model, avg(rmse) AS rmse, avg(mae) AS mae, avg(correlation) AS correlation, count(*) AS n FROM m GROUP BY model)
SELECT model, round(rmse,6) AS rmse, round(mae,6) AS mae, round(correlation,6) AS correlation, n,
 round(rmse/(SELECT rmse FROM a WHERE model='base'),6) AS rmse_ratio FROM a""")
def mt22(spark, sf_dir):
    t = _tiles(spark, sf_dir).withColumn("model", F.when(F.col("tile_id") % 2 == 0, "base").otherwise("tuned"))
    return rounded(reports.compare_models(t, "base"))


@query("mt23_split_table", """
WITH m AS (SELECT CASE WHEN tile_id%2=0 THEN 'val' ELSE 'test' END AS split, avg(rmse) AS macro_rmse, avg(semantic_miou) AS macro_semantic_miou FROM tiles GROUP BY 1)
SELECT metric, direction, round(max(v) FILTER (split='val'),6) AS validation, round(max(v) FILTER (split='test'),6) AS test FROM
(SELECT split, 'macro_rmse' AS metric, 'lower better' AS direction, macro_rmse AS v FROM m UNION ALL
 SELECT split, 'macro_semantic_miou', 'higher better', macro_semantic_miou FROM m) GROUP BY metric, direction""")
def mt23(spark, sf_dir):
    t = _tiles(spark, sf_dir).withColumn("split", F.when(F.col("tile_id") % 2 == 0, "val").otherwise("test"))
    macro = t.groupBy("split").agg(F.avg("rmse").alias("macro_rmse"), F.avg("semantic_miou").alias("macro_semantic_miou"))
    return rounded(reports.split_table(macro, {"macro_rmse": "lower better", "macro_semantic_miou": "higher better"}))


@query("mt24_class_iou_distribution", f"""
WITH r AS ({" UNION ALL ".join(f"SELECT '{n}' AS name, iou{c} AS iou FROM tiles" for c, n in enumerate(CLASS_NAMES))}),
m AS (SELECT name, median(iou) AS median, count(iou) AS n FROM r WHERE iou IS NOT NULL GROUP BY name)
SELECT name, round(median,6) AS median, n, row_number() OVER (ORDER BY median DESC, name) AS place FROM m""")
def mt24(spark, sf_dir):
    return rounded(reports.class_iou_distribution(_tiles(spark, sf_dir)))


@query("mt25_building_deep_dive", """SELECT count(building_iou) AS with_buildings, count(*)-count(building_iou) AS without_buildings,
round(avg((building_iou>=0.5)::INT),6) AS share_half, round(corr(building_iou,building_f1),6) AS correlation, round(median(building_iou),6) AS median_iou FROM tiles""")
def mt25(spark, sf_dir):
    return rounded(reports.building_deep_dive(_tiles(spark, sf_dir)))


def _with_logits(spark, sf_dir):
    score = lambda c: F.when(F.col("pred_class") == c, F.lit(2.0)).otherwise(F.lit(0.0)) + ((F.col("k") * (c + 1)) % 7) / 10.0
    return fx.pred(spark, sf_dir).withColumn("logits", F.array(*[score(c) for c in range(CLASS_COUNT)]))


_LG = ", ".join(f"(CASE WHEN pred_class={c} THEN 2.0 ELSE 0.0 END + ((k*{c + 1})%7)/10.0)::DOUBLE" for c in range(7))


@query("mt26_loss_report", f"""
WITH l AS (SELECT *, [{_LG}] AS lg, class=3 AS bld, CASE WHEN target_edge THEN 1.0 ELSE 0.0 END AS ed FROM edges),
z AS (SELECT *, ln(list_sum(list_transform(lg, lambda x: exp(x)))) AS nrm, 1+1.25*bld::INT+0.75*(height>0.15)::INT AS w,
 CASE WHEN abs(pred_height-height)<0.05 THEN 0.5*(pred_height-height)^2/0.05 ELSE abs(pred_height-height)-0.025 END AS sl,
 greatest(pred_boundary_logit,0)+ln(1+exp(-abs(pred_boundary_logit))) AS spx, greatest(-pred_boundary_logit,0)+ln(1+exp(-abs(pred_boundary_logit))) AS smx FROM l),
g AS (SELECT a.tile_id, avg(abs((b.pred_height-a.pred_height)-(b.height-a.height))) FILTER (b.col=a.col+1) AS gx,
 avg(abs((b.pred_height-a.pred_height)-(b.height-a.height))) FILTER (b."row"=a."row"+1) AS gy
 FROM pred a JOIN pred b ON a.tile_id=b.tile_id AND ((b.col=a.col+1 AND b."row"=a."row") OR (b.col=a.col AND b."row"=a."row"+1)) GROUP BY a.tile_id),
s AS (SELECT tile_id, sum(sl*w)/sum(w) AS height, avg(sl) AS smooth_l1, avg(abs(ln(1+pred_height)-ln(1+height))) AS log,
 avg(nrm-lg[class+1]) AS cross_entropy, 1-({" + ".join(f"(2*sum(CASE WHEN class={c} THEN exp(lg[{c + 1}]-nrm) ELSE 0 END)+1e-5)/(sum(exp(lg[{c + 1}]-nrm))+count(*) FILTER (class={c})+1e-5)" for c in range(7))})/7 AS dice,
 (least(20,greatest(1,greatest(sum(1-ed),1)/greatest(sum(ed),1)))*sum(ed*smx)+sum((1-ed)*spx))/count(*) AS boundary FROM z GROUP BY tile_id)
SELECT s.tile_id, round(height,6) AS height, round(smooth_l1,6) AS smooth_l1, round(gx+gy,6) AS gradient, round(log,6) AS log,
 round(cross_entropy,6) AS cross_entropy, round(dice,6) AS dice, round(boundary,6) AS boundary,
 round(height+0.2*(gx+gy)+0.1*log+0.35*(cross_entropy+0.5*dice)+0.25*boundary,6) AS total FROM s JOIN g USING (tile_id)""")
def mt26(spark, sf_dir):
    return rounded(losses.loss_report(_with_logits(spark, sf_dir)))


@query("mt26_tall_weighted_loss", """SELECT landscape, round(avg((CASE WHEN abs(pred_height-height)<1 THEN 0.5*(pred_height-height)^2 ELSE abs(pred_height-height)-0.5 END)
* CASE WHEN height>15 THEN 3.0 ELSE 1.0 END),6) AS loss FROM pred GROUP BY landscape""")
def mt26_tall(spark, sf_dir):
    return rounded(losses.target_weighted_smooth_l1(fx.pred(spark, sf_dir), ["landscape"]))
