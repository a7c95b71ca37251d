"""Scores of predicted against reference rasters.

Input: cells with ``height``/``class`` (reference) and ``pred_height``/``pred_class``, optionally a
boolean ``valid``. Undefined scores are NULL; pass the result through ``coalesce`` for the 0.0 that
some callers expect.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rastertab.functions.columns import finite, ratio
from rastertab.functions.grid import attach, stencil, tile_shape
from rastertab.functions.quantiles import exact_quantiles
from rastertab.schema import BUILDING, CLASS_COUNT, CLASS_NAMES, GROUND


def valid_only(pred: DataFrame) -> DataFrame:
    return pred.where("valid") if "valid" in pred.columns else pred


def _count(condition: Column) -> Column:
    return F.count_if(condition)


def height_aggregates(when: Column | None = None) -> dict[str, Column]:
    """rmse, mae, guarded Pearson correlation and count; all of one pass with map-side combine."""
    use = finite("pred_height") & finite("height")
    use = use if when is None else use & when
    p, t = F.when(use, F.col("pred_height")), F.when(use, F.col("height"))
    d = p - t
    spread = F.stddev_pop(p) * F.stddev_pop(t)
    defined = (F.count(d) >= 2) & (F.stddev_pop(p) >= 1e-8) & (F.stddev_pop(t) >= 1e-8)
    return {
        "rmse": F.sqrt(F.avg(d * d)),
        "mae": F.avg(F.abs(d)),
        "correlation": F.when(defined, F.try_divide(F.covar_pop(p, t), spread)),
        "n": F.count(d),
    }


def height_metrics(pred: DataFrame, by: Sequence[str] = ("tile_id",)) -> DataFrame:
    """RMSE, MAE, Pearson r and count over valid pixels per key."""
    aggs = [c.alias(n) for n, c in height_aggregates().items()]
    return valid_only(pred).groupBy(*by).agg(*aggs)


def pooled_metrics(pred: DataFrame, split: str = "split") -> DataFrame:
    """The same scores over all pixels of a split."""
    return height_metrics(pred, [split])


# Names and bounds of the reported masks.
TALL_METRES = 10.0
HEIGHT_RANGES = (("0_2m", 0.0, 2.0), ("2_10m", 2.0, 10.0), ("10m_plus", 10.0, float("inf")))


def masked_metrics(pred: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Scores per mask: all, ground, non_ground, building, tall_structure and three height ranges."""
    masks = [
        ("all", F.lit(True)),
        ("ground", F.col("class") == GROUND),
        ("non_ground", F.col("class") != GROUND),
        ("building", F.col("class") == BUILDING),
        ("tall_structure", F.col("height") >= TALL_METRES),
    ]
    masks += [(n, (F.col("height") >= lo) & (F.col("height") < hi)) for n, lo, hi in HEIGHT_RANGES]
    names = F.filter(F.array(*[F.when(c, F.lit(n)) for n, c in masks]), lambda m: m.isNotNull())
    rows = valid_only(pred).withColumn("mask", F.explode(names))
    return height_metrics(rows.drop("valid"), [*by, "mask"])


def confusion_matrix(pred: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Counts of predicted class (p0..p6) per target class over valid pixels; one row per target class."""
    counted = valid_only(pred).groupBy(*by, F.col("class").alias("target")).agg(
        *[_count(F.col("pred_class") == c).alias(f"p{c}") for c in range(CLASS_COUNT)]
    )
    if by:
        return counted
    ids = pred.sparkSession.range(CLASS_COUNT).select(F.col("id").cast("int").alias("target"))
    return ids.join(counted, "target", "left").na.fill(0)


def class_aggregates() -> dict[str, Column]:
    out = {}
    for c in range(CLASS_COUNT):
        t, p = F.col("class") == c, F.col("pred_class") == c
        out[f"_i{c}"] = _count(t & p)
        out[f"_u{c}"] = _count(t | p)
    return out


def _iou(c: int) -> Column:
    return ratio(F.col(f"_i{c}"), F.col(f"_u{c}"))


def class_iou(pred: DataFrame, by: Sequence[str] = ("tile_id",)) -> DataFrame:
    """Intersection over union per key and class; NULL where the union is empty."""
    sums = valid_only(pred).groupBy(*by).agg(*[c.alias(n) for n, c in class_aggregates().items()])
    entries = F.array(
        *[
            F.struct(
                F.lit(c).alias("class"), F.lit(CLASS_NAMES[c]).alias("name"),
                F.col(f"_i{c}").alias("intersection"), F.col(f"_u{c}").alias("union"), _iou(c).alias("iou"),
            )
            for c in range(CLASS_COUNT)
        ]
    )
    return sums.select(*by, F.inline(entries))


def mean_iou(pred: DataFrame, by: Sequence[str] = ("tile_id",)) -> DataFrame:
    """Mean IoU over the classes with a non-empty union."""
    return class_iou(pred, by).groupBy(*by).agg(F.avg("iou").alias("mean_iou"), F.count("iou").alias("n_classes"))


def building_scores(pred: DataFrame, by: Sequence[str] = ("tile_id",), class_id: int = BUILDING) -> DataFrame:
    """IoU, precision, recall and F1 of the building mask."""
    t, p = F.col("class") == class_id, F.col("pred_class") == class_id
    sums = valid_only(pred).groupBy(*by).agg(
        _count(t & p).alias("tp"), _count(p).alias("predicted"), _count(t).alias("target")
    )
    return sums.select(
        *by, "tp", "predicted", "target",
        ratio("tp", F.col("predicted") + F.col("target") - F.col("tp")).alias("iou"),
        ratio("tp", "predicted").alias("precision"),
        ratio("tp", "target").alias("recall"),
        ratio(2 * F.col("tp"), F.col("predicted") + F.col("target")).alias("f1"),
    )


def footprint_f1(pred: DataFrame, by: Sequence[str] = ("tile_id",)) -> DataFrame:
    """F1 of the building *masks* - the value one trainer reports under the name of a boundary F1."""
    return building_scores(pred, by).select(*by, F.col("f1").alias("footprint_f1"))


def edge_of(name: str) -> Column:
    """After a stencil over a boolean column: true here and false or absent in some 4-neighbour."""
    around = [F.coalesce(F.col(f"n_{d}.{name}"), F.lit(False)) for d in "udlr"]
    inner = around[0] & around[1] & around[2] & around[3]
    return F.coalesce(F.col(name), F.lit(False)) & ~inner


def with_boundaries(pred: DataFrame, masks: dict[str, Column]) -> DataFrame:
    """Replace each named boolean mask by its 4-neighbour boundary, all in one stencil pass."""
    rows = pred
    for name, mask in masks.items():
        rows = rows.withColumn(name, F.coalesce(mask, F.lit(False)))
    rows = stencil(rows, list(masks), diagonals=False)
    edges = {name: edge_of(name) for name in masks}
    return rows.select(*[c for c in rows.columns if c not in masks and not c.startswith("n_")],
                       *[e.alias(n) for n, e in edges.items()])


def building_boundaries(pred: DataFrame) -> DataFrame:
    return with_boundaries(
        pred, {"target_edge": F.col("class") == BUILDING, "pred_edge": F.col("pred_class") == BUILDING}
    )


def _edge_sums(hit: Column, predicted: Column, target: Column) -> list[Column]:
    return [_count(hit).alias("tp"), _count(predicted).alias("predicted"), _count(target).alias("target")]


def _f1() -> Column:
    return ratio(2 * F.col("tp"), F.col("predicted") + F.col("target")).alias("f1")


def boundary_f1(pred: DataFrame, by: Sequence[str] = ("tile_id",)) -> DataFrame:
    """Exact F1 of predicted against target building boundary."""
    e = valid_only(building_boundaries(pred))
    p, t = F.col("pred_edge"), F.col("target_edge")
    return e.groupBy(*by).agg(*_edge_sums(p & t, p, t)).withColumn("f1", _f1())


def dilate4_wrap(mask: DataFrame, shape: DataFrame) -> DataFrame:
    """True cells and their four shifts, wrapping around the tile edge; distinct cell keys.

    ``mask`` holds only the true cells, ``shape`` rows/cols per tile. The wrap-around is what the
    tolerant boundary score does; use it there only.
    """
    moves = [(0, 0), (-1, 0), (1, 0), (0, -1), (0, 1)]
    targets = F.array(
        *[
            F.struct(
                F.pmod(F.col("row") + dr, F.col("rows")).cast("int").alias("row"),
                F.pmod(F.col("col") + dc, F.col("cols")).cast("int").alias("col"),
            )
            for dr, dc in moves
        ]
    )
    return attach(mask, shape, how="inner").select("tile_id", F.inline(targets)).distinct()


def boundary_f1_tolerant(pred: DataFrame) -> DataFrame:
    """As boundary_f1 but a predicted edge counts when it touches the dilated target edge; 0 when empty."""
    e = building_boundaries(pred)
    near = dilate4_wrap(e.where("target_edge").select("tile_id", "row", "col"), tile_shape(pred))
    e = e.join(near.withColumn("near", F.lit(True)), ["tile_id", "row", "col"], "left")
    p = F.col("pred_edge")
    hit = p & F.coalesce(F.col("near"), F.lit(False))
    sums = valid_only(e).groupBy("tile_id").agg(*_edge_sums(hit, p, F.col("target_edge")))
    return sums.withColumn("f1", 2.0 * F.col("tp") / F.greatest(F.col("predicted") + F.col("target"), F.lit(1)))


def height_boundary(cells: DataFrame, reference: str = "height", values: Sequence[str] = ("height",), q: float = 0.72) -> DataFrame:
    """Boundary of {value >= max(q-quantile of the reference, 0.75)} for each value column, as edge_<value>."""
    limits = exact_quantiles(cells, ["tile_id"], reference, {"_p": q}).select(
        "tile_id", F.greatest(F.col("_p"), F.lit(0.75)).alias("threshold")
    )
    rows = attach(cells, limits)
    return with_boundaries(rows, {f"edge_{v}": finite(v) & (F.col(v) >= F.col("threshold")) for v in values})


def height_boundary_f1(pred: DataFrame) -> DataFrame:
    """F1 of height-derived boundaries, both sides cut at the reference threshold; 0 when undefined."""
    e = height_boundary(pred, values=["height", "pred_height"])
    p, t = F.col("edge_pred_height"), F.col("edge_height")
    return e.groupBy("tile_id").agg(*_edge_sums(p & t, p, t)).withColumn("f1", F.coalesce(_f1(), F.lit(0.0)))


def boundary_head_f1(pred: DataFrame, logit: str = "pred_boundary_logit") -> DataFrame:
    """Boundary logit >= 0 against the target building boundary."""
    e = valid_only(with_boundaries(pred, {"target_edge": F.col("class") == BUILDING}))
    p, t = F.col(logit) >= 0.0, F.col("target_edge")
    return e.groupBy("tile_id").agg(*_edge_sums(p & t, p, t)).withColumn("f1", _f1())


# The metrics every tile record carries.
TILE_METRICS = (
    "rmse", "mae", "correlation", "semantic_miou", "building_iou",
    "building_f1", "boundary_f1", "boundary_head_f1",
)


def tile_metrics(pred: DataFrame, group: Sequence[str] = ("landscape",)) -> DataFrame:
    """One row per tile with every score, the per-class IoU map and the valid pixel count.

    One stencil shuffle for both boundaries, then one aggregation by tile with map-side combine.
    """
    rows = valid_only(building_boundaries(pred))
    p, t = F.col("pred_edge"), F.col("target_edge")
    aggs = {**height_aggregates(), **class_aggregates()}
    aggs |= {"_pb": _count(p), "_tb": _count(t), "_hb": _count(p & t)}
    if "pred_boundary_logit" in pred.columns:
        head = F.col("pred_boundary_logit") >= 0.0
        aggs |= {"_ph": _count(head), "_hh": _count(head & t)}
    aggs |= {"_pc": _count(F.col("pred_class") == BUILDING), "_tc": _count(F.col("class") == BUILDING)}
    sums = rows.groupBy("tile_id", *group).agg(*[c.alias(n) for n, c in aggs.items()])
    ious = F.array(*[_iou(c) for c in range(CLASS_COUNT)])
    known = F.filter(ious, lambda v: v.isNotNull())
    mean = F.when(
        F.size(known) > 0, F.aggregate(known, F.lit(0.0), lambda a, v: a + v) / F.size(known)
    )
    by_name = F.map_from_arrays(F.array(*[F.lit(n) for n in CLASS_NAMES]), ious)
    head_f1 = (
        ratio(2 * F.col("_hh"), F.col("_ph") + F.col("_tb")) if "_ph" in aggs else F.lit(None).cast("double")
    )
    return sums.select(
        "tile_id", *group, "rmse", "mae", "correlation",
        by_name.alias("per_class_iou"),
        mean.alias("semantic_miou"),
        _iou(BUILDING).alias("building_iou"),
        ratio(2 * F.col(f"_i{BUILDING}"), F.col("_pc") + F.col("_tc")).alias("building_f1"),
        ratio(2 * F.col("_hb"), F.col("_pb") + F.col("_tb")).alias("boundary_f1"),
        head_f1.alias("boundary_head_f1"),
        F.col("n").alias("valid_pixels"),
    )
