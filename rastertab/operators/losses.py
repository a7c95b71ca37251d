"""Training losses as evaluation sums per tile (scoring only)."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rastertab.functions.columns import ratio
from rastertab.functions.grid import drop_neighbours, stencil
from rastertab.operators.metrics import edge_of
from rastertab.schema import BUILDING, CLASS_COUNT


def smooth_l1(error: Column, beta: float) -> Column:
    size = F.abs(error)
    return F.when(size < beta, 0.5 * size * size / beta).otherwise(size - 0.5 * beta)


def _softplus(x: Column) -> Column:
    return F.greatest(x, F.lit(0.0)) + F.log1p(F.exp(-F.abs(x)))


def gradient_report(pred: DataFrame) -> DataFrame:
    """Forward differences dx, dy of reference and prediction; NULL unless both ends are valid."""
    rows = stencil(pred, ["height", "pred_height", "valid"], diagonals=False)
    out = rows
    for name, d in (("dx", "r"), ("dy", "d")):
        both = F.col("valid") & F.coalesce(F.col(f"n_{d}.valid"), F.lit(False))
        out = out.withColumn(name, F.when(both, F.col(f"n_{d}.height") - F.col("height")))
        out = out.withColumn(f"pred_{name}", F.when(both, F.col(f"n_{d}.pred_height") - F.col("pred_height")))
    return drop_neighbours(out)


def loss_report(
    pred: DataFrame,
    class_weights: Sequence[float] | None = None,
    beta: float = 0.05,
    height_scale: float = 1.0,
    semantic_weight: float = 0.35,
    boundary_weight: float = 0.25,
) -> DataFrame:
    """Height, gradient, log-height, cross-entropy, Dice and boundary losses per tile and their total.

    Needs ``logits ARRAY<DOUBLE>`` of seven scores and ``pred_boundary_logit``. Heights are divided
    by ``height_scale`` except in the log term. One stencil shuffle, one aggregation.
    """
    rows = stencil(
        pred.withColumn("_b", F.col("class") == BUILDING), ["height", "pred_height", "valid", "_b"], diagonals=False
    )
    valid = F.col("valid").cast("double")
    t, p = F.col("height") / height_scale, F.col("pred_height") / height_scale

    def gradient(d: str) -> tuple[Column, Column]:
        both = F.col("valid") & F.coalesce(F.col(f"n_{d}.valid"), F.lit(False))
        diff = (F.col(f"n_{d}.pred_height") / height_scale - p) - (F.col(f"n_{d}.height") / height_scale - t)
        return F.sum(F.when(both, F.abs(diff))), F.count_if(both)

    top = F.array_max("logits")
    scale = F.aggregate("logits", F.lit(0.0), lambda a, x: a + F.exp(x - top))
    log_norm = top + F.log(scale)
    own = F.element_at("logits", (F.col("class") + 1).cast("int"))
    weights = class_weights or [1.0] * CLASS_COUNT
    own_weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (F.col("class") + 1).cast("int"))
    edge = edge_of("_b").cast("double")
    x = F.col("pred_boundary_logit")
    pixel_weight = (1.0 + 1.25 * F.col("_b").cast("double") + 0.75 * (t > 0.15).cast("double")) * valid
    gx, nx = gradient("r")
    gy, ny = gradient("d")
    aggs = {
        "_n": F.sum(valid),
        "_w": F.sum(pixel_weight),
        "_h": F.sum(smooth_l1(p - t, beta) * pixel_weight),
        "_plain": F.sum(smooth_l1(p - t, beta) * valid),
        "_gx": gx, "_nx": nx, "_gy": gy, "_ny": ny,
        "_log": F.sum(F.abs(F.log1p("pred_height") - F.log1p("height")) * valid),
        "_ce": F.sum((log_norm - own) * own_weight * valid),
        "_pos": F.sum(edge),
        "_neg": F.sum(valid - edge * valid),
        "_bt": F.sum(edge * _softplus(-x) * valid),
        "_bf": F.sum((1.0 - edge) * _softplus(x) * valid),
    }
    for c in range(CLASS_COUNT):
        prob = F.exp(F.element_at("logits", c + 1) - log_norm)
        hot = (F.col("class") == c).cast("double")
        aggs[f"_d{c}"] = F.sum(prob * hot * valid)
        aggs[f"_p{c}"] = F.sum(prob * valid)
        aggs[f"_t{c}"] = F.sum(hot * valid)
    sums = rows.groupBy("tile_id").agg(*[c.alias(n) for n, c in aggs.items()])

    def per(num: str, den: str) -> Column:
        return F.coalesce(F.col(num), F.lit(0.0)) / F.greatest(F.col(den).cast("double"), F.lit(1.0))

    dice = sum(
        ((2 * F.col(f"_d{c}") + 1e-5) / (F.col(f"_p{c}") + F.col(f"_t{c}") + 1e-5) for c in range(CLASS_COUNT)),
        F.lit(0.0),
    )
    positive_weight = F.greatest(
        F.lit(1.0),
        F.least(F.lit(20.0), F.greatest("_neg", F.lit(1.0)) / F.greatest("_pos", F.lit(1.0))),
    )
    out = sums.select(
        "tile_id",
        F.coalesce(ratio("_h", "_w"), F.lit(0.0)).alias("height"),
        per("_plain", "_n").alias("smooth_l1"),
        (per("_gx", "_nx") + per("_gy", "_ny")).alias("gradient"),
        per("_log", "_n").alias("log"),
        per("_ce", "_n").alias("cross_entropy"),
        (1.0 - dice / CLASS_COUNT).alias("dice"),
        ((positive_weight * F.col("_bt") + F.col("_bf")) / F.greatest("_n", F.lit(1.0))).alias("boundary"),
    )
    total = (
        F.col("height") + 0.20 * F.col("gradient") + 0.10 * F.col("log")
        + semantic_weight * (F.col("cross_entropy") + 0.5 * F.col("dice"))
        + boundary_weight * F.col("boundary")
    )
    return out.withColumn("total", total)


def target_weighted_smooth_l1(
    pred: DataFrame, by: Sequence[str] = ("tile_id",), beta: float = 1.0, tall: float = 15.0, weight: float = 3.0
) -> DataFrame:
    """Mean smooth-L1 with extra weight on tall targets."""
    w = F.when(F.col("height") > tall, F.lit(weight)).otherwise(F.lit(1.0))
    loss = smooth_l1(F.col("pred_height") - F.col("height"), beta) * w
    return pred.groupBy(*by).agg(F.avg(loss).alias("loss"))
