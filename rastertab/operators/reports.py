"""Reports over per-tile metrics and training histories."""

from __future__ import annotations

import math
from collections.abc import Iterator, Mapping, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from rastertab.functions.columns import ratio
from rastertab.functions.quantiles import exact_quantiles
from rastertab.functions.ranking import prefix_extreme, value_rank
from rastertab.functions.state import settle
from rastertab.operators.metrics import TILE_METRICS
from rastertab.schema import CLASS_NAMES


def _macro_aggregates(metrics: Sequence[str]) -> list:
    aggs = []
    for m in metrics:
        aggs += [F.avg(m).alias(f"macro_{m}"), F.stddev_pop(m).alias(f"std_{m}")]
    class_means = [
        F.avg(F.try_element_at("per_class_iou", F.lit(n))).alias(f"iou_{n}") for n in CLASS_NAMES
    ]
    return [*aggs, F.sum("valid_pixels").alias("pooled_valid_pixels"), *class_means,
            F.count(F.lit(1)).alias("sample_count")]


def macro_metrics(tiles: DataFrame, metrics: Sequence[str] = TILE_METRICS) -> DataFrame:
    """Mean and population deviation per metric ignoring undefined values, class means, pooled pixels."""
    return tiles.groupBy().agg(*_macro_aggregates(metrics))


def by_group(tiles: DataFrame, group: str = "landscape", metrics: Sequence[str] = TILE_METRICS) -> DataFrame:
    """Macro metrics overall (group NULL) and per group in one rollup."""
    return tiles.rollup(group).agg(*_macro_aggregates(metrics))


def long_metrics(tiles: DataFrame, metrics: Sequence[str], keep: Sequence[str] = ("tile_id",)) -> DataFrame:
    """(keep…, metric, value), undefined values dropped."""
    entries = F.array(*[F.struct(F.lit(m).alias("metric"), F.col(m).cast("double").alias("value")) for m in metrics])
    return tiles.select(*keep, F.inline(entries)).where(F.col("value").isNotNull())


def poisson_steps(terms: int = 12) -> list[float]:
    """Cumulative Poisson(1) probabilities: a uniform number's weight is how many of them it reaches."""
    total, out = 0.0, []
    for k in range(terms):
        total += math.exp(-1) / math.factorial(k)
        out.append(total)
    return out


RESIDUES = (1 << 31) - 1


REPLICATES = 1 << 20  # weights held at once in a task


def replicate_sums(tiles: DataFrame, metrics: Sequence[str], iterations: int, seed: int) -> DataFrame:
    """(replicate, s_<metric>…, n_<metric>…) partial sums: one row per replicate and task.

    How often a row is drawn in a replicate is a Poisson(1) number from (a + replicate b) mod 2^31 - 1, where a and b are
    28 bits each of the MD5 of the row's key and the seed, so numbers of a replicate are independent and replicates are
    so in pairs.
    """
    text = F.md5(F.concat_ws("|", F.col("tile_id").cast("string"), F.lit(seed).cast("string")).cast("binary"))
    a, b = (F.conv(F.substring(text, at, 7), 16, 10).cast("bigint") for at in (1, 8))
    names = [*(f"s_{m}" for m in metrics), *(f"n_{m}" for m in metrics)]
    steps = np.array(poisson_steps())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, r = None, np.arange(1, iterations + 1)
        for batch in batches:
            held = max(1, REPLICATES // iterations)
            for at in range(0, batch.num_rows, held):
                piece = batch.slice(at, held)
                a, b = (piece.column(i).to_numpy() for i in (0, 1))
                u = ((a[:, None] + r * b[:, None]) % RESIDUES) / float(RESIDUES)
                weights = np.searchsorted(steps, u, side="right").astype(float)
                known = np.column_stack([c.is_valid().to_numpy(zero_copy_only=False) for c in piece.columns[2:]])
                values = np.column_stack([c.fill_null(0.0).to_numpy(zero_copy_only=False) for c in piece.columns[2:]])
                odd = ~np.isfinite(values)  # spoils the replicates that draw the row, and no others
                sums = np.hstack([weights.T @ np.where(odd, 0.0, values), weights.T @ known])
                if odd.any():
                    sums[:, : odd.shape[1]][(weights > 0).astype(float).T @ odd > 0] = np.nan
                total = sums if total is None else total + sums
        if total is not None:
            yield pa.RecordBatch.from_arrays([pa.array(r), *(pa.array(c) for c in total.T)], names=["replicate", *names])

    rows = tiles.select(a.alias("_a"), b.alias("_b"), *(F.col(m).cast("double").alias(m) for m in metrics))
    return rows.mapInArrow(run, ", ".join(["replicate bigint", *(f"{n} double" for n in names)]))


def bootstrap_ci(
    tiles: DataFrame, metrics: Sequence[str] = TILE_METRICS, iterations: int = 1000, seed: int = 7
) -> DataFrame:
    """2.5 and 97.5 percentiles of resampled means per metric.

    **Departure**: instead of n draws from n rows every row gets a Poisson(1) weight per replicate, from a hash; the
    weights of rows need not know of each other, so each task sums its rows into one vector per replicate and only
    those vectors are exchanged. All metrics of a row share its weight. Undefined values take no part.
    """
    parts = replicate_sums(tiles, metrics, iterations, seed)
    names = [c for c in parts.columns if c != "replicate"]
    vectors = settle(parts.groupBy("replicate").agg(*[F.sum(c).alias(c) for c in names]), "replicates")  # a row per replicate, read several times
    entries = F.array(*[F.struct(F.lit(m).alias("metric"), F.try_divide(f"s_{m}", f"n_{m}").alias("mean")) for m in metrics])
    means = vectors.select(F.inline(entries)).where("mean IS NOT NULL")
    return exact_quantiles(means, ["metric"], "mean", {"low": 0.025, "high": 0.975}).withColumn(
        "confidence", F.lit(0.95)
    )


def landscape_report(tiles: DataFrame, group: str = "landscape") -> DataFrame:
    """Mean RMSE, MAE and correlation per landscape type with the number of tiles."""
    return tiles.groupBy(group).agg(
        F.avg("rmse").alias("rmse"), F.avg("mae").alias("mae"), F.avg("correlation").alias("correlation"),
        F.count(F.lit(1)).alias("num_samples"),
    )


def ecdf(tiles: DataFrame, metric: str = "rmse", tie: str = "tile_id") -> DataFrame:
    """rank / n per value; equal values keep separate ranks."""
    ranked = value_rank(tiles.select(tie, metric), [], metric, tie, "rank", "n")
    return ranked.select(tie, metric, "rank", (F.col("rank") / F.col("n")).alias("ecdf"))


def error_summary(tiles: DataFrame, metric: str = "rmse") -> DataFrame:
    """Median, mean, 90th percentile and worst value."""
    quantiles = exact_quantiles(tiles.withColumn("_k", F.lit(0)), ["_k"], metric, {"median": 0.5, "p90": 0.9})
    rest = tiles.groupBy(F.lit(0).alias("_k")).agg(F.avg(metric).alias("mean"), F.max(metric).alias("worst"))
    return quantiles.join(rest, "_k").drop("_k")


def error_histogram(tiles: DataFrame, metric: str = "rmse", bins: int = 30) -> DataFrame:
    """Equal-width counts over min..max, the last bin closed; empty bins included."""
    limits = tiles.agg(F.min(metric).alias("lo"), F.max(metric).alias("hi")).withColumn("_k", F.lit(0))
    values = tiles.where(F.col(metric).isNotNull()).select(F.col(metric).alias("v"), F.lit(0).alias("_k"))
    span = F.col("hi") - F.col("lo")
    at = F.least(F.floor(F.coalesce(F.try_divide((F.col("v") - F.col("lo")) * bins, span), F.lit(bins / 2))) + 1, F.lit(bins))
    counts = values.join(F.broadcast(limits), "_k").groupBy(at.alias("bin")).agg(F.count(F.lit(1)).alias("tiles"))
    grid = tiles.sparkSession.range(1, bins + 1).select(F.col("id").alias("bin"))
    return grid.join(counts, "bin", "left").na.fill(0, ["tiles"])


def worst_tiles(tiles: DataFrame, metric: str = "rmse", k: int = 10, tie: str = "tile_id") -> DataFrame:
    """The k tiles with the largest error (a top-k, not a sort of all tiles)."""
    return tiles.where(F.col(metric).isNotNull()).orderBy(F.col(metric).desc(), tie).limit(k)


def best_epoch(history: DataFrame, by: Sequence[str] = ("run_id",)) -> DataFrame:
    """Lowest rmse per run; ties by lower mae, higher correlation, earlier epoch.

    A minimum of structs, so a long run is combined map-side and never sorted.
    """
    order = F.struct("rmse", "mae", (-F.col("correlation")).alias("_c"), "epoch")
    return history.groupBy(*by).agg(F.min(order).alias("_b")).select(
        *by, "_b.epoch", "_b.rmse", "_b.mae", (-F.col("_b._c")).alias("correlation")
    )


def early_stop(history: DataFrame, column: str = "rmse", patience: int = 10) -> DataFrame:
    """Per run the best epoch before stopping and the epoch at which training stops (NULL: never).

    Training stops at the first epoch that lies ``patience`` epochs after the last strict improvement.
    """
    steps = prefix_extreme(history, ["run_id"], "epoch", F.col(column), "_before", largest=False, inclusive=False)
    improved = F.col("_before").isNull() | (F.col(column) < F.col("_before"))
    steps = prefix_extreme(
        steps, ["run_id"], "epoch", F.when(improved, F.col("epoch")), "_last", largest=True, inclusive=True
    ).withColumn("_stale", F.col("epoch") - F.col("_last"))
    first_stop = F.min(F.when(F.col("_stale") >= patience, F.struct("epoch", "_last")))
    ends = steps.groupBy("run_id").agg(first_stop.alias("_s"), F.max("_last").alias("_final"))
    return ends.select(
        "run_id", F.col("_s.epoch").alias("stop_epoch"), F.coalesce(F.col("_s._last"), F.col("_final")).alias("best_epoch")
    )


def compare_models(tiles: DataFrame, baseline: str, model: str = "model") -> DataFrame:
    """Mean scores per model and their ratio to the baseline model."""
    means = tiles.groupBy(model).agg(
        F.avg("rmse").alias("rmse"), F.avg("mae").alias("mae"), F.avg("correlation").alias("correlation"),
        F.count(F.lit(1)).alias("n"),
    )
    base = means.where(F.col(model) == baseline).select(F.col("rmse").alias("_b"), F.lit(0).alias("_k"))
    joined = means.withColumn("_k", F.lit(0)).join(F.broadcast(base), "_k", "left")
    return joined.withColumn("rmse_ratio", ratio("rmse", "_b")).drop("_k", "_b")


def split_table(macro: DataFrame, metrics: Mapping[str, str], split: str = "split") -> DataFrame:
    """metric x (validation, test) with the direction in which it improves.

    ``macro`` has one row per split; ``metrics`` maps column names to "lower better"/"higher better".
    """
    rows = F.array(
        *[
            F.struct(F.lit(m).alias("metric"), F.col(m).cast("double").alias("value"), F.lit(d).alias("direction"))
            for m, d in metrics.items()
        ]
    )
    tall = macro.select(split, F.inline(rows))
    return tall.groupBy("metric", "direction").agg(
        F.max(F.when(F.col(split) == "val", F.col("value"))).alias("validation"),
        F.max(F.when(F.col(split) == "test", F.col("value"))).alias("test"),
    )


def class_iou_distribution(tiles: DataFrame) -> DataFrame:
    """Median and number of defined IoU values per class, best median first in ``place``."""
    rows = tiles.select(F.explode("per_class_iou").alias("name", "iou"))
    medians = exact_quantiles(rows, ["name"], "iou", {"median": 0.5}, count_name="n")
    order = Window.orderBy(F.col("median").desc(), "name")  # at most seven rows
    return medians.withColumn("place", F.row_number().over(order))


def building_deep_dive(tiles: DataFrame) -> DataFrame:
    """Tiles with and without buildings, median IoU, share of IoU >= 0.5, correlation of IoU and F1."""
    with_b = F.col("building_iou").isNotNull()
    p, t = F.when(with_b, F.col("building_iou")), F.when(with_b, F.col("building_f1"))
    sums = tiles.groupBy(F.lit(0).alias("_k")).agg(
        F.count_if(with_b).alias("with_buildings"),
        F.count_if(~with_b).alias("without_buildings"),
        F.avg((p >= 0.5).cast("double")).alias("share_half"),
        F.try_divide(F.covar_pop(p, t), F.stddev_pop(p) * F.stddev_pop(t)).alias("correlation"),
    )
    median = exact_quantiles(tiles.withColumn("_k", F.lit(0)), ["_k"], "building_iou", {"median_iou": 0.5})
    return sums.join(median, "_k", "left").drop("_k")
