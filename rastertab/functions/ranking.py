"""Ranks over a whole group without sorting the group in one task."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from rastertab.functions.quantiles import bucket_sql


def _offsets(counts: DataFrame, keys: list[str], bucket: str) -> DataFrame:
    before = Window.partitionBy(*keys).orderBy(bucket).rowsBetween(Window.unboundedPreceding, -1)
    return counts.withColumn("_off", F.coalesce(F.sum("_n").over(before), F.lit(0))).drop("_n")


def spread_rank(
    df: DataFrame, keys: Sequence[str], order: Column, tie: Sequence[str], name: str, buckets: int = 4096,
    limit: Column | None = None,
) -> DataFrame:
    """1-based rank of rows by ``order`` (a number in [0, 1)) and ``tie`` inside each key.

    Ranges of ``order`` are counted first; only the counts are accumulated, each range is sorted
    on its own. With ``limit`` only rows of rank <= limit are kept, and ranges that start beyond it
    are dropped before anything is sorted.
    """
    grouped = list(keys) or ["_all"]
    src = df if keys else df.withColumn("_all", F.lit(0))
    src = src.withColumn("_o", order).withColumn("_bk", F.floor(F.col("_o") * buckets).cast("int"))
    counts = src.groupBy(*grouped, "_bk").agg(F.count(F.lit(1)).alias("_n"))
    placed = src.join(_offsets(counts, grouped, "_bk"), [*grouped, "_bk"])
    if limit is not None:
        placed = placed.where(F.col("_off") < limit)
    inside = F.row_number().over(Window.partitionBy(*grouped, "_bk").orderBy("_o", *tie))
    ranked = placed.withColumn(name, inside + F.col("_off"))
    if limit is not None:
        ranked = ranked.where(F.col(name) <= limit)
    return ranked.drop("_o", "_bk", "_off", *([] if keys else ["_all"]))


def value_rank(df: DataFrame, keys: Sequence[str], value: str, tie: str, name: str, total: str) -> DataFrame:
    """1-based rank by a double value; equal values keep separate ranks. Adds the group size too.

    Value counts are accumulated bucket by bucket, equal values are split by a hash of ``tie``.
    """
    grouped = list(keys) or ["_all"]
    src = df if keys else df.withColumn("_all", F.lit(0))
    src = src.where(F.col(value).isNotNull())
    src = src.withColumn("_b", F.expr(bucket_sql(f"`{value}`"))).withColumn(
        "_t", F.pmod(F.xxhash64(F.col(tie)), F.lit(64)).cast("int")
    )
    n = F.count(F.lit(1)).alias("_n")
    per_tie = src.groupBy(*grouped, "_b", value, "_t").agg(n)
    per_bucket = per_tie.groupBy(*grouped, "_b").agg(F.sum("_n").alias("_n"))
    whole = F.sum("_n").over(Window.partitionBy(*grouped))
    bucket_off = _offsets(per_bucket.withColumn(total, whole), grouped, "_b")
    per_value = per_tie.groupBy(*grouped, "_b", value).agg(F.sum("_n").alias("_n"))
    value_off = _offsets(per_value, [*grouped, "_b"], value).withColumnRenamed("_off", "_off_v")
    tie_off = _offsets(per_tie, [*grouped, "_b", value], "_t").withColumnRenamed("_off", "_off_t")
    inside = F.row_number().over(Window.partitionBy(*grouped, "_b", value, "_t").orderBy(tie))
    return (
        src.withColumn("_in", inside)
        .join(tie_off, [*grouped, "_b", value, "_t"])
        .join(value_off, [*grouped, "_b", value])
        .join(bucket_off, [*grouped, "_b"])
        .withColumn(name, F.col("_in") + F.col("_off_t") + F.col("_off_v") + F.col("_off"))
        .drop("_b", "_t", "_in", "_off", "_off_v", "_off_t", *([] if keys else ["_all"]))
    )


def prefix_extreme(
    df: DataFrame, keys: Sequence[str], order: str, value: Column, name: str, largest: bool, inclusive: bool, chunk: int = 4096
) -> DataFrame:
    """Running MIN or MAX of ``value`` by an integer ``order``, combined from per-chunk extremes.

    A long series is scanned chunk by chunk; only one extreme per chunk is carried forward.
    """
    pick = F.max if largest else F.min
    src = df.withColumn("_pv", value).withColumn("_ck", F.floor(F.col(order) / chunk))
    parts = src.groupBy(*keys, "_ck").agg(pick("_pv").alias("_x"))
    earlier = Window.partitionBy(*keys).orderBy("_ck").rowsBetween(Window.unboundedPreceding, -1)
    carried = parts.select(*keys, "_ck", pick("_x").over(earlier).alias("_carry"))
    inside = Window.partitionBy(*keys, "_ck").orderBy(order).rowsBetween(
        Window.unboundedPreceding, 0 if inclusive else -1
    )
    combine = F.greatest if largest else F.least
    return (
        src.withColumn("_in", pick("_pv").over(inside))
        .join(carried, [*keys, "_ck"])
        .withColumn(name, combine("_in", "_carry"))
        .drop("_pv", "_ck", "_in", "_carry")
    )
