"""Exact grouped quantiles without gathering a group into one task.

Spark's own ``percentile`` merges every distinct value of a group in one task, which does not
survive a group that holds a third of all rows. Here values are first counted per (group, value),
then the bucket that holds each wanted rank is located by counting over a monotone bucketing of the
value axis (4096 buckets per power of two), and only the located buckets are ranked value by value.
A window partition is thus either the buckets of a group (a bounded number) or the distinct values of
one bucket (at most 2048 for single-precision rasters), however many rows the group has.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

_COARSE = 4096  # buckets per power of two
_TINY = 1e-300  # magnitudes below this share the bucket of zero


def axis_sql(v: str) -> str:
    """Monotone, piecewise-linear log2 position of a double on a bounded axis, as SQL text."""
    exponent = f"double(floor(log2(abs({v}))))"
    position = f"({exponent} + (abs({v}) / pow(2D, {exponent}) - 1D) + 1100D)"
    return f"if(abs({v}) < {_TINY}D, 0D, signum({v}) * {position})"


def bucket_sql(v: str) -> str:
    return f"floor({axis_sql(v)} * {_COARSE})"


def _locate(counts: DataFrame, within: Sequence[str], order: str, wanted: str) -> DataFrame:
    """Running counts inside ``within``; keeps entries that hold a wanted rank, made relative."""
    upto = f"sum(n) OVER (PARTITION BY {', '.join(within)} ORDER BY {order} ROWS UNBOUNDED PRECEDING)"
    inside = f"filter({wanted}, w -> w.rank >= _end - n AND w.rank < _end)"
    hits = f"transform({inside}, w -> named_struct('slot', w.slot, 'rank', w.rank - (_end - n)))"
    return counts.selectExpr("*", f"{upto} AS _end").selectExpr("*", f"{hits} AS _hits").where("size(_hits) > 0")


def exact_quantiles(
    df: DataFrame,
    keys: Sequence[str],
    value,
    wanted: Mapping[str, float | str],
    count_name: str | None = None,
) -> DataFrame:
    """One row per group with one exact quantile column per entry of ``wanted``.

    A number p in 0..1 gives the linearly interpolated quantile, low * (1 - d) + high * d with every step rounded on its
    own and never beyond the two values it lies between; ``"upper"`` the element at index n div 2 of the sorted values. NULL, NaN and infinite values and NULL keys are ignored; groups without a value are
    absent.
    """
    value = F.col(value) if isinstance(value, str) else value
    grouped = [f"`{k}`" for k in keys] or ["_all"]
    source = df if keys else df.selectExpr("*", "0 AS _all")
    plain = list(keys) or ["_all"]

    values = (
        source.select(*plain, value.cast("double").alias("_v"))
        .where(" AND ".join([*(f"{k} IS NOT NULL" for k in grouped), "abs(_v) < double('infinity')"]))
        .groupBy(*plain, "_v")
        .agg(F.count(F.lit(1)).alias("n"))
        .selectExpr("*", f"coalesce({bucket_sql('_v')}, 0L) AS _b")
    )
    # Both uses of ``values`` share one exchange: neither key nor bucket can be NULL here, so the join
    # below adds no filter that would tell them apart.

    slots, outputs = [], [*grouped] if keys else []
    for i, (name, p) in enumerate(wanted.items()):
        low, high = f"_s{2 * i}", f"_s{2 * i + 1}"
        if p == "upper":
            ends = ("_total div 2", "_total div 2")
            outputs.append(f"{low} AS `{name}`")
        else:
            position = f"({float(p)!r}D * (_total - 1))"
            ends = (f"floor({position})", f"ceil({position})")
            blend = f"{low} * (ceil({position}) - {position}) + {high} * ({position} - floor({position}))"
            outputs.append(f"if(floor({position}) = ceil({position}), {low}, greatest({low}, least({high}, {blend}))) AS `{name}`")
        for side, rank in enumerate(ends):
            slots.append(f"named_struct('slot', {2 * i + side}, 'rank', bigint({rank}))")
    if count_name:
        outputs.append(f"_total AS `{count_name}`")

    buckets = values.groupBy(*plain, "_b").agg(F.sum("n").alias("n")).selectExpr(
        "*", f"sum(n) OVER (PARTITION BY {', '.join(grouped)}) AS _total"
    )
    located = _locate(buckets, grouped, "_b", f"array({', '.join(slots)})").selectExpr(
        *grouped, "_b", "_total", "_hits AS _w"
    )
    exact = values.join(located, [*plain, "_b"])
    found = _locate(exact, [*grouped, "_b"], "_v", "_w").selectExpr(*grouped, "_total", "_v", "inline(_hits)")
    ends = [F.expr(f"max(if(slot = {i}, _v, NULL)) AS _s{i}") for i in range(2 * len(wanted))]
    return found.groupBy(*plain).agg(F.max("_total").alias("_total"), *ends).selectExpr(*outputs)
