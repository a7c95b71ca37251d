"""Small Column helpers shared by the operators."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def as_col(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def finite(c) -> Column:
    """True for a non-NULL, non-NaN, non-infinite number; never NULL (NaN sorts above infinity)."""
    return F.coalesce(F.abs(as_col(c)) < F.lit(float("inf")), F.lit(False))


def ratio(num, den) -> Column:
    """num / den as double, NULL when the denominator is 0 or NULL."""
    return F.try_divide(as_col(num).cast("double"), as_col(den).cast("double"))


def python_round(c, digits: int = 0) -> Column:
    """Half-to-even rounding, as Python's round()."""
    return F.bround(as_col(c), digits)


def js_round(c) -> Column:
    """Round half up towards positive infinity."""
    return F.floor(as_col(c) + F.lit(0.5))


def _ordered(values: list[Column]) -> tuple[Column, Column, Column]:
    """Sorted array (NULL first), number of NULLs and number of values of a few columns."""
    nulls = F.lit(0)
    for v in values:
        nulls = nulls + v.isNull().cast("int")
    return F.sort_array(F.array(*values)), nulls, F.lit(len(values)) - nulls


def with_upper_median(rows: DataFrame, values: list[Column], name: str = "_median") -> DataFrame:
    """Adds the element at index n div 2 of the sorted non-NULL values of a few columns (NULL if none).

    The sorted array is a column of its own, so that it is computed once and not per reference.
    """
    ordered, nulls, _ = _ordered(values)
    staged = rows.withColumns({"_ordered": ordered, "_nulls": nulls})
    middle = F.col("_nulls") + F.floor((len(values) - F.col("_nulls")) / 2).cast("int")
    return staged.withColumn(name, F.get("_ordered", middle)).drop("_ordered", "_nulls")


def middle_median(*values: Column) -> Column:
    """Ordinary median (mean of the two middle values) of a few columns; NULL when there is none."""
    ordered, nulls, n = _ordered(list(values))
    low, high = F.floor((n - 1) / 2).cast("int"), F.floor(n / 2).cast("int")
    return F.when(n > 0, (F.get(ordered, nulls + low) + F.get(ordered, nulls + high)) / 2)


def null_if_not_finite(c) -> Column:
    return F.when(finite(c), as_col(c))


def unit_hash(*parts) -> Column:
    """Deterministic number in [0, 1) derived from the given columns and literals.

    The first 32 bits of the MD5 of their text, joined by "|": other engines can repeat every choice made with it.
    """
    text = F.concat_ws("|", *[(p if isinstance(p, Column) else F.lit(p)).cast("string") for p in parts])
    return F.conv(F.substring(F.md5(text.cast("binary")), 1, 8), 16, 10).cast("bigint") / F.lit(4294967296.0)


def popcount_true(flags: list[Column]) -> Column:
    """How many of a few boolean columns are true (NULL counts as false)."""
    total = F.lit(0)
    for flag in flags:
        total = total + F.coalesce(flag, F.lit(False)).cast("int")
    return total
