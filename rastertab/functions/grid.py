"""Grid plumbing: block partitioning with halos, neighbours, row-major order, per-tile scalars.

A tile can hold a third of all cells, so nothing here is keyed by ``tile_id`` alone: stencils work
on fixed-size blocks of a tile, ordering works line by line, per-tile scalars are joined salted.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

BLOCK = 64  # block edge in cells
_BLOCK_KEY = ["tile_id", "_bi", "_bj"]

FOUR = ("u", "d", "l", "r")
EIGHT = ("ul", "u", "ur", "l", "r", "dl", "d", "dr")
OFFSETS = {
    "ul": (-1, -1), "u": (-1, 0), "ur": (-1, 1), "l": (0, -1),
    "r": (0, 1), "dl": (1, -1), "d": (1, 0), "dr": (1, 1),
}


def with_halo(cells: DataFrame, halo: int = 1, block: int = BLOCK) -> DataFrame:
    """Repartition cells by block, copying only a ``halo``-wide rim to adjoining blocks.

    One shuffle of about (1 + 2*halo/block)^2 times the input serves any number of stencil passes
    up to ``halo``; each pass is a local sort because windows start with the block key.
    """

    def spans(axis: str) -> str:
        low = f"int(floor((`{axis}` - {halo}) / {block}))"
        return f"explode(sequence(greatest({low}, 0), int(floor((`{axis}` + {halo}) / {block}))))"

    return (
        cells.selectExpr("*", f"{spans('row')} AS _bi")
        .selectExpr("*", f"{spans('col')} AS _bj")
        .repartition(*_BLOCK_KEY)
    )


def core(blocked: DataFrame, block: int = BLOCK) -> DataFrame:
    """Drop the rim copies and the block columns."""
    own = f"floor(`row` / {block}) = _bi AND floor(col / {block}) = _bj"
    return blocked.where(own).drop("_bi", "_bj")


def gather(blocked: DataFrame, values: Sequence[str], diagonals: bool = True) -> DataFrame:
    """Add struct columns n_u, n_d, n_l, n_r (and the four diagonals) holding ``values``.

    A neighbour struct is NULL when that cell does not exist, so existence and NULL values stay
    apart. Sparse and ragged tiles are handled: an absent cell next to a present one is stood in
    for by a placeholder that only carries its horizontal neighbours to the rows above and below.

    Expressions are SQL text: this is the inner step of every stencil, and text costs one call to the
    JVM where a Column tree costs one per node.
    """

    def beside(axis: str, across: str, packed: str) -> tuple[str, str]:
        """Previous and next entry along ``axis`` as _p and _q, to be checked for adjacency."""
        over = f"OVER (PARTITION BY {', '.join(_BLOCK_KEY)}, `{across}` ORDER BY `{axis}`)"
        probe = f"struct(`{axis}` AS at, {packed} AS v)"
        return f"lag({probe}) {over} AS _p", f"lead({probe}) {over} AS _q"

    def at(entry: str, axis: str, offset: int) -> str:
        return f"if({entry}.at = `{axis}` + ({offset}), {entry}.v, NULL)"

    packed = f"struct({', '.join(f'`{v}`' for v in values)})"
    here = blocked.selectExpr("*", *beside("col", "row", packed))
    if not diagonals:
        kept = [f"`{c}`" for c in blocked.columns]
        here = here.selectExpr(*kept, f"{at('_p', 'col', -1)} AS n_l", f"{at('_q', 'col', 1)} AS n_r")
        here = here.selectExpr("*", *beside("row", "col", packed))
        return here.selectExpr(
            *kept, "n_l", "n_r", f"{at('_p', 'row', -1)} AS n_u", f"{at('_q', 'row', 1)} AS n_d"
        )

    payload = f"struct({', '.join(f'`{c}`' for c in blocked.columns)})"

    def entry(col: str, row: str, left: str, mid: str, right: str) -> str:
        return f"struct(int({col}) AS col, {row} AS _row, struct({left} AS l, {mid} AS m, {right} AS r) AS _v)"

    none_v, none_row = f"if(false, {packed}, NULL)", f"if(false, {payload}, NULL)"
    own = entry("col", payload, at("_p", "col", -1), packed, at("_q", "col", 1))
    right = entry("col + 1", none_row, packed, none_v, at("_q", "col", 2))
    left = entry("col - 1", none_row, none_v, none_v, packed)
    entries = (
        f"filter(array({own}, if(_q IS NULL OR _q.at > col + 1, {right}, NULL), "
        f"if(_p IS NULL OR _p.at < col - 2, {left}, NULL)), e -> e IS NOT NULL)"
    )
    spread = here.selectExpr(*_BLOCK_KEY, "`row`", f"inline({entries})")
    spread = spread.selectExpr(*_BLOCK_KEY, "`row`", "col", "_row", "_v", *beside("row", "col", "_v"))
    return spread.where("_row IS NOT NULL").selectExpr(
        *_BLOCK_KEY, "`row`", "col", "_row", "_v",
        f"{at('_p', 'row', -1)} AS _up", f"{at('_q', 'row', 1)} AS _down",
    ).selectExpr(
        "_row.*", "_v.l AS n_l", "_v.r AS n_r", "_up.m AS n_u", "_down.m AS n_d",
        "_up.l AS n_ul", "_up.r AS n_ur", "_down.l AS n_dl", "_down.r AS n_dr",
    )


def neighbour_columns(diagonals: bool = True) -> list[Column]:
    return [F.col(f"n_{d}") for d in (EIGHT if diagonals else FOUR)]


def drop_neighbours(df: DataFrame) -> DataFrame:
    return df.drop(*[f"n_{d}" for d in EIGHT])


def stencil(cells: DataFrame, values: Sequence[str], diagonals: bool = True) -> DataFrame:
    """One-pass neighbour lookup over all tiles: halo, gather, drop the rim."""
    return core(gather(with_halo(cells, 1), values, diagonals))


def tile_shape(cells: DataFrame, by: Sequence[str] = ("tile_id",)) -> DataFrame:
    """Rows and columns per tile."""
    return cells.groupBy(*by).agg(
        (F.max("row") + 1).alias("rows"), (F.max("col") + 1).alias("cols")
    )


def attach(
    big: DataFrame,
    scalars: DataFrame,
    keys: Sequence[str] = ("tile_id",),
    how: str = "left",
    spread: Sequence[str] = ("row", "col"),
) -> DataFrame:
    """Join one-row-per-key scalars onto many rows per key.

    Spark broadcasts the scalars when they are under its size limit; otherwise the salt spreads a hot
    key over ``spark.rastertab.saltBuckets`` shuffle partitions.
    """
    buckets = int(big.sparkSession.conf.get("spark.rastertab.saltBuckets", "16"))
    columns = ", ".join(f"`{c}`" for c in spread)
    salted = big.selectExpr("*", f"int(pmod(xxhash64({columns}), {buckets})) AS _salt")
    copies = scalars.selectExpr("*", f"explode(sequence(0, {buckets - 1})) AS _salt")
    return salted.join(copies, [*keys, "_salt"], how).drop("_salt")


def row_major_rank(cells: DataFrame, name: str, by: Sequence[str] = ("tile_id",)) -> DataFrame:
    """Add the 1-based row-major position of each cell inside its tile.

    Lines are counted first and only the line counts are accumulated per tile, so no task ever sorts
    a whole tile.
    """
    keys = list(by)
    lines = cells.groupBy(*keys, "row").agg(F.count(F.lit(1)).alias("_n"))
    before = Window.partitionBy(*keys).orderBy("row").rowsBetween(Window.unboundedPreceding, -1)
    offsets = lines.select(*keys, "row", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_off"))
    inside = F.row_number().over(Window.partitionBy(*keys, "row").orderBy("col"))
    return (
        cells.withColumn("_in", inside)
        .join(offsets, [*keys, "row"])
        .withColumn(name, F.col("_in") + F.col("_off"))
        .drop("_in", "_off")
    )


def block_numbers(rows: pd.DataFrame, keys: Sequence[str] = _BLOCK_KEY) -> np.ndarray:
    """0, 1, … for the blocks of rows that lie block by block, as :func:`whole_groups` hands them on."""
    new = np.zeros(len(rows), bool)
    for name in keys:
        at = rows[name].to_numpy()
        new[1:] |= (at[1:] != at[:-1]) & ~(pd.isna(at[1:]) & pd.isna(at[:-1]))
    return np.cumsum(new)


def whole_groups(frames: Iterator[pd.DataFrame], keys: Sequence[str]) -> Iterator[pd.DataFrame]:
    """Rows that lie group by group, whole groups at a time, as many as a batch of rows holds.

    Small groups thus cost what their rows cost, not a call each; of a batch's last group the rest is awaited, so a
    task holds one batch and one group.
    """
    held: list[pd.DataFrame] = []
    for frame in frames:
        if not len(frame):
            continue
        if held:
            same = block_numbers(pd.concat([held[-1].tail(1), frame.tail(1)]), keys)[-1] == 0
            held.append(frame)
            if same:
                continue
            frame = pd.concat(held, ignore_index=True)
        numbers = block_numbers(frame, keys)
        cut = int(np.searchsorted(numbers, numbers[-1]))
        if cut:
            yield frame.iloc[:cut].reset_index(drop=True)
        held = [frame.iloc[cut:]]
    if held:
        yield pd.concat(held, ignore_index=True)


def over_blocks(
    rows: DataFrame, axes: tuple[str, str], block: int, step: Callable[[pd.DataFrame], pd.DataFrame], schema: str
) -> DataFrame:
    """``step`` over whole blocks of ``block`` x ``block``, as many at a time as :func:`whole_groups` hands on."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in whole_groups(frames, _BLOCK_KEY):
            yield step(frame)

    at = {k: F.floor(F.col(axis) / block) for k, axis in zip(_BLOCK_KEY[1:], axes)}
    return rows.withColumns(at).repartition(*_BLOCK_KEY).sortWithinPartitions(*_BLOCK_KEY).mapInPandas(run, schema)
