"""Running totals in key order, spread over range partitions, and ranks of linked lists.

No group and no list is gathered in one task: rows are dealt out by ranges of their order, each partition adds up what
it holds, and one row per partition, not per key, is carried on by the driver.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from rastertab.functions.state import settle

PRIME = (1 << 31) - 1  # lanes are polynomials modulo this; products of two residues fit a long
BLOCK = 1 << 16  # arcs of a list that one task joins up at a time


def dealt_parts(df: DataFrame) -> int:
    return int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))


def powers(base: int, exponents: np.ndarray) -> np.ndarray:
    """``base`` to each of ``exponents`` modulo PRIME."""
    out, square, left = np.ones(len(exponents), np.int64), base % PRIME, exponents.copy()
    while left.any():
        out[(left & 1) == 1] = out[(left & 1) == 1] * square % PRIME
        square, left = square * square % PRIME, left >> 1
    return out


def running(
    df: DataFrame, order: Sequence, group: Sequence[str] = (), sums: Sequence[str] = (), lanes: dict[str, int] | None = None,
    label: str = "running",
) -> DataFrame:
    """``df`` with ``seq`` (1-based place of a row in its group) and, per column of ``sums`` or ``lanes``, its running total.

    Rows are taken by ``order``, which starts with the columns of ``group`` (integers, not NULL). ``run_<sum>`` adds the
    values up; ``run_<lane>`` adds value * base^seq modulo PRIME, so that equal prefixes of groups have equal lanes.
    """
    group, sums, lanes = list(group), list(sums), dict(lanes or {})
    added = ["seq", *(f"run_{c}" for c in [*sums, *lanes])]
    schema = T.StructType([*df.schema, *T.StructType.fromDDL("part int, at bigint, " + ", ".join(f"{c} bigint" for c in added))])

    def run(batches):
        part, at, last, carried = TaskContext.get().partitionId(), 0, None, [0] * len(added)
        for batch in batches:
            n = batch.num_rows
            if not n:
                continue
            keys = np.stack([batch.column(batch.schema.get_field_index(c)).to_numpy() for c in group]) if group else np.zeros((1, n))
            new = np.concatenate(([last is None or bool((keys[:, 0] != last).any())], (keys[:, 1:] != keys[:, :-1]).any(axis=0)))
            first = np.maximum.accumulate(np.where(new, np.arange(n), -1))
            old = first < 0  # rows of the group that the batch before left open
            start = np.where(old, 0, first)
            seq = np.arange(n) - start + 1 + np.where(old, carried[0], 0)
            made = [seq]
            for k, c in enumerate([*sums, *lanes], 1):
                v = batch.column(batch.schema.get_field_index(c)).to_numpy().astype(np.int64)
                if c in lanes:
                    v = v % PRIME * powers(lanes[c], seq) % PRIME
                total = np.cumsum(v)
                total = total - (total[start] - v[start]) + np.where(old, carried[k], 0)
                made.append(total % PRIME if c in lanes else total)
            last, carried = keys[:, -1].copy(), [int(m[-1]) for m in made]
            extra = [pa.array(np.full(n, part, np.int32)), pa.array(np.arange(at, at + n)), *map(pa.array, made)]
            at += n
            yield pa.RecordBatch.from_arrays([*batch.columns, *extra], names=schema.names)

    dealt = df.repartitionByRange(dealt_parts(df), *order).sortWithinPartitions(*order)
    found = settle(dealt.mapInArrow(run, schema), label)
    inside = lambda cols: F.struct(F.lit(0).alias("_"), *cols)  # noqa: E731  a struct even without a group
    ends = found.groupBy("part").agg(
        F.min_by(inside(group), "at").alias("head"), F.max_by(inside([*group, *added]), "at").alias("tail")
    )
    carry, have, rows = None, None, []
    for r in ends.orderBy("part").collect():  # a row per partition
        head, tail = [r.head[c] for c in group], [r.tail[c] for c in group]
        mine = [r.tail[c] for c in added]
        if carry is not None and head == have:
            rows.append((r.part, *head, *carry, *(pow(b, carry[0], PRIME) for b in lanes.values())))
            if tail == head:
                summed = [a + b for a, b in zip(carry[: 1 + len(sums)], mine)]
                mixed = zip(lanes.values(), carry[1 + len(sums) :], mine[1 + len(sums) :])
                mine = summed + [(a + pow(base, carry[0], PRIME) * b) % PRIME for base, a, b in mixed]
        carry, have = mine, tail
    names = [*(f"_g{k}" for k in range(len(group))), *(f"_c{k}" for k in range(len(added))), *(f"_p{k}" for k in range(len(lanes)))]
    small = df.sparkSession.createDataFrame(rows, "_part int, " + ", ".join(f"{c} bigint" for c in names))
    on = F.col("part") == F.col("_part")
    for k, c in enumerate(group):
        on = on & (F.col(c) == F.col(f"_g{k}"))
    met = found.join(F.broadcast(small), on, "left")
    plus = {}
    for k, c in enumerate(added):
        base = F.coalesce(F.col(f"_c{k}"), F.lit(0))
        which = k - 1 - len(sums)
        plus[c] = F.col(c) + base if which < 0 else (base + F.coalesce(F.col(f"_p{which}"), F.lit(1)) * F.col(c)) % PRIME
    return met.select(*df.columns, *(v.alias(c) for c, v in plus.items()))


def _join_block(pdf: pd.DataFrame) -> pd.DataFrame:
    """(arc, head, place, next, tail): pieces of the list that lie in one block, and each arc's place in its piece."""
    arcs, after = pdf["arc"].to_numpy(), pdf["next"].fillna(-1).to_numpy().astype(np.int64)
    order = np.argsort(arcs)
    arcs, after = arcs[order], after[order]
    spot = np.minimum(np.searchsorted(arcs, after), len(arcs) - 1)
    here = arcs[spot] == after
    jump = np.arange(len(arcs))
    jump[spot[here]] = np.flatnonzero(here)
    place = (jump != np.arange(len(arcs))).astype(np.int64)
    while True:
        further = jump[jump]
        if np.array_equal(further, jump):
            break
        place, jump = place + place[jump], further
    return pd.DataFrame({"arc": arcs, "head": arcs[jump], "place": place, "next": np.where(after < 0, -1, after), "tail": ~here})


def list_rank(arcs: DataFrame, block: int = BLOCK) -> DataFrame:
    """(arc, left): number of arcs from each to the end of its list, itself included.

    ``arcs`` is (arc, next), numbered densely from 0, next NULL at the end. Blocks of neighbouring numbers join their
    arcs to pieces; pieces, mostly far fewer, halve the way to the end by pointer doubling, written round by round.
    """
    placed = arcs.withColumn("_b", F.floor(F.col("arc") / block)).groupBy("_b").applyInPandas(
        _join_block, "arc bigint, head bigint, place bigint, next bigint, tail boolean"
    )
    placed = settle(placed, "pieces")
    now = placed.where("tail").select(F.col("head").alias("id"), F.when(F.col("next") >= 0, F.col("next")).alias("to"), (F.col("place") + 1).alias("w"))
    while True:
        now = settle(now, "doubling")
        if now.where("to IS NOT NULL").isEmpty():
            break
        ahead = now.select(F.col("id").alias("to"), F.col("to").alias("_to"), F.col("w").alias("_w"))
        now = now.join(ahead, "to", "left").select("id", F.col("_to").alias("to"), (F.col("w") + F.coalesce("_w", F.lit(0))).alias("w"))
    return placed.join(now.select(F.col("id").alias("head"), "w"), "head").select("arc", (F.col("w") - F.col("place")).alias("left"))
