"""Connected components of an edge list by large-star and small-star steps.

A node's least neighbour is pre-aggregated before the exchange and joined back, so a node of very many edges is one
row on one side of the join; its rows on the other side are split by adaptive execution.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rastertab.functions.state import discard, settle

PARTS = 64  # range partitions at least, so that tasks stay small on small clusters too


def dealt_parts(df: DataFrame) -> int:
    return max(PARTS, int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")))


def forest(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(node, least node of its component) of every node that edges (a, b) connect, but for the least ones."""
    nodes, at = np.unique(np.concatenate((a, b)), return_inverse=True)
    x, y = at[: len(a)], at[len(a) :]
    root = np.arange(len(nodes))
    while True:
        low = np.minimum(root[x], root[y])
        new = root.copy()
        np.minimum.at(new, root[x], low)
        np.minimum.at(new, root[y], low)
        while not np.array_equal(new, new[new]):
            new = new[new]
        if np.array_equal(new, root):
            break
        root = new
    moved = np.flatnonzero(root != np.arange(len(nodes)))
    return nodes[moved], nodes[root[moved]]


def _star(edges: DataFrame, large: bool) -> DataFrame:
    """One step over ``edges`` (a, b), a > b: the neighbours of each node go to its least one (or itself)."""
    rows = edges.selectExpr("inline(array(struct(a, b), struct(b AS a, a AS b)))") if large else edges
    least = rows.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
    met = rows.join(least, "a")
    if large:
        return met.where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b"))
    return met.selectExpr("inline(array(struct(a, m AS b), struct(b AS a, m AS b)))").where("a <> b")


def roots(edges: DataFrame) -> DataFrame:
    """(node, root) of every node of ``edges`` (a, b) that is not the least of its component; root is that least.

    Steps alternate until no edge changes; every round is written to the shared folder, and two numbers of it reach
    the driver. No edges give no rows.
    """
    low, high = F.least("a", "b"), F.greatest("a", "b")
    now = settle(edges.where("a <> b").select(high.alias("a"), low.alias("b")).distinct(), "edges")
    mark = None
    while True:
        before, now = now, settle(_star(_star(now, True), False).distinct(), "stars")
        discard(before)
        was, mark = mark, now.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(20,0)"))).first()
        if mark == was or mark[0] == 0:
            return now.select(F.col("a").alias("node"), F.col("b").alias("root"))
