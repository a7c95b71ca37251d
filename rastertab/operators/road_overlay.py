"""Two-level road graph: tables of least costs between the border cells of a block, and searches over those tables.

Road cells are read twice and only twice: once to fill the tables, and, for the blocks that a best path may cross, once
to unpack it. In between a search sees border cells only. A round of it solves a whole region of blocks, so rounds grow
with the regions a path crosses; every round adds rows to one folder, and nothing that was written is rewritten.

Blocks that a request changes (its ends, blocked or penalised cells) have tables of their own; all others share one
per tile, profile and treatment of water.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rastertab.functions.grid import block_numbers, whole_groups
from rastertab.functions.state import new_path, settle

BLOCK = 64  # cells of a block's side
REGION = 8  # blocks of a region's side
TIE = 1e-9
CODE = 1 << 32  # number of a cell: row * CODE + col
MOVES = ((-1, 0), (0, -1), (0, 1), (1, 0))  # ascending (row, col)
AT = ["route_id", "bi", "bj"]
CELL = -1  # kind of a block's road cells among its ends or gates


@dataclass
class Roads:
    """Road cells with their blocks, and the gates: cells with a road cell beyond the border of their block."""

    cells: DataFrame
    gates: DataFrame
    block: int
    crossed: bool  # whether there are gates at all


def _together(left: DataFrame, right: DataFrame, keys: list[str]):
    """Both frames by ``keys``, to be handed to one function; the second gets columns of its own.

    Groups are few bytes and much work: the number of partitions is set, so that they are not joined into one task.
    """
    n = int(left.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    apart = right.select(*(F.col(c).alias(c) for c in right.columns))
    return left.repartition(n, *keys).groupBy(*keys).cogroup(apart.repartition(n, *keys).groupBy(*keys))


def _in_batches(cells: DataFrame, others: DataFrame, keys: list[str], step, schema: str) -> DataFrame:
    """``step`` over road cells (kind CELL, value their cost) and ``others`` (with value and kind) of whole groups.

    A call takes a batch of groups, as most blocks are far less work than a call. The number of partitions is set, as
    the rows are few bytes and much work.
    """
    n = int(cells.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    columns = [*keys, "row", "col", "value", "kind"]
    rows = cells.withColumn("value", F.col("cost")).withColumn("kind", F.lit(CELL)).select(*columns).unionByName(others.select(*columns))

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in whole_groups(frames, keys):
            yield step(frame)

    return rows.repartition(n, *keys).sortWithinPartitions(*keys).mapInPandas(run, schema)


def _groups(rows: pd.DataFrame, keys: list[str]) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """First row of each group, and the group's rows, columns, values and kinds."""
    first = np.flatnonzero(np.diff(block_numbers(rows, keys), prepend=-1))
    parts = [rows[c].to_numpy() for c in ("row", "col", "value", "kind")]
    for low, high in zip(first.tolist(), [*first[1:].tolist(), len(rows)]):
        yield low, *(p[low:high] for p in parts)


def block_of(axis: str, block: int) -> Column:
    return F.floor(F.col(axis) / block).cast("int")


def prepare(roads: DataFrame, block: int = BLOCK) -> Roads:
    """Road cells, written once for all rounds of all searches, and their gates."""
    cells = settle(roads.withColumn("bi", block_of("row", block)).withColumn("bj", block_of("col", block)), "roads")
    rim = cells.where((F.col("row") % block).isin(0, block - 1) | (F.col("col") % block).isin(0, block - 1))
    rim = rim.select("tile_id", "row", "col", "bi", "bj")
    beyond = [F.struct((F.col("row") + r).alias("row"), (F.col("col") + c).alias("col")) for r, c in MOVES]
    seen = rim.select("tile_id", "bi", "bj", F.inline(F.array(*beyond)))
    seen = seen.where((F.col("bi") != block_of("row", block)) | (F.col("bj") != block_of("col", block)))
    gates = settle(rim.join(seen.select("tile_id", "row", "col").distinct(), ["tile_id", "row", "col"], "left_semi"), "gates")
    return Roads(cells, gates, block, not gates.isEmpty())


def _grid(r: np.ndarray, c: np.ndarray, price: np.ndarray) -> tuple[np.ndarray, int, int]:
    """Cost of entering each cell of a block, with a rim of impassable cells; first row and column."""
    r0, c0 = int(r.min()) - 1, int(c.min()) - 1
    cost = np.full((int(r.max()) - r0 + 2, int(c.max()) - c0 + 2), np.inf)
    cost[r - r0, c - c0] = price
    return cost, r0, c0


def relax(cost: np.ndarray, dist: np.ndarray) -> np.ndarray:
    """Least costs to all cells of a block from those given in ``dist`` (any number of searches, side by side)."""
    inner, inside = dist[..., 1:-1, 1:-1], cost[1:-1, 1:-1]
    while True:
        near = np.minimum(
            np.minimum(dist[..., :-2, 1:-1], dist[..., 2:, 1:-1]), np.minimum(dist[..., 1:-1, :-2], dist[..., 1:-1, 2:])
        )
        near += inside
        if not (near < inner).any():
            return dist
        np.minimum(inner, near, out=inner)


def _table(row: np.ndarray, col: np.ndarray, value: np.ndarray, kind: np.ndarray):
    """A block's border cells and ends as cell numbers, what it costs to enter them, all costs between them, row by row."""
    road = kind == CELL
    if not road.any() or road.all():
        return None
    cost, r0, c0 = _grid(row[road], col[road], value[road])
    r, c = row[~road] - r0, col[~road] - c0
    inside = (r >= 0) & (c >= 0) & (r < cost.shape[0]) & (c < cost.shape[1])
    r, c = r[inside], c[inside]
    open_ = np.isfinite(cost[r, c])
    if not open_.any():
        return None
    r, c = np.divmod(np.unique(r[open_] * cost.shape[1] + c[open_]), cost.shape[1])
    dist = np.full((len(r), *cost.shape), np.inf)
    dist[np.arange(len(r)), r, c] = 0.0
    table = relax(cost, dist)[:, r, c]
    return (r + r0).astype(np.int64) * CODE + (c + c0), cost[r, c], table.ravel()


def _fill_tables(keys: list[str]):
    """Kernel: one row for each block that has ends, see :func:`_table`."""

    def step(rows: pd.DataFrame) -> pd.DataFrame:
        found = [(low, table) for low, *block in _groups(rows, keys) if (table := _table(*block)) is not None]
        out = rows[keys].iloc[[low for low, _ in found]].reset_index(drop=True)
        for i, name in enumerate(("cell", "cost", "dist")):
            out[name] = pd.Series([table[i] for _, table in found], dtype=object)
        return out

    return step


class Region:
    """Border cells of the blocks of one region: numbers, costs of entering, tables, and steps between blocks."""

    def __init__(self, tables: pd.DataFrame):
        sizes = [len(c) for c in tables["cell"]]
        self.code = np.concatenate([np.asarray(c, np.int64) for c in tables["cell"]]) if sizes else np.zeros(0, np.int64)
        self.cost = np.concatenate([np.asarray(c, float) for c in tables["cost"]]) if sizes else np.zeros(0)
        self.begin = np.concatenate(([0], np.cumsum(sizes))).astype(int)
        self.table = [np.asarray(d, float).reshape(n, n) for d, n in zip(tables["dist"], sizes)]
        self.block = np.repeat(np.arange(len(sizes)), sizes)
        self.order = np.argsort(self.code)
        steps = []
        for dr, dc in MOVES:
            to = self.find(self.code + dr * CODE + dc)
            here = np.flatnonzero(to >= 0)
            here = here[self.block[here] != self.block[to[here]]]
            steps.append((here, to[here]))
        self.left, self.right = (np.concatenate(x) for x in zip(*steps))

    def find(self, codes: np.ndarray) -> np.ndarray:
        """Place of each cell number, -1 for cells that are no border cells here."""
        if not len(self.code):
            return np.full(len(codes), -1)
        spot = np.minimum(np.searchsorted(self.code, codes, sorter=self.order), len(self.code) - 1)
        at = self.order[spot]
        return np.where(self.code[at] == codes, at, -1)


def _code(pdf: pd.DataFrame) -> np.ndarray:
    return pdf["row"].to_numpy().astype(np.int64) * CODE + pdf["col"].to_numpy()


def _solve(block: int, region: int):
    """Kernel of a round: ``given`` has arrivals (kind 0 at a cell, 1 before entering it) and what is known (2)."""

    def run(key, tables: pd.DataFrame, given: pd.DataFrame) -> pd.DataFrame:
        names = ["route_id", "tile_id", "row", "col", "dist", "leaves"]
        reg = Region(tables)
        at, kind, value = reg.find(_code(given)), given["kind"].to_numpy(), given["dist"].to_numpy()
        at, kind, value = at[at >= 0], kind[at >= 0], value[at >= 0]
        known, dist = np.full(len(reg.code), np.inf), np.full(len(reg.code), np.inf)
        np.minimum.at(known, at[kind == 2], value[kind == 2])
        np.minimum.at(dist, at, value + np.where(kind == 1, reg.cost[at], 0.0))
        while True:
            before = dist.copy()
            for k, table in enumerate(reg.table):
                part = dist[reg.begin[k] : reg.begin[k + 1]]
                if len(part):
                    np.minimum(part, (part[:, None] + table).min(axis=0), out=part)
            np.minimum.at(dist, reg.right, dist[reg.left] + reg.cost[reg.right])
            if np.array_equal(before, dist):
                break
        found = np.flatnonzero(dist < known)
        row, col = reg.code[found] // CODE, reg.code[found] % CODE
        out = [(row, col, dist[found], np.zeros(len(found), bool))]
        wide = block * region
        for dr, dc in MOVES:
            r, c = row + dr, col + dc
            away = (r >= 0) & (c >= 0) & ((r // wide != row // wide) | (c // wide != col // wide))
            out.append((r[away], c[away], dist[found][away], np.ones(int(away.sum()), bool)))
        r, c, d, leaves = (np.concatenate(x) for x in zip(*out))
        tile = int(tables["tile_id"].iloc[0]) if len(tables) else 0
        return pd.DataFrame({"route_id": key[0], "tile_id": tile, "row": r, "col": c, "dist": d, "leaves": leaves})[names]

    return run


def _mark(slack: float):
    """Kernel of a backward round: border cells on a best path. ``given``: known (2), known outside (1), marked (0)."""

    def run(key, tables: pd.DataFrame, given: pd.DataFrame) -> pd.DataFrame:
        reg = Region(tables)
        codes, kind, value = _code(given), given["kind"].to_numpy(), given["dist"].to_numpy()
        at = reg.find(codes)
        dist = np.full(len(reg.code), np.inf)
        np.minimum.at(dist, at[(kind == 2) & (at >= 0)], value[(kind == 2) & (at >= 0)])
        outside = dict(zip(codes[kind == 1].tolist(), value[kind == 1].tolist()))
        back: dict[int, list[int]] = {}
        for a, b in zip(reg.left.tolist(), reg.right.tolist()):
            back.setdefault(b, []).append(a)
        todo = at[(kind == 0) & (at >= 0)].tolist()
        marked, leaves = set(todo), set()
        while todo:
            b = todo.pop()
            k, most = reg.block[b], dist[b] + slack
            lo, hi = reg.begin[k], reg.begin[k + 1]
            near = [int(a) for a in lo + np.flatnonzero(dist[lo:hi] + reg.table[k][:, b - lo] <= most) if dist[a] < dist[b]]
            near += [a for a in back.get(b, []) if dist[a] + reg.cost[b] <= most]
            todo += [a for a in near if a not in marked]
            marked.update(near)
            for dr, dc in MOVES:
                code = int(reg.code[b]) + dr * CODE + dc
                if code in outside and outside[code] + reg.cost[b] <= most:
                    leaves.add(code)
        cells = np.array([*(int(reg.code[a]) for a in marked), *leaves], np.int64)
        flags = np.array([False] * len(marked) + [True] * len(leaves), bool)
        return pd.DataFrame({"route_id": key[0], "row": cells // CODE, "col": cells % CODE, "leaves": flags})

    return run


def _unpack(row: np.ndarray, col: np.ndarray, value: np.ndarray, kind: np.ndarray) -> list[tuple]:
    """Walk back from every marked border cell of a block to the cell before the block, or to the start.

    Besides the road cells there are the block's border cells with their costs (kind 2; 0 if marked) and those just
    outside (1).
    """
    road, away, marked = kind == CELL, kind == 1, kind == 0
    if not road.any():
        return []
    cost, r0, c0 = _grid(row[road], col[road], value[road])
    dist = np.full(cost.shape, np.inf)
    mine = ~road & ~away
    r, c = row[mine] - r0, col[mine] - c0
    good = (r >= 0) & (c >= 0) & (r < cost.shape[0]) & (c < cost.shape[1])
    np.minimum.at(dist, (r[good], c[good]), value[mine][good])
    dist[~np.isfinite(cost)] = np.inf
    relax(cost, dist)
    best, price = dist.tolist(), cost.tolist()
    outside = dict(zip(zip((row[away] - r0).tolist(), (col[away] - c0).tolist()), value[away].tolist()))
    out = []
    for er, ec in dict.fromkeys(zip(row[marked].tolist(), col[marked].tolist())):
        p, step, over = (er - r0, ec - c0), 0, None
        while over is None:
            d, following = best[p[0]][p[1]], None
            if d > 0:
                most, enter = d + TIE, price[p[0]][p[1]]
                for dr, dc in MOVES:
                    q = (p[0] + dr, p[1] + dc)
                    if best[q[0]][q[1]] + enter <= most:
                        following = q
                        break
                    if q in outside and outside[q] + enter <= most:
                        over = q
                        break
            out.append((er, ec, step, p[0] + r0, p[1] + c0, *((over[0] + r0, over[1] + c0) if over else (None, None))))
            if following is None:
                break
            p, step = following, step + 1
    return out


def _unpack_blocks(rows: pd.DataFrame) -> pd.DataFrame:
    """Kernel: the steps of :func:`_unpack` in each block of a request."""
    names = ["route_id", "e_row", "e_col", "step", "row", "col", "n_row", "n_col"]
    routes = rows["route_id"].to_numpy()
    steps = [(int(routes[low]), *step) for low, *block in _groups(rows, AT) for step in _unpack(*block)]
    return pd.DataFrame(steps, columns=names).astype({"n_row": float, "n_col": float})


class Search:
    """Least costs of ``ask`` (see ``routes.REQUEST``) over ``roads``; ``price`` prices road cells joined to requests.

    ``changed`` is (route_id, row, col): cells whose price or passability differs for a request. ``price`` maps a frame
    of (requests, road cells) to one with a ``cost`` column, without impassable cells; its second argument tells
    whether cells of single requests (True) or of all that share a profile are priced.
    """

    def __init__(self, ask: DataFrame, roads: Roads, price, changed: DataFrame | None = None, flavour=("avoid_water", "profile")):
        self.ask, self.roads, self.price, self.block = ask, roads, price, roads.block
        self.flavour = ["tile_id", *flavour]
        self.spark = ask.sparkSession
        ends = ask.selectExpr("route_id", "inline(array(struct(start_row AS row, start_col AS col), struct(dest_row AS row, dest_col AS col)))")
        self.ends = ends
        touched = ends if changed is None else ends.unionByName(changed.select("route_id", "row", "col"))
        own = touched.select("route_id", block_of("row", self.block).alias("bi"), block_of("col", self.block).alias("bj")).distinct()
        self.own = settle(own.join(ask, "route_id"), "own")
        self.tables = settle(self._tables(), "tables")
        self.reached = new_path(self.spark, "reached")

    def _cells(self, own: DataFrame) -> DataFrame:
        met = own.join(self.roads.cells, ["tile_id", "bi", "bj"])
        return self.price(met, True).select("route_id", "tile_id", "bi", "bj", "row", "col", "cost")

    def _tables(self) -> DataFrame:
        shape = "bi int, bj int, cell array<bigint>, cost array<double>, dist array<double>"
        gates, spot = self.roads.gates, ["tile_id", "bi", "bj"]
        ends = self.ends.join(self.ask.select("route_id", "tile_id"), "route_id").select(
            *AT[:1], block_of("row", self.block).alias("bi"), block_of("col", self.block).alias("bj"), "row", "col"
        )
        mine = self.own.select(*AT, "tile_id")
        if self.roads.crossed:
            ends = ends.unionByName(mine.join(gates, spot).select(*AT, "row", "col"))

        end = lambda rows: rows.withColumn("value", F.lit(0.0)).withColumn("kind", F.lit(0))
        own = _in_batches(self._cells(self.own), end(ends), AT, _fill_tables(AT), f"route_id bigint, {shape}").join(
            self.ask.select("route_id", "tile_id"), "route_id"
        )
        blank = [F.lit(None).cast(self.ask.schema[c].dataType).alias(c) for c in self.flavour[1:]]
        own = own.select("route_id", "tile_id", *blank, "bi", "bj", "cell", "cost", "dist")
        if not self.roads.crossed:
            return own
        keys = [*self.flavour, "bi", "bj"]
        wanted = self.ask.select(*self.flavour).distinct()
        among = wanted.join(gates.select(*spot).distinct(), "tile_id")
        cells = self.price(among.join(self.roads.cells, spot), False).select(*keys, "row", "col", "cost")
        ddl = ", ".join(f"{c} {self.ask.schema[c].dataType.simpleString()}" for c in self.flavour)
        shared = _in_batches(cells, end(among.join(gates, spot).select(*keys, "row", "col")), keys, _fill_tables(keys), f"{ddl}, {shape}")
        return own.unionByName(shared.withColumn("route_id", F.lit(None).cast("bigint")))

    def _places(self, rows: DataFrame) -> DataFrame:
        wide = self.block * REGION
        return rows.withColumn("ri", F.floor(F.col("row") / wide).cast("int")).withColumn("rj", F.floor(F.col("col") / wide).cast("int"))

    def _tables_of(self, active: DataFrame) -> DataFrame:
        """Tables of the blocks of each active (route_id, ri, rj): the request's own before shared ones."""
        region = lambda axis: F.floor(F.col(axis) / REGION).cast("int")
        placed = self.tables.withColumn("ri", region("bi")).withColumn("rj", region("bj"))
        picked = ["route_id", "ri", "rj", "tile_id", "bi", "bj", "cell", "cost", "dist"]
        own = placed.where("route_id IS NOT NULL").join(active, ["route_id", "ri", "rj"], "left_semi").select(*picked)
        if not self.roads.crossed:
            return own
        met = active.join(self.ask.select("route_id", *self.flavour), "route_id").join(
            placed.where("route_id IS NULL").drop("route_id"), [*self.flavour, "ri", "rj"]
        )
        return own.unionByName(met.join(self.own.select(*AT), AT, "left_anti").select(*picked))

    def known(self) -> DataFrame:
        """(route_id, row, col, dist): least cost so far of every border cell that was reached."""
        rows = self.spark.read.schema("route_id bigint, tile_id bigint, row int, col int, dist double, leaves boolean, round int").parquet(self.reached)
        return rows.where("NOT leaves").groupBy("route_id", "row", "col").agg(F.min("dist").alias("dist"))

    def forward(self) -> Search:
        """Solves region after region until no border cell improves. Beyond the best arrival nothing is followed."""
        keys = ["route_id", "ri", "rj"]
        given = self._places(self.ask.select("route_id", F.col("start_row").alias("row"), F.col("start_col").alias("col"), F.lit(0.0).alias("dist")))
        given = given.select(*keys, "row", "col", "dist", F.lit(0).alias("kind"))
        n = 0
        while True:
            active = given.select(*keys).distinct()
            if n:
                seen = self._places(self.known()).join(active, keys, "left_semi")
                given = given.unionByName(seen.select(*keys, "row", "col", "dist", F.lit(2).alias("kind")))
            solved = _together(self._tables_of(active), given, keys).applyInPandas(
                _solve(self.block, REGION), "route_id bigint, tile_id bigint, row int, col int, dist double, leaves boolean"
            )
            solved.withColumn("round", F.lit(n)).write.mode("append").parquet(self.reached)
            if not self.roads.crossed:
                return self
            rows = self.spark.read.schema(
                "route_id bigint, tile_id bigint, row int, col int, dist double, leaves boolean, round int"
            ).parquet(self.reached)
            goal = self.known().join(
                self.ask.select("route_id", F.col("dest_row").alias("row"), F.col("dest_col").alias("col")), ["route_id", "row", "col"]
            ).select("route_id", F.col("dist").alias("goal"))
            sent = rows.where(F.col("leaves") & (F.col("round") == n)).join(goal, "route_id", "left")
            sent = self._places(sent.where(F.col("goal").isNull() | (F.col("dist") + 1 < F.col("goal"))))
            given = settle(sent.select(*keys, "row", "col", "dist", F.lit(1).alias("kind")), "arrivals")
            n += 1
            if given.isEmpty():
                return self

    def costs(self) -> DataFrame:
        """(route_id, cost) of the requests whose destination was reached."""
        goal = self.ask.select("route_id", F.col("dest_row").alias("row"), F.col("dest_col").alias("col"))
        return self.known().join(goal, ["route_id", "row", "col"]).select("route_id", F.col("dist").alias("cost"))

    def _marked(self, known: DataFrame, ends: DataFrame) -> DataFrame:
        """(route_id, row, col) of the border cells on best paths, destinations included."""
        if not self.roads.crossed:
            return ends
        keys, path = ["route_id", "ri", "rj"], new_path(self.spark, "marked")
        placed, n, now = self._places(known), 0, ends
        wide = self.block * REGION
        beside = F.array(*[F.struct((F.col("row") + r).alias("y"), (F.col("col") + c).alias("x")) for r, c in MOVES])
        around = known.select("*", F.inline(beside)).withColumn("ri", F.floor(F.col("y") / wide).cast("int")).withColumn("rj", F.floor(F.col("x") / wide).cast("int"))
        around = around.where((F.col("ri") != F.floor(F.col("row") / wide)) | (F.col("rj") != F.floor(F.col("col") / wide)))
        around = settle(around.select(*keys, "row", "col", "dist").distinct(), "around")
        rows = lambda df, kind: df.select(*keys, "row", "col", "dist", F.lit(kind).alias("kind"))
        while True:
            marks = self._places(now.select("route_id", "row", "col").withColumn("dist", F.lit(0.0)))
            active = marks.select(*keys).distinct()
            given = rows(marks, 0).unionByName(rows(placed.join(active, keys, "left_semi"), 2)).unionByName(rows(around.join(active, keys, "left_semi"), 1))
            found = _together(self._tables_of(active), given, keys).applyInPandas(
                _mark(TIE * self.block * self.block), "route_id bigint, row int, col int, leaves boolean"
            )
            found.withColumn("round", F.lit(n)).write.mode("append").parquet(path)
            all_ = self.spark.read.schema("route_id bigint, row int, col int, leaves boolean, round int").parquet(path)
            old = all_.where("NOT leaves").select("route_id", "row", "col").distinct()
            now = settle(all_.where(F.col("leaves") & (F.col("round") == n)).select("route_id", "row", "col").distinct().join(old, ["route_id", "row", "col"], "left_anti"), "marks")
            n += 1
            if now.isEmpty():
                return old

    def paths(self) -> DataFrame:
        """(route_id, seq, row, col) of every reached request, seq 0 at the start.

        **Departure**: among equally good predecessors the smallest (row, col) is taken; a priority queue would depend
        on its insertion order.
        """
        cell = ["route_id", "row", "col"]
        known = settle(self.known(), "known") if self.roads.crossed else self.known()
        dest = self.ask.select("route_id", F.col("dest_row").alias("row"), F.col("dest_col").alias("col"))
        dest = dest.join(known.select(*cell), cell, "left_semi")
        marked = self._marked(known, dest)
        at = lambda df, r="row", c="col": df.withColumn("bi", block_of(r, self.block)).withColumn("bj", block_of(c, self.block))
        blocks = at(marked).select(*AT).distinct()
        gates = at(known).select(*AT, "row", "col", "dist", F.lit(2).alias("kind")).unionByName(
            at(marked.withColumn("dist", F.lit(float("inf")))).select(*AT, "row", "col", "dist", F.lit(0).alias("kind"))
        )
        if self.roads.crossed:
            beside = F.array(*[F.struct((F.col("row") + r).alias("y"), (F.col("col") + c).alias("x")) for r, c in MOVES])
            out = known.select(*cell, "dist", F.inline(beside))
            out = at(out, "y", "x").where((F.col("bi") != block_of("row", self.block)) | (F.col("bj") != block_of("col", self.block)))
            gates = gates.unionByName(out.select(*AT, "row", "col", "dist", F.lit(1).alias("kind")).distinct())
            blocks = settle(blocks, "path_blocks")
        gates = gates.join(blocks, AT, "left_semi")
        cells = self._cells(blocks.join(self.ask, "route_id"))
        walked = _in_batches(
            cells, gates.withColumnRenamed("dist", "value"), AT, _unpack_blocks,
            "route_id bigint, e_row int, e_col int, step int, row int, col int, n_row double, n_col double",
        )
        walked = settle(walked, "walked")
        if not self.roads.crossed:
            length = walked.groupBy("route_id").agg(F.max("step").alias("_last"))
            return walked.join(length, "route_id").select("route_id", (F.col("_last") - F.col("step")).alias("seq"), "row", "col")
        return _chained(walked, dest)


def _chained(walked: DataFrame, dest: DataFrame) -> DataFrame:
    """Path rows from the pieces that follow each other from the destination, found by pointer doubling.

    Every piece learns its way to the start in as many rounds as the logarithm of the pieces; the pieces a path uses
    are those its destination leads to within 1, 2, 4, ... pieces.
    """
    code = lambda r, c: F.col(r).cast("bigint") * CODE + F.col(c).cast("bigint")
    pieces = walked.groupBy("route_id", code("e_row", "e_col").alias("id")).agg(
        F.max(code("n_row", "n_col")).alias("to"), F.count(F.lit(1)).alias("w")
    )
    used = dest.select("route_id", code("row", "col").alias("id"))
    now = settle(pieces, "pieces")
    while not now.where("to IS NOT NULL").isEmpty():
        step = now.select("route_id", "id", "to")
        used = settle(used.union(used.join(step, ["route_id", "id"]).where("to IS NOT NULL").select("route_id", F.col("to").alias("id"))).distinct(), "used")
        ahead = now.select("route_id", F.col("id").alias("to"), F.col("to").alias("_to"), F.col("w").alias("_w"))
        now = settle(now.join(ahead, ["route_id", "to"], "left").select("route_id", "id", F.col("_to").alias("to"), (F.col("w") + F.coalesce("_w", F.lit(0))).alias("w")), "pieces")
    left = used.join(now, ["route_id", "id"]).select("route_id", "id", "w")
    placed = walked.withColumn("id", code("e_row", "e_col")).join(left, ["route_id", "id"])
    return placed.select("route_id", (F.col("w") - 1 - F.col("step")).cast("int").alias("seq"), "row", "col")
