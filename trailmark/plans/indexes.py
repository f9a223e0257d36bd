"""The physical indexes: how each keys a row, and which keys a window needs.

Every index adds columns to a trajectory table (``index``) and makes of windows the rows that may
answer one of them (``select``), always a superset of the answers: rows with a point in a
window, or, for ``whole``, with no point outside it. The latter serves similarity: all points of a trajectory
within eps of another lie in the other's envelope grown by eps.
"""

from __future__ import annotations

from collections import deque
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from trailmark.functions.grid import Grid, subtree
from trailmark.model import BEIJING, Extent
from trailmark.plans.ranges import MOST, Plan, masked, merged, united, within


class Planned:
    """What the indexes with plans have in common; ``plan(window, whole)`` and ``rows(df, plan, whole)`` are their own."""

    def select(self, df: DataFrame, windows: list, whole: bool = False) -> DataFrame:
        return self.rows(df, united([self.plan(w, whole) for w in windows] or [Plan()]), whole)

    def candidates(self, df: DataFrame, window) -> DataFrame:
        return self.select(df, [window])

    def rows(self, df: DataFrame, plan: Plan, whole: bool) -> DataFrame:
        return df.where(within("idx", plan.ranges))

    def parts(self) -> dict[str, Column]:
        return {}


def _walk(grid: Grid, win, whole: bool, visit) -> Plan:
    """Breadth-first over nodes whose element meets the window; ``visit`` says what a node that is not contained adds.

    For ``whole`` the window must meet the node's own cell, as that holds the lower left corner of all below.
    """
    plan, todo = Plan(), deque([(0, 0, 0)])
    while todo:
        level, ix, iy = todo.popleft()
        x0, y0, x1, y1 = grid.element(level, ix, iy)
        w = 1 << grid.resolution - level
        if whole and (win[0] > x0 + w - 1 or win[1] > y0 + w - 1):
            continue
        if win[0] > x1 or win[2] < x0 or win[1] > y1 or win[3] < y0:
            continue
        if win[0] <= x0 and win[1] <= y0 and x1 <= win[2] and y1 <= win[3]:
            plan.contained += 1
            visit(plan, level, ix, iy, True)
            continue
        plan.met += 1
        visit(plan, level, ix, iy, False)
        if level < grid.resolution:
            todo.extend((level + 1, 2 * ix + dx, 2 * iy + dy) for dx in (0, 1) for dy in (0, 1))
    plan.ranges, plan.sure = merged(plan.ranges), merged(plan.sure)
    return plan


@dataclass(frozen=True)
class ShapeIndex(Planned):
    """Key (quad << alpha * beta) | shape: an element of alpha by beta cells of its level, a bit a cell.

    A contained element takes its whole subtree; one that the window meets takes its
    rows whose shape has a cell in common with the window.
    """

    extent: Extent = BEIJING
    resolution: int = 8
    alpha: int = 3
    beta: int = 3
    name = "shape"

    @property
    def grid(self) -> Grid:
        return Grid(self.extent, self.resolution, self.alpha, self.beta, self.alpha, self.beta)

    def index(self, df: DataFrame) -> DataFrame:
        bits = self.alpha * self.beta
        return self.grid.indexed(df).withColumn("idx", F.shiftleft("quad", bits).bitwiseOR(F.col("shape")))

    def plan(self, window, whole: bool = False) -> Plan:
        grid, win, bits = self.grid, self.grid.window(window), self.alpha * self.beta

        def visit(plan: Plan, level: int, ix: int, iy: int, contained: bool) -> None:
            code = grid.node_code(level, ix, iy)
            if contained:
                plan.ranges.append((code << bits, (code + subtree(grid.resolution, level) << bits) - 1))
                plan.sure.append((code, code + subtree(grid.resolution, level) - 1))
                return
            mask = grid.window_mask(level, ix, iy, win)
            if mask:
                plan.ranges.append((code << bits, (code + 1 << bits) - 1))
                plan.masks[code] = [mask]

        return _walk(grid, win, whole, visit)

    def rows(self, df: DataFrame, plan: Plan, whole: bool) -> DataFrame:
        return masked(super().rows(df, plan, whole), plan, "quad", whole)

    def parts(self) -> dict[str, Column]:
        """What a key says: its node and shape."""
        bits = self.alpha * self.beta
        return {"quad": F.shiftright("idx", bits), "shape": F.col("idx").bitwiseAND(F.lit((1 << bits) - 1).cast("bigint"))}


@dataclass(frozen=True)
class XZPlusIndex(ShapeIndex):
    """Elements of 2 by 2 cells, with a mask of alpha by beta parts."""

    name = "xzplus"

    @property
    def grid(self) -> Grid:
        return Grid(self.extent, self.resolution, 2, 2, self.alpha, self.beta)


@dataclass(frozen=True)
class XZIndex(Planned):
    """Key: the quad of an element of 2 by 2 cells, no shapes."""

    extent: Extent = BEIJING
    resolution: int = 8
    name = "xz"

    @property
    def grid(self) -> Grid:
        return Grid(self.extent, self.resolution, 2, 2, 2, 2)

    def index(self, df: DataFrame) -> DataFrame:
        return self.grid.indexed(df).withColumn("idx", F.col("quad"))

    def plan(self, window, whole: bool = False) -> Plan:
        grid, win = self.grid, self.grid.window(window)

        def visit(plan: Plan, level: int, ix: int, iy: int, contained: bool) -> None:
            code = grid.node_code(level, ix, iy)
            plan.ranges.append((code, code + subtree(grid.resolution, level) - 1 if contained else code))

        return _walk(grid, win, whole, visit)


#: Position codes of the sets of occupied quarters (lower left 1, lower right 2, upper left 4, upper right 8).
POSITIONS = {3: 1, 5: 2, 7: 3, 15: 4, 11: 5, 13: 6, 14: 7, 9: 8, 6: 9, 1: 10}


@dataclass(frozen=True)
class XZStarIndex(Planned):
    """Key: element of 2 by 2 cells and the position code of its occupied quarters.

    An element has nine codes, ten on the last level; a subtree's codes are consecutive.
    """

    extent: Extent = BEIJING
    resolution: int = 8
    name = "xzstar"

    @property
    def grid(self) -> Grid:
        return Grid(self.extent, self.resolution, 2, 2, 2, 2)

    def codes(self, level: int) -> int:
        """Codes of a subtree whose root is on this level."""
        return (39 * 4 ** (self.resolution - level) - 9) // 3

    def _base(self, level: int, ix: int, iy: int) -> int:
        """The number before the element's first code."""
        total = -10
        for lev in range(1, level + 1):
            s = level - lev
            total += 9 + ((ix >> s & 1) + 2 * (iy >> s & 1)) * self.codes(lev)
        return total

    def index(self, df: DataFrame) -> DataFrame:
        grid = self.grid
        df = grid.indexed(df)
        total = F.lit(-10).cast("bigint")
        for lev in range(1, grid.resolution + 1):
            s = grid.resolution - lev
            q = F.shiftright("gx", s).bitwiseAND(F.lit(1)) + 2 * F.shiftright("gy", s).bitwiseAND(F.lit(1))
            total = total + F.when(F.col("level") >= lev, 9 + q * F.lit(self.codes(lev)).cast("bigint")).otherwise(F.lit(0))
        # the mask's bits are column by column, the quarters row by row
        quarters = F.lit(0)
        for bit, quarter in ((0, 1), (1, 4), (2, 2), (3, 8)):
            quarters = quarters + F.when(F.col("shape").bitwiseAND(F.lit(1 << bit)) != 0, quarter).otherwise(0)
        position = F.lit(0)
        for q, p in POSITIONS.items():
            position = F.when(quarters == q, p).otherwise(position)
        return df.withColumn("pos", position).withColumn("idx", total + F.col("pos"))

    def plan(self, window, whole: bool = False) -> Plan:
        grid, win = self.grid, self.grid.window(window)

        def visit(plan: Plan, level: int, ix: int, iy: int, contained: bool) -> None:
            base = self._base(level, ix, iy)
            if contained:
                plan.ranges.append((base + 1, base + self.codes(level)))
                return
            mask = grid.window_mask(level, ix, iy, win)
            quarters = sum(quarter for bit, quarter in ((0, 1), (1, 4), (2, 2), (3, 8)) if mask >> bit & 1)
            fits = (lambda q: not q & ~quarters) if whole else (lambda q: q & quarters)
            plan.ranges.extend((base + p, base + p) for q, p in POSITIONS.items() if fits(q) and (p < 10 or level == grid.resolution))

        return _walk(grid, win, whole, visit)


class Intervals:
    """What the indexes with an interval of keys have in common; ``interval(window)`` is their own."""

    def select(self, df: DataFrame, windows: list, whole: bool = False) -> DataFrame:
        asked = [self.interval(w) for w in windows]
        if len(asked) > MOST:  # one for all
            asked = [(min(lo for lo, _ in asked), max(hi for _, hi in asked))]
        test = "(idx >= {0}L AND max_sfc <= {1}L)" if whole else "(idx <= {1}L AND max_sfc >= {0}L)"
        return df.where(F.expr(" OR ".join(test.format(*a) for a in asked) or "false"))

    def candidates(self, df: DataFrame, window) -> DataFrame:
        return self.select(df, [window])


@dataclass(frozen=True)
class CurveIndex(Intervals):
    """Key interval (min_sfc, max_sfc): an envelope's corners on a curve that grows along both axes.

    ``theta`` gives each bit of x, then of y, lowest first, its place in the key.
    """

    theta: tuple[int, ...] = ()
    extent: Extent = BEIJING
    bits: int = 20
    name = "lmsfc"

    def __post_init__(self):
        if not self.theta:  # alternating bits: the Z-order curve
            object.__setattr__(self, "theta", (*range(0, 2 * self.bits, 2), *range(1, 2 * self.bits, 2)))
        x, y = self.theta[: self.bits], self.theta[self.bits :]
        if len(y) != self.bits or len(set(self.theta)) != 2 * self.bits or not all(0 <= t <= 62 for t in self.theta) or list(x) != sorted(x) or list(y) != sorted(y):
            raise ValueError("theta needs 2 * bits different places from 0 to 62, growing along each axis")

    @property
    def grid(self) -> Grid:
        return Grid(self.extent, self.bits, 2, 2, 2, 2)

    def sfc(self, x: Column, y: Column) -> Column:
        """Key of a cell (fine cells of 2 ** bits by 2 ** bits)."""
        parts = []
        for v, places in ((x, self.theta[: self.bits]), (y, self.theta[self.bits :])):
            parts += [F.shiftleft(F.shiftright(v, i).bitwiseAND(F.lit(1).cast("bigint")), t) for i, t in enumerate(places)]
        out = parts[0]
        for p in parts[1:]:
            out = out.bitwiseOR(p)
        return out

    def key(self, x: int, y: int) -> int:
        return sum((v >> i & 1) << t for v, places in ((x, self.theta[: self.bits]), (y, self.theta[self.bits :])) for i, t in enumerate(places))

    def index(self, df: DataFrame) -> DataFrame:
        g = self.grid
        low = self.sfc(g.fine(F.array_min("xs"), 0), g.fine(F.array_min("ys"), 1))
        high = self.sfc(g.fine(F.array_max("xs"), 0), g.fine(F.array_max("ys"), 1))
        return df.withColumns({"idx": low, "max_sfc": high})

    def interval(self, window) -> tuple[int, int]:
        x0, y0, x1, y1 = self.grid.window(window)
        return self.key(x0, y0), self.key(x1, y1)



@dataclass(frozen=True)
class BMNode:
    dim: int  # -1: leaf
    left: int = -1
    right: int = -1
    child: int = -1


@dataclass(frozen=True)
class BMTreeIndex(Intervals):
    """As ``CurveIndex``, on a piecewise curve: a tree says which axis gives the next bit, from the highest down.

    A leaf's remaining bits alternate, beginning with the axis after the last one
    taken. Each axis gives its bits from the highest down, so the curve grows along both.
    """

    nodes: tuple[BMNode, ...] = (BMNode(-1),)
    extent: Extent = BEIJING
    bits: int = 20
    name = "bmtree"

    @property
    def grid(self) -> Grid:
        return Grid(self.extent, self.bits, 2, 2, 2, 2)

    def keys(self, x: np.ndarray, y: np.ndarray) -> np.ndarray:
        """Keys of cells, all at once."""
        out = np.zeros(len(x), np.int64)
        axes = (x.astype(np.int64), y.astype(np.int64))
        todo = [(0, np.arange(len(x)), (0, 0), 1)]
        while todo:
            at, rows, used, last = todo.pop()
            node = self.nodes[at]
            if node.dim < 0 or not len(rows):
                used, turn = list(used), 1 - last
                while sum(used) < 2 * self.bits and len(rows):
                    if used[turn] < self.bits:
                        out[rows] = out[rows] << 1 | axes[turn][rows] >> self.bits - 1 - used[turn] & 1
                        used[turn] += 1
                    turn = 1 - turn
                continue
            bit = axes[node.dim][rows] >> self.bits - 1 - used[node.dim] & 1
            out[rows] = out[rows] << 1 | bit
            now = tuple(u + (i == node.dim) for i, u in enumerate(used))
            if node.child >= 0:
                todo.append((node.child, rows, now, node.dim))
            else:
                todo += [(node.left, rows[bit == 0], now, node.dim), (node.right, rows[bit == 1], now, node.dim)]
        return out

    def index(self, df: DataFrame) -> DataFrame:
        g = self.grid

        @F.pandas_udf("bigint")
        def key(x: pd.Series, y: pd.Series) -> pd.Series:
            return pd.Series(self.keys(x.to_numpy(), y.to_numpy()))

        low = key(g.fine(F.array_min("xs"), 0), g.fine(F.array_min("ys"), 1))
        high = key(g.fine(F.array_max("xs"), 0), g.fine(F.array_max("ys"), 1))
        return df.withColumns({"idx": low, "max_sfc": high})

    def interval(self, window) -> tuple[int, int]:
        x0, y0, x1, y1 = self.grid.window(window)
        low, high = self.keys(np.array([x0, x1]), np.array([y0, y1]))
        return int(low), int(high)



@dataclass
class AdaptiveIndex(Planned):
    """Key (order << bits) | shape order, over the nodes that hold many trajectories.

    ``build`` counts the trajectories of every node's subtree and keeps the root and the nodes
    with ``least`` or more; each has its own mask size and a number in preorder. A
    trajectory belongs to the deepest kept node above its own; its shape is taken in
    that node's element. A node's distinct shapes are ordered so that neighbours
    differ in few cells, and its union mask skips windows that none of them meets.
    """

    extent: Extent = BEIJING
    resolution: int = 8
    alpha: int = 3
    beta: int = 3
    least: int = 4
    #: Mask sizes from sparse to dense nodes, with the counts from which they hold.
    sizes: tuple[tuple[int, int, int], ...] = ((0, 2, 2), (8, 3, 3), (64, 4, 4))
    nodes: list[dict] = field(default_factory=list)  # order, level, ix, iy, quad, n, alpha, beta, union
    name = "adaptive"

    @property
    def grid(self) -> Grid:
        return Grid(self.extent, self.resolution, self.alpha, self.beta, self.alpha, self.beta)

    def build(self, df: DataFrame) -> AdaptiveIndex:
        """Learns the nodes; they are at most (4 ** (resolution + 1) - 1) / 3, whatever the table's size."""
        grid, r = self.grid, self.resolution
        rows = grid.indexed(df).groupBy("level", "gx", "gy").agg(F.count("*").alias("n"))
        path = F.transform(F.sequence(F.lit(0), F.col("level")), lambda lev: F.struct(lev.alias("level"), F.floor(F.col("gx") / F.pow(F.lit(2.0), r - lev)).alias("ix"), F.floor(F.col("gy") / F.pow(F.lit(2.0), r - lev)).alias("iy")))
        counts = rows.select("n", F.explode(path).alias("v")).groupBy("v.level", "v.ix", "v.iy").agg(F.sum("n").alias("n"))
        kept = counts.where((F.col("n") >= self.least) | (F.col("level") == 0)).collect()
        self.nodes = []
        for c in kept or [{"level": 0, "ix": 0, "iy": 0, "n": 0}]:
            alpha, beta = next((a, b) for n, a, b in reversed(self.sizes) if c["n"] >= n)
            self.nodes.append({"level": c["level"], "ix": c["ix"], "iy": c["iy"], "quad": grid.node_code(c["level"], c["ix"], c["iy"]), "n": c["n"], "alpha": alpha, "beta": beta, "union": (1 << alpha * beta) - 1})
        self.nodes.sort(key=lambda n: n["quad"])
        for i, n in enumerate(self.nodes):
            n["order"] = i
        shapes = self.shapes(df).cache()
        unions = {u["q_order"]: u["m"] for u in shapes.groupBy("q_order").agg(F.bit_or("shape").alias("m")).collect()}
        for n in self.nodes:
            n["union"] = unions.get(n["order"], 0)
        self._built = df, shapes
        return self

    def _table(self, spark) -> DataFrame:
        return spark.createDataFrame([(n["order"], n["level"], n["quad"], n["quad"] + subtree(self.resolution, n["level"]) - 1, n["alpha"], n["beta"]) for n in self.nodes], "q_order bigint, q_level int, q_lo bigint, q_hi bigint, a int, b int")

    def _placed(self, df: DataFrame) -> DataFrame:
        """Adds q_order and the shape in the node's element; nodes are few, so their table is broadcast."""
        grid, spark, r = self.grid, df.sparkSession, self.resolution
        rows = grid.indexed(df).drop("shape")
        # each quad's deepest kept ancestor, worked out once for each distinct quad
        quads = rows.select("quad", "level", "gx", "gy").distinct()
        up = F.transform(F.sequence(F.lit(0), F.col("level")), lambda lev: grid.code(F.col("gx"), F.col("gy"), lev))
        above = quads.select("quad", F.explode(up).alias("q_lo")).join(F.broadcast(self._table(spark)), "q_lo")
        best = above.groupBy("quad").agg(F.max(F.struct("q_level", "q_order", "a", "b")).alias("best"))
        rows = rows.join(best, "quad").withColumns({"q_order": F.col("best.q_order"), "q_level": F.col("best.q_level"), "a": F.col("best.a"), "b": F.col("best.b")})
        width = F.pow(F.lit(2.0), r - F.col("q_level"))
        rows = rows.withColumns({"_ax": (F.floor(F.col("gx") / width) * width).cast("bigint"), "_ay": (F.floor(F.col("gy") / width) * width).cast("bigint")})
        shape = grid.mask(grid.cells(), F.col("_ax"), F.col("_ay"), F.col("q_level"), F.col("a"), F.col("b"))
        return rows.withColumn("shape", shape).drop("best", "_ax", "_ay", "a", "b")

    def shapes(self, df: DataFrame) -> DataFrame:
        """q_order, shape, n and shape_order of every distinct shape of every node."""
        counts = self._placed(df).groupBy("q_order", "shape").agg(F.count("*").alias("n"))
        return shape_orders(counts, "q_order")

    def index(self, df: DataFrame) -> DataFrame:
        if not self.nodes:
            self.build(df)
        # the masks have 16 cells at most, hence a node 65,535 shapes and the key 16 bits for them
        built, shapes = getattr(self, "_built", (None, None))
        orders = (shapes if built is df else self.shapes(df)).select("q_order", "shape", "shape_order")
        rows = self._placed(df).join(orders, ["q_order", "shape"])
        return rows.withColumn("idx", F.shiftleft("q_order", 16).bitwiseOR(F.col("shape_order").cast("bigint")))

    def plan(self, window, whole: bool = False) -> Plan:
        """Over orders. Every kept node is looked at: its element may reach out of its parent's."""
        grid, win, plan = self.grid, self.grid.window(window), Plan()
        for n in self.nodes:
            x0, y0, x1, y1 = grid.element(n["level"], n["ix"], n["iy"])
            w = 1 << grid.resolution - n["level"]
            if win[0] > x1 or win[2] < x0 or win[1] > y1 or win[3] < y0 or whole and (win[0] > x0 + w - 1 or win[1] > y0 + w - 1):
                continue
            if win[0] <= x0 and win[1] <= y0 and x1 <= win[2] and y1 <= win[3]:
                plan.contained += 1
                plan.sure.append((n["order"], n["order"]))
            else:
                mask = grid.window_mask(n["level"], n["ix"], n["iy"], win, n["alpha"], n["beta"]) & n["union"]
                if not mask:
                    continue
                plan.met += 1
                plan.masks[n["order"]] = [mask]
            plan.ranges.append((n["order"] << 16, (n["order"] + 1 << 16) - 1))
        plan.ranges, plan.sure = merged(plan.ranges), merged(plan.sure)
        return plan

    def rows(self, df: DataFrame, plan: Plan, whole: bool) -> DataFrame:
        return masked(super().rows(df, plan, whole), plan, "q_order", whole)


def greedy_tour(shapes: np.ndarray) -> np.ndarray:
    """Positions of the sorted, distinct shapes in a tour that always goes to the nearest unvisited one (fewest
    differing cells, then the smallest).

    Masks of up to 16 cells are looked up by what they differ in, one cell, two cells and so on, until
    fewer shapes are left than there are such masks.
    """
    n, bits = len(shapes), int(shapes.max()).bit_length() if len(shapes) else 0
    tour = np.zeros(n, np.int64)
    spot = np.full(1 << bits, -1, np.int64) if bits <= 16 else None  # where an unvisited shape is
    rings: list[np.ndarray] = []
    if spot is not None:
        spot[shapes] = np.arange(n)
        masks = np.arange(1 << bits, dtype=np.int64)
        cells = np.bitwise_count(masks)
        rings = [masks[cells == d] for d in range(bits + 1)]
    left, at = np.ones(n, bool), 0
    for i in range(n):
        tour[at], left[at] = i, False
        if i + 1 == n:
            break
        here, found = shapes[at], -1
        if spot is not None:
            spot[here] = -1
            for ring in rings[1:]:
                if len(ring) > n - i:
                    break
                near = spot[here ^ ring]
                near = near[near >= 0]
                if len(near):
                    found = int(near.min())
                    break
        if found < 0:
            rest = np.flatnonzero(left)
            found = int(rest[np.bitwise_count(shapes[rest] ^ here).argmin()])
        at = found
    return tour


def shape_orders(counts: DataFrame, key: str) -> DataFrame:
    """Adds shape_order to (key, shape, n): a greedy tour over each key's distinct shapes, from the smallest on."""

    def order(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("shape", ignore_index=True)
        return pdf.assign(shape_order=greedy_tour(pdf["shape"].to_numpy(np.int64)))

    return counts.groupBy(key).applyInPandas(order, f"{key} bigint, shape bigint, n bigint, shape_order bigint")


KINDS = {"shape": ShapeIndex, "xz": XZIndex, "xzplus": XZPlusIndex, "xzstar": XZStarIndex, "lmsfc": CurveIndex, "bmtree": BMTreeIndex, "adaptive": AdaptiveIndex}
