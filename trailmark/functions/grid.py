"""Quadtree codes as integer arithmetic, the same for rows (columns) and for windows (Python).

The extent is cut into 2**R by 2**R fine cells. A point's fine cell is computed in
integers from its micro-degrees and clamped, so cells are exact and monotone: a point in
a window has its fine cell in the window's range of fine cells. Every level, cell and
mask is derived from fine cells by shifts and divisions, hence is exact too.

A node is (level l, cell ix, iy); its element stretches ``ex`` by ``ey`` cells of its level
from that cell. A trajectory belongs to the deepest node whose element, anchored
at the cell of its lower left corner, holds its envelope.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

from trailmark.model import MICRO, Extent


def subtree(resolution: int, level: int) -> int:
    """Nodes of a subtree whose root is on this level."""
    return (4 ** (resolution - level + 1) - 1) // 3


@dataclass(frozen=True)
class Grid:
    extent: Extent
    resolution: int = 8
    #: Element size in cells of its level.
    ex: int = 3
    ey: int = 3
    #: Cells of a shape mask.
    alpha: int = 3
    beta: int = 3

    def __post_init__(self):
        if min(self.ex, self.ey, self.alpha, self.beta) < 2:
            raise ValueError("elements and masks of less than 2 by 2 cells lose trajectories")
        if 2 * (self.resolution + 1) + self.alpha * self.beta > 62:
            raise ValueError("codes would not fit into 62 bits")

    # -- fine cells

    def fine(self, v: Column, axis: int) -> Column:
        lo, hi = self.extent.micro()[axis], self.extent.micro()[axis + 2]
        cell = F.floor((v.cast("bigint") - lo) * (1 << self.resolution) / F.lit(hi - lo))
        return F.greatest(F.lit(0), F.least(F.lit((1 << self.resolution) - 1), cell)).cast("bigint")

    def fine_at(self, degrees: float, axis: int) -> int:
        lo, hi = self.extent.micro()[axis], self.extent.micro()[axis + 2]
        # a window's edge may lie between micro-degrees: both edges go outwards by less than one
        cell = int((degrees * MICRO - lo) * (1 << self.resolution) // (hi - lo))
        return max(0, min((1 << self.resolution) - 1, cell))

    def window(self, w) -> tuple[int, int, int, int]:
        """Range of fine cells of (xmin, ymin, xmax, ymax), one micro-degree wider."""
        e = 1 / MICRO
        return self.fine_at(w[0] - e, 0), self.fine_at(w[1] - e, 1), self.fine_at(w[2] + e, 0), self.fine_at(w[3] + e, 1)

    # -- rows

    def level(self, x0: Column, y0: Column, x1: Column, y1: Column) -> Column:
        """Deepest level whose element at (x0, y0) holds (x1, y1); arguments are fine cells."""
        fits = []
        for lev in range(self.resolution + 1):
            s = self.resolution - lev
            inside = (F.shiftright(x1, s) - F.shiftright(x0, s) < self.ex) & (F.shiftright(y1, s) - F.shiftright(y0, s) < self.ey)
            fits.append(F.when(inside, F.lit(lev)).otherwise(F.lit(0)))
        return F.greatest(*fits)

    def code(self, x0: Column, y0: Column, level: Column) -> Column:
        """Preorder number of the node: one for each level, plus the subtrees passed on the way."""
        total = F.lit(0).cast("bigint")
        for lev in range(1, self.resolution + 1):
            s = self.resolution - lev
            q = F.shiftright(x0, s).bitwiseAND(F.lit(1)) + 2 * F.shiftright(y0, s).bitwiseAND(F.lit(1))
            total = total + F.when(level >= lev, 1 + q * F.lit(subtree(self.resolution, lev)).cast("bigint")).otherwise(F.lit(0))
        return total

    def anchor(self, fine: Column, level: Column) -> Column:
        """First fine cell of the node's cell."""
        size = F.expr("1L")
        width = F.lit(1 << self.resolution).cast("bigint")
        for lev in range(self.resolution + 1):
            size = F.when(level == lev, width / F.lit(1 << lev)).otherwise(size)
        size = size.cast("bigint")
        return fine - fine % size

    def mask(self, cells: Column, ax: Column, ay: Column, level: Column, alpha=None, beta=None) -> Column:
        """Cells of the element's mask that hold a point; bit i * beta + j. ``cells`` is an array of (x, y)."""
        a, b = alpha if alpha is not None else F.lit(self.alpha), beta if beta is not None else F.lit(self.beta)
        width = F.expr(f"shiftleft(1L, {self.resolution})") / F.pow(F.lit(2.0), level)

        def bit(p: Column) -> Column:
            i = F.least(F.floor((p.x - ax) * a / (self.ex * width)), a - 1)
            j = F.least(F.floor((p.y - ay) * b / (self.ey * width)), b - 1)
            return F.pow(F.lit(2.0), (i * b + j).cast("double")).cast("bigint")

        bits = F.array_distinct(F.transform(cells, bit))
        return F.aggregate(bits, F.lit(0).cast("bigint"), lambda m, x: m.bitwiseOR(x))

    def indexed(self, df):
        """Adds level, quad, shape and (fine) gx, gy of the anchor to a trajectory table."""
        micro = lambda c: F.array_min(c), lambda c: F.array_max(c)
        df = df.withColumns({"_x0": self.fine(micro[0]("xs"), 0), "_y0": self.fine(micro[0]("ys"), 1), "_x1": self.fine(micro[1]("xs"), 0), "_y1": self.fine(micro[1]("ys"), 1)})
        df = df.withColumn("level", self.level(*(F.col(c) for c in ("_x0", "_y0", "_x1", "_y1"))))
        df = df.withColumn("quad", self.code(F.col("_x0"), F.col("_y0"), F.col("level")))
        df = df.withColumns({"gx": self.anchor(F.col("_x0"), F.col("level")), "gy": self.anchor(F.col("_y0"), F.col("level"))})
        df = df.withColumn("shape", self.mask(self.cells(), F.col("gx"), F.col("gy"), F.col("level")))
        return df.drop("_x0", "_y0", "_x1", "_y1")

    def cells(self) -> Column:
        return F.zip_with("xs", "ys", lambda x, y: F.struct(self.fine(x, 0).alias("x"), self.fine(y, 1).alias("y")))

    # -- windows

    def node_code(self, level: int, ix: int, iy: int) -> int:
        total = 0
        for lev in range(1, level + 1):
            s = level - lev
            total += 1 + ((ix >> s & 1) + 2 * (iy >> s & 1)) * subtree(self.resolution, lev)
        return total

    def element(self, level: int, ix: int, iy: int) -> tuple[int, int, int, int]:
        """Fine cells of a node's element, last ones included; the extent's edge cuts it off."""
        w, most = 1 << self.resolution - level, (1 << self.resolution) - 1
        return ix * w, iy * w, min(most, ix * w + self.ex * w - 1), min(most, iy * w + self.ey * w - 1)

    def window_mask(self, level: int, ix: int, iy: int, win, alpha: int | None = None, beta: int | None = None) -> int:
        """Mask cells of the element that the window's fine cells meet."""
        a, b = alpha or self.alpha, beta or self.beta
        w = 1 << self.resolution - level
        x0, y0, x1, y1 = self.element(level, ix, iy)
        if win[0] > x1 or win[2] < x0 or win[1] > y1 or win[3] < y0:
            return 0
        i0, i1 = (max(win[0], x0) - x0) * a // (self.ex * w), (min(win[2], x1) - x0) * a // (self.ex * w)
        j0, j1 = (max(win[1], y0) - y0) * b // (self.ey * w), (min(win[3], y1) - y0) * b // (self.ey * w)
        mask = 0
        for i in range(i0, min(i1, a - 1) + 1):
            for j in range(j0, min(j1, b - 1) + 1):
                mask |= 1 << i * b + j
        return mask
