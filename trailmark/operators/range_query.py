"""Spatial range queries: trajectories with a stored point in a closed window."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from trailmark.functions.grid import Grid
from trailmark.model import BEIJING, MICRO, Extent

#: Cells of windows, with four sides and four cells each, that are broadcast; more are joined by shuffle.
FEW = 200_000
#: Windows that one scan answers.
BLOCK = 1000
_SIDES = ("xmin", "ymin", "xmax", "ymax")


def _in(x: Column, y: Column, w: dict[str, Column]) -> Column:
    x, y = x / F.lit(float(MICRO)), y / F.lit(float(MICRO))
    return (x >= w["xmin"]) & (x <= w["xmax"]) & (y >= w["ymin"]) & (y <= w["ymax"])


def _sides(window) -> dict[str, Column]:
    return {c: F.lit(float(v)) for c, v in zip(("xmin", "ymin", "xmax", "ymax"), window, strict=True)}


def meets(w: dict[str, Column]) -> Column:
    """Envelope test first, which Parquet statistics can use, then the points."""
    box = (F.col("xmin") <= w["xmax"]) & (F.col("xmax") >= w["xmin"]) & (F.col("ymin") <= w["ymax"]) & (F.col("ymax") >= w["ymin"])
    return box & F.exists(F.arrays_zip("xs", "ys"), lambda p: _in(p.xs, p.ys, w))


def brute_force(df: DataFrame, window) -> DataFrame:
    return df.where(F.exists(F.arrays_zip("xs", "ys"), lambda p: _in(p.xs, p.ys, _sides(window))))


def range_query(indexed: DataFrame, index, window) -> DataFrame:
    """Answer of one window on a table that ``index`` has keyed."""
    return index.candidates(indexed, window).where(meets(_sides(window)))


def range_queries(indexed: DataFrame, index, windows) -> DataFrame:
    """qid, oid, tid of each (qid, window) of a list: the ranges of all windows in one scan, then
    each window against what they leave. Lists of more than ``BLOCK`` windows are taken in blocks."""
    windows = list(windows)
    parts = []
    for i in range(0, max(1, len(windows)), BLOCK):
        some = windows[i : i + BLOCK]
        asked = indexed.sparkSession.createDataFrame([(q, *map(float, w)) for q, w in some], "qid int, w_xmin double, w_ymin double, w_xmax double, w_ymax double")
        rows = index.select(indexed, [w for _, w in some]).select("oid", "tid", *_SIDES, "xs", "ys")
        parts.append(rows.join(F.broadcast(asked), meets({c: F.col(f"w_{c}") for c in _SIDES})).select("qid", "oid", "tid"))
    return reduce(DataFrame.unionAll, parts)


def candidate_counts(indexed: DataFrame, index, windows) -> DataFrame:
    """qid and candidates: rows that the index leaves before the exact test."""
    parts = [index.candidates(indexed, w).agg(F.count("*").alias("candidates")).select(F.lit(q).alias("qid"), "candidates") for q, w in windows]
    return reduce(DataFrame.unionAll, parts)


def polygon_query(df: DataFrame, ring: list[tuple[float, float]]) -> DataFrame:
    """Trajectories with a point inside a polygon, by counting the edges to the right of it, or on its border."""
    xs, ys = [p[0] for p in ring], [p[1] for p in ring]
    edges = list(zip(ring, ring[1:] + ring[:1], strict=True))

    def inside(p: Column) -> Column:
        x, y = p.xs / F.lit(float(MICRO)), p.ys / F.lit(float(MICRO))
        crossings, border = F.lit(0), F.lit(False)
        for (x1, y1), (x2, y2) in edges:
            side = (x - x1) * (y2 - y1) - (y - y1) * (x2 - x1)
            border = border | ((side == 0) & x.between(min(x1, x2), max(x1, x2)) & y.between(min(y1, y2), max(y1, y2)))
            if y1 != y2:
                straddles = (F.lit(y1) > y) != (F.lit(y2) > y)
                crossings = crossings + F.when(straddles & (x < (x2 - x1) * (y - y1) / (y2 - y1) + x1), 1).otherwise(0)
        return border | (crossings % 2 == 1)

    box = (F.col("xmin") <= max(xs)) & (F.col("xmax") >= min(xs)) & (F.col("ymin") <= max(ys)) & (F.col("ymax") >= min(ys))
    return df.where(box & F.exists(F.arrays_zip("xs", "ys"), inside))


def batch_join(df: DataFrame, windows: DataFrame, extent: Extent = BEIJING, resolution: int = 6) -> DataFrame:
    """qid, oid, tid for a table of windows, in one join on grid cells.

    A trajectory is listed under the cells its points are in, a window under those it
    covers; a pair is decided once, in the first of the trajectory's cells that the window covers,
    which its four outer cells tell, so no duplicates arise. Points outside the extent have the
    border's cells. Points decide, so two rows with equal ids stay two rows.
    """
    grid = Grid(extent, resolution, 2, 2, 2, 2)
    e = 1 / MICRO
    edge = lambda c, d, axis: grid.fine(F.round((F.col(c) + d) * MICRO), axis)
    w = windows.select("qid", *(F.col(c).alias(f"w_{c}") for c in _SIDES), edge("xmin", -e, 0).alias("cx0"), edge("ymin", -e, 1).alias("cy0"), edge("xmax", e, 0).alias("cx1"), edge("ymax", e, 1).alias("cy1"))
    listed = w.agg(F.sum((F.col("cx1") - F.col("cx0") + 1) * (F.col("cy1") - F.col("cy0") + 1)).alias("n")).first().n or 0
    w = w.select("*", F.explode(F.sequence("cx0", "cx1")).alias("cx")).select("*", F.explode(F.sequence("cy0", "cy1")).alias("cy"))
    # a row is listed under its distinct cells with all of them, in order
    cells = F.array_sort(F.array_distinct(grid.cells()))
    t = df.select("oid", "tid", *_SIDES, "xs", "ys", cells.alias("cells")).select("*", F.explode("cells").alias("c"))
    t = t.select("oid", "tid", *_SIDES, "xs", "ys", "cells", F.col("c.x").alias("cx"), F.col("c.y").alias("cy"))
    sides = {c: F.col(f"w_{c}") for c in _SIDES}
    joined = t.join(F.broadcast(w) if listed <= FEW else w, ["cx", "cy"])
    # no cell of the row before this one is in the window too
    here = F.struct(F.col("cx").alias("x"), F.col("cy").alias("y"))
    earlier = F.exists("cells", lambda c: (c < here) & c.x.between(F.col("cx0"), F.col("cx1")) & c.y.between(F.col("cy0"), F.col("cy1")))
    return joined.where(~earlier & meets(sides)).select("qid", "oid", "tid")
