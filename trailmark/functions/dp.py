"""Pivots and covering boxes of a trajectory (Douglas-Peucker).

A stretch splits at the point farthest from its chord while that is more than
``PRECISION`` degrees away. Each final stretch gives the least rectangle along
its chord that holds all its points; pivots are the stretches' ends.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from trailmark.model import MICRO

PRECISION = 0.01


def _frame(p: np.ndarray, s: int, e: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Along and across coordinates of points s to e, in the chord's direction."""
    chord = p[e] - p[s]
    size = np.hypot(*chord)
    u = chord / size if size > 0 else np.array([1.0, 0.0])
    d = p[s : e + 1] - p[s]
    return u, d @ u, d @ np.array([-u[1], u[0]])


def features(p: np.ndarray, precision: float = PRECISION) -> tuple[list[int], list[np.ndarray]]:
    """Pivot positions and boxes (four corners each) of points (n by 2)."""
    if len(p) == 1:
        return [0], [np.repeat(p, 4, axis=0)]
    pivots, boxes, todo = [0], [], [(0, len(p) - 1)]
    while todo:
        s, e = todo.pop()
        u, along, across = _frame(p, s, e)
        # the end points lie on the chord; of a closed stretch the distance from its start counts
        off = np.abs(across) if u is not None and not np.array_equal(p[s], p[e]) else np.hypot(along, across)
        i = int(off[1:-1].argmax()) + 1 if e - s > 1 else 0
        if i and off[i] > precision:
            todo += [(s + i, e), (s, s + i)]
            continue
        v = np.array([-u[1], u[0]])
        boxes.append(np.array([p[s] + a * u + b * v for a, b in ((along.min(), across.min()), (along.max(), across.min()), (along.max(), across.max()), (along.min(), across.max()))]))
        pivots.append(e)
    return pivots, boxes


def with_features(df: DataFrame) -> DataFrame:
    """Adds pivots ARRAY<INT> and pivot_mbrs ARRAY<ARRAY<STRUCT<x, y>>> to a trajectory table."""

    @F.pandas_udf("pivots array<int>, pivot_mbrs array<array<struct<x:double,y:double>>>")
    def run(xs: pd.Series, ys: pd.Series) -> pd.DataFrame:
        rows = [features(np.stack([a, b], axis=1) / MICRO) for a, b in zip(xs, ys, strict=True)]
        return pd.DataFrame({"pivots": [p for p, _ in rows], "pivot_mbrs": [[[{"x": x, "y": y} for x, y in box.tolist()] for box in boxes] for _, boxes in rows]})

    return df.withColumn("_dp", run("xs", "ys")).select("*", "_dp.pivots", "_dp.pivot_mbrs").drop("_dp")


def boxes_meet(window) -> Column:
    """Whether a window meets the envelope of one of the boxes: cheap, and never wrong to say yes."""
    x0, y0, x1, y1 = map(float, window)
    return F.exists("pivot_mbrs", lambda b: (F.array_min(F.transform(b, lambda c: c.x)) <= x1) & (F.array_max(F.transform(b, lambda c: c.x)) >= x0) & (F.array_min(F.transform(b, lambda c: c.y)) <= y1) & (F.array_max(F.transform(b, lambda c: c.y)) >= y0))
