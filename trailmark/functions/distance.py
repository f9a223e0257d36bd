"""Distances of trajectories (planar, in degrees) and cheap bounds below them.

All bounds are native columns. Distances run in NumPy, in Arrow batches, in memory linear in
the points and with early abandoning: the native forms, nested transforms and aggregates, copy their
row state at every step and are kept for short trajectories and for comparison.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from trailmark.model import MICRO

KINDS = ("frechet", "hausdorff", "dtw")


def _far(p: Column, q: Column) -> Column:
    return F.sqrt((p.x - q.x) * (p.x - q.x) + (p.y - q.y) * (p.y - q.y))


def hausdorff(p: Column, q: Column) -> Column:
    """Of two arrays of (x, y)."""
    one = lambda a, b: F.array_max(F.transform(a, lambda u: F.array_min(F.transform(b, lambda v: _far(u, v)))))
    return F.greatest(one(p, q), one(q, p))


def by_rows(p: Column, q: Column, kind: str) -> Column:
    """Fréchet or DTW as a fold over the rows of the matrix; for short trajectories."""
    worse = (lambda d, m: F.greatest(d, m)) if kind == "frechet" else (lambda d, m: d + m)
    infinite = F.lit(float("inf"))

    def row(state: Column, u: Column) -> Column:
        """The next row: each entry from the one to its left and the two above."""
        first = F.array().cast("array<double>")
        return F.aggregate(
            F.transform(q, lambda v, j: F.struct(_far(u, v).alias("d"), j.alias("j"))),
            first,
            lambda out, c: F.concat(
                out,
                F.array(worse(c.d, F.when((c.j == 0) & (F.size(state) == 0), F.lit(0.0)).otherwise(F.least(F.coalesce(F.get(out, c.j - 1), infinite), F.coalesce(F.get(state, c.j), infinite), F.coalesce(F.get(state, c.j - 1), infinite))))),
            ),
        )

    return F.element_at(F.aggregate(p, F.array().cast("array<double>"), row), -1)


#: Entries of a block of the matrix that Hausdorff looks at in one go.
BLOCK = 1 << 20


def _hausdorff(p: np.ndarray, q: np.ndarray, limit: float) -> float:
    """In blocks of rows; ends early once a point of p is too far from all of q."""
    rows = max(1, BLOCK // len(q))
    nearest, most = np.full(len(q), np.inf), 0.0
    for i in range(0, len(p), rows):
        part = p[i : i + rows]
        d = (part[:, None, 0] - q[None, :, 0]) ** 2 + (part[:, None, 1] - q[None, :, 1]) ** 2
        most = max(most, float(d.min(1).max()))
        if most > limit * limit:
            return float("inf")
        np.minimum(nearest, d.min(0), out=nearest)
    return float(np.sqrt(max(most, float(nearest.max()))))


def pair_distance(p: np.ndarray, q: np.ndarray, kind: str, limit: float = float("inf")) -> float:
    """Fréchet, Hausdorff or DTW of two point arrays (n by 2); infinity as soon as it is sure to exceed ``limit``.

    Fréchet and DTW go along the diagonals of the pairs' matrix, of which three are kept: memory is linear.
    """
    limit += 1e-9 * max(1.0, limit) if limit < float("inf") else 0.0  # rounding must not drop what is at the limit
    if kind == "hausdorff":
        return _hausdorff(p, q, limit)
    if len(p) > len(q):
        p, q = q, p
    n, m = len(p), len(q)
    px, py, qx, qy = (np.ascontiguousarray(c) for c in (p[:, 0], p[:, 1], q[::-1, 0], q[::-1, 1]))
    # a diagonal i + j = s, by i, between two cells of infinity; it needs the two diagonals before
    before, last, new = (np.full(n + 1, np.inf) for _ in range(3))
    for s in range(n + m - 1):
        lo, hi = max(0, s - m + 1), min(n, s + 1)
        at = slice(m - 1 - s + lo, m - 1 - s + hi)  # of q turned round, j = s - i
        cell = np.sqrt((px[lo:hi] - qx[at]) ** 2 + (py[lo:hi] - qy[at]) ** 2)
        new.fill(np.inf)
        if s:
            least = np.minimum(np.minimum(last[lo:hi], last[lo + 1 : hi + 1]), before[lo:hi])
            new[lo + 1 : hi + 1] = np.maximum(cell, least) if kind == "frechet" else cell + least
            # every path crosses this diagonal or steps over it from the one before
            if min(new[lo + 1 : hi + 1].min(), last.min()) > limit:
                return float("inf")
        else:
            new[1] = cell[0]
        before, last, new = last, new, before
    return float(last[n])


def exact(kind: str) -> Callable[..., Column]:
    """The distance of columns (xs, ys, qxs, qys) of micro-degrees; a fifth column is a limit beyond which infinity will do."""
    if kind not in KINDS:
        raise ValueError(f"unknown distance {kind}")

    @F.pandas_udf("double")
    def distance(xs: pd.Series, ys: pd.Series, qxs: pd.Series, qys: pd.Series, limit: pd.Series) -> pd.Series:
        points = lambda a, b: np.stack([a, b], axis=1) / float(MICRO)
        return pd.Series([pair_distance(points(a, b), points(c, d), kind, e) for a, b, c, d, e in zip(xs, ys, qxs, qys, limit, strict=True)], dtype="float64")

    return lambda xs, ys, qxs, qys, limit=None: distance(xs, ys, qxs, qys, F.lit(float("inf")) if limit is None else limit)


def point_to_box(x: Column, y: Column, box: dict[str, Column]) -> Column:
    """Distance of a point to a rectangle; 0 inside."""
    zero = F.lit(0.0)
    dx, dy = F.greatest(box["xmin"] - x, x - box["xmax"], zero), F.greatest(box["ymin"] - y, y - box["ymax"], zero)
    return F.sqrt(dx * dx + dy * dy)


def lower_bound(points: Column, box: dict[str, Column]) -> Column:
    """Largest distance of a trajectory's point to the other's envelope: below all three distances."""
    return F.array_max(F.transform(points, lambda p: point_to_box(p.x, p.y, box)))


def boxes_within(a: dict[str, Column], b: dict[str, Column], eps: Column) -> Column:
    """Necessary for any of the distances to be eps or less: each envelope lies in the other, widened by eps."""

    def inside(u, v):
        return (u["xmin"] >= v["xmin"] - eps) & (u["xmax"] <= v["xmax"] + eps) & (u["ymin"] >= v["ymin"] - eps) & (u["ymax"] <= v["ymax"] + eps)

    return inside(a, b) & inside(b, a)
