"""Learns the bit layout of the interval curve from a sample of points."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from trailmark.functions.grid import Grid
from trailmark.model import Extent
from trailmark.plans.indexes import CurveIndex

SEED = 7_919
#: Points and windows that a layout is judged by.
POINTS, PIVOTS = 10_000, 300
#: A window's side, as a share of the extent.
SIDE = 0.01


def sample_points(df: DataFrame, grid: Grid, n: int = POINTS, seed: int = SEED) -> np.ndarray:
    """Fine cells of ``n`` points at most, chosen by a hash, hence always the same."""
    rows = df.select("oid", "tid", F.posexplode(grid.cells()).alias("i", "p")).select(F.xxhash64(F.lit(seed), "oid", "tid", "i").alias("h"), "p.x", "p.y")
    return np.array([(r.x, r.y) for r in rows.orderBy("h", "x", "y").limit(n).collect()], np.int64).reshape(-1, 2)


def places(layout: np.ndarray) -> tuple[int, ...]:
    """A layout, the axis of each bit from the lowest on, as theta."""
    return (*np.flatnonzero(layout == 0).tolist(), *np.flatnonzero(layout == 1).tolist())


def keys(cells: np.ndarray, theta: tuple[int, ...], bits: int) -> np.ndarray:
    out = np.zeros(len(cells), np.int64)
    for axis in (0, 1):
        for i, t in enumerate(theta[axis * bits : (axis + 1) * bits]):
            out |= (cells[:, axis] >> i & 1) << t
    return out


def cost(cells: np.ndarray, low: np.ndarray, high: np.ndarray, theta: tuple[int, ...], bits: int) -> float:
    """Mean, over windows, of points scanned between the corners' keys plus those of them outside the window."""
    order = np.argsort(keys(cells, theta, bits), kind="stable")
    k, c = keys(cells, theta, bits)[order], cells[order]
    a, b = np.searchsorted(k, keys(low, theta, bits)), np.searchsorted(k, keys(high, theta, bits), "right")
    total = 0
    for i in range(len(low)):
        part = c[a[i] : b[i]]
        inside = ((part >= low[i]) & (part <= high[i])).all(1).sum()
        total += 2 * len(part) - inside
    return total / max(1, len(low))


def learn(df: DataFrame, extent: Extent, bits: int = 20, layouts: int = 64, seed: int = SEED) -> CurveIndex:
    """The best of ``layouts`` layouts: alternating and blocked ones, then changes of the best and random ones."""
    grid = Grid(extent, bits, 2, 2, 2, 2)
    cells = sample_points(df, grid, seed=seed)
    rng = np.random.default_rng(seed)
    half = max(1, int((1 << bits) * SIDE / 2))
    centres = cells[rng.integers(0, len(cells), PIVOTS)] if len(cells) else np.zeros((0, 2), np.int64)
    low, high = np.maximum(centres - half, 0), np.minimum(centres + half, (1 << bits) - 1)
    axes = np.array([0, 1] * bits)
    waiting = [axes, 1 - axes, np.sort(axes), np.sort(axes)[::-1].copy()]
    seen: set[bytes] = set()
    best, least = axes, float("inf")
    while len(seen) < layouts:
        if waiting:
            layout = waiting.pop(0)
        elif rng.random() < 0.7:
            layout = best.copy()
            i, j = rng.integers(0, 2 * bits, 2)
            layout[[i, j]] = layout[[j, i]]
        else:
            layout = rng.permutation(axes)
        if layout.astype(np.int8).tobytes() in seen:
            continue
        seen.add(layout.astype(np.int8).tobytes())
        c = cost(cells, low, high, places(layout), bits)
        if c < least:
            best, least = layout, c
    return CurveIndex(places(best), extent, bits)


def to_text(index: CurveIndex) -> str:
    return ", ".join(map(str, index.theta))


def from_text(text: str, extent: Extent) -> CurveIndex:
    theta = tuple(int(t) for t in text.replace("\n", ",").split(",") if t.strip())
    return CurveIndex(theta, extent, len(theta) // 2)
