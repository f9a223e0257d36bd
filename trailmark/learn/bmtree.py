"""Learns the piecewise curve's tree from a sample of envelopes and a workload of windows."""

from __future__ import annotations

from collections import deque

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from trailmark.functions.grid import Grid
from trailmark.model import Extent
from trailmark.plans.indexes import BMNode, BMTreeIndex

SAMPLES, WINDOWS, PAGE, LEAST = 4000, 300, 64, 32


def strided(windows: list, most: int = WINDOWS) -> list:
    """``most`` windows at most, evenly spread over the workload."""
    return windows[:: max(1, -(-len(windows) // most))]


def _cost(corners: np.ndarray, low: np.ndarray, high: np.ndarray, tree: BMTreeIndex) -> float:
    """Mean over windows of the pages, of the samples in key order, from a window's first key to its last."""
    if not len(low):
        return 0.0
    k = np.sort(tree.keys(corners[:, 0], corners[:, 1]))
    a, b = np.searchsorted(k, tree.keys(low[:, 0], low[:, 1])), np.searchsorted(k, tree.keys(high[:, 0], high[:, 1]), "right")
    return float(np.where(b > a, (np.maximum(b - 1, a)) // PAGE - a // PAGE + 1, 0).mean())


def learn(df: DataFrame, windows: list, extent: Extent, bits: int = 20, depth: int = 8) -> tuple[BMNode, ...]:
    """Breadth-first: each node with enough samples takes the axis with fewer pages, ties the axis in turn."""
    grid = Grid(extent, bits, 2, 2, 2, 2)
    fine = df.select(F.xxhash64("oid", "tid").alias("h"), grid.fine(F.array_min("xs"), 0).alias("x"), grid.fine(F.array_min("ys"), 1).alias("y"))
    corners = np.array([(r.x, r.y) for r in fine.orderBy("h", "x", "y").limit(SAMPLES).collect()], np.int64).reshape(-1, 2)
    win = np.array([grid.window(w) for w in strided(windows)], np.int64).reshape(-1, 4)
    low, high = win[:, :2], win[:, 2:]
    nodes: list[BMNode] = [BMNode(-1)]
    todo = deque([(0, np.arange(len(corners)), (0, 0), 1, 0)])
    while todo:
        at, rows, used, last, level = todo.popleft()
        axes = [d for d in (1 - last, last) if used[d] < bits]
        if level >= depth or len(rows) <= LEAST or not axes:
            continue

        def with_axis(d: int, at: int = at) -> list[BMNode]:
            n = len(nodes)
            return [*nodes[:at], BMNode(d, n, n + 1), *nodes[at + 1 :], BMNode(-1), BMNode(-1)]

        costs = [_cost(corners, low, high, BMTreeIndex(tuple(with_axis(d)), extent, bits)) for d in axes]
        d = axes[int(np.argmin(costs))]
        nodes = with_axis(d)
        bit = corners[rows, d] >> bits - 1 - used[d] & 1
        now = tuple(u + (i == d) for i, u in enumerate(used))
        for b, child in enumerate((nodes[at].left, nodes[at].right)):
            todo.append((child, rows[bit == b], now, d, level + 1))
    return tuple(nodes)


def to_text(nodes: tuple[BMNode, ...], bits: int) -> str:
    """Header ``dimensions bits bits``, the depth, then ``id parent depth dim left right child`` a line."""
    parent, level, lines = {0: -1}, {0: 0}, []
    for i, n in enumerate(nodes):
        for c in (n.left, n.right, n.child):
            if c >= 0:
                parent[c], level[c] = i, level[i] + 1
        lines.append(f"{i} {parent[i]} {level[i]} {n.dim} {n.left} {n.right} {n.child}")
    return "\n".join([f"2 {bits} {bits}", str(max(level.values())), *lines]) + "\n"


def from_text(text: str, extent: Extent) -> BMTreeIndex:
    head, _, *lines = [line.split() for line in text.splitlines() if line.strip()]
    dims, *bits = map(int, head)
    if dims != 2 or len(set(bits)) != 1 or len(bits) != 2:
        raise ValueError("the tree needs two axes of equal bits")
    rows = {int(a[0]): BMNode(*map(int, a[3:7])) for a in lines}
    if sorted(rows) != list(range(len(rows))):
        raise ValueError("node numbers must run from 0")
    # a child that is not listed is a leaf
    nodes = [rows[i] for i in range(len(rows))]
    renamed: dict[int, int] = {}
    for n in list(nodes):
        for c in (n.left, n.right, n.child):
            if c >= len(rows) and c not in renamed:
                renamed[c] = len(nodes)
                nodes.append(BMNode(-1))
    to = lambda c: renamed.get(c, c)
    return BMTreeIndex(tuple(BMNode(n.dim, to(n.left), to(n.right), to(n.child)) for n in nodes), extent, bits[0])
