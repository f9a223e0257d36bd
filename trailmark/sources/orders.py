"""Order files of the adaptive index, as JSON: its nodes, their numbers and what lies below them."""

from __future__ import annotations

import json
from bisect import bisect_left, bisect_right

from pyspark.sql import SparkSession

from trailmark.functions.grid import subtree
from trailmark.model import MICRO, Extent
from trailmark.plans.indexes import AdaptiveIndex


def _box(index: AdaptiveIndex, n: dict) -> dict[str, float]:
    x0, y0, x1, y1 = (v / MICRO for v in index.extent.micro())
    w, h = (x1 - x0) / (1 << n["level"]), (y1 - y0) / (1 << n["level"])
    return {"xmin": x0 + n["ix"] * w, "ymin": y0 + n["iy"] * h, "xmax": x0 + (n["ix"] + 1) * w, "ymax": y0 + (n["iy"] + 1) * h}


def to_json(index: AdaptiveIndex) -> str:
    e = index.extent
    meta = {
        "global_alpha": index.alpha,
        "global_beta": index.beta,
        "quadtree_max_level": index.resolution,
        "active_cells": len(index.nodes),
        "min_trajs": index.least,
        "max_shape_count": 1 << max((n["alpha"] * n["beta"] for n in index.nodes), default=0),
        "partition_search": [[a, b] for _, a, b in index.sizes],
        "effective_subtree_contiguous": [n["order"] for n in index.nodes] == list(range(len(index.nodes))),
        "spatial_boundary": {"xmin": e.xmin, "ymin": e.ymin, "xmax": e.xmax, "ymax": e.ymax},
    }
    rows = []
    by_quad = sorted((n["quad"], n["order"]) for n in index.nodes)
    quads = [q for q, _ in by_quad]
    for n in sorted(index.nodes, key=lambda n: n["order"]):
        last = n["quad"] + subtree(index.resolution, n["level"]) - 1
        below = sorted(o for _, o in by_quad[bisect_left(quads, n["quad"]) : bisect_right(quads, last)])
        parent = {**_box(index, n), "alpha": n["alpha"], "beta": n["beta"], "level": n["level"], "element_code": n["quad"], "ix": n["ix"], "iy": n["iy"], "count": n["n"], "union_mask": n["union"]}
        rows.append({"order": n["order"], "parent": parent, "coverage": {"effective_subtree_count": len(below), "effective_subtree_orders": below}})
    return json.dumps({"metadata": meta, "ordering": rows})


def from_json(text: str) -> AdaptiveIndex:
    """Files without cell positions and masks are read too: positions follow from the code, masks count as full."""
    d = json.loads(text)
    m = d["metadata"]
    index = AdaptiveIndex(Extent(**m["spatial_boundary"]), m["quadtree_max_level"], m.get("global_alpha", 2), m.get("global_beta", 2), m.get("min_trajs", 0))
    for row in d["ordering"]:
        p = row["parent"]
        ix, iy = (p["ix"], p["iy"]) if "ix" in p else position(index.resolution, p["level"], p["element_code"])
        index.nodes.append({"order": row["order"], "level": p["level"], "ix": ix, "iy": iy, "quad": p["element_code"], "n": p.get("count", 0), "alpha": p["alpha"], "beta": p["beta"], "union": p.get("union_mask", (1 << p["alpha"] * p["beta"]) - 1)})
    return index


def position(resolution: int, level: int, code: int) -> tuple[int, int]:
    """The cell of a node, from its preorder number."""
    ix = iy = 0
    for lev in range(1, level + 1):
        q, code = divmod(code - 1, subtree(resolution, lev))
        ix, iy = 2 * ix + (q & 1), 2 * iy + (q >> 1)
    return ix, iy


def write_order(spark: SparkSession, index: AdaptiveIndex, path: str) -> None:
    spark.createDataFrame([(to_json(index),)], "value string").coalesce(1).write.mode("overwrite").text(path)


def order_path(base: str, dataset: str, least: int, resolution: int, alpha: int, beta: int) -> str:
    """Where an index's order file lies by its parameters."""
    return f"{base}/{dataset}/order_{least}_{resolution}_{alpha}_{beta}.json"


def read_order(spark: SparkSession, path: str) -> AdaptiveIndex:
    return from_json("\n".join(r.value for r in spark.read.text(path, wholetext=True).collect()))  # one file


def reordered(index: AdaptiveIndex, key) -> AdaptiveIndex:
    """The same nodes in order of ``key(node)``, ties by level and code: another curve's order."""
    out = AdaptiveIndex(index.extent, index.resolution, index.alpha, index.beta, index.least, index.sizes)
    ranked = sorted(index.nodes, key=lambda n: (key(n), n["level"], n["quad"]))
    out.nodes = [{**n, "order": i} for i, n in enumerate(ranked)]
    return out


def curve_order(index: AdaptiveIndex, curve) -> AdaptiveIndex:
    """Nodes in order of their cell's place on an interval curve (``CurveIndex`` or ``BMTreeIndex``)."""
    shift = curve.bits - index.resolution

    def key(n: dict) -> int:
        s = index.resolution - n["level"]
        x, y = n["ix"] << s, n["iy"] << s
        x, y = (x << shift, y << shift) if shift >= 0 else (x >> -shift, y >> -shift)
        if hasattr(curve, "keys"):
            import numpy as np

            return int(curve.keys(np.array([x]), np.array([y]))[0])
        return curve.key(x, y)

    return reordered(index, key)
