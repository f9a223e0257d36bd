"""Key ranges: what a planner finds for a window, merged, and as predicates on rows."""

from __future__ import annotations

from bisect import bisect_right
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

#: A predicate names so many intervals at most; the closest ones are joined beyond it.
MOST = 64


@dataclass
class Plan:
    """Key intervals (both ends included) whose rows may answer, for some nodes masks one of which a row's shape
    must meet, and ``sure``, intervals of nodes that need none."""

    ranges: list[tuple[int, int]] = field(default_factory=list)
    masks: dict[int, list[int]] = field(default_factory=dict)
    contained: int = 0
    met: int = 0
    sure: list[tuple[int, int]] = field(default_factory=list)


def merged(ranges: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Overlapping and adjacent ranges made one."""
    out: list[tuple[int, int]] = []
    for lo, hi in sorted(ranges):
        if out and lo <= out[-1][1] + 1:
            out[-1] = (out[-1][0], max(out[-1][1], hi))
        else:
            out.append((lo, hi))
    return out


def capped(ranges: list[tuple[int, int]], most: int = MOST) -> list[tuple[int, int]]:
    """``most`` ranges at most: those with the smallest gaps are joined, so nothing is lost."""
    ranges = merged(ranges)
    if len(ranges) <= most:
        return ranges
    gaps = sorted(range(1, len(ranges)), key=lambda i: ranges[i][0] - ranges[i - 1][1], reverse=True)[: most - 1]
    cuts = [0, *sorted(gaps), len(ranges)]
    return [(ranges[a][0], ranges[b - 1][1]) for a, b in zip(cuts, cuts[1:], strict=False)]


def within(key: str, ranges: list[tuple[int, int]]) -> Column:
    """Whether a key is in one of the ranges: plain comparisons, which Parquet statistics can use."""
    return F.expr(" OR ".join(f"{key} BETWEEN {lo}L AND {hi}L" for lo, hi in capped(ranges)) or "false")


def united(plans: list[Plan]) -> Plan:
    """One plan for several windows: what any of them needs. A node that one window holds whole needs no mask."""
    if len(plans) == 1:
        return plans[0]
    out = Plan(merged([r for p in plans for r in p.ranges]), {}, sum(p.contained for p in plans), sum(p.met for p in plans), merged([r for p in plans for r in p.sure]))
    starts = [lo for lo, _ in out.sure]
    for p in plans:
        for node, masks in p.masks.items():
            i = bisect_right(starts, node) - 1
            if i < 0 or out.sure[i][1] < node:
                out.masks.setdefault(node, []).extend(m for m in masks if m not in out.masks[node])
    return out


def masked(rows: DataFrame, plan: Plan, node: str, whole: bool = False, shape: str = "shape") -> DataFrame:
    """Of the rows in a node with masks those whose shape meets one of them, or, for ``whole``, lies in one."""
    if not plan.masks:
        return rows
    masks = rows.sparkSession.createDataFrame(list(plan.masks.items()), "_node bigint, _masks array<bigint>")  # nodes on windows' borders, as many as the planner emits
    rows = rows.join(F.broadcast(masks), F.col(node) == F.col("_node"), "left")
    fits = (lambda m: F.col(shape).bitwiseAND(F.bitwise_not(m)) == 0) if whole else (lambda m: F.col(shape).bitwiseAND(m) != 0)
    return rows.where(F.col("_masks").isNull() | F.exists("_masks", fits)).drop("_node", "_masks")


def merge_ranges(df: DataFrame) -> DataFrame:
    """Merges (qid, lo, hi, contained) within each qid; contained only if all parts are."""
    before = W.partitionBy("qid").orderBy("lo", "hi").rowsBetween(W.unboundedPreceding, -1)
    upto = W.partitionBy("qid").orderBy("lo", "hi").rowsBetween(W.unboundedPreceding, 0)
    rows = df.withColumn("start", F.when(F.col("lo") <= F.max("hi").over(before) + 1, 0).otherwise(1))
    rows = rows.withColumn("island", F.sum("start").over(upto))
    return rows.groupBy("qid", "island").agg(F.min("lo").alias("lo"), F.max("hi").alias("hi"), F.min("contained").alias("contained")).drop("island")
