"""Similar trajectories: within a distance, or the k nearest.

Query trajectories are a stated set (columns qid, q_oid, q_tid, qxs, qys and their
envelope) that meets all rows; larger sets are taken in blocks of ``BLOCK``.
Cheap native bounds come first, the exact distance, in Arrow batches, last. A trajectory
is not similar to itself (equal oid and tid); answers rank by rounded distance, oid, tid.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from trailmark.functions.distance import boxes_within, exact, lower_bound
from trailmark.model import points_of

#: Query trajectories in one broadcast.
BLOCK = 1000
#: Distances are published and ranked to so many digits.
DIGITS = 9
_SIDES = ("xmin", "ymin", "xmax", "ymax")


def as_queries(df: DataFrame, keys: DataFrame) -> DataFrame:
    """Query trajectories for keys (qid, oid, tid)."""
    rows = df.join(F.broadcast(keys), ["oid", "tid"])
    return rows.select("qid", F.col("oid").alias("q_oid"), F.col("tid").alias("q_tid"), F.col("xs").alias("qxs"), F.col("ys").alias("qys"), *(F.col(c).alias(f"q_{c}") for c in _SIDES))


def _box(prefix: str = "") -> dict[str, Column]:
    return {c: F.col(f"{prefix}{c}") for c in _SIDES}


def _blocks(queries: DataFrame) -> list[DataFrame]:
    n = queries.count()
    return [queries] if n <= BLOCK else [queries.where(F.pmod(F.xxhash64("qid"), F.lit(-(-n // BLOCK))) == i) for i in range(-(-n // BLOCK))]


def _paired(df: DataFrame, queries: DataFrame, condition: Column) -> DataFrame:
    other = ~(F.col("oid").eqNullSafe(F.col("q_oid")) & F.col("tid").eqNullSafe(F.col("q_tid")))
    rows = df.select("oid", "tid", "xs", "ys", *_SIDES)
    return rows.join(F.broadcast(queries), other & condition)


def _scored(rows: DataFrame, kind: str, limit: Column | None = None) -> DataFrame:
    return rows.withColumn("dist", exact(kind)("xs", "ys", "qxs", "qys", limit))


def _end_to_end(eps: Column) -> Column:
    """Fréchet couples the first points and the last points."""
    at = lambda c, i: F.get(c, F.lit(0) if i else F.size(c) - 1) / F.lit(1e6)
    far = lambda i: F.sqrt(F.pow(at("xs", i) - at("qxs", i), 2) + F.pow(at("ys", i) - at("qys", i), 2))
    slack = F.lit(1e-9)  # bounds must not be stricter than the distance by rounding
    return (far(1) <= eps + slack) & (far(0) <= eps + slack)


def within(df: DataFrame, queries: DataFrame, eps: float, kind: str) -> DataFrame:
    """qid, oid, tid, dist of all trajectories at distance eps or less."""
    e = F.lit(float(eps))
    near = boxes_within(_box(), _box("q_"), e + 1e-9)
    if kind == "frechet":
        near = near & _end_to_end(e)
    parts = []
    for q in _blocks(queries):
        rows = _paired(df, q, near)
        rows = rows.where(lower_bound(points_of("qxs", "qys"), _box()) <= e + 1e-9)
        rows = rows.where(lower_bound(points_of(), _box("q_")) <= e + 1e-9)
        parts.append(_scored(rows, kind, e).where(F.col("dist") <= e))
    found = reduce(DataFrame.unionAll, parts)
    # one answer for an (oid, tid), the nearest
    return found.groupBy("qid", "oid", "tid").agg(F.round(F.min("dist"), DIGITS).alias("dist"))


def _unlimited(rows: DataFrame, k: int, kind: str) -> DataFrame:
    """qid and tau, the largest distance of the k rows with the least lower bounds; none if they are not k ids."""
    order = W.partitionBy("qid").orderBy("lb", "oid", "tid")
    # the limit on a rank takes k rows a query in each task before anything is shuffled
    some = rows.withColumn("r", F.row_number().over(order)).where(F.col("r") <= k)
    first = _scored(some, kind).groupBy("qid", "oid", "tid").agg(F.min("dist").alias("dist"))
    return first.groupBy("qid").agg(F.max("dist").alias("tau"), F.count("*").alias("n")).where(F.col("n") >= k).select("qid", "tau")


def _bounded(df: DataFrame, q: DataFrame) -> DataFrame:
    lb = F.greatest(lower_bound(points_of("qxs", "qys"), _box()), lower_bound(points_of(), _box("q_")))
    return _paired(df, q, F.lit(True)).withColumn("lb", lb)


def _ranked(parts: list[DataFrame], k: int) -> DataFrame:
    found = reduce(DataFrame.unionAll, parts).groupBy("qid", "oid", "tid").agg(F.round(F.min("dist"), DIGITS).alias("dist"))
    rank = F.row_number().over(W.partitionBy("qid").orderBy("dist", "oid", "tid"))
    return found.withColumn("rnk", rank).where(F.col("rnk") <= k).select("qid", "rnk", "oid", "tid", "dist")


def _upto(rows: DataFrame, tau: DataFrame, kind: str) -> DataFrame:
    rows = rows.join(F.broadcast(tau), "qid", "left").withColumn("tau", F.coalesce("tau", F.lit(float("inf")))).where(F.col("lb") <= F.col("tau") + 1e-9)
    return _scored(rows, kind, F.col("tau")).where(F.col("dist") < float("inf"))


def nearest(df: DataFrame, queries: DataFrame, k: int, kind: str) -> DataFrame:
    """qid, rnk, oid, tid, dist of the k nearest trajectories; exact, in two passes.

    The k rows with the least lower bounds are scored; the largest of their distances bounds
    the answer, so that only rows with a lower bound up to it can be in it. Should an id have several
    of those rows, so that the ids are less than k, nothing is ruled out.
    """
    if k <= 0:
        return df.sparkSession.createDataFrame([], "qid int, rnk int, oid bigint, tid string, dist double")
    parts = []
    for q in _blocks(queries):
        rows = _bounded(df, q)
        parts.append(_upto(rows, _unlimited(rows, k, kind), kind))
    return _ranked(parts, k)


def _envelopes(queries: DataFrame) -> dict:
    """Envelopes by qid, of a block of queries."""
    return {r.qid: (r.q_xmin, r.q_ymin, r.q_xmax, r.q_ymax) for r in queries.select("qid", *(f"q_{c}" for c in _SIDES)).collect()}


def grown(box, by: float) -> tuple[float, float, float, float]:
    by += 1e-9
    return box[0] - by, box[1] - by, box[2] + by, box[3] + by


def within_indexed(table: DataFrame, index, queries: DataFrame, eps: float, kind: str) -> DataFrame:
    """As ``within``, on a table that ``index`` has keyed: all points of an answer lie in the query's envelope grown by eps."""
    parts = []
    for q in _blocks(queries):
        near = index.select(table, [grown(b, eps) for b in _envelopes(q).values()], whole=True)
        parts.append(within(near, q, eps, kind))
    return reduce(DataFrame.unionAll, parts)  # blocks share no query


def nearest_indexed(table: DataFrame, index, queries: DataFrame, k: int, kind: str) -> DataFrame:
    """As ``nearest``, on a table that ``index`` has keyed, in two range scans.

    The rows with a point in a query's envelope give its radius; then the envelope grown by it holds
    every answer. A query whose envelope meets less than k others has all rows as candidates.
    """
    if k <= 0:
        return nearest(table, queries, k, kind)
    parts = []
    for q in _blocks(queries):
        boxes = _envelopes(q)
        seeds = _bounded(index.select(table, list(boxes.values())), q)
        tau = {r.qid: r.tau for r in _unlimited(seeds, k, kind).collect()}  # a row for each of the block's queries
        known = table.sparkSession.createDataFrame(list(tau.items()), q.select("qid", F.lit(0.0).alias("tau")).schema)
        near = index.select(table, [grown(boxes[i], t) for i, t in tau.items()], whole=True)
        if tau:
            parts.append(_upto(_bounded(near, q.join(F.broadcast(known.select("qid")), "qid", "left_semi")), known, kind).select("qid", "oid", "tid", "dist"))
        if len(tau) < len(boxes):
            parts.append(nearest(table, q.join(F.broadcast(known.select("qid")), "qid", "left_anti"), k, kind).select("qid", "oid", "tid", "dist"))
    return _ranked(parts, k) if parts else nearest(table, queries, k, kind)


def candidate_counts(table: DataFrame, index, queries: DataFrame, eps: float) -> DataFrame:
    """qid and candidates: rows that the index leaves for a query before any distance, the query itself not counted."""
    parts = []
    for q in _blocks(queries):
        keys = {r.qid: (r.q_oid, r.q_tid) for r in q.select("qid", "q_oid", "q_tid").collect()}
        for i, box in _envelopes(q).items():
            oid, tid = keys[i]
            rows = index.select(table, [grown(box, eps)], whole=True).where(~(F.col("oid").eqNullSafe(F.lit(oid)) & F.col("tid").eqNullSafe(F.lit(tid))))
            parts.append(rows.agg(F.count("*").alias("candidates")).select(F.lit(i).alias("qid"), "candidates"))
    return reduce(DataFrame.unionAll, parts)


def all_pairs(df: DataFrame, queries: DataFrame, kind: str) -> DataFrame:
    """qid, oid, tid, dist of every query and every other trajectory: the definition that pruning is held against."""
    parts = [_scored(_paired(df, q, F.lit(True)), kind) for q in _blocks(queries)]
    return reduce(DataFrame.unionAll, parts).select("qid", "oid", "tid", F.round("dist", DIGITS).alias("dist"))
