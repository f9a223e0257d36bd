"""Workload experiments: grids of data sets, windows and methods, and their CSV reports.

Times are measured as they are and never adjusted. A case's first query warms up and
counts only if it is the only one.
"""

from __future__ import annotations

import csv
import json
import time
from collections.abc import Callable, Iterable
from dataclasses import dataclass
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from trailmark.learn.bmtree import learn as learn_tree
from trailmark.learn.theta import learn as learn_theta
from trailmark.model import BEIJING, Extent
from trailmark.operators import range_query, reports, similarity
from trailmark.plans.indexes import AdaptiveIndex, BMTreeIndex, CurveIndex, ShapeIndex, XZIndex, XZPlusIndex, XZStarIndex
from trailmark.sources import orders
from trailmark.sources.tables import write_table

#: Defaults of all suites.
RESOLUTION, MIN_TRAJ, ALPHA, BETA, METRES = 8, 4, 3, 3, 1000
RESOLUTIONS, MIN_TRAJS = (6, 7, 8, 9, 10), (2, 4, 6, 8, 10)
#: Column names of the reports.
COLUMNS = {
    "comparison": "dataset,distribution,query_range,method,avg_latency_ms,avg_rki,avg_ct,avg_final,query_count",
    "ablation": "variant,order_source,adaptive_partition,resolution,min_traj,avg_latency_ms,avg_rki,avg_ct,avg_final,query_count",
    "parameter": "dataset,study,resolution,min_traj,rc,avg_latency_ms,avg_rki,avg_ct,query_count",
    "build": "dataset,table_name,study,resolution,min_traj,trajectory_count,node_count,shape_count,build_time_ms,main_table_bytes,index_table_bytes,extra_index_info_bytes,total_bytes,note",
    "similarity": "dataset,query_type,parameter_name,parameter_value,distance_function,method,avg_latency_ms,avg_row_key_ranges,avg_candidates,avg_final_size,avg_iterations,query_count",
    "statistics": "type,min,max,avg,median,per70,per80,per90",
}


@dataclass
class Measure:
    latency_ms: float
    ranges: int
    candidates: int
    finals: int


def method(name: str, extent: Extent = BEIJING, resolution: int = RESOLUTION, min_traj: int = MIN_TRAJ, **learned):
    """An index by its name; learned curves take ``theta`` or ``nodes``."""
    made: dict[str, Callable] = {
        "adaptive": lambda: AdaptiveIndex(extent, resolution, ALPHA, BETA, min_traj),
        "shape": lambda: ShapeIndex(extent, resolution, ALPHA, BETA),
        "xz": lambda: XZIndex(extent, resolution),
        "xzplus": lambda: XZPlusIndex(extent, resolution, ALPHA, BETA),
        "xzstar": lambda: XZStarIndex(extent, resolution),
        "lmsfc": lambda: CurveIndex(learned.get("theta", ()), extent),
        "bmtree": lambda: BMTreeIndex(learned["nodes"], extent) if "nodes" in learned else BMTreeIndex(extent=extent),
    }
    return made[name]()


def measured(table: DataFrame, index, window) -> Measure:
    """One query: latency of the answer, key ranges, candidates, size of the answer."""
    began = time.perf_counter()
    finals = range_query.range_query(table, index, window).count()
    took = 1000 * (time.perf_counter() - began)
    found = len(index.plan(window).ranges) if hasattr(index, "plan") else 1
    return Measure(took, found, index.candidates(table, window).count(), finals)


def means(rows: list[Measure]) -> tuple[float, float, float, float, int]:
    """Mean latency, ranges, candidates, finals, and the number of queries."""
    rows = rows[1:] if len(rows) > 1 else rows
    n = max(1, len(rows))
    return (*(sum(getattr(r, c) for r in rows) / n for c in ("latency_ms", "ranges", "candidates", "finals")), len(rows))


def write_csv(path: str, kind: str, rows: Iterable[Iterable]) -> None:
    Path(path).parent.mkdir(parents=True, exist_ok=True)
    with open(path, "w", newline="") as f:
        out = csv.writer(f)
        out.writerow(COLUMNS[kind].split(","))
        out.writerows(rows)


def statistics(values: list[int]) -> tuple[int, ...]:
    """min, max, whole average, middle, and the values of rank floor(n * p) - 1; zeros without values."""
    v, n = sorted(values), len(values)
    return (v[0], v[-1], sum(v) // n, v[n // 2], *(v[max(0, int(n * p) - 1)] for p in (0.7, 0.8, 0.9))) if n else (0,) * 7


def write_statistics(path: str, rows: list[Measure]) -> None:
    # fixed values: the report's row labels
    kinds = (("time", "latency_ms"), ("rowKeyRanges", "ranges"), ("candidates", "candidates"), ("finalSize", "finals"))
    write_csv(path, "statistics", [(name, *statistics([int(getattr(r, c)) for r in rows])) for name, c in kinds])


def comparison(spark: SparkSession, data: DataFrame, workloads: dict[tuple[str, int], list], methods: list[str], dataset: str = "data", **how) -> list[tuple]:
    """Every method over every (distribution, metres) workload; a table is stored once for a method."""
    out = []
    for name in methods:
        index = method(name, **how)
        table = write_table(data, index)
        for (distribution, metres), windows in workloads.items():
            out.append((dataset, distribution, metres, name, *means([measured(table, index, w) for w in windows])))
    return out


def parameter_study(spark: SparkSession, data: DataFrame, windows: list, dataset: str = "data", resolutions=RESOLUTIONS, min_trajs=MIN_TRAJS) -> tuple[list[tuple], list[tuple]]:
    """Resolution and least trajectories of the adaptive index: query rows and build rows."""
    queries, builds = [], []
    cases = [("resolution", r, MIN_TRAJ) for r in resolutions] + [("min_traj", RESOLUTION, m) for m in min_trajs]
    for study, resolution, least in cases:
        index = method("adaptive", resolution=resolution, min_traj=least)
        began = time.perf_counter()
        table = write_table(data, index)
        took = int(1000 * (time.perf_counter() - began))
        size = reports.table_size(table).first()
        shapes = table.select("q_order", "shape").distinct().count()
        extra = len(orders.to_json(index))
        builds.append((dataset, f"{study}_{resolution}_{least}", study, resolution, least, size.n_trajectories, len(index.nodes), shapes, took, size.n_bytes, 16 * shapes, extra, size.n_bytes + 16 * shapes + extra, ""))
        latency, ranges, candidates, _, n = means([measured(table, index, w) for w in windows])
        queries.append((dataset, study, resolution, least, METRES, latency, ranges, candidates, n))
    return queries, builds


def ablation(spark: SparkSession, data: DataFrame, windows: list, extent: Extent = BEIJING) -> list[tuple]:
    """The adaptive index as it is, in the order of either learned curve, and with one mask size for all nodes."""
    base = method("adaptive", extent).build(data)
    fixed = AdaptiveIndex(extent, RESOLUTION, ALPHA, BETA, MIN_TRAJ, ((0, ALPHA, BETA),)).build(data)
    theta = learn_theta(data, extent, bits=RESOLUTION)
    tree = BMTreeIndex(learn_tree(data, windows, extent, bits=RESOLUTION), extent, RESOLUTION)
    variants = (("base", "preorder", True, base), ("theta order", "lmsfc", True, orders.curve_order(base, theta)), ("tree order", "bmtree", True, orders.curve_order(base, tree)), ("one mask size", "preorder", False, fixed))
    out = []
    for name, source, adaptive, index in variants:
        table = write_table(data, index)
        out.append((name, source, adaptive, RESOLUTION, MIN_TRAJ, *means([measured(table, index, w) for w in windows])))
    return out


def similarity_suite(data: DataFrame, keys: DataFrame, kinds: list[str], ks: list[int], thresholds: list[float], dataset: str = "data", methods: Iterable[str] = ("shape",)) -> list[tuple]:
    """Both query types over their parameters and methods; all queries of a case are one batch.

    Ranges and candidates are those of the last pass, per query: of a threshold, or of the radius that holds the k nearest.
    """
    queries = similarity.as_queries(data, keys).cache()
    boxes = similarity._envelopes(queries)
    n, out = len(boxes), []
    for name in methods:
        index = method(name)
        table = write_table(data, index)
        for kind in kinds:
            cases = [("top_k", "k", k, lambda k=k, kind=kind: similarity.nearest_indexed(table, index, queries, k, kind), 2) for k in ks]
            cases += [("similarity", "threshold", e, lambda e=e, kind=kind: similarity.within_indexed(table, index, queries, e, kind), 1) for e in thresholds]
            for query_type, parameter, value, run, passes in cases:
                began = time.perf_counter()
                found = run().collect()  # k or fewer a query, or a threshold's answers
                took = 1000 * (time.perf_counter() - began)
                reach = value if query_type == "similarity" else max((r.dist for r in found), default=0.0)
                ranges = sum(len(index.plan(similarity.grown(b, reach), True).ranges) if hasattr(index, "plan") else 1 for b in boxes.values())
                candidates = sum(r.candidates for r in similarity.candidate_counts(table, index, queries, reach).collect())
                out.append((dataset, query_type, parameter, value, kind.upper(), name, took / max(1, n), ranges / max(1, n), candidates / max(1, n), len(found) / max(1, n), passes, n))
    return out


def validate(data: DataFrame, index, windows: list) -> DataFrame:
    """qid, verdict, n of each window's answer against brute force."""
    table = write_table(data, index)
    numbered = list(enumerate(windows))
    found = range_query.range_queries(table, index, numbered)
    parts = [range_query.brute_force(data, w).select(F.lit(q).alias("qid"), "oid", "tid") for q, w in numbered]
    truth = parts[0]
    for p in parts[1:]:
        truth = truth.unionAll(p)
    return reports.compared(truth, found, ["qid", "oid", "tid"]).groupBy("qid", "verdict").agg(F.count("*").alias("n"))


def dump_validation(data: DataFrame, index, windows: list, path: str) -> DataFrame:
    """Writes each window's answers with their verdicts (correct, missing, extra), a folder a verdict, and returns them as read back."""
    table = write_table(data, index)
    numbered = list(enumerate(windows))
    found = range_query.range_queries(table, index, numbered)
    truth = range_query.batch_join(data, data.sparkSession.createDataFrame([(q, *map(float, w)) for q, w in numbered], "qid int, xmin double, ymin double, xmax double, ymax double"), index.extent)
    rows = reports.compared(truth, found, ["qid", "oid", "tid"])
    rows.write.mode("overwrite").partitionBy("verdict").option("header", True).csv(path)
    return data.sparkSession.read.schema("qid int, oid bigint, tid string, verdict string").option("header", True).csv(path)


def config(text: str) -> dict:
    """An experiment's JSON: datasets, distributions, queryRanges, methods, queryTypes, topKValues, similarityThresholds, distanceFunctions, outputDir."""
    d = json.loads(text)
    missing = [k for k in ("datasets", "methods", "outputDir") if k not in d]
    if missing:
        raise ValueError(f"missing: {', '.join(missing)}")
    return {"queryTypes": ["top_k", "similarity"], "topKValues": [50], "similarityThresholds": [0.01], "distanceFunctions": ["FRECHET"], "queryLimit": 100} | d


def run_suite(spark: SparkSession, text: str, read) -> dict[str, list[tuple]]:
    """Runs what an experiment's JSON asks for and writes its CSVs; ``read(path)`` gives a trajectory table.

    A data set has name, path and windows, a list of windows or (distribution, metres, windows); similarity
    runs if there are queryTypes and the data set has queries, a list of (oid, tid).
    """
    c, out = config(text), {"comparison": [], "similarity": []}
    for d in c["datasets"]:
        data = read(d["path"]).cache()
        if d.get("windows"):
            loads = {(w["distribution"], w["metres"]): w["windows"] for w in d["windows"]} if isinstance(d["windows"][0], dict) else {("given", METRES): d["windows"]}
            out["comparison"] += comparison(spark, data, loads, [m.lower() for m in c["methods"]], d["name"])
        if d.get("queries"):
            keys = spark.createDataFrame([(i, int(o), str(t)) for i, (o, t) in enumerate(d["queries"][: c["queryLimit"]])], "qid int, oid bigint, tid string")
            ks = c["topKValues"] if "top_k" in c["queryTypes"] else []
            thresholds = c["similarityThresholds"] if "similarity" in c["queryTypes"] else []
            out["similarity"] += similarity_suite(data, keys, [f.lower() for f in c["distanceFunctions"]], ks, thresholds, d["name"], [m.lower() for m in c["methods"]])
        data.unpersist()
    for kind, rows in out.items():
        if rows:
            write_csv(f"{c['outputDir']}/{kind}.csv", kind, rows)
    return out
