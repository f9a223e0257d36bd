"""Statistics of workloads, comparison of answers, counts of shapes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def _ranked(df: DataFrame, group: list[str], value: Column) -> DataFrame:
    """``group``, v, its count c, the rank behind its last row, and per group n and s (sum): equal values are
    counted before the shuffle, so that a group is as long as its distinct values."""
    counts = df.groupBy(*group, value.alias("v")).agg(F.count("*").alias("c"))
    every = W.partitionBy(*group)
    upto = every.orderBy("v").rowsBetween(W.unboundedPreceding, 0)
    return counts.withColumns({"upto": F.sum("c").over(upto), "n": F.sum("c").over(every), "s": F.sum(F.col("c") * F.col("v")).over(every)})


def _at(rank: Column) -> Column:
    """The value of a rank, from 0."""
    return F.min(F.when(F.col("upto") > rank, F.col("v")))


def workload_stats(df: DataFrame, group: str, value: str) -> DataFrame:
    """Per group: minimum, maximum, whole average, middle, and values at 70, 80, 90 percent by rank floor(n * p) - 1."""
    n = F.col("n")
    at = lambda p: _at(F.greatest(F.floor(n * F.lit(p)) - 1, F.lit(0)))
    rows = _ranked(df, [group], F.col(value).cast("bigint"))
    return rows.groupBy(group).agg(F.min("v").alias("min_v"), F.max("v").alias("max_v"), F.expr("max(s) div max(n)").alias("avg_v"), _at(F.floor(n / 2)).alias("mid_v"), at(0.7).alias("p70"), at(0.8).alias("p80"), at(0.9).alias("p90"))


def profile_stats(df: DataFrame) -> DataFrame:
    """(method, metric, value) to n, min, max, avg, p50, p90 by nearest rank; metrics that are all zero are left out."""
    n = F.col("n")
    at = lambda p: _at(F.ceil(n * F.lit(p)) - 1)
    rows = _ranked(df, ["method", "metric"], F.col("value"))
    out = rows.groupBy("method", "metric").agg(F.max("n").cast("int").alias("n"), F.min("v").alias("min_v"), F.max("v").alias("max_v"), (F.max("s") / F.max("n")).alias("avg_v"), at(0.5).alias("p50"), at(0.9).alias("p90"), F.max(F.abs("v")).alias("top"))
    return out.where("top > 0").drop("top")


def case_means(df: DataFrame) -> DataFrame:
    """(case, seq, latency_ms, ranges, candidates, finals) to means; a case's first query warms up and counts only if alone."""
    n = F.count("*").over(W.partitionBy("case"))
    rows = df.withColumn("n", n).where((F.col("seq") > 0) | (F.col("n") == 1))
    return rows.groupBy("case").agg(*(F.avg(c).alias(f"avg_{c}") for c in ("latency_ms", "ranges", "candidates", "finals")), F.count("*").alias("query_count"))


def compared(truth: DataFrame, found: DataFrame, keys: list[str]) -> DataFrame:
    """Each key with its verdict: correct, missing or extra."""
    t, f = truth.select(*keys).distinct().withColumn("_t", F.lit(1)), found.select(*keys).distinct().withColumn("_f", F.lit(1))
    verdict: Column = F.when(F.col("_f").isNull(), "missing").when(F.col("_t").isNull(), "extra").otherwise("correct")
    return t.join(f, keys, "full").select(*keys, verdict.alias("verdict"))


def compared_distances(truth: DataFrame, found: DataFrame, tolerance: float = 1e-9) -> DataFrame:
    """As ``compared`` for (qid, oid, tid, dist), with mismatch where distances differ by more than the tolerance."""
    keys = ["qid", "oid", "tid"]
    t, f = truth.select(*keys, F.col("dist").alias("_t")), found.select(*keys, F.col("dist").alias("_f"))
    verdict = F.when(F.col("_f").isNull(), "missing").when(F.col("_t").isNull(), "extra").when(F.abs(F.col("_t") - F.col("_f")) > tolerance, "mismatch").otherwise("correct")
    return t.join(f, keys, "full").select(*keys, verdict.alias("verdict"))


def shape_counts(indexed: DataFrame) -> DataFrame:
    """The index table: quad, shape and how many trajectories have them."""
    return indexed.groupBy("quad", "shape").agg(F.count("*").alias("n"))


def quad_shapes(indexed: DataFrame) -> DataFrame:
    """Per quad: distinct shapes and the union of their masks."""
    return indexed.groupBy("quad").agg(F.count_distinct("shape").alias("n_shapes"), F.bit_or("shape").alias("union_mask"), F.count("*").alias("n"))


def table_size(df: DataFrame) -> DataFrame:
    """Rows, points and bytes of the stored coordinates and ids."""
    width = 8 + F.length("tid") + 12 * F.col("n")
    return df.agg(F.count("*").alias("n_trajectories"), F.sum("n").alias("n_points"), F.sum(width).alias("n_bytes"))
