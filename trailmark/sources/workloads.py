"""Query workloads: windows and query trajectories."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from trailmark.sources.parse import parsed

SCHEMA = "qid int, xmin double, ymin double, xmax double, ymax double"


def _numbered(rows: DataFrame, order: str) -> DataFrame:
    """Windows of lines with exactly four numbers; a workload is a list, hence small."""
    parts = F.split("value", ",")
    cast = [F.trim(F.get(parts, i)).try_cast("double").alias(c) for i, c in enumerate(("xmin", "ymin", "xmax", "ymax"))]
    good = rows.where(F.size(parts) == 4).select(order, *[c for c in rows.columns if c not in ("value", order)], *cast).dropna(subset=["xmin", "ymin", "xmax", "ymax"])
    return good.withColumn("qid", F.expr(f"row_number() over (order by {order})").cast("int")).drop(order)


def windows_text(spark: SparkSession, path: str) -> DataFrame:
    """A window ``xmin,ymin,xmax,ymax`` a line; lines of another form are skipped."""
    return _numbered(spark.read.text(path).withColumn("at", F.monotonically_increasing_id()), "at")


def windows_json(spark: SparkSession, path: str) -> DataFrame:
    """``[{"query": "xmin,ymin,xmax,ymax", "range_meters": n}, ...]``."""
    rows = spark.read.schema("query string, range_meters int").json(path, multiLine=True)
    return _numbered(rows.select(F.col("query").alias("value"), "range_meters").withColumn("at", F.monotonically_increasing_id()), "at")


def windows_inline(spark: SparkSession, text: str) -> DataFrame:
    """Windows between semicolons."""
    return _numbered(spark.createDataFrame(list(enumerate(w.strip() for w in text.split(";") if w.strip())), "at int, value string"), "at")


def windows_list(spark: SparkSession, rows) -> DataFrame:
    return spark.createDataFrame([(i, *map(float, w)) for i, w in rows], SCHEMA)


def window_path(base: str, distribution: str, metres: int) -> str:
    return f"{base}/range/{distribution}/{distribution}_{metres}m.txt"


def query_trajectories(spark: SparkSession, path: str, limit: int | None = None) -> DataFrame:
    """Query trajectories, one a line; ``limit`` is how many the workload asks for."""
    rows = parsed(spark.read.text(path))
    return rows.limit(limit) if limit else rows
