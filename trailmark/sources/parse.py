"""Trajectories from text lines, in three layouts.

* pipe: ``oid|tid|sid|x,y;x,y;...`` (any line with a bar)
* csv: ``oid,tid,sid,WKT`` (three or more commas' parts before the geometry)
* standard: ``oid-tid-WKT`` (two cuts, so negative coordinates survive)

WKT is MULTIPOINT, LINESTRING or POINT, with or without z (epoch milliseconds) and
inner brackets. Lines that fit no layout, or hold no point, are rejected: they
come out of ``rejected`` with a reason, never silently.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from trailmark.model import POINTS

_NUMBER = r"[-+]?(?:\d+\.?\d*|\.\d+)(?:[eE][-+]?\d+)?"
_GEOMETRY = r"(?i)(LINESTRING|MULTIPOINT|POINT)"


def wkt_points(wkt: Column) -> Column:
    """Points of MULTIPOINT, LINESTRING or POINT text; null for other text."""
    inner = F.regexp_extract(wkt, r"(?is)^\s*(?:LINESTRING|MULTIPOINT|POINT)\s*Z?\s*\((.*)\)\s*$", 1)
    parts = F.split(F.translate(inner, "()", ""), ",")
    numbers = F.transform(parts, lambda p: F.split(F.trim(p), r"\s+"))
    good = F.filter(numbers, lambda a: (F.size(a) >= 2) & a[0].rlike(f"^{_NUMBER}$") & a[1].rlike(f"^{_NUMBER}$"))
    points = F.transform(good, lambda a: F.struct(a[0].try_cast("double").alias("x"), a[1].try_cast("double").alias("y"), F.get(a, 2).try_cast("double").cast("bigint").alias("t")))
    return F.when(inner != "", points.cast(POINTS))


def pair_points(text: Column) -> Column:
    """Points of ``x,y;x,y;...``; blank and short pairs are skipped."""
    pairs = F.filter(F.transform(F.split(text, ";"), lambda p: F.split(F.trim(p), ",")), lambda a: F.size(a) >= 2)
    points = F.transform(pairs, lambda a: F.struct(F.trim(a[0]).try_cast("double").alias("x"), F.trim(a[1]).try_cast("double").alias("y"), F.lit(None).cast("bigint").alias("t")))
    return F.filter(points, lambda p: p.x.isNotNull() & p.y.isNotNull()).cast(POINTS)


def parse_lines(lines: DataFrame, column: str = "value") -> DataFrame:
    """layout, oid, tid, sid, points (null if the line is not understood) and the line itself."""
    line = F.trim(F.col(column))
    head = F.split(F.regexp_extract(line, rf"(?is)^(.*?)(?:LINESTRING|MULTIPOINT|POINT)", 1), ",")
    bar, dash = F.split(line, r"\|"), F.split(line, "-", 3)
    layout = F.when(line.contains("|"), "pipe").when(line.rlike(_GEOMETRY) & (F.size(head) >= 4), "csv").when(line.contains("-"), "standard")
    geometry = F.regexp_extract(line, r"(?is)((?:LINESTRING|MULTIPOINT|POINT).*)$", 1)
    pick = lambda pipe, csv, standard: F.when(F.col("layout") == "pipe", pipe).when(F.col("layout") == "csv", csv).when(F.col("layout") == "standard", standard)
    rows = lines.where(F.coalesce(line, F.lit("")) != "").withColumn("layout", layout)
    return rows.select(
        "layout",
        F.trim(pick(F.get(bar, 0), F.get(head, 0), F.get(dash, 0))).try_cast("bigint").alias("oid"),
        F.trim(pick(F.get(bar, 1), F.get(head, 1), F.get(dash, 1))).alias("tid"),
        pick(F.trim(F.get(bar, 2)), F.trim(F.get(head, 2)), F.lit(None)).alias("sid"),
        pick(pair_points(F.get(bar, 3)), wkt_points(geometry), wkt_points(F.get(dash, 2))).alias("points"),
        F.col(column).alias("line"),
    )


_USABLE = "oid IS NOT NULL AND tid IS NOT NULL AND coalesce(size(points), 0) > 0"


def parsed(lines: DataFrame, column: str = "value") -> DataFrame:
    return parse_lines(lines, column).where(_USABLE)


def rejected(lines: DataFrame, column: str = "value") -> DataFrame:
    """Lines that gave no trajectory, with the reason."""
    reason = F.when(F.col("layout").isNull(), "unknown layout").when(F.col("oid").isNull(), "oid is no number").when(F.col("tid").isNull(), "no tid").otherwise("no points")
    return parse_lines(lines, column).where(f"NOT coalesce({_USABLE}, false)").select("line", reason.alias("reason"))


def read_text(spark: SparkSession, path: str) -> DataFrame:
    """Parsed rows of text files; any path or glob that Spark reads."""
    return parsed(spark.read.text(path))
