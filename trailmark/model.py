"""The trajectory model: one row a trajectory, coordinates as micro-degree integers.

Columns of a trajectory table: oid BIGINT, tid STRING, sid STRING, n INT, xs, ys
ARRAY<INT> (micro-degrees), ts ARRAY<INT> (epoch seconds, null where the input has no
time), and, derived, xmin, ymin, xmax, ymax DOUBLE (degrees), start_x, start_y, end_x, end_y
DOUBLE, start_time, end_time TIMESTAMP. Everything, indexes included, works on
the quantised coordinates, so that no index can lose what the exact filter keeps.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

MICRO = 1_000_000
POINTS = "array<struct<x:double,y:double,t:bigint>>"


@dataclass(frozen=True)
class Extent:
    """The space that a table's index covers, in degrees; points outside count as on its border."""

    xmin: float
    ymin: float
    xmax: float
    ymax: float

    def micro(self) -> tuple[int, int, int, int]:
        return tuple(round(v * MICRO) for v in (self.xmin, self.ymin, self.xmax, self.ymax))


#: The two cities' extents.
BEIJING = Extent(115.29, 39.00, 117.83, 41.50)
CHENGDU = Extent(104.04, 30.65, 104.13, 30.73)


def quantised(points: Column) -> tuple[Column, Column, Column]:
    """xs, ys, ts of points in degrees and epoch milliseconds; truncates towards zero."""
    whole = lambda v: v.cast("int")
    return (
        F.transform(points, lambda p: whole(p.x * MICRO)),
        F.transform(points, lambda p: whole(p.y * MICRO)),
        F.transform(points, lambda p: whole(p.t / 1000)),
    )


def with_bounds(df: DataFrame) -> DataFrame:
    """Adds envelope, end points and times to a table with xs, ys, ts."""
    deg = lambda v: v / F.lit(float(MICRO))
    at = lambda c, i: F.get(c, F.lit(0) if i else F.size(c) - 1)
    return df.withColumns(
        {
            "xmin": deg(F.array_min("xs")),
            "ymin": deg(F.array_min("ys")),
            "xmax": deg(F.array_max("xs")),
            "ymax": deg(F.array_max("ys")),
            "start_x": deg(at("xs", 1)),
            "start_y": deg(at("ys", 1)),
            "end_x": deg(at("xs", 0)),
            "end_y": deg(at("ys", 0)),
            "start_time": F.timestamp_seconds(at("ts", 1)),
            "end_time": F.timestamp_seconds(at("ts", 0)),
        }
    )


def trajectories(df: DataFrame) -> DataFrame:
    """Canonical table of parsed rows (oid, tid, sid, points); rows without points are dropped, as they have no place."""
    xs, ys, ts = quantised(F.col("points"))
    df = df.where(F.size("points") > 0).select(F.col("oid").cast("bigint").alias("oid"), "tid", "sid", F.size("points").alias("n"), xs.alias("xs"), ys.alias("ys"), ts.alias("ts"))
    return with_bounds(df)


def points_of(xs="xs", ys="ys") -> Column:
    """Points in degrees of a canonical row."""
    return F.zip_with(xs, ys, lambda x, y: F.struct((x / F.lit(float(MICRO))).alias("x"), (y / F.lit(float(MICRO))).alias("y")))


def to_wkt(xs: Column, ys: Column, ts: Column) -> Column:
    """MULTIPOINT text in degrees, with epoch milliseconds as z where there is time."""
    num = lambda v: (v.cast("decimal(20,6)") / MICRO).cast("decimal(20,6)").cast("string")
    parts = F.transform(F.arrays_zip(xs.alias("x"), ys.alias("y"), ts.alias("t")), lambda p: F.concat_ws(" ", num(p.x), num(p.y), (p.t.cast("bigint") * 1000).cast("string")))
    return F.concat(F.lit("MULTIPOINT ("), F.array_join(parts, ", "), F.lit(")"))


def to_text(df: DataFrame) -> DataFrame:
    """``value``: a line ``oid-tid-WKT`` for each trajectory."""
    return df.select(F.concat_ws("-", F.col("oid").cast("string"), "tid", to_wkt(F.col("xs"), F.col("ys"), F.col("ts"))).alias("value"))
