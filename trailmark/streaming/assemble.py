"""Trajectories from a stream of points: a session of an object is a trajectory.

The same expression serves batch and stream. On a stream the watermark bounds
both lateness and state; a session is emitted once the watermark has passed its end.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from trailmark.model import with_bounds


def sessions(points: DataFrame, gap: str = "30 minutes", lateness: str = "10 minutes") -> DataFrame:
    """Canonical table of points (oid BIGINT, ts TIMESTAMP, xi INT, yi INT); ``tid`` is the session's start in seconds."""
    rows = points.withWatermark("ts", lateness)
    point = F.struct("ts", "xi", "yi")
    grouped = rows.groupBy("oid", F.session_window("ts", gap).alias("s")).agg(F.sort_array(F.collect_list(point)).alias("p"))
    pick = lambda c: F.transform("p", lambda p: p[c])
    flat = grouped.select(
        "oid",
        F.unix_seconds("s.start").cast("string").alias("tid"),
        F.lit(None).cast("string").alias("sid"),
        F.size("p").alias("n"),
        pick("xi").alias("xs"),
        pick("yi").alias("ys"),
        F.transform("p", lambda p: F.unix_seconds(p.ts).cast("int")).alias("ts"),
    )
    return with_bounds(flat)


def write_stream(stream: DataFrame, index, path: str, checkpoint: str):
    """Appends keyed trajectories to a table as the stream closes them; each batch is sorted by key."""

    def batch(df: DataFrame, _: int) -> None:
        index.index(df).sortWithinPartitions("idx").write.mode("append").parquet(f"{path}/rows")

    return stream.writeStream.outputMode("append").option("checkpointLocation", checkpoint).foreachBatch(batch)
