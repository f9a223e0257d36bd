"""Trajectories from an event stream: a user's events of a week are one trajectory."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from trailmark.model import with_bounds

#: 2024-01-01 UTC and a week, in seconds.
EPOCH, WEEK = 1_704_067_200, 604_800


def points(events: DataFrame) -> DataFrame:
    """oid, tid, t (seconds), event_id, xi, yi (micro-degrees) of each event."""
    seconds = F.floor(F.unix_micros(F.col("ts").cast("timestamp")) / 1_000_000)
    user = F.col("user_id")
    xi = 115_290_000 + (user * 7919) % 1000 * 2300 + F.round(F.col("value") * 100).cast("bigint") * 3
    yi = 39_000_000 + (user * 104_729) % 1000 * 2300 + (F.col("event_id") * 37) % 1000 * 150
    return events.select(user.alias("oid"), F.floor((seconds - EPOCH) / WEEK).cast("string").alias("tid"), seconds.alias("t"), "ts", "event_id", xi.cast("int").alias("xi"), yi.cast("int").alias("yi"))


def trajectories(events: DataFrame) -> DataFrame:
    """Canonical table; one shuffle, points in order of (ts, event_id)."""
    rows = F.sort_array(F.collect_list(F.struct("ts", "event_id", "xi", "yi", "t")))
    grouped = points(events).groupBy("oid", "tid").agg(rows.alias("p"))
    pick = lambda c: F.transform("p", lambda p: p[c].cast("int"))
    return with_bounds(grouped.select("oid", "tid", F.lit(None).cast("string").alias("sid"), F.size("p").alias("n"), pick("xi").alias("xs"), pick("yi").alias("ys"), pick("t").alias("ts")))
