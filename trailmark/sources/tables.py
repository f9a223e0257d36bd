"""Stored tables: range-sorted Parquet, and what says how a table is keyed."""

from __future__ import annotations

import json
from dataclasses import asdict

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from trailmark.model import Extent
from trailmark.plans.indexes import KINDS, AdaptiveIndex, BMNode
from trailmark.session import work_dir


def write_table(df: DataFrame, index, path: str | None = None) -> DataFrame:
    """Keys the trajectories by ``index``, writes them in order of the key, so that row groups
    have narrow ranges, with the index's description beside them, and returns the table as read back."""
    spark = df.sparkSession
    path = path or work_dir(spark, "table")
    if isinstance(index, AdaptiveIndex) and not index.nodes:
        index.build(df)
    rows = index.index(df)
    rows.repartitionByRange("idx").sortWithinPartitions("idx").write.mode("overwrite").parquet(f"{path}/rows")
    write_meta(spark, index, path)
    return spark.read.schema(rows.schema).parquet(f"{path}/rows")


def read_table(spark: SparkSession, path: str) -> tuple[DataFrame, object]:
    """A stored table and its index."""
    return spark.read.parquet(f"{path}/rows"), read_meta(spark, path)


def write_meta(spark: SparkSession, index, path: str) -> None:
    text = json.dumps({"kind": index.name, **asdict(index)})
    spark.createDataFrame([(text,)], "value string").coalesce(1).write.mode("overwrite").text(f"{path}/meta")


def read_meta(spark: SparkSession, path: str):
    """The index of a stored table; fields that the description lacks have their defaults."""
    d = json.loads("".join(r.value for r in spark.read.text(f"{path}/meta").collect()))  # one line
    kind = KINDS[d.pop("kind")]
    known = {k: v for k, v in d.items() if k in kind.__dataclass_fields__}
    if "extent" in known:
        known["extent"] = Extent(**known["extent"])
    if kind.name == "bmtree":
        known["nodes"] = tuple(BMNode(**n) for n in known["nodes"])
    elif kind.name == "adaptive":
        known["sizes"] = tuple(map(tuple, known["sizes"]))
    elif "theta" in known:
        known["theta"] = tuple(known["theta"])
    return kind(**known)


def write_index_table(table: DataFrame, path: str) -> DataFrame:
    """The side table: each distinct key and how many rows have it, in order of the key; returned as read back."""
    rows = table.groupBy("idx").agg(F.count("*").alias("n"))
    rows.repartitionByRange("idx").sortWithinPartitions("idx").write.mode("overwrite").parquet(f"{path}/index")
    return table.sparkSession.read.schema(rows.schema).parquet(f"{path}/index")


def looked_up(table: DataFrame, index, side: DataFrame, windows: list) -> DataFrame:
    """As ``index.select``, by way of the side table: its keys in the windows' ranges, then the rows with these keys."""
    keys = index.select(side.withColumns(index.parts()), windows).select("idx")
    return table.join(keys, "idx", "left_semi")


def write_shape_table(table: DataFrame, path: str) -> DataFrame:
    """The adaptive index's shapes: node, shape, its place in the node's order, rows; returned as read back."""
    rows = table.groupBy("q_order", "shape", F.col("idx").bitwiseAND(F.lit(0xFFFF).cast("bigint")).alias("shape_order")).agg(F.count("*").alias("n"))
    rows.repartitionByRange("q_order", "shape_order").write.mode("overwrite").parquet(f"{path}/shapes")
    return table.sparkSession.read.schema(rows.schema).parquet(f"{path}/shapes")


def drop_table(spark: SparkSession, path: str) -> bool:
    """Removes a stored table with all that lies beside it; whether there was one."""
    jvm = spark.sparkContext._jvm
    place = jvm.org.apache.hadoop.fs.Path(path)
    return place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(place, True)
