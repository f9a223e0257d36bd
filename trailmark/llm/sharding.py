"""Two-pass external shuffle into shards whose row counts differ by one at most.

Pass one scatters the records by a seeded hash into buckets of a set size in
bytes, one bucket a task; pass two gives each bucket a Fisher-Yates shuffle and
writes it. The buckets, one after the other, are the shuffled order of the whole
input, which is cut into equal runs, the shards; a slot is the place in the shard.

The result follows from the rows and the seed alone: a row's hash decides its
bucket and its place before the shuffle, and each bucket's permutation is drawn
over numbers, in a frame of one row a bucket whose partitions are fixed, never
over the records, whose tasks and order a cluster may change.

Defined cases: a null text counts one byte; rows with equal id and text are told
apart by an occurrence number, so that they scatter too, a hot one included: they are
counted before the shuffle and numbered afterwards, a block of ``RUN`` a task;
null ids are an id like any other; an empty table gives no rows. The whole input row
travels in the struct ``record``, so no column can clash. The driver holds one
count for each bucket, as many as the input has ``bucket_bytes``.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from trailmark.llm.shared import work_dir, written

#: Occurrences of one row that are numbered in one go.
RUN = 4096
#: Permutations that one task draws, one after the other.
DRAWN = 64
#: Repeated rows, and places of permutations, that are broadcast; more are joined by shuffle.
FEW = 200_000


def text_bytes(text: Column) -> Column:
    """UTF-8 bytes of a text, none for null, plus one."""
    return F.coalesce(F.octet_length(text), F.lit(0)).cast("bigint") + 1


def _keyed(docs: DataFrame, seed: int) -> DataFrame:
    """``record`` and ``tie``, a seeded hash that tells all rows apart, equal ones by their occurrence."""
    text = F.col("record.text")
    print_ = F.xxhash64(F.lit(seed), F.coalesce(F.col("record.doc_id").cast("string"), F.lit("null")), F.coalesce(F.length(text), F.lit(-1)), text)
    rows = docs.select(F.struct("*").alias("record")).withColumn("print", print_)
    again = written(rows.groupBy("print").agg(F.count("*").alias("c")).where("c > 1").select("print"), "repeated")
    n = again.count()
    none = F.lit(0).cast("bigint")
    if not n:
        return rows.select("record", F.xxhash64(F.lit(seed), "print", none).alias("tie"))
    again = F.broadcast(again) if n <= FEW else again
    single = rows.join(again, "print", "left_anti").select("record", F.xxhash64(F.lit(seed), "print", none).alias("tie"))
    # rows alike in all columns are one row and their number, rows with equal id and text only stay apart by the rest
    alike = rows.join(again, "print", "left_semi").groupBy("print", F.xxhash64(F.to_json("record")).alias("rest")).agg(F.first("record").alias("record"), F.count("*").alias("c"))
    runs = alike.select("*", F.explode(F.sequence(none, F.expr(f"(c - 1) div {RUN}"))).alias("run")).repartition("print", "rest", "run")
    each = runs.select("record", "print", "rest", F.explode(F.sequence(F.col("run") * RUN, F.least(F.col("c"), (F.col("run") + 1) * RUN) - 1)).alias("occurrence"))
    return single.unionByName(each.select("record", F.xxhash64(F.lit(seed), "print", "rest", "occurrence").alias("tie")))


def shuffled(docs: DataFrame, n_shards: int = 8, seed: int = 20_260, bucket_bytes: int = 16 << 20) -> DataFrame:
    """``record``, ``shard`` and ``slot`` of every row of ``docs`` (columns ``doc_id`` and ``text`` at least).

    ``bucket_bytes`` is what one task shuffles at a time. Its records are sorted, which can spill; in memory is
    the permutation, four bytes a record.
    """
    spark, rows = docs.sparkSession, _keyed(docs, seed)
    total = docs.agg(F.sum(text_bytes(F.col("text")))).first()[0] or 0
    n_buckets = max(1, math.ceil(total / bucket_bytes))
    rows = rows.withColumn("bucket", F.pmod(F.xxhash64(F.lit(seed), "tie"), F.lit(n_buckets)).cast("int"))
    found = {r.bucket: r.n for r in rows.groupBy("bucket").agg(F.count("*").alias("n")).collect()}  # n_buckets rows
    n, starts = 0, []
    for b in range(n_buckets):
        starts.append((b, n, found.get(b, 0)))
        n += found.get(b, 0)
    starts = spark.createDataFrame(starts, "bucket int, start bigint, n bigint").where("n > 0")
    numbers = spark.range(0, n_buckets, 1, math.ceil(n_buckets / DRAWN)).select(F.col("id").cast("int").alias("bucket"))
    drawn = numbers.join(F.broadcast(starts), "bucket").select("bucket", "start", F.shuffle(F.sequence(F.lit(0), F.col("n").cast("int") - 1), F.lit(seed)).alias("to"))
    drawn = written(drawn, "permutations")
    ranked = rows.repartitionById(n_buckets, "bucket").withColumn("at", F.row_number().over(W.partitionBy("bucket").orderBy("tie")) - 1)
    drawn = F.broadcast(drawn) if n <= FEW else drawn.repartitionById(n_buckets, "bucket")  # dealt like the rows
    place = ranked.join(drawn, "bucket").select("record", (F.col("start") + F.get("to", F.col("at"))).alias("place"))
    n = max(n, 1)
    shard = F.expr(f"((place + 1) * {n_shards} - 1) div {n}")
    return place.withColumn("shard", shard.cast("int")).select("record", "shard", F.expr(f"place - cast(shard AS bigint) * {n} div {n_shards}").alias("slot"))


def write_shards(docs: DataFrame, path: str | None = None, **how) -> DataFrame:
    """Writes the shards as Parquet under ``path``, a folder each, and returns them as read back.

    Without a path they go to the shared work folder.
    """
    spark = docs.sparkSession
    path = path or work_dir(spark, "shards")
    out = shuffled(docs, **how)
    out.write.partitionBy("shard").parquet(path)
    return spark.read.schema(out.schema).parquet(path)
