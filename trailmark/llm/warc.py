"""Web archives: one record a page, written and read back by boundary chains.

Writing: a record is a string, and Spark's text writer puts the record end
between records, so files go wherever Spark can write. Among equal payloads of
``LEAST`` bytes or more the one with the smallest page_id is stored, the others
are revisits without payload.

Reading: Spark's text reader cuts the files at every occurrence of the magic
line, wherever it is, many tasks to a file. Each piece is a candidate record with
the offset at which the next must start. Offsets are worked out in one scan and
written. A second scan, for the text of pieces that turn out to be parts of a payload,
finds them by the SHA-256 of the piece, never by where a scan has cut the files: splits
may differ from scan to scan. A payload may hold the magic line, so
candidates need not be records; records are those that the chain from the start
of the file reaches. The chain is followed by pointer jumping: inside a block
(what one task has read of a file) each candidate's pointer jumps to the first
offset behind the block, then pointers jump across blocks, doubling their reach.

Defined cases: a null html is an empty payload; a null page_id is written as
an empty id, read as null, and is always a response; a null url has no
target line, control characters in a url are percent-encoded; rows with an equal
id and payload are all responses, if theirs is the smallest id; a cut-off last
record is left out; extra columns are not stored.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from trailmark.llm.shared import work_dir, written

MAGIC, END = "WARC/1.1\r\n", "\r\n\r\n"
LEAST = 100
#: Revisits that are broadcast to the pages; more are joined by shuffle.
FEW = 500_000
#: Fixed value: the date of all records, so that equal pages give equal archives.
DATE = "2024-01-01T00:00:00Z"


def _line(name: str, value: Column) -> Column:
    return F.coalesce(F.concat(F.lit(f"{name}: "), value, F.lit("\r\n")), F.lit(""))


def _escaped(url: Column) -> Column:
    out = url
    for c in range(32):
        out = F.replace(out, F.lit(chr(c)), F.lit(f"%{c:02X}"))
    return F.when(url.rlike(r"[\x00-\x1F]"), out).otherwise(url)


def revisits(pages: DataFrame) -> DataFrame:
    """page_id, digest and ``first`` (the response's id) of pages that repeat a payload."""
    payload = F.coalesce("html", F.lit(""))
    light = pages.select(F.col("page_id").cast("long").alias("page_id"), F.sha2(payload, 256).alias("digest"), F.octet_length(payload).alias("size")).where(F.col("size") >= LEAST)
    firsts = light.groupBy("digest").agg(F.min("page_id").alias("first"), F.max("page_id").alias("last")).where("first < last")
    return light.join(firsts.select("digest", "first"), "digest").where("page_id > first").select("page_id", "digest", "first").distinct()


def write_archive(pages: DataFrame, path: str | None = None) -> str:
    """Writes the archives of ``pages`` (page_id, url, html) and returns their folder."""
    path = path or work_dir(pages.sparkSession, "warc")
    again = written(revisits(pages), "revisits")
    payload = F.coalesce("html", F.lit(""))
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), "url", payload.alias("html"), F.sha2(payload, 256).alias("digest"))
    rows = rows.join(F.broadcast(again) if again.count() <= FEW else again, ["page_id", "digest"], "left")
    kind = F.when(F.col("first").isNull(), "response").otherwise("revisit")
    body = F.when(F.col("first").isNull(), F.col("html")).otherwise("")
    number = F.coalesce(F.col("page_id").cast("string"), F.lit(""))
    lines = [
        F.lit(MAGIC),
        _line("WARC-Type", kind),
        _line("WARC-Record-ID", F.concat(F.lit("<urn:page:"), number, F.lit(">"))),
        _line("WARC-Date", F.lit(DATE)),
        _line("WARC-Target-URI", _escaped(F.col("url"))),
        _line("WARC-Payload-Digest", F.concat(F.lit("sha256:"), "digest")),
        _line("WARC-Refers-To", F.concat(F.lit("<urn:page:"), F.col("first").cast("string"), F.lit(">"))),
        _line("X-Payload-Length", F.octet_length("html").cast("string")),
        _line("Content-Type", F.lit("text/html; charset=utf-8")),
        _line("Content-Length", F.octet_length(body).cast("string")),
        F.lit("\r\n"),
        body,
    ]
    rows.select(F.concat(*lines).alias("value")).write.option("lineSep", END).text(path)
    return path


def _head(name: str, kind: str = r"[^\r]*") -> Column:
    return F.regexp_extract("head", rf"(?i)\r\n{name}: *({kind}) *(?:\r\n|$)", 1)


def _number(text: Column) -> Column:
    return F.nullif(text, F.lit("")).try_cast("bigint")


def _pieces(spark: SparkSession, path: str) -> DataFrame:
    """What lies between magic lines: value, file, block, and ``at``, which grows within a block.

    The last two hold for one scan only, as they go with its splits.
    """
    raw = spark.read.option("lineSep", MAGIC).text(path)
    return raw.select("value", F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("at"))


def _print(value: Column) -> Column:
    """What a piece is found by again."""
    return F.unhex(F.sha2(value, 256))


def candidates(spark: SparkSession, path: str) -> DataFrame:
    """A row for each occurrence of the magic line: file, block, off, next, the header's
    values, digest of the payload if the piece is the whole record, else the piece itself."""
    rows = _pieces(spark, path).withColumn("head", F.concat(F.lit("\r\n"), F.substring_index("value", END, 1)))
    rows = rows.withColumn("size", _number(_head("Content-Length", "[0-9]{1,18}")))
    body = F.expr("substring(value, length(head) + 3)")  # the head has 2 characters more, the blank line 4
    rows = rows.withColumn("body", body)
    whole = (F.octet_length("body") == F.col("size") + 4) & F.col("body").endswith(END)
    payload = F.expr("left(body, length(body) - 4)")
    light = rows.select(
        "file",
        "block",
        "at",
        F.octet_length("value").cast("long").alias("bytes"),
        (F.octet_length("head") - 2 + len(END) + F.col("size") + len(END)).alias("span"),
        _head("WARC-Type").alias("type"),
        _head("WARC-Record-ID", "<urn:page:[0-9-]*>").alias("id"),
        _head("WARC-Refers-To", "<urn:page:[0-9-]*>").alias("refers"),
        _number(_head("X-Payload-Length", "[0-9]{1,18}")).alias("full"),
        _head("WARC-Payload-Digest", "sha256:[0-9a-f]*").alias("said"),
        F.when(whole, F.sha2(payload, 256)).alias("digest"),
        F.when(whole, F.lit(None)).otherwise(F.col("value")).alias("piece"),
        F.when(whole, _print(F.col("value"))).alias("print"),
        F.col("size"),
    )
    light = written(light, "candidates")
    own = F.sum(F.col("bytes") + len(MAGIC))
    blocks = light.groupBy("file", "block").agg(own.alias("total"))
    ahead = W.partitionBy("file").orderBy("block").rowsBetween(W.unboundedPreceding, -1)
    blocks = blocks.select("file", "block", F.coalesce(F.sum("total").over(ahead), F.lit(0)).alias("base"))
    before = W.partitionBy("file", "block").orderBy("at").rowsBetween(W.unboundedPreceding, -1)
    start = light.withColumn("start", F.coalesce(own.over(before), F.lit(0))).join(blocks, ["file", "block"])
    # what precedes a file's first magic line is no candidate
    spots = start.withColumn("off", F.col("base") + F.col("start") - len(MAGIC)).where("off >= 0")
    return spots.withColumn("next", F.col("off") + len(MAGIC) + F.col("span"))


def _exits(pdf: pd.DataFrame) -> pd.DataFrame:
    """Where each candidate's chain leaves the block."""
    pdf = pdf.sort_values("off", ignore_index=True)
    off, out = pdf["off"].to_numpy(), pdf["next"].fillna(-1).to_numpy(np.int64)
    while True:
        i = np.minimum(np.searchsorted(off, out), len(off) - 1)
        inside = off[i] == out
        if not inside.any():
            return pdf.assign(exit=out)[["file", "block", "off", "exit"]]
        out = np.where(inside, out[i], out)


def _marked(pdf: pd.DataFrame) -> pd.DataFrame:
    """The candidates that the block's entry reaches."""
    pdf = pdf.sort_values("off", ignore_index=True)
    off, to = pdf["off"].to_numpy(), pdf["next"].fillna(-1).to_numpy(np.int64)
    i = np.minimum(np.searchsorted(off, to), len(off) - 1)
    step = np.where(off[i] == to, i, np.arange(len(off)))  # the last of a chain points to itself
    on = pdf["entry"].to_numpy(bool)
    while True:  # what the marked ones reach in 1, 2, 4, ... steps
        more = on.copy()
        more[step[on]] = True
        if (more == on).all() and (step == step[step]).all():
            return pdf.loc[on, ["file", "off"]]
        on, step = more, step[step]


def reached(spots: DataFrame) -> DataFrame:
    """file and off of the candidates on the chain from their file's start."""
    links = spots.select("file", "block", "off", "next")
    jump = links.groupBy("file", "block").applyInPandas(_exits, "file string, block long, off long, exit long")
    jump = written(jump, "jumps")
    gates = jump.select("file", F.col("exit").alias("off")).distinct()
    entry = jump.where("off = 0").select("file", "off")
    hop = jump.join(gates, ["file", "off"], "left_semi").select("file", "off", "exit").unionByName(jump.where("off = 0").select("file", "off", "exit")).distinct()
    most = jump.groupBy("file").agg(F.countDistinct("block").alias("n")).agg(F.max("n")).first()[0] or 1
    for _ in range((most - 1).bit_length()):
        entry = written(entry.unionByName(hop.join(entry, ["file", "off"], "left_semi").select("file", F.col("exit").alias("off"))).distinct(), "entries")
        then = hop.select("file", F.col("off").alias("exit"), F.col("exit").alias("far"))
        hop = written(hop.join(then, ["file", "exit"]).select("file", "off", F.col("far").alias("exit")), "hops")
    flagged = links.join(entry.withColumn("entry", F.lit(True)), ["file", "off"], "left").withColumn("entry", F.coalesce("entry", F.lit(False)))
    return flagged.groupBy("file", "block").applyInPandas(_marked, "file string, off long")


def read_archive(spark: SparkSession, path: str) -> DataFrame:
    """page_id, payload_bytes, payload_digest, record_type, refers_to and ``sound``
    (the payload has the digest that its header states) of every record."""
    spots = written(candidates(spark, path), "spots")
    on_chain = written(reached(spots), "chain")
    good = spots.join(on_chain, ["file", "off"], "left_semi")
    whole = good.where("digest is not null")
    # records cut by a magic line in their payload: put their pieces together again
    parts = spots.where("piece is not null").select("file", "off", "piece")
    # pieces that look like records but lie in another's payload: only now is their text needed
    lost = spots.where("digest is not null").join(on_chain, ["file", "off"], "left_anti").select("file", "off", "print")
    prints = lost.select("print").distinct()
    n_lost = prints.count()
    if n_lost:
        texts = _pieces(spark, path).select(_print(F.col("value")).alias("print"), F.col("value").alias("piece"))
        texts = texts.join(F.broadcast(prints) if n_lost <= FEW else prints, "print", "left_semi").dropDuplicates(["print"])
        parts = parts.unionByName(lost.join(texts, "print").select("file", "off", "piece"))
    pieces = parts.join(on_chain.withColumn("on", F.lit(True)), ["file", "off"], "left")
    to_here = W.partitionBy("file").orderBy("off").rowsBetween(W.unboundedPreceding, 0)
    pieces = pieces.withColumn("record", F.last(F.when(F.col("on"), F.col("off")), True).over(to_here))
    joined = pieces.groupBy("file", F.col("record").alias("off")).agg(F.sort_array(F.collect_list(F.struct("off", "piece"))).alias("p"))
    text = F.array_join(F.transform("p", lambda x: x.piece), MAGIC)
    body = F.concat(F.lit(""), F.expr("substring(t, length(substring_index(t, '\\r\\n\\r\\n', 1)) + 5)")).cast("binary")
    joined = joined.withColumn("t", text).select("file", "off", body.alias("body"))
    cut = good.where("digest is null").drop("digest").join(joined, ["file", "off"]).where(F.octet_length("body") >= F.col("size"))
    cut = cut.withColumn("digest", F.sha2(F.expr("substring(body, 1, cast(size as int))"), 256)).drop("body")
    rows = whole.unionByName(cut)
    revisit = F.col("type") == "revisit"
    digest = F.when(revisit, F.substring("said", 8, 64)).otherwise(F.col("digest"))
    return rows.select(
        _number(F.regexp_extract("id", "[0-9-]+", 0)).alias("page_id"),
        F.when(revisit, F.col("full")).otherwise(F.col("size")).alias("payload_bytes"),
        digest.alias("payload_digest"),
        F.col("type").alias("record_type"),
        _number(F.regexp_extract("refers", "[0-9-]+", 0)).alias("refers_to"),
        (digest == F.substring("said", 8, 64)).alias("sound"),
    )
