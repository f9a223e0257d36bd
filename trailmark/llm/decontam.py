"""Benchmark decontamination by a prefix-filtered join.

A benchmark window (ten consecutive words, or the whole of a shorter item) can
only occur in a document that has the window's rarest word. Words are ordered
by their count over all documents, each window's rarest word is its prefix,
and only documents' occurrences of prefix words meet windows. A candidate's
place in the window fixes where the window would start: the positional bound
rejects starts before the text or ends past it, and the words between are
compared in full.

Defined cases: null and empty texts have no words; a null item_id hits words
but is not listed; items without words have no window; repeated documents
give a row each; repeated items count once. Long texts stay in one row and
are read once, each occurrence of a prefix word costing one comparison.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from trailmark.llm.shared import written
from trailmark.llm.text import alnum_words

#: Windows that are broadcast at once; a larger benchmark is joined in blocks.
BLOCK = 200_000
#: Stands behind the last word of each document; no word can be a blank.
END = " "


def windows(bench: DataFrame, size: int = 10) -> DataFrame:
    """``words`` (array) and ``items`` (ids as strings) of each distinct window."""
    items = bench.select(F.col("item_id").cast("string").alias("item"), alnum_words(F.col("text")).alias("w"))
    starts = F.sequence(F.lit(1), F.greatest(F.size("w") - size + 1, F.lit(1)))
    cut = items.where(F.size("w") > 0).select("item", F.explode(F.transform(starts, lambda i: F.slice("w", i, size))).alias("words"))
    return cut.groupBy("words").agg(F.collect_set("item").alias("items"))


def _tokens(docs: DataFrame) -> DataFrame:
    text = F.coalesce(F.col("text"), F.lit(""))
    rows = docs.select("doc_id", F.xxhash64(text, F.length(text)).alias("print"), alnum_words(text).alias("words"))
    ended = F.concat(F.col("words"), F.array(F.lit(END)))
    return rows.select("doc_id", "print", "words", F.size("words").alias("n"), F.posexplode(ended).alias("pos", "token"))


def prefixes(docs: DataFrame, wins: DataFrame) -> DataFrame:
    """``token`` and its ``place`` in the window: the window's word that is rarest over all documents."""
    spots = wins.select("words", "items", F.posexplode("words").alias("place", "token"))
    vocabulary = spots.select("token").distinct()
    words = docs.select(F.explode(alnum_words(F.col("text"))).alias("token"))
    few = vocabulary.count() <= BLOCK
    counts = words.join(F.broadcast(vocabulary) if few else vocabulary, "token", "left_semi").groupBy("token").agg(F.count("*").alias("df"))
    # no more rows than the vocabulary; broadcast, so that the places of a common word stay where they are
    ranked = spots.join(F.broadcast(counts) if few else counts, "token", "left").withColumn("df", F.coalesce("df", F.lit(0)))
    first = F.min(F.struct("df", "token", "place")).alias("first")
    best = ranked.groupBy("words").agg(first, F.first("items").alias("items"))
    return best.select("first.token", "first.place", F.size("words").alias("len"), F.array_join("words", " ").alias("window"), "items")


def _covered(spans: Column) -> Column:
    """Words in the union of spans (start, end)."""
    zero = F.lit(0).cast("bigint")
    return F.aggregate(
        F.sort_array(spans),
        F.struct(zero.alias("n"), zero.alias("e")),
        lambda s, x: F.struct((s.n + F.greatest(zero, x.end - F.greatest(x.start, s.e))).alias("n"), F.greatest(s.e, x.end).alias("e")),
        lambda s: s.n,
    )


def contamination(docs: DataFrame, bench: DataFrame, size: int = 10, block: int = BLOCK) -> DataFrame:
    """Per document: doc_id, print, n_words, n_hit, n_items, items_sha256, contaminated, spans.

    ``print`` is a hash of the text, so that (doc_id, print) finds the row again.
    """
    table = written(prefixes(docs, windows(bench, size)), "windows")
    blocks = max(1, math.ceil(table.count() / block))
    parts = []
    for b in range(blocks):
        part = table.where(F.pmod(F.xxhash64("window"), F.lit(blocks)) == b) if blocks > 1 else table
        if not b:
            end = docs.sparkSession.range(1).select(F.lit(END).alias("token"), F.lit(0).alias("place"), F.lit(0).alias("len"), F.lit(None).cast("string").alias("window"), F.array().cast("array<string>").alias("items"))
            part = part.unionByName(end)
        start = F.col("pos") - F.col("place")
        met = _tokens(docs).join(F.broadcast(part), "token")
        same = (start >= 0) & (start + F.col("len") <= F.col("n")) & (F.array_join(F.slice("words", F.greatest(start + 1, F.lit(1)), F.col("len")), " ") == F.col("window"))
        met = met.where((F.col("token") == END) | same)
        span = F.when(F.col("token") != END, F.struct(start.cast("bigint").alias("start"), (start + F.col("len")).cast("bigint").alias("end")))
        parts.append(met.select("doc_id", "print", F.col("n").cast("bigint").alias("n"), (F.col("token") == END).cast("bigint").alias("copies"), span.alias("span"), "items"))
    met = parts[0]
    for p in parts[1:]:
        met = met.unionByName(p)
    found = met.groupBy("doc_id", "print").agg(F.max("n").alias("n_words"), F.sum("copies").alias("copies"), F.collect_set("span").alias("spans"), F.array_distinct(F.flatten(F.collect_set("items"))).alias("items"))
    found = found.withColumn("items", F.sort_array("items")).withColumn("n_hit", _covered(F.col("spans")))
    return found.select(
        "doc_id",
        "print",
        "n_words",
        "n_hit",
        F.size("items").cast("bigint").alias("n_items"),
        F.sha2(F.array_join("items", ","), 256).alias("items_sha256"),
        (F.col("n_hit") > 0).alias("contaminated"),
        "spans",
        F.explode(F.array_repeat(F.lit(0), F.col("copies").cast("int"))).alias("_copy"),
    ).drop("_copy")


def clean(docs: DataFrame, bench: DataFrame, size: int = 10) -> DataFrame:
    """The rows of ``docs`` in which no window occurs, with the columns of ``docs``."""
    bad = contamination(docs.select("doc_id", "text"), bench, size).where("contaminated").select(F.col("doc_id").alias("_id"), F.col("print").alias("_print")).distinct()
    text = F.coalesce(F.col("record.text"), F.lit(""))
    rows = docs.select(F.struct("*").alias("record"))
    return rows.join(bad, F.col("record.doc_id").eqNullSafe(F.col("_id")) & (F.xxhash64(text, F.length(text)) == F.col("_print")), "left_anti").select("record.*")
