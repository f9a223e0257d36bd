"""Quality rules as a bitmask ledger.

``ledger`` evaluates every rule once for every document and stores its
measurements and a bit for each failed rule. A policy is a versioned set of
rules, so that applying one, or asking what a rule costs (``ablation``), reads
only the bitmask and never the text again.

Defined cases: null and empty texts have no words and fail ``too_short``;
repeated rows are judged one by one; ids play no part, so null ids pass
through; an empty table gives an empty ledger. The whole input row travels in
the struct ``record``, so that columns named like a measurement do not clash.
All work on a document happens inside its row: one pass, no shuffle.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from trailmark.llm.text import blank_words

#: The bits of a window's hash that are used: all.
HASHED = -1
SYMBOLS = "[#*$%&|<>]"
#: Rules in order of their bit: name and the condition for failure, in integers.
RULES = (
    ("too_short", "n_words < 50"),
    ("repetitive", "100 * n_repeat_words > 50 * n_words"),
    ("symbols", "100 * n_symbols > 10 * word_chars"),
    ("long_words", "word_chars > 25 * n_words"),
    ("repeated_lines", "100 * n_dup_lines > 50 * n_lines"),
)
BITS = {name: 1 << i for i, (name, _) in enumerate(RULES)}
#: Versioned policies: the rules that reject.
POLICIES = {
    "base": ("too_short", "repetitive"),
    "v1": ("too_short", "repetitive", "symbols", "long_words"),
    "strict": tuple(BITS),
}


def mask_of(policy: str) -> int:
    return sum(BITS[name] for name in POLICIES[policy])


def _repeat_words(words: Column, n: Column) -> dict[str, Column]:
    """Columns, each built on the ones before, that count the words inside repeated 3-word windows.

    A window becomes one long: high bits of its hash, low bits its position.
    Sorting the longs brings equal windows together; the positions kept are
    those with an equal neighbour, and each covers three words, fewer where it
    runs into the next. Neighbours of equal hashes are compared word by word; in the
    rare text where they differ, the windows themselves are sorted instead.
    """
    low = F.expr("shiftleft(1L, length(bin(n_words))) - 1")

    def window(i: Column) -> Column:
        h = F.xxhash64(F.get(words, i), F.get(words, i + 1), F.get(words, i + 2))
        h = h if HASHED == -1 else h.bitwiseAND(F.lit(HASHED))
        return h.bitwiseAND(F.bitwise_not(F.col("_low"))).bitwiseOR(i.cast("bigint"))

    def near(x: Column, other: Column) -> Column:
        same = x.bitwiseXOR(other).bitwiseAND(F.bitwise_not(F.col("_low"))) == 0
        return F.coalesce(same, F.lit(False))

    def place(x: Column) -> Column:
        return x.bitwiseAND(F.col("_low"))

    def unlike(x: Column, other: Column) -> Column:
        i, j = place(x).cast("int"), place(other).cast("int")
        return (F.get(words, i) != F.get(words, j)) | (F.get(words, i + 1) != F.get(words, j + 1)) | (F.get(words, i + 2) != F.get(words, j + 2))

    windows = F.when(n >= 3, F.sort_array(F.transform(F.sequence(F.lit(0), n.cast("int") - 3), window)))
    at = lambda k: F.get(F.col("_sorted"), k)
    twice = F.filter(F.col("_sorted"), lambda x, k: near(x, at(k - 1)) | near(x, at(k + 1)))
    before = lambda k: F.get(F.col("_twice"), k - 1)
    clash = F.size(F.filter(F.col("_twice"), lambda x, k: near(x, before(k)) & unlike(x, before(k)))) > 0
    grams = F.sort_array(F.transform(F.sequence(F.lit(0), n.cast("int") - 3), lambda i: F.struct(F.concat_ws(" ", F.get(words, i), F.get(words, i + 1), F.get(words, i + 2)).alias("g"), i.cast("bigint").alias("i"))))
    gram = lambda k: F.get(F.col("_grams"), k).g
    truly = F.filter(F.col("_grams"), lambda x, k: F.coalesce(x.g == gram(k - 1), F.lit(False)) | F.coalesce(x.g == gram(k + 1), F.lit(False)))
    starts = F.sort_array(F.when(F.col("_clash"), F.transform(truly, lambda x: x.i)).otherwise(F.transform(F.col("_twice"), place)))
    gaps = F.transform(F.col("_starts"), lambda x, k: F.least(F.lit(3).cast("bigint"), x - F.coalesce(F.get(F.col("_starts"), k - 1), x - 3)))
    total = F.aggregate(gaps, F.lit(0).cast("bigint"), lambda a, b: a + b)
    return {"_low": low, "_sorted": windows, "_twice": twice, "_clash": clash, "_grams": F.when(F.col("_clash"), grams), "_starts": starts, "n_repeat_words": F.coalesce(total, F.lit(0).cast("bigint"))}


def ledger(docs: DataFrame) -> DataFrame:
    """``record`` (the input row), the measurements (long) and ``fail_bits`` (long) of each document."""
    text = F.coalesce(F.col("record.text"), F.lit(""))
    rows = docs.select(F.struct("*").alias("record")).select("record", text.alias("_text"), blank_words(text).alias("_words"))
    lines = F.filter(F.split(F.col("_text"), "\n"), lambda s: s.rlike(r"[^\x20\x09-\x0D]"))
    rows = rows.select(
        "record",
        "_words",
        F.size("_words").cast("bigint").alias("n_words"),
        F.length(F.array_join("_words", "")).cast("bigint").alias("word_chars"),
        (F.length("_text") - F.length(F.regexp_replace("_text", SYMBOLS + "+", ""))).cast("bigint").alias("n_symbols"),
        lines.alias("_lines"),
    )
    rows = rows.select("*", F.size("_lines").cast("bigint").alias("n_lines"), F.size(F.array_distinct("_lines")).cast("bigint").alias("_kinds"))
    rows = rows.withColumn("n_dup_lines", F.col("n_lines") - F.col("_kinds"))
    for name, column in _repeat_words(F.col("_words"), F.col("n_words")).items():
        rows = rows.withColumn(name, column)
    bits = sum((F.when(F.expr(failed), F.lit(bit).cast("bigint")).otherwise(F.lit(0).cast("bigint")) for (_, failed), bit in zip(RULES, BITS.values(), strict=True)), F.lit(0).cast("bigint"))
    return rows.select("record", "n_words", "word_chars", "n_symbols", "n_lines", "n_dup_lines", "n_repeat_words", bits.alias("fail_bits"))


def passes(policy: str) -> Column:
    """Whether a ledger row passes the policy."""
    return F.col("fail_bits").bitwiseAND(F.lit(mask_of(policy)).cast("bigint")) == 0


def accepted(docs: DataFrame, policy: str = "v1") -> DataFrame:
    """The rows of ``docs`` that pass, with the columns of ``docs``."""
    # behind a generator, so that the optimiser doesn't copy the rules into the filter once for each use
    rows = ledger(docs).select("record", F.explode(F.array("fail_bits")).alias("fail_bits"))
    return rows.where(passes(policy)).select("record.*")


def ablation(rows: DataFrame, policy: str) -> DataFrame:
    """For each rule of a policy: rows that fail it, and rows that fail it alone, hence kept without it.

    Counts go through the distinct bitmasks, of which there are at most
    ``2 ** len(RULES)``; no document is looked at again.
    """
    mask = mask_of(policy)
    masks = rows.groupBy(F.col("fail_bits").bitwiseAND(F.lit(mask).cast("bigint")).alias("bits")).agg(F.count("*").alias("n"))
    names = F.array(*(F.struct(F.lit(n).alias("rule"), F.lit(BITS[n]).cast("bigint").alias("bit")) for n in POLICIES[policy]))
    each = masks.select("bits", "n", F.explode(names).alias("r")).select("bits", "n", "r.rule", "r.bit")
    hit = F.col("bits").bitwiseAND(F.col("bit")) != 0
    zero = F.lit(0).cast("bigint")
    return each.groupBy("rule", "bit").agg(
        F.sum(F.when(hit, F.col("n")).otherwise(zero)).alias("n_failed"),
        F.sum(F.when(F.col("bits") == F.col("bit"), F.col("n")).otherwise(zero)).alias("n_only"),
    )
