"""URL filter: rules first, then the ratio of two character language models.

Every url that a rule decides trains a model, the allowed ones the model of
accepted urls, the blocked ones that of rejected urls: characters after up to
``order`` others, each order smoothed into the next shorter one by the number
of its distinct successors (Witten-Bell). A url without a rule is judged by
the difference of its log-likelihoods under both models, divided by its length,
against a threshold that lies between the two classes. One in ``FOLDS`` urls with a
rule, chosen by a digest of the url, trains no model and calibrates the threshold; a
class that has none calibrates on its training urls.

Scores are summed in millionths as integers, so that no order of summation
changes a verdict. The models see whole urls, scheme, query and fragment
included; the rules see host and path. Defined cases: a null url, or one
without ``://``, has an empty host and path and no rule; a null url is judged
as an empty string; without training urls all scores are 0 and the threshold is 0, which allows; repeated
rows get equal verdicts. Equal urls are scored once, so a hot url costs one row.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from trailmark.llm.shared import written
from trailmark.llm.text import UPPER

#: Verdict, host, path.
RULES = (
    ("allow", "com", "/"),
    ("block", "example.com", "/en/"),
    ("allow", "www.example.com", "/en/"),
    ("block", "net", "/es/"),
    ("block", "net", "/fr/"),
)
ORDER = 4
#: Stands before the first and behind the last character of a url; neither is a character of one.
START, STOP = "\u0002", "\u0003"
#: The shortest model gives each character at least this share.
FLOOR = 1 / 1024
#: Grams whose scores are broadcast; more are joined by shuffle. The other joins leave the choice to
#: Spark, which broadcasts a side only if its measured size is below spark.sql.autoBroadcastJoinThreshold.
BLOCK = 300_000
#: One in so many urls is kept out of training.
FOLDS = 5


def host_and_path(url: Column) -> tuple[Column, Column]:
    part = r"://([^/?#]*)([^?#]*)"
    url = F.coalesce(url, F.lit(""))
    return F.translate(F.regexp_extract(url, part, 1), UPPER, UPPER.lower()), F.regexp_extract(url, part, 2)


def rule_of(host: Column, path: Column, rules=RULES) -> tuple[Column, Column]:
    """The longest rule that fits (ties: the first by name) and its verdict; null if none fits."""
    rule = verdict = F.lit(None).cast("string")
    for says, h, p in sorted(rules, key=lambda r: (len(r[1] + r[2]), [-ord(c) for c in r[1] + r[2]])):
        fits = ((host == h) | host.endswith("." + h)) & path.startswith(p)
        rule, verdict = F.when(fits, F.lit(h + p)).otherwise(rule), F.when(fits, F.lit(says)).otherwise(verdict)
    return rule, verdict


def _grams(rows: DataFrame, order: int) -> DataFrame:
    """The columns of ``rows`` and ``g``: each character of ``said`` with the ``order`` before it."""
    chars = F.concat(F.array_repeat(F.lit(START), order), F.array_remove(F.split("said", ""), ""), F.array(F.lit(STOP)))
    keep = rows.columns
    rows = rows.withColumn("chars", chars)
    spots = rows.select(*keep, "chars", F.explode(F.sequence(F.lit(1), F.size("chars") - order)).alias("i"))
    return spots.select(*keep, F.array_join(F.slice("chars", F.col("i"), order + 1), "").alias("g"))


def gram_scores(urls: DataFrame, order: int = ORDER) -> DataFrame:
    """``g`` and ``score``: millionths of log P(last character | the others), accepted minus rejected.

    ``urls`` has ``said``, ``verdict`` (null for none) and ``n``, the rows with this url.
    Every gram of every url gets a score; counts come from those with a verdict.
    """
    zero = F.lit(0).cast("bigint")
    rows = urls.select("said", F.when(F.col("verdict") == "allow", F.col("n")).otherwise(zero).alias("a"), F.when(F.col("verdict") == "block", F.col("n")).otherwise(zero).alias("b"))
    counts = [written(_grams(rows, order).groupBy("g").agg(F.sum("a").alias("a"), F.sum("b").alias("b")), "grams")]
    for _ in range(order):  # each shorter order from the one before
        longer = counts[-1]
        counts.append(longer.groupBy(F.expr("substring(g, 2)").alias("g")).agg(F.sum("a").alias("a"), F.sum("b").alias("b")))
    lower = None
    for k, table in enumerate(reversed(counts)):
        head = F.expr("left(g, length(g) - 1)") if k else F.lit("")
        kinds = [F.sum(F.when(F.col(c) > 0, 1).otherwise(0)).alias(f"t{c}") for c in "ab"]
        totals = table.groupBy(head.alias("h")).agg(F.sum("a").alias("na"), F.sum("b").alias("nb"), *kinds)
        rows = table.withColumn("h", head).join(totals, "h")
        if lower is None:
            rows = rows.withColumns({"la": F.lit(FLOOR), "lb": F.lit(FLOOR)})
        else:
            rows = rows.withColumn("s", F.expr("substring(g, 2)")).join(lower.select(F.col("g").alias("s"), F.col("pa").alias("la"), F.col("pb").alias("lb")), "s")

        def p(c: str) -> Column:
            seen = F.col(f"n{c}") + F.col(f"t{c}")
            return F.when(seen > 0, (F.col(c) + F.col(f"t{c}") * F.col(f"l{c}")) / seen).otherwise(F.col(f"l{c}"))

        lower = rows.select("g", p("a").alias("pa"), p("b").alias("pb"))
    return lower.select("g", F.round(F.lit(1e6) * (F.log("pa") - F.log("pb"))).cast("bigint").alias("score"))


def kept_out(said: Column) -> Column:
    """Whether a url calibrates: by the first 16 bits of its MD5."""
    return F.conv(F.left(F.md5(said), F.lit(4)), 16, 10).cast("int") % FOLDS == 0


def judged(pages: DataFrame, rules=RULES, order: int = ORDER) -> DataFrame:
    """``record``, host, path, rule, ``score`` (millionths a character) and ``verdict`` of each row of ``pages``."""
    rows = pages.select(F.struct("*").alias("record"))
    host, path = host_and_path(F.col("record.url"))
    rows = rows.withColumns({"host": host, "path": path})
    rule, verdict = rule_of(F.col("host"), F.col("path"), rules)
    rows = rows.withColumns({"rule": rule, "ruled": verdict, "said": F.coalesce("record.url", F.lit(""))})
    # equal urls have the same rule
    urls = written(rows.groupBy("said").agg(F.first("ruled").alias("verdict"), F.count("*").alias("n")), "urls")
    training = urls.withColumn("verdict", F.when(~kept_out(F.col("said")), F.col("verdict")))
    scores = written(gram_scores(training, order), "scores")
    few = scores.count() <= BLOCK
    grams = _grams(urls, order).join(F.broadcast(scores) if few else scores, "g")
    scored = grams.groupBy("said", "verdict", "n").agg(F.expr("sum(score) div count(*)").alias("score"))
    scored = written(scored, "scored")
    x, n = F.col("score").cast("decimal(38,0)"), F.col("n")
    stats = scored.where("verdict is not null").groupBy("verdict", kept_out(F.col("said")).alias("out")).agg(F.sum(n).alias("n"), F.sum(x * n).alias("s"), F.sum(x * x * n).alias("q")).collect()  # four rows
    at = {}
    for r in sorted(stats, key=lambda r: r.out):  # those kept out, if there are any
        mean = float(r.s) / r.n
        at[r.verdict] = mean, max(float(r.q) / r.n - mean * mean, 1e-9) ** 0.5
    (ma, sa), (mb, sb) = at.get("allow", (0.0, 1.0)), at.get("block", (0.0, 1.0))
    bound = math.floor((ma * sb + mb * sa) / (sa + sb) + 0.5) if len(at) == 2 else 0
    model = F.when(F.col("score") >= bound, "allow").otherwise("block")
    return rows.join(scored.select("said", "score"), "said").select("record", "host", "path", "rule", "score", F.coalesce("ruled", model).alias("verdict"))
