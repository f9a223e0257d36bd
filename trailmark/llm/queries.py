"""The queries of this subpackage and the SQL that gives the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from trailmark.llm import decontam, html, licenses, neardup, pieces, quality, sharding, toxicity, urls, warc


def _read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = quality.ledger(_read(spark, sf_dir, "documents").select("doc_id", "text"))
    return rows.select("record.doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", (~quality.passes("base")).alias("base_failed"), quality.passes("v1").alias("kept"), "fail_bits")


def op2_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = sharding.write_shards(_read(spark, sf_dir, "documents").select("doc_id", "text"))
    text = F.col("record.text")
    return rows.select("record.doc_id", sharding.text_bytes(text).alias("size"), F.crc32(F.coalesce(text, F.lit("")).cast("binary")).alias("text_crc32"), F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


def op3_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html.extracted(_read(spark, sf_dir, "pages"))


def op4_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = warc.write_archive(_read(spark, sf_dir, "pages"))
    return warc.read_archive(spark, path).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op5_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neardup.groups(_read(spark, sf_dir, "documents").select("doc_id", "text"), k=4).select("doc_id", "n_shingles", "component_id", "kept")


def op6_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _read(spark, sf_dir, "documents").select("doc_id", "text")
    return toxicity.scored(docs, toxicity.trained(docs, _read(spark, sf_dir, "labels")))


def op7_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scanned(_read(spark, sf_dir, "documents")).drop("spans")


def op8_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = urls.judged(_read(spark, sf_dir, "pages").select("page_id", "url"))
    return rows.select("record.page_id", "host", "path", "rule", "verdict", "score")


def op9_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = decontam.contamination(_read(spark, sf_dir, "documents").select("doc_id", "text"), _read(spark, sf_dir, "benchmark"))
    return rows.select("doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated")


def op10_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pieces.digest(pieces.encoded(_read(spark, sf_dir, "documents")))


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


OPERATORS = (
    op1_quality_rules,
    op2_sharding,
    op3_html_extraction,
    op4_warc,
    op5_minhash,
    op6_toxicity,
    op7_license_scan,
    op8_url_filter,
    op9_decontamination,
    op10_sentencepiece,
)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (*OPERATORS, pipeline)}


_OP1 = r"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w,
                  row_number() OVER () AS r FROM documents),
m AS (SELECT *, len(w)::BIGINT AS n_words, coalesce(list_sum(list_transform(w, lambda x: length(x))), 0)::BIGINT AS word_chars,
             len(regexp_extract_all(text, '[#*$%&|<>]'))::BIGINT AS n_symbols,
             list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS lines FROM d),
win AS (SELECT r, i, w[i] || ' ' || w[i + 1] || ' ' || w[i + 2] AS g FROM m, unnest(generate_series(1, n_words - 2)) AS t(i)),
twice AS (SELECT r, i FROM (SELECT r, i, count(*) OVER (PARTITION BY r, g) AS c FROM win) WHERE c > 1),
rep AS (SELECT r, count(DISTINCT i + k)::BIGINT AS n FROM twice, unnest([0, 1, 2]) AS u(k) GROUP BY r),
s AS (SELECT m.*, len(lines)::BIGINT AS n_lines, (len(lines) - len(list_distinct(lines)))::BIGINT AS n_dup_lines,
             coalesce(rep.n, 0)::BIGINT AS n_repeat_words FROM m LEFT JOIN rep USING (r)),
b AS (SELECT *, ((n_words < 50)::INT + 2 * (100 * n_repeat_words > 50 * n_words)::INT + 4 * (100 * n_symbols > 10 * word_chars)::INT
             + 8 * (word_chars > 25 * n_words)::INT + 16 * (100 * n_dup_lines > 50 * n_lines)::INT)::BIGINT AS fail_bits FROM s)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, (fail_bits & 3) > 0 AS base_failed, (fail_bits & 15) = 0 AS kept, fail_bits
FROM b"""

_OP5 = r"""
WITH RECURSIVE d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
s AS (SELECT DISTINCT doc_id, array_to_string(w[i:i + 3], ' ') AS g FROM d, unnest(generate_series(1, greatest(len(w) - 3, 1))) AS t(i) WHERE len(w) > 0),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
p AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM s a JOIN s b USING (g) WHERE a.doc_id <> b.doc_id GROUP BY ALL),
e AS (SELECT a, b FROM p JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * c >= 80 * (x.n + y.n - c)),
reach(id, c) AS (SELECT doc_id, doc_id FROM documents UNION SELECT e.a, reach.c FROM reach JOIN e ON e.b = reach.id),
least AS (SELECT id, min(c) AS c FROM reach GROUP BY id)
SELECT d.doc_id, coalesce(n.n, 0)::BIGINT AS n_shingles, least.c AS component_id, d.doc_id = least.c AS kept
FROM d JOIN least ON least.id = d.doc_id LEFT JOIN n ON n.doc_id = d.doc_id"""

_ALNUM = r"regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"

_OP9 = rf"""
WITH d AS (SELECT doc_id, row_number() OVER () AS r, {_ALNUM} AS w FROM documents),
b AS (SELECT item_id::VARCHAR AS item, {_ALNUM} AS w FROM benchmark),
bw AS (SELECT DISTINCT item, array_to_string(w[i:i + 9], ' ') AS g, len(w[i:i + 9]) AS k FROM b, unnest(generate_series(1, greatest(len(w) - 9, 1))) AS t(i) WHERE len(w) > 0),
k AS (SELECT DISTINCT k FROM bw),
dw AS (SELECT r, i, k, array_to_string(w[i:i + k - 1], ' ') AS g FROM d, k, unnest(generate_series(1, len(w) - k + 1)) AS t(i)),
hit AS (SELECT r, i, k, item FROM dw JOIN bw USING (g, k)),
n AS (SELECT r, count(DISTINCT i + j) AS n_hit FROM (SELECT DISTINCT r, i, k FROM hit), unnest(generate_series(0, k - 1)) AS u(j) GROUP BY r),
it AS (SELECT r, list_sort(list(DISTINCT item)) AS items FROM hit GROUP BY r)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(len(items), 0)::BIGINT AS n_items,
       sha256(coalesce(array_to_string(items, ','), '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN n USING (r) LEFT JOIN it USING (r)"""


_OP4 = """
WITH p AS (SELECT page_id::BIGINT AS page_id, coalesce(html, '') AS html FROM pages),
d AS (SELECT page_id, strlen(html)::BIGINT AS payload_bytes, sha256(html) AS payload_digest FROM p),
f AS (SELECT *, min(page_id) OVER (PARTITION BY payload_digest) AS least FROM d)
SELECT page_id, payload_bytes, payload_digest, CASE WHEN payload_bytes >= 100 AND page_id > least THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN payload_bytes >= 100 AND page_id > least THEN least END AS refers_to
FROM f"""


def _op8() -> str:
    """The rules, then both models order by order, the sum over each url, and the threshold."""
    fits = lambda h, p: f"((host = '{h}' OR ends_with(host, '.{h}')) AND starts_with(path, '{p}'))"
    ranked = sorted(urls.RULES, key=lambda r: -len(r[1] + r[2]))
    rule = " ".join(f"WHEN {fits(h, p)} THEN '{h}{p}'" for _, h, p in ranked)
    says = " ".join(f"WHEN {fits(h, p)} THEN '{v}'" for v, h, p in ranked)
    order, out = urls.ORDER, f"kept % {urls.FOLDS} = 0"
    parts = [
        f"""c{order} AS (SELECT g, sum(CASE WHEN ruled = 'allow' AND NOT ({out}) THEN n ELSE 0 END)::BIGINT AS a, sum(CASE WHEN ruled = 'block' AND NOT ({out}) THEN n ELSE 0 END)::BIGINT AS b FROM grams GROUP BY g)"""
    ]
    for k in range(order - 1, -1, -1):
        parts.append(f"c{k} AS (SELECT substr(g, 2) AS g, sum(a)::BIGINT AS a, sum(b)::BIGINT AS b FROM c{k + 1} GROUP BY 1)")
    share = lambda c: f"CASE WHEN n{c} + t{c} > 0 THEN (x.{c} + t{c} * l{c}) / (n{c} + t{c}) ELSE l{c} END"
    for k in range(order + 1):
        lower = f"JOIN (SELECT g AS s, pa AS la, pb AS lb FROM p{k - 1}) ON s = substr(x.g, 2)" if k else f"CROSS JOIN (SELECT {urls.FLOOR}::DOUBLE AS la, {urls.FLOOR}::DOUBLE AS lb)"
        parts.append(f"""h{k} AS (SELECT substr(g, 1, {k}) AS h, sum(a) AS na, sum(b) AS nb, count(*) FILTER (a > 0) AS ta, count(*) FILTER (b > 0) AS tb FROM c{k} GROUP BY 1),
p{k} AS (SELECT x.g, {share("a")} AS pa, {share("b")} AS pb FROM c{k} x JOIN h{k} ON h = substr(x.g, 1, {k}) {lower})""")
    between = "(ma * sb + mb * sa) / (sa + sb)"
    side = lambda v: f"(SELECT m FROM f WHERE ruled = '{v}') AS m{v[0]}, (SELECT sd FROM f WHERE ruled = '{v}') AS s{v[0]}"
    chars = " || ".join(["chr(2)"] * order)
    return f"""
WITH u AS (SELECT page_id, coalesce(url, '') AS said FROM pages),
v AS (SELECT *, translate(regexp_extract(said, '://([^/?#]*)([^?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
             regexp_extract(said, '://([^/?#]*)([^?#]*)', 2) AS path FROM u),
r AS (SELECT *, CASE {rule} END AS rule, CASE {says} END AS ruled FROM v),
d AS (SELECT said, any_value(ruled) AS ruled, count(*) AS n, ('0x' || substr(md5(said), 1, 4))::INT AS kept FROM r GROUP BY said),
grams AS (SELECT d.*, substr({chars} || said || chr(3), i::INT, {order + 1}) AS g FROM d, unnest(generate_series(1, length(said) + 1)) AS t(i)),
{", ".join(parts)},
s AS (SELECT g, CAST(round(1e6::DOUBLE * (ln(pa) - ln(pb))) AS BIGINT) AS score FROM p{order}),
z AS (SELECT said, any_value(ruled) AS ruled, any_value(n) AS n, any_value({out}) AS out, CAST(trunc(sum(score)::DOUBLE / count(*)) AS BIGINT) AS score FROM grams JOIN s USING (g) GROUP BY said),
e AS (SELECT ruled, out, sum(score::HUGEINT * n)::DOUBLE / sum(n) AS m, sum(score::HUGEINT * score * n)::DOUBLE / sum(n) AS q FROM z WHERE ruled IS NOT NULL GROUP BY ALL),
f AS (SELECT ruled, m, sqrt(greatest(q - m * m, 1e-9::DOUBLE)) AS sd FROM e WHERE out OR ruled NOT IN (SELECT ruled FROM e WHERE out)),
bound AS (SELECT CASE WHEN ma IS NULL OR mb IS NULL THEN 0 ELSE floor({between} + 0.5::DOUBLE)::BIGINT END AS b FROM (SELECT {side("allow")}, {side("block")}))
SELECT page_id, host, path, rule, score, coalesce(r.ruled, CASE WHEN score >= b THEN 'allow' ELSE 'block' END) AS verdict
FROM r JOIN z USING (said) CROSS JOIN bound"""


def oracle_sql() -> dict[str, str]:
    return {"op1_quality_rules": _OP1, "op4_warc": _OP4, "op8_url_filter": _op8(), "op5_minhash": _OP5, "op9_decontamination": _OP9}
