"""From raw documents to training tokens, in stages that each read what the one before wrote.

Every stage but the last returns the columns of documents, whatever they are called. Defined cases:
null and empty texts fail the quality rules; a null doc_id passes every stage that keeps its text; of
repeated rows and near copies one row stays; a document with a benchmark window goes whole; without
documents there are no rows, without labels the fixed insults decide, without a benchmark nothing is a leak.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from trailmark.llm import decontam, neardup, pieces, quality, toxicity
from trailmark.llm.shared import written


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    scorer = toxicity.trained(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return toxicity.harmless(docs, scorer)


def apply_quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return quality.accepted(docs, "v1")


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return neardup.deduplicated(docs, k=5, percent=80)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return decontam.clean(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return pieces.digest(pieces.encoded(docs))


STAGES = (
    ("toxicity", drop_toxic),
    ("quality rules", apply_quality_rules),
    ("near duplicates", drop_near_duplicates),
    ("decontamination", decontaminate),
    ("sentencepiece", encode),
)

#: A learned classifier decides in the first stage, which SQL can't express.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for i, (_, stage) in enumerate(STAGES):
        docs = written(stage(spark, docs, sf_dir), f"stage{i}")
    return docs
