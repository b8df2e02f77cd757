"""The corpus pipeline: quality classifier, quality rules, near-duplicate removal, packing.

Each stage takes (spark, docs, sf_dir), works on all that its predecessor kept and returns a DataFrame, which is written
as Parquet and reread as the next stage's ``docs``; all but the last return the columns of ``documents``.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ordinata.llm import minmax_dedup, packing, quality_model, quality_rules
from ordinata.llm.workspace import materialize


def classify(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose quality score reaches 0.5; the model is learnt from all labelled documents outside the held-out third."""
    described = materialize(quality_model.describe(docs), "pipeline-statistics")
    model = quality_model.fit_on_labels(described, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    scored = quality_model.with_score(docs, model, out_col="quality_score__")
    return scored.where(F.col("quality_score__") >= 0.5).select(*docs.columns)


def apply_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that every rule of the table accepts; short documents are judged by the rules that suit them."""
    judged = quality_rules.judge(docs, out_col="quality_rules__", min_words=1)
    return judged.where("quality_rules__.kept").select(*docs.columns)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates: shingles of five words, similarity of 0.8 or more."""
    dropped = minmax_dedup.near_duplicates(docs, shingle=5, percent=80).where(~F.col("kept")).select("doc_id")
    return docs.join(dropped.distinct(), "doc_id", "left_anti").select(*docs.columns)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of 2048-token sequences."""
    return packing.pack(docs, public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)


STAGES = [("quality_classifier", classify), ("quality_rules", apply_rules), ("near_duplicates", drop_near_duplicates), ("packing", pack)]

#: SQL can express neither the classifier's fit nor the packing.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``, each written and reread."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
