"""The corpus pipeline: each stage calls one operator on what its predecessor kept."""

from __future__ import annotations

import os
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from graphloom.llm import decontamination, mixing, near_dedup, pii, quality
from graphloom.llm.common import ensure_checkpoint_dir, table, with_text

#: Documents below this score are rejected.
QUALITY = 0.7


def _same_columns(out: DataFrame, docs: DataFrame) -> DataFrame:
    """``docs``' columns, with the length column, where there is one, made to fit the text again."""
    if "n_chars" in docs.columns and "text" in docs.columns:
        out = out.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType))
    return out.select(*docs.columns)


def quality_classifier(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rejects documents that the classifier finds to be of low quality."""
    scored = quality.score(docs, table(spark, sf_dir, "labels").select("doc_id", "quality")).where(F.col("score") >= QUALITY)
    return scored.select(*with_text(docs, "row", "text", F.col("text").cast("string")))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates stays, the one with the smallest id.

    Of rows with one id and one text, one stays, whether the id is null or not; rows with a null id and
    different texts all stay, and so do null, empty and wordless texts with ids of their own.
    """
    linked = near_dedup.cut(near_dedup.link(docs))
    gone = linked.where(~F.col("kept")).select("doc_id").distinct()
    out = docs.join(gone, "doc_id", "left_anti").select(*docs.columns)
    twice = linked.groupBy("doc_id").count().where("count > 1")  # where no id stands twice there is nothing to drop
    return out if twice.isEmpty() else out.dropDuplicates(["doc_id", "text"])


def benchmark_decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Cuts benchmark passages from the texts."""
    return _same_columns(decontamination.remove(docs, table(spark, sf_dir, "benchmark").select("item_id", "text")), docs)


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Replaces personal data by its kind in brackets."""
    return _same_columns(pii.redact(docs), docs)


def source_mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents that meet the sources' target weights, with the number of times each is taken."""
    return mixing.apply_mix(docs)


STAGES = [
    ("quality classifier", quality_classifier),
    ("MinHash near-dedup", near_duplicates),
    ("benchmark decontamination", benchmark_decontamination),
    ("PII", personal_data),
    ("mixing sources to target weights", source_mix),
]

#: SQL can express neither the classifier nor the forest; the tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; each stage's rows are written to the shared folder and read back by the next."""
    ensure_checkpoint_dir(spark)
    home = os.path.join(spark.sparkContext._jsc.sc().getCheckpointDir().get(), f"pipeline-{uuid.uuid4().hex}")
    docs = table(spark, sf_dir, "documents")
    for k, (_, stage) in enumerate(STAGES):
        stage(spark, docs, sf_dir).write.parquet(f"{home}/{k}")
        docs = spark.read.parquet(f"{home}/{k}")
    return docs
