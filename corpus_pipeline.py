"""The corpus pipeline: judge, deduplicate, mix and pack documents, stage by stage."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from supportlens.llm.exact_dedup import keep_one_copy
from supportlens.llm.mixing import mixed_rows
from supportlens.llm.near_dedup import keep_one_of_each
from supportlens.llm.packing import pack
from supportlens.llm.quality import keep_good
from supportlens.llm.queries import vocabulary
from supportlens.session import apply_settings, materialize, remove_folder, work_folder, work_scope


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    apply_settings(spark)
    return keep_good(docs)


def exact_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    apply_settings(spark)
    return keep_one_copy(docs)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    apply_settings(spark)
    return keep_one_of_each(docs)


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    apply_settings(spark)
    return mixed_rows(docs)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    apply_settings(spark)
    return pack(docs, vocabulary())


STAGES = [
    ("quality rules", quality_rules),
    ("exact dedup", exact_dedup),
    ("near dedup", near_dedup),
    ("mixing", mixing),
    ("packing", packing),
]
#: The fitted vote model, the signatures and the token ids have no SQL form.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Apply the stages to ``documents``; each result is written and read again.

    What a stage wrote for itself is deleted when its result is written, and that when the
    next one's is; the last result stays in the shared folder.
    """
    docs, before = spark.read.parquet(f"{sf_dir}/documents.parquet"), None
    for name, stage in STAGES:
        name = name.replace(" ", "-")
        path = work_folder(spark, name)
        with work_scope(spark):
            docs = materialize(stage(spark, docs, sf_dir), name, path)
        if before:
            remove_folder(spark, before)
        before = path
    return docs
