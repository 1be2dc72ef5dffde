"""Readers with fixed schemas. Convert large inputs to parquet after the first read:
multi-line CSV and JSON files cannot be split."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession, functions as F, types as T

from supportlens import schemas as S

CORRUPT = "_corrupt_record"


def read_qa_csv(spark: SparkSession, path: str, schema: T.StructType = S.QA_CSV) -> DataFrame:
    """CSV with a header; quoted fields may hold commas, quotes and line breaks."""
    return spark.read.csv(
        path, schema=schema, header=True, multiLine=True, quote='"', escape='"',
        ignoreLeadingWhiteSpace=False, ignoreTrailingWhiteSpace=False,
    )


def latest_dataset(spark: SparkSession, folder: str, prefix: str) -> str:
    """Path of the file or folder under ``folder`` whose name is the last one starting with ``prefix``.

    Only file names are read. Raises FileNotFoundError when there is none.
    """
    pattern = rf"^(.*/({re.escape(prefix)}[^/]*))(/[^/]+)?$"
    try:
        files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(folder)
        name = F.regexp_extract("path", pattern, 2)
        last = (
            files.where(name != "").agg(F.max(F.struct(name, F.regexp_extract("path", pattern, 1)))).first()[0]
        )
    except Exception as error:
        if "PATH_NOT_FOUND" not in str(error):
            raise
        last = None
    if last is None:
        raise FileNotFoundError(f"no {prefix}* under {folder}")
    return last[1]


def read_latest_csv(spark: SparkSession, folder: str, prefix: str = "combined_data_") -> DataFrame:
    return read_qa_csv(spark, latest_dataset(spark, folder, prefix))


def read_json_records(
    spark: SparkSession, path: str, schema: T.StructType = S.INSTRUCTION, array: bool = False
) -> DataFrame:
    """JSON records, one per line, or files holding one array of records each."""
    return spark.read.json(path, schema=schema, multiLine=array)


def _grouped(spark: SparkSession, path: str, schema: T.MapType, whole: bool) -> DataFrame:
    lines = spark.read.text(path, wholetext=whole)
    parsed = lines.select(F.explode(F.from_json("value", schema)).alias("group", "items"))
    return parsed.select("group", F.explode("items").alias("item"))


def read_grouped_qa(spark: SparkSession, path: str, whole: bool = False) -> DataFrame:
    """Objects category -> list of pairs, one object per line (or per file), as rows."""
    return _grouped(spark, path, S.GROUPED_QA, whole).select(
        F.col("group").alias("category"),
        "item.question",
        "item.answer",
        F.coalesce("item.metadata.source", F.lit("unknown")).alias("source"),
        F.coalesce("item.metadata.entities", F.array().cast("array<string>")).alias("entities"),
    )


def read_grouped_instructions(spark: SparkSession, path: str, whole: bool = False) -> DataFrame:
    """Objects intent -> list of instructions, as rows."""
    return _grouped(spark, path, S.GROUPED_INSTRUCTIONS, whole).select(
        F.col("group").alias("intent"), F.col("item").alias("instruction")
    )


def read_feedback(spark: SparkSession, path: str, array: bool = False) -> DataFrame:
    """Feedback files; corrupt records and those without a rating are skipped.

    The text may be named ``comment`` or ``comments``.
    """
    schema = T.StructType(S.FEEDBACK.fields + [T.StructField(CORRUPT, T.StringType())])
    records = spark.read.json(
        path, schema=schema, mode="PERMISSIVE", columnNameOfCorruptRecord=CORRUPT, multiLine=array
    )
    return (
        records.where(F.col(CORRUPT).isNull() & F.col("rating").isNotNull())
        .withColumn("comment", F.coalesce("comment", "comments"))
        .drop(CORRUPT, "comments")
    )
