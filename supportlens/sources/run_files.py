"""Result files of training runs: one nested object each, with a list per measure."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F, types as T

#: Measures of a run and the lists that hold them, one entry per epoch; fixed names of the files.
MEASURES = ("training_loss", "validation_loss", "training_accuracy", "validation_accuracy")
RUN = T.StructType(
    [T.StructField("run_id", T.StringType())]
    + [T.StructField(f"{name}_history", T.ArrayType(T.DoubleType())) for name in MEASURES]
    + [
        T.StructField("class_names", T.ArrayType(T.StringType())),
        T.StructField("confusion_matrix", T.ArrayType(T.ArrayType(T.LongType()))),
        T.StructField(
            "performance_metrics",
            T.StructType([T.StructField("confusion_matrix", T.ArrayType(T.ArrayType(T.LongType())))]),
        ),
    ]
)


def read_runs(spark: SparkSession, path: str, whole: bool = True) -> DataFrame:
    """Result files, one object per file, or per line; a run without a name takes its file's.

    The matrix may stand at the top or under ``performance_metrics``; classes without names are numbered.
    """
    runs = spark.read.json(path, schema=RUN, multiLine=whole)
    matrix = F.coalesce("confusion_matrix", "performance_metrics.confusion_matrix")
    named = F.coalesce("run_id", F.regexp_extract(F.col("_metadata.file_name"), r"^(.*?)(\.json)?$", 1))
    numbers = F.transform(matrix, lambda row, i: i.cast("string"))
    return runs.select(
        named.alias("run_id"),
        *[f"{name}_history" for name in MEASURES],
        F.coalesce("class_names", numbers).alias("class_names"),
        matrix.alias("confusion_matrix"),
    )


def histories(runs: DataFrame) -> DataFrame:
    """A row per run and epoch, from 1; lists that are shorter, or missing, end in nulls."""
    epochs = F.arrays_zip(*[F.coalesce(f"{name}_history", F.array().cast("array<double>")).alias(name) for name in MEASURES])
    rows = runs.select("run_id", F.posexplode(epochs).alias("place", "row"))
    return rows.select(
        "run_id", (F.col("place") + 1).alias("epoch"), *[F.col("row").getField(name).alias(name) for name in MEASURES]
    )


def confusions(runs: DataFrame) -> DataFrame:
    """Matrices as run_id, actual, predicted and n, zeros included; a row is an actual label."""
    cells = runs.select("run_id", "class_names", F.posexplode("confusion_matrix").alias("row", "counts"))
    label = lambda place: F.get("class_names", F.col(place))
    return cells.select("run_id", "class_names", "row", F.posexplode("counts").alias("column", "n")).select(
        "run_id", label("row").alias("actual"), label("column").alias("predicted"), "n"
    )
