"""Label ids, category and intent classifiers and their scores."""

from __future__ import annotations

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import LogisticRegression, RandomForestClassifier
from pyspark.ml.feature import HashingTF, IDF, RegexTokenizer, StringIndexer, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame, Window, functions as F

from supportlens import constants as C
from supportlens.operators.filters import split_train_test
from supportlens.operators.profile import standardize
from supportlens.session import materialize


def label_index(df: DataFrame, column: str) -> DataFrame:
    """Labels with ids in alphabetical order.

    Labels are sorted in ranges; an id is the position in its range plus the size of
    the ranges before it. The ranges are stored, since both steps must see the same.
    """
    labels = df.select(F.col(column).alias("label")).where("label IS NOT NULL").distinct()
    ranged = labels.repartitionByRange("label").sortWithinPartitions("label")
    position = F.monotonically_increasing_id().bitwiseAND((1 << 33) - 1)
    stored = materialize(
        ranged.select("label", F.spark_partition_id().alias("part"), position.alias("position")), "labels"
    )
    sizes = stored.groupBy("part").agg(F.count("*").alias("size"))
    # One row per range.
    before = F.sum("size").over(Window.orderBy("part")) - F.col("size")
    offsets = sizes.select("part", before.alias("offset"))
    return stored.join(offsets, "part").select(
        "label", (F.col("offset") + F.col("position")).alias("class_id")
    )


def with_label_id(df: DataFrame, column: str) -> DataFrame:
    """Add ``<column>_id``; ids come from the whole table, not from a batch of it."""
    ids = label_index(df, column).select(
        F.col("label").alias(column), F.col("class_id").alias(f"{column}_id")
    )
    return df.join(ids, column, "left")


def scale_features(df: DataFrame, columns: list[str]) -> DataFrame:
    return standardize(df, columns)


def train_category_forest(
    df: DataFrame, id_column: str, features: list[str], target: str, trees: int = 100
) -> tuple[PipelineModel, DataFrame]:
    """Random forest on 80 % of the rows; returns the model and the scored other 20 %."""
    split = split_train_test(df, id_column)
    stages = [
        StringIndexer(inputCol=target, outputCol="class_id", stringOrderType="alphabetAsc"),
        VectorAssembler(inputCols=features, outputCol="features"),
        RandomForestClassifier(
            featuresCol="features", labelCol="class_id", numTrees=trees, seed=C.SEED
        ),
    ]
    stages[0] = stages[0].fit(df)
    model = Pipeline(stages=stages).fit(split.where("split = 'train'"))
    return model, model.transform(split.where("split = 'test'"))


def feature_importance(model: PipelineModel, features: list[str], like: DataFrame) -> DataFrame:
    """Importance per feature, largest first; one row per feature."""
    values = model.stages[-1].featureImportances.toArray()
    rows = [(name, float(value)) for name, value in zip(features, values)]
    return like.sparkSession.createDataFrame(rows, "feature STRING, importance DOUBLE").orderBy(
        F.desc("importance"), "feature"
    )


def sort_importance(table: DataFrame, name: str = "feature", value: str = "importance") -> DataFrame:
    """A table of importances with ranks, the largest first; equal ones go by name, missing ones come last."""
    order = Window.orderBy(F.desc_nulls_last(value), name)
    # One row per feature of a model.
    return table.withColumn("rank", F.row_number().over(order))


def train_intent_classifier(
    df: DataFrame, id_column: str, text: str, target: str, hashes: int = 1 << 12, iterations: int = 20
) -> tuple[PipelineModel, DataFrame]:
    """Text to intent: hashed TF-IDF and a logistic regression; returns the model and all rows scored.

    Texts are hashed once and stored as sparse counts; training and scoring read only those. The
    scored rows have ``split``, of which 'test' was held out. The returned model starts from the
    texts again.
    """
    tokens = RegexTokenizer(inputCol=text, outputCol="_tokens", pattern=r"[^\p{L}\p{N}_]+")
    hashing = HashingTF(inputCol="_tokens", outputCol="_counts", numFeatures=hashes)
    split = split_train_test(df, id_column)
    counts = materialize(
        hashing.transform(tokens.transform(split)).select(id_column, target, "split", "_counts"),
        "intent-counts",
    )
    indexer = StringIndexer(
        inputCol=target, outputCol="class_id", stringOrderType="alphabetAsc"
    ).fit(counts)
    stages = [
        IDF(inputCol="_counts", outputCol="features"),
        LogisticRegression(
            featuresCol="features", labelCol="class_id", maxIter=iterations, regParam=0.01
        ),
    ]
    fitted = Pipeline(stages=[indexer, *stages]).fit(counts.where("split = 'train'"))
    model = PipelineModel([indexer, tokens, hashing, *fitted.stages[1:]])
    return model, fitted.transform(counts)


def score_labels(scored: DataFrame, model: PipelineModel, id_column: str, target: str) -> DataFrame:
    """Actual label, most probable label and its probability per scored row."""
    labels = F.array(*[F.lit(label) for label in model.stages[0].labels])
    probabilities = vector_to_array("probability")
    return scored.select(
        id_column,
        F.col(target).alias("actual"),
        F.element_at(labels, (F.col("prediction") + 1).cast("int")).alias("predicted"),
        F.array_max(probabilities).alias("confidence"),
        probabilities.alias("probabilities"),
    )
