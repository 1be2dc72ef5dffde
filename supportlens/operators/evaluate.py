"""Metrics from a table with an actual and a predicted label per row."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F


def _counts(df: DataFrame, actual: str, predicted: str, n: str | None = None) -> DataFrame:
    """Rows per pair of labels; ``n`` names a column that counts them already."""
    rows = F.count("*") if n is None else F.sum(n)
    return df.groupBy(F.col(actual).alias("actual"), F.col(predicted).alias("predicted")).agg(rows.alias("n"))


def confusion_matrix(
    df: DataFrame, actual: str = "actual", predicted: str = "predicted"
) -> DataFrame:
    """Rows per (actual, predicted) label, zeros included."""
    counts = _counts(df, actual, predicted)
    labels = counts.select(F.explode(F.array("actual", "predicted")).alias("actual")).distinct()
    # The label vocabulary fits one row; the table has a cell per label pair by definition.
    vocabulary = labels.agg(F.collect_set("actual")).scalar()
    cells = labels.select("actual", F.explode(vocabulary).alias("predicted"))
    return cells.join(counts, ["actual", "predicted"], "left").fillna(0, ["n"])


def label_counts(df: DataFrame, actual: str = "actual", predicted: str = "predicted", n: str | None = None) -> DataFrame:
    """Per label: support, predicted rows and correct rows."""
    sides = F.array(
        F.struct(F.col("actual").alias("label"), F.col("n").alias("support"), F.lit(0).alias("named")),
        F.struct(F.col("predicted").alias("label"), F.lit(0).alias("support"), F.col("n").alias("named")),
    )
    hit = F.when(F.col("actual") == F.col("predicted"), F.col("n")).otherwise(0)
    return (
        _counts(df, actual, predicted, n)
        .select(hit.alias("hits"), F.inline(sides))
        .groupBy("label")
        .agg(
            F.sum("support").alias("support"),
            F.sum("named").alias("named"),
            F.sum(F.when(F.col("support") > 0, F.col("hits")).otherwise(0)).alias("hits"),
        )
    )


def _zero(value: Column) -> Column:
    return F.coalesce(value, F.lit(0.0))


def _scores(labels: DataFrame) -> DataFrame:
    precision = _zero(F.try_divide(F.col("hits"), F.col("named")))
    recall = _zero(F.try_divide(F.col("hits"), F.col("support")))
    return labels.withColumns({"precision": precision, "recall": recall}).withColumn(
        "f1",
        _zero(
            F.try_divide(
                2.0 * F.col("precision") * F.col("recall"), F.col("precision") + F.col("recall")
            )
        ),
    )


def weighted_metrics(df: DataFrame, actual: str = "actual", predicted: str = "predicted", n: str | None = None) -> DataFrame:
    """Accuracy and support-weighted precision, recall and F1 in one row; ``n`` counts the rows of a matrix."""

    def weighted(column: str) -> Column:
        return F.round(F.sum(F.col(column) * F.col("support")) / F.sum("support"), 6).alias(column)

    return _scores(label_counts(df, actual, predicted, n)).agg(
        F.round(F.sum("hits") / F.sum("support"), 6).alias("accuracy"),
        weighted("precision"),
        weighted("recall"),
        weighted("f1"),
    )


def class_report(df: DataFrame, actual: str = "actual", predicted: str = "predicted") -> DataFrame:
    """Scores and support per label, then their macro and weighted averages."""
    scores = _scores(label_counts(df, actual, predicted))
    names = ("precision", "recall", "f1")
    per_label = scores.select("label", *[F.round(c, 6).alias(c) for c in names], "support")
    macro = scores.agg(
        *[F.round(F.avg(c), 6).alias(c) for c in names], F.sum("support").alias("support")
    )
    weighted = scores.agg(
        *[F.round(F.sum(F.col(c) * F.col("support")) / F.sum("support"), 6).alias(c) for c in names],
        F.sum("support").alias("support"),
    )
    return per_label.unionByName(macro.select(F.lit("macro avg").alias("label"), "*")).unionByName(
        weighted.select(F.lit("weighted avg").alias("label"), "*")
    )


def top_labels(scores: DataFrame, id_column: str, probabilities: str, n: int = 3) -> DataFrame:
    """The ``n`` most probable class ids per row, from an array of probabilities.

    Sorting the array inside the row needs no shuffle.
    """
    indexed = F.transform(
        F.col(probabilities), lambda p, i: F.struct((-p).alias("minus_p"), i.alias("class_id"))
    )
    best = F.slice(F.array_sort(indexed), 1, n)
    return scores.select(id_column, F.posexplode(best).alias("pos", "best")).select(
        id_column,
        (F.col("pos") + 1).alias("rank"),
        F.col("best.class_id").alias("class_id"),
        (-F.col("best.minus_p")).alias("confidence"),
    )
