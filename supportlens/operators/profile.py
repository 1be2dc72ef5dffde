"""Data-quality profile: missing values, duplicates, outliers, scaling, class balance.

Statistics of all columns come from one aggregation. They reach the driver as one
row, so that the row-wise steps use plain literals and need no join.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from supportlens import constants as C
from supportlens.operators.aggregates import as_rows
from supportlens.operators.quantiles import exact_quantiles, number, numeric_columns, text_columns
from supportlens.session import materialize


def missing_stats(df: DataFrame) -> DataFrame:
    """Null count and percent per column."""
    counts = df.agg(
        F.count("*").alias("_rows"),
        *[F.count_if(F.col(c).isNull()).alias(f"_{i}") for i, c in enumerate(df.columns)],
    )
    return as_rows(
        counts,
        [
            F.struct(
                F.lit(c).alias("column"),
                F.col(f"_{i}").alias("missing"),
                F.round(F.try_divide(F.col(f"_{i}") * 100.0, F.col("_rows")), 6).alias("percent"),
            )
            for i, c in enumerate(df.columns)
        ],
    )


def drop_sparse_columns(df: DataFrame, percent: float = C.SPARSE_PERCENT) -> DataFrame:
    """Drop columns with more than ``percent`` nulls."""
    sparse = [r["column"] for r in missing_stats(df).where(F.col("percent") > percent).collect()]
    return df.drop(*sparse)


def _columns_with_nulls(df: DataFrame) -> list[str]:
    return [r["column"] for r in missing_stats(df).where(F.col("missing") > 0).collect()]


def fill_median(df: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """Replace nulls of numeric columns by the exact median."""
    if columns is None:
        gaps = _columns_with_nulls(df)
        columns = [c for c in numeric_columns(df) if c in gaps]
    medians = exact_quantiles(df, columns, [0.5]) if columns else {}
    return df.withColumns(
        {c: F.coalesce(number(df, c), F.lit(medians[c][0.5])) for c in columns}
    )


def modes(df: DataFrame, columns: list[str]) -> DataFrame:
    """Most frequent non-null value per text column, the smallest one on ties."""
    items = F.array(
        *[F.struct(F.lit(c).alias("column"), F.col(c).alias("value")) for c in columns]
    )
    counts = (
        df.select(F.inline(items))
        .where(F.col("value").isNotNull())
        .groupBy("column", "value")
        .agg(F.count("*").alias("n"))
    )
    best = F.min(F.struct((-F.col("n")).alias("minus_n"), F.col("value").alias("value")))
    return counts.groupBy("column").agg(best.alias("best")).select(
        "column", F.col("best.value").alias("mode"), (-F.col("best.minus_n")).alias("n")
    )


def fill_mode(df: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """Replace nulls of text columns by the most frequent value."""
    if columns is None:
        gaps = _columns_with_nulls(df)
        columns = [c for c in text_columns(df) if c in gaps]
    if not columns:
        return df
    found = {r["column"]: r["mode"] for r in modes(df, columns).collect()}
    return df.withColumns(
        {c: F.coalesce(c, F.lit(found[c])) for c in columns if c in found}
    )


def duplicate_count(df: DataFrame) -> DataFrame:
    """Rows, distinct rows and their difference."""
    copies = df.groupBy(*df.columns).agg(F.count("*").alias("_copies"))
    return copies.agg(
        F.coalesce(F.sum("_copies"), F.lit(0)).alias("total_records"),
        F.count("*").alias("distinct_records"),
        F.coalesce(F.sum(F.col("_copies") - 1), F.lit(0)).alias("duplicate_records"),
    )


def iqr_bounds(df: DataFrame, columns: list[str]) -> dict[str, tuple[float, float, float, float]]:
    """Per column (q1, q3, lower bound, upper bound); columns without values are left out."""
    found = exact_quantiles(df, columns, [0.25, 0.75])
    bounds = {}
    for column in columns:
        q1, q3 = found[column][0.25], found[column][0.75]
        if q1 is not None:
            reach = C.IQR_FACTOR * (q3 - q1)
            bounds[column] = (q1, q3, q1 - reach, q3 + reach)
    return bounds


def iqr_table(df: DataFrame, columns: list[str]) -> DataFrame:
    rows = [(c, *values) for c, values in iqr_bounds(df, columns).items()]
    return df.sparkSession.createDataFrame(
        rows, "`column` STRING, q1 DOUBLE, q3 DOUBLE, lower DOUBLE, upper DOUBLE"
    )


def outlier_count(df: DataFrame, columns: list[str]) -> DataFrame:
    """Values outside the IQR bounds per column."""
    bounds = iqr_bounds(df, columns)
    counts = df.agg(
        *[
            F.count_if(~number(df, c).between(low, high)).alias(c)
            for c, (_, _, low, high) in bounds.items()
        ]
    )
    return as_rows(
        counts,
        [F.struct(F.lit(c).alias("column"), F.col(c).alias("outliers")) for c in bounds],
    )


def clip_outliers(df: DataFrame, columns: list[str]) -> DataFrame:
    """Clamp values to the IQR bounds; nulls stay null."""
    clipped = {}
    for column, (_, _, low, high) in iqr_bounds(df, columns).items():
        value = number(df, column)
        clipped[column] = F.when(
            value.isNotNull(), F.greatest(F.lit(low), F.least(F.lit(high), value))
        )
    return df.withColumns(clipped)


def scaling_stats(df: DataFrame, columns: list[str]) -> DataFrame:
    """Mean, population deviation, minimum and maximum per column."""
    stats = df.agg(
        *[
            F.struct(
                F.lit(c).alias("column"),
                F.avg(number(df, c)).alias("mean"),
                F.stddev_pop(number(df, c)).alias("scale"),
                F.min(number(df, c)).alias("min"),
                F.max(number(df, c)).alias("max"),
            ).alias(f"_{i}")
            for i, c in enumerate(columns)
        ]
    )
    return as_rows(stats, [F.col(f"_{i}") for i in range(len(columns))])


def standardize(df: DataFrame, columns: list[str], minmax: bool = False) -> DataFrame:
    """(x - mean) / population deviation, 0 for a constant column.

    With ``minmax`` also add ``<column>_minmax`` in 0..1, again 0 when constant.
    """
    scaled = {}
    for row in scaling_stats(df, columns).collect():
        value = number(df, row["column"])
        # The mean of equal values may be off by a rounding, so a constant is told by its range.
        constant = value * 0.0
        varies = row["min"] is not None and row["min"] != row["max"] and row["scale"]
        scaled[row["column"]] = (value - F.lit(row["mean"])) / F.lit(row["scale"]) if varies else constant
        if minmax:
            width = (row["max"] or 0.0) - (row["min"] or 0.0)
            shifted = value - F.lit(row["min"])
            scaled[f"{row['column']}_minmax"] = shifted / F.lit(width) if width else constant
    return df.withColumns(scaled)


def class_balance(df: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """Largest and smallest class of every text column, in percent of all rows."""
    columns = columns or text_columns(df)
    items = F.array(
        *[F.struct(F.lit(c).alias("column"), F.col(c).alias("value")) for c in columns]
    )
    counts = (
        df.select(F.inline(items))
        .where(F.col("value").isNotNull())
        .groupBy("column", "value")
        .agg(F.count("*").alias("n"))
    )
    total = df.agg(F.count("*")).scalar()
    low, high = C.IMBALANCE_PERCENT
    return (
        counts.groupBy("column")
        .agg(
            F.count("*").alias("classes"),
            (F.max("n") * 100.0 / total).alias("max_percent"),
            (F.min("n") * 100.0 / total).alias("min_percent"),
        )
        .select(
            "column",
            "classes",
            F.round("max_percent", 6).alias("max_percent"),
            F.round("min_percent", 6).alias("min_percent"),
            ((F.col("max_percent") > high) | (F.col("min_percent") < low)).alias("imbalanced"),
        )
    )


def correlation_matrix(df: DataFrame, columns: list[str]) -> DataFrame:
    """Pearson correlation of all column pairs, rows with both values only."""
    pairs = [(a, b) for i, a in enumerate(columns) for b in columns[i:]]
    values = df.select(*[number(df, c).alias(c) for c in columns])
    matrix = values.agg(
        *[F.round(F.corr(a, b), 6).alias(f"_{k}") for k, (a, b) in enumerate(pairs)]
    )
    matrix = matrix.select(*[F.when(F.col(c) == 0.0, 0.0).otherwise(F.col(c)).alias(c) for c in matrix.columns])
    rows = []
    for k, (a, b) in enumerate(pairs):
        for left, right in {(a, b), (b, a)}:
            rows.append(
                F.struct(F.lit(left).alias("a"), F.lit(right).alias("b"), F.col(f"_{k}").alias("r"))
            )
    return as_rows(matrix, rows)


def describe_numeric(df: DataFrame, columns: list[str]) -> DataFrame:
    """Count, mean, sample deviation, minimum, quartiles and maximum per column."""
    quartiles = exact_quantiles(df, columns, [0.25, 0.5, 0.75])
    stats = df.agg(
        *[
            F.struct(
                F.lit(c).alias("column"),
                F.count(number(df, c)).alias("count"),
                F.round(F.avg(number(df, c)), 6).alias("mean"),
                F.round(F.stddev_samp(number(df, c)), 6).alias("std"),
                F.min(number(df, c)).alias("min"),
                F.round(F.lit(quartiles[c][0.25]).cast("double"), 6).alias("q25"),
                F.round(F.lit(quartiles[c][0.5]).cast("double"), 6).alias("q50"),
                F.round(F.lit(quartiles[c][0.75]).cast("double"), 6).alias("q75"),
                F.max(number(df, c)).alias("max"),
            ).alias(f"_{i}")
            for i, c in enumerate(columns)
        ]
    )
    return as_rows(stats, [F.col(f"_{i}") for i in range(len(columns))])


def describe_categorical(df: DataFrame, columns: list[str]) -> DataFrame:
    """Count, distinct values, most frequent value (smallest on ties) and its frequency."""
    items = F.array(
        *[F.struct(F.lit(c).alias("column"), F.col(c).cast("string").alias("value")) for c in columns]
    )
    counts = (
        df.select(F.inline(items))
        .where(F.col("value").isNotNull())
        .groupBy("column", "value")
        .agg(F.count("*").alias("n"))
    )
    best = F.min(F.struct((-F.col("n")).alias("minus_n"), F.col("value").alias("value")))
    return (
        counts.groupBy("column")
        .agg(F.sum("n").alias("count"), F.count("*").alias("unique"), best.alias("best"))
        .select(
            "column",
            "count",
            "unique",
            F.col("best.value").alias("top"),
            (-F.col("best.minus_n")).alias("freq"),
        )
    )


def column_kinds(df: DataFrame) -> DataFrame:
    """Numeric and categorical columns with their number of non-null values."""
    kinds = [(c, "numeric") for c in numeric_columns(df)]
    kinds += [(c, "categorical") for c in text_columns(df)]
    counts = df.agg(*[F.count(c).alias(c) for c, _ in kinds])
    return as_rows(
        counts,
        [
            F.struct(F.lit(c).alias("column"), F.lit(kind).alias("kind"), F.col(c).alias("present"))
            for c, kind in kinds
        ],
    )


def distinct_up_to(df: DataFrame, columns: list[str], limit: int = C.MAX_PLOT_VALUES) -> list[str]:
    """Columns with at most ``limit`` distinct values, nulls counting as one.

    A sketch settles the clear cases; only columns near the limit are counted exactly.
    """
    if not columns:
        return []
    sketch = df.agg(
        *[
            (F.approx_count_distinct(c, 0.02) + F.max(F.col(c).isNull().cast("int"))).alias(c)
            for c in columns
        ]
    ).first()
    close = [c for c in columns if 0.8 * limit <= sketch[c] <= 1.25 * limit]
    exact = {}
    if close:
        exact = df.agg(
            *[
                (F.countDistinct(c) + F.max(F.col(c).isNull().cast("int"))).alias(c)
                for c in close
            ]
        ).first().asDict()
    return [c for c in columns if exact.get(c, sketch[c]) <= limit]


def clean_frame(df: DataFrame) -> DataFrame:
    """Drop sparse columns, fill nulls, drop copies; clip and scale numeric columns.

    The frame without copies is written once, since several passes read it.
    """
    missing = {row["column"]: row for row in missing_stats(df).collect()}
    kept = df.select(*[c for c in df.columns if not (missing[c].percent or 0.0) > C.SPARSE_PERCENT])
    gaps = [c for c in kept.columns if missing[c].missing > 0]
    filled = fill_median(kept, [c for c in numeric_columns(kept) if c in gaps])
    filled = fill_mode(filled, [c for c in text_columns(kept) if c in gaps])
    unique = materialize(filled.distinct(), "profile")
    columns = numeric_columns(unique)
    return standardize(clip_outliers(unique, columns), columns, minmax=True)


def report(df: DataFrame) -> DataFrame:
    """Profile report as a long table (section, key, value), with the statistics of numeric columns as column.statistic."""
    missing = missing_stats(df).select(
        F.lit("missing_values").alias("section"), F.col("column").alias("key"), F.col("missing").alias("value")
    )
    copies = duplicate_count(df)
    counted = as_rows(
        copies,
        [
            F.struct(F.lit("records").alias("section"), F.lit(k).alias("key"), F.col(k).alias("value"))
            for k in ("total_records", "duplicate_records")
        ],
    )
    kinds = column_kinds(df).select(
        F.concat("kind", F.lit("_features")).alias("section"), F.col("column").alias("key"), F.col("present").alias("value")
    )
    counts = missing.unionByName(counted).unionByName(kinds).withColumn("value", F.col("value").cast("double"))
    numbers = numeric_columns(df)
    if not numbers:
        return counts
    described = describe_numeric(df, numbers)
    statistics = described.select(
        F.lit("numeric_statistics").alias("section"),
        F.inline(
            F.array(
                *[
                    F.struct(F.concat("column", F.lit(f".{name}")).alias("key"), F.col(name).cast("double").alias("value"))
                    for name in described.columns
                    if name != "column"
                ]
            )
        ),
    )
    return counts.unionByName(statistics)
